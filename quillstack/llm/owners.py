"""Exact duplicates: compressed radix tries of whole texts, whose terminal nodes know the row that owns each text.

Each input partition puts its texts into a trie first, so that copies leave it as one class, however many there are.
Classes are dealt out by length and content hash; there a trie of full byte strings finds which of them are equal, so
no hash is trusted. A trie that outgrows its memory writes its largest subtree to the task's own temporary file and
goes through it afterwards. Owners reach rows by the number of their class, never by text, so a text that a third of
all rows have isn't one key of the last join either.
"""

from __future__ import annotations

import pickle
import tempfile
from array import array
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.llm.common import map_texts, materialise
from quillstack.llm.simhash import keep_least
from quillstack.scratch import discard

#: Bytes that a trie of an input partition and one of a shuffled partition hold.
LOCAL, HELD = 48 << 20, 128 << 20
#: What a node costs besides its label.
NODE = 400
#: Bytes and rows of one Arrow batch.
BATCH, ROWS = 4 << 20, 10_000
_white = frozenset(b" \t\n\x0b\x0c\r")


def normal(text: str) -> bytes:
    """UTF-8 with each run of white space, U+0009 to U+000D and the space, as one space."""
    data = text.encode("utf-8", "surrogatepass")
    out = b" ".join(data.split())
    if not out:
        return b" " if data else b""
    return (b" " if data[0] in _white else b"") + out + (b" " if data[-1] in _white else b"")


def _common(label: bytes, key: bytes, at: int) -> int:
    """How many bytes of label key has from ``at`` on; halves are compared as wholes."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if label[low:mid] == key[at + low:at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class _Node:
    __slots__ = ("children", "label", "value")

    def __init__(self, label: bytes, value=None, children: dict[int, _Node] | None = None):
        self.label, self.value, self.children = label, value, children or {}


class Spilled:
    """A subtree that lives in a file: keys under it, and what was put there, to be gone through later."""

    def __init__(self):
        self.file = tempfile.TemporaryFile(prefix="quillstack-trie-")  # gone with the task
        self.rows = 0

    def add(self, key: bytes, value) -> None:
        pickle.dump((key, value), self.file, pickle.HIGHEST_PROTOCOL)
        self.rows += 1

    def __iter__(self) -> Iterator[tuple[bytes, object]]:
        self.file.seek(0)
        for _ in range(self.rows):
            yield pickle.load(self.file)


class Trie:
    """A compressed radix trie of byte strings with values that merge; subtrees beyond ``most`` bytes go to files."""

    def __init__(self, merge, most: int):
        self.merge, self.most, self.held = merge, most, 0
        self.root = _Node(b"")

    def put(self, key: bytes, value) -> None:
        node, at = self.root, 0
        while True:
            if at == len(key):
                node.value = value if node.value is None else self.merge(node.value, value)
                return
            child = node.children.get(key[at])
            if child is None:
                node.children[key[at]] = _Node(key[at:], value)
                self.held += len(key) - at + NODE
                return
            n = len(child.label) if key.startswith(child.label, at) else _common(child.label, key, at)
            if n < len(child.label):  # a node in between, where the two part
                middle = _Node(child.label[:n], None, {child.label[n]: child})
                child.label = child.label[n:]
                node.children[key[at]] = child = middle
                self.held += NODE
            elif isinstance(child.value, Spilled):
                child.value.add(key, value)
                return
            node, at = child, at + n

    def walk(self, node: _Node, prefix: bytes) -> Iterator[tuple[bytes, object]]:
        """Keys and values below a node; prefix ends with its label."""
        open_nodes = [(node, prefix)]
        while open_nodes:
            node, prefix = open_nodes.pop()
            if node.value is not None:
                yield prefix, node.value
            open_nodes += [(c, prefix + c.label) for c in node.children.values()]

    def _size(self, node: _Node) -> int:
        size, open_nodes = 0, [node]
        while open_nodes:
            n = open_nodes.pop()
            size += len(n.label) + NODE
            open_nodes += n.children.values()
        return size

    def spill(self) -> bool:
        """Write the largest subtree below the first fork to a file; False if there is none to write."""
        node, prefix = self.root, b""
        while True:
            here = [c for c in node.children.values() if not isinstance(c.value, Spilled)]
            if not here:
                return False
            if len(node.children) > 1 or node.value is not None:
                break
            if not here[0].children:
                return False
            node = here[0]
            prefix += node.label
        size, child = max(((self._size(c), c) for c in here), key=lambda x: x[0])
        out = Spilled()
        for key, value in self.walk(child, prefix + child.label):
            if isinstance(value, Spilled):
                for k, v in value:
                    out.add(k, v)
            else:
                out.add(key, value)
        child.children, child.value = {}, out
        self.held -= size - len(child.label) - NODE
        return True

    def items(self) -> Iterator[tuple[bytes, object]]:
        """All keys with their merged values; spilled subtrees in tries of their own, one after the other."""
        left = []
        for key, value in self.walk(self.root, b""):
            if isinstance(value, Spilled):
                left.append(value)
            else:
                yield key, value
        self.root, self.held = _Node(b""), 0
        while left:
            inner = Trie(self.merge, self.most)
            for key, value in left.pop():
                inner.put(key, value)
                inner.trim()
            yield from inner.items()

    def trim(self) -> None:
        while self.held > self.most and self.spill():
            pass


def _before(x) -> tuple:
    """Order of ids: nulls last."""
    return (True,) if x is None else (False, x)


def classes(docs: DataFrame, id_col: str, text_col: str, held: int = LOCAL) -> DataFrame:
    """(cls, length, hash, sha, text, ids): texts with the rows of one input partition that have them, the smallest id first.

    A partition may give the same text again once its trie was full. cls is a number no other class has.
    """
    kind = dict(docs.dtypes)[id_col]

    def rows(batches) -> Iterator[pa.RecordBatch]:
        number = 0
        schema = None

        def out(found: list) -> pa.RecordBatch:
            nonlocal number
            texts = [k for k, _ in found]
            first = number
            number += len(found)
            return pa.RecordBatch.from_arrays([
                pa.array([part << 33 | n for n in range(first, number)], pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
                pa.array([xxhash.xxh3_64_intdigest(t) - (1 << 63) for t in texts], pa.int64()), pa.array([sha256(t).hexdigest() for t in texts], pa.string()),
                pa.array(texts, pa.binary()), pa.array([ids for _, ids in found], pa.list_(schema))], names=["cls", "length", "hash", "sha", "text", "ids"])

        def flush() -> Iterator[pa.RecordBatch]:
            found, size = [], 0
            for key, ids in trie.items():
                least = min(range(len(ids)), key=lambda i: _before(ids[i]))
                ids[0], ids[least] = ids[least], ids[0]
                found.append((key, ids))
                size += len(key) + 8 * len(ids)
                if size > BATCH or len(found) >= ROWS:
                    yield out(found)
                    found, size = [], 0
            if found:
                yield out(found)

        def join(a: list, b: list) -> list:
            a += b
            return a

        trie, seen = Trie(join, 2 * held), 0
        part = 0
        for kept, texts in batches:
            schema = kept.column(0).type
            parts = kept.column(1).to_pylist()
            part = parts[0] if parts else part
            for i, text in zip(kept.column(0).to_pylist(), texts, strict=True):
                trie.put(normal(text), [i])
                seen += 1
                if trie.held + 64 * seen > held:
                    yield from flush()
                    seen = 0
        yield from flush()

    schema = f"cls long, length long, hash long, sha string, text binary, ids array<{kind}>"
    return map_texts(docs, text_col, [id_col, F.spark_partition_id()], schema, rows)


def _owners(held: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(cls, keep_id, keep_cls, group_size) of each class, from (cls, text, least, n)."""
        def merge(a: list, b: list) -> list:
            if (_before(b[0]), b[1]) < (_before(a[0]), a[1]):
                a[0], a[1] = b[0], b[1]
            a[2] += b[2]
            a[3] += b[3]
            return a

        def out(rows: list) -> pa.RecordBatch:
            cls, keep, keep_cls, n = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(keep, kind), pa.array(keep_cls, pa.int64()), pa.array(n, pa.int64())], names=["cls", "keep_id", "keep_cls", "group_size"])

        trie, kind = Trie(merge, held), None
        for b in batches:
            kind = b.schema.field("least").type
            for cls, text, least, n in zip(*(b.column(c).to_pylist() for c in ("cls", "text", "least", "n")), strict=True):
                trie.put(text, [least, cls, n, array("q", [cls])])
                trie.trim()
        rows = []
        for _, (keep, keep_cls, n, members) in trie.items():
            for cls in members:
                rows.append((cls, keep, keep_cls, n))
                if len(rows) >= ROWS:
                    yield out(rows)
                    rows = []
        if rows:
            yield out(rows)
    return run


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", local: int = LOCAL, held: int = HELD) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256; equal are texts with the same words and white space in the same places.

    A null text counts as empty, which is a text like any other. The row with the smallest id stays; null ids come last,
    so a group without ids keeps one row and has no keep_id. Where a row is repeated, each repetition counts and one of
    those with the smallest id is kept. An empty table gives none. Other columns are not read.
    """
    kind = dict(docs.dtypes)[id_col]
    found = materialise(classes(docs, id_col, text_col, local), "classes")
    dealt = found.select("cls", "length", "hash", "text", F.element_at("ids", 1).alias("least"), F.size("ids").cast("long").alias("n")).repartition("length", "hash")
    owners = materialise(dealt.select("cls", "text", "least", "n").mapInArrow(_owners(held), f"cls long, keep_id {kind}, keep_cls long, group_size long"), "owners")
    rows = found.select("cls", "sha", "ids").join(owners, "cls").select("cls", "sha", "keep_id", "keep_cls", "group_size", F.posexplode("ids").alias("at", "doc_id"))
    kept = (F.col("cls") == F.col("keep_cls")) & (F.col("at") == 0)
    out = materialise(rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256")), "duplicates")
    discard(found, owners)
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one row of each group of equal texts, that with the smallest id; all columns as they were."""
    found = duplicates(docs, id_col, text_col)
    return keep_least(docs, found.select("doc_id", F.col("keep_id").alias("component_id")), id_col)


def oracle() -> str:
    """The same rows in DuckDB."""
    return r"""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS s FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(s) AS text_sha256 FROM t WINDOW w AS (PARTITION BY s)"""
