"""Personal data by anchor expansion.

An Aho-Corasick automaton finds at-signs, plus signs, digits, schemes and identifier cues in one pass. Local
parsers expand each anchor to its boundaries and validate it. Base kinds (email, ip, card, phone) equal what a
leftmost non-overlapping search with their patterns finds, less the matches that fail validation; the method
adds urls and account values after a cue.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.llm.common import map_texts

# Kinds in their order, and the cues before account values, in any case.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account")
CUES = ("account", "acct", "iban", "ssn", "social security number", "passport", "passport number", "token", "access token", "access_token", "secret", "client_secret",
        "password", "passwd", "pwd", "api key", "api_key", "api-key", "apikey", "access key", "access_key", "accesskey", "private key", "private_key", "key", "license", "licence")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_domain = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_ip = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_card = re.compile(r"[0-9](?:[ -]?[0-9])+")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_host = re.compile(r"://(?:[A-Za-z0-9._~%-]+(?::[^\s/@]*)?@)?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::[0-9]{1,5})?(?:[/?#][^\s\"'<>]*)?")
_scheme = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+-.")
# What may stand between a cue and its value, and the value; blanks are never given back, so long runs are read once.
_between = re.compile(r"[\"']?[ \t]*+(?:(?:number|num|no|nr|id)\b\.?[ \t]*+)?(?:[:=#]|is\b)?[ \t]*+[\"']?", re.IGNORECASE)
_value = re.compile(r"[A-Za-z0-9][A-Za-z0-9_/+.-]{7,}[A-Za-z0-9]")
_iban = re.compile(r"[A-Za-z]{2}[0-9]{2}(?:[ -]?[A-Za-z0-9]{4}){2,7}(?:[ -]?[A-Za-z0-9]{1,3})?(?![A-Za-z0-9])")
_capitals = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@lru_cache(maxsize=1)
def _anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for digit in "0123456789":
        found.add_word(digit, ("digit", 1))
    for word, kind in (("@", "email"), ("+", "phone"), ("://", "url")):
        found.add_word(word, (kind, len(word)))
    for cue in CUES:
        found.add_word(cue, ("account", len(cue)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    """Whether every second digit from the right, doubled and with its digits added, makes the sum end in 0."""
    doubled = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    return (sum(map(int, digits[-1::-2])) + sum(doubled[int(d)] for d in digits[-2::-2])) % 10 == 0


def iban(text: str) -> bool:
    """Whether an account number's letters as numbers, first four places last, leave 1 when divided by 97."""
    plain = text.replace(" ", "").replace("-", "").upper()
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def account(text: str, at: int) -> tuple[int, int] | None:
    """Start and end of the value after a cue that ends at ``at``: a checked account number, in groups or not, or a word with three digits."""
    start = _between.match(text, at).end()
    if (m := _iban.match(text, start)) and iban(m.group()):
        return start, m.end()
    m = _value.match(text, start)
    return (start, m.end()) if m and sum(c in "0123456789" for c in m.group()) >= 3 else None


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of all spans, in this order."""
    out: list[tuple[int, int, int]] = []
    email_end = ip_end = card_end = url_end = account_end = 0
    low = text.lower() if text.isascii() else text.translate(_capitals)
    for at, (kind, width) in _anchors().iter(low):
        if kind == "digit":
            if at >= card_end and (m := _card.match(text, at)):
                card_end = m.end()
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((at, 2, card_end))
            if at >= ip_end and not (at and text[at - 1] in "0123456789") and (m := _ip.match(text, at)):
                ip_end = m.end()
                if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m.group().split(".")):
                    out.append((at, 1, ip_end))
        elif kind == "email":
            start = at
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _domain.match(text, at)):
                email_end = m.end()
                out.append((start, 0, email_end))
        elif kind == "phone":
            if (m := _phone.match(text, at)) and 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
                out.append((at, 3, m.end()))
        elif kind == "url":
            start = colon = at - width + 1
            while start > url_end and text[start - 1] in _scheme:
                start -= 1
            while start < colon and not text[start].isalpha():
                start += 1
            if start < colon and (m := _host.match(text, colon)):
                url_end = start + len(text[start:m.end()].rstrip(".,;:!?)"))
                out.append((start, 4, url_end))
        else:
            start = at - width + 1
            if start < account_end or start and (text[start - 1].isalnum() or text[start - 1] in "_-") or text[at + 1:at + 2].isalnum():
                continue
            if (found := account(text, at + 1)) and found[0] >= account_end:
                account_end = found[1]
                out.append((found[0], 5, account_end))
    out.sort()
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>): code points, end exclusive. Null text: no spans. No shuffle."""
    def rows(batches) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for kept, texts in batches:
            found = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in find(t)] for t in texts]
            yield pa.RecordBatch.from_arrays([kept.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    return map_texts(docs, text_col, [id_col], f"doc_id {dict(docs.dtypes)[id_col]}, spans array<struct<kind:string,start:long,end:long>>", rows)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, counts of the base kinds, base_sha256, spans. A null text is the empty text: zeros, the digest
    of nothing, no spans. Repeated rows and null ids are kept. One pass without a shuffle; a text is read once, in linear time."""
    def rows(batches) -> Iterator[pa.RecordBatch]:
        for kept, texts in batches:
            n, base, every = ([], [], [], []), [], []
            for t in texts:
                spans = find(t)
                for k in range(4):
                    n[k].append(sum(s[1] == k for s in spans))
                base.append(hashlib.sha256(joined([s for s in spans if s[1] < 4]).encode()).hexdigest())
                every.append(joined(spans))
            yield pa.RecordBatch.from_arrays(
                [kept.column(0), *(pa.array(x, pa.int64()) for x in n), pa.array(base, pa.string()), pa.array(every, pa.string())],
                names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    return map_texts(docs, text_col, [id_col], f"doc_id {dict(docs.dtypes)[id_col]}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", rows)


def redacted(text: str, kinds: frozenset[int]) -> str:
    out, end = [], 0
    for a, k, b in find(text):
        if k not in kinds:
            continue
        if a >= end:
            out += [text[end:a], f"<{KINDS[k].upper()}>"]
        end = max(end, b)  # an overlapping span goes with the one before
    return "".join([*out, text[end:]]) if out else text


def redact(docs: DataFrame, text_col: str = "text", kinds: tuple[str, ...] = (*BASE, "account")) -> DataFrame:
    """The same rows and columns, with spans of ``kinds`` in the text replaced by <KIND>. A null text stays null."""
    chosen = frozenset(map(KINDS.index, kinds))

    @F.pandas_udf("string")
    def replace(texts):
        return texts.map(lambda t: redacted(t, chosen), na_action="ignore")

    masked: Column = replace(F.col(text_col))
    return docs.withColumn(text_col, masked)
