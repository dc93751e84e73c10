"""Quality classifier from weak labels.

Overlapping heuristic labellers, and people's labels where the labels table has a row, vote on two questions: is the
text junk, is it toxic. Expectation-maximisation over the counts of vote patterns estimates how often each labeller,
people included, is right for either class; nothing else of the votes reaches the driver. Posteriors of a bounded sample
then train a hashed linear scorer with an L1 penalty, which scores every whole text. The sample holds documents with
labels, and others that a heuristic votes against: without either, votes say too little to learn from.
"""

from __future__ import annotations

import operator
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import fsum

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.llm.chunks import Memo
from quillstack.llm.common import map_texts, materialise

# Function words of five languages and abusive words.
COMMON = frozenset("the of and to in is that it for was on are as with by at be this from or an de la el los y que en un una del por para con "
                   "se las es le les et des du est pour dans qui sur au der die das und zu den von mit ist im nicht ein eine".split())
ABUSE = frozenset("trash pathetic idiot worthless disgusting stupid clown scum loser moron".split())
JUNK = ("symbols", "pipes", "stutter", "capitals", "same_lines", "few_words", "common_words", "sentences", "label_quality")
TOXIC = ("abuse_any", "abuse_share", "label_toxic")
#: First guesses at the accuracy of heuristics and of people, and the imaginary documents a class that stand for them.
GUESS, TRUST = (0.8, 10), (0.999, 1000)
BUCKETS = 1 << 18
#: Documents in the training sample; three quarters of them labelled, as far as there are so many.
SAMPLE = 8_000
#: Bytes of features in a block of the training table, and tasks that read it in each round at most.
BLOCK, TASKS = 2 << 20, 8
#: L1 penalty of the scorer, and the probability of rejection above which a document goes; chosen on held-out labels.
PENALTY, THRESHOLD = 4e-3, 0.4
STRIP = ".,;:!?\"'()[]<>|*#$%&"
_drop_symbols = bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)) + b" \t\r\n.,;:!?'\"()-|/_"
_upper, _letters = bytes(range(65, 91)), bytes(range(65, 91)) + bytes(range(97, 123))


def votes(text: str) -> tuple[str, str]:
    """A letter for each heuristic labeller of JUNK and of TOXIC: g good, b bad, - no opinion."""
    words = text.split()
    n = len(words)
    if not n:
        return "b" * (len(JUNK) - 1), "-" * (len(TOXIC) - 1)
    lower = text.lower()
    low = lower.split()
    data = text.encode()
    symbols = len(data.translate(None, _drop_symbols)) / len(data)
    letters = len(data) - len(data.translate(None, _letters))
    capitals = (len(data) - len(data.translate(None, _upper))) / max(letters, 1)
    stutter = sum(map(operator.eq, low, low[1:])) / n
    pipes = text.count("|") / n
    lines = [x for x in text.split("\n") if x.strip()]
    same = 1 - len(set(lines)) / max(len(lines), 1)
    few = len(set(low)) / n
    common = sum(map(COMMON.__contains__, low)) / n
    ends = sum(text.count(c) for c in ".!?") / n
    pick = lambda bad, good: "b" if bad else "g" if good else "-"
    junk = (pick(symbols > 0.05, symbols < 0.01), pick(pipes > 0.2, pipes < 0.05), pick(stutter > 0.2, stutter < 0.05),
            pick(capitals > 0.6 and letters > 20, capitals < 0.3), pick(same > 0.3 and len(lines) > 3, same < 0.1 and len(lines) > 3),
            pick(few < 0.25 and 40 < n < 2000, few > 0.4), pick(common < 0.02 and n > 30, common > 0.1), pick(ends < 0.005 and n > 40, ends > 0.03))
    hits = sum(w.strip(STRIP) in ABUSE for w in low) if any(a in lower for a in ABUSE) else 0
    toxic = (pick(hits > 0, hits == 0), pick(hits > 0.005 * n, False))
    return "".join(junk), "".join(toxic)


@dataclass
class Labellers:
    """Class-conditional vote probabilities of labellers for one question, and the share of bad documents."""

    bad: np.ndarray  # P(vote b | bad, it votes)
    good: np.ndarray  # P(vote g | good, it votes)
    prior: float

    def posterior(self, patterns: list[str]) -> np.ndarray:
        """P(bad | votes) of each pattern."""
        v = np.array([[c for c in p] for p in patterns]).reshape(len(patterns), len(self.bad))
        b, g = v == "b", v == "g"
        log_bad = np.log(self.prior) + (b * np.log(self.bad) + g * np.log(1 - self.bad)).sum(axis=1)
        log_good = np.log(1 - self.prior) + (b * np.log(1 - self.good) + g * np.log(self.good)).sum(axis=1)
        return 1 / (1 + np.exp(np.clip(log_good - log_bad, -60, 60)))


def expectation_maximisation(patterns: list[str], counts: np.ndarray, start: np.ndarray, weight: np.ndarray, rounds: int = 200) -> Labellers:
    """Fit from vote patterns and how often each occurs; start holds each labeller's first guess at its accuracy.

    weight: imaginary documents a class that vote as the first guess says. They keep every estimate inside (0, 1); many of
    them for people's labels keep the classes what people mean by them.
    """
    model = Labellers(start.copy(), start.copy(), 0.1)
    if not patterns:
        return model
    v = np.array([[c for c in p] for p in patterns])
    b, g = v == "b", v == "g"
    for _ in range(rounds):
        p = model.posterior(patterns)
        wb, wg = (counts * p)[:, None], (counts * (1 - p))[:, None]
        bad = ((wb * b).sum(0) + weight * start) / ((wb * (b | g)).sum(0) + weight)
        good = ((wg * g).sum(0) + weight * start) / ((wg * (b | g)).sum(0) + weight)
        prior = float(np.clip((counts @ p + 1) / (counts.sum() + 10), 1e-4, 0.5))
        done = max(abs(bad - model.bad).max(), abs(good - model.good).max(), abs(prior - model.prior)) < 1e-9
        model = Labellers(np.clip(bad, 1e-4, 1 - 1e-4), np.clip(good, 1e-4, 1 - 1e-4), prior)
        if done:
            break
    return model


def bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) % BUCKETS


def word_features(word: str) -> list[int]:
    """Buckets of a word without the punctuation around it, and of its beginnings."""
    word = word.strip(STRIP)
    return [bucket("w " + word), *(bucket(f"p {word[:k]}") for k in (4, 5) if len(word) > k)] if word else []


def vote_features(junk: str, toxic: str) -> list[int]:
    return [bucket(f"v {i} {c}") for i, c in enumerate(junk + toxic) if c != "-"]


def features(text: str) -> list[int]:
    """Buckets of the distinct words of a text and of its heuristic votes."""
    return [b for w in set(text.lower().split()) for b in word_features(w)] + vote_features(*votes(text))


def blocks(found: DataFrame, junk_model: Labellers, toxic_model: Labellers) -> DataFrame:
    """(f, sizes, target): features of many sampled documents end to end, their counts, and the probabilities of rejection."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            keep = (1 - junk_model.posterior(b.column(0).to_pylist())) * (1 - toxic_model.posterior(b.column(1).to_pylist()))
            data = b.column(2).to_pylist()
            ends = np.cumsum([len(x) for x in data])
            cuts = [0, *(np.flatnonzero(np.diff(ends // BLOCK)) + 1).tolist(), len(data)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                sizes = np.array([len(x) // 4 for x in data[i:j]], "<i4")
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (b"".join(data[i:j]), sizes.tobytes(), (1 - keep[i:j]).tobytes())], names=["f", "sizes", "target"])

    return found.select("junk", "toxic", "f").coalesce(TASKS).mapInArrow(rows, "f binary, sizes binary, target binary")


def sums(table: RDD, used: np.ndarray | None, x: np.ndarray, intercept: float, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(X' e, [documents, sum of e]) over all blocks, for e = 1 (ones), X x (linear) or sigmoid(X x + intercept) - target (error).

    used: the buckets that x and the result are limited to. A task returns one vector.
    """
    at = np.flatnonzero(x)
    shared = table.context.broadcast((used, at.astype(np.int32), x[at], intercept))

    def task(rows: Iterator[tuple[bytes, bytes, bytes]]) -> Iterator[tuple[bytes, bytes]]:
        used, at, some, intercept = shared.value
        dense = np.zeros(BUCKETS)
        dense[at if used is None else used[at]] = some
        total, counts = np.zeros(BUCKETS), np.zeros(2)
        for f, sizes, target in rows:
            f, target = np.frombuffer(f, "<i4"), np.frombuffer(target, "<f8")
            owner = np.repeat(np.arange(len(target), dtype=np.int32), np.frombuffer(sizes, "<i4"))
            if kind == "ones":
                e, counted = np.ones(len(target)), target
            else:
                z = np.bincount(owner, dense[f], len(target))
                e = counted = z if kind == "linear" else 1 / (1 + np.exp(-np.clip(z + intercept, -40, 40))) - target
            total += np.bincount(f, e[owner], BUCKETS)
            counts += len(target), counted.sum()
        if counts[0]:
            yield (total if used is None else total[used]).tobytes(), counts.tobytes()

    out, counts = np.zeros(len(x)), np.zeros(2)
    for v, c in table.mapPartitions(task).collect():  # one row a task
        out += np.frombuffer(v)
        counts += np.frombuffer(c)
    shared.destroy()
    return out, counts


def fit(blocks: DataFrame, penalty: float = PENALTY, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic scorer for soft targets, by proximal gradient steps with an L1 penalty.

    The documents stay in the table of blocks, which executors keep; the driver holds vectors of at most BUCKETS numbers.
    """
    table = blocks.rdd.map(lambda r: tuple(map(bytes, r))).persist(StorageLevel.MEMORY_AND_DISK)  # an RDD, as rounds need no plan
    try:
        return _steps(table, penalty, rounds)
    finally:
        table.unpersist()


def _steps(table: RDD, penalty: float, rounds: int) -> tuple[np.ndarray, float]:
    weights = np.zeros(BUCKETS)
    seen, (n, targets) = sums(table, None, weights, 0.0, "ones")
    if not n:
        return weights, -2.0
    used = np.flatnonzero(seen)
    # features are scaled by how often they occur, so that rare decisive words learn as fast as votes
    scale = 1 / np.sqrt(seen[used] / n + 1e-3)
    mean = targets / n
    w, look, b, t = np.zeros(len(used)), np.zeros(len(used)), float(np.log((mean + 1e-3) / (1.001 - mean))), 1.0
    probe = np.random.default_rng(0).standard_normal(len(used))
    size = 1.0
    for _ in range(12):  # largest curvature by power iteration
        probe = scale * sums(table, used, scale * probe, 0.0, "linear")[0] / n
        size = float(np.linalg.norm(probe))
        probe /= max(size, 1e-12)
    step = 4 / max(size, 1.0)
    for _ in range(rounds):
        gradient, (_, error) = sums(table, used, scale * look, b, "error")
        new = look - step * scale * gradient / n
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        b -= min(step, 4.0) * error / n
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        look = new + (before - 1) / t * (new - w)
        w = new
    weights[used] = w * scale
    return weights, float(b)


class Scorer:
    """Scores whole texts; the summed weights of words met before are kept, up to a bound."""

    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = {int(b): float(weights[b]) for b in np.flatnonzero(weights)}, intercept
        self.words = Memo(lambda w: self._sum(word_features(w)), kept=500_000)

    def _sum(self, buckets: list[int]) -> float:
        return fsum(self.weights.get(b, 0.0) for b in buckets)

    def __call__(self, text: str) -> float:
        # exact sums, as sets of strings come in another order in each process
        z = self.intercept + fsum(map(self.words.__getitem__, set(text.lower().split()))) + self._sum(vote_features(*votes(text)))
        return 1 / (1 + np.exp(-min(max(z, -60.0), 60.0)))


def train(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE):
    """The two label models and the scorer's weights, from all documents' votes and a bounded sample of texts."""
    def rows(batches) -> Iterator[pa.RecordBatch]:
        for kept, texts in batches:
            both = [votes(t) for t in texts]
            yield pa.RecordBatch.from_arrays([kept.column(0), pa.array([j for j, _ in both], pa.string()), pa.array([t for _, t in both], pa.string())], names=["doc_id", "junk", "toxic"])

    kind = dict(docs.dtypes)[id_col]
    voted = map_texts(docs, text_col, [id_col], f"doc_id {kind}, junk string, toxic string", rows)
    if labels is not None:
        known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
        voted = voted.join(known, "doc_id", "left")
    else:
        voted = voted.withColumns({"q": F.lit(None).cast("int"), "t": F.lit(None).cast("int")})
    letter = lambda c, bad: F.when(F.col(c).isNull(), "-").when(F.col(c) == bad, "b").otherwise("g")
    voted = materialise(voted.select("doc_id", F.concat("junk", letter("q", 0)).alias("junk"), F.concat("toxic", letter("t", 1)).alias("toxic"),
                                     (F.col("q").isNotNull() | F.col("t").isNotNull()).alias("labelled")), "votes")

    def label_model(question: str, names: tuple[str, ...]) -> Labellers:
        found = voted.groupBy(question).count().collect()  # at most 3 ** len(names) patterns
        found.sort()
        start, weight = np.array([TRUST if n.startswith("label_") else GUESS for n in names]).T
        return expectation_maximisation([r[0] for r in found], np.array([r[1] for r in found], float), start, weight)

    junk_model, toxic_model = label_model("junk", JUNK), label_model("toxic", TOXIC)
    order = [F.xxhash64("doc_id"), "doc_id", "junk", "toxic"]
    named = voted.where("doc_id is not null")
    against = named.where("not labelled and (contains(junk, 'b') or contains(toxic, 'b'))")
    known = named.where("labelled").orderBy(*order).limit(sample * 3 // 4)
    chosen = known.union(against.orderBy(*order).limit(sample // 4)).dropDuplicates(["doc_id"])
    if labels is None or known.isEmpty():
        chosen = named.orderBy(*order).limit(sample).dropDuplicates(["doc_id"])

    def featured(batches) -> Iterator[pa.RecordBatch]:
        for kept, texts in batches:
            found = [np.array(sorted(features(t)), "<i4").tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(found, pa.binary())], names=["doc_id", "junk", "toxic", "f"])

    # the sample has a fixed bound, so it may be broadcast
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen.select("doc_id", "junk", "toxic")), "doc_id")
    found = map_texts(texts, "text", ["doc_id", "junk", "toxic"], f"doc_id {kind}, junk string, toxic string, f binary", featured)
    found = found.groupBy("doc_id").agg(F.min(F.struct("f", "junk", "toxic")).alias("x")).select("x.*")
    weights, intercept = fit(materialise(blocks(found, junk_model, toxic_model), "features"))
    return junk_model, toxic_model, weights, intercept


def classify(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """All rows and columns of docs and, last, reject_probability: the scorer's that a document should go.

    Underscores go before that name where docs has a column of it. A null or empty text has no words and all junk votes. labels (doc_id, quality, toxic) may be missing or empty;
    documents without a row there are judged by the heuristics alone. Repeated rows are scored alike.
    """
    *_, weights, intercept = train(docs, labels, id_col, text_col, sample)
    shared = docs.sparkSession.sparkContext.broadcast((weights, intercept))  # BUCKETS numbers
    scorer: list[Scorer] = []

    @F.pandas_udf("double")
    def score(texts):
        if not scorer:
            scorer.append(Scorer(*shared.value))
        return texts.fillna("").map(scorer[0])

    name = "reject_probability"
    while name in map(str.lower, docs.columns):
        name = "_" + name
    return docs.withColumn(name, score(F.col(text_col)))


def filtered(docs: DataFrame, labels: DataFrame | None = None, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The documents whose probability of rejection is at most the threshold; all columns as they were."""
    scored = classify(docs, labels, **options)
    return scored.where(F.col(scored.columns[-1]) <= threshold).select(docs.columns)
