"""Recognised ids and the expected ones of their document: exact tiers by equi-joins, similar strings by shared pieces.

A string at most d edits away from another leaves two of its d + 2 pieces whole, each moved by no more places than
edits allow. So strings that are similar enough share a key of two pieces, and only such pairs are compared: a document
with very many ids isn't compared with itself in all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstack.functions import ids
from quillstack.scratch import materialise

# From which similarity on a code or a uuid is taken for an expected one, and the shortest uuid that is tried as it is.
CODE_CUTOFF, UUID_CUTOFF, UUID_LEAST = 70.0, 90.0, 30
#: Expected strings up to which a document's are all compared: keys would cost more.
FEW = 32


def _edits(length: Column, cutoff: float) -> Column:
    """How many edits leave the longer of two strings similar enough."""
    return F.floor(length * (1 - cutoff / 100) + 1e-9).cast("int")


def _reach(length: Column, cutoff: float) -> Column:
    """The greatest length of a string that may be similar enough."""
    return F.floor(length / (cutoff / 100) + 1e-9).cast("int")


def _piece(text: str, k: str, move: str = "0") -> str:
    """SQL of the k-th of d + 2 pieces of a string of e characters, in a text where it has moved."""
    begin = f"CAST(floor({k} * e / (d + 2)) AS INT)"
    return f"substring({text}, {begin} + {move} + 1, CAST(floor(({k} + 1) * e / (d + 2)) AS INT) - {begin})"


_PAIRS = "flatten(transform(sequence(0, d), i -> transform(sequence(i + 1, d + 1), j -> named_struct('i', i, 'j', j))))"
_MOVES = ("filter(flatten(transform(sequence(-d, d), a -> transform(sequence(-d, d), b -> named_struct('a', a, 'b', b)))), "
          "s -> abs(s.a) + abs(s.b - s.a) + abs(m - e - s.b) <= d)")


def by_pieces(seen: DataFrame, expected: DataFrame, cutoff: float) -> DataFrame:
    """(doc_id, seen, text) of the same document that share a key: all that are similar enough, and a few more.

    seen has (doc_id, seen), expected (doc_id, text), both distinct.
    """
    e = F.length("text")
    keyed = expected.select("doc_id", "text", e.alias("e"), F.explode(F.sequence(_edits(e, cutoff), _edits(_reach(e, cutoff), cutoff))).alias("d"))
    keyed = keyed.select("*", F.explode(F.expr(_PAIRS)).alias("p"))
    keyed = keyed.select("doc_id", "text", F.expr(f"xxhash64(e, d, p.i, p.j, {_piece('text', 'p.i')}, {_piece('text', 'p.j')})").alias("key"))
    m = F.length("seen")
    tried = seen.select("doc_id", "seen", m.alias("m"), F.explode(F.sequence(F.ceil(m * (cutoff / 100) - 1e-9).cast("int"), _reach(m, cutoff))).alias("e"))
    tried = tried.withColumn("d", _edits(F.greatest("m", "e"), cutoff)).select("*", F.explode(F.expr(_MOVES)).alias("s")).select("*", F.explode(F.expr(_PAIRS)).alias("p"))
    inside = "floor(p.i * e / (d + 2)) + s.a >= 0 AND floor((p.j + 1) * e / (d + 2)) + s.b <= m"
    tried = tried.where(inside).select("doc_id", "seen", F.expr(f"xxhash64(e, d, p.i, p.j, {_piece('seen', 'p.i', 's.a')}, {_piece('seen', 'p.j', 's.b')})").alias("key"))
    return tried.join(keyed, ["doc_id", "key"]).select("doc_id", "seen", "text").distinct()


def nearest(seen: DataFrame, expected: DataFrame, cutoff: float) -> DataFrame:
    """(doc_id, seen, id, score): for each seen string the most similar expected one of its document, the first of equals; none below the cutoff.

    seen has (doc_id, seen), expected (doc_id, id, text, pos); what repeats counts once, empty and null strings match
    nothing. Documents of few expected strings compare all, others those that share pieces: both find the same.
    """
    seen = seen.select("doc_id", "seen").where("seen <> '' and doc_id is not null").repartition("doc_id").distinct()
    first = F.min_by("id", F.struct("pos", "id"))
    # grouped and counted where a document's are, and kept, as several joins read them
    expected = expected.where("text <> '' and doc_id is not null").repartition("doc_id").groupBy("doc_id", "text").agg(first.alias("id"), F.min("pos").alias("pos"))
    expected = materialise(expected.withColumn("_n", F.count("*").over(Window.partitionBy("doc_id"))), "texts")
    few, many = expected.where(F.col("_n") <= FEW).drop("_n"), expected.where(F.col("_n") > FEW).drop("_n")
    scored = seen.join(few.repartition("doc_id"), "doc_id").select("doc_id", "seen", "id", "pos", ids.similarity(F.col("seen"), F.col("text")).alias("score"))
    if not many.isEmpty():
        some = by_pieces(seen.join(many.select("doc_id").distinct(), "doc_id", "left_semi"), many.select("doc_id", "text"), cutoff)
        some = some.withColumn("score", ids.similarity(F.col("seen"), F.col("text"))).where(F.col("score") >= cutoff)
        scored = scored.union(some.join(many, ["doc_id", "text"]).select("doc_id", "seen", "id", "pos", "score"))
    best = scored.where(F.col("score") >= cutoff).groupBy("doc_id", "seen")
    return best.agg(F.max_by("id", F.struct("score", -F.col("pos"))).alias("id"), F.max("score").alias("score"))


def _firsts(expected: DataFrame, name: str) -> DataFrame:
    """(doc_id, text, name) of (doc_id, id, text, pos): of equal texts the first id."""
    return expected.repartition("doc_id").groupBy("doc_id", "text").agg(F.min(F.struct("pos", "id"))["id"].alias(name))


def _nearest(rest: DataFrame, expected: DataFrame, cutoff: float) -> DataFrame:
    """(doc_id, seen, id, score) for (doc_id, seen, text), by the text."""
    near = nearest(rest.select("doc_id", F.col("text").alias("seen")), expected, cutoff).withColumnRenamed("seen", "text")
    return rest.repartition("doc_id").join(near, ["doc_id", "text"]).select("doc_id", "seen", "id", "score")


def match_codes(seen: DataFrame, expected: DataFrame, cutoff: float = CODE_CUTOFF) -> DataFrame:
    """(doc_id, seen, id, score) of recognised codes (doc_id, seen) among expected ids (doc_id, id, pos), codes or uuids.

    The repaired code as an expected code, then as the beginning of an expected uuid, then the expected code that is
    most similar to what was read.
    """
    seen = seen.select("doc_id", "seen").where("seen is not null").distinct()
    clean = F.upper(F.replace("id", F.lit("-"), F.lit("")))
    codes = expected.where(ids.is_code(F.col("id"))).select("doc_id", "id", clean.alias("text"), "pos")
    digits = F.lower(F.replace("id", F.lit("-"), F.lit("")))
    uuids = expected.where(digits.rlike("^[0-9a-f]{32}$")).select("doc_id", "id", F.substring(digits, 1, 10).alias("text"), "pos")
    fixed = seen.select("doc_id", "seen", ids.repair(F.col("seen")).alias("fixed"))
    fixed = fixed.select("doc_id", "seen", F.replace("fixed", F.lit("-"), F.lit("")).alias("text"), ids.decode(F.col("fixed")).alias("prefix")).repartition("doc_id")
    met = fixed.join(_firsts(codes, "by_code"), ["doc_id", "text"], "left").drop("text").join(_firsts(uuids, "by_uuid").withColumnRenamed("text", "prefix"), ["doc_id", "prefix"], "left")
    met = materialise(met.select("doc_id", "seen", F.coalesce("by_code", "by_uuid").alias("id")), "met")
    exact, rest = _parted(met)
    rest = rest.select("doc_id", "seen", F.upper(F.regexp_replace("seen", "[- ]", "")).alias("text"))
    return exact if rest.isEmpty() else exact.union(_nearest(rest, codes, cutoff))


def _parted(met: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Exact finds (doc_id, seen, id, score) of a scratch table, and the rest, whose id is null."""
    return met.where("id is not null").select("doc_id", "seen", "id", F.lit(100.0).alias("score")), met.where("id is null")


def match_uuids(seen: DataFrame, expected: DataFrame, cutoff: float = UUID_CUTOFF) -> DataFrame:
    """(doc_id, seen, id, score) of recognised uuids (doc_id, seen) among expected ids (doc_id, id, pos).

    The normal form as it is, then the expected id most similar to it, then that most similar to what was read, all but
    hexadecimals and dashes dropped.
    """
    seen = seen.select("doc_id", "seen").where("seen is not null").distinct()
    texts = expected.select("doc_id", "id", F.col("id").alias("text"), "pos")
    normal = seen.select("doc_id", "seen", ids.normal_uuid(F.col("seen")).alias("text")).repartition("doc_id")
    exact, rest = _parted(materialise(normal.join(_firsts(texts, "id"), ["doc_id", "text"], "left").select("doc_id", "seen", "id", "text"), "met"))
    rest = rest.drop("id")
    if rest.isEmpty():
        return exact
    near = materialise(_nearest(rest, texts, cutoff), "near")
    clean = F.regexp_replace(F.lower("seen"), r"[^a-f0-9\-]", "")
    raw = rest.join(near.select("doc_id", "seen"), ["doc_id", "seen"], "left_anti").select("doc_id", "seen", clean.alias("text")).where(F.length("text") >= UUID_LEAST)
    raw = materialise(raw, "unmatched")
    return exact.union(near) if raw.isEmpty() else exact.union(near).union(_nearest(raw, texts, cutoff))
