"""What of a document's html belongs to which block: markers with ids, closed by the next one, and block divs for the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstack.functions.status import stripped
from quillstack.operators.matching import match_codes, match_uuids
from quillstack.scratch import materialise

# Markers with a code and with a uuid, block divs, links to crops, and what goes with a marker.
CODE_MARKER = r"(?i)BLOCK:\s*([A-Z0-9]{2,5}[-\s]*[A-Z0-9]{2,5}[-\s]*[A-Z0-9]{2,5})"
UUID_MARKER = (r"(?i)\[\[?\s*BLOCK[\s_]*ID\s*[:\-]?\s*([0-9A-Za-z]{8}[-\s_]*[0-9A-Za-z]{4}[-\s_]*[0-9A-Za-z]{4}[-\s_]*[0-9A-Za-z]{4}[-\s_]*[0-9A-Za-z]{12})\s*\]?\]?")
BLOCK_DIV = (r'(?i)<div[^>]*class="[^"]*block\s+block-type-(\w+)[^"]*"[^>]*>\s*<div[^>]*class="[^"]*block-header[^"]*"[^>]*>([^<]*)</div>\s*'
             r'<div[^>]*class="[^"]*block-content[^"]*"[^>]*>([\s\S]*?)</div></div>')
CROP_LINK = r"(?i)crops/([a-f0-9\-]{36})\.pdf"
AFTER_MARKER = r"^\s*\]?\]?\s*</\w+>\s*"
NEXT_MARKER = r"(?i)\s*<p>\s*BLOCK:\s*[A-Z0-9]{4}-[A-Z0-9]{4}-[A-Z0-9]{3}\s*</p>\s*$"
NEXT_HEADER, NEXT_BLOCK = r'(?s)<div[^>]*class="[^"]*block-header[^"]*"[^>]*>.*$', r'(?s)</div>\s*</div>\s*<div[^>]*class="[^"]*block.*$'
OPEN_PARAGRAPH, EMPTY_PARAGRAPH = r"\s*<p>\s*$", r"<p>\s*</p>"
HEADER_LINES = (r"(?i)<p><b>Created:</b>[^<]*</p>\s*", r"(?i)<p><b>Linked block:</b>[^<]*</p>\s*", r"(?i)<p><b>Grouped blocks:</b>[^<]*</p>\s*",
                r'(?s)<div class="stamp-info[^"]*">.*?</div>\s*')
SAMPLE, UUID_SAMPLE = 60, 120


def _without(text: Column, *patterns: str) -> Column:
    for p in patterns:
        text = F.regexp_replace(text, p, "")
    return text


def after_marker(text: Column) -> Column:
    """A block's html of what stands between its marker and the next."""
    return stripped(_without(text, AFTER_MARKER, r"^\s+", NEXT_MARKER, NEXT_HEADER, NEXT_BLOCK, OPEN_PARAGRAPH, *HEADER_LINES))


def in_div(text: Column) -> Column:
    """A block's html of what its div holds."""
    bare = stripped(_without(stripped(_without(text, CODE_MARKER, UUID_MARKER)), EMPTY_PARAGRAPH))
    return stripped(_without(bare, *HEADER_LINES))


def _kept_markers(pages: DataFrame, expected: DataFrame, pattern: str, match) -> DataFrame:
    """(doc_id, kept) as a scratch table: documents' markers (id, k, next, score) of one kind that cut.

    Only markers of expected ids do, and of several with one id the first. Markers are matched without their texts.
    """
    found = pages.select("doc_id", F.posexplode(F.regexp_extract_all("html", F.lit(pattern), F.lit(1))).alias("k", "code"))
    found = materialise(found, "markers")
    known = match(found.select("doc_id", F.col("code").alias("seen")), expected).withColumnRenamed("seen", "code")
    # dealt by documents, as all that follows is grouped by them
    kept = found.repartition("doc_id").join(known.repartition("doc_id"), ["doc_id", "code"]).groupBy("doc_id", "id").agg(F.min("k").alias("k"), F.min_by("score", "k").alias("score"))
    ends = kept.withColumn("next", F.lead("k").over(Window.partitionBy("doc_id").orderBy("k")))
    return materialise(ends.groupBy("doc_id").agg(F.collect_list(F.struct("id", "k", "next", "score")).alias("kept")), "kept")


def _by_markers(pages: DataFrame, kept: DataFrame, pattern: str, sample: int) -> DataFrame:
    """(doc_id, id, html, method, score, sample) by kept markers of one kind; the others stay in the text.

    Markers meet their texts a document at a time, and texts are cut only where they are asked for.
    """
    marks, rest = F.regexp_extract_all("html", F.lit(pattern), F.lit(0)), F.split("html", pattern, -1)
    # marker, what follows, marker, what follows, ...; made below the join, so that it isn't made again for every marker
    parts = F.flatten(F.zip_with(marks, F.slice(rest, 2, F.size(marks)), lambda a, b: F.array(a, b)))
    cut = pages.where(F.col("html").rlike(pattern)).select("doc_id", parts.alias("parts")).join(kept, "doc_id")
    def one(m: Column) -> Column:
        last = F.coalesce(m["next"], F.floor(F.size("parts") / 2).cast("int"))
        text = F.array_join(F.slice("parts", 2 * m["k"] + 2, 2 * (last - m["k"]) - 1), "")
        return F.struct(m["id"].alias("id"), text.alias("text"), m["score"].alias("score"), F.substring(F.get("parts", 2 * m["k"]), 1, sample).alias("sample"))
    pieces = cut.select("doc_id", F.explode(F.transform("kept", one)).alias("s")).select("doc_id", "s.id", after_marker(F.col("s.text")).alias("html"), "s.score", "s.sample")
    return pieces.select("doc_id", "id", "html", F.when(F.col("html") == "", "marker_empty").otherwise("marker").alias("method"), "score", "sample")


def _ids(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", F.explode("kept.id").alias("id"))


def _by_divs(pages: DataFrame, expected: DataFrame) -> DataFrame:
    """(doc_id, id, html, method, score, sample) by block divs whose content names an id: a marker or a link to a crop."""
    found = pages.select("doc_id", F.posexplode(F.regexp_extract_all("html", F.lit(BLOCK_DIV), F.lit(3))).alias("k", "content"))
    first = lambda pattern, group=1: F.nullif(F.regexp_extract("content", pattern, group), F.lit(""))
    found = found.select("doc_id", "k", F.col("content"), first(CODE_MARKER).alias("code"), first(UUID_MARKER).alias("uuid"), first(CROP_LINK).alias("link"))
    found = materialise(found, "divs")
    if found.isEmpty():
        return found.select("doc_id", F.col("code").alias("id"), F.col("content").alias("html"), F.col("code").alias("method"), F.lit(0.0).alias("score"), F.col("code").alias("sample"))
    named_by = lambda column: found.select("doc_id", F.col(column).alias("seen")).where("seen is not null")
    codes = match_codes(named_by("code"), expected)
    uuids = match_uuids(named_by("uuid"), expected)
    named = lambda df, column, name: df.select("doc_id", F.col("seen").alias(column), F.col("id").alias(name), F.col("score").alias(name + "_score"))
    there = expected.select("doc_id", F.col("id").alias("link"), F.col("id").alias("by_link")).distinct()
    met = found.join(named(codes, "code", "by_code"), ["doc_id", "code"], "left").join(named(uuids, "uuid", "by_uuid"), ["doc_id", "uuid"], "left").join(there, ["doc_id", "link"], "left")
    by = F.when(F.col("by_code").isNotNull(), F.struct(F.col("by_code").alias("id"), F.col("by_code_score").alias("score"), F.substring(first(CODE_MARKER, 0), 1, SAMPLE).alias("sample")))
    by = by.when(F.col("by_uuid").isNotNull(), F.struct(F.col("by_uuid").alias("id"), F.col("by_uuid_score").alias("score"), F.substring(first(UUID_MARKER, 0), 1, SAMPLE).alias("sample")))
    by = by.when(F.col("by_link").isNotNull(), F.struct(F.col("by_link").alias("id"), F.lit(100.0).alias("score"), F.concat(F.lit("URL: "), "link").alias("sample")))
    firsts = met.select("doc_id", "k", "content", by.alias("by")).where("by is not null")
    firsts = firsts.groupBy("doc_id", F.col("by.id").alias("id")).agg(F.min_by(F.struct("content", "by.score", "by.sample"), "k").alias("f"))
    return firsts.select("doc_id", "id", in_div(stripped(F.col("f.content"))).alias("html"), F.lit("div_structure").alias("method"), "f.score", "f.sample")


def segments(pages: DataFrame, expected: DataFrame) -> DataFrame:
    """(doc_id, id, html, method, score, sample): the html of each expected id that a document's text holds.

    pages has one row (doc_id, html) a document, expected (doc_id, id, pos). Markers with codes come first, those with
    uuids where a document has none of an expected id, block divs for ids that are then still missing. A marker
    without text is a find of its own (marker_empty). Null texts and documents that expect nothing have no segments.
    """
    pages, expected, by_code, by_uuid = _marked(pages, expected)
    # dealt by documents as the markers' own grouping
    ids = _ids(by_code).union(_ids(by_uuid))
    missing = materialise(expected.repartition("doc_id").join(ids.repartition("doc_id"), ["doc_id", "id"], "left_anti"), "missing")
    found = _by_markers(pages, by_code, CODE_MARKER, SAMPLE).union(_by_markers(pages, by_uuid, UUID_MARKER, UUID_SAMPLE))
    return found.union(_by_divs(pages.join(missing.select("doc_id").distinct(), "doc_id", "left_semi"), missing))


def _marked(pages: DataFrame, expected: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Pages and expected ids, and kept markers with codes and with uuids, all as scratch tables."""
    # written before it is filtered, as a filter would make each text again
    pages = materialise(pages.select("doc_id", "html"), "pages").where("html is not null")
    expected = expected.select("doc_id", "id", "pos").where("id is not null").groupBy("doc_id", "id").agg(F.min("pos").alias("pos"))
    expected = materialise(expected, "expected")
    by_code = _kept_markers(pages, expected, CODE_MARKER, match_codes)
    bare = pages.where(F.col("html").rlike(UUID_MARKER)).join(by_code.select("doc_id"), "doc_id", "left_anti")
    return pages, expected, by_code, _kept_markers(bare, expected, UUID_MARKER, match_uuids)


def missing_ids(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, id, pos) of expected ids that have no segment."""
    return expected.join(found.select("doc_id", "id").distinct(), ["doc_id", "id"], "left_anti")
