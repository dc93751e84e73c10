"""Clean-up of recognised texts, storage keys and small formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstack.functions.status import stripped
from quillstack.functions.tables import RULE

# Think blocks, links to junk images, and tags that make a text html.
THINKING = (r"(?is)<think>.*?</think>", r"(?is)<think>.*$", r"(?is)^.*?</think>")
JUNK_LINK = r"\[img:[a-f0-9]{20,}_img\]"
TAG = r"(?i)<(?:table|thead|tbody|tr|th|td|p|div|span|h[1-6]|ul|ol|li|br|img|math|sub|sup|pre|input)(?![\p{L}\p{N}_])"


def strip_thinking(text: Column) -> Column:
    """Without closed, unclosed and orphaned think blocks."""
    for p in THINKING:
        text = F.regexp_replace(text, p, "")
    return stripped(text)


def sanitize_markdown(text: Column) -> Column:
    """Without links to junk images, at most one empty line in a row."""
    return stripped(F.regexp_replace(F.regexp_replace(text, JUNK_LINK, ""), r"\n{3,}", "\n\n"))


def strip_fence(text: Column) -> Column:
    """What a code fence around the whole text holds, else the text."""
    fence = r"(?s)^```\w*\s*\n(.*?)```\s*$"
    return F.when(text.rlike(fence), stripped(F.regexp_extract(text, fence, 1))).otherwise(text)


def escape_html(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def has_markdown_table(text: Column) -> Column:
    """At least two lines between pipes and one of dashes."""
    lines = F.transform(F.split(stripped(text), "\n"), stripped)
    piped = F.size(F.filter(lines, lambda x: x.startswith("|") & x.endswith("|") & (F.length(x) > 2)))
    return (piped >= 2) & (F.size(F.filter(lines, lambda x: x.rlike(RULE))) >= 1)


def contains_html(text: Column) -> Column:
    return text.contains("<") & text.rlike(TAG)


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)\.pdf$", "")


def export_keys(prefix: Column, name: Column) -> Column:
    """Keys of a document's exports under its prefix."""
    s = F.concat(prefix, F.lit("/"), stem(name))
    return F.struct(F.concat(s, F.lit("_ocr.html")).alias("html"), F.concat(s, F.lit("_document.md")).alias("markdown"), F.concat(s, F.lit("_annotation.json")).alias("annotation"))


def size_text(size: Column) -> Column:
    """Bytes for people: B, KB, MB or GB with one decimal."""
    at = lambda k, unit: F.concat(F.format_string("%.1f", F.bround(size / float(1024 ** k), 1)), F.lit(unit))
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1024 ** 2, at(1, " KB")).when(size < 1024 ** 3, at(2, " MB")).otherwise(at(3, " GB"))


def filled_prompt(prompt: Column, document: Column, page: Column, block: Column) -> Column:
    """Names in braces of a prompt replaced; pages count from one there."""
    out = F.replace(prompt, F.lit("{DOC_NAME}"), F.coalesce(document, F.lit("")))
    out = F.replace(out, F.lit("{PAGE_NUM}"), F.coalesce((page + 1).cast("string"), F.lit("")))
    return F.replace(out, F.lit("{BLOCK_ID}"), F.coalesce(block, F.lit("")))
