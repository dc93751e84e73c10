"""Recognition results: error markers, suspicious outputs, status and quality of a text."""

from __future__ import annotations

import json
from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Markers, key sets and patterns of what a recogniser says instead of a page's text.
ERROR = "[Ошибка"
NON_RETRIABLE = "[НеПовторяемая"
BOX_KEYS = ("bbox", "data-bbox", "data-label", "label")
TABLE_KEYS = ("cells", "colspan", "columns", "rows", "rowspan", "table")
THINKING = r"(?imu)(?:(?:The user wants|I need to|I will now|I should|Let me|Looking at|Analyzing)\b|(?U:(?:Давай|Мне нужно|Я должен|Рассмотрим|Анализируя)\b)|^\d+\.\s+\*\*)"
CONCLUDING = r"(?i)(?:I will now generate|based on this analysis|Let me now|I will now output)\b"
TAGGED = r"(?i)<(?:p|table|div|h[1-6]|ul|ol|tr|td|th)\b"
# White space as Python's strip() knows it.
SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
TOP = r'data-bbox="\d+\s+(\d+)\s+\d+\s+\d+"'


def stripped(text: Column) -> Column:
    """Without white space at both ends, in linear time."""
    return F.btrim(text, F.lit(SPACE))


def is_blank(text: Column) -> Column:
    return F.coalesce(stripped(text) == "", F.lit(True))


def error(message: Column) -> Column:
    return F.concat(F.lit(ERROR + ": "), message, F.lit("]"))


def non_retriable(message: Column) -> Column:
    return F.concat(F.lit(NON_RETRIABLE + " ошибка: "), message, F.lit("]"))


def is_error(text: Column) -> Column:
    return F.coalesce(text.startswith(ERROR), F.lit(False))


def is_non_retriable(text: Column) -> Column:
    return F.coalesce(text.startswith(NON_RETRIABLE), F.lit(False))


def is_any_error(text: Column) -> Column:
    return is_error(text) | is_non_retriable(text)


def _keys(value, depth: int = 0) -> set:
    if depth > 3 or not isinstance(value, dict | list):
        return set()
    inside = value.values() if isinstance(value, dict) else value
    return (set(value) if isinstance(value, dict) else set()).union(*(_keys(v, depth + 1) for v in inside))


def dump_kind(text: str | None) -> str | None:
    """box or table if the text is a JSON list whose objects have such keys in four levels, else null."""
    try:
        data = json.loads(text or "")
    except ValueError:
        return None
    keys = _keys(data) if isinstance(data, list) else set()
    return "box" if keys & set(BOX_KEYS) else "table" if keys & set(TABLE_KEYS) else None


class _Plain(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found = []

    def handle_data(self, data):
        self.found.append(data)


def plain_html(html: str | None) -> str:
    """The text of html, entities decoded."""
    parser = _Plain()
    parser.feed(html or "")
    return "".join(parser.found)


@F.pandas_udf(T.StringType())
def _dump(texts):
    return texts.map(dump_kind, na_action="ignore")


@F.pandas_udf(T.IntegerType())
def _plain_length(texts):
    return texts.map(lambda t: len(plain_html(t).strip()), na_action="ignore")


def suspicion(text: Column, html: Column | None = None, exact: bool = True) -> Column:
    """Why a result is no page's text: dump_box, dump_table, preformatted, sparse, reasoning, headless_table, or null.

    Only texts that look like a JSON list, or have markup and too little outside it, reach Python; with exact=False
    tags are cut by a pattern and nothing does.
    """
    s = stripped(text)
    dump = _dump(F.when(s.startswith("[") & s.endswith("]"), s)) if exact else F.lit(None).cast("string")
    rough = F.length(stripped(F.regexp_replace(s, "<[^>]+>", "")))
    # entities only get shorter when decoded, so a text without tags and entities is as long as it looks
    dense = _plain_length(F.when((F.length(s) > 50) & s.rlike("[<&]"), s)) if exact else rough
    thoughts = F.regexp_count(s, F.lit(THINKING))
    tops = F.transform(F.regexp_extract_all(s, F.lit(TOP), 1), lambda t: t.cast("int"))
    inner = stripped(F.regexp_extract(stripped(html), r"(?s)^<pre>(.*)</pre>$", 1)) if html is not None else None
    rule = F.when(is_blank(text) | is_any_error(text), F.lit(None).cast("string")).when(dump.isNotNull(), F.concat(F.lit("dump_"), dump))
    if inner is not None:
        rule = rule.when(F.coalesce(stripped(html).rlike(r"(?s)^<pre>.*</pre>$") & (inner.startswith("[{") | inner.startswith("{") | F.substring(inner, 1, 50).contains("&quot;")), F.lit(False)), F.lit("preformatted"))
    rule = rule.when((F.length(s) > 50) & (F.coalesce(dense, rough) < 20), F.lit("sparse"))
    rule = rule.when((thoughts > 0) & ((thoughts >= 2) | s.rlike(CONCLUDING)) & (~s.rlike(TAGGED) | (thoughts >= 3)), F.lit("reasoning"))
    return rule.when(s.rlike(r"(?i)<table\b") & ~s.rlike(r"(?i)<h[1-6]\b") & (F.size(tops) > 0) & (F.array_min(tops) >= 150), F.lit("headless_table"))


def status(text: Column, exact: bool = True) -> Column:
    """success, error or not_recognized."""
    return F.when(is_blank(text), "not_recognized").when(is_any_error(text) | suspicion(text, exact=exact).isNotNull(), "error").otherwise("success")


def needs_recognition(text: Column, is_correction: Column, exact: bool = True) -> Column:
    return F.coalesce(is_correction, F.lit(False)) | (status(text, exact) != "success")


def should_retry(text: Column, attempt: Column, most: Column) -> Column:
    """Whether an empty or retriable result has attempts left."""
    return (is_blank(text) | is_error(text)) & (attempt < most)


def text_quality(text: Column, html: Column | None = None, exact: bool = True) -> Column:
    """empty, api_error, suspicious or ok; results not to be retried count as ok."""
    return F.when(is_blank(text), "empty").when(is_error(text), "api_error").when(suspicion(text, html, exact).isNotNull(), "suspicious").otherwise("ok")


def coverage(recognised: Column, total: Column) -> Column:
    """What a document's share of recognised blocks makes of its job: error for none, partial below nine tenths, else done."""
    return F.when(F.coalesce(recognised, F.lit(0)) == 0, "error").when(recognised < 0.9 * total, "partial").otherwise("done")
