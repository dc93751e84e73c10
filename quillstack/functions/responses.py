"""What model servers answer: message texts, structured results, reasoning cut off, errors, image and stamp fields.

A response or message is a JSON text; what is not JSON gives null where the docstring names nothing else.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstack.functions import status as st
from quillstack.functions import texts as tx
from quillstack.functions.once import once

# How reasoning begins, tags that begin or are a page's text, how a title is named, markers, fields and labels.
REASONING = (
    r"(?i)^(?:\d+\.\s+\*\*|(?:Let me|I need to|I will|I should|I see|I can|First[,.]|Looking at|Analyzing|The user|The input|The image|The document|The table|"
    r"This is|This looks|Here |Now |OK |Sure |Based on|Alright|To (?:analyze|process|extract|transcribe))\b|\*\*(?:Analyze|Step|Plan|Approach|Solution|Observation)\b|"
    r"(?:Давай|Мне нужно|Сначала|Анализируя|Рассмотрим|Пользователь|Входные данные|На изображении)(?![\p{L}\p{N}_]))")
FIRST_TAG = r"(?i)<(?:p|table|h[1-6]|div|ul|ol|span|br|hr|img)\b"
TEXT_TAG = r"(?i)<(?:p|table|h[1-6]|div|ul|ol|span|br|hr|math|input|thead|tbody|tr|th|td)\b"
TABLE_FIRST = r"(?i)^\s*(?:<div\b[^>]*>\s*)?<table\b"
TITLE = r"""(?iu)(?:the\s+title\s+is\s+["“'](.+?)["”']|title:\s*["“']?(.+?)["”']?\s*[.\n]|header:\s*["“']?(.+?)["”']?\s*[.\n]|Заголовок:\s*[«"“]?(.+?)[»"”]?\s*[.\n]|Название:\s*[«"“]?(.+?)[»"”]?\s*[.\n])"""
TRUNCATED, OVERFLOW = "[LENGTH_TRUNCATED]", "[CONTEXT_OVERFLOW]"
STAMP_KEYS = ("document_code", "project_name", "sheet_name")
TOO_LONG = "контекст превышен — блок слишком большой для модели"
LOOKALIKE = r"(?<![a-zA-Zа-яА-ЯёЁ])[ABCEHKMPX](?![a-zA-Zа-яА-ЯёЁ])"
GONE, PASSING = ("NoSuchKey", "404"), ("RequestTimeout", "ServiceUnavailable")
IMAGE_FIELDS = ("content_summary", "detailed_description", "fragment_type")
STAMP_LABELS = (("document_code", "Шифр"), ("stage", "Стадия"), ("sheet", "Лист"), ("project_name", "Объект"), ("sheet_name", "Наименование листа"),
                ("organization", "Организация выпустившая проект"), ("revision", "Статус"), ("signatures", "Ответственные"))


def _text(data: Column, path: str) -> Column:
    """A field's text; null if it is missing, null or empty."""
    return F.nullif(F.get_json_object(data, path), F.lit(""))


def _kind(data: Column, path: str) -> Column:
    """STRING, ARRAY<...>, OBJECT<...>, ... of a field; null if it is missing."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(data), path, "variant"))


def _after(text: Column, pattern: str) -> Column:
    """The text from the first match on; null without a match."""
    at = F.regexp_instr(text, F.lit(pattern))
    return F.when(at > 0, F.substr(text, at))


def message_text(message: Column) -> Column:
    """The text of a message's content: a string, or the non-blank strings and text or content fields of a list, line by line."""
    items = F.try_variant_get(F.try_parse_json(message), "$.content", "array<variant>")
    field = lambda v, path: F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.nullif(F.try_variant_get(v, path, "string"), F.lit("")))
    said = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.coalesce(field(v, "$.text"), field(v, "$.content")))
    lines = F.filter(F.transform(items, lambda v: st.stripped(said(v))), lambda t: F.coalesce(t != "", F.lit(False)))
    listed = F.array_join(lines, "\n")
    kind = _kind(message, "$.content")
    plain = st.stripped(F.coalesce(F.get_json_object(message, "$.content"), F.lit("")))
    return F.when(kind.startswith("ARRAY"), listed).otherwise(plain)


def strip_untagged_reasoning(text: Column) -> Column:
    """Without reasoning before the first tag; nothing is left of reasoning without tags. Texts that begin otherwise stay."""
    start = F.ltrim(text)
    reasons = ~start.startswith("<") & ~start.startswith("```") & start.rlike(REASONING)
    return F.when(reasons, F.coalesce(_after(text, FIRST_TAG), F.lit(""))).otherwise(text)


def structured_html(text: Column) -> Column:
    """ocr_html of a text that is one JSON object; null if there is none."""
    s = st.stripped(text)
    return F.when(s.startswith("{") & s.endswith("}") & (_kind(s, "$.ocr_html") == "STRING"), F.nullif(st.stripped(F.get_json_object(s, "$.ocr_html")), F.lit("")))


def structured_list(text: Column) -> Column:
    """The html of a text that is a JSON list of segments, each in a div with its box and label; null if any has none."""
    s = st.stripped(text)
    items = F.from_json(F.when(s.startswith("[") & s.endswith("]"), s), "array<struct<html: string, `data-bbox`: string, `data-label`: string>>")
    attribute = lambda name, v: F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f' {name}="'), v, F.lit('"'))).otherwise("")
    def one(item: Column) -> Column:
        attributes = F.concat(attribute("data-bbox", item["data-bbox"]), attribute("data-label", item["data-label"]))
        return F.when(attributes == "", st.stripped(item["html"])).otherwise(F.concat(F.lit("<div"), attributes, F.lit(">"), st.stripped(item["html"]), F.lit("</div>")))
    whole = (F.size(items) > 0) & F.forall(items, lambda i: F.coalesce(st.stripped(i["html"]) != "", F.lit(False)))
    return F.when(whole, F.array_join(F.transform(items, one), "\n"))


def title_of(reasoning: Column) -> Column:
    """The title that reasoning names first, of more than three characters; null if it names none or that is shorter."""
    found = F.coalesce(*(F.nullif(F.regexp_extract(reasoning, TITLE, k), F.lit("")) for k in range(1, 6)))
    return F.when(F.length(st.stripped(found)) > 3, st.stripped(found))


def strip_reasoning_before_html(text: Column) -> Column:
    """From the first tag on; a title named before it goes above a table without headings. Nothing is left without tags."""
    html = _after(text, TEXT_TAG)
    title = title_of(F.substr(text, F.lit(1), F.regexp_instr(text, F.lit(TEXT_TAG)) - 1))
    bare = html.rlike(TABLE_FIRST) & ~html.rlike(r"(?i)<h[1-6]\b") & title.isNotNull()
    headed = F.when(bare, F.concat(F.lit('<div data-label="Section-Header"><h1>'), title, F.lit("</h1></div>\n"), html)).otherwise(html)
    return F.when(F.ltrim(text).startswith("<"), text).otherwise(F.coalesce(headed, F.lit("")))


def chosen_text(content: Column, thought: Column) -> Column:
    """The page's text: structured content, content without reasoning, else the html in the reasoning; may be empty."""
    own = F.coalesce(structured_html(content), structured_list(content), F.nullif(strip_untagged_reasoning(content), F.lit("")))
    return F.coalesce(own, F.when(thought.rlike(TEXT_TAG), thought), F.lit(""))


def thought_text(message: Column) -> Column:
    """The html in a message's reasoning; empty if there is none."""
    return st.stripped(strip_reasoning_before_html(tx.strip_thinking(F.coalesce(F.get_json_object(message, "$.reasoning_content"), F.lit("")))))


def response_text(message: Column) -> Column:
    """A message's page text."""
    return chosen_text(message_text(message), thought_text(message))


def outcome(response: Column, text: Column) -> Column:
    """The page text of a response, marked if its length ran out, or an error for one without choices or text.

    An error that isn't a text is told as its JSON.
    """
    whole = F.when(text == "", st.error(F.lit("Chandra: пустой ответ модели")))
    whole = whole.when(F.get_json_object(response, "$.choices[0].finish_reason") == "length", F.concat(F.lit(TRUNCATED), text)).otherwise(text)
    wrong = F.concat(F.lit("Chandra: некорректный ответ ("), F.coalesce(F.get_json_object(response, "$.error"), response), F.lit(")"))
    return F.when(F.get_json_object(response, "$.choices[0]").isNull(), st.error(wrong)).otherwise(whole)


def read(responses: DataFrame, response: str, text: str) -> DataFrame:
    """Responses with the outcome of each as column ``text``; each step is a projection of its own, so that nothing is computed twice."""
    steps = responses.withColumn("_message", F.get_json_object(response, "$.choices[0].message"))
    steps = steps.withColumns({"_content": message_text(F.col("_message")), "_thought": thought_text(F.col("_message"))})
    steps = steps.withColumn("_text", chosen_text(F.col("_content"), F.col("_thought")))
    return steps.withColumn(text, outcome(F.col(response), F.col("_text"))).drop("_message", "_content", "_thought", "_text")


def structured(text: Column) -> Column:
    """Of a text that is one JSON object its ocr_html, or the text itself if it has a key of stamps or images; else null."""
    s = st.stripped(text)
    known = F.when(s.endswith("}"), _object(s))
    return F.coalesce(structured_html(s), F.when(has_key(known, STAMP_KEYS + IMAGE_FIELDS), known))


def json_in_reasoning(text: Column) -> Column:
    """The JSON that reasoning is or the first object in it with a known key; null if there is none."""
    s = st.stripped(text)
    return F.coalesce(F.when(s.endswith("}"), _object(s)), embedded_json(s, (*STAMP_KEYS, *IMAGE_FIELDS, "ocr_html")))


def read_structured(responses: DataFrame, response: str, text: str, source: str) -> DataFrame:
    """Responses of the server that answers in JSON too, with each one's outcome and where it is from, as columns.

    Content that is structured, content without reasoning, then JSON in the reasoning, then the html in it. Of two fields
    for reasoning the newer one counts if it isn't empty. Without choices or text the outcome is an error.
    """
    steps = responses.withColumn("_message", F.get_json_object(response, "$.choices[0].message"))
    kind = _kind(F.col("_message"), "$.content")
    steps = steps.withColumn("_content", F.when(kind.startswith("ARRAY") | (kind == "STRING"), message_text(F.col("_message"))).otherwise(""))
    steps = steps.withColumn("_said", F.coalesce(structured(F.col("_content")), F.nullif(strip_untagged_reasoning(F.col("_content")), F.lit(""))))
    newer = _text(F.col("_message"), "$.reasoning")
    steps = steps.withColumn("_newer", newer.isNotNull())
    thought = st.stripped(F.coalesce(newer, _text(F.col("_message"), "$.reasoning_content")))
    steps = steps.withColumn("_thought", F.when(F.col("_said").isNull(), tx.strip_thinking(thought)))
    steps = steps.withColumn("_json", json_in_reasoning(F.col("_thought")))
    html = F.when(F.ltrim(F.col("_thought")).startswith("<"), F.when(F.col("_thought").rlike(TEXT_TAG), F.col("_thought"))).otherwise(_after(F.col("_thought"), TEXT_TAG))
    steps = steps.withColumn("_html", F.nullif(st.stripped(F.when(F.col("_json").isNull(), html)), F.lit("")))
    field = F.when(F.col("_newer"), "reasoning").otherwise("reasoning_content")
    by = F.when(F.col("_said").isNotNull(), "content").when(F.col("_json").isNotNull(), field).when(F.col("_html").isNotNull(), "reasoning_content").otherwise("empty")
    found = F.coalesce("_said", "_json", "_html", st.error(F.lit("Qwen: пустой ответ модели")))
    wrong = st.error(F.concat(F.lit("Qwen: некорректный ответ ("), F.coalesce(F.get_json_object(response, "$.error"), response), F.lit(")")))
    good = F.get_json_object(response, "$.choices[0]").isNotNull()
    out = steps.withColumns({text: F.when(good, found).otherwise(wrong), source: F.when(good, by).otherwise("error")})
    return out.drop("_message", "_content", "_said", "_newer", "_thought", "_json", "_html")


def final_result(code: Column, text: Column) -> Column:
    """The result not to be retried of a request that is too long for the model; else null."""
    return F.when(final_error(code, text).isNotNull(), st.non_retriable(F.lit(TOO_LONG)))


def unfenced_json(text: Column) -> Column:
    """JSON of any kind as written, a code fence's first and last line left out; null for what is none."""
    s = st.stripped(text)
    lines = F.split(s, "\n")
    inner = F.when(s.startswith("```") & (F.size(lines) > 2), st.stripped(F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 2, F.lit(0))), "\n"))).otherwise(s)
    return F.when(F.try_parse_json(inner).isNotNull(), inner)


def storage_error(code: Column) -> Column:
    """struct<retryable, queued> of a store's error code: only what passes by itself is tried again."""
    passing = F.coalesce(code.isin(*PASSING), F.lit(False))
    return F.struct(passing.alias("retryable"), passing.alias("queued"))


def has_lookalikes(text: Column) -> Column:
    """Whether a Latin capital that looks like a Cyrillic one stands by itself, as axes are named."""
    return F.coalesce(text.rlike(LOOKALIKE), F.lit(False))


def is_structured_html(data: Column) -> Column:
    """Whether a JSON object has html of a text or of a stamp."""
    return has_key(data, ("content_html", "stamp_html"))


def final_error(code: Column, text: Column) -> Column:
    """The marker of an error that the same request will meet again: a context that is too small; else null."""
    return F.when((code == 400) & F.lower(text).contains("context size"), F.lit(OVERFLOW))


def parsed_json(text: Column) -> Column:
    """The JSON object a result is or holds in a fence marked json, as written; null if there is none. Each is parsed once."""
    valid = lambda t: (t != "") & F.try_parse_json(t).isNotNull()
    def found(s: Column) -> Column:
        fenced = F.when(s.contains("```json"), F.regexp_extract(s, r"(?s)```json\s*(.*?)\s*```", 1))
        return F.when(s.startswith("{") & valid(s), s).otherwise(once(fenced, lambda t: F.when(valid(t), t)))
    return once(st.stripped(text), found)


_token = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*(?:"|\\?\Z)|[{}]', re.DOTALL)


def balanced(text: str) -> str | None:
    """From the first brace to the one that closes it; braces in strings don't count. Null if it never closes. Linear."""
    begin, depth = text.find("{"), 0
    if begin < 0:
        return None
    for m in _token.finditer(text, begin):
        depth += {"{": 1, "}": -1}.get(m.group(), 0)
        if not depth:
            return text[begin:m.end()]
    return None


@F.pandas_udf(T.StringType())
def _balanced(texts):
    return texts.map(balanced, na_action="ignore")


def _object(text: Column) -> Column:
    """The text if it is a JSON object, else null."""
    return F.when(text.startswith("{") & F.try_parse_json(text).isNotNull(), text)


def has_key(data: Column, keys: tuple[str, ...]) -> Column:
    """Whether a JSON object has one of the keys, be its value null."""
    return F.coalesce(F.array_contains(F.array(*(_kind(data, f"$.{k}").isNotNull() for k in keys)), True), F.lit(False))


def embedded_json(text: Column, keys: tuple[str, ...]) -> Column:
    """The first balanced object in a text, if it is JSON and has one of the keys; null otherwise."""
    found = _object(_balanced(F.when(text.contains("{"), text)))
    return F.when(has_key(found, keys), found)


def stamp_json(text: Column) -> Column:
    """The JSON object a stamp's result is, holds in a fence marked json, or has somewhere in its text with a stamp's key."""
    s = st.stripped(text)
    fenced = st.stripped(F.regexp_extract(s, r"(?s)```json\s*(.*?)\s*```", 1))
    sure = F.coalesce(_object(s), _object(fenced))
    return F.coalesce(sure, embedded_json(F.when(sure.isNull(), s), STAMP_KEYS))


_IMAGE = "fragment_type string, location string, content_summary string, detailed_description string, verification_recommendations string, key_entities string"
_PLACE = ("zone_name", "grid_lines", "level_or_elevation")
#: The JSON of an image, valid and without escapes by number, whose fields are texts, its place an object of texts and its entities a list of texts.
_QUOTED, _BETWEEN = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', r"[\s,]*+"
_FIELD = rf"{_QUOTED}\s*+:\s*+(?:{_QUOTED}|null){_BETWEEN}"
_PLAIN = rf'(?s)^\{{\s*+(?:"key_entities"\s*+:\s*+\[\s*+(?:{_QUOTED}{_BETWEEN})*+\]{_BETWEEN}|"location"\s*+:\s*+\{{\s*+(?:{_FIELD})*+\}}{_BETWEEN}|(?!"key_entities"|"location"|"analysis"){_FIELD})*+\}}$'
_LONGEST = 4000


def flat_image(data: Column) -> Column:
    """The fields of an image's JSON, a valid object, as a struct, if it is as plain as most are; else null. Read in one go, so for a column of its own."""
    plain = (F.length(data) <= _LONGEST) & ~data.contains("\\u") & data.rlike(_PLAIN)
    return F.from_json(F.when(plain, data), ", ".join(f"{f} string" for f in _TEXTS) + f", location struct<{', '.join(f'{k}: string' for k in _PLACE)}>, key_entities array<string>")


def image_fields(data: Column, parsed: Column | None = None, flat: Column | None = None) -> Column:
    """Fields of an image's JSON, or of its analysis: type, place with its level, texts with what to check, and at most a hundred entities.

    parsed is the same JSON as a variant and flat its flat_image, if they are there already.
    """
    if flat is not None:
        told = _told({f: flat[f] for f in _TEXTS}, {k: flat["location"][k] for k in _PLACE}, F.lit(None).cast("string"), flat["location"].isNotNull(), flat["key_entities"])
        return F.when(flat.isNotNull(), told).otherwise(image_fields(data, parsed))
    return once(F.try_parse_json(data) if parsed is None else parsed, lambda v: _read_again(data, v))


_TEXTS = ("fragment_type", "content_summary", "detailed_description", "verification_recommendations")


def _told(texts: dict[str, Column], place: dict[str, Column], location: Column, placed: Column, entities: Column) -> Column:
    said = lambda v: F.coalesce(v, F.lit(""))
    return F.struct(said(texts["fragment_type"]).alias("fragment_type"), *(F.when(placed, said(place[k])).alias(k) for k in _PLACE), F.when(~placed, F.nullif(location, F.lit(""))).alias("location_text"),
                    *(said(texts[k]).alias(k) for k in _TEXTS[1:]), F.slice(F.coalesce(entities, F.array().cast("array<string>")), 1, 100).alias("key_entities"))


def _read_again(data: Column, v: Column) -> Column:
    is_object = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")).startswith("OBJECT"), F.lit(False))
    inside = is_object("$.analysis")
    read = F.struct(F.from_json(F.when(inside, F.get_json_object(data, "$.analysis")).otherwise(data), _IMAGE).alias("d"), F.when(inside, is_object("$.analysis.location")).otherwise(is_object("$.location")).alias("placed"))
    def fields(x: Column) -> Column:
        d, entities = x["d"], F.from_json(x["d"]["key_entities"], "array<string>")
        place = F.from_json(F.when(x["placed"], d["location"]), ", ".join(f"{k} string" for k in _PLACE))
        return once(place, lambda at: _told({f: d[f] for f in _TEXTS}, {k: at[k] for k in _PLACE}, d["location"], x["placed"], entities))
    return once(read, fields)


def may_hold(data: Column, key: str) -> Column:
    """Whether JSON's text names a key or has escapes, cheap to ask before the key is looked for: a variant's missing field costs far more than one that is there."""
    return data.contains(key) | data.contains("\\u")


def is_image_json(data: Column) -> Column:
    """Whether a JSON object, or its analysis, has one of the fields of an image."""
    return once(F.try_parse_json(data), lambda v: is_image(v, data))


def is_image(parsed: Column, data: Column) -> Column:
    """is_image_json of JSON that is a variant already."""
    there = lambda way: reduce(Column.__or__, (may_hold(data, f) & F.try_variant_get(parsed, f"${way}.{f}", "variant").isNotNull() for f in IMAGE_FIELDS))
    return F.coalesce(there("") | (may_hold(data, "analysis") & there(".analysis")), F.lit(False))


def qwen_html(data: Column) -> Column:
    return F.coalesce(_text(data, "$.content_html"), _text(data, "$.stamp_html"), F.lit(""))


_REVISION = "change_num string, revision_number string, doc_num string, document_number string, date string"
_PERSON = "role string, surname string, name string"


_LISTS = {"revisions": _REVISION, "signatures": _PERSON}


def with_stamp_values(df: DataFrame, data: str, values: str) -> DataFrame:
    """df with struct<label's name: text> of a stamp's fields, empty ones null, as column ``values``; null without JSON.

    The JSON is read once, and again, with its lists item by item, only where these aren't there as lists of objects. Each
    step is a projection of its own.
    """
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    fields = [n for n, _ in STAMP_LABELS if n not in ("sheet", "revision", "signatures")] + ["sheet_number", "total_sheets"]
    schema = lambda lists: ", ".join([*(f"{n} string" for n in fields), *lists])
    steps = df.withColumn("_t", F.from_json(data, schema(f"{n} array<struct<{of.replace(' string', ': string')}>>" for n, of in _LISTS.items())))
    absent = lambda n: F.col(f"_t.{n}").isNull() & ~F.col(data).contains(n) & ~F.col(data).contains("\\u")
    known = [absent(n) | F.coalesce(~F.exists(f"_t.{n}", lambda x: x.isNull()), F.lit(False)) for n in _LISTS]
    steps = steps.withColumn("_r", F.from_json(F.when(~(known[0] & known[1]), F.col(data)), schema(f"{n} string" for n in _LISTS)))
    again = F.col("_r").isNotNull()
    steps = steps.withColumns({"_s": F.struct(*(F.when(again, F.col(f"_r.{n}")).otherwise(F.col(f"_t.{n}")).alias(n) for n in fields)),
                               "_revisions": F.from_json("_r.revisions", "array<string>"), "_signed": F.from_json("_r.signatures", "array<string>")})
    steps = steps.withColumn("_last", F.when(again, F.from_json(F.try_element_at("_revisions", F.lit(-1)), _REVISION)).otherwise(F.try_element_at("_t.revisions", F.lit(-1))))
    number, document = F.coalesce(some("_last.change_num"), some("_last.revision_number"), F.lit("")), F.coalesce(some("_last.doc_num"), some("_last.document_number"))
    steps = steps.withColumns({"_number": number, "_document": document})
    dated = F.when(some("_last.date").isNotNull(), F.concat(F.lit(" от "), "_last.date")).otherwise("")
    named = F.when(F.col("_document").isNotNull(), F.concat(F.lit(" (Док. № "), "_document", dated, F.lit(")"))).otherwise("")
    revision = F.when((F.col("_number") != "") | F.col("_document").isNotNull(), F.concat(F.lit("Изм. "), "_number", named))
    def person(p: Column) -> Column:
        return F.concat(F.nullif(p["role"], F.lit("")), F.lit(": "), F.coalesce(F.nullif(p["surname"], F.lit("")), F.nullif(p["name"], F.lit(""))))
    def signed(one: Column) -> Column:
        return F.when(one.startswith("{"), once(F.from_json(one, _PERSON), person)).otherwise(one)
    # nulls are left out; a column of its own, as what follows names it twice
    steps = steps.withColumn("_told", F.when(again, F.array_join(F.transform("_signed", signed), "; ")).otherwise(F.array_join(F.transform("_t.signatures", person), "; ")))
    listed = lambda n, texts: F.when(again, F.col(texts).isNotNull()).otherwise(F.col(f"_t.{n}").isNotNull())
    total = some("_s.total_sheets")
    told = {"sheet": F.when(total.isNotNull(), F.concat(F.coalesce("_s.sheet_number", F.lit("")), F.lit(" (из "), total, F.lit(")"))).otherwise(some("_s.sheet_number")),
            "revision": F.when(listed("revisions", "_revisions"), revision).otherwise(some("_r.revisions")),
            "signatures": F.when(listed("signatures", "_signed"), some("_told")).otherwise(some("_r.signatures"))}
    every = F.struct(*(told.get(name, some(f"_s.{name}")).alias(name) for name, _ in STAMP_LABELS))
    return steps.withColumn(values, F.when(F.col(data).isNotNull(), every)).drop("_t", "_r", "_s", "_revisions", "_signed", "_last", "_number", "_document", "_told")


def stamp_parts(values: Column) -> Column:
    """array<struct<label, value>> of a stamp's values (with_stamp_values) in their order, null ones left out."""
    every = F.array(*(F.struct(F.lit(label).alias("label"), values[name].alias("value")) for name, label in STAMP_LABELS))
    return F.filter(every, lambda p: p["value"].isNotNull())


def with_stamp_parts(df: DataFrame, data: str, parts: str) -> DataFrame:
    """df with array<struct<label, value>> of a stamp's fields in their order, empty ones left out, as column ``parts``."""
    return with_stamp_values(df, data, "_v").withColumn(parts, stamp_parts(F.col("_v"))).drop("_v")


def stamp_line(parts: Column, separator: str = " | ") -> Column:
    """A stamp's parts as "label: value", joined."""
    return F.array_join(F.transform(parts, lambda p: F.concat(p["label"], F.lit(": "), p["value"])), separator)


def json_quality(text: Column, data: Column) -> Column:
    """empty, api_error, suspicious or ok of an image's or a stamp's result and the JSON made of it."""
    blank, bare = st.is_blank(text), F.coalesce(F.regexp_replace(data, r"\s+", "").isin("{}", "[]"), F.lit(False))
    none = data.isNull() | bare
    return F.when(blank, F.when(none, "empty").otherwise("ok")).when(st.is_error(text), "api_error").when(none, "suspicious").otherwise("ok")
