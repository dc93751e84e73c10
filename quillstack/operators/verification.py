"""Recognising again what failed: blocks of each kind that need it, budgets, and rounds whose attempts are a table.

The state of a verification is its attempts (id, round, text) alone: the blocks as they are now follow from them, so a run
that stops goes on from the table it has written and ends with the same one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstack.functions import responses as rs
from quillstack.functions import status as st
from quillstack.operators import blocks as bl
from quillstack.operators.stamps import is_stamp
from quillstack.scratch import materialise

KINDS = ("text", "stamp", "image")
ATTEMPTS = "id string, round int, text string"


def _category(blocks: DataFrame) -> Column | None:
    return F.col("category_code") if "category_code" in blocks.columns else None


def missing(blocks: DataFrame, kind: str) -> DataFrame:
    """(doc_id, id, page, pos, reason) of one kind's blocks to recognise again: empty, api_error or suspicious_output.

    Texts by what they say; stamps and images by whether their result holds JSON. Results that are not to be retried
    stay. An old category makes a stamp of any block.
    """
    stamp = is_stamp(F.col("block_type"), _category(blocks))
    if kind == "text":
        return bl.missing(blocks.where(~stamp))
    of_kind = blocks.where(stamp if kind == "stamp" else ~stamp & (F.col("block_type") == "image")).where(~st.is_non_retriable(F.col("ocr_text")))
    data = rs.stamp_json(F.col("ocr_text")) if kind == "stamp" else rs.parsed_json(F.col("ocr_text"))
    quality = rs.json_quality(F.col("ocr_text"), data)
    reason = F.when(quality == "suspicious", "suspicious_output").otherwise(quality)
    return of_kind.select("doc_id", "id", "page", "pos", reason.alias("reason")).where("reason <> 'ok'")


def applied(blocks: DataFrame, attempts: DataFrame) -> DataFrame:
    """Blocks with the last attempt that gave a text; those whose attempts all failed stay as they were."""
    good = attempts.where(~st.is_blank(F.col("text")) & ~st.is_any_error(F.col("text")))
    last = good.groupBy("id").agg(F.max_by("text", F.struct("round", "text")).alias("_text"))
    return blocks.join(last, "id", "left").withColumn("ocr_text", F.coalesce("_text", "ocr_text")).select(blocks.columns)


def verified(blocks: DataFrame, recognise: Callable[[DataFrame, int], DataFrame], rounds: int, most: int, kinds: tuple[str, ...] = KINDS, attempts: DataFrame | None = None) -> DataFrame:
    """The attempts of all rounds, as scratch tables: each recognises again, of each kind and document, at most the budget's share.

    recognise takes blocks and a round's number and gives (id, text). attempts are those of a run that stopped after some
    rounds; the next one follows.
    """
    spark = blocks.sparkSession
    found = attempts if attempts is not None else spark.createDataFrame([], ATTEMPTS)
    done = found.agg(F.max("round")).first()[0] or 0
    for number in range(done + 1, rounds + 1):
        now = materialise(applied(blocks, found), "blocks")
        todo = bl.retry_quota(missing(now, kinds[0]), most).select("id")
        for kind in kinds[1:]:
            todo = todo.union(bl.retry_quota(missing(now, kind), most).select("id"))
        new = recognise(now.join(todo.distinct(), "id", "left_semi"), number).select("id", F.lit(number).alias("round"), "text")
        new = materialise(new, "attempts")
        if new.isEmpty():
            break
        found = found.union(new)
    return found
