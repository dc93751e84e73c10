"""Account cues, long texts, null ids and repeated rows of the personal-data operator."""

import time

import pytest

from quillstack.llm import pii


@pytest.mark.parametrize(("text", "value"), [
    ("Api_Key: zx81ab22cc90", "zx81ab22cc90"), ("apiKey: zx81ab22cc90", "zx81ab22cc90"), ("API_key=zx81ab22cc90", "zx81ab22cc90"), ('{"access_token": "zx81ab22cc90"}', "zx81ab22cc90"),
    ("Passport number is X12345678", "X12345678"), ("my IBAN: DE89 3704 0044 0532 0130 00, thanks", "DE89 3704 0044 0532 0130 00"), ("iban GB82-WEST-1234-5698-7654-32.", "GB82-WEST-1234-5698-7654-32"),
    ("the key to success is patience", None), ("monkey: 123456789012", None), ("keyboard 123456789", None), ("iban DE00 1111 2222 3333 4444 55", None), ("account no. 12-345-678-9", "12-345-678-9")])
def test_accounts_after_a_cue(text, value):
    found = [text[a:b] for a, k, b in pii.find(text) if pii.KINDS[k] == "account"]
    assert found == ([value] if value else [])


@pytest.mark.parametrize("unit", ["key ", "key" + " " * 50, "a@", "+1 ", "1.", "://", "a://b.", "key=a-", "@a.", "is key:", "12 ", "key\t\"", "iban ", "a+b-c.", "DE89 3704 "])
def test_long_texts_take_linear_time(unit):
    for text in (unit * (1_000_000 // len(unit)), "key" + unit[-1] * 1_000_000, unit + " " * 1_000_000 + "x"):
        began = time.process_time()
        pii.find(text)
        assert time.process_time() - began < 20


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, "a@b.org"), (1, "a@b.org"), (1, "a@b.org"), (2, None)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, spans string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_email, r.spans) for r in pii.digests(docs).collect())
    assert got == [(False, 1, 1, "email:0:7")] * 2 + [(False, 2, 0, ""), (True, 0, 1, "email:0:7")]
