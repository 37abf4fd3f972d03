"""Ids of any text, null ids and repeated rows go through archives and back."""

from __future__ import annotations

import hashlib

from millrace.llm.warc import round_trip

BIG = "x" * 150


def test_ids_of_any_text_come_back(spark):
    ids = ["None", "a\nb", "a b", "100%", "<urn:page:1>", "é+/", "", None, None]
    rows = [(i, "http://a.org/", BIG, 1, "z") for i in ids] + [("None", None, BIG, 1, "z"), ("small", "u", "tiny", 1, "z"), (None, "u", "tiny", 1, "z"), ("null", "u", None, 1, "z")]
    got = round_trip(spark, spark.createDataFrame(rows, "page_id string, url string, html string, offset int, digest string")).collect()
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    first = min(i for i in ids if i is not None)
    want = [(i, 150, digest(BIG), *(("response", None) if i == first else ("revisit", first))) for i in [*ids, "None"]]
    want += [("small", 4, digest("tiny"), "response", None), (None, 4, digest("tiny"), "response", None), ("null", 0, digest(""), "response", None)]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_only_null_ids_and_no_rows(spark):
    rows = spark.createDataFrame([(None, "u", BIG), (None, "u", BIG)], "page_id long, url string, html string")
    assert [tuple(r) for r in round_trip(spark, rows).collect()] == [(None, 150, hashlib.sha256(BIG.encode()).hexdigest(), "response", None)] * 2
    assert round_trip(spark, rows.limit(0)).count() == 0
