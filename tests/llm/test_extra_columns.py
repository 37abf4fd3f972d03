"""Columns of any name stay as they are in all functions that return documents; long runs of marks take linear time."""

from __future__ import annotations

import time

import pytest

from millrace.llm import decontaminate, kneser_ney, line_dedup, sentence_spans, similar, simhash, suffix_radix

NAMES = ["__rid", "__text", "__id", "__keys", "__rkey", "__good_text", "__lost_id", "__bad_md5", "__of", "__runs", "rid", "row", "key", "runs", "sid", "digest", "component", "first", "a b", "c.d", "e`f", "extra_3_of_docs"]
LONG = "A line of some words that is long enough to count. And one more sentence of several words here. Then a third one that ends the passage."


@pytest.mark.parametrize("fn", [sentence_spans.drop_repeated_spans, suffix_radix.drop_repeated_substrings, line_dedup.drop_repeated_lines, similar.drop_similar, simhash.drop_near_duplicates, kneser_ney.keep_good, decontaminate.drop_contaminated], ids=lambda f: f.__name__)
def test_extra_columns_of_any_name_stay(spark, fn):
    texts = [LONG, LONG, LONG, "Nothing that others have, said in ten words or a few more.", None, ""]
    rows = [(i, t, "en", *(f"{n}{i}" for n in NAMES)) for i, t in enumerate(texts)]
    schema = ", ".join(["doc_id long", "text string", "lang string", *("`" + n.replace("`", "``") + "` string" for n in NAMES)])
    docs = spark.createDataFrame(rows, schema)
    more = [spark.createDataFrame([("i", "zz yy xx")], "item_id string, text string")] if fn is decontaminate.drop_contaminated else []
    out = fn(docs, *more)
    assert out.columns == docs.columns
    for r in out.collect():
        assert list(r)[3:] == [f"{n}{r.doc_id}" for n in NAMES]


def test_sentences_of_long_runs_of_marks():
    start = time.time()
    dots = b"." * 5_000_000
    assert sentence_spans.sentences(dots + b"x") == [dots + b"x"]
    assert sentence_spans.sentences(dots) == [dots]
    assert time.time() - start < 20
    assert sentence_spans.sentences(b"One.. two!?  x.y z\nlast one") == [b"One.. ", b"two!?  ", b"x.y z", b"\n", b"last one"]
