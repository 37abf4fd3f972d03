"""Keywords by RAKE against a plain count, for keys of one row and of several."""

from __future__ import annotations

import re

import pytest

from millrace.operators import text

WORD = re.compile(r"\w+")


def _brute(texts, top):
    """The phrases of all texts of one key, best first."""
    stop, phrases = set(text.STOP_WORDS["en"].split()), []
    for t in texts:
        for part in re.split(r"[^\w\s]+", t.lower()):
            run = []
            for w in [*WORD.findall(part), None]:
                if w is None or w in stop:
                    phrases += [tuple(run)] if run else []
                    run = []
                else:
                    run.append(w)
    value = {w: sum(len(p) for p in phrases for x in p if x == w) / sum(x == w for p in phrases for x in p) for p in phrases for w in p}
    return sorted(((-round(sum(value[w] for w in p), 9), " ".join(p)) for p in set(phrases)))[:top]


TEXTS = [
    "Deep learning models need data. The deep learning field is new, and data is\nthe new data of models!",
    "Große Öfen heizen: größe, ÉTÉ chaud; 42 wells_of 42 oil 𝐚the end. été chaud été",
    "the of and",
    "",
    None,
    "one word word word, word word two; one two and two one",
]


@pytest.mark.parametrize("most", [0, 100])
def test_rake_by_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(text, "MOST_SHARED", most)
    keyed = [*enumerate(TEXTS), (10, TEXTS[0]), (10, TEXTS[5]), (10, TEXTS[0]), (None, TEXTS[1]), (None, TEXTS[5])]
    want = {}
    for k in {k for k, _ in keyed}:
        for r, (score, p) in enumerate(_brute([t for key, t in keyed if key == k and t], 4), 1):
            want[k, r] = (p, -score)
    got = text.keyword_rake_yake(spark.createDataFrame(keyed, "id int, t string"), "t", "id", topK=4)
    assert got.columns == ["id", "keyword", "score", "rank"]
    assert {(g.id, g["rank"]): (g.keyword, round(g.score, 9)) for g in got.collect()} == want


def test_rake_shuffles_no_text_of_single_rows(spark):
    df = spark.createDataFrame([(i, f"some words{i}, other words") for i in range(20)], "id int, t string")
    plan = text.keyword_rake_yake(df, "t", "id", topK=2)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
