"""Benchmark items that share an id or have none, documents without ids, clashing columns, and terms that are not broadcast."""

import hashlib
import random

import pytest


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_items_of_one_id_and_without_id_are_all_found(spark, monkeypatch, most):
    from millrace.llm import decontaminate as dc

    monkeypatch.setattr(dc, "MOST_BROADCAST", most)
    items = [(1, "alpha beta gamma"), (1, "delta epsilon zeta"), (1, "alpha beta gamma"), (None, "eta theta iota"), (None, "kappa lambda my"), (2, "eta theta iota")]
    texts = ["x alpha beta gamma", "delta epsilon zeta x", "x eta theta iota x", "kappa lambda my", "alpha delta eta kappa", "alpha beta gamma kappa lambda my"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {}
    for i, t in enumerate(texts):
        found = {(k, s) for k, s in items if f" {s} " in f" {t} "}
        ids = {k for k, _ in found}
        names = ",".join(sorted(str(k) for k in ids if k is not None))
        want[i] = (3 * len({s for _, s in found}), len(ids), hashlib.sha256(names.encode()).hexdigest(), bool(found))
    got = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in dc.contamination(df, bench).collect()}
    assert got == want
    assert [r.doc_id for r in dc.drop_contaminated(df, bench).collect()] == [4]


def test_documents_without_ids_repeated_rows_and_clashing_columns(spark):
    from millrace.llm.decontaminate import contamination, drop_contaminated

    bench = spark.createDataFrame([(7, "alpha beta gamma")], "item_id long, text string")
    rows = [(None, "so alpha beta gamma", 1), (None, "clean text", 2), (3, "alpha beta gamma", 3), (3, "alpha beta gamma", 3), (3, "other text of that id", 4), (5, None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row long").withColumnRenamed("row", "words").withColumnsRenamed({"words": "row"})
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in contamination(df, bench).collect()), key=str)
    assert got == sorted([(None, 4, 3, True), (None, 2, 0, False), (3, 3, 3, True), (3, 3, 3, True), (3, 5, 0, False), (5, 0, 0, False)], key=str)
    assert sorted(r.row for r in drop_contaminated(df, bench).collect()) == [2, 4, 5]


def brute_near(words, window, slop):
    """The least number of words from each start that hold the window in order."""
    out = set()
    for at in range(len(words)):
        i, k = at, 0
        while i < len(words) and i < at + len(window) + slop and k < len(window):
            k += words[i] == window[k] if (i > at or words[i] == window[0]) else 0
            if i == at and k == 0:
                break
            i += 1
        if k == len(window):
            out |= set(range(at, i))
    return out


@pytest.mark.parametrize("slop", [0, 1, 3])
def test_phrases_and_proximity_match_brute_force_on_few_words(spark, slop):
    from millrace.llm.decontaminate import contamination

    rng = random.Random(slop)
    say = lambda n: [rng.choice("abcd") for _ in range(n)]
    items = [(k, say(rng.choice([1, 3, 4, 5, 7]))) for k in range(2, 9)]
    items = [(k, w) for k, w in items if slop == 0 or len(w) > 1]
    texts = [say(rng.randint(0, 30)) for _ in range(40)]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items) for r in contamination(df, bench, window=4, slop=slop).collect()}
    for i, t in enumerate(texts):
        hit, ids = set(), set()
        for k, w in items:
            for s in range(max(1, len(w) - 3)):
                if found := brute_near(t, w[s : s + 4], slop):
                    hit |= found
                    ids.add(k)
        assert got[i] == (len(hit), len(ids)), (i, t)
