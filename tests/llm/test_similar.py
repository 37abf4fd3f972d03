"""The pipeline's near-duplicates against all pairs of shingle sets."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def brute_kept(rows):
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if comp[i] != comp[j] and (a == b or 5 * len(a & b) >= 4 * len(a | b)):
                comp = [comp[j] if c == comp[i] else c for c in comp]
    best = {}
    for c, (i, _) in zip(comp, rows):
        best[c] = min(best.get(c, (True, 0)), (i is None, i or 0))
    return sorted([(i is None, i or 0) for c, (i, _) in zip(comp, rows) if (i is None, i or 0) == best[c]])


@pytest.mark.parametrize("small", [16, 2])
def test_drops_all_pairs_of_similarity(spark, monkeypatch, small):
    from millrace.llm import similar

    monkeypatch.setattr(similar, "SMALL", small)
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    texts = []
    for k in range(12):
        w = passage[: 5 * (k % 7)] + [rng.choice(vocabulary) for _ in range(rng.randint(1, 150))]
        texts.append(w)
        for _ in range(25 if k == 3 else rng.randint(0, 4)):
            x = list(w)
            for _ in range(rng.randint(1, 4)):
                x[rng.randrange(len(x))] = rng.choice(vocabulary)
            texts.append(x)
    rng.shuffle(texts)
    rows = [(i, " ".join(t).upper() if i % 3 else "  ".join(t)) for i, t in enumerate(texts)]
    rows += [(900, None), (901, " "), (902, "one"), (903, "One two"), (904, "ONE"), (None, rows[0][1]), (None, "own text of a row without an id"), (905, "own text two"), (905, "another text of the same id")]
    got = similar.drop_similar(make(spark, rows))
    assert got.columns == SCHEMA.replace("long", "").replace("string", "").replace(" ", "").split(",")
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == brute_kept(rows)
    assert similar.drop_similar(make(spark, [])).count() == 0


def test_stage_drops_near_copies_and_keeps_null_ids(spark):
    import corpus_pipeline

    rng = random.Random(12)
    w = [f"w{rng.randrange(500)}" for _ in range(80)]
    x = w[:20] + ["changed"] + w[21:]
    rows = [(1, " ".join(w)), (2, " ".join(x)), (3, " ".join(w) + " th"), (None, "a text of its own without any id")]
    stage = dict(corpus_pipeline.STAGES)["simhash near-dedup"]
    assert {r.doc_id for r in stage(spark, make(spark, rows), "").collect()} == {1, None}


def test_pairs_are_left_out_by_parity_maps_without_prefixes(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from millrace.llm import similar

    rng = random.Random(13)
    texts = []
    for n in (4, 40, 60, 63, 120, 128, 500):  # sets on both sides of a map's length
        w = [f"v{rng.randrange(10**6)}" for _ in range(n)]
        texts += [w, w[: n - n // 6], w + [f"x{k}" for k in range(n // 5)], w[: n // 2] + ["other"] + w[n // 2 :], [f"v{rng.randrange(10**6)}" for _ in range(n)]]
    texts = [" ".join(w) for w in texts]
    sets = [similar.shingle_set(t.encode()) for t in texts]
    marked = similar._marked(make(spark, list(enumerate(texts))), "doc_id", "text", similar.SHINGLE, similar.SIMILARITY)
    reps = marked.select(F.col("id").alias("sid"), "rkey", "n", "bits").localCheckpoint()
    apart = reps.alias("a").crossJoin(reps.alias("b")).select("a.sid", "b.sid", similar._bits_apart(F.col("a.bits"), F.col("b.bits")), F.size("a.bits"), F.size("b.bits")).collect()
    found = 0
    for a, b, bits, long_a, long_b in apart:
        differ = len(np.setxor1d(sets[a], sets[b]))
        assert (bits is None) == (max(long_a, long_b) > 2 * min(long_a, long_b))
        assert bits is None or bits <= differ and (differ or bits == 0)
        found += bits is not None and 9 * bits > len(sets[a]) + len(sets[b])
    assert found > 100
    rows = reps.join(make(spark, list(enumerate(texts))).select(F.col("doc_id").alias("sid"), F.encode("text", "utf-8").alias("text")), "sid").select("rkey", "text")
    every = spark.createDataFrame([(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts))], "a long, b long")
    want = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b]))}
    for most in (similar.MOST_KEYS, 10):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(similar, "MOST_KEYS", most)
            assert {tuple(r) for r in similar._confirmed(every, reps, rows, similar.SHINGLE, similar.SIMILARITY).collect()} == want


def test_texts_go_to_python_in_small_batches(spark, monkeypatch):
    from millrace.llm import similar

    key, seen, settle = "spark.sql.execution.arrow.maxRecordsPerBatch", {}, similar.settle
    before = spark.conf.get(key)
    monkeypatch.setattr(similar, "settle", lambda df, name: (seen.setdefault(name, int(spark.conf.get(key))), settle(df, name))[1])
    w = " ".join(f"w{k}" for k in range(60))
    similar.drop_similar(make(spark, [(1, w), (2, w + " more"), (3, "a text of its own")])).collect()
    assert seen["similar-marked"] <= 256 and seen["similar-sets"] <= 256
    assert spark.conf.get(key) == before
