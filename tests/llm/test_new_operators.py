"""URL filter, conversation trie and whitening against brute force on small tables."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import prefix_trie, url_filter, whitening

PAGES = "page_id long, url string, verdict int"


def _murmur3(data: bytes, seed: int = 42) -> int:
    """32-bit Murmur3 of a public description."""
    mask, h = 0xFFFFFFFF, seed
    rotl = lambda x, r: ((x << r) | (x >> (32 - r))) & mask
    whole = len(data) // 4 * 4
    for i in range(0, whole, 4):
        h = (rotl(h ^ (rotl(int.from_bytes(data[i : i + 4], "little") * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask), 13) * 5 + 0xE6546B64) & mask
    if tail := int.from_bytes(data[whole:], "little"):
        h ^= rotl(tail * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
    h ^= len(data)
    for shift, m in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ (h >> shift)) * m & mask
    return h


def _parts(url: str | None) -> tuple[str, str]:
    _, sep, rest = (url or "").partition("://")
    cut = lambda s, ends: min([s.find(e) for e in ends if e in s] or [len(s)])
    host = rest[: cut(rest, "/?#")] if sep else ""
    path = rest[len(host) :]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path[: cut(path, "?#")]


def _rule(host: str, path: str) -> tuple[str, str] | None:
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else None


URLS = ["https://A.Example.NET/en/1?x=/de/", "http://example.net", "https://x.org/fr/9#a", "https://notexample.com/de/1", "https://example.com/de/", "https://m.example.com/DE/", "net/en/", None, "", "://", "ftp://net/", "https://casino-poker.example.org/en/1.html", "https://a.org/x\ny://b.net/", "https://ex.org/pills/" + "a" * 200_000, "https://museum.example.org/de/7", "http://host.net?q://other.org/fr/", "https://ünïcode.example.org/straße/ß"]


def test_url_rules_and_scores_by_brute_force(spark):
    pages = spark.createDataFrame([(i if i != 3 else None, u, 1) for i, u in enumerate(URLS + URLS[:2])], PAGES)
    model = url_filter.fit(url_filter.labelled_urls(spark))
    got = url_filter.judge(pages, model=model).collect()
    assert len(got) == len(URLS) + 2
    w, b = model.coefficients.toArray(), model.intercept
    want = []
    for i, u in enumerate(URLS + URLS[:2]):
        host, path = _parts(u)
        seen = set()
        for text, mark in ((f"<{host}>", "h"), (path, "p")):
            text = "".join("0" if c in "123456789" else c for c in text)
            seen |= {mark + text[k : k + n] for n in url_filter.N_GRAMS for k in range(len(text) - n + 1)}
        buckets = {((h := _murmur3(g.encode())) - (1 << 32) * (h >> 31)) % url_filter.BUCKETS for g in seen}
        score = 1 / (1 + math.exp(-(b + sum(w[k] for k in buckets))))
        rule = _rule(host, path)
        want.append((i if i != 3 else None, host, path, rule and rule[0], rule[1] if rule else "block" if score >= url_filter.THRESHOLD else "allow", score))
    key = lambda r: (r[0] is None, r[0] or 0)
    for g, x in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:5] == x[:5]
        assert g[5] == pytest.approx(x[5], abs=1e-6)


def test_url_model_on_subjects_it_has_not_seen(spark):
    table = url_filter.labelled_urls(spark).withColumn("fold", F.pmod(F.xxhash64(F.regexp_extract("url", "[a-z]{4,}", 0)), F.lit(4)))
    model = url_filter.fit(table.where("fold <> 0"))
    out = url_filter.judge(table.where("fold = 0 and label = 0").withColumnRenamed("label", "page_id"), rules=[], model=model)
    assert out.where("verdict = 'block'").count() <= 0.05 * out.count()
    unseen = ["https://casinoking.example.org/en/1", "https://hot-pornsite.example.com/en/1", "https://viagra-pills.example.org/1", "https://malwares.example.com/1", "https://pokerslots.example.org/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(unseen)], "page_id long, url string")
    assert [r.verdict for r in url_filter.judge(pages).orderBy("page_id").collect()] == ["block"] * len(unseen)


def test_url_filter_runs_no_python_and_takes_an_empty_table(spark):
    pages = spark.createDataFrame([], PAGES)
    out = url_filter.judge(pages)
    assert out.count() == 0
    assert not any(x in out._jdf.queryExecution().toString() for x in ("Python", "Arrow", "Pandas"))
    model = url_filter.fit(spark.createDataFrame([("https://a.org/", 0), (None, 1), ("https://b.org/", None)], "url string, label int"))
    assert np.isfinite(model.intercept)


def _brute_trie(rows: list[tuple], rebuild: bool = True) -> set[tuple]:
    convs: dict[int, list] = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        convs.setdefault(c, []).append((role or "", text or ""))
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuild else 0
        built[c] = convs.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:]
    members: dict[tuple, list[int]] = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {v: [u for u in members if u and u[:-1] == v] for v in members}
    out = set()
    for v, m in members.items():
        below = [u for u in members if u[: len(v)] == v]
        ids = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(v))
        saved = sum((len(members[u]) - 1) * len(u[-1][1]) for u in below if u)
        out.add((min(m), len(v), min(members[v[:-1]]) if v else None, len(m), len(kids[v]), sum(not kids[u] for u in below), saved, hashlib.sha256(ids.encode()).hexdigest()))
    return out


TURNS = "conv_id long, turn long, role string, text string, depth int, k1 string"


def _random_turns(seed: int, n: int, long: int) -> list[tuple]:
    r = random.Random(seed)
    rows = []
    for c in {0, 100, *(r.randrange(-250, 500) for _ in range(n))}:
        turns = r.randrange(1, 9) if r.random() < 0.95 else long
        for t in range(turns):
            rows.append((c, t if r.random() < 0.98 or t else None, r.choice(["user", "user", None]), r.choice(["", "a", "bcé", None, "a\nb"]) if t < 3 or r.random() < 0.2 else "same"))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("levels", [10, 2])
def test_trie_by_brute_force(spark, monkeypatch, levels):
    monkeypatch.setattr(prefix_trie, "LEVELS", levels)  # with 2, chunks are positions of the recursion twice over
    rows = [r for r in _random_turns(levels, 60, 21)]
    rows += [(7001, 0, "user", "x"), (7002, 0, "user", "x"), (7002, 1, "user", "y"), (None, 0, "user", "x"), (800, None, None, None)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], TURNS)
    for rebuild in (True, False):
        got = prefix_trie.trie(df, rebuild=rebuild).collect()
        assert len(got) == len(set(map(tuple, got)))
        assert set(map(tuple, got)) == _brute_trie(rows, rebuild)


def test_trie_of_repeats_turnless_and_empty(spark):
    same = [(c, t, "user", "tt") for c in range(1, 40) for t in range(2) for _ in range(2)]
    turnless = [(4000 + c, 0, "u", "only") for c in range(1, 20)]
    rows = same + turnless
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], TURNS)
    assert set(map(tuple, prefix_trie.trie(df).collect())) == _brute_trie(rows)
    empty = prefix_trie.trie(df.limit(0))
    assert empty.count() == 0 and empty.columns[0] == "conv_id"


def _brute_whiten(vectors: dict, k: int = 32):
    x = np.array([[math.floor(64 * float(np.float64(c))) + 1_000_000 for c in v] for v in vectors.values()], dtype=np.int64)
    n, s = len(x), x.sum(axis=0)
    q = n * x - s
    dev = [sum(int(a) ** 2 for a in row) for row in q]
    c = q / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return n, dev, c @ u, e, e / np.trace(c.T @ c / n)


VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("row", T.StringType()), T.StructField("x", T.StringType())])


@pytest.mark.parametrize("d", [3, 40])
def test_whitening_by_brute_force(spark, d):
    r = np.random.default_rng(d)
    good = {i: [float(np.float32(c)) for c in r.normal(size=d) * np.arange(1, d + 1)] for i in range(137)}
    bad = [(900, None), (901, []), (902, [None] * d), (903, [float("nan")] * d), (904, [float("inf")] + [0.0] * (d - 1)), (905, [1.0] * (d + 1))]
    df = spark.createDataFrame([(i, v, "a", "b") for i, v in [*good.items(), *bad]], VECTORS).repartition(5)
    rows = whitening.whiten(df).orderBy("vec_id", "component").collect()
    k = min(32, d)
    assert len(rows) == len(good) * k
    n, dev, proj, e, share = _brute_whiten(good)
    z = np.array([x.whitened for x in rows]).reshape(n, k)
    want = proj / np.sqrt(e)
    sign = np.sign((z * want).sum(axis=0))
    assert np.allclose(z, want * sign, atol=1e-8)
    assert [x.deviation for x in rows[::k]] == dev and {x.n for x in rows} == {n}
    assert [x.component for x in rows[:k]] == list(range(1, k + 1))
    assert np.allclose([x.explained for x in rows[:k]], share, rtol=1e-6)
    assert max(x.identity_error for x in rows) < 1e-9


def test_whitening_without_variance_repeats_and_empty(spark):
    flat = spark.createDataFrame([(1, [1.0, 2.0, 5.0], "", ""), (1, [1.0, 3.0, 5.0], "", ""), (None, [1.0, 3.0, 5.0], "", "")], VECTORS)
    rows = whitening.whiten(flat).orderBy("component").collect()
    assert len(rows) == 9
    assert all(x.whitened is not None for x in rows[:3]) and all(x.whitened is None and abs(x.explained) < 1e-12 for x in rows[3:])
    one = whitening.whiten(flat.limit(1)).collect()
    assert [(x.n, x.deviation, x.whitened, x.explained, x.identity_error) for x in one] == [(1, 0, None, None, None)] * 3
    assert whitening.whiten(flat.limit(0)).count() == 0
    huge = spark.createDataFrame([(1, [3e38, 1.0], "", ""), (2, [-3e38, 2.0], "", "")], VECTORS)
    assert {x.deviation for x in whitening.whiten(huge).collect()} == {None}
