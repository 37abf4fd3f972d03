"""Brute-force checks of substring, line and SimHash deduplication on small tables."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA)


def brute_substrings(texts, length=200):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = {}
    for k, d in enumerate(data):
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(d)) if gone[i] and not (i and gone[i - 1]))
        out[k] = (len(d), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(d, gone) if not g)).hexdigest())
    return out


def pieces(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdé ") for _ in range(420)) for _ in range(3)]
    texts = ["".join(rng.choice(base)[rng.randint(0, 150) : rng.randint(150, 420)] + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 60))) for _ in range(5)) for _ in range(25)]
    return texts + [texts[0], texts[1], "a" * 900, "ab" * 300, None, "", "short", texts[3] + "tail", "é" * 250]


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings_match_brute_force(spark, seed):
    from millrace.llm.suffix_radix import drop_repeated_substrings, substring_report

    texts = pieces(seed)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_report(make(spark, texts)).collect()}
    assert got == brute_substrings(texts)
    kept = drop_repeated_substrings(make(spark, texts))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r.doc_id: r.text for r in kept.collect()}[29] is None


def test_substrings_empty_table(spark):
    from millrace.llm.suffix_radix import substring_report

    assert substring_report(make(spark, [])).count() == 0


def brute_lines(texts, min_chars=20, min_docs=3):
    held = defaultdict(set)
    key = lambda x: x.encode().strip().lower().decode()
    for i, t in enumerate(texts):
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                held[key(x)].add(i)
    out = {}
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (len(held.get(key(x), ())) >= min_docs and max(held[key(x)]) != i)]
        out[i] = (len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest())
    return out


@pytest.mark.parametrize("log2_bits", [4, 20, None])
def test_lines_match_brute_force_even_with_a_full_filter(spark, log2_bits):
    from millrace.llm.line_dedup import drop_repeated_lines, line_report

    rng = random.Random(3)
    common = [f"This LINE number {k} is found in many documents" for k in range(6)] + ["kurz", "é" * 20, "é" * 19]
    texts = ["\n".join(rng.choice(["  ", "\t", ""]) + rng.choice([rng.choice(common), f"own line {rng.random()} of the document", ""]) for _ in range(rng.randint(1, 9))) for _ in range(40)] + [None, "", "x" * 200_000]
    df = make(spark, texts)
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_report(df, log2_bits=log2_bits).collect()}
    assert got == brute_lines(texts)
    kept = drop_repeated_lines(df, log2_bits=log2_bits)
    assert kept.columns == df.columns and kept.count() == len(texts)
    assert line_report(make(spark, [])).count() == 0


def test_few_lines_are_suspected_where_none_repeats(spark):
    from millrace.llm import line_dedup as ld

    rng = random.Random(5)
    texts = ["\n".join(f"line {rng.random()} of its own {rng.random()}" for _ in range(50)) for _ in range(400)]
    df = make(spark, texts)
    bits = ld.filter_bits(df, "text")
    assert 8 * 20_000 <= 1 << bits <= 16 * 20_000
    filt = np.frombuffer(ld.twice_seen(df, "text", 20, bits), np.uint8)
    keys = [k for t in texts for k in ld._keys(t.encode(), 20)]
    assert ld._is_set(filt, ld._bits(keys, bits)).all(axis=1).mean() < 0.05


def test_lines_with_repeated_rows_and_clashing_columns(spark):
    from millrace.llm.line_dedup import drop_repeated_lines

    line = "the same line in every row of it"
    df = spark.createDataFrame([(1, line, "k"), (1, line, "k"), (2, line, "k"), (None, line, "k")], "doc_id long, text string, keys string")
    assert [r.text for r in drop_repeated_lines(df).collect()] == [line] * 4  # two documents only


def brute_simhash(texts):
    fps = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0)
    comp = list(range(len(fps)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((root(i), root(j)))
                comp[b] = a
    return {i: (f"{fps[i]:016x}", root(i)) for i in range(len(fps))}


def test_simhash_matches_brute_force(spark):
    from millrace.llm.simhash import drop_near_duplicates, near_duplicates

    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(300)]
    texts = []
    for _ in range(25):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(1, 200))]
        texts.append(" ".join(w))
        for _ in range(rng.randint(0, 4)):
            x = list(w)
            x[rng.randrange(len(x))] = rng.choice(vocabulary)
            texts.append("  ".join(x).upper())
    texts += [None, "", "   ", "one", "one two", "ONE two", "long " * 50_000]
    df = make(spark, texts)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in near_duplicates(df).collect()}
    want = brute_simhash(texts)
    assert got == want
    assert {r.doc_id for r in drop_near_duplicates(df).collect()} == {c for _, c in want.values()}
    assert near_duplicates(make(spark, [])).count() == 0


def test_covering_masks_catch_every_pair_of_bits():
    from millrace.llm.simhash import FREE

    assert all(any(i in f and j in f for f in FREE.values()) for i in range(64) for j in range(64))


def test_simhash_keeps_rows_without_ids_and_clashing_columns(spark):
    from millrace.llm.simhash import drop_near_duplicates, near_duplicates

    rows = [(None, "own text of a row without id", 1), (None, "quite another thing, also without", 2), (None, "quite another thing, also without", 2), (5, "first text with an id here", 3), (None, "first text with an id here", 4), (7, "first text with an id here", 5), (5, "a second text of that id", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, group long")
    assert sorted(r.group for r in drop_near_duplicates(df).collect()) == [1, 2, 2, 3, 6]
    assert sorted((str(r.doc_id), str(r.component_id)) for r in near_duplicates(df).collect()) == [("5", "5"), ("5", "5"), ("7", "5"), ("None", "5")] + [("None", "None")] * 3
