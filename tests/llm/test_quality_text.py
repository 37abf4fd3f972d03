"""Quality model, toxicity, HTML, WARC, spans, mixing, decontamination and the pipeline on small fixtures."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, texts, lang="en", source=None):
    return spark.createDataFrame([(i, t, lang, (source or (lambda k: f"s{k % 3}"))(i), len(t or "")) for i, t in enumerate(texts)], SCHEMA)


def prose(rng, n=60):
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "re"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


# quality rules


def brute_base(text):
    w = (text or "").encode().split()
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for x in (text or "").split("\n"):
        if x.encode().split():
            dup += x in seen
            seen.add(x)
    chars = sum(len(x.decode()) for x in w)
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(w), chars, symbols, dup, len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)


def test_base_rules_match_brute_force():
    from millrace.llm.kneser_ney import base_rules

    rng = random.Random(1)
    texts = [None, "", "  \n ", "a b c d e a b c d e", "é x # <b>\n\nx\nx", "x " * 500] + ["\n".join(prose(rng, rng.randint(1, 12)) for _ in range(4)) * rng.randint(1, 2) for _ in range(30)]
    for t in texts:
        assert base_rules(t.encode() if t is not None else None)[1] == brute_base(t)


def brute_kn(texts, order):
    """Modified Kneser-Ney by the textbook, over one language."""
    raw = defaultdict(Counter)
    for t in texts:
        s = "\n" + " ".join(t.split()) + " "
        for i in range(2, len(s) + 1):
            g = s[max(0, i - order) : i]
            raw[len(g)][g] += 1
    counts = {order: dict(raw[order])}
    for k in range(order - 1, 0, -1):
        left = defaultdict(set)
        for g in counts[k + 1]:
            left[g[1:]].add(g[0])
        counts[k] = {g: len(v) for g, v in left.items()} | dict(raw[k])
    lower, out = None, {}
    for k in range(1, order + 1):
        n = [sum(1 for c in counts[k].values() if c == i) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else None
        d = [0.0]
        for i in (1, 2, 3):
            ok = y is not None and n[i]
            d.append(max(0.0, min(i, i - (i + 1) * y * n[i + 1] / n[i])) if ok and i + 1 < 5 else 0.5 * i)
        total, gone = Counter(), Counter()
        for g, c in counts[k].items():
            total[g[:-1]] += c
            gone[g[:-1]] += d[min(c, 3)]
        p = {}
        for g, c in counts[k].items():
            b = gone[g[:-1]] / total[g[:-1]]
            base = 1 / (len(counts[1]) + 1) if lower is None else lower[g[1:]]
            p[g] = (c - d[min(c, 3)]) / total[g[:-1]] + b * base
        out |= p
        lower = p
    return out


@pytest.fixture(scope="module")
def fitted(spark):
    from millrace.llm import kneser_ney as kn

    rng = random.Random(2)
    docs = make(spark, [prose(rng) for _ in range(12)])
    return docs, kn.fit(kn.count_grams(docs, order=3), 3)


def test_model_matches_textbook(fitted):
    from millrace.llm.kneser_ney import UNIT

    docs, model = fitted
    got = {r.gram: math.exp(r.logp / UNIT) for r in model.collect() if r.logp is not None}
    want = brute_kn([r.text for r in docs.collect()], 3)
    assert got.keys() == want.keys()
    for g, p in want.items():
        assert got[g] == pytest.approx(p, rel=1e-4)


def test_scores_are_sums_of_logs_across_words(spark, fitted):
    from millrace.llm.kneser_ney import UNIT, score

    docs, model = fitted
    p = brute_kn([r.text for r in docs.collect()], 3)
    for r in score(docs, model, order=3).join(docs.select("doc_id", "text"), "doc_id").collect():
        s = "\n" + " ".join(r.text.split()) + " "
        grams = [s[max(0, i - 3) : i] for i in range(2, len(s) + 1)]
        assert r.nll / UNIT == pytest.approx(-sum(math.log(p[g]) for g in grams), rel=1e-4)


def test_joined_scores_equal_broadcast_scores(spark, fitted):
    from millrace.llm import kneser_ney as kn

    docs, model = fitted
    odd = make(spark, ["unseen zzz qqq words that the model never met at all ok", "né \0 ñandú 漢字 x y z 1 2 3 4 5", None, ""]).withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id") + 100))
    more = docs.unionByName(odd).unionByName(docs.limit(1))
    a = sorted(((r.doc_id, r.nll) for r in kn.score(more, model, order=3).collect()), key=str)
    assert a == sorted(((r.doc_id, r.nll) for r in kn.score(more, model, order=3, max_broadcast=0).collect()), key=str)
    both = [sorted(((r.doc_id, r.perplexity, r.kept) for r in kn.quality(more, order=3, max_broadcast=m).collect()), key=str) for m in (kn.MAX_BROADCAST, 0)]
    assert both[0] == both[1]


def test_long_texts_in_pieces_score_and_count_as_whole_ones():
    from millrace.llm import kneser_ney as kn

    rng = random.Random(8)
    texts = [prose(rng, n) + " " for n in (200, 3, 90)]
    whole, cut = ([(kn.point_grams(p.points(np.arange(len(p.at)))), p.owner.tolist()) for p in kn.text_pieces(texts, 4, piece)] for piece in (1 << 20, 17))
    flat = lambda parts: [(i, g) for grams, owner in parts for i, g in zip(owner, grams, strict=True)]
    assert flat(whole) == flat(cut) == [(k, ("\n" + t)[max(0, i - 4) : i]) for k, t in enumerate(texts) for i in range(2, len(t) + 2)]


def chain(rng, n=120):
    """Words each of which settles how the next one begins."""
    out, c = [], rng.choice("abcdefgh")
    for _ in range(n):
        after = "bcdefgha"["abcdefgh".index(c)]
        out.append(c + rng.choice(["an", "er", "ist", "ol"]) + after)
        c = after
    return out


def test_word_order_counts_and_bands_match_brute_force(spark):
    from statistics import median

    from millrace.llm.kneser_ney import quality

    rng = random.Random(9)
    good = [chain(rng, rng.randint(60, 200)) for _ in range(60)]
    salad = [rng.sample(w, len(w)) for w in good[:6]]
    rows = {r.doc_id: r for r in quality(make(spark, [" ".join(w) for w in good + salad])).collect()}
    assert all(rows[60 + k].perplexity > 1.5 * rows[k].perplexity for k in range(6))
    assert not any(rows[60 + k].kept for k in range(6)) and sum(rows[k].kept for k in range(60)) >= 57
    x = {k: round(math.log(r.perplexity), 3) for k, r in rows.items()}
    mid = median(x.values())
    mad = median(round(abs(v - mid), 3) for v in x.values())
    one = median(round(abs(v - mid) * math.sqrt(rows[k].n_words), 2) for k, v in x.items())
    for r in rows.values():
        wide = 3.0 * math.sqrt(mad**2 + one**2 / r.n_words)
        assert (math.log(r.lower), math.log(r.upper)) == (pytest.approx(mid - wide, abs=1e-6), pytest.approx(mid + wide, abs=1e-6))
        assert r.kept == (not r.base_failed and r.lower <= r.perplexity <= r.upper)


def test_quality_rejects_what_is_out_of_band(spark):
    from millrace.llm.kneser_ney import keep_good, quality

    rng = random.Random(3)
    texts = [prose(rng, rng.randint(40, 200)) for _ in range(40)] + [" ".join(w + "".join(rng.sample("%$#&|*<>+=~", 4)) for w in prose(rng, 80).upper().split()), "too short", None, "", "same five words again here " * 30]
    df = make(spark, texts)
    got = {r.doc_id: r for r in quality(df).collect()}
    kept = {i for i in range(40) if got[i].kept}
    assert len(got) == len(texts) and len(kept) >= 38 and not any(got[i].kept for i in range(40, 45))
    assert not got[40].base_failed and got[44].base_failed
    assert {r.doc_id for r in keep_good(df).collect()} == kept
    assert quality(make(spark, [])).count() == 0
    # rows without ids are judged like others, and other columns may have any name
    none = df.withColumn("doc_id", F.lit(None).cast("long")).withColumn("text_key", F.lit(1)).withColumn("x", F.lit("k"))
    out = keep_good(none.unionByName(none.limit(1)))
    assert out.columns == none.columns and out.count() == len(kept) + (0 in kept)


# toxicity


def test_toxicity_on_held_out_rows_and_misspellings(spark):
    from millrace.llm.toxicity import score, train

    rng = random.Random(4)
    texts, labels = [], []
    for i in range(400):
        w = prose(rng, 30).split()
        bad = i % 4 == 0
        if bad:
            w[rng.randrange(30)] = w[rng.randrange(30)] = rng.choice(["horrible", "disgusting"])
        texts.append(" ".join(w))
        labels.append((i, 1, int(bad)))
    docs = make(spark, texts + [None, ""])
    got = {r.doc_id: r for r in score(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    held = [i for i in range(400) if got[i].held_out]
    assert 60 < len(held) < 140 and sum(got[i].predicted == (i % 4 == 0) for i in held) / len(held) > 0.9
    assert 0 <= got[400].score <= 1 and got[400].score == got[401].score
    margin, _ = train([t.encode() for t in texts], [x[2] for x in labels])
    from millrace.llm.toxicity import features

    assert margin[features([b"disgustting"])[0]].mean() > margin[features([b"threonan"])[0]].mean()
    assert score(make(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_rare_words_and_their_misspellings_have_vectors():
    from millrace.llm.toxicity import bags, train

    rng = random.Random(6)
    texts, labels = [], []
    for i in range(1000):
        w = prose(rng, 40).split()
        bad = i % 8 == 0
        if bad:
            # one word is in 5 rows of 1,000, the others share the rest
            w[rng.randrange(40)] = "wretchkopf" if i % 200 == 0 else rng.choice(["horrible", "disgusting", "stupid"])
        texts.append(" ".join(w).encode())
        labels.append(int(bad))
    assert sum(b"wretchkopf" in t for t in texts) == 5
    margin, bias = train(texts, labels)

    def scores(probes):
        return [1 / (1 + math.exp(-bias - float(margin[b] @ w))) for b, w in bags(probes)]

    clean = [prose(rng, 12) for _ in range(200)]
    plain = scores([t.encode() for t in clean])
    for word in ("wretchkopf", "wretchkopff", "wretchk0pf", "disgustting"):
        marked = scores([f"{t} {word}".encode() for t in clean])
        assert sum(m >= 0.3 for m in marked) > 0.9 * len(marked), word
    assert sum(x >= 0.3 for x in plain) < 0.05 * len(plain)


def brute_margin(token, margin):
    from millrace.llm import toxicity as tx

    word = token.decode().lower().strip(tx._EDGE)
    if not word:
        return 0.0, 0
    found = [zlib.crc32(word.encode()) % tx.BUCKETS]
    s = f"<{word}>"
    for n in tx.SIZES:
        for i in range(len(s) - n + 1 if len(s) > n else 0):
            h = n
            for c in s[i : i + n]:
                h = (h ^ ord(c)) * 0x9E3779B97F4A7C15 % 2**64
                h ^= h >> 29
            found.append(h % tx.BUCKETS)
    return sum(float(margin[f]) for f in found), len(found)


def test_scores_match_brute_force_and_rows_may_repeat(spark):
    from millrace.llm import toxicity as tx

    rng = random.Random(10)
    texts = [prose(rng, 12) + (" you stupid idiot" if i % 3 == 0 else "") for i in range(60)] + [None, "", "!!! --", "É ñandú (Straße) a", "idiot " * 5000]
    df = make(spark, texts)
    labels = [(i, 1, int(i % 3 == 0)) for i in range(60)] + [(0, 1, 0), (None, 1, 1)]
    odd = df.unionByName(df.limit(2)).unionByName(df.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long"))).withColumn("score", F.lit("k"))
    got = tx.score(odd, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(texts) + 3
    learnt = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2]
    margin, bias = tx.train([texts[i].encode() for i in learnt], [int(i % 3 == 0) for i in learnt])
    for r in got:
        text = texts[3 if r.doc_id is None else r.doc_id]
        parts = [brute_margin(t, margin) for t in (text or "").encode().split()]
        z = bias + sum(p[0] for p in parts) / max(1, sum(p[1] for p in parts))
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-6) and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


# WARC


def test_warc_round_trip(spark):
    from millrace.llm.warc import read_records, round_trip, write_archives

    big = "<p>é" + "x" * 200
    rows = [(1, "http://a/ b", "tiny"), (2, "http://a", "tiny"), (5, "u", big), (3, None, big), (9, "u", big), (4, "u", None), (7, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in round_trip(spark, pages).collect()}
    for i, _, h in rows:
        data = (h or "").encode()
        again = data == big.encode() and i != 3
        assert got[i] == (len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", 3 if again else None)
    index = write_archives(pages)
    some = {int(r.page_id): bytes(r.block).decode() for r in read_records(index.where("page_id in (3, 4)")).collect()}
    assert some == {3: big, 4: ""}
    assert round_trip(spark, pages.limit(0)).count() == 0


# sentence spans


def test_later_spans_go(spark):
    from millrace.llm.sentence_spans import drop_repeated_spans, span_report

    shared = "This is the first shared sentence. Here comes another one of them! And a third to make the run whole. And a fourth."
    texts = [f"Intro of zero. {shared} Own end.", f"Other start.\n{shared}\nOther end.", shared.upper(), "Alone here.", None, ""]
    df = make(spark, texts)
    kept = {r.doc_id: r.text for r in drop_repeated_spans(df).collect()}
    assert kept[0] == texts[0] and kept[1] == "Other start.\n\nOther end." and kept[2] == "" and kept[3] == texts[3] and kept[4] is None
    got = {r.doc_id: r.n_removed for r in span_report(df).collect()}
    assert got == {0: 0, 1: 4, 2: 4, 3: 0, 4: 0, 5: 0}
    assert span_report(make(spark, [])).count() == 0


def brute_spans(texts, span=3, enough=30, at_least=10):
    """Numbers of removed sentences, from every run of every start, first occurrence by document and place."""
    from millrace.llm.sentence_spans import sentences

    said = [[x.lower().split() for x in sentences((t or "").encode()) if x.strip()] for t in texts]
    first, gone = {}, [set() for _ in texts]
    runs = []
    for d, ss in enumerate(said):
        total = sum(map(len, ss))
        for k in range(len(ss)):
            ends = [e for e in range(k + 1, len(ss) + 1) if e - k >= span and sum(map(len, ss[k:e])) >= at_least][:1]
            ends += [e for e in range(k + 1, len(ss) + 1) if sum(map(len, ss[k:e])) >= enough][:1]
            if k == 0 and not [e for e in ends if e >= span] and total >= at_least:
                ends.append(len(ss))
            runs += [(tuple(w for s in ss[k:e] for w in s), (d, k), e) for e in set(ends)]
    for key, place, _ in runs:
        first[key] = min(first.get(key, place), place)
    for key, (d, k), e in runs:
        if first[key] != (d, k):
            gone[d] |= set(range(k, e))
    return {d: (len(ss), len(g)) for d, (ss, g) in enumerate(zip(said, gone))}


def test_spans_match_brute_force(spark):
    from millrace.llm.sentence_spans import span_report

    rng = random.Random(13)
    pool = [" ".join(rng.choice("abcdefghij") + str(k) for _ in range(rng.choice([1, 2, 4, 9, 18, 35]))) + rng.choice([".", "!", "?!"]) for k in range(25)]
    texts = [rng.choice([" ", "\n"]).join(pool[(s + j) % 25] for j in range(rng.randint(1, 8))) for s in (rng.randrange(25) for _ in range(60))]
    texts += [None, "", "one two three.", pool[5] * 2, "WORD!! " * 30, "word!!\n" * 30, "a b c d e f g h i j k l", "A b c d e f g  h i j k l"]
    got = {r.doc_id: (r.n_sentences, r.n_removed) for r in span_report(make(spark, texts)).collect()}
    assert got == brute_spans(texts)


def test_spans_with_null_ids_repeated_rows_and_clashing_columns(spark):
    from millrace.llm.sentence_spans import drop_repeated_spans

    text = "One sentence of this text. Another sentence of it! And here is the third of them."
    df = spark.createDataFrame([(None, text, 1), (4, text, 2), (4, text, 3), (4, "An own text that no other row holds at all, not even in part.", 4)], "doc_id long, text string, rid long")
    kept = {r.rid: r.text.strip() for r in drop_repeated_spans(df).collect()}
    assert kept == {1: text, 2: "", 3: "", 4: "An own text that no other row holds at all, not even in part."}


# mixing


def test_quotas_and_flow():
    from millrace.llm.mixing import quotas, route

    q = quotas({"a": 100, "b": 100, None: 100})
    assert q["a"] == 200 and q["b"] + q[None] == pytest.approx(250) and q["b"] == pytest.approx(2 * q[None])
    given = route({("a",): 50, ("a", "b"): 100, ("b",): 10}, {"a": 120, "b": 90})
    assert sum(given.values()) == 210 and all(given[p] <= 2 * c for p, c in {("a",): 50, ("a", "b"): 100, ("b",): 10}.items())
    assert given[("a", "b")] >= 100  # nothing is repeated before all is used once


def test_mix_meets_targets(spark):
    from millrace.llm.mixing import mix

    rng = random.Random(5)
    texts = [" ".join(["w"] * rng.randint(0, 60)) for _ in range(300)] + [None]
    df = make(spark, texts, source=lambda i: None if i % 5 == 0 else f"s{i % 4}")
    rows = mix(df).collect()
    assert len(rows) == 301 and all(0 <= r.taken <= 2 * r["size"] for r in rows)
    by = defaultdict(lambda: [0, 0.0])
    for r in rows:
        by[r.source_size][0] += r.taken
        by[r.source_size][1] = r.target
    assert all(abs(t - want) <= 60 for t, want in by.values())
    assert sorted(map(tuple, mix(df.repartition(7)).collect())) == sorted(map(tuple, rows))
    assert mix(make(spark, [])).count() == 0
    over = df.withColumn("source", F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("x"))).otherwise(F.array(F.lit("x"), F.lit("y"))))
    assert mix(over).count() == 301


# decontamination


def brute_contamination(texts, items, n=10):
    import re

    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = defaultdict(set)
    for i, t in items:
        w = cut(t)
        for k in range(max(1, len(w) - n + 1) if w else 0):
            windows[tuple(w[k : k + n])].add(str(i))
    sizes = {len(w) for w in windows}
    out = {}
    for d, t in enumerate(texts):
        w, hit, own = cut(t), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if found := windows.get(tuple(w[k : k + size])):
                    hit |= set(range(k, k + size))
                    own |= found
        out[d] = (len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit))
    return out


def test_contamination_matches_brute_force(spark):
    from millrace.llm.decontaminate import contamination, drop_contaminated, matches  # noqa: F401

    rng = random.Random(6)
    items = [(i, prose(rng, rng.choice([3, 9, 10, 11, 25]))) for i in range(12)] + [(50, None), (51, "..."), (52, "the"), (53, "Straße ÉTÉ")]
    texts = [prose(rng, 50) for _ in range(20)]
    texts += [f"{prose(rng, 5)}, {items[k][1].upper()}! {prose(rng, 4)}" for k in range(12)] + ["THE end", "Straße ÉTÉ", "straße été", None, "", " ".join(x[1] for x in items[:12]) * 3]
    df, bench = make(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in contamination(df, bench).collect()}
    want = brute_contamination(texts, items)
    assert got == want
    assert {r.doc_id for r in drop_contaminated(df, bench).collect()} == {k for k, v in want.items() if not v[4]}
    assert contamination(df, bench.limit(0)).where("contaminated").count() == 0 and contamination(df.limit(0), bench).count() == 0


def test_proximity(spark):
    from millrace.llm.decontaminate import contamination

    bench = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    df = make(spark, ["x alpha beta so gamma delta y", "alpha q q q q beta gamma delta", "alpha beta gamma delta"])
    assert [r.contaminated for r in contamination(df, bench, slop=1).orderBy("doc_id").collect()] == [True, False, True]


# pipeline


def test_pipeline_stages_act_and_keep_columns(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(7)
    texts = [prose(rng, 80) for _ in range(30)]
    bench = prose(rng, 12)
    texts += [texts[0], texts[1] + " th", f"{texts[2]} {bench} {texts[3]}", "short", None]
    make(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        docs = docs.persist()
        kept.append({r.doc_id for r in docs.collect()})
    assert kept[0] == set(range(33)) and kept[1] == kept[0]
    assert 30 not in kept[2] and 0 in kept[2] and 32 in kept[2] and kept[3] == kept[2] - {32}
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.collect()} == kept[3]
