"""Language detection against brute force and held-out labels; every pattern of personal data."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.operators import scalars, text

DOCS = "/root/testdata/sf0.01/documents.parquet"


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("a 555 123 4567 b", "a # b"),
        ("(555) 123-4567", "#"),
        ("x(555)123.4567y", "x(555)123.4567y"),
        ("+15551234567, 15551234567, 1-555-123-4567", "#, #, #"),
        ("+49 555 123 4567", "#"),
        ("4111111111111111", "#"),
        ("4111 1111 1111 1111 end", "# end"),
        ("3782-822463-10005", "#"),
        ("123456789012 12345678901234567", "123456789012 12345678901234567"),
        ("123-45-6789 1234-45-6789", "# 1234-45-6789"),
        ("To: Jo.Doe+x@mail.example.co.uk.", "To: #."),
        ("a" * 300_000 + "@", "a" * 300_000 + "@"),
        ("", ""),
        (None, None),
    ],
)
def test_personal_data(spark, given, want):
    df = spark.createDataFrame([(given,)], "s string")
    assert scalars.pii_redact(df, ["s"], replacement="#").first().s == want


def test_only_the_patterns_asked_for_and_literal_replacements(spark):
    df = spark.createDataFrame([("a@b.org 555-123-4567",)], "s string")
    assert scalars.pii_redact(df, ["s"], "phone", r"$1\x").first().s == r"a@b.org $1\x"
    with pytest.raises(ValueError):
        scalars.pii_redact(df, ["s"], "phones")


def _grams(t: str | None) -> list[str]:
    t = " ".join(re.findall(r"[^\W\d_]+", (t or "").lower()))
    t = f" {t} "
    return [t[i : i + 3] for i in range(len(t) - 2)] if t.strip() else []


def test_language_scores_by_brute_force(spark):
    train = [("en", "the cat and the hat"), ("de", "die Katze und der Hut, über"), ("fr", "le chat et l'été"), (None, "x y z"), ("en", None), ("de", "")]
    asked = ["the hut", "über die", "l'été", "zzz qqq", "", None, "12 !!", "le " * 50_000]
    profile = text.language_profile(spark.createDataFrame(train, "lang string, t string"), "t", "lang")
    df = spark.createDataFrame(list(enumerate(asked)), "id long, t string")
    got = {r.id: r for r in text.language_detect(df, "t", profile=profile).collect()}
    counts: dict[str, Counter] = defaultdict(Counter)
    for lang, t in train:
        if lang and _grams(t):
            counts[lang].update(_grams(t))
    vocabulary = set().union(*counts.values())
    for i, t in enumerate(asked):
        known = [g for g in _grams(t) if g in vocabulary]
        if not known:
            assert got[i].language is None and got[i].language_probability is None
            continue
        score = {x: sum(math.log((c[g] + 0.5) / (sum(c.values()) + 0.5 * len(vocabulary))) for g in known) for x, c in counts.items()}
        top = max(sorted(score), key=score.get)
        assert got[i].language == top
        assert got[i].language_probability == pytest.approx(1 / sum(math.exp(s - score[top]) for s in score.values()), rel=1e-6)


def test_languages_of_held_out_documents_and_short_texts(spark):
    docs = spark.read.parquet(DOCS).select("doc_id", "text", "lang", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).alias("held"))
    profile = text.language_profile(docs.where("not held"), "text", "lang")
    held = docs.where("held and text rlike '[a-zA-Z]'")
    short = held.where("lang is not null").withColumn("text", F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)), 1, 5), " "))
    for rows, least in ((held, 0.95), (short, 0.95)):
        share = text.language_detect(rows, "text", profile=profile).groupBy("lang").agg(F.avg(F.coalesce(F.col("language") == F.col("lang"), F.lit(False)).cast("double")).alias("s")).collect()
        print({r.lang: r.s for r in share})
        assert min(r.s for r in share) >= least


def test_without_a_profile_and_with_an_empty_one(spark):
    df = spark.createDataFrame([(1, "the cat and the dog"), (2, "der Hund und die Katze")], "id long, t string")
    assert [r.language for r in text.language_detect(df, "t").orderBy("id").collect()] == ["en", "de"]
    empty = text.language_profile(spark.createDataFrame([], "lang string, t string"), "t", "lang")
    assert [r.language for r in text.language_detect(df, "t", profile=empty).collect()] == [None, None]
    assert text.language_detect(df.limit(0), "t").count() == 0
