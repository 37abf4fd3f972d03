"""Text: tokens, keywords, tf-idf, sentiment, language, topics."""

from __future__ import annotations

import heapq
import math
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.registry import operator
from millrace.scratch import settle

WORDS = r"[\p{L}\p{N}_]+"


@operator(columns=("textColumn",))
def tokenize(df: DataFrame, textColumn: str, mode: str = "word", ngramSize: int = 2, lowercase: bool = True, outputColumn: str = "tokens") -> DataFrame:
    """Arrays of words, sentences, or n-grams of words."""
    text = F.lower(textColumn) if lowercase else F.col(textColumn)
    if mode == "sentence":
        return df.withColumn(outputColumn, F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != ""))
    words = F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))
    if mode == "word":
        return df.withColumn(outputColumn, words)
    grams = F.transform(F.sequence(F.lit(1), F.size("__w") - ngramSize + 1), lambda i: F.array_join(F.slice("__w", i, ngramSize), " "))
    out = df.withColumn("__w", words).withColumn(outputColumn, F.when(F.size("__w") >= ngramSize, grams).when(F.col("__w").isNotNull(), F.array().cast("array<string>")))
    return out.drop("__w")


# Frequent function words by language, for stop lists and for telling languages apart.
STOP_WORDS = {
    "en": "a about after all also an and any are as at be because been but by can could did do does for from had has have he her him his how i if in into is it its just like me more my no not now of on one only or other our out over said she so some such than that the their them then there these they this those to too up very was we were what when which who will with would you your",
    "de": "aber als am an auch auf aus bei bin bis da dann das dass dem den der des die doch du durch ein eine einem einen einer es für hat ich ihr im in ist ja kann mit nach nicht noch nun nur oder schon sich sie sind so über um und uns von vor war was wenn wie wir wird zu zum zur",
    "fr": "à au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur lui ma mais me mes mon ne nos notre nous on ou où par pas plus pour qu que qui sa se ses son sur ta te tes toi ton tu un une vos votre vous",
    "es": "a al como con de del el ella en entre era es esta este ha hay la las le lo los más me mi muy no nos o para pero por porque que qué se ser si sin sobre son su sus también te tiene todo un una uno y ya yo",
}


def _tokens(df: DataFrame, text: str, key: str) -> DataFrame:
    return df.select(F.col(key).alias("k"), F.posexplode(F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))).alias("pos", "w"))


#: Up to this many keys that several rows share are broadcast.
MOST_SHARED = 100_000


def _phrases(text: str, language: str) -> Column:
    """The runs of words between stop words and punctuation, one a line, words a blank apart; empty without any."""
    marked = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]+", ".")
    words = F.regexp_extract_all(marked, F.lit(WORDS + r"|\."), F.lit(0))
    cut = F.transform(words, lambda w: F.when(w.isin(*STOP_WORDS[language].split(), "."), F.lit("\n")).otherwise(w))
    runs = F.transform(F.split(F.array_join(cut, " "), "\n"), lambda p: F.trim(p))
    return F.array_join(F.filter(runs, lambda p: p != ""), "\n")


def _best_phrases(text: bytes, top: int) -> list[tuple[float, bytes]]:
    """(score, phrase) of the best phrases of one text, from its phrases by line."""
    seen = {p: (n, p.split(b" ")) for p, n in Counter(text.split(b"\n")).items()}
    degree, often = Counter(), Counter()
    for n, words in seen.values():
        for w in words:
            degree[w] += n * len(words)
            often[w] += n
    value = {w: d / often[w] for w, d in degree.items()}
    scored = ((math.fsum(map(value.__getitem__, words)), p) for p, (_, words) in seen.items())
    return heapq.nsmallest(top, scored, key=lambda x: (-round(x[0], 12), x[1]))


def _rake(rows: DataFrame, topK: int) -> DataFrame:
    """(k, keyword, score, rank) of rows (k, s) with phrases by line.

    A row whose key is its own is scored where it is read, so that only keys are shuffled; the phrases of keys that several
    rows share are counted over all of them. Scores that differ by rounding only are equal.
    """
    # texts without a phrase are left out last: a condition on s here would have it made twice
    shared = settle(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("k").alias("shared")), "rake-shared-keys")
    kind = rows.schema["k"].dataType.simpleString()

    def best(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [(i, p.decode(), score, r) for i, s in enumerate(part.column(1).to_pylist()) if s for r, (score, p) in enumerate(_best_phrases(s, topK), 1)]
                i, keyword, score, rank = zip(*found, strict=True) if found else ((),) * 4
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(i, pa.int64())), pa.array(keyword, pa.string()), pa.array(score, pa.float64()), pa.array(rank, pa.int32())], ["k", "keyword", "score", "rank"])

    local = lambda own: own.select("k", F.col("s").cast("binary")).mapInArrow(best, f"k {kind}, keyword string, score double, rank int")
    n = shared.count()
    if not n:
        return local(rows)
    keys = F.broadcast(shared) if n <= MOST_SHARED else shared
    same = F.col("k").eqNullSafe(F.col("shared"))
    counted = rows.join(keys, same, "left_semi").select("k", F.explode(F.split("s", "\n")).alias("keyword")).where("keyword <> ''").groupBy("k", "keyword").agg(F.count(F.lit(1)).alias("n"))
    counted = settle(counted, "rake-phrases")
    words = counted.select("k", "keyword", "n", F.split("keyword", " ").alias("ws")).select("k", "keyword", "n", F.size("ws").alias("size"), F.explode("ws").alias("w"))
    scores = words.groupBy(F.col("k").alias("__k"), F.col("w").alias("__w")).agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("s"))
    scored = words.join(scores, F.col("k").eqNullSafe(F.col("__k")) & (F.col("w") == F.col("__w"))).groupBy("k", "keyword").agg(F.sum("s").alias("score"))
    rank = F.row_number().over(Window.partitionBy("k").orderBy(F.desc(F.round("score", 12)), "keyword"))
    return local(rows.join(keys, same, "left_anti")).unionByName(scored.withColumn("rank", rank).where(F.col("rank") <= topK))


@operator(columns=("textColumn", "key"))
def keyword_rake_yake(df: DataFrame, textColumn: str, key: str, algorithm: str = "rake", topK: int = 5, language: str = "en") -> DataFrame:
    """(key, keyword, score, rank). rake: phrases between stop words, scored by degree over frequency of their words (higher is better); yake: words by first place, length and frequency (lower is better)."""
    if algorithm != "yake":
        return _rake(df.select(F.col(key).alias("k"), _phrases(textColumn, language).alias("s")), topK).withColumnRenamed("k", key)
    stop = F.array(*(F.lit(w) for w in STOP_WORDS[language].split()))
    rows = _tokens(df, textColumn, key).where(~F.array_contains(stop, F.col("w")) & (F.length("w") > 2)).groupBy("k", "w").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n"))
    rows = rows.select("k", F.col("w").alias("keyword"), (F.log1p(F.col("first") + 1) / (F.col("n") * F.sqrt(F.length("w")))).alias("score"))
    best = [F.asc("score"), F.asc("keyword")]
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy(*best))).where(F.col("rank") <= topK)
    return ranked.withColumnRenamed("k", key)


@operator(columns=("textColumn", "key"))
def tfidf(df: DataFrame, textColumn: str, key: str, topK: int = 5, maxFeatures: int = 1000, language: str = "en") -> DataFrame:
    """(key, term, tfidf, rank): smooth idf, vectors of length 1, over the maxFeatures most frequent terms that are not stop words."""
    stop = F.array(*(F.lit(w) for w in STOP_WORDS[language].split()))
    rows = _tokens(df, textColumn, key).where((F.length("w") > 1) & ~F.array_contains(stop, F.col("w"))).groupBy("k", "w").agg(F.count(F.lit(1)).alias("tf"))
    vocabulary = rows.groupBy("w").agg(F.sum("tf").alias("n"), F.count(F.lit(1)).alias("d")).orderBy(F.desc("n"), "w").limit(maxFeatures)
    docs = df.agg(F.count(F.lit(1)).alias("docs"))
    idf = vocabulary.crossJoin(F.broadcast(docs)).select("w", (F.ln((1 + F.col("docs")) / (1 + F.col("d"))) + 1).alias("idf"))
    v = rows.join(F.broadcast(idf), "w").withColumn("x", F.col("tf") * F.col("idf"))
    v = v.withColumn("tfidf", F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("k"))))
    ranked = v.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy(F.desc(F.round("tfidf", 12)), "w"))).where(F.col("rank") <= topK)
    return ranked.select(F.col("k").alias(key), F.col("w").alias("term"), "tfidf", "rank")


@operator(ports=("df", "lexicon"))
def sentiment_lexicon(df: DataFrame, lexicon: DataFrame, textColumn: str, key: str) -> DataFrame:
    """(key, compound, pos, neg, neu) from lexicon(word, valence); a word right after a negation counts -0.74 of its valence."""
    toks = _tokens(df, textColumn, key)
    before = F.lag("w").over(Window.partitionBy("k").orderBy("pos"))
    toks = toks.withColumn("negated", F.coalesce(before.isin("not", "no", "never", "without", "nor", "cannot"), F.lit(False)))
    v = F.coalesce(F.when(F.col("negated"), -0.74 * F.col("valence")).otherwise(F.col("valence")), F.lit(0.0))
    s = toks.join(lexicon.select(F.lower("word").alias("w"), F.col("valence").cast("double").alias("valence")).dropDuplicates(["w"]), "w", "left").withColumn("v", v)
    agg = s.groupBy("k").agg(F.sum("v").alias("sum"), F.sum(F.when(F.col("v") > 0, F.col("v") + 1).otherwise(0.0)).alias("p"), F.sum(F.when(F.col("v") < 0, F.col("v") - 1).otherwise(0.0)).alias("n"), F.count_if(F.col("v") == 0).alias("u"))
    total = F.col("p") - F.col("n") + F.col("u")
    return agg.select(F.col("k").alias(key), (F.col("sum") / F.sqrt(F.col("sum") * F.col("sum") + 15)).alias("compound"), (F.col("p") / total).alias("pos"), (-F.col("n") / total).alias("neg"), (F.col("u") / total).alias("neu"))


#: Grams of a language that its profile keeps, the commonest first: some 16 bytes each in every task.
MOST_GRAMS = 20_000
GRAM = 3


def _letters(text: str | Column) -> Column:
    """Lower-cased words of letters, one blank around each; NULL without any letter."""
    text = F.col(text) if isinstance(text, str) else text
    words = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "))
    return F.when(words != "", F.concat(F.lit(" "), words, F.lit(" ")))


def _gram_keys(text: str):
    """Code points of each three neighbouring characters, packed into 63 bits."""
    import numpy as np

    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    return points[:-2] << 42 | points[1:-1] << 21 | points[2:]


@operator(columns=("textColumn", "langColumn"))
def language_profile(df: DataFrame, textColumn: str, langColumn: str, mostGrams: int = MOST_GRAMS) -> DataFrame:
    """(lang, gram, n): how often each language's texts hold each three characters (letters and word edges), for language_detect.

    Tasks count their batches, so that distinct grams are shuffled, not texts. The mostGrams commonest of each language are
    kept, ties by the grams' code points. Rows without a language or a letter are left out.
    """
    kind = dict(df.dtypes)[langColumn]
    rows = df.where(F.col(langColumn).isNotNull()).select(F.col(langColumn).alias("lang"), _letters(textColumn).alias("t")).where("t is not null")

    def count(frames):
        import numpy as np

        for pdf in frames:
            for lang, texts in pdf.groupby("lang")["t"]:
                # a piece of texts at a time, each text's grams apart from the next one's
                for at in range(0, len(texts), 256):
                    keys, n = np.unique(np.concatenate([_gram_keys(x) for x in texts.iloc[at : at + 256]]), return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": keys, "n": n})

    counted = rows.mapInPandas(count, f"lang {kind}, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= mostGrams).drop("rank")


def _by_function_words(df: DataFrame, textColumn: str, outputColumn: str) -> DataFrame:
    """The language whose function words are most frequent, and its share of all such words; NULL for texts without any."""
    own = "__millrace_language"
    out = df.withColumn(own, F.regexp_extract_all(F.lower(textColumn), F.lit(WORDS), F.lit(0)))

    def among(listed: str):
        return lambda w: w.isin(listed.split())

    hits = F.array(*(F.struct(F.size(F.filter(own, among(v))).alias("n"), F.lit(k).alias("lang")) for k, v in STOP_WORDS.items()))
    out = out.withColumn(own, hits)
    total = F.aggregate(own, F.lit(0), lambda a, x: a + x["n"])
    best = F.array_max(own)
    return out.withColumns({outputColumn: F.when(total > 0, best["lang"]), f"{outputColumn}_probability": F.when(total > 0, best["n"] / total)}).drop(own)


@operator(columns=("textColumn",))
def language_detect(df: DataFrame, textColumn: str, outputColumn: str = "language", profile: DataFrame | None = None, smoothing: float = 0.5) -> DataFrame:
    """The likeliest language of each text and its probability, by naive Bayes over three-character grams with equal priors.

    profile is a table of language_profile, from texts whose language is known (written and read back, if wanted); without
    one, the shares of built-in function words tell en, de, fr and es apart, and less surely. Texts without any letter, or without any
    gram of the profile, are NULL; ties go to the first language by name. Whole texts are read, at no cost but
    their length: grams are looked up in sorted arrays that each task holds (languages times MOST_GRAMS entries).
    """
    import numpy as np

    if profile is None:
        return _by_function_words(df, textColumn, outputColumn)
    found = profile.select(F.col("lang").cast("string"), "gram", "n").orderBy("lang", "gram").toPandas()
    langs = sorted(found["lang"].unique(), key=lambda x: x.encode())
    grams = np.unique(found["gram"].to_numpy(np.int64))
    counts = np.zeros((len(grams), len(langs)))
    counts[np.searchsorted(grams, found["gram"]), [langs.index(x) for x in found["lang"]]] = found["n"]
    logs = np.log((counts + smoothing) / (counts.sum(axis=0) + smoothing * max(1, len(grams))))

    @F.pandas_udf("lang string, p double")
    def best(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            score = np.zeros(len(langs))
            hits = 0
            for at in range(0, len(t or "") - 2 if len(grams) else 0, 1 << 20):
                keys = _gram_keys(t[at : at + (1 << 20) + 2])
                place = np.minimum(np.searchsorted(grams, keys), len(grams) - 1)
                place = place[grams[place] == keys]
                hits += len(place)
                score += logs[place].sum(axis=0)
            if hits:
                top = int(np.argmax(score))
                out.append((langs[top], float(1 / np.exp(score - score[top]).sum())))
            else:
                out.append((None, None))
        return pd.DataFrame(out, columns=["lang", "p"])

    own = "__millrace_language"
    return df.withColumn(own, best(_letters(textColumn))).withColumns({outputColumn: F.col(f"{own}.lang"), f"{outputColumn}_probability": F.col(f"{own}.p")}).drop(own)


@operator(columns=("textColumn",))
def lda_topics(df: DataFrame, textColumn: str, nTopics: int = 5, seed: int = 42, vocabulary: int = 2_000, topTerms: int = 8) -> DataFrame:
    """The dominant topic of each row and that topic's top terms."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer, StopWordsRemover
    from pyspark.ml.functions import vector_to_array

    words = tokenize(df.withColumn("__t", F.coalesce(textColumn, F.lit(""))), "__t", outputColumn="__w")
    clean = StopWordsRemover(inputCol="__w", outputCol="__c").transform(words)
    counter = CountVectorizer(inputCol="__c", outputCol="features", vocabSize=vocabulary).fit(clean)
    vectors = counter.transform(clean).persist()
    model = LDA(k=nTopics, seed=seed, maxIter=15, optimizer="online").fit(vectors)
    topics = [(r.topic, [counter.vocabulary[i] for i in r.termIndices]) for r in model.describeTopics(topTerms).collect()]
    names = F.broadcast(df.sparkSession.createDataFrame(topics, "topic int, top_terms array<string>"))
    share = vector_to_array("topicDistribution")
    out = model.transform(vectors).withColumn("topic", (F.array_position(share, F.array_max(share)) - 1).cast("int"))
    return out.join(names, "topic", "left").select(*df.columns, "topic", "top_terms")
