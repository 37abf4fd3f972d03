"""URL filter: host and path rules first, then logistic regression on hashed character n-grams of host and path.

Everything is DataFrame functions and the DataFrame-based MLlib; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import lower_ascii
from millrace.scratch import settle

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with its path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

#: Subjects of the labelled table, by hand.
BLOCKED = "adult porn xxx sex nude escort hentai webcam casino poker slots roulette bets betting gamble lottery jackpot pills viagra cialis steroids spam ads adserver banner popup track tracker malware phishing warez keygen torrent replica payday casinos pill".split()
ALLOWED = "news school library garden science weather museum recipe travel music history health sport books city university hospital market theatre farm river forest bridge harbour kitchen letters language teacher physics chemistry railway cycling painting poetry council parish gallery archive journal observatory orchard village nature window coffee bakery theory method report station other thought rather there nation mention other ration question".split()
#: (host, path) of the labelled table for a subject w; both labels have them alike, so what they share tells nothing.
SHAPES = [("{w}.example.org", "/en/{n}"), ("www.{w}-{v}.example.com", "/en/{n}.html"), ("{v}-{w}.example.net", "/de/{n}/"), ("blog.{w}{v}.example.com", "/fr/{n}.html"), ("m.{v}{w}.example.org", "/es/{n}"), ("pages.example.com", "/{w}/{n}.html"), ("www.example.org", "/{v}-{w}/{n}")]
#: Parts of made-up names, which are allowed: a name that tells nothing must not be blocked.
ONSETS, VOWELS, CODAS = "b c d f g h l m n p r s t v w th st sh ch tr br".split(), "aeiou", ["", "n", "r", "s", "st", "nd", "ng", "nt", "th", "tion", "ly", "re"]
MADE_UP = 250
FILLERS = ["best", "my", "free", "top", "web", "home", "daily", "online", "world"]

N_GRAMS, BUCKETS, THRESHOLD = (3, 4, 5), 1 << 18, 0.35
#: Up to this many hosts with rules (some 100 bytes each) are broadcast.
MOST_BROADCAST = 100_000


def host_path(url: str | Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``, ``#`` or the end. Both empty for null and without ``://``."""
    url = F.col(url) if isinstance(url, str) else url
    part = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return lower_ascii(part(1)), part(2)


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, label 1 for block): the small built-in table, each subject in each shape. Made-up names are ONSETS, VOWELS and CODAS taken in turn, at strides without a common period."""
    part = lambda i: ONSETS[i % len(ONSETS)] + VOWELS[i // 3 % len(VOWELS)] + CODAS[i // 7 % len(CODAS)]
    made_up = [part(i) + part(5 * i + 2) for i in range(MADE_UP)]
    rows = [(f"https://{h}{p}".format(w=w, v=FILLERS[(i + k) % len(FILLERS)], n=1000 + i), label) for label, subjects in ((1, BLOCKED), (0, ALLOWED + made_up)) for i, w in enumerate(subjects) for k, (h, p) in enumerate(SHAPES)]
    table = spark.range(1).select(F.explode(F.split(F.lit("\n".join(f"{y} {u}" for u, y in rows)), "\n")).alias("row"))
    return table.select(F.substring_index("row", " ", -1).alias("url"), F.substring("row", 1, 1).cast("int").alias("label"))


def _runs(chars: str, mark: str, n: int) -> Column:
    found = F.transform(F.sequence(F.lit(1), F.size(chars) - (n - 1)), lambda i: F.concat(F.lit(mark), *(F.element_at(chars, i + k) for k in range(n))))
    return F.when(F.size(chars) >= n, found).otherwise(F.array().cast("array<string>"))


def with_features(df: DataFrame, host: str = "host", path: str = "path", buckets: int = BUCKETS, sizes: tuple[int, ...] = N_GRAMS) -> DataFrame:
    """Adds __features: hashed character n-grams of both parts, marked by the part; the host's ends count as characters, every digit as 0.

    The characters are columns of their own, so that no n-gram searches the text from its start: linear in the length.
    """
    chars = lambda text: F.filter(F.split(F.translate(text, "123456789", "0" * 9), ""), lambda c: c != "")
    cut = df.withColumns({"__h": chars(F.concat(F.lit("<"), F.col(host), F.lit(">"))), "__p": chars(F.col(path))})
    listed = cut.withColumn("__grams", F.concat(*(_runs(c, mark, n) for c, mark in (("__h", "h"), ("__p", "p")) for n in sizes)))
    return HashingTF(numFeatures=buckets, binary=True, inputCol="__grams", outputCol="__features").transform(listed).drop("__h", "__p", "__grams")


def fit(labelled: DataFrame, url_col: str = "url", label_col: str = "label", buckets: int = BUCKETS, penalty: float = 1e-3) -> LogisticRegressionModel:
    """Ridge-penalised logistic regression. Rows without a label are left out; a null url has no n-grams and only moves the intercept."""
    host, path = host_path(url_col)
    rows = labelled.where(F.col(label_col).isNotNull()).select(host.alias("host"), path.alias("path"), F.col(label_col).cast("double").alias("label")).orderBy("host", "path", "label").coalesce(1)
    return LogisticRegression(featuresCol="__features", labelCol="label", regParam=penalty, standardization=False, maxIter=50, tol=1e-6).fit(with_features(rows, buckets=buckets))


def matched_rules(hosts: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, rules): for each distinct host with any rule, the rules of it and its parent domains, the longest (host and path together, then host) first."""
    spark = hosts.sparkSession
    if not rules:
        return hosts.select("host").limit(0).select("host", F.array().cast("array<struct<path:string,rule:string,verdict:string>>").alias("rules"))
    table = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("domain"), F.lit(p).alias("path")) for v, h, p in rules)))).withColumn("domain", lower_ascii(F.col("domain")))
    depth = max(h.count(".") + 1 for _, h, _ in rules)
    domains = F.array_distinct(F.array(*(F.substring_index("host", ".", -k) for k in range(1, depth + 1))))
    found = hosts.select("host").distinct().select("host", F.explode(domains).alias("domain")).join(F.broadcast(table) if len(rules) <= MOST_BROADCAST else table, "domain")
    ranked = F.struct((-F.length("domain") - F.length("path")).alias("by"), (-F.length("domain")).alias("then"), "path", F.concat("domain", "path").alias("rule"), "verdict")
    return found.groupBy("host").agg(F.array_sort(F.collect_list(ranked)).alias("r")).select("host", F.transform("r", lambda x: F.struct(x["path"].alias("path"), x["rule"].alias("rule"), x["verdict"].alias("verdict"))).alias("rules"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, labelled: DataFrame | None = None, model: LogisticRegressionModel | None = None, id_col: str = "page_id", url_col: str = "url", threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row.

    The longest rule that fits decides; without one, rows whose blocking probability (score) reaches the threshold are
    blocked. A null url and one without ``://`` have an empty host and path, no rule, and the model's verdict on no n-grams,
    which is allow. Repeated rows and null ids are rows like any other, an empty table gives no rows, other columns are not
    read. A hot host costs its rows only: rules are found once for each distinct host.
    """
    spark = pages.sparkSession
    host, path = host_path(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    found = settle(matched_rules(rows, rules), "url-rules")
    few = found.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    ruled = rows.join(F.broadcast(found) if few else found, "host", "left")
    fits = F.filter("rules", lambda x: F.startswith(F.col("path"), x["path"]))
    ruled = ruled.withColumn("__rule", F.when(F.size(fits) > 0, F.element_at(fits, 1)))
    model = model or fit(labelled if labelled is not None else labelled_urls(spark))
    scored = model.transform(with_features(ruled, buckets=model.numFeatures))
    score = vector_to_array("probability")[1]
    verdict = F.coalesce("__rule.verdict", F.when(score >= threshold, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", F.col("__rule.rule").alias("rule"), verdict.alias("verdict"), score.alias("score"))
