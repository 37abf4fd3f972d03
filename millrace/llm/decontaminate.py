"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations only.

Texts are cut into words once. The index holds the postings (term, row, position) of every benchmark term in every document
and is written. A benchmark window is found by intersecting its terms' lists, shifted by the terms' places: first the
list of the window's rarest term, then that of the next rarest, and what is left of them with all the other lists. Lists are
intersected by joins on (row, position, term); no document is read again. Exact phrases are windows for which every place is
held; proximity matches are read off the postings near the rarest term.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import extras_apart
from millrace.scratch import settle

WINDOW = 10
#: Benchmark terms and windows are broadcast up to this many rows; beyond, they are joined by shuffles, terms in SALT parts each.
MOST_BROADCAST, SALT = 1_000_000, 32
#: ASCII characters that no word holds.
_BETWEEN = "".join(chr(c) for c in range(128) if chr(c) not in string.ascii_letters + string.digits)


def terms(text: Column) -> Column:
    """Runs of anything but ASCII characters other than letters and digits, A-Z lower-cased; no words for null."""
    plain = F.translate(text, string.ascii_uppercase + _BETWEEN, string.ascii_lowercase + " " * len(_BETWEEN))
    return F.coalesce(F.array_remove(F.split(plain, " "), ""), F.array().cast("array<string>"))


def _few(side: DataFrame) -> bool:
    return side.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST


def _send(side: DataFrame) -> DataFrame:
    return F.broadcast(side) if _few(side) else side


def cut_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, text_md5, words) of every row, written; row is a number of its own that stays, as the table is written."""
    text = F.col(text_col)
    return settle(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.md5(text.cast("binary")).alias("text_md5"), terms(text).alias("words")), "decontamination-words")


def build_postings(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(tid, row, pos) for the terms of ``vocabulary`` (tid, term), written: the positional index over whole texts."""
    said = tokens.select("row", F.posexplode("words").alias("pos", "term"))
    if _few(vocabulary):
        found = said.join(F.broadcast(vocabulary), "term")
    else:  # a frequent term is dealt to SALT tasks
        parts = vocabulary.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
        found = said.withColumn("salt", F.pmod("pos", F.lit(SALT))).join(parts, ["term", "salt"])
    return settle(found.select("tid", "row", "pos"), "decontamination-postings")


def benchmark_items(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Items (seq, words, ids) by distinct words, and the vocabulary (tid, term). Items without words have no part in either."""
    items = benchmark.select(F.col(item_col).cast("string").alias("id"), terms(F.col(text_col)).alias("words")).where("size(words) > 0")
    items = items.groupBy("words").agg(F.collect_set(F.struct("id")).alias("ids"))
    items = settle(items.select(F.monotonically_increasing_id().alias("seq"), "words", F.col("ids.id").alias("ids")), "benchmark-items")
    vocabulary = items.select(F.explode("words").alias("term")).distinct()
    return items, settle(vocabulary.select(F.monotonically_increasing_id().alias("tid"), "term"), "benchmark-terms")


def item_windows(items: DataFrame, vocabulary: DataFrame, postings: DataFrame, window: int = WINDOW) -> DataFrame:
    """(seq, w, tids, one, two): the windows that may occur, the term of each place, and (n, place, tid) of the rarest and the next rarest term.

    Rarity is the number of postings. Windows with a term that no document has are left out; ``two`` is null for one-word windows.
    """
    counts = vocabulary.join(postings.groupBy("tid").agg(F.count(F.lit(1)).alias("n")), "tid", "left").select("tid", "term", F.coalesce("n", F.lit(0)).alias("n"))
    placed = items.select("seq", F.posexplode("words").alias("place", "term")).join(_send(counts), "term")
    rated = placed.groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("place", "n", "tid"))).alias("terms"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("terms") - window, F.lit(0)))
    cut = rated.select("seq", F.explode(starts).alias("w"), "terms").select("seq", "w", F.slice("terms", F.col("w") + 1, F.lit(window)).alias("terms"))
    cut = cut.select("seq", "w", F.col("terms.tid").alias("tids"), F.array_sort(F.transform("terms", lambda t: F.struct(t["n"].alias("n"), t["place"].alias("place"), t["tid"].alias("tid")))).alias("by"))
    return settle(cut.select("seq", "w", "tids", F.col("by")[0].alias("one"), F.get("by", F.lit(1)).alias("two")).where("one.n > 0"), "benchmark-windows")


def phrase_matches(postings: DataFrame, windows: DataFrame) -> DataFrame:
    """(row, seq, at, width): where windows occur word by word."""
    first = windows.select("seq", F.col("one.place").alias("p1"), F.col("one.tid").alias("tid")).distinct()
    second = windows.where("two is not null").select("seq", F.col("one.place").alias("p1"), F.col("two.place").alias("p2"), F.col("two.tid").alias("tid")).distinct()
    # shift: the position of the item's place 0, which may lie before the document
    held = postings.join(_send(first), "tid").select("row", "seq", "p1", (F.col("pos") - F.col("p1")).alias("shift"))
    held = settle(held, "decontamination-first")
    wanted = held.join(_send(second), ["seq", "p1"]).select("row", (F.col("shift") + F.col("p2")).alias("pos"), "tid", "seq", "p1", "p2", "shift")
    rare = postings.join(_send(second.select("tid").distinct()), "tid", "left_semi")
    both = settle(wanted.join(rare, ["row", "pos", "tid"]).select("row", "seq", "p1", "p2", "shift"), "decontamination-second")
    keys = windows.select("seq", "w", "tids", F.col("one.place").alias("p1"), F.col("two.place").alias("p2"))
    alone = held.join(_send(keys.where("p2 is null").select("seq", "p1", "w")), ["seq", "p1"]).select("row", "seq", (F.col("shift") + F.col("w")).alias("at"), F.lit(1).alias("width"))
    alive = both.join(_send(keys.where("p2 is not null")), ["seq", "p1", "p2"]).select("row", "seq", "w", (F.col("shift") + F.col("w")).alias("at"), "tids").where("at >= 0")
    needed = alive.select("row", "seq", "w", "at", F.size("tids").alias("width"), F.posexplode("tids").alias("k", "tid")).withColumn("pos", F.col("at") + F.col("k"))
    near = postings.join(_send(both.select("row").distinct()), "row", "left_semi")
    all_lists = needed.join(near, ["row", "pos", "tid"]).groupBy("row", "seq", "w", "at", "width").agg(F.count(F.lit(1)).alias("n")).where("n = width")
    return all_lists.select("row", "seq", "at", "width").unionByName(alone)


def near_matches(postings: DataFrame, windows: DataFrame, slop: int) -> DataFrame:
    """(row, seq, at, width): runs of words that hold a window's words in order, its first word in place, and at most ``slop`` others."""
    one = windows.select(F.col("one.tid").alias("tid"), (F.col("one.place") - F.col("w")).alias("place"), "seq", "w", "tids")
    held = postings.join(_send(one), "tid").where("pos >= place")
    starts = F.sequence(F.greatest(F.lit(0), F.col("pos") - F.col("place") - slop), F.when(F.col("place") == 0, F.col("pos")).otherwise(F.col("pos") - F.col("place")))
    tries = settle(held.select("row", "seq", "tids", F.explode(starts).alias("at")).distinct(), "decontamination-tries")
    spread = tries.select("row", "seq", "tids", "at", F.explode(F.sequence(F.col("at"), F.col("at") + F.size("tids") + slop - 1)).alias("pos"))
    run = spread.join(postings, ["row", "pos"]).groupBy("row", "seq", "tids", "at").agg(F.array_sort(F.collect_list(F.struct("pos", "tid"))).alias("run"))
    start = F.struct(F.lit(0).alias("i"), F.lit(-1).alias("last"))
    step = lambda a, x: F.when((a["i"] < F.size("tids")) & (x["tid"] == F.get("tids", a["i"])), F.struct((a["i"] + 1).alias("i"), x["pos"].alias("last"))).otherwise(a)
    width = F.aggregate("run", start, step, lambda a: F.when(a["i"] == F.size("tids"), a["last"] - F.col("at") + 1).otherwise(0))
    return run.where((F.col("run")[0]["pos"] == F.col("at")) & (F.col("run")[0]["tid"] == F.col("tids")[0])).select("row", "seq", "at", width.alias("width")).where("width > 0")


def matches(tokens: DataFrame, benchmark: DataFrame, item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, slop: int = 0) -> tuple[DataFrame, DataFrame]:
    """(row, seq, at, width) for all occurrences of benchmark windows in ``tokens`` of ``cut_words``, and the items (seq, words, ids).

    slop = 0 returns exact phrases; slop = k > 0 also runs of words in which the window's words appear in order with at
    most k other words among them (the first word in its place).
    """
    items, vocabulary = benchmark_items(benchmark, item_col, item_text)
    postings = build_postings(tokens, vocabulary)
    windows = item_windows(items, vocabulary, postings, window)
    return settle(near_matches(postings, windows, slop) if slop else phrase_matches(postings, windows), "decontamination-matches"), items


def _covered(found: Column) -> Column:
    """Number of word positions that the found windows cover."""
    spans = F.array_sort(F.transform(found, lambda c: F.struct(c["at"].alias("at"), (c["at"] + c["width"]).alias("end"))))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    step = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["at"], a["upto"]))).alias("n"), F.greatest(a["upto"], s["end"]).alias("upto"))
    return F.aggregate(spans, start, step, lambda a: a["n"]).cast("long")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, slop: int = 0) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, items_sha256, contaminated) for every row of ``docs``; other columns are not read.

    A window is ``window`` consecutive words of an item, or the whole item if it has fewer. Null and word-less texts have
    no hits, null and word-less items no windows; items that share an id are all looked for and count as one, and
    all items with a null id count as one that ``items_sha256`` leaves out; rows with a null id are looked at like any other; repeated
    rows are all returned, repeated items count once; empty tables on either side are fine; texts are read whole.
    """
    tokens = cut_words(docs, id_col, text_col)
    found, items = matches(tokens, benchmark, item_col, item_text, window, slop)
    hits = found.groupBy("row").agg(_covered(F.collect_set(F.struct("at", "width"))).alias("n_hit"))
    ids = found.select("row", "seq").distinct().join(_send(items.select("seq", "ids")), "seq").select("row", F.explode("ids").alias("id"))
    ids = ids.groupBy("row").agg(F.transform(F.array_sort(F.collect_set(F.struct("id"))), lambda x: x["id"]).alias("items"))
    out = tokens.select("row", "doc_id", F.size("words").cast("long").alias("n_words")).join(hits.join(ids, "row"), "row", "left")
    n_hit, listed = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), listed.alias("items"), F.sha2(F.array_join(listed, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


@extras_apart
def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, slop: int = 0) -> DataFrame:
    """``docs`` without the rows in whose text any benchmark window occurs, whatever their ids; columns and their order are kept.

    Rows are told by their text's MD5, as equal texts share their fate.
    """
    tokens = cut_words(docs, id_col, text_col)
    found, _ = matches(tokens, benchmark, item_col, item_text, window, slop)
    bad = tokens.select("row", "text_md5").join(found.select("row"), "row", "left_semi").select(F.col("text_md5").alias("__bad_md5")).distinct()
    return docs.join(bad, F.md5(F.col(text_col).cast("binary")) == F.col("__bad_md5"), "left_anti").select(*docs.columns)
