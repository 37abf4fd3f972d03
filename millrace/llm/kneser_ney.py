"""Quality rules: counts of words, symbols and repeats, and the perplexity of an n-gram model of each language.

The model is a modified Kneser-Ney model over the characters of a text, whose words stand one space apart: n-grams run across
words, so what follows what counts. Spark counts the n-grams of all documents that pass the base rules and derives
continuation counts, discounts, and interpolated probabilities order by order with joins. For scoring, n-grams become 64-bit hashes in
sorted arrays with their log probabilities; the arrays are broadcast while the model has at most ``max_broadcast`` n-grams,
and beyond that documents' n-grams are joined to the model tables instead, with the same sums. Documents outside their
language's band of perplexities are rejected.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import as_bytes, extras_apart, rows_of
from millrace.scratch import settle

ORDER, MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 5, 10, 20, 5
BAND, MAX_BROADCAST, MAX_LANGS = 3.0, 8_000_000, 10_000
#: Logarithms count in 1 / UNIT nats; UNKNOWN is that of a symbol the model never met, NONE stands for no value.
UNIT, UNKNOWN, NONE = 1 << 16, round(math.log(1e-6) * (1 << 16)), -(1 << 31)
#: Symbols that are counted or scored at once, and n-grams that a task holds before it sends them.
PIECE, HELD_GRAMS = 1 << 18, 400_000
START, END = "\n", " "
SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\r\x0b\x0c"


def repeat_words(w: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in windows found twice or more in the text, the first one included."""
    n = len(w) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, w), np.int64, len(w)).view(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(window):
        key = (key ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    hit = np.zeros(len(w) + 1, np.int32)
    at = np.flatnonzero(np.isin(key, twice))
    np.add.at(hit, at, 1)
    np.add.at(hit, at + window, -1)
    return int(np.count_nonzero(np.cumsum(hit[:-1]) > 0))


def fails(w: list[bytes], repeats: int | None = None) -> bool:
    """The base rules' verdict on a text's words."""
    return len(w) < MIN_WORDS or 100 * (repeat_words(w) if repeats is None else repeats) > MAX_REPEAT_PERCENT * len(w)


def base_rules(text: bytes | None) -> tuple[list[bytes], tuple]:
    """The words, and (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    text = text or b""
    w = text.split()
    chars = len(text) if text.isascii() else len(text.decode("utf-8", "replace"))
    spaces = len(text) - len(text.translate(None, _SPACE))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeats = repeat_words(w)
    return w, (len(w), chars - spaces, symbols, len(lines) - len(set(lines)), repeats, fails(w, repeats))


def spoken(w: list[bytes]) -> str:
    """The words as the model reads them: one space between them, and one at the end."""
    return (b" ".join(w)).decode("utf-8", "replace").replace("\0", "\ufffd") + END


def _seed(lang: str | None) -> int:
    return xxhash.xxh64_intdigest((lang if lang is not None else "\x00").encode(), 42)


def _fold(columns: Iterable[np.ndarray], seed: int) -> np.ndarray:
    """64-bit hashes of n-grams from the columns of their code points, first symbol first, 0 where there is none."""
    h: np.ndarray | None = None
    for c in columns:
        h = np.full(len(c), seed, np.uint64) if h is None else h
        np.bitwise_xor(h, c, out=h)
        np.multiply(h, np.uint64(0x9E3779B97F4A7C15), out=h)
        np.bitwise_xor(h, h >> np.uint64(29), out=h)
    return h.view(np.int64)


def gram_points(grams: list[str], order: int) -> np.ndarray:
    return np.frombuffer("".join(g.rjust(order, "\0") for g in grams).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64).reshape(-1, order)


def point_grams(points: np.ndarray) -> list[str]:
    flat = points.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
    order = points.shape[1]
    return [flat[i : i + order].lstrip("\0") for i in range(0, len(flat), order)]


def _firsts(codes: np.ndarray, n: int) -> np.ndarray:
    """Where each of the n codes is met first."""
    out = np.zeros(n, np.int64)
    out[codes[::-1]] = np.arange(len(codes))[::-1]
    return out


class Piece:
    """Symbols of several texts in a row; ``at`` are the places where an n-gram ends, ``owner`` the text of each."""

    def __init__(self, chunks: list[tuple[str, int, int, int]], order: int) -> None:
        self.order = order
        self.flat = np.frombuffer("".join(c[0] for c in chunks).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        sizes = np.array([len(c[0]) for c in chunks])
        starts = np.r_[0, np.cumsum(sizes)[:-1]]
        counts = np.ones(len(self.flat), bool)
        self.short: list[tuple[int, int]] = []  # places that have so many symbols of their text before them, fewer than order - 1
        for start, (text, lead, since, _) in zip(starts.tolist(), chunks, strict=True):
            counts[start : start + max(lead, since == 0)] = False
            if since == 0:
                self.short += [(start + k, k) for k in range(min(len(text), order - 1))]
        self.at = np.flatnonzero(counts)
        self.owner = np.repeat(np.array([c[3] for c in chunks]), sizes)[self.at]

    def columns(self) -> Iterator[np.ndarray]:
        """Code points ``order - 1`` places before each place, and so on to the place itself."""
        for k in range(self.order - 1, -1, -1):
            column = np.r_[np.zeros(min(k, len(self.flat)), np.uint64), self.flat[: max(0, len(self.flat) - k)]]
            column[[i for i, before in self.short if before < k]] = 0
            yield column

    def hashes(self, seed: int) -> np.ndarray:
        return _fold(self.columns(), seed)[self.at]

    def points(self, which: np.ndarray) -> np.ndarray:
        """The n-grams that end at those of ``at``, as rows of code points."""
        return np.stack([c[self.at[which]] for c in self.columns()], axis=1)


def text_pieces(texts: list[str], order: int, piece: int = PIECE) -> Iterator[Piece]:
    """The texts in pieces of some ``piece`` symbols.

    A text begins with the start mark, which is context only; a long one is cut, and its chunks overlap by the context.
    """
    held, n = [], 0
    for i, text in enumerate(texts):
        s = START + text
        for at in range(0, len(s), piece):
            lead = min(at, order - 1)
            held.append((s[at - lead : at + piece], lead, at - lead, i))
            n += len(held[-1][0])
            if n >= piece:
                yield Piece(held, order)
                held, n = [], 0
    if held:
        yield Piece(held, order)


def count_grams(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """(lang, gram, n) over the whole texts of all documents that pass the base rules. Tasks add up before they send."""

    def merge(parts: list[tuple]) -> list[tuple]:
        """Sums of (hash, points, n), one for each hash."""
        if len(parts) < 2:
            return parts
        h, points, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        codes, kinds = pd.factorize(h)
        return [(kinds, points[_firsts(codes, len(kinds))], np.bincount(codes, weights=n).astype(np.int64))]

    def flush(held: dict) -> pa.RecordBatch:
        langs, grams, ns = [], [], []
        for lang, parts in held.items():
            _, points, n = merge(parts)[0]
            langs += [lang] * len(n)
            grams += point_grams(points)
            ns += n.tolist()
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(grams, pa.string()), pa.array(ns, pa.int64())], names=["lang", "gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = defaultdict(list)  # the first part is merged, the others are not yet
        waiting: dict = defaultdict(list)
        size: Counter = Counter()

        def take(lang: str | None) -> None:
            for part in text_pieces(waiting.pop(lang), order):
                codes, kinds = pd.factorize(part.hashes(_seed(lang)))
                held[lang].append((kinds, part.points(_firsts(codes, len(kinds))).astype(np.uint32), np.bincount(codes, minlength=len(kinds))))
                if sum(len(x[0]) for x in held[lang][1:]) > max(len(held[lang][0][0]), HELD_GRAMS // 4):
                    held[lang] = merge(held[lang])
            size[lang] = 0

        for _, (langs, texts) in rows_of(batches):
            for lang, text in zip(langs, texts, strict=True):
                w = (text or b"").split()
                if not fails(w):
                    waiting[lang].append(spoken(w))
                    size[lang] += len(waiting[lang][-1])
                    if size[lang] >= PIECE:
                        take(lang)
            if sum(len(x[0]) for parts in held.values() for x in parts) > 2 * HELD_GRAMS:
                yield flush(held)
                held.clear()
        for lang in list(waiting):
            take(lang)
        yield flush(held)

    rows = docs.select(F.col(lang_col).alias("lang"), as_bytes(text_col).alias("text")).mapInArrow(run, "lang string, gram string, n long")
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, logp, logb): interpolated log probability of the gram's last symbol, and the log back-off weight of the gram as a context.

    Logarithms are whole numbers of 1 / UNIT nats, so a document's sum is the same in whatever order it is added up.
    """
    raw = settle(counts.select(F.coalesce("lang", F.lit("\x00")).alias("lang"), "gram", "n"), "kn-counts")
    tables = {order: raw.where(F.length("gram") == order)}
    for k in range(order - 1, 0, -1):
        longer = tables[k + 1].select("lang", F.substring("gram", 2, k).alias("gram")).groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("n"))
        tables[k] = settle(raw.where(F.length("gram") == k).unionByName(longer), f"kn-order{k}")
    # discounts and contexts of all orders at once: fewer and smaller plans for the driver than order by order
    union = lambda xs: reduce(DataFrame.unionByName, xs)
    every = union([t.select("lang", "gram", "n", F.lit(k).alias("k")) for k, t in tables.items()])
    c = [F.count_if(F.col("n") == i).cast("double").alias(f"n{i}") for i in range(1, 5)]
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
    raw_d = lambda i: i - (i + 1) * y * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}"))
    discount = lambda i: F.when(raw_d(i).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(float(i)), raw_d(i)))).otherwise(0.5 * i)
    d = every.groupBy("lang", "k").agg(*c, F.count(F.lit(1)).alias("kinds")).select("lang", "k", "kinds", *(discount(i).alias(f"d{i}") for i in (1, 2, 3)))
    d = settle(d, "kn-discounts")  # a row a language and order
    d = F.broadcast(d) if d.limit(order * MAX_LANGS + 1).count() <= order * MAX_LANGS else d
    # whole numbers are added up, so that no order of addition shows in the result
    head = F.expr("substring(gram, 1, k - 1)")
    sums = every.groupBy("lang", "k", head.alias("h")).agg(F.sum("n").alias("all"), *(F.count_if(F.least("n", F.lit(3)) == i).alias(f"k{i}") for i in (1, 2, 3)))
    gone = sum((F.col(f"d{i}") * F.col(f"k{i}") for i in (2, 3)), F.col("d1") * F.col("k1"))
    contexts = settle(sums.join(d, ["lang", "k"]).select("lang", "k", "h", "all", "kinds", "d1", "d2", "d3", (gone / F.col("all")).alias("b")), "kn-contexts")
    fitted, lower = [], None
    for k in range(1, order + 1):
        t = tables[k].withColumn("h", F.substring("gram", 1, k - 1) if k > 1 else F.lit(""))
        p = t.join(contexts.where(F.col("k") == k).drop("k"), ["lang", "h"]).withColumn("own", (F.col("n") - F.expr("case when n = 1 then d1 when n = 2 then d2 else d3 end")) / F.col("all"))
        if lower is None:
            p = p.withColumn("p", F.col("own") + F.col("b") / (F.col("kinds") + 1))
        else:
            p = p.withColumn("tail", F.substring("gram", 2, k - 1)).join(lower.select("lang", F.col("gram").alias("tail"), F.col("p").alias("q")), ["lang", "tail"], "left")
            p = p.withColumn("p", F.col("own") + F.col("b") * F.coalesce("q", F.lit(1e-9)))
        lower = settle(p.select("lang", "gram", "p"), f"kn-p{k}")
        fitted.append(lower)
    both = union(fitted).join(contexts.select("lang", F.col("h").alias("gram"), "b"), ["lang", "gram"], "full")
    units = lambda x: F.round(F.ln(x) * UNIT).cast("int")
    return settle(both.select("lang", "gram", units(F.col("p")).alias("logp"), units(F.greatest("b", F.lit(1e-9))).alias("logb")), "kn-model")


def _sorted_arrays(model: DataFrame, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, log probabilities and log back-off weights, sorted by hash. Tasks pack their rows, so that the driver gets plain bytes, 16 a row."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, grams = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            h, owner = np.zeros(len(grams), np.int64), np.array(langs, object)
            for lang in set(langs):
                mine = np.flatnonzero(owner == lang)
                h[mine] = _fold(gram_points([grams[i] for i in mine], order).T, _seed(lang))
            p, b = (batch.column(i).fill_null(NONE).to_numpy().astype(np.int32) for i in (2, 3))
            yield pa.RecordBatch.from_pydict({"data": [h.tobytes() + p.tobytes() + b.tobytes()]})

    parts = []
    for row in model.select("lang", "gram", "logp", "logb").mapInArrow(pack, "data binary").toLocalIterator():
        n = len(row.data) // 16
        parts.append((np.frombuffer(row.data, np.int64, n), np.frombuffer(row.data, np.int32, n, 8 * n), np.frombuffer(row.data, np.int32, n, 12 * n)))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
    h, p, b = (np.concatenate(x) for x in zip(*parts, strict=True))
    at = np.argsort(h)
    return h[at], p[at], b[at]


class Arrays:
    """The model as sorted hashes with log probabilities and back-off weights."""

    def __init__(self, hashes: np.ndarray, logp: np.ndarray, logb: np.ndarray, order: int) -> None:
        self.hashes, self.logp, self.logb, self.order = hashes, logp, logb, order

    def find(self, h: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The value of each hash, NONE if there is none."""
        if not len(self.hashes):
            return np.full(len(h), NONE)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, values[at], NONE).astype(np.int64)

    def logs(self, points: np.ndarray, seed: int) -> np.ndarray:
        """Log probability of each n-gram's last symbol, backed off where the model does not hold the n-gram."""
        out = self.find(_fold(points.T, seed), self.logp)
        open_ = np.flatnonzero(out == NONE)
        points, back = points[open_].copy(), np.zeros(len(open_), np.int64)
        while len(open_):
            context = np.c_[np.zeros(len(points), np.uint64), points[:, :-1]]
            weight = self.find(_fold(context.T, seed), self.logb)
            back += np.where((weight == NONE) | ~context.any(axis=1), 0, weight)
            first = np.argmax(points != 0, axis=1)
            last = first == self.order - 1
            points[np.arange(len(points)), first] *= last.astype(np.uint64)
            found = np.where(last, UNKNOWN, self.find(_fold(points.T, seed), self.logp))
            done = found != NONE
            out[open_[done]] = (back + found)[done]
            open_, points, back = open_[~done], points[~done], back[~done]
        return out

    def score(self, texts: list[str], seed: int) -> np.ndarray:
        """Log probability of each text, in units."""
        total = np.zeros(len(texts))
        for part in text_pieces(texts, self.order):
            codes, kinds = pd.factorize(part.hashes(seed))
            total += np.bincount(part.owner, weights=self.logs(part.points(_firsts(codes, len(kinds))), seed)[codes], minlength=len(texts))
        return total


_STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _text_key(lang_col: str, text_col: str) -> Column:
    """128 bits of language and text, which is all that a verdict depends on."""
    return F.md5(F.concat(F.coalesce(F.concat(F.lit("="), F.col(lang_col)), F.lit("")), F.lit("\n"), F.coalesce(F.col(text_col), F.lit(""))).cast("binary"))


def score(docs: DataFrame, model: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", order: int = ORDER, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(text_key, doc_id, lang, five counts, base_failed, nll): the negative log likelihood, in units, of documents that pass the base rules."""
    kind = docs.schema[id_col].dataType.simpleString()
    named = docs.select(_text_key(lang_col, text_col).alias("text_key"), F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), as_bytes(text_col).alias("text"))
    small = model.limit(max_broadcast + 1).count() <= max_broadcast
    sent = docs.sparkSession.sparkContext.broadcast(_sorted_arrays(model, order)) if small else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = Arrays(*sent.value, order) if sent else None
        for part, (_, _, langs, texts) in rows_of(batches):
            stats, nll, said = [], [None] * len(texts), defaultdict(list)
            for i, (lang, text) in enumerate(zip(langs, texts, strict=True)):
                w, own = base_rules(text)
                stats.append(own)
                if arrays and not own[-1]:
                    said[lang].append((i, spoken(w)))
            for lang, own in said.items():
                for (i, _), total in zip(own, arrays.score([t for _, t in own], _seed(lang)), strict=True):
                    nll[i] = -int(total)
            counts = [pa.array([s[k] for s in stats], pa.int64()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), *counts, pa.array([s[5] for s in stats]), pa.array(nll, pa.int64())], names=["text_key", "doc_id", "lang", *_STATS, "base_failed", "nll"])

    rows = named.mapInArrow(run, f"text_key string, doc_id {kind}, lang string, {', '.join(f'{c} long' for c in _STATS)}, base_failed boolean, nll long")
    return rows if small else rows.drop("nll").join(_score_by_join(named, model, order), "text_key", "left")


def _score_by_join(named: DataFrame, model: DataFrame, order: int) -> DataFrame:
    """(text_key, nll) with the model in tables: the n-grams of each distinct text back off by a join an order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (keys, _, langs, texts) in rows_of(batches, 16):
            for key, lang, text in zip(keys, langs, texts, strict=True):
                w = (text or b"").split()
                if fails(w):
                    continue
                for part in text_pieces([spoken(w)], order):
                    _, first, n = np.unique(part.hashes(0), return_index=True, return_counts=True)
                    yield pa.RecordBatch.from_pydict({"text_key": [key] * len(n), "lang": [lang if lang is not None else "\x00"] * len(n), "gram": point_grams(part.points(first)), "n": n})

    rows = named.dropDuplicates(["text_key"]).mapInArrow(run, "text_key string, lang string, gram string, n long").withColumn("b", F.lit(0).cast("long"))
    done = []
    for _ in range(order):
        rows = settle(rows.join(model.select("lang", "gram", "logp"), ["lang", "gram"], "left"), "kn-scored")
        done.append(rows.where("logp is not null or length(gram) = 1").select("text_key", "n", (F.col("b") + F.coalesce("logp", F.lit(UNKNOWN))).alias("l")))
        left = rows.where("logp is null and length(gram) > 1").drop("logp").withColumn("h", F.expr("substring(gram, 1, length(gram) - 1)"))
        weights = model.select("lang", F.col("gram").alias("h"), "logb")
        rows = left.join(weights, ["lang", "h"], "left").select("text_key", "lang", F.expr("substring(gram, 2)").alias("gram"), "n", (F.col("b") + F.coalesce("logb", F.lit(0))).alias("b"))
    return reduce(DataFrame.unionByName, done).groupBy("text_key").agg((-F.sum(F.col("n") * F.col("l"))).cast("long").alias("nll"))


def quality(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", order: int = ORDER, band: float = BAND, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(text_key, doc_id, five counts, base_failed, perplexity, lower, upper, kept) for every row of ``docs``; other columns are not read.

    The band of a language is its median log perplexity a word, plus and minus ``band`` times the median absolute deviation,
    which is scaled up for short documents by what so few words scatter. Null texts have no words, so they fail;
    a null language is one of its own; null ids are fine; repeated rows are all returned and counted; an empty table gives no rows;
    long texts are read whole, in pieces.
    """
    model = fit(count_grams(docs, lang_col, text_col, order), order)
    scored = settle(score(docs, model, id_col, lang_col, text_col, order, max_broadcast), "kn-documents")
    x = F.try_divide(F.col("nll") / UNIT, F.col("n_words"))
    rated = scored.withColumn("x", F.round(x, 3)).withColumn("l", F.coalesce("lang", F.lit("\x00")))
    # medians are taken of rounded values, whose number is bounded
    middle = settle(rated.where("x is not null").groupBy("l").agg(F.percentile("x", 0.5).alias("mid")), "kn-middle")
    few = middle.limit(MAX_LANGS + 1).count() <= MAX_LANGS
    send = F.broadcast if few else lambda side: side
    off = F.abs(F.col("x") - F.col("mid"))
    spread = rated.where("x is not null").join(send(middle), "l").groupBy("l", "mid").agg(F.percentile(F.round(off, 3), 0.5).alias("mad"), F.percentile(F.round(off * F.sqrt("n_words"), 2), 0.5).alias("one"))
    out = rated.join(send(settle(spread, "kn-bands")), "l", "left")
    wide = band * F.sqrt(F.col("mad") * F.col("mad") + F.coalesce(F.try_divide(F.col("one") * F.col("one"), F.col("n_words")), F.lit(0.0)))
    out = out.withColumn("lower", F.exp(F.col("mid") - wide)).withColumn("upper", F.exp(F.col("mid") + wide)).withColumn("perplexity", F.exp(x))
    kept = ~F.col("base_failed") & F.coalesce(F.col("perplexity").between(F.col("lower"), F.col("upper")), F.lit(False))
    return out.select("text_key", "doc_id", *_STATS, "base_failed", "perplexity", "lower", "upper", kept.alias("kept"))


@extras_apart
def keep_good(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", **kw) -> DataFrame:
    """``docs`` without the documents that the base rules or their language's band reject; columns and their order are kept.

    Rows are told by 128 bits of their language and text, whatever their ids, as equal texts of a language share their fate.
    """
    good = quality(docs, id_col, lang_col, text_col, **kw).where("kept").select(F.col("text_key").alias("__good_text")).distinct()
    return docs.join(good, _text_key(lang_col, text_col) == F.col("__good_text"), "left_semi").select(*docs.columns)
