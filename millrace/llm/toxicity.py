"""Toxicity from subword bags: word and character n-gram embeddings are averaged over the text into a linear softmax.

Embeddings (by gradient steps) and softmax (by Adam) are trained jointly in numpy, on minibatches of a bounded sample of labelled rows. A misspelling
never seen in training shares most of its n-grams with the word it stands for, and so its vectors. Once trained, every
n-gram adds a number to the text's margin, so scoring looks up one sum a word and all texts are scored whole, in one pass.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import as_bytes, rows_of

BUCKETS, DIM, SIZES, EPOCHS, BATCH, RATE = 1 << 19, 8, (3, 4, 5), 8, 64, 0.05
#: The classifier is fitted on at most this many labelled rows, those that come first by a hash of their ids.
MAX_TRAIN = 3_000
THRESHOLD, HELD_WORDS = 0.3, 300_000
#: An n-gram in a share q of the training rows weighs SMOOTH / (SMOOTH + q) in a text's average, so that a few rare words are not
#: lost among common ones. Its vector moves by plain gradient steps: what few rows hold moves little, and no n-gram is left out.
SMOOTH, STEP = 0.03, 4000.0
#: Rows of label 1 count this often; the softmax starts with its two directions this far apart, whatever the seed.
POSITIVE, SPREAD = 4.0, 1.2
_EDGE = ".,;:!?%*&$#|\"'()[]<>-_"


def _mix(columns: list[np.ndarray]) -> np.ndarray:
    h = np.full(len(columns[0]), len(columns), np.uint64)
    for c in columns:
        h = (h ^ c) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def features(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word and of its character n-grams, word boundaries included, all words in a row, and how many each word has.

    Words are lower-cased and stripped of punctuation; of a word that is nothing else there are none.
    """
    plain = [t.decode("utf-8", "replace").lower().strip(_EDGE) for t in tokens]
    held = np.array([i for i, w in enumerate(plain) if w], np.int64)
    counts = np.zeros(len(tokens), np.int64)
    if not len(held):
        return np.zeros(0, np.int64), counts
    whole = np.array([zlib.crc32(plain[i].encode("utf-8", "surrogatepass")) for i in held], np.uint64)
    flat = np.frombuffer("".join(f"<{plain[i]}>" for i in held).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(plain[i]) + 2 for i in held])
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(flat))  # symbols up to the word's end
    full, word = np.repeat(sizes, sizes), np.repeat(np.arange(len(held)), sizes)
    owners, found = [np.arange(len(held))], [whole]
    for n in SIZES:
        at = np.flatnonzero((left >= n) & (full > n))
        owners.append(word[at])
        found.append(_mix([flat[at + k] for k in range(n)]))
    owner, buckets = np.concatenate(owners), (np.concatenate(found) % np.uint64(BUCKETS)).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    counts[held] = np.bincount(owner, minlength=len(held))
    return buckets[order], counts


def held_out(id_col: str) -> Column:
    """Rows that are never learnt from: crc32 of the id's text leaves 2 by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def bags(texts: list[bytes | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text and their shares. A few texts' words are cut at once, to hold little memory."""
    out = []
    for at in range(0, len(texts), 64):
        counts = [Counter((t or b"").split()) for t in texts[at : at + 64]]
        vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for c in counts for w in c))}
        flat, sizes = features(list(vocabulary))
        starts = np.r_[0, np.cumsum(sizes)]
        for c in counts:
            words = [vocabulary[w] for w in c]
            parts = [flat[starts[i] : starts[i + 1]] for i in words]
            ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            n = np.repeat(np.fromiter(c.values(), np.float32, len(c)), sizes[words]) if words else np.zeros(0, np.float32)
            found, kind = np.unique(ids, return_inverse=True)
            share = np.bincount(kind, weights=n, minlength=len(found)).astype(np.float32)
            out.append((found.astype(np.int32), share / max(1.0, share.sum())))
    return out


def train(texts: list[bytes | None], labels: list[int], epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, float]:
    """(margin of each bucket, bias) of the fitted softmax: class 1 against class 0. N-grams that no text has add nothing."""
    if not texts:
        return np.zeros(BUCKETS, np.float32), 0.0
    return fit(bags(texts), np.array(labels), epochs, seed)


def fit(held: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, float]:
    """``train`` of texts whose bags are made."""
    rng = np.random.default_rng(seed)
    sizes = np.array([len(b) for b, _ in held])
    starts = np.r_[0, np.cumsum(sizes)]
    known, every = np.unique(np.concatenate([b for b, _ in held]), return_inverse=True)
    rarity = (SMOOTH / (SMOOTH + np.bincount(every, minlength=len(known)) / len(held))).astype(np.float32)
    weight = np.concatenate([w for _, w in held]) * rarity[every]
    emb = rng.standard_normal((len(known), DIM), np.float32) * np.float32(0.05)
    soft, bias = rng.normal(0, 1, (DIM, 2)).astype(np.float32), np.log([max(1, (y == c).sum()) / len(y) for c in (0, 1)]).astype(np.float32)
    soft *= SPREAD / np.linalg.norm(soft[:, 1] - soft[:, 0])
    cost = np.where(y == 1, POSITIVE, 1.0).astype(np.float32)
    ms, vs, mb, vb = np.zeros_like(soft), np.zeros_like(soft), np.zeros(2, np.float32), np.zeros(2, np.float32)
    flat, places, step = emb.reshape(-1), np.arange(DIM), 0
    for _ in range(epochs):
        order = rng.permutation(len(held))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            owner = np.repeat(np.arange(len(rows)), sizes[rows])
            if not len(owner):
                continue
            step += 1
            take = np.concatenate([np.arange(starts[r], starts[r + 1]) for r in rows])
            ids, w = every[take], weight[take]
            mean = np.stack([np.bincount(owner, w * emb[ids, d], len(rows)) for d in places], axis=1).astype(np.float32)
            z = mean @ soft + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p *= cost[rows, None] / len(rows)
            g_soft, g_bias = mean.T @ p, p.sum(axis=0)
            np.add.at(flat, (ids[:, None] * DIM + places).ravel(), ((-STEP * w)[:, None] * (p @ soft.T)[owner]).ravel())
            fix1, fix2 = 1 - 0.9**step, 1 - 0.999**step
            for x, g, a, b in ((soft, g_soft, ms, vs), (bias, g_bias, mb, vb)):
                a[...] = 0.9 * a + 0.1 * g
                b[...] = 0.999 * b + 0.001 * g * g
                x -= RATE * (a / fix1) / (np.sqrt(b / fix2) + 1e-8)
    margin = np.zeros(BUCKETS, np.float32)
    margin[known] = rarity * (emb @ (soft[:, 1] - soft[:, 0]))
    return margin, float(bias[1] - bias[0])


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_train: int) -> DataFrame:
    """At most max_train rows (text binary, label) that may be learnt from."""
    ours = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    ours = ours.groupBy(F.col(id_col).alias("__of")).agg(F.max(label_col).cast("int").alias("label"))
    first = ours.orderBy(F.xxhash64("__of"), "__of").limit(max_train)
    return docs.join(F.broadcast(first), docs[id_col] == first["__of"]).groupBy("__of").agg(F.min(as_bytes(text_col)).alias("text"), F.first("label").alias("label")).orderBy("__of")


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Null, empty and word-less texts get the score that the bias alone gives. A null id is scored like any other and is not held
    out; of labels that repeat an id the largest counts; of documents that repeat an id the first by text is learnt from, all are
    scored; without labels every score is 0.5; an empty table gives no rows.
    """
    sample = training_rows(docs, labels, id_col, text_col, label_col, max_train).collect()
    margin, bias = train([bytes(r.text) if r.text is not None else None for r in sample], [int(r.label > 0) for r in sample])
    sent = docs.sparkSession.sparkContext.broadcast((margin, bias))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margin, bias = sent.value
        sums: dict[bytes, float] = {}
        sizes: dict[bytes, int] = {}
        for part, (_, _, texts) in rows_of(batches):
            tokens = [(text or b"").split() for text in texts]
            new = list({w for t in tokens for w in t}.difference(sums))
            flat, n = features(new)
            totals = np.bincount(np.repeat(np.arange(len(new)), n), weights=margin[flat], minlength=len(new))
            sums.update(zip(new, totals.tolist(), strict=True))
            sizes.update(zip(new, n.tolist(), strict=True))
            out = []
            for t in tokens:
                z = bias + sum(map(sums.__getitem__, t)) / max(1, sum(map(sizes.__getitem__, t)))
                out.append(1 / (1 + math.exp(-max(-500.0, min(500.0, z)))))
            if len(sums) > HELD_WORDS:
                sums, sizes = {}, {}
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.float64())], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), as_bytes(text_col).alias("text"))
    rows = rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
