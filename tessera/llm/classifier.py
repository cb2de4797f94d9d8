"""Quality classifier: supervised subword embeddings.

A document is the mean of the learned vectors of its features (hashed words, and hashed character n-grams within words);
a softmax over two classes reads that mean. Both layers are trained by stochastic gradient descent in numpy on a bounded
sample of labelled rows. Since the mean is linear, scoring needs one number per bucket, and a text is scored whole.

Cases: a null or empty text has no features and gets the score of the bias. Repeated rows are scored each. Labels that
are null, or of documents that don't exist, are not used; without labels the score is 0.5. lang, source, doc_id and the
labels are no inputs of a score. A text is read whole, however long, by a task that holds a batch. Extra columns are ignored,
whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import Scratch, held_out, small
from tessera.llm.kernel import mix, powers, spans, texts, word_hashes, _CHAR, _R, _R_INV

BITS, DIM, NGRAMS = 17, 12, (3, 4)
#: The sample: so many labelled rows and so many bytes of text at most, those of the smallest hashes of their ids.
SAMPLE_ROWS, SAMPLE_BYTES = 4000, 24 << 20
EPOCHS, RATE, SEED = 8, 0.5, 13
THRESHOLD = 0.3


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the features of each text, one text after another, and where each text's begin."""
    starts, ends, first = spans(data, off)
    top = np.uint64(64 - BITS)
    words = (word_hashes(data, starts, ends, lower=False) >> top).astype(np.int32)
    parts, bounds = [words], [first]
    n = len(data)
    if n:
        h = np.zeros(n + 1, np.uint64)
        np.cumsum(_CHAR[data] * powers(_R, n), out=h[1:])
        inverse = powers(_R_INV, n)
        # How many bytes of its word follow a byte, itself included.
        left = np.zeros(n, np.int64)
        lens = ends - starts
        total = int(lens.sum())
        at = np.repeat(starts - (np.cumsum(lens) - lens), lens) + np.arange(total)
        left[at] = np.repeat(ends, lens) - at
        for size in NGRAMS:
            where = np.flatnonzero(left >= size)
            g = (h[where + size] - h[where]) * inverse[where] + np.uint64(size)
            parts.append((mix(g) >> top).astype(np.int32))
            bounds.append(np.searchsorted(where, off))
    else:
        bounds = [first]
    counts = [np.diff(b) for b in bounds]
    total = np.sum(counts, axis=0)
    out, ends_ = np.empty(int(total.sum()), np.int32), np.concatenate([[0], np.cumsum(total)])
    place = ends_[:-1].copy()
    for part, c, b in zip(parts, counts, bounds):
        out[np.repeat(place - b[:-1], c) + np.arange(b[0], b[-1])] = part[b[0] : b[-1]]
        place += c
    return out, ends_


def train(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, float]:
    """rows: (buckets, their shares in the document, label). A weight for each bucket, and a bias."""
    rng = np.random.default_rng(SEED)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(len(rows)):
            at, share, y = rows[i]
            e = emb[at]
            v = share @ e
            z = out @ v + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            grad = (p @ out) * rate
            out -= rate * np.outer(p, v)
            bias -= rate * 0.1 * p
            emb[at] = e - share[:, None] * grad[None, :] * 20
    return emb @ (out[1] - out[0]), float(bias[1] - bias[0])


def _sample(batches):
    for batch in batches:
        for i, j, data, off in texts(batch):
            f, at = features(data, off)
            rows = [np.unique(f[a:b], return_counts=True) for a, b in zip(at[:-1], at[1:])]
            yield pa.record_batch([pa.array([r[0].tobytes() for r in rows], pa.binary()), pa.array([r[1].astype(np.int32).tobytes() for r in rows], pa.binary()), batch.column("y")[i:j]], ["at", "n", "y"])


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Trains on the sample of labelled rows outside the held-out fold."""
    scratch = Scratch(spark, "classifier")
    y = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 0)).groupBy("doc_id").agg(F.max("quality").cast("int").alias("y"))
    size = F.octet_length("text")
    # Labels of documents that are there, and have a text.
    y = scratch.write(y, "labelled")
    there = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id")).join(small(y), "doc_id").groupBy("doc_id").agg(F.max("y").alias("y"))
    # Ids of the sample: the smallest hashes, so that it doesn't depend on order.
    y = scratch.write(there.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS), "labels")
    got = scratch.write(docs.select("doc_id", "text").where("text is not null").join(small(y), "doc_id").dropDuplicates(["doc_id"]), "sample")
    total = F.sum("size").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    ids = got.select("doc_id", size.alias("size")).withColumn("total", total).where((F.col("total") <= SAMPLE_BYTES) | (F.col("total") == F.col("size"))).select("doc_id")
    chosen = got.join(F.broadcast(ids), "doc_id").select("doc_id", "text", "y")
    rows = sorted((r.y, bytes(r.at), bytes(r.n)) for r in chosen.mapInArrow(_sample, "at binary, n binary, y int").toLocalIterator())
    out = []
    for label, at, n in rows:
        at, n = np.frombuffer(at, np.int32), np.frombuffer(n, np.int32)
        if len(at):
            out.append((at, (n / n.sum()).astype(np.float32), label))
    return train(out) if out else (np.zeros(1 << BITS, np.float32), 0.0)


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id and score, a row per document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        weights, bias = shared.value
        for batch in batches:
            for i, j, data, off in texts(batch):
                f, at = features(data, off)
                total = np.concatenate([[0.0], np.cumsum(weights[f], dtype=np.float64)])
                n = np.diff(at)
                z = (total[at[1:]] - total[at[:-1]]) / np.maximum(n, 1) + bias
                yield pa.record_batch([batch.column("doc_id")[i:j].cast(pa.int64()), pa.array(1 / (1 + np.exp(-z)), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def op5(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    s = score(docs, fit(spark, docs, labels))
    fold = F.coalesce(held_out(F.col("doc_id"), 0), F.lit(False))
    return s.select("doc_id", fold.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))
