"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network with a calibrated temperature."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import RangeHash, mix, steps, text_of, utf8

#: Hashed vocabulary, width of a vector, entries of a token's random index vector, neighbours on each side.
BUCKETS, WIDTH, NONZERO, REACH = 1 << 15, 32, 2, 2
#: Rows of a block in which tasks send their sums.
BLOCK = 1 << 9
#: Most labelled rows that the network is fitted on, chosen by a hash of the id; everything else covers all documents.
TRAIN_ROWS = 20_000
HIDDEN, EPOCHS, MIN_STEPS, BATCH, RATE, DECAY = 32, 40, 1500, 256, 3e-3, 1e-4
THRESHOLD = 0.7

#: Kind of byte: 0 white space, 1 letter (and all beyond ASCII), 2 digit, 3 any other.
_KIND = np.full(256, 3, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E), 0]] = 0
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_KIND[0x30:0x3A] = 2


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every token: a run of letters, digits or other marks."""
    kind = _KIND[data]
    change = np.zeros(len(data) + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[offsets] = True
    edges = np.flatnonzero(change)
    start, end = edges[:-1], edges[1:]
    real = kind[start] > 0 if len(start) else np.zeros(0, bool)
    start, end = start[real], end[real]
    return RangeHash(data).of(start, end), np.searchsorted(offsets, start, side="right") - 1


def context_sums(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For every bucket, the sum of the index vectors of the tokens around its tokens."""
    row = (hashes % np.uint64(BUCKETS)).astype(np.int64)
    total = np.zeros(BUCKETS * WIDTH)
    for k in range(NONZERO):
        drawn = mix(hashes + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64)))
        dim, sign = (drawn % np.uint64(WIDTH)).astype(np.int64), 1.0 - 2.0 * ((drawn >> np.uint64(32)) & np.uint64(1)).astype(float)
        for d in range(1, REACH + 1):
            near = doc[d:] == doc[:-d]
            for word, other in ((row[:-d], slice(d, None)), (row[d:], slice(None, -d))):
                total += np.bincount(word[near] * WIDTH + dim[other][near], weights=sign[other][near], minlength=len(total))
    return total.reshape(BUCKETS, WIDTH)


def pooled(data: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Features of every text: mean and spread of its word vectors, how alike neighbours are, length of the mean, log count."""
    n = len(offsets) - 1
    hashes, doc = tokens(data, offsets)
    out = np.zeros((n, 2 * WIDTH + 3), np.float32)
    if not len(hashes):
        return out
    own = vectors[(hashes % np.uint64(BUCKETS)).astype(np.int64)]
    count = np.bincount(doc, minlength=n)
    here = np.flatnonzero(count)
    first = np.concatenate([[0], np.cumsum(count[here])[:-1]])
    size = count[here][:, None].astype(np.float32)
    mean = np.add.reduceat(own, first, axis=0) / size
    square = np.add.reduceat(own * own, first, axis=0) / size
    out[here, :WIDTH], out[here, WIDTH : 2 * WIDTH] = mean, np.sqrt(np.maximum(square - mean * mean, 0))
    near = doc[1:] == doc[:-1]
    alike = np.bincount(doc[1:][near], weights=np.einsum("ij,ij->i", own[1:], own[:-1])[near], minlength=n)
    out[:, -3] = alike / np.maximum(1, count - 1)
    out[here, -2] = np.sqrt((mean * mean).sum(axis=1))
    out[:, -1] = np.log1p(count)
    return out


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Random-indexing vectors over all documents: every task adds up a matrix of fixed size, the sums meet block by block.

    The matrix is BUCKETS x WIDTH (4 MB), whatever the corpus; blocks are added as they stream in, never gathered.
    """

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BUCKETS, WIDTH))
        for part in steps(batches, "text", 2 << 20):
            hashes, doc = tokens(*utf8(part.column("text")))
            if len(hashes):
                total += context_sums(hashes, doc)
        yield sent(total.reshape(-1, BLOCK * WIDTH), np.arange(BUCKETS // BLOCK))

    def sent(sums: np.ndarray, blocks: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([s.astype("<f8").tobytes() for s in sums], pa.binary())], ["block", "sums"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch.column("block").to_pylist(), batch.column("sums").to_pylist()):
                sums[block] = sums.get(block, 0) + np.frombuffer(raw, "<f8")
        if sums:
            yield sent(np.stack(list(sums.values())), np.array(list(sums)))

    shape = "block int, sums binary"
    parts = docs.select(text_of(text).alias("text")).mapInArrow(add_up, shape).repartition(BUCKETS // BLOCK, "block").mapInArrow(merge, shape)
    total = np.zeros((BUCKETS // BLOCK, BLOCK * WIDTH))
    for r in parts.collect():
        total[r["block"]] += np.frombuffer(r["sums"], "<f8")
    total = total.reshape(BUCKETS, WIDTH)
    norm = np.sqrt((total * total).sum(axis=1, keepdims=True))
    return (total / np.maximum(norm, 1e-9)).astype(np.float32)


@dataclass
class Network:
    """Standardised features, one hidden layer, one logit, divided by a temperature."""

    centre: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    temperature: float = 1.0

    def logits(self, features: np.ndarray) -> np.ndarray:
        x = np.clip((features - self.centre) / self.scale, -8, 8)
        w1, b1, w2, b2 = self.weights
        return (np.tanh(x @ w1 + b1) @ w2)[:, 0] + b2[0]

    def probabilities(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(features) / self.temperature, -500, 500)))


def fit(features: np.ndarray, labels: np.ndarray, seed: int = 7) -> Network:
    """Two-layer network by Adam on four fifths of the rows; the temperature is set on the rest."""
    rng = np.random.default_rng(seed)
    width = features.shape[1]
    net = Network(np.zeros(width), np.ones(width), [np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros((HIDDEN, 1)), np.zeros(1)])
    if not len(labels) or labels.min() == labels.max():  # nothing to learn from: the share of label 1, or a half
        share = (labels.sum() + 1) / (len(labels) + 2)
        net.weights[3][:] = np.log(share / (1 - share))
        return net
    net.centre, net.scale = features.mean(axis=0), features.std(axis=0) + 1e-6
    net.weights[0] = rng.normal(0, width**-0.5, (width, HIDDEN))
    net.weights[2] = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 1))
    order = rng.permutation(len(labels))
    held, used = order[: len(order) // 5], order[len(order) // 5 :]
    x, y = np.clip((features - net.centre) / net.scale, -8, 8), labels.astype(float)
    first, second = [np.zeros_like(w) for w in net.weights], [np.zeros_like(w) for w in net.weights]
    step = 0
    for _ in range(max(EPOCHS, MIN_STEPS // (len(used) // BATCH + 1))):
        rng.shuffle(used)
        for at in range(0, len(used), BATCH):
            b = used[at : at + BATCH]
            w1, b1, w2, b2 = net.weights
            h = np.tanh(x[b] @ w1 + b1)
            error = (1 / (1 + np.exp(-(h @ w2)[:, 0] - b2[0])) - y[b])[:, None] / len(b)
            back = error @ w2.T * (1 - h * h)
            grads = [x[b].T @ back + DECAY * w1, back.sum(axis=0), h.T @ error + DECAY * w2, error.sum(axis=0)]
            step += 1
            for k, g in enumerate(grads):
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                net.weights[k] = net.weights[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    if len(held) > 10:
        z, t = net.logits(features[held]), y[held]
        grid = np.geomspace(0.25, 8, 121)
        loss = [float(np.mean(np.logaddexp(0, z / g) - t * z / g)) for g in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


def fold(doc: str | Column) -> Column:
    """crc32 of the id as text, modulo 4; remainder 2 is held out. A null id has a null fold and is not held out."""
    return F.crc32((F.col(doc) if isinstance(doc, str) else doc).cast("string").cast("binary")) % 4


def score_quality(docs: DataFrame, labels: DataFrame, corpus: DataFrame | None = None, doc: str = "doc_id", text: str = "text", quality: str = "quality", train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """All rows of docs with held_out, score (probability of label 1) and predicted (1 from the threshold on).

    Word vectors come from every document of the corpus (by default docs). The network is fitted on at most `train_rows`
    labelled rows outside the held-out fold, those with the least hash of their id; their features are a bounded table that the
    driver holds, as it holds the model (about 4 MB). Scoring is one pass without a shuffle. Only the text enters a score.

    Null and empty texts have zero features and a score as any other; rows with a null id are scored, never learnt from. Labels
    and rows that repeat in id, label and text are one example, null labels are left out; without labels of both kinds the score is one number for all. The new
    columns replace columns of the same names.
    """
    spark = docs.sparkSession
    corpus = docs if corpus is None else corpus
    vectors = word_vectors(corpus, text)
    shared = spark.sparkContext.broadcast(vectors)
    taught = labels.select(F.col(doc).alias("id"), F.col(quality).cast("int").alias("y")).where(F.col("y").isNotNull() & (fold("id") != 2))
    taught = spark.createDataFrame(taught.orderBy(F.xxhash64("id"), "id", "y").limit(train_rows).collect(), taught.schema)
    examples = corpus.select(F.col(doc).alias("id"), text_of(text).alias("text")).join(F.broadcast(taught), "id")
    # rows that repeat an id are examples too, each different text once; so many ids may repeat that the bound holds here again
    examples = examples.withColumn("tie", F.xxhash64("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, "text", 1 << 20):
            made = pooled(*utf8(part.column("text")), shared.value)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "y", "tie")), pa.array(list(made), pa.list_(pa.float32()))], ["id", "y", "tie", "x"])

    kind = examples.schema["id"].dataType.simpleString()
    made = examples.mapInArrow(features, f"id {kind}, y int, tie long, x array<float>").groupBy("id", "y", "tie").agg(F.count(F.lit(1)).alias("n"), F.first("x").alias("x"))
    rows = made.orderBy(F.xxhash64("id"), "id", "y", "tie").limit(train_rows).collect()
    net = fit(np.array([r["x"] for r in rows], np.float32).reshape(len(rows), 2 * WIDTH + 3), np.array([r["y"] for r in rows], np.int64))
    kept = docs.drop("held_out", "score", "predicted")
    wanted = kept.withColumn("score", F.lit(0.0))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, text, 1 << 20):
            made = net.probabilities(pooled(*utf8(part.column(text)), shared.value))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(np.round(made.astype(float), 12))], part.schema.names)  # equal texts score alike, whatever stands around them

    out = wanted.mapInArrow(score, wanted.schema)
    return out.withColumn("held_out", F.coalesce(fold(doc) == 2, F.lit(False))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
