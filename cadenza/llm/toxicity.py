"""Toxicity by multiple-instance learning: only documents have labels, and a document is toxic if any of its sentences is."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import RangeHash, materialize, mix, steps, text_of, utf8

#: Most labelled rows that features and weights are learnt from, chosen by a hash of the id; scoring covers all documents.
TRAIN_ROWS = 20_000
#: Features kept: those most associated with the label, by the log-likelihood ratio, in so many toxic documents at least.
FEATURES, MIN_RATIO, MIN_TOXIC = 4096, 10.0, 3
#: Words in a sentence; longer runs without an end are cut.
SENTENCE_WORDS = 48
#: Bytes of the word beginnings that are features beside the word.
STEMS = (4, 5, 6, 7, 8)
STEPS, RATE, DECAY, START = 400, 0.05, 1e-3, -6.0
THRESHOLD = 0.5

_WORD = np.zeros(256, bool)
_WORD[[*range(0x61, 0x7B), *range(0x41, 0x5B), *range(0x80, 0x100)]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def cut_sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (start, end and sentence number) and sentences (start, end) of texts in one buffer.

    A sentence ends at a line break, after `.`, `!` or `?` before white space, at the end of its text, or after SENTENCE_WORDS words; it
    begins after the one before. A text that isn't empty has a sentence at least.
    """
    word = _WORD[data]
    edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    cut[1:-1] |= np.isin(data[:-1], list(b".!?")) & _BLANK[data[1:]]
    cut[1:] |= data == 10
    inner = cut[1:-1] & word[1:] & word[:-1]  # the end of a text between two letters
    start = np.sort(np.concatenate([np.flatnonzero(edge == 1), np.flatnonzero(inner) + 1]))
    end = np.sort(np.concatenate([np.flatnonzero(edge == -1), np.flatnonzero(inner) + 1]))
    sentence = np.cumsum(cut)[start] if len(start) else np.zeros(0, np.int64)
    first = np.concatenate([[True], sentence[1:] != sentence[:-1]]) if len(start) else np.zeros(0, bool)
    place = np.arange(len(start)) - np.maximum.accumulate(np.where(first, np.arange(len(start)), 0))
    cut[start[(place > 0) & (place % SENTENCE_WORDS == 0)]] = True
    cut[len(data)] = False
    begins = np.flatnonzero(cut)
    begins = begins[begins < len(data)]
    return start, end, np.searchsorted(begins, start, side="right") - 1, begins, np.append(begins[1:], len(data))


def features(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words and of their beginnings, and the number of the word that each belongs to."""
    hashes = RangeHash(data)
    made, owner = [hashes.of(start, end)], [np.arange(len(start))]
    for size in STEMS:
        longer = np.flatnonzero(end - start > size)
        made.append(mix(hashes.of(start[longer], start[longer] + size) + np.uint64(size)))
        owner.append(longer)
    return np.concatenate(made).view(np.int64), np.concatenate(owner)


def evidence(data: np.ndarray, offsets: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which known features (ordered hashes) stand in which sentence, each once, and where the sentences stand: sentence, feature,
    text number of each sentence, start, end."""
    start, end, sentence, begins, ends = cut_sentences(data, offsets)
    made, owner = features(data, start, end)
    at = np.searchsorted(known, made)
    hit = np.flatnonzero((at < len(known)) & (known[np.minimum(at, len(known) - 1)] == made)) if len(known) else np.zeros(0, np.int64)
    pairs = np.unique(sentence[owner[hit]] * (len(known) + 1) + at[hit])
    doc = np.searchsorted(offsets, begins, side="right") - 1
    return pairs // (len(known) + 1), pairs % (len(known) + 1), doc, begins, ends


@dataclass
class Model:
    """Known features, their weights, and the logit of a sentence without any."""

    known: np.ndarray
    weights: np.ndarray
    base: float

    def sentences(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Logit of each sentence, its text number, start and end."""
        own, feature, doc, begins, ends = evidence(data, offsets, self.known)
        return self.base + np.bincount(own, weights=self.weights[feature], minlength=len(begins)), doc, begins, ends


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def fit(known: np.ndarray, toxic: np.ndarray, plain: np.ndarray, doc: np.ndarray, sentence: np.ndarray, feature: np.ndarray) -> Model:
    """Weights by the likelihood of the documents' labels: a document is clean with the product of its sentences' chances to be.

    toxic: label of each document; plain: its sentences without evidence; doc: document of each sentence with evidence; sentence
    and feature: which features it has.
    """
    weights, base = np.zeros(len(known)), START
    if not len(toxic) or toxic.min() == toxic.max():  # nothing to learn from: every sentence as good as the next
        return Model(known, weights, START if not len(toxic) or not toxic.max() else -START)
    weights += 1.0
    first, second = np.zeros(len(known) + 1), np.zeros(len(known) + 1)
    n = len(toxic)
    for step in range(1, STEPS + 1):
        z = base + np.bincount(sentence, weights=weights[feature], minlength=len(doc))
        total = plain * softplus(base) + np.bincount(doc, weights=softplus(z), minlength=n)
        slope = np.where(toxic == 1, -1 / np.expm1(np.clip(total, 1e-9, 500)), 1.0) / n  # of the loss by the total
        back = slope[doc] / (1 + np.exp(-z))
        grad = np.bincount(feature, weights=back[sentence], minlength=len(known)) + DECAY / n * weights
        grad = np.append(grad, back.sum() + (slope * plain).sum() / (1 + np.exp(-base)))
        first += 0.1 * (grad - first)
        second += 0.001 * (grad * grad - second)
        move = RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-10)
        weights, base = weights - move[:-1], base - move[-1]
    return Model(known, weights, float(base))


def fold(doc: str | Column) -> Column:
    """crc32 of the id as text, modulo 5; remainder 0 is held out. A null id has a null fold and is not held out."""
    return F.crc32((F.col(doc) if isinstance(doc, str) else doc).cast("string").cast("binary")) % 5


def known_features(examples: DataFrame, n_toxic: int, n_clean: int) -> np.ndarray:
    """Hashes of the features that speak for label 1 most, by the documents of either label that hold them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, "text", 2 << 20):
            lowered, label = pc.utf8_lower(part.column("text")), part.column("y").to_numpy()
            data, offsets = utf8(lowered)
            start, end, *_ = cut_sentences(data, offsets)
            made, owner = features(data, start, end)
            doc = np.searchsorted(offsets, start, side="right")[owner] - 1
            order = np.lexsort((doc, made))
            made, doc = made[order], doc[order]
            fresh = np.concatenate([[True], (made[1:] != made[:-1]) | (doc[1:] != doc[:-1])])[: len(made)]
            made, doc = made[fresh], doc[fresh]
            first = np.flatnonzero(np.concatenate([[True], made[1:] != made[:-1]])[: len(made)])
            if len(first):
                toxic = np.add.reduceat(label[doc].astype(np.int64), first)
                yield pa.RecordBatch.from_arrays([pa.array(made[first]), pa.array(toxic), pa.array(np.diff(np.append(first, len(made))) - toxic)], ["feature", "toxic", "clean"])

    counts = examples.select("text", "y").mapInArrow(count, "feature long, toxic long, clean long")
    counts = counts.groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b")).where(F.col("a") >= MIN_TOXIC)
    term = lambda seen, expected: f"if({seen} = 0, 0D, {seen} * ln({seen} / ({expected})))"
    share = f"(a + b) / {float(n_toxic + n_clean)}"
    ratio = " + ".join([term("a", f"{share} * {n_toxic}D"), term("b", f"{share} * {n_clean}D"), term(f"({n_toxic} - a)", f"(1 - {share}) * {n_toxic}D"), term(f"({n_clean} - b)", f"(1 - {share}) * {n_clean}D")])
    best = counts.withColumn("ratio", F.expr(f"2 * ({ratio})")).where(f"ratio >= {MIN_RATIO} and a / {float(n_toxic)} > b / {float(n_clean)}")
    return np.sort(np.array([r["feature"] for r in best.orderBy(F.desc("ratio"), "feature").limit(FEATURES).collect()], np.int64))


def learn(examples: DataFrame) -> Model:
    """A model from examples of text and label y (0 or 1). The driver sees counts by label, FEATURES hashes at most, and of each example
    the numbers of the known features in its sentences, each different set once; sentences without any are only counted."""
    n = {r["y"]: r["n"] for r in examples.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    known = known_features(examples, n[1], n[0]) if n.get(0) and n.get(1) else np.zeros(0, np.int64)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, "text", 2 << 20):
            own, feature, doc, begins, _ = evidence(*utf8(pc.utf8_lower(part.column("text"))), known)
            total = np.bincount(doc, minlength=part.num_rows)
            sets: list[dict[tuple[int, ...], None]] = [{} for _ in range(part.num_rows)]
            plain = total.copy()
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])[: len(own)])
            for low, high in zip(first.tolist(), np.append(first[1:], len(own)).tolist() if len(first) else []):
                text = int(doc[own[low]])
                sets[text][tuple(feature[low:high].tolist())] = None
                plain[text] -= 1
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("y"), pa.array(plain), pa.array([[list(x) for x in s] for s in sets], pa.list_(pa.list_(pa.int32())))], ["id", "y", "plain", "sets"])

    rows = examples.select("id", "text", "y").mapInArrow(bags, f"id {examples.schema['id'].dataType.simpleString()}, y int, plain long, sets array<array<int>>")
    rows = sorted(rows.collect(), key=str)  # the same order however tasks finish
    doc = [k for k, r in enumerate(rows) for _ in r["sets"]]
    sets = [x for r in rows for x in r["sets"]]
    feature = np.array([f for x in sets for f in x], np.int64)
    sentence = np.repeat(np.arange(len(sets)), [len(x) for x in sets]) if sets else np.zeros(0, np.int64)
    return fit(known, np.array([r["y"] for r in rows], np.int64), np.array([r["plain"] for r in rows], float), np.array(doc, np.int64), sentence, feature)


def score_toxicity(docs: DataFrame, labels: DataFrame, corpus: DataFrame | None = None, doc: str = "doc_id", text: str = "text", toxic: str = "toxic", train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """All rows of docs with held_out, score (probability that a sentence is toxic), predicted (1 from the threshold on) and
    offending: start, end (code points) and score of the sentences that reach the threshold by themselves, in order.

    A sentence's logit is the sum of the weights of the words and word beginnings in it, a document's score the noisy-or of its
    sentences. Learnt from at most `train_rows` labelled texts of the corpus (by default docs) outside the held-out fold, those with the
    least hash of their id. Scoring is one pass without a shuffle; only the text enters a score.

    Null and empty texts have no sentence and score 0; rows with a null id are scored, never learnt from. Rows that repeat in text and
    label are one example, null labels are left out; without labels of both kinds nothing is learnt and all sentences score
    alike. Texts of any length are read whole; an empty table gives no rows; the new columns replace columns of the same names.
    """
    spark = docs.sparkSession
    corpus = docs if corpus is None else corpus
    taught = labels.select(F.col(doc).alias("id"), F.col(toxic).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("id").isNotNull() & (fold("id") != 0)).distinct()
    taught = spark.createDataFrame(taught.orderBy(F.xxhash64("id"), "id", "y").limit(train_rows).collect(), taught.schema)
    examples = corpus.select(F.col(doc).alias("id"), text_of(text).alias("text")).join(F.broadcast(taught), "id")
    # copies are one example; ids that repeat with other texts may be so many that the bound holds here again
    examples = examples.groupBy(F.xxhash64("text").alias("tie"), "y").agg(F.min_by(F.struct("id", "text"), "id").alias("e"))
    examples = examples.select("e.id", "e.text", "y").orderBy(F.xxhash64("id"), "id", "y").limit(train_rows)
    model = learn(materialize(examples))
    shared = spark.sparkContext.broadcast(model)
    kept = docs.drop("held_out", "score", "predicted", "offending")
    wanted = kept.selectExpr("*", "0D as score", "cast(null as array<struct<start:long,end:long,score:double>>) as offending")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in steps(batches, text, 1 << 20):
            data, offsets = utf8(pc.utf8_lower(part.column(text)))
            z, owner, begins, ends = model.sentences(data, offsets)
            total = np.bincount(owner, weights=softplus(z), minlength=part.num_rows)
            made = np.round(-np.expm1(-total), 12)  # equal texts score alike, whatever stands around them
            point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            p = np.round(1 / (1 + np.exp(-np.clip(z, -500, 500))), 12)
            bad = np.flatnonzero(p >= threshold)
            base = point[offsets[owner[bad]]]
            spans = pa.StructArray.from_arrays([pa.array(point[begins[bad]] - base), pa.array(point[ends[bad]] - base), pa.array(p[bad])], ["start", "end", "score"])
            found = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner[bad], np.arange(part.num_rows + 1)), pa.int32()), spans)
            yield pa.RecordBatch.from_arrays([*part.columns[:-2], pa.array(made), found], part.schema.names)

    out = wanted.mapInArrow(score, wanted.schema)
    return out.withColumn("held_out", F.coalesce(fold(doc) == 0, F.lit(False))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
