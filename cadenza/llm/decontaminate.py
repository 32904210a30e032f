"""Benchmark decontamination by an FM-index of every training shard."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import KEPT, covered, materialize, runs, steps, text_of
from cadenza.llm.fm_index import FMIndex

WINDOW = 10
#: Benchmark text that one pass over the documents searches for (some 100 MB in a worker); a larger benchmark takes more passes.
BLOCK_CHARS = 16_000_000
#: Tokens of one shard's index; a longer text is a shard of its own.
SHARD_TOKENS = 1 << 20

#: Bytes that belong to words, A-Z to lower case, all others to a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def words_of(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8: runs of 0-9, a-z (A-Z folded) and everything beyond ASCII."""
    return (text or "").encode().translate(_FOLD).split()


class Phrases:
    """The windows of a block of items: numbers of all words in a row, where each different window starts in it and how long it is, and
    the items that it stands for; about 25 bytes a word, and the vocabulary."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW) -> None:
        vocabulary: dict[bytes, int] = {}
        texts = [np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)], np.int32) for _, text in items]
        self.words, self.names = list(vocabulary), [item for item, _ in items]
        size = np.array([len(t) for t in texts], np.int64)
        self.flat = np.concatenate([*texts, np.zeros(window, np.int32)])
        n = np.where(size > 0, np.maximum(1, size - window + 1), 0)
        item = np.repeat(np.arange(len(items)), n)
        start = np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(np.cumsum(size) - size, n)
        length = np.minimum(size[item], window)
        rows = np.where(np.arange(window) < length[:, None], self.flat[start[:, None] + np.arange(window)], 0).astype(np.int32)
        _, first, which = np.unique(rows.view(np.dtype((np.void, 4 * window))).ravel(), return_index=True, return_inverse=True) if len(rows) else [np.zeros(0, np.int64)] * 3
        self.starts, self.lengths = start[first].astype(np.int32), length[first].astype(np.int32)
        pairs = np.unique(which * np.int64(len(items)) + item)
        self.owner = (pairs % max(1, len(items))).astype(np.int32)
        self.owned = np.searchsorted(pairs, np.arange(len(first) + 1) * np.int64(len(items))).astype(np.int32)
        self.shortest = int(self.lengths.min(initial=window))

    def numbers(self) -> dict[bytes, int]:
        """The number of each word of the vocabulary; made where it is used, so that only the words travel."""
        return {w: k + 1 for k, w in enumerate(self.words)}

    def find(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start of every occurrence in a sequence where 0 stands for other words and for borders, and its window."""
        start, end = runs(tokens > 0)
        fits = end - start >= self.shortest  # a shorter run of benchmark words can't hold a window
        start, end = start[fits], end[fits]
        if not len(start):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        size = end - start + 1  # with a border after each
        to = np.concatenate([[0], np.cumsum(size)])
        source = np.arange(to[-1]) - np.repeat(to[:-1] - start, size)
        text = np.where(source < np.repeat(end, size), tokens[np.minimum(source, len(tokens) - 1)], 0)
        index = FMIndex(text, len(self.words) + 1)
        low, high = index.search(self.flat, self.starts, self.lengths)
        count = high - low
        which = np.repeat(np.arange(len(low)), count)
        rows = np.arange(len(which)) - np.repeat(np.cumsum(count) - count - low, count)
        return source[index.locate(rows)], which


def _search(texts: list[str | None], phrases: Phrases, numbers: dict[bytes, int]) -> Iterator[tuple[int, list[tuple[int, int]], list[str]]]:
    """Per text: number of words, hit word ranges, items found."""
    look = numbers.get

    def shard(parts: list[list[int]]) -> Iterator[tuple[int, list[tuple[int, int]], list[str]]]:
        offsets = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
        tokens = np.fromiter((x for p in parts for x in (*p, 0)), np.int64, int(offsets[-1]))
        at, which = phrases.find(tokens)
        hit = covered(len(tokens), at, phrases.lengths[which])
        start, end = runs(hit)
        span_doc = np.searchsorted(offsets, start, side="right") - 1
        found: dict[int, set[str]] = {}
        n = len(phrases.starts)
        for pair in np.unique((np.searchsorted(offsets, at, side="right") - 1) * n + which).tolist():
            own = phrases.owner[phrases.owned[pair % n] : phrases.owned[pair % n + 1]]
            found.setdefault(pair // n, set()).update(phrases.names[k] for k in own.tolist())
        spans: dict[int, list[tuple[int, int]]] = {}
        for d, s, e in zip(span_doc.tolist(), start.tolist(), end.tolist()):
            spans.setdefault(d, []).append((s - int(offsets[d]), e - int(offsets[d])))
        for d, part in enumerate(parts):
            yield len(part), spans.get(d, []), sorted(found.get(d, ()))

    parts: list[list[int]] = []
    held = 0
    for text in texts:
        words = words_of(text)
        parts.append(list(map(look, words, repeat(0))))
        held += len(words) + 1
        if held >= SHARD_TOKENS:
            yield from shard(parts)
            parts, held = [], 0
    if parts:
        yield from shard(parts)


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS, remove: bool = False) -> DataFrame:
    """Every row of docs with n_words, hit_spans (word ranges covered by benchmark windows, merged) and hit_items.

    A window is `window` consecutive words of an item, or a shorter item whole. Each task cuts its rows into shards, builds
    an FM-index of a shard (runs of words that no item has are collapsed to a border, which no window can cross), searches
    all windows backwards through wavelet-tree ranks and locates the occurrences by sampled suffix positions. The documents
    are read once for each block of the benchmark, without a shuffle; only a block of bounded size goes to the tasks, as arrays.

    With `remove`, the hit words are cut out of the text in the same pass, as remove_spans does it.
    The new columns replace columns of the same names. Null texts have no words; null item ids are named by an empty
    string; repeated items and rows are allowed; an empty benchmark finds nothing; an empty table gives no rows.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(item_text).alias("text"))
    total = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-int(total) // block_chars))
    rows = docs.drop("n_words", "hit_spans", "hit_items")
    rows = rows.selectExpr("*", "0L as n_words", "cast(array() as array<struct<start:int,end:int>>) as hit_spans", "cast(array() as array<string>) as hit_items")
    schema = rows.schema
    for block in range(blocks):
        here = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block) if blocks > 1 else items
        shared = spark.sparkContext.broadcast(Phrases([(r["item"], r["text"]) for r in here.distinct().collect()], window))
        name = f"phrases {uuid.uuid4()}"

        def search(batches: Iterator[pa.RecordBatch], shared=shared, name=name, last=block == blocks - 1) -> Iterator[pa.RecordBatch]:
            phrases = shared.value
            for part in steps(batches, text, 16 << 20, keep=name):
                numbers = KEPT.get(name) or KEPT.setdefault(name, phrases.numbers())
                names = part.schema.names
                before = part.column(names.index("hit_spans")).to_pylist()
                known = part.column(names.index("hit_items")).to_pylist()
                texts = part.column(names.index(text)).to_pylist()
                found = list(_search(texts, phrases, numbers))
                spans = [_merge([(s["start"], s["end"]) for s in old] + new) for old, (_, new, _) in zip(before, found)]
                columns = dict(zip(names, part.columns))
                columns["n_words"] = pa.array([n for n, _, _ in found], pa.int64())
                columns["hit_spans"] = pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], _SPAN)
                columns["hit_items"] = pa.array([sorted({*old, *new}) for old, (_, _, new) in zip(known, found)], pa.list_(pa.string()))
                if remove and last:
                    columns[text] = pa.array([_without(t, x) for t, x in zip(texts, spans)], part.schema.field(text).type)
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

        rows = rows.mapInArrow(search, schema)
        if block < blocks - 1:
            rows = materialize(rows)  # only one block's phrases are in a worker at a time
    return rows


def _without(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without word ranges: from the first byte of a range's first word to the last byte of its last."""
    if not spans:
        return text
    raw = (text or "").encode()
    places = [m.span() for m in _WORD.finditer(raw.translate(_FOLD))]
    pieces, at = [], 0
    for start, end in spans:
        pieces.append(raw[at : places[start][0]])
        at = places[end - 1][1]
    return b"".join([*pieces, raw[at:]]).decode()


def remove_spans(found: DataFrame, text: str = "text") -> DataFrame:
    """The rows of find_contamination with the hit words cut out of the text, from the first byte of a span's first word to the
    last byte of its last; what stands between words around a cut stays. Texts without a hit, null ones too, stay as they are."""
    rows = found.drop("n_words", "hit_items")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            names = part.schema.names
            out = [_without(t, [(x["start"], x["end"]) for x in spans]) for t, spans in zip(part.column(names.index(text)).to_pylist(), part.column(names.index("hit_spans")).to_pylist())]
            columns = dict(zip(names, part.columns))
            columns[text] = pa.array(out, part.schema.field(text).type)
            del columns["hit_spans"]
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return rows.mapInArrow(cut, rows.drop("hit_spans").schema)


def contamination_digest(found: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256 and contaminated."""
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda total, s: total + (s["end"] - s["start"]))
    return found.select(
        F.col(doc).alias("doc_id"),
        "n_words",
        hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )
