"""Repetition rules: how much of a text lies inside repeated word n-grams and repeated lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import RangeHash, covered, mix, repeated, runs, steps, text_of, utf8

#: Largest share of word characters inside later occurrences of n-grams of each length, and of repeated lines.
MAX_NGRAM_SHARE = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
MAX_LINE_SHARE = 0.20
MIN_WORDS, REPEAT_WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

_SCHEMA = "doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, line_chars long, ngram_chars array<long>"


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _rolling(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive word hashes."""
    size = max(0, len(words) - n + 1)
    out = np.zeros(size, np.uint64)
    for j in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[j : j + size]
    return mix(out)


def measure(data: np.ndarray, offsets: np.ndarray, lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    """Counts of every text in one buffer. Texts never mix: each hash carries the number of its text."""
    n_docs = len(offsets) - 1
    letter = ~_SPACE[data]
    inner = np.zeros(len(data), bool)  # a text's first byte starts a word whatever stands before it
    inner[1:] = letter[1:] & letter[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    inner[first] = False
    starts = np.flatnonzero(letter & ~inner)
    stops = letter.copy()
    stops[:-1] &= ~inner[1:]
    ends = np.flatnonzero(stops) + 1
    doc = np.searchsorted(offsets, starts, side="right") - 1
    hashes = RangeHash(data)
    words = hashes.of(starts, ends)
    point = letter & ((data & 0xC0) != 0x80)
    before = np.concatenate([[0], np.cumsum(point, dtype=np.int64)])
    chars = before[ends] - before[starts]
    out = {"n_words": np.bincount(doc, minlength=n_docs), "word_chars": _sums(point, offsets), "n_symbols": _sums(_SYMBOL[data], offsets)}

    # lines
    breaks = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    line_doc = np.searchsorted(offsets, line_start, side="right") - 1
    keep = line_start < len(data)
    line_start, line_doc = line_start[keep], line_doc[keep]
    line_end = np.minimum(np.concatenate([line_start[1:], [len(data)]]), offsets[line_doc + 1])
    line_end = line_end - ((line_end > line_start) & (data[np.maximum(line_end, 1) - 1] == 10))
    any_word = before[line_end] > before[line_start]
    line_start, line_end, line_doc = line_start[any_word], line_end[any_word], line_doc[any_word]
    _, later = repeated(hashes.of(line_start, line_end) ^ mix(line_doc.astype(np.uint64)))
    out["n_dup_lines"] = np.bincount(line_doc[later], minlength=n_docs)
    out["line_chars"] = np.bincount(line_doc[later], weights=(before[line_end] - before[line_start])[later], minlength=n_docs).astype(np.int64)

    # n-grams, shortest first: only places whose shorter n-gram is repeated can hold a repeated longer one
    salt = mix(doc.astype(np.uint64) + np.uint64(1))
    out["n_repeat_words"] = np.zeros(n_docs, np.int64)
    shares = np.zeros((n_docs, len(lengths)), np.int64)
    places = np.arange(len(words))
    for n in sorted({*lengths, REPEAT_WINDOW}):
        places = places[places + n <= len(words)]
        places = places[doc[places] == doc[places + n - 1]]
        keys = _rolling(words, n)[places] ^ salt[places]
        multiple, later = repeated(keys)
        if n == REPEAT_WINDOW:
            hit = covered(len(words), places[multiple], n)
            out["n_repeat_words"] = np.bincount(doc[hit], minlength=n_docs)
        if n in lengths:
            hit = covered(len(words), places[later], n)
            shares[:, lengths.index(n)] = np.bincount(doc[hit], weights=chars[hit], minlength=n_docs).astype(np.int64)
        places = places[multiple]
    out["ngram_chars"] = shares
    return out


def repetition_rules(docs: DataFrame, max_ngram_share: dict[int, float] | None = None, max_line_share: float = MAX_LINE_SHARE, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and verdict for every text, in one pass without a shuffle.

    Words are runs of bytes other than space and 0x09-0x0D. base_failed: under 20 words, or over 30 % of the words in
    8-word windows that occur twice or more. kept: base holds and no n-gram length has more than its share of word
    characters inside later occurrences, nor repeated lines theirs. Returns doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept, line_share and ngram_shares (in the order of the lengths).

    Null counts as an empty text, which fails the base; a text of any length is measured whole. Repeated rows are measured
    each; null ids stay null; an empty table gives no rows; other columns are ignored.
    """
    limits = dict(sorted((MAX_NGRAM_SHARE if max_ngram_share is None else max_ngram_share).items()))
    lengths = tuple(limits)
    rows = docs.select(F.col(doc).alias("doc_id"), text_of(text).alias("text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_chars"]

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, "text"):
            got = measure(*utf8(part.column("text")), lengths)
            shares = got["ngram_chars"]
            listed = pa.ListArray.from_arrays(pa.array(np.arange(0, shares.size + 1, max(1, len(lengths))) if lengths else np.zeros(part.num_rows + 1), pa.int32()), pa.array(shares.ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(got[k], pa.int64()) for k in names), listed], ["doc_id", *names, "ngram_chars"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    measured = rows.mapInArrow(counts, _SCHEMA.format(kind=kind))
    whole = F.greatest(F.col("word_chars"), F.lit(1))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    shares = F.transform("ngram_chars", lambda x: x / whole)
    over = F.exists(F.arrays_zip(F.col("ngram_shares").alias("share"), F.array(*(F.lit(float(x)) for x in limits.values())).cast("array<double>").alias("most")), lambda x: x["share"] > x["most"])
    out = measured.withColumn("line_share", F.col("line_chars") / whole).withColumn("ngram_shares", shares).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("line_share") <= max_line_share) & ~over).select("doc_id", *names[:5], "base_failed", "kept", "line_share", "ngram_shares")
