"""Packing of tokenised documents into sequences of one length by cutting-stock column generation."""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import KEPT, materialize, steps, text_of
from cadenza.llm.cutting_stock import plan

SEQUENCE = 4096
#: Remainders of documents are cut at multiples of this; what is shorter packs by itself.
UNIT = 32
END_TOKEN = 2
#: Entries that a worker's memo of encoded chunks may hold (about 200 bytes each) before it starts anew.
MEMO_ENTRIES = 1_000_000


class WordEncoder:
    """Token ids of texts, remembered by space-separated chunk.

    The tokenizer drops white space and no token spans it, so a text's ids are its chunks' ids in a row.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo: dict[str, bytes] = {"": b""}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.memo) > MEMO_ENTRIES:
            self.memo = {"": b""}
        chunks = [t.replace("\n", " ").split(" ") for t in texts]
        new = [c for c in {c for cs in chunks for c in cs} if c not in self.memo]
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            for chunk, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                self.memo[chunk] = array("I", e.ids).tobytes()
        ids = self.memo.__getitem__
        return [b"".join(map(ids, cs)) for cs in chunks]


def encoder_for(path: str) -> WordEncoder:
    """The worker's encoder, kept from task to task until another operator runs there."""
    if not isinstance(kept := KEPT.get(path), WordEncoder):
        kept = KEPT[path] = WordEncoder(path)
    return kept


def cut_lengths(n: int, sequence: int = SEQUENCE, unit: int = UNIT) -> list[int]:
    """Whole sequences, then a multiple of the unit, then the rest."""
    rest = n % sequence
    return [sequence] * (n // sequence) + [x for x in (rest - rest % unit, rest % unit) if x]


def tokenize_and_cut(docs: DataFrame, tokenizer: str, doc: str = "doc_id", text: str = "text", sequence: int = SEQUENCE, unit: int = UNIT, end_token: int = END_TOKEN, with_ids: bool = False) -> DataFrame:
    """Pieces of every document's ids: doc_id, start, length, ids_crc32, doc_tokens, part and rank (the piece's number among
    those of its length that its task wrote), and the ids themselves if wanted."""
    rows = docs.select(F.col(doc).alias("doc_id"), text_of(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "rank", *["ids"] * with_ids]
    end = np.array([end_token], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, made, part = encoder_for(tokenizer), np.zeros(sequence + 1, np.int64), TaskContext.get().partitionId()
        for rows in steps(batches, "text", 2 << 20, keep=tokenizer):
            out: list[tuple[int, ...]] = []
            cuts: list[bytes] = []
            for row, raw in enumerate(encoder.encode(rows.column("text").to_pylist())):
                raw += end
                start = 0
                for length in cut_lengths(len(raw) // 4, sequence, unit):
                    piece = raw[4 * start : 4 * (start + length)]
                    out.append((row, start, length, zlib.crc32(piece), len(raw) // 4, part, int(made[length])))
                    made[length] += 1
                    start += length
                    if with_ids:
                        cuts.append(piece)
            table = np.array(out, np.int64)
            ids = [rows.column("doc_id").take(pa.array(table[:, 0]))]
            more = [pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in cuts], pa.list_(pa.int32()))] if with_ids else []
            yield pa.RecordBatch.from_arrays([*ids, *(pa.array(np.ascontiguousarray(table[:, k])) for k in range(1, 7)), *more], names)

    return rows.mapInArrow(pieces, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names[1:7]) + ", ids array<int>" * with_ids)


def pack(docs: DataFrame, tokenizer: str, doc: str = "doc_id", text: str = "text", sequence: int = SEQUENCE, unit: int = UNIT, end_token: int = END_TOKEN, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence_id and offset; each id lies in exactly one piece, sequences have no gaps.

    The driver sees the histogram of piece lengths only (at most `sequence` numbers) and solves the cutting-stock program
    on it. Pieces of one length are ranked by adding each task's base to the rank inside the task, so that no length's pieces
    meet in one place; a rank then falls into one use of one pattern, looked up in a table that the lengths bound.
    Lengths are exact, so a sequence is padded only where its pattern falls short: in the few left over by rounding.

    Null counts as an empty text, which is one end token; repeated rows are packed each; an empty table gives no pieces.
    The pieces are written once to the shared checkpoint folder, so that ranks can't change when a task runs again.
    """
    pieces = materialize(tokenize_and_cut(docs, tokenizer, doc, text, sequence, unit, end_token, with_ids))
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("part", "length", F.coalesce(upto, F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places, used, next_sequence = [], dict.fromkeys(histogram, 0), 0
    for pattern, times in plan(histogram, sequence, unit):
        offset = 0
        for length, n in sorted(pattern.items(), reverse=True):
            places.append((length, used[length], used[length] + n * times, n, next_sequence, offset))
            used[length] += n * times
            offset += n * length
        next_sequence += times
    shape = "length long, from_rank long, to_rank long, per long, first_sequence long, first_offset long"
    lookup = docs.sparkSession.createDataFrame(places, shape)
    ranked = pieces.join(base, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("base"))
    placed = ranked.join(F.broadcast(lookup), "length").where("rank >= from_rank and rank < to_rank")
    within = F.col("rank") - F.col("from_rank")
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("first_sequence") + F.expr("(rank - from_rank) div per")).alias("sequence_id"),
        (F.col("first_offset") + within % F.col("per") * F.col("length")).alias("offset"),
        *["ids"] * with_ids,
    )
