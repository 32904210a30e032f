"""Removal of long byte strings that stand earlier in the corpus too, by run-length indexes of suspicious passages."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import RangeHash, materialize, mix, runs, steps, text_of, utf8
from cadenza.llm.r_index import repeated_windows

#: Bytes of a window, and of the gram that anchors it: long enough that unrelated texts seldom share one.
WINDOW, GRAM = 100, 48
#: Different passages around one anchor that go into one index; where there are more, each window is looked for by its hash.
INDEX_PASSAGES = 20_000
#: An anchor is hot if it has more than one in so many of all passages; so there are never more than so many hot ones.
HOT_SHARE = 2000
#: One in so many documents is looked at to find the hot anchors, which only decides how their passages travel.
HOT_SAMPLE, HOT_LEAST = 64, 50
#: Bytes that one index holds, but for a single anchor's passages.
INDEX_BYTES = 2 << 20
STEP = 1 << 20

#: What a travelling row is: a passage, a single window, or a range that is known to be repeated.
PASSAGE, SINGLE, REPEATED = 0, 1, 2


def anchors(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Content-defined cut of all windows into passages: neighbouring windows whose least gram hash is the same gram.

    The choice depends on a window's own bytes only (least 32-bit hash, leftmost on ties), so equal windows have equal anchors
    at equal distances, wherever they stand. Gives, per passage: text number, anchor hash, first window, number of windows and
    a hash of the passage's bytes.
    """
    n = len(data)
    empty = {k: np.zeros(0, np.int64) for k in ("doc", "anchor", "at", "n", "passage")}
    if n < window:
        return empty
    hashes = RangeHash(data)
    size = n - gram + 1
    grams = mix((hashes.sums[gram:] - hashes.sums[:size]) * hashes.back[:size])
    packed = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(size, dtype=np.uint64)
    reach, least = 1, packed
    width = window - gram + 1
    while reach < width:
        step = min(reach, width - reach)
        least = np.minimum(least[:-step], least[step:])
        reach += step
    start = np.arange(n - window + 1)
    doc = np.searchsorted(offsets, start, side="right") - 1
    whole = start + window <= offsets[doc + 1]
    start, doc, anchor = start[whole], doc[whole], (least[whole] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    if not len(start):
        return empty
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]))
    count = np.diff(np.concatenate([first, [len(start)]]))
    at = start[first]
    return {"doc": doc[first], "anchor": grams[anchor[first]].view(np.int64), "at": at - offsets[doc[first]], "n": count, "passage": hashes.of(at, at + count - 1 + window).view(np.int64)}


def _windows_of(hashes: RangeHash, begin: np.ndarray, n: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of passages of n windows that begin at `begin`: which passage, how far into it, and two independent hashes each."""
    which = np.repeat(np.arange(len(n)), n)
    into = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    at = begin[which] + into
    one = hashes.of(at, at + window)
    two = mix(hashes.of(at, at + window // 2) ^ (one << np.uint64(1)))
    return which, into, np.stack([one.view(np.int64), two.view(np.int64)], axis=1)


def _document_order(part: pa.RecordBatch) -> np.ndarray:
    """Rank of each row's document by (doc, tie), nulls first."""
    doc, tie = part.column("doc").to_pylist(), part.column("tie").to_pylist()
    rank = np.empty(len(doc), np.int64)
    rank[sorted(range(len(doc)), key=lambda k: (doc[k] is not None, doc[k], tie[k]))] = np.arange(len(doc))
    return rank


_ROW = ["anchor", "passage", "doc", "tie", "place"]


def _travelling(part: pa.RecordBatch, row: np.ndarray, anchor: np.ndarray, passage: np.ndarray, at: np.ndarray, n: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
    """Rows for the shuffle: of equal passages of this step, only the earliest is still a passage; the others are repeated, and
    travel by a random key. So a passage that is everywhere sends one row a step to its place."""
    rank = _document_order(part)
    order = np.lexsort((at, rank[row], passage, anchor))
    a, p = anchor[order], passage[order]
    later = np.zeros(len(order), bool)
    later[order[1:]] = (a[1:] == a[:-1]) & (p[1:] == p[:-1])
    kind = np.where(later, REPEATED, kind)
    scattered = mix(passage.view(np.uint64) ^ mix(np.arange(len(row), dtype=np.uint64) + np.uint64(1))).view(np.int64)
    owner = pa.array(row)
    columns = [pa.array(np.where(later, scattered, anchor)), pa.array(passage), part.column("doc").take(owner), part.column("tie").take(owner), pa.array(at << 10 | kind << 8 | n)]
    return pa.RecordBatch.from_arrays(columns, _ROW)


def _met(rows: DataFrame, window: int) -> DataFrame:
    """What comes out where rows of one anchor meet: doc, tie, start, end of repeated ranges (anchor null), or passages around an
    anchor that has several different ones (anchor, and end null; apart: very many).

    Rows stream by in order; of an anchor only its different passages are held, `INDEX_PASSAGES` of them at most.
    """
    kind = rows.schema["doc"].dataType.simpleString()
    names = ["doc", "tie", "start", "end", "anchor", "apart"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # different passages of the anchor that was read last
        many = False  # they are too many, and all but the last have been passed on

        def out(rows: pa.RecordBatch, which: np.ndarray, place: np.ndarray, repeated: bool, apart: np.ndarray | bool = False) -> pa.RecordBatch:
            chosen, place = pa.array(which), place[which]
            start, count = place >> 10, place & 255
            end = pa.array(start + count + window - 1) if repeated else pa.array(count)
            anchor = pa.nulls(len(which), pa.int64()) if repeated else rows.column("anchor").take(chosen)
            return pa.RecordBatch.from_arrays([rows.column("doc").take(chosen), rows.column("tie").take(chosen), pa.array(start), end, anchor, pa.array(np.broadcast_to(apart, len(which)))], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches(max_chunksize=held.num_rows + batch.num_rows)[0]
            before = 0 if held is None else held.num_rows
            anchor, passage, place = (rows.column(c).to_numpy() for c in ("anchor", "passage", "place"))
            what = place >> 8 & 3
            same_anchor = np.concatenate([[False], anchor[1:] == anchor[:-1]])
            same = same_anchor & np.concatenate([[False], passage[1:] == passage[:-1]]) & (what < REPEATED)
            known = np.flatnonzero((what == REPEATED) | same)
            if len(known):
                yield out(rows, known, place, True)
            heads = np.flatnonzero(~same & (what < REPEATED))
            # a scattered range can only stand between two anchors if it has the same key as one of them, so heads of an anchor are neighbours
            number = np.concatenate([[0], np.cumsum(anchor[heads][1:] != anchor[heads][:-1])]) if len(heads) else heads
            size = np.bincount(number) if len(heads) else heads
            last = number == number[-1] if len(heads) else np.zeros(0, bool)
            apart = size[number] > INDEX_PASSAGES if len(heads) else last
            if many and len(heads):
                apart |= number == 0
            suspect = (what[heads] == PASSAGE) & ((size[number] > 1) | apart) & (~last | apart)
            if many:
                suspect &= heads >= before  # what was held has been passed on
            if suspect.any():
                yield out(rows, heads[suspect], place, False, apart[suspect])
            many = bool(len(heads) and apart[-1])
            keep = heads[last][-1:] if many else heads[last]
            held = rows.take(pa.array(keep)) if len(keep) else None
        if held is not None and held.num_rows > 1:
            place = held.column("place").to_numpy()
            yield out(held, np.flatnonzero((place >> 8 & 3) == PASSAGE), place, False)

    ordered = rows.repartition("anchor").sortWithinPartitions(*_ROW)
    return ordered.mapInArrow(walk, f"doc {kind}, tie long, start long, end long, anchor long, apart boolean")


def hot_anchors(spark: SparkSession, texts: DataFrame, window: int = WINDOW) -> np.ndarray:
    """Anchors with more than one in HOT_SHARE of the passages of one in HOT_SAMPLE documents: HOT_SHARE at most. One that isn't
    noticed only travels as any other."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, "text", STEP):
            found, n = np.unique(anchors(*utf8(part.column("text")), window)["anchor"], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["anchor", "n"])

    part = texts.where(F.pmod(F.xxhash64("doc", "tie", F.lit(7)), F.lit(HOT_SAMPLE)) == 0).select("text")
    counts = part.mapInArrow(cut, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") >= 2)
    counts = materialize(counts)
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    rows = counts.where((F.col("n") >= HOT_LEAST) & (F.col("n") * HOT_SHARE > total)).select("anchor").collect()
    return np.sort(np.array([r["anchor"] for r in rows], np.int64))


def repeated_ranges(docs: DataFrame, doc: str = "doc_id", text: str = "text", window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The keyed documents (doc, tie, text) and, for them, byte ranges covered by windows that start earlier too (doc, tie, start, end).

    1. Every text is cut into passages around content-defined anchors, which meet by their anchor in one shuffle. Passages that are
       equal as a whole are repeated but for the earliest; most are found so in the step that cuts them.
    2. Anchors with several different passages: the earliest copies of these go to run-length indexes, through which later ones are
       streamed; matching statistics of a window's length mark what is repeated.
    3. Anchors that hold more than one in HOT_SHARE of all passages are taken apart into windows before the shuffle, and those with
       more than INDEX_PASSAGES different passages after it. Equal windows of a step travel as one, so no group has to fit
       into one task, and a hot one isn't dealt to one.
    """
    rows = docs.select(F.col(doc).alias("doc"), text_of(text).alias("text"))
    single = rows.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    rows = rows.withColumn("tie", F.lit(0).cast("long") if single else F.xxhash64("text"))
    kind = rows.schema["doc"].dataType.simpleString()
    unique = (rows if single else rows.dropDuplicates(["doc", "tie"])).select("doc", "tie", "text")
    hot = hot_anchors(docs.sparkSession, unique, window)
    shape = f"anchor long, passage long, doc {kind}, tie long, place long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, "text", STEP):
            data, offsets = utf8(part.column("text"))
            got = anchors(data, offsets, window)
            if not len(got["doc"]):
                continue
            row, anchor, passage, at, n = (got[c] for c in ("doc", "anchor", "passage", "at", "n"))
            taken = np.isin(anchor, hot)
            if taken.any():
                which, into, key = _windows_of(RangeHash(data), (offsets[row] + at)[taken], n[taken], window)
                rest = ~taken
                row, at = np.concatenate([row[rest], row[taken][which]]), np.concatenate([at[rest], at[taken][which] + into])
                anchor, passage = np.concatenate([anchor[rest], key[:, 0]]), np.concatenate([passage[rest], key[:, 1]])
                kinds = np.concatenate([np.full(rest.sum(), PASSAGE), np.full(len(which), SINGLE)])
                n = np.concatenate([n[rest], np.ones(len(which), np.int64)])
            else:
                kinds = np.full(len(row), PASSAGE)
            yield _travelling(part, row, anchor, passage, at, n, kinds)

    met = materialize(_met(unique.mapInArrow(cut, shape), window))
    ranges = met.where("anchor is null").select("doc", "tie", "start", "end")
    suspects = met.where("anchor is not null").select("doc", "tie", F.struct("anchor", "start", F.col("end").alias("n"), "apart").alias("w"))
    wanted = suspects.groupBy("doc", "tie").agg(F.collect_list("w").alias("wanted"))
    texts = unique.join(wanted.select(F.col("doc").alias("d"), F.col("tie").alias("t"), "wanted"), F.col("doc").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("t"))).select("doc", "tie", "text", "wanted")

    def wishes(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        lists = part.column("wanted")
        flat = lists.flatten()
        row = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
        return row, *(flat.field(c).to_numpy(zero_copy_only=False) for c in ("anchor", "start", "n", "apart"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, "text", STEP):
            data, offsets = utf8(part.column("text"))
            row, anchor, start, n, apart = wishes(part)
            row, anchor, start, n = (x[~apart] for x in (row, anchor, start, n))
            begin = offsets[row] + start
            raw = [data[b:e].tobytes() for b, e in zip(begin.tolist(), (begin + n - 1 + window).tolist())]
            owner = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), part.column("doc").take(owner), part.column("tie").take(owner), pa.array(start), pa.array(raw, pa.binary())], ["anchor", "doc", "tie", "start", "bytes"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, "text", STEP):
            data, offsets = utf8(part.column("text"))
            row, _, start, n, apart = wishes(part)
            row, start, n = (x[apart] for x in (row, start, n))
            if len(row):
                which, into, key = _windows_of(RangeHash(data), offsets[row] + start, n, window)
                one = np.ones(len(which), np.int64)
                yield _travelling(part, row[which], key[:, 0], key[:, 1], start[which] + into, one, one * SINGLE)

    fetched = texts.mapInArrow(fetch, f"anchor long, doc {kind}, tie long, start long, bytes binary")
    span = f"doc {kind}, tie long, start long, end long"

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def found() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=sum(b.num_rows for b in held))[0]
            strings = [np.frombuffer(b, np.uint8) for b in rows.column("bytes").to_pylist()]
            flags = repeated_windows(strings, rows.column("anchor").to_numpy(), window)
            row, start, end = [], [], []
            for k in [k for k, f in enumerate(flags) if f.any()]:
                s, e = runs(flags[k])
                row += [k] * len(s)
                start += s.tolist()
                end += (e - 1 + window).tolist()
            owner, base = pa.array(row, pa.int64()), rows.column("start").to_numpy()[row]
            return pa.RecordBatch.from_arrays([rows.column("doc").take(owner), rows.column("tie").take(owner), pa.array(base + np.array(start, np.int64)), pa.array(base + np.array(end, np.int64))], ["doc", "tie", "start", "end"])

        for batch in batches:
            if not batch.num_rows:
                continue
            anchor = batch.column("anchor").to_numpy()
            edges = [0, *(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1).tolist(), batch.num_rows]
            bytes_of = pc.binary_length(batch.column("bytes")).to_numpy()
            for a, b in zip(edges, edges[1:]):
                if size > INDEX_BYTES and held[-1].column("anchor")[-1].as_py() != int(anchor[a]):
                    yield found()
                    held, size = [], 0
                held.append(batch.slice(a, b - a))
                size += int(bytes_of[a:b].sum())
        if held:
            yield found()

    ordered = fetched.repartition("anchor").sortWithinPartitions("anchor", "doc", "tie", "start")
    ranges = ranges.unionByName(ordered.mapInArrow(index, span))
    if not met.where("apart").isEmpty():
        ranges = ranges.unionByName(_met(texts.mapInArrow(split, shape), window).select("doc", "tie", "start", "end"))
    return rows, ranges


def remove_repeated(docs: DataFrame, doc: str = "doc_id", text: str = "text", window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans and kept_sha256, and the remaining bytes if wanted.

    A byte goes if a window of `window` bytes over it also starts earlier: in a smaller doc_id, or in the same text further left.
    Windows are judged on the input. Null texts are empty; a null id comes before all others. Rows that repeat an id are told
    apart by their text, in the order of its hash; rows equal in both count as one document, and each returns its result. Texts
    of any length are treated whole; an empty table gives no rows; other columns are ignored.
    """
    rows, ranges = repeated_ranges(docs, doc, text, window)
    gone = ranges.groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "end")).alias("gone")).select(F.col("doc").alias("d"), F.col("tie").alias("t"), "gone")
    joined = rows.select("doc", "tie", "text").join(gone, F.col("doc").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("t")), "left").select("doc", "text", "gone")
    kind = rows.schema["doc"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text]

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, "text"):
            data, offsets = utf8(part.column("text"))
            out = []
            for k, spans in enumerate(part.column("gone").to_pylist()):
                raw = data[offsets[k] : offsets[k + 1]]
                removed = n = 0
                if spans:
                    hit = np.zeros(len(raw) + 1, np.int64)
                    np.add.at(hit, [s["start"] for s in spans], 1)
                    np.add.at(hit, [s["end"] for s in spans], -1)
                    hit = np.cumsum(hit)[:-1] > 0
                    removed, n = int(hit.sum()), len(runs(hit)[0])
                    raw = raw[~hit]
                raw = raw.tobytes()
                out.append((int(offsets[k + 1] - offsets[k]), removed, n, hashlib.sha256(raw).hexdigest(), *[raw] * with_text))
            columns = list(zip(*out))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.binary()] * with_text]
            yield pa.RecordBatch.from_arrays([part.column("doc"), *(pa.array(c, t) for c, t in zip(columns, kinds))], names)

    return joined.mapInArrow(strip, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
