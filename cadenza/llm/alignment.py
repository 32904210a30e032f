"""Alignment of two tokenizers over a corpus: which tokens of one stand where tokens of the other stand, and how usual that is.

Inverted pair bitmaps: for every pair of linked ids, compressed bitmaps of the documents that hold it, one for each bit of how often they
hold it. The planes of a pair are ORed and popcounted for its number of documents, and as postings they take the pair's score back to
its documents.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import KEPT, join_per_key, materialize, steps, text_of

#: Bytes of text in a block of documents; a longer document is a block of its own.
BLOCK_BYTES = 6 << 20
#: Most documents of a block: their numbers fit 16 bits.
BLOCK_DOCS = 1 << 16
#: A worker's memo starts anew beyond so many pieces of text or links of theirs.
MEMO_PIECES, MEMO_LINKS = 600_000, 6_000_000
#: Ids of the second tokenizer are below this; a pair is one number.
PAIR = 1 << 16
#: Rows of bitmaps that are made or read at once.
ROWS = 1 << 10

#: Where a text may be cut without either tokenizer noticing: before a single space after something that isn't white space. No token of
#: either spans such a place, and what a tokenizer does on one side depends on that side alone.
CUT = re.compile(r"(?<=[^\s▁])(?= [^ ])")
#: Pieces of which one may stand after another, one space between, and neither tokenizer notices.
PLAIN = re.compile(r"[^ ](?:.*[^\s▁])?\Z(?<![\s▁])", re.DOTALL)
IN_A_ROW = 64
#: Texts without these are cut at every space.
GLUED = re.compile(r"[\s▁] |^ | $")


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level token stands for: printable ones stand for themselves, the rest are numbered
    from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Aligner:
    """Both tokenizers, and for every piece of text seen how its tokens align: counts, its groups in writing, its links."""

    def __init__(self, first: str, second: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(first)
        self.first.encode_special_tokens = True  # their strings in a text are plain text
        self.second = sentencepiece.SentencePieceProcessor(model_file=second)
        letters = byte_level()
        size = self.first.get_vocab_size(with_added_tokens=True)
        self.first_bytes = [bytes(letters.get(c, 0) for c in self.first.id_to_token(k) or "") for k in range(size)]
        self.second_bytes = [self._second_bytes(k) for k in range(self.second.get_piece_size())]
        self.widths = [np.array([len(b) for b in x], np.int64) for x in (self.first_bytes, self.second_bytes)]
        # an id in writing, by what follows it: first ids in a group, at its end; second ids in a group, at its end, at a piece's end
        self.written = [f"{k}{end}" for n, ends in ((size, ",|"), (len(self.second_bytes), ",;\n")) for end in ends for k in range(n)]
        self.forget()

    def _second_bytes(self, k: int) -> bytes:
        piece = self.second.id_to_piece(k)
        return bytes([int(piece[3:5], 16)]) if self.second.is_byte(k) else piece.replace("▁", " ").encode()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[str | None] = []  # None: the bytes differ
        self.counts = array("q")  # of each piece: tokens of either kind, groups
        self.links = array("q")
        self.ends = array("q", [0])  # of the links of each piece

    def learn(self, pieces: list[str]) -> None:
        """Align new pieces of text, each standing after a space. Those that may stand in a row are encoded by rows of them."""
        plain = [p for p in pieces if PLAIN.match(p)]
        self._learn([plain[at : at + IN_A_ROW] for at in range(0, len(plain), IN_A_ROW)] + [[p] for p in pieces if not PLAIN.match(p)])

    def _learn(self, rows: list[list[str]]) -> None:
        texts = [" ".join(row) for row in rows]
        firsts = [e.ids for e in self.first.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        seconds = self.second.encode(texts, num_threads=1)
        good, again = [], []
        for row, text, a, b in zip(rows, texts, firsts, seconds):
            if b"".join(map(self.first_bytes.__getitem__, a)) == b" " + text.encode() == b"".join(map(self.second_bytes.__getitem__, b)):
                good.append((row, a, b))
            elif len(row) > 1:
                again.extend([p] for p in row)
            else:
                self._leave_out(row[0])
        again.extend([p] for k in self._add(good) for p in good[k][0])
        if again:
            self._learn(again)

    def _leave_out(self, piece: str) -> None:
        self.number[piece] = len(self.groups)
        self.groups.append(None)
        self.counts.extend((0, 0, 0))
        self.ends.append(self.ends[-1])

    def _add(self, rows: list[tuple[list[str], list[int], list[int]]]) -> list[int]:
        """Take up the pieces of rows whose bytes agree with their tokens of both kinds. Returns the numbers of rows in which a piece
        doesn't end with a token of either kind; of these nothing is taken up."""
        if not rows:
            return []
        pieces = [p for row, _, _ in rows for p in row]
        stops = np.cumsum([1 + len(p.encode()) for p in pieces])
        a, b = (np.array([k for row in rows for k in row[kind]], np.int64) for kind in (1, 2))
        end_a, end_b = np.cumsum(self.widths[0][a]), np.cumsum(self.widths[1][b])
        ends = np.intersect1d(end_a, end_b)  # of groups
        if len(open_ended := np.setdiff1d(stops, ends)):
            owner = np.repeat(np.arange(len(rows)), [len(row) for row, _, _ in rows])
            bad = np.unique(owner[np.searchsorted(stops, open_ended)]).tolist()
            self._add([row for k, row in enumerate(rows) if k not in bad])
            return bad
        group_a, group_b = np.searchsorted(ends, end_a), np.searchsorted(ends, end_b)
        size_a, size_b = np.bincount(group_a, minlength=len(ends)), np.bincount(group_b, minlength=len(ends))
        upto_a, upto_b, last = np.cumsum(size_a), np.cumsum(size_b), np.searchsorted(ends, stops)
        # in writing, a group is its first ids, then its second ids
        code_a, code_b, n_a, n_b = a.copy(), b + 2 * len(self.first_bytes), len(self.first_bytes), len(self.second_bytes)
        code_a[upto_a - 1] += n_a
        code_b[upto_b - 1] += n_b
        code_b[upto_b[last] - 1] += n_b
        codes = np.zeros(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + (upto_b - size_b)[group_a]] = code_a
        codes[np.arange(len(b)) + upto_a[group_b]] = code_b
        # every first id of a group with every second id of it
        times = size_b[group_a]
        at = np.repeat((upto_b - size_b)[group_a] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        start = self.ends[-1]
        self.number.update(zip(pieces, range(len(self.groups), len(self.groups) + len(pieces))))
        self.groups.extend("".join(map(self.written.__getitem__, codes.tolist())).split("\n")[:-1])
        self.links.frombytes((np.repeat(a, times) * PAIR + b[at]).tobytes())
        counts = np.stack([upto_a[last], upto_b[last], last + 1], axis=1)
        self.counts.frombytes(np.diff(counts, axis=0, prepend=0).astype(np.int64).tobytes())
        self.ends.frombytes((start + np.cumsum(size_a * size_b)[last]).astype(np.int64).tobytes())
        return []

    def align(self, texts: list[str]) -> tuple[list[tuple[int, int, int, int, str]], np.ndarray, np.ndarray, np.ndarray]:
        """For each text its tokens of either kind, groups, links and the digest of its groups; and for each different piece of a
        text: text number, piece, times. Texts without tokens have none."""
        if len(self.groups) > MEMO_PIECES or len(self.links) > MEMO_LINKS:
            self.forget()
        cut = [[] if not t else [p[1:] for p in CUT.split(" " + t)] if GLUED.search(t) else t.split(" ") for t in texts]
        new = [p for p in {p for parts in cut for p in parts} if p not in self.number]
        for at in range(0, len(new), 4096):
            self.learn(new[at : at + 4096])
        number = self.number.__getitem__
        rows, doc, piece, times = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        counts, ends = np.frombuffer(self.counts, np.int64).reshape(-1, 3), np.frombuffer(self.ends, np.int64)
        for k, parts in enumerate(cut):
            at = list(map(number, parts))
            written = [self.groups[i] for i in at]
            if not at or None in written:
                rows.append((0, 0, 0, 0, ""))
                continue
            own, n = np.unique(np.array(at, np.int64), return_counts=True)
            total = n @ counts[own]
            rows.append((*total.tolist(), int(n @ (ends[own + 1] - ends[own])), hashlib.sha256(";".join(written).encode()).hexdigest()))
            doc.append(np.full(len(own), k)), piece.append(own), times.append(n)
        return rows, np.concatenate(doc), np.concatenate(piece), np.concatenate(times)

    def postings(self, doc: np.ndarray, piece: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pair, text number and how often, ordered, each pair and text once."""
        ends = np.frombuffer(self.ends, np.int64)
        start, size = ends[piece], ends[piece + 1] - ends[piece]
        at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
        pair = np.frombuffer(self.links, np.int64)[at] if len(at) else np.zeros(0, np.int64)
        key = pair * BLOCK_DOCS + np.repeat(doc, size)
        many = np.repeat(times, size)
        # times of up to 16 bits travel in the sorted number itself; more is rare and goes in several parts
        parts = []
        while len(key):
            part = np.minimum(many, 0xFFFF)
            parts.append((key.astype(np.uint64) << np.uint64(16)) | part.astype(np.uint64))
            key, many = key[many > 0xFFFF], (many - part)[many > 0xFFFF]
        packed = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
        key = (packed >> np.uint64(16)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        count = np.add.reduceat((packed & np.uint64(0xFFFF)).astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
        return key[first] // BLOCK_DOCS, key[first] % BLOCK_DOCS, count


def aligner_for(first: str, second: str) -> Aligner:
    """The worker's aligner, kept from task to task until another operator runs there."""
    name = f"{first} {second}"
    if not isinstance(kept := KEPT.get(name), Aligner):
        kept = KEPT[name] = Aligner(first, second)
    return kept


def compress(owner: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, pa.Array]:
    """Bitmaps of ordered document numbers: the owner of each, and its bytes: 16-bit numbers, or one bit for each of the n_docs
    documents of the block where that is shorter. The first byte tells which."""
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(owner)))
    width = (n_docs + 7) // 8
    dense = 2 * size > width
    length = 1 + np.where(dense, width, 2 * size)
    start = np.cumsum(length) - length
    data = np.zeros(int(length.sum()), np.uint8)
    data[start] = dense
    numbers = np.repeat(~dense, size)
    within = np.arange(len(owner)) - np.repeat(first, size)
    at = (np.repeat(start + 1, size) + 2 * within)[numbers]
    data[at], data[at + 1] = doc[numbers] & 0xFF, doc[numbers] >> 8
    thick = np.flatnonzero(dense)
    for low in range(0, len(thick), ROWS):
        rows = thick[low : low + ROWS]
        bits = np.zeros((len(rows), n_docs), np.uint8)
        place = np.repeat(first[rows] - (np.cumsum(size[rows]) - size[rows]), size[rows]) + np.arange(size[rows].sum())
        bits[np.repeat(np.arange(len(rows)), size[rows]), doc[place]] = 1
        data[(start[rows] + 1)[:, None] + np.arange(width)] = np.packbits(bits, axis=1)
    offsets = pa.py_buffer(np.append(start, length.sum()).astype(np.int32))
    return owner[first], pa.Array.from_buffers(pa.binary(), len(first), [None, offsets, pa.py_buffer(data)])


def expand(bitmaps: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and document number of every document in compressed bitmaps."""
    data, offsets = _bytes(bitmaps)
    start, length = offsets[:-1] + 1, np.diff(offsets) - 1
    dense = data[offsets[:-1]] == 1
    size = np.where(dense, 0, length // 2)
    row = np.repeat(np.arange(len(size)), size)
    at = np.repeat(start - 2 * (np.cumsum(size) - size), size) + 2 * np.arange(len(row))
    rows, docs = [row], [data[at].astype(np.int64) | (data[at + 1].astype(np.int64) << 8)]
    for width in np.unique(length[dense]).tolist():  # one block's bitmaps are of one width
        thick = np.flatnonzero(dense & (length == width))
        for low in range(0, len(thick), ROWS):
            own = thick[low : low + ROWS]
            k, doc = np.nonzero(np.unpackbits(data[start[own][:, None] + np.arange(width)], axis=1))
            rows.append(own[k]), docs.append(doc)
    return np.concatenate(rows), np.concatenate(docs)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def inverted_pairs(docs: DataFrame, first: str, second: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Two kinds of rows. Documents: block, number (in the block), doc_id, n_a, n_b, n_groups, n_links, groups_sha256. Postings: block,
    pair, plane (bit of the number of links), bitmap (documents of the block), and n_docs: the popcount of all planes of the pair in
    the block ORed, on one of their rows, 0 on the others."""
    rows = docs.select(F.col(doc).alias("doc_id"), text_of(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["block", "number", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pair", "plane", "bitmap", "n_docs"]
    types = [pa.int64(), pa.int32(), None, *[pa.int64()] * 4, pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.int64()]

    def batch(arrow: pa.DataType, n: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, t or arrow) for c, t in zip(names, types)], names)

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_for(first, second)
        block = TaskContext.get().partitionId() << 32
        for step in steps(batches, "text", BLOCK_BYTES, keep=f"{first} {second}"):
            for low in range(0, step.num_rows, BLOCK_DOCS):
                part = step.slice(low, BLOCK_DOCS)
                n, arrow = part.num_rows, part.column("doc_id").type
                found, owner, piece, times = aligner.align(part.column("text").to_pylist())
                columns = dict(zip(("n_a", "n_b", "n_groups", "n_links"), (pa.array(x, pa.int64()) for x in list(zip(*found))[:4])))
                yield batch(arrow, n, block=pa.array(np.full(n, block)), number=pa.array(np.arange(n), pa.int32()), doc_id=part.column("doc_id"), groups_sha256=pa.array([r[4] for r in found]), **columns)
                pair, number, many = aligner.postings(owner, piece, times)
                for plane in range(int(many.max(initial=0)).bit_length()):
                    here = (many >> plane) & 1 == 1
                    own, bitmap = compress(pair[here], number[here], n)
                    # documents first seen in this plane: over all planes they are those of the union
                    fresh = np.bincount(np.searchsorted(own, pair[here & (many & ((1 << plane) - 1) == 0)]), minlength=len(own))
                    size = len(own)
                    yield batch(arrow, size, block=pa.array(np.full(size, block)), pair=pa.array(own), plane=pa.array(np.full(size, plane), pa.int32()), bitmap=bitmap, n_docs=pa.array(fresh))
                block += 1

    shape = f"block long, number int, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pair long, plane int, bitmap binary, n_docs long"
    return rows.mapInArrow(invert, shape)


def pair_scores(postings: DataFrame) -> DataFrame:
    """pair, n_docs (corpus-wide), n (rows of postings), and best: is that the highest of the pairs of its first id?

    The pairs of one first id are at most as many as the second tokenizer has ids.
    """
    counts = postings.groupBy("pair").agg(F.sum("n_docs").alias("n_docs"), F.count(F.lit(1)).alias("n"))
    top = F.max("n_docs").over(Window.partitionBy(F.expr(f"pair div {PAIR}")))
    return counts.withColumn("best", F.col("n_docs") == top)


def _add_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n_best and count_sum of every document of the blocks that meet here."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        block, plane, score, best = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "plane", "n_docs", "best"))
        row, doc = expand(batch.column("bitmap"))
        links = np.int64(1) << plane.astype(np.int64)
        order = np.argsort(block[row], kind="stable")
        row, doc = row[order], doc[order]
        own = block[row]
        edges = np.append(np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])), len(own))
        for low, high in zip(edges[:-1], edges[1:]):
            r, d = row[low:high], doc[low:high]
            size = int(d.max()) + 1
            key = int(own[low])
            have = sums.get(key)
            if have is None or have.shape[1] < size:
                grown = np.zeros((2, size), np.int64)
                if have is not None:
                    grown[:, : have.shape[1]] = have
                have = sums[key] = grown
            np.add.at(have[0], d, links[r] * best[r])
            np.add.at(have[1], d, links[r] * score[r])
    for key, have in sums.items():
        used = np.flatnonzero(have[1])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), key)), pa.array(used, pa.int32()), pa.array(have[0][used]), pa.array(have[1][used])], ["block", "number", "n_best", "count_sum"])


def align_tokenizers(docs: DataFrame, first: str, second: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    `first` is a byte-level tokenizer's file, `second` a sentence-piece model that keeps white space and adds a space before the text.
    Tokens of both are cut into groups where both end; every two tokens of a group are linked; a pair of ids counts in how many
    documents it is linked. Texts are cut into pieces at places that neither tokenizer spans, and a worker remembers the pieces' links.

    Documents travel in blocks: the bitmaps of a block are written once, joined to the scores of their pairs (hot pairs by broadcast,
    others by a shuffle), and added up where the block's documents meet, in dense sums of 16 bytes a document.

    Null and empty texts, and texts that either tokenizer doesn't give back, have zeros and an empty digest. Every row is a document,
    also where ids repeat or are null; a text of any length is a block if it is longer than one; an empty table gives no rows; other
    columns are not read.
    """
    made = materialize(inverted_pairs(docs, first, second, doc, text))
    postings = made.where("pair is not null").select("block", "pair", "plane", "bitmap", "n_docs")
    scores = materialize(pair_scores(postings))
    total = scores.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    scored = join_per_key(postings.drop("n_docs"), scores, "pair", total).select("block", "plane", "bitmap", "n_docs", "best")
    sums = scored.repartition("block").mapInArrow(_add_scores, "block long, number int, n_best long, count_sum long")
    texts = made.where("number is not null").select("block", "number", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    joined = texts.join(sums, ["block", "number"], "left").fillna(0, ["n_best", "count_sum"])
    return joined.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
