"""Divergence of sources: which sources of a language use its words differently, and by which words.

Chunk factorization: documents are counted by white-space chunk, every distinct chunk of the corpus is cut into terms once, and its
terms are joined back to the places of the chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import materialize, steps, text_of

#: What stands between terms, which are letters of ASCII and everything beyond ASCII.
NO_TERM = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of text in a block of documents; a longer document is a block of its own.
BLOCK_BYTES = 32 << 20
#: Documents of terms of a block that are counted at once.
STEP_HELD = 1 << 19
#: Documents of a language that must hold a term for it to count.
MIN_DOCS = 10
#: Terms listed for each group.
TOP_TERMS = 10
#: Sources and terms that are compared in one place.
TILE_SOURCES, TILE_TERMS = 128, 2048
#: Shares are whole numbers of this part of one.
UNIT = 1_000_000_000


def count_chunks(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Chunks of every block of documents: block, row (number of the chunk in the block) and chunk. A further row of each block has no
    chunk but the rest: how many documents hold each chunk (sizes), which by their numbers in the block, as steps from one to the
    next (docs), how often each does (times), and the documents' languages and sources by number."""
    rows = docs.select(text_of(text).alias("text"), text_of(lang).alias("lang"), text_of(source).alias("source"))
    names = ["block", "row", "chunk", "sizes", "docs", "times", "langs", "sources"]
    types = [pa.int64(), pa.int32(), pa.string(), *[pa.binary()] * 3, *[pa.list_(pa.string())] * 2]

    def batch(n: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, t) for c, t in zip(names, types)], names)

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for part in steps(batches, "text", BLOCK_BYTES):
            cut = pc.ascii_split_whitespace(part.column("text"))
            doc = np.repeat(np.arange(part.num_rows, dtype=np.int32), pc.list_value_length(cut).to_numpy())
            chunks = cut.flatten().dictionary_encode()
            del cut  # a block's chunks one by one are larger than its text
            size = len(chunks.dictionary)
            order = pc.sort_indices(chunks.dictionary).to_numpy()  # neighbours are alike and compress well wherever they go
            rank = np.empty(size, np.int64)
            rank[order] = np.arange(size)
            place = rank[chunks.indices.to_numpy(zero_copy_only=False)]
            place <<= 32
            place |= doc
            place.sort()
            first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, np.int64)
            times = squeeze(np.diff(np.append(first, len(place))))
            place = place[first]
            del first, doc
            owner = place >> 32
            fresh = np.diff(owner, prepend=-1) != 0
            sizes = squeeze(np.bincount(owner, minlength=size))
            del owner
            place &= 0xFFFFFFFF
            step = np.diff(place, prepend=0)
            step[fresh] = place[fresh]
            packed = {"sizes": sizes, "docs": squeeze(step), "times": times}
            del place, step, fresh
            yield batch(size, block=pa.array(np.full(size, block)), row=pa.array(np.arange(size), pa.int32()), chunk=chunks.dictionary.take(pa.array(order)).cast(pa.string()))
            of = {f"{c}s": pa.array([part.column(c).to_pylist()], pa.list_(pa.string())) for c in ("lang", "source")}
            yield batch(1, block=pa.array([block]), **{c: pa.array([x], pa.binary()) for c, x in packed.items()}, **of)
            block += 1

    return rows.mapInArrow(postings, "block long, row int, chunk string, sizes binary, docs binary, times binary, langs array<string>, sources array<string>")


def squeeze(numbers: np.ndarray) -> bytes:
    """Numbers under 2^32, compressed: all lowest bytes first, since most numbers are small."""
    raw = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(raw, asbytes=True)


def unsqueeze(packed: bytes) -> np.ndarray:
    raw = pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def chunk_terms(places: DataFrame) -> DataFrame:
    """block, row and terms (lower case, separated by spaces) of every place of a chunk that has terms.

    All places of a chunk stand one after the other in one task, and its terms are cut out once. A chunk has one place in a block, so
    even the most frequent one is a small part of a partition.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            same = pc.run_end_encode(batch.column("chunk"))
            length = np.diff(same.run_ends.to_numpy(), prepend=0)
            terms = pc.utf8_trim(pc.replace_substring_regex(pc.ascii_lower(same.values), NO_TERM, " "), " ")
            places = pa.RecordBatch.from_arrays([batch.column("block"), batch.column("row"), terms.take(pa.array(np.repeat(np.arange(len(length)), length)))], ["block", "row", "terms"])
            yield places.filter(pc.not_equal(places.column("terms"), ""))

    return places.select("block", "row", "chunk").repartition("chunk").sortWithinPartitions("chunk").mapInArrow(cut, "block long, row int, terms string")


def _ends_of_steps(term: np.ndarray, width: np.ndarray) -> list[int]:
    """Where to cut ordered terms so that a step has whole terms and about STEP_HELD of their documents; more only by its first term."""
    last = np.flatnonzero(np.append(term[1:] != term[:-1], True))
    step = (np.cumsum(width)[last] - 1) // STEP_HELD
    return (last[np.append(step[1:] != step[:-1], True)] + 1).tolist()


def _sum_block(places: pa.Table, head: pa.Table) -> pa.Table:
    """Occurrences and distinct documents of every language, source and term of one block."""
    kind = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("count", pa.int64()), ("documents", pa.int64())])
    if not places.num_rows:
        return kind.empty_table()
    pa.default_memory_pool().release_unused()
    sizes, step = (unsqueeze(head.column(c)[0].as_py()) for c in ("sizes", "docs"))
    begin = np.cumsum(sizes) - sizes
    docs = np.cumsum(step)
    docs -= np.repeat(docs[begin] - step[begin], sizes)
    docs = docs.astype(np.int32)
    del step
    times = unsqueeze(head.column("times")[0].as_py()).astype(np.int32)
    cut = pc.split_pattern(places.column("terms").combine_chunks(), " ")
    terms = cut.flatten().dictionary_encode()
    row = np.repeat(places.column("row").to_numpy(), pc.list_value_length(cut).to_numpy())  # of each term of a chunk
    del cut
    term = terms.indices.to_numpy().astype(np.int64)
    order = np.argsort(term, kind="stable")
    row, term = row[order], term[order]
    langs, sources = (head.column(c).combine_chunks().flatten().dictionary_encode() for c in ("langs", "sources"))
    n_sources = len(sources.dictionary)
    group = langs.indices.to_numpy().astype(np.int64) * n_sources + sources.indices.to_numpy()
    size = n_sources * len(langs.dictionary)
    parts, low = [], 0
    for high in _ends_of_steps(term, sizes[row]):
        mine = row[low:high]
        width = sizes[mine]
        at = np.repeat(begin[mine] - (np.cumsum(width) - width), width) + np.arange(width.sum())  # its documents
        key = (np.repeat(term[low:high], width) << 32) | docs[at]
        order = np.argsort(key, kind="stable")
        key, many = key[order], times[at][order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.add.reduceat(many, first, dtype=np.int64)
        own, where = np.unique((key[first] >> 32) * size + group[key[first] & 0xFFFFFFFF], return_inverse=True)
        total = np.zeros(len(own), np.int64)
        np.add.at(total, where, count)
        parts.append((own, total, np.bincount(where, minlength=len(own))))
        low = high
    own, total, documents = (np.concatenate(x) for x in zip(*parts))
    took = [langs.dictionary.take(pa.array(own % size // n_sources)), sources.dictionary.take(pa.array(own % n_sources)), terms.dictionary.take(pa.array(own // size))]
    return pa.Table.from_arrays([*took, pa.array(total), pa.array(documents)], schema=kind)


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, count (occurrences) and documents (that hold it) of every term of every group; the rows of one language and term
    stand in one partition.

    Chunks leave their block and come back as terms without the documents that hold them; those wait, compressed, where the block
    meets again. What a task holds at once is one block. Sums of a block travel by term, so that its groups follow each other.
    """
    counted = materialize(count_chunks(docs, text, lang, source), "zstd")
    terms = chunk_terms(counted.where("row is not null"))
    heads = counted.where("row is null").select(F.col("block").alias("of_block"), "sizes", "docs", "times", "langs", "sources")
    summed = terms.groupBy("block").cogroup(heads.groupBy("of_block")).applyInArrow(_sum_block, "lang string, source string, term string, count long, documents long")
    return summed.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("documents").alias("documents"))


def share(count: str, total: str, size: str) -> Column:
    """1 + floor(UNIT * (count + 2) / (total + 2 * size)), exactly; null where size is 0."""
    return F.expr(f"1 + (cast({UNIT} as decimal(10,0)) * cast({count} + 2 as decimal(20,0))) div nullif(cast({total} as decimal(20,0)) + 2 * cast({size} as decimal(20,0)), 0)")


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)) of positive whole numbers up to UNIT + 1, whose squares fit 64 bits."""
    return (p - q) * (p - q) // (p + q)


def _compare_sources(cells: pa.Table, sources: pa.Table) -> pa.Table:
    """Sums of the gaps of every two sources that meet here over the terms that any of them has; both orders of each pair."""
    kind = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("total", pa.int64()), ("seen", pa.int64()), ("unseen_gap", pa.int64()), ("size", pa.int64())])
    names, zero = sources.column("source").to_pylist(), sources.column("unseen").to_numpy()
    tile = sources.column("tile").to_numpy()
    across = sources.column("of_low")[0].as_py() != sources.column("of_high")[0].as_py()
    wanted = tile[:, None] != tile[None, :] if across else np.ones((len(tile), len(tile)), bool)
    shares = np.repeat(zero[:, None], 0, axis=1)
    if cells.num_rows:
        terms = cells.column("term").combine_chunks().dictionary_encode()
        shares = np.repeat(zero[:, None], len(terms.dictionary), axis=1)
        place = pc.index_in(cells.column("source"), pa.array(names, pa.string())).to_numpy()
        shares[place, terms.indices.to_numpy()] = cells.column("p").to_numpy()
    one, other, total = [], [], []
    for k in range(len(names) - 1):
        with_ = k + 1 + np.flatnonzero(wanted[k, k + 1 :])
        one.append(np.full(len(with_), k)), other.append(with_)
        total.append(gap(shares[with_], shares[k]).sum(axis=1))
    one, other, total = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (one, other, total))
    left, right = np.concatenate([one, other]), np.concatenate([other, one])
    named = pa.array(names, pa.string())
    lang = pa.array([sources.column("lang")[0].as_py()] * len(left), pa.string())
    whole = [np.tile(total, 2), np.full(len(left), shares.shape[1]), gap(zero[left], zero[right]), np.full(len(left), sources.column("size")[0].as_py())]
    return pa.Table.from_arrays([lang, named.take(pa.array(left)), named.take(pa.array(right)), *(pa.array(x, pa.int64()) for x in whole)], schema=kind)


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value and rank: how far each source of a language is from its other sources (part pair, all ranks), and
    the terms that it uses most above the language (part term, `top` ranks). Whole numbers throughout.

    A language keeps the terms that at least `min_docs` of its documents hold; the share of a kept term in a group, or in the language, is
    `share` of its count there; two shares are apart by `gap`. Terms that neither of two sources has add the same each, so only the
    terms that one of them has are compared one by one: sources and terms are dealt by hash into tiles of about TILE_SOURCES and
    TILE_TERMS, every two source tiles meet once for each term tile, and a cell travels to as many places as its language has source tiles.

    Null text, language and source count as ''. Every row is a document, also where ids repeat. Groups without a term
    have only pairs; with one source a language has none; languages without kept terms have pairs of value 0; an empty table gives
    no rows; other columns are not read.
    """
    term = Window.partitionBy("lang", "term")
    found = term_counts(docs, text, lang, source).withColumn("d", F.sum("documents").over(term)).withColumn("of_lang", F.sum("count").over(term))
    found = found.withColumn("once", F.row_number().over(term.orderBy("source")) == 1)
    used = materialize(found.where(F.col("d") >= min_docs).drop("d", "documents"), "zstd")
    by_lang = used.where("once").groupBy("lang").agg(F.count(F.lit(1)).alias("size"), F.sum("of_lang").alias("lang_total"))
    groups = docs.select(text_of(lang).alias("lang"), text_of(source).alias("source")).distinct()
    width = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / TILE_SOURCES).alias("tiles"))
    sums = used.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    sizes = groups.join(width, "lang").join(by_lang, "lang", "left").join(sums, ["lang", "source"], "left").fillna(0, ["size", "lang_total", "total"])
    sizes = materialize(sizes.withColumn("unseen", F.coalesce(share("0", "total", "size"), F.lit(1))).withColumn("tile", F.pmod(F.xxhash64("source"), "tiles")))

    cells = used.join(sizes, ["lang", "source"]).withColumn("p", share("count", "total", "size"))
    above = cells.withColumn("q", share("of_lang", "lang_total", "size")).where("p > q")
    terms = above.selectExpr("lang", "source", "'term' as part", "term as item", "((p - q) * (p - q)) div (p + q) as value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    buckets = f"greatest(1, cast(ceil(size / {TILE_TERMS}) as long))"
    meet = "explode(transform(sequence(0L, tiles - 1), u -> struct(least(u, tile) as low, greatest(u, tile) as high))) as m"
    dealt = cells.selectExpr("lang", "source", "term", "p", f"pmod(xxhash64(term, 1), {buckets}) as bucket", meet).select("lang", "m.low", "m.high", "bucket", "source", "term", "p")
    present = sizes.selectExpr("*", f"explode(sequence(0L, {buckets} - 1)) as bucket").selectExpr("lang", "source", "unseen", "size", "tile", "bucket", meet)
    keys = ["lang", "low", "high", "bucket"]
    present = present.select("lang", "m.low", "m.high", "bucket", "source", "unseen", "size", "tile")
    present = present.select(*(F.col(k).alias(f"of_{k}") for k in keys), *(F.col(c).alias(c) for c in ("lang", "source", "unseen", "size", "tile")))
    shape = "lang string, source string, item string, total long, seen long, unseen_gap long, size long"
    met = dealt.groupBy(*keys).cogroup(present.groupBy(*(f"of_{k}" for k in keys))).applyInArrow(_compare_sources, shape)
    pairs = met.groupBy("lang", "source", "item").agg(F.sum("total").alias("total"), F.sum("seen").alias("seen"), F.first("unseen_gap").alias("unseen_gap"), F.first("size").alias("size"))
    pairs = pairs.selectExpr("lang", "source", "'pair' as part", "item", "if(size = 0, 0L, total + (size - seen) * unseen_gap) as value")
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms)
