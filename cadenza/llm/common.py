"""Small helpers shared by the text operators: Arrow text buffers, hashing and suffix sorting in numpy."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step works on; a single longer text is a step of its own.
STEP_BYTES = 4 << 20

#: Odd multiplier of the rolling hashes and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    """The text with null as the empty string."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one under /tmp where driver and executors are one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> None:
    """Make checkpoint() usable."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


#: A key is hot if it has more than one in so many of all rows; so there are never more than so many hot keys.
HOT_SHARE = 2000
#: Rows that are joined in a moment, however they are dealt.
FEW_ROWS = 1_000_000


def join_per_key(rows: DataFrame, one: DataFrame, key: str | list[str], total: int) -> DataFrame:
    """`total` rows with the columns of `one`, which has a row of fixed size per key and in n how many of the rows have it.

    Hot keys, of which there are HOT_SHARE at most, come by broadcast, so that their rows stay where they are.
    """
    if total <= FEW_ROWS:
        return rows.join(one.drop("n"), key)
    hot = one.where(F.col("n") * HOT_SHARE > total)
    rest = rows.join(F.broadcast(hot.select(*([key] if isinstance(key, str) else key))), key, "left_anti").join(one.where(F.col("n") * HOT_SHARE <= total).drop("n"), key)
    return rest.unionByName(rows.join(F.broadcast(hot.drop("n")), key))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


#: What a worker process keeps from task to task of one operator.
KEPT: dict[str, object] = {}


def steps(batches: Iterator[pa.RecordBatch], column: str, limit: int = STEP_BYTES, keep: str | None = None) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about `limit` bytes of the text column, and one row at least.

    Forgets what tasks of other operators kept in this process: all but the entry named `keep`."""
    for name in [k for k in KEPT if k != keep]:
        del KEPT[name]
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = utf8(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(10, (n - 1).bit_length())
        have = np.ones(1, np.uint64)
        while len(have) < size:
            have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
        if size <= 4 * STEP_BYTES:
            _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), so that every input bit reaches every output bit."""
    x = np.asarray(x, dtype=np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


#: Bytes up to which a range is hashed by a polynomial. Modulo a power of two that is no good for long texts of two letters.
LONG = 160


class RangeHash:
    """64-bit hash of any byte range of one buffer: of up to LONG bytes in constant time, by a prefix sum of byte values times powers;
    of a longer one by a digest of its bytes."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        self.data = data
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_VALUES[data] * powers(BASE, n), out=self.sums[1:])
        self.back = powers(BASE_INV, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.back[start]
        out = mix(raw ^ mix((end - start).astype(np.uint64) + np.uint64(1)))
        for k in np.flatnonzero(end - start > LONG).tolist():
            out[k] = int.from_bytes(hashlib.blake2b(self.data[start[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
        return out


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of true values."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: does it occur more than once, and is it a later occurrence?"""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    later = np.zeros(len(keys), bool)
    later[order[1:]] = same
    multiple = later.copy()
    multiple[order[:-1]] |= same
    return multiple, later


def covered(n: int, starts: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """Which of n places lie in some [start, start + length)."""
    change = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(starts + length, minlength=n + 1)[: n + 1]
    return np.cumsum(change)[:n] > 0


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix order of a sequence of non-negative integers, shorter first on equal prefixes.

    Prefix doubling: the first round sorts as many symbols as fit in 62 bits, later rounds only what is still tied.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    bits = int(text.max() + 1).bit_length()
    depth = max(1, 62 // bits)
    shifted = np.concatenate([text.astype(np.int64) + 1, np.zeros(depth, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(depth):
        key = (key << bits) | shifted[j : j + n]
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    head = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    where = np.arange(n)
    rank = np.zeros(n + 1, np.int64)  # rank[n]: the empty suffix, before all others
    rank[order] = np.maximum.accumulate(np.where(head, where, 0)) + 1
    tail = np.concatenate([head[1:], [True]])
    place = np.flatnonzero(~(head & tail))
    while len(place):
        active = order[place]
        first, second = rank[active], rank[np.minimum(active + depth, n)]
        again = np.lexsort((second, first)) if n >= (1 << 31) else np.argsort(first * (n + 1) + second, kind="stable")
        active, first, second = active[again], first[again], second[again]
        order[place] = active
        head = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        rank[active] = np.maximum.accumulate(np.where(head, place, 0)) + 1
        tail = np.concatenate([head[1:], [True]])
        place = place[~(head & tail)]
        depth *= 2
    return order


def materialize(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """The rows written as a table in the cluster's shared checkpoint folder and read from there: cuts the lineage and survives
    lost executors. The folder is the caller's to clear."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
