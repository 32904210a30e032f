"""Line deduplication by a deletion-neighbourhood join: lines within one edit of an earlier line go."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import join_per_key, materialize, mix, powers, text_of

#: Shorter lines (code points) go only if they equal an earlier one: one edit says little about them.
MIN_CHARS = 10
#: Characters of lines that are joined at once in one place; lines that share a half and hold more are joined by their variants.
PLACE_CHARS = 500_000
#: Variants of one line that travel as one batch.
VARIANTS = 100_000

_PRIME = 0xD6E8FEB86659FD93


def variant_keys(line: str) -> tuple[int, np.ndarray]:
    """Hash of a line, and of the line without its k-th code point for every k."""
    points = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    n = len(points)
    value = mix(points + np.uint64(1))
    scale = powers(_PRIME, n + 1)
    whole = np.zeros(n + 1, np.uint64)
    np.cumsum(value * scale[:n], out=whole[1:])
    # after the gap every code point moves one place forward
    moved = np.zeros(n + 1, np.uint64)
    np.cumsum((value[1:] * scale[: n - 1])[::-1], out=moved[1:n])
    gone = whole[:n] + moved[:n][::-1]
    return int(mix(whole[n : n + 1] ^ np.uint64(n))[0].view(np.int64)), mix(gone ^ np.uint64(max(0, n - 1))).view(np.int64)


def half_keys(line: Column) -> Column:
    """Hashes by which two lines within one edit must meet: cut the shorter line in the middle, and either its first part
    starts both or its second part ends both. A line stands for the shorter and for the longer one of a pair."""
    out = []
    for less in (0, 1):
        size = F.length(line) - less
        cut = (size / 2).cast("int")
        out += [F.xxhash64(F.substr(line, F.lit(1), cut), size, F.lit(0)), F.xxhash64(F.right(line, size - cut), size, F.lit(1))]
    return F.array(*out)


def within_one_edit(a: str, b: str) -> bool:
    """Are two different texts one insertion, deletion or substitution apart?"""
    if abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    low, high = 0, len(a)
    while low < high:  # longest common prefix by halving
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    return a[low + 1 :] == b[low + 1 :] if len(a) == len(b) else a[low:] == b[low + 1 :]


def earliest_neighbours(lines: list[str], rank: np.ndarray, group: np.ndarray) -> list[tuple[int, int]]:
    """Deletion-neighbourhood join inside groups: each line with the least-ranked one within one edit, if that ranks lower."""
    keys, owner, gap = [], [], []
    for k, line in enumerate(lines):
        own, gone = variant_keys(line)
        keys.append(np.concatenate([[own], gone]))
        owner.append(np.full(len(gone) + 1, k))
        gap.append(np.arange(-1, len(gone)))
    owner, gap = np.concatenate(owner), np.concatenate(gap)
    key = mix(np.concatenate(keys).view(np.uint64) ^ mix(group.view(np.uint64)[owner]))
    best = np.arange(len(lines))

    def offer(to: np.ndarray, by: np.ndarray) -> None:
        order = np.argsort(-rank[by], kind="stable")  # the least rank is written last
        to, by = to[order], by[order]
        better = rank[by] < rank[best[to]]
        best[to[better]] = by[better]

    def least_of(place: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """For each of the ordered places, the owner of least rank among those between two fresh starts."""
        ranks = np.minimum.reduceat(rank[owner[place]], np.flatnonzero(fresh))
        return by_rank[ranks][np.cumsum(fresh) - 1]

    by_rank = np.empty(len(rank), np.int64)
    by_rank[rank] = np.arange(len(rank))
    place = np.lexsort((gap, key))
    fresh = np.concatenate([[True], (key[place][1:] != key[place][:-1]) | (gap[place][1:] != gap[place][:-1])])
    swapped = gap[place] >= 0
    offer(owner[place][swapped], least_of(place, fresh)[swapped])  # same variant, same gap: one substitution
    whole = np.flatnonzero(gap < 0)
    whole = whole[np.argsort(key[whole], kind="stable")]
    gone = np.flatnonzero(gap >= 0)
    at = np.searchsorted(key[whole], key[gone])
    meets = (at < len(whole)) & (key[whole][np.minimum(at, len(whole) - 1)] == key[gone])
    a, b = owner[whole[at[meets]]], owner[gone[meets]]  # a variant of b is all of a: one insertion
    offer(b, a)
    offer(a, b)
    return [(k, int(best[k])) for k in np.flatnonzero(best != np.arange(len(best))).tolist()]


def repeated_lines(rows: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Lines to remove from rows of doc, tie (tells texts of one doc apart) and text: doc, tie and line (number from 0).

    A line goes if an equal line stands earlier (smaller doc, or same document and smaller line), or one within one insertion, deletion
    or substitution, both of `min_chars` at least; lines are judged on the input, not on what is left. Lines of white space stay. Steps:

    1. Equal lines: the earliest place of every distinct line, by an aggregate.
    2. Distinct lines that share half a line with another one (pigeonhole): only these can have a partner, and only among those
       they share it with. Their texts are fetched, each document's lines in one pass over its text.
    3. Their deletion neighbourhoods as hashed keys. Equal variants with the same gap are one substitution apart; a variant that
       equals a whole line is one insertion or deletion away. Both hold for every pair that meets, so the earliest line of a key is
       a witness for all others, and no pairs are made inside a key. Lines sharing a half are joined where they meet; if those
       hold very many characters, their variants are spread over the cluster and joined by aggregates instead.
    4. Witnesses are verified by their edit distance.
    """
    cut = rows.select("doc", "tie", F.posexplode(F.split("text", "\n", -1)).alias("line", "s")).where(F.col("s").rlike(r"\S"))
    halves = F.when(F.length("s") >= min_chars, half_keys(F.col("s")))
    lines = cut.select(F.struct("doc", "tie", "line").alias("at"), F.xxhash64("s").alias("h1"), F.xxhash64("s", F.lit(1)).alias("h2"), halves.alias("halves"), F.length("s").alias("size"))
    first = materialize(lines.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.first("halves").alias("halves"), F.first("size").alias("size"), F.count(F.lit(1)).alias("n")))
    repeated = first.where("n > 1").select("h1", "h2", "first", "n")
    copies = join_per_key(lines.select("h1", "h2", "at"), repeated, ["h1", "h2"], _total(repeated)).where("at > first").select("at.*")

    keys = first.where("halves is not null").select("first", "size", F.explode(F.array_distinct("halves")).alias("key"))
    shared = materialize(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("chars")).where("n > 1"))
    maybe = join_per_key(keys, shared, "key", _total(shared)).groupBy("first.doc", "first.tie").agg(F.collect_list(F.struct("first.line", "key", (F.col("chars") > PLACE_CHARS).alias("many"))).alias("wanted"))
    maybe = maybe.select(F.col("doc").alias("d"), F.col("tie").alias("t"), "wanted")
    held = rows.select("doc", "tie", "text").join(maybe, F.col("doc").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("t")))
    fetched = _fetched(held)
    near = _joined_in_place(fetched.where("not many"))
    if not shared.where(F.col("chars") > PLACE_CHARS).isEmpty():
        near = near.unionByName(_joined_by_variant(materialize(fetched.where("many").select("at", "s").distinct())))
    return copies.unionByName(near)


def _total(one: DataFrame) -> int:
    return one.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _fetched(held: DataFrame) -> DataFrame:
    """The wanted lines of texts (doc, tie, text, wanted): at, key, many, s. A text is split once, however many of its lines are wanted."""
    kind = held.schema["doc"].dataType.simpleString()
    names = ["doc", "tie", "line", "key", "many", "s"]

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for k in range(part.num_rows):
                wanted = part.column("wanted")[k].values
                row = part.slice(k, 1)
                lines = pa.array(row.column("text")[0].as_py().split("\n"))
                columns = {c: wanted.field(c) for c in ("line", "key", "many")}
                for low in range(0, len(wanted), VARIANTS):
                    at = {c: x.slice(low, VARIANTS) for c, x in columns.items()}
                    size = len(at["line"])
                    own = [row.column(c).take(pa.array(np.zeros(size, np.int64))) for c in ("doc", "tie")]
                    yield pa.RecordBatch.from_arrays([*own, *at.values(), lines.take(at["line"])], names)

    made = held.select("doc", "tie", "text", "wanted").mapInArrow(fetch, f"doc {kind}, tie long, line int, key long, many boolean, s string")
    return made.select(F.struct("doc", "tie", "line").alias("at"), "key", "many", "s")


def _joined_in_place(fetched: DataFrame) -> DataFrame:
    """Lines (at, key, s) that have an earlier neighbour among those of the same key, joined key by key."""
    kind = fetched.schema["at"].dataType["doc"].dataType.simpleString()
    names = ["doc", "tie", "line"]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, tuple, str]] = []
        size, arrow = 0, None

        def found() -> pa.RecordBatch:
            order = sorted({x[1] for x in held}, key=lambda at: (at[0] is not None, at))
            number = {at: k for k, at in enumerate(order)}
            rank = np.array([number[x[1]] for x in held])
            rank[np.argsort(rank, kind="stable")] = np.arange(len(rank))  # a line may stand in several groups
            texts = [x[2] for x in held]
            pairs = earliest_neighbours(texts, rank, np.array([x[0] for x in held], np.int64))
            gone = sorted({number[held[k][1]] for k, by in pairs if texts[k] != texts[by] and within_one_edit(texts[k], texts[by])})
            columns = list(zip(*(order[k] for k in gone))) if gone else [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(columns[0], arrow), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32())], names)

        for batch in batches:
            arrow = batch.column("doc").type
            for key, doc, tie, line, s in zip(*(batch.column(c).to_pylist() for c in ("key", *names, "s"))):
                if size > PLACE_CHARS and held[-1][0] != key:
                    yield found()
                    held, size = [], 0
                held.append((key, (doc, tie, line), s))
                size += len(s)
        if held:
            yield found()

    ranged = fetched.select("key", "at.*", "s").repartition("key").sortWithinPartitions("key")
    return ranged.mapInArrow(join, f"doc {kind}, tie long, line int").distinct()


def _joined_by_variant(candidates: DataFrame) -> DataFrame:
    """The same among all of the lines (at, s), with one row for each variant."""
    where = candidates.schema["at"].dataType.simpleString()

    def variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, key, gap = [], [], []

        def sent(whole: pa.RecordBatch) -> pa.RecordBatch:
            made = [whole.column("at").take(pa.array(np.concatenate(row))), pa.array(np.concatenate(key)), pa.array(np.concatenate(gap), pa.int32())]
            row.clear(), key.clear(), gap.clear()
            return pa.RecordBatch.from_arrays(made, ["at", "key", "gap"])

        for whole in batches:
            for k, s in enumerate(whole.column("s")):
                own, gone = variant_keys(s.as_py())
                for start in range(-1, len(gone), VARIANTS):
                    stop = min(start + VARIANTS, len(gone))
                    gap.append(np.arange(start, stop))
                    key.append(gone[start:stop] if start >= 0 else np.concatenate([[own], gone[:stop]]))
                    row.append(np.full(stop - start, k))
                    if sum(map(len, row)) >= VARIANTS:
                        yield sent(whole)
            if row:
                yield sent(whole)

    spread = candidates.mapInArrow(variants, f"at {where}, key long, gap int")
    per_gap = materialize(spread.groupBy("key", "gap").agg(F.min("at").alias("least"), F.max("at").alias("most"), F.count(F.lit(1)).alias("n")))
    per_key = per_gap.groupBy("key").agg(
        F.sum("n").alias("n"),
        F.min(F.when(F.col("gap") < 0, F.col("least"))).alias("whole"),
        F.min(F.when(F.col("gap") >= 0, F.col("least"))).alias("deleter"),
        F.max((F.col("gap") >= 0) & (F.col("least") < F.col("most"))).alias("swaps"),
    )
    meets = per_key.where("swaps or (whole is not null and deleter is not null)")
    total = _total(per_gap)
    near = join_per_key(join_per_key(spread, meets, "key", total), per_gap.select("key", "gap", "least", "n"), ["key", "gap"], total)
    witness = F.when(F.col("gap") < 0, F.col("deleter")).otherwise(F.least("whole", "least"))
    pairs = near.select("at", witness.alias("by")).where("by < at").groupBy("at").agg(F.min("by").alias("by"))
    a, b = candidates.select("at", F.col("s").alias("mine")), candidates.select(F.col("at").alias("by"), F.col("s").alias("theirs"))
    return pairs.join(a, "at").join(b, "by").where(F.levenshtein("mine", "theirs", 1).between(0, 1)).select("at.*")


def dedup_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """All rows of docs with the repeated lines taken out of the text, and n_lines and n_removed.

    Lines of under `min_chars` code points go only if they are equal to an earlier one, lines of white space never. Rows equal in id and text count as one document and lose the same lines;
    rows with a null id come first in the order. Null texts stay null and have no lines; a line of any length is compared
    whole; an empty table gives no rows. The new columns replace columns of the same names.
    """
    rows = docs.drop("n_lines", "n_removed")
    single = rows.groupBy(doc).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    rows = rows.withColumn("__tie", F.lit(0).cast("long") if single else F.xxhash64(text_of(text)))
    plain = rows.select(F.col(doc).alias("doc"), F.col("__tie").alias("tie"), text_of(text).alias("text"))
    gone = repeated_lines(plain if single else plain.dropDuplicates(["doc", "tie"]), min_chars).groupBy("doc", "tie").agg(F.collect_set("line").alias("gone"))
    gone = gone.select(F.col("doc").alias("__doc"), F.col("tie").alias("__gone_tie"), F.col("gone").alias("__gone"))
    joined = rows.join(gone, rows[doc].eqNullSafe(gone["__doc"]) & (rows["__tie"] == gone["__gone_tie"]), "left").drop("__doc", "__tie", "__gone_tie")
    wanted = joined.selectExpr("*", "0L as n_lines", "0L as n_removed")
    schema = wanted.drop("__gone").schema

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            names = part.schema.names
            texts, total, removed = [], [], []
            for t, out in zip(part.column(names.index(text)).to_pylist(), part.column(names.index("__gone")).to_pylist()):
                lines = [] if t is None else t.split("\n")
                out = set(out or ())
                texts.append("\n".join(s for k, s in enumerate(lines) if k not in out) if out else t)
                total.append(len(lines))
                removed.append(len(out))
            columns = dict(zip(names, part.columns))
            columns |= {text: pa.array(texts, part.schema.field(text).type), "n_lines": pa.array(total, pa.int64()), "n_removed": pa.array(removed, pa.int64())}
            del columns["__gone"]
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return wanted.mapInArrow(keep, schema)
