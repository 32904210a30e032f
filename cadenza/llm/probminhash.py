"""Near-duplicate documents by ProbMinHash: signatures of weighted shingles, banding, exact verification, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import FEW_ROWS, HOT_SHARE, RangeHash, join_per_key, materialize, mix, steps, text_of, utf8
from cadenza.llm.components import connected_components

SHINGLE, THRESHOLD = 5, 0.8
#: Bands of so many registers each: a pair at the threshold shares a band with probability 1 - (1 - 0.8**5)**24 > 0.9999.
BANDS, PER_BAND = 24, 5
REGISTERS = BANDS * PER_BAND
#: How often every shared band draws a new centre, and how many of its centres a document is compared with each time.
ROUNDS, CENTRES = 3, 2
#: Band members that are compared as rows of pairs; larger bands are cut into blocks of about so many nodes and shingles.
FEW, BLOCK_NODES, BLOCK_SHINGLES = 32, 500, 1_000_000

#: Bytes of text that one numpy step sketches, and rows of small tables for one task.
STEP, ROWS_PER_TASK = 1 << 20, 200_000

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of every text: text number, hash and count, by text; and a hash of each text's word sequence (0: no word).

    Words are runs of ASCII letters (lower-cased), digits and everything beyond ASCII. A text of fewer words is one shingle.
    """
    data = _LOWER[data]
    letter = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = letter[1:] != letter[:-1]
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    real = letter[cuts[:-1]] if len(data) else np.zeros(0, bool)
    start, end = cuts[:-1][real], cuts[1:][real]
    doc = np.searchsorted(offsets, start, side="right") - 1
    words = RangeHash(data).of(start, end)
    n = len(offsets) - 1
    count = np.bincount(doc, minlength=n)
    first = np.cumsum(count) - count
    step = np.arange(len(words)) - first[doc]
    sequence = np.zeros(n, np.uint64)
    np.add.at(sequence, doc, mix(words ^ mix(step.astype(np.uint64) + np.uint64(11))))
    sequence = np.where(count > 0, mix(sequence ^ count.astype(np.uint64)), 0)
    whole = np.flatnonzero(step + size <= count[doc])
    gram = np.zeros(len(whole), np.uint64)
    for j in range(size):
        gram = gram * np.uint64(0xD6E8FEB86659FD93) + words[whole + j]
    short = np.flatnonzero((count > 0) & (count < size))
    hashes = np.concatenate([mix(gram), sequence[short]])
    owner = np.concatenate([doc[whole], short])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])]) if len(hashes) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return owner[at], hashes[at], np.diff(np.concatenate([at, [len(hashes)]])), sequence


def signatures(owner: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash of n weighted sets: for each register, the element whose Poisson process reaches it first.

    Every element arrives at exponential intervals of its weight's rate, each time at a register drawn at random. All elements of all
    sets advance together; one whose latest arrival is later than every register of its set has stopped. Two sets agree in a
    register with a probability that is their probability Jaccard similarity.
    """
    earliest = np.full(n * registers, np.inf)
    winner = np.zeros(n * registers, np.uint64)
    live, time, turn = np.arange(len(hashes)), np.zeros(len(hashes)), 0
    while len(live):
        turn += 1
        drawn = mix(mix(hashes[live]) ^ mix(np.uint64([turn])))
        uniform = ((drawn >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53
        time = time - np.log(uniform) / weights[live]
        slot = owner[live] * registers + (mix(drawn) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(earliest, slot, time)
        won = earliest[slot] == time
        winner[slot[won]] = hashes[live[won]]
        latest = earliest.reshape(n, registers).max(axis=1)
        going = time < latest[owner[live]]
        live, time = live[going], time[going]
    return winner.reshape(n, registers)


def band_keys(winner: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One hash for each band of each signature."""
    parts = winner.reshape(len(winner), bands, -1)
    key = np.zeros(parts.shape[:2], np.uint64)
    for j in range(parts.shape[2]):
        key = mix(key + parts[:, :, j])
    return mix(key ^ np.arange(bands, dtype=np.uint64)[None, :]).view(np.int64)


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Exact probability Jaccard similarity of two weighted sets (sorted distinct elements a, b with weights x, y)."""
    both, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    u, v = x[i].astype(float), y[j].astype(float)
    only_a, only_b = x.sum() - u.sum(), y.sum() - v.sum()
    ratio = u / v
    order = np.argsort(-ratio, kind="stable")
    u, v, ratio = u[order], v[order], ratio[order]
    # for a common element: others with a larger ratio count by their weight in a, the rest by theirs in b
    above = only_a + np.cumsum(u)
    below = only_b + v.sum() - np.cumsum(v)
    return float((1 / (above / u + below / v)).sum())


def _sketch(docs: DataFrame) -> DataFrame:
    """doc, tie, node (hash of the word sequence, null without words) and its band keys."""
    kind = docs.schema["doc"].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, "text", STEP):
            owner, hashes, count, sequence = shingles(*utf8(part.column("text")))
            # texts that are equal in this step are sketched once
            shown, first = np.unique(sequence, return_index=True)
            place = np.full(len(sequence), -1)
            place[first] = np.arange(len(first))
            keep = place[owner] >= 0
            keys = band_keys(signatures(place[owner[keep]], hashes[keep], count[keep].astype(float), len(first)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.ravel()))
            which = np.searchsorted(shown, sequence)
            nodes = pa.array(sequence.view(np.int64), mask=sequence == 0)
            yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("tie"), nodes, lists.take(pa.array(which))], ["doc", "tie", "node", "bands"])

    return docs.mapInArrow(make, f"doc {kind}, tie long, node long, bands array<long>")


def _weighted(texts: DataFrame) -> DataFrame:
    """node, its sorted shingles, their counts and their number."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in steps(batches, "text", STEP):
            owner, hashes, count, sequence = shingles(*utf8(part.column("text")))
            bounds = pa.array(np.searchsorted(owner, np.arange(part.num_rows + 1)), pa.int32())
            size = pa.array(np.diff(bounds.to_numpy()), pa.int32())
            made = pa.RecordBatch.from_arrays([part.column("node"), pa.ListArray.from_arrays(bounds, pa.array(hashes.view(np.int64))), pa.ListArray.from_arrays(bounds, pa.array(count.astype(np.int32))), size], ["node", "shingles", "counts", "size"])
            yield made.filter(pa.array(sequence.view(np.int64) == part.column("node").to_numpy()))  # an id may have several texts

    return texts.mapInArrow(make, "node long, shingles array<long>, counts array<int>, size int")


def _with_shingles(pairs: DataFrame, total: int, weighted: DataFrame, side: str, other: str, names: tuple[str, str]) -> DataFrame:
    """`total` pairs with shingles and counts of one side. A node with more than one in HOT_SHARE of the pairs, of which there are HOT_SHARE
    at most, has its shingles repeated as often as that is exceeded, and its pairs are dealt over the copies."""
    one = weighted.select(F.col("node").alias(side), F.col("shingles").alias(names[0]), F.col("counts").alias(names[1]))
    if total <= FEW_ROWS:
        return pairs.join(one, side)
    hot = pairs.groupBy(side).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * HOT_SHARE > total)
    hot = F.broadcast(hot.select(side, F.ceil(F.col("n") * HOT_SHARE / total).cast("int").alias("times")))
    dealt = pairs.join(hot, side, "left").withColumn("copy", F.coalesce(F.pmod(F.xxhash64(other), "times").cast("int"), F.lit(0))).drop("times")
    copies = one.join(hot, side, "left").withColumn("copy", F.explode(F.sequence(F.lit(0), F.coalesce("times", F.lit(1)) - 1))).drop("times")
    return dealt.join(copies, [side, "copy"]).drop("copy")


def _verified(pairs: DataFrame, most: int, weighted: DataFrame, threshold: float) -> DataFrame:
    """The pairs a, b (`most` at most) and whether their similarity is at least the threshold (near)."""
    if most > FEW_ROWS:
        pairs = materialize(pairs)
        most = pairs.count()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                columns = [[np.asarray(v.values) for v in part.column(c)] for c in ("s", "x", "t", "y")]
                keep = [probability_jaccard(s.view(np.uint64), x, t.view(np.uint64), y) >= threshold for s, x, t, y in zip(*columns)]
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(keep, pa.bool_())], ["a", "b", "near"])

    sides = _with_shingles(_with_shingles(pairs, most, weighted, "a", "b", ("s", "x")), most, weighted, "b", "a", ("t", "y"))
    return sides.mapInArrow(check, "a long, b long, near boolean")


def block_links(key: int, part: np.ndarray, label: np.ndarray, bands: np.ndarray, size: np.ndarray, hashes: np.ndarray, counts: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links that join the classes of one block of a band, or of two blocks (part 0 and 1), as pairs of positions.

    Every pair of different classes is compared in the first band that it shares. The common mass of two sets, each of mass 1, is
    never less than their similarity, so the exact one is taken only where that mass reaches the threshold.
    """
    n = len(label)
    owner = np.repeat(np.arange(n), size)
    end = np.cumsum(size)
    share = counts / np.bincount(owner, counts, n)[owner]
    known, ids = np.unique(hashes, return_inverse=True)
    mine = np.zeros(len(known))
    label, order = label.copy(), np.arange(n)
    band = int(np.argmax(bands[0] == key))
    first = part == 0
    across = not first.all()
    out = []
    for i in np.flatnonzero(first).tolist():
        others = (label != label[i]) & (~first if across else order > i)
        if not others.any():
            continue
        others &= (bands == bands[i]).argmax(axis=1) == band
        if not others.any():
            continue
        at = slice(end[i] - size[i], end[i])
        mine[ids[at]] = share[at]
        mass = np.bincount(owner, np.minimum(mine[ids], share), n)
        mine[ids[at]] = 0
        for j in np.flatnonzero(others & (mass >= threshold - 1e-9)).tolist():
            to = slice(end[j] - size[j], end[j])
            if label[i] != label[j] and probability_jaccard(ids[at], counts[at], ids[to], counts[to]) >= threshold:
                out.append((i, j))
                label[label == label[j]] = label[i]
    return out


def _linked_in_blocks(cells: DataFrame, threshold: float) -> DataFrame:
    """Links a, b of all cells: rows of key, low and high (two blocks of a band, or one twice), part, node, label, bands, shingles, counts."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        cell = None

        def found() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=sum(b.num_rows for b in held))[0]
            node, label, part = (rows.column(c).to_numpy() for c in ("node", "label", "part"))
            lists = rows.column("shingles")
            bands = rows.column("bands").flatten().to_numpy().reshape(len(node), -1)
            pairs = block_links(cell[0], part, label, bands, np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy().view(np.uint64), rows.column("counts").flatten().to_numpy(), threshold)
            i, j = np.array(pairs, np.int64).reshape(-1, 2).T
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            names = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "low", "high")], axis=1)
            starts = np.concatenate([[0], np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1, [len(names)]]).tolist()
            for start, stop in zip(starts, starts[1:]):
                if held and cell != tuple(names[start].tolist()):
                    yield found()
                    held = []
                cell = tuple(names[start].tolist())
                held.append(batch.slice(start, stop - start))
        if held:
            yield found()

    at = ["key", "low", "high"]
    return cells.repartition(*at).sortWithinPartitions(*at).mapInArrow(join, "a long, b long")


def _links_left(members: DataFrame, sketch: DataFrame, weighted: DataFrame, label: DataFrame | None, tried: DataFrame | None, threshold: float, total: int) -> DataFrame:
    """Links a, b among all members of a band that are still in different classes, without those tried."""
    tasks = total // ROWS_PER_TASK + 1
    here = members.select("key", "node").coalesce(tasks)
    here = here.withColumn("label", F.col("node")) if label is None else here.join(label, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label")).coalesce(tasks)
    mixed = here.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("n")).where("x < y").select("key", "n").coalesce(tasks)
    sized = mixed.withColumn("size", F.col("n"))
    apart = materialize(join_per_key(here, sized, "key", total).select("key", "node", "label", F.col("size").alias("n")).coalesce(tasks))
    few = apart.where(F.col("n") <= FEW)
    one, two = (few.select("key", F.col("node").alias(x), F.col("label").alias(y)) for x, y in (("a", "p"), ("b", "q")))
    pairs = one.join(two, "key").where("a < b and p <> q").select("a", "b").distinct().coalesce(tasks)
    if tried is not None:
        pairs = pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti").coalesce(tasks)
    links = _verified(pairs, total * FEW // 2, weighted, threshold).where("near").select("a", "b")
    many = apart.where(F.col("n") > FEW)
    if many.isEmpty():
        return links
    sizes = many.join(weighted.select("node", "size"), "node").groupBy("key").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_NODES), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n"))
    own = join_per_key(many.drop("n"), sizes, "key", total).select("key", "node", "label", "blocks", F.pmod(F.xxhash64("node", "key"), "blocks").cast("int").alias("own"))
    cells = own.select("key", "node", "label", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = cells.select("key", "node", "label", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).cast("int").alias("part"))
    bands = sketch.join(many.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("bands").alias("bands"))
    return links.unionByName(_linked_in_blocks(cells.join(bands, "node").join(weighted.drop("size"), "node"), threshold))


def near_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, rounds: int = ROUNDS, centres: int = CENTRES) -> DataFrame:
    """Class of every document: doc_id, class_id (least doc_id of its class) and representative (one row's text of each class).

    Classes are the components of the pairs whose five-word shingles, weighted by their counts, have a probability Jaccard
    similarity of at least the threshold.

    1. Texts of equal word sequence are one node, found by an aggregate; later steps see each text once.
    2. Nodes that share a band are candidates. First without pairs inside a band: each time, every band draws a centre by hash, and a
       member that is not yet in the centre's class is compared with those of its centres that it shares most bands with. That joins
       dense classes.
    3. Compared pairs are verified by their exact similarity; classes are joined by connected components.
    4. Members of a band that are still in different classes are then all compared: as pairs in small bands, block against block in
       large ones. So every two nodes that share a band are compared or already in one class, and rounds and centres only save work.

    Null texts and texts without a word are in no class but their own, which has their own id; rows with a null id have the class of
    their text, or a null one if it is theirs alone. Repeated rows each return their class; an empty table gives no rows; other
    columns are ignored; texts of any length are shingled whole.
    """
    rows = docs.select(F.col(doc).alias("doc"), text_of(text).alias("text"))
    sketch = materialize(_sketch(rows.withColumn("tie", F.xxhash64("text"))))
    named = sketch.where("node is not null")
    nodes = materialize(named.groupBy("node").agg(F.min("doc").alias("doc"), F.first("bands").alias("bands")))
    keys = nodes.select("node", "doc", F.explode("bands").alias("key"))
    shared = materialize(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    total = shared.agg(F.sum("n").alias("n")).first()["n"] or 0
    members = materialize(join_per_key(keys, shared, "key", total).select("key", "node", "doc"))
    # one text of every node that has a candidate
    wanted = members.select("node", "doc").distinct().select(F.col("node").alias("want"), F.col("doc").alias("d"))
    texts = rows.join(wanted, F.col("doc").eqNullSafe(F.col("d"))).select(F.col("want").alias("node"), "text")
    weighted = materialize(_weighted(texts).dropDuplicates(["node"]))
    tried = label = None
    tasks = total // ROWS_PER_TASK + 1  # small tables stay in few partitions
    for turn in range(rounds):
        here = members.select("key", "node").coalesce(tasks)
        here = here.withColumn("label", F.col("node")) if label is None else here.join(label, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label")).coalesce(tasks)
        centre = here.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", "key", F.lit(turn)), F.col("node").alias("c"), F.col("label").alias("of"))).alias("m"), F.count(F.lit(1)).alias("n")).select("key", "m.c", "m.of", "n").coalesce(tasks)
        tries = join_per_key(here, centre, "key", total).where("label <> of").groupBy("node", "c").agg(F.count(F.lit(1)).alias("n")).coalesce(tasks)
        best = F.row_number().over(Window.partitionBy("node").orderBy(F.col("n").desc(), F.xxhash64("node", "c")))
        pairs = tries.withColumn("k", best).where(F.col("k") <= centres).select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b")).coalesce(tasks).distinct().coalesce(tasks)
        checked = materialize(_verified(pairs, total * centres, weighted, threshold))
        tried = checked if tried is None else tried.unionByName(checked)
        found = checked.where("near").select("a", "b")
        if found.isEmpty():
            break
        # a class is as good as a star for the next turn, and has as many edges as nodes
        stars = None if label is None else label.select(F.col("node").alias("a"), F.col("label").alias("b"))
        label = materialize(connected_components(found if stars is None else stars.unionByName(found)).withColumnRenamed("component", "label"))
    left = materialize(_links_left(members, sketch, weighted, label, tried, threshold, total))
    if not left.isEmpty():
        stars = None if label is None else label.select(F.col("node").alias("a"), F.col("label").alias("b"))
        label = materialize(connected_components(left if stars is None else stars.unionByName(left)).withColumnRenamed("component", "label"))
    if label is None:
        label = named.select("node", F.col("node").alias("label")).limit(0)
    classes = nodes.join(label, "node", "left").select("node", "doc", F.coalesce("label", "node").alias("label"))
    least = classes.groupBy("label").agg(F.min("doc").alias("class_id"), F.min(F.when(F.col("doc").isNotNull(), F.struct("doc", "node"))).alias("m"), F.min("node").alias("any"))
    chosen = classes.join(least, "label").select("node", "class_id", (F.col("node") == F.coalesce("m.node", "any")).alias("chosen"))
    # of a node's rows, those of the least id and, among these, the least tie
    holder = named.groupBy("node").agg(F.min("doc").alias("least"))
    ties = named.join(holder, "node").where(F.col("doc").eqNullSafe(F.col("least"))).groupBy("node").agg(F.min("tie").alias("least_tie"), F.first("least").alias("least"))
    about = chosen.join(ties, "node")
    first = F.col("chosen") & F.col("doc").eqNullSafe(F.col("least")) & (F.col("tie") == F.col("least_tie"))
    alone = F.col("node").isNull()
    return sketch.select("doc", "tie", "node").join(about, "node", "left").select(F.col("doc").alias("doc_id"), "tie", F.when(alone, F.col("doc")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, True).otherwise(first).alias("representative"))


def keep_representatives(docs: DataFrame, doc: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class of near-duplicates, the least id's, with all columns of docs. Rows without a word stay; of rows equal
    in id and text, one does."""
    kept = near_duplicates(docs, doc, text, threshold).where("representative").select(F.col("doc_id").alias("__doc"), F.col("tie").alias("__kept"))
    rows = docs.withColumn("__tie", F.xxhash64(text_of(text)))
    kept = kept.distinct()
    found = rows.join(kept, F.col(doc).eqNullSafe(F.col("__doc")) & (F.col("__tie") == F.col("__kept")), "left_semi")
    return found.dropDuplicates([doc, "__tie"]).drop("__tie")
