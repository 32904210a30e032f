"""Chord progressions: merged sequences, scale-degree numbers, repeated patterns, vamps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from cadenza.functions.names import chord_label, chord_quality, chord_root, nashville


def by(order: str = "pos") -> WindowSpec:
    """Rows of a song in order."""
    return Window.partitionBy("song_id").orderBy(order)


def plain(made: pd.DataFrame) -> pd.DataFrame:
    """Rows whose song ids are Python objects: ids that were put together from several songs don't go to Arrow as one array."""
    return made.assign(song_id=made["song_id"].astype(object))


def whole(held: list[pd.DataFrame]) -> pd.DataFrame:
    """The parts of a song as one; most songs have one part, which isn't copied."""
    return held[0] if len(held) == 1 else pd.concat(held)


def song_by_song(rows: DataFrame, order: str, call: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A call for each song's rows in order: songs are dealt and sorted by Spark, and a task walks through its songs batch by batch, so
    that small songs cost no call of their own into Python; it holds one song and one batch at a time."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        last: object = held  # no song
        for batch in batches:
            songs = [None if missing else s for s, missing in zip(batch["song_id"].tolist(), batch["song_id"].isna().tolist())]
            starts = [k for k, s in enumerate(songs) if s != (songs[k - 1] if k else last)]
            done = []
            for k, (start, stop) in enumerate(zip([0, *starts], [*starts, len(songs)])):
                if k and held:
                    done.append(call(whole(held)))
                    held = []
                if start < stop:
                    held.append(batch.iloc[start:stop])
            if done:
                yield plain(pd.concat(done))
            last = songs[-1] if songs else last
        if held:
            yield plain(call(whole(held)))

    return rows.repartition("song_id").sortWithinPartitions("song_id", order).mapInPandas(walk, schema)


def islands(rows: DataFrame, same: Column, order: str = "pos", name: str = "island") -> DataFrame:
    """Number the maximal runs of consecutive rows that are each `same` as the row before."""
    upto = by(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(upto))


def chord_sequence(chords: DataFrame) -> DataFrame:
    """Labelled chords with equal neighbours merged: start of the first, end of the last; the confidence is folded pairwise."""
    rows = chords.withColumn("chord", chord_label(F.col("root"), F.col("quality")))
    rows = islands(rows, F.col("chord") == F.lag("chord").over(by()))
    parts = F.sort_array(F.collect_list(F.struct("pos", "confidence")))
    folded = F.aggregate(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0))), F.col("parts")[0]["confidence"], lambda c, x: (c + x["confidence"]) / 2)
    first = lambda c: F.min_by(c, "pos").alias(c)
    merged = rows.groupBy("song_id", "island").agg(*(first(c) for c in ("chord", "root", "quality", "start", "bar", "key_tonic", "key_mode")), F.max_by("end", "pos").alias("end"), parts.alias("parts"))
    return merged.select("song_id", (F.col("island") - 1).cast("int").alias("pos"), "chord", "root", "quality", "start", "end", (F.col("end") - F.col("start")).alias("duration"), folded.alias("confidence"), "bar", "key_tonic", "key_mode")


def add_nashville(sequence: DataFrame, song_key: DataFrame | None = None) -> DataFrame:
    """Number of every chord in its local key, else in the song's key (song_id, tonic)."""
    rows = sequence if song_key is None else sequence.join(song_key.select("song_id", F.col("tonic").alias("__tonic")), "song_id", "left")
    tonic = F.col("key_tonic") if song_key is None else F.coalesce("key_tonic", "__tonic")
    return rows.withColumn("nashville", nashville(F.col("root"), F.col("quality"), tonic)).drop("__tonic")


def n_grams(sequence: DataFrame, lengths: range, symbol: str = "chord", least: int = 1) -> DataFrame:
    """Every run of consecutive items of each length: song_id, pos, n, pattern, and the first item's start and last one's end.

    Runs whose shortest beginning comes fewer than `least` times in the song, which then can't come more often themselves, are left
    out before anything is made of them: beginnings are counted by a 64-bit hash, and equal hashes only let more runs through.
    """
    longest = max(lengths)
    ahead = by().rowsBetween(0, longest - 1)
    rows = sequence.select("song_id", "pos", F.col(symbol).alias("s"), "nashville", "start", "end")
    if least > 1:
        begins = F.xxhash64("s", *(F.lead("s", k).over(by()) for k in range(1, min(lengths))))
        rows = rows.withColumn("begins", begins).withColumn("often", F.count(F.lit(1)).over(Window.partitionBy("song_id", "begins")) >= least)
    rows = rows.withColumn("ahead", F.collect_list(F.struct("s", "nashville", "end")).over(ahead))
    rows = rows.where("often") if least > 1 else rows
    rows = rows.withColumn("n", F.explode(F.filter(F.array(*(F.lit(n) for n in lengths)), lambda n: n <= F.size("ahead"))))
    part = F.slice("ahead", 1, F.col("n"))
    return rows.select("song_id", "pos", "n", F.transform(part, lambda x: x["s"]).alias("pattern"), F.transform(part, lambda x: x["nashville"]).alias("numbers"), "start", F.element_at("ahead", F.col("n"))["end"].alias("stop"))


def repeated_patterns(sequence: DataFrame, shortest: int = 4, longest: int = 8, least: int = 2) -> DataFrame:
    """Patterns that occur at least twice in a song (overlaps count): occurrences, first place, numbers there, all places with theirs."""
    grams = n_grams(sequence, range(shortest, longest + 1), least=least)
    found = grams.groupBy("song_id", "pattern").agg(
        F.first("n").alias("length"), F.count(F.lit(1)).alias("occurrences"), F.min("pos").alias("first_pos"), F.min_by("numbers", "pos").alias("numbers"), F.sort_array(F.collect_list(F.struct("pos", "start", "stop", "numbers"))).alias("locations")
    )
    return found.where(F.col("occurrences") >= least)


def maximal_patterns(patterns: DataFrame) -> DataFrame:
    """Repeated patterns that no longer repeated pattern contains. A contained one is the head or tail of one that is one longer.

    Every pattern goes out once as itself and twice as what it contains, by a 64-bit hash, so one grouping of numbers decides.
    """
    own = F.struct("pattern", *(c for c in patterns.columns if c not in ("song_id", "pattern")))
    kind = patterns.select(own.alias("own")).schema["own"].dataType
    part = lambda first: F.struct(F.xxhash64(F.slice("pattern", F.lit(first), F.col("length") - 1)).alias("h"), F.lit(None).cast(kind).alias("own"))
    each = patterns.select("song_id", F.explode(F.array(F.struct(F.xxhash64("pattern").alias("h"), own.alias("own")), part(1), part(2))).alias("e"))
    found = each.groupBy("song_id", "e.h").agg(F.first("e.own", ignorenulls=True).alias("own"), F.count(F.lit(1)).alias("n"))
    return found.where("own is not null and n = 1").select("song_id", "own.*")


def stabilize_chords(sequence: DataFrame, shortest: float = 0.65) -> DataFrame:
    """Short chords between two equal neighbours take the neighbours' name, left to right; then equal runs merge.

    In a run of neighbouring candidates only every other one changes, beginning with the first. Songs of under three items stay.
    """
    before, after = F.lag("chord").over(by()), F.lead("chord").over(by())
    glitch = (before == after) & (F.col("chord") != before) & (F.col("duration") > 0) & (F.col("duration") < shortest)
    rows = sequence.withColumn("glitch", F.coalesce(glitch, F.lit(False))).withColumn("before", before).withColumn("items", F.count(F.lit(1)).over(Window.partitionBy("song_id")))
    rows = islands(rows, F.col("glitch") & F.lag("glitch").over(by()))
    nth = F.row_number().over(Window.partitionBy("song_id", "island").orderBy("pos"))
    rows = rows.withColumn("nth", nth).withColumn("chord", F.when(F.col("glitch") & (F.col("nth") % 2 == 1) & (F.col("items") >= 3), F.col("before")).otherwise(F.col("chord")))
    rows = islands(rows.drop("island"), (F.col("chord") == F.lag("chord").over(by())) & (F.col("items") >= 3))
    out = rows.groupBy("song_id", "island").agg(F.min_by("chord", "pos").alias("chord"), F.min("start").alias("start"), F.max_by("end", "pos").alias("end"))
    return out.select("song_id", (F.col("island") - 1).cast("int").alias("pos"), "chord", chord_root(F.col("chord")).alias("root"), chord_quality(F.col("chord")).alias("quality"), "start", "end", (F.col("end") - F.col("start")).alias("duration"))


def chord_statistics(sequence: DataFrame) -> DataFrame:
    """Number of items before and after stabilising, of different chords, and counts per chord after it."""
    counts = stabilize_chords(sequence).groupBy("song_id", "chord").agg(F.count(F.lit(1)).alias("n"))
    after = counts.groupBy("song_id").agg(F.sum("n").alias("stabilized"), F.count(F.lit(1)).alias("different"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("chord", "n")))).alias("counts"))
    return sequence.groupBy("song_id").agg(F.count(F.lit(1)).alias("original")).join(after, "song_id")


def alternating_vamps(sequence: DataFrame, least: int = 4) -> DataFrame:
    """Longest A-B-A-B runs of at least four items, none overlapping an earlier one: song_id, first_pos, length, a, b. Items are
    compared by their number, or by name where they have none."""
    sequence = sequence.withColumn("chord", F.coalesce("nashville", "chord"))
    one, two = F.lag("chord", 1).over(by()), F.lag("chord", 2).over(by())
    rows = sequence.withColumn("goes", F.coalesce((F.col("chord") == two) & (F.col("chord") != one), F.lit(False)))
    rows = islands(rows, F.col("goes") == F.lag("goes").over(by())).where("goes")
    run = rows.groupBy("song_id", "island").agg((F.min("pos") - 2).alias("first"), (F.count(F.lit(1)) + 2).alias("length"))
    runs = run.groupBy("song_id").agg(F.sort_array(F.collect_list(F.struct("first", "length"))).alias("runs"))
    # a run that shares its first item with one that was kept starts one later
    start = F.struct(F.lit(-1).cast("int").alias("end"), F.array().cast("array<struct<first:int,length:bigint>>").alias("kept"))

    def step(state: Column, run: Column) -> Column:
        late = F.when(run["first"] <= state["end"], 1).otherwise(0)
        length = run["length"] - late
        keep = length >= least
        at = F.struct((run["first"] + late).cast("int").alias("first"), length.alias("length"))
        return F.struct(F.when(keep, (run["first"] + run["length"] - 1).cast("int")).otherwise(state["end"]).alias("end"), F.when(keep, F.array_append(state["kept"], at)).otherwise(state["kept"]).alias("kept"))

    kept = runs.select("song_id", F.explode(F.aggregate("runs", start, step)["kept"]).alias("r")).select("song_id", F.col("r.first").alias("first_pos"), "r.length")
    a = sequence.select("song_id", F.col("pos").alias("first_pos"), F.col("chord").alias("a"), F.lead("chord").over(by()).alias("b"))
    return kept.join(a, ["song_id", "first_pos"])


def repeated_regions(sequence: DataFrame, length: int = 4, least: int = 2) -> DataFrame:
    """Runs of four numbers that occur at least twice: signature, occurrences, first place."""
    grams = n_grams(sequence, range(length, length + 1), "nashville", least)
    found = grams.groupBy("song_id", F.col("pattern").alias("signature")).agg(F.count(F.lit(1)).alias("occurrences"), F.min("pos").alias("first_pos"))
    return found.where(F.col("occurrences") >= least)


def rotation_merged_regions(regions: DataFrame) -> DataFrame:
    """Signatures that are rotations of each other as one group, under the signature that occurs first."""
    turned = F.transform(F.sequence(F.lit(1), F.size("signature")), lambda k: F.concat(F.slice("signature", k, F.size("signature")), F.slice("signature", 1, k - 1)))
    rows = regions.withColumn("least", F.array_min(turned))
    return rows.groupBy("song_id", "least").agg(F.min_by("signature", "first_pos").alias("signature"), F.sum("occurrences").alias("occurrences"), F.min("first_pos").alias("first_pos"), F.count(F.lit(1)).alias("variants")).drop("least")


def compress_runs(sequence: DataFrame, symbol: str = "chord") -> DataFrame:
    """One text per song: neighbouring equal items once, with a count; null as a question mark."""
    rows = sequence.select("song_id", "pos", F.coalesce(symbol, F.lit("?")).alias("s"))
    rows = islands(rows, F.col("s") == F.lag("s").over(by()))
    run = rows.groupBy("song_id", "island").agg(F.first("s").alias("s"), F.count(F.lit(1)).alias("n"))
    text = F.when(F.col("n") > 1, F.concat("s", F.lit(" ×"), F.col("n").cast("string"))).otherwise(F.col("s"))
    runs = run.select("song_id", F.struct("island", text.alias("text")).alias("r")).groupBy("song_id").agg(F.sort_array(F.collect_list("r")).alias("runs"))
    return runs.select("song_id", F.array_join(F.transform("runs", lambda r: r["text"]), " ").alias("text"))
