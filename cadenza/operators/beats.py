"""Beats, tempo, meter and bars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from cadenza.functions import tables as T
from cadenza.functions.names import lookup
from cadenza.operators.progression import by, song_by_song

MAX_LAG = 16
#: Frames of a song that one window holds besides the halo; longer songs spread over as many tasks.
RANGE = 4096


def ranged(frames: DataFrame, halo: int, size: int | None = None) -> DataFrame:
    """Frames with the range that they stand in or lie within `halo` frames of, once for each, and whether it is their own.

    A window over (song_id, range) that reaches no farther than the halo is right for the range's own frames.
    """
    size = size or RANGE
    halo = F.lit(halo)
    into = F.sequence(F.floor((F.col("frame") - halo) / size), F.floor((F.col("frame") + halo) / size))
    return frames.withColumn("range", F.explode(into)).withColumn("own", F.floor(F.col("frame") / size) == F.col("range"))


def near_frames() -> WindowSpec:
    return Window.partitionBy("song_id", "range").orderBy("frame")


def beat_accents(frames: DataFrame, beats: DataFrame, reach: int = 2, columns: tuple[str, ...] = ("low_env", "onset_env")) -> DataFrame:
    """Beats with the largest value of each envelope within `reach` frames; one sort of the frames, range by range, serves all columns."""
    near = near_frames().rangeBetween(-reach, reach)
    rows = ranged(frames.select("song_id", "frame", *columns), reach)
    peaks = rows.select("song_id", "frame", "own", *(F.max(c).over(near).alias(f"acc_{c}") for c in columns)).where("own").drop("own")
    return beats.join(peaks, ["song_id", "frame"], "left")


def middle(values: Column) -> Column:
    """Median of an array of numbers, the mean of both in the middle if their number is even; nulls don't count.

    For a few values in each of many groups, where one collected array costs less than a percentile for each of its places.
    """
    known = F.sort_array(F.filter(values, lambda x: x.isNotNull()))
    return F.get(F.transform(F.array(known), lambda v: F.try_divide(F.get(v, F.floor((F.size(v) - 1) / 2).cast("int")) + F.get(v, F.floor(F.size(v) / 2).cast("int")), F.lit(2.0))), F.lit(0))


def beat_intervals(beats: DataFrame, n_frames: DataFrame) -> DataFrame:
    """Beats with from and to: up to the next beat; the last one repeats the last spacing, inside the song."""
    gap = F.col("frame") - F.lag("frame").over(by("beat"))
    to = F.coalesce(F.lead("frame").over(by("beat")), F.col("frame") + F.coalesce(gap, F.lit(1)))
    rows = beats.join(n_frames.select("song_id", "n"), "song_id")
    return rows.withColumn("from", F.col("frame")).withColumn("to", F.least(to, F.col("n")))


def beat_chroma(frames: DataFrame, beats: DataFrame, column: str = "chroma") -> DataFrame:
    """Twelve numbers per beat: the median of its frames if there are more than two, else the mean."""
    return beat_medians(frames, beats, (column,), frames.groupBy("song_id").agg((F.max("frame") + 1).alias("n")))


def beat_medians(frames: DataFrame, beats: DataFrame, columns: tuple[str, ...], n_frames: DataFrame) -> DataFrame:
    """The same for several columns in one pass over the frames (song_id, n: how many a song has).

    Intervals become frame numbers and join by equality, so a long song spreads over tasks. An empty one takes the frame it starts at,
    the song's last one if it starts beyond.
    """
    first = F.greatest(F.lit(0), F.least(F.col("from"), F.col("n") - 1))
    spans = beat_intervals(beats, n_frames).withColumn("from", first).withColumn("to", F.greatest(F.col("from") + 1, F.least("to", "n")))
    each = spans.select("song_id", "beat", F.explode(F.sequence("from", F.col("to") - 1)).alias("frame"))
    rows = each.join(frames.select("song_id", "frame", *columns), ["song_id", "frame"])
    found = rows.groupBy("song_id", "beat").agg(*(F.collect_list(c).alias(c) for c in columns))
    # of one or two values the median is the mean
    return found.select("song_id", "beat", *(F.array(*(middle(F.transform(c, lambda v: v[i])) for i in range(12))).alias(c) for c in columns))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def beat_novelty(beats: DataFrame) -> DataFrame:
    """Beats with novelty: one less the cosine to the beat before, half from chroma and half from bass; 0 for the first."""
    change = lambda c: F.when(F.lag(c).over(by("beat")).isNotNull(), 1 - cosine(F.lag(c).over(by("beat")), F.col(c))).otherwise(0.0)
    return beats.withColumn("novelty", 0.5 * change("chroma") + 0.5 * change("bass"))


def zscore(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Columns of z-scores by song (population deviation), all 0 where a song's values are equal."""
    whole = Window.partitionBy("song_id")
    for column, name in columns.items():
        spread = F.stddev_pop(column).over(whole)
        df = df.withColumn(name, F.when(spread > 1e-12, (F.col(column) - F.avg(column).over(whole)) / spread).otherwise(0.0))
    return df


def frame_blocks(frames: DataFrame, columns: tuple[str, ...], before: int, after: int, size: int | None = None) -> DataFrame:
    """One row per block of a song's frames: song_id, block, first (number of the first frame in it) and an array per column, with so
    many frames more before and after; and of each column the song's mean and deviation (mean_, sd_), of the song its number of frames.

    Frames move once, by song and block; what is known of a whole song meets blocks, not frames.
    """
    size = size or 2 * RANGE
    into = F.sequence(F.greatest(F.lit(0), F.floor((F.col("frame") - after) / size)), F.floor((F.col("frame") + before) / size))
    rows = frames.select("song_id", F.explode(into).alias("block"), F.struct("frame", *(F.col(c).cast("double").alias(c) for c in columns)).alias("x"))
    blocks = rows.groupBy("song_id", "block").agg(F.sort_array(F.collect_list("x")).alias("x"))
    whole = frames.groupBy("song_id").agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{n}_{c}") for c in columns for f, n in ((F.avg, "mean"), (F.stddev_pop, "sd"))), F.covar_pop(*columns[:2]).alias("both"))
    arrays = (F.col(f"x.{c}").alias(c) for c in columns)
    return blocks.select("song_id", "block", (F.col("block") * size).alias("begin"), ((F.col("block") + 1) * size).alias("end"), F.col("x")[0]["frame"].alias("first"), *arrays).join(whole, "song_id")


def standard(row: pd.Series, column: str) -> np.ndarray:
    """A block's column as z-scores of its song."""
    x, sd = np.asarray(row[column], float), row[f"sd_{column}"]
    return (x - row[f"mean_{column}"]) / sd if sd > 0 else np.zeros(len(x))


def peaks_of(x: np.ndarray) -> np.ndarray:
    """Places higher than both sides; a level counts as one place, in its middle."""
    if not len(x):
        return np.zeros(0, np.int64)
    edge = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    level, last = x[edge], np.concatenate([edge[1:], [len(x)]]) - 1
    inner = np.arange(1, len(edge) - 1)
    top = inner[(level[inner] > level[inner - 1]) & (level[inner] > level[inner + 1])]
    return (edge[top] + last[top]) // 2


def apart(at: np.ndarray, height: np.ndarray, distance: int) -> np.ndarray:
    """Which of the ordered places stay if the tallest of those closer than the distance do; the later one on ties. Groups that lie
    apart don't meet, so the work grows with the places."""
    kept = np.ones(len(at), bool)
    for own in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) >= distance) + 1):
        for k in own[np.argsort(height[own], kind="stable")[::-1]] if len(own) > 1 else ():
            if kept[k]:
                close = np.abs(at[own] - at[k]) < distance
                close[k - own[0]] = False
                kept[own[close]] = False
    return kept


def onset_peaks(frames: DataFrame) -> DataFrame:
    """Strong onsets: song_id, frame. Peaks of the summed z-scores of both envelopes above mean + 0.8 deviations, at least five
    frames apart (the tallest stay), of these the upper three tenths.

    Peaks are found block by block, with a quarter of a block more at either side (a level held for longer is no peak); only peaks meet
    by song.
    """
    guard = RANGE // 4
    kind = frames.schema["song_id"].dataType.simpleString()

    def peaks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: list[tuple[object, np.ndarray, np.ndarray]] = []
            for _, row in batch.iterrows():
                x = standard(row, "low_env") + standard(row, "onset_env")
                sd = [row[f"sd_{c}"] for c in ("low_env", "onset_env")]
                spread = sum(s > 0 for s in sd) + (2 * row["both"] / (sd[0] * sd[1]) if min(sd) > 0 else 0)
                at = peaks_of(x)
                at = at[x[at] >= 0.8 * np.sqrt(max(0.0, spread))]
                frame = at + row["first"]
                mine = (frame >= row["begin"]) & (frame < row["end"])
                found.append((row["song_id"], frame[mine].astype(np.int32), x[at[mine]]))
            if found:  # one answer to a batch, not one to every block
                songs = [song for song, at, _ in found for _ in range(len(at))]
                yield pd.DataFrame({"song_id": pd.Series(songs, dtype=object), "frame": np.concatenate([at for _, at, _ in found]), "height": np.concatenate([x for _, _, x in found])})

    def strong(pdf: pd.DataFrame) -> pd.DataFrame:
        at, height = pdf["frame"].to_numpy(), pdf["height"].to_numpy()
        stay = apart(at, height, 5)
        at, height = at[stay], height[stay]
        return pd.DataFrame({"song_id": pdf["song_id"].iloc[0], "frame": at[height >= np.quantile(height, 0.70)]})

    found = frame_blocks(frames, ("low_env", "onset_env"), guard, guard).mapInPandas(peaks, f"song_id {kind}, frame int, height double")
    return song_by_song(found, "frame", strong, f"song_id {kind}, frame int")


def median_gap(grid: DataFrame) -> DataFrame:
    """song_id and period: the median distance of neighbouring grid points in frames."""
    gap = F.col("frame") - F.lag("frame").over(by("frame"))
    return grid.withColumn("gap", gap).groupBy("song_id").agg(F.percentile("gap", F.lit(0.5)).alias("period"))


def grid_coverage(onsets: DataFrame, grid: DataFrame, share: float = 0.12, period: DataFrame | None = None, of: tuple[str, ...] = ("song_id",)) -> DataFrame:
    """Share of the onsets (song_id, frame) whose nearest grid point (song_id, frame as a number) is within a tolerance of the period:
    the grid's median one unless it is given (song_id, period). All three may have more columns that tell several grids of a song apart."""
    period = median_gap(grid) if period is None else period
    both = onsets.select(*of, F.col("frame").cast("double").alias("frame"), F.lit(True).alias("onset")).unionByName(grid.select(*of, F.col("frame").cast("double").alias("frame"), F.lit(False).alias("onset")))
    point = F.when(~F.col("onset"), F.col("frame"))
    # both look back, each in its order: a window to the end of the song would start anew at every row
    before, after = (F.last(point, ignorenulls=True).over(Window.partitionBy(*of).orderBy(order).rangeBetween(Window.unboundedPreceding, 0)) for order in (F.asc("frame"), F.desc("frame")))
    rows = both.withColumn("d", F.least(F.col("frame") - before, after - F.col("frame"))).where("onset").join(period, list(of))
    near = F.col("d") <= F.greatest(F.lit(1.0), share * F.col("period"))
    return rows.groupBy(*of).agg(F.avg(F.when(near, 1.0).otherwise(0.0)).alias("coverage"))


def tempo_fold(beats: DataFrame, frame_s: float = T.HOP / T.SAMPLE_RATE) -> DataFrame:
    """Beats (frame, low, full; keep: leave this song's grid alone) halved from 160 a minute on (the half with the larger mean low plus
    mean full stays, the even one on ties) or doubled by whole-frame midpoints below 50; with the tempo measured again afterwards. Songs whose beats share a frame have no tempo and stay as they are."""
    gap = lambda: F.lead("frame").over(by("beat")) - F.col("frame")
    bpm = lambda column: F.try_divide(F.lit(60.0), F.percentile(column, F.lit(0.5)) * frame_s)
    keep = F.coalesce("keep", F.lit(False)) if "keep" in beats.columns else F.lit(False)
    rows = beats.withColumn("next", F.lead("frame").over(by("beat"))).withColumn("keep", keep)
    half = lambda side: F.avg(F.when(F.col("beat") % 2 == side, F.col("low"))) + F.avg(F.when(F.col("beat") % 2 == side, F.col("full")))
    about = rows.groupBy("song_id").agg(bpm(F.col("next") - F.col("frame")).alias("bpm"), half(0).alias("even"), half(1).alias("odd"))
    fold = F.when(F.col("keep"), 1.0).when(F.col("bpm") >= 160, 0.5).when(F.col("bpm") < 50, 2.0).otherwise(1.0)
    side = F.when(F.col("even") >= F.col("odd"), 0).otherwise(1)
    rows = rows.join(about, "song_id").withColumn("fold", fold).where((F.col("fold") != 0.5) | (F.col("beat") % 2 == side))
    frames = F.when((F.col("fold") == 2) & F.col("next").isNotNull(), F.array(F.col("frame"), F.expr("(frame + next) div 2").cast("int"))).otherwise(F.array("frame"))
    out = rows.select("song_id", "fold", F.posexplode(frames).alias("half", "frame"), F.col("beat").alias("was"))
    out = out.withColumn("beat", F.row_number().over(Window.partitionBy("song_id").orderBy("was", "half")) - 1)
    measured = out.withColumn("gap", gap()).groupBy("song_id").agg(bpm("gap").alias("tempo"))
    out = out.select("song_id", "beat", "frame", "fold").join(measured, "song_id")
    return out.withColumn("tempo_half", F.col("tempo") / 2).withColumn("tempo_double", F.col("tempo") * 2)


def extend_grid(beats: DataFrame, n_frames: DataFrame) -> DataFrame:
    """Frames of the beats and of more before and after at the median spacing, while they fall inside the song (a quarter spacing of slack)."""
    gap = F.lead("frame").over(by("frame")) - F.col("frame")
    about = beats.withColumn("gap", gap).groupBy("song_id").agg(F.percentile("gap", F.lit(0.5)).alias("iv"), F.min("frame").alias("first"), F.max("frame").alias("last"))
    about = about.join(n_frames.select("song_id", "n"), "song_id").where("iv > 0")
    before = F.floor((F.col("first") + 0.25 * F.col("iv")) / F.col("iv")).cast("int")
    after = F.floor((F.col("n") - 1 - 0.25 * F.col("iv") - F.col("last")) / F.col("iv")).cast("int")
    steps = lambda k: F.when(k >= 1, F.sequence(F.lit(1), F.greatest(k, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    head = about.select("song_id", F.explode(F.transform(steps(before), lambda k: F.greatest(F.lit(0.0), F.bround(F.col("first") - k * F.col("iv"))))).alias("frame"))
    tail = about.select("song_id", F.explode(F.transform(steps(after), lambda k: F.bround(F.col("last") + k * F.col("iv")))).alias("frame"))
    every = beats.select("song_id", F.col("frame").cast("double").alias("frame")).unionByName(head).unionByName(tail)
    return every.select("song_id", (F.row_number().over(by("frame")) - 1).alias("beat"), F.col("frame").cast("int").alias("frame"))


def tempo_stability(beats: DataFrame) -> DataFrame:
    """Population deviation of the beat intervals over their mean; none where that is 0."""
    gap = F.lead("time").over(by("beat")) - F.col("time")
    return beats.withColumn("gap", gap).groupBy("song_id").agg(F.try_divide(F.stddev_pop("gap"), F.avg("gap")).alias("stability"))


def triplet_feel(frames: DataFrame, beats: DataFrame, column: str = "onset_env", least: int = 6) -> DataFrame:
    """How strong the thirds of a beat sound next to its half: mean third over mean third plus mean half, beats of six frames or more.

    The places are cut down to whole frames. Songs without a long beat have 0.
    """
    following = F.lead("frame").over(by("beat"))
    rows = beats.withColumn("span", following - F.col("frame")).where(F.col("span") >= least)
    points = F.array(*(F.struct(F.lit(kind).alias("kind"), (F.col("frame") + F.floor(part)).cast("int").alias("at")) for kind, part in (("third", F.col("span") / 3), ("third", F.col("span") * 2 / 3), ("half", F.col("span") / 2))))
    points = rows.select("song_id", F.explode(points).alias("p")).select("song_id", "p.kind", F.col("p.at").alias("frame"))
    near = ranged(frames.select("song_id", "frame", column), 1)
    peak = near.select("song_id", "frame", "own", F.max(column).over(near_frames().rangeBetween(-1, 1)).alias("x")).where("own").drop("own")
    sums = points.join(peak, ["song_id", "frame"]).groupBy("song_id").agg(*(F.avg(F.when(F.col("kind") == k, F.col("x"))).alias(k) for k in ("third", "half")))
    total = F.col("third") + F.col("half")
    found = sums.select("song_id", F.when(total > 0, F.col("third") / total).otherwise(0.0).alias("triplet"))
    return beats.select("song_id").distinct().join(found, "song_id", "left").select("song_id", F.coalesce("triplet", F.lit(0.0)).alias("triplet"))


def autocorrelation(series: DataFrame, column: str, max_lag: int = MAX_LAG) -> DataFrame:
    """song_id, lag and autocorrelation of the mean-free series at lags 0 to max_lag; 0 where there is no energy."""
    rows = series.withColumn("__x", F.col(column) - F.avg(column).over(Window.partitionBy("song_id")))
    sums = rows.select("song_id", "__x", *(F.lead("__x", k).over(by("beat")).alias(f"__{k}") for k in range(1, max_lag + 1)))
    sums = sums.groupBy("song_id").agg(F.array(F.sum(F.col("__x") * F.col("__x")), *(F.coalesce(F.sum(F.col("__x") * F.col(f"__{k}")), F.lit(0.0)) for k in range(1, max_lag + 1))).alias("s"))
    return sums.select("song_id", F.posexplode("s").alias("lag", "x"), F.col("s")[0].alias("e")).select("song_id", "lag", F.when(F.col("e") > 1e-12, F.col("x") / F.col("e")).otherwise(0.0).alias("acf"))


def _period_strength(ac: str, beats: int, lags: int = MAX_LAG) -> Column:
    """How far the autocorrelation stands above its neighbours at a period, and at twice the period if that is known."""
    peak = lambda k: F.greatest(F.lit(0.0), F.col(ac)[k] - 0.5 * (F.col(ac)[k - 1] + F.col(ac)[k + 1])) if k + 1 <= lags else F.lit(0.0)
    return 0.65 * peak(beats) + 0.35 * peak(2 * beats) if 2 * beats + 1 <= lags else peak(beats)


def forced_meter(meter: DataFrame, overrides: DataFrame) -> DataFrame:
    """The listener's time signature (song_id, forced_meter) in place of the estimated one, which keeps its confidence; with user_forced."""
    wish = overrides.select("song_id", "forced_meter").where(F.col("forced_meter").isin(*T.METER_BEATS))
    rows = meter.join(wish, "song_id", "left")
    label = F.coalesce("forced_meter", "label")
    return rows.withColumn("label", label).withColumn("bpb", F.coalesce(lookup(T.METER_BEATS, F.col("forced_meter")), "bpb")).withColumn("user_forced", F.col("forced_meter").isNotNull()).drop("forced_meter")


def estimate_meter(accents: DataFrame, novelty: DataFrame, triplet: DataFrame) -> DataFrame:
    """Time signature by song: label, beats per bar, confidence and the three best with their shares.

    Accents and novelty are autocorrelations (song_id, lag, acf); the triplet feel blends straight and compound meters.
    """
    wide = lambda df, name: df.groupBy("song_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("lag", "acf"))), lambda s: s["acf"]).alias(name))
    rows = wide(accents, "a").join(wide(novelty, "n"), "song_id").join(triplet, "song_id", "left")
    strength = {b: 0.6 * _period_strength("a", b) + 0.4 * _period_strength("n", b) for b in (2, 3, 4, 6)}
    rows = rows.select("song_id", F.coalesce("triplet", F.lit(0.0)).alias("tri"), *(s.alias(f"s{b}") for b, s in strength.items()))
    compound = F.when(F.col("tri") >= 0.52, 1.0).when(F.col("tri") >= 0.45, (F.col("tri") - 0.45) / 0.07).otherwise(0.0)
    rows = rows.withColumn("c", compound)
    straight = 1.0 - F.col("c")
    six = F.greatest(F.col("s2"), 0.8 * F.col("s6")) * F.col("c") * 0.85
    six = F.when((F.col("c") > 0) & (F.col("s6") > F.greatest("s2", "s4")), F.greatest(six, F.col("s6") * F.col("c"))).otherwise(six)
    scores = {"4/4": F.col("s4") * straight, "3/4": F.col("s3") * straight * 0.90, "2/4": F.col("s2") * straight * 0.45, "12/8": F.col("s4") * F.col("c") * 0.90, "9/8": F.col("s3") * F.col("c") * 0.55, "6/8": six}
    each = F.array(*(F.struct(s.alias("score"), F.lit(-k).alias("o"), F.lit(label).alias("label")) for k, (label, s) in enumerate(scores.items())))
    rows = rows.select("song_id", F.sort_array(each, asc=False).alias("r"))
    total = F.aggregate("r", F.lit(0.0), lambda t, s: t + s["score"]) + 1e-9
    best = F.col("r")[0]
    label = F.when(best["score"] > 0, best["label"]).otherwise("4/4")
    return rows.select("song_id", label.alias("label"), lookup(T.METER_BEATS, label).alias("bpb"), F.when(best["score"] > 0, best["score"] / total).otherwise(0.0).alias("confidence"), F.transform(F.slice("r", 1, 3), lambda s: F.struct(s["label"].alias("label"), (s["score"] / total).alias("score"))).alias("alternatives"))


def downbeat_phase(beats: DataFrame, meter: DataFrame) -> DataFrame:
    """First beat of a bar: the phase with the greatest mean of low_z + 0.7 nov_z + 0.3 full_z over two beats or more; the lowest on ties."""
    rows = beats.join(meter.select("song_id", "bpb"), "song_id").withColumn("phase", F.col("beat") % F.col("bpb"))
    means = rows.groupBy("song_id", "bpb", "phase").agg((F.avg("low_z") + 0.7 * F.avg("nov_z") + 0.3 * F.avg("full_z")).alias("score"), F.count(F.lit(1)).alias("n"))
    best = means.groupBy("song_id", "bpb").agg(F.max(F.when(F.col("n") >= 2, F.struct(F.round("score", 9).alias("score"), (-F.col("phase")).alias("p")))).alias("m"))
    return best.select("song_id", "bpb", F.coalesce(-F.col("m.p"), F.lit(0)).cast("int").alias("phase"))


def build_bars(beats: DataFrame, tempo: DataFrame) -> DataFrame:
    """Bars from the phase on: index, start and end, first beat and the beat after; the last one ends at the last beat. Where beats have
    their frame, bars have that of both ends (frame_start, frame_end)."""
    last = F.max("beat").over(Window.partitionBy("song_id"))
    framed = ["frame"] * ("frame" in beats.columns)
    rows = beats.select("song_id", "beat", "time", *framed).join(tempo.select("song_id", "phase", "bpb"), "song_id").withColumn("last", last)
    index = F.floor((F.col("beat") - F.col("phase")) / F.col("bpb")).cast("int")
    starts = rows.where((F.col("beat") >= F.col("phase")) & ((F.col("beat") - F.col("phase")) % F.col("bpb") == 0) & (F.col("beat") < F.col("last")))
    starts = starts.select("song_id", index.alias("index"), F.col("time").alias("start"), F.col("beat").alias("beat_start"), F.least(F.col("beat") + F.col("bpb"), F.col("last")).alias("beat_end"), *(F.col(c).alias("frame_start") for c in framed))
    ends = beats.select("song_id", F.col("beat").alias("beat_end"), F.col("time").alias("end"), *(F.col(c).alias("frame_end") for c in framed))
    return starts.join(ends, ["song_id", "beat_end"]).select("song_id", "index", "start", "end", "beat_start", "beat_end", *(f"frame_{e}" for _ in framed for e in ("start", "end")))


def harmonic_novelty(frames: DataFrame, width: int) -> DataFrame:
    """Per frame, one less the cosine of the mean unit chroma before and after it; 0 for the first and the last `width` frames.

    A song's frames are numbered without gaps; a long song is cut into ranges, each with `width` frames of its neighbours.
    """
    norm = F.sqrt(F.aggregate("chroma", F.lit(0.0), lambda a, x: a + x * x))
    unit = frames.select("song_id", "frame", F.when(norm > 0, F.transform("chroma", lambda x: x / norm)).otherwise(F.col("chroma")).alias("u"))
    order = near_frames()
    before, after = order.rowsBetween(-width, -1), order.rowsBetween(0, width - 1)
    rows = ranged(unit, width)
    sides = rows.select("song_id", "frame", "own", *(F.array(*(F.avg(F.col("u")[i]).over(w) for i in range(12))).alias(n) for n, w in (("b", before), ("a", after))), F.count("u").over(before).alias("nb"), F.lead("frame", width).over(order).alias("ahead"))
    whole = (F.col("nb") == width) & F.col("ahead").isNotNull()
    return sides.where("own").select("song_id", "frame", F.when(whole, 1 - cosine(F.col("b"), F.col("a"))).otherwise(0.0).alias("novelty"))
