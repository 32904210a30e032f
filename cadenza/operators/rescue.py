"""Second thoughts about the pulse: denser grids, bar length from the accents, another meter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import tables as T
from cadenza.operators.beats import apart, frame_blocks, grid_coverage, median_gap, peaks_of, standard
from cadenza.operators.progression import plain, song_by_song

LONGEST_LAG_S, SHORTEST_BAR_S, LONGEST_BAR_S, LEAST_GAP_S = 11.7, 1.4, 9.0, 0.15
LEAST_STRENGTH, SAME_BAR, QUARTER_S = 0.18, 0.07, (0.40, 1.20)
#: Tempo that the tracker starts from, how far a grid's hint may be from a wished tempo, and beats that a song needs.
START_BPM, GRID_FIT, LEAST_BEATS = 100.0, 0.07, 8


def refine_pulse(beats: DataFrame, onsets: DataFrame, wider: float = 1.5, gain: float = 0.10) -> DataFrame:
    """The beats (song_id, beat, frame), or a grid with 1.5 times their spacing at the phase 0, 0.5 or 1 that catches at least a tenth more onsets.

    A grid needs eight points before the last beat. Points between beats are interpolated: each finds the beat below and the one above by
    equality. The best of three phases wins, the first on ties.
    """
    count = beats.groupBy("song_id").agg(F.max("beat").alias("last"))
    places = count.select("song_id", "last", F.explode(F.array(F.lit(0.0), F.lit(0.5), F.lit(1.0))).alias("phase"))
    n = F.ceil((F.col("last") - F.col("phase")) / wider).cast("int")
    places = places.where(n >= 8).select("song_id", "phase", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.col("phase") + k * wider)).alias("nth", "at"))
    # beats are as many as the input has and no table to send to all: a few megabytes, compressed, of them fill the driver
    side = lambda name: beats.select("song_id", F.col("beat").alias(f"{name}_beat"), F.col("frame").alias(name)).hint("merge")
    low = places.withColumn("low_beat", F.floor("at").cast("int")).withColumn("high_beat", F.ceil("at").cast("int"))
    grid = low.join(side("low"), ["song_id", "low_beat"]).join(side("high"), ["song_id", "high_beat"])
    grid = grid.select("song_id", "phase", "nth", (F.col("low") + (F.col("high") - F.col("low")) * (F.col("at") - F.col("low_beat"))).alias("frame"))
    # the beats themselves are the grid of phase -1: all four are rated in one pass
    each = lambda rows: rows.withColumn("phase", F.explode(F.array(*(F.lit(p) for p in (-1.0, 0.0, 0.5, 1.0)))))
    period = each(median_gap(beats)).withColumn("period", F.when(F.col("phase") < 0, F.col("period")).otherwise(F.col("period") * wider))
    grids = grid.select("song_id", "phase", "frame").unionByName(beats.select("song_id", F.lit(-1.0).alias("phase"), F.col("frame").cast("double").alias("frame")))
    rated = grid_coverage(each(onsets.select("song_id", "frame")), grids, period=period, of=("song_id", "phase"))
    found = F.max(F.when(F.col("phase") >= 0, F.struct("coverage", (-F.col("phase")).alias("p"))))
    best = rated.groupBy("song_id").agg(found.alias("m"), F.max(F.when(F.col("phase") < 0, F.col("coverage"))).alias("base"))
    better = best.where(F.col("m.coverage") >= F.col("base") + gain).select("song_id", (-F.col("m.p")).alias("phase"))
    swapped = grid.join(better, ["song_id", "phase"]).select("song_id", F.col("nth").alias("beat"), F.bround("frame").cast("int").alias("frame"), F.lit(True).alias("regridded"))
    same = beats.join(better, "song_id", "left_anti").select("song_id", "beat", "frame", F.lit(False).alias("regridded"))
    return same.unionByName(swapped)


def bar_period(frames: DataFrame, frame_s: float = T.HOP / T.SAMPLE_RATE) -> DataFrame:
    """Length of a bar by song (low_env, onset_env and novelty per frame): bar_s, strength and the accents' autocorrelation.

    The shortest peak of the summed z-scores' autocorrelation that is nearly as high as the highest. Every block of frames is multiplied
    with itself and the longest lag of frames behind it; the products of a song's blocks add up to its autocorrelation.
    """
    kind = frames.schema["song_id"].dataType.simpleString()
    columns = ("low_env", "onset_env", "novelty")
    lags = int(LONGEST_LAG_S / frame_s) + 1

    def products(own: np.ndarray, behind: np.ndarray) -> list[float]:
        """Sums of own[t] * (own and behind)[t + lag]."""
        both = np.concatenate([own, behind])
        size = 1 << int(len(own) + len(both) + lags).bit_length()
        return np.fft.irfft(np.fft.rfft(both, size) * np.fft.rfft(own, size).conj(), size)[:lags].tolist()

    def correlate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for _, row in batch.iterrows():
                low, onset, novelty = (standard(row, c) for c in columns)
                n = int(row["end"] - row["first"])
                accent, every = low + onset, low + onset + 2 * novelty
                rows.append((row["song_id"], row["block"], row["n"], products(every[:n], every[n : n + lags]), products(accent[:n], accent[n : n + lags])))
            yield plain(pd.DataFrame(rows, columns=["song_id", "block", "n", "every", "accent"]))

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        some = min(lags, int(pdf["n"].iloc[0]))
        every, accent = (np.sum(np.stack(pdf[c].to_numpy()), axis=0)[:some] for c in ("every", "accent"))
        ac, accent = (x / x[0] if len(x) and x[0] > 1e-12 else np.zeros(some) for x in (every, accent))
        peaks = peaks_of(ac)
        kept = peaks[apart(peaks, ac[peaks], max(1, int(LEAST_GAP_S / frame_s)))]
        fits = [k for k in kept.tolist() if SHORTEST_BAR_S <= k * frame_s <= LONGEST_BAR_S]
        top = max((ac[k] for k in fits), default=0.0)
        bar = next((k for k in fits if ac[k] >= 0.85 * top), None) if top > 0 else None
        return pd.DataFrame([(pdf["song_id"].iloc[0], None if bar is None else bar * frame_s, 0.0 if bar is None else float(ac[bar]), accent.tolist())], columns=["song_id", "bar_s", "strength", "accent"])

    blocks = frame_blocks(frames, columns, 0, lags).mapInPandas(correlate, f"song_id {kind}, block long, n long, every array<double>, accent array<double>")
    return song_by_song(blocks, "block", find, f"song_id {kind}, bar_s double, strength double, accent array<double>")


def rescue_meter(periods: DataFrame, bars: DataFrame, frame_s: float = T.HOP / T.SAMPLE_RATE, overrides: DataFrame | None = None) -> DataFrame:
    """Songs (bar_s, strength, accent) whose tracked bars contradict the accents: label, bpm and share of the better of 4/4 and 3/4, and
    what contradicts what (tracked_s, bar_s, strength).

    Bars of about the same, double, half, four times or a quarter the length agree; songs of two bars or fewer
    are left alone, and so are those whose tempo the listener gave (song_id, forced_bpm).
    """
    if overrides is not None:
        periods = periods.join(overrides.where("forced_bpm is not null").select("song_id"), "song_id", "left_anti")
    tracked = bars.groupBy("song_id").agg(F.percentile(F.col("end") - F.col("start"), F.lit(0.5)).alias("tracked_s"), F.count(F.lit(1)).alias("n_bars")).where("n_bars > 2")
    rows = periods.join(tracked, "song_id").where((F.col("strength") >= LEAST_STRENGTH) & F.col("bar_s").isNotNull())
    for times in (1.0, 2.0, 0.5, 4.0, 0.25):
        rows = rows.where(F.abs(F.try_divide("bar_s", "tracked_s") / times - 1) >= SAME_BAR)

    def around(lag_s: Column) -> Column:
        """Largest accent correlation within three percent of a lag."""
        low, high = (F.bround(lag_s / frame_s * w).cast("int") for w in (0.97, 1.03))
        return F.coalesce(F.array_max(F.slice("accent", low + 1, F.greatest(F.lit(0), F.least(high, F.size("accent") - 1) - low + 1))), F.lit(0.0))

    tries = []
    for beats, label, prior in ((4, "4/4", 1.0), (3, "3/4", 0.85)):
        quarter = F.col("bar_s") / beats
        score = sum((around(quarter * k) for k in range(1, beats)), F.lit(0.0)) / (beats - 1) * prior
        tries.append(F.when(quarter.between(*QUARTER_S), F.struct(score.alias("score"), F.lit(beats).alias("bpb"), F.lit(label).alias("label"), (60.0 / quarter).alias("bpm"))))
    rows = rows.withColumn("t", F.array_compact(F.array(*tries))).where(F.size("t") > 0)
    rows = rows.withColumn("best", F.array_max("t"))
    total = F.aggregate("t", F.lit(0.0), lambda s, x: s + F.greatest(x["score"], F.lit(1e-6)))
    return rows.select("song_id", "best.label", "best.bpb", "best.bpm", (F.col("best.score") / total).alias("share"), "tracked_s", "bar_s", "strength")


def usual_grids(tracked: DataFrame) -> DataFrame:
    """Of a song's tracked grids (song_id, beat, frame, bpm_hint: the tempo that the tracker was asked for, null if for none) the one
    without a hint, else that with the hint nearest to the tracker's own start; the slower on ties."""
    far = F.when(F.col("bpm_hint").isNull(), -1.0).otherwise(F.abs(F.col("bpm_hint") - START_BPM))
    return _picked(tracked, tracked.groupBy("song_id").agg(F.min_by("bpm_hint", F.struct(far.alias("far"), "bpm_hint")).alias("hint")))


def grids_at(tracked: DataFrame, wishes: DataFrame) -> DataFrame:
    """For songs with a wished tempo (song_id, bpm) the grid that was tracked nearest to it, if that is within GRID_FIT; the slower
    on ties. Songs without one are missing: for them the tracker would have to run again."""
    rows = tracked.select("song_id", "bpm_hint").where("bpm_hint is not null").distinct().join(wishes.select("song_id", "bpm"), "song_id")
    far = F.abs(F.try_divide("bpm_hint", "bpm") - 1)
    return _picked(tracked, rows.withColumn("far", far).where(F.col("far") <= GRID_FIT).groupBy("song_id").agg(F.min_by("bpm_hint", F.struct("far", "bpm_hint")).alias("hint")))


def _picked(tracked: DataFrame, hints: DataFrame) -> DataFrame:
    chosen = hints.select(F.col("song_id").alias("__song"), "hint")
    return tracked.join(chosen, (F.col("song_id") == F.col("__song")) & F.col("bpm_hint").eqNullSafe(F.col("hint"))).select("song_id", "beat", "frame", "bpm_hint")


def rejected_songs(frames: DataFrame, tracked: DataFrame) -> DataFrame:
    """Songs that can't be analysed, with the reason: no frames, fewer than LEAST_BEATS tracked beats, or beats that share a frame."""
    have = frames.groupBy("song_id").agg(F.count(F.lit(1)).alias("n"))
    gap = F.lead("frame").over(Window.partitionBy("song_id").orderBy("beat")) - F.col("frame")
    grid = tracked.select("song_id", "beat", "frame", gap.alias("gap")).groupBy("song_id").agg(F.count(F.lit(1)).alias("beats"), F.percentile("gap", F.lit(0.5)).alias("median"))
    beats = F.coalesce("beats", F.lit(0))
    reason = F.when(F.col("n").isNull(), "no frames").when(beats < LEAST_BEATS, "no steady beat").when(F.col("median") <= 0, "beats share a frame")
    return have.join(grid, "song_id", "full").select("song_id", reason.alias("reason"), beats.alias("beats")).where("reason is not null")
