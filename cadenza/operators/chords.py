"""Chord decoding: template scores, key prior, a best path over sixty chord states, segments."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import tables as T
from cadenza.functions.names import entry, spell_pitch
from cadenza.operators.key import key_at
from cadenza.operators.progression import by, islands, song_by_song

#: State number = 5 * root + quality.
STATES = [(root, quality) for root in range(12) for quality in T.STATE_QUALITIES]
P_DOWNBEAT, P_MIDDLE, P_OTHER = 0.45, 0.12, 0.02


def templates() -> np.ndarray:
    """One unit vector of twelve for each state."""
    out = np.zeros((len(STATES), 12))
    for k, (root, quality) in enumerate(STATES):
        for step, weight in T.QUALITY_TONES[quality].items():
            out[k, (root + step) % 12] = weight
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def prior_bonus(tonic: int, mode: str) -> list[float]:
    """Bonus of every state in a key."""
    diatonic, borrowed = (T.MAJOR_DIATONIC, T.MAJOR_BORROWED) if mode == "major" else (T.MINOR_DIATONIC, {})
    out = []
    for root, quality in STATES:
        degree = (root - tonic) % 12
        if quality in diatonic.get(degree, ()):
            out.append(0.3 if degree == 0 and quality == "dominant7" else 0.7)
        elif quality in borrowed.get(degree, ()):
            out.append(0.3)
        else:
            out.append(0.25 if degree in diatonic or degree in borrowed else 0.0)
    return out


def _literal(values: list[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def chord_template_scores(beats: DataFrame) -> DataFrame:
    """Beats with sixty cosines of the chroma with the templates, and scores: cosine, a share for the bass at the root, the quality's bias.

    Arrays in, one array out: no row is made per state. All in one projection beside the sums over arrays: on its own, the sixty dot
    products become one generated method that is too long for the JVM to compile.
    """
    norm = F.sqrt(F.aggregate("chroma", F.lit(0.0), lambda a, x: a + x * x))
    low = F.aggregate("bass", F.lit(0.0), lambda a, x: a + x)
    norm, low = F.when(norm > 0, norm).otherwise(1.0), F.when(low > 0, low).otherwise(1.0)
    dots = [sum((F.col("chroma")[i] * float(w) for i, w in enumerate(template) if w), F.lit(0.0)) / norm for template in templates()]
    scores = [dots[k] + T.BASS_WEIGHT * F.col("bass")[root] / low + T.QUALITY_BIAS[quality] for k, (root, quality) in enumerate(STATES)]
    return beats.withColumns({"cosines": F.array(*dots), "scores": F.array(*scores)})


def key_prior(beats: DataFrame, timeline: DataFrame, song_key: DataFrame) -> DataFrame:
    """Beats with the sixty bonuses of the key that holds at their time."""
    rows = key_at(beats, timeline, song_key)
    modes = F.array(*(_literal(prior_bonus(t, m)) for t in range(12) for m in ("major", "minor")))
    return rows.withColumn("prior", F.get(modes, F.col("key_tonic") * 2 + F.when(F.col("key_mode") == "minor", 1).otherwise(0)))


def chord_emission(beats: DataFrame) -> DataFrame:
    """Beats (scores, prior, chroma) with emission: distance from the best score in units of temperature, plus the prior; all 0 for
    silent beats, those with under a twentieth of the song's median chroma."""
    total = F.aggregate("chroma", F.lit(0.0), lambda a, x: a + x)
    median = F.percentile("__total", F.lit(0.5)).over(Window.partitionBy("song_id"))
    rows = beats.withColumn("__total", total).withColumn("__median", median).withColumn("__top", F.array_max("scores"))
    heard = F.zip_with("scores", "prior", lambda s, p: (s - F.col("__top")) / T.TEMPERATURE + p)
    return rows.withColumn("emission", F.when(F.col("__total") < 0.05 * F.col("__median"), F.transform("scores", lambda s: F.lit(0.0))).otherwise(heard)).drop("__total", "__median", "__top")


def change_probability(beats: DataFrame, tempo: DataFrame) -> DataFrame:
    """Beats with the chance of a new chord there: high on the first beat of a bar, less in the middle of an even one, low elsewhere."""
    place = F.pmod(F.col("beat") - F.col("phase"), F.col("bpb"))
    middle = (F.col("bpb") >= 4) & (F.col("bpb") % 2 == 0) & (place == F.floor(F.col("bpb") / 2))
    p = F.when(place == 0, P_DOWNBEAT).when(middle, P_MIDDLE).otherwise(P_OTHER)
    return beats.join(tempo.select("song_id", "phase", "bpb"), "song_id").withColumn("p_change", p)


def chord_path(beats: DataFrame) -> DataFrame:
    """State of every beat (emission, p_change) on the best path: staying costs the chance of no change, moving is shared among the others.

    Staying wins ties, then the lower state; songs of under four beats have no chords. One row per beat reaches the call. Beats with time
    and cosines keep their time, and of the cosines their state's own, so that nothing has to be looked up afterwards.
    """
    carried = {"time", "cosines"} <= set(beats.columns)

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < 4:
            none = pdf[["song_id", "beat"]].iloc[:0].assign(state=pd.Series(dtype="int32"))
            return none.assign(time=pd.Series(dtype=float), own=pd.Series(dtype=float)) if carried else none
        emission, p = np.stack(pdf["emission"].to_numpy()), pdf["p_change"].to_numpy()
        n = emission.shape[1]
        total, back = emission[0], []
        for row, chance in zip(emission[1:], p[1:]):
            top = int(total.argmax())
            stay, move = total + np.log(1 - chance), total[top] + np.log(chance / (n - 1))
            moves = move > stay
            moves[top] = False
            back.append(np.where(moves, top, np.arange(n)))
            total = np.where(moves, move, stay) + row
        state = [int(total.argmax())]
        for came in reversed(back):
            state.append(int(came[state[-1]]))
        path = pd.DataFrame({"song_id": pdf["song_id"], "beat": pdf["beat"], "state": state[::-1]})
        return path.assign(time=pdf["time"], own=np.stack(pdf["cosines"].to_numpy())[np.arange(len(pdf)), state[::-1]]) if carried else path

    kind = beats.schema["song_id"].dataType.simpleString()
    return song_by_song(beats.select("song_id", "beat", "emission", "p_change", *["time", "cosines"] * carried), "beat", best, f"song_id {kind}, beat int, state int" + ", time double, own double" * carried)


def chord_segments(path: DataFrame, beats: DataFrame, tempo: DataFrame) -> DataFrame:
    """Runs of equal state as chords: beats, times, mean cosine as confidence, bar. The last one lasts as long as the beat before it.
    A path without time and own finds both in the beats."""
    if "own" not in path.columns:
        path = path.join(beats.select("song_id", "beat", "time", "cosines"), ["song_id", "beat"]).withColumn("own", F.get("cosines", F.col("state")))
    rows = path.join(tempo.select("song_id", "phase", "bpb"), "song_id")
    gap = F.col("time") - F.lag("time").over(by("beat"))
    rows = rows.withColumn("next", F.coalesce(F.lead("time").over(by("beat")), F.col("time") + F.coalesce(gap, F.lit(0.0))))
    rows = islands(rows, F.col("state") == F.lag("state").over(by("beat")), "beat")
    out = rows.groupBy("song_id", "island").agg(
        F.first("state").alias("state"), F.min("time").alias("start"), F.max_by("next", "beat").alias("end"), F.min("beat").alias("beat_start"), (F.max("beat") + 1).alias("beat_end"), F.avg("own").alias("confidence"), F.first("phase").alias("phase"), F.first("bpb").alias("bpb")
    )
    bar = F.when(F.col("beat_start") >= F.col("phase"), F.floor((F.col("beat_start") - F.col("phase")) / F.col("bpb"))).otherwise(-1).cast("int")
    quality = entry(T.STATE_QUALITIES, F.col("state") % 5)
    return out.select("song_id", (F.col("island") - 1).cast("int").alias("pos"), F.floor(F.col("state") / 5).cast("int").alias("root_pc"), quality.alias("quality"), "start", "end", (F.col("end") - F.col("start")).alias("duration"), "beat_start", "beat_end", "confidence", bar.alias("bar"))


def spell_chords(segments: DataFrame, timeline: DataFrame, song_key: DataFrame) -> DataFrame:
    """Segments with the key at their middle and the root's name in it."""
    rows = key_at(segments.withColumn("__mid", (F.col("start") + F.col("end")) / 2), timeline, song_key, "__mid").drop("__mid")
    return rows.withColumn("root", spell_pitch(F.col("root_pc"), F.col("key_tonic"), F.col("key_mode")))
