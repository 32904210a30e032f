"""Key of a song and its changes: chroma windows, profile correlation, a best path, evidence from chords."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import tables as T
from cadenza.functions.names import key_name, lookup, other_mode, relative_tonic
from cadenza.operators.progression import by, islands, song_by_song

STAY, NEAR, FAR = 0.0, 0.8, 1.2


def unit_sum(v: Column) -> Column:
    """An array divided by its sum; as it is where the sum is zero."""
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.transform(v, lambda x: x / total)).otherwise(v)


def mean_chroma(rows: DataFrame, keys: list[str], column: str = "chroma") -> DataFrame:
    """Mean of twelve-number arrays as twelve plain averages: no rows are made, and tasks pre-aggregate."""
    return rows.groupBy(*keys).agg(F.array(*(F.avg(F.col(column)[i]) for i in range(12))).alias("chroma"))


def global_chroma(frames: DataFrame) -> DataFrame:
    """Mean of the frames' chroma, each scaled to sum one."""
    return mean_chroma(frames.select("song_id", unit_sum(F.col("chroma")).alias("chroma")), ["song_id"])


def _centred(profile: tuple[float, ...], tonic: int) -> list[float]:
    turned = np.array([profile[(i - tonic) % 12] for i in range(12)])
    turned = turned - turned.mean()
    return (turned / np.sqrt((turned * turned).sum())).tolist()


def with_length(rows: DataFrame, column: str = "chroma") -> DataFrame:
    """Rows with the length of a chroma array's deviations from its mean, made once for all profiles."""
    v = [F.col(column)[i] for i in range(12)]
    rows = rows.withColumn("__mean", sum(v[1:], v[0]) / 12.0)
    return rows.withColumn("__length", F.sqrt(sum(((x - F.col("__mean")) * (x - F.col("__mean")) for x in v), F.lit(0.0)))).drop("__mean")


def correlation(profile: tuple[float, ...], tonic: int, column: str = "chroma") -> Column:
    """Pearson correlation of a chroma array with a key profile that starts at the tonic; 0 for a flat array.

    The profile's weights add up to 0, so the array's mean drops out of the dot product.
    """
    dot = sum((F.col(column)[i] * w for i, w in enumerate(_centred(profile, tonic))), F.lit(0.0))
    return F.when(F.col("__length") > 1e-12, dot / F.col("__length")).otherwise(0.0)


def key_candidates(chroma: DataFrame) -> DataFrame:
    """All 24 keys of every song with their score and rank; on ties (to nine places) C major, C minor, C# major and so on."""
    each = [F.struct(F.lit(2 * t + m).alias("ordinal"), F.lit(t).alias("tonic"), F.lit(mode).alias("mode"), correlation(profile, t).alias("score")) for t in range(12) for m, (mode, profile) in enumerate((("major", T.MAJOR_PROFILE), ("minor", T.MINOR_PROFILE)))]
    rows = with_length(chroma).select("song_id", F.explode(F.array(*each)).alias("c")).select("song_id", "c.*")
    rank = F.row_number().over(Window.partitionBy("song_id").orderBy(F.round("score", 9).desc(), "ordinal"))
    return rows.withColumn("rank", rank).drop("ordinal")


def key_windows(frames: DataFrame, window: int, hop: int) -> DataFrame:
    """Mean chroma of every full window of frames, at least one for a song; columns song_id, win, chroma.

    Frames add up once, into buckets of a hop: sum and number of all of a bucket's frames, and of the first few where the hop doesn't
    divide the window. A window is its whole buckets and the beginning of the next one; it is full if as many frames as that
    have come together, a song's frames being numbered without gaps.
    """
    whole, rest = divmod(window, hop)
    rows = frames.select("song_id", F.floor(F.col("frame") / hop).alias("bucket"), (F.col("frame") % hop < rest).alias("early"), unit_sum(F.col("chroma")).alias("chroma"))
    sums = lambda of: F.array(*(F.sum(F.when(of, F.col("chroma")[i]).otherwise(0.0)) for i in range(12)))
    every = F.lit(True)
    buckets = rows.groupBy("song_id", "bucket").agg(F.struct(sums(every).alias("s"), F.count(F.lit(1)).alias("n")).alias("all"), F.struct(sums(F.col("early")).alias("s"), F.count_if("early").alias("n")).alias("part"))
    into = F.transform(F.sequence(F.greatest(F.lit(0), F.col("bucket") - whole), F.col("bucket")), lambda w: F.struct(w.alias("win"), F.when(F.col("bucket") - w < whole, F.col("all")).otherwise(F.col("part")).alias("x")))
    parts = buckets.select("song_id", F.explode(into).alias("w")).select("song_id", F.col("w.win").cast("int").alias("win"), "w.x.s", "w.x.n")
    added = parts.groupBy("song_id", "win").agg(F.array(*(F.sum(F.col("s")[i]) for i in range(12))).alias("s"), F.sum("n").alias("n"))
    return added.where((F.col("n") == window) | (F.col("win") == 0)).select("song_id", "win", F.transform("s", lambda x: F.try_divide(x, F.col("n"))).alias("chroma"))


def region_scores(windows: DataFrame) -> DataFrame:
    """Windows with scores: for each of the twelve regions the better of its major key and the relative minor, to nine places so that
    ties are ties."""
    scores = [F.round(F.greatest(correlation(T.MAJOR_PROFILE, r), correlation(T.MINOR_PROFILE, (r + 9) % 12)), 9) for r in range(12)]
    return with_length(windows).withColumn("scores", F.array(*scores)).drop("__length")


def switch_costs() -> np.ndarray:
    """Cost of a change between regions: none to stay, less for one or two semitones up."""
    gap = (np.arange(12)[None, :] - np.arange(12)[:, None]) % 12
    return np.where(gap == 0, STAY, np.where((gap == 1) | (gap == 2), NEAR, FAR))


def key_path(scores: DataFrame) -> DataFrame:
    """Region of every window on the path with the greatest sum of scores less switch costs; lower regions win ties. The chroma stays.

    A song's windows are few and go to one call; no frame does.
    """
    cost = switch_costs()

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        emission = np.stack(pdf["scores"].to_numpy())
        total, back = emission[0], []
        for row in emission[1:]:
            options = total[:, None] - cost
            came = options.argmax(axis=0)
            back.append(came)
            total = options[came, np.arange(12)] + row
        state = [int(total.argmax())]
        for came in reversed(back):
            state.append(int(came[state[-1]]))
        return pd.DataFrame({"song_id": pdf["song_id"], "win": pdf["win"], "region": state[::-1], "chroma": pdf["chroma"]})

    kind = scores.schema["song_id"].dataType.simpleString()
    return song_by_song(scores.select("song_id", "win", "scores", "chroma"), "win", best, f"song_id {kind}, win int, region int, chroma array<double>")


def key_votes(path: DataFrame) -> DataFrame:
    """The path with the song's key on every row (tonic, mode, confidence, margin): its commonest region (lowest on ties); major or
    relative minor by the mean chroma of that region's windows. Windows over a song's few rows, so that the path is made once."""
    song = Window.partitionBy("song_id")
    n = F.count(F.lit(1)).over(Window.partitionBy("song_id", "region"))
    rows = path.withColumn("__n", n).withColumn("__main", F.max(F.struct("__n", (-F.col("region")).alias("r"))).over(song)["r"])
    own = F.when(F.col("region") == -F.col("__main"), F.col("chroma"))
    rows = rows.withColumn("__own", F.array(*(F.avg(own[i]).over(song) for i in range(12))))
    rows = with_length(rows, "__own")
    pick = lambda profile, shift: F.element_at(F.array(*(correlation(profile, (r + shift) % 12, "__own") for r in range(12))), 1 - F.col("__main"))
    rows = rows.withColumn("__major", pick(T.MAJOR_PROFILE, 0)).withColumn("__minor", pick(T.MINOR_PROFILE, 9))
    is_major = F.col("__major") >= F.col("__minor")
    tonic = F.when(is_major, -F.col("__main")).otherwise(F.pmod(9 - F.col("__main"), F.lit(12)))
    mode = F.when(is_major, "major").otherwise("minor")
    return rows.select("song_id", "win", "region", tonic.cast("int").alias("tonic"), mode.alias("mode"), F.greatest("__major", "__minor").alias("confidence"), F.abs(F.col("__major") - F.col("__minor")).alias("margin"))


def key_mode_vote(path: DataFrame) -> DataFrame:
    """Key of a song: song_id, tonic, mode, confidence and margin."""
    return key_votes(path).where("win = 0").drop("win", "region")


def key_timeline(path: DataFrame, durations: DataFrame, hop: int, window_s: float = 12.0, hop_s: float = 3.0, frame_s: float = T.HOP / T.SAMPLE_RATE) -> DataFrame:
    """Stretches of equal tonic: every window owns half a hop around its centre, the first from 0, the last to the end (song_id, duration).

    Windows begin at whole frames, `hop` apart, while the stretch that one owns is hop_s long; so stretches may overlap a little.
    """
    rows = key_votes(path).join(durations, "song_id")
    tonic = F.when(F.col("mode") == "minor", F.pmod(F.col("region") + 9, F.lit(12))).otherwise(F.col("region")).cast("int")
    centre = F.col("win") * hop * frame_s + window_s / 2
    last = F.max("win").over(Window.partitionBy("song_id"))
    rows = rows.withColumn("tonic", tonic).withColumn("start", F.when(F.col("win") == 0, 0.0).otherwise(centre - hop_s / 2)).withColumn("end", F.when(F.col("win") == last, F.col("duration")).otherwise(centre + hop_s / 2))
    rows = islands(rows, F.col("tonic") == F.lag("tonic").over(by("win")), "win")
    out = rows.groupBy("song_id", "island").agg(F.min("start").alias("start"), F.max_by("end", "win").alias("end"), F.first("tonic").alias("tonic"), F.first("mode").alias("mode"))
    return out.select("song_id", (F.col("island") - 1).cast("int").alias("seg"), "start", "end", "tonic", "mode", key_name(F.col("tonic"), F.col("mode")).alias("key"))


def forced_timeline(timeline: DataFrame, overrides: DataFrame, durations: DataFrame) -> DataFrame:
    """The timeline, with one stretch in the listener's key for songs that have one (forced_tonic, forced_mode); so these have no change."""
    wish = overrides.where("forced_tonic is not null").select("song_id", F.col("forced_tonic").cast("int").alias("tonic"), F.col("forced_mode").alias("mode"))
    whole = wish.join(durations, "song_id").select("song_id", F.lit(0).alias("seg"), F.lit(0.0).alias("start"), F.col("duration").alias("end"), "tonic", "mode", key_name(F.col("tonic"), F.col("mode")).alias("key"))
    return timeline.join(wish.select("song_id"), "song_id", "left_anti").select(whole.columns).unionByName(whole)


def relabelled_timeline(timeline: DataFrame, song_key: DataFrame) -> DataFrame:
    """Stretches in the mode of the song's refined key: each keeps its region and takes the relative tonic if the mode has changed."""
    rows = timeline.join(song_key.select("song_id", F.col("mode").alias("__mode")), "song_id")
    flips = F.col("mode") != F.col("__mode")
    tonic = F.when(flips, relative_tonic(F.col("tonic"), F.col("mode"))).otherwise(F.col("tonic")).cast("int")
    return rows.select("song_id", "seg", "start", "end", tonic.alias("tonic"), F.col("__mode").alias("mode"), key_name(tonic, F.col("__mode")).alias("key"))


def modulations(timeline: DataFrame) -> DataFrame:
    """Changes from one stretch to the next: time, keys and the way up in semitones."""
    before = lambda c: F.lag(c).over(by("seg"))
    rows = timeline.select("song_id", F.col("start").alias("time"), before("key").alias("from_key"), F.col("key").alias("to_key"), F.pmod(F.col("tonic") - before("tonic"), F.lit(12)).alias("semitones"))
    return rows.where(F.col("from_key").isNotNull())


def key_runner_up(candidates: DataFrame, song_key: DataFrame) -> DataFrame:
    """Best key on another tonic, where the song's key scores above 0 and leads by under 15 percent."""
    rows = candidates.join(song_key.select("song_id", F.col("tonic").alias("t"), F.col("mode").alias("m")), "song_id")
    winner = rows.where("tonic = t and mode = m").select("song_id", F.col("score").alias("win"))
    other = rows.where("tonic <> t").groupBy("song_id").agg(F.min_by(F.struct("tonic", "mode", "score"), "rank").alias("r"))
    close = (F.col("win") > 0) & ((F.col("win") - F.col("r.score")) / F.col("win") < 0.15)
    return other.join(winner, "song_id").where(close).select("song_id", "r.tonic", "r.mode", "r.score")


def forced_key(song_key: DataFrame, candidates: DataFrame, overrides: DataFrame) -> DataFrame:
    """The listener's key in place of the detected one: its candidate score as confidence, no margin. forced_timeline is its timeline."""
    wish = overrides.select("song_id", "forced_tonic", "forced_mode").where("forced_tonic is not null")
    score = candidates.select("song_id", F.col("tonic").alias("forced_tonic"), F.col("mode").alias("forced_mode"), "score")
    rows = song_key.join(wish.join(score, ["song_id", "forced_tonic", "forced_mode"]), "song_id", "left")
    forced = F.col("forced_tonic").isNotNull()
    return rows.select("song_id", F.coalesce("forced_tonic", "tonic").alias("tonic"), F.coalesce("forced_mode", "mode").alias("mode"), F.when(forced, F.col("score")).otherwise(F.col("confidence")).alias("confidence"), F.when(~forced, F.col("margin")).alias("margin"), forced.alias("user_forced"))


def key_at(points: DataFrame, timeline: DataFrame, song_key: DataFrame, at: str = "time") -> DataFrame:
    """Points (song_id and others) with key_tonic and key_mode: the first stretch that holds the time, else the last stretch, else the song's key.

    A song has few stretches: they are one array per song, looked up without widening the join.
    """
    stretches = timeline.groupBy("song_id").agg(F.sort_array(F.collect_list(F.struct("seg", "start", "end", "tonic", "mode"))).alias("__s"))
    rows = points.join(stretches, "song_id", "left").join(song_key.select("song_id", F.col("tonic").alias("__t"), F.col("mode").alias("__m")), "song_id", "left")
    holds = F.filter("__s", lambda s: (s["start"] <= F.col(at)) & (F.col(at) < s["end"]))
    found = F.coalesce(F.get(holds, F.lit(0)), F.element_at("__s", -1))
    rows = rows.withColumn("__k", found)
    return rows.withColumn("key_tonic", F.coalesce("__k.tonic", "__t")).withColumn("key_mode", F.coalesce("__k.mode", "__m")).drop("__s", "__t", "__m", "__k")


def _family(quality: Column) -> Column:
    return F.when(quality.isin("major", "major7", "dominant7"), "major").otherwise("minor")


def _fits(mode: Column, degree: Column, family: Column) -> Column:
    tables = {m: {f"{d}{f}": True for d, fs in t.items() for f in fs} for m, t in (("major", T.MAJOR_FAMILY), ("minor", T.MINOR_FAMILY))}
    name = F.concat(degree.cast("string"), family)
    return F.coalesce(F.when(mode == "major", lookup(tables["major"], name)).otherwise(lookup(tables["minor"], name)), F.lit(False))


def key_chord_evidence(chords: DataFrame, keys: DataFrame) -> DataFrame:
    """How well the chords of a song fit a key (song_id, tonic, mode): share of time on scale chords and on the tonic chord, V to I moves."""
    ahead = F.lead("root_pc").over(by())
    rows = chords.select("song_id", "pos", "root_pc", "quality", "duration", ahead.alias("ahead")).join(keys.select("song_id", "tonic", "mode"), "song_id")
    degree, family = F.pmod(F.col("root_pc") - F.col("tonic"), F.lit(12)), _family(F.col("quality"))
    resolves = (degree == 7) & (F.pmod(F.col("ahead") - F.col("tonic"), F.lit(12)) == 0)
    some = lambda c: F.sum(F.when(c, F.col("duration")).otherwise(0.0))
    total = F.when(F.sum("duration") == 0, 1.0).otherwise(F.sum("duration"))
    out = rows.groupBy("song_id", "tonic", "mode").agg((some(_fits(F.col("mode"), degree, family)) / total).alias("diatonic_fit"), (some((degree == 0) & (family == F.col("mode"))) / total).alias("tonic_time"), F.count_if(resolves).alias("resolutions"), F.count(F.lit(1)).alias("n"))
    moves = F.least(F.lit(1.0), F.col("resolutions") / F.col("n") * 4)
    return out.withColumn("combined", 0.55 * F.col("diatonic_fit") + 0.35 * F.col("tonic_time") + 0.10 * moves).drop("n")


def _ends(frames: DataFrame, frame_s: float) -> DataFrame:
    """Per song: number of frames, and the sums of the chroma at its beginning and at its end.

    Only the first 45 and the last 20 seconds can matter; they are equality joins of two short stretches of frame numbers.
    """
    counts = frames.groupBy("song_id").agg((F.max("frame") + 1).alias("n"))
    length = F.col("n") * frame_s
    early = F.floor(F.least(F.lit(45.0), length * 0.12) / frame_s).cast("int")
    late = F.floor(F.greatest(F.lit(0.0), length - F.least(F.lit(20.0), length * 0.08)) / frame_s).cast("int")
    spans = counts.withColumn("early", early).withColumn("late", late).withColumn("last", F.col("n").cast("int") - 1)
    side = lambda name, a, b: spans.where(a <= b).select("song_id", F.explode(F.sequence(a, b)).alias("frame"), F.lit(name).alias("end"))
    wanted = side("early", F.lit(0), F.col("early") - 1).unionByName(side("late", F.col("late"), F.col("last")))
    rows = wanted.join(frames.select("song_id", "frame", "chroma"), ["song_id", "frame"])
    sums = rows.groupBy("song_id").agg(*(F.array(*(F.sum(F.when(F.col("end") == w, F.col("chroma")[i]).otherwise(0.0)) for i in range(12))).alias(w) for w in ("early", "late")))
    none = F.array(*(F.lit(0.0) for _ in range(12)))
    return counts.join(sums, "song_id", "left").select("song_id", "n", *(F.coalesce(w, none).alias(w) for w in ("early", "late")))


def _endpoint(frame_s: float) -> Column:
    share = lambda w: F.element_at(unit_sum(F.col(w)), F.col("tonic") + 1)
    return F.when(F.col("n") * frame_s <= 2.0, 0.0).otherwise(0.35 * share("early") + 0.65 * share("late"))


def endpoint_evidence(frames: DataFrame, keys: DataFrame, frame_s: float = T.HOP / T.SAMPLE_RATE) -> DataFrame:
    """Share of the tonic in the chroma of a song's beginning and end, the end counting more; 0 for songs of two seconds or less."""
    return keys.select("song_id", "tonic", "mode").join(_ends(frames, frame_s), "song_id").select("song_id", "tonic", "mode", _endpoint(frame_s).alias("endpoint"))


def refine_key_mode(song_key: DataFrame, chords: DataFrame, frames: DataFrame, frame_s: float = T.HOP / T.SAMPLE_RATE) -> DataFrame:
    """The song's key or its relative, whichever chords and endpoints favour; the relative needs a lead of 0.05.

    Songs without chords stay, and so do those whose key the listener gave (user_forced, if there is that column).
    """
    other = F.struct(relative_tonic(F.col("tonic"), F.col("mode")).cast("int").alias("tonic"), other_mode(F.col("mode")).alias("mode"))
    both = song_key.select("song_id", F.explode(F.array(F.struct(F.col("tonic").cast("int").alias("tonic"), "mode"), other)).alias("k")).select("song_id", "k.*")
    # the evidence of both keys meets by song, and so do the ends of the song; the keys are made once for it and once for the result
    scored = key_chord_evidence(chords, both).join(_ends(frames, frame_s), "song_id").withColumn("score", F.col("combined") + 0.35 * _endpoint(frame_s))
    names = F.map_from_entries(F.collect_list(F.struct(F.concat(F.col("tonic").cast("string"), "mode"), "score")))
    rows = song_key.join(scored.groupBy("song_id").agg(names.alias("scores")), "song_id", "left").withColumn("other", other)
    mine, theirs = (F.get(F.transform(F.array(F.concat(t.cast("string"), m)), lambda k: F.element_at("scores", k)), F.lit(0)) for t, m in ((F.col("tonic"), F.col("mode")), (F.col("other.tonic"), F.col("other.mode"))))
    free = ~F.coalesce("user_forced", F.lit(False)) if "user_forced" in song_key.columns else F.lit(True)
    rows = rows.withColumn("flip", F.coalesce((theirs > mine + 0.05) & free, F.lit(False)))
    pick = lambda c: F.when(F.col("flip"), F.col(f"other.{c}")).otherwise(F.col(c)).alias(c)
    return rows.select("song_id", pick("tonic"), pick("mode"), "confidence", "margin", F.col("flip").alias("mode_corrected_by_chords"))
