"""The registered music queries: each applies one operator to song tables read from the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.functions import names as N
from cadenza.operators import beats as B
from cadenza.operators import chords as C
from cadenza.operators import evaluate as E
from cadenza.operators import key as K
from cadenza.operators import progression as P
from cadenza.operators import rescue as X
from cadenza.operators import structure as S
from cadenza.plans import analysis as W
from cadenza.plans import document as D
from cadenza.sources import adapters as A
from cadenza.sources import requests as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def joined(column: str) -> F.Column:
    return F.array_join(column, " ")


def sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.add_nashville(P.chord_sequence(A.chords(spark, sf_dir)))


# sources and requests


@query
def audio_manifest(spark, sf_dir):
    suffix = N.entry((".mp3", ".WAV", ".txt", "", ".flac", ".Aac"), F.pmod("doc_id", F.lit(6)))
    files = A.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("songs/"), "source", F.lit("/"), F.col("doc_id").cast("string"), suffix).alias("path"))
    return R.audio_manifest(files)


@query
def clip_quality_gate(spark, sf_dir):
    clips = A.song_events(spark, sf_dir).groupBy("song_id").agg((F.sum("k") * 100).alias("n_samples"), (F.max("value") / 1e8).alias("peak")).withColumn("sr", F.lit(22050))
    return R.clip_quality_gate(clips).select("song_id", F.round("seconds", 6).alias("seconds"), "is_usable", "reason")


@query
def apply_overrides(spark, sf_dir):
    first = A.song_events(spark, sf_dir).where("pos = 0")
    keys = N.entry(("Ab major", "F# minor", "bb", "", "H major", "c Minor"), F.pmod("k", F.lit(6)))
    meters = N.entry(("4/4", "5/4", "6/8", "3/4"), F.pmod("k", F.lit(4)))
    wishes = first.select("song_id", meters.alias("meter"), (F.col("k") * 3.0).alias("bpm"), keys.alias("key"))
    return R.apply_overrides(first.select("song_id"), wishes).withColumn("forced_tonic", F.coalesce("forced_tonic", F.lit(-1)))


# scalar functions


@query
def parse_key(spark, sf_dir):
    text = F.concat(N.entry(("Ab", "f#", "Bb", "H", "", "c", "E"), F.pmod("k", F.lit(7))), N.entry((" major", " minor", "", "  Min", " dorian"), F.pmod("pos", F.lit(5))))
    rows = A.song_events(spark, sf_dir).select("song_id", "pos", text.alias("text"))
    key = N.parse_key(F.col("text"))
    return rows.select("song_id", "pos", F.coalesce(key["tonic"], F.lit(-1)).alias("tonic"), key["mode"].alias("mode"))


def _pairs(spark, sf_dir):
    """A pitch class, a tonic and a mode per event."""
    return A.song_events(spark, sf_dir).select("song_id", "pos", F.pmod("k", F.lit(12)).alias("pc"), F.pmod(F.col("pos") * 5, F.lit(12)).alias("tonic"), F.when(F.col("k") < 50, "major").otherwise("minor").alias("mode"))


@query
def spell_pitch(spark, sf_dir):
    return _pairs(spark, sf_dir).select("song_id", "pos", N.spell_pitch(F.col("pc"), F.col("tonic"), F.col("mode")).alias("name"))


@query
def relative_key(spark, sf_dir):
    return _pairs(spark, sf_dir).select("song_id", "pos", N.relative_key(F.col("tonic"), F.col("mode")).alias("name"))


def _wide_labels(spark, sf_dir):
    rows = A.chords(spark, sf_dir, wide=True)
    odd = F.when(F.col("pos") % 11 == 0, F.concat(F.lower("root"), F.lit("?"))).when(F.col("pos") % 13 == 0, F.concat("root", F.lit("sus4")))
    return rows.withColumn("chord", F.coalesce(odd, N.chord_label(F.col("root"), F.col("quality"))))


@query
def split_chord(spark, sf_dir):
    return _wide_labels(spark, sf_dir).select("song_id", "pos", N.chord_root(F.col("chord")).alias("root"), N.chord_quality(F.col("chord")).alias("quality"))


@query
def chord_label(spark, sf_dir):
    return A.chords(spark, sf_dir, wide=True).select("song_id", "pos", N.chord_label(F.col("root"), F.col("quality")).alias("chord"))


@query
def chord_to_nashville(spark, sf_dir):
    key = N.entry(("Ab major", "G minor", "", "F#"), F.pmod("pos", F.lit(4)))
    return _wide_labels(spark, sf_dir).select("song_id", "pos", N.chord_to_nashville(F.col("chord"), key).alias("nashville"))


@query
def harmonic_role(spark, sf_dir):
    chord = N.entry(("I", "ii", "V", "vii°", "A♭", "", "X", "Ab"), F.pmod("k", F.lit(8)))
    key = N.entry(("Ab major", "C", ""), F.pmod("pos", F.lit(3)))
    return A.song_events(spark, sf_dir).select("song_id", "pos", N.harmonic_role(chord, key).alias("role"))


@query
def format_clock(spark, sf_dir):
    return A.song_events(spark, sf_dir).select("song_id", "pos", N.format_clock(F.col("k") + F.col("pos") * 0.25).alias("clock"))


# progressions


@query
def chord_sequence(spark, sf_dir):
    return sequence(spark, sf_dir).select("song_id", "pos", "chord", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), F.round("confidence", 6).alias("confidence"), "bar")


@query
def add_nashville(spark, sf_dir):
    rows = P.chord_sequence(A.chords(spark, sf_dir, wide=True)).withColumn("key_tonic", F.when(F.col("pos") % 7 > 0, F.col("key_tonic")))
    key = rows.groupBy("song_id").agg((F.count(F.lit(1)) % 12).cast("int").alias("tonic"))
    return P.add_nashville(rows, key).select("song_id", "pos", "chord", "nashville")


@query
def repeated_patterns(spark, sf_dir):
    found = P.repeated_patterns(sequence(spark, sf_dir))
    places = F.array_join(F.transform("locations", lambda x: F.concat(x["pos"].cast("string"), F.lit(":"), F.array_join(x["numbers"], " "))), ",")
    return found.select("song_id", joined("pattern").alias("pattern"), "length", "occurrences", "first_pos", joined("numbers").alias("numbers"), places.alias("places"))


@query
def maximal_patterns(spark, sf_dir):
    found = P.maximal_patterns(P.repeated_patterns(sequence(spark, sf_dir)))
    return found.select("song_id", joined("pattern").alias("pattern"), "length", "occurrences", "first_pos", joined("numbers").alias("numbers"))


def _long_glitches(spark, sf_dir):
    return sequence(spark, sf_dir).withColumn("duration", F.col("duration") / 8)


@query
def stabilize_chords(spark, sf_dir):
    return P.stabilize_chords(_long_glitches(spark, sf_dir)).select("song_id", "pos", "chord", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query
def chord_statistics(spark, sf_dir):
    found = P.chord_statistics(_long_glitches(spark, sf_dir))
    counts = F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return found.select("song_id", "original", "stabilized", "different", counts.alias("counts"))


@query
def alternating_vamps(spark, sf_dir):
    return P.alternating_vamps(sequence(spark, sf_dir)).select("song_id", "first_pos", "length", "a", "b")


@query
def repeated_regions(spark, sf_dir):
    return P.repeated_regions(sequence(spark, sf_dir)).select("song_id", joined("signature").alias("signature"), "occurrences", "first_pos")


@query
def rotation_merged_regions(spark, sf_dir):
    return P.rotation_merged_regions(P.repeated_regions(sequence(spark, sf_dir))).select("song_id", joined("signature").alias("signature"), "occurrences", "first_pos", "variants")


@query
def compress_runs(spark, sf_dir):
    return P.compress_runs(A.chords(spark, sf_dir).withColumn("chord", F.when(F.col("pos") % 9 > 0, N.chord_label(F.col("root"), F.col("quality")))))


# keys: windows of 12 notes every 3 notes, one note a second; the stretch that a window owns is a little longer than its hop

WINDOW, HOP, WINDOW_S, HOP_S = 12, 3, 12.5, 3.25


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(c, 6) + F.lit(0.0))  # no negative zero
    return df


def _windows(spark, sf_dir):
    return K.key_windows(A.frames(spark, sf_dir), WINDOW, HOP)


def _path(spark, sf_dir):
    return K.key_path(K.region_scores(_windows(spark, sf_dir)))


def _key(spark, sf_dir):
    return K.key_mode_vote(_path(spark, sf_dir))


def _candidates(spark, sf_dir):
    return K.key_candidates(K.global_chroma(A.frames(spark, sf_dir)))


def _durations(spark, sf_dir):
    return A.song_events(spark, sf_dir).groupBy("song_id").agg((F.max("pos") + 1.0).alias("duration"))


def _timeline(spark, sf_dir):
    return K.key_timeline(_path(spark, sf_dir), _durations(spark, sf_dir), HOP, WINDOW_S, HOP_S, 1.0)


def _forced(spark, sf_dir):
    return A.song_events(spark, sf_dir).where("pos = 0 and k % 3 = 0").select("song_id", F.pmod("k", F.lit(12)).alias("forced_tonic"), F.lit("minor").alias("forced_mode"))


def _spread(df, column, *keys):
    return df.select(*keys, F.posexplode(column).alias("pc", "x")).select(*keys, "pc", F.round("x", 6).alias("x"))


@query
def global_chroma(spark, sf_dir):
    return _spread(K.global_chroma(A.frames(spark, sf_dir)), "chroma", "song_id")


@query
def key_candidates(spark, sf_dir):
    return rounded(_candidates(spark, sf_dir), "score")


@query
def key_windows(spark, sf_dir):
    return _spread(_windows(spark, sf_dir), "chroma", "song_id", "win")


@query
def region_scores(spark, sf_dir):
    return _spread(K.region_scores(_windows(spark, sf_dir)), "scores", "song_id", "win")


@query
def key_path(spark, sf_dir):
    return _path(spark, sf_dir).drop("chroma")


@query
def key_mode_vote(spark, sf_dir):
    return rounded(_key(spark, sf_dir), "confidence", "margin")


@query
def key_timeline(spark, sf_dir):
    return _timeline(spark, sf_dir)


@query
def modulations(spark, sf_dir):
    return K.modulations(_timeline(spark, sf_dir))


@query
def key_runner_up(spark, sf_dir):
    return rounded(K.key_runner_up(_candidates(spark, sf_dir), _candidates(spark, sf_dir).where("rank = 1")), "score")


@query
def forced_key(spark, sf_dir):
    return rounded(K.forced_key(_key(spark, sf_dir), _candidates(spark, sf_dir), _forced(spark, sf_dir)), "confidence", "margin")


@query
def forced_timeline(spark, sf_dir):
    """Also in it: forced songs have no modulation."""
    timeline = K.forced_timeline(_timeline(spark, sf_dir), _forced(spark, sf_dir), _durations(spark, sf_dir))
    return timeline.withColumn("segments", F.count(F.lit(1)).over(Window.partitionBy("song_id")))


@query
def relabelled_timeline(spark, sf_dir):
    other = A.song_events(spark, sf_dir).where("pos = 0").select("song_id", F.when(F.col("k") % 2 == 0, "major").otherwise("minor").alias("mode"))
    return K.relabelled_timeline(_timeline(spark, sf_dir), other)


@query
def key_at(spark, sf_dir):
    points = A.song_events(spark, sf_dir).select("song_id", "pos", (F.col("pos") * 1.1).alias("time"))
    return K.key_at(points, _timeline(spark, sf_dir), _key(spark, sf_dir)).select("song_id", "pos", "key_tonic", "key_mode")


@query
def key_chord_evidence(spark, sf_dir):
    keys = _candidates(spark, sf_dir).where("rank <= 3").select("song_id", "tonic", "mode")
    return rounded(K.key_chord_evidence(A.chords(spark, sf_dir), keys), "diatonic_fit", "tonic_time", "combined")


@query
def endpoint_evidence(spark, sf_dir):
    return rounded(K.endpoint_evidence(A.frames(spark, sf_dir), _candidates(spark, sf_dir).where("rank = 1"), 1.0), "endpoint")


@query
def refine_key_mode(spark, sf_dir):
    best = _candidates(spark, sf_dir).where("rank = 1").select("song_id", "tonic", "mode", F.col("score").alias("confidence"), F.lit(0.0).alias("margin"))
    return rounded(K.refine_key_mode(best, A.chords(spark, sf_dir), A.frames(spark, sf_dir), 1.0), "confidence")


# beats: one event a beat; where frames matter, every fifth note is a beat


def _every(spark, sf_dir, n=5):
    return A.song_events(spark, sf_dir).where(F.col("pos") % n == 0).select("song_id", (F.col("pos") / n).cast("int").alias("beat"), F.col("pos").alias("frame"), F.col("t").alias("time"))


def _series(spark, sf_dir):
    return B.zscore(A.beat_series(spark, sf_dir), {"low": "low_z", "full": "full_z", "nov": "nov_z"})


def _n_frames(spark, sf_dir):
    return A.beat_series(spark, sf_dir).groupBy("song_id").agg((F.max("frame") + 70).alias("n"))


@query
def beat_accents(spark, sf_dir):
    return B.beat_accents(A.frames(spark, sf_dir), _every(spark, sf_dir)).select("song_id", "beat", "acc_low_env", "acc_onset_env")


@query
def beat_chroma(spark, sf_dir):
    return _spread(B.beat_chroma(A.frames(spark, sf_dir), _every(spark, sf_dir)), "chroma", "song_id", "beat")


@query
def beat_novelty(spark, sf_dir):
    rows = A.frames(spark, sf_dir).withColumnRenamed("frame", "beat")
    return rounded(B.beat_novelty(rows), "novelty").select("song_id", "beat", "novelty")


@query
def zscore(spark, sf_dir):
    return rounded(_series(spark, sf_dir), "low_z", "full_z", "nov_z").select("song_id", "beat", "low_z", "full_z", "nov_z")


@query
def onset_peaks(spark, sf_dir):
    return B.onset_peaks(A.frames(spark, sf_dir))


@query
def grid_coverage(spark, sf_dir):
    onsets = A.frames(spark, sf_dir).where("low_env > 40").select("song_id", (F.col("frame") * 3).alias("frame"))
    return rounded(B.grid_coverage(onsets, _every(spark, sf_dir).select("song_id", (F.col("frame") * 3).alias("frame"))), "coverage")


@query
def tempo_fold(spark, sf_dir):
    pace = F.pmod("song_id", F.lit(3))
    rows = A.beat_series(spark, sf_dir).withColumn("frame", (F.col("beat") * F.when(pace == 0, 20).when(pace == 1, 10).otherwise(61) + F.col("frame") % 5).cast("int"))
    return rounded(B.tempo_fold(rows.withColumn("keep", F.col("song_id") % 7 == 0)), "tempo", "tempo_half", "tempo_double")


@query
def extend_grid(spark, sf_dir):
    return B.extend_grid(A.beat_series(spark, sf_dir).where("beat > 6"), _n_frames(spark, sf_dir))


@query
def tempo_stability(spark, sf_dir):
    return rounded(B.tempo_stability(A.beat_series(spark, sf_dir)), "stability")


@query
def triplet_feel(spark, sf_dir):
    return rounded(B.triplet_feel(A.frames(spark, sf_dir), _every(spark, sf_dir, 7)), "triplet")


@query
def autocorrelation(spark, sf_dir):
    return rounded(B.autocorrelation(A.beat_series(spark, sf_dir), "low"), "acf")


def _meter(spark, sf_dir):
    beats = A.beat_series(spark, sf_dir)
    feel = beats.where("beat = 0").select("song_id", (F.pmod("song_id", F.lit(8)) / 50 + 0.40).alias("triplet"))
    return B.estimate_meter(B.autocorrelation(beats, "low"), B.autocorrelation(beats, "nov"), feel)


@query
def estimate_meter(spark, sf_dir):
    found = rounded(_meter(spark, sf_dir), "confidence")
    return found.select("song_id", "label", "bpb", "confidence", F.array_join(F.transform("alternatives", lambda a: a["label"]), " ").alias("best"))


def _tempo(spark, sf_dir):
    return B.downbeat_phase(_series(spark, sf_dir), _meter(spark, sf_dir))


@query
def forced_meter(spark, sf_dir):
    wish = A.song_events(spark, sf_dir).where("pos = 0").select("song_id", N.entry(("4/4", "5/4", "6/8", "3/4"), F.pmod("k", F.lit(4))).alias("forced_meter"))
    found = rounded(B.forced_meter(_meter(spark, sf_dir), wish), "confidence")
    return found.select("song_id", "label", "bpb", "confidence", "user_forced")


@query
def downbeat_phase(spark, sf_dir):
    return _tempo(spark, sf_dir)


@query
def build_bars(spark, sf_dir):
    return rounded(B.build_bars(A.beat_series(spark, sf_dir).drop("frame"), _tempo(spark, sf_dir)), "start", "end")


@query
def bar_frames(spark, sf_dir):
    return B.build_bars(A.beat_series(spark, sf_dir), _tempo(spark, sf_dir)).select("song_id", "index", "frame_start", "frame_end")


@query
def harmonic_novelty(spark, sf_dir):
    return rounded(B.harmonic_novelty(A.frames(spark, sf_dir), 4), "novelty")


# chords: one note a beat; two stretches of key in every song


def _chord_beats(spark, sf_dir):
    times = A.song_events(spark, sf_dir).select("song_id", F.col("pos").alias("frame"), F.col("t").alias("time"))
    return A.frames(spark, sf_dir).join(times, ["song_id", "frame"]).withColumnRenamed("frame", "beat").select("song_id", "beat", "time", "chroma", "bass")


def _two_keys(spark, sf_dir):
    songs = A.song_events(spark, sf_dir).where("pos = 0").select("song_id")
    one = songs.select("song_id", F.lit(0).alias("seg"), F.lit(0.0).alias("start"), F.lit(300.0).alias("end"), F.pmod("song_id", F.lit(12)).cast("int").alias("tonic"), F.lit("major").alias("mode"))
    two = songs.select("song_id", F.lit(1), F.lit(299.5), F.lit(600.0), F.pmod(F.col("song_id") + 7, F.lit(12)).cast("int"), F.lit("minor"))
    return one.union(two), one.select("song_id", "tonic", "mode"), songs.select("song_id", F.pmod("song_id", F.lit(3)).cast("int").alias("phase"), F.lit(4).alias("bpb"))


def _heard(spark, sf_dir):
    timeline, key, tempo = _two_keys(spark, sf_dir)
    scored = C.chord_template_scores(_chord_beats(spark, sf_dir))
    return C.change_probability(C.chord_emission(C.key_prior(scored, timeline, key)), tempo)


def _segments(spark, sf_dir):
    beats = _heard(spark, sf_dir)
    return C.chord_segments(C.chord_path(beats), beats, _two_keys(spark, sf_dir)[2])


def _weighed(column):
    """One number for an array of sixty: each entry times its place."""
    return F.round(F.aggregate(F.transform(column, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x), 4)


@query
def chord_template_scores(spark, sf_dir):
    return C.chord_template_scores(_chord_beats(spark, sf_dir)).select("song_id", "beat", _weighed("scores").alias("x"))


@query
def key_prior(spark, sf_dir):
    timeline, key, _ = _two_keys(spark, sf_dir)
    return C.key_prior(_chord_beats(spark, sf_dir), timeline, key).select("song_id", "beat", "key_tonic", "key_mode", _weighed("prior").alias("x"))


@query
def chord_emission(spark, sf_dir):
    return _heard(spark, sf_dir).select("song_id", "beat", _weighed("emission").alias("x"))


@query
def change_probability(spark, sf_dir):
    return _heard(spark, sf_dir).select("song_id", "beat", "p_change")


@query
def chord_path(spark, sf_dir):
    return C.chord_path(_heard(spark, sf_dir).select("song_id", "beat", "emission", "p_change"))


@query
def chord_segments(spark, sf_dir):
    return rounded(_segments(spark, sf_dir), "start", "end", "duration", "confidence")


@query
def spell_chords(spark, sf_dir):
    timeline, key, _ = _two_keys(spark, sf_dir)
    return C.spell_chords(_segments(spark, sf_dir), timeline, key).select("song_id", "pos", "root", "quality", "key_tonic", "key_mode")


# evaluation: narrow chords as truth, the same with other roots now and then as found


def _found_and_true(spark, sf_dir):
    rows = A.chords(spark, sf_dir)
    found = rows.select("song_id", (F.col("start") + 0.5).alias("start"), (F.col("end") + 0.5).alias("end"), F.when(F.col("pos") % 5 == 0, 1).otherwise(F.col("root_pc")).alias("root_pc"), "quality")
    return found, rows.select("song_id", F.col("start").alias("t0"), F.col("end").alias("t1"), F.col("root_pc").alias("root"), "quality")


@query
def chord_accuracy(spark, sf_dir):
    return rounded(E.chord_accuracy(*_found_and_true(spark, sf_dir)), "accuracy")


@query
def regression_report(spark, sf_dir):
    first = A.song_events(spark, sf_dir).where("pos = 0")
    meter = N.entry(("4/4", "3/4"), F.pmod("k", F.lit(2)))
    truth = first.select("song_id", F.pmod("k", F.lit(12)).alias("tonic"), (F.col("k") + 60.0).alias("bpm"), meter.alias("meter"))
    found = first.where("k % 7 > 0").select("song_id", F.pmod("k", F.lit(11)).alias("tonic"), (F.col("k") * 1.02 + 60).alias("bpm"), F.lit("4/4").alias("meter"))
    report = rounded(E.regression_report(found, truth, E.chord_accuracy(*_found_and_true(spark, sf_dir))), "chord_accuracy")
    return report.select("song_id", "key_ok", "tempo_ok", "meter_ok", "chord_accuracy")


@query
def regression_values(spark, sf_dir):
    """The report with both sides: the few chords stand for what was found, the many for the truth, every eighth chord begins a section."""
    sides = []
    for song in (A.chords(spark, sf_dir), A.chords(spark, sf_dir, wide=True)):
        counts = song.groupBy("song_id").agg(F.max_by("root_pc", F.struct("duration", "pos")).alias("tonic"), (F.count(F.lit(1)) * 1.5).alias("bpm"), F.when(F.count_if(F.col("quality") == "minor") % 2 == 0, "4/4").otherwise("3/4").alias("meter"))
        parts = song.where("pos % 8 = 0").groupBy("song_id").agg(F.sort_array(F.collect_list(F.struct("pos", "root"))).alias("p"))
        sides.append(counts.join(parts, "song_id").select("song_id", "tonic", "bpm", "meter", F.array_join(F.transform("p", lambda x: x["root"]), " - ").alias("form"), F.size("p").alias("n_sections")))
    found, truth = sides[0].where("song_id % 7 > 0"), sides[1]
    played = A.chords(spark, sf_dir, wide=True).select("song_id", F.col("start").alias("t0"), F.col("end").alias("t1"), F.col("root_pc").alias("root"), "quality")
    return rounded(E.regression_report(found, truth, E.chord_accuracy(A.chords(spark, sf_dir), played)), "chord_accuracy")


# structure: bars of one song per label, two seconds each


def _vector_bars(spark, sf_dir):
    v = A.bar_vectors(spark, sf_dir)
    length = F.sqrt(F.aggregate(F.slice("v", 37, 4), F.lit(0.0), lambda a, x: a + x * x))
    part = lambda k: F.slice("v", k, 12)
    return v.select("song_id", "bar", S.unit(part(1)).alias("chroma"), S.unit(part(13)).alias("bass"), part(25).alias("timbre"), length.alias("rms"), (F.col("bar") * 2.0).alias("start"), (F.col("bar") * 2.0 + 2).alias("end"))


def _bars(spark, sf_dir):
    return S.bar_vectors(_vector_bars(spark, sf_dir))


def _settled(spark, sf_dir, **steps):
    bars = _bars(spark, sf_dir)
    blocks = S.block_clusters(bars)
    return S.settle_parts(S.merge_parts(blocks), bars, blocks, **steps), bars


def _plain_bars(spark, sf_dir):
    """Bars of a song of events: four to a chord."""
    rows = A.song_events(spark, sf_dir).select("song_id", "pos", "value", "k", F.explode(F.array(*(F.lit(i) for i in range(4)))).alias("i"))
    bar = (F.col("pos") * 4 + F.col("i")).cast("int")
    return rows.select("song_id", bar.alias("bar"), (F.col("value") * (F.pmod("k", F.lit(5)) + 1)).alias("energy"), (bar * 2.0).alias("start"), (bar * 2.0 + 2).alias("end"))


def _plain_parts(spark, sf_dir):
    """Parts of a song of events: equal neighbours among its first chords, then among the rest by threes; clusters by appearance."""
    rows = A.chords(spark, sf_dir).select("song_id", (F.col("pos") * 4).cast("int").alias("a"), (F.col("pos") * 4 + 4).cast("int").alias("b"), F.when(F.col("pos") < 9, F.col("root_pc")).otherwise(F.floor(F.col("pos") / 9) % 3).cast("int").alias("cluster"))
    parts = S.merge_parts(rows)
    first = F.min("part").over(Window.partitionBy("song_id", "cluster"))
    return parts.withColumn("first", first).withColumn("cluster", (F.dense_rank().over(Window.partitionBy("song_id").orderBy("first")) - 1).cast("int")).drop("first")


def _plain_lines(spark, sf_dir):
    rows = A.song_events(spark, sf_dir)
    return rows.select("song_id", (F.col("pos") * 4).cast("int").alias("a"), (F.col("pos") * 4 + 4).cast("int").alias("b"), F.when(F.col("pos") % 4 < 3, 0).otherwise(F.pmod("k", F.lit(3))).cast("int").alias("cluster"))


def _named_parts(spark, sf_dir):
    """Parts by name, and the bars. What several steps read is written once, here and below: a plan that holds the whole way to each of
    its inputs again outgrows the driver."""
    bars = W.checkpointed(_plain_bars(spark, sf_dir))
    return W.checkpointed(S.name_parts(W.checkpointed(_plain_parts(spark, sf_dir)), bars)), bars


def _named(spark, sf_dir):
    """The same with vamps; parts, bars and lines."""
    parts, bars = _named_parts(spark, sf_dir)
    lines = W.checkpointed(_plain_lines(spark, sf_dir))
    return W.checkpointed(S.name_vamps(parts, lines)), bars, lines


def _said(spark, sf_dir):
    return sequence(spark, sf_dir).select("song_id", "pos", "chord", "nashville", (F.col("pos") * 8.0).alias("start"))


def _sections(spark, sf_dir):
    """Sections, bars, lines and the chords that sound in them."""
    parts, bars, lines = _named(spark, sf_dir)
    said = W.checkpointed(_said(spark, sf_dir))
    return W.checkpointed(S.sections(parts, said, bars, lines)), bars, lines, said


@query
def bar_features(spark, sf_dir):
    timeline, key, _ = _two_keys(spark, sf_dir)
    events = A.song_events(spark, sf_dir)
    bars = events.groupBy("song_id", F.floor(F.col("pos") / 4).cast("int").alias("bar")).agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.min("t").alias("start"), F.max("t").alias("end"))
    found = S.bar_features(A.frames(spark, sf_dir), bars, timeline, key)
    return found.select("song_id", "bar", _weighed("chroma").alias("chroma"), _weighed("bass").alias("bass"), _weighed("timbre").alias("timbre"), F.round("rms", 6).alias("rms"))


@query
def bar_vectors(spark, sf_dir):
    return _bars(spark, sf_dir).select("song_id", "bar", _weighed("v").alias("v"), _weighed("w").alias("w"))


@query
def choose_tiling(spark, sf_dir):
    return rounded(S.choose_tiling(_bars(spark, sf_dir)), "score")


@query
def block_clusters(spark, sf_dir):
    return S.block_clusters(_bars(spark, sf_dir))


@query
def merge_parts(spark, sf_dir):
    return S.merge_parts(A.chords(spark, sf_dir).select("song_id", (F.col("pos") * 4).alias("a"), (F.col("pos") * 4 + 4).alias("b"), F.col("root_pc").alias("cluster")))


@query
def attach_fragments(spark, sf_dir):
    bars = _bars(spark, sf_dir)
    eights = bars.where((F.col("bar") - F.col("song_id") % 8) % 8 == 7).where("bar >= 7 + song_id % 8")
    begin = F.col("bar") - 7
    blocks = eights.select("song_id", begin.cast("int").alias("a"), (F.col("bar") + 1).cast("int").alias("b"), (begin / 8).cast("int").alias("cluster"), F.lit(8).alias("length"))
    return S.attach_fragments(blocks, bars)


@query
def merge_inseparable(spark, sf_dir):
    return _settled(spark, sf_dir, split=False)[0]


@query
def split_long_parts(spark, sf_dir):
    return _settled(spark, sf_dir)[0]


@query
def line_clusters(spark, sf_dir):
    return S.line_clusters(_bars(spark, sf_dir))


@query
def name_parts(spark, sf_dir):
    return _named_parts(spark, sf_dir)[0].select("song_id", "part", "cluster", "a", "b", "blocks", "name")


@query
def name_vamps(spark, sf_dir):
    return _named(spark, sf_dir)[0].select("song_id", "part", "cluster", "name")


@query
def sections(spark, sf_dir):
    return _sections(spark, sf_dir)[0].select("song_id", "part", "label", "name", "instance", "of", "start", "end", joined("chords").alias("chords"), joined("nashville").alias("nashville"), joined("lines").alias("lines"))


@query
def structure_repeats(spark, sf_dir):
    found = rounded(S.structure_repeats(*_sections(spark, sf_dir)[:2]), "loudness")
    return found.select("song_id", "label", "name", "occurrences", F.size("instances").alias("n"), joined("chords").alias("chords"), F.round("loudness", 3).alias("loudness"))


@query
def line_repeats(spark, sf_dir):
    sections, bars, lines, said = _sections(spark, sf_dir)
    found = S.line_repeats(lines, sections, said, bars)
    places = F.array_join(F.transform("instances", lambda x: F.concat(x["a"].cast("string"), F.lit(":"), F.coalesce(x["in_part"], F.lit("-")))), " ")
    return found.select("song_id", "line", "occurrences", "bars", joined("chords").alias("chords"), joined("nashville").alias("nashville"), places.alias("places"))


@query
def form_string(spark, sf_dir):
    return S.form_string(_sections(spark, sf_dir)[0])


# second thoughts, and the whole document


@query
def refine_pulse(spark, sf_dir):
    beats = A.song_events(spark, sf_dir).where("pos % 4 = 0").select("song_id", (F.col("pos") / 4).cast("int").alias("beat"), (F.col("pos") * 10).cast("int").alias("frame"))
    onsets = A.frames(spark, sf_dir).where("low_env > 20").select("song_id", (F.col("frame") * 10).alias("frame"))
    return X.refine_pulse(beats, onsets)


def _periods(spark, sf_dir):
    frames = A.frames(spark, sf_dir)
    return X.bar_period(frames.join(B.harmonic_novelty(frames, 2), ["song_id", "frame"]), 0.2)


@query
def bar_period(spark, sf_dir):
    return rounded(_periods(spark, sf_dir).select("song_id", "bar_s", "strength"), "bar_s", "strength")


@query
def rescue_meter(spark, sf_dir):
    bars = B.build_bars(A.beat_series(spark, sf_dir), _tempo(spark, sf_dir))
    wish = A.song_events(spark, sf_dir).where("pos = 0 and k % 5 = 0").select("song_id", (F.col("k") + 60.0).alias("forced_bpm"))
    return rounded(X.rescue_meter(_periods(spark, sf_dir), bars, 0.2, wish).select("song_id", "label", "bpb", "bpm", "share"), "bpm", "share")


def _grids(spark, sf_dir):
    """Three tracked grids of every song, asked for at different tempos, and one without a wish for every second song."""
    events = A.song_events(spark, sf_dir)
    hinted = [events.where(F.col("pos") % n == 0).select("song_id", (F.col("pos") / n).cast("int").alias("beat"), F.col("pos").alias("frame"), (F.lit(60.0) + 40 * n + F.col("song_id") % 7).alias("bpm_hint")) for n in (1, 2, 3)]
    plain = events.where("song_id % 2 = 0 and pos % 5 = 0").select("song_id", (F.col("pos") / 5).cast("int").alias("beat"), F.col("pos").alias("frame"), F.lit(None).cast("double").alias("bpm_hint"))
    return hinted[0].unionByName(hinted[1]).unionByName(hinted[2]).unionByName(plain)


@query
def usual_grids(spark, sf_dir):
    return X.usual_grids(_grids(spark, sf_dir)).withColumn("bpm_hint", F.coalesce("bpm_hint", F.lit(0.0)))


@query
def rescued_grids(spark, sf_dir):
    """Grids of the second pass: those near the tempo that the accents would rather have."""
    bars = B.build_bars(A.beat_series(spark, sf_dir), _tempo(spark, sf_dir))
    return X.grids_at(_grids(spark, sf_dir), X.rescue_meter(_periods(spark, sf_dir), bars, 0.2))


@query
def rejected_songs(spark, sf_dir):
    frames = A.frames(spark, sf_dir).where("song_id % 9 > 0")
    beats = A.song_events(spark, sf_dir).where(F.col("k") % (1 + F.col("song_id") % 11) == 0)
    at = F.when(F.col("song_id") % 4 == 1, 7).otherwise(F.col("pos"))
    return X.rejected_songs(frames, beats.select("song_id", F.col("pos").alias("beat"), at.alias("frame")))


@query
def song_document(spark, sf_dir):
    songs = A.song_events(spark, sf_dir).where("pos = 0").select("song_id")
    chords = sequence(spark, sf_dir).select("song_id", "pos", "chord", "nashville")
    patterns = P.maximal_patterns(P.repeated_patterns(sequence(spark, sf_dir))).select("song_id", "first_pos", "length", "occurrences")
    out = D.song_document(songs, {"chords": (chords, "pos"), "patterns": (patterns, "first_pos")})
    return out.select("song_id", F.size("chords").alias("n_chords"), F.when(F.col("patterns").isNull(), 0).otherwise(F.size("patterns")).alias("n_patterns"), F.array_join(F.transform("chords", lambda c: c["chord"]), " ").alias("chords"))


@query
def song_analysis(spark, sf_dir):
    """Every step in a row: an event is a frame of a quarter second, every second one a tracked beat; some songs have wishes."""
    frames, events = A.frames(spark, sf_dir), A.song_events(spark, sf_dir)
    tracked = events.where("pos % 2 = 0").select("song_id", (F.col("pos") / 2).cast("int").alias("beat"), F.col("pos").alias("frame"))
    first = events.where("pos = 0 and k % 4 = 0")
    wish = first.select("song_id", N.entry(("4/4", "6/8", None), F.pmod("k", F.lit(3))).alias("forced_meter"), F.when(F.col("k") % 3 == 0, 120.0).alias("forced_bpm"), F.when(F.col("k") % 5 == 0, F.pmod("k", F.lit(12))).alias("forced_tonic"), F.when(F.col("k") % 5 == 0, "minor").alias("forced_mode"))
    out = rounded(W.analyze(frames, tracked, wish, 0.25), "key_confidence", "meter_confidence", "tempo")
    counts = (F.coalesce(F.size(c), F.lit(0)).alias(f"n_{c}") for c in ("key_timeline", "modulations", "bars", "chords", "patterns", "sections", "lines"))
    return out.select("song_id", "key", "key_confidence", "mode_corrected_by_chords", "meter", "tempo", "fold", "form", *counts)
