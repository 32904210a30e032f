"""The whole way of a song: frames and tracked beats to key, meter, chords, patterns, parts and one document."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions import tables as T
from cadenza.functions.names import key_name, other_mode, relative_key, relative_tonic
from cadenza.operators import beats as B
from cadenza.operators import chords as C
from cadenza.operators import key as K
from cadenza.operators import progression as P
from cadenza.operators import rescue as X
from cadenza.operators import structure as S
from cadenza.plans.document import song_document

FRAME_S = T.HOP / T.SAMPLE_RATE
WINDOW_S, HOP_S, NOVELTY_S = 12.0, 3.0, 0.5
#: Size up to which a side of a join is sent to all executors. Every such table is in the driver's memory first.
BROADCAST = "256k"
RESCUE = "struct<tracker_bar_s:double,music_bar_s:double,tracker_tempo:double,tracker_meter:string,strength:double>"


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one under /tmp where all is one machine."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or "/tmp/checkpoints")
    return spark.sparkContext.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows in the checkpoint folder: several steps read them, and a lost executor doesn't cost the way there."""
    checkpoint_folder(df.sparkSession)
    held = df.persist()  # or the last stage would run twice, once to count and once to write
    try:
        return held.checkpoint()
    finally:
        held.unpersist()


def tabled(df: DataFrame, session: SparkSession | None = None) -> DataFrame:
    """The rows as a table in that folder, for what many steps read a few columns of; read in the given session, else in their own. The
    folder is the caller's to clear."""
    path = f"{checkpoint_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return (session or df.sparkSession).read.schema(df.schema).parquet(path)


def joining_apart(spark: SparkSession) -> SparkSession:
    """A session with the same settings, but joins that broadcast BROADCAST at most.

    The tables of a song's steps have rows for every song: they grow with the input, and dozens of joins meet in one step. What goes to
    all executors up to Spark's own limit, compressed, adds up to more than a driver holds.
    """
    session = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            session.conf.set(key, value)
    for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        session.conf.set(key, "-1" if spark.conf.get(key, None) == "-1" else BROADCAST)
    return session


def find_key(frames: DataFrame, overrides: DataFrame, frame_s: float = FRAME_S) -> tuple[DataFrame, DataFrame, DataFrame]:
    """song_key (tonic, mode, confidence, margin, user_forced), timeline and candidates."""
    hop = max(1, int(HOP_S / frame_s))
    windows = K.key_windows(frames, max(1, int(WINDOW_S / frame_s)), hop)
    path = checkpointed(K.key_path(K.region_scores(windows)))
    durations = frames.groupBy("song_id").agg(((F.max("frame") + 1) * frame_s).alias("duration"))
    candidates = checkpointed(K.key_candidates(K.global_chroma(frames)))
    song_key = K.forced_key(K.key_mode_vote(path), candidates, overrides)
    timeline = K.forced_timeline(K.key_timeline(path, durations, hop, WINDOW_S, HOP_S, frame_s), overrides, durations)
    return checkpointed(song_key), checkpointed(timeline), candidates


def settle_beats(frames: DataFrame, pulse: DataFrame, sizes: DataFrame, overrides: DataFrame, frame_s: float = FRAME_S) -> tuple[DataFrame, DataFrame, DataFrame]:
    """beats (frame, time, chroma, bass), tempo (tempo, fold, regridded, meter, phase, stability) and bars of songs whose pulse is known:
    song_id, beat, frame, regridded and keep (leave this grid as it is)."""
    accents = B.beat_accents(frames, pulse).select("song_id", "beat", "frame", "keep", F.col("acc_low_env").alias("low"), F.col("acc_onset_env").alias("full"))
    folded = checkpointed(B.tempo_fold(accents, frame_s))
    grid = checkpointed(B.extend_grid(folded, sizes))
    beats = B.beat_accents(frames, grid).withColumnRenamed("acc_low_env", "low").withColumnRenamed("acc_onset_env", "full")
    beats = beats.join(B.beat_medians(frames, grid, ("chroma", "bass"), sizes), ["song_id", "beat"])
    beats = B.beat_novelty(beats).withColumn("time", F.col("frame") * frame_s)
    beats = checkpointed(B.zscore(beats, {"low": "low_z", "full": "full_z", "novelty": "nov_z"}))
    accent = beats.withColumn("accent", F.col("low_z") + 0.5 * F.col("full_z"))
    triplet = checkpointed(B.triplet_feel(frames, grid))
    meter = B.estimate_meter(B.autocorrelation(accent, "accent"), B.autocorrelation(accent, "nov_z"), triplet)
    meter = checkpointed(B.forced_meter(meter, overrides))
    phase = B.downbeat_phase(beats, meter).select("song_id", "phase")
    tempo = meter.select("song_id", F.col("label").alias("meter"), "bpb", "confidence", "user_forced", "alternatives").join(phase, "song_id").join(triplet.withColumnRenamed("triplet", "triplet_feel"), "song_id")
    measured = folded.groupBy("song_id").agg(*(F.first(c).alias(c) for c in ("tempo", "tempo_half", "tempo_double", "fold")))
    tempo = tempo.join(measured, "song_id").join(pulse.groupBy("song_id").agg(F.max("regridded").alias("regridded")), "song_id").join(B.tempo_stability(beats), "song_id")
    tempo = checkpointed(tempo)
    return beats, tempo, checkpointed(B.build_bars(beats, tempo))


def find_beats(frames: DataFrame, tracked: DataFrame, overrides: DataFrame, frame_s: float = FRAME_S) -> tuple[DataFrame, DataFrame, DataFrame]:
    """beats, tempo and bars in two passes. Tracked grids (song_id, beat, frame, and bpm_hint if the tracker ran more than once) of songs
    whose tempo the listener gave are kept as they are, the one nearest to that tempo if there is one.

    Where the accents contradict the bars of the first pass, the song goes through these steps again on the grid that was tracked near
    the tempo that the accents say, in their meter, with their share as the confidence (bar_rescue tells what changed). Without
    such a grid the song stays, with needs_retrack and what the tracker should be asked for (retrack).
    """
    if "bpm_hint" not in tracked.columns:
        tracked = tracked.withColumn("bpm_hint", F.lit(None).cast("double"))
    sizes = checkpointed(frames.groupBy("song_id").agg((F.max("frame") + 1).alias("n")))
    usual = X.usual_grids(tracked)
    forced = overrides.where("forced_bpm is not null").select("song_id", F.col("forced_bpm").alias("bpm"))
    near = X.grids_at(tracked, forced)
    asked = near.unionByName(usual.join(forced, "song_id", "left_semi").join(near.select("song_id").distinct(), "song_id", "left_anti"))
    kept = lambda grid: grid.select("song_id", "beat", "frame", F.lit(False).alias("regridded"), F.lit(True).alias("keep"))
    free = checkpointed(usual.join(forced, "song_id", "left_anti").select("song_id", "beat", "frame"))
    pulse = X.refine_pulse(free, checkpointed(B.onset_peaks(frames))).select("song_id", "beat", "frame", "regridded", F.col("regridded").alias("keep"))
    beats, tempo, bars = settle_beats(frames, checkpointed(pulse.unionByName(kept(asked))), sizes, overrides, frame_s)

    novel = frames.select("song_id", "frame", "low_env", "onset_env").join(B.harmonic_novelty(frames, max(2, int(NOVELTY_S / frame_s))), ["song_id", "frame"])
    better = checkpointed(X.rescue_meter(X.bar_period(novel, frame_s), bars, frame_s, overrides))
    again = checkpointed(kept(X.grids_at(tracked, better)))
    chosen = checkpointed(again.select("song_id").distinct())
    says = better.join(chosen, "song_id", "left_anti").select("song_id", F.struct("label", "bpb", "bpm", "share").alias("retrack"))
    tempo = tempo.join(says, "song_id", "left").withColumn("needs_retrack", F.col("retrack").isNotNull())
    if chosen.isEmpty():
        return beats, tempo.withColumn("bar_rescue", F.lit(None).cast(RESCUE)), bars
    was = tempo.select("song_id", F.col("tempo").alias("tracker_tempo"), F.col("meter").alias("tracker_meter"))
    about = better.join(chosen, "song_id").join(was, "song_id").select("song_id", F.col("share").alias("confidence"), F.struct(F.col("tracked_s").alias("tracker_bar_s"), F.col("bar_s").alias("music_bar_s"), "tracker_tempo", "tracker_meter", "strength").alias("bar_rescue"))
    wanted = better.select("song_id", F.col("label").alias("forced_meter"))
    beats_2, tempo_2, bars_2 = settle_beats(frames.join(chosen, "song_id", "left_semi"), again, sizes, wanted, frame_s)
    tempo_2 = tempo_2.drop("confidence").join(about, "song_id").withColumn("user_forced", F.lit(False)).withColumn("needs_retrack", F.lit(False))
    first = lambda rows: rows.join(chosen, "song_id", "left_anti")
    return checkpointed(first(beats).unionByName(beats_2)), first(tempo).unionByName(tempo_2, allowMissingColumns=True), checkpointed(first(bars).unionByName(bars_2))


def find_chords(beats: DataFrame, tempo: DataFrame, timeline: DataFrame, song_key: DataFrame) -> DataFrame:
    """Chord segments, named in the key that holds at their middle."""
    heard = C.chord_emission(C.key_prior(C.chord_template_scores(beats), timeline, song_key))
    heard = C.change_probability(heard, tempo)
    return C.spell_chords(C.chord_segments(C.chord_path(heard), heard, tempo), timeline, song_key)


def find_parts(frames: DataFrame, bars: DataFrame, timeline: DataFrame, song_key: DataFrame, sequence: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """sections, parts and lines that come again, and of each song the form and how many bars a block and a line have; songs of under
    eight bars or without repeats have none. Bars are cut at the frames of their beats."""
    n = frames.groupBy("song_id").agg((F.max("frame") + 1).alias("n"))
    spans = bars.select("song_id", F.col("index").alias("bar"), "start", "end", "frame_start", "frame_end").join(n, "song_id")
    spans = spans.withColumn("first", F.least(F.col("frame_start"), F.col("n") - 1)).withColumn("last", F.greatest("first", F.least(F.col("frame_end"), F.col("n")) - 1))
    vectors = checkpointed(S.bar_vectors(S.bar_features(frames, spans, timeline, song_key)))
    times = spans.select("song_id", "bar", "start", "end")
    blocks = checkpointed(S.block_clusters(vectors))
    lines = checkpointed(S.line_clusters(vectors))
    parts = checkpointed(S.settle_parts(S.merge_parts(blocks), vectors, blocks))
    # each step reads its input several times: one plan for all would hold the whole way to it as often
    named = checkpointed(S.name_vamps(checkpointed(S.name_parts(parts, vectors)), lines))
    sections = checkpointed(S.sections(named, sequence, times, lines))
    length = blocks.groupBy("song_id").agg(F.first("length").alias("block_bars"))
    form = S.form_string(sections).join(length.withColumn("line_bars", F.greatest(F.lit(2), (F.col("block_bars") / 2).cast("int"))), "song_id", "left")
    return sections, checkpointed(S.structure_repeats(sections, vectors)), checkpointed(S.line_repeats(lines, sections, sequence, times)), form


def analyze(frames: DataFrame, tracked: DataFrame, overrides: DataFrame, frame_s: float = FRAME_S) -> DataFrame:
    """One document per song: key, tempo, meter, beats, bars, chords, patterns, sections, structure, lines and form.

    frames: song_id, frame (numbered from 0 without gaps), chroma, bass, onset_env, low_env, rms, mfcc. tracked: song_id, beat, frame, and
    bpm_hint where the tracker ran at several tempos. overrides: song_id, forced_meter, forced_bpm, forced_tonic, forced_mode (null
    for what the listener left open; songs may be missing). After the first decoding, a key that the chords contradict gives way
    to its relative, and only those songs are decoded again. Songs that can't be analysed (no frames, no steady beat) keep out of all
    steps and have a row with the reason and nothing else.
    """
    session = joining_apart(frames.sparkSession)
    rejected = checkpointed(X.rejected_songs(frames, tracked))
    good = lambda rows: rows.join(rejected.select("song_id"), "song_id", "left_anti")
    frames, tracked, overrides, rejected = (tabled(rows, session) for rows in (good(frames), good(tracked), good(overrides), rejected))
    song_key, timeline, candidates = find_key(frames, overrides, frame_s)
    beats, tempo, bars = find_beats(frames, tracked, overrides, frame_s)
    tempo = checkpointed(tempo)
    chords = checkpointed(find_chords(beats, tempo, timeline, song_key))
    refined = checkpointed(K.refine_key_mode(song_key, chords, frames, frame_s))
    flipped = refined.where("mode_corrected_by_chords").select("song_id")
    both = song_key.select("song_id", F.explode(F.array(F.struct("tonic", "mode"), F.struct(relative_tonic(F.col("tonic"), F.col("mode")).cast("int").alias("tonic"), other_mode(F.col("mode")).alias("mode")))).alias("k")).select("song_id", "k.*")
    evidence = checkpointed(K.key_chord_evidence(chords, both).join(K.endpoint_evidence(frames, both, frame_s), ["song_id", "tonic", "mode"]))
    timeline = checkpointed(K.relabelled_timeline(timeline, refined))
    again = find_chords(beats.join(flipped, "song_id", "left_semi"), tempo, timeline, refined)
    chords = chords.join(flipped, "song_id", "left_anti").unionByName(again)
    sequence = checkpointed(P.add_nashville(P.chord_sequence(chords), refined))
    patterns = checkpointed(P.maximal_patterns(P.repeated_patterns(sequence)))
    sections, structure, lines, form = find_parts(frames, bars, timeline, refined, sequence)
    key = refined.withColumn("key", key_name(F.col("tonic"), F.col("mode"))).withColumn("relative_key", relative_key(F.col("tonic"), F.col("mode")))
    runner_up = K.key_runner_up(candidates, refined).select("song_id", F.struct("tonic", "mode", "score").alias("key_runner_up"))
    wished = song_key.select("song_id", F.col("user_forced").alias("key_user_forced")).join(overrides.select("song_id", F.col("forced_bpm").isNotNull().alias("tempo_user_forced")), "song_id", "left").fillna(False, ["tempo_user_forced"])
    length = frames.groupBy("song_id").agg(((F.max("frame") + 1) * frame_s).alias("duration"))
    songs = key.withColumnRenamed("confidence", "key_confidence").withColumnRenamed("margin", "key_margin").join(tempo.withColumnRenamed("confidence", "meter_confidence"), "song_id", "left")
    for more in (wished, runner_up, length, form):
        songs = songs.join(more, "song_id", "left")
    songs = checkpointed(songs)
    children = {
        "key_timeline": (timeline, "seg"), "modulations": (K.modulations(timeline), "time"), "candidates": (candidates, "rank"), "key_evidence": (evidence, "tonic"), "beats": (beats.select("song_id", "beat", "frame", "time"), "beat"),
        "bars": (bars, "index"), "chords": (sequence, "pos"), "patterns": (patterns, "first_pos"), "sections": (sections, "part"), "structure": (structure, "cluster"), "lines": (lines, "line"),
    }
    return song_document(songs, children).unionByName(rejected.select("song_id", "reason"), allowMissingColumns=True)
