"""Song tables read from an event log or from vectors: one user is one song, one event one chord, note or beat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.functions.names import entry
from cadenza.functions.tables import SHARP_NAMES

#: Chord of each event type where few different chords are wanted.
NARROW = {"click": (0, "major"), "error": (7, "major"), "purchase": (9, "minor"), "signup": (5, "major"), "view": (2, "dominant7")}
#: Quality of each event type where the root comes from the event's number.
WIDE = {"click": "major", "error": "minor", "purchase": "dominant7", "signup": "major7", "view": "minor7"}
#: Vector ids that make up one song of each label, about 64 bars.
SONG_IDS = 640
#: Which eight-vector stretch a bar takes, so that parts come back as in a song.
FORM = (0, 1, 0, 1, 2, 1, 3, 3)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def song_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """song_id, pos, t (hours since the first day, taken as seconds), event_type, value and k, in time order per song."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("song_id"),
        (F.row_number().over(order) - 1).alias("pos"),
        (F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)") / 3.6e9).alias("t"),
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def _case(table: dict, pick: int | None = None) -> Column:
    out = None
    for name, value in table.items():
        value = value if pick is None else value[pick]
        out = F.when(F.col("event_type") == name, value) if out is None else out.when(F.col("event_type") == name, value)
    return out


def chords(spark: SparkSession, sf_dir: str, wide: bool = False) -> DataFrame:
    """Chord segments: song_id, pos, root_pc, quality, root, start, end, duration, confidence, bar, key_tonic, key_mode.

    Narrow: one of five chords. Wide: any of sixty. Every fourth chord starts a bar; the local key changes at position 40.
    """
    following = F.lead("t").over(Window.partitionBy("song_id").orderBy("pos"))
    rows = song_events(spark, sf_dir).withColumn("end", F.coalesce(following, F.col("t") + 1.0))
    root, quality = (F.pmod("k", F.lit(12)), _case(WIDE)) if wide else (_case(NARROW, 0), _case(NARROW, 1))
    return rows.select(
        "song_id", "pos", root.cast("int").alias("root_pc"), quality.alias("quality"), F.col("t").alias("start"), "end", (F.col("end") - F.col("t")).alias("duration"),
        ((F.col("k") + 1) / 97.0).alias("confidence"), F.floor(F.col("pos") / 4).cast("int").alias("bar"),
        F.when(F.col("pos") < 40, 0).otherwise(7).alias("key_tonic"), F.lit("major").alias("key_mode"),
    ).withColumn("root", entry(SHARP_NAMES, F.col("root_pc")))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature frames: song_id, frame, chroma and bass (12 each), onset_env, low_env, rms, mfcc (13). A note sounds with a fifth and a third."""
    note = F.pmod("k", F.lit(12))
    tone = lambda pc, gain: F.when(F.lit(pc) == note, F.col("value")).when(F.pmod(note + 7, F.lit(12)) == pc, F.col("value") * 0.51).when(F.pmod(note + 4, F.lit(12)) == pc, F.col("value") * gain).otherwise(0.0)
    return song_events(spark, sf_dir).select(
        "song_id", F.col("pos").alias("frame"), F.array(*(tone(p, 0.23) for p in range(12))).alias("chroma"),
        F.array(*(F.when(note == p, F.col("value")).otherwise(0.0) for p in range(12))).alias("bass"),
        F.col("value").alias("onset_env"), (F.col("value") * F.col("k") / 100.0).alias("low_env"), F.col("value").alias("rms"),
        F.array(*(F.pmod(F.col("k") * (i + 1), F.lit(13)) * F.col("value") for i in range(13))).alias("mfcc"),
    )


def beat_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beats: song_id, beat, frame, time, low, full and nov. Frames are 20 apart, a little uneven."""
    return song_events(spark, sf_dir).select("song_id", F.col("pos").alias("beat"), (F.col("pos") * 20 + F.pmod("k", F.lit(5))).alias("frame"), F.col("t").alias("time"), F.col("value").alias("low"), (F.col("value") + F.col("k")).alias("full"), (F.col("k") / 100.0).alias("nov"))


def bar_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars: song_id, bar and v (64 numbers), with parts that come back after the fixed form. A song is one label's vectors among
    SONG_IDS neighbouring ids, so that songs have about as many bars whatever the table, and there are more of them if it grows."""
    vectors = table(spark, sf_dir, "embeddings")
    labels = vectors.agg((F.coalesce(F.max("label"), F.lit(0)) + 1).alias("labels"))  # one number
    song = (F.col("label") + F.expr(f"vec_id div {SONG_IDS}") * F.col("labels")).cast("int")
    rows = vectors.crossJoin(F.broadcast(labels)).select(song.alias("song_id"), "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("own"))
    rows = rows.select("song_id", (F.row_number().over(Window.partitionBy("song_id").orderBy("vec_id")) - 1).alias("bar"), "own")
    source = entry(FORM, F.pmod(F.floor(F.col("bar") / 8), F.lit(8))) * 8 + F.col("bar") % 8
    rows = rows.withColumn("from", source)
    other = rows.select("song_id", F.col("bar").alias("from"), F.col("own").alias("form"))
    mixed = F.zip_with(F.coalesce("form", "own"), "own", lambda a, b: a + b * 0.05)
    return rows.join(other, ["song_id", "from"], "left").select("song_id", "bar", mixed.alias("v"))
