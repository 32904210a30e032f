"""What comes in: song files, decoded clips and the listener's wishes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions.names import parse_key
from cadenza.functions.tables import AUDIO_SUFFIXES, METER_BEATS, SAMPLE_RATE


def audio_manifest(files: DataFrame, path: str = "path") -> DataFrame:
    """path, ext, accepted and reason of every file name, by its suffix in lower case."""
    rows = files.select(F.col(path).alias("path"))
    rows = rows.withColumn("ext", F.lower(F.regexp_extract(F.coalesce("path", F.lit("")), r"\.([^./]+)$", 1)))
    known = F.col("ext").isin(*AUDIO_SUFFIXES)
    empty = F.coalesce("path", F.lit("")) == ""
    reason = F.when(empty, "No audio file was provided.").when(~known, F.concat(F.lit("Unsupported audio format: "), F.when(F.col("ext") == "", "unknown").otherwise(F.concat(F.lit("."), "ext"))))
    return rows.select("path", "ext", (~empty & known).alias("accepted"), reason.alias("reason"))


def clip_quality_gate(clips: DataFrame, least_seconds: float = 5.0, least_peak: float = 1e-6) -> DataFrame:
    """Clips with seconds, is_usable and reason: broken if empty, too short or silent."""
    seconds = F.col("n_samples") / F.coalesce(F.col("sr"), F.lit(SAMPLE_RATE))
    reason = F.when(F.coalesce("n_samples", F.lit(0)) == 0, "empty").when(seconds < least_seconds, "too short").when(F.coalesce("peak", F.lit(0.0)) < least_peak, "silent")
    return clips.withColumn("seconds", seconds).withColumn("reason", reason).withColumn("is_usable", reason.isNull())


def apply_overrides(songs: DataFrame, overrides: DataFrame) -> DataFrame:
    """Songs with forced_meter (a known one), forced_bpm (30 to 240) and the forced key's tonic and mode; null means automatic."""
    key = parse_key(F.col("key"))
    wishes = overrides.select(
        "song_id",
        F.when(F.col("meter").isin(*METER_BEATS), F.col("meter")).alias("forced_meter"),
        F.when(F.col("bpm").between(30, 240), F.col("bpm")).alias("forced_bpm"),
        key["tonic"].alias("forced_tonic"),
        key["mode"].alias("forced_mode"),
    )
    return songs.join(wishes, "song_id", "left")
