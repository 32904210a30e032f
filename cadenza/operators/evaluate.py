"""Found chords and songs against known ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Seconds of a cell by which overlapping chords find each other.
CELL_S = 16.0


def chord_accuracy(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of the overlap of found and true chords in which root and minor or not agree; 0 without any overlap.

    Chords meet in the cells of CELL_S seconds that they touch, and an overlap counts in the cell in which it begins.
    """
    is_minor = lambda c: F.col(c).startswith("min")
    a = found.select("song_id", "start", "end", F.col("root_pc").alias("root"), is_minor("quality").alias("minor"))
    b = truth.select("song_id", "t0", "t1", F.col("root").alias("true_root"), is_minor("quality").alias("true_minor"))
    cell = lambda at: F.floor(at / CELL_S)
    cells = lambda rows, low, high: rows.where(F.col(low) < F.col(high)).withColumn("cell", F.explode(F.sequence(cell(F.col(low)), cell(F.col(high)))))
    rows = cells(b, "t0", "t1").join(cells(a, "start", "end"), ["song_id", "cell"])
    rows = rows.where((F.col("start") < F.col("t1")) & (F.col("t0") < F.col("end")) & (F.col("cell") == cell(F.greatest("start", "t0"))))
    both = F.least("end", "t1") - F.greatest("start", "t0")
    agree = (F.col("root") == F.col("true_root")) & (F.col("minor") == F.col("true_minor"))
    sums = rows.groupBy("song_id").agg(F.sum(F.when(agree, both).otherwise(0.0)).alias("right"), F.sum(both).alias("all"))
    return truth.select("song_id").distinct().join(sums, "song_id", "left").select("song_id", F.coalesce(F.col("right") / F.when(F.col("all") > 0, F.col("all")), F.lit(0.0)).alias("accuracy"))


def regression_report(found: DataFrame, truth: DataFrame, accuracy: DataFrame) -> DataFrame:
    """Per song: key, tempo (within 4 percent) and meter right or wrong, with what was found and what is true of each, chord accuracy, and
    the form and the sections (an array, or their number n_sections) where either side has them; songs that were not found have
    false and no values."""
    values = ("tonic", "bpm", "meter")
    more = ("form", "sections", "n_sections")
    side = lambda rows, name: rows.select("song_id", *(F.col(c).alias(f"{name}_{c}") for c in (*values, *more) if c in rows.columns))
    rows = side(truth, "true").join(side(found, "found"), "song_id", "left").join(accuracy, "song_id", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    told = [c for c in rows.columns if c not in ("song_id", "accuracy")]
    return rows.select(
        "song_id",
        yes(F.col("found_tonic") == F.col("true_tonic")).alias("key_ok"),
        yes(F.abs(F.try_divide("found_bpm", "true_bpm") - 1) < 0.04).alias("tempo_ok"),
        yes(F.col("found_meter") == F.col("true_meter")).alias("meter_ok"),
        F.coalesce("accuracy", F.lit(0.0)).alias("chord_accuracy"),
        *sorted(told),
    )
