"""Names of notes, keys and chords as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadenza.functions import tables as T


def lookup(table: dict, key: Column) -> Column:
    """Value of a small literal table; null if the key is missing or null."""
    return F.element_at(F.create_map(*(F.lit(x) for x in chain(*table.items()))), key)


def entry(values: tuple, index: Column) -> Column:
    """Value of a small literal list by position from 0."""
    return F.get(F.array(*(F.lit(v) for v in values)), index.cast("int"))


def parse_key(text: Column) -> Column:
    """``'Ab major'`` as a struct of tonic and mode; minor if the second word starts with min; null for no known note."""
    words = F.split(F.trim(text), r"\s+")
    note = F.concat(F.upper(F.substring(words[0], 1, 1)), F.substr(words[0], F.lit(2)))
    tonic = lookup(T.NOTE_TO_PC, note)
    minor = F.coalesce(F.lower(F.get(words, F.lit(1))).startswith("min"), F.lit(False))
    return F.when(tonic.isNotNull(), F.struct(tonic.cast("int").alias("tonic"), F.when(minor, "minor").otherwise("major").alias("mode")))


def spell_pitch(pc: Column, tonic: Column, mode: Column) -> Column:
    """Name of a pitch class in a key: with flats if the key's (relative) major tonic is written with flats."""
    major = F.when(mode == "minor", F.pmod(tonic + 3, F.lit(12))).otherwise(F.pmod(tonic, F.lit(12)))
    place = F.pmod(pc, F.lit(12))
    return F.when(major.isin(*T.FLAT_TONICS), entry(T.FLAT_NAMES, place)).otherwise(entry(T.SHARP_NAMES, place))


def key_name(tonic: Column, mode: Column) -> Column:
    return F.concat(spell_pitch(tonic, tonic, mode), F.lit(" "), mode)


def relative_tonic(tonic: Column, mode: Column) -> Column:
    return F.pmod(tonic + F.when(mode == "minor", 3).otherwise(9), F.lit(12))


def other_mode(mode: Column) -> Column:
    return F.when(mode == "minor", "major").otherwise("minor")


def relative_key(tonic: Column, mode: Column) -> Column:
    """Name of the key with the same notes in the other mode."""
    return key_name(relative_tonic(tonic, mode), other_mode(mode))


def chord_root(chord: Column) -> Column:
    """Root note of a chord name; the whole name if it has none."""
    found = F.regexp_extract(chord, r"^([A-G][#b]?)(.*)$", 1)
    return F.when(found == "", chord).otherwise(found)


def chord_quality(chord: Column) -> Column:
    """Quality by suffix; major for an unknown suffix or no root."""
    suffix = F.regexp_extract(chord, r"^([A-G][#b]?)(.*)$", 2)
    return F.coalesce(lookup({v: k for k, v in T.QUALITY_SUFFIX.items()}, suffix), F.when(chord.isNotNull(), "major"))


def chord_label(root: Column, quality: Column) -> Column:
    return F.concat(root, F.coalesce(lookup(T.QUALITY_SUFFIX, quality), F.lit("")))


def nashville(root: Column, quality: Column, tonic: Column) -> Column:
    """Scale-degree number of a chord; a dominant seventh is written with a raised 7. Null for an unknown root or key."""
    degree = entry(T.NASHVILLE_DEGREES, F.pmod(lookup(T.NOTE_TO_PC, root) - tonic, F.lit(12)))
    suffix = F.when(quality == "dominant7", "⁷").otherwise(F.coalesce(lookup(T.QUALITY_SUFFIX, quality), F.lit("")))
    return F.concat(degree, suffix)


def chord_to_nashville(chord: Column, key: Column) -> Column:
    return nashville(chord_root(chord), chord_quality(chord), parse_key(key)["tonic"])


def harmonic_role(chord: Column, key: Column) -> Column:
    """Role of a chord or roman numeral in a key."""
    plain = F.translate(chord, "♭♯", "b#")
    first = F.split(F.coalesce(key, F.lit("")), " ")[0]
    return F.when(F.coalesce(chord, F.lit("")) == "", "unknown").when(plain == first, "tonic").otherwise(F.coalesce(lookup(T.ROLES, plain), F.lit("chromatic")))


def format_clock(seconds: Column) -> Column:
    """``m:ss.ss``; a dash for null and non-finite numbers."""
    minutes = F.floor(seconds / 60)
    finite = seconds.isNotNull() & ~F.isnan(seconds) & (F.abs(seconds) < float("inf"))
    return F.when(finite, F.format_string("%d:%05.2f", minutes, seconds - minutes * 60)).otherwise("—")
