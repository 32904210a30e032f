"""Fixed values of music theory that results depend on."""

from __future__ import annotations

SHARP_NAMES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
FLAT_NAMES = ("C", "Db", "D", "Eb", "E", "F", "Gb", "G", "Ab", "A", "Bb", "B")
#: Pitch classes of the major keys written with flats.
FLAT_TONICS = (1, 3, 5, 8, 10)
NOTE_TO_PC = {
    "C": 0, "C#": 1, "Db": 1, "D": 2, "D#": 3, "Eb": 3, "E": 4, "F": 5, "F#": 6, "Gb": 6, "G": 7, "G#": 8, "Ab": 8, "A": 9, "A#": 10, "Bb": 10, "B": 11,
}
QUALITY_SUFFIX = {"major": "", "minor": "m", "dominant7": "7", "major7": "maj7", "minor7": "m7", "diminished": "dim"}
NASHVILLE_DEGREES = ("1", "b2", "2", "b3", "3", "4", "#4", "5", "b6", "6", "b7", "7")
ROLES = {"I": "tonic", "ii": "predominant", "iii": "tonic substitute", "IV": "predominant", "V": "dominant", "vi": "tonic substitute", "vii°": "dominant substitute"}
#: Key profiles (Temperley 2005), semitones above the tonic.
MAJOR_PROFILE = (5.0, 2.0, 3.5, 2.0, 4.5, 4.0, 2.0, 4.5, 2.0, 3.5, 1.5, 4.0)
MINOR_PROFILE = (5.0, 2.0, 3.5, 4.5, 2.0, 4.0, 2.0, 4.5, 3.5, 2.0, 1.5, 4.0)
#: Chord families that belong to a scale degree, for choosing between a key and its relative.
MAJOR_FAMILY = {0: ("major",), 2: ("minor",), 4: ("minor",), 5: ("major",), 7: ("major",), 9: ("minor",), 10: ("major",)}
MINOR_FAMILY = {0: ("minor",), 3: ("major",), 5: ("minor",), 7: ("major", "minor"), 8: ("major",), 10: ("major",)}
#: Chord states of the decoder: qualities, their tones with weights, their bias.
STATE_QUALITIES = ("major", "minor", "dominant7", "major7", "minor7")
QUALITY_TONES = {
    "major": {0: 1.0, 4: 0.85, 7: 0.75},
    "minor": {0: 1.0, 3: 0.85, 7: 0.75},
    "dominant7": {0: 1.0, 4: 0.85, 7: 0.75, 10: 0.60},
    "major7": {0: 1.0, 4: 0.85, 7: 0.75, 11: 0.60},
    "minor7": {0: 1.0, 3: 0.85, 7: 0.75, 10: 0.60},
}
QUALITY_BIAS = {"major": 0.0, "minor": 0.0, "dominant7": -0.035, "major7": -0.045, "minor7": -0.035}
BASS_WEIGHT, TEMPERATURE = 0.08, 0.04
MAJOR_DIATONIC = {0: ("major", "major7", "dominant7"), 2: ("minor", "minor7"), 4: ("minor", "minor7"), 5: ("major", "major7"), 7: ("major", "dominant7"), 9: ("minor", "minor7")}
MAJOR_BORROWED = {10: ("major", "dominant7")}
MINOR_DIATONIC = {0: ("minor", "minor7"), 3: ("major", "major7"), 5: ("minor", "minor7"), 7: ("minor", "minor7", "major", "dominant7"), 8: ("major", "major7"), 10: ("major", "dominant7")}
#: Beats in a bar by time signature, in the order that ties are broken.
METER_BEATS = {"4/4": 4, "3/4": 3, "2/4": 2, "12/8": 4, "9/8": 3, "6/8": 2}
AUDIO_SUFFIXES = ("mp3", "wav", "flac", "m4a", "ogg", "aac")
HOP, SAMPLE_RATE = 512, 22050
