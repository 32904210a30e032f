"""Operators on hand-made songs with known answers."""

import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cadenza.functions import names as N
from cadenza.functions import tables as T
from cadenza.operators import beats as B
from cadenza.operators import chords as C
from cadenza.operators import evaluate as E
from cadenza.operators import key as K
from cadenza.operators import progression as P
from cadenza.operators import rescue as X
from cadenza.operators import structure as S
from cadenza.sources import requests as R


def column(spark, expression, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize("text, want", [("Ab major", (8, "major")), ("F# minor", (6, "minor")), ("bb", (10, "major")), ("", None), ("H major", None), (None, None), ("c Min", (0, "minor"))])
def test_parse_key(spark, text, want):
    got = column(spark, N.parse_key(F.lit(text).cast("string")))
    assert (got and (got["tonic"], got["mode"])) == want


@pytest.mark.parametrize("chord, key, want", [("Fm7", "Ab major", "6m7"), ("G7", "C major", "5⁷"), ("G#", "Ab major", "1"), ("X", "C", None), ("C", "H", None), ("Asus4", "A", "1")])
def test_nashville(spark, chord, key, want):
    assert column(spark, N.chord_to_nashville(F.lit(chord), F.lit(key))) == want


def test_names(spark):
    assert column(spark, N.spell_pitch(F.lit(8), F.lit(8), F.lit("major"))) == "Ab"
    assert column(spark, N.spell_pitch(F.lit(8), F.lit(4), F.lit("major"))) == "G#"
    assert column(spark, N.relative_key(F.lit(8), F.lit("major"))) == "F minor"
    assert column(spark, N.format_clock(F.lit(65.5))) == "1:05.50"
    assert column(spark, N.format_clock(F.lit(float("nan")))) == "—"
    assert column(spark, N.harmonic_role(F.lit("A♭"), F.lit("Ab major"))) == "tonic"


def test_requests(spark):
    files = spark.createDataFrame([("a/b.MP3",), ("x.txt",), ("noext",), ("",), (None,)], "path string")
    got = [(r["accepted"], r["reason"]) for r in R.audio_manifest(files).collect()]
    assert [a for a, _ in got] == [True, False, False, False, False]
    assert got[1][1] == "Unsupported audio format: .txt" and got[4][1] == "No audio file was provided."
    clips = spark.createDataFrame([(1, 22050, 22050 * 6, 0.5), (2, 22050, 100, 0.5), (3, 22050, 22050 * 6, 0.0), (4, 22050, None, None)], "song_id int, sr int, n_samples long, peak double")
    assert [r["reason"] for r in R.clip_quality_gate(clips).orderBy("song_id").collect()] == [None, "too short", "silent", "empty"]


def song(spark, chords, length=1.0, lengths=None):
    rows, t = [], 0.0
    for k, c in enumerate(chords):
        d = lengths[k] if lengths else length
        rows.append((1, k, c, t, t + d, d))
        t += d
    frame = spark.createDataFrame(rows, "song_id int, pos int, chord string, start double, end double, duration double")
    return frame.withColumn("root", N.chord_root(F.col("chord"))).withColumn("quality", N.chord_quality(F.col("chord"))).withColumn("nashville", N.nashville(F.col("root"), F.col("quality"), F.lit(0)))


def test_patterns(spark):
    rng = random.Random(1)
    for _ in range(4):
        chords = [rng.choice("CFG") for _ in range(40)]
        found = {tuple(r["pattern"]): r["occurrences"] for r in P.repeated_patterns(song(spark, chords)).collect()}
        want = {}
        for n in range(4, 9):
            for i in range(len(chords) - n + 1):
                g = tuple(chords[i : i + n])
                want[g] = want.get(g, 0) + 1
        want = {g: n for g, n in want.items() if n > 1}
        assert found == want
        inside = lambda p, q: len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        kept = {tuple(r["pattern"]) for r in P.maximal_patterns(P.repeated_patterns(song(spark, chords))).collect()}
        assert kept == {p for p in want if not any(inside(p, q) for q in want)}


def steady(chords, lengths, shortest=0.65):
    """The rule one step after the other."""
    chords = list(chords)
    if len(chords) < 3:
        return chords
    for k in range(1, len(chords) - 1):
        if 0 < lengths[k] < shortest and chords[k - 1] == chords[k + 1] != chords[k]:
            chords[k] = chords[k - 1]
    return [c for k, c in enumerate(chords) if not k or c != chords[k - 1]]


def test_stabilize(spark):
    rng = random.Random(2)
    for _ in range(8):
        n = rng.randint(1, 30)
        chords, lengths = [rng.choice(["C", "F", "Gdim"]) for _ in range(n)], [rng.choice([0.3, 1.0]) for _ in range(n)]
        got = [r["chord"] for r in P.stabilize_chords(song(spark, chords, lengths=lengths)).orderBy("pos").collect()]
        assert got == steady(chords, lengths)


def vamps(x):
    out, k = [], 0
    while k < len(x) - 3:
        n = 2
        while k + n < len(x) and x[k] != x[k + 1] and x[k + n] == x[k + n - 2]:
            n += 1
        if n >= 4 and x[k] != x[k + 1]:
            out.append((k, n))
            k += n
        else:
            k += 1
    return out


def test_vamps(spark):
    rng = random.Random(3)
    for chords in ["ABABCBCB", "AABAB", "ABA", *("".join(rng.choice("ABC") for _ in range(30)) for _ in range(6))]:
        got = sorted((r["first_pos"], r["length"]) for r in P.alternating_vamps(song(spark, chords)).collect())
        assert got == vamps(chords)


def test_rotations(spark):
    chords = ["C", "G", "Am", "F"] * 3 + ["D"] + ["G", "Am", "F", "C"] * 2
    found = P.rotation_merged_regions(P.repeated_regions(song(spark, chords))).collect()
    assert any(r["variants"] == 4 and r["signature"] == ["1", "5", "6m", "4"] for r in found)


def test_key_follows_rotation(spark):
    rng = np.random.default_rng(4)
    base = rng.random(12)
    rows = [(r, k, np.roll(base, r).tolist()) for r in range(12) for k in range(5)]
    frames = spark.createDataFrame(rows, "song_id int, frame int, chroma array<double>")
    best = {r["song_id"]: (r["tonic"], r["mode"]) for r in K.key_candidates(K.global_chroma(frames)).where("rank = 1").collect()}
    assert all(best[r] == ((best[0][0] + r) % 12, best[0][1]) for r in range(12))


def test_paths_against_all_sequences(spark):
    rng = np.random.default_rng(5)
    scores = rng.random((4, 12))
    cost = K.switch_costs()
    frame = spark.createDataFrame([(1, k, s.tolist(), [float(k)]) for k, s in enumerate(scores)], "song_id int, win int, scores array<double>, chroma array<double>")
    got = [r["region"] for r in K.key_path(frame).orderBy("win").collect()]
    total = lambda p: sum(scores[k, s] for k, s in enumerate(p)) - sum(cost[a, b] for a, b in zip(p, p[1:]))
    every = np.stack(np.meshgrid(*[range(12)] * 4, indexing="ij"), axis=-1).reshape(-1, 4)
    assert abs(total(got) - max(total(p) for p in every.tolist())) < 1e-9


def test_key_lookup(spark):
    timeline = spark.createDataFrame([(1, 0, 0.0, 3.0, 0, "major"), (1, 1, 2.995, 6.0, 7, "major")], "song_id int, seg int, start double, end double, tonic int, mode string")
    key = spark.createDataFrame([(1, 2, "minor"), (2, 5, "major")], "song_id int, tonic int, mode string")
    points = spark.createDataFrame([(1, 2.997), (1, 5.0), (1, 9.0), (2, 1.0)], "song_id int, time double")
    got = [(r["time"], r["key_tonic"]) for r in K.key_at(points, timeline, key).orderBy("song_id", "time").collect()]
    assert got == [(2.997, 0), (5.0, 7), (9.0, 7), (1.0, 5)]


def golden():
    """A known song: form, chords per bar, 4/4 at 100 in A flat."""
    parts = [("Intro", 4, 1, [(0, "major"), (7, "major")]), ("Verse", 8, 2, [(0, "major"), (9, "minor"), (5, "major"), (7, "major")]), ("Chorus", 8, 2, [(5, "major"), (7, "major"), (0, "major"), (9, "minor")])]
    parts += [parts[1], parts[2], ("Bridge", 8, 2, [(9, "minor"), (5, "major"), (2, "minor"), (7, "major7")]), parts[2], ("Outro", 2, 1, [(0, "major")])]
    bars = []
    for _, n, each, chords in parts:
        bars += [chords[k // each % len(chords)] for k in range(n)]
    return [((8 + o) % 12, q) for o, q in bars]


def test_golden_song(spark):
    bars, bar_s, states = golden(), 2.4, C.templates()
    rows = []
    for k, (root, quality) in enumerate(bars):
        chroma = states[C.STATES.index((root, quality))]
        bass = np.eye(12)[root]
        rows += [(1, 4 * k + b, (4 * k + b) * bar_s / 4, (chroma + 0.01).tolist(), bass.tolist()) for b in range(4)]
    beats = spark.createDataFrame(rows, "song_id int, beat int, time double, chroma array<double>, bass array<double>")
    frames = beats.withColumnRenamed("beat", "frame")
    candidates = K.key_candidates(K.global_chroma(frames))
    best = candidates.where("rank = 1").first()
    assert (best["tonic"], best["mode"]) in ((8, "major"), (5, "minor"))
    key = spark.createDataFrame([(1, 8, "major")], "song_id int, tonic int, mode string")
    timeline = spark.createDataFrame([(1, 0, 0.0, 1000.0, 8, "major")], "song_id int, seg int, start double, end double, tonic int, mode string")
    tempo = spark.createDataFrame([(1, 0, 4)], "song_id int, phase int, bpb int")
    heard = C.change_probability(C.chord_emission(C.key_prior(C.chord_template_scores(beats), timeline, key)), tempo)
    segments = C.chord_segments(C.chord_path(heard), heard, tempo)
    truth = spark.createDataFrame([(1, k * bar_s, (k + 1) * bar_s, r, q) for k, (r, q) in enumerate(bars)], "song_id int, t0 double, t1 double, root int, quality string")
    assert E.chord_accuracy(segments, truth).first()["accuracy"] > 0.99
    spelled = C.spell_chords(segments, timeline, key)
    sequence = P.add_nashville(P.chord_sequence(spelled))
    assert [r["nashville"] for r in sequence.orderBy("pos").collect()][4:12] == ["1", "6m", "4", "5", "4", "5", "1", "6m"]
    assert any(r["pattern"] == ["Ab", "Fm", "Db", "Eb"] and r["occurrences"] == 2 for r in P.repeated_patterns(sequence, 4, 4).collect())
    # structure: the chords of each bar as features, choruses louder
    loud = [1.0] * 4 + [1.0] * 8 + [2.0] * 8 + [1.0] * 8 + [2.0] * 8 + [1.0] * 8 + [2.0] * 8 + [1.0] * 2
    features = [(1, k, np.roll(states[C.STATES.index(b)], -8).tolist(), np.roll(np.eye(12)[b[0]], -8).tolist(), [0.0] * 12, loud[k], k * bar_s, (k + 1) * bar_s) for k, b in enumerate(bars)]
    table = spark.createDataFrame(features, "song_id int, bar int, chroma array<double>, bass array<double>, timbre array<double>, rms double, start double, end double")
    vectors = S.bar_vectors(table)
    blocks = S.block_clusters(vectors)
    parts = S.settle_parts(S.merge_parts(blocks), vectors, blocks)
    named = S.name_vamps(S.name_parts(parts, vectors), S.line_clusters(vectors))
    order = [r["name"] for r in named.orderBy("part").collect()]
    assert order.count("Chorus") >= 1 and S.form_string(S.sections(named, sequence, table)).count() == 1


def test_linkage_against_definition():
    rng = np.random.default_rng(6)
    v = rng.normal(size=(12, 3))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    groups = [[k] for k in range(12)]
    mean = lambda a, b: np.mean([[np.clip(1 - v[i] @ v[j], 0, 2) for j in b] for i in a])
    while len(groups) > 1:
        d, a, b = min((mean(x, y), i, j) for i, x in enumerate(groups) for j, y in enumerate(groups) if i < j)
        if d > 0.5:
            break
        groups[a] += groups.pop(b)
    want = [next(c for c, g in enumerate(sorted(groups, key=min)) if k in g) for k in range(12)]
    assert S.average_linkage(v, 0.5) == want
    assert S.average_linkage(v[:1]) == [0]


def plain_linkage(v, cut):
    """Average linkage by looking at all pairs of groups every time; the lowest pair on ties."""
    apart, groups = np.clip(1 - v @ v.T, 0, 2), [[k] for k in range(len(v))]
    while len(groups) > 1:
        d, a, b = min((round(float(apart[np.ix_(x, y)].mean()), 12), i, j) for i, x in enumerate(groups) for j, y in enumerate(groups) if i < j)
        if d > cut:
            break
        groups[a] += groups.pop(b)
    names = {}
    return [names.setdefault(next(c for c, g in enumerate(groups) if k in g), len(names)) for k in range(len(v))]


def test_linkage_of_many_blocks():
    rng = np.random.default_rng(9)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    for n in (2, 3, 9, 25):
        for cut in (0.1, 0.4, 0.9):
            v = unit(rng.normal(size=(n, 3)))
            assert S.average_linkage(v, cut) == plain_linkage(v, cut)
            copies = v[rng.integers(0, max(1, n // 3), n)]  # equal blocks: ties at distance 0
            assert S.average_linkage(copies, 0.001) == [[tuple(x) for x in dict.fromkeys(map(tuple, copies))].index(tuple(r)) for r in copies]
    start = time.time()
    found = S.average_linkage(unit(rng.normal(size=(40, 24))[rng.integers(0, 40, 2000)] + rng.normal(size=(2000, 24)) * 0.05))
    assert len(set(found)) == 40 and time.time() - start < 5


def test_fragments_by_sets_and_by_song(spark):
    rng = np.random.default_rng(3)
    rows = []
    for song, offset, n in (("a", 7, 60), ("b", 3, 45), ("c", 0, 39), ("d", 6, 46), ("e", 0, 5)):
        base = rng.normal(size=(3, 8, 5))
        for bar in range(n):
            block, k = divmod(bar - offset + 8, 8)
            v = base[block % 3][k] + rng.normal(size=5) * 0.05
            rows.append((song, bar, v.tolist(), [*v.tolist(), float(rng.normal() * 0.05)]))
    bars = spark.createDataFrame(rows, "song_id string, bar int, v array<double>, w array<double>")
    got = {tuple(r) for r in S.attach_fragments(S.full_blocks(bars), bars).collect()}
    want = {tuple(r) for r in S.block_clusters(bars).collect()}
    assert got == want and {r[0] for r in got} == set("abcd") and any(r[2] - r[1] < r[4] for r in got)


def test_values_do_not_depend_on_ranges(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(song, k, rng.random(12).round(3).tolist(), float(rng.integers(0, 9)), float(rng.random())) for song, n in (("a", 400), ("b", 137), ("c", 3)) for k in range(n)]
    frames = spark.createDataFrame(rows, "song_id string, frame int, chroma array<double>, low_env double, onset_env double")
    beats = frames.where("frame % 9 = 4").selectExpr("song_id", "cast(frame / 9 as int) as beat", "frame")

    def values():
        novel = B.harmonic_novelty(frames, 7)
        out = [B.beat_accents(frames, beats), B.triplet_feel(frames, beats), novel, B.onset_peaks(frames), X.bar_period(frames.join(novel, ["song_id", "frame"]), 0.1)]
        flat = lambda x: [flat(y) for y in x] if isinstance(x, (list, tuple)) else round(x, 9) + 0.0 if isinstance(x, float) else x
        return [sorted((flat(tuple(r)) for r in df.collect()), key=str) for df in out]

    want = values()
    monkeypatch.setattr(B, "RANGE", 50)
    assert values() == want


def as_parts(rows):
    return pd.DataFrame(rows, columns=["cluster", "a", "b", "blocks"])


def test_inseparable_parts():
    merged = S.merged_pairs(as_parts([(0, 0, 8, 1), (1, 8, 16, 1), (2, 16, 24, 1), (0, 24, 32, 1), (1, 32, 40, 1)]))
    assert merged.to_numpy().tolist() == [[0, 0, 16, 2], [2, 16, 24, 1], [0, 24, 40, 2]]
    assert S.merged_pairs(as_parts([(0, 0, 8, 1), (1, 8, 16, 1)])).to_numpy().tolist() == [[0, 0, 8, 1], [1, 8, 16, 1]]
    chain = as_parts([(c, k, k + 1, 1) for k, c in enumerate([0, 1, 2, 3, 0, 1, 2, 4])])  # three in a row that never come apart
    assert S.merged_pairs(chain).to_numpy().tolist() == [[0, 0, 3, 3], [3, 3, 4, 1], [0, 4, 7, 3], [4, 7, 8, 1]]


def test_long_parts_are_cut(spark):
    rng = np.random.default_rng(7)
    kinds = rng.normal(size=(4, 8, 36))
    kinds[:, :, :24] = kinds[0, :, :24]  # the same harmony; timbre tells them apart
    kinds[:, :, 24:] *= 0.6
    order = [0, 1, 2, 1, 2, 0, 3]  # blocks of eight bars inside the long part
    bars = [(s, k, v) for s in (1, 2) for k, v in enumerate([rng.normal(size=36).tolist() for _ in range(16)] + [row.tolist() for c in order for row in kinds[c]] + [[0.1] * 36] * 3)]
    bars = spark.createDataFrame(bars, "song_id int, bar int, v array<double>")
    parts = spark.createDataFrame([(s, 0, 0, 0, 8, 1) for s in (1, 2)] + [(s, 1, 1, 8, 16, 1) for s in (1, 2)] + [(s, 2, 2, 16, 75, 8) for s in (1, 2)], "song_id int, part int, cluster int, a int, b int, blocks int")
    blocks = spark.createDataFrame([(1, 8), (2, 8)], "song_id int, length int")
    got = S.settle_parts(parts, bars, blocks).orderBy("song_id", "part").collect()
    want = [(0, 0, 0, 8, 1), (1, 1, 8, 16, 1), (2, 2, 16, 24, 1), (3, 3, 24, 40, 2), (4, 3, 40, 56, 2), (5, 2, 56, 64, 1), (6, 4, 64, 75, 2)]
    for song_id in (1, 2):
        assert [tuple(r)[1:] for r in got if r["song_id"] == song_id] == want
    assert S.settle_parts(parts, bars, blocks, split=False).where("part = 2").first()["b"] == 75
    assert S.settle_parts(parts.limit(0), bars, blocks).count() == 0


def test_songs_walk_in_order(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        rows = [(s, k) for s in (None, 1, 2, 3, 4) for k in range((s or 5) * 2)]
        frame = spark.createDataFrame(rows[::-1], "song_id long, pos int")
        walked = P.song_by_song(frame, "pos", lambda pdf: pdf.iloc[:1].assign(n=len(pdf), last=pdf["pos"].iloc[-1]), "song_id double, pos int, n int, last int").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((-1 if r["song_id"] is None or r["song_id"] != r["song_id"] else r["song_id"], r["pos"], r["n"], r["last"]) for r in walked) == [(-1, 0, 10, 9), (1, 0, 2, 1), (2, 0, 4, 3), (3, 0, 6, 5), (4, 0, 8, 7)]


def test_values_by_hand(spark):
    envelope = lambda n, at: spark.createDataFrame([(1, k, float(k == at)) for k in range(n)], "song_id int, frame int, onset_env double")
    two = spark.createDataFrame([(1, 0, 10), (1, 1, 17)], "song_id int, beat int, frame int")
    # places 12 (a third, cut down from 12.33), 14 (two thirds) and 13 (a half), each with its neighbours
    assert B.triplet_feel(envelope(30, 12), two).first()["triplet"] == 0.5 / (0.5 + 1)
    assert B.triplet_feel(envelope(30, 11), two).first()["triplet"] == 1.0
    assert B.triplet_feel(envelope(30, 15), two).first()["triplet"] == 1.0
    near = spark.createDataFrame([(1, 0, 10), (1, 1, 14)], "song_id int, beat int, frame int")
    assert B.triplet_feel(envelope(30, 12), near).first()["triplet"] == 0.0  # no beat is long enough
    # novelty: none in the first and the last six of twelve frames
    chroma = [np.eye(12)[0 if k < 6 else 5].tolist() for k in range(13)]
    flat = lambda n: {r["frame"]: r["novelty"] for r in B.harmonic_novelty(spark.createDataFrame([(1, k, chroma[k]) for k in range(n)], "song_id int, frame int, chroma array<double>"), 6).collect()}
    assert set(flat(12).values()) == {0.0} and {k: v for k, v in flat(13).items() if v} == {6: 1.0}
    # twelve beats: the grid at phase 0.5 has seven points before the last beat, one too few; at phase 0 it has eight
    beats = lambda n: spark.createDataFrame([(1, k, 20 * k) for k in range(n)], "song_id int, beat int, frame int")
    onsets = lambda phase, n: spark.createDataFrame([(1, int(20 * phase + 30 * k)) for k in range(n)], "song_id int, frame int")
    assert not X.refine_pulse(beats(12), onsets(0.5, 7)).first()["regridded"]
    wide = X.refine_pulse(beats(13), onsets(0.5, 8)).orderBy("beat").collect()
    assert wide[0]["regridded"] and [r["frame"] for r in wide] == [10 + 30 * k for k in range(8)]
    # bar period: peaks six frames apart are both kept where the least gap is 6.46 frames
    rng = np.random.default_rng(1)
    accents = np.tile([5.0, 0, 0, 0, 0, 0], 40) + rng.random(240) * 0.01
    periods = X.bar_period(spark.createDataFrame([(1, k, float(x), float(x), float(x)) for k, x in enumerate(accents)], "song_id int, frame int, low_env double, onset_env double, novelty double"), 0.15 / 6.46)
    assert periods.first()["bar_s"] is None or abs(periods.first()["bar_s"] / (0.15 / 6.46) % 6) < 1e-6
    # fold: whole-frame midpoints, tempo measured again
    slow = spark.createDataFrame([(1, k, 31 * k + k % 2, 1.0, 1.0) for k in range(9)], "song_id int, beat int, frame int, low double, full double")
    folded = B.tempo_fold(slow, 0.05).orderBy("beat").collect()
    assert [r["frame"] for r in folded][:5] == [0, 16, 32, 47, 62] and folded[0]["fold"] == 2.0 and abs(folded[0]["tempo"] - 60 / (15.5 * 0.05)) < 5
    kept = B.tempo_fold(slow.selectExpr("*", "true as keep"), 0.05).collect()
    assert len(kept) == 9 and kept[0]["fold"] == 1.0
    # key stretches: windows begin at whole frames, 129 of them apart
    path = spark.createDataFrame([(1, k, 0 if k < 5 else 4, np.eye(12)[0].tolist()) for k in range(9)], "song_id int, win int, region int, chroma array<double>")
    durations = spark.createDataFrame([(1, 40.0)], "song_id int, duration double")
    stretches = K.key_timeline(path, durations, 129).orderBy("seg").collect()
    frame_s = T.HOP / T.SAMPLE_RATE
    assert abs(stretches[0]["end"] - (4 * 129 * frame_s + 7.5)) < 1e-9 and abs(stretches[1]["start"] - (5 * 129 * frame_s + 4.5)) < 1e-9
    # vamps go by their cluster's letter, and by number where a chord has one
    parts = spark.createDataFrame([(1, 0, 0, 0, 16, "x"), (1, 1, 1, 16, 20, "y"), (1, 2, 2, 20, 36, "z")], "song_id int, part int, cluster int, a int, b int, name string")
    lines = spark.createDataFrame([(1, 4 * k, 4 * k + 4, 0) for k in range(9)], "song_id int, a int, b int, cluster int")
    assert [r["name"] for r in S.name_vamps(parts, lines).orderBy("part").collect()] == ["Vamp A", "y", "Vamp C"]
    numbered = spark.createDataFrame([(1, k, c, n, float(k), k + 1.0) for k, (c, n) in enumerate([("A", "1"), ("B", "4"), ("A#", "1"), ("B", "4")])], "song_id int, pos int, chord string, nashville string, start double, end double")
    assert [(r["first_pos"], r["length"], r["a"], r["b"]) for r in P.alternating_vamps(numbered).collect()] == [(0, 4, "1", "4")]


def test_confidence_is_the_cosine(spark):
    root = C.STATES.index((3, "minor"))
    chroma = (C.templates()[root] * 7).tolist()
    beats = spark.createDataFrame([(1, k, k * 0.5, chroma, np.eye(12)[3].tolist()) for k in range(6)], "song_id int, beat int, time double, chroma array<double>, bass array<double>")
    tempo = spark.createDataFrame([(1, 0, 4)], "song_id int, phase int, bpb int")
    path = spark.createDataFrame([(1, k, root) for k in range(6)], "song_id int, beat int, state int")
    assert abs(C.chord_segments(path, C.chord_template_scores(beats), tempo).first()["confidence"] - 1) < 1e-9


def test_flat_series_and_short_songs(spark):
    beats = spark.createDataFrame([(1, k, 1.0) for k in range(5)], "song_id int, beat int, x double")
    assert {r["z"] for r in B.zscore(beats, {"x": "z"}).collect()} == {0.0}
    assert {r["acf"] for r in B.autocorrelation(beats, "x").collect()} == {0.0}
    few = spark.createDataFrame([(1, k, [0.0] * 60, 0.1) for k in range(3)], "song_id int, beat int, emission array<double>, p_change double")
    assert C.chord_path(few).count() == 0


def test_fixed_tables():
    assert len(C.STATES) == 60 and len(T.NASHVILLE_DEGREES) == 12
    assert abs(np.linalg.norm(C.templates(), axis=1) - 1).max() < 1e-9
