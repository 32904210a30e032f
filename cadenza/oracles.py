"""The same queries as SQL for DuckDB."""

from __future__ import annotations

from cadenza.functions import tables as T


def listed(values: tuple) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


def pick(values: tuple, index: str) -> str:
    return f"({listed(values)})[({index}) + 1]"


def look(table: dict, key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN " + (f"'{v}'" if isinstance(v, str) else str(v)) for k, v in table.items()) + " END"


def mod12(x: str) -> str:
    return f"((({x}) % 12 + 12) % 12)"


NOTES = look(T.NOTE_TO_PC, "{0}")
SUFFIX = look(T.QUALITY_SUFFIX, "{0}")
QUALITY = look({v: k for k, v in T.QUALITY_SUFFIX.items()}, "{0}")


def spelled(pc: str, tonic: str, mode: str) -> str:
    major = mod12(f"CASE WHEN {mode} = 'minor' THEN {tonic} + 3 ELSE {tonic} END")
    return f"CASE WHEN {major} IN {T.FLAT_TONICS} THEN {pick(T.FLAT_NAMES, mod12(pc))} ELSE {pick(T.SHARP_NAMES, mod12(pc))} END"


def numbered(root: str, quality: str, tonic: str) -> str:
    degree = pick(T.NASHVILLE_DEGREES, mod12(f"{NOTES.format(root)} - ({tonic})"))
    return f"({degree} || CASE WHEN {quality} = 'dominant7' THEN '⁷' ELSE coalesce({SUFFIX.format(quality)}, '') END)"


def note_of(text: str) -> str:
    word = f"string_split_regex(trim({text}), '\\s+')[1]"
    return NOTES.format(f"(upper(left({word}, 1)) || substr({word}, 2))")


ROOT = "CASE WHEN regexp_extract({0}, '^([A-G][#b]?)(.*)$', 1) = '' THEN {0} ELSE regexp_extract({0}, '^([A-G][#b]?)(.*)$', 1) END"
KIND = "coalesce(" + QUALITY.format("regexp_extract({0}, '^([A-G][#b]?)(.*)$', 2)") + ", 'major')"

EV = """ev AS (
  SELECT user_id AS song_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS pos,
    date_diff('microsecond', timestamp '2024-01-01', ts) / 3.6e9 AS t, event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS k
  FROM events
)"""


def chords(wide: bool = False) -> str:
    if wide:
        root, quality = "k % 12", look({"click": "major", "error": "minor", "purchase": "dominant7", "signup": "major7", "view": "minor7"}, "event_type")
    else:
        root, quality = look({"click": 0, "error": 7, "purchase": 9, "signup": 5, "view": 2}, "event_type"), look({"click": "major", "error": "major", "purchase": "minor", "signup": "major", "view": "dominant7"}, "event_type")
    return f"""{EV}, raw AS (
  SELECT song_id, pos, {root} AS root_pc, {quality} AS quality, t AS start, coalesce(lead(t) OVER (PARTITION BY song_id ORDER BY pos), t + 1.0) AS stop,
    (k + 1) / 97.0::DOUBLE AS confidence, CAST(floor(pos / 4) AS INT) AS bar, CASE WHEN pos < 40 THEN 0 ELSE 7 END AS key_tonic, 'major' AS key_mode FROM ev
), chords AS (SELECT *, stop - start AS duration, {pick(T.SHARP_NAMES, "root_pc")} AS root FROM raw)"""


def sequence(wide: bool = False) -> str:
    return f"""{chords(wide)}, labelled AS (SELECT *, root || {SUFFIX.format("quality")} AS chord FROM chords
), flagged AS (SELECT *, CASE WHEN chord = lag(chord) OVER (PARTITION BY song_id ORDER BY pos) THEN 0 ELSE 1 END AS fresh FROM labelled
), runs AS (SELECT *, sum(fresh) OVER (PARTITION BY song_id ORDER BY pos) AS island FROM flagged
), merged AS (
  SELECT song_id, CAST(island - 1 AS INT) AS pos, first(chord ORDER BY pos) AS chord, first(root ORDER BY pos) AS root, first(quality ORDER BY pos) AS quality, min(start) AS start,
    last(stop ORDER BY pos) AS stop, list_reduce(list(confidence ORDER BY pos), lambda c, x: (c + x) / 2) AS confidence, first(bar ORDER BY pos) AS bar, first(key_tonic ORDER BY pos) AS key_tonic
  FROM runs GROUP BY song_id, island
), seq AS (SELECT *, stop - start AS duration, {numbered("root", "quality", "key_tonic")} AS nashville FROM merged)"""


GRAMS = """, grams AS (
  SELECT song_id, pos, n, list(chord) OVER w AS c, list(nashville) OVER w AS m FROM seq, (SELECT unnest(range({0}, {1})) AS n)
  WINDOW w AS (PARTITION BY song_id, n ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)
), cut AS (SELECT song_id, pos, n, array_to_string(c[1:n], ' ') AS pattern, array_to_string(m[1:n], ' ') AS numbers FROM grams WHERE len(c) >= n)"""

PATTERNS = f"""{sequence()}{GRAMS.format(4, 9)}, patterns AS (
  SELECT song_id, pattern, n AS length, count(*) AS occurrences, min(pos) AS first_pos, first(numbers ORDER BY pos) AS numbers, string_agg(pos || ':' || numbers, ',' ORDER BY pos) AS places
  FROM cut GROUP BY ALL HAVING count(*) >= 2
)""".replace("GROUP BY ALL", "GROUP BY song_id, pattern, n")

STABLE = f"""{sequence()}, around AS (
  SELECT * REPLACE (duration / 8 AS duration), lag(chord) OVER w AS before, lead(chord) OVER w AS after, count(*) OVER (PARTITION BY song_id) AS items FROM seq WINDOW w AS (PARTITION BY song_id ORDER BY pos)
), marked AS (SELECT *, coalesce(before = after AND chord <> before AND duration > 0 AND duration < 0.65, false) AS glitch FROM around
), turned AS (SELECT *, CASE WHEN glitch AND lag(glitch) OVER (PARTITION BY song_id ORDER BY pos) THEN 0 ELSE 1 END AS fresh FROM marked
), grouped AS (SELECT *, sum(fresh) OVER (PARTITION BY song_id ORDER BY pos) AS g FROM turned
), nth AS (SELECT *, row_number() OVER (PARTITION BY song_id, g ORDER BY pos) AS nth FROM grouped
), fixed AS (SELECT song_id, pos, start, stop, items, CASE WHEN glitch AND nth % 2 = 1 AND items >= 3 THEN before ELSE chord END AS chord FROM nth
), again AS (SELECT *, CASE WHEN items >= 3 AND chord = lag(chord) OVER (PARTITION BY song_id ORDER BY pos) THEN 0 ELSE 1 END AS f2 FROM fixed
), isl AS (SELECT *, sum(f2) OVER (PARTITION BY song_id ORDER BY pos) AS island FROM again
), stable AS (SELECT song_id, CAST(island - 1 AS INT) AS pos, first(chord ORDER BY pos) AS chord, min(start) AS start, last(stop ORDER BY pos) AS stop FROM isl GROUP BY song_id, island)"""

VAMPS = f"""{sequence()}, items AS (SELECT song_id, pos, coalesce(nashville, chord) AS chord FROM seq
), steps AS (
  SELECT *, coalesce(chord = lag(chord, 2) OVER w AND chord <> lag(chord) OVER w, false) AS goes FROM items WINDOW w AS (PARTITION BY song_id ORDER BY pos)
), marked AS (SELECT *, CASE WHEN goes = lag(goes) OVER (PARTITION BY song_id ORDER BY pos) THEN 0 ELSE 1 END AS fresh FROM steps
), grouped AS (SELECT *, sum(fresh) OVER (PARTITION BY song_id ORDER BY pos) AS g FROM marked
), vamp AS (SELECT song_id, min(pos) - 2 AS first_pos, count(*) + 2 AS length, row_number() OVER (PARTITION BY song_id ORDER BY min(pos)) AS i FROM grouped WHERE goes GROUP BY song_id, g
), walk AS (
  SELECT song_id, i, first_pos AS f, length AS n, first_pos + length - 1 AS edge FROM vamp WHERE i = 1 AND length >= 4
  UNION ALL SELECT song_id, i, first_pos, length, -1 FROM vamp WHERE i = 1 AND length < 4
  UNION ALL
  SELECT v.song_id, v.i, v.first_pos + late, v.length - late, CASE WHEN v.length - late >= 4 THEN v.first_pos + v.length - 1 ELSE edge END
  FROM (SELECT v.*, w.edge, CASE WHEN v.first_pos <= w.edge THEN 1 ELSE 0 END AS late FROM vamp v JOIN walk w ON v.song_id = w.song_id AND v.i = w.i + 1) v
)
SELECT walk.song_id, CAST(f AS INT) AS first_pos, CAST(n AS BIGINT) AS length, x.chord AS a, y.chord AS b FROM walk
JOIN items x ON x.song_id = walk.song_id AND x.pos = f JOIN items y ON y.song_id = walk.song_id AND y.pos = f + 1 WHERE n >= 4"""

REGIONS = f"""{sequence()}{GRAMS.format(4, 5)}, regions AS (SELECT song_id, numbers AS signature, count(*) AS occurrences, min(pos) AS first_pos FROM cut GROUP BY song_id, numbers HAVING count(*) >= 2)"""

PAIRS = f"{EV}, pairs AS (SELECT song_id, pos, k % 12 AS pc, pos * 5 % 12 AS tonic, CASE WHEN k < 50 THEN 'major' ELSE 'minor' END AS mode FROM ev)"
LABELS = f"""{chords(True)}, labels AS (SELECT *, CASE WHEN pos % 11 = 0 THEN lower(root) || '?' WHEN pos % 13 = 0 THEN root || 'sus4' ELSE root || {SUFFIX.format("quality")} END AS chord FROM chords)"""
RELATIVE = mod12("tonic + CASE WHEN mode = 'minor' THEN 3 ELSE 9 END")
OTHER = "CASE WHEN mode = 'minor' THEN 'major' ELSE 'minor' END"
KEYS = {"Ab major": 0, "F# minor": 1}

ORACLES: dict[str, str] = {
    "audio_manifest": f"""WITH files AS (SELECT 'songs/' || source || '/' || doc_id || {pick((".mp3", ".WAV", ".txt", "", ".flac", ".Aac"), "doc_id % 6")} AS path FROM documents),
      cut AS (SELECT path, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS ext FROM files)
      SELECT path, ext, ext IN {T.AUDIO_SUFFIXES} AS accepted, CASE WHEN ext IN {T.AUDIO_SUFFIXES} THEN NULL ELSE 'Unsupported audio format: ' || CASE WHEN ext = '' THEN 'unknown' ELSE '.' || ext END END AS reason FROM cut""",
    "clip_quality_gate": f"""WITH {EV}, clips AS (SELECT song_id, sum(k) * 100 AS n, max(value) / 1e8 AS peak FROM ev GROUP BY song_id),
      judged AS (SELECT song_id, n / 22050.0::DOUBLE AS s, CASE WHEN n = 0 THEN 'empty' WHEN n / 22050.0 < 5 THEN 'too short' WHEN peak < 1e-6 THEN 'silent' END AS reason FROM clips)
      SELECT song_id, round(s, 6) AS seconds, reason IS NULL AS is_usable, reason FROM judged""",
    "apply_overrides": f"""WITH {EV}, w AS (SELECT song_id, {pick(("4/4", "5/4", "6/8", "3/4"), "k % 4")} AS meter, k * 3.0::DOUBLE AS bpm, {pick(("Ab major", "F# minor", "bb", "", "H major", "c Minor"), "k % 6")} AS key FROM ev WHERE pos = 0)
      SELECT song_id, CASE WHEN meter IN {tuple(T.METER_BEATS)} THEN meter END AS forced_meter, CASE WHEN bpm BETWEEN 30 AND 240 THEN bpm END AS forced_bpm, coalesce({note_of("key")}, -1) AS forced_tonic,
        CASE WHEN {note_of("key")} IS NOT NULL THEN CASE WHEN lower(key) LIKE '% min%' THEN 'minor' ELSE 'major' END END AS forced_mode FROM w""",
    "parse_key": f"""WITH {EV}, w AS (SELECT song_id, pos, {pick(("Ab", "f#", "Bb", "H", "", "c", "E"), "k % 7")} || {pick((" major", " minor", "", "  Min", " dorian"), "pos % 5")} AS text FROM ev)
      SELECT song_id, pos, coalesce({note_of("text")}, -1) AS tonic, CASE WHEN {note_of("text")} IS NOT NULL THEN CASE WHEN lower(coalesce(string_split_regex(trim(text), '\\s+')[2], '')) LIKE 'min%' THEN 'minor' ELSE 'major' END END AS mode FROM w""",
    "spell_pitch": f"WITH {PAIRS} SELECT song_id, pos, {spelled('pc', 'tonic', 'mode')} AS name FROM pairs",
    "relative_key": f"WITH {PAIRS}, r AS (SELECT song_id, pos, {RELATIVE} AS tonic, {OTHER} AS mode FROM pairs) SELECT song_id, pos, {spelled('tonic', 'tonic', 'mode')} || ' ' || mode AS name FROM r",
    "split_chord": f"WITH {LABELS} SELECT song_id, pos, {ROOT.format('chord')} AS root, {KIND.format('chord')} AS quality FROM labels",
    "chord_label": f"WITH {chords(True)} SELECT song_id, pos, root || {SUFFIX.format('quality')} AS chord FROM chords",
    "chord_to_nashville": f"""WITH {LABELS}, parts AS (SELECT song_id, pos, {ROOT.format("chord")} AS root, {KIND.format("chord")} AS quality, {note_of(pick(("Ab major", "G minor", "", "F#"), "pos % 4"))} AS tonic FROM labels)
      SELECT song_id, pos, {numbered("root", "quality", "tonic")} AS nashville FROM parts""",
    "harmonic_role": f"""WITH {EV}, w AS (SELECT song_id, pos, translate({pick(("I", "ii", "V", "vii°", "A♭", "", "X", "Ab"), "k % 8")}, '♭♯', 'b#') AS chord, {pick(("Ab", "C", ""), "pos % 3")} AS tonic FROM ev)
      SELECT song_id, pos, CASE WHEN chord = '' THEN 'unknown' WHEN chord = tonic THEN 'tonic' ELSE coalesce({look(T.ROLES, "chord")}, 'chromatic') END AS role FROM w""",
    "format_clock": f"""WITH {EV}, w AS (SELECT song_id, pos, k + pos * 0.25::DOUBLE AS s FROM ev)
      SELECT song_id, pos, printf('%d:%05.2f', CAST(floor(s / 60) AS BIGINT), s - floor(s / 60) * 60) AS clock FROM w""",
    "chord_sequence": f"WITH {sequence()} SELECT song_id, pos, chord, round(start, 6) AS start, round(stop, 6) AS \"end\", round(confidence, 6) AS confidence, bar FROM seq",
    "add_nashville": f"""WITH {sequence(True)}, keyed AS (SELECT *, CAST(count(*) OVER (PARTITION BY song_id) % 12 AS INT) AS own FROM seq)
      SELECT song_id, pos, chord, {numbered("root", "quality", "CASE WHEN pos % 7 > 0 THEN key_tonic ELSE own END")} AS nashville FROM keyed""",
    "repeated_patterns": f"WITH {PATTERNS} SELECT * FROM patterns",
    "maximal_patterns": f"""WITH {PATTERNS} SELECT song_id, pattern, length, occurrences, first_pos, numbers FROM patterns p
      WHERE NOT EXISTS (SELECT 1 FROM patterns q WHERE q.song_id = p.song_id AND q.length > p.length AND contains(' ' || q.pattern || ' ', ' ' || p.pattern || ' '))""",
    "stabilize_chords": f"WITH {STABLE} SELECT song_id, pos, chord, round(start, 6) AS start, round(stop, 6) AS \"end\" FROM stable",
    "chord_statistics": f"""WITH {STABLE}, n AS (SELECT song_id, chord, count(*) AS n FROM stable GROUP BY song_id, chord)
      SELECT song_id, any_value(o.original) AS original, CAST(sum(n) AS BIGINT) AS stabilized, count(*) AS different, string_agg(chord || ':' || n, ',' ORDER BY chord) AS counts FROM n JOIN (SELECT song_id, count(*) AS original FROM seq GROUP BY song_id) o USING (song_id) GROUP BY song_id""",
    "alternating_vamps": f"WITH RECURSIVE {VAMPS}",
    "repeated_regions": f"WITH {REGIONS} SELECT song_id, signature, occurrences, first_pos FROM regions",
    "rotation_merged_regions": f"""WITH {REGIONS}, parts AS (SELECT *, string_split(signature, ' ') AS s FROM regions),
      turned AS (SELECT *, list_min([array_to_string(list_concat(s[i:], s[:i - 1]), ' ') for i in range(1, 5)]) AS least FROM parts)
      SELECT song_id, first(signature ORDER BY first_pos) AS signature, CAST(sum(occurrences) AS BIGINT) AS occurrences, min(first_pos) AS first_pos, count(*) AS variants FROM turned GROUP BY song_id, least""",
    "compress_runs": f"""WITH {chords()}, s AS (SELECT song_id, pos, CASE WHEN pos % 9 > 0 THEN root || {SUFFIX.format("quality")} ELSE '?' END AS s FROM chords),
      f AS (SELECT *, CASE WHEN s = lag(s) OVER (PARTITION BY song_id ORDER BY pos) THEN 0 ELSE 1 END AS fresh FROM s), g AS (SELECT *, sum(fresh) OVER (PARTITION BY song_id ORDER BY pos) AS g FROM f),
      r AS (SELECT song_id, g, any_value(s) AS s, count(*) AS n FROM g GROUP BY song_id, g)
      SELECT song_id, string_agg(CASE WHEN n > 1 THEN s || ' ×' || n ELSE s END, ' ' ORDER BY g) AS text FROM r GROUP BY song_id""",
}

FRAMES = f"""{EV}, tones AS (
  SELECT song_id, pos AS frame, pc, CASE WHEN pc = k % 12 THEN value WHEN pc = (k % 12 + 7) % 12 THEN value * 0.51::DOUBLE WHEN pc = (k % 12 + 4) % 12 THEN value * 0.23::DOUBLE ELSE 0 END AS raw
  FROM ev, (SELECT unnest(range(12)) AS pc)
), scaled AS (SELECT *, raw / sum(raw) OVER (PARTITION BY song_id, frame) AS x FROM tones
), sizes AS (SELECT song_id, max(pos) + 1 AS n FROM ev GROUP BY song_id)"""

PROFILES = "profiles AS (SELECT tonic, mode, pc, CASE mode WHEN 'major' THEN {0} ELSE {1} END AS w FROM (SELECT unnest(range(12)) AS tonic), (SELECT unnest(['major', 'minor']) AS mode), (SELECT unnest(range(12)) AS pc))".format(
    pick(T.MAJOR_PROFILE, "(pc - tonic + 12) % 12"), pick(T.MINOR_PROFILE, "(pc - tonic + 12) % 12")
)

CANDIDATES = f"""{FRAMES}, {PROFILES}, chroma AS (SELECT song_id, pc, avg(x) AS x FROM scaled GROUP BY song_id, pc
), scores AS (SELECT song_id, tonic, mode, corr(x, CAST(w AS DOUBLE)) AS score FROM chroma JOIN profiles USING (pc) GROUP BY song_id, tonic, mode
), candidates AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY round(score, 9) DESC, tonic, mode) AS rank FROM scores)"""

WINDOWS = f"""{FRAMES}, {PROFILES}, wins AS (SELECT song_id, unnest(range(greatest(0, CAST(floor((n - 12) / 3) AS INT)) + 1)) AS win FROM sizes
), windows AS (SELECT s.song_id, w.win, s.pc, avg(x) AS x FROM scaled s JOIN wins w ON s.song_id = w.song_id AND s.frame BETWEEN w.win * 3 AND w.win * 3 + 11 GROUP BY s.song_id, w.win, s.pc
), fit AS (SELECT song_id, win, tonic, mode, corr(x, CAST(w AS DOUBLE)) AS score FROM windows JOIN profiles USING (pc) GROUP BY song_id, win, tonic, mode
), regions AS (SELECT song_id, win, CASE mode WHEN 'major' THEN tonic ELSE (tonic + 3) % 12 END AS region, round(max(score), 9) AS score FROM fit GROUP BY ALL)""".replace(
    "GROUP BY ALL", "GROUP BY 1, 2, 3"
)

PATHS = f"""{WINDOWS}, walk AS (
  SELECT song_id, win, region, score, [region] AS path FROM regions WHERE win = 0
  UNION ALL
  SELECT song_id, win, region, total AS score, list_append(path, region) FROM (
    SELECT r.song_id, r.win, r.region, w.path, best + r.score AS total, row_number() OVER (PARTITION BY r.song_id, r.win, r.region ORDER BY best DESC, w.region) AS nth
    FROM (SELECT *, unnest(range(12)) AS to_region FROM walk) w
    JOIN regions r ON r.song_id = w.song_id AND r.win = w.win + 1 AND r.region = w.to_region,
    LATERAL (SELECT w.score - CASE WHEN (r.region - w.region + 12) % 12 = 0 THEN 0 WHEN (r.region - w.region + 12) % 12 IN (1, 2) THEN 0.8::DOUBLE ELSE 1.2::DOUBLE END AS best)
  ) WHERE nth = 1
), ends AS (SELECT song_id, path FROM (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY win DESC, score DESC, region) AS nth FROM walk) WHERE nth = 1
), paths AS (SELECT song_id, CAST(unnest(range(len(path))) AS INT) AS win, CAST(unnest(path) AS INT) AS region FROM ends)"""

VOTES = f"""{PATHS}, tally AS (SELECT song_id, region, row_number() OVER (PARTITION BY song_id ORDER BY count(*) DESC, region) AS nth FROM paths GROUP BY song_id, region
), main AS (SELECT song_id, region FROM tally WHERE nth = 1
), own AS (SELECT m.song_id, m.region, w.pc, avg(w.x) AS x FROM main m JOIN paths p ON p.song_id = m.song_id AND p.region = m.region JOIN windows w ON w.song_id = p.song_id AND w.win = p.win GROUP BY m.song_id, m.region, w.pc
), rated AS (
  SELECT song_id, region, corr(x, CAST(w AS DOUBLE)) FILTER (mode = 'major' AND tonic = region) AS a, corr(x, CAST(w AS DOUBLE)) FILTER (mode = 'minor' AND tonic = (region + 9) % 12) AS b
  FROM own JOIN profiles USING (pc) GROUP BY song_id, region
), song_key AS (SELECT song_id, CASE WHEN a >= b THEN region ELSE (region + 9) % 12 END AS tonic, CASE WHEN a >= b THEN 'major' ELSE 'minor' END AS mode, greatest(a, b) AS confidence, abs(a - b) AS margin FROM rated)"""

TIMES = f"""{VOTES}, placed AS (
  SELECT p.song_id, p.win, k.mode, CASE k.mode WHEN 'minor' THEN (p.region + 9) % 12 ELSE p.region END AS tonic,
    CASE WHEN p.win = 0 THEN 0 ELSE p.win * 3 + 4.625::DOUBLE END AS start, CASE WHEN p.win = max(p.win) OVER (PARTITION BY p.song_id) THEN CAST(n AS DOUBLE) ELSE p.win * 3 + 7.875::DOUBLE END AS stop
  FROM paths p JOIN song_key k USING (song_id) JOIN sizes USING (song_id)
), fresh AS (SELECT *, CASE WHEN tonic = lag(tonic) OVER (PARTITION BY song_id ORDER BY win) THEN 0 ELSE 1 END AS f FROM placed
), runs AS (SELECT *, sum(f) OVER (PARTITION BY song_id ORDER BY win) AS g FROM fresh
), timeline AS (SELECT song_id, CAST(g - 1 AS INT) AS seg, CAST(min(start) AS DOUBLE) AS start, last(stop ORDER BY win) AS stop, any_value(tonic) AS tonic, any_value(mode) AS mode FROM runs GROUP BY song_id, g
), named AS (SELECT *, {spelled("tonic", "tonic", "mode")} || ' ' || mode AS key FROM timeline)"""

EVIDENCE = """ahead AS (SELECT song_id, pos, root_pc, duration, CASE WHEN quality IN ('major', 'major7', 'dominant7') THEN 'major' ELSE 'minor' END AS family, lead(root_pc) OVER (PARTITION BY song_id ORDER BY pos) AS nxt FROM chords
), degrees AS (SELECT a.*, tonic, mode, (root_pc - tonic + 12) % 12 AS d, (nxt - tonic + 12) % 12 AS nd FROM ahead a JOIN keys USING (song_id)
), evidence AS (
  SELECT song_id, tonic, mode, sum(CASE WHEN (mode = 'major' AND d || family IN {0}) OR (mode = 'minor' AND d || family IN {1}) THEN duration ELSE 0 END) / sum(duration) AS diatonic_fit,
    sum(CASE WHEN d = 0 AND family = mode THEN duration ELSE 0 END) / sum(duration) AS tonic_time, count(*) FILTER (d = 7 AND nd = 0) AS resolutions, count(*) AS n
  FROM degrees GROUP BY song_id, tonic, mode
), combined AS (SELECT *, 0.55::DOUBLE * diatonic_fit + 0.35::DOUBLE * tonic_time + 0.1::DOUBLE * least(1.0::DOUBLE, resolutions / n * 4) AS combined FROM evidence)""".format(
    *(tuple(f"{d}{f}" for d, fs in t.items() for f in fs) for t in (T.MAJOR_FAMILY, T.MINOR_FAMILY))
)

ENDPOINTS = """bounds AS (SELECT song_id, n, floor(least(45, n * 0.12::DOUBLE)) AS a, floor(greatest(0, n - least(20, n * 0.08::DOUBLE))) AS b FROM sizes
), sums AS (SELECT song_id, pc, any_value(n) AS n, sum(CASE WHEN frame < a THEN raw ELSE 0 END) AS early, sum(CASE WHEN frame >= b THEN raw ELSE 0 END) AS late FROM tones JOIN bounds USING (song_id) GROUP BY song_id, pc
), shares AS (SELECT *, coalesce(early / nullif(sum(early) OVER (PARTITION BY song_id), 0), 0) AS e, coalesce(late / nullif(sum(late) OVER (PARTITION BY song_id), 0), 0) AS l FROM sums
), endpoints AS (SELECT k.song_id, k.tonic, k.mode, CASE WHEN n <= 2 THEN 0 ELSE 0.35::DOUBLE * e + 0.65::DOUBLE * l END AS endpoint FROM keys k JOIN shares s ON s.song_id = k.song_id AND s.pc = k.tonic)"""

_CHORDS_ONLY = chords().removeprefix(EV)

ORACLES |= {
    "global_chroma": f"WITH {FRAMES} SELECT song_id, CAST(pc AS INT) AS pc, round(avg(x), 6) AS x FROM scaled GROUP BY song_id, pc",
    "key_candidates": f"WITH {CANDIDATES} SELECT song_id, tonic, mode, round(score, 6) AS score, rank FROM candidates",
    "key_windows": f"WITH {WINDOWS} SELECT song_id, win, pc, round(x, 6) AS x FROM windows",
    "region_scores": f"WITH {WINDOWS} SELECT song_id, win, region AS pc, round(score, 6) AS x FROM regions",
    "key_path": f"WITH RECURSIVE {PATHS} SELECT song_id, win, region FROM paths",
    "key_mode_vote": f"WITH RECURSIVE {VOTES} SELECT song_id, tonic, mode, round(confidence, 6) AS confidence, round(margin, 6) AS margin FROM song_key",
    "key_timeline": f'WITH RECURSIVE {TIMES} SELECT song_id, seg, start, stop AS "end", tonic, mode, key FROM named',
    "modulations": f"""WITH RECURSIVE {TIMES} SELECT * FROM (SELECT song_id, start AS time, lag(key) OVER w AS from_key, key AS to_key, (tonic - lag(tonic) OVER w + 12) % 12 AS semitones FROM named WINDOW w AS (PARTITION BY song_id ORDER BY seg)) WHERE from_key IS NOT NULL""",
    "key_runner_up": f"""WITH {CANDIDATES}, best AS (SELECT * FROM candidates WHERE rank = 1), other AS (SELECT c.*, row_number() OVER (PARTITION BY c.song_id ORDER BY c.rank) AS nth, b.score AS win FROM candidates c JOIN best b ON b.song_id = c.song_id AND b.tonic <> c.tonic)
      SELECT song_id, tonic, mode, round(score, 6) AS score FROM other WHERE nth = 1 AND win > 0 AND (win - score) / win < 0.15""",
    "forced_key": f"""WITH RECURSIVE {VOTES}, chroma AS (SELECT song_id, pc, avg(x) AS x FROM scaled GROUP BY song_id, pc), wish AS (SELECT song_id, k % 12 AS t FROM ev WHERE pos = 0 AND k % 3 = 0),
      forced AS (SELECT song_id, t, corr(x, CAST(w AS DOUBLE)) AS score FROM wish JOIN chroma USING (song_id) JOIN profiles p ON p.pc = chroma.pc AND p.tonic = t AND p.mode = 'minor' GROUP BY song_id, t)
      SELECT song_id, coalesce(t, tonic) AS tonic, CASE WHEN t IS NULL THEN mode ELSE 'minor' END AS mode, round(CASE WHEN t IS NULL THEN confidence ELSE score END, 6) AS confidence, round(CASE WHEN t IS NULL THEN margin END, 6) AS margin, t IS NOT NULL AS user_forced
      FROM song_key LEFT JOIN forced USING (song_id)""",
    "key_at": f"""WITH RECURSIVE {TIMES}, points AS (SELECT song_id, pos, pos * 1.1::DOUBLE AS time FROM ev), ranked AS (
      SELECT p.song_id, p.pos, t.tonic, t.mode, row_number() OVER (PARTITION BY p.song_id, p.pos ORDER BY CASE WHEN start <= time AND time < stop THEN seg ELSE 1000000 - seg END) AS nth FROM points p JOIN timeline t USING (song_id))
      SELECT song_id, pos, tonic AS key_tonic, mode AS key_mode FROM ranked WHERE nth = 1""",
    "key_chord_evidence": f"""WITH {CANDIDATES}{_CHORDS_ONLY}, keys AS (SELECT song_id, tonic, mode FROM candidates WHERE rank <= 3), {EVIDENCE}
      SELECT song_id, tonic, mode, round(diatonic_fit, 6) AS diatonic_fit, round(tonic_time, 6) AS tonic_time, resolutions, round(combined, 6) AS combined FROM combined""",
    "forced_timeline": f"""WITH RECURSIVE {TIMES}, wish AS (SELECT song_id, k % 12 AS tonic, 'minor' AS mode FROM ev WHERE pos = 0 AND k % 3 = 0),
      both_kinds AS (SELECT song_id, seg, start, stop, tonic, mode, key FROM named WHERE song_id NOT IN (SELECT song_id FROM wish) UNION ALL SELECT song_id, 0, 0, CAST(n AS DOUBLE), tonic, mode, {spelled("tonic", "tonic", "mode")} || ' ' || mode FROM wish JOIN sizes USING (song_id))
      SELECT song_id, seg, start, stop AS "end", tonic, mode, key, count(*) OVER (PARTITION BY song_id) AS segments FROM both_kinds""",
    "relabelled_timeline": f"""WITH RECURSIVE {TIMES}, wish AS (SELECT song_id, CASE WHEN k % 2 = 0 THEN 'major' ELSE 'minor' END AS other FROM ev WHERE pos = 0),
      turned AS (SELECT song_id, seg, start, stop, other AS mode, CASE WHEN mode <> other THEN {RELATIVE} ELSE tonic END AS tonic FROM timeline JOIN wish USING (song_id))
      SELECT song_id, seg, start, stop AS "end", tonic, mode, {spelled("tonic", "tonic", "mode")} || ' ' || mode AS key FROM turned""",
    "endpoint_evidence": f"WITH {CANDIDATES}, keys AS (SELECT * FROM candidates WHERE rank = 1), {ENDPOINTS} SELECT song_id, tonic, mode, round(endpoint, 6) AS endpoint FROM endpoints",
    "refine_key_mode": f"""WITH {CANDIDATES}{_CHORDS_ONLY}, best AS (SELECT * FROM candidates WHERE rank = 1),
      keys AS (SELECT song_id, tonic, mode, true AS own FROM best UNION ALL SELECT song_id, {RELATIVE}, {OTHER}, false FROM best), {EVIDENCE}, {ENDPOINTS},
      rated AS (SELECT song_id, max(combined + 0.35::DOUBLE * endpoint) FILTER (own) AS mine, max(combined + 0.35::DOUBLE * endpoint) FILTER (NOT own) AS theirs FROM combined JOIN endpoints USING (song_id, tonic, mode) JOIN keys USING (song_id, tonic, mode) GROUP BY song_id)
      SELECT song_id, CASE WHEN theirs > mine + 0.05 THEN {RELATIVE} ELSE tonic END AS tonic, CASE WHEN theirs > mine + 0.05 THEN {OTHER} ELSE mode END AS mode, round(score, 6) AS confidence, 0.0::DOUBLE AS margin, theirs > mine + 0.05 AS mode_corrected_by_chords
      FROM best JOIN rated USING (song_id)""",
}

SERIES = f"""{EV}, beats AS (SELECT song_id, pos AS beat, pos * 20 + k % 5 AS frame, t AS time, value AS low, value + k AS "full", k / 100.0::DOUBLE AS nov FROM ev
), scored AS (SELECT *, {", ".join(f"CASE WHEN stddev_pop({c}) OVER s > 1e-12 THEN ({c} - avg({c}) OVER s) / stddev_pop({c}) OVER s ELSE 0 END AS {n}" for c, n in (("low", "low_z"), ('"full"', "full_z"), ("nov", "nov_z")))} FROM beats WINDOW s AS (PARTITION BY song_id))"""


def every(n: int = 5) -> str:
    return f"grid AS (SELECT song_id, pos // {n} AS beat, pos AS frame FROM ev WHERE pos % {n} = 0)"


def acf(column: str, name: str) -> str:
    return f"""{name}_c AS (SELECT song_id, beat, {column} - avg({column}) OVER (PARTITION BY song_id) AS x FROM beats
), {name}_e AS (SELECT song_id, sum(x * x) AS e FROM {name}_c GROUP BY song_id
), {name} AS (
  SELECT c.song_id, lag, CASE WHEN any_value(e) > 1e-12 THEN coalesce(sum(c.x * d.x), 0) / any_value(e) ELSE 0 END AS acf
  FROM {name}_c c CROSS JOIN (SELECT CAST(unnest(range(17)) AS INT) AS lag) LEFT JOIN {name}_c d ON d.song_id = c.song_id AND d.beat = c.beat + lag JOIN {name}_e e ON e.song_id = c.song_id GROUP BY c.song_id, lag
)"""


def strength(ac: str, b: int) -> str:
    peak = lambda k: f"greatest(0, {ac}[{k + 1}] - 0.5 * ({ac}[{k}] + {ac}[{k + 2}]))"
    return f"(0.65::DOUBLE * {peak(b)} + 0.35::DOUBLE * {peak(2 * b)})"


METER = f"""{SERIES}, {acf("low", "acl")}, {acf("nov", "acn")}, wide AS (SELECT song_id, (SELECT list(acf ORDER BY lag) FROM acl WHERE acl.song_id = s.song_id) AS a, (SELECT list(acf ORDER BY lag) FROM acn WHERE acn.song_id = s.song_id) AS n, song_id % 8 / 50.0::DOUBLE + 0.40::DOUBLE AS tri FROM (SELECT DISTINCT song_id FROM beats) s
), strong AS (SELECT song_id, {", ".join(f"0.6::DOUBLE * {strength('a', b)} + 0.4::DOUBLE * {strength('n', b)} AS s{b}" for b in (2, 3, 4, 6))}, CASE WHEN tri >= 0.52::DOUBLE THEN 1.0::DOUBLE WHEN tri >= 0.45::DOUBLE THEN (tri - 0.45::DOUBLE) / 0.07::DOUBLE ELSE 0 END AS c FROM wide
), scores AS (SELECT song_id, unnest([
    {{'o': 0, 'label': '4/4', 'bpb': 4, 'score': s4 * (1 - c)}}, {{'o': 1, 'label': '3/4', 'bpb': 3, 'score': s3 * (1 - c) * 0.90::DOUBLE}}, {{'o': 2, 'label': '2/4', 'bpb': 2, 'score': s2 * (1 - c) * 0.45::DOUBLE}},
    {{'o': 3, 'label': '12/8', 'bpb': 4, 'score': s4 * c * 0.90::DOUBLE}}, {{'o': 4, 'label': '9/8', 'bpb': 3, 'score': s3 * c * 0.55::DOUBLE}},
    {{'o': 5, 'label': '6/8', 'bpb': 2, 'score': CASE WHEN c > 0 AND s6 > greatest(s2, s4) THEN greatest(greatest(s2, 0.8::DOUBLE * s6) * c * 0.85::DOUBLE, s6 * c) ELSE greatest(s2, 0.8::DOUBLE * s6) * c * 0.85::DOUBLE END}}
  ], recursive := true) FROM strong
), ordered AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY score DESC, o) AS nth, sum(score) OVER (PARTITION BY song_id) AS total FROM scores
), meter AS (
  SELECT song_id, CASE WHEN max(score) > 0 THEN first(label ORDER BY nth) ELSE '4/4' END AS label, CASE WHEN max(score) > 0 THEN first(bpb ORDER BY nth) ELSE 4 END AS bpb,
    CASE WHEN max(score) > 0 THEN max(score) / (any_value(total) + 1e-9) ELSE 0 END AS confidence, string_agg(label, ' ' ORDER BY nth) FILTER (nth <= 3) AS best FROM ordered GROUP BY song_id
)"""

PHASE = f"""{METER}, means AS (SELECT song_id, bpb, beat % bpb AS p, avg(low_z) + 0.7::DOUBLE * avg(nov_z) + 0.3::DOUBLE * avg(full_z) AS score, count(*) AS n FROM scored JOIN meter USING (song_id) GROUP BY song_id, bpb, beat % bpb
), tempo AS (SELECT song_id, bpb, p AS phase FROM (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY round(score, 9) DESC, p) AS nth FROM means WHERE n >= 2) WHERE nth = 1)"""

FOLD = f"""{EV}, beats AS (SELECT song_id, pos AS beat, pos * CASE song_id % 3 WHEN 0 THEN 20 WHEN 1 THEN 10 ELSE 61 END + k % 5 AS frame, value AS low, value + k AS "full" FROM ev
), gaps AS (SELECT *, lead(frame) OVER (PARTITION BY song_id ORDER BY beat) AS nxt FROM beats
), about AS (SELECT song_id, 60 / (quantile_cont(nxt - frame, 0.5) * ({T.HOP} / {T.SAMPLE_RATE}::DOUBLE)) AS bpm,
    CASE WHEN avg(low) FILTER (beat % 2 = 0) + avg("full") FILTER (beat % 2 = 0) >= avg(low) FILTER (beat % 2 = 1) + avg("full") FILTER (beat % 2 = 1) THEN 0 ELSE 1 END AS side FROM gaps GROUP BY song_id
), folded AS (SELECT *, CASE WHEN song_id % 7 = 0 THEN 1.0::DOUBLE WHEN bpm >= 160 THEN 0.5::DOUBLE WHEN bpm < 50 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS fold FROM gaps JOIN about USING (song_id)
), places AS (SELECT song_id, fold, unnest(CASE WHEN fold = 2 AND nxt IS NOT NULL THEN [frame, (frame + nxt) // 2] ELSE [frame] END) AS frame FROM folded WHERE fold <> 0.5 OR beat % 2 = side
), again AS (SELECT *, lead(frame) OVER (PARTITION BY song_id ORDER BY frame) - frame AS gap, row_number() OVER (PARTITION BY song_id ORDER BY frame) - 1 AS beat FROM places
), measured AS (SELECT song_id, 60 / (quantile_cont(gap, 0.5) * ({T.HOP} / {T.SAMPLE_RATE}::DOUBLE)) AS tempo FROM again GROUP BY song_id)"""

STATES = f"""states AS (
  SELECT root, q, quality, pc, w / sqrt(sum(w * w) OVER (PARTITION BY root, q)) AS w, CASE quality WHEN 'major7' THEN -0.045::DOUBLE WHEN 'major' THEN 0 WHEN 'minor' THEN 0 ELSE -0.035::DOUBLE END AS bias FROM (
    SELECT root, q, quality, pc, CAST(CASE {" ".join(f"WHEN quality = '{q}' AND (pc - root + 12) % 12 = {s} THEN {w}" for q, tones in T.QUALITY_TONES.items() for s, w in tones.items())} ELSE 0 END AS DOUBLE) AS w
    FROM (SELECT unnest(range(12)) AS root), (SELECT unnest(range(5)) AS q, unnest({listed(T.STATE_QUALITIES)}) AS quality), (SELECT unnest(range(12)) AS pc)))"""

_IN = lambda table: tuple(f"{d}{q}" for d, qs in table.items() for q in qs)
HEARD = f"""{FRAMES}, {STATES}, norms AS (SELECT song_id, frame AS beat, sqrt(sum(raw * raw)) AS norm, sum(raw) AS total FROM tones GROUP BY song_id, frame
), scores AS (
  SELECT t.song_id, t.frame AS beat, root * 5 + q AS state, root, quality, sum(raw * w) / any_value(norm) AS cosine, sum(raw * w) / any_value(norm) + CASE WHEN root = any_value(e.k) % 12 THEN 0.08::DOUBLE ELSE 0 END + any_value(bias) AS score
  FROM tones t JOIN states s USING (pc) JOIN norms n ON n.song_id = t.song_id AND n.beat = t.frame JOIN ev e ON e.song_id = t.song_id AND e.pos = t.frame GROUP BY t.song_id, t.frame, root, q, quality
), keyed AS (SELECT song_id, pos AS beat, t AS time, CASE WHEN t < 300 THEN song_id % 12 ELSE (song_id + 7) % 12 END AS key_tonic, CASE WHEN t < 300 THEN 'major' ELSE 'minor' END AS key_mode FROM ev
), degrees AS (SELECT k.*, s.state, s.score, s.cosine, s.quality, (s.root - key_tonic + 12) % 12 AS d FROM keyed k JOIN scores s USING (song_id, beat)
), priors AS (
  SELECT *, CAST(CASE WHEN key_mode = 'major' THEN CASE WHEN d || quality = '0dominant7' THEN 0.3 WHEN d || quality IN {_IN(T.MAJOR_DIATONIC)} THEN 0.7 WHEN d || quality IN {_IN(T.MAJOR_BORROWED)} THEN 0.3 WHEN d IN (0, 2, 4, 5, 7, 9, 10) THEN 0.25 ELSE 0 END
    ELSE CASE WHEN d || quality IN {_IN(T.MINOR_DIATONIC)} THEN 0.7 WHEN d IN (0, 3, 5, 7, 8, 10) THEN 0.25 ELSE 0 END END AS DOUBLE) AS prior FROM degrees
), medians AS (SELECT song_id, quantile_cont(total, 0.5) AS middle FROM norms GROUP BY song_id
), heard AS (
  SELECT p.*, CASE WHEN n.total < 0.05::DOUBLE * m.middle THEN 0 ELSE (score - max(score) OVER (PARTITION BY p.song_id, p.beat)) / 0.04::DOUBLE + prior END AS emission,
    CASE WHEN (p.beat - p.song_id % 3 + 4) % 4 = 0 THEN 0.45::DOUBLE WHEN (p.beat - p.song_id % 3 + 4) % 4 = 2 THEN 0.12::DOUBLE ELSE 0.02::DOUBLE END AS p_change
  FROM priors p JOIN norms n USING (song_id, beat) JOIN medians m USING (song_id)
)"""

CHORD_PATH = f"""{HEARD}, walk AS (
  SELECT song_id, beat, state, emission AS total, [state] AS path FROM heard WHERE beat = 0
  UNION ALL
  SELECT h.song_id, h.beat, h.state, CASE WHEN moved THEN w.top ELSE w.total END + CASE WHEN moved THEN ln(p_change / 59) ELSE ln(1 - p_change) END + emission, list_append(CASE WHEN moved THEN w.top_path ELSE w.path END, h.state)
  FROM (SELECT *, max(total) OVER s AS top, first(state) OVER (PARTITION BY song_id ORDER BY total DESC, state) AS top_state, first(path) OVER (PARTITION BY song_id ORDER BY total DESC, state) AS top_path FROM walk WINDOW s AS (PARTITION BY song_id)) w
  JOIN heard h ON h.song_id = w.song_id AND h.beat = w.beat + 1 AND h.state = w.state, LATERAL (SELECT w.state <> w.top_state AND w.top + ln(p_change / 59) > w.total + ln(1 - p_change) AS moved)
), ends AS (SELECT song_id, path FROM (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY beat DESC, total DESC, state) AS nth FROM walk) WHERE nth = 1 AND len(path) >= 4
), chosen AS (SELECT song_id, CAST(unnest(range(len(path))) AS INT) AS beat, CAST(unnest(path) AS INT) AS state FROM ends)"""

SEGMENTS = f"""{CHORD_PATH}, timed AS (SELECT c.*, h.time, h.cosine, lead(h.time) OVER w AS nxt, h.time - lag(h.time) OVER w AS gap, CASE WHEN c.state = lag(c.state) OVER w THEN 0 ELSE 1 END AS f FROM chosen c JOIN heard h USING (song_id, beat, state) WINDOW w AS (PARTITION BY song_id ORDER BY beat)
), runs AS (SELECT *, sum(f) OVER (PARTITION BY song_id ORDER BY beat) AS g FROM timed
), segments AS (
  SELECT song_id, CAST(g - 1 AS INT) AS pos, any_value(state) // 5 AS root_pc, {pick(T.STATE_QUALITIES, "any_value(state) % 5")} AS quality, min(time) AS start, last(coalesce(nxt, time + gap) ORDER BY beat) AS stop, min(beat) AS beat_start, max(beat) + 1 AS beat_end, avg(cosine) AS confidence
  FROM runs GROUP BY song_id, g)"""

FOUND = f"""{chords()}, found AS (SELECT song_id, start + 0.5::DOUBLE AS a, stop + 0.5::DOUBLE AS b, CASE WHEN pos % 5 = 0 THEN 1 ELSE root_pc END AS root, quality FROM chords
), accuracy AS (
  SELECT c.song_id, sum(CASE WHEN f.root = c.root_pc AND (f.quality LIKE 'min%') = (c.quality LIKE 'min%') THEN least(b, stop) - greatest(a, start) ELSE 0 END) / sum(least(b, stop) - greatest(a, start)) AS accuracy
  FROM chords c JOIN found f ON f.song_id = c.song_id AND f.a < c.stop AND c.start < f.b GROUP BY c.song_id)"""

ORACLES |= {
    "beat_accents": f"""WITH {EV}, f AS (SELECT song_id, pos, max(value * k / 100.0::DOUBLE) OVER w AS l, max(value) OVER w AS o FROM ev WINDOW w AS (PARTITION BY song_id ORDER BY pos RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING))
      SELECT song_id, pos // 5 AS beat, l AS acc_low_env, o AS acc_onset_env FROM f WHERE pos % 5 = 0""",
    "beat_chroma": f"""WITH {FRAMES}, {every()}, spans AS (SELECT song_id, beat, frame, least(coalesce(lead(frame) OVER w, frame + coalesce(frame - lag(frame) OVER w, 1)), n) AS stop FROM grid JOIN sizes USING (song_id) WINDOW w AS (PARTITION BY song_id ORDER BY beat))
      SELECT s.song_id, s.beat, pc, round(CASE WHEN count(*) > 2 THEN quantile_cont(raw, 0.5) ELSE avg(raw) END, 6) AS x FROM spans s JOIN tones t ON t.song_id = s.song_id AND t.frame >= s.frame AND t.frame < s.stop GROUP BY s.song_id, s.beat, pc""",
    "beat_novelty": f"""WITH {FRAMES}, pairs AS (SELECT a.song_id, a.frame, sum(a.raw * b.raw) / (sqrt(sum(a.raw * a.raw)) * sqrt(sum(b.raw * b.raw))) AS c FROM tones a JOIN tones b ON b.song_id = a.song_id AND b.frame = a.frame - 1 AND b.pc = a.pc GROUP BY a.song_id, a.frame)
      SELECT e.song_id, e.pos AS beat, round(coalesce(0.5 * (1 - c) + 0.5 * CASE WHEN e.k % 12 = p.k % 12 THEN 0 ELSE 1 END, 0), 6) + 0.0::DOUBLE AS novelty FROM ev e LEFT JOIN pairs ON pairs.song_id = e.song_id AND pairs.frame = e.pos LEFT JOIN ev p ON p.song_id = e.song_id AND p.pos = e.pos - 1""",
    "zscore": f"WITH {SERIES} SELECT song_id, beat, round(low_z, 6) AS low_z, round(full_z, 6) AS full_z, round(nov_z, 6) AS nov_z FROM scored",
    "grid_coverage": f"""WITH {EV}, {every()}, points AS (SELECT song_id, frame * 3 AS f FROM grid), onsets AS (SELECT song_id, pos * 3 AS f FROM ev WHERE value * k / 100.0::DOUBLE > 40),
      d AS (SELECT o.song_id, o.f, min(abs(o.f - p.f)) AS d FROM onsets o JOIN points p USING (song_id) GROUP BY o.song_id, o.f)
      SELECT song_id, round(avg(CASE WHEN d <= greatest(1, 0.12 * 15) THEN 1.0 ELSE 0 END), 6) AS coverage FROM d GROUP BY song_id""",
    "tempo_fold": f"WITH {FOLD} SELECT song_id, beat, frame, fold, round(tempo, 6) AS tempo, round(tempo / 2, 6) AS tempo_half, round(tempo * 2, 6) AS tempo_double FROM again JOIN measured USING (song_id)",
    "extend_grid": f"""WITH {SERIES}, own AS (SELECT * FROM beats WHERE beat > 6), gaps AS (SELECT song_id, frame, lead(frame) OVER (PARTITION BY song_id ORDER BY frame) - frame AS g FROM own),
      about AS (SELECT song_id, quantile_cont(g, 0.5) AS iv, min(frame) AS a, max(frame) AS z FROM gaps GROUP BY song_id), sizes AS (SELECT song_id, max(frame) + 70 AS n FROM beats GROUP BY song_id),
      steps AS (SELECT *, unnest(range(1, 60)) AS s FROM about JOIN sizes USING (song_id)),
      extra AS (SELECT song_id, greatest(0, round_even(a - s * iv, 0)) AS frame FROM steps WHERE a - s * iv >= -0.25 * iv UNION ALL SELECT song_id, round_even(z + s * iv, 0) FROM steps WHERE z + s * iv <= n - 1 - 0.25 * iv UNION ALL SELECT song_id, frame FROM own)
      SELECT song_id, row_number() OVER (PARTITION BY song_id ORDER BY frame) - 1 AS beat, CAST(frame AS INT) AS frame FROM extra""",
    "tempo_stability": f"WITH {SERIES}, g AS (SELECT song_id, lead(time) OVER (PARTITION BY song_id ORDER BY beat) - time AS g FROM beats) SELECT song_id, round(stddev_pop(g) / avg(g), 6) AS stability FROM g GROUP BY song_id",
    "triplet_feel": f"""WITH {EV}, {every(7)}, spans AS (SELECT song_id, frame, lead(frame) OVER (PARTITION BY song_id ORDER BY beat) - frame AS span FROM grid),
      points AS (SELECT song_id, unnest(['third', 'third', 'half']) AS kind, unnest([frame + floor(span / 3.0), frame + floor(span * 2 / 3.0), frame + floor(span / 2.0)]) AS at FROM spans WHERE span >= 6),
      peak AS (SELECT song_id, pos, max(value) OVER (PARTITION BY song_id ORDER BY pos RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS x FROM ev),
      m AS (SELECT p.song_id, avg(x) FILTER (kind = 'third') AS a, avg(x) FILTER (kind = 'half') AS b FROM points p JOIN peak ON peak.song_id = p.song_id AND peak.pos = p.at GROUP BY p.song_id)
      SELECT song_id, coalesce(round(CASE WHEN a + b > 0 THEN a / (a + b) ELSE 0 END, 6), 0) AS triplet FROM (SELECT DISTINCT song_id FROM grid) LEFT JOIN m USING (song_id)""",
    "autocorrelation": f"WITH {SERIES}, {acf('low', 'acl')} SELECT song_id, lag, round(acf, 6) AS acf FROM acl",
    "estimate_meter": f"WITH {METER} SELECT song_id, label, bpb, round(confidence, 6) AS confidence, best FROM meter",
    "forced_meter": f"""WITH {METER}, wish AS (SELECT song_id, {pick(("4/4", "5/4", "6/8", "3/4"), "k % 4")} AS wished FROM ev WHERE pos = 0),
      asked AS (SELECT song_id, label, bpb, confidence, CASE WHEN wished IN {tuple(T.METER_BEATS)} THEN wished END AS wished FROM meter JOIN wish USING (song_id))
      SELECT song_id, coalesce(wished, label) AS label, coalesce({look(T.METER_BEATS, "wished")}, bpb) AS bpb, round(confidence, 6) AS confidence, wished IS NOT NULL AS user_forced FROM asked""",
    "downbeat_phase": f"WITH {PHASE} SELECT song_id, bpb, phase FROM tempo",
    "build_bars": f"""WITH {PHASE}, ends AS (SELECT song_id, max(beat) AS last FROM beats GROUP BY song_id),
      starts AS (SELECT b.song_id, (b.beat - phase) // bpb AS index, time AS start, b.beat AS beat_start, least(b.beat + bpb, last) AS beat_end FROM beats b JOIN tempo USING (song_id) JOIN ends USING (song_id) WHERE b.beat >= phase AND (b.beat - phase) % bpb = 0 AND b.beat < last)
      SELECT s.song_id, index, round(start, 6) AS start, round(e.time, 6) AS "end", beat_start, beat_end FROM starts s JOIN beats e ON e.song_id = s.song_id AND e.beat = s.beat_end""",
    "bar_frames": f"""WITH {PHASE}, ends AS (SELECT song_id, max(beat) AS last FROM beats GROUP BY song_id),
      starts AS (SELECT b.song_id, (b.beat - phase) // bpb AS index, frame, least(b.beat + bpb, last) AS beat_end FROM beats b JOIN tempo USING (song_id) JOIN ends USING (song_id) WHERE b.beat >= phase AND (b.beat - phase) % bpb = 0 AND b.beat < last)
      SELECT s.song_id, index, s.frame AS frame_start, e.frame AS frame_end FROM starts s JOIN beats e ON e.song_id = s.song_id AND e.beat = s.beat_end""",
    "harmonic_novelty": f"""WITH {FRAMES}, u AS (SELECT song_id, frame, pc, raw / sqrt(sum(raw * raw) OVER (PARTITION BY song_id, frame)) AS x FROM tones),
      s AS (SELECT song_id, frame, pc, avg(x) OVER b AS b, avg(x) OVER a AS a, frame >= 4 AND frame < n - 4 AS whole FROM u JOIN sizes USING (song_id) WINDOW b AS (PARTITION BY song_id, pc ORDER BY frame ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY song_id, pc ORDER BY frame ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING))
      SELECT song_id, frame, round(CASE WHEN any_value(whole) THEN 1 - sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))) ELSE 0 END, 6) + 0.0::DOUBLE AS novelty FROM s GROUP BY song_id, frame""",
    "chord_template_scores": f"WITH {HEARD} SELECT song_id, beat, round(sum(score * (state + 1)), 4) AS x FROM heard GROUP BY song_id, beat",
    "key_prior": f"WITH {HEARD} SELECT song_id, beat, any_value(key_tonic) AS key_tonic, any_value(key_mode) AS key_mode, round(sum(prior * (state + 1)), 4) AS x FROM heard GROUP BY song_id, beat",
    "chord_emission": f"WITH {HEARD} SELECT song_id, beat, round(sum(emission * (state + 1)), 4) AS x FROM heard GROUP BY song_id, beat",
    "change_probability": f"WITH {HEARD} SELECT DISTINCT song_id, beat, p_change FROM heard",
    "chord_path": f"WITH RECURSIVE {CHORD_PATH} SELECT song_id, beat, state FROM chosen",
    "chord_segments": f"""WITH RECURSIVE {SEGMENTS} SELECT song_id, pos, root_pc, quality, round(start, 6) AS start, round(stop, 6) AS "end", round(stop - start, 6) AS duration, beat_start, beat_end, round(confidence, 6) AS confidence,
      CASE WHEN beat_start >= song_id % 3 THEN (beat_start - song_id % 3) // 4 ELSE -1 END AS bar FROM segments""",
    "spell_chords": f"""WITH RECURSIVE {SEGMENTS}, mid AS (SELECT *, CASE WHEN (start + stop) / 2 < 300 THEN song_id % 12 ELSE (song_id + 7) % 12 END AS key_tonic, CASE WHEN (start + stop) / 2 < 300 THEN 'major' ELSE 'minor' END AS key_mode FROM segments)
      SELECT song_id, pos, {spelled("root_pc", "key_tonic", "key_mode")} AS root, quality, key_tonic, key_mode FROM mid""",
    "chord_accuracy": f"WITH {FOUND} SELECT song_id, round(accuracy, 6) AS accuracy FROM accuracy",
    "regression_report": f"""WITH {FOUND}, f AS (SELECT * FROM ev WHERE pos = 0) SELECT song_id, k % 7 > 0 AND k % 12 = k % 11 AS key_ok, k % 7 > 0 AND abs((k * 1.02::DOUBLE + 60) / (k + 60) - 1) < 0.04 AS tempo_ok, k % 7 > 0 AND k % 2 = 0 AS meter_ok, round(accuracy, 6) AS chord_accuracy FROM f JOIN accuracy USING (song_id)""",
}

_TURN = "list_concat(({0})[t + 1:], ({0})[:t])"
BAR_FEATURES = f"""{FRAMES}, rows AS (SELECT t.song_id, t.frame // 4 AS bar, t.pc, quantile_cont(raw, 0.5) AS c, avg(CASE WHEN pc = k % 12 THEN value ELSE 0 END) AS b FROM tones t JOIN ev e ON e.song_id = t.song_id AND e.pos = t.frame GROUP BY t.song_id, t.frame // 4, t.pc
), bars AS (SELECT song_id, pos // 4 AS bar, CASE WHEN (min(t) + max(t)) / 2 < 300 THEN song_id % 12 ELSE (song_id + 7) % 12 END AS tonic, avg(value) AS rms, {" + ".join(f"avg(value * (k * {i + 1} % 13)) * {i}" for i in range(1, 13))} AS timbre FROM ev GROUP BY song_id, pos // 4
), turned AS (SELECT song_id, bar, (pc - tonic + 12) % 12 AS p, c / coalesce(nullif(sqrt(sum(c * c) OVER w), 0), 1) AS c, b / coalesce(nullif(sqrt(sum(b * b) OVER w), 0), 1) AS b, rms, timbre FROM rows JOIN bars USING (song_id, bar) WINDOW w AS (PARTITION BY song_id, bar))"""

BAR_VECTORS = """own AS (SELECT song_id, row_number() OVER (PARTITION BY song_id ORDER BY vec_id) - 1 AS bar, embedding FROM (SELECT CAST(label + vec_id // 640 * (SELECT max(label) + 1 FROM embeddings) AS INTEGER) AS song_id, vec_id, embedding FROM embeddings)
), placed AS (SELECT *, ([0, 1, 0, 1, 2, 1, 3, 3])[bar // 8 % 8 + 1] * 8 + bar % 8 AS source FROM own
), cells AS (SELECT p.song_id, p.bar, unnest(range(64)) AS i, unnest(p.embedding) AS mine, unnest(coalesce(o.embedding, p.embedding)) AS form FROM placed p LEFT JOIN own o ON o.song_id = p.song_id AND o.bar = p.source
), mixed AS (SELECT song_id, bar, i, CAST(form AS DOUBLE) + CAST(mine AS DOUBLE) * 0.05::DOUBLE AS x FROM cells
), loud AS (SELECT song_id, bar, sqrt(sum(x * x)) AS e FROM mixed WHERE i BETWEEN 36 AND 39 GROUP BY song_id, bar
), harmony AS (SELECT song_id, bar, i, x / sqrt(sum(x * x) OVER (PARTITION BY song_id, bar, i // 12)) * CASE WHEN i >= 12 THEN 0.5::DOUBLE ELSE 1 END AS x FROM mixed WHERE i < 24
), timbre AS (SELECT song_id, bar, i, (x - avg(x) OVER w) / stddev_pop(x) OVER w * 0.2::DOUBLE / sqrt(12) AS x FROM mixed WHERE i BETWEEN 24 AND 35 WINDOW w AS (PARTITION BY song_id, i)
), v AS (SELECT song_id, bar, sum(x * (i + 1)) AS v FROM (SELECT * FROM harmony UNION ALL SELECT * FROM timbre) GROUP BY song_id, bar
), z AS (SELECT song_id, bar, 37 * 0.2::DOUBLE * greatest(-2.5, least(2.5, (e - avg(e) OVER w) / stddev_pop(e) OVER w)) AS z FROM loud WINDOW w AS (PARTITION BY song_id))"""

ORACLES |= {
    "bar_features": f"WITH {BAR_FEATURES} SELECT song_id, bar, round(sum(c * (p + 1)), 4) AS chroma, round(sum(b * (p + 1)), 4) AS bass, round(any_value(timbre), 4) AS timbre, round(any_value(rms), 6) AS rms FROM turned GROUP BY song_id, bar",
    "bar_vectors": f"WITH {BAR_VECTORS} SELECT song_id, bar, round(v, 4) AS v, round(v + z, 4) AS w FROM v JOIN z USING (song_id, bar)",
    "merge_parts": f"""WITH {chords()}, f AS (SELECT *, CASE WHEN root_pc = lag(root_pc) OVER (PARTITION BY song_id ORDER BY pos) THEN 0 ELSE 1 END AS f FROM chords), g AS (SELECT *, sum(f) OVER (PARTITION BY song_id ORDER BY pos) AS g FROM f)
      SELECT song_id, CAST(g - 1 AS INT) AS part, any_value(root_pc) AS cluster, min(pos) * 4 AS a, max(pos) * 4 + 4 AS b, CAST(count(*) AS INT) AS blocks FROM g GROUP BY song_id, g""",
}

ORACLES["refine_pulse"] = f"""WITH {EV}, beats AS (SELECT song_id, pos // 4 AS beat, pos * 10 AS frame FROM ev WHERE pos % 4 = 0), onsets AS (SELECT song_id, pos * 10 AS f FROM ev WHERE value * k / 100.0::DOUBLE > 20),
  about AS (SELECT song_id, max(beat) AS last, quantile_cont(gap, 0.5) AS period FROM (SELECT song_id, beat, frame - lag(frame) OVER (PARTITION BY song_id ORDER BY frame) AS gap FROM beats) GROUP BY song_id),
  places AS (SELECT song_id, period, phase, unnest(range(CAST(ceil((last - phase) / 1.5) AS INT))) AS nth FROM about, (SELECT unnest([0.0::DOUBLE, 0.5, 1.0]) AS phase) WHERE ceil((last - phase) / 1.5) >= 8),
  spots AS (SELECT *, phase + nth * 1.5 AS spot FROM places),
  grid AS (SELECT g.song_id, phase, nth, period, x.frame + (y.frame - x.frame) * (spot - x.beat) AS f FROM spots g JOIN beats x ON x.song_id = g.song_id AND x.beat = floor(spot) JOIN beats y ON y.song_id = g.song_id AND y.beat = ceil(spot)),
  wide AS (SELECT song_id, phase, avg(CASE WHEN d <= greatest(1, 0.12::DOUBLE * 1.5 * period) THEN 1 ELSE 0 END) AS share FROM (SELECT o.song_id, phase, o.f, any_value(period) AS period, min(abs(o.f - g.f)) AS d FROM onsets o JOIN grid g USING (song_id) GROUP BY o.song_id, phase, o.f) GROUP BY song_id, phase),
  base AS (SELECT song_id, avg(CASE WHEN d <= greatest(1, 0.12::DOUBLE * period) THEN 1 ELSE 0 END) AS share FROM (SELECT o.song_id, o.f, min(abs(o.f - b.frame)) AS d FROM onsets o JOIN beats b USING (song_id) GROUP BY o.song_id, o.f) JOIN about USING (song_id) GROUP BY song_id),
  best AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY share DESC, phase) AS nth FROM wide), better AS (SELECT b.song_id, b.phase FROM best b JOIN base ON base.song_id = b.song_id WHERE nth = 1 AND b.share >= base.share + 0.1::DOUBLE)
  SELECT song_id, CAST(beat AS INT) AS beat, CAST(frame AS INT) AS frame, false AS regridded FROM beats WHERE song_id NOT IN (SELECT song_id FROM better)
  UNION ALL SELECT g.song_id, CAST(nth AS INT), CAST(round_even(f, 0) AS INT), true FROM grid g JOIN better USING (song_id, phase)"""

#: Parts, bars and lines of the queries that name and list parts.
PLAIN = f"""{sequence()}, coarse AS (SELECT song_id, pos, CASE WHEN pos < 9 THEN root_pc ELSE pos // 9 % 3 END AS c FROM chords
), turns AS (SELECT *, CASE WHEN c = lag(c) OVER (PARTITION BY song_id ORDER BY pos) THEN 0 ELSE 1 END AS turn FROM coarse
), counted AS (SELECT *, sum(turn) OVER (PARTITION BY song_id ORDER BY pos) AS g FROM turns
), joint AS (SELECT song_id, CAST(g - 1 AS INT) AS part, any_value(c) AS c, min(pos) * 4 AS a, max(pos) * 4 + 4 AS b, CAST(count(*) AS INT) AS blocks FROM counted GROUP BY song_id, g
), seen AS (SELECT *, min(part) OVER (PARTITION BY song_id, c) AS first FROM joint
), parts AS (SELECT song_id, part, dense_rank() OVER (PARTITION BY song_id ORDER BY first) - 1 AS cluster, a, b, blocks FROM seen
), lines AS (SELECT song_id, pos * 4 AS la, pos * 4 + 4 AS lb, CASE WHEN pos % 4 < 3 THEN 0 ELSE k % 3 END AS line FROM ev
), loud AS (SELECT p.song_id, part, any_value(cluster) AS cluster, avg(value * (k % 5 + 1)) AS energy FROM parts p JOIN ev e ON e.song_id = p.song_id AND e.pos * 4 >= a AND e.pos * 4 < b GROUP BY p.song_id, part
), totals AS (SELECT song_id, count(*) * 4 AS n FROM ev GROUP BY song_id
), stats AS (
  SELECT p.song_id, p.cluster, count(*) AS times, avg(energy) AS energy, min(part) AS first, min(b - a) AS size, avg((a + b) / 2) AS middle, any_value(n) AS n, any_value(last) AS last
  FROM parts p JOIN loud USING (song_id, part) JOIN totals USING (song_id) JOIN (SELECT song_id, max(part) AS last FROM parts GROUP BY song_id) USING (song_id) GROUP BY p.song_id, p.cluster
), ended AS (
  SELECT *, CASE WHEN times = 1 AND last >= 2 AND first = 0 AND size <= greatest(8, 0.2::DOUBLE * n) THEN 'Intro' WHEN times = 1 AND last >= 2 AND first = last AND size <= greatest(12, 0.2::DOUBLE * n) THEN 'Outro' END AS edge FROM stats
), sorted AS (SELECT *, edge IS NULL AND times >= 2 AS again, edge IS NULL AND times = 1 AND middle / n BETWEEN 0.4::DOUBLE AND 0.9::DOUBLE AS fits FROM ended
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY song_id, again ORDER BY energy DESC, cluster) AS loudness, row_number() OVER (PARTITION BY song_id, fits ORDER BY abs(middle / n - 0.7::DOUBLE), cluster) AS nearness,
    again AND count(*) OVER w >= 2 AND max(energy) OVER w > 1.05::DOUBLE * min(energy) OVER w AS clear FROM sorted WINDOW w AS (PARTITION BY song_id, again)
), called AS (SELECT song_id, cluster, CASE WHEN edge IS NOT NULL THEN edge WHEN clear AND loudness = 1 THEN 'Chorus' WHEN clear AND loudness = 2 THEN 'Verse' WHEN fits AND nearness = 1 THEN 'Bridge' ELSE 'Section ' || chr(CAST(65 + cluster % 26 AS INT)) END AS name FROM ranked
), shares AS (SELECT song_id, part, max(n) / sum(n) AS share FROM (SELECT p.song_id, part, line, count(*) AS n FROM parts p JOIN lines l ON l.song_id = p.song_id AND la >= a AND lb <= b GROUP BY p.song_id, part, line) GROUP BY song_id, part
), vamps AS (SELECT song_id, cluster, count(*) OVER (PARTITION BY song_id) AS of FROM (SELECT song_id, cluster FROM parts LEFT JOIN shares USING (song_id, part) GROUP BY song_id, cluster HAVING bool_and(b - a >= 16 AND coalesce(share, 0) >= 0.7::DOUBLE))
), named AS (
  SELECT p.*, coalesce(CASE WHEN v.of = 1 THEN 'Vamp' ELSE 'Vamp ' || chr(CAST(65 + v.cluster % 26 AS INT)) END, c.name) AS name FROM parts p JOIN called c USING (song_id, cluster) LEFT JOIN vamps v USING (song_id, cluster)
), numbered AS (SELECT *, chr(CAST(65 + cluster % 26 AS INT)) AS label, row_number() OVER (PARTITION BY song_id, cluster ORDER BY part) AS instance, count(*) OVER (PARTITION BY song_id, cluster) AS of FROM named
), said AS (SELECT n.song_id, part, string_agg(chord, ' ' ORDER BY pos) AS chords, string_agg(nashville, ' ' ORDER BY pos) AS nashville FROM numbered n JOIN seq s ON s.song_id = n.song_id AND s.pos * 8 >= a * 2 AND s.pos * 8 < b * 2 GROUP BY n.song_id, part
), spelt AS (SELECT p.song_id, part, string_agg(chr(CAST(97 + line % 26 AS INT)), ' ' ORDER BY la) AS lines FROM parts p JOIN lines l ON l.song_id = p.song_id AND la >= a AND lb <= b GROUP BY p.song_id, part
), sections AS (
  SELECT n.*, a * 2.0::DOUBLE AS start, b * 2.0::DOUBLE AS stop, coalesce(chords, '') AS chords, coalesce(nashville, '') AS nashville, coalesce(s.lines, '') AS lines FROM numbered n LEFT JOIN said USING (song_id, part) LEFT JOIN spelt s USING (song_id, part))"""

ORACLES |= {
    "name_parts": f"WITH {PLAIN} SELECT song_id, part, cluster, a, b, blocks, name FROM parts JOIN called USING (song_id, cluster)",
    "name_vamps": f"WITH {PLAIN} SELECT song_id, part, cluster, name FROM named",
    "sections": f'WITH {PLAIN} SELECT song_id, part, label, name, instance, of, start, stop AS "end", chords, nashville, lines FROM sections',
    "structure_repeats": f"""WITH {PLAIN} SELECT song_id, any_value(label) AS label, any_value(name) AS name, count(*) AS occurrences, CAST(count(*) AS INT) AS n, first(chords ORDER BY part) AS chords, round(round(avg(energy), 4), 3) AS loudness
      FROM sections JOIN (SELECT song_id, part, energy FROM loud) USING (song_id, part) GROUP BY song_id, cluster HAVING count(*) >= 2""",
    "line_repeats": f"""WITH {PLAIN}, placed AS (SELECT l.*, coalesce(label || instance, '-') AS p FROM lines l LEFT JOIN sections s ON s.song_id = l.song_id AND la >= a AND la < b),
      again AS (SELECT song_id, line, count(*) AS occurrences, min(la) AS la, string_agg(la || ':' || p, ' ' ORDER BY la) AS places FROM placed GROUP BY song_id, line HAVING count(*) >= 2),
      heard AS (SELECT g.song_id, line, string_agg(chord, ' ' ORDER BY pos) AS chords, string_agg(nashville, ' ' ORDER BY pos) AS nashville FROM again g JOIN seq s ON s.song_id = g.song_id AND s.pos * 8 >= la * 2 AND s.pos * 8 < la * 2 + 8 GROUP BY g.song_id, line)
      SELECT song_id, line, occurrences, 4 AS bars, coalesce(chords, '') AS chords, coalesce(nashville, '') AS nashville, places FROM again LEFT JOIN heard USING (song_id, line)""",
    "form_string": f"WITH {PLAIN} SELECT song_id, string_agg(CASE WHEN name LIKE 'Section %' THEN label ELSE name END, ' - ' ORDER BY part) AS form, string_agg(label, ' ' ORDER BY part) AS letters FROM sections GROUP BY song_id",
}

ORACLES["song_document"] = f"""WITH {PATTERNS}, kept AS (SELECT * FROM patterns p WHERE NOT EXISTS (SELECT 1 FROM patterns q WHERE q.song_id = p.song_id AND q.length > p.length AND contains(' ' || q.pattern || ' ', ' ' || p.pattern || ' '))),
  n AS (SELECT song_id, CAST(count(*) AS INT) AS n FROM kept GROUP BY song_id), c AS (SELECT song_id, CAST(count(*) AS INT) AS n_chords, string_agg(chord, ' ' ORDER BY pos) AS chords FROM seq GROUP BY song_id)
  SELECT song_id, n_chords, coalesce(n, 0) AS n_patterns, chords FROM c LEFT JOIN n USING (song_id)"""

#: Columns that the queries return as 32-bit integers.
_SIDE = """SELECT song_id, arg_max(root_pc, {{'duration': duration, 'pos': pos}}) AS tonic, count(*) * 1.5::DOUBLE AS bpm, CASE WHEN count(*) FILTER (quality = 'minor') % 2 = 0 THEN '4/4' ELSE '3/4' END AS meter,
  string_agg(root, ' - ' ORDER BY pos) FILTER (pos % 8 = 0) AS form, CAST(count(*) FILTER (pos % 8 = 0) AS INT) AS n_sections FROM {0} GROUP BY song_id"""
ORACLES["regression_values"] = f"""WITH {chords()}, read AS (SELECT *, stop - start AS duration FROM chords), {chords(True).removeprefix(EV).removeprefix(", ").replace("raw AS", "wide_raw AS").replace("FROM raw", "FROM wide_raw").replace("chords AS", "wide_chords AS")},
  played AS (SELECT *, stop - start AS duration FROM wide_chords), f AS ({_SIDE.format("read")}), t AS ({_SIDE.format("played")}),
  laps AS (SELECT p.song_id, least(p.stop, r.stop) - greatest(p.start, r.start) AS d, p.root_pc = r.root_pc AND starts_with(p.quality, 'min') = starts_with(r.quality, 'min') AS ok FROM played p JOIN read r ON p.song_id = r.song_id AND r.start < p.stop AND p.start < r.stop),
  acc AS (SELECT song_id, sum(d) FILTER (ok) / sum(d) AS accuracy FROM laps GROUP BY song_id HAVING sum(d) > 0)
  SELECT t.song_id, coalesce(f.tonic = t.tonic, false) AS key_ok, coalesce(abs(f.bpm / t.bpm - 1) < 0.04, false) AS tempo_ok, coalesce(f.meter = t.meter, false) AS meter_ok, round(coalesce(accuracy, 0), 6) AS chord_accuracy,
    f.tonic AS found_tonic, f.bpm AS found_bpm, f.meter AS found_meter, f.form AS found_form, f.n_sections AS found_n_sections, t.tonic AS true_tonic, t.bpm AS true_bpm, t.meter AS true_meter, t.form AS true_form, t.n_sections AS true_n_sections
  FROM t LEFT JOIN f ON f.song_id = t.song_id AND f.song_id % 7 > 0 LEFT JOIN acc ON acc.song_id = t.song_id"""
#: All 28 tilings of every song's bars.
TILINGS = f"""{BAR_VECTORS}, f AS (SELECT * FROM harmony UNION ALL SELECT * FROM timbre), dots AS (SELECT a.song_id, a.bar AS p, b.bar AS q, sum(a.x * b.x) AS d FROM f a JOIN f b ON a.song_id = b.song_id AND a.i = b.i GROUP BY ALL),
  counts AS (SELECT song_id, max(bar) + 1 AS n FROM f GROUP BY song_id HAVING max(bar) >= 7),
  blocks AS (SELECT song_id, len, o, unnest(range(o, n - len + 1, len)) AS s FROM counts, (SELECT len, unnest(range(len)) AS o FROM (SELECT unnest([8, 4, 16]) AS len))),
  pairs AS (SELECT x.song_id, x.len, x.o, x.s, y.s AS t, sum(d) AS d FROM blocks x JOIN blocks y ON x.song_id = y.song_id AND x.len = y.len AND x.o = y.o JOIN dots ON dots.song_id = x.song_id AND p >= x.s AND p < x.s + x.len AND q = p - x.s + y.s GROUP BY ALL),
  norms AS (SELECT song_id, len, o, s, sqrt(d) AS r FROM pairs WHERE s = t),
  best_of AS (SELECT p.song_id, p.len, p.o, p.s, max(CASE WHEN p.s = p.t THEN -1 ELSE p.d / (a.r * b.r) END) AS m FROM pairs p JOIN norms a ON a.song_id = p.song_id AND a.len = p.len AND a.o = p.o AND a.s = p.s JOIN norms b ON b.song_id = p.song_id AND b.len = p.len AND b.o = p.o AND b.s = p.t GROUP BY ALL),
  scores AS (SELECT song_id, len, o, avg(m) - 0.002::DOUBLE * o AS score FROM best_of GROUP BY song_id, len, o HAVING count(*) >= 3),
  by_len AS (SELECT * FROM scores WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY song_id, len ORDER BY score DESC, o) = 1),
  tiling AS (SELECT * FROM (SELECT *, max(score) OVER (PARTITION BY song_id) AS top FROM by_len) QUALIFY row_number() OVER (PARTITION BY song_id ORDER BY len = 8 AND score >= top - 0.05 DESC, score DESC, list_position([8, 4, 16], len)) = 1)"""
ORACLES["choose_tiling"] = f"WITH {TILINGS} SELECT song_id, CAST(len AS INTEGER) AS length, CAST(o AS INTEGER) AS offset, round(score, 6) AS score FROM tiling"
ORACLES["attach_fragments"] = f"""WITH {BAR_VECTORS}, w AS (SELECT * FROM harmony UNION ALL SELECT * FROM timbre UNION ALL SELECT song_id, bar, 36, z / 37 FROM z),
  counts AS (SELECT song_id, max(bar) + 1 AS n FROM w GROUP BY song_id), full_ AS (SELECT song_id, unnest(range(song_id % 8, n - 7, 8)) AS a FROM counts), edge AS (SELECT song_id, min(a) AS lo, max(a) + 8 AS hi, max(a // 8) AS top, n FROM full_ JOIN counts USING (song_id) GROUP BY song_id, n),
  ends AS (SELECT song_id, 0 AS a, lo AS b, top + 1 AS c, 1 AS nth FROM edge WHERE lo > 0 UNION ALL SELECT song_id, hi, n, top + 2, 2 FROM edge WHERE hi < n),
  alike AS (SELECT e.song_id, e.nth, f.a, sum(x.x * y.x) / (sqrt(sum(x.x * x.x)) * sqrt(sum(y.x * y.x))) AS s FROM ends e JOIN full_ f USING (song_id) JOIN w x ON x.song_id = e.song_id AND x.bar >= e.a AND x.bar < e.b JOIN w y ON y.song_id = f.song_id AND y.bar = x.bar - e.a + f.a AND y.i = x.i WHERE e.b - e.a >= 6 GROUP BY ALL),
  near AS (SELECT * FROM alike WHERE s >= 0.80 QUALIFY row_number() OVER (PARTITION BY song_id, nth ORDER BY s DESC, a) = 1),
  everything AS (SELECT song_id, a, a + 8 AS b, a // 8 AS c FROM full_ UNION ALL SELECT e.song_id, e.a, e.b, coalesce(near.a // 8, e.c) FROM ends e LEFT JOIN near USING (song_id, nth)),
  named AS (SELECT *, min(a) OVER (PARTITION BY song_id, c) AS begins FROM everything)
  SELECT song_id, CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, CAST(dense_rank() OVER (PARTITION BY song_id ORDER BY begins) - 1 AS INTEGER) AS cluster, 8 AS length FROM named"""
#: Bar lengths by a direct sum over all lags, frames of a fifth of a second: 59 of them.
PERIODS = f"""{FRAMES}, u AS (SELECT song_id, frame, pc, raw / sqrt(sum(raw * raw) OVER (PARTITION BY song_id, frame)) AS x FROM tones),
  s AS (SELECT song_id, frame, pc, avg(x) OVER b AS b, avg(x) OVER a AS a, frame >= 2 AND frame < n - 2 AS whole FROM u JOIN sizes USING (song_id) WINDOW b AS (PARTITION BY song_id, pc ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY song_id, pc ORDER BY frame ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING)),
  nov AS (SELECT song_id, frame AS pos, CASE WHEN any_value(whole) THEN 1 - sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))) ELSE 0 END AS nov FROM s GROUP BY song_id, frame),
  three AS (SELECT song_id, pos, value * k / 100.0::DOUBLE AS low, value AS onset, nov FROM ev JOIN nov USING (song_id, pos)),
  zs AS (SELECT song_id, pos, (low - avg(low) OVER w) / stddev_pop(low) OVER w + (onset - avg(onset) OVER w) / stddev_pop(onset) OVER w AS accent, accent + 2 * (nov - avg(nov) OVER w) / stddev_pop(nov) OVER w AS every FROM three WINDOW w AS (PARTITION BY song_id)),
  sums AS (SELECT a.song_id, b.pos - a.pos AS lag, sum(a.every * b.every) AS e, sum(a.accent * b.accent) AS c FROM zs a JOIN zs b ON a.song_id = b.song_id AND b.pos BETWEEN a.pos AND a.pos + 58 GROUP BY ALL),
  acs AS (SELECT song_id, lag, e / first(e) OVER w AS ac, c / first(c) OVER w AS accent FROM sums WINDOW w AS (PARTITION BY song_id ORDER BY lag)),
  tops AS (SELECT song_id, lag, ac FROM (SELECT *, lag(ac) OVER w AS l, lead(ac) OVER w AS r FROM acs WINDOW w AS (PARTITION BY song_id ORDER BY lag)) WHERE ac > l AND ac > r AND lag * 0.2::DOUBLE BETWEEN 1.4 AND 9),
  best AS (SELECT song_id, min(lag) AS lag FROM (SELECT *, max(ac) OVER (PARTITION BY song_id) AS top FROM tops) WHERE top > 0 AND ac >= 0.85::DOUBLE * top GROUP BY song_id),
  periods AS (SELECT s.song_id, b.lag * 0.2::DOUBLE AS bar_s, coalesce(a.ac, 0) AS strength FROM (SELECT DISTINCT song_id FROM acs) s LEFT JOIN best b USING (song_id) LEFT JOIN acs a ON a.song_id = b.song_id AND a.lag = b.lag)"""
ORACLES["bar_period"] = f"WITH {PERIODS} SELECT song_id, round(bar_s, 6) AS bar_s, round(strength, 6) AS strength FROM periods"

_AROUND = "coalesce((SELECT max(accent) FROM acs WHERE acs.song_id = h.song_id AND acs.lag BETWEEN CAST(round_even(q * {0} / 0.2::DOUBLE * 0.97::DOUBLE, 0) AS INT) AND CAST(round_even(q * {0} / 0.2::DOUBLE * 1.03::DOUBLE, 0) AS INT)), 0)"
#: The bars of build_bars against the periods; {0}: songs that may be rescued.
HYPOTHESES = f"""{PHASE}, {PERIODS.removeprefix(EV).removeprefix(", ")}, lasts AS (SELECT song_id, max(beat) AS last FROM beats GROUP BY song_id),
  starts AS (SELECT b.song_id, time AS start, least(b.beat + bpb, last) AS stop FROM beats b JOIN tempo USING (song_id) JOIN lasts USING (song_id) WHERE b.beat >= phase AND (b.beat - phase) % bpb = 0 AND b.beat < last),
  tracked AS (SELECT s.song_id, quantile_cont(e.time - s.start, 0.5) AS tracked_s FROM starts s JOIN beats e ON e.song_id = s.song_id AND e.beat = s.stop GROUP BY s.song_id HAVING count(*) > 2),
  odd AS (SELECT * FROM periods JOIN tracked USING (song_id) WHERE strength >= 0.18 AND bar_s IS NOT NULL AND list_min([abs(bar_s / tracked_s / t - 1) FOR t IN [1.0::DOUBLE, 2, 0.5, 4, 0.25]]) >= 0.07),
  h AS (SELECT song_id, bar_s / 4 AS q, 4 AS bpb, '4/4' AS label FROM odd UNION ALL SELECT song_id, bar_s / 3, 3, '3/4' FROM odd),
  guesses AS (SELECT song_id, bpb, label, 60 / q AS bpm, CASE bpb WHEN 4 THEN ({_AROUND.format(1)} + {_AROUND.format(2)} + {_AROUND.format(3)}) / 3 ELSE ({_AROUND.format(1)} + {_AROUND.format(2)}) / 2 * 0.85::DOUBLE END AS score FROM h WHERE q BETWEEN 0.40 AND 1.20),
  hypotheses AS (SELECT song_id, label, bpb, bpm, score / total AS share FROM (SELECT *, sum(greatest(score, 1e-6::DOUBLE)) OVER (PARTITION BY song_id) AS total, row_number() OVER (PARTITION BY song_id ORDER BY score DESC, bpb DESC) AS nth FROM guesses) WHERE nth = 1)"""
ORACLES["rescue_meter"] = f"WITH {HYPOTHESES} SELECT song_id, label, bpb, round(bpm, 6) AS bpm, round(share, 6) AS share FROM hypotheses WHERE song_id NOT IN (SELECT song_id FROM ev WHERE pos = 0 AND k % 5 = 0)"
GRIDS = """grids AS (SELECT song_id, pos // n AS beat, pos AS frame, 60.0::DOUBLE + 40 * n + song_id % 7 AS bpm_hint FROM ev, (SELECT unnest([1, 2, 3]) AS n) WHERE pos % n = 0
  UNION ALL SELECT song_id, pos // 5, pos, NULL FROM ev WHERE song_id % 2 = 0 AND pos % 5 = 0)"""
ORACLES["usual_grids"] = f"WITH {EV}, {GRIDS} SELECT song_id, beat, frame, coalesce(bpm_hint, 0) AS bpm_hint FROM grids QUALIFY rank() OVER (PARTITION BY song_id ORDER BY bpm_hint IS NOT NULL, abs(bpm_hint - 100), bpm_hint) = 1"
ORACLES["rescued_grids"] = f"WITH {HYPOTHESES}, {GRIDS} SELECT song_id, beat, frame, bpm_hint FROM grids JOIN hypotheses USING (song_id) WHERE abs(bpm_hint / bpm - 1) <= 0.07 QUALIFY rank() OVER (PARTITION BY song_id ORDER BY abs(bpm_hint / bpm - 1), bpm_hint) = 1"
ORACLES["rejected_songs"] = f"""WITH {EV}, grid AS (SELECT song_id, count(*) AS beats, quantile_cont(gap, 0.5) AS median FROM (SELECT song_id, lead(f) OVER (PARTITION BY song_id ORDER BY pos) - f AS gap FROM (SELECT song_id, pos, CASE WHEN song_id % 4 = 1 THEN 7 ELSE pos END AS f FROM ev WHERE k % (1 + song_id % 11) = 0)) GROUP BY song_id),
  rows AS (SELECT coalesce(f.song_id, g.song_id) AS song_id, coalesce(beats, 0) AS beats, CASE WHEN f.song_id IS NULL THEN 'no frames' WHEN coalesce(beats, 0) < 8 THEN 'no steady beat' WHEN median <= 0 THEN 'beats share a frame' END AS reason FROM (SELECT DISTINCT song_id FROM ev WHERE song_id % 9 > 0) f FULL JOIN grid g ON f.song_id = g.song_id)
  SELECT song_id, reason, beats FROM rows WHERE reason IS NOT NULL"""

_INTEGERS = {
    "maximal_patterns": ("length",), "repeated_patterns": ("length",), "key_chord_evidence": ("tonic",), "name_parts": ("cluster",), "name_vamps": ("cluster",), "sections": ("instance",), "key_candidates": ("tonic", "rank"), "key_windows": ("win", "pc"), "region_scores": ("win", "pc"), "key_runner_up": ("tonic",), "endpoint_evidence": ("tonic",), "refine_key_mode": ("tonic",),
    "beat_chroma": ("pc",), "tempo_fold": ("beat", "frame"), "extend_grid": ("beat",), "key_prior": ("key_tonic",), "chord_segments": ("bar",), "spell_chords": ("key_tonic",), "bar_vectors": ("bar",),
}
for _name, _columns in _INTEGERS.items():
    ORACLES[_name] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS INTEGER) AS {c}' for c in _columns)}) FROM ({ORACLES[_name]})"
