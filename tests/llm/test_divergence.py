"""Divergence of sources against its SQL, with few and with many tiles and blocks."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import cadenza.llm.divergence as module
from cadenza.llm.divergence import divergence, term_counts
from cadenza.llm.queries import ORACLES

COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def made_documents():
    rng = random.Random(3)
    words = ["the", "The,", "THE.", "été", "Été", "don't", "a1b", "x y", "\U0001d4d0b", "###", "12", "", "naïve-co", *(f"w{chr(97 + k)}" for k in range(20))]
    rows = []
    for k in range(400):
        lang, source = rng.choice(["en", "en", "de", None]), rng.choice(["hot"] * 5 + ["a", "b", "c", "d", None, ""])
        rows.append((k, rng.choice([" ", "\n", "\t\x0b", "  "]).join(rng.choice(words[k % 7 :]) for _ in range(rng.randrange(12))), lang, source))
    rows += [(500, None, "en", "empty"), (501, "", "en", "bare"), (502, "few words here", "fr", "a"), (503, "few words", "fr", "b"), (504, "alone", "it", "a")]
    rows += [(505, "copy of the words", "en", "a")] * 12 + [(None, "the " * 5000, "en", "long"), (506, "q" * 50000, "en", "long")]
    return rows


def by_sql(rows):
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", rows) if rows else None
    return sorted(con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLES['op12_source_divergence']})").fetchall())


def found(frame):
    return sorted(tuple(r[c] for c in COLUMNS) for r in divergence(frame).collect())


@pytest.mark.parametrize("sizes", [None, {"TILE_SOURCES": 2, "TILE_TERMS": 3, "BLOCK_BYTES": 500}])
def test_divergence_against_sql(spark, monkeypatch, sizes):
    for name, value in (sizes or {}).items():
        monkeypatch.setattr(module, name, value)
    rows = made_documents()
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3).selectExpr("*", "'x' as term", "1 as block", "2 as count")
    want = by_sql(rows)
    assert found(frame) == want
    assert {("fr", "a", "pair", "b", 0, 1)} <= set(want) and not [r for r in want if r[0] == "it"]


def test_counts_of_terms(spark):
    frame = spark.createDataFrame([(1, "The the, THE-the x", "en", "s"), (2, "the", "en", "s"), (2, "the", "en", "s")], "doc_id long, text string, lang string, source string")
    got = {(r["term"], r["count"], r["documents"]) for r in term_counts(frame).collect()}
    assert got == {("the", 6, 3), ("x", 1, 1)}


def test_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert found(frame) == [] and divergence(frame).columns == COLUMNS


def test_counts_beyond_64_bits(spark):
    row = spark.range(1).selectExpr("4000000000000L as c", "9000000000000L as t", "7L as v").select(module.share("c", "t", "v").alias("p")).first()
    assert row["p"] == 1 + 10**9 * (4 * 10**12 + 2) // (9 * 10**12 + 14)


def test_steps_of_a_block_are_whole_terms(monkeypatch):
    rng = random.Random(4)
    texts = [[rng.choice(["a b", "b", "c a c", "d", "e b"]) for _ in range(rng.randrange(1, 9))] for _ in range(60)]
    chunks = sorted({c for t in texts for c in t})
    held = [(k, [t.count(c) for t in texts]) for k, c in enumerate(chunks)]
    docs = [[d for d, n in enumerate(many) if n] for _, many in held]
    packed = {"sizes": [len(d) for d in docs], "docs": [x for d in docs for x in np.diff(d, prepend=0)], "times": [many[d] for (_, many), own in zip(held, docs) for d in own]}
    head = pa.table({**{c: pa.array([module.squeeze(np.array(x))], pa.binary()) for c, x in packed.items()}, "langs": pa.array([["en"] * 60]), "sources": pa.array([[f"s{d % 3}" for d in range(60)]])})
    places = pa.table({"row": pa.array(range(len(chunks)), pa.int32()), "terms": pa.array(chunks)})
    want = sorted(("en", f"s{s}", w, sum(" ".join(t).split().count(w) for t in texts[s::3]), sum(w in " ".join(t).split() for t in texts[s::3])) for s in range(3) for w in "abcde")
    for size in (1, 20, 1 << 19):
        monkeypatch.setattr(module, "STEP_HELD", size)
        assert sorted(tuple(r.values()) for r in module._sum_block(places, head).to_pylist()) == [r for r in want if r[4]]
