"""Toxicity by multiple-instance learning: cutting and scoring against plain versions, planted sentences, held-out rows."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from cadenza.llm.common import utf8
from cadenza.llm.toxicity import SENTENCE_WORDS, STEPS, cut_sentences, fit, fold, score_toxicity, softplus

WORD = re.compile(r"[A-Za-z\x80-\U0010ffff]+")


def sentences_by_hand(text):
    """Start and end of each sentence."""
    cuts = {0} | {m.end() for m in re.finditer(r"\n|[.!?](?=[ \t\n\x0b\x0c\r])", text)}
    out = []
    for low, high in zip(sorted(cuts), [*sorted(cuts)[1:], len(text)]):
        words = [m.start() + low for m in WORD.finditer(text[low:high])]
        edges = [low, *words[SENTENCE_WORDS::SENTENCE_WORDS], high]
        out += [(a, b) for a, b in zip(edges, edges[1:]) if a < b]
    return out


def test_sentences():
    rng = random.Random(1)
    part = lambda: rng.choice(["word", "été", ".", "! ", "?\n", "\n", " ", "3.5", "a b ", "\t", "x" * 9, "... "])
    texts = ["", "a", "\n", ". ", "w " * 200, *("".join(part() for _ in range(rng.randrange(30))) for _ in range(300))]
    data, offsets = utf8(pa.array(texts))
    start, end, sentence, begins, ends = cut_sentences(data, offsets)
    raw = data.tobytes()
    want = [t[a:b].encode() for t in texts for a, b in sentences_by_hand(t)]
    assert [raw[a:b] for a, b in zip(begins, ends)] == want
    words = [(k, w.encode()) for k, s in enumerate(x.decode() for x in want) for w in WORD.findall(s)]
    assert [(k, raw[a:b]) for k, a, b in zip(sentence, start, end)] == words


def test_fit_finds_the_sentence_that_explains_the_label():
    rng = np.random.default_rng(2)
    n = 400  # every document has 20 plain sentences and 3 with one of six features; feature 0 makes it toxic
    feature = rng.integers(0, 6, 3 * n)
    doc = np.repeat(np.arange(n), 3)
    toxic = (np.bincount(doc, weights=feature == 0, minlength=n) > 0).astype(np.int64)
    model = fit(np.arange(6), toxic, np.full(n, 20.0), doc, np.arange(3 * n), feature)
    p = 1 / (1 + np.exp(-model.base - model.weights))
    assert STEPS and p[0] > 0.9 and p[1:].max() < 0.05 and 20 * softplus(np.array(model.base)) < 0.05


def planted(n, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    rows, labels, spans = [], [], {}
    for k in range(n):
        said = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 12))).capitalize() + "." for _ in range(rng.randint(2, 12))]
        toxic = rng.random() < 0.3
        if toxic:
            at = rng.randrange(len(said))
            said[at] = said[at][:-1] + f" {rng.choice(['Vilest', 'scoundrel', 'scoundrels', 'ÉGOUT'])}."
            start = sum(len(s) + 1 for s in said[:at])
            spans[k] = (max(0, start), start + len(said[at]))
        rows.append((k, " ".join(said))), labels.append((k, 1, int(toxic)))
    return rows, labels, spans


def test_planted_sentences(spark):
    rows, labels, spans = planted(900)
    odd = [(5000, None), (5001, ""), (5002, "scoundrel " * 30000), (5003, "word " * 60000), (None, "a scoundrel"), (1, rows[1][1]), (5004, "éİ. Égout!")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string").selectExpr("*", "'x' as id", "1 as y", "2 as score")
    marks = spark.createDataFrame(labels + [(5000, 1, 1), (5001, None, None), (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = score_toxicity(docs, marks).collect()
    assert len(got) == len(rows) + len(odd)
    by = {(r["doc_id"], r["text"]): r for r in got}
    for k, t in rows:
        r = by[k, t]
        assert r["predicted"] == (k in spans) and [(s["start"], s["end"]) for s in r["offending"] if s["start"] >= 0] == ([(spans[k][0] - (spans[k][0] > 0), spans[k][1])] if k in spans else []), k
        assert r["held_out"] == (fold_of(k) == 0) and 0 <= r["score"] <= 1
    assert by[5000, None]["score"] == 0 == by[5001, ""]["score"] and by[5002, odd[2][1]]["predicted"] == 1 == by[5004, odd[6][1]]["predicted"]
    assert by[5003, odd[3][1]]["offending"] == [] and by[5004, odd[6][1]]["offending"][-1]["end"] == 10
    assert score_toxicity(docs.limit(0), marks).count() == 0
    assert {r["score"] > 0.5 for r in score_toxicity(docs.limit(5), marks.limit(0)).collect()} == {False}


def fold_of(k):
    import zlib

    return zlib.crc32(str(k).encode()) % 5


@pytest.mark.parametrize("column", ["toxic"])
def test_held_out_rows(spark, column):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    held = score_toxicity(docs.join(labels, "doc_id", "left_semi"), labels).where("held_out").select("doc_id", "predicted").join(labels, "doc_id")
    n = {(r["predicted"], r[column]): r["count"] for r in held.groupBy("predicted", column).count().collect()}
    assert n[1, 1] >= 0.88 * (n[1, 1] + n[0, 1]) and n[1, 0] <= 0.02 * (n[1, 0] + n[0, 0])
    assert held.where(fold("doc_id") != 0).isEmpty()
