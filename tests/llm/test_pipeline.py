"""Each pipeline stage against a plain version, on a small corpus written as tables."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from cadenza.llm.quality_model import score_quality
from tests_llm_helpers import contaminated_words, line_by_hand, near_classes

WORDS = [f"{a}{b}" for a in "ba de fi go ku la me ni po ru sa te".split() for b in "n r st l m ck".split()]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(7)
    text = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))
    items = [(k, text(15)) for k in range(6)]
    rows, labels = [], []
    for k in range(240):
        lines = [text(rng.randint(8, 20)) for _ in range(rng.randint(2, 6))]
        good = rng.random() < 0.8
        body = "\n".join(lines)
        if not good:
            body = re.sub(r"(\w+)", r"\1!!", body.upper())
        elif k % 11 == 0:
            body += "\n" + items[k % 6][1] + " and more"
        rows.append((k, body, "en", "s", len(body)))
        labels.append((k, int(good), 0))
    for k in (3, 5, 8, 13, 21):
        words = rows[k][1].split(" ")
        words[len(words) // 2] = "zzz"
        rows.append((300 + k, " ".join(words), "en", "s", 1))
        rows.append((400 + k, rows[k][1], "de", "s", 2))
    rows += [(900, None, "en", None, None), (901, "", "en", "s", 0)]
    d = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, items, dict(labels_of(labels))


def labels_of(labels):
    return [(d, q) for d, q, _ in labels]


def texts(df):
    return {(r["doc_id"], r["text"]) for r in df.collect()}


def test_stages(spark, corpus):
    d, items, truth = corpus
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "line_dedup", "near_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns

    kept = corpus_pipeline.quality(spark, docs, d).cache()
    scored = {r["doc_id"]: r["predicted"] for r in score_quality(docs, spark.read.parquet(f"{d}/labels.parquet")).collect()}
    assert {r["doc_id"] for r in kept.collect()} == {k for k, p in scored.items() if p == 1} and kept.columns == columns
    assert np.mean([scored[k] == q for k, q in truth.items()]) > 0.95

    lines = corpus_pipeline.lines(spark, kept, d).cache()
    before = [(r["doc_id"], r["text"]) for r in kept.collect()]
    want = {(k, t) for (k, t), (_, old) in zip(line_by_hand(before), before) if not (t == "" and old)}
    assert texts(lines) == want and lines.columns == columns
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect() if r["text"] not in (None, dict(before)[r["doc_id"]]))

    single = corpus_pipeline.near_duplicates(spark, lines, d).cache()
    classes = near_classes([(r["doc_id"], r["text"]) for r in lines.collect()])
    assert {r["doc_id"] for r in single.collect()} == {k for k, c in classes if k == c} and single.columns == columns

    clean = corpus_pipeline.decontamination(spark, single, d).cache()
    hits = contaminated_words([(r["doc_id"], r["text"]) for r in single.collect()], items)
    old = dict(texts(single))
    assert sum(hits.values()) > 0 and clean.columns == columns
    for k, t in texts(clean):
        assert (t == old[k]) == (hits[k] == 0)
    assert sum(contaminated_words(list(texts(clean)), items).values()) == 0

    pieces = corpus_pipeline.packing(spark, clean, d).collect()
    assert {r["doc_id"] for r in pieces} == {k for k, _ in texts(clean)}
    assert sum(r["length"] for r in pieces) == sum({r["doc_id"]: r["doc_tokens"] for r in pieces}.values())


def test_run(spark, corpus):
    assert corpus_pipeline.run(spark, corpus[0]).count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_edges(spark, corpus):
    """Nulls anywhere, empty and very long texts, repeated rows, columns of clashing names, empty tables."""
    d, items, _ = corpus
    rng = random.Random(9)
    long = " ".join(rng.choice(WORDS) + str(rng.randrange(10**6)) for _ in range(60_000))
    one = " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(40))
    rows = [(1, long), (2, one), (2, one), (2, one + " tail"), (None, one + " other"), (3, None), (3, None), (4, ""), (5, "\n\n"), (6, items[0][1] + " " + one[::-1])]
    docs = spark.createDataFrame([(k, t, None, None, None, 1, "x", 2.0, 3) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long, tie int, node string, key double, label int")
    before = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d).cache()
        before[name] = out
        if name == "packing":
            assert sorted({(r["doc_id"] is None, r["doc_id"] or 0) for r in out.collect()}) == sorted({(k is None, k or 0) for k, _ in rows})
        else:
            assert out.columns == docs.columns and all(r["tie"] == 1 and r["node"] == "x" for r in out.collect())
        assert stage(spark, docs.limit(0), d).count() == 0
    lines, single, clean = (before[k] for k in ("line_dedup", "near_dedup", "decontamination"))
    # the null id comes first, so its line stays; of the others only lines that no earlier document has
    assert texts(lines) >= {(None, one + " other"), (1, long), (3, None), (4, ""), (5, "\n\n")}
    kept = [(r["doc_id"], r["text"]) for r in single.collect()]
    assert kept.count((2, one)) <= 1 and {k for k, _ in kept} >= {1, 3, 4, 5, 6}
    assert dict(texts(clean))[6] != rows[-1][1] and dict(texts(clean))[1] == long and clean.count() == len(rows)
