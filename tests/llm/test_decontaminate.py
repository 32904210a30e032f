"""FM-index decontamination against a plain search."""

import hashlib
import random
import re

import numpy as np

from cadenza.llm.common import suffix_array
from cadenza.llm.decontaminate import Phrases, contamination_digest, find_contamination, remove_spans
from cadenza.llm.fm_index import FMIndex

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def by_hand(docs, items):
    windows = []
    for item, text in items:
        w = words(text)
        windows += [(item, tuple(w[i : i + 10])) for i in range(max(1, len(w) - 9) if w else 0)]
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, win in windows:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found.add(str(item) if item is not None else "")
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_suffix_array_and_index():
    rng = np.random.default_rng(3)
    for n, k in ((0, 2), (1, 2), (50, 1), (200, 2), (400, 30)):
        text = rng.integers(0, k, n)
        t = text.tolist()
        assert suffix_array(text).tolist() == sorted(range(n), key=lambda i: t[i:])
        index = FMIndex(text, k, sample=4)
        patterns = rng.integers(0, k, (40, 3))
        lengths = rng.integers(1, 4, 40)
        low, high = index.search(patterns.ravel(), np.arange(40) * 3, lengths)
        for p, m, a, b in zip(patterns.tolist(), lengths.tolist(), low, high):
            assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(n - m + 1) if t[i : i + m] == p[:m]]


def test_contamination(spark):
    rng = random.Random(5)
    vocabulary = ["aa", "Bb", "çé", "9z", "dd"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.randint(8, 14))) for k in range(12)] + [(12, "zz"), (13, None), (14, "--"), (3, "unique words here"), (None, "qq rr")]
    docs = [(k, text(rng.randint(0, 400))) for k in range(30)] + [(100, None), (101, ""), (102, "x ZZ, y zz."), (102, "x ZZ, y zz."), (103, "qq--rr unique WORDS\nhere"), (None, "dd")]
    docs += [(200 + k, "pre " + items[k][1].upper() + "! post") for k in range(12)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as hit_items", "1 as n_words")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (10_000_000, 100):  # one block, then several
        found = find_contamination(frame, bench, block_chars=block)
        got = sorted((tuple(r) for r in contamination_digest(found).collect()), key=str)
        assert got == by_hand(docs, items)
    clean = {r["doc_id"]: r["text"] for r in remove_spans(found).collect()}
    assert clean == {r["doc_id"]: r["text"] for r in find_contamination(frame, bench, block_chars=100, remove=True).collect()}
    assert clean[102] == "x , y ." and clean[100] is None and clean[101] == "" and clean[103] == ""
    for d, t in docs:
        assert len(words(clean[d])) == len(words(t)) - {g[0]: g[2] for g in got}[d]
    assert contamination_digest(find_contamination(frame.limit(0), bench)).count() == 0
    assert not any(r["contaminated"] for r in contamination_digest(find_contamination(frame, bench.limit(0))).collect())


def test_long_texts_and_size_of_phrases(spark):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(500)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    item = text(12)
    long = text(200_000) + " " + item + " " + text(1000)
    docs = spark.createDataFrame([(1, long), (2, text(50)), (2, text(50))], "doc_id long, text string")
    found = {r["doc_id"]: r for r in contamination_digest(find_contamination(docs, spark.createDataFrame([(7, item), (7, item), (8, item)], "item_id long, text string"))).collect()}
    assert (found[1]["n_hit"], found[1]["n_items"], found[2]["contaminated"]) == (12, 2, False) and found[1]["n_words"] == 201_012
    phrases = Phrases([(str(k), text(3000)) for k in range(100)])
    held = sum(getattr(phrases, name).nbytes for name in ("flat", "starts", "lengths", "owner", "owned"))
    assert len(phrases.starts) > 290_000 and held < 25 * 300_000
