"""Run-length index deduplication against a plain set of windows."""

import hashlib
import random

import numpy as np

import cadenza.llm.substring_dedup as module
from cadenza.llm.r_index import RunLengthIndex, joined, repeated_windows
from cadenza.llm.substring_dedup import remove_repeated


def by_hand(docs):
    seen, out, done = set(), [], {}
    for d, t in sorted(set(docs), key=lambda x: (x[0] is not None, x[0] or 0)):
        b = (t or "").encode()
        hit = [False] * len(b)
        for i in range(len(b) - 99):
            w = b[i : i + 100]
            if w in seen:
                hit[i : i + 100] = [True] * 100
            seen.add(w)
        kept = bytes(x for x, h in zip(b, hit) if not h)
        spans = sum(h and not p for h, p in zip(hit, [False, *hit]))
        done[d, t] = (d, len(b), sum(hit), spans, hashlib.sha256(kept).hexdigest())
    return sorted((done[x] for x in docs), key=str)


def corpus():
    rng = random.Random(4)
    noise = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passages = [noise(rng.randint(90, 300)) for _ in range(8)]
    docs = []
    for k in range(70):
        parts = [rng.choice([noise(rng.randint(0, 80)), rng.choice(passages), rng.choice(passages)[rng.randint(0, 60) :]]) for _ in range(rng.randint(0, 6))]
        docs.append((k, "".join(parts)))
    docs += [(200, None), (201, ""), (None, docs[5][1]), (202, "z" * 5000), (203, "ab" * 300), (204, noise(20000)), (205, docs[9][1]), (206, docs[9][1] + "x")]
    return docs


def test_against_windows(spark):
    docs = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as anchor", "'x' as tie", "2 as at")
    assert sorted((tuple(r) for r in remove_repeated(frame).collect()), key=str) == by_hand(docs)
    assert remove_repeated(frame.limit(0)).count() == 0


def test_repeated_rows_and_many_passages(spark, monkeypatch):
    docs = corpus()
    twice = [*docs, docs[9], docs[9]]
    frame = spark.createDataFrame(twice, "doc_id long, text string")
    assert sorted((tuple(r) for r in remove_repeated(frame).collect()), key=str) == by_hand(twice)
    monkeypatch.setattr(module, "INDEX_PASSAGES", 2)  # most anchors are taken apart into windows after they met
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    kept = remove_repeated(frame, with_text=True).drop("kept")
    assert sorted((tuple(r) for r in kept.collect()), key=str) == by_hand(docs)


def test_hot_anchors(spark, monkeypatch):
    rng = random.Random(8)
    noise = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    line = noise(90)  # shorter than a window, so every passage around it is another one
    docs = [(k, noise(rng.randint(0, 60)) + line + rng.choice(("", "tail that comes again", noise(40)))) for k in range(3000)]
    monkeypatch.setattr(module, "HOT_SAMPLE", 1)
    monkeypatch.setattr(module, "HOT_SHARE", 20)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert len(module.hot_anchors(spark, frame.selectExpr("doc_id as doc", "0L as tie", "text"))) > 0
    assert sorted((tuple(r) for r in remove_repeated(frame).collect()), key=str) == by_hand(docs)
    # the same around anchors that nobody noticed, in one index and taken apart
    monkeypatch.setattr(module, "HOT_SHARE", 1)
    assert sorted((tuple(r) for r in remove_repeated(frame).collect()), key=str) == by_hand(docs)
    monkeypatch.setattr(module, "INDEX_PASSAGES", 500)
    assert sorted((tuple(r) for r in remove_repeated(frame).collect()), key=str) == by_hand(docs)


def test_index_against_plain_comparison():
    rng = np.random.default_rng(1)
    for trial in range(20):
        strings, group = [], []
        for g in range(3):
            base = rng.integers(0, 3 + trial, rng.integers(10, 30)).astype(np.uint8) + 80 * g
            for _ in range(rng.integers(1, 29)):
                s = base.copy()
                if rng.random() < 0.7:
                    s[rng.integers(0, len(s))] = rng.integers(0, 5) + 80 * g
                strings.append(s[rng.integers(0, len(s) - 9) :] if rng.random() < 0.4 else s)
                group.append(g)
        held = lambda s, n, others: [any(s[i : i + n].tobytes() in t.tobytes() for t in others) for i in range(len(s) - n + 1)]
        for k, flags in enumerate(repeated_windows(strings, np.array(group), 10)):
            assert flags.tolist() == held(strings[k], 10, strings[:k])
        index = RunLengthIndex(joined(strings[:4], np.zeros(4))[0])
        for s, match in zip(strings, index.matches(strings, np.zeros(len(strings)), 20)):
            longest = [max(n for n in range(min(20, len(s) - i) + 1) if any(s[i : i + n].tobytes() in t.tobytes() for t in strings[:4])) for i in range(len(s))]
            assert match.tolist() == longest
    copies = [rng.integers(0, 9, 150).astype(np.uint8)] * 500
    text, _, _ = joined(copies, np.zeros(500))
    assert len(RunLengthIndex(text).heads) < len(text) / 100  # copies add next to nothing to what is kept
