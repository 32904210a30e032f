"""Packing: every id once, no gaps, little padding."""

import zlib
from collections import defaultdict

import numpy as np

from cadenza.llm.cutting_stock import best_pattern, plan, solve_relaxation
from cadenza.llm.packing import WordEncoder, pack
from cadenza.llm.queries import tokenizer_path


def test_knapsack_and_plan():
    assert best_pattern(np.array([3, 5]), np.array([3.0, 5.1]), 11).tolist() == [2, 1]
    basis, use = solve_relaxation(np.array([3, 5, 7]), np.array([10.0, 10.0, 10.0]), 10)
    assert abs((basis @ use - 10).sum()) < 1e-6 and use.sum() < 16.01
    rng = np.random.default_rng(1)
    histogram = {int(x): int(rng.integers(0, 500)) for x in [*range(1, 32), *range(32, 4097, 32)]}
    patterns = plan(histogram, 4096, 32)
    total = defaultdict(int)
    for pattern, times in patterns:
        assert sum(x * n for x, n in pattern.items()) <= 4096 and times > 0
        for x, n in pattern.items():
            total[x] += n * times
    assert {k: v for k, v in total.items() if v} == {k: v for k, v in histogram.items() if v}
    used = sum(t for _, t in patterns)
    assert used <= 1.03 * sum(k * v for k, v in histogram.items()) / 4096 + 2
    assert plan({}, 4096, 32) == []


def test_pack_round_trip(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    plain = Tokenizer.from_file(path)
    texts = [None, "", "a", "Hello  world\n\nit's <|endoftext|> fine x y don't", "é ́e Σας ΣΑΣ 漢字かな \x1c\x85z", "word salad " * 5000, "zz" * 9000, "x\ty\r\nz"]
    docs = [(k, t) for k, t in enumerate(texts)] + [(2, "a"), (None, "b c")] + [(100 + k, f"text {k} " * (k % 97)) for k in range(300)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as length", "2 as rank", "3 as part")
    encoder = WordEncoder(path)
    want = {}
    for d, t in docs:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
        assert np.frombuffer(encoder.encode([t or ""])[0], "<u4").tolist() == ids[:-1]
        want[d] = np.array(ids, "<u4")
    rows = pack(frame, path, with_ids=True).collect()
    at, per = defaultdict(list), defaultdict(list)
    for r in rows:
        at[r["doc_id"]].append(r)
        per[r["sequence_id"]].append((r["offset"], r["length"]))
    assert at.keys() == want.keys()
    for d, pieces in at.items():
        copies = 2 if d == 2 else 1
        assert sum(p["length"] for p in pieces) == copies * len(want[d])
        for p in pieces:
            ids = want[d][p["start"] : p["start"] + p["length"]]
            assert p["doc_tokens"] == len(want[d]) and p["ids_crc32"] == zlib.crc32(ids.tobytes()) and p["ids"] == ids.tolist()
    for spans in per.values():
        spans.sort()
        assert [a for a, _ in spans] == np.cumsum([0, *(n for _, n in spans)])[:-1].tolist() and sum(n for _, n in spans) <= 4096
    assert pack(frame.limit(0), path).count() == 0
