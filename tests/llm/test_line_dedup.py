"""Line deduplication against all pairs."""

import random
import time

import cadenza.llm.line_dedup as module
from cadenza.llm.line_dedup import dedup_lines, variant_keys, within_one_edit


def near(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def by_hand(docs):
    places = sorted({(-1 if d is None else d, t, k) for d, t in docs if t is not None for k in range(t.count("\n") + 1)}, key=lambda x: (x[0], x[2]))
    lines = [(d, t, k, t.split("\n")[k]) for d, t, k in places]
    lines = [x for x in lines if x[3].strip()]
    gone = set()
    for i, (d, t, k, s) in enumerate(lines):
        if any(s == o[3] or (min(len(s), len(o[3])) >= 10 and near(s, o[3])) for o in lines if (o[0], o[2]) < (d, k)):
            gone.add((d, t, k))
    return [(d, None if t is None else "\n".join(s for k, s in enumerate(t.split("\n")) if (-1 if d is None else d, t, k) not in gone)) for d, t in docs]


def test_variants():
    own, gone = variant_keys("abcé")
    assert [variant_keys(x)[0] for x in ("bcé", "acé", "abé", "abc")] == gone.tolist()
    assert len(variant_keys("")[1]) == 0 and variant_keys("a")[1].tolist() == [variant_keys("")[0]]


def test_within_one_edit():
    rng = random.Random(8)
    for _ in range(3000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 6))) for _ in range(2))
        assert a == b or within_one_edit(a, b) == near(a, b)


def test_line_dedup(spark, monkeypatch):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcé ") for _ in range(rng.randint(8, 40))) for _ in range(30)]

    def edit(s):
        k = rng.randrange(len(s) + 1)
        return rng.choice([s, s[:k] + "z" + s[k:], s[: max(0, k - 1)] + s[k:], s[: max(0, k - 1)] + "y" + s[k:], s[:k] + "zz" + s[k:]])

    docs = [(k, "\n".join(edit(rng.choice(base)) for _ in range(rng.randint(0, 9)))) for k in range(60)]
    docs += [(2000, "Yes.\nNo\n \n"), (2001, "No\nYes!\nYes.\n \n"), (2002, "Yes.")]
    docs += [(1000, None), (1001, ""), (1002, "\n\n"), (None, base[0] + "\n" + base[1]), (1003, "q" * 20000), (1004, "q" * 20001), (1005, "same line here"), (1005, "same line here")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as line", "1 as n_lines", "2 as tie")
    want = {(d, t) for d, t in by_hand(docs)}
    assert {(r["doc_id"], r["text"]) for r in dedup_lines(frame).collect()} == want
    assert dedup_lines(frame.limit(0)).count() == 0
    monkeypatch.setattr(module, "PLACE_CHARS", 60)  # most groups are spread by variant
    monkeypatch.setattr(module, "VARIANTS", 7)
    assert {(r["doc_id"], r["text"]) for r in dedup_lines(frame).collect()} == want
    single = spark.createDataFrame(docs[:60], "doc_id long, text string")
    assert {(r["doc_id"], r["text"]) for r in dedup_lines(single).collect()} == set(by_hand(docs[:60]))


def test_a_document_of_many_lines(spark):
    """Half of its lines are near copies of another one; the time grows with their number, not with its square."""
    rng = random.Random(4)
    n = 20_000
    base = ["".join(rng.choice("abcdefghijklmnop ") for _ in range(40)) for _ in range(n // 2)]
    lines = base + [s[:20] + "Z" + s[21:] for s in base]
    rng.shuffle(lines)
    start = time.time()
    row = dedup_lines(spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")).first()
    assert (row["n_lines"], row["n_removed"]) == (n, n // 2)
    seen, kept = set(), []
    for s in lines:
        if s[:20] + s[21:] not in seen:
            seen.add(s[:20] + s[21:])
            kept.append(s)
    assert row["text"] == "\n".join(kept)
    assert time.time() - start < 90
