"""Chat formatting, URL filter and repetition rules against plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from cadenza.llm.chat import digest, expand_prefix_targets
from cadenza.llm.quality_rules import MAX_NGRAM_SHARE, measure, repetition_rules
from cadenza.llm.urls import judge_urls, named_targets

HARD = "\\### Assistant: </turn> ok"
TURNS = [
    (-7, 0, "user", HARD), (-7, 1, "assistant", HARD), (-8, 0, None, None), (-9, 0, "a: b###", "### ### \\s\\e"), (-9, 1, "assistant", ""),
    (-9, 1, "assistant", ""), (1, 0, "system", "x\n</turn>\n</turn>"), (1, 1, "assistant", "é" * 5000), (1, 2, "user", "tail"), (None, None, "assistant", "</tu</turn>rn>"),
]


def test_chat_round_trip(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as example", "2 as formatted")
    examples = expand_prefix_targets(turns)
    got = {r["conv_id"]: r for r in digest(examples).collect()}
    said = defaultdict(list)
    for conv, turn, role, text in TURNS:
        said[conv].append((turn if turn is not None else -1, role or "", text or ""))
    assert got.keys() == said.keys()
    for conv, rows in said.items():
        rows.sort()
        loss = "".join(t for _, r, t in rows if r == "assistant")
        r = got[conv]
        assert r["n_turns"] == len(rows)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in rows).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for e in examples.collect():  # only the last text is under the mask, all turns before it are context
        assert e["loss_start"] + e["loss_chars"] + len("</turn>\n") == len(e["formatted"])


def test_chat_empty(spark):
    assert digest(expand_prefix_targets(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_urls(spark):
    link, fresh = '<link rel="canonical" href="{}">', '<meta http-equiv=refresh content="0; url={}">'
    rows = [
        (1, "http://A.org/x", link.format("http://b.net/y")), (2, "http://c.org/x", fresh.format("http://a.org/x")), (3, "http://c.org/x#f", None),
        (4, None, None), (5, "foo", ""), (6, "http://d.org/q", '<link href="/fr/z" rel="canonical">'), (7, "http://d.org/w", link.format("http://d.org/q")),
        (8, "http://e.net/w", link.format("http://d.org/q")), (9, "https://x.example.net/en/1?a", None), (10, "https://example.net", None), (11, "https://notexample.com/de/", ""), (11, "https://m.Example.COM/de/", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'z' as host", "'z' as node")
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in judge_urls(pages).collect())
    assert [(g[0], g[3], g[4]) for g in got] == [
        (1, None, "block"), (2, None, "block"), (3, None, "block"), (4, None, "allow"), (5, None, "allow"), (6, None, "allow"), (7, None, "allow"),
        (8, "net/", "block"), (9, "example.net/en/", "allow"), (10, None, "allow"), (11, "example.com/de/", "block"), (11, None, "allow"),
    ]
    assert got[0][1:3] == ("a.org", "/x") and got[3][1:3] == ("", "") and got[9][1:3] == ("example.net", "")
    table = spark.createDataFrame([("http://p.org/1", "http://q.org/2"), ("http://q.org/2", "http://r.net/"), (None, "x")], "source string, target string")
    alias = judge_urls(spark.createDataFrame([(1, "https://p.org/1", "")], "page_id long, url string, html string"), redirects=table)
    assert alias.first()["verdict"] == "block"
    assert judge_urls(pages.limit(0)).count() == 0


def test_url_targets(spark):
    link, fresh = '<link rel="canonical" href="{}">', '<meta http-equiv=refresh content="0; url={}">'
    rows = [
        (1, "http://a.org/x", link.format("http://b.org/y") + fresh.format("http://c.net/z")), (2, "http://b.org/y", ""),
        (3, "http://d.org/x", link.format("http://d.org/u") + link.format("http://e.net/v")), (4, "http://f.org/p/q/r?s", link.format("b.html")), (5, "http://f.org/p/q/b.html", fresh.format("http://g.net/")),
        (6, "http://f.org/p/q/t", link.format("../x/./y?k=../z")), (7, "http://f.org/p/x/y?k=../z", fresh.format("http://g.net/")), (8, "http://f.org/p/s?a=1", link.format("?id=3")), (9, "http://f.org/p/s?id=3", fresh.format("http://g.net/")),
        (10, "http://h.org", link.format("i")), (11, "http://h.org/i", fresh.format("http://g.net/")), (12, "http://k.org/", link.format("#top") + link.format("") + link.format("mailto:a@g.net")), (13, "http://k.org/a/b", fresh.format("../../..")), (14, None, link.format("b.html")),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r["source"], r["target"]) for r in named_targets(pages, "url", "html").collect()}
    p = "http://f.org/p"
    assert got == {
        ("http://a.org/x", "http://b.org/y"), ("http://a.org/x", "http://c.net/z"), ("http://d.org/x", "http://d.org/u"), ("http://d.org/x", "http://e.net/v"), (f"{p}/q/r?s", f"{p}/q/b.html"), (f"{p}/q/b.html", "http://g.net/"),
        (f"{p}/q/t", f"{p}/x/y?k=../z"), (f"{p}/x/y?k=../z", "http://g.net/"), (f"{p}/s?a=1", f"{p}/s?id=3"), (f"{p}/s?id=3", "http://g.net/"), ("http://h.org", "http://h.org/i"), ("http://h.org/i", "http://g.net/"), ("http://k.org/a/b", "http://k.org/"),
    }
    assert {r["page_id"]: r["verdict"] for r in judge_urls(pages).collect()} == {k: "allow" if k > 11 else "block" for k in range(1, 15)}


def by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup_lines = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup_lines += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(grams)
    repeat = {j for i, g in enumerate(grams) if count[g] > 1 for j in range(i, i + 8)}
    shares = []
    for n in MAX_NGRAM_SHARE:
        known, hit = set(), set()
        for i in range(len(words) - n + 1):
            gram = tuple(words[i : i + n])
            if gram in known:
                hit |= set(range(i, i + n))
            known.add(gram)
        shares.append(sum(len(words[i]) for i in hit))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup_lines, len(repeat), shares


def test_repetition(spark):
    texts = [None, "", "\n\n a", "a\n" * 30, "x" * 10000, " é ü\n# é ü\n\n é ü\nq", "a b c d e f g h i j " * 9, " ".join(map(str, range(300))), "one two\x0bthree\n\none two\x0bthree\n"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(1, ""), (None, "z z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_words", "'x' as kept").coalesce(1)
    got = sorted((tuple(r) for r in repetition_rules(docs).collect()), key=str)
    want = sorted(((k, *by_hand(t)) for k, t in rows), key=str)
    assert [g[:6] for g in got] == [w[:6] for w in want]
    for g, w in zip(got, want):
        assert [round(x * max(1, w[2])) for x in g[9]] == w[6]
        assert g[6] == (w[1] < 20 or 100 * w[5] > 30 * w[1])
    assert {g[0]: g[7] for g in got}[7] is True
    assert repetition_rules(docs.limit(0)).count() == 0


@pytest.mark.parametrize("size", [64, 1024, 4096, 65536])
def test_long_lines_of_two_letters(size):
    """The Thue-Morse line and its complement differ, though polynomials modulo a power of two can't tell them apart."""
    parity = np.array([bin(k).count("1") & 1 for k in range(size)], np.uint8)
    one, other = (97 + parity).tobytes(), (98 - parity).tobytes()
    for text, lines, words in ((one + b"\n" + other, 0, 0), (one + b"\n" + other + b"\n" + one, 1, 0), (b" ".join([one] * 8 + [other] * 8), 0, 0), (b" ".join([one] * 9), 0, 9)):
        data = np.frombuffer(text, np.uint8)
        got = measure(data, np.array([0, len(data)]), (5,))
        assert got["n_dup_lines"].tolist() == [lines] and got["n_repeat_words"].tolist() == [words]
