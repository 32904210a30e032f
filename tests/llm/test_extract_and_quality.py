"""HTML extraction on pages with known text, and the classifier on held-out rows."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa

from cadenza.llm.boosting import fit_trees
from cadenza.llm.common import mix, utf8
from cadenza.llm.html_dom import Page
from cadenza.llm.html_extract import decode, extract_text, features, layout, text_from, train
from cadenza.llm.quality_model import BUCKETS, NONZERO, REACH, WIDTH, context_sums, fit, pooled, score_quality, tokens

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def paragraph(rng, n=40):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randint(5, n))).capitalize() + "."


def test_reader():
    page = Page('<p>a&amp;b <b>c<br>d<p>e<script>x<p>y</script> f <li>g<li>h<!-- <p>z --><img src="a>b">i</li><div CLASS=\'Side-Bar adBox\'>j &copy k<td>l</')
    text = text_from(page, [not s for s in page.silent])
    assert text == "a&b c d\ne f\ng\nhi\nj © k l</"
    assert ("side", "bar", "ad", "box") in page.words
    assert text_from(Page(""), [True]) == "" and Page("<a href='x").tags == ["#root", "a"]


def test_trees():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = fit_trees(x[:1500], y[:1500], np.ones(1500), trees=40, depth=3)
    assert ((model.log_odds(x[1500:]) > 0) == y[1500:]).mean() > 0.95


def test_decoding_is_consistent():
    rng = random.Random(1)
    page = Page(layout(rng, [paragraph(rng) for _ in range(50)]))
    kept = decode(page, np.random.default_rng(2).normal(size=len(page.tags)))
    assert all(kept[page.parents[k]] for k in range(1, len(kept)) if kept[k])


def test_held_out_layouts():
    rng = random.Random(3)
    model = train(["<p>" + paragraph(rng, 80) + "</p>" for _ in range(80)], layouts=300)
    right = wrong = 0
    for _ in range(60):
        page = Page(layout(rng, [paragraph(rng, 80) for _ in range(40)]))
        kept = decode(page, model.log_odds(features([page])))
        for node, text, _ in page.runs:
            if not page.silent[node] and text.strip():
                right += len(text) * (kept[node] == page.marked[node])
                wrong += len(text) * (kept[node] != page.marked[node])
    assert right / (right + wrong) > 0.97


def test_extract(spark):
    rng = random.Random(4)
    rows = [(None, None, None), (1, "u", ""), (2, "u", "<p")]
    want = {}
    for k in range(3, 40):
        body = [paragraph(rng) for _ in range(rng.randint(2, 8))]
        want[k] = "\n".join(["Title & more", *body])
        page = f'<html><head><title>t</title></head><body><nav><ul><li><a href="/a">alpha</a></li><li><a href="/b">beta</a></li></ul></nav><div class="ad">{paragraph(rng)}</div><article><h1>Title &amp; more</h1>' + "".join(f"<p>{p}</p>" for p in body)
        rows.append((k, "u", page + f"</article><footer>&copy; x &middot; {paragraph(rng)}</footer></body></html>"))
    rows.append(rows[-1])
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    got = extract_text(frame).collect()
    assert len(got) == len(rows)
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert {r["page_id"]: r["text"] for r in got if r["page_id"] in want} == want
    assert {r["text"] for r in got if r["page_id"] in (None, 1)} == {""}
    assert extract_text(frame.limit(0)).count() == 0


def test_network():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1200, 6)).astype(np.float32)
    y = (x[:, 0] + x[:, 1] ** 2 + 0.1 * rng.normal(size=1200) > 0.5).astype(int)
    net = fit(x[:900], y[:900])
    p = net.probabilities(x[900:])
    assert ((p > 0.5) == y[900:]).mean() > 0.85 and 0 <= p.min() and p.max() <= 1
    assert fit(x[:0], y[:0]).probabilities(x[:2]).tolist() == [0.5, 0.5]


def test_quality(spark):
    rng = random.Random(6)
    docs, labels = [(None, "alpha beta"), (-1, None), (-2, ""), (-2, "")], [(None, 1), (7, None)]
    for k in range(600):
        good = rng.random() < 0.7
        text = paragraph(rng, 200)
        docs.append((k, text if good else re.sub(r"(\w+)", r"\1$$$", text)))
        labels.append((k, int(good)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "2 as score", "'x' as y")
    taught = spark.createDataFrame(labels, "doc_id long, quality int").selectExpr("*", "'z' as text")
    got = score_quality(frame, taught).collect()
    truth = dict(labels)
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(docs) and 100 < len(held) < 200
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held if r["doc_id"] in truth]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert score_quality(frame.limit(0), taught).count() == 0
    assert score_quality(frame, taught.limit(0)).count() == len(docs)


def test_decoding_against_all_labellings():
    rng = np.random.default_rng(3)
    for source in ("<div><p>a</p><p>b<b>c</b></p></div><p>d</p>", "<ul><li>a<i>b</i></li><li>c</li></ul><div><div><p>d</p></div></div>", "<p>a</p>", "<script>x</script><div>y<p>z</p></div>"):
        page = Page(source)
        n = len(page.parents)
        for _ in range(5):
            odds = rng.normal(size=n) * 2
            best, found = -np.inf, None
            for choice in itertools.product([False, True], repeat=n - 1):
                kept = [True, *choice]
                if any(kept[k] and (page.silent[k] or not kept[page.parents[k]]) for k in range(1, n)):
                    continue
                value = sum(-np.logaddexp(0, -odds[k]) if kept[k] else -np.logaddexp(0, odds[k]) for k in range(1, n))
                if value > best:
                    best, found = value, kept
            assert decode(page, odds) == found


def test_word_vectors_and_pooling_by_hand():
    texts = ["aa bb aa cc", "", "bb 12!", "x"]
    data, offsets = utf8(pa.array(texts))
    hashes, doc = tokens(data, offsets)
    assert doc.tolist() == [0, 0, 0, 0, 2, 2, 2, 3] and hashes[0] == hashes[2] and hashes[1] == hashes[4]

    def drawn(h):
        v = np.zeros(WIDTH)
        for k in range(NONZERO):
            m = int(mix(np.array([(int(h) + 0x9E3779B97F4A7C15 * (k + 1)) % (1 << 64)], np.uint64))[0])
            v[m % WIDTH] += 1 - 2 * (m >> 32 & 1)
        return v

    want = np.zeros((BUCKETS, WIDTH))
    for i, h in enumerate(hashes):
        for j in range(len(hashes)):
            if i != j and abs(i - j) <= REACH and doc[i] == doc[j]:
                want[int(h) % BUCKETS] += drawn(hashes[j])
    assert np.allclose(context_sums(hashes, doc), want)
    vectors = np.random.default_rng(1).normal(size=(BUCKETS, WIDTH)).astype(np.float32)
    got = pooled(data, offsets, vectors)
    for k in range(len(texts)):
        own = np.array([vectors[int(h) % BUCKETS] for h, d in zip(hashes, doc) if d == k])
        if not len(own):
            assert not got[k].any()
            continue
        alike = sum(float(a @ b) for a, b in zip(own[1:], own)) / max(1, len(own) - 1)
        mean = own.mean(axis=0)
        assert np.allclose(got[k], [*mean, *own.std(axis=0), alike, np.sqrt(mean @ mean), np.log1p(len(own))], atol=1e-4)


def test_repeated_ids_and_long_texts_of_the_classifier(spark):
    rng = random.Random(2)
    docs = [(k % 50, f"{paragraph(rng)} {k % 2 * 'bad!! '}") for k in range(400)] + [(999, "word " * 400_000), (None, "a"), (7, None), (7, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as score", "1 as id", "2 as tie")
    taught = spark.createDataFrame([(k, k % 2) for k in range(50)] * 2 + [(None, 1), (3, None)], "doc_id long, quality int")
    got = score_quality(frame, taught, train_rows=100).collect()
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["text"] is None}) == 1
