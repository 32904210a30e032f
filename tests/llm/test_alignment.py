"""Alignment of two tokenizers against whole-text encoding and counting by hand."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

import cadenza.llm.alignment as module
from cadenza.llm.alignment import Aligner, align_tokenizers, compress, expand
from cadenza.llm.queries import QUERIES, tokenizer_path

FIRST, SECOND = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def aligner():
    return Aligner(FIRST, SECOND)


def groups_by_hand(aligner, text):
    """Groups of a text that each tokenizer reads as a whole; None without tokens."""
    if not text:
        return None
    a, b = aligner.first.encode(" " + text, add_special_tokens=False).ids, aligner.second.encode(text)
    whole = b" " + text.encode()
    if b"".join(aligner.first_bytes[k] for k in a) != whole or b"".join(aligner.second_bytes[k] for k in b) != whole:
        return None
    ends = [np.cumsum([len(table[k]) for k in ids]).tolist() for table, ids in ((aligner.first_bytes, a), (aligner.second_bytes, b))]
    out = []
    while a or b:
        k, shared = 0, sorted(set(ends[0][:3100]) & set(ends[1][:3100]))[0]
        k, m = ends[0].index(shared) + 1, ends[1].index(shared) + 1
        out.append((a[:k], b[:m]))
        a, b, ends = a[k:], b[m:], [ends[0][k:], ends[1][m:]]
    return out


def by_hand(aligner, docs):
    cut = [(d, groups_by_hand(aligner, t)) for d, t in docs]
    links = [Counter((a, b) for mine, theirs in g or () for a in mine for b in theirs) for _, g in cut]
    held = Counter(p for n in links for p in n)
    top = {}
    for (a, _), n in held.items():
        top[a] = max(top.get(a, 0), n)
    out = []
    for (d, g), n in zip(cut, links):
        said = hashlib.sha256(";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g).encode()).hexdigest() if g else ""
        g = g or []
        best = sum(m for p, m in n.items() if held[p] == top[p[0]])
        out.append((d, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(n.values()), best, sum(m * held[p] for p, m in n.items()), said))
    return sorted(out, key=str)


def strange_texts():
    rng = random.Random(5)
    part = lambda: rng.choice([" ", "  ", "\n", "\t", "\n ", " \n", " ", "　", "\x85", "\x1c", "\x00", "a", "The", "don't", "'s", "été", "12", "345", "!!", "<|endoftext|>", "<s>", "</s>", "<0x41>", "\U0001f600", "日本", "ﬁ", "́", "_", "ß", "​", "x" * 30])
    return ["".join(part() for _ in range(rng.randrange(1, 14))) for _ in range(1500)]


def test_pieces_join_to_the_whole_text(aligner):
    for t in [*strange_texts(), "a▁b", "a ▁b", " ", "  ", "\n", "a ", " a", "a  b c"]:
        rows, *_ = aligner.align([t])
        whole = groups_by_hand(aligner, t)
        assert rows[0][:3] == ((0, 0, 0) if whole is None else (sum(len(a) for a, _ in whole), sum(len(b) for _, b in whole), len(whole))), t
        assert rows[0][4] == ("" if whole is None else hashlib.sha256(";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in whole).encode()).hexdigest()), t


def test_pieces_in_rows_are_as_pieces_alone(aligner):
    texts = [*strange_texts(), "a▁b c", "x y ", " x y", "it 's n't", "1 2 3"]
    aligner.forget()
    alone = [aligner.align([t])[0][0] for t in texts]
    aligner.forget()
    rows, doc, piece, times = aligner.align(texts)
    assert rows == alone
    pair, number, many = aligner.postings(doc, piece, times)
    for k, t in enumerate(texts):
        links = Counter((a, b) for mine, theirs in groups_by_hand(aligner, t) or () for a in mine for b in theirs)
        own = number == k
        assert {(p // module.PAIR, p % module.PAIR): n for p, n in zip(pair[own].tolist(), many[own].tolist())} == links, t


def test_rows_with_an_open_end_are_left(aligner):
    aligner.forget()
    a, b = aligner.first.encode(" alignment of words", add_special_tokens=False).ids, aligner.second.encode("alignment of words")
    assert aligner._add([(["alignment", "of", "words"], a, b), (["ali", "nment of words"], a, b)]) == [1]
    assert list(aligner.number) == ["alignment", "of", "words"] and len(aligner.groups) == 3
    aligner.forget()


def test_bitmaps():
    rng = np.random.default_rng(1)
    for n in (1, 7, 300, 65536):
        held = np.unique(np.concatenate([rng.integers(0, 40 * n, 500), 3 * n + np.arange(n)]))
        own, packed = compress(held // n, held % n, n)
        row, doc = expand(packed)
        assert sorted(own[row] * n + doc) == held.tolist()
        assert max(len(x.as_py()) for x in packed) <= 1 + (n + 7) // 8


def test_alignment(spark, aligner, monkeypatch):
    rng = random.Random(6)
    words = "the of and a Haus étude ción walking tokenization 1234 don't <|endoftext|> ###".split()
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(40)))) for k in range(120)]
    docs += [(200 + k, t) for k, t in enumerate(strange_texts()[:150])]
    docs += [(1000, None), (1001, ""), (1002, "the " * 2000), (1003, "q" * 3000), (1004, "under▁score"), (None, "the end"), (7, "again"), (7, "again")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as block", "'x' as pair", "2 as number").repartition(3)
    want = by_hand(aligner, docs)
    assert sorted((tuple(r) for r in align_tokenizers(frame, FIRST, SECOND).select(COLUMNS).collect()), key=str) == want
    monkeypatch.setattr(module, "BLOCK_BYTES", 3000)
    assert sorted((tuple(r) for r in align_tokenizers(frame, FIRST, SECOND).select(COLUMNS).collect()), key=str) == want
    assert align_tokenizers(frame.limit(0), FIRST, SECOND).count() == 0


def test_registered_query(spark, aligner):
    folder = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op13_tokenizer_alignment"](spark, folder)
    assert sorted((tuple(r) for r in got.select(COLUMNS).collect()), key=str) == by_hand(aligner, docs)
