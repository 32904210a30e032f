"""ProbMinHash near-duplicates against all pairs."""

import random
import re
from collections import Counter

import numpy as np

import cadenza.llm.common as common
import cadenza.llm.probminhash as module
from cadenza.llm.components import connected_components
from cadenza.llm.probminhash import keep_representatives, near_duplicates, probability_jaccard, signatures
from cadenza.llm.queries import QUERIES

WORD = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")


def bag(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), " ".join(WORD.findall(text or ""))).split()
    return tuple(w), Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] * bool(w))


def similarity(a, b):
    return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in {*a, *b}) for d in a if d in b)


def classes_by_hand(docs):
    bags = [bag(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if bags[i][0] and bags[j][0] and (bags[i][0] == bags[j][0] or similarity(bags[i][1], bags[j][1]) >= 0.8):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    ids = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            ids[root(i)] = min(d, ids.get(root(i), d))
    return sorted(((d, ids.get(root(i)) if bags[i][0] else d) for i, (d, _) in enumerate(docs)), key=str)


def test_similarity_and_signature():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a, b = (Counter(rng.integers(0, 30, 40).tolist()) for _ in range(2))
        x, y = np.array(sorted(a)), np.array(sorted(b))
        exact = similarity(a, b)
        assert abs(probability_jaccard(x, np.array([a[k] for k in x.tolist()]), y, np.array([b[k] for k in y.tolist()])) - exact) < 1e-9
        owner = np.concatenate([np.zeros(len(x), int), np.ones(len(y), int)])
        made = signatures(owner, np.concatenate([x, y]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.concatenate([[a[k] for k in x.tolist()], [b[k] for k in y.tolist()]]).astype(float), 2, 4000)
        assert abs((made[0] == made[1]).mean() - exact) < 0.05


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 360)] + [(500, k) for k in range(501, 560)] + [(7, 7), (1, None)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    near = {}
    for a, b in pairs:
        if b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for start in near:
        seen, todo = {start}, [start]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        assert got[start] == min(seen)
    assert got.keys() == near.keys()
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark):
    rng = random.Random(3)
    docs = []
    for k in range(12):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([3, 20, 100, 300]))]
        for c in range(rng.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, len(base) // 50, len(base) // 12])):
                copy[rng.randrange(len(copy))] = f"v{rng.randrange(10**6)}"
            docs.append((100 * k + c, " ".join(copy)))
    docs += [(9000, None), (9001, ""), (9002, "..."), (9003, "One two"), (9004, "one, TWO!"), (None, "one two"), (9005, "a b c d e f g " * 40), (9006, "a b c d e f g " * 44), (9007, "x y"), (9007, "one two"), (None, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as node", "'x' as label")
    got = sorted(((r["doc_id"], r["class_id"]) for r in near_duplicates(frame).collect()), key=str)
    assert got == classes_by_hand(docs)
    kept = sorted(((r["doc_id"], r["text"]) for r in keep_representatives(frame).collect()), key=str)
    classes = {c for d, c in got if c is not None and c not in (9000, 9001, 9002)}
    assert sorted({d for d, _ in kept} - {None, 9000, 9001, 9002}) == sorted(classes) and len(kept) == len(classes) + 4
    assert near_duplicates(frame.limit(0)).count() == 0


def template_family(rng, number, first):
    """Texts of one template with two or three words replaced each: most pairs lie just above or below 0.8."""
    base = [f"t{first}w{k}" for k in range(200)]
    docs = []
    for k in range(number):
        words = list(base)
        for at in rng.sample(range(200), rng.choice([2, 3, 3, 3, 4])):
            words[at] = f"x{first + k}y{at}"
        docs.append((first + k, " ".join(words)))
    return docs


def classes_of_sets(docs):
    """Like classes_by_hand, for texts without repeated shingles, where the similarity is that of sets."""
    bags = [set(bag(t)[1]) for _, t in docs]
    label = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if label[i] != label[j] and len(bags[i] & bags[j]) >= 0.8 * len(bags[i] | bags[j]):
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    return sorted((d, docs[label[i]][0]) for i, (d, _) in enumerate(docs))


def test_boilerplate_families(spark):
    """Pairs of similarity 0.85 that all share boilerplate, with 0.78 between the pairs: no link is lost, none is added."""
    common_part = [f"boiler{k}" for k in range(176)]
    own = lambda k, c: [f"own{k}x{j}" for j in range(8)] + [f"one{k}y{c}z{j}" for j in range(16)]
    docs = [(2 * k + c, " ".join(common_part + own(k, c))) for k in range(150) for c in (0, 1)]
    want = classes_of_sets(docs)
    assert [c for _, c in want] == [2 * (d // 2) for d, _ in want]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted((r["doc_id"], r["class_id"]) for r in near_duplicates(frame).collect()) == want


def test_template_family(spark, monkeypatch):
    rng = random.Random(5)
    docs = [d for k in range(6) for d in template_family(rng, 12, 1000 * k)] + template_family(rng, 300, 10_000)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    want = classes_of_sets(docs)
    assert sorted((r["doc_id"], r["class_id"]) for r in near_duplicates(frame).collect()) == want
    monkeypatch.setattr(module, "BLOCK_NODES", 20)  # blocks against blocks
    monkeypatch.setattr(common, "FEW_ROWS", 0)  # hot keys apart
    monkeypatch.setattr(common, "HOT_SHARE", 60)
    monkeypatch.setattr(module, "FEW_ROWS", 0)
    monkeypatch.setattr(module, "HOT_SHARE", 60)
    assert sorted((r["doc_id"], r["class_id"]) for r in near_duplicates(frame, rounds=1).collect()) == want


def test_registered_query_against_all_pairs(spark):
    folder = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    bags = {d: bag(t) for d, t in docs}
    holds = {}
    for d, (_, shingles) in bags.items():
        for e in shingles:
            holds.setdefault(e, []).append(d)
    links = []
    for d, (words, shingles) in bags.items():
        shared = Counter()
        for e, n in shingles.items():
            shared.update(dict.fromkeys((x for x in holds[e] if x < d), n))
        # the weight of what two texts share is a bound of their similarity
        total = sum(shingles.values())
        links += [(x, d) for x, n in shared.items() if n >= 0.8 * total and (bags[x][0] == words or similarity(bags[x][1], shingles) >= 0.8)]
    # no class reaches beyond a component of the links
    root = {d: d for d in bags}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in links:
        root[max(top(a), top(b))] = min(top(a), top(b))
    found = {r["doc_id"]: r["class_id"] for r in QUERIES["op5_near_dedup"](spark, folder).collect()}
    assert len(links) > 50 and len(found) == len(docs)
    assert sum(found[a] == found[b] for a, b in links) >= 0.99 * len(links)
    assert all(top(d) == top(c) for d, c in found.items())
