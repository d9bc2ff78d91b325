import random

import numpy as np
import pytest
import xxhash

from larkspur.llm import simhash
from larkspur.llm.components import connected_components, forest


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(900, 900 + i) for i in range(60)] + [(7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = roots({n for e in edges for n in e}, edges)
    assert got == {n: want[n] for e in edges if e[0] != e[1] for n in e}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest_joins_what_links_join():
    p, q = np.array([0, 1, 5, 5]), np.array([3, 3, 6, 7])
    assert set(map(tuple, forest(p, q, 8))) == {(1, 0), (3, 0), (6, 5), (7, 5)}


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


TEXTS = [None, "", " \t\n", "One", "one", "a b", "A B c", "a b c d", "é É a b", "x " * 3000, "a\x1cb c d", "w " + "y" * 50_000]


def test_fingerprints():
    for t in TEXTS:
        assert simhash.fingerprint(t) == plain_fingerprint(t), t


@pytest.mark.parametrize("bucket", [1, 3, 64])
def test_pairs_are_all_found_however_small_the_buckets(spark, bucket):
    rng = random.Random(bucket)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = set(base) | {b ^ sum(1 << k for k in rng.sample(range(64), n)) for b in base[:3] for n in (1, 2, 3) for _ in range(25)}
    fps = sorted(fps)
    rows = [(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)]
    got = {tuple(sorted((r.a, r.b))) for r in simhash.near_pairs(spark.createDataFrame(rows, "fp long, node long"), 2, bucket).collect()}
    assert got == {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 2}


def test_near_duplicates_of_odd_rows(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(50, "a b c d", "y", 2), (50, "a b c d", "y", 2), (None, "a b c d", "z", 3), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    fps = {r[0]: plain_fingerprint(r[1]) for r in rows if r[0] is not None}
    want = roots(fps, [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2])
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert {r.component_id for r in got if r.doc_id is None} == {want[0], want[7]}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({c for c in want.values()})
    assert simhash.near_duplicates(docs.where("false")).count() == 0


def test_near_copies_by_similarity(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(400)]
        copy = base[:]
        copy[rng.randrange(50, 350)] = word()
        texts += [base, copy]
    texts += [[word() for _ in range(400)] for _ in range(20)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)] + [(100, ""), (101, None)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs, block=2).collect()}
    assert got == {**{i: i - i % 2 for i in range(24)}, **{i: i for i in range(24, 44)}, 100: 100, 101: 100}


@pytest.mark.parametrize("lead", [0, 60])
def test_all_pairs_of_a_large_bucket_are_compared(spark, lead):
    """Pairs, chains and rows near the smallest node, in a bucket far above the block."""
    rng = random.Random(lead)
    flip = lambda f, n: f ^ sum(1 << k for k in rng.sample(range(256), n))
    fps = [rng.getrandbits(256)]
    fps += [flip(fps[0], rng.randrange(20, 50)) for _ in range(lead)]
    for _ in range(120):
        fps.append(rng.getrandbits(256))
        fps += [flip(fps[-1], 40)]
        fps += [flip(fps[-1], 30)]
    signed = lambda f, k: (f >> 64 * k & 2**64 - 1) - (2**64 if f >> 64 * k + 63 & 1 else 0)
    rows = [(5, i, *(signed(f, k) for k in range(4))) for i, f in enumerate(fps)] + [(6, i, *(signed(f, k) for k in range(4))) for i, f in enumerate(fps[:3])]
    dealt = spark.createDataFrame(rows, "key long, node long, f0 long, f1 long, f2 long, f3 long")
    got = {(r.a, r.b) for r in simhash._verified(dealt, 43, 16).collect()}
    near = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 43]
    assert roots(range(len(fps)), got) == roots(range(len(fps)), near)
    assert len(set(roots(range(len(fps)), near).values())) > 100


def test_near_copies_recall_against_brute_force(spark):
    """Of all pairs with a Jaccard similarity of 0.8 or more at least nine in ten share a group; unlike texts don't."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    texts, family = [], []
    for f in range(60):
        base = [word() for _ in range(rng.randrange(120, 300))]
        texts.append(base)
        for edits in (1, 2, 3, 4):
            copy = base[:]
            for at in rng.sample(range(len(base)), edits):
                copy[at] = word()
            texts.append(copy)
        family += [f] * 5
    shingles = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if family[i] == family[j] and len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j])]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}
    assert len(near) > 300 and sum(got[i] == got[j] for i, j in near) >= 0.9 * len(near)
    assert all(family[i] == family[c] for i, c in got.items())
