"""The near_copies stage against the Jaccard similarity of all pairs."""

import random

import corpus_pipeline
import numpy as np
import pytest
from paperloom.llm import nearcopies, simhash
from paperloom.llm.common import table
from test_text_operators import DOCS, ODD


def slow_set(text):
    found = (text or "").encode().lower().split()
    return frozenset(tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4)))


def slow_components(texts):
    """{doc_id: smallest id reached} by comparing all pairs of ``texts[(doc_id, text)]``."""
    held = sorted((i, slow_set(t)) for i, t in texts)
    root = list(range(len(held)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (_, a) in enumerate(held):
        for m in range(n):
            if len(a & held[m][1]) * 5 >= len(a | held[m][1]) * 4:
                x, y = sorted((find(n), find(m)))
                root[y] = x
    return {i: held[find(n)][0] for n, (i, _) in enumerate(held)}


def drawn(seed=5):
    """Texts with copies of 0 to 12 changed words: far below, at and above the similarity."""
    draws = random.Random(seed)
    words = [f"w{i}" for i in range(5000)]
    out = []
    for _ in range(30):
        base = draws.choices(words, k=draws.randint(3, 300))
        out.append(" ".join(base))
        for _ in range(draws.randint(0, 6)):
            copy = list(base)
            for _ in range(draws.randint(0, 12)):
                copy[draws.randrange(len(copy))] = draws.choice(words)
            out.append(" ".join(copy).upper() if draws.random() < 0.3 else "  ".join(copy))
    return list(enumerate(out))


def by_id(df):
    return {r["doc_id"]: r["component_id"] for r in df.collect()}


def test_near_copies_equal_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert by_id(nearcopies.near_copies(docs)) == slow_components(texts)


@pytest.mark.parametrize("block", [3, 2048])
def test_stage_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(nearcopies, "BLOCK", block)
    texts = drawn()
    want = slow_components(texts)
    docs = spark.createDataFrame([(i, t, "en", "a", 1, None, None) for i, t in texts], DOCS)
    assert 30 < len(set(want.values())) < len(want) - 20
    got = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == sorted(set(want.values()))


def chained(seed=9):
    """Chains: each text differs from the one before in a little, so most pairs of a chain do not link."""
    draws, out = random.Random(seed), []
    words = [f"v{i}" for i in range(9000)]
    for _ in range(4):
        text = draws.choices(words, k=200)
        for _ in range(25):
            text = list(text)
            for _ in range(3):
                text[draws.randrange(200)] = draws.choice(words)
            out.append(" ".join(text))
    return list(enumerate(out))


def test_chains_equal_brute_force(spark):
    texts = chained()
    want = slow_components(texts)
    assert len(set(want.values())) < 30
    docs = spark.createDataFrame([(i, t, "en", "a", 1, None, None) for i, t in texts], DOCS)
    assert by_id(nearcopies.near_copies(docs)) == want


def test_buckets_are_not_joined_with_themselves(spark, monkeypatch):
    """Texts at similarity 0.5 share buckets; the sketches spare almost all of their pairs."""
    seen = []
    settled = nearcopies.settle
    monkeypatch.setattr(nearcopies, "settle", lambda df, label: seen.append((label, kept := settled(df, label))) or kept)
    draws = random.Random(4)
    base, texts = [f"b{i}" for i in range(150)], []
    for k in range(150):
        texts.append(" ".join(base + [f"own{draws.randrange(10**9)}" for _ in range(66)]))
    docs = spark.createDataFrame([(i, t, "en", "a", 1, None, None) for i, t in enumerate(texts)], DOCS)
    got = by_id(nearcopies.near_copies(docs))
    assert got == slow_components(list(enumerate(texts)))
    assert sum(df.count() for label, df in seen if label == "links") == 0


def test_forest_takes_the_nearest_pairs():
    rng = np.random.default_rng(6)
    for many in (5, 9, 30):
        x, y = np.triu_indices(many, 1)
        value = rng.permutation(len(x)) + 1
        kept = rng.random(len(x)) < 3 / many
        x, y, value = x[kept], y[kept], value[kept]
        want, root = set(), list(range(many))
        for k in np.argsort(-value).tolist():  # Kruskal's algorithm
            a, b = root[x[k]], root[y[k]]
            if a != b:
                want.add(k)
                root = [a if r == b else r for r in root]
        assert set(nearcopies._forest(many, x, y, value).tolist()) == want


def test_odd_rows(spark):
    odd, none = spark.createDataFrame(ODD, DOCS), spark.createDataFrame([], DOCS)
    got = nearcopies.near_copies(odd).collect()
    assert len(got) == len(ODD)
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 2)} == {1}
    assert nearcopies.near_copies(none).count() == nearcopies.keep_first(none).count() == 0
    kept = nearcopies.keep_first(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] in (1, 2, 3)) == [1, 3, 3]
    assert sum(r["doc_id"] is None for r in kept.collect()) == 1


def test_simhash_links_are_joined_without_buckets(spark):
    """With one band of 90 minima almost no pair shares a bucket; close fingerprints link all the same."""
    draws = random.Random(12)
    words, texts = [f"s{i}" for i in range(5000)], []
    for _ in range(25):
        base = draws.choices(words, k=400)
        copy = list(base)
        copy[draws.randrange(400)] = "other"
        texts += [" ".join(base), " ".join(copy).upper()]
    prints = [simhash.fingerprint(t, nearcopies.SHINGLE) for t in texts]
    want = [(i, i + 1) for i in range(0, 50, 2) if (prints[i] ^ prints[i + 1]).bit_count() <= simhash.DISTANCE]
    docs = spark.createDataFrame([(i, t, "en", "a", 1, None, None) for i, t in enumerate(texts)], DOCS)
    got = by_id(nearcopies.near_copies(docs, bands=1, rows=90))
    assert len(want) > 20 and all(got[i] == got[j] == i for i, j in want)


def test_simhash_links_are_checked(spark):
    """Texts whose fingerprints are near or equal, but whose sets are not, stay apart."""
    draws = random.Random(13)
    words, common = [f"t{i}" for i in range(900)], " ".join(f"c{i}" for i in range(5))
    texts = [" ".join([common] * 200 + draws.choices(words, k=12)) for _ in range(30)]
    prints = [simhash.fingerprint(t, nearcopies.SHINGLE) for t in texts]
    assert sum((a ^ b).bit_count() <= simhash.DISTANCE for n, a in enumerate(prints) for b in prints[:n]) > 100
    docs = spark.createDataFrame([(i, t, "en", "a", 1, None, None) for i, t in enumerate(texts)], DOCS)
    want = slow_components(list(enumerate(texts)))
    assert len(set(want.values())) > 20 and by_id(nearcopies.near_copies(docs)) == want
