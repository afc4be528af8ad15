import random
import re
from itertools import combinations

import pytest
import xxhash

from grove.llm import simhash


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs, radius=3):
    ids = [d for d, _ in pairs]
    parent = list(range(len(pairs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(pairs)), 2):
        if bin(pairs[i][1] ^ pairs[j][1]).count("1") <= radius:
            parent[max(find(i), find(j))] = min(find(i), find(j))
    least: dict = {}
    for k in range(len(pairs)):
        if ids[k] is not None:
            least[find(k)] = min(least.get(find(k), ids[k]), ids[k])
    return [(ids[k], f"{pairs[k][1]:016x}", least.get(find(k))) for k in range(len(pairs))]


key = lambda r: tuple((x is not None, x) for x in r)


def test_rows_against_brute_force(spark, sf_docs, odd_docs, no_docs):
    rng = random.Random(10)
    base = "some words that make up one text of which there are many near copies in the table " * 8
    near = [(10_000 + k, base + rng.choice(["", "!", " end", " so"]) * rng.randint(0, 2)) for k in range(60)]
    made = spark.createDataFrame([*near, (20_000, "two words"), (20_001, "Two WORDS"), (20_002, None), (20_003, "")], "doc_id long, text string")
    docs = sf_docs.select("doc_id", "text").unionByName(made).unionByName(odd_docs.select("doc_id", "text"))
    want = brute_components([(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()])
    got = simhash.near_duplicates(docs).collect()
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert simhash.near_duplicates(no_docs).count() == 0


def test_masks_cover_every_pair_within_the_radius():
    rng = random.Random(11)
    for family in range(3):
        masks = simhash.covering_masks(family=family)
        assert len(masks) == 15
        for _ in range(3000):
            differ = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3)))
            assert any(not m & differ for m in masks)


@pytest.mark.parametrize("group", [16, 40, 1024])
def test_large_groups_lose_no_link(spark, group):
    rng = random.Random(12)
    centres = [rng.getrandbits(64) for _ in range(6)]
    fps = set()
    for c in centres:
        x = c
        for _ in range(60):  # chains and balls
            fps.add(x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
            x ^= sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2])))
    pairs = list(enumerate(fps))
    signed = [(d, f - 2**64 if f >= 2**63 else f) for d, f in pairs]
    table = spark.createDataFrame(signed, "doc_id long, fp long")
    want = {d: c for d, _, c in brute_components(pairs)}
    distinct = table.select("fp")
    from grove.operators.components import connected_components

    found = {r.node: r.component for r in connected_components(simhash.links(distinct, group=group)).collect()}
    root: dict = {}
    for d, f in signed:
        root.setdefault(found.get(f, f), set()).add(want[d])
    assert all(len(x) == 1 for x in root.values()) and len(root) == len(set(want.values()))


@pytest.mark.parametrize("hot", [0.0001, 0.01, 1.0])
def test_hot_groups_give_the_same_links(spark, hot):
    from grove.operators.components import connected_components

    rng = random.Random(13)
    centre = rng.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(500)} | {rng.getrandbits(64) for _ in range(100)}
    pairs = list(enumerate(fps))
    signed = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for _, f in pairs], "fp long")
    found = {r.node % 2**64: r.component for r in connected_components(simhash.links(signed, group=24, hot=hot)).collect()}
    root: dict = {}
    for (_, f), (_, _, c) in zip(pairs, brute_components(pairs), strict=True):
        root.setdefault(found.get(f, f), set()).add(c)
    assert all(len(x) == 1 for x in root.values()) and len(root) == len({c for x in root.values() for c in x})


def test_one_of_each(spark):
    rows = [(1, "a b c d e", "en"), (2, "a b c d e", "de"), (3, "quite another text of words", None), (3, "quite another text of words", None), (None, None, "en"), (5, "", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as fp")
    got = simhash.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(1, "a b c d e"), (3, "quite another text of words"), (5, "")]


def test_one_of_each_component(spark):
    texts = ["the first text of some words", "a second one that is quite another", "and a third about nothing of that kind"]
    rows = [(None, texts[0], 1), (None, texts[1], 2), (None, texts[1], 2), (7, texts[0], 3), (7, texts[2], 4), (None, None, 5), (None, "", 6)]
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, n int")).collect()
    assert sorted((r.n, r.doc_id, r.text) for r in got) == [(2, None, texts[1]), (3, 7, texts[0]), (4, 7, texts[2]), (5, None, None)]


def test_one_of_each_keeps_every_column(spark):
    rows = [(1, "a b c d e", "own", 7, 1, {"a": 1}), (2, "a b c d e", "x", 8, 2, {"b": 1})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _kept string, _root int, _h int, m map<string,int>")
    got = simhash.one_of_each(docs)
    assert got.schema.simpleString() == docs.schema.simpleString() and [tuple(r) for r in got.collect()] == [rows[0]]
