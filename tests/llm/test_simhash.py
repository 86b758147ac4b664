import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from riskframe.llm import simhash_dedup as S
from riskframe.llm.components import connected_components

FULL = (1 << 64) - 1


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < 3 else [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius=3):
    """fingerprint -> component number, by comparing all pairs."""
    up = list(range(len(fps)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    u = np.array(fps, dtype=np.uint64)
    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u[i] ^ u[i + 1:]) <= radius):
            up[root(i)] = root(i + 1 + int(j))
    return {f: root(i) for i, f in enumerate(fps)}


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


@pytest.mark.parametrize("text", [None, "", " \t", "one", "One two", "a b c", "A B c d a b C d", "été\x0bÉté été x y", "w " * 500])
def test_fingerprint_matches_definition(text):
    assert S.fingerprint(text) == brute_fingerprint(text)


def test_long_texts_are_hashed_whole(monkeypatch):
    text = " ".join(f"w{i}" for i in range(300))
    whole = S.fingerprint(text)
    monkeypatch.setattr(S, "HASHES_AT_ONCE", 7)
    assert S.fingerprint(text) == whole == brute_fingerprint(text)


def test_spark_and_xxhash_agree(spark):
    (row,) = spark.sql("select xxhash64('a b ç') h").collect()
    assert row.h & FULL == xxhash.xxh64("a b ç".encode(), seed=42).intdigest()


def test_bk_tree_finds_all_within_radius():
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    items = [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 9))) for _ in range(400)] + [rng.getrandbits(64) for _ in range(200)]
    tree = S.BKTree()
    for x in items:
        tree.add(x)
    for q in items[:80]:
        assert sorted(tree.within(q, 3)) == [i for i, x in enumerate(items) if (x ^ q).bit_count() <= 3]


@pytest.mark.parametrize("tree_size", [512, 20])
def test_links_lose_no_component(spark, tree_size):
    # tight clusters that share block values, so that shards are hot and are cut into several trees
    rng = random.Random(tree_size)
    fps = set()
    for _ in range(6):
        c = rng.getrandbits(64)
        fps |= {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for _ in range(150)}
    fps = sorted(fps)
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    edges = S.link_fingerprints(df, 3, tree_size)
    got = {r.node & FULL: r.root & FULL for r in connected_components(edges).collect()}
    want = brute_components(fps)
    mine = defaultdict(set)
    theirs = defaultdict(set)
    for f in fps:
        mine[got.get(f, f)].add(f)
        theirs[want[f]].add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(60)]
    star = [(100, i) for i in range(101, 160)] + [(5000, 5000)]
    roots = {r.node: r.root for r in connected_components(spark.createDataFrame(path + star, "u long, v long")).collect()}
    assert len({roots[i] for i in range(61)}) == 1 and len({roots[i] for i in range(100, 160)}) == 1
    assert roots[0] != roots[100]
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_documents_match_brute_force(small_docs):
    rows = small_docs.select("doc_id", "text").collect()
    fp = {r.doc_id: brute_fingerprint(r.text) for r in rows}
    comp = brute_components(sorted(set(fp.values())))
    least = defaultdict(lambda: 1 << 60)
    for d, f in fp.items():
        least[comp[f]] = min(least[comp[f]], d)
    out = S.simhash_dedup(small_docs).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.fp & FULL == fp[r.doc_id] and r.component_id == least[comp[fp[r.doc_id]]] and r.kept == (r.doc_id == r.component_id)


def test_awkward_rows(awkward, empty):
    out = S.simhash_dedup(awkward).collect()
    assert len(out) == awkward.count()
    zero = [r for r in out if r.fp == 0]
    assert {r.component_id for r in zero} == {2} and len(zero) == 4  # null, empty, white space; a null id does not lead
    assert {r.component_id for r in out if r.doc_id in (0, 1)} == {0}
    kept = S.keep_one_of_each(awkward)
    assert kept.columns == awkward.columns and kept.count() == len({r.component_id for r in out if r.component_id is not None}) + 1
    assert S.simhash_dedup(empty).collect() == []


@pytest.mark.parametrize("n", [10 ** 3, 10 ** 6, 10 ** 8, 10 ** 10, 10 ** 12])
def test_copies_of_a_fingerprint_stay_few(n):
    masks = S.shard_masks(n, 3, 512)
    bits = min(bin(m & (2 ** 64 - 1)).count("1") for m in masks)
    assert len(masks) * max(1, n / 2 ** bits / 512) < 64
    rng = random.Random(n)
    for _ in range(300):  # every change of three bits leaves one mask untouched
        change = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(not change & m for m in masks)


@pytest.mark.parametrize("pretend", [10, 10 ** 10, 10 ** 12])
def test_links_are_the_same_whatever_the_block_plan(spark, monkeypatch, pretend):
    rng = random.Random(4)
    fps = [rng.getrandbits(64) for _ in range(60)]
    fps = list({*fps, *[f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))) for f in fps for _ in range(4)]})
    plan = S.shard_masks
    monkeypatch.setattr(S, "shard_masks", lambda n, *rest: plan(pretend, *rest))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = S.link_fingerprints(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    root = {f: f for f in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for e in edges:
        assert bin((e.u ^ e.v) & (2 ** 64 - 1)).count("1") <= 3
        root[find(e.u)] = find(e.v)
    for i, a in enumerate(signed):
        for b in signed[:i]:
            if bin((a ^ b) & (2 ** 64 - 1)).count("1") <= 3:
                assert find(a) == find(b)
