import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from riskframe.llm import lexical_search as L

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    bags = [(i, terms(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(b) for _, b in bags), sum(len(b) for _, b in bags)
    df = Counter(w for _, b in bags for w in set(b))
    out = []
    for item, text in items:
        q = Counter(terms(text))
        scored = []
        for i, b in bags:
            tf = Counter(b)
            m = 25 + (75 * len(b) * n_docs) // max(n_terms, 1)
            s = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * tf[w]) // (1000 * tf[w] + 8 * m))
                    for w, c in q.items() if w in tf)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, n, i, -s) for n, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def some(seed, n, words=60, longest=30):
    r = random.Random(seed)
    pool = [f"w{int(r.paretovariate(0.7)) % words}" for _ in range(4000)]
    return [(i, r.choice([" ", "-", "\n"]).join(r.choice([w, w.upper()]) for w in r.choices(pool, k=r.randint(0, longest)))) for i in range(n)]


@pytest.mark.parametrize(("seed", "sizes"), [
    (1, {}), (2, {"shard_rows": 40, "query_rows": 3, "block": 4}), (3, {"shard_cells": 100, "query_terms": 20, "block": 1}), (4, {"block": 16, "k": 3})])
def test_matches_brute_force(spark, seed, sizes):
    docs, items = some(seed, 300), some(seed + 50, 12)
    got = L.search(spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame(items, ITEMS), **sizes)
    assert found(got) == brute(docs, items, sizes.get("k", 10))


def _shard(seed, n=1500, vocabulary=80, block=16):
    r = np.random.default_rng(seed)
    topics = [r.choice(vocabulary, 12, replace=False) for _ in range(8)]
    rows = [np.unique(np.concatenate([r.choice(topics[i % 8], 8), r.choice(vocabulary, 2)])) for i in range(n)]
    heads = np.append(0, np.cumsum([len(x) for x in rows]))
    weights = r.integers(1, 9000, vocabulary)
    return L.Shard(heads, np.concatenate(rows), r.integers(1, 10 ** 6, heads[-1]), weights, block), weights, topics


def test_summaries_bound_every_score_and_blocks_are_skipped():
    shard, weights, topics = _shard(1)
    skipped = 0
    for topic in topics:
        q = np.zeros(80, dtype=np.int64)
        q[topic] = weights[topic]
        every = shard.scores(np.arange(shard.docs), q)
        for term in topic:
            blocks = shard.blocks(int(term))
            bounds = np.add.reduceat(blocks.most * q[blocks.terms], blocks.heads)
            for b, bound in enumerate(bounds):
                inside = blocks.docs[blocks.first[b]:blocks.first[b + 1]]
                assert len(inside) and every[inside].max() <= bound
                held = np.zeros(80, dtype=np.int64)
                held[blocks.terms[blocks.heads[b]:np.append(blocks.heads, len(blocks.terms))[b + 1]]] = blocks.most[blocks.heads[b]:np.append(blocks.heads, len(blocks.terms))[b + 1]]
                want = np.zeros(80, dtype=np.int64)
                for d in inside:
                    at = slice(shard.heads[d], shard.heads[d + 1])
                    np.maximum.at(want, shard.terms[at], shard.impacts[at])
                assert (held == want).all()
        score, at, n = shard.search(q, 10)
        want = sorted(zip((-every).tolist(), range(shard.docs), strict=True))[:10]
        assert list(zip((-score).tolist(), at.tolist(), strict=True)) == want
        skipped += n
    assert skipped > 50  # the bounds do prune


def test_dense_and_sorted_summaries_agree(monkeypatch):
    dense, _, _ = _shard(3)
    by_sort, _, _ = _shard(3)
    for term in range(80):
        if dense.most[term]:
            monkeypatch.setattr(L, "DENSE_CELLS", 1 << 22)
            a = dense.blocks(term)
            monkeypatch.setattr(L, "DENSE_CELLS", 0)
            assert all((x == y).all() for x, y in zip(a, by_sort.blocks(term), strict=True))


def test_blocks_gather_similar_documents():
    shard, _, _ = _shard(2)
    blocks = shard.blocks(int(np.argmax(np.diff(shard.posting_heads))))
    topic = blocks.docs % 8  # rows were made topic by topic
    same = np.mean([np.bincount(topic[a:b]).max() / (b - a) for a, b in zip(blocks.first, blocks.first[1:], strict=False) if b - a > 3])
    assert same > 0.5  # by chance about a quarter


def test_awkward_rows(spark, awkward, empty):
    docs = [(r.doc_id, r.text) for r in awkward.collect()]
    items = [(1, "The CAT sat"), (1, "The CAT sat"), (None, "été WORD word"), (2, None), (3, ""), (4, "no such termx"), (5, "x" * 200_000),
             (6, "an identifier without"), (7, "word " * 5000 + "mat")]
    ask = spark.createDataFrame(items, ITEMS).selectExpr("*", "1 as uid", "2 as n", "'x' as terms", "3 as rank")
    assert found(L.search(awkward, ask)) == brute(docs, items)
    assert found(L.search(empty, ask)) == []
    assert found(L.search(awkward, ask.limit(0))) == []


def test_ties_and_copies(spark):
    docs = [(i, "the same few words") for i in range(200, 0, -1)] + [(None, "the same few words")] * 3 + [(500 + i, f"other text {i}") for i in range(30)]
    items = [(1, "same words"), (2, "other")]
    assert found(L.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), shard_rows=50, block=8)) == brute(docs, items)
    few = docs[198:203] + docs[-3:]
    assert found(L.search(spark.createDataFrame(few, DOCS), spark.createDataFrame(items, ITEMS))) == brute(few, items)


def test_very_long_documents(spark):
    docs = [*some(9, 60), (900, "w1 w2 " * 200_000), (901, " ".join(f"v{i}" for i in range(150_000)))]
    items = [(1, "w1 w3 v77"), (2, "W2"), (3, " ".join(f"v{i}" for i in range(0, 150_000, 7)))]
    assert found(L.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), query_terms=5000)) == brute(docs, items)
