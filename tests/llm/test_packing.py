import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from riskframe.llm import packing as P


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(P.default_tokenizer())


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, P.END_ID]


def test_ids_are_the_tokenizers(tokenizer, small_docs):
    encode = P._encoder(P.default_tokenizer())
    texts = [r.text for r in small_docs.select("text").collect()]
    texts += ["", " ", "\n\n a  b\t", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "été 😀  x", "x" * 5000, "don't I'LL we've", "1234 5,678"]
    for t in texts:
        assert encode(t).tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def check(rows, docs, tokenizer, capacity):
    """Pieces rebuild every document; sequences are gapless and fit."""
    want = defaultdict(list)
    for doc_id, text in docs:
        want[doc_id].append(ids_of(tokenizer, text))
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for doc_id, versions in want.items():
        pieces = []
        for ids in versions:
            first = len(ids) % capacity or capacity
            cuts = [0, *range(first, len(ids) + 1, capacity)]
            pieces += [(k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
        assert sorted(got[doc_id]) == sorted(pieces)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


def test_pack_matches_sequential_best_fit(small_docs, tokenizer):
    rows = P.best_fit_pack(small_docs).collect()
    n = check(rows, [(r.doc_id, r.text) for r in small_docs.select("doc_id", "text").collect()], tokenizer, 1024)
    assert n <= best_fit_decreasing([r.length for r in rows], 1024)
    assert n <= 1.02 * sum(r.length for r in rows) / 1024 + 1


@pytest.mark.parametrize("seed", range(5))
def test_moves_are_a_packing_as_good_as_best_fit(seed):
    rng = np.random.default_rng(seed)
    capacity = 100
    lengths = rng.integers(1, [100, 30, 60, 100, 10][seed] + 1, 500).tolist()
    counts = {n: lengths.count(n) for n in set(lengths)}
    fill, taken = defaultdict(list), defaultdict(int)
    for n, rank, count, first, offset in P.plan_moves(counts, capacity):
        for i in range(count):
            fill[first + i].append((offset, n))
        taken[n] += count
        assert rank + count <= counts[n]
    assert dict(taken) == counts
    for own in fill.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= capacity
    assert len(fill) <= best_fit_decreasing(lengths, capacity)


def test_awkward_rows(awkward, empty, tokenizer):
    rows = P.best_fit_pack(awkward, capacity=64).collect()
    check(rows, [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()], tokenizer, 64)
    assert P.best_fit_pack(empty).collect() == []


def test_hot_length(spark, tokenizer):
    docs = spark.range(2000).selectExpr("id as doc_id", "if(id % 3 = 0, '', concat('some words ', id)) as text")
    rows = P.best_fit_pack(docs, capacity=32, buckets=4).collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()], tokenizer, 32)


def test_a_dotted_name_and_one_row_many_times(spark):
    rows = [(7, "the same few words")] * 3000 + [(None, "no identifier here")] * 1000 + [(i, "word " * (i % 90)) for i in range(500)]
    df = spark.createDataFrame(rows, "`my.id` long, `my.text` string")
    out = P.best_fit_pack(df, id_col="my.id", text_col="my.text").toPandas()
    assert len(out) == 4500
    for _, s in out.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert (s["offset"].to_numpy() == s["length"].cumsum().to_numpy() - s["length"].to_numpy()).all() and s["length"].sum() <= 1024
    assert out["sequence_id"].nunique() == -(-out["length"].sum() // 1024)
