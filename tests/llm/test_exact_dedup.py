import hashlib
from collections import defaultdict

import pytest

from riskframe.llm import exact_dedup as X


def norm(t):
    return (t or "").encode().lower()


@pytest.mark.parametrize(("keep", "leaves", "fan_bits"), [("largest", None, 3), ("smallest", 16, 1), ("largest", 8, 2)])
def test_groups_match_brute_force(spark, small_docs, keep, leaves, fan_bits):
    rows = small_docs.select("doc_id", "text").collect()
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r.text)].append(r.doc_id)
    pick = max if keep == "largest" else min
    out = X.exact_dedup(small_docs, keep=keep, leaves=leaves, fan_bits=fan_bits).withColumn("sha", X.sha256_hex()).collect()
    text = {r.doc_id: r.text for r in rows}
    assert len(out) == len(rows)
    for r in out:
        own = groups[norm(text[r.doc_id])]
        assert (r.keep_id, r.group_size, r.kept) == (pick(own), len(own), r.doc_id == pick(own))
        assert r.sha == hashlib.sha256(norm(text[r.doc_id])).hexdigest()


def test_awkward_rows(awkward, empty):
    out = X.exact_dedup(awkward).collect()
    assert len(out) == awkward.count()
    by = defaultdict(list)
    for r in out:
        by[r.doc_id].append(r)
    assert {(r.keep_id, r.group_size) for r in by[0] + by[1]} == {(1, 3)}
    assert sorted(r.kept for r in by[0] + by[1]) == [False, False, True]  # of the repeated row one stays
    assert {(r.keep_id, r.group_size) for r in by[2] + by[3]} == {(3, 3)}  # null counts as empty
    assert by[5][0].keep_id == 5 and by[6][0].keep_id == 6  # only A-Z is folded
    assert X.exact_dedup(empty).collect() == []


def test_rows_that_stay_keep_their_columns(awkward):
    out = X.keep_one_of_each(awkward)
    assert out.columns == awkward.columns
    texts = [norm(r.text) for r in out.collect()]
    assert len(texts) == len(set(texts)) == len({norm(r.text) for r in awkward.select("text").collect()})


def test_hot_group(spark):
    # a third of all rows are copies of one text
    docs = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'Same text', concat('text ', id)) as text").repartition(7)
    out = X.exact_dedup(docs, leaves=64)
    assert out.filter("kept").count() == 2001
    assert {(r.keep_id, r.group_size) for r in out.filter("doc_id % 3 = 0").collect()} == {(2997, 1000)}
