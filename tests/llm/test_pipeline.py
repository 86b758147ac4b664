from collections import Counter, defaultdict

import pytest
from test_packing import check, tokenizer  # noqa: F401
from test_simhash import brute_components, brute_fingerprint

import corpus_pipeline as C
from riskframe.llm import mixing
from riskframe.llm.common import pin
from riskframe.llm.queries import MIX_WEIGHTS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, f in C.STAGES:
        out.append(pin(f(spark, out[-1], SF), name))
    return out


def test_stages_are_the_dealt_ones(stages):
    assert [n for n, _ in C.STAGES] == ["language_id", "exact_dedup", "simhash_dedup", "source_mixing", "best_fit_packing"]
    for before, after in zip(stages[:-2], stages[1:-1], strict=True):
        assert after.columns == before.columns


def test_clean_documents_pass_language_id(stages):
    assert stages[1].count() == stages[0].count()


def test_exact_copies_go(stages):
    best = {}
    for r in stages[1].collect():
        key = (r.text or "").encode().lower()
        best[key] = max(best.get(key, -1), r.doc_id)
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(best.values())


def test_one_of_each_near_group_stays(stages):
    rows = stages[2].collect()
    fp = {r.doc_id: brute_fingerprint(r.text) for r in rows}
    comp = brute_components(sorted(set(fp.values())))
    least = defaultdict(lambda: 1 << 60)
    for d, f in fp.items():
        least[comp[f]] = min(least[comp[f]], d)
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted(least.values())


def test_mix_selects_by_weight(stages):
    want = Counter(r.doc_id for r in mixing.mix(stages[3], MIX_WEIGHTS, share=(1, 1), max_epochs=2, seed=7).collect())
    assert Counter(r.doc_id for r in stages[4].collect()) == want


def test_sequences_hold_all_documents(stages, tokenizer):  # noqa: F811
    check(stages[5].collect(), [(r.doc_id, r.text) for r in stages[4].collect()], tokenizer, 1024)


def test_run_gives_the_last_stage(spark, stages):
    # sequence numbers are free; pieces are not
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    a = sorted(map(tuple, C.run(spark, SF).select(*key).collect()))
    assert a == sorted(map(tuple, stages[5].select(*key).collect()))


def test_awkward_rows(spark, awkward, empty):
    for docs in (awkward.select("doc_id", "text", "lang", "source", "n_chars"), empty.select("doc_id", "text", "lang", "source", "n_chars")):
        for name, f in C.STAGES:
            docs = pin(f(spark, docs, SF), name)
        docs.count()
