import math
import random
import string
from collections import Counter, defaultdict

import numpy as np
import pytest

from riskframe.llm import language_id as L

VERDICT = ["lang_pred", "score", "bits", "length", "rejected"]


def brute_codes(text):
    out = []
    for ch in text.lower():
        if ch.isalpha():
            out.append(ch)
        elif out and out[-1] != " ":
            out.append(" ")
    return "".join(out).strip()


class BruteModel:
    """Interpolated Kneser-Ney with dictionaries, straight from the formulas."""

    def __init__(self, texts, symbols):
        self.n3 = Counter()
        for t in texts:
            x = "  " + brute_codes(t)
            self.n3.update(x[i:i + 3] for i in range(len(x) - 2))
        self.n2 = Counter(g[1:] for g in self.n3)
        self.n1 = Counter(g[1:] for g in self.n2)
        self.symbols = symbols
        self.d = {k: self.discount(n) for k, n in ((3, self.n3), (2, self.n2), (1, self.n1))}
        self.sum, self.kinds = defaultdict(int), defaultdict(int)
        for n in (self.n3, self.n2, self.n1):
            for g, c in n.items():
                self.sum[len(g), g[:-1]] += c
                self.kinds[len(g), g[:-1]] += 1

    @staticmethod
    def discount(n):
        one, two = sum(c == 1 for c in n.values()), sum(c == 2 for c in n.values())
        return one / (one + 2 * two) if one and two else 0.5

    def p(self, g):
        if not g:
            return 1 / self.symbols
        n = {3: self.n3, 2: self.n2, 1: self.n1}[len(g)]
        total = self.sum[len(g), g[:-1]]
        if not total:
            return self.p(g[1:])
        d = self.d[len(g)]
        return max(n[g] - d, 0) / total + d * self.kinds[len(g), g[:-1]] / total * self.p(g[1:])

    def bits(self, text):
        x = "  " + brute_codes(text)
        return sum(-math.log2(self.p(x[i:i + 3])) for i in range(len(x) - 2))


def counts(texts):
    key, n = np.unique(np.concatenate([L.trigrams(L.codes(t)) for t in texts]), return_counts=True)
    return key, n


def test_model_matches_formulas():
    train = {"a": ["the cat sat on the mat", "that is the thing, there!"], "b": ["le chat est sur la table", "été à la plage"]}
    m = L.fit({k: counts(v) for k, v in train.items()})
    symbols = len({c for v in train.values() for t in v for c in "  " + brute_codes(t)}) + 1
    brute = {k: BruteModel(v, symbols) for k, v in train.items()}
    tests = ["the chat", "zzz qqq", "été", "x", "A  B\n\nthe; that", "ßß the"]
    bits, length = L.bits_of(m, tests)
    for i, t in enumerate(tests):
        assert length[i] == len(brute_codes(t))
        assert bits[i] == pytest.approx([brute[k].bits(t) for k in m.langs], rel=1e-9)


def pruned(t, tri, bi):
    """Tables with only some entries stored."""
    return t._replace(tri=t.tri[tri], n3=t.n3[tri], bi=t.bi[bi], n2=t.n2[bi], total3=t.total3[bi], kinds3=t.kinds3[bi])


def test_pruned_entries_go_to_the_back_off_and_sums_stay_one():
    t = L.tables(*counts(["abcab bca cabba acb bac", "cab abc cba"]))
    rng = np.random.default_rng(1)
    whole = L.fit_tables({"a": t})
    m = L.fit_tables({"a": pruned(t, np.flatnonzero(rng.random(len(t.tri)) < 0.5), np.flatnonzero(rng.random(len(t.bi)) < 0.7))})
    chars = [ord(c) for c in " abc"]
    for a in chars:
        for b in chars:
            keys = np.array([(a << 42) | (b << 21) | c for c in [*chars, 0x7A]], dtype=np.uint64)
            assert np.exp2(L.log_probs(m, keys)).sum() == pytest.approx(1.0)
    kept = m.tri_p[np.isin(m.tri, whole.tri)]
    assert len(kept) < len(whole.tri) and len(m.uni) == len(whole.uni) and (m.unknown_p == whole.unknown_p).all()


def test_spark_sums_give_the_same_model_and_limits_prune_only(spark, small_docs):
    texts = {}
    for r in small_docs.select("lang", "text").dropna().collect():
        texts.setdefault(r.lang, []).append(r.text)
    want = L.fit({k: counts(v) for k, v in texts.items()})
    got = L.train(small_docs)
    for a, b in zip(got[1:], want[1:], strict=True):
        assert np.allclose(a, b)
    some = L.train(small_docs, max_ngrams=500)
    assert (some.unknown_p == want.unknown_p).all() and np.allclose(some.uni_p, want.uni_p)  # from all counts
    assert len(some.tri) < len(want.tri) / 2
    a, b = (L.identify(small_docs, m, "true").select("__k1", "lang_pred").toPandas().sort_values("__k1")["lang_pred"].tolist() for m in (want, some))
    assert np.mean([x == y for x, y in zip(a, b, strict=True)]) > 0.99


def test_fifty_languages_have_a_bounded_model(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(string.ascii_lowercase[i % 20:i % 20 + 6] + " ") for _ in range(3000)), f"l{i:02d}") for i in range(50)]
    m = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(m.langs) == 50 and m.tri_p.size <= L.MAX_CELLS and m.bi_p.size <= L.MAX_CELLS


def test_another_script_does_not_lift_the_limits(spark, small_docs):
    rng = random.Random(6)
    pool = [chr(0x4E00 + i) for i in range(4000)]
    chinese = [(2000 + i, "".join(rng.choice(pool) for _ in range(2000)), "zh") for i in range(8)]
    # a Latin-script language that nothing was learned of: syllables of its own
    syllables = [c + v + d for c in "kxqjzwv" for v in "uoyi" for d in "kqxjz"]
    strange = [(3000 + i, " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(120)), None) for i in range(5)]
    kind = "doc_id long, text string, lang string"
    learn = small_docs.select("doc_id", "text", "lang").union(spark.createDataFrame(chinese, kind))
    out = L.identify(learn.union(spark.createDataFrame(strange, kind)), L.train(learn), "doc_id < 3000").collect()
    rejected = {r.doc_id for r in out if r.rejected}
    assert {i for i, *_ in strange} <= rejected and len(rejected) <= 5 + 0.01 * len(out)


def test_probabilities_sum_to_one():
    m = L.fit({"a": counts(["abcab bca", "cab"])})
    chars = [ord(c) for c in " abc"]
    for context in ((32, 32), (97, 98), (99, 99), (120, 121)):
        keys = np.array([(context[0] << 42) | (context[1] << 21) | c for c in [*chars, 0x7A]], dtype=np.uint64)
        assert np.exp2(L.log_probs(m, keys)).sum() == pytest.approx(1.0)  # the unknown character included


def test_codes_and_long_texts(monkeypatch):
    for t in ["", "  ", "Ab--c 1", "É!é", "a" * 10, "..x..y..", "ıİß"]:
        assert "".join(map(chr, L.codes(t))) == brute_codes(t)
    m = L.fit({"a": counts(["abc cab bca"]), "b": counts(["xyz abc"])})
    text = "abc xyz cab " * 50
    whole = L.bits_of(m, [text, None, text])
    monkeypatch.setattr(L, "CHUNK", 16)
    pieces = L.bits_of(m, [text, None, text])
    assert np.allclose(whole[0], pieces[0]) and (whole[1] == pieces[1]).all() and whole[1][1] == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = L.split_and_identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert len(out) == 1000 and len(held) > 100
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in out) and not any(r.rejected for r in out)  # clean documents stay


def test_lang_source_and_id_are_no_input(spark, small_docs):
    model = L.train(small_docs.filter("doc_id % 2 = 0"))
    a = L.identify(small_docs, model, "true").select("__k1", *VERDICT).toPandas().sort_values("__k1").reset_index(drop=True)
    other = small_docs.selectExpr("doc_id", "text", "'xx' as lang", "'yy' as source")
    b = L.identify(other, model, "true").select("__k1", *VERDICT).toPandas().sort_values("__k1").reset_index(drop=True)
    assert a.equals(b)


def test_rejects_what_is_no_language(spark, small_docs):
    rng = random.Random(2)
    junk = [(1000 + i, "".join(rng.choice(string.ascii_letters) for _ in range(400))) for i in range(5)]
    docs = small_docs.select("doc_id", "text").union(spark.createDataFrame(junk, "doc_id long, text string"))
    out = L.identify(docs, L.train(small_docs), "doc_id < 1000", keep=()).collect()
    assert {r.doc_id for r in out if r.rejected} == {1000, 1001, 1002, 1003, 1004}


def test_awkward_rows(awkward, empty):
    out = L.split_and_identify(awkward).collect()
    assert len(out) == awkward.count()
    for r in out:
        if r.doc_id in (2, 3, 4, 9):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
    assert {r.lang_pred for r in out} <= {"und", "en", "fr", "de"}
    kept = L.keep_identified(awkward)
    assert kept.columns == awkward.columns and kept.filter("doc_id = 1").count() == 2  # repeated rows stay
    assert L.split_and_identify(empty).collect() == []
    none = L.split_and_identify(awkward.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()
    assert {r.lang_pred for r in none} == {"und"}
