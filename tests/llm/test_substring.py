from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from riskframe.llm import substring_dedup as S
from riskframe.llm.common import row_keys


def parts_of(text):
    raw = (text or "").encode()
    ends, words = S.sentences(raw)
    return [raw[a:e] for a, e in zip([0, *ends], ends, strict=False)], words


def brute(docs, run=S.RUN, min_words=S.MIN_WORDS):
    """doc_id -> positions of the sentences that go; spans kept as word tuples, not hashes."""
    occurrences = defaultdict(list)
    parts = {}
    for i, t in docs:
        parts[i], words = parts_of(t)
        for a in range(len(words)):
            e = next((e for e in range(a + run, len(words) + 1) if sum(map(len, words[a:e])) >= min_words), None)
            if e:
                occurrences[tuple(map(tuple, words[a:e]))].append((i, a, e))
    gone = defaultdict(set)
    for places in occurrences.values():
        for i, a, e in sorted(places)[1:]:
            gone[i].update(range(a, e))
    return parts, gone


@pytest.mark.parametrize("partitions", [1, 7])
def test_matches_brute_force(small_docs, partitions):
    small_docs = small_docs.repartition(partitions)
    docs = [(r.doc_id, r.text) for r in small_docs.select("doc_id", "text").collect()]
    parts, gone = brute(docs)
    out = S.remove_repeats(small_docs).collect()
    assert len(out) == len(docs) and any(gone.values())
    for r in out:
        assert r.n_removed == len(gone[r.doc_id])
        assert r.text.encode() == b"".join(p for i, p in enumerate(parts[r.doc_id]) if i not in gone[r.doc_id])


def test_span_hashes_depend_on_content_and_order_only():
    words = [[b"a", b"b"], [b"c"], [b"d"], [b"a", b"b"], [b"c"], [b"d"], [b"c"], [b"a", b"b"], [b"d"]]
    n, h = S.spans(words, run=3, min_words=1)
    assert n.tolist() == [3] * 7
    keys = [tuple(col) for col in h.T.tolist()]
    assert keys[0] == keys[3] and len(set(keys)) == 6
    n, h = S.spans(words, run=3, min_words=6)
    assert n.tolist() == [5, 5, 4, 5, 4] or all(sum(map(len, words[i:i + k])) >= 6 for i, k in enumerate(n.tolist()))


@pytest.mark.parametrize("text", ["", " ", "\n", "a", " a b. c", "A. B! C?\n\n D e.f g\n  \nh", "x\r\ny \n\n", "w " * 40 + ". z", "\n\n a.\n",
                                  "one. two! three? four... five", "many words without an end " * 30])
def test_sentences_rebuild_the_text(text):
    raw = text.encode()
    ends, words = S.sentences(raw)
    assert ends == sorted(set(ends)) and len(ends) == len(words) and all(words)
    assert [w for s in words for w in s] == raw.lower().split()
    assert (ends[-1] if ends else len(raw)) == len(raw) or not raw.split()


def passage(n, seed, punctuated=True):
    import random
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n)]
    if punctuated:
        for i in range(6, n, 7):
            words[i] += "."
    return " ".join(words)


@pytest.mark.parametrize("punctuated", [True, False])
def test_long_passages_are_caught(spark, punctuated):
    shared = passage(55, 0, punctuated)
    docs = [(i, passage(120, 10 + i, punctuated) + " " + shared + " " + passage(90, 50 + i, punctuated)) for i in range(8)]
    docs += [(100 + i, passage(200, 200 + i, punctuated)) for i in range(5)]
    out = {r.doc_id: r for r in S.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out[0].n_removed == 0 and out[0].text == docs[0][1]  # the first stays
    for i in range(1, 8):
        left = len(docs[i][1].split()) - len(out[i].text.split())
        assert 30 <= left <= 55 + 20
    assert all(out[100 + i].n_removed == 0 for i in range(5))


def test_awkward_rows(awkward, empty):
    out = S.remove_repeats(awkward).collect()
    assert len(out) == awkward.count()
    by = defaultdict(list)
    for r in out:
        by[r.doc_id].append(r)
    assert [r.n_removed for r in by[0]] == [0] and [r.n_removed for r in by[1]] == [3, 3]  # a repeated row shares its result
    assert {r.text for r in by[1]} == {""} and by[2][0].text == ""
    assert S.remove_repeats(empty).collect() == []


def test_hot_passage(spark):
    shared = passage(60, 1)
    docs = spark.createDataFrame([(i, shared if i % 3 == 0 else passage(40, 1000 + i)) for i in range(300)], "doc_id long, text string").repartition(9)
    out = S.remove_repeats(docs).collect()
    assert sorted(r.doc_id for r in out if r.n_removed) == list(range(3, 300, 3))


def test_rows_without_an_id_are_told_apart_by_the_whole_key(spark):
    passage = "One two three four five six. Seven eight nine ten eleven twelve. Last three words are here now. "
    own = F.concat(*[F.concat(F.lit(f"{w}a"), F.col("id"), F.lit(f" {w}b c d e f. ")) for w in "pqrstu"])
    texts = (spark.range(30_000).withColumn("with_passage", F.col("id") % 2 == 0).withColumn("doc_id", F.lit(None).cast("bigint"))
             .withColumn("text", F.concat(F.when(F.col("with_passage"), F.lit(passage)).otherwise(F.lit("")), own)))
    met = defaultdict(list)
    for r in texts.select("with_passage", "text", (row_keys("doc_id", "text")[0].bitwiseAND(F.lit((1 << 23) - 1))).alias("low")).collect():
        met[r.low].append(r)
    pairs = [v for v in met.values() if len(v) > 1]  # the low 23 bits are alike, the texts are not
    both = next(v[:2] for v in pairs if v[0].with_passage and v[1].with_passage)
    one = next(v[:2] for v in pairs if v[0].with_passage != v[1].with_passage)
    kind = "doc_id long, text string"
    out = S.remove_repeats(spark.createDataFrame([(None, r.text) for r in both], kind)).collect()
    assert sorted(r.n_removed for r in out) == [0, 3]
    out = S.remove_repeats(spark.createDataFrame([(1, passage), *[(None, r.text) for r in one]], kind)).collect()
    assert sorted((r.n_removed, r.text) for r in out if r.doc_id is None) == sorted(
        (3 if r.with_passage else 0, r.text.replace(passage, "")) for r in one)


@pytest.mark.parametrize("words", [51, 55, 60])
def test_every_shared_passage_of_running_text_holds_a_common_span(words):
    missed = 0
    for seed in range(400):
        shared = passage(words, seed, False)
        a, b = (" ".join([passage(30, 10_000 + seed + k, False), shared, passage(40, 20_000 + seed + k, False)]).encode() for k in (0, 500))
        keys = [set(map(tuple, S.spans(S.sentences(t)[1])[1].T.tolist())) for t in (a, b)]
        missed += not keys[0] & keys[1]
    assert missed == 0


def test_cuts_lie_close(small_docs):
    text = passage(3000, 3, False).encode()
    _, words = S.sentences(text)
    assert max(map(len, words)) <= S.CUT_WITHIN and 4 < 3000 / len(words) < 8


def test_scripts_without_spaces(spark):
    import random
    rng = random.Random(7)
    han = [chr(0x4E00 + i) for i in range(3000)]
    text = lambda n: "".join(rng.choice(han) + ("。" if i % 23 == 22 else "") for i in range(n))
    shared, line = text(120), "".join(rng.choice(han) for _ in range(110))
    docs = [(i, f"{text(200)}{shared}{text(150)}") for i in range(4)] + [(10 + i, f"{text(90)}\n{text(40)}{line}{text(80)}") for i in range(3)]
    docs += [(20, text(500)), (21, "".join(rng.choice(han) for _ in range(2000))), (22, "ภาษาไทย" * 3 + "".join(rng.choice("กขคงจฉชซ") for _ in range(300)))]
    out = {r.doc_id: r for r in S.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(out[i].n_removed == 0 and out[i].text == dict(docs)[i] for i in (0, 10, 20, 21, 22))
    for i in (1, 2, 3):
        assert 60 <= len(dict(docs)[i]) - len(out[i].text) <= len(shared) + 40
    for i in (11, 12):
        assert 60 <= len(dict(docs)[i]) - len(out[i].text) <= len(line) + 40
    raw = dict(docs)[21].encode()
    ends, words = S.sentences(raw)
    assert ends[-1] == len(raw) and sum(map(len, words)) == 2000 and max(map(len, words)) <= S.CUT_WITHIN
