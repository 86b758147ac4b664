import math
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from riskframe.llm import gru
from riskframe.llm import lm_scoring as M


def base_figures(docs, modulus=7, held=2):
    counts = Counter()
    for i, t in docs:
        if crc32(("" if i is None else str(i)).encode()) % modulus != held:
            counts.update([*M.words(t), M.END])
    n, v = sum(counts.values()), len(counts)
    return n, {i: (len(w := [*M.words(t), M.END]), sum(counts[x] > 0 for x in w), sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w))
               for i, t in docs}


@pytest.fixture(scope="module")
def scored(small_docs):
    return M.score(small_docs).collect()


def test_base_matches_definition(scored, small_docs):
    docs = [(r.doc_id, r.text) for r in small_docs.select("doc_id", "text").collect()]
    n, want = base_figures(docs)
    assert len(scored) == len(docs)
    for r in scored:
        assert (r.n_tokens, r.n_known) == want[r.doc_id][:2] and r.train_tokens == n
        assert r.base_score == pytest.approx(want[r.doc_id][2], rel=1e-9)
        assert r.held_out == (crc32(str(r.doc_id).encode()) % 7 == 2)


def test_beats_the_base_on_held_out_documents(scored):
    held = [r for r in scored if r.held_out]
    assert sum(r.score for r in held) > 0.97 * sum(r.base_score for r in held)
    assert sum(r.score > r.base_score for r in held) / len(held) > 0.8  # 68,000 training tokens


def test_small_lexicon_gives_the_same_scores(scored, small_docs):
    # words beyond the lexicon come by the join
    other = {r.doc_id: r for r in M.score(small_docs, lexicon=2000).collect()}
    for r in scored:
        o = other[r.doc_id]
        assert (o.n_known, o.n_tokens) == (r.n_known, r.n_tokens)
        assert o.base_score == pytest.approx(r.base_score) and o.score == pytest.approx(r.score)


@pytest.mark.parametrize("piece", [64, 1 << 16])
def test_words_are_split_and_found_like_python_does(monkeypatch, piece):
    monkeypatch.setattr(M, "PIECE", piece)
    texts = ["", None, " ", "a", "The the THE été É x\x0by\tz\r\nw", "one two " * 40, "q" * 300 + " end", "\u00a0nbsp \u2003em", "b " * 5000]
    counts = Counter(w for t in texts for w in M.words(t) if len(w) < 100)
    entries = list(counts.items())[:12] + [(M.END, 5)]
    lex = M.Lexicon(entries, 4, 2, 7, np.full(7, 1e6), np.full(7, 1e5), 3)
    number = {w: i for i, w in enumerate(lex.words)}
    for t, (numbers, symbols, rare) in zip(texts, lex.encode(texts), strict=True):
        w = M.words(t)
        assert numbers.tolist() == [number.get(x, -1) for x in w]
        assert symbols.tolist() == [number[x] if number.get(x, 99) < 4 else 4 + M.spelling_class(x, 7) for x in w] + [lex.end]
        assert rare == Counter(x for x in w if x not in number)


def tiny(seed=0, hidden=5):
    s = gru.Shape(hidden, np.array([0, 1, 4, 9]), 3)
    p = gru.initial(s, np.arange(1.0, 7.0), np.arange(9.0, 0.0, -1), seed)
    return s, gru.Params(*[q.astype(np.float64) for q in p])


def step_by_step(s, p, doc, end):
    """One document, one token at a time."""
    k = s.hidden
    h, x, total = np.zeros(k), end, 0.0
    for y in doc:
        a, u = p.x[x], h @ p.u
        z, r = (1 / (1 + np.exp(-(a[i * k:(i + 1) * k] + u[i * k:(i + 1) * k]))) for i in (0, 1))
        n = np.tanh(a[2 * k:] + r * u[2 * k:])
        h = (1 - z) * n + z * h
        logits = h @ p.oc + p.bc
        c = int(gru.class_of(s, np.array([y]))[0])
        total += logits[c] - np.log(np.exp(logits).sum())
        if y < s.words:
            lo, hi = s.bounds[c], s.bounds[c + 1]
            inner = p.ow[lo:hi] @ h + p.bw[lo:hi]
            total += inner[y - lo] - np.log(np.exp(inner).sum())
        x = y
    return total


def test_score_carries_state_through_whole_documents():
    s, p = tiny()
    rng = np.random.default_rng(1)
    docs = [np.append(rng.integers(0, 12, n), 0).astype(np.int32) for n in (0, 1, 5, 70, 200, 3, 17)]
    for lanes in (1, 3, 64):
        got = gru.score(p, s, gru.Lanes(docs, 0, lanes), len(docs), window=8)
        assert got == pytest.approx([step_by_step(s, p, d, 0) for d in docs], rel=1e-5)


def test_next_token_probabilities_sum_to_one():
    s, p = tiny()
    ends = [np.array([3, 10, y], dtype=np.int32) for y in range(12)]
    before = gru.score(p, s, gru.Lanes([np.array([3, 10], dtype=np.int32)], 0, 1), 1)[0]
    assert np.exp(gru.score(p, s, gru.Lanes(ends, 0, 4), 12) - before).sum() == pytest.approx(1.0, rel=1e-5)


def test_gradients_match_differences(monkeypatch):
    monkeypatch.setattr(gru, "LOSS_EVERY", 1)
    s, p = tiny(3)
    docs = [np.array([1, 5, 10, 2, 0], dtype=np.int32), np.array([7, 0], dtype=np.int32)]
    n = sum(map(len, docs))
    lanes = gru.Lanes(docs, 0, 2)
    trainer = gru.Trainer(p, s, 1.0, window=16, start=0.0)
    grads = [np.zeros_like(q) for q in p]

    def note(which, grad, rows=slice(None)):
        grads[which][rows] += grad

    trainer._step = note
    trainer._window(lanes, 0, lanes.steps, 2, np.zeros((2, s.hidden)))
    rng = np.random.default_rng(0)
    for which, q in enumerate(p):
        for _ in range(6):
            at = tuple(rng.integers(0, d) for d in q.shape)
            e, old = 1e-2, q[at]
            loss = []
            for v in (old - e, old + e):
                q[at] = v
                loss.append(-sum(step_by_step(s, p, d, 0) for d in docs) / n)
            q[at] = old
            assert grads[which][at] == pytest.approx((loss[1] - loss[0]) / (2 * e), abs=2e-4)


def test_every_training_token_is_a_target_after_its_own_state(monkeypatch):
    s, p = tiny()
    rng = np.random.default_rng(2)
    docs = [np.append(rng.integers(1, 12, n), 0).astype(np.int32) for n in (1300, 40, 700)]
    targets, begun = [], []
    class_of, run = gru.class_of, gru._run
    monkeypatch.setattr(gru, "class_of", lambda shape, y: targets.extend(y.tolist()) or class_of(shape, y))

    def note(p, x, fresh, h, trace):
        begun.append(int(fresh.sum()))
        return run(p, x, fresh, h, trace)

    monkeypatch.setattr(gru, "_run", note)
    gru.Trainer(p, s, 0.1).fit(docs, 0)
    assert sorted(targets) == sorted(np.concatenate(docs).tolist())
    assert sum(begun) == len(docs)  # the state is set to zero where a document begins, nowhere else


def model_score(docs, rows, lex_of):
    """Final scores from the network's own log probability, one token at a time, and the counts of all other words."""
    lex, p, counts = lex_of
    out = {}
    class_n, class_v = Counter(), Counter()
    explicit = set(lex.words[:lex.shape.words])
    for w, n in counts.items():
        if w not in explicit:
            class_n[M.spelling_class(w, lex.spelling)] += n
            class_v[M.spelling_class(w, lex.spelling)] += 1
    number = {w: i for i, w in enumerate(lex.words[:lex.shape.words])}
    for i, t in rows:
        w = [*M.words(t), M.END]
        symbols = np.array([number[x] if x in number else lex.shape.words + M.spelling_class(x, lex.spelling) for x in w])
        total = step_by_step(lex.shape, p, symbols, lex.end) / math.log(10)
        for x in w:
            if x not in number:
                k = M.spelling_class(x, lex.spelling)
                total += math.log10((counts[x] + 1) / (class_n[k] + class_v[k] + 1))
        out[i] = total
    return out


@pytest.mark.parametrize("lexicon", [1 << 18, 1500])
def test_final_score_equals_the_model_token_by_token(small_docs, monkeypatch, lexicon):
    seen = {}
    fit = M.fit

    def note(encoded, lex, *rest):
        weights = fit(encoded, lex, *rest)
        seen["lex"], seen["p"] = lex, gru.from_flat(lex.shape, weights)
        return weights

    monkeypatch.setattr(M, "fit", note)
    docs = small_docs.limit(90).persist()
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: r.score for r in M.score(docs, explicit=200, spelling=20, lexicon=lexicon).collect()}
    counts = Counter()
    for i, t in rows:
        if crc32(str(i).encode()) % 7 != 2:
            counts.update([*M.words(t), M.END])
    short = sorted(rows, key=lambda r: len(r[1] or ""))[:40]
    for i, want in model_score(docs, short, (seen["lex"], seen["p"], counts)).items():
        assert got[i] == pytest.approx(want, rel=1e-4)
    docs.unpersist()


def test_scores_do_not_depend_on_partitions(scored, small_docs, monkeypatch):
    monkeypatch.setattr(M, "REPLICA_TOKENS", 20_000)  # several replicas
    one, many = ({r.doc_id: r.score for r in M.score(small_docs.repartition(n)).collect()} for n in (1, 7))
    assert one == pytest.approx(many, rel=1e-7)  # the weights are the same; a score rounds by the batch it is in


def test_a_very_long_document_among_many(spark):
    rng = np.random.default_rng(4)
    docs = [(i, " ".join(f"w{x}" for x in rng.integers(0, 300, 20))) for i in range(2000)] + [(2000, "w1 w2 w3 w4 " * 250_000)]
    lanes = gru.Lanes([np.zeros(21, dtype=np.int32)] * 2000 + [np.zeros(1_000_001, dtype=np.int32)], 0, gru.MAX_LANES)
    assert sum(x.nbytes for x in (lanes.flat, lanes.docs, lanes.first)) < 12 * 1_042_001  # bytes by tokens, not by lanes
    assert sum(int((lanes.cut(a, b, n)[2] >= 0).sum()) for a, b, n in lanes.windows(4096)) == 1_042_001
    out = {r.doc_id: r for r in M.score(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert len(out) == 2001 and out[2000].n_tokens == 1_000_001 and out[2000].score > out[2000].base_score


def test_words_of_the_network_grow_with_the_tokens():
    sizes = [M.explicit_words(n) for n in (0, 10 ** 6, 10 ** 9, 10 ** 12)]
    assert sizes[:2] == [M.EXPLICIT] * 2 and sizes[1] < sizes[2] < sizes[3]


def test_awkward_rows(awkward, empty):
    docs = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    out = M.score(awkward).collect()
    n, _ = base_figures(docs)
    assert len(out) == len(docs) and {r.train_tokens for r in out} == {n}
    by = {r.doc_id: r for r in out}
    assert by[2].n_tokens == by[3].n_tokens == by[4].n_tokens == 1 and by[7].n_tokens == 30_001
    assert all(np.isfinite([r.score, r.base_score]).all() and r.score < 0 for r in out)
    assert M.score(empty).collect() == []
    only_held = M.score(awkward.filter("doc_id = 9"), modulus=1, held=0).collect()  # nothing to learn from
    assert [(r.train_tokens, r.n_known, r.held_out) for r in only_held] == [(0, 0, True)] and np.isfinite(only_held[0].score)


def test_training_reuses_the_memory_of_a_window(monkeypatch):
    resource = pytest.importorskip("resource")
    s = gru.Shape(16, np.arange(0, 1025, 32), 96)
    rng = np.random.default_rng(5)
    docs = [np.append(rng.integers(1, 1120, 640), 0).astype(np.int32) for _ in range(512)]
    p = gru.initial(s, np.ones(s.classes), np.ones(s.words), 1)
    trainer = gru.Trainer(p, s, 0.1)
    lanes = gru.Lanes(docs, 0, 512)
    h = np.zeros((512, 16), dtype=np.float32)
    seen = []
    for a, b, live in lanes.windows(16):
        h = trainer._window(lanes, a, b, live, h[:live])
        seen.append(resource.getrusage(resource.RUSAGE_SELF).ru_minflt)
    assert seen[-1] - seen[19] < 200 * (len(seen) - 20)  # page faults; some 2,000 a window before
