import hashlib
import random
import zlib

import pytest
import xxhash

from riskframe.llm import prefix_trie as T
from riskframe.llm.queries import op11_prefix_trie

KIND = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _hash(*parts):
    seed = 42
    for p in parts:
        seed = xxhash.xxh64_intdigest(p.encode(), seed=seed)
    return seed - (1 << 64) if seed >> 63 else seed


def rebuild(rows, every=100, modulus=6):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, _hash(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % modulus
        base = c - int(c - every * int(c / every))
        out[c] = own.get(base, [])[:h] + ts[h:]
    return out


def brute(rows, every=100, modulus=6):
    convs = rebuild(rows, every, modulus)
    members = {}
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    out = []
    for p, cs in members.items():
        below = [v for v in members if v[:len(p)] == p]
        children = [v for v in below if len(v) == len(p) + 1]
        leaves = [v for v in below if not any(w[:len(v)] == v and len(w) > len(v) for w in below)]
        saved = sum((len(members[v]) - 1) * len(v[-1][1]) for v in below if v)
        ending = ",".join(str(c) for c in sorted(c for c in cs if len(convs[c]) == len(p)))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(children), len(leaves), saved,
                    hashlib.sha256(ending.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def some(seed, convs, turns, words=2):
    r = random.Random(seed)
    rows = [(c, t, r.choice(["user", "bot"]), "é" * r.randint(0, words)) for c in convs for t in range(r.randint(1, turns))]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "convs", "turns", "width"), [
    (1, range(90, 140), 4, 8), (2, [*range(0, 30), *range(100, 130)], 7, 2), (3, range(-120, -90), 5, 3), (4, range(200, 212), 30, 4),
    (5, range(300, 310), 1, 1)])
def test_matches_brute_force(spark, seed, convs, turns, width):
    rows = some(seed, convs, turns)
    assert found(T.prefix_trie(spark.createDataFrame(rows, KIND).repartition(3), width=width)) == brute(rows)


def test_awkward_rows(spark):
    rows = [*some(6, range(100, 112), 3), (None, 1, "user", "x"), (None, None, None, None), (104, None, "user", "first of all"),
            (104, None, None, None), (105, 0, "user", "a tie"), (105, 0, "user", "b tie"), (106, 1, "u", "again"), (106, 1, "u", "again"),
            (107, 5, None, ""), (107, 6, "", None), (108, 0, "user", "long " * 50_000), (110_000_000_017, -3, "user", "q")]
    df = spark.createDataFrame(rows, KIND).selectExpr("*", "1 as pos", "2 as block", "3 as chars", "4 as key1", "'x' as h", "5 as depth")
    assert found(T.prefix_trie(df)) == brute(rows)
    assert found(T.prefix_trie(df.limit(0))) == []


def test_one_conversation_with_most_turns_and_one_shared_by_most(spark):
    rows = [(100, t, "u", f"t{t % 5}") for t in range(150)] + [(c, t, "u", f"s{t}") for c in range(200, 290) for t in range(8)]
    assert found(T.prefix_trie(spark.createDataFrame(rows, KIND), width=4)) == brute(rows)


def test_pieces_of_a_hot_end(spark, monkeypatch):
    monkeypatch.setattr(T, "PIECE", 20)
    rows = [(c, 0, "u", "same") for c in range(1000, 1400) if zlib.crc32(str(c).encode()) % 6 == 0]
    assert found(T.prefix_trie(spark.createDataFrame(rows, KIND))) == brute(rows)


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(op11_prefix_trie(spark, sf)) == brute(rows)
