import random
import re
import string

import pytest

from riskframe.llm import secret_scan as S
from riskframe.llm.queries import QUERIES

ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


TRICKY = [
    "password: token = \"abcdefgh\"", "token=api_key=abcdef", "PassWord'  :  'x.y/z=-+_'", "api_key:12345", "apikey = 123456 secret=",
    "é😀 secret = zzzzzz 😀 token:abcdefg", "AKIA" + "A" * 15 + " AKIA" + "B" * 16, "AKIAAKIA" + "C" * 12, "a" * 23 + " " + "b" * 24 + "g" + "c" * 30,
    "tokentoken=abcdef", "secret==abcdef", "paſſword=abcdef toKen=abcdef", "token = " + "0123456789abcdef" * 2, "", None,
]


def test_base_spans_match_python(spark, small_docs):
    rows = [(i, t) for i, t in enumerate(TRICKY)]
    rows += [(1000 + r.doc_id, r.text) for r in small_docs.select("doc_id", "text").collect()]
    out = {r.doc_id: r for r in S.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        want = base(t)
        assert out[i].base_spans == want, t
        assert [out[i].n_assign, out[i].n_access, out[i].n_hex] == [want.count(k + ":") for k in S.BASE]
        assert set(filter(None, want.split(","))) <= set(out[i].spans.split(","))


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(5)
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
    words = lambda n: " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 12))) for _ in range(n))
    draw = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    keys = {0: lambda: draw(string.ascii_letters + string.digits + "+/", 40), 1: lambda: draw("0123456789ABCDEF", 40),
            2: lambda: draw(string.ascii_lowercase, 32), 3: lambda: words(20).upper().replace(" ", ""),
            4: lambda: "-" * 40 + " " + "=" * 30 + " " + "xy" * 20 + " 12345678901234567890123"}
    rows = []
    for i in range(300):
        key = keys[i % 10]() if i % 10 in keys else ""
        rows.append((i, words(150) + " " + key + " " + words(20), key))
    df = spark.createDataFrame(rows, "doc_id long, text string, key string")
    return {r.doc_id: r for r in S.scan(df).collect()}, {r[0]: r for r in rows}


def test_battery_finds_keys_and_leaves_writing(planted):
    out, rows = planted
    for i, r in out.items():
        random_spans = [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s.startswith("random")]
        if i % 10 in (0, 1, 2):
            assert [rows[i][1][a:b] for a, b in random_spans] == [rows[i][2]]
        else:
            assert random_spans == [], rows[i][2]


def test_spans_are_ordered_and_do_not_repeat_base(planted):
    out, _ = planted
    for r in out.values():
        starts = [int(s.split(":")[1]) for s in r.spans.split(",") if s]
        assert starts == sorted(starts)


def test_awkward_rows(awkward, empty):
    out = S.scan(awkward).collect()
    assert len(out) == awkward.count()
    text = {r.doc_id: r.text for r in awkward.collect()}
    assert all(r.base_spans == base(text[r.doc_id]) for r in out if r.doc_id is not None)
    assert S.scan(empty).collect() == []


def test_plan_has_no_python(spark):
    plan = QUERIES["op5_secret_scan"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
