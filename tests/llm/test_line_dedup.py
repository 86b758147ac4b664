import random

import pytest

from riskframe.llm import line_dedup as L

KIND = "doc_id long, text string"


def low(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def brute(rows, min_chars=20, min_docs=3):
    split = [(i, (t or "").split("\n")) for i, t in rows]
    key = lambda x: low(x.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for n, (_, parts) in enumerate(split):
        for k in {key(p) for p in parts}:
            holders.setdefault(k, set()).add(n)
    out = []
    for i, parts in split:
        def gone(p, i=i):
            k = key(p)
            if len(k) < min_chars or len(holders[k]) < min_docs:
                return False
            known = [split[n][0] for n in holders[k] if split[n][0] is not None]
            return i != (max(known) if known else None)
        stay = [p for p in parts if not gone(p)]
        out.append((i, len(parts), len(parts) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_lines", "n_dropped", "kept_text").collect()), key=str)


def some(seed, docs, pool):
    r = random.Random(seed)
    texts = [f"{'Shared' if n % 2 else 'ÉTÉ commun'} line number {n} " + "z" * (n % 9) for n in range(pool)]
    rows = [(i, "\n".join(r.choice([" ", "", "\t", "\x0b"]) + r.choice([t.upper(), t, low(t)]) + r.choice(["", "  ", "\r"])
                          for t in r.choices(texts, k=r.randint(0, 9)))) for i in range(docs)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "batches", "fan"), [(1, 6, 3), (2, 1, 2), (3, 9, 2), (4, 4, 9)])
def test_matches_brute_force(spark, seed, batches, fan):
    rows = some(seed, 150, 120)
    assert found(L.dedup_lines(spark.createDataFrame(rows, KIND).repartition(3), batches=batches, fan=fan)) == brute(rows)


def test_runs_are_compacted_and_settled_lines_are_not_added_again(spark, monkeypatch):
    rows = [(i, "a line that every document holds\n" + f"a line of document {i} alone") for i in range(60)]
    written = []
    write = L.LineRuns._write
    monkeypatch.setattr(L.LineRuns, "_write", lambda self, e, level: (write(self, e, level), written.append((level, self.spark.table(self.levels[level][-1]).count()))))
    assert found(L.dedup_lines(spark.createDataFrame(rows, KIND), batches=6, fan=3)) == brute(rows)
    assert [x for x, _ in written] == [0, 0, 0, 1, 0, 0, 0, 1]
    assert written[0][1] == written[1][1] + 1  # the shared line is settled after the first batch
    assert sum(n for x, n in written if x == 0) == 61
    assert spark.sql("SHOW TABLES LIKE 'line_run_*'").count() == 0


def test_plan_moves_the_batch_only(spark):
    rows = some(7, 60, 50)
    cells = L.line_hashes(spark.createDataFrame(rows, KIND), "doc_id", "text", 20)
    runs = L.LineRuns(spark, 3, 9)
    runs.add(L.documents_of_lines(cells))
    settled = spark.table(runs.levels[0][0]).filter("n >= 3").select(*L.HASH)
    plan = L.documents_of_lines(cells).join(settled.hint("merge"), L.HASH, "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Python" not in plan and "Arrow" not in plan
    runs.frequent()


def test_awkward_rows(spark, awkward, empty):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert found(L.dedup_lines(awkward, min_chars=5, min_docs=2)) == brute(rows, 5, 2)
    assert found(L.dedup_lines(empty)) == []


def test_ties_repeats_nulls_and_long_texts(spark):
    line = "a line which many documents hold"
    rows = [(5, line), (5, line), (5, f"{line}\nmore"), (1, line), (None, line), (None, None), (2, ""), (3, "\n\n"), (4, f"{line}\n" * 20_000),
            (9, "only once: " + "w" * 300_000)] + [(None, "held by rows without an id only")] * 4 + [(6, "exactly nineteen ch")] * 3 + [(7, "exactly twenty chars")] * 2 \
        + [(8, "ÀÉ exactly twenty ch"), (1, "àé exactly twenty ch")]
    assert found(L.dedup_lines(spark.createDataFrame(rows, KIND))) == brute(rows)


def test_one_row_repeated_by_a_third(spark):
    rows = [(3, "the same row again and again\nand its second line, shared")] * 400 + some(8, 800, 200)
    assert found(L.dedup_lines(spark.createDataFrame(rows, KIND))) == brute(rows)
