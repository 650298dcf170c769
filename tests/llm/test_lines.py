"""Lines that many documents share: runs against brute force, batches in any order, edge rows."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from playerlytics.llm import lines

from .conftest import docs_df

BLANKS = " \t\n\x0b\x0c\r"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(BLANKS).translate(FOLD)


def brute(rows, least_chars, least_docs):
    """Rows as documents; null ids come before all others."""
    low = float("-inf")
    docs, top = defaultdict(int), defaultdict(lambda: low)
    for i, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            docs[k] += 1
            top[k] = max(top[k], low if i is None else i)
    out = []
    for i, text in rows:
        parts = (text or "").split("\n")
        kept = [x for x in parts if len(key(x)) < least_chars or docs[key(x)] < least_docs
                or (low if i is None else i) >= top[key(x)]]
        out.append((i, "\n".join(kept), len(parts), len(parts) - len(kept)))
    return sorted(out, key=str)


def found(spark, rows, extra="", **kw):
    return sorted((tuple(r) for r in lines.without_repeated_lines(docs_df(spark, rows, extra), **kw).toLocalIterator()), key=str)


@pytest.mark.parametrize("seed,batches,fanout", [(0, 5, 2), (1, 1, 4), (2, 9, 3)])
def test_equals_brute_force(spark, seed, batches, fanout):
    rng = random.Random(seed)
    pool = [f"{'  ' * (i % 2)}Shared line {i} É" + "x" * (i % 7) + "\t" * (i % 3) for i in range(25)]
    rows = [(i, "\n".join(rng.choice(pool).swapcase() if rng.random() < 0.2 else rng.choice(pool)
                          for _ in range(rng.randint(0, 12)))) for i in range(60)]
    rows += [(None, pool[0]), (None, None), (7, rows[7][1]), (7, "other\n" + pool[3]), (8, "")]
    assert found(spark, rows, "lines", least_chars=17, least_docs=5, batches=batches, fanout=fanout) == brute(rows, 17, 5)


def test_only_code_points_and_ascii_blanks_count(spark):
    wide = "é" * 40
    rows = [(i, f" {wide}\n {wide} \r\n{wide[:39]}") for i in range(5)]
    assert found(spark, rows) == brute(rows, 40, 5)
    assert [r[3] for r in found(spark, rows)] == [2, 2, 2, 2, 0]


def test_empty_table_and_texts(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None), (2, ""), (3, "\n")]) == [(1, "", 1, 0), (2, "", 1, 0), (3, "\n", 2, 0)]


def test_null_ids_alone_keep_their_lines(spark):
    rows = [(None, "y" * 50)] * 6
    assert found(spark, rows) == brute(rows, 40, 5)
    assert all(r[3] == 0 for r in found(spark, rows))


def test_hot_line_and_very_long_document(spark):
    hot = "the same notice stands in every one of these documents"
    rows = [(i, f"{hot}\nown line {i} that is long enough to be looked at, too") for i in range(400)]
    rows.append((400, "\n".join([hot] * 30_000 + ["end"])))
    assert found(spark, rows) == brute(rows, 40, 5)


def test_runs_settle_and_compact(spark):
    """Batches in any order give the same keys; settled keys enter no later run; levels stay short."""
    rows = [(i, "\n".join([f"common line {'c' * 40}", f"own {i} {'o' * 40}", f"few {i // 3} {'f' * 40}"])) for i in range(48)]
    keyed = lines.keyed_lines(docs_df(spark, rows).select(F.col("doc_id").alias("id"), "text"), 40).cache()
    results = []
    for order in (range(8), reversed(range(8)), [3, 0, 7, 1, 6, 2, 5, 4]):
        with lines.line_runs(spark, 5, fanout=3) as runs:
            for b in order:
                runs.add(keyed.where(F.floor(F.col("id") / 6) == b))
            assert all(len(level) < 3 for level in runs.levels) and len(runs.levels) > 1
            assert runs.compacted(runs.runs()).count() == runs.table(runs.runs()).select("h", "g").distinct().count()
            results.append(sorted(map(tuple, runs.repeated().toLocalIterator())))
            if b == 0:  # descending ids: the last run holds no entry of the settled key
                common = results[-1][0][:2]
                assert runs.table(runs.levels[-1]).where(f"h = {common[0]}").count() == 1
                assert runs.table(runs.levels[0]).where(f"h = {common[0]}").count() == 0
        assert not spark.catalog.tableExists(runs.name)
    assert results[0] == results[1] == results[2] and len(results[0]) == 1


def test_runs_are_merged_without_a_shuffle(spark):
    keyed = lines.keyed_lines(docs_df(spark, [(i, "z" * 50) for i in range(9)]).select(F.col("doc_id").alias("id"), "text"), 40)
    with lines.line_runs(spark, 5, fanout=9) as runs:
        for b in range(3):
            runs.add(keyed.where(F.col("id") % 3 == b))
        plan = runs.repeated()._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
        own = keyed.groupBy("h", "g").agg(F.sum(F.col("first").cast("long")).alias("docs"), F.max("id").alias("top"))
        plan = runs.unsettled(own)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 1 and plan.count("Exchange") == 1


def test_no_python_on_the_path(spark):
    out = lines.without_repeated_lines(docs_df(spark, [(1, "a"), (2, "b")]))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
