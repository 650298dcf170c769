import __spark_entry__ as E

ROWS_ONLY = set()


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"userId", "gameId", "date", "partOfDay", "numLevelsCompleted"} <= set(df.columns)


def test_every_query_has_an_oracle_or_is_rows_only():
    from playerlytics.plans.catalog import QUERIES
    from playerlytics.plans.oracle import ORACLE
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and set(QUERIES) <= set(q) and set(ORACLE) <= set(o)
    assert set(QUERIES) - set(ORACLE) == ROWS_ONLY


#: Files that fetch small results, with their bound checked or stated beside the call.
BOUNDED = {"functions/bounded.py": {".toArrow("}, "llm/langid.py": {".toPandas("}, "llm/urls.py": {".toArrow("}}


def test_no_collect_in_library():
    import pathlib
    root = pathlib.Path(__file__).resolve().parent.parent / "playerlytics"
    for p in root.rglob("*.py"):
        found = {call for call in (".collect()", ".toPandas(", ".toArrow(", ".toLocalIterator(") if call in p.read_text()}
        assert found <= BOUNDED.get(p.relative_to(root).as_posix(), set()), p
