from figmill.operators import tables

CELL = "paper_id string, table_id string, cell_id long, cell_idx int, row_index int, col_index int, row_span int, col_span int, score double, label string, content string, x1 double, y1 double, x2 double, y2 double, cx double, cy double"


def cells(spark, rows):
    return spark.createDataFrame([("p", "t", i, i, r, c, 1, 1, 0.5, "cell", text, x, y, x + 10, y + 10, x + 5, y + 5) for i, (r, c, text, x, y) in enumerate(rows)], CELL)


def test_gap_clusters(spark):
    df = cells(spark, [(0, 0, "", 0.0, y - 5) for y in (10.0, 15.0, 24.0, 40.0, 50.0, 61.0)])
    assert sorted((r.ord, r.n) for r in tables.gap_clusters(df, "cy").collect()) == [(0, 3), (1, 2), (2, 1)]


def test_pivot_last_write_wins(spark):
    df = cells(spark, [(0, 0, "a", 0.0, 0.0), (1, 1, "b", 0.0, 0.0), (1, 1, "c", 0.0, 0.0), (3, None, "x", 0.0, 0.0), (2, 0, None, 0.0, 0.0)])
    got = {r.row_index: (r.c0, r.c1) for r in tables.pivoted(df, 2).collect()}
    assert got == {0: ("a", ""), 1: ("", "c"), 2: ("", "")}


def test_pivot_keeps_wide_tables(spark):
    df = cells(spark, [(0, c, f"t{c}", 0.0, 0.0) for c in range(9)])
    got = tables.pivoted(df).collect()
    assert [[r[f"c{c}"] for c in range(9)] for r in got] == [[f"t{c}" for c in range(9)]]


def test_sequential(spark):
    df = spark.range(1000).selectExpr("id * 7 % 1009 as k")
    got = sorted((r.no, r.k) for r in tables.sequential(df, "k", "no", 1).collect())
    assert [n for n, _ in got] == list(range(1, 1001)) and [k for _, k in got] == sorted(k for _, k in got)


def test_empty(spark):
    df = cells(spark, [(0, 0, "a", 0.0, 0.0)]).limit(0)
    assert tables.pivoted(df).count() == 0 and tables.gap_clusters(df, "cx").count() == 0 and tables.merged(df, df).count() == 0
