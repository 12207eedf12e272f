"""Cascades and bounds that move few rows."""

from strandloom.operators import filters, hierarchy

COLS = "id string, parent string, type string, seq string, strand string, start long, stop long, quality string, row long"
ROWS = [("g", None, "gene", 0, 9), ("m", "g", "mRNA", 0, 9), ("n", "g", "mRNA", 0, 9), ("p", "m", "CDS", 2, 4), (None, "m", "CDS", 5, 8), (None, "n", "CDS", 1, 3), ("x", "n", None, 0, 50), ("h", None, "gene", 3, 4), ("k", None, None, 0, 1), (None, None, "CDS", 0, 1)]


def tree(spark, flags=()):
    return spark.createDataFrame([(i, p, t, "c", "+", a, z, "0" if i in flags else "1", k) for k, (i, p, t, a, z) in enumerate(ROWS)], COLS)


def joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def test_cascade_asks_for_a_parent_where_there_is_no_id(spark):
    df = tree(spark)
    got = hierarchy.cascade_delete(df, df.where("id = 'm'").select("id"))
    assert [r.row for r in got.orderBy("row").collect()] == [0, 2, 5, 6, 7, 8, 9]
    assert joins(got) == 1


def test_bounds_join_no_parts(spark):
    got = {r.row: (r.start, r.stop) for r in hierarchy.propagate_bounds(tree(spark)).collect()}
    assert got == {k: v for k, v in enumerate([(1, 8), (2, 8), (1, 3), (2, 4), (5, 8), (1, 3), (0, 50), (3, 4), (0, 1), (0, 1)])}
    parts = tree(spark).where("type = 'CDS'")
    plan = hierarchy.propagate_bounds(tree(spark))._jdf.queryExecution().optimizedPlan()
    assert plan.nodeName() == "Union" and parts.count() == 4


def test_quality_pass_reads_its_rows_once(spark, monkeypatch):
    tags, write = [], filters.written
    monkeypatch.setattr(filters, "written", lambda df, tag: tags.append(tag) or write(df, tag))
    edges, store = [], hierarchy.written
    monkeypatch.setattr(hierarchy, "written", lambda df, tag: edges.append(tag) or store(df, tag))
    got = filters.quality_pass(tree(spark, ("m",)))
    assert [r.row for r in got.orderBy("row").collect()] == [0, 2, 5, 6, 8, 9]
    assert tags == ["features", "passed"] and "edges" not in edges
