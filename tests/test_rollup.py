"""States of windows and tags: batches merge once, whatever their order, and levels are sums."""

from pyspark.sql import functions as F

from strandloom.operators import rollup

WINDOWS = "species string, chrom string, kept boolean, intergenic boolean, selected boolean, length long"


def test_batches_count_once(spark, tmp_path):
    one = spark.createDataFrame([("A", "1", True, True, True, 9), ("A", "1", True, False, True, 100), ("A", "2", False, True, False, 5), (None, "1", True, None, None, None)], WINDOWS)
    two = spark.createDataFrame([("A", "1", True, True, False, 0), ("B", "1", False, False, False, 7)], WINDOWS)
    path = str(tmp_path / "s")
    for batch, df in (("one", one), ("two", two), ("one", one), ("two", two.limit(0)), ("two", two)):
        rollup.save(rollup.window_state(df, batch), path)
    rollup.save(rollup.tag_state(spark.createDataFrame([("A", "1", "x"), ("A", "2", "x"), ("A", "2", None)], "species string, chrom string, tag string"), "one"), path)
    got = {(r.level, r.species, r.chrom): r for r in rollup.window_rollup(rollup.load(spark, path)).collect()}
    assert set(got) == {("dataset", "A", "1"), ("dataset", "A", "2"), ("dataset", "B", "1"), ("dataset", None, "1"), ("species", "A", None), ("species", "B", None), ("species", None, None), ("all", None, None)}
    r = got["all", None, None]
    assert (r.processed, r.kept, r.skipped, r.available_intergenic, r.available_genic, r.selected_intergenic, r.selected_genic) == (6, 4, 2, 2, 2, 1, 1)
    assert r.keep_rate == 4 / 6 and r.available_share == 0.5 and r.length_from == 8
    r = got["dataset", "B", "1"]
    assert (r.processed, r.kept, r.selected_share, r.length_from) == (1, 0, None, None)
    assert got["dataset", None, "1"].processed == got["species", None, None].processed == 1
    tags = {(r.level, r.species, r.chrom, r.tag): (r.n, r.frequency) for r in rollup.tag_rollup(rollup.load(spark, path)).collect()}
    assert tags["species", "A", None, "x"] == (2, 2 / 3) and tags["dataset", "A", "2", None] == (1, 0.5) and tags["all", None, None, "x"] == (2, 2 / 3)


def test_states_of_parts_add_up_to_the_whole(spark, tmp_path):
    x = spark.range(500).select(F.concat(F.lit("s"), F.col("id") % 3).alias("species"), F.concat(F.lit("c"), F.col("id") % 2).alias("chrom"), (F.col("id") % 4 > 0).alias("kept"), (F.col("id") % 5 > 1).alias("intergenic"), (F.col("id") % 7 > 2).alias("selected"), F.col("id").alias("length"))
    rollup.save(rollup.window_state(x, F.concat(F.lit("b"), F.col("length") % 9)), str(tmp_path / "s"))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(rollup.window_rollup(rollup.load(spark, str(tmp_path / "s")))) == key(rollup.window_rollup(rollup.window_state(x, "all")))
