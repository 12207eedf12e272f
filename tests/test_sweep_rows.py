"""What the rows hold that a sweep shuffles."""

from pyspark.sql import functions as F

from strandloom.operators.sweep import Take, running


def test_rows_of_a_sweep_hold_keys_once(spark):
    df = spark.createDataFrame([("c", "+", 1, 5)], "seq string, strand string, start long, stop long")
    x = running(df, ("seq", "strand"), [F.col("start"), F.col("stop")], "start", {"reach": Take("max", F.col("stop"))})
    nodes, sides = [x._jdf.queryExecution().optimizedPlan()], []
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "Join":
            sides.append(node.left().output().size())
        nodes += [node.children().apply(k) for k in range(node.children().size())]
    assert sides == [3]  # start, stop and the struct of keys and block
