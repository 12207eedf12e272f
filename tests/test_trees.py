"""Boosted trees against a recursive walk, and the workflow that joins gene fragments."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.operators import trees
from strandloom.plans import pipelines


def grow(rng, depth=5, features=6):
    nodes = []

    def add(d):
        k = len(nodes)
        nodes.append(None)
        if d == 0 or rng.random() < 0.2:
            nodes[k] = (-1, -1, 0, rng.uniform(-1, 1), 0)
        else:
            f, c, m = rng.randrange(features), rng.choice([-0.5, 0.1, 0.25, 1.0]), rng.randrange(2)
            left = add(d - 1)
            nodes[k] = (left, add(d - 1), f, c, m)
        return k

    add(depth)
    return dict(zip(("left_children", "right_children", "split_indices", "split_conditions", "default_left"), map(list, zip(*nodes, strict=True)), strict=True))


def model(seed, base="5E-1", n=7):
    rng = random.Random(seed)
    return {"learner": {"objective": {"name": "binary:logistic"}, "learner_model_param": {"base_score": base}, "gradient_booster": {"model": {"trees": [grow(rng) for _ in range(n)]}}}}


def walk(m, row):
    total = 0.0
    for t in m["learner"]["gradient_booster"]["model"]["trees"]:
        k = 0
        while t["left_children"][k] >= 0:
            v = row[t["split_indices"][k]]
            left = t["default_left"][k] if v is None or math.isnan(v) else np.float32(v) < np.float32(t["split_conditions"][k])
            k = t["left_children" if left else "right_children"][k]
        total += float(np.float32(t["split_conditions"][k]))
    p = float(m["learner"]["learner_model_param"]["base_score"].strip("[]"))
    return 1 / (1 + math.exp(-total - math.log(p / (1 - p))))


def test_scores_against_a_recursive_walk(spark, tmp_path):
    models = {"m1": model(1), "m2": model(2, "[2.5E-1]"), "m3": model(3, n=1)}
    for k, m in models.items():
        (tmp_path / f"{k}.json").write_text(json.dumps(m))
    (tmp_path / "config.json").write_text("{}")
    loaded = trees.load_models(spark, str(tmp_path))
    assert list(loaded) == ["m1", "m2", "m3"]
    rng = random.Random(9)
    rows = [(i, None if i == 7 else [rng.choice([None, float("nan"), 0.1, -0.5, rng.gauss(0, 1)]) for _ in range(6)]) for i in range(60)]
    got = {r.k: r for r in trees.score(spark.createDataFrame(rows, "k long, x array<double>"), loaded, "k", "x").collect()}
    for i, x in rows:
        if x is None:
            assert got[i].m1 is None and got[i].mean_score is None and got[i].predicted_label is None
            continue
        want = [walk(m, x) for m in models.values()]
        assert np.allclose([got[i].m1, got[i].m2, got[i].m3, got[i].mean_score], [*want, sum(want) / 3], atol=1e-12)
        assert got[i].predicted_label == int(sum(want) / 3 >= 0.5)
    with pytest.raises(FileNotFoundError):
        (tmp_path / "none").mkdir()
        (tmp_path / "none/config.json").write_text("{}")
        trees.load_models(spark, str(tmp_path / "none"))
    with pytest.raises(Exception, match="rows have 2"):
        trees.score(spark.createDataFrame([(1, [1.0, 2.0])], "k long, x array<double>"), loaded, "k", "x").collect()
    with pytest.raises(ValueError, match="binary logistic"):
        trees.Ensemble.from_json(json.dumps(model(1) | {"learner": model(1)["learner"] | {"objective": {"name": "rank:ndcg"}}}))


def test_fragments_are_joined_where_the_models_say_so(spark):
    dna = "ATGAAACCC" + "TTTGGGTAA" + "CCCCCC" + "ATGGGG" + "AAATGA" + "CC"
    genes = [("g1", 0, 9), ("g2", 9, 18), ("g3", 24, 30), ("g4", 30, 36)]
    rows = [r for k, (g, a, z) in enumerate(genes) for r in ((g, None, "gene", a, z, 3 * k), (f"{g}.t", g, "mRNA", a, z, 3 * k + 1), (f"{g}.c", f"{g}.t", "CDS", a, z, 3 * k + 2))]
    f = spark.createDataFrame(rows, "id string, parent string, type string, start long, stop long, row long").withColumns({"seq": F.lit("c"), "strand": F.lit("+")})
    # the only feature is the share of K: above 0.2 the models say yes
    yes = {"learner": {"learner_model_param": {"base_score": "5E-1"}, "gradient_booster": {"model": {"trees": [{"left_children": [1, -1, -1], "right_children": [2, -1, -1], "split_indices": [0, 0, 0], "split_conditions": [0.2, -3.0, 3.0], "default_left": [0, 0, 0]}]}}}}
    embedder = lambda texts: [np.array([[float(c == "K")] for c in t]) for t in texts]
    tree, scores = pipelines.join_fragments(f, spark.createDataFrame([("c", dna)], "seq string, dna string"), embedder, {"m": trees.Ensemble.from_json(json.dumps(yes))})
    assert {(r.key, r.predicted_label) for r in scores.collect()} == {("c~g1|g2~+", 0), ("c~g3|g4~+", 1)}
    assert {r.id for r in tree.where("type = 'gene'").collect()} == {"g1", "g2", "concat_g3_g4"}
