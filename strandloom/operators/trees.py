"""Scores of boosted-tree models, as node tables that a batch of rows walks down together.

A model is read from the public JSON form of gradient-boosting libraries (trees as arrays of children, split features and
conditions). A row goes left where its feature is below the condition, by the default side where it is missing, both as 32-bit
floats; a model's score is the logistic function of the sum of its leaves and of the base score's log odds.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Ensemble:
    """All nodes of a model's trees, one tree after the other; a leaf has no left child (-1) and its value in `condition`."""

    feature: np.ndarray
    condition: np.ndarray
    left: np.ndarray
    right: np.ndarray
    default_left: np.ndarray
    roots: np.ndarray
    margin: float

    @classmethod
    def from_json(cls, text: str) -> Ensemble:
        learner = json.loads(text)["learner"]
        trees = learner["gradient_booster"]["model"]["trees"]
        kind = learner.get("objective", {}).get("name", "binary:logistic")
        if kind != "binary:logistic":
            raise ValueError(f"only binary logistic models are scored, not {kind}")
        size = np.array([len(t["left_children"]) for t in trees], "i8")
        base = np.cumsum(size) - size
        whole = lambda k, kind: np.concatenate([np.asarray(t[k], kind) for t in trees]) if trees else np.zeros(0, kind)
        shift = np.repeat(base, size)
        side = lambda k: np.where((c := whole(k, "i8")) >= 0, c + shift, -1)
        p = float(str(learner["learner_model_param"]["base_score"]).strip("[]"))
        return cls(whole("split_indices", "i8"), whole("split_conditions", "f4"), side("left_children"), side("right_children"), whole("default_left", "i1").astype(bool), base, float(np.log(p / (1 - p))))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Of rows of features; one step of the loop takes every row one level down in every tree."""
        x = np.asarray(x, "f4")
        if len(self.feature) and len(inner := self.feature[self.left >= 0]) and x.shape[1] <= inner.max():
            raise ValueError(f"the model asks for feature {inner.max()}, rows have {x.shape[1]}")
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        while (inside := self.left[node] >= 0).any():
            v = x[row, np.where(inside, self.feature[node], 0)]
            left = np.where(np.isnan(v), self.default_left[node], v < self.condition[node])
            node = np.where(inside, np.where(left, self.left[node], self.right[node]), node)
        return 1 / (1 + np.exp(-(self.condition[node].astype("f8").sum(axis=1) + self.margin)))


def load_models(spark: SparkSession, path: str) -> dict[str, Ensemble]:
    """Models by file name from all JSON files of a folder but config.json, in order of names. Models are small beside the data: each
    is one text of the driver, as the closures that use it are."""
    found = spark.read.text(path, wholetext=True, pathGlobFilter="*.json").select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("n"), "value").where("n <> 'config.json'").toLocalIterator()
    models = {r.n[: -len(".json")]: Ensemble.from_json(r.value) for r in sorted(found, key=lambda r: r.n)}
    if not models:
        raise FileNotFoundError(f"no models in {path}")
    return models


def score(df: DataFrame, models: dict[str, Ensemble], id_col: str, features: str, threshold: float = 0.5) -> DataFrame:
    """(id, a column for each model, mean_score, predicted_label) of rows with an array of features; null components are missing, a null
    array has null scores and no label."""
    if clash := {id_col, "mean_score", "predicted_label"} & set(models):
        raise ValueError(f"names of models clash: {sorted(clash)}")
    names = list(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(1)
            there = col.is_valid().to_numpy(zero_copy_only=False)
            own = col.filter(pa.array(there))
            width = {int(n) for n in own.value_lengths().to_pylist()}
            if len(width) > 1:
                raise ValueError(f"rows have from {min(width)} to {max(width)} features")
            x = own.flatten().to_numpy(zero_copy_only=False).astype("f4").reshape(len(own), -1) if len(own) else None
            out = []
            for n in names:
                s = np.full(b.num_rows, np.nan)
                if x is not None:
                    s[there] = models[n].scores(x)
                out.append(pa.array(s, mask=~there))
            yield pa.record_batch([b.column(0), *out], names=["id", *names])

    kind = df.schema[id_col].dataType.simpleString()
    x = df.select(F.col(id_col).alias("id"), F.col(features).cast("array<float>").alias("x")).mapInArrow(run, f"id {kind}, " + ", ".join(f"`{n}` double" for n in names))
    mean = sum((F.col(f"`{n}`") for n in names[1:]), F.col(f"`{names[0]}`")) / F.lit(len(names))
    return x.withColumn("mean_score", mean).withColumn("predicted_label", (F.col("mean_score") >= threshold).cast("int")).withColumnRenamed("id", id_col)


def embed(df: DataFrame, embedder: Callable[[list[str]], list[np.ndarray]], text_col: str, name: str = "features") -> DataFrame:
    """df with the mean over residues of what embedder gives for each text: [residue, feature]. It gets a batch of texts at a time, as a
    neural model wants; a text without residues has a null."""
    cols = [c for c in df.columns if c != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(cols.index(text_col)).to_pylist()
            found = iter(embedder([t for t in texts if t]))
            made = [np.asarray(next(found), "f4").mean(axis=0) if t else None for t in texts]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.list_(pa.float32()))], names=[*cols, name])

    ddl = ", ".join(f"`{k}` {t}" for k, t in df.select(*cols).dtypes)
    return df.select(*cols).mapInArrow(run, f"{ddl}, `{name}` array<float>")
