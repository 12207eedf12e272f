"""Chunked array stores: round trips, appends, pruning, and stores that others wrote."""

import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.sources import arrays


@pytest.fixture
def table(spark):
    x = spark.range(0, 250).withColumn("group", F.when(F.col("id") < 170, "Ath/chr1").otherwise("Ath/chr2"))
    x = x.withColumn("sequence", F.when(F.col("id") < 170, F.col("id")).otherwise(F.col("id") - 170))
    return x.select("group", "sequence", F.substring(F.lit("ACGT"), (F.col("id") % 4 + 1).cast("int"), F.lit(1)).alias("base"), (F.col("id") % 3 == 0).alias("mask"), F.array((F.col("id") * 2).cast("int"), F.lit(7)).alias("ids"), F.when(F.col("id") % 5 > 0, F.col("id") / 4).alias("score"))


def rows(df):
    return sorted(tuple("nan" if v is None or v != v else v for v in r) for r in df.select("group", "sequence", "base", "mask", "ids", "score").collect())


@pytest.mark.parametrize("compressor", ["zlib", "zstd", "gzip", "none"])
def test_round_trip_and_pruning(spark, table, tmp_path, compressor):
    path = str(tmp_path / "s.zarr")
    arrays.write(table, path, chunk=40, compressor=compressor, **{"dims.ids": "strand"})
    table.write.parquet(str(tmp_path / "p"))
    x = arrays.read(spark, path)
    assert x.rdd.getNumPartitions() == 5 + 2
    assert rows(x) == rows(spark.read.parquet(str(tmp_path / "p")))
    some = x.where("group = 'Ath/chr1' and sequence >= 85 and sequence < 130")
    assert some.rdd.getNumPartitions() == 2
    assert rows(some) == rows(table.where("group = 'Ath/chr1' and sequence >= 85 and sequence < 130"))
    assert arrays.read(spark, path, ["mask"]).columns == ["group", "sequence", "mask"]
    (tmp_path / "s.zarr/Ath/chr1/score/0.0").parent.joinpath("0").unlink()  # an array that is not asked for is not opened
    assert arrays.read(spark, path, ["mask"], begin="10", end="20").where("mask").count() == sum(i % 3 == 0 for i in range(10, 20)) + sum(i % 3 == 0 for i in range(180, 190))
    assert {(r.group, r.path) for r in arrays.groups(spark, path, 2).collect()} == {(f"Ath/chr{k}", f"{path}/Ath/chr{k}") for k in (1, 2)}
    assert arrays.groups(spark, path, 1).count() == 0 and arrays.groups(spark, path).count() == 2
    meta = json.loads((tmp_path / "s.zarr/Ath/chr1/ids/.zarray").read_text())
    assert meta["shape"] == [170, 2] and meta["chunks"] == [40, 2] and json.loads((tmp_path / "s.zarr/Ath/chr1/ids/.zattrs").read_text())["_ARRAY_DIMENSIONS"] == ["sequence", "strand"]


def test_append_goes_on_after_what_is_there(spark, table, tmp_path):
    path = str(tmp_path / "s")
    for lo, hi in ((0, 50), (50, 90), (90, 170)):  # half-full and full last chunks
        part = table.where(F.col("sequence").between(lo, hi - 1)).withColumn("sequence", F.col("sequence") - lo)
        arrays.write(part, path, chunk=30, append=True)
    assert rows(arrays.read(spark, path)) == rows(table)
    with pytest.raises(Exception, match="not each there once|missing"):
        arrays.write(table.where("sequence <> 20"), path, chunk=30, append=True)
    assert rows(arrays.read(spark, path)) == rows(table) and not list((tmp_path / "s").glob(".stage*"))
    arrays.write(table.where("group = 'Ath/chr2'"), path, chunk=30)
    assert rows(arrays.read(spark, path)) == rows(table.where("group = 'Ath/chr2'"))
    with pytest.raises(Exception, match="longer than"):
        arrays.write(table.withColumn("base", F.lit("AC")), path, chunk=30)
    with pytest.raises(Exception, match="only floats"):
        arrays.write(table.withColumn("mask", F.lit(None).cast("boolean")), path, chunk=30)


def test_store_of_another_writer(spark, tmp_path):
    """Strand first, fill values for missing chunks, a coordinate with an offset, big-endian numbers, no metadata in one file."""
    g = tmp_path / "s/sp/c1"
    want = np.arange(2 * 25, dtype=">i4").reshape(2, 25)
    for name, x, chunks, dims in (("tok", want, (1, 10), ["strand", "sequence"]), ("sequence", np.arange(100, 125, dtype="<i8"), (10,), ["sequence"]), ("strand", np.array(["positive", "negative"]), (2,), ["strand"])):
        (g / name).mkdir(parents=True)
        (g / name / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": x.shape, "chunks": chunks, "dtype": x.dtype.str, "compressor": {"id": "zlib", "level": 1}, "fill_value": -1 if name == "tok" else None, "order": "C", "filters": None}))
        (g / name / ".zattrs").write_text(json.dumps({"_ARRAY_DIMENSIONS": dims}))
        full = np.zeros([-(-n // c) * c for n, c in zip(x.shape, chunks, strict=True)], x.dtype)
        full[tuple(slice(n) for n in x.shape)] = x
        for i in np.ndindex(*(n // c for n, c in zip(full.shape, chunks, strict=True))):
            if (name, i) != ("tok", (1, 1)):
                part = full[tuple(slice(k * c, (k + 1) * c) for k, c in zip(i, chunks, strict=True))]
                (g / name / ".".join(map(str, i))).write_bytes(zlib.compress(part.tobytes()))
    got = arrays.read(spark, str(tmp_path / "s")).where("sequence >= 103").orderBy("sequence").collect()
    assert [(r.sequence, r.tok) for r in got] == [(100 + i, [i, -1 if 10 <= i < 20 else 25 + i]) for i in range(3, 25)]
