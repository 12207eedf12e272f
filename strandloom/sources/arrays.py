"""Chunked array stores (the public Zarr format, version 2) as a Spark data source: `spark.read.format("chunked_arrays")`.

A store is a folder of groups (species/chromosome, say); a group holds arrays whose dimensions are named by the attribute
_ARRAY_DIMENSIONS. The source reads a group as rows along one dimension: `group`, the place along the dimension (the values of an
array of its name where there is one), and a column for each array that has the dimension; other dimensions make arrays of values.

Options: path; dim (`sequence`); groups (comma-separated; all by default); depth (only groups so many levels down); variables
(comma-separated arrays; all by default); begin and end (places, half-open). For writing also chunk (rows of a chunk), compressor
(zlib, gzip, zstd or none), width (bytes of a text value) and dims.<column> (the name of a column's inner dimension). Options that begin
with fs. go to the file system's address. Filters on the group and on the place leave out groups and chunks before they are read.

Each chunk along the dimension is a task of its own. Files are read and written by pyarrow's file systems (local, hdfs, s3, gs).
Writers stage their chunks; the commit checks that they are complete, moves them and then replaces the metadata, so a reader sees the
old length or the new one. An append goes on after the present length, and its first task completes a chunk that is half full. Two
writers of one group at the same time are not supported: a commit raises if the length has changed since it began. `error` mode is
not known to this source: use append or overwrite.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

NAME = "chunked_arrays"
BATCH = 1 << 16  # rows of a record batch
# Numpy kinds and sizes of the format's element types, and Spark's types for them.
KINDS = {"b1": T.BooleanType(), "i1": T.ByteType(), "i2": T.ShortType(), "i4": T.IntegerType(), "i8": T.LongType(), "u1": T.ShortType(), "u2": T.IntegerType(), "u4": T.LongType(), "f4": T.FloatType(), "f8": T.DoubleType()}
ARROW = {T.BooleanType(): pa.bool_(), T.ByteType(): pa.int8(), T.ShortType(): pa.int16(), T.IntegerType(): pa.int32(), T.LongType(): pa.int64(), T.FloatType(): pa.float32(), T.DoubleType(): pa.float64(), T.StringType(): pa.string()}


def file_system(options) -> tuple[pafs.FileSystem, str]:
    """The file system of the option `path` and the path in it."""
    path = options["path"].rstrip("/")
    more = "&".join(f"{k[3:]}={v}" for k, v in sorted(options.items()) if k.lower().startswith("fs."))
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path + ("?" + more if more else ""))


def load(fs: pafs.FileSystem, path: str) -> bytes | None:
    if fs.get_file_info(path).type != pafs.FileType.File:
        return None
    with fs.open_input_stream(path) as f:
        return f.read()


def store(fs: pafs.FileSystem, path: str, data: bytes) -> None:
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(path) as f:
        f.write(data)


def discover(fs: pafs.FileSystem, root: str, depth: int | None = None) -> list[str]:
    """Groups that hold arrays, '' for the root. Each folder is listed; arrays' own folders are not entered."""
    found, todo = [], [("", 0)]
    while todo:
        group, level = todo.pop()
        at = f"{root}/{group}".rstrip("/")
        below = sorted(i.base_name for i in fs.get_file_info(pafs.FileSelector(at)) if i.type == pafs.FileType.Directory and not i.base_name.startswith("."))
        arrays = [b for b in below if fs.get_file_info(f"{at}/{b}/.zarray").type == pafs.FileType.File]
        if arrays and depth in (None, level):
            found.append(group)
        if depth is None or level < depth:
            todo += [(f"{group}/{b}".lstrip("/"), level + 1) for b in below if b not in arrays]
    return sorted(found)


@dataclass
class Array:
    """One array's metadata."""

    name: str
    meta: dict
    dims: list[str]

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(self.meta["dtype"])

    def spark(self, dim: str) -> T.DataType:
        kind = T.StringType() if self.dtype.kind in "SU" else KINDS.get(f"{self.dtype.kind}{self.dtype.itemsize}")
        if kind is None:
            raise ValueError(f"{self.name}: element type {self.meta['dtype']} is not supported")
        for _ in self.dims[1:]:
            kind = T.ArrayType(kind, False)
        return kind


def group_arrays(fs: pafs.FileSystem, root: str, group: str) -> dict[str, Array]:
    """Arrays of a group, from its one metadata file where there is one, else from each array's."""
    at, found = f"{root}/{group}".rstrip("/"), {}
    if whole := load(fs, f"{at}/.zmetadata"):
        meta = json.loads(whole)["metadata"]
        names = [k.rsplit("/", 1)[0] for k in meta if k.endswith("/.zarray") and k.count("/") == 1]
        parts = {n: (meta[f"{n}/.zarray"], meta.get(f"{n}/.zattrs", {})) for n in names}
    else:
        names = [i.base_name for i in fs.get_file_info(pafs.FileSelector(at)) if i.type == pafs.FileType.Directory]
        parts = {n: (json.loads(a), json.loads(load(fs, f"{at}/{n}/.zattrs") or b"{}")) for n in names if (a := load(fs, f"{at}/{n}/.zarray"))}
    for n, (meta, attrs) in sorted(parts.items()):
        found[n] = Array(n, meta, attrs.get("_ARRAY_DIMENSIONS") or ([n] if len(meta["shape"]) == 1 else []))
    return found


def along(arrays: dict[str, Array], dim: str) -> dict[str, Array]:
    """The arrays that have the dimension, without its coordinate."""
    return {n: a for n, a in arrays.items() if dim in a.dims and n != dim}


def unpacked(data: bytes, meta: dict) -> bytes:
    """A chunk's bytes."""
    if meta.get("filters"):
        raise ValueError(f"filters are not supported: {meta['filters']}")
    name = (meta.get("compressor") or {}).get("id")
    size = int(np.prod(meta["chunks"])) * np.dtype(meta["dtype"]).itemsize
    if name is None:
        return data
    if name in ("zlib", "gzip"):
        return zlib.decompress(data, 47)
    if name == "zstd":
        return pa.decompress(data, size, "zstd", asbytes=True)
    raise ValueError(f"compressor {name!r} is not supported")


def packed(data: bytes, name: str) -> bytes:
    if name == "gzip":
        import gzip

        return gzip.compress(data, 1, mtime=0)
    return {"none": lambda: data, "zlib": lambda: zlib.compress(data, 1), "zstd": lambda: pa.compress(data, "zstd", asbytes=True)}[name]()


def values(fs: pafs.FileSystem, at: str, a: Array, dim: str, lo: int, hi: int) -> np.ndarray:
    """Places lo to hi along the dimension, which comes first."""
    shape, chunks, axis = a.meta["shape"], a.meta["chunks"], a.dims.index(dim)
    fill = a.meta.get("fill_value")
    size = [hi - lo if d == axis else n for d, n in enumerate(shape)]
    out = np.full(size, 0 if fill is None and a.dtype.kind not in "SU" else "" if fill is None else fill, a.dtype)
    spans = [range(lo // c, -(-hi // c)) if d == axis else range(-(-n // c)) for d, (n, c) in enumerate(zip(shape, chunks, strict=True))]
    for index in np.ndindex(*(len(s) for s in spans)):
        part = [s[i] for s, i in zip(spans, index, strict=True)]
        data = load(fs, f"{at}/{a.name}/{a.meta.get('dimension_separator', '.').join(map(str, part))}")
        if data is None:
            continue
        block = np.frombuffer(unpacked(data, a.meta), a.dtype).reshape(chunks, order=a.meta.get("order", "C"))
        low = [lo if d == axis else 0 for d in range(len(shape))]
        begin = [max(p * c, b) for p, c, b in zip(part, chunks, low, strict=True)]
        end = [min((p + 1) * c, b + n) for p, c, b, n in zip(part, chunks, low, size, strict=True)]
        out[tuple(slice(x - b, y - b) for x, y, b in zip(begin, end, low, strict=True))] = block[tuple(slice(x - p * c, y - p * c) for x, y, p, c in zip(begin, end, part, chunks, strict=True))]
    return np.moveaxis(out, axis, 0)


def to_arrow(x: np.ndarray, kind: T.DataType) -> pa.Array:
    depth = 0
    while isinstance(kind, T.ArrayType):
        kind, depth = kind.elementType, depth + 1
    flat = x.reshape(-1)
    if flat.dtype.kind == "S":
        flat = np.char.decode(flat, "utf-8")
    out = pa.array(flat.tolist() if flat.dtype.kind == "U" else flat.astype(flat.dtype.newbyteorder("=")), ARROW[kind])
    for n in reversed(x.shape[1 : 1 + depth]):
        out = pa.ListArray.from_arrays(pa.array(np.arange(0, len(out) + 1, n) if n else np.zeros(len(x) + 1), pa.int32()), out)
    return out


def names_of(options, key: str) -> list[str] | None:
    return [x.strip() for x in options[key].split(",") if x.strip()] if key in options else None


@dataclass
class Span(InputPartition):
    group: str
    lo: int
    hi: int

    def __init__(self, group: str, lo: int, hi: int):
        super().__init__((group, lo, hi))
        self.group, self.lo, self.hi = group, lo, hi


class ArrayReader(DataSourceReader):
    def __init__(self, options, schema: T.StructType):
        self.options, self.schema, self.dim = dict(options), schema, options.get("dim", "sequence")
        self.low, self.high, self.groups = int(options.get("begin", 0)), int(options["end"]) if "end" in options else None, names_of(options, "groups")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Ranges of places and lists of groups choose the tasks; Spark checks all filters again."""
        for f in filters:
            name = f.attribute[0] if isinstance(f, EqualTo | In | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and len(f.attribute) == 1 else None
            if name == "group" and isinstance(f, EqualTo | In):
                wanted = [f.value] if isinstance(f, EqualTo) else list(f.value)
                self.groups = wanted if self.groups is None else [g for g in self.groups if g in wanted]
            elif name == self.dim and not isinstance(f, In):
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    end = f.value + (not isinstance(f, LessThan))
                    self.high = end if self.high is None else min(self.high, end)
            yield f

    def partitions(self) -> list[InputPartition]:
        fs, root = file_system(self.options)
        depth = int(self.options["depth"]) if "depth" in self.options else None
        found = self.groups if self.groups is not None else discover(fs, root, depth)
        out: list[InputPartition] = []
        for group in found:
            every = group_arrays(fs, root, group)
            arrays = along(every, self.dim)
            if not arrays:
                continue
            first = next((a for n, a in arrays.items() if n in self.schema.names), next(iter(arrays.values())))
            axis = first.dims.index(self.dim)
            n, chunk = first.meta["shape"][axis], max(1, first.meta["chunks"][axis])
            named = self.dim in every  # a coordinate may not be the place itself: its chunks are all read
            lo, hi = (0, n) if named and not self.plain(every[self.dim]) else (max(self.low, 0), n if self.high is None else min(n, self.high))
            out += [Span(group, max(lo, c * chunk), min(hi, (c + 1) * chunk)) for c in range(lo // chunk, -(-hi // chunk))] if lo < hi else []
        return out

    @staticmethod
    def plain(a: Array) -> bool:
        """Whether the store says that the coordinate is the place itself, as this writer's does."""
        return bool(a.meta.get("arange"))

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(self.options)
        at = f"{root}/{partition.group}".rstrip("/")
        every = group_arrays(fs, root, partition.group)
        for lo in range(partition.lo, partition.hi, max(BATCH, 1)):
            hi = min(partition.hi, lo + BATCH) if partition.hi - partition.lo > 4 * BATCH else partition.hi
            columns = []
            for field in self.schema.fields:
                if field.name == "group":
                    columns.append(pa.array([partition.group] * (hi - lo)))
                elif field.name == self.dim and self.dim not in every:
                    columns.append(pa.array(np.arange(lo, hi)))
                elif field.name not in every:
                    raise ValueError(f"group {partition.group!r} has no array {field.name!r}")
                else:
                    x = values(fs, at, every[field.name], self.dim, lo, hi)
                    columns.append(to_arrow(x.astype("i8") if field.name == self.dim else x, field.dataType))
            yield pa.record_batch(columns, names=self.schema.names)
            if hi == partition.hi:
                return


@dataclass
class Chunks(WriterCommitMessage):
    stage: str
    made: list  # (group, chunk, first place, rows, inner shapes by column)


class ArrayWriter(DataSourceArrowWriter):
    """Rows (group, place, columns), each chunk's rows in one task and in order: see write()."""

    def __init__(self, options, schema: T.StructType, overwrite: bool):
        self.options, self.schema, self.overwrite, self.dim = dict(options), schema, overwrite, options.get("dim", "sequence")
        self.chunk, self.compressor, self.width = int(options.get("chunk", 10_000_000)), options.get("compressor", "zlib"), int(options.get("width", 1))
        self.names = [n for n in schema.names if n not in ("group", self.dim)]
        self.stage = f".stage-{uuid.uuid4().hex}"  # of this write; every attempt of a task has a folder of its own there
        fs, root = file_system(options)
        self.before = {} if overwrite or fs.get_file_info(root).type != pafs.FileType.Directory else {g: self.length(fs, root, g) for g in discover(fs, root)}

    def length(self, fs: pafs.FileSystem, root: str, group: str) -> int:
        arrays = group_arrays(fs, root, group)
        a = arrays.get(self.dim) or next(iter(along(arrays, self.dim).values()), None)
        return a.meta["shape"][a.dims.index(self.dim)] if a else 0

    def dtype(self, kind: T.DataType) -> np.dtype:
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        if isinstance(kind, T.StringType):
            return np.dtype(f"S{self.width}")
        return next(np.dtype("<" + k if k not in ("b1", "i1") else "|" + k) for k, v in KINDS.items() if v == kind and k[0] != "u")

    def column(self, name: str, rows: pa.Array) -> np.ndarray:
        kind, shape = self.schema[name].dataType, [len(rows)]
        while isinstance(kind, T.ArrayType):
            sizes = set(rows.value_lengths().to_pylist())
            if len(sizes) > 1 or None in sizes:
                raise ValueError(f"{name}: inner arrays of one length and without nulls are needed")
            shape.append(sizes.pop() if sizes else 0)
            rows, kind = rows.flatten(), kind.elementType
        if isinstance(kind, T.FloatType | T.DoubleType):
            rows = rows.fill_null(float("nan"))
        if rows.null_count:
            raise ValueError(f"{name}: only floats may be null")
        if isinstance(kind, T.StringType):
            flat = [x.encode() for x in rows.to_pylist()]
            if any(len(x) > self.width for x in flat):
                raise ValueError(f"{name}: a value is longer than {self.width} bytes")
            return np.array(flat, f"S{self.width}").reshape(shape)
        return rows.to_numpy(zero_copy_only=False).astype(self.dtype(kind)).reshape(shape)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Chunks:
        fs, root = file_system(self.options)
        stage = f"{root}/{self.stage}/{uuid.uuid4().hex}"
        made, held, now = [], [], None
        for b in iterator:
            groups = b.column(b.schema.get_field_index("group")).to_pylist()
            place = b.column(b.schema.get_field_index(self.dim)).to_numpy(zero_copy_only=False)
            began = np.array([self.before.get(g, 0) for g in groups], "i8") if self.before else 0
            chunk = (place + began) // self.chunk
            at = 0
            while at < len(groups):
                key = (groups[at], int(chunk[at]))
                end = at + 1
                while end < len(groups) and groups[end] == key[0] and chunk[end] == key[1]:
                    end += 1
                if key != now:
                    if held:
                        made.append(self.flush(fs, root, stage, now, held))
                    now, held = key, []
                held.append(b.slice(at, end - at))
                at = end
        if held:
            made.append(self.flush(fs, root, stage, now, held))
        return Chunks(stage, made)

    def flush(self, fs: pafs.FileSystem, root: str, stage: str, key: tuple[str, int], held: list[pa.RecordBatch]) -> tuple:
        (group, chunk), t = key, pa.Table.from_batches(held).combine_chunks()
        began = self.before.get(group, 0)
        place = t.column(self.dim).to_numpy() + began
        if len(place) > 1 and not (np.diff(place) == 1).all():
            raise ValueError(f"{group}: places {place.min()} to {place.max()} are not each there once and in order")
        start, old = chunk * self.chunk, 0
        if start < began:  # this chunk is half full
            old = began - start
        shapes = {}
        for name in [*self.names, self.dim]:
            x = place.astype("<i8") if name == self.dim else self.column(name, t.column(name).chunk(0) if t.column(name).num_chunks else t.column(name).combine_chunks())
            if old:
                a = group_arrays(fs, root, group)[name]
                x = np.concatenate([values(fs, f"{root}/{group}".rstrip("/"), a, self.dim, start, began).astype(x.dtype), x])
            full = np.zeros((self.chunk, *x.shape[1:]), x.dtype)
            full[: len(x)] = x
            shapes[name] = list(x.shape[1:])
            store(fs, f"{stage}/{group}/{name}/{'.'.join(map(str, [chunk] + [0] * (x.ndim - 1)))}".replace("//", "/"), packed(full.tobytes(), self.compressor))
        return group, chunk, int(place[0]), len(place), shapes

    def commit(self, messages: list[Chunks | None]) -> None:
        fs, root = file_system(self.options)
        messages = [m for m in messages if m is not None]
        by_group: dict[str, list] = {}
        for m in messages:
            for group, *rest in m.made:
                by_group.setdefault(group, []).append((*rest, m.stage))
        for group, made in by_group.items():
            made.sort(key=lambda x: x[1])
            upto = self.before.get(group, 0)
            for _, first, n, shapes, _ in made:
                if first != upto or shapes != made[0][3]:
                    self.abort(messages)
                    raise ValueError(f"{group}: rows from place {upto} on are missing, or inner sizes differ")
                upto = first + n
            if not self.overwrite and fs.get_file_info(root).type == pafs.FileType.Directory and self.length_or_zero(fs, root, group) != self.before.get(group, 0):
                self.abort(messages)
                raise RuntimeError(f"{group}: another writer has changed it")
        if self.overwrite and fs.get_file_info(root).type == pafs.FileType.Directory:
            for i in fs.get_file_info(pafs.FileSelector(root)):
                if not i.base_name.startswith(".stage-"):
                    (fs.delete_dir if i.type == pafs.FileType.Directory else fs.delete_file)(i.path)
        for group, made in by_group.items():
            at = f"{root}/{group}".rstrip("/")
            for chunk, _, _, shapes, stage in made:
                for name, inner in shapes.items():
                    file = f"{name}/{'.'.join(map(str, [chunk] + [0] * len(inner)))}"
                    fs.create_dir(f"{at}/{name}", recursive=True)
                    fs.move(f"{stage}/{group}/{file}".replace("//", "/"), f"{at}/{file}")
            self.describe(fs, root, group, made[-1][1] + made[-1][2], made[0][3])
        self.abort(messages)

    def length_or_zero(self, fs: pafs.FileSystem, root: str, group: str) -> int:
        there = fs.get_file_info(f"{root}/{group}".rstrip("/")).type == pafs.FileType.Directory
        return self.length(fs, root, group) if there else 0

    def describe(self, fs: pafs.FileSystem, root: str, group: str, rows: int, shapes: dict) -> None:
        """Metadata files of a group; the one with all of it comes last and is what readers look at."""
        at, parts = f"{root}/{group}".rstrip("/"), {".zgroup": {"zarr_format": 2}}
        for name, inner in shapes.items():
            kind = np.dtype("<i8") if name == self.dim else self.dtype(self.schema[name].dataType)
            meta = {"zarr_format": 2, "shape": [rows, *inner], "chunks": [self.chunk, *(max(1, n) for n in inner)], "dtype": kind.str, "compressor": None if self.compressor == "none" else {"id": self.compressor, "level": 1}, "fill_value": None, "order": "C", "filters": None}
            if name == self.dim:
                meta["arange"] = True
            inner_dims = [self.options.get(f"dims.{name}", f"{name}_{k}" if k else f"{name}_inner") for k in range(len(inner))]
            parts |= {f"{name}/.zarray": meta, f"{name}/.zattrs": {"_ARRAY_DIMENSIONS": [self.dim, *inner_dims]}}
        level = ""
        for part in group.split("/")[:-1]:
            level = f"{level}/{part}".lstrip("/")
            store(fs, f"{root}/{level}/.zgroup", json.dumps({"zarr_format": 2}).encode())
        for k, v in parts.items():
            store(fs, f"{at}/{k}", json.dumps(v).encode())
        store(fs, f"{at}/.zmetadata-new", json.dumps({"zarr_consolidated_format": 1, "metadata": parts}).encode())
        fs.move(f"{at}/.zmetadata-new", f"{at}/.zmetadata")

    def abort(self, messages: list[Chunks | None]) -> None:
        """Deletes what this write has staged, also by attempts that failed."""
        fs, root = file_system(self.options)
        if fs.get_file_info(f"{root}/{self.stage}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/{self.stage}")


class ChunkedArrays(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> T.StructType:
        fs, root = file_system(self.options)
        dim, wanted = self.options.get("dim", "sequence"), names_of(self.options, "variables")
        groups = names_of(self.options, "groups") or discover(fs, root, int(self.options["depth"]) if "depth" in self.options else None)
        for group in groups:
            if arrays := along(group_arrays(fs, root, group), dim):
                if missing := [n for n in wanted or [] if n not in arrays]:
                    raise ValueError(f"no arrays {missing} along {dim!r} in {group!r}")
                kinds = [T.StructField(n, arrays[n].spark(dim)) for n in wanted or arrays]
                return T.StructType([T.StructField("group", T.StringType()), T.StructField(dim, T.LongType()), *kinds])
        raise ValueError(f"no arrays along {dim!r} in {root}")

    def reader(self, schema: T.StructType) -> ArrayReader:
        return ArrayReader(self.options, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> ArrayWriter:
        return ArrayWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session and lets Spark hand filters to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ChunkedArrays)


def groups(spark: SparkSession, path: str, depth: int | None = None, **options: str) -> DataFrame:
    """(group, path) of the groups that hold arrays, of one level only where depth is given."""
    fs, root = file_system({"path": path} | options)
    return spark.createDataFrame([(g, f"{path.rstrip('/')}/{g}".rstrip("/")) for g in discover(fs, root, depth)], "`group` string, path string")


def read(spark: SparkSession, path: str, variables: list[str] | None = None, **options: str) -> DataFrame:
    """Rows of a store; variables names the arrays to read, others are not opened."""
    register(spark)
    reader = spark.read.format(NAME).options(**options)
    return (reader.option("variables", ",".join(variables)) if variables else reader).load(path)


def write(df: DataFrame, path: str, dim: str = "sequence", chunk: int = 10_000_000, append: bool = False, **options: str) -> None:
    """Writes rows (group, dim: places from 0 on, without gaps, in each group; columns). With append they go on after what is there.

    Rows are dealt by group and chunk, so a long group uses many tasks; what a task holds is one chunk."""
    register(spark := df.sparkSession)
    before = {}
    if append:
        fs, root = file_system({"path": path} | options)
        if fs.get_file_info(root).type == pafs.FileType.Directory:
            w = ArrayWriter({"path": path, "dim": dim} | options, df.schema, False)
            before = {g: n % chunk for g, n in w.before.items() if n % chunk}
    shift = F.lit(0)
    if before:  # groups whose last chunk is half full: chunks of the new rows are counted from there
        known = spark.createDataFrame(sorted(before.items()), "`group` string, _shift long")
        df = df.join(F.broadcast(known) if len(before) < 100_000 else known, "group", "left")
        shift = F.coalesce("_shift", F.lit(0))
    cols = ["group", dim, *(c for c in df.columns if c not in ("group", dim, "_shift"))]
    x = df.withColumn("_chunk", F.floor((F.col(dim) + shift) / F.lit(chunk))).repartition("group", "_chunk").sortWithinPartitions("group", "_chunk", dim).select(*cols)
    x.write.format(NAME).options(dim=dim, chunk=str(chunk), **options).mode("append" if append else "overwrite").save(path)
