"""Most likely state paths over per-position probabilities, decoded in blocks so that one long sequence uses many tasks.

A block's max-plus product (states x states) says how well each state before the block leads to each state at its end. The
products of neighbouring blocks are combined in rounds, which fixes the state at every block's end, and each block is then
traced back on its own between its two fixed states. A block is one row, and all blocks of an Arrow batch take each step together.
Near ties can differ from a single pass, as float sums associate otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import written

EPS = float(np.finfo(float).eps)
STATES = ("intergenic", "intron", "five_prime_utr", "cds", "three_prime_utr")
BLOCK, FAN, BATCH_BYTES = 1024, 256, "16m"  # places of a block, blocks that one row of the next round stands for

# Transition priors between STATES, by domain and by whether incomplete transcripts were removed from training.
PRIORS = {
    ("plant", True): (
        (9.9995043940833084e-01, 0.0, 4.9560591669216442e-05, 0.0, 0.0),
        (0.0, 9.9669866350105285e-01, 1.4053978186751904e-04, 3.0901254015455425e-03, 7.0671315534084214e-05),
        (0.0, 8.8466835423086916e-04, 9.9451467488120215e-01, 4.6006567645669990e-03, 0.0),
        (0.0, 3.3405151589122515e-03, 0.0, 9.9585209719964018e-01, 8.0738764144757324e-04),
        (2.8711465041655749e-03, 2.6647086976677194e-04, 1.0282342852383601e-06, 0.0, 9.9686135439178236e-01),
    ),
    ("plant", False): (
        (9.9991456305332926e-01, 0.0, 5.5072062791886075e-05, 3.0364883878810989e-05, 0.0),
        (0.0, 9.9664525996386222e-01, 1.0966944004592222e-04, 3.1866712940318738e-03, 5.8399302060040908e-05),
        (0.0, 9.0160615580967289e-04, 9.9447096031810234e-01, 4.6274335260879790e-03, 0.0),
        (2.9278358774311944e-04, 3.0940342516742247e-03, 1.2635776951496243e-08, 9.9603932835033049e-01, 5.7384117447525039e-04),
        (2.8602482119673934e-03, 2.7769522276139527e-04, 1.2582474977861136e-06, 1.8873712466791704e-07, 9.9686060958064870e-01),
    ),
    ("animal", True): (
        (9.99952169130e-01, 0.0, 4.7830870e-05, 0.0, 0.0),
        (0.0, 9.99752475248e-01, 9.9009900e-06, 2.351485150e-04, 2.4752480e-06),
        (0.0, 9.604519770e-04, 9.94350282486e-01, 4.689265537e-03, 0.0),
        (0.0, 4.705882353e-03, 0.0, 9.94117647059e-01, 1.176470588e-03),
        (7.890365450e-04, 4.1528239e-05, 0.0, 0.0, 9.991694352159e-01),
    ),
    ("animal", False): (
        (9.99952169130e-01, 0.0, 2.8698522e-05, 1.9132348e-05, 0.0),
        (0.0, 9.99752475248e-01, 9.9009900e-06, 2.351485150e-04, 2.4752480e-06),
        (0.0, 9.604519770e-04, 9.94350282486e-01, 4.689265537e-03, 0.0),
        (2.941176470e-04, 4.705882353e-03, 0.0, 9.94117647059e-01, 8.823529410e-04),
        (7.890365450e-04, 4.1528239e-05, 0.0, 0.0, 9.991694352159e-01),
    ),
}


def priors(domain: str = "plant", complete: bool = True) -> np.ndarray:
    if (domain, complete) not in PRIORS:
        raise ValueError(f"no priors for domain {domain!r}")
    return np.array(PRIORS[domain, complete])


def stationary(matrix: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eig(np.asarray(matrix, float).T)
    v = np.real(vectors[:, np.abs(values - 1).argmin()])
    return v / v.sum()


def regularised(matrix: np.ndarray, alpha: float) -> np.ndarray:
    """Every transition gets more likely by alpha; rows are scaled to one again."""
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must lie between 0 and 1")
    m = np.asarray(matrix, float) + alpha
    return m / m.sum(axis=1, keepdims=True)


def checked(matrix: np.ndarray, initial: np.ndarray | None, n: int) -> tuple[np.ndarray, np.ndarray]:
    m = np.asarray(matrix, float)
    if m.shape != (n, n):
        raise ValueError(f"the transition matrix is {m.shape}, not {(n, n)}")
    sums = m.sum(axis=1)
    if not np.all(np.isfinite(sums)) or not np.allclose(sums, 1, atol=1e-6):
        raise ValueError("rows of the transition matrix must sum to one")
    m = m / sums[:, None]
    start = stationary(m) if initial is None else np.asarray(initial, float)
    if start.shape != (n,) or not np.isclose(start.sum(), 1):
        raise ValueError("initial probabilities must be one for each state and sum to one")
    return m, start


def viterbi(emission: np.ndarray, matrix: np.ndarray, initial: np.ndarray | None = None, alpha: float | None = None, eps: float = EPS) -> np.ndarray:
    """The path of one sequence in memory; ties go to the lowest state."""
    e = np.log(np.asarray(emission, float) + eps)
    m, start = checked(matrix if alpha is None else regularised(matrix, alpha), initial, e.shape[1])
    return _trace(e[1:], np.log(m + eps), np.log(start + eps) + e[0], None) if len(e) else np.zeros(0, int)


def _trace(e: np.ndarray, trans: np.ndarray, score: np.ndarray, last: int | None) -> np.ndarray:
    """States of the place that `score` belongs to and of all places of e; `last` fixes the final one."""
    back = np.empty((len(e), len(score)), np.int8)
    for t, row in enumerate(e):
        step = score[:, None] + trans
        back[t] = step.argmax(axis=0)
        score = step.max(axis=0) + row
    path = np.empty(len(e) + 1, np.int64)
    path[-1] = score.argmax() if last is None else last
    for t in range(len(e) - 1, -1, -1):
        path[t] = back[t, path[t + 1]]
    return path


def _padded(flat: np.ndarray, length: np.ndarray, n: int, eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, how many blocks are at least t + 1 long for each t, log emissions [t, state, block]) of blocks sorted from the longest on."""
    order = np.argsort(-length, kind="stable")
    size = length[order]
    begin = (np.cumsum(length) - length)[order]
    at = np.minimum(np.arange(size[0])[:, None], size[None] - 1) + begin[None]
    logs = np.log(flat.reshape(-1, n).T + eps)  # [state, place]
    e = np.empty((size[0], n, len(size)))
    for j in range(n):
        e[:, j] = logs[j][at]
    return order, np.searchsorted(-size, -np.arange(size[0]), "left"), e


def _step(score: np.ndarray, trans: np.ndarray, best: np.ndarray, other: np.ndarray) -> None:
    """best[j] = max over i of score[i] + trans[i, j], for all blocks, which lie along the last axis."""
    weight = trans.reshape(*trans.shape, *[1] * (score.ndim - 1))
    np.add(score[0], weight[0], out=best)
    for i in range(1, len(trans)):
        np.add(score[i], weight[i], out=other)
        np.maximum(best, other, out=best)


def products(flat: np.ndarray, length: np.ndarray, head: np.ndarray, trans: np.ndarray, first: np.ndarray, eps: float = EPS) -> np.ndarray:
    """[block, state before, state at the end]: best log scores through many blocks at once. A head block has no place before it: its
    first place takes the initial scores, on the diagonal."""
    n = len(trans)
    order, live, e = _padded(flat, length, n, eps)
    start = np.where(np.eye(n, dtype=bool), first[:, None], -np.inf)
    p = np.ascontiguousarray(np.where(head[order], start.T[:, :, None], trans.T[:, :, None]) + e[0][:, None, :])  # [state now, state before, block]
    best, other = np.empty_like(p), np.empty_like(p)
    flat_p, flat_best, flat_other = (x.reshape(n, -1) for x in (p, best, other))
    for t in range(1, len(e)):
        k = live[t]
        if k == len(order):  # long runs of memory are quicker
            _step(flat_p, trans, flat_best, flat_other)
        else:
            _step(p[..., :k], trans, best[..., :k], other[..., :k])
        np.add(best[..., :k], e[t, :, None, :k], out=p[..., :k])
    out = np.empty((len(order), n, n))
    out[order] = p.transpose(2, 1, 0)
    return out


def traces(flat: np.ndarray, length: np.ndarray, state_in: np.ndarray, state_out: np.ndarray, trans: np.ndarray, first: np.ndarray, eps: float = EPS) -> np.ndarray:
    """States of all places of many blocks, one after the other, each between its two fixed states (state_in -1: none before). Scores of
    all places are kept, so the way back looks only at the steps into the states it takes."""
    n = len(trans)
    order, live, score = _padded(flat, length, n, eps)  # emissions become scores in place
    came = state_in[order]
    score[0] += np.where(came < 0, first[:, None], trans[came].T)
    best, other = np.empty(score.shape[1:]), np.empty(score.shape[1:])
    for t in range(1, len(score)):
        k = live[t]
        _step(score[t - 1, :, :k], trans, best[:, :k], other[:, :k])
        score[t, :, :k] += best[:, :k]
    path = np.zeros((len(order), len(score)), np.int8)
    now = state_out[order].astype(np.int64)
    into = np.ascontiguousarray(trans.T)  # [state, state before]
    for t in range(len(score) - 1, -1, -1):
        k = live[t]
        path[:k, t] = now[:k]
        if t:
            now[:k] = (score[t - 1, :, :k] + into[now[:k]].T).argmax(axis=0)
    whole = np.empty_like(path)
    whole[order] = path
    return whole[np.arange(len(score))[None] < length[:, None]].astype(np.int64)


def chain(m: np.ndarray) -> np.ndarray:
    """The max-plus product of matrices [block, before, after] in order: neighbours are multiplied in rounds."""
    while len(m) > 1:
        odd = m[-1:] if len(m) % 2 else m[:0]
        a, b = m[: len(m) - len(odd) : 2], m[1 : len(m) - len(odd) : 2]
        m = np.concatenate([(a[:, :, :, None] + b[:, None, :, :]).max(axis=2), odd])
    return m[0]


def resolve(m: np.ndarray, state_in: int, state_out: int) -> tuple[np.ndarray, np.ndarray]:
    """States before and at the end of each of a row of blocks, between fixed ones; -1: none before, the best at the end."""
    score, backs = m[0].max(axis=0) if state_in < 0 else m[0][state_in], []
    for p in m[1:]:
        step = score[:, None] + p
        backs.append(step.argmax(axis=0))
        score = step.max(axis=0)
    out = np.empty(len(m), np.int64)
    out[-1] = score.argmax() if state_out < 0 else state_out
    for k in range(len(m) - 1, 0, -1):
        out[k - 1] = backs[k - 1][out[k]]
    return np.concatenate([[state_in], out[:-1]]), out


def block_ends(made: DataFrame, keys: list[str], key_ddl: str, n: int, fan: int = FAN) -> DataFrame:
    """(keys, block, state_in, state_out) from the blocks' products (keys, block, m): products of `fan` blocks each are made in parallel and
    resolved likewise, round by round, until a sequence has `fan` at most; then each round's ends fix the states inside. So a task
    holds `fan` small matrices, however long a sequence is."""
    ends = f"{key_ddl}, block long, state_in long, state_out long"
    stack = lambda pdf: np.stack(pdf["m"].to_numpy()).reshape(len(pdf), n, n)
    most = made.agg(F.max("block")).first()[0]
    if most is None or most < fan:

        def top(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("block").reset_index(drop=True)
            pdf["state_in"], pdf["state_out"] = resolve(stack(pdf), -1, -1)
            return pdf[[*keys, "block", "state_in", "state_out"]]

        return written(made.groupBy(*keys).applyInPandas(top, ends), "block-ends")

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block").reset_index(drop=True)
        one = pdf.iloc[:1][[*keys, "_up"]].rename(columns={"_up": "block"})
        one["m"] = [chain(stack(pdf)).ravel()]
        return one

    def inner(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block").reset_index(drop=True)
        pdf["state_in"], pdf["state_out"] = resolve(stack(pdf), int(pdf["state_in"][0]), int(pdf["state_out"][0]))
        return pdf[[*keys, "block", "state_in", "state_out"]]

    x = made.withColumn("_up", F.expr(f"block div {fan}"))
    up = written(x.groupBy(*keys, "_up").applyInPandas(multiply, f"{key_ddl}, block long, m array<double>"), "block-products")
    found = block_ends(up, keys, key_ddl, n, fan).withColumnRenamed("block", "_up")
    return written(x.join(found, [*keys, "_up"]).groupBy(*keys, "_up").applyInPandas(inner, ends), "block-ends")


def viterbi_paths(df: DataFrame, keys: list[str], matrix: np.ndarray, initial: np.ndarray | None = None, alpha: float | None = None, probs: str = "probs", pos: str = "pos", block: int = BLOCK, eps: float = EPS, fan: int = FAN) -> DataFrame:
    """(keys, pos, state) for rows (keys, pos from 0, probs array). A block is one row, and a task works on many of them at once."""
    n = len(matrix)
    m, start = checked(matrix if alpha is None else regularised(matrix, alpha), initial, n)
    trans, first = np.log(m + eps), np.log(start + eps)
    rows = df.select(*keys, F.col(pos).cast("long").alias("pos"), F.col(probs).cast("array<double>").alias("probs"))
    key_ddl = ", ".join(f"`{k}` {t}" for k, t in rows.dtypes if k in keys)
    place = F.array_sort(F.collect_list(F.struct("pos", "probs")))  # at most `block` places
    packed = rows.groupBy(*keys, F.expr(f"pos div {block}").alias("block")).agg(place.alias("x"))
    packed = written(packed.select(*keys, "block", F.col("x.pos").alias("pos"), F.flatten("x.probs").alias("flat")), "emissions")
    width = len(keys)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def arrays(b: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
        col = b.column(name)
        return col.flatten().to_numpy(), col.value_lengths().to_numpy().astype(np.int64)

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                flat, size = arrays(b, "flat")
                p = products(flat, size // n, b.column("block").to_numpy() == 0, trans, first, eps)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * n * n, pa.int32()), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns[: width + 1], lists], names=[*keys, "block", "m"])

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                flat, size = arrays(b, "flat")
                path = traces(flat, size // n, b.column("state_in").to_numpy(), b.column("state_out").to_numpy(), trans, first, eps)
                offsets = pa.array(np.concatenate([[0], np.cumsum(size // n)]), pa.int32())
                yield pa.RecordBatch.from_arrays([*b.columns[:width], b.column("pos"), pa.ListArray.from_arrays(offsets, pa.array(path))], names=[*keys, "pos", "state"])

    made = written(packed.select(*keys, "block", "flat").mapInArrow(product, f"{key_ddl}, block long, m array<double>"), "products")
    ends = block_ends(made, keys, key_ddl, n, fan)
    both = packed.join(ends, [*keys, "block"]).select(*keys, "pos", "flat", "state_in", "state_out")
    paths = both.mapInArrow(trace, f"{key_ddl}, pos array<long>, state array<long>")
    return paths.select(*keys, F.inline(F.arrays_zip("pos", "state")))


def direct_path(probs: Column) -> Column:
    """State of each position on its own: the first most likely one."""
    from ..functions.logits import argmax

    return argmax(probs)


def every_path(emission: np.ndarray, matrix: np.ndarray, initial: np.ndarray, eps: float = EPS) -> np.ndarray:
    """The best of all paths, for tests with a few places."""
    from itertools import product as all_paths

    e, m, s = np.log(np.asarray(emission) + eps), np.log(np.asarray(matrix) + eps), np.log(np.asarray(initial) + eps)
    score = lambda p: s[p[0]] + e[0, p[0]] + sum(m[p[t - 1], p[t]] + e[t, p[t]] for t in range(1, len(e)))
    return np.array(max(all_paths(range(len(s)), repeat=len(e)), key=score))
