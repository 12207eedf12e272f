"""Language identification by hierarchical discrimination.

First a linear support vector machine (one-versus-one where there are more than two) chooses the language family, then
one-versus-one linear support vector machines among that family's languages vote for the language. Features are hashed
character 1- to 3-grams of the lower-cased text, square-rooted and scaled to length one.

Training rows are rows with a language that the caller's filter admits; of these at most TRAIN_PER_LANG for each language,
those with the smallest hash of the id, are read (a documented bound), and of many languages fewer, so that there are at most
TRAIN_ROWS in all, but at least one of each: every language with a usable row is trained. Machines are fitted on the rows' inner
products, which is cheaper than on DIM features and gives the same weights. All rows are predicted over their whole texts. The
number of machines grows with the square of the number of languages.

As a filter (keep_known) the operator rejects a text that is `und` or whose score is below a bound: half of the smallest score
that the model gives to a rightly predicted row of a calibration sample (CALIBRATE labelled rows of each language that are not
trained on; without such rows the bound is 0). Rows that stay get the predicted language as their lang, whatever it was before.
Without a labelled row there is no model: then only null and letterless texts are rejected, and lang stays as it is.

Edge cases: a null text, or one without a letter, is `und` with score 0; with no training rows every text is `und`; with one
language it is always that one; null ids are never trained on; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import arrow_rows

DIM, TRAIN_PER_LANG, TRAIN_ROWS, CALIBRATE = 4096, 400, 6400, 50

# Families of languages that are often told apart; any other language is a family of its own.
FAMILY = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "bg": "slavic", "sr": "slavic",
}

_LETTER = regex.compile(r"\p{L}")
_PIECE = 1 << 20


def features(text: str) -> np.ndarray:
    """DIM hashed character-gram weights of a whole text, of length one."""
    total = np.zeros(DIM)
    low = text.lower()
    for at in range(0, len(low), _PIECE):  # in pieces that overlap by two characters, to bound memory
        c = np.frombuffer(low[max(0, at - 2) : at + _PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        skip = min(at, 2)
        a, b, d = c[skip:], c[max(skip - 1, 0) : -1] if len(c) > 1 else c[:0], c[max(skip - 2, 0) : -2] if len(c) > 2 else c[:0]
        total += np.bincount((a * np.uint32(2654435761)) >> np.uint32(20), minlength=DIM)
        n = len(b)
        two = c[len(c) - n :] * np.uint32(2654435761) + b * np.uint32(2246822519)
        total += np.bincount((two ^ (two >> np.uint32(15))) * np.uint32(3266489917) >> np.uint32(20), minlength=DIM)
        n = len(d)
        three = c[len(c) - n :] * np.uint32(2654435761) + c[len(c) - 1 - n : len(c) - 1] * np.uint32(2246822519) + d * np.uint32(374761393)
        total += np.bincount((three ^ (three >> np.uint32(13))) * np.uint32(668265263) >> np.uint32(20), minlength=DIM)
    out = np.sqrt(total)
    return out / max(np.linalg.norm(out), 1e-12)


def train_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, steps: int = 300) -> np.ndarray:
    """Weights (last: bias) of a linear machine for y in {-1, 1}: squared hinge loss, accelerated gradient descent, balanced classes."""
    product = (x @ x.T).astype(np.float64) + 1
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    w = v = np.zeros(len(x))  # coefficients of the rows
    rate = 1 / (2 * 2 + penalty)  # rows have squared length two
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (product @ v))
        new = v - rate * (penalty * v - 2 * weight * y * slack)
        v, w = new + k / (k + 3) * (new - w), new
    return np.append(w @ x, w.sum())


class Machines:
    """One-versus-one machines among classes; one class needs none."""

    def __init__(self, x: np.ndarray, labels: np.ndarray):
        self.names = sorted(set(labels.tolist()))
        self.pairs = [(i, j) for i in range(len(self.names)) for j in range(i)]
        self.w = np.zeros((len(self.pairs), x.shape[1] + 1), np.float32)
        for k, (i, j) in enumerate(self.pairs):
            own = np.isin(labels, [self.names[i], self.names[j]])
            self.w[k] = train_svm(x[own], np.where(labels[own] == self.names[i], 1.0, -1.0))

    def choose(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the winner (most votes, then largest sum of margins, then first) and its mean logistic margin."""
        n = len(self.names)
        if n == 1:
            return np.zeros(len(x), int), np.ones(len(x))
        margin = x @ self.w[:, :-1].T + self.w[:, -1]
        votes, sums, p = np.zeros((len(x), n)), np.zeros((len(x), n)), np.zeros((len(x), n))
        for k, (i, j) in enumerate(self.pairs):
            m = margin[:, k]
            votes[:, i] += m > 0
            votes[:, j] += m <= 0
            sums[:, i] += m
            sums[:, j] -= m
            q = 1 / (1 + np.exp(-2 * np.clip(m, -20, 20)))
            p[:, i] += q
            p[:, j] += 1 - q
        best = np.argmax(votes + np.clip(sums, -1e3, 1e3) * 1e-6, axis=1)
        return best, p[np.arange(len(x)), best] / (n - 1)


class Model:
    def __init__(self, x: np.ndarray, langs: np.ndarray):
        families = np.array([FAMILY.get(v, f"={v}") for v in langs.tolist()], dtype=object)
        self.top = Machines(x, families)
        self.below = {f: Machines(x[families == f], langs[families == f]) for f in self.top.names}

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        family, score = self.top.choose(x)
        out = np.empty(len(x), object)
        for k, f in enumerate(self.top.names):
            if (own := family == k).any():
                best, p = self.below[f].choose(x[own])
                out[own] = np.array(self.below[f].names, dtype=object)[best]
                score[own] *= p
        return out.tolist(), score


def training_rows(docs: DataFrame, admitted: Column, per_lang: int = TRAIN_PER_LANG, calibrate: int = 0) -> DataFrame:
    """(doc_id, lang, text, trained): at most per_lang rows of each language to train on, fewer if there were over TRAIN_ROWS in all, and
    at least one; after these in hash order at most `calibrate` that are not trained on.

    Rows are first left out by a hash threshold from the language's count, so that a hot language sends few rows to its task."""
    rows = docs.where(admitted).select("doc_id", "lang", "text")
    rows = rows.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")).toArrow().to_pylist()  # a row for each language
    per_lang = max(1, min(per_lang, TRAIN_ROWS // max(len(counts), 1)))
    calibrate = min(calibrate, per_lang)
    most = per_lang + calibrate
    # with a mean of four times as many and 64 more, a language falls short of `most` with a chance of under 1e-9
    limits = [(c["lang"], min(float(1 << 63), 2.0**64 * (4 * most + 64) / c["_n"] - 2.0**63)) for c in counts]
    limits = docs.sparkSession.createDataFrame(limits, "_lang string, _limit double")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    some = rows.select("doc_id", "lang").join(F.broadcast(limits), F.col("lang") == F.col("_lang")).where(F.xxhash64("doc_id").cast("double") <= F.col("_limit"))
    ids = some.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most).select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), (F.col("_k") <= per_lang).alias("trained")).distinct()
    # at most TRAIN_ROWS ids to train on and as many to calibrate with, or one for each language
    return rows.join(F.broadcast(ids), (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang"))).select("doc_id", "lang", "text", "trained")


def fit(docs: DataFrame, admitted: Column, per_lang: int = TRAIN_PER_LANG, calibrate: int = 0) -> tuple[Model | None, float]:
    """The model and the score bound of its calibration rows. Trains on the driver from feature vectors that the executors computed: at
    most 2 * TRAIN_ROWS rows, or one for each language, of DIM half floats."""
    arrow_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array([features(t).astype(np.float16).tobytes() for t in texts], pa.binary())], names=["doc_id", "lang", "trained", "x"])

    got = training_rows(docs, admitted, per_lang, calibrate).mapInArrow(run, "doc_id long, lang string, trained boolean, x binary").toArrow().to_pylist()
    if not got:
        return None, 0.0
    got.sort(key=lambda r: (r["lang"], r["doc_id"], r["x"]))
    x = lambda own: np.array([np.frombuffer(r["x"], np.float16) for r in own], np.float32)
    langs = lambda own: np.array([r["lang"] for r in own], dtype=object)
    own, rest = [r for r in got if r["trained"]], [r for r in got if not r["trained"]]
    model = Model(x(own), langs(own))
    if not rest:
        return model, 0.0
    found, score = model.predict(x(rest).astype(np.float64))
    right = np.array(found, dtype=object) == langs(rest)
    return model, float(score[right].min()) / 2 if right.any() else 0.0


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row of docs; the model's size depends on the number of languages alone."""
    arrow_rows(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = b.column(1).to_pylist()
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            own = [i for i, t in enumerate(texts) if m is not None and t is not None and _LETTER.search(t)]
            if own:
                found, p = m.predict(np.array([features(texts[i]) for i in own]))
                for i, v in zip(own, found, strict=True):
                    lang[i] = v
                score[own] = p
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_id(docs: DataFrame) -> DataFrame:
    """Trains on the admitted rows of docs and predicts all: doc_id, held_out, lang_pred, score."""
    model, _ = fit(docs, ~held_out(F.col("doc_id")))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows of docs whose language is found with a score of at least the calibrated bound, with docs' own columns and the
    predicted lang."""
    model, bound = fit(docs, ~held_out(F.col("doc_id")), calibrate=CALIBRATE)
    return keep_predicted(docs, model, bound)


def keep_predicted(docs: DataFrame, model: Model | None, bound: float = 0.0) -> DataFrame:
    """Filters in one pass: batches keep all their columns, so no join with the texts is needed. Without a model all texts with a letter stay."""
    arrow_rows(docs.sparkSession)
    shared, at, to = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text"), docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts, lang = b.column(at).to_pylist(), b.column(to).to_pylist()
            keep = np.array([t is not None and _LETTER.search(t) is not None for t in texts], bool)
            own = np.flatnonzero(keep)
            if m is not None and len(own):
                found, score = m.predict(np.array([features(texts[i]) for i in own]))
                keep[own] = score >= bound
                for i, v in zip(own.tolist(), found, strict=True):
                    lang[i] = v
            yield b.set_column(to, b.schema.field(to), pa.array(lang, b.schema.field(to).type)).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
