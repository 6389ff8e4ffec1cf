"""Quality classifier: naive Bayes support vectors over hashed n-gram indicators.

An indicator says that a text holds an n-gram: of lower-cased words (n = 1, 2)
or of word shapes (n = 1, 2, 3; case, digits, punctuation, repetition of the
word before), hashed to 2**bits places.  Indicators are scaled by their
log-count ratio between the classes, and a linear hinge-loss model is fitted
to them by dual coordinate descent.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .store import cut

BITS = 18
#: At most so many labelled rows are fitted on, with at most so many indicators in all (documented bounds), in the order of a hash of the id.
FIT_ROWS = 12_000
FIT_INDICATORS = 1 << 25
_U = np.uint64

_b = np.arange(256)
_UPPER = (_b >= 65) & (_b <= 90)
_DIGIT = (_b >= 48) & (_b <= 57)
_LETTER = ((_b >= 97) & (_b <= 122)) | (_b >= 128)
_PUNCT = ~(_UPPER | _DIGIT | _LETTER) & (_b > 32) & (_b < 127)


def indicators(w: W.Words, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of every indicator that is set, each once."""
    n_text = len(w.ptr) - 1
    text = w.text_of_word()
    if not len(text):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)

    def count(flags):
        total = np.zeros(len(w.raw) + 1, np.int32)
        np.cumsum(flags[w.raw], out=total[1:])
        return np.minimum(total[w.ends] - total[w.starts], 3).astype(_U)

    hashes = w.hashes()
    again = np.zeros(len(text), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    last = w.raw[w.ends - 1]
    length = np.minimum(w.ends - w.starts, 31).astype(_U)
    shape = count(_UPPER)
    for part, width in ((np.minimum(count(_LETTER), _U(1)), 1), (np.minimum(count(_DIGIT), _U(1)), 1), (count(_PUNCT), 2), (again.astype(_U), 1), (np.where(_PUNCT[last], last, 0).astype(_U), 8), ((length > _U(12)).astype(_U), 1)):
        shape = (shape << _U(width)) | part
    shapes = W.mix(shape + _U(0x5AFE))
    keys = []
    for base, longest in ((hashes, 2), (shapes, 3)):
        for n in range(1, longest + 1):
            grams = base if n == 1 else W.ngram_hashes(base, n)
            inside = text[: len(grams)] == text[n - 1 :]
            keys.append((text[: len(grams)][inside].astype(_U) << _U(bits)) | (grams[inside] >> _U(64 - bits)))
    keys = np.sort(np.concatenate(keys))
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])].astype(np.int64)
    assert n_text <= 1 << 40
    return keys >> bits, keys & ((1 << bits) - 1)


@dataclass
class Model:
    """weights: of each place, times its scale; square: the scale squared."""

    weights: np.ndarray
    square: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, w: W.Words) -> np.ndarray:
        text, place = indicators(w)
        n = len(w.ptr) - 1
        return np.bincount(text, self.weights[place], n) / np.sqrt(np.maximum(np.bincount(text, self.square[place], n), 1e-18)) + self.bias

    def scores(self, w: W.Words) -> np.ndarray:
        margin = self.margins(w)
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500)))


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, size: int, alpha: float = 1.0) -> np.ndarray:
    counts = np.full((2, size), alpha)
    for label in (0, 1):
        for r, v in zip(rows, y):
            if v == label:
                counts[label][r] += 1  # each place once in a row
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, c: float = 0.1, rounds: int = 8, seed: int = 7) -> tuple[np.ndarray, float]:
    """Hinge loss with an L2 penalty in the dual, one coordinate at a time; (weights, bias).

    Rows are indicator places; their values are `scale` there, brought to unit
    length.  Classes count alike.  A constant feature gives the bias.
    """
    w, b = np.zeros(len(scale)), 0.0
    sign = np.where(y == 1, 1.0, -1.0)
    share = np.where(y == 1, 1 / max(1, (y == 1).sum()), 1 / max(1, (y == 0).sum())) * len(y) / 2
    unit = [1 / max(1e-9, float(np.linalg.norm(scale[r]))) for r in rows]
    a, top = np.zeros(len(y)), c * share
    order = np.random.Generator(np.random.PCG64(seed))
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(y)):
            r = rows[i]
            v = scale[r] * unit[i]
            gain = sign[i] * (float(w[r] @ v) + b) - 1
            new = min(max(a[i] - gain / 2, 0.0), top[i])  # squared length: 1 and 1 for the constant
            step = (new - a[i]) * sign[i]
            if step:
                w[r] += step * v
                b += step
                a[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w, b


def fit(rows: list[np.ndarray], y: np.ndarray, bits: int = BITS) -> Model:
    """A model of hashed rows, its weights from all of them; the scale of its scores comes from a fifth that a first fit doesn't see."""
    size = 1 << bits
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(size), np.zeros(size), 0.0, 1.0, 6.0 if (y == 1).all() and len(y) else 0.0 if not len(y) else -6.0)
    apart = np.arange(len(y)) % 5 == 4
    if len(set(y[apart].tolist())) < 2 or len(set(y[~apart].tolist())) < 2:
        apart = np.zeros(len(y), bool)

    def train(keep):
        own = [r for r, k in zip(rows, keep) if k]
        scale = log_count_ratio(own, y[keep], size)
        w, b = dual_coordinate_descent(own, y[keep], scale)
        return scale, w, b

    def margins(scale, w, b, which):
        out = []
        for r, k in zip(rows, which):
            if k:
                v = scale[r]
                out.append(float(w[r] @ v) / max(1e-9, float(np.sqrt(v @ v))) + b)
        return np.array(out)

    scale, w, b = train(~apart)
    which = apart if apart.any() else np.ones(len(y), bool)
    slope, shift = _platt(margins(scale, w, b, which), y[which])
    if apart.any():
        scale, w, b = train(np.ones(len(y), bool))
    return Model(w * scale, scale * scale, b, slope, shift)


def _platt(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic scale of margins, by Newton steps with a little ridge."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(y == 1, 0.5 / max(n1, 1), 0.5 / max(n0, 1))  # both classes count alike
    x = np.stack([m, np.ones_like(m)], 1)
    t = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ t, -30, 30)))
        g = x.T @ (weight * (p - target)) + 1e-4 * t
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2)
        step = np.linalg.solve(h, g)
        t = t - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(t[0]), float(t[1])


def held_out(id_col) -> F.Column:
    """Whether a row is held out: crc32 of the id as text leaves 0 modulo 5."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = FIT_ROWS) -> Model:
    """Fits on labelled rows that are not held out, at most `most` of them and FIT_INDICATORS of theirs, by hash order of the id.

    Only ids of that bounded sample are broadcast, so no text is shuffled but
    the sample's; its hashed rows come to the driver.  Labels of ids without a
    document, null labels and null ids are left out; of several labels of an
    id the largest counts, of several texts of an id the smallest; without
    usable labels every score is 0.5.
    """
    usable = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(id_col))
    order = F.xxhash64(F.col(id_col).cast("string"))
    chosen = usable.groupBy(id_col).agg(F.max(label_col).cast("int").alias("_y")).orderBy(order, id_col).limit(most)

    def run(batches):
        for batch in batches:
            for i, j, w in W.batches_of(batch.column(1), lower=True):
                text, place = indicators(w)
                edge = np.searchsorted(text, np.arange(j - i + 1))
                made = pa.array([_packed(place[a:b]) for a, b in zip(edge, edge[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), made], names=["at", "y", "row"])

    sample = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col).groupBy(id_col, "_y").agg(F.min(text_col).alias("_t"))
    made = cut(sample.select(order, "_t", "_y").mapInArrow(run, "at long, y int, row binary"))
    sizes = made.select("at", (F.octet_length("row") / 2).alias("n")).toPandas().sort_values("at")  # `most` rows
    within = sizes["at"][sizes["n"].cumsum() <= FIT_INDICATORS]
    got = made.filter(F.col("at") <= (int(within.iloc[-1]) if len(within) else -(1 << 63))).toArrow()
    order = np.lexsort((got["y"].to_numpy(), got["at"].to_numpy()))
    y, packed = got["y"].to_numpy()[order], got["row"].combine_chunks()
    flat, rows, end = np.empty(int(sizes["n"].sum()), np.int32), [], 0  # one allocation, which goes back whole
    for k in order.tolist():
        row = _unpacked(packed[k].as_buffer())
        flat[end : end + len(row)] = row
        rows.append(flat[end : end + len(row)])
        end += len(row)
    del got, packed
    return fit(rows, y)


def _packed(place: np.ndarray) -> bytes:
    """Ascending places as how many are in each 2**16 of them, and their low 16 bits."""
    blocks = 1 << (BITS - 16)
    return np.diff(np.searchsorted(place, np.arange(blocks + 1) << 16)).astype("<u4").tobytes() + (place & 0xFFFF).astype("<u2").tobytes()


def _unpacked(raw) -> np.ndarray:
    blocks = 1 << (BITS - 16)
    count = np.frombuffer(raw, "<u4", blocks)
    return np.frombuffer(raw, "<u2", offset=4 * blocks).astype(np.int32) + np.repeat(np.arange(blocks, dtype=np.int32) << 16, count)


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(id, held_out, score, predicted) of every whole text, one row per input row.

    Null and empty texts have the score of no indicators; held_out of a null
    id is null; an empty table gives no rows; other columns are not read.
    """
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((model.weights.astype(np.float32), model.square.astype(np.float32), model.bias, model.slope, model.shift))  # 2**bits places, whatever the corpus
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])

    def run(batches):
        own = Model(*shared.value)
        for batch in batches:
            for i, j, w in W.batches_of(batch.column(1), lower=True):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(own.scores(w))], names=schema.names)

    scored = docs.select(id_col, text_col).mapInArrow(run, schema)
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, whose text scores at least threshold; one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.square.astype(np.float32), model.bias, model.slope, model.shift))
    at = docs.columns.index(text_col)

    def run(batches):
        own = Model(*shared.value)
        for batch in batches:
            keep = [own.scores(w) >= threshold for _, _, w in W.batches_of(batch.column(at), lower=True)]
            yield batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)
