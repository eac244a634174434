"""Naive Bayes support vectors: n-gram indicators scaled by class log-count ratios, then a linear hinge-loss fit by
dual coordinate descent.

Indicators are hashed: byte 3-grams and 4-grams, and pairs of word shapes (letter case, closing signs, same as the
word before). The fit takes a bounded sample of labelled rows (MAX_FIT_ROWS, smallest hashes of the id first) in one
task; scoring reads every whole text of the table in one pass without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.frames import arrow_map
from tallyloom.llm.textbatch import Texts, mix

#: Hashed features; the model is one float per feature, so its size is fixed.
BITS = 18
#: Labelled rows that a fit takes at most.
MAX_FIT_ROWS = 4000
ROUNDS = 12
COST = 0.05
SMOOTH = 1.0
#: Share of the sample that only sets the slope of the score.
CALIBRATION = 5

_UPPER, _LOWER, _DIGIT = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER[97:123] = True
_LOWER[128:] = True
_DIGIT[48:58] = True


def indicators(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct feature numbers of each text, one after another, and how many each has."""
    d = texts.data.astype(np.uint32)
    top = np.uint32(32 - BITS)
    tri = np.zeros(len(d), np.uint32)
    quad = np.zeros(len(d), np.uint32)
    if len(d) >= 3:
        tri[:-2] = d[:-2] | (d[1:-1] << np.uint32(8)) | (d[2:] << np.uint32(16))
    if len(d) >= 4:
        quad[:-3] = tri[:-3] | (d[3:] << np.uint32(24))
    tri = (tri * np.uint32(2654435761) + np.uint32(12345)) * np.uint32(2246822519) >> top
    quad = ((quad ^ (quad >> np.uint32(15))) * np.uint32(2246822519) + np.uint32(777)) * np.uint32(3266489917) >> top
    starts, ends = texts.words()
    owner = texts.owner(starts)
    counts = np.bincount(owner, minlength=len(texts))
    hashes = texts.hashes(starts, ends)
    upto = np.zeros((3, len(d) + 1), np.int64)
    for row, kind in zip(upto, (_UPPER, _LOWER, _DIGIT)):
        np.cumsum(kind[texts.data], out=row[1:])
    has = (upto[:, ends] - upto[:, starts]) > 0
    last = texts.data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    same = np.zeros(len(starts), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    sign = np.where(_LOWER[last] | _UPPER[last] | _DIGIT[last], 0, last)
    shape = (has[0] | has[1] << 1 | has[2] << 2 | same.astype(np.int64) << 3 | sign.astype(np.int64) << 4).astype(np.uint64)
    pair = shape.copy()
    pair[1:] |= shape[:-1] << np.uint64(16)
    pair = (mix(pair | np.uint64(1 << 40)) >> np.uint64(64 - BITS)).astype(np.uint32)
    words_upto = np.concatenate(([0], np.cumsum(counts)))
    seen = np.zeros(1 << BITS, bool)
    out = []
    for i in range(len(texts)):
        a, b = int(texts.offsets[i]), int(texts.offsets[i + 1])
        seen[tri[a : max(a, b - 2)]] = True
        seen[quad[a : max(a, b - 3)]] = True
        seen[pair[words_upto[i] : words_upto[i + 1]]] = True
        found = np.flatnonzero(seen).astype(np.int32)
        seen[found] = False
        out.append(found)
    sizes = np.array([len(x) for x in out], np.int64)
    return (np.concatenate(out) if out else np.zeros(0, np.int32)), sizes


@dataclass(frozen=True)
class Model:
    """Weights already multiplied by the log-count ratios; ``score = 1 / (1 + exp(-slope * margin))``."""

    weights: np.ndarray
    bias: float
    slope: float

    def scores(self, texts: Texts) -> np.ndarray:
        features, sizes = indicators(texts)
        margins = self.margins(features, sizes)
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margins, -30, 30)))

    def margins(self, features: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        upto = np.concatenate(([0.0], np.cumsum(self.weights[features].astype(np.float64))))
        ends = np.cumsum(sizes)
        # a long text has more indicators than a short one: margins go by the root of their number
        return (upto[ends] - upto[ends - sizes]) / np.sqrt(np.maximum(sizes, 1)) + self.bias

    def packed(self) -> dict[str, object]:
        return {"weights": self.weights.astype(np.float32).tobytes(), "bias": float(self.bias), "slope": float(self.slope)}

    @classmethod
    def unpacked(cls, row) -> "Model":
        return cls(np.frombuffer(row["weights"], np.float32), row["bias"], row["slope"])


def fit_rows(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """Fits on lists of feature numbers with labels 0/1. With one class only, every score says that class (0.5 when
    there are no rows at all)."""
    labels = np.asarray(labels, int)
    if not len(labels) or labels.min() == labels.max():
        side = 0.0 if not len(labels) else (1.0 if labels[0] else -1.0)
        return Model(np.zeros(1 << BITS, np.float32), side, 4.0)
    held = np.arange(len(rows)) % CALIBRATION == CALIBRATION - 1
    if len(rows) < 50 or len(set(labels[held])) < 2 or len(set(labels[~held])) < 2:
        held[:] = False
    counts = np.full((2, 1 << BITS), SMOOTH)
    for x, y, h in zip(rows, labels, held):
        if not h:
            counts[y, x] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    train = [i for i in range(len(rows)) if not held[i]]
    sign = np.where(labels == 1, 1.0, -1.0)
    # classes weigh the same in the loss
    share = np.where(labels == 1, labels.mean(), 1 - labels.mean())
    most = COST / (2 * share)
    values = [ratio[rows[i]] / np.sqrt(max(len(rows[i]), 1)) for i in range(len(rows))]
    norms = np.array([v @ v + 1.0 for v in values])
    w, bias, alpha = np.zeros(1 << BITS), 0.0, np.zeros(len(rows))
    order = np.random.default_rng(7)
    for _ in range(ROUNDS):
        for i in order.permutation(train):
            x, v = rows[i], values[i]
            gradient = sign[i] * (w[x] @ v + bias) - 1.0
            new = min(max(alpha[i] - gradient / norms[i], 0.0), most[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                alpha[i] = new
                w[x] += step * v
                bias += step
    model = Model((w * ratio).astype(np.float32), bias, 1.0)
    check = np.flatnonzero(held) if held.any() else np.arange(len(rows))
    margins = np.array([model.weights[rows[i]].sum(dtype=np.float64) / np.sqrt(max(len(rows[i]), 1)) + bias for i in check])
    slopes = np.geomspace(0.25, 16, 25)
    loss = [np.logaddexp(0, -s * sign[check] * margins).mean() for s in slopes]
    return Model(model.weights, bias, float(slopes[int(np.argmin(loss))]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_column: str = "doc_id", text: str = "text", max_rows: int = MAX_FIT_ROWS) -> Model:
    """Fits on at most ``max_rows`` labelled documents: those with the smallest hash of the id, ties by id.

    ``labels`` must hold only rows that may be learned from. Rows with a null id or label are left out; of several
    labels for one id the smallest counts; a null text counts as empty.
    """
    chosen = (
        labels.where(F.col(id_column).isNotNull() & F.col(label).isNotNull())
        .groupBy(id_column)
        .agg(F.min(label).cast("int").alias("__label"))
        .orderBy(F.xxhash64(id_column), id_column)
        .limit(max_rows)
    )
    rows = docs.select(id_column, text).join(F.broadcast(chosen), id_column)

    def features(batch: pa.RecordBatch):
        for first, end, texts in Texts.from_arrow(batch.column(1)).slices():
            found, sizes = indicators(texts)
            cut = np.split(found, np.cumsum(sizes)[:-1])
            yield {
                "id": batch.column(0).slice(first, end - first).cast(pa.string()),
                "label": batch.column(2).slice(first, end - first),
                "features": pa.array([x.tobytes() for x in cut], pa.binary()),
            }

    made = arrow_map(rows, [id_column, text, "__label"], features, "id string, label int, features binary")

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["id", "features"]).drop_duplicates("id")
        rows = [np.frombuffer(x, np.int32) for x in part["features"]]
        return pd.DataFrame([fit_rows(rows, part["label"].to_numpy()).packed()])

    row = made.groupBy().applyInPandas(one, "weights binary, bias double, slope double").first()
    return Model.unpacked(row) if row else fit_rows([], np.zeros(0, int))


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, score (0 to 1) for every row of ``docs``; null texts are scored as empty; repeated ids stay apart."""
    kind = docs.schema[id_column].dataType.simpleString()

    def each(batch: pa.RecordBatch):
        for first, end, texts in Texts.from_arrow(batch.column(1)).slices():
            yield {id_column: batch.column(0).slice(first, end - first), "score": model.scores(texts)}

    return arrow_map(docs, [id_column, text], each, f"`{id_column}` {kind}, score double")


def accepted(docs: DataFrame, model: Model, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores ``least`` or more, with all their columns; null texts score as empty."""
    names = docs.columns
    at = names.index(text)

    def each(batch: pa.RecordBatch):
        scores = [model.scores(texts) for _, _, texts in Texts.from_arrow(batch.column(at)).slices()]
        kept = batch.filter(pa.array(np.concatenate(scores) >= least))
        yield dict(zip(names, kept.columns))

    return arrow_map(docs, names, each, docs.schema)
