"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

Features are hashed words and word beginnings (4 and 6 characters), each with the
square root of its share of the document's words.  One weight vector w serves
all ordered thresholds: P(grade > k) = sigmoid(w.x - theta_k).  The result is the
expected severity, the sum of these probabilities over k, from 0 to 3.

Labels say only toxic or not.  Training grades are made from them: clean
documents are grade 0; toxic ones get 1 to 3 by how dense the words most
associated with toxic labels are in them (thirds of the toxic sample; without
any such word, grade 1).

The model is fitted on the driver on at most ``most`` labelled documents (a
parameter); a fifth of them, not used for the weights, sets the severity from
which a document counts as toxic (best F1).  All documents are scored in tasks.

Defined cases: a null or wordless text scores the severity of no features; with
no usable labels of both kinds every severity is 0 and nothing is toxic; a severity
equal to the cut is toxic; repeated rows and rows without an id are scored like
any other, each by its own text alone; texts of any length are scored whole;
columns of any name are kept, but those of the result's names are replaced.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import as_batch, ddl_of, fresh, light_batches, plain_names, quoted, small_batches, texts_of
from tickloom.llm.labelled import sample

WIDTH = 1 << 17  # hashed features
GRADES = 4
LEAST_DOCS = 4  # sampled documents that a feature must occur in
TELLING = 4.0  # standard errors
FEWEST = 200  # features kept at least
MOST_WORDS = 1 << 17  # words whose features a worker remembers
EDGE = b".,;:!?\"'()[]{}<>|*#$%&-_~`+=/\\"


@dataclass
class Model:
    weights: np.ndarray  # float32, WIDTH
    thresholds: np.ndarray  # ascending, GRADES - 1
    cut: float


class _Features(dict):
    def __missing__(self, word: bytes) -> tuple[int, int, int]:
        if len(self) >= MOST_WORDS:
            self.clear()
        letters = word.decode(errors="ignore")
        found = tuple(zlib.crc32(p + b":" + x) % WIDTH for p, x in ((b"w", word), (b"4", letters[:4].encode()), (b"6", letters[:6].encode())))
        self[word] = found
        return found


def features(texts: list[bytes], known: _Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows as offsets, feature numbers and values."""
    offsets, columns, values = [0], [], []
    for text in texts:
        counts = Counter(w.strip(EDGE) for w in text.decode().lower().encode().split())
        counts.pop(b"", None)
        total = counts.total()
        if total:
            hashed = np.array([known[w] for w in counts], np.int64)
            times = np.repeat(np.fromiter(counts.values(), np.float64, len(counts)), 3)
            own, where = np.unique(hashed.ravel(), return_inverse=True)
            columns.append(own)
            values.append(np.sqrt(np.bincount(where, times) / total))
        offsets.append(offsets[-1] + (len(columns[-1]) if total else 0))
    flat = lambda x, t: np.concatenate(x).astype(t) if x else np.empty(0, t)
    return np.array(offsets), flat(columns, np.int64), flat(values, np.float64)


def _dot(offsets, columns, values, weights) -> np.ndarray:
    """Scores of sparse rows; each row is summed alone, so that its score does not depend on its batch."""
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    return np.bincount(rows, values * weights[columns], minlength=len(offsets) - 1)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def severity(model: Model, score: np.ndarray) -> np.ndarray:
    return _sigmoid(score[:, None] - model.thresholds).sum(axis=1)


def grades(offsets, columns, values, toxic: np.ndarray) -> np.ndarray:
    """Training grades 0 to 3 from 0/1 labels (see the module's head)."""
    row = np.repeat(np.arange(len(toxic)), np.diff(offsets))
    in_toxic = np.bincount(columns[toxic[row] == 1], minlength=WIDTH)
    in_clean = np.bincount(columns[toxic[row] == 0], minlength=WIDTH)
    odds = np.log((in_toxic + 0.5) / ((toxic == 1).sum() + 1)) - np.log((in_clean + 0.5) / ((toxic == 0).sum() + 1))
    lexicon = (odds > 2) & (in_toxic >= LEAST_DOCS)
    density = np.bincount(row, values**2 * lexicon[columns], minlength=len(toxic))
    marked = density[(toxic == 1) & (density > 0)]
    cuts = np.quantile(marked, [1 / 3, 2 / 3]) if len(marked) else np.array([np.inf, np.inf])
    return np.where(toxic == 1, 1 + (density[:, None] > cuts).sum(axis=1), 0)


def chosen_features(columns, toxic_of, toxic: int, clean: int) -> np.ndarray:
    """Features whose log odds between the labels lie over ``TELLING`` standard errors from 0, or else the ``FEWEST`` furthest."""
    a, b = (np.bincount(columns[toxic_of == k], minlength=WIDTH) + 0.5 for k in (1, 0))
    far = np.abs(np.log(a / (toxic + 1)) - np.log(b / (clean + 1))) / np.sqrt(1 / a + 1 / b)
    far[a + b < LEAST_DOCS + 1] = 0
    return (far > TELLING) if (far > TELLING).sum() >= FEWEST else far >= max(1e-9, np.sort(far)[-FEWEST])


def fit(offsets, columns, values, toxic: np.ndarray, rounds: int = 120, rate: float = 0.3, decay: float = 2e-4) -> Model:
    """Cumulative-link fit by Adam on the whole sample; deterministic."""
    empty = Model(np.zeros(WIDTH, np.float32), np.full(GRADES - 1, 40.0), np.inf)
    if not 0 < toxic.sum() < len(toxic):
        return empty
    row = np.repeat(np.arange(len(toxic)), np.diff(offsets))
    held = np.arange(len(toxic)) % 5 == 4
    grade = grades(offsets, columns, values, np.where(held, -1, toxic))
    telling = chosen_features(columns[~held[row]], toxic[row][~held[row]], int(toxic[~held].sum()), int((1 - toxic[~held]).sum()))
    use = telling[columns] & ~held[row]
    own_row, own_col, own_val = row[use], columns[use], values[use]
    weight = np.where(held, 0, np.where(toxic == 1, (1 - toxic).sum() / toxic.sum() / 2, 1.0))
    weight /= weight.sum()
    above = (grade[:, None] > np.arange(GRADES - 1)).astype(float)
    w, first, gaps = np.zeros(WIDTH), 1.0, np.zeros(GRADES - 2)
    state = [np.zeros(WIDTH + GRADES - 1) for _ in range(2)]
    for t in range(1, rounds + 1):
        theta = first + np.append(0, np.cumsum(np.exp(gaps)))
        score = np.bincount(own_row, own_val * w[own_col], minlength=len(toxic))
        # grade probabilities are differences of neighbouring cumulative ones
        cumulative = np.column_stack([np.ones(len(toxic)), _sigmoid(score[:, None] - theta), np.zeros(len(toxic))])
        slope = cumulative * (1 - cumulative)
        at = np.arange(len(toxic))
        chance = np.maximum(cumulative[at, grade] - cumulative[at, grade + 1], 1e-9)
        upper, lower = slope[at, grade] / chance, slope[at, grade + 1] / chance
        by_score = -(upper - lower) * weight
        by_theta = np.array([(weight * (np.where(grade == k + 1, upper, 0) - np.where(grade == k, lower, 0))).sum() for k in range(GRADES - 1)])
        by_gap = np.array([by_theta[k + 1 :].sum() * np.exp(gaps[k]) for k in range(GRADES - 2)])
        slope_w = np.bincount(own_col, own_val * by_score[own_row], minlength=WIDTH) + decay * w
        g = np.concatenate([slope_w, [by_theta.sum()], by_gap])
        state[0] = 0.9 * state[0] + 0.1 * g
        state[1] = 0.99 * state[1] + 0.01 * g * g
        step = rate * (state[0] / (1 - 0.9**t)) / (np.sqrt(state[1] / (1 - 0.99**t)) + 1e-8) * (1 - t / (rounds + 1))
        w -= step[:WIDTH]
        first -= step[WIDTH]
        gaps = np.clip(gaps - step[WIDTH + 1 :], -4, 4)
    model = Model(w.astype(np.float32), first + np.append(0, np.cumsum(np.exp(gaps))), 0.0)
    rest = severity(model, _dot(offsets, columns, values, model.weights))
    judged = held if 0 < toxic[held].sum() < held.sum() else ~held
    model.cut = _best_cut(rest[judged], toxic[judged])
    return model


def _best_cut(scores: np.ndarray, truth: np.ndarray) -> float:
    """The middle of the gap below the cut of best F1."""
    order = np.argsort(-scores, kind="stable")
    hits = np.cumsum(truth[order])
    f1 = 2 * hits / (np.arange(1, len(hits) + 1) + truth.sum())
    k = int(np.argmax(f1))
    below = scores[order[k + 1]] if k + 1 < len(order) else 0.0
    return float((scores[order[k]] + below) / 2)


_ROW = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("columns", pa.binary()), ("values", pa.binary())])


def _sampled(batches):
    known = _Features()
    for batch in small_batches(batches, "text"):
        offsets, columns, values = features(texts_of(batch.column("text")), known)
        cut = lambda x, t: [x[a:b].astype(t).tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield as_batch(_ROW, batch.column("doc_id"), batch.column("label"), cut(columns, "<u4"), cut(values, "<f4"))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = 6000) -> Model:
    """Fit on at most ``most`` labelled documents, brought to the driver as sparse features."""
    rows = sample(docs, labels, label, most).transform(light_batches).mapInArrow(_sampled, "doc_id long, label int, columns binary, values binary").collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0]))
    offsets = np.append(0, np.cumsum([len(r[2]) // 4 for r in rows])).astype(np.int64)
    columns = np.frombuffer(b"".join(r[2] for r in rows), "<u4").astype(np.int64)
    values = np.frombuffer(b"".join(r[3] for r in rows), "<f4").astype(np.float64)
    return fit(offsets, columns, values, np.array([int(r[1] > 0) for r in rows], np.int64))


def _score(batches, model, text_col: str, name: str):
    model, known = model.value, _Features()
    for batch in small_batches(batches, text_col):
        found = severity(model, _dot(*features(texts_of(batch.column(text_col)), known), model.weights))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, name])


def _scored(docs: DataFrame, model: Model, text_col: str, name: str) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(model)  # half a megabyte, whatever the input
    plain = docs.toDF(*plain_names(docs.columns)).transform(light_batches)
    return plain.mapInArrow(partial(_score, model=held, text_col=text_col, name=name), f"{ddl_of(plain.schema)}, {name} double").toDF(*docs.columns, name)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``severity`` (0 to 3), ``grade`` (rounded) and ``toxic``; columns of these names are replaced."""
    scored = _scored(docs.drop("severity", "grade", "toxic"), model, text_col, "severity")
    return scored.withColumns({"grade": F.round("severity").cast("int"), "toxic": F.col("severity") >= F.lit(float(model.cut))})


def without_toxic(docs: DataFrame, labels: DataFrame, most: int = 6000, text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that count as toxic, with their own columns only."""
    model = train(docs, labels, most=most)
    (name,) = fresh(docs.columns, "_severity")
    return _scored(docs, model, text_col, name).where(F.col(name) < F.lit(float(model.cut))).select(*quoted(docs.columns))
