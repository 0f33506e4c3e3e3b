"""Quality score by histogram gradient-boosted trees over document statistics.

Statistics (``STATISTICS``) are taken from the whole text only: shares of kinds
of characters, word and line shapes, repetition, compressibility.  Trees of fixed
depth are grown on binned statistics by gradient histograms with the logistic
loss, and flattened into arrays: all trees step down one level at a time for a
whole batch by numpy indexing.

The model is fitted on the driver on at most ``most`` labelled documents (a
parameter) whose crc32 of the id is not 0 modulo 5; all documents are scored in
tasks.

Defined cases: a null text counts as empty, and empty texts are scored like any
other from their statistics; ids that are null count as held out; with no usable
labels of both kinds the score is the share of label 1 (1 without any label).
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

from tickloom.llm.common import as_batch, light_batches, small_batches, texts_of
from tickloom.llm.labelled import sample

STATISTICS = (
    "log_bytes", "log_words", "log_lines", "letters", "digits", "spaces", "upper", "marks", "wide", "common_mark",
    "odd_marks", "word_mean", "word_deviation", "longest_word", "distinct_words", "top_word", "same_next", "distinct_pairs",
    "line_mean", "short_lines", "distinct_lines", "ends_with_mark", "marked_words", "single_bytes", "entropy", "compressed",
)
BINS, DEPTH = 64, 4
_KIND = np.zeros((8, 256), np.float64)
for _row, _bytes in enumerate((range(97, 123), range(48, 58), (9, 10, 11, 12, 13, 32), range(65, 91), b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", range(128, 256), b"#$%&*+/<=>@[\\]^_`{|}~")):
    _KIND[_row, list(_bytes)] = 1
_MARKS = np.flatnonzero(_KIND[4])


def statistics(text: bytes) -> list[float]:
    """The numbers named in ``STATISTICS`` for one text's UTF-8 bytes."""
    raw = np.frombuffer(text, np.uint8)
    size = max(1, len(raw))
    counts = np.bincount(raw, minlength=256)
    small, digits, spaces, upper, marks, wide, odd = (_KIND[:7] @ counts) / size
    words = text.split()
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    times = Counter(words)
    pairs = list(zip(words, words[1:]))
    lines = text.split(b"\n")
    line_lengths = np.fromiter(map(len, lines), np.float64, len(lines))
    share = counts[counts > 0] / size
    last = counts[_MARKS].max() / size
    return [
        np.log1p(len(raw)), np.log1p(len(words)), np.log1p(len(lines)), small + upper + wide, digits, spaces, upper, marks, wide, last,
        odd, lengths.mean(), lengths.std(), np.log1p(lengths.max()), len(times) / n, max(times.values(), default=0) / n,
        sum(a == b for a, b in pairs) / n, len(set(pairs)) / max(1, len(pairs)),
        np.log1p(line_lengths.mean()), (line_lengths < 20).mean(), len(set(lines)) / len(lines),
        float(text.rstrip()[-1:] in (b".", b"!", b"?")), sum(not w[-1:].isalnum() and w[-1:].isascii() for w in words) / n,
        (lengths == 1).mean(), float(-(share * np.log2(share)).sum()), len(zlib.compress(text, 1)) / size,
    ]


@dataclass
class Trees:
    """All trees as arrays: node i of a level-ordered complete tree has children 2i+1 and 2i+2."""

    feature: np.ndarray  # int16, trees x (2**DEPTH - 1)
    cut: np.ndarray  # float64, go right above it
    leaf: np.ndarray  # float64, trees x 2**DEPTH
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        rows, trees = np.arange(len(x))[:, None], np.arange(len(self.leaf))[None, :]
        node = np.zeros((len(x), len(self.leaf)), np.int64)
        for _ in range(DEPTH):
            right = x[rows, self.feature[trees, node]] > self.cut[trees, node]
            node = 2 * node + 1 + right
        raw = self.base + self.leaf[trees, node - (2**DEPTH - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(raw, -40, 40)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, rate: float = 0.15, penalty: float = 2.0, least: float = 4.0) -> Trees:
    """Boost ``trees`` trees of depth ``DEPTH`` on binned columns."""
    nodes = 2**DEPTH - 1
    share = y.mean() if len(y) else 1.0
    base = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    out = Trees(np.zeros((trees, nodes), np.int16), np.full((trees, nodes), np.inf), np.zeros((trees, 2**DEPTH)), base)
    if not 0 < share < 1:
        return out
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)])
    width = x.shape[1]
    flat = binned + np.arange(width) * BINS
    raw = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        slope, curve = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, many = 2**level - 1, 2**level
            where = ((node - first)[:, None] * (width * BINS) + flat).ravel()
            g, h = (np.bincount(where, np.repeat(v, width), many * width * BINS).reshape(many, width, BINS).cumsum(axis=2) for v in (slope, curve))
            all_g, all_h = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + penalty) + (all_g - g) ** 2 / (all_h - h + penalty) - all_g**2 / (all_h + penalty)
            gain[(h < least) | (all_h - h < least)] = 0
            best = gain.reshape(many, -1).argmax(axis=1)
            feature, at = best // BINS, best % BINS
            for k in range(many):
                if gain[k, feature[k], at[k]] > 1e-6 and at[k] < len(edges[feature[k]]):
                    out.feature[t, first + k], out.cut[t, first + k] = feature[k], edges[feature[k]][at[k]]
            right = x[np.arange(len(y)), out.feature[t, node]] > out.cut[t, node]
            node = 2 * node + 1 + right
        leaf = node - nodes
        g, h = (np.bincount(leaf, v, 2**DEPTH) for v in (slope, curve))
        out.leaf[t] = -rate * g / (h + penalty)
        raw += out.leaf[t, leaf]
    return out


_ROW = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("x", pa.list_(pa.float64()))])


def _sampled(batches):
    for batch in small_batches(batches, "text"):
        yield as_batch(_ROW, batch.column("doc_id"), batch.column("label"), [statistics(t) for t in texts_of(batch.column("text"))])


def held_out(column: F.Column) -> F.Column:
    """Whether an id belongs to the fold that no label is learnt from."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = 16000) -> Trees:
    """Fit on at most ``most`` labelled documents outside the held-out fold, brought to the driver as statistics."""
    usable = labels.where(~held_out(F.col("doc_id")))
    rows = sample(docs, usable, label, most).transform(light_batches).mapInArrow(_sampled, "doc_id long, label int, x array<double>").collect()
    rows.sort(key=lambda r: r[0])
    return grow(np.array([r[2] for r in rows]).reshape(len(rows), len(STATISTICS)), np.array([float(r[1] > 0) for r in rows]))


def _score(batches, model):
    model = model.value
    for batch in small_batches(batches, "text"):
        x = np.array([statistics(t) for t in texts_of(batch.column("text"))])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x), pa.float64())], names=["doc_id", "score"])


def score(docs: DataFrame, model: Trees, cut: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # some tens of kilobytes, whatever the input
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = docs.transform(light_batches).mapInArrow(partial(_score, model=held), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= F.lit(cut)).cast("int").alias("predicted"))
