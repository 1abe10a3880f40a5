"""Quality scores by a generalised additive model with pairwise interactions.

Features of a text are cut into bins at quantiles of the training rows. Boosting goes round the features in a fixed cycle;
each turn fits a shallow tree (three splits at most) on the bins of one feature to the gradient, and adds it to that
feature's lookup table. Then the pairs of features that explain most of what is left get tables of their own, boosted in
the same way with one split on either side. A score is the logistic of a sum of table entries, found for whole batches.

Nulls and empty texts have the features of an empty text (all zero) and a score like any other. Without labelled rows of
both kinds every text gets the share of the kind there is (0.5 without any). Repeated rows are scored alike; other columns are not read; texts of any length
are read whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import kernel
from lodestrata.llm.common import fresh, small_batches, training_rows, with_score

TRAIN_ROWS = 20_000  # labelled documents at most
BINS, CYCLES, PAIRS, PAIR_CYCLES, RATE = 32, 60, 6, 30, 0.15
NAMES = ["words", "word_length", "distinct", "commonest", "adjacent", "capitals", "digits", "symbols", "bars", "stops", "exclaims", "line_length", "repeated_lines", "marked_words", "long_words", "non_ascii", "brackets"]


def _masks() -> np.ndarray:
    out = np.zeros((9, 256), np.float32)
    for row, chars in enumerate((bytes(range(65, 91)), b"0123456789", b"#$%&*+=@^~\\_", b"|", b".,;:?", b"!", b"\n", bytes(range(128, 256)), b"<>{}[]()/")):
        out[row, list(chars)] = 1
    return out


MASKS = _masks()
END = np.zeros(256, bool)
END[list(b"#$%&*+=@^~|!<>{}[]")] = True
NEWLINE = np.zeros(256, bool)
NEWLINE[10] = True


def _per_row(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values[at[i]:at[i+1]]."""
    sums = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return sums[at[1:]] - sums[at[:-1]]


def _repeats(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of distinct values and the count of the commonest one in each row."""
    n = len(at) - 1
    distinct, most = np.zeros(n), np.zeros(n)
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        if b > a:
            s = np.sort(h[a:b])
            edges = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1], [True])))
            distinct[i], most[i] = len(edges) - 1, np.diff(edges).max()
    return distinct, most


def describe(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of features for each text."""
    starts, ends, at = kernel.words(buf, offsets)
    n = np.diff(at).astype(float)
    one, size = np.maximum(n, 1), np.maximum(np.diff(offsets), 1).astype(float)
    out = np.zeros((len(n), len(NAMES)))
    if not len(buf):
        return out
    h = kernel.hashes(kernel.LOWERED[buf], starts, ends)
    lengths = ends - starts
    distinct, most = _repeats(h, at)
    same = np.zeros(len(h))
    same[1:] = h[1:] == h[:-1]
    first = at[:-1][n > 0]
    same[first] = 0
    shares = np.stack([_per_row(m[buf], offsets) for m in MASKS], 1)
    lines_s, lines_e, lines_at = kernel.words(buf, offsets, NEWLINE)
    lines, line_distinct = np.diff(lines_at).astype(float), _repeats(kernel.hashes(buf, lines_s, lines_e), lines_at)[0]
    out[:, 0] = np.log1p(n)
    out[:, 1] = _per_row(lengths, at) / one
    out[:, 2] = distinct / np.maximum(n, 1) ** 0.8
    out[:, 3] = most / one
    out[:, 4] = _per_row(same, at) / one
    out[:, [5, 6, 7, 8, 15, 16]] = shares[:, [0, 1, 2, 3, 7, 8]] / size[:, None]
    out[:, [9, 10]] = shares[:, [4, 5]] / one[:, None]
    out[:, 11] = np.log1p(n / np.maximum(lines, 1))
    out[:, 12] = 1 - line_distinct / np.maximum(lines, 1) * (lines > 0) - (lines == 0)
    out[:, 13] = _per_row(END[buf[ends - 1]] if len(ends) else np.zeros(0), at) / one
    out[:, 14] = _per_row(lengths > 20, at) / one
    return out


class Additive:
    """Bin edges and tables; all of a bounded size."""

    def __init__(self, edges, base: float, tables, pairs, pair_tables):
        self.edges, self.base, self.tables, self.pairs, self.pair_tables = edges, base, tables, pairs, pair_tables

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            z += t[b[:, j]]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            z += t[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _tree(g: np.ndarray, w: np.ndarray, splits: int = 3, ridge: float = 2.0) -> np.ndarray:
    """Leaf values over the bins of one feature, from sums of gradients and curvatures, by best-first splits."""
    leaves = [(0, len(g))]
    G, W = np.concatenate(([0], np.cumsum(g))), np.concatenate(([0], np.cumsum(w)))
    part = lambda a, b: (G[b] - G[a]) ** 2 / (W[b] - W[a] + ridge)
    for _ in range(splits):
        best = max(((part(a, c) + part(c, b) - part(a, b), k, c) for k, (a, b) in enumerate(leaves) for c in range(a + 1, b)), default=(0, 0, 0))
        if best[0] <= 1e-6:
            break
        _, k, c = best
        a, b = leaves[k]
        leaves[k : k + 1] = [(a, c), (c, b)]
    out = np.zeros(len(g))
    for a, b in leaves:
        out[a:b] = (G[b] - G[a]) / (W[b] - W[a] + ridge)
    return out


def _quadrants(g: np.ndarray, w: np.ndarray, ridge: float = 2.0) -> tuple[float, np.ndarray]:
    """The best single split on each of two features together: its gain, and its values over the bins of the pair."""
    G, W = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, w))
    n, m = g.shape
    i, j = np.meshgrid(np.arange(1, n), np.arange(1, m), indexing="ij")
    corners = [(0, i, 0, j), (0, i, j, m), (i, n, 0, j), (i, n, j, m)]
    area = lambda S, a, b, c, d: S[b, d] - S[a, d] - S[b, c] + S[a, c]
    gain = sum(area(G, *c) ** 2 / (area(W, *c) + ridge) for c in corners)
    if not gain.size:
        return 0.0, np.zeros_like(g)
    x, y = np.unravel_index(gain.argmax(), gain.shape)
    out = np.zeros_like(g)
    for a, b, c, d in ((0, x + 1, 0, y + 1), (0, x + 1, y + 1, m), (x + 1, n, 0, y + 1), (x + 1, n, y + 1, m)):
        out[a:b, c:d] = area(G, a, b, c, d) / (area(W, a, b, c, d) + ridge)
    return float(gain.max()), out


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(len(NAMES))]
    rate = (y.sum() + 0.5) / (len(y) + 1)
    model = Additive(edges, float(np.log(rate / (1 - rate))), [np.zeros(len(e) + 1) for e in edges], [], [])
    if not len(y) or y.min() == y.max():
        return model
    b = model.bins(x)
    z = np.full(len(y), model.base)
    grad = lambda: ((p := 1 / (1 + np.exp(-z))), y - p, p * (1 - p))[1:]
    for _ in range(CYCLES):
        for j, t in enumerate(model.tables):
            g, w = grad()
            add = RATE * _tree(np.bincount(b[:, j], g, len(t)), np.bincount(b[:, j], w, len(t)))
            t += add
            z += add[b[:, j]]

    def sums(i, j):
        g, w = grad()
        shape = len(model.tables[i]), len(model.tables[j])
        flat = b[:, i] * shape[1] + b[:, j]
        return np.bincount(flat, g, shape[0] * shape[1]).reshape(shape), np.bincount(flat, w, shape[0] * shape[1]).reshape(shape)

    ranked = sorted(((_quadrants(*sums(i, j))[0], i, j) for i in range(len(NAMES)) for j in range(i)), reverse=True)[:PAIRS]
    model.pairs = [(i, j) for _, i, j in ranked]
    model.pair_tables = [np.zeros((len(model.tables[i]), len(model.tables[j]))) for i, j in model.pairs]
    for _ in range(PAIR_CYCLES):
        for (i, j), t in zip(model.pairs, model.pair_tables, strict=True):
            add = RATE * _quadrants(*sums(i, j))[1]
            t += add
            z += add[b[:, i], b[:, j]]
    return model


def _features(batches, keep: int, at: int | None = None):
    """(kept columns, features) of each batch; at: the place of the text (behind the kept columns)."""
    for batch in kernel.parts(batches, 2048):
        rows = [describe(buf, offsets) for _, buf, offsets in kernel.pieces(batch.column(keep if at is None else at))]
        yield [batch.column(i) for i in range(keep)], np.concatenate(rows) if rows else np.zeros((0, len(NAMES)))


def train(docs: DataFrame, labels: DataFrame, kept: Column, label: str = "quality", limit: int = TRAIN_ROWS) -> Additive:
    def run(batches):
        import pyarrow as pa

        for (y,), x in _features(batches, 1):
            yield pa.RecordBatch.from_arrays([y, pa.array(list(x), pa.list_(pa.float64()))], names=["y", "x"])

    rows = training_rows(small_batches(docs), labels, label, kept, limit).select("y", F.col("text").cast("binary").alias("t"))
    found = rows.mapInArrow(run, "y int, x array<double>").toArrow()  # `limit` rows at most
    x = found["x"].combine_chunks().flatten().to_numpy().reshape(-1, len(NAMES)) if len(found) else np.zeros((0, len(NAMES)))
    y = found["y"].to_numpy().astype(float)
    order = np.lexsort((y, *x.T))
    return fit(x[order], y[order])


def score(docs: DataFrame, model: Additive, keep: list[str], text: str = "text", name: str = "score") -> DataFrame:
    """The kept columns and a column of scores, 0 to 1."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    at = keep.index(text) if text in keep else len(keep)

    def run(batches):
        import pyarrow as pa

        for columns, x in _features(batches, len(keep), at):
            yield pa.RecordBatch.from_arrays([*columns, pa.array(shipped.value.score(x), pa.float64())], names=[*keep, name])

    own = small_batches(docs).select(*keep, *([docs[text].cast("binary").alias(fresh(keep, "_text"))] if text not in keep else []))
    return own.mapInArrow(kernel.trimmed(run), with_score(own, len(keep), name))
