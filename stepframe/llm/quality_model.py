"""Quality classifier: Bradley-Terry ranking of documents, thresholded by a quantile of scores."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import discard, from_texts, materialize, texts, with_arrow

_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:", b"!", b"?", b"#*$%&@^~+=\\_", b"|<>[]{}/", b"\"'()-", b"\n"]
_BY_CLASS = np.zeros((256, len(_CLASSES)))
for _k, _bytes in enumerate(_CLASSES):
    _BY_CLASS[list(_bytes), _k] = 1
N_FEATURES = len(_CLASSES) + 8


def features(text: str) -> np.ndarray:
    """What a whole text looks like: rates of character classes, repetition, word and line lengths."""
    data = text.encode("utf-8", "replace")
    words = data.split()
    n, out = max(1, len(words)), np.empty(N_FEATURES)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    out[: len(_CLASSES)] = np.log1p(counts @ _BY_CLASS / n)
    lines = [x for x in data.split(b"\n") if x.strip()]
    letters = counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum()
    out[len(_CLASSES) :] = [
        np.log1p(len(words)) / 10,
        sum(map(eq, words, words[1:])) / n,
        np.log1p(len(words)) / np.log1p(len(set(words))) - 1 if len(words) > 1 else 0.0,
        sum(map(eq, words, words[2:])) / n,
        letters / max(1, len(data)),
        np.log1p(len(data) / n) / 3,
        1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(n / max(1, len(lines))) / 5,
    ]
    return out


def _linear(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w, summed in one order, so that a row's score does not depend on the rows beside it."""
    out = np.zeros(len(x))
    for j, weight in enumerate(w):
        out += x[:, j] * weight
    return out


@dataclass
class Ranker:
    """score = logistic(w (x - mean) / scale - threshold + logit(cut)): the cut lies at the threshold."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    threshold: float
    cut: float = 0.3

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = _linear((x - self.mean) / self.scale, self.w) - self.threshold + np.log(self.cut / (1 - self.cut))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


#: Sums of integers by (kind, place): the same in whatever parts and order the rows come.
Sums = dict[tuple[int, int], np.ndarray]
#: Applies a function of labels and features to all rows, some at a time, and adds up what it returns.
Tally = Callable[[Callable[[np.ndarray, np.ndarray], Sums]], Sums]

#: Rows that are summed at once.
_ROWS = 2048
#: Distance of the nodes that scores are spread over, and to how many of them a score goes. The logistic
#: function of a pair's difference is interpolated between them to about 1e-11.
_STEP, _NODES = 1 / 8, 10
#: Nodes in a cell; within a cell the curvature is taken as that of its middle. This affects only how many steps are taken.
_CELL = 2


def _add(to: Sums, more: Sums) -> None:
    for key, values in more.items():
        to[key] = to[key] + values if key in to else values


def _in_parts(fn: Callable[[np.ndarray, np.ndarray], Sums], label: np.ndarray, x: np.ndarray) -> Sums:
    out: Sums = {}
    for a in range(0, len(x), _ROWS):
        _add(out, fn(label[a : a + _ROWS], x[a : a + _ROWS]))
    return out


def _by_place(place: np.ndarray, values: np.ndarray) -> tuple[list[int], np.ndarray]:
    order = np.argsort(place, kind="stable")
    places, first = np.unique(place[order], return_index=True)
    return places.tolist(), np.add.reduceat(values[order], first, axis=0)


def _spread(label: np.ndarray, x: np.ndarray, w: np.ndarray, unit: float) -> Sums:
    """Sums of (1, x) by node, weighted for interpolation, and of (1, x) (1, x)' by cell; kinds 0 and 1, 2 and 3 by label."""
    z = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    place = _linear(x, w) / _STEP
    base = np.floor(place)
    at = np.arange(_NODES) - (_NODES // 2 - 1)
    weights = np.ones((len(x), _NODES))
    for j in range(_NODES):
        for m in range(_NODES):
            if m != j:
                weights[:, j] *= (place - base - at[m]) / (at[j] - at[m])
    a, b = np.triu_indices(z.shape[1])
    base, out = base.astype(np.int64), {}
    for k in (0, 1):
        rows = label == k
        if not rows.any():
            continue
        places, sums = _by_place(base[rows], np.rint(weights[rows][:, :, None] * z[rows][:, None] * unit).astype(np.int64))
        for j in range(_NODES):
            _add(out, {(k, p + int(at[j])): v[j] for p, v in zip(places, sums)})
        places, sums = _by_place(base[rows] // _CELL, np.rint(z[rows][:, a] * z[rows][:, b] * unit).astype(np.int64))
        _add(out, {(2 + k, p): v for p, v in zip(places, sums)})
    return out


def _blocks(good: np.ndarray, bad: np.ndarray):
    """Differences bad - good of all pairs, a slice of the good ones at a time."""
    size = max(1, 2**20 // len(bad))
    for a in range(0, len(good), size):
        yield slice(a, a + size), bad[None] - good[a : a + size, None]


def _loss(sums: Sums, w: np.ndarray, pairs: float, ridge: float, unit: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The mean logistic loss over all pairs with the ridge's, its downward gradient and its curvature."""

    def of(kind: int) -> tuple[np.ndarray, np.ndarray]:
        found = sorted(at for k, at in sums if k == kind)
        return np.array(found, float), np.array([sums[kind, at] for at in found]) / unit

    (bad, zb), (good, zg) = of(0), of(1)
    value, grad = ridge / 2 * (w @ w), -ridge * w
    for part, d in _blocks(good * _STEP, bad * _STEP):
        soft = np.logaddexp(0, d)
        p = np.exp(d - soft)  # chance that the pair is ranked wrongly
        value += zg[part, 0] @ soft @ zb[:, 0] / pairs
        grad = grad + (zg[part, 1:].T @ (p @ zb[:, 0]) - (zg[part, 0] @ p) @ zb[:, 1:]) / pairs
    (bad, mb), (good, mg) = of(2), of(3)
    n, (a, b) = len(w) + 1, np.triu_indices(len(w) + 1)
    square = lambda m: np.stack([_symmetric(v, n, a, b) for v in m])
    mb, mg, hess = square(mb), square(mg), ridge * np.eye(len(w))
    for part, d in _blocks(good * _STEP * _CELL, bad * _STEP * _CELL):
        p = np.exp(d - np.logaddexp(0, d))
        k = p * (1 - p)
        cross = mg[part, 0, 1:].T @ k @ mb[:, 0, 1:]
        own = np.tensordot(k @ mb[:, 0, 0], mg[part, 1:, 1:], 1) + np.tensordot(mg[part, 0, 0] @ k, mb[:, 1:, 1:], 1)
        hess = hess + (own - cross - cross.T) / pairs
    return float(value), grad, hess


def _symmetric(values: np.ndarray, n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((n, n))
    out[a, b] = out[b, a] = values
    return out


def _ordered(s: np.ndarray) -> np.ndarray:
    """Integers in the order of the floats; the same again gives the bits back."""
    return np.where(s < 0, s ^ np.int64(2**63 - 1), s)


def _reaching(tally: Tally, w: np.ndarray, mass: np.ndarray, goal: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The least score up to which the classes' masses reach the goal, and the rows of either class below and up to it.

    It is exact: 16 bits of all scores are counted at a time.
    """
    before, prefix = np.zeros(2, np.int64), None
    for shift in (48, 32, 16, 0):

        def count(label, x, shift=shift, prefix=prefix):
            key = _ordered((_linear(x, w) + 0.0).view(np.int64))
            rows = slice(None) if prefix is None else key >> (shift + 16) == prefix
            label, key = label[rows], key[rows] >> shift
            if not len(key):
                return {}
            places, sums = _by_place(key, np.stack([label == 0, label == 1], axis=1).astype(np.int64))
            return {(0, p): v for p, v in zip(places, sums)}

        cells = sorted(tally(count).items())
        upto = before + np.cumsum([v for _, v in cells], axis=0)
        k = min(int(np.searchsorted(upto @ mass, goal)), len(cells) - 1)
        prefix, before = cells[k][0][1], upto[k - 1] if k else before
    return float(_ordered(np.array([prefix], np.int64)).view(np.float64)[0]), before, upto[k]


def _learn(tally: Tally, n_good: int, n_bad: int, mean: np.ndarray, scale: np.ndarray, share: float, cut: float, ridge: float, steps: int) -> Ranker:
    pairs, n = float(n_good) * float(n_bad), n_good + n_bad
    unit = 2.0 ** min(32, 61 - n.bit_length())  # features have variance 1, so sums stay below 2^62
    standard = lambda fn: tally(lambda label, x: fn(label, (x - mean) / scale))
    at = lambda w: _loss(standard(lambda label, x: _spread(label, x, w, unit)), w, pairs, ridge, unit)
    w = np.zeros(len(mean))
    value, grad, hess = at(w)
    for _ in range(steps):
        step = np.linalg.solve(hess, grad)
        if grad @ step < 1e-15:  # twice what the loss is above the least one
            break
        new = at(w + step)
        while new[0] > value + 1e-9 and abs(step).max() > 1e-9:
            step = step / 2
            new = at(w + step)
        w, (value, grad, hess) = w + step, new
    # each class stands for its share of documents, whatever their numbers
    mass = np.array([share / n_bad, (1 - share) / n_good])
    border, under, upto = _reaching(standard, w, mass, share - 1e-9)
    # equal scores fall on one side together, on that which comes nearer to the share
    falls = (upto - under).sum() == 1 or upto @ mass - share <= share - under @ mass
    rows = (upto if falls else under).sum()
    beside = _reaching(standard, w, np.ones(2), rows + (0.5 if falls else -0.5))[0] if 0 < rows < n else border
    return Ranker(mean, scale, w, (border + beside) / 2, cut)


def fit(good: np.ndarray, bad: np.ndarray, *, share_bad: float | None = None, cut: float = 0.3, ridge: float = 1e-3, steps: int = 25) -> Ranker:
    """Bradley-Terry by Newton's method on the mean logistic loss of feature differences of all (good, bad) pairs.

    No pair is formed: scores are spread over nodes, and the loss is summed over the pairs of nodes.
    The threshold is the quantile of the scores that leaves ``share_bad`` of the documents below (by
    default the share of bad ones), in the middle between the two scores beside it; equal scores fall on
    one side together, on that which comes nearer to the share. Without one of the
    classes nothing can be ranked: all scores then are near 1 (only good) or near 0 (only bad or none).
    """
    x = np.concatenate([good, bad]) if len(good) + len(bad) else np.zeros((1, N_FEATURES))
    mean, scale = x.mean(0), x.std(0) + 1e-6
    if not len(good) or not len(bad):
        return _unranked(mean, scale, len(good), cut)
    label = np.repeat([1, 0], [len(good), len(bad)])
    share = len(bad) / len(label) if share_bad is None else share_bad
    return _learn(lambda fn: _in_parts(fn, label, x), len(good), len(bad), mean, scale, share, cut, ridge, steps)


def _unranked(mean: np.ndarray, scale: np.ndarray, n_good: int, cut: float) -> Ranker:
    return Ranker(mean, scale, np.zeros(len(mean)), -5.0 if n_good else 5.0, cut)


def _spark_tally(rows: DataFrame) -> Tally:
    """Sums over the rows (label, x) of a table: by partition, and then those of a place in one task."""

    def batch_of(sums: Sums) -> pa.RecordBatch:
        keys = list(sums)
        return pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in keys], pa.int32()), pa.array([p for _, p in keys], pa.int64()), pa.array([sums[k] for k in keys], pa.list_(pa.int64()))],
            names=["kind", "place", "sums"],
        )

    def tally(fn: Callable[[np.ndarray, np.ndarray], Sums]) -> Sums:
        def add(batches):
            out: Sums = {}
            for batch in batches:
                _add(out, _in_parts(fn, batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().reshape(-1, N_FEATURES)))
            yield batch_of(out)

        def merge(batches):
            out: Sums = {}
            for batch in batches:
                for kind, place, sums in zip(*[c.to_pylist() for c in batch.columns]):
                    _add(out, {(kind, place): np.array(sums, np.int64)})
            yield batch_of(out)

        schema = "kind int, place long, sums array<long>"
        merged = rows.mapInArrow(add, schema).repartition("kind", "place").mapInArrow(merge, schema)
        return {(r.kind, r.place): np.array(r.sums, np.int64) for r in merged.collect()}  # by range of scores, not by rows

    return tally


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", cut: float = 0.3, ridge: float = 1e-3, steps: int = 25) -> Ranker:
    """Fit on all labelled documents, as ``fit`` does, whose arrays need not fit one process here.

    Features are computed before the labels are joined, so that no text is shuffled.
    """
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("label"))
    measured = with_arrow(
        docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("x")).where("__id IS NOT NULL"),
        {"x": pa.list_(pa.float64())},
        lambda batch: {"x": pa.array([features(t) for t in texts(batch, "x")], pa.list_(pa.float64()))},
    )
    rows = materialize(measured.join(known, "__id").select("label", "x"), "quality_features")
    try:
        x = [F.col("x")[i] for i in range(N_FEATURES)]
        exact = lambda values: [F.sum(v.cast("decimal(28,18)")) for v in values]
        n, n_good, *sums = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0)), *exact(x)).first()
        mean = np.array([float(v or 0) for v in sums]) / max(1, n)
        squares = rows.agg(*exact([(c - F.lit(float(m))) * (c - F.lit(float(m))) for c, m in zip(x, mean)])).first()
        scale = np.sqrt(np.array([float(v or 0) for v in squares]) / max(1, n)) + 1e-6
        if not n_good or n_good == n:
            return _unranked(mean, scale, n_good, cut)
        return _learn(_spark_tally(rows), n_good, n - n_good, mean, scale, (n - n_good) / n, cut, ridge, steps)
    finally:
        discard(rows)


def score(docs: DataFrame, model: Ranker, *, text_col: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1, higher is better) and ``predicted`` (1 from ``model.cut`` on).

    Defined results: null texts count as empty, and empty texts get the score of their features; repeated
    rows come back each; an empty table gives an empty table; same-named columns are replaced.
    """

    def predict(rows: list[str]) -> dict[str, pa.Array]:
        x = [features(t) for t in rows]
        s = model.scores(np.array(x).reshape(-1, N_FEATURES))
        return {"score": pa.array(s), "predicted": pa.array((s >= model.cut).astype(np.int32))}

    return from_texts(docs, text_col, {"score": pa.float64(), "predicted": pa.int32()}, predict)
