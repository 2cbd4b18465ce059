"""Language identification by a byte convolutional network, trained in numpy on labelled text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import from_texts, materialize, quoted, texts

WIDTHS = (2, 3, 4)
UNDETERMINED = "und"


def to_windows(text: str, size: int) -> np.ndarray:
    """The whole lower-cased text in UTF-8 as rows of ``size`` bytes, the last one padded with zeros."""
    data = text.lower().encode("utf-8", "replace")
    rows = max(1, -(-len(data) // size))
    out = np.zeros(rows * size, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(rows, size)


@dataclass
class ByteCNN:
    """Byte embedding, convolutions of several widths, ReLU, max pooling over a window, softmax."""

    langs: list[str]
    embed: np.ndarray
    kernels: dict[int, np.ndarray]  # width -> (width * embedding size, filters)
    biases: dict[int, np.ndarray]
    dense: np.ndarray
    offset: np.ndarray

    @classmethod
    def new(cls, langs: list[str], size: int = 8, filters: int = 16, seed: int = 7) -> ByteCNN:
        r = np.random.default_rng(seed)
        normal = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        embed = r.standard_normal((256, size)).astype(np.float32) * 0.5
        embed[0] = 0
        return cls(langs, embed, {w: normal(w * size, filters) for w in WIDTHS}, {w: np.zeros(filters, np.float32) for w in WIDTHS}, normal(filters * len(WIDTHS), len(langs)), np.zeros(len(langs), np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, *self.kernels.values(), *self.biases.values(), self.dense, self.offset]

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """Gradients of the weighted mean cross entropy, in the order of parameters()."""
        n, size = x.shape
        e, dim = self.embed[x], self.embed.shape[1]
        pooled, best = [], {}
        for w, k in self.kernels.items():
            patches = np.concatenate([e[:, i : size - w + 1 + i] for i in range(w)], axis=2)
            z = patches @ k
            best[w] = z.argmax(1)  # (n, filters): only these positions have a gradient
            pooled.append(np.take_along_axis(z, best[w][:, None, :], 1)[:, 0] + self.biases[w])
        z = np.concatenate(pooled, axis=1)
        hidden = np.maximum(z, 0)
        logits = hidden @ self.dense + self.offset
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(n), y] -= 1
        p *= (weight / weight.sum())[:, None]
        up = (p @ self.dense.T) * (z > 0)
        embed = np.zeros_like(self.embed)
        kernels, biases = [], []
        for j, (w, k) in enumerate(self.kernels.items()):
            g = up[:, j * k.shape[1] : (j + 1) * k.shape[1]]
            at = x[np.arange(n)[:, None, None], best[w][:, :, None] + np.arange(w)]  # (n, filters, w)
            patch = self.embed[at].reshape(n, k.shape[1], w * dim)
            kernels.append(np.einsum("nf,nfd->df", g, patch, optimize=True))
            biases.append(g.sum(0))
            np.add.at(embed, at.ravel(), (g[:, :, None] * k.T[None]).reshape(-1, dim))
        embed[0] = 0
        return [embed, *kernels, *biases, hidden.T @ p, p.sum(0)]

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = 8, batch: int = 128, rate: float = 4e-3, seed: int = 7) -> ByteCNN:
        """Adam; the learning rate falls linearly to a tenth."""
        r, params, t = np.random.default_rng(seed), self.parameters(), 0
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        total = epochs * -(-len(x) // batch)
        for _ in range(epochs):
            order = r.permutation(len(x))
            for a in range(0, len(x), batch):
                rows = order[a : a + batch]
                t += 1
                for p, (m, v), g in zip(params, moments, self.gradients(x[rows], y[rows], weight[rows])):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (1 - 0.9 * t / total) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        return self

    def tables(self) -> list[tuple[int, list[tuple[int, np.ndarray]]]]:
        """The convolutions restated as sums of table rows: by width, (offset, table by byte pair or byte)."""
        dim, out = self.embed.shape[1], []
        for w, k in self.kernels.items():
            by_byte = [self.embed @ k[i * dim : (i + 1) * dim] for i in range(w)]
            pairs = [(i, (by_byte[i][:, None] + by_byte[i + 1][None]).reshape(65536, -1)) for i in range(0, w - 1, 2)]
            out.append((w, pairs + ([(w - 1, by_byte[-1])] if w % 2 else [])))
        return out

    def log_probabilities(self, windows: np.ndarray, tables=None, block: int = 128) -> np.ndarray:
        """(windows, langs), in blocks that stay in the cache."""
        tables, out = tables or self.tables(), []
        for a in range(0, len(windows), block):
            wide = windows[a : a + block].T.astype(np.int32)  # position first: the maximum then runs over long rows
            size, n = wide.shape
            pairs = (wide[:-1] << 8) | wide[1:]
            pooled = []
            for w, parts in tables:
                z = None
                for at, rows in parts:
                    codes = (wide if len(rows) == 256 else pairs)[at : at + size - w + 1]
                    got = rows.take(codes.ravel(), axis=0)
                    z = got if z is None else np.add(z, got, out=z)
                pooled.append(z.reshape(size - w + 1, -1).max(0).reshape(n, -1) + self.biases[w])
            logits = np.maximum(np.concatenate(pooled, axis=1), 0) @ self.dense + self.offset
            logits -= logits.max(1, keepdims=True)
            out.append(logits - np.log(np.exp(logits).sum(1, keepdims=True)))
        return np.concatenate(out) if out else np.zeros((0, len(self.langs)), np.float32)


#: Cells that the hashes are counted in, again and again.
_CELLS = 256


def _least_hashes(keys: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows of least ``hash`` (ties: least ``k``) of each ``l``.

    Three counts by cell, each within the cell that the n-th row lies in, leave about n + rows / 256^3 of a language to sort.
    """
    down = Window.partitionBy("l").orderBy("cell")
    keys = materialize(keys.withColumn("sure", F.lit(False)), "lang_keys")
    for level in (1, 2, 3):
        here = F.when(F.col("sure"), -1).otherwise(F.pmod(F.shiftright("hash", 64 - 8 * level) + (_CELLS // 2 if level == 1 else 0), F.lit(_CELLS)))
        keys = keys.withColumn("cell", here.cast("int"))
        counts = keys.groupBy("l", "cell").count()
        counts = counts.withColumn("before", F.sum("count").over(down) - F.col("count")).where(F.col("before") < n)
        last = counts.groupBy("l").agg(F.max("cell").alias("last"))  # one row a language
        keys = keys.join(last, "l").where("cell <= last").withColumn("sure", F.col("cell") < F.col("last")).drop("cell", "last")
        keys = materialize(keys, f"lang_keys{level}")
    return keys.withColumn("nth", F.row_number().over(Window.partitionBy("l").orderBy("hash", "k"))).where(F.col("nth") <= n)


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_per_lang: int = 2500, windows_per_doc: int = 3, window: int = 256, seed: int = 7) -> ByteCNN | None:
    """Fit on windows of at most ``max_per_lang`` labelled documents of each language; None without any.

    They are those of least hash of the id in each language, so every language that a document with a
    text is labelled with is in the model. Rows that share id and language count as one, that of least text.
    """
    labelled = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"), F.col(quoted(lang_col)).alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    chosen = _least_hashes(labelled.select(F.col("id").alias("k"), F.col("lang").alias("l")).distinct().withColumn("hash", F.xxhash64("k", F.lit(seed))), max_per_lang)
    chosen = chosen.select("k", "l")
    same = F.col("k").eqNullSafe(F.col("id")) & (F.col("l") == F.col("lang"))
    sample = labelled.join(F.broadcast(chosen), same).groupBy("lang", "id").agg(F.min("text").alias("text"))  # at most max_per_lang rows a language

    def cut(batches):
        for batch in batches:
            langs, found = [], []
            for lang, text in zip(batch.column(0).to_pylist(), texts(batch, "text")):
                rows = to_windows(text, window)
                for i in np.unique(np.linspace(0, len(rows) - 1, windows_per_doc).astype(int)):
                    langs.append(lang)
                    found.append(rows[i].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.binary())], names=["lang", "window"])

    rows = sorted((r.lang, bytes(r.window)) for r in sample.mapInArrow(cut, "lang string, window binary").collect())  # max_per_lang * windows_per_doc windows a language
    if not rows:
        return None
    langs = sorted({r[0] for r in rows})
    x = np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(-1, window).copy()
    y = np.searchsorted(np.array(langs), np.array([r[0] for r in rows]))
    # a part of the windows ends early, as short texts do
    r = np.random.default_rng(seed)
    for i in np.flatnonzero(r.random(len(x)) < 0.5):
        x[i, int(np.exp(r.uniform(np.log(4), np.log(window)))) :] = 0
    share = np.bincount(y, minlength=len(langs))
    return ByteCNN.new(langs, seed=seed).fit(x, y, (1.0 / share[y]).astype(np.float32), seed=seed)


def identify(docs: DataFrame, model: ByteCNN | None, *, text_col: str = "text", window: int = 256) -> DataFrame:
    """Add ``lang_pred`` and ``score``: every window of the whole text votes by its log-probabilities.

    Windows are weighted by their bytes; the score is the geometric mean of their probabilities,
    normalised over the languages. Defined results: null texts, texts without a letter, and all texts
    if there was nothing to learn from, are ``und`` with score 0; equal scores go to the language that
    sorts first; repeated rows come back each; same-named columns are replaced.
    """

    def predict(rows: list[str]) -> dict[str, pa.Array]:
        langs: list[str] = [UNDETERMINED] * len(rows)
        scores = np.zeros(len(rows))
        tables = model.tables() if model else None
        for i, text in enumerate(rows):
            if model is None or not any(map(str.isalpha, text)):
                continue
            windows = to_windows(text, window)
            weight = np.full(len(windows), float(window))
            weight[-1] = max(1, np.count_nonzero(windows[-1]))
            logits = weight @ model.log_probabilities(windows, tables) / weight.sum()
            p = np.exp(logits - logits.max())
            best = int(p.argmax())
            langs[i], scores[i] = model.langs[best], p[best] / p.sum()
        return {"lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores)}

    return from_texts(docs, text_col, {"lang_pred": pa.string(), "score": pa.float64()}, predict)


def language_id(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_on=None, **bounds) -> DataFrame:
    """Train on the labelled documents for which ``train_on`` holds (all by default) and label every document."""
    labelled = docs.where(train_on) if train_on is not None else docs
    model = train(labelled, id_col=id_col, text_col=text_col, lang_col=lang_col, **bounds)
    return identify(docs, model, text_col=text_col, window=bounds.get("window", 256))
