"""Language-model scores by masked pseudo-likelihood: each word is predicted from both of its sides."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import keyed_join, materialize, mix64, packed, quoted, texts, unpacked, word_hashes

SIDE = 2  # words that are seen on either side
VOCABULARY = 2048  # rows of the embedding; row 0 is the edge of a document
EMBED, HIDDEN = 16, 32
BUCKETS = 1 << 18  # of word counts
ANCHORS = 48  # common buckets that the others are clustered by
CLUSTERS, STRATA = 8, 4  # classes of rare words: by the company they keep, and by frequency
COMMON = 32  # the commonest buckets are classes of their own
CLASSES = COMMON + CLUSTERS * STRATA
#: Weight of the network against one window seen elsewhere.
PRIOR = 1.0
#: Logarithms are summed as multiples of this, so that sums don't depend on their order.
UNIT = 2.0**-20


@dataclass
class Counts:
    """Corpus counts by bucket, and how buckets fall into classes."""

    classes: np.ndarray  # class of each bucket
    within: np.ndarray  # log probability of each bucket within its class

    @classmethod
    def of(cls, counts: np.ndarray, clusters: np.ndarray | None = None) -> "Counts":
        """The commonest buckets are classes of their own; a cluster's others fall into STRATA of about equal counts."""
        smooth = counts + 1.0
        clusters = np.zeros(BUCKETS, np.int64) if clusters is None else clusters
        order = commonest(counts)
        classes = np.zeros(BUCKETS, np.int64)
        classes[order[:COMMON]] = np.arange(COMMON)
        for k in range(CLUSTERS):
            own = order[COMMON:][clusters[order[COMMON:]] == k]
            if len(own):
                mass = np.cumsum(smooth[own])
                classes[own] = COMMON + k * STRATA + np.minimum(STRATA * (mass - smooth[own]) / mass[-1], STRATA - 1).astype(np.int64)
        return cls(classes, np.log(smooth / np.bincount(classes, smooth, CLASSES)[classes]))


def commonest(counts: np.ndarray) -> np.ndarray:
    """Buckets by descending count, ties by number."""
    return np.lexsort((np.arange(BUCKETS), -counts))


def group_anchors(pairs: np.ndarray) -> np.ndarray:
    """Cluster of each anchor from how often anchors stand near each other: spectral, then k-means from far-apart seeds."""
    both = pairs + pairs.T + 0.1
    share = both / both.sum()
    side = share.sum(1)
    ppmi = np.maximum(0, np.log(share / np.outer(side, side)))
    values, vectors = np.linalg.eigh(ppmi)
    x = vectors[:, -CLUSTERS:] * np.sqrt(np.maximum(values[-CLUSTERS:], 0))
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-9
    seeds = [0]
    while len(seeds) < CLUSTERS:
        seeds.append(int(np.argmax(((x[:, None] - x[seeds]) ** 2).sum(2).min(1))))
    centres = x[seeds]
    for _ in range(30):
        near = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
        centres = np.array([x[near == k].mean(0) if (near == k).any() else centres[k] for k in range(CLUSTERS)])
    return near


def shapes() -> list[tuple[int, ...]]:
    return [(VOCABULARY, EMBED), (2 * SIDE * EMBED, HIDDEN), (HIDDEN,), (HIDDEN, CLASSES), (CLASSES,)]


def initial(seed: int = 11) -> list[np.ndarray]:
    r = np.random.default_rng(seed)
    return [(r.standard_normal(s) / np.sqrt(s[0] if len(s) > 1 and s[0] != VOCABULARY else 4) * (len(s) > 1)).astype(np.float32) for s in shapes()]


def unpack(flat: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for s in shapes():
        out.append(flat[at : at + int(np.prod(s))].reshape(s).astype(np.float32))
        at += int(np.prod(s))
    return out


def tokens(rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, edges (0) around each; the positions of each text's words as (texts, 2) bounds."""
    edge, parts, bounds, at = np.zeros(SIDE, np.uint64), [], [], 0
    for text in rows:
        h = word_hashes(text.encode("utf-8", "replace").lower())
        parts += [edge, h | np.uint64(1)]  # never 0
        at += SIDE
        bounds.append((at, at + len(h)))
        at += len(h)
    return np.concatenate([*parts, edge]) if rows else edge, np.array(bounds, np.int64).reshape(-1, 2)


def chunks(rows: list[str], size: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``size`` characters, and at most 60,000 of them (their numbers are sent in 16 bits)."""
    start = held = 0
    for i, text in enumerate(rows):
        held += len(text)
        if held >= size or i + 1 - start >= 60_000:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(rows):
        yield start, len(rows)


def bucket(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(20)) & np.uint64(BUCKETS - 1)).astype(np.int64)


def embedded(h: np.ndarray) -> np.ndarray:
    return np.where(h == 0, 0, 1 + ((h >> np.uint64(40)) % np.uint64(VOCABULARY - 1)).astype(np.int64))


_AROUND = np.array([*range(-SIDE, 0), *range(1, SIDE + 1)])


def forward(model: list[np.ndarray], around: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    e, w, b, v, c = model
    x = e[around].reshape(len(around), -1)
    hidden = np.tanh(x @ w + b)
    logits = hidden @ v + c
    logits -= logits.max(1, keepdims=True)
    logits -= np.log(np.exp(logits).sum(1, keepdims=True))
    return x, hidden, logits


class Learner:
    """Adam on the cross entropy of classes."""

    def __init__(self, model: list[np.ndarray], rate: float = 2.8e-3) -> None:
        self.model, self.rate, self.t, self.seen = [p.copy() for p in model], rate, 0, 0
        self.moments = [(np.zeros_like(p), np.zeros_like(p)) for p in model]

    def step(self, around: np.ndarray, target: np.ndarray) -> None:
        n = len(target)
        x, hidden, p = forward(self.model, around)
        np.exp(p, out=p)
        p[np.arange(n), target] -= 1
        p /= n
        up = (p @ self.model[3].T) * (1 - hidden**2)
        cells = around.reshape(-1, 1) * EMBED + np.arange(EMBED)
        g_e = np.bincount(cells.ravel(), (up @ self.model[1].T).ravel(), VOCABULARY * EMBED).astype(np.float32).reshape(VOCABULARY, EMBED)
        self.t += 1
        self.seen += n
        for q, (m, v), g in zip(self.model, self.moments, (g_e, x.T @ up, up.sum(0), hidden.T @ p, p.sum(0))):
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            g *= g
            g *= 0.001
            v += g
            np.multiply(v, 1 / (1 - 0.999**self.t), out=g)
            np.sqrt(g, out=g)
            g += 1e-8
            np.divide(m, g, out=g)
            g *= self.rate / (1 - 0.9**self.t)
            q -= g


def word_counts(docs: DataFrame, *, text_col: str = "text") -> np.ndarray:
    """Counts of all words of all documents by bucket: summed in each task, then by Spark; BUCKETS numbers reach the driver."""

    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            rows = texts(batch, "text")
            for a, b in chunks(rows):
                h, _ = tokens(rows[a:b])
                total += np.bincount(bucket(h[h != 0]), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["b", "n"])

    found = docs.select(F.col(quoted(text_col)).alias("text")).mapInArrow(count, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS)
    out[found["b"].to_numpy()] = found["n"].to_numpy()
    return out


def clusters(docs: DataFrame, counts: np.ndarray, *, text_col: str = "text") -> np.ndarray:
    """Cluster of each bucket: that of the anchors which its words stand near, by votes over the whole corpus.

    Pairs (bucket, anchor within SIDE words) are counted in each task, summed by Spark and written. The
    driver gets the anchors' counts of each other and one number a bucket.
    """
    anchors = commonest(counts)[:ANCHORS]
    number = np.full(BUCKETS, -1, np.int64)
    number[anchors] = np.arange(ANCHORS)

    def count(batches):
        for batch in batches:
            rows, pairs, n = texts(batch, "text"), np.zeros(0, np.int64), np.zeros(0, np.int64)
            for a, b in chunks(rows, 1_000_000):
                h, _ = tokens(rows[a:b])
                found = []
                buckets = np.where(h == 0, -1, bucket(h))
                near = np.where(h == 0, -1, number[buckets])
                for k in range(1, SIDE + 1):
                    for x, y in ((buckets[k:], near[:-k]), (buckets[:-k], near[k:])):
                        both = (x >= 0) & (y >= 0)
                        found.append(x[both] * ANCHORS + y[both])
                new, times = np.unique(np.concatenate(found), return_counts=True)
                pairs, at = np.unique(np.concatenate([pairs, new]), return_inverse=True)
                n = np.bincount(at, np.concatenate([n, times]), len(pairs)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], names=["pair", "n"])

    pairs = docs.select(F.col(quoted(text_col)).alias("text")).mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    pairs = materialize(pairs.select(F.floor(F.col("pair") / ANCHORS).alias("b"), (F.col("pair") % ANCHORS).alias("a"), "n"), "pairs")
    square = np.zeros((ANCHORS, ANCHORS))
    for r in pairs.where(F.col("b").isin([int(x) for x in anchors])).collect():  # ANCHORS x ANCHORS at most
        square[number[r.b], r.a] = r.n
    groups = group_anchors(square)
    cluster = F.element_at(F.array(*[F.lit(int(g)) for g in groups]), (F.col("a") + 1).cast("int"))
    totals = {k: max(1.0, float(square[:, groups == k].sum())) for k in range(CLUSTERS)}
    weight = F.element_at(F.array(*[F.lit(1 / totals[k]) for k in range(CLUSTERS)]), F.col("k") + 1)
    votes = pairs.groupBy("b", cluster.alias("k")).agg(F.sum("n").alias("n")).groupBy("b").agg(F.max_by("k", F.struct(F.col("n") * weight, -F.col("k"))).alias("k")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[votes["b"].to_numpy()] = votes["k"].to_numpy()
    return out


def train(docs: DataFrame, counts: Counts, *, text_col: str = "text", batch: int = 1024, seed: int = 11) -> list[np.ndarray]:
    """Every task learns from its share of the corpus, from one start; the mean of the models, by words seen, is the model.

    Every word of every document is a target once. Means are taken by Spark, a number a row, in whole
    multiples of 2 ** -24, so that their order does not matter.
    """
    start = initial(seed)

    def learn(batches):
        learner = Learner(start)
        for record in batches:
            rows = texts(record, "text")
            for a, b in chunks(rows, 500_000):
                h, _ = tokens(rows[a:b])
                at = np.random.default_rng(len(h)).permutation(np.flatnonzero(h))
                ids, classes = embedded(h), counts.classes[bucket(h)]
                for k in range(0, len(at), batch):
                    learner.step(ids[at[k : k + batch, None] + _AROUND], classes[at[k : k + batch]])
        if learner.seen:
            flat = np.concatenate([p.ravel() for p in learner.model]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(np.rint(flat * 2.0**24).astype(np.int64)), pa.array(np.full(len(flat), learner.seen, np.int64))], names=["i", "x", "w"])

    sums = docs.select(F.col(quoted(text_col)).alias("text")).mapInArrow(learn, "i long, x long, w long").groupBy("i")
    means = sums.agg(F.sum(F.col("x").cast("decimal(19,0)") * F.col("w").cast("decimal(18,0)")).cast("double").alias("x"), F.sum("w").alias("w")).toArrow()
    if not len(means):
        return start
    flat = np.zeros(sum(int(np.prod(s)) for s in shapes()))
    flat[means["i"].to_numpy()] = means["x"].to_numpy() / means["w"].to_numpy() / 2.0**24
    return unpack(flat)


def network_logs(model: list[np.ndarray], counts: Counts, h: np.ndarray, block: int = 8192) -> np.ndarray:
    """The network's log probability of each word of ``h`` given the words around it; 0 at edges."""
    ids, buckets, at = embedded(h), bucket(h), np.flatnonzero(h)
    logs = np.zeros(len(h))
    for k in range(0, len(at), block):
        p = at[k : k + block]
        logits = forward(model, ids[p[:, None] + _AROUND])[2]
        logs[p] = logits[np.arange(len(p)), counts.classes[buckets[p]]] + counts.within[buckets[p]]
    return logs


#: Bits of the word in a key of window and word.
_WORD_BITS = np.uint64(20)


def window_keys(h: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word of ``h`` the part that its window (the words around it) falls into, and a key of window and word."""
    at = np.flatnonzero(h)
    window = np.zeros(len(at), np.uint64)
    for offset in _AROUND:
        window = mix64(window * np.uint64(0x9E3779B97F4A7C15) + h[at + offset])
    part = ((window >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
    return part, (mix64(window) << _WORD_BITS) | (h[at] >> (np.uint64(64) - _WORD_BITS))


def elsewhere(keys: np.ndarray, docs: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What other documents change: for (keys, docs, log probability by the network) of one part, (records, change of the log).

    Of n windows elsewhere equal to the word's own, m with the word in them, the probability is
    (m + PRIOR * network) / (n + PRIOR). Only records with n > 0 are returned.
    """
    order = np.lexsort((docs, keys))
    k, d = keys[order], docs[order]
    new_key = np.concatenate([[True], k[1:] != k[:-1]])
    new_window = np.concatenate([[True], (k[1:] >> _WORD_BITS) != (k[:-1] >> _WORD_BITS)])
    window = np.cumsum(new_window) - 1
    many = np.bincount(window)[window] > 1  # what occurs once occurs nowhere else
    order, k, d, window = order[many], k[many], d[many], window[many]
    if not len(order):
        return order, np.zeros(0)

    def runs(new: np.ndarray) -> np.ndarray:
        run = np.cumsum(new) - 1
        return np.bincount(run)[run]

    first = np.ones(1, bool)
    new_key = np.concatenate([first, k[1:] != k[:-1]])
    same_word, own_word = runs(new_key), runs(new_key | np.concatenate([first, d[1:] != d[:-1]]))
    same_window = np.bincount(window)[window]
    by_doc = np.lexsort((d, window))
    w, e = window[by_doc], d[by_doc]
    own_window = np.empty(len(d), np.int64)
    own_window[by_doc] = runs(np.concatenate([first, (w[1:] != w[:-1]) | (e[1:] != e[:-1])]))
    n, m = same_window - own_window, same_word - own_word
    other = n > 0
    order, n, m = order[other], n[other], m[other]
    base = logs[order].astype(np.float64)
    return order, np.log((m + PRIOR * np.exp(base)) / (n + PRIOR)) - base


def score(docs: DataFrame, model: list[np.ndarray], counts: Counts, n_words: int, *, text_col: str = "text", part_words: int = 1_500_000) -> DataFrame:
    """Add ``n_tokens``, ``log_prob`` (sum over all words given both sides) and ``mean_log_prob``.

    The network gives the probability of a word's class given the words around it, times the word's share of
    the class in the corpus. Where the same words stand around a place in other documents, what stands
    there between them is counted in; see elsewhere(). These windows are gathered from the whole corpus by
    one shuffle, about 12 bytes a word: to parts of about ``part_words`` windows, as many as the ``n_words`` of
    the corpus need, in blobs of arrays by chunk of texts. What a part finds goes back to the chunks, for
    windows with company only. Logs are summed in whole multiples of UNIT, so that reruns agree.

    Defined results: null texts count as empty; empty texts and those without words have 0 tokens, log_prob 0
    and a null mean; equal texts have equal scores, so repeated rows come back each with the same; an empty
    table gives an empty table; same-named columns are replaced, all others pass through.
    """
    spark = docs.sparkSession
    parts = max(1, -(-n_words // part_words))
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    keyed = packed(docs, text=text, t1=F.xxhash64(text), t2=F.xxhash64(text, F.lit(1)))

    def windows(batches):
        number = TaskContext.get().partitionId() << 32
        for record in batches:
            rows, t1, t2 = texts(record, "text"), record.column(1).to_numpy(), record.column(2).to_numpy()
            for a, b in chunks(rows):
                h, bounds = tokens(rows[a:b])
                logs = network_logs(model, counts, h)
                sums = np.concatenate([[0], np.cumsum(np.rint(logs / UNIT).astype(np.int64))])
                own = np.stack([t1[a:b], t2[a:b], bounds[:, 1] - bounds[:, 0], sums[bounds[:, 1]] - sums[bounds[:, 0]]]).astype(np.int64)
                part, keys = window_keys(h, parts)
                doc = np.repeat(np.arange(len(bounds), dtype=np.uint16), bounds[:, 1] - bounds[:, 0])
                order = np.argsort(part, kind="stable")
                ends = np.searchsorted(part[order], np.arange(parts + 1))
                keys, doc, logs = keys[order], doc[order], logs[h != 0][order].astype(np.float16)
                full = np.flatnonzero(np.diff(ends))
                blobs = [keys[ends[p] : ends[p + 1]].tobytes() + doc[ends[p] : ends[p + 1]].tobytes() + logs[ends[p] : ends[p + 1]].tobytes() for p in full]
                places = [*full.tolist(), number % parts]
                yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array([number] * len(places), pa.int64()), pa.array([False] * len(full) + [True]), pa.array([*blobs, own.tobytes()], pa.binary())], names=["part", "chunk", "own", "blob"])
                number += 1

    def compare(batches):
        held: dict[int, list[tuple[int, bytes]]] = {}
        for record in batches:
            passed = []
            for part, chunk, own, blob in zip(*(c.to_pylist() for c in record.columns)):
                if own:
                    passed.append((chunk, True, blob))
                else:
                    held.setdefault(part, []).append((chunk, blob))
            yield back(passed)
        for part in sorted(held):
            found = sorted(held.pop(part))
            sizes = [len(blob) // 12 for _, blob in found]
            keys = np.concatenate([np.frombuffer(blob, np.uint64, n) for (_, blob), n in zip(found, sizes)])
            place = np.repeat(np.arange(len(found)), sizes) << 16
            place |= np.concatenate([np.frombuffer(blob, np.uint16, n, 8 * n) for (_, blob), n in zip(found, sizes)])
            logs = np.concatenate([np.frombuffer(blob, np.float16, n, 10 * n) for (_, blob), n in zip(found, sizes)])
            at, change = elsewhere(keys, place, logs)
            places, run = np.unique(place[at], return_inverse=True)
            sums = np.zeros(len(places), np.int64)
            np.add.at(sums, run, np.rint(change / UNIT).astype(np.int64))
            ends = np.searchsorted(places >> 16, np.arange(len(found) + 1))
            rows = [(found[i][0], False, (places[ends[i] : ends[i + 1]] & 0xFFFF).astype(np.uint16).tobytes() + sums[ends[i] : ends[i + 1]].tobytes()) for i in np.flatnonzero(np.diff(ends))]
            for i in range(0, len(rows), 5000):
                yield back(rows[i : i + 5000])

    def back(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.binary())], names=["chunk", "own", "blob"])

    def add_up(batches):
        chunk, table = None, None

        def finish():
            return pa.RecordBatch.from_arrays([pa.array(x) for x in table], names=["t1", "t2", "n", "units"])

        for record in batches:
            for number, own, blob in zip(*(c.to_pylist() for c in record.columns)):
                if own:  # first of its chunk
                    if chunk is not None:
                        yield finish()
                    chunk, table = number, np.frombuffer(blob, np.int64).reshape(4, -1).copy()
                else:
                    n = len(blob) // 10
                    table[3, np.frombuffer(blob, np.uint16, n)] += np.frombuffer(blob[2 * n :], np.int64)
        if chunk is not None:
            yield finish()

    sent = keyed.select("text", "t1", "t2").mapInArrow(windows, "part int, chunk long, own boolean, blob binary").repartitionById(parts, F.col("part"))
    returned = sent.mapInArrow(compare, "chunk long, own boolean, blob binary").repartition(max(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))), "chunk")
    found = returned.sortWithinPartitions("chunk", F.desc("own")).mapInArrow(add_up, "t1 long, t2 long, n long, units long")
    found = materialize(found.groupBy("t1", "t2").agg(F.first("n").alias("n"), F.min("units").alias("units"), F.count(F.lit(1)).alias("copies")), "scores")
    out = keyed_join(keyed.select("row", "t1", "t2"), found, ["t1", "t2"], "copies", found.agg(F.sum("copies")).first()[0] or 0)
    log_prob = F.col("units") * UNIT
    return unpacked(out, docs, {"n_tokens": F.col("n"), "log_prob": log_prob, "mean_log_prob": F.when(F.col("n") > 0, log_prob / F.col("n"))})


def lm_score(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """Count, cluster, train and score on one and the same corpus; see word_counts(), clusters(), train() and score()."""
    totals = word_counts(docs, text_col=text_col)
    counts = Counts.of(totals, clusters(docs, totals, text_col=text_col))
    return score(docs, train(docs, counts, text_col=text_col), counts, int(totals.sum()), text_col=text_col)
