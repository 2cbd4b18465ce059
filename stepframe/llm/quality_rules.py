"""Host-level quality rules: rule failures by domain, shrunk by an empirical beta prior. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import SPACE_CLASS, WHITESPACE, materialize, packed, quoted, unpacked


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(WHITESPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE_CLASS}]+"))


def text_rules(docs: DataFrame, *, text_col: str = "text", window: int = 8) -> DataFrame:
    """Add ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of each text; same-named columns are replaced."""
    return unpacked(_counted(packed(docs, text=text_col), window), docs, {c: F.col(c) for c in COUNTS})


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _counted(d: DataFrame, window: int = 8) -> DataFrame:
    """The counts of column ``text`` in place of it."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = [c for c in d.columns if c != "text"]
    d = d.withColumn("words", words_of(text)).withColumn("lines", F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WHITESPACE)) != ""))
    starts = F.sequence(F.lit(1), F.size("words") - (window - 1))
    hashes = F.when(F.size("words") >= window, F.transform(starts, lambda i: F.xxhash64(F.slice("words", i, window)))).otherwise(F.array().cast("array<bigint>"))
    d = d.withColumn("h", hashes).withColumn("repeats", F.size(F.array_distinct("h")) < F.size("h"))
    # (hash, start) in the order of hashes; those that equal a neighbour are repeats, back in the order of starts
    pairs = F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("pairs", F.when(F.col("repeats"), pairs))
    at = lambda k: F.get(F.col("pairs"), k)["h"]
    marked = F.transform("pairs", lambda p, k: F.when((p["h"] == at(k - 1)) | (p["h"] == at(k + 1)), p["i"]))
    d = d.withColumn("at", F.sort_array(F.filter(marked, lambda x: x.isNotNull())))
    gaps = F.zip_with("at", F.slice("at", 2, F.size("at")), lambda a, b: F.least(F.lit(window), F.coalesce(b - a, F.lit(window))))
    new = {
        "n_words": F.size("words"),
        "word_chars": F.length(F.array_join("words", "")),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": F.coalesce(F.aggregate(gaps, F.lit(0), lambda s, x: s + x), F.lit(0)),
    }
    return d.select(*kept, *[v.cast("long").alias(k) for k, v in new.items()])


def host_rates(failures: DataFrame, *, host_col: str = "host", failed_col: str = "failed") -> DataFrame:
    """One row a host: ``host, n, n_failed, rate, prior_mean, prior_strength`` with rate = (n_failed + a) / (n + a + b).

    The beta prior (a, b) comes from the hosts' own rates by the method of moments: m is the pooled rate,
    v the variance of rates weighted by n less what binomial noise explains, and a + b = m (1 - m) / v - 1,
    kept within [1, 1e6]; without failures (or only failures) every rate is the pooled one.

    Defined results: a null host is a host of its own; a null verdict counts as no failure; repeated rows count
    each; an empty table gives no hosts; other columns are not read, so none can clash.
    """
    hosts = failures.groupBy(F.col(host_col).alias("host")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.col(failed_col), F.lit(False)).cast("long")).alias("n_failed"))
    r = F.col("n_failed") / F.col("n")
    prior = hosts.agg(F.sum("n").alias("__n"), F.sum("n_failed").alias("__f"), F.count(F.lit(1)).alias("__k"), F.sum(F.col("n") * r * r).alias("__s2"))
    m = F.col("__f") / F.col("__n")
    between = F.col("__s2") / F.col("__n") - m * m - m * (1 - m) * F.col("__k") / F.col("__n")
    strength = F.when(between > 0, m * (1 - m) / between - 1).otherwise(F.lit(1e6))
    prior = prior.select(m.alias("__m"), F.least(F.greatest(strength, F.lit(1.0)), F.lit(1e6)).alias("__ab"))
    shrunk = (F.col("n_failed") + F.col("__m") * F.col("__ab")) / (F.col("n") + F.col("__ab"))
    return hosts.join(F.broadcast(prior)).select("host", "n", "n_failed", shrunk.alias("rate"), F.col("__m").alias("prior_mean"), F.col("__ab").alias("prior_strength"))  # prior: one row


def quality_rules(docs: DataFrame, *, text_col: str = "text", host_col: str = "source", min_words: int = 20, max_repeat_percent: int = 30, max_host_rate: float = 0.5) -> DataFrame:
    """Base rules for each document and the verdict on its host; adds the counts, ``base_failed`` and ``kept``.

    A document fails with under ``min_words`` words, or if over ``max_repeat_percent`` % of its words lie in
    repeated 8-word windows. Failures are summed by host, rates shrunk by the prior of host_rates(), and
    the verdicts joined back: a document is kept if it passes itself and its host's rate is within the limit.
    The limit comes from the prior: two of its standard deviations above its mean, but at least three times
    the mean and at most ``max_host_rate``. A host of few documents, failing by chance, thus stays near the
    common rate, and where hosts hardly differ, none falls for differing a little.

    The texts are read once; only counts are written, summed by host (partial aggregates, so that a host
    with a third of all rows is no hot spot) and joined back.

    Defined results: null text has no words and fails; documents of a null host are judged as one host;
    repeated rows count and come back each; empty tables give empty tables; same-named columns are replaced.
    """
    others = docs.select(*[quoted(c) for c in docs.columns if c != text_col])
    row = F.struct(*[F.col(quoted(c)) for c in others.columns])
    counted = _counted(docs.select(row.alias("row"), F.col(quoted(host_col)).alias("of_host"), F.col(quoted(text_col)).alias("text")))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    counted = materialize(counted.withColumn("base_failed", failed), "counts")
    m, spread = F.col("prior_mean"), F.sqrt(F.col("prior_mean") * (1 - F.col("prior_mean")) / (F.col("prior_strength") + 1))
    hosts = host_rates(counted, host_col="of_host", failed_col="base_failed")
    hosts = hosts.select("host", F.col("rate").alias("host_rate"), F.least(F.lit(max_host_rate), F.greatest(3 * m, m + 2 * spread)).alias("limit"))
    out = counted.join(hosts, F.col("of_host").eqNullSafe(F.col("host")), "left")
    added = {c: F.col(c) for c in (*COUNTS, "base_failed", "host_rate")}
    return unpacked(out, others, added | {"kept": ~F.col("base_failed") & (F.col("host_rate") <= F.col("limit"))})
