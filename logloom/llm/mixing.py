"""Mixing sources to target weights: every document is repeated a Poisson number of times."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SEED = 42
#: Without explicit targets a source weighs its number of documents to this power.
ALPHA = 0.5
#: Sources times copies, up to which the table of rates is broadcast (16 bytes each, 64 MB).
BROADCAST_ENTRIES = 4_000_000


def uniform(seed: int, *parts: Column) -> Column:
    """52 bits of an MD5 as a number in [0, 1): the same on every engine and run."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def _key(column: Column) -> Column:
    """Null is a source of its own, other than the empty name."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def source_rates(
    docs: DataFrame, targets: dict[str, float] | None = None, alpha: float = ALPHA, size: float | None = None
) -> DataFrame:
    """One row per source: `__source`, n_docs, rate (mean copies of a document).

    `size` is the expected number of rows of the mix, as many as there are if None.
    Sources that `targets` doesn't name have weight 0; a target without documents is
    spread over the others.
    """
    counts = docs.groupBy(_key(F.col("source")).alias("__source")).agg(F.count("*").alias("n_docs"))
    if targets is None:
        weight = F.pow(F.col("n_docs").cast("double"), F.lit(float(alpha)))
    else:
        weight = F.lit(0.0)
        for name, w in targets.items():
            if w < 0:
                raise ValueError("weights are not negative")
            weight = F.when(F.col("__source") == F.lit(f"={name}"), F.lit(float(w))).otherwise(weight)
    weighed = counts.withColumn("weight", weight)
    total, rows = weighed.agg(F.sum("weight"), F.sum("n_docs")).first()
    rows = size if size is not None else rows or 0
    rate = F.lit(float(rows)) * F.col("weight") / F.lit(float(total or 1.0)) / F.col("n_docs")
    return weighed.select("__source", "n_docs", rate.alias("rate"))


def poisson_cuts(rates: DataFrame) -> DataFrame:
    """The distribution function of each source's Poisson law, as an ascending array.

    It ends where less than 2^-52, the grain of the uniform numbers, is left.
    """
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 40).cast("int")
    steps = rates.where("rate > 0").withColumn("__k", F.explode(F.sequence(F.lit(0), last)))
    upto = W.partitionBy("__source").orderBy("__k")
    log_p = F.sum(F.when(F.col("__k") == 0, -F.col("rate")).otherwise(F.log(F.col("rate") / F.col("__k")))).over(upto)
    steps = steps.withColumn("__p", F.exp(log_p))
    steps = steps.withColumn("__cdf", F.sum("__p").over(upto))
    return steps.groupBy("__source").agg(F.array_sort(F.collect_list("__cdf")).alias("__cuts"))


def replicate(
    docs: DataFrame, targets: dict[str, float] | None = None, alpha: float = ALPHA, size: float | None = None,
    seed: int = SEED,
) -> DataFrame:
    """The mix in a global random order: the columns of `docs`, copy (from 1), mix_key.

    A document's number of copies inverts the Poisson law of its source at a uniform
    number hashed from (seed, doc_id), so it is the same on every run and does not
    depend on the other rows of its source but through the rate. Rows are ordered by a
    hash of (seed, doc_id, copy) over the whole result. Rows that repeat a doc_id get
    the same number of copies; a null doc_id is drawn by its text; a null source is a
    source; columns named copy or mix_key are replaced. Empty in, empty out. Documents
    are shuffled once, as copies; a hot source is never gathered: the rates are joined
    by broadcast up to a checked size, else by a join whose large partitions are split.
    """
    kept = [c for c in docs.columns if c not in ("copy", "mix_key")]
    rates = source_rates(docs, targets, alpha, size)
    entries = rates.agg(F.sum(F.col("rate") + 12 * F.sqrt("rate") + 42)).first()[0] or 0
    cuts = poisson_cuts(rates)
    if entries <= BROADCAST_ENTRIES and not math.isnan(entries):
        cuts = F.broadcast(cuts)
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text"), F.lit(""))))
    drawn = docs.select(*kept, _key(F.col("source")).alias("__source")).join(cuts, "__source")
    drawn = drawn.withColumn("__u", uniform(seed, name))
    times = F.size(F.filter("__cuts", lambda c: c <= F.col("__u")))
    copies = drawn.select(*kept, times.alias("__times")).where("__times > 0")
    copies = copies.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).drop("__times")
    key = F.md5(F.concat_ws("|", F.lit(f"{seed} order"), name, F.col("copy").cast("string")))
    return copies.withColumn("mix_key", key).orderBy("mix_key")


#: The same over the table `documents` with the defaults above.
REPLICATE_SQL = f"""
WITH counts AS (
  SELECT coalesce('=' || source, '') AS src, count(*) AS n FROM documents GROUP BY 1),
rates AS (
  SELECT src, CAST(sum(n) OVER () AS DOUBLE) * pow(n, {ALPHA}) / sum(pow(n, {ALPHA})) OVER () / n AS rate FROM counts),
steps AS (
  SELECT src, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 40) AS BIGINT) + 1)) AS k FROM rates),
laws AS (
  SELECT src, k, exp(sum(CASE WHEN k = 0 THEN -rate ELSE ln(rate / greatest(k, 1)) END)
    OVER (PARTITION BY src ORDER BY k)) AS p FROM steps),
cuts AS (
  SELECT src, sum(p) OVER (PARTITION BY src ORDER BY k) AS cut FROM laws),
arrays AS (SELECT src, list(cut) AS cuts FROM cuts GROUP BY src),
drawn AS (
  SELECT d.*, len(list_filter(cuts, lambda c: c <=
    CAST('0x' || substr(md5('{SEED}|' || doc_id), 1, 13) AS BIGINT) / CAST({1 << 52} AS DOUBLE))) AS times
  FROM documents d JOIN arrays a ON coalesce('=' || d.source, '') = a.src),
copies AS (
  SELECT * EXCLUDE (times), CAST(unnest(range(1, times + 1)) AS INTEGER) AS copy FROM drawn)
SELECT *, md5('{SEED} order|' || doc_id || '|' || copy) AS mix_key FROM copies
"""
