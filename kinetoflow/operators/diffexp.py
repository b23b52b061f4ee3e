"""Differential editing between conditions: TMM factors, moderated dispersions, and an exact test of negative binomial counts.

Rows are sites (key), columns samples; samples are few, rows many. Library sizes, factors and the likelihoods of dispersions are
aggregations over all rows; the test runs row by row in Arrow batches. A row's dispersion maximises its own conditional likelihood on a
grid, plus ``PRIOR_DF`` degrees of freedom's worth of the mean likelihood of rows of like abundance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import keep

GRID = tuple(float(x) for x in np.geomspace(1e-4, 4.0, 40))
#: Weight of the trend against a row's own likelihood, in degrees of freedom.
PRIOR_DF = 10.0
#: Rows are of like abundance by the rounded log2 of their mean count, from 0 to LEVELS - 1; the trend takes SPAN levels on either side, nearer ones more.
LEVELS, SPAN = 48, 2


def library_sizes(counts: DataFrame) -> DataFrame:
    """(sample, total) from (key, sample, n)."""
    return counts.groupBy("sample").agg(F.sum("n").cast("double").alias("total"))


def tmm_factors(counts: DataFrame, log_trim: float = 0.3, sum_trim: float = 0.05) -> DataFrame:
    """(sample, factor): trimmed means of log ratios to the sample whose upper quartile share is nearest to the mean, product 1.

    Rows that are 0 in either sample are left out; ratios' ranks (ties by key) outside the middle 40 %, and intensities' outside the
    middle 90 %, are trimmed; weights are the inverse variances.
    """
    sizes = library_sizes(counts)
    shares = counts.join(F.broadcast(sizes), "sample").where("total > 0").withColumn("share", F.col("n") / F.col("total"))
    filled = counts.groupBy("key").agg(F.sum("n").alias("s")).where("s > 0").select("key")
    quartiles = shares.join(filled, "key", "left_semi").groupBy("sample").agg(F.expr("percentile(share, 0.75)").alias("q"))
    middle = quartiles.agg(F.avg("q").alias("middle"))
    ref = quartiles.crossJoin(F.broadcast(middle)).orderBy(F.abs(F.col("q") - F.col("middle")), "sample").limit(1).select(F.col("sample").alias("ref"))
    base = shares.join(F.broadcast(ref), F.col("sample") == F.col("ref")).select("key", F.col("n").alias("rn"), F.col("total").alias("rt"))
    rows = shares.join(base, "key").where("n > 0 and rn > 0")
    ratio = F.log2(F.col("share") / (F.col("rn") / F.col("rt")))
    level = (F.log2("share") + F.log2(F.col("rn") / F.col("rt"))) / 2
    spread = (F.col("total") - F.col("n")) / F.col("total") / F.col("n") + (F.col("rt") - F.col("rn")) / F.col("rt") / F.col("rn")
    rows = rows.withColumn("m", ratio).withColumn("a", level).withColumn("v", spread)
    per = W.partitionBy("sample")
    rows = rows.withColumn("rm", F.row_number().over(per.orderBy("m", "key"))).withColumn("ra", F.row_number().over(per.orderBy("a", "key"))).withColumn("k", F.count("*").over(per))
    low_m, low_a = F.floor(F.col("k") * log_trim) + 1, F.floor(F.col("k") * sum_trim) + 1
    kept = rows.where((F.col("rm") >= low_m) & (F.col("rm") <= F.col("k") + 1 - low_m) & (F.col("ra") >= low_a) & (F.col("ra") <= F.col("k") + 1 - low_a) & (F.col("v") > 0))
    logs = kept.groupBy("sample").agg((F.sum(F.col("m") / F.col("v")) / F.sum(1 / F.col("v"))).alias("log"))
    logs = sizes.select("sample").join(logs, "sample", "left").select("sample", F.coalesce("log", F.lit(0.0)).alias("log"))
    return logs.crossJoin(F.broadcast(logs.agg(F.avg("log").alias("mean")))).select("sample", F.pow(F.lit(2.0), F.col("log") - F.col("mean")).alias("factor"))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Log gamma of positive numbers: Stirling's series, after a rise of eight by the recurrence."""
    x = np.asarray(x, float)
    rise = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    y = x + 8
    z = 1 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - rise


def _nb_conditional(y: np.ndarray, dispersion: float) -> np.ndarray:
    """Conditional log likelihood of each row of equal-sized samples, given its sum."""
    r, n, total = 1 / dispersion, y.shape[1], y.sum(1)
    return _log_gamma(y + r).sum(1) + math.lgamma(n * r) - _log_gamma(total + n * r) - n * math.lgamma(r)


def row_likelihoods(y: np.ndarray, groups: list[np.ndarray]) -> np.ndarray:
    """Conditional log likelihood of each row (samples in columns) at each dispersion of ``GRID``, over groups of two samples or more."""
    out = np.zeros((len(y), len(GRID)))
    for g in groups:
        if g.sum() > 1:
            out += np.stack([_nb_conditional(y[:, g], d) for d in GRID], axis=1)
    return out


def abundance_level(y: np.ndarray) -> np.ndarray:
    """Level of each row: log2 of its mean count plus one half, rounded, within the levels."""
    return np.clip(np.rint(np.log2(y.mean(1) + 0.5)), 0, LEVELS - 1).astype(int)


def trend(sums: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Mean likelihood of a row near each level (LEVELS x GRID), from the sums and numbers of rows by level; levels weigh 1 / (1 + distance)."""
    at = np.arange(len(rows))
    apart = np.abs(at[:, None] - at[None, :])
    weights = np.where(apart <= SPAN, 1.0 / (1 + apart), 0.0)
    return (weights @ sums) / np.maximum(weights @ rows, 1e-12)[:, None]


def exact_p(s1: int, s2: int, n1: int, n2: int, dispersion: float) -> float:
    """Two-sided probability of a split of s1 + s2 counts, over n1 and n2 samples, as unlikely as this one or more so."""
    total = s1 + s2
    if total == 0:
        return 1.0
    k = np.arange(total, dtype=float)
    rises = lambda r: np.concatenate(([0.0], np.cumsum(np.log(k + r) - np.log(k + 1))))  # noqa: E731  log of gamma(k + r) / k!, up to a constant
    log_p = rises(n1 / dispersion) + rises(n2 / dispersion)[::-1]
    log_p -= log_p.max()
    p = np.exp(log_p)
    p /= p.sum()
    return float(min(1.0, p[p <= p[s1] * (1 + 1e-9)].sum()))


def false_discovery(tested: DataFrame, p: str = "p_value", name: str = "fdr") -> DataFrame:
    """Add the FDR of Benjamini and Hochberg. Null p get null and do not count; ties share one value.

    Counts of distinct p are dealt into ranges; ranks and least quotients run within a range, and one row for each range carries
    them on: no window holds all rows.
    """
    counts = tested.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("__p")).agg(F.count("*").alias("__c"))
    rows = keep(counts.repartitionByRange("__p").withColumn("__part", F.spark_partition_id()))
    parts = rows.groupBy("__part").agg(F.sum("__c").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("__before", before).withColumn("__all", F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    rank = F.sum("__c").over(W.partitionBy("__part").orderBy("__p")) + F.col("__before")
    rows = rows.join(parts, "__part").withColumn("__q", F.col("__p") * F.col("__all") / rank)
    least = rows.groupBy("__part").agg(F.min("__q").alias("__least"))
    later = least.select("__part", F.min("__least").over(W.orderBy("__part").rowsBetween(1, W.unboundedFollowing)).alias("__later"))
    own = F.min("__q").over(W.partitionBy("__part").orderBy(F.desc("__p")))
    found = rows.join(later, "__part").select("__p", F.least(F.lit(1.0), own, F.col("__later")).alias(name))
    return tested.join(found, F.col(p) == F.col("__p"), "left").select(*tested.columns, name)


def exact_test(counts: DataFrame, conditions: dict[str, str], first: str, second: str, prior_df: float = PRIOR_DF) -> DataFrame:
    """(key, log_fc, log_cpm, dispersion, p_value, fdr) of ``second`` against ``first``; ``conditions`` maps samples to conditions.

    Counts are scaled to the geometric mean of the effective library sizes. A row's dispersion weighs its own likelihood against the trend's by
    ``prior_df``; without two samples in a condition it is 0.1. Rows without counts have p 1. FDR by Benjamini and Hochberg.
    """
    samples = sorted(s for s, c in conditions.items() if c in (first, second))
    sizes = {r["sample"]: r["total"] * r["factor"] for r in library_sizes(counts).join(tmm_factors(counts), "sample").collect()}  # a row for each sample
    common = math.exp(sum(math.log(max(sizes.get(s, 0.0), 1.0)) for s in samples) / len(samples))
    scale = {s: common / max(sizes.get(s, 0.0), 1.0) for s in samples}
    wide = counts.where(F.col("sample").isin(samples)).groupBy("key").pivot("sample", samples).agg(F.sum("n")).na.fill(0)
    cols = [F.round(F.col(f"`{s}`") * scale[s]).alias(f"s{i}") for i, s in enumerate(samples)]
    rows = keep(wide.select("key", *cols))
    groups = [np.array([conditions[s] == g for s in samples]) for g in (first, second)]
    names = [f"s{i}" for i in range(len(samples))]
    freedom = sum(max(int(g.sum()) - 1, 0) for g in groups)

    def by_level(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, seen = np.zeros((LEVELS, len(GRID))), np.zeros(LEVELS)
        for b in batches:
            y = b[names].to_numpy(float)
            y = y[y.sum(1) > 0]
            level = abundance_level(y)
            np.add.at(sums, level, row_likelihoods(y, groups))
            seen += np.bincount(level, minlength=LEVELS)
        found = np.flatnonzero(seen)
        if len(found):
            yield pd.DataFrame({"level": found, "seen": seen[found], "ll": list(sums[found])})

    prior = None
    if freedom:
        mine = rows.select(*names).mapInPandas(by_level, "level int, seen double, ll array<double>")
        mine = mine.select("level", "seen", F.posexplode("ll").alias("i", "ll")).groupBy("level", "i").agg(F.sum("ll").alias("ll"), F.sum("seen").alias("seen"))
        sums, seen = np.zeros((LEVELS, len(GRID))), np.zeros(LEVELS)
        for r in mine.collect():  # at most LEVELS x GRID numbers
            sums[r["level"], r["i"]], seen[r["level"]] = r["ll"], r["seen"]
        prior = trend(sums, seen) * (prior_df / freedom)
    n1, n2 = int(groups[0].sum()), int(groups[1].sum())

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            y = b[names].to_numpy(float)
            a, c = y[:, groups[0]].sum(1), y[:, groups[1]].sum(1)
            small = 0.125
            fc = np.log2((c / n2 + small) / (a / n1 + small))
            cpm = np.log2((y.mean(1) + small) / common * 1e6)
            spread = np.full(len(y), 0.1)
            if prior is not None:
                spread = np.array(GRID)[(row_likelihoods(y, groups) + prior[abundance_level(y)]).argmax(1)]
            p = [exact_p(int(i), int(j), n1, n2, d) for i, j, d in zip(a, c, spread)]
            yield pd.DataFrame({"key": b["key"], "log_fc": fc, "log_cpm": cpm, "dispersion": spread, "p_value": p})

    return false_discovery(keep(rows.mapInPandas(test, "key string, log_fc double, log_cpm double, dispersion double, p_value double")))


def top(tested: DataFrame, n: int = 10) -> DataFrame:
    return tested.orderBy("p_value", F.desc(F.abs("log_fc")), "key").limit(n)
