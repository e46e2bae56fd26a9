"""Report metadata: filters, date repair, samples, label bookkeeping, statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quirefold.sources.shared import materialize


def open_reports(reports: DataFrame, mark: str = "C") -> DataFrame:
    """Without confidential ones; an unknown status is confidential."""
    return reports.filter(~F.col("rstatus").contains(mark))


def filter_reports(reports: DataFrame, after: str | None = None, submitter: str | None = None, include: list[str] | None = None, exclude: list[str] | None = None, legacy: bool = False, exclude_titles: list[str] | None = None) -> DataFrame:
    """Date after, submitter contains, type contains any (legacy: all) of include and none of exclude, title none of exclude_titles."""
    if after:
        reports = reports.filter(F.col("repdate") > F.to_date(F.lit(after)))
    if submitter:
        reports = reports.filter(F.col("submitby").contains(submitter))
    if include:
        has = [F.col("rtype").contains(t) for t in include]
        reports = reports.filter(reduce(lambda a, b: a & b if legacy else a | b, has))
    for t in exclude or []:
        reports = reports.filter(~F.col("rtype").contains(t))
    for t in exclude_titles or []:
        reports = reports.filter(~F.col("rtitle").contains(t))
    return reports


def stable_key(number: Column) -> Column:
    """A pseudo-random order of integers that any engine can compute."""
    return F.pmod(number * F.lit(2654435761), F.lit(4294967296))


def sample_ids(rows: DataFrame, key: str, n: int) -> DataFrame:
    """n distinct rows without replacement, the same at every run."""
    return rows.orderBy(stable_key(F.col(key)), key).limit(n)


def repair_date(d: Column, latest: str = "2020-01-01") -> Column:
    """Dates after the latest possible one are a century too late."""
    return F.when(d > F.to_date(F.lit(latest)), F.date_sub(d, 36525)).otherwise(d)


def migrate_labels(rows: DataFrame, previous: DataFrame, keys: list[str], line_offset: int = 0) -> DataFrame:
    """rows with y and tag_method='legacy' from a previous labelled set, where exactly one of its rows has the keys."""
    if line_offset:
        previous = previous.withColumn("line_num", F.col("line_num") + line_offset)
    unique = previous.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first("y").alias("y")).filter("_n = 1 and y is not null").drop("_n")
    return rows.join(unique, keys, "left").withColumn("tag_method", F.when(F.col("y").isNotNull(), "legacy"))


def auto_tag(rows: DataFrame, predicted: Column) -> DataFrame:
    """Labels that no human gave become predictions."""
    own = F.col("tag_method").isNull() | (F.col("tag_method") == "auto") | F.col("y").isNull()
    return rows.withColumn("_own", own).withColumn("y", F.when(F.col("_own"), predicted).otherwise(F.col("y"))).withColumn("tag_method", F.when(F.col("_own"), "auto").otherwise(F.col("tag_method"))).drop("_own")


def reset_suspicious(rows: DataFrame, suspicious: Column) -> DataFrame:
    """Labels 0 that flags speak against are unset, unless a human gave them."""
    bad = suspicious & (F.col("y") == 0) & F.coalesce(F.col("tag_method") != "manual", F.lit(True))
    return rows.withColumn("y", F.when(bad, None).otherwise(F.col("y")))


def uncertain(rows: DataFrame, certainty: Column, key: str, k: int) -> DataFrame:
    """The labelling queue: the k rows of least certainty."""
    return rows.withColumn("uncertainty", 1 - certainty).orderBy(F.desc("uncertainty"), key).limit(k)


def keyword_pool(rows: DataFrame, text: str, words: list[str]) -> DataFrame:
    """Rows whose text has any of the words."""
    return rows.filter(reduce(lambda a, b: a | b, [F.lower(text).contains(w) for w in words]))


def confusion(rows: DataFrame, y: str = "y", predicted: str = "predicted") -> DataFrame:
    return rows.groupBy(y, predicted).agg(F.count(F.lit(1)).alias("n"))


def class_report(rows: DataFrame, y: str = "y", predicted: str = "predicted") -> DataFrame:
    """(label, support, precision, recall, f1) from the confusion counts."""
    c = confusion(rows, y, predicted)
    both = c.select(F.explode(F.array(F.struct(F.col(y).alias("label"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p")), F.struct(F.col(predicted).alias("label"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p")))).alias("x"), F.when(F.col(y) == F.col(predicted), F.col("n")).otherwise(0).alias("hit"))
    sums = both.groupBy("x.label").agg(F.sum("x.t").alias("support"), F.sum("x.p").alias("_p"), (F.sum("hit") / 2).alias("_hit"))
    precision, recall = F.coalesce(F.try_divide("_hit", "_p"), F.lit(0.0)), F.coalesce(F.try_divide("_hit", "support"), F.lit(0.0))
    return sums.select("label", "support", precision.alias("precision"), recall.alias("recall"), F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)).alias("f1"))


def histogram(rows: DataFrame, value: str, bins: int) -> DataFrame:
    """(bucket 1..bins, n) of equal-width bins from the least to the greatest value; the range is a one-row aggregate."""
    low, high = rows.agg(F.min(value), F.max(value)).first()
    if low is None:
        return rows.select(F.lit(1).cast("long").alias("bucket"), F.lit(1).cast("long").alias("n")).limit(0)
    width = (high - low) / bins or 1
    bucket = F.least(F.floor((F.col(value) - low) / F.lit(float(width))) + 1, F.lit(bins)).cast("long")
    return rows.filter(F.col(value).isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def exact_quantiles(rows: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(key, a column for each share): quantiles with linear interpolation between neighbours, nulls apart.

    Equal values are counted before anything else; ranges of values are ranked apart, and only the ranges' sizes meet. So
    neither a key nor a value with very many rows is held by one task."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(F.col(key).alias("_k"), F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    ranges = materialize(counts.repartitionByRange("_k", "_v").withColumn("_r", F.spark_partition_id()), "value_ranges")
    sizes = ranges.groupBy("_k", "_r").agg(F.sum("_c").alias("_n"))
    order = W.partitionBy("_k").orderBy("_r").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("_k", "_r", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_start"), F.sum("_n").over(W.partitionBy("_k")).alias("_all"))
    within = W.partitionBy("_r", "_k").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = ranges.withColumn("_end", F.sum("_c").over(within)).join(sizes, ["_k", "_r"]).withColumn("_end", F.col("_end") + F.col("_start"))
    first = F.col("_end") - F.col("_c")  # ranks first .. end - 1, from 0, have the value

    def at(rank: Column) -> Column:
        return F.max(F.when((first <= rank) & (rank < F.col("_end")), F.col("_v")))

    out = []
    for name, share in shares.items():
        place = (F.col("_all") - 1) * F.lit(share)
        low, high = F.floor(place), F.ceil(place)
        part = F.max(place - low)
        out.append((at(low) * (1 - part) + at(high) * part).alias(name))
    return placed.groupBy(F.col("_k").alias(key)).agg(*out)


def modes(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, mode): the most frequent value of each key, the least of equals."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("_c"))
    most = counts.groupBy(key).agg(F.max("_c").alias("_m"))
    return counts.join(most, key).filter("_c = _m").groupBy(key).agg(F.min(value).alias("mode"))
