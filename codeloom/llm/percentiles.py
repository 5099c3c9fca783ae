"""Percentiles per group by radix selection over order-preserving integers.

A double's bits become an integer of the same order (``ordered_bits``). ``exact_percentiles`` histograms 16 bits
at a time: each pass aggregates (group, digit) counts before the shuffle, picks the digit that holds each target
rank, and the next pass keeps only the rows under the picked prefixes, by the doubles that bound them. Four passes give the exact value of rank
ceil(p * n). ``sketch`` is the first passes' histogram kept as a table: counts of the top ``bits`` bits. Sketches
of days or partitions combine by adding counts, and ``from_sketch`` reads percentiles from any sum of them with
relative error at most 2**-(bits - 12), reported per row as an interval that holds the exact value.

Defined results
- Null and NaN values are not ranked; -0.0 counts as 0.0; infinities and negative values rank as numbers.
- Null group keys form groups of their own. Groups without a ranked value give no row.
- Ties need no rule: equal values are one integer. Repeated rows count as often as they occur.
- Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.session import Scratch, bounded_broadcast

DIGIT = 16
SIGN = np.int64(-(2**63))


def bits_of(x: np.ndarray) -> np.ndarray:
    """Order-preserving signed 64-bit integers of doubles."""
    b = (x + 0.0).view(np.int64)
    return np.where(b < 0, ~b ^ SIGN, b)


def value_of(k: np.ndarray) -> np.ndarray:
    """Inverse of ``bits_of``."""
    return np.where(k < 0, ~(k ^ SIGN), k).view(np.float64)


def ordered_bits(x: Column | str) -> Column:
    """The integer of a double column that has neither nulls nor NaN."""

    @F.pandas_udf("long")
    def mapped(s: pd.Series) -> pd.Series:
        return pd.Series(bits_of(s.to_numpy(dtype="float64", copy=True)))

    return mapped(x)


def ordered_value(k: Column | str) -> Column:
    """The double of an integer of ``ordered_bits``."""

    @F.pandas_udf("double")
    def mapped(s: pd.Series) -> pd.Series:
        return pd.Series(value_of(s.to_numpy(dtype="int64")))

    return mapped(k)


def _values(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """g0.., v: group keys and each ranked value."""
    cols = [F.col(g).alias(f"g{i}") for i, g in enumerate(groups)]
    return df.select(*cols, F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))


def _bounds(prefix: Column, bits: int) -> tuple[Column, Column]:
    """The least and the greatest double whose integer begins with ``prefix`` of ``bits`` bits; codes beyond the infinities
    are no numbers and stand for them."""
    first = F.shiftleft(prefix, 64 - bits)
    low, high = ordered_value(first), ordered_value(first.bitwiseOR(F.lit((1 << (64 - bits)) - 1)))
    return F.coalesce(F.nanvl(low, F.lit(None).cast("double")), F.lit(float("-inf"))), F.coalesce(F.nanvl(high, F.lit(None).cast("double")), F.lit(float("inf")))


def exact_percentiles(df: DataFrame, groups: list[str], value: str, ps: list[float]) -> DataFrame:
    """groups.., p, n, value: the value of rank max(1, ceil(p * n)) among the n ranked values of the group."""
    g = [f"g{i}" for i in range(len(groups))]
    values = _values(df, groups, value)
    scratch = Scratch(df.sparkSession)
    targets = None
    for step in range(64 // DIGIT):
        rows = values
        if step:
            # only values between the bounds of a followed prefix reach Python
            want = targets.select(*[F.col(c).alias(f"w_{c}") for c in g], "prefix").distinct()
            low, high = _bounds(F.col("prefix"), DIGIT * step)
            want = bounded_broadcast(scratch.write(want.select(*[f"w_{c}" for c in g], low.alias("low"), high.alias("high"))), 200_000)
            rows = rows.join(want, reduce(lambda a, c: a & rows[c].eqNullSafe(want[f"w_{c}"]), g, (F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high"))), "left_semi")
        digit = F.shiftright(ordered_bits("v"), 64 - DIGIT * (step + 1))
        hist = rows.groupBy(*g, digit.alias("digit")).agg(F.count("*").alias("c"))
        if step:
            hist = hist.withColumn("prefix", F.shiftright("digit", DIGIT))
        hist = scratch.write(hist)
        part = ", ".join([*g, *(["prefix"] if step else [])]) or "1"
        hist = hist.withColumn("upto", F.expr(f"sum(c) over (partition by {part} order by digit)"))
        if not step:
            hist = hist.withColumn("n", F.expr(f"sum(c) over (partition by {part})"))
            t = hist.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in ps])))
            t = t.withColumn("rank", F.greatest(F.lit(1), F.ceil(F.col("p") * F.col("n"))).cast("long"))
            keep = [*g, "p", "n", "rank"]
        else:
            h = hist.select(*[F.col(c).alias(f"h_{c}") for c in g], F.col("prefix").alias("h_prefix"), "digit", "c", "upto")
            t = targets.join(h, reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"h_{c}")), g, F.col("prefix") == F.col("h_prefix")))
            keep = [*g, "p", "n", "rank"]
        t = t.where((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("c")))
        t = t.withColumn("rank", F.col("rank") - (F.col("upto") - F.col("c")))
        targets = scratch.write(t.select(*keep, F.col("digit").alias("prefix")))
    return targets.select(*[F.col(f"g{i}").alias(c) for i, c in enumerate(groups)], "p", "n", ordered_value("prefix").alias("value"))


def sketch(df: DataFrame, groups: list[str], value: str, bits: int = 20) -> DataFrame:
    """groups.., bin, n: counts of the top ``bits`` bits; add the counts of equal bins to combine sketches."""
    rows = _values(df, groups, value)
    out = rows.groupBy(*[f"g{i}" for i in range(len(groups))], F.shiftright(ordered_bits("v"), 64 - bits).alias("bin")).agg(F.count("*").alias("n"))
    return out.select(*[F.col(f"g{i}").alias(c) for i, c in enumerate(groups)], "bin", "n")


def combine(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """One sketch per ``groups`` from sketches of finer groups."""
    return sketches.groupBy(*groups, "bin").agg(F.sum("n").alias("n"))


def from_sketch(sk: DataFrame, groups: list[str], ps: list[float], bits: int = 20) -> DataFrame:
    """groups.., p, n, value, low, high: ``low <= exact <= high``; value is their middle.

    For normal numbers (high - low) / |value| is below 2**-(bits - 12), so the error is at most half of that.
    """
    part = ", ".join(f"`{c}`" for c in groups) or "1"
    h = sk.withColumn("upto", F.expr(f"sum(n) over (partition by {part} order by bin)")).withColumn("total", F.expr(f"sum(n) over (partition by {part})"))
    h = h.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in ps])))
    h = h.withColumn("rank", F.greatest(F.lit(1), F.ceil(F.col("p") * F.col("total"))).cast("long"))
    h = h.where((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n")))
    shift = 64 - bits
    first = F.shiftleft("bin", shift)
    h = h.withColumn("low", ordered_value(first)).withColumn("high", ordered_value(first.bitwiseOR(F.lit((1 << shift) - 1))))
    # the bins of the infinities reach into the codes of NaN
    h = h.withColumn("high", F.coalesce(F.nanvl("high", "low"), "low")).withColumn("low", F.coalesce(F.nanvl("low", "high"), "high"))
    return h.select(*groups, "p", F.col("total").alias("n"), ((F.col("low") + F.col("high")) / 2).alias("value"), "low", "high")


def latest(df: DataFrame, key: str, version: str) -> DataFrame:
    """One row per key: the one of greatest version. Rows with a null key are all kept."""
    cols = [c for c in df.columns if c != key]
    one = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(F.col(version).isNotNull(), F.col(version))).alias("_row"))
    return one.select(*[F.col(key) if c == key else F.col("_row")[c].alias(c) for c in df.columns]).unionByName(df.where(F.col(key).isNull()))
