"""Sequences at scale: rows in a total order, cut into range partitions that any task can hold.

A range partition bounds the rows of a task whatever the groups are: a hot group spans many partitions, and what a
row needs from the partitions before it comes from a table with a row per partition.

Defined results: the order must be total (end it with a unique column) for results to be the same in every run; rows
equal in all order columns may trade places. Null groups are a group, nulls sort first. Empty tables stay empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.session import Scratch

PART = "_part"


def in_order(df: DataFrame, order: list, scratch: Scratch, partitions: int | None = None) -> DataFrame:
    """``df`` written in ranges of ``order`` with the number of each row's range in ``_part``."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return scratch.write(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(PART, F.spark_partition_id()))


def prefix_sums(df: DataFrame, groups: list[str], order: list[str], sums: dict[str, str], scratch: Scratch, partitions: int | None = None) -> DataFrame:
    """``df`` with, for each name in ``sums``, the sum of its SQL expression over the rows of the group before the row."""
    rows = in_order(df, [*groups, *order], scratch, partitions)
    by = ", ".join(f"`{c}`" for c in (*groups, PART))
    here = f"over (partition by {by} order by {', '.join(f'`{c}`' for c in order)} rows between unbounded preceding and 1 preceding)"
    part = rows.groupBy(*groups, PART).agg(*[F.sum(F.expr(e)).alias(f"_t_{k}") for k, e in sums.items()])
    over = "over (partition by " + (", ".join(f"`{c}`" for c in groups) or "1") + f" order by {PART} rows between unbounded preceding and 1 preceding)"
    base = part.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col(PART).alias("_p"), *[F.expr(f"sum(`_t_{k}`) {over}").alias(f"_b_{k}") for k in sums])
    # only the first group of a range can have begun before it: at most one such row per range
    base = F.broadcast(base.where(F.expr(f"`_b_{next(iter(sums))}` is not null")))
    out = rows.withColumns({f"_h_{k}": F.expr(f"sum({e}) {here}") for k, e in sums.items()})
    same = reduce(lambda a, i: a & F.col(groups[i]).eqNullSafe(F.col(f"_g{i}")), range(len(groups)), F.col(PART) == F.col("_p"))
    out = out.join(base, same, "left")
    return out.select(*df.columns, *[(F.coalesce(f"_h_{k}", F.lit(0)) + F.coalesce(f"_b_{k}", F.lit(0))).alias(k) for k in sums])


class Run:
    """The open run of a greedy cut: rows in it, their sum, and how many runs began."""

    def __init__(self, items: int = 0, total: float = 0.0, begun: int = 0):
        self.items, self.total, self.begun = items, total, begun

    def take(self, size: float, max_items: int, max_size: float) -> int:
        """Add a row; the number of its run."""
        if not self.items or self.items >= max_items or size >= 0 and self.total + size > max_size:
            self.items, self.total, self.begun = 0, 0.0, self.begun + 1
        self.items += 1
        self.total += max(size, 0.0)
        return self.begun - 1


def cut_sequences(df: DataFrame, groups: list[str], order: list[str], size: str, max_items: int, max_size: float, out: str, scratch: Scratch, partitions: int | None = None) -> DataFrame:
    """``df`` with the number (from 0) of each row's run within its group: in order, a run takes rows until the next
    would be one too many or exceed ``max_size`` in sum; a larger single row is a run of its own. Negative
    sizes count as 0, a null size joins whatever run is open, null groups are one group.

    Rows are streamed range by range. A run that is open where a range begins holds some number of the last
    ``max_items`` rows before it, so for groups that span ranges each range states what becomes of every such number;
    these few rows are chained, and then all ranges number their rows at once.
    """
    spark, names = df.sparkSession, df.columns
    keys = [f"_g{i}" for i in range(len(groups))]
    clean = df.withColumns({k: F.concat(F.lit("="), F.col(g).cast("string")) for k, g in zip(keys, groups)}).na.fill("", keys)
    clean = clean.withColumn("_s", F.coalesce(F.greatest(F.col(size).cast("double"), F.lit(0.0) + F.col(size) * 0), F.lit(-1.0)))
    rows = in_order(clean, [*keys, *order], scratch, partitions)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = [PART, *keys]
    spans = rows.groupBy(*cols).agg(F.count("*").alias("n")).withColumn("parts", F.expr(f"count(*) over (partition by {', '.join(keys) or '1'})")).where("parts > 1")
    state: dict[tuple, tuple[int, float, int]] = {}
    known = sorted((tuple(r[k] for k in keys), r[PART]) for r in spans.select(*cols).collect())  # at most two rows per range

    def streamed(df: DataFrame) -> DataFrame:
        return df.repartition(n, *cols).sortWithinPartitions(*cols, *order)

    if known:
        ranges = spark.createDataFrame([(part, *key) for key, part in known], f"{PART} int" + "".join(f", {k} string" for k in keys))
        open_rows = rows.join(F.broadcast(ranges), cols, "left_semi").select(*cols, *[c for c in order if c not in cols], "_s")
        newest = ", ".join(f"`{c}` desc nulls last" for c in order)
        last = open_rows.withColumn("_r", F.expr(f"row_number() over (partition by {', '.join(cols)} order by {newest})")).where(F.col("_r") <= max_items)
        tails = {(tuple(r[k] for k in keys), r[PART]): [x["_s"] for x in sorted(r["t"], key=lambda x: -x["_r"])] for r in last.groupBy(*cols).agg(F.collect_list(F.struct("_r", "_s")).alias("t")).collect()}
        before: dict[tuple, list[float]] = {}
        lead: list[float] = []
        for at, (key, part) in enumerate(known):
            lead = lead if at and known[at - 1][0] == key else []
            before[key, part] = lead
            lead = (lead + tails[key, part])[-max_items:]

        def followed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            now, runs, at = None, [], []

            def told() -> pd.DataFrame:
                return pd.DataFrame([(now[1], *now[0], k, runs[i].items, runs[i].total, runs[i].begun) for k, i in enumerate(at)], columns=[*cols, "k", "items", "total", "begun"])

            for pdf in batches:
                for part, *key, s in zip(pdf[PART], *[pdf[k] for k in keys], pdf["_s"]):
                    if now != (tuple(key), part):
                        if now:
                            yield told()
                        now = (tuple(key), part)
                        b = before[now]
                        runs = [Run(k, sum(x for x in b[len(b) - k :] if x > 0), 0) for k in range(len(b) + 1)]
                        at = list(range(len(runs)))
                    cut = False
                    for r in runs:
                        had = r.begun
                        r.take(s, max_items, max_size)
                        cut = cut or r.begun > had
                    if cut and len(runs) > 1:  # what ends in the same state goes on as one
                        seen: dict[tuple, int] = {}
                        to = [seen.setdefault((r.items, r.total, r.begun), len(seen)) for r in runs]
                        runs = [runs[to.index(j)] for j in range(len(seen))]
                        at = [to[i] for i in at]
            if now:
                yield told()

        schema = f"{PART} int, " + "".join(f"{k} string, " for k in keys) + "k int, items int, total double, begun long"
        step = {(tuple(r[k] for k in keys), r[PART], r["k"]): (r["items"], r["total"], r["begun"]) for r in streamed(open_rows).mapInPandas(followed, schema).collect()}
        for at, (key, part) in enumerate(known):
            if not at or known[at - 1][0] != key:
                items, total, begun = 0, 0.0, 0
            state[key, part] = (items, total, begun)
            items, total, more = step[key, part, items]
            begun += more

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, run = None, Run()
        for pdf in batches:
            got = []
            for part, *key, s in zip(pdf[PART], *[pdf[k] for k in keys], pdf["_s"]):
                if now != (tuple(key), part):
                    now = (tuple(key), part)
                    run = Run(*state.get(now, ()))
                got.append(run.take(s, max_items, max_size))
            yield pdf[names].assign(**{out: pd.Series(got, index=pdf.index, dtype="int64")})

    return streamed(rows).mapInPandas(numbered, T.StructType([*df.schema.fields, T.StructField(out, T.LongType())]))
