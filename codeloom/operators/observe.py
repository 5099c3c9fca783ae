"""Observability: counters, histograms, provider statistics, streaks, logs, rate limits and idempotency (batch forms).

The streaming forms of rate limits and idempotency share the functions ``take`` and ``judge`` (see ``codeloom.streaming``).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Upper bounds of the histogram buckets; the last is everything.
BUCKETS = [1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1000.0, 2500.0, 5000.0, 10000.0]


def counters(df: DataFrame, name: Column, labels: dict[str, Column], amount: Column | None = None) -> DataFrame:
    """(name, labels, value): sums per sorted label set; null label values count as ""."""
    rendered = F.concat_ws(",", *[F.concat(F.lit(f'{k}="'), F.coalesce(v.cast("string"), F.lit("")), F.lit('"')) for k, v in sorted(labels.items())])
    return df.select(name.alias("name"), rendered.alias("labels"), (amount if amount is not None else F.lit(1.0)).cast("double").alias("a")).groupBy("name", "labels").agg(F.round(F.sum("a"), 6).alias("value"))


def histogram(df: DataFrame, keys: list[str], value: str, bounds: list[float] | None = None) -> DataFrame:
    """keys.., le, n: cumulative counts at most each bound, and "+Inf". Null and NaN values are not observed."""
    bounds = bounds or BUCKETS
    v = F.col(value)
    x = df.where(v.isNotNull() & ~F.isnan(v))
    aggs = [F.count_if(v <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    g = x.groupBy(*keys).agg(*aggs, F.count("*").alias("all"))
    pairs = [F.struct(F.lit(f"{b:g}").alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)] + [F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("n"))]
    return g.select(*keys, F.explode(F.array(*pairs)).alias("p")).select(*keys, "p.le", "p.n")


def prometheus(df: DataFrame) -> DataFrame:
    """(line): counters rendered one per line."""
    return df.select(F.concat("name", F.when(F.col("labels") != "", F.concat(F.lit("{"), "labels", F.lit("}"))).otherwise(""), F.lit(" "), F.col("value").cast("string")).alias("line"))


def provider_stats(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: calls, successes and their rate, mean latency, tokens and cost, last error by time, last call."""
    ok = F.col("success")
    t = F.struct("called_at", "call_id")
    return df.groupBy(*keys).agg(
        F.count("*").alias("calls"), F.count_if(ok).alias("successes"), F.round(F.count_if(ok) / F.count("*"), 6).alias("success_rate"),
        F.round(F.avg(F.when(~F.isnan("duration_ms"), F.col("duration_ms"))), 3).alias("avg_latency"), F.sum("total_tokens").alias("tokens"), F.round(F.sum("cost_usd"), 4).alias("cost"),
        F.max_by("error", F.when(~ok, t)).alias("last_error"), F.max("called_at").alias("last_call"),
    )


def failure_streak(df: DataFrame, keys: list[str], order: list[str], success: str) -> DataFrame:
    """Per key, how many failures follow the last success: those ordered after it. No window over a hot key is needed."""
    t = F.struct(*order)
    last = df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.max(F.when(F.col(success), t)).alias("_last"))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    failed = ~F.coalesce(F.col(success), F.lit(False)) & (F.col("_last").isNull() | (t > F.col("_last")))
    return df.join(last, on).groupBy(*keys).agg(F.count_if(failed).alias("streak"))


def logs(df: DataFrame, level: str | None = None, component: str | None = None, since: str | None = None, limit: int = 100) -> DataFrame:
    """Newest first; component without case. Columns: log_id, ts, level, component, message."""
    x = df
    if level:
        x = x.where(F.upper("level") == level.upper())
    if component:
        x = x.where(F.lower("component") == component.lower())
    if since:
        x = x.where(F.col("ts") >= F.lit(since).cast(dict(df.dtypes)["ts"]))
    return x.orderBy(F.desc("ts"), F.desc("log_id")).limit(min(1000, limit))


def take(state: tuple[float, float] | None, at: float, rate: float, burst: float) -> tuple[bool, tuple[float, float]]:
    """One request of a token bucket: whether it passes, and (tokens, time) after it. ``rate`` is per minute."""
    tokens, last = state if state is not None else (burst, at)
    tokens = min(burst, tokens + max(0.0, at - last) * rate / 60.0)
    if tokens >= 1.0:
        return True, (tokens - 1.0, max(at, last))
    return False, (tokens, max(at, last))


def rate_limited(df: DataFrame, identity: str, at: str, order: str, rate: float = 60.0, burst: float = 10.0) -> DataFrame:
    """(identity, order, allowed) by one token bucket per identity, in time order.

    The bucket is sequential per identity, so a partition is sorted by identity and time and read as a stream; an
    identity of any size needs no more memory than one Arrow batch. Rows without an identity or a time are refused.
    """
    x = df.select(F.col(identity).alias("k"), F.col(order).alias("o"), F.unix_micros(F.col(at).cast("timestamp")).alias("t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for pdf in batches:
            out = []
            for k, t in zip(pdf["k"], pdf["t"]):
                if k != key:
                    key, state = k, None
                ok, state = take(state, t / 1e6, rate, burst)
                out.append(ok)
            yield pd.DataFrame({"k": pdf["k"], "o": pdf["o"], "allowed": out})

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = dict(x.dtypes)
    good = x.where("k is not null and t is not null").repartition(n, "k").sortWithinPartitions("k", "t", "o")
    done = good.mapInPandas(run, f"k {kinds['k']}, o {kinds['o']}, allowed boolean")
    return done.unionByName(x.where("k is null or t is null").select("k", "o", F.lit(False).alias("allowed"))).select(F.col("k").alias(identity), F.col("o").alias(order), "allowed")


def idempotent(df: DataFrame, key: str, payload: str, at: str, order: str, ttl_s: int = 86_400) -> DataFrame:
    """(order, outcome): 'new', 'replay' (same key and payload within the time to live of the key's last new
    request) or 'conflict' (another payload). A request after the time to live is new."""
    x = df.select(F.col(key).alias("k"), F.col(payload).alias("p"), F.col(order).alias("o"), F.unix_micros(F.col(at).cast("timestamp")).alias("t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for pdf in batches:
            out = []
            for k, p, t in zip(pdf["k"], pdf["p"], pdf["t"]):
                if k != current:
                    current, state = k, None
                result, state = judge(state, p, t / 1e6, ttl_s)
                out.append(result)
            yield pd.DataFrame({"o": pdf["o"], "outcome": out})

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    good = x.where("k is not null and t is not null").repartition(n, "k").sortWithinPartitions("k", "t", "o")
    done = good.mapInPandas(run, f"o {dict(x.dtypes)['o']}, outcome string")
    return done.unionByName(x.where("k is null or t is null").select("o", F.lit("new").alias("outcome"))).select(F.col("o").alias(order), "outcome")


def judge(state: tuple[str, float] | None, payload: str, at: float, ttl_s: float) -> tuple[str, tuple[str, float]]:
    """Outcome of one request, and (payload, time) of the request that holds the key."""
    if state is None or at - state[1] > ttl_s:
        return "new", (payload, at)
    return ("replay" if state[0] == payload else "conflict"), state


def severity(code: str | Column) -> Column:
    """Severity of a lint code: E9 and F errors, E and W warnings, else info."""
    c = F.col(code) if isinstance(code, str) else code
    return F.when(c.startswith("E9") | c.startswith("F"), "error").when(c.startswith("E") | c.startswith("W"), "warning").otherwise("info")


def newest(df: DataFrame, keys: list[str], order: list[str], keep: int, buckets: int = 64) -> DataFrame:
    """The ``keep`` newest rows of each key with ``dropped``, how many older ones fell out. Ranks are taken per bucket
    first, so a hot key never lies in one task."""
    part = ", ".join(f"`{k}`" for k in keys)
    by = ", ".join(f"`{c}` desc nulls last" for c in order)
    total = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    x = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets))).withColumn("_r", F.expr(f"row_number() over (partition by {part}, _b order by {by})")).where(F.col("_r") <= keep)
    x = x.withColumn("_r", F.expr(f"row_number() over (partition by {part} order by {by})")).where(F.col("_r") <= keep).drop("_r", "_b")
    t = total.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_n")
    on = None
    for i, k in enumerate(keys):
        same = F.col(k).eqNullSafe(F.col(f"_k{i}"))
        on = same if on is None else on & same
    return x.join(t, on).select(*df.columns, F.greatest(F.col("_n") - keep, F.lit(0)).cast("long").alias("dropped"))


def first_provider(providers: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """keys.., provider, hits: of providers in their order the first that has any row for the keys, and how many."""
    both = None
    for n, (name, df) in enumerate(providers.items()):
        part = df.groupBy(*keys).agg(F.count("*").alias("hits")).withColumn("_p", F.struct(F.lit(n).alias("n"), F.lit(name).alias("name")))
        both = part if both is None else both.unionByName(part)
    best = both.groupBy(*keys).agg(F.min_by(F.struct("_p", "hits"), "_p.n").alias("b"))
    return best.select(*keys, F.col("b._p.name").alias("provider"), F.col("b.hits").alias("hits"))
