"""Mix sources to target weights of total size by hash-random order and distributed prefix sums.

Each record gets a hash-random key. A source's budget is its share of the mixture's size; it is met by whole
epochs of the source plus, of one more epoch, the records up to the budget in key order. Records are range-sorted by
source and key; the running sum that cuts there is that of the record's range plus the sums of the ranges before, so
that no source, however large, lies in one task.

The mixture's size is ``total`` if given; else, by ``extent``, that of all records of the sources ("all"), or the greatest
at which every source can give its share within its repeats ("exact"). A source that cannot give its share is used as
often as allowed, and the shares reached are reported.

Defined results
- Sources without a target, and null ones, take no part. Shares of sources without any token are spread over the
  others in proportion. Targets that are null or not above 0 count as none; repeats that are null or below 1 as 1.
- Records of 0 or null tokens are not used. Repeated rows are records of their own as long as their ids differ; rows
  of one id are ordered together, and ties of the key are ordered by id.
- The record that crosses the budget is taken if that comes nearer to it than leaving it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.ordered import prefix_sums
from codeloom.session import Scratch


def plan_budgets(sources: list[dict], total: float | None, extent: str = "all") -> tuple[dict[str, float], float]:
    """Tokens wanted per source and the mixture's size, from (source, share, repeats, tokens) of each."""
    live = [s for s in sources if s["tokens"] > 0 and s["share"] > 0]
    if not live:
        return {}, 0.0
    weight = sum(s["share"] for s in live)
    if total is None and extent == "all":
        total = float(sum(s["tokens"] for s in live))
    elif total is None:
        total = min(s["tokens"] * s["repeats"] * weight / s["share"] for s in live)
    return {s["source"]: min(total * s["share"] / weight, s["tokens"] * s["repeats"]) for s in live}, total


def mixture(sized: DataFrame, targets: DataFrame, record_id: str, source: str, size: str, total: float | None = None, extent: str = "all", seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(records: record_id, source, n_tokens, copies; report: one row per target source)."""
    spark = sized.sparkSession
    scratch = Scratch(spark)
    key = F.xxhash64(F.lit(seed), F.col(record_id))
    want = targets.groupBy(F.col("source").alias("source")).agg(F.sum("target_share").alias("share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1))).alias("repeats")).where(F.col("source").isNotNull())
    docs = scratch.write(sized.select(F.col(record_id).alias("record_id"), F.col(source).alias("source"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("n_tokens"), key.alias("key")).where("source is not null"))
    sums = docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n"))
    stats = want.join(sums, "source", "left").collect()
    rows = [{"source": r["source"], "share": float(r["share"] or 0), "repeats": int(r["repeats"]), "tokens": int(r["tokens"] or 0), "n": int(r["n"] or 0)} for r in stats]
    budgets, _ = plan_budgets(rows, total, extent)
    cuts = []
    for r in rows:
        b = budgets.get(r["source"], 0.0)
        epochs = int(b // r["tokens"]) if r["tokens"] else 0
        cuts.append((r["source"], r["share"], r["repeats"], r["tokens"], r["n"], float(b), epochs, float(b - epochs * r["tokens"])))
    cut = spark.createDataFrame(cuts, "source string, target_share double, max_repeats int, tokens_available long, n_records long, budget double, epochs int, rest double")
    # only sources with a target, in key order within each
    wanted = docs.join(F.broadcast(cut.select("source", "epochs", "rest", "max_repeats")) if len(cuts) <= 20_000 else cut.select("source", "epochs", "rest", "max_repeats"), "source")
    near = prefix_sums(wanted, ["source"], ["key", "record_id"], {"before": "n_tokens"}, scratch).withColumn("upto", F.col("before") + F.col("n_tokens"))
    extra = (F.col("n_tokens") > 0) & (F.col("epochs") < F.col("max_repeats")) & (F.col("rest") > 0) & (F.col("upto") - F.col("n_tokens") / 2 <= F.col("rest"))
    picked = near.withColumn("copies", F.when(F.col("n_tokens") > 0, F.col("epochs") + extra.cast("int")).otherwise(0).cast("long")).where("copies > 0")
    picked = scratch.write(picked.select("record_id", "source", "n_tokens", "copies"))
    used = {r["source"]: r for r in picked.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("t"), F.count("*").alias("n"), F.max("copies").alias("m")).collect()}  # one row per target
    all_used = sum(r["t"] for r in used.values())
    out = []
    for src, share, repeats, tokens, n, budget, _, _ in sorted(cuts):
        u = used.get(src)
        got = int(u["t"]) if u else 0
        out.append((src, share, round(got / all_used, 6) if all_used else 0.0, repeats, int(u["m"]) if u else 0, tokens, n, round(budget, 3), got, int(u["n"]) if u else 0))
    report = spark.createDataFrame(out, REPORT)
    return picked.withColumnRenamed("record_id", record_id), report


REPORT = "source string, target_share double, share_reached double, max_repeats int, most_copies long, tokens_available long, n_records long, budget double, tokens_used long, records_used long"
