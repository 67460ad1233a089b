"""Usage, cost, session and timeline analytics. Times are epoch milliseconds, ``now_ms`` a parameter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def between_ms(at: Column, start_ms: int | None, end_ms: int | None) -> Column:
    """start <= at < end; an end that isn't given is open."""
    out = F.lit(True)
    if start_ms is not None:
        out = out & (at >= start_ms)
    return out if end_ms is None else out & (at < end_ms)


def fresh(updated_at: Column, now_ms: int, max_age_ms: int | None) -> Column:
    return F.lit(True) if max_age_ms is None else updated_at >= now_ms - max_age_ms


def by_day(df: DataFrame, at: Column, name: str) -> DataFrame:
    """Rows for each UTC day that has any."""
    return df.groupBy(F.date_format(at, "yyyy-MM-dd").alias("day")).agg(F.count("*").alias(name))


def llm_costs(usage: DataFrame, prices: DataFrame, on_missing: str = "raise") -> DataFrame:
    """Tokens, calls and cost in total, by model and by agent. prices has one row
    a model; Spark broadcasts it if its size allows. A model without a price raises, or counts as null with on_missing="null"."""
    priced = usage.join(prices, "model_name", "left")
    cost = F.col("prompt_tokens") / 1e6 * F.col("input_per_million") + F.col("output_tokens") / 1e6 * F.col("output_per_million")
    if on_missing == "raise":
        cost = F.when(F.col("input_per_million").isNull(), F.raise_error(F.concat(F.lit("no price for model "), F.coalesce("model_name", F.lit("null"))))).otherwise(cost)
    rows = priced.select("model_name", "agent_name", F.col("prompt_tokens").cast("long").alias("prompt_tokens"), F.col("output_tokens").cast("long").alias("output_tokens"), cost.alias("cost"))
    return rows.groupingSets([[], ["model_name"], ["agent_name"]], "model_name", "agent_name").agg(
        F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"), F.count("*").alias("calls")
    )


def _success() -> Column:
    ended = F.count("finish_reason")
    return F.round(F.when(ended == 0, 0.0).otherwise(F.count_if(F.col("finish_reason") == "ANSWER_COMPLETE") / ended), 9)


def session_measures(sessions: DataFrame, modes: Sequence[str]) -> DataFrame:
    """One row: totals, rates, and the truncated average duration of each mode (null without any)."""
    averages = [F.floor(F.avg(F.when(F.col("mode") == m, F.col("duration_ms")))).cast("long").alias(f"avg_{m}_ms") for m in modes]
    found = F.round(F.when(F.count("*") == 0, 0.0).otherwise(F.count_if("answer_found") / F.count("*")), 9)
    return sessions.agg(F.count("*").alias("total"), _success().alias("success_rate"), found.alias("found_rate"), *averages)


def domain_measures(sessions: DataFrame) -> DataFrame:
    """By domain, most sessions first, ties by domain."""
    out = sessions.groupBy("domain").agg(F.count("*").alias("sessions"), _success().alias("success_rate"))
    return out.orderBy(F.desc("sessions"), "domain")


def timeline(events: DataFrame, processed: Sequence[str], iteration: str) -> DataFrame:
    return events.groupBy("session_id").agg(
        F.count("*").alias("n_events"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"), (F.max("ms") - F.min("ms")).alias("duration_ms"),
        F.count_if(F.col("event_type").isin(*processed)).alias("urls_processed"), F.count_if(F.col("event_type") == iteration).alias("iterations"), F.array_sort(F.collect_set("event_type")).alias("types"),
    )


def stage_counts(states: DataFrame, key: str, stages: Sequence[str]) -> DataFrame:
    """Rows in all, by stage, and failed ones (which also count in their stage)."""
    return states.groupBy(key).agg(F.count("*").alias("total"), *(F.count_if(F.col("stage") == s).alias(f"stage_{s.lower()}") for s in stages), F.count("error").alias("failed"))


def described_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts of a small vocabulary as one text, most frequent first."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    rows = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col(column).alias("v"))))
    return counts.agg(F.array_join(F.transform(rows, lambda r: F.concat(r["v"], F.lit(": "), (-r["n"]).cast("string"))), ", ").alias("description"))


def subscription_usage(subscriptions: DataFrame, now_ms: int) -> DataFrame:
    """Of rows that haven't expired: the PAID ones of a user if there are any, else the FREE ones."""
    live = subscriptions.filter(F.col("expires_at_ms").isNull() | (F.col("expires_at_ms") >= now_ms))
    top = F.max("tier").over(Window.partitionBy("user_id"))  # PAID sorts after FREE
    allowed = F.col("max_searches") + F.col("rollover_searches")
    rows = live.withColumn("top", top).filter("tier = top")
    return rows.groupBy("user_id", F.col("top").alias("tier")).agg(F.sum("used_searches").alias("used"), F.sum(allowed).alias("available"), F.sum(F.greatest(F.lit(0), allowed - F.col("used_searches"))).alias("remaining"))


def dominant(df: DataFrame, key: str, value: str, least_rows: int = 3, least_hits: int = 2, least_share: float = 0.5) -> DataFrame:
    """The most frequent value of each key (ties: the smaller), where it is frequent enough."""
    counts = df.groupBy(key, value).agg(F.count("*").alias("n"))
    best = counts.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("b"), F.sum("n").alias("total"))
    return best.select(key, F.col("b.v").alias(value), (-F.col("b.m")).alias("n"), "total").filter((F.col("total") >= least_rows) & (F.col("n") >= least_hits) & (F.col("n") >= least_share * F.col("total"))).drop("total")


def size_statistics(df: DataFrame, key: str, size: str) -> DataFrame:
    """Upper median and consistency 1 / (1 + variance / max(1, mean^2)). The median is found on counts of
    sizes, so no key's rows are collected."""
    counts = df.groupBy(key, size).agg(F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy(size).rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumns({"upto": F.sum("n").over(w), "total": F.sum("n").over(Window.partitionBy(key))})
    median = placed.filter(F.col("upto") > F.floor(F.col("total") / 2)).groupBy(key).agg(F.min(size).alias("upper_median"))
    spread = df.groupBy(key).agg(F.round(1 / (1 + F.var_pop(size) / F.greatest(F.lit(1.0), F.avg(size) * F.avg(size))), 9).alias("consistency"))
    return median.join(spread, key)
