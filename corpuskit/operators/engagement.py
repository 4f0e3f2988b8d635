"""Measures of use: sessions, retention, conversion, service levels, periods, variants and ratings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.operators.sample import key_hash
from corpuskit.operators.selection import exact_percentiles


def session_engagement(
    events: DataFrame, user: str = "user_id", ts: str = "ts", gap: str = "30 minutes", target_seconds: int = 20 * 60
) -> DataFrame:
    """One row: sessions, their whole and mean length, and how many last as long as the target.

    A session ends where more than ``gap`` passes without an event; it is as long as from its first to its last event.
    """
    sessions = events.groupBy(user, F.session_window(ts, gap)).agg(
        (F.unix_micros(F.max(F.col(ts).cast("timestamp"))) - F.unix_micros(F.min(F.col(ts).cast("timestamp")))).alias("micros"))
    return sessions.agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("micros").alias("total_micros"),
        (F.try_divide(F.sum("micros"), F.count(F.lit(1))) / 1e6).alias("mean_seconds"),
        F.count_if(F.col("micros") >= target_seconds * 1_000_000).alias("target_sessions"))


def retention(events: DataFrame, user: str = "user_id", ts: str = "ts", period: str = "month", target: float = 0.6) -> DataFrame:
    """Per period: active users, those active in the next one too, their share, and whether it meets the target.

    The last period has no next one and is left out.
    """
    active = events.where(F.col(user).isNotNull()).select(
        F.col(user).alias("user"), F.date_trunc(period, ts).cast("date").alias("period")).distinct()
    back = {"month": F.add_months("period", -1), "week": F.date_sub("period", 7), "day": F.date_sub("period", 1)}[period]
    again = active.select("user", back.alias("period"), F.lit(1).alias("again"))
    last = active.agg(F.max("period")).scalar()  # one value
    share = F.sum("again") / F.count(F.lit(1))
    return (
        active.where(F.col("period") < last).join(again, ["user", "period"], "left")
        .groupBy("period").agg(
            F.count(F.lit(1)).alias("active"), F.count("again").alias("retained"),
            F.coalesce(share, F.lit(0.0)).alias("retention"), F.coalesce(share >= target, F.lit(False)).alias("met"))
    )


def conversion(
    events: DataFrame, user: str = "user_id", ts: str = "ts", kind: str = "event_type",
    start: str = "signup", goal: str = "purchase", target: float = 0.05,
) -> DataFrame:
    """One row: users who started, those who reached the goal at or after their start, the share, and whether it meets the target."""
    first = lambda what: F.min(F.when(F.col(kind) == what, F.col(ts)))
    last = F.max(F.when(F.col(kind) == goal, F.col(ts)))
    users = events.where(F.col(user).isNotNull()).groupBy(user).agg(first(start).alias("began"), last.alias("reached"))
    share = F.try_divide(F.count_if(F.col("reached") >= F.col("began")), F.count("began"))
    return users.agg(
        F.count("began").alias("started"), F.count_if(F.col("reached") >= F.col("began")).alias("converted"),
        share.alias("share"), (share >= target).alias("met"))


def response_and_uptime(
    log: DataFrame, latency_ms: str = "latency_ms", status: str = "status", most_ms: float = 3000.0, target: float = 0.995
) -> DataFrame:
    """One row: requests, median and 95th percentile of the response time, requests within ``most_ms``, availability.

    A request is served unless its status is missing or a server error.
    """
    served = F.count_if(F.coalesce(F.col(status) < 500, F.lit(False)))
    # Response times hardly repeat, so their quantiles are selected by passes that count, not sorted or gathered.
    p50, p95 = exact_percentiles(log, F.col(latency_ms), [0.5, 0.95])
    n, availability = F.count(F.lit(1)), F.try_divide(served, F.count(F.lit(1)))
    return log.agg(
        n.alias("requests"), F.lit(p50).cast("double").alias("p50_ms"), F.lit(p95).cast("double").alias("p95_ms"),
        F.count_if(F.col(latency_ms) <= most_ms).alias("fast"), availability.alias("availability"), (availability >= target).alias("met"))


def period_over_period(df: DataFrame, at: str, amount: str) -> DataFrame:
    """Per month: rows, amount, and the change of each against the month before in percent; null without one."""
    months = df.where(F.col(at).isNotNull()).groupBy(F.date_trunc("month", at).cast("date").alias("month")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col(amount).cast("decimal(18,2)")).alias("amount"))
    before = months.select(F.add_months("month", 1).alias("month"), F.col("rows").alias("rows0"), F.col("amount").alias("amount0"))
    change = lambda now, then: (100 * (now.cast("double") - then) / F.nullif(then.cast("double"), F.lit(0.0)))
    return months.join(before, "month", "left").select(
        "month", "rows", F.col("amount").cast("double").alias("amount"),
        change(F.col("rows"), F.col("rows0").cast("double")).alias("rows_change"),
        change(F.col("amount"), F.col("amount0").cast("double")).alias("amount_change"))


def day_schedule(df: DataFrame, at: str, day: str, tie: str) -> DataFrame:
    """The rows of one day in order of time; the filter is a range, so that files without the day are skipped."""
    start = F.to_timestamp(F.lit(day))
    return df.where((F.col(at) >= start) & (F.col(at) < start + F.expr("interval 1 day"))).orderBy(at, tie)


def arm_of(user: Column, arms: int = 2, seed: int = 42) -> Column:
    """The variant a user always gets, by hash."""
    return F.pmod(key_hash(user, seed), F.lit(arms)).cast("int")


def compare_arms(events: DataFrame, user: str = "user_id", kind: str = "event_type", goal: str = "purchase", arms: int = 2) -> DataFrame:
    """Per arm: users, events, users that reached the goal and their share."""
    users = events.where(F.col(user).isNotNull()).groupBy(user).agg(
        F.count(F.lit(1)).alias("n"), F.max((F.col(kind) == goal).cast("int")).alias("reached"))
    return users.groupBy(arm_of(F.col(user), arms).alias("arm")).agg(
        F.count(F.lit(1)).alias("users"), F.sum("n").alias("events"), F.sum("reached").cast("bigint").alias("reached"),
        (F.sum("reached") / F.count(F.lit(1))).alias("share"))


def satisfaction(ratings: DataFrame, period: str, rating: str, target: float = 4.5) -> DataFrame:
    """Per period: ratings, their mean, and whether it meets the target. Missing ratings do not count."""
    mean = F.sum(rating) / F.count(rating)
    return ratings.where(F.col(rating).isNotNull()).groupBy(period).agg(
        F.count(rating).alias("ratings"), mean.alias("mean"), (mean >= target).alias("met"))
