"""Service-level numbers over the ledger and the records."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.windows import timestamp

# Fixed values.
DURATION_EDGES = (0.1, 0.5, 1.0, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0, 600.0, 1200.0, 3600.0)
SUCCESS_DAYS = 28
LATENCY_DAYS = 7
FAILED_SHARE = 2 / 7
SKETCH_K = 4096
OVERDUE = timedelta(hours=26)
# name -> (factor, long window in minutes, short window in minutes)
BURN_WINDOWS = {"fast": (14.4, 60, 5), "slow": (6.0, 360, 30)}


def duration_histogram(df: DataFrame, value: str = "value", edges=DURATION_EDGES, by=()) -> DataFrame:
    """Cumulative histogram: count of values up to each edge, in one pass.
    The last edge is infinite."""
    all_edges = [*edges, float("inf")]
    counts = F.array(*[F.count_if(F.col(value) <= e) for e in all_edges])
    row = df.groupBy(*by).agg(counts.alias("counts"), F.sum(value).alias("sum"))
    le = F.array(*[F.lit(str(e) if e != float("inf") else "+Inf") for e in all_edges])
    return row.select(
        *by, F.posexplode(F.arrays_zip(le.alias("le"), F.col("counts").alias("n"))).alias("edge_no", "e")
    ).select(*by, "edge_no", F.col("e.le").alias("le"), F.col("e.n").alias("cumulative"))


def histogram_quantile(hist: DataFrame, q: float, edges=DURATION_EDGES, by=()) -> DataFrame:
    """Quantile by linear interpolation inside its bucket; values beyond the
    last finite edge count as that edge. Groups without values give no row."""
    upper = F.element_at(F.array(*[F.lit(e) for e in edges]), F.least(F.col("edge_no") + 1, F.lit(len(edges))))
    steps = Window.partitionBy(*by).orderBy("edge_no")
    target = q * F.max("cumulative").over(Window.partitionBy(*by))
    bounded = hist.select(
        *by, "edge_no", "cumulative", upper.alias("upper"), target.alias("target"),
        F.coalesce(F.lag("cumulative").over(steps), F.lit(0)).alias("previous"),
    ).withColumn("lower", F.coalesce(F.lag("upper").over(steps), F.lit(0.0)))
    inside = (F.col("target") - F.col("previous")) / (F.col("cumulative") - F.col("previous"))
    return bounded.filter(
        (F.col("target") > F.col("previous")) & (F.col("target") <= F.col("cumulative"))
    ).select(*by, (F.col("lower") + (F.col("upper") - F.col("lower")) * inside).alias("quantile"))


def host_records(host_totals: DataFrame) -> DataFrame:
    """Records per host and alert level; rows of zero are absent."""
    return host_totals.select(
        "host", F.explode(F.array(
            F.struct(F.lit("error").alias("level"), F.col("error").alias("records")),
            F.struct(F.lit("critical").alias("level"), F.col("critical").alias("records")),
        )).alias("m")
    ).select("host", "m.level", "m.records").filter(F.col("records") > 0)


def host_incidents(incidents: DataFrame) -> DataFrame:
    return incidents.groupBy("host").agg(F.count("*").alias("incidents"))


def delivery_state(runs: DataFrame, now: datetime, overdue: timedelta = OVERDUE) -> DataFrame:
    """Last delivery and whether the next one is overdue."""
    last = F.max(F.when(F.col("status") == "done", F.col("completed_at")))
    return runs.agg(last.alias("last_success")).withColumn(
        "is_overdue", F.coalesce(F.col("last_success") < timestamp(now - overdue), F.lit(True))
    )


def _days(t: Column) -> Column:
    return F.unix_date(t.cast("date"))


def _rolling(days: int) -> Window:
    # one row per day: the whole history of a ledger is a small table
    return Window.orderBy("_day").rangeBetween(1 - days, 0)


def _by_day(cycles: DataFrame, *aggs: Column) -> DataFrame:
    day = F.date_trunc("day", "at").cast("timestamp_ntz")
    return cycles.groupBy(day.alias("day")).agg(*aggs).withColumn("_day", _days(F.col("day")))


def success_rate(cycles: DataFrame, days: int = SUCCESS_DAYS) -> DataFrame:
    """Share of delivered cycles over the last ``days``, for every day; a
    delivery with a source missing is a success."""
    ok = F.count_if(F.col("outcome").isin("ok", "partial"))
    daily = _by_day(cycles, F.count("*").alias("n"), ok.alias("ok"))
    w = _rolling(days)
    return daily.select(
        "day", F.sum("ok").over(w).alias("succeeded"), F.sum("n").over(w).alias("cycles")
    ).withColumn("rate", F.col("succeeded") / F.col("cycles"))


def failed_share(cycles: DataFrame, days: int = LATENCY_DAYS, limit: float = FAILED_SHARE) -> DataFrame:
    """Share of failed and partial cycles over the last ``days`` and whether
    it is too high."""
    bad = F.count_if(F.col("outcome").isin("failed", "partial"))
    daily = _by_day(cycles, F.count("*").alias("n"), bad.alias("bad"))
    w = _rolling(days)
    return (
        daily.select("day", F.sum("bad").over(w).alias("failed"), F.sum("n").over(w).alias("cycles"))
        .withColumn("share", F.col("failed") / F.col("cycles"))
        .withColumn("is_alert", F.col("share") > limit)
    )


def latency_quantile(runs: DataFrame, q: float = 0.95, days: int = LATENCY_DAYS) -> DataFrame:
    """Quantile of the duration of delivered runs over the last ``days``, from
    the daily histograms: counts add up, so no durations are collected."""
    timed = runs.filter(F.col("status") == "done").select(
        F.date_trunc("day", "window_from").cast("timestamp_ntz").alias("day"),
        (F.unix_micros(F.col("completed_at").cast("timestamp"))
         - F.unix_micros(F.col("created_at").cast("timestamp"))).alias("us"),
    ).withColumn("seconds", F.col("us") / 1000000.0)
    hist = duration_histogram(timed, "seconds", by=("day",))
    w = Window.partitionBy("edge_no").orderBy("_day").rangeBetween(1 - days, 0)
    rolled = hist.withColumn("_day", _days(F.col("day"))).select(
        "day", "edge_no", F.sum("cumulative").over(w).alias("cumulative")
    )
    return histogram_quantile(rolled, q, by=("day",))


def latency_sketches(cycles: DataFrame, value: str = "seconds", at: str = "at") -> DataFrame:
    """(day, latency): a KLL sketch of the durations of each day, to be stored.
    Up to SKETCH_K durations it holds all of them; above that the rank of a
    quantile is wrong by 2.3 / SKETCH_K ** 0.9 at most in 99 of 100 cases."""
    day = F.date_trunc("day", at).cast("timestamp_ntz")
    return cycles.groupBy(day.alias("day")).agg(F.kll_sketch_agg_double(F.col(value), F.lit(SKETCH_K)).alias("latency"))


def sketched_quantile(sketches: DataFrame, q: float = 0.95, days: int = LATENCY_DAYS) -> DataFrame:
    """Quantile of the durations of the last ``days``, for every stored day,
    by merging the daily sketches; no durations are read."""
    reach = F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("ahead")
    part = sketches.select("latency", F.col("day").alias("of"), reach).select(
        "latency", (F.col("of") + F.make_dt_interval(days=F.col("ahead"))).alias("day")
    )
    merged = part.join(sketches.select("day"), "day", "left_semi").groupBy("day").agg(
        F.kll_merge_agg_double("latency", SKETCH_K).alias("latency")
    )
    return merged.select(
        "day", F.kll_sketch_get_n_double("latency").alias("cycles"),
        F.kll_sketch_get_quantile_double("latency", F.lit(q)).alias("quantile"),
    )


def burn_rate(logs: DataFrame, slo: float = 0.99, windows=None) -> DataFrame:
    """Error-budget burn per host and minute: an alert needs the error share
    of both the long and the short window above (1 - slo) * factor.

    Records are first counted per host and minute; the sliding sums run on
    that table.
    """
    windows = windows or BURN_WINDOWS
    minute = F.date_trunc("minute", "event_time").cast("timestamp_ntz")
    minutes = logs.groupBy("host", minute.alias("minute")).agg(
        F.count("*").alias("n"), F.count_if(F.col("level") == "error").alias("bad")
    ).withColumn("_m", F.floor(F.unix_seconds(F.col("minute").cast("timestamp")) / 60))

    def share(length: int) -> Column:
        w = Window.partitionBy("host").orderBy("_m").rangeBetween(1 - length, 0)
        return F.sum("bad").over(w) / F.sum("n").over(w)

    shares = minutes.select("host", "minute", *[
        share(length).alias(f"{name}_{part}")
        for name, (_, long, short) in windows.items() for part, length in (("long", long), ("short", short))
    ])
    return shares.withColumns({
        f"{name}_alert": (F.col(f"{name}_long") > (1 - slo) * factor) & (F.col(f"{name}_short") > (1 - slo) * factor)
        for name, (factor, _, _) in windows.items()
    })
