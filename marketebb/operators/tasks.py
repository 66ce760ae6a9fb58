"""Health of the collecting jobs: task events, block streaks, rates and latencies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketebb.functions import text, times
from marketebb.operators import slices
from marketebb.session import stage

MAX_RETRIES = 3
BLOCK_STREAK = 3
STREAK_TTL_S = 600
# Upper bounds of the duration histogram in seconds.
DURATION_BOUNDS = (0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0)


def latest_events(events: DataFrame) -> DataFrame:
    """Latest event of each task, with its first push and latest start."""
    return (
        events.groupBy("task_id")
        .agg(
            F.max_by(F.struct("ip_id", "event", "ts", "retry_count"), F.struct("ts", "seq")).alias("e"),
            F.min(F.when(F.col("event") == "pushed", F.col("ts"))).alias("created_at"),
            F.max(F.when(F.col("event") == "started", F.col("ts"))).alias("started_at"),
        )
        .select("task_id", "e.*", "created_at", "started_at")
    )


def queue_depths(events: DataFrame) -> DataFrame:
    """Tasks per state, the state being that of a task's latest event."""
    state = (
        F.when(F.col("event") == "pushed", "waiting")
        .when(F.col("event") == "started", "processing")
        .when(F.col("event") == "acked", "processed")
        .otherwise("dead")
    )
    return latest_events(events).groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("tasks"))


def queue_stats(events: DataFrame, now) -> DataFrame:
    """One row: tasks waiting, processing and dead, entities with an open task, remembered ids."""
    count = F.count(F.lit(1))
    ends = events.filter(F.col("event").isin("pushed", "acked", "dead"))
    marks = ends.groupBy("ip_id").agg(F.max_by("event", F.struct("ts", "seq")).alias("last"))
    remembered = processed_within(events.filter(F.col("event") == "acked"), now)
    latest = latest_events(events)
    return latest.agg(
        F.count_if(F.col("event") == "pushed").alias("waiting"),
        F.count_if(F.col("event") == "started").alias("processing"),
        F.count_if(F.col("event") == "dead").alias("dead"),
    ).select(
        "*",
        marks.filter(F.col("last") == "pushed").agg(count).scalar().alias("pending_entities"),
        remembered.select("task_id").distinct().agg(count).scalar().alias("processed_ids"),
    )


def stuck_tasks(events: DataFrame, now, timeout_s: int = 1800, max_retries: int = MAX_RETRIES) -> DataFrame:
    """Started tasks without an end for longer than the timeout: try again, or give up."""
    latest = latest_events(events).filter(F.col("event") == "started")
    began = F.coalesce("started_at", "created_at")
    age = (times.micros(times.ntz(now)) - times.micros(began)) / times.US_PER_SECOND
    retry = (F.col("retry_count") + 1).cast("int")
    return (
        latest.filter(F.floor(age) > timeout_s)
        .withColumn("new_retry", retry)
        .select(
            "task_id",
            "ip_id",
            F.col("new_retry").alias("retry_count"),
            F.when(F.col("new_retry") > max_retries, "dead").otherwise("retry").alias("outcome"),
        )
    )


def accepted_pushes(events: DataFrame) -> DataFrame:
    """Pushes with the verdict of the one-open-task rule.

    An entity's mark is set by an accepted push and cleared when a task ends. Dropped pushes change
    nothing, so a push is accepted exactly when the entity's previous push or end was an end, or
    there is none.
    """
    relevant = events.filter(F.col("event").isin("pushed", "acked", "dead")).withColumn(
        "slice", F.col("ts").cast("date")
    )
    chained = slices.previous(relevant, ["ip_id"], "slice", ["ts", "seq"], {"before": "event"})
    return chained.filter(F.col("event") == "pushed").select(
        "task_id",
        "ip_id",
        "ts",
        "seq",
        (F.col("before").isNull() | (F.col("before") != "pushed")).alias("accepted"),
    )


def first_of_each_task(events: DataFrame) -> DataFrame:
    """First queued entry of each task_id; copies are combined before the shuffle."""
    fields = [c for c in events.columns if c != "task_id"]
    first = F.min_by(F.struct(*fields), F.struct("ts", "seq"))
    return (
        events.groupBy("task_id")
        .agg(first.alias("e"), (F.count(F.lit(1)) - 1).alias("dropped"))
        .select("task_id", "e.*", "dropped")
    )


def unprocessed(messages: DataFrame, processed: DataFrame) -> DataFrame:
    """Messages whose task_id has not been processed yet."""
    return messages.join(processed.select("task_id"), "task_id", "left_anti")


def processed_within(processed: DataFrame, now, hours: int = 24) -> DataFrame:
    """Processed ids still remembered at ``now`` (each id on its own clock)."""
    limit = times.ntz(now) - F.make_dt_interval(hours=F.lit(hours))
    return processed.filter(F.col("ts") > limit)


def block_streaks(
    log: DataFrame, threshold: int = BLOCK_STREAK, ttl_s: int = STREAK_TTL_S, scope: str = "node", before: DataFrame | None = None
) -> DataFrame:
    """Blocked runs per node with the count of blocks since the last success; with scope "all" one count over all nodes.

    A pause longer than ``ttl_s`` between runs also restarts the count. ``cooldown`` marks the block
    that reaches the threshold. Inside an hour of a node the count is the number of blocks so far minus
    that number at the last restart; what an hour inherits comes from one summary row per node and hour. ``before`` (node,
    streak, ts) is what nodes had counted before these rows; it takes part as an hour ahead of theirs.
    """
    if scope == "all":
        log = log.withColumn("node", F.lit("all"))
    elif scope != "node":
        raise ValueError(f"unknown scope {scope!r}")
    ok = F.col("outcome").isin("success", "empty_result")
    blocked = F.col("outcome") == "403_forbidden"
    ttl_us = ttl_s * times.US_PER_SECOND
    us = F.col("us")
    # Both users of these rows need exactly these columns, so one shuffle serves both.
    rows = log.filter(ok | blocked).select(
        "node",
        "task_id",
        blocked.cast("long").alias("block"),
        times.micros(F.col("ts")).alias("us"),
        times.hour_floor(F.col("ts")).alias("slice"),
    ).filter("node IS NOT NULL AND slice IS NOT NULL")
    in_order = Window.partitionBy("node", "slice").orderBy("us", "task_id")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
    restart = (F.col("block") == 0) | (us - F.col("before") > ttl_us)
    marked = (
        rows.withColumn("before", F.lag("us").over(in_order))
        .withColumn("blocks", F.sum("block").over(so_far))
        .withColumn("base", F.max(F.when(restart, F.col("blocks") - F.col("block"))).over(so_far))
    )

    hours = marked.groupBy("node", "slice").agg(
        F.sum("block").alias("n"), F.max("base").alias("base"), F.min("us").alias("first"), F.max("us").alias("last")
    )
    if before is not None:
        at = times.micros(F.col("ts"))
        hours = hours.unionByName(
            before.select(
                "node", (times.plus_seconds(times.hour_floor(F.col("ts")), F.lit(-3600))).alias("slice"), F.col("streak").alias("n"), F.lit(0).cast("long").alias("base"), at.alias("first"), at.alias("last")
            )
        )
    over_hours = Window.partitionBy("node").orderBy("slice")
    past = over_hours.rowsBetween(Window.unboundedPreceding, 0)
    pause = F.col("last_before").isNull() | (F.col("first") - F.col("last_before") > ttl_us)
    reset = F.when(F.col("base").isNotNull(), F.col("upto") - F.col("n") + F.col("base")).when(
        F.col("pause"), F.col("upto") - F.col("n")
    )
    inherited = (
        hours.withColumn("last_before", F.lag("last").over(over_hours))
        .withColumn("pause", pause)
        .withColumn("upto", F.sum("n").over(past))
        .withColumn("open", F.col("upto") - F.max(reset).over(past))
        .select(
            "node", "slice", F.when(F.col("pause"), 0).otherwise(F.lag("open").over(over_hours)).alias("inherited")
        )
    )
    streak = F.col("blocks") - F.coalesce("base", -F.col("inherited"))
    return (
        marked.join(inherited, ["node", "slice"])
        .filter(F.col("block") == 1)
        .select(
            "node",
            "task_id",
            times.from_micros(us).alias("ts"),
            streak.alias("streak"),
            (streak == threshold).alias("cooldown"),
        )
    )


def run_counters(log: DataFrame) -> DataFrame:
    """Processed, failed, skipped, mean duration and success rate (1 when nothing ran)."""
    done = F.count_if(F.col("outcome") == "success")
    failed = F.count_if(F.col("outcome").isin("403_forbidden", "error"))
    return log.agg(
        done.alias("processed"),
        failed.alias("failed"),
        F.count_if(F.col("outcome") == "empty_result").alias("skipped"),
        F.coalesce(F.avg(F.when(F.col("outcome") == "success", F.col("duration_s"))), F.lit(0.0)).alias(
            "avg_duration_s"
        ),
        F.coalesce(F.try_divide(done, done + failed), F.lit(1.0)).alias("success_rate"),
    )


def outcome_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("outcome", "mode").agg(F.count(F.lit(1)).alias("runs"))


def outcome_by_error(log: DataFrame) -> DataFrame:
    """Runs by outcome, mode and error type, from (mode, error_text, items); runs without an error have no type."""
    error = F.when(F.col("error_text").isNotNull(), text.error_class(F.col("low")))
    typed = log.withColumn("low", F.lower("error_text")).withColumn("error_type", error)
    outcome = text.run_outcome(F.col("error_type"), F.col("items")).alias("outcome")
    return typed.groupBy(outcome, "mode", "error_type").agg(F.count(F.lit(1)).alias("runs"))


def duration_histogram(log: DataFrame, bounds: Sequence[float] = DURATION_BOUNDS) -> DataFrame:
    """Runs per duration bucket; ``le`` is the inclusive upper bound, NULL for the open last one."""
    le = F.when(F.col("duration_s") <= bounds[0], F.lit(bounds[0]))
    for bound in bounds[1:]:
        le = le.when(F.col("duration_s") <= bound, F.lit(bound))
    return log.groupBy(le.alias("le")).agg(F.count(F.lit(1)).alias("runs"))


def _bucket_counts(bounds: Sequence[float]) -> Column:
    upto = [F.count_if(F.col("duration_s") <= b) for b in bounds]
    return F.array(*upto, F.count(F.lit(1)))


def _quantile(counts: Column, bounds: Sequence[float], q: float) -> Column:
    """Linear interpolation inside the histogram bucket that holds the rank."""
    total = F.element_at(counts, -1)
    rank = total * F.lit(q)
    at = F.array_position(F.transform(counts, lambda c: c >= rank), F.lit(True)).cast("int")
    uppers = F.array(*[F.lit(float(b)) for b in bounds])
    upper = F.get(uppers, at - 1)
    lower = F.coalesce(F.get(uppers, at - 2), F.lit(0.0))
    below = F.coalesce(F.get(counts, at - 2), F.lit(0))
    inside = F.get(counts, at - 1) - below
    return F.when(at > len(bounds), F.lit(float(bounds[-1]))).otherwise(
        lower + (upper - lower) * (rank - below) / inside
    )


def _quantile_of(upto: Sequence[Column], total: Column, bounds: Sequence[float], q: float) -> Column:
    """The same from a column for each bound, for rows that are many; NULL without runs."""
    rank, lower, below, out = total * F.lit(q), 0.0, F.lit(0), None
    for bound, count in zip(bounds, upto, strict=True):
        value = F.lit(lower) + F.lit(bound - lower) * F.try_divide(rank - below, count - below)
        out = F.when(count >= rank, value) if out is None else out.when(count >= rank, value)
        lower, below = bound, count
    return F.when(total > 0, out.otherwise(F.lit(float(bounds[-1]))))


def latency_quantiles(
    log: DataFrame,
    minutes: int = 5,
    quantiles: Sequence[float] = (0.5, 0.95, 0.99),
    bounds: Sequence[float] = DURATION_BOUNDS,
) -> DataFrame:
    """Latency quantiles per window, interpolated in bucket counts, which merge freely."""
    per_window = log.groupBy(times.minutes_floor(F.col("ts"), minutes).alias("window_start")).agg(
        _bucket_counts(bounds).alias("counts")
    )
    return per_window.select(
        "window_start",
        F.element_at("counts", -1).alias("runs"),
        *[_quantile(F.col("counts"), bounds, q).alias(f"p{round(q * 100)}") for q in quantiles],
    )


def latency_sketch(log: DataFrame, minutes: int = 5, quantiles: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """The same from a quantile sketch of the durations themselves."""
    return log.groupBy(times.minutes_floor(F.col("ts"), minutes).alias("window_start")).agg(
        F.percentile_approx("duration_s", list(quantiles), 10_000).alias("quantiles")
    )


def rates(events: DataFrame, minutes: int = 5) -> DataFrame:
    """Pushed, processed and dead per minute over a sliding window that moves by one minute.

    Events are counted per minute first; only those counts are repeated for overlapping windows.
    """
    kinds = {"pushed": "pushed", "acked": "processed", "dead": "failed"}
    per_minute = events.groupBy(times.minutes_floor(F.col("ts"), 1).alias("minute")).agg(
        *[F.count_if(F.col("event") == e).alias(n) for e, n in kinds.items()]
    )
    spread = per_minute.withColumn("back", F.explode(F.sequence(F.lit(0), F.lit(minutes - 1))))
    start = times.plus_seconds(F.col("minute"), F.col("back") * -60)
    return spread.groupBy(start.alias("window_start")).agg(
        *[(F.sum(n) / minutes).alias(f"{n}_per_min") for n in kinds.values()]
    )


def operation_alerts(
    events: DataFrame,
    log: DataFrame,
    backlog: int = 100,
    blocked: int = 5,
    p95_s: float = 60.0,
    minutes: int = 5,
    latency_hold: int = 5,
) -> DataFrame:
    """Operation rules as (rule, severity, since, until, value).

    Backlog (pushes minus starts) above a limit for five minutes, dead tasks standing for a minute,
    more than five blocks in a window of ``minutes`` that slides by the minute, the 95th latency percentile of such a
    window above a limit for ``latency_hold`` minutes. Windowed rules give one row for each run of minutes above.
    """
    minute = times.minutes_floor(F.col("ts"), 1).alias("minute")
    count = F.count(F.lit(1))
    step = F.when(F.col("event") == "pushed", 1).when(F.col("event") == "started", -1).otherwise(0).cast("long")
    standing = events.groupBy(minute).agg(F.sum(step).alias("depth"), F.count_if(F.col("event") == "dead").alias("dead"), F.lit(True).alias("task"))
    upto = {f"upto_{i}": F.count_if(F.col("duration_s") <= b) for i, b in enumerate(DURATION_BOUNDS)}
    windowed = {"blocks": F.count_if(F.col("outcome") == "403_forbidden"), **upto, "runs": count}
    inside = window_steps(log.groupBy(minute).agg(*[c.alias(n) for n, c in windowed.items()]), minutes)
    sums = ["depth", "dead", *windowed]
    steps = standing.unionByName(inside, allowMissingColumns=True).groupBy("minute").agg(*[F.sum(F.coalesce(n, F.lit(0))).alias(f"step_{n}") for n in sums], F.bool_or("task").alias("task"))
    points = _over_time(steps, "q", F.lit("all"), {n: F.col(f"step_{n}") for n in sums}, "alert-steps")

    points = points.withColumn("p95", _quantile_of([F.col(n) for n in upto], F.col("runs"), DURATION_BOUNDS, 0.95))
    rules = (
        ("queue_backlog", "warning", F.col("depth"), backlog, 5, True),
        ("dead_letters", "critical", F.col("dead"), 0, 1, True),
        ("collector_blocked", "critical", F.col("blocks"), blocked, 0, False),
        ("high_latency", "warning", F.col("p95"), p95_s, latency_hold, False),
    )
    judged = [
        F.when(
            F.coalesce("task", F.lit(False)) if of_tasks else F.lit(True),
            F.struct(
                F.lit(name).alias("rule"), F.lit(severity).alias("severity"), value.cast("double").alias("value"), F.coalesce(value > limit, F.lit(False)).alias("above"),
                F.lit(hold * 60 * times.US_PER_SECOND).alias("hold"), F.lit(of_tasks).alias("of_tasks"),
            ),
        )
        for name, severity, value, limit, hold, of_tasks in rules
    ]
    return _episodes(points.select("minute", F.explode(F.array_compact(F.array(*judged))).alias("r")).select("minute", "r.*"))


def window_steps(per_minute: DataFrame, minutes: int) -> DataFrame:
    """What enters and leaves the window of so many minutes that ends with each minute.

    A minute's counts enter the window when it comes and leave it ``minutes`` later, so a running sum over the result gives
    every window; the cost follows the minutes that have rows, not the width of the window.
    """
    names = [c for c in per_minute.columns if c != "minute"]
    later = times.plus_seconds(F.col("minute"), F.lit(minutes * 60)).alias("minute")
    return per_minute.unionByName(per_minute.select(later, *[(-F.col(n)).alias(n) for n in names]))


def _over_time(rows: DataFrame, key: str, value: Column, sums: dict[str, Column], label: str) -> DataFrame:
    """Running sums by minute, over rows that are first written once."""
    rows = stage(rows.withColumn(key, value).withColumn("slice", F.col("minute").cast("date")), label)
    return slices.running(rows, [key], "slice", ["minute"], {n: ("sum", c) for n, c in sums.items()})


def _episodes(points: DataFrame) -> DataFrame:
    """Runs of minutes above a limit that last at least ``hold``.

    Points above share the number of points not above so far; the point that ends them has the next number. A value that is known
    at task events alone holds until the last of them; that of a window until the minute before it changes.
    """
    rows = _over_time(points, "rule", F.col("rule"), {"run": (~F.col("above")).cast("long")}, "alert-points")
    above = F.when(F.col("above"), F.col("minute"))
    ended = times.plus_seconds(F.min(F.when(~F.col("above"), F.col("minute"))), F.lit(-60))
    runs = (
        rows.groupBy("rule", "severity", "hold", "of_tasks", F.when(F.col("above"), F.col("run")).otherwise(F.col("run") - 1).alias("run"))
        .agg(F.min(above).alias("since"), F.max(above).alias("last"), ended.alias("ended"), F.max(F.when(F.col("above"), F.col("value"))).alias("value"))
        .filter(F.col("since").isNotNull())
        .withColumn("until", F.when(F.col("of_tasks"), F.col("last")).otherwise(F.col("ended")))
    )
    return runs.filter(times.micros(F.col("until")) - times.micros(F.col("since")) >= F.col("hold")).select("rule", "severity", "since", "until", "value")
