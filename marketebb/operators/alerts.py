"""Alert rules on each crawl, and the alert list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketebb.functions import times

HIGH_OUTFLOW = 50
LOW_LIQUIDITY = 0.3
HIGH_LIQUIDITY = 2.0

# Message formats.
HIGH_OUTFLOW_TEXT = "出货量达到 %d，超过阈值 %d"
LOW_LIQUIDITY_TEXT = "流动性指数 %.4f，低于阈值 %.4f"
SURGE_TEXT = "流动性指数 %.4f，超过阈值 %.4f (供不应求)"


def alerts(
    flow: DataFrame,
    high_outflow: int = HIGH_OUTFLOW,
    low_liquidity: float = LOW_LIQUIDITY,
    high_liquidity: float = HIGH_LIQUIDITY,
) -> DataFrame:
    """Alerts of each crawl (not of the hour's total). A threshold of 0 switches its rule off.

    Liquidity counts only when something came in and something went out.
    """
    out = F.col("outflow")
    liq = F.when((F.col("inflow") > 0) & (out > 0), out.cast("double") / F.col("inflow"))

    def alert(kind, severity, text, metric, threshold, cast):
        return F.struct(
            F.lit(kind).alias("alert_type"),
            F.lit(severity).alias("severity"),
            F.format_string(text, metric.cast(cast), F.lit(threshold).cast(cast)).alias("message"),
            metric.cast("double").alias("metric_value"),
            F.lit(float(threshold)).alias("threshold_value"),
        )

    rules = []
    if high_outflow > 0:
        rules.append(
            F.when(out >= high_outflow, alert("high_outflow", "warning", HIGH_OUTFLOW_TEXT, out, high_outflow, "long"))
        )
    if low_liquidity > 0:
        rules.append(
            F.when(liq < low_liquidity, alert("low_liquidity", "info", LOW_LIQUIDITY_TEXT, liq, low_liquidity, "double"))
        )
    if high_liquidity > 0:
        rules.append(
            F.when(liq > high_liquidity, alert("surge", "critical", SURGE_TEXT, liq, high_liquidity, "double"))
        )
    return flow.select(
        "ip_id",
        times.hour_floor(F.col("crawl_ts")).alias("hour_bucket"),
        F.col("crawl_ts").alias("created_at"),
        F.explode(F.array_compact(F.array(*rules))).alias("a"),
    ).select(
        "ip_id",
        "a.*",
        "hour_bucket",
        F.lit(False).alias("acknowledged"),
        F.lit(None).cast("timestamp_ntz").alias("acknowledged_at"),
        "created_at",
    )


def alert_list(
    rows: DataFrame, ip_id: int | None = None, severity: str | None = None, acknowledged: bool | None = False
) -> DataFrame:
    """Filtered alerts; only open ones unless told otherwise."""
    if ip_id is not None:
        rows = rows.filter(F.col("ip_id") == ip_id)
    if severity:
        rows = rows.filter(F.col("severity") == severity)
    if acknowledged is not None:
        rows = rows.filter(F.col("acknowledged") == acknowledged)
    return rows


def with_entity_name(rows: DataFrame, metadata: DataFrame) -> DataFrame:
    names = metadata.select(F.col("id").alias("ip_id"), F.col("name").alias("ip_name"))
    return rows.join(names, "ip_id", "left").fillna("", ["ip_name"])


def recent(rows: DataFrame, metadata: DataFrame, limit: int = 10) -> DataFrame:
    """Newest alerts with entity name and a message cut to 50 characters for display."""
    newest = rows.orderBy(F.desc("created_at"), "ip_id", "alert_type").limit(limit)
    return with_entity_name(newest, metadata).select(
        "ip_id", "ip_name", "alert_type", "severity", F.left("message", F.lit(50)).alias("message"), "acknowledged", "created_at"
    )


def acknowledge(rows: DataFrame, keys: DataFrame, at) -> DataFrame:
    """Acknowledge the alerts named in ``keys``; ``outcome`` reports what happened to each.

    An alert is acknowledged once: the time of an earlier acknowledgement stays.
    """
    on = keys.columns
    hit = keys.distinct().withColumn("__hit", F.lit(True))
    joined = rows.join(hit, on, "left")
    fresh = F.col("__hit") & ~F.col("acknowledged")
    return (
        joined.withColumn(
            "outcome",
            F.when(fresh, "acknowledged").when(F.col("__hit"), "already acknowledged").otherwise("untouched"),
        )
        .withColumn("acknowledged_at", F.when(fresh, times.ntz(at)).otherwise(F.col("acknowledged_at")))
        .withColumn("acknowledged", F.col("acknowledged") | F.coalesce("__hit", F.lit(False)))
        .select(*rows.columns, "outcome")
    )
