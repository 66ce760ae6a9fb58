"""Adaptive weight: busy entities are observed more often, quiet ones less often."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketebb.functions.measures import minutes_to_weight, usable_weight, weight_to_minutes


@dataclass(frozen=True)
class WeightRules:
    """Intervals in minutes; thresholds follow from the page counts."""

    base: int = 120
    low: int = 60
    high: int = 120
    pages_on_sale: int = 5
    pages_sold: int = 5
    fast_step: int = 15
    slow_step: int = 15
    regress_step: int = 5
    busy_per_page: int = 100
    quiet_in_per_page: int = 50
    quiet_out_per_page: int = 3

    @property
    def busy(self) -> tuple[int, int]:
        return self.busy_per_page * self.pages_on_sale, self.busy_per_page * self.pages_sold

    @property
    def quiet(self) -> tuple[int, int]:
        return self.quiet_in_per_page * self.pages_on_sale, self.quiet_out_per_page * self.pages_sold


def activity(rules: WeightRules, first_crawl: Column, inflow: Column, sold: Column) -> Column:
    """What a crawl asks for: 'none' (first crawl), 'active', 'cold' or 'regress'."""
    busy_in, busy_out = rules.busy
    quiet_in, quiet_out = rules.quiet
    return (
        F.when(first_crawl, "none")
        .when((inflow > busy_in) | (sold > busy_out), "active")
        .when((inflow < quiet_in) & (sold < quiet_out), "cold")
        .otherwise("regress")
    )


def step(rules: WeightRules, minutes: Column, asked: Column) -> Column:
    """Interval after one crawl."""
    towards_base = F.when(
        minutes < rules.base, F.least(minutes + rules.regress_step, F.lit(rules.base))
    ).otherwise(F.greatest(minutes - rules.regress_step, F.lit(rules.base)))
    return (
        F.when(asked == "active", F.greatest(minutes - rules.fast_step, F.lit(rules.low)))
        .when(asked == "cold", F.least(minutes + rules.slow_step, F.lit(rules.high)))
        .when(asked == "regress", towards_base)
        .otherwise(minutes)
    )


def adjust_once(crawls: DataFrame, rules: WeightRules = WeightRules()) -> DataFrame:
    """One adjustment per row of (ip_id, weight, inflow, sold, first_crawl)."""
    asked = activity(rules, F.col("first_crawl"), F.col("inflow"), F.col("sold"))
    old = crawls.withColumn("asked", asked).withColumn("old_minutes", weight_to_minutes(F.col("weight"), rules.base))
    new = old.withColumn("new_minutes", step(rules, F.col("old_minutes"), F.col("asked")))
    changed = F.col("new_minutes") != F.col("old_minutes")
    return (
        new.withColumn("adjustment", F.when(changed, F.col("asked")).otherwise("none"))
        .withColumn(
            "new_weight",
            F.when(changed, minutes_to_weight(F.col("new_minutes"), rules.base)).otherwise(
                usable_weight(F.col("weight"))
            ),
        )
        .drop("asked")
    )


def adjust_over_time(flow: DataFrame, entities: DataFrame, rules: WeightRules = WeightRules()) -> DataFrame:
    """Interval and weight of each entity after each crawl, starting from the entity's weight.

    The stored weight stays as it is until an interval changes; from then on it is the weight of the interval.

    A crawl maps whole minutes to whole minutes, and such maps compose. The crawls of an entity and day fold into one table
    (minutes before the day -> minutes after it); the tables of an entity's days are chained, and each day is then run
    through from its own start. No row holds more than a day of crawls, or one small table for each day of an entity.
    """
    asked = activity(rules, F.col("first_crawl"), F.col("inflow"), F.col("sold"))
    crawls = flow.select("ip_id", F.col("crawl_ts").cast("date").alias("day"), F.struct("crawl_ts", asked.alias("asked")).alias("crawl"))
    start = entities.select(
        F.col("id").alias("ip_id"), usable_weight(F.col("weight")).alias("weight"), weight_to_minutes(F.col("weight"), rules.base).alias("minutes")
    )
    days = crawls.groupBy("ip_id", "day").agg(F.sort_array(F.collect_list("crawl")).alias("crawls")).join(start, "ip_id", "left")
    days = days.withColumn("weight", F.coalesce("weight", F.lit(1.0))).withColumn("minutes", F.coalesce("minutes", F.lit(rules.base)))

    def run(crawls: Column, minutes: Column, changed: Column) -> Column:
        """Minutes and whether any crawl has changed them, after these crawls."""
        return F.aggregate(
            crawls,
            F.struct(minutes.cast("int").alias("m"), changed.alias("changed")),
            lambda a, c: F.struct(step(rules, a["m"], c["asked"]).cast("int").alias("m"), (a["changed"] | (step(rules, a["m"], c["asked"]) != a["m"])).alias("changed")),
        )

    # no interval leaves this range
    lowest, highest = F.least("minutes", F.lit(min(rules.low, rules.base))), F.greatest("minutes", F.lit(max(rules.high, rules.base)))
    days = days.withColumn("lowest", lowest).withColumn("reach", F.sequence("lowest", highest))
    tables = days.withColumn("table", F.transform("reach", lambda m: run(F.col("crawls"), m, F.lit(False))))
    chain = tables.groupBy("ip_id").agg(
        F.sort_array(F.collect_list(F.struct("day", "table"))).alias("days"), F.first("minutes").alias("minutes"), F.first("lowest").alias("lowest")
    )
    begin = F.aggregate(
        "days",
        F.struct(F.col("minutes").cast("int").alias("m"), F.lit(False).alias("changed"), F.array().cast("array<struct<day:date,m:int,changed:boolean>>").alias("out")),
        lambda a, d: F.struct(
            F.element_at(d["table"], a["m"] - F.col("lowest") + 1)["m"].alias("m"),
            (a["changed"] | F.element_at(d["table"], a["m"] - F.col("lowest") + 1)["changed"]).alias("changed"),
            F.concat(a["out"], F.array(F.struct(d["day"].alias("day"), a["m"].alias("m"), a["changed"].alias("changed")))).alias("out"),
        ),
        lambda a: a["out"],
    )
    begins = chain.select("ip_id", F.inline(begin)).withColumnsRenamed({"m": "start_minutes", "changed": "changed_before"})
    steps = F.aggregate(
        "crawls",
        F.struct(
            F.col("start_minutes").alias("m"), F.col("changed_before").alias("changed"),
            F.array().cast("array<struct<crawl_ts:timestamp_ntz,asked:string,old_minutes:int,new_minutes:int,changed:boolean>>").alias("out"),
        ),
        lambda a, c: F.struct(
            step(rules, a["m"], c["asked"]).cast("int").alias("m"),
            (a["changed"] | (step(rules, a["m"], c["asked"]) != a["m"])).alias("changed"),
            F.concat(
                a["out"],
                F.array(
                    F.struct(
                        c["crawl_ts"].alias("crawl_ts"), c["asked"].alias("asked"), a["m"].alias("old_minutes"), step(rules, a["m"], c["asked"]).cast("int").alias("new_minutes"),
                        (a["changed"] | (step(rules, a["m"], c["asked"]) != a["m"])).alias("changed"),
                    )
                ),
            ).alias("out"),
        ),
        lambda a: a["out"],
    )
    folded = days.join(begins, ["ip_id", "day"]).select("ip_id", "weight", F.inline(steps))
    return folded.select(
        "ip_id",
        "crawl_ts",
        F.when(F.col("new_minutes") != F.col("old_minutes"), F.col("asked")).otherwise("none").alias("adjustment"),
        "old_minutes",
        "new_minutes",
        F.when(F.col("changed"), minutes_to_weight(F.col("new_minutes"), rules.base)).otherwise(F.col("weight")).alias("new_weight"),
    )
