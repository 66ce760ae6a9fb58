"""The entity dimension: lists, search, import, partial update, soft delete."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketebb.operators.slices import global_rank

NAMES = ("name", "name_en", "name_cn")
BLIND = "UNICODE_CI_AI"  # collation that ignores case and accents


def entity_list(
    entities: DataFrame, status: str | None = None, category: str | None = None, keyword: str | None = None
) -> DataFrame:
    """Entities of a status (everything but deleted by default), a category, matching a keyword.

    The keyword may stand in any of the three names; case and accents do not matter.
    """
    rows = entities.filter(F.col("status") == status if status else F.col("status") != "deleted")
    if category:
        rows = rows.filter(F.col("category") == category)
    if keyword:
        hit = F.lit(False)
        for name in NAMES:
            hit = hit | F.coalesce(
                F.contains(F.collate(F.col(name), BLIND), F.collate(F.lit(keyword), BLIND)), F.lit(False)
            )
        rows = rows.filter(hit)
    return rows


def market_filter(entities: DataFrame, category: str = "All", keyword: str = "") -> DataFrame:
    """Category or 'All', and a case-blind substring of any name."""
    rows = entities if category == "All" else entities.filter(F.col("category") == category)
    if keyword:
        hit = F.lit(False)
        for name in NAMES:
            hit = hit | F.coalesce(F.contains(F.lower(name), F.lit(keyword.lower())), F.lit(False))
        rows = rows.filter(hit)
    return rows


def categories(entities: DataFrame) -> DataFrame:
    named = entities.filter(F.length("category") > 0)
    return named.select("category").distinct().orderBy("category")


def normalise(entries: DataFrame) -> DataFrame:
    """Import entries with defaults filled in: weight 1, empty tags, status active."""
    weight = F.col("weight").cast("double")
    rows = entries.withColumn("weight", F.when(weight > 0, weight).otherwise(1.0)).withColumn("status", F.lit("active"))
    if "tags" in entries.columns:
        rows = rows.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    return rows


def rejected(entries: DataFrame) -> DataFrame:
    """Entries without a name."""
    return entries.filter(F.coalesce(F.length("name"), F.lit(0)) == 0).withColumn("error", F.lit("name is required"))


def import_plan(entities: DataFrame, entries: DataFrame, upsert: bool = True) -> DataFrame:
    """One row per named entry name: the values to store and what happens to them.

    Of several entries with one name the last (by ``pos``) wins an upsert and the first wins an
    insert-only import. ``created``/``updated``/``skipped`` count entries.
    """
    good = normalise(entries.filter(F.length("name") > 0))
    fields = [c for c in good.columns if c not in ("name", "pos")]
    pick = F.max_by if upsert else F.min_by
    # the two aggregates combine copies of a name before the shuffle
    per_name = good.groupBy("name").agg(
        pick(F.struct(*fields), "pos").alias("v"), F.count(F.lit(1)).alias("entries")
    )
    known = entities.select("name", F.col("id").alias("__id"))
    joined = per_name.join(known, "name", "left")
    new = F.col("__id").isNull()
    fresh = F.when(new, 1).otherwise(0).cast("long")
    again = F.col("entries") - fresh
    return joined.select(
        F.col("__id").alias("id"),
        "name",
        "v.*",
        F.when(new, "created").otherwise("updated" if upsert else "skipped").alias("outcome"),
        fresh.alias("created"),
        (again if upsert else F.lit(0).cast("long")).alias("updated"),
        (F.lit(0).cast("long") if upsert else again).alias("skipped"),
    )


def import_summary(plan: DataFrame, entries: DataFrame) -> DataFrame:
    """Created, updated, skipped and failed entries in one row."""
    done = plan.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("created", "updated", "skipped")]
    )
    failed = rejected(entries).agg(F.count(F.lit(1)).alias("n")).scalar()
    return done.withColumn("failed", failed)


def apply_import(entities: DataFrame, plan: DataFrame, upsert: bool = True) -> DataFrame:
    """The dimension after the import. New entities get ids after the largest one.

    Updates keep id and status. Nothing is written: for a dry run show the result, otherwise store it.
    """
    values = [c for c in entities.columns if c in plan.columns and c not in ("id", "name", "status")]
    if upsert:
        change = plan.filter("outcome = 'updated'").select(
            "name", F.lit(True).alias("__hit"), *[F.col(c).alias(f"__{c}") for c in values]
        )
        kept = entities.join(change, "name", "left")
        for c in values:
            kept = kept.withColumn(c, F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)))
        kept = kept.select(*entities.columns)
    else:
        kept = entities
    top = entities.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    fresh = global_rank(plan.filter("outcome = 'created'"), [F.col("name")])
    fresh = fresh.withColumn("id", F.col("position") + top).select(
        *[F.col(c) for c in entities.columns if c in fresh.columns]
    )
    return kept.unionByName(fresh, allowMissingColumns=True)


def partial_update(entities: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows keyed by id with only the given (non-NULL) fields changed."""
    fields = [c for c in changes.columns if c != "id"]
    if not fields:
        raise ValueError("no field to update")
    renamed = changes.select("id", *[F.col(c).alias(f"__{c}") for c in fields])
    joined = entities.join(renamed, "id", "left")
    for c in fields:
        joined = joined.withColumn(c, F.coalesce(f"__{c}", c))
    return joined.select(*entities.columns)


def soft_delete(entities: DataFrame, ids: DataFrame) -> DataFrame:
    hit = ids.select("id").distinct().withColumn("__hit", F.lit(True))
    joined = entities.join(hit, "id", "left")
    return joined.withColumn("status", F.when(F.col("__hit"), "deleted").otherwise(F.col("status"))).select(
        *entities.columns
    )


def touch_crawled(entities: DataFrame, crawls: DataFrame) -> DataFrame:
    """Dimension with ``last_crawled_at`` moved to each entity's newest crawl."""
    newest = crawls.groupBy(F.col("ip_id").alias("id")).agg(F.max("crawl_ts").alias("__at"))
    joined = entities.join(newest, "id", "left")
    if "last_crawled_at" in entities.columns:
        at = F.greatest("last_crawled_at", "__at")
        return joined.withColumn("last_crawled_at", at).select(*entities.columns)
    return joined.withColumnRenamed("__at", "last_crawled_at")
