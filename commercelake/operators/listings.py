"""Product listings: category normalisation, validation, partial updates, feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commercelake.functions.text import strip

MAX_DEPTH = 3
MAX_PHOTOS = 10

# Why a listing is refused.
NO_TITLE = "Title is required"
NO_DESCRIPTION = "Description is required"
NO_CATEGORY = "Category is required"
DEEP_CATEGORY = "Category depth exceeds 3 levels"
BAD_PHOTOS = "Photos must contain between 1 and 10 images"
BAD_PRICE = "Price must be greater than zero"
BAD_STOCK = "Stock must be non-negative"
NO_SKU = "SKU is required"


NOT_FOUND = "Item not found"


def category_path(raw: Column, listed: bool = False) -> Column:
    """'a > b > c', or a list of levels, to its trimmed, non-blank levels."""
    parts = F.coalesce(raw, F.array().cast("array<string>")) if listed else F.split(F.coalesce(raw, F.lit("")), ">")
    return F.filter(F.transform(parts, strip), lambda part: part != "")


def _listed(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.ArrayType)


def normalize_category(df: DataFrame, raw: str = "category") -> DataFrame:
    """Add the path and the reason a category is refused (NULL when it is fine)."""
    path = df.withColumn("path", category_path(F.col(raw), _listed(df, raw)))
    depth = F.size("path")
    return path.withColumn(
        "category_error",
        F.when(depth == 0, NO_CATEGORY).when(depth > MAX_DEPTH, DEEP_CATEGORY),
    )


def validate_listing(df: DataFrame, present: str | None = None) -> DataFrame:
    """Add violations ARRAY<STRING>, in the order a listing is checked.

    With present (an ARRAY<STRING> column of supplied fields) only those are checked.
    """

    def blank(name: str) -> Column:
        return strip(F.coalesce(F.col(name), F.lit(""))) == ""

    depth = F.size(category_path(F.col("category"), _listed(df, "category")))
    photos = F.coalesce(F.size("photos"), F.lit(0))
    rules = [
        ("title", blank("title"), NO_TITLE),
        ("description", blank("description"), NO_DESCRIPTION),
        ("category", depth == 0, NO_CATEGORY),
        ("category", depth > MAX_DEPTH, DEEP_CATEGORY),
        ("photos", ~photos.between(1, MAX_PHOTOS), BAD_PHOTOS),
        ("price", F.coalesce(F.col("price_cents"), F.lit(0)) <= 0, BAD_PRICE),
        ("stock", F.coalesce(F.col("stock"), F.lit(-1)) < 0, BAD_STOCK),
        ("sku", blank("sku"), NO_SKU),
    ]

    def applies(field: str, broken: Column) -> Column:
        return broken if present is None else F.array_contains(present, field) & broken

    found = F.array(*[F.when(applies(field, broken), F.lit(message)) for field, broken, message in rules])
    return df.withColumn("violations", F.array_compact(found))


def patch(
    base: DataFrame, updates: DataFrame, key: str, fields: dict[str, str], order: str, problem: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """Overwrite only the fields each update supplies: (changed rows, refused updates with reason).

    updates holds key, order (non-null, distinct per key), keys ARRAY<STRING> and the new
    values: a field listed in keys is taken even when its value is NULL, a field that is not
    listed is left alone. fields maps such names to columns. Of several updates the last that
    lists a field counts for it. An update of an unknown key, or one with a problem, is
    refused as a whole.
    """
    checked = updates.withColumn("_problem", problem if problem is not None else F.lit(None).cast("string"))

    def last(name: str, column: str) -> Column:
        listed = F.when(F.array_contains("keys", name), F.col(order))
        return F.max_by(F.struct(F.col(column).alias("v")), listed).alias(f"_new_{column}")

    new = checked.where("_problem IS NULL").groupBy(key).agg(*[last(*pair) for pair in fields.items()])
    joined = base.join(new, key, "left")
    changed = joined.select(
        *[
            F.when(F.col(f"_new_{c}").isNotNull(), F.col(f"_new_{c}")["v"]).otherwise(F.col(c)).alias(c)
            if c in fields.values()
            else F.col(c)
            for c in base.columns
        ]
    )
    known = base.select(key, F.lit(True).alias("_known"))
    reason = F.when(F.col("_known").isNull(), NOT_FOUND).otherwise(F.col("_problem"))
    refused = checked.join(known, key, "left").withColumn("reason", reason).where("reason IS NOT NULL")
    return changed, refused.select(*updates.columns, "reason")


def deactivate(items: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Soft delete: (items with the requested ones inactive, requests for unknown items)."""
    hits = requests.select("item_id").distinct().withColumn("_hit", F.lit(True))
    changed = (
        items.join(hits, "item_id", "left")
        .withColumn("active", F.when(F.col("_hit"), False).otherwise(F.col("active")))
        .drop("_hit")
    )
    return changed, requests.join(items.select("item_id"), "item_id", "left_anti")


def feed(items: DataFrame, category: str = "all") -> DataFrame:
    return items if category == "all" else items.where(F.col("category") == category)


def by_state(items: DataFrame) -> DataFrame:
    """Listing counts, active and paused; an unknown state counts as paused."""
    state = F.when(F.coalesce("active", F.lit(False)), "active").otherwise("paused")
    return items.groupBy(state.alias("state")).agg(F.count("*").alias("items"))


def newest_first(items: DataFrame, limit: int) -> DataFrame:
    return items.orderBy(F.desc("item_id")).limit(limit)
