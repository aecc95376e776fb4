"""The dashboard's filters and aggregates, and small relational operators on sets of keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .reports import GMV, PLATFORM, SELLER, SFEE, TFEE, Shelf, as_double, completed, contributions, in_period, month_of, products


def category_sales(shelf: Shelf, category: str, period: str | None = None) -> DataFrame:
    """month, order_count, gmv of a category's products: the filter is a semi join on their skus."""
    skus = shelf["products"].filter(F.col("category") == category).select("sku")
    s = completed(shelf, period).join(skus, "sku", "left_semi")
    return s.groupBy(month_of("order_date").alias("month")).agg(F.count("*").alias("order_count"), F.sum(GMV).cast("double").alias("gmv")).orderBy("month")


#: Fixed: the tables of the dashboard, by whether they are limited by sku and by which column of dates or months.
LIMITED = {
    "products": ("sku",), "inventory": ("sku",), "orders": ("sku", "order_date"), "ads": ("month",), "purchase_orders": ("sku", "order_date"), "returns": ("sku", "request_date"),
    "reviews": ("sku", "review_date"), "operating_costs": ("month",), "inventory_movements": ("sku", "movement_date"), "quality_checks": ("sku", "check_date"), "cash_flow": ("date",),
    "supplier_performance": ("month",), "customer_segments": ("month",), "product_funnel": ("sku", "month"), "co_purchase": ("sku", "paired_sku", "month"),
}


def limited(shelf: Shelf, categories: list[str], months: list[str]) -> dict[str, DataFrame]:
    """The dashboard's 15 tables for the products of some categories and for some months. Products are limited by a semi
    join on their skus (for pairs, on both), months by ranges of dates that reach the scan."""
    skus = shelf["products"].filter(F.col("category").isin(categories)).select("sku")
    out = {}
    for table, columns in LIMITED.items():
        rows = shelf[table]
        for c in columns:
            if c.endswith("sku"):
                rows = rows.join(skus.select(F.col("sku").alias(c)), c, "left_semi")
            elif c == "month":
                rows = rows.filter(F.col(c).isin(months))
            else:
                rows = rows.filter(reduce(Column.__or__, (in_period(c, m) for m in months), F.lit(False)))
        out[table] = rows
    return out


def percentage(part: DataFrame, whole: DataFrame) -> DataFrame:
    """percent: what one number is of another (one row each: value); an error if the whole is 0."""
    both = part.select(F.col("value").cast("double").alias("p")).crossJoin(F.broadcast(whole.select(F.col("value").cast("double").alias("w"))))
    return both.select(F.when(F.col("w") == 0, F.raise_error(F.lit("a percentage of 0")).cast("double")).otherwise(F.col("p") / F.col("w") * 100).alias("percent"))


def cost_shares(shelf: Shelf) -> DataFrame:
    c = shelf["operating_costs"].groupBy(F.col("cost_category").alias("category")).agg(F.sum("amount_vnd").alias("n"))
    share = F.coalesce(F.try_divide(F.col("n").cast("double") * 100.0, F.sum("n").over(Window.partitionBy()).cast("double")), F.lit(0.0))
    return c.select("category", as_double(F.col("n")).alias("amount"), share.alias("share_percent"), F.row_number().over(Window.orderBy(F.desc("n"), "category")).cast("long").alias("position"))


def monthly_gmv(shelf: Shelf) -> DataFrame:
    return completed(shelf).groupBy(month_of("order_date").alias("month")).agg(F.sum(GMV).cast("double").alias("gmv")).orderBy("month")


def deductions(shelf: Shelf, period: str | None = None) -> DataFrame:
    """kind, amount of what is taken from sales; only kinds over 0."""
    s = completed(shelf, period).agg(F.sum(SELLER).alias("seller_discount"), F.sum(PLATFORM).alias("platform_discount"), F.sum(TFEE).alias("transaction_fee"), F.sum(SFEE).alias("service_fee"))
    return s.unpivot([], ["seller_discount", "platform_discount", "transaction_fee", "service_fee"], "kind", "amount").filter("amount > 0").select("kind", as_double(F.col("amount")).alias("amount"))


def top_products(shelf: Shelf, n: int = 12) -> DataFrame:
    c = contributions(shelf)
    return c.select("sku", "product_name", as_double(F.col("gmv")).alias("gmv"), as_double(F.col("contribution")).alias("contribution")).orderBy(F.desc("gmv"), "sku").limit(n)


def price_position(shelf: Shelf) -> DataFrame:
    """Each product's list price beside the least, median and largest price of its category's other products; alone there: null."""
    p = products(shelf).select("sku", "category", F.col("list_price").cast("double").alias("price")).filter("price is not null")
    w = Window.partitionBy("category")
    p = p.withColumns({"place": F.row_number().over(w.orderBy("price", "sku")) - 1, "others": F.count("*").over(w) - 1})
    # Of a category's prices in order, the two ends and the middle ones are all that a product's others can differ in.
    one, two = F.floor((F.col("others") - 1) / 2), F.floor(F.col("others") / 2)
    at = {"a0": F.lit(0), "a1": F.lit(1), "z0": F.col("others"), "z1": F.col("others") - 1, "m0": one, "m1": one + 1, "m2": one + 2}
    ends = p.groupBy("category").agg(*(F.max(F.when(F.col("place") == i, F.col("price"))).alias(n) for n, i in at.items()))
    p = p.join(ends, "category")
    low = F.when(F.col("place") == 0, F.col("a1")).otherwise(F.col("a0"))
    high = F.when(F.col("place") == F.col("others"), F.col("z1")).otherwise(F.col("z0"))
    first = F.when(F.col("place") > one, F.col("m0")).otherwise(F.col("m1"))
    second = F.when(one == two, first).when(F.col("place") > two, F.col("m1")).otherwise(F.col("m2"))
    p = p.select("sku", "category", "price", F.when(F.col("others") > 0, low).alias("low"), F.when(F.col("others") > 0, (first + second) / 2).alias("median"), F.when(F.col("others") > 0, high).alias("high"))
    label = F.when(F.col("price") < F.col("low"), "below").when(F.col("price") > F.col("high"), "above").when(F.col("low").isNotNull(), "within").otherwise("unknown")
    return p.withColumn("position", label)


def never_sold(shelf: Shelf) -> DataFrame:
    """sku, product_name of products without a completed order."""
    return shelf["products"].join(completed(shelf).select("sku"), "sku", "left_anti").select("sku", "product_name")


def duplicates(rows: DataFrame, key: str, text: str) -> DataFrame:
    """sha256, copies, first of texts that occur more than once. Only digests are shuffled."""
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256).alias("sha256")
    return rows.select(key, digest).groupBy("sha256").agg(F.count("*").alias("copies"), F.min(key).alias("first")).filter("copies > 1")


def previous_user_turn(turns: DataFrame) -> DataFrame:
    """conv_id, turn, text, previous, repeated: the user's turns, each with the one before, and whether it repeats it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    u = turns.filter("role = 'user'").withColumn("previous", F.lag("text").over(w))
    same = F.lower(F.trim("text")) == F.lower(F.trim("previous"))
    return u.select("conv_id", "turn", "text", "previous", F.coalesce(same, F.lit(False)).alias("repeated"))


def last_turns(turns: DataFrame, n: int = 6) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("back", F.row_number().over(w).cast("long")).filter(F.col("back") <= n).select("conv_id", "turn", "role", "text", "back")


def strong_hits(hits: DataFrame, least: float = 2.0, share: float = 0.62, n: int = 2) -> DataFrame:
    """Of each query's ranked hits, the first n that reach both a floor and a share of the best score."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    kept = hits.withColumn("best", best).filter((F.col("score").cast("double") >= least) & (F.col("score").cast("double") >= F.col("best").cast("double") * share))
    return kept.filter(F.col("rank") <= n).select("query_id", "rank", "doc_id", "score")
