"""Market and strategy operators: price bands, opportunity scores, shop roll-ups, what-if estimates and stock risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def price_band(listings: DataFrame, own: DataFrame, by: str) -> DataFrame:
    """by, listings, lower, typical, upper, own_price, position: second lowest, median and second highest price, to the thousand."""
    band = lambda c: F.bround(c.cast("decimal(18,4)"), -3).cast("double")
    low, high = Window.partitionBy(by).orderBy("price"), Window.partitionBy(by).orderBy(F.desc("price"))
    p = listings.withColumns({"lo": F.row_number().over(low), "hi": F.row_number().over(high)})
    b = p.groupBy(by).agg(F.count("*").alias("listings"), band(F.max(F.when(F.col("lo") == 2, F.col("price")))).alias("lower"), band(F.percentile("price", F.lit(0.5))).alias("typical"), band(F.max(F.when(F.col("hi") == 2, F.col("price")))).alias("upper"))
    o = own.filter("price > 0").groupBy(by).agg(band(F.percentile("price", F.lit(0.5))).alias("own_price"))
    label = F.when(F.col("own_price").isNull(), "unknown").when(F.col("own_price") < F.col("lower"), "below").when(F.col("own_price") > F.col("upper"), "above").otherwise("within")
    return b.join(o, by, "left").withColumn("position", label)


def opportunities(rows: DataFrame, key: str) -> DataFrame:
    """Scores on the largest volume and revenue, with a rank and what to do. rows: key, units, revenue, fit, reviews, longevity."""
    most = rows.agg(F.max("units").cast("double").alias("mu"), F.max("revenue").cast("double").alias("mr"))
    r = rows.crossJoin(F.broadcast(most))
    volume, revenue = F.try_divide(F.col("units").cast("double"), F.col("mu")) * 100.0, F.try_divide(F.col("revenue").cast("double"), F.col("mr")) * 100.0
    r = r.withColumns({"volume_score": volume, "revenue_score": revenue})
    balance = F.least("volume_score", "revenue_score")
    score = balance * 0.30 + (F.col("volume_score") + F.col("revenue_score")) / 2.0 * 0.15 + F.col("fit") * 0.20 + F.col("reviews") * 0.20 + F.col("longevity") * 0.15
    r = r.withColumn("opportunity_score", score.cast("decimal(18,6)"))
    advice = F.when(F.col("opportunity_score") >= 80, "try_small").when(F.col("opportunity_score") >= 68, "watch").otherwise("wait")
    rank = F.row_number().over(Window.orderBy(F.desc("opportunity_score"), key)).cast("long")
    return r.select(key, F.col("volume_score").cast("decimal(18,6)").alias("volume_score"), F.col("revenue_score").cast("decimal(18,6)").alias("revenue_score"), "opportunity_score", advice.alias("advice"), rank.alias("rank"))


def what_if(shops: DataFrame, price_change: int, bundle: bool, ad_change: int, restock: int) -> DataFrame:
    """Estimated whole units and revenue after one bounded change, and the revenue's change. shops: shop, units, gmv."""
    demand = max(0.72, min(1.28, 1 - price_change * 0.012))
    factor = demand * (1.08 if bundle else 1.0) * (1 + min(0.12, max(0, ad_change) * 0.0024))
    stock = 1 + F.least(F.lit(0.10), F.lit(float(restock)) / F.greatest(F.col("units"), F.lit(1)) * 0.8)
    if price_change <= -10 and not bundle:
        risk = "high"
    elif (ad_change >= 40 and not bundle) or restock == 0:
        risk = "medium"
    else:
        risk = "controlled"
    units = F.bround(F.col("units") * F.lit(factor) * stock).cast("long")
    gmv = F.bround(F.col("gmv").cast("double") * F.lit(factor * (1 + price_change / 100)) * stock).cast("long")
    s = shops.select("shop", units.alias("estimated_units"), gmv.alias("estimated_gmv"), F.col("gmv").cast("double").alias("_was"))
    change = F.coalesce(F.try_divide(F.col("estimated_gmv").cast("double"), F.col("_was")) - 1, F.lit(0.0)) * 100
    return s.withColumns({"gmv_change_percent": tenth(change), "risk": F.lit(risk)}).drop("_was")


def tenth(c: Column) -> Column:
    """To one place, halves up."""
    return F.floor(c * 10 + 0.5) / 10


def stock_risk(items: DataFrame, target_months: float = 2.0) -> DataFrame:
    """Status and order proposal of each item; if none is proposed, the healthy item with the least cover gets a small one.

    items: item, price, unit_cost, reserve, sold_per_month, on_hand, idle_days, score."""
    sold = F.greatest(F.lit(1.0), F.col("sold_per_month"))
    margin = F.col("price") - F.col("unit_cost") - F.col("reserve")
    r = items.withColumns({"sold": sold, "margin": margin, "cover": tenth(F.col("on_hand") / sold), "capital": F.col("on_hand") * F.col("unit_cost")})
    status = F.when(F.col("margin") <= 0, "loss").when(F.col("idle_days") >= 60, "idle").when(F.col("cover") >= target_months + 1.5, "tied_up").when((F.col("cover") < 0.8) & (F.col("score") >= 62), "reorder").otherwise("watch")
    r = r.withColumn("status", status)
    quantity = F.when(F.col("status") == "reorder", F.greatest(F.lit(1), F.ceil(F.col("sold") * target_months - F.col("on_hand")))).otherwise(F.lit(0)).cast("long")
    r = r.withColumn("order_quantity", quantity)
    eligible = (F.col("margin") > 0) & (F.col("idle_days") < 60)
    chosen = r.agg(F.count_if(F.col("order_quantity") > 0).alias("orders"), F.min(F.when(eligible, F.struct("cover", "item")))["item"].alias("pick"))
    r = r.crossJoin(F.broadcast(chosen))
    fallback = F.coalesce((F.col("orders") == 0) & (F.col("item") == F.col("pick")), F.lit(False))
    small = F.greatest(F.lit(1), F.ceil(tenth(F.col("sold")) * target_months * 0.5)).cast("long")
    r = r.withColumns({"order_quantity": F.when(fallback, small).otherwise(F.col("order_quantity")), "status": F.when(fallback, "try_small").otherwise(F.col("status"))})
    return r.select("item", "status", "order_quantity", (F.col("order_quantity") * F.col("unit_cost")).alias("order_budget"), F.col("cover").cast("decimal(18,6)").alias("cover"), "capital")


def stock_totals(risks: DataFrame) -> DataFrame:
    """One row over stock_risk's rows: items not to buy again, to buy, capital in those that lose money or lie idle, and the
    proposed budget."""
    dead = F.col("status").isin("loss", "idle")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return risks.agg(
        F.count_if(dead).alias("no_reorder"), F.count_if(F.col("order_quantity") > 0).alias("reorder"), total(F.when(dead, F.col("capital"))).alias("capital_at_risk"),
        total(F.when(F.col("order_quantity") > 0, F.col("order_budget"))).alias("suggested_budget"),
    )


def shop_scores(listings: DataFrame, shops: DataFrame) -> DataFrame:
    """shop, listing_count, units, gmv, average_price, shop_score of every shop. listings: shop, product, price, units. shops:
    shop, rating (to 5), longevity (to 100)."""
    by = listings.groupBy("shop").agg(F.count("*").alias("listing_count"), F.sum("units").cast("long").alias("units"), F.sum(F.col("price") * F.col("units")).cast("long").alias("gmv"))
    s = by.join(shops, "shop").crossJoin(F.broadcast(by.agg(F.max("units").alias("mu"), F.max("gmv").alias("mg"))))
    volume, revenue = (F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0)) * 100 for a, b in (("units", "mu"), ("gmv", "mg")))
    score = F.least(volume, revenue) * 0.45 + (volume + revenue) / 2 * 0.20 + tenth(F.col("rating") / 5 * 100) * 0.20 + F.col("longevity") * 0.15
    return s.select("shop", "listing_count", "units", "gmv", F.bround(F.try_divide(F.col("gmv").cast("double"), F.col("units"))).cast("long").alias("average_price"), score.cast("decimal(18,6)").alias("shop_score"))


def listing_scores(listings: DataFrame, shops: DataFrame) -> DataFrame:
    """shop, product, product_score of every listing, on the largest volume and revenue of any."""
    rows = listings.withColumn("gmv", F.col("price") * F.col("units"))
    r = rows.join(shops.select("shop", "rating"), "shop").crossJoin(F.broadcast(rows.agg(F.max("units").alias("mu"), F.max("gmv").alias("mg"))))
    volume, revenue = (F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0)) * 100 for a, b in (("units", "mu"), ("gmv", "mg")))
    score = F.least(volume, revenue) * 0.50 + (volume + revenue) / 2 * 0.20 + F.col("rating") / 5 * 100 * 0.30
    return r.select("shop", "product", score.cast("decimal(18,6)").alias("product_score"))


def advice(scores: DataFrame, shops: DataFrame, own: int) -> DataFrame:
    """One row: who leads the other shops by revenue, their mean price and rating, and how far the own shop is from them.
    scores: as shop_scores gives them."""
    s = scores.join(shops.select("shop", "rating"), "shop")
    other = F.col("shop") != own
    o = s.agg(
        F.max_by("shop", F.when(other, F.struct("gmv", -F.col("shop")))).alias("leader"), F.avg(F.when(other, F.col("average_price"))).alias("typical_price"), F.avg(F.when(other, F.col("rating"))).alias("average_rating"),
        F.max(F.when(~other, F.col("average_price"))).alias("own_price"), F.max(F.when(~other, F.col("rating"))).alias("own_rating"),
    )
    gap = F.col("own_price") - F.col("typical_price")
    direction = F.when(gap > 0, "above").when(gap < 0, "below").otherwise("near")
    return o.select("leader", F.col("typical_price").cast("decimal(18,4)").alias("typical_price"), gap.cast("decimal(18,4)").alias("price_gap"), direction.alias("direction"), (F.col("average_rating") - F.col("own_rating")).cast("decimal(18,6)").alias("rating_gap"))
