"""The shop's reports. Each takes the shelf (tables by name, typed) and a period, and returns a DataFrame.

A period is a prefix of ISO dates ("2026", "2026-08") or None for all rows; month tables match it whole. Dimension
tables are joined by broadcast only if Spark's size estimate allows; a missing product keeps its sku as its name
and a cost of 0. Undefined ratios are null, but a campaign's return on no spend is 0. Ties are settled by keys.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import header_form
from ..session import settled, without_shuffles
from .ordinals import numbered, running

Shelf = Mapping[str, DataFrame]


def money(c: Column | str) -> Column:
    return F.coalesce(c, F.lit(0)).cast("decimal(18,4)") if isinstance(c, Column) else F.coalesce(F.col(c), F.lit(0)).cast("decimal(18,4)")


def total(c: Column | str) -> Column:
    """A sum that is 0 over no rows."""
    return F.coalesce(F.sum(c), F.lit(0))


def as_double(c: Column) -> Column:
    return c.cast("double")


def ratio(a: Column, b: Column, scale: float = 1.0) -> Column:
    """scale * a / b in doubles; null where b is 0."""
    return F.try_divide(a.cast("double") * F.lit(scale), b.cast("double"))


def in_period(column: str, period: str | None) -> Column:
    """Rows whose date starts with the period, as a range that reaches the scan."""
    c = F.col(column)
    if period is None:
        return F.lit(True)
    year = int(period[:4])
    if len(period) == 4:
        return (c >= F.lit(date(year, 1, 1))) & (c < F.lit(date(year + 1, 1, 1)))
    month = int(period[5:7])
    if len(period) == 7:
        return (c >= F.lit(date(year, month, 1))) & (c < F.lit(date(year + month // 12, month % 12 + 1, 1)))
    return c == F.lit(date.fromisoformat(period))


def in_month(period: str | None) -> Column:
    return F.lit(True) if period is None else F.col("month") == period


def month_of(column: str) -> Column:
    return F.date_format(column, "yyyy-MM")


def completed(shelf: Shelf, period: str | None = None) -> DataFrame:
    return shelf["orders"].filter((F.lower(F.trim("status")) == "completed") & in_period("order_date", period))


def products(shelf: Shelf) -> DataFrame:
    return shelf["products"].select("sku", "product_name", "category", F.col("cost_per_unit_vnd").alias("unit_cost"), F.col("list_price_vnd").alias("list_price"))


def named(df: DataFrame, shelf: Shelf) -> DataFrame:
    """df with product_name (the sku where unknown), unit_cost (0) and list_price (0)."""
    p = products(shelf).select("sku", F.col("product_name").alias("_n"), F.col("unit_cost").alias("_c"), F.col("list_price").alias("_l"))
    return df.join(p, "sku", "left").withColumns({"product_name": F.coalesce("_n", F.col("sku").cast("string")), "unit_cost": money("_c"), "list_price": money("_l")}).drop("_n", "_c", "_l")


GMV, SELLER, PLATFORM = "gross_merchandise_value_vnd", "seller_discount_vnd", "platform_discount_vnd"
TFEE, SFEE = "estimated_transaction_fee_vnd", "estimated_service_fee_vnd"


def sales_summary(shelf: Shelf, period: str | None = None) -> DataFrame:
    sums = {"gmv": GMV, "seller_discount": SELLER, "platform_discount": PLATFORM, "transaction_fee": TFEE, "service_fee": SFEE}
    s = completed(shelf, period).agg(F.count("*").alias("order_count"), total("quantity").cast("long").alias("units"), *(total(c).alias(n) for n, c in sums.items()))
    fees = F.col("transaction_fee") + F.col("service_fee")
    s = s.withColumn("platform_fees", fees).withColumn("net_revenue", F.col("gmv") - F.col("seller_discount") - fees)
    return s.select("order_count", "units", *(as_double(F.col(c)).alias(c) for c in (*sums, "platform_fees", "net_revenue")))


def product_gmv_ranking(shelf: Shelf, period: str | None = None) -> DataFrame:
    by = completed(shelf, period).groupBy("sku").agg(F.sum(GMV).alias("gmv"), F.sum("quantity").cast("long").alias("units"), F.count("*").alias("order_count"))
    ranked = named(by, shelf).select("sku", "product_name", as_double(F.col("gmv")).alias("gmv"), "units", "order_count")
    return ranked.orderBy(F.desc("gmv"), "product_name", "sku")


def contributions(shelf: Shelf, period: str | None = None) -> DataFrame:
    """sku, product_name, units, gmv, contribution (exact decimals)."""
    by = completed(shelf, period).groupBy("sku").agg(F.sum(GMV).alias("gmv"), F.sum("quantity").cast("long").alias("units"), F.sum(F.col(SELLER) + F.col(TFEE) + F.col(SFEE)).alias("deducted"))
    cost = (F.col("unit_cost") * F.col("units")).cast("decimal(28,4)")
    return named(by, shelf).withColumn("contribution", F.col("gmv").cast("decimal(28,4)") - F.col("deducted").cast("decimal(28,4)") - cost)


def product_contribution(shelf: Shelf, period: str | None = None) -> DataFrame:
    c = contributions(shelf, period)
    return c.select(
        "sku", "product_name", "units", as_double(F.col("gmv")).alias("gmv"), as_double(F.col("contribution")).alias("contribution"),
        ratio(F.col("contribution"), F.col("units")).alias("contribution_per_unit"), ratio(F.col("contribution"), F.col("gmv"), 100).alias("margin_percent"),
    ).orderBy("contribution", "sku")


def monthly_sales(shelf: Shelf) -> DataFrame:
    m = completed(shelf).groupBy(month_of("order_date").alias("month")).agg(F.count("*").alias("order_count"), F.sum(GMV).alias("gmv"))
    return m


def sales_period_comparison(shelf: Shelf) -> DataFrame:
    """Every recorded month beside the recorded month before it. Months are few: the window holds one row each."""
    m = monthly_sales(shelf)
    w = Window.orderBy("month")
    m = m.withColumn("previous_month", F.lag("month").over(w)).withColumn("previous_gmv", F.lag("gmv").over(w))
    change = (F.col("gmv") - F.col("previous_gmv")).cast("double") * 100.0
    return m.select("month", "order_count", as_double(F.col("gmv")).alias("gmv"), "previous_month", as_double(F.col("previous_gmv")).alias("previous_gmv"), F.try_divide(change, F.col("previous_gmv").cast("double")).alias("gmv_change_percent")).orderBy("month")


def inventory_alerts(shelf: Shelf) -> DataFrame:
    i = shelf["inventory"].withColumn("available", F.col("on_hand") - F.col("reserved")).filter(F.col("available") <= F.col("reorder_point"))
    i = i.withColumn("shortfall", F.col("reorder_point") - F.col("available"))
    return named(i, shelf).select("sku", "product_name", "available", "reorder_point", "shortfall").orderBy(F.desc("shortfall"), "sku")


def inventory_slow_products(shelf: Shelf, period: str | None = None) -> DataFrame:
    sold = completed(shelf, period).groupBy("sku").agg(F.sum("quantity").cast("long").alias("n"))
    i = shelf["inventory"].join(sold, "sku", "left").withColumns({"units_sold": F.coalesce("n", F.lit(0)), "available": F.col("on_hand") - F.col("reserved")})
    return named(i, shelf).select("sku", "product_name", "units_sold", "available").orderBy("units_sold", F.desc("available"), "product_name", "sku")


def advertising_summary(shelf: Shelf, period: str | None = None) -> DataFrame:
    a = shelf["ads"].filter(in_month(period)).agg(F.count("*").alias("campaign_count"), total("spend_vnd").alias("spend"), total("attributed_revenue_vnd").alias("revenue"), total("orders").cast("long").alias("orders"))
    return a.select("campaign_count", as_double(F.col("spend")).alias("spend"), as_double(F.col("revenue")).alias("revenue"), "orders", F.coalesce(ratio(F.col("revenue"), F.col("spend")), F.lit(0.0)).alias("roas"))


def profitability_summary(shelf: Shelf, period: str | None = None) -> DataFrame:
    o = named(completed(shelf, period), shelf)
    net = F.col(GMV) - F.col(SELLER) - F.col(TFEE) - F.col(SFEE)
    s = o.agg(total(net).alias("net"), total((F.col("unit_cost") * F.col("quantity")).cast("decimal(28,4)")).alias("cogs"))
    return s.select(as_double(F.col("net")).alias("net_revenue"), as_double(F.col("cogs")).alias("cogs"), as_double(F.col("net") - F.col("cogs")).alias("contribution"))


def by_label(df: DataFrame, label: str, amount: str, out: str, blank: str) -> DataFrame:
    """Sums by a label, where blank has a name, with each one's share of all; the largest first."""
    name = F.coalesce(F.nullif(F.trim(label), F.lit("")), F.lit(blank))
    g = df.groupBy(name.alias("label")).agg(F.sum(amount).alias("n"))
    return g.select("label", as_double(F.col("n")).alias(out), ratio(F.col("n"), F.sum("n").over(Window.partitionBy()), 100).alias("share_percent")).orderBy(F.desc(out), "label")


def operating_costs(shelf: Shelf, period: str | None = None) -> DataFrame:
    return by_label(shelf["operating_costs"].filter(in_month(period)), "cost_category", "amount_vnd", "amount", "Chưa phân loại")


#: Fixed: the kinds of stock movements that a summary names, and what one without a kind is called.
MOVEMENTS, NO_MOVEMENT = {"inbound": "nhập kho", "outbound": "bán ra", "damaged": "hàng lỗi/hủy"}, "chưa phân loại"


def inventory_movements(shelf: Shelf, period: str | None = None) -> DataFrame:
    kind = F.lower(F.trim("movement_type"))
    of = lambda k: F.coalesce(F.sum(F.when(kind == MOVEMENTS[k], F.col("quantity"))), F.lit(0)).cast("long").alias(k)
    return shelf["inventory_movements"].filter(in_period("movement_date", period)).agg(F.count("*").alias("movement_count"), of("inbound"), of("outbound"), of("damaged"))


def movements_by_type(shelf: Shelf, period: str | None = None) -> DataFrame:
    kind = F.coalesce(F.nullif(F.lower(F.trim("movement_type")), F.lit("")), F.lit(NO_MOVEMENT))
    m = shelf["inventory_movements"].filter(in_period("movement_date", period)).groupBy(kind.alias("movement_type")).agg(F.sum("quantity").cast("long").alias("units"))
    return m.orderBy(F.desc("units"), "movement_type")


def quality_summary(shelf: Shelf, period: str | None = None) -> DataFrame:
    q = shelf["quality_checks"].filter(in_period("check_date", period)).agg(F.count("*").alias("check_count"), total("inspected_quantity").cast("long").alias("inspected"), total("defective_quantity").cast("long").alias("defective"))
    return q.withColumn("defect_rate_percent", ratio(F.col("defective"), F.col("inspected"), 100))


def defects_by_type(shelf: Shelf, period: str | None = None) -> DataFrame:
    q = shelf["quality_checks"].filter(in_period("check_date", period) & (F.col("defective_quantity") > 0))
    return q.groupBy("defect_type").agg(F.sum("defective_quantity").cast("long").alias("defective")).orderBy(F.desc("defective"), "defect_type")


def cash_flow_summary(shelf: Shelf, period: str | None = None) -> DataFrame:
    of = lambda d: F.coalesce(F.sum(F.when(F.lower(F.trim("direction")) == d, F.col("amount_vnd"))), F.lit(0))
    c = shelf["cash_flow"].filter(in_period("date", period)).agg(of("thu").alias("i"), of("chi").alias("o"))
    return c.select(as_double(F.col("i")).alias("inflow"), as_double(F.col("o")).alias("outflow"), as_double(F.col("i") - F.col("o")).alias("net"))


def outflow_by_category(shelf: Shelf, period: str | None = None) -> DataFrame:
    return by_label(shelf["cash_flow"].filter(in_period("date", period) & (F.lower(F.trim("direction")) == "chi")), "category", "amount_vnd", "amount", "Chưa phân loại")


def supplier_ranking(shelf: Shelf, period: str | None = None) -> DataFrame:
    """Suppliers from best to worst, with flags for the lowest punctuality and the longest lead time."""
    s = shelf["supplier_performance"].filter(in_month(period))
    order = [F.desc("on_time_delivery_rate_percent"), F.asc("defect_rate_percent"), F.asc("average_lead_time_days"), F.asc("supplier_id")]
    s = numbered(s, [], order)
    best = s.agg(F.min_by("position", F.struct("on_time_delivery_rate_percent", "position")).alias("late"), F.min_by("position", F.struct(-F.col("average_lead_time_days"), F.col("position"))).alias("slow"))
    return s.crossJoin(F.broadcast(best)).select(
        "position", "supplier_id", "supplier_name", "on_time_delivery_rate_percent", "defect_rate_percent", "average_lead_time_days",
        (F.col("position") == F.col("late")).alias("least_punctual"), (F.col("position") == F.col("slow")).alias("slowest"),
    )


def customer_retention(shelf: Shelf, period: str | None = None) -> DataFrame:
    """Customers of segments named as returning count as such, also where the name goes on to deny it."""
    returning = F.lower("segment_name").contains("quay lại")
    s = shelf["customer_segments"].filter(in_month(period)).agg(
        total("customer_count").cast("long").alias("customers"), total(F.when(returning, F.col("customer_count"))).cast("long").alias("returning_customers"),
        total("order_count").cast("long").alias("orders"), total("repeat_order_count").cast("long").alias("repeat_orders"), total("gmv_vnd").alias("g"),
    )
    return s.select("customers", "returning_customers", "orders", "repeat_orders", as_double(F.col("g")).alias("gmv"), ratio(F.col("repeat_orders"), F.col("orders"), 100).alias("repeat_rate_percent"))


def product_funnel(shelf: Shelf, period: str | None = None) -> DataFrame:
    """Rates of each funnel row; which row is weak from cart to order, and, among the much viewed, from view to cart."""
    f = named(shelf["product_funnel"].filter(in_month(period)), shelf)
    f = f.withColumns({"view_to_cart_percent": ratio(F.col("add_to_cart_count"), F.col("views"), 100), "cart_to_order_percent": ratio(F.col("order_count"), F.col("add_to_cart_count"), 100)})
    median = f.agg(F.percentile("views", F.lit(0.5)).alias("median_views"))
    f = f.crossJoin(F.broadcast(median))
    enough, much = F.col("views") >= 20, F.col("views") >= F.col("median_views")
    # The weakest row of each kind is a smallest struct, found by partial sums; it goes back as one row.
    row = F.struct("sku", "month")
    cart = F.struct(F.coalesce("cart_to_order_percent", F.lit(0.0)).alias("a"), F.col("views").alias("b"), row.alias("r"))
    view = F.struct(F.col("view_to_cart_percent").isNull().alias("n"), F.col("view_to_cart_percent").alias("a"), (-F.col("views")).alias("b"), row.alias("r"))
    weak = f.agg(F.min(F.when(enough, cart))["r"].alias("weak_cart"), F.min(F.when(much, view))["r"].alias("weak_view"))
    return f.crossJoin(F.broadcast(weak)).select(
        "month", "sku", "product_name", "views", F.col("add_to_cart_count").alias("carts"), F.col("order_count").alias("orders"), "view_to_cart_percent", "cart_to_order_percent", "median_views",
        F.coalesce(enough & (row == F.col("weak_cart")), F.lit(False)).alias("weak_cart_to_order"), F.coalesce(much & (row == F.col("weak_view")), F.lit(False)).alias("weak_view_to_cart"),
    )


def funnel_totals(shelf: Shelf, period: str | None = None) -> DataFrame:
    t = shelf["product_funnel"].filter(in_month(period)).agg(F.countDistinct("sku").alias("products"), *(total(c).cast("long").alias(n) for n, c in (("views", "views"), ("carts", "add_to_cart_count"), ("orders", "order_count"))))
    return t.withColumns({"view_to_cart_percent": ratio(F.col("carts"), F.col("views"), 100), "cart_to_order_percent": ratio(F.col("orders"), F.col("carts"), 100)})


def co_purchases(shelf: Shelf, period: str | None = None, top: int = 10) -> DataFrame:
    """Pairs bought together, of known products: those with stock first."""
    best = _best_pairs(shelf, period, top)
    p = products(shelf)
    side = lambda s, key: p.select(F.col("sku").alias(key), F.col("product_name").alias(f"{s}_name"), F.col("unit_cost").alias(f"{s}_cost"), F.col("list_price").alias(f"{s}_price"))
    stock = lambda s, key: shelf["inventory"].select(F.col("sku").alias(key), (F.col("on_hand") - F.col("reserved")).alias(f"{s}_stock"))
    c = best.join(side("a", "sku"), "sku").join(side("b", "paired_sku"), "paired_sku")
    c = c.join(stock("a", "sku"), "sku", "left").join(stock("b", "paired_sku"), "paired_sku", "left")
    price, cost = F.col("a_price") + F.col("b_price"), F.col("a_cost") + F.col("b_cost")
    least = F.when(F.col("a_stock").isNotNull() & F.col("b_stock").isNotNull(), F.least("a_stock", "b_stock"))
    c = c.withColumns({"combined_price": as_double(price), "combined_cost": as_double(cost), "trial_price": as_double(price * F.lit(95) / F.lit(100)), "least_stock": least})
    order = [least.isNull().cast("int"), (F.coalesce(least, F.lit(0)) <= 0).cast("int"), F.desc("joint_order_count"), F.asc("sku"), F.asc("paired_sku"), F.asc("month")]
    return c.orderBy(*order).limit(top).select("month", "sku", "paired_sku", "a_name", "b_name", "joint_order_count", "combined_price", "combined_cost", "trial_price", "least_stock")


def _best_pairs(shelf: Shelf, period: str | None, top: int) -> DataFrame:
    """month, sku, paired_sku, joint_order_count of the pairs that the first `top` rows are among. Pairs meet no more than
    whether their products are known and in stock: names and prices are for the few that are shown. The table may come in
    parts, one after the other. Once enough pairs in stock are known, pairs of fewer orders can't be among the first, and
    go before they meet anything; the pairs of most orders are looked at first for that."""
    spark = shelf["inventory"].sparkSession
    stock = F.col("on_hand") - F.col("reserved")
    state = F.when(stock.isNull(), 2).when(stock <= 0, 1).otherwise(0)
    known = products(shelf).select("sku").distinct().join(shelf["inventory"], "sku", "left").select("sku", state.alias("state")).distinct()
    of = lambda key, name: known.select(F.col("sku").alias(key), F.col("state").alias(name))
    names, by_count = ["month", "sku", "paired_sku", "joint_order_count"], [F.desc("joint_order_count"), "sku", "paired_sku", "month"]
    rows, least, schema = [], None, None

    def met(c: DataFrame) -> DataFrame:
        return c.join(of("sku", "_a"), "sku").join(of("paired_sku", "_b"), "paired_sku").select(*names, F.greatest("_a", "_b").alias("state")).distinct().orderBy("state", *by_count).limit(top)

    in_parts = hasattr(shelf, "parts_of")
    for part in shelf.parts_of("co_purchase") if in_parts else [shelf["co_purchase"]]:
        c = part.filter(in_month(period)).select(*names)
        if least is None:
            c = settled(c)
        for some in (c.orderBy(*by_count).limit(100 * top), c) if least is None else (c,):
            found = met(some if least is None else some.filter(F.col("joint_order_count") >= least))
            schema = schema or found.schema
            with without_shuffles(spark):
                rows = spark.createDataFrame(rows + found.collect(), schema).distinct().orderBy("state", *by_count).limit(top).collect()
            if rows and len(rows) == top and rows[-1]["state"] == 0:
                least = rows[-1]["joint_order_count"]
    best = spark.createDataFrame(rows, schema).drop("state").distinct()
    if in_parts:
        return best
    # A table that is given may say a row twice.
    table = shelf["co_purchase"]
    return table.join(F.broadcast(best), reduce(Column.__and__, (table[c].eqNullSafe(best[c]) for c in names)), "left_semi").select(*names)


def price_promotions(shelf: Shelf, period: str | None = None) -> DataFrame:
    p = shelf["price_promotions"].filter(in_period("date", period)).groupBy("sku").agg(
        F.count("*").alias("rows"), F.sum("list_price_vnd").alias("l"), F.sum("final_price_vnd").alias("f"), F.sum("seller_discount_vnd").alias("d"),
        F.array_join(F.sort_array(F.collect_set(F.nullif(F.trim("voucher_source"), F.lit("")))), "|").alias("voucher_sources"),
    )
    return named(p, shelf).select(
        "sku", "product_name", "rows", ratio(F.col("l"), F.col("rows")).alias("average_list_price"), ratio(F.col("f"), F.col("rows")).alias("average_final_price"),
        ratio(F.col("d"), F.col("rows")).alias("average_seller_discount"), ratio(F.col("l") - F.col("f"), F.col("l"), 100).alias("discount_percent"), "voucher_sources",
    ).orderBy(F.desc_nulls_last("discount_percent"), "sku")


def ads_by_sku(shelf: Shelf, period: str | None = None) -> DataFrame:
    a = shelf["ads_sku_daily"].filter(in_period("date", period)).groupBy("sku").agg(
        *(F.sum(c).cast("long").alias(n) for n, c in (("impressions", "impressions"), ("clicks", "clicks"), ("carts", "add_to_cart_count"), ("orders", "attributed_orders"))),
        F.sum("spend_vnd").alias("s"), F.sum("attributed_revenue_vnd").alias("r"),
    )
    return named(a, shelf).select(
        "sku", "product_name", "impressions", "clicks", "carts", "orders", as_double(F.col("s")).alias("spend"), as_double(F.col("r")).alias("revenue"),
        ratio(F.col("clicks"), F.col("impressions"), 100).alias("ctr_percent"), ratio(F.col("carts"), F.col("clicks"), 100).alias("click_to_cart_percent"), ratio(F.col("r"), F.col("s")).alias("roas"),
    ).orderBy(F.desc_nulls_last("roas"), F.desc("revenue"), "sku")


def batch_ages(shelf: Shelf, as_of: date, top: int = 20) -> DataFrame:
    b = named(shelf["inventory_batches"], shelf).withColumn("age_days", F.greatest(F.datediff(F.lit(as_of), "received_date"), F.lit(0)).cast("long"))
    return b.select("batch_id", "sku", "product_name", "available_units", "age_days").orderBy(F.desc("age_days"), F.desc("available_units"), "batch_id").limit(top)


def _terms(shelf: Shelf, period: str | None) -> DataFrame:
    s = shelf["search_performance"].filter(in_period("date", period)).groupBy("search_term").agg(
        F.sum("impressions").cast("long").alias("impressions"), F.sum("clicks").cast("long").alias("clicks"),
        (F.sum(F.col("average_position").cast("decimal(18,4)")).cast("double") / F.count("average_position")).alias("average_position"), F.countDistinct("sku").alias("skus"),
    )
    s = s.withColumn("ctr_percent", ratio(F.col("clicks"), F.col("impressions"), 100))
    # Terms are compared by what a report shows: two places.
    return s.withColumns({"_position": F.round("average_position", 2), "_ctr": F.round("ctr_percent", 2)})


def search_terms(shelf: Shelf, period: str | None = None) -> DataFrame:
    """All terms: those with most clicks first, then those found higher up."""
    return _terms(shelf, period).orderBy(F.desc("clicks"), "_position", "search_term").drop("_position", "_ctr")


def search_leaders(shelf: Shelf, period: str | None = None) -> DataFrame:
    """The terms with most impressions, most clicks, the best rate and the best position; what settles ties differs."""
    best = lambda pick, *order: pick("search_term", F.struct(*order))
    term, clicks, position = F.col("search_term"), F.col("clicks"), F.col("_position")
    return _terms(shelf, period).agg(
        best(F.max_by, F.col("impressions"), clicks, term).alias("most_seen"), best(F.min_by, -clicks, position, term).alias("most_clicked"),
        F.max_by("search_term", F.when(F.col("_ctr").isNotNull(), F.struct(F.col("_ctr"), clicks, -position, term))).alias("best_rate"), best(F.min_by, position, -clicks, term).alias("best_position"),
    )


#: Fixed: states of orders that are cancelled, and of settlements that are done, in header form; a reason that none gave.
CANCELLED, SETTLED, NO_REASON = ("huy", "cancelled", "canceled", "da_huy"), ("da_nhan", "received", "completed", "hoan_tat"), "Chưa ghi lý do"


def _cancelled() -> Column:
    return F.coalesce(header_form(F.col("status")).isin(*CANCELLED), F.lit(False))


def shipping_summary(shelf: Shelf, period: str | None = None) -> DataFrame:
    s = shelf["shipping_performance"].filter(in_period("order_date", period))
    summary = s.agg(F.count("*").alias("order_count"), F.count_if("is_late").alias("late"), F.count_if(_cancelled()).alias("cancelled"), (F.sum(F.col("processing_hours").cast("decimal(18,4)")).cast("double") / F.count("processing_hours")).alias("average_hours"))
    top = cancellation_reasons(shelf, period).agg(F.min_by(F.struct("reason", "orders"), F.struct(-F.col("orders"), F.col("reason"))).alias("t"))
    return summary.crossJoin(F.broadcast(top)).select("order_count", "late", "cancelled", "average_hours", F.col("t.reason").alias("top_reason"), F.coalesce("t.orders", F.lit(0)).alias("top_reason_orders"))


def cancellation_reasons(shelf: Shelf, period: str | None = None) -> DataFrame:
    s = shelf["shipping_performance"].filter(in_period("order_date", period) & _cancelled())
    reason = F.coalesce(F.nullif(F.trim("cancellation_reason"), F.lit("")), F.lit(NO_REASON))
    return s.groupBy(reason.alias("reason")).agg(F.count("*").alias("orders")).orderBy(F.desc("orders"), "reason")


def settlement_summary(shelf: Shelf, period: str | None = None) -> DataFrame:
    """Whatever isn't settled in so many words is pending."""
    open_ = ~F.coalesce(header_form(F.col("status")).isin(*SETTLED), F.lit(False))
    s = shelf["settlements"].filter(in_period("settlement_date", period)).agg(F.count("*").alias("settlement_count"), total("marketplace_payable_vnd").alias("p"), total("actual_fee_vnd").alias("f"), total("received_amount_vnd").alias("r"), F.count_if(open_).alias("pending"))
    expected = F.col("p") - F.col("f")
    return s.select("settlement_count", as_double(F.col("p")).alias("payable"), as_double(F.col("f")).alias("fees"), as_double(expected).alias("expected"), as_double(F.col("r")).alias("received"), as_double(F.col("r") - expected).alias("difference"), "pending")


def competitor_summary(shelf: Shelf, period: str | None = None) -> DataFrame:
    """The upper median of all prices, and the true medians over listings of own products."""
    c = shelf["competitor_catalog"].filter(in_period("observed_date", period))
    # Prices are counted before they are summed up, and the running sums lie over many tasks.
    counts = c.groupBy("price_vnd").agg(F.count("*").alias("n"))
    sums = running(counts, [], [F.col("price_vnd")], {"upto": F.col("n")})
    all_of = c.agg(F.count("*").alias("listing_count"))
    middle = F.floor(F.col("listing_count") / 2) + 1
    upper = sums.crossJoin(F.broadcast(all_of)).agg(F.min(F.when(F.col("upto") >= middle, F.col("price_vnd"))).cast("double").alias("upper_median_price"))
    matched = c.join(products(shelf).select(F.col("sku").alias("reference_sku"), "list_price"), "reference_sku")
    median = lambda x: F.percentile(x.cast("double"), F.lit(0.5))
    m = matched.agg(F.count("*").alias("matched"), median(F.col("price_vnd")).alias("matched_median"), median(F.col("list_price")).alias("own_median"), median(F.col("price_vnd") - F.col("list_price")).alias("median_difference"))
    return all_of.crossJoin(F.broadcast(upper)).crossJoin(F.broadcast(m))


def competitor_listings(shelf: Shelf, period: str | None = None, top: int = 20) -> DataFrame:
    """The listings that sell most, then the better rated, then the cheaper; ties by shop and product."""
    c = shelf["competitor_catalog"].filter(in_period("observed_date", period))
    order = [F.desc("estimated_monthly_units"), F.desc("rating"), F.asc("price_vnd"), F.asc("competitor_shop"), F.asc("reference_sku"), F.asc("observed_date")]
    return c.select("reference_sku", "competitor_shop", F.col("price_vnd").cast("double").alias("price"), "rating", "estimated_monthly_units", "observed_date", "price_vnd").orderBy(*order).limit(top).drop("price_vnd")


def returns_summary(shelf: Shelf, period: str | None = None) -> DataFrame:
    r = shelf["returns"].filter(in_period("request_date", period)).agg(F.count("*").alias("requests"), total("quantity").cast("long").alias("units"), total("refund_amount_vnd").alias("a"))
    return r.select("requests", "units", as_double(F.col("a")).alias("refunds"))


def returns_by_reason(shelf: Shelf, period: str | None = None) -> DataFrame:
    r = shelf["returns"].filter(in_period("request_date", period)).groupBy("reason").agg(F.sum("quantity").cast("long").alias("units"))
    return r.orderBy(F.desc("units"), "reason")


def review_summary(shelf: Shelf, period: str | None = None) -> DataFrame:
    r = shelf["reviews"].filter(in_period("review_date", period))
    return r.agg(F.count("*").alias("reviews"), ratio(F.sum("rating"), F.count("rating")).alias("average_rating"), F.count_if(F.col("rating") <= 3).alias("low_ratings"))


#: Fixed: what a review that names no issue is about.
NO_ISSUE = "Không nêu vấn đề"


def review_issues(shelf: Shelf, period: str | None = None) -> DataFrame:
    issue = F.coalesce(F.nullif(F.trim("issue_type"), F.lit("")), F.lit(NO_ISSUE))
    r = shelf["reviews"].filter(in_period("review_date", period)).groupBy(issue.alias("issue_type")).agg(F.count("*").alias("reviews"), F.count_if(F.col("rating") <= 3).alias("low_ratings"))
    return r.orderBy(F.desc("reviews"), "issue_type")


def review_priority(shelf: Shelf, period: str | None = None) -> DataFrame:
    """The issue that most low ratings name, and how many low ratings name none."""
    low = shelf["reviews"].filter(in_period("review_date", period) & (F.col("rating") <= 3))
    issue = F.coalesce(F.trim("issue_type"), F.lit(""))
    by = low.groupBy(issue.alias("issue")).agg(F.count("*").alias("n"))
    named_issue = F.when(F.col("issue") != "", F.struct(-F.col("n"), F.col("issue")))
    return by.agg(F.min_by("issue", named_issue).alias("priority_issue"), F.coalesce(F.sum(F.when(F.col("issue") == "", F.col("n"))), F.lit(0)).alias("unclassified"))


def procurement_summary(shelf: Shelf, period: str | None = None) -> DataFrame:
    p = shelf["purchase_orders"].filter(in_period("order_date", period))
    is_open = ~F.lower(F.trim("status")).isin("received", "cancelled")
    value = (F.col("quantity") * F.col("unit_cost_vnd")).cast("decimal(28,4)")
    s = p.agg(F.count("*").alias("purchase_orders"), F.count_if(is_open).alias("open_orders"), total(F.when(is_open, F.col("quantity"))).cast("long").alias("open_units"), total(F.when(is_open, value)).alias("v"))
    return s.select("purchase_orders", "open_orders", "open_units", as_double(F.col("v")).alias("open_value"))


def scorecard(shelf: Shelf, period: str | None = None) -> DataFrame:
    """Every product with what is known of it: sales, stock, reviews, quality, returns and funnel; risks and gaps.

    Each side is summed by sku before it is joined. Gaps are missing evidence, not low risk: a product with gaps is never
    recommended. The lowest contribution is that of all products (0 where none was sold), and a signal if it was sold."""
    sales = contributions(shelf, period).select("sku", "units", "gmv", "contribution")
    stock = shelf["inventory"].select("sku", (F.col("on_hand") - F.col("reserved")).alias("available"), "reorder_point")
    reviews = shelf["reviews"].filter(in_period("review_date", period)).groupBy("sku").agg(F.count("*").alias("reviews"), F.count_if(F.col("rating") <= 3).alias("low_ratings"))
    quality = shelf["quality_checks"].filter(in_period("check_date", period)).groupBy("sku").agg(F.sum("defective_quantity").alias("defective"), F.sum("inspected_quantity").alias("inspected"))
    returned = shelf["returns"].filter(in_period("request_date", period)).groupBy("sku").agg(F.sum("quantity").alias("returned"))
    funnel = shelf["product_funnel"].filter(in_month(period)).groupBy("sku").agg(F.sum("views").alias("views"), F.sum("add_to_cart_count").alias("carts"))
    s = shelf["products"].select("sku", "product_name")
    for side in (sales, stock, reviews, quality, returned, funnel):
        s = s.join(side, "sku", "left")
    zero = F.lit(0).cast("decimal(28,4)")
    s = s.withColumns({"sold": F.coalesce("units", F.lit(0)) > 0, "gmv": F.coalesce("gmv", zero), "contribution": F.coalesce("contribution", zero)})
    # One-row results go out by broadcast, so that no window gathers all products.
    low = s.agg(F.min(F.struct("contribution", "sku"))["sku"].alias("low_sku"))
    s = s.crossJoin(F.broadcast(low))
    scarce = F.col("available") <= F.col("reorder_point")
    signals = F.array_compact(F.array(
        F.when(F.col("sold") & (F.col("low_sku") == F.col("sku")), "lowest_contribution"), F.when(scarce, "low_stock"), F.when(F.col("low_ratings") > 0, "low_rating"),
        F.when(F.col("defective") > 0, "defect"), F.when(F.col("returned") > 0, "returned"),
    ))
    gaps = F.array_compact(F.array(F.when(F.col("reviews").isNull(), "review"), F.when(F.col("defective").isNull(), "quality"), F.when(F.col("views").isNull(), "funnel")))
    s = s.withColumns({"risk_signals": F.array_join(signals, "|"), "signal_count": F.size(signals).cast("long"), "evidence_gaps": F.array_join(gaps, "|")})
    eligible = (F.col("gmv") > 0) & (F.col("contribution") > 0) & ~F.coalesce(scarce, F.lit(False)) & (F.col("evidence_gaps") == "") & (F.col("signal_count") == 0)
    best = s.filter(eligible).orderBy(F.desc("gmv"), F.desc("contribution"), "sku").limit(1).select("sku", F.lit(True).alias("best"))
    risky = s.filter("signal_count > 0").orderBy(F.desc("signal_count"), "contribution", F.desc("gmv"), "sku").limit(3).select("sku", F.lit(True).alias("risky"))
    s = s.join(F.broadcast(best), "sku", "left").join(F.broadcast(risky), "sku", "left")
    return s.select(
        "sku", "product_name", F.coalesce("units", F.lit(0)).alias("units"), as_double(F.col("gmv")).alias("gmv"), as_double(F.col("contribution")).alias("contribution"),
        F.coalesce("low_ratings", F.lit(0)).alias("low_ratings"), ratio(F.col("defective"), F.col("inspected"), 100).alias("defect_rate_percent"), F.col("views").cast("long").alias("views"), ratio(F.col("carts"), F.col("views"), 100).alias("view_to_cart_percent"),
        "risk_signals", "signal_count", "evidence_gaps", F.coalesce("best", F.lit(False)).alias("recommended"), F.coalesce("risky", F.lit(False)).alias("top_risk"),
    )


def available_periods(shelf: Shelf) -> DataFrame:
    return shelf["orders"].select(month_of("order_date").alias("month")).distinct().orderBy("month")


def profit_after_overhead(shelf: Shelf, period: str | None = None) -> DataFrame:
    cost = shelf["operating_costs"].filter(in_month(period)).agg(total("amount_vnd").cast("double").alias("overhead"))
    return profitability_summary(shelf, period).crossJoin(cost).select("contribution", "overhead", (F.col("contribution") - F.col("overhead")).alias("profit"))
