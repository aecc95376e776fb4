"""The shelf's tables bound to a star schema of orders, parts, suppliers, customers and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settled

#: Pairs of parts that are counted at once.
PAIRS_AT_ONCE = 30_000_000


class Star(dict):
    """Reads a bound table when it is asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")

    def __missing__(self, table: str) -> DataFrame:
        self[table] = df = getattr(self, f"_{table}")()
        return df

    @staticmethod
    def _dec(c: str | Column, scale: int = 2) -> Column:
        return (F.col(c) if isinstance(c, str) else c).cast(f"decimal(18,{scale})")

    def _lines(self) -> DataFrame:
        """Line items with their order. Both sides are large: Spark shuffles on the order key unless one is small."""
        o = self.raw("orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("order_date"), "o_orderstatus", "o_orderpriority")
        li = self.raw("lineitem").withColumn("ship_date", F.col("l_shipdate").cast("date"))
        return li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))

    def _orders(self) -> DataFrame:
        price = self._dec("l_extendedprice")
        status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "shipping").otherwise("pending")
        four = lambda c: c.cast("decimal(18,4)")
        return self["lines"].select(
            F.col("l_orderkey").alias("order_id"), "order_date", status.alias("status"), F.col("l_partkey").alias("sku"), F.col("l_quantity").cast("long").alias("quantity"), four(price).alias("gross_merchandise_value_vnd"),
            four(price * self._dec("l_discount")).alias("seller_discount_vnd"), four(price * F.lit("0.01").cast("decimal(4,2)")).alias("platform_discount_vnd"),
            four(price * self._dec("l_tax")).alias("estimated_transaction_fee_vnd"), four(price * F.lit("0.02").cast("decimal(4,2)")).alias("estimated_service_fee_vnd"),
        )

    def _products(self) -> DataFrame:
        price = self._dec("p_retailprice")
        return self.raw("part").select(F.col("p_partkey").alias("sku"), F.col("p_name").alias("product_name"), F.col("p_type").alias("category"), (price * F.lit("0.6").cast("decimal(4,2)")).cast("decimal(18,4)").alias("cost_per_unit_vnd"), price.cast("decimal(18,4)").alias("list_price_vnd"))

    def _inventory(self) -> DataFrame:
        return self.raw("part").select(F.col("p_partkey").alias("sku"), F.col("p_size").cast("long").alias("on_hand"), (F.col("p_partkey") % 7).alias("reserved"), F.lit(12).cast("long").alias("reorder_point"))

    def _purchase_orders(self) -> DataFrame:
        status = F.when(F.col("l_linestatus") == "O", "ordered").when(F.col("l_returnflag") == "R", "cancelled").otherwise("received")
        return self["lines"].select(F.col("l_orderkey").alias("purchase_order_id"), "order_date", F.col("l_suppkey").alias("supplier_name"), F.col("l_partkey").alias("sku"), F.col("l_quantity").cast("long").alias("quantity"), self._dec("l_extendedprice").alias("unit_cost_vnd"), F.col("ship_date").alias("expected_arrival_date"), status.alias("status"))

    def _returns(self) -> DataFrame:
        return self["lines"].filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("order_id"), F.col("ship_date").alias("request_date"), F.col("l_partkey").alias("sku"), F.col("l_quantity").cast("long").alias("quantity"), F.col("o_orderpriority").alias("reason"), self._dec("l_extendedprice").alias("refund_amount_vnd"))

    def _quality_checks(self) -> DataFrame:
        bad = F.when(F.col("l_returnflag") == "R", F.col("l_quantity").cast("long")).otherwise(F.lit(0))
        return self["lines"].select(F.col("ship_date").alias("check_date"), F.col("l_partkey").alias("sku"), F.col("l_quantity").cast("long").alias("inspected_quantity"), bad.alias("defective_quantity"), F.col("o_orderpriority").alias("defect_type"))

    def _reviews(self) -> DataFrame:
        rated = self.raw("events").filter(F.col("value").isNotNull())
        return rated.select(F.col("ts").cast("date").alias("review_date"), F.col("user_id").alias("sku"), (F.col("event_id") % 5 + 1).alias("rating"), F.when(F.col("event_id") % 7 != 0, F.col("event_type")).otherwise(" ").alias("issue_type"))

    def _operating_costs(self) -> DataFrame:
        e = self.raw("events")
        return e.select(F.date_format("ts", "yyyy-MM").alias("month"), F.col("event_type").alias("cost_category"), self._dec(F.floor(F.col("value") * 100).cast("decimal(18,0)") / F.lit(100)).alias("amount_vnd"))

    def _inventory_movements(self) -> DataFrame:
        kind = F.when(F.col("l_returnflag") == "R", "Hàng lỗi/hủy").when(F.col("l_linestatus") == "O", "Nhập kho").when(F.col("l_linenumber") == 7, " ").otherwise(" bán ra ")
        return self["lines"].select(F.col("ship_date").alias("movement_date"), F.col("l_partkey").alias("sku"), kind.alias("movement_type"), F.col("l_quantity").cast("long").alias("quantity"))

    def _cash_flow(self) -> DataFrame:
        return self["lines"].select(F.col("order_date").alias("date"), F.when(F.col("l_linestatus") == "O", "thu").otherwise("chi").alias("direction"), F.col("o_orderpriority").alias("category"), self._dec("l_extendedprice").alias("amount_vnd"))

    def _supplier_performance(self) -> DataFrame:
        lead = F.greatest(F.datediff("ship_date", "order_date"), F.lit(0))
        n = F.count("*").cast("double")
        return self["lines"].groupBy(F.col("l_suppkey").alias("supplier_id")).agg(
            F.lit("all").alias("month"), (F.count_if(lead <= 60) * 100.0 / n).alias("on_time_delivery_rate_percent"), (F.count_if(F.col("l_returnflag") == "R") * 100.0 / n).alias("defect_rate_percent"),
            (F.sum(lead).cast("double") / n).alias("average_lead_time_days"), F.count("*").alias("order_count"),
        ).join(self.raw("supplier").select(F.col("s_suppkey").alias("supplier_id"), F.col("s_name").alias("supplier_name")), "supplier_id")

    def _customer_segments(self) -> DataFrame:
        o = self.raw("orders").select("o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"), self._dec("o_totalprice").alias("price"))
        by = o.groupBy("month", "o_custkey").agg(F.count("*").alias("n"), F.sum("price").alias("gmv"))
        c = self.raw("customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
        name = F.when(F.col("n") > 1, F.concat("c_mktsegment", F.lit(" Quay lại"))).otherwise(F.col("c_mktsegment"))
        return by.join(c, "o_custkey").groupBy("month", name.alias("segment_name")).agg(F.count("*").alias("customer_count"), F.sum("n").alias("order_count"), F.sum(F.col("n") - 1).alias("repeat_order_count"), F.sum("gmv").alias("gmv_vnd"))

    def _product_funnel(self) -> DataFrame:
        of = lambda t: F.count_if(F.col("event_type") == t)
        return self.raw("events").groupBy(F.date_format("ts", "yyyy-MM").alias("month"), F.col("user_id").alias("sku")).agg(of("view").alias("views"), of("click").alias("add_to_cart_count"), of("purchase").alias("order_count"))

    def _baskets(self) -> DataFrame:
        """Orders' parts, each once, as one row for each order: an order has few lines. Written, and what was shuffled goes."""
        date = F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM").alias("month")
        months = self.raw("orders").groupBy(F.col("o_orderkey").alias("l_orderkey")).agg(F.collect_set(F.struct(date)).alias("months"))
        parts = self.raw("lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_partkey")).alias("skus"))
        return settled(parts.filter(F.size("skus") > 1).join(months, "l_orderkey").select("months", "skus"))

    def _pairs(self, part: int = 0, parts: int = 1) -> DataFrame:
        """month, sku, paired_sku, joint_order_count of the pairs whose first part falls to this part of all."""
        baskets = self["baskets"].select(F.explode("months").alias("m"), F.size("months").alias("n"), "skus").select("m.month", "n", "skus", F.posexplode("skus").alias("at", "sku"))
        mine = baskets.filter(F.pmod(F.xxhash64("sku"), F.lit(parts)) == part) if parts > 1 else baskets
        pairs = mine.select("month", "n", "sku", F.explode(F.slice("skus", F.col("at") + 2, F.size("skus"))).alias("paired_sku"))
        return pairs.groupBy("month", "sku", "paired_sku").agg(F.sum("n").alias("joint_order_count"))

    def _co_purchase(self) -> DataFrame:
        """Pairs of parts of one order."""
        return self._pairs()

    def parts_of(self, table: str) -> list[DataFrame]:
        """A table as parts of a bounded number of rows before they are grouped, which together are the table."""
        if table != "co_purchase":
            return [self[table]]
        n = F.size("skus").cast("long")
        pairs = self["baskets"].agg(F.sum(F.size("months") * n * (n - 1) / 2).alias("n")).first()["n"] or 0
        parts = max(1, -(-int(pairs) // PAIRS_AT_ONCE))
        return [self._pairs(i, parts) for i in range(parts)]

    def _price_promotions(self) -> DataFrame:
        price = self._dec("l_extendedprice")
        off = (price * self._dec("l_discount")).cast("decimal(18,4)")
        return self["lines"].filter("l_discount > 0").select(F.col("order_date").alias("date"), F.col("l_partkey").alias("sku"), price.cast("decimal(18,4)").alias("list_price_vnd"), (price - off).cast("decimal(18,4)").alias("final_price_vnd"), off.alias("seller_discount_vnd"), F.col("o_orderpriority").alias("voucher_source"))

    def _cents(self) -> Column:
        return (F.floor(F.col("value") * 100).cast("decimal(18,0)") / F.lit(100)).cast("decimal(18,4)")

    def _ads_sku_daily(self) -> DataFrame:
        of = lambda t: (F.col("event_type") == t).cast("long")
        paid = lambda t: F.when(F.col("event_type") == t, self._cents()).otherwise(F.lit(0)).cast("decimal(18,4)")
        return self.raw("events").select(F.col("ts").cast("date").alias("date"), F.col("user_id").alias("sku"), of("view").alias("impressions"), of("click").alias("clicks"), paid("click").alias("spend_vnd"), of("signup").alias("add_to_cart_count"), of("purchase").alias("attributed_orders"), paid("purchase").alias("attributed_revenue_vnd"))

    def _ads(self) -> DataFrame:
        d = self["ads_sku_daily"].withColumn("month", F.date_format("date", "yyyy-MM"))
        return d.groupBy("month", (F.col("sku") % 5).alias("campaign_id")).agg(F.sum("spend_vnd").alias("spend_vnd"), F.sum("attributed_revenue_vnd").alias("attributed_revenue_vnd"), F.sum("attributed_orders").alias("orders"))

    def _inventory_batches(self) -> DataFrame:
        return self["lines"].groupBy(F.col("l_partkey").alias("sku"), F.col("ship_date").alias("received_date")).agg(F.sum("l_quantity").cast("long").alias("available_units")).withColumn("batch_id", F.concat_ws("/", F.col("sku").cast("string"), F.date_format("received_date", "yyyy-MM-dd")))

    def _search_performance(self) -> DataFrame:
        e = self.raw("events")
        return e.select(F.col("ts").cast("date").alias("date"), F.col("user_id").alias("sku"), F.concat("event_type", (F.col("user_id") % 20).cast("string")).alias("search_term"), (F.col("event_id") % 9 + 1).alias("impressions"), (F.col("event_id") % 3).alias("clicks"), ((F.col("event_id") % 50) / F.lit(4.0)).alias("average_position"))

    def _shipping_performance(self) -> DataFrame:
        days = F.datediff("ship_date", "order_date")
        return self["lines"].select(F.col("l_orderkey").alias("order_id"), "order_date", F.when(F.col("o_orderstatus") == "P", F.get(F.array(F.lit("Đã hủy"), F.lit("CANCELLED "), F.lit("hủy")), F.col("l_linenumber").cast("int") % 3)).otherwise("shipped").alias("status"), (days > 60).alias("is_late"), F.when(F.col("l_linenumber") != 1, F.col("o_orderpriority")).otherwise(" ").alias("cancellation_reason"), F.greatest(days, F.lit(0)).cast("double").alias("processing_hours"))

    def _settlements(self) -> DataFrame:
        price = self._dec("l_extendedprice")
        fee = (price * self._dec("l_tax")).cast("decimal(18,4)")
        return self["lines"].select(F.col("ship_date").alias("settlement_date"), price.cast("decimal(18,4)").alias("marketplace_payable_vnd"), fee.alias("actual_fee_vnd"), (price - fee - F.lit(1)).cast("decimal(18,4)").alias("received_amount_vnd"), F.when(F.col("l_linestatus") == "O", "pending").when(F.col("l_returnflag") == "R", "disputed").when(F.col("l_linenumber") % 2 == 0, "Đã nhận ").otherwise("Hoàn tất").alias("status"))

    def _competitor_catalog(self) -> DataFrame:
        return self["lines"].select(F.col("order_date").alias("observed_date"), (F.col("l_partkey") * 2).alias("reference_sku"), F.col("l_suppkey").alias("competitor_shop"), self._dec("l_extendedprice").cast("decimal(18,4)").alias("price_vnd"), (F.col("l_linenumber") % 5 + 0.5).cast("double").alias("rating"), F.col("l_quantity").cast("long").alias("estimated_monthly_units"))
