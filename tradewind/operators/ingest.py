"""Ingestion: header and value aliases, dates and months, typing, and validation of the shelf's tables.

A table comes in as strings. `prepare` maps headers and values and types the columns; `errors` lists the rows that
break a rule; `validate` raises on the first of them."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import header_form
from ..schemas import REQUIRED, SPARK_TYPES, TABLES

#: Fixed value aliases, by their folded form.
STATUS = {
    "hoan_tat": "completed", "hoan_thanh": "completed", "da_hoan_thanh": "completed", "completed": "completed", "huy": "cancelled", "da_huy": "cancelled", "cancelled": "cancelled",
    "canceled": "cancelled", "da_nhan": "received", "received": "received", "da_xac_nhan": "confirmed", "confirmed": "confirmed", "dang_xem_xet": "under_review", "under_review": "under_review",
}
DIRECTION = {"tien_thu": "thu", "thu": "thu", "tien_chi": "chi", "chi": "chi"}
MOVEMENT = {"nhap_kho": "Nhập kho", "ban_ra": "Bán ra", "hang_loi_huy": "Hàng lỗi/hủy"}
TRUE, FALSE = ("co", "yes", "true", "1"), ("khong", "no", "false", "0")
MOST_BYTES = 10 * 1024 * 1024


def mapped_headers(df: DataFrame, table: str, aliases: Mapping[str, str] | None = None) -> DataFrame:
    """Columns renamed by their folded form; two headers with one meaning, or a missing column, are errors."""
    forms = df.sparkSession.range(1).select(*(header_form(F.lit(c)).alias(f"c{i}") for i, c in enumerate(df.columns))).first()
    # The payable column is named after the marketplace that pays.
    named = lambda f: "marketplace_payable_vnd" if table == "settlements" and f.endswith("_payable_vnd") else f
    names = [(aliases or {}).get(f, named(f)) for f in forms]
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        raise ValueError(f"{table}: several columns mean {', '.join(repeated)}")
    missing = [c for c in TABLES[table] if c not in names]
    if missing:
        raise ValueError(f"{table}: missing columns {', '.join(missing)}")
    return df.toDF(*names)


def aliased(value: Column, aliases: Mapping[str, str]) -> Column:
    """The alias of a value's folded form, else the trimmed value."""
    table = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
    return F.coalesce(table[header_form(F.trim(value))], F.trim(value))


def to_date(value: Column) -> Column:
    """ISO dates (with or without hyphens), else month/day/year, else day/month/year; null where none fits."""
    v = F.trim(value)
    iso = F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(v, "yyyy-MM-dd")).when(v.rlike(r"^\d{8}$"), F.try_to_date(v, "yyyyMMdd"))
    slash = v.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$")
    return F.coalesce(iso, F.when(slash, F.try_to_date(v, "M/d/yyyy")), F.when(slash, F.try_to_date(v, "d/M/yyyy")))


def to_month(value: Column) -> Column:
    """YYYY-MM, M/YYYY, or the month of a date."""
    v = F.trim(value)
    parts = F.split(v, "/")
    swapped = F.concat_ws("-", F.get(parts, F.lit(1)), F.lpad(F.get(parts, F.lit(0)), 2, "0"))
    return F.when(v.rlike(r"^\d{4}-(0[1-9]|1[0-2])$"), v).when(v.rlike(r"^(0?[1-9]|1[0-2])/\d{4}$"), swapped).otherwise(F.date_format(to_date(v), "yyyy-MM"))


def to_boolean(value: Column) -> Column:
    v = header_form(F.trim(value))
    return F.when(v.isin(*TRUE), True).when(v.isin(*FALSE), False)


def typed(table: str, column: str) -> Column:
    """A raw column as its type; null where it doesn't fit. Blank money is 0."""
    kind, c = TABLES[table][column], F.trim(F.col(column))
    if kind == "d":
        return to_date(c)
    if kind == "M":
        return to_month(c)
    if kind == "b":
        return to_boolean(c)
    if kind == "m":
        return F.when(F.coalesce(c, F.lit("")) == "", F.lit(0)).otherwise(c.try_cast("decimal(18,4)")).cast(SPARK_TYPES["m"])
    if kind == "s":
        return c
    return c.try_cast(SPARK_TYPES[kind])


def not_blank(df: DataFrame) -> DataFrame:
    """Rows with anything in them."""
    return df.filter(F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in df.columns)).isNotNull())


def prepare(df: DataFrame, table: str, aliases: Mapping[str, str] | None = None) -> DataFrame:
    """The table with mapped headers and values, still as strings, other columns dropped."""
    df = not_blank(mapped_headers(df, table, aliases).select(*TABLES[table]))
    by_column = {"status": STATUS} | {"cash_flow": {"direction": DIRECTION}, "inventory_movements": {"movement_type": MOVEMENT}}.get(table, {})
    return df.select(*((aliased(F.col(c), by_column[c]) if c in by_column else F.trim(c)).alias(c) for c in TABLES[table]))


#: Fixed: columns that can't be below 0, table by table. Other money may be: corrections are.
NOT_NEGATIVE: dict[str, tuple[str, ...]] = {
    "orders": ("quantity",), "inventory": ("on_hand", "reserved", "reorder_point"), "purchase_orders": ("quantity",), "returns": ("quantity",), "operating_costs": ("amount_vnd",),
    "inventory_movements": ("quantity",), "quality_checks": ("inspected_quantity", "defective_quantity"), "cash_flow": ("amount_vnd",), "supplier_performance": ("average_lead_time_days", "order_count"),
    "customer_segments": ("customer_count", "order_count", "repeat_order_count"), "product_funnel": ("views", "add_to_cart_count", "order_count"), "co_purchase": ("joint_order_count",),
    "price_promotions": ("list_price_vnd", "final_price_vnd", "seller_discount_vnd"),
    "ads_sku_daily": ("impressions", "clicks", "add_to_cart_count", "attributed_orders", "spend_vnd", "attributed_revenue_vnd"), "inventory_batches": ("available_units", "unit_cost_vnd"),
    "search_performance": ("impressions", "clicks"), "shipping_performance": ("processing_hours",), "settlements": ("marketplace_payable_vnd", "actual_fee_vnd", "received_amount_vnd"),
    "competitor_catalog": ("price_vnd", "review_count", "estimated_monthly_units"),
}
#: Fixed: what else must hold of a typed row.
RULES: dict[str, list[str]] = {
    "reviews": ["rating between 1 and 5"], "quality_checks": ["defective_quantity <= inspected_quantity"], "cash_flow": ["lower(direction) in ('thu', 'chi')"],
    "supplier_performance": ["on_time_delivery_rate_percent between 0 and 100", "defect_rate_percent between 0 and 100"],
    "product_funnel": ["order_count <= add_to_cart_count", "add_to_cart_count <= views"], "co_purchase": ["sku <> paired_sku"], "price_promotions": ["final_price_vnd <= list_price_vnd"],
    "ads_sku_daily": ["attributed_orders <= add_to_cart_count", "add_to_cart_count <= clicks", "clicks <= impressions"], "search_performance": ["clicks <= impressions", "average_position > 0"],
    "competitor_catalog": ["rating between 0 and 5"],
}


def reason(table: str) -> Column:
    """The first rule that a raw row breaks: a blank, a value of the wrong type, or one below 0 that can't be."""
    checks: list[tuple[Column, str]] = []
    for c, kind in TABLES[table].items():
        checks.append((F.coalesce(F.trim(c), F.lit("")) == "", f"{c}: blank"))
        if kind != "s":
            checks.append((typed(table, c).isNull(), f"{c}: not a value of its type"))
        if c in NOT_NEGATIVE.get(table, ()):
            checks.append((typed(table, c) < 0, f"{c}: below 0"))
    return reduce(lambda out, check: F.when(check[0], F.lit(check[1])).otherwise(out), reversed(checks), F.lit(None).cast("string"))


def errors(df: DataFrame, table: str, order: str = "_row") -> DataFrame:
    """row, reason of the rows that break a rule. `order` numbers the input rows, the first being 2 (after the header)."""
    typed_rows = df.select(order, reason(table).alias("reason"), *(typed(table, c).alias(c) for c in TABLES[table]))
    own = reduce(lambda out, rule: F.when(~F.coalesce(F.expr(rule), F.lit(False)), F.lit(rule)).otherwise(out), reversed(RULES.get(table, [])), F.lit(None).cast("string"))
    return typed_rows.select(F.col(order).alias("row"), F.coalesce("reason", own).alias("reason")).filter("reason is not null")


def validate(df: DataFrame, table: str, order: str = "_row") -> DataFrame:
    """The typed table; raises on the first row that breaks a rule."""
    first = errors(df, table, order).orderBy("row").limit(1).collect()
    if first:
        raise ValueError(f"{table}, row {first[0]['row']}: {first[0]['reason']}")
    return df.select(*(typed(table, c).alias(c) for c in TABLES[table]))


def last_wins(df: DataFrame, key: str, order: str = "_row") -> DataFrame:
    """One row of each key: the last."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def check_bundle(names: set[str]) -> None:
    """Required tables must be there, unknown ones must not."""
    missing, unknown = sorted(set(REQUIRED) - names), sorted(names - set(TABLES))
    if missing or unknown:
        raise ValueError("; ".join(x for x in (f"missing: {', '.join(missing)}" * bool(missing), f"unknown: {', '.join(unknown)}" * bool(unknown)) if x))


def sized(files: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """path, bytes, reason of files (path, bytes) that can't be taken: empty ones, and those over `most` bytes. Sizes come
    from the listing, so no such file is read."""
    reason = F.when(F.coalesce("bytes", F.lit(0)) <= 0, "empty").when(F.col("bytes") > most, "too_large")
    return files.select("path", "bytes", reason.alias("reason")).filter("reason is not null")
