"""The shelf: 22 tables of a seller's shop, as they come (all strings), with the type that each column is read as."""

from __future__ import annotations

from pyspark.sql import types as T

#: s string, i non-negative integer, m money, f double, d date, M month (YYYY-MM), b boolean. Fixed names.
TABLES: dict[str, dict[str, str]] = {
    "orders": dict(order_id="s", order_date="d", status="s", sku="s", quantity="i", gross_merchandise_value_vnd="m", seller_discount_vnd="m", platform_discount_vnd="m", estimated_transaction_fee_vnd="m", estimated_service_fee_vnd="m"),
    "products": dict(sku="s", product_name="s", category="s", cost_per_unit_vnd="m", list_price_vnd="m"),
    "inventory": dict(sku="s", on_hand="i", reserved="i", reorder_point="i", last_updated="d"),
    "ads": dict(campaign_id="s", month="M", campaign_name="s", spend_vnd="m", attributed_revenue_vnd="m", orders="i"),
    "purchase_orders": dict(purchase_order_id="s", order_date="d", supplier_name="s", sku="s", quantity="i", unit_cost_vnd="m", expected_arrival_date="d", status="s"),
    "returns": dict(return_id="s", order_id="s", request_date="d", sku="s", quantity="i", reason="s", status="s", refund_amount_vnd="m"),
    "reviews": dict(review_id="s", review_date="d", sku="s", rating="i", sentiment="s", issue_type="s", comment="s"),
    "operating_costs": dict(cost_id="s", month="M", cost_category="s", amount_vnd="m", note="s"),
    "inventory_movements": dict(movement_id="s", movement_date="d", sku="s", movement_type="s", quantity="i", reference="s", note="s"),
    "quality_checks": dict(check_id="s", check_date="d", purchase_order_id="s", sku="s", inspected_quantity="i", defective_quantity="i", defect_type="s", status="s"),
    "cash_flow": dict(cash_flow_id="s", date="d", direction="s", category="s", amount_vnd="m", reference="s", note="s"),
    "supplier_performance": dict(supplier_id="s", supplier_name="s", month="M", on_time_delivery_rate_percent="f", defect_rate_percent="f", average_lead_time_days="f", order_count="i"),
    "customer_segments": dict(month="M", segment_name="s", customer_count="i", order_count="i", repeat_order_count="i", gmv_vnd="m"),
    "product_funnel": dict(month="M", sku="s", views="i", add_to_cart_count="i", order_count="i"),
    "co_purchase": dict(month="M", sku="s", paired_sku="s", joint_order_count="i"),
    "price_promotions": dict(date="d", sku="s", list_price_vnd="m", final_price_vnd="m", seller_discount_vnd="m", voucher_source="s", campaign_name="s"),
    "ads_sku_daily": dict(date="d", campaign_id="s", sku="s", impressions="i", clicks="i", spend_vnd="m", add_to_cart_count="i", attributed_orders="i", attributed_revenue_vnd="m"),
    "inventory_batches": dict(batch_id="s", sku="s", received_date="d", available_units="i", unit_cost_vnd="m"),
    "search_performance": dict(date="d", sku="s", search_term="s", impressions="i", clicks="i", average_position="f"),
    "shipping_performance": dict(order_id="s", order_date="d", status="s", is_late="b", cancellation_reason="s", processing_hours="f"),
    "settlements": dict(settlement_id="s", settlement_date="d", payout_date="d", marketplace_payable_vnd="m", actual_fee_vnd="m", received_amount_vnd="m", status="s"),
    "competitor_catalog": dict(observed_date="d", reference_sku="s", competitor_shop="s", product_name="s", price_vnd="m", rating="f", review_count="i", estimated_monthly_units="i"),
}
REQUIRED = ("orders", "products", "inventory")

SPARK_TYPES = {"s": T.StringType(), "i": T.LongType(), "m": T.DecimalType(18, 4), "f": T.DoubleType(), "d": T.DateType(), "M": T.StringType(), "b": T.BooleanType()}


def raw_schema(table: str) -> T.StructType:
    """All columns as strings."""
    return T.StructType([T.StructField(c, T.StringType()) for c in TABLES[table]])


def typed_schema(table: str) -> T.StructType:
    return T.StructType([T.StructField(c, SPARK_TYPES[k]) for c, k in TABLES[table].items()])
