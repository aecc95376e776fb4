"""Registered queries of the engine: the shop's reports, the dashboard, retrieval, evaluation and market operators."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from ..operators import reports as r
from ..sources.testdata import Star
from . import answers, more, questions, reviews, texts, wording
from .oracles_shop import ORACLES as SHOP

Query = Callable[[SparkSession, str], DataFrame]


def _shop(report: Callable[..., DataFrame], *args, drop: tuple[str, ...] = ()) -> Query:
    return lambda spark, sf_dir: report(Star(spark, sf_dir), *args).drop(*drop)


SHOP_QUERIES: dict[str, Query] = {
    "ag01_sales_summary": _shop(r.sales_summary), "ag01_sales_summary_year": _shop(r.sales_summary, "1996"), "ag01_sales_summary_month": _shop(r.sales_summary, "1996-02"),
    "ag02_product_gmv_ranking": _shop(r.product_gmv_ranking), "ag03_product_contribution": _shop(r.product_contribution), "ag04_sales_period_comparison": _shop(r.sales_period_comparison),
    "ag05_inventory_alerts": _shop(r.inventory_alerts), "ag06_inventory_slow_products": _shop(r.inventory_slow_products), "ag07_advertising_summary": _shop(r.advertising_summary),
    "ag08_profitability_summary": _shop(r.profitability_summary), "ag09_operating_costs": _shop(r.operating_costs), "ag10_inventory_movements": _shop(r.inventory_movements),
    "ag11_quality_summary": _shop(r.quality_summary), "ag11_defects_by_type": _shop(r.defects_by_type), "ag12_cash_flow_summary": _shop(r.cash_flow_summary),
    "ag12_outflow_by_category": _shop(r.outflow_by_category), "ag13_supplier_ranking": _shop(r.supplier_ranking), "ag14_customer_retention": _shop(r.customer_retention),
    "ag15_product_funnel": _shop(r.product_funnel), "ag16_co_purchases": _shop(r.co_purchases), "ag17_price_promotions": _shop(r.price_promotions),
    "ag18_ads_by_sku": _shop(r.ads_by_sku, drop=("product_name",)), "ag19_batch_ages": _shop(r.batch_ages, date(2002, 1, 1)), "ag20_search_terms": _shop(r.search_terms),
    "ag20_search_leaders": _shop(r.search_leaders), "ag21_shipping_summary": _shop(r.shipping_summary), "ag22_settlement_summary": _shop(r.settlement_summary),
    "ag23_competitor_summary": _shop(r.competitor_summary), "ag24_returns_summary": _shop(r.returns_summary), "ag24_returns_by_reason": _shop(r.returns_by_reason),
    "ag24_review_summary": _shop(r.review_summary), "ag24_review_issues": _shop(r.review_issues), "ag24_procurement_summary": _shop(r.procurement_summary),
    "ag10_movements_by_type": _shop(r.movements_by_type), "ag15_funnel_totals": _shop(r.funnel_totals), "ag21_cancellation_reasons": _shop(r.cancellation_reasons), "ag23_competitor_listings": _shop(r.competitor_listings),
    "ag24_review_priority": _shop(r.review_priority), "ag25_scorecard": _shop(r.scorecard), "ag26_available_periods": _shop(r.available_periods), "ag39_profit_after_overhead": _shop(r.profit_after_overhead),
}


def queries() -> dict[str, Query]:
    return SHOP_QUERIES | more.QUERIES | answers.QUERIES | questions.QUERIES | texts.QUERIES | reviews.QUERIES | wording.QUERIES


def oracle_sql() -> dict[str, str]:
    return SHOP | more.ORACLES | answers.ORACLES | questions.ORACLES | texts.ORACLES | reviews.ORACLES | wording.ORACLES
