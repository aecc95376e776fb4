"""Parts of one order: the whole table, its parts, and what the report of the first pairs shuffles."""

import random
from collections import Counter
from datetime import datetime
from decimal import Decimal

import pytest

from tradewind.operators import reports
from tradewind.sources import testdata


@pytest.fixture
def star(spark, tmp_path):
    """Orders of few parts, of two dates once, of one line, of a part twice and of none."""
    rng = random.Random(9)
    lines = [(o, rng.randint(1, 12)) for o in range(300) for _ in range(rng.randint(1, 7))] + [(7, None), (9_999, 1), (9_999, 2)]
    orders = [(o, datetime(1996, 1 + o % 2, 3) if o % 50 else None) for o in range(301)] + [(5, datetime(1997, 1, 1)), (6, datetime(1996, 1, 9))]
    part = [(p, f"part {p}", "t", p % 5 + (p != 3), 10.0 * p) for p in range(1, 12)]
    tables = {"lineitem": (lines, "l_orderkey long, l_partkey long"), "orders": (orders, "o_orderkey long, o_orderdate timestamp"), "part": (part, "p_partkey long, p_name string, p_type string, p_size int, p_retailprice double")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    months = {}
    for o, d in orders:
        months.setdefault(o, set()).add(d and d.strftime("%Y-%m"))
    baskets = {}
    for o, p in lines:
        baskets.setdefault(o, set()).add(p)
    want = Counter()
    for o, parts in baskets.items():
        for m in months.get(o, ()):
            want.update({(m, a, b): len(months[o]) for a in parts for b in parts if a and b and a < b})
    return testdata.Star(spark, str(tmp_path)), want


def test_pairs_are_whole_in_any_number_of_parts(star, monkeypatch):
    shelf, want = star
    assert {(r.month, r.sku, r.paired_sku): r.joint_order_count for r in shelf["co_purchase"].collect()} == want
    monkeypatch.setattr(testdata, "PAIRS_AT_ONCE", 500)
    parts = shelf.parts_of("co_purchase")
    rows = [tuple(r) for p in parts for r in p.collect()]
    assert len(parts) > 3 and len(rows) == len(want) and {r[:3]: r[3] for r in rows} == want


@pytest.mark.parametrize("top", [1, 10, 10_000])
def test_first_pairs_of_all_parts(star, monkeypatch, top):
    shelf, want = star
    stock = {r.sku: r.on_hand - r.reserved for r in shelf["inventory"].collect()}
    rows = [(m, a, b, n) for (m, a, b), n in want.items() if a in stock and b in stock]
    first = sorted(rows, key=lambda r: (min(stock[r[1]], stock[r[2]]) <= 0, -r[3], r[1], r[2], r[0] or ""))[:top]
    for at_once in (10**6, 500):
        monkeypatch.setattr(testdata, "PAIRS_AT_ONCE", at_once)
        got = [(r.month, r.sku, r.paired_sku, r.joint_order_count) for r in reports.co_purchases(shelf, top=top).collect()]
        assert got == first


def test_a_given_table_keeps_its_repeats(spark):
    names = "month string, sku string, paired_sku string, joint_order_count long"
    rows = [("2026-08", "A", "B", 5), ("2026-08", "A", "B", 5), (None, "A", "B", 9), ("2026-08", "A", "Z", 90)]
    known = spark.createDataFrame([("A", "a", "c", Decimal(1), Decimal(2)), ("B", "b", "c", Decimal(3), Decimal(4))], "sku string, product_name string, category string, cost_per_unit_vnd decimal(18,4), list_price_vnd decimal(18,4)")
    shelf = {"co_purchase": spark.createDataFrame(rows, names), "products": known, "inventory": spark.createDataFrame([("A", 3, 1)], "sku string, on_hand long, reserved long")}
    got = [(r.month, r.sku, r.paired_sku, r.joint_order_count) for r in reports.co_purchases(shelf).collect()]
    assert got == [rows[2], rows[0], rows[1]]


def test_pairs_meet_no_names(spark):
    """What the report joins with all pairs has a state alone; names come to the few that are shown."""
    shelf = testdata.Star(spark, "/root/testdata/sf0.001")
    text = reports.co_purchases(shelf)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in text and "p_partkey" in text
