"""Ingestion, validation and reports on a small shelf."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tradewind.functions import text
from tradewind.operators import ingest, planner, reports, retrieval
from tradewind.schemas import raw_schema
from tradewind.sources import shelf as files

ORDERS = [
    ("o1", "2026-08-03", "Hoàn thành", "A", "2", "200000", "10000", "5000", "8000", "4000"), ("o2", "8/31/2026", "completed", "B", "1", "90000", "", "0", "3600", "1800"),
    ("o3", "2026-07-01", "Completed ", "A", "1", "100000", "0", "0", "4000", "2000"), ("o4", "2026-08-09", "Đã hủy", "A", "5", "500000", "0", "0", "0", "0"), ("o5", "2026-08-10", "completed", "Z", "1", "10000", "0", "0", "0", "0"),
]
PRODUCTS = [("A", "Tai nghe", "Audio", "40000", "120000"), ("B", "Ốp lưng", "Case", "50000", "90000")]
INVENTORY = [("A", "10", "6", "8", "2026-08-31"), ("B", "30", "0", "5", "2026-08-31")]


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("shelf")
    for name, rows in (("orders", ORDERS), ("products", PRODUCTS), ("inventory", INVENTORY)):
        header = ",".join(raw_schema(name).names)
        (folder / f"{name}.csv").write_text("﻿" + header + "\n" + "".join(",".join(r) + "\n" for r in rows), encoding="utf-8")
    return files.Shelf(spark, str(folder))


def test_sales(shop):
    r = reports.sales_summary(shop, "2026-08").first()
    assert (r.order_count, r.units, r.gmv, r.seller_discount, r.platform_fees, r.net_revenue) == (3, 4, 300000, 10000, 17400, 272600)
    assert reports.sales_summary(shop, "2026").first().order_count == 4
    assert reports.sales_summary(shop, "2025").first().gmv == 0


def test_rankings_and_defaults(shop):
    r = reports.product_gmv_ranking(shop, "2026-08").collect()
    assert [(x.sku, x.product_name) for x in r] == [("A", "Tai nghe"), ("B", "Ốp lưng"), ("Z", "Z")]
    c = {x.sku: x.contribution for x in reports.product_contribution(shop).collect()}
    assert c == {"A": 300000 - 10000 - 12000 - 6000 - 120000, "B": 90000 - 5400 - 50000, "Z": 10000}
    m = reports.sales_period_comparison(shop).collect()
    assert [(x.month, x.previous_month, x.gmv_change_percent) for x in m] == [("2026-07", None, None), ("2026-08", "2026-07", 200.0)]
    assert [(x.sku, x.shortfall) for x in reports.inventory_alerts(shop).collect()] == [("A", 4)]
    assert [x.sku for x in reports.inventory_slow_products(shop, "2026-08").collect()] == ["B", "A"]


def test_missing_tables(spark, shop, tmp_path):
    r = reports.advertising_summary(shop).first()
    assert (r.campaign_count, r.spend, r.roas) == (0, 0.0, 0.0)
    assert reports.quality_summary(shop).first().defect_rate_percent is None
    s = {x.sku: x for x in reports.scorecard(shop).collect()}
    assert s["A"].evidence_gaps == "review|quality|funnel" and "low_stock" in s["A"].risk_signals
    with pytest.raises(FileNotFoundError):
        files.Shelf(spark, str(tmp_path))["orders"]


def test_validation(spark):
    names = "movement_id,movement_date,sku,movement_type,quantity,reference,note"
    rows = [(2, "m1", "2026-08-01", "A", "inbound", "3", "r", "n"), (3, "m2", "2026-13-01", "A", "inbound", "3", "r", "n"), (4, "m3", "2026-08-01", "A", "lost", "-3", "r", "n"), (5, "m4", "2026-08-01", " ", "inbound", "-1", "r", "n")]
    df = spark.createDataFrame(rows, "_row int, " + ", ".join(f"{c} string" for c in names.split(",")))
    found = {r.row: r.reason for r in ingest.errors(df, "inventory_movements").collect()}
    assert set(found) == {3, 4, 5} and found[3] == "movement_date: not a value of its type" and found[5] == "sku: blank"
    with pytest.raises(ValueError, match="row 3"):
        ingest.validate(df, "inventory_movements")
    assert ingest.validate(df.filter("_row = 2"), "inventory_movements").first().quantity == 3


def test_headers(spark):
    df = spark.createDataFrame([("A", "1", "x", "2", "3")], ["SKU", "Tên SP", "Category ", "cost_per_unit_vnd", "List-Price VND"])
    assert ingest.mapped_headers(df, "products", {"ten_sp": "product_name"}).columns == ["sku", "product_name", "category", "cost_per_unit_vnd", "list_price_vnd"]
    with pytest.raises(ValueError, match="several"):
        ingest.mapped_headers(df.withColumnRenamed("Tên SP", "sku "), "products")
    with pytest.raises(ValueError, match="missing"):
        ingest.mapped_headers(df, "products")
    with pytest.raises(ValueError, match="missing: inventory"):
        ingest.check_bundle({"orders", "products"})


def test_dates_and_months(spark):
    rows = ["2026-08-31", "20260831", "3/4/2026", "31/8/2026", "2026", "2026-8-3", "", None]
    df = spark.createDataFrame([(x,) for x in rows], "d string").select(ingest.to_date(F.col("d")).alias("d"))
    assert [r.d for r in df.collect()] == [date(2026, 8, 31), date(2026, 8, 31), date(2026, 3, 4), date(2026, 8, 31), None, None, None, None]
    m = spark.createDataFrame([("2026-08",), ("8/2026",), ("2026-08-02",), ("x",)], "m string").select(ingest.to_month(F.col("m")).alias("m"))
    assert [r.m for r in m.collect()] == ["2026-08", "2026-08", "2026-08", None]


def test_text(spark):
    df = spark.createDataFrame([("Đơn hàng  ĐÃ hủy!", "ab", "ba"), ("aaaa", "abc", "ab"), ("12 3", "abc", "abd")], "t string, a string, b string")
    r = df.select(text.match_form(F.col("t")).alias("m"), text.gibberish(F.col("t")).alias("g"), text.one_edit_apart(F.col("a"), F.col("b")).alias("e"), retrieval.terms(F.col("t")).alias("n")).collect()
    assert [x.m for x in r] == ["don hang da huy", "aaaa", "12 3"]
    assert [x.g for x in r] == [False, True, True]
    assert [x.e for x in r] == [True, True, False]
    assert r[2].n == ["12", "3", "12_3"]


def test_budget_skips_and_goes_on(spark):
    rows = [(1, 1, "a" * 40), (1, 2, "b" * 90), (1, 3, "c" * 40), (1, 4, "a" * 40), (1, 5, "d" * 20), (1, 6, "e" * 1)]
    df = spark.createDataFrame(rows, "q int, place long, text string")
    assert retrieval.within_budget(df, "q", "place", "text", chars=100, most=4).first().kept == [1, 3, 5]


def test_files_and_replacement(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_bytes(b"one")
    (tmp_path / "y.csv").write_bytes(b"two")
    r = files.files(spark, str(tmp_path), extensions=(".txt",)).collect()
    assert len(r) == 1 and r[0].bytes == 3
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c")], "k int, v string")
    assert sorted(tuple(x) for x in files.replace_by_key(old, new, "k").collect()) == [(1, "a"), (2, "c")]


def test_stream_equals_batch(spark, tmp_path):
    from tradewind.streaming import funnel

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = funnel.stream(source).writeStream.format("memory").queryName("daily").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("daily").collect())) == sorted(map(tuple, funnel.daily(events).collect()))


def test_page_text(spark):
    html = "<style>p {x}</style><h1>A &amp; B</h1><!-- no <p> --><p>caf&#233; &#xe9;&#x1F600;<br>next &amp;#65; &#99999999; &amp;lt;&lt;&hellip;&#150;&nope;&</p><DIV>x</DIV >y<script a='b'>z</script>"
    assert spark.range(1).select(text.html_to_text(F.lit(html))).first()[0] == "A & B\n\ncafé é😀\nnext &#65; \ufffd &lt;<…–&nope;&\n\nx\ny"


def test_terms_keep_vietnamese_words(spark):
    r = spark.range(1).select(text.unigrams(F.lit("Thống  kê API v2.0/api_key, Đơn")), text.with_bigrams(F.lit("Phí giao-dịch 5%")), text.with_bigrams(F.lit(" "))).first()
    assert list(r) == [["thong", "ke", "api", "v2.0/api_key", "don"], ["phi", "giao-dich", "5%", "phi_giao-dich", "giao-dich_5%"], []]


def test_encodings_are_tried_in_turn(spark):
    rows = [("\ufeffđơn".encode(),), ("hàng hóa đ ư".encode("cp1258", "ignore"),), (b"caf\xe9 \x8a",)]
    got = [r[0] for r in spark.createDataFrame(rows, "b binary").select(files.text_of(F.col("b"))).collect()]
    assert got == ["đơn", rows[1][0].decode("cp1258"), "café \x8a"]


def test_scorecard_needs_evidence(spark):
    """A product without reviews, checks or funnel is no candidate; the lowest contribution counts products that weren't sold."""
    tables = {
        "orders": [(s, "2026-08-01", q, g, 0, 0, 0, 0, "completed") for s, q, g in (("a", 2, 900), ("b", 1, 500), ("c", 1, 10))], "products": [(s, s, "x", 100, 300) for s in "abcd"], "inventory": [(s, 50, 0, 5) for s in "abcd"],
        "reviews": [(s, "2026-08-02", 5, "") for s in "bcd"], "quality_checks": [(s, "2026-08-02", 10, 0, "") for s in "abcd"], "returns": [], "product_funnel": [("2026-08", s, 100, 10, 1) for s in "abcd"],
    }
    names = {
        "orders": "sku string, order_date string, quantity int, gross_merchandise_value_vnd int, seller_discount_vnd int, platform_discount_vnd int, estimated_transaction_fee_vnd int, estimated_service_fee_vnd int, status string",
        "products": "sku string, product_name string, category string, cost_per_unit_vnd int, list_price_vnd int", "inventory": "sku string, on_hand int, reserved int, reorder_point int", "reviews": "sku string, review_date string, rating int, issue_type string",
        "quality_checks": "sku string, check_date string, inspected_quantity int, defective_quantity int, defect_type string", "returns": "sku string, request_date string, quantity int", "product_funnel": "month string, sku string, views int, add_to_cart_count int, order_count int",
    }
    got = {r.sku: r for r in reports.scorecard({n: spark.createDataFrame(rows, names[n]) for n, rows in tables.items()}).collect()}
    assert [s for s, r in got.items() if r.recommended] == ["b"] and got["a"].evidence_gaps == "review" and got["a"].gmv > got["b"].gmv
    assert {s for s, r in got.items() if r.top_risk} == {"c"} and got["c"].risk_signals == "lowest_contribution" and got["d"].contribution == 0 and got["b"].view_to_cart_percent == 10


def test_search_terms_are_all_there(spark):
    rows = [("2026-08-01", f"s{i % 7}", f"t{i:02d}", 10, i // 2, float(i % 4)) for i in range(45)] + [("2026-07-01", "s0", "old", 10, 1, 1.0)]
    shop = {"search_performance": spark.createDataFrame(rows, "date string, sku string, search_term string, impressions int, clicks int, average_position double")}
    got = [r.search_term for r in reports.search_terms(shop, "2026-08").collect()]
    assert got == [f"t{i:02d}" for i in sorted(range(45), key=lambda i: (-(i // 2), i % 4, i))]
