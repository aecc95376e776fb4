"""DuckDB's SQL for the shop's reports over the star schema."""

from __future__ import annotations

D2, D4 = "DECIMAL(18,2)", "DECIMAL(18,4)"

TABLES = {
    "lines": "SELECT l.*, CAST(l_shipdate AS DATE) AS ship_date, CAST(o_orderdate AS DATE) AS order_date, o_orderstatus, o_orderpriority, CAST(l_extendedprice AS DECIMAL(18,2)) AS price FROM lineitem l JOIN orders ON l_orderkey = o_orderkey",
    "sales": "SELECT l_orderkey AS order_id, order_date, l_partkey AS sku, CAST(l_quantity AS BIGINT) AS quantity, CAST(price AS DECIMAL(18,4)) AS gmv, CAST(price * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(18,4)) AS sd, CAST(price * CAST(0.01 AS DECIMAL(4,2)) AS DECIMAL(18,4)) AS pd, CAST(price * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(18,4)) AS tf, CAST(price * CAST(0.02 AS DECIMAL(4,2)) AS DECIMAL(18,4)) AS sf FROM lines WHERE o_orderstatus = 'F'",
    "products": "SELECT p_partkey AS sku, p_name AS product_name, CAST(CAST(p_retailprice AS DECIMAL(18,2)) * CAST(0.6 AS DECIMAL(4,2)) AS DECIMAL(18,4)) AS unit_cost, CAST(p_retailprice AS DECIMAL(18,2)) AS list_price FROM part",
    "inv": "SELECT p_partkey AS sku, p_size - p_partkey % 7 AS available, 12 AS reorder_point FROM part",
    "why": "SELECT CASE WHEN l_linenumber = 1 THEN 'Chưa ghi lý do' ELSE o_orderpriority END AS reason, count(*) AS n FROM lines WHERE o_orderstatus = 'P' GROUP BY 1",
    "ev": "SELECT *, strftime(ts, '%Y-%m') AS month, CAST(CAST(floor(value * 100) AS DECIMAL(18,0)) / 100 AS DECIMAL(18,2)) AS cents FROM events",
    "contrib": "SELECT sku, product_name, units, g, g - d - unit_cost * units AS c FROM (SELECT sku, sum(quantity) AS units, sum(gmv) AS g, sum(sd + tf + sf) AS d FROM sales GROUP BY sku) JOIN products USING (sku)",
}
NEEDS = {"why": ["lines"], "sales": ["lines"], "contrib": ["lines", "sales", "products"]}


def sql(body: str, *tables: str) -> str:
    """The body with the bound tables that it names."""
    order = list(dict.fromkeys(t for name in tables for t in [*NEEDS.get(name, []), name]))
    return "WITH " + ", ".join(f"{t} AS ({TABLES[t]})" for t in order) + " " + body


Y = "order_date >= DATE '1996-01-01' AND order_date < DATE '1997-01-01'"
M = "order_date >= DATE '1996-02-01' AND order_date < DATE '1996-03-01'"
SUMS = ", ".join(f"CAST(coalesce(sum({c}), 0) AS DOUBLE) AS {n}" for c, n in (("gmv", "gmv"), ("sd", "seller_discount"), ("pd", "platform_discount"), ("tf", "transaction_fee"), ("sf", "service_fee"), ("tf + sf", "platform_fees"), ("gmv - sd - tf - sf", "net_revenue")))

ORACLES = {
    "ag01_sales_summary": sql(f"SELECT count(*) AS order_count, CAST(coalesce(sum(quantity), 0) AS BIGINT) AS units, {SUMS} FROM sales", "sales"),
    "ag01_sales_summary_year": sql(f"SELECT count(*) AS order_count, CAST(coalesce(sum(quantity), 0) AS BIGINT) AS units, {SUMS} FROM sales WHERE {Y}", "sales"),
    "ag01_sales_summary_month": sql(f"SELECT count(*) AS order_count, CAST(coalesce(sum(quantity), 0) AS BIGINT) AS units, {SUMS} FROM sales WHERE {M}", "sales"),
    "ag02_product_gmv_ranking": sql("SELECT sku, product_name, CAST(sum(gmv) AS DOUBLE) AS gmv, CAST(sum(quantity) AS BIGINT) AS units, count(*) AS order_count FROM sales JOIN products USING (sku) GROUP BY ALL", "sales", "products"),
    "ag03_product_contribution": sql("SELECT sku, product_name, CAST(units AS BIGINT) AS units, CAST(g AS DOUBLE) AS gmv, CAST(c AS DOUBLE) AS contribution, CAST(c AS DOUBLE) / CAST(units AS DOUBLE) AS contribution_per_unit, CAST(c AS DOUBLE) * 100 / CAST(g AS DOUBLE) AS margin_percent FROM contrib", "contrib"),
    "ag04_sales_period_comparison": sql("SELECT month, order_count, CAST(gmv AS DOUBLE) AS gmv, lag(month) OVER w AS previous_month, CAST(lag(gmv) OVER w AS DOUBLE) AS previous_gmv, CAST(gmv - lag(gmv) OVER w AS DOUBLE) * 100 / nullif(CAST(lag(gmv) OVER w AS DOUBLE), 0) AS gmv_change_percent FROM (SELECT strftime(order_date, '%Y-%m') AS month, count(*) AS order_count, sum(gmv) AS gmv FROM sales GROUP BY 1) WINDOW w AS (ORDER BY month)", "sales"),
    "ag05_inventory_alerts": sql("SELECT sku, product_name, CAST(available AS BIGINT) AS available, CAST(reorder_point AS BIGINT) AS reorder_point, CAST(reorder_point - available AS BIGINT) AS shortfall FROM inv JOIN products USING (sku) WHERE available <= reorder_point", "inv", "products"),
    "ag06_inventory_slow_products": sql("SELECT i.sku, product_name, CAST(coalesce(n, 0) AS BIGINT) AS units_sold, CAST(available AS BIGINT) AS available FROM inv i JOIN products p ON i.sku = p.sku LEFT JOIN (SELECT sku, sum(quantity) AS n FROM sales GROUP BY sku) s ON s.sku = i.sku", "inv", "products", "sales"),
    "ag07_advertising_summary": sql("SELECT count(DISTINCT (month, user_id % 5)) AS campaign_count, CAST(sum(CASE WHEN event_type = 'click' THEN cents ELSE 0 END) AS DOUBLE) AS spend, CAST(sum(CASE WHEN event_type = 'purchase' THEN cents ELSE 0 END) AS DOUBLE) AS revenue, count(*) FILTER (event_type = 'purchase') AS orders, CAST(sum(CASE WHEN event_type = 'purchase' THEN cents ELSE 0 END) AS DOUBLE) / CAST(sum(CASE WHEN event_type = 'click' THEN cents ELSE 0 END) AS DOUBLE) AS roas FROM ev", "ev"),
    "ag08_profitability_summary": sql("SELECT CAST(sum(gmv - sd - tf - sf) AS DOUBLE) AS net_revenue, CAST(sum(unit_cost * quantity) AS DOUBLE) AS cogs, CAST(sum(gmv - sd - tf - sf) - sum(unit_cost * quantity) AS DOUBLE) AS contribution FROM sales JOIN products USING (sku)", "sales", "products"),
    "ag09_operating_costs": sql("SELECT event_type AS label, CAST(sum(cents) AS DOUBLE) AS amount, CAST(sum(cents) AS DOUBLE) * 100 / CAST(sum(sum(cents)) OVER () AS DOUBLE) AS share_percent FROM ev GROUP BY 1", "ev"),
    "ag10_inventory_movements": sql("SELECT count(*) AS movement_count, CAST(coalesce(sum(l_quantity) FILTER (l_returnflag <> 'R' AND l_linestatus = 'O'), 0) AS BIGINT) AS inbound, CAST(coalesce(sum(l_quantity) FILTER (l_returnflag <> 'R' AND l_linestatus <> 'O' AND l_linenumber <> 7), 0) AS BIGINT) AS outbound, CAST(coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0) AS BIGINT) AS damaged FROM lines", "lines"),
    "ag11_quality_summary": sql("SELECT count(*) AS check_count, CAST(sum(l_quantity) AS BIGINT) AS inspected, CAST(sum(l_quantity) FILTER (l_returnflag = 'R') AS BIGINT) AS defective, sum(l_quantity) FILTER (l_returnflag = 'R') * 100 / sum(l_quantity) AS defect_rate_percent FROM lines", "lines"),
    "ag11_defects_by_type": sql("SELECT o_orderpriority AS defect_type, CAST(sum(l_quantity) AS BIGINT) AS defective FROM lines WHERE l_returnflag = 'R' AND l_quantity >= 1 GROUP BY 1", "lines"),
    "ag12_cash_flow_summary": sql("SELECT CAST(sum(price) FILTER (l_linestatus = 'O') AS DOUBLE) AS inflow, CAST(sum(price) FILTER (l_linestatus <> 'O') AS DOUBLE) AS outflow, CAST(sum(CASE WHEN l_linestatus = 'O' THEN price ELSE -price END) AS DOUBLE) AS net FROM lines", "lines"),
    "ag12_outflow_by_category": sql("SELECT o_orderpriority AS label, CAST(sum(price) AS DOUBLE) AS amount, CAST(sum(price) AS DOUBLE) * 100 / CAST(sum(sum(price)) OVER () AS DOUBLE) AS share_percent FROM lines WHERE l_linestatus <> 'O' GROUP BY 1", "lines"),
    "ag13_supplier_ranking": sql("SELECT p AS position, supplier_id, s_name AS supplier_name, o AS on_time_delivery_rate_percent, d AS defect_rate_percent, a AS average_lead_time_days, row_number() OVER (ORDER BY o, p) = 1 AS least_punctual, row_number() OVER (ORDER BY a DESC, p) = 1 AS slowest FROM (SELECT *, row_number() OVER (ORDER BY o DESC, d, a, supplier_id) AS p FROM (SELECT l_suppkey AS supplier_id, count(*) FILTER (greatest(ship_date - order_date, 0) <= 60) * 100.0::DOUBLE / count(*) AS o, count(*) FILTER (l_returnflag = 'R') * 100.0::DOUBLE / count(*) AS d, CAST(sum(greatest(ship_date - order_date, 0)) AS DOUBLE) / count(*) AS a FROM lines GROUP BY 1)) JOIN supplier ON s_suppkey = supplier_id", "lines"),
    "ag14_customer_retention": "WITH b AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_custkey, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS g FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) SELECT count(*) AS customers, count(*) FILTER (n > 1) AS returning_customers, CAST(sum(n) AS BIGINT) AS orders, CAST(sum(n - 1) AS BIGINT) AS repeat_orders, CAST(sum(g) AS DOUBLE) AS gmv, CAST(sum(n - 1) AS DOUBLE) * 100 / CAST(sum(n) AS DOUBLE) AS repeat_rate_percent FROM b",
    "ag15_product_funnel": sql("""SELECT month, f.sku, coalesce(p_name, CAST(f.sku AS VARCHAR)) AS product_name, views, carts, orders, vc AS view_to_cart_percent, co AS cart_to_order_percent, median_views,
        views >= 20 AND row_number() OVER (PARTITION BY views >= 20 ORDER BY coalesce(co, 0), views, f.sku, month) = 1 AS weak_cart_to_order,
        views >= median_views AND row_number() OVER (PARTITION BY views >= median_views ORDER BY vc ASC NULLS LAST, views DESC, f.sku, month) = 1 AS weak_view_to_cart
        FROM (SELECT *, carts * 100.0::DOUBLE / nullif(views, 0) AS vc, orders * 100.0::DOUBLE / nullif(carts, 0) AS co, CAST(median(views) OVER () AS DOUBLE) AS median_views FROM (SELECT month, user_id AS sku, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'click') AS carts, count(*) FILTER (event_type = 'purchase') AS orders FROM ev GROUP BY 1, 2)) f LEFT JOIN part ON p_partkey = f.sku""", "ev"),
    "ag16_co_purchases": sql("""SELECT month, c.sku, paired_sku, a.product_name AS a_name, b.product_name AS b_name, n AS joint_order_count, CAST(a.list_price + b.list_price AS DOUBLE) AS combined_price, CAST(a.unit_cost + b.unit_cost AS DOUBLE) AS combined_cost, CAST((a.list_price + b.list_price) * CAST(0.95 AS DECIMAL(4,2)) AS DOUBLE) AS trial_price, CAST(least(i.available, j.available) AS BIGINT) AS least_stock
        FROM (SELECT x.month, x.sku, y.sku AS paired_sku, count(*) AS n FROM o x JOIN o y ON x.k = y.k AND x.sku < y.sku GROUP BY ALL) c JOIN products a ON a.sku = c.sku JOIN products b ON b.sku = paired_sku LEFT JOIN inv i ON i.sku = c.sku LEFT JOIN inv j ON j.sku = paired_sku
        ORDER BY least(i.available, j.available) <= 0, n DESC, c.sku, paired_sku, month LIMIT 10""", "lines", "products", "inv").replace(" SELECT month, c.sku", ", o AS (SELECT DISTINCT strftime(order_date, '%Y-%m') AS month, l_orderkey AS k, l_partkey AS sku FROM lines) SELECT month, c.sku", 1),
    "ag17_price_promotions": sql("SELECT sku, product_name, n AS rows, CAST(l AS DOUBLE) / n AS average_list_price, CAST(l - d AS DOUBLE) / n AS average_final_price, CAST(d AS DOUBLE) / n AS average_seller_discount, CAST(d AS DOUBLE) * 100 / CAST(l AS DOUBLE) AS discount_percent, v AS voucher_sources FROM (SELECT l_partkey AS sku, count(*) AS n, sum(price) AS l, sum(price * CAST(l_discount AS DECIMAL(4,2))) AS d, array_to_string(list_sort(list(DISTINCT o_orderpriority)), '|') AS v FROM lines WHERE l_discount > 0 GROUP BY 1) JOIN products USING (sku)", "lines", "products"),
    "ag18_ads_by_sku": sql("SELECT sku, i AS impressions, c AS clicks, a AS carts, o AS orders, CAST(s AS DOUBLE) AS spend, CAST(r AS DOUBLE) AS revenue, c * 100.0::DOUBLE / nullif(i, 0) AS ctr_percent, a * 100.0::DOUBLE / nullif(c, 0) AS click_to_cart_percent, CAST(r AS DOUBLE) / nullif(CAST(s AS DOUBLE), 0) AS roas FROM (SELECT user_id AS sku, count(*) FILTER (event_type = 'view') AS i, count(*) FILTER (event_type = 'click') AS c, count(*) FILTER (event_type = 'signup') AS a, count(*) FILTER (event_type = 'purchase') AS o, coalesce(sum(cents) FILTER (event_type = 'click'), 0) AS s, coalesce(sum(cents) FILTER (event_type = 'purchase'), 0) AS r FROM ev GROUP BY 1)", "ev"),
    "ag19_batch_ages": sql("SELECT batch_id, b.sku, product_name, available_units, age_days FROM (SELECT l_partkey || '/' || CAST(ship_date AS VARCHAR) AS batch_id, l_partkey AS sku, CAST(sum(l_quantity) AS BIGINT) AS available_units, CAST(greatest(DATE '2002-01-01' - ship_date, 0) AS BIGINT) AS age_days FROM lines GROUP BY l_partkey, ship_date) b JOIN products p ON b.sku = p.sku ORDER BY age_days DESC, available_units DESC, batch_id LIMIT 20", "lines", "products"),
    "ag20_search_terms": "WITH s AS (SELECT event_type || (user_id % 20) AS t, CAST(sum(event_id % 9 + 1) AS BIGINT) AS i, CAST(sum(event_id % 3) AS BIGINT) AS c, sum((event_id % 50) / 4.0::DOUBLE) / count(*) AS a, count(DISTINCT user_id) AS skus FROM events GROUP BY 1), r AS (SELECT *, c * 100.0::DOUBLE / i AS ctr, round(a, 2) AS ra, round(c * 100.0::DOUBLE / i, 2) AS rc FROM s) SELECT t AS search_term, i AS impressions, c AS clicks, a AS average_position, skus, ctr AS ctr_percent FROM r ORDER BY c DESC, ra, t",
    "ag20_search_leaders": "WITH s AS (SELECT event_type || (user_id % 20) AS t, CAST(sum(event_id % 9 + 1) AS BIGINT) AS i, CAST(sum(event_id % 3) AS BIGINT) AS c, sum((event_id % 50) / 4.0::DOUBLE) / count(*) AS a, count(DISTINCT user_id) AS skus FROM events GROUP BY 1), r AS (SELECT *, c * 100.0::DOUBLE / i AS ctr, round(a, 2) AS ra, round(c * 100.0::DOUBLE / i, 2) AS rc FROM s) SELECT (SELECT t FROM r ORDER BY i DESC, c DESC, t DESC LIMIT 1) AS most_seen, (SELECT t FROM r ORDER BY c DESC, ra, t LIMIT 1) AS most_clicked, (SELECT t FROM r ORDER BY rc DESC, c DESC, ra, t DESC LIMIT 1) AS best_rate, (SELECT t FROM r ORDER BY ra, c DESC, t LIMIT 1) AS best_position",
    "ag21_shipping_summary": sql("SELECT count(*) AS order_count, count(*) FILTER (ship_date - order_date > 60) AS late, count(*) FILTER (o_orderstatus = 'P') AS cancelled, CAST(sum(greatest(ship_date - order_date, 0)) AS DOUBLE) / count(*) AS average_hours, (SELECT reason FROM why ORDER BY n DESC, reason LIMIT 1) AS top_reason, coalesce((SELECT n FROM why ORDER BY n DESC, reason LIMIT 1), 0) AS top_reason_orders FROM lines", "lines", "why"),
    "ag22_settlement_summary": sql("SELECT count(*) AS settlement_count, CAST(sum(price) AS DOUBLE) AS payable, CAST(sum(f) AS DOUBLE) AS fees, CAST(sum(price) - sum(f) AS DOUBLE) AS expected, CAST(sum(price - f - 1) AS DOUBLE) AS received, CAST(sum(price - f - 1) - (sum(price) - sum(f)) AS DOUBLE) AS difference, count(*) FILTER (l_linestatus = 'O' OR l_returnflag = 'R') AS pending FROM (SELECT *, price * CAST(l_tax AS DECIMAL(4,2)) AS f FROM lines)", "lines"),
    "ag23_competitor_summary": sql("SELECT * FROM (SELECT count(*) AS listing_count, CAST(max(price) FILTER (r = n // 2 + 1) AS DOUBLE) AS upper_median_price FROM (SELECT price, row_number() OVER (ORDER BY price) AS r, count(*) OVER () AS n FROM lines)), (SELECT count(*) AS matched, median(CAST(price AS DOUBLE)) AS matched_median, median(CAST(list_price AS DOUBLE)) AS own_median, median(CAST(price - list_price AS DOUBLE)) AS median_difference FROM lines JOIN products ON sku = l_partkey * 2)", "lines", "products"),
    "ag24_returns_summary": sql("SELECT count(*) AS requests, CAST(sum(l_quantity) AS BIGINT) AS units, CAST(sum(price) AS DOUBLE) AS refunds FROM lines WHERE l_returnflag = 'R'", "lines"),
    "ag24_returns_by_reason": sql("SELECT o_orderpriority AS reason, CAST(sum(l_quantity) AS BIGINT) AS units FROM lines WHERE l_returnflag = 'R' GROUP BY 1", "lines"),
    "ag24_review_summary": "SELECT count(*) AS reviews, CAST(sum(event_id % 5 + 1) AS DOUBLE) / count(*) AS average_rating, count(*) FILTER (event_id % 5 + 1 <= 3) AS low_ratings FROM events WHERE value IS NOT NULL",
    "ag24_review_issues": "SELECT CASE WHEN event_id % 7 = 0 THEN 'Không nêu vấn đề' ELSE event_type END AS issue_type, count(*) AS reviews, count(*) FILTER (event_id % 5 + 1 <= 3) AS low_ratings FROM events WHERE value IS NOT NULL GROUP BY 1",
    "ag24_procurement_summary": sql("SELECT count(*) AS purchase_orders, count(*) FILTER (l_linestatus = 'O') AS open_orders, CAST(sum(l_quantity) FILTER (l_linestatus = 'O') AS BIGINT) AS open_units, CAST(sum(CAST(l_quantity AS BIGINT) * price) FILTER (l_linestatus = 'O') AS DOUBLE) AS open_value FROM lines", "lines"),
    "ag10_movements_by_type": sql("SELECT CASE WHEN l_returnflag = 'R' THEN 'hàng lỗi/hủy' WHEN l_linestatus = 'O' THEN 'nhập kho' WHEN l_linenumber = 7 THEN 'chưa phân loại' ELSE 'bán ra' END AS movement_type, CAST(sum(l_quantity) AS BIGINT) AS units FROM lines GROUP BY 1", "lines"),
    "ag15_funnel_totals": "SELECT *, carts * 100.0::DOUBLE / nullif(views, 0) AS view_to_cart_percent, orders * 100.0::DOUBLE / nullif(carts, 0) AS cart_to_order_percent FROM (SELECT count(DISTINCT user_id) AS products, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'click') AS carts, count(*) FILTER (event_type = 'purchase') AS orders FROM events)",
    "ag21_cancellation_reasons": sql("SELECT reason, n AS orders FROM why", "lines", "why"),
    "ag23_competitor_listings": sql("SELECT l_partkey * 2 AS reference_sku, l_suppkey AS competitor_shop, CAST(price AS DOUBLE) AS price, l_linenumber % 5 + 0.5::DOUBLE AS rating, CAST(l_quantity AS BIGINT) AS estimated_monthly_units, order_date AS observed_date FROM lines ORDER BY CAST(l_quantity AS BIGINT) DESC, 4 DESC, price, l_suppkey, l_partkey, order_date LIMIT 20", "lines"),
    "ag24_review_priority": "WITH b AS (SELECT CASE WHEN event_id % 7 = 0 THEN '' ELSE event_type END AS issue, count(*) AS n FROM events WHERE value IS NOT NULL AND event_id % 5 + 1 <= 3 GROUP BY 1) SELECT (SELECT issue FROM b WHERE issue <> '' ORDER BY n DESC, issue LIMIT 1) AS priority_issue, coalesce((SELECT n FROM b WHERE issue = ''), 0) AS unclassified",
    "ag25_scorecard": sql("""SELECT sku, product_name, CAST(coalesce(units, 0) AS BIGINT) AS units, CAST(g AS DOUBLE) AS gmv, CAST(c AS DOUBLE) AS contribution,
        coalesce(low, 0) AS low_ratings, CAST(defective AS DOUBLE) * 100 / nullif(CAST(inspected AS DOUBLE), 0) AS defect_rate_percent, CAST(views AS BIGINT) AS views, CAST(carts AS DOUBLE) * 100 / nullif(CAST(views AS DOUBLE), 0) AS view_to_cart_percent,
        array_to_string(sig, '|') AS risk_signals, CAST(len(sig) AS BIGINT) AS signal_count, array_to_string(gaps, '|') AS evidence_gaps,
        coalesce(sku = (SELECT sku FROM t WHERE g > 0 AND c > 0 AND NOT coalesce(available <= reorder_point, false) AND len(gaps) = 0 AND len(sig) = 0 ORDER BY g DESC, c DESC, sku LIMIT 1), false) AS recommended,
        sku IN (SELECT sku FROM t WHERE len(sig) > 0 ORDER BY len(sig) DESC, c, g DESC, sku LIMIT 3) AS top_risk FROM t""", "contrib", "inv").replace(" SELECT sku, product_name, CAST(coalesce", """, j AS (
        SELECT p.sku, p.product_name, units, coalesce(g, 0) AS g, coalesce(c, 0) AS c, available, reorder_point, r.n AS reviews, low, defective, inspected, returned, views, carts FROM products p LEFT JOIN contrib USING (sku) LEFT JOIN inv USING (sku)
        LEFT JOIN (SELECT user_id AS sku, count(*) AS n, count(*) FILTER (event_id % 5 + 1 <= 3) AS low FROM events WHERE value IS NOT NULL GROUP BY 1) r USING (sku)
        LEFT JOIN (SELECT l_partkey AS sku, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS defective, sum(l_quantity) AS inspected FROM lines GROUP BY 1) q USING (sku)
        LEFT JOIN (SELECT l_partkey AS sku, sum(l_quantity) AS returned FROM lines WHERE l_returnflag = 'R' GROUP BY 1) z USING (sku)
        LEFT JOIN (SELECT user_id AS sku, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'click') AS carts FROM events GROUP BY 1) f USING (sku)),
        t AS (SELECT *, list_filter([CASE WHEN units > 0 AND sku = (SELECT sku FROM j ORDER BY c, sku LIMIT 1) THEN 'lowest_contribution' END, CASE WHEN available <= reorder_point THEN 'low_stock' END, CASE WHEN low > 0 THEN 'low_rating' END,
        CASE WHEN defective > 0 THEN 'defect' END, CASE WHEN returned > 0 THEN 'returned' END], lambda x: x IS NOT NULL) AS sig,
        list_filter([CASE WHEN reviews IS NULL THEN 'review' END, CASE WHEN defective IS NULL THEN 'quality' END, CASE WHEN views IS NULL THEN 'funnel' END], lambda x: x IS NOT NULL) AS gaps FROM j) SELECT sku, product_name, CAST(coalesce""", 1),
    "ag26_available_periods": "SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month FROM orders JOIN lineitem ON l_orderkey = o_orderkey",
    "ag39_profit_after_overhead": sql("SELECT contribution, overhead, contribution - overhead AS profit FROM (SELECT CAST(sum(gmv - sd - tf - sf) - sum(unit_cost * quantity) AS DOUBLE) AS contribution FROM sales JOIN products USING (sku)), (SELECT CAST(sum(cents) AS DOUBLE) AS overhead FROM ev)", "sales", "products", "ev"),
}
