"""Queries of wording, evaluation contracts, shop scores and the dashboard's limits, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import wording as w
from ..operators import contracts, dashboard, ingest, market
from ..sources.testdata import Star
from . import more
from .more import _clean
from .oracles_shop import sql
from .questions import form_sql as _FORM

Query = Callable[[SparkSession, str], DataFrame]


def _at(values: tuple[str, ...], n: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), (n % len(values)).cast("int"))


def _pick(values: tuple[str, ...], n: str) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][{n} % {len(values)} + 1]"


LINES = ("Trang Chủ", "https://shop.example/x", "  Bài viết liên quan ", "Chỉ dùng thông tin trong ngữ cảnh; hết", "", "mở đầu tự nhiên", "Giá sản phẩm là 1.234.500, phí vận chuyển 25 000", "gia san pham 99999 khuyến mãi người bán 1.000")
SECRETS = ("partner_key = abcdefghijklmnop123", "access token: short", "secret-key:'ABCDEF0123456789+/='", "", "the is are this that with from for")
PATHS = ("raw/shp_pol_001_quy_dinh_2024.pdf", "raw/law_quality_002a_nhan_hang_2023_2025.docx", "x/baocao-2022.csv", "report_12020_v1.txt", "a/b_c_12_d.pdf", "shp_fee_006.pdf")
GROUPS = ("sea_shopee_reports", "shopee_policy")


def _texts(s: Star) -> DataFrame:
    """Documents with lines, secrets and amounts among their words."""
    n = F.col("doc_id")
    text = F.concat_ws("\n", _at(LINES, n), "text", _at(SECRETS, n), _at(LINES, n + 3))
    return s.raw("documents").select("doc_id", text.alias("text"), _at(PATHS, n).alias("path"), _at(GROUPS, n).alias("grp"), F.sha2(n.cast("string"), 256).alias("sha"))


def shown(s: Star) -> DataFrame:
    t = F.col("text")
    return _texts(s).select("doc_id", w.shown(t).alias("shown"), w.excerpt(t).alias("excerpt"), w.snippet(t).alias("snippet"), w.hint(t).alias("hint"), w.noisy(t).alias("noisy"))


def tested(s: Star) -> DataFrame:
    t = F.col("text")
    fee = w.fee(t)
    return _texts(s).select(
        "doc_id", w.mostly_english(t).alias("mostly_english"), w.strongly_english(t).alias("strongly_english"), w.holds_secret(t).alias("secret"), (F.length(F.trim(t)) > 2000).alias("oversized"),
        fee["base"].cast("long").alias("fee_base"), fee["fee"].cast("long").alias("fee"), w.vnd(fee["fee"]).alias("fee_text"), F.sha2(w.without_leaks(t), 256).alias("without_leaks"),
    )


def file_names(s: Star) -> DataFrame:
    p = F.col("path")
    return _texts(s).select("doc_id", w.file_id(p, F.col("grp"), F.col("sha")).alias("file_id"), w.file_title(p).alias("title"), w.file_year(p).alias("year"), w.group_language(F.col("grp")).alias("lang"), F.array_join(w.parsed_list(F.col("path"), "_"), "|").alias("parts"))


def dates(s: Star) -> DataFrame:
    """Order dates in the forms that sheets have them, read back."""
    n, d = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    forms = F.get(F.array(F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "M/d/yyyy"), F.date_format(d, "d/M/yyyy"), F.date_format(d, "yyyyMMdd"), F.lit("31/02/2025"), F.lit(" "), F.date_format(d, "MM/yyyy"), F.date_format(d, "yyyy-MM")), (n % 8).cast("int"))
    return s.raw("orders").select(n.alias("order_id"), forms.alias("raw")).select("order_id", "raw", ingest.to_date(F.col("raw")).alias("date"), ingest.to_month(F.col("raw")).alias("month"))


def _sheet(s: Star) -> DataFrame:
    """Line items as a sheet of promotions, all text, with what people get wrong."""
    n, k = F.col("l_orderkey") * 10 + F.col("l_linenumber"), F.col("l_quantity").cast("long")
    return s.raw("lineitem").select(
        n.alias("_row"), F.when(n % 13 == 0, "31/31/2025").otherwise(F.col("l_shipdate").cast("date").cast("string")).alias("date"), F.when(n % 17 == 0, " ").otherwise(F.col("l_partkey").cast("string")).alias("sku"),
        F.when(n % 19 == 0, "x").otherwise(k.cast("string")).alias("list_price_vnd"), F.when(n % 5 == 0, (k + 1).cast("string")).otherwise((k - 1).cast("string")).alias("final_price_vnd"),
        F.when(n % 7 == 0, "-1").otherwise("0").alias("seller_discount_vnd"), F.lit("v").alias("voucher_source"), F.lit("c").alias("campaign_name"),
    )


def sheet_errors(s: Star) -> DataFrame:
    return ingest.errors(_sheet(s), "price_promotions")


def _values(s: Star) -> DataFrame:
    """Cash movements with directions and states as people write them."""
    n = F.col("o_orderkey")
    directions = ("Tiền thu", "thu", "TIỀN CHI", "chi ", "chuyển")
    return s.raw("orders").select(n.cast("string").alias("Cash flow ID"), F.lit("2025-01-02").alias("date"), _at(directions, n).alias("Direction"), F.lit("c").alias("category"), F.lit("1").alias("amount_vnd"), F.lit("r").alias("reference"), F.lit("n").alias("note"))


def sheet_values(s: Star) -> DataFrame:
    return ingest.prepare(_values(s), "cash_flow").select(F.col("cash_flow_id").cast("long").alias("id"), "direction")


def _found(s: Star) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ten results of each of the benchmark's questions, among them some that are expected, on some expected pages."""
    n, r = F.col("item_id"), F.col("rank")
    results = s.raw("benchmark").select(n, F.explode(F.sequence(F.lit(1), F.lit(10))).alias("rank")).select(n.alias("query_id"), r.cast("long").alias("rank"), ((n * 7 + r * (n % 3)) % 23).alias("doc_id"), ((n + r) % 4).cast("string").alias("page"))
    expected = s.raw("benchmark").select(n.alias("query_id"), F.explode(F.array(n % 23, (n * 7 + 4) % 23)).alias("doc_id"))
    pages = s.raw("benchmark").filter("item_id % 3 <> 0").select(n.alias("query_id"), (n % 5).cast("string").alias("page"))
    return results, expected, pages


def document_metrics(s: Star) -> DataFrame:
    return contracts.document_metrics(*_found(s))


def error_classes(s: Star) -> DataFrame:
    return contracts.classified(document_metrics(s))


def _runs(s: Star) -> DataFrame:
    """A run for each label: what was expected and what came, differing by its number."""
    n = F.col("doc_id")
    tools = lambda a, b: F.array_compact(F.array(F.when(a, "shop_data"), F.when(b, "rag")))
    trace = F.array(F.struct(F.lit("shop_data").alias("tool"), F.when(n % 9 == 0, "error").otherwise("ok").alias("status")), F.struct(F.lit("rag").alias("tool"), F.lit("ok").alias("status")))
    answer = F.concat_ws(" ", F.when(n % 6 != 0, "Dữ liệu vận hành mô phỏng"), F.when(n % 4 == 0, "Ngoài phạm vi"), F.concat(F.lit("GMV "), (n % 10).cast("string")))
    return s.raw("labels").select(
        n.alias("id"), _at(("dev", "Test", " challenge"), n).alias("split"), F.when(n % 4 == 0, "out_of_scope").otherwise("policy_rag").alias("expected_intent"), F.when(n % 11 == 0, "casual").when(n % 4 == 0, "out_of_scope").otherwise("policy_rag").alias("intent"),
        tools(n % 2 == 1, n % 3 == 1).alias("expected_tools"), tools(n % 2 == 1, n % 6 == 1).alias("tools"), F.when(n % 5 == 0, "2026-08").alias("expected_period"), F.when(n % 10 == 0, "2026-08").alias("period"),
        F.when(n % 3 == 1, F.array(F.lit(" D1 "), F.lit(""))).alias("expected_documents"), F.when(n % 3 == 1, F.array(F.when(n % 7 == 0, "D2").otherwise("D1"))).otherwise(F.array().cast("array<string>")).alias("cited_documents"),
        F.when(n % 5 == 1, F.array(F.lit("gmv 1"), F.lit(" "))).alias("expected_markers"), answer.alias("answer"), F.when(n % 4 != 0, trace).alias("trace"), (F.col("quality") == 1).alias("verified"), (n % 100 / 100.0).alias("latency"),
    )


def contract(s: Star) -> DataFrame:
    return contracts.contract(_runs(s))


def contract_summary(s: Star) -> DataFrame:
    return contracts.contract_summary(contracts.contract(_runs(s)))


def candidate_chunks(s: Star) -> DataFrame:
    d = s.raw("documents").select(F.concat(_at(("SHP_FEE_", "LAW_", "SHP_API_"), F.col("doc_id")), (F.col("doc_id") % 50).cast("string")).alias("document_id"), F.col("doc_id").alias("chunk_index"), "text")
    c = contracts.candidate_chunks(d, {"fees": ("SHP_FEE",), "shop": ("SHP_",), "law": ("LAW_",)})
    return contracts.first_documents(c).unionByName(c.groupBy("category").agg(F.count("*").alias("place"), F.lit("all").alias("document_id")))


def readiness(s: Star) -> DataFrame:
    return contracts.readiness(s.raw("labels").select(_at(("dev", " Test"), F.col("doc_id")).alias("split"), (F.col("quality") == 1).alias("gold_verified")), True)


def unknown_citations(s: Star) -> DataFrame:
    n = F.col("doc_id")
    items = s.raw("labels").select(n.alias("id"), F.array(n.cast("string"), F.concat(F.lit(" "), (n * 3).cast("string")), F.lit("")).alias("expected_documents"))
    return contracts.unknown_citations(items, s.raw("documents").select(n.cast("string").alias("document_id")))


def repeated_keys(s: Star) -> DataFrame:
    return contracts.repeated_keys(s.raw("lineitem"), "l_orderkey")


def _listings(s: Star) -> tuple[DataFrame, DataFrame]:
    listings = s["lines"].select(F.col("l_suppkey").alias("shop"), F.col("l_partkey").alias("product"), F.floor("l_extendedprice").cast("long").alias("price"), F.col("l_quantity").cast("long").alias("units"))
    k = F.col("s_suppkey")
    return listings, s.raw("supplier").select(k.alias("shop"), (F.lit(4.0) + (k % 10) / 10.0).alias("rating"), (k % 50 + 45).alias("longevity"))


def shop_scores(s: Star) -> DataFrame:
    return market.shop_scores(*_listings(s))


def listing_scores(s: Star) -> DataFrame:
    listings, shops = _listings(s)
    return market.listing_scores(listings, shops).groupBy("shop").agg(F.max("product_score").alias("best"), F.count("*").alias("listings"))


def shop_advice(s: Star) -> DataFrame:
    listings, shops = _listings(s)
    return market.advice(market.shop_scores(listings, shops), shops, 1)


def stock_totals(s: Star) -> DataFrame:
    return market.stock_totals(more.stock_risk(s))


MONTHS, CATEGORIES = ["1996-02", "1997-11", "2024-02"], ["SMALL", "PROMO"]


def dashboard_rows(s: Star) -> DataFrame:
    """How many rows of each of the dashboard's tables are left."""
    out = None
    for table, rows in dashboard.limited(s, CATEGORIES, MONTHS).items():
        n = rows.agg(F.count("*").alias("rows")).select(F.lit(table).alias("table"), "rows")
        out = n if out is None else out.unionByName(n)
    return out


def _of(f: Callable[[Star], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(Star(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "str05_shown_texts": _of(shown), "str18_text_tests": _of(tested), "str13_file_names": _of(file_names), "ing05_dates": _of(dates), "val02_sheet_errors": _of(sheet_errors), "ing04_values": _of(sheet_values),
    "ev01_document_metrics": _of(document_metrics), "ev07_error_classes": _of(error_classes), "ev06_contract": _of(contract), "ev06_contract_summary": _of(contract_summary), "ev13_candidate_chunks": _of(candidate_chunks),
    "aud05_readiness": _of(readiness), "jn09_unknown_citations": _of(unknown_citations), "ag44_repeated_keys": _of(repeated_keys), "mk05_shop_scores": _of(shop_scores), "mk05_listing_scores": _of(listing_scores),
    "ag38_shop_advice": _of(shop_advice), "ag37_stock_totals": _of(stock_totals), "flt08_dashboard_rows": _of(dashboard_rows),
}

_T = f"""t AS (SELECT doc_id, concat_ws(chr(10), {_pick(LINES, "doc_id")}, text, {_pick(SECRETS, "doc_id")}, {_pick(LINES, "(doc_id + 3)")}) AS text, {_pick(PATHS, "doc_id")} AS path, {_pick(GROUPS, "doc_id")} AS grp, sha256(CAST(doc_id AS VARCHAR)) AS sha FROM documents)"""
_STRIP = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _last(x: str, mark: str) -> str:
    m = "chr(10)" if mark == "\n" else f"'{mark}'"
    return f"CASE WHEN instr(reverse({x}), reverse({m})) > 0 THEN length({x}) - instr(reverse({x}), reverse({m})) - {len(mark) - 1} ELSE -1 END"


_KEPT = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: {_STRIP('x')}), lambda x: x NOT IN ({', '.join(repr(x) for x in w.MENU_LINES)}) AND NOT starts_with(x, 'http://') AND NOT starts_with(x, 'https://'))"
_WHOLE = _STRIP(f"regexp_replace(array_to_string({_KEPT}, chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g')")
_ONE_LINE = "trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ')"
_NOISY = _FORM("text")
for _a, _b in w.NOISE.items():
    _NOISY = f"replace({_NOISY}, '{_a}', '{_b}')"
_NUMBER = lambda label: f"nullif(regexp_replace(regexp_extract(replace(text, chr(10), ' '), '(?i){label}.{{0,30}}?(\\d{{1,3}}(?:[.\\s,]\\d{{3}})+|\\d+)', 1), '[^0-9]', '', 'g'), '')"
_AMOUNT = {name: f"TRY_CAST(coalesce({', '.join(_NUMBER(x) for x in labels)}) AS BIGINT)" for name, labels in w.FEE_PARTS.items()}
_WORDS_OF = lambda words: "len(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda x: x IN (" + ", ".join(repr(x) for x in words) + ")))"
_MARKS = f"len(regexp_extract_all(lower(text), '[{w.VIETNAMESE_LETTERS}]'))"

ORACLES = {
    "str05_shown_texts": f"""WITH {_T}, a AS (SELECT doc_id, text, {_WHOLE} AS whole, {_ONE_LINE} AS line, {_clean("text")} AS cl FROM t),
        b AS (SELECT *, left(whole, 1200) AS c1, left(cl, 360) AS c2 FROM a), c AS (SELECT *, greatest({_last("c1", ". ")}, {_last("c1", chr(10))}, {_last("c1", "; ")}) AS p1, greatest({_last("c2", ". ")}, {_last("c2", "; ")}, {_last("c2", ": ")}, {_last("c2", " ")}) AS p2 FROM b)
        SELECT doc_id, CASE WHEN length(whole) <= 1200 THEN whole ELSE regexp_replace(CASE WHEN p1 > 660 THEN substr(c1, 1, p1 + 1) ELSE c1 END, '\\s+$', '') || '...' END AS shown,
        regexp_replace(left(line, 480), '\\s+$', '') || CASE WHEN length(line) > 480 THEN '...' ELSE '' END AS excerpt,
        CASE WHEN length(cl) <= 360 THEN cl ELSE regexp_replace(CASE WHEN p2 > 198 THEN substr(c2, 1, p2) ELSE c2 END, '[ .,;:]+$', '') || '...' END AS snippet,
        coalesce(nullif(array_to_string(list_filter(regexp_extract_all(text, '[0-9A-Za-zÀ-ỹ_/%.-]+'), lambda x: length(x) >= 4 AND NOT regexp_full_match(x, '[0-9]+'))[1:8], ' '), ''), 'đoạn này') AS hint, {_NOISY} AS noisy FROM c""",
    "str18_text_tests": f"""WITH {_T}, a AS (SELECT *, {_WORDS_OF(w.ENGLISH)} AS e, {_WORDS_OF(w.VIETNAMESE)} AS v, {", ".join(f"{x} AS {n}" for n, x in _AMOUNT.items())} FROM t),
        b AS (SELECT *, e >= 5 AND e > v * 1.5::DOUBLE AS me, CASE WHEN product_price IS NOT NULL THEN CAST(product_price AS HUGEINT) + coalesce(shipping_fee, 0) - coalesce(seller_discount, 0) - coalesce(bank_discount, 0) END AS base FROM a),
        c AS (SELECT *, CAST(round_even(CAST(base AS DOUBLE) * 6 / 100, 0) AS BIGINT) AS f FROM b)
        SELECT doc_id, me AS mostly_english, me OR (len(regexp_extract_all(text, '[A-Za-z]+')) >= 20 AND {_MARKS} < 3) AS strongly_english, regexp_matches(text, '(?i)\\b(partner[_\\s-]?key|access[_\\s-]?token|secret[_\\s-]?key)\\b\\s*[:=]\\s*["'']?([a-z0-9_\\-./+=]{{16,}})') AS secret,
        length(trim(text, ' ')) > 2000 AS oversized, CAST(base AS BIGINT) AS fee_base, f AS fee, replace(format('{{:,}}', f), ',', '.') || ' VND' AS fee_text,
        sha256({_STRIP("regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT (" + " OR ".join(f"starts_with({_FORM('x')}, '{p}')" for p in w.LEAKED) + ")), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g')")}) AS without_leaks FROM c""",
    "str13_file_names": f"""WITH {_T}, v(path, file_id, title, year) AS (VALUES ('{PATHS[0]}', 'SHP_POL_001', 'Quy dinh 2024', '2024'), ('{PATHS[1]}', 'LAW_QUALITY_002A', 'Nhan hang 2023 2025', '2025'), ('{PATHS[2]}', NULL, 'Baocao-2022', '2022'),
        ('{PATHS[3]}', NULL, 'Report 12020 v1', ''), ('{PATHS[4]}', NULL, 'B c 12 d', ''), ('{PATHS[5]}', 'SHP_FEE_006', 'Shp fee 006', ''))
        SELECT doc_id, coalesce(file_id, upper(grp || '_' || left(sha, 10))) AS file_id, title, year, CASE WHEN grp = 'sea_shopee_reports' THEN 'en' ELSE 'vi' END AS lang, array_to_string(list_filter(string_split(path, '_'), lambda x: trim(x) <> ''), '|') AS parts FROM t JOIN v USING (path)""",
    "ing05_dates": """WITH d AS (SELECT o_orderkey AS order_id, CAST(o_orderdate AS DATE) AS d FROM orders), r AS (SELECT *, [strftime(d, '%Y-%m-%d'), strftime(d, '%-m/%-d/%Y'), strftime(d, '%-d/%-m/%Y'), strftime(d, '%Y%m%d'), '31/02/2025', ' ', strftime(d, '%m/%Y'), strftime(d, '%Y-%m')][order_id % 8 + 1] AS raw FROM d),
        p AS (SELECT *, CASE WHEN order_id % 8 IN (0, 1, 3) THEN d WHEN order_id % 8 = 2 THEN CASE WHEN day(d) <= 12 THEN make_date(year(d), day(d), month(d)) ELSE d END END AS date FROM r)
        SELECT order_id, raw, date, CASE WHEN order_id % 8 IN (6, 7) THEN strftime(d, '%Y-%m') ELSE strftime(date, '%Y-%m') END AS month FROM p""",
    "val02_sheet_errors": """WITH n AS (SELECT l_orderkey * 10 + l_linenumber AS n FROM lineitem) SELECT n AS row, CASE WHEN n % 13 = 0 THEN 'date: not a value of its type' WHEN n % 17 = 0 THEN 'sku: blank' WHEN n % 19 = 0 THEN 'list_price_vnd: not a value of its type'
        WHEN n % 5 <> 0 AND k = 0 THEN 'final_price_vnd: below 0' WHEN n % 7 = 0 THEN 'seller_discount_vnd: below 0' ELSE 'final_price_vnd <= list_price_vnd' END AS reason
        FROM (SELECT l_orderkey * 10 + l_linenumber AS n, CAST(l_quantity AS BIGINT) AS k FROM lineitem) WHERE n % 13 = 0 OR n % 17 = 0 OR n % 19 = 0 OR (n % 5 <> 0 AND k = 0) OR n % 7 = 0 OR n % 5 = 0""",
    "ing04_values": "SELECT o_orderkey AS id, ['thu', 'thu', 'chi', 'chi', 'chuyển'][o_orderkey % 5 + 1] AS direction FROM orders",
    "ev01_document_metrics": """WITH r AS (SELECT item_id AS q, k AS rank, (item_id * 7 + k * (item_id % 3)) % 23 AS d, CAST((item_id + k) % 4 AS VARCHAR) AS page FROM benchmark, range(1, 11) t(k)), e AS (SELECT DISTINCT item_id AS q, unnest([item_id % 23, (item_id * 7 + 4) % 23]) AS d FROM benchmark),
        pg AS (SELECT item_id AS q, CAST(item_id % 5 AS VARCHAR) AS page FROM benchmark WHERE item_id % 3 <> 0), f AS (SELECT q, d, row_number() OVER (PARTITION BY q ORDER BY min(rank), d) AS place FROM r GROUP BY q, d), n AS (SELECT q, count(*) AS n FROM e GROUP BY q),
        h AS (SELECT r.q, min(rank) AS best, count(*) FILTER (rank <= 5 AND r.page = pg.page) AS onp FROM r JOIN e ON r.q = e.q AND r.d = e.d LEFT JOIN pg ON pg.q = r.q GROUP BY r.q), u AS (SELECT f.q, count(*) FILTER (place <= 5) AS u FROM f JOIN e ON f.q = e.q AND f.d = e.d GROUP BY f.q)
        SELECT n.q AS query_id, CAST(coalesce(best = 1, false) AS INTEGER) AS hit_at_1, CAST(coalesce(best <= 5, false) AS INTEGER) AS hit_at_5, CAST(coalesce(best <= 10, false) AS INTEGER) AS hit_at_10, coalesce(u, 0) / CAST(n AS DOUBLE) AS unique_document_recall_at_5,
        CASE WHEN n.q % 3 <> 0 THEN CAST(coalesce(onp > 0, false) AS INTEGER) END AS page_hit_at_5, n AS expected_documents FROM n LEFT JOIN h USING (q) LEFT JOIN u USING (q)""",
    "ev06_contract": """WITH l AS (SELECT doc_id AS n, quality = 1 AS verified FROM labels), c AS (SELECT n, ['dev', 'test', 'challenge'][n % 3 + 1] AS split, n % 11 <> 0 AS intent_correct, (n % 3 = 1) = (n % 6 = 1) AS plan_tools_correct,
        NOT (n % 4 = 0 AND (n % 2 = 1 OR n % 3 = 1)) AND NOT (n % 4 <> 0 AND n % 2 = 1 AND n % 9 = 0) AS tools_executed, true AS citations_correct, n % 3 <> 1 OR n % 7 <> 0 AS citation_document_correct, true AS answer_marker_correct,
        n % 2 <> 1 OR n % 6 <> 0 AS disclaimer_correct, true AS refusal_correct, n % 5 <> 0 OR n % 10 = 0 AS period_correct, NOT (n % 4 <> 0 AND n % 9 = 0) AS no_trace_error, n % 3 = 1 AS documents_apply, n % 5 = 1 AS markers_apply, verified, n % 100 / 100.0::DOUBLE AS latency FROM l),
        m AS (SELECT * REPLACE (n % 5 <> 1 OR n % 10 = 1 AS answer_marker_correct) FROM c)
        SELECT n AS id, * EXCLUDE (n), intent_correct AND plan_tools_correct AND tools_executed AND citations_correct AND citation_document_correct AND answer_marker_correct AND disclaimer_correct AND refusal_correct AND period_correct AND no_trace_error AS overall_pass FROM m""",
    "ev13_candidate_chunks": f"""WITH d AS (SELECT ['SHP_FEE_', 'LAW_', 'SHP_API_'][doc_id % 3 + 1] || (doc_id % 50) AS document_id, {_clean("coalesce(text, '')")} AS text FROM documents), g AS (SELECT * FROM d WHERE length(text) >= 180 AND len(regexp_extract_all(text, '\\.\\.\\.')) <= 8),
        c AS (SELECT 'fees' AS category, document_id FROM g WHERE starts_with(document_id, 'SHP_FEE') UNION ALL SELECT 'shop', document_id FROM g WHERE starts_with(document_id, 'SHP_') UNION ALL SELECT 'law', document_id FROM g WHERE starts_with(document_id, 'LAW_'))
        SELECT category, place, document_id FROM (SELECT category, document_id, row_number() OVER (PARTITION BY category ORDER BY document_id) AS place FROM (SELECT DISTINCT * FROM c)) WHERE place <= 3 UNION ALL SELECT category, count(*), 'all' FROM c GROUP BY category""",
    "aud05_readiness": "SELECT *, CASE WHEN verified = total THEN 'PASS' ELSE 'BLOCK' END AS status FROM (SELECT count(*) AS total, count(*) FILTER (quality = 1) AS verified, count(*) FILTER (doc_id % 2 = 1) AS test, count(*) FILTER (quality = 1 AND doc_id % 2 = 1) AS verified_test FROM labels)",
    "jn09_unknown_citations": "SELECT doc_id AS id, CAST(doc_id * 3 AS VARCHAR) AS document_id FROM labels WHERE doc_id * 3 NOT IN (SELECT doc_id FROM documents) UNION SELECT doc_id, CAST(doc_id AS VARCHAR) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)",
    "ag44_repeated_keys": "SELECT CAST(l_orderkey AS VARCHAR) AS key, count(*) AS times FROM lineitem GROUP BY 1 HAVING count(*) > 1",
}
ORACLES["ev07_error_classes"] = f"""WITH m AS ({ORACLES["ev01_document_metrics"]}), c AS (SELECT query_id, CASE WHEN hit_at_5 = 0 THEN CASE WHEN hit_at_10 = 1 THEN 1 ELSE 0 END WHEN expected_documents > 1 AND unique_document_recall_at_5 < 1 THEN 2 WHEN page_hit_at_5 = 0 THEN 3 WHEN hit_at_1 = 0 THEN 4 ELSE 5 END AS p FROM m)
    SELECT query_id, [{", ".join(repr(c) for c in contracts.CLASSES)}][p + 1] AS error_class, CAST(p AS INTEGER) AS priority FROM c"""
ORACLES["ev06_contract_summary"] = f"""WITH m AS ({ORACLES["ev06_contract"]}) SELECT count(*) AS items, {", ".join(f"count(*) FILTER ({c}) / CAST(count(*) AS DOUBLE) AS {c}" for c in ("overall_pass", *(c for c in contracts.CHECKS if c not in ("citation_document_correct", "answer_marker_correct"))))},
    count(*) FILTER (documents_apply AND citation_document_correct) / CAST(count(*) FILTER (documents_apply) AS DOUBLE) AS citation_document_correct, count(*) FILTER (markers_apply AND answer_marker_correct) / CAST(count(*) FILTER (markers_apply) AS DOUBLE) AS answer_marker_correct,
    count(*) FILTER (documents_apply) AS document_checks, count(*) FILTER (markers_apply) AS marker_checks, median(latency) AS latency_median, quantile_disc(latency, 0.95) AS latency_p95, count(*) FILTER (verified) AS verified FROM m"""

_SHOPS = "ls AS (SELECT l_suppkey AS shop, l_partkey AS product, CAST(floor(l_extendedprice) AS BIGINT) AS price, CAST(l_quantity AS BIGINT) AS units FROM lines), sh AS (SELECT s_suppkey AS shop, 4.0::DOUBLE + (s_suppkey % 10) / 10.0::DOUBLE AS rating, s_suppkey % 50 + 45 AS longevity FROM supplier)"
_BY = "bs AS (SELECT shop, count(*) AS listing_count, CAST(sum(units) AS BIGINT) AS units, CAST(sum(price * units) AS BIGINT) AS gmv FROM ls GROUP BY shop), sc AS (SELECT bs.*, rating, longevity, units / CAST(max(units) OVER () AS DOUBLE) * 100 AS v, gmv / CAST(max(gmv) OVER () AS DOUBLE) * 100 AS r FROM bs JOIN sh USING (shop))"
ORACLES |= {
    "mk05_shop_scores": sql("SELECT shop, listing_count, units, gmv, CAST(round_even(gmv / CAST(units AS DOUBLE), 0) AS BIGINT) AS average_price, CAST(least(v, r) * 0.45::DOUBLE + (v + r) / 2 * 0.20::DOUBLE + floor(rating / 5 * 100 * 10 + 0.5::DOUBLE) / 10 * 0.20::DOUBLE + longevity * 0.15::DOUBLE AS DECIMAL(18,6)) AS shop_score FROM sc", "lines").replace(" SELECT shop, listing_count", f", {_SHOPS}, {_BY} SELECT shop, listing_count", 1),
    "mk05_listing_scores": sql("SELECT shop, max(CAST(least(v, r) * 0.50::DOUBLE + (v + r) / 2 * 0.20::DOUBLE + rating / 5 * 100 * 0.30::DOUBLE AS DECIMAL(18,6))) AS best, count(*) AS listings FROM (SELECT shop, rating, units / CAST(max(units) OVER () AS DOUBLE) * 100 AS v, price * units / CAST(max(price * units) OVER () AS DOUBLE) * 100 AS r FROM ls JOIN sh USING (shop)) GROUP BY shop", "lines").replace(" SELECT shop, max", f", {_SHOPS} SELECT shop, max", 1),
    "ag38_shop_advice": sql("SELECT (SELECT shop FROM bs WHERE shop <> 1 ORDER BY gmv DESC, shop LIMIT 1) AS leader, CAST(tp AS DECIMAL(18,4)) AS typical_price, CAST(op - tp AS DECIMAL(18,4)) AS price_gap, CASE WHEN op > tp THEN 'above' WHEN op < tp THEN 'below' ELSE 'near' END AS direction, CAST(ar - orr AS DECIMAL(18,6)) AS rating_gap FROM (SELECT avg(ap) FILTER (shop <> 1) AS tp, max(ap) FILTER (shop = 1) AS op, avg(rating) FILTER (shop <> 1) AS ar, max(rating) FILTER (shop = 1) AS orr FROM (SELECT shop, rating, CAST(round_even(gmv / CAST(units AS DOUBLE), 0) AS BIGINT) AS ap FROM sc))", "lines").replace(" SELECT (SELECT", f", {_SHOPS}, {_BY} SELECT (SELECT", 1),
    "ag37_stock_totals": f"SELECT count(*) FILTER (status IN ('loss', 'idle')) AS no_reorder, count(*) FILTER (order_quantity > 0) AS reorder, CAST(coalesce(sum(capital) FILTER (status IN ('loss', 'idle')), 0) AS BIGINT) AS capital_at_risk, CAST(coalesce(sum(order_budget) FILTER (order_quantity > 0), 0) AS BIGINT) AS suggested_budget FROM ({more.ORACLES['mk08_stock_risk']}) z",
}

_IN = "IN (" + ", ".join(f"'{m}'" for m in MONTHS) + ")"
_SKUS = "IN (SELECT p_partkey FROM part WHERE p_type IN (" + ", ".join(f"'{c}'" for c in CATEGORIES) + "))"
_COUNT = lambda table, source, where: f"SELECT '{table}' AS \"table\", count(*) AS rows FROM {source} WHERE {where}"
_LM = lambda column: f"strftime({column}, '%Y-%m') {_IN}"
ORACLES["flt08_dashboard_rows"] = sql(
    " UNION ALL ".join((
        _COUNT("products", "part", f"p_partkey {_SKUS}"), _COUNT("inventory", "part", f"p_partkey {_SKUS}"), _COUNT("orders", "lines", f"l_partkey {_SKUS} AND {_LM('order_date')}"),
        _COUNT("ads", "(SELECT DISTINCT month, user_id % 5 FROM ev)", f"month {_IN}"), _COUNT("purchase_orders", "lines", f"l_partkey {_SKUS} AND {_LM('order_date')}"), _COUNT("returns", "lines", f"l_returnflag = 'R' AND l_partkey {_SKUS} AND {_LM('ship_date')}"),
        _COUNT("reviews", "ev", f"value IS NOT NULL AND user_id {_SKUS} AND month {_IN}"), _COUNT("operating_costs", "ev", f"month {_IN}"), _COUNT("inventory_movements", "lines", f"l_partkey {_SKUS} AND {_LM('ship_date')}"),
        _COUNT("quality_checks", "lines", f"l_partkey {_SKUS} AND {_LM('ship_date')}"), _COUNT("cash_flow", "lines", _LM("order_date")), "SELECT 'supplier_performance', 0",
        _COUNT("customer_segments", "(SELECT DISTINCT month, c_mktsegment, n > 1 FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_custkey, count(*) AS n FROM orders GROUP BY ALL) JOIN customer ON c_custkey = o_custkey)", f"month {_IN}"),
        _COUNT("product_funnel", "(SELECT DISTINCT month, user_id FROM ev)", f"user_id {_SKUS} AND month {_IN}"),
        _COUNT("co_purchase", "(SELECT DISTINCT x.month, x.sku, y.sku AS paired FROM od x JOIN od y ON x.k = y.k AND x.sku < y.sku)", f"sku {_SKUS} AND paired {_SKUS} AND month {_IN}"),
    )),
    "lines", "ev",
).replace(" SELECT 'products'", ", od AS (SELECT DISTINCT strftime(order_date, '%Y-%m') AS month, l_orderkey AS k, l_partkey AS sku FROM lines) SELECT 'products'", 1)


CONTEXTS = ("Phản hồi trong vòng 3 ngày, người bán", "Trong vòng 12 giờ phải phản hồi", "Danh sách sản phẩm bị cấm 4.1", "a = b", "không có gì", "Người bán có 2 Ngày để phản hồi trong 5 ngày", "5 ngàyx")
ASKED = ("bao lâu", "tỷ lệ bao nhiêu", "công thức", "danh sách bị cấm", "trách nhiệm", "xin chào")


def answerable(s: Star) -> DataFrame:
    """Whether each document answers a question of its number."""
    n = F.col("doc_id")
    d = s.raw("documents").select("doc_id", F.concat_ws(" ", _at(CONTEXTS, n), F.when(n % 3 != 0, F.translate("text", "0123456789=", ""))).alias("context"), w.question_kind(_at(ASKED, n)).alias("kind"))
    return d.select("doc_id", "kind", w.answers(F.col("kind"), F.col("context")).alias("answered"), w.names_deadline(F.col("context")).alias("deadline"))


QUERIES["str21_answerable"] = _of(answerable)
_HAS = lambda view, words: "(" + " OR ".join(f"contains({view}, '{x}')" for x in words) + ")"
ORACLES["str21_answerable"] = f"""WITH d AS (SELECT doc_id, concat_ws(' ', {_pick(CONTEXTS, "doc_id")}, CASE WHEN doc_id % 3 <> 0 THEN regexp_replace(text, '[0-9=]', '', 'g') END) AS c, ['duration', 'number', 'formula', 'list', 'obligation', 'general'][doc_id % 6 + 1] AS kind FROM documents), f AS (SELECT *, {_FORM("c")} AS form FROM d)
    SELECT doc_id, kind, CASE kind WHEN 'duration' THEN regexp_matches(c, '(?i)(^|[^\\p{{L}}\\p{{N}}_])\\d+\\s*(ngày|giờ|tháng|năm)($|[^\\p{{L}}\\p{{N}}_])') OR {_HAS("form", ("trong vong", "thoi han", "moc thoi gian"))} WHEN 'number' THEN regexp_matches(c, '[0-9]')
    WHEN 'formula' THEN contains(c, '=') OR {_HAS("form", ("base_string", "partner_id", "api_path", "cach tinh", "cong thuc", "phi xu ly giao dich", "muc phi"))} WHEN 'list' THEN {_HAS("form", ("danh sach", "bi cam", "khong duoc phep", "4.1", "4.2", "4.3"))} ELSE true END AS answered,
    regexp_matches(c, '(?is)người\\s*bán.{{0,140}}phản\\s*hồi.{{0,80}}\\d+\\s*(ngày|giờ)') OR regexp_matches(c, '(?is)phản\\s*hồi.{{0,80}}\\d+\\s*(ngày|giờ).{{0,140}}người\\s*bán') OR regexp_matches(c, '(?is)trong\\s*vòng\\s*\\d+\\s*(ngày|giờ).{{0,120}}phản\\s*hồi') AS deadline FROM f"""
