"""Queries on documents, vectors, conversations and markets, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import chunking
from ..operators import dashboard as d
from ..operators import evaluation as e
from ..operators import market as m
from ..operators import retrieval as rt
from ..sources.testdata import Star
from .oracles_shop import sql

Query = Callable[[SparkSession, str], DataFrame]


def _docs(s: Star) -> DataFrame:
    return s.raw("documents").select("doc_id", "text")


def _questions(s: Star) -> DataFrame:
    return s.raw("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def _vectors(s: Star) -> DataFrame:
    return s.raw("embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))


def bm25(s: Star) -> DataFrame:
    return rt.bm25(_docs(s), _questions(s))


def dense(s: Star) -> DataFrame:
    first = s.raw("embeddings").groupBy("label").agg(F.min_by("vec_id", "vec_id").alias("query_id"), F.min_by("embedding", "vec_id").alias("vector"))
    return rt.dense(_vectors(s), first.select("query_id", "vector"))


def fusion(s: Star) -> DataFrame:
    q = s.raw("benchmark").select(F.col("item_id").alias("doc_id")).join(_vectors(s), "doc_id").select(F.col("doc_id").alias("query_id"), "vector")
    return rt.fused(rt.dense(_vectors(s), q), rt.bm25(_docs(s), _questions(s)))


def metrics(s: Star) -> DataFrame:
    expected = _docs(s).select((F.col("doc_id") % 40).alias("query_id"), "doc_id")
    return e.ranking_metrics(rt.bm25(_docs(s), _questions(s)), expected)


def summaries(s: Star) -> DataFrame:
    rows = s.raw("events").select(F.col("value").alias("measure"), "event_type", (F.col("user_id") % 7).alias("team"))
    return e.summary(rows, "measure", "event_type", "team")


def classification(s: Star) -> DataFrame:
    rows = s.raw("labels").select(F.col("quality").cast("string").alias("expected"), F.col("toxic").cast("string").alias("predicted"))
    return e.classification(rows, ["0", "1", "2"])


def confusion(s: Star) -> DataFrame:
    rows = s.raw("labels").select(F.col("quality").cast("string").alias("expected"), F.col("toxic").cast("string").alias("predicted"))
    return e.confusion(rows, ["0", "1", "2"])


def tools(s: Star) -> DataFrame:
    two = lambda a, b: F.array_compact(F.array(F.when(a, "rag"), F.when(b, "shop_data")))
    rows = s.raw("labels").select(F.col("doc_id").alias("id"), two(F.col("quality") == 1, F.col("toxic") == 1).alias("expected_tools"), two(F.col("doc_id") % 2 == 0, F.col("doc_id") % 3 == 0).alias("predicted_tools"))
    return e.tool_metrics(rows)


def price_bands(s: Star) -> DataFrame:
    p = s.raw("part").select(F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("price"), "p_size")
    return m.price_band(p.select("brand", "price"), p.filter("p_size > 45").select("brand", "price"), "brand")


def opportunities(s: Star) -> DataFrame:
    sold = s["lines"].groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_quantity").alias("u"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("r"))
    by = s.raw("part").join(sold, "p_partkey").groupBy("p_type").agg(F.sum("u").cast("long").alias("units"), F.sum("r").alias("revenue"), (F.count("*") % 35 + 62).cast("double").alias("fit"), (F.sum("p_size") % 30 + 68).cast("double").alias("reviews"), (F.max("p_size") % 38 + 58).cast("double").alias("longevity"))
    return m.opportunities(by, "p_type")


def what_if(s: Star) -> DataFrame:
    shops = s["lines"].groupBy(F.col("l_suppkey").alias("shop")).agg(F.sum("l_quantity").cast("long").alias("units"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("gmv"))
    return m.what_if(shops, -12, False, 20, 100)


def stock_risk(s: Star) -> DataFrame:
    price = F.floor("p_retailprice").cast("long")
    p = s.raw("part").select(F.col("p_partkey").alias("item"), price.alias("price"), F.floor(price * (58 + F.col("p_partkey") % 39) / 100).cast("long").alias("unit_cost"), F.floor(price * 12 / 100).cast("long").alias("reserve"), (F.col("p_partkey") % 23).cast("double").alias("sold_per_month"), F.col("p_size").cast("long").alias("on_hand"), (F.col("p_partkey") * 29 % 100).alias("idle_days"), (F.col("p_partkey") % 50 + 45).alias("score"))
    return m.stock_risk(p)


def html(s: Star) -> DataFrame:
    return s.raw("pages").select("page_id", t.html_to_text(F.col("html")).alias("text"))


def term_statistics(s: Star) -> DataFrame:
    return rt.term_stats(_docs(s)).select("term", "df", F.col("idf").cast("decimal(18,6)").alias("idf"))


def token_counts(s: Star) -> DataFrame:
    return rt.token_counts(_docs(s))


def matched_forms(s: Star) -> DataFrame:
    return _docs(s).select("doc_id", t.match_form(F.col("text")).alias("form"))


def grouping(s: Star) -> DataFrame:
    s.raw("documents").createOrReplaceTempView("tw_documents")
    return s.spark.sql("SELECT lang, source, count(*) AS documents, sum(n_chars) AS chars FROM tw_documents GROUP BY GROUPING SETS ((), (lang), (source), (lang, source))")


def context(s: Star) -> DataFrame:
    """The turns around the longest of each conversation."""
    c = s.raw("conversations").select(F.col("conv_id").alias("document"), F.col("turn").alias("place"), "text")
    top = c.groupBy("document").agg(F.max_by("place", F.struct(F.length("text"), -F.col("place"))).alias("top"))
    return rt.neighbours(c, top.withColumn("query_id", F.col("document")))


def budget(s: Star) -> DataFrame:
    """Which of these turns fit a budget of characters, as one row for each turn kept."""
    kept = rt.within_budget(context(s), "query_id", "place", "text", chars=1200)
    return kept.select("query_id", F.explode("kept").alias("place"))


def _of(f: Callable[[Star], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(Star(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "flt08_category_sales": _of(lambda s: d.category_sales(s, "SMALL")), "ag30_cost_shares": _of(d.cost_shares), "ag32_product_contribution_top": _of(d.top_products),
    "ag33_monthly_gmv": _of(d.monthly_gmv), "ag34_deductions": _of(d.deductions), "ag36_price_position": _of(d.price_position), "jn07_never_sold": _of(d.never_sold),
    "aud02_duplicates": _of(lambda s: d.duplicates(s.raw("documents"), "doc_id", "text")), "wn12_previous_user_turn": _of(lambda s: d.previous_user_turn(s.raw("conversations"))),
    "wn13_last_turns": _of(lambda s: d.last_turns(s.raw("conversations"))), "tk05_strong_hits": _of(lambda s: d.strong_hits(bm25(s))),
    "ret01_bm25": _of(bm25), "ret02_dense": _of(dense), "ret04_fusion": _of(fusion), "ev01_ranking_metrics": _of(metrics), "ev03_summaries": _of(summaries),
    "ev04_classification": _of(classification), "ev04_confusion": _of(confusion), "ev05_tool_metrics": _of(tools), "mk03_price_bands": _of(price_bands), "mk04_opportunities": _of(opportunities),
    "mk07_what_if": _of(what_if), "mk08_stock_risk": _of(stock_risk), "src12_html_text": _of(html), "ag40_term_stats": _of(term_statistics), "str03_token_counts": _of(token_counts),
    "str02_match_forms": _of(matched_forms), "ag46_grouping_sets": _of(grouping), "jn12_context": _of(context), "wn08_budget": _of(budget), "str12_chunks": _of(lambda s: chunking.chunks(_docs(s))),
}

_FORM = "trim(regexp_replace(regexp_replace(strip_accents(lower(coalesce(text, ''))), '[^a-z0-9_/%.-]+', ' ', 'g'), '\\s+', ' ', 'g'), ' ')"
_TOKENS = f"list_filter(string_split({_FORM}, ' '), lambda x: x <> '')"
_TERMS = "list_concat(ts, list_transform(range(1, len(ts)), lambda i: ts[i] || '_' || ts[i + 1]))"
_BM25 = f"""d AS (SELECT doc_id, {_TERMS} AS terms FROM (SELECT doc_id, {_TOKENS} AS ts FROM documents)),
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({_TERMS}) AS term FROM (SELECT item_id, {_TOKENS} AS ts FROM benchmark)) GROUP BY ALL),
c AS (SELECT count(*) AS n, greatest(CAST(sum(len(terms)) AS DOUBLE) / count(*), 1) AS avg FROM d),
tf AS (SELECT doc_id, len(terms) AS length, term, count(*) AS tf FROM (SELECT doc_id, terms, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY doc_id, len(terms), term),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT doc_id, term, CAST(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * length / avg)) AS DECIMAL(20,12)) AS w FROM tf JOIN dfs USING (term), c),
sc AS (SELECT query_id, doc_id, CAST(sum(w * CAST(qtf AS DECIMAL(7,0))) AS DECIMAL(18,6)) AS score FROM w JOIN q USING (term) GROUP BY ALL),
bm AS (SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM sc) WHERE rank <= 30)"""
_V, _Q = "CAST(v.embedding AS DOUBLE[])", "CAST(q.embedding AS DOUBLE[])"
_DOT = f"CAST(greatest(0, least(1, coalesce(list_inner_product({_V}, {_Q}) / nullif(sqrt(list_inner_product({_V}, {_V})) * sqrt(list_inner_product({_Q}, {_Q})), 0), 0))) AS DECIMAL(18,6))"


def _dense(queries: str) -> str:
    return f"dn AS (SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, {_DOT} AS score FROM embeddings v, ({queries}) q)) WHERE rank <= 30)"


_NORM = "CASE WHEN abs(max(s) OVER w - min(s) OVER w) <= greatest(abs(max(s) OVER w), abs(min(s) OVER w)) * 1e-9 THEN 1.0::DOUBLE ELSE (s - min(s) OVER w) / nullif(max(s) OVER w - min(s) OVER w, 0) END"

ORACLES = {
    "flt08_category_sales": sql("SELECT strftime(order_date, '%Y-%m') AS month, count(*) AS order_count, CAST(sum(gmv) AS DOUBLE) AS gmv FROM sales WHERE sku IN (SELECT p_partkey FROM part WHERE p_type = 'SMALL') GROUP BY 1", "sales"),
    "ag30_cost_shares": sql("SELECT event_type AS category, CAST(sum(cents) AS DOUBLE) AS amount, CAST(sum(cents) AS DOUBLE) * 100 / CAST(sum(sum(cents)) OVER () AS DOUBLE) AS share_percent, row_number() OVER (ORDER BY sum(cents) DESC, event_type) AS position FROM ev GROUP BY 1", "ev"),
    "ag32_product_contribution_top": sql("SELECT sku, product_name, CAST(g AS DOUBLE) AS gmv, CAST(c AS DOUBLE) AS contribution FROM contrib ORDER BY g DESC, sku LIMIT 12", "contrib"),
    "ag33_monthly_gmv": sql("SELECT strftime(order_date, '%Y-%m') AS month, CAST(sum(gmv) AS DOUBLE) AS gmv FROM sales GROUP BY 1", "sales"),
    "ag34_deductions": sql("SELECT * FROM (SELECT 'seller_discount' AS kind, CAST(sum(sd) AS DOUBLE) AS amount FROM sales UNION ALL SELECT 'platform_discount', CAST(sum(pd) AS DOUBLE) FROM sales UNION ALL SELECT 'transaction_fee', CAST(sum(tf) AS DOUBLE) FROM sales UNION ALL SELECT 'service_fee', CAST(sum(sf) AS DOUBLE) FROM sales) WHERE amount > 0", "sales"),
    "ag36_price_position": """WITH p AS (SELECT p_partkey AS sku, p_type AS category, p_retailprice AS price FROM part),
        o AS (SELECT p.sku, min(x.price) AS low, median(x.price) AS median, max(x.price) AS high FROM p JOIN p x ON p.category = x.category AND p.sku <> x.sku GROUP BY 1)
        SELECT p.sku, category, price, low, median, high, CASE WHEN price < low THEN 'below' WHEN price > high THEN 'above' WHEN low IS NOT NULL THEN 'within' ELSE 'unknown' END AS position FROM p LEFT JOIN o USING (sku)""",
    "jn07_never_sold": sql("SELECT p_partkey AS sku, p_name AS product_name FROM part WHERE p_partkey NOT IN (SELECT sku FROM sales)", "sales"),
    "aud02_duplicates": "SELECT sha256(coalesce(text, '')) AS sha256, count(*) AS copies, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1",
    "wn12_previous_user_turn": "SELECT conv_id, turn, text, lag(text) OVER w AS previous, coalesce(lower(trim(text, ' ')) = lower(trim(lag(text) OVER w, ' ')), false) AS repeated FROM conversations WHERE role = 'user' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
    "wn13_last_turns": "SELECT * FROM (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 6",
    "tk05_strong_hits": f"WITH {_BM25} SELECT query_id, rank, doc_id, score FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM bm) WHERE CAST(score AS DOUBLE) >= 2 AND CAST(score AS DOUBLE) >= CAST(best AS DOUBLE) * 0.62::DOUBLE AND rank <= 2",
    "ret01_bm25": f"WITH {_BM25} SELECT * FROM bm",
    "ret02_dense": "WITH " + _dense("SELECT min(vec_id) AS vec_id, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label") + " SELECT * FROM dn",
    "ret04_fusion": "WITH " + _BM25 + ", " + _dense("SELECT vec_id, embedding FROM embeddings JOIN benchmark ON item_id = vec_id") + f""",
        x AS (SELECT query_id, doc_id, rank AS vr, {_NORM} AS vn FROM (SELECT *, CAST(score AS DOUBLE) AS s FROM dn) WINDOW w AS (PARTITION BY query_id)), y AS (SELECT query_id, doc_id, rank AS br, {_NORM} AS bn FROM (SELECT *, CAST(score AS DOUBLE) AS s FROM bm) WINDOW w AS (PARTITION BY query_id)),
        z AS (SELECT query_id, doc_id, vr AS vector_rank, br AS bm25_rank, CAST(0.62::DOUBLE * coalesce(vn, 0) + 0.38::DOUBLE * coalesce(bn, 0) + CASE WHEN vr IS NOT NULL AND br IS NOT NULL THEN 0.05::DOUBLE ELSE 0 END AS DECIMAL(18,6)) AS score FROM x FULL JOIN y USING (query_id, doc_id))
        SELECT query_id, rank, doc_id, score, vector_rank, bm25_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM z) WHERE rank <= 10""",
    "ev01_ranking_metrics": f"""WITH {_BM25}, ex AS (SELECT doc_id % 40 AS query_id, doc_id FROM documents), n AS (SELECT query_id, count(*) AS n FROM ex GROUP BY 1),
        h AS (SELECT query_id, min(rank) AS best, count(*) FILTER (rank <= 5) AS found, sum(CAST(1 / log2(rank + 1) AS DECIMAL(18,12))) FILTER (rank <= 5) AS gain FROM bm JOIN ex USING (query_id, doc_id) GROUP BY 1)
        SELECT n.query_id, CAST(coalesce(best = 1, false) AS BIGINT) AS hit_at_1, CAST(coalesce(best <= 5, false) AS BIGINT) AS hit_at_5, coalesce(found, 0) / CAST(n AS DOUBLE) AS recall_at_5, CASE WHEN best <= 10 THEN 1.0::DOUBLE / best ELSE 0 END AS mrr_at_10,
        CAST(coalesce(gain, 0) AS DOUBLE) / CAST((SELECT sum(CAST(1 / log2(i + 1) AS DECIMAL(18,12))) FROM range(1, 6) r(i) WHERE i <= n) AS DOUBLE) AS ndcg_at_5 FROM n LEFT JOIN h USING (query_id)""",
    "ev03_summaries": "SELECT CASE grouping(event_type, team) WHEN 3 THEN 'overall' WHEN 1 THEN 'event_type' ELSE 'team' END AS level, CASE grouping(event_type, team) WHEN 3 THEN 'all' WHEN 1 THEN event_type ELSE CAST(team AS VARCHAR) END AS value, count(m) AS items, CAST(sum(CAST(m AS DECIMAL(28,9))) AS DOUBLE) / count(m) AS mean, median(m) AS median, quantile_cont(m, 0.95) AS p95, quantile_disc(m, 0.95) AS p95_nearest FROM (SELECT value AS m, event_type, user_id % 7 AS team FROM events) GROUP BY GROUPING SETS ((), (event_type), (team))",
    "ev04_classification": "WITH l(label) AS (VALUES ('0'), ('1'), ('2')), c AS (SELECT label, count(*) FILTER (quality::VARCHAR = label) AS s, count(*) FILTER (toxic::VARCHAR = label) AS k, count(*) FILTER (quality::VARCHAR = label AND toxic::VARCHAR = label) AS r FROM l, labels GROUP BY 1) SELECT label, s AS support, coalesce(r::DOUBLE / nullif(k, 0), 0) AS precision, coalesce(r::DOUBLE / nullif(s, 0), 0) AS recall, coalesce(2 * (r::DOUBLE / nullif(k, 0)) * (r::DOUBLE / nullif(s, 0)) / nullif((r::DOUBLE / nullif(k, 0)) + (r::DOUBLE / nullif(s, 0)), 0), 0) AS f1, (SELECT count(*) FILTER (quality = toxic)::DOUBLE / count(*) FROM labels) AS accuracy FROM c",
    "ev04_confusion": "WITH l(label) AS (VALUES ('0'), ('1'), ('2')) SELECT a.label AS expected, b.label AS predicted, (SELECT count(*) FROM labels WHERE quality::VARCHAR = a.label AND toxic::VARCHAR = b.label) AS n FROM l a, l b",
    "ev05_tool_metrics": "WITH x AS (SELECT doc_id AS id, list_filter([CASE WHEN quality = 1 THEN 'rag' END, CASE WHEN toxic = 1 THEN 'shop_data' END], lambda x: x IS NOT NULL) AS e, list_filter([CASE WHEN doc_id % 2 = 0 THEN 'rag' END, CASE WHEN doc_id % 3 = 0 THEN 'shop_data' END], lambda x: x IS NOT NULL) AS p FROM labels), y AS (SELECT id, e = p AS same_sequence, CASE WHEN len(e) = 0 AND len(p) = 0 THEN 1.0::DOUBLE ELSE coalesce(len(list_intersect(e, p))::DOUBLE / nullif(len(p), 0), 0) END AS precision, CASE WHEN len(e) = 0 AND len(p) = 0 THEN 1.0::DOUBLE ELSE coalesce(len(list_intersect(e, p))::DOUBLE / nullif(len(e), 0), 0) END AS recall FROM x) SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM y",
    "mk03_price_bands": "WITH p AS (SELECT p_brand AS brand, p_retailprice AS price, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice) AS lo, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC) AS hi FROM part), b AS (SELECT brand, count(*) AS listings, 1000 * round_even(max(price) FILTER (lo = 2) / 1000, 0) AS lower, 1000 * round_even(median(price) / 1000, 0) AS typical, 1000 * round_even(max(price) FILTER (hi = 2) / 1000, 0) AS upper FROM p GROUP BY 1), o AS (SELECT brand, 1000 * round_even(median(price) / 1000, 0) AS own_price FROM p WHERE p_size > 45 AND price > 0 GROUP BY 1) SELECT *, CASE WHEN own_price IS NULL THEN 'unknown' WHEN own_price < lower THEN 'below' WHEN own_price > upper THEN 'above' ELSE 'within' END AS position FROM b LEFT JOIN o USING (brand)",
    "mk04_opportunities": sql("SELECT p_type, CAST(v AS DECIMAL(18,6)) AS volume_score, CAST(r AS DECIMAL(18,6)) AS revenue_score, s AS opportunity_score, CASE WHEN s >= 80 THEN 'try_small' WHEN s >= 68 THEN 'watch' ELSE 'wait' END AS advice, row_number() OVER (ORDER BY s DESC, p_type) AS rank FROM (SELECT *, CAST(least(v, r) * 0.30::DOUBLE + (v + r) / 2 * 0.15::DOUBLE + fit * 0.20::DOUBLE + reviews * 0.20::DOUBLE + longevity * 0.15::DOUBLE AS DECIMAL(18,6)) AS s FROM (SELECT *, units::DOUBLE / max(units::DOUBLE) OVER () * 100 AS v, revenue::DOUBLE / max(revenue::DOUBLE) OVER () * 100 AS r FROM (SELECT p_type, CAST(sum(u) AS BIGINT) AS units, sum(rev) AS revenue, CAST(count(*) % 35 + 62 AS DOUBLE) AS fit, CAST(sum(p_size) % 30 + 68 AS DOUBLE) AS reviews, CAST(max(p_size) % 38 + 58 AS DOUBLE) AS longevity FROM part JOIN (SELECT l_partkey AS p_partkey, sum(l_quantity) AS u, sum(price) AS rev FROM lines GROUP BY 1) USING (p_partkey) GROUP BY 1)))", "lines"),
    "mk07_what_if": sql("SELECT shop, eu AS estimated_units, eg AS estimated_gmv, floor((eg / gmv - 1) * 100 * 10 + 0.5::DOUBLE) / 10 AS gmv_change_percent, 'high' AS risk FROM (SELECT *, CAST(round_even(units * (1.144::DOUBLE * 1.0::DOUBLE * 1.048::DOUBLE) * st, 0) AS BIGINT) AS eu, CAST(round_even(gmv * (1.144::DOUBLE * 1.0::DOUBLE * 1.048::DOUBLE * 0.88::DOUBLE) * st, 0) AS BIGINT) AS eg FROM (SELECT *, 1 + least(0.10::DOUBLE, 100.0::DOUBLE / greatest(units, 1) * 0.8::DOUBLE) AS st FROM (SELECT l_suppkey AS shop, CAST(sum(l_quantity) AS BIGINT) AS units, CAST(sum(price) AS DOUBLE) AS gmv FROM lines GROUP BY 1)))", "lines"),
    "mk08_stock_risk": """WITH p AS (SELECT p_partkey AS item, CAST(floor(p_retailprice) AS BIGINT) AS price, greatest(1, CAST(p_partkey % 23 AS DOUBLE)) AS sold, CAST(p_size AS BIGINT) AS on_hand, p_partkey * 29 % 100 AS idle, p_partkey % 50 + 45 AS score FROM part),
        q AS (SELECT *, CAST(floor(price * (58 + item % 39) / 100) AS BIGINT) AS cost, CAST(floor(price * 12 / 100) AS BIGINT) AS reserve, floor(on_hand / sold * 10 + 0.5::DOUBLE) / 10 AS cover FROM p),
        r AS (SELECT *, price - cost - reserve AS margin, CASE WHEN price - cost - reserve <= 0 THEN 'loss' WHEN idle >= 60 THEN 'idle' WHEN cover >= 3.5 THEN 'tied_up' WHEN cover < 0.8 AND score >= 62 THEN 'reorder' ELSE 'watch' END AS st FROM q),
        u AS (SELECT *, CASE WHEN st = 'reorder' THEN greatest(1, ceil(sold * 2 - on_hand)) ELSE 0 END AS oq FROM r), k AS (SELECT count(*) FILTER (oq > 0) AS n, arg_min(item, (cover, item)) FILTER (margin > 0 AND idle < 60) AS pick FROM u),
        f AS (SELECT *, n = 0 AND item = pick AS fb FROM u, k)
        SELECT item, CASE WHEN fb THEN 'try_small' ELSE st END AS status, CAST(CASE WHEN fb THEN greatest(1, ceil(sold * 2 * 0.5)) ELSE oq END AS BIGINT) AS order_quantity, CAST(CASE WHEN fb THEN greatest(1, ceil(sold * 2 * 0.5)) ELSE oq END AS BIGINT) * cost AS order_budget, CAST(cover AS DECIMAL(18,6)) AS cover, on_hand * cost AS capital FROM f""",
    "ag40_term_stats": f"WITH d AS (SELECT doc_id, {_TERMS} AS terms FROM (SELECT doc_id, {_TOKENS} AS ts FROM documents)), n AS (SELECT count(*) AS n FROM d) SELECT term, df, CAST(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS DECIMAL(18,6)) AS idf FROM (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(terms)) AS term FROM d) GROUP BY 1), n",
    "str03_token_counts": f"SELECT doc_id, len(ts) AS words, len({_TERMS}) AS terms, CAST(len(list_distinct(list_filter(ts, lambda x: len(x) >= 3 AND NOT regexp_full_match(x, '[0-9]+')))) AS BIGINT) AS distinct_words FROM (SELECT doc_id, {_TOKENS} AS ts FROM documents)",
    "str02_match_forms": f"SELECT doc_id, {_FORM} AS form FROM documents",
    "ag46_grouping_sets": "SELECT lang, source, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY GROUPING SETS ((), (lang), (source), (lang, source))",
    "jn12_context": "WITH c AS (SELECT conv_id AS document, turn AS place, text FROM conversations), t AS (SELECT document, arg_max(place, (length(text), -place)) AS top FROM c GROUP BY 1) SELECT t.document AS query_id, c.document, c.place, c.text FROM c JOIN t ON c.document = t.document AND abs(place - top) <= 2",
}


def _clean(x: str) -> str:
    for p, to in (("chr(0)", ""),):
        x = f"replace({x}, {p}, '{to}')"
    for p, to in (("\\r\\n?", "\\n"), ("[ \\t\xa0]+", " "), (" ?\\n ?", "\\n"), ("\\n{3,}", "\\n\\n"), ("^\\s+|\\s+$", "")):
        x = f"regexp_replace({x}, '{p}', " + ("'" + to + "'" if "\\" not in to else " || ".join(["chr(10)"] * to.count("n"))) + ", 'g')"
    return f"trim({x}, ' ')"


_HTML = "html"
for _p, _to in (("(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>", "' '"), ("(?i)</(?:p|h1|h2|h3|h4|h5|h6)\\s*>", "chr(10) || chr(10)"), ("(?i)</(?:div)\\s*>|<br\\s*/?>", "chr(10)"), ("<[^>]+>", "' '")):
    _HTML = f"regexp_replace({_HTML}, '{_p}', {_to}, 'g')"
# The references that these pages have, each read once, from left to right.
_NAMES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "''", "nbsp": "\u00a0", "copy": "©", "middot": "·", "hellip": "…", "eacute": "é", "euro": "€", "ndash": "–", "mdash": "—"}
_PARTS = f"string_split({_HTML}, '&')"
_REF = "regexp_extract(x, '^(#[0-9]{1,8}|[A-Za-z][A-Za-z0-9]*);', 1)"
_CHARACTER = "CASE {r} {n} WHEN '' THEN NULL ELSE CASE WHEN {r}[1] = '#' THEN chr(CAST({r}[2:] AS INTEGER)) END END".format(r=_REF, n=" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _NAMES.items()))
_HTML = f"list_reduce(list_prepend({_PARTS}[1], list_transform({_PARTS}[2:], lambda x: coalesce({_CHARACTER} || x[length({_REF}) + 2:], '&' || x))), lambda a, b: a || b)"
ORACLES["src12_html_text"] = f"SELECT page_id, {_clean(_HTML)} AS text FROM pages"
_EMPTY = "{'used': CAST(0 AS BIGINT), 'seen': CAST([] AS VARCHAR[]), 'kept': CAST([] AS BIGINT[]), "
ORACLES["wn08_budget"] = (
    f"WITH n AS ({ORACLES['jn12_context']}), i AS (SELECT query_id, list({_EMPTY}'o': CAST(place AS BIGINT), 'n': CAST(length(text) AS BIGINT), 'f': left(text, 250)}} ORDER BY place) AS items FROM n GROUP BY query_id), "
    f"r AS (SELECT query_id, list_reduce(list_prepend({_EMPTY}'o': CAST(0 AS BIGINT), 'n': CAST(0 AS BIGINT), 'f': ''}}, items), lambda acc, x: CASE WHEN acc.used + x.n <= 1200 AND len(acc.kept) < 4 AND NOT list_contains(acc.seen, x.f) "
    "THEN {'used': acc.used + x.n, 'seen': list_append(acc.seen, x.f), 'kept': list_append(acc.kept, x.o), 'o': CAST(0 AS BIGINT), 'n': CAST(0 AS BIGINT), 'f': ''} ELSE acc END) AS z FROM i) SELECT query_id, unnest(z.kept) AS place FROM r"
)
