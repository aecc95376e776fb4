"""Queries of routed retrieval, bonuses, citations and context, with their SQL. Documents get a title, a page, an id and a
group of sources by their number, passages a seller's question before their text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import files, quick_rules
from ..operators import heuristics as h
from ..operators import retrieval as rt
from ..sources.questions import QUESTIONS_SQL, questions
from ..sources.testdata import Star
from .questions import any_sql, form_sql

Query = Callable[[SparkSession, str], DataFrame]

GROUPS = ("shopee_api", "seller_operations_guides", "legal_ecommerce", "shopee_policy", "other")
TITLES = (
    "Biểu phí cố định theo ngành hàng 2026", "Điều khoản dịch vụ", "Phí xử lý giao dịch", "Quy định đăng bán sản phẩm", "Quy trình trả hàng hoàn tiền người bán 2024 và 2025",
    "Ngành hàng hạn chế khuyến mãi", "API calls", "", "Cấm hạn chế sản phẩm",
)
IDS = ("SHP_FEE_006", "SHP_FEE_004", "SHP_POL_007", "SHP_RET_003", "OTHER")
OPENING = (
    "Cáp sạc bộ chuyển đổi 12%.", "Trong vòng 15 ngày từ khi đơn giao thành công.", "Sản phẩm bị cấm.", "Trong vòng 6 ngày người mua phản hồi.", "Giải quyết khiếu nại.", "Xử lý dữ liệu cá nhân.",
    "Merchant API merchant_id và Shop API shop_id.", "GMV 36.7 và 28.6.", "", "Phí xử lý giao dịch = 6%", "Trong vòng 2 ngày.",
)
ASKED = (
    "Phí cố định của cáp sạc?", "Phí xử lý giao dịch là gì", "Quy định đăng bán", "Người mua được hoàn tiền trong bao lâu", "Hàng cấm", "Trả hàng bao lâu", "Trách nhiệm với người tiêu dùng",
    "Bảo vệ dữ liệu cá nhân", "merchant api base_string", "shop api và base_string", "GMV quý 4 năm 2025", "", "nguyên tắc đăng sản phẩm",
)
MODES = ("llm", "fast", "calculation", "signature_flow", "smalltalk", "rag")
ASKED_TOPICS = ("fixed_fee", "transaction_fee", "none", "return_refund", "none", "return_refund", "none", "none", "merchant_api", "shop_api", "none", "none", "none")


def _at(values: tuple[str, ...], n: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), (n % len(values)).cast("int"))


def _docs(s: Star) -> DataFrame:
    n = F.col("doc_id")
    number = F.regexp_extract(F.coalesce("source", F.lit("")), "([0-9]+)", 1).try_cast("int")
    text = F.concat_ws(" ", F.nullif(_at(OPENING, n), F.lit("")), "text")
    return s.raw("documents").select("doc_id", text.alias("text"), _at(TITLES, n).alias("title"), (n % 8).cast("string").alias("page"), _at(IDS, n).alias("document_id"), F.coalesce(_at(GROUPS, number), F.lit("other")).alias("source"))


def _questions(s: Star) -> DataFrame:
    n = F.col("item_id")
    return s.raw("benchmark").select(n.alias("query_id"), F.concat_ws(" ", F.nullif(_at(ASKED, n), F.lit("")), "text").alias("question"), _at(ASKED_TOPICS, n).alias("topic"), _at(MODES, n).alias("mode"))


def _vectors(s: Star) -> DataFrame:
    """A document's vector is the one of its number; the vector's group is the document's."""
    return s.raw("embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), _at(GROUPS, F.col("vec_id")).alias("source"))


def routed_bm25(s: Star) -> DataFrame:
    return rt.bm25(_docs(s), _questions(s), groups=h.source_groups(_questions(s)))


def _asked_vectors(s: Star) -> DataFrame:
    q = _questions(s).select("query_id")
    return q.join(_vectors(s).select(F.col("doc_id").alias("query_id"), "vector"), "query_id")


def routed_dense(s: Star) -> DataFrame:
    return rt.dense(_vectors(s), _asked_vectors(s), groups=h.source_groups(_questions(s)))


def routes(s: Star) -> DataFrame:
    return h.source_groups(_questions(s))


def _hits(s: Star) -> tuple[DataFrame, DataFrame]:
    groups = h.source_groups(_questions(s))
    return rt.dense(_vectors(s), _asked_vectors(s), groups=groups), rt.bm25(_docs(s), _questions(s), groups=groups)


def hybrid(s: Star) -> DataFrame:
    """Routed candidates of both kinds, with the additive bonus, the best ten."""
    vector, words = _hits(s)
    both = rt.candidates(vector, words)
    return rt.fused(vector, words, bonus=h.bonuses(both, _questions(s), _docs(s)))


def bonuses(s: Star) -> DataFrame:
    """Each document with the question of its number."""
    pairs = _docs(s).select("doc_id", (F.col("doc_id") % 40).alias("query_id"))
    return h.bonuses(pairs.join(_questions(s).select("query_id"), "query_id"), _questions(s), _docs(s))


def _results(s: Star) -> DataFrame:
    """BM25's results with what is known of their documents."""
    hits = rt.bm25(_docs(s), _questions(s)).filter("rank <= 5").withColumnRenamed("score", "bm25_score")
    known = _docs(s).select("doc_id", "title", "page", "source", "text")
    # The hits are few; the texts stay where they are.
    return known.join(rt.sent(hits), "doc_id").join(_questions(s), "query_id").withColumns({"hybrid_score": 1.0 / F.col("rank"), "vector_score": (F.col("doc_id") % 10) / 9.0})


def citations(s: Star) -> DataFrame:
    return h.citations(_results(s))


def sufficiency(s: Star) -> DataFrame:
    r = _results(s)
    cited = r.groupBy("query_id").agg(F.max(F.col("title") != "").alias("cited"))
    c = h.sufficiency(F.col("mode"), F.col("topic"), F.col("cited"), F.lit(True), F.col("hybrid_score"), F.col("vector_score"), F.col("bm25_score"))
    best = r.filter("rank = 1").join(cited, "query_id").withColumn("confidence", c)
    return best.select("query_id", "mode", "confidence", h.band(F.col("confidence")).alias("band"), h.similarity_band(F.col("vector_score")).alias("b")).select("query_id", "mode", "confidence", "band", "b.percent", F.col("b.band").alias("similarity"))


def contexts(s: Star) -> DataFrame:
    return h.context_strings(_results(s).filter("rank <= 3").withColumn("place", F.col("rank")))


def labels(s: Star) -> DataFrame:
    return _docs(s).select("doc_id", h.label(F.col("title"), F.col("page"), F.col("source")).alias("label"), h.year_of(F.col("title")).alias("year"), h.own_data_asked(F.col("text")).alias("own_data"))


def _of(f: Callable[[Star], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(Star(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "ret03_source_groups": _of(routes),
    "flt10_routed_bm25": _of(routed_bm25),
    "flt10_routed_dense": _of(routed_dense),
    "ret04_hybrid": _of(hybrid),
    "ret05_bonuses": _of(bonuses),
    "ret08_citations": _of(citations),
    "ret09_sufficiency": _of(sufficiency),
    "ret14_source_labels": _of(labels),
    "ret15_context_strings": _of(contexts),
}


def _pick(values: tuple[str, ...], n: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][{n} % {len(values)} + 1]"


_TERMS = "list_concat(ts, list_transform(range(1, len(ts)), lambda i: ts[i] || '_' || ts[i + 1]))"
_TOKENS = "list_filter(string_split({}, ' '), lambda x: x <> '')"
_ROUTE = " ".join(f"WHEN {any_sql(words)} THEN [{', '.join(repr(g) for g in groups)}]" for words, groups in (
    (h.API_WORDS, ["shopee_api"]), (h.OPERATIONS_WORDS, ["seller_operations_guides"]), (h.REPORT_WORDS, ["sea_shopee_reports", "ecommerce_market_reports"]),
    (h.LAW_WORDS, ["legal_ecommerce", "shopee_policy", "seller_operations_guides"]), (h.POLICY_WORDS, ["shopee_policy"]),
))
_BASE = f"""dt AS (SELECT doc_id, concat_ws(' ', nullif({_pick(OPENING, "doc_id")}, ''), text) AS text, {_pick(TITLES, "doc_id")} AS title, CAST(doc_id % 8 AS VARCHAR) AS page, {_pick(IDS, "doc_id")} AS document_id,
    coalesce({_pick(GROUPS, "TRY_CAST(regexp_extract(source, '([0-9]+)', 1) AS INTEGER)")}, 'other') AS source FROM documents),
qt AS (SELECT item_id AS query_id, concat_ws(' ', nullif({_pick(ASKED, "item_id")}, ''), text) AS question, {_pick(ASKED_TOPICS, "item_id")} AS topic, {_pick(MODES, "item_id")} AS mode FROM benchmark),
gr AS (SELECT query_id, unnest(CASE {_ROUTE} END) AS source FROM (SELECT query_id, {form_sql("question")} AS form FROM qt))"""


def _limited(sources: str) -> str:
    return f"SELECT query_id, source FROM gr WHERE query_id IN (SELECT query_id FROM gr WHERE source IN (SELECT source FROM {sources}))"


_SCORES = f"""d AS (SELECT doc_id, source, {_TERMS} AS terms FROM (SELECT doc_id, source, {_TOKENS.format(form_sql("text"))} AS ts FROM dt)),
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_TERMS}) AS term FROM (SELECT query_id, {_TOKENS.format(form_sql("question"))} AS ts FROM qt)) GROUP BY ALL),
c AS (SELECT count(*) AS n, greatest(CAST(sum(len(terms)) AS DOUBLE) / count(*), 1) AS avg FROM d),
tf AS (SELECT doc_id, source, len(terms) AS length, term, count(*) AS tf FROM (SELECT doc_id, source, terms, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY doc_id, source, len(terms), term),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT doc_id, source, term, CAST(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * length / avg)) AS DECIMAL(20,12)) AS w FROM tf JOIN dfs USING (term), c)"""


def _bm25(limited: str | None) -> str:
    allowed = f" WHERE q.query_id NOT IN (SELECT query_id FROM ({limited})) OR (q.query_id, w.source) IN (SELECT query_id, source FROM ({limited}))" if limited else ""
    return f"""{_SCORES}, sc AS (SELECT query_id, doc_id, CAST(sum(w * CAST(qtf AS DECIMAL(7,0))) AS DECIMAL(18,6)) AS score FROM w JOIN q USING (term){allowed} GROUP BY ALL),
bm AS (SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM sc) WHERE rank <= 30)"""


_ROUTED = _bm25(_limited("dt"))
_V, _Q = "CAST(v.embedding AS DOUBLE[])", "CAST(e.embedding AS DOUBLE[])"
_DOT = f"CAST(greatest(0, least(1, coalesce(list_inner_product({_V}, {_Q}) / nullif(sqrt(list_inner_product({_V}, {_V})) * sqrt(list_inner_product({_Q}, {_Q})), 0), 0))) AS DECIMAL(18,6))"
_DENSE = f"""vt AS (SELECT vec_id, embedding, {_pick(GROUPS, "vec_id")} AS source FROM embeddings), lv AS ({_limited("vt")}),
dn AS (SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM (SELECT query_id, v.vec_id AS doc_id, {_DOT} AS score FROM qt JOIN embeddings e ON e.vec_id = query_id, vt v
    WHERE query_id NOT IN (SELECT query_id FROM lv) OR (query_id, v.source) IN (SELECT query_id, source FROM lv))) WHERE rank <= 30)"""
_NORM = "CASE WHEN abs(max(s) OVER w - min(s) OVER w) <= greatest(abs(max(s) OVER w), abs(min(s) OVER w)) * 1e-9 THEN 1.0::DOUBLE ELSE (s - min(s) OVER w) / nullif(max(s) OVER w - min(s) OVER w, 0) END"

# The bonus as the rules say it, over q (question), form (title and text), title_form, document_id, page and source.
_HAS = lambda view, *phrases: "(" + " AND ".join(f"contains({view}, '{p}')" for p in phrases) + ")"
_ANY = lambda view, *phrases: "(" + " OR ".join(f"contains({view}, '{p}')" for p in phrases) + ")"
_BONUS_RULES = (
    (f"{_HAS('q', 'phi co dinh')} AND ({_HAS('q', 'cap sac')} OR {_HAS('q', 'cap', 'sac')})", (
        (f"document_id = 'SHP_FEE_006' OR {_HAS('title_form', 'bieu phi co dinh theo nganh hang')}", "0.32"), ("page = '7'", "0.18"), (_HAS("form", "cap", "sac", "bo chuyen doi"), "0.25"),
        (_HAS("form", "12"), "0.18"), (_HAS("title_form", "dieu khoan dich vu"), "-0.30"))),
    (f"{_HAS('q', 'phi xu ly giao dich')} OR {_HAS('q', 'phi thanh toan')} AND {_ANY('q', 'ten moi', 'moc ap dung')} OR {_HAS('q', 'khau tru', 'giao dich')} AND {_ANY('q', 'kenh', 'xem')}", (
        (f"document_id = 'SHP_FEE_004' OR {_HAS('title_form', 'phi xu ly giao dich')}", "0.30"), (_HAS("form", "phi xu ly giao dich =", "6%"), "0.16"))),
    (f"{_HAS('q', 'quy dinh dang ban')} OR {_HAS('q', 'nguyen tac', 'dang san pham')}", ((f"document_id = 'SHP_POL_007' OR {_HAS('title_form', 'quy dinh dang ban san pham')}", "0.28"),)),
    (f"{_HAS('q', 'nguoi mua', 'hoan tien')} AND {_ANY('q', 'bao lau', 'thoi han', 'thoi gian')}", (("document_id = 'SHP_RET_003' AND page = '1'", "0.20"), (_HAS("form", "trong vong 15 ngay", "don giao thanh cong"), "0.14"))),
    (_ANY("q", "cam dang ban", "san pham nao bi cam", "hang cam"), (
        (_ANY("title_form", "cam han che san pham", "quy dinh dang ban san pham", "quy che hoat dong san"), "0.28"),
        (_ANY("form", "san pham bi cam", "hang hoa cam", "khong duoc phep dang ban", "danh sach san pham cam"), "0.24"), (_HAS("title_form", "nganh hang han che khuyen mai"), "-0.45"))),
    (_HAS("q", "tra hang", "bao lau"), (
        (_HAS("title_form", "quy trinh tra hang hoan tien nguoi ban"), "0.18"), (_ANY("form", "trong vong 2 ngay", "moc thoi gian co the khieu nai", "phan hoi"), "0.20"),
        (_HAS("form", "trong vong 6 ngay", "nguoi mua"), "-0.10"))),
    (_HAS("q", "trach nhiem", "nguoi tieu dung"), (("source = 'legal_ecommerce'", "0.22"), (_ANY("form", "cung cap thong tin day du", "bao ve quyen loi nguoi tieu dung", "giai quyet khieu nai", "nghia vu nguoi ban"), "0.20"))),
    (_HAS("q", "bao ve du lieu ca nhan"), (("source = 'legal_ecommerce'", "0.22"), (_ANY("form", "bao mat thong tin ca nhan", "xu ly du lieu ca nhan", "luu tru thong tin ca nhan", "xoa thong tin"), "0.18"))),
    (_HAS("q", "merchant api", "base_string"), ((_HAS("form", "merchant api", "merchant_id"), "0.24"),)),
    (_HAS("q", "shop api", "base_string"), ((_HAS("form", "shop api", "shop_id"), "0.24"),)),
    (_HAS("q", "gmv", "quy 4", "2025"), ((_HAS("form", "36.7", "28.6"), "0.30"),)),
)
_BONUS = "CAST(" + " + ".join(f"CASE WHEN ({q}) AND ({d}) THEN {v} ELSE 0 END" for q, parts in _BONUS_RULES for d, v in parts) + " AS DECIMAL(6,2))"
_FORMS = f"qf AS (SELECT query_id, {form_sql('question')} AS q FROM qt), df2 AS (SELECT doc_id, {form_sql('concat_ws(chr(32), title, text)')} AS form, {form_sql('title')} AS title_form, document_id, page, source FROM dt)"

_RESULTS = f"""{_bm25(None)}, rs AS (SELECT bm.query_id, bm.rank, bm.doc_id, bm.score, title, page, source, text, question, topic, mode, 1.0::DOUBLE / bm.rank AS hybrid, (bm.doc_id % 10) / 9.0::DOUBLE AS vector FROM bm JOIN dt USING (doc_id) JOIN qt USING (query_id) WHERE bm.rank <= 5)"""
_STOPPED = lambda text: f"list_distinct(list_filter(string_split({form_sql(text)}, ' '), lambda w: length(w) >= 3 AND w NOT IN ({', '.join(repr(w) for w in h.STOP_WORDS)})))"
_PHRASES = "CASE topic " + " ".join(f"WHEN '{t}' THEN " + " + ".join(f"CASE WHEN contains(tf, '{p}') THEN 6 ELSE 0 END" for p in ps) for t, ps in h.TITLE_PHRASES.items()) + " ELSE 0 END"
_YEAR = "coalesce(list_max(list_transform(regexp_extract_all(title, '20[0-9]{2}'), lambda y: CAST(y AS INTEGER))), 0)"

ORACLES = {
    "ret03_source_groups": f"WITH {_BASE} SELECT query_id, source FROM gr",
    "flt10_routed_bm25": f"WITH {_BASE}, {_ROUTED} SELECT * FROM bm",
    "flt10_routed_dense": f"WITH {_BASE}, {_DENSE} SELECT * FROM dn",
    "ret05_bonuses": f"WITH {_BASE}, {_FORMS} SELECT query_id, doc_id, {_BONUS} AS bonus FROM df2 JOIN qf ON query_id = doc_id % 40",
    "ret04_hybrid": f"""WITH {_BASE}, {_FORMS}, {_ROUTED}, {_DENSE},
        x AS (SELECT query_id, doc_id, rank AS vr, {_NORM} AS vn FROM (SELECT *, CAST(score AS DOUBLE) AS s FROM dn) WINDOW w AS (PARTITION BY query_id)), y AS (SELECT query_id, doc_id, rank AS br, {_NORM} AS bn FROM (SELECT *, CAST(score AS DOUBLE) AS s FROM bm) WINDOW w AS (PARTITION BY query_id)),
        k AS (SELECT query_id, doc_id, vr, br, 0.62::DOUBLE * coalesce(vn, 0) + 0.38::DOUBLE * coalesce(bn, 0) + CASE WHEN vr IS NOT NULL AND br IS NOT NULL THEN 0.05::DOUBLE ELSE 0 END AS base FROM x FULL JOIN y USING (query_id, doc_id)),
        z AS (SELECT query_id, doc_id, vr AS vector_rank, br AS bm25_rank, CAST(base + coalesce(CAST({_BONUS} AS DOUBLE), 0) AS DECIMAL(18,6)) AS score FROM k JOIN qf USING (query_id) LEFT JOIN df2 USING (doc_id))
        SELECT query_id, rank, doc_id, score, vector_rank, bm25_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM z) WHERE rank <= 10""",
    "ret08_citations": f"""WITH {_BASE}, {_RESULTS}, f AS (SELECT *, {form_sql("title")} AS tf, {_YEAR} AS year, row_number() OVER (PARTITION BY query_id, lower(title), page ORDER BY rank) AS n FROM rs WHERE title <> ''),
        g AS (SELECT *, CAST({_PHRASES} + len(list_intersect({_STOPPED("question")}, {_STOPPED("title")})) * 2.5::DOUBLE + least(hybrid, 2.0::DOUBLE) + vector * 2.0::DOUBLE + least(CAST(score AS DOUBLE) / 25.0::DOUBLE, 4.0::DOUBLE) + year / 10000.0::DOUBLE AS DECIMAL(18,6)) AS citation_score FROM f WHERE n = 1),
        b AS (SELECT *, max(citation_score) OVER (PARTITION BY query_id) AS best FROM g)
        SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY citation_score DESC, year DESC, rank) AS place, title, page, year, citation_score FROM b WHERE CAST(citation_score AS DOUBLE) >= greatest(2.0::DOUBLE, CAST(best AS DOUBLE) * 0.62::DOUBLE)) WHERE place <= 2""",
    "ret09_sufficiency": f"""WITH {_BASE}, {_RESULTS}, ct AS (SELECT query_id, bool_or(title <> '') AS cited FROM rs GROUP BY 1), b AS (SELECT *, CAST(score AS DOUBLE) AS s FROM rs JOIN ct USING (query_id) WHERE rank = 1),
        k AS (SELECT *, CASE WHEN mode IN ({", ".join(repr(m) for m in h.UNSCORED)}) THEN NULL WHEN mode IN ({", ".join(repr(m) for m in h.CALCULATED)}) THEN 99 WHEN mode IN ({", ".join(repr(m) for m in h.DETERMINED)}) AND cited THEN 97
            WHEN mode = 'fast' AND cited AND topic IN ({", ".join(repr(m) for m in h.KNOWN_TOPICS)}) THEN 96
            ELSE greatest(55, least(95, CAST(round_even(60 + 15 * vector + 11 * CASE WHEN s > 0 THEN s / (s + 30.0::DOUBLE) ELSE 0 END + 10 * (hybrid / (hybrid + 1.0::DOUBLE)) + CASE WHEN cited THEN 3 ELSE 0 END - CASE WHEN mode = 'llm' THEN 3 ELSE 0 END, 0) AS INTEGER))) END AS confidence FROM b)
        SELECT query_id, mode, CAST(confidence AS INTEGER) AS confidence, CASE WHEN confidence IS NULL THEN '' WHEN confidence >= 90 THEN 'Cao' WHEN confidence >= 75 THEN 'Khá cao' WHEN confidence >= 60 THEN 'Trung bình' ELSE 'Thấp' END AS band,
        CAST(round_even(vector * 100, 0) AS INTEGER) AS percent, CASE WHEN vector >= 0.78 THEN 'Cao' WHEN vector >= 0.58 THEN 'Trung bình' ELSE 'Thấp' END AS similarity FROM k""",
    "ret14_source_labels": f"""WITH {_BASE} SELECT doc_id, concat_ws(' | ', nullif(title, ''), 'trang ' || page, 'nhóm ' || source) AS label, {_YEAR} AS year, {any_sql(h.OWN_DATA, form_sql("text"))} AS own_data FROM dt""",
    "ret15_context_strings": f"""WITH {_BASE}, {_RESULTS} SELECT query_id, string_agg('[NGUỒN ' || rank || ']' || CASE WHEN title <> '' THEN chr(10) || 'Tài liệu: ' || title ELSE '' END || chr(10) || 'Trang: ' || page || chr(10) || 'Nhóm: ' || source || chr(10) || 'Nội dung:' || chr(10) || trim(coalesce(text, ''), ' '), chr(10) || chr(10) ORDER BY rank) AS context FROM rs WHERE rank <= 3 GROUP BY query_id""",
}


def search(s: Star) -> DataFrame:
    """The whole way from question to the three best results, of three modes."""
    return h.search(_docs(s), _questions(s), _vectors(s), _asked_vectors(s))


def search_by_words(s: Star) -> DataFrame:
    return h.search(_docs(s), _questions(s))


def index_metadata(s: Star) -> DataFrame:
    d = _docs(s).select("document_id", "doc_id", "title", F.col("source").alias("source_group"), "page").withColumns({"chunk_index": F.when(F.col("doc_id") % 3 != 0, F.col("doc_id")), "pages": F.array(F.col("page").cast("int"))})
    return h.index_metadata(d).select("document_id", "chunk_index", "title", "source_group", "page", "pages", "sha256")


def manner(s: Star) -> DataFrame:
    return quick_rules.manner(questions(s.raw("conversations"))).select("id", "off_subject", "asks_files", "asks_source", "wants_detail", "smalltalk")


#: Rules for the file names that pages' addresses give.
DRAFTS, RULES = ("thsh", "Dự thảo"), [(("ing", "thion"), "a_ing.pdf"), (("er",), "b_er.pdf"), (("th",), "c_th.pdf")]


def _files(s: Star) -> DataFrame:
    """A file for each page: by its site, some with a name of the standard, some with an extension twice."""
    n, site = F.col("page_id"), F.regexp_extract("url", "^https?://([^/]+)/", 1)
    name = F.when(n % 10 == 0, F.concat(F.lit("law_"), n.cast("string"))).when(n % 101 == 1, F.lit("law_a_ing")).when(n % 17 == 0, F.concat(F.lit("abcdefghijklmnop"), n.cast("string"))).otherwise(F.concat(site, F.lit("_"), (n % 97).cast("string")))
    return s.raw("pages").select(F.concat(F.element_at(F.split(site, r"\."), -1), F.lit("/"), name, F.when(n % 13 == 0, ".pdf.pdf").otherwise(".pdf")).alias("path"), F.sha2((n % 40).cast("string"), 256).alias("sha256")).groupBy("path").agg(F.min("sha256").alias("sha256"))


def file_groups(s: Star) -> DataFrame:
    return files.groups(_files(s).select("path"))


def file_classes(s: Star) -> DataFrame:
    return files.classified(_files(s), DRAFTS, RULES, "law_").groupBy("status", "target").agg(F.count("*").alias("files"))


QUERIES |= {
    "ret06_search": _of(search),
    "ret06_search_by_words": _of(search_by_words),
    "prj03_index_metadata": _of(index_metadata),
    "pl07_manner": _of(manner),
}

_INDEXED = "di AS (SELECT doc_id, source, concat_ws(chr(10), title, source, coalesce(text, '')) AS text FROM dt)"
_SEARCHED = _ROUTED.replace("FROM dt))", "FROM di))")
_PLAIN_ONES = "po AS (SELECT query_id FROM gr GROUP BY 1 HAVING count(*) = 1 AND min(source) = 'shopee_policy')"
_FUSED = f"""x AS (SELECT query_id, doc_id, rank AS vr, {_NORM} AS vn FROM (SELECT *, CAST(score AS DOUBLE) AS s FROM dm) WINDOW w AS (PARTITION BY query_id)), y AS (SELECT query_id, doc_id, rank AS br, {_NORM} AS bn FROM (SELECT *, CAST(score AS DOUBLE) AS s FROM bm) WINDOW w AS (PARTITION BY query_id)),
    k AS (SELECT query_id, doc_id, 0.62::DOUBLE * coalesce(vn, 0) + 0.38::DOUBLE * coalesce(bn, 0) + CASE WHEN vr IS NOT NULL AND br IS NOT NULL THEN 0.05::DOUBLE ELSE 0 END AS base FROM x FULL JOIN y USING (query_id, doc_id)),
    z AS (SELECT query_id, doc_id, CAST(base + coalesce(CAST({_BONUS} AS DOUBLE), 0) AS DECIMAL(18,6)) AS score FROM k JOIN qf USING (query_id) LEFT JOIN df2 USING (doc_id)),
    best AS (SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM z) WHERE rank <= 3)"""
_ORDER = f"WITH {_BASE}, {_FORMS}, {_INDEXED}, {_SEARCHED}, {_PLAIN_ONES}"
ORACLES |= {
    "ret06_search": f"{_ORDER}, {_DENSE}, dm AS (SELECT * FROM dn WHERE query_id NOT IN (SELECT query_id FROM po)), {_FUSED} SELECT query_id, rank, doc_id, score, CASE WHEN query_id IN (SELECT query_id FROM po) THEN 'bm25_fast_path' ELSE 'hybrid_with_heuristic' END AS mode FROM best",
    "ret06_search_by_words": f"{_ORDER}, dm AS (SELECT * FROM bm WHERE false), {_FUSED} SELECT query_id, rank, doc_id, score, CASE WHEN query_id IN (SELECT query_id FROM po) THEN 'bm25_fast_path' ELSE 'bm25_without_vector_db' END AS mode FROM best",
    "prj03_index_metadata": f"WITH {_BASE} SELECT document_id, CASE WHEN doc_id % 3 <> 0 THEN CAST(doc_id AS VARCHAR) ELSE '' END AS chunk_index, title, source AS source_group, page, '[' || page || ']' AS pages, '' AS sha256 FROM dt",
    "pl07_manner": f"""WITH {QUESTIONS_SQL}, f AS (SELECT id, {form_sql("question")} AS form FROM qs) SELECT id, {any_sql(quick_rules.OFF_SUBJECT)} AND NOT {any_sql(quick_rules.ON_SUBJECT)} AS off_subject, {any_sql(quick_rules.DATA_FILES)} AS asks_files,
        {any_sql(quick_rules.LAST_SOURCE)} AS asks_source, {any_sql(quick_rules.DETAIL)} AS wants_detail, CASE WHEN form IN ({", ".join(repr(x) for x in quick_rules.GREETINGS)}) THEN 'greeting' WHEN starts_with(form, 'cam on') THEN 'thanks'
        WHEN form IN ({", ".join(repr(x) for x in quick_rules.AGREED)}) THEN 'agreed' WHEN form IN ({", ".join(repr(x) for x in quick_rules.ABLE)}) OR (contains(form, 'ban') AND contains(form, 'giup') AND contains(form, 'gi')) THEN 'able' WHEN form IN ({", ".join(repr(x) for x in quick_rules.WHO)}) THEN 'who' END AS smalltalk FROM f""",
}

QUERIES |= {"aud03_file_groups": _of(file_groups), "aud04_file_classes": _of(file_classes)}
_SITE = "regexp_extract(url, '^https?://([^/]+)/', 1)"
_FILES = f"""n AS (SELECT page_id AS n, {_SITE} AS site FROM pages), p AS (SELECT string_split(site, '.')[-1] || '/' || CASE WHEN n % 10 = 0 THEN 'law_' || n WHEN n % 101 = 1 THEN 'law_a_ing' WHEN n % 17 = 0 THEN 'abcdefghijklmnop' || n ELSE site || '_' || (n % 97) END
    || CASE WHEN n % 13 = 0 THEN '.pdf.pdf' ELSE '.pdf' END AS path, sha256(CAST(n % 40 AS VARCHAR)) AS sha FROM n), fs AS (SELECT path, min(sha) AS sha FROM p GROUP BY path)"""
ORACLES["aud03_file_groups"] = f"WITH {_FILES} SELECT string_split(path, '/')[1] AS \"group\", count(*) AS files FROM fs GROUP BY 1"
ORACLES["aud04_file_classes"] = f"""WITH {_FILES}, a AS (SELECT *, string_split(path, '/')[-1] AS name, trim(regexp_replace(regexp_replace(lower(regexp_replace(string_split(path, '/')[-1], '\\.[^.]*$', '')), '[^a-z0-9]+', ' ', 'g'), '\\s+', ' ', 'g'), ' ') AS form FROM fs),
    k AS (SELECT *, CASE WHEN starts_with(name, 'law_') THEN 'standard' WHEN contains(form, 'thsh') OR contains(form, 'du thao') THEN 'excluded_draft' WHEN regexp_full_match(replace(form, ' ', ''), '[a-z0-9]{{15,}}') THEN 'manual_review' END AS kind FROM a),
    t AS (SELECT *, CASE WHEN kind IS NULL THEN CASE WHEN contains(form, 'ing') OR contains(form, 'thion') THEN 'a_ing.pdf' WHEN contains(form, 'er') THEN 'b_er.pdf' WHEN contains(form, 'th') THEN 'c_th.pdf' END END AS target FROM k),
    o AS (SELECT target, arg_min(path, (late, path)) AS owner, arg_min(sha, (late, path)) AS osha FROM (SELECT name AS target, 0 AS late, path, sha FROM t WHERE kind = 'standard' UNION ALL SELECT target, 1, path, sha FROM t WHERE target IS NOT NULL) GROUP BY target)
    SELECT status, target, count(*) AS files FROM (SELECT t.target, coalesce(kind, CASE WHEN t.target IS NULL THEN 'unrecognized' WHEN owner = path THEN 'renamed' WHEN osha = sha THEN 'duplicate' ELSE 'conflict' END) AS status FROM t LEFT JOIN o USING (target)) GROUP BY ALL"""
