"""Retrieval's heuristics: the groups a question is about, the additive bonus of its candidates, citation scores, how far
the evidence carries, and the labels of sources. Rules are tables; each compiles to one expression over the candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import match_form, unigrams
from .retrieval import bm25, candidates, dense, fused, sent
from .router import Test, equals, flagged, holds, holds_all, routed

# The words that send a question to a group of sources, in their order.
API_WORDS = (
    "api", "open platform", "signature", "chu ky", "base_string", "partner_id", "shop_id", "merchant_id", "access_token", "authorization", "endpoint", "webhook",
)
OPERATIONS_WORDS = (
    "sku", "roas", "gia von", "bien loi nhuan", "loi nhuan gop", "gia san", "hoa von", "ton kho an toan", "dat hang lai", "so ngay du hang", "vong quay ton kho", "ty le ban het", "hang cham ban",
    "combo", "gia tri don trung binh", "ty le chuyen doi", "mo shop", "shop moi", "nha cung cap", "dong tien", "doi soat", "dong goi", "cham soc khach", "danh gia san pham", "quan ly don",
    "kiem tra don", "hang cam", "hang han che", "du lieu csv", "bao mat tai khoan", "muc chac chan",
)
REPORT_WORDS = ("gmv", "gross orders", "sea limited", "ket qua kinh doanh", "doanh thu shopee")
LAW_WORDS = ("phap luat", "luat", "nghi dinh", "nguoi tieu dung", "du lieu ca nhan", "du lieu khach hang", "nhan hang hoa", "hop dong", "giao dich dien tu")
POLICY_WORDS = ("phi", "tra hang", "hoan tien", "khieu nai", "van chuyen", "dang ban", "nguoi ban")
ROUTES: list[tuple[str, Test]] = [
    ("shopee_api", holds(*API_WORDS)),
    ("seller_operations_guides", holds(*OPERATIONS_WORDS)),
    ("sea_shopee_reports,ecommerce_market_reports", holds(*REPORT_WORDS)),
    ("legal_ecommerce,shopee_policy,seller_operations_guides", holds(*LAW_WORDS)),
    ("shopee_policy", holds(*POLICY_WORDS)),
]
#: Fixed: phrases of questions that only a seller's own data answers.
OWN_DATA = (
    "shop toi", "cua shop toi", "doanh thu thang", "loi nhuan shop", "ton kho shop", "san pham cua toi", "don hang cua toi", "quang cao cua toi", "roas cua toi",
)


def source_groups(questions: DataFrame) -> DataFrame:
    """query_id, source: the groups that each question is about; none for those about no group in particular."""
    q = questions.select("query_id", match_form(F.col("question")).alias("form"))
    return routed(q, ROUTES).filter("route is not null").select("query_id", F.explode(F.split("route", ",")).alias("source"))


def own_data_asked(text: Column) -> Column:
    form = match_form(text)
    return reduce(Column.__or__, (F.contains(form, F.lit(p)) for p in OWN_DATA))


def _q(*phrases: str) -> Test:
    return holds(*phrases, view="q")


def _text(*phrases: str) -> Test:
    return holds(*phrases, view="form")


def _title(*phrases: str) -> Test:
    return holds(*phrases, view="title_form")


def _is(column: str, value: str) -> Test:
    return equals(value, view=column)


_fixed = holds_all("phi co dinh", "cap", "sac", view="q")
_transaction = _q("phi xu ly giao dich") | (_q("phi thanh toan") & _q("ten moi", "moc ap dung")) | (holds_all("khau tru", "giao dich", view="q") & _q("kenh", "xem"))
_listing = _q("quy dinh dang ban") | holds_all("nguyen tac", "dang san pham", view="q")
_refund = holds_all("nguoi mua", "hoan tien", view="q") & _q("bao lau", "thoi han", "thoi gian")
_banned = _q("cam dang ban", "san pham nao bi cam", "hang cam")
_return = holds_all("tra hang", "bao lau", view="q")
_duty = holds_all("trach nhiem", "nguoi tieu dung", view="q")
_privacy = _q("bao ve du lieu ca nhan")
#: Fixed: conditions on question and text, and what each adds to a candidate's score.
BONUS: list[tuple[Test, float]] = [
    (_fixed & (_is("document_id", "SHP_FEE_006") | _title("bieu phi co dinh theo nganh hang")), 0.32),
    (_fixed & _is("page", "7"), 0.18),
    (_fixed & holds_all("cap", "sac", "bo chuyen doi", view="form"), 0.25),
    (_fixed & _text("12"), 0.18),
    (_fixed & _title("dieu khoan dich vu"), -0.30),
    (_transaction & (_is("document_id", "SHP_FEE_004") | _title("phi xu ly giao dich")), 0.30),
    # No form has an equals sign, so this one never holds; it is kept as the rule says it.
    (_transaction & holds_all("phi xu ly giao dich =", "6%", view="form"), 0.16),
    (_listing & (_is("document_id", "SHP_POL_007") | _title("quy dinh dang ban san pham")), 0.28),
    (_refund & _is("document_id", "SHP_RET_003") & _is("page", "1"), 0.20),
    (_refund & holds_all("trong vong 15 ngay", "don giao thanh cong", view="form"), 0.14),
    (_banned & _title("cam han che san pham", "quy dinh dang ban san pham", "quy che hoat dong san"), 0.28),
    (_banned & _text("san pham bi cam", "hang hoa cam", "khong duoc phep dang ban", "danh sach san pham cam"), 0.24),
    (_banned & _title("nganh hang han che khuyen mai"), -0.45),
    (_return & _title("quy trinh tra hang hoan tien nguoi ban"), 0.18),
    (_return & _text("trong vong 2 ngay", "moc thoi gian co the khieu nai", "phan hoi"), 0.20),
    (_return & holds_all("trong vong 6 ngay", "nguoi mua", view="form"), -0.10),
    (_duty & _is("source", "legal_ecommerce"), 0.22),
    (_duty & _text("cung cap thong tin day du", "bao ve quyen loi nguoi tieu dung", "giai quyet khieu nai", "nghia vu nguoi ban"), 0.20),
    (_privacy & _is("source", "legal_ecommerce"), 0.22),
    (_privacy & _text("bao mat thong tin ca nhan", "xu ly du lieu ca nhan", "luu tru thong tin ca nhan", "xoa thong tin"), 0.18),
    (holds_all("merchant api", "base_string", view="q") & holds_all("merchant api", "merchant_id", view="form"), 0.24),
    (holds_all("shop api", "base_string", view="q") & holds_all("shop api", "shop_id", view="form"), 0.24),
    (holds_all("gmv", "quy 4", "2025", view="q") & holds_all("36.7", "28.6", view="form"), 0.30),
]


def bonuses(pairs: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id, doc_id, bonus of each pair. pairs: query_id, doc_id (candidates: few for each query). queries: query_id,
    question. docs: doc_id, title, text, source, page, document_id. Each side's phrases are looked for once a question
    and once a text, not once a pair."""
    groups = list(dict.fromkeys(g for test, _ in BONUS for g in test.groups()))
    name = {g: f"_g{n}" for n, g in enumerate(groups)}
    asked = {name[g]: g for g in groups if g.view == "q"}
    held = {name[g]: g for g in groups if g.view != "q"}
    q = flagged(queries.select("query_id", match_form(F.col("question")).alias("q")), asked).drop("q")
    wanted = docs.join(sent(pairs.select("doc_id").distinct()), "doc_id", "left_semi")
    plain = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    d = wanted.select(
        "doc_id", match_form(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit("")))).alias("form"), match_form(F.coalesce("title", F.lit(""))).alias("title_form"),
        *(plain(c).alias(c) for c in ("source", "page", "document_id")),
    )
    d = flagged(d, held).drop("form", "title_form")
    total = sum((F.when(test.over(name), F.lit(f"{weight:.2f}").cast("decimal(6,2)")).otherwise(F.lit("0").cast("decimal(6,2)")) for test, weight in BONUS), F.lit("0").cast("decimal(6,2)"))
    return pairs.select("query_id", "doc_id").join(q, "query_id").join(d, "doc_id").select("query_id", "doc_id", total.cast("decimal(6,2)").alias("bonus"))


# Words that citations are not matched by, and the phrases of each topic's titles.
STOP_WORDS = ("la", "cua", "cho", "va", "thi", "nao", "bao", "nhieu", "tren", "trong", "duoc", "nhung", "cac", "mot", "voi", "theo", "tai", "lieu", "shopee")
TITLE_PHRASES = {
    "transaction_fee": ("phi xu ly giao dich",), "fixed_fee": ("bieu phi co dinh", "phi co dinh"), "merchant_api": ("api calls", "merchant api", "authorization"),
    "shop_api": ("api calls", "shop authorization", "shop api"), "public_api": ("api calls", "public api"), "open_platform": ("platform introduction", "open platform", "api calls"),
    "return_refund": ("tra hang", "hoan tien"), "shopee_xu": ("shopee xu", "diem thuong"),
}
#: Fixed: a citation's least score, the share of the best one's that it must reach, and how many are shown.
LEAST_SCORE, OF_BEST, SHOWN = 2.0, 0.62, 2


def year_of(title: Column) -> Column:
    """The latest year from 2000 to 2099 that a title names, or 0."""
    years = F.transform(F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit("20[0-9]{2}"), F.lit(0)), lambda y: y.cast("int"))
    return F.coalesce(F.array_max(years), F.lit(0))


def citation_words(text: Column) -> Column:
    return F.array_distinct(F.filter(unigrams(text), lambda w: (F.length(w) >= 3) & ~w.isin(*STOP_WORDS)))


def _clamped(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(score.cast("double"), F.lit(0.0))))


def _least0(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.coalesce(score.cast("double"), F.lit(0.0)))


def citation_scores(results: DataFrame) -> DataFrame:
    """results with citation_score and year. results: question, topic, title, hybrid_score, vector_score, bm25_score (may be
    null)."""
    title = match_form(F.coalesce("title", F.lit("")))
    phrases = reduce(lambda acc, t: acc.when(F.col("topic") == t, sum((F.when(F.contains(title, F.lit(p)), 6.0).otherwise(0.0) for p in TITLE_PHRASES[t]), F.lit(0.0))), TITLE_PHRASES, F).otherwise(0.0)
    overlap = F.size(F.array_intersect(citation_words(F.col("question")), citation_words(F.col("title"))))
    year = year_of(F.col("title"))
    score = (
        phrases + overlap * 2.5 + F.least(_least0(F.col("hybrid_score")), F.lit(2.0)) + _clamped(F.col("vector_score")) * 2.0
        + F.least(_least0(F.col("bm25_score")) / 25.0, F.lit(4.0)) + year / 10000.0
    )
    return results.withColumns({"citation_score": score.cast("decimal(18,6)"), "year": year})


def citations(results: DataFrame, most: int = SHOWN) -> DataFrame:
    """query_id, place, title, page, year, citation_score: the best distinct sources (title and page) of each query that
    reach 62 % of the best one's score and 2.0. results: as for citation_scores, with query_id, rank, page; sources without
    a title are none. Of equal sources the first counts, of equal scores the later year, then the earlier rank."""
    own = results.filter(F.trim(F.coalesce("title", F.lit(""))) != "").withColumn("page", F.trim(F.coalesce(F.col("page").cast("string"), F.lit("—"))))
    first = own.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", F.lower(F.trim("title")), "page").orderBy("rank"))).filter("_n = 1")
    scored = citation_scores(first)
    query = Window.partitionBy("query_id")
    good = scored.withColumn("_best", F.max("citation_score").over(query)).filter(F.col("citation_score").cast("double") >= F.greatest(F.lit(LEAST_SCORE), F.col("_best").cast("double") * OF_BEST))
    place = F.row_number().over(query.orderBy(F.desc("citation_score"), F.desc("year"), "rank"))
    return good.withColumn("place", place.cast("long")).filter(F.col("place") <= most).select("query_id", "place", F.trim("title").alias("title"), "page", "year", "citation_score")


# Ways of answering that have no score, and those that have a fixed one.
UNSCORED = (
    "clarification", "smalltalk", "capabilities", "out_of_scope", "private_data_missing", "private_business_data", "private_inventory_missing", "operational_missing", "processing_error",
    "processing_timeout", "not_answerable", "no_result", "rewards_guard", "deadline_guard", "data_guidance", "guidance",
)
CALCULATED = ("calculation", "calculation_followup", "calculation_guard")
DETERMINED = (
    "api_comparison", "three_api_comparison", "public_api_guard", "conversation_guard", "merchant_base_string", "signature_flow", "signature_algorithm", "verification_guard",
    "merchant_api_overview", "merchant_api_auth_components", "full_api_guide", "merchant_signature_python_example", "merchant_vietnamese_only", "example_followup", "fixed_fee_example",
    "global_fee_lookup", "partner_key_guard", "direct_domain", "deterministic", "confirmation_followup", "topic_summary", "topic_explanation",
)
KNOWN_TOPICS = ("transaction_fee", "fixed_fee", "merchant_api", "shop_api", "public_api", "open_platform")


def sufficiency(mode: Column, topic: Column, cited: Column, results: Column, hybrid: Column, vector: Column, bm25: Column) -> Column:
    """How far the evidence carries an answer, 0 to 100, or null: a heuristic, no probability. cited: whether there are
    citations; results: whether anything was retrieved; the scores are those of the best result."""
    h, v, b = _least0(hybrid), _clamped(vector), _least0(bm25)
    score = 60 + 15 * v + 11 * F.when(b > 0, b / (b + 30.0)).otherwise(0.0) + 10 * (h / (h + 1.0)) + F.when(cited, 3).otherwise(0) - F.when(mode == "llm", 3).otherwise(0)
    # Halves go to the even number.
    found = F.greatest(F.lit(55), F.least(F.lit(95), F.bround(score).cast("int")))
    return (
        F.when(mode.isin(*UNSCORED), F.lit(None)).when(mode.isin(*CALCULATED), 99).when(mode.isin(*DETERMINED) & cited, 97)
        .when((mode == "fast") & cited & F.coalesce(topic.isin(*KNOWN_TOPICS), F.lit(False)), 96).when(results, found).when(cited, 91)
    )


def band(confidence: Column) -> Column:
    """Fixed: names of the bands."""
    return F.when(confidence.isNull(), "").when(confidence >= 90, "Cao").when(confidence >= 75, "Khá cao").when(confidence >= 60, "Trung bình").otherwise("Thấp")


def similarity_band(score: Column) -> Column:
    """band and percent of a score from 0 to 1. Fixed: the bands."""
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    name = F.when(bounded >= 0.78, "Cao").when(bounded >= 0.58, "Trung bình").otherwise("Thấp")
    return F.struct(name.alias("band"), F.bround(bounded * 100).cast("int").alias("percent"))


def label(title: Column, page: Column, group: Column) -> Column:
    """title | trang page | nhóm group, without what is blank."""
    part = lambda c, before: F.when(F.trim(F.coalesce(c.cast("string"), F.lit(""))) != "", F.concat(F.lit(before), F.trim(c.cast("string"))))
    return F.concat_ws(" | ", part(title, ""), part(page, "trang "), part(group, "nhóm "))


def context_strings(chunks: DataFrame) -> DataFrame:
    """query_id, context: the numbered blocks of each query's chunks in their order. chunks: query_id, place, title, page,
    source, text; they are few for each query, as they fit a budget of characters."""
    number = F.row_number().over(Window.partitionBy("query_id").orderBy("place"))
    # Fixed: the names of a block's lines; blank ones are left out.
    line = lambda c, name: F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "", F.concat(F.lit(f"{name}: "), F.trim(F.col(c).cast("string"))))
    head = F.concat_ws("\n", F.concat(F.lit("[NGUỒN "), F.col("_n").cast("string"), F.lit("]")), line("title", "Tài liệu"), line("page", "Trang"), line("source", "Nhóm"))
    block = F.concat(head, F.lit("\nNội dung:\n"), F.trim(F.coalesce("text", F.lit(""))))
    rows = chunks.withColumn("_n", number).select("query_id", F.struct("_n", block.alias("b")).alias("x"))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["b"]), "\n\n").alias("context"))


#: Fixed: the one group whose questions are answered from words alone.
WORDS_ONLY = "shopee_policy"


def search(docs: DataFrame, queries: DataFrame, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, k: int = 3) -> DataFrame:
    """query_id, rank, doc_id, score, mode of the k best results: questions are routed to groups, candidates found by words
    and by vectors, fused and given their bonus. Questions about policies alone, and all of them without vectors, are
    answered by words alone. docs: doc_id, title, source, text, page, document_id; words are looked for in title, source
    and text. queries: query_id, question. vectors: doc_id, vector, source. query_vectors: query_id, vector."""
    groups = source_groups(queries)
    routes = groups.groupBy("query_id").agg(F.collect_set("source").alias("s"))
    plain = routes.filter(F.col("s") == F.array(F.lit(WORDS_ONLY))).select("query_id")
    indexed = docs.withColumn("text", F.concat_ws("\n", *(F.coalesce(c, F.lit("")) for c in ("title", "source", "text"))))
    words = bm25(indexed.select("doc_id", "text", "source"), queries, groups=groups)
    if vectors is None or query_vectors is None:
        near = queries.sparkSession.createDataFrame([], words.schema)
    else:
        near = dense(vectors, query_vectors.join(plain, "query_id", "left_anti"), groups=groups)
    both = candidates(near, words)
    found = fused(near, words, k, bonuses(both, queries, docs)).join(F.broadcast(plain).withColumn("_plain", F.lit(True)), "query_id", "left")
    mode = F.when(F.col("_plain"), "bm25_fast_path").otherwise("bm25_without_vector_db" if vectors is None else "hybrid_with_heuristic")
    return found.select("query_id", "rank", "doc_id", "score", mode.alias("mode"))


#: Fixed: what is kept of a chunk beside its text.
METADATA = (
    "document_id", "chunk_index", "title", "document_type", "source_group", "source", "source_owner", "source_url", "organization", "published_year", "effective_date", "language", "file_path",
    "detected_file_path", "sha256", "data_authenticity", "verification_status", "location_type", "location", "page", "page_start", "page_end", "pages", "char_count",
)


def index_metadata(chunks: DataFrame) -> DataFrame:
    """The 24 fields of an index as text: those that are missing or null as empty text, lists and structs as JSON."""

    def kept(name: str) -> Column:
        if name not in chunks.columns:
            return F.lit("").alias(name)
        kind = dict(chunks.dtypes)[name]
        value = F.to_json(name) if kind.startswith(("array", "struct", "map")) else F.col(name)
        return F.coalesce(value.cast("string"), F.lit("")).alias(name)

    return chunks.select(*(kept(n) for n in METADATA))
