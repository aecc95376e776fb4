"""What an evaluation holds an answer to: documents and pages found, the contract of a whole answer, classes of errors, and
the items that a benchmark can be made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_text
from .evaluation import safe

# What an answer must say about made-up data and about questions that aren't answered.
DISCLAIMER, REFUSAL = "dữ liệu vận hành mô phỏng", "ngoài phạm vi"
#: Fixed: classes of errors, the first that applies, by priority.
CLASSES = ("not_retrieved_top10", "relevant_below_top5", "partial_multi_document_retrieval", "wrong_page", "ranking_error_top1", "success")
#: Fixed: what a chunk needs to stand for a question.
LEAST_CHUNK, MOST_DOTS = 180, 8


def document_metrics(results: DataFrame, expected: DataFrame, pages: DataFrame, cut: int = 5, deep: int = 10) -> DataFrame:
    """query_id, hit_at_1, hit_at_5, hit_at_10, unique_document_recall_at_5, page_hit_at_5 of every query with expected
    documents. results: query_id, rank, doc_id, page. expected: query_id, doc_id. pages: query_id, page; a query without
    expected pages has no page hit to speak of (null). Ranks count results, the unique recall counts distinct documents."""
    e = expected.select("query_id", "doc_id").distinct()
    n = e.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    wanted = pages.filter("page <> ''").select("query_id", "page").distinct()
    hits = results.join(e, ["query_id", "doc_id"], "left_semi")
    first = results.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    places = first.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "doc_id")))
    found = places.join(e, ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.count_if(F.col("place") <= cut).alias("unique"))
    at = hits.groupBy("query_id").agg(F.min("rank").alias("best"))
    on_page = hits.filter(F.col("rank") <= cut).join(wanted, ["query_id", "page"], "left_semi").select("query_id").distinct().withColumn("on_page", F.lit(1))
    asked = wanted.select("query_id").distinct().withColumn("asked", F.lit(True))
    m = n.join(at, "query_id", "left").join(found, "query_id", "left").join(on_page, "query_id", "left").join(asked, "query_id", "left")
    hit = lambda k: F.coalesce((F.col("best") <= k).cast("int"), F.lit(0))
    return m.select(
        "query_id", hit(1).alias("hit_at_1"), hit(cut).alias("hit_at_5"), hit(deep).alias("hit_at_10"), (F.coalesce("unique", F.lit(0)) / F.col("n").cast("double")).alias("unique_document_recall_at_5"),
        F.when(F.col("asked"), F.coalesce("on_page", F.lit(0))).alias("page_hit_at_5"), F.col("n").alias("expected_documents"),
    )


def error_class(rows: DataFrame) -> Column:
    """The first class that applies to a row of document_metrics."""
    return (
        F.when(F.col("hit_at_5") == 0, F.when(F.col("hit_at_10") == 1, CLASSES[1]).otherwise(CLASSES[0]))
        .when((F.col("expected_documents") > 1) & (F.col("unique_document_recall_at_5") < 1.0), CLASSES[2])
        .when(F.coalesce(F.col("page_hit_at_5") == 0, F.lit(False)), CLASSES[3]).when(F.col("hit_at_1") == 0, CLASSES[4]).otherwise(CLASSES[5])
    )


def classified(metrics: DataFrame) -> DataFrame:
    """query_id, error_class, priority (0: see to it first)."""
    c = metrics.select("query_id", error_class(metrics).alias("error_class"))
    return c.withColumn("priority", (F.array_position(F.array(*map(F.lit, CLASSES)), F.col("error_class")) - 1).cast("int"))


def _set(values: str) -> Column:
    return F.array_distinct(F.filter(F.transform(F.coalesce(F.col(values), F.array().cast("array<string>")), lambda v: F.trim(v)), lambda v: v != ""))


CHECKS = (
    "intent_correct", "plan_tools_correct", "tools_executed", "citations_correct", "citation_document_correct", "answer_marker_correct", "disclaimer_correct", "refusal_correct", "period_correct",
    "no_trace_error",
)


def contract(runs: DataFrame) -> DataFrame:
    """id, split, the ten checks, whether two of them apply, and overall_pass. runs: id, split, expected_intent, intent,
    expected_tools, tools, expected_period, period, expected_documents, cited_documents, expected_markers (arrays of
    strings), answer, trace (array of tool, status), verified, latency."""
    none = F.array().cast("array<string>")
    wanted, planned = F.coalesce("expected_tools", none), F.coalesce("tools", none)
    done = F.transform(F.filter(F.coalesce("trace", F.array().cast("array<struct<tool:string,status:string>>")), lambda t: t["status"] == "ok"), lambda t: t["tool"])
    failed = F.exists(F.coalesce("trace", F.array().cast("array<struct<tool:string,status:string>>")), lambda t: F.coalesce(t["status"] == "error", F.lit(False)))
    traced = F.coalesce(F.size("trace"), F.lit(0)) > 0
    answer = F.lower(F.coalesce("answer", F.lit("")))
    cited = F.coalesce(F.size("cited_documents"), F.lit(0)) > 0
    documents, markers = _set("expected_documents"), _set("expected_markers")
    needs = lambda tool: F.array_contains(wanted, tool)
    same = lambda a, b: F.coalesce(F.col(a), F.lit("")) == F.coalesce(F.col(b), F.lit(""))
    checks = {
        "intent_correct": same("expected_intent", "intent"), "plan_tools_correct": wanted == planned, "tools_executed": F.size(F.array_except(wanted, done)) == 0, "citations_correct": needs("rag") == cited,
        "citation_document_correct": (F.size(documents) == 0) | F.arrays_overlap(documents, _set("cited_documents")), "answer_marker_correct": F.forall(markers, lambda m: F.contains(answer, F.lower(m))),
        "disclaimer_correct": ~needs("shop_data") | F.contains(answer, F.lit(DISCLAIMER)),
        "refusal_correct": (F.coalesce("expected_intent", F.lit("")) != "out_of_scope") | (F.contains(answer, F.lit(REFUSAL)) & ~traced),
        "period_correct": (F.coalesce("expected_period", F.lit("")) == "") | same("expected_period", "period"), "no_trace_error": ~failed,
    }
    rows = runs.select("id", F.lower(F.trim(F.coalesce("split", F.lit("")))).alias("split"), *(c.alias(n) for n, c in checks.items()), (F.size(documents) > 0).alias("documents_apply"), (F.size(markers) > 0).alias("markers_apply"), F.coalesce("verified", F.lit(False)).alias("verified"), F.coalesce("latency", F.lit(0.0)).alias("latency"))
    overall = F.lit(True)
    for n in CHECKS:
        overall = overall & F.col(n)
    return rows.withColumn("overall_pass", overall)


def contract_summary(rows: DataFrame) -> DataFrame:
    """One row: counts, the rate of every check (of two, only where they apply: null if nowhere), and latencies."""
    rate = lambda c: safe(F.count_if(c), F.count(F.lit(1)))
    applied = lambda c, where: F.try_divide(F.count_if(F.col(c) & F.col(where)).cast("double"), F.count_if(F.col(where)).cast("double"))
    rates = [
        applied(n, {"citation_document_correct": "documents_apply", "answer_marker_correct": "markers_apply"}[n]).alias(n) if n in ("citation_document_correct", "answer_marker_correct") else rate(F.col(n)).alias(n) for n in CHECKS
    ]
    return rows.agg(
        F.count(F.lit(1)).alias("items"), rate(F.col("overall_pass")).alias("overall_pass"), *rates, F.count_if("documents_apply").alias("document_checks"), F.count_if("markers_apply").alias("marker_checks"),
        F.coalesce(F.percentile("latency", F.lit(0.5)), F.lit(0.0)).alias("latency_median"), F.coalesce(F.expr("percentile_disc(0.95) within group (order by latency)"), F.lit(0.0)).alias("latency_p95"), F.count_if("verified").alias("verified"),
    )


def loaded(raw: DataFrame) -> DataFrame:
    """Items of a benchmark with what is left out filled in, and the scope of their question: private before unanswerable
    before answerable. raw: id, question, and any of split, category, query_type, expected_documents, expected_pages,
    answerable, requires_private_shop_data, gold_verified."""
    there = set(raw.columns)
    of = lambda c, default, kind: (F.coalesce(F.col(c).cast(kind), default) if c in there else default).alias(c)
    none, text = F.array().cast("array<string>"), F.lit("")
    rows = raw.select(
        F.col("id").cast("string").alias("id"), F.col("question").cast("string").alias("question"), F.lower(F.trim(F.coalesce(F.col("split"), text) if "split" in there else text)).alias("split"),
        of("category", text, "string"), of("query_type", text, "string"), of("expected_documents", none, "array<string>"), of("expected_pages", none, "array<string>"), of("answerable", F.lit(True), "boolean"),
        of("requires_private_shop_data", F.lit(False), "boolean"), of("gold_verified", F.lit(False), "boolean"),
    )
    scope = F.when(F.col("requires_private_shop_data"), "private_data").when(~F.col("answerable"), "out_of_scope").otherwise("answerable")
    return rows.withColumn("scope", scope)


def selected(items: DataFrame, splits: tuple[str, ...]) -> DataFrame:
    """Answerable items of these splits; an error if any of them isn't verified."""
    chosen = items.filter(F.col("answerable") & F.col("split").isin(*splits))
    first = chosen.filter("not gold_verified").select("id").orderBy("id").first()
    if first is not None:
        raise ValueError(f"item {first.id} isn't verified")
    return chosen


def candidate_chunks(chunks: DataFrame, prefixes: dict[str, tuple[str, ...]]) -> DataFrame:
    """category, document_id, chunk_index, text of chunks that a question can be made of, for the categories whose prefixes
    their document's id begins with. chunks: document_id, chunk_index, text."""
    text = clean_text(F.coalesce("text", F.lit("")))
    good = chunks.select("document_id", "chunk_index", text.alias("text")).filter((F.length("text") >= LEAST_CHUNK) & (F.regexp_count("text", F.lit(r"\.\.\.")) <= MOST_DOTS))
    of = F.array_compact(F.array(*(F.when(F.exists(F.array(*map(F.lit, p)), lambda x: F.col("document_id").startswith(x)), c) for c, p in sorted(prefixes.items()))))
    return good.select(F.explode(of).alias("category"), "document_id", "chunk_index", "text")


def first_documents(candidates: DataFrame, n: int = 3) -> DataFrame:
    """category, place, document_id: the first distinct documents of each category."""
    each = candidates.select("category", "document_id").distinct()
    place = F.row_number().over(Window.partitionBy("category").orderBy("document_id"))
    return each.withColumn("place", place.cast("long")).filter(F.col("place") <= n)


def unknown_citations(items: DataFrame, catalogue: DataFrame) -> DataFrame:
    """id, document_id: cited documents that the catalogue doesn't have. items: id, expected_documents."""
    cited = items.select("id", F.explode("expected_documents").alias("document_id")).withColumn("document_id", F.trim("document_id")).filter("document_id <> ''").distinct()
    return cited.join(catalogue.select("document_id"), "document_id", "left_anti").select("id", "document_id")


def repeated_keys(rows: DataFrame, key: str) -> DataFrame:
    """key, times of keys that come more than once."""
    return rows.groupBy(F.col(key).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("times")).filter("times > 1")


def readiness(items: DataFrame, locked: bool) -> DataFrame:
    """total, verified, test, verified_test, status: PASS if the benchmark is locked, has items and all are verified; else
    BLOCK. items: split, gold_verified."""
    test = F.lower(F.trim(F.coalesce("split", F.lit("")))) == "test"
    verified = F.coalesce("gold_verified", F.lit(False))
    c = items.agg(F.count(F.lit(1)).alias("total"), F.count_if(verified).alias("verified"), F.count_if(test).alias("test"), F.count_if(test & verified).alias("verified_test"))
    return c.withColumn("status", F.when(F.lit(locked) & (F.col("total") > 0) & (F.col("verified") == F.col("total")), "PASS").otherwise("BLOCK"))
