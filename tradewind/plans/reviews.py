"""Queries of reviews, audits, gates, digests and nested sources, over data derived from the tables; with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, provenance, review
from ..sources import nested
from ..sources.testdata import Star
from .questions import any_sql
from .texts import _PLAIN, _WORDS

Query = Callable[[SparkSession, str], DataFrame]


def _records(s: Star) -> DataFrame:
    """Turns as records; every 29th comes twice."""
    c = s.raw("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).cast("string").alias("id"), F.col("text").alias("question"), "role", F.lit("draft").alias("review_status"))
    return c.unionByName(c.filter("cast(id as bigint) % 29 = 0"))


def _reviews(s: Star) -> DataFrame:
    """A review of every third turn, a second one of every ninth, some of turns that aren't there, some that break a rule."""
    n = F.col("conv_id") * 1000 + F.col("turn")
    c = s.raw("conversations").withColumn("n", n).filter("n % 3 = 0")
    at = F.when(F.col("n") % 9 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    c = c.select("n", F.col("text"), F.explode(at).alias("k"))
    pick = lambda *values: F.get(F.array(*map(F.lit, values)), (F.col("n") % len(values)).cast("int"))
    return c.select(
        F.concat(F.when(F.col("n") % 31 == 0, "x").otherwise(" "), F.col("n").cast("string"), F.lit(" ")).alias("id"), (F.col("n") * 2 + F.col("k")).alias("at"), pick("An", "Binh ", "", "Chi", "Dung").alias("reviewer"),
        pick("verified", "needs_rewrite", "rejected", "done", "verified", "verified", "rejected").alias("status"), (F.col("n") % 4 != 0).alias("confirmed"),
        F.concat(F.lit(" Câu hỏi "), F.col("k").cast("string"), F.lit(": "), F.coalesce("text", F.lit(""))).alias("question"), pick("Đáp án", "Có", "Không", " ", "Đúng", "Sai", "Có", "Không", "Đúng", "Sai", "Có").alias("reference_answer"),
        F.when(F.col("n") % 13 != 0, F.array(F.struct(F.lit("D1").alias("document_id"), F.col("k").cast("string").alias("page"), F.lit("s").alias("support")))).alias("evidence"),
        F.array(F.lit(" D1 "), F.lit("")).alias("expected_documents"), F.array(F.col("k").cast("string")).alias("expected_pages"), pick("đã kiểm tra trang gốc", " ngắn ", "kiểm tra lại lần nữa").alias("note"),
    )


def reviewed(s: Star) -> DataFrame:
    df = review.applied(_records(s), _reviews(s)).records
    return df.select("id", "question", "role", "review_status", "reference_answer", F.to_json("evidence").alias("evidence"), F.array_join("expected_documents", ",").alias("documents"), "gold_verified", "reviewer", "verification_note")


def journal(s: Star) -> DataFrame:
    return review.applied(_records(s), _reviews(s)).journal


def refused(s: Star) -> DataFrame:
    return review.applied(_records(s), _reviews(s)).refused


def _items(s: Star) -> DataFrame:
    """An item for each labelled document, citing it, a page that isn't there, or another's text; some ids come twice."""
    n = F.col("doc_id")
    text = s.raw("labels").select("doc_id", "quality").join(s.raw("documents").select("doc_id", "text"), "doc_id").withColumn("text", F.coalesce("text", F.lit("")))
    one = F.struct(
        F.when(n % 19 == 0, "").otherwise(n.cast("string")).alias("document_id"), F.when(n % 7 == 0, "9").otherwise("1").alias("page"),
        F.when(n % 5 == 0, F.concat(F.lit("Xin chào "), F.substring("text", 10, 150))).when(n % 11 == 0, F.lit("đoạn văn này không có trong tài liệu nào cả, xin đừng tìm nó")).otherwise(F.substring("text", 5, 300)).alias("support"),
    )
    two = F.struct(F.lit("77").alias("document_id"), F.lit("1").alias("page"), F.substring("text", 1, 60).alias("support"))
    evidence = F.when(n % 23 == 0, F.array().cast("array<struct<document_id:string,page:string,support:string>>")).when(n % 17 == 0, F.array(one, two)).otherwise(F.array(one))
    question = F.concat(F.when(n % 6 == 0, "Theo trang 12: ").otherwise(""), F.when(n % 4 == 0, F.substring("text", 1, 80)).otherwise(F.lit("Người bán cần làm gì khi khách không nhận hàng?")))
    return text.select(
        F.when(n % 37 == 0, "").when(n % 41 == 0, "Q0").otherwise(F.concat(F.lit("Q"), n.cast("string"))).alias("id"), question.alias("question"), (n % 8 != 0).alias("answerable"), (F.col("quality") == 1).alias("gold_verified"),
        F.when(n % 29 == 0, F.array().cast("array<string>")).otherwise(F.array(n.cast("string"))).alias("expected_documents"), F.array(F.lit("1")).alias("expected_pages"), evidence.alias("evidence"),
        F.get(F.array(*map(F.lit, ("dev", "Test ", "challenge", "train"))), (n % 4).cast("int")).alias("split"),
    )


def _chunks(s: Star) -> DataFrame:
    return s.raw("documents").select("doc_id", F.col("doc_id").cast("string").alias("document_id"), F.lit("1").alias("page"), "text")


def audited(s: Star) -> DataFrame:
    a = audit.audited(_items(s).drop("split"), _chunks(s))
    return a.select("id", F.array_join("flags", ",").alias("flags"), F.array_join("actions", ",").alias("actions"), "review_status")


def audit_flags(s: Star) -> DataFrame:
    return audit.flag_counts(audit.audited(_items(s).drop("split"), _chunks(s)))


def gates(s: Star) -> DataFrame:
    """Labels as a benchmark: quality stands for checked, toxic for flagged."""
    n = F.col("doc_id")
    items = s.raw("labels").select(n.cast("string").alias("id"), F.get(F.array(*map(F.lit, ("dev", " Test", "dev"))), (n % 3).cast("int")).alias("split"), (F.col("quality") == 1).alias("gold_verified"), F.when(F.col("toxic") == 1, F.array(F.lit("toxic"))).alias("flags"))
    return provenance.gates(items).drop("sha256")


def manifest(s: Star) -> DataFrame:
    tables = {t: s.raw(t) for t in ("labels", "benchmark", "region")}
    return provenance.manifest(tables, "retrieval", {"k": "10", "bonus": "no"}, "draft").select("table", "rows", "sha256", "evaluation", "configuration", "status")


def _store(s: Star) -> DataFrame:
    """A conversation record on each line, from a turn each; some lines and fields as they shouldn't be."""
    n = F.col("conv_id") * 1000 + F.col("turn")
    message = F.struct(
        F.when(F.col("turn") % 5 != 0, F.col("role")).alias("role"), F.col("text").alias("content"), F.when(F.col("turn") % 2 == 0, F.col("turn") / 10.0).alias("confidence"),
        F.struct(F.lit("rag").alias("mode"), (F.col("turn") * 0.25).alias("elapsed")).alias("metrics"), F.array(F.struct(F.lit("t").alias("title"))).alias("citations"),
    )
    whole = F.to_json(F.struct(F.col("conv_id").cast("string").alias("id"), F.when(n % 2 == 0, F.concat(F.lit("Hội thoại "), n.cast("string"))).alias("title"), F.lit("2026-01-01T00:00:00").alias("created_at"), F.array(message).alias("messages")))
    # A message that is none before the one that is; a list of messages that is none; no object; no JSON.
    value = (
        F.when(n % 17 == 0, F.left(whole, F.length(whole) - 3)).when(n % 13 == 0, F.concat(F.lit("["), whole, F.lit("]"))).when(n % 11 == 0, F.regexp_replace(whole, r'"messages":\[', '"messages":"none","other":['))
        .when(n % 7 == 0, F.regexp_replace(whole, r'"messages":\[', '"messages":["no object",7,')).when(n % 19 == 0, F.lit("  ")).otherwise(whole)
    )
    return s.raw("conversations").select(value.alias("value"))


def stored_messages(s: Star) -> DataFrame:
    return nested.conversations(_store(s)).select("conversation_id", "title", "updated_at", "place", "role", "content", "confidence", "citations", "mode", "elapsed")


def store_rejects(s: Star) -> DataFrame:
    return nested.rejected(_store(s))


def _answers(s: Star) -> DataFrame:
    """Pages as the posts of an interface's answers."""
    post = F.struct(F.col("html").alias("message"), F.lit("2026-02-03T04:05:06Z").alias("created_time"), F.when(F.col("page_id") % 3 != 0, F.col("url")).alias("permalink_url"))
    return s.raw("pages").select(F.to_json(F.struct(F.array(post).alias("data"))).alias("value"))


def posts(s: Star) -> DataFrame:
    return nested.posts(_answers(s))


def _of(f: Callable[[Star], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(Star(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "ev10_reviewed_records": _of(reviewed),
    "ev10_review_journal": _of(journal),
    "ev10_refused_reviews": _of(refused),
    "ev08_audit": _of(audited),
    "ev08_flag_counts": _of(audit_flags),
    "ev09_gates": _of(gates),
    "snk07_manifest": _of(manifest),
    "src22_stored_messages": _of(stored_messages),
    "src22_store_rejects": _of(store_rejects),
    "src23_posts": _of(posts),
}


def _pick(*values: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][n % {len(values)} + 1]"


_REVIEWS = f"""c AS (SELECT conv_id * 1000 + turn AS n, role, text FROM conversations),
rec AS (SELECT CAST(n AS VARCHAR) AS id, text AS question, role, 'draft' AS review_status FROM c UNION ALL SELECT CAST(n AS VARCHAR), text, role, 'draft' FROM c WHERE n % 29 = 0),
k AS (SELECT n, text, unnest(CASE WHEN n % 9 = 0 THEN [1, 2] ELSE [1] END) AS k FROM c WHERE n % 3 = 0),
rv AS (SELECT CASE WHEN n % 31 = 0 THEN 'x' ELSE ' ' END || n || ' ' AS id, n * 2 + k AS "at", {_pick("An", "Binh ", "", "Chi", "Dung")} AS reviewer,
    {_pick("verified", "needs_rewrite", "rejected", "done", "verified", "verified", "rejected")} AS status, n % 4 <> 0 AS confirmed, ' Câu hỏi ' || k || ': ' || coalesce(text, '') AS question,
    {_pick("Đáp án", "Có", "Không", " ", "Đúng", "Sai", "Có", "Không", "Đúng", "Sai", "Có")} AS reference_answer, n % 13 <> 0 AS has_evidence, CAST(k AS VARCHAR) AS page,
    {_pick("đã kiểm tra trang gốc", " ngắn ", "kiểm tra lại lần nữa")} AS note FROM k),
met AS (SELECT id, count(*) AS records FROM rec GROUP BY id),
jd AS (SELECT rv.*, trim(rv.id, ' ') AS key, coalesce(records, 0) AS records, CASE WHEN status NOT IN ('verified', 'needs_rewrite', 'rejected') THEN 'unknown_status' WHEN trim(reviewer, ' ') = '' THEN 'no_reviewer'
    WHEN length(trim(note, ' ')) < 10 THEN 'short_note' WHEN trim(question, ' ') = '' THEN 'no_question' WHEN trim(reference_answer, ' ') = '' THEN 'no_answer' WHEN NOT has_evidence THEN 'no_evidence'
    WHEN status = 'verified' AND NOT confirmed THEN 'unconfirmed' WHEN coalesce(records, 0) = 0 THEN 'no_record' WHEN records > 1 THEN 'several_records' END AS reason
    FROM rv LEFT JOIN met ON met.id = trim(rv.id, ' ')),
ok AS (SELECT key, "at", status, trim(reviewer, ' ') AS reviewer, trim(question, ' ') AS question, trim(reference_answer, ' ') AS answer, page, trim(note, ' ') AS note FROM jd WHERE reason IS NULL),
fin AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY "at" DESC) AS back FROM ok) WHERE back = 1)"""
_SAID = "CASE WHEN status = 'verified' THEN 'Manual PDF/page review by ' || reviewer || ': ' || note ELSE 'Review by ' || reviewer || ' (' || status || '): ' || note END"
_J = lambda name, value: f"""'"{name}":' || {value}"""
_STR = lambda value: f"CAST(to_json({value}) AS VARCHAR)"
_AFTER = (
    "'{' || "
    + " || ',' || ".join((
        _J("evidence", """'[{"document_id":"D1","page":"' || page || '","support":"s"}]'"""), _J("expected_documents", """'["D1"]'"""), _J("expected_pages", """'["' || page || '"]'"""),
        _J("gold_verified", "CASE WHEN status = 'verified' THEN 'true' ELSE 'false' END"), _J("id", _STR("key")), _J("question", _STR("question")), _J("reference_answer", _STR("answer")), _J("review_note", _STR("note")),
        _J("review_status", _STR("status")), _J("reviewer", _STR("reviewer")), _J("role", _STR("role")), _J("verification_note", _STR(f"({_SAID})")),
    ))
    + " || '}'"
)
_BEFORE = "'{' || " + " || ',' || ".join((_J("id", _STR("key")), _J("question", _STR("old_question")), _J("review_status", _STR("'draft'")), _J("role", _STR("role")))) + " || '}'"

_AUDIT = f"""b AS (SELECT doc_id AS n, quality, coalesce(text, '') AS text FROM labels JOIN documents USING (doc_id)),
it AS (SELECT n, CASE WHEN n % 37 = 0 THEN '' WHEN n % 41 = 0 THEN 'Q0' ELSE 'Q' || n END AS id, CASE WHEN n % 6 = 0 THEN 'Theo trang 12: ' ELSE '' END || CASE WHEN n % 4 = 0 THEN substr(text, 1, 80) ELSE 'Người bán cần làm gì khi khách không nhận hàng?' END AS question,
    n % 8 <> 0 AS answerable, quality = 1 AS verified, CASE WHEN n % 29 <> 0 THEN CAST(n AS VARCHAR) END AS wanted,
    CASE WHEN n % 23 = 0 THEN [] WHEN n % 17 = 0 THEN [e1, {{'document': '77', 'page': '1', 'support': substr(text, 1, 60)}}] ELSE [e1] END AS evidence
    FROM (SELECT *, {{'document': CASE WHEN n % 19 = 0 THEN '' ELSE CAST(n AS VARCHAR) END, 'page': CASE WHEN n % 7 = 0 THEN '9' ELSE '1' END, 'support': CASE WHEN n % 5 = 0 THEN 'Xin chào ' || substr(text, 10, 150)
        WHEN n % 11 = 0 THEN 'đoạn văn này không có trong tài liệu nào cả, xin đừng tìm nó' ELSE substr(text, 5, 300) END}} AS e1 FROM b)),
ch AS (SELECT CAST(doc_id AS VARCHAR) AS document, '1' AS page, {_PLAIN.format("text")} AS t FROM documents),
ev AS (SELECT n, u.document AS document, u.page AS page, trim(u.support, ' ') AS support FROM (SELECT n, unnest(evidence) AS u FROM it)),
ef AS (SELECT *, document <> '' AND support <> '' AS whole, {_PLAIN.format("support")} AS sp, trim(replace({_PLAIN.format("support")}, '...', ''), ' ') AS form, {_WORDS.format(_PLAIN.format("support"))} AS said FROM ev),
ju AS (SELECT ef.*, t IS NOT NULL AS there, t IS NOT NULL AND length(form) >= 40 AND len(said) > 0 AND (contains(t, form) OR len(list_intersect(said, {_WORDS.format("t")})) / CAST(len(said) AS DOUBLE) >= 0.85::DOUBLE) AS borne FROM ef LEFT JOIN ch ON whole AND ef.document = ch.document AND ef.page = ch.page AND t <> ''),
gr AS (SELECT n, bool_or(NOT whole) AS incomplete, bool_or(whole AND NOT there) AS lost, bool_or(whole AND there AND NOT borne) AS unborne, bool_or(whole AND {any_sql(audit.NAVIGATION, "sp")}) AS menu,
    list(document) FILTER (whole) AS documents, list(page) FILTER (whole AND page <> '') AS pages, list_distinct(flatten(list(said))) AS ews FROM ju GROUP BY n),
tm AS (SELECT id, count(*) > 1 AS again FROM it WHERE id <> '' GROUP BY id),
fl AS (SELECT it.id, list_sort(list_filter([CASE WHEN it.id = '' THEN 'missing_id' END, CASE WHEN len(qw) < 5 THEN 'question_too_short' END, CASE WHEN regexp_matches(question, '(?i)\\b(trang|page)\\s*[0-9]+\\b') THEN 'question_leaks_page_number' END,
    CASE WHEN regexp_matches(trim(question, ' '), '(?i)^(theo|trong|bao cao|van ban phap luat)\\s+') THEN 'question_likely_mentions_source_title' END, CASE WHEN NOT verified THEN 'gold_not_human_verified' END, CASE WHEN wanted IS NULL THEN 'missing_expected_document' END,
    CASE WHEN answerable AND len(evidence) = 0 THEN 'answerable_without_evidence' END, CASE WHEN incomplete THEN 'incomplete_evidence_record' END, CASE WHEN lost THEN 'evidence_source_not_found_in_chunks' END, CASE WHEN unborne THEN 'evidence_support_not_confirmed_in_chunks' END,
    CASE WHEN menu THEN 'evidence_contains_navigation_or_header_boilerplate' END, CASE WHEN wanted IS NOT NULL AND NOT list_contains(coalesce(documents, []), wanted) THEN 'expected_document_missing_from_evidence' END,
    CASE WHEN NOT list_contains(coalesce(pages, []), '1') THEN 'expected_page_missing_from_evidence' END, CASE WHEN len(qw) > 0 AND len(list_intersect(qw, coalesce(ews, []))) / CAST(len(qw) AS DOUBLE) >= 0.55::DOUBLE THEN 'question_has_high_lexical_overlap_with_evidence' END,
    CASE WHEN again THEN 'duplicate_id' END], lambda f: f IS NOT NULL)) AS flags FROM (SELECT *, {_WORDS.format(_PLAIN.format("question"))} AS qw FROM it) it LEFT JOIN gr USING (n) LEFT JOIN tm ON tm.id = it.id)"""

_LINKS = "['evidence_source_not_found_in_chunks', 'evidence_support_not_confirmed_in_chunks', 'expected_document_missing_from_evidence', 'expected_page_missing_from_evidence']"
_KIND = "CASE WHEN n % 17 = 0 THEN 'not_json' WHEN n % 13 = 0 THEN 'not_an_object' WHEN n % 11 = 0 THEN 'no_messages' WHEN n % 7 = 0 THEN 'mixed' WHEN n % 19 = 0 THEN 'blank' ELSE 'whole' END"

ORACLES = {
    "ev10_refused_reviews": f'WITH {_REVIEWS} SELECT id, "at", reason, records FROM jd WHERE reason IS NOT NULL',
    "ev10_reviewed_records": f"""WITH {_REVIEWS} SELECT rec.id, coalesce(fin.question, rec.question) AS question, role, coalesce(status, review_status) AS review_status, answer AS reference_answer,
        CASE WHEN key IS NOT NULL THEN '[{{"document_id":"D1","page":"' || page || '","support":"s"}}]' END AS evidence, CASE WHEN key IS NOT NULL THEN 'D1' END AS documents, status = 'verified' AS gold_verified, reviewer,
        CASE WHEN key IS NOT NULL THEN {_SAID} END AS verification_note FROM rec LEFT JOIN fin ON key = rec.id""",
    "ev10_review_journal": f"""WITH {_REVIEWS}, st AS (SELECT ok.*, rec.role, rec.question AS old_question FROM ok JOIN rec ON rec.id = key), sh AS (SELECT *, sha256({_AFTER}) AS after_sha256, sha256({_BEFORE}) AS first_sha256 FROM st)
        SELECT key AS record_id, "at", reviewer, status AS review_status, status = 'verified' AS gold_verified, coalesce(lag(after_sha256) OVER (PARTITION BY key ORDER BY "at"), first_sha256) AS before_sha256, after_sha256 FROM sh""",
    "ev08_audit": f"""WITH {_AUDIT} SELECT id, array_to_string(flags, ',') AS flags, concat_ws(',', 'verify_original_pdf_and_page', CASE WHEN len(list_filter(flags, lambda f: contains(f, 'question'))) > 0 THEN 'rewrite_question_in_natural_user_language' END,
        CASE WHEN list_contains(flags, 'evidence_contains_navigation_or_header_boilerplate') THEN 'replace_boilerplate_with_substantive_evidence' END, CASE WHEN list_has_any(flags, {_LINKS}) THEN 'repair_document_page_or_evidence_link' END,
        CASE WHEN list_contains(flags, 'gold_not_human_verified') THEN 'set_gold_verified_only_after_human_review' END) AS actions, CASE WHEN len(flags) = 0 THEN 'ready_to_lock' ELSE 'needs_manual_review' END AS review_status FROM fl""",
    "ev08_flag_counts": f"WITH {_AUDIT} SELECT flag, count(*) AS items FROM (SELECT unnest(flags) AS flag FROM fl) GROUP BY flag",
    "ev09_gates": """WITH i AS (SELECT CAST(doc_id AS VARCHAR) AS id, ['dev', 'test', 'dev'][doc_id % 3 + 1] AS split, quality = 1 AS ok, toxic = 1 AS bad FROM labels),
        few AS (SELECT (SELECT string_agg(id, ',' ORDER BY id) FROM (SELECT id FROM i WHERE NOT ok ORDER BY id LIMIT 10)) AS u, (SELECT string_agg(id, ',' ORDER BY id) FROM (SELECT id FROM i WHERE bad ORDER BY id LIMIT 10)) AS f)
        SELECT 'not_empty' AS gate, count(*) > 0 AS passed, count(*) AS found, '' AS examples FROM i UNION ALL SELECT 'splits_present', false, 1, 'challenge' UNION ALL SELECT 'test_has_items', count(*) > 0, count(*), '' FROM i WHERE split = 'test'
        UNION ALL SELECT 'all_verified', count(*) = 0, count(*), coalesce(any_value(u), '') FROM i, few WHERE NOT ok UNION ALL SELECT 'no_flags', count(*) = 0, count(*), coalesce(any_value(f), '') FROM i, few WHERE bad""",
    "src22_stored_messages": f"""WITH c AS (SELECT *, conv_id * 1000 + turn AS n FROM conversations), k AS (SELECT *, {_KIND} AS kind FROM c)
        SELECT CAST(conv_id AS VARCHAR) AS conversation_id, CASE WHEN n % 2 = 0 THEN 'Hội thoại ' || n ELSE '{nested.UNTITLED}' END AS title, '2026-01-01T00:00:00' AS updated_at, CAST(0 AS INTEGER) AS place, CASE WHEN turn % 5 <> 0 THEN role ELSE 'assistant' END AS role,
        coalesce(text, '') AS content, CASE WHEN turn % 2 = 0 THEN turn / 10.0::DOUBLE END AS confidence, CAST(1 AS INTEGER) AS citations, 'rag' AS mode, turn * 0.25::DOUBLE AS elapsed FROM k WHERE kind IN ('whole', 'mixed')""",
    "src22_store_rejects": f"WITH c AS (SELECT conv_id * 1000 + turn AS n FROM conversations) SELECT kind AS reason, count(*) AS records FROM (SELECT {_KIND} AS kind FROM c) WHERE kind IN ('not_json', 'not_an_object') GROUP BY kind",
    "src23_posts": """WITH t AS (SELECT *, trim(regexp_replace(coalesce(html, 'Bài viết không có nội dung'), '\\s+', ' ', 'g'), ' ') AS m FROM pages)
        SELECT left(m, 110) || CASE WHEN length(m) > 110 THEN '…' ELSE '' END AS title, 'Facebook Page đã cấp quyền' AS creator, '2026-02-03' AS published_at, CASE WHEN page_id % 3 <> 0 THEN url ELSE '' END AS url FROM t""",
}


def _digest(table: str, columns: dict[str, str]) -> str:
    """A table's digest: sums of four parts of its rows' digests, of their JSON with names in order."""
    row = "sha256('{' || " + " || ',' || ".join(f"'\"{c}\":' || coalesce(" + (f"CAST(to_json({c}) AS VARCHAR)" if kind == "text" else f"CAST({c} AS VARCHAR)") + ", 'null')" for c, kind in sorted(columns.items())) + " || '}')"
    sums = ", ".join(f"CAST(coalesce(sum(CAST('0x' || substr(h, {1 + 16 * n}, 16) AS UBIGINT)), 0) % 18446744073709551616::HUGEINT AS VARCHAR)" for n in range(4))
    return f"SELECT '{table}' AS \"table\", count(*) AS rows, sha256(concat_ws(',', '{','.join(sorted(columns))}', CAST(count(*) AS VARCHAR), {sums})) AS sha256, 'retrieval' AS evaluation, '{{\"bonus\":\"no\",\"k\":\"10\"}}' AS configuration, 'draft' AS status FROM (SELECT {row} AS h FROM {table})"


ORACLES["snk07_manifest"] = " UNION ALL ".join((
    _digest("labels", {"doc_id": "number", "quality": "number", "toxic": "number"}), _digest("benchmark", {"item_id": "number", "text": "text"}), _digest("region", {"r_regionkey": "number", "r_name": "text"}),
))
