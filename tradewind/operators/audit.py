"""Audit of a benchmark's items against the chunks they cite: flags, what a reviewer has to do, and who is ready.

Evidence meets chunks on document and page, and is then tested on the texts; each item's evidence is judged in rows, so
that an item with much evidence, or a page with many chunks, is no group in one task's memory."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evidence import LEAST_LETTERS, SHARE, plain, words

# Headers and menus in folded form, and patterns of questions that give their source away.
NAVIGATION = (
    "xin chao", "shopee co the giup gi cho ban", "mua sam cung shopee", "khuyen mai uu dai", "thanh toan don hang", "thong tin chung", "language supported", "last updated",
)
PAGE_REFERENCE, TITLE_PREFIX = r"(?i)\b(trang|page)\s*[0-9]+\b", r"(?i)^(theo|trong|bao cao|van ban phap luat)\s+"
LINK_FLAGS = ("evidence_source_not_found_in_chunks", "evidence_support_not_confirmed_in_chunks", "expected_document_missing_from_evidence", "expected_page_missing_from_evidence")
#: Fixed: words a question must have, and the share of them in the evidence that gives it away.
LEAST_WORDS, COPIED = 5, 0.55


def _trim(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name).cast("string"), F.lit("")))


def _all(values: str) -> Column:
    return F.transform(F.coalesce(F.col(values), F.array().cast("array<string>")), lambda v: F.trim(v))


def audited(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """id, flags (sorted), actions, review_status for every item. items: id, question, answerable, gold_verified,
    expected_documents, expected_pages (arrays of strings), evidence (array of document_id, page, support). chunks:
    document_id, page, text; those without document or text are none. Items that are wholly equal are judged once and
    returned as often as they come."""
    i = items.withColumn("_row", F.sha2(F.to_json(F.struct(*sorted(items.columns))), 256))
    i = i.withColumns({"_id": _trim("id"), "_documents": _all("expected_documents"), "_pages": _all("expected_pages")})
    known = chunks.select(_trim("document_id").alias("document"), _trim("page").alias("page"), plain(F.col("text")).alias("t_form")).filter("document <> '' and t_form <> ''")
    one = i.dropDuplicates(["_row"])
    cited = one.select("_row", F.posexplode("evidence").alias("_place", "e")).select(
        "_row", "_place", F.trim(F.coalesce(F.col("e.document_id").cast("string"), F.lit(""))).alias("document"), F.trim(F.coalesce(F.col("e.page").cast("string"), F.lit(""))).alias("page"),
        F.trim(F.coalesce("e.support", F.lit(""))).alias("support"),
    )
    cited = cited.withColumns({"whole": (F.col("document") != "") & (F.col("support") != ""), "form": F.trim(F.replace(plain(F.col("support")), F.lit("..."), F.lit(""))), "said": words(plain(F.col("support")))})
    meets = cited.filter("whole").select("_row", "_place", "document", "page", "form", "said").join(known, ["document", "page"])
    share = F.size(F.array_intersect("said", words(F.col("t_form")))) / F.size("said").cast("double")
    borne = (F.length("form") >= LEAST_LETTERS) & (F.size("said") > 0) & (F.contains("t_form", F.col("form")) | (share >= SHARE))
    found = meets.groupBy("_row", "_place").agg(F.max(F.coalesce(borne, F.lit(False))).alias("borne"))
    judged = cited.join(found, ["_row", "_place"], "left")
    menu = reduce(Column.__or__, (F.contains(plain(F.col("support")), F.lit(m)) for m in NAVIGATION))
    flag = lambda test, name: F.when(test, F.lit(name))
    by_item = judged.groupBy("_row").agg(
        F.max(~F.col("whole")).alias("incomplete"), F.max(F.col("whole") & F.col("borne").isNull()).alias("lost"), F.max(~F.col("borne")).alias("unborne"), F.max(F.col("whole") & menu).alias("menu"),
        F.collect_set(F.when(F.col("whole"), F.col("document"))).alias("documents"), F.collect_set(F.when(F.col("whole") & (F.col("page") != ""), F.col("page"))).alias("pages"),
        F.array_distinct(F.flatten(F.collect_list("said"))).alias("evidence_words"),
    )
    times = i.filter("_id <> ''").groupBy("_id").agg((F.count(F.lit(1)) > 1).alias("again"))
    asked = words(plain(F.col("question")))
    none = F.coalesce(F.size("evidence"), F.lit(0)) < 1
    j = one.join(by_item, "_row", "left").join(times, "_id", "left").withColumn("asked", asked)
    copied = F.size(F.array_intersect("asked", "evidence_words")) / F.nullif(F.size("asked"), F.lit(0)).cast("double") >= COPIED
    question = F.trim(F.coalesce("question", F.lit("")))
    missing = lambda wanted, there: (F.size(wanted) > 0) & (F.size(F.array_except(wanted, F.coalesce(there, F.array().cast("array<string>")))) > 0)
    flags = F.array_sort(F.array_compact(F.array(
        flag(F.col("_id") == "", "missing_id"), flag(F.size("asked") < LEAST_WORDS, "question_too_short"), flag(question.rlike(PAGE_REFERENCE), "question_leaks_page_number"),
        flag(question.rlike(TITLE_PREFIX), "question_likely_mentions_source_title"), flag(~F.coalesce("gold_verified", F.lit(False)), "gold_not_human_verified"),
        flag(F.size("_documents") == 0, "missing_expected_document"), flag(F.coalesce("answerable", F.lit(True)) & none, "answerable_without_evidence"),
        flag(F.col("incomplete"), "incomplete_evidence_record"), flag(F.col("lost"), LINK_FLAGS[0]), flag(F.col("unborne"), LINK_FLAGS[1]),
        flag(F.col("menu"), "evidence_contains_navigation_or_header_boilerplate"), flag(missing("_documents", F.col("documents")), LINK_FLAGS[2]), flag(missing("_pages", F.col("pages")), LINK_FLAGS[3]),
        flag(copied, "question_has_high_lexical_overlap_with_evidence"), flag(F.col("again"), "duplicate_id"),
    )))
    j = j.select("_row", flags.alias("flags"))
    held = lambda name: F.array_contains("flags", name)
    actions = F.array_compact(F.array(
        F.lit("verify_original_pdf_and_page"), F.when(F.exists("flags", lambda f: F.contains(f, F.lit("question"))), "rewrite_question_in_natural_user_language"),
        F.when(held("evidence_contains_navigation_or_header_boilerplate"), "replace_boilerplate_with_substantive_evidence"),
        F.when(F.arrays_overlap("flags", F.array(*map(F.lit, LINK_FLAGS))), "repair_document_page_or_evidence_link"), F.when(held("gold_not_human_verified"), "set_gold_verified_only_after_human_review"),
    ))
    status = F.when(F.size("flags") == 0, "ready_to_lock").otherwise("needs_manual_review")
    return i.select("_row", F.col("_id").alias("id")).join(j, "_row").select("id", "flags", actions.alias("actions"), status.alias("review_status"))


def flag_counts(audit: DataFrame) -> DataFrame:
    """flag, items: how many items have each flag."""
    return audit.select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("items"))
