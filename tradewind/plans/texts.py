"""Queries over passages, pages and positions: evidence, repeated lines, exact ordinals; with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import html_to_text
from ..operators import evidence, followups, lines, ordinals
from ..sources.questions import QUESTIONS_SQL, questions
from ..sources.testdata import Star
from .more import ORACLES as MORE
from .more import _clean
from .questions import form_sql

Query = Callable[[SparkSession, str], DataFrame]

#: How rows of each kind are dealt to the parts of a benchmark.
PATTERNS = {
    "policy_rag": ["dev", "dev", "dev", "dev", "test", "test", "challenge", "challenge"],
    "shop_analysis": ["dev", "dev", "dev", "dev", "test", "test", "challenge"],
    "out_of_scope": ["dev", "dev", "test", "test", "challenge"],
    "shop_data": ["dev", "test", "challenge"],
}


def evidence_links(s: Star) -> DataFrame:
    passages = s.raw("benchmark").select(F.col("item_id").alias("passage"), "text")
    return evidence.borne_out(passages, s.raw("documents").select(F.col("doc_id").alias("text_id"), "text"))


def _site_pages(s: Star) -> DataFrame:
    """A site's pages: its name, the page's text, and its number at the foot."""
    site = F.regexp_extract("url", "^https?://([^/]+)/", 1)
    text = F.concat_ws("\n", F.concat(site, F.lit(" | menu")), html_to_text(F.col("html")), F.concat(F.lit("Trang "), F.col("page_id").cast("string")), F.lit("© all rights reserved"))
    return s.raw("pages").select(site.alias("document"), F.col("page_id").alias("page"), text.alias("text"))


def repeated_lines(s: Star) -> DataFrame:
    return lines.repeated(_site_pages(s))


def without_repeated(s: Star) -> DataFrame:
    return lines.without_repeated(_site_pages(s))


def _kinds(s: Star) -> DataFrame:
    """Two labels of three are of one kind."""
    kind = F.when(F.col("doc_id") % 3 != 0, "policy_rag").when(F.col("quality") == 1, "shop_analysis").when(F.col("toxic") == 1, "out_of_scope").when(F.col("doc_id") % 2 == 0, "shop_data").otherwise("unknown")
    return s.raw("labels").select("doc_id", kind.alias("kind"))


def splits(s: Star) -> DataFrame:
    return ordinals.dealt(_kinds(s), "kind", [F.col("doc_id")], PATTERNS)


def line_positions(s: Star) -> DataFrame:
    """Every line item's place by price in the whole table, one group of all rows."""
    return ordinals.numbered(s.raw("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), [], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")])


def _of(f: Callable[[Star], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(Star(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "jn13_evidence_links": _of(evidence_links),
    "ag41_repeated_lines": _of(repeated_lines),
    "ag41_pages_without_repeated_lines": _of(without_repeated),
    "wn10_positional_split": _of(splits),
    "wn01_positions_of_all": _of(line_positions),
}

_PLAIN = "trim(regexp_replace(strip_accents(replace(lower(coalesce({}, '')), 'đ', 'd')), '\\s+', ' ', 'g'), ' ')"
_WORDS = "list_distinct(list_filter(regexp_extract_all({}, '[0-9a-z_/-]+'), lambda w: length(w) >= 3 AND NOT regexp_full_match(w, '[0-9]+')))"
_HTML_TEXT = MORE["src12_html_text"].removeprefix("SELECT page_id, ").removesuffix(" AS text FROM pages")
_PAGES = f"""sp AS (SELECT regexp_extract(url, '^https?://([^/]+)/', 1) AS document, page_id AS page, concat_ws(chr(10), regexp_extract(url, '^https?://([^/]+)/', 1) || ' | menu', {_HTML_TEXT}, 'Trang ' || page_id, '© all rights reserved') AS text FROM pages),
ln AS (SELECT document, page, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM sp),
fm AS (SELECT *, trim(regexp_replace(regexp_replace(strip_accents(replace(lower(line), 'đ', 'd')), '[^a-z0-9]+', ' ', 'g'), '\\s+', ' ', 'g'), ' ') AS form FROM ln),
sz AS (SELECT document, count(*) AS of_pages FROM sp GROUP BY 1),
rp AS (SELECT document, form, count(DISTINCT page) AS pages, any_value(of_pages) AS of_pages FROM fm JOIN sz USING (document) WHERE of_pages >= 3 AND length(form) BETWEEN 3 AND 120 AND NOT regexp_full_match(form, '[0-9]{{1,4}}')
    GROUP BY document, form HAVING count(DISTINCT page) >= greatest(3, CAST(floor(any_value(of_pages) * 0.6::DOUBLE) AS INTEGER)))"""

ORACLES = {
    "jn13_evidence_links": f"""WITH p AS (SELECT item_id AS passage, trim(replace({_PLAIN.format("text")}, '...', ''), ' ') AS form, {_WORDS.format(_PLAIN.format("text"))} AS ws FROM benchmark),
        d AS (SELECT doc_id AS text_id, {_PLAIN.format("text")} AS t, {_WORDS.format(_PLAIN.format("text"))} AS tw FROM documents),
        b AS (SELECT passage, text_id, contains(t, form) AS contained, len(list_intersect(ws, tw)) / CAST(len(ws) AS DOUBLE) AS share FROM p, d WHERE length(form) >= 40 AND len(ws) > 0)
        SELECT * FROM b WHERE contained OR share >= 0.85::DOUBLE""",
    "ag41_repeated_lines": f"WITH {_PAGES} SELECT document, form, pages, of_pages AS of FROM rp",
    "ag41_pages_without_repeated_lines": f"""WITH {_PAGES}, kept AS (SELECT document, page, string_agg(line, chr(10) ORDER BY place) AS text FROM fm WHERE NOT EXISTS (SELECT 1 FROM rp WHERE rp.document = fm.document AND rp.form = fm.form) GROUP BY document, page)
        SELECT document, page, CASE WHEN of_pages >= 3 THEN {_clean("coalesce(kept.text, '')")} ELSE coalesce(kept.text, '') END AS text FROM sp JOIN sz USING (document) LEFT JOIN kept USING (document, page)""",
    "wn10_positional_split": """WITH k AS (SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN 'policy_rag' WHEN quality = 1 THEN 'shop_analysis' WHEN toxic = 1 THEN 'out_of_scope' WHEN doc_id % 2 = 0 THEN 'shop_data' ELSE 'unknown' END AS kind FROM labels),
        n AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY doc_id) AS position FROM k)
        SELECT doc_id, kind, position, CASE kind """
    + " ".join(f"WHEN '{k}' THEN [{', '.join(repr(x) for x in v)}][(position - 1) % {len(v)} + 1]" for k, v in PATTERNS.items())
    + " END AS split FROM n",
    "wn01_positions_of_all": "SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS position FROM lineitem",
}


def follow_ups(s: Star) -> DataFrame:
    """Questions made of the user's turns; every fifth asks the same as the one before."""
    q = questions(s.raw("conversations"))
    again = F.when(F.col("turn") % 4 == 2, F.concat(F.lit("Nó dùng để làm gì "), F.col("conv_id").cast("string"))).when(F.col("turn") % 8 == 4, F.concat(F.lit("NÓ dùng để làm gì? "), F.col("conv_id").cast("string"))).otherwise(F.col("question"))
    return followups.batch(q.select("conv_id", "turn", "role", again.alias("text")))


QUERIES["pl04_follow_ups"] = _of(follow_ups)

_LEANS = " OR ".join(f"form = '{m.strip()}' OR starts_with(form, '{m}') OR contains(form, '{m.strip()}')" for m in followups.MARKERS)
_INTENT = " ".join(
    f"WHEN previous <> '' AND ({' OR '.join(f'contains(form, {p!r})' for p in phrases)}) THEN '{followups.BASED_ON}' || previous || '. {followups.REQUESTS[intent]} {followups.NOW}' || question" for intent, phrases in followups.INTENTS.items()
)
ORACLES["pl04_follow_ups"] = f"""WITH {QUESTIONS_SQL}, t AS (SELECT conv_id, turn, role, CASE WHEN turn % 4 = 2 THEN 'Nó dùng để làm gì ' || conv_id WHEN turn % 8 = 4 THEN 'NÓ dùng để làm gì? ' || conv_id ELSE question END AS text FROM qs),
    u AS (SELECT conv_id, turn, coalesce(text, '') AS question, lag(text) OVER w AS previous, lag(turn) OVER w AS since FROM t WHERE role = 'user' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    a AS (SELECT u.conv_id, u.turn, arg_max(t.text, t.turn) AS last_answer FROM u JOIN t ON t.conv_id = u.conv_id AND t.role = 'assistant' AND t.turn > since AND t.turn < u.turn GROUP BY ALL),
    f AS (SELECT u.*, last_answer, {form_sql("question")} AS form, {form_sql("previous")} AS before FROM u LEFT JOIN a USING (conv_id, turn))
    SELECT conv_id, turn, question, previous, last_answer, CASE WHEN previous IS NOT NULL AND len(string_split(form, ' ')) <= 10 AND ({_LEANS}) THEN '{followups.PREVIOUS}' || previous || chr(10) || '{followups.NEXT}' || question ELSE question END AS resolved,
    CASE {_INTENT} ELSE question END AS query, CASE WHEN previous <> '' AND coalesce(last_answer, '') <> '' AND form = before THEN last_answer END AS repeat_answer FROM f"""
