"""Queries of planning, routing and repair over the questions made of `conversations`, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import planner, quick_rules, repair
from ..operators.router import Test
from ..sources.questions import QUESTIONS_SQL, questions
from ..sources.testdata import Star

Query = Callable[[SparkSession, str], DataFrame]

#: Words of documents that count as known: letters only, in so many documents at least.
KNOWN_IN = 2


def _questions(s: Star) -> DataFrame:
    return questions(s.raw("conversations"))


def _words(texts: DataFrame) -> DataFrame:
    return texts.select(F.explode(F.array_distinct(F.split(t.match_form(F.col("text")), " "))).alias("word"))


def typo_repairs(s: Star) -> DataFrame:
    """Words of passages, conversations and questions against the words that documents share."""
    known = _words(s.raw("documents")).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= KNOWN_IN)
    known = known.filter(F.col("word").rlike("^[a-z]{3,}$"))
    asked = s.raw("benchmark").select("text").unionByName(s.raw("conversations").select("text")).unionByName(_questions(s).select(F.col("question").alias("text")))
    return repair.repairs(_words(asked).filter(F.col("word").rlike("^[a-z]+$")), known)


def plans(s: Star) -> DataFrame:
    return planner.plans(_questions(s)).withColumns({c: F.array_join(c, ",") for c in ("tools", "tags")})


def understood(s: Star) -> DataFrame:
    return planner.understood(_questions(s)).select("id", "form")


def routes(s: Star) -> DataFrame:
    return quick_rules.quick_routes(_questions(s)).select("id", "question", "route")


def gibberish(s: Star) -> DataFrame:
    return _questions(s).select("id", t.gibberish(F.col("question")).alias("gibberish"))


def _of(f: Callable[[Star], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(Star(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "str15_typo_repairs": _of(typo_repairs),
    "str15_understood_questions": _of(understood),
    "str17_gibberish": _of(gibberish),
    "pl01_plans": _of(plans),
    "pl03_quick_routes": _of(routes),
}


def form_sql(text: str, kept: str = "a-z0-9_/%.-") -> str:
    return f"trim(regexp_replace(regexp_replace(strip_accents(replace(lower(coalesce({text}, '')), 'đ', 'd')), '[^{kept}]+', ' ', 'g'), '\\s+', ' ', 'g'), ' ')"


def listed(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def any_sql(words: tuple[str, ...], view: str = "form") -> str:
    return f"len(list_filter({listed(words)}, lambda w: contains({view}, w))) > 0"


def rule_sql(test: Test) -> str:
    """A rule as the chain of substring tests that it stands for."""
    if test.kind == "any":
        return f"({any_sql(test.phrases, test.view)})"
    if test.kind == "is":
        return f"trim({test.view}, ' .') IN ({', '.join(repr(p) for p in test.phrases)})"
    if test.kind == "topic":
        return f"coalesce(topic IN ({', '.join(repr(p) for p in test.phrases)}), false)"
    if test.kind == "like":
        return " OR ".join(f"regexp_matches({test.view}, '{p}')" for p in test.phrases)
    if test.kind == "flag":
        return test.view
    parts = [f"({rule_sql(p)})" for p in test.parts]
    return f"NOT {parts[0]}" if test.kind == "no" else (" AND " if test.kind == "all" else " OR ").join(parts)


#: One letter more or less, or two neighbours swapped.
ONE_EDIT = (
    "(abs(length({a}) - length({b})) = 1 AND levenshtein({a}, {b}) = 1"
    " OR length({a}) = length({b}) AND levenshtein({a}, {b}) = 2 AND damerau_levenshtein({a}, {b}) = 1)"
)

_COMPACT = "regexp_replace(" + form_sql("question") + ", '[^a-z0-9]+', '', 'g')"
_GIBBERISH = f"""(SELECT x = '' OR regexp_full_match(x, '[0-9]+') OR x IN ({", ".join(repr(w) for w in t.NOISE)}) OR regexp_full_match(x, '(ha)(ha)+|(he)(he)+|(hi)(hi)+|(sad)(sad)+[a-z]*')
    OR (length(x) >= 4 AND regexp_full_match(x, '[a-z]+') AND replace(x, x[1], '') = '') OR (length(x) >= 7 AND length(regexp_replace(x, '[^aeiouy]', '', 'g')) <= 1) FROM (SELECT {_COMPACT} AS x))"""

_ALIASED = "form"
for _typo in quick_rules.BASE_STRING_TYPOS:
    _ALIASED = f"replace({_ALIASED}, '{_typo}', 'base string')"

_UNDERSTOOD = f"""{QUESTIONS_SQL},
plain AS (SELECT id, {form_sql("question", "a-z0-9")} AS form FROM qs),
words AS (SELECT DISTINCT w FROM (SELECT unnest(string_split(form, ' ')) AS w FROM plain) WHERE length(w) >= 3 AND w NOT IN (SELECT unnest({listed(planner.PROTECTED + planner.TYPO_VOCABULARY)}))),
fixes AS (SELECT w, min(v) AS v FROM words, (SELECT unnest({listed(planner.TYPO_VOCABULARY)}) AS v) WHERE {ONE_EDIT.format(a="w", b="v")} GROUP BY w HAVING count(*) = 1),
fixed AS (SELECT id, form, string_agg(coalesce(v, w), ' ' ORDER BY i) AS repaired FROM (SELECT id, form, unnest(string_split(form, ' ')) AS w, generate_subscripts(string_split(form, ' '), 1) AS i FROM plain) LEFT JOIN fixes USING (w) GROUP BY id, form),
semantic AS (SELECT id, CASE WHEN repaired = form THEN form ELSE form || ' ' || repaired END AS form FROM fixed),
understood AS (SELECT id, trim(concat_ws(' ', form, {", ".join(f"CASE WHEN {any_sql(v)} THEN '{k}' END" for k, v in planner.ALIASES.items())}), ' ') AS form FROM semantic)"""

_SHOP_CHAIN = f"""flags AS (SELECT id, form, {any_sql(planner.OUT_OF_SCOPE)} AS is_out, {any_sql(planner.SHOP + planner.POLICY + planner.CALCULATION)} AS signal,
    len(list_filter({listed(planner.CASUAL)}, lambda w: form = w OR starts_with(form, w || ' '))) > 0 AS greets, {any_sql(planner.POLICY)} AS policy, {any_sql(planner.PRIVATE)} AS private,
    {any_sql(planner.CALCULATION)} AS calculates, {any_sql(planner.SHOP)} OR {any_sql(planner.COST)} AS asks_shop, {any_sql(planner.SYSTEM_LIMIT)} AS limits,
    {any_sql(planner.DEFINED)} AND {any_sql(planner.DEFINITION)} AS defines, contains(form, 'chi phi quang cao') AND contains(form, 'co phai') AS contrasts,
    {any_sql(planner.LAW)} AS law, contains(form, 'mat hang nay') AND contains(form, 'duoc ban') AS sellable, {any_sql(planner.SETTLED)} AS settled, {any_sql(planner.OWN)} AS own FROM understood),
needs AS (SELECT *, greets AND NOT signal AS casual, asks_shop AND NOT ((defines AND NOT private) OR contrasts OR (law AND NOT private) OR sellable OR (policy AND NOT private AND NOT settled AND NOT own) OR limits) AS shop FROM flags),
month AS (SELECT *, regexp_extract(form, 'thang\\s*(\\d{{1,2}})(?:\\s*(?:nam)?\\s*(20\\d{{2}}))?', 1) AS m, regexp_extract(form, 'thang\\s*(\\d{{1,2}})(?:\\s*(?:nam)?\\s*(20\\d{{2}}))?', 2) AS y FROM needs)"""

ORACLES = {
    "str15_typo_repairs": f"""WITH {QUESTIONS_SQL},
        known AS (SELECT w FROM (SELECT unnest(list_distinct(string_split({form_sql("text")}, ' '))) AS w FROM documents) WHERE regexp_full_match(w, '[a-z]{{3,}}') GROUP BY w HAVING count(*) >= {KNOWN_IN}),
        asked AS (SELECT DISTINCT w FROM (SELECT unnest(string_split({form_sql("text")}, ' ')) AS w FROM (SELECT text FROM benchmark UNION ALL SELECT text FROM conversations UNION ALL SELECT question FROM qs))
            WHERE regexp_full_match(w, '[a-z]{{3,}}') AND w NOT IN (SELECT w FROM known)),
        met AS (SELECT asked.w AS word, known.w AS v FROM asked JOIN known ON length(asked.w) BETWEEN length(known.w) - 1 AND length(known.w) + 1 AND {ONE_EDIT.format(a="asked.w", b="known.w")})
        SELECT word, count(*) AS candidates, CASE WHEN count(*) = 1 THEN min(v) END AS repaired FROM met GROUP BY word""",
    "str15_understood_questions": f"WITH {_UNDERSTOOD} SELECT id, form FROM understood",
    "str17_gibberish": f"WITH {QUESTIONS_SQL} SELECT id, {_GIBBERISH} AS gibberish FROM qs",
    "pl01_plans": f"""WITH {_UNDERSTOOD}, {_SHOP_CHAIN}
        SELECT id, CASE WHEN casual AND NOT is_out THEN NULL WHEN TRY_CAST(m AS INTEGER) BETWEEN 1 AND 12 THEN CASE WHEN y = '' THEN '2026' ELSE y END || '-' || lpad(m, 2, '0') END AS period,
        CASE WHEN is_out OR casual THEN '' WHEN shop AND policy AND calculates THEN 'shop_data,rag,calculator' WHEN shop AND policy THEN 'shop_data,rag'
            WHEN shop AND calculates THEN 'shop_data,calculator' WHEN shop THEN 'shop_data' ELSE 'rag' END AS tools,
        CASE WHEN is_out THEN 'out_of_scope' WHEN casual THEN 'casual' WHEN shop AND policy AND calculates THEN 'multi_tool_policy_and_shop_analysis' WHEN shop AND policy THEN 'multi_tool_policy_and_shop_retrieval'
            WHEN shop AND calculates THEN 'shop_analysis' WHEN shop THEN 'shop_data' ELSE 'policy_rag' END AS intent,
        shop AND NOT is_out AND NOT casual AS needs_shop_data,
        concat_ws(',', {", ".join(f"CASE WHEN {rule_sql(planner.TAGS[tag])} THEN '{tag}' END" for tag in sorted(planner.TAGS))}) AS tags FROM month""",
    "pl03_quick_routes": f"""WITH {QUESTIONS_SQL}, f AS (SELECT *, {form_sql("question")} AS form, {_GIBBERISH} AS gibberish FROM qs), v AS (SELECT *, {_ALIASED} AS alias FROM f)
        SELECT id, question, CASE {" ".join(f"WHEN {rule_sql(test)} THEN '{name}'" for name, test in quick_rules.RULES)} ELSE 'retrieval' END AS route FROM v""",
}
