"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions alone.

Documents fall into cells of source, language and topic. The cells' token weights are raked in turn to the
target marginals of each attribute until the largest relative miss is small, each weight cut at what its cell can
give. A value that can't give its target gives all it has, and its attribute's other values take the rest in
proportion; marginals() tells what was wanted and what the rates give. A cell's rate is its raked share of the token budget over the tokens it has; each document is then drawn with that probability by a hash of its
id (rates over one repeat documents: the whole part always, the rest by the draw).

Defined results: null texts have no tokens and are drawn at their cell's rate; a null source or language is the
value "unknown", and so are all if there is no such column; repeated rows are drawn alike unless doc_id differs; null doc_ids share one draw; other
columns are kept as they are; an empty table gives an empty one. Attribute values without a target keep what
the other attributes give them; targets for values that have no tokens are spread over the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

ATTRIBUTES = ("source", "lang", "topic")
#: Exponent on each attribute's own share of tokens that gives its target where none is passed.
TEMPER = 0.5
ROUNDS = 8
#: Rounds of raking with cut weights at most: these converge more slowly, and stop at the same tolerance.
BOUNDED_ROUNDS = 40
TOLERANCE = 1e-6
SALT = "mix"


def topic(text: Column) -> Column:
    """A document's topic by its layout: table, marked-up, shouted, notice or prose; blank texts are empty."""
    return (
        F.when(F.trim(text) == "", "empty")
        .when(F.instr(text, " | ") > 0, "table")
        .when(text.rlike("[%$&*#]{3}"), "markup")
        .when(F.instr(text, "!!") > 0, "shouted")
        .when(F.lower(text).rlike("licen[sc]e|copyright|rights reserved"), "notice")
        .otherwise("prose")
    )


def n_tokens(text: Column) -> Column:
    """Words between white space."""
    return F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """doc (the documents' own columns, as one struct), mix_source, mix_lang, mix_topic, mix_tokens."""
    text = F.coalesce(F.col("text"), F.lit(""))
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown")) if c in docs.columns else F.lit("unknown")
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    return docs.select(own, value("source").alias("mix_source"), value("lang").alias("mix_lang"), topic(text).alias("mix_topic"), n_tokens(text).alias("mix_tokens"))


def cells_of(rows: DataFrame) -> DataFrame:
    """source, lang, topic, tokens, docs: sums by cell, combined before the shuffle."""
    keys = [F.col(f"mix_{a}").alias(a) for a in ATTRIBUTES]
    return rows.groupBy(*keys).agg(F.sum("mix_tokens").alias("tokens"), F.count("*").alias("docs"))


def targets_of(cells: DataFrame, attribute: str, temper: float = TEMPER) -> DataFrame:
    """value, share: each value's share of tokens, raised to `temper` and scaled to sum to one."""
    by = cells.groupBy(F.col(attribute).alias("value")).agg(F.sum("tokens").alias("n")).filter("n > 0")
    raised = F.pow(F.col("n").cast("double"), F.lit(temper))
    return by.select("value", (raised / F.sum(raised).over(Window.partitionBy())).alias("share"))


def _kept(df: DataFrame, few: bool) -> DataFrame:
    """df as a written table. The few cells that MOST_BROADCAST allows are one partition: a round then shuffles nothing."""
    out = written(df, "rake")
    return out.coalesce(1) if few else out


def _few(cells: DataFrame) -> bool:
    return cells.count() <= MOST_BROADCAST


def raked(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """The cells with `weight`: shares of all tokens, which sum to one and meet the targets as nearly as they can."""
    live = cells.filter("tokens > 0")
    total = live.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return cells.withColumn("weight", F.lit(0.0))
    state = live.withColumn("weight", F.col("tokens") / F.lit(float(total)))
    for name, t in targets.items():
        t = t.select(F.col("value").alias(name), F.col("share").alias(f"{name}_share"))
        state = state.join(t, name, "left")
    few = _few(cells)
    state = _kept(state, few)
    for _ in range(rounds):
        miss = F.lit(0.0)
        for name in targets:
            over, share = Window.partitionBy(name), F.col(f"{name}_share")
            state = state.withColumn("now", F.sum("weight").over(over))
            state = state.withColumn(f"{name}_miss", F.when(share > 0, F.abs(F.col("now") / share - 1)).otherwise(0.0))
            state = state.withColumn("weight", F.when(share.isNotNull() & (F.col("now") > 0), F.col("weight") * share / F.col("now")).otherwise(F.col("weight")))
            miss = F.greatest(miss, F.col(f"{name}_miss"))
        state = _kept(state.withColumn("miss", miss).withColumn("weight", F.col("weight") / F.sum("weight").over(Window.partitionBy())), few)
        if state.agg(F.max("miss")).first()[0] <= tolerance:
            break
    return cells.join(state.select(*ATTRIBUTES, "weight"), list(ATTRIBUTES), "left").fillna(0.0, ["weight"])


def _filled(state: DataFrame, by: list[str], free: str, most: str, goal: Column, key: list[str]) -> DataFrame:
    """Add `factor`: in each group, what `free` is to be multiplied with to sum to `goal` if each row is cut at `most`.

    Rows are cut in the order of most/free. Each row, taken as the first that isn't cut, gives a factor that is
    not above the right one; the right one is the largest."""
    full = F.try_divide(most, free)
    up = Window.partitionBy(*by).orderBy(full.asc_nulls_last(), *(F.col(k).asc() for k in key))
    down = Window.partitionBy(*by).orderBy(full.desc_nulls_first(), *(F.col(k).desc() for k in key))
    cut = F.coalesce(F.sum(most).over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    uncut = F.sum(free).over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    state = state.withColumn("factor", F.try_divide(goal - cut, uncut))
    return state.withColumn("factor", F.greatest(F.lit(0.0), F.max("factor").over(Window.partitionBy(*by))))


def _scaled(state: DataFrame, by: list[str], goal: Column) -> tuple[Column, Column]:
    """In each group the sum of the cut weights, and what to multiply the free ones with: what the rows that are cut now
    leave of the goal, over the sum of the others."""
    free, bound, over = F.col("free"), F.col("bound"), Window.partitionBy(*by)
    now = F.sum(F.least(free, bound)).over(over)
    cut = F.coalesce(F.sum(F.when(free >= bound, bound)).over(over), F.lit(0.0))
    uncut = F.coalesce(F.sum(F.when(free < bound, free)).over(over), F.lit(0.0))
    return now, F.when((uncut > 0) & (goal > cut), (goal - cut) / uncut).otherwise(F.coalesce(F.try_divide(goal, now), F.lit(1.0)))


def raked_within(cells: DataFrame, targets: dict[str, DataFrame], budget: float, most: float, rounds: int = BOUNDED_ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """As raked(), but no weight asks for more than `most` of its cell's tokens at this budget."""
    live = cells.filter("tokens > 0")
    total = live.agg(F.sum("tokens")).first()[0] or 0
    if not total or budget <= 0:
        return raked(cells, targets)
    whole = min(1.0, most / budget)
    state = live.withColumn("free", F.col("tokens") / F.lit(float(total))).withColumn("bound", F.col("tokens") * F.lit(most / (budget * total)))
    few = _few(cells)
    state, loose = _kept(state, few), False
    for name, t in targets.items():
        t = t.select(F.col("value").alias(name), F.col("share").cast("double").alias("share"))
        by = _kept(state.groupBy(name).agg(F.sum("bound").alias("can")).join(t, name, "left"), few)
        r = by.agg(F.count("*").alias("values"), F.count("share").alias("named"), F.sum("share").alias("share"), F.sum(F.when(F.col("share").isNotNull(), F.col("can"))).alias("can")).first()
        loose = loose or r["named"] < r["values"]
        goal = min(whole, r["can"] or 0.0) if r["named"] == r["values"] else min(whole, r["can"] or 0.0, r["share"] or 0.0)
        by = _filled(by.filter("share is not null"), [], "share", "can", F.lit(goal), [name])
        state = state.join(by.select(name, F.least("can", F.col("share") * F.col("factor")).alias(f"{name}_goal")), name, "left")
    state, weight = _kept(state, few), F.least("free", "bound")
    for _ in range(rounds):
        miss = F.lit(0.0)
        for name in targets:
            goal = F.col(f"{name}_goal")
            now, factor = _scaled(state, [name], goal)
            state = state.select("*", now.alias("now"), factor.alias("factor"))
            miss = F.greatest(miss, F.when(F.col(f"{name}_goal") > 0, F.abs(F.col(f"{name}_now") / goal - 1)).otherwise(0.0))
            state = state.withColumn("free", F.when(goal.isNotNull(), F.col("free") * F.col("factor")).otherwise(F.col("free"))).withColumnRenamed("now", f"{name}_now").drop("factor")
        if loose:
            _, factor = _scaled(state, [], F.lit(whole))
            state = state.withColumn("factor", factor).withColumn("free", F.col("free") * F.col("factor")).drop("factor")
        state = _kept(state.withColumn("miss", miss).drop(*(f"{name}_now" for name in targets)), few)
        if state.agg(F.max("miss")).first()[0] <= tolerance:
            break
    return cells.join(state.select(*ATTRIBUTES, weight.alias("weight")), list(ATTRIBUTES), "left").fillna(0.0, ["weight"])


def rates(cells: DataFrame, budget: float, most: float, rounds: int = ROUNDS) -> DataFrame:
    """The cells with `rate`: expected copies of each document, at most `most`; what a cell can't take goes to the others."""
    cells = _kept(cells, _few(cells))
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    goal, scale = budget * total, 1.0
    raw = F.when(F.col("tokens") > 0, F.col("weight") * goal / F.col("tokens")).otherwise(F.lit(min(budget, most)))
    for _ in range(rounds):
        rate = F.least(F.lit(most), raw * scale)
        r = cells.agg(F.sum(F.when(rate < most, rate * F.col("tokens"))).alias("free"), F.sum(F.when(rate >= most, most * F.col("tokens"))).alias("full")).first()
        free, full = r["free"] or 0.0, r["full"] or 0.0
        if not free or abs(free + full - goal) <= 1e-6 * goal:
            break
        scale *= max(0.0, goal - full) / free
    return cells.withColumn("rate", F.when(F.col("tokens") > 0, F.least(F.lit(most), raw * scale)).otherwise(raw))


def draw(doc_id: Column, salt: str = SALT) -> Column:
    """A uniform number in [0, 1) from the id alone."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(salt), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 13), 16, 10).cast("double") / float(1 << 52)


def rated_cells(docs: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = 0.5, most: float = 1.0) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The cells with tokens, weight and rate; and the targets that they were raked to."""
    cells = written(cells_of(measured(docs)), "cells")
    cells = cells.coalesce(1) if _few(cells) else cells
    targets = targets or {a: targets_of(cells, a) for a in ATTRIBUTES}
    return written(rates(raked_within(cells, targets, budget, most), budget, most), "rates"), targets


def marginals(rated: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """attribute, value, wanted, got: each target, as a share of the tokens, and what the rates give."""
    out = None
    for name, t in targets.items():
        drawn = rated.groupBy(F.col(name).alias("value")).agg(F.sum(F.col("rate") * F.col("tokens")).alias("n"))
        total = drawn.agg(F.sum("n").alias("total"))
        joined = drawn.join(t.select("value", F.col("share").cast("double").alias("wanted")), "value", "full").crossJoin(F.broadcast(total))
        part = joined.select(F.lit(name).alias("attribute"), "value", "wanted", F.coalesce(F.try_divide("n", "total"), F.lit(0.0)).alias("got"))
        out = part if out is None else out.unionByName(part)
    return out


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = 0.5, most: float = 1.0) -> DataFrame:
    """The sampled documents with mix_source, mix_lang, mix_topic, mix_tokens, mix_rate and mix_copies, which take the
    place of columns of the same name.

    budget: tokens to return as a share of the tokens there are. most: the highest rate of a cell."""
    drawn = _drawn(docs, targets, budget, most)
    own = [F.col(f"doc.`{c}`").alias(c) for c in docs.columns if c not in ADDED]
    return drawn.select(*own, *ADDED)


def sampled(docs: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = 0.5, most: float = 1.0) -> DataFrame:
    """As mix(), but with the documents' own columns alone, whatever their names."""
    return _drawn(docs, targets, budget, most).select(*(F.col(f"doc.`{c}`").alias(c) for c in docs.columns))


def _drawn(docs: DataFrame, targets: dict[str, DataFrame] | None, budget: float, most: float) -> DataFrame:
    rated, _ = rated_cells(docs, targets, budget, most)
    few = _few(rated)
    rated = rated.select(*[F.col(a).alias(f"mix_{a}") for a in ATTRIBUTES], F.col("rate").alias("mix_rate"))
    # The cells are as many as distinct values allow, not as documents; they are broadcast only when few.
    joined = measured(docs).join(F.broadcast(rated) if few else rated, [f"mix_{a}" for a in ATTRIBUTES])
    whole = F.floor("mix_rate")
    copies = (whole + (draw(F.col("doc.doc_id")) < F.col("mix_rate") - whole).cast("long")).cast("int")
    return joined.withColumn("mix_copies", copies).filter("mix_copies > 0")


#: What mix() adds to the documents.
ADDED = ("mix_source", "mix_lang", "mix_topic", "mix_tokens", "mix_rate", "mix_copies")
#: Cells, of some 100 bytes each, that are sent to every executor at most.
MOST_BROADCAST = 20_000
