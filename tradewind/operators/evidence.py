"""Evidence: which texts bear out which passages.

A passage is borne out by a text that holds it word by word, or that shares 85 % of its distinct words. Comparing all
passages with all texts isn't needed: of a passage's n words, a text that shares 85 % holds at least one of the rarest
n - ceil(0.85 n) + 1; one that holds the passage itself holds all of its words but the first and the last (which may be
cut), so the rarest of these. These few words of each passage are the join's keys, counted over the texts beforehand;
a passage without such words is found by the first letters of its longest word. What meets on a key is then tested on
the whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, squeeze

#: Fixed: the share of a passage's words that a text must have, and the letters of a passage that says anything.
SHARE, LEAST_LETTERS = 0.85, 40
#: Letters by which passages are found that have no whole word inside.
GRAM = 20


def plain(text: Column) -> Column:
    """Folded letters in lower case, spaces squeezed; other characters stay."""
    return squeeze(fold(F.coalesce(text, F.lit(""))))


def words(form: Column) -> Column:
    """Distinct words of three characters or more that aren't numbers."""
    return F.array_distinct(F.filter(F.regexp_extract_all(form, F.lit("[0-9a-z_/-]+"), F.lit(0)), lambda w: (F.length(w) >= 3) & ~w.rlike("^[0-9]+$")))


def _grams(form: Column) -> Column:
    long_words = F.filter(F.split(form, " "), lambda w: F.length(w) >= GRAM)
    return F.flatten(F.transform(long_words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - GRAM + 1), lambda i: F.concat(F.lit("~"), F.substring(w, i, F.lit(GRAM))))))


def prepared(passages: DataFrame) -> DataFrame:
    """passage, form, words, n of those that say enough. Dots left out of a passage are no part of it."""
    form = F.trim(F.replace(plain(F.col("text")), F.lit("..."), F.lit("")))
    p = passages.select("passage", form.alias("form"), words(plain(F.col("text"))).alias("words"))
    return p.filter((F.length("form") >= LEAST_LETTERS) & (F.size("words") > 0)).withColumn("n", F.size("words"))


def _keys(p: DataFrame, texts: DataFrame) -> DataFrame:
    """passage, key: the words, or letters, that a text must hold one of."""
    asked = p.select(F.explode("words").alias("key")).distinct()
    known = texts.select(F.explode("words").alias("key")).join(asked, "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("texts"))
    each = p.select("passage", "n", "form", F.explode("words").alias("key")).join(known, "key", "left")
    # Words of the form that are whole whatever stands around the passage: all but the first and the last.
    inner = words(F.regexp_extract("form", r"^[^ ]* (.*) [^ ]*$", 1))
    item = F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "key")
    by = each.groupBy("passage").agg(F.first("n").alias("n"), F.first("form").alias("form"), F.array_sort(F.collect_list(item)).alias("rare"))
    by = by.withColumn("inner", inner)
    rarest = F.slice("rare", 1, F.col("n") - F.ceil(F.col("n") * SHARE).cast("int") + 1)
    inside = F.slice(F.filter("rare", lambda r: F.array_contains("inner", r["key"])), 1, 1)
    longest = F.element_at(F.array_sort(F.transform(F.split("form", " "), lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))), -1)["w"]
    letters = F.when((F.size(inside) == 0) & (F.length(longest) >= GRAM), F.array(F.concat(F.lit("~"), F.substring(longest, 1, GRAM)))).otherwise(F.array().cast("array<string>"))
    keys = F.array_distinct(F.concat(F.transform(F.concat(rarest, inside), lambda r: r["key"]), letters))
    return by.select("passage", F.explode(keys).alias("key"))


def borne_out(passages: DataFrame, texts: DataFrame) -> DataFrame:
    """passage, text_id, contained, share: every text that bears out a passage. passages: passage, text. texts: text_id,
    text. Passages of under 40 letters, or without words, bear out nothing."""
    p = prepared(passages)
    form = plain(F.col("text"))
    t = texts.select("text_id", form.alias("t_form")).select("text_id", "t_form", words(F.col("t_form")).alias("t_words"))
    keys = _keys(p, t.select(F.col("t_words").alias("words")))
    held = t.select("text_id", F.explode(F.concat("t_words", _grams(F.col("t_form")))).alias("key"))
    # Only keys are joined before the pairs are made distinct: texts travel once for each passage that may fit.
    pairs = held.join(keys, "key").select("passage", "text_id").distinct()
    both = pairs.join(p.select("passage", "form", "words", "n"), "passage").join(t, "text_id")
    share = F.size(F.array_intersect("words", "t_words")) / F.col("n").cast("double")
    tested = both.select("passage", "text_id", F.contains("t_form", F.col("form")).alias("contained"), share.alias("share"))
    return tested.filter(F.col("contained") | (F.col("share") >= SHARE))


def candidate_pairs(passages: DataFrame, texts: DataFrame) -> DataFrame:
    """passage, text_id of the pairs that borne_out tests."""
    t = texts.select("text_id", plain(F.col("text")).alias("t_form")).select("text_id", "t_form", words(F.col("t_form")).alias("t_words"))
    keys = _keys(prepared(passages), t.select(F.col("t_words").alias("words")))
    return t.select("text_id", F.explode(F.concat("t_words", _grams(F.col("t_form")))).alias("key")).join(keys, "key").select("passage", "text_id").distinct()
