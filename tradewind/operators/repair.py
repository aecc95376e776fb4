"""Typing errors: words that are one letter or one swap away from exactly one word of a vocabulary.

Two words are that near only if they share a form with at most one letter left out: the shorter of two is such a form of
the longer, and a swap's words are equal without the first letter swapped in one, the second in the other. Forms are
therefore join keys: each word brings as many as it has letters, meets the few vocabulary words of the same form, and no
vocabulary is scanned. What meets is then tested. Words are taken once each, however often they occur."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import one_edit_apart

#: Shorter words are left alone.
LEAST_LETTERS = 3


def deletions(word: Column) -> Column:
    """The word, and each form of it with one letter left out."""
    places = F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1)))
    return F.array_distinct(F.concat(F.array(word), F.transform(places, lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))))


def suspects(words: DataFrame, vocabulary: DataFrame, protected: list[str] = ()) -> DataFrame:
    """word: distinct words that are in neither list and have letters enough."""
    long_enough = words.select("word").filter(F.length("word") >= LEAST_LETTERS)
    return long_enough.filter(~F.col("word").isin(list(protected)) if protected else F.lit(True)).distinct().join(vocabulary.select("word"), "word", "left_anti")


def repairs(words: DataFrame, vocabulary: DataFrame, protected: list[str] = ()) -> DataFrame:
    """word, candidates, repaired: how many vocabulary words are one error away, and that word where it is the only one.
    Words with no such candidate have no row."""
    left = suspects(words, vocabulary, protected).select("word", F.explode(deletions(F.col("word"))).alias("form"))
    right = vocabulary.select(F.col("word").alias("known")).distinct().select("known", F.explode(deletions(F.col("known"))).alias("form"))
    met = left.join(right, "form").filter(one_edit_apart(F.col("word"), F.col("known"))).select("word", "known").distinct()
    found = met.groupBy("word").agg(F.count(F.lit(1)).alias("candidates"), F.min("known").alias("known"))
    return found.select("word", "candidates", F.when(F.col("candidates") == 1, F.col("known")).alias("repaired"))


def repaired_texts(texts: DataFrame, vocabulary: DataFrame, protected: list[str] = ()) -> DataFrame:
    """texts (id, form: words and single spaces) with repaired: the form with its errors repaired. Only words that need
    it travel; a text's words stay in its row."""
    words = texts.select("id", F.explode(F.array_distinct(F.split("form", " "))).alias("word"))
    fixes = repairs(words, vocabulary, protected).filter("repaired is not null").select("word", "repaired")
    own = words.join(fixes, "word").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("word", "repaired"))).alias("fixes"))
    fixed = F.array_join(F.transform(F.split("form", " "), lambda w: F.coalesce(F.try_element_at("fixes", w), w)), " ")
    return texts.join(own, "id", "left").withColumn("repaired", F.coalesce(fixed, "form")).drop("fixes")
