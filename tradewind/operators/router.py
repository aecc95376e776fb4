"""Routing of questions by an ordered list of rules: the first rule that fires names the route.

All phrases of all rules go into one automaton, which a task builds once; each text is read once, whatever the number of
phrases, and leaves one bit for each group of phrases it holds one of. Rules are then tests of bits: plain expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..session import ship_package

#: Bits of one long that are used.
BITS = 62


@dataclass(frozen=True)
class Test:
    """A condition on a question. kind: any (holds one of the phrases), is (is one of them, dots and spaces at the ends
    left out), topic (the topic so far is one of them), like (matches one of these patterns), flag (a column says so), all, one, no
    (of parts)."""

    kind: str
    phrases: tuple[str, ...] = ()
    parts: tuple[Test, ...] = ()
    view: str = "form"

    def __and__(self, other: Test) -> Test:
        return Test("all", parts=(self, other))

    def __or__(self, other: Test) -> Test:
        return Test("one", parts=(self, other))

    def __invert__(self) -> Test:
        return Test("no", parts=(self,))

    def groups(self) -> list[Test]:
        return [self] if self.kind == "any" else [g for p in self.parts for g in p.groups()]

    def over(self, name: dict[Test, str]) -> Column:
        """The test where each group of phrases has been looked for and has a boolean column."""
        return self._column(lambda group: F.col(name[group]))

    def column(self, bit: dict[Test, int]) -> Column:
        """The test over bits()."""
        return self._column(lambda group: F.col("_bits")[bit[group] // BITS].bitwiseAND(F.lit(1 << (bit[group] % BITS))) != 0)

    def _column(self, held: Callable[[Test], Column]) -> Column:
        if self.kind == "any":
            return held(self)
        if self.kind == "is":
            return F.regexp_replace(F.col(self.view), r"^[ .]+|[ .]+$", "").isin(list(self.phrases))
        if self.kind == "topic":
            return F.coalesce(F.col("topic").isin(list(self.phrases)), F.lit(False))
        if self.kind == "like":
            return reduce(Column.__or__, (F.col(self.view).rlike(p) for p in self.phrases))
        if self.kind == "flag":
            return F.col(self.view)
        parts = [p._column(held) for p in self.parts]
        return ~parts[0] if self.kind == "no" else reduce(Column.__and__ if self.kind == "all" else Column.__or__, parts)


def holds(*phrases: str, view: str = "form") -> Test:
    return Test("any", phrases, view=view)


def holds_all(*phrases: str, view: str = "form") -> Test:
    return reduce(Test.__and__, (holds(p, view=view) for p in phrases))


def equals(*phrases: str, view: str = "form") -> Test:
    return Test("is", phrases, view=view)


def topic(*names: str) -> Test:
    return Test("topic", names)


def like(*patterns: str, view: str = "form") -> Test:
    return Test("like", patterns, view=view)


def flag(column: str) -> Test:
    return Test("flag", view=column)


def bits(groups: list[Test]) -> Column:
    """array<long>: a bit for each group of phrases that its view of the text holds one of."""
    views = sorted({g.view for g in groups})
    wanted: dict[str, dict[str, list[int]]] = {v: {} for v in views}
    for number, g in enumerate(groups):
        for p in dict.fromkeys(g.phrases):  # A phrase that a group names twice counts once: twice its bit is the next group's.
            wanted[g.view].setdefault(p, []).append(number)
    words = -(-len(groups) // BITS)
    masks = {v: {p: [sum(1 << (n % BITS) for n in numbers if n // BITS == w) for w in range(words)] for p, numbers in found.items()} for v, found in wanted.items()}

    @pandas_udf("array<long>")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        import ahocorasick

        automata = []
        for v in views:
            a = ahocorasick.Automaton()
            for phrase, mask in masks[v].items():
                a.add_word(phrase, mask)
            a.make_automaton()
            automata.append(a)
        for columns in batches:
            out = []
            for texts in zip(*(columns if isinstance(columns, tuple) else (columns,)), strict=True):
                total = [0] * words
                for a, text in zip(automata, texts, strict=True):
                    for _, mask in a.iter(text or ""):
                        total = [x | y for x, y in zip(total, mask, strict=True)]
                out.append(total)
            yield pd.Series(out)

    return run(*(F.col(v) for v in views))


def flagged(questions: DataFrame, tests: dict[str, Test]) -> DataFrame:
    """questions with a boolean column for each test; a null text holds nothing. The views that tests look at must be
    there."""
    ship_package(questions.sparkSession)
    groups = list(dict.fromkeys(g for test in tests.values() for g in test.groups()))
    bit = {g: n for n, g in enumerate(groups)}
    found = questions.withColumn("_bits", bits(groups)) if groups else questions
    return found.withColumns({name: F.coalesce(test.column(bit), F.lit(False)) for name, test in tests.items()}).drop("_bits")


def routed(questions: DataFrame, rules: list[tuple[str, Test]], otherwise: str | None = None) -> DataFrame:
    """questions with route: the name of the first rule that fires, otherwise none. The columns that rules look at (form,
    topic and other views) must be there; a null text holds nothing."""
    names = {f"_rule{n}": name for n, (name, _) in enumerate(rules)}
    found = flagged(questions, dict(zip(names, (test for _, test in rules), strict=True)))
    route = reduce(lambda chain, rule: chain.when(F.col(rule), names[rule]), names, F)
    return found.withColumn("route", route.otherwise(F.lit(otherwise))).drop(*names)
