"""Questions that lean on the one before: what was asked and answered last, questions written out in full, and repeated
ones that get the last answer again.

The batch side finds a turn's predecessors by running counts over range partitions and equi joins, so that a conversation
of any length is spread over tasks; streaming/turns.py keeps the same in a keyed state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import match_form
from .ordinals import running

# What a question that leans on another begins with or holds, what it asks for, and how it is written out.
MARKERS = ("no ", "no dung", "no dung de", "cai nay", "cai do", "lay o dau", "dung de lam gi", "thi sao", "khac gi", "con ", "vay ", "the ")
MOST_WORDS = 10
INTENTS = {
    "purpose": ("dung de lam gi", "co tac dung gi", "muc dich la gi", "de lam gi"),
    "location": ("lay o dau", "tim o dau", "o dau"),
    "comparison": ("khac gi", "khac nhau the nao", "so sanh"),
}
REQUESTS = {
    "purpose": "Hãy giải thích mục đích và vai trò của nội dung đó.",
    "location": "Hãy xác định nội dung đó được lấy hoặc cấu hình ở đâu.",
    "comparison": "Hãy so sánh nội dung đó với phần liên quan gần nhất.",
}
PREVIOUS, NEXT, BASED_ON, NOW = "Câu hỏi trước: ", "Câu hỏi tiếp theo: ", "Dựa trên câu hỏi trước: ", "Câu hỏi hiện tại: "


def _any(form: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, (F.contains(form, F.lit(p)) for p in phrases))


def with_last(turns: DataFrame) -> DataFrame:
    """conv_id, turn, question, previous, last_answer: the user's turns, each with the user's question before it and the
    last answer since that one. turns: conv_id, turn (no two alike in a conversation), role, text."""
    user = F.col("role") == "user"
    rows = running(turns.select("conv_id", "turn", "role", "text"), ["conv_id"], [F.col("turn")], {"asked": user.cast("int")})
    users = rows.filter(user).select("conv_id", "turn", F.col("text").alias("question"), "asked")
    before = users.select("conv_id", (F.col("asked") + 1).alias("asked"), F.col("question").alias("previous"))
    answers = rows.filter((F.col("role") == "assistant") & (F.col("asked") > 0)).groupBy("conv_id", (F.col("asked") + 1).alias("asked")).agg(F.max_by("text", "turn").alias("last_answer"))
    return users.join(before, ["conv_id", "asked"], "left").join(answers, ["conv_id", "asked"], "left").drop("asked")


def rewritten(turns: DataFrame) -> DataFrame:
    """turns (question, previous, last_answer) with resolved (the question with the one before it, where it leans on it),
    query (the same written out by what it asks for) and repeat_answer (the last answer, where the question is the same
    again). Works on a batch and on a stream."""
    q = turns.withColumns({"_form": match_form(F.col("question")), "_before": match_form(F.col("previous"))})
    form = F.col("_form")
    leans = reduce(Column.__or__, ((form == m.strip()) | form.startswith(m) | F.contains(form, F.lit(m.strip())) for m in MARKERS))
    few = F.when(form == "", 0).otherwise(F.size(F.split("_form", " "))) <= MOST_WORDS
    there = F.col("previous").isNotNull()
    question = F.coalesce("question", F.lit(""))
    resolved = F.when(there & few & leans, F.concat(F.lit(PREVIOUS), "previous", F.lit("\n" + NEXT), question)).otherwise(question)
    query = F
    for intent, phrases in INTENTS.items():
        query = query.when(there & (F.col("previous") != "") & _any(form, phrases), F.concat(F.lit(BASED_ON), "previous", F.lit(f". {REQUESTS[intent]} {NOW}"), question))
    known = there & (F.col("previous") != "") & (F.coalesce("last_answer", F.lit("")) != "")
    return q.withColumns({"resolved": resolved, "query": query.otherwise(question), "repeat_answer": F.when(known & (form == F.col("_before")), F.col("last_answer"))}).drop("_form", "_before")


def batch(turns: DataFrame) -> DataFrame:
    return rewritten(with_last(turns))
