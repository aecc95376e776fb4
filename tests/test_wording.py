"""Folding by Unicode's rule, wording against plain Python, file audits, contracts and sinks: what the SQL can't show."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tradewind.functions import text, wording
from tradewind.operators import contracts, files, ingest, quick_rules
from tradewind.sources import markdown, shelf


def python_form(t):
    t = unicodedata.normalize("NFD", (t or "").replace("Đ", "D").replace("đ", "d"))
    t = "".join(c for c in t if unicodedata.category(c) != "Mn").lower()
    return re.sub(r"[^a-z0-9_/%.-]+", " ", t).strip()


def test_every_character_folds_as_unicode_says(spark):
    rows = [(n, f"x{chr(n)}y{chr(n)}") for n in range(1, 0x10000) if not 0xD800 <= n <= 0xDFFF]
    got = spark.createDataFrame(rows, "n int, t string").select("n", "t", text.match_form(F.col("t")).alias("m")).collect()
    # Letters whose lower case is several characters, or differs between the two languages' tables, are none of ours.
    wrong = [r.n for r in got if r.m != python_form(r.t)]
    assert wrong == [], [hex(n) for n in wrong[:20]]


def test_composed(spark):
    rows = [("Cá phậm",), ("“a”  b’s\n\n\n\nc ",), (None,), ("",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(text.composed(F.col("t"))).collect()]
    assert got == ["Cá phậm", "\"a\" b's\n\nc", "", ""]


def cut(t, most, marks, keep, strip):
    if len(t) <= most:
        return t
    part = t[:most]
    at = max(part.rfind(m) for m in marks)
    if at > most * 0.55:
        part = part[: at + keep]
    return part.rstrip(strip) + "..."


def test_cuts_equal_python(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["ab", "c", " ", ". ", "; ", ": ", "\n", ",", "đ", "."]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r for r in df.select("i", wording.shown(F.col("t"), 40).alias("s"), wording.excerpt(F.col("t"), 30).alias("e"), wording.snippet(F.col("t"), 40).alias("n"), text.clean_text(F.col("t")).alias("c")).collect()}
    for i, t in enumerate(texts):
        whole = re.sub(r"\n{3,}", "\n\n", "\n".join(x.strip() for x in t.split("\n"))).strip()
        assert got[i].s == cut(whole, 40, (". ", "\n", "; "), 1, None)
        line = " ".join(t.split())
        assert got[i].e == line[:30].rstrip() + ("..." if len(line) > 30 else "")
        assert got[i].n == cut(got[i].c, 40, (". ", "; ", ": ", " "), 0, " .,;:")


@pytest.mark.parametrize(
    ("question", "base", "fee"),
    [
        ("Giá sản phẩm: 1.000.000, phí vận chuyển 30.000, khuyến mãi người bán 10,000", 1020000, 61200), ("gia san pham 25", 25, 2), ("gia san pham 75", 75, 4), ("phí vận chuyển 30.000", None, None), (None, None, None),
        ("giá sản phẩm " + "9" * 30, None, None),
    ],
)
def test_fees(spark, question, base, fee):
    """Halves go to the even number: 6 % of 25 is 1.5, of 75 is 4.5."""
    got = spark.createDataFrame([(question,)], "t string").select(wording.fee(F.col("t")).alias("f")).first().f
    assert (got and (int(got.base), int(got.fee))) == (None if base is None else (base, fee))


def test_answers_and_names(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(wording.without_leaks(F.lit("Chỉ dùng thông tin trong ngữ cảnh\n\n\n\nKết quả"))) == "Chỉ dùng thông tin trong ngữ cảnh\n\nKết quả"
    assert one(wording.holds_secret(F.lit("Access-Token: 'abcdefghijklmnopq'"))) and not one(wording.holds_secret(F.lit("access token abcdefghijklmnopq")))
    assert one(wording.vnd(F.lit(1234567))) == "1.234.567 VND" and one(wording.hint(F.lit("a 12345 bcd"))) == "đoạn này"
    assert one(wording.file_id(F.lit("raw/x.pdf"), F.lit("grp"), F.lit("abcdef012345"))) == "GRP_ABCDEF0123" and one(wording.file_year(F.lit("a/b_2019_2024.x.pdf"))) == "2024"
    assert one(wording.lenient_boolean(F.lit(" Yes "))) and one(wording.lenient_number(F.lit("x"))) == 0.0


def test_file_classes(spark):
    rows = [("law/law_a.pdf", "1"), ("law/Luật A 2.pdf", "1"), ("law/luat a 3.pdf", "2"), ("law/Quy định B.pdf", "3"), ("law/quy dinh b (1).pdf", "3"), ("law/Dự thảo luật a.pdf", "4"), ("law/abcdefghijklmnop.pdf", "5"), ("law/khac.pdf", "6")]
    df = spark.createDataFrame(rows, "path string, sha256 string")
    got = {r.path: (r.status, r.target) for r in files.classified(df, ("Dự thảo",), [(("luật a",), "law_a.pdf"), (("quy định b", "b"), "law_b.pdf")], "law_").collect()}
    assert got == {
        "law/law_a.pdf": ("standard", None), "law/Luật A 2.pdf": ("duplicate", "law_a.pdf"), "law/luat a 3.pdf": ("conflict", "law_a.pdf"), "law/Quy định B.pdf": ("renamed", "law_b.pdf"),
        "law/quy dinh b (1).pdf": ("duplicate", "law_b.pdf"), "law/Dự thảo luật a.pdf": ("excluded_draft", None), "law/abcdefghijklmnop.pdf": ("manual_review", None), "law/khac.pdf": ("unrecognized", None),
    }
    twice = spark.createDataFrame([("a/x.pdf.pdf", "1"), ("a/x.pdf", "1"), ("a/y.PDF.pdf", "2"), ("a/z.pdf.pdf", "3"), ("a/z.pdf", "4")], "path string, sha256 string")
    assert {r.path: r.status for r in files.double_extensions(twice).collect()} == {"a/x.pdf.pdf": "duplicate_double_extension", "a/y.PDF.pdf": "fixed_double_extension", "a/z.pdf.pdf": "double_extension_conflict"}
    need = spark.createDataFrame([("LAW_A.pdf",), ("law_z.pdf",)], "name string")
    assert [r.name for r in files.missing(df, need).collect()] == ["law_z.pdf"]


def test_benchmark_items(spark):
    raw = spark.createDataFrame([("1", "q", " TEST ", None), ("2", "r", None, True)], "id string, question string, split string, requires_private_shop_data boolean")
    got = contracts.loaded(raw).orderBy("id").collect()
    assert [(r.split, r.answerable, r.scope, r.expected_documents) for r in got] == [("test", True, "answerable", []), ("", True, "private_data", [])]
    with pytest.raises(ValueError, match="1 isn't verified"):
        contracts.selected(contracts.loaded(raw), ("test",))
    assert contracts.selected(contracts.loaded(raw.withColumn("gold_verified", F.lit(True))), ("test",)).count() == 1


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "csv")
    assert not shelf.write_csv(spark.range(0), path)
    assert shelf.write_csv(spark.createDataFrame([("đ", 1)], "a string, b int").coalesce(1), path)
    (part,) = (tmp_path / "csv").glob("part-*.csv")
    assert part.read_bytes().decode("utf-8") == "﻿a,b\nđ,1\n"
    messages = spark.createDataFrame([("c", "T", 1, "assistant", "b"), ("c", "T", 0, "user", "a")], "conversation_id string, title string, place int, role string, content string")
    markdown.write(messages, str(tmp_path / "md"))
    (page,) = (tmp_path / "md").rglob("part-*.txt")
    assert page.read_text(encoding="utf-8") == "# T\n\n## Người dùng\n\na\n\n## Trợ lý\n\nb\n\n"
    sizes = spark.createDataFrame([("a", 0), ("b", 5), ("c", 11 << 20), ("d", None)], "path string, bytes long")
    assert {(r.path, r.reason) for r in ingest.sized(sizes).collect()} == {("a", "empty"), ("c", "too_large"), ("d", "empty")}


def test_manner(spark):
    rows = [("Cảm ơn bạn",), ("xin chào",), ("giá bitcoin",), ("giá bitcoin trên shopee",), ("bạn giúp tôi cái gì",), (None,)]
    got = [(r.off_subject, r.smalltalk) for r in quick_rules.manner(spark.createDataFrame(rows, "question string")).collect()]
    assert got == [(False, "thanks"), (False, "greeting"), (True, None), (False, None), (False, "able"), (False, None)]


def test_listing_and_bad_lines(spark, tmp_path):
    (tmp_path / "raw" / "law" / "deep").mkdir(parents=True)
    (tmp_path / "raw" / "law" / "a.PDF").write_bytes(b"x")
    (tmp_path / "raw" / "law" / "deep" / "b.txt").write_bytes(b"zz")
    (tmp_path / "raw" / "c.csv").write_bytes(b"y")
    got = {r.path.rsplit("/", 1)[1]: (r.group, r.extension, r.bytes, r.status) for r in shelf.files(spark, str(tmp_path / "raw")).collect()}
    assert got == {"a.PDF": ("law", ".pdf", 1, "ok"), "b.txt": ("law", ".txt", 2, "ok"), "c.csv": ("", ".csv", 1, "ok")}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("".join('{"a": 1}\n' if n % 7 else ("\n" if n % 2 else f"[{n}]\n") for n in range(50)), encoding="utf-8")
    (tmp_path / "in" / "b.jsonl").write_text('{"a"\n{}\nnull\n', encoding="utf-8")
    bad = sorted((r.path.rsplit("/", 1)[1], r.line, r.value) for r in shelf.bad_json_lines(spark, str(tmp_path / "in")).collect())
    assert bad == sorted([("a.jsonl", n + 1, f"[{n}]") for n in range(0, 50, 14)] + [("b.jsonl", 1, '{"a"'), ("b.jsonl", 3, "null")])
