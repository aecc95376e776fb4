"""Typing errors, routing, evidence, lines, positions, reviews, digests and replacement: what the SQL can't show."""

import random

import pytest
from pyspark.sql import functions as F

from tradewind.operators import evidence, heuristics, lines, ordinals, planner, provenance, quick_rules, repair, review, router
from tradewind.sources import nested, replace


def test_repairs(spark):
    words = spark.createDataFrame([(w,) for w in ("quagn", "huyy", "tn", "on", "to", "gia", "giaa", "xem", "")], "word string")
    known = spark.createDataFrame([(w,) for w in ("quang", "huy", "ton", "don", "gia", "xem", "giao")], "word string")
    got = {r.word: (r.candidates, r.repaired) for r in repair.repairs(words, known, ["xem"]).collect()}
    # "giaa" is one letter from "gia", and two swaps away from none: "giao" differs by a replaced letter only.
    assert got == {"quagn": (1, "quang"), "huyy": (1, "huy"), "giaa": (1, "gia")}
    two = repair.repairs(spark.createDataFrame([("donn",), ("tonn",), ("oton",)], "word string"), spark.createDataFrame([("don",), ("ton",), ("oto",)], "word string"))
    assert {r.word: (r.candidates, r.repaired) for r in two.collect()} == {"donn": (1, "don"), "tonn": (1, "ton"), "oton": (2, None)}


@pytest.mark.parametrize(
    ("question", "topic", "route"),
    [
        ("12345", None, "gibberish"), (None, None, "gibberish"), ("viết code python", None, "out_of_scope"), ("viết code python cho merchant api", None, "retrieval"), ("thời tiết ở Huế hôm nay", None, "out_of_scope"),
        ("hàng nào sắp hết", None, "inventory"), ("phiếu hết hạn, sắp hết hàng", None, "inventory"), ("merchant api base strng gồm gì", None, "merchant_base_string"), ("Merchant API là gì", None, "merchant_overview"),
        ("tại sao phải đúng thứ tự", "shop_api", "order_reason"), ("tại sao phải đúng thứ tự", None, "retrieval"), ("Cho ví dụ.", None, "generic_example"), ("cho ví dụ tính phí", "fixed_fee", "fixed_fee_example"),
        ("phí xử lý 5%", None, "fee_calculation"), ("phí xử lý", None, "retrieval"), ("doanh thu của tôi", None, "private_business"), ("public api", None, "public_api"),
    ],
)
def test_quick_routes(spark, question, topic, route):
    df = spark.createDataFrame([(question, topic)], "question string, topic string")
    assert quick_rules.quick_routes(df).first().route == route


def test_many_groups_of_phrases(spark):
    """More groups than one long has bits; phrases inside each other; a rule after another that doesn't fire."""
    rules = [(f"r{n}", router.holds(f"w{n}x") & ~router.holds("stop")) for n in range(150)] + [("inner", router.holds("w1"))]
    df = spark.createDataFrame([("w149x",), ("w70x w3x",), ("w70x stop w1",), ("w1",), (None,), ("",)], "form string")
    assert [r.route for r in router.routed(df, rules, "none").collect()] == ["r149", "r3", "inner", "inner", "none", "none"]


def test_plans(spark):
    rows = [(1, "Doanh thu tháng 8 của shop tôi là bao nhiêu?"), (2, "Chính sách hoàn tiền"), (3, "Thời tiết hôm nay"), (4, "GMV là gì"), (5, "xin chào"), (6, "quagn cáo của shop tháng 13")]
    got = {r.id: r for r in planner.plans(spark.createDataFrame(rows, "id int, question string")).collect()}
    assert (got[1].period, got[1].tools, got[1].intent) == ("2026-08", ["shop_data", "calculator"], "shop_analysis")
    assert (got[2].tools, got[2].intent) == (["rag"], "policy_rag") and (got[3].tools, got[3].intent) == ([], "out_of_scope")
    assert got[4].intent == "policy_rag" and got[5].intent == "casual" and got[5].tools == []
    assert got[6].period is None and "advertising" in got[6].tags and got[6].needs_shop_data


def test_evidence_tests_only_candidates(spark):
    words = [f"w{n:04d}x" for n in range(4000)]
    rng = random.Random(1)
    texts = [(n, " ".join(rng.sample(words, 120))) for n in range(200)]
    passages = [(0, texts[3][1][30:200]), (1, " ".join(words[:20])), (2, "a" * 50), (3, "ngắn"), (4, None), (5, " ".join(sorted(texts[7][1].split()[:40])))]
    texts += [(200, "x" + "a" * 60 + "y " + " ".join(words[:19]) + " khác"), (201, None), (202, "")]
    p, t = spark.createDataFrame(passages, "passage int, text string"), spark.createDataFrame(texts, "text_id int, text string")
    found = {(r.passage, r.text_id): (r.contained, round(r.share, 4)) for r in evidence.borne_out(p, t).collect()}
    assert found[0, 3][0] and found[5, 7] == (False, 1.0) and found[1, 200] == (False, 0.95) and found[2, 200][0]
    assert set(found) == {(0, 3), (1, 200), (2, 200), (5, 7)}
    assert evidence.candidate_pairs(p, t).count() < 0.4 * 4 * 203


def test_repeated_lines(spark):
    pages = [("a", n, f"Menu  chính\n\nnội dung {n}\r\nTrang {n}\n{'x' * 130}\n12") for n in range(5)] + [("b", n, "Menu\nkhác") for n in range(2)] + [("c", 0, None), ("c", 1, "Menu"), ("c", 2, "menu!"), ("c", 3, "MENU")]
    df = spark.createDataFrame(pages, "document string, page int, text string").repartition(3)
    assert {(r.document, r.form, r.pages) for r in lines.repeated(df).collect()} == {("a", "menu chinh", 5), ("c", "menu", 3)}
    got = {(r.document, r.page): r.text for r in lines.without_repeated(df).collect()}
    assert got["a", 1] == f"nội dung 1\nTrang 1\n{'x' * 130}\n12" and got["b", 0] == "Menu\nkhác"
    assert [got["c", n] for n in range(4)] == ["", "", "", ""]


def test_positions_of_a_hot_group(spark):
    """A group over all partitions, ties and nulls among groups; no task holds more than a part of it."""
    rows = [("hot", n % 50, n) for n in range(3000)] + [(None, 1, n) for n in range(40)] + [(f"g{n}", 0, n) for n in range(100)]
    df = spark.createDataFrame(rows, "g string, k int, n int").repartition(5)
    got = ordinals.numbered(df, ["g"], [F.desc("k"), F.col("n")]).collect()
    want = {}
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        want |= {r: n + 1 for n, r in enumerate(own)}
    assert {(r.g, r.k, r.n): r.position for r in got} == want and len(got) == len(rows)
    sums = ordinals.running(df, [], [F.col("n"), F.col("k"), F.col("g")], {"total": F.col("k"), "rows": F.lit(1)}).orderBy("rows").collect()
    assert [r.rows for r in sums] == list(range(1, len(rows) + 1)) and sums[-1].total == sum(r[1] for r in rows)
    assert ordinals.numbered(df.limit(0), ["g"], [F.col("n")]).count() == 0


RECORD, REVIEW = "id string, question string", "id string, at int, reviewer string, status string, confirmed boolean, question string, reference_answer string, evidence array<string>, expected_documents array<string>, expected_pages array<string>, note string"


def one_review(key="a", at=1, status="verified", confirmed=True, note="đã kiểm tra kỹ"):
    return (key, at, "An", status, confirmed, f"q{at}", "r", ["e"], [" d "], ["1", ""], note)


def test_reviews_must_meet_one_record(spark):
    records = spark.createDataFrame([("a", "x"), ("b", "y"), ("b", "y"), (None, "z")], RECORD)
    reviews = spark.createDataFrame([one_review(), one_review(at=2, status="rejected", confirmed=False), one_review("b", 3), one_review("c", 4), one_review("", 5), one_review("a", 6, note="ngắn"), one_review("a", 7, confirmed=False)], REVIEW)
    got = review.applied(records, reviews)
    assert {(r.at, r.reason, r.records) for r in got.refused.collect()} == {(3, "several_records", 2), (4, "no_record", 0), (5, "no_id", 1), (6, "short_note", 1), (7, "unconfirmed", 1)}
    done = {r.id: r for r in got.records.collect() if r.id != "b"}
    assert (done["a"].question, done["a"].review_status, done["a"].gold_verified, done["a"].expected_documents) == ("q2", "rejected", False, ["d"]) and done[None].question == "z"
    steps = sorted(got.journal.collect(), key=lambda r: r.at)
    assert [r.at for r in steps] == [1, 2] and steps[1].before_sha256 == steps[0].after_sha256 and steps[0].before_sha256 != steps[0].after_sha256
    with pytest.raises(ValueError, match="several_records"):
        review.replaced(records, spark.createDataFrame([one_review("b")], REVIEW))
    assert review.replaced(records, spark.createDataFrame([one_review()], REVIEW)).count() == 4


def test_digest_is_of_the_rows(spark):
    rows = [(n, f"t{n}", None if n % 3 else n / 7) for n in range(500)]
    digest = lambda data, parts: spark.createDataFrame(data, "a int, b string, c double").repartition(parts).agg(provenance.table_digest(["a", "b", "c"]).alias("d")).first().d
    whole = digest(rows, 1)
    assert whole == digest(rows[::-1], 7)
    assert len({whole, digest(rows[:-1], 3), digest([*rows, rows[0]], 3), digest([*rows[:-1], (499, "t499 ", rows[-1][2])], 3), digest([*rows[:-1], (499, None, rows[-1][2])], 3)}) == 5


def test_gates_that_hold(spark):
    items = spark.createDataFrame([(str(n), s, True, []) for n, s in enumerate(("dev", " TEST", "challenge"))], "id string, split string, gold_verified boolean, flags array<string>")
    assert all(r.passed for r in provenance.gates(items).collect())
    got = {r.gate: (r.passed, r.examples) for r in provenance.gates(items.limit(0)).collect()}
    assert got["not_empty"] == (False, "") and got["splits_present"] == (False, "challenge,dev,test") and got["all_verified"][0]


class Died(Exception):
    pass


@pytest.mark.parametrize("step", replace.STEPS)
@pytest.mark.parametrize("first", [True, False])
def test_a_dead_writer_leaves_old_or_new(spark, tmp_path, monkeypatch, step, first):
    path = str(tmp_path / "t")
    if not first:
        assert replace.replaced(spark.range(3).selectExpr("id", "'old' AS k"), path) == 3

    def die(now):
        if now == step:
            raise Died

    monkeypatch.setattr(replace, "_after", die)
    with pytest.raises(Died):
        replace.replaced(spark.range(5).selectExpr("id", "'new' AS k"), path)
    monkeypatch.undo()
    if first and step == "written":
        assert replace.recover(spark, path) == "whole" and not (tmp_path / "t").exists()
    else:
        kinds = {r.k for r in replace.opened(spark, path).collect()}
        assert kinds == ({"old"} if step == "written" or (step == "checked" and not first) else {"new"})
    assert [p.name for p in tmp_path.iterdir() if p.name != "t"] == []
    assert replace.replaced(spark.range(2).selectExpr("id", "'last' AS k"), path) == 2
    assert {r.k for r in replace.opened(spark, path).collect()} == {"last"}


def test_a_table_replaced_by_rows_of_its_own(spark, tmp_path):
    path = str(tmp_path / "t")
    replace.replaced(spark.range(10).selectExpr("id", "'đ' AS k"), path)
    assert replace.replaced(replace.opened(spark, path).filter("id < 4"), path) == 4
    assert sorted(r.id for r in replace.opened(spark, path).collect()) == [0, 1, 2, 3]


def test_nested_sources(spark):
    lines_of = lambda *values: spark.createDataFrame([(v,) for v in values], "value string")
    store = lines_of('{"id": "c", "messages": [{"role": 5, "content": null}, "x", {"content": "hi", "confidence": "no", "metrics": 3, "citations": [1, {}]}]}', "[]", "{", "", '{"messages": {"a": 1}}', "null")
    got = nested.conversations(store).collect()
    assert [(r.conversation_id, r.title, r.place, r.role, r.content, r.confidence, r.citations, r.elapsed) for r in got] == [("c", nested.UNTITLED, 0, "5", "", None, 0, 0.0), ("c", nested.UNTITLED, 1, "assistant", "hi", None, 1, 0.0)]
    assert {(r.reason, r.records) for r in nested.rejected(store).collect()} == {("not_an_object", 2), ("not_json", 1)}
    videos = nested.videos(lines_of('{"items": [{"id": {"videoId": "v"}, "snippet": {"title": "T", "publishedAt": "2026-01-02T03"}}, {"id": {}}, 7]}', '{"items": null}'))
    assert [tuple(r) for r in videos.collect()] == [("T", nested.NO_CHANNEL, "2026-01-02", "https://www.youtube.com/watch?v=v")]
    found = nested.research(lines_of('{"data": {"videos": [{"video_description": "d", "view_count": 12345, "create_time": 20260102}]}}')).collect()
    assert [tuple(r) for r in found] == [("d", "12,345 lượt xem · 0 lượt thích", "20260102", "")]


def test_bonus_may_be_negative(spark):
    pairs = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2)], "query_id int, doc_id int")
    queries = spark.createDataFrame([(1, "Hàng cấm là gì?"), (2, None)], "query_id int, question string")
    docs = spark.createDataFrame([(1, "Ngành hàng hạn chế khuyến mãi", "x", "other", "1", "D"), (2, "Cấm hạn chế sản phẩm", "Danh sách sản phẩm cấm", None, None, None)], "doc_id int, title string, text string, source string, page string, document_id string")
    got = {(r.query_id, r.doc_id): float(r.bonus) for r in heuristics.bonuses(pairs, queries, docs).collect()}
    assert got == {(1, 1): -0.45, (1, 2): 0.52, (2, 1): 0.0, (2, 2): 0.0}


def test_a_phrase_named_twice_sets_its_own_groups_bit_alone(spark):
    texts = spark.createDataFrame([(1, "so sanh roas"), (2, "tra hang")], "id long, form string")
    got = router.flagged(texts, {"twice": router.holds("roas", "gmv", "roas"), "next": router.holds("tra hang")})
    assert [(r.twice, r.next) for r in got.orderBy("id").collect()] == [(True, False), (False, True)]
    asked = spark.createDataFrame([(1, "so sánh roas")], "id long, question string")
    plan = planner.plans(asked).first()
    assert (plan.intent, plan.tools) == ("shop_analysis", ["shop_data", "calculator"])
