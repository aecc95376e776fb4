"""Planning over a table of questions: period, tools in order, intent and analysis tags, by rules over folded text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, squeeze
from .repair import repaired_texts
from .router import Test, flagged, holds, holds_all

# Words that typing errors are repaired to, words that stay, and what other phrasings stand for.
TYPO_VOCABULARY = (
    "quang", "cao", "ton", "kho", "van", "hanh", "danh", "gia", "doi", "soat", "giao", "tre", "huy", "don", "luot", "xem", "them", "gio", "nha", "cung", "cap", "doanh", "thu", "phi", "loi",
    "nhuan", "khuyen", "mai", "sku", "roas", "chi", "nhieu",
)
PROTECTED = (
    "ai", "bao", "cua", "da", "de", "gi", "hay", "la", "lo", "nao", "nhat", "neu", "sau", "san", "pham", "shop", "thang", "uoc", "tinh", "ve", "voi",
)
ALIASES = {
    "chi phi van hanh khoan van hanh": ("khoan chi van hanh", "chi van hanh", "khoan van hanh"),
    "luot xem cao": ("xem nhieu", "nhieu nguoi xem", "xem cao"),
    "it them gio": ("ty le them gio thap", "them gio thap", "it vao gio"),
    "quang cao theo sku": ("roas quang cao sku", "roas theo sku", "quang cao sku"),
    "danh gia thap": ("danh gia xau", "danh gia kem", "danh gia 1 3 sao"),
    "ty le giao dung hen": ("giao dung hen", "giao on time", "ty le dung hen"),
}
# The phrases of each kind of question.
POLICY = (
    "theo chinh sach", "chinh sach", "quy dinh", "dieu khoan", "shopee", "phi co dinh", "phi xu ly", "tra hang", "hoan tien", "merchant api", "shop api", "hop dong", "giao dich dien tu",
    "phap luat", "luat",
)
SHOP = (
    "shop toi", "cua shop toi", "doanh thu", "doanh so", "gmv", "don hang", "ton kho", "san pham cua toi", "quang cao", "roas", "chi phi cua shop", "loi nhuan", "lai gop", "lo von", "gia von",
    "hang hoan", "hoan hang", "danh gia", "phan hoi", "review", "nhap hang", "nha cung cap", "don nhap", "chi phi van hanh", "dong goi", "nhan su", "kho bai", "bien dong kho", "hang loi",
    "hang hu", "kiem tra chat luong", "chat luong lo hang", "that thoat", "dong tien", "tien vao", "tien ra", "nha cung cap tot", "giao hang dung hen", "khach quay lai",
    "khach hang than thiet", "khach trung thanh", "luot xem", "them gio hang", "hieu qua san pham", "phieu san pham", "giam gia", "nhap bao nhieu", "nhap nhieu hon", "sap het", "ton lau",
    "it ban", "san pham ban tot", "ty le loi lo hang", "ty le loi", "nguon hang", "danh gia xau", "khoan van hanh", "tien chi", "thieu tien", "luot xem cao", "it them gio", "it dat mua",
    "kho chot don", "30 ngay", "tao combo", "nguy co lo", "tuan nay", "khuyen mai", "ma giam gia", "gia sau khuyen mai", "quang cao theo sku", "tuoi ton", "lo hang ton", "tu khoa", "tim kiem",
    "vi tri tim kiem", "giao tre", "van chuyen", "thoi gian xu ly", "ly do huy don", "huy don", "do huy", "doi soat", "tien shopee phai tra", "phi thuc te", "ngay nhan tien", "doi thu",
    "shop tham khao",
)
DEFINED = (
    "gmv", "roas", "sku", "doanh thu", "loi nhuan", "gia von", "hoa von", "dong tien", "ton kho", "don bi huy", "don huy", "don da huy", "nguong nhap them", "chi phi quang cao",
)
DEFINITION = (
    "la gi", "nghia la gi", "co phai", "khac gi", "tinh nhu the nao", "tinh sao", "giai thich", "co duoc tinh", "co tinh", "tinh doanh thu khong",
)
PRIVATE = ("shop toi", "cua shop", "cua toi", "cua hang toi", "bao nhieu", "san pham nao", "thang nay", "thang ", "ky nay", "hien tai")
COST = ("khoan chi phi", "chi phi nao", "chi phi lon nhat", "khoan phi lon nhat", "anh huong nhieu nhat")
CALCULATION = ("tinh", "bao nhieu", "ty le", "phan tram", "roas", "anh huong nhieu nhat", "cao nhat", "thap nhat", "so sanh", "so voi")
OUT_OF_SCOPE = ("thoi tiet", "bong da", "doi bong", "world cup", "phim", "am nhac", "dich benh", "tu van y te", "bi sot", "uong thuoc", "gia vang", "chung khoan")
CASUAL = (
    "chao", "xin chao", "hello", "hi", "alo", "cam on", "thanks", "thank you", "ban khoe khong", "ban la ai", "eslabong la gi", "ban co the lam gi", "ban lam duoc gi", "eslabong co the lam gi",
    "ban co the giup gi", "giup toi voi", "toi can giup do",
)
SYSTEM_LIMIT = ("ai co cam ket", "ai nay da ket noi", "tu doan roas", "khong tai bang quang cao")
LAW = ("hop dong", "giao dich dien tu", "phap luat", "luat")
SETTLED = ("doi soat", "tien shopee phai tra", "phi thuc te", "ngay nhan tien")
OWN = ("shop toi", "cua shop", "cua toi", "cua hang toi", "thang ", "ky nay", "hien tai", "bao nhieu", "san pham nao")

_policy, _private = holds(*POLICY), holds(*PRIVATE)
_definition = (holds(*DEFINED) & holds(*DEFINITION) & ~_private) | holds_all("chi phi quang cao", "co phai")
_general_policy = (holds(*LAW) & ~_private) | holds_all("mat hang nay", "duoc ban") | (_policy & ~_private & ~holds(*SETTLED) & ~holds(*OWN))
_shop = (holds(*SHOP) | holds(*COST)) & ~(_definition | _general_policy | holds(*SYSTEM_LIMIT))
KINDS: dict[str, Test] = {
    "out": holds(*OUT_OF_SCOPE),
    "signal": holds(*SHOP, *POLICY, *CALCULATION),
    "policy": _policy,
    "shop": _shop,
    "calculation": holds(*CALCULATION) & _shop,
}


def _tag(*tests: tuple[str, Test]) -> dict[str, Test]:
    """A tag may come from several rules."""
    out: dict[str, Test] = {}
    for tags, test in tests:
        for tag in tags.split():
            out[tag] = out[tag] | test if tag in out else test
    return out


# What a question is about, for the choice of reports.
TAGS = _tag(
    ("product_gmv", holds("gmv") & holds("san pham nao", "mat hang nao", "cao nhat")),
    ("product_contribution", holds("lai gop") & holds("san pham nao", "mat hang nao", "thap nhat", "thap")),
    ("sales_comparison", holds("so sanh") & holds("doanh thu", "gmv", "thang truoc")),
    ("inventory", holds("ton kho", "sap het", "ton lau", "it ban", "nhap them", "nhap bao nhieu", "nhap nhieu hon")),
    ("slow_inventory inventory_batches", holds("ton lau", "it ban", "cham ban")),
    ("product_demand", holds("san pham ban tot", "san pham nao ban tot", "nhap nhieu hon")),
    ("advertising", holds("quang cao", "roas", "ads")),
    ("price_promotions", holds("giam gia", "khuyen mai", "ma giam gia", "gia sau khuyen mai", "gia cuoi")),
    ("ads_sku_daily", holds("quang cao theo sku", "quang cao tung san pham", "sku nao nen tang ngan sach") | holds_all("sku", "roas")),
    ("inventory_batches", holds("tuoi ton", "ton theo lo", "lo hang ton", "lo ton lau")),
    ("inventory_batch_question inventory_batches", holds("lo hang", "lo ton", "lo nao", "2 lo") & holds("ton", "nam lau", "ton lau", "tuoi ton")),
    ("search_performance", holds("tu khoa", "tim kiem", "vi tri tim kiem", "hien thi tim kiem")),
    ("shipping_performance", holds("giao tre", "van chuyen", "thoi gian xu ly", "ly do huy don", "huy don", "do huy")),
    ("settlements", holds("doi soat", "tien shopee phai tra", "phi thuc te", "ngay nhan tien")),
    ("competitor_catalog", holds("doi thu", "shop tham khao", "gia doi thu", "danh muc doi thu")),
    ("price_strategy price_promotions", holds("giam gia", "dieu chinh gia", "gia ban") & holds("nen", "co nen", "the nao", "toan bo")),
    ("restock_strategy quality", holds("nhap bao nhieu", "nhap nhieu hon", "nhap them", "nhap hang")),
    ("ad_strategy ads_sku_daily", holds("tang ngan sach", "ngan sach quang cao", "chi quang cao") & holds("nen", "co nen", "hieu qua", "tang")),
    ("profitability", holds("loi nhuan", "lo von", "gia von", "lai sau chi phi van hanh", "nguy co lo")),
    ("returns", holds("hang hoan", "hoan hang", "ly do hoan")),
    ("reviews", holds("danh gia", "review", "phan hoi khach")),
    ("review_action", holds("danh gia xau", "danh gia thap", "giam danh gia") | (holds("danh gia") & holds("1-3 sao", "1 3 sao", "xu ly", "van de nao truoc"))),
    ("procurement", holds("nhap hang", "don nhap")),
    ("operating_costs", holds("chi phi van hanh", "khoan van hanh", "dong goi", "nhan su", "kho bai", "van chuyen phat sinh")),
    ("operating_rank", holds("khoan van hanh nao", "khoan chi van hanh nao") | (holds("khoan van hanh") & holds("lon nhat", "cao nhat"))),
    ("inventory_movements", holds("bien dong kho", "that thoat", "hang hu", "hang loi", "hang loi/huy")),
    ("quality", holds("kiem tra chat luong", "chat luong lo hang", "ty le loi", "lo hang", "hang loi", "nguon hang nao co ty le loi")),
    ("cash_flow", holds("dong tien", "tien vao", "tien ra", "tien chi", "thieu tien")),
    ("cash_rank", holds("khoan tien chi") & holds("lon nhat", "cao nhat")),
    ("cash_explanation", holds_all("doanh thu tang", "thieu tien")),
    ("suppliers", holds("nha cung cap", "nguon hang", "giao hang dung hen")),
    ("suppliers supplier_on_time_low", holds("ty le giao dung hen") & holds("thap nhat", "thap", "kem nhat")),
    ("quality supplier_action", holds("phan hoi nha cung cap")),
    ("quality supplier_defect", holds("nguon hang nao co ty le loi")),
    ("customer_retention", holds("khach quay lai", "khach hang than thiet", "khach trung thanh")),
    ("retention_action", holds("lam sao tang khach quay lai")),
    ("product_funnel", holds("luot xem", "them gio", "hieu qua san pham", "phieu san pham", "kho chot don", "dat mua")),
    ("funnel_view_action", holds_all("luot xem", "them gio") & holds("luot xem cao", "nhieu luot xem", "it them gio", "ty le tu xem sang them gio", "thap nhat")),
    ("funnel_cart_action", holds("them gio") & holds("it dat mua", "it dat")),
    ("inventory_shrinkage", holds("that thoat")),
    ("profitability operating_costs profit_after_overhead", holds("lai sau chi phi van hanh")),
    ("quality_rate", holds("ty le loi lo hang")),
    (
        "strategy profitability operating_costs returns reviews inventory slow_inventory inventory_movements quality product_funnel",
        holds("30 ngay", "tao combo", "nguy co lo", "tuan nay"),
    ),
    ("combo_strategy", holds("tao combo")),
    ("risk_strategy", holds("nguy co lo")),
    ("weekly_strategy", holds("tuan nay")),
)


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def period(text: Column, year: int = 2026) -> Column:
    """YYYY-MM from "thang M [nam] YYYY"; the default year where none is given; null without a month from 1 to 12."""
    pattern = r"thang\s*(\d{1,2})(?:\s*(?:nam)?\s*(20\d{2}))?"
    month, given = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    return F.when(month.try_cast("int").between(1, 12), F.concat_ws("-", F.when(given != "", given).otherwise(F.lit(str(year))), F.lpad(month, 2, "0")))


def understood(questions: DataFrame) -> DataFrame:
    """questions (id, question) with form: folded letters and digits; after them, where it differs, the same with typing
    errors repaired; after these, the usual names of other phrasings."""
    spark = questions.sparkSession
    plain = squeeze(F.regexp_replace(fold(F.coalesce("question", F.lit(""))), "[^a-z0-9]+", " "))
    texts = questions.withColumn("form", plain)
    vocabulary = spark.createDataFrame([(w,) for w in TYPO_VOCABULARY], "word string")
    both = repaired_texts(texts, vocabulary, list(PROTECTED))
    both = both.withColumn("form", F.when(F.col("repaired") == F.col("form"), F.col("form")).otherwise(F.concat_ws(" ", "form", "repaired"))).drop("repaired")
    names = [F.when(any_of(F.col("form"), variants), F.lit(name)) for name, variants in ALIASES.items()]
    return both.withColumn("form", squeeze(F.concat_ws(" ", "form", *names)))


def plans(questions: DataFrame) -> DataFrame:
    """id, period, tools in order, intent, needs_shop_data, tags (sorted). questions: id (no two alike), question."""
    q = flagged(understood(questions.select("id", "question")), KINDS | {f"tag_{t}": test for t, test in TAGS.items()})
    starts = reduce(Column.__or__, ((F.col("form") == w) | F.col("form").startswith(w + " ") for w in CASUAL))
    casual = starts & ~F.col("signal")
    kept = F.array_compact(F.array(F.when(F.col("shop"), "shop_data"), F.when(F.col("policy"), "rag"), F.when(F.col("calculation"), "calculator")))
    none = F.array().cast("array<string>")
    tools = F.when(F.col("out") | casual, none).when(F.size(kept) == 0, F.array(F.lit("rag"))).otherwise(kept)
    shop, policy, calculation = F.col("shop"), F.col("policy"), F.col("calculation")
    intent = (
        F.when(F.col("out"), "out_of_scope").when(casual, "casual").when(~shop, "policy_rag").when(~policy & ~calculation, "shop_data")
        .when(policy & calculation, "multi_tool_policy_and_shop_analysis").when(policy, "multi_tool_policy_and_shop_retrieval").otherwise("shop_analysis")
    )
    when = F.when(~casual | F.col("out"), period(F.col("form")))
    tags = F.array_compact(F.array(*(F.when(F.col(f"tag_{t}"), t) for t in sorted(TAGS))))
    return q.select("id", when.alias("period"), tools.alias("tools"), intent.alias("intent"), (shop & ~F.col("out") & ~casual).alias("needs_shop_data"), tags.alias("tags"))
