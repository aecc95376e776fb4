"""Rules that answer a question without retrieval, in their order. Phrases are in match form (folded letters)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import gibberish, match_form
from .router import Test, equals, flag, flagged, holds, holds_all, like, routed, topic

# The phrases of every rule.
API_CONTEXT = ("shopee", "merchant api", "shop api", "public api", "open platform", "base_string", "base string", "signature")
PROGRAMMING = (
    "viet code", "code python", "lap trinh python", "quan ly sinh vien", "quan ly nhan vien", "tao website", "lam website", "lam web", "xay dung website", "website ban quan ao",
    "web ban quan ao", "huong dan toi lam website", "huong dan lam website", "viet chuong trinh", "chuong trinh java",
)
WEATHER_WHEN = ("hom nay", "ngay mai", "du bao")
OUT_OF_SCOPE = (
    "gia bitcoin", "bitcoin hom nay", "gia vang hom nay", "du bao gia vang", "gia vang ngay mai", "ty gia hom nay", "gia co phieu", "chung khoan hom nay", "du bao thi truong tai chinh",
    "manchester united", "lich thi dau bong da", "ty so bong da", "hom nay da voi ai", "doi nao da hom nay", "ket qua bong da",
    "du bao thoi tiet", "thoi tiet hom nay", "thoi tiet ngay mai", "nhiet do hom nay", "nhiet do ngay mai",
    "viet cho toi mot bai tho", "viet bai tho", "bai tho tinh", "viet truyen", "ke chuyen", "sang tac bai hat",
)
INVENTORY = (
    "san pham nao dang co nguy co het hang", "san pham nao sap het hang", "san pham sap het hang", "nguy co het hang", "sap het hang", "canh bao ton kho", "ton kho hien tai", "so luong ton",
    "sku sap het", "hang nao sap het",
)
THREE_APIS = ("public api", "shop api", "merchant api")
FULL_GUIDE = (
    "tong hop toan bo", "tong hop day du", "giai thich toan bo", "trinh bay toan bo", "loi thuong gap", "vi du chi tiet cho tung loai", "cach tao base_string", "cach tao base string",
)
SIGNATURE = ("signature", "chu ky")
CODE_EXAMPLE = ("viet vi du", "cho vi du", "vi du python", "viet code", "doan code", "ma nguon", "tao signature")
VIETNAMESE_ONLY = ("tieng viet hoan toan", "hoan toan bang tieng viet", "khong dung tu tieng anh", "chi dung tieng viet")
COMPARE_DETAIL = ("khac nhau", "so sanh", "giai thich chi tiet", "cau truc base_string", "base_string cua tung loai")
ALGORITHM = ("thuat toan nao", "thuat toan gi", "tao bang thuat toan", "tao bang gi", "duoc tinh bang gi")
VERIFICATION = (
    "merchant api khong can merchant_id", "merchant api khong can merchant id", "merchant_id khong can", "merchant id khong can", "shop api dung merchant_id", "shop api dung merchant id",
    "signature dung md5", "signature tao bang md5", "chu ky dung md5", "chu ky tao bang md5",
)
AUTHENTICATION = ("xac thuc", "authentication")
COMPONENTS = ("thanh phan", "tham so", "gom nhung gi", "gom gi", "bao gom", "can nhung gi", "can gi", "components", "parameters")
OVERVIEW = (
    "merchant api gom nhung gi", "merchant api gom gi", "merchant api bao gom nhung gi", "merchant api bao gom gi", "merchant api co nhung gi", "merchant api la gi",
    "merchant api gom nhung thanh phan nao", "merchant api co nhung thanh phan nao", "merchant api gom cac thanh phan nao", "merchant api co cac thanh phan nao",
)
ORDER_REASON = ("tai sao phai dung thu tu", "tai sao phai dung dung thu tu", "vi sao phai dung thu tu", "tai sao phai sap xep dung thu tu", "thu tu do de lam gi")
API_TOPICS = ("merchant_api", "shop_api", "public_api", "api_comparison")
RETURNS = ("tra hang", "hoan tien")
NO_RESPONSE = ("nguoi ban khong phan hoi", "neu nguoi ban khong phan hoi", "khong phan hoi yeu cau tra hang")
EXAMPLE = ("cho vi du", "vi du", "cho mot vi du", "lay vi du", "vi du cu the", "cho vi du cu the")
SUMMARY = ("tom tat lai", "tom tat", "tong hop lai", "rut gon lai", "tom luoc lai")
FEE_EXAMPLE = ("cho vi du tinh phi", "cho vi du voi gia san pham", "vi du voi gia san pham", "tinh phi voi gia san pham")
BASE_STRING_TYPOS = (
    "base strng", "base strig", "base sting", "base sring", "base strin", "base strinh", "basestring", "base-string", "base  string", "base_strng", "base_strig",
)
BASE_STRING = (
    "base_string", "base string", "ghep chuoi", "noi chuoi", "ghep base string", "noi base string", "build string", "build base string", "build base_string", "xay dung base string",
    "xay dung chuoi", "tao chuoi ky", "tao chuoi", "chuoi merchant api",
)
BASE_STRING_DETAIL = (
    "gom nhung tham so nao", "gom tham so nao", "gom nhung gi", "gom gi", "gom j", "co nhung gi", "base string gom", "base_string gom", "theo thu tu nao", "tao base_string", "tao base string",
    "ghep chuoi", "noi chuoi", "ghep base string", "noi base string", "ghep base", "build string", "build base string", "build base_string", "xay dung", "tao chuoi ky", "tao chuoi",
    "chuoi merchant api", "nhu the nao", "nhu nao", "the nao", "ra sao",
)
FLOW = ("luong", "quy trinh", "cac buoc", "tao nhu the nao")
NO_BANK_DISCOUNT = ("neu khong co khuyen mai ngan hang", "khong co khuyen mai ngan hang thi sao", "bo khuyen mai ngan hang")
SHOP_MERCHANT_DETAIL = ("giai thich chi tiet", "kem vi du", "khac nhau nhu the nao")
CAPABILITY = (
    "toi co the hoi them gi", "toi co the hoi gi", "ban co the giup gi", "ban ho tro nhung gi", "ngoai dieu tren", "ngoai nhung dieu tren", "toi co the hoi ban dieu gi",
    "co the hoi them gi khong", "toi nen hoi gi",
)
DATA_NEEDED = (
    "toi phai cung cap cho ban thong tin gi", "toi can cung cap thong tin gi", "can cung cap gi de ban tong hop", "toi phai gui du lieu gi", "toi can gui file gi", "ban can toi cung cap gi",
    "de ban lam tong hop thong tin cho toi",
)
CONFIRMATION = (
    "thong tin nay chuan khong", "thong tin nay dung khong", "co chinh xac khong", "co tin duoc khong", "toi co tin duoc khong", "vay toi co tin duoc khong", "cau tra loi nay dung khong",
    "ban chac khong", "co chac khong",
)
TRANSACTION_EXAMPLE = ("cho mot vi du tinh thu", "vi du tinh thu", "cho vi du tinh", "tinh thu voi gia tri gia dinh")
EASIER = ("giai thich de hieu hon", "noi de hieu hon", "giai thich don gian hon")
TWO_LINES = ("tom tat trong 2 dong", "tom tat 2 dong", "tom tat lai trong 2 dong", "tom tat trong hai dong")
THREE_LINES = ("tom tat trong 3 dong", "tom tat 3 dong", "tom tat lai trong 3 dong", "tom tat trong ba dong")
PRIVATE_METRIC = (
    "doanh thu shop", "doanh thu cua shop", "doanh thu thang nay", "loi nhuan shop", "loi nhuan cua shop", "loi nhuan thang nay", "chi phi shop", "don hang cua shop", "top 5 san pham ban chay",
    "san pham ban chay nhat", "mat hang ban chay nhat", "roas cua shop", "quang cao cua shop",
)
OWNERSHIP = ("shop toi", "cua shop toi", "cua shop", "shop cua toi", "cong ty toi", "cua cong ty toi", "doanh nghiep toi", "cua doanh nghiep toi", "cua toi")
METRIC = (
    "doanh thu", "thu nhap", "loi nhuan", "chi phi", "don hang", "ton kho", "quang cao", "roas", "ban chay", "top 5 san pham", "sap het hang", "nguy co het hang", "so luong ton", "sku",
    "thang nay", "quy nay",
)

_merchant = holds("merchant api")
_base_string = (
    _merchant & ~(holds("tong hop toan bo") | holds_all("shop api", "public api") | holds("loi thuong gap"))
    & holds(*BASE_STRING, view="alias") & holds(*BASE_STRING_DETAIL, view="alias")
)
_components = _merchant & ~_base_string & holds(*AUTHENTICATION) & holds(*COMPONENTS)

RULES: list[tuple[str, Test]] = [
    ("gibberish", flag("gibberish")),
    ("out_of_scope", (holds(*PROGRAMMING) & ~holds(*API_CONTEXT)) | (holds("thoi tiet") & holds(*WEATHER_WHEN)) | holds(*OUT_OF_SCOPE)),
    ("inventory", holds(*INVENTORY) & ~(holds("het han") & ~holds("het hang"))),
    ("full_api_guide", holds_all(*THREE_APIS) & holds(*FULL_GUIDE)),
    ("merchant_python_example", _merchant & holds(*SIGNATURE) & holds("python") & holds(*CODE_EXAMPLE)),
    ("vietnamese_only", _merchant & holds(*VIETNAMESE_ONLY)),
    ("three_api_comparison", holds_all(*THREE_APIS) & holds(*COMPARE_DETAIL)),
    ("signature_algorithm", holds(*SIGNATURE) & holds(*ALGORITHM)),
    ("api_verification", holds(*VERIFICATION)),
    ("merchant_auth_components", _components),
    ("merchant_overview", _merchant & ~_base_string & ~_components & holds(*OVERVIEW)),
    ("order_reason", holds(*ORDER_REASON) & topic(*API_TOPICS)),
    ("no_seller_response", holds(*RETURNS) & holds(*NO_RESPONSE)),
    ("generic_example", equals(*EXAMPLE)),
    ("generic_summary", equals(*SUMMARY)),
    ("fixed_fee_example", holds(*FEE_EXAMPLE) & topic("fixed_fee")),
    ("merchant_base_string", _base_string),
    ("signature_flow", holds("signature") & holds(*FLOW)),
    ("no_bank_discount", holds(*NO_BANK_DISCOUNT)),
    ("fee_calculation", holds("phi xu ly") & like("[0-9]", view="question")),
    ("public_api", holds("public api")),
    ("shop_merchant_detail", holds_all("shop api", "merchant api") & holds(*SHOP_MERCHANT_DETAIL)),
    ("capability", holds(*CAPABILITY)),
    ("data_requirement", holds(*DATA_NEEDED)),
    ("confirmation", holds(*CONFIRMATION)),
    ("transaction_fee_example", holds(*TRANSACTION_EXAMPLE) & topic("transaction_fee")),
    ("easy_explanation", holds(*EASIER)),
    ("two_line_summary", holds(*TWO_LINES)),
    ("three_line_summary", holds(*THREE_LINES)),
    ("private_business", holds(*PRIVATE_METRIC) | (holds(*OWNERSHIP) & holds(*METRIC))),
]


def prepared(questions: DataFrame) -> DataFrame:
    """questions (question; topic so far, or null) with what the rules look at."""
    q = questions.withColumn("form", match_form(F.col("question")))
    alias = F.col("form")
    for typo in BASE_STRING_TYPOS:
        alias = F.replace(alias, F.lit(typo), F.lit("base string"))
    return q.withColumns({"alias": alias, "gibberish": gibberish(F.col("question"))})


def quick_routes(questions: DataFrame) -> DataFrame:
    """questions with route: the first rule that answers without retrieval, or "retrieval"."""
    return routed(prepared(questions), RULES, "retrieval").drop("form", "alias", "gibberish")


# Phrases that are on the subject, and some that aren't; what asks for files, for the last source, for detail.
ON_SUBJECT = (
    "shopee", "shop", "nguoi ban", "nguoi mua", "phi", "tra hang", "hoan tien", "api", "base_string", "partner key", "gmv", "thuong mai dien tu", "bao ve du lieu", "nguoi tieu dung", "don hang",
    "doanh thu", "ton kho", "quang cao", "san pham", "van chuyen",
)
OFF_SUBJECT = ("bitcoin", "btc", "ethereum", "thoi tiet", "bong da", "world cup", "gia vang", "chung khoan", "ty gia", "lich thi dau", "du bao thoi tiet")
DATA_FILES = ("toi can cung cap file gi", "can cung cap file gi", "gui file gi", "can du lieu gi", "can cung cap du lieu gi", "toi can gui gi")
LAST_SOURCE = ("nguon vua roi", "tai lieu vua roi", "lay dung nhom tai lieu", "ket qua vua roi lay tu dau")
DETAIL = (
    "chi tiet", "cu the", "giai thich", "vi sao", "tai sao", "phan tich", "so sanh", "vi du", "lam the nao", "cach tinh", "tung buoc", "dieu kien", "neu ro", "ky hon", "the nao", "kiem tra",
    "cai thien", "truoc khi",
)
GREETINGS = ("hi", "hello", "xin chao", "chao", "chao ban", "alo", "hey")
AGREED = ("ok", "oke", "okay", "duoc", "duoc roi", "roi", "tiep", "tiep di", "hieu roi")
ABLE = ("ban co the giup gi", "ban co the giup gi cho toi", "ban giup duoc gi", "ban lam duoc gi", "toi co the hoi gi")
WHO = ("ban la ai", "ban la tro ly gi")
SMALLTALK: list[tuple[str, Test]] = [
    ("greeting", flag("greets")), ("thanks", like("^cam on")), ("agreed", flag("agrees")), ("able", flag("asks_able") | holds_all("ban", "giup", "gi")), ("who", flag("asks_who")),
]
#: Fixed: topics whose answer names its own figures.
FOCUSED = (
    "product_gmv", "product_contribution", "sales_comparison", "price_promotions", "ads_sku_daily", "inventory_batches", "slow_inventory", "product_funnel", "reviews", "returns", "quality",
    "cash_flow", "suppliers", "customer_retention", "strategy", "price_strategy", "restock_strategy", "ad_strategy", "search_performance", "shipping_performance", "settlements",
    "competitor_catalog",
)


def manner(questions: DataFrame) -> DataFrame:
    """questions (question) with off_subject (words on the subject win), asks_files, asks_source, wants_detail, and smalltalk:
    the kind of a polite phrase, or null."""
    form = F.col("form")
    q = questions.withColumn("form", match_form(F.col("question")))
    q = q.withColumns({"greets": form.isin(*GREETINGS), "agrees": form.isin(*AGREED), "asks_able": form.isin(*ABLE), "asks_who": form.isin(*WHO)})
    tests = {"off_subject": holds(*OFF_SUBJECT) & ~holds(*ON_SUBJECT), "asks_files": holds(*DATA_FILES), "asks_source": holds(*LAST_SOURCE), "wants_detail": holds(*DETAIL)}
    return routed(flagged(q, tests), SMALLTALK).withColumnRenamed("route", "smalltalk").drop("form", "greets", "agrees", "asks_able", "asks_who")


def shows_totals(tags: Column) -> Column:
    """Whether an answer on these tags leaves room for general figures below it."""
    return ~F.arrays_overlap(tags, F.array(*map(F.lit, FOCUSED)))
