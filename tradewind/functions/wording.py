"""Wording: excerpts, snippets, hints, cleaned answers, language and secret tests, amounts, and what a file name tells."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_text, match_form, squeeze

# Lines of menus that are shown to nobody; where a shown text may be cut, and from where on.
MENU_LINES = (
    "Trang Chủ", "Khóa học", "Sự kiện", "Blog", "Chuyên mục", "Chủ đề", "Tìm kiếm", "Bạn có hài lòng với bài viết này?", "Hài lòng", "Không hài lòng", "Bài viết liên quan",
    "Gửi yêu cầu hỗ trợ", "Shopee Policy", "Service Requirement", "Privacy Policy", "Shopee Policies",
)
SHOWN, EXCERPT, SNIPPET, FROM = 1200, 480, 360, 0.55
# How questions are made noisy, step by step.
NOISE = {
    "chinh sach": "chin sach", "thuong mai dien tu": "tmdt", "hoan tien": "hoan tien", "nguoi ban": "ng ban", "giao dich": "giao dich", "du lieu": "du lieu", "quang cao": "qc",
    "signature": "signatre", "base_string": "base strng",
}
# Words that tell a language, and letters that only one has.
ENGLISH = (
    "the", "is", "are", "was", "were", "this", "that", "with", "from", "for", "and", "or", "not", "source", "according", "current", "provided", "within", "used", "merchant", "seller",
)
VIETNAMESE = ("là", "của", "và", "được", "trong", "theo", "người", "doanh", "nghiệp", "phải", "không", "nguồn", "tài", "liệu", "thời", "hạn")
VIETNAMESE_LETTERS = "ăâđêôơưáàảãạấầẩẫậắằẳẵặéèẻẽẹếềểễệíìỉĩịóòỏõọốồổỗộớờởỡợúùủũụứừửữựýỳỷỹỵ"
# How lines begin that repeat a prompt; a secret's names and form; groups written in English.
LEAKED = ("mở đầu tự nhiên", "nguồn chính là", "yêu cầu trả lời", "trả lời trực tiếp bằng tiếng việt", "chỉ dùng thông tin trong ngữ cảnh", "không dùng nhãn nguồn")
SECRET = r"""(?i)\b(partner[_\s-]?key|access[_\s-]?token|secret[_\s-]?key)\b\s*[:=]\s*["']?([a-z0-9_\-./+=]{16,})"""
ENGLISH_GROUPS = ("sea_shopee_reports", "shopee_api")
# What a fee is worked out from, by its names, and its rate.
FEE_PARTS = {
    "product_price": (r"giá\s*sản\s*phẩm", r"gia\s*san\s*pham"), "shipping_fee": (r"phí\s*vận\s*chuyển", r"phi\s*van\s*chuyen"),
    "seller_discount": (r"khuyến\s*mãi\s*người\s*bán", r"khuyen\s*mai\s*nguoi\s*ban"), "bank_discount": (r"khuyến\s*mãi\s*ngân\s*hàng", r"khuyen\s*mai\s*ngan\s*hang"),
}
FEE_PERCENT = 6


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _right_trimmed(text: Column, characters: str = r"\s") -> Column:
    return F.regexp_replace(text, f"[{characters}]+$", "")


def last_of(text: Column, mark: str) -> Column:
    """Where a mark begins last, counted from 0; -1 if nowhere."""
    back = F.instr(F.reverse(text), mark[::-1])
    return F.when(back > 0, F.length(text) - back - len(mark) + 1).otherwise(-1)


def shown(text: Column, most: int = SHOWN) -> Column:
    """A text as it is shown: without menu lines and bare addresses, cut at the end of a sentence or line past 55 %."""
    lines = F.transform(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", "")))
    kept = F.filter(lines, lambda x: ~x.isin(*MENU_LINES) & ~x.startswith("http://") & ~x.startswith("https://"))
    whole = F.regexp_replace(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")

    def cut(part: Column) -> Column:
        at = F.greatest(*(last_of(part, m) for m in (". ", "\n", "; ")))
        return F.concat(_right_trimmed(F.when(at > most * FROM, F.substring(part, F.lit(1), at + 1)).otherwise(part)), F.lit("..."))

    return _let(whole, lambda w: F.when(F.length(w) <= most, w).otherwise(_let(F.left(w, F.lit(most)), cut)))


def excerpt(text: Column, most: int = EXCERPT) -> Column:
    """The first characters of a text in one line, with dots if there are more."""
    return _let(squeeze(F.coalesce(text, F.lit(""))), lambda t: F.concat(_right_trimmed(F.left(t, F.lit(most))), F.when(F.length(t) > most, "...").otherwise("")))


#: A table cell is cut as an excerpt is.
def cell(text: Column, most: int = 180) -> Column:
    return excerpt(text, most)


def snippet(text: Column, most: int = SNIPPET) -> Column:
    """The first characters of a cleaned text, cut at a mark or space past 55 %, with dots if there are more."""

    def cut(part: Column) -> Column:
        at = F.greatest(*(last_of(part, m) for m in (". ", "; ", ": ", " ")))
        return F.concat(_right_trimmed(F.when(at > most * FROM, F.substring(part, F.lit(1), at)).otherwise(part), " .,;:"), F.lit("..."))

    return _let(clean_text(F.coalesce(text, F.lit(""))), lambda t: F.when(F.length(t) <= most, t).otherwise(_let(F.left(t, F.lit(most)), cut)))


def hint(text: Column) -> Column:
    """The first eight words of four characters or more that aren't numbers."""
    words = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^0-9A-Za-zÀ-ỹ_/%.-]+", " "), " ")
    long_ones = F.filter(words, lambda w: (F.length(w) >= 4) & ~w.rlike("^[0-9]+$"))
    return F.when(F.size(long_ones) == 0, "đoạn này").otherwise(F.array_join(F.slice(long_ones, 1, 8), " "))


def noisy(text: Column) -> Column:
    """A match form with usual slips and short forms."""
    return reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), NOISE.items(), match_form(text))


def _count(text: Column, words: tuple[str, ...]) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\b(?:" + "|".join(words) + r")\b"))


def mostly_english(text: Column) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    return _let(F.struct(_count(t, ENGLISH).alias("e"), _count(t, VIETNAMESE).alias("v")), lambda c: (c["e"] >= 5) & (c["e"] > c["v"] * 1.5))


def strongly_english(text: Column) -> Column:
    """Mostly English by its words, or twenty words of plain letters with hardly a Vietnamese letter."""
    t = F.coalesce(text, F.lit(""))
    marks = F.regexp_count(F.lower(t), F.lit(f"[{VIETNAMESE_LETTERS}]"))
    return mostly_english(text) | ((F.regexp_count(t, F.lit("[A-Za-z]+")) >= 20) & (marks < 3))


def holds_secret(text: Column) -> Column:
    return F.coalesce(text.rlike(SECRET), F.lit(False))


def without_leaks(text: Column) -> Column:
    """An answer without lines that repeat its prompt. The prompt's lines are compared as they are written, against match
    forms, so only those without accents can be found."""
    lines = F.split(F.coalesce(text, F.lit("")), "\r\n|\r|\n")
    kept = F.filter(lines, lambda x: ~_let(match_form(x), lambda f: reduce(Column.__or__, (f.startswith(p) for p in LEAKED))))
    return F.regexp_replace(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def amount(text: Column, labels: tuple[str, ...]) -> Column:
    """The number within 30 characters after one of the labels, thousands marked or not; the first label that has one."""
    t = F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" "))
    found = [F.nullif(F.regexp_replace(F.regexp_extract(t, rf"(?iu){label}.{{0,30}}?(\d{{1,3}}(?:[.\s,]\d{{3}})+|\d+)", 1), r"[^0-9]", ""), F.lit("")) for label in labels]
    return F.coalesce(*found).try_cast("long")


def fee(text: Column) -> Column:
    """base, fee of a question that names a product's price: price and shipping less discounts, and 6 % of it (halves to the
    even number); null without a price. Numbers of more than 18 digits are none."""
    parts = {name: amount(text, labels) for name, labels in FEE_PARTS.items()}
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).cast("decimal(19,0)")
    base = zero(parts["product_price"]) + zero(parts["shipping_fee"]) - zero(parts["seller_discount"]) - zero(parts["bank_discount"])
    of = lambda b: F.struct(b.cast("decimal(20,0)").alias("base"), F.bround(b.cast("decimal(20,0)") * F.lit(FEE_PERCENT) / F.lit(100), 0).cast("decimal(20,0)").alias("fee"))
    return F.when(parts["product_price"].isNotNull(), _let(base, of))


def vnd(value: Column) -> Column:
    """1.234.567 VND"""
    return F.concat(F.replace(F.format_number(value, 0), F.lit(","), F.lit(".")), F.lit(" VND"))


def stem(path: Column) -> Column:
    """A file's name without folders and its last extension."""
    return F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def file_id(path: Column, group: Column, sha256: Column) -> Column:
    """aaa_bbb_001_... as AAA_BBB_001; other names by their group and digest."""
    name = F.regexp_extract(stem(path), "^([a-zA-Z]+_[a-zA-Z]+_[0-9]{3}[a-zA-Z]?)(?:_|$)", 1)
    return F.upper(F.when(name != "", name).otherwise(F.concat_ws("_", group, F.left(sha256, F.lit(10)))))


def file_title(path: Column) -> Column:
    """What comes after such an id, or the whole name, as words with a capital."""
    parts = F.split(stem(path), "_")
    named = (F.size(parts) >= 4) & F.coalesce(F.get(parts, F.lit(2)).rlike("^[0-9]{3}[a-zA-Z]?$"), F.lit(False))
    title = squeeze(F.array_join(F.when(named, F.slice(parts, F.lit(4), F.greatest(F.size(parts), F.lit(1)))).otherwise(parts), " "))
    return F.when(title == "", stem(path)).otherwise(F.concat(F.upper(F.left(title, F.lit(1))), F.substring(title, F.lit(2), F.length(title))))


def file_year(path: Column) -> Column:
    """The last year from 2000 to 2099 in a file's name, or nothing."""
    return F.coalesce(F.try_element_at(F.regexp_extract_all(stem(path), F.lit("(?<![0-9])(20[0-9]{2})(?![0-9])"), F.lit(1)), F.lit(-1)), F.lit(""))


def group_language(group: Column) -> Column:
    return F.when(group.isin(*ENGLISH_GROUPS), "en").otherwise("vi")


def parsed_list(text: Column, mark: str = ",") -> Column:
    """Parts between marks, trimmed, without blanks."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), mark), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def lenient_boolean(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin("1", "true", "yes"), F.lit(False))


def lenient_number(text: Column) -> Column:
    return F.coalesce(F.trim(text).try_cast("double"), F.lit(0.0))


# What a question asks for, the first kind that applies; and what a text must hold to answer it.
KINDS = {
    "duration": ("bao lau", "thoi han"), "number": ("bao nhieu", "muc phi", "ty le", "gmv"), "formula": ("tinh nhu the nao", "cong thuc", "base_string", "chu ky"),
    "list": ("nhung san pham nao", "danh sach", "bi cam"), "obligation": ("trach nhiem", "nghia vu", "bao ve"),
}
ANSWERS = {
    "duration": (r"(?iu)(?<![\p{L}\p{N}_])\d+\s*(ngày|giờ|tháng|năm)(?![\p{L}\p{N}_])", ("trong vong", "thoi han", "moc thoi gian")), "number": (r"\d", ()),
    "formula": ("=", ("base_string", "partner_id", "api_path", "cach tinh", "cong thuc", "phi xu ly giao dich", "muc phi")),
    "list": ("(?!)", ("danh sach", "bi cam", "khong duoc phep", "4.1", "4.2", "4.3")),
}
DEADLINE = (r"người\s*bán.{0,140}phản\s*hồi.{0,80}\d+\s*(ngày|giờ)", r"phản\s*hồi.{0,80}\d+\s*(ngày|giờ).{0,140}người\s*bán", r"trong\s*vòng\s*\d+\s*(ngày|giờ).{0,120}phản\s*hồi")


def _any(form: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, (F.contains(form, F.lit(p)) for p in phrases), F.lit(False))


def question_kind(question: Column) -> Column:
    """What a question asks for: a duration, number, formula, list or obligation, else something general."""
    return _let(match_form(question), lambda f: reduce(lambda chain, kind: chain.when(_any(f, KINDS[kind]), kind), KINDS, F).otherwise("general"))


def answers(kind: Column, context: Column) -> Column:
    """Whether a text can answer a question of that kind; an empty one answers none."""
    raw = F.coalesce(context, F.lit(""))
    found = _let(match_form(raw), lambda f: reduce(lambda chain, k: chain.when(kind == k, raw.rlike(ANSWERS[k][0]) | _any(f, ANSWERS[k][1])), ANSWERS, F).otherwise(True))
    return (raw != "") & found


def names_deadline(context: Column) -> Column:
    """Whether a text says within how many days or hours a seller must reply."""
    return reduce(Column.__or__, (F.coalesce(context, F.lit("")).rlike(f"(?isu){p}") for p in DEADLINE))
