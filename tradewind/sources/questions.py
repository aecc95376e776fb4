"""Seller questions for the rules of planning and routing, made of the turns of `conversations`: each turn's text gets an
opening and a subject by its number, so that every rule meets questions it fires on and others it doesn't."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPENINGS = (
    "", "Shop tôi:", "Tháng 8 năm 2025", "Xin chào", "Cho ví dụ", "Tóm tắt lại", "So sánh", "Nó dùng để làm gì", "Lấy ở đâu", "Theo chính sách", "Tính", "tháng 12", "Giải thích chi tiết",
    "GMV là gì", "vì sao", "Còn", "viết code python", "haha", "Tóm tắt trong 2 dòng",
)
SUBJECTS = (
    "doanh thu shop bao nhiêu?", "Merchant API gồm những tham số nào trong base strng", "Shop API và Public API khác nhau thế nào so với merchant api", "signature tạo bằng thuật toán nào",
    "quagn cáo theo sku nên tăng ngân sách", "tồn kho sắp hết hàng", "thời tiết hôm nay", "phí xử lý 5%", "trả hàng hoàn tiền nếu người bán không phản hồi", "merchant api là gì",
    "merchant api xác thực cần gì", "lý do hủy dơn", "đối soat tiền shopee phải trả", "lợi nhuận cua shop tháng 5", "đánh giá xấu xử lý thế nào", "lượt xem cao ít thêm giỏ", "dòng tiền thiếu tiền",
    "nhà cung cấp giao hàng đúng hẹn thấp nhất", "bạn có thể giúp gì", "có chính xác không", "tại sao phải đúng thứ tự", "quy trình tạo signature", "hợp đồng giao dịch điện tử", "",
    "viết chương trình shopee", "12345", "nhập bao nhiêu hàng", "khách quay lại", "loi nhuann thag này", "tuổi tồn lô hàng", "từ khóa tìm kiếm", "giá đối thủ", "asdf",
)
TOPICS = (None, "merchant_api", "fixed_fee", "transaction_fee", "public_api")


def _at(values: tuple, place: Column) -> Column:
    return F.get(F.array(*(F.lit(v) for v in values)), place.cast("int"))


def questions(conversations: DataFrame) -> DataFrame:
    """id, conv_id, turn, role, question, topic. Every third question is an opening and a subject alone."""
    n = F.col("conv_id") * 31 + F.col("turn") * 7
    text = F.concat_ws(" ", F.nullif(_at(OPENINGS, n % len(OPENINGS)), F.lit("")), F.nullif(_at(SUBJECTS, n % len(SUBJECTS)), F.lit("")), F.when(n % 3 != 0, F.col("text")))
    return conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", "turn", "role", text.alias("question"), _at(TOPICS, n % len(TOPICS)).alias("topic"))


def _list(values: tuple) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


#: The same in SQL, as a table expression named qs.
QUESTIONS_SQL = f"""qs AS (SELECT conv_id * 1000 + turn AS id, conv_id, turn, role,
    concat_ws(' ', nullif({_list(OPENINGS)}[n % {len(OPENINGS)} + 1], ''), nullif({_list(SUBJECTS)}[n % {len(SUBJECTS)} + 1], ''), CASE WHEN n % 3 <> 0 THEN text END) AS question,
    {_list(TOPICS)}[n % {len(TOPICS)} + 1] AS topic FROM (SELECT *, conv_id * 31 + turn * 7 AS n FROM conversations))"""
