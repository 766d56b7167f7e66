"""Single rules on small tables."""
import datetime as dt
import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from patronage.functions import dates as D, hashing as H, text as T
from patronage.functions.cells import classify_cells
from patronage.functions.courses import code_by_header
from patronage.operators.events import redact_workflow


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in df.select("i", expr(F.col("v")).alias("o")).orderBy("i").collect()]


def test_phone_spellings(spark):
    same = ["0812345678", "081-234-5678", "081 234 5678", "+66812345678", "66812345678", "812345678", "+66 81 234 5678", "(081) 2345678", " 0812345678 "]
    assert column(spark, same, T.normalize_phone) == ["+66812345678"] * len(same)
    assert column(spark, ["021234567", "+1 415 555 0100", "", "abc", "12345", None], T.normalize_phone) == ["+6621234567", None, None, None, None, None]


def test_email_and_masks(spark):
    assert column(spark, [" A@B.co ", "a b@c.com", "a@b", "x" * 250 + "@b.co", None], T.normalize_email) == ["a@b.co", None, None, None, None]
    assert column(spark, ["+66812345678", "+6621234567", "12345", None], T.mask_phone) == ["08x-xxx-5678", "02x-xxx-4567", "xxx", ""]
    assert column(spark, ["somchai@mail.com", "ab@mail.com", "nope", None], T.mask_email) == ["so***@mail.com", "a***@mail.com", "***", ""]


def test_names(spark):
    got = column(spark, ["นาย  สมชาย ใจดี", "Mr. John Doe", "Drake", "นาย ก", "x", " ", "Café Noir"], T.normalize_name)
    assert got == ["สมชาย ใจดี", "John Doe", "ake", "นาย ก", None, None, "Café Noir"]


def test_name_words_split_at_thai_vowel_marks(spark):
    assert column(spark, ["ใจดี"], lambda c: F.concat_ws("|", T.name_words(c))) == ["ใจด"]


def test_birth_year(spark):
    assert column(spark, ["1992", "2535", "2449", "2565", "19.5", "x"], lambda c: T.birth_year_be(c, 2026)) == [2535, 2535, None, None, None, None]
    assert column(spark, [9, 10, 47, 119, 120], T.age_band, "int") == [None, "10-19", "40-49", "110-119", None]


@pytest.mark.parametrize("key", ["pepper", "k" * 80])
def test_keyed_hash_equals_the_standard(spark, key):
    values = ["PHONE|+66812345678", "นาย", ""]
    want = [hmac.new(key.encode(), v.encode(), hashlib.sha256).hexdigest() for v in values]
    assert column(spark, values, lambda c: H.hmac_sha256(c, key)) == want


def test_log_redaction(spark):
    got = column(spark, ["call 081-234-5678 now", "+66 81 234 5678", "mail a.b@c.com!", "id 1-1234-12345-12-1", "order 20240101", "é@x.com"], T.redact_text)
    assert got == ["call [PHONE] now", "[PHONE]", "mail [EMAIL]!", "id [NATIONAL_ID]", "order 20240101", "é@x.com"]
    assert column(spark, ["Bearer abc.def x"], redact_workflow) == ["Bearer [REDACTED] x"]


def test_safe_labels(spark):
    assert column(spark, ["27-28 Jun", "เลื่อน 27-28 Jun", "สมชาย", " ", None], T.safe_session_label) == ["27-28 Jun", "เลื่อน 27-28 Jun", "«ข้อความอื่น»", None, None]


def test_sheet_values(spark):
    assert column(spark, ["1,234.5", "0", "-3", "x"], lambda c: T.sheet_amount(c).cast("string")) == ["1234.50", None, None, None]
    assert column(spark, ["2025-03-04", "45720", "soon", None], T.sheet_date) == [dt.date(2025, 3, 4), dt.date(2025, 3, 4), None, None]
    assert column(spark, [0, 25, 26, 701], T.column_letter, "int") == ["A", "Z", "AA", "ZZ"]
    assert column(spark, [0.873, 1.0, 0.0, 2.0, 0.12345], T.confidence_label, "double") == ["87.3%", "100%", "0%", "100%", "12.35%"]


def test_hashtags(spark):
    df = spark.createDataFrame([(1, "go #Inner #INNER #inner_makeover"), (2, "#TTRT #Commu"), (3, "#promo"), (4, None), (5, "#ｄｅｅｐｉｎ")], "i int, message string")
    rows = {r.i: r for r in T.read_hashtags(df).collect()}
    assert rows[1].hashtags == ["#Inner", "#inner_makeover"] and rows[1].course_code == "INNER" and not rows[1].unmapped
    assert rows[2].ambiguous and rows[2].course_code is None and rows[2].unmapped
    assert rows[3].unknown_hashtags == ["#promo"] and rows[3].unmapped
    assert rows[4].hashtags == [] and rows[4].unmapped
    assert rows[5].course_code == "DEEPIN"


def test_bangkok_periods(spark):
    at = [dt.datetime(2026, 7, 31, 17, 30), dt.datetime(2026, 8, 2, 16, 59)]
    month = column(spark, at, lambda c: D.period_key(D.local_date(c), "month"), "timestamp")
    week = column(spark, at, lambda c: D.period_key(D.local_date(c), "week"), "timestamp")
    assert month == ["2026-08", "2026-08"] and week == ["2026-07-27", "2026-07-27"]
    assert D.previous_range("1997-01-01", "1997-12-31") == (dt.date(1996, 1, 2), dt.date(1996, 12, 31))
    assert D.day_range("2026-01-01", "2026-01-31", compat=True)[0] == dt.date(2025, 12, 31)


CELLS = [
    ("27-28 Jun", "enrolled", "2025-06-27", True), ("31 May - 1 Jun", "enrolled", "2025-05-31", True), ("28 Feb-1 Mar", "enrolled", "2025-02-28", True),
    ("30,31 Jan-1 Feb", "enrolled", "2025-01-30", True), ("17-18 Jan 26", "enrolled", "2026-01-17", True), ("Oct", "enrolled", "2025-10-01", True),
    ("27-28 Jun D-1", "enrolled", "2025-06-27", True), ("RL 30-31 Aug", "relearn", "2025-08-30", False), ("Free 17-18 Jan", "free", "2025-01-17", False),
    ("Free RL 15-16 Nov", "free", "2025-11-15", False), ("RL Free 15-16 Nov", "free", "2025-11-15", False), ("Wait", "waitlist", None, False),
    ("คืนเงิน", "refund", None, False), ("หนังสือ RL", "merchandise", None, False), ("RL หนังสือ", "merchandise", None, False), ("ค่าปรับ 6980", "penalty", None, False),
    ("เพิ่ม IN-6806-00164", "adjustment", None, False), ("8-9 Mar ย้ายเรียน IN", "transfer", "2025-03-08", False), ("2026.0", "unknown", None, False),
    ("13-14 Jun คุณสมชาย ใจดี เรียนแทน", "enrolled", "2025-06-13", True), ("31 Feb", "enrolled", "2025-03-03", True), ("Up Pack 3", "adjustment", None, False),
    ("Jan 23", "enrolled", "2025-01-23", True), ("ตัดสิทธิ", "adjustment", None, False),
]


def test_course_cells(spark):
    df = spark.createDataFrame([(i, c[0], 2025) for i, c in enumerate(CELLS)] + [(99, "   ", 2025)], "i int, value string, sheet_year int")
    rows = {r.i: r for r in classify_cells(df).collect()}
    assert 99 not in rows
    for i, (text, kind, start, seat) in enumerate(CELLS):
        r = rows[i]
        assert (r.kind, str(r.session_start) if r.session_start else None, r.counts_as_seat) == (kind, start, seat), text
    assert rows[5].session_precision == "month" and rows[4].session_year == 2026
    assert rows[16].ref_slip == "IN-6806-00164"
    assert rows[19].substitute and rows[19].session_label == "13-14 Jun" and "สมชาย" in rows[19].raw


def test_course_headers(spark):
    got = column(spark, ["Inner", " DEEP  IN ", "อื่น ๆ", "MC Pro#5"], code_by_header)
    assert got == ["INNER", "DEEPIN", "OTHER", None]
