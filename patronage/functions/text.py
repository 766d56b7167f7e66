"""Contact, name, mask, redaction and hashtag columns."""
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType

from . import vocabulary as V

# Java's \s is ASCII only; the source rules also count the Unicode spaces below.
WS = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
NOT_BEFORE = "(?<![A-Za-z0-9_])"  # ASCII word boundaries, independent of the JVM version
NOT_AFTER = "(?![A-Za-z0-9_])"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{WS}]+|[{WS}]+$", "")


def squeeze(c: Column) -> Column:
    """Collapse every run of spaces to one and trim."""
    return F.trim(F.regexp_replace(c, f"[{WS}]+", " "))


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def replace_first(c: Column, pattern: str, replacement: str = "") -> Column:
    return F.regexp_replace(c, f"(?s)^(.*?){pattern}", "$1" + replacement)


def number(c: Column) -> Column:
    """Text to double, null for anything that is not a plain decimal number."""
    return plain_number(strip(c))


def plain_number(t: Column) -> Column:
    """``number`` of a text without white space around it."""
    return F.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), t.try_cast("double"))


def normalize_phone(c: Column) -> Column:
    """Thai numbers to E.164; anything else becomes null."""
    raw = strip(c)
    return e164(national_phone(raw, F.regexp_replace(raw, "[^0-9]", "")))


def national_phone(raw: Column, digits: Column) -> Column:
    """The digits behind the country code or the leading zero."""
    n = F.length(digits)
    return (
        F.when(raw.startswith("+"), F.when(digits.startswith("66"), F.right(digits, n - 2)))
        .when(digits.startswith("0"), F.right(digits, n - 1))
        .when(digits.startswith("66") & (n == 11), F.right(digits, n - 2))
        .when(n == 9, digits)
    )


def e164(national: Column) -> Column:
    return F.when(national.rlike("^[2-9][0-9]{7,8}$"), F.concat(F.lit("+66"), national))


def local_phone(c: Column) -> Column:
    return F.when(c.startswith("+66"), F.concat(F.lit("0"), F.right(c, F.length(c) - 3))).otherwise(c)


def normalize_email(c: Column) -> Column:
    v = F.lower(strip(c))
    ok = (F.length(v) <= 254) & v.rlike(rf"^[^{WS}@,;]+@[^{WS}@,;]+\.[a-z]{{2,}}$")
    return F.when(ok, v)


def _unicode_form(form: str):
    @F.pandas_udf(StringType())
    def apply(s: pd.Series) -> pd.Series:
        return s.map(lambda v: unicodedata.normalize(form, v), na_action="ignore")

    return apply


def unicode_form(c: Column, form: str) -> Column:
    """NFC or NFKC. Only non-ASCII values travel to Python; Spark has no built-in for this."""
    return F.coalesce(_unicode_form(form)(F.when(c.rlike(r"[^\x00-\x7f]"), c)), c)


def normalize_name(c: Column, composed: bool = False) -> Column:
    """Collapse spaces and strip the first matching title. ``composed=True`` skips the NFC step."""
    v = squeeze(c if composed else unicode_form(c, "NFC"))
    # the first title in the list that leaves a name wins; alternatives are tried in that order
    titles = "|".join(re.escape(x) for x in V.NAME_TITLES)
    out = F.regexp_replace(v, rf"(?iu)^(?:{titles}) *(?=[^ ].)", "")
    return F.when(F.length(out) >= 2, out)


def birth_year_be(c: Column, current_year: int) -> Column:
    n = number(c.cast("string"))
    n = F.when(n == F.floor(n), n)
    be = F.when((n < 2400) & (n > 1900), n + 543).otherwise(n)
    return F.when(be.between(2450, current_year + 543 - 5), be.cast("int"))


def age_from_be(c: Column, current_year: int) -> Column:
    return F.lit(current_year + 543) - c


def age_band(age: Column) -> Column:
    start = (F.floor(age / 10) * 10).cast("int")
    return F.when(
        age.between(10, 119) & (age == F.floor(age)),
        F.concat(start.cast("string"), F.lit("-"), (start + 9).cast("string")),
    )


def mask_phone(c: Column) -> Column:
    d = F.regexp_replace(local_phone(c), "[^0-9]", "")
    masked = F.when(F.length(d) < 6, F.lit("xxx")).otherwise(
        F.concat(F.substring(d, 1, 2), F.lit("x-xxx-"), F.right(d, F.lit(4))))
    return F.when(c.isNull() | (c == ""), F.lit("")).otherwise(masked)


def mask_email(c: Column) -> Column:
    hit = F.regexp_extract(c, r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}", 0)
    local = F.substring_index(hit, "@", 1)
    domain = F.right(hit, F.length(hit) - F.length(local))
    keep = F.when(F.length(local) <= 2, 1).otherwise(2)
    masked = F.when(hit == "", F.lit("***")).otherwise(
        F.concat(F.substring(local, F.lit(1), keep), F.lit("***"), domain))
    return F.when(c.isNull() | (c == ""), F.lit("")).otherwise(masked)


def last4(c: Column) -> Column:
    return blank_to_null(F.regexp_extract(c, r"([0-9]{4})$", 1))


def email_domain(c: Column) -> Column:
    return F.when(c.contains("@"), F.lower(F.substring_index(c, "@", -1)))


# --- Fixed values: redaction patterns, applied in this order ---
LOG_PATTERNS = [
    (rf"\+?66[-{WS}]?[0-9]{{1,2}}[-{WS}]?[0-9]{{3}}[-{WS}]?[0-9]{{4}}{NOT_AFTER}", "[PHONE]"),
    (rf"{NOT_BEFORE}0[0-9]{{1,2}}[-{WS}]?[0-9]{{3}}[-{WS}]?[0-9]{{4}}{NOT_AFTER}", "[PHONE]"),
    (rf"(?i)(?:(?<=[A-Za-z0-9_])(?=[^A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))[^{WS}@,;]+@[^{WS}@,;]+\.[a-z]{{2,}}{NOT_AFTER}", "[EMAIL]"),
    (rf"{NOT_BEFORE}eyJ[A-Za-z0-9_-]{{10,}}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "[JWT]"),
    (rf"{NOT_BEFORE}[0-9][-{WS}]?[0-9]{{4}}[-{WS}]?[0-9]{{5}}[-{WS}]?[0-9]{{2}}[-{WS}]?[0-9]{NOT_AFTER}", "[NATIONAL_ID]"),
]
SECRET_KEY = r"(?i)(secret|token|password|pepper|_key$|^key$|Enc$)"


def redact_text(c: Column) -> Column:
    for pattern, mark in LOG_PATTERNS:
        c = F.regexp_replace(c, pattern, mark)
    return c


def redact_map(c: Column) -> Column:
    """Redact a map column: values of secret-named keys are dropped, the rest is cleaned."""
    return F.transform_values(
        c, lambda k, v: F.when(k.rlike(SECRET_KEY), F.lit("[REDACTED]")).otherwise(redact_text(v)))


def safe_session_label(label: Column) -> Column:
    rest = label
    for word in V.SAFE_LABEL_WORDS:
        rest = F.replace(rest, F.lit(word), F.lit(""))
    kept = F.when(rest.rlike("[฀-๿]"), F.lit(V.OTHER_TEXT)).otherwise(label)
    return F.when(strip(label) != "", kept)


def name_words(c: Column, composed: bool = False) -> Column:
    """Lower-case letter or digit runs of at least two characters."""
    words = F.regexp_extract_all(F.lower(normalize_name(c, composed)), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return F.filter(words, lambda w: F.length(w) >= 2)


# ---- hashtags -------------------------------------------------------------------------------

def hashtag_key(c: Column, composed: bool = False) -> Column:
    v = strip(c if composed else unicode_form(c, "NFKC"))
    v = F.regexp_replace(v, "^#+", "")
    return F.lower(F.regexp_replace(v, f"[{WS}_-]+", ""))


def _alias_codes() -> dict:
    return {a.replace("_", "").lower(): code for code, names in V.HASHTAG_COURSES.items() for a in names}


def _literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


@F.pandas_udf(ArrayType(StringType()))
def _nfkc_list(s: pd.Series) -> pd.Series:
    return s.map(lambda tags: [unicodedata.normalize("NFKC", t) for t in tags], na_action="ignore")


def hashtags_in(message: Column, include_marks: bool = False) -> Column:
    """All ``#word`` runs as written."""
    word = r"[\p{L}\p{N}\p{M}_]+" if include_marks else r"[\p{L}\p{N}_]+"
    return F.coalesce(F.regexp_extract_all(message, F.lit(f"(#{word})"), F.lit(1)), F.array().cast("array<string>"))


def hashtag_keys(tags: Column) -> Column:
    """Normal forms of tags; only lists with non-ASCII letters travel to Python for the Unicode fold."""
    foreign = F.exists(tags, lambda t: t.rlike(r"[^\x00-\x7f]"))
    folded = F.coalesce(_nfkc_list(F.when(foreign, tags)), tags)
    return F.transform(folded, lambda t: hashtag_key(t, composed=True))


def read_hashtags(df: DataFrame, message: str = "message", include_marks: bool = False) -> DataFrame:
    """Add hashtags (first spelling per normal form), course_code, unknown_hashtags, ambiguous, unmapped."""
    df = df.withColumn("_tags", hashtags_in(F.col(message), include_marks))
    df = df.withColumn("_keys", hashtag_keys(F.col("_tags")))
    pairs = F.filter(
        F.transform("_keys", lambda k, i: F.struct(
            F.get("_tags", i).alias("tag"), k.alias("key"), (F.array_position("_keys", k) == i + 1).alias("first"))),
        lambda z: z["first"] & (z["key"] != ""))
    df = df.withColumn("_pairs", pairs)
    codes = _literal_map(_alias_codes())
    code_of = lambda z: F.element_at(codes, z["key"])
    df = df.withColumns({
        "hashtags": F.transform("_pairs", lambda z: z["tag"]),
        "_known": F.array_distinct(F.filter(F.transform("_pairs", code_of), lambda x: x.isNotNull())),
        "unknown_hashtags": F.transform(F.filter("_pairs", lambda z: code_of(z).isNull()), lambda z: z["tag"])})
    return df.withColumns({
        "course_code": F.when(F.size("_known") == 1, F.get("_known", F.lit(0))), "ambiguous": F.size("_known") > 1,
        "unmapped": (F.size("unknown_hashtags") > 0) | (F.size("_known") != 1)}).drop("_tags", "_keys", "_pairs", "_known")


# ---- sheet values ---------------------------------------------------------------------------

def sheet_text(c: Column) -> Column:
    return blank_to_null(squeeze(c))


def sheet_amount(c: Column) -> Column:
    return amount_of(number(F.regexp_replace(c, ",", "")))


def amount_of(n: Column) -> Column:
    return F.when(n > 0, n.cast("decimal(18,2)"))


def sheet_age(c: Column) -> Column:
    return age_of(number(c))


def age_of(n: Column) -> Column:
    return F.when((n == F.floor(n)) & (n > 0) & (n < 120), n.cast("int"))


def sheet_date(c: Column) -> Column:
    """ISO date or timestamp text, or a serial day count from 1899-12-30."""
    return date_of(sheet_text(c))


def date_of(s: Column) -> Column:
    """``sheet_date`` of a text without needless blanks."""
    serial = F.when(s.rlike(r"^[0-9]{4,6}(\.[0-9]+)?$") & ~s.rlike(r"^[0-9]{4}$"), s.try_cast("double"))
    from_serial = F.date_add(F.lit("1899-12-30").cast("date"), F.floor(serial).cast("int"))
    return F.coalesce(from_serial, s.try_cast("date"), s.try_cast("timestamp").cast("date"))


def sheet_year(c: Column) -> Column:
    return F.regexp_extract(c, r"(20[0-9]{2})", 1).try_cast("int")


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(strip(c)).isin(V.CONSENT_YES), F.lit(False))


def confidence_label(c: Column) -> Column:
    pct = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)) * 10000 + 0.5) / 100
    return F.concat(F.regexp_replace(pct.cast("string"), r"\.0$", ""), F.lit("%"))


def column_letter(index0: Column) -> Column:
    """Spreadsheet letters for any zero-based index: digits of base 26 that have no zero."""
    start = F.struct(index0.cast("long").alias("left"), F.lit("").alias("out"))
    # 14 letters number more columns than a long can
    step = lambda acc, _: F.when(acc["left"] < 0, acc).otherwise(F.struct(
        (F.floor(acc["left"] / 26) - 1).cast("long").alias("left"), F.concat(F.char(acc["left"] % 26 + 65), acc["out"]).alias("out")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step, lambda acc: acc["out"])
