"""Course-cell interpretation as staged columns over a table of cells."""
from pyspark.sql import Column, DataFrame, functions as F

from . import vocabulary as V
from .courses import counts_as_seat
from .text import NOT_AFTER, NOT_BEFORE, blank_to_null, number, replace_first, squeeze

SLIP = f"(?i){NOT_BEFORE}(IN-[0-9]{{4}}-[0-9]{{5}}){NOT_AFTER}"


def _is_month(token: Column) -> Column:
    return F.lower(F.left(token, F.lit(3))).isin(V.MONTHS)


def _whole(token: Column) -> Column:
    n = number(token)
    return F.when(n == F.floor(n), n)


def add_session(df: DataFrame, label: str, sheet_year: str) -> DataFrame:
    """Add ``_label``, ``_year``, ``_start`` and ``_precision``: the first day named by a session text.

    Built in steps so each token list is computed once per row and not once per use.
    """
    c = F.col
    df = df.withColumn("_label", squeeze(c(label)))
    df = df.withColumn("_tokens", F.filter(F.split(F.regexp_replace("_label", "[,\\-–—]", " "), " +"), lambda t: t != ""))
    df = df.withColumn("_months", F.transform("_tokens", _is_month))
    df = df.withColumns({
        "_first": F.array_position("_months", True).cast("int"),
        "_last": (F.size("_months") - F.array_position(F.reverse("_months"), True) + 1).cast("int")})
    df = df.withColumns({
        "_before": F.slice("_tokens", F.lit(1), F.greatest(c("_first") - 1, F.lit(0))),
        "_tail": F.slice("_tokens", c("_last") + 1, F.size("_tokens")),
        "_month": F.lower(F.left(F.get("_tokens", c("_first") - 1), F.lit(3)))})
    df = df.withColumns({
        "_lead": F.get(F.filter(F.transform("_before", _whole), lambda n: n.between(1, 31)), F.lit(0)),
        "_next": F.get(F.filter(F.transform("_tail", _whole), lambda n: n.isNotNull()), F.lit(0)),
        "_short": F.get(F.filter("_tail", lambda t: t.rlike("^[0-9]{2}$")), F.lit(0)).try_cast("int")})
    day = F.coalesce("_lead", F.when(c("_next").between(1, 31), c("_next")))
    year = F.when(c("_lead").isNotNull(), F.coalesce(c("_short") + 2000, c(sheet_year))).otherwise(c(sheet_year))
    df = df.withColumns({"_day": day, "_year0": year})
    month = F.array_position(F.array(*[F.lit(m) for m in V.MONTHS]), c("_month")).cast("int")
    start = F.date_add(F.make_date(c("_year0"), month, F.lit(1)), (F.coalesce("_day", F.lit(1.0)) - 1).cast("int"))
    found = c("_first") > 0
    return df.withColumns({
        "_year": F.when(found, c("_year0")), "_start": F.when(found, start),
        "_precision": F.when(found & c("_day").isNotNull(), "day").when(found, "month").otherwise("none")})


def classify_cells(df: DataFrame, value: str = "value", sheet_year: str = "sheet_year") -> DataFrame:
    """Add kind, session columns, ref_slip, substitute and counts_as_seat to a table of cells.

    Empty cells are dropped: a blank cell means the course was not taken.
    """
    raw = squeeze(F.coalesce(F.col(value).cast("string"), F.lit("")))
    df = df.withColumn("raw", raw).where(F.col("raw") != "")
    raw = F.col("raw")
    slip = blank_to_null(F.upper(F.regexp_extract(raw, SLIP, 1)))
    goods = raw.rlike(V.CELL_GOODS_START)
    early = (
        F.when(raw.contains(V.CELL_REFUND), "refund")
        .when(raw.contains(V.CELL_PENALTY), "penalty")
        .when(raw.contains(V.CELL_CUT) | raw.rlike(V.CELL_ADJUST_START), "adjustment")
        .when(raw.rlike(V.CELL_CHANGE_START) | raw.rlike(f"(?i)^up pack{NOT_AFTER}"), "adjustment")
        .when(slip.isNotNull() & ~raw.rlike("[0-9]{1,2} *[-–]"), "adjustment")
        .when(raw.rlike(V.CELL_TRANSFER_START), "transfer")
        .when((F.lower(raw) == "wait") | F.lower(raw).startswith("wait "), "waitlist")
        .when(goods, "merchandise")
    )
    df = df.withColumn("ref_slip", slip).withColumn("_early", early)

    # Right prefixes: any order of "RL" and "Free"; Free wins because it says there is no revenue.
    rl, free = f"(?i)^rl{NOT_AFTER} *", f"(?i)^free{NOT_AFTER} *"
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, rl, ""), free, ""), rl, "")
    after_rl = F.regexp_replace(raw, rl, "")
    prefix = F.when(after_rl.rlike(free), "free").when(raw.rlike(rl), "relearn").otherwise("enrolled")
    df = df.withColumn("_prefix", prefix).withColumn("_rest", F.trim(rest))

    rest = F.col("_rest")
    substitute = rest.contains(V.CELL_SUBSTITUTE)
    text = F.when(substitute, F.trim(F.regexp_replace(rest, V.CELL_PERSON_TAIL, ""))).otherwise(rest)
    text = F.trim(replace_first(text, f"(?i:{NOT_BEFORE}D-[0-9]{NOT_AFTER})"))
    df = df.withColumn("_sub", substitute).withColumn("_text", text)

    moved = F.col("_text").contains(V.CELL_MOVED)
    label = F.when(moved, F.trim(F.regexp_replace(F.col("_text"), V.CELL_MOVED + ".*$", ""))).otherwise(F.col("_text"))
    df = add_session(df.withColumns({"_moved": moved, "_session": label}), "_session", sheet_year)

    early = F.col("_early")
    df = df.withColumn("_done", early.isNotNull() | F.col("_rest").rlike(V.CELL_GOODS_START))
    kind = (
        F.when(early.isNotNull(), early)
        .when(F.col("_done"), "merchandise")
        .when(F.col("_moved"), "transfer")
        .when((F.col("_precision") == "none") & (F.col("_prefix") == "enrolled"), "unknown")
        .otherwise(F.col("_prefix"))
    )
    kept = [c for c in df.columns if not c.startswith("_")]
    df = df.withColumn("kind", kind)
    session = lambda c: F.when(~F.col("_done"), F.col(c))
    return df.select(
        *kept, "kind", blank_to_null(session("_label")).alias("session_label"), session("_year").alias("session_year"),
        session("_start").alias("session_start"), F.coalesce(session("_precision"), F.lit("none")).alias("session_precision"),
        F.coalesce(session("_sub"), F.lit(False)).alias("substitute"), counts_as_seat(F.col("kind")).alias("counts_as_seat"))
