"""Old sales sheets: header mapping, import into people / payments / enrolments, and the sheet profile."""
from pyspark.sql import Column, DataFrame, Window, functions as F

from patronage.functions import vocabulary as V
from patronage.functions.cells import classify_cells
from patronage.functions.courses import code_by_header
from patronage.functions.text import (age_of, amount_of, blank_to_null, date_of, e164, national_phone, number, plain_number,
                                      safe_session_label, sheet_year, squeeze, strip)
from patronage.sources.store import settle, spread

FIELDS = list(V.SHEET_FIELDS)


def field_of(header: Column) -> Column:
    """Canonical field of a header cell by prefix, null for a course column."""
    h = F.lower(squeeze(header))
    hits = [F.when(h.startswith(p), F.lit(f)) for f, prefixes in V.SHEET_FIELDS.items() for p in prefixes]
    return F.coalesce(*hits)


def extract_rows(grid: DataFrame) -> DataFrame:
    """Grid of cells (sheet, row_number from 1, cells array) to rows with ``fields`` and ``courses``.

    The header is the first of the top 8 rows that holds the marker word; a sheet without one yields nothing.
    """
    top = grid.where((F.col("row_number") <= 8) & F.exists("cells", lambda c: squeeze(c).contains(V.SHEET_MARKER)))
    heads = top.groupBy("sheet").agg(F.min(F.struct("row_number", "cells")).alias("h")).select(
        "sheet", F.col("h.row_number").alias("header_row"), F.transform("h.cells", squeeze).alias("header"))
    kinds = F.transform("header", field_of)
    heads = heads.withColumn("kinds", kinds).withColumn(
        "kinds", F.transform("kinds", lambda k, i: F.when(F.array_position("kinds", k) == i + 1, k)
                             .when(k.isNotNull(), "-").when(blank_to_null(F.get("header", i)).isNull(), "-")))
    # A sheet may hold most rows: its header is repeated for eight parts a shuffle partition, so that hashes deal it evenly.
    parts = 8 * int(grid.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heads = heads.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = grid.withColumn("_part", F.pmod(F.xxhash64("sheet", "row_number"), F.lit(parts)).cast("int"))
    body = dealt.join(heads, ["sheet", "_part"]).where(F.col("row_number") > F.col("header_row"))
    zipped = F.arrays_zip(F.col("header").alias("label"), F.col("kinds").alias("kind"), F.col("cells").alias("value"))
    filled = F.filter(zipped, lambda z: z["value"].isNotNull() & (z["value"] != "") & z["label"].isNotNull())
    pick = lambda keep: F.filter(filled, keep)
    return body.select(
        "sheet", "row_number",
        F.map_from_entries(F.transform(pick(lambda z: z["kind"].isNotNull() & (z["kind"] != "-")),
                                       lambda z: F.struct(z["kind"], z["value"]))).alias("fields"),
        F.transform(pick(lambda z: z["kind"].isNull()),
                    lambda z: F.struct(z["label"].alias("label"), z["value"].alias("value"))).alias("courses"))


def parse_rows(rows: DataFrame, *more: str) -> DataFrame:
    """Typed payment and contact columns plus the person key: phone, else e-mail, else the row itself; and columns ``more``.

    Built in steps so that each text is cleaned once per row and not once per use.
    """
    f = lambda name: F.element_at("fields", name)
    texts = {"_paid": "paidAt", "_slip": "slipNo", "_name": "fullNameTh", "_name_en": "fullNameEn", "_nickname": "nickname", "_social": "social",
             "_rep": "saleRep", "_email": "email"}
    df = spread(rows).select("sheet", "row_number", "courses", *more, *[squeeze(f(field)).alias(c) for c, field in texts.items()],
                             strip(F.regexp_replace(f("amount"), ",", "")).alias("_amount"), strip(f("age")).alias("_age"), strip(f("phone")).alias("_phone"))
    df = df.withColumns({c: blank_to_null(F.col(c)) for c in texts} | {c: plain_number(F.col(c)) for c in ("_amount", "_age")}
                        | {"_digits": F.regexp_replace("_phone", "[^0-9]", "")})
    df = df.withColumn("_phone", national_phone(F.col("_phone"), F.col("_digits")))
    df = df.withColumns({"phone": e164(F.col("_phone")), "email": F.lower("_email")})
    here = F.concat_ws(":", F.lit("row"), "sheet", F.col("row_number").cast("string"))
    return df.select(
        "sheet", "row_number", "courses", sheet_year(F.col("sheet")).alias("sheet_year"),
        date_of(F.col("_paid")).alias("paid_at"), amount_of(F.col("_amount")).alias("amount"), F.col("_slip").alias("slip_no"),
        F.col("_name").alias("display_name"), F.col("_name_en").alias("full_name_en"), F.col("_nickname").alias("nickname"),
        F.col("_social").alias("social_handle"), age_of(F.col("_age")).alias("age_at_import"), F.col("_rep").alias("sale_rep"),
        "phone", "email", F.coalesce("phone", "email", here).alias("person_key"), *more)


def _id(prefix: str, *parts) -> Column:
    return F.concat(F.lit(prefix), F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(26)))


def row_cells(parsed: DataFrame) -> DataFrame:
    """Non-empty course cells, one per row and column, classified; unknown headers keep a null code."""
    cells = parsed.select("sheet", "row_number", "sheet_year", "person_key", F.explode("courses").alias("c")).select(
        "sheet", "row_number", "sheet_year", "person_key", F.col("c.label").alias("label"), F.col("c.value").alias("value"))
    return classify_cells(cells).withColumn("course_code", code_by_header(F.col("label")))


def import_rows(rows: DataFrame) -> dict:
    """People, payments, enrolments, unknown headers and skipped rows of sheet rows.

    People come from one hash aggregation; ids are hashes of natural keys, so payments and
    enrolments find their person without a join.
    """
    parsed = settle(parse_rows(rows))
    cells = settle(row_cells(parsed))
    known = cells.where("course_code is not null")
    signal_rows = known.select("sheet", "row_number").distinct().withColumn("_cells", F.lit(True))
    has_money = F.col("paid_at").isNotNull() | F.col("amount").isNotNull() | F.col("slip_no").isNotNull()
    marked = parsed.join(signal_rows, ["sheet", "row_number"], "left").withColumn("_live", has_money | F.coalesce("_cells", F.lit(False)))
    live = marked.where("_live")

    payments = live.select(
        _id("lpy_", "sheet", F.col("row_number").cast("string")).alias("payment_id"), _id("lgp_", "person_key").alias("person_id"),
        "slip_no", "amount", "paid_at", F.col("sheet_year").alias("year"), "sale_rep", "sheet", "row_number")
    enrollments = known.select(
        _id("len_", "sheet", F.col("row_number").cast("string"), "label").alias("enrollment_id"),
        _id("lpy_", "sheet", F.col("row_number").cast("string")).alias("payment_id"), _id("lgp_", "person_key").alias("person_id"),
        "course_code", F.col("label").alias("course_label"), "kind", "counts_as_seat", "session_label", "session_start",
        "session_precision", "session_year", "ref_slip", "substitute", "raw", "sheet", "row_number")

    order = ["sheet", "row_number"]
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(*order, c)))[c].alias(c)
    seats = enrollments.where("counts_as_seat").groupBy("person_id").agg(
        F.count("*").alias("seat_count"), F.sort_array(F.collect_set("course_code")).alias("course_codes"))
    people = live.groupBy(_id("lgp_", "person_key").alias("person_id")).agg(
        *[first(c) for c in ("display_name", "full_name_en", "nickname", "phone", "email", "social_handle", "age_at_import")],
        F.min("paid_at").alias("first_paid_at"), F.max("paid_at").alias("last_paid_at"),
        F.sum(F.coalesce("amount", F.lit(0).cast("decimal(18,2)"))).alias("total_paid"), F.count("*").alias("payment_count"))
    people = people.join(seats, "person_id", "left").withColumns({
        "seat_count": F.coalesce("seat_count", F.lit(0)), "course_codes": F.coalesce("course_codes", F.array().cast("array<string>"))})
    return {"people": people, "payments": payments, "enrollments": enrollments, "skipped": marked.where("not _live").select(*order),
            "unknown_headers": cells.where("course_code is null").select("label").distinct()}


# ---- profile --------------------------------------------------------------------------------

def index_quantiles(df: DataFrame, group: str, value: str, width: float) -> DataFrame:
    """Exact order statistics per group at n/4, the middle and 3n/4 without sorting the table.

    Values are counted in buckets of ``width``; only buckets that hold a wanted position are looked into.
    """
    vals = df.where(F.col(value).isNotNull()).select(group, F.col(value).cast("double").alias("v")).withColumn(
        "b", F.floor(F.col("v") / width))
    counted = vals.groupBy(group, "b", "v").agg(F.count("*").alias("n"))
    per_bucket = counted.groupBy(group, "b").agg(F.sum("n").alias("bn"))
    run = Window.partitionBy(group).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = per_bucket.withColumns({"skip": F.coalesce(F.sum("bn").over(run), F.lit(0)),
                                      "total": F.sum("bn").over(Window.partitionBy(group))})
    n = F.col("total")
    wanted = buckets.select(group, "b", "bn", "skip", F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), pos.cast("long").alias("pos")) for name, pos in (
            ("p25", F.floor(n / 4)), ("mid_lo", F.floor((n - 1) / 2)), ("mid_hi", F.floor(n / 2)), ("p75", F.floor(n * 3 / 4)))])).alias("w"))
    wanted = wanted.where((F.col("w.pos") >= F.col("skip")) & (F.col("w.pos") < F.col("skip") + F.col("bn"))).select(
        group, "b", "skip", "w.name", "w.pos")
    inside = counted.join(wanted.select(group, "b").distinct(), [group, "b"], "left_semi")
    inside = inside.withColumn("upto", F.sum("n").over(
        Window.partitionBy(group, "b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    hit = inside.join(wanted, [group, "b"]).where(
        (F.col("pos") < F.col("skip") + F.col("upto")) & (F.col("pos") >= F.col("skip") + F.col("upto") - F.col("n")))
    q = hit.groupBy(group).agg(*[F.max(F.when(F.col("name") == x, F.col("v"))).alias(x) for x in ("p25", "mid_lo", "mid_hi", "p75")])
    stats = vals.groupBy(group).agg(F.min("v").alias("min"), F.max("v").alias("max"), F.round(F.avg("v"), 2).alias("mean"))
    return stats.join(q, group).select(group, "min", "p25", ((F.col("mid_lo") + F.col("mid_hi")) / 2).alias("median"), "p75", "max", "mean")


def amount_bucket(amount: Column) -> Column:
    edges = V.AMOUNT_EDGES
    out = F.when((amount >= edges[0]) & (amount < edges[1]), f"{edges[0]}-{edges[1]}")
    for lo, hi in zip(edges[1:], edges[2:]):
        out = out.when((amount >= lo) & (amount < hi), f"{lo}-{hi}")
    return out


def profiled(rows: DataFrame) -> DataFrame:
    """Typed rows a profile counts, only those with a name; parsed once and written, as several counts read them."""
    whole = F.floor(number(F.element_at("fields", "age")))
    typed = parse_rows(rows.withColumn("whole_age", F.when(whole.between(10, 90), whole)), "whole_age")
    return settle(typed.where("display_name is not null").withColumnRenamed("whole_age", "profile_age"))


def sheet_fill(p: DataFrame) -> DataFrame:
    """Rows, fill rates (4 places) and distinct phones per sheet in one pass."""
    rate = lambda c: F.round(F.count(c) / F.count("*"), 4).alias(f"fill_{c}")
    cols = ["full_name_en", "nickname", "social_handle", "email", "phone", "profile_age", "amount", "paid_at", "slip_no"]
    return p.groupBy("sheet").agg(F.count("*").alias("rows"), *[rate(c) for c in cols], F.count_distinct("phone").alias("distinct_phones"))


def sheet_histograms(p: DataFrame) -> DataFrame:
    """Long table (sheet, measure, bucket, n): amounts, months, courses per row, hits, sessions, reps, repeats, slips.

    One pass gives every row's buckets; only the two measures of reuse need a count per phone or slip first.
    """
    bucket = lambda measure, b, wanted: F.when(wanted, F.struct(F.lit(measure).alias("measure"), b.cast("string").alias("bucket")))
    cells = F.filter(F.transform("courses", lambda c: F.struct(c["label"].alias("label"), squeeze(c["value"]).alias("v"))), lambda c: c["v"] != "")
    of_cells = lambda measure, b: F.transform("cells", lambda c: F.struct(F.lit(measure).alias("measure"), b(c).alias("bucket")))
    own = F.array(
        bucket("amount", amount_bucket(F.col("amount")), F.col("amount").isNotNull()), bucket("month", F.month("paid_at"), F.col("paid_at").isNotNull()),
        bucket("courses_per_row", F.size("cells"), F.lit(True)), bucket("sale_rep", F.col("sale_rep"), F.col("sale_rep").isNotNull()))
    label = lambda c: F.concat(c["label"], F.lit(" / "), F.coalesce(safe_session_label(c["v"]), F.lit("")))
    rows = p.select("sheet", "amount", "paid_at", "sale_rep", cells.alias("cells")).select(
        "sheet", F.explode_outer(F.concat(own, of_cells("course_hits", lambda c: c["label"]), of_cells("course_sessions", label))).alias("b")).where("b IS NOT NULL")
    out = rows.groupBy("sheet", "b.measure", "b.bucket").agg(F.count("*").alias("n"))
    for key, measure in (("phone", "repeat_by_phone"), ("slip_no", "slip_reuse")):
        uses = p.where(F.col(key).isNotNull()).groupBy("sheet", key).agg(F.count("*").alias("uses"))
        out = out.unionByName(uses.groupBy("sheet", F.lit(measure).alias("measure"), F.col("uses").cast("string").alias("bucket")).agg(F.count("*").alias("n")))
    return out
