"""Sheet-shaped reports, customer profiles and review queues."""
from pyspark.sql import Column, DataFrame, functions as F

from patronage.functions import vocabulary as V
from patronage.functions.courses import clean_code, course_name, literal_map
from patronage.functions.text import confidence_label
from patronage.operators.numbering import numbered as number_rows

SECTION = {"summary": 0, "header": 1, "row": 2}


def sales_report(t, start: str | None = None, end: str | None = None) -> DataFrame:
    """One row per buying customer. Bills, lines and old history are reduced apart, then joined."""
    bills = t.purchases.where("status = 'active' and customer_id is not null")
    if start:
        bills = bills.where(F.col("paid_at") >= F.lit(start).cast("date"))
    if end:
        bills = bills.where(F.col("paid_at") <= F.lit(end).cast("date"))
    paid = bills.groupBy("customer_id").agg(
        F.sum(F.coalesce("amount", F.lit(0).cast("decimal(18,2)"))).alias("new_purchase_total"),
        F.max(F.coalesce(F.col("paid_at").cast("timestamp"), "created_at")).alias("last_activity"))
    lines = t.purchase_items.join(bills.select("purchase_id", "customer_id"), "purchase_id").groupBy("customer_id").agg(
        F.count_if("counts_as_seat").alias("new_seat_count"),
        F.sort_array(F.collect_set(F.when(clean_code(F.col("course_code")) != "", clean_code(F.col("course_code"))))).alias("courses"))
    links = t.customer_links.where("status = 'confirmed'").select("customer_id", "legacy_person_id").distinct()
    old = t.legacy_payments.groupBy(F.col("person_id").alias("legacy_person_id")).agg(
        F.sum(F.coalesce("amount", F.lit(0).cast("decimal(18,2)"))).alias("paid"), F.max("paid_at").alias("last"))
    legacy = links.join(old, "legacy_person_id", "left").groupBy("customer_id").agg(
        F.sum("paid").alias("legacy_total_paid"), F.max("last").alias("legacy_last_paid"))
    who = t.customers.select("customer_id", F.coalesce("display_name", "line_display_name", "nickname").alias("name"), "customer_status")
    return (who.join(paid, "customer_id").join(lines, "customer_id", "left").join(legacy.withColumn("_link", F.lit(True)), "customer_id", "left")
            .select("customer_id", "name", F.when(F.col("_link"), "returning").otherwise("new").alias("kind"), "customer_status",
                    "last_activity", "new_purchase_total", F.coalesce("new_seat_count", F.lit(0)).alias("new_seat_count"),
                    F.coalesce("courses", F.array().cast("array<string>")).alias("courses"), "legacy_total_paid", "legacy_last_paid"))


def sales_summary(report: DataFrame) -> DataFrame:
    return report.agg(
        F.count("*").alias("total_customers"), F.count_if(F.col("kind") == "new").alias("new_count"),
        F.count_if(F.col("kind") == "returning").alias("returning_count"),
        F.coalesce(F.sum("new_purchase_total"), F.lit(0).cast("decimal(18,2)")).alias("revenue"),
        F.coalesce(F.sum("new_seat_count"), F.lit(0)).alias("seat_count"))


def _cells(*cells) -> list:
    return [(c if isinstance(c, Column) else F.lit(c)).cast("string").alias(f"c{i + 1}") for i, c in enumerate(cells)]


def _header(df: DataFrame, headers: list) -> DataFrame:
    return df.sparkSession.range(1).select(F.lit(SECTION["header"]).alias("section"), *_cells(*headers))


def _plain(c: Column) -> Column:
    """A decimal without trailing zeros, as a sheet shows it."""
    text = c.cast("string")
    return F.when(text.contains("."), F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")).otherwise(text)


def sales_sheet(report: DataFrame) -> DataFrame:
    """Summary, header and data rows as text cells; ``section`` and the sort columns carry the order."""
    s = sales_summary(report)
    summary = s.select(F.lit(0).alias("section"), *_cells(
        "สรุป", F.format_string("ลูกค้ารวม %d คน", "total_customers"), F.format_string("🆕 ใหม่ %d คน", "new_count"),
        F.format_string("🔁 กลับมาซื้อ %d คน", "returning_count"),
        F.concat(F.lit("ยอดใหม่ "), _plain(F.col("revenue")), F.lit(" บาท")), F.format_string("ที่นั่ง %d", "seat_count")))
    rows = report.select(
        F.lit(2).alias("section"), *_cells(
            F.coalesce("name", F.lit("")), F.when(F.col("kind") == "returning", V.KIND_RETURNING_LABEL).otherwise(V.KIND_NEW_LABEL),
            F.concat_ws(", ", "courses"), _plain(F.col("new_purchase_total")), F.coalesce(_plain(F.col("legacy_total_paid")), F.lit("")),
            F.date_format("last_activity", "yyyy-MM-dd")), F.col("last_activity").alias("sort_at"), F.col("customer_id").alias("sort_id"))
    return (rows.unionByName(summary, allowMissingColumns=True).unionByName(_header(report, V.SALES_HEADERS), allowMissingColumns=True)
            .orderBy("section", F.desc("sort_at"), "sort_id"))


def intent_sheet(current: DataFrame, customers: DataFrame) -> DataFrame:
    """Displayable opinions with labels; ``current`` comes from ``intents.displayable``."""
    who = customers.select("customer_id", F.when(F.col("status") == "erased", "").otherwise(
        F.coalesce("display_name", "line_display_name", "nickname", F.lit(""))).alias("who"))
    rows = current.join(who, "customer_id", "left")
    return rows.select(
        F.lit(2).alias("section"), *_cells(
            F.coalesce("who", F.lit("")), F.coalesce("course_code", F.lit("")),
            F.element_at(literal_map(V.INTENT_STATUS_LABELS), F.col("status")),
            F.coalesce(F.element_at(literal_map(V.INTENT_REASON_LABELS), F.col("hesitation_reason")), F.lit("")),
            confidence_label(F.col("confidence")),
            F.when(F.col("source") == "staff", V.SOURCE_STAFF_LABEL).otherwise("AI"), F.date_format("observed_at", "yyyy-MM-dd")),
        F.col("observed_at").alias("sort_at"), F.col("intent_id").alias("sort_id")).orderBy(F.desc("sort_at"), "sort_id")


def intent_summary(current: DataFrame) -> DataFrame:
    return current.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("interested", "hesitant", "not_interested")])


# ---- customer profiles ----------------------------------------------------------------------

def customer_purchases(t) -> DataFrame:
    """Every purchase of every customer, new and (over confirmed links) old, with its course lines nested."""
    line = F.struct("course_code", course_name(F.col("course_code")).alias("course_name"), "kind", "counts_as_seat", "session_label")
    nest = lambda df, key: df.groupBy(key).agg(F.array_sort(F.collect_list(line)).alias("courses"))
    new = t.purchases.where("status = 'active' and customer_id is not null").join(nest(t.purchase_items, "purchase_id"), "purchase_id", "left")
    links = t.customer_links.where("status = 'confirmed'").select("customer_id", F.col("legacy_person_id").alias("person_id")).distinct()
    old = t.legacy_payments.join(links, "person_id").join(nest(t.legacy_enrollments, "payment_id"), "payment_id", "left")
    cols = ["paid_at", "amount", "sale_rep", F.coalesce("courses", F.array().cast(
        "array<struct<course_code:string,course_name:string,kind:string,counts_as_seat:boolean,session_label:string>>")).alias("courses")]
    return new.select("customer_id", F.lit("partner").alias("source"), F.col("purchase_id").alias("payment_id"), *cols).unionByName(
        old.select("customer_id", F.lit("legacy").alias("source"), "payment_id", *cols))


def customer_profiles(t) -> DataFrame:
    """Totals for every customer. Line counts come from nested arrays, so money is never repeated."""
    p = customer_purchases(t)
    seat = F.size(F.filter("courses", lambda c: c["counts_as_seat"]))
    totals = p.groupBy("customer_id").agg(
        F.sum(F.coalesce("amount", F.lit(0).cast("decimal(18,2)"))).alias("total_paid"), F.count("*").alias("payment_count"),
        F.sum(seat).alias("seat_count"), F.min("paid_at").alias("first_paid_at"), F.max("paid_at").alias("last_paid_at"))
    codes = p.select("customer_id", F.explode("courses.course_code").alias("code")).groupBy("customer_id").agg(
        F.sort_array(F.collect_set("code")).alias("course_codes"))
    links = t.customer_links.groupBy("customer_id").agg(
        F.count_distinct(F.when(F.col("status") == "confirmed", F.col("legacy_person_id"))).alias("linked_people"),
        F.max(F.col("status").isin("auto", "needs_review")).alias("unconfirmed"))
    erased = F.col("status") == "erased"
    shown = lambda c: F.when(~erased, c)
    joined = (t.customers.join(totals, "customer_id", "left").join(codes, "customer_id", "left").join(links, "customer_id", "left"))
    return joined.select(
        "customer_id", shown(F.coalesce("display_name", "line_display_name")).alias("display_name"), shown(F.col("phone")).alias("phone"),
        shown(F.col("email")).alias("email"), shown(F.col("heard_from")).alias("heard_from"), "customer_status", "status",
        F.coalesce("total_paid", F.lit(0).cast("decimal(18,2)")).alias("total_paid"), F.coalesce("payment_count", F.lit(0)).alias("payment_count"),
        F.coalesce("seat_count", F.lit(0)).alias("seat_count"), "first_paid_at", "last_paid_at",
        F.coalesce("course_codes", F.array().cast("array<string>")).alias("course_codes"),
        F.coalesce("linked_people", F.lit(0)).alias("linked_people"), F.coalesce("unconfirmed", F.lit(False)).alias("has_unconfirmed_links"))


# ---- customer sheet -------------------------------------------------------------------------

def customer_sheet(customers: DataFrame, current_year: int) -> DataFrame:
    """The 21 system columns as text, in sheet order; the staff column is never produced."""
    col = lambda n: F.col(n) if n in customers.columns else F.lit(None).cast("string")
    text = lambda n: F.coalesce(col(n).cast("string"), F.lit(""))
    day = lambda n: F.coalesce(F.date_format(col(n).cast("timestamp"), "yyyy-MM-dd"), F.lit(""))
    age = F.coalesce((F.lit(current_year + 543) - F.col("birth_year")).cast("string"), F.lit(""))
    granted = F.when(F.col("consent_data"), F.concat(F.lit("✓ "), day("consent_granted_at"))).otherwise("✗")
    values = {
        "customerId": text("customer_id"), "title": text("title"), "fullNameTh": text("display_name"), "nickname": text("nickname"),
        "fullNameEn": text("full_name_en"), "birthYear": text("birth_year"), "age": age, "phone": text("phone"), "email": text("email"),
        "lineDisplayName": text("line_display_name"), "facebook": text("facebook"), "instagram": text("instagram"),
        "heardFrom": text("heard_from"), "tags": F.concat_ws(", ", "tags") if "tags" in customers.columns else F.lit(""),
        "firstInteractionAt": day("first_interaction_at"), "firstMessageAt": day("first_message_at"),
        "formSubmittedAt": day("form_submitted_at"), "consent": granted,
        "consentMarketing": F.when(F.col("consent_marketing"), "✓").otherwise("✗"), "pendingMerge": text("pending_merge"),
        "updatedAt": F.coalesce(F.date_format(F.col("updated_at"), "yyyy-MM-dd HH:mm"), F.lit(""))}
    return customers.select(*[values[name].alias(name) for name, _ in V.SHEET_COLUMNS])


def sheet_write_plan(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """Row number per key: known keys keep theirs, new ones follow the last row by (day, key).

    Rows are numbered by ranges, so neither a busy day nor the whole table is ordered by one task.
    """
    placed = rows.select("customer_id", F.to_date("updated_at").alias("_day")).join(existing, "customer_id", "left")
    last = existing.agg(F.coalesce(F.max("row_number"), F.lit(1))).scalar()
    new = number_rows(placed.where("row_number is null").select("customer_id", "_day"), [], ["_day", "customer_id"], "_pos")
    numbered = new.select("customer_id", (last + F.col("_pos")).cast("long").alias("row_number"), F.lit("append").alias("action"))
    kept = placed.where("row_number is not null").select("customer_id", F.col("row_number").cast("long"), F.lit("update").alias("action"))
    return kept.unionByName(numbered)


# ---- review queues --------------------------------------------------------------------------

def oldest(df: DataFrame, at: str, key: str, limit: int = 200) -> DataFrame:
    return df.orderBy(at, key).limit(limit)


def pending_merge_queue(customers: DataFrame, limit: int = 200) -> DataFrame:
    """Customers waiting for a merge decision with the contact evidence against their candidate."""
    waiting = oldest(customers.where("pending_merge is not null and status = 'active'"), "updated_at", "customer_id", limit)
    other = customers.select(F.col("customer_id").alias("candidate_id"), F.col("phone").alias("o_phone"), F.col("email").alias("o_email"),
                             F.col("status").alias("candidate_status"))
    j = waiting.join(other, waiting.pending_merge == other.candidate_id, "left")
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    return j.select("customer_id", F.col("pending_merge").alias("candidate_id"), "candidate_status",
                    same("phone", "o_phone").alias("phone_match"), same("email", "o_email").alias("email_match"), "updated_at")


def link_review_queue(t, limit: int = 200) -> DataFrame:
    """Oldest links waiting for review with the person's payments and seats summarised."""
    waiting = oldest(t.customer_links.where("status = 'needs_review'"), "updated_at", "link_id", limit)
    people = F.col("legacy_person_id")
    pays = t.legacy_payments.join(waiting.select(people.alias("person_id")).distinct(), "person_id", "left_semi").groupBy("person_id").agg(
        F.count("*").alias("payments"), F.sum("amount").alias("paid"), F.max("paid_at").alias("last_paid_at"))
    seats = t.legacy_enrollments.join(waiting.select(people.alias("person_id")).distinct(), "person_id", "left_semi").groupBy("person_id").agg(
        F.count_if("counts_as_seat").alias("seats"), F.sort_array(F.collect_set("course_code")).alias("courses"))
    return (waiting.withColumnRenamed("legacy_person_id", "person_id").join(pays, "person_id", "left").join(seats, "person_id", "left")
            .select("link_id", "customer_id", "person_id", "score", F.coalesce("payments", F.lit(0)).alias("payments"), "paid", "last_paid_at",
                    F.coalesce("seats", F.lit(0)).alias("seats"), "courses", "updated_at"))
