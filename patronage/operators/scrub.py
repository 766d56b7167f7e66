"""Privacy-scrubbed copies and the audit that proves they hold no contact data."""
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructType

from patronage.functions.hashing import email_hash, name_keys, nickname_key, person_token, phone_hash, slip_group
from patronage.functions.text import age_band, mask_email, mask_phone, redact_text, safe_session_label
from patronage.sources.store import spread

PHONE_IN_TEXT = r"(?<![0-9])(\+66|0)[2-9][0-9]{7,8}(?![0-9])"
EMAIL_IN_TEXT = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"


def _masked(c: Column, mask) -> Column:
    return F.when(c != "", mask(c))


def scrub_customers(df: DataFrame, key: str, composed: bool = False) -> DataFrame:
    """Tokens for names, masks and keyed hashes for contacts, days instead of instants."""
    c = F.col
    nested = F.when(c("lead_pending").isNotNull() | c("lead_ad_or_organic").isNotNull(), F.struct(
        c("lead_ad_or_organic").alias("ad_or_organic"), c("lead_pending").alias("attribution_pending")))
    return df.select(
        "customer_id", "status", "merged_into", "title", "heard_from", "customer_status", "birth_year",
        person_token(c("display_name"), key).alias("display_name"),
        person_token(c("nickname"), key).alias("nickname"),
        person_token(c("full_name_en"), key).alias("full_name_en"),
        _masked(c("phone"), mask_phone).alias("phone"), _masked(c("email"), mask_email).alias("email"),
        phone_hash(c("phone"), key).alias("phone_hash"), email_hash(c("email"), key).alias("email_hash"),
        name_keys(c("display_name"), c("full_name_en"), key=key, composed=composed).alias("name_keys"),
        nickname_key(c("nickname"), key, composed).alias("nickname_key"),
        F.coalesce(c("consent_marketing"), F.lit(False)).alias("consent_marketing"),
        F.to_date("first_interaction_at").alias("first_interaction_at"),
        F.to_date("form_submitted_at").alias("form_submitted_at"),
        nested.alias("lead_attribution"), c("updated_at").alias("source_updated_at"))


def person_payment_stats(payments: DataFrame, enrollments: DataFrame) -> DataFrame:
    """Per legacy person: money from payments only, seats from enrolments only."""
    paid = payments.groupBy("person_id").agg(
        F.count("*").alias("payment_count"), F.sum(F.coalesce("amount", F.lit(0))).alias("total_paid"),
        F.min("paid_at").alias("first_paid_at"), F.max("paid_at").alias("last_paid_at"),
        F.sort_array(F.collect_set("year")).alias("years_active"))
    seats = enrollments.where("counts_as_seat").groupBy("person_id").agg(
        F.count("*").alias("seat_count"), F.sort_array(F.collect_set("course_code")).alias("course_codes"))
    return paid.join(seats, "person_id", "full_outer")


def scrub_legacy_people(people: DataFrame, stats: DataFrame, key: str, composed: bool = False) -> DataFrame:
    c = F.col
    return people.join(stats, "person_id", "left").select(
        "person_id",
        person_token(c("display_name"), key).alias("display_name"),
        person_token(c("full_name_en"), key).alias("full_name_en"),
        person_token(c("nickname"), key).alias("nickname"),
        _masked(c("phone"), mask_phone).alias("phone"), _masked(c("email"), mask_email).alias("email"),
        phone_hash(c("phone"), key).alias("phone_hash"), email_hash(c("email"), key).alias("email_hash"),
        name_keys(c("display_name"), c("full_name_en"), key=key, composed=composed).alias("name_keys"),
        nickname_key(c("nickname"), key, composed).alias("nickname_key"),
        age_band(c("age_at_import")).alias("age_band"), "first_paid_at", "last_paid_at",
        F.coalesce("total_paid", F.lit(0).cast("decimal(18,2)")).alias("total_paid"),
        F.coalesce("payment_count", F.lit(0)).alias("payment_count"),
        F.coalesce("seat_count", F.lit(0)).alias("seat_count"),
        F.coalesce("course_codes", F.array().cast("array<string>")).alias("course_codes"),
        F.coalesce("years_active", F.array().cast("array<int>")).alias("years_active"),
        "synthetic", c("updated_at").alias("source_updated_at"))


def scrub_legacy_payments(df: DataFrame, key: str) -> DataFrame:
    return df.select(
        "payment_id", "person_id", slip_group(F.col("slip_no"), key).alias("slip_group_id"), "slip_shared",
        "amount", "paid_at", "year", F.month("paid_at").alias("month"), "sale_rep", "synthetic")


def scrub_legacy_enrollments(df: DataFrame) -> DataFrame:
    return df.withColumn("session_label", safe_session_label(F.col("session_label")))


def scrub_purchases(df: DataFrame, key: str) -> DataFrame:
    return df.select(
        "purchase_id", "customer_id", "partner_id", slip_group(F.col("external_payment_id"), key).alias("payment_group_id"),
        "amount", "paid_at", F.year("paid_at").alias("year"), F.month("paid_at").alias("month"), "sale_rep", "status")


def scrub_items(df: DataFrame) -> DataFrame:
    return df.withColumns({"session_label": safe_session_label(F.col("session_label")),
                           "session_year": F.year("session_start")})


def scrub_intents(df: DataFrame) -> DataFrame:
    return df.select("intent_id", "customer_id", "course_code", "status", "hesitation_reason", "confidence",
                     "below_threshold", "source", "lock_kind", "model", "observed_at", "voided_at")


def flag_shared_slips(payments: DataFrame) -> DataFrame:
    """A slip number on several rows marks them all. Counted by key, then joined back, so one
    hot slip costs a partial aggregate and a skew-splittable join instead of one window task."""
    shared = (payments.where("slip_no is not null").groupBy("slip_no").agg(F.count("*").alias("uses"))
              .where("uses > 1").select("slip_no", F.lit(True).alias("slip_shared")))
    return payments.join(shared, "slip_no", "left").withColumn("slip_shared", F.coalesce("slip_shared", F.lit(False)))


def redact_columns(df: DataFrame, *columns: str) -> DataFrame:
    """Log redaction over whole text columns."""
    return spread(df).withColumns({c: redact_text(F.col(c)) for c in columns})


# ---- audit ----------------------------------------------------------------------------------

# --- Fixed values: columns that no scrubbed copy may have, by kind of copy ---
FORBIDDEN = ("social_handle", "facebook", "instagram", "raw", "note")
FORBIDDEN_LEGACY = ("raw", "social_handle", "source_refs", "slip_no", "age_at_import", "course_label")
FORBIDDEN_PARTNER = ("raw", "external_payment_id", "source_event_id", "course_label", "full_name", "phone", "email")
HASHED = ("phone_hash", "email_hash", "slip_group_id")


def _leaves(kind, col: Column, path: tuple):
    """(path, texts) for every part of a column that holds text: its values as an array, map keys beside map values.

    A path names the fields passed; elements of arrays and maps keep their field's name.
    """
    def many(kind_, elements, here):
        paths = [p for p, _ in _leaves(kind_, F.col("x"), here)]
        return [(p, F.flatten(F.transform(elements, lambda x: dict(_leaves(kind_, x, here))[p]))) for p in paths]  # noqa: B023

    if isinstance(kind, StringType):
        return [(path, F.array(col))]
    if isinstance(kind, StructType):
        return [leaf for f in kind.fields for leaf in _leaves(f.dataType, col[f.name], (*path, f.name))]
    if isinstance(kind, ArrayType):
        return many(kind.elementType, col, path)
    if isinstance(kind, MapType):
        return many(kind.keyType, F.map_keys(col), (*path, "key")) + many(kind.valueType, F.map_values(col), path)
    return []


def _names(kind, path: tuple = ()):
    """Every field name at any depth with its path."""
    if isinstance(kind, StructType):
        for f in kind.fields:
            yield f.name, (*path, f.name)
            yield from _names(f.dataType, (*path, f.name))
    elif isinstance(kind, ArrayType):
        yield from _names(kind.elementType, path)
    elif isinstance(kind, MapType):
        yield from _names(kind.keyType, path)
        yield from _names(kind.valueType, path)


def leak_audit(df: DataFrame, id_column: str, forbidden: tuple = FORBIDDEN, exempt: tuple = HASHED) -> DataFrame:
    """Rows that still carry a contact: id, column, violation. Texts are searched at every depth.

    Forbidden field names, also at every depth, appear once with a null id.
    """
    checks = []
    for field in df.schema.fields:
        for path, values in _leaves(field.dataType, F.col(f"`{field.name}`"), (field.name,)):
            name = ".".join(path)
            if path[-1] in exempt or name == id_column:
                continue
            bad = {"phone": F.exists(values, lambda v: v.rlike(PHONE_IN_TEXT)), "email": F.exists(values, lambda v: v.rlike(EMAIL_IN_TEXT))}
            if path[-1] == "name_keys":
                bad["name_key"] = F.exists(values, lambda v: ~v.rlike("^[0-9a-f]{12}$"))
            checks += [F.when(hit, F.struct(F.lit(name).alias("column"), F.lit(kind_).alias("violation"))) for kind_, hit in bad.items()]
    present = [".".join(path) for name, path in _names(df.schema) if name in forbidden]
    named = df.sparkSession.createDataFrame([(None, c, "forbidden") for c in present], "id string, column string, violation string")
    if not checks:
        return named
    found = F.filter(F.array(*checks), lambda x: x.isNotNull())
    rows = df.select(F.col(id_column).cast("string").alias("id"), F.explode_outer(found).alias("v")).where("v IS NOT NULL").select("id", "v.column", "v.violation")
    return rows.unionByName(named) if present else rows


def leak_counts(audit: DataFrame) -> DataFrame:
    return audit.groupBy("column", "violation").agg(F.count("*").alias("rows"))


def feature_export_audit(df: DataFrame) -> DataFrame:
    """Exported pair features may hold no letters of names, addresses, tokens or long digit runs."""
    bad = [F.col(f.name).rlike(r"[฀-๿]|@|<PERSON_|[0-9]{9,}") for f in df.schema.fields
           if isinstance(f.dataType, StringType) and f.name != "pair_id"]
    hit = F.lit(False)
    for b in bad:
        hit = hit | F.coalesce(b, F.lit(False))
    return df.agg(F.count("*").alias("rows"), F.count_if(hit).alias("unsafe"))


# ---- erasure --------------------------------------------------------------------------------

ERASED_COLUMNS = ("title", "display_name", "nickname", "full_name_en", "phone", "email", "facebook", "instagram",
                  "line_display_name", "picture_url", "birth_year", "heard_from", "lead_page_id", "lead_form_id",
                  "lead_ad_id", "lead_ad_or_organic", "lead_pending", "pending_merge", "form_submitted_at")


def erase_customers(customers: DataFrame, requests: DataFrame, now: str) -> DataFrame:
    """Blank personal columns of requested customers; purchases stay untouched elsewhere.

    ``requests``: customer_id, reason.
    """
    req = requests.groupBy("customer_id").agg(F.min("reason").alias("erase_reason"))
    joined = customers.join(req.withColumn("_hit", F.lit(True)), "customer_id", "left")
    hit = F.coalesce("_hit", F.lit(False))
    out = {c: F.when(~hit, F.col(c)) for c in ERASED_COLUMNS if c in customers.columns}
    out["status"] = F.when(hit, "erased").otherwise(F.col("status"))
    out["updated_at"] = F.when(hit, F.lit(now).cast("timestamp")).otherwise(F.col("updated_at"))
    for flag in ("sheet_dirty", "ai_dirty"):
        if flag in customers.columns:
            out[flag] = hit | F.col(flag)
    return joined.withColumns(out).drop("_hit")


def drop_owned(df: DataFrame, requests: DataFrame) -> DataFrame:
    """Profiles, identities and intents of erased customers disappear."""
    return df.join(requests.select("customer_id").distinct(), "customer_id", "left_anti")


def erase_audit(requests: DataFrame, removed: dict, now: str) -> DataFrame:
    """One audit row per request with counts only; no erased value is copied."""
    base = requests.groupBy("customer_id").agg(F.min("reason").alias("reason"))
    for name, df in removed.items():
        n = df.join(base, "customer_id", "left_semi").groupBy("customer_id").agg(F.count("*").alias(name))
        base = base.join(n, "customer_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return base.select(F.lit("partner:erase").alias("actor"), F.lit("customer.erased").alias("action"), "*",
                       F.lit(now).cast("timestamp").alias("at"))
