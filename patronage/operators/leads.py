"""Ad leads: notifications, field mapping, form-to-course mapping and the fold into customers."""
from pyspark.sql import Column, DataFrame, functions as F

from patronage.functions import vocabulary as V
from patronage.functions.text import WS, normalize_email, normalize_name, normalize_phone, strip, truthy

NOTICE_JSON = ("object string, entry array<struct<id:string, time:bigint, changes:array<struct<field:string, value:struct<leadgen_id:string, "
               "page_id:string, form_id:string, ad_id:string, adgroup_id:string, created_time:bigint>>>>>")


def notifications(raw: DataFrame) -> DataFrame:
    """Webhook bodies (column ``raw``) to one row per lead notice; other change kinds are skipped."""
    e = raw.select(F.explode(F.from_json("raw", NOTICE_JSON)["entry"]).alias("e")).select("e.id", F.explode("e.changes").alias("c"))
    v = F.col("c.value")
    return e.where((F.col("c.field") == "leadgen") & (v["leadgen_id"] != "")).select(
        v["leadgen_id"].alias("leadgen_id"), F.coalesce(v["page_id"], F.col("id")).alias("page_id"), v["form_id"].alias("form_id"),
        v["ad_id"].alias("ad_id"), v["adgroup_id"].alias("adgroup_id"), F.timestamp_seconds(v["created_time"]).alias("created_time"))


def page_scope(notices: DataFrame, page_id: str) -> tuple:
    """Rows of the configured page, and a count of the rest."""
    ours = F.coalesce(F.col("page_id") == page_id, F.lit(False))
    return notices.where(ours), notices.where(~ours).agg(F.count("*").alias("rejected"))


def _norm(c: Column) -> Column:
    return F.regexp_replace(F.lower(strip(c)), f"[{WS}]+", "_")


def _pick(fields: Column, aliases: list) -> Column:
    wanted = [a.strip().lower() for a in aliases]
    hits = F.filter(fields, lambda f: _norm(f["name"]).isin(wanted) & F.exists(f["values"], lambda x: strip(x) != ""))
    return strip(F.get(F.filter(F.get(hits, F.lit(0))["values"], lambda x: strip(x) != ""), F.lit(0)))


def map_leads(leads: DataFrame, consent_field: str | None = None, marketing_field: str | None = None, composed: bool = False) -> DataFrame:
    """Chosen fields of ``field_data`` (array of name/values). Without a consent question there is no consent."""
    f = F.col("field_data")
    for name, aliases in V.LEAD_ALIASES.items():
        leads = leads.withColumn(f"_{name}", _pick(f, aliases))
    joined = F.coalesce("_full_name", F.when(F.coalesce("_first_name", "_last_name").isNotNull(), F.concat_ws(" ", "_first_name", "_last_name")))

    def answer(name):
        if not name:
            return F.lit(None).cast("string")
        key = name.strip().lower()
        last = F.try_element_at(F.filter(f, lambda x: _norm(x["name"]) == key), F.lit(-1))
        return F.get(last["values"], F.lit(0))

    asked = answer(consent_field)
    known = [a.lower() for names in V.LEAD_ALIASES.values() for a in names] + [n.strip().lower() for n in (consent_field, marketing_field) if n]
    names = F.transform(f, lambda x: x["name"])
    return leads.withColumns({
        "display_name": normalize_name(joined, composed), "phone": normalize_phone(F.col("_phone")), "email": normalize_email(F.col("_email")),
        "consent_data": F.when(asked.isNotNull(), truthy(asked)), "consent_marketing": F.when(asked.isNotNull(), truthy(answer(marketing_field))),
        "needs_consent": asked.isNull() | ~truthy(asked),
        "ignored_fields": F.filter(names, lambda n: (n != "") & ~_norm(n).isin(known))}).drop(*[f"_{n}" for n in V.LEAD_ALIASES])


def pick_mapping(notices: DataFrame, mappings: DataFrame) -> DataFrame:
    """Mapping of the ad, else of the form, else of the page; adds the attribution columns."""
    out = notices
    for level, column in (("adId", "ad_id"), ("formId", "form_id"), ("pageId", "page_id")):
        side = mappings.where(F.col("match_on") == level).groupBy(F.col("match_value").alias(column)).agg(
            F.min(F.struct("campaign_name", "course_code", "ad_or_organic")).alias(f"_{level}"))
        out = out.join(side, column, "left")
    m = F.coalesce("_adId", "_formId", "_pageId")
    out = out.withColumn("_m", m)
    return out.select(
        *notices.columns, F.col("_m.course_code").alias("course_code"), F.col("_m.campaign_name").alias("campaign_name"),
        F.coalesce("_m.ad_or_organic", F.lit("unknown")).alias("ad_or_organic"), F.col("_m").isNull().alias("attribution_pending"))


def fold_leads(notices: DataFrame, leads: DataFrame, mappings: DataFrame, customers: DataFrame, rejected: DataFrame,
               consent_field: str | None = None, marketing_field: str | None = None) -> DataFrame:
    """One customer row per lead with attribution, consent and a pending merge when a contact belongs to someone.

    A shared contact never merges by itself. A notice without lead details is ``failed``.
    """
    from patronage.operators.identity import contact_conflicts
    j = pick_mapping(notices, mappings).join(map_leads(leads, consent_field, marketing_field).withColumn("_got", F.lit(True)), "leadgen_id", "left")
    own_id = F.concat(F.lit("cus_"), F.left(F.sha2(F.concat_ws("|", F.lit("lead_ads"), F.coalesce("page_id", F.lit("unknown")), "leadgen_id"), 256), F.lit(26)))
    j = j.withColumn("customer_id", own_id)
    seen = customers.select("customer_id", F.lit(True).alias("_old"))
    clash = contact_conflicts(j.select("customer_id", "phone", "email"), customers, rejected, ("phone", "email"))
    j = j.join(seen, "customer_id", "left").join(clash.withColumnRenamed("candidate_id", "pending_merge"), "customer_id", "left")
    result = F.when(F.col("_got").isNull(), "failed").when(F.col("_old"), "updated").otherwise("created")
    return j.withColumn("result", result).drop("_got", "_old", "field_data")


def lead_report(folded: DataFrame) -> DataFrame:
    r = lambda v: F.count_if(F.col("result") == v)
    live = F.col("result") != "failed"
    return folded.agg(r("created").alias("created"), r("updated").alias("updated"), r("failed").alias("failed"),
                      F.count_if(live & F.col("pending_merge").isNotNull()).alias("pending_merge"),
                      F.count_if(live & F.col("needs_consent")).alias("needs_consent"),
                      F.count_if(live & F.col("attribution_pending")).alias("attribution_pending"))
