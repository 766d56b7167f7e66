"""Posts: landing, course by hashtag, analytics, ad attribution and the marketing sheets."""
from pyspark.sql import Column, DataFrame, functions as F

from patronage.functions import vocabulary as V
from patronage.functions.courses import course_name, known_code
from patronage.functions.dates import utc_bounds
from patronage.functions.text import read_hashtags, strip

POST_JSON = ("id string, message string, created_time string, permalink_url string, reactions struct<summary:struct<total_count:double>>, "
             "comments struct<summary:struct<total_count:double>>, shares struct<count:double>")
INSIGHT_JSON = "data array<struct<name:string, values:array<struct<value:double>>>>"


def _instant(c: Column) -> Column:
    return F.regexp_replace(c, r"([+-][0-9]{2})([0-9]{2})$", "$1:$2").try_cast("timestamp")


def land_posts(raw: DataFrame, previous: DataFrame) -> DataFrame:
    """Raw post and insight JSON to post rows; ``valid`` is false without id or date.

    Reach falls back to the previous snapshot, which also keeps the known ad ids.
    ``raw``: post_json, insight_json. ``previous``: post_id, reach, ad_ids.
    """
    p = raw.select(F.from_json("post_json", POST_JSON).alias("p"), F.from_json("insight_json", INSIGHT_JSON).alias("i"))
    amount = lambda c: F.when(F.col(c) > 0, F.col(c).cast("long")).otherwise(0)
    values = F.get(F.filter("i.data", lambda m: m["name"] == "post_impressions_unique"), F.lit(0))["values"]
    reach = F.try_element_at(values, F.lit(-1))["value"]
    p = p.select(
        strip(F.col("p.id")).alias("post_id"), F.col("p.message").alias("message"), _instant(F.col("p.created_time")).alias("created_time"),
        F.col("p.permalink_url").alias("permalink"), amount("p.reactions.summary.total_count").alias("reactions"),
        amount("p.comments.summary.total_count").alias("comments"), amount("p.shares.count").alias("shares"),
        F.when(reach >= 0, reach.cast("long")).alias("_reach"), F.col("i").isNull().alias("no_insight"))
    old = previous.select("post_id", F.col("reach").alias("_old"), "ad_ids")
    j = p.join(old, "post_id", "left").withColumns({
        "reach": F.coalesce("_reach", "_old", F.lit(0)), "ad_ids": F.array_distinct(F.coalesce("ad_ids", F.array().cast("array<string>"))),
        "valid": F.coalesce(F.col("post_id") != "", F.lit(False)) & F.col("created_time").isNotNull()})
    return read_hashtags(j.drop("_reach", "_old"))


def landing_report(landed: DataFrame) -> DataFrame:
    return landed.agg(F.count("*").alias("fetched"), F.count_if("valid").alias("stored"), F.count_if(~F.col("valid")).alias("invalid"),
                      F.count_if(F.col("no_insight") & F.col("valid")).alias("missing_insights"))


def sync_window(days: int | None, first_load: bool) -> int:
    """Days to fetch: 365 on the first load, 90 after, within 1..366."""
    d = days if days is not None else (365 if first_load else 90)
    if not 1 <= d <= 366:
        raise ValueError("days must lie in 1..366")
    return d


def in_range(posts: DataFrame, start: str, end: str) -> DataFrame:
    lo, hi = utc_bounds(start, end)
    return posts.where(F.col("created_time").between(F.lit(lo).cast("timestamp"), F.lit(hi).cast("timestamp")))


def post_analytics(posts: DataFrame, start: str, end: str) -> DataFrame:
    """Totals and two-place averages per course; posts without one share a bucket."""
    g = in_range(posts, start, end).groupBy(F.coalesce("course_code", F.lit("UNMAPPED")).alias("key")).agg(
        F.count("*").alias("post_count"), *[F.sum(c).alias(c) for c in ("reactions", "comments", "shares", "reach")])
    g = g.withColumn("engagement", F.col("reactions") + F.col("comments") + F.col("shares"))
    avg = lambda c: (F.floor(F.col(c) / F.col("post_count") * 100 + 0.5) / 100).alias(f"{c}_avg")
    label = F.when(F.col("key") == "UNMAPPED", V.UNMAPPED_POST_LABEL).otherwise(course_name(F.col("key")))
    cols = ["reactions", "comments", "shares", "engagement", "reach"]
    return g.select("key", label.alias("label"), "post_count", *cols, *[avg(c) for c in cols]).orderBy(F.desc("engagement"), "key")


def post_summary(posts: DataFrame, start: str, end: str) -> DataFrame:
    rows = in_range(posts, start, end)
    eng = F.col("reactions") + F.col("comments") + F.col("shares")
    per = rows.groupBy("course_code").agg(
        F.count("*").alias("n"), F.count_if(~F.col("unmapped") & F.col("course_code").isNotNull()).alias("m"), F.count_if("unmapped").alias("u"),
        F.sum(eng).alias("e"), F.sum("reach").alias("r"), F.max("synthetic").alias("s"))
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_posts"), F.coalesce(F.sum("m"), F.lit(0)).alias("mapped_posts"),
        F.coalesce(F.sum("u"), F.lit(0)).alias("unmapped_posts"), F.coalesce(F.sum("e"), F.lit(0)).alias("total_engagement"),
        F.coalesce(F.sum("r"), F.lit(0)).alias("total_reach"), F.greatest(F.lit(1), F.coalesce(F.max("e"), F.lit(1))).alias("chart_max_engagement"),
        F.coalesce(F.max("s"), F.lit(False)).alias("contains_synthetic"))


def newest_post_per_ad(posts: DataFrame) -> DataFrame:
    pairs = posts.select(F.explode(F.array_distinct("ad_ids")).alias("ad_id"), "created_time", "post_id", "course_code", "permalink", "message")
    top = pairs.groupBy("ad_id").agg(F.max(F.struct("created_time", "post_id", "course_code", "permalink", "message")).alias("p"))
    return top.select("ad_id", "p.post_id", F.col("p.course_code").alias("post_course"), "p.permalink", "p.message")


def attribute_leads(customers: DataFrame, posts: DataFrame, ad_posts: DataFrame, mappings: DataFrame) -> DataFrame:
    """Outcome per customer whose ad attribution is still pending.

    The post's course wins, then the ad's mapping; only dictionary codes resolve. ``ad_posts`` holds
    ad -> post ids found outside the post table.
    """
    waiting = customers.where(F.col("lead_pending") & (F.col("source_channel") == "facebook_lead")).select(
        "customer_id", F.col("lead_ad_id").alias("ad_id"), F.col("lead_ad_or_organic").alias("kind"))
    known = newest_post_per_ad(posts).select("ad_id", "post_id")
    route = known.unionByName(ad_posts.join(known, "ad_id", "left_anti").select("ad_id", "post_id"))
    content = posts.select("post_id", F.col("course_code").alias("post_course"), "permalink")
    fallback = mappings.where("match_on = 'adId'").select(F.col("match_value").alias("ad_id"), F.col("course_code").alias("map_course"), "campaign_name")
    fallback = fallback.groupBy("ad_id").agg(F.min(F.struct("campaign_name", "map_course")).alias("m")).select("ad_id", "m.*")
    j = waiting.join(route, "ad_id", "left").join(content, "post_id", "left").join(fallback, "ad_id", "left")
    organic = F.col("ad_id").isNull() | F.coalesce(F.col("kind") == "organic", F.lit(False))
    course = F.coalesce("post_course", "map_course")
    ok = known_code(course).isNotNull()
    return j.select(
        "customer_id", "ad_id", F.when(organic, "skipped_organic").when(ok, "resolved").otherwise("unresolved").alias("status"),
        F.when(~organic & ok, F.when(F.col("post_course").isNotNull(), "post").otherwise("fallback")).alias("source"),
        F.when(~organic & ok, course).alias("course_code"), F.when(~organic, F.col("post_id")).alias("post_id"),
        F.when(~organic, F.col("permalink")).alias("permalink"), F.when(~organic & ok, F.col("campaign_name")).alias("campaign_name"))


def attribution_report(outcome: DataFrame) -> DataFrame:
    n = lambda c, v: F.count_if(F.col(c) == v)
    return outcome.agg(F.count("*").alias("considered"), n("status", "resolved").alias("resolved"), n("status", "unresolved").alias("unresolved"),
                       n("status", "skipped_organic").alias("organic_skipped"), n("source", "post").alias("by_post"), n("source", "fallback").alias("by_fallback"))


def apply_attribution(customers: DataFrame, outcome: DataFrame) -> DataFrame:
    done = outcome.where("status = 'resolved'").select("customer_id", F.col("course_code").alias("lead_course_code"), F.lit(True).alias("_ok"))
    ok = F.coalesce("_ok", F.lit(False))
    j = customers.join(done, "customer_id", "left")
    return j.withColumns({"lead_pending": F.when(ok, False).otherwise(F.col("lead_pending")),
                          "lead_ad_or_organic": F.when(ok, "ad").otherwise(F.col("lead_ad_or_organic"))}).drop("_ok")


def remember_ads(posts: DataFrame, outcome: DataFrame) -> DataFrame:
    """Add the ad ids that led to a post."""
    new = outcome.where("post_id is not null and ad_id is not null").groupBy("post_id").agg(F.collect_set("ad_id").alias("_new"))
    return posts.join(new, "post_id", "left").withColumn(
        "ad_ids", F.array_sort(F.array_union("ad_ids", F.coalesce("_new", F.array().cast("array<string>"))))).drop("_new")


def post_label(message: Column, permalink: Column) -> Column:
    title = F.substring(F.get(F.split(strip(message), r"\r?\n"), F.lit(0)), 1, 90)
    return F.concat_ws(" | ", F.when(title != "", title), F.when(permalink != "", permalink))


def _is_lead(customers: DataFrame) -> Column:
    """Came by a lead form, first or later."""
    first = F.col("source_channel").eqNullSafe("facebook_lead")
    return first | F.coalesce(F.array_contains("sources", "facebook_lead"), F.lit(False)) if "sources" in customers.columns else first


def marketing_leads(customers: DataFrame, posts: DataFrame) -> DataFrame:
    """Lead tab: name, phone, course, post label and day; erased people show blanks."""
    leads = customers.where(_is_lead(customers))
    ads = newest_post_per_ad(posts).withColumnRenamed("ad_id", "lead_ad_id")
    j = leads.join(ads, "lead_ad_id", "left")
    shown = lambda c: F.when(F.col("status") == "erased", "").otherwise(F.coalesce(c, F.lit("")))
    course = F.col("lead_course_code") if "lead_course_code" in customers.columns else F.lit(None).cast("string")
    return j.select(
        "customer_id", shown(F.coalesce("display_name", "line_display_name")).alias("name"), shown(F.col("phone")).alias("phone"),
        F.coalesce(course, F.lit("")).alias("course"), post_label(F.col("message"), F.col("permalink")).alias("post"),
        F.date_format("first_interaction_at", "yyyy-MM-dd").alias("day"), "updated_at").orderBy(F.desc("updated_at"), "customer_id")


def marketing_posts(posts: DataFrame) -> DataFrame:
    eng = F.col("reactions") + F.col("comments") + F.col("shares")
    return posts.select(
        "post_id", F.coalesce("course_code", F.lit("")).alias("course"), F.date_format("created_time", "yyyy-MM-dd").alias("day"), "reactions",
        "comments", "shares", eng.alias("engagement"), "reach", F.coalesce("permalink", F.lit("")).alias("permalink"),
        F.when(F.col("unmapped"), V.UNMAPPED_POST_MARK).otherwise("").alias("mark")).orderBy(F.desc("day"), "post_id")


def marketing_counts(customers: DataFrame, posts: DataFrame) -> DataFrame:
    c = customers.agg(F.count("*").alias("customers"), F.count_if(_is_lead(customers)).alias("leads"))
    p = posts.agg(F.count("*").alias("posts"), F.count_if("unmapped").alias("unmapped"))
    return c.select("customers", "leads", p.select("posts").scalar().alias("posts"), p.select("unmapped").scalar().alias("unmapped_posts"))
