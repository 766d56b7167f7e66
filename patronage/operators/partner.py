"""Partner event intake: validation, course canonicalisation, revisions, folds and quarantine."""
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from patronage.functions import vocabulary as V
from patronage.functions.courses import clean_code, code_by_header, counts_as_seat, is_non_course, known_code
from patronage.functions.dates import source_year_month, valid_date_text
from patronage.functions.text import normalize_email, normalize_phone, strip
from patronage.sources.store import settle, spread

# --- Fixed values: accepted keys of each object, in checking order ---
KEYS = {
    "": ["eventId", "type", "occurredAt", "revision", "subject", "payment", "intent", "voids", "tags", "attribution", "erase"],
    "subject": ["lineUserId", "phone", "email", "fullName"],
    "payment": ["externalPaymentId", "amount", "currency", "paidAt", "saleRep", "lines"],
    "intent": ["courseCode", "status", "hesitationReason", "confidence", "source", "model", "lock"],
    "attribution": ["source", "adOrOrganic", "campaignId", "contentRef"],
    "erase": ["reason", "requestedAt"],
    "line": ["courseLabel", "courseCode", "sessionLabel", "sessionStart", "kind", "countsAsSeat"],
}
MAX_TEXT = {"eventId": 240, "type": 40, "voids": 240, "subject.lineUserId": 200, "subject.phone": 100, "subject.email": 320,
            "subject.fullName": 300, "payment.externalPaymentId": 200, "payment.saleRep": 100, "intent.courseCode": 50,
            "intent.status": 60, "intent.hesitationReason": 80, "intent.model": 200, "attribution.source": 80,
            "attribution.adOrOrganic": 40, "attribution.campaignId": 200, "attribution.contentRef": 300}
ERASE_REASONS = ["customer_request", "legal_request", "other"]


class _Doc:
    """Typed access to one variant column by path."""

    def __init__(self, v: Column):
        self.v = v

    def kind(self, path: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(self.v, f"$.{path}", "variant"))

    def text(self, path: str) -> Column:
        return F.when(self.kind(path) == "STRING", F.try_variant_get(self.v, f"$.{path}", "string"))

    def number(self, path: str) -> Column:
        return F.when(self.is_number(path), F.try_variant_get(self.v, f"$.{path}", "double"))

    def is_number(self, path: str) -> Column:
        return F.coalesce(self.kind(path).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT)"), F.lit(False))

    def missing(self, path: str) -> Column:
        return self.kind(path).isNull()

    def null(self, path: str) -> Column:
        return F.coalesce(self.kind(path) == "VOID", F.lit(False))

    def object(self, path: str) -> Column:
        return F.coalesce(self.kind(path).startswith("OBJECT"), F.lit(False))

    def absent(self, path: str) -> Column:
        return self.missing(path) | self.null(path)


def _no(c: Column) -> Column:
    return ~F.coalesce(c, F.lit(False))


# --- Fixed values: JSON kinds per key, for the quick shape test on canonical JSON ---
TEXT_KEYS = "eventId|type|occurredAt|lineUserId|phone|email|fullName|externalPaymentId|currency|paidAt|saleRep|courseLabel|courseCode|" \
            "sessionLabel|sessionStart|kind|status|hesitationReason|source|model|lock|voids|adOrOrganic|campaignId|contentRef|reason|requestedAt"
# A pattern begins where a key ends and looks back only if the value is of another kind: most keys have texts and are passed at once.
NEVER_NULL = "eventId|type|occurredAt|currency|courseLabel|kind|status|source|confidence|revision|voids|lock|reason|requestedAt"
ODD_KINDS = (f'":(?:(?!"|null)(?<="(?:{TEXT_KEYS})":)|(?![0-9-]|null)(?<="(?:revision|amount|confidence)":)|(?!true|false)(?<="countsAsSeat":)|'
             r'(?!\{)(?<="(?:subject|payment|intent|attribution|erase)":)|(?!\[)(?<="(?:lines|tags)":)|'
             f'(?=null)(?<="(?:{NEVER_NULL})":))')
EVENT_JSON = ("eventId string, type string, occurredAt string, revision double, subject struct<lineUserId:string,phone:string,email:string,fullName:string>, "
              "payment struct<externalPaymentId:string,amount:double,currency:string,paidAt:string,saleRep:string,"
              "lines:array<struct<courseLabel:string,courseCode:string,sessionLabel:string,sessionStart:string,kind:string,countsAsSeat:boolean>>>, "
              "intent struct<courseCode:string,status:string,hesitationReason:string,confidence:double,source:string,model:string,lock:string>, "
              "voids string, tags array<string>, attribution struct<source:string,adOrOrganic:string,campaignId:string,contentRef:string>, "
              "erase struct<reason:string,requestedAt:string>")


def _plainly_fine(e: Column, j: Column) -> Column:
    """True only for events with nothing to complain about; the slow path finds the exact problem of the rest."""
    def fits(c, n, needed=False):
        ok = F.length(strip(c)).between(1, n)
        return F.coalesce(ok, F.lit(not needed))

    def within(keys, name):
        return F.coalesce(F.size(F.array_except(keys, F.array(*[F.lit(k) for k in KEYS[name]]))) == 0, F.lit(True))

    s, p, i, a, x = (e[n] for n in ("subject", "payment", "intent", "attribution", "erase"))
    lines = F.from_json(F.get_json_object(j, "$.payment.lines"), "array<map<string,string>>")
    line_ok = F.forall(lines, lambda m: within(F.map_keys(m), "line"))
    lines_fit = F.forall(p["lines"], lambda r: fits(r["courseLabel"], 200, True) & fits(r["courseCode"], 50) & fits(r["sessionLabel"], 300)
                         & fits(r["kind"], 40, True) & (r["sessionStart"].isNull() | valid_date_text(r["sessionStart"])))
    checks = [
        ~j.rlike(ODD_KINDS), within(F.json_object_keys(j), ""), fits(e["eventId"], 240, True), fits(e["type"], 40, True),
        e["occurredAt"].rlike(r"(Z|[+-][0-9]{2}:[0-9]{2})$") & e["occurredAt"].try_cast("timestamp").isNotNull(),
        e["revision"].isNull() | ((e["revision"] >= 1) & (e["revision"] == F.floor(e["revision"]))), fits(e["voids"], 240), e["tags"].isNull(),
        s.isNull() | (fits(s["lineUserId"], 200) & fits(s["phone"], 100) & fits(s["email"], 320) & fits(s["fullName"], 300)
                      & F.coalesce(s["lineUserId"], s["phone"], s["email"], s["fullName"]).isNotNull()
                      & within(F.json_object_keys(F.get_json_object(j, "$.subject")), "subject")),
        p.isNull() | (fits(p["externalPaymentId"], 200) & fits(p["saleRep"], 100) & strip(p["currency"]).rlike("^[A-Z]{3}$")
                      & F.coalesce(p["amount"] >= 0, j.contains('"amount":null')) & (p["paidAt"].isNull() & j.contains('"paidAt":null') | valid_date_text(p["paidAt"]))
                      & F.size(p["lines"]).between(1, 100) & lines_fit & line_ok
                      & within(F.json_object_keys(F.get_json_object(j, "$.payment")), "payment")),
        i.isNull() | (fits(i["courseCode"], 50) & fits(i["status"], 60, True) & fits(i["hesitationReason"], 80) & i["confidence"].between(0, 1)
                      & i["source"].isin("ai", "staff") & fits(i["model"], 200) & F.coalesce(i["lock"].isin("soft", "sticky"), F.lit(True))
                      & within(F.json_object_keys(F.get_json_object(j, "$.intent")), "intent")),
        a.isNull() & x.isNull()]
    out = F.lit(True)
    for c in checks:
        out = out & F.coalesce(c, F.lit(False))
    return out


def _issues(d: _Doc, raw: Column) -> Column:
    """First schema problem of an event as its path, null when the shape is right."""
    out = []

    def bad(path, condition, when=None):
        out.append(F.when(condition if when is None else when & condition, F.lit(path)))

    def good_text(path):
        t = strip(d.text(path))
        return t.isNotNull() & (F.length(t) >= 1) & (F.length(t) <= MAX_TEXT[path])

    def keys_known(path, name):
        keys = F.json_object_keys(raw if not path else F.get_json_object(raw, f"$.{path}"))
        return F.size(F.array_except(keys, F.array(*[F.lit(k) for k in KEYS[name]]))) == 0

    bad("eventId", _no(good_text("eventId")))
    bad("type", _no(good_text("type")))
    at = d.text("occurredAt")
    bad("occurredAt", _no(at.rlike(r"(Z|[+-][0-9]{2}:[0-9]{2})$") & at.try_cast("timestamp").isNotNull()))
    rev = d.number("revision")
    bad("revision", ~d.missing("revision") & _no((rev >= 1) & (rev == F.floor(rev))))
    for name in ("subject", "payment", "intent"):
        here = d.object(name)
        bad(name, ~d.missing(name) & ~here)
        if name == "subject":
            for k in KEYS[name]:
                bad(f"{name}.{k}", ~d.absent(f"{name}.{k}") & _no(good_text(f"{name}.{k}")), here)
        elif name == "payment":
            p = lambda k: f"payment.{k}"
            bad(p("externalPaymentId"), ~d.absent(p("externalPaymentId")) & _no(good_text(p("externalPaymentId"))), here)
            bad(p("amount"), ~d.null(p("amount")) & _no(d.number(p("amount")) >= 0), here)
            bad(p("currency"), _no(strip(d.text(p("currency"))).rlike("^[A-Z]{3}$")), here)
            bad(p("paidAt"), ~d.null(p("paidAt")) & ~valid_date_text(d.text(p("paidAt"))), here)
            bad(p("saleRep"), ~d.absent(p("saleRep")) & _no(good_text(p("saleRep"))), here)
            lines = F.try_variant_get(d.v, "$.payment.lines", "array<variant>")
            bad(p("lines"), _no(F.size(lines).between(1, 100)), here)
            out.append(F.when(here, F.get(F.filter(F.transform(lines, _line_issue), lambda x: x.isNotNull()), F.lit(0))))
        else:
            i = lambda k: f"intent.{k}"
            bad(i("courseCode"), ~d.absent(i("courseCode")) & _no(good_text(i("courseCode"))), here)
            bad(i("status"), _no(good_text(i("status"))), here)
            bad(i("hesitationReason"), ~d.absent(i("hesitationReason")) & _no(good_text(i("hesitationReason"))), here)
            bad(i("confidence"), _no(d.number(i("confidence")).between(0, 1)), here)
            bad(i("source"), _no(d.text(i("source")).isin("ai", "staff")), here)
            bad(i("model"), ~d.absent(i("model")) & _no(good_text(i("model"))), here)
            bad(i("lock"), ~d.missing(i("lock")) & _no(d.text(i("lock")).isin("soft", "sticky")), here)
        bad(name, ~keys_known(name, name), here)
        if name == "subject":
            bad(name, F.coalesce(*[d.text(f"subject.{k}") for k in KEYS[name]]).isNull(), here)
    bad("voids", ~d.missing("voids") & _no(good_text("voids")))
    tags = F.try_variant_get(d.v, "$.tags", "array<string>")
    bad("tags", ~d.missing("tags") & _no((F.size(tags) <= 100) & F.forall(tags, lambda x: F.length(strip(x)).between(1, 100))))
    here = d.object("attribution")
    bad("attribution", ~d.missing("attribution") & ~here)
    for k in KEYS["attribution"]:
        bad(f"attribution.{k}", ~d.absent(f"attribution.{k}") & _no(good_text(f"attribution.{k}")), here)
    bad("attribution", ~keys_known("attribution", "attribution"), here)
    here = d.object("erase")
    bad("erase", ~d.missing("erase") & ~here)
    bad("erase.reason", ~d.missing("erase.reason") & _no(d.text("erase.reason").isin(ERASE_REASONS)), here)
    bad("erase.requestedAt", ~d.missing("erase.requestedAt") & d.text("erase.requestedAt").isNull(), here)
    bad("erase", ~keys_known("erase", "erase"), here)
    bad("event", ~keys_known("", ""))
    return F.coalesce(*out)


def _line_issue(v: Column, i: Column) -> Column:
    d = _Doc(v)
    t = lambda k: strip(d.text(k))
    ok = lambda k, n: t(k).isNotNull() & F.length(t(k)).between(1, n)
    path = lambda k: F.concat(F.lit("payment.lines."), i.cast("string"), F.lit(k))
    keys = F.json_object_keys(F.to_json(v))
    return F.coalesce(
        F.when(_no(ok("courseLabel", 200)), path(".courseLabel")),
        F.when(~d.absent("courseCode") & _no(ok("courseCode", 50)), path(".courseCode")),
        F.when(~d.absent("sessionLabel") & _no(ok("sessionLabel", 300)), path(".sessionLabel")),
        F.when(~d.absent("sessionStart") & ~valid_date_text(d.text("sessionStart")), path(".sessionStart")),
        F.when(_no(ok("kind", 40)), path(".kind")),
        F.when(~d.missing("countsAsSeat") & _no(d.kind("countsAsSeat") == "BOOLEAN"), path(".countsAsSeat")),
        F.when(F.size(F.array_except(keys, F.array(*[F.lit(k) for k in KEYS["line"]]))) > 0, path("")))


def _read_line(x: Column) -> Column:
    return F.struct(
        strip(x["courseLabel"]).alias("course_label"), strip(x["courseCode"]).alias("course_code"),
        strip(x["sessionLabel"]).alias("session_label"), x["sessionStart"].try_cast("date").alias("session_start"), strip(x["kind"]).alias("kind"))


def parse_events(df: DataFrame) -> DataFrame:
    """Typed columns, ``outcome`` (ok / rejected / quarantined) and ``reason`` for raw JSON events.

    ``df``: partner_id, seq (arrival order), raw. Staged so the document is parsed once.
    """
    df = spread(df).withColumn("doc", F.try_parse_json("raw"))
    df = df.withColumn("json", F.to_json("doc"))
    df = df.withColumn("e", F.from_json("json", EVENT_JSON))
    df = df.withColumn("fine", _plainly_fine(F.col("e"), F.col("json")))
    d, e = _Doc(F.col("doc")), F.col("e")
    is_object = F.coalesce(F.schema_of_variant("doc").startswith("OBJECT"), F.lit(False))
    forbidden = F.coalesce(F.col("json").rlike('"(' + "|".join(V.FORBIDDEN_KEYS) + ')":'), F.lit(False))
    issue = F.when(F.col("fine"), None).when(~is_object, "event").otherwise(_issues(d, F.col("json")))
    s, p, i = e["subject"], e["payment"], e["intent"]
    df = df.withColumns({
        "event_id": F.coalesce(strip(d.text("eventId")), F.lit("unknown")), "type": strip(e["type"]), "occurred_at": e["occurredAt"].try_cast("timestamp"),
        "revision": F.coalesce(e["revision"].cast("int"), F.lit(1)), "forbidden": forbidden, "issue": issue,
        "has_subject": s.isNotNull(), "has_payment": p.isNotNull(), "has_intent": i.isNotNull(), "has_tags": e["tags"].isNotNull(),
        "voids": strip(e["voids"]), "erase_reason": F.coalesce(e["erase"]["reason"], F.lit("customer_request")),
        "line_user_id": strip(s["lineUserId"]), "phone": normalize_phone(s["phone"]), "email": normalize_email(s["email"]), "full_name": strip(s["fullName"]),
        "external_payment_id": strip(p["externalPaymentId"]), "amount": p["amount"].cast("decimal(18,2)"), "currency": strip(p["currency"]),
        "paid_at": p["paidAt"].try_cast("date"), "sale_rep": strip(p["saleRep"]), "lines": F.transform(p["lines"], _read_line),
        "intent_course": strip(i["courseCode"]), "intent_status": strip(i["status"]), "intent_reason": strip(i["hesitationReason"]),
        "intent_confidence": i["confidence"], "intent_source": i["source"], "intent_model": strip(i["model"]), "intent_lock": i["lock"]})
    t, c = F.col("type"), F.col
    bad_kind = F.get(F.filter("lines", lambda x: ~x["kind"].isin(V.PARTNER_KINDS)), F.lit(0))["kind"]
    tag = lambda kind, why: F.struct(F.lit(kind).alias("outcome"), (why if isinstance(why, Column) else F.lit(why)).alias("reason"))
    verdict = (
        F.when(c("forbidden"), tag("rejected", "forbidden_chat_field"))
        .when(c("issue").isNotNull(), tag("rejected", F.concat(F.lit("invalid_schema:"), "issue")))
        .when((t == "tag") | c("has_tags"), tag("quarantined", "unsupported_type:tag"))
        .when((t == "erase") & ~c("has_subject"), tag("rejected", "erase_requires_subject"))
        .when(~t.isin(V.PARTNER_TYPES), tag("rejected", F.concat(F.lit("unsupported_type:"), t)))
        .when(t.isin("purchase", "intent") & ~c("has_subject"), tag("rejected", "subject_required"))
        .when((t == "purchase") & ~c("has_payment"), tag("rejected", "payment_required"))
        .when((t == "intent") & ~c("has_intent"), tag("rejected", "intent_required"))
        .when(t.isin("purchase.void", "intent.void") & c("voids").isNull(), tag("rejected", "voids_required"))
        .when(c("has_intent") & ~c("intent_status").isin(V.INTENT_STATUSES), tag("quarantined", F.concat(F.lit("unknown_intent_status:"), "intent_status")))
        .when(c("intent_reason").isNotNull() & ~c("intent_reason").isin(V.HESITATION_REASONS),
              tag("quarantined", F.concat(F.lit("unknown_hesitation_reason:"), "intent_reason")))
        .when((c("intent_status") != "hesitant") & c("intent_reason").isNotNull(), tag("rejected", "hesitation_reason_without_hesitant"))
        .when((c("intent_source") == "ai") & c("intent_model").isNull(), tag("rejected", "ai_model_required"))
        .when((c("intent_source") == "ai") & c("intent_lock").isNotNull(), tag("rejected", "ai_lock_forbidden"))
        .when(bad_kind.isNotNull(), tag("rejected", F.concat(F.lit("unsupported_kind:"), bad_kind)))
        .otherwise(tag("ok", F.lit(None).cast("string"))))
    staff = c("intent_source") == "staff"
    df = df.withColumn("_v", verdict).withColumns({
        "outcome": c("_v.outcome"), "reason": c("_v.reason"), "type": F.when((t == "tag") | c("has_tags"), "tag").otherwise(t),
        "intent_reason": F.when(c("intent_status") == "hesitant", F.coalesce("intent_reason", F.lit("unknown"))),
        "intent_confidence": F.when(staff, 1.0).otherwise(c("intent_confidence")), "intent_model": F.when(~staff, c("intent_model")),
        "intent_lock": F.when(staff, F.coalesce("intent_lock", F.lit("soft"))).otherwise("soft")})
    return _canonical(df.drop("_v", "doc", "json", "e", "fine", "forbidden", "issue"))


def _canonical(df: DataFrame) -> DataFrame:
    """Dictionary codes for lines and intent; unknown or contradictory courses go to quarantine."""
    def line(x):
        by_code = known_code(clean_code(x["course_code"]))
        by_label = code_by_header(x["course_label"])
        problem = (F.when(x["course_code"].isNotNull() & by_code.isNull(), F.concat(F.lit("unknown_course_code:"), x["course_code"]))
                   .when(by_code.isNotNull() & by_label.isNotNull() & (by_code != by_label),
                         F.concat(F.lit("course_mismatch:"), x["course_code"], F.lit(":"), x["course_label"]))
                   .when(by_code.isNull() & by_label.isNull(), F.concat(F.lit("unknown_course:"), x["course_label"])))
        return x.withField("course_code", F.coalesce(by_code, by_label)).withField("problem", problem)

    df = df.withColumn("lines", F.transform("lines", line))
    code = known_code(clean_code(F.col("intent_course")))
    problem = F.coalesce(
        F.get(F.filter(F.transform("lines", lambda x: x["problem"]), lambda p: p.isNotNull()), F.lit(0)),
        F.when(F.col("intent_course").isNotNull() & code.isNull(), F.concat(F.lit("unknown_course_code:"), "intent_course")))
    hit = (F.col("outcome") == "ok") & problem.isNotNull()
    return df.withColumns({"reason": F.when(hit, problem).otherwise(F.col("reason")), "outcome": F.when(hit, "quarantined").otherwise(F.col("outcome")),
                           "intent_course": code})


EVENT = ["partner_id", "event_id"]
SUBJECT = ["line_user_id", "phone", "email"]
#: What decides about an arrival; the other columns of a parsed event only travel along.
DECIDES = [*EVENT, "seq", "revision", "type", "outcome", "reason", "voids", "intent_course"]
# Columns that the folds below read beside those.
PURCHASE = ["occurred_at", "external_payment_id", "amount", "currency", "paid_at", "sale_rep", "lines"]
ARRIVAL = ["occurred_at", "intent_confidence", "intent_source", "intent_lock"]
OPINION = [*ARRIVAL, "intent_status", "intent_reason", "intent_model"]
CORRECTABLE = ["lines", "has_intent", "intent_status"]


def settle_revisions(events: DataFrame) -> DataFrame:
    """Final ``status`` per arrival for parsed events that carry customer_id / evidence / ambiguous.

    A stored event keeps its type and owner. Revisions are compared over one row per (event,
    revision), so a resend storm of one event id shrinks in the first aggregation.
    """
    first_ok = F.min(F.when(F.col("outcome") == "ok", F.struct("seq", "customer_id", "intent_course")))
    facts = events.where("outcome <> 'rejected'").groupBy(*EVENT).agg(F.min(F.struct("seq", "type")).alias("f"), first_ok.alias("o")).select(
        *EVENT, F.col("f.type").alias("first_type"), F.col("o.seq").alias("ok_seq"), F.col("o.customer_id").alias("owner"),
        F.col("o.intent_course").alias("first_course"))
    j = events.join(facts, EVENT, "left")
    later = (F.col("outcome") == "ok") & (F.col("seq") > F.col("ok_seq")) & F.col("type").isin("purchase", "intent")
    clash = (F.when(F.col("type") != F.col("first_type"), "revision_type_change")
             .when(later & F.col("customer_id").isNotNull() & ~F.col("customer_id").eqNullSafe(F.col("owner")), "revision_identity_change")
             .when(later & (F.col("type") == "intent") & ~F.col("intent_course").eqNullSafe(F.col("first_course")), "revision_course_change"))
    j = j.withColumn("clash", F.when(F.col("outcome") != "rejected", clash))

    usable = j.where("outcome <> 'rejected' and clash is null")
    revs = usable.groupBy(*EVENT, "revision").agg(F.min("seq").alias("seq"))
    past = Window.partitionBy(*EVENT).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    revs = revs.withColumn("top", F.max("revision").over(past)).where("top is null or revision > top")
    applied = revs.select(*EVENT, "seq", F.lit(True).alias("applied"))
    # Highest stored revision before a clashing row decides between duplicate and rejected.
    reach = revs.select(*EVENT, F.col("seq").alias("rseq"), F.col("revision").alias("rrev"))
    clashing = j.where("clash is not null").select(*EVENT, "seq", "revision").join(reach, EVENT).groupBy(*EVENT, "seq", "revision").agg(
        F.max(F.when(F.col("rseq") < F.col("seq"), F.col("rrev"))).alias("held")).select(*EVENT, "seq", "held")
    j = j.join(applied, [*EVENT, "seq"], "left").join(clashing, [*EVENT, "seq"], "left")
    status = (F.when(F.col("outcome") == "rejected", "rejected")
              .when(F.col("clash").isNotNull() & (F.col("held") >= F.col("revision")), "duplicate")
              .when(F.col("clash").isNotNull(), "rejected").when(F.col("applied").isNull(), "duplicate")
              .when(F.col("outcome") == "quarantined", "quarantined")
              .when(F.col("type").isin("purchase", "intent", "erase") & F.coalesce("customer_id", "owner").isNull(), "pending_identity")
              .otherwise("accepted"))
    why = (F.when(F.col("outcome") == "rejected", F.col("reason")).when(F.col("status") == "duplicate", None)
           .when(F.col("status") == "rejected", F.col("clash")).when(F.col("status") == "quarantined", F.col("reason"))
           .when(F.col("status") == "pending_identity", F.when(F.col("type") == "erase", F.when(F.col("ambiguous"), "ambiguous_subject").otherwise("subject_not_found"))
                 .otherwise(F.when(F.col("ambiguous"), "ambiguous_identity").otherwise("identity_not_found")))
           .when(F.col("type").isin("purchase", "intent"), F.col("evidence")))
    return j.withColumn("status", status).withColumns({"reason": why, "customer_id": F.coalesce("owner", "customer_id")}).drop(
        "applied", "held", "clash", "first_course", "owner", "outcome")


def _looked_up(log: DataFrame, is_void: Column, targets: DataFrame) -> DataFrame:
    """``log`` beside the ``targets`` (partner_id, voids, ...) of its void events; all other rows look nothing up and stay spread."""
    from patronage.operators.identity import lookup_key
    wanted = log.withColumn("_target", lookup_key(is_void & F.col("voids").isNotNull(), F.col("voids"), log))
    return wanted.join(targets.withColumnRenamed("voids", "_target"), ["partner_id", "_target"], "left").drop("_target")


def judge_voids(log: DataFrame) -> DataFrame:
    """Void events need a stored target of the right type that arrived before them; else quarantine."""
    targets = log.where("status in ('accepted', 'pending_identity') and type in ('purchase', 'intent')").groupBy(
        "partner_id", F.col("event_id").alias("voids")).agg(F.min(F.struct("seq", "type")).alias("tgt"))
    is_void = F.col("type").isin("purchase.void", "intent.void") & (F.col("status") == "accepted")
    j = _looked_up(log, is_void, targets)
    fits = F.coalesce((F.col("tgt.seq") < F.col("seq")) & (F.concat("tgt.type", F.lit(".void")) == F.col("type")), F.lit(False))
    lost = is_void & ~fits
    return j.withColumns({"status": F.when(lost, "quarantined").otherwise(F.col("status")),
                          "reason": F.when(lost, "void_target_not_found").otherwise(F.col("reason"))}).drop("tgt").select(*log.columns)


def intake(raw: DataFrame, identities: DataFrame, customers: DataFrame, corrections: DataFrame | Callable | None = None, payload: list | None = None) -> DataFrame:
    """The event log: every arrival with its status and reason.

    ``corrections``: the rows that ``corrected`` takes, or a function that gives them from the log before any correction.
    ``payload``: the columns of parsed events that the caller reads beside ``DECIDES``, all if left out. Every event is parsed and
    checked whole, but the columns that nobody reads take no part in the seven joins of the log.
    """
    from patronage.operators.identity import resolve_subjects
    parsed, unread = parse_events(raw), []
    if payload is not None:
        read = {*DECIDES, *payload, *(CORRECTABLE if corrections is not None else [])}
        unread = [c for c in SUBJECT if c not in read]
        parsed = parsed.drop(*[c for c in parsed.columns if c not in read and c not in SUBJECT])
    parsed = settle(parsed)
    make = (F.col("outcome") == "ok") & (F.col("type") != "erase")

    def judged(arrivals):
        owned = settle(resolve_subjects(arrivals, identities, customers, make).drop(*unread))
        return settle(judge_voids(settle_revisions(owned)))

    if corrections is None:
        return judged(parsed)
    before = judged(parsed)
    held = before.where("status = 'quarantined'").select(*EVENT, "seq")
    corrections = corrections(before) if callable(corrections) else corrections
    return judged(parsed.unionByName(corrected(parsed.join(held, [*EVENT, "seq"], "left_semi"), corrections)))


def intake_summary(log: DataFrame) -> DataFrame:
    return log.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("accepted", "duplicate", "quarantined", "rejected", "pending_identity")])


def _current(log: DataFrame, kind: str) -> DataFrame:
    """The highest applied revision of each event of a kind."""
    live = log.where(F.col("status").isin("accepted", "pending_identity") & (F.col("type") == kind))
    rest = [c for c in log.columns if c not in (*EVENT, "revision", "seq")]
    top = live.groupBy(*EVENT).agg(F.max(F.struct("revision", "seq", F.struct(*rest).alias("r"))).alias("t"))
    return top.select(*EVENT, "t.revision", "t.seq", "t.r.*")


def _voided(log: DataFrame, kind: str) -> DataFrame:
    return log.where((F.col("type") == f"{kind}.void") & (F.col("status") == "accepted")).select(
        "partner_id", F.col("voids").alias("event_id"), F.lit(True).alias("_void")).distinct()


def _id(prefix: str, *parts) -> Column:
    return F.concat(F.lit(prefix), F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(26)))


def fold_purchases(log: DataFrame) -> tuple:
    """Purchase headers and lines of the log. Seats are decided here; the partner's flag is ignored."""
    cur = _current(log, "purchase").join(_voided(log, "purchase"), EVENT, "left")
    year, month = source_year_month(F.col("paid_at"), F.col("occurred_at"))
    pid = _id("pur_", "partner_id", "event_id")
    head = cur.select(
        pid.alias("purchase_id"), "customer_id", *EVENT, "external_payment_id", "amount", "currency", "paid_at", year.alias("year"),
        month.alias("month"), "sale_rep", F.when(F.col("_void"), "voided").otherwise("active").alias("status"))
    items = cur.select(pid.alias("purchase_id"), "customer_id", F.posexplode("lines").alias("line_no", "x")).select(
        _id("pit_", "purchase_id", F.col("line_no").cast("string")).alias("item_id"), "purchase_id", "customer_id",
        "x.course_code", "x.course_label", "x.kind", (counts_as_seat(F.col("x.kind")) & ~is_non_course(F.col("x.course_code"))).alias("counts_as_seat"),
        "x.session_label", "x.session_start", F.year("x.session_start").alias("session_year"))
    return head, items


def opinion_arrivals(log: DataFrame) -> DataFrame:
    """Opinions, their voids and erasures of known customers, as arrivals that ``precedence.replay`` runs through."""
    kind = F.when(F.col("type") == "intent", "intent").when(F.col("type") == "intent.void", "void").when(F.col("type") == "erase", "erase")
    rows = log.where("status = 'accepted'").withColumn("kind", kind).where("kind is not null and (kind = 'void' or customer_id is not null)")
    target = F.concat_ws("\x01", "partner_id", F.when(F.col("kind") == "void", F.col("voids")).otherwise(F.col("event_id")))
    return rows.select("seq", "kind", target.alias("event_id"), "customer_id", F.col("intent_course").alias("course_code"), F.col("intent_source").alias("source"),
                       F.col("intent_lock").alias("lock_kind"), F.col("occurred_at").alias("observed_at"), F.col("intent_confidence").alias("confidence"))


def judge_opinions(log: DataFrame) -> tuple:
    """(log, replayed): the log after staff precedence in arrival order, with voids and erasures taken into account.

    A refused opinion is rejected; a void whose opinion was refused, or erased before, has lost its target.
    """
    from patronage.operators.precedence import replay
    replayed = settle(replay(opinion_arrivals(log)))
    by_seq = replayed.groupBy("seq").agg(F.max("rejection").alias("_no"), F.max("hit").alias("_hit"))
    j = log.join(by_seq, "seq", "left")
    pending = log.where("type = 'intent' and status = 'pending_identity'").select("partner_id", F.col("event_id").alias("voids"), F.lit(True).alias("_waits")).distinct()
    is_void = (F.col("type") == "intent.void") & (F.col("status") == "accepted")
    j = _looked_up(j, is_void, pending)
    lost = is_void & ~F.coalesce("_hit", "_waits", F.lit(False))
    refused = (F.col("type") == "intent") & F.col("_no").isNotNull()
    out = j.withColumns({"status": F.when(refused, "rejected").when(lost, "quarantined").otherwise(F.col("status")),
                         "reason": F.when(refused, F.col("_no")).when(lost, "void_target_not_found").otherwise(F.col("reason"))})
    return out.select(*log.columns), replayed


def fold_intents(log: DataFrame, now: str) -> DataFrame:
    """Opinions of the log after staff precedence, voids, erasures and current-row marking."""
    from patronage.operators.intents import mark_superseded
    judged, replayed = judge_opinions(log)
    judged = settle(judged)
    gone = replayed.where("kind = 'erase'").groupBy("customer_id").agg(F.max("seq").alias("_gone"))
    cur = _current(judged, "intent").join(gone, "customer_id", "left").where("_gone is null or seq > _gone")
    rows = cur.select(
        _id("int_", "partner_id", "event_id").alias("intent_id"), "customer_id", F.col("intent_course").alias("course_code"), *EVENT,
        F.col("intent_status").alias("status"), F.col("intent_reason").alias("hesitation_reason"), F.col("intent_confidence").alias("confidence"),
        ((F.col("intent_source") == "ai") & (F.col("intent_confidence") < 0.6)).alias("below_threshold"), F.col("intent_source").alias("source"),
        F.col("intent_lock").alias("lock_kind"), F.col("intent_model").alias("model"), F.col("occurred_at").alias("observed_at"),
        F.timestamp_seconds("seq").alias("created_at"))
    stamped = rows.join(_voided(judged, "intent"), EVENT, "left").withColumn("voided_at", F.when(F.col("_void"), F.lit(now).cast("timestamp"))).drop("_void")
    return mark_superseded(stamped, now)


def erasure_report(log: DataFrame, replayed: DataFrame) -> DataFrame:
    """Every erasure with its outcome, and how many (customer, course) pairs lost opinions by it."""
    hit = replayed.where("kind = 'erase'").groupBy("seq").agg(F.count_if("hit").alias("pairs"))
    return log.where("type = 'erase'").join(hit, "seq", "left").select("seq", "customer_id", "status", "reason", F.coalesce("pairs", F.lit(0)).alias("pairs"))


def erase_requests(log: DataFrame) -> DataFrame:
    """Customers to erase; an unknown subject is never erased."""
    return log.where("type = 'erase' and status = 'accepted'").select("customer_id", F.col("erase_reason").alias("reason"))


def quarantine_table(log: DataFrame) -> DataFrame:
    """Latest reason and payload per event still in quarantine; the first payload is kept beside it."""
    last = F.struct("revision", "seq", "status", "reason", "raw")
    rows = log.where("status in ('quarantined', 'accepted', 'pending_identity')").groupBy(*EVENT).agg(
        F.max(last).alias("l"), F.min(F.struct("seq", "raw")).alias("f"))
    return rows.where("l.status = 'quarantined'").select(*EVENT, "l.revision", "l.reason", "l.raw", F.col("f.raw").alias("original_raw"))


def corrected(parsed: DataFrame, corrections: DataFrame) -> DataFrame:
    """Staff corrections as further parsed arrivals: the latest version of ``parsed``, the rows in quarantine, plus one revision.

    ``corrections``: partner_id, event_id, fix_seq (arrival order), fix_course, fix_status, fix_voids.
    """
    rest = [c for c in parsed.columns if c not in (*EVENT, "revision", "seq")]
    last = parsed.groupBy(*EVENT).agg(F.max(F.struct("revision", "seq", F.struct(*rest).alias("r"))).alias("t")).select(
        *EVENT, (F.col("t.revision") + 1).alias("revision"), "t.r.*")
    fix = F.col("fix_course")
    lines = F.transform("lines", lambda x: x.withField("course_code", fix).withField("course_label", fix))
    out = last.join(corrections, EVENT).withColumns({
        "seq": F.col("fix_seq"), "lines": F.when(fix.isNotNull(), lines).otherwise(F.col("lines")),
        "intent_course": F.coalesce(F.when(F.col("has_intent"), fix), "intent_course"),
        "intent_status": F.coalesce("fix_status", "intent_status"), "voids": F.coalesce("fix_voids", "voids"),
        "outcome": F.when(F.col("type") == "tag", "quarantined").otherwise("ok"),
        "reason": F.when(F.col("type") == "tag", F.col("reason"))})
    return _canonical(out).select(*parsed.columns)


def reconcile_pending(log: DataFrame, identities: DataFrame, customers: DataFrame) -> DataFrame:
    """Events stored without an owner, looked up again; ambiguous ones stay pending."""
    from patronage.operators.identity import resolve_subjects
    waiting = log.where("status = 'pending_identity' and type in ('purchase', 'intent')").groupBy(*EVENT).agg(
        F.max(F.struct("revision", "seq", "line_user_id", "phone", "email")).alias("t")).select(
        *EVENT, "t.line_user_id", "t.phone", "t.email")
    found = resolve_subjects(waiting, identities, customers)
    return found.withColumn("result", F.when(F.col("ambiguous"), "ambiguous").when(F.col("customer_id").isNotNull(), "resolved").otherwise("still_pending"))


def reconciled(log: DataFrame, found: DataFrame) -> DataFrame:
    """The log after a look-up: resolved events get their owner and count as accepted, the others stay as they are."""
    won = found.where("result = 'resolved'").select(*EVENT, F.col("customer_id").alias("_owner"), F.col("evidence").alias("_evidence"))
    j = log.join(won, EVENT, "left")
    hit = F.col("_owner").isNotNull() & (F.col("status") == "pending_identity")
    return j.withColumns({"customer_id": F.when(hit, F.col("_owner")).otherwise(F.col("customer_id")), "reason": F.when(hit, F.col("_evidence")).otherwise(F.col("reason")),
                          "status": F.when(hit, "accepted").otherwise(F.col("status"))}).select(*log.columns)


def reconcile_report(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("scanned"), *[F.count_if(F.col("result") == r).alias(r) for r in ("resolved", "still_pending", "ambiguous")])
