"""Form answers: rules given as data, normalisation and the fold of submissions into customers.

A rule list is one published form: a handful of fields that become column expressions, so a whole
table of submissions is checked in one scan.
"""
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from patronage.functions.text import birth_year_be, normalize_email, normalize_phone, number, strip
from patronage.functions.vocabulary import FIXED_LIMITS as L
from patronage.operators.numbering import numbered
from patronage.sources.store import spread


@dataclass(frozen=True)
class Rule:
    field_id: str
    type: str = "text"
    required: bool = False
    pattern: str | None = None
    min_length: int | None = None
    max_length: int | None = None
    min: float | None = None
    max: float | None = None
    min_items: int | None = None
    max_items: int | None = None
    options: tuple = ()
    visible_if: tuple | None = None  # (field, op, value) with op eq / ne / in / truthy
    bind_to: str | None = None
    extra: dict = field(default_factory=dict, compare=False)


class _Answers:
    """Per-field columns of the answers document, each read once: its JSON kind and its text."""

    @staticmethod
    def read(df: DataFrame, rules: list) -> DataFrame:
        names = list(dict.fromkeys([r.field_id for r in rules] + [r.visible_if[0] for r in rules if r.visible_if]))
        schema = ", ".join(f"`{n}` variant" for n in names)
        df = df.withColumn("_doc", F.from_json("answers", schema))
        df = df.withColumns({f"_v_{n}": F.col("_doc")[n] for n in names})
        df = df.withColumns({f"_k_{n}": F.schema_of_variant(f"_v_{n}") for n in names})
        return df.withColumns({f"_s_{n}": F.try_variant_get(f"_v_{n}", "$", "string") for n in names})

    @staticmethod
    def done(df: DataFrame) -> DataFrame:
        return df.drop(*[c for c in df.columns if c == "_doc" or c[:3] in ("_v_", "_k_", "_s_")])

    def kind(self, name: str) -> Column:
        return F.col(f"_k_{name}")

    def missing(self, name: str) -> Column:
        return self.kind(name).isNull()

    def text(self, name: str) -> Column:
        return F.when(self.kind(name) == "STRING", F.col(f"_s_{name}"))

    def any_text(self, name: str) -> Column:
        return F.col(f"_s_{name}")

    def items(self, name: str) -> Column:
        return F.when(self.kind(name).startswith("ARRAY"), F.try_variant_get(f"_v_{name}", "$", "array<string>"))

    def truth(self, name: str) -> Column:
        t = self.any_text(name)
        return F.coalesce((self.kind(name) != "VOID") & ~t.isin("", "false", "0"), self.kind(name).rlike("^(ARRAY|OBJECT)"), F.lit(False))


def _visible(a: _Answers, rule: Rule) -> Column:
    if rule.visible_if is None:
        return F.lit(True)
    name, op, value = rule.visible_if
    if op == "truthy":
        return a.truth(name)
    same = F.coalesce(a.any_text(name).isin([str(v) for v in value] if op == "in" else [str(value)]), F.lit(False))
    return ~same if op == "ne" else same


def _checks(a: _Answers, r: Rule) -> list:
    """(code, bad) pairs of one rule."""
    given, t = ~a.missing(r.field_id), a.text(r.field_id)
    s = strip(t)
    need = _visible(a, r) if r.required else F.lit(False)
    blank = F.coalesce(strip(a.any_text(r.field_id)) == "", F.lit(True)) if r.type not in ("checkbox", "consent") else F.lit(False)
    out = []
    if r.type == "checkbox":
        items = a.items(r.field_id)
        n = F.size(items)
        out.append(("type", given & items.isNull()))
        if r.min_items is not None:
            out.append(("min_items", n < r.min_items))
        if r.max_items is not None:
            out.append(("max_items", n > r.max_items))
        if r.options:
            out.append(("option", F.exists(items, lambda x: ~x.isin(list(r.options)))))
        out.append(("required", need & (F.coalesce(n, F.lit(0)) < max(1, r.min_items or 1))))
    elif r.type == "consent":
        out.append(("type", given & (a.kind(r.field_id) != "BOOLEAN")))
        out.append(("required", need & ~(F.coalesce(a.kind(r.field_id) == "BOOLEAN", F.lit(False)) & a.truth(r.field_id))))
    elif r.type == "number":
        raw = strip(a.any_text(r.field_id))
        n = F.when(raw == "", F.lit(0.0)).otherwise(number(raw))
        out.append(("type", given & n.isNull()))
        if r.min is not None:
            out.append(("min", n < r.min))
        if r.max is not None:
            out.append(("max", n > r.max))
        out.append(("required", need & (a.missing(r.field_id) | n.isNull())))
    else:
        out.append(("type", given & t.isNull()))
        if r.type == "tel":
            out.append(("phone", (s != "") & normalize_phone(s).isNull()))
        elif r.type == "email":
            out.append(("email", (s != "") & normalize_email(s).isNull()))
        elif r.type in ("select", "radio"):
            if r.options:
                out.append(("option", (t != "") & ~t.isin(list(r.options))))
        else:
            if r.min_length is not None:
                out.append(("min_length", F.length(s) < r.min_length))
            if r.max_length is not None:
                out.append(("max_length", F.length(s) > r.max_length))
            if r.pattern:
                out.append(("pattern", ~s.rlike(r.pattern)))
        out.append(("required", need & blank))
    return out


def validate(df: DataFrame, rules: list) -> DataFrame:
    """Add ``violations`` (array of field/code) to submissions with a JSON column ``answers``.

    Fields the form does not ask for are violations too, which blocks smuggled columns.
    """
    live = [r for r in rules if r.type not in ("readonly", "image")]
    df, a = _Answers.read(spread(df), live), _Answers()
    found = [F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(r.field_id).alias("field"), F.lit(code).alias("code")))
             for r in live for code, bad in _checks(a, r)]
    extra = F.array_except(F.json_object_keys("answers"), F.array(*[F.lit(r.field_id) for r in live]))
    unknown = F.transform(F.coalesce(extra, F.array().cast("array<string>")), lambda k: F.struct(k.alias("field"), F.lit("unknown").alias("code")))
    return df.withColumn("violations", F.concat(F.filter(F.array(*found), lambda v: v.isNotNull()), unknown)).transform(_Answers.done)


def violations(df: DataFrame, rules: list, key: str) -> DataFrame:
    """One row (key, field, code) per violation.

    ``explode_outer`` keeps the optimizer from testing the computed array in a filter of its own, which would be pushed
    below the parsed columns and parse the answers once more for every check.
    """
    v = validate(df, rules).select(key, F.explode_outer("violations").alias("v"))
    return v.where("v IS NOT NULL").select(key, "v.field", "v.code")


def valid_submissions(df: DataFrame, rules: list) -> DataFrame:
    """Submissions without violations; only these are folded.

    The test is a generated column: as a plain filter it would be pushed below the parsed columns, as in ``violations``.
    """
    tested = validate(df, rules).select(*df.columns, F.explode_outer(F.array(F.size("violations") == 0)).alias("_valid"))
    return tested.where("_valid").drop("_valid")


def normalize_answers(df: DataFrame, rules: list, current_year: int) -> DataFrame:
    """Add ``normal``: map of cleaned answers; blanks and missing fields are left out."""
    df, a = _Answers.read(df, rules), _Answers()
    pairs = []
    for r in rules:
        raw = a.any_text(r.field_id)
        if r.type == "tel":
            value = F.coalesce(normalize_phone(raw), raw)
        elif r.type == "email":
            value = F.coalesce(normalize_email(raw), raw)
        elif r.field_id == "birthYear" or r.bind_to == "customers.birthYear":
            value = F.coalesce(birth_year_be(raw, current_year).cast("string"), raw)
        elif r.type == "checkbox":
            value = F.to_json(a.items(r.field_id))
        else:
            value = strip(raw)
        pairs.append(F.when(~a.missing(r.field_id) & (F.coalesce(raw, F.lit("x")) != ""), F.struct(F.lit(r.field_id).alias("k"), value.alias("v"))))
    return df.withColumn("normal", F.map_from_entries(F.filter(F.array(*pairs), lambda p: p.isNotNull()))).transform(_Answers.done)


def summarize_answers(answers: Column) -> Column:
    """What a field holds without its value, for a map column of text or JSON lists."""
    def one(k, v):
        items = F.from_json(v, "array<string>")
        return (F.when(v.isNull() | (v == ""), "empty").when(v == "true", "ticked")
                .when(v.startswith("["), F.concat(F.size(items).cast("string"), F.lit(" items")))
                .otherwise(F.concat(F.length(v).cast("string"), F.lit(" characters"))))
    return F.transform_values(answers, one)


def cap_meta(keys: Column, meta: Column) -> Column:
    """Client metadata within its budget: short keys only, clipped values, in the given key order."""
    def step(acc, k):
        value = F.substring(F.element_at(meta, k), F.lit(1), F.least(F.lit(L["meta_value"]), acc["left"]))
        fits = (acc["left"] > 0) & (F.length(k) <= L["meta_key"]) & F.element_at(meta, k).isNotNull()
        entry = F.array(F.struct(k.alias("k"), value.alias("v")))
        return F.struct(F.when(fits, acc["left"] - F.length(value)).otherwise(acc["left"]).alias("left"),
                        F.when(fits, F.concat(acc["out"], entry)).otherwise(acc["out"]).alias("out"))
    zero = F.struct(F.lit(L["meta_budget"]).alias("left"), F.array().cast("array<struct<k:string,v:string>>").alias("out"))
    return F.map_from_entries(F.aggregate(keys, zero, step, lambda acc: acc["out"]))


def published(schemas: DataFrame) -> DataFrame:
    """Latest published version per form."""
    return schemas.where("status = 'published'").groupBy("form_id").agg(F.max_by("version", F.struct("published_at", "version")).alias("version"))


def version_conflicts(submissions: DataFrame, schemas: DataFrame) -> DataFrame:
    """``version_state`` per submission: ok, conflict (not published any more) or unknown."""
    s = schemas.select("form_id", "version", F.col("status").alias("_status"))
    state = F.when(F.col("_status").isNull(), "unknown").when(F.col("_status") != "published", "conflict").otherwise("ok")
    return submissions.join(s, ["form_id", "version"], "left").withColumn("version_state", state).drop("_status")


def number_revisions(submissions: DataFrame, stored: DataFrame) -> DataFrame:
    """Revision per customer after the stored ones, in (at, id) order.

    Submissions are numbered by ranges, so one busy customer spreads over many tasks.
    """
    base = stored.groupBy("customer_id").agg(F.max("revision").alias("_base"))
    placed = numbered(submissions, ["customer_id"], ["at", "submission_id"], "_pos").join(base, "customer_id", "left")
    return placed.withColumn("revision", (F.coalesce("_base", F.lit(0)) + F.col("_pos")).cast("int")).drop("_pos", "_base")


def first_submissions(submissions: DataFrame) -> DataFrame:
    """One row per idempotency key: the earliest; a resend adds no revision."""
    rest = [c for c in submissions.columns if c not in ("idempotency_key", "at", "submission_id")]
    g = submissions.groupBy("idempotency_key").agg(F.min(F.struct("at", "submission_id", *rest)).alias("r"))
    return g.select("idempotency_key", "r.*").select(*submissions.columns)


# --- Fixed values: answer field -> customer column ---
BOUND = {"title": "title", "heardFrom": "heard_from", "fullNameTh": "display_name", "nickname": "nickname", "fullNameEn": "full_name_en",
         "phone": "phone", "email": "email", "facebook": "facebook", "instagram": "instagram"}


def write_back(customers: DataFrame, valid: DataFrame, now: str, conflicts: DataFrame | None = None) -> DataFrame:
    """Customers after valid submissions (with ``normal`` and ``revision``): the newest given value of a field wins.

    Bound fields, birth year, consent, the completion tag, the submit count, last contact, dirty flags and, from
    ``conflicts`` (customer_id, candidate_id), the merge a person has to decide. Columns that are missing start empty.
    """
    empty = {"tags": "array<string>", "form_submits": "bigint", "last_interaction_at": "timestamp", "pending_merge": "string"}
    for c, kind in empty.items():
        if c not in customers.columns:
            customers = customers.withColumn(c, F.lit(None).cast(kind))
    latest = {}
    for name, column in BOUND.items():
        if column not in customers.columns:
            continue
        v = F.element_at("normal", name)
        ok = v.isNotNull()
        if name == "phone":
            ok = v.startswith("+")
        if name == "email":
            ok = v.contains("@")
        latest[column] = F.max(F.when(ok, F.struct("revision", v.alias("v"))))["v"].alias(f"_{column}")
    given = lambda name: F.element_at("normal", name)
    year = given("birthYear").try_cast("int")
    latest["birth_year"] = F.max(F.when(year.isNotNull(), F.struct("revision", year.alias("v"))))["v"].alias("_birth_year")
    agreed = given("consentDataProcessing") == "true"
    g = valid.groupBy("customer_id").agg(
        *latest.values(), F.max("at").alias("_at"), F.count("*").alias("_n"), F.max(agreed).alias("_agreed"),
        F.max(F.when(agreed, F.struct("revision", F.coalesce(given("consentMarketing") == "true", F.lit(False)).alias("v"))))["v"].alias("_marketing"))
    if conflicts is not None:
        g = g.join(conflicts.select("customer_id", F.col("candidate_id").alias("_candidate")), "customer_id", "left")
    else:
        g = g.withColumn("_candidate", F.lit(None).cast("string"))
    j = customers.join(g, "customer_id", "left")
    hit = F.col("_at").isNotNull()
    out = {c: F.coalesce(f"_{c}", c) for c in latest}
    out["form_submitted_at"] = F.greatest("form_submitted_at", "_at")
    out["last_interaction_at"] = F.greatest("last_interaction_at", F.when(hit, F.lit(now).cast("timestamp")))
    out["updated_at"] = F.when(hit, F.lit(now).cast("timestamp")).otherwise(F.col("updated_at"))
    none = F.array().cast("array<string>")
    out["tags"] = F.when(hit, F.sort_array(F.array_union(F.coalesce("tags", none), F.array(F.lit("form-completed"))))).otherwise(F.coalesce("tags", none))
    out["form_submits"] = F.coalesce("form_submits", F.lit(0)) + F.coalesce("_n", F.lit(0))
    out["pending_merge"] = F.coalesce("_candidate", "pending_merge")
    out["consent_data"] = F.col("consent_data") | F.coalesce("_agreed", F.lit(False))
    out["consent_marketing"] = F.coalesce("_marketing", "consent_marketing")
    out |= {c: F.col(c) | hit for c in ("sheet_dirty", "ai_dirty") if c in customers.columns}
    return j.withColumns(out).select(*customers.columns)


def current_answers(stored: DataFrame, profiles: DataFrame) -> DataFrame:
    """Stored fields (map ``fields``) overlaid by the latest revision's answers (map ``answers``)."""
    last = profiles.groupBy("customer_id").agg(F.max_by("answers", "revision").alias("_a"))
    empty = F.create_map().cast("map<string,string>")
    a = F.coalesce("_a", empty)
    base = F.map_filter("fields", lambda k, v: ~F.map_contains_key(a, k))
    return stored.join(last, "customer_id", "left").select("customer_id", F.map_concat(base, a).alias("answers"))
