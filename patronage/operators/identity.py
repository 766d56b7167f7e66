"""Who is it: merge chains, identity lookups, merges and duplicate-contact flags."""
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

CHILD_KEY = "customer_id"
# --- Fixed values: columns a surviving customer takes over when its own is blank ---
FILL_FORWARD = ["title", "heard_from", "display_name", "nickname", "full_name_en", "birth_year", "line_display_name", "picture_url",
                "facebook", "instagram", "phone", "email"]
FILLED = ["display_name", "nickname", "phone", "email", "birth_year", "consent_data"]


def lookup_key(wanted: Column, key: Column, df: DataFrame) -> Column:
    """``key`` for rows that look something up; for the others a value that nothing has, spread by the row's contents.

    Nulls would all go to one task of a join.
    """
    simple = [F.col(f"`{f.name}`") for f in df.schema.fields if not f.dataType.simpleString().startswith(("map", "variant"))]
    return F.coalesce(F.when(wanted, key), F.concat(F.lit("\x00"), F.xxhash64(*simple).cast("string")))


def follow_merges(customers: DataFrame, strict: bool) -> DataFrame:
    """Merged customer -> survivor over at most five hops.

    A broken or too long chain gives the last id reached, or null when ``strict``.
    """
    merged = customers.where("status = 'merged' and merged_into is not null").select("customer_id", "merged_into")
    step = merged.select(F.col("customer_id").alias("cur"), F.col("merged_into").alias("nxt"))
    out = merged.select("customer_id", F.col("merged_into").alias("cur"), F.lit(1).alias("hops"))
    for _ in range(4):
        out = out.join(step, "cur", "left").select(
            "customer_id", F.coalesce("nxt", "cur").alias("cur"), (F.col("hops") + F.col("nxt").isNotNull().cast("int")).alias("hops"))
    if not strict:
        return out.select("customer_id", F.col("cur").alias("survivor"))
    alive = customers.select(F.col("customer_id").alias("cur"), F.lit(True).alias("alive"))
    return out.join(alive, "cur", "left").select("customer_id", F.when((F.col("hops") < 5) & F.col("alive"), F.col("cur")).alias("survivor"))


def surviving(df: DataFrame, column: str, customers: DataFrame, strict: bool) -> DataFrame:
    """Replace ``column`` by the surviving customer; strict also blanks ids that do not exist."""
    chain = follow_merges(customers, strict).select(F.col("customer_id").alias(column), "survivor", F.lit(True).alias("_m"))
    out = df.join(chain, column, "left").withColumn("_to", F.when(F.col("_m"), F.col("survivor")).otherwise(F.col(column)))
    if strict:
        alive = customers.select(F.col("customer_id").alias("_to"), F.lit(True).alias("_alive"))
        out = out.join(alive, "_to", "left").withColumn("_to", F.when(F.col("_alive"), F.col("_to"))).drop("_alive")
    return out.withColumn(column, F.col("_to")).drop("_to", "_m", "survivor")


def _contact_owner(customers: DataFrame, column: str) -> DataFrame:
    """Active owners per contact: how many, and the smallest id."""
    return customers.where((F.col("status") == "active") & F.col(column).isNotNull()).groupBy(column).agg(
        F.count("*").alias(f"{column}_n"), F.min("customer_id").alias(f"{column}_owner"))


def resolve_events(events: DataFrame, identities: DataFrame, customers: DataFrame) -> DataFrame:
    """Identity triple, else any active owner of the phone, else of the e-mail, else a new customer.

    ``events``: provider, channel_id, external_id, phone, email and anything else. Adds customer_id,
    ``is_new`` and ``linked``. New ids are hashes of the triple, so equal events meet.
    """
    triple = ["provider", "channel_id", "external_id"]
    known = identities.groupBy(*triple).agg(F.min_by("customer_id", F.struct("linked_at", "customer_id")).alias("known_id"))
    known = surviving(known, "known_id", customers, strict=False)
    j = events.join(known, triple, "left")
    for contact in ("phone", "email"):
        # Only rows still without an owner look up a contact.
        key = lookup_key(F.col("known_id").isNull(), F.col(contact), events)
        owners = _contact_owner(customers, contact).withColumnRenamed(contact, f"_{contact}")
        j = j.withColumn(f"_{contact}", key).join(owners, f"_{contact}", "left")
    new_id = F.concat(F.lit("cus_"), F.left(F.sha2(F.concat_ws("|", *triple), 256), F.lit(26)))
    hint = F.coalesce("phone_owner", "email_owner")
    return j.withColumns({
        "customer_id": F.coalesce("known_id", hint, new_id), "is_new": F.col("known_id").isNull() & hint.isNull(),
        "linked": F.col("known_id").isNull() & hint.isNotNull()}).select(*events.columns, "customer_id", "is_new", "linked")


def resolve_login(logins: DataFrame, identities: DataFrame, customers: DataFrame) -> DataFrame:
    """Login user id to customer whatever the channel: the earliest link wins."""
    first = identities.where(F.col("provider").isin("line", "line_login")).groupBy("external_id").agg(
        F.min_by("customer_id", F.struct("linked_at", "customer_id")).alias("customer_id"))
    return logins.join(surviving(first, "customer_id", customers, strict=False), "external_id", "left")


def resolve_subjects(subjects: DataFrame, identities: DataFrame, customers: DataFrame, create_missing: Column | None = None) -> DataFrame:
    """Partner subjects: chat id, else the only active owner of the phone, else of the e-mail.

    Several owners are ambiguous and never guessed. ``subjects``: line_user_id, phone, email, normalised.
    """
    first = identities.where(F.col("provider").isin("line", "line_login")).groupBy(F.col("external_id").alias("line_user_id")).agg(
        F.min_by("customer_id", F.struct("linked_at", "customer_id")).alias("line_owner"))
    first = surviving(first, "line_owner", customers, strict=True).withColumn("by_line", F.lit(True))
    j = subjects.withColumn("_line", lookup_key(F.col("line_user_id").isNotNull(), F.col("line_user_id"), subjects))
    j = j.join(first.withColumnRenamed("line_user_id", "_line"), "_line", "left")
    make = F.lit(False) if create_missing is None else F.coalesce(create_missing & F.col("line_user_id").isNotNull() & F.col("by_line").isNull(), F.lit(False))
    j = j.withColumn("_make", make)
    open_ = F.col("by_line").isNull() & ~F.col("_make")
    for contact in ("phone", "email"):
        owners = _contact_owner(customers, contact).withColumnRenamed(contact, f"_{contact}")
        j = j.withColumn(f"_{contact}", lookup_key(open_, F.col(contact), subjects)).join(owners, f"_{contact}", "left")
    phone_hit, email_hit = F.col("phone_n").isNotNull(), F.col("phone_n").isNull() & F.col("email_n").isNotNull()
    new_id = F.concat(F.lit("cus_"), F.left(F.sha2(F.concat_ws("|", F.lit("line"), F.lit("partner"), "line_user_id"), 256), F.lit(26)))
    owner = (F.when(F.col("by_line"), F.col("line_owner")).when(F.col("_make"), new_id)
             .when(F.col("phone_n") == 1, F.col("phone_owner")).when(email_hit & (F.col("email_n") == 1), F.col("email_owner")))
    evidence = (F.when(F.col("by_line") | F.col("_make"), "line").when(F.col("phone_n") == 1, "phone_only")
                .when(email_hit & (F.col("email_n") == 1), "email_only"))
    ambiguous = (phone_hit & (F.col("phone_n") > 1)) | (email_hit & (F.col("email_n") > 1))
    return j.withColumns({"customer_id": owner, "evidence": evidence, "ambiguous": F.coalesce(ambiguous, F.lit(False)),
                          "created": F.col("_make")}).select(*subjects.columns, "customer_id", "evidence", "ambiguous", "created")


def pair_key(a: str, b: str) -> Column:
    return F.concat_ws(":", F.array_sort(F.array(a, b)))


def contact_conflicts(claims: DataFrame, customers: DataFrame, rejected: DataFrame, contacts: tuple = ("phone",)) -> DataFrame:
    """Another active customer with the claimed contact and a pair nobody rejected: customer_id, candidate_id.

    The two smallest owners of a contact are enough to find one that is not the claimant itself.
    """
    found = []
    for contact in contacts:
        owners = customers.where((F.col("status") == "active") & F.col(contact).isNotNull())
        low = owners.groupBy(contact).agg(F.min("customer_id").alias("o1"))
        second = (owners.join(low, contact).where("customer_id <> o1").groupBy(contact).agg(F.min("customer_id").alias("o2")))
        pick = low.join(second, contact, "left")
        found.append(claims.where(F.col(contact).isNotNull()).select("customer_id", contact).join(pick, contact).select(
            "customer_id", F.when(F.col("o1") != F.col("customer_id"), F.col("o1")).otherwise(F.col("o2")).alias("candidate_id")))
    both = found[0]
    for f in found[1:]:
        both = both.unionByName(f)
    best = both.where("candidate_id is not null").groupBy("customer_id").agg(F.min("candidate_id").alias("candidate_id"))
    bad = rejected.select(pair_key("a", "b").alias("pair")).distinct()
    return best.withColumn("pair", pair_key("customer_id", "candidate_id")).join(bad, "pair", "left_anti").drop("pair")


# ---- merges ---------------------------------------------------------------------------------

def pick_winner(pairs: DataFrame, customers: DataFrame, identities: DataFrame) -> DataFrame:
    """For pairs (a, b): more verified identities, then older, then more filled fields; ties keep a."""
    verified = identities.where("verified").groupBy("customer_id").agg(F.count("*").alias("v"))
    filled = sum((F.col(c).isNotNull().cast("int") if c != "consent_data" else F.coalesce(F.col(c), F.lit(False)).cast("int")) for c in FILLED)
    facts = customers.join(verified, "customer_id", "left").select("customer_id", F.struct(
        F.coalesce("v", F.lit(0)).alias("v"), (-F.unix_timestamp("created_at")).alias("age"), filled.alias("filled")).alias("s"))
    side = lambda x: facts.select(F.col("customer_id").alias(x), F.col("s").alias(f"s_{x}"))
    j = pairs.join(side("a"), "a").join(side("b"), "b")
    keep = F.col("s_a") >= F.col("s_b")
    return j.select(F.when(keep, F.col("a")).otherwise(F.col("b")).alias("winner_id"), F.when(keep, F.col("b")).otherwise(F.col("a")).alias("loser_id"))


def rekey(child: DataFrame, merges: DataFrame) -> DataFrame:
    """Move child rows of merged customers to their winner."""
    to = merges.select(F.col("loser_id").alias("customer_id"), "winner_id")
    return child.join(to, "customer_id", "left").withColumn("customer_id", F.coalesce("winner_id", "customer_id")).drop("winner_id")


def apply_merges(customers: DataFrame, merges: DataFrame, now: str) -> DataFrame:
    """Customers after merges: winners take over what they miss, losers become tombstones.

    Sources and tags unite, counters add up, consent is filled as a whole where the winner has none, first and last contact
    widen, and both sides become dirty; of the columns that customers may lack, those present are written.
    """
    ts, none = F.lit(now).cast("timestamp"), F.array().cast("array<string>")
    have = lambda *names: [c for c in names if c in customers.columns]
    fill, counters, consent = have(*FILL_FORWARD), have("milestones", "form_submits"), have("consent_data", "consent_marketing")
    own = {"sources": F.array_compact(F.array_union(F.array("source_channel"), F.coalesce("sources", none) if have("sources") else none))}
    own |= {c: F.coalesce(c, none) for c in have("tags")}
    losers = customers.join(merges.withColumnRenamed("loser_id", "customer_id"), "customer_id")
    gains = [F.min(F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.struct("customer_id", c)))[c].alias(f"_f_{c}") for c in fill]
    gains += [F.array_distinct(F.flatten(F.collect_set(x))).alias(f"_u_{c}") for c, x in own.items()]
    gains += [F.sum(F.coalesce(c, F.lit(0))).alias(f"_n_{c}") for c in counters]
    gains += [F.max("last_interaction_at").alias("_last")] if have("last_interaction_at") else []
    given = F.coalesce(*[F.col(c).cast("string") for c in consent]).isNotNull() if consent else None
    gains += [F.min(F.when(given, F.struct("customer_id", *consent))).alias("_consent")] if consent else []
    gained = losers.groupBy(F.col("winner_id").alias("customer_id")).agg(*gains, F.min("first_interaction_at").alias("_first"), F.lit(True).alias("_won"))
    tomb = merges.select(F.col("loser_id").alias("customer_id"), F.col("winner_id").alias("_into"))
    j = customers.join(gained, "customer_id", "left").join(tomb, "customer_id", "left")
    lost, won = F.col("_into").isNotNull(), F.col("_won").isNotNull()
    blank = lambda c: F.col(c).isNull() | (F.col(c).cast("string") == "")
    out = {c: F.when(blank(c) & F.col(f"_f_{c}").isNotNull(), F.col(f"_f_{c}")).otherwise(F.col(c)) for c in fill}
    out |= {c: F.array_sort(F.array_union(x, F.coalesce(f"_u_{c}", none))) for c, x in own.items()}
    out |= {c: F.when(won, F.coalesce(c, F.lit(0)) + F.col(f"_n_{c}")).otherwise(F.col(c)) for c in counters}
    out |= {c: F.when(given, F.col(c)).otherwise(F.col("_consent")[c]) for c in consent}
    out |= {"last_interaction_at": F.greatest("last_interaction_at", "_last")} if have("last_interaction_at") else {}
    out |= {c: F.when(lost | won, True).otherwise(F.col(c)) for c in have("sheet_dirty", "ai_dirty")}
    out.update({
        "status": F.when(lost, "merged").otherwise(F.col("status")), "merged_into": F.coalesce("_into", "merged_into"),
        "first_interaction_at": F.least("first_interaction_at", "_first"),
        "updated_at": F.when(lost | won, ts).otherwise(F.col("updated_at"))})
    return j.withColumns(out).select(*dict.fromkeys([*customers.columns, "sources"]))


def match_candidates_for(events: DataFrame, customers: DataFrame, limit: int = 20) -> DataFrame:
    """Customers a reviewer may pick for an event: same phone, e-mail or exact name, with what matched.

    A customer found by name alone ranks by id, so beyond the first ``limit`` customers of a name only those with a second
    match can be shown: a frequent name is never joined whole.
    """
    live = customers.where("status = 'active'")
    named = live.where("display_name is not null").select(F.col("customer_id").alias("candidate_id"), "display_name")
    low = Window.partitionBy("display_name").orderBy("candidate_id")
    first = named.withColumn("_r", F.row_number().over(low)).where(F.col("_r") <= limit).drop("_r")
    names = events.where("display_name is not null").select("event_id", "display_name")
    contacts = [events.where(F.col(c).isNotNull()).select("event_id", c).join(
        live.select(F.col("customer_id").alias("candidate_id"), c, F.col("display_name")), c).select("event_id", "candidate_id", "display_name", F.lit(c).alias("by"))
        for c in ("phone", "email")]
    found = contacts[0].unionByName(contacts[1])
    kinds = ["email", "name", "phone"]
    bit = reduce(lambda c, i: c.when(F.col("by") == kinds[i], 1 << i), range(1, len(kinds)), F.when(F.col("by") == kinds[0], 1))
    by_name = names.join(first, "display_name").select("event_id", "candidate_id").unionByName(
        found.join(names, ["event_id", "display_name"]).select("event_id", "candidate_id"))
    # Matches are bits, and an event's rows meet once: for their candidates and for the ranks.
    rows = found.drop("display_name").unionByName(by_name.withColumn("by", F.lit("name"))).repartition("event_id").groupBy("event_id", "candidate_id").agg(
        F.bit_or(bit).alias("_by"))
    rows = rows.select("event_id", "candidate_id", F.array_compact(F.array(*[F.when(F.col("_by").bitwiseAND(1 << i) != 0, k) for i, k in enumerate(kinds)])).alias("matched_by"))
    best = Window.partitionBy("event_id").orderBy(F.desc(F.size("matched_by")), "candidate_id")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)
