"""Named queries for the sheet import and the sheet profile."""
from pyspark.sql import functions as F

from patronage.catalog import query
from patronage.functions import vocabulary as V
from patronage.operators import sheets as X
from patronage.operators.scrub import flag_shared_slips, redact_columns
from patronage.sources.bindings import CELLS
from patronage.sources.store import run_manifest


def sheet_rows(t):
    field = {"paidAt": "paid_text", "amount": "amount_text", "slipNo": "slip_text", "fullNameTh": "name_text", "phone": "phone_text",
             "email": "email_text", "age": "age_text", "saleRep": "rep_text"}
    cells = F.array(F.struct(F.lit(" Inner").alias("label"), F.col("inner_cell").alias("value")),
                    F.struct(F.lit("MC Pro#5").alias("label"), F.col("pro_cell").alias("value")))
    entries = F.array(*[F.struct(F.lit(k).alias("k"), F.col(v).alias("v")) for k, v in field.items()])
    return t.sheet_flat.select("sheet", "row_number", F.map_from_entries(entries).alias("fields"), cells.alias("courses"))


# Expected reading of each sample cell: kind, start month and day, precision ('' = none). {y} is the sheet year.
EXPECT = [("enrolled", "{y}-05-04", "day"), ("relearn", "{y}-09-06", "day"), ("free", "{y}-02-21", "day"), ("waitlist", None, "none"),
          ("refund", None, "none"), ("enrolled", "2026-11-09", "day"), ("enrolled", "{y}-12-01", "month"), (None, None, None),
          ("transfer", "{y}-04-22", "day"), ("unknown", None, "none"), ("adjustment", None, "none"), ("enrolled", "{y}-03-02", "day"),
          ("enrolled", "{y}-03-28", "day"), ("enrolled", "{y}-07-19", "day"), ("enrolled", "{y}-08-14", "day")]
K = "(row_number - 2)"


def _expect(i):
    parts = []
    for k, e in enumerate(EXPECT):
        v = e[i]
        v = "NULL" if v is None else "'" + v.replace("{y}", "' || right(sheet, 4) || '") + "'"
        parts.append(f"WHEN {k} THEN {v}")
    return f"CASE {K} % {len(CELLS)} {' '.join(parts)} END"


ROWS = f"""r AS (SELECT *, TRY_CAST(paid_text AS DATE) AS paid_at, CASE WHEN amount_text <> 'free' THEN CAST(trim(amount_text) AS DECIMAL(18,2)) END AS amount,
      {_expect(0)} AS kind, CAST({_expect(1)} AS DATE) AS start, {_expect(2)} AS prec, replace(name_text, '  ', ' ') AS name,
      CASE WHEN length(phone_text) = 10 AND substr(phone_text, 2, 1) <> '0' AND substr(phone_text, 2, 1) <> '1' THEN '+66' || substr(phone_text, 2) END AS phone,
      lower(email_text) AS email FROM sheet_flat),
  live AS (SELECT *, coalesce(phone, email, 'row:' || sheet || ':' || row_number) AS person_key FROM r
      WHERE paid_at IS NOT NULL OR amount IS NOT NULL OR slip_text IS NOT NULL OR kind IS NOT NULL)"""
PID = "'lgp_' || left(sha256(person_key), 26)"
LPY = "'lpy_' || left(sha256(sheet || '|' || row_number), 26)"


@query("course_cells", f"""WITH {ROWS} SELECT sheet, row_number, kind, start AS session_start, prec AS session_precision, kind = 'enrolled' AS counts_as_seat,
    {K} % {len(CELLS)} = 13 AS substitute, CASE WHEN {K} % {len(CELLS)} = 10 THEN 'IN-7001-00042' END AS ref_slip FROM r WHERE kind IS NOT NULL""")
def course_cells(t):
    return X.row_cells(X.parse_rows(sheet_rows(t))).where("course_code is not null").select(
        "sheet", "row_number", "kind", "session_start", "session_precision", "counts_as_seat", "substitute", "ref_slip")


@query("import_people", f"""WITH {ROWS} SELECT {PID} AS person_id, arg_min(name, (sheet, row_number)) FILTER (name IS NOT NULL) AS display_name, min(phone) AS phone,
    arg_min(email, (sheet, row_number)) FILTER (email IS NOT NULL) AS email, min(paid_at) AS first_paid_at, max(paid_at) AS last_paid_at,
    sum(coalesce(amount, 0)) AS total_paid, count(*) AS payment_count, count(CASE WHEN kind = 'enrolled' THEN 1 END) AS seat_count FROM live GROUP BY person_key""")
def import_people(t):
    return X.import_rows(sheet_rows(t))["people"].select("person_id", "display_name", "phone", "email", "first_paid_at", "last_paid_at",
                                                         "total_paid", "payment_count", "seat_count")


@query("import_payments", f"""WITH {ROWS} SELECT {LPY} AS payment_id, {PID} AS person_id, slip_text AS slip_no, amount, paid_at,
    CAST(right(sheet, 4) AS INT) AS year, rep_text AS sale_rep, slip_text IS NOT NULL AND count(*) OVER (PARTITION BY slip_text) > 1 AS slip_shared FROM live""")
def import_payments(t):
    return flag_shared_slips(X.import_rows(sheet_rows(t))["payments"].drop("sheet", "row_number"))


@query("import_enrollments", f"""WITH {ROWS} SELECT {LPY} AS payment_id, {PID} AS person_id, 'INNER' AS course_code, kind, kind = 'enrolled' AS counts_as_seat
    FROM live WHERE kind IS NOT NULL""")
def import_enrollments(t):
    return X.import_rows(sheet_rows(t))["enrollments"].select("payment_id", "person_id", "course_code", "kind", "counts_as_seat")


@query("import_manifest", f"""WITH {ROWS} SELECT 'run-1' AS run_id, (SELECT count(DISTINCT person_key) FROM live) AS people, (SELECT count(*) FROM live) AS payments,
    (SELECT count(*) FROM live WHERE kind IS NOT NULL) AS enrollments, (SELECT count(*) FROM r) - (SELECT count(*) FROM live) AS skipped""")
def import_manifest(t):
    d = X.import_rows(sheet_rows(t))
    return run_manifest(d["people"], d["payments"], d["enrollments"], d["skipped"], "run-1")


@query("import_unknown_headers", "SELECT 'MC Pro#5' AS label")
def unknown_headers(t):
    return X.import_rows(sheet_rows(t))["unknown_headers"]


GRID_HEAD = ["No.", "วัน/เดือน/ปี ที่ชำระ", "ชื่อ - นามสกุล", "เบอร์โทร", "Email", "ยอดชำระ", "Sale", "Inner", "Commu"]


def grid(t):
    """The flat rows as a spreadsheet grid with a title row and a header row on top."""
    body = t.sheet_flat.select("sheet", "row_number", F.array(
        F.col("row_number").cast("string"), "paid_text", "name_text", "phone_text", "email_text", "amount_text", "rep_text", "inner_cell", "pro_cell").alias("cells"))
    sheets = t.sheet_flat.select("sheet").distinct()
    title = sheets.select("sheet", F.lit(0).cast("long").alias("row_number"), F.array(F.lit("Sales")).alias("cells"))
    head = sheets.select("sheet", F.lit(1).cast("long").alias("row_number"), F.array(*[F.lit(h) for h in GRID_HEAD]).alias("cells"))
    return body.unionByName(title).unionByName(head)


@query("extract_sheet_rows", """SELECT sheet, row_number, paid_text AS paid, name_text AS name, phone_text AS phone, rep_text AS rep,
    (inner_cell <> '')::INT + (pro_cell IS NOT NULL)::INT AS courses FROM sheet_flat""")
def extract_rows(t):
    f = lambda n: F.element_at("fields", n)
    return X.extract_rows(grid(t)).select("sheet", "row_number", f("paidAt").alias("paid"), f("fullNameTh").alias("name"),
                                          f("phone").alias("phone"), f("saleRep").alias("rep"), F.size("courses").alias("courses"))


PROF = ROWS + """, p AS (SELECT *, CASE WHEN TRY_CAST(age_text AS INT) BETWEEN 10 AND 90 THEN CAST(age_text AS INT) END AS page FROM r WHERE name IS NOT NULL)"""


@query("sheet_profile_fill", f"""WITH {PROF} SELECT sheet, count(*) AS "rows", round(count(email) / count(*), 4) AS fill_email, round(count(phone) / count(*), 4) AS fill_phone,
    round(count(page) / count(*), 4) AS fill_profile_age, round(count(amount) / count(*), 4) AS fill_amount, round(count(paid_at) / count(*), 4) AS fill_paid_at,
    round(count(slip_text) / count(*), 4) AS fill_slip_no, count(DISTINCT phone) AS distinct_phones,
    0.0::DOUBLE AS fill_full_name_en, 0.0::DOUBLE AS fill_nickname, 0.0::DOUBLE AS fill_social_handle FROM p GROUP BY 1""")
def profile_fill(t):
    return X.sheet_fill(X.profiled(sheet_rows(t)))


@query("sheet_profile_quantiles", f"""WITH {PROF}, v AS (SELECT sheet, 'age' AS measure, CAST(page AS DOUBLE) AS v FROM p WHERE page IS NOT NULL
      UNION ALL SELECT sheet, 'amount', CAST(amount AS DOUBLE) FROM p WHERE amount IS NOT NULL),
    o AS (SELECT *, row_number() OVER (PARTITION BY sheet, measure ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY sheet, measure) AS n FROM v)
    SELECT sheet, measure, min(v) AS min, max(CASE WHEN i = n // 4 THEN v END) AS p25, (max(CASE WHEN i = (n - 1) // 2 THEN v END) + max(CASE WHEN i = n // 2 THEN v END)) / 2 AS median,
      max(CASE WHEN i = n * 3 // 4 THEN v END) AS p75, max(v) AS max, round(avg(v), 2) AS mean FROM o GROUP BY 1, 2""")
def profile_quantiles(t):
    p = X.profiled(sheet_rows(t))
    age = X.index_quantiles(p, "sheet", "profile_age", 10).withColumn("measure", F.lit("age"))
    return age.unionByName(X.index_quantiles(p, "sheet", "amount", 1000).withColumn("measure", F.lit("amount")))


EDGE = V.AMOUNT_EDGES
BUCKET = "CASE " + " ".join(f"WHEN amount >= {a} AND amount < {b} THEN '{a}-{b}'" for a, b in zip(EDGE, EDGE[1:])) + " END"


@query("sheet_profile_histograms", f"""WITH {PROF}, h AS (SELECT sheet, 'amount' AS measure, {BUCKET} AS bucket FROM p WHERE amount IS NOT NULL
      UNION ALL SELECT sheet, 'month', CAST(month(paid_at) AS STRING) FROM p WHERE paid_at IS NOT NULL
      UNION ALL SELECT sheet, 'courses_per_row', CAST((inner_cell <> '')::INT + (pro_cell IS NOT NULL)::INT AS STRING) FROM p
      UNION ALL SELECT sheet, 'course_hits', ' Inner' FROM p WHERE inner_cell <> ''
      UNION ALL SELECT sheet, 'course_hits', 'MC Pro#5' FROM p WHERE pro_cell IS NOT NULL
      UNION ALL SELECT sheet, 'course_sessions', ' Inner / ' || CASE WHEN contains(inner_cell, 'คุณ') THEN '«ข้อความอื่น»' ELSE inner_cell END FROM p WHERE inner_cell <> ''
      UNION ALL SELECT sheet, 'course_sessions', 'MC Pro#5 / ' || pro_cell FROM p WHERE pro_cell IS NOT NULL
      UNION ALL SELECT sheet, 'sale_rep', rep_text FROM p
      UNION ALL SELECT sheet, 'repeat_by_phone', CAST(count(*) AS STRING) FROM p WHERE phone IS NOT NULL GROUP BY sheet, phone
      UNION ALL SELECT sheet, 'slip_reuse', CAST(count(*) AS STRING) FROM p WHERE slip_text IS NOT NULL GROUP BY sheet, slip_text)
    SELECT sheet, measure, bucket, count(*) AS n FROM h GROUP BY ALL""")
def profile_histograms(t):
    return X.sheet_histograms(X.profiled(sheet_rows(t)))


WORD = "[A-Za-z0-9_]"
SP = r"[-\s]"


def _redacted(c):
    rx = [(rf"\+?66{SP}?[0-9]{{1,2}}{SP}?[0-9]{{3}}{SP}?[0-9]{{4}}\b", "[PHONE]"), (rf"\b0[0-9]{{1,2}}{SP}?[0-9]{{3}}{SP}?[0-9]{{4}}\b", "[PHONE]"),
          (r"(?i)\b[^\s@,;]+@[^\s@,;]+\.[a-z]{2,}\b", "[EMAIL]"), (r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "[JWT]"),
          (rf"\b[0-9]{SP}?[0-9]{{4}}{SP}?[0-9]{{5}}{SP}?[0-9]{{2}}{SP}?[0-9]\b", "[NATIONAL_ID]")]
    for pattern, mark in rx:
        c = f"regexp_replace({c}, '{pattern}', '{mark}', 'g')"
    return c


@query("redact_documents", f"SELECT doc_id, {_redacted('text')} AS text FROM documents")
def redact_documents(t):
    return redact_columns(t.documents.select("doc_id", "text"), "text")


@query("redact_conversations", f"SELECT conv_id, turn, {_redacted('text')} AS text FROM conversations")
def redact_conversations(t):
    return redact_columns(t.conversations.select("conv_id", "turn", "text"), "text")
