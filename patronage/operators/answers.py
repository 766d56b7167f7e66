"""Audit of written answers: every number in a text must come from its result."""
from pyspark.sql import Column, DataFrame, functions as F


def _plain(n: Column) -> Column:
    text = n.cast("decimal(38,6)").cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def _fixed(n: Column, places: int) -> Column:
    return F.round(n.cast("decimal(38,10)"), places).cast(f"decimal(38,{places})").cast("string")


def _forms(n: Column) -> Column:
    """Every way a value may be written."""
    a = F.abs(n)
    whole = F.floor(a + 0.5)
    pct = a * 100
    return F.concat(
        F.array(_plain(n), _plain(a), whole.cast("string"), _fixed(a, 1), _fixed(a, 2), F.format_number(whole, 0)),
        F.when(a <= 1, F.array(F.floor(pct + 0.5).cast("string"), _fixed(pct, 1), _fixed(pct, 2))).otherwise(F.array().cast("array<string>")))


def audit_answers(insights: DataFrame) -> DataFrame:
    """Add ``invented`` (numbers without a source) and ``verified``.

    ``insights``: answer, rows (array of key/label/value/share/delta), total, rows_scanned, start, end.
    """
    values = F.concat(F.transform("rows", lambda r: r["value"].cast("double")), F.transform("rows", lambda r: r["share"].cast("double")),
                      F.transform("rows", lambda r: r["delta"].cast("double")),
                      F.array(F.col("total").cast("double"), F.size("rows").cast("double"), F.col("rows_scanned").cast("double")))
    df = insights.withColumn("_values", F.array_distinct(F.filter(values, lambda v: v.isNotNull())))
    df = df.withColumn("_allowed", F.array_distinct(F.flatten(F.transform("_values", _forms))))
    df = df.withColumn("_tokens", F.array_distinct(F.regexp_extract_all("answer", F.lit(r"([0-9][0-9,]*(?:\.[0-9]+)?)"), F.lit(1))))
    df = df.withColumn("_known", F.concat(F.transform("rows", lambda r: r["key"]), F.transform("rows", lambda r: r["label"]),
                                          F.array(F.concat_ws(" ", "start", "end"))))

    def known(token):
        plain = F.regexp_replace(token, ",", "")
        short = F.when(plain.contains("."), F.regexp_replace(plain, r"\.?0+$", "")).otherwise(plain)
        listed = F.exists(F.array(token, plain, short), lambda x: F.array_contains(F.col("_allowed"), x))
        return listed | token.rlike("^(19|20)[0-9]{2}$") | F.exists("_known", lambda k: k.contains(token))

    df = df.withColumn("invented", F.filter("_tokens", lambda t: ~F.coalesce(known(t), F.lit(False))))
    return df.withColumn("verified", F.size("invented") == 0).drop("_values", "_allowed", "_tokens", "_known")


def insight_rows(rows: DataFrame, meta: DataFrame, question: str, answer: str) -> DataFrame:
    """One audit row of a finished metric: its rows as an array beside the metadata, ready to append.

    A metric result is a report of a few hundred groups, so one array holds it.
    """
    cell = F.struct("key", "label", F.col("value").cast("double").alias("value"), "share",
                    (F.col("delta").cast("double") if "delta" in rows.columns else F.lit(None).cast("double")).alias("delta"))
    packed = rows.agg(F.array_sort(F.collect_list(cell)).alias("rows"), F.sum("value").cast("double").alias("total"))
    m = meta.select(F.struct("metric", F.col("from").alias("start"), F.col("to").alias("end"), "rows_scanned").alias("m")).scalar()
    return packed.withColumn("_m", m).select("rows", "total", "_m.*", F.lit(question).alias("question"), F.lit(answer).alias("answer"))
