"""Field coercion, type checks and document validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Date formats that a date field may have.
DATE_FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "yyyy/MM/dd", "dd MMM yyyy")


def as_boolean(v: Column) -> Column:
    t = F.lower(F.trim(v))
    return F.when(t.isin("true", "yes", "y", "1"), True).when(t.isin("false", "no", "n", "0"), False)


def as_number(v: Column) -> Column:
    return F.regexp_replace(F.trim(v), ",", "").try_cast("double")


def as_date(v: Column) -> Column:
    return F.coalesce(*[F.try_to_date(F.trim(v), f) for f in DATE_FORMATS])


# Words of truth that a field may hold, and dates as they are written.
TRUE, FALSE = ("true", "yes", "y", "1", "on"), ("false", "no", "n", "0", "off")


def coerced(v: Column, kind: Column) -> Column:
    """The value as its type writes it, or null: booleans as true and false, the first number in the text, dates that are dates, other texts trimmed."""
    t = F.nullif(F.trim(v), F.lit(""))
    truth = F.when(F.lower(t).isin(*TRUE), "true").when(F.lower(t).isin(*FALSE), "false")
    number = F.nullif(F.regexp_extract(F.replace(t, F.lit(","), F.lit("")), r"[-+]?\d+(?:\.\d+)?", 0), F.lit(""))
    return F.when(kind == "boolean", truth).when(kind == "number", number).when(kind.isin("date", "datetime"), F.when(as_date(t).isNotNull(), t)).otherwise(t)


def enum_value(v: Column, values: list[str]) -> Column:
    """The allowed value that is the same but for case; without any, the text itself."""
    t = F.nullif(F.trim(v), F.lit(""))
    return t if not values else F.coalesce(*[F.when(F.lower(t) == x.lower(), F.lit(x)) for x in values])


def reason(kind: Column, v: Column) -> Column:
    """null if the value has its type, else a reason code."""
    bad = lambda test, code: F.when(test.isNull(), code)
    return F.when(kind == "boolean", bad(as_boolean(v), "invalid_boolean")).when(kind == "number", bad(as_number(v), "invalid_number")).when(kind.isin("date", "datetime"), bad(as_date(v), "invalid_date"))


def validate(definitions: DataFrame, extracted: DataFrame, least: float = 0.7) -> DataFrame:
    """definitions (doc_id, field_name, type, required), extracted (doc_id, field_name, value, confidence): lists and a status."""
    m = definitions.join(extracted, ["doc_id", "field_name"], "left")
    has = F.coalesce(F.trim("value") != "", F.lit(False))
    missing = F.when(F.col("required") & ~has, F.col("field_name"))
    invalid = F.when(has & reason(F.col("type"), F.col("value")).isNotNull(), F.col("field_name"))
    low = F.when(has & (F.col("confidence") < least), F.col("field_name"))
    g = m.groupBy("doc_id").agg(*[F.array_join(F.array_sort(F.collect_list(x)), ",").alias(n) for n, x in (("missing", missing), ("invalid", invalid), ("low_confidence", low))])
    return g.withColumn("status", F.when((F.col("missing") != "") | (F.col("invalid") != ""), "FAIL").when(F.col("low_confidence") != "", "WARNING").otherwise("PASS"))


def label_pairs(docs: DataFrame, max_label: int = 64, max_words: int = 6) -> DataFrame:
    """doc_id, label, value, pos of 'Label: value' lines: the first of each label, label and value different."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    label, value = F.trim(F.regexp_extract("line", r"^\s*([A-Za-z][^:\n]*?)\s*[:=]\s*(\S.*?)\s*$", 1)), F.regexp_extract("line", r"^\s*([A-Za-z][^:\n]*?)\s*[:=]\s*(\S.*?)\s*$", 2)
    rows = lines.select("doc_id", "pos", label.alias("label"), value.alias("value")).where((F.length("label") > 0) & (F.length("label") <= max_label) & (F.size(F.split("label", " ")) <= max_words))
    rows = rows.where(F.lower("label") != F.lower("value"))
    return rows.groupBy("doc_id", F.lower("label").alias("key")).agg(F.min(F.struct("pos", "label", "value")).alias("m")).select("doc_id", "m.label", "m.value", "m.pos")


def best_candidates(rows: DataFrame) -> DataFrame:
    """doc_id, field_name: the candidate with the highest confidence, the first of equals."""
    return rows.groupBy("doc_id", "field_name").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "pos", "value")).alias("m")).select("doc_id", "field_name", "m.value", (-F.col("m.c")).alias("confidence"))
