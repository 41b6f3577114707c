"""De-identification with stable ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventpulse.functions.numbers import padded
from eventpulse.functions.text import EMAIL, PHONE, as_column
from eventpulse.operators.numbering import numbered


def ordinal_ids(df: DataFrame, keys: list[str], prefix: str, out: str, digits: int = 4) -> DataFrame:
    """`prefix0001` by sorted distinct key; a blank key has ""."""
    text = F.concat_ws("\u0001", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    keyed = df.withColumn("_key", text)
    names = keyed.select("_key").distinct().filter(F.trim(F.replace("_key", F.lit("\u0001"), F.lit(""))) != "")
    ids = numbered(names, [], ["_key"], "_number")
    shown = F.concat(F.lit(prefix), padded(F.col("_number"), digits))
    return keyed.join(ids, "_key", "left").withColumn(out, F.when(F.col("_number").isNull(), "").otherwise(shown)).drop("_key", "_number")


def assign_stable_ids(facts: DataFrame, existing: DataFrame, person: list[str], record: str, seen: str, prefix: str = "P") -> DataFrame:
    """Adds person_id: one id a person, over all tables that facts unites. An id published for one of the person's records
    (existing: record, person_id) stays; new persons are numbered after the largest, in the order first seen."""
    known = facts.select(*person, record).join(existing, record).groupBy(*person).agg(F.min("person_id").alias("person_id"))
    largest = existing.agg(F.coalesce(F.max(F.substring("person_id", len(prefix) + 1, 20).cast("long")), F.lit(0)).alias("_largest"))
    new = facts.join(known, person, "left_anti").groupBy(*person).agg(F.min(seen).alias("_seen"))
    new = numbered(new, [], ["_seen", *person], "_number").join(F.broadcast(largest))
    new = new.select(*person, F.concat(F.lit(prefix), padded(F.col("_largest") + F.col("_number"), 6)).alias("person_id"))
    return facts.join(known.unionByName(new), person, "left")


def mask_record(df: DataFrame, raw: str, name: str, phone: str, person_id: str) -> DataFrame:
    """Name and phone replaced; in the raw text of five lines or more lines 4 and 5, else the name and any phone pattern."""
    lines = F.split(F.coalesce(F.col(raw), F.lit("")), "\n")
    masked = F.transform(lines, lambda x, i: F.when(i == 3, F.col(person_id)).when(i == 4, F.lit("[phone]")).otherwise(x))
    plain = F.regexp_replace(F.when(F.col(name) == "", F.col(raw)).otherwise(F.replace(F.col(raw), F.col(name), F.col(person_id))), PHONE, "[phone]")
    return df.withColumns({raw: F.when(F.size(lines) >= 5, F.array_join(masked, "\n")).otherwise(plain), name: F.col(person_id), phone: F.lit("[phone]")})


def deident_audit(df: DataFrame, id_column: str, id_pattern: str, phone: str, raw: str) -> DataFrame:
    """Rows with a malformed id, rows with an unmasked phone, remaining phone and e-mail patterns."""
    return df.agg(
        F.count("*").alias("rows"), F.count_if(~F.coalesce(as_column(id_column), F.lit("")).rlike(id_pattern)).alias("bad_ids"), F.count_if(F.coalesce(as_column(phone), F.lit("")) != "[phone]").alias("unmasked_phones"),
        F.coalesce(F.sum(F.regexp_count(raw, F.lit(PHONE)).cast("long")), F.lit(0)).alias("phone_patterns"), F.coalesce(F.sum(F.regexp_count(raw, F.lit(EMAIL)).cast("long")), F.lit(0)).alias("email_patterns"),
    )


def public_projection(df: DataFrame, columns: dict[str, str], notes: dict[str, str]) -> DataFrame:
    """Allowed columns under their public names, and fixed handling notes."""
    return df.select(*[F.col(c).alias(n) for c, n in columns.items()], *[F.lit(v).alias(n) for n, v in notes.items()])
