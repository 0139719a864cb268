"""MARC-XML records to field values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.merge import MARC_FIELDS
from shelfmark.operators.skew import exploded

_CORRUPT = "_corrupt_record"
_SCHEMA = (
    "controlfield array<struct<_tag: string, _VALUE: string>>, "
    "datafield array<struct<_tag: string, _ind2: string, subfield: array<struct<_code: string, _VALUE: string>>>>, "
    f"{_CORRUPT} string"
)


def parse_records(df: DataFrame, xml: str = "raw_record") -> DataFrame:
    """Adds the parsed ``record``; the ``marc:`` prefix and record attributes are removed, malformed records dropped."""
    plain = F.regexp_replace(F.replace(F.col(xml), F.lit("marc:"), F.lit("")), "<record[^>]*>", "<record>")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT, "ignoreSurroundingSpaces": "false"}
    parsed = df.filter(F.length(xml) > 0).withColumn("record", F.from_xml(plain, _SCHEMA, options))
    return parsed.filter(F.col("record").isNotNull() & F.col(f"record.{_CORRUPT}").isNull()).drop(xml)


def field_values(df: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, field, pos, value`` by the subfield rules: subfields a and x (for 245 also b and c) joined by a blank;
    subject fields with second indicator 9 are skipped."""
    empty = "array<struct<field: string, value: string>>"
    control = F.transform(
        F.filter("record.controlfield", lambda c: c["_tag"] == "008"),
        lambda c: F.struct(c["_tag"].alias("field"), F.coalesce(c["_VALUE"], F.lit("")).alias("value")),
    )

    def wanted(d):
        foreign = d["_tag"].startswith("6") & (F.coalesce(d["_ind2"], F.lit("")) == "9")
        return d["_tag"].isin(*MARC_FIELDS) & ~foreign

    def codes(d):
        return F.when(d["_tag"] == "245", F.array(*map(F.lit, "abcx"))).otherwise(F.array(*map(F.lit, "ax")))

    def joined(d):
        chosen = F.filter(d["subfield"], lambda s: F.array_contains(codes(d), s["_code"]) & s["_VALUE"].isNotNull())
        return F.coalesce(F.array_join(F.transform(chosen, lambda s: s["_VALUE"]), " "), F.lit(""))

    data = F.transform(
        F.filter("record.datafield", wanted), lambda d: F.struct(d["_tag"].alias("field"), joined(d).alias("value"))
    )
    both = F.concat(*[F.coalesce(a, F.array().cast(empty)) for a in (control, data)])
    rows = exploded(df, keys, both, "pos", "_v", kind="posexplode")
    return rows.select(*keys, "_v.field", "pos", "_v.value")


def collect_fields(
    values: DataFrame, keys: list[str], record: str = "record_id", delimiter: str = " $|$ ", last_only: bool = False
) -> DataFrame:
    """One row per key with a column per MARC field, values in record order.

    ``last_only`` keeps only the last record of each key.
    """
    if last_only:
        last = values.groupBy(*keys).agg(F.max(record).alias(record))
        values = values.join(last, [*keys, record], "left_semi")
    entry = F.struct(record, "pos", "value")
    columns = [
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.when(F.col("field") == f, entry))), lambda e: e["value"]), delimiter
        ).alias(f)
        for f in MARC_FIELDS
    ]
    return values.groupBy(*keys).agg(*columns)
