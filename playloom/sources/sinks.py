"""What leaves the archive: exports as JSON or CSV, and rows staged as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What is shown in place of a name that is not to leave.
MASK = "hidden"


def masked(rows: DataFrame, *columns: str) -> DataFrame:
    """The rows with the texts of some columns hidden: equal texts stay equal, null stays null."""
    short = {c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{MASK}-"), F.substring(F.sha2(c, 256), 1, 8))) for c in columns}
    return rows.withColumns(short)


def export(rows: DataFrame, path: str, kind: str = "json", mask: tuple[str, ...] = ()) -> None:
    """Writes the rows below a folder in Spark's JSON lines or CSV with a header; nested columns go into CSV as JSON."""
    out = masked(rows, *mask)
    if kind == "json":
        out.write.mode("error").option("ignoreNullFields", "false").json(path)
    elif kind == "csv":
        nested = {f.name: F.to_json(f.name) for f in out.schema if f.dataType.typeName() in ("array", "map", "struct", "variant")}
        out.withColumns(nested).write.mode("error").option("header", "true").option("escape", '"').csv(path)
    else:
        raise ValueError(f"unknown kind of export: {kind}")


def staged(rows: DataFrame, key: str) -> DataFrame:
    """stage_key and payload_json, one of each key; a payload that would not be read back as it is raises."""
    fields = F.struct(*[F.col(c) for c in rows.columns if c != key])
    payload = F.to_json(fields, {"ignoreNullFields": "false"})
    kind = rows.select(fields.alias("s")).schema["s"].dataType
    back = F.to_json(F.from_json(payload, kind, {"mode": "FAILFAST"}), {"ignoreNullFields": "false"})
    valid = F.when(back.eqNullSafe(payload), payload).otherwise(F.raise_error(F.concat(F.lit("invalid staged payload of "), F.col(key).cast("string"))))
    return rows.select(F.col(key).alias("stage_key"), valid.alias("payload_json")).groupBy("stage_key").agg(F.max("payload_json").alias("payload_json"))
