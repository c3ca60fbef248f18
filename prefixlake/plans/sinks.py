"""Results as text: JSON lines, nested JSON, CSV, and payloads for message brokers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixlake.functions.prefix import text


def json_lines(rows: DataFrame) -> DataFrame:
    """One JSON text for each route of a search; null fields are left out. For ``write.text``."""
    shown = text(F.col("afi"), F.col("plen"), F.col("p_hi"), F.col("p_lo"))
    return rows.select(F.to_json(F.struct(shown.alias("prefix"), "section", "status", F.col("ingress").alias("ingress"), F.col("attrs").alias("pathAttributes"))).alias("value"))


def nested_json(rows: DataFrame) -> DataFrame:
    """One JSON text for each section and prefix of a search: its routes by mui. A task holds one prefix's routes at most."""
    shown = text(F.col("afi"), F.col("plen"), F.col("p_hi"), F.col("p_lo"))
    route = F.struct("mui", "status", F.col("attrs").alias("pathAttributes"))
    grouped = rows.groupBy("section", "afi", shown.alias("nlri")).agg(F.sort_array(F.collect_list(route)).alias("routes"))
    return grouped.select(F.to_json(F.struct("section", "nlri", "routes")).alias("value"))


def broker_messages(outputs: DataFrame, ingresses: DataFrame, topic: str = "routes/{id}") -> DataFrame:
    """topic and value (ingress, record) for records addressed to the broker; for a Kafka sink or ``foreachBatch``."""
    ing = ingresses.select(F.col("id").alias("mui"), F.struct(*ingresses.columns).alias("ingress"))
    record = F.struct(*[c for c in outputs.columns if c != "mui"])
    return outputs.join(ing, "mui", "left").select(F.replace(F.lit(topic), F.lit("{id}"), F.coalesce("topic", F.lit(""))).alias("topic"), F.to_json(F.array(F.to_json("ingress"), F.to_json(record))).alias("value"))


def write(rows: DataFrame, path: str, form: str) -> None:
    """``csv`` (no header), ``json`` (null fields too), ``json-min`` (without them), or ``null``, which only runs the query. Files at ``path`` are replaced."""
    if form == "null":
        rows.write.format("noop").mode("overwrite").save()
    elif form == "csv":
        rows.write.mode("overwrite").csv(path)
    elif form in ("json", "json-min"):
        rows.write.mode("overwrite").option("ignoreNullFields", form == "json-min").json(path)
    else:
        raise ValueError(f"unknown format: {form}")
