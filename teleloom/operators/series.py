"""Series of a metric: keys, facets, axes, nearest points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from teleloom.functions.catalog import facet_rules, labels
from teleloom.operators.metrics import METRIC, SERIES
from teleloom.plans.skew import lookup_join
from teleloom.plans.storage import Workspace

#: The cardinality window of discovered facets.
FACET_MIN, FACET_MAX = 2, 20
#: Most metrics whose names are broadcast.
FEW = 100_000


def plain(json: Column) -> Column:
    """an attribute value as text: strings without quotes, others as JSON, null as ``(unset)``."""
    text = F.when(json.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), json, F.lit("}")), "$.v")).otherwise(json)
    return F.when(json.isNull() | (json == "null"), F.lit("(unset)")).otherwise(F.coalesce(text, json))


def attr(name: str) -> Column:
    return plain(F.try_element_at("attributes", F.lit(name)))


def facet_series(points: DataFrame, attributes: list[str]) -> DataFrame:
    """Points with ``series``, the values of the facet's attributes joined by a space."""
    return points.withColumn("series", F.concat_ws(" ", *[attr(a) for a in attributes]) if attributes else F.lit(""))


def cardinality(points: DataFrame, keys: list[str] = METRIC, cap: int = FACET_MAX + 1) -> DataFrame:
    """(keys, attribute, n): exact distinct values of each attribute, nulls left out, no more than ``cap``.

    Distinct values are taken before the shuffle by key, so one metric may hold any share of the points.
    """
    one = points.select(*keys, F.explode("attributes").alias("attribute", "v")).filter("v is not null and v <> 'null'").select(*keys, "attribute", plain(F.col("v")).alias("v")).distinct()
    return one.groupBy(*keys, "attribute").agg(F.least(F.count(F.lit(1)), F.lit(cap)).alias("n"))


def facets(points: DataFrame) -> DataFrame:
    """(service_name, metric_name, ordinal, facet_id, label): catalogue tuples all of whose attributes are present, then single attributes with 2 to 20 values by name."""
    spark = points.sparkSession
    card = cardinality(points)
    have = card.groupBy(*METRIC).agg(F.collect_set("attribute").alias("have"))
    rules = F.broadcast(facet_rules(spark))  # a fixed table of some dozens of rules
    hit = have.join(rules, F.col("metric_name").startswith(F.col("pattern"))).groupBy(*METRIC).agg(F.min_by(F.struct("attributes", "label"), "ordinal").alias("r"), F.first("have").alias("have"))
    tuples = hit.filter("r.attributes is not null").filter(F.size(F.array_except("r.attributes", "have")) == 0).select(*METRIC, F.lit(0).alias("part"), F.array_join("r.attributes", "|").alias("facet_id"), F.col("r.label").alias("label"))
    names = F.broadcast(labels(spark))
    single = card.filter(F.col("n").between(FACET_MIN, FACET_MAX)).join(names, "attribute", "left").select(*METRIC, F.lit(1).alias("part"), F.col("attribute").alias("facet_id"), F.coalesce("label", "attribute").alias("label"))
    w = Window.partitionBy(*METRIC).orderBy("part", "facet_id")
    return tuples.unionByName(single).withColumn("ordinal", F.row_number().over(w)).select(*METRIC, "ordinal", "facet_id", "label")


def axis_domain(points: DataFrame, keys: list[str] = METRIC) -> DataFrame:
    """(keys, x_min, x_max, y_min, y_max): y spans 0 and 1 at least and is padded by a tenth."""
    g = points.groupBy(*keys).agg(F.min("ts_ns").alias("x_min"), F.max("ts_ns").alias("x_max"), F.least(F.min("value"), F.lit(0.0)).alias("lo"), F.greatest(F.max("value"), F.lit(1.0)).alias("hi"))
    pad = (F.col("hi") - F.col("lo")) * 0.1
    pad = F.when(pad == 0, 1.0).otherwise(pad)
    return g.select(*keys, "x_min", "x_max", (F.col("lo") - pad).alias("y_min"), (F.col("hi") + pad).alias("y_max"))


def nearest(points: DataFrame, cursor_ns: Column | int) -> DataFrame:
    """For each metric, the points of its series nearest to the time nearest to the cursor.

    Times are compared in milliseconds. First the point nearest to the cursor over all series of the metric is found
    (ties: the series that appeared first, in a series the earlier point), then in each series the point nearest to
    it. Two aggregations; the cursor's time travels as one row per metric, by broadcast where there are at most
    ``FEW`` metrics, which are counted, else by a shuffle that splits the metrics of many points.
    """
    cursor = F.floor((cursor_ns if isinstance(cursor_ns, Column) else F.lit(cursor_ns)) / F.lit(10**6))
    p = points.withColumn("t", F.floor(F.col("ts_ns") / F.lit(10**6)))
    first = p.groupBy(*SERIES).agg(F.min("arrival_seq").alias("first"), F.min_by("t", F.struct(F.abs(F.col("t") - cursor), "t", "arrival_seq")).alias("near"))
    at = first.groupBy(*METRIC).agg(F.min_by("near", F.struct(F.abs(F.col("near") - cursor), "first")).alias("at"))
    at = Workspace(points.sparkSession, "nearest").put("at", at)
    if at.count() <= FEW:
        met = p.join(F.broadcast(at), METRIC)
    else:
        key = F.md5(F.concat_ws("\x1f", *METRIC))
        stored = Workspace(points.sparkSession, "nearest").put("points", p.withColumn("_key", key))
        met = lookup_join(stored, at.withColumn("_key", key).drop(*METRIC), "_key")
    return met.groupBy(*SERIES, "at").agg(F.min_by("value", F.struct(F.abs(F.col("t") - F.col("at")), "t", "arrival_seq")).alias("value")).select(*SERIES, F.col("at").alias("at_ms"), "value")


def any_attributes(points: DataFrame) -> DataFrame:
    """A17."""
    return points.groupBy(*METRIC).agg(F.max(F.coalesce(F.size("attributes"), F.lit(0)) > 0).alias("any_attributes"))


def colours(points: DataFrame, count: int = 5) -> DataFrame:
    """(series, colour): series of a metric numbered by first appearance, mod ``count``; one row per series enters the window."""
    first = points.groupBy(*SERIES).agg(F.min("arrival_seq").alias("f"))
    return first.select(*SERIES, ((F.row_number().over(Window.partitionBy(*METRIC).orderBy("f")) - 1) % count).alias("colour"))


def by_time(points: DataFrame) -> DataFrame:
    """Points in order of time (milliseconds, then arrival) within series."""
    return points.orderBy(*SERIES, F.floor(F.col("ts_ns") / F.lit(10**6)), "arrival_seq")


def newest_first(points: DataFrame) -> DataFrame:
    """L6."""
    return points.orderBy(F.desc("arrival_seq"))


def by_name(metrics: DataFrame, collation: str | None = None) -> DataFrame:
    """L4: metrics by name, in byte order or a collation such as ``UNICODE``."""
    name = F.collate("metric_name", collation) if collation else F.col("metric_name")
    return metrics.orderBy(name, "service_name")
