"""Service graph and span trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from teleloom.functions.ids import pack_ids
from teleloom.operators.hierarchy import tree
from teleloom.plans.ordered import rank_by_key
from teleloom.plans.skew import lookup_join
from teleloom.plans.storage import Workspace


def service_nodes(spans: DataFrame) -> DataFrame:
    """(service, span_count, error_count)."""
    return spans.groupBy(F.col("service_name").alias("service")).agg(F.count(F.lit(1)).alias("span_count"), F.count_if(F.col("status_code") == "Error").alias("error_count"))


def with_parent(spans: DataFrame, cols: list[str], how: str = "left") -> DataFrame:
    """``spans`` (deduplicated) with ``parent_<col>`` of the parent in the same trace; null if unset or missing.

    Parents are looked up by a packed key; a parent of a large share of all spans is met by broadcast.
    """
    key = pack_ids(F.col("trace_id"), F.col("parent_span_id"))
    child = spans.withColumn("_key", F.when(F.col("parent_span_id") != "", key))
    child = Workspace(spans.sparkSession, "parents").put("children", child)
    parent = spans.filter("span_id <> ''").select(pack_ids(F.col("trace_id"), F.col("span_id")).alias("_key"), *[F.col(c).alias(f"parent_{c}") for c in cols])
    return lookup_join(child, parent, "_key", how).drop("_key")


def service_edges(spans: DataFrame) -> DataFrame:
    """(source, target, call_count) of calls between different services."""
    pairs = with_parent(spans.select("trace_id", "span_id", "parent_span_id", "service_name"), ["service_name"], "inner")
    return pairs.filter("parent_service_name <> service_name").groupBy(F.col("parent_service_name").alias("source"), F.col("service_name").alias("target")).agg(F.count(F.lit(1)).alias("call_count"))


def resolved_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are nodes, with the spans of either end."""
    a = nodes.select(F.col("service").alias("source"), F.col("span_count").alias("source_spans"))
    b = nodes.select(F.col("service").alias("target"), F.col("span_count").alias("target_spans"))
    return edges.join(a, "source").join(b, "target").select("source", "target", "call_count", "source_spans", "target_spans")


def node_sizes(nodes: DataFrame, least: float = 20.0, most: float = 40.0) -> DataFrame:
    """Nodes with a radius from ``least`` to ``most`` by their share of the largest span count."""
    top = nodes.agg(F.greatest(F.max("span_count"), F.lit(1)).alias("_top"))
    return nodes.join(F.broadcast(top), F.lit(True)).select("service", "span_count", (F.lit(least) + F.col("span_count") / F.col("_top") * (most - least)).alias("radius"))


def orphans(spans: DataFrame) -> DataFrame:
    """Spans whose parent id is set but not in their trace. A parent that many spans name is met by broadcast."""
    child, known = _keyed(spans)
    return lookup_join(child.filter("_key is not null"), known, "_key", "left").filter("_known is null").select(*spans.columns)


def _keyed(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``spans``, stored, with the ``_key`` of their parent (null if unset); the keys of all spans, once each, with ``_known``."""
    parent = F.when(F.col("parent_span_id") != "", pack_ids(F.col("trace_id"), F.col("parent_span_id")))
    child = Workspace(spans.sparkSession, "parents").put("children", spans.withColumn("_key", parent))
    known = child.filter("span_id <> ''").select(pack_ids(F.col("trace_id"), F.col("span_id")).alias("_key")).distinct().withColumn("_known", F.lit(True))
    return child, known


def with_children(spans: DataFrame) -> DataFrame:
    """Spans that are the parent of another or of themselves.

    The parents' keys are made distinct before they meet the spans, one row a key on either side.
    """
    child, _ = _keyed(spans)
    used = child.filter("_key is not null").select(F.col("_key").alias("_own")).distinct()
    own = F.when(F.col("span_id") != "", pack_ids(F.col("trace_id"), F.col("span_id")))
    return child.withColumn("_own", own).join(used, "_own", "left_semi").select(*spans.columns)


def span_tree(spans: DataFrame) -> DataFrame:
    """(trace_id, span_id, depth, has_children, position, path) of deduplicated spans in pre-order within a trace.

    Roots are parentless or orphaned spans; siblings come in order of start, ties in order of arrival. Spans on or
    below a loop have no root and no row. ``path`` sorts a trace's spans in pre-order; it has sixteen bytes for each span
    from the root on.
    """
    ws = Workspace(spans.sparkSession, "span-tree")
    ids = pack_ids(F.col("trace_id"), F.col("span_id")), F.when(F.col("parent_span_id") != "", pack_ids(F.col("trace_id"), F.col("parent_span_id")))
    step = F.concat(_eight(F.greatest(F.coalesce("start_ns", F.lit(0)), F.lit(0))), _eight(F.col("arrival_seq")))
    named = ws.put("named", spans.filter("span_id <> ''").select(ids[0].alias("node"), ids[1].alias("parent"), step.alias("seg")))
    t = tree(named, sep="").filter("not endless")
    used = named.filter("parent is not null").select(F.col("parent").alias("node")).distinct().withColumn("_kids", F.lit(True))
    flat = ws.put("flat", t.join(used, "node", "left").select("trace_id", "span_id", "depth", F.coalesce("_kids", F.lit(False)).alias("has_children"), "path"))
    return rank_by_key(flat, ["trace_id"], [F.col("path")], "position").select("trace_id", "span_id", "depth", "has_children", "position", "path")


def _eight(c: Column) -> Column:
    """A whole number not below 0 as eight bytes that sort as it does."""
    return F.unhex(F.lpad(F.hex(c.cast("bigint")), 16, "0"))


#: Bytes of a path for each span on it.
_STEP = 16


def collapse(flat: DataFrame, collapsed: DataFrame) -> DataFrame:
    """A span tree without the descendants of ``collapsed`` (trace_id, span_id) spans, which themselves stay.

    Each row looks its own ancestors up by their paths, so nothing but equal paths meets.
    """
    shut = flat.join(collapsed.select("trace_id", "span_id").distinct(), ["trace_id", "span_id"], "left_semi").select("trace_id", F.col("path").alias("_up"))
    up = flat.filter("depth > 0").select("trace_id", "span_id", F.explode(F.transform(F.sequence(F.lit(1), F.col("depth").cast("int")), lambda i: F.substring(F.col("path"), F.lit(1), i * _STEP))).alias("_up"))
    hidden = up.join(shut, ["trace_id", "_up"], "left_semi").select("trace_id", "span_id").distinct()
    return flat.join(hidden, ["trace_id", "span_id"], "left_anti").select(*flat.columns)


def waterfall_bars(spans: DataFrame, traces: DataFrame) -> DataFrame:
    """(trace_id, span_id, offset_ns, width_ns, total_ns): offset and width not below 0, total at least 1."""
    t = traces.select("trace_id", F.col("start_ns").alias("_base"), F.greatest(F.coalesce("duration_ns", F.lit(0)), F.lit(1)).alias("total_ns"))
    s = spans.select("trace_id", "span_id", "start_ns", "duration_ns")
    zero = F.lit(0)
    return lookup_join(s, t, "trace_id").select("trace_id", "span_id", F.greatest(F.col("start_ns") - F.col("_base"), zero).alias("offset_ns"), F.greatest(F.coalesce("duration_ns", zero), zero).alias("width_ns"), "total_ns")


def timeline_ticks(traces: DataFrame, count: int = 5) -> DataFrame:
    """(trace_id, tick, at_ns) for ticks 0 to ``count`` of each trace's duration."""
    total = F.greatest(F.coalesce("duration_ns", F.lit(0)), F.lit(1))
    return traces.select("trace_id", total.alias("_t"), F.explode(F.sequence(F.lit(0), F.lit(count))).alias("tick")).select("trace_id", "tick", (F.col("_t") / F.lit(count) * F.col("tick")).alias("at_ns"))


def services_present(flat: DataFrame, spans: DataFrame, colours: int = 8) -> DataFrame:
    """(trace_id, service_name, colour): services of a trace in order of first appearance in pre-order, numbered mod ``colours``.

    One row per trace and service enters the window.
    """
    first = spans.select("trace_id", "span_id", "service_name").join(flat.select("trace_id", "span_id", "position"), ["trace_id", "span_id"]).groupBy("trace_id", "service_name").agg(F.min("position").alias("_p"))
    return first.select("trace_id", "service_name", ((F.row_number().over(Window.partitionBy("trace_id").orderBy("_p")) - 1) % colours).alias("colour"))


def bounds(traces: DataFrame) -> DataFrame:
    """(trace_id, base_ns, total_ns) with the fallback (0, 1) where nothing is known."""
    return traces.select("trace_id", F.coalesce("start_ns", F.lit(0)).alias("base_ns"), F.greatest(F.coalesce("duration_ns", F.lit(1)), F.lit(1)).alias("total_ns"))


def is_error(c: str = "status_code") -> Column:
    return F.col(c) == "Error"
