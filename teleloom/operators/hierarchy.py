"""Parent-child rows to full hierarchies, by pointer doubling.

Every node starts with a pointer to its parent. A round replaces each pointer by the pointer of the node it leads
to, so that jumps double: after k rounds a chain of 2^k links has been walked. Nodes whose chain has ended leave the
working set, which shrinks fast. When a round frees no node, every pointer left leads to another node that is left:
those chains never end, they lie on a loop or below one.

Only (key, pointer) pairs move; a round is one join of the working set with itself, and nodes that attract a large
share of the pointers are met by broadcast (``plans.skew``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from teleloom.functions.ids import normal_id, pack_ids, packed_span, packed_trace
from teleloom.plans.skew import lookup_join
from teleloom.plans.storage import Workspace


#: Rows of a pool that are not worth a job to cut.
LARGE = 500_000


def first_arrivals(spans: DataFrame) -> DataFrame:
    """One row (node, parent) for each set (trace_id, span_id): that of the smallest arrival_seq.

    Rows with an unset id are left out; an unset parent is null. Ties in arrival_seq take the smaller parent.
    """
    trace, span, parent = normal_id("trace_id"), normal_id("span_id"), normal_id("parent_span_id")
    rows = spans.select(trace.alias("t"), span.alias("s"), parent.alias("p"), F.coalesce("arrival_seq", F.lit(2**63 - 1)).alias("seq"))
    rows = rows.filter("t <> '' and s <> ''").select(pack_ids(F.col("t"), F.col("s")).alias("node"), F.when(F.col("p") != "", pack_ids(F.col("t"), F.col("p"))).alias("parent"), "seq")
    return rows.groupBy("node").agg(F.min(F.struct("seq", "parent")).alias("x")).select("node", F.col("x.parent").alias("parent"))


def unending(edges: DataFrame, ws: Workspace) -> DataFrame:
    """The nodes of ``edges`` (node, parent: both set, one row per node) whose chain of parents never ends.

    A chain goes on at a node only if that node has a row, so a pointer to anything else ends it. Rounds store keys
    and pointers only, and each drops the one before.
    """
    now, old = ws.put("edges", edges), "edges"
    left, k = now.count(), 0
    while left:
        target = now.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
        name = f"jump{k}"
        step = ws.put(name, lookup_join(now, target, "parent", total=left).select("node", F.col("next").alias("parent")))
        n = step.count()
        ws.drop(old)
        now, old, k = step, name, k + 1
        if n == left:
            break
        left = n
    return now.select("node")


def endless(spans: DataFrame) -> DataFrame:
    """(trace_id, span_id) of each span that lies on a loop of parent links or below one.

    Empty input gives no rows; unset or unknown parents end a chain; other columns are ignored.
    """
    found = unending(first_arrivals(spans).filter("parent is not null"), Workspace(spans.sparkSession, "hierarchy"))
    return found.select(packed_trace("node").alias("trace_id"), packed_span("node").alias("span_id"))


def tree(nodes: DataFrame, sep: str = "/") -> DataFrame:
    """Paths of ``nodes`` (node, parent: packed keys, one row per node; seg: its piece of a path).

    (node, trace_id, span_id, root, depth, path, endless): root is the root's span id, path the pieces from the root
    on, joined by ``sep`` (or put together as they are, if that is empty: binary pieces of one length). A node whose parent is null or not among the nodes is a root. On or below a loop root, depth
    and path are null and endless is true.
    """
    ws = Workspace(nodes.sparkSession, "tree")
    nodes = ws.put("nodes", nodes)
    known = nodes.select(F.col("node").alias("parent"), F.lit(True).alias("known"))
    start = lookup_join(nodes, known, "parent", "left").select("node", F.when(F.col("known"), F.col("parent")).alias("parent"), F.col("seg").alias("path"))
    state = ["node", "parent", "depth", "path", "root"]
    begun = ws.put("begun", start.withColumn("root", F.when(F.col("parent").isNull(), packed_span("node"))).withColumn("depth", F.when(F.col("parent").isNull(), 0).otherwise(1)).select(*state))
    total, left = begun.agg(F.count(F.lit(1)), F.count("parent")).first()
    # Rounds go on while one frees a node. What none frees has no end (see ``unending``); its paths, which double in
    # every round, are by then at most twice as long as the longest path there is.
    done, active, pool, size, k = [begun.filter("parent is null")], begun.filter("parent is not null"), begun, total, 0
    while left:
        if size > max(4 * left, LARGE):
            # The pool is cut to the nodes that pointers lead to. A node that is 2^(k+1) links above another is 2^k
            # links above one too, so no later round misses one that is cut; leaves go at once.
            led_to = active.select(F.col("parent").alias("node")).distinct()
            pool = ws.put(f"pool{k}", pool.join(led_to, "node", "left_semi").select(*state))
            size = pool.count()
        # A pointer that leads to an ended node ends too, one that leads to an active node takes over its pointer.
        target = pool.select(F.col("node").alias("parent"), F.col("parent").alias("next"), F.col("depth").alias("d"), F.col("path").alias("up"), F.col("root").alias("top"))
        step = lookup_join(active.select("node", "parent", "depth", "path"), target, "parent", total=left)
        step = ws.put(f"round{k}", step.select("node", F.col("next").alias("parent"), (F.col("depth") + F.col("d")).alias("depth"), (F.concat_ws(sep, "up", "path") if sep else F.concat("up", "path")).alias("path"), F.col("top").alias("root")))
        n = step.filter("parent is not null").count()
        if n == left:
            break
        done.append(step.filter("parent is null"))
        active, pool, size, left, k = step.filter("parent is not null"), pool.filter("parent is null").unionByName(step), size + left, n, k + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    none = F.lit(None)
    out = out.select("node", "root", "depth", "path", F.lit(False).alias("endless"))
    if left:
        out = out.unionByName(active.select("node", none.cast("string").alias("root"), none.cast("int").alias("depth"), none.cast(dict(begun.dtypes)["path"]).alias("path"), F.lit(True).alias("endless")))
    return out.select("node", packed_trace("node").alias("trace_id"), packed_span("node").alias("span_id"), "root", F.col("depth").cast("bigint").alias("depth"), "path", "endless")


def hierarchy(spans: DataFrame) -> DataFrame:
    """For each first-arrived span: trace_id, span_id, root_span_id, depth (root 0), path (span ids from the root,
    joined by ``/``) and endless (true on or below a loop, where root, depth and path are null).

    A span whose parent is unset or unknown in its trace is a root.
    """
    t = tree(first_arrivals(spans).withColumn("seg", packed_span("node")))
    return t.select("trace_id", "span_id", F.col("root").alias("root_span_id"), "depth", "path", "endless")


def descendants(tree: DataFrame) -> DataFrame:
    """(trace_id, ancestor_span_id, span_id, distance) for each pair of a node of ``hierarchy`` and one above it.

    As many rows as the paths have steps; nodes under a loop have none.
    """
    up = tree.filter("path is not null").select("trace_id", "span_id", "depth", F.posexplode(F.split("path", "/")).alias("at", "ancestor_span_id"))
    return up.filter("at < depth").select("trace_id", "ancestor_span_id", "span_id", (F.col("depth") - F.col("at")).alias("distance"))
