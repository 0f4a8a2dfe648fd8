"""Parent-child links to full hierarchies with cycle detection (problem 3).

Nodes are co-located and walked depth-first with node colours: by group while a
group fits a task (``max_group`` nodes, a memory bound), else by connected
component, found by pointer jumping. Only a single component beyond the bound is
resolved by pointer doubling over DataFrames: round k knows each node's 2^k-th
ancestor, so log2(depth) joins find roots, depths, subtree sizes and the nodes
that never reach a root. All ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.runtime import cut, drop_cut

MAX_GROUP = 100_000
SEP = "/"
NODES = "trace_id string, span_id string, root_span_id string, span_depth int, n_descendants int"


def normal_id(col: str) -> Column:
    return F.lower(F.trim(F.col(col)))


def links(df: DataFrame, trace: str = "trace_id", node: str = "span_id", parent: str = "parent_span_id") -> DataFrame:
    """Distinct ``(trace_id, span_id, parent)``; copies of a node are one.

    A null, empty or all-zero parent is none. Copies that disagree on the
    parent keep the greatest id given. Null or empty traces and nodes are
    dropped.
    """
    p = normal_id(parent)
    return (
        df.select(normal_id(trace).alias("trace_id"), normal_id(node).alias("span_id"), F.when(~p.rlike("^0*$"), p).alias("parent"))
        .where("trace_id is not null and span_id is not null and span_id <> ''")
        .groupBy("trace_id", "span_id")
        .agg(F.max("parent").alias("parent"))
    )


def walk(ids: list[str], parents: list[str | None]) -> tuple[list, list, list]:
    """Iterative depth-first traversal: (root, depth, descendants) by node.

    Colours: 0 unseen, 1 on the stack, 2 done. Children of real roots are done
    first; whatever stays white hangs on a ring (a back edge closes it) or
    below one and gets root '', depth -1 and -1 descendants.
    """
    at = {x: i for i, x in enumerate(ids)}
    n = len(ids)
    children: list[list[int]] = [[] for _ in range(n)]
    roots = []
    for i, p in enumerate(parents):
        j = at.get(p) if p is not None else None
        if j is None:
            roots.append(i)
        else:
            children[j].append(i)
    root, depth, size = [""] * n, [-1] * n, [-1] * n
    colour = bytearray(n)
    for r in roots:
        stack = [r]
        root[r], depth[r] = ids[r], 0
        while stack:
            i = stack[-1]
            if colour[i] == 0:
                colour[i] = 1
                size[i] = 0
                for c in children[i]:
                    root[c], depth[c] = ids[r], depth[i] + 1
                    stack.append(c)
            else:
                stack.pop()
                if colour[i] == 1:
                    colour[i] = 2
                    if depth[i]:
                        size[at[parents[i]]] += size[i] + 1
    return root, depth, size


def _paths(ids: list[str], parents: list[str | None], depth: list[int]) -> list[str | None]:
    at = {x: i for i, x in enumerate(ids)}
    out: list[str | None] = [None] * len(ids)
    for i in sorted(range(len(ids)), key=depth.__getitem__):
        if depth[i] >= 0:
            out[i] = ids[i] if depth[i] == 0 else out[at[parents[i]]] + SEP + ids[i]
    return out


def _small(nodes: DataFrame, with_path: bool) -> DataFrame:
    """Co-located groups or components (``comp``), walked one by one.

    ``mapInPandas`` over rows clustered and sorted by group walks many small
    traces per batch instead of paying one Python call for each.
    """
    schema = NODES + (", path string" if with_path else "")

    def emit(t: list[str], g: list[str], s: list[str], p: list[str | None], out: list) -> None:
        k = 0
        n = len(t)
        while k < n:
            e = k
            while e < n and t[e] == t[k] and g[e] == g[k]:
                e += 1
            ids, par = s[k:e], p[k:e]
            root, depth, size = walk(ids, par)
            cols = [t[k:e], ids, root, depth, size]
            if with_path:
                cols.append(_paths(ids, par, depth))
            out.append(cols)
            k = e

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t: list[str] = []
        g: list[str] = []
        s: list[str] = []
        p: list[str | None] = []

        def frame(end: int) -> pd.DataFrame:
            out: list = []
            emit(t[:end], g[:end], s[:end], p[:end], out)
            del t[:end], g[:end], s[:end], p[:end]
            names = [c.split()[0] for c in schema.split(", ")]
            return pd.DataFrame({c: [x for o in out for x in o[i]] for i, c in enumerate(names)})

        for b in batches:
            t += b["trace_id"].tolist()
            g += b["comp"].tolist()
            s += b["span_id"].tolist()
            p += [x if isinstance(x, str) else None for x in b["parent"]]
            end = len(t)
            while end and t[end - 1] == t[-1] and g[end - 1] == g[-1]:
                end -= 1
            if end:
                yield frame(end)
        if t:
            yield frame(len(t))

    clustered = nodes.select("trace_id", F.coalesce("comp", F.lit("")).alias("comp"), "span_id", "parent").repartition("trace_id", "comp").sortWithinPartitions("trace_id", "comp", "span_id")
    return clustered.mapInPandas(run, schema)


def _large(nodes: DataFrame, with_path: bool) -> DataFrame:
    """Pointer doubling over the links of groups too large for one task.

    State per node: ``up`` its 2^k-th ancestor or null, ``dist`` and ``top``
    how far and where the climb got, ``below`` how many nodes hang less than
    2^k steps below. One round joins each climbing node with its ``up`` (a hub
    parent with most of the nodes is a skewed left side, which AQE splits) and
    adds the ``below`` of all nodes 2^k steps down, pre-aggregated map-side.
    Depths are contiguous, so the first round in which no node arrives ends it:
    what still climbs never will, being on or under a ring.
    """
    have = nodes.select("trace_id", F.col("span_id").alias("parent"))
    known = nodes.where("parent is not null").join(have, ["trace_id", "parent"], "left_semi").select("trace_id", "span_id", F.col("parent").alias("up"))
    state = (
        nodes.select("trace_id", "span_id")
        .join(known, ["trace_id", "span_id"], "left")
        .select(
            "trace_id", "span_id", "up",
            F.when(F.col("up").isNull(), F.col("span_id")).otherwise(F.col("up")).alias("top"),
            F.when(F.col("up").isNull(), 0).otherwise(1).cast("bigint").alias("dist"),
            F.lit(1).cast("bigint").alias("below"),
            *([F.when(F.col("up").isNull(), F.array("span_id")).otherwise(F.array("up", "span_id")).alias("trail")] if with_path else []),
        )
    )
    state = cut(state)
    climbing = state.where("up is not null").count()
    while climbing:
        go, stay = state.where("up is not null"), state.where("up is null")
        far = state.select("trace_id", F.col("span_id").alias("up"), F.col("up").alias("up2"), F.col("top").alias("top2"), F.col("dist").alias("dist2"), *([F.col("trail").alias("trail2")] if with_path else []))
        moved = go.join(far, ["trace_id", "up"]).select(
            "trace_id", "span_id", F.col("up2").alias("up"), F.col("top2").alias("top"), (F.col("dist") + F.col("dist2")).alias("dist"), "below",
            *([F.concat("trail2", F.slice("trail", 2, F.greatest(F.size("trail") - 1, F.lit(0)))).alias("trail")] if with_path else []),
        )
        add = go.groupBy("trace_id", F.col("up").alias("span_id")).agg(F.sum("below").alias("more"))
        joined = stay.select(moved.columns).unionByName(moved).join(add, ["trace_id", "span_id"], "left")
        after = cut(joined.select(*[c for c in moved.columns if c != "below"], (F.col("below") + F.coalesce("more", F.lit(0))).alias("below")))
        drop_cut(state)
        state = after
        left = state.where("up is not null").count()
        if left == climbing:
            break
        climbing = left
    ringed = F.col("up").isNotNull()
    return state.select(
        "trace_id", "span_id",
        F.when(ringed, "").otherwise(F.col("top")).alias("root_span_id"),
        F.when(ringed, -1).otherwise(F.col("dist")).cast("int").alias("span_depth"),
        F.when(ringed, -1).otherwise(F.col("below") - 1).cast("int").alias("n_descendants"),
        *([F.when(~ringed, F.array_join("trail", SEP)).alias("path")] if with_path else []),
    )


def _climb(nodes: DataFrame) -> DataFrame:
    """Pointer jumping to the end: ``up`` is each node's root, or a ring member
    where it reaches none; ``low`` is the least id on the way there.

    Every round doubles the steps; it takes log2 of the longest way or ring,
    which no group exceeds. Where a climb never ends, 2^k steps from a ring
    member cover the ring, so its ``low`` is the ring's least id.
    """
    have = nodes.select("trace_id", F.col("span_id").alias("parent"))
    known = nodes.where("parent is not null").join(have, ["trace_id", "parent"], "left_semi").select("trace_id", "span_id", F.col("parent").alias("up"))
    state = cut(nodes.select("trace_id", "span_id").join(known, ["trace_id", "span_id"], "left").select("trace_id", "span_id", F.coalesce("up", "span_id").alias("up"), F.least("span_id", F.coalesce("up", "span_id")).alias("low"), F.col("up").isNull().alias("done")))
    longest = nodes.groupBy("trace_id").count().agg(F.max("count")).collect()[0][0] or 0
    steps = 1
    while steps < longest and not state.where("not done").isEmpty():
        far = state.select("trace_id", F.col("span_id").alias("up"), F.col("up").alias("up2"), F.col("low").alias("low2"), F.col("done").alias("done2"))
        go = state.where("not done").join(far, ["trace_id", "up"]).select("trace_id", "span_id", F.col("up2").alias("up"), F.least("low", "low2").alias("low"), F.col("done2").alias("done"))
        after = cut(state.where("done").unionByName(go))
        drop_cut(state)
        state, steps = after, steps * 2
    return state


def components(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``comp``, the connected component: its root, or the least
    id of the ring that all of its nodes climb to."""
    end = _climb(nodes)
    ring = end.where("not done").select("trace_id", F.col("span_id").alias("up"), F.col("low").alias("ring"))
    named = end.select("trace_id", "span_id", "up", "done").join(ring, ["trace_id", "up"], "left").select("trace_id", "span_id", F.when(F.col("done"), F.col("up")).otherwise(F.concat(F.lit("ring "), "ring")).alias("comp"))
    return nodes.join(named, ["trace_id", "span_id"])


def hierarchy(df: DataFrame, *, trace: str = "trace_id", node: str = "span_id", parent: str = "parent_span_id", with_path: bool = False, max_group: int = MAX_GROUP) -> DataFrame:
    """Root, depth and number of descendants of every node, and its path.

    One row per distinct (trace, node). Nodes whose parent has no row in the
    trace are roots. Nodes on a ring or below one have root '', depth -1, -1
    descendants and a null path. Empty input gives an empty result; a node that
    is its own parent is a ring of one.
    """
    nodes = links(df, trace, node, parent)
    big = nodes.groupBy("trace_id").count().where(F.col("count") > max_group).select("trace_id")
    whole = nodes.withColumn("comp", F.lit(None).cast("string"))
    if big.isEmpty():
        return _small(whole, with_path)
    nodes = cut(nodes)
    sizes = cut(big)
    parts = cut(components(nodes.join(sizes, "trace_id", "left_semi")))
    huge = cut(parts.groupBy("trace_id", "comp").count().where(F.col("count") > max_group).select("trace_id", "comp"))
    small = nodes.join(sizes, "trace_id", "left_anti").withColumn("comp", F.lit(None).cast("string")).unionByName(parts.join(huge, ["trace_id", "comp"], "left_anti").select("trace_id", "span_id", "parent", "comp"))
    out = _small(small, with_path)
    if huge.isEmpty():
        return out
    return out.unionByName(_large(cut(parts.join(huge, ["trace_id", "comp"], "left_semi").select("trace_id", "span_id", "parent")), with_path))


def descendants(paths: DataFrame) -> DataFrame:
    """All (ancestor, descendant, distance) pairs from rows with ``path``.

    As many rows as the sum of the depths, which is what the answer holds.
    """
    up = F.split("path", SEP)
    return (
        paths.where("path is not null")
        .select("trace_id", "span_id", "span_depth", F.posexplode(up).alias("pos", "ancestor_id"))
        .where(F.col("pos") < F.col("span_depth"))
        .select("trace_id", "ancestor_id", F.col("span_id").alias("descendant_id"), (F.col("span_depth") - F.col("pos")).cast("int").alias("distance"))
    )


def rings(df: DataFrame, *, trace: str = "trace_id", node: str = "span_id", parent: str = "parent_span_id", max_group: int = MAX_GROUP) -> DataFrame:
    """The nodes caught in rings, one row each.

    ``cycle_id``: the least id of the ring a node is on or below; ``on_ring``
    tells members from nodes below; ``n_members`` of the ring; ``back_edge``:
    the link of this member to its parent closes the ring, for a traversal that
    starts at the least id. Members are what is reached after as many steps as
    there are caught nodes; pointer jumping takes the logarithm of that many
    rounds, over the caught nodes only.
    """
    h = hierarchy(df, trace=trace, node=node, parent=parent, max_group=max_group).where("span_depth = -1").select("trace_id", "span_id")
    caught = cut(h.join(links(df, trace, node, parent), ["trace_id", "span_id"]))
    end = _climb(caught)
    member = end.groupBy("trace_id", F.col("up").alias("span_id")).agg(F.lit(True).alias("on_ring"))
    ring = end.join(member, ["trace_id", "span_id"]).select("trace_id", F.col("span_id").alias("up"), F.col("low").alias("cycle_id"))
    size = ring.groupBy("trace_id", "cycle_id").agg(F.count(F.lit(1)).alias("n_members"))
    named = end.select("trace_id", "span_id", "up").join(ring, ["trace_id", "up"]).join(member, ["trace_id", "span_id"], "left").join(size, ["trace_id", "cycle_id"])
    on = F.coalesce("on_ring", F.lit(False))
    return named.select("trace_id", "span_id", on.alias("on_ring"), "cycle_id", "n_members", (on & (F.col("span_id") == F.col("cycle_id"))).alias("back_edge"))
