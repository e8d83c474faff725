"""Prerequisite graphs: edges are ``child, parent``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators.dedup import components, cut

#: Edges of a part of a graph that one task walks through, in less than 1 GB; larger parts are worked on by all tasks.
LOCAL_EDGES = 1_000_000
#: Edges that are walked at once while a graph shrinks, rounds of it at most, and doublings of the steps that a round looks ahead.
BLOCK_EDGES, SHRINKS, HOPS = 250_000, 8, 6


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("child").alias("node")).union(edges.select("parent")).distinct()


def neighbours(edges: DataFrame) -> DataFrame:
    """Sorted predecessors and successors of every node."""
    before = edges.groupBy(F.col("child").alias("node")).agg(F.array_sort(F.collect_set("parent")).alias("before"))
    after = edges.groupBy(F.col("parent").alias("node")).agg(F.array_sort(F.collect_set("child")).alias("after"))
    none = F.expr("cast(array() AS array<bigint>)")
    joined = nodes_of(edges).join(before, "node", "left").join(after, "node", "left")
    return joined.select("node", F.coalesce("before", none).alias("before"), F.coalesce("after", none).alias("after"))


def _shortcuts(edges: DataFrame, steps: int) -> DataFrame:
    """``x, y`` of the edges, and for every node where 2, 4, ... steps along one chosen edge out, or back along one chosen edge in, lead.

    A shortcut only says what a path says, so it changes no component, and a ring of n
    nodes is crossed in some log n rounds.
    """
    out = edges
    for start, end in (("x", "y"), ("y", "x")):
        hop = cut(edges.groupBy(F.col(start).alias("a")).agg(F.min_by(end, F.xxhash64(start, end)).alias("b")))
        for _ in range(steps):
            hop = cut(hop.join(hop.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b")))
            far = hop.where("a <> b")
            out = out.unionByName(far.select(F.col("a").alias(start), F.col("b").alias(end)))
    return out.distinct()


def _trimmed(edges: DataFrame, rounds: int = 3) -> DataFrame:
    """Edges whose ends may lie on a cycle: those without a way in or out go, a few rounds of them."""
    for _ in range(rounds):
        both = edges.select(F.col("x").alias("n")).intersect(edges.select("y"))
        edges = cut(edges.join(both.withColumnRenamed("n", "x"), "x", "left_semi").join(both.withColumnRenamed("n", "y"), "y", "left_semi").select("x", "y"))
    return edges


def _tarjan(edges: list[tuple]) -> dict:
    """The smallest node of its component for each end of an edge, in one walk of a bounded graph."""
    out: dict = {}
    for x, y in edges:
        out.setdefault(x, []).append(y)
        out.setdefault(y, [])
    number: dict = {}
    low: dict = {}
    least: dict = {}
    trail: list = []
    for root in out:
        if root in number:
            continue
        open_ = [(root, iter(out[root]))]
        number[root] = low[root] = len(number)
        trail.append(root)
        while open_:
            node, ways = open_[-1]
            for y in ways:
                if y not in number:
                    number[y] = low[y] = len(number)
                    trail.append(y)
                    open_.append((y, iter(out[y])))
                    break
                if y not in least:
                    low[node] = min(low[node], number[y])
            else:
                open_.pop()
                if open_:
                    low[open_[-1][0]] = min(low[open_[-1][0]], low[node])
                if low[node] == number[node]:
                    members = [trail.pop()]
                    while members[-1] != node:
                        members.append(trail.pop())
                    least.update(dict.fromkeys(members, min(members)))
    return least


def _solved(parts: DataFrame) -> DataFrame:
    """``node, component`` of the ends of ``part, x, y``, each part in one task."""
    kind = parts.schema["x"].dataType.simpleString()

    def walk(g: pd.DataFrame) -> pd.DataFrame:
        least = _tarjan(list(zip(g["x"].tolist(), g["y"].tolist())))
        return pd.DataFrame({"node": list(least), "component": list(least.values())})

    return parts.groupBy("part").applyInPandas(walk, f"node {kind}, component {kind}")


def _shrunk(links: DataFrame, most: int) -> tuple[DataFrame, list[DataFrame]]:
    """Links between the first nodes of components that runs of ``most`` edges show, and for each round ``node, head`` of what became another.

    A cycle among some edges is one of the whole graph, so its nodes may take their
    smallest's name; of a node that two runs name differently the smaller name stays, and
    a cycle through both names is left for later.  Runs go by the edges' starts, every second round by the least node on a
    few steps along one chosen edge, so neighbours lie together whatever their names; it ends
    when so few links are left that one walk does, or a round of each kind shows little.
    """
    kind, heads, idle = links.schema["x"].dataType.simpleString(), [], 0
    left = links.count()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list = []

        def heads_of(edges: list) -> pa.RecordBatch:
            other = [(n, c) for n, c in _tarjan(edges).items() if n != c]
            return pa.record_batch({"node": pa.array([n for n, _ in other], kinds), "head": pa.array([c for _, c in other], kinds)})

        kinds = None
        for batch in batches:
            kinds = batch.column("x").type
            rows = list(zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()))
            while rows:
                take = most - len(open_)
                open_ += rows[:take]
                rows = rows[take:]
                if len(open_) == most:
                    yield heads_of(open_)
                    open_ = []
        if open_:
            yield heads_of(open_)

    for turn in range(SHRINKS):
        if left <= most or idle == 2:
            break
        runs, order = -(-left // most), ["x", "y"]
        placed = links
        if turn % 2:
            step = links.groupBy(F.col("x").alias("a")).agg(F.min_by("y", F.xxhash64("x", "y")).alias("b")).withColumn("least", F.least("a", "b"))
            for _ in range(HOPS):
                far = step.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("least").alias("far"))
                step = cut(step.join(far, "b", "left").select("a", F.coalesce("c", "b").alias("b"), F.least("least", F.coalesce("far", "least")).alias("least")))
            placed, order = links.join(step.select(F.col("a").alias("x"), F.col("least").alias("_least")), "x"), ["_least", "x", "y"]
        head = cut(placed.repartitionByRange(runs, *order).sortWithinPartitions(*order).select("x", "y").mapInArrow(walk, f"node {kind}, head {kind}").groupBy("node").agg(F.min("head").alias("head")))
        found = head.limit(1).count()
        if found:
            heads.append(head)
            for end in ("x", "y"):
                to = head.select(F.col("node").alias(end), F.col("head").alias("_head"))
                links = links.join(to, end, "left").withColumn(end, F.coalesce("_head", end)).drop("_head")
            links = _trimmed(cut(links.where("x <> y").distinct().select("x", "y")), 1)
        now = links.count() if found else left
        idle = idle + 1 if now > 0.9 * left else 0
        left = now
    return links, heads


def strong_components(nodes: DataFrame, edges: DataFrame, local: int = LOCAL_EDGES) -> DataFrame:
    """``node, component``: the smallest node of each strongly connected component, for every node and every end of an edge.

    Nodes off all cycles are trimmed a few rounds.  Cycles within runs of edges become one
    node each, which leaves little of most graphs; at most ``local`` edges are then
    finished by one walk in a task, else each weakly connected part of so many.  In larger ones every node takes
    the greatest mark that reaches it, marks being drawn anew in each turn; what carries
    one mark and reaches its owner is the owner's component, and the rest of a mark is a
    part of its own in the next turn.  Nothing but one row a node and edge, and some log
    n shortcuts a node, is held, so rings may be of any length.
    """
    edges = cut(edges.select("child", "parent").distinct())
    all_nodes = nodes.select("node").union(nodes_of(edges)).where("node IS NOT NULL").distinct()
    links = _trimmed(edges.where("child <> parent").select(F.col("child").alias("x"), F.col("parent").alias("y")))
    if not links.limit(1).count():
        return all_nodes.withColumn("component", F.col("node"))
    links, heads = _shrunk(links, min(local, BLOCK_EDGES)) if local else (links, [])
    named = all_nodes.withColumn("label", F.col("node"))
    for head in heads:
        named = named.join(head.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("head", "label").alias("label"))
    every = _parts_solved(links, local)
    return named.join(every.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("component", "label").alias("component"))


def _parts_solved(links: DataFrame, local: int) -> DataFrame:
    """``node, component`` of the ends of links: by one walk if there are few, else by weakly connected parts."""
    if links.count() <= local:
        return _solved(links.withColumn("part", F.lit(0)))
    live = links.select(F.col("x").alias("node")).union(links.select("y")).distinct()
    part = components(live, links.select(F.col("x").alias("a"), F.col("y").alias("b"))).withColumnRenamed("component", "part")
    found, turn, short = [], 0, None
    while True:
        inside = cut(links.join(part.withColumnRenamed("node", "x"), "x").join(part.select(F.col("node").alias("y"), F.col("part").alias("part2")), "y").where("part = part2").select("part", "x", "y"))
        large = inside.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > local).select("part")
        found.append(_solved(inside.join(large, "part", "left_anti")))
        graph = cut(part.join(large, "part", "left_semi"))
        size = graph.count()
        if not size:
            break
        if short is None:
            short = cut(_shortcuts(links.join(graph.select(F.col("node").alias("x")), "x", "left_semi"), size.bit_length()))
        mine = short.join(graph.withColumnRenamed("node", "x"), "x").join(graph.select(F.col("node").alias("y"), F.col("part").alias("part2")), "y").where("part = part2").select("x", "y")
        closed, part = _one_turn(graph, cut(mine), turn)
        found.append(closed)
        turn += 1
    every = found[0]
    for f in found[1:]:
        every = every.union(f)
    return every


def _one_turn(graph: DataFrame, links: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """The components of this turn's mark owners, and the other nodes with their mark as part."""
    mark = F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), F.col("node").alias("owner"))
    marks = cut(graph.select("node", mark.alias("mark")))
    while True:  # forward: the greatest mark that reaches a node, and what has reached that mark's owner
        came = links.join(marks.withColumnRenamed("node", "x"), "x").groupBy(F.col("y").alias("node")).agg(F.max("mark").alias("came"))
        up = marks.join(came, "node", "left").select("node", F.col("mark").alias("old"), F.greatest("mark", F.coalesce("came", "mark")).alias("mark"))
        far = marks.select(F.col("node").alias("owner"), F.col("mark").alias("far"))
        up = cut(up.withColumn("owner", F.col("mark.owner")).join(far, "owner").select("node", "old", F.greatest("mark", "far").alias("mark")))
        marks = up.drop("old")
        if not up.where("mark <> old").limit(1).count():
            break
    same = links.join(marks.select(F.col("node").alias("x"), F.col("mark.owner").alias("o")), "x").join(marks.select(F.col("node").alias("y"), F.col("mark.owner").alias("o2")), "y").where("o = o2")
    same = cut(same.select("x", "y"))
    back = new = cut(marks.where("node = mark.owner").select("node"))
    while True:  # backward: what of a mark reaches its owner
        more = same.join(new.withColumnRenamed("node", "y"), "y", "left_semi").select(F.col("x").alias("node")).distinct()
        new = cut(more.join(back, "node", "left_anti"))
        if not new.limit(1).count():
            break
        back = cut(back.union(new))
    closed = marks.join(back, "node", "left_semi").select("node", F.col("mark.owner").alias("owner"))
    closed = cut(closed.join(closed.groupBy("owner").agg(F.min("node").alias("component")), "owner").select("node", "component"))
    return closed, cut(marks.join(back, "node", "left_anti").select("node", F.col("mark.owner").alias("part")))


def on_cycles(edges: DataFrame) -> DataFrame:
    """Nodes that reach themselves: those of a component of several, and those with an edge to themselves."""
    edges = cut(edges.select("child", "parent"))
    found = cut(strong_components(nodes_of(edges), edges))
    several = found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    loops = edges.where("child = parent").select(F.col("child").alias("node"))
    return found.join(several, "component", "left_semi").select("node").union(loops).distinct()


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return components(nodes, edges.select(F.col("child").alias("a"), F.col("parent").alias("b")))


def topology(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts that the checks of a curriculum use: one row over all nodes and edges."""
    ids = nodes.select("node")
    inside = edges.join(ids.withColumnRenamed("node", "parent"), "parent", "left_semi")
    children = inside.groupBy("parent").agg(F.count(F.lit(1)).alias("n"))
    parents = edges.groupBy("child").agg(F.count(F.lit(1)).alias("n"))
    per = ids.join(children.select(F.col("parent").alias("node"), F.col("n").alias("out")), "node", "left").join(parents.select(F.col("child").alias("node"), F.col("n").alias("into")), "node", "left").na.fill(0, ["out", "into"])
    shape = per.agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.expr("into = 0")).alias("roots"), F.count_if(F.expr("out >= 2")).alias("branches"), F.count_if(F.expr("into >= 2")).alias("merges"), F.count_if(F.expr("into = 1")).alias("single"), F.count_if(F.expr("into = 0 AND out = 0")).alias("orphans"))
    dangling = edges.join(ids.withColumnRenamed("node", "parent"), "parent", "left_anti").agg(F.count(F.lit(1)).alias("dangling"))
    loops = edges.agg(F.count_if(F.expr("child = parent")).alias("self_loops"))
    weak = weak_components(ids, inside.where("child <> parent")).agg(F.countDistinct("component").alias("components"))
    return shape.crossJoin(dangling).crossJoin(loops).crossJoin(weak)  # one row each


def walk_up(parents: DataFrame) -> DataFrame:
    """``node, ancestor, level`` up to the root; parents are ``node, parent``, one row a node. A cycle raises.

    Steps double, so a chain of n nodes takes some log n rounds; its rows are the result's own.
    """
    level = F.lit(0).cast("long")
    outer = parents.select(F.col("parent").alias("node")).where("node IS NOT NULL").join(parents.select("node"), "node", "left_anti").distinct()  # ends of a walk that have no row
    known = parents.select("node").unionByName(outer)
    out = cut(known.select("node", F.col("node").alias("ancestor"), level.alias("level")))
    jump = cut(parents.where("parent IS NOT NULL").select("node", F.col("parent").alias("far")))
    steps, most = 1, out.count()
    while jump.limit(1).count():
        if steps > 2 * most or jump.where("node = far").limit(1).count():
            raise ValueError("the hierarchy has a cycle")
        beyond = jump.join(out.withColumnRenamed("node", "far"), "far").select("node", "ancestor", (F.col("level") + steps).alias("level"))
        out = cut(out.unionByName(beyond))
        jump = cut(jump.join(jump.select(F.col("node").alias("far"), F.col("far").alias("next")), "far").select("node", F.col("next").alias("far")))
        steps *= 2
    return out.join(outer, "node", "left_anti")


def first_cycle(order: list[int], before: dict[int, list[int]]) -> list[int] | None:
    """The first cycle that a depth-first walk over prerequisites closes, or None.

    It runs from the child of the node that closes it down to that node.
    """
    done: set[int] = set()
    for root in order:
        if root in done:
            continue
        trail, open_ = [root], [iter(before.get(root, ()))]
        while trail:
            for p in open_[-1]:
                if p in trail:
                    return [*trail[trail.index(p) + 1 :], p]
                if p in before and p not in done:
                    trail.append(p)
                    open_.append(iter(before[p]))
                    break
            else:
                done.add(trail.pop())
                open_.pop()
    return None


def break_cycles(edges: DataFrame, keys: list[str], prefer: Column | None = None, most: int = 16) -> DataFrame:
    """Edges of each graph without cycles; at most ``most`` edges of a graph are taken out, one a step.

    A step takes the first edge of the cycle that touches a node of ``prefer``, a
    condition on ``node``; without one, the first edge into the cycle from the node that
    closes it.  Nodes and prerequisites go in ascending order, edges from a node to
    itself are dropped.  Graphs are of a curriculum's size and are mended each on its own.
    """
    clean = edges.where("child <> parent").select(*keys, "child", "parent").distinct()
    wanted = F.lit(False) if prefer is None else prefer
    nodes = clean.select(F.col("child").alias("node")).union(clean.select("parent")).distinct().where(wanted).select("node").withColumn("_p", F.lit(True))
    marked = clean.join(nodes.select(F.col("node").alias("child"), F.col("_p").alias("_pc")), "child", "left").join(nodes.select(F.col("node").alias("parent"), F.col("_p").alias("_pp")), "parent", "left")
    marked = marked.select(*keys, "child", "parent", (F.coalesce("_pc", F.lit(False)) | F.coalesce("_pp", F.lit(False))).alias("_prefer"))

    def mend(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["child", "parent"])
        before = {int(n): [] for n in sorted({*g["child"], *g["parent"]})}
        for child, parent in zip(g["child"], g["parent"]):
            before[int(child)].append(int(parent))
        liked = {(int(c), int(p)) for c, p, x in zip(g["child"], g["parent"], g["_prefer"]) if x}
        for _ in range(most):
            cycle = first_cycle(list(before), before)
            if cycle is None:
                break
            inside = [(n, p) for n in cycle for p in before[n] if p in cycle]
            last = [e for e in inside if e[0] == cycle[-1]]
            n, p = next((e for e in inside if e in liked), last[0])
            before[n].remove(p)
        kept = [p in before[int(c)] for c, p in zip(g["child"], g["parent"])]
        return g[kept][[*keys, "child", "parent"]]

    return marked.groupBy(*keys).applyInPandas(mend, clean.schema)
