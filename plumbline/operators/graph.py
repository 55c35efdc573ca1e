"""Graphs as edge tables: levels, cycles, closure, trees.

Each step of an iteration joins a frontier without repetitions and writes it, so
lineage stays short and a lost executor costs one step. No step brings nodes to the driver; only counts.
"""

from __future__ import annotations

import tempfile
import uuid
from collections import defaultdict, deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def written(df: DataFrame) -> DataFrame:
    """df as a table in the folder of spark.checkpoint.dir, which goes when the application ends. Only where that is unset and all runs in one process, as in tests, a local folder; on a cluster an error is raised."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="plumbline-")
    path = f"{folder.rstrip('/')}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)
    return spark.read.schema(df.schema).parquet(path)


def in_degree(edges: DataFrame) -> DataFrame:
    """node and number of edges into it. edges: src, dst."""
    return edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"))


def _peel(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Levels (node, level) of the nodes from which no cycle is reached, in rounds: a node whose dependencies all have a level gets the next; and the nodes left over. A round writes only the edges that remain; the nodes it freed are those that began an edge before it and begin none after."""
    known = written(nodes.select("node").distinct())
    ends = known.select(F.col("node").alias("dst"))
    left = written(edges.select("src", "dst").distinct().join(ends, "dst", "left_semi").join(known.select(F.col("node").alias("src")), "src", "left_semi").select("src", "dst"))
    starts = lambda e: e.select(F.col("src").alias("node")).distinct()
    free = written(known.join(starts(left), "node", "left_anti").withColumn("level", F.lit(0)))
    out, level, size = free, 0, left.count()
    while size:
        level += 1
        rest = written(left.join(free.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"))
        free = written(starts(left).join(starts(rest), "node", "left_anti").withColumn("level", F.lit(level)))
        out = out.unionByName(free)
        before, size, left = size, rest.count(), rest
        if size == before:
            break
    return out, starts(left)


def topo_levels(edges: DataFrame, nodes: DataFrame, ignore_self: bool = False) -> DataFrame:
    """node and level, dependencies first: the longest path to a node without dependencies; -1 for nodes in a cycle or depending on one. A self-edge is a cycle unless ignored."""
    e = edges.where("src <> dst") if ignore_self else edges
    levels, left = _peel(e, nodes)
    return levels.unionByName(left.withColumn("level", F.lit(-1)))


def _fixed_point(state: DataFrame, step, measure) -> DataFrame:
    """state under step, written each time, until its measure no longer changes."""
    state = written(state)
    seen = state.agg(measure).first()[0]
    while True:
        state = written(step(state))
        now = state.agg(measure).first()[0]
        if now == seen:
            return state
        seen = now


#: A core of no more edges is finished in one task; a larger one by distributed rounds, with the same result.
CORE_EDGES = 500_000


def _strong(table: pa.Table) -> pa.Table:
    """Nodes of the strong components with a cycle, by Tarjan's algorithm without recursion."""
    below = defaultdict(list)
    for a, b in zip(table["src"].to_pylist(), table["dst"].to_pylist(), strict=True):
        below[a].append(b)
    index, low, on, stack, out = {}, {}, set(), [], []
    for root in list(below):
        if root in index:
            continue
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        work = [(root, iter(below[root]))]
        while work:
            v, rest = work[-1]
            for w in rest:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(below.get(w, ()))))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    part = []
                    while True:
                        part.append(stack.pop())
                        on.discard(part[-1])
                        if part[-1] == v:
                            break
                    if len(part) > 1 or v in below.get(v, ()):
                        out += part
    return pa.table({"node": pa.array(out, pa.string())})


_strong.__annotations__ = {"table": pa.Table, "return": pa.Table}


def cycles(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes that lie on a cycle. What is peeled off from either end lies on none; in the rest, colours (the largest node that reaches one) run along the edges, and a colour's strong component is what reaches its largest node within the colour; components are taken out until none is left."""
    spark = edges.sparkSession
    known = nodes.select("node").distinct()
    live, out = edges.select("src", "dst").distinct(), spark.createDataFrame([], nodes.select("node").schema)
    turned = lambda e: e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    inside = lambda e, n: e.join(n.select(F.col("node").alias("src")), "src", "left_semi").join(n.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")
    while True:
        _, left = _peel(live, known)
        live = written(inside(live, left))
        _, left = _peel(turned(live), left)
        live, known = written(inside(live, left)), written(left)
        size = live.count()
        if not size:
            return out
        if size <= CORE_EDGES:
            return out.union(live.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(_strong, "node string"))

        def recolour(c: DataFrame, e: DataFrame = live) -> DataFrame:
            sent = c.select(F.col("node").alias("src"), "colour").join(e, "src").select(F.col("dst").alias("node"), "colour")
            return c.unionByName(sent).groupBy("node").agg(F.max("colour").alias("colour"))

        colour = _fixed_point(known.select("node", F.col("node").alias("colour")), recolour, F.sum(F.xxhash64("node", "colour").cast("decimal(38,0)")))
        own = written(live.join(colour.select(F.col("node").alias("src"), "colour"), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("c2")), "dst").where("colour = c2").select("src", "dst"))

        def grow(r: DataFrame, e: DataFrame = own) -> DataFrame:
            return r.union(e.join(r.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node"))).distinct()

        part = _fixed_point(colour.where("node = colour").select("node"), grow, F.count("*"))
        # a root alone is on a cycle only by an edge to itself
        out = written(out.union(inside(own, part).select("src")).distinct())
        known = written(known.join(part, "node", "left_anti"))
        live = written(inside(live, known))


def _doubled(e: DataFrame) -> DataFrame:
    """start, node and distance of every pair of nodes with a way, in rounds that each double the length: a shortest way of more than n steps goes on, from a node exactly n away, by a shortest way of its own. So pairs are held against those known once for each doubling, not once for each step."""
    seen = far = written(e.select(F.col("src").alias("start"), F.col("dst").alias("node"), F.lit(1).alias("distance")))
    length = 1
    while not far.isEmpty():
        near = seen.select(F.col("start").alias("mid"), "node", F.col("distance").alias("more"))
        longer = far.select("start", F.col("node").alias("mid")).join(near, "mid").groupBy("start", "node").agg((F.min("more") + F.lit(length)).alias("distance"))
        new = written(longer.join(seen.select("start", "node"), ["start", "node"], "left_anti"))
        seen, length = seen.unionByName(new), length * 2
        far = new.where(F.col("distance") == length)
    return seen


def closure(edges: DataFrame, start: DataFrame) -> DataFrame:
    """start, node and distance of every node reached from the start nodes, without the start itself unless it is on a cycle. edges: src, dst; start: node. From some nodes only, ways grow step by step; from all, they double."""
    e = written(edges.select("src", "dst").distinct())
    if e.join(start.select(F.col("node").alias("src")), "src", "left_anti").isEmpty():
        return _doubled(e)
    seen = front = written(start.select(F.col("node").alias("start"), F.col("node").alias("src")).distinct().join(e, "src").select("start", F.col("dst").alias("node")).distinct().withColumn("distance", F.lit(1)))
    step = 1
    while True:
        step += 1
        nxt = front.select("start", F.col("node").alias("src")).join(e, "src").select("start", F.col("dst").alias("node")).distinct()
        front = written(nxt.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("distance", F.lit(step)))
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)


#: Edges up to which they go to every executor.
FEW_EDGES = 200_000


def dep_tree(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """path (names joined by ' > ') and depth of every way down from the roots, repeated subtrees in full; a way ends where it would come back to a node of its own. As many rows as there are ways, which in a graph with many shared subtrees is far more than nodes. Ways are never sorted: of a join, only the edges are held."""
    # most ways meet in few nodes, and all ways at one node would be sorted in one task
    e = written(edges.select("src", "dst").distinct())
    e = F.broadcast(e) if e.count() <= FEW_EDGES else e.hint("shuffle_hash")
    out = front = written(roots.select("node", F.col("node").alias("path"), F.lit(0).alias("depth")))
    mark = F.lit(" > ")
    while True:
        down = front.join(e, F.col("node") == F.col("src")).where(F.instr(F.concat(mark, "path", mark), F.concat(mark, "dst", mark)) == 0)
        front = written(down.select(F.col("dst").alias("node"), F.concat("path", mark, "dst").alias("path"), (F.col("depth") + 1).alias("depth")))
        if front.isEmpty():
            return out.select("path", "depth")
        out = out.unionByName(front)


def kahn_order(nodes: list[str], edges: list[tuple[str, str]], self_edges: bool = True, cycles_first: bool = True) -> tuple[list[str], list[str]]:
    """Nodes, dependencies first, in the exact order of a first-in first-out peel of what nothing depends on, reversed; and those in or below a cycle. For the few thousand nodes of one project, on the driver."""
    degree = dict.fromkeys(nodes, 0)
    below = defaultdict(list)
    for a, b in edges:
        if a in degree and b in degree and (self_edges or a != b):
            degree[b] += 1
            below[a].append(b)
    queue, order = deque(n for n in nodes if degree[n] == 0), []
    while queue:
        n = queue.popleft()
        order.append(n)
        for b in below[n]:
            degree[b] -= 1
            if degree[b] == 0:
                queue.append(b)
    done = set(order)
    stuck = [n for n in nodes if n not in done]
    return (list(reversed(order + stuck)) if cycles_first else list(reversed(order)) + stuck), stuck
