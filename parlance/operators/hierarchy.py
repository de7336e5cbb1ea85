"""Parent-child links to full hierarchies by heavy-path decomposition.

Every step is a set operation over edges and takes a number of rounds that grows with the logarithm of the depth:
cycles are separated by pointer doubling, subtree sizes are summed by the same doubling, the child with the largest
subtree continues its parent's chain, and what is known of a chain's head is handed down from chain to chain, of which
a root path crosses at most log2(n).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.operators.ranking import positions
from parlance.session import forget, written


@dataclass
class Hierarchy:
    """labels: one row per node of a tree with links. circles: one row per node on or above a circle."""

    labels: DataFrame
    circles: DataFrame


def _replace(old: DataFrame | None, new: DataFrame, name: str) -> DataFrame:
    done = written(new, name)
    if old is not None:
        forget(old)
    return done


def links(rows: DataFrame, node: str, parent: str) -> DataFrame:
    """(node, up): every row that names a parent; up is NULL where that parent isn't among the rows.

    NULL and empty parents are none. Rows must hold one row per node.
    """
    have = rows.select(F.col(node).alias("up"), F.lit(True).alias("__have"))
    edges = rows.where(F.coalesce(F.col(parent).cast("string"), F.lit("")) != "").select(F.col(node).alias("node"), F.col(parent).alias("up"))
    return edges.join(have, "up", "left").select("node", F.when(F.col("__have"), F.col("up")).alias("up"))


def decompose(edges: DataFrame) -> Hierarchy:
    """Label the forest given by edges (node, up); up NULL marks a node that is itself a root.

    labels: node, up, root, depth, size (nodes of its subtree, itself included), head (first node of its heavy chain),
    place (steps below head), first (preorder number within the root's tree: the descendants of a node are the rows of
    the same root whose first lies in first+1 .. first+size-1). Parents that appear only as `up` are roots and get rows too.
    circles: node, circle (smallest node on the circle reached), on_circle. Empty input gives empty results.
    Repeated edges are taken once; of several parents of one node the smallest counts.
    """
    edges = edges.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("up").alias("up"))
    roots = edges.where("up IS NOT NULL").select(F.col("up").alias("node")).distinct().join(edges.select("node"), "node", "left_anti")
    base = written(edges.unionByName(roots.withColumn("up", F.lit(None).cast(dict(edges.dtypes)["up"]))), "edges")

    # jump: the ancestor `step` steps up, NULL beyond the root; below: nodes less than `step` steps below, itself included
    state = written(base.select("node", F.col("up").alias("jump"), F.lit(1).cast("long").alias("below")), "jumps")
    open_before, image_before = -1, -1
    while True:
        now = state.where("jump IS NOT NULL").agg(F.count("*").alias("n"), F.count_distinct("jump").alias("image")).first()
        if not now["n"]:
            loops = None
            break
        if now["n"] == open_before and now["image"] == image_before:
            loops = state.where("jump IS NOT NULL")
            break
        open_before, image_before = now["n"], now["image"]
        gains = state.where("jump IS NOT NULL").groupBy(F.col("jump").alias("node")).agg(F.sum("below").alias("gain"))
        nxt = state.select(F.col("node").alias("jump"), F.col("jump").alias("jump2"))
        # nodes past their root stay out of the join on jump: they would all meet on one key
        ahead = state.where("jump IS NOT NULL").join(nxt, "jump", "left").select("node", F.col("jump2").alias("jump"), "below")
        done = state.where("jump IS NULL").select("node", "jump", "below")
        state = _replace(state, ahead.unionByName(done).join(gains, "node", "left").select("node", "jump", (F.col("below") + F.coalesce("gain", F.lit(0))).alias("below")), "jumps")

    if loops is None:
        circles = base.select("node", F.col("node").alias("circle"), F.lit(False).alias("on_circle")).where(F.lit(False))
        trees = base
    else:
        circles = _circles(base, loops)
        trees = base.join(circles.select("node"), "node", "left_anti")
    sized = written(trees.join(state.select("node", F.col("below").alias("size")), "node"), "sizes")
    forget(state)

    # the heavy child goes on with its parent's chain
    heavy = sized.where("up IS NOT NULL").groupBy("up").agg(F.max(F.struct("size", "node")).alias("h")).select(F.col("h.node").alias("node"), F.col("up").alias("jump"))
    chain = written(sized.select("node").join(heavy, "node", "left").select("node", "jump", F.coalesce("jump", "node").alias("head"), F.when(F.col("jump").isNull(), 0).otherwise(1).cast("long").alias("place")), "chains")
    while chain.where("jump IS NOT NULL").limit(1).count():
        nxt = chain.select(F.col("node").alias("head"), F.col("jump").alias("jump2"), F.col("head").alias("head2"), F.col("place").alias("place2"))
        ahead = chain.where("jump IS NOT NULL").join(nxt, "head", "left").select("node", F.col("jump2").alias("jump"), F.coalesce("head2", "head").alias("head"), (F.col("place") + F.coalesce("place2", F.lit(0))).alias("place"))
        chain = _replace(chain, ahead.unionByName(chain.where("jump IS NULL")), "chains")
    body = written(sized.join(chain.select("node", "head", "place"), "node"), "bodies")
    forget(chain)
    forget(sized)

    # preorder: the heavy child directly follows its parent, light siblings come after it in order of node
    light = body.where("head = node AND up IS NOT NULL")
    ahead = positions(light.select("node", "up", "size"), ["up"], [F.col("node")], "through", weight=F.col("size")).select("node", (F.col("through") - F.col("size")).alias("earlier"))
    heavies = body.where("head <> node").select("up", F.col("size").alias("heavy_size"))
    heads = light.join(ahead, "node").join(heavies, "up", "left").select("node", "up", (F.lit(1) + F.coalesce("heavy_size", F.lit(0)) + F.col("earlier")).alias("skip"))
    above = body.select(F.col("node").alias("up"), F.col("head").alias("over"), F.col("place").alias("hop"))
    open_heads = written(heads.join(above, "up").select("node", "over", (F.col("hop") + 1).alias("depth"), (F.col("hop") + F.col("skip")).alias("first")), "heads")
    known = written(body.where("head = node AND up IS NULL").select("node", F.col("node").alias("root"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("first")), "known")
    parts, front = [known], known
    while front.limit(1).count():
        up = front.select(F.col("node").alias("over"), "root", F.col("depth").alias("d0"), F.col("first").alias("f0"))
        front = written(open_heads.join(up, "over").select("node", "root", (F.col("depth") + F.col("d0")).alias("depth"), (F.col("first") + F.col("f0")).alias("first")), "known")
        parts.append(front)
    solved = parts[0]
    for p in parts[1:]:
        solved = solved.unionByName(p)
    solved = solved.select(F.col("node").alias("head"), "root", F.col("depth").alias("d0"), F.col("first").alias("f0"))
    labels = body.join(solved, "head").select("node", "up", "root", (F.col("d0") + F.col("place")).alias("depth"), "size", "head", "place", (F.col("f0") + F.col("place")).alias("first"))
    return Hierarchy(labels, circles)


def _circles(base: DataFrame, loops: DataFrame) -> DataFrame:
    """Nodes that run into a circle. The doubling has gone past every tail, so the images of the jump are just the circles' nodes."""
    loops = written(loops.select("node", "jump"), "loops")
    on = loops.select(F.col("jump").alias("node")).distinct()
    ring = written(base.join(on, "node").select("node", F.col("up").alias("jump"), F.least("node", "up").alias("low")), "rings")
    while True:
        nxt = ring.select(F.col("node").alias("jump"), F.col("jump").alias("jump2"), F.col("low").alias("low2"))
        step = written(ring.join(nxt, "jump").select("node", F.col("jump2").alias("jump"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("moved")), "rings")
        forget(ring)
        ring = step.drop("moved")
        if not step.where("moved").limit(1).count():
            break
    low = ring.select(F.col("node").alias("jump"), F.col("low").alias("circle"))
    return loops.join(low, "jump").join(on.select("node", F.lit(True).alias("on_circle")), "node", "left").select("node", "circle", F.coalesce("on_circle", F.lit(False)).alias("on_circle"))


def chain_segments(labels: DataFrame) -> DataFrame:
    """(head, members): each heavy chain in order, top first; a path is a prefix of each of at most log2(n) chains."""
    return labels.groupBy("head").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "node"))), lambda x: x["node"]).alias("members"))


def paths(labels: DataFrame) -> DataFrame:
    """(node, path): the nodes from the root down to the node, put together from chain segments."""
    segments = written(chain_segments(labels), "segments")
    heads = labels.where("head = node").select(F.col("node").alias("head"), "up")
    place = labels.select(F.col("node").alias("up"), F.col("head").alias("over"), F.col("place").alias("hop"))
    prefix = written(heads.where("up IS NULL").select("head", F.array().cast("array<string>").alias("prefix")), "prefixes")
    parts, front = [prefix], prefix
    todo = written(heads.where("up IS NOT NULL").join(place, "up").select("head", "over", "hop"), "todo")
    while front.limit(1).count():
        over = front.join(segments, "head").select(F.col("head").alias("over"), "prefix", "members")
        front = written(todo.join(over, "over").select("head", F.concat("prefix", F.slice("members", F.lit(1), (F.col("hop") + 1).cast("int"))).alias("prefix")), "prefixes")
        parts.append(front)
    solved = parts[0]
    for p in parts[1:]:
        solved = solved.unionByName(p)
    return labels.join(solved, "head").join(segments, "head").select("node", F.concat("prefix", F.slice("members", F.lit(1), (F.col("place") + 1).cast("int"))).alias("path"))


def descendants(labels: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(node, below, steps): every descendant of each node, or of those of `of` (column node), read off the preorder intervals.

    An interval is the union of at most two blocks of each power of two, and a place lies in one block of each; so intervals
    and places meet in blocks, and no tree is a single key however large it is.
    """
    top = labels if of is None else labels.join(of.select("node"), "node", "left_semi")
    largest = labels.agg(F.max("size")).first()[0] or 1
    levels = F.sequence(F.lit(0), F.lit(int(largest).bit_length()))
    wide = top.where("size > 1").select("node", "root", (F.col("first") + 1).alias("lo"), (F.col("first") + F.col("size")).alias("hi"), F.col("depth").alias("d0"), F.explode(levels).alias("l"))
    edges = wide.withColumns({"lo": F.expr("shiftright(lo + shiftleft(1L, l) - 1, l)"), "hi": F.expr("shiftright(hi, l)")}).where("lo < hi")
    blocks = edges.select("node", "root", "d0", "l", F.explode(F.filter(F.array(F.when(F.col("lo") % 2 == 1, F.col("lo")), F.when(F.col("hi") % 2 == 1, F.col("hi") - 1)), lambda x: x.isNotNull())).alias("block"))
    low = labels.where("depth > 0").select(F.col("node").alias("below"), "root", "depth", "first", F.explode(levels).alias("l")).withColumn("block", F.expr("shiftright(first, l)"))
    return blocks.join(low, ["root", "l", "block"]).select("node", "below", (F.col("depth") - F.col("d0")).alias("steps"))


def opened(edges: DataFrame, circles: DataFrame) -> DataFrame:
    """(node, up): the edges of the nodes that run into a circle, each circle cut above its smallest node, which becomes a root."""
    cut = F.col("on_circle") & (F.col("node") == F.col("circle"))
    return edges.join(circles, "node").select("node", F.when(~cut, F.col("up")).alias("up"))


def all_descendants(labels: DataFrame, around: DataFrame, circles: DataFrame) -> DataFrame:
    """(node, below, steps): every descendant of every node, as many rows as there are pairs.

    labels hold the trees, `around` the labels of the opened circles. On a circle everything that runs into it is below
    each of its nodes: what the cut leaves out are the nodes of the circle deeper than the one where a path enters it.
    """
    ring = written(around.join(circles.where("on_circle").select("node"), "node").select("node", "root", F.col("depth").alias("q")), "ring")
    pairs = written(descendants(around), "pairs")
    own = around.select("node", F.col("node").alias("below"))
    entry = pairs.select("node", "below").unionByName(own).join(ring.select("node", "q"), "node").groupBy("below").agg(F.max("q").alias("p"))
    last = ring.groupBy("root").agg(F.count("*").alias("k"))
    low = around.select(F.col("node").alias("below"), "root", "depth").join(entry, "below").join(last, "root")
    over = low.join(ring, "root").where("q > p").select("node", "below", (F.col("depth") + F.col("k") - F.col("q")).alias("steps"))
    return descendants(labels).unionByName(pairs).unionByName(over)


def rooted(hierarchy: Hierarchy) -> DataFrame:
    """(node, root, depth): depth -1 and the smallest node of the circle for those that run into one."""
    return hierarchy.labels.select("node", "root", F.col("depth").cast("int").alias("depth")).unionByName(hierarchy.circles.select("node", F.col("circle").alias("root"), F.lit(-1).alias("depth")))
