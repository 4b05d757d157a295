"""Reachability over edge tables by rounds of joins, each round stored reliably."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bomscope.session import written


def _edges(edges: DataFrame, src: str, dst: str) -> DataFrame:
    return edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL").distinct()


def follow(links: DataFrame) -> DataFrame:
    """(n, last, low, ring) for links (n, to), one per n: the end of n's chain of links, and the smallest node on the way.

    Every round doubles the steps, so rounds grow with the logarithm of the longest chain.  Nodes that are still moving
    after as many steps as there are links never end: they lie on a ring or run into one.
    """
    state = written(links.select("n", F.col("to").alias("last"), F.col("n").alias("low")))
    size, steps = state.count(), 1
    while True:
        beyond = state.select(F.col("n").alias("last"), F.col("last").alias("_last"), F.col("low").alias("_low"))
        state = written(state.join(beyond, "last", "left").select(
            "n", F.coalesce("_last", "last").alias("last"), F.least("low", "_low").alias("low"), F.col("_last").isNotNull().alias("ring")))
        if steps >= size or state.filter("ring").isEmpty():
            return state
        state, steps = state.drop("ring"), 2 * steps


def _contract(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Every chain of nodes with one edge in and one out becomes one edge.

    Returns the shorter edges, the nodes that went with the ends of their chain (n, first, last), and nodes that form
    rings of their own (n, colour); None if there is no such node.
    """
    ins = edges.groupBy(F.col("b").alias("n")).agg(F.count("*").alias("ins"), F.min("a").alias("prev")).filter("ins = 1")
    outs = edges.groupBy(F.col("a").alias("n")).agg(F.count("*").alias("outs"), F.min("b").alias("to")).filter("outs = 1")
    links = written(ins.join(outs, "n").filter("prev <> n").select("n", "prev", "to"))
    if links.isEmpty():
        return None
    forth = follow(links.select("n", "to"))
    back = follow(links.select("n", F.col("prev").alias("to"))).select("n", F.col("last").alias("first"))
    ends = written(forth.join(back, "n").join(links.select("n", "prev"), "n"))
    chains = ends.filter("NOT ring")
    heads = chains.filter("prev = first").select(F.col("first").alias("a"), F.col("last").alias("b"))
    rest = (edges.join(links.select(F.col("n").alias("a")), "a", "left_anti").join(links.select(F.col("n").alias("b")), "b", "left_anti")
            .select("a", "b").unionByName(heads).distinct())
    return written(rest), chains.select("n", "first", "last"), ends.filter("ring").select("n", F.col("low").alias("colour"))


def _reduce(edges: DataFrame, chains: list[DataFrame], rings: list[DataFrame]) -> DataFrame:
    """Edges that may lie on a cycle, with chains contracted; what went is added to `chains` and `rings`.

    An edge goes if nobody reaches its source or its target leads nowhere.  Where a round of that removes little, the
    graph has long chains: they are contracted, so a chain takes rounds as the logarithm of its length.
    """
    size = edges.count()
    while size:
        edges = written(
            edges.join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
            .join(edges.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"))
        left = edges.count()
        if left > 0.9 * size:
            shorter = _contract(edges)
            if shorter is None:
                if left == size:
                    return edges
            else:
                edges, chain, ring = shorter
                chains.append(chain)
                rings.append(ring)
                left = edges.count()
        size = left
    return edges


def _spread(labels: DataFrame, edges: DataFrame, within: bool) -> DataFrame:
    """Fixpoint of "a node takes the greatest colour of its predecessors" (`within`: only own colour)."""
    while True:
        if within:
            # (n, colour, hit): hit spreads from b to a along edges that stay inside one colour.
            hit = labels.filter("hit = 1").select(F.col("n").alias("b"), F.col("colour").alias("c"))
            got = edges.join(hit, "b").select(F.col("a").alias("n"), F.col("c").alias("colour")).distinct()
            nxt = labels.join(got.withColumn("now", F.lit(1)), ["n", "colour"], "left").select(
                "n", "colour", F.greatest("hit", F.coalesce("now", F.lit(0))).alias("hit"),
                (F.coalesce("now", F.lit(0)) > F.col("hit")).alias("moved"))
        else:
            best = (edges.join(labels.select(F.col("n").alias("a"), F.col("colour").alias("c")), "a")
                    .groupBy(F.col("b").alias("n")).agg(F.max("c").alias("c")))
            nxt = labels.join(best, "n", "left").select(
                "n", F.greatest("colour", "c").alias("colour"),
                (F.greatest("colour", "c") > F.col("colour")).alias("moved"))
        nxt = written(nxt)
        labels = nxt.drop("moved")
        if nxt.filter("moved").isEmpty():
            return labels


def cycle_nodes(edges: DataFrame, src: str, dst: str, name: str = "node") -> DataFrame:
    """Nodes on a directed cycle: members of a strongly connected component, or self-loops.

    State is linear in the graph; no (root, node) pairs or paths are enumerated.  Edges that cannot be on a cycle are
    trimmed and chains contracted first (an acyclic graph ends there).  The rest is split by colouring: colours
    spread forwards, then from each colour's own node backwards inside the colour, which yields one component per
    colour; found components are removed and the remainder is reduced again.  At last a contracted node is on a cycle
    if both ends of its chain are in one component.
    """
    chains: list[DataFrame] = []
    found: list[DataFrame] = []
    rest = _reduce(written(_edges(edges, src, dst)), chains, found)
    while not rest.isEmpty():
        nodes = rest.select(F.explode(F.array("a", "b")).alias("n")).distinct()
        colours = _spread(nodes.withColumn("colour", F.col("n")), rest, within=False)
        seeded = colours.withColumn("hit", (F.col("n") == F.col("colour")).cast("int"))
        same = (rest.join(colours.select(F.col("n").alias("a"), F.col("colour").alias("ca")), "a")
                .join(colours.select(F.col("n").alias("b"), F.col("colour").alias("cb")), "b")
                .filter("ca = cb").select("a", "b"))
        members = written(_spread(seeded, written(same), within=True).filter("hit = 1").select("n", "colour"))
        # A component of one node is a cycle only with a self-loop.
        big = members.join(members.groupBy("colour").agg(F.count("*").alias("size")).filter("size > 1"), "colour", "left_semi")
        loops = rest.filter("a = b").select(F.col("a").alias("n"))
        found.append(big.select("n", "colour").unionByName(members.join(loops, "n", "left_semi").select("n", "colour")).distinct())
        gone = members.select("n")
        rest = _reduce(written(rest.join(gone.select(F.col("n").alias("a")), "a", "left_anti")
                                    .join(gone.select(F.col("n").alias("b")), "b", "left_anti").select("a", "b")), chains, found)
    if not found:
        return rest.sparkSession.createDataFrame([], f"{name} string")
    cyclic = found[0]
    for more in found[1:]:
        cyclic = cyclic.unionByName(more)
    cyclic = written(cyclic)
    for chain in reversed(chains):  # the ends of an early chain may have gone in a later one
        ends = (chain.join(cyclic.select(F.col("n").alias("first"), F.col("colour").alias("c1")), "first")
                .join(cyclic.select(F.col("n").alias("last"), F.col("colour").alias("c2")), "last").filter("c1 = c2"))
        cyclic = written(cyclic.unionByName(ends.select("n", F.col("c1").alias("colour"))))
    return cyclic.select(F.col("n").alias(name)).distinct()


def reach_with_depth(edges: DataFrame, src: str, dst: str, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(seed, node, depth): every distinct depth at which a node is reached from a seed.

    Each round keeps distinct (seed, node) of that depth, so work is bounded by nodes, not
    paths.  On a cycle depths would grow for ever: check `cycle_nodes` first, or pass
    `max_depth`; the default bound is the number of edges.
    """
    links = written(_edges(edges, src, dst))
    bound = links.count() if max_depth is None else max_depth
    front = seeds.select(F.col(seeds.columns[0]).alias("seed"), F.col(seeds.columns[0]).alias("node")).distinct()
    out, depth = None, 0
    while depth < bound:
        depth += 1
        front = written(front.join(links, front["node"] == links["a"]).select("seed", F.col("b").alias("node")).distinct())
        if front.isEmpty():
            break
        step = front.withColumn("depth", F.lit(depth))
        out = step if out is None else out.unionByName(step)
    return out if out is not None else seeds.sparkSession.createDataFrame([], "seed string, node string, depth int")
