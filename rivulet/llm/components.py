"""Groups of similar things: connected components of their links, and links from shared buckets.

Components come from alternating large and small stars
(Kiveris et al., "Connected Components in MapReduce and Beyond", 2014), in
DataFrame operations alone. A star step needs the least neighbour of each
node, which is an aggregate and a join back, so no list of neighbours is ever
gathered. The links of each round are written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, materialize, measured, text_bytes


def _round(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    moved = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.withColumnRenamed("m", "v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``links`` (u, v) of longs -> (id, component): each linked node and the least node of its component.

    Links with a null end and links of a node to itself join nothing. Repeated links count once.
    """
    edges = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    state = {"n": F.count("*"), "sum": F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))}  # equal for equal sets of links
    (edges, now), before = measured(edges, "links", **state), None
    while now["n"] and now != before:
        last = edges
        (edges, now), before = measured(_round(last), "links", **state), now
        drop(last)
    stars = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("id"), "component").distinct())


def buckets(dealt: DataFrame) -> DataFrame:
    """``dealt`` (node, key), each pair once -> node, key, and the ``size`` of the bucket, for keys of several nodes."""
    sizes = dealt.groupBy("key").agg(F.count("*").alias("size"))
    return dealt.join(sizes.filter("size > 1"), "key")


def counted(dealt: DataFrame) -> DataFrame:
    """As ``buckets``, with one exchange and one sort of the rows where that takes two of each."""
    return dealt.withColumn("size", F.count("*").over(Window.partitionBy("key"))).filter("size > 1")


#: An element of more sets than this counts as common and comes late in the order of ``prefix_pairs``; any order is right.
COMMON = 16


def close_enough(x: list[Column], y: list[Column], nx: Column, ny: Column, similarity: float) -> Column:
    """Whether sets of ``nx`` and ``ny`` elements with the sketches ``x`` and ``y`` can have this Jaccard similarity.

    Sets of the similarity s differ in at most (1 - s) / (1 + s) * (nx + ny) elements, and sketches in no more bits.
    """
    differing = sum((F.bit_count(a.bitwiseXOR(b)) for a, b in zip(x, y, strict=True)), F.lit(0))
    return (F.least(nx, ny) >= similarity * F.greatest(nx, ny) - 1e-9) & (differing * (1 + similarity) <= (1 - similarity) * (nx + ny) + 1e-9)


def _near(x: str, y: str, sketches: DataFrame, similarity: float) -> Column:
    """Whether rows of two aliases with the columns of ``sketches`` are of one kind and pass ``close_enough``."""
    words = [c for c in sketches.columns if c not in ("node", "kind", "n")]
    near = close_enough([F.col(f"{x}.{w}") for w in words], [F.col(f"{y}.{w}") for w in words], F.col(f"{x}.n"), F.col(f"{y}.n"), similarity)
    return (F.col(f"{x}.kind") == F.col(f"{y}.kind")) & near


def accompanied(members: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """Those of ``members`` (node, key, ...) that have another node in their bucket from which sketches (node, kind, n, words) do not tell them apart.

    What is left out has no link in that bucket. A member is one row at most, however many others are close to it.
    """
    each = members.select("node", "key").join(sketches, "node")
    close = each.alias("x").join(each.alias("y"), (F.col("x.key") == F.col("y.key")) & F.expr("x.node <> y.node") & _near("x", "y", sketches, similarity), "left_semi")
    return close.select("node", "key").distinct()


def prefix_pairs(nodes: DataFrame, sets: Callable[[DataFrame], DataFrame], similarity: float) -> DataFrame:
    """Pairs (a, b) of ``nodes`` (node, component, rest) in two components, one of them ``rest``; none of this Jaccard similarity is left out.

    ``sets`` gives (node, kind, value), an array of distinct elements, for a table with the column node; only sets of one
    kind are compared. Further columns are the words of a sketch for ``close_enough``; where elements are few, as runs of
    two characters are, prefixes alone would leave pairs in number with the square of the nodes. Elements are put in one order, common ones last. If x and y have at least the similarity s, let i and j be the places (from 0) of
    their first common element. What stands before is not common, so the overlap, which is at least s / (1 + s) *
    (nx + ny), is at most nx - i and at most ny - j. Hence i + j <= (1 - s) / (1 + s) * (nx + ny): the place is in the
    first (1 - s) / (1 + s) of one of the two sets, and before n - ceil(s n) + 1 in both. Joining on those places leaves
    out what has only a common passage.
    """
    each = sets(nodes)
    sketch = [c for c in each.columns if c not in ("node", "kind", "value")]
    each = materialize(each.join(nodes, "node").withColumn("n", F.size("value")), "bucket-sets")
    elements = each.select("node", "kind", F.explode("value").alias("element"))
    common = materialize(elements.groupBy("element").agg(F.count("*").alias("times")).filter(F.col("times") > COMMON), "common")
    placed = elements.join(common, "element", "left").withColumn("times", F.coalesce("times", F.lit(0)))
    ordered = placed.groupBy("node", "kind").agg(F.sort_array(F.collect_list(F.struct("times", "element"))).alias("ordered"))  # no more than the set itself
    until = (F.col("n") - F.ceil(similarity * F.col("n") - 1e-9) + 1).cast("int")
    own = ["node", "kind", "component", "rest", "n", *sketch]
    places = ordered.join(each.select(*own), ["node", "kind"]).select(*own, F.posexplode(F.slice("ordered", F.lit(1), until)).alias("place", "x"))
    places = materialize(places.select(*own, "place", F.col("x.element").alias("element")), "prefixes")
    drop(each, common)
    early = places.filter(F.col("place") * (1 + similarity) <= (1 - similarity) * F.col("n") + 1e-9)

    def joined(x: DataFrame, y: DataFrame) -> DataFrame:
        x, y = x.alias("x"), y.alias("y")
        near = F.expr("x.element = y.element and x.kind = y.kind and x.component <> y.component")
        near &= close_enough([F.col(f"x.{w}") for w in sketch], [F.col(f"y.{w}") for w in sketch], F.col("x.n"), F.col("y.n"), similarity)
        room = F.least(F.expr("x.n - x.place"), F.expr("y.n - y.place")) >= similarity / (1 + similarity) * F.expr("x.n + y.n") - 1e-9
        return x.join(y, near & room).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))

    return joined(early.filter("rest"), places).unionByName(joined(early, places.filter("rest"))).distinct()


#: Nodes of a large bucket that are compared with each other, or with as many others, at once.
BLOCK = 4096
_CELL = ["key", "kind", "i", "j"]


def _close(cell: pa.Table, words: list[str], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of pairs of a cell's nodes that ``close_enough`` lets through, by wide sketches too, of two components and with one ``rest``."""
    n = cell["n"].to_numpy()
    order = np.argsort(n, kind="stable")
    n, component, rest, block = n[order], *[cell[c].to_numpy()[order] for c in ("component", "rest", "block")]
    sketch = [cell[w].to_numpy()[order].view(np.uint64) for w in words]
    across, found = cell["i"][0].as_py() != cell["j"][0].as_py(), [np.zeros((2, 0), np.intp)]
    since, upto = np.searchsorted(n, n * similarity - 1e-6), np.searchsorted(n, n / similarity + 1e-6, "right")  # beyond them sets are too small or large
    ours = np.flatnonzero(rest)
    for at in range(0, len(ours), 256):
        one = ours[at : at + 256]
        other = np.arange(since[one[0]], upto[one[-1]])
        differing = np.zeros((len(one), len(other)), np.uint16)
        for w in sketch:
            differing += np.bitwise_count(w[one, None] ^ w[None, other])
        fine = differing * (1 + similarity) <= (1 - similarity) * (n[one, None] + n[None, other]) + 1e-9
        fine &= np.minimum(n[one, None], n[None, other]) >= similarity * np.maximum(n[one, None], n[None, other]) - 1e-9
        fine &= (component[one, None] != component[None, other]) & (~rest[None, other] | (one[:, None] < other[None, :]))
        if across:
            fine &= block[one, None] != block[None, other]
        x, y = np.nonzero(fine)
        found.append(np.stack((one[x], other[y])))
    x, y = np.concatenate(found, axis=1)
    if "wide" in cell.column_names and len(x):
        wide = text_bytes(cell["wide"].combine_chunks())[0].view(np.uint64).reshape(len(n), -1)[order]
        differing = np.concatenate([np.bitwise_count(wide[x[at : at + BLOCK]] ^ wide[y[at : at + BLOCK]]).sum(axis=1, dtype=np.int64) for at in range(0, len(x), BLOCK)])
        fine = differing * (1 + similarity) <= (1 - similarity) * (n[x] + n[y]) + 1e-9
        x, y = x[fine], y[fine]
    return order[x], order[y]


def close_pairs(members: DataFrame, sketches: DataFrame, similarity: float, most: int = BLOCK, wide: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) in a bucket of two components, one of them ``rest``, whose sketches do not tell them apart.

    ``members`` is (key, size, node, component, rest), and ``sketches`` (node, kind, n, further words). A bucket of more than
    ``most`` nodes is cut to blocks, which meet two at a time, so no task holds more than two of them. Only pairs that are close
    are rows; the comparison of two sketches is a few operations on words. In large sets many differences fall into slots that are
    taken already; ``wide`` (node, kind, wide), where given, has sketches of more slots as bytes, by which such pairs are compared too.
    """
    words = [c for c in sketches.columns if c not in ("node", "kind", "n")]
    known = sketches if wide is None else sketches.join(wide, ["node", "kind"])
    each = members.join(known, "node").withColumn("parts", F.ceil(F.col("size") / most).cast("int"))
    each = each.withColumn("block", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    cells = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    cells = cells.select(*_CELL, "node", "component", "rest", "block", "n", *words, *([] if wide is None else ["wide"])).repartition(*_CELL).sortWithinPartitions(*_CELL)

    def pairs(cell: pa.Table):
        if len(cell) > 1:
            x, y = _close(cell, words, similarity)
            a, b = cell["node"].to_numpy()[x], cell["node"].to_numpy()[y]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def run(batches):
        held = None  # the last cell so far, which may go on
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table]).combine_chunks()
            new = np.zeros(max(len(table) - 1, 0), bool)
            for c in _CELL:
                values = table[c].to_numpy()
                new |= values[1:] != values[:-1]
            ends = [0, *(np.flatnonzero(new) + 1).tolist()]
            for lo, hi in zip(ends, ends[1:]):  # noqa: B905
                yield from pairs(table.slice(lo, hi - lo))
            held = table.slice(ends[-1])
        if held is not None:
            yield from pairs(held)

    return cells.mapInArrow(run, "a bigint, b bigint").distinct()


def group_buckets(members: DataFrame, verify: Callable[[DataFrame], DataFrame], sets: Callable[[DataFrame], DataFrame] | None, similarity: float, whole: int = 32, sketches: DataFrame | None = None, wide: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``members`` (node, key, size) -> (id, component), over links between nodes that share a key.

    ``verify`` keeps those of the pairs (a, b) that are links. A bucket is not expanded to its pairs: its most central
    node leads it (the one whose buckets are largest in sum, which in a group of variants is the one nearest to all),
    and each node is verified with the best of its leaders, then with its leaders in groups that are still others.
    That joins what belongs together in all but a few buckets. There the nodes outside the largest part are verified
    with all others of the bucket if it has at most ``whole`` nodes. In larger ones, where all pairs would grow with the
    square of what has one passage in common, they are verified with all nodes that ``prefix_pairs`` finds, which leaves
    out only pairs that are no links. ``sets`` gives (node, kind, value) and sketches for a table of nodes, and ``similarity`` is
    the Jaccard similarity of a link. Where ``sketches`` (node, kind, n, words) are given, ``close_pairs`` takes the place of
    ``prefix_pairs``: it compares what shares a bucket, by sketches, and deals no elements; and in smaller buckets only pairs that sketches
    do not tell apart are rows. ``wide`` gives the wide sketches for ``close_pairs`` of a table of nodes.

    So any two nodes that share a bucket end up in one group, have been verified, or are no link by their prefixes.
    """
    scores = members.groupBy("node").agg(F.sum("size").alias("score"))
    scored = materialize(members.join(scores, "node"), "scored")
    top = F.max(F.struct("score", (-F.col("node")).alias("order"))).alias("top")
    leaders = scored.groupBy("key").agg(top).select("key", (-F.col("top.order")).alias("leader"), F.col("top.score").alias("leader_score"))
    led = materialize(scored.join(leaders, "key"), "led")
    drop(scored)

    def pair(x: str, y: str) -> list:
        return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]

    groups = tested = None  # the components so far, and all pairs verified

    def grouped() -> DataFrame:
        found = groups.withColumnRenamed("id", "node")
        return materialize(led.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "parts")

    def spend(pairs: DataFrame) -> bool:
        """Verify those of the pairs that are new; whether that changed the groups."""
        nonlocal groups, tested
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs, found = measured(pairs, "pairs", n=F.count("*"))
        if not found["n"] and groups is not None:
            return False
        tested = pairs if tested is None else tested.unionByName(pairs)
        links, found = measured(verify(pairs).select(F.col("a").alias("u"), F.col("b").alias("v")), "verified", n=F.count("*"))
        if groups is None:
            groups = components(links)
        elif found["n"]:
            groups = components(links.unionByName(groups.select(F.col("id").alias("u"), F.col("component").alias("v"))))
        drop(links)
        return bool(found["n"])

    best = led.filter("leader <> node").groupBy("node").agg(F.max_by("leader", F.struct("leader_score", (-F.col("leader")).alias("order"))).alias("leader"))
    spend(best.select(*pair("node", "leader")).distinct())
    now = grouped()
    leads = now.filter("node = leader").select("key", F.col("component").alias("lead"))
    if spend(now.join(leads, "key").filter("component <> lead").select(*pair("leader", "node")).distinct()):
        now = grouped()
    shares = now.groupBy("key", "component").agg(F.count("*").alias("n"))
    apart = shares.groupBy("key").agg(F.max_by("component", "n").alias("largest"), F.count("*").alias("parts")).filter("parts > 1")
    split, found = measured(now.join(apart, "key").select("key", "size", "node", "component", "largest"), "apart", size=F.max("size"))
    if found["size"] is None:
        return groups
    small, large = split.filter(F.col("size") <= whole), split.filter(F.col("size") > whole)
    others = small.select("key", F.col("node").alias("other"), F.col("component").alias("lead"))
    rest = small.filter("component <> largest").select("key", "node", "component")
    if sketches is None:
        pairs = rest.join(others, "key").filter("component <> lead").select(*pair("node", "other"))
    else:
        x, y = rest.join(sketches, "node").alias("x"), small.select("key", "node", "component").join(sketches, "node").alias("y")
        pairs = x.join(y, F.expr("x.key = y.key and x.component <> y.component") & _near("x", "y", sketches, similarity)).select(*pair("x.node", "y.node"))
    if found["size"] > whole and sketches is not None:
        mine = large.select("key", "size", "node", "component", (F.col("component") != F.col("largest")).alias("rest"))
        finer = None if wide is None else materialize(wide(mine.select("node").distinct()), "wide")
        pairs = pairs.unionByName(close_pairs(mine, sketches, similarity, wide=finer))
    elif found["size"] > whole:
        nodes = large.groupBy("node", "component").agg(F.bool_or(F.col("component") != F.col("largest")).alias("rest"))
        pairs = pairs.unionByName(prefix_pairs(nodes, sets, similarity))
    spend(pairs.distinct())
    return groups


def dealt_pairs(pairs: DataFrame, values: DataFrame, most: int = 256) -> DataFrame:
    """``pairs`` (a, b, ...) with the value of each end: a, b, va, vb, ...; ``values`` is (node, value).

    A node in many pairs is copied once for each ``most`` of them, and its pairs are dealt to the copies. The numbers of
    copies are written first, so that the joins with them are stages of their own, whose skewed tasks Spark can split.
    """
    hubs = materialize(pairs.groupBy("a").agg(F.expr(f"cast(ceil(count(*) / {most}) as int)").alias("parts")), "hubs")
    left = hubs.join(values.select(F.col("node").alias("a"), F.col("value").alias("va")), "a")
    left = left.select("a", "va", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    right = pairs.join(hubs, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")).drop("parts")
    right = right.join(values.select(F.col("node").alias("b"), F.col("value").alias("vb")), "b")
    return right.join(left, ["a", "part"])


def alike(pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b, va, vb) whose arrays ``va`` and ``vb``, taken as sets, have at least this Jaccard similarity.

    The arrays go through a generator, which Spark does not merge with the filter: each is computed once for a pair.
    """
    once = pairs.select("a", "b", F.explode(F.array(F.struct("va", "vb"))).alias("v"))
    return once.filter(F.size(F.array_intersect("v.va", "v.vb")) >= similarity * F.size(F.array_union("v.va", "v.vb"))).select("a", "b")
