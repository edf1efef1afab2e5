"""Similarity clusters: average linkage by reciprocal nearest neighbours on a sparse graph, and their description.

The average similarity of two clusters of unit vectors is the product of their sums over the product of their sizes, so a cluster is
kept as (sum, size) and linkage is exact without the pairs. The graph holds each cluster's few best partners; each round merges all
mutual best pairs at once, and the graph is rebuilt until no pair of clusters reaches the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm import vectors as V
from quern.llm.graph import connected_components
from quern.session import durable_round

#: Partners of a cluster in the sparse graph.
PARTNERS = 6
#: Nodes of a group whose rounds run in one task on the sparse graph; the graph itself comes from many tasks beyond GROUP_ROWS.
LINK_ROWS = 65_536
#: Dissimilar pairs of a cluster up to this number are worked off inside one task.
MISS_PAIRS = 4_000_000


def similarity_of(sa: np.ndarray, na: np.ndarray, sb: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Average similarities of clusters, to nine places, so that ties do not hang on the order of additions."""
    return np.rint(np.einsum("ij,ij->i", sa, sb) / (na * nb) * 1e9) / 1e9


def reciprocal_rounds(sums: np.ndarray, sizes: np.ndarray, lab: np.ndarray, a: np.ndarray, b: np.ndarray, floor: float) -> None:
    """Merges mutual best pairs of the sparse graph (a, b) until none is left; sums, sizes and lab change in place.

    Only edges whose ends changed are scored anew, so a round costs some passes over the edges, also where one large cluster draws all
    others to it and few pairs are mutual."""
    n = len(sizes)
    s, rounds = similarity_of(sums[a], sizes[a], sums[b], sizes[b]), 0
    while True:
        ok = (s >= floor) & (a != b)
        if not ok.all():
            a, b, s = a[ok], b[ok], s[ok]
        if not len(a):
            return
        top = np.full(n, -np.inf)
        np.maximum.at(top, a, s)
        np.maximum.at(top, b, s)
        mate = np.full(n, n)
        for end, other in ((a, b), (b, a)):
            at = s == top[end]
            np.minimum.at(mate, end[at], other[at])
        x = np.flatnonzero(mate < n)
        x = x[(mate[mate[x]] == x) & (x < mate[x])]
        y = mate[x]
        sums[x] += sums[y]
        sizes[x] += sizes[y]
        to = np.arange(n)
        to[y] = x
        lab[:] = to[lab]
        met = np.zeros(n, bool)
        met[x] = True
        a, b = to[a], to[b]
        rounds += 1
        if rounds % 16 == 0:  # edges that have become the same one
            _, at = np.unique(np.minimum(a, b) * n + np.maximum(a, b), return_index=True)
            a, b, s = a[at], b[at], s[at]
        new = np.flatnonzero((met[a] | met[b]) & (a != b))
        s[new] = similarity_of(sums[a[new]], sizes[a[new]], sums[b[new]], sizes[b[new]])


def link_average(sums: np.ndarray, sizes: np.ndarray, floor: float, k: int = PARTNERS) -> np.ndarray:
    """Cluster label (smallest member) of each of the given clusters, after all merges at an average similarity >= floor."""
    sums, sizes = sums.copy(), sizes.astype(np.float64).copy()
    lab = np.arange(len(sizes))
    while True:
        live = np.unique(lab)
        mean = sums[live] / sizes[live][:, None]
        ids = np.arange(len(live))
        ea, eb, es = [], [], []
        for s in range(0, len(live), 1024):
            q = np.rint(mean[s : s + 1024] @ mean.T * V.MICRO).astype(np.int64)
            r, c = V.best(q, ids[s : s + 1024], ids, k)
            hit = q[r, c] >= floor * V.MICRO
            ea.append(r[hit] + s), eb.append(c[hit]), es.append(q[r, c][hit])
        a, b, q = np.concatenate(ea), np.concatenate(eb), np.concatenate(es)
        if not len(a):
            return lab
        same = q >= V.MICRO  # copies merge in any order with the same result
        group = V.merge_labels(np.arange(len(live)), a[same], b[same])
        to = np.arange(len(sizes))
        moved = np.flatnonzero(group != np.arange(len(live)))
        np.add.at(sums, live[group[moved]], sums[live[moved]])
        np.add.at(sizes, live[group[moved]], sizes[live[moved]])
        to[live[moved]] = live[group[moved]]
        lab = to[lab]
        a, b = live[group[a]], live[group[b]]
        a, b = np.minimum(a, b), np.maximum(a, b)
        before = len(np.unique(lab))
        reciprocal_rounds(sums, sizes, lab, a[a != b], b[a != b], floor)
        if not len(moved) and len(np.unique(lab)) == before:
            return lab


def link_rows(u: np.ndarray, v: np.ndarray, floor: float) -> np.ndarray:
    """link_average of rows in the order of their keys: equal vectors are one cluster from the start."""
    _, first, same = np.unique(np.ascontiguousarray(v + 0.0).view(f"V{v.itemsize * v.shape[1]}").ravel(), return_index=True, return_inverse=True)
    first = first[same.ravel()]
    live = np.unique(first)
    size = np.bincount(first, minlength=len(u))[live]
    lab = link_average(u[live] * size[:, None], size, floor)
    return live[lab][np.searchsorted(live, first)]


def peel(u: np.ndarray, floor: int) -> np.ndarray:
    """Rows left after members that are not similar to all others are taken out, the least similar first."""
    miss = np.concatenate([V.micro(u[s : s + 1024], u) < floor for s in range(0, len(u), 1024)]) if len(u) else np.zeros((0, 0), bool)
    bad, live = miss.sum(1), np.ones(len(u), bool)
    while live.any() and bad.max() > 0:
        worst = np.argmax(bad)
        live[worst] = False
        bad -= miss[:, worst]
        bad[worst] = 0
        miss[worst] = False
    return np.flatnonzero(live)


def peel_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Keys that peel() takes out, given the pairs of keys that are not similar."""
    keys, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    end, other = at, np.concatenate([at[len(a) :], at[: len(a)]])
    order = np.argsort(end, kind="stable")
    other = other[order]
    bad = np.bincount(end, minlength=len(keys))
    start = np.concatenate([[0], np.cumsum(bad)])
    out = []
    while len(keys) and bad.max() > 0:
        worst = int(np.argmax(bad))
        out.append(worst)
        near = other[start[worst] : start[worst + 1]]
        bad[near] -= 1
        bad[worst] = np.iinfo(bad.dtype).min // 2
    return keys[out]


def _link_groups(dim: int, similarity: float, linked: bool = False):
    """Clusters of the groups `comp` without their misfits; with `linked`, each group is one cluster already."""
    floor = round(similarity * V.MICRO)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in V.runs(it, "comp"):
            for b in t.combine_chunks().select(["key", "vector", "comp"]).to_batches():
                rows, keys, v = V.valid_block(b, dim)
                comp = b.column(2).to_numpy(zero_copy_only=False)[rows]
                u = V.unit(v)
                out = []
                for lo, hi in V.spans(comp) if len(comp) else []:
                    lab = np.zeros(hi - lo, np.int64) if linked else link_rows(u[lo:hi], v[lo:hi], similarity)
                    order = np.argsort(lab, kind="stable")
                    for s, e in V.spans(lab[order]):
                        m = order[s:e] + lo
                        m = m[peel(u[m], floor)]
                        mean = u[m].sum(0)
                        typical = np.rint(u[m] @ mean / max(np.linalg.norm(mean), 1e-12) * V.MICRO)
                        out.append((keys[m], np.full(len(m), keys[m].min()), np.full(len(m), len(m)), typical))
                if out:
                    key, cluster, size, typical = (np.concatenate(x) for x in zip(*out))
                    yield pa.record_batch([pa.array(key, pa.int64()), pa.array(cluster, pa.int64()), pa.array(size, pa.int64()), pa.array(typical / V.MICRO, pa.float64())], names=["key", "cluster", "size", "typicality"])

    return run


def _finish_groups(dim: int, similarity: float):
    """Nodes (comp, node, total, n) of groups that fit one task -> (node, cluster)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in V.runs(it, "comp"):
            t = t.combine_chunks()
            comp, node, n = (t.column(x).to_numpy() for x in ("comp", "node", "n"))
            sums = _matrix(t.column("total").combine_chunks(), dim)
            for lo, hi in V.spans(comp):
                lab = link_average(sums[lo:hi], n[lo:hi], similarity)
                yield pa.record_batch([pa.array(node[lo:hi], pa.int64()), pa.array(node[lo:hi][lab], pa.int64())], names=["node", "cluster"])

    return run


def _matrix(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _rounds_in_task(nodes: DataFrame, edges: DataFrame, similarity: float, dim: int) -> DataFrame:
    """The moves (node, to) of reciprocal_rounds() on the edges (a, b) of each group, one group a task."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("node").combine_chunks()
        node = left.column("node").to_numpy()
        lab = np.arange(len(node))
        if right.num_rows:
            at = [np.searchsorted(node, right.column(x).to_numpy()) for x in ("a", "b")]
            sums = _matrix(left.column("total").combine_chunks(), dim).copy()
            reciprocal_rounds(sums, left.column("n").to_numpy().astype(np.float64), lab, *at, similarity)
        moved = np.flatnonzero(lab != np.arange(len(node)))
        return pa.table({"node": pa.array(node[moved], pa.int64()), "to": pa.array(node[lab[moved]], pa.int64())})

    placed = durable_round(edges.select("a", "b").join(nodes.select(F.col("node").alias("a"), F.col("comp").alias("group")), "a").select("group", "a", "b"))
    return durable_round(nodes.select("comp", "node", "total", "n").groupBy("comp").cogroup(placed.groupBy("group")).applyInArrow(run, "node bigint, to bigint"))


def _edge_scores(dim: int):
    """(a, b, sa, na, sb, nb) -> (a, b, s): average similarities of the edges' ends."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in it:
            s = similarity_of(_matrix(x.column(2), dim), x.column(3).to_numpy(), _matrix(x.column(4), dim), x.column(5).to_numpy())
            yield pa.record_batch([x.column(0), x.column(1), pa.array(s)], names=["a", "b", "s"])

    return run


def _unit_rows(dim: int, weighed: bool = False):
    """Unit vectors of (key, vector, comp); with `weighed`, times the number n of the fourth column, which goes on."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows, keys, v = V.valid_block(b, dim)
            if len(keys):
                n = b.column(3).to_numpy()[rows] if weighed else np.ones(len(rows), np.int64)
                cols = [pa.array(keys, pa.int64()), pa.array(list(V.unit(v) * n[:, None]), pa.list_(pa.float64())), b.column(2).take(pa.array(rows))]
                yield pa.record_batch(cols + [pa.array(n)] * weighed, names=["node", "total", "comp", "n"][: 3 + weighed])

    return run


def _misses(dim: int, floor: int):
    """Pairs (comp, a, b) of keys of a chunk pair that are below the floor, each once."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in V.runs(it, "group"):
            for b in t.combine_chunks().select(["key", "vector", "group", "i", "j", "c", "comp"]).to_batches():
                rows, keys, v = V.valid_block(b, dim)
                group, i, j, c, comp = (b.column(x).to_numpy(zero_copy_only=False)[rows] for x in (2, 3, 4, 5, 6))
                u = V.unit(v)
                for lo, hi in V.spans(group) if len(group) else []:
                    left, right = np.flatnonzero(c[lo:hi] == i[lo:hi]) + lo, np.flatnonzero(c[lo:hi] == j[lo:hi]) + lo
                    for s in range(0, len(left), 512):
                        x, y = np.nonzero(V.micro(u[left[s : s + 512]], u[right]) < floor)
                        x, y = keys[left[s : s + 512][x]], keys[right[y]]
                        once = x < y if i[lo] == j[lo] else np.ones(len(x), bool)
                        yield pa.record_batch([pa.array(np.full(once.sum(), comp[lo]), pa.int64()), pa.array(x[once], pa.int64()), pa.array(y[once], pa.int64())], names=["comp", "a", "b"])

    return run


def _peel_comps(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in V.runs(it, "comp"):
        comp, a, b = (t.column(x).to_numpy() for x in ("comp", "a", "b"))
        for lo, hi in V.spans(comp):
            yield pa.record_batch([pa.array(peel_pairs(a[lo:hi], b[lo:hi]), pa.int64())], names=["key"])


def misfits(misses: DataFrame) -> DataFrame:
    """(key): members that peel() takes out of their clusters, given the dissimilar pairs (comp, a, b).

    A member with more misses than each of its partners (of equals, the smaller key) is taken out before any of them, whatever
    else is, so all such members leave at once; a cluster with at most MISS_PAIRS pairs left is finished in one task."""
    out = None
    misses = durable_round(misses)
    while not misses.isEmpty():
        count = misses.groupBy("comp").agg(F.count("*").alias("pairs"))
        sized = misses.join(count, "comp")
        few = sized.where(F.col("pairs") <= MISS_PAIRS).select("comp", "a", "b")
        gone = few.repartition("comp").sortWithinPartitions("comp").mapInArrow(_peel_comps, "key bigint")
        many = durable_round(sized.where(F.col("pairs") > MISS_PAIRS).select("comp", "a", "b"))
        ends = many.select(F.col("a").alias("key"), F.col("b").alias("other")).union(many.select("b", "a"))
        bad = durable_round(ends.groupBy("key").agg(F.count("*").alias("bad")))
        worst = ends.join(bad.toDF("other", "theirs"), "other").groupBy("key").agg(F.max(F.struct("theirs", (-F.col("other")).alias("k"))).alias("m")).join(bad, "key")
        worst = durable_round(worst.where(F.struct("bad", (-F.col("key")).alias("k")) > F.col("m")).select("key"))
        gone = durable_round(gone.union(worst))
        out = gone if out is None else out.union(gone)
        misses = durable_round(many.join(worst.toDF("a"), "a", "left_anti").join(worst.toDF("b"), "b", "left_anti").select("comp", "a", "b"))
    return misses.select(F.col("a").alias("key")) if out is None else out


def _graph(nodes: DataFrame, floor: int, dim: int, k: int = PARTNERS) -> DataFrame:
    """(a, b, q): the k best partners of each node (node, total, comp, n) at an average similarity of at least floor, in micros."""
    wide = nodes.join(nodes.groupBy("comp").agg(F.count("*").alias("rows")), "comp")
    mean = wide.withColumn("vector", F.transform("total", lambda x: x / F.col("n"))).select("comp", F.col("rows").alias("n"), F.col("node").alias("key"), "vector")
    pairs = V.chunk_pairs(mean).withColumn("group", F.xxhash64("comp", "i", "j"))
    ranked = pairs.repartition("group").sortWithinPartitions("group", "key").mapInArrow(V._rank_chunks(dim, k, floor, normal=False), "key bigint, neighbour bigint, micro bigint")
    w = Window.partitionBy("key").orderBy(F.desc("micro"), "neighbour")
    top = ranked.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
    return durable_round(top.select(F.least("key", "neighbour").alias("a"), F.greatest("key", "neighbour").alias("b"), F.col("micro").alias("q")).distinct())


def _merge(nodes: DataFrame, to: DataFrame, dim: int) -> DataFrame:
    """Nodes after the moves (node, to): sums and sizes of the nodes that meet are added; dim numbers a partial sum."""
    moved = nodes.join(to, "node", "left").withColumn("node", F.coalesce("to", "node"))
    met = to.select(F.col("to").alias("node")).distinct()
    added = moved.join(met, "node").groupBy("comp", "node").agg(F.array(*[F.sum(F.col("total")[i]) for i in range(dim)]).alias("total"), F.sum("n").alias("n"))
    return durable_round(moved.join(met, "node", "left_anti").select("comp", "node", "total", "n").unionByName(added))


def _merge_pairs(nodes: DataFrame, to: DataFrame) -> DataFrame:
    """_merge() where at most one node moves to each."""
    gone = nodes.join(to, "node").select(F.col("to").alias("node"), F.col("total").alias("more"), F.col("n").alias("m"))
    both = nodes.join(to, "node", "left_anti").join(gone, "node", "left")
    total = F.when(F.col("m").isNull(), F.col("total")).otherwise(F.zip_with("total", "more", lambda x, y: x + y))
    return durable_round(both.select("comp", "node", total.alias("total"), (F.col("n") + F.coalesce("m", F.lit(0))).alias("n")))


def _rewire(edges: DataFrame, to: DataFrame) -> DataFrame:
    """Edges (a, b, s) after the moves; the score of an edge with an end that moved or was met is forgotten."""
    met = to.select("node", "to").union(to.select(F.col("to").alias("node"), "to")).distinct()
    out = edges.join(met.toDF("a", "ta"), "a", "left").join(met.toDF("b", "tb"), "b", "left")
    a, b = F.coalesce("ta", "a"), F.coalesce("tb", "b")
    out = out.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.when(F.col("ta").isNull() & F.col("tb").isNull(), F.col("s")).alias("s"))
    return out.where("a <> b").groupBy("a", "b").agg(F.max("s").alias("s"))


def _rounds(nodes: DataFrame, edges: DataFrame, similarity: float, dim: int) -> tuple[DataFrame, DataFrame]:
    """reciprocal_rounds() on tables: each round all mutual best pairs of the edges (a, b, s) are merged at once. Returns the nodes
    and the moves (node, to), always to the smaller node."""
    moves = None
    while True:
        end = nodes.select("node", "total", "n")
        fresh = edges.where("s is null").select("a", "b").join(end.toDF("a", "sa", "na"), "a").join(end.toDF("b", "sb", "nb"), "b").select("a", "b", "sa", "na", "sb", "nb")
        edges = durable_round(edges.where("s is not null").unionByName(fresh.mapInArrow(_edge_scores(dim), "a bigint, b bigint, s double")).where(F.col("s") >= similarity))
        ends = edges.select(F.col("a").alias("node"), F.col("b").alias("other"), "s").union(edges.select("b", "a", "s"))
        best = ends.groupBy("node").agg(F.max(F.struct("s", (-F.col("other")).alias("k"))).alias("m")).select("node", (-F.col("m.k")).alias("mate"))
        pairs = best.join(best.toDF("mate", "node"), ["node", "mate"]).where("node > mate")
        to = durable_round(pairs.select("node", F.col("mate").alias("to")))
        moves = to if moves is None else moves.union(to)
        if to.isEmpty():
            return nodes, moves
        nodes, edges = _merge_pairs(nodes, to), durable_round(_rewire(edges, to))


def _link_large(large: DataFrame, dim: int, similarity: float) -> DataFrame:
    """Groups beyond one task, by the steps of link_rows() on tables: copies are one node, the sparse graph comes from chunk pairs in
    different tasks, rounds of mutual best pairs run on its edges (in one task up to LINK_ROWS nodes, beyond that on tables), and the
    graph is made anew until no pair reaches the threshold. A
    group whose nodes have become few enough is finished in one task, which takes the same steps. Members that miss others leave
    their cluster as in smaller groups, the worst first."""
    rows = durable_round(large.select("comp", "key", "vector"))
    copies = rows.groupBy("comp", "vector").agg(F.min("key").alias("node"), F.count("*").alias("n"))
    head = durable_round(copies)
    member = durable_round(rows.join(head.select("comp", "vector", F.col("node").alias("cluster")), ["comp", "vector"]).select(F.col("key").alias("row"), "cluster"))
    nodes = head.select(F.col("node").alias("key"), "vector", "comp", "n").mapInArrow(_unit_rows(dim, True), "node bigint, total array<double>, comp bigint, n bigint")
    nodes, moves, floor = durable_round(nodes.select("comp", "node", "total", "n")), [], round(similarity * V.MICRO)
    while True:
        per = nodes.groupBy("comp").agg(F.count("*").alias("rows"))
        few = nodes.join(per.where(F.col("rows") <= V.GROUP_ROWS), "comp").select("comp", "node", "total", "n")
        moves.append(durable_round(few.repartition("comp").sortWithinPartitions("comp", "node").mapInArrow(_finish_groups(dim, similarity), "node bigint, cluster bigint")))
        nodes = durable_round(nodes.join(per.where(F.col("rows") > V.GROUP_ROWS).select("comp"), "comp").select("comp", "node", "total", "n"))
        edges = _graph(nodes, floor, dim)
        if edges.isEmpty():
            break
        before = durable_round(nodes.groupBy("comp").agg(F.count("*").alias("before")))
        same = edges.where(F.col("q") >= V.MICRO).select("a", "b")
        edges = edges.select("a", "b", F.lit(None).cast("double").alias("s"))
        if not same.isEmpty():  # as good as copies: they merge in any order with the same result
            to = durable_round(connected_components(same).where("node <> comp").select("node", F.col("comp").alias("to")))
            moves.append(to)
            nodes, edges = _merge(nodes, to, dim), durable_round(_rewire(edges, to))
        size = nodes.groupBy("comp").agg(F.count("*").alias("rows"))
        fit = durable_round(nodes.join(size.where(F.col("rows") <= LINK_ROWS), "comp").drop("rows"))
        wide = durable_round(nodes.join(size.where(F.col("rows") > LINK_ROWS), "comp").drop("rows"))
        to = _rounds_in_task(fit, edges, similarity, dim)
        moves.append(to)
        nodes = _merge(fit, to, dim)
        if not wide.isEmpty():
            wide, to = _rounds(wide, durable_round(edges.join(wide.select(F.col("node").alias("a")), "a", "left_semi")), similarity, dim)
            moves.append(to)
            nodes = nodes.unionByName(wide.select(*nodes.columns))
        still = nodes.groupBy("comp").agg(F.count("*").alias("after")).join(before, "comp").where("after = before").select("comp")
        nodes = durable_round(nodes.join(still, "comp", "left_anti"))  # nothing merges there: a similarity on the last digit of the threshold
    # nodes move to smaller ones only, so a cluster's name is the smallest node of its chain of moves
    ends = connected_components(reduce(DataFrame.union, [m.toDF("a", "b") for m in moves])).toDF("cluster", "to")
    member = durable_round(member.join(ends, "cluster", "left").select(F.col("row").alias("node"), F.coalesce("to", "cluster").alias("cluster")))
    size = member.groupBy("cluster").count()
    rows = durable_round(member.join(size, "cluster").join(large.select(F.col("key").alias("node"), "vector"), "node").select(F.col("cluster").alias("comp"), F.col("count").alias("n"), F.col("node").alias("key"), "vector"))
    schema = "key bigint, cluster bigint, size bigint, typicality double"
    out = rows.where(F.col("n") <= V.GROUP_ROWS).repartition("comp").sortWithinPartitions("comp", "key").mapInArrow(_link_groups(dim, similarity, linked=True), schema)
    wide = rows.where(F.col("n") > V.GROUP_ROWS)
    if wide.isEmpty():
        return out
    pairs = V.chunk_pairs(wide).withColumn("group", F.xxhash64("comp", "i", "j"))
    bad = misfits(pairs.repartition("group").sortWithinPartitions("group").mapInArrow(_misses(dim, round(similarity * V.MICRO)), "comp bigint, a bigint, b bigint"))
    kept = durable_round(wide.join(bad, "key", "left_anti").select("key", "vector", "comp").mapInArrow(_unit_rows(dim), "node bigint, total array<double>, comp bigint"))
    named = kept.groupBy("comp").agg(F.min("node").alias("cluster"), F.count("*").alias("size"), F.array(*[F.sum(F.col("total")[i]) for i in range(dim)]).alias("mean"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    typical = F.round(dot(F.col("total"), F.col("mean")) / F.sqrt(dot(F.col("mean"), F.col("mean"))), 6)
    return out.unionByName(kept.join(named, "comp").select(F.col("node").alias("key"), "cluster", "size", typical.alias("typicality")))


def similarity_clusters(vectors: DataFrame, similarity: float = 0.75, least: int = 5, dim: int = 128, recall: float = 0.95) -> DataFrame:
    """(key, cluster, size, typicality) of every valid row of (key, vector) in a cluster of at least `least` rows.

    cluster is the smallest key of the cluster, typicality the cosine to its mean direction. Average linkage merges while the
    average similarity is at least `similarity`; afterwards every two members are similar, members that miss one are taken out.
    Null keys and invalid vectors are left out, copies count one by one, an empty table gives an empty result.
    """
    vectors = vectors.select(*vectors.columns[:2])
    small, large, hot = V.grouped_vectors(vectors, dim, similarity, recall)
    schema = "key bigint, cluster bigint, size bigint, typicality double"
    out = small.repartition("comp").sortWithinPartitions("comp", "key").mapInArrow(_link_groups(dim, similarity), schema)
    if hot:
        out = out.unionByName(_link_large(large, dim, similarity))
    return out.where(F.col("size") >= least)


def describe_clusters(members: DataFrame, texts: DataFrame, typical: int = 3) -> DataFrame:
    """(cluster, size, mean_typicality, typical_keys, typical_text): each cluster's size and most typical members.

    texts is (key, text); a null text gives a null typical_text; equally typical members come in the order of their keys."""
    w = Window.partitionBy("cluster").orderBy(F.desc("typicality"), "key")
    top = members.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= typical)
    texts = texts.select(F.col(texts.columns[0]).alias("key"), F.col(texts.columns[1]).alias("text"))
    named = top.join(texts, "key", "left")
    keys = F.transform(F.array_sort(F.collect_list(F.struct("rn", "key"))), lambda x: x["key"])
    best = named.groupBy("cluster").agg(keys.alias("typical_keys"), F.min(F.struct("rn", "text"))["text"].alias("typical_text"))
    whole = members.groupBy("cluster").agg(F.count("*").alias("size"), F.round(F.avg("typicality"), 6).alias("mean_typicality"))
    return whole.join(best, "cluster")
