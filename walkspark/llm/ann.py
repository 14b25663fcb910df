"""Approximate nearest neighbours by inner product on robust-pruned directed graphs.

Vectors are dealt to shards by hash. In a shard, vectors join the graph in batches: a greedy search from
the entry point proposes neighbours, and robust pruning with a relaxed distance (alpha) keeps those that no
kept neighbour is much closer to; reverse edges are pruned alike. Queries are beam-searched in every shard,
and the best of all shards are ranked on exact inner products in double precision.

Inner product becomes distance by one extra coordinate that gives all vectors of a shard the largest norm. A shard
holds vectors of one band of norms (a factor of 16), so that a few large vectors don't hide the differences between
the others, and its graph is built on vectors scaled by a power of two, so that no finite vector is too large. Equal vectors
are one node, which carries the smallest ids of its class: no other member can be among the k nearest. A shard's
task reads its nodes first, then its queries batch by batch, so that it holds one shard and one batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARDS, SHARD_MB = 8, 128
#: Norms of a band differ by a factor below 2 ** BAND; there are some 525 bands of doubles.
BAND = 4
#: A band of few vectors has no more shards than this many vectors each allow.
FEW = 64


class Graph:
    """A directed graph over the rows of x, all of one norm."""

    def __init__(self, x: np.ndarray, degree: int = 32, beam: int = 64, alpha: float = 1.2):
        self.x, self.degree, self.alpha = x, degree, alpha
        n = len(x)
        self.edges = np.full((n, degree), -1, np.int32)
        self.entry = int(np.argmax(x @ x.mean(axis=0))) if n else 0
        order = np.random.default_rng(7).permutation(n)
        order = np.r_[self.entry, order[order != self.entry]]
        at, step = 1, 1
        while at < n:
            some = order[at : at + step]
            found = self.search(x[some], beam)[0]
            if step < 64:  # while the graph is small, all that is in it is proposed
                found = np.concatenate([found, np.broadcast_to(order[max(0, at - 64) : at], (len(some), min(at, 64)))], axis=1)
            self.edges[some] = self.pruned(some, found)
            self._reverse(some)
            at += step
            step = min(2 * step, 512)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, inner products) of the `beam` best nodes that a beam search meets, best first; -1 where there are fewer."""
        m, n = len(q), len(self.x)
        ids = np.full((m, beam), -1, np.int32)
        score = np.full((m, beam), -np.inf, np.float32)
        open_ = np.zeros((m, beam), bool)
        seen = np.zeros((m, n + 1), bool)
        seen[:, n] = True
        ids[:, 0], score[:, 0], open_[:, 0] = self.entry, q @ self.x[self.entry], True
        seen[:, self.entry] = True
        active = np.arange(m)
        while len(active):
            best = np.argmax(open_[active], axis=1)  # rows are sorted: the first open one is the best
            node = ids[active, best]
            open_[active, best] = False
            near = self.edges[node]
            near = np.where(near < 0, n, near)
            fresh = ~seen[active[:, None], near]
            seen[active[:, None], near] = True
            s = np.full(near.shape, -np.inf, np.float32)
            new, column = np.nonzero(fresh)  # most neighbours have been met before: only the others are compared
            s[new, column] = np.einsum("ij,ij->i", self.x[near[new, column]], q[active[new]])
            all_s = np.concatenate([score[active], s], axis=1)
            all_i = np.concatenate([ids[active], near.astype(np.int32)], axis=1)
            all_o = np.concatenate([open_[active], fresh], axis=1)
            top = np.argsort(-all_s, axis=1, kind="stable")[:, :beam]
            rows = np.arange(len(active))[:, None]
            score[active], ids[active] = all_s[rows, top], all_i[rows, top]
            open_[active] = all_o[rows, top] & np.isfinite(score[active])
            active = active[open_[active].any(axis=1)]
        return np.where(np.isfinite(score), ids, -1), score

    def pruned(self, nodes: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """Robust pruning: from the nearest on, a candidate is kept unless a kept one is alpha times closer to it than the node is."""
        x, n = self.x, len(self.x)
        candidates = np.where(candidates == nodes[:, None], -1, candidates)
        candidates = -np.sort(-candidates, axis=1)
        candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
        c = x[np.clip(candidates, 0, n - 1)]
        far = np.maximum(0, 2 * (self._square(nodes)[:, None] - np.einsum("ijk,ik->ij", c, x[nodes])))
        far = np.where(candidates < 0, np.inf, far)
        order = np.argsort(far, axis=1, kind="stable")
        rows = np.arange(len(nodes))[:, None]
        far, candidates, c = far[rows, order], candidates[rows, order], c[rows, order]
        alive = np.isfinite(far)
        out = np.full((len(nodes), self.degree), -1, np.int32)
        square = (c * c).sum(axis=2)
        for k in range(self.degree):
            has = alive.any(axis=1)
            if not has.any():
                break
            best = np.argmax(alive, axis=1)
            r = np.arange(len(nodes))
            out[has, k] = candidates[r, best][has]
            alive[r, best] = False
            between = np.maximum(0, square + square[r, best][:, None] - 2 * np.einsum("ijk,ik->ij", c, c[r, best]))
            alive &= ~(has[:, None] & (self.alpha**2 * between <= far))
        return out

    def _square(self, nodes: np.ndarray) -> np.ndarray:
        return (self.x[nodes] ** 2).sum(axis=1)

    def _reverse(self, some: np.ndarray) -> None:
        """Edges back to the new nodes; full lists are pruned."""
        to = self.edges[some].ravel()
        back = np.repeat(some, self.degree)[to >= 0]
        to = to[to >= 0]
        order = np.argsort(to, kind="stable")
        to, back = to[order], back[order]
        targets, starts, counts = np.unique(to, return_index=True, return_counts=True)
        width = int(counts.max()) if len(counts) else 0
        more = np.full((len(targets), width), -1, np.int32)
        more[np.repeat(np.arange(len(targets)), counts), np.arange(len(to)) - np.repeat(starts, counts)] = back
        both = np.concatenate([self.edges[targets], more], axis=1)
        size = (both >= 0).sum(axis=1)
        fits = size <= self.degree
        if fits.any():
            self.edges[targets[fits]] = -np.sort(-both[fits], axis=1)[:, : self.degree]
        for lo in range(0, int((~fits).sum()), 512):
            t = targets[~fits][lo : lo + 512]
            self.edges[t] = self.pruned(t, both[~fits][lo : lo + 512])


def _search_shards(k: int, degree: int, beam: int, alpha: float):
    """Rows come sorted by shard, nodes before queries."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, nodes, graph = None, [], None
        for frame in frames:
            for key, part in frame.groupby(["shard"], sort=False):
                if key[0] != shard:
                    shard, nodes, graph = key[0], [], None
                mine = part[part["query_id"].isna()]
                if len(mine):
                    nodes.append(mine)
                queries = part[part["query_id"].notna()]
                if not len(queries) or not nodes:
                    continue
                if graph is None:
                    every = pd.concat(nodes)
                    x = np.stack(every["vector"].to_numpy()).astype(np.float64)
                    members = every["members"].to_list()
                    scaled = _scaled(x, np.abs(x).max())
                    square = (scaled * scaled).sum(axis=1)
                    graph = Graph(np.c_[scaled, np.sqrt(square.max() - square)].astype(np.float32), degree, beam, alpha)
                for lo in range(0, len(queries), 256):
                    some = queries.iloc[lo : lo + 256]
                    q = np.stack(some["vector"].to_numpy()).astype(np.float64)
                    unit = _scaled(q, np.abs(q).max(axis=1, keepdims=True))
                    found, _ = graph.search(np.c_[unit, np.zeros(len(q))].astype(np.float32), max(3 * beam, 2 * k))
                    yield _ranked(some["query_id"].to_numpy(np.int64), q, found, x, members, k)

    return run


def _scaled(x: np.ndarray, peak: np.ndarray) -> np.ndarray:
    """x times the power of two that brings peak, the largest component, below 1."""
    return np.ldexp(x, -np.frexp(peak)[1])


def _products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision; one that doubles can't hold is an infinity of its sign."""
    with np.errstate(over="ignore", invalid="ignore"):
        exact = (x * q).sum(axis=1)
        if len(over := np.flatnonzero(~np.isfinite(exact))):
            far = np.abs(x[over]).max(axis=1, keepdims=True)
            part = (_scaled(x[over], far) * _scaled(q, np.abs(q).max())).sum(axis=1)
            exact[over] = np.ldexp(part, np.frexp(far[:, 0])[1] + np.frexp(np.abs(q).max())[1])
    return exact


def _ranked(ids, q, found, x, members, k) -> pd.DataFrame:
    """The k best of what each query found. Nodes that tie with the last place all take part, so that ids decide."""
    out = []
    for i, query in enumerate(ids):
        nodes = found[i][found[i] >= 0]
        exact = _products(x[nodes], q[i])
        least = np.sort(exact)[::-1][min(k, len(exact) - 1)]  # of k + 1 nodes: the query's own class may give no one but the query
        best = [(-exact[j], int(v)) for j in np.flatnonzero(exact >= least) for v in members[nodes[j]] if v != query]
        out += [(query, v, -s) for s, v in sorted(best)[:k]]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


def nearest(vectors: DataFrame, queries: DataFrame, id: str = "vec_id", vector: str = "embedding", k: int = 20, degree: int = 32, beam: int = 64, alpha: float = 1.2, shards: int = SHARDS, shard_mb: int = SHARD_MB) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k vectors of largest inner product found, itself left out.

    Ties go to the smaller id, among all that the search met. Null or zero vectors and those with null or non-finite
    components take no part, nor do null ids; a product too large for a double is an infinity of its sign; vectors are compared with queries of their own dimension. Repeated rows
    count once. An id with several vectors is one query and one candidate, with the best score of any of them. There are
    `shards` shards for a band of norms, more where a shard's graph would take over shard_mb megabytes, fewer for few
    vectors; every query is searched in each.
    Empty tables give no rows; columns but id and vector are ignored.
    """
    valid = lambda c: c.isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(c, lambda x: x != 0)
    clean = lambda df: df.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).filter(F.col("id").isNotNull() & F.coalesce(valid(F.col("vector")), F.lit(False)))
    peak = F.array_max(F.transform("vector", F.abs))
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + (x / F.col("peak")) * (x / F.col("peak")))
    least = F.row_number().over(Window.partitionBy("h", "vector").orderBy("id"))
    some = clean(vectors).distinct().withColumn("h", F.xxhash64("vector")).withColumn("r", least).filter(F.col("r") <= k + 1)  # ranks are limited before the shuffle
    nodes = some.groupBy("h", "vector").agg(F.sort_array(F.collect_list("id")).alias("members"))
    nodes = nodes.withColumns({"dim": F.size("vector"), "peak": peak})
    nodes = nodes.withColumn("band", F.floor((F.log2("peak") + F.log2(square) / 2 + BAND / 2) / BAND).cast("int")).drop("peak")  # no norm of usual vectors, 1 above all, is at a bound
    sizes = sorted(tuple(r) for r in nodes.groupBy("dim", "band").agg(F.count("*").alias("n")).collect())
    rows = lambda dim: max(1000, (shard_mb << 20) // (12 * dim + 4 * degree + 64))
    if not sizes:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    plan, total = [], 0
    for dim, band, n in sizes:
        count = max(min(shards, -(-n // FEW)), -(-n // rows(dim)))
        plan.append((dim, band, total, count))
        total += count
    plan = F.broadcast(vectors.sparkSession.createDataFrame(plan, "dim int, band int, first long, count long"))  # a row for each band of a dimension
    numbered = nodes.join(plan, ["dim", "band"]).select((F.col("first") + F.pmod("h", "count")).alias("shard"), F.lit(None).cast("long").alias("query_id"), "members", "vector")
    each = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("count") - 1))
    asked = clean(queries).distinct().withColumn("dim", F.size("vector")).join(plan, "dim")
    asked = asked.select(each.alias("shard"), F.col("id").alias("query_id"), F.lit(None).cast("array<bigint>").alias("members"), "vector")
    dealt = numbered.union(asked).repartition(4 * total, "shard").sortWithinPartitions("shard", F.col("query_id").asc_nulls_first())
    found = dealt.mapInPandas(_search_shards(k, degree, beam, alpha), "query_id long, vec_id long, score double")
    once = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
