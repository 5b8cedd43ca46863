"""Nearest neighbours by a hierarchical k-means tree with best-bin-first visits.

The tree is fitted on at most `sample` vectors, chosen by a hash, with leaves of about
`leaf` rows of the whole table; every vector goes to the leaf that a descent finds.  A query visits leaves
in the order of a priority queue over the tree's open branches, the best inner product
with a branch's centre first.  How many leaves it visits is widened until the recall
of `trial` queries against brute force over all rows reaches `recall`.

A query's queue is run once, and its visits are written by round.
Leaves are cut into parts of about `chunk` rows, so a leaf with a third of all rows is many
tasks' work.  Visits go in rounds, each four times as wide as all before it: a query carries the
score of its k-th best row so far, and a part answers with nothing below that.  So a query's
answers grow with the logarithm of the parts it visits, not with their number.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import literal_array, schema, written
from .text import lists

_FOUND = "query_id long, vec_id long, score double"
_ROUTED_AT = 1_000_000


class Tree:
    """Centres by level; a node's children are at child[node] onwards, leaves have none."""

    def __init__(self, rows: np.ndarray, leaf: int, branches: int = 8, rounds: int = 8, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.centres: list[np.ndarray] = [rows.mean(axis=0) if len(rows) else np.zeros(rows.shape[1])]
        self.children: list[range] = [range(0)]
        todo = [(0, rows)]
        while todo:
            node, part = todo.pop()
            k = min(branches, -(-len(part) // leaf))
            if k < 2:
                continue
            centres = part[rng.choice(len(part), k, replace=False)]
            for _ in range(rounds):
                near = self._nearest(part, centres)
                for j in range(k):
                    if (near == j).any():
                        centres[j] = part[near == j].mean(axis=0)
            near = self._nearest(part, centres)
            full = [j for j in range(k) if (near == j).any()]
            if len(full) < 2:
                continue
            self.children[node] = range(len(self.centres), len(self.centres) + len(full))
            for j in full:
                todo.append((len(self.centres), part[near == j]))
                self.centres.append(centres[j])
                self.children.append(range(0))
        self.matrix = np.array(self.centres)

    @staticmethod
    def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return np.argmin((centres**2).sum(axis=1) - 2 * rows @ centres.T, axis=1)

    def leaves(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out = np.zeros(len(rows), np.int64)
        todo = [(0, np.arange(len(rows)))]
        while todo:
            node, which = todo.pop()
            below = self.children[node]
            if not len(below) or not len(which):
                out[which] = node
                continue
            near = self._nearest(rows[which], self.matrix[below.start : below.stop])
            todo += [(below.start + j, which[near == j]) for j in range(len(below))]
        return out

    def visits(self, query: np.ndarray, most: int, rows: np.ndarray, need: int) -> list[int]:
        """The first leaves in best-bin-first order: `most` of them, and more while they hold fewer than `need` rows."""
        worth = self.matrix @ query
        queue, out, held = [(0.0, 0)], [], 0
        while queue and (len(out) < most or held < need):
            node = heapq.heappop(queue)[1]
            if below := self.children[node]:
                for child in below:
                    heapq.heappush(queue, (-worth[child], child))
            else:
                out.append(node)
                held += int(rows[node])
        return out


def _matrix(column) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False)).astype(float) if len(column) else np.zeros((0, 1))


def _assigned(batches: Iterator[pa.RecordBatch], tree: Tree) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            leaf = tree.leaves(_matrix(batch.column("v")))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(leaf)], names=["vec_id", "v", "leaf"])


def _round_edges(parts: int) -> list[int]:
    """Where rounds begin and end among `parts` places: one part first, then each round four times as wide as all before it."""
    edges = [0, 1]
    while edges[-1] < parts:
        edges.append(4 * edges[-1])
    return edges


def _routed(batches: Iterator[pa.RecordBatch], tree: Tree, rows: np.ndarray, parts: np.ndarray, most: int, need: int, edges: list[int]) -> Iterator[pa.RecordBatch]:
    """Each query's visits, worked out once: a row for each round with the leaves and their parts in it."""
    for batch in batches:
        held: list[tuple] = []
        size = 0
        for query, v in zip(batch.column("vec_id").to_pylist(), _matrix(batch.column("v")), strict=False):
            seen = np.array(tree.visits(v, most, rows, need), np.int64)
            n = parts[seen]
            leaf = np.repeat(seen, n)
            part = np.arange(len(leaf)) - np.repeat(np.cumsum(n) - n, n)
            held += [(query, turn, leaf[a:b], part[a:b]) for turn, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if a < len(leaf)]
            size += len(leaf)
            if size > _ROUTED_AT:
                yield _route_rows(held)
                held, size = [], 0
        if held:
            yield _route_rows(held)


def _route_rows(held: list[tuple]) -> pa.RecordBatch:
    query, turn, leaves, parts = zip(*held, strict=True)
    places = np.concatenate([[0], np.cumsum([len(x) for x in leaves])])
    listed = [lists(np.concatenate(x), places, pa.int32()) for x in (leaves, parts)]
    return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(turn, pa.int32()), *listed], names=["query_id", "round", "leaves", "parts"])


def best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, floor: np.ndarray | None = None) -> pd.DataFrame:
    """Each query's k best rows but itself, none below its floor, ties to the smaller id, in blocks of bounded size."""
    out = []
    order = np.argsort(ids, kind="stable")
    ids, rows = ids[order], rows[order]
    floor = np.full(len(queries), -np.inf) if floor is None else np.where(np.isnan(floor), -np.inf, floor)
    step = max(1, 4_000_000 // max(1, len(ids)))
    for a in range(0, len(queries), step):
        score = queries[a : a + step] @ rows.T
        score[query_ids[a : a + step, None] == ids[None, :]] = -np.inf
        edge = floor[a : a + step]
        if len(ids) > k:
            edge = np.maximum(edge, np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k])
        # all that tie with the k-th, less a hair for other orders of summing
        q, r = np.nonzero((score >= (edge - 1e-12 * np.where(np.isfinite(edge), np.abs(edge), 0.0))[:, None]) & (score > -np.inf))
        found = pd.DataFrame({"q": q, "vec_id": ids[r], "score": (queries[a + q] * rows[r]).sum(axis=1)})
        found = found[found["score"].to_numpy() >= floor[a + q]]
        found = found.sort_values(["q", "score", "vec_id"], ascending=[True, False, True]).groupby("q").head(k)
        out.append(pd.DataFrame({"query_id": query_ids[a + found["q"].to_numpy()], "vec_id": found["vec_id"], "score": found["score"]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def _searched(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    if not len(queries) or not len(rows):
        return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype=float)})
    return best(
        queries["query_id"].to_numpy(), np.stack(queries["q"]).astype(float), rows["vec_id"].to_numpy(), np.stack(rows["v"]).astype(float), k,
        queries["floor"].to_numpy(float),
    )


def _brute(batches: Iterator[pa.RecordBatch], ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The k best of all rows of the task for each of the few queries."""
    held = None
    for batch in batches:
        if batch.num_rows:
            found = best(ids, queries, batch.column("vec_id").to_numpy(), _matrix(batch.column("v")), k)
            held = found if held is None else pd.concat([held, found]).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(k)
    if held is not None:
        yield pa.RecordBatch.from_pandas(held.astype({"query_id": "int64", "vec_id": "int64"}), preserve_index=False)


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def sound_vectors(table: DataFrame) -> DataFrame:
    """vec_id and v of the rows whose vector takes part: not null, empty or zero, and every component a finite number.

    Vectors of another length than the commonest take no part either.
    """
    v = F.col("embedding").cast("array<double>")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0)
    )
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(2).collect()
    return rows.where(F.size("v") == sizes[0].n) if len(sizes) > 1 else rows


def nearest(
    table: DataFrame, every: int = 20, k: int = 20, recall: float = 0.94, sample: int = 50_000, leaf: int = 2048, chunk: int = 4096, trial: int = 100
) -> DataFrame:
    """Vectors -> query_id, rank, vec_id, score: for each vec_id divisible by `every` its k nearest other rows.

    Nearness is the inner product in double precision, ties to the smaller vec_id.  Vectors
    that are null, zero, or hold a null or a non-finite component take no part.  Of rows
    repeated under one vec_id the least vector counts.  An empty table gives no rows.
    Columns other than vec_id and embedding are not read.
    """
    spark = table.sparkSession
    rows = written(sound_vectors(table).groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    n, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    # the sample holds 8 million numbers at most
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(sample, (1 << 23) // (width or 1))).select("v").toArrow().to_pandas()
    fit = np.stack(drawn["v"]).astype(float) if len(drawn) else np.zeros((0, 1))
    # leaves of about `leaf` rows of the table, and of 16 of the sample at least
    tree = Tree(fit, max(16, leaf * len(fit) // max(1, n)))
    kinds = schema("vec_id long, v array<double>, leaf long")
    placed = written(rows.mapInArrow(partial(_assigned, tree=tree), kinds), "leaves")
    # one row per leaf, and the sample bounds the leaves
    sizes = placed.groupBy("leaf").count().toArrow().to_pandas()
    in_leaf = np.zeros(len(tree.centres), np.int64)
    in_leaf[sizes["leaf"].to_numpy(np.int64)] = sizes["count"]
    in_parts = -(-in_leaf // chunk)

    asked = placed.where(F.col("vec_id") % every == 0).select("vec_id", "v")
    tried = asked.orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(trial).toArrow().to_pandas()
    most = 1
    if len(tried):
        ids, vectors = tried["vec_id"].to_numpy(), np.stack(tried["v"]).astype(float)
        brute = placed.select("vec_id", "v").mapInArrow(partial(_brute, ids=ids, queries=vectors, k=k), schema(_FOUND))
        truth = _top(brute, k).join(placed.select("vec_id", "leaf"), "vec_id").select("query_id", "leaf").toArrow().to_pandas()
        order = {q: {leaf: i for i, leaf in enumerate(tree.visits(v, len(tree.centres), in_leaf, 0))} for q, v in zip(ids.tolist(), vectors, strict=True)}
        places = np.sort([order[q][leaf] for q, leaf in zip(truth["query_id"], truth["leaf"], strict=True)])
        most = 1 + int(places[min(len(places) - 1, int(np.ceil(recall * len(places))))]) if len(places) else 1

    in_part = literal_array(in_parts.tolist(), "long")[F.col("leaf").cast("int")]
    chunked = placed.withColumn("part", F.pmod(F.xxhash64("vec_id"), in_part))
    # the queue is run once for each query; a round reads its own folder of what it gave
    edges = _round_edges(int(in_parts.sum()))
    route = partial(_routed, tree=tree, rows=in_leaf, parts=in_parts, most=most, need=k + 1, edges=edges)
    routes = written(asked.mapInArrow(route, schema("query_id long, round int, leaves array<int>, parts array<int>")), "visits", by=["round"])
    rounds = (routes.agg(F.max("round")).first()[0] or 0) + 1
    found = None
    for turn in range(rounds):
        queries = asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
        if found is None:
            queries = queries.withColumn("floor", F.lit(None).cast("double"))
        else:
            queries = queries.join(found.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor")), "query_id", "left")
        # one row of a query meets its vector, and only then becomes its visits
        visits = routes.where(F.col("round") == turn).join(queries, "query_id").select("query_id", "q", "floor", F.explode(F.arrays_zip("leaves", "parts")).alias("x"))
        visits = visits.select("query_id", "q", "floor", F.col("x.leaves").cast("long").alias("leaf"), F.col("x.parts").cast("long").alias("part"))
        answers = _searched_parts(visits, chunked, k, chunk)
        known = answers if found is None else answers.unionByName(found.drop("rank"))
        found = written(_top(known, k), "found")
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _searched_parts(visits: DataFrame, chunked: DataFrame, k: int, chunk: int) -> DataFrame:
    """What the visited parts answer; a part's queries are cut into blocks of about `chunk`, and its rows sent to each block."""
    blocks = visits.groupBy("leaf", "part").agg(F.ceil(F.count("*") / chunk).alias("blocks"))
    sent = visits.join(blocks, ["leaf", "part"]).withColumn("block", F.pmod(F.xxhash64("query_id"), "blocks"))
    rows = chunked.join(blocks, ["leaf", "part"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = ["leaf", "part", "block"]
    rows = rows.select("vec_id", "v", *(F.col(c).alias(f"of_{c}") for c in keys))
    ask = sent.select("query_id", "q", "floor", *keys)
    return ask.groupBy(*keys).cogroup(rows.groupBy(*(f"of_{c}" for c in keys))).applyInPandas(lambda a, b: _searched(a, b, k), schema(_FOUND))
