"""Approximate nearest neighbours with a robust-pruned directed graph.

Rows are dealt to shards by hash. Each shard builds one graph: rows enter in batches, a greedy search over the graph so far
proposes neighbours, and relaxed distance pruning keeps an edge only if no kept neighbour is nearer to its target by more
than the factor ``ALPHA``, so the few edges that stay point in different directions. Queries search every shard with a
beam; the shards' finds are merged by exact scores.

Largest inner product becomes smallest distance by one more coordinate, sqrt(M^2 - |x|^2) with M the largest norm of the
shard; queries get zero there. Rows of a shard have norms within a factor of two, so a few very long vectors can't drown the
others' differences. Each shard sets its beam itself: a sample of its rows is searched with wider and wider beams until the
finds hold RECALL of what a scan of the shard gives. A shard with no more rows than the beam is scanned. Graphs and searches
use single precision, the scores returned use double precision on the original vectors.

Shards and the queries that go to them are sorted into the same tasks, each shard before its queries: the queries stream past a
graph, which is read once per QUERY_ROWS of them, so that few shards don't leave cores idle.

Cases: vectors that are null, empty, all zero, or hold a null or non-finite component take no part, on either side. Only
vectors of equal length are compared; each length has shards of its own. Equal vectors are one node of a graph, which stands
for its k + 1 smallest ids: more can't be among the k nearest, as ties of score go to the smaller id. Rows that share both
id and vector count once; rows that share only the id are one query or candidate with several vectors, whose best score
counts. A query leaves out its own id. With fewer candidates than asked for, all are found. Empty tables give empty results.
Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labframe.llm.common import materialize

#: Rows in a shard at most, about; and the least number of shards where they hold so many rows, so that small tables use the
#: cluster too.
SHARD_ROWS, LEAST_SHARDS, LEAST_ROWS = 50_000, 8, 1000
DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA = 28, 48, 72, 1.2
#: Edges of a row at most: one with more is pruned to DEGREE, so that not every edge back prunes its row again.
WIDTH = 40
#: Steps that a beam is expanded in, about.
STEPS = 24
#: The beam of a shard is doubled until so many sampled rows find this share of their nearest.
SAMPLE, RECALL = 64, 0.96
BATCH = 256
#: Queries that one task takes past a shard, about; with more, the shard goes to several tasks.
QUERY_ROWS = 8000
#: A table of lengths and norms up to so many rows (40 bytes each) is sent to all executors; a larger one is joined by shuffle.
BROADCAST_ROWS = 50_000


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, vec (array<double>), dim, level of the rows that take part. Norms of one level differ by less than a factor of two; the
    edges between levels lie away from norm 1, where unit vectors would fall on both sides by rounding."""
    v = F.col("vec")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).filter("id is not null")
    rows = rows.filter(F.coalesce(ok, F.lit(False))).withColumn("most", F.array_max(F.transform(v, F.abs)))
    # Squares are taken of shares of the largest component, so that they can't overflow. It is a column: within the lambda it would be
    # sought again for every component.
    share = F.aggregate(v, F.lit(0.0), lambda a, x: a + (x / F.col("most")) * (x / F.col("most")))
    return rows.select("id", "vec", F.size(v).alias("dim"), F.floor(F.log2("most") + F.log2(share) / 2 + 0.5).cast("int").alias("level"))


def beam_search(x: np.ndarray, graph: np.ndarray, start: int, asked: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For a block of queries in step: row numbers and distances of the ``beam`` nearest rows met, nearest first; -1 and
    infinity where there are fewer. A missing edge is -1. A step expands the nearest rows of every beam, so many that a beam
    takes some twenty steps whatever its size: sorting the beams costs no more than the distances."""
    q, n = len(asked), len(x)
    ids = np.full((q, beam), -1, np.int64)
    dist = np.full((q, beam), np.inf, np.float32)
    done = np.ones((q, beam), bool)
    seen = np.zeros(q * n, bool)
    first = np.empty(q * n, np.int32)  # where a pair of query and row stands first in a step; read only where just written
    norms = np.einsum("ij,ij->i", x, x)
    ids[:, 0], done[:, 0], seen[np.arange(q) * n + start] = start, False, True
    dist[:, 0] = norms[start] - 2 * (asked @ x[start])
    while True:
        live = np.flatnonzero(~done.all(axis=1))
        if not len(live):
            return ids, dist
        open_ = ~done[live]
        at, place = np.nonzero(open_ & (np.cumsum(open_, axis=1) <= max(1, beam // STEPS)))  # beams are sorted: the nearest
        done[live[at], place] = True
        near = graph[ids[live[at], place]]
        some = near >= 0
        at, near = np.repeat(at, some.sum(axis=1)), near[some]
        pair = live[at] * n + near
        fresh = np.flatnonzero(~seen[pair])
        first[pair[fresh]] = fresh
        fresh = fresh[first[pair[fresh]] == fresh]
        seen[pair[fresh]] = True
        at, near = at[fresh], near[fresh]
        d = norms[near] - 2 * np.einsum("ij,ij->i", x.take(near, axis=0), asked.take(live[at], axis=0))
        nearer = d < dist[live[at], -1]
        at, near, d = at[nearer], near[nearer], d[nearer]
        count = np.bincount(at, minlength=len(live))
        column = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        all_d = np.full((len(live), beam + count.max()), np.inf, np.float32)
        all_i, all_x = np.full(all_d.shape, -1, np.int64), np.ones(all_d.shape, bool)
        all_d[:, :beam], all_i[:, :beam], all_x[:, :beam] = dist[live], ids[live], done[live]
        all_d[at, beam + column], all_i[at, beam + column], all_x[at, beam + column] = d, near, False
        best = np.argsort(all_d, axis=1)[:, :beam]
        dist[live] = np.take_along_axis(all_d, best, 1)
        ids[live] = np.take_along_axis(all_i, best, 1)
        done[live] = np.take_along_axis(all_x, best, 1)


def robust_prune(x: np.ndarray, rows: np.ndarray, found: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Per row at most ``degree`` of the proposed neighbours (-1: none), nearest first. A proposal goes once a kept
    neighbour, its distance stretched by alpha, is no farther from it than the row itself. Distances come from products of matrices."""
    found = np.sort(found, axis=1)  # the same row proposed twice counts once
    points = x[np.where(found < 0, 0, found)]
    norms = np.einsum("rcd,rcd->rc", points, points)
    between = alpha * alpha * (norms[:, :, None] + norms[:, None, :] - 2 * (points @ points.transpose(0, 2, 1)))
    own = x[rows]
    to_row = norms + np.einsum("rd,rd->r", own, own)[:, None] - 2 * (points @ own[:, :, None])[:, :, 0]
    to_row[(found < 0) | (found == rows[:, None])] = np.inf
    to_row[:, 1:][found[:, 1:] == found[:, :-1]] = np.inf
    out = np.full((len(rows), degree), -1, np.int64)
    each = np.arange(len(rows))
    for k in range(degree):
        pick = np.argmin(to_row, axis=1)
        some = np.isfinite(to_row[each, pick])
        if not some.any():
            break
        out[some, k] = found[each, pick][some]
        to_row[between[each, pick] <= to_row] = np.inf
        to_row[each, pick] = np.inf
    return out


def build_graph(x: np.ndarray, seed: int = 7) -> tuple[np.ndarray, int]:
    """Edges (row numbers, -1 where there are fewer) and the row to start from: the one nearest to the mean."""
    n = len(x)
    graph = np.full((n, WIDTH), -1, np.int64)
    start = int(np.argmin(((x - x.mean(axis=0)) ** 2).sum(axis=1)))
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    placed, step = 1, 1
    while placed < n:
        # Batches grow with the graph, so that early rows see one another.
        rows = order[placed : placed + max(1, min(BATCH, step))]
        found, _ = beam_search(x, graph, start, x[rows], BUILD_BEAM)
        graph[rows, :DEGREE] = robust_prune(x, rows, np.concatenate([found, np.where(found[:, :1] < 0, -1, graph[found[:, 0]])], axis=1))
        _add_reverse(x, graph, rows)
        placed += len(rows)
        step = placed
    return graph, start


def _add_reverse(x: np.ndarray, graph: np.ndarray, rows: np.ndarray) -> None:
    """Edges back from the new rows' neighbours; a neighbour without room is pruned again."""
    to = graph[rows]
    src = np.repeat(rows, to.shape[1])[to.ravel() >= 0]
    dst = to.ravel()[to.ravel() >= 0]
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    nodes, first, count = np.unique(dst, return_index=True, return_counts=True)
    more = np.full((len(nodes), int(count.max()) if len(count) else 0), -1, np.int64)
    more[np.repeat(np.arange(len(nodes)), count), np.arange(len(dst)) - np.repeat(first, count)] = src
    room = (graph[nodes] < 0).sum(axis=1)
    for easy in (True, False):
        some = np.flatnonzero((count <= room) == easy)
        for at in range(0, len(some), BATCH):
            part = some[at : at + BATCH]
            both = np.concatenate([graph[nodes[part]], more[part]], axis=1)
            if easy:
                graph[nodes[part]] = np.sort(both, axis=1)[:, ::-1][:, :WIDTH]
            else:
                graph[nodes[part], :DEGREE], graph[nodes[part], DEGREE:] = robust_prune(x, nodes[part], both), -1


def _lifted(exact: np.ndarray) -> np.ndarray:
    """Rows of a shard, scaled by the largest norm, with the coordinate that makes all norms equal."""
    x = exact / np.abs(exact).max()
    norm2 = np.einsum("ij,ij->i", x, x)
    return (np.concatenate([x, np.sqrt(norm2.max() - norm2)[:, None]], axis=1) / np.sqrt(norm2.max())).astype(np.float32)


def _asked(exact: np.ndarray) -> np.ndarray:
    """Queries as unit vectors with zero in the added coordinate; their length doesn't change an order."""
    x = exact / np.abs(exact).max(axis=1, keepdims=True)
    x = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return np.concatenate([x, np.zeros((len(x), 1))], axis=1).astype(np.float32)


def beam_for(x: np.ndarray, graph: np.ndarray, start: int, exact: np.ndarray, k: int, seed: int = 11) -> int:
    """The beam with which sampled rows of the shard find RECALL of their k nearest, by scores in double precision."""
    rows = np.random.default_rng(seed).permutation(len(x))[:SAMPLE]
    unit, q = exact / np.abs(exact).max(), _asked(exact[rows])
    score = q[:, :-1].astype(np.float64) @ unit.T
    want = np.argsort(-score, axis=1, kind="stable")[:, :k]
    least = np.take_along_axis(score, want, 1)[:, -1:]
    beam = max(SEARCH_BEAM, k)
    while beam < len(x):
        found, _ = beam_search(x, graph, start, q, beam)
        hit = (np.take_along_axis(score, np.where(found < 0, 0, found), 1) >= least) & (found >= 0)
        if np.minimum(hit.sum(axis=1), k).sum() >= RECALL * want.size:
            break
        beam *= 2
    return beam


def members(rows: DataFrame, most: int) -> DataFrame:
    """rep, id, vec, dim, level: of each group of equal vectors the ``most`` smallest ids; rep is the smallest. The ids are
    first cut down within salted parts, so a vector that a third of all rows have isn't gathered in one task."""
    salted = Window.partitionBy("vec", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
    whole = Window.partitionBy("vec").orderBy("id")
    some = rows.dropDuplicates(["id", "vec"]).withColumn("n", F.row_number().over(salted)).filter(F.col("n") <= most)
    return some.withColumn("n", F.row_number().over(whole)).withColumn("rep", F.first("id").over(whole)).filter(F.col("n") <= most).drop("n")


def build_index(rows: DataFrame, shard_rows: int = SHARD_ROWS, k: int = 20, least_shards: int = LEAST_SHARDS) -> DataFrame:
    """shard, row, id, vec, start, beam, edges: one graph per shard, stored. ``rows`` comes from ``usable``."""
    stats = materialize(rows.groupBy("dim", "level").agg(F.count("*").alias("n")), "levels")
    small = stats.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    shards = F.greatest(F.ceil(F.col("n") / shard_rows), F.least(F.lit(least_shards), F.ceil(F.col("n") / LEAST_ROWS)))
    # A shard's number holds the length in its upper half, then the level, then the shard of these.
    first = F.shiftleft(F.col("dim").cast("long"), 32) + F.shiftleft(F.col("level").cast("long") + 2048, 20)
    dealt = rows.join(F.broadcast(stats) if small else stats, ["dim", "level"]).withColumn("shard", first + F.pmod(F.xxhash64("id", "vec"), shards))

    def build(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        exact = np.stack(group.vec.to_numpy())
        x = _lifted(exact)
        graph, start = build_graph(x)
        out = group[["shard", "id", "vec"]].copy()
        out["row"], out["start"], out["beam"] = np.arange(len(x), dtype=np.int64), start, beam_for(x, graph, start, exact, k + 1)
        out["edges"] = list(graph.astype(np.int32))
        return out

    return materialize(dealt.select("shard", "id", "vec").groupBy("shard").applyInPandas(build, INDEX), "graph")


INDEX = "shard long, id long, vec array<double>, row long, start long, beam long, edges array<int>"


def _searched(index: pd.DataFrame, k: int):
    """A function from queries (id, vec) to finds in one shard."""
    exact, ids = np.stack(index.vec.to_numpy()), index.id.to_numpy().astype(np.int64)
    beam, start = int(index.beam.iloc[0]), int(index.start.iloc[0])
    x, graph = _lifted(exact), np.stack(index.edges.to_numpy()).astype(np.int64)

    def find(queries: pd.DataFrame) -> pd.DataFrame:
        q = np.stack(queries.vec.to_numpy())
        if len(x) <= beam:
            rows = np.broadcast_to(np.arange(len(x)), (len(q), len(x)))
        else:
            rows, _ = beam_search(x, graph, start, _asked(q), beam)
        none, safe = rows < 0, np.where(rows < 0, 0, rows)
        score = np.einsum("qrd,qd->qr", exact[safe], q)
        best = np.lexsort((ids[safe], -score, none), axis=1)[:, : k + 1]
        ok = ~np.take_along_axis(none, best, 1)
        taken, found = np.take_along_axis(score, best, 1), np.take_along_axis(ids[safe], best, 1)
        query = np.repeat(queries.id.to_numpy().astype(np.int64), best.shape[1]).reshape(best.shape)
        return pd.DataFrame({"query_id": query[ok], "vec_id": found[ok], "score": taken[ok]})

    return find


def search(index: DataFrame, queries: DataFrame, groups: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score. ``queries`` comes from ``usable``. ``groups`` has the ids (id) that each node of the
    index (rep) stands for."""
    shards = index.select("shard", F.shiftright("shard", 32).cast("int").alias("dim")).distinct()
    # A query goes to the shards of its length: a stated query set against all rows.
    parts = max(1, -(-queries.count() // QUERY_ROWS))
    asked = queries.join(shards, "dim").select("shard", F.lit(True).alias("query"), F.lit(None).cast("long").alias("row"), "id", "vec")
    asked = asked.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    held = index.withColumn("query", F.lit(False)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    both = held.unionByName(asked, allowMissingColumns=True).repartition("shard", "part").sortWithinPartitions("shard", "part", "query", "row")

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at_work, held, finder = None, [], None
        for batch in batches:
            for lo, hi in _runs_of(batch[["shard", "part", "query"]].to_numpy()):
                part = batch.iloc[lo:hi]
                if (part.shard.iloc[0], part.part.iloc[0]) != at_work:
                    at_work, held, finder = (part.shard.iloc[0], part.part.iloc[0]), [], None
                if not part["query"].iloc[0]:
                    held.append(part)
                    continue
                if finder is None:
                    finder, held = _searched(pd.concat(held), k), []
                for at in range(0, len(part), BATCH):
                    yield finder(part.iloc[at : at + BATCH])

    found = both.mapInPandas(find, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    all_ids = found.withColumnRenamed("vec_id", "rep").join(groups.select("rep", F.col("id").alias("vec_id")), "rep").filter("vec_id <> query_id")
    ranked = all_ids.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _runs_of(k: np.ndarray) -> list[tuple[int, int]]:
    edges = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), len(k)]
    return [(lo, hi) for lo, hi in zip(edges, edges[1:], strict=False) if hi > lo]


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, shard_rows: int = SHARD_ROWS, least_shards: int = LEAST_SHARDS) -> DataFrame:
    """The rows whose vec_id is divisible by ``every`` against all other rows."""
    rows = usable(vectors)
    groups = materialize(members(rows, k + 1), "vectors")
    nodes = groups.filter("id = rep").dropDuplicates(["id", "vec"]).select("id", "vec", "dim", "level")
    index = build_index(nodes, shard_rows, k, least_shards)
    return search(index, rows.filter(F.col("id") % every == 0), groups.select("rep", "id").distinct(), k)
