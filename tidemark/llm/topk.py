"""Exact top-k search by inner product with a pivot table.

A vector is turned into integers, floor(64 * x) of each component. The table holds every vector's
distances to many pivots. For a query q and a candidate x, no pivot p allows a distance below
|d(q, p) - d(x, p)|, so with q.x = (|q|^2 + |x|^2 - d(q, x)^2) / 2 the largest of these bounds gives
a bound from above on the score. Candidates are evaluated in order of their bound, in rising steps,
until the k-th best score found is larger than the next bound; then nothing left can matter, not
even as a tie.

The table is written once. Its rows are grouped by nearest pivot and, in `SHELLS` at most, by the
distance to it; of each group the least and the largest distance to every pivot and the largest
length bound the scores that a query can reach in it. A query first meets one chunk of the group
with the best bound, whose k-th best score is its floor, then the chunks of those groups only whose
bound reaches the floor. Chunks hold at most some `CANDIDATES` rows and `QUERIES` queries, by hash;
a task returns the k best of each of its queries, and the k best of those are the result.

The pivots are `PIVOTS` of the vectors with the smallest hash of the id, the same for all. Pivots and
groups, `PIVOTS` times `SHELLS` at most for each length of vectors, are all that the driver holds.

Cases: vectors that are null, empty, or hold null or non-finite components take no part, neither as
query nor as candidate, nor do rows with a null id; vectors meet only those of their own length; a
query's own row is no candidate, and of rows that share an id every one with another vector's id
counts, so a repeated id is met twice by the others and not by itself; ties go to the smaller id;
with fewer candidates than k all are returned; an empty table gives an empty table; other columns
are left alone. Scores are exact as long as they stay below 2^53.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, partitions
from .vectors import packed, stacked

PIVOTS = 16
SHELLS = 16
QUERIES = 8_192
CANDIDATES = 16_384
BLOCK = 64  #: queries whose bounds stand in memory together
FIRST = 1_024


def whole(x: np.ndarray) -> np.ndarray:
    return np.floor(64.0 * x)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """(rows, pivots)."""
    return np.stack([np.sqrt(((x - p) ** 2).sum(1)) for p in pivots], 1)


def best(q: np.ndarray, x: np.ndarray, ids: np.ndarray, tq: np.ndarray, tx: np.ndarray, floors: np.ndarray, own: np.ndarray, k: int):
    """Of each query row the positions in x of its k best that reach its floor, and their scores; tq, tx:
    the rows' distances to the pivots; own: the queries' ids."""
    sx, table = (x**2).sum(1), np.ascontiguousarray(tx.T, dtype=np.float32)
    for first in range(0, len(q), BLOCK):
        some = slice(first, first + BLOCK)
        y, cut, d = q[some], floors[some].copy(), tq[some].astype(np.float32)
        low = np.zeros((len(y), len(x)), np.float32)
        for row, at in zip(table, d.T, strict=True):
            np.maximum(low, np.abs(row - at[:, None]), out=low)
        # single precision rounds distances by less than 1e-7 of their size, hence the room
        low = np.maximum(low - np.float32(4e-7) * (d.max(1)[:, None] + table.max(0)), 0).astype(np.float64)
        size = (y**2).sum(1)[:, None] + sx
        bound = (size - low**2) / 2 + 1e-9 * size + 1e-3
        others = ids != own[some][:, None]
        reach = lambda at: at[(~(bound[:, at] < cut[:, None]) & others[:, at]).any(0)]  # noqa: E731, B023
        rest = np.argsort(-bound.max(0), kind="stable")
        top = [(np.empty(0, np.int64), np.empty(0))] * len(y)
        take, rest = FIRST, reach(rest)
        while len(rest):
            now, rest = rest[:take], rest[take:]
            score = y @ x[now].T
            good = (score >= cut[:, None]) & others[:, now]
            for i in np.flatnonzero(good.any(1)):
                at, got = np.concatenate([top[i][0], now[good[i]]]), np.concatenate([top[i][1], score[i, good[i]]])
                order = np.lexsort((ids[at], -got))[:k]
                top[i] = at[order], got[order]
                if len(order) == k:
                    cut[i] = max(cut[i], got[order[-1]])
            rest, take = reach(rest), take * 4
        yield from top


def pivots_of(rows: DataFrame) -> dict[int, np.ndarray]:
    """By length of vectors; a length without any gets the zero vector from `of_length`."""
    out: dict[int, list[np.ndarray]] = {}
    for r in rows.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).collect():
        out.setdefault(r["dim"], []).append(whole(np.frombuffer(r["v"], np.float64)))
    return {dim: np.array(p) for dim, p in out.items()}


def of_length(pivots: dict[int, np.ndarray], dim: int) -> np.ndarray:
    return pivots.get(dim, np.zeros((1, dim)))


def pivot_table(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """rows with v in whole numbers, its squared length, distances to the pivots, the nearest one and its distance."""

    def run(batches):
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = b.filter(pa.array(dims == dim))
                x = whole(stacked(part.column("v"), int(dim)))
                d = distances(x, of_length(pivots, int(dim)))
                near = d.argmin(1)
                v = pa.array([r.tobytes() for r in x], pa.binary())
                table = pa.array(list(d), pa.list_(pa.float64()))
                cols = [part.column("dim"), part.column("id"), part.column("asks"), v, pa.array((x**2).sum(1)), table, pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])]
                yield pa.RecordBatch.from_arrays(cols, ["dim", "id", "asks", "v", "size", "d", "cell", "far"])

    return rows.mapInArrow(run, "dim int, id long, asks boolean, v binary, size double, d array<double>, cell int, far double")


def shelled(table: DataFrame) -> DataFrame:
    """The table with each row's shell: cells that fill more than one chunk are cut by quantiles of the distance to their pivot."""
    steps = [i / SHELLS for i in range(1, SHELLS)]
    cuts = table.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.percentile_approx("far", steps, 1_000).alias("cuts"))
    cuts = cuts.select(F.col("dim").alias("cd"), F.col("cell").alias("cc"), F.when(F.col("n") > CANDIDATES, F.col("cuts")).otherwise(F.array().cast("array<double>")).alias("cuts"))
    # a row for each pivot at most
    held = table.join(F.broadcast(cuts), (F.col("dim") == F.col("cd")) & (F.col("cell") == F.col("cc")))
    return held.withColumn("shell", F.size(F.filter("cuts", lambda c: c < F.col("far")))).drop("cd", "cc", "cuts")


def groups_of(table: DataFrame, pivots: dict[int, np.ndarray]) -> dict[int, dict[str, np.ndarray]]:
    """By length of vectors the groups' cells, shells, rows, largest squared lengths and ranges of distances."""
    most = max([len(p) for p in pivots.values()], default=1)
    ends = [f(F.get("d", F.lit(i))).alias(f"{n}{i}") for n, f in (("low", F.min), ("high", F.max)) for i in range(most)]
    out: dict[int, dict[str, list]] = {}
    for r in table.groupBy("dim", "cell", "shell").agg(F.count("*").alias("n"), F.max("size").alias("size"), *ends).collect():
        g, own = out.setdefault(r["dim"], {k: [] for k in ("cell", "shell", "n", "size", "low", "high")}), len(of_length(pivots, r["dim"]))
        for k in ("cell", "shell", "n", "size"):
            g[k].append(r[k])
        for k in ("low", "high"):
            g[k].append([r[f"{k}{i}"] for i in range(own)])
    return {dim: {k: np.array(v) for k, v in g.items()} for dim, g in out.items()}


def reachable(d: np.ndarray, size: np.ndarray, g: dict[str, np.ndarray]) -> np.ndarray:
    """(queries, groups): a bound from above on a query's scores in a group."""
    out = np.empty((len(d), len(g["n"])))
    for j in range(len(g["n"])):
        room = 1e-9 * (d + g["high"][j])
        gap = np.maximum(g["low"][j] - d, d - g["high"][j]) - room
        both = size + g["size"][j]
        out[:, j] = (both - np.maximum(gap.max(1), 0) ** 2) / 2 + 1e-9 * both + 1e-3
    return out


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of every row for whose `id` the condition holds."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    rows = packed(vectors, id_col, vec_col, nonzero=False).where("v is not null and id is not null")
    rows = scratch.put("rows", rows.select((F.octet_length("v") / 8).cast("int").alias("dim"), "id", F.coalesce(is_query, F.lit(False)).alias("asks"), "v"))
    pivots = pivots_of(rows)
    table = scratch.put("table", pivot_table(rows, pivots))
    table = scratch.put("shells", shelled(table))
    scratch.drop("rows", "table")
    groups = groups_of(table, pivots)
    asked = table.where("asks").count()
    nq = max(1, -(-asked // QUERIES))
    chunks = lambda n: np.maximum(1, -(-n // CANDIDATES))

    def deal(everywhere: bool):
        """(dim, cell, shell, sub, a, id, v, size, d, floor): a query's chunks."""

        def run(batches):
            for b in batches:
                dims = b.column("dim").to_numpy()
                for dim in np.unique(dims):
                    every, g = b.filter(pa.array(dims == dim)), groups[int(dim)]
                    step = max(1, (1 << 20) // int(chunks(g["n"]).sum()))
                    for part in (every.slice(i, step) for i in range(0, len(every), step)):
                        top = reachable(part.column("d").flatten().to_numpy().reshape(len(part), -1), part.column("size").to_numpy(), g)
                        if everywhere:
                            at, of = np.nonzero(~(top < part.column("floor").to_numpy()[:, None]))
                            times = chunks(g["n"])[of]
                            sub = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                            at, of = np.repeat(at, times), np.repeat(of, times)
                        else:
                            at, sub = np.arange(len(part)), np.zeros(len(part), np.int64)
                            of = np.where(g["n"] > k, top, -np.inf).argmax(1)
                        for i in range(0, len(at), 4_096):
                            s = slice(i, i + 4_096)
                            sent = part.take(pa.array(at[s]))
                            cols = [pa.array(g["cell"][of[s]].astype(np.int32)), pa.array(g["shell"][of[s]].astype(np.int32)), pa.array(sub[s].astype(np.int64))]
                            yield pa.RecordBatch.from_arrays([*cols, *(sent.column(c) for c in ("dim", "a", "id", "v", "d", "floor"))], ["cell", "shell", "sub", "dim", "a", "id", "v", "d", "floor"])

        return run

    def match(t: pa.Table) -> pa.Table:
        dim, side = t.column("dim")[0].as_py(), t.column("side").to_numpy()
        left, right = t.filter(pa.array(side == 0)), t.filter(pa.array(side == 1))
        out = [[np.empty(0, np.int64)] for _ in range(3)]
        if len(left) and len(right):
            x, ids, own = stacked(right.column("v"), dim), right.column("id").to_numpy(), left.column("id").to_numpy()
            tables = [c.combine_chunks().flatten().to_numpy().reshape(len(c), -1) for c in (left.column("d"), right.column("d"))]
            for i, (at, got) in enumerate(best(stacked(left.column("v"), dim), x, ids, *tables, left.column("floor").to_numpy(), own, k)):
                for o, v in zip(out, (np.full(len(at), own[i]), ids[at], got.astype(np.int64)), strict=True):
                    o.append(v)
        return pa.table([pa.array(np.concatenate(x)) for x in out], ["query_id", "vec_id", "score"])

    sizes = [(int(dim), int(c), int(s), int(n)) for dim, g in groups.items() for c, s, n in zip(g["cell"], g["shell"], chunks(g["n"]), strict=True)]
    sizes = F.broadcast(spark.createDataFrame(sizes, "dim int, cell int, shell int, nc int"))
    candidates = table.join(sizes, ["dim", "cell", "shell"]).withColumn("sub", F.pmod(F.xxhash64("id", F.lit(4)), F.col("nc").cast("long")))

    def meet(queries: DataFrame, everywhere: bool) -> DataFrame:
        """What the queries' chunks return."""
        place = ["dim", "cell", "shell", "sub"]
        sent = queries.mapInArrow(deal(everywhere), "cell int, shell int, sub long, dim int, a long, id long, v binary, d array<double>, floor double")
        wanted = sent.select(*place, "a").distinct()
        right = candidates.join(wanted, place).select(*place, "a", F.lit(1).alias("side"), "id", "v", "d", F.lit(0.0).alias("floor"))
        both = sent.select(*place, "a", F.lit(0).alias("side"), "id", "v", "d", "floor").unionByName(right)
        both = both.select(F.xxhash64(*place, "a").alias("task"), "dim", "side", "id", "v", "d", "floor")
        return both.repartition(max(partitions(spark), 32), "task").groupBy("task").applyInArrow(match, "query_id long, vec_id long, score long")

    least = float(-(2**62))
    asks = table.where("asks").withColumn("a", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(nq).cast("long")))
    near = meet(asks.withColumn("floor", F.lit(least)), False)
    # rows that share an id share a floor: below it are none of the k best of their id
    floors = near.groupBy("query_id").agg(F.count("*").alias("n"), F.slice(F.sort_array(F.collect_list("score"), asc=False), k, 1).alias("kth"))
    floors = scratch.put("floors", floors.where(F.col("n") >= k).select("query_id", F.col("kth")[0].cast("double").alias("kth")))
    asks = asks.join(floors, F.col("id") == F.col("query_id"), "left").withColumn("floor", F.coalesce("kth", F.lit(least)))
    found = meet(asks, True)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
