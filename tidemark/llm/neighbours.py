"""Embedding near-dedup by a subspace pigeonhole join.

Vectors are scaled to length 1 and rotated by a fixed random rotation, which spreads every direction
over all coordinates, then split into `BLOCKS` blocks of coordinates. Two vectors of cosine c are at
squared distance 2 - 2c; were the distance in every block above its proportional share, the whole
would be above, so at least one block holds at most its share. Each block is joined by range apart:
a grid over its first coordinates gives every vector a home cell; of two vectors within the budget
each has the other's home within reach, so it is enough that a vector visits those cells in reach
that come before its home. A cell's task pairs the vectors at home with one another and with the
visitors; a cell with many vectors is cut into chunks of either side, so that no task gets more than
`CHUNK` of each. A pair counts in the first block whose budget it keeps, if the cosine of the two
whole vectors, in double precision, reaches the threshold.

Equal vectors are one node with a number of copies. A task adds up the links of each of its vectors
and returns a spanning forest of its links, so what it returns grows with its vectors and not with
its pairs.

Cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing;
vectors link only with vectors of their own length; equal vectors link with each other; rows that
share an id are vectors of their own; a null id takes part, and comes last in a component; an empty
table gives an empty table; other columns are left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, with_checkpoints
from .links import components
from .vectors import packed, stacked

BLOCKS = 4
GRID = 2
CHUNK = 32_768
TILE = 1_024
SEED = 7
LEAST_WIDTH = 1 / 64  #: of a cell, which bounds the number of cells whatever the rows and the threshold
HOME, VISITOR, BOTH, PARTNER = 0, 1, 2, 3  #: left side; right side from another cell; both sides; right side from this cell


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def blocks_of(dim: int) -> list[slice]:
    n = min(BLOCKS, dim)
    cuts = [dim * i // n for i in range(n + 1)]
    return [slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]


class Space:
    """Rotation, blocks, budgets and grid for vectors of one length."""

    def __init__(self, dim: int, cosine: float):
        self.dim, self.cosine = dim, cosine
        self.turn, self.blocks = rotation(dim), blocks_of(dim)
        whole = max(2 - 2 * cosine, 0.0) + 1e-9  # room for rounding; the cosine is tested exactly
        self.budgets = [whole * (s.stop - s.start) / dim for s in self.blocks]

    def turned(self, x: np.ndarray) -> np.ndarray:
        return (x / np.linalg.norm(x / np.abs(x).max(1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(1, keepdims=True)) @ self.turn

    def cells(self, y: np.ndarray, i: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Of every row: its own cell in block i, and the cells within reach (rows, cells)."""
        r = np.sqrt(self.budgets[i])
        width, part = max(2 * r, LEAST_WIDTH), y[:, self.blocks[i]][:, :GRID]
        side = int(np.ceil(1 / width)) * 2 + 3
        to = lambda c: np.clip(np.floor(c / width).astype(np.int64) + side // 2, 0, side - 1)
        own = np.zeros(len(y), np.int64)
        reach = [own]
        for j in range(part.shape[1]):
            own = own * side + to(part[:, j])
            low, high = to(part[:, j] - r - 1e-6), to(part[:, j] + r + 1e-6)
            reach = [np.where((k < 0) | (low + n > high), -1, k * side + low + n) for k in reach for n in range(int((high - low).max(initial=0)) + 1)]
        return own, reach


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept (vec_id = component_id) of every row."""
    spark = vectors.sparkSession
    with_checkpoints(spark)
    rows = packed(vectors, id_col, vec_col, nonzero=True).withColumn("node", F.xxhash64("v", F.lit(1)))
    rows = rows.withColumn("node", F.when(F.col("v").isNotNull(), F.col("node"))).checkpoint()
    nodes = rows.where("v is not null").groupBy("node").agg(F.first("v").alias("v"), F.count("*").alias("copies"), F.min("id").alias("m")).checkpoint()

    def deal(batches):
        """Every vector once for its home cell of each block and once for each earlier cell in reach."""
        spaces: dict[int, Space] = {}
        for b in batches:
            raw, ids, copies = b.column("v").to_pylist(), b.column("node").to_numpy(False), b.column("copies").to_numpy(False)
            sizes = np.array([len(x) // 8 for x in raw])
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                space = spaces.setdefault(int(dim), Space(int(dim), cosine))
                y = space.turned(np.frombuffer(b"".join([raw[i] for i in at]), np.float64).reshape(-1, dim))
                for i in range(len(space.blocks)):
                    own, reach = space.cells(y, i)
                    for side, cell, ok in [(HOME, own, own >= 0), *((VISITOR, k, (k >= 0) & (k < own)) for k in reach)]:
                        n = int(ok.sum())
                        if n:
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(n, int(dim) * 64 + i)), pa.array(cell[ok]), pa.array(np.full(n, side, np.int32)), pa.array(ids[at[ok]]), pa.array(copies[at[ok]]), b.column("v").take(pa.array(at[ok]))],
                                ["block", "cell", "side", "node", "copies", "v"],
                            )

    dealt = nodes.select("node", "v", "copies").mapInArrow(deal, "block long, cell long, side int, node long, copies long, v binary")
    # cells are few: a block's grid over [-1, 1] has as many whatever the rows
    sizes = dealt.groupBy("block", "cell").agg(F.count(F.when(F.col("side") == HOME, 1)).alias("l"), F.count("*").alias("r")).where("l > 0")
    sizes = sizes.select(F.col("block").alias("b2"), F.col("cell").alias("c2"), *(F.ceil(F.col(k) / CHUNK).cast("long").alias(f"n{k}") for k in "lr")).checkpoint()
    cut = dealt.join(F.broadcast(sizes), (F.col("block") == F.col("b2")) & (F.col("cell") == F.col("c2")))

    # (side, x, y): the tasks of a row, x the chunk of the left side and y that of the right one
    chunk = lambda n: F.pmod(F.xxhash64("node", F.lit(2)), F.col(n))
    to = lambda side, x, y: F.struct(F.lit(side).alias("side"), x.alias("x"), y.alias("y"))
    zero = F.lit(0).cast("long")
    left = F.transform(F.sequence(zero, F.col("nr") - 1), lambda y: to(HOME, chunk("nl"), y))
    right = lambda side: F.transform(F.sequence(zero, F.col("nl") - 1), lambda x: to(side, x, chunk("nr")))
    home = F.when(F.col("nr") == 1, F.array(to(BOTH, zero, zero))).otherwise(F.concat(left, right(PARTNER)))
    cut = cut.select("block", "cell", "node", "copies", "v", F.explode(F.when(F.col("side") == HOME, home).otherwise(right(VISITOR))).alias("to"))
    cut = cut.select(F.xxhash64("block", "cell", "to.x", "to.y").alias("task"), "block", "to.side", "node", "copies", "v")

    def match(t: pa.Table) -> pa.Table:
        block = t.column("block")[0].as_py()
        dim, i = block // 64, block % 64
        space = Space(dim, cosine)
        t = t.sort_by("node")
        side = t.column("side").to_numpy()
        left, right = t.filter(pa.array((side == HOME) | (side == BOTH))), t.filter(pa.array(side != HOME))
        out: list[tuple[int, int, int]] = []
        if len(left) and len(right):
            vl, vr = stacked(left.column("v"), dim), stacked(right.column("v"), dim)
            il, ir = left.column("node").to_numpy(), right.column("node").to_numpy()
            cl, cr = left.column("copies").to_numpy(), right.column("copies").to_numpy()
            visits = right.column("side").to_numpy() == VISITOR
            yl, yr = space.turned(vl), space.turned(vr)
            sl, sr = yl[:, space.blocks[i]], yr[:, space.blocks[i]]
            half_l, half_r = (sl**2).sum(1), (sr**2).sum(1)
            nl, nr = np.zeros(len(il), np.int64), np.zeros(len(ir), np.int64)
            names, place = np.unique(np.concatenate([il, ir]), return_inverse=True)
            pl, pr = place[: len(il)], place[len(il) :]
            root = np.arange(len(names))

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            def tie(u: np.ndarray, w: np.ndarray) -> None:
                """Links between places; one of each two trees that they join is enough."""
                while (root[root] != root).any():
                    root[:] = root[root]
                ends = np.sort(np.stack([root[u], root[w]], 1), 1)
                trees, first = np.unique(ends, axis=0, return_index=True)
                for (a, b), k in zip(trees.tolist(), first.tolist(), strict=True):
                    a, b = find(a), find(b)
                    if a != b:
                        root[max(a, b)] = min(a, b)
                        out.append((int(names[u[k]]), int(names[w[k]]), 0))

            # one product a pair: s.t - |s|^2 / 2 - |t|^2 / 2 + budget / 2, at least 0 within the budget;
            # in single precision with room, the exact tests follow
            room = (space.budgets[i] + 1e-5) / 2
            ones = lambda v: np.ones((len(v), 1))
            fl = np.hstack([sl, ones(sl), (room - half_l / 2)[:, None]]).astype(np.float32)
            fr = np.hstack([sr, -half_r[:, None] / 2, ones(sr)]).astype(np.float32)
            for a in range(0, len(il), TILE):
                # of two vectors at home the one of the smaller node is on the left
                met = np.flatnonzero(visits | (ir > il[a]))
                for b in range(0, len(met), 4 * TILE):
                    of = met[b : b + 4 * TILE]
                    p, q = np.divmod(np.flatnonzero(fl[a : a + TILE] @ fr[of].T >= 0), len(of))
                    p, q = p + a, of[q]
                    ok = visits[q] | (il[p] < ir[q])
                    p, q = p[ok], q[ok]
                    for c in range(0, len(p), 65_536):
                        x, y = p[c : c + 65_536], q[c : c + 65_536]
                        norm = np.sqrt(np.einsum("ij,ij->i", vl[x], vl[x]) * np.einsum("ij,ij->i", vr[y], vr[y]))
                        good = np.einsum("ij,ij->i", vl[x], vr[y]) / norm >= space.cosine
                        x, y = x[good], y[good]
                        # the first block that the pair keeps to counts it
                        mine, open_ = np.zeros(len(x), bool), np.ones(len(x), bool)
                        for j, s in enumerate(space.blocks[: i + 1]):
                            keeps = open_ & (((yl[x][:, s] - yr[y][:, s]) ** 2).sum(1) <= space.budgets[j])
                            if j == i:
                                mine = keeps
                            open_ &= ~keeps
                        x, y = x[mine], y[mine]
                        np.add.at(nl, x, cr[y])
                        np.add.at(nr, y, cl[x])
                        if len(x):
                            tie(pl[x], pr[y])
            for ids, links in ((il, nl), (ir, nr)):
                hit = np.flatnonzero(links)
                out += [(k, k, n) for k, n in zip(ids[hit].tolist(), links[hit].tolist(), strict=True)]
        cols = list(zip(*out, strict=True)) if out else [()] * 3
        return pa.table([pa.array(c, pa.int64()) for c in cols], ["a", "b", "n"])

    cut = cut.repartition(max(partitions(spark), 32), "task")
    found = cut.groupBy("task").applyInArrow(match, "a long, b long, n long").checkpoint()
    comp = components(found.where("a <> b").select("a", "b"))
    links = found.where("a = b").groupBy(F.col("a").alias("ln")).agg(F.sum("n").alias("n"))
    joined = nodes.select("node", "copies", "m").join(comp.withColumnRenamed("node", "cn"), F.col("node") == F.col("cn"), "left")
    joined = joined.join(links, F.col("node") == F.col("ln"), "left").select("node", "copies", "m", F.coalesce("component", "node").alias("component"), F.coalesce("n", F.lit(0)).alias("n"))
    smallest = joined.groupBy(F.col("component").alias("sc")).agg(F.min("m").alias("component_id"))
    nodes = joined.join(smallest, F.col("component") == F.col("sc")).select(F.col("node").alias("nd"), (F.col("n") + F.col("copies") - 1).alias("n_links"), "component_id").checkpoint()
    out = rows.select("id", "node").join(nodes, F.col("node") == F.col("nd"), "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))
