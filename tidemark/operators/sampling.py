"""Sampling with deterministic hashes in place of a generator's draws: same counts and invariants,
and the same rows on every run and every partitioning."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .interactions import numbered


def uniform(key: Column, seed: int) -> Column:
    """In (0, 1), from the first 13 hex digits of a digest: the same in any engine."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def keep_by_degree(pairs: DataFrame, ratio: float, seed: int) -> DataFrame:
    """ceil(n * (1 - ratio)) pairs, at least one, without replacement by weight 1 / sqrt(degrees):
    the smallest -ln(u) / weight. The cut is a top-n, not a sort of all rows into one task."""
    n = pairs.count()
    keep = max(1, -int(-(n * (1 - ratio)) // 1)) if n else 0
    du = pairs.groupBy("user").agg(F.count("*").alias("__du"))
    di = pairs.groupBy("item").agg(F.count("*").alias("__di"))
    key = F.concat_ws(":", F.col("user").cast("string"), F.col("item").cast("string"))
    ranked = pairs.join(du, "user").join(di, "item").withColumn("__k", F.round(-F.log(uniform(key, seed)) * F.sqrt(F.col("__du") * F.col("__di")), 9))
    return numbered(ranked, ["__k", "user", "item"]).where(F.col("place") < keep).select("user", "item")


def alpha_quota(sizes: DataFrame, key: str, total: int, alpha: float) -> DataFrame:
    """Places for each group in proportion to size ** alpha, largest remainders first, ties by key."""
    whole = Window.partitionBy()
    x = sizes.withColumn("__w", F.pow("size", F.lit(alpha)))
    x = x.withColumn("__raw", F.col("__w") / F.sum("__w").over(whole) * total).withColumn("__b", F.floor("__raw"))
    place = F.row_number().over(Window.orderBy(F.desc(F.round(F.col("__raw") - F.col("__b"), 9)), key))
    quota = F.col("__b") + F.when(place <= F.lit(total) - F.sum("__b").over(whole), 1).otherwise(0)
    return x.withColumn("quota", quota.cast("long")).drop("__w", "__raw", "__b")


def capped(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n distinct keys by hash order, sorted by key."""
    picked = rows.select(key).distinct().orderBy(uniform(F.col(key).cast("string"), seed), key).limit(n)
    return picked.orderBy(key)


def negative_tails(triples: DataFrame, seed: int, tries: int = 4, pool: DataFrame | None = None) -> DataFrame:
    """(h, r, t, negative): a tail of the same relation (of `pool` (r, t), or of all triples) that is no true
    tail of (h, r), by hash among
    `tries` draws from the relation's numbered tails, or where all are true tails, among those that
    (h, r) lacks; only triples of an (h, r) that lacks none are left out. A triple stays one row throughout:
    its draws are made and judged where its head's true tails lie together as numbers."""
    tails = (triples if pool is None else pool).select("r", "t").distinct()
    per = Window.partitionBy("r").orderBy("t")
    tails = tails.withColumn("i", F.row_number().over(per) - 1)
    size = tails.groupBy("r").agg(F.count("*").alias("n"))
    x = triples.select("h", "r", "t").join(F.broadcast(size), "r").join(tails, ["r", "t"], "left")
    u = lambda k: uniform(F.concat_ws(":", *[F.col(c).cast("string") for c in ("h", "r", "t")], F.lit(str(k))), seed)
    draws = [F.floor(u(k) * F.col("n")).alias(f"d{k}") for k in range(tries)]
    dealt = x.repartition("h", "r").sortWithinPartitions("h", "r", "t")
    dealt = dealt.select("h", "r", "t", F.when(F.col("h").isNotNull(), F.col("i")).cast("long").alias("i"), "n", u(tries).alias("u"), *draws)

    def changed(*columns: pa.Array) -> np.ndarray:
        """Whether a row differs from the one before it; nulls are alike."""
        out = np.ones(len(columns[0]), bool)
        if len(out) > 1:
            pairs = [(c[1:], c[:-1]) for c in columns]
            differ = [pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b))) for a, b in pairs]
            out[1:] = np.any([d.to_numpy(zero_copy_only=False) for d in differ], axis=0)
        return out

    def pick(t: pa.Table) -> pa.RecordBatch:
        """Whole heads, in order."""
        t = t.combine_chunks()
        col = lambda c: t.column(c).combine_chunks()
        t = t.filter(pa.array(changed(col("h"), col("r"), col("t"))))
        head = np.cumsum(changed(col("h"), col("r"))) - 1
        n, held = t.column("n").to_numpy(), ~t.column("i").is_null().to_numpy()
        wide = np.int64(n.max() + 1)
        codes = np.sort(head[held] * wide + t.column("i").drop_null().to_numpy())  # true tails, head by head
        m = np.bincount(head[held], minlength=head[-1] + 1)
        start = np.cumsum(m) - m
        got = np.full(len(head), -1, np.int64)
        for k in range(tries):
            open_ = np.flatnonzero(got < 0)
            d = t.column(f"d{k}").to_numpy()[open_]
            want = head[open_] * wide + d
            at = np.searchsorted(codes, want)
            free = np.ones(len(open_), bool)
            inside = at < len(codes)
            free[inside] = codes[at[inside]] != want[inside]
            got[open_[free]] = d[free]
        # the tail of rank k among those that the head lacks has the number k plus the true ones before it
        open_ = np.flatnonzero((got < 0) & (m[head] < n))
        rank = np.floor(t.column("u").to_numpy()[open_] * (n[open_] - m[head[open_]])).astype(np.int64)
        before = codes - (np.arange(len(codes)) - np.repeat(start, m))
        got[open_] = rank + np.searchsorted(before, head[open_] * wide + rank, "right") - start[head[open_]]
        out = t.append_column("at", pa.array(got)).filter(pa.array(got >= 0)).select(["h", "r", "t", "at"]).combine_chunks()
        return pa.RecordBatch.from_arrays([c.combine_chunks() for c in out.columns], ["h", "r", "t", "i"])

    def run(batches):
        """The last head of a batch may go on in the next."""
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not len(b):
                continue
            joined = pa.Table.from_batches([held[-1].slice(len(held[-1]) - 1), b]) if held else pa.Table.from_batches([b])
            cuts = np.flatnonzero(changed(*(joined.column(c).combine_chunks() for c in ("h", "r")))) - (1 if held else 0)
            cuts = cuts[cuts >= 0] if held else cuts[1:]
            if len(cuts):
                if held or cuts[-1]:
                    yield pick(pa.Table.from_batches([*held, b.slice(0, int(cuts[-1]))]))
                held, b = [], b.slice(int(cuts[-1]))
            held.append(b)
        if held:
            yield pick(pa.Table.from_batches(held))

    kind = dict(triples.dtypes)
    drawn = dealt.mapInArrow(run, f"h {kind['h']}, r {kind['r']}, t {kind['t']}, i long")
    return drawn.join(tails.withColumnsRenamed({"t": "negative"}), ["r", "i"]).select("h", "r", "t", "negative")


def bpr_pairs(pairs: DataFrame, homes: DataFrame, catalog: DataFrame, seed: int, tries: int = 4) -> DataFrame:
    """(user, item, negative): for every training pair an item of the user's market (user, market) that
    some training pair has and the user's pairs have not. A user who has all of them is left out."""
    own = pairs.select("user", "item").distinct().join(homes.select("user", "market"), "user")
    warm = catalog.select("market", "item").distinct().join(own.select("item").distinct(), "item", "left_semi")
    pool = warm.select(F.col("market").alias("r"), F.col("item").alias("t"))
    triples = own.select(F.col("user").alias("h"), F.col("market").alias("r"), F.col("item").alias("t"))
    return negative_tails(triples, seed, tries, pool).select(F.col("h").alias("user"), F.col("t").alias("item"), "negative")


def epoch_draw(pairs: DataFrame, group: str, alpha: float, seed: int) -> DataFrame:
    """As many rows as `pairs` has, dealt over the groups by size ** alpha: a group that gets no more
    than it has gives its first rows by hash, another one all of its rows, once and again in whole
    passes and then the first ones. `pass` counts from 0."""
    key = uniform(F.concat_ws(":", F.col("user").cast("string"), F.col("item").cast("string")), seed)
    rows = numbered(pairs.select("user", "item", group).withColumn("__k", key), [group, "__k", "user", "item"])
    sizes = rows.groupBy(group).agg(F.count("*").alias("size"), F.min("place").alias("__first"))  # a row a group
    quota = alpha_quota(sizes, group, pairs.count(), alpha)
    x = rows.join(F.broadcast(quota), group).withColumn("__at", F.col("place") - F.col("__first"))
    n = F.floor(F.col("quota") / F.col("size")) + (F.col("__at") < F.col("quota") % F.col("size")).cast("int")
    return x.withColumn("__n", n).where("__n > 0").select("user", "item", group, F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)).alias("pass"))


def macro_batches(rows: DataFrame, by: list[str], batch: int, macro: int) -> DataFrame:
    """Rows in the order of `by` with `batch` and `macro`, the number of the group of whole batches that
    holds at least `macro` rows, the last one what is left."""
    at = F.floor(F.col("place") / batch)
    return numbered(rows, by).withColumn("batch", at).withColumn("macro", F.floor(F.col("batch") / -(-macro // batch))).drop("place")
