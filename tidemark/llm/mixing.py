"""Mixing sources to target weights by temperature.

A source's weight is its share of the tokens raised to an exponent between 0 (all sources alike) and
1 (as found), normalised. The exponent is bisected to the largest one that reaches a target entropy
of the weights, or the smallest that keeps every source within a limit of repetitions.

The budget, by default as many tokens as it takes to read every source at least once, gives each
source a number of passes. Whole passes take every document. The last, broken pass takes a block
permutation: the source's documents are dealt by hash into blocks of about `BLOCK_TOKENS` tokens, the
blocks are put in an order by hash, and documents are taken, block by block and within the block
that the budget ends in by hash, as long as they fit. Whether a document is in comes down to two
numbers a source, so only a table of sources meets the documents. A position from 0 to 1 interleaves
the sources evenly.

Cases: null texts have no tokens; documents without tokens go with every pass of their source, and a
source without tokens is read once; a null source is a source of its own; rows with equal ids (null
ids too) are taken or left together; texts of any length count whole; an empty table gives an empty
table; other columns stay in `mix`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_slices, join_sites, with_checkpoints

BLOCK_TOKENS = 200_000
SEED = 20_240
LEVELS = 5  #: halvings that one pass over the sources decides
ROUNDS = 9


@dataclass
class Plan:
    """passes: (s, e, full, cut_block, cut_hash) by source; the exponent; the number of sources."""

    passes: DataFrame
    exponent: float
    sources: int


def token_counts(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, s, tokens) of every row; tokens are words between ASCII white space."""

    def run(batches):
        for b in batches:
            n = [len((t.as_py() or b"").split()) for t in b.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("s"), pa.array(n, pa.int64())], ["id", "s", "tokens"])

    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[source_col].cast("string").alias("s"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(in_slices(run), "id long, s string, tokens long")


def _measures(sources: DataFrame, exponents: list[float]) -> dict[float, tuple[float, float]]:
    """For each exponent: the entropy of the weights, and the passes of the most repeated source in
    terms of those of the least repeated one."""
    a = F.explode(F.array(*map(F.lit, exponents))).alias("a")
    x = sources.select("share", a).withColumn("p", F.pow("share", "a")).withColumn("r", F.pow("share", F.col("a") - 1))
    got = x.groupBy("a").agg(F.sum("p").alias("z"), F.sum(F.col("p") * F.col("a") * F.log("share")).alias("l"), F.max("r").alias("hi"), F.min("r").alias("lo")).collect()
    return {g["a"]: (float(math.log(g["z"]) - g["l"] / g["z"]), g["hi"] / g["lo"]) for g in got}


def exponent_for(sources: DataFrame, entropy: float | None, repetition: float | None) -> float:
    """Bisection over [0, 1]; each pass over the sources evaluates the next `LEVELS` halvings' points."""
    if (entropy is None) == (repetition is None):
        raise ValueError("give a target entropy or a repetition limit")
    # the condition holds below some exponent (entropy) or above some exponent (repetition)
    holds = (lambda m: m[0] >= entropy) if entropy is not None else (lambda m: m[1] > repetition)
    ends = _measures(sources, [0.0, 1.0])
    if not ends or not holds(ends[0.0]):
        return 0.0
    if holds(ends[1.0]):
        return 1.0
    low, high = 0.0, 1.0  # holds at low, not at high
    for _ in range(ROUNDS):
        n = 1 << LEVELS
        points = [low + (high - low) * i / n for i in range(1, n)]
        m = _measures(sources, points)
        i, j = 0, n
        while j - i > 1:
            mid = (i + j) // 2
            i, j = (mid, j) if holds(m[points[mid - 1]]) else (i, mid)
        low, high = (points[i - 1] if i else low), (points[j - 1] if j < n else high)
    return low if entropy is not None else high


def plan(counts: DataFrame, entropy: float | None = None, repetition: float | None = None, budget: int | None = None) -> Plan:
    """Passes of every source; counts: (id, s, tokens)."""
    with_checkpoints(counts.sparkSession)
    sources = counts.groupBy("s").agg(F.sum("tokens").alias("t")).checkpoint()  # a row a source
    total = sources.agg(F.count("*").alias("n"), F.sum("t").alias("t")).first()
    known = sources.where("t > 0").select("s", "t", (F.col("t") / F.lit(float(total["t"] or 1))).alias("share"))
    a = exponent_for(known, entropy, repetition)
    z = known.agg(F.sum(F.pow("share", F.lit(a))).alias("z"), F.min(F.pow("share", F.lit(a - 1))).alias("lo")).first()
    # passes = weight * budget / tokens; the default budget makes the least repeated source's passes 1
    scale = 1 / z["lo"] if z["lo"] and budget is None else (budget or 0) / ((z["z"] or 1.0) * float(total["t"] or 1))
    e = F.when(F.col("t") > 0, F.pow(F.col("t") / F.lit(float(total["t"] or 1)), F.lit(a - 1)) * F.lit(float(scale))).otherwise(1.0)
    e = F.when(F.abs(e - F.round(e)) < 1e-9, F.round(e)).otherwise(e)  # 1 stays 1 whatever the rounding
    sources = sources.select("s", "t", e.alias("e"), F.greatest(F.lit(1), F.ceil(F.col("t") / BLOCK_TOKENS)).alias("blocks"))
    sources = sources.withColumns({"full": F.floor("e").cast("int"), "rest": ((F.col("e") - F.floor("e")) * F.col("t")).cast("long")}).checkpoint()

    docs = join_sites(counts, sources.select("s", "blocks", "rest"), ["s"], total["n"]).withColumns(_hashes("id", "s"))
    blocks = docs.groupBy("s", "block_hash", "rest").agg(F.sum("tokens").alias("t"))
    before = Window.partitionBy("s").orderBy("block_hash")
    blocks = blocks.withColumn("sofar", F.sum("t").over(before))
    # the block that the budget ends in: the first whose running sum exceeds it
    cut = blocks.where(F.col("sofar") > F.col("rest")).groupBy("s").agg(F.min(F.struct("block_hash", (F.col("rest") - F.col("sofar") + F.col("t")).alias("left"))).alias("c"))
    cut = cut.select("s", F.col("c.block_hash").alias("cut_block"), F.col("c.left").alias("left")).checkpoint()
    last = join_sites(docs.select("s", "block_hash", "hash", "tokens"), cut, ["s"], total["n"]).where(F.col("block_hash") == F.col("cut_block"))
    run = F.sum("t").over(Window.partitionBy("s").orderBy("hash"))
    last = last.groupBy("s", "hash", "left").agg(F.sum("tokens").alias("t")).withColumn("sofar", run).where(F.col("sofar") <= F.col("left"))
    last = last.groupBy("s").agg(F.max("hash").alias("cut_hash"))
    passes = join_sites(join_sites(sources.select("s", "e", "full", "blocks", "rest"), cut.drop("left"), ["s"], total["n"]), last, ["s"], total["n"])
    return Plan(passes.checkpoint(), a, total["n"])


def _hashes(id_col: str, source: str) -> dict:
    block = F.pmod(F.xxhash64(id_col, F.lit(SEED)), F.col("blocks"))
    return {"block_hash": F.xxhash64(F.coalesce(source, F.lit("")), block, F.lit(SEED + 1)), "hash": F.xxhash64(id_col, F.lit(SEED + 2))}


def mix(docs: DataFrame, made: Plan, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Every column of `docs`, a row for each pass that takes it, with __epoch (from 1) and __position."""
    prefix = {c: f"__mix_{c}" for c in ("e", "full", "blocks", "rest", "cut_block", "cut_hash")}
    sources = made.passes.withColumnsRenamed({**prefix, "s": "__mix_s"})
    rows = docs.withColumns({"__mix_s": docs[source_col].cast("string"), "__mix_id": docs[id_col].cast("long")})
    rows = join_sites(rows, sources, ["__mix_s"], made.sources)
    block = F.pmod(F.xxhash64("__mix_id", F.lit(SEED)), F.col("__mix_blocks"))
    bh = F.xxhash64(F.coalesce("__mix_s", F.lit("")), block, F.lit(SEED + 1))
    h = F.xxhash64("__mix_id", F.lit(SEED + 2))
    inside = (bh < F.col("__mix_cut_block")) | ((bh == F.col("__mix_cut_block")) & (h <= F.col("__mix_cut_hash")))
    more = F.when((F.col("__mix_rest") > 0) & F.coalesce(inside, F.lit(False)), 1).otherwise(0)
    n = F.col("__mix_full") + more
    rows = rows.withColumn("__mix_n", n).where("__mix_n > 0").withColumn("__epoch", F.explode(F.sequence(F.lit(1), F.col("__mix_n"))))
    u = F.pmod(F.xxhash64("__mix_id", "__epoch", F.lit(SEED + 3)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    # a broken pass is spread over what is left of the source's passes
    room = F.least(F.lit(1.0), F.col("__mix_e") - F.col("__epoch") + 1)
    rows = rows.withColumn("__position", (F.col("__epoch") - 1 + u * room) / F.greatest(F.col("__mix_e"), F.lit(1e-9)))
    return rows.select(*docs.columns, "__epoch", "__position")


def mix_documents(docs: DataFrame, entropy: float | None = None, repetition: float | None = None, budget: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, n_tokens, epoch and position of every realised reading of a document."""
    with_checkpoints(docs.sparkSession)
    counts = token_counts(docs, id_col, text_col, source_col).checkpoint()
    made = plan(counts, entropy, repetition, budget)
    out = mix(counts, made, "id", "s")
    return out.select(F.col("id").alias("doc_id"), F.col("s").alias("source"), F.col("tokens").alias("n_tokens"), F.col("__epoch").alias("epoch"), F.col("__position").alias("position"))
