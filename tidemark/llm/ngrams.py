"""N-gram Jaccard join by vertical partitioning.

A document's set holds the hashes of its word n-grams; the hash order is the global order of n-grams.
The order is cut into fragments, so that a set falls into segments.

Candidates. Two sets of similarity t differ in at most D n-grams, D following from their sizes. With
more than D fragments some segment must be the same in both. Sets are classed by size (a class spans
a factor of 1.5; a set that can match the next class takes part there too), a class has D + 3 +
D / 16 fragments, and every non-empty segment gives a key. A link of two sets leaves at least as many
fragments alike as the class has fragments beyond the pair's own D; a set with fewer empty fragments
than that for its largest partner is thus sure to share a segment. Only a set with more empty ones,
which the spare fragments make very rare, sends keys for those as well: unrelated sets share them, so
their pairs would grow with the square of the table. Sets that merely share a passage share no whole
segment, so common passages make no candidates.

Overlaps. For the candidates the order is cut into `PARTS` fragments; the overlap of a pair is
counted in each apart and summed per pair, and the pair is a link if the sum reaches the threshold.

Only the links' components are asked for, so equal sets count as one node, and each key first ties
its nodes to its most central one, the one whose keys are held by most; of near copies that is as a
rule the text that the others were made from. Of the pairs that share a key but no component yet,
those are counted whose odd sketches (a bit for the parity of the n-grams that fall on it) differ in
no more bits than the two sets may differ in n-grams, which sketches of linked sets never do. So no
link between components is lost, pairs that are not near each other are passed over without being
written, and a link inside a component isn't needed. The keys of one main component are counted
together, so that nodes that share many keys meet, and are named as a pair, once and not once a key;
their nodes meet in chunks of bounded size.

Cases: null texts and texts without words have the empty set, which links with nothing; a text of
fewer than n words has its whole sequence as its one n-gram; a null id takes part, and a component
without any id has a null one; rows that share an id are documents of their own; an empty table
gives an empty table; texts of any length are taken whole; other columns are left alone. Nodes are
64-bit hashes of sets.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, in_slices, mix64, partitions
from .links import components

PARTS = 8
TURN = 2  #: fragments counted at a time, which bounds the shuffle files that exist at once
SLACK = 2  #: fragments that a class has to spare, and one more for each `SPARE` differences
SPARE = 16
STEP = 1.5
LEFT, RIGHT = 2_048, 8_192  #: most nodes of a main component's keys that meet in one go
_C = np.uint64(0x9E3779B97F4A7C15)


def shingles(raw: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of the words, letters A-Z in lower case."""
    words = raw.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(n, len(words))
    out = np.full(len(words) - k + 1, k, np.uint64)
    for j in range(k):
        out = out * _C + h[j : len(words) - k + 1 + j]
    return np.unique(mix64(out))


class Classes:
    """Size classes for the threshold percent / 100 and their fragments."""

    def __init__(self, percent: int):
        self.percent = percent

    def first(self, c: int) -> int:
        """Smallest size of class c."""
        return int(np.ceil(STEP**c - 1e-9))

    def of(self, size: int) -> int:
        c = int(np.log(size) / np.log(STEP))
        while self.first(c + 1) <= size:
            c += 1
        while self.first(c) > size:
            c -= 1
        return c

    def difference(self, a: int, b: int) -> int:
        """Most n-grams in which linked sets of these sizes differ: D <= (1 - t)(a + b + D) / 2."""
        p = self.percent
        return (100 - p) * (a + b) // (100 + p)

    def fragments(self, c: int) -> int:
        top = self.first(c + 1) - 1
        d = self.difference(top, top)
        return 1 if d == 0 else d + 1 + SLACK + d // SPARE

    def taking_part(self, size: int) -> list[int]:
        c = self.of(size)
        return [c, c + 1] if 100 * size >= self.percent * self.first(c + 1) else [c]

    def alike(self, size: int, c: int) -> int:
        """Fewest fragments of class c in which a set of this size is the same as one that it links with."""
        partner = min(self.first(c + 1) - 1, 100 * size // self.percent)
        return self.fragments(c) - self.difference(size, partner)

    def sketch(self, grams: np.ndarray) -> np.ndarray:
        """Parities of the n-grams by bit; half of the length folds onto the other half to the sketch of
        that length. Counts of few bits scatter more, so few differences get 16 bits each, many of them three."""
        c = self.of(len(grams))
        top = self.first(c + 1) - 1
        d = self.difference(top, top)
        bits = 64 << int(np.ceil(np.log2(max(64, 3 * d, min(16 * d, 256)) / 64)))
        odd = np.bincount((mix64(grams ^ _C) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)

    def keys(self, grams: np.ndarray) -> np.ndarray:
        """Keys of the set's segments."""
        out, upper, sums = [], grams >> np.uint64(32), np.concatenate([[np.uint64(0)], np.cumsum(mix64(grams))])
        for c in self.taking_part(len(grams)):
            f = self.fragments(c)
            cuts = np.searchsorted((upper * np.uint64(f)) >> np.uint64(32), np.arange(f + 1, dtype=np.uint64))
            held = np.flatnonzero(np.diff(cuts))
            if f - len(held) >= self.alike(len(grams), c):
                held = np.arange(f)
            seg = sums[cuts[held + 1]] - sums[cuts[held]]
            out.append(mix64(mix64(seg + (cuts[held + 1] - cuts[held]).astype(np.uint64)) * _C + np.uint64(c * 1_000_003) + held.astype(np.uint64)))
        return np.unique(np.concatenate(out))


def node_of(grams: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(grams.tobytes())).astype(np.int64)))


def sets(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(id, size, node, sketch): the last one only with the first of equal sets that a task meets."""
    classes = Classes(percent)

    def run(batches):
        known: set[int] = set()
        for b in batches:
            size, node, sketch = [], [], []
            for text in b.column("text").cast(pa.binary()):
                g = shingles(text.as_py() or b"", n)
                size.append(len(g))
                node.append(node_of(g) if len(g) else None)
                new = len(g) > 0 and node[-1] not in known
                sketch.append(classes.sketch(g) if new else [])
                if new:
                    known.add(node[-1])
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(size, pa.int64()), pa.array(node, pa.int64()), pa.array(sketch, pa.list_(pa.int64()))],
                ["id", "size", "node", "sketch"],
            )

    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(in_slices(run), "id long, size long, node long, sketch array<long>")


def hits(docs: DataFrame, n: int, percent: int, text_col: str) -> DataFrame:
    """(key, node, size, held) of the keys that two nodes or more have. The keys travel once, straight
    from the texts to the task that sorts them; a task that meets a set again sends nothing. `held`,
    the nodes of the key that stand together in one batch, only ranks nodes."""
    classes = Classes(percent)

    def send(batches):
        known: set[int] = set()
        for b in batches:
            keys, node, size = [np.empty(0, np.int64)], [], []
            for text in b.column("text").cast(pa.binary()):
                g = shingles(text.as_py() or b"", n)
                if not len(g) or (own := node_of(g)) in known:
                    continue
                known.add(own)
                keys.append(classes.keys(g).view(np.int64))
                node.append(own)
                size.append(len(g))
            counts = list(map(len, keys[1:]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys)), pa.array(np.repeat(np.array(node, np.int64), counts)), pa.array(np.repeat(np.array(size, np.int32), counts))],
                ["key", "node", "size"],
            )

    def shared(batches):
        """Rows in order of key and node: drops repeated ones and keys of one node."""
        carry = last = None  # a row that may yet meet another of its key; the last row that was sent
        for b in batches:
            key, node, size = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "node", "size"))
            if carry is not None:
                key, node, size = (np.concatenate([[x], y]).astype(y.dtype) for x, y in zip(carry, (key, node, size), strict=True))
                carry = None
            if not len(key):
                continue
            new = np.r_[last is None or (key[0], node[0]) != last, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]
            key, node, size = key[new], node[new], size[new]
            if not len(key):
                continue
            group = np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1
            held = np.bincount(group)[group]
            if last is not None and last[0] == key[0]:
                held[group == 0] += 1
            ok = held > 1
            if ok[-1]:
                last = (key[-1], node[-1])
            else:
                carry = (key[-1], node[-1], size[-1])
            yield pa.RecordBatch.from_arrays([pa.array(x[ok]) for x in (key, node, size, held.astype(np.int64))], ["key", "node", "size", "held"])

    rows = docs.select(docs[text_col].cast("string").alias("text"))
    keyed = rows.mapInArrow(in_slices(send), "key long, node long, size int")
    dealt = keyed.repartition(partitions(docs.sparkSession), "key").sortWithinPartitions("key", "node")
    return dealt.mapInArrow(shared, "key long, node long, size int, held long")


def segments(docs: DataFrame, wanted: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(node, part, size, grams) of the wanted nodes, each given as (node, rep): an id that has it."""
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    rows = rows.join(wanted, F.col("id").eqNullSafe(F.col("rep")), "inner").select("node", "text")

    def run(batches):
        cuts = np.array([(i << 64) // PARTS for i in range(1, PARTS)], dtype=np.uint64)
        for b in batches:
            out = []
            for node, text in zip(b.column("node").to_pylist(), b.column("text").cast(pa.binary()), strict=True):
                g = shingles(text.as_py() or b"", n)
                if len(g) and node_of(g) == node:  # else another row of the same id
                    at = [0, *np.searchsorted(g, cuts), len(g)]
                    out += [(node, i, len(g), g[at[i] : at[i + 1]].view(np.int64)) for i in range(PARTS)]
            cols = list(zip(*out, strict=True)) if out else [()] * 4
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["node", "part", "size", "grams"])

    return rows.mapInArrow(in_slices(run), "node long, part int, size long, grams array<long>")


def overlaps(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """(a, b, size_a, size_b, n): for every pair and part, the n-grams that the two have in common."""
    right = parts.select(F.col("node").alias("b"), "part", F.col("size").alias("size_b"), F.col("grams").alias("grams_b"))
    left = parts.select(F.col("node").alias("la"), F.col("part").alias("lp"), F.col("size").alias("size_a"), F.col("grams").alias("grams_a"))
    both = pairs.join(right, "b").join(left, (F.col("a") == F.col("la")) & (F.col("part") == F.col("lp")))
    each = both.select("a", "b", "part", "size_a", "size_b", F.size(F.array_intersect("grams_a", "grams_b")).cast("long").alias("n"))
    # rows that repeat an id and a text bring a part more than once
    return each.groupBy("a", "b", "part", "size_a", "size_b").agg(F.max("n").alias("n")).drop("part")


def counted_links(pairs: DataFrame, parts: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose overlaps, counted in every part and summed, reach the threshold; `TURN`
    parts at a time."""
    counted, names = None, []
    for i in range(0, PARTS, TURN):
        names.append(f"overlaps-{uuid.uuid4().hex}")
        some = scratch.put(names[-1], overlaps(pairs, parts.where(F.col("part").between(i, i + TURN - 1))))
        counted = some if counted is None else counted.unionByName(some)
    total = counted.groupBy("a", "b", "size_a", "size_b").agg(F.sum("n").alias("n"))
    links = scratch.put(f"links-{uuid.uuid4().hex}", total.where(100 * F.col("n") >= percent * (F.col("size_a") + F.col("size_b") - F.col("n"))).select("a", "b"))
    scratch.drop(*names)
    return links


def apart(length: np.ndarray, flat: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits the sketches a[i] and b[i] differ, both folded to the shorter one's length;
    `length` words each, one after the other in `flat`."""
    starts, short, out = np.cumsum(length) - length, np.minimum(length[a], length[b]), np.zeros(len(a), np.int64)
    for s in np.unique(short).tolist():
        of, step = np.flatnonzero(short == s), max(1, (1 << 21) // s)
        for i in (of[k : k + step] for k in range(0, len(of), step)):
            rows, back = np.unique(np.concatenate([a[i], b[i]]), return_inverse=True)
            f = np.zeros((len(rows), s), np.uint64)
            for k in range(0, int(length[rows].max()), s):
                has = length[rows] > k
                f[has] ^= flat[starts[rows[has]][:, None] + np.arange(k, k + s)]
            out[i] = np.bitwise_count(f[back[: len(i)]] ^ f[back[len(i) :]]).sum(1, dtype=np.int64)
    return out


def words(*columns: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and content of list columns, one after the other."""
    length = np.concatenate([np.diff(c.offsets.to_numpy()) for c in columns])
    return length, np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in columns]).view(np.uint64)


def plausible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that may be links by their sizes and sketches; nodes: (node, size, sketch)."""
    side = lambda x: nodes.select(*(F.col(c).alias(f"{c}_{x}") for c in ("node", "size", "sketch")))
    both = pairs.join(side("a"), F.col("a") == F.col("node_a")).join(side("b"), F.col("b") == F.col("node_b"))
    both = both.where(100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b"))

    def run(batches):
        for b in batches:
            length, flat = words(b.column("sketch_a"), b.column("sketch_b"))
            size, at = b.column("size_a").to_numpy() + b.column("size_b").to_numpy(), np.arange(len(b))
            yield b.select(["a", "b"]).filter(pa.array(apart(length, flat, at, at + len(b)) <= (100 - percent) * size // (100 + percent)))

    return both.select("a", "b", "size_a", "size_b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long")


def tasks(side: DataFrame, scratch: Scratch) -> DataFrame:
    """(task, side, node, size, component, keys): where nodes of the keys of one main component meet
    those of other components; side: (key, node, size, component, main), main one component of the key.
    A node comes once with all its keys of a main one. One of two such nodes is outside `main`, so those
    meet all, in chunks of `LEFT` and `RIGHT`."""
    outside = F.col("component") != F.col("main")
    met = scratch.put("met", side.groupBy("main", "node", "size", "component").agg(F.collect_list("key").alias("keys")))
    per = met.groupBy("main").agg(F.count(F.when(outside, 1)).alias("l"), F.count("*").alias("r"))
    # few are that large: each has more than `LEFT` nodes
    large = per.where((F.col("l") > LEFT) | (F.col("r") > RIGHT))
    large = large.select(F.col("main").alias("m"), *(F.ceil(F.col(n) / LEFT if n == "l" else F.col(n) / RIGHT).alias(n) for n in "lr"))
    cut = met.join(F.broadcast(large), F.col("main") == F.col("m"), "left")
    chunk = lambda n: F.pmod(F.xxhash64("node", F.lit(5)), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    keep = ["main", "node", "size", "component", "keys"]
    # a main one of one chunk sends each row once, for both sides (2) or for the right one only
    zero = F.lit(0).cast("long")
    whole = cut.where("m is null").select(*keep, F.when(outside, 2).otherwise(1).alias("side"), zero.alias("x"), zero.alias("y"))
    left = cut.where(F.col("m").isNotNull() & outside).select(*keep, F.lit(0).alias("side"), chunk("l").alias("x"), every("r").alias("y"))
    right = cut.where("m is not null").select(*keep, F.lit(1).alias("side"), every("l").alias("x"), chunk("r").alias("y"))
    sent = whole.unionByName(left).unionByName(right)
    return sent.select(F.xxhash64("main", "x", "y").alias("task"), "side", "node", "size", "component", "keys")


def meetings(group: np.ndarray, side: np.ndarray, count: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and the number of the meeting that each attends, in order of meetings: the rows of a group
    meet by key, or all at once where that makes no more pairs; rows of side 1 meet those that aren't,
    rows of side 0 those that aren't; `count` keys a row, one after the other in `key`."""
    row = np.repeat(np.arange(len(group)), count)
    order = np.lexsort((key, group[row]))
    row, key = row[order], key[order]
    at = np.cumsum(np.r_[True, (key[1:] != key[:-1]) | (group[row[1:]] != group[row[:-1]])]) - 1
    pairs = lambda of, rows: np.bincount(of, side[rows] != 1) * np.bincount(of, side[rows] != 0)
    each = np.arange(len(group))
    whole = pairs(group, each) <= np.bincount(group[row[np.r_[True, at[1:] != at[:-1]]]], pairs(at, row))
    each, keyed = each[whole[group]], ~whole[group[row]]
    of = np.concatenate([group[each], group[-1] + 1 + at[keyed]])
    order = np.argsort(of, kind="stable")
    return np.concatenate([each, row[keyed]])[order], np.unique(of[order], return_inverse=True)[1]


def open_pairs(met: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of nodes of one task but different components that may be links by their sizes
    and sketches; met: as `tasks` gives it; nodes: (node, sketch)."""

    def meet(t: pa.Table) -> pa.RecordBatch:
        """Whole tasks, in order."""
        t = t.combine_chunks()
        task, side, node, size, comp = (t.column(c).to_numpy() for c in ("task", "side", "node", "size", "component"))
        length, flat = words(*t.column("sketch").chunks)
        row, at = meetings(np.cumsum(np.r_[True, task[1:] != task[:-1]]) - 1, side, *words(*t.column("keys").chunks))
        left, right = np.flatnonzero(side[row] != 1), np.flatnonzero(side[row] != 0)
        n = np.bincount(at[right], minlength=at[-1] + 1)
        per, first = n[at[left]], (np.cumsum(n) - n)[at[left]]
        left, right, done = row[left], row[right], np.cumsum(per)
        out, i = [np.empty((0, 2), np.int64)], 0
        while i < len(left):
            j = max(i + 1, int(np.searchsorted(done, done[i] - per[i] + (1 << 20), "right")))
            a = np.repeat(left[i:j], per[i:j])
            b = right[np.arange(len(a)) - np.repeat(done[i:j] - per[i:j] - first[i:j], per[i:j]) + (done[i] - per[i])]
            ok = (comp[a] != comp[b]) & (100 * np.minimum(size[a], size[b]) >= percent * np.maximum(size[a], size[b]))
            a, b = a[ok], b[ok]
            ok = apart(length, flat, a, b) <= (100 - percent) * (size[a].astype(np.int64) + size[b]) // (100 + percent)
            a, b = node[a[ok]], node[b[ok]]
            out.append(np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0))
            i = j
        found = np.unique(np.concatenate(out), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    def run(batches):
        """Tasks in order; the last one of a batch may go on in the next."""
        held: list[pa.RecordBatch] = []
        for b in batches:
            task = b.column("task").to_numpy()
            if not len(task):
                continue
            cuts = np.flatnonzero(task[1:] != task[:-1])
            if held and held[-1].column("task")[0].as_py() != task[0]:
                cuts = np.r_[-1, cuts]
            if len(cuts):
                held.append(b.slice(0, int(cuts[-1]) + 1))
                yield meet(pa.Table.from_batches(held))
                held, b = [], b.slice(int(cuts[-1]) + 1)
            held.append(b)
        if held:
            yield meet(pa.Table.from_batches(held))

    both = met.join(nodes.select(F.col("node").alias("nn"), "sketch"), F.col("node") == F.col("nn")).drop("nn")
    dealt = both.repartition(partitions(met.sparkSession), "task").sortWithinPartitions("task")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def join_documents(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id reachable by links) of every row."""
    scratch = Scratch(docs.sparkSession, "ngrams")
    rows = scratch.put("rows", sets(docs, n, percent, id_col, text_col))
    met = scratch.put("hits", hits(docs, n, percent, text_col))

    # every key's most central node: the one whose keys are held by most
    central = met.groupBy("node").agg(F.sum("held").alias("held")).select(F.col("node").alias("cn"), F.col("held").alias("central"))
    first = met.join(central, F.col("node") == F.col("cn")).groupBy("key").agg(F.max(F.struct("central", "node"))["node"].alias("hub"))
    first = scratch.put("first", first.select(F.col("key").alias("k"), "hub"))
    hubbed = scratch.put("hubbed", met.join(first, F.col("key") == F.col("k")).select("key", "node", "size", "hub"))
    scratch.drop("hits", "first")
    stars = scratch.put("stars", hubbed.where("node <> hub").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct())
    # what the hits' nodes have; all of equal sets' rows agree
    held = rows.where(F.size("sketch") > 0).join(hubbed.select(F.col("node").alias("hn")).distinct(), F.col("node") == F.col("hn"), "left_semi")
    nodes = scratch.put("nodes", held.groupBy("node").agg(F.first("size").alias("size"), F.first("sketch").alias("sketch")))

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """The links among the pairs; reads the texts of one document for each of their nodes."""
        ends = pairs.select(F.col("a").alias("en")).union(pairs.select(F.col("b").alias("en"))).distinct()
        reps = rows.where("size > 0").join(ends, F.col("node") == F.col("en"), "left_semi").groupBy("node").agg(F.min("id").alias("rep"))
        parts = scratch.put(f"{name}-parts", segments(docs, reps, n, id_col, text_col))
        links = counted_links(pairs, parts, percent, scratch)
        scratch.drop(f"{name}-parts")
        return links

    links = verified(scratch.put("star-pairs", plausible(stars, nodes, percent)), "stars")
    scratch.drop("star-pairs")
    found = components(links)

    of = lambda df, key, out: df.join(found.withColumnsRenamed({"node": f"__{out}", "component": out}), F.col(key) == F.col(f"__{out}"), "left").withColumn(out, F.coalesce(out, key)).drop(f"__{out}")
    # keys whose nodes are not all of their hub's component yet
    side = of(of(hubbed, "hub", "main"), "node", "component")
    side = scratch.put("side", side.select("key", "node", "size", "component", "main"))
    scratch.drop("hubbed")
    mixed = side.where(F.col("component") != F.col("main")).select(F.col("key").alias("mk")).distinct()
    met = scratch.put("tasks", tasks(side.join(mixed, F.col("key") == F.col("mk"), "left_semi"), scratch))
    scratch.drop("side", "met")
    pairs = scratch.put("pairs", open_pairs(met, nodes, percent).join(stars, ["a", "b"], "left_anti"))
    scratch.drop("tasks", "stars", "nodes")
    if pairs.take(1):
        found = components(links.unionByName(verified(pairs, "pairs")))
    scratch.drop("pairs")

    least = rows.where("size > 0").groupBy("node").agg(F.min("id").alias("m"))
    joined = least.join(found, "node", "left").select("node", "m", F.coalesce("component", "node").alias("component"))
    smallest = joined.groupBy("component").agg(F.min("m").alias("component_id"))
    ids = scratch.put("ids", joined.join(smallest, "component").select(F.col("node").alias("nd"), "component_id"))
    out = rows.select("id", "size", "node").join(ids, F.col("node") == F.col("nd"), "left")
    own = F.when(F.col("size") == 0, F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), own.alias("component_id"))
