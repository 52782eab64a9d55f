"""Exact substring dedup by super-k-mers.

Every window of `WINDOW` consecutive words has a minimiser, the smallest of its runs of `MINI` words
by hash. Consecutive windows of a document that share their minimiser travel together, as one packed
string, to the bucket that the minimiser names; equal windows have equal minimisers, so a bucket
holds every copy of its windows. There the windows are sorted (by a hash of their words, equal
neighbours then compared word by word), and every window but the first of its kind is a repeat.

Skew. A task sends equal packed strings once and reports the later copies on the spot, so that a
text which many documents hold in full travels once a task. Runs of words that are so frequent that
one would load a bucket more than the mean bucket (found by a pass that sums, over all tasks, what
holds that share of some task's words: a share of the whole must be reached in some task) come last
in the order of minimisers, so windows that lie only partly in a common passage go by their own
words. The list has at most `FREQUENT` entries, whatever the input; it changes only where windows meet.

Removal. The words covered by repeated windows are dropped from the document; windows are judged on
the input. Results are the kept words joined by one space.

Cases: null texts have no words; a null id counts as larger than any other; of rows that share an id
those with the same text are one document (each row gets its result), others are documents of their
own, in order of their text's crc32; texts of any length are taken whole; other columns are left
alone; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, Scratch, in_slices, mix64, partitions, rolling_min

WINDOW = 20
MINI = 4
RUN = 512  #: most windows of one packed string
BUCKET_BYTES = 24 << 20
FLUSH_BYTES = 48 << 20
FREQUENT = 250_000  #: most runs in the list of frequent ones, which only orders minimisers: 2 MB
SPAN_BYTES = 100  #: what a span that is known as a repeat takes
_C = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def run_hashes(words: list[bytes]) -> np.ndarray:
    """Hash of every run of MINI words."""
    h = word_hashes(words)
    out = h[: len(h) - MINI + 1].copy()
    for j in range(1, MINI):
        out = out * _C + h[j : len(h) - MINI + 1 + j]
    return mix64(out)


def minimisers(runs: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The minimiser of every window; frequent runs of words come last."""
    order = runs >> np.uint64(1)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, runs), len(frequent) - 1)
        order |= (frequent[at] == runs).astype(np.uint64) << np.uint64(63)
    return rolling_min(order, WINDOW - MINI + 1)


def _pack(items: list[tuple[int, int, int, bytes]]) -> bytes:
    ids, crcs, starts, texts = zip(*items, strict=True)
    head = np.array(ids, np.int64).tobytes() + np.array(crcs, np.uint32).tobytes() + np.array(starts, np.int32).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(struct.pack("<q", len(items)) + head + b"\n".join(texts))


def _unpack(blob: bytes):
    raw = zstandard.ZstdDecompressor().decompress(blob)
    (n,) = struct.unpack_from("<q", raw)
    ids = np.frombuffer(raw, np.int64, n, 8)
    crcs = np.frombuffer(raw, np.uint32, n, 8 + 8 * n)
    starts = np.frombuffer(raw, np.int32, n, 8 + 12 * n)
    return ids, crcs, starts, raw[8 + 16 * n :]


def _spans(spans: list[tuple[int, int]]) -> bytes:
    """Merged word spans as int32 pairs."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return np.array(out, np.int32).tobytes()


class Sender:
    """What a task has to send: distinct packed strings by bucket, and spans already known as repeats."""

    def __init__(self, buckets: int, frequent: np.ndarray):
        self.buckets, self.frequent = buckets, frequent
        self.clear()

    def clear(self) -> None:
        self.size = 0
        self.first: dict[bytes, tuple[int, int, int, int]] = {}  # packed -> bucket, id, crc, start
        self.repeats: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def add(self, doc: int, crc: int, text: bytes) -> None:
        words = text.split()
        if len(words) < WINDOW:
            return
        low = minimisers(run_hashes(words), self.frequent)
        n = len(low)
        cuts = np.flatnonzero(low[1:] != low[:-1]) + 1
        cuts = np.unique(np.concatenate([[0], cuts, np.arange(0, n, RUN)]))
        to = (mix64(low[cuts]) % np.uint64(self.buckets)).tolist()
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        a = np.where(cuts > 0, ends[cuts - 1], 0).tolist()
        last = np.append(cuts[1:], n) + WINDOW - 2  # a string's last word
        b = (ends[last] - 1).tolist()
        last = last.tolist()
        first = self.first
        for bucket, start, i, j, z in zip(to, cuts.tolist(), a, b, last, strict=True):
            packed = line[i:j]
            have = first.get(packed)
            if have is None:
                first[packed] = (bucket, doc, crc, start)
                self.size += len(packed)
                continue
            if have[1:] == (doc, crc, start):
                continue
            span = z + 1 - start
            self.size += SPAN_BYTES
            if (doc, crc, start) < have[1:]:
                first[packed] = (bucket, doc, crc, start)
                self.repeats.setdefault(have[1:3], []).append((have[3], have[3] + span))
            else:
                self.repeats.setdefault((doc, crc), []).append((start, z + 1))

    def rows(self) -> pa.RecordBatch:
        by: dict[int, list] = {}
        for packed, (bucket, doc, crc, start) in self.first.items():
            by.setdefault(bucket, []).append((doc, crc, start, packed))
        keys = [*by.keys(), *([-1 - k % self.buckets for k, _ in self.repeats])]
        n = len(by)
        ids, crcs = [0] * n + [k[0] for k in self.repeats], [0] * n + [k[1] for k in self.repeats]
        blobs = [_pack(v) for v in by.values()] + [_spans(v) for v in self.repeats.values()]
        self.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array(ids, pa.int64()), pa.array(crcs, pa.int64()), pa.array(blobs, pa.binary())],
            ["bucket", "id", "crc", "blob"],
        )


SENT = "bucket long, id long, crc long, blob binary"


def _numbered(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The words' numbers, equal for equal words, and how many words each string has; words end in a
    blank, the last one of a string in a line feed."""
    marks = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero((marks == 32) | (marks == 10))
    last = np.flatnonzero(marks[ends] == 10)
    offsets = np.append(0, ends + 1).astype(np.int64)
    alike = pa.py_buffer(raw.replace(b"\n", b" "))
    words = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), alike])
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False), np.diff(np.append(-1, last))


def repeats_of(blobs: list[bytes]) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """The repeated word spans, by document, among a bucket's packed strings."""
    parts = [_unpack(b) for b in blobs]
    ids, crcs, starts = (np.concatenate([p[i] for p in parts]) for i in range(3))
    raw = b"\n".join([p[3] for p in parts]) + b"\n"
    del parts
    codes, lengths = _numbered(raw)
    del raw
    windows = lengths - WINDOW + 1
    owner = np.repeat(np.arange(len(lengths)), windows)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    where = np.repeat(np.cumsum(lengths) - lengths, windows) + inside
    key, mixed = np.zeros(len(where), np.uint64), mix64(codes.astype(np.uint64) + np.uint64(1))
    for j in range(WINDOW):
        key = key * _C + mixed[where + j]
    del mixed
    start = starts[owner] + inside
    order = np.lexsort((start, crcs[owner], ids[owner], key))
    same = key[order[1:]] == key[order[:-1]]
    a, b = where[order[:-1][same]], where[order[1:][same]]
    equal = np.ones(len(a), bool)
    for j in range(WINDOW):
        equal &= codes[a + j] == codes[b + j]
    if not equal.all():  # different windows of one hash: sort by the words themselves
        order = np.lexsort((start, crcs[owner], ids[owner], *(codes[where + j] for j in range(WINDOW))))
        same = np.ones(len(order) - 1, bool)
        for j in range(WINDOW):
            same &= codes[where[order[1:]] + j] == codes[where[order[:-1]] + j]
    # position in `order` of the first window of each one's kind
    head = np.maximum.accumulate(np.where(np.r_[True, ~same], np.arange(len(order)), 0))
    first = order[head]
    o, f = owner[order], owner[first]
    repeated = (ids[o] != ids[f]) | (crcs[o] != crcs[f]) | (start[order] != start[first])
    hit = np.zeros(len(order), bool)
    hit[order[repeated]] = True
    # runs of repeated windows within one packed string
    edge = np.flatnonzero(hit & np.r_[True, ~hit[:-1] | (owner[1:] != owner[:-1])])
    stop = np.flatnonzero(hit & np.r_[~hit[1:] | (owner[1:] != owner[:-1]), True])
    out: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for s, e in zip(edge.tolist(), stop.tolist(), strict=True):
        k = owner[s]
        out.setdefault((int(ids[k]), int(crcs[k])), []).append((int(start[s]), int(start[e]) + WINDOW))
    return out


def frequent_runs(rows: DataFrame, buckets: int) -> np.ndarray:
    """Hashes of the runs of MINI words that hold a share of 1 / (4 * buckets) of all of them."""
    least = 1.0 / (4 * buckets)

    def run(batches):
        held: list[np.ndarray] = []
        size = 0

        def summed():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            big = n >= max(2, least * n.sum())
            return pa.RecordBatch.from_arrays(
                [pa.array(np.append(h[big], 0).view(np.int64)), pa.array(np.append(n[big], 0)), pa.array(np.append(np.zeros(big.sum(), np.int64), n.sum()))],
                ["h", "n", "total"],
            )

        for b in batches:
            for text in b.column("text").cast(pa.binary()):
                words = (text.as_py() or b"").split()
                if len(words) >= WINDOW:
                    held.append(run_hashes(words))
                    size += len(words)
            if size > 4_000_000:
                yield summed()
                held, size = [], 0
        if held:
            yield summed()

    sums = rows.select("text").mapInArrow(in_slices(run), "h long, n long, total long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    scratch = Scratch(rows.sparkSession, "frequent")
    sums = scratch.put("sums", sums)
    total = sums.agg(F.sum("total").alias("t")).first()["t"] or 0
    top = sums.where(F.col("n") >= F.lit(max(2.0, least * total))).orderBy(F.desc("n"), "h").limit(min(4 * buckets, FREQUENT))
    out = np.sort(np.array([r["h"] for r in top.select("h").collect()], np.int64).view(np.uint64))
    scratch.drop()
    return out


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, crc, blob): pieces of every document's repeated word spans, as int32 pairs."""
    spark = docs.sparkSession
    rows = docs.select(
        F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID)).alias("id"), docs[text_col].cast("string").alias("text")
    ).where("text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(4 * partitions(spark), 3 * size // BUCKET_BYTES)
    hot = spark.sparkContext.broadcast(frequent_runs(rows, buckets))  # 8 bytes each, FREQUENT at most

    def send(batches):
        sender = Sender(buckets, hot.value)
        for b in batches:
            for doc, text in zip(b.column("id").to_pylist(), b.column("text").cast(pa.binary()), strict=True):
                raw = text.as_py()
                sender.add(doc, zlib.crc32(raw), raw)
                if sender.size > FLUSH_BYTES:
                    yield sender.rows()
        yield sender.rows()

    def find(batches):
        """Batches of one partition, sorted by bucket."""
        now, blobs = None, []

        def found():
            got = repeats_of(blobs) if blobs else {}
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in got], pa.int64()), pa.array([k[1] for k in got], pa.int64()), pa.array([_spans(v) for v in got.values()], pa.binary())],
                ["id", "crc", "blob"],
            )

        for b in batches:
            for i, bucket in enumerate(b.column("bucket").to_pylist()):
                if bucket < 0:
                    yield b.slice(i, 1).select(["id", "crc", "blob"])
                    continue
                if bucket != now:
                    yield found()
                    now, blobs = bucket, []
                blobs.append(b.column("blob")[i].as_py())
        yield found()

    sent = rows.mapInArrow(in_slices(send), SENT)
    return sent.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket").mapInArrow(find, "id long, crc long, blob binary")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by one space) for every row; with
    `digests` kept_sha256 in place of kept."""
    spans = repeated_spans(docs, id_col, text_col).groupBy("id", "crc").agg(F.collect_list("blob").alias("blobs"))
    spans = spans.withColumnRenamed("id", "__id").withColumnRenamed("crc", "__crc")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    rows = rows.withColumns({"id": F.coalesce("doc_id", F.lit(NULL_ID)), "crc": F.crc32(F.col("text").cast("binary"))})
    # the spans' side is built into a hash table: texts need no sort
    both = rows.join(spans.hint("shuffle_hash"), (F.col("id") == F.col("__id")) & (F.col("crc") == F.col("__crc")), "left")

    def run(batches):
        for b in batches:
            n, gone, kept = [], [], []
            for text, blobs in zip(b.column("text").cast(pa.binary()), b.column("blobs").to_pylist(), strict=True):
                words = (text.as_py() or b"").split()
                n.append(len(words))
                if blobs:
                    drop = np.zeros(len(words) + 1, np.int32)
                    spans = np.frombuffer(b"".join(blobs), np.int32).reshape(-1, 2)
                    np.add.at(drop, spans[:, 0], 1)
                    np.add.at(drop, spans[:, 1], -1)
                    stay = np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()
                    words = [words[i] for i in stay]
                gone.append(n[-1] - len(words))
                left = b" ".join(words)
                kept.append(hashlib.sha256(left).hexdigest() if digests else left.decode())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256" if digests else "kept"],
            )

    out = both.select("doc_id", "text", "blobs")
    return out.mapInArrow(in_slices(run), f"doc_id long, n_words long, n_removed long, {'kept_sha256' if digests else 'kept'} string")
