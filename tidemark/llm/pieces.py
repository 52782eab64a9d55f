"""SentencePiece encoding and decoding of merge-type (BPE) models.

For every prefix of a segment the table holds the one token that ends the prefix's encoding. It is
found among the vocabulary pieces that end there (Aho-Corasick matches): a piece fits if it stands
at the start, or if it and the last token of the prefix before it are compatible, that is, if the
two merged afresh come out as the same two. Walking back from the full prefix recovers the ids.

A text is first cut where no piece of the vocabulary can span (between two characters that stand
next to each other in no piece), which leaves the encoding as it is. Segments are kept in a bounded
cache. The model must normalise by identity (checked).

Cases: null and empty texts have no tokens and decode to the empty text; texts of any length are
encoded whole; repeated rows and ids are encoded each; other columns are left alone; an empty table
gives an empty table.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_slices

SPACE = "▁"
CACHE_ENTRIES = 200_000
SCHEMA = "doc_id long, n_tokens long, ids string, decoded string"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class PieceModel:
    """Vocabulary, automaton, pair tests and caches of one model, given as its serialized bytes."""

    def __init__(self, proto: bytes):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.sp = sp
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.rank: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.byte_ids = [0] * 256
        self.byte_of: dict[int, int] = {}
        self.control = set()
        self.unk = sp.unk_id()
        for i, p in enumerate(self.pieces):
            if sp.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
                self.byte_of[i] = int(p[3:5], 16)
            elif sp.is_control(i):
                self.control.add(i)
            elif not sp.is_unknown(i) and not sp.is_unused(i):
                self.ids[p] = i
                self.rank[p] = -sp.get_score(i) if len(p) > 1 else -1.0
        if not self.byte_of:
            raise ValueError("the model has no byte fallback")
        probe = "Å  x ＡÅﬁ"
        if sp.normalize(probe) != SPACE + probe.replace(" ", SPACE):
            raise ValueError("only models that keep texts as they are and add a leading space")
        self.plain = frozenset(self.ids.values())
        self.names = {p: str(i) for p, i in self.ids.items()}
        inner = {(a, b) for p in self.ids for a, b in zip(p, p[1:], strict=False)}
        if any(b == SPACE and a != SPACE for a, b in inner):
            raise ValueError("a piece spans the start of a word")
        joined = {c for pair in inner for c in pair}
        alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in joined and chr(c) != " ")
        self.cut = re.compile(f"([{alone}])") if alone else None
        self.inner = {a + b for a, b in inner}
        self.single = {p for p in self.ids if len(p) == 1}
        self.runs = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.parts: dict[str, list[str]] = {}
        self.fits: dict[tuple[str, str], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            if self.stands(p):
                self.automaton.add_word(p, (p, len(p)))
        self.automaton.make_automaton()
        self.cache: dict[str, tuple[int, str, str]] = {}
        self.older: dict[str, tuple[int, str, str]] = {}

    def halves(self, p: str) -> list[str]:
        """The two tokens whose merge makes p last; p alone if it is one character or never made."""
        got = self.parts.get(p)
        if got is None:
            parts, rank, got = list(p), self.rank, [p]
            while len(parts) > 1:
                ranks = [rank.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
                known = [r for r in ranks if r is not None]
                if not known:
                    break
                at = ranks.index(min(known))
                got = parts[at : at + 2]
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.parts[p] = got = got if len(parts) == 1 else [p]
        return got

    def stands(self, p: str) -> bool:
        """Whether p, merged afresh, comes out as one token."""
        return len(p) == 1 or len(self.halves(p)) == 2

    def fit(self, a: str, b: str) -> bool:
        """Whether a and b stay apart. Their seam is taken back through the merges, the later one
        first; they would join if two tokens at the seam make a piece that merges before the token
        which took either of them up (on the left at a tie)."""
        rank, x, y = self.rank, a, b
        limit = float("inf")
        while True:
            r = rank.get(x + y)
            if r is not None and r < limit:
                return False
            left, right = rank[x], rank[y]
            if left > right and len(x) > 1 or len(y) == 1:
                if len(x) == 1:
                    return True
                # x was made at `left`; whatever merges at that same rank further left goes first
                limit, x = left, self.halves(x)[1]
            else:
                # y's own merge stands right of the seam, so an equal rank at the seam goes first
                limit, y = right + 0.5, self.halves(y)[0]

    def tokens(self, segment: str) -> list[str]:
        """Pieces of a segment by the prefix table; every character is a piece, or else all neighbours
        stand together in pieces; a character that is in no piece is a segment of its own."""
        last: list[str] = [""] * (len(segment) + 1)
        fits = self.fits
        if len(fits) > 4 * CACHE_ENTRIES:
            fits.clear()
        for end, (p, size) in self.automaton.iter(segment):
            end += 1
            if last[end]:
                continue
            if end == size:
                last[end] = p
                continue
            pair = (last[end - size], p)
            ok = fits.get(pair)
            if ok is None:
                ok = fits[pair] = self.fit(*pair)
            if ok:
                last[end] = p
        out, at = [], len(segment)
        while at:
            p = last[at] or segment[at - 1]
            out.append(p)
            at -= len(p)
        return out[::-1]

    def ids_of(self, tokens: list[str]) -> list[int]:
        out: list[int] = []
        for p in tokens:
            i = self.ids.get(p)
            if i is None:
                out.extend(self.byte_ids[b] for b in p.encode())
            else:
                out.append(i)
        return out

    def segment(self, s: str) -> tuple[int, str, str]:
        """Token count, ids with commas, and decoded text of one segment."""
        got = self.cache.get(s) or self.older.get(s)
        if got is None:
            inner = self.inner
            # the table needs no cuts where every character is a piece
            cuts = [] if self.single.issuperset(s) else [i for i in range(1, len(s)) if s[i - 1 : i + 1] not in inner]
            if cuts:
                parts = [self.segment(s[i:j]) for i, j in zip([0, *cuts], [*cuts, len(s)], strict=True)]
                got = (sum([g[0] for g in parts]), ",".join([g[1] for g in parts]), "".join([g[2] for g in parts]))
            else:
                tokens, name = self.tokens(s), self.names.get
                names = [name(p) for p in tokens]
                if None in names:
                    ids = self.ids_of(tokens)
                    got = (len(ids), ",".join(map(str, ids)), self.decode_raw(ids))
                else:  # plain pieces decode to themselves
                    got = (len(names), ",".join(names), s.replace(SPACE, " "))
        if len(s) <= 256:
            if len(self.cache) >= CACHE_ENTRIES:
                self.older, self.cache = self.cache, {}
            self.cache[s] = got
        return got

    def segments(self, text: str) -> list[str]:
        """The text with its leading space, cut before every word and around characters that are
        in no longer piece."""
        marked = SPACE + text.replace(" ", SPACE)
        out: list[str] = []
        for part in [marked] if self.cut is None else self.cut.split(marked):
            if SPACE + SPACE in part or part.endswith(SPACE):
                out += self.runs.findall(part)
                continue
            first, *words = part.split(SPACE)
            if first:
                out.append(first)
            out += [SPACE + w for w in words]
        return out

    def encode_text(self, text: str) -> tuple[int, str, str]:
        """Token count, decimal ids joined by commas, and the text that the ids decode to."""
        if not text:
            return 0, "", ""
        get, make = self.cache.get, self.segment
        got = [get(s) or make(s) for s in self.segments(text)]
        decoded = "".join([g[2] for g in got])
        return sum([g[0] for g in got]), ",".join([g[1] for g in got]), decoded[1:] if decoded[:1] == " " else decoded

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.encode_text(text)[1].split(",") if x]

    def decode_raw(self, ids: list[int]) -> str:
        if self.plain.issuperset(ids):
            return "".join([self.pieces[i] for i in ids]).replace(SPACE, " ")
        out, raw = [], bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                raw.append(b)
                continue
            if raw:
                out.append(_characters(raw))
                raw = bytearray()
            if i == self.unk:
                out.append(" ⁇ ")
            elif i not in self.control:
                out.append(self.pieces[i])
        if raw:
            out.append(_characters(raw))
        return "".join(out).replace(SPACE, " ")

    def decode(self, ids: list[int]) -> str:
        """The text of the ids, without the space that encoding sets before it."""
        text = self.decode_raw(ids)
        return text[1:] if ids and self.pieces[ids[0]][:1] == SPACE else text


def _characters(raw: bytearray) -> str:
    """UTF-8; each byte that fits into no character becomes one replacement character."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for size in (1, 2, 3, 4):
                try:
                    out.append(raw[at : at + size].decode())
                    at += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


_MODELS: dict[bytes, PieceModel] = {}


def model_of(proto: bytes) -> PieceModel:
    """One model a worker process, kept between tasks."""
    key = hashlib.md5(proto).digest()
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = PieceModel(proto)
    return _MODELS[key]


def encode_documents(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False
) -> DataFrame:
    """Encode every whole text and decode its ids again.

    Returns doc_id, n_tokens, ids (decimal, joined by commas) and decoded; with `digests` the
    SHA-256 of the two texts in their place, made beside the encoding so that ids don't travel.
    """
    spark = docs.sparkSession
    with open(model_path, "rb") as f:
        proto = spark.sparkContext.broadcast(f.read())  # half a MB, whatever the input

    def run(batches):
        model = model_of(proto.value)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in batches:
            n, ids, decoded = [], [], []
            for text in b.column(1):
                k, i, d = model.encode_text(text.as_py() or "")
                n.append(k)
                ids.append(sha(i) if digests else i)
                decoded.append(sha(d) if digests else d)
            names = ["doc_id", "n_tokens", *(["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"])]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names
            )

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(in_slices(run), DIGESTS if digests else SCHEMA)
