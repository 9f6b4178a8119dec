"""SentencePiece encoding and decoding by a weighted finite-state transducer.

A model file is compiled to machines: a normaliser (a trie of character maps that rewrites the longest match, then blanks
as U+2581 with one before the text), a lexicon (a trie whose final states emit a piece, in a unigram model with minus its
score as the weight), and a fallback (an arc for any symbol that no piece is, which emits its bytes, or the unknown
piece). The closure of lexicon and fallback is composed with each normalised input on the fly: a state is a place in the
input, an arc a piece from there. The encoding is the shortest path in the tropical semiring, places taken in order.

In a BPE model the closure is composed with one more machine, an acceptor of piece pairs: a pair that merging would leave
side by side weighs nothing, any other infinity, and a state then is a place with the piece before it. A path whose pairs
all are left side by side is what merging gives for the whole, so one path at most has a finite weight at any place.

Where no piece has two symbols side by side, no path crosses between them. So inputs are cut before blanks and between
letters and the marks that no piece has beside a letter, and the paths of short parts are kept, in bounded memory.
"""

from __future__ import annotations

import os
import re
import struct
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches

MODEL = os.environ.get("QUERN_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
BLANK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Bytes of paths that a worker keeps, in two generations of half as many: where the younger is full, it becomes the elder,
#: and what is found in the elder goes on living in the younger. A full table of pairs starts anew.
_KEPT_BYTES = 64 << 20
_KEPT_PAIRS = 250_000
_ENTRY = 190  # bytes of an entry's own objects


def _fields(data: bytes):
    """(number, value) of each field of a protocol-buffer message."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        elif kind == 2:
            size = varint()
            value, at = data[at : at + size], at + size
        elif kind == 5:
            value, at = data[at : at + 4], at + 4
        else:
            raise ValueError("not a model file")
        yield key >> 3, value


@dataclass
class PieceModel:
    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    model_type: int = UNIGRAM
    dummy_prefix: bool = True
    squeeze: bool = True
    charmap: bytes = b""

    @staticmethod
    def parse(data: bytes) -> PieceModel:
        m = PieceModel([], [], [])
        for number, value in _fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                m.pieces.append(piece)
                m.scores.append(score)
                m.kinds.append(kind)
            elif number == 2:
                spec = dict(_fields(value))
                m.model_type = spec.get(3, UNIGRAM)
                if spec.get(24):
                    raise ValueError("models with blanks as suffixes aren't supported")
            elif number == 3:
                spec = dict(_fields(value))
                m.dummy_prefix, m.squeeze, m.charmap = bool(spec.get(3, 1)), bool(spec.get(4, 1)), spec.get(2, b"")
                if not spec.get(5, 1):
                    raise ValueError("models that keep blanks aren't supported")
        if m.model_type not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        if USER in m.kinds or (m.model_type == BPE and UNUSED in m.kinds):
            raise ValueError("models with pieces of the user, and BPE models with unused pieces, aren't supported")
        return m


def character_map(blob: bytes) -> dict[str, str]:
    """What a model file's double-array trie of UTF-8 bytes rewrites, by string.

    The blob is the trie's size in bytes, its 32-bit units, then the replacements, each ended by a zero byte. A unit has
    a label in its low byte, a flag that a value follows in bit 8, and the distance to its children in bits 10 to 30
    (in steps of 256 where bit 9 is set); a value is a place among the replacements.
    """
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units, texts_ = np.frombuffer(blob, "<u4", size // 4, 4).tolist(), blob[4 + size :]
    children = lambda at: at ^ ((units[at] >> 10) << ((units[at] & 512) >> 6))
    out, todo = {}, [(children(0), b"")]
    while todo:
        base, key = todo.pop()
        for label in range(1, 256):
            at = base ^ label
            if at < len(units) and units[at] & 0x800000FF == label:
                below = children(at)
                if units[at] >> 8 & 1:
                    start = units[below] & 0x7FFFFFFF
                    out[(key + bytes([label])).decode("utf-8", "surrogateescape")] = texts_[start : texts_.index(b"\0", start)].decode()
                todo.append((below, key + bytes([label])))
    return out


class Normaliser:
    """Rewrites the longest string of the map at each place, squeezes blanks, and writes them as U+2581."""

    def __init__(self, model: PieceModel):
        self.model, self.map = model, character_map(model.charmap)
        self.longest = max(map(len, self.map), default=0)
        first = "".join(re.escape(c) for c in sorted({k[0] for k in self.map}))
        self.some = re.compile(f"[{first}]") if first else None

    def rewritten(self, text: str) -> str:
        out, done = [], 0
        while found := self.some.search(text, done):
            at = found.start()
            out.append(text[done:at])
            size = next((k for k in range(min(self.longest, len(text) - at), 0, -1) if text[at : at + k] in self.map), 0)
            out.append(self.map[text[at : at + size]] if size else text[at])
            done = at + max(size, 1)
        return "".join(out) + text[done:]

    def __call__(self, text: str) -> str:
        text = self.rewritten(text) if self.some else text
        if self.model.squeeze:
            text = re.sub("  +", " ", text).strip(" ")
        return (BLANK if self.model.dummy_prefix else "") + text.replace(" ", BLANK) if text else ""


class PieceTransducer:
    def __init__(self, model: PieceModel):
        self.model = model
        self.normalise = Normaliser(model)
        self.ids = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds)) if k == NORMAL}  # noqa: B905
        self.codes = {p: np.int32(i).tobytes() for p, i in self.ids.items()}
        self.score = {p: model.scores[i] for p, i in self.ids.items()}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(model.pieces, model.kinds)) if k == BYTE}  # noqa: B905
        self.unknown = next((i for i, k in enumerate(model.kinds) if k == UNKNOWN), 0)
        self.unknown_score = np.float32(min(self.score.values(), default=0.0)) - np.float32(10)
        self.bpe = model.model_type == BPE
        self.pairs: dict[str | None, dict[str, bool]] = {}
        self.n_pairs = 0
        self.paths: dict[str, bytes] = {}
        self.elder: dict[str, bytes] = {}
        self.kept = 0
        crosses = any(re.search(f"[^{BLANK}]{BLANK}", p) for p in self.ids)
        joined = {c for p in self.ids if len(p) > 1 for c in p}
        single = "".join(re.escape(c) for c in map(chr, range(32)) if c not in joined)
        self.parts = re.compile(r"(?s).+") if crosses else re.compile(f"(?s)[{single}]|{BLANK}*[^{BLANK}{single}]+|{BLANK}+")
        letter = re.compile(r"[^\W\d_]")
        beside = {c for p in self.ids for a, b in zip(p, p[1:]) if bool(letter.match(a)) != bool(letter.match(b)) for c in (a, b)}  # noqa: B905
        marks = "".join(re.escape(c) for c in sorted(joined - beside) if not letter.match(c) and c != BLANK)
        self.cuts = re.compile(rf"(?<=[^\W\d_])(?=[{marks}])|(?<=[{marks}])(?=[^\W\d_])") if marks and not crosses else None
        #: The lexicon with the links of its failures, which finds all pieces of an input in one pass.
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        #: States of the lexicon by the string that leads to them, and whether they are final.
        self.lexicon = dict.fromkeys((p[:k] for p in self.ids for k in range(1, len(p) + 1)), False) | dict.fromkeys(self.ids, True)
        blob = [bytes([int(p[3:5], 16)]) if k == BYTE else p.encode() if k in (NORMAL, UNUSED) else " ⁇ ".encode() if k == UNKNOWN else b"" for p, k in zip(model.pieces, model.kinds)]  # noqa: B905
        self.sizes = np.array([len(b) for b in blob], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.blob = np.frombuffer(b"".join(blob), np.uint8)

    def merged(self, text: str) -> list[str]:
        """What merging leaves of a short text: the best-scored pair first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def stays(self, left: str | None, right: str) -> bool:
        """Whether merging leaves left and right side by side (at a start: right alone)."""
        known = self.pairs.setdefault(left, {})
        got = known.get(right)
        if got is None:
            if self.n_pairs >= _KEPT_PAIRS:
                self.pairs.clear()
                self.n_pairs = 0
            got = known[right] = self.merged((left or "") + right) == ([right] if left is None else [left, right])
            self.n_pairs += 1
        return got

    def fallback(self, symbol: str) -> bytes:
        """Ids for a symbol that no piece is."""
        return np.array([self.bytes[b] for b in symbol.encode()] if self.bytes else [self.unknown], np.int32).tobytes()

    def shortest_path(self, part: str) -> list[str]:
        """Outputs (pieces, and symbols of the fallback) on the tropical shortest path over a part of a normalised input.

        All arcs lead forward, so the weight of a place is final once the places before are done. Of equal paths the one
        found first stays, which starts its last arc further left.
        """
        last = self._paired(part) if self.bpe else self._weighted(part)
        out, at = [], len(part)
        while at:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def _paired(self, part: str) -> list[str | None]:
        """For each place the arc that enters it with a weight of zero: every finite weight is zero in a BPE model.

        The automaton gives the lexicon's arcs by the place where they end, long ones first; a place has one at most
        with a finite weight, so the rest are passed over once it is found.
        """
        pairs, stays = self.pairs, self.stays
        last: list[str | None] = [None] * (len(part) + 1)
        done = 0
        for at, piece in self.automaton.iter(part):
            end = at + 1
            if last[end] is not None:
                continue
            while done < at:  # places that no piece ends at are entered by the fallback
                done += 1
                if last[done] is None:
                    last[done] = part[done - 1]
            left = last[end - len(piece)]
            if left is None and end > len(piece):
                continue  # infinity
            seen = pairs.get(left)
            stay = seen.get(piece) if seen else None
            if stays(left, piece) if stay is None else stay:
                last[end] = piece
        for done in range(done + 1, len(part) + 1):
            if last[done] is None:
                last[done] = part[done - 1]
        return last

    def _weighted(self, part: str) -> list[str | None]:
        """For each place the arc of least weight that enters it, in the library's single precision."""
        score, lexicon, n = self.score, self.lexicon, len(part)
        last: list[str | None] = [None] * (n + 1)
        best = np.zeros(n + 1, np.float32)  # minus the weights
        for start in range(n):
            single = part[start] in score
            for end in range(start + 1, n + 1):
                piece = part[start:end]
                final = lexicon.get(piece)
                if final is None and end > start + 1:
                    break
                if final or (end == start + 1 and not single):
                    value = best[start] + (np.float32(score[piece]) if final else self.unknown_score)
                    if last[end] is None or value > best[end]:
                        best[end], last[end] = value, piece
        return last

    def _ids(self, part: str) -> bytes:
        codes = self.codes
        return b"".join([codes[p] if p in codes else self.fallback(p) for p in self.shortest_path(part)])

    def _path(self, part: str) -> bytes:
        """Ids of a part, put together from those of its own parts where it has some."""
        inner = self.cuts.split(part) if self.cuts else ()
        return b"".join([self.paths.get(p) or self._ids(p) for p in inner]) if len(inner) > 1 else self._ids(part)

    def encode(self, text: str) -> np.ndarray:
        paths, out = self.paths, []
        for part in self.parts.findall(self.normalise(text)):
            got = paths.get(part)
            if got is None:
                got = self.elder.get(part) or self._path(part)
                if len(part) <= 64:
                    size = len(part) + len(got) + _ENTRY
                    if self.kept + size > _KEPT_BYTES // 2:
                        self.elder, self.paths, self.kept = paths, {}, 0
                        paths = self.paths
                    self.kept += size
                    paths[part] = got
            out.append(got)
        ids = np.frombuffer(b"".join(out), np.int32)
        if not self.bytes and len(ids) > 1:  # the library has one unknown piece for a run of them
            ids = ids[np.append(True, (ids[1:] != self.unknown) | (ids[:-1] != self.unknown))]
        return ids

    def decode(self, ids: np.ndarray) -> str:
        sizes = self.sizes[ids]
        before = np.cumsum(sizes) - sizes
        at = np.repeat(self.starts[ids] - before, sizes) + np.arange(int(sizes.sum()))
        text = self.blob[at].tobytes().decode("utf-8", "replace").replace(BLANK, " ")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


_compiled: dict[bytes, PieceTransducer] = {}


def transducer(data: bytes) -> PieceTransducer:
    """The compiled model; a worker compiles it once."""
    if data not in _compiled:
        _compiled.clear()
        _compiled[data] = PieceTransducer(PieceModel.parse(data))
    return _compiled[data]


def encode_decode(docs: DataFrame, model_path: str = MODEL, *keep: str, text: str = "text") -> DataFrame:
    """keep columns, token_ids, decoded for each row of docs: the encoding of the whole text and what it decodes to.

    Null and empty texts give no tokens and an empty text; rows that repeat are encoded each; an empty table gives no
    rows. The driver reads the model file (under a few MB) and sends it along, so executors need no copy of it. A text
    that is to be kept travels once.
    """
    with open(model_path, "rb") as f:
        data = f.read()
    model = docs.sparkSession.sparkContext.broadcast(data)
    sent = [*keep] if text in keep else [*keep, text]
    at = sent.index(text)

    def run(batches):
        t = transducer(model.value)
        for batch in batches:
            column, done = batch.column(at), 0
            while done < batch.num_rows:
                ids, back, size, first = [], [], 0, done
                while done < batch.num_rows and size < 1 << 21:
                    value = column[done].as_py() or ""
                    ids.append(t.encode(value))
                    back.append(t.decode(ids[-1]))
                    size, done = size + len(value), done + 1
                where = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
                lists = pa.ListArray.from_arrays(pa.array(where, pa.int32()), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(first, done - first) for i in range(len(keep))), lists, pa.array(back, pa.string())], [*keep, "token_ids", "decoded"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(*sent)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)])
    return rows.mapInArrow(run, f"{schema}, token_ids array<int>, decoded string" if keep else "token_ids array<int>, decoded string")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded; round_trip tells whether it came back. Nulls and empties as in encode_decode."""
    done = encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), MODEL, "doc_id", "text")
    same = F.col("decoded") == F.replace(F.coalesce("text", F.lit("")), F.lit(BLANK), F.lit(" "))
    return done.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", F.sha2("decoded", 256).alias("decoded_sha256"), same.alias("round_trip"))
