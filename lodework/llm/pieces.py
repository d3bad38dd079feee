"""SentencePiece encoding and decoding by suffix-array matching.

A batch's texts fall into segments that no piece crosses (a run of blanks and what follows up to the next blank).
Segments met before are remembered with their ids, up to a bound in bytes, so most of a batch is looked up. The distinct
segments that are new in it are laid end to end as one text and indexed by a suffix array. Every piece of the
vocabulary is binary-searched in it, which gives the range of all its occurrences: the edges of a lattice. Sorted
by position, the edges are relaxed from left to right, all segments side by side.

The models here are of the BPE kind, where the wanted path is that of the merges, not the one of least cost. A path
is the merges' result exactly if each piece on it is its own encoding and each two neighbours stay two when
encoded together. So relaxing keeps, at each place, the one edge whose piece stands beside the one kept where it
starts; whether two pieces stay two is found once and remembered, and the last answers are looked up by slots.

Characters outside the vocabulary become their UTF-8 bytes' pieces. Special pieces' names in a text are plain text.

A model of another kind, or one whose normalisation changes more than blanks into blank signs with one in front, is
refused.

Nulls and edge cases: a null text is empty and has no ids. A blank sign of the vocabulary (U+2581) in a text reads
back as a blank, as the format has no other writing for it. Very long texts and segments go through whole. Where two
paths seem to tie, the merges decide. Repeated rows are encoded one by one. Columns named like the result's are replaced,
others are carried along. An empty table gives no row.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .common import table, tidy
from .induced_sort import depth_sort

BLANK = "▁"
_SEGMENT = re.compile(rb"\xff*[^\xff]*")
_END = 0xFE  # stands after each segment; neither it nor 0xFF, the blank, is in UTF-8


def _coded(piece: str) -> bytes:
    return piece.replace(" ", BLANK).encode("utf-8", "replace").replace(b"\xe2\x96\x81", b"\xff")


def _fields(raw: bytes) -> dict[int, object]:
    """The last value of each field of a message in the wire format of protocol buffers."""
    out, i = {}, 0

    def number() -> int:
        nonlocal i
        value = shift = 0
        while True:
            b = raw[i]
            i += 1
            value |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return value

    while i < len(raw):
        key = number()
        if key & 7 == 0:
            out[key >> 3] = number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            out[key >> 3] = raw[i : i + size]
            i += size
    return out


def check_model(path: str) -> None:
    """Refuses a model that is not of the BPE kind, or that normalises texts in ways not followed here."""
    model = _fields(Path(path).read_bytes())
    # The numbers of the fields and of the BPE kind, and the defaults of what is left out.
    kind = _fields(model.get(2, b"")).get(3, 1)
    rules = _fields(model.get(3, b""))
    if kind != 2:
        raise ValueError(f"{path}: a model of kind {kind}; only BPE (2) is encoded here")
    wanted = {"precompiled map": (rules.get(2, b""), b""), "dummy prefix": (rules.get(3, 1), 1), "blanks removed": (rules.get(4, 1), 0), "blanks escaped": (rules.get(5, 1), 1)}
    if odd := [name for name, (have, want) in wanted.items() if have != want]:
        raise ValueError(f"{path}: normalisation that isn't followed here: {', '.join(odd)}")


#: What remembered segments may take, in bytes; remembered pairs may take a third of that, besides their slots.
CACHE = 96 << 20
#: So many suffixes are searched at once.
PART = 1 << 19
#: Slots for pairs of pieces, a power of two: 9 MB.
SLOTS = 1 << 20
_SPREAD = np.int64(-7046029254386353131)


class Pieces:
    """A BPE vocabulary and what is known of segments and of neighbouring pieces."""

    def __init__(self, path: str, most: int = CACHE):
        import sentencepiece

        check_model(path)
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.most, self.known, self.held = most, {}, 0
        self.bytes = {}
        self.text: list[bytes] = [b""] * n
        ids, codes = [], []
        for i in range(n):
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[1:-1], 16)
                self.bytes[value] = i
                self.text[i] = bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                code = _coded(model.id_to_piece(i))
                ids.append(i)
                codes.append(code)
                self.text[i] = code
        self.unknown = model.unk_id()
        self.score = {c: model.get_score(i) for i, c in zip(ids, codes, strict=True)}
        self.id = dict(zip(codes, ids, strict=True))
        # only a piece that is its own encoding can be on a path
        self.codes = [c for c in codes if self.merged(c) == [c]]
        self.codes.sort()
        self.code_ids = np.array([self.id[c] for c in self.codes], np.int64)
        self.code_len = np.fromiter(map(len, self.codes), np.int64, len(self.codes))
        self.width = -(-int(self.code_len.max()) // 8) * 8
        self.pairs: dict[int, bool] = {}
        # the pairs looked up last, each in the slot of its hash
        self.slots, self.stay = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, bool)

    @staticmethod
    def _chars(code: bytes) -> list[bytes]:
        return [m.encode("utf-8", "surrogateescape") for m in code.decode("utf-8", "surrogateescape")]

    def merged(self, code: bytes) -> list[bytes]:
        """The merges' result: again and again the best-scored pair, the leftmost of equals."""
        return self._merged(self._chars(code))

    def _merged(self, parts: list[bytes]) -> list[bytes]:
        score, none = self.score.get, -np.inf
        scores = [score(a + b, none) for a, b in itertools.pairwise(parts)]
        while scores and (best := max(scores)) > none:
            i = scores.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = score(parts[i - 1] + parts[i], none)
            if i < len(scores):
                scores[i] = score(parts[i] + parts[i + 1], none)
        return parts

    def _stays(self, keys: np.ndarray) -> np.ndarray:
        """For each left id * 2**32 + right id: do the two stay two?"""
        slot = (keys * _SPREAD).view(np.uint64) >> np.uint64(64 - SLOTS.bit_length() + 1)
        stay = self.stay[slot]
        at = np.flatnonzero(self.slots[slot] != keys)
        if len(at):
            fresh, back = np.unique(keys[at], return_inverse=True)
            if 100 * len(self.pairs) > self.most // 3:
                self.pairs.clear()
            known, got = self.pairs, np.zeros(len(fresh), bool)
            for k, key in enumerate(fresh.tolist()):
                if (stays := known.get(key)) is None:
                    a, b = self.text[key >> 32], self.text[key & 0xFFFFFFFF]
                    stays = known[key] = self._merged(self._chars(a) + self._chars(b)) == [a, b]
                got[k] = stays
            stay[at] = got[back]
            self.slots[slot[at]], self.stay[slot[at]] = keys[at], stay[at]
        return stay

    def learn(self, segments: list[bytes]) -> dict[bytes, bytes]:
        """The ids of each segment, as little-endian 32-bit integers."""
        if not segments:
            return {}
        text = np.frombuffer(b"".join(s + b"\xfe" for s in segments) + bytes(8), np.uint8)
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        begin = np.flatnonzero(((text < 0x80) | (text >= 0xC0)) & (text != _END))[:-8]
        order = depth_sort(text, begin, self.width)
        padded = np.concatenate([text, np.zeros(self.width, np.uint8)])
        least, most = (np.array(x, f"S{self.width}") for x in (self.codes, [c + b"\xff" * (self.width - len(c)) for c in self.codes]))
        lo, hi = np.zeros(len(least), np.int64), np.zeros(len(least), np.int64)
        for a in range(0, len(order), PART):  # places in a part of the array add up to those in the whole
            rows = padded[order[a : a + PART, None] + np.arange(self.width)].view(f"S{self.width}").ravel()
            lo += np.searchsorted(rows, least)
            hi += np.searchsorted(rows, most, "right")
        count = hi - lo
        which = np.repeat(np.arange(len(count)), count)
        at = order[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)].astype(np.int64)
        token, size = self.code_ids[which], self.code_len[which]
        # characters that are no piece stand as tokens of their own, numbered from -2 down by their length
        one = np.zeros(len(text), bool)
        width = np.select([text < 0x80, text < 0xE0, text < 0xF0, text < 0xFF], [1, 2, 3, 4], 1)
        one[at[size == width[at]]] = True
        odd = begin[~one[begin]]
        at, token, size = np.concatenate([at, odd]), np.concatenate([token, np.full(len(odd), -2)]), np.concatenate([size, width[odd]])
        owner = np.repeat(np.arange(len(segments), dtype=np.int32), sizes + 1)[at]
        end = at + size - starts[owner]
        by = np.argsort(end, kind="stable")
        at, token, size, owner, end = at[by], token[by], size[by], owner[by], end[by]
        last, length = np.full(len(text) + 1, -1, np.int64), np.zeros(len(text) + 1, np.int64)
        bounds = np.flatnonzero(np.r_[True, end[1:] != end[:-1], True])
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            s, t = at[a:b], token[a:b]
            fits = s == starts[owner[a:b]]
            left = np.where(fits, -1, last[s])
            free = (left == -2) | (t == -2) & (left != -1)
            fits |= free
            ask = np.flatnonzero(~fits & (left >= 0))
            if len(ask):
                fits[ask] = self._stays((left[ask] << 32) | t[ask])
            k = np.flatnonzero(fits)
            last[s[k] + size[a:b][k]], length[s[k] + size[a:b][k]] = t[k], size[a:b][k]
        # back from each segment's end, a step of all segments at a time
        alive = np.flatnonzero(sizes)
        here = ends[alive]
        steps, lost = [], [np.zeros(0, np.int64)]
        while len(alive):
            n, t = length[here], last[here]
            lost.append(alive[(n == 0) | (t < 0)])  # no path by neighbours alone, or one with characters that are no piece
            steps.append((alive, t))
            here = here - n
            go = (here > starts[alive]) & (n > 0) & (t >= 0)
            alive, here = alive[go], here[go]
        who, ids = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in reversed(steps))]) for k in (0, 1))
        by = np.argsort(who, kind="stable")
        raw = ids[by].astype("<u4").tobytes()
        bounds = 4 * np.r_[0, np.cumsum(np.bincount(who, minlength=len(segments)))]
        out = [raw[a:b] for a, b in itertools.pairwise(bounds.tolist())]
        for i in np.concatenate(lost).tolist():
            out[i] = self._spelled(segments[i], last, length, int(starts[i]), int(ends[i]))
        return dict(zip(segments, out, strict=True))

    def _spelled(self, segment: bytes, last: np.ndarray, length: np.ndarray, start: int, here: int) -> bytes:
        """The ids of a segment whose path has characters that are no piece, or that has none by neighbours alone."""
        ids: list[int] = []
        end = here
        while here > start:
            n, t = int(length[here]), int(last[here])
            if not n:
                parts = self.merged(segment)
                return np.array([x for p in parts for x in ([self.id[p]] if p in self.id else [self.bytes.get(b, self.unknown) for b in p])], "<u4").tobytes()
            at = len(segment) - (end - here)
            ids += [t] if t >= 0 else [self.bytes.get(x, self.unknown) for x in segment[at - n : at][::-1]]
            here -= n
        return np.array(ids[::-1], "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each whole text. A blank comes before the first character, as the model asks."""
        split = [_SEGMENT.findall(_coded(" " + t)) if t else [] for t in texts]
        new = {s for words in split for s in words if s not in self.known}
        if new:
            if self.held > self.most:
                self.forget()
                new = {s for words in split for s in words}
            found = self.learn(sorted(new))
            self.known.update(found)
            self.held += sum(len(s) + len(ids) + 200 for s, ids in found.items())
        return [b"".join(map(self.known.__getitem__, words)) for words in split]

    def forget(self) -> None:
        self.known.clear()
        self.held = 0

    def decode(self, ids: bytes) -> str:
        """The text of ids (little-endian 32-bit): blanks for the blank sign, but the first; bytes joined to characters."""
        raw = b"".join(map(self.text.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return (raw[1:] if raw[:1] == b"\xff" else raw).replace(b"\xff", b" ").decode("utf-8", "replace")


_models: dict[str, Pieces] = {}


def model(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def _texts(column: pa.Array, most: int = 2 << 20) -> Iterator[list[str | None]]:
    part, size = [], 0
    for t in column:
        part.append(t.as_py())
        size += len(part[-1] or "")
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


OUT = "n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean"


def encode_column(docs: DataFrame, path: str, text: str = "text", digest: bool = False) -> DataFrame:
    """docs with ids (array of integers) for each text, or with their digests and those of the text decoded from them."""
    names = [c.strip().split(" ")[0] for c in OUT.split(",")] if digest else ["ids"]
    carried = docs.select(*[c for c in docs.columns if c not in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for batch in batches:
            row = 0
            for part in _texts(batch.column(batch.schema.get_field_index(text))):
                got = pieces.encode(part)
                if digest:
                    back = list(map(pieces.decode, got))
                    same = [b == (t or "").replace(BLANK, " ") for b, t in zip(back, part, strict=True)]
                    made = [
                        pa.array([len(e) // 4 for e in got], pa.int64()),
                        pa.array(list(map(zlib.crc32, got)), pa.int64()),
                        pa.array([hashlib.sha256(b.encode("utf-8", "replace")).hexdigest() for b in back], pa.string()),
                        pa.array(same, pa.bool_()),
                    ]
                else:
                    made = [pa.array([np.frombuffer(e, "<u4").astype(np.int32) for e in got], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([*batch.slice(row, len(part)).columns, *made], names=[*batch.schema.names, *names])
                row += len(part)

    return carried.mapInArrow(tidy(run), StructType([*carried.schema.fields, *StructType.fromDDL(OUT if digest else "ids array<int>").fields]))


def decode_column(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """rows with the text of their ids; null ids give a null text."""
    carried = rows.select(*[c for c in rows.columns if c != "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for batch in batches:
            got = [None if x is None else pieces.decode(np.array(x, "<u4").tobytes()) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.string())], names=[*batch.schema.names, "text"])

    return carried.mapInArrow(tidy(run), StructType([*carried.schema.fields, *StructType.fromDDL("text string").fields]))


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_column(table(spark, sf_dir, "documents").select("doc_id", "text"), model_path(), digest=True).drop("text")


QUERIES = {"op4_sentencepiece": op4}
ORACLE: dict[str, str] = {}
