"""Packing of tokenized documents into fixed-length sequences: vector bin packing by the dot-product heuristic.

An example is a vector of demands (tokens, segments, loss-bearing tokens) against a sequence's capacities. One
sequence is open at a time: of a bounded window of waiting examples the one with the largest dot product of
demand and remaining capacity goes in, each dimension weighted by its capacity. When none fits whole, the best
one is cut to what is left and its rest waits on, so a sequence ends full, or at its limit of segments.

Each partition packs its own rows: no shuffle, no text leaves its task, and at most one sequence a partition
ends short of its tokens, but for those that end at a limit of segments or loss-bearing tokens. Unless it is given, there
is no such limit: every segment has a token. A sequence's id is the partition's number times 2**33 plus its number there. A lost task packs its own rows
again; the pieces of a document never meet another task's.

Nulls and edge cases: a null or empty text is its end token only; a null id is carried along. Very long texts are cut
over many sequences, without a copy of what is left. Of examples that score the same the first waiting goes first.
Repeated rows are packed each for itself; an empty table gives no pieces. Other columns, whatever their names, are
dropped.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import table, tidy

END_ID = 1


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes as: printable Latin-1 stands for itself, the other
    bytes follow from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _word_merger(path: str):
    """bytes -> ids for one lower-case word of letters, or None where the vocabulary's ids aren't in the order of
    its merges. A word end is written as a zero byte, which joins the last byte before any other merge."""
    import tiktoken

    model = json.loads(Path(path).read_text())["model"]
    vocab, merges, end = model["vocab"], model["merges"], model["end_of_word_suffix"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
    order = [vocab[a + b] for a, b in pairs]
    if not end or order != sorted(order) or order[0] < 512:
        return None
    letters, ranks = _byte_letters(), {}
    for token, i in vocab.items():
        core = token.removesuffix(end)
        if i < order[0] + len(order) and all(c in letters for c in core):
            ranks[bytes(map(letters.__getitem__, core)) + b"\0" * (core != token)] = i
    merge = tiktoken.Encoding("words", pat_str=".+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
    return lambda word: merge(word + b"\0")


#: One run of letters, and such a run before one run of punctuation without an apostrophe.
_WORD = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*)([!-&(-/:-@\[-`{-~]*)")


#: What the words in a cache and their ids may take together, in bytes.
CACHE = 96 << 20
_ASCII_WORD = re.compile(rb"([A-Za-z]*)([!-&(-/:-@\[-`{-~]*)")


class WordCache(dict):
    """The ids of one word's bytes, as little-endian 32-bit integers; a word is what lies between ASCII white space.

    The tokenizer's own patterns never cross white space, so a text's ids are its words' ids in order. A word of
    Latin letters, and punctuation after it, are each one token group and are merged directly; every other
    word goes through the tokenizer itself. Both ways give the same ids."""

    def __init__(self, path: str, most: int = CACHE):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.most, self.merge = Tokenizer.from_file(path), most, _word_merger(path)
        self.marks: dict[bytes, bytes] = {}  # runs of punctuation, a bounded number of them
        self.held = 0
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def __missing__(self, word: bytes) -> bytes:
        ids = self._plain(word) if self.merge else None
        if ids is None:
            ids = self._ids(word)
        if len(word) < 64:
            # besides their bytes an entry's two objects and its place in the table take about 200
            self.held += len(word) + len(ids) + 200
            if self.held > self.most:
                self.forget()
            self[word] = ids
        return ids

    def _plain(self, word: bytes) -> bytes | None:
        """The ids of ASCII letters and punctuation after them; the letters may be known as a word of their own."""
        m = _ASCII_WORD.fullmatch(word)
        if not m:
            return None
        core, mark = m.groups()
        if mark and any(map(word.__contains__, self.special)):
            return None
        low = core.lower()
        ids = self.get(low) if low is not word else None
        if ids is None:
            ids = _packed(self.merge(low)) if low else b""
        if mark:
            if (tail := self.marks.get(mark)) is None:
                tail = _packed(self.merge(mark))
                if len(self.marks) < 10_000:
                    self.marks[mark] = tail
            ids += tail
        return ids

    def _ids(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if self.merge and (m := _WORD.fullmatch(text)) and not any(map(word.__contains__, self.special)):
            return b"".join(_packed(self.merge(run.encode())) for run in (m[1].lower(), m[2]) if run)
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def forget(self) -> None:
        self.clear()
        self.held = 0


_caches: dict[str, WordCache] = {}


def encode(texts: list[str | None], path: str, end: int | None = END_ID) -> list[bytes]:
    """Each text's ids as bytes of little-endian 32-bit integers, and the end id."""
    cache = _caches[path] if path in _caches else _caches.setdefault(path, WordCache(path))
    tail = b"" if end is None else int(end).to_bytes(4, "little")
    return [b"".join(map(cache.__getitem__, (t or "").encode("utf-8", "replace").split())) + tail for t in texts]


def _packed(ids: list[int]) -> bytes:
    made = array("I", ids)
    if sys.byteorder != "little":
        made.byteswap()
    return made.tobytes()


class Packer:
    """Places examples as they come. `emit(key, start, ids, sequence, offset)` is called for each piece."""

    def __init__(self, emit: Callable, tokens: int = 2048, segments: int | None = None, loss: int | None = None, window: int = 256):
        self.cap = np.array([tokens, segments or tokens, loss or tokens], float)
        self.emit, self.window = emit, window
        self.waiting: list = []  # (key, start, ids, loss-bearing tokens left)
        self.need = np.zeros((window, 3))  # a row for each that waits
        self.left, self.sequence, self.offset = self.cap.copy(), 0, 0

    def add(self, key: object, ids: bytes, loss: int | None = None) -> None:
        """loss: how many of the example's last tokens bear loss; all, unless given."""
        n = len(ids) // 4
        loss = n if loss is None else loss
        self.need[len(self.waiting)] = (n, 1, loss)
        self.waiting.append((key, 0, ids, loss))
        while len(self.waiting) >= self.window:
            self._place()

    def finish(self) -> None:
        while self.waiting:
            self._place()
        self._close()

    def _close(self) -> None:
        if self.offset:
            self.sequence, self.offset, self.left = self.sequence + 1, 0, self.cap.copy()

    def _place(self) -> None:
        need = self.need[: len(self.waiting)]
        fits = (need <= self.left).all(axis=1)
        score = need @ (self.left / self.cap**2)
        if fits.any():
            k = int(np.where(fits, score, -1).argmax())
        else:
            if self.left[1] < 1 or self.left[0] < 1:
                return self._close()
            k = int(score.argmax())
        key, start, ids, loss = self.waiting[k]
        n = int(need[k, 0])
        take = n if fits[k] else self._cut(n, loss)
        if not take:
            return self._close()
        self.emit(key, start, ids[4 * start : 4 * (start + take)], self.sequence, self.offset)
        lossy = max(0, take - (n - loss))
        self.left -= (take, 1, lossy)
        self.offset += take
        if take == n:
            self.waiting[k] = self.waiting[-1]
            self.need[k] = need[-1]
            self.waiting.pop()
        else:
            self.waiting[k] = (key, start + take, ids, loss - lossy)
            self.need[k] = (n - take, 1, loss - lossy)
        if self.left[0] < 1 or self.left[1] < 1:
            self._close()

    def _cut(self, n: int, loss: int) -> int:
        """As much of an example's front as the open sequence takes."""
        take = min(n, int(self.left[0]))
        free = n - loss
        return min(take, free + int(self.left[2])) if take > free else take


OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", tokens: int = 2048, segments: int | None = None, window: int = 256, with_ids: bool = False, loss: str | None = None, loss_capacity: int | None = None) -> DataFrame:
    """A row for each piece. with_ids adds the ids themselves, an array of integers.

    loss names a column that says how many of a row's last tokens, its end token among them, bear loss (null: all);
    each piece then has its number of them in loss_tokens. A sequence takes loss_capacity of them, or `tokens`."""
    if loss_capacity is not None and loss_capacity < 1:
        raise ValueError("loss_capacity has to be 1 at least")
    schema = OUT + (", ids array<int>" if with_ids else "") + (", loss_tokens long" if loss else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []
        names = [c.strip().split(" ")[0] for c in schema.split(",")]
        kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_ids + [pa.int64()] * bool(loss)

        def emit(k: tuple, start: int, ids: bytes, sequence: int, offset: int) -> None:
            doc, n, bearing = k
            free = n - bearing
            lossy = max(0, start + len(ids) // 4 - free) - max(0, start - free)
            rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), n, base + sequence, offset, *([np.frombuffer(ids, "<u4").astype(np.int32)] * with_ids), *([lossy] * bool(loss))))

        packer = Packer(emit, tokens, segments, loss_capacity, window)

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=names)

        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(key)).to_pylist()
            texts = batch.column(batch.schema.get_field_index(text))
            lossy = batch.column(batch.schema.get_field_index(loss)).to_pylist() if loss else [None] * len(ids)
            for i in range(0, len(ids), 64):
                for d, e, x in zip(ids[i : i + 64], encode(texts[i : i + 64].to_pylist(), path), lossy[i : i + 64], strict=True):
                    n = len(e) // 4
                    bearing = n if x is None else min(max(int(x), 0), n)
                    packer.add((d, n, bearing), e, bearing)
                if len(rows) > 5000:
                    yield out()
        packer.finish()
        yield out()

    return docs.select(key, text, *([loss] if loss else [])).mapInArrow(tidy(run), schema)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES = {"op8_packing": op8}
ORACLE: dict[str, str] = {}
