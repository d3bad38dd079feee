"""External induced suffix sorting with common-prefix values, by recursion on renamed strings.

1. The text's local minima (suffixes smaller than both neighbours) cut it into substrings. These are sorted by words of
   characters and types, dealt to files by ranges of a word where they don't fit in memory, and named by rank.
2. The names make a shorter string. Unless they all differ, its suffixes are sorted by the same steps: recursion.
3. That order of the minima induces all others. Suffix tuples wait in queues, one for each character or, of a renamed
   string, for each range of symbols. A scan in suffix order pushes each suffix's predecessor, first the larger ones
   from small to large, then the smaller ones back from large to small.

At the top level tuples carry common-prefix values: a pushed tuple's is one more than the least among those scanned
since the last push to its queue, a range minimum. The minima's own are compared in the text, to `depth` characters.

What goes beyond the memory given (queues, positions, names, the order itself) is in files of the task, in blocks that
are written and read in order or mapped; the text may be mapped, too. 0 separates strings. Separators are told apart
by their places, so no order depends on what follows one, and the recursion ends after about log2 of the longest
string's length.
"""

from __future__ import annotations

import tempfile
from collections import deque
from collections.abc import Iterator

import numpy as np


class Store:
    """A task's files. They have no name once they are open, so a lost task leaves none behind."""

    def __init__(self, memory: int = 32 << 20, folder: str | None = None):
        self.memory, self.folder, self.spills = memory, folder, 0

    def file(self):
        self.spills += 1
        return tempfile.TemporaryFile(dir=self.folder)

    def array(self, n: int, kind: type) -> np.ndarray:
        """Zeros, in a file if they are large."""
        if n * np.dtype(kind).itemsize <= self.memory // 4:
            return np.zeros(n, kind)
        with self.file() as f:
            f.truncate(n * np.dtype(kind).itemsize)
            return np.memmap(f, kind, "r+", shape=(n,))


class Queues:
    """First in, first out, `many` of them, of rows with columns of these kinds; in a file beyond a share of the memory."""

    def __init__(self, many: int, store: Store, *kinds: type, chunk: int = 1 << 18):
        self.store, self.kinds, self.chunk = store, [np.dtype(k) for k in kinds], chunk
        self.size = sum(k.itemsize for k in self.kinds)
        self.entries: list[deque] = [deque() for _ in range(many)]
        self.held, self.disk = 0, None

    def push(self, c: int, *cols: np.ndarray) -> None:
        if len(cols[0]):
            self.entries[c].append(cols)
            self.held += self.size * len(cols[0])
            if self.held > self.store.memory // 4:
                self._spill()

    def _spill(self) -> None:
        self.disk = self.disk or self.store.file()
        self.store.spills += 1
        self.disk.seek(0, 2)
        for c, entries in enumerate(self.entries):
            if any(isinstance(e[0], np.ndarray) for e in entries):
                done: deque = deque()
                for e in entries:
                    if not isinstance(e[0], np.ndarray):
                        done.append(e)
                        continue
                    for a in range(0, len(e[0]), self.chunk):
                        done.append((self.disk.tell(), len(e[0][a : a + self.chunk])))
                        for col, kind in zip(e, self.kinds, strict=True):
                            self.disk.write(col[a : a + self.chunk].astype(kind, copy=False).tobytes())
                self.entries[c] = done
        self.held = 0

    def load(self, entry: tuple) -> tuple[np.ndarray, ...]:
        if isinstance(entry[0], np.ndarray):
            return entry
        at, n = entry
        self.disk.seek(at)
        raw, out, a = self.disk.read(self.size * n), [], 0
        for kind in self.kinds:
            out.append(np.frombuffer(raw, kind, n, a))
            a += kind.itemsize * n
        return tuple(out)

    def pop(self, c: int) -> tuple[np.ndarray, ...] | None:
        """The next block of a queue, or None."""
        taken, size, entries = [], 0, self.entries[c]
        while entries and size < self.chunk:
            e = entries.popleft()
            if isinstance(e[0], np.ndarray):
                self.held -= self.size * len(e[0])
            taken.append(self.load(e))
            size += len(taken[-1][0])
        if len(taken) < 2:
            return taken[0] if taken else None
        return tuple(np.concatenate([t[k] for t in taken]) for k in range(len(self.kinds)))

    def blocks(self, c: int, backwards: bool = False) -> Iterator[tuple[np.ndarray, ...]]:
        """All blocks of a queue, which keeps them."""
        for e in reversed(self.entries[c]) if backwards else self.entries[c]:
            yield self.load(e)

    def take(self, c: int) -> tuple[np.ndarray, ...]:
        """All rows of a queue, which is empty then."""
        got = list(iter(lambda: self.pop(c), None))
        return tuple(np.concatenate([g[k] for g in got]) if got else np.zeros(0, kind) for k, kind in enumerate(self.kinds))


def minima(text: np.ndarray, store: Store, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(whether each suffix is larger than the one after it, the places of local minima in order), block by block from
    the end. The last suffix is larger; of two zeros the second is."""
    n = len(text)
    larger = store.array(n, np.bool_)
    places = store.array(n // 2 + 1, np.int64)
    free = len(places)
    larger[n - 1] = True
    for b in range(n - 1, 0, -block):
        a = max(0, b - block)
        x, y = text[a:b], text[a + 1 : b + 1]
        kind = (x < y).astype(np.int8) - (x > y) + ((x == y) & (x == 0))
        kind = np.append(kind, np.int8(-1 if larger[b] else 1))
        known = np.flatnonzero(kind)
        big = kind[known[np.searchsorted(known, np.arange(b - a + 1))]] < 0
        larger[a:b] = big[:-1]
        found = a + 1 + np.flatnonzero(~big[1:] & big[:-1])
        places[free - len(found) : free] = found
        free -= len(found)
    return larger, places[free:]


class Names:
    """Names for the substrings from each local minimum to the next, in their order, and so the renamed string."""

    def __init__(self, text: np.ndarray, larger: np.ndarray, places: np.ndarray, store: Store, separated: bool):
        self.text, self.larger, self.places, self.store, self.separated = text, larger, places, store, separated
        top = 4 * (int(text.max()) if len(text) else 0) + 3
        self.bits = next(b for b in (16, 32, 64) if top < 1 << b)

    def words(self, idx: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k-th word of each substring, 0 beyond its end, and whether it goes on beyond that word."""
        width = 64 // self.bits
        at = self.places[idx] + k * width
        following = np.minimum(idx + 1, len(self.places) - 1)
        end = np.where(idx + 1 < len(self.places), self.places[following], len(self.text) - 1)
        out = np.zeros(len(idx), np.uint64)
        for c in range(width):
            here = np.minimum(at + c, end)
            # of one character the text's end is the smallest, then a larger suffix, then a smaller one
            code = self.text[here].astype(np.uint64) * np.uint64(4) + np.uint64(3) - self.larger[here] - (here == len(self.text) - 1)
            out = (out << np.uint64(self.bits % 64)) | np.where(at + c <= end, code, np.uint64(0))
        return out, at + width <= end

    def inside(self, idx: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(idx in order, where a new name begins), from word k on, in memory."""
        group, new = np.zeros(len(idx), np.int64), np.zeros(len(idx), bool)
        new[:1] = True
        open_ = np.arange(len(idx)) if len(idx) > 1 else np.zeros(0, np.int64)
        while len(open_):
            w, more = self.words(idx[open_], k)
            g = group[open_]
            o = np.lexsort((w, g)) if g[0] != g[-1] else np.argsort(w, kind="stable")
            w, more, g = w[o], more[o], g[o]
            idx[open_] = idx[open_][o]
            starts = np.r_[True, (g[1:] != g[:-1]) | (w[1:] != w[:-1])]
            new[open_[starts]] = True
            lone = starts & np.r_[starts[1:], True]
            group[open_] = np.cumsum(starts)
            open_ = open_[more & ~lone]
            k += 1
        yield idx, new

    def ordered(self, blocks: Iterator[np.ndarray], many: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """As inside(), for more than the memory holds: dealt by ranges of the word, or by the next one if all are equal."""
        if 64 * many <= self.store.memory or many < 2:
            yield from self.inside(np.concatenate([*blocks, np.zeros(0, np.int64)]), k)
            return
        spool, sample, go_on = Queues(1, self.store, np.int64), [], False
        for idx in blocks:
            w, more = self.words(idx, k)
            go_on |= bool(more.any())
            sample.append(np.sort(w)[:: max(1, len(w) // 64)])
            sample.append(w[[w.argmin(), w.argmax()]])
            spool.push(0, idx)
        seen = np.sort(np.concatenate(sample))
        if seen[0] == seen[-1]:
            if go_on:
                yield from self.ordered((b for (b,) in spool.blocks(0)), many, k + 1)
                return
            first = True
            for (idx,) in spool.blocks(0):
                new = np.zeros(len(idx), bool)
                new[0], first = first, False
                yield idx, new
            return
        ranges = min(256, 2 + 64 * many // max(1, self.store.memory))
        cuts = np.unique(np.r_[seen[np.linspace(0, len(seen) - 1, ranges + 1).astype(int)[1:-1]], seen[-1]])
        cuts = cuts[cuts > seen[0]]
        dealt, sizes = Queues(len(cuts) + 1, self.store, np.int64), np.zeros(len(cuts) + 1, np.int64)
        for (idx,) in spool.blocks(0):
            r = np.searchsorted(cuts, self.words(idx, k)[0], "right")
            for c in np.unique(r):
                dealt.push(int(c), part := idx[r == c])
                sizes[c] += len(part)
        for c, size in enumerate(sizes.tolist()):
            if size:
                yield from self.ordered((b for (b,) in dealt.blocks(c)), size, k)

    def renamed(self, block: int) -> tuple[np.ndarray, bool]:
        """(the renamed string, whether all its symbols differ). Separators' names are their places in order."""
        m = len(self.places)
        out = self.store.array(m, np.int64)
        ahead, spool, rest = 0, Queues(1, self.store, np.int64), 0
        for a in range(0, m, block):
            idx = np.arange(a, min(a + block, m))
            apart = (self.text[self.places[idx]] == 0) & self.separated
            out[idx[apart]] = ahead + 1 + np.arange(apart.sum())
            ahead += int(apart.sum())
            spool.push(0, idx[~apart])
            rest += int((~apart).sum())
        name, alone = ahead, True
        for idx, new in self.ordered((b for (b,) in spool.blocks(0)), rest, 0):
            names = name + np.cumsum(new)
            out[idx] = names
            alone &= bool(new.all())
            name = int(names[-1]) if len(names) else name
        return out, alone


def order(text: np.ndarray, store: Store) -> np.ndarray:
    """The suffix array of a string of positive integers, those of separators unlike all others."""
    n, block = len(text), max(1024, store.memory // 64)
    larger, places = minima(text, store, block)
    seeds = _seeds(text, larger, places, store, block, False)
    del larger
    sample = np.sort(np.asarray(text[:: max(1, n // 65536)]))
    many = 1 + max(96 * n // max(1, store.memory), n >> 14)
    cuts, times = np.unique(sample[np.linspace(0, len(sample) - 1, many + 1).astype(int)[1:-1]], return_counts=True)
    cuts = np.union1d(cuts, cuts[times > 1] + 1)  # a frequent symbol has a range of its own
    lows, tops = np.r_[0, cuts], np.r_[cuts, max(int(text.max()), int(cuts.max(initial=0))) + 1]
    sizes = np.zeros(len(lows), np.int64)
    for a in range(0, n, block):
        sizes += np.bincount(np.searchsorted(cuts, text[a : a + block], "right"), minlength=len(lows))
    seed_ends = np.zeros(len(lows) + 1, np.int64)
    for a in range(0, len(seeds), block):
        seed_ends[1:] += np.bincount(np.searchsorted(cuts, text[seeds[a : a + block]], "right"), minlength=len(lows))
    seed_ends = np.cumsum(seed_ends)

    def push(queues: Queues, pos: np.ndarray) -> None:
        r = np.searchsorted(cuts, text[pos], "right")
        by = np.argsort(r, kind="stable")
        pos, r = pos[by], r[by]
        starts = np.flatnonzero(np.diff(r, prepend=-1))
        for a, b in zip(starts, np.r_[starts[1:], len(pos)][: len(starts)], strict=True):
            queues.push(int(r[a]), pos[a:b])

    def scan(first: np.ndarray, second: np.ndarray, lo: int, hi: int, up: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Suffixes of one range in scan order, whether each is of the kind induced, and predecessors of other ranges.
        first: those pushed before, in order; second: those of the other kind, in order. What they induce in the
        range itself stands between the two, symbol by symbol, in the order of what it was induced from: that is found
        by sorting it again until nothing changes."""

        def looked_at(pos: np.ndarray, sym: np.ndarray, equal: np.ndarray | bool) -> tuple[np.ndarray, ...]:
            before = np.maximum(pos - 1, 0)
            prev = text[before]
            wanted = (pos > 0) & ((prev > sym if up else prev < sym) | ((prev == sym) & equal))
            here = wanted & ((prev < hi) if up else (prev >= lo))
            return pos, sym, before, prev, wanted & ~here, here

        pos = np.concatenate([first, second])
        group = np.repeat(np.array([0, 2]), [len(first), len(second)])
        place = np.concatenate([np.arange(len(first)), np.arange(len(second))])
        waves, parents, known = [looked_at(pos, text[pos], group == 0)], [], 0
        while len(at := np.flatnonzero(waves[-1][5])):
            parents.append(known + at)
            known += len(waves[-1][0])
            waves.append(looked_at(waves[-1][2][at], waves[-1][3][at], True))
        pos, sym, before, _, out, _ = (np.concatenate([w[k] for w in waves]) for k in range(6))
        level = sym - lo if up else hi - sym
        if hi - lo >= 1 << 21:
            level = np.unique(level, return_inverse=True)[1]
        key = level << 42
        own = len(group)
        key[:own] |= group << 40 | place
        if parents:
            parent, least = np.concatenate(parents), key[own:] | 1 << 40
            rank = np.arange(len(parent))
            while True:
                key[own:] = least | rank
                o = np.lexsort((key[parent], least))
                new = np.empty_like(rank)
                new[o] = np.arange(len(o))
                if np.array_equal(new, rank):
                    break
                rank = new
        o = np.argsort(key)
        kind = np.ones(len(pos), bool)
        kind[:own] = group == 0
        out = out[o]
        return pos[o], kind[o], before[o][out]

    def stream(pos: np.ndarray, sym: int, queues: Queues, up: bool, equal: bool) -> None:
        """The predecessors of suffixes that begin with one symbol."""
        before = np.maximum(pos - 1, 0)
        prev = text[before]
        push(queues, before[(pos > 0) & ((prev > sym if up else prev < sym) | (prev == sym) & equal)])

    alone = tops == lows + 1  # such a range needs no sorting, and goes through in blocks
    rising, found = Queues(len(lows), store, np.int64), Queues(len(lows), store, np.int64)
    push(rising, np.array([n - 1]))
    for r in range(len(lows)):
        if alone[r]:
            while got := rising.pop(r):
                found.push(r, *got)
                stream(*got, lows[r], rising, True, True)
            for a in range(seed_ends[r], seed_ends[r + 1], block):
                stream(np.asarray(seeds[a : min(a + block, seed_ends[r + 1])]), lows[r], rising, True, False)
            continue
        got, kind, out = scan(rising.take(r)[0], np.asarray(seeds[seed_ends[r] : seed_ends[r + 1]]), lows[r], tops[r], True)
        found.push(r, got[kind])
        push(rising, out)
    sa, ends = store.array(n, np.int64), np.cumsum(sizes)
    falling = Queues(len(lows), store, np.int64)
    for r in range(len(lows) - 1, -1, -1):
        if alone[r]:
            to = ends[r]
            while got := falling.pop(r):
                sa[to - len(got[0]) : to] = got[0][::-1]
                to -= len(got[0])
                stream(*got, lows[r], falling, False, True)
            for (pos,) in found.blocks(r, backwards=True):
                sa[to - len(pos) : to] = pos
                to -= len(pos)
                stream(pos[::-1], lows[r], falling, False, False)
            continue
        got, _, out = scan(falling.take(r)[0], found.take(r)[0][::-1], lows[r], tops[r], False)
        sa[ends[r] - sizes[r] : ends[r]] = got[::-1]
        push(falling, out)
    return sa


def _seeds(text: np.ndarray, larger: np.ndarray, places: np.ndarray, store: Store, block: int, separated: bool) -> np.ndarray:
    """The local minima in suffix order: by their names, or by recursion on the renamed string."""
    out = store.array(len(places), np.int64)
    if not len(places):
        return out
    names, alone = Names(text, larger, places, store, separated).renamed(block)
    if not alone:
        ranks = order(names, store)
        for a in range(0, len(out), block):
            out[a : a + block] = places[ranks[a : a + block]]
        return out
    for a in range(0, len(out), block):
        out[names[a : a + block] - 1] = places[a : a + block]
    return out


class RangeMin:
    """Minima of ranges, from those of all runs of a power of two, which are laid end to end."""

    def __init__(self, a: np.ndarray):
        runs = 1 << np.arange(max(len(a), 1).bit_length())
        ends = np.cumsum(len(a) + 1 - runs)
        self.runs, self.starts, self.flat = runs, np.r_[0, ends[:-1]], np.empty(ends[-1], a.dtype)
        self.flat[: len(a)] = a
        for run, before, start, end in zip(runs[1:] // 2, self.starts, self.starts[1:], ends[1:], strict=False):
            np.minimum(self.flat[before : start - run], self.flat[before + run : start], out=self.flat[start:end])

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minima over [lo, hi], both inside and lo <= hi."""
        k = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
        start = self.starts[k]
        return np.minimum(self.flat[start + lo], self.flat[start + hi + 1 - self.runs[k]])


class _Pusher:
    """Takes scanned tuples of one first character in order and pushes the predecessors that are of the wanted kind."""

    def __init__(self, text: np.ndarray, queues: Queues, depth: int, up: bool):
        self.text, self.queues, self.depth, self.up = text, queues, depth, up
        self.since = np.zeros(256, np.uint8)  # the least prefix scanned since the last push; 0 before any push
        self.pushed = np.zeros(256, bool)
        self.last = -1

    def scan(self, c: int, pos: np.ndarray, lcp: np.ndarray, equal: bool) -> None:
        """equal: whether a predecessor of the same character is wanted, too."""
        before = np.maximum(pos - 1, 0)
        prev = self.text[before]
        k = np.flatnonzero((pos > 0) & ((prev > c if self.up else prev < c) | ((prev == c) & equal)))
        least = lcp.min()
        fresh = np.minimum(self.since, least)
        if len(k):
            chars = prev[k]
            by = np.argsort(chars, kind="stable")
            k, chars = k[by], chars[by]
            first = np.flatnonzero(np.r_[True, chars[1:] != chars[:-1]])
            lo = np.r_[0, k[:-1] + 1]
            lo[first] = 0
            least_of = RangeMin(lcp)
            got = least_of(lo, k)
            got[first] = np.minimum(got[first], self.since[chars[first]])
            out = np.minimum(got.astype(np.int16) + 1, self.depth).astype(np.uint8)
            ends = np.r_[first[1:], len(k)]
            tail = k[ends - 1] + 1
            full = tail < len(lcp)
            rest = np.full(len(first), self.depth, np.uint8)
            rest[full] = least_of(tail[full], np.full(full.sum(), len(lcp) - 1))
            fresh[chars[first]] = rest
            places = before[k]
            # a queue's first tuple follows nothing of the same character; separators have nothing in common
            for f, e, x in zip(first, ends, chars[first], strict=True):
                if not self.pushed[x]:
                    out[f] = 0
                    self.pushed[x] = True
                if not x:
                    out[f:e] = 0
                self.queues.push(int(x), places[f:e], out[f:e])
        self.since = fresh
        self.last = int(pos[-1])


class Prefixes:
    """Common prefixes of suffixes of a text, which end at a separator, to `depth` characters."""

    #: The least numbers of one to eight bytes.
    STEPS = np.uint64(1) << np.arange(0, 64, 8, dtype=np.uint64)

    def __init__(self, padded: np.ndarray, n: int, depth: int):
        self.words, self.n, self.depth = np.ndarray((n,), ">u8", padded, strides=(1,)), n, depth

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), np.int64)
        live = np.arange(len(a))
        for k in range(0, self.depth, 8):
            live = live[np.maximum(a[live], b[live]) + k < self.n]
            if not len(live):
                break
            x, y = (self.words[p[live] + k].astype(np.uint64) for p in (a, b))
            low = np.uint64(0x7F7F7F7F7F7F7F7F)
            # bits set from the first character on that differs or is a separator
            odd = (x ^ y) | ~(((x & low) + low) | x | low)
            same = 8 - np.searchsorted(self.STEPS, odd, "right")
            out[live] += same
            live = live[same == 8]
        # a word may reach beyond the text's end
        return np.minimum(np.minimum(out, self.depth), self.n - np.maximum(a, b)).astype(np.uint8)

    def one(self, a: int, b: int) -> int:
        return int(self(np.array([a]), np.array([b]))[0])


def suffix_array(text: np.ndarray, depth: int, memory: int = 64 << 20, store: Store | None = None, n: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (positions, prefix with the position before, at most depth), in suffix order up to the separators.

    n: the text's length where eight zeros or more follow it in `text`, which is then not copied."""
    store = store or Store(memory)
    if n is None:
        n, text = len(text), np.concatenate([text, np.zeros(8, np.uint8)])
    if not n:
        return
    prefixes, text = Prefixes(text, n, depth), text[:n]
    block = max(1024, store.memory // 64)
    larger, places = minima(text, store, block)
    seeds = _seeds(text, larger, places, store, block, True)
    del larger
    bounds = np.zeros(257, np.int64)
    for a in range(0, len(seeds), block):
        bounds[1:] += np.bincount(text[seeds[a : a + block]], minlength=256)
    bounds = np.cumsum(bounds)

    kind = np.int32 if n < 1 << 31 else np.int64
    waiting, ready = (Queues(256, store, kind, np.uint8) for _ in range(2))
    push = _Pusher(text, waiting, depth, True)
    push.pushed[text[-1]] = True
    waiting.push(int(text[-1]), np.array([n - 1], kind), np.zeros(1, np.uint8))
    for c in range(256):
        some = False
        while got := waiting.pop(c):
            ready.push(c, *got)
            push.scan(c, *got, equal=c > 0)
            some = True
        for a in range(bounds[c], bounds[c + 1], block):
            here = np.asarray(seeds[a : min(a + block, bounds[c + 1])])
            lcp = np.zeros(len(here), np.uint8)
            lcp[1:] = prefixes(here[:-1], here[1:])
            if some:
                lcp[0] = prefixes.one(push.last, int(here[0]))
            push.scan(c, here, lcp, equal=False)
            some = True
    del seeds
    down, out = (Queues(256, store, kind, np.uint8) for _ in range(2))
    push = _Pusher(text, down, depth, False)

    def drain(c: int) -> None:
        while got := down.pop(c):
            out.push(c, *got)
            push.scan(c, *got, equal=True)

    for c in range(255, -1, -1):
        drain(c)
        had = push.last if push.last >= 0 and text[push.last] == c else -1
        after = -1
        for pos, lcp in ready.blocks(c, backwards=True):
            if after < 0:
                after = prefixes.one(had, int(pos[-1])) if had >= 0 else 0
            push.scan(c, pos[::-1], np.r_[np.uint8(after), lcp[:0:-1]].astype(np.uint8), equal=c == 0)
            after = int(lcp[0])
    drain(0)  # zeros before the last one, if that ends the text
    for c in range(256):
        end = -1
        for pos, lcp in ready.blocks(c):
            yield pos, lcp
            end = int(pos[-1])
        lead = -1
        for pos, lcp in out.blocks(c, backwards=True):
            # read backwards, a value stands with the later of two; forwards, with the earlier
            if lead < 0:
                lead = prefixes.one(end, int(pos[-1])) if end >= 0 else 0
            yield pos[::-1], np.r_[np.uint8(lead), lcp[:0:-1]].astype(np.uint8)
            lead = int(lcp[0])


def _word(text: np.ndarray, pos: np.ndarray, k: int) -> np.ndarray:
    """Eight characters from pos + 8 * k on as one big-endian number; 0 beyond the end."""
    out = np.zeros(len(pos), np.uint64)
    for at in range(8 * k, 8 * k + 8):
        here = pos + at
        out = out << np.uint64(8) | np.where(here < len(text), text[np.minimum(here, len(text) - 1)], 0).astype(np.uint64)
    return out


def depth_sort(text: np.ndarray, pos: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their first `depth` characters at least, by words of eight."""
    idx, group = pos.astype(np.int64), np.zeros(len(pos), np.int64)
    open_ = np.arange(len(pos))
    for k in range(-(-depth // 8)):
        if not len(open_):
            break
        w, g = _word(text, idx[open_], k), group[open_]
        o = np.lexsort((w, g)) if g[0] != g[-1] else np.argsort(w, kind="stable")
        idx[open_], w, g = idx[open_][o], w[o], g[o]
        starts = np.r_[True, (g[1:] != g[:-1]) | (w[1:] != w[:-1])]
        group[open_] = np.cumsum(starts)
        open_ = open_[~(starts & np.r_[starts[1:], True])]
    return idx
