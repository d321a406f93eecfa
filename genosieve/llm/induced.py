"""External induced sorting of the suffixes of one shard, with their common prefixes.

Suffixes smaller than their follower are S-type, others L-type; an S-type after an L-type is a seed. Seeds are sorted first: an
induction over unsorted seeds orders the pieces between them, equal pieces get equal names, and the string of names is
sorted in the same way until no name repeats. From sorted seeds one ascending scan induces all L-type suffixes and one
descending scan all S-type ones.

A scan takes suffixes from a priority queue in order and puts the suffix one place before each back, if the scan is to
sort it. Priorities are first symbols; tuples of one symbol arrive in their final order, so the queue is a list of blocks per
symbol (or range of symbols, in strings of names), whose blocks go to disk when they exceed ``limit`` bytes. Tuples are
(suffix, common prefix with the tuple before of the same symbol); a new tuple's prefix is one more than the least of those
between the two suffixes that it comes from. What stays in memory is the string itself, the type of each suffix and the
blocks of the symbol at hand.

A string ends with a virtual symbol smaller than all others.
"""

from __future__ import annotations

import uuid
from collections import defaultdict

import numpy as np
import pyarrow.fs as pafs

#: Suffixes of a range of names that are sorted at once.
RANGE = 1 << 15
INDEX = np.int32


class Queue:
    """Blocks of (suffix, common prefix) by priority; the blocks go to one file a time below ``folder`` beyond ``limit`` bytes."""

    def __init__(self, folder: str | None = None, limit: int = 64 << 20):
        self.folder, self.limit, self.size = folder, limit, 0
        self.held: dict[int, list] = defaultdict(list)
        self.stored: dict[int, list] = defaultdict(list)
        self.files: list[str] = []

    def push(self, priority: int, suffixes: np.ndarray, prefixes: np.ndarray) -> None:
        self.held[priority].append((suffixes, prefixes))
        self.size += suffixes.nbytes + prefixes.nbytes
        if self.folder and self.size > self.limit:
            self._store()

    def _store(self) -> None:
        fs, root = pafs.FileSystem.from_uri(self.folder)
        path, at = f"{root}/{uuid.uuid4().hex}.queue", 0
        with fs.open_output_stream(path) as out:
            for priority, blocks in self.held.items():
                for s, p in blocks:
                    out.write(s.tobytes())
                    out.write(p.tobytes())
                    self.stored[priority].append((path, at, len(s)))
                    at += s.nbytes + p.nbytes
        self.files.append(path)
        self.held.clear()
        self.size = 0

    def pop(self, priority: int) -> tuple[np.ndarray, np.ndarray]:
        """All tuples of a priority in the order of arrival."""
        blocks = []
        for path, at, n in self.stored.pop(priority, ()):
            fs, _ = pafs.FileSystem.from_uri(self.folder)
            with fs.open_input_file(path) as f:
                data = f.read_at(n * (np.dtype(INDEX).itemsize + 2), at)
            blocks.append((np.frombuffer(data, INDEX, n), np.frombuffer(data, np.uint16, n, n * np.dtype(INDEX).itemsize)))
        held = self.held.pop(priority, [])
        self.size -= sum(s.nbytes + p.nbytes for s, p in held)
        blocks += held
        if not blocks:
            return np.zeros(0, INDEX), np.zeros(0, np.uint16)
        return np.concatenate([b[0] for b in blocks]), np.concatenate([b[1] for b in blocks])

    def close(self) -> None:
        for path in self.files:
            fs, _ = pafs.FileSystem.from_uri(self.folder)
            fs.delete_file(path)
        self.files = []


def types(x: np.ndarray) -> np.ndarray:
    """Whether each suffix is S-type."""
    d = np.full(len(x), -1, np.int8)
    d[:-1] = (x[1:] > x[:-1]).astype(np.int8) - (x[1:] < x[:-1])
    turns = np.flatnonzero(d)
    return np.repeat(d[turns] > 0, np.diff(turns, prepend=-1))


def common(text: np.ndarray, a: np.ndarray, b: np.ndarray, limit: np.ndarray | int) -> np.ndarray:
    """Symbols that the suffixes a[k] and b[k] have in common, ``limit`` at most; eight bytes at a time for bytes."""
    top = int(np.max(limit, initial=0))
    out, live = np.zeros(len(a), np.int64), np.arange(len(a))
    limit = np.broadcast_to(np.asarray(limit, np.int64), (len(a),))
    if text.dtype == np.uint8:
        padded = np.concatenate([text, np.zeros(top + 16, np.uint8)])  # what lies there counts for nothing
        words = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
        while len(live):
            differ = words[a[live] + out[live]] ^ words[b[live] + out[live]]
            same = differ == 0
            out[live] += np.where(same, 8, np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) >> 3)
            live = live[same & (out[live] < limit[live])]
    else:
        while len(live):
            i, j = a[live] + out[live], b[live] + out[live]
            same = (i < len(text)) & (j < len(text)) & (out[live] < limit[live])
            live, i, j = live[same], i[same], j[same]
            live = live[text[i] == text[j]]
            out[live] += 1
    return np.minimum(out, np.minimum(limit, len(text) - np.maximum(a, b)))


def _least(prefixes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One more than the least of the prefixes after at[k - 1] up to at[k], where those ascend; other values are left to the caller."""
    out = np.zeros(len(at), np.int64)
    if len(at) > 1:
        out[1:] = np.minimum.reduceat(np.append(prefixes, prefixes.dtype.type(0)), at + 1)[:-1]
    return out + 1


def induce_bytes(y: np.ndarray, mine: np.ndarray, seeds: np.ndarray, queue: Queue, first: int | None = None, seed_prefix: np.ndarray | None = None, text: np.ndarray | None = None, depth: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes of ``mine`` in the order of y, common prefix of each with the one before of the same symbol).

    ``seeds`` are sorted suffixes that come after those of ``mine`` with the same symbol; prefixes are kept up to ``depth``,
    and not at all for 0."""
    bounds = np.searchsorted(y[seeds], np.arange(257))
    order, prefix = [], []
    if first is not None:
        queue.push(int(y[first]), np.array([first], INDEX), np.zeros(1, np.uint16))
    for c in range(256):
        now, p = queue.pop(c)
        if not len(now) and bounds[c] == bounds[c + 1]:
            continue
        own, own_p, length = [now], [p], 0
        if len(p):
            p = p.copy()
            p[0] = 0
            own_p[0] = p
        while len(now):  # suffixes that begin with a run of the symbol: shorter runs come first
            before = now - 1
            at = np.flatnonzero((before >= 0) & mine[before] & (y[before] == c))
            if not len(at):
                break
            length += 1
            if depth:
                p = np.minimum(_least(p, at), depth).astype(np.uint16)
                p[0] = min(length, depth)
            else:
                p = np.zeros(len(at), np.uint16)
            now = before[at]
            own.append(now)
            own_p.append(p)
        own, own_p, later = np.concatenate(own), np.concatenate(own_p), seeds[bounds[c] : bounds[c + 1]]
        order.append(own)
        prefix.append(own_p)
        scan, p = np.concatenate([own, later]), np.concatenate([own_p, np.zeros(len(later), np.uint16) if seed_prefix is None else seed_prefix[bounds[c] : bounds[c + 1]]])
        if depth and len(later):
            p[len(own)] = common(text, own[-1:], later[:1], depth)[0] if len(own) else 0
        before = scan - 1
        to = y[before]
        at = np.flatnonzero((before >= 0) & mine[before] & (to > c))
        if not len(at):
            continue
        to = to[at]
        by = np.argsort(to, kind="stable")
        at, to = at[by], to[by]
        p = np.minimum(_least(p, at), depth).astype(np.uint16) if depth else np.zeros(len(at), np.uint16)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(to)) + 1])
        p[cuts] = min(1, depth)  # what came before to this symbol follows another symbol
        out = before[at]
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(to)]):
            queue.push(int(to[a]), out[a:b], p[a:b])
    queue.close()
    return (np.concatenate(order), np.concatenate(prefix)) if order else (np.zeros(0, INDEX), np.zeros(0, np.uint16))


def induce_names(y: np.ndarray, mine: np.ndarray, seeds: np.ndarray, symbols: int, queue: Queue, first: int | None = None) -> np.ndarray:
    """As ``induce_bytes`` for names, range by range; no prefixes. Within a range, suffixes whose follower is there too are
    sorted by doubling along their followers."""
    before_symbol = np.concatenate([[0], np.cumsum(np.bincount(y, minlength=symbols))[:-1]])
    ranges = (before_symbol // RANGE).astype(np.int64)
    ranges = np.unique(ranges, return_inverse=True)[1]
    block = ranges[y]
    bounds = np.searchsorted(block[seeds], np.arange(int(ranges[-1]) + 2))
    order = []
    if first is not None:
        queue.push(int(block[first]), np.array([first], INDEX), np.zeros(1, np.uint16))
    for c in range(int(ranges[-1]) + 1):
        known, later = queue.pop(c)[0], seeds[bounds[c] : bounds[c + 1]]
        if not len(known) and not len(later):
            continue
        parts, origin, at, base = [known, later], [], np.concatenate([known, later]), 0
        while True:  # suffixes induced within the range, each with the place of its follower
            before = at - 1
            k = np.flatnonzero((before >= 0) & mine[before] & (block[before] == c))
            if not len(k):
                break
            origin.append(k + base)
            base += len(at)
            at = before[k]
            parts.append(at)
        every = np.concatenate(parts)
        n, inside = len(every), len(known) + len(later)
        kind = np.concatenate([np.zeros(len(known), np.int64), np.full(len(later), 2), np.ones(n - inside, np.int64)])
        key = y[every].astype(np.int64) * 4 + kind
        by = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[by] = np.arange(n)
        if origin:
            follower = np.arange(n)
            follower[inside:] = np.concatenate(origin)
            start = np.flatnonzero(np.concatenate([[True], np.diff(key[by]) != 0]))
            tie = start[np.searchsorted(start, rank, side="right") - 1]
            rank[inside:] = tie[inside:]
            open_ = np.arange(inside, n)
            while True:
                group = rank[open_]
                alone = np.bincount(group, minlength=n)[group] == 1
                open_ = open_[~alone]
                if not len(open_):
                    break
                a, b = rank[open_], rank[follower[open_]]
                o = np.lexsort((b, a))
                a, b = a[o], b[o]
                new = np.concatenate([[True], (np.diff(a) != 0) | (np.diff(b) != 0)])
                group = np.concatenate([[True], np.diff(a) != 0])
                place = np.arange(len(a))
                rank[open_[o]] = a + (place[new] - place[group][np.cumsum(group)[new] - 1])[np.cumsum(new) - 1]
                follower[inside:] = follower[follower[inside:]]
            by = np.argsort(rank, kind="stable")
        scan = every[by]
        order.append(scan[kind[by] != 2])
        before = scan - 1
        to = block[before]
        k = np.flatnonzero((before >= 0) & mine[before] & (to > c))
        if len(k):
            to = to[k]
            o = np.argsort(to, kind="stable")
            out, to = before[k][o].astype(INDEX), to[o]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(to)) + 1])
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(to)]):
                queue.push(int(to[a]), out[a:b], np.zeros(b - a, np.uint16))
    queue.close()
    return np.concatenate(order) if order else np.zeros(0, INDEX)


def _scan(x: np.ndarray, symbols: int, small: np.ndarray, seeds: np.ndarray, queue: dict) -> tuple[np.ndarray, np.ndarray]:
    """(L-type suffixes, S-type suffixes) in ascending order, from seeds in order."""
    if x.dtype == np.uint8:
        large = induce_bytes(x, ~small, seeds, Queue(**queue), len(x) - 1)[0]
        return large, induce_bytes(255 - x, small, large[::-1], Queue(**queue))[0][::-1]
    large = induce_names(x, ~small, seeds, symbols, Queue(**queue), len(x) - 1)
    return large, induce_names(symbols - 1 - x, small, large[::-1], symbols, Queue(**queue))[::-1]


def sorted_seeds(x: np.ndarray, symbols: int, small: np.ndarray, queue: dict) -> np.ndarray:
    """The seeds in the order of their suffixes."""
    seeds = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(INDEX)
    if len(seeds) < 2:
        return seeds
    order = _scan(x, symbols, small, seeds[np.argsort(x[seeds], kind="stable")], queue)[1]
    number = np.full(len(x), -1, INDEX)  # which seed
    number[seeds] = np.arange(len(seeds), dtype=INDEX)
    order = order[number[order] >= 0]
    size = np.diff(seeds, append=len(x)) + 1  # a piece ends with the first symbol of the next; the last one has no equal
    a, b = order[:-1], order[1:]
    sa, sb = size[number[a]], size[number[b]]
    equal = (sa == sb) & (number[a] != len(seeds) - 1) & (number[b] != len(seeds) - 1)
    at = np.flatnonzero(equal)
    equal[at] = common(x, a[at], b[at], sa[at]) >= sa[at]
    names = np.empty(len(seeds), INDEX)
    names[number[order]] = np.concatenate([[0], np.cumsum(~equal)])
    if equal.any():
        return seeds[suffix_order(names, int(names.max()) + 1, queue)]
    return order


def suffix_order(x: np.ndarray, symbols: int, queue: dict | None = None) -> np.ndarray:
    """All suffixes in order."""
    queue = queue or {}
    small = types(x)
    large, little = _scan(x, symbols, small, sorted_seeds(x, symbols, small, queue), queue)
    both = np.concatenate([large, little])
    return both[np.argsort(x[both], kind="stable")]  # of one symbol, L-type ones come first


def repeated(text: np.ndarray, length: int, queue: dict | None = None) -> np.ndarray:
    """Whether the ``length`` bytes from each place on are found from another place on, too."""
    queue, out = queue or {}, np.zeros(len(text), bool)
    if not len(text):
        return out
    small = types(text)
    seeds = sorted_seeds(text, 256, small, queue)
    prefix = np.concatenate([[0], common(text, seeds[:-1], seeds[1:], length)]).astype(np.uint16)[: len(seeds)]
    large, lp = induce_bytes(text, ~small, seeds, Queue(**queue), len(text) - 1, prefix, text, length)
    down = np.concatenate([[0], lp[:0:-1]]).astype(np.uint16)[: len(large)]
    little, sp = induce_bytes(255 - text, small, large[::-1], Queue(**queue), None, down, text, length)
    for order, p in ((large, lp), (little, sp)):
        at = np.flatnonzero(p >= length)
        out[order[at]] = out[order[at - 1]] = True
    little = little[::-1]
    last = np.searchsorted(text[large], np.arange(256), side="right") - 1  # the last L-type beside the first S-type of a symbol
    head = np.searchsorted(text[little], np.arange(256), side="left")
    for c in range(256):
        if last[c] >= 0 and head[c] < len(little) and text[large[last[c]]] == c == text[little[head[c]]]:
            pair = np.array([large[last[c]], little[head[c]]])
            if common(text, pair[:1], pair[1:], length)[0] >= length:
                out[pair] = True
    return out
