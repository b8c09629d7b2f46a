"""External suffix sorting by recursive induction, with common-prefix values.

Text, types, orders and queues lie in files of a task's scratch folder and are worked on in batches; memory holds a bounded number of tuples. A tuple
(symbol, position, prefix) stands for a suffix and what it has in common with the tuple of the same symbol before it: a suffix that is brought by its
successor has one symbol more in common with its neighbour than the successors have, the least of all prefixes between them.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np

#: Tuples that the queues hold in memory, and suffixes that are worked on at once.
IN_MEMORY, BATCH = 1 << 18, 1 << 16
#: A symbol that follows itself so often has a range of its own.
LONG_RUN = 64
#: Larger than any common prefix.
ENDLESS = 1 << 30
#: Bytes of a position, symbol or prefix; a text has fewer than 2**31 symbols.
WORD = np.int32


class Disk:
    """Scratch files of one sort, and the bounds of what is in memory."""

    def __init__(self, folder: str, bound: int = IN_MEMORY, batch: int = BATCH):
        self.folder, self.bound, self.batch, self.n, self.spilled = folder, bound, batch, 0, 0

    def name(self) -> str:
        self.n += 1
        return f"{self.folder}/{self.n}"

    def array(self, dtype, *shape: int) -> np.ndarray:
        """An array in a file, zero at first; the file goes with its last view."""
        path = self.name()
        made = np.memmap(path, dtype, "w+", shape=tuple(max(1, s) for s in shape))
        os.remove(path)
        return made.view(np.ndarray)[: shape[0]]

    def parts(self, n: int) -> Iterator[tuple[int, int]]:
        for a in range(0, n, self.batch):
            yield a, min(n, a + self.batch)


class Queues:
    """First-in-first-out queues of tuples, one for each range of symbols: together a priority queue, for ranges are taken in rising order.

    What is in memory beyond the bound goes to one file a queue.
    """

    def __init__(self, disk: Disk, n: int):
        self.disk, self.parts, self.files, self.held = disk, [[] for _ in range(n)], [None] * n, 0

    def push(self, q: int, tuples: np.ndarray) -> None:
        self.parts[q].append(tuples.astype(WORD, copy=False))
        self.held += len(tuples)
        if self.held > self.disk.bound:
            for i, parts in enumerate(self.parts):
                if parts:
                    self.files[i] = self.files[i] or self.disk.name()
                    with open(self.files[i], "ab") as f:
                        np.concatenate(parts).tofile(f)
                    self.parts[i] = []
            self.disk.spilled += self.held
            self.held = 0

    def pop(self, q: int) -> Iterator[np.ndarray]:
        """The queue's tuples in batches; they leave it."""
        if self.files[q]:
            with open(self.files[q], "rb") as f:
                while len(part := np.fromfile(f, WORD, 3 * self.disk.batch)):
                    yield part.reshape(-1, 3).astype(np.int64)
            os.remove(self.files[q])
            self.files[q] = None
        parts, self.parts[q] = self.parts[q], []
        self.held -= sum(map(len, parts))
        for part in parts:
            for a in range(0, len(part), self.disk.batch):
                yield part[a : a + self.disk.batch].astype(np.int64)


class Tuples:
    """Tuples in a file, in their order or turned round; a turned tuple's prefix is what it has in common with the one that now stands before it."""

    def __init__(self, rows: np.ndarray, turned: bool):
        self.rows, self.turned = rows, turned

    def __len__(self) -> int:
        return len(self.rows)

    def symbol(self, at: np.ndarray) -> np.ndarray:
        return self.rows[len(self.rows) - 1 - at if self.turned else at, 0].astype(np.int64)

    def part(self, a: int, b: int) -> np.ndarray:
        if not self.turned:
            return self.rows[a:b].astype(np.int64)
        n = len(self.rows)
        out = self.rows[n - b : n - a][::-1].astype(np.int64)
        at = n - np.arange(a, b)
        out[:, 2] = np.where(at < n, self.rows[np.minimum(at, n - 1), 2], 0)
        return out

    def count(self, before) -> np.ndarray:
        """How many of the first tuples have symbols of which ``before(symbols)`` is true: it is for none after them."""
        low = np.zeros(before(None), np.int64)
        high = np.full(len(low), len(self))
        while (low < high).any():
            middle = np.minimum((low + high) // 2, max(0, len(self) - 1))
            go = (low < high) & before(self.symbol(middle))
            low, high = np.where(go, middle + 1, low), np.where(go | (low >= high), high, middle)
        return low


class Minima:
    """Least values of ranges of an array."""

    def __init__(self, v: np.ndarray):
        self.levels = np.empty((max(1, len(v)).bit_length(), max(1, len(v))), np.int64)
        self.levels[0, : len(v)] = v
        for k in range(1, len(self.levels)):
            span = 1 << (k - 1)
            n = len(v) - 2 * span + 1
            np.minimum(self.levels[k - 1, :n], self.levels[k - 1, span : span + n], out=self.levels[k, :n])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """min(v[a:b]); ENDLESS where that is empty."""
        some = b > a
        level = np.frexp(np.where(some, b - a, 1).astype(float))[1] - 1
        first = np.where(some, a, 0)
        last = np.where(some, b - (1 << level), 0)
        return np.where(some, np.minimum(self.levels[level, first], self.levels[level, last]), ENDLESS)


def common(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int = ENDLESS) -> np.ndarray:
    """Symbols that the suffixes at a and b have in common, compared one after another."""
    n, out, alive, width = len(text), np.zeros(len(a), np.int64), np.arange(len(a)), 4
    while len(alive):
        x, y = (p[alive, None] + out[alive, None] + np.arange(width) for p in (a, b))
        same = (text[np.minimum(x, n - 1)] == text[np.minimum(y, n - 1)]) & (x < n) & (y < n)
        more = np.where(same.all(1), width, same.argmin(1))
        out[alive] += more
        alive = alive[(more == width) & (out[alive] < cap)]
        width = min(64, 2 * width)
    return np.minimum(out, cap)


def _types(text: np.ndarray, disk: Disk) -> tuple[np.ndarray, np.ndarray]:
    """Is a suffix smaller than the next one? And how often does its first symbol stand just before it?"""
    n = len(text)
    small, run = disk.array(bool, n), disk.array(np.int32, n)
    follows, next_ = False, -1  # of the suffix after the part; the end is smaller than any symbol
    for a, b in reversed(list(disk.parts(n))):
        t = text[a:b].astype(np.int64)
        after = np.append(t[1:], next_)
        differs = np.flatnonzero(t != after)
        at = np.searchsorted(differs, np.arange(b - a))
        own = np.append(t[differs] < after[differs], follows)
        small[a:b] = own[at]
        follows, next_ = bool(small[a]), int(t[0])
    last, count = -1, 0
    for a, b in disk.parts(n):
        t = text[a:b].astype(np.int64)
        fresh = t != np.append(last, t[:-1])
        head = np.maximum.accumulate(np.where(fresh, np.arange(b - a), -count - 1 if not fresh[0] else 0))
        run[a:b] = np.arange(b - a) - head
        last, count = int(t[-1]), int(run[b - 1])
    return small, run


def _packed(typed, start, length, depth: int, width: int, bits: int) -> np.ndarray:
    """The substrings' symbols with their types from ``depth`` on in one number; zero after a substring's end."""
    out = np.zeros(len(start), np.int64)
    for k in range(depth, depth + width):
        out <<= bits
        out |= typed[np.where(k < length, start + k, len(typed) - 1)]
    return out


def names(text: np.ndarray, small: np.ndarray, star: np.ndarray, disk: Disk) -> tuple[np.ndarray, int]:
    """Order-keeping names of the substrings, of symbols with their types, from each star to the next, both included; and how many names there are.

    Substrings are dealt to files by their next symbols until a file fits into memory.
    """
    top = max(int(text[a:b].max()) for a, b in disk.parts(len(text)))
    bits = (2 * top + 2).bit_length()
    width = max(1, 62 // bits)
    name, used = disk.array(np.int32, len(star)), 0
    typed = disk.array(np.int64 if bits > 31 else WORD, len(text) + 1)  # the last one stays zero
    for a, b in disk.parts(len(text)):
        typed[a:b] = text[a:b].astype(np.int64) * 2 + small[a:b] + 1

    def of(index):
        start = star[index].astype(np.int64)
        return start, np.where(index + 1 < len(star), star[np.minimum(index + 1, len(star) - 1)] + 1, len(text)) - start

    def settle(index: np.ndarray, depth: int) -> None:
        nonlocal used
        start, length = of(index)
        group, todo = np.zeros(len(index), np.int64), np.arange(len(index))
        while len(todo):  # groups count the smaller ones; only ties that go on are looked at again
            key = _packed(typed, start[todo], length[todo], depth, width, bits)
            by = np.lexsort((key, group[todo])) if group.any() else np.argsort(key)
            g, k, todo = group[todo[by]], key[by], todo[by]
            first = np.append(True, g[1:] != g[:-1])
            fresh = first | np.append(True, k[1:] != k[:-1])
            place = np.arange(len(by))
            group[todo] = g + np.maximum.accumulate(np.where(fresh, place, 0)) - np.maximum.accumulate(np.where(first, place, 0))
            depth += width
            head = np.flatnonzero(fresh)
            size = np.diff(np.append(head, len(by)))
            going = (size > 1) & (np.maximum.reduceat(length[todo], head) > depth)
            todo = todo[np.repeat(going, size)]
        values, dense = np.unique(group, return_inverse=True)
        name[index] = used + dense
        used += len(values)

    def deal(queue: Queues, q: int, n: int, depth: int) -> None:
        nonlocal used
        if n <= disk.bound:
            parts = [p[:, 0] for p in queue.pop(q)]
            if parts:
                settle(np.concatenate(parts), depth)
            return
        keys, ends = disk.array(np.int64, n, 3), 0
        for part in queue.pop(q):
            start, length = of(part[:, 0])
            keys[ends : ends + len(part)] = np.column_stack([_packed(typed, start, length, depth, width, bits), part[:, 0], length])
            ends += len(part)
        cut = np.unique(keys[:: max(1, n // 64), 0])
        lower, size, going = Queues(disk, 2 * len(cut) + 1), np.zeros(2 * len(cut) + 1, np.int64), np.zeros(2 * len(cut) + 1, bool)
        for a, b in disk.parts(n):
            key, index, length = keys[a:b].T
            into = np.searchsorted(cut, key, "left") + np.searchsorted(cut, key, "right")
            by = np.argsort(into, kind="stable")
            into, index, longer = into[by], index[by], length[by] > depth + width
            head = np.flatnonzero(np.append(True, into[1:] != into[:-1]))
            for i, x, y in zip(into[head].tolist(), head.tolist(), np.append(head[1:], len(into)).tolist(), strict=True):
                lower.push(i, np.column_stack([index[x:y]] * 3))
                size[i] += y - x
                going[i] |= bool(longer[x:y].any())
        for i in range(len(size)):
            if i % 2 == 0 or going[i]:
                deal(lower, i, int(size[i]), depth + width * (i % 2))
            elif size[i]:  # one key, and nothing after it
                for part in lower.pop(i):
                    name[part[:, 0]] = used
                used += 1

    every = Queues(disk, 1)
    for a, b in disk.parts(len(star)):
        index = np.arange(a, b)
        every.push(0, np.column_stack([index, index, index]))
    deal(every, 0, len(star), 0)
    return name, used


class Induction:
    """One pass over the suffixes in rising order of their symbols, which brings all suffixes of one type from sorted seeds of the other.

    A suffix taken from its queue, or a seed, brings the suffix before it if that is of the wanted type. Of suffixes with equal first symbol the induced ones
    come first, in the order of those that brought them, then the seeds. The pass that goes down in the text's order counts symbols from the top.
    """

    def __init__(self, text, small, run, kind: bool, seeds: Tuples, disk: Disk, cap: int):
        self.text, self.small, self.run, self.kind, self.seeds, self.disk, self.cap = text, small, run, kind, seeds, disk, cap
        self.top = max(int(text[a:b].max()) for a, b in disk.parts(len(text)))
        self.ends, self.lone = self._ranges()
        self.queues = Queues(disk, len(self.ends))
        # for each symbol: the batch of its last tuple, and the least prefix from there to that batch's end
        self.last, self.carry = disk.array(WORD, self.top + 1), disk.array(WORD, self.top + 1)
        self.turn, self.since = 1, np.full(1024, ENDLESS, np.int64)  # since: least prefix of all batches from one on; batch 0 is the end of the text
        wanted = sum(int((small[a:b] == kind).sum()) for a, b in disk.parts(len(text)))
        self.out, self.n_out = disk.array(WORD, wanted, 3), 0

    def key(self, pos: np.ndarray) -> np.ndarray:
        s = self.text[pos].astype(np.int64)
        return self.top - s if self.kind else s

    def _ranges(self) -> tuple[np.ndarray, np.ndarray]:
        """Ends of ranges of symbols of about half a batch each, and which hold one symbol only."""
        count, own = self.disk.array(WORD, self.top + 1), self.disk.array(bool, self.top + 1)
        for a, b in self.disk.parts(len(self.text)):
            s, c = np.unique(self.key(np.arange(a, b)), return_counts=True)
            count[s] += c
            own[self.key(a + np.flatnonzero(self.run[a:b] == LONG_RUN))] = True
        room = max(1, self.disk.batch // 2)
        ends, lone = [], []
        for a, b in self.disk.parts(self.top + 1):
            c, alone = count[a:b], own[a:b] | (count[a:b] > room)
            part = np.cumsum(np.where(alone, 0, c)) // room
            cut = np.append((part[1:] != part[:-1]) | alone[1:] | alone[:-1], True)
            ends.append(a + np.flatnonzero(cut) + 1)
            lone.append(np.diff(np.append(a, ends[-1])) == 1)
        return np.concatenate(ends), np.concatenate(lone)

    def _since(self, symbol: np.ndarray) -> np.ndarray:
        """The least prefix since each symbol's last tuple, up to this batch; -1: there is no such tuple."""
        last = self.last[symbol].astype(np.int64) - 1
        return np.where(last < 0, -1, np.minimum(self.carry[symbol], self.since[np.maximum(last, 0) + 1]))

    def _take(self, pos: np.ndarray, prefix: np.ndarray, above: int, emit: np.ndarray | bool = True) -> None:
        """Suffixes in order: the wanted ones go out, and those before them, if their symbol is ``above`` or more, to their queues."""
        if not len(pos):
            return
        if emit is not False:
            p, v = (pos, prefix) if emit is True else (pos[emit], prefix[emit])
            self.out[self.n_out : self.n_out + len(p)] = np.column_stack([self.text[p], p, v])
            self.n_out += len(p)
        rank = np.flatnonzero(pos > 0)
        before = pos[rank] - 1
        symbol = self.key(before)
        use = (self.small[before] == self.kind) & (symbol >= above)
        rank, before, symbol = rank[use], before[use], symbol[use]
        if len(rank):
            by = np.argsort(symbol, kind="stable")
            rank, before, symbol = rank[by], before[by], symbol[by]
            fresh = np.append(True, symbol[1:] != symbol[:-1])
            least = Minima(prefix)
            found = least.of(np.where(fresh, 0, np.append(0, rank[:-1]) + 1), rank + 1)
            head = np.flatnonzero(fresh)
            tail = np.append(head[1:], len(rank)) - 1
            found[head] = np.minimum(found[head], self._since(symbol[head]))
            self.carry[symbol[head]] = least.of(rank[tail] + 1, np.full(len(tail), len(pos)))
            self.last[symbol[head]] = self.turn + 1
            self._push(np.column_stack([symbol, before, np.minimum(self.cap, found + 1)]))
        self.since[: self.turn + 1] = np.minimum(self.since[: self.turn + 1], prefix.min())
        self.turn += 1
        if self.turn + 2 > len(self.since):
            self.since = np.append(self.since, np.full(len(self.since), ENDLESS))

    def _push(self, tuples: np.ndarray) -> None:
        into = np.searchsorted(self.ends, tuples[:, 0], "right")
        cut = np.flatnonzero(np.append(True, into[1:] != into[:-1]))
        for a, b in zip(cut.tolist(), np.append(cut[1:], len(into)).tolist(), strict=True):
            self.queues.push(int(into[a]), tuples[a:b])

    def run_through(self, first: int | None) -> np.ndarray:
        """All wanted suffixes in order: (text's symbol, position, prefix). ``first`` is a wanted suffix that nothing brings."""
        if first is not None:
            symbol = self.key(np.array([first]))
            self._push(np.column_stack([symbol, [first], [0]]))
            self.last[symbol], self.carry[symbol] = 1, 0
        at = 0
        for r, end in enumerate(self.ends.tolist()):
            upto = self._seeds_to(at, end)
            (self._one if self.lone[r] else self._several)(r, end, at, upto)
            at = upto
        return self.out[: self.n_out]

    def _seeds_to(self, at: int, end: int) -> int:
        """Where the seeds of symbols from ``end`` on begin."""
        low, high = at, len(self.seeds)
        while low < high:
            middle = (low + high) // 2
            symbol = int(self.seeds.symbol(middle))
            if (self.top - symbol if self.kind else symbol) < end:
                low = middle + 1
            else:
                high = middle
        return low

    def _one(self, r: int, end: int, at: int, upto: int) -> None:
        """A range of one symbol: its tuples as they came; then those before them with the same symbol, once more for each repetition; then the seeds."""
        batch, final, later, carry = self.disk.batch, None, Queues(self.disk, 1), ENDLESS
        n_later = 0
        for part in self.queues.pop(r):
            pos, prefix = part[:, 1], part[:, 2]
            self._take(pos, prefix, end)
            final = int(pos[-1])
            more, carry = self._survivors(pos, self.run[pos].astype(np.int64), prefix, 0, carry)
            later.push(0, more)
            n_later += len(more)
        level = 0
        while n_later > batch:  # level by level, from file to file
            level, again, carry, n_again, head = level + 1, Queues(self.disk, 1), ENDLESS, 0, True
            for part in later.pop(0):
                pos, times, prefix = part.T
                value = np.minimum(self.cap, prefix + level)
                if head:
                    value[0], head = min(level, self.cap), False
                self._take(pos - level, value, end)
                final = int(pos[-1]) - level
                more, carry = self._survivors(pos, times, prefix, level, carry)
                again.push(0, more)
                n_again += len(more)
            later, n_later = again, n_again
        rest = list(later.pop(0))
        pos, times, prefix = np.concatenate(rest).T if rest else np.zeros((3, 0), np.int64)
        while len(pos):  # few enough: many levels at once
            left, least = times - level, Minima(prefix)
            low, high = 1, int(left.max())
            while low < high:
                middle = (low + high + 1) // 2
                low, high = (middle, high) if np.minimum(left, middle).sum() <= batch else (low, middle - 1)
            n = np.minimum(left, low)
            index = np.repeat(np.arange(len(pos)), n)
            up = np.arange(len(index)) - np.repeat(np.cumsum(n) - n, n) + 1
            by = np.argsort(up, kind="stable")
            index, up = index[by], up[by]
            head = np.append(True, up[1:] != up[:-1])
            value = least.of(np.where(head, 0, np.append(0, index[:-1]) + 1), index + 1)
            value = np.where(head, 0, value) + level + up
            self._take(pos[index] - level - up, np.minimum(self.cap, value), end)
            final = int(pos[index[-1]] - level - up[-1])
            level += low
            more, _ = self._survivors(pos, times, prefix, level, ENDLESS)
            pos, times, prefix = more.T
        for a in range(at, upto, batch):
            part = self.seeds.part(a, min(upto, a + batch))
            if a == at:
                part[0, 2] = 0 if final is None else common(self.text, np.array([final]), part[:1, 1], self.cap)[0]
            self._take(part[:, 1], part[:, 2], end, False)

    @staticmethod
    def _survivors(pos, times, prefix, level: int, carry: int) -> tuple[np.ndarray, int]:
        """Tuples whose symbol stands before them once more, with the least prefix since the one before; and the least prefix after the last."""
        kept = np.flatnonzero(times > level)
        if not len(kept):
            return np.zeros((0, 3), np.int64), min(carry, int(prefix.min()))
        value = np.minimum.reduceat(prefix[: kept[-1] + 1], np.append(0, kept[:-1] + 1))
        value[0] = min(carry, value[0])
        after = prefix[kept[-1] + 1 :]
        return np.column_stack([pos[kept], times[kept], value]), int(after.min()) if len(after) else ENDLESS

    def _several(self, r: int, end: int, at: int, upto: int) -> None:
        """A range of several symbols, all in memory: suffixes that are brought inside the range are found step by step and placed by doubling."""
        known = np.concatenate([*self.queues.pop(r), np.zeros((0, 3), np.int64)])
        own = self.seeds.part(at, upto)
        pos, kind, source = [known[:, 1], own[:, 1]], [np.zeros(len(known), np.int64), np.full(len(own), 2)], [np.arange(len(known)), np.arange(len(own))]
        n, total, frontier = 0, len(known) + len(own), np.concatenate(pos)
        while len(frontier):
            before = np.maximum(frontier - 1, 0)
            inside = (frontier > 0) & (self.small[before] == self.kind) & (self.key(before) < end)
            source.append(np.flatnonzero(inside) + n)
            n, frontier = total, before[inside]
            total += len(frontier)
            pos.append(frontier)
            kind.append(np.ones(len(frontier), np.int64))
        pos, kind, source = np.concatenate(pos), np.concatenate(kind), np.concatenate(source)
        if not len(pos):
            return
        symbol, made = self.key(pos), kind == 1
        # tuples and seeds have their order; what was brought inside compares by symbol, then by its source: ranks are doubled along the sources
        dense = np.unique(symbol, return_inverse=True)[1].astype(np.int64)
        rank = np.unique(((dense * 3 + kind) << 31) | np.where(made, 0, source), return_inverse=True)[1]
        jump = np.where(made, source, np.arange(len(source)))
        while rank.max() + 1 < len(rank):
            rank = np.unique((rank << 31) | rank[jump], return_inverse=True)[1]
            jump = jump[jump]
        order = np.empty(len(rank), np.int64)
        order[rank] = np.arange(len(rank))
        given = np.concatenate([known[:, 2], own[:, 2], np.zeros(int(made.sum()), np.int64)])[order]
        pos, kind, symbol, made, source = pos[order], kind[order], symbol[order], made[order], rank[source[order] * made[order]]
        same, prev = np.append(False, symbol[1:] == symbol[:-1]), np.append(0, kind[:-1])
        value = np.where(same | (kind == 0), given, 0)
        border = np.flatnonzero(same & (kind == 2) & (prev != 2))
        value[border] = common(self.text, pos[border - 1], pos[border], self.cap)
        todo = np.flatnonzero(made & same)
        start = np.where(prev[todo] == 1, source[todo - 1] + 1, 0)
        outer = np.where(prev[todo] == 1, ENDLESS, self._since(symbol[todo]))
        value[todo] = self.cap
        while len(todo):  # prefixes inside the range rest on each other; from above they come down to what they are
            new = np.minimum(self.cap, 1 + np.minimum(outer, Minima(value).of(start, source[todo] + 1)))
            if (new == value[todo]).all():
                break
            value[todo] = new
        self._take(pos, value, end, kind < 2)


def suffix_order(text: np.ndarray, disk: Disk, cap: int = ENDLESS) -> np.ndarray:
    """(position, prefix) of all suffixes of a text of non-negative integers in lexicographic order, the end being smaller than any symbol.

    The prefix is what a suffix has in common with the one before it, ``cap`` at most.
    """
    n = len(text)
    if n < 2:
        return np.zeros((n, 2), np.int64)
    small, run = _types(text, disk)
    is_star = disk.array(bool, n)
    for a, b in disk.parts(n):
        is_star[a:b] = small[a:b] & ~np.append(True if a == 0 else small[a - 1], small[a : b - 1])
    star, end = disk.array(WORD, sum(int(is_star[a:b].sum()) for a, b in disk.parts(n))), 0
    for a, b in disk.parts(n):
        found = a + np.flatnonzero(is_star[a:b])
        star[end : end + len(found)] = found
        end += len(found)
    seeds = disk.array(WORD, len(star), 3)
    if len(star):
        name, different = names(text, small, star, disk)
        if different == len(star):
            lower = disk.array(WORD, len(star), 2)
            for a, b in disk.parts(len(star)):
                lower[name[a:b], 0] = np.arange(a, b)
        else:
            lower = suffix_order(name, disk)
        last = None
        for a, b in disk.parts(len(star)):
            index, shared = lower[a:b].astype(np.int64).T
            pair = np.append(last if a else index[0], index[:-1])
            pos = star[index].astype(np.int64)
            skip = star[index + shared] - pos
            prefix = np.minimum(cap, skip)
            far = np.flatnonzero(prefix < cap)
            prefix[far] += common(text, pos[far] + skip[far], star[pair[far]] + skip[far], cap)
            prefix = np.minimum(prefix, cap)
            if a == 0:
                prefix[0] = 0
            seeds[a:b] = np.column_stack([text[pos], pos, prefix])
            last = index[-1]
        del name, lower
    del star, is_star
    large = Induction(text, small, run, False, Tuples(seeds, False), disk, cap).run_through(n - 1)
    del seeds
    down = Induction(text, small, run, True, Tuples(large, True), disk, cap).run_through(None)
    return _merged(text, large, down, disk, cap)


def _merged(text, large, down, disk: Disk, cap: int) -> np.ndarray:
    """Of each symbol first the larger suffixes, in rising order, then the smaller ones, which come in falling order."""
    out, rising, up = disk.array(WORD, len(large) + len(down), 2), Tuples(large, False), Tuples(down, True)

    def before(tuples, values, equal):
        return tuples.count(lambda s: len(values) if s is None else (s <= values) if equal else s < values)

    for a, b in disk.parts(len(large)):
        part = rising.part(a, b)
        values, back = np.unique(part[:, 0], return_inverse=True)
        out[np.arange(a, b) + before(up, values, False)[back]] = part[:, 1:]
    last = -1
    for a, b in disk.parts(len(down)):
        part = up.part(a, b)
        values, back = np.unique(part[:, 0], return_inverse=True)
        over, under = before(rising, values, True)[back], before(rising, values, False)[back]
        head = np.flatnonzero(part[:, 0] != np.append(last, part[:-1, 0]))
        part[head, 2], last = 0, part[-1, 0]
        head = head[over[head] > under[head]]
        part[head, 2] = common(text, large[over[head] - 1, 1].astype(np.int64), part[head, 1], cap)
        out[np.arange(a, b) + over] = part[:, 1:]
    return out


def repeated_starts(text: np.ndarray, starts: np.ndarray, length: int, bound: int | None = None, batch: int | None = None) -> np.ndarray:
    """Which positions of a text of pieces, ended by zero symbols before the next of ``starts``, begin ``length`` symbols that also begin elsewhere?

    Other symbols are not zero, so equal ``length`` symbols within a piece are never across an end; neighbours in the order that have so many in common mark each other.
    """
    scratch = tempfile.mkdtemp(prefix="folio-sort-")
    try:
        disk = Disk(scratch, bound or IN_MEMORY, batch or BATCH)
        order = suffix_order(text, disk, length)
        hit, last = disk.array(bool, len(text)), 0
        for a, b in disk.parts(len(order)):
            pos, prefix = order[a:b].astype(np.int64).T
            same = prefix >= length
            hit[pos[same]] = True
            hit[np.append(last, pos[:-1])[same]] = True
            last = int(pos[-1])
        for a, b in disk.parts(len(text)):
            at = np.arange(a, b)
            end = np.append(starts[1:], len(text))[np.searchsorted(starts, at, "right") - 1] - 1
            hit[a:b] &= at + length <= end
        return np.array(hit)
    finally:
        shutil.rmtree(scratch, ignore_errors=True)
