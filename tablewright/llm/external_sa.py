"""External induced sorting: suffix array and capped common prefixes of a text on disk.

Suffixes are sorted by induction from the left-most smaller suffixes (S*): their substrings are sorted by inducing once,
named, and the string of names is sorted in turn, by the same induction while its alphabet is small and by doubling sorted
on disk in ranges otherwise. A second induction carries (position, common prefix) tuples through priority queues. Induction
asks its queues for the smallest symbol first and, within a symbol, for the earliest arrival, so a queue is a first-in
first-out spool for each symbol; together the spools hold up to HOLD entries in memory, and the rest on disk. Whatever is as long
as the text, or as its S* positions, is a scratch array: a memory map in a scratch folder if it is over KEEP bytes. It is read and
written in steps of STEP, so memory is bounded by HOLD, STEP and KEEP, not by the text.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

#: Entries that the spools of a queue hold in memory (a put counts as PUT more); entries handled at a time; the largest alphabet
#: that is induced rather than doubled; the least run of a symbol that is handled at once.
HOLD, PUT, STEP, ALPHABET, RUN = 1 << 21, 12, 1 << 19, 2048, 8
#: Bytes of an array that is kept in memory; a larger one is a memory map.
KEEP = 16 << 20
ENTRY = np.dtype([("pos", "<i8"), ("lcp", "<u2")])


def scratch(folder: str, name: str, kind: type, n: int) -> np.ndarray:
    """Zeros, in memory or in a file of the folder."""
    if n * np.dtype(kind).itemsize <= KEEP:
        return np.zeros(n, kind)
    return np.memmap(f"{folder}/{name}", kind, "w+", shape=(n,))


class Spool:
    """A first-in first-out queue of entries, in memory until flush() puts them on disk."""

    def __init__(self, path: str) -> None:
        self.path, self.on_disk, self.taken = path, 0, 0
        self.held: list[np.ndarray] = []
        self.n_held = 0

    def put(self, entries: np.ndarray) -> None:
        self.held.append(entries)
        self.n_held += len(entries)

    def flush(self) -> None:
        if self.n_held:
            with open(self.path, "ab") as file:
                for x in self.held:
                    file.write(x.tobytes())
        self.on_disk += self.n_held
        self.held, self.n_held = [], 0

    def __len__(self) -> int:
        return self.on_disk + self.n_held - self.taken

    def _read(self, a: int, b: int) -> np.ndarray:
        with open(self.path, "rb") as file:
            file.seek(a * ENTRY.itemsize)
            return np.frombuffer(file.read((b - a) * ENTRY.itemsize), ENTRY)

    def take(self) -> np.ndarray:
        """The next entries; they leave the queue's front but stay readable by slices()."""
        if self.taken < self.on_disk:
            got = self._read(self.taken, min(self.taken + STEP, self.on_disk))
        else:
            if len(self.held) > 1:
                self.held = [np.concatenate(self.held)]
            got = self.held[0][self.taken - self.on_disk :]
        self.taken += len(got)
        return got

    def slices(self, backwards: bool = False) -> Iterator[np.ndarray]:
        """All entries ever put, in order or from the last to the first."""
        total = self.on_disk + self.n_held
        cuts = [(a, min(a + STEP, self.on_disk)) for a in range(0, self.on_disk, STEP)]
        cuts += [(self.on_disk, total)] if self.n_held else []
        for a, b in reversed(cuts) if backwards else cuts:
            got = self._read(a, b) if a < self.on_disk else np.concatenate(self.held)
            yield got[::-1] if backwards else got

    def drop(self) -> None:
        self.held, self.n_held = [], 0
        if self.on_disk:
            os.unlink(self.path)
            self.on_disk = 0


class _Queues:
    """A spool for each symbol, and the smallest common prefix seen since its last arrival."""

    def __init__(self, folder: str, name: str, symbols: int, cap: int) -> None:
        self.spools = [Spool(f"{folder}/{name}-{c}") for c in range(symbols)]
        self.least = np.full(symbols, -1, np.int64)  # -1: nothing has arrived
        self.cap = cap
        self.held = 0

    def put(self, c: int, entries: np.ndarray) -> None:
        self.spools[c].put(entries)
        self.held += len(entries) + PUT
        if self.held > HOLD:
            for spool in self.spools:
                spool.flush()
            self.held = 0

    def induce(self, symbols: np.ndarray, pos: np.ndarray, go: np.ndarray, lcp: np.ndarray) -> None:
        """Entries popped in order, with the common prefix of each and the one popped before it; those that go put pos
        into the spool of their symbol."""
        at = np.flatnonzero(go)
        low = int(lcp.min()) if len(lcp) else self.cap
        if not len(at):
            self.least = np.where(self.least >= 0, np.minimum(self.least, low), -1)
            return
        met = symbols[at]
        order = np.argsort(met, kind="stable")
        at, met = at[order], met[order]
        cuts = np.flatnonzero(np.diff(met, prepend=-1))
        ends = [*cuts[1:].tolist(), len(met)]
        before = self.least.copy()
        self.least = np.where(self.least >= 0, np.minimum(self.least, low), -1)
        for a, b in zip(cuts.tolist(), ends, strict=True):
            c, own = int(met[a]), at[a:b]
            out = np.empty(b - a, ENTRY)
            out["pos"] = pos[own]
            mins = np.empty(b - a, np.int64)
            mins[0] = min(before[c], lcp[: own[0] + 1].min()) + 1 if before[c] >= 0 else 0
            if b - a > 1:
                mins[1:] = np.minimum.reduceat(lcp[: own[-1] + 1], own[:-1] + 1) + 1
            out["lcp"] = np.minimum(mins, self.cap)
            self.put(c, out)
            rest = lcp[own[-1] + 1 :]
            self.least[c] = rest.min() if len(rest) else self.cap


def _run(text: np.ndarray, i: int, cap: int) -> int:
    """How often the symbol at i repeats."""
    some = np.asarray(text[i : i + cap + 1])
    other = np.flatnonzero(some != some[0])
    return int(other[0]) if len(other) else len(some)


def _join(text: np.ndarray, a: int, b: int, cap: int) -> int:
    """Common prefix of the last L and the first S suffix of a symbol."""
    return min(_run(text, a, cap), _run(text, b, cap), cap)


def _sorted_by_induction(text: np.ndarray, symbols: int, stars: np.ndarray, prefixes: np.ndarray, cap: int, folder: str, level: str) -> tuple[list[Spool], list[Spool]]:
    """Spools of L suffixes (ascending) and S suffixes (descending) for each symbol, from S* positions in order."""
    big = _Queues(folder, f"{level}-L", symbols, cap)
    at = np.concatenate([[0], np.cumsum(_symbols(text, stars, symbols))])

    def pop(queues: _Queues, entries_pos: np.ndarray, lcp: np.ndarray, c: int, test) -> None:
        before = entries_pos - 1
        prev = np.asarray(text[np.maximum(before, 0)]).astype(np.int64)
        queues.induce(prev, before, (before >= 0) & test(prev, c), lcp)

    def runs(queues: _Queues, got: np.ndarray, c: int) -> np.ndarray:
        """Where all that is in a symbol's spool stands in runs of the symbol, its rounds repeat: each puts the places one to the
        left, with common prefixes one longer. They are made at once; the last round is returned to be popped as usual."""
        spool = queues.spools[c]
        if len(spool) or len(got) > 256:
            return got
        reach = np.minimum(got["pos"].min(), STEP // (4 * len(got)))
        if reach < RUN or (np.asarray(text[got["pos"] - RUN]) != c).any():
            return got
        left = np.asarray(text[got["pos"][:, None] - np.arange(1, reach + 1)]) == c
        rounds = int(np.where(left.all(axis=1), reach, left.argmin(axis=1)).min())
        if rounds < RUN:
            return got
        first = got["lcp"].astype(np.int64)
        low = int(first.min())
        if queues.least[c] >= 0:
            first[0] = min(int(queues.least[c]), int(first[0]))
        else:
            first[0] = -1
        out = np.empty((rounds, len(got)), ENTRY)
        out["pos"] = got["pos"] - np.arange(1, rounds + 1)[:, None]
        out["lcp"] = np.minimum(first + np.arange(1, rounds + 1)[:, None], queues.cap)
        queues.least = np.where(queues.least >= 0, np.minimum(queues.least, min(low, int(out["lcp"].min()))), -1)
        queues.least[c] = queues.cap
        queues.put(c, out.ravel())
        spool.taken += out.size
        return out[-1]

    for c in range(symbols):
        spool, last = big.spools[c], -1
        while len(spool):
            got = runs(big, spool.take(), c)
            pop(big, got["pos"], got["lcp"].astype(np.int64), c, np.greater_equal)
            last = int(got["pos"][-1])
        a, b = int(at[c]), int(at[c + 1])
        for x in range(a, b, STEP):
            pos, lcp = np.asarray(stars[x : min(b, x + STEP)]), np.asarray(prefixes[x : min(b, x + STEP)]).astype(np.int64)
            if x == a:
                lcp = lcp.copy()
                lcp[0] = _join(text, last, int(pos[0]), cap) if last >= 0 else 0
            pop(big, pos, lcp, c, np.greater)
    small = _Queues(folder, f"{level}-S", symbols, cap)
    for c in range(symbols - 1, -1, -1):
        spool, last = small.spools[c], -1
        while len(spool):
            got = runs(small, spool.take(), c)
            pop(small, got["pos"], got["lcp"].astype(np.int64), c, np.less_equal)
            last = int(got["pos"][-1])
        carry = 0  # of the entry read before: its common prefix with the next one down
        fresh = True
        for got in big.spools[c].slices(backwards=True):
            lcp = np.concatenate([[carry], got["lcp"][:-1]]).astype(np.int64)
            if fresh:
                lcp[0] = _join(text, int(got["pos"][0]), last, cap) if last >= 0 else 0
                fresh = False
            carry = int(got["lcp"][-1])
            pop(small, got["pos"], lcp, c, np.less)
    return big.spools, small.spools


def _steps(n: int) -> Iterator[tuple[int, int]]:
    for a in range(0, n, STEP):
        yield a, min(a + STEP, n)


def _symbols(text: np.ndarray, places: np.ndarray, symbols: int) -> np.ndarray:
    """How often each symbol stands at the places."""
    out = np.zeros(symbols, np.int64)
    for a, b in _steps(len(places)):
        out += np.bincount(text[places[a:b]], minlength=symbols)
    return out


def _stars(text: np.ndarray, folder: str, level: str) -> np.ndarray:
    """S* positions, ascending; text ends with its only smallest symbol."""
    n, total, carry = len(text), 0, True
    with tempfile.SpooledTemporaryFile(KEEP, dir=folder) as back:  # from the last to the first
        for b in range(n, 0, -STEP):
            a = max(0, b - STEP)
            here = np.asarray(text[a : min(b + 1, n)]).astype(np.int64)
            step = np.sign(np.diff(here)) if b < n else np.append(np.sign(np.diff(here)), 1)
            if step[-1] == 0:
                step[-1] = 1 if carry else -1
            nonzero = np.where(step != 0, np.arange(len(step)), len(step) - 1)
            small = step[np.minimum.accumulate(nonzero[::-1])[::-1]] > 0
            found = np.flatnonzero(small[1:] & ~small[:-1]) + a + 1
            if b < n and not small[-1] and carry:
                found = np.append(found, b)
            back.write(found[::-1].astype("<i8").tobytes())
            total += len(found)
            carry = bool(small[0])
        out = scratch(folder, f"{level}-stars", np.int64, total)
        back.seek(0)
        while total:
            got = np.frombuffer(back.read(8 * min(STEP, total)), "<i8")
            out[total - len(got) : total] = got[::-1]
            total -= len(got)
    return out


def _by_symbol(text: np.ndarray, places: np.ndarray, symbols: int, folder: str, level: str) -> np.ndarray:
    """The places in the order of their symbols."""
    out = scratch(folder, f"{level}-seeds", np.int64, len(places))
    counts = _symbols(text, places, symbols)
    at = np.cumsum(counts) - counts
    for a, b in _steps(len(places)):
        own = np.asarray(places[a:b])
        met = np.asarray(text[own]).astype(np.int64)
        order = np.argsort(met, kind="stable")
        own, met = own[order], met[order]
        here = np.bincount(met, minlength=symbols)
        out[at[met] + np.arange(len(met)) - (np.cumsum(here) - here)[met]] = own
        at += here
    return out


def _alike(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Common prefix of the suffixes at a and b, at most `most`; several symbols are compared at a time."""
    out = np.zeros(len(a), np.int64)
    live = np.flatnonzero(most > 0)
    n, size = len(text), text.dtype.itemsize
    each = 8 // size
    if each > 1 and n > each:
        words = np.ndarray((n - each + 1,), "<u8", buffer=text, strides=(size,))
        near_end = []
        while len(live):
            i, j = a[live] + out[live], b[live] + out[live]
            ok = np.maximum(i, j) <= n - each
            near_end.append(live[~ok])
            live, i, j = live[ok], i[ok], j[ok]
            apart = words[i] ^ words[j]
            same = np.full(len(live), each)
            for k in range(each, 0, -1):
                same[apart & np.uint64((1 << (8 * size * k)) - 1) != 0] = k - 1
            out[live] += same
            live = live[(same == each) & (out[live] < most[live])]
        live = np.concatenate([live, *near_end])
        out = np.minimum(out, most)
        live = live[out[live] < most[live]]
    while len(live):
        i, j = a[live] + out[live], b[live] + out[live]
        ok = (i < n) & (j < n)
        same = ok & (np.asarray(text[np.minimum(i, n - 1)]) == np.asarray(text[np.minimum(j, n - 1)]))
        out[live[same]] += 1
        live = live[same]
        live = live[out[live] < most[live]]
    return out


def _ranges(keys: np.ndarray, order: np.ndarray, folder: str, name: str) -> Iterator[np.ndarray]:
    """Places of keys in ascending order of key, by ranges that fit into memory. order: places that are nearly in order."""
    if len(keys) <= 4 * STEP:
        own = np.array(order)
        yield own[np.argsort(keys[own], kind="stable")]
        return
    some = np.sort(np.asarray(keys[:: max(1, len(keys) // 4096)]))
    picked = some[:: max(1, len(some) * STEP // (2 * len(keys)))]
    often = picked[1:][np.diff(picked) == 0]  # a key of many places has a range of its own, in which nothing is to be sorted
    bounds = np.unique(np.concatenate([picked, often + 1]))
    alone = np.isin(np.concatenate([[-1], bounds]), often)
    paths = [f"{folder}/{name}-range-{k}" for k in range(len(bounds) + 1)]
    for a, b in _steps(len(keys)):
        places = np.array(order[a:b])
        part = np.searchsorted(bounds, np.asarray(keys[places]), side="right")
        by = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[by], np.arange(len(paths) + 1))
        for k, path in enumerate(paths):
            if cuts[k] < cuts[k + 1]:
                with open(path, "ab") as f:
                    f.write(places[by[cuts[k] : cuts[k + 1]]].astype("<i8").tobytes())
    for k, path in enumerate(paths):
        if not os.path.exists(path):
            continue
        with open(path, "rb") as f:
            while data := f.read(8 * STEP if alone[k] else -1):
                places = np.frombuffer(data, "<i8")
                yield places if alone[k] else places[np.argsort(np.asarray(keys[places]), kind="stable")]
        os.unlink(path)


def _doubled(names: np.ndarray, cap: int, folder: str, level: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Order of the suffixes of names by their first cap names (later ones do not matter), and their ranks by the first 1, 2,
    4, ... names."""
    n = len(names)
    rank, order, keys = (scratch(folder, f"{level}-{name}", np.int64, n) for name in ("rank", "order", "keys"))
    for a, b in _steps(n):
        rank[a:b] = names[a:b]
        order[a:b] = np.arange(a, b)
    width, before = 1, 0
    levels = [names]
    while True:
        for a, b in _steps(n):
            keys[a:b] = rank[a:b] * (n + 1)
            c = min(b, n - width)
            if c > a:
                keys[a:c] += rank[a + width : c + width] + 1
        at, count, last = 0, -1, None
        for places in _ranges(keys, order, folder, level):
            order[at : at + len(places)] = places
            own = keys[places]
            fresh = np.diff(own, prepend=own[0] if last is None else last) != 0
            if last is None:
                fresh[0] = True
            ranks = count + np.cumsum(fresh)
            rank[places] = ranks
            count, last, at = int(ranks[-1]), own[-1], at + len(places)
        width *= 2
        if count in (n - 1, before) or width >= cap:  # nothing left to tell apart, or nothing was
            return order, levels
        held = scratch(folder, f"{level}-rank-{width}", np.int32 if n < 1 << 31 else np.int64, n)
        for a, b in _steps(n):
            held[a:b] = rank[a:b]
        levels.append(held)
        before = count


def _star_order(text: np.ndarray, symbols: int, cap: int, folder: str, level: int) -> tuple[np.ndarray, np.ndarray]:
    """S* positions in the order of their suffixes, and the common prefix of each with the one before, at most cap."""
    stars = _stars(text, folder, str(level))
    n, m = len(text), len(stars)
    if m <= 1:
        return stars, np.zeros(m, np.uint16)
    new = lambda name, kind, size=m: scratch(folder, f"{level}-{name}", kind, size)
    seeds = _by_symbol(text, stars, symbols, folder, str(level))
    big, small = _sorted_by_induction(text, symbols, seeds, new("none", np.uint16), 1, folder, f"{level}a")
    is_star = new("is-star", np.uint8, n)
    for a, b in _steps(m):
        is_star[stars[a:b]] = 1
    ordered = new("ordered", np.int64)
    ordered[0], at = stars[m - 1], 1  # the last suffix is its own sentinel and is induced by nothing
    for c in range(symbols):
        for x in small[c].slices(backwards=True):
            own = x["pos"][is_star[x["pos"]] > 0]
            ordered[at : at + len(own)] = own
            at += len(own)
    for s in (*big, *small):
        s.drop()
    assert at == m
    names, order, count = new("names", np.int64), new("order", np.int64), -1
    last, last_size = -1, -1
    for a, b in _steps(m):
        own = np.asarray(ordered[a:b])
        index = np.searchsorted(stars, own)
        sizes = np.where(index + 1 < m, stars[np.minimum(index + 1, m - 1)], n - 1) - own + 1
        before, fresh = np.concatenate([[last], own[:-1]]), np.ones(b - a, bool)
        equal = np.flatnonzero(sizes == np.concatenate([[last_size], sizes[:-1]]))
        fresh[equal] = _alike(text, before[equal], own[equal], sizes[equal]) < sizes[equal]
        own_names = count + np.cumsum(fresh)
        names[index], order[a:b] = own_names, index
        count, last, last_size = int(own_names[-1]), int(own[-1]), int(sizes[-1])
    if count == m - 1:
        return ordered, _star_prefixes(text, stars, order, [], cap, folder, level)
    if count + 1 < ALPHABET:
        inner = new("inner", np.int64, m + 1)
        for a, b in _steps(m):
            inner[a:b] = names[a:b] + 1
        at, levels = 0, [names]
        for x in suffixes(inner, count + 2, cap, folder, level + 1):
            own = x["pos"][x["pos"] < m]
            order[at : at + len(own)] = own
            at += len(own)
    else:
        order, levels = _doubled(names, cap // 2 + 1, folder, f"{level}d")  # a name spans two symbols at least
    for a, b in _steps(m):
        ordered[a:b] = stars[order[a:b]]
    return ordered, _star_prefixes(text, stars, order, levels, cap, folder, level)


def _star_prefixes(text: np.ndarray, stars: np.ndarray, order: np.ndarray, levels: list[np.ndarray], cap: int, folder: str, level: int) -> np.ndarray:
    """Of S* suffixes in order: equal ranks skip many names at once, the rest is compared by symbols."""
    out = scratch(folder, f"{level}-prefixes", np.uint16, len(order))
    for a, b in _steps(len(order) - 1):
        k = np.arange(a + 1, b + 1)
        i, j = order[k - 1].copy(), order[k].copy()
        for depth in range(len(levels) - 1, -1, -1):
            ranks, width = levels[depth], 1 << depth
            inside = (np.maximum(i, j) + width) < len(order)
            skip = inside & (np.asarray(ranks[i]) == np.asarray(ranks[j]))
            i[skip] += width
            j[skip] += width
        done = stars[i] - stars[order[k - 1]]
        most = np.maximum(cap - done, 0)
        out[a + 1 : b + 1] = np.minimum(done + _alike(text, stars[i], stars[j], most), cap)
    return out


def suffixes(text: np.ndarray, symbols: int, cap: int, folder: str, level: int = 0) -> Iterator[np.ndarray]:
    """Entries (pos, lcp) in suffix order; lcp is that with the entry before, at most cap.

    text: symbols 0 to symbols - 1, of which 0 stands at the end and nowhere else. Suffixes that agree in their first cap
    symbols may come in any order.
    """
    text = np.asanyarray(text)
    if len(text) == 1:
        yield np.zeros(1, ENTRY)
        return
    stars, prefixes = _star_order(text, symbols, cap, folder, level)
    big, small = _sorted_by_induction(text, symbols, stars, prefixes, cap, folder, f"{level}b")
    end = np.zeros(1, ENTRY)
    end["pos"] = len(text) - 1
    for c in range(symbols):
        last = -1
        if c == 0:
            yield end  # the sentinel
            big[0].drop()
            small[0].drop()
            continue
        for got in big[c].slices():
            yield got
            last = int(got["pos"][-1])
        held = None  # an S entry waits for the one below it, whose prefix it is that it needs
        for got in small[c].slices(backwards=True):
            out = got.copy()
            out["lcp"][1:] = got["lcp"][:-1]
            out["lcp"][0] = (_join(text, last, int(got["pos"][0]), cap) if last >= 0 else 0) if held is None else held
            held = int(got["lcp"][-1])
            yield out
        big[c].drop()
        small[c].drop()
