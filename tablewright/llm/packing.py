"""Best-fit packing of documents into training sequences by bin completion.

How many sequences are needed depends on how many pieces there are of each length and on nothing else, so the search runs
on a histogram of at most max_tokens counts, whatever the corpus. It goes around the largest piece left and enumerates every
undominated filling of the room beside it, least waste first. A filling is dominated if some pieces in it (or the room left)
could be changed for one larger piece that is still there and fits; all that can be gained with a dominated filling can be
gained with another. Waste bounds prune the enumeration, and a bound on the pieces left prunes a branch that cannot beat the
incumbent, which is best-fit decreasing at first. A filling is applied as often as the counts allow, and then, on the way
back, once less at a time, so that the search is complete: it ends with as few sequences as there can be, unless NODES
fillings were tried before. Packing is a hard problem, so some such limit must stand; Search says whether it was reached.
The search may be as deep as there are different fillings, so only its deepest levels, of HELD bytes, keep their tables; one
above makes its own again when the search comes back to it, and goes on where it was. States seen are kept as digests.
Pieces then take their places by their rank among the pieces of the same length.

Null texts are empty and give the end id alone. Repeated rows are packed once each; rows with a null doc_id are packed like
others. Only doc_id and text are read of a table, whatever its other columns are called. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm import common, tokens

MAX_TOKENS = 2048
#: Fillings tried in all.
NODES = 50_000
#: Bytes of tables that the levels of the search hold, beside the deepest one's.
HELD = 1 << 24

Pattern = tuple[tuple[int, ...], int]  # lengths in one sequence, how many such sequences


def lower_bound(counts: np.ndarray, size: int) -> int:
    """Total volume, and pieces over half a sequence with what cannot lie beside them, for each least size of a small piece."""
    n, volume = np.cumsum(counts), np.cumsum(np.arange(len(counts)) * counts)
    half = size // 2
    k = np.arange(1, half + 1)
    over = n[size - k] - n[half]  # over half, with room for a piece of k
    room = over * size - (volume[size - k] - volume[half])
    small = volume[half] - volume[k - 1]
    bounds = n[size] - n[half] + np.maximum(0, -((room - small) // size))
    return max(-(-int(volume[size]) // size), int(bounds.max(initial=0)))


def best_fit_decreasing(counts: np.ndarray, size: int) -> list[Pattern]:
    """The incumbent: bins alike are kept as one group."""
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        for room in sorted(r for r in open_bins if r >= length):
            groups, each = open_bins.pop(room), room // length
            while groups and left:
                items, n = groups.pop()
                full = min(n, left // each)
                if full:
                    open_bins.setdefault(room - each * length, []).append((items + (length,) * each, full))
                    left -= full * each
                if full < n:
                    if left:  # one bin takes the rest
                        open_bins.setdefault(room - left * length, []).append((items + (length,) * left, 1))
                        full, left = full + 1, 0
                    if full < n:
                        groups.append((items, n - full))
            if groups:
                open_bins.setdefault(room, []).extend(groups)
            if not left:
                break
        each = size // length
        if left // each:
            open_bins.setdefault(size - each * length, []).append(((length,) * each, left // each))
        if left % each:
            open_bins.setdefault(size - left % each * length, []).append(((length,) * (left % each), 1))
    return [x for groups in open_bins.values() for x in groups]


class _Budget:
    """How many fillings may still be tried."""

    def __init__(self, left: int) -> None:
        self.left = left


def _dominated(items: tuple[int, ...], counts: np.ndarray, there: int, room: int) -> bool:
    """Whether some of the items, or none, can be changed for one larger piece, or several for one as large. there: the lengths
    that counts has, as bits."""
    one, many, copies = 0, 0, {}
    for x in items:
        many |= (one | many) << x
        one |= 1 << x
        copies[x] = copies.get(x, 0) + 1
    for x, n in copies.items():
        if n == counts[x]:
            there &= ~(1 << x)
    slack = room - sum(items)
    sums, width = 1 | one | many, 1
    gained = sums << 1 if slack else 0  # sums of some items and 1 to slack more
    while width < slack:
        step = min(width, slack - width)
        gained |= gained << step
        width += step
    return bool((gained | many) & there & ((1 << (room + 1)) - 1))


def _exact(have: list[int], reach: list[int], counts: np.ndarray, k: int, left: int, start: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
    """Of the first k lengths, with a sum of left; from start on, if it has items. Not a function within fillings(): one that
    calls itself would keep the tables until garbage is collected."""
    if not left:
        yield ()
        return
    for j in range(bisect_left(have, start[0]) if start else bisect_right(have, left, 0, k) - 1, -1, -1):
        if not reach[j + 1] >> left & 1:
            return
        length = have[j]
        for n in range(start.count(length) if start else min(int(counts[length]), left // length), 0, -1):
            if reach[j] >> (left - n * length) & 1:
                for rest in _exact(have, reach, counts, j, left - n * length, start[n:]):
                    yield (length,) * n + rest
            start = ()


def fillings(counts: np.ndarray, room: int, most: int, budget: _Budget | None = None, start: tuple[int, ...] | None = None) -> Iterator[tuple[int, tuple[int, ...]]]:
    """(waste, lengths) of all undominated fillings of room with what counts has that waste at most `most`; least waste and
    largest pieces first. They are made as they are asked for. start: the filling to begin with, which was tried before."""
    budget = budget or _Budget(1 << 62)
    have = [int(x) for x in np.flatnonzero(counts[: room + 1]) if x]
    reach, there, mask = [1], 0, (1 << (room + 1)) - 1  # sums of the first pieces, as bits
    for length in have:
        bits, left, step = reach[-1], min(int(counts[length]), room // length), 1
        while left:
            step = min(step, left)
            bits |= (bits << (step * length)) & mask
            left, step = left - step, step * 2
        reach.append(bits)
        there |= 1 << length

    for waste in range(room - sum(start) if start is not None else 0, min(most, room) + 1):
        if reach[-1] >> (room - waste) & 1:
            for items in _exact(have, reach, counts, len(have), room - waste, start or ()):
                if start is None:
                    budget.left -= 1
                    if budget.left < 0:
                        return
                    if _dominated(items, counts, there, room):
                        continue
                start = None
                yield waste, items


@dataclass(frozen=True)
class Search:
    """patterns hold every piece; least: a lower bound on the sequences; complete: whether there cannot be fewer sequences (the
    bound was met, or the search ended before its limit)."""

    patterns: list[Pattern]
    least: int
    complete: bool

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.patterns)


@dataclass
class _Level:
    """A step of the search: the filling that may not come here, what may be wasted, and the filling last tried here (without
    the largest piece) and how often; options: what comes next, none while its tables, of so many bytes, are not held."""

    barred: tuple[int, ...] | None
    spare: int
    rest: tuple[int, ...] | None = None
    often: int = 0
    options: Iterator[tuple[tuple[int, ...], int, tuple[int, ...] | None]] | None = None
    bytes: int = 0


def bin_completion(counts: np.ndarray, size: int = MAX_TOKENS, nodes: int = NODES, held: int = HELD) -> Search:
    """Branch and bound over the fillings around the largest piece; never more sequences than best-fit decreasing needs."""
    counts = counts.astype(np.int64).copy()
    best, least = best_fit_decreasing(counts, size), lower_bound(counts, size)
    bins, budget = sum(n for _, n in best), _Budget(nodes)
    path: list[Pattern] = []
    used = 0
    seen: dict[tuple, int] = {}

    def level(barred: tuple[int, ...] | None) -> _Level:
        return _Level(barred, (bins - 1 - used) * size - int((np.arange(len(counts)) * counts).sum()))

    def options(at: _Level) -> Iterator[tuple[tuple[int, ...], int, tuple[int, ...] | None]]:
        """(filling, how often, the filling that may not come next), after what was tried at this level."""
        own = counts.copy()
        largest = int(np.flatnonzero(own)[-1])
        own[largest] -= 1
        for waste, rest in fillings(own, size - largest, at.spare, budget, at.rest):
            items = (largest, *rest)
            if items == at.barred:
                continue
            lengths, each = np.unique(items, return_counts=True)
            often = int(((own[lengths] + (lengths == largest)) // each).min())
            most = min(often, at.spare // waste) if waste else often
            for n in range(at.often - 1 if rest == at.rest else most, 0, -1):
                at.rest, at.often = rest, n
                yield items, n, items if n < often else None

    def table_bytes() -> int:
        """Of the counts, of the lengths that fit beside the largest piece, and of their sums as bits."""
        room = size - int(np.flatnonzero(counts)[-1])
        return counts.nbytes + int(np.count_nonzero(counts[: room + 1])) * (room // 8 + 100)

    stack = [level(None)] if bins > least else []
    first = total = 0  # the levels from the first on hold their tables, of so many bytes
    while stack and bins > least and budget.left > 0:
        at = stack[-1]
        if at.options is None:
            at.options, at.bytes = options(at), table_bytes()
            first, total = min(first, len(stack) - 1), total + at.bytes
            while total > held + at.bytes:
                stack[first].options, total = None, total - stack[first].bytes
                first += 1
        step = next(at.options, None)
        if step is None:
            total -= stack.pop().bytes
            if path:
                items, n = path.pop()
                np.add.at(counts, list(items), n)
                used -= n
            continue
        items, n, last = step
        budget.left -= 1
        np.subtract.at(counts, list(items), n)
        state = (hashlib.blake2b(counts, digest_size=16).digest(), last)
        hopeless = used + n + lower_bound(counts, size) >= bins or seen.get(state, 1 << 62) <= used + n
        if not hopeless and not counts.any():
            best, bins, hopeless = [*path, (items, n)], used + n, True
        if hopeless:
            np.add.at(counts, list(items), n)
            continue
        seen[state] = used + n
        path.append((items, n))
        used += n
        stack.append(level(last))
    return Search(best, least, bins == least or budget.left > 0)


def _pieces(tokenizer: str, end_id: int, size: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = tokens.encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            for key, ids in zip(batch.column(0).to_pylist(), enc.ids(common.texts_of(batch.column(1))), strict=True):
                ids += end
                n = len(ids) // 4
                cuts = [0, *range(n % size or size, n + 1, size)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    own = ids[a * 4 : b * 4]
                    out.append((key, k, a, b - a, zlib.crc32(own), np.frombuffer(own, "<u4") if with_ids else None))
            cols = list(zip(*out, strict=True)) if out else [()] * 6
            names = ("doc_id", "piece", "start", "length", "ids_crc32")
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            made = {k: pa.array(c, t) for k, c, t in zip(names, cols, kinds, strict=False)}
            if with_ids:
                made["ids"] = pa.array(cols[5], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict(made)

    return run


def _places(key: np.ndarray, seq: np.ndarray, offset: np.ndarray):
    """key: length << 40 | first rank, ascending; a row's rank past it is added to the sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            own = (table["length"].to_numpy() << 40) | table.pop("_rank").to_numpy()
            k = np.searchsorted(key, own, side="right") - 1
            table |= {"sequence_id": pa.array(seq[k] + (own - key[k])), "offset": pa.array(offset[k])}
            yield pa.RecordBatch.from_pydict(table)

    return run


def pack(docs: DataFrame, *, max_tokens: int = MAX_TOKENS, tokenizer: str | None = None, end_id: int = 0, with_ids: bool = False, nodes: int = NODES) -> DataFrame:
    """Rows: doc_id, piece, start, length, ids_crc32, [ids], sequence_id, offset.

    Documents longer than max_tokens are cut into pieces of max_tokens, of which the first may be shorter. nodes: the limit of
    the search.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    pieces = common.saved(docs.mapInArrow(_pieces(tokenizer or tokens.default_path(), end_id, max_tokens, with_ids), schema), "pieces")
    counts = np.zeros(max_tokens + 1, np.int64)
    for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most max_tokens rows
        counts[r["length"]] = r["n"]
    slots, used, seq = [], np.zeros(max_tokens + 1, np.int64), 0
    for items, n in bin_completion(counts, max_tokens, nodes).patterns:
        at = 0
        for length in items:
            slots.append(((length << 40) | int(used[length]), seq, at))
            used[length] += n
            at += length
        seq += n
    assert (used == counts).all()
    key, base, offset = np.array(sorted(slots), np.int64).reshape(-1, 3).T.copy()
    ranks = common.ranked(pieces, ["length"], ["doc_id", "piece"], "_rank")
    return ranks.mapInArrow(_places(key, base, offset), schema + ", sequence_id long, offset long")


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(common.read_table(spark, sf_dir, "documents"))
