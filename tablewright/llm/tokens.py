"""Byte-level BPE ids of whole texts, by the tokenizers library.

The pre-tokenizer of a byte-level BPE ends a piece wherever one space or line feed stands between two characters that are
not white space, so a text may be cut there and its parts encoded apart: the ids are those of the whole text. Parts repeat
far more often than texts: a block of texts is cut and its different parts are numbered by Arrow, each part is encoded once
for the block, and the ids of the texts are gathered by number. Parts that occurred more than once in a block are held in a
table of at most TABLE parts, which the worker process keeps for its later blocks and tasks. Parts are encoded many in a call:
joined by single spaces (or line feeds, for those that have no space before them), each shows where it begins by a token that
starts with a space (or by the line feed between). Texts with other white space, or with what may be a special token's string,
are given to the library whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters of text that are encoded together, parts in one string (long strings are slower for each part), strings in a call.
BLOCK, RUN, CALL = 12_000_000, 100, 64
#: Parts that a worker process keeps, with their ids.
TABLE = 250_000
_SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ODD = f"{_SPACE}{_SPACE}|^{_SPACE}|{_SPACE}$|<\\||^$"


class Encoder:
    """Little-endian unsigned 32-bit ids of whole texts, as bytes."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        space = self.tokenizer.encode(" a", add_special_tokens=False).tokens[0][0]
        vocab = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.opens[[i for t, i in vocab.items() if t.startswith(space)]] = True
        self.feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        assert len(self.feed) == 1
        self._forget()

    def _forget(self) -> None:
        """Empty the table."""
        self.known: tuple[dict[str, int], dict[str, int]] = ({}, {})  # parts without and with a space before them
        self.flat, self.sizes = np.zeros(0, "<u4"), np.zeros(0, np.int64)

    def _keep(self, parts: tuple[list[str], list[str]], ids: np.ndarray, sizes: np.ndarray, often: np.ndarray) -> None:
        """Add those of the new parts (without a space first) that occurred more than once."""
        if len(self.sizes) + int(often.sum()) > TABLE:
            self._forget()
        chosen = np.flatnonzero(often)[:TABLE]
        at = len(self.sizes)
        for k in chosen.tolist():
            spaced = k >= len(parts[0])
            self.known[spaced][parts[spaced][k - len(parts[0]) * spaced]] = at
            at += 1
        own = np.zeros(len(sizes), bool)
        own[chosen] = True
        self.flat = np.concatenate([self.flat, ids[np.repeat(own, sizes)]])
        self.sizes = np.concatenate([self.sizes, sizes[chosen]])

    def whole(self, text: str) -> bytes:
        """By the library alone."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _parts(self, parts: list[str], spaced: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different parts, with a space before each or without, and the number of each."""
        ids, sizes = [], []
        runs = [parts[a : a + RUN] for a in range(0, len(parts), RUN)]
        for a in range(0, len(runs), CALL):
            texts = [" " + " ".join(run) if spaced else "\n".join(run) for run in runs[a : a + CALL]]
            found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            for run, one in zip(runs[a : a + CALL], found, strict=True):
                got = np.array(one.ids, dtype="<u4")
                if spaced:
                    cuts = np.flatnonzero(self.opens[got])
                    sizes.append(np.diff(cuts, append=len(got)))
                else:
                    gaps = got == self.feed[0]
                    cuts = np.append(np.flatnonzero(gaps), len(got))
                    sizes.append(np.diff(cuts, prepend=-1) - 1)
                    got = got[~gaps]
                assert len(sizes[-1]) == len(run)
                ids.append(got)
        return (np.concatenate(ids), np.concatenate(sizes)) if ids else (np.zeros(0, "<u4"), np.zeros(0, np.int64))

    def _block(self, texts: list[str]) -> list[bytes]:
        column = pa.array(texts, pa.string())
        odd = pc.match_substring_regex(column, _ODD).to_numpy(zero_copy_only=False)
        plain = np.flatnonzero(~odd)
        out: list[bytes] = [b""] * len(texts)
        for i in np.flatnonzero(odd).tolist():
            out[i] = self.whole(texts[i]) if texts[i] else b""
        if not len(plain):
            return out
        if len(plain) < len(texts):
            column = column.filter(pa.array(~odd))
        split = pc.split_pattern(pc.replace_substring(column, "\n", " \n "), " ")
        cuts = split.offsets.to_numpy()
        coded = split.values.slice(int(cuts[0]), int(cuts[-1] - cuts[0])).dictionary_encode()
        cuts = cuts - cuts[0]
        words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        feed = pc.index(coded.dictionary, "\n").as_py()
        start = codes == feed  # parts without a space before them; a line feed is one too
        start[1:] |= start[:-1].copy()
        start[cuts[:-1]] = True
        start &= codes != feed
        n = len(words)
        met = np.bincount(codes + n * (~start & (codes != feed)), minlength=2 * n).reshape(2, n)  # without and with a space
        if feed >= 0:
            met[0, feed] = 0
        place = np.zeros((2, n), np.int64)
        fresh, counts = ([], []), []
        at = len(self.sizes)
        for spaced in (0, 1):
            own = np.flatnonzero(met[spaced])
            get = self.known[spaced].get
            found = np.fromiter((get(words[i], -1) for i in own.tolist()), np.int64, len(own))
            new = own[found < 0]
            found[found < 0] = at + np.arange(len(new))
            at += len(new)
            place[spaced, own] = found
            fresh[spaced].extend([words[i] for i in new.tolist()])
            counts.append(met[spaced, new])
        if feed >= 0:
            place[0, feed] = at
        del words
        ids, sizes = (np.concatenate(x) for x in zip(self._parts(fresh[0], False), self._parts(fresh[1], True), strict=True))
        flat = np.concatenate([self.flat, ids, np.array(self.feed, "<u4")])
        all_sizes = np.concatenate([self.sizes, sizes, [1]])
        self._keep(fresh, ids, sizes, np.concatenate(counts) > 1)
        sizes = all_sizes
        number = place[(~start & (codes != feed)).astype(np.int8), codes]
        starts = (np.cumsum(sizes) - sizes)[number]
        own = sizes[number]
        ends = np.cumsum(own)
        got = flat[np.repeat(starts - (ends - own), own) + np.arange(ends[-1])]
        ends = np.concatenate([[0], ends])[cuts].tolist()
        for i, a, b in zip(plain.tolist(), ends, ends[1:], strict=False):
            out[i] = got[a:b].tobytes()
        return out

    def ids(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text, in order."""
        block: list[str] = []
        size = 0
        for text in texts:
            block.append(text)
            size += len(text)
            if size >= BLOCK:
                yield from self._block(block)
                block, size = [], 0
        if block:
            yield from self._block(block)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
