import random
import tracemalloc
import zlib

import numpy as np
import pytest

from tablewright.llm import common, packing, token_files, tokens

MARKS = [" ", "  ", "\n", "\t", "a", "Bc", "é", "'s", "1", "23", "!", ".", "a,", "\xa0", "　", "<|endoftext|>", "x y", "\x1c", "\x85", "ſ", "中文", "<|"]


def test_ids_are_the_librarys():
    enc, rng = tokens.encoder(tokens.default_path()), random.Random(1)
    texts = ["".join(rng.choices(MARKS, k=rng.randint(0, 9))) for _ in range(5000)]
    assert list(enc.ids(texts)) == [enc.whole(t) for t in texts]


def test_the_table_of_parts_is_bounded_and_exact(monkeypatch):
    enc, rng = tokens.Encoder(tokens.default_path()), random.Random(2)
    monkeypatch.setattr(tokens, "TABLE", 40)
    monkeypatch.setattr(tokens, "BLOCK", 300)
    words = ["".join(rng.choices("abcdefg,.'1é", k=rng.randint(1, 7))) for _ in range(300)]
    for _ in range(20):
        texts = [rng.choice([" ", "\n"]).join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(30)]
        assert list(enc.ids(texts)) == [enc.whole(t) for t in texts]
        assert len(enc.sizes) <= 40 and sum(map(len, enc.known)) == len(enc.sizes) and enc.sizes.sum() == len(enc.flat)


def expected(text, end):
    enc = tokens.encoder(tokens.default_path())
    return np.append(np.frombuffer(enc.whole(text or ""), "<u4"), end).astype("<u4")


def test_token_files(spark, odd, empty):
    folder = common.fresh_path(spark, "t")
    spec, shards = token_files.write_files(odd, folder, shards=3)
    rows = token_files.read_files(spark, folder, spec, shards).orderBy("start").collect()
    at = 0
    source = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in odd.collect()))
    for (known, key, text), r in zip(source, rows, strict=True):
        ids = expected(text, 2)
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (key if known else None, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    reader = token_files.ShardReader(f"{folder}/shard-{shards[-1][0]:06d}.ids", spec)
    assert len(reader.ids(len(reader.index) - 1)) == reader.index["n_tokens"][-1]
    with pytest.raises(ValueError):
        token_files.ShardReader(f"{folder}/shard-{shards[-1][0]:06d}.ids", token_files.Spec(spec.tokenizer, 2, spec.width, b"other"))
    folder = common.fresh_path(spark, "t")
    assert token_files.read_files(spark, folder, *token_files.write_files(empty, folder)).count() == 0


def test_dictionary_samples_are_bounded(spark):
    rows = [(7, "same key " + str(i)) for i in range(3000)] + [(8, "x y " * 300_000)]
    sent = []
    real = tokens.Encoder.ids
    try:
        tokens.Encoder.ids = lambda self, texts: real(self, sent.extend(texts) or list(sent))
        token_files.train(spark.createDataFrame(rows, "doc_id long, text string"), tokens.default_path(), 2, 20)
    finally:
        tokens.Encoder.ids = real
    assert len(sent) <= 40 and max(map(len, sent)) <= token_files.SAMPLE_BYTES


def test_packing(odd, empty):
    rows = packing.pack(odd, max_tokens=64, with_ids=True).collect()
    seqs, docs = {}, {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        docs.setdefault((r["doc_id"], r["ids_crc32"] if r["doc_id"] is None else None), []).append(r)
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
    for places in seqs.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    long = sorted((r["piece"], r["start"], r["length"]) for r in rows if r["doc_id"] == 5)
    n = len(expected("x" * 300_000, 0))
    assert sum(x[2] for x in long) == n and all(x[2] == 64 for x in long[1:]) and [x[0] for x in long] == list(range(len(long)))
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_bin_completion_holds_every_piece(seed):
    rng = np.random.default_rng(seed)
    size = int(rng.integers(10, 60))
    counts = np.zeros(size + 1, np.int64)
    counts[rng.integers(1, size + 1, 12)] = rng.integers(1, 30, 12)
    made = packing.bin_completion(counts, size, 500).patterns
    held = np.zeros_like(counts)
    for items, n in made:
        assert sum(items) <= size
        np.add.at(held, list(items), n)
    bins = sum(n for _, n in made)
    assert (held == counts).all() and packing.lower_bound(counts, size) <= bins <= sum(n for _, n in packing.best_fit_decreasing(counts, size))


def test_bin_completion_beats_best_fit():
    counts = np.zeros(101, np.int64)
    for x, n in ((44, 2), (28, 2), (36, 2), (24, 2), (34, 1), (33, 2)):  # best fit needs one sequence more
        counts[x] += n
    assert packing.bin_completion(counts, 100).sequences == packing.lower_bound(counts, 100)
    counts = np.zeros(2049, np.int64)
    counts[[1048, 900, 648, 500, 350, 330, 320]] = 1
    assert packing.bin_completion(counts, 2048).sequences == 2


def fewest(pieces, size):
    """By trying all subsets."""
    best = [(1, 0)] + [(len(pieces) + 1, 0)] * ((1 << len(pieces)) - 1)  # bins, and what is in the last one
    for mask in range(1, 1 << len(pieces)):
        for i, x in enumerate(pieces):
            if mask >> i & 1:
                bins, load = best[mask ^ (1 << i)]
                best[mask] = min(best[mask], (bins, load + x) if load + x <= size else (bins + 1, x))
    return best[-1][0]


def test_bin_completion_is_optimal():
    rng, met, beaten = random.Random(5), 0, 0
    while beaten < 200:
        size = rng.randint(15, 60)
        pieces = sorted(rng.choices(range(1, rng.randint(size // 3, size) + 1), k=rng.randint(6, 11)))
        counts = np.bincount(pieces, minlength=size + 1)
        incumbent = sum(n for _, n in packing.best_fit_decreasing(counts, size))
        if incumbent == packing.lower_bound(counts, size):
            continue
        found, want = packing.bin_completion(counts, size), fewest(pieces, size)
        assert found.complete and found.sequences == want >= found.least, (size, pieces)
        met, beaten = met + 1, beaten + (want < incumbent)
    counts = np.bincount([2, 3, 3, 3, 6, 7, 7, 8, 9, 12, 12, 12], minlength=29)
    assert packing.bin_completion(counts, 28).sequences == 3


def test_bin_completion_holds_little():
    """A search of many levels holds the tables of a few, and ends as one that holds them all."""
    counts = np.bincount(np.random.default_rng(3).integers(100, 1800, 6_000), minlength=2049)
    tracemalloc.start()
    try:
        found = packing.bin_completion(counts, 2048, 4_000)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert not found.complete and most < 40 << 20
    for seed in range(40):
        rng = np.random.default_rng(seed)
        size = int(rng.integers(20, 90))
        counts = np.bincount(rng.integers(size // 6, size + 1, 25), minlength=size + 1)
        assert len({str(packing.bin_completion(counts, size, 600, held)) for held in (0, 2_000, 1 << 30)}) == 1


def test_fillings_start_where_they_were():
    counts = np.bincount(np.random.default_rng(4).integers(10, 90, 24), minlength=201)
    got = list(packing.fillings(counts, 200, 3))
    assert len(got) > 20 and all(list(packing.fillings(counts, 200, 3, start=x)) == got[k:] for k, (_, x) in enumerate(got))


def test_fillings_are_all_that_are_not_dominated():
    rng = random.Random(9)
    for _ in range(150):
        room = rng.randint(5, 30)
        counts = np.bincount(rng.choices(range(1, room + 5), k=7), minlength=room + 6)
        pieces = [x for x in range(1, room + 1) for _ in range(counts[x])]
        every = {tuple(sorted((pieces[i] for i in range(len(pieces)) if mask >> i & 1), reverse=True)) for mask in range(1 << len(pieces))}
        every = {x for x in every if sum(x) <= room}

        def fits(small, large):
            """Whether the pieces of small can be put into those of large."""
            if not small:
                return True
            return any(fits(small[1:], large[:k] + (large[k] - small[0],) + large[k + 1 :]) for k in range(len(large)) if large[k] >= small[0])

        want = {x for x in every if not any(x != y and sum(y) >= sum(x) and fits(x, y) for y in every)}
        got = [x for _, x in packing.fillings(counts, room, room)]
        assert len(got) == len(set(got)) and set(got) == want
