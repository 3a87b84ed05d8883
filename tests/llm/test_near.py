import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import components, external_sa, repeats, simhash


def brute_components(keys, fps, radius):
    up = list(range(len(keys)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(keys)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(keys)):
        groups.setdefault(find(i), []).append(i)
    return {i: min((keys[k] for k in own if keys[k] is not None), default=None) for own in groups.values() for i in own}


def brute_fingerprint(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", "A b", "The quick BROWN fox jumps", "É a\x0bb c d e", "one two three " * 50])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == [brute_fingerprint(text)]


@pytest.mark.parametrize(("lanes", "radius"), [(1, 3), (2, 27)])
def test_link_equals_brute_force(lanes, radius):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, (60, lanes)).astype(np.uint64)
    near = np.concatenate([base, *[base ^ (np.uint64(1) << rng.integers(0, 63, base.shape).astype(np.uint64)) for _ in range(4)]])
    got = simhash.link(near[:150], near[150:], radius)
    apart = np.bitwise_count(near[:, None] ^ near[None]).sum(axis=2)
    apart[150:, 150:] = 1000  # guests do not meet guests
    label = np.arange(len(near))
    while True:
        new = np.array([label[apart[i] <= radius].min() if (apart[i] <= radius).any() else label[i] for i in range(len(near))])
        new = np.minimum(new, label)
        if (new == label).all():
            break
        label = new
    assert (got == label).all()


@pytest.mark.parametrize("block", [2, 1 << 17])
def test_near_duplicates(spark, odd, empty, block):
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["a", "b", "c", "d", "e", "f"], 30)) for _ in range(40)]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts + [t + " g" for t in texts[:20]], start=100)]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select("doc_id", "text"))
    all_rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    fps = [brute_fingerprint(t) for _, t in all_rows]
    want = brute_components([k for k, _ in all_rows], fps, 3)
    expected = sorted((str(k), f, str(want[i])) for i, ((k, _), f) in enumerate(zip(all_rows, fps, strict=True)))
    got = simhash.near_duplicates(docs, block=block).collect()
    assert sorted((str(r["doc_id"]), r["fp0"] % (1 << 64), str(r["component_id"])) for r in got) == expected
    assert simhash.near_duplicates(empty).count() == 0


def test_keep_one(spark, odd):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [1, 3, 5, 6, 7]
    assert [r["text"] for r in kept.where("doc_id is null").collect()] == ["a null id"]  # the null text is empty, like document 1


def test_keep_one_tells_rows_apart(spark, empty):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(7, long), (7, "quite another text of the same id and of no copies"), (None, long + " end"), (None, "nobody knows this one"), (8, long), (8, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("_row", "_row_", "_n", "_kept", "node", "group", "first", "d0", "chunk")})
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"], r["_row"], r["_kept"]) for r in kept.collect()) == sorted((k or 0, t, "_row", "_kept") for k, t in rows[:2] + rows[3:4])
    assert simhash.keep_one(empty).count() == 0


def test_recall_of_wide_fingerprints():
    """Planted pairs of similarity 0.8 to 0.85, of 12 to 400 words: at least 95 in 100 are candidates."""
    rng, met, found = np.random.default_rng(12), 0, 0
    while met < 1500:
        words = [f"w{x}" for x in rng.integers(0, 20_000, int(rng.choice([12, 20, 30, 60, 120, 400])))]
        own = list(words)
        for at in rng.choice(len(own), int(rng.integers(1, max(2, len(own) // 30 + 1))), replace=False):
            own[at] = f"n{rng.integers(0, 20_000)}"
        a, b = " ".join(words), " ".join(own if rng.random() < 0.5 else [*words, *(f"e{x}" for x in rng.integers(0, 20_000, len(words) // 5))])
        if 0.8 <= brute_similarity(a, b) < 0.85:
            met += 1
            apart = sum(bin(x ^ y).count("1") for x, y in zip(simhash.fingerprint(a, 5, 2), simhash.fingerprint(b, 5, 2), strict=True))
            sizes = [simhash.band(len(simhash.shingles(t))) for t in (a, b)]
            found += apart <= simhash.WIDE_RADIUS and abs(sizes[0] - sizes[1]) <= 1
    assert found >= 0.95 * met, found / met


def test_size_bands():
    for n in range(1, 3000):
        assert simhash.band(n) - simhash.band(-(-n * 4 // 5)) <= 1


@pytest.mark.parametrize("tokens", [1 << 21, 50])
def test_verified_equals_brute_force(monkeypatch, tokens):
    monkeypatch.setattr(simhash, "TOKENS", tokens)
    rng = np.random.default_rng(4)
    for chunks in (1, 2):
        sets = [np.unique(rng.integers(0, 12, rng.integers(0, 14)).astype(np.uint64)) for _ in range(60)]
        fps, chunk = rng.integers(0, 4, (60, 1)).astype(np.uint64), rng.integers(0, chunks, 60)
        up = list(range(60))
        for i in range(60):
            for j in range(i):
                both, either = len(np.intersect1d(sets[i], sets[j])), len(np.union1d(sets[i], sets[j]))
                if both and both >= 0.8 * either and int(fps[i, 0] ^ fps[j, 0]).bit_count() <= 1 and (chunk[i] != chunk[j] or (chunk == chunk[0]).all()):
                    a, b = up[i], up[j]
                    up = [min(a, b) if x in (a, b) else x for x in up]
        assert simhash.verified(fps, sets, chunk, 1).tolist() == up


def brute_similarity(a, b):
    sets = []
    for text in (a, b):
        words = text.lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set())
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0


@pytest.mark.parametrize("texts", [1 << 25, 600])
def test_near_copies_are_similar(spark, texts):
    rng = np.random.default_rng(3)
    made = []
    for _ in range(12):
        words = [f"w{x}" for x in rng.integers(0, 5000, 60)]
        for changes in (0, 1, 2, 3, 4, 5):
            own = list(words)
            for at in rng.choice(60, changes, replace=False):
                own[at] = f"n{rng.integers(0, 5000)}"
            made.append(" ".join(own))
    line = "one line that is repeated many times over "
    made += [line * 30 + f"tail {' '.join(f'{k}x{i}' for i in range(12))}" for k in range(4)] + ["", " ", made[0].upper()]
    fps = [simhash.fingerprint(t, 5, 2) for t in made]
    up = list(range(len(made)))
    candidates, pairs = 0, 0
    for i in range(len(made)):
        for j in range(i):
            near = sum(bin(a ^ b).count("1") for a, b in zip(fps[i], fps[j], strict=True)) <= simhash.WIDE_RADIUS
            candidates += near
            if near and brute_similarity(made[i], made[j]) >= 0.8:
                pairs += 1
                a, b = up[i], up[j]
                up = [min(a, b) if x in (a, b) else x for x in up]
    keyed = spark.createDataFrame([(i, i, t) for i, t in enumerate(made)], "_row long, doc_id long, text string")
    got = {r["_row"]: r["root"] for r in simhash.near_copies(keyed, texts=texts).collect()}
    assert got == dict(enumerate(up)) and 0 < pairs < candidates


def test_repeated_line_is_no_near_copy(spark):
    line = "the same line of the form stands here once more "
    texts = [line * 60 + " ".join(f"{k}word{i}" for i in range(20)) for k in "abc"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert brute_similarity(texts[0], texts[1]) < 0.3
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == [0, 1, 2]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (7, 7), (200, 0)], "u long, v long")
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 102: 100, 0: 0, 200: 0}
    assert components.components(edges.limit(0)).count() == 0


def brute_removed(texts, length):
    counts = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            counts[t[i : i + length]] = counts.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        mask = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                mask[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(t)) if mask[i] and (i == 0 or not mask[i - 1]))
        out.append((len(t), sum(mask), spans, hashlib.sha256(bytes(c for c, m in zip(t, mask, strict=True) if not m)).hexdigest()))
    return out


@pytest.mark.parametrize("max_slices", [200_000, 1])
def test_repeats(spark, empty, max_slices):
    rng = np.random.default_rng(2)
    word = lambda n: "".join(rng.choice(list("abcdé "), n))
    passage, other = word(300), word(260)
    texts = [word(500), word(80) + passage + word(90), passage + word(40), word(10) + passage[:230], "ab" * 400, "z" * 250, "z" * 199, "", None, other + word(1) + other, word(700)]
    texts += [texts[0], texts[10][:450] + "X" + texts[10][450:], passage[50:] + word(200)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, word(300))], "doc_id long, text string")
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    want = sorted((str(k), *x) for (k, _), x in zip(rows, brute_removed([t for _, t in rows], 200), strict=True))
    got = repeats.repeated_spans(docs, max_slices=max_slices).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want
    assert repeats.repeated_spans(empty).count() == 0


def test_repeats_of_odd_rows(odd):
    got = {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in repeats.repeated_spans(odd).collect()}
    assert got[(3, 441)] == 441 and got[(5, 300_000)] == 300_000 and got[(1, 0)] == 0


@pytest.mark.parametrize(("step", "hold", "alphabet"), [(1 << 20, 1 << 18, 2048), (16, 4, 2048), (16, 4, 3)])
def test_external_suffixes(tmp_path, monkeypatch, step, hold, alphabet):
    for name, value in (("STEP", step), ("HOLD", hold), ("ALPHABET", alphabet), ("KEEP", hold)):
        monkeypatch.setattr(external_sa, name, value)
    rng = np.random.default_rng(4)
    for k in range(60):
        n, s = int(rng.integers(0, 70)), int(rng.choice([1, 2, 3, 5]))
        base = rng.integers(1, s + 1, n)
        if k % 2 and n > 20:
            base = np.concatenate([base[:20], base])
        text = np.append(base, 0).astype(np.uint8)
        cap = int(rng.choice([4, 10, 100]))
        folder = tmp_path / str(k)
        folder.mkdir()
        got = np.concatenate([x.copy() for x in external_sa.suffixes(text, s + 1, cap, str(folder))])
        assert sorted(got["pos"].tolist()) == list(range(len(text)))
        for a, b, lcp in zip(got["pos"], got["pos"][1:], got["lcp"][1:], strict=False):
            x, y = text[a : a + cap].tolist(), text[b : b + cap].tolist()
            same = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
            assert x <= y and same == lcp


def test_external_suffixes_in_bounded_memory(tmp_path, monkeypatch):
    """Four times the text takes no more memory: what is as long as the text lies on disk."""
    import tracemalloc

    for name, value in (("STEP", 1 << 13), ("HOLD", 1 << 13), ("KEEP", 1 << 13)):
        monkeypatch.setattr(external_sa, name, value)
    rng, peaks = np.random.default_rng(8), []
    words = [rng.integers(1, 27, rng.integers(2, 9)) for _ in range(4000)]
    for k, size in enumerate((150_000, 600_000)):
        folder = tmp_path / str(k)
        folder.mkdir()
        text = np.memmap(folder / "text", np.uint16, "w+", shape=(size,))
        at = 0
        while at < size - 1:
            word = words[int(rng.zipf(1.2)) % len(words)][: size - 1 - at]
            text[at : at + len(word)] = word
            at += len(word)
        tracemalloc.start()
        n = sum(len(x) for x in external_sa.suffixes(text, 27, 200, str(folder)))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert n == size
    assert peaks[1] < 1.5 * peaks[0] and peaks[1] < 12 << 20, peaks


def test_null_text_is_empty(spark):
    docs = spark.createDataFrame([(1, None)], "doc_id long, text string").withColumn("text", F.col("text"))
    assert simhash.near_duplicates(docs).first()["fp0"] == 0
