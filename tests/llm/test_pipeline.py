import re
import zlib
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from tablewright.llm import common, decontaminate, langid, secrets, simhash, tokens

from .test_near import brute_similarity
from .test_text import brute_coverage, brute_secrets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def brute_near(rows):
    """The smallest doc_id of each group of texts linked by a similarity of 0.8 or more."""
    up = {k: k for k, _ in rows}
    grams = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for k, t in rows}
    for a, b in combinations(sorted(up), 2):
        if up[a] != up[b]:
            x, y = grams[a], grams[b]
            if (not x and not y) or (min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y)):
                low, high = sorted((up[a], up[b]))
                up = {k: low if v == high else v for k, v in up.items()}
    return set(up.values())


def brute_clean(text, items):
    """Whether no item is covered by half or more."""
    words = re.findall(r"\w+", text.lower())
    grams = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
    for item in items:
        if item and not grams.isdisjoint({tuple(item[i : i + 5]) for i in range(len(item) - 4)}):
            known = set(item)
            if brute_coverage(item, [w if w in known else object() for w in words], 5) >= 0.5:
                return False
    return True


def test_stages_equal_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = common.read_table(spark, sf, "documents")
    items = [re.findall(r"\w+", (r["text"] or "").lower()) for r in common.read_table(spark, sf, "benchmark").collect()]
    model = langid.learn(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r.asDict() for r in docs.collect()}
        found = secrets.train(secrets.scan(docs)) if name == "secret_scan" else None
        docs = common.saved(stage(spark, docs, sf), name)
        assert docs.columns == COLUMNS
        after = {r["doc_id"]: r.asDict() for r in docs.collect()}
        if name == "language_id":
            keys = list(before)
            kept = {k for k, (lang, p) in zip(keys, model.predict([before[k]["text"] for k in keys]), strict=True) if lang != "und" and p >= langid.MIN_SCORE}
        elif name == "simhash_near_dedup":
            kept = brute_near([(k, r["text"]) for k, r in before.items()])
        elif name == "benchmark_decontamination":
            kept = {k for k, r in before.items() if brute_clean(r["text"], items)}
        else:
            kept = set(before)
        assert set(after) == kept, name
        for k in kept:
            if name != "secret_scan":
                assert after[k] == before[k]
                continue
            text, base = before[k]["text"], brute_secrets(before[k]["text"])
            own = [[(a, b, secrets.window(text, a, b)) for a, b in secrets.candidates(text, text.encode())]]
            gone = np.zeros(len(text), bool)
            spans = [(a, b) for a, _, b in [*base, *secrets.added(found, [base], own)[0]]]
            for a, b in spans:
                gone[a:b] = True
            starts = {a for a, b in spans if a == 0 or not gone[a - 1] or not any(x < a < y for x, y in spans)}
            want = "".join("[SECRET]" * (i in starts) + ("" if gone[i] else c) for i, c in enumerate(text))
            assert after[k]["text"] == want and after[k]["n_chars"] == len(want)
    enc = tokens.encoder(tokens.default_path())
    pieces = {}
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect():
        pieces.setdefault(r["doc_id"], []).append(r)
    assert set(pieces) == set(after)
    for k, own in pieces.items():
        ids = np.append(np.frombuffer(enc.whole(after[k]["text"]), "<u4"), 0).astype("<u4")
        own = sorted(own, key=lambda r: r["piece"])
        assert [r["start"] for r in own] == [sum(x["length"] for x in own[:i]) for i in range(len(own))]
        assert all(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in own) and sum(r["length"] for r in own) == len(ids)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_and_empty_tables(spark, odd, empty, name):
    stage, sf = dict(corpus_pipeline.STAGES)[name], "/root/testdata/sf0.001"
    got = stage(spark, odd, sf)
    n = {"language_id": None, "simhash_near_dedup": 6, "benchmark_decontamination": odd.count(), "secret_scan": odd.count()}.get(name)
    assert n is None or got.count() == n
    if name == "best_fit_packing":
        assert got.select("doc_id").distinct().count() == odd.select("doc_id").distinct().count()
    else:
        assert got.columns == odd.columns
    assert stage(spark, empty, sf).count() == 0


def test_near_copies_go(spark):
    base = " ".join(f"word{i}" for i in range(200))
    near = base.replace("word77 ", "other ")
    assert brute_similarity(base, near) >= 0.8
    docs = spark.createDataFrame([(1, base), (2, near), (3, base), (4, " ".join(f"else{i}" for i in range(200)))], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == [1, 4]


def test_best_covered_item_of_a_document(spark, tmp_path):
    """The answer of the query: the best covered item, the smallest of equals, and how many are covered by half."""
    a, b, c = (" ".join(f"{k}{i}" for i in range(20)) for k in "abc")
    texts = {1: f"x {a} y {' '.join(b.split()[:12])}", 2: " ".join([*b.split()[10:], "z", *b.split()[:10]]), 3: " ".join(c.split()[:9]), 4: f"{a} {c}", 5: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, a), (8, b), (9, c), (10, c)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["doc_id"]: (r["item_id"], round(r["coverage"], 3), r["n_items"]) for r in decontaminate.op1_greedy_tiling_decontamination(spark, str(tmp_path)).collect()}
    want = {}
    for k, text in texts.items():
        shares = [(brute_coverage(x.split(), (text or "").split(), 5), -i) for i, x in ((7, a), (8, b), (9, c), (10, c))]
        if max(shares)[0] >= 0.5:
            want[k] = (-max(shares)[1], round(max(shares)[0], 3), sum(s >= 0.5 for s, _ in shares))
    assert got == want and set(got) == {1, 2, 4}
