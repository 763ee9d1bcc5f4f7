"""Ranked search against brute force: ties, copies, full signatures, several batches."""

import collections
import math
import random
import re

import numpy as np
import pytest

from kredo.llm import lexical_search

SCHEMA = "doc_id long, text string, item_id string, score long, k1 long, rank int"
ITEMS = "item_id string, text string, part int, words string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1, 2, 3) for i, t in rows], SCHEMA)


def items(spark, rows):
    return spark.createDataFrame([(i, t, 1, "w") for i, t in rows], ITEMS)


def terms(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(rows, item_rows, k=10):
    held = [(i, collections.Counter(terms(t))) for i, t in rows]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = collections.Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in dict.fromkeys(item_rows):
        scored = []
        for i, c, n in held:
            m = 25 + 75 * n * n_docs // n_terms
            score = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                        for t, r in collections.Counter(terms(text)).items())
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def got(df):
    return sorted([(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()], key=str)


def sample(seed, n=400):
    rng = random.Random(seed)
    word = lambda: "w" + str(int(rng.paretovariate(0.7)) % 700)
    text = lambda m: " ".join(word() for _ in range(m))
    rows = [(i, text(rng.choice([1, 3, 20, 60, 300]))) for i in range(n)]
    rows += [(n + i, rows[i % 5][1]) for i in range(120)]           # copies
    bench = [(str(i), text(rng.choice([1, 5, 30]))) for i in range(25)]
    return rows, bench + [("copy", rows[3][1]), ("twice", bench[0][1]), ("twice", bench[0][1])]


@pytest.mark.parametrize("seed,k,batch_terms", [(1, 10, 4096), (2, 3, 60), (3, 10, 1)])
def test_brute_force(spark, seed, k, batch_terms):
    rows, bench = sample(seed, 400 if batch_terms > 1 else 60)
    bench = bench if batch_terms > 1 else bench[-5:]
    found = lexical_search.search(docs(spark, rows).repartition(5), items(spark, bench), k=k, batch_terms=batch_terms)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert got(found) == brute(rows, bench, k)


@pytest.mark.parametrize("setting", [("ENTRY_BITS", 1), ("BLOCK_DOCS", 7), ("DICTIONARY", 20), ("BLOCK_ENTRIES", 50)])
def test_full_signatures_and_small_blocks(spark, monkeypatch, setting):
    monkeypatch.setattr(lexical_search, *setting)
    rows, bench = sample(4, 150)
    assert got(lexical_search.search(docs(spark, rows), items(spark, bench))) == brute(rows, bench)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "..."), (4, "Alpha beta"), (4, "Alpha beta"), (4, "alpha"), (None, "alpha beta"),
            (5, "x " * 300_000 + "alpha"), (6, "ÄÖ äö 7"), (-7, "gamma_gamma")]
    bench = [("a", "ALPHA"), ("b", None), (None, "beta alpha alpha"), ("c", ""), ("d", "none of these"), ("e", "Äö gamma 7")]
    assert got(lexical_search.search(docs(spark, rows), items(spark, bench))) == brute(rows, bench)
    assert lexical_search.search(docs(spark, rows), items(spark, [])).count() == 0
    assert lexical_search.search(docs(spark, []), items(spark, bench)).count() == 0
    assert lexical_search.search(docs(spark, rows[:3]), items(spark, bench)).count() == 0


def test_bounds_hold_and_exclude(spark, tmp_path):
    rows, bench = sample(6)
    index = lexical_search.build_index(docs(spark, rows).coalesce(1), str(tmp_path / "index"))
    vocabulary = sorted({w for _, t in bench for w in terms(t)})
    hashes = np.sort(np.array([lexical_search.hash_of(w.encode()) for w in vocabulary], np.int64).view(np.uint64))
    place = {int(h): i for i, h in enumerate(hashes)}
    asked = []
    for _, t in bench:
        c = collections.Counter(place[lexical_search.hash_of(w.encode()) % 2**64] for w in terms(t))
        asked.append((np.array(list(c)), np.array(list(c.values()), np.int64)))
    held = {i: collections.Counter(terms(t)) for i, t in rows}
    n_terms = sum(sum(c.values()) for c in held.values())
    above, total = 0, 0
    for block in index.where("slices IS NOT NULL").collect():
        upper = lexical_search._upper(block, lexical_search.Query(hashes, asked), len(rows), n_terms)
        for j, i in enumerate(block["ids"]):
            n = sum(held[i].values())
            m = 25 + 75 * n * len(rows) // n_terms
            for q, (_, t) in enumerate(bench):
                exact = sum(r * (10**9 * held[i][w] // (1000 * held[i][w] + 8 * m)) for w, r in collections.Counter(terms(t)).items())
                assert upper[q, j] >= exact
                above += bool(upper[q, j] > 1.2 * exact)
                total += 1
    assert above < 0.1 * total
    assert sum(len(b["ids"]) for b in index.where("slices IS NOT NULL").collect()) == len(rows)
