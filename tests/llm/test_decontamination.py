"""Benchmark passages against brute force: short, long, repeated and null items, several
automata, and documents cleaned."""

import random
import re

import pytest
from pyspark.sql import functions as F

from kredo.llm import decontamination
from kredo.llm.automaton import Automaton

SCHEMA = "doc_id long, text string, spans string, k1 long, items long, longest int"
ITEMS = "item_id string, text string, words string, part int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1, 2, 3) for i, t in rows], SCHEMA)


def items(spark, rows):
    return spark.createDataFrame([(i, t, "w", 1) for i, t in rows], ITEMS)


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(rows, item_rows, window=10):
    out = []
    for i, text in rows:
        w, hit, found, longest = words(text), set(), set(), 0
        for item, item_text in item_rows:
            v = words(item_text)
            k = min(window, len(v))
            for a in range(len(v) - k + 1) if v else ():
                for b in range(len(w) - k + 1):
                    if w[b:b + k] == v[a:a + k]:
                        hit |= set(range(b, b + k))
                        found.add(item or "")
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def sample(seed, n_words=30):
    rng = random.Random(seed)
    pick = lambda n: " ".join(rng.choice("abcdefgh"[:n_words]) for _ in range(rng.randint(0, 40)))
    bench = [(str(i), " ".join(rng.choice("abcd") for _ in range(rng.choice([0, 1, 2, 3, 6, 12, 25])))) for i in range(8)]
    rows = [(i, " ".join([pick(4), rng.choice(bench)[1], pick(8)])) for i in range(60)]
    return rows, bench


def got(df):
    return sorted(((r["doc_id"], r["n_words"], r["n"], r["items"]) for r in
                   df.withColumn("n", decontamination.n_hit(F.col("spans"))).collect()), key=str)


@pytest.mark.parametrize("seed,window,part_words", [(1, 10, 1 << 17), (2, 4, 1 << 17), (3, 4, 20), (4, 10, 15)])
def test_brute_force(spark, seed, window, part_words):
    rows, bench = sample(seed)
    found = decontamination.overlaps(docs(spark, rows), items(spark, bench), window=window, part_words=part_words)
    assert got(found) == brute(rows, bench, window)


def test_long_items_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "PIECE", 7)
    rows, bench = sample(5)
    bench.append(("long", " ".join(rows[0][1].split() + rows[1][1].split() + rows[2][1].split())))
    found = decontamination.overlaps(docs(spark, rows), items(spark, bench), window=6, part_words=40)
    assert got(found) == brute(rows, bench, 6)


def test_edges(spark):
    passage = "One two THREE four-five; six Ünï seven eight nine ten eleven"
    rows = [(1, None), (2, ""), (3, "... \n"), (4, passage.lower()), (4, passage.lower()), (4, "other words"),
            (None, "x " + passage), (5, "clean " * 30), (6, "y " * 200_000 + passage)]
    bench = [("a", passage), ("a", passage), ("b", None), (None, passage), ("c", ""), ("d", "zebra")]
    found = decontamination.overlaps(docs(spark, rows), items(spark, bench))
    assert got(found) == brute(rows, bench)
    none = items(spark, [])
    assert got(decontamination.overlaps(docs(spark, rows[:4]), none)) == brute(rows[:4], [])
    assert decontamination.overlaps(docs(spark, []), items(spark, bench)).count() == 0


def test_cleaning(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    clean = "Ä word " * 20
    rows = [(1, clean + passage.upper() + " end " + passage + "!"), (2, passage), (3, clean), (4, None), (1, "another of the id")]
    left = decontamination.without_passages(docs(spark, rows), items(spark, [("a", passage)]))
    assert left.columns == docs(spark, []).columns
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str) == sorted(
        [(1, clean + " end " + "!"), (3, clean), (4, None), (1, "another of the id")], key=str)
    assert decontamination.without_passages(docs(spark, rows), items(spark, [("a", passage)]),
                                            max_words=11, max_coverage=1.0).count() == 5


def test_automaton_reads_longest_matches():
    rng = random.Random(7)
    texts = [[rng.randint(0, 2) for _ in range(rng.randint(1, 15))] for _ in range(12)]
    made = Automaton()
    for t in texts:
        made.add(t)
    parts = {tuple(t[a:b]) for t in texts for a in range(len(t)) for b in range(a + 1, len(t) + 1)}
    read = [rng.randint(0, 3) for _ in range(300)]
    for i, (state, length) in enumerate(Automaton.of(*made.arrays()).read(read), 1):
        want = max((n for n in range(i + 1) if tuple(read[i - n:i]) in parts), default=0)
        assert length == want and (made.size[state] >= length > (made.size[made.link[state]] if state else -1))
