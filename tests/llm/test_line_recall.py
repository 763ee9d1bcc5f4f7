"""How many of the lines that a brute-force parser of the same rule groups are found."""

import collections
import random

from kredo.llm import line_dedup as L
from kredo.llm.scratch import Scratch


def test_recall_against_all_pairs(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(400)]
    lines = []
    for _ in range(120):                     # families that share four openings
        base = rng.choice(["then last night", "the old man", "in the end", "dear sir madam"]).split() + [rng.choice(words) for _ in range(12)]
        for _ in range(rng.randint(1, 25)):
            line = list(base)
            for _ in range(rng.randint(0, 2)):
                line[rng.randint(3, 14)] = rng.choice(["he", "she", "they", "we"])
            lines.append(" ".join(line))
    rng.shuffle(lines)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    raw, scratch = L._raw_lines(docs, "doc_id", "text"), Scratch(spark, "recall")
    parsed = scratch.keep(L._lines(raw, L.DEPTH, L.MIN_SHARE))
    adopted = L._adopted(raw, parsed.drop("tokens"), scratch, L.DEPTH, L.MIN_SHARE)
    found = {(r["leaf"], r["line"]) for r in adopted.select("leaf", "line").collect()}
    leaves = collections.defaultdict(dict)
    for r in parsed.where("leaf IS NOT NULL").collect():
        leaves[r["leaf"]][r["line"]] = r["tokens"][L.DEPTH:]
    wanted = set()
    for leaf, members in leaves.items():
        for a, x in members.items():
            if any(a != b and sum(p == q for p, q in zip(x, y)) >= L.MIN_SHARE * len(x) for b, y in members.items()):
                wanted.add((leaf, a))
    assert len(wanted) > 800 and len(wanted & found) >= 0.99 * len(wanted)
