"""Each operator on nulls, empty texts, repeated rows, ties, clashing columns and empty
tables, and against brute force on a small table."""

import collections
import hashlib
import math
import random
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from kredo.llm import (bpe, exact_dedup, licences, line_dedup, lm_scoring, mixing, quality, simhash,
                       substring_dedup, url_filter)

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, source string, n_chars long, kept boolean, k1 long, word string, id string, fp long"


def docs(spark, rows):
    return spark.createDataFrame(
        [(i, t, s, None if t is None else len(t), True, 1, "w", "x", 2) for i, t, s in rows], SCHEMA)


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(["the", "of", "lorem", "ipsum", "dolor", "amet"]) + str(rng.randint(0, 300)) for _ in range(n))


LONG = prose(3000, 1)
ROWS = [(1, "One two three four five.", "a"), (2, None, "a"), (3, "", None), (4, "same text here", "b"),
        (4, "same text here", "b"), (5, "same text here", "c"), (None, "no id at all", "b"), (6, LONG, "c"),
        (7, LONG + " and an end", "c"), (8, " \n\t\n ", "a"), (9, "Licensed under the Apache License, Version 2.0.\nmore", "a")]


@pytest.fixture(scope="module")
def edge(spark):
    return docs(spark, ROWS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def spaced(text):
    return (text or "").encode().split()


def test_exact(edge, none):
    got = exact_dedup.exact_duplicates(edge).collect()
    assert len(got) == len(ROWS)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[2]["keep_id"] == 3 and by_id[2]["group_size"] == 2 and not by_id[2]["kept"] and by_id[3]["kept"]
    assert by_id[4]["keep_id"] == 5 and by_id[4]["group_size"] == 3
    assert by_id[None]["keep_id"] is None and by_id[None]["kept"]
    assert by_id[6]["text_sha256"] == hashlib.sha256(LONG.encode()).hexdigest()
    assert exact_dedup.drop_exact_duplicates(edge).count() == 8
    assert exact_dedup.exact_duplicates(none).count() == 0
    full = exact_dedup.exact_duplicates(edge, bits=7).collect()     # a filter that is full
    assert sorted(map(str, full)) == sorted(map(str, got))


def test_substring(spark, edge, none):
    rng = random.Random(4)
    shared = " ".join(prose(60, 9).split())
    rows = [*ROWS, (20, prose(50, 2) + " " + shared + " " + prose(30, 3), "a"), (21, shared, "b"),
            (22, "x " * 90, "b"), (23, prose(40, 5) + "\u00a0" + "y" * 50, "c")]
    rng.shuffle(rows)
    got = collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"])
                              for r in substring_dedup.remove_repeats(docs(spark, rows)).collect())
    seen = collections.Counter(tuple(spaced(t)[i:i + 35]) for _, t, _ in rows for i in range(len(spaced(t)) - 34))
    want = collections.Counter()
    for i, t, _ in rows:
        words = spaced(t)
        gone = {j for s in range(len(words) - 34) if seen[tuple(words[s:s + 35])] > 1 for j in range(s, s + 35)}
        want[i, len(words), len(gone), b" ".join(w for j, w in enumerate(words) if j not in gone).decode()] += 1
    assert got == want
    assert substring_dedup.remove_repeats(none).count() == 0


def test_lm_scores(edge, none):
    got = lm_scoring.score_documents(edge).collect()
    assert len(got) == len(ROWS)
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _, _ in ROWS}
    counts = collections.Counter()
    for i, t, _ in ROWS:
        if not held[i]:
            counts.update([*spaced((t or "").lower()), 0])
    n, v = sum(counts.values()), len(counts)
    want = {i: sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*spaced((t or "").lower()), 0]) for i, t, _ in ROWS}
    for r in got:
        assert r["train_tokens"] == n and r["held_out"] == held[r["doc_id"]]
        assert abs(r["base_score"] - want[r["doc_id"]]) < 1e-6 * abs(want[r["doc_id"]]) and r["score"] < 0
    assert lm_scoring.score_documents(none).count() == 0


def fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    ones = [sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def test_lm_words_are_those_of_a_plain_split(monkeypatch):
    import numpy as np
    import pyarrow as pa
    odd = ["", " ", "a  B\tC\x0b\x0c\r\n", "\x1c x\x1d", "É Ünï x  y à", "AAAA", "  lead", "trail  ", "\x85 q \x00z", "ẞ İ à b a b", *[t or "" for _, t, _ in ROWS]]
    texts = pa.array(["not in the slice", *odd]).slice(1)
    plain = [t.encode().lower().split() for t in odd]
    for at_once in (1 << 20, 16, 1):
        monkeypatch.setattr(lm_scoring, "TEXT_AT_ONCE", at_once)
        for parts in ([x for _, x in lm_scoring._slices(texts)], list(lm_scoring._gathered([texts.slice(0, 3), texts.slice(3)]))):
            got = []
            for part in parts:
                different, codes, first = lm_scoring._words(part)
                words = [w.encode() for w in different.to_pylist()]
                got += [[words[j] for j in codes[a:b]] for a, b in zip(first, first[1:])]
            assert got == plain
    voc = lm_scoring.Vocabulary([b"a", b"x"], np.array([5, 3]), 2, 9, 3, np.full(32, 9.0), np.full(32, 3.0), lm_scoring.LAYOUT)
    _, _, ranks, first, tokens = voc.read(texts)
    rank = {b"a": 1, b"x": 2}
    assert ranks.tolist() == [rank.get(w, 0) for t in plain for w in t]
    head = lm_scoring.LAYOUT.head
    assert [d.tolist() for d in lm_scoring._documents(first, tokens)] == [
        [*[rank.get(w) or head + lm_scoring.bin_of(w, 32) for w in t], 0] for t in plain]
    assert [len(x) for x in lm_scoring._words(pa.array([], pa.string()))] == [0, 0, 1]


def test_lm_learns_from_every_training_document(spark):
    layout = lm_scoring.LAYOUT
    for i in range(3):
        training = spark.createDataFrame([(i, "some words of a text")], "id long, text string")
        counts = lm_scoring.word_counts(training.select("text"))
        voc = lm_scoring._vocabulary(training, counts, layout)
        start = lm_scoring.gru.initial(layout, voc.weight)
        p = lm_scoring.train(training, spark.sparkContext.broadcast(voc), layout)
        assert any((p[k] != start[k]).any() for k in p)


def test_simhash(spark, edge, none):
    rows = [*ROWS, *[(30 + i, LONG.replace("lorem1 ", f"lorem1 new{i} "), "a") for i in range(6)]]
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    prints = [fingerprint(t) for _, t, _ in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                if (prints[a] ^ prints[b]).bit_count() <= 4:
                    group[a] = group[b] = min(group[a], group[b])
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None)
             for g in set(group)}
    want = collections.Counter((rows[i][0], f"{prints[i]:016x}", least[group[i]]) for i in range(len(rows)))
    assert collections.Counter(map(tuple, got)) == want
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.keep_first_of_each(edge).columns == edge.columns


def test_trie_links_of_dense_groups():
    import numpy as np
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 62)
    fps = np.unique([int(centre) ^ sum(1 << int(b) for b in rng.choice(62, 3)) for _ in range(300)]).astype(np.int64)
    found = set()
    bits = fps.view(np.uint64)
    simhash.trie_pairs(bits, np.array([[0, len(fps), 0, len(fps)]]), 4,
                       lambda i, j: found.update(zip(i.tolist(), j.tolist())))
    want = {(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if int(bits[a] ^ bits[b]).bit_count() <= 4}
    assert {(min(p), max(p)) for p in found} == want


def test_lines(spark, edge, none):
    rows = [(1, "Page 1 of 20 now\nfirst body of text", "a"), (2, "Page 2 of 20 now\nsecond body stands here", "a"),
            (3, "only words\nPage 7 of 9 now", "b"), (4, "Page 2 of 20 now", "b"), (5, None, None),
            (6, "send the file to Anna by noon please dear friend of mine", "b"),
            (7, "send the file to Bert by noon please dear friend of mine", "b")]
    got = {r["row"]["doc_id"]: r["kept_text"] for r in line_dedup.without_recurring_lines(docs(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: "second body stands here", 3: "only words", 4: "", 5: "", 6: rows[5][1], 7: ""}
    left = line_dedup.drop_recurring_lines(docs(spark, rows))
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 2, 3, 5, 6] and left.columns == edge.columns
    assert line_dedup.without_recurring_lines(edge).count() == len(ROWS)
    assert line_dedup.drop_recurring_lines(none).count() == 0


def kept_lines(spark, texts):
    rows = [(i, t, "a") for i, t in enumerate(texts)]
    got = line_dedup.without_recurring_lines(docs(spark, rows)).collect()
    return {r["row"]["doc_id"] for r in got if r["n_dropped"] == 0}


def test_lines_of_several_templates_in_a_leaf(spark):
    other = [f"This article was first seen in {x} Tribune Monday" for x in ("Rome", "Oslo", "Bonn")]
    mixed_end = [f"This article was posted near {x} for the Gazette" for x in ("Rome", "Oslo", "Bonn")]
    family = [f"This article was written by {x} for the Gazette" for x in ("Anna", "Bert")]
    assert kept_lines(spark, [*other, *family]) == {0, 3}
    assert kept_lines(spark, [*mixed_end, *family]) == {0, 3}


def test_lines_alike_by_chance_stay(spark):
    texts = ["He went to the store.", "He went to the hospital.", "3.14 2.71 1.41", "1969 07 20", "12 | 30 | 4", "7 | 8 | 9",
             "Page 1 of 20", "Page 2 of 21"]
    assert kept_lines(spark, texts) == set(range(8))
    # exact repeats go, and short generalised lines from the third document
    assert kept_lines(spark, [*texts, "1969 07 20", "He went to the store."]) == set(range(8))
    assert kept_lines(spark, [*texts, "Page 2 of 21"]) == set(range(7))
    assert kept_lines(spark, ["Page 2 of 21", "Page 2 of 21"]) == {0}


def test_quality(edge, none):
    got = {r["doc_id"]: r for r in quality.quality_flags(edge).collect()}
    assert got[2]["n_words"] == 0 and got[2]["base_failed"] and got[8]["n_lines"] == 0
    assert got[6]["n_words"] == 3000
    grams = collections.Counter(tuple(LONG.split()[i:i + 3]) for i in range(2998))
    covered = {j for i in range(2998) if grams[tuple(LONG.split()[i:i + 3])] > 1 for j in range(i, i + 3)}
    assert got[6]["n_repeat_words"] == len(covered)
    assert quality.quality_flags(none).count() == 0 and quality.keep_good(edge).columns == edge.columns


def test_bpe(edge, none):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(TOKENIZER)
    for piece in (1 << 15, 37):
        got = bpe.encode_decode(edge, TOKENIZER, piece=piece).collect()
        want = collections.Counter((i, str(tok.encode(t or "", add_special_tokens=False).ids), t or "") for i, t, _ in ROWS)
        assert collections.Counter((r["doc_id"], str(r["ids"]), r["decoded"]) for r in got) == want
    assert bpe.encode_decode(none, TOKENIZER).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_bpe_pieces(seed):
    from types import SimpleNamespace
    codec, rng = bpe.codec_of(TOKENIZER), random.Random(seed)
    kinds = ["abcdefghij", "the of and ", " \n\t a'sb'll 're 12", "\u00e9\u00df\u65e5\u672c\U0001f600", "!!!'???'t"]
    for n in (1, 40, 300, 9000):
        for kind in ("".join(kinds), kinds[0], kinds[3] + kinds[0]):
            text = "".join(rng.choice(kind) for _ in range(n))
            size = rng.randint(1, 30) if n < 1000 else rng.randint(400, 3000)
            pieces = [SimpleNamespace(**bpe._open_ends(text[i:i + size], codec)) for i in range(0, n, size)]
            assert bpe.joined_pieces(pieces, codec) == codec.tok.encode(text, add_special_tokens=False).ids


def test_special_tokens_in_long_texts(spark):
    text = "some words <|endoftext|> and more " * 40
    got = bpe.encode_decode(docs(spark, [(1, text, "a")]), TOKENIZER, piece=50).first()
    assert list(got["ids"]) == bpe.codec_of(TOKENIZER).tok.encode(text, add_special_tokens=False).ids
    assert got["decoded"] == text


def test_licences(edge, none):
    rows, _ = licences.scan(edge)
    got = {r["doc_id"]: list(r["licences"]) for r in rows.collect()}
    assert got[9] == ["apache"] and not any(v for k, v in got.items() if k != 9)
    assert rows.count() == len(ROWS) and licences.scan(none)[0].count() == 0


def test_licences_of_two_notices_in_a_line(spark):
    filler = "the river went on past the old mill and the children played there until dusk " * 20
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    texts = [f"{mit} {apache}", "Licensed under the MIT license or the Apache License, Version 2.0.",
             f"{filler}. {mit} {filler}. {apache} {filler}", apache,
             "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"]
    rows, _ = licences.scan(docs(spark, [(i, t, "a") for i, t in enumerate(texts)]))
    got = {r["doc_id"]: list(r["licences"]) for r in rows.collect()}
    both = ["apache", "mit"]
    assert got == {0: both, 1: both, 2: both, 3: ["apache"], 4: ["lgpl"]}


def test_licences_in_paragraphs_without_a_licence_word(spark):
    import re

    notices = {0: "to deal in the Software without restriction, obtaining a copy of this software and associated documentation files",
               1: "You should have received a copy of the GNUGeneral Public along with this program; you can use it under the terms "
                  "as published by the Free Software Foundation, either version 3, or (at your option) any later version."}
    term = re.compile(licences.TERMS[4:], re.IGNORECASE)
    assert not any(term.search(x) for x in notices.values())
    prose = "She walked along the river and came home late. The children were asleep by then."
    texts = {**notices, 2: prose, 3: "", 4: "Она шла вдоль реки.", 5: f"{prose}\n{notices[0]}"}
    classifier = licences.train(spark.createDataFrame([(prose,)], "text string"))      # not on the notices
    rows, statements = licences.scan(docs(spark, [(i, t, "a") for i, t in texts.items()]), classifier=classifier)
    got = {r["doc_id"]: list(r["licences"]) for r in rows.collect()}
    assert got == {0: ["mit"], 1: ["gpl"], 2: [], 3: [], 4: [], 5: ["mit"]}
    assert [r["no"] for r in statements.where("id = 5").collect()] == [1]


def test_paragraphs_that_are_left_whole_have_no_piece_but_prose(spark):
    """Notices in all manner of company: what the bound leaves out holds prose alone, piece by
    piece, and most ordinary paragraphs are left out."""
    rng = random.Random(21)
    notices = [x for _, x in licences.TEMPLATES] + list(licences.UNKNOWN) + list(licences.PROSE)
    words = sorted({w for x in notices for w in x.split()} | {"river", "e.g.", "3.5", "naïve", "日本", "and/or", "x/or", "a\x00b"})
    ordinary = [prose(rng.randint(1, 300), i) for i in range(60)]
    odd = ["", " ", ".", "or", "©", "Version 2.0", "BY 4.0/or CC BY-SA 4.0 and MIT."]
    for _ in range(150):
        parts = [" ".join(rng.choices(words, k=rng.randint(1, 40))), rng.choice(notices), rng.choice(ordinary)]
        joint = rng.choice([" ", ". ", " or ", "/or ", " and/or ", "\t", ".\u00a0", "/"])
        odd.append(joint.join(rng.sample(parts, rng.randint(1, 3))))
    table = spark.createDataFrame([(i, t) for i, t in enumerate(ordinary + odd)], "no int, text string").cache()
    classifier = licences.train(table.select("text"))
    kept = {r["no"] for r in licences._open(table, classifier).collect()}
    pieces = table.select("no", F.inline(licences._pieces("text"))).withColumnRenamed("piece", "text")
    statements = {r["no"] for r in licences.classified(pieces, classifier).where(F.col("family") != licences.NONE).collect()}
    assert statements and statements <= kept
    assert sum(i in kept for i in range(len(ordinary))) < len(ordinary) / 2
    table.unpersist()


def test_licence_tokens(spark):
    texts = ["a.b 3.5 .5 e.g. x... end.", "©2020 CC-BY 4.0.", "a\x00b\x01c\td", "naïve Kelvin \u212a \u0130 日本.5 x😀y", ".", "", "..5. 6..", "A_B~c"]
    table = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = F.array_remove(F.split(F.lower(F.regexp_replace("text", r"[^A-Za-z0-9©.]+|\.(?![0-9])", " ")), " +"), "")
    for row in table.select("text", licences.tokens(F.col("text")).alias("got"), plain.alias("want")).collect():
        assert row["got"] == row["want"], row["text"]


def test_removal_goes_by_row_not_by_id(spark):
    rows = docs(spark, [(None, "A", "a"), (5, "A", "a"), (None, "B", "a")])
    assert sorted((str(r["doc_id"]), r["text"]) for r in exact_dedup.drop_exact_duplicates(rows).collect()) == [("5", "A"), ("None", "B")]
    a, b = prose(80, 1), prose(80, 2)
    rows = docs(spark, [(3, a, "a"), (5, a, "a"), (5, b, "a"), (None, a, "a"), (7, b, "b"), (7, b, "b")])
    left = simhash.keep_first_of_each(rows)
    assert sorted((str(r["doc_id"]), r["text"]) for r in left.collect()) == sorted([("3", a), ("5", b), ("None", a)])
    assert left.columns == rows.columns


def test_pipeline_edges(spark, edge, none):
    """Every stage on null, empty, repeated rows and clashing columns, and on no rows."""
    import corpus_pipeline
    for rows in (edge, none):
        now = rows
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, "")
            if name != "bpe":
                assert now.columns == rows.columns, name
        assert now.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
        assert {r["doc_id"] for r in now.collect()} <= {i for i, _, _ in ROWS}


def test_quality_of_other_scripts(spark):
    russian = ("Вечером в деревне было тихо и только старый мельник сидел у окна читая письмо сына который давно уехал на север "
               "где строили новую железную дорогу через болота леса и горы а зимой там стояли такие морозы что птицы замерзали "
               "на лету и люди грелись возле больших костров рассказывая друг другу длинные истории про тёплое море виноградники "
               "белые города и далёкие острова")
    rng = random.Random(3)
    chinese = "\n".join(" ".join("".join(chr(rng.randint(0x4E00, 0x8000)) for _ in range(18)) for _ in range(5)) for _ in range(14))
    shouting = russian.upper().replace(" ", "! ")
    latin = "blorp zindle quaffer mumbly frotz gnusto rezrov yomin tharn wibble " * 1 + " ".join(f"zork{chr(97 + i % 26)}{i}" for i in range(60))
    rows = [(1, russian, "a"), (2, chinese, "a"), (3, shouting, "a"), (4, latin, "a")]
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality.quality_flags(docs(spark, rows)).collect()}
    assert got == {1: (False, True), 2: (False, True), 3: (False, False), 4: (False, False)}


def test_mixing(edge, none):
    got = mixing.mix_report(edge, block_words=16).collect()
    assert len(got) == len(ROWS)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    sizes, taken, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        sizes[r["source_size"]] += r["size"]
        taken[r["target"]] += r["taken"]
    for t, n in taken.items():
        assert abs(t - n) <= 1
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_report(edge, block_words=16).collect()))
    mixed = mixing.mixed_documents(edge, block_words=16)
    words = sum(len(spaced(r["text"])) for r in mixed.collect())
    assert words == sum(taken.values()) and mixed.columns == edge.columns
    assert mixing.mix_report(none).count() == 0


def test_urls(spark):
    rng = random.Random(5)
    urls = [None, "", "no scheme", "http://ORG", "http://a.org/", "https://x.example.org/es/1?q", "http://example.org/en/12#a",
            "http://org/en/1", "ftp://b.com/fr/", "http://b.com?x/de/", "http://b.com/de/1", "http://b.com/de/1", "x://y://com/de/"]
    urls += [f"http://{rng.choice(['a', 'b.c', ''])}.{rng.choice(['org', 'com', 'example.org'])}/{rng.choice(['es', 'de', 'en/1', 'fr'])}/{i}" for i in range(40)]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    rules = [*url_filter.RULES, ("com", "/de/1", "allow"), ("com", "/de/1", "block")]

    def want(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        fits = [(len(h + p), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, v, r = max(fits, default=(0, "allow", None))
        return host, path, r, v
    for sweep_rows in (1, 256):
        got = url_filter.judge_urls(pages, url_filter.rules_table(spark, rules), sweep_rows=sweep_rows).collect()
        assert {r["page_id"]: tuple(r)[1:] for r in got} == {i: want(u) for i, u in enumerate(urls)}
    assert url_filter.judge_urls(pages, url_filter.rules_table(spark, ())).where("verdict <> 'allow'").count() == 0


def test_pipeline(spark):
    import corpus_pipeline
    done = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert done.count() > 0 and done.where(F.size("ids") != F.col("n_tokens")).count() == 0


def test_urls_of_one_hot_domain(spark):
    """Most pages of one domain, more rules than a sweep has rows, and no pages at all."""
    rng = random.Random(12)
    schema = "page_id long, url string, host string, rev string, salt int"
    urls = [f"http://{rng.choice(['a.', 'b.c.', ''])}Hot.com/{rng.choice('xyz')}/{rng.randint(0, 40)}" for _ in range(400)] + ["http://cold.org/x", None, "x"]
    pages = spark.createDataFrame([(i, u, "h", "r", 1) for i, u in enumerate(urls)], schema)
    listed = [("com", "/", "allow"), ("hot.com", "/x/", "block"), ("hot.com", "/x/1", "allow"), ("c.hot.com", "/", "block"),
              ("com", "/y/2", "block"), *[("hot.com", f"/z/{i}", "block") for i in range(20)]]
    rules = spark.createDataFrame(listed, "host string, path string, verdict string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, rules, sweep_rows=8).collect()}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host, path = (rest.split("/", 1)[0].lower(), "/" + rest.split("/", 1)[1]) if "/" in rest else ("", "")
        fits = [(len(h + p), h + p, v) for h, p, v in listed if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = max(fits)[1:] if fits else (None, url_filter.DEFAULT)
        assert got[i] == want, (u, got[i], want)
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0
