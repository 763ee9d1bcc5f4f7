"""Tokens of two tokenizers against a plain loop over bytes; fragments composed in any way."""

import collections
import hashlib
import random

import numpy as np
import pytest

from kredo.llm import alignment

public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, pairs string, n_a int, k1 long, ok boolean, id string, no int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "p", 1, 2, True, "x", 3) for i, t in rows], SCHEMA)


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(["über", "the", "Łódź", "tokenization", "日本語", "x=1;", "naïve\n", " 42", "unsplit" * 9]) for _ in range(n))


ROWS = [(1, None), (2, ""), (3, " "), (4, "Hello  world!\n\n\tand <|endoftext|> <s> <0x0A> more"), (4, "other"), (5, "a▁b"),
        (6, prose(300, 1)), (6, prose(300, 1)), (7, prose(40, 2)), (None, "no id"), (8, "w" * 3000), (9, "日本" * 400),
        (10, "  lead and trail  "), (11, " x 　y\x00z​ 🙂🙂 fin"), (12, ("ab cd " * 200) + "▁" + " ef" * 50)]


def library(text):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    a = t.encode(" " + text, add_special_tokens=False)
    s = SentencePieceProcessor(model_file=B)
    b = s.encode(text)
    shown = {chr(x): x for x in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    shown.update({chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in shown.values())})
    bytes_a = [bytes(shown[c] for c in t.id_to_token(i)) for i in a.ids]
    bytes_b = [bytes([int(s.id_to_piece(i)[3:5], 16)]) if s.is_byte(i) else s.id_to_piece(i).replace("▁", " ").encode() for i in b]
    return a.ids, b, bytes_a, bytes_b


def brute(rows):
    found = []
    for i, text in rows:
        if not text:
            found.append((i, None))
            continue
        a, b, bytes_a, bytes_b = library(text)
        if not (b"".join(bytes_a) == b"".join(bytes_b) == b" " + text.encode()):
            found.append((i, None))
            continue
        spans = []
        for ids, parts in ((a, bytes_a), (b, bytes_b)):
            at, out = 0, []
            for x, p in zip(ids, parts):
                out.append((at, at + len(p), x))
                at += len(p)
            spans.append(out)
        links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]]
        ends = sorted({x[1] for x in spans[0]} & {y[1] for y in spans[1]})
        groups = [tuple(",".join(str(x[2]) for x in s if lo < x[1] <= hi) for s in spans) for lo, hi in zip([0, *ends], ends)]
        found.append((i, (len(a), len(b), links, ";".join("|".join(g) for g in groups), len(groups))))
    count = collections.Counter(p for _, f in found if f for p in f[2])
    top = collections.defaultdict(int)
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    out = []
    for i, f in found:
        out.append((i, 0, 0, 0, 0, 0, 0, "") if f is None else (
            i, f[0], f[1], f[4], len(f[2]), sum(count[p] == top[p[1]] for p in f[2]), sum(count[p] for p in f[2]),
            hashlib.sha256(f[3].encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))
                   for r in df.collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"size": 40, "fan": 4, "longest": 1 << 13}, {"size": 7, "fan": 64, "longest": 1 << 14},
                                     {"part_pairs": 100}])
def test_brute_force(spark, options):
    assert got(alignment.aligned_corpus(docs(spark, ROWS), A, B, **options)) == brute(ROWS)


def test_empty(spark):
    assert alignment.aligned_corpus(docs(spark, []), A, B).count() == 0
    assert got(alignment.aligned_corpus(docs(spark, ROWS[:2]), A, B)) == brute(ROWS[:2])


def test_groups_text(spark):
    r = alignment.align(docs(spark, [(1, "Hello world")]), A, B).first()
    a, b, *_ = library("Hello world")
    assert r["groups"] == ";".join(f"{x}|{y}" for x, y in zip(a, b)) and r["n_links"] == r["n_groups"] == 2


def test_composing_is_associative():
    t = alignment.tokenizers_of(A, B)
    text = prose(120, 3)
    data = b" " + text.encode()
    a, b, _ = t.plainly([text])[0]
    whole = alignment._summary(a, b, t)
    rng = random.Random(5)
    end_a, end_b = np.cumsum(t.length_a[a]), np.cumsum(t.length_b[b])
    open_ends = 0
    for _ in range(20):
        cuts = sorted(rng.sample(range(1, len(data)), 30))
        parts = []
        for s, e in zip([0, *cuts], [*cuts, len(data)]):
            (i, j), (k, m) = (np.searchsorted(x, [s, e], "right") for x in (end_a, end_b))
            parts.append(alignment.Fragment.of(a[i:j], b[k:m], int(end_a[i - 1]) if i else 0, int(end_b[k - 1]) if k else 0, t))
        open_ends += sum(bool(len(p.suffix[0]) or len(p.suffix[1]) or not p.cut) for p in parts)
        while len(parts) > 1:
            n = rng.randint(1, 3)
            at = rng.randrange(len(parts))
            parts[at:at + n] = [alignment.Fragment.composed(parts[at:at + n], t)]
        done = parts[0].finished(t)
        assert done[0] == whole[0] and done[1] == whole[1]
        assert done[2].tolist() == whole[2].tolist() and done[3].tolist() == whole[3].tolist()
    assert open_ends > 100


def test_ranges_cover_the_text():
    for text in ("word " * 500, "x" * 900 + " y" * 300, "日本 語" * 90, " ", "a  b   c    d" * 50):
        data = b" " + text.encode()
        found = alignment.ranges(data, 32)
        assert [r[1] for r in found] == [0, *[r[2] for r in found[:-1]]] and found[-1][2] == len(data)
        assert sum(r[3] - r[0] for r in found) <= 5 * len(data) + 100
        assert all(low <= start < end <= high for low, start, end, high in found)


def test_word_by_word_is_as_a_whole(monkeypatch):
    t = alignment.Tokenizers(A, B)
    rng = random.Random(9)
    parts = ["a", "\n", "\t", " ", "the", "Über", "\u00a0", "\u3000", "日", "'s", "!!", "12", "\x1c", "▁", "é", "x\ny"]
    texts = [x or "" for _, x in ROWS] + ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(1, 12)))
                                          for _ in range(3000)]
    for kept in (1 << 18, 50):
        monkeypatch.setattr(alignment.Words, "KEPT", kept)
        for low in range(0, len(texts), 100):
            some = texts[low:low + 100]
            for text, x, y in zip(some, t.encode(some), t.plainly(some)):
                assert x[2] == y[2] and (not x[2] or [z.tolist() for z in x[:2]] == [z.tolist() for z in y[:2]]), repr(text)
    assert sum(x is not None for x in t.words.encode(texts)) > 500
