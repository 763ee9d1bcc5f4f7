"""Quality rules: a table of thresholds compiled into one projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kredo.llm.text import SPACE_RUN, WORD_CHAR, whole

# Frequent words of English, French, German and Spanish prose.  A clean text
# in another language of Latin script has to hold one word of a hundred that is among them
# (Italian, Portuguese or Dutch do; others may not).
STOP_WORDS = (
    "a an and as at be by for from in is it of on or that the this to was were with "
    "au dans de des du en est et il la le les ne par pas pour que qui sur un une "
    "auf das dem den der des die ein eine ist mit nicht sich und von zu im "
    "como con del el ella en es la las los no para por que se su un una y").split()


@dataclass(frozen=True)
class Rule:
    """A ratio must lie in [least, most]; a side that is None is open.  A rule of Latin
    script holds for texts of which at most half the characters are of other scripts."""
    name: str
    ratio: str
    least: float | None = None
    most: float | None = None
    latin: bool = False


# Characters beyond the Latin blocks and general punctuation.
OTHER_SCRIPT = r"[^\x00-\x{24F}\x{1E00}-\x{1EFF}\x{2000}-\x{206F}]+"


# Ratios are SQL over the measures of ``measures``.
RULES = (
    Rule("word_length", "word_chars / n_words", 3.0, 12.0, latin=True),
    Rule("symbols", "n_symbols / n_words", None, 0.1),
    Rule("shouting", "n_marks / n_words", None, 0.25),
    Rule("capitals", "n_capitals / word_chars", None, 0.4),
    Rule("stop_words", "n_stop_words / n_words", 0.01, None, latin=True),
    Rule("repeated_lines", "n_dup_lines / n_lines", None, 0.3),
    Rule("ellipsis_lines", "n_ellipsis_lines / n_lines", None, 0.3),
    Rule("bullet_lines", "n_bullet_lines / n_lines", None, 0.9),
)


def _let(value: str, name: str, body: str) -> str:
    """SQL that evaluates ``value`` once and uses it as ``name`` in ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _repeat_words(w: str) -> str:
    """SQL for the words of ``w`` in three-word windows that are found twice or more.

    Windows are hashed to 64 bits; if a distinct count shows repeats, (hash,
    position) pairs are sorted, those with an equal neighbour are kept, and the
    positions they cover are added up in order."""
    n = f"size({w}) - 2"
    hashes = f"transform(arrays_zip(slice({w}, 1, {n}), slice({w}, 2, {n}), slice({w}, 3, {n})), x -> xxhash64(x))"
    pairs = "array_sort(transform(h, (x, i) -> struct(x AS h, i AS i)))"
    equal = ("filter(s, (e, k) -> CASE WHEN k > 0 AND s[k - 1].h = e.h THEN true "
             "WHEN k + 1 < size(s) THEN s[k + 1].h = e.h ELSE false END)")
    covered = (f"aggregate(array_sort(transform({equal}, e -> e.i)), struct(-3 AS last, 0 AS n), "
               "(a, p) -> struct(p AS last, a.n + least(3, p - a.last) AS n), a -> a.n)")
    found = f"CASE WHEN size(array_distinct(h)) = size(h) THEN 0 ELSE {_let(pairs, 's', covered)} END"
    return f"CASE WHEN size({w}) < 4 THEN 0 ELSE {_let(hashes, 'h', found)} END"


def _measures(text: str) -> str:
    """SQL struct of the counts the rules use, over the column ``text``.  Every
    count is 0 for an empty text."""
    stop = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))

    def chars(pattern: str) -> str:
        return f"char_length({text}) - char_length(regexp_replace({text}, r'{pattern}', ''))"

    of_lines = ("named_struct('n_lines', size(l), 'n_dup_lines', size(l) - size(array_distinct(l)), "
                "'n_ellipsis_lines', size(filter(l, x -> endswith(rtrim(x), '...') OR endswith(rtrim(x), '…'))), "
                "'n_bullet_lines', size(filter(l, x -> ltrim(x) rlike r'^[-*•]')))")
    lines = _let(f"filter(split({text}, r'\\n'), x -> x rlike r'{WORD_CHAR}')", "l", of_lines)
    counts = ("named_struct('n_words', size(w), 'word_chars', char_length(array_join(w, '')), "
              # other scripts take two bytes a character or more: few extra bytes, few such characters
              f"'n_other', CASE WHEN 2 * (octet_length({text}) - char_length({text})) > char_length(array_join(w, '')) "
              f"THEN {chars(OTHER_SCRIPT)} ELSE 0 END, "
              f"'n_stop_words', size(filter(w, x -> lower(x) IN ({stop}))), "
              f"'n_repeat_words', {_repeat_words('w')}, "
              f"'n_symbols', {chars('[#*$%&|<>]+')}, 'n_marks', {chars('!+')}, 'n_capitals', {chars('[A-Z]+')}, "
              "'n_lines', c.n_lines, 'n_dup_lines', c.n_dup_lines, "
              "'n_ellipsis_lines', c.n_ellipsis_lines, 'n_bullet_lines', c.n_bullet_lines)")
    words = f"array_remove(split({text}, r'{SPACE_RUN}'), '')"
    return _let(lines, "c", _let(words, "w", counts))


def _verdict(rules) -> str:
    """SQL over the measures ``m``: every ratio lies within its bounds.  A ratio
    with an empty denominator passes."""
    tests = []
    for rule in rules:
        names = [f"m.{x}" if x.isidentifier() else x for x in rule.ratio.split()]
        if len(names) != 3 or names[1] != "/":
            raise ValueError(f"rule {rule.name}: a ratio of two measures is needed, not {rule.ratio!r}")
        top, bottom = names[0], names[2]
        bounds = [f"{top} {sign} {limit} * {bottom}" for sign, limit in ((">=", rule.least), ("<=", rule.most)) if limit is not None]
        if bounds:
            tests.append(f"(2 * m.n_other > m.word_chars OR {' AND '.join(bounds)})" if rule.latin else " AND ".join(bounds))
    return " AND ".join(tests) or "true"


def judged(docs: DataFrame, text_col: str = "text", rules=RULES, min_words: int = 50,
           out: str = "_quality") -> DataFrame:
    """Add one struct column with all measures, ``base_failed`` and ``kept``.

    The whole table of rules becomes one expression over the text: it is computed
    once per row, in the scan's own stage, without shuffles.  A document fails the
    base rules with fewer than ``min_words`` words or if more than half its words
    lie in three-word windows found twice or more; else the table decides.  Null
    and empty texts have no words and fail."""
    result = ("named_struct('n_words', m.n_words, 'word_chars', m.word_chars, 'n_symbols', m.n_symbols, "
              "'n_dup_lines', m.n_dup_lines, 'n_repeat_words', m.n_repeat_words, 'n_lines', m.n_lines, "
              "'n_stop_words', m.n_stop_words, 'n_marks', m.n_marks, 'n_capitals', m.n_capitals, "
              "'base_failed', b, 'kept', NOT b AND ({}))").format(_verdict(rules))
    base = f"(m.n_words < {int(min_words)} OR 100L * m.n_repeat_words > 50L * m.n_words)"
    return (docs.withColumn("_whole", whole(F.col(text_col)))
            .withColumn(out, F.expr(_let(_measures("_whole"), "m", _let(base, "b", result))))
            .drop("_whole"))


def quality_flags(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """One row per document: id, word and line counts, ``base_failed``, ``kept``.

    Repeated rows are judged alike, each by itself; an empty table gives an empty
    one; other columns are not read."""
    rows = judged(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_text", rules)
    counts = [F.col(f"_quality.{c}").cast("long").alias(c) for c in
              ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words")]
    return rows.select(F.col("_id").alias(id_col), *counts, "_quality.base_failed", "_quality.kept")


def keep_good(docs: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """The documents that pass, with their columns; the text is judged in the filter."""
    return judged(docs, text_col, rules).where("_quality.kept").select(*docs.columns)
