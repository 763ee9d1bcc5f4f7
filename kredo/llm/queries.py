"""The queries op1 to op13 and their SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from kredo.llm import alignment, bpe, decontamination, exact_dedup, lexical_search, licences, line_dedup, lm_scoring, mixing, quality, simhash, substring_dedup, url_filter
from kredo.sources.tables import table

SPACE = r"[\x20\x09-\x0D]+"


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


OP1 = """SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""


def op2_substring_dedup(spark, sf_dir):
    done = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP2 = r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i FROM w),
g AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 34], ' ')) AS h FROM s JOIN w USING (doc_id)),
r AS (SELECT doc_id, i FROM g WHERE h IN (SELECT h FROM g GROUP BY h HAVING count(*) > 1)),
c AS (SELECT doc_id, list_distinct(list(i + d)) AS gone FROM r, (SELECT unnest(range(0, 35)) AS d) GROUP BY doc_id),
k AS (SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
    list_filter(w, lambda x, i: gone IS NULL OR NOT list_contains(gone, i)) AS kept
  FROM w LEFT JOIN c USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
  sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k"""


def op3_lm_scoring(spark, sf_dir):
    return lm_scoring.score_documents(table(spark, sf_dir, "documents"))


def op4_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark, sf_dir):
    """doc_id, n_lines, n_dropped and the digest of the text that is left."""
    done = line_dedup.without_recurring_lines(table(spark, sf_dir, "documents"))
    return done.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped",
                       F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_quality_rules(spark, sf_dir):
    flags = quality.quality_flags(table(spark, sf_dir, "documents"))
    return flags.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        "base_failed", "kept")


_STOPS = ", ".join(f"'{w}'" for w in sorted(set(quality.STOP_WORDS)))
OP6 = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '{SPACE}'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
p AS (SELECT doc_id, count(DISTINCT i + d) AS n_repeat_words FROM f, (SELECT unnest([0, 1, 2]) AS d) GROUP BY doc_id),
m AS (SELECT t.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    length(regexp_replace(text, '[^!]', '', 'g')) AS n_marks,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals,
    length(text) - length(regexp_replace(text, '{quality.OTHER_SCRIPT}', '', 'g')) AS n_other,
    len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
    len(list_filter(l, lambda x: regexp_matches(x, '(\\.\\.\\.|…) *$'))) AS n_ellipsis_lines,
    len(list_filter(l, lambda x: regexp_matches(x, '^ *[-*•]'))) AS n_bullet_lines,
    len(list_filter(w, lambda x: lower(x) IN ({_STOPS}))) AS n_stop_words,
    coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM t LEFT JOIN p USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND (2 * n_other > word_chars OR word_chars >= 3 * n_words AND word_chars <= 12 * n_words AND n_stop_words >= 0.01 * n_words)
    AND n_symbols <= 0.1 * n_words AND n_marks <= 0.25 * n_words AND n_capitals <= 0.4 * word_chars
    AND n_dup_lines <= 0.3 * n_lines AND n_ellipsis_lines <= 0.3 * n_lines
    AND n_bullet_lines <= 0.9 * n_lines AS kept
FROM b"""


def op7_bpe(spark, sf_dir):
    import public_tokenizers

    done = bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_license_scans(spark, sf_dir):
    """doc_id, licences joined by a space, n_statements, probability (six decimals)."""
    documents, _ = licences.scan(table(spark, sf_dir, "documents"))
    return documents.select("doc_id", F.array_join("licences", " ").alias("licences"), "n_statements",
                            F.round("probability", 6).alias("probability"))


def op9_mixing(spark, sf_dir):
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op10_url_filters(spark, sf_dir):
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), url_filter.rules_table(spark))


OP10 = """WITH u AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u),
k AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r(rhost, rpath, rverdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
f AS (SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule,
    arg_max(rverdict, length(rhost || rpath)) AS verdict
  FROM k JOIN r ON (host = rhost OR suffix(host, '.' || rhost)) AND prefix(path, rpath) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM k LEFT JOIN f USING (page_id)"""


def op11_benchmark_decontamination(spark, sf_dir):
    found = decontamination.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = decontamination.n_hit(F.col("spans"))
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


_TERMS = r"""list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""
OP11 = f"""WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, w, least(len(w), 10) AS k FROM (SELECT item_id, {_TERMS} AS w FROM benchmark) WHERE len(w) > 0),
g AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS gram
  FROM (SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM b)),
s AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM b) WHERE len(w) >= k),
h AS (SELECT doc_id, i, s.k, item FROM (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS gram FROM s) s
  JOIN g ON s.gram = g.gram AND s.k = g.k),
c AS (SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS i FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, c.n IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""


def op12_ranked_search(spark, sf_dir):
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
s AS (SELECT count(*) AS n_all, sum(len(w)) AS l_all FROM d WHERE len(w) > 0),
m AS (SELECT r, doc_id, CAST(100 - 75 + (75 * len(w) * n_all) // l_all AS BIGINT) AS m FROM d, s WHERE len(w) > 0),
t AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY r, t),
q AS (SELECT item_id, t, count(*) AS c FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY item_id, t),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * any_value(n_all) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, s GROUP BY t),
x AS (SELECT item_id, r, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN w USING (t) JOIN t USING (t) JOIN m USING (r) GROUP BY item_id, r, doc_id),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM x WHERE score > 0)
SELECT * FROM k WHERE rank <= 10"""


def op13_tokenizer_alignment(spark, sf_dir):
    import public_tokenizers

    return alignment.aligned_corpus(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                    public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup, "op2_substring_dedup": op2_substring_dedup, "op3_lm_scoring": op3_lm_scoring,
    "op4_simhash": op4_simhash, "op5_line_dedup": op5_line_dedup, "op6_quality_rules": op6_quality_rules, "op7_bpe": op7_bpe,
    "op8_license_scans": op8_license_scans, "op9_mixing": op9_mixing, "op10_url_filters": op10_url_filters,
    "op11_benchmark_decontamination": op11_benchmark_decontamination,
    "op12_ranked_search": op12_ranked_search,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
    "pipeline": corpus_pipeline.run,
}
ORACLE = {"op1_exact_dedup": OP1, "op2_substring_dedup": OP2, "op6_quality_rules": OP6, "op10_url_filters": OP10,
          "op11_benchmark_decontamination": OP11, "op12_ranked_search": OP12}
