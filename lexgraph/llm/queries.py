"""The queries that apply the operators to whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexgraph.llm import bpe, decontaminate, html, jaccard, license, linededup, lm, quality, ranked, spelling, suffix, tokenfile, warc
from lexgraph.session import table


def word_bpe_path() -> str:
    """The installed tokenizer file with word ends."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages")).drop("url")


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``spans`` as text: label:first_word-end_word:edits, joined by commas."""
    found = license.scan_licenses(table(spark, sf_dir, "documents"))
    text = F.transform("spans", lambda s: F.concat(s["label"], F.lit(":"), s["first_word"].cast("string"), F.lit("-"), s["end_word"].cast("string"), F.lit(":"), s["edits"].cast("string")))
    return found.withColumn("spans", F.array_join(text, ","))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), word_bpe_path())


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that stand once in all texts are not in the model: there words back off."""
    found = lm.score_documents(table(spark, sf_dir, "documents"), least=2)
    # Perplexities are large: sums in another order differ in their sixth decimal.
    return found.withColumns({c: F.round(c, n) + F.lit(0.0) for c, n in (("log_score", 6), ("perplexity", 3))})


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.dedup_substrings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_files(table(spark, sf_dir, "documents"), word_bpe_path())


QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_quality_rules, op3_warc, op4_license_scans, op5_decontamination, op6_bpe, op7_jaccard_join, op8_lm_scoring, op9_suffix_dedup, op10_line_dedup, op11_ranked_search, op12_spelling_variants, op13_token_files)}

ORACLES = {
    "op3_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
     d AS (SELECT page_id, strlen(h) AS n, sha256(h) AS g FROM p),
     m AS (SELECT *, min(page_id) OVER (PARTITION BY g) AS f FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, g AS payload_digest,
       CASE WHEN n >= 100 AND page_id > f THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id > f THEN f END AS refers_to
FROM m""",
    "op8_lm_scoring": r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
     t AS (SELECT doc_id, unnest(w) AS b, unnest(list_prepend(NULL, w[:-2])) AS a FROM d),
     one AS (SELECT b AS w, count(*) AS c FROM t GROUP BY 1),
     two AS (SELECT a, b, count(*) AS c FROM t WHERE a IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2),
     s AS (SELECT doc_id, sum(CASE WHEN p.c IS NOT NULL THEN ln(p.c) - ln(v.c) ELSE ln(o.c) - ln((SELECT sum(c) FROM one)) + CASE WHEN a IS NULL THEN 0 ELSE ln(0.4) END END) AS score, count(*) FILTER (a IS NOT NULL AND p.c IS NULL) AS lost
           FROM t JOIN one o ON b = o.w LEFT JOIN one v ON a = v.w LEFT JOIN two p USING (a, b) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(lost, 0) AS n_backoff, round(coalesce(score, 0), 6) + 0.0 AS log_score,
       CASE WHEN len(w) > 0 THEN round(exp(-score / len(w)), 3) + 0.0 END AS perplexity
FROM d LEFT JOIN s USING (doc_id)""",
    "op10_line_dedup": r"""
WITH l AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
     b AS (SELECT line FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY line HAVING count(DISTINCT source) >= 8),
     m AS (SELECT l.*, b.line IS NOT NULL AS gone FROM l LEFT JOIN b ON l.line = b.line),
     d AS (SELECT doc_id, any_value(text) AS text, count(*) AS n_lines, count_if(gone) AS n, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept FROM m GROUP BY doc_id)
SELECT doc_id, n_lines, CAST(n AS BIGINT) AS n_removed, sha256(CASE WHEN n > 0 THEN kept ELSE text END) AS kept_sha256
FROM d""",
    "op11_ranked_search": r"""
WITH d AS (SELECT doc_id, unnest(list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term FROM documents),
q AS (SELECT item_id, unnest(list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term FROM benchmark),
p AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY 1, 2),
len AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY 1),
t AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS l FROM len),
m AS (SELECT doc_id, 25 + (75 * n * nn) // l AS m FROM len, t),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, t GROUP BY term, nn),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY 1, 2)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10""",
    # The crc32 of a run is folded over its UTF-8 bytes (all code points are below U+0100) with a table made by the rule.
    "op12_spelling_variants": r"""
WITH RECURSIVE tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) r(i))),
runs AS (SELECT doc_id, translate(unnest(string_split_regex(text, '[^A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
each AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY 1, 2),
code AS (SELECT *, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + unicode(c) // 64, 128 + unicode(c) % 64] END)) AS bytes FROM each),
h AS (SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(bytes, lambda b: CAST(b AS BIGINT))), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) AS h FROM code, tab),
v AS (SELECT CASE WHEN h % 199 = 0 THEN run[: h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5),
spot AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
near AS (SELECT DISTINCT a.word AS a, b.word AS b FROM spot a JOIN spot b ON a.i = b.i AND length(a.word) = length(b.word) AND a.word <> b.word AND a.word[: a.i - 1] || '?' || a.word[a.i + 1 :] = b.word[: b.i - 1] || '?' || b.word[b.i + 1 :]
 UNION SELECT s.word, v.word FROM spot s JOIN v ON v.word = s.word[: i - 1] || s.word[i + 1 :] UNION SELECT v.word, s.word FROM spot s JOIN v ON v.word = s.word[: i - 1] || s.word[i + 1 :]),
best AS (SELECT a AS word, count(*) AS n_near, min((-n, b)) AS o FROM near JOIN v ON b = word GROUP BY 1),
form AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -o[1] >= 5 * v.n THEN o[2] END AS form, CASE WHEN -o[1] >= 5 * v.n THEN -o[1] END AS form_n FROM v LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS at FROM form UNION ALL SELECT walk.word, form.form FROM walk JOIN form ON walk.at = form.word WHERE form.form IS NOT NULL)
SELECT f.word, f.form, w.at AS root, f.n, f.n_near, f.form_n FROM form f JOIN walk w ON f.word = w.word JOIN form l ON w.at = l.word WHERE l.form IS NULL""",
}
