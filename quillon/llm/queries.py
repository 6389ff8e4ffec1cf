"""One query for each operator of this folder, over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bands, bpe, collocations, contamination, jaccard, licenses, passages, quality, rules, sequences, store, tokens, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit_quality(docs, _table(spark, sf_dir, "labels")))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_table(spark, sf_dir, "documents"), _vocabulary())


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(_table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(_table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.pattern_pack(_table(spark, sf_dir, "documents"), _vocabulary())


def op9_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = store.new_path(spark, "packed")
    sequences.write_packed(_table(spark, sf_dir, "documents"), _vocabulary(), to)
    return sequences.read_segments(spark.read.parquet(to))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    to = store.new_path(spark, "warc")
    warc.write_warc(pages, to)
    return warc.archive_index(warc.read_warc(spark, to), pages.schema["page_id"].dataType)


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op12_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bands.near_prices(_table(spark, sf_dir, "sale_lines"), _table(spark, sf_dir, "items"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op1_quality_classifier": op1_quality_classifier,
        "op2_license_scan": op2_license_scan,
        "op3_token_counts": op3_token_counts,
        "op4_jaccard_join": op4_jaccard_join,
        "op5_quality_rules": op5_quality_rules,
        "op6_decontamination": op6_decontamination,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_best_fit_packing": op8_best_fit_packing,
        "op9_packed_ids": op9_packed_ids,
        "op10_warc": op10_warc,
        "op11_byte_bpe": op11_byte_bpe,
        "op12_band_join": op12_band_join,
        "op13_collocations": op13_collocations,
    }


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
h AS (SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM h WHERE payload_bytes >= 100 GROUP BY 1)
SELECT h.page_id, h.payload_bytes, h.payload_digest,
       CASE WHEN f.first < h.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first < h.page_id THEN f.first END AS refers_to
FROM h LEFT JOIN f ON h.payload_bytes >= 100 AND h.payload_digest = f.payload_digest
"""


_WORDS = r"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP4_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM d),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p WHERE 100 * c >= 90 * (na + nb - c)),
m AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, m.b FROM r JOIN m ON r.b = m.a)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c.b AS component_id FROM s JOIN (SELECT a, min(b) AS b FROM r GROUP BY 1) c ON c.a = s.doc_id
"""


def _grams(n: int) -> str:
    gram = " || ' ' || ".join(f"w[i + {k}]" for k in range(n))
    return f"""g{n} AS (SELECT doc_id, unnest(range(1, len(w) - {n - 2})) AS p, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: {gram})) AS g FROM d WHERE len(w) >= {n}),
c{n} AS (SELECT DISTINCT doc_id, unnest(range(p, p + {n})) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g{n}) WHERE n > 1),
t{n} AS (SELECT doc_id, count(*) AS words, sum(length(w[c{n}.p])) AS chars FROM c{n} JOIN d USING (doc_id) GROUP BY 1)"""


OP5_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
{", ".join(_grams(n) for n in (3, 5, 8, 10))},
l AS (SELECT doc_id, line, count(*) AS n, length(line) AS k FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY ALL),
ll AS (SELECT doc_id, sum(n - 1) AS dup, sum((n - 1) * k) AS dup_chars, sum(n * k) AS chars FROM l GROUP BY 1),
m AS (SELECT d.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(dup, 0) AS n_dup_lines, coalesce(t3.words, 0) AS n_repeat_words, coalesce(t5.chars, 0) / greatest(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0), 1) AS share_5,
  coalesce(t8.chars, 0) / greatest(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0), 1) AS share_8, coalesce(t10.chars, 0) / greatest(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0), 1) AS share_10,
  coalesce(dup_chars, 0) / greatest(coalesce(ll.chars, 0), 1) AS share_lines
  FROM d LEFT JOIN t3 USING (doc_id) LEFT JOIN t5 USING (doc_id) LEFT JOIN t8 USING (doc_id) LEFT JOIN t10 USING (doc_id) LEFT JOIN ll USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  base_failed, NOT base_failed AND share_5 <= {rules.NGRAM_SHARE[5]} AND share_8 <= {rules.NGRAM_SHARE[8]} AND share_10 <= {rules.NGRAM_SHARE[10]} AND share_lines <= {rules.LINE_SHARE} AS kept,
  CAST(share_5 AS DOUBLE) AS share_5, CAST(share_8 AS DOUBLE) AS share_8, CAST(share_10 AS DOUBLE) AS share_10, CAST(share_lines AS DOUBLE) AS share_lines FROM f
"""


#: crc32 of an ASCII text, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), flatten(list_transform(range(1, length({t}) + 1), lambda i: [CAST(ascii({t}[i]) AS UBIGINT), 0, 0, 0, 0, 0, 0, 0]))),
  lambda c, s: xor(xor(c, s) >> 1, (xor(c, s) & 1) * 3988292384)))"""

OP12_SQL = f"""
WITH l AS (SELECT sale_id AS a, line_no AS b, item_id AS owner, CAST(floor(100 * amount + 0.5) AS HUGEINT) AS c, CAST(quantity AS HUGEINT) AS q, concat_ws(',', sale_id, coalesce(CAST(line_no AS VARCHAR), ''), item_id) AS t
  FROM sale_lines WHERE sale_id IS NOT NULL AND item_id IS NOT NULL AND amount IS NOT NULL AND quantity > 0),
r AS (SELECT a, b, owner, CAST((2 * c + q - ((2 * c + q) % (2 * q) + 2 * q) % (2 * q)) // (2 * q) AS BIGINT) AS u, CAST({_CRC.format(t="t")} AS HUGEINT) AS w FROM l),
i AS (SELECT item_id, CAST(floor(100 * price + 0.5) AS BIGINT) AS p FROM items),
m AS (SELECT item_id, abs(u - p) AS gap, u, a, b, owner, w FROM i JOIN r ON owner <> item_id AND u BETWEEN p - 50 - p // 150 AND p + 50 + p // 150 AND (abs(u - p) <= 50 OR 1000 * abs(u - p) <= 5 * least(u, p))),
s AS (SELECT item_id, count(*) AS n, sum(gap) AS g, sum(w) AS w FROM m GROUP BY 1),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY gap, u, a, b, owner) AS rank FROM m QUALIFY rank <= 10)
SELECT i.item_id, CAST(coalesce(rank, 0) AS INTEGER) AS rank, gap, u, a AS sale_id, CAST(b AS BIGINT) AS line_no, owner AS line_item_id, CAST(coalesce(n, 0) AS BIGINT) AS n_pairs, CAST(coalesce(g, 0) AS BIGINT) AS gap_sum, CAST(coalesce(s.w, 0) AS BIGINT) AS lines_crc
FROM i LEFT JOIN s ON s.item_id = i.item_id LEFT JOIN k ON k.item_id = i.item_id
"""

OP13_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM d),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 6) t(k) WHERE len(w) >= k),
n AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM w GROUP BY 1),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT * FROM f s WHERE k > 1 AND NOT EXISTS (SELECT 1 FROM f o WHERE o.lang = s.lang AND o.k > s.k AND 100 * o.f >= 100 * s.f AND contains(' ' || o.phrase || ' ', ' ' || s.phrase || ' '))),
t AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM c),
q AS (SELECT t.lang, t.phrase, t.f AS a, cut, x.f AS l, y.f AS r, n, (1000 * CAST(t.f AS HUGEINT) * n) // (CAST(x.f AS HUGEINT) * y.f) AS score FROM t JOIN n USING (lang)
  JOIN f x ON x.lang = t.lang AND x.phrase = array_to_string(w[1:cut], ' ') JOIN f y ON y.lang = t.lang AND y.phrase = array_to_string(w[cut + 1:], ' ')),
b AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM b QUALIFY rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op12_band_join": OP12_SQL, "op13_collocations": OP13_SQL, "op4_jaccard_join": OP4_SQL, "op5_quality_rules": OP5_SQL, "op10_warc": OP10_SQL}
