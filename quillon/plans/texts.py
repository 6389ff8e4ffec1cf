"""Text cleaning, name matching, prompts and word-set queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.operators import tables as O
from quillon.plans.registry import query, rounded
from quillon.sources.tables import table

_STOP = "(" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + ")"
_PUNCT = "'[!-/:-@\\[-`{-~]'"


def _clean(c: str) -> str:
    return f"array_to_string(list_filter(string_split_regex(lower(regexp_replace(coalesce({c}, ''), {_PUNCT}, '', 'g')), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '' AND x NOT IN {_STOP}), ' ')"


@query(f"SELECT doc_id, {_clean('text')} AS clean FROM documents")
def clean_text(spark, d):
    """P02."""
    return table(spark, d, "documents").select("doc_id", X.clean_text(F.col("text")).alias("clean"))


@query("""SELECT page_id, lower(coalesce(CASE WHEN page_id % 3 = 0 THEN NULL ELSE url END, 'VENUE_NAN')) AS venue, CAST(coalesce(CASE WHEN page_id % 4 = 0 THEN NULL ELSE page_id % 30 + 1990 END, 2024) AS BIGINT) AS year FROM pages""")
def filled_fields(spark, d):
    """Defaults for missing values, lower case."""
    p = table(spark, d, "pages")
    return rounded(p.select("page_id", X.filled_lower(F.when(F.col("page_id") % 3 != 0, F.col("url")), "VENUE_NAN").alias("venue"), F.coalesce(F.when(F.col("page_id") % 4 != 0, F.col("page_id") % 30 + 1990), F.lit(2024)).alias("year")))


@query(f"""SELECT p_partkey, {_clean("lower(p_name) || ' ' || " + _clean("p_type || ', the ' || p_brand") + " || ' ' || lower(p_brand || ' ' || p_type)")} AS text FROM part""")
def composed_text(spark, d):
    """P03."""
    p = table(spark, d, "part")
    abstract = F.concat("p_type", F.lit(", the "), "p_brand")
    return p.select("p_partkey", X.composed_text(F.col("p_name"), abstract, F.array("p_brand", "p_type")).alias("text"))


_PEOPLE = """people AS (SELECT l_orderkey AS id, list({'name': s_name || ' ' || (l_linenumber % 3), 'org': CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE n_name END} ORDER BY l_linenumber, s_name) AS authors
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)"""


def _people(spark, d):
    li = table(spark, d, "lineitem").join(table(spark, d, "supplier").withColumnRenamed("s_suppkey", "l_suppkey"), "l_suppkey").join(table(spark, d, "nation").withColumnRenamed("n_nationkey", "s_nationkey"), "s_nationkey")
    person = F.struct(F.concat_ws(" ", "s_name", (F.col("l_linenumber") % 3).cast("string")).alias("name"), F.when(F.col("l_suppkey") % 4 == 0, "").otherwise(F.col("n_name")).alias("org"))
    made = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "s_name", person.alias("p")))).alias("a"))
    return made.select("id", F.col("a.p").alias("authors"))


@query(f"""WITH {_PEOPLE}
SELECT id, lower(coalesce(authors[1].name, '')) AS a1, lower(coalesce(authors[2].name, '')) AS a2, lower(coalesce(authors[3].name, '')) AS a3,
 lower(coalesce(authors[1].org, '')) AS o1, lower(coalesce(authors[2].org, '')) AS o2, lower(coalesce(authors[3].org, '')) AS o3 FROM people""")
def first_authors(spark, d):
    """P04, P05."""
    a = F.col("authors")
    return _people(spark, d).select("id", *(X.field_at(a, k, f).alias(f"{f[0] if f == 'org' else 'a'}{k + 1}") for f in ("name", "org") for k in range(3)))


@query(f"""WITH {_PEOPLE}
SELECT id, array_to_string(list_filter(list_transform(authors, lambda x: lower(x.name)), lambda x: x <> ''), ' ') AS names, array_to_string(list_filter(list_transform(authors, lambda x: lower(x.org)), lambda x: x <> ''), ' ') AS orgs,
 CAST(len(authors) AS BIGINT) AS n_names, CAST(len(list_filter(authors, lambda x: x.org <> '')) AS BIGINT) AS n_orgs FROM people""")
def extracted_names(spark, d):
    """P06, P08, P16."""
    names, orgs = X.field_list(F.col("authors"), "name"), X.field_list(F.col("authors"), "org")
    return rounded(_people(spark, d).select("id", F.array_join(names, " ").alias("names"), F.array_join(orgs, " ").alias("orgs"), F.size("authors").alias("n_names"), F.size(orgs).alias("n_orgs")))


@query("""WITH t AS (SELECT p_partkey, p_name, [string_split(p_name, ' ')[2] || ' ' || string_split(p_name, ' ')[1], p_type, lower(p_brand)] AS others FROM part WHERE p_partkey % 2 = 0
 UNION ALL SELECT p_partkey, p_name, [p_type || ' ' || string_split(p_name, ' ')[1], p_brand] FROM part WHERE p_partkey % 2 = 1)
SELECT p_partkey, CAST(list_contains(list_transform(others, lambda o: lower(o)), lower(p_name)) OR list_contains(list_transform(others, lambda o: lower(o)), lower(string_split(p_name, ' ')[2] || ' ' || string_split(p_name, ' ')[1])) AS BIGINT) AS found,
 CAST(len(list_filter(others, lambda o: len(list_intersect(string_split(lower(o), ' '), string_split(lower(p_name), ' '))) > 0)) > 0 AS BIGINT) AS token FROM t""")
def name_matching(spark, d):
    """A name among others in either order, and shared words."""
    w = F.split("p_name", " ")
    even = F.array(F.concat_ws(" ", w[1], w[0]), F.col("p_type"), F.lower("p_brand"))
    odd = F.array(F.concat_ws(" ", F.col("p_type"), w[0]), F.col("p_brand"))
    t = table(spark, d, "part").select("p_partkey", "p_name", F.when(F.col("p_partkey") % 2 == 0, even).otherwise(odd).alias("others"))
    return rounded(t.select("p_partkey", X.name_matches(F.col("p_name"), F.col("others")).alias("found"), X.shares_token(F.col("p_name"), F.col("others")).alias("token")))


_LETTERS = """c AS (SELECT p_partkey, replace(lower(p_name), ' ', '') AS x, replace(lower(p_type), ' ', '') AS y, replace(lower(p_brand), ' ', '') AS z FROM part),
g AS (SELECT unnest(string_split('abcdefghijklmnopqrstuvwxyz0123456789#', '')) AS ch),
k AS (SELECT p_partkey, ch, length(x) - length(replace(x, ch, '')) AS nx, length(y) - length(replace(y, ch, '')) AS ny, length(z) - length(replace(z, ch, '')) AS nz FROM c, g),
s AS (SELECT p_partkey, sum(nx * ny) AS py, sum(nx * nz) AS pz, sum(least(nx, ny)) AS cy, sum(least(nx, nz)) AS cz FROM k GROUP BY 1)"""


@query(f"""WITH {_LETTERS} SELECT p_partkey, CAST(py + pz AS BIGINT) AS pairs, CAST(cy + cz AS BIGINT) AS characters, CAST(greatest(py, pz, cy, cz) AS BIGINT) AS most FROM s""")
def common_lengths(spark, d):
    """Matching character pairs and multiset overlaps over a list of names."""
    t = table(spark, d, "part").select("p_partkey", X.total_common_lengths(F.col("p_name"), F.array("p_type", "p_brand")).alias("t"))
    return rounded(t.select("p_partkey", "t.pairs", "t.characters", "t.most"))


@query("""SELECT conv_id, string_agg(role, ',' ORDER BY turn, role) FILTER (lower(role) <> 'user') AS others, CAST(count(*) AS BIGINT) AS n FROM conversations GROUP BY 1""")
def other_people(spark, d):
    """All names but the main one."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("r"), F.count("*").alias("n"))
    others = X.other_names(F.lit("USER"), F.col("r.role"))
    return c.select("conv_id", F.when(F.size(others) > 0, F.array_join(others, ",")).alias("others"), "n")


@query("""SELECT doc_id, CAST(length(text) AS BIGINT) AS len_text, CAST(length(source) AS BIGINT) AS len_venue, round(length(source) / nullif(length(text), 0), 6) AS ratio, round(length(source) / (length(text) + 0.001), 6) AS guarded FROM documents""")
def length_features(spark, d):
    """P08, P09."""
    t, s = F.char_length("text"), F.char_length("source")
    return rounded(table(spark, d, "documents").select("doc_id", t.alias("len_text"), s.alias("len_venue"), F.try_divide(s, t).alias("ratio"), (s / (t + 0.001)).alias("guarded")))


_WORDS = """w AS (SELECT conv_id, turn, pos, word FROM (SELECT conv_id, turn, unnest(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+')) AS word, generate_subscripts(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), 1) AS pos FROM conversations) WHERE word <> '')"""


def _words(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", r"[ \t\n\x0B\f\r]+")).alias("pos", "word"))
    return c.filter("word <> ''").withColumn("at", F.struct("turn", "pos"))


@query(f"""WITH {_WORDS},
c AS (SELECT conv_id, word, count(*) AS n, min(turn * 1000000 + pos) AS f FROM w GROUP BY ALL),
t AS (SELECT conv_id, word FROM c QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, f) <= 10)
SELECT conv_id, turn, count(DISTINCT w.word) AS own, count(DISTINCT t.word) AS top10 FROM w LEFT JOIN t USING (conv_id, word) GROUP BY ALL""")
def vocabulary_overlap(spark, d):
    """Words of a row in its group's vocabulary and in its most frequent words."""
    w = _words(spark, d)
    top = O.top_values(w, "conv_id", "word", "at", 10).select("conv_id", "word", F.col("word").alias("hit"))
    return w.join(top, ["conv_id", "word"], "left").groupBy("conv_id", "turn").agg(F.countDistinct("word").alias("own"), F.countDistinct("hit").alias("top10"))


@query(f"""WITH {_WORDS},
c AS (SELECT conv_id, word, count(*) AS n, min(turn * 1000000 + pos) AS f FROM w GROUP BY ALL),
t AS (SELECT conv_id, word FROM c QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, f) <= 50),
g AS (SELECT conv_id, list(word) AS a FROM t GROUP BY 1),
r AS (SELECT conv_id, turn, list(DISTINCT word) AS b FROM w GROUP BY ALL),
x AS (SELECT r.conv_id, turn, len(a) AS na, len(b) AS nb, len(list_intersect(a, b)) AS ni FROM r JOIN g ON r.conv_id = g.conv_id)
SELECT conv_id, turn, round(1 - ni / (na + nb - ni), 6) AS jaccard, round(1 - 2 * ni / (na + nb), 6) AS sorensen FROM x""")
def set_distances(spark, d):
    """A08."""
    w = _words(spark, d)
    top = O.top_lists(w, "conv_id", "word", "at", 50)
    r = w.groupBy("conv_id", "turn").agg(F.collect_set("word").alias("own"))
    j = r.join(top, "conv_id")
    return rounded(j.select("conv_id", "turn", *(X.set_distance(F.col("top"), F.col("own"), k).alias(k) for k in ("jaccard", "sorensen"))))


@query("""SELECT doc_id, md5(CASE WHEN n_chars / 4 >= 200 THEN array_to_string(string_split(text, ' ')[1:100], ' ') ELSE text END) AS clipped FROM documents""")
def clipped_titles(spark, d):
    """P22."""
    return table(spark, d, "documents").select("doc_id", F.md5(X.clip_words(F.col("text"), F.col("n_chars") / 4)).alias("clipped"))


TEMPLATE = "Given items: {titles}. Does the item belong: {target}?"


@query("""WITH t AS (SELECT conv_id, turn, text AS title FROM conversations),
b AS (SELECT a.conv_id, a.turn, string_agg(b.title, ' # ' ORDER BY b.turn) AS titles, any_value(a.title) AS target FROM t a LEFT JOIN t b ON a.conv_id = b.conv_id AND a.turn <> b.turn GROUP BY ALL)
SELECT conv_id, turn, 'Given items: ' || coalesce(titles, '') || '. Does the item belong: ' || target || '?' AS prompt FROM b""")
def prompts(spark, d):
    """The other titles of a group, in order, in a template."""
    t = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("title"))
    every = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "title"))).alias("all"))
    j = t.join(every, "conv_id")
    others = F.transform(F.filter("all", lambda x: x["turn"] != F.col("turn")), lambda x: x["title"])
    return j.select("conv_id", "turn", X.prompt(others, F.col("title"), TEMPLATE).alias("prompt"))


@query("""WITH t AS (SELECT conv_id, list(CAST(length(text) % 50 AS BIGINT) ORDER BY turn, length(text) % 50) AS ids, list(CAST(length(text) % 50 % 2 AS BIGINT) ORDER BY turn, length(text) % 50) AS mask FROM conversations GROUP BY 1),
m AS (SELECT *, max(len(ids)) OVER () AS n FROM t)
SELECT conv_id, list_concat(ids, list_transform(range(n - len(ids)), lambda x: 0)) AS input_ids,
 list_concat(list_transform(range(1, len(ids) + 1), lambda i: CASE WHEN mask[i] = 1 THEN ids[i] ELSE -100 END), list_transform(range(n - len(ids)), lambda x: -100)) AS labels FROM m""")
def padded_batches(spark, d):
    """P25: right padding to the longest, labels masked."""
    n = (F.char_length("text") % 50).cast("long")
    t = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", n.alias("id")))).alias("s"))
    t = t.select("conv_id", F.col("s.id").alias("ids"), F.transform("s", lambda x: x["id"] % 2).alias("mask"))
    longest = t.agg(F.max(F.size("ids")).alias("n"))
    t = t.crossJoin(F.broadcast(longest))  # one row
    return t.select("conv_id", X.padded(F.col("ids"), F.col("n"), 0).cast("array<bigint>").alias("input_ids"), X.padded(X.masked_labels(F.col("ids"), F.col("mask")), F.col("n"), -100).cast("array<bigint>").alias("labels"))


@query("""SELECT conv_id, list_concat([1], list(CAST(turn AS BIGINT) ORDER BY turn), [2, 2])[1:6] AS ids FROM conversations GROUP BY 1""")
def assembled_tokens(spark, d):
    """Begin, prompt and end ids, cut at a length."""
    t = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("t"))
    ids = X.assembled([F.array(F.lit(1).cast("long")), F.col("t"), F.array(F.lit(2).cast("long"), F.lit(2).cast("long"))], 6)
    return t.select("conv_id", ids.alias("ids"))


@query("""WITH t AS (SELECT p_partkey, [length(p_name), length(p_brand), length(p_type)] AS n FROM part)
SELECT p_partkey, CAST(least(n[1], 20) AS BIGINT) AS a, CAST(greatest(least(n[2], 20 - n[1]), 0) AS BIGINT) AS b, CAST(greatest(least(n[3], 20 - n[1] - n[2]), 0) AS BIGINT) AS c FROM t""")
def entity_spans(spark, d):
    """Spans in a fixed order, each cut to what is left of the budget."""
    ids = lambda c: F.transform(F.split(c, ""), lambda x: F.ascii(x))
    t = table(spark, d, "part").select("p_partkey", X.budgeted_spans(F.array(ids("p_name"), ids("p_brand"), ids("p_type")), 20).alias("s"))
    return rounded(t.select("p_partkey", *(F.size(F.col("s")[k]).alias(n) for k, n in enumerate("abc"))))


@query(r"""WITH g AS (SELECT p_partkey, regexp_extract_all(lower(p_name || ' ' || p_type), '[0-9A-Za-z_]{2,}') AS w FROM part),
t AS (SELECT p_partkey, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM g),
c AS (SELECT p_partkey, term, count(*) AS tf FROM t GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM c GROUP BY 1),
n AS (SELECT count(*) AS n FROM part),
x AS (SELECT p_partkey, c.term, tf * (ln((1 + n) / (1 + df)) + 1) AS x FROM c JOIN f USING (term), n WHERE df <= 0.95 * n)
SELECT p_partkey, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY p_partkey)), 6) AS weight FROM x""")
def tfidf_terms(spark, d):
    """Word and word-pair TF-IDF, rows of length 1."""
    from quillon.operators.features import tf_idf

    p = table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("t"))
    return rounded(tf_idf(p, "p_partkey", "t"))


@query(r"""WITH t AS (SELECT p_partkey, unnest(regexp_extract_all(lower(p_name || ' ' || p_type), '[0-9A-Za-z_]{2,}')) AS term FROM part)
SELECT term, count(*) AS n, count(DISTINCT p_partkey) AS df FROM t GROUP BY 1 HAVING count(DISTINCT p_partkey) >= 2""")
def term_counts(spark, d):
    """Counts of terms in at least two rows."""
    from quillon.operators.features import terms

    p = table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("t"))
    return terms(p, "p_partkey", "t", 1).groupBy("term").agg(F.count("*").alias("n"), F.countDistinct("p_partkey").alias("df")).filter("df >= 2")


@query("""SELECT CAST(turn AS BIGINT) AS turn, count(*) AS n FROM conversations WHERE trim(text) <> '' GROUP BY 1""")
def corpus_lines(spark, d):
    """Non-blank texts."""
    return table(spark, d, "conversations").filter(F.trim("text") != "").groupBy("turn").agg(F.count("*").alias("n"))


@query("""SELECT conv_id, string_agg(text, ' ' ORDER BY turn, text) AS text FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1""")
def group_documents(spark, d):
    """The texts of an entity together, in order."""
    from quillon.operators.features import group_documents as together

    return together(table(spark, d, "conversations"), "conv_id", "turn", "text")


@query("""SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role) AS BIGINT) AS from_end FROM conversations""")
def turns_from_the_end(spark, d):
    """W04 over conversations."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"), "role")
    return rounded(table(spark, d, "conversations").select("conv_id", "turn", "role", F.row_number().over(w).alias("from_end")))
