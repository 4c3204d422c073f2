"""Queries of the string functions over names, texts and URLs, each column one function."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import strings as X
from .registry import query, table


@query("""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents)
SELECT doc_id, md5(substring(t, 3, greatest(n - 5, 0))) AS middle, md5(CASE WHEN n > 10 THEN right(t, 10) ELSE t END) AS tail,
       (length(t) - length(replace(t, 'the', ''))) // 3 AS n_the, strpos(t, 'and') - 1 AS first_and,
       CASE WHEN strpos(t, 'and') = 0 THEN -1 ELSE n - strpos(reverse(t), 'dna') - 2 END AS last_and,
       starts_with(t, 'The') AS starts, ends_with(t, '.') AS ends, CASE WHEN starts_with(substring(t, 3), 'e') THEN true ELSE false END AS third_is_e,
       len(string_split(t, '. '))::INTEGER AS n_parts, md5(replace(t, 'e', '3')) AS replaced, length(trim(t, ' ' || chr(10) || chr(13) || chr(9)))::INTEGER AS stripped,
       (n - length(ltrim(t, ' ' || chr(10) || chr(13) || chr(9))))::INTEGER AS first_char, length(rtrim(t, ' ' || chr(10) || chr(13) || chr(9)))::INTEGER AS right_stripped
FROM d""")
def text_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices, counts, places and edges of whole texts."""
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select(
        "doc_id", X.md5(X.view(t, 2, -3)).alias("middle"), X.md5(X.view(t, -10)).alias("tail"), X.count(t, "the").cast("long").alias("n_the"),
        X.find(t, "and").cast("long").alias("first_and"), X.rfind(t, "and").cast("long").alias("last_and"), X.startswith(t, "The").alias("starts"), X.endswith(t, ".").alias("ends"),
        X.startswith(t, "e", 2).alias("third_is_e"), F.size(X.split(t, ". ")).alias("n_parts"), X.md5(X.replace(t, "e", "3")).alias("replaced"),
        F.length(X.strip(t)).alias("stripped"), X.first_char(t).alias("first_char"), F.length(X.rstrip(t)).alias("right_stripped"),
    )


@query("""
SELECT page_id, regexp_extract(url, '^https?', 0) AS scheme, nullif(regexp_extract(url, '[0-9]+', 0), '') AS number,
       CASE WHEN regexp_matches(url, '[0-9]+') THEN length(regexp_extract(url, '^[^0-9]*', 0))::INTEGER END AS number_at,
       array_to_string(regexp_extract_all(url, '[a-z]+'), ' ') AS words, regexp_replace(url, '[^A-Za-z0-9_]', '_', 'g') AS identifier,
       regexp_replace(url, '([()\\[\\]{}?*+\\-|^$\\\\.&~# ])', '\\\\\\1', 'g') AS escaped,
       CASE WHEN length(url) > 41 THEN left(url, 18) || ' ... ' || right(url, 17) ELSE url END AS short,
       md5(url) AS digest, regexp_replace(url, '([0-9]+)', '<\\1>', 'g') AS marked
FROM pages""")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches at the start, first and all matches, names, escapes and short forms of URLs."""
    u = F.col("url")
    first = X.search(u, "[0-9]+")
    return table(spark, sf_dir, "pages").select(
        "page_id", X.match(u, "https?").alias("scheme"), first["text"].alias("number"), first["start"].alias("number_at"), F.array_join(X.finditer(u, "[a-z]+"), " ").alias("words"),
        X.as_identifier(u).alias("identifier"), X.escape_re(u).alias("escaped"), X.abbreviate_middle(u, 41).alias("short"), X.md5(u).alias("digest"),
        X.subf(u, "[0-9]+", lambda m: F.concat(F.lit("<"), m, F.lit(">"))).alias("marked"),
    )


@query("""
SELECT p_partkey, '"' || p_brand || '&amp;' || p_type || '&lt;"' AS fixed, 'x' || CASE WHEN p_partkey % 2 = 0 THEN '"' || p_name || '"' END AS valid,
       '''' || p_type || '"' || p_brand || '''' AS quoted, '"' || p_type || '"?&apos;' AS both_quotes, '"' || p_name || '?"' AS latin,
       '{{' || p_type || '}}{{x}}' AS braces, '"' || p_type || '\\n\\"' || p_brand || '\\\\"' AS json, p_type || '\\n\\t\\\\\\x01' AS controls,
       printf('\\x%02x', ascii(p_type)) AS code, printf('&#x%02x;', ascii(p_type)) AS entity, list_contains(['A', 'B'], 'A') AS fenced
FROM part""".replace("'\"' || p_type || '\"?&apos;'", "'''' || p_type || '\"?&apos;'''").replace("\\\\\\\\", "\\\\"))
def quoting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values quoted for XML, JSON, format strings and messages."""
    t, brand, name = F.col("p_type"), F.col("p_brand"), F.col("p_name")
    value = F.when(F.col("p_partkey") % 2 == 0, name).otherwise(F.concat(name, F.lit("<")))
    return table(spark, sf_dir, "part").select(
        "p_partkey", X.xml_attribute(F.concat(brand, F.lit("&"), t, F.lit("<"))).alias("fixed"), F.concat(F.lit("x"), X.xml_attribute(value, fix=False)).alias("valid"),
        X.xml_attribute(F.concat(t, F.lit('"'), brand)).alias("quoted"), X.xml_attribute(F.concat(t, F.lit("\"?'"))).alias("both_quotes"), X.xml_attribute(F.concat(name, F.lit("漢")), latin=True).alias("latin"),
        X.escape_formatstr(F.concat(F.lit("{"), t, F.lit("}{{x}}"))).alias("braces"), X.json_string(F.concat(t, F.lit('\n"'), brand, F.lit("\\"))).alias("json"),
        X.escape_ctrl_chars(F.concat(t, F.lit("\n\t\\\x01"))).alias("controls"), X.char_code(t).alias("code"), X.xml_entity(t).alias("entity"),
        X.has_fenced_code(F.concat(t, F.lit("\n```ebnf \nx\n```"))).alias("fenced"),
    )


@query("""
SELECT p_partkey, array_to_string([p_type, p_brand || ', x'], '|') AS semicolons, array_to_string([p_type, p_brand], '|') AS commas, array_to_string(string_split(p_name, ' '), '|') AS blanks,
       least(p_type, p_brand, 'M') || CASE least(p_type, p_brand, 'M') WHEN p_type THEN p_brand || 'M' WHEN p_brand THEN 'M' || p_type ELSE p_type || p_brand END AS circle,
       length(p_type)::INTEGER + 1 AS inner_open, length(p_type)::INTEGER + length(p_name)::INTEGER + 2 AS inner_close, length(p_type)::INTEGER + length(p_name)::INTEGER + 4 AS lone, length(p_name)::INTEGER AS after_view
FROM part""")
def lists_and_brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists by their delimiters, circular paths, and brackets that belong together."""
    t, brand, name = F.col("p_type"), F.col("p_brand"), F.col("p_name")
    pairs = X.matching_brackets(F.concat(F.lit("("), t, F.lit("("), F.substring(name, F.lit(1), F.length(name)), F.lit("))"), F.lit(")")))
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.array_join(X.smart_list(F.concat(t, F.lit("; "), brand, F.lit(", x"))), "|").alias("semicolons"), F.array_join(X.smart_list(F.concat(t, F.lit(", "), brand)), "|").alias("commas"),
        F.array_join(X.smart_list(name), "|").alias("blanks"), F.array_join(X.normalize_circular_path(F.array(t, brand, F.lit("M"))), "").alias("circle"), pairs.alias("p"), X.index(name, 0, F.length(name)).alias("after_view"),
    )
    inner = F.get("p.pairs", F.lit(0))
    return rows.select("p_partkey", "semicolons", "commas", "blanks", "circle", inner["open"].alias("inner_open"), inner["close"].alias("inner_close"), F.get("p.unmatched", F.lit(0)).alias("lone"), "after_view")
