"""Queries over headlines, listings and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from hindcast.functions import text as T
from hindcast.plans.registry import query, rounded
from hindcast.sources.adapters import table
from hindcast.sources.html import html_items

LEXICON, NEGATIONS, INTENSIFIERS = {"for": 1.4, "was": -1.3, "with": 1.2, "by": -1.8}, ["not", "no", "is"], {"on": 1.4, "be": 0.7}


def headlines(spark, sf_dir):
    """The first twelve words of every document with the time of the event of its number."""
    docs, events = table(spark, sf_dir, "documents"), table(spark, sf_dir, "events")
    words = F.array_join(F.slice(F.split(F.coalesce("text", F.lit("")), " "), 1, 12), " ")
    rows = docs.select(F.col("doc_id").alias("id"), "source", F.coalesce("text", F.lit("")).alias("text"), words.alias("title"))
    return rows.join(events.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("published")), "id", "left")


_SCORED = """tok AS (SELECT doc_id AS id, source, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+(?:''[a-z]+)?') AS t FROM documents),
w AS (SELECT id, t, unnest(range(1, len(t) + 1)) AS i FROM tok), h AS (SELECT id, t, i, t[i] AS word, CASE t[i] WHEN 'for' THEN 1.4 WHEN 'was' THEN -1.3 WHEN 'with' THEN 1.2 ELSE -1.8 END * CASE WHEN i > 1 AND list_has_any(t[greatest(i - 3, 1):i - 1], ['not', 'no', 'is']) THEN -1 ELSE 1 END
 * CASE WHEN i > 1 AND t[i - 1] = 'on' THEN 1.4 WHEN i > 1 AND t[i - 1] = 'be' THEN 0.7 ELSE 1 END AS c FROM w WHERE t[i] IN ('for', 'was', 'with', 'by')),
s AS (SELECT tok.id, tok.source, coalesce(sum(c), 0) AS raw FROM tok LEFT JOIN h ON h.id = tok.id GROUP BY 1, 2),
sc AS (SELECT id, source, tanh(raw / 3) AS score, CASE WHEN round(tanh(raw / 3), 9) >= 0.18 THEN 'Positive' WHEN round(tanh(raw / 3), 9) <= -0.18 THEN 'Negative' ELSE 'Neutral' END AS label FROM s)"""


@query("WITH " + _SCORED + " SELECT id, round(score, 6) AS score, label FROM sc")
def f11_lexicon_sentiment(spark, sf_dir):
    return T.lexicon_scores(headlines(spark, sf_dir), "id", "text", LEXICON, NEGATIONS, INTENSIFIERS).select("id", *rounded("score"), "label")


@query("WITH " + _SCORED + """, x AS (SELECT sc.*, CASE WHEN e.ts IS NOT NULL THEN (epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(e.ts)) / 3600.0 END AS hours FROM sc LEFT JOIN events e ON e.event_id = sc.id)
SELECT source, round(greatest(-1, least(1, sum(score * exp(-coalesce(hours, 72) / 120)) / greatest(sum(exp(-coalesce(hours, 72) / 120)), 1))), 5) AS sentiment, count_if(label = 'Positive') AS positive, count_if(label = 'Negative') AS negative, count_if(label = 'Neutral') AS neutral FROM x GROUP BY 1""")
def a41_a42_weighted_sentiment(spark, sf_dir):
    heads = headlines(spark, sf_dir)
    hours = (F.unix_micros(F.lit("2024-01-31 00:00:00").cast("timestamp")) - F.unix_micros("published")) / 3.6e9
    rows = T.lexicon_scores(heads, "id", "text", LEXICON, NEGATIONS, INTENSIFIERS).join(heads.select("id", "source", hours.alias("hours")), "id")
    return T.weighted_sentiment(rows, ["source"], "score", "hours").select("source", *rounded("sentiment", places=5), "positive", "negative", "neutral")


@query("""SELECT source, id FROM (SELECT source, doc_id AS id, row_number() OVER (PARTITION BY source ORDER BY age NULLS LAST, doc_id) AS n FROM (SELECT doc_id, source, (epoch(TIMESTAMP '2024-01-16 00:00:00') - epoch(ts)) / 86400.0 AS age FROM documents LEFT JOIN events ON event_id = doc_id) WHERE age IS NULL OR age <= 14) WHERE n <= 12""")
def p12_recent_headlines(spark, sf_dir):
    age = (F.unix_micros(F.lit("2024-01-16 00:00:00").cast("timestamp")) - F.unix_micros("published")) / 8.64e10
    return T.recent_headlines(headlines(spark, sf_dir).withColumn("age", age), ["source"], "age").select("source", "id")


@query("""SELECT page_id, CASE WHEN regexp_matches(url, '^https?:') THEN url ELSE '' END AS url FROM pages""")
def f34_url_scheme(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.web_url(F.col("url")).alias("url"))


@query("""SELECT event_id, date_trunc('second', ts) AS at FROM events""")
def f27_parsed_times(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.date_trunc("second", F.col("ts").cast("timestamp")))
    raw = F.when(F.col("event_id") % 3 == 0, F.unix_seconds("ts").cast("string")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return e.select("event_id", T.parsed_time(raw).alias("at"))


@query("""SELECT DISTINCT upper(c_mktsegment) || '-' || c_nationkey AS symbol FROM customer""")
def p6_symbols(spark, sf_dir):
    raw = F.concat(F.lit(" $"), F.lower("c_mktsegment"), F.lit("-"), F.col("c_nationkey").cast("string"), F.lit(" "))
    return table(spark, sf_dir, "customer").select(T.normal_symbol(raw).alias("symbol")).distinct()


_LIST = """SELECT 'S' || p_partkey || CASE WHEN p_size % 7 = 0 THEN '.A' ELSE '' END AS symbol, p_name || CASE p_size % 5 WHEN 0 THEN ' Warrant' WHEN 1 THEN ' - Common Stock' ELSE '' END AS name, CASE WHEN p_size % 11 = 0 THEN 'Y' ELSE 'N' END AS test_issue, CASE WHEN p_size % 13 = 0 THEN 'Y' ELSE 'N' END AS etf, CASE WHEN p_size % 17 = 0 THEN 'D' ELSE 'N' END AS financial_status FROM part"""


@query(f"""SELECT replace(symbol, '.', '-') AS symbol, trim(string_split(name, ' - ')[1]) AS name FROM ({_LIST}) WHERE test_issue = 'N' AND etf = 'N' AND financial_status = 'N' AND name NOT LIKE '%Warrant' AND NOT (length(symbol) = 5 AND right(symbol, 1) IN ('W', 'R', 'U', 'P'))""")
def s5_s6_p3_p4_p5_listings(spark, sf_dir):
    p, z = table(spark, sf_dir, "part"), F.col("p_size")
    flag = lambda k, y: F.when(z % k == 0, y).otherwise("N")
    rows = p.select(
        F.concat(F.lit("S"), F.col("p_partkey").cast("string"), F.when(z % 7 == 0, ".A").otherwise("")).alias("symbol"), F.concat("p_name", F.when(z % 5 == 0, " Warrant").when(z % 5 == 1, " - Common Stock").otherwise("")).alias("name"),
        flag(11, "Y").alias("test_issue"), flag(13, "Y").alias("etf"), flag(17, "D").alias("financial_status"),
    )
    return T.listed(rows)


@query("""WITH a AS (SELECT DISTINCT p_type AS symbol, 'first ' || p_type AS name, CASE WHEN p_type < 'M' THEN '' ELSE 'core' END AS sector FROM part), b AS (SELECT p_brand AS symbol, 'second ' || p_brand AS name, 'brands' AS sector FROM part GROUP BY 1 UNION ALL SELECT DISTINCT p_type, 'second ' || p_type, 'types' FROM part)
SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.name, b.name) AS name, coalesce(nullif(a.sector, ''), b.sector) AS sector, CASE WHEN a.symbol IS NULL THEN 'B' ELSE 'A' END AS list, CAST((a.symbol IS NOT NULL) AS BIGINT) + CAST((b.symbol IS NOT NULL) AS BIGINT) AS sources FROM a FULL JOIN b ON a.symbol = b.symbol""")
def j14_u2_c12_universe_merge(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    types, brands = p.select(F.col("p_type").alias("symbol")).distinct(), p.select(F.col("p_brand").alias("symbol")).distinct()
    a = types.select("symbol", F.concat(F.lit("first "), "symbol").alias("name"), F.when(F.col("symbol") < "M", "").otherwise("core").alias("sector"), F.lit("A").alias("list"))
    b = brands.withColumn("sector", F.lit("brands")).unionByName(types.withColumn("sector", F.lit("types"))).select("symbol", F.concat(F.lit("second "), "symbol").alias("name"), "sector", F.lit("B").alias("list"))
    return T.merge_universe([a, b])


@query("""SELECT page_id, count(*) AS items FROM (SELECT page_id, unnest(regexp_extract_all(html, '<li>')) FROM pages) GROUP BY 1""")
def s7_html_items(spark, sf_dir):
    return html_items(spark, table(spark, sf_dir, "pages"), "page_id", "html").groupBy("page_id").agg(F.count(F.lit(1)).alias("items"))


@query("""SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g') AS title, role AS publisher FROM conversations""")
def s10_headline_json(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    flat = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("title"), F.col("role").alias("publisher")))
    nested = F.to_json(F.struct(F.struct(F.coalesce("text", F.lit("")).alias("title"), F.struct(F.col("role").alias("displayName")).alias("provider")).alias("content")))
    schema = "title string, publisher string, content struct<title:string,provider:struct<displayName:string>>"
    j = rows.select("conv_id", "turn", F.from_json(F.when(F.col("turn") % 2 == 0, flat).otherwise(nested), schema).alias("j"))
    return j.select("conv_id", "turn", F.regexp_replace(F.coalesce("j.title", "j.content.title"), r"\s+", " ").alias("title"), F.coalesce("j.publisher", "j.content.provider.displayName").alias("publisher"))


@query("""SELECT lang, sha256(count(*) || ':' || CAST(sum(('0x' || substr(md5(to_json({'doc_id': doc_id, 'lang': lang, 'n_chars': n_chars, 'source': source, 'text': text})), 1, 15))::BIGINT) AS VARCHAR)) AS vintage FROM documents GROUP BY 1""")
def f14_content_hash(spark, sf_dir):
    """A vintage of each language's rows: order-free, summed map-side."""
    return vintages(table(spark, sf_dir, "documents"))


def vintages(docs):
    """Of each language: the hash of count and sum of its whole rows' hashes, nulls told from empty texts."""
    whole = F.to_json(F.struct(*sorted(docs.columns)), {"ignoreNullFields": "false"})
    number = F.conv(F.substring(F.md5(whole), 1, 15), 16, 10).cast("decimal(19,0)")
    rows = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(number).alias("s"))
    return rows.select("lang", F.sha2(F.concat_ws(":", F.col("n").cast("string"), F.col("s").cast("string")), 256).alias("vintage"))
