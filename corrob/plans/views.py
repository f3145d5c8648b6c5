"""Model tables derived from the driver's parquet tables.

Each view exists twice: as a DataFrame, and as an SQL text (``SQL[name]``) the
oracle queries put in a WITH clause.  Every view covers its whole base table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF_EVENTS = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of_events() -> Column:
    return F.lit(AS_OF_EVENTS).cast("timestamp_ntz")


def as_of_orders(spark: SparkSession, sf_dir: str) -> Column:
    """One day after the last order, as a scalar of the data."""
    newest = table(spark, sf_dir, "orders").agg((F.max("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("m"))
    return newest.scalar()


PLACES = ["Japan", "Chile", "Greece", "Nepal", "Peru", "Kenya"]
OPENINGS = ["Earthquake strikes ", "Quake hits ", "Strong earthquake strikes ", "Powerful earthquake hits ",
            "Flooding in "]
EVENT_STATUSES = ["DETECTED", "CLUSTERING", "VERIFYING", "VERIFIED", "EDITORIAL_REVIEW", "PUBLISHED", "UPDATING",
                  "ARCHIVED", "UNVERIFIED", "WAIT"]
EVENT_KINDS = ["earthquake", "flood", "politics", "sports", "volcano", "conflict", "health"]


def _pick(index: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headline-like reports with places, tolls, magnitudes and planted conflicts."""
    suppliers = table(spark, sf_dir, "supplier").agg(F.count(F.lit(1))).scalar()
    user, day = F.col("user_id"), F.day("ts")
    place = _pick(day % 6, PLACES)
    deaths = 5 + day % 3 + F.when((user % 17 == 0) & (day % 2 == 0), 7).otherwise(0)
    injured = 40 + F.when((user % 3 == 0) & (day % 5 == 0), 1).otherwise(0)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("report_id"),
        (user % suppliers).alias("source_id"),
        F.concat_ws("-", place, day.cast("string"), F.floor(F.hour("ts") / 6).cast("string")).alias("event_key"),
        F.col("ts").alias("published_at"),
        F.col("ts").alias("retrieved_at"),
        F.concat(_pick(user % 5, OPENINGS), place, F.lit(" killing "), deaths.cast("string")).alias("title"),
        F.concat(F.lit("A magnitude "), (5 + day % 4).cast("string"), F.lit("."), (day % 10).cast("string"),
                 F.lit(" event on "), day.cast("string"), F.lit(" January 2024. Officials said "),
                 injured.cast("string"), F.lit(" people were injured.")).alias("description"),
        F.col("event_type").alias("kind"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    official = F.when(s % 7 == 0, F.lit("National Agency ")).otherwise(F.lit("Publisher "))
    return table(spark, sf_dir, "supplier").select(
        s.alias("source_id"),
        F.concat(F.lit("src"), s.cast("string")).alias("slug"),
        F.concat(official, s.cast("string")).alias("name"),
        F.when(s % 4 == 1, s - 1).alias("lineage_root_id"),
        (60 + F.col("s_nationkey")).cast("double").alias("reliability_score"),
        F.col("s_nationkey").alias("country_key"),
        F.when(s % 3 == 0, "es").when(s % 3 == 1, "").otherwise("de").alias("language"),
        (s % 2 == 0).alias("raw_text_permitted"),
        (s % 9 != 0).alias("enabled"),
        (s % 3 == 0).alias("is_international"),
        (s % 101).cast("int").alias("priority"),
        F.lit(300).alias("poll_interval_seconds"))


def country_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("country_key"), s.alias("source_id"),
        ((s * 37) % 101).cast("int").alias("priority"), (s % 5 != 0).alias("enabled"),
        F.lit("primary").alias("role"))


def countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("country_key"), F.col("n_name").alias("name"),
        (F.col("n_nationkey") % 2 == 0).alias("is_supported"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").join(
        table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).select(
        o.alias("article_id"), F.col("o_custkey").alias("event_id"),
        (F.col("o_orderstatus") != "P").alias("is_published"), (o % 3 != 0).alias("is_global"),
        F.when(o % 3 == 0, F.col("c_nationkey")).alias("locale_key"),
        F.col("c_nationkey").alias("event_country_key"), F.col("o_orderdate").alias("published_at"),
        (o % 101).cast("double").alias("importance_score"),
        ((o * 7) % 101).cast("double").alias("confidence_score"),
        F.concat(F.lit("Order "), F.col("o_orderpriority")).alias("headline"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event per customer, dated by its orders."""
    c = F.col("c_custkey")
    dated = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.min("o_orderdate").alias("first_detected_at"), F.max("o_orderdate").alias("last_updated_at"),
        F.count(F.lit(1)).alias("report_count"))
    return table(spark, sf_dir, "customer").join(dated, c == F.col("o_custkey")).select(
        c.alias("event_id"), F.col("c_name").alias("title"), _pick(c % 7, EVENT_KINDS).alias("event_type"),
        F.col("c_nationkey").alias("country_key"), _pick(c % 10, EVENT_STATUSES).alias("status"),
        "first_detected_at", "last_updated_at", "report_count",
        (c * 13 % 101).cast("double").alias("importance_score"),
        (c * 29 % 101).cast("double").alias("confidence_score"),
        F.when(c % 4 == 0, 1).otherwise(0).alias("conflict_count"))


def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("event_id"), F.concat(F.lit("claim "), o.cast("string")).alias("claim"),
        F.when(F.col("o_orderstatus") == "O", "unresolved").otherwise("resolved").alias("status"))


def article_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("article_id"), F.col("l_linenumber").alias("version"))


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.col("event_type") != "error"
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("source_id"), F.col("ts").alias("checked_at"), ok.alias("ok"),
        (F.col("value") * 50).alias("latency_ms"), F.col("event_id").alias("poll_id"),
        F.when(~ok, F.concat(F.lit("timeout "), F.col("props"))).alias("error"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"),
        F.when(status == "F", "SUCCEEDED").when(status == "O", "PENDING").otherwise("DEAD").alias("status"),
        F.col("o_orderpriority").alias("job_type"), (F.col("o_orderkey") % 6).cast("int").alias("attempts"),
        F.col("o_orderdate").alias("updated_at"),
        (F.col("o_orderdate") - F.make_dt_interval((F.col("o_orderkey") % 9).cast("int"))).alias("created_at"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages and event rows as feed entries, some unusable, one batch."""
    from corrob.sources.feeds import read_page_entries

    pages = read_page_entries(table(spark, sf_dir, "pages")).select(
        F.col("page_id").alias("entry_id"), (F.col("page_id") % 50).alias("source_id"), "title",
        "description", "link", F.lit(None).cast("timestamp_ntz").alias("published_at"),
        F.lit("").alias("language"))
    e = F.col("event_id")
    user = F.col("user_id").cast("string")
    link = (F.when(e % 11 == 0, F.concat(F.lit("ftp://wire.example/"), user))
            .when(e % 7 == 0, "")
            .otherwise(F.concat(F.lit("http://wire.example/u/"), user, F.lit("?utm_source=x&d="),
                                F.day("ts").cast("string"))))
    rows = table(spark, sf_dir, "events").select(
        (1000000000 + e).alias("entry_id"), (F.col("user_id") % 50).alias("source_id"),
        F.when(e % 13 == 0, "  ").otherwise(F.concat(F.lit("User "), user, F.lit(" did "), "event_type")).alias("title"),
        F.col("props").alias("description"), link.alias("link"),
        F.when(e % 17 == 0, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")).otherwise(F.col("ts")).alias("published_at"),
        F.when(e % 2 == 0, "en-GB-oxendict-long-tag").alias("language"))
    return pages.unionByName(rows).withColumn("ord", F.col("entry_id"))


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports kept by an earlier run: other spellings of the same pages and titles."""
    from corrob.functions.text import content_hash, url_hash

    u = F.col("user_id").cast("string")
    rows = table(spark, sf_dir, "events").select(
        F.concat(F.lit("https://wire.example/u/"), u, F.lit("/?d="), (F.day("ts") * 2).cast("string")).alias("link"),
        F.concat(F.lit("USER "), u, F.lit(" did: purchase")).alias("title"),
        F.col("props").alias("description"))
    return rows.select(url_hash(F.col("link")).alias("canonical_url_hash"),
                       content_hash(F.col("title"), F.col("description")).alias("content_hash"))


_NORM = "trim(regexp_replace(replace(lower({0}), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"


def sql_norm(expr: str) -> str:
    return _NORM.format(expr)


def sql_canonical(url: str) -> str:
    """Oracle form of URL canonicalisation for plain http(s) links."""
    rest = f"regexp_replace(split_part({url}, '#', 1), '^https?://', '')"
    loc = f"split_part({rest}, '?', 1)"
    query = f"CASE WHEN contains({rest}, '?') THEN regexp_replace({rest}, '^[^?]*[?]', '') ELSE '' END"
    kept = ("list_filter(list_sort(string_split({q}, '&')), lambda p: regexp_matches(p, '^[^=]+=.') AND "
            "NOT regexp_matches(lower(p), '^(utm_[a-z]+|ref|ref_src|ref_url|source|gclid|fbclid|spm)='))").format(q=query)
    host = f"lower(split_part({loc}, '/', 1))"
    path = f"regexp_replace(regexp_replace({loc}, '^[^/]*', ''), '/+$', '')"
    base = f"('https://' || {host} || CASE WHEN {path} = '' THEN '/' ELSE {path} END)"
    return (f"({base} || CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END)")


_TITLE = r"trim(regexp_replace(replace(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '^\s+|\s+$', '', 'g'))"
_BODY = r"trim(regexp_replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '^\s+|\s+$', '', 'g'))"

SQL = {
    "reports": f"""reports AS (
  SELECT event_id AS report_id, user_id % (SELECT count(*) FROM supplier) AS source_id,
    ({_sql_list(PLACES)})[CAST(day(ts) % 6 AS INT) + 1] || '-' || CAST(day(ts) AS VARCHAR) || '-' ||
      CAST(hour(ts) // 6 AS VARCHAR) AS event_key,
    ({_sql_list(PLACES)})[CAST(day(ts) % 6 AS INT) + 1] AS place,
    ts AS published_at, ts AS retrieved_at,
    ({_sql_list(OPENINGS)})[CAST(user_id % 5 AS INT) + 1] || ({_sql_list(PLACES)})[CAST(day(ts) % 6 AS INT) + 1]
      || ' killing ' || CAST(5 + day(ts) % 3 + CASE WHEN user_id % 17 = 0 AND day(ts) % 2 = 0 THEN 7 ELSE 0 END AS VARCHAR) AS title,
    'A magnitude ' || CAST(5 + day(ts) % 4 AS VARCHAR) || '.' || CAST(day(ts) % 10 AS VARCHAR) || ' event on '
      || CAST(day(ts) AS VARCHAR) || ' January 2024. Officials said '
      || CAST(40 + CASE WHEN user_id % 3 = 0 AND day(ts) % 5 = 0 THEN 1 ELSE 0 END AS VARCHAR) || ' people were injured.' AS description,
    CAST(5 + day(ts) % 3 + CASE WHEN user_id % 17 = 0 AND day(ts) % 2 = 0 THEN 7 ELSE 0 END AS DOUBLE) AS deaths,
    CAST(40 + CASE WHEN user_id % 3 = 0 AND day(ts) % 5 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS injured,
    CAST(CAST(5 + day(ts) % 4 AS VARCHAR) || '.' || CAST(day(ts) % 10 AS VARCHAR) AS DOUBLE) AS magnitude,
    '2024-01-' || lpad(CAST(day(ts) AS VARCHAR), 2, '0') AS iso_day
  FROM events)""",
    "sources": """sources AS (
  SELECT s_suppkey AS source_id, 'src' || CAST(s_suppkey AS VARCHAR) AS slug,
    CASE WHEN s_suppkey % 7 = 0 THEN 'National Agency ' ELSE 'Publisher ' END || CAST(s_suppkey AS VARCHAR) AS name,
    CASE WHEN s_suppkey % 4 = 1 THEN s_suppkey - 1 END AS lineage_root_id,
    CAST(60 + s_nationkey AS DOUBLE) AS reliability_score, s_nationkey AS country_key,
    CASE WHEN s_suppkey % 3 = 0 THEN 'es' WHEN s_suppkey % 3 = 1 THEN '' ELSE 'de' END AS language,
    s_suppkey % 2 = 0 AS raw_text_permitted, s_suppkey % 9 <> 0 AS enabled, s_suppkey % 3 = 0 AS is_international,
    CAST(s_suppkey % 101 AS INT) AS priority, 300 AS poll_interval_seconds
  FROM supplier)""",
    "country_sources": """country_sources AS (
  SELECT s_nationkey AS country_key, s_suppkey AS source_id, CAST((s_suppkey * 37) % 101 AS INT) AS priority,
    s_suppkey % 5 <> 0 AS enabled, 'primary' AS role FROM supplier)""",
    "countries": """countries AS (
  SELECT n_nationkey AS country_key, n_name AS name, n_nationkey % 2 = 0 AS is_supported FROM nation)""",
    "articles": """articles AS (
  SELECT o_orderkey AS article_id, o_custkey AS event_id, o_orderstatus <> 'P' AS is_published,
    o_orderkey % 3 <> 0 AS is_global, CASE WHEN o_orderkey % 3 = 0 THEN c_nationkey END AS locale_key,
    c_nationkey AS event_country_key, o_orderdate AS published_at, CAST(o_orderkey % 101 AS DOUBLE) AS importance_score,
    CAST((o_orderkey * 7) % 101 AS DOUBLE) AS confidence_score, 'Order ' || o_orderpriority AS headline
  FROM orders JOIN customer ON c_custkey = o_custkey)""",
    "event_rows": f"""event_rows AS (
  SELECT c_custkey AS event_id, c_name AS title, ({_sql_list(EVENT_KINDS)})[CAST(c_custkey % 7 AS INT) + 1] AS event_type,
    c_nationkey AS country_key, ({_sql_list(EVENT_STATUSES)})[CAST(c_custkey % 10 AS INT) + 1] AS status,
    first_detected_at, last_updated_at, report_count, CAST(c_custkey * 13 % 101 AS DOUBLE) AS importance_score,
    CAST(c_custkey * 29 % 101 AS DOUBLE) AS confidence_score, CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END AS conflict_count
  FROM customer JOIN (SELECT o_custkey, min(o_orderdate) AS first_detected_at, max(o_orderdate) AS last_updated_at,
    count(*) AS report_count FROM orders GROUP BY o_custkey) d ON c_custkey = o_custkey)""",
    "conflicts": """conflicts AS (
  SELECT o_custkey AS event_id, 'claim ' || CAST(o_orderkey AS VARCHAR) AS claim,
    CASE WHEN o_orderstatus = 'O' THEN 'unresolved' ELSE 'resolved' END AS status FROM orders)""",
    "article_versions": "article_versions AS (SELECT l_orderkey AS article_id, l_linenumber AS version FROM lineitem)",
    "polls": """polls AS (
  SELECT user_id AS source_id, ts AS checked_at, event_type <> 'error' AS ok, value * 50 AS latency_ms, event_id AS poll_id,
    CASE WHEN event_type = 'error' THEN 'timeout ' || props END AS error FROM events)""",
    "jobs": """jobs AS (
  SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'F' THEN 'SUCCEEDED' WHEN 'O' THEN 'PENDING' ELSE 'DEAD' END AS status,
    o_orderpriority AS job_type, CAST(o_orderkey % 6 AS INT) AS attempts, o_orderdate AS updated_at,
    o_orderdate - to_days(CAST(o_orderkey % 9 AS INT)) AS created_at FROM orders)""",
    "as_of_orders": "clock AS (SELECT max(o_orderdate) + INTERVAL 1 DAY AS as_of FROM orders)",
    "entries": f"""entries AS (
  SELECT *, entry_id AS ord FROM (
    SELECT page_id AS entry_id, page_id % 50 AS source_id, {_TITLE} AS title, {_BODY} AS description,
      url AS link, CAST(NULL AS TIMESTAMP) AS published_at, '' AS language FROM pages
    UNION ALL
    SELECT 1000000000 + event_id, user_id % 50,
      CASE WHEN event_id % 13 = 0 THEN '  ' ELSE 'User ' || CAST(user_id AS VARCHAR) || ' did ' || event_type END,
      props,
      CASE WHEN event_id % 11 = 0 THEN 'ftp://wire.example/' || CAST(user_id AS VARCHAR) WHEN event_id % 7 = 0 THEN ''
        ELSE 'http://wire.example/u/' || CAST(user_id AS VARCHAR) || '?utm_source=x&d=' || CAST(day(ts) AS VARCHAR) END,
      CASE WHEN event_id % 17 = 0 THEN TIMESTAMP '2024-02-01 00:00:00' ELSE ts END,
      CASE WHEN event_id % 2 = 0 THEN 'en-GB-oxendict-long-tag' END FROM events) e)""",
    "stored": f"""stored AS (
  SELECT sha256({sql_canonical("link")}) AS canonical_url_hash,
    sha256({sql_norm("title")} || chr(10) || {sql_norm("description")}) AS content_hash FROM (
    SELECT 'https://wire.example/u/' || CAST(user_id AS VARCHAR) || '/?d=' || CAST(day(ts) * 2 AS VARCHAR) AS link,
      'USER ' || CAST(user_id AS VARCHAR) || ' did: purchase' AS title, props AS description FROM events) s)""",
}


def with_views(*names: str) -> str:
    """``WITH`` clause that defines the named views."""
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n"
