"""Ranked feeds, listings, localisation and visitor countries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corrob import fixed_values as V
from corrob.functions.scores import is_public, rank_score
from corrob.functions.text import bind, json_list
from corrob.operators.similarity import salted_lookup


def _feed_order() -> list[Column]:
    return [F.desc("score"), F.desc_nulls_last("published_at"), F.asc("article_id")]


def _scored(articles: DataFrame, as_of: Column, local: bool) -> DataFrame:
    return articles.withColumn("score", rank_score(
        F.col("importance_score"), F.col("confidence_score"), F.col("published_at"), as_of, local))


def global_feed(articles: DataFrame, as_of: Column, n: int = V.FEED_LIMIT) -> DataFrame:
    """The ``n`` best published global articles; only ``n`` rows per task leave it."""
    live = articles.filter(F.col("is_published") & F.col("is_global"))
    return _scored(live, as_of, False).orderBy(*_feed_order()).limit(n)


def primary_mapping(country_sources: DataFrame) -> DataFrame:
    """Best enabled mapping of each country: highest priority, then lowest source."""
    best = F.min(F.struct((-F.col("priority")).alias("p"), "source_id"))
    return country_sources.filter("enabled").groupBy("country_key").agg(best.alias("b")).select(
        "country_key", F.col("b.source_id").alias("source_id"), (-F.col("b.p")).alias("priority"))


def local_feeds(articles: DataFrame, mappings: DataFrame, as_of: Column, n: int = V.FEED_LIMIT) -> DataFrame:
    """The local list of every mapped country, each event once, its own edition preferred.

    An article belongs to its locale and to its event's country, so it is
    spread to at most two countries instead of joined on an OR.
    """
    live = articles.filter("is_published").withColumn(
        "country_key", F.explode(F.array_distinct(F.array_compact(F.array("locale_key", "event_country_key")))))
    foreign = F.when(F.col("locale_key").eqNullSafe(F.col("country_key")), 0).otherwise(1)
    fields = ["published_at", "importance_score", "confidence_score"]
    chosen = live.groupBy("country_key", "event_id").agg(F.min(F.struct(
        foreign.alias("foreign"), F.when(F.col("is_global"), 0).otherwise(1).alias("partial"), "article_id", *fields)).alias("c"))
    chosen = chosen.select("country_key", "event_id", "c.article_id", *[f"c.{f}" for f in fields])
    served = chosen.join(primary_mapping(mappings).select("country_key"), "country_key", "left_semi")
    best = Window.partitionBy("country_key").orderBy(*_feed_order())
    return _scored(served, as_of, True).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n)


def latest_articles(articles: DataFrame, n: int = 20) -> DataFrame:
    return articles.filter("is_published").orderBy(F.desc("published_at"), "article_id").limit(max(1, min(n, 100)))


def public_events(events: DataFrame, n: int = 20) -> DataFrame:
    return events.filter(is_public(F.col("status"))).orderBy(
        F.desc("importance_score"), F.desc("last_updated_at"), "event_id").limit(max(1, min(n, 100)))


def list_sources(sources: DataFrame, enabled: bool | None = None, international: bool | None = None) -> DataFrame:
    if enabled is not None:
        sources = sources.filter(F.col("enabled") == enabled)
    if international is not None:
        sources = sources.filter(F.col("is_international") == international)
    return sources.orderBy(F.desc("priority"), "name")


def _at_most(n: int, limit: int) -> int:
    """The size of a listing; a request outside 1 to ``limit`` is refused, not cut."""
    if not 1 <= n <= limit:
        raise ValueError(f"a listing has 1 to {limit} rows, not {n}")
    return n


def list_jobs(jobs: DataFrame, job_type: str | None = None, status: str | None = None, n: int = 100) -> DataFrame:
    for column, wanted in (("job_type", job_type), ("status", status)):
        if wanted:
            jobs = jobs.filter(F.col(column) == wanted)
    return jobs.orderBy(F.desc("created_at"), "job_id").limit(_at_most(n, 500))


def rejected_queue(events: DataFrame, n: int = 50) -> DataFrame:
    return events.filter(F.col("status") == "EDITORIAL_REVIEW").orderBy(
        F.desc("importance_score"), "event_id").limit(_at_most(n, 200))


def lookup(df: DataFrame, **keys) -> DataFrame:
    """Rows with the given key values; the equality reaches the parquet scan."""
    for column, value in keys.items():
        df = df.filter(F.col(column) == value)
    return df


def event_review(events: DataFrame, facts: DataFrame, conflicts: DataFrame, status: str | None = None,
                 n: int = 50) -> DataFrame:
    """The newest events with their facts and conflicts nested.

    The list is cut to at most 500 events before anything is joined, which is
    what makes broadcasting it safe.
    """
    picked = (events.filter(F.col("status") == status) if status else events).orderBy(
        F.desc("last_updated_at"), "event_id").limit(_at_most(n, 500))
    few = F.broadcast(picked.select("event_id"))
    nested_facts = facts.join(few, "event_id", "left_semi").groupBy("event_id").agg(
        F.array_sort(F.collect_list(F.struct("fact_type", "fact_key", "statement"))).alias("facts"))
    nested_conflicts = conflicts.join(few, "event_id", "left_semi").groupBy("event_id").agg(
        F.array_sort(F.collect_list(F.struct("claim", "status"))).alias("conflicts"))
    return picked.join(nested_facts, "event_id", "left").join(nested_conflicts, "event_id", "left")


def article_detail(articles: DataFrame, attributions: DataFrame, images: DataFrame) -> DataFrame:
    """Published articles with decoded lists, their sources and one image."""
    sources = attributions.groupBy("article_id").agg(
        F.array_sort(F.collect_list(F.struct("source_name", "url", "is_independent"))).alias("sources"))
    image = images.groupBy("article_id").agg(F.min(F.struct("image_id", "ephemeral_url")).alias("image"))
    detail = articles.filter("is_published").withColumn("key_points", json_list(F.col("key_points")))
    return detail.join(sources, "article_id", "left").join(image, "article_id", "left")


def country_source_listing(country_sources: DataFrame, sources: DataFrame) -> DataFrame:
    named = sources.select("source_id", F.col("slug").alias("source_slug"), F.col("name").alias("source_name"))
    return country_sources.join(named, "source_id").select(
        "country_key", "role", "priority", "enabled", "source_slug", "source_name").orderBy(
        "country_key", F.desc("priority"))


def localized_countries(events: DataFrame, members: DataFrame, country_sources: DataFrame, countries: DataFrame) -> DataFrame:
    """(event_id, country_key) pairs to write an edition for.

    The event's own country when supported; otherwise the countries whose
    enabled local source reported it.
    """
    supported = countries.filter("is_supported").select("country_key")
    own = events.select("event_id", "country_key").join(supported, "country_key", "left_semi")
    rest = events.select("event_id").join(own, "event_id", "left_anti")
    reporting = members.select("event_id", "source_id").distinct().join(rest, "event_id", "left_semi")
    local = country_sources.filter("enabled").select("country_key", "source_id")
    told = reporting.join(local, "source_id").select("event_id", "country_key").distinct()
    return own.select("event_id", "country_key").unionByName(told)


_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IPV4 = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"


def ipv4_number(ip: Column) -> Column:
    """Dotted address as a number; NULL when malformed."""
    octets = [F.regexp_extract(ip, _IPV4, g).cast("bigint") for g in (1, 2, 3, 4)]
    value = octets[0] * 16777216 + octets[1] * 65536 + octets[2] * 256 + octets[3]
    return F.when(ip.rlike(_IPV4), value)


def _bits(hex_digits: Column, words: int) -> Column:
    """Hexadecimal text of ``words`` groups of eight digits as ones and zeros."""
    return F.concat(*[F.lpad(F.conv(F.substring(hex_digits, 8 * i + 1, 8), 16, 2), 32, "0") for i in range(words)])


def address_bits(ip: Column) -> Column:
    """An address as text of 32 (IPv4) or 128 (IPv6) bits; NULL when malformed.

    An IPv6 address may be shortened once by ``::`` and end in dotted form.
    """

    def groups(side: Column) -> Column:
        return F.when(side == "", F.array().cast("array<string>")).otherwise(F.split(side, ":", -1))

    def spread(plain: Column) -> Column:
        """The eight groups; fewer or more when malformed."""
        halves = F.split(plain, "::", -1)
        return bind(halves, lambda h: bind(groups(h[0]), lambda left: bind(
            F.when(F.size(h) == 2, groups(F.get(h, F.lit(1)))).otherwise(F.array().cast("array<string>")), lambda right: F.when(
                F.size(h) > 2, F.array().cast("array<string>")).when(F.size(h) == 1, left).otherwise(F.concat(
                    left, F.array_repeat(F.lit("0"), F.greatest(8 - F.size(left) - F.size(right), F.lit(1))), right)))))

    def six(plain: Column) -> Column:
        return bind(spread(plain), lambda g: F.when(
            (F.size(g) == 8) & F.forall(g, lambda x: x.rlike("^[0-9a-f]{1,4}$")),
            _bits(F.array_join(F.transform(g, lambda x: F.lpad(x, 4, "0")), ""), 4)))

    def hexed(plain: Column) -> Column:
        """A dotted end as two groups."""
        dotted = bind(ipv4_number(F.regexp_extract(plain, r"([0-9.]+)$", 1)), lambda n: F.lpad(F.lower(F.hex(n)), 8, "0"))
        return F.when(plain.contains("."), bind(dotted, lambda d: F.concat(
            F.regexp_extract(plain, r"^(.*:)[0-9.]+$", 1), F.substring(d, 1, 4), F.lit(":"), F.substring(d, 5, 4)))).otherwise(plain)

    def four(plain: Column) -> Column:
        return bind(ipv4_number(plain), lambda n: F.lpad(F.conv(n.cast("string"), 10, 2), 32, "0"))

    return bind(F.lower(ip), lambda p: F.when(p.contains(":"), bind(hexed(p), six)).otherwise(four(p)))


def geo_enrich(visits: DataFrame, cidrs: DataFrame, row_key: str) -> DataFrame:
    """Add ``country_code`` and ``resolved`` to rows with an ``ip``, IPv4 or IPv6.

    ``cidrs`` is (ord, cidr, code); of the networks that hold an address the
    first listed wins.  A distinct address is looked up once under each prefix
    length that networks of its family have (129 at most), an equality join on
    the prefix's bits, so a busy address is no hot key and a wide network no
    list of blocks.
    """
    length = F.substring_index("cidr", "/", -1).cast("int")
    base = address_bits(F.substring_index("cidr", "/", 1))
    networks = cidrs.select("ord", "code", F.length(base).alias("family"), length.alias("length"), base.alias("bits")).filter(
        F.col("length").between(0, F.col("family"))).withColumn("prefix", F.substring(F.col("bits"), F.lit(1), F.col("length"))).drop("bits")
    lengths = networks.groupBy("family").agg(F.collect_set("length").alias("lengths"))
    addresses = visits.select("ip").distinct().withColumn("bits", address_bits(F.col("ip"))).filter(
        F.col("bits").isNotNull()).withColumn("family", F.length("bits"))
    tried = addresses.join(lengths, "family").select("ip", "bits", "family", F.explode("lengths").alias("length")).withColumn(
        "prefix", F.substring(F.col("bits"), F.lit(1), F.col("length")))
    held = tried.join(networks, ["family", "length", "prefix"])
    known = held.groupBy("ip").agg(F.min(F.struct("ord", "code")).alias("m")).select(
        "ip", F.upper(F.nullif(F.col("m.code"), F.lit(""))).alias("found"))
    return salted_lookup(visits, known, ["ip"], [row_key]).withColumn(
        "country_code", F.coalesce("found", F.lit(V.GLOBAL_COUNTRY))).withColumn(
        "resolved", F.col("found").isNotNull()).drop("found")
