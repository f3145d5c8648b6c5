"""Landed feeds and web pages as entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corrob.functions.text import bind, canonicalize_url, strip, strip_html

_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
#: Zone names of RFC 822 and their offsets.  Other names count as UTC.
ZONES = {"gmt": "+00:00", "utc": "+00:00", "ut": "+00:00", "z": "+00:00", "est": "-05:00", "edt": "-04:00", "cst": "-06:00",
         "cdt": "-05:00", "mst": "-07:00", "mdt": "-06:00", "pst": "-08:00", "pdt": "-07:00"}
_CLOCK = r"(?:[T,\s]+(?:at\s+)?(\d{1,2}:\d{2})(:\d{2})?(\.\d{1,6})?\d*)?\s*([AaPp][Mm])?\s*([+-]\d{2}:?\d{2}|[A-Za-z]{1,5})?$"
#: Date spellings: pattern of the date part, and the groups of year, month and day in it.
_SPELLINGS = [(r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", (1, 2, 3)),
              (r"^(\d{1,2})[-\s]+([A-Za-z]{3})[a-z]*\.?[-,\s]+(\d{4}|\d{2})(?!\d)", (3, 2, 1)),
              (r"^([A-Za-z]{3})[a-z]*\.?\s+(\d{1,2})(?:st|nd|rd|th)?(?:,\s*|\s+)(\d{4})", (3, 1, 2))]


def _spelled(text: Column, pattern: str, groups: tuple[int, int, int]) -> Column:
    """The time in ``text`` if it has this spelling.  All groups come out of one replacement, cut at a mark no group can hold."""
    spelled, mark = pattern + _CLOCK, "\u0001"
    parts = F.split(F.regexp_replace(text, spelled, "".join(f"${i}{mark}" for i in range(1, 9))), mark)
    return F.when(text.rlike(spelled), bind(parts, lambda part: _time(part, groups)))


def _time(part: Column, groups: tuple[int, int, int]) -> Column:
    year, month, day = (part[g - 1] for g in groups)
    clock, seconds, fraction, half, zone = (part[i - 1] for i in range(4, 9))
    full_year = F.when(F.length(year) == 4, year).otherwise(F.concat(F.when(year < "70", "20").otherwise("19"), year))
    known = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.lower(month)).cast("string")
    number = F.when(month.between("0", "9~"), month).otherwise(known)
    hour = F.substring_index(clock, ":", 1).try_cast("int")
    shifted = F.when(F.lower(half) == "pm", hour % 12 + 12).when(F.lower(half) == "am", hour % 12).otherwise(hour)
    time = F.when(clock == "", "00:00:00").otherwise(F.concat(
        F.lpad(shifted.cast("string"), 2, "0"), F.lit(":"), F.substring_index(clock, ":", -1),
        F.when(seconds == "", ":00").otherwise(seconds), fraction))
    names = F.create_map(*[F.lit(x) for pair in ZONES.items() for x in pair])
    offset = F.when(F.left(zone, F.lit(1)).isin("+", "-"), F.concat(F.substring(zone, 1, 3), F.lit(":"), F.substring(zone, -2, 2))).otherwise(
        F.coalesce(F.try_element_at(names, F.lower(zone)), F.lit("+00:00")))
    iso = F.concat(full_year, F.lit("-"), F.lpad(number, 2, "0"), F.lit("-"), F.lpad(day, 2, "0"), F.lit("T"), time, offset)
    return iso.try_cast("timestamp")


def parse_entry_ts(*texts: Column) -> Column:
    """First parseable of several date texts; else NULL.

    A date part is required, so nothing depends on the clock: ISO 8601 and
    year-first dates, RFC 822 with or without seconds, month-first dates, zone
    names and offsets, am and pm.  Two-digit years are 1970 to 2069; a text
    without a zone is UTC; a leading weekday carries no information.
    """

    def read(text: Column) -> Column:
        return F.coalesce(*[_spelled(text, pattern, groups) for pattern, groups in _SPELLINGS])

    # bound, so that a text is trimmed once and not once for every part of every spelling
    blank = " \t\n\x0b\f\r"
    trimmed = [F.ltrim(F.rtrim(text, F.lit(blank + "\x85\u2028\u2029")), F.lit(blank)) for text in texts]
    return F.coalesce(*[bind(F.regexp_replace(text, r"^[A-Za-z]+,\s*", ""), read) for text in trimmed])


# names without their prefix: ``date`` and ``creator`` are Dublin Core, ``encoded`` is the content module
_RSS = (T.StructType().add("title", "string").add("link", "string").add("description", "string").add("encoded", "string")
        .add("pubDate", "string").add("date", "string").add("author", "string").add("creator", "string")
        .add("_corrupt_record", "string"))
_ATOM_LINK = T.ArrayType(T.StructType().add("_href", "string").add("_rel", "string"))
_ATOM = (T.StructType().add("title", "string").add("link", _ATOM_LINK).add("summary", "string").add("content", "string")
         .add("published", "string").add("updated", "string").add("created", "string")
         .add("author", T.StructType().add("name", "string")).add("_corrupt_record", "string"))
#: A ``language`` element is read by itself, so no channel is ever one row.
_LANGUAGE = T.StructType().add("_VALUE", "string").add("_corrupt_record", "string")


def _file_name(c: Column) -> Column:
    """One spelling of local file names, which readers give with one or three slashes."""
    return F.regexp_replace(c, "^file:/+", "file:/")


def _scan(spark: SparkSession, path: str | list[str], tag: str, schema: T.StructType) -> DataFrame:
    return (spark.read.format("xml").option("rowTag", tag).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record").option("ignoreNamespace", "true")
            .schema(schema).load(path).withColumn("feed_file", _file_name(F.input_file_name())))


def read_feed_entries(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """RSS, RDF and Atom files under ``path`` -> one row per usable entry.

    An entry needs a link and a title.  Of the date fields the first that can
    be read counts, ``dc:date`` after ``pubDate``; a missing description is
    taken from ``content:encoded`` or ``content``, a missing author from
    ``dc:creator``.  The feed's language (the last in order of several) is
    copied to each of its entries.  Broken entries go to :func:`read_feed_rejects`.
    """

    def filled(*names: str) -> Column:
        return F.coalesce(*[F.when(strip(F.col(n)) != "", F.col(n)) for n in names])

    rss = _scan(spark, path, "item", _RSS).filter(F.col("_corrupt_record").isNull()).select(
        "feed_file", "title", "link", filled("description", "encoded").alias("description"),
        parse_entry_ts(F.col("pubDate"), F.col("date")).alias("published_at"), filled("author", "creator").alias("author"))
    alternate = F.coalesce(
        F.try_element_at(F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(1)),
        F.try_element_at("link", F.lit(1)))
    atom = _scan(spark, path, "entry", _ATOM).filter(F.col("_corrupt_record").isNull()).select(
        "feed_file", "title", alternate["_href"].alias("link"), filled("summary", "content").alias("description"),
        parse_entry_ts(F.col("published"), F.col("updated"), F.col("created")).alias("published_at"),
        F.col("author.name").alias("author"))
    languages = _scan(spark, path, "language", _LANGUAGE).groupBy("feed_file").agg(
        F.max(F.nullif(strip(F.col("_VALUE")), F.lit(""))).alias("language"))
    entries = rss.unionByName(atom).select(
        "feed_file", strip_html(F.col("title")).alias("title"), strip_html(F.col("description")).alias("description"),
        strip(F.coalesce("link", F.lit(""))).alias("link"), "published_at", "author")
    usable = entries.filter((F.col("link") != "") & (F.col("title") != ""))
    return usable.withColumn("canonical_url", canonicalize_url(F.col("link"))).join(languages, "feed_file", "left")


def read_feed_rejects(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Quarantine: broken entries, and files without any readable entry."""
    rss, atom = _scan(spark, path, "item", _RSS), _scan(spark, path, "entry", _ATOM)
    fields = ["feed_file", "title", F.col("link").isNotNull().alias("linked"), "_corrupt_record"]
    entries = rss.select(*fields).unionByName(atom.select(*fields))
    filled = F.col("title").isNotNull() | F.col("linked")
    readable = entries.filter(F.col("_corrupt_record").isNull() & filled).select("feed_file").distinct()
    broken = entries.filter(F.col("_corrupt_record").isNotNull()).select(
        "feed_file", F.lit("broken entry").alias("problem"), F.coalesce("_corrupt_record", "title").alias("payload"))
    files = spark.read.format("binaryFile").load(path).select(_file_name(F.col("path")).alias("feed_file"))
    empty = files.join(readable, "feed_file", "left_anti").select(
        "feed_file", F.lit("feed could not be parsed").alias("problem"), F.lit(None).cast("string").alias("payload"))
    return broken.distinct().join(readable, "feed_file", "left_semi").unionByName(empty)


def read_page_entries(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) -> title, body text and canonical address of each page."""
    title = F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)
    return pages.select(
        "page_id", F.col("url").alias("link"), strip_html(title).alias("title"),
        strip_html(F.col("html")).alias("description"), canonicalize_url(F.col("url")).alias("canonical_url"))
