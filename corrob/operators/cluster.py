"""Event clustering: many reports of one happening become one event.

Reports are taken in order of arrival.  Each joins the live event that scores
best against it, if that reaches the threshold, and starts an event otherwise;
the event's centroid is the sum of its reports' vectors up to then.  The result
is that of the one-at-a-time pass for any batching: all reports at once, wave by
wave, or the micro-batches of a stream.

How Spark decides many at a time:

*Signatures.*  Texts that no signal can tell apart are one signature; facts and
vectors are worked out once for each distinct text.

*Neighbourhoods.*  With c the least cosine at which anything can be joined, a
report joins an event only if it has a cosine of c*c or more with one of the
event's reports, or with the centroid it had before: every joined report makes
the sum at least c longer, so with all cosines below c*c the sum could not
reach c.  Signatures and known events linked at c*c fall into components that
cannot influence each other, and neither can reports before and after a silence
longer than the time window.

*Optimistic replay.*  Reports sorted by neighbourhood and arrival are cut into
stretches of bounded size, and a task replays a stretch one report after
another.  A neighbourhood that spans several stretches is replayed
speculatively: every stretch starts from the known events and from what the
latest runs of the earlier stretches added to them.  Centroids are sums of
whole numbers, hence exact in any order.  A stretch whose start has changed
since it ran is run again, the others stand.  When nothing changes, each
stretch has run on exactly what the earlier ones leave, which is the
one-at-a-time result; each round settles one more stretch at least.

*State.*  What a batch changes is written as new versions of the events it
touched.  The next batch reads the versions within reach of its own times, so
its work does not grow with the events that have fallen silent.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from corrob import fixed_values as V
from corrob.functions.facts import report_facts
from corrob.functions.vectors import embed_tokens, hash_embedding_md5, sparse_unit, token_embedding
from corrob.operators.graph import connected
from corrob.operators.replay import replayer
from corrob.operators.similarity import bucket_ranks, prefix_join, prefix_of, salted_lookup
from corrob.session import ship_package, working_table, written

#: Cosine any attachable pair must reach, as the other signals add at most .20.
MIN_COSINE = (V.CLUSTER_THRESHOLD - V.WEIGHT_ENTITY - V.WEIGHT_NUMBER) / V.WEIGHT_SEMANTIC
#: Cosine below which a report has no influence on another (see above), less a margin for rounding.
NEAR = MIN_COSINE * MIN_COSINE - 1e-6
SCALE = 1 << 18  # vectors are whole multiples of 1 / SCALE
STRETCH = 20_000  # reports replayed in one task, or days of a signature if these are fewer
LONGEST = 400_000  # reports replayed in one task at most
WINDOW_US = V.EVENT_WINDOW_HOURS * 3_600_000_000

EVENT_COLUMNS = ["event_id", "started", "title", "event_type", "entities", "numbers", "total", "report_count",
                 "first_detected_at", "last_activity"]
_WHOLE = "array<struct<bucket:int,w:bigint>>"


def default_embedder(texts: DataFrame) -> DataFrame:
    """Adds ``vec``, a hashed sparse unit vector of the headline.

    Any function of this shape can take its place in :func:`cluster_events`.
    """
    return texts.withColumn("vec", token_embedding()(embed_tokens(F.col("title"))))


def md5_embedder(texts: DataFrame) -> DataFrame:
    """As :func:`default_embedder` with buckets that SQL can compute as well."""
    return texts.withColumn("vec", hash_embedding_md5(F.col("title")))


def text_key(report_id: Column, title: Column, description: Column) -> Column:
    """Key of a report's text.  A headline without topical words only equals itself."""
    plain = F.concat_ws("\u0001", title, F.coalesce(description, F.lit("")))
    alone = F.size(embed_tokens(title)) == 0
    return F.md5(F.when(alone, F.concat_ws("\u0001", plain, report_id.cast("string"))).otherwise(plain))


def arrival_wave(hours: float) -> Column:
    """Wave number of a report by the time it was retrieved."""
    return F.floor(F.unix_micros(F.col("retrieved_at").cast("timestamp")) / (hours * 3.6e9)).cast("bigint")


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def _day(micros: Column) -> Column:
    return F.floor(micros / 86_400_000_000).cast("bigint")


def _texts(keyed: DataFrame, embedder) -> DataFrame:
    """One row per distinct text with its signals and its signature."""
    texts = keyed.groupBy("text_id").agg(F.first(F.struct("title", "description")).alias("t")).select("text_id", "t.*")
    facts = report_facts(F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")))

    def of_kind(kind: str, field: str) -> Column:
        return F.transform(F.filter("facts", lambda f: f["fact_type"] == kind), lambda f: F.lower(f[field]))

    whole = F.transform("vec", lambda e: F.struct(
        e["bucket"].cast("int").alias("bucket"), F.round(e["w"] * SCALE).cast("bigint").alias("w")))
    signals = embedder(texts.withColumn("facts", facts)).select(
        "text_id", F.array_sort(F.filter(whole, lambda e: e["w"] != 0)).alias("vec"),
        F.array_sort(F.array_distinct(of_kind("entity", "value_text"))).alias("entities"),
        F.array_sort(F.array_distinct(of_kind("number", "fact_key"))).alias("numbers"),
        F.try_element_at(of_kind("event_type", "value_text"), F.lit(1)).alias("event_type"))
    alone = F.when(F.size("vec") == 0, F.col("text_id"))
    return signals.withColumn("sig", F.md5(F.concat_ws(
        "\u0001", F.to_json("vec"), F.array_join("entities", "\u0002"), F.array_join("numbers", "\u0002"),
        F.coalesce("event_type", F.lit("-")), alone)))


def empty_events(spark: SparkSession, reports: DataFrame) -> DataFrame:
    """An event table with no rows, typed after the reports."""
    kinds = dict(reports.dtypes)
    rid, ts, occurred = kinds["report_id"], kinds["retrieved_at"], kinds["published_at"]
    return spark.createDataFrame([], f"""event_id {rid}, started struct<retrieved_at:{ts},report_id:{rid},occurred_at:{occurred}>,
        title string, event_type string, entities array<string>, numbers array<string>,
        total {_WHOLE}, report_count bigint, first_detected_at {occurred}, last_activity {occurred}""")


def latest_events(versions: DataFrame) -> DataFrame:
    """The newest version of each event."""
    return versions.groupBy("event_id").agg(F.max_by(F.struct(*versions.columns), "version").alias("e")).select("e.*")


def _within_reach(versions: DataFrame, low: int, high: int) -> DataFrame:
    """Events that a report between two times (microseconds) may join.

    Activity only moves forward, so a version below the lower limit may have a
    newer one above it but not the other way round.
    """
    last = F.unix_micros(F.col("last_activity").cast("timestamp"))
    return latest_events(versions.filter(last >= low - WINDOW_US)).filter(last <= high + WINDOW_US)


def _neighbourhoods(sigs: DataFrame, live: DataFrame) -> DataFrame:
    """(node, component) of signatures ("s" and the signature) and events ("e" and the event)."""

    def nodes(df: DataFrame, letter: str, key: str, vec: str) -> DataFrame:
        real = F.transform(vec, lambda e: F.struct(e["bucket"].alias("bucket"), e["w"].cast("double").alias("w")))
        return df.filter(F.size(vec) > 0).select(
            F.concat(F.lit(letter), F.col(key).cast("string")).alias("node"), sparse_unit(real).alias("vec"))

    mine, theirs = nodes(sigs, "s", "sig", "vec"), nodes(live, "e", "event_id", "total")
    every = mine.unionByName(theirs)
    ready = written(prefix_of(every, bucket_ranks(every), NEAR, "node"), "prefixes")
    each_once = F.col("node_r").startswith("e") | (F.col("node") < F.col("node_r"))
    pairs = prefix_join(ready.filter(F.col("node").startswith("s")), ready, NEAR, condition=each_once)
    return connected(pairs.select(F.col("node").alias("a"), F.col("node_r").alias("b"))).select(
        F.col("id").alias("node"), "component")


def _units(rows: DataFrame, live: DataFrame, sigs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` and ``live`` with ``unit``: component and stretch of time without a silence beyond the window."""
    component = written(_neighbourhoods(sigs, live), "components")

    def placed(df: DataFrame, node: Column) -> DataFrame:
        return df.withColumn("node", node).join(component, "node", "left").withColumn(
            "component", F.coalesce("component", "node")).drop("node")

    of_sig = placed(rows.groupBy("sig", "day").agg(F.min("occurred").alias("lo"), F.max("occurred").alias("hi")),
                    F.concat(F.lit("s"), F.col("sig")))
    last = F.unix_micros(F.col("last_activity").cast("timestamp"))
    events = placed(live.withColumn("day", _day(last)).withColumn("last", last), F.concat(F.lit("e"), F.col("event_id").cast("string")))
    of_sig = written(of_sig, "sigdays")
    days = of_sig.select("component", "day", "lo", "hi").union(events.select("component", "day", "last", "last")).groupBy(
        "component", "day").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    along = Window.partitionBy("component").orderBy("day")  # a row per day
    silent = F.col("lo") - F.max("hi").over(along.rowsBetween(Window.unboundedPreceding, -1)) > WINDOW_US
    pieces = days.withColumn("silent", F.coalesce(silent, F.lit(False)).cast("int")).select(
        "component", "day", F.concat_ws("/", "component", F.sum("silent").over(along).cast("string")).alias("unit"))
    named = of_sig.join(pieces, ["component", "day"]).select("sig", "day", "unit")
    return (salted_lookup(rows, named, ["sig", "day"], ["report_id"], how="inner").drop("day"),
            events.join(pieces, ["component", "day"]).drop("component", "day"))


def _cut(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows in order of unit and arrival, in stretches, with the ``task`` that replays them; and the tasks.

    Units within one stretch are replayed with it; a unit that spans several
    has a task for each, numbered by ``place``.  Reports of one signature and
    day are replayed in runs, so it is signature days that bound a stretch:
    what repeats makes stretches longer (up to ``LONGEST``), not more.
    """
    count, days = rows.agg(F.count(F.lit(1)), F.approx_count_distinct(F.xxhash64("sig", _day(F.col("occurred"))))).first()
    parts = max(1, math.ceil(days / STRETCH), math.ceil(count / max(STRETCH, LONGEST)))
    order = ["unit", "retrieved", "report_id"]
    dealt = written(rows.repartitionByRange(parts, *order).withColumn("stretch", F.spark_partition_id()), "stretches")
    spans = dealt.groupBy("unit", "stretch").agg(F.min("occurred").alias("lo"))
    of_unit = Window.partitionBy("unit")
    numbered = spans.withColumn("place", F.row_number().over(of_unit.orderBy("stretch"))).withColumn(
        "of", F.count(F.lit(1)).over(of_unit))
    task = F.when(F.col("of") == 1, F.concat(F.lit("#"), F.col("stretch").cast("string"))).otherwise(
        F.concat_ws("@", "unit", F.col("stretch").cast("string")))
    tasks = written(numbered.withColumn("task", task), "tasks")
    return written(dealt.join(tasks, ["unit", "stretch"]), "rows"), tasks


_CONTEXT = ["task", "unit", "sig", "event_id", "started_at", "vec", "entities", "numbers", "event_type", "last", "n"]


def _replay(rows: DataFrame, context: DataFrame) -> DataFrame:
    kinds = dict(rows.dtypes)
    schema = (f"task string, unit string, report_id {kinds['report_id']}, event_id {kinds['report_id']}, score double, is_new boolean, "
              f"started_at bigint, vec {_WHOLE}, entities array<string>, numbers array<string>, event_type string, last bigint, n bigint")
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    mine = rows.select("task", "unit", "report_id", "retrieved", "occurred", "sig")
    return mine.groupBy("task").cogroup(context.select(*_CONTEXT).groupBy("task")).applyInArrow(
        _some(replayer(WINDOW_US, arrow), arrow), schema)


def _some(run, schema: pa.Schema):
    def checked(left: pa.Table, right: pa.Table) -> pa.Table:
        return run(left, right) if left.num_rows else schema.empty_table()

    return checked


def _settled(rows: DataFrame, tasks: DataFrame, live: DataFrame, sigs: DataFrame) -> DataFrame:
    """What the replay of all stretches comes to: rows of reports and of additions to events."""
    spark, rid = rows.sparkSession, dict(rows.dtypes)["report_id"]
    none = {"event_id": F.lit(None).cast(rid), "started_at": F.lit(None).cast("bigint"), "last": F.lit(None).cast("bigint"),
            "n": F.lit(None).cast("bigint")}
    texts = rows.select("task", "sig").distinct().join(sigs, "sig").withColumns({"unit": F.lit(None).cast("string"), **none})
    known = live.select(
        "unit", F.lit(None).cast("string").alias("sig"), "event_id", F.unix_micros(F.col("started.retrieved_at").cast("timestamp")).alias("started_at"),
        F.col("total").alias("vec"), "entities", "numbers", "event_type", "last", F.col("report_count").alias("n"))
    path = working_table(spark, "replays")

    def run(which: DataFrame, events: DataFrame, number: int) -> None:
        """Replay the tasks of ``which`` against events as given, as run ``number``."""
        wanted = rows.join(which.select("task").distinct(), "task", "left_semi")
        context = texts.join(which.select("task").distinct(), "task", "left_semi").select(*_CONTEXT).unionByName(events.select(*_CONTEXT))
        _replay(wanted, written(context, "context")).withColumn("run", F.lit(number)).write.mode("append").parquet(path)

    first = tasks.filter("place = 1")
    run(first, first.select("task", "unit").join(known, "unit"), 1)
    results = spark.read.parquet(path)
    later = tasks.filter("place > 1")
    if later.isEmpty():
        return results
    starts = spark.createDataFrame([], "task string, mark bigint, run int")
    number = 1
    while True:
        latest = _latest_runs(spark.read.parquet(path))
        added = latest.filter("report_id is null").drop("run", "report_id", "score", "is_new").join(
            tasks.filter("of > 1").select("task", "place"), "task").drop("task").withColumn("sig", F.lit(None).cast("string"))
        parts = known.join(later.select("unit").distinct(), "unit", "left_semi").withColumn("place", F.lit(0)).unionByName(added)
        # an event counts with all its parts if its last activity is within reach of the stretch
        alive = parts.groupBy("unit", "event_id").agg(F.max("last").alias("until"))
        events = later.select("task", "unit", F.col("place").alias("mine"), "lo").join(
            parts.join(alive, ["unit", "event_id"]), "unit").filter(
            (F.col("place") < F.col("mine")) & (F.col("until") >= F.col("lo") - WINDOW_US))
        events = written(events.select(*_CONTEXT), "starts")
        marks = events.groupBy("task").agg(F.bit_xor(F.xxhash64("event_id", "vec", "last", "n")).alias("mark"))
        now = later.select("task").join(marks, "task", "left").fillna(0, ["mark"])
        ran = starts.groupBy("task").agg(F.max_by("mark", "run").alias("before"))
        changed = written(now.join(ran, "task", "left").filter(~F.col("mark").eqNullSafe(F.col("before"))).select("task", "mark"), "changed")
        if changed.isEmpty():
            return latest
        number += 1
        run(changed, events.join(changed.select("task"), "task", "left_semi"), number)
        starts = starts.unionByName(changed.withColumn("run", F.lit(number)))


def _latest_runs(results: DataFrame) -> DataFrame:
    newest = results.groupBy("task").agg(F.max("run").alias("run"))
    return results.join(newest, ["task", "run"])


def cluster_batch(reports: DataFrame, versions: DataFrame | None = None, embedder=default_embedder) -> tuple[DataFrame, DataFrame]:
    """Cluster one batch of reports -> (touched events, edges), both written tables.

    ``versions`` are the events of earlier batches: EVENT_COLUMNS and
    ``version``, of which the highest counts.  They are not changed; the
    touched events are to be kept as a newer version.
    """
    spark = reports.sparkSession
    ship_package(spark)
    keyed = reports.withColumn("occurred_at", F.coalesce("published_at", "retrieved_at")).withColumn(
        "text_id", text_key(F.col("report_id"), F.col("title"), F.col("description")))
    texts = written(_texts(keyed, embedder), "texts")
    sigs = written(texts.drop("text_id").dropDuplicates(["sig"]), "signatures")
    narrow = keyed.select("report_id", _micros("retrieved_at").alias("retrieved"), _micros("occurred_at").alias("occurred"), "text_id")
    rows = written(salted_lookup(narrow, texts.select("text_id", "sig"), ["text_id"], ["report_id"], how="inner").drop(
        "text_id").withColumn("day", _day(F.col("occurred"))), "reports")
    low, high = rows.agg(F.min("occurred"), F.max("occurred")).first()
    live = empty_events(spark, reports)
    if versions is not None and low is not None:
        live = written(_within_reach(versions, low, high).select(*EVENT_COLUMNS), "reach")
    rows, live = _units(rows, live, sigs)
    live = written(live, "live")
    settled = _settled(*_cut(rows), live, sigs)
    edges = written(settled.filter("report_id is not null").select(
        "event_id", "report_id", F.round("score", 4).alias("similarity_score"), F.col("is_new").alias("is_primary")), "edges")

    added = settled.filter("report_id is null")
    growth = added.groupBy("event_id").agg(
        F.sum("n").alias("added"), F.max("last").alias("until"), F.first("entities").alias("its_entities"),
        F.first("numbers").alias("its_numbers"), F.first("event_type").alias("its_type"))
    weights = added.select("event_id", F.explode("vec").alias("e")).unionByName(
        live.join(growth, "event_id", "left_semi").select("event_id", F.explode("total").alias("e")))
    totals = weights.groupBy("event_id", F.col("e.bucket").alias("bucket")).agg(F.sum("e.w").alias("w")).groupBy("event_id").agg(
        F.array_sort(F.collect_list(F.struct("bucket", "w"))).alias("new_total"))
    founders = keyed.join(edges.filter("is_primary").select("report_id"), "report_id", "left_semi").select(
        F.col("report_id").alias("event_id"), F.struct("retrieved_at", "report_id", "occurred_at").alias("its_start"),
        F.substring("title", 1, 500).alias("its_title"), F.col("occurred_at").alias("its_first"))
    joined = growth.join(totals, "event_id", "left").join(founders, "event_id", "left").join(live.drop("unit", "last"), "event_id", "left")
    is_known = F.col("report_count").isNotNull()
    kind = dict(empty_events(spark, reports).dtypes)["last_activity"]
    until = F.timestamp_micros("until")
    touched = joined.select(
        "event_id", F.coalesce("started", "its_start").alias("started"), F.coalesce("title", "its_title").alias("title"),
        F.when(is_known, F.col("event_type")).otherwise(F.col("its_type")).alias("event_type"),
        F.coalesce("entities", "its_entities").alias("entities"), F.coalesce("numbers", "its_numbers").alias("numbers"),
        F.coalesce("new_total", F.array().cast(_WHOLE)).alias("total"),
        (F.coalesce("report_count", F.lit(0)) + F.col("added")).alias("report_count"),
        F.coalesce("first_detected_at", "its_first").alias("first_detected_at"),
        F.greatest(until.cast(kind), "last_activity").alias("last_activity"))
    return written(touched, "touched"), edges


def cluster_events(reports: DataFrame, wave: Column | None = None, events: DataFrame | None = None,
                   embedder=default_embedder) -> tuple[DataFrame, DataFrame]:
    """Cluster reports into events -> (events, edges).

    ``reports``: report_id, title, description, published_at, retrieved_at.
    ``wave`` numbers batches that are to be taken one after another, in order of
    arrival; the result is the same without (all at once).  ``events`` are those
    known already.  ``events`` comes back with summed whole vectors (``total``);
    ``edges`` is event_id, report_id, similarity_score, is_primary.
    """
    spark = reports.sparkSession
    versions = None if events is None else events.select(*EVENT_COLUMNS).withColumn("version", F.lit(-1))
    if wave is None:
        touched, edges = cluster_batch(reports, versions, embedder)
        touched = touched.withColumn("version", F.lit(0))
        return latest_events(touched if versions is None else versions.unionByName(touched)).drop("version"), edges
    waves = working_table(spark, "waves")
    reports.withColumn("wave", wave).write.partitionBy("wave").parquet(waves)
    dealt, log, out = spark.read.parquet(waves), working_table(spark, "events"), working_table(spark, "edges")
    for number, (key,) in enumerate(dealt.select("wave").distinct().orderBy("wave").toLocalIterator()):
        touched, edges = cluster_batch(dealt.filter(F.col("wave").eqNullSafe(F.lit(key))).drop("wave"), versions, embedder)
        touched.withColumn("version", F.lit(number)).write.mode("append").parquet(log)
        edges.write.mode("append").parquet(out)
        written = spark.read.schema(touched.withColumn("version", F.lit(number)).schema).parquet(log)
        versions = written if events is None else events.select(*EVENT_COLUMNS).withColumn("version", F.lit(-1)).unionByName(written)
    if versions is None:
        return empty_events(spark, reports), cluster_batch(reports, None, embedder)[1]
    return latest_events(versions).drop("version"), spark.read.parquet(out)


def backfill(reports: DataFrame, sources: DataFrame, as_of: Column, wave: Column | None = None,
             events: DataFrame | None = None, embedder=default_embedder) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cluster the NEW reports in order of retrieval, then verify the touched events.

    -> (verified, events, edges).  Headline vectors come along, so copies of a
    headline count as one chain.
    """
    from corrob.operators.verify import event_members, verify_events

    fresh = reports.filter(F.col("status") == "NEW") if "status" in reports.columns else reports
    clustered, edges = cluster_events(fresh, wave, events, embedder)
    members = embedder(event_members(edges.select("event_id", "report_id"), fresh, sources))
    return verify_events(members, as_of), clustered, edges
