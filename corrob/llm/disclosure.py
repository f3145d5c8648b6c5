"""Personal data: fixed patterns, and terms that give a protected entity away.

Base spans are the matches of four patterns.  Their values are the protected
entities.  Words of the same text may reveal an entity as well, so corpus counts
tell how much: with co(t, e) the texts that hold term t and entity e and df(t)
those that hold t at all, seeing t leaves -log2(co / df) bits of uncertainty
about e (the entity's information content less the pointwise mutual
information).  A term that keeps it at DISCLOSED bits or less for some entity,
in at least SUPPORT different texts, is a span of kind ``term`` wherever it
stands in any text; ``sanitised`` removes it, or generalises it above REMOVED
bits.

Everything is built-in expressions.  Positions come from splitting a text by a
pattern: the lengths of the parts and of the matches add up.  Patterns start
only where a match can start (after \\G or a character outside) and repeat
possessively where nothing can be given back, so a text of one long token takes
linear time.  One pass finds spans and the words of texts with spans; pairs are made
only of entities in SUPPORT texts or more.  A second pass counts candidate terms
(those whose count in texts with spans alone does not rule them out), a third
finds the disclosing ones in all texts; both keep a word only if it passes a
filter of at most BUCKETS hash values, the one thing that is broadcast by hint.

Defined cases: a null text is empty; repeated rows (doc_id and text) get equal
results, and equal texts count once in the statistics; a null doc_id is kept;
an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrob.llm.common import let, stored, text_or_empty

#: Kinds in order, with their patterns and cheap conditions without which there is no valid match.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HINTS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}",
         "phone": r"\+[0-9]"}
LONGEST = 24
TERM = rf"\p{{L}}{{3,{LONGEST}}}+(?!\p{{L}})"  # of a longer word its end
SUPPORT, DISCLOSED, REMOVED = 3, 1.0, 0.15
BUCKETS = 65536


def spans_of(text: Column, pattern: str | Column) -> Column:
    """array<struct<start, end, match>> of all matches, leftmost and not overlapping; code points, end exclusive."""
    kind = "struct<at: int, out: array<struct<start: int, end: int, match: string>>>"

    def place(parts: Column, matches: Column) -> Column:
        def step(state: Column, pair: Column) -> Column:
            start = state["at"] + F.length(pair["part"])
            end = start + F.length(pair["match"])
            one = F.struct(start.alias("start"), end.alias("end"), pair["match"].alias("match"))
            return F.struct(end.alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

        pairs = F.zip_with(F.slice(parts, 1, F.size(matches)), matches, lambda p, m: F.struct(p.alias("part"), m.alias("match")))
        empty = F.from_json(F.lit('{"at": 0, "out": []}'), kind)
        return F.aggregate(pairs, empty, step, lambda s: s["out"])

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: let(F.split(text, pattern, -1), lambda p: place(p, m)))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def worth(i: Column) -> Column:
        digit = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, digit).when(digit > 4, 2 * digit - 9).otherwise(2 * digit)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), worth), F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: str) -> Callable[[Column], Column]:
    def check(span: Column) -> Column:
        match = span["match"]
        if kind == "ip":
            # at most 255: longer numbers than three digits only with leading zeros
            return F.forall(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike(
                "^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
        if kind == "card":
            return let(_digits(match), lambda d: F.length(d).between(12, 19) & _luhn(d))
        if kind == "phone":
            return F.length(_digits(match)).between(9, 15)
        return F.lit(True)

    return check


def base_spans(text: Column) -> Column:
    """array<struct<start, kind (its place), end, match>> of all kinds, by start, then kind."""
    none = F.array().cast("array<struct<start: int, place: int, end: int, match: string>>")

    def of(kind: str, place: int) -> Column:
        found = F.filter(spans_of(text, PATTERNS[kind]), _valid(kind))
        return F.when(text.rlike(HINTS[kind]), F.transform(found, lambda s: F.struct(
            s["start"].alias("start"), F.lit(place).alias("place"), s["end"].alias("end"), s["match"].alias("match")))).otherwise(none)

    return F.array_sort(F.concat(*[of(k, i) for i, k in enumerate(PATTERNS)]))


def _entity(span: Column) -> Column:
    """What is protected, spelled alike: digits of numbers, an address in lower case."""
    return F.concat_ws(":", span["place"].cast("string"), F.when(span["place"] == 0, F.lower(span["match"])).when(
        span["place"] == 1, span["match"]).otherwise(_digits(span["match"])))


def _spellings(text: Column) -> Column:
    """The different words of a text that may be terms, as they are spelled."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, spans, entities, words) of every row, written once; words only of texts with spans."""
    both = let(text_or_empty(docs), lambda t: let(base_spans(t), lambda s: F.struct(
        s.alias("spans"), F.array_distinct(F.transform(s, _entity)).alias("entities"),
        F.when(F.size(s) > 0, F.array_distinct(F.transform(_spellings(t), F.lower))).alias("words"))))
    return stored(docs.select(docs["doc_id"], F.xxhash64(text_or_empty(docs)).alias("digest"), both.alias("x")).select(
        "doc_id", "digest", "x.*"), "personal")


def _holding(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, digest, word, term, ...) of the words of all texts that are among ``terms`` (term, ...)."""
    bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS))
    buckets = terms.select(bucket.alias("bucket")).distinct()  # BUCKETS rows at most
    return docs.select(docs["doc_id"], F.xxhash64(text_or_empty(docs)).alias("digest"), F.explode(_spellings(text_or_empty(docs))).alias(
        "word")).withColumn("term", F.lower("word")).withColumn("bucket", bucket).join(F.broadcast(buckets), "bucket").drop(
        "bucket").join(terms, "term")


def disclosing(docs: DataFrame, scanned: DataFrame) -> DataFrame:
    """(entity, term, bits): terms that leave at most DISCLOSED bits of uncertainty about an entity."""
    texts = stored(scanned.filter(F.size("spans") > 0).groupBy("digest").agg(
        F.first("entities").alias("entities"), F.first("words").alias("words")), "entities")
    held = texts.select("digest", F.explode("entities").alias("entity"))
    often = held.groupBy("entity").agg(F.count(F.lit(1)).alias("texts")).filter(F.col("texts") >= SUPPORT).select("entity")
    pairs = held.join(often, "entity", "left_semi").groupBy("digest").agg(F.collect_list("entity").alias("often")).join(
        texts.select("digest", "words"), "digest").select("often", F.explode("words").alias("term")).select(
        F.explode("often").alias("entity"), "term")
    together = pairs.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("together")).filter(F.col("together") >= SUPPORT)

    def bits(texts: str) -> Column:
        return F.greatest(-F.log2(F.col("together") / F.col(texts)), F.lit(0.0))

    # the texts with spans are some of those that hold a term
    least = texts.select(F.explode("words").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("least"))
    together = stored(together.join(least, "term").filter(bits("least") <= DISCLOSED).drop("least"), "together")
    alone = _holding(docs, together.select("term").distinct()).select("digest", "term").distinct().groupBy("term").agg(
        F.count(F.lit(1)).alias("texts"))
    return together.join(alone, "term").select("entity", "term", bits("texts").alias("bits")).filter(F.col("bits") <= DISCLOSED)


def _places(text: Column, told: Column) -> Column:
    """array<struct<start, end, bits>> of the words of ``told`` (array<struct<word, bits>>) in a text."""
    whole, ends = (F.array_join(F.transform(F.filter(told, lambda t: keep(F.length(t["word"]))), lambda t: t["word"]), "|") for keep in (
        lambda n: n < LONGEST, lambda n: n >= LONGEST))
    pattern = F.concat(F.lit(r"(?:(?<!\p{L})(?:"), F.when(whole == "", "(?!)").otherwise(whole), F.lit(")|(?:"),
                       F.when(ends == "", "(?!)").otherwise(ends), F.lit(r"))(?!\p{L})"))
    bits = F.map_from_entries(told)
    return let(bits, lambda b: F.transform(spans_of(text, pattern), lambda m: F.struct(
        m["start"].alias("start"), m["end"].alias("end"), F.element_at(b, m["match"]).alias("bits"))))


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, spans, terms) of every row; ``terms`` is array<struct<start, end, bits>>."""
    scanned = scan(docs)
    telling = stored(disclosing(docs, scanned).groupBy("term").agg(F.min("bits").alias("bits")), "telling")
    told = _holding(docs, telling).groupBy("doc_id", "digest").agg(F.collect_set(F.struct("word", "bits")).alias("told")).select(
        F.col("doc_id").alias("its_id"), F.col("digest").alias("its_digest"), "told")
    rows = docs.select(docs["doc_id"], F.xxhash64(text_or_empty(docs)).alias("digest"), text_or_empty(docs).alias("text"))
    terms = rows.join(told, (F.col("digest") == F.col("its_digest")) & F.col("doc_id").eqNullSafe(F.col("its_id"))).groupBy(
        "doc_id", "digest").agg(F.first("text").alias("text"), F.first("told").alias("told"))
    found = terms.select(F.col("doc_id").alias("its_id"), F.col("digest").alias("its_digest"), _places(F.col("text"), F.col("told")).alias("terms"))
    joined = scanned.join(found, (F.col("digest") == F.col("its_digest")) & F.col("doc_id").eqNullSafe(F.col("its_id")), "left")
    # a word inside a base span is covered by it
    free = F.filter(F.coalesce("terms", F.array().cast("array<struct<start: int, end: int, bits: double>>")), lambda t: ~F.exists(
        "spans", lambda s: (t["start"] < s["end"]) & (s["start"] < t["end"])))
    return joined.select("doc_id", "digest", "spans", free.alias("terms"))


def listed(docs: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans and all spans as text."""
    names = F.array(*[F.lit(k) for k in [*PATTERNS, "term"]])

    def spelled(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", F.get(names, s["place"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    plain = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["place"].alias("place"), s["end"].alias("end")))
    terms = F.transform("terms", lambda t: F.struct(t["start"].alias("start"), F.lit(len(PATTERNS)).alias("place"), t["end"].alias("end")))

    def count(place: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["place"] == place)).cast("bigint")

    return personal_data(docs).select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(PATTERNS)],
        F.sha2(spelled(plain).cast("binary"), 256).alias("base_sha256"), spelled(F.array_sort(F.concat(plain, terms))).alias("spans"),
        F.size("terms").cast("bigint").alias("n_term"))


def sanitised(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with every span replaced by its kind; terms that reveal nearly all are removed."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in PATTERNS])
    edits = F.array_sort(F.concat(
        F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(names, s["place"]).alias("by"))),
        F.transform("terms", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.when(
            t["bits"] <= REMOVED, F.lit("")).otherwise(F.lit("[TERM]")).alias("by")))))
    found = personal_data(docs).filter((F.size("spans") > 0) | (F.size("terms") > 0)).select(
        F.col("doc_id").alias("its_id"), F.col("digest").alias("its_digest"), edits.alias("edits")).dropDuplicates(["its_id", "its_digest"])
    rows = docs.select(docs["doc_id"], docs["text"])
    met = rows.join(found, (F.xxhash64(text_or_empty(rows)) == F.col("its_digest")) & F.col("doc_id").eqNullSafe(F.col("its_id")), "left")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def edit(state: Column, e: Column) -> Column:
        # of overlapping spans the rest after the first is covered already
        begin = F.greatest(e["start"], state["at"])
        return F.when(e["end"] <= state["at"], state).otherwise(F.struct(e["end"].alias("at"), F.concat(
            state["out"], F.substring(F.col("text"), state["at"] + 1, begin - state["at"]), e["by"]).alias("out")))

    rebuilt = F.aggregate("edits", start, edit, lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.length("text"))))
    return met.select("doc_id", F.when(F.col("edits").isNull(), F.col("text")).otherwise(rebuilt).alias("text"))
