"""URL filters: a rule list, then templates of each host's paths judged by labelled purity.

A host's paths form a tree of segments.  Segments that vary are wildcards:
numbers and identifiers by their form, and at a node with many children of few
pages each all of them.  A node knows how many labelled pages below it are bad
and how many are good.  Siblings whose labels do not differ significantly are
one branch with summed counts (a branch without labels joins none).  The
purity of a branch is its share of bad pages, smoothed towards its parent's,
up to the share of all labelled pages; a page is blocked if the deepest branch
of it that has LEAST_LABELLED labels has a purity of PURITY or more.  Hosts or
branches without labels of their own are never blocked.

Everything is built-in expressions; counts are partial aggregates per (host,
template), and the pages meet them in a join of two written tables, whose
skewed partitions Spark splits, so one host may hold a third of the pages.

Defined cases: a null url, or one without ``://``, has an empty host and path,
fits no rule and is judged as host ""; repeated rows count each; an empty
table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corrob.llm.common import stored

#: Fixed values: (verdict, host, path) of the rule list.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
DEPTH = 4  # levels of a template; what is deeper is one wildcard
CHILDREN, PAGES_PER_CHILD = 8, 3.0  # a node with more children than this and fewer pages each is a wildcard
SMOOTHING, LEAST_LABELLED, PURITY = 4.0, 5, 0.9
SIMILAR = 1.96  # standard errors within which siblings are alike

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits; null without one.

    A rule's host fits itself and its subdomains, its path all paths that
    start with it.  The list is compiled into one expression.
    """
    out: Column = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, domain, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(domain + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _form(segment: Column) -> Column:
    """A segment with its varying parts as wildcards, as far as its form tells."""
    named = F.regexp_replace(segment, r"(?i)^[0-9a-f]{8}-[0-9a-f-]{20,}(?=\.|$)|^(?=[^.]*[0-9])[0-9a-zA-Z_-]{16,}(?=\.|$)", "{id}")
    return F.regexp_replace(named, r"[0-9]+", "{n}")


def templates(pages: DataFrame) -> DataFrame:
    """``pages`` (host, path, ...) with ``t1`` to ``tDEPTH``: the path's template, level by level (null below its end)."""
    segments = F.transform(F.filter(F.split("path", "/", -1), lambda s: s != ""), _form)
    out = pages.withColumn("segments", segments)
    prefix: list[str] = ["host"]
    for level in range(1, DEPTH + 1):
        segment = F.get("segments", F.lit(level - 1)) if level < DEPTH else F.when(
            F.size("segments") == DEPTH, F.get("segments", F.lit(DEPTH - 1))).when(F.size("segments") > DEPTH, F.lit("**"))
        out = stored(out.withColumn("segment", segment), "segments")
        children = out.filter("segment is not null").groupBy(*prefix, "segment").agg(F.count(F.lit(1)).alias("pages"))
        wide = children.groupBy(*prefix).agg(F.count(F.lit(1)).alias("children"), F.sum("pages").alias("pages")).filter(
            (F.col("children") > CHILDREN) & (F.col("pages") < PAGES_PER_CHILD * F.col("children"))).select(
            *[F.col(p).alias(f"w_{p}") for p in prefix])
        met = out.join(stored(wide, "wide"), [F.col(p) == F.col(f"w_{p}") for p in prefix], "left")
        out = met.withColumn(f"t{level}", F.when(F.col("segment").isNotNull() & F.col("w_host").isNotNull(), F.lit("*")).otherwise(
            F.col("segment"))).drop("segment", *[f"w_{p}" for p in prefix])
        prefix.append(f"t{level}")
    return out.drop("segments")


def _nodes(level: int) -> Column:
    """The template of a page down to a level, as one string; null if the path ends before."""
    parts = [F.col(f"t{i}") for i in range(1, level + 1)]
    whole = F.concat(F.lit("/"), F.concat_ws("/", *parts))
    return F.when(parts[-1].isNotNull(), whole) if parts else F.lit("/")


def purity(labelled: DataFrame) -> DataFrame:
    """(host, template, purity, labels) of every labelled branch; ``labelled`` has templates and ``bad`` (0 or 1)."""
    nodes = F.array(*[F.struct(F.lit(level).alias("level"), _nodes(level).alias("template"), (
        _nodes(level - 1) if level else F.lit(None).cast("string")).alias("parent")) for level in range(DEPTH + 1)])
    counts = stored(labelled.select("host", "bad", F.inline(nodes)).filter("template is not null").groupBy(
        "host", "level", "template", "parent").agg(F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("labels")), "nodes")
    # siblings in the order of their share; a significant step up begins a new branch
    siblings = Window.partitionBy("host", "level", "parent").orderBy(F.col("bad") / F.col("labels"), "template")
    before, n0 = F.lag("bad").over(siblings), F.lag("labels").over(siblings)
    pooled = (F.col("bad") + before) / (F.col("labels") + n0)
    error = F.sqrt(pooled * (1 - pooled) * (1 / F.col("labels") + 1 / n0))
    apart = F.coalesce((F.col("bad") / F.col("labels") - before / n0) > SIMILAR * error + 1e-9, F.lit(False))
    # steps are marked first, then summed to the branch's number
    marked = counts.withColumn("apart", apart.cast("int")).withColumn("branch", F.sum("apart").over(siblings))
    sums = marked.groupBy("host", "level", "parent", "branch").agg(F.sum("bad").alias("bad"), F.sum("labels").alias("labels"))
    merged = stored(marked.drop("bad", "labels", "apart").join(
        sums.select(F.col("host").alias("h"), F.col("level").alias("l"), F.col("parent").alias("p"), F.col("branch").alias("b"), "bad", "labels"),
        (F.col("host") == F.col("h")) & (F.col("level") == F.col("l")) & F.col("parent").eqNullSafe(F.col("p")) & (
            F.col("branch") == F.col("b"))).drop("h", "l", "p", "b", "branch"), "branches")
    overall = counts.filter("level = 0").agg((F.sum("bad") / F.sum("labels")).alias("overall"))
    level0 = merged.filter("level = 0").crossJoin(overall)  # one row on the right
    done = level0.withColumn("purity", (F.col("bad") + SMOOTHING * F.col("overall")) / (F.col("labels") + SMOOTHING)).drop("overall")
    out = done
    for level in range(1, DEPTH + 1):
        above = done.select(F.col("host").alias("h"), F.col("template").alias("t"), F.col("purity").alias("above"))
        done = merged.filter(F.col("level") == level).join(above, (F.col("host") == F.col("h")) & (F.col("parent") == F.col("t"))).withColumn(
            "purity", (F.col("bad") + SMOOTHING * F.col("above")) / (F.col("labels") + SMOOTHING)).drop("h", "t", "above")
        out = out.unionByName(done)
    return out.select("host", "level", "template", "purity", "labels")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, purity) of every row of ``pages`` (page_id, url).

    Pages that a rule decides are the labelled ones.
    """
    host, path = host_and_path(pages["url"])
    narrow = pages.select(pages["page_id"], host.alias("host"), path.alias("path"))
    ruled = narrow.withColumn("ruled", rule_for(F.col("host"), F.col("path"), rules))
    placed = stored(templates(ruled), "templates")
    known = placed.filter("ruled is not null").withColumn("bad", (F.col("ruled.verdict") == "block").cast("int"))
    judged = stored(purity(known).filter(F.col("labels") >= LEAST_LABELLED), "purity")
    out = placed
    for level in range(DEPTH, -1, -1):
        here = judged.filter(F.col("level") == level).select(
            F.col("host").alias("h"), F.col("template").alias("t"), F.col("purity").alias(f"purity{level}"))
        out = out.join(here, (F.col("host") == F.col("h")) & (_nodes(level) == F.col("t")), "left").drop("h", "t")
    deepest = F.coalesce(*[F.col(f"purity{level}") for level in range(DEPTH, -1, -1)])
    # only a page's own branch counts: labels of other branches of the host do not condemn it
    own = F.coalesce(*[F.when(_nodes(level).isNotNull(), F.col(f"purity{level}")) for level in range(DEPTH, 0, -1)])
    verdict = F.when(F.coalesce(own, F.lit(0.0)) >= PURITY, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", F.col("ruled.rule").alias("rule"),
                      F.coalesce("ruled.verdict", verdict).alias("verdict"), deepest.alias("purity"))
