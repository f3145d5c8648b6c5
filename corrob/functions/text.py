"""Text and URL column functions.  All are built-in expressions unless noted."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from corrob import fixed_values as V


def strip(c: Column) -> Column:
    """Trim every kind of leading and trailing white space."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def strip_html(c: Column) -> Column:
    """Tags and ``&nbsp;`` become spaces, ends are trimmed, NULL becomes ''."""
    no_tags = F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^>]+>", " ")
    return strip(F.replace(no_tags, F.lit("&nbsp;"), F.lit(" ")))


# --- URLs --------------------------------------------------------------------


def _unquote(c: Column) -> Column:
    """Decode ``%xx`` and ``+``; text with a broken escape keeps its percent signs."""
    return F.coalesce(F.try_url_decode(c), F.replace(c, F.lit("+"), F.lit(" ")))


def _quote(c: Column) -> Column:
    """Percent-encode with ``_ . - ~`` kept and ``*`` encoded."""
    encoded = F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~"))
    return F.replace(encoded, F.lit("*"), F.lit("%2A"))


def _canonical_query(query: Column) -> Column:
    """Tracking parameters and blank values dropped, the rest sorted and quoted anew.

    With at most one plain parameter left there is nothing to sort or quote,
    which settles most addresses with two regular expressions.
    """
    tracking = "(?i)&(" + "|".join(V.TRACKING_PARAMS) + ")=[^&]*"
    left = F.regexp_replace(F.regexp_replace(F.concat(F.lit("&"), query), tracking, ""), "^&", "")
    return F.when(left.rlike("^([A-Za-z0-9_.-]*=[A-Za-z0-9_.-]+)?$"), left).otherwise(_sorted_query(query))


def _sorted_query(query: Column) -> Column:
    parts = F.filter(F.split(query, "&"), lambda p: p.rlike("^[^=]*=."))
    pairs = F.transform(
        parts,
        lambda p: F.struct(
            _unquote(F.substring_index(p, "=", 1)).alias("k"),
            _unquote(F.regexp_replace(p, "^[^=]*=", "")).alias("v"),
        ),
    )
    kept = F.filter(pairs, lambda kv: ~F.lower(kv["k"]).isin(V.TRACKING_PARAMS))
    return F.array_join(
        F.transform(
            F.array_sort(kept), lambda kv: F.concat(_quote(kv["k"]), F.lit("="), _quote(kv["v"]))
        ),
        "&",
    )


_URL_PARTS = r"^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def canonicalize_url(c: Column) -> Column:
    """One stable spelling per page address, for URL deduplication."""
    url = strip(c)
    scheme, authority, path, query = [F.regexp_extract(url, _URL_PARTS, g) for g in (1, 2, 3, 4)]
    scheme = F.regexp_replace(F.lower(scheme), "^(http)?$", "https")
    authority = F.regexp_replace(F.lower(authority), "^.*@", "")
    # NULL rather than '' where there is no port: a failing cast is costly per row
    port = F.nullif(F.regexp_extract(authority, r":(\d+)$", 1), F.lit("")).try_cast("int")
    host = F.regexp_replace(authority, r":\d*$", "")
    shown_port = F.when((port != 0) & ~((port == 443) & (scheme == "https")), F.concat(F.lit(":"), port.cast("string")))
    rooted = F.regexp_replace(path, "^(?=[^/])", "/")
    address = F.when(path.isin("", "/"), "/").otherwise(F.rtrim(rooted, F.lit("/")))
    hierarchical = (authority != "") | (scheme == "https")
    body = F.when(hierarchical, F.concat(F.lit("//"), host, F.coalesce(shown_port, F.lit("")), address)).otherwise(path)
    tail = F.when(query == "", "").otherwise(
        F.regexp_replace(F.concat(F.lit("?"), _canonical_query(query)), r"^\?$", ""))
    return F.concat(scheme, F.lit(":"), body, tail)


def url_hash(c: Column) -> Column:
    return F.sha2(canonicalize_url(c), 256)


# --- normalised text and hashes ----------------------------------------------


def normalize_text(c: Column) -> Column:
    """Lower case, sharp s folded, every run of non-word characters one space."""
    folded = F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("ß"), F.lit("ss"))
    return F.trim(F.regexp_replace(folded, r"[^\p{L}\p{N}_]+", " "))


@pandas_udf(StringType())
def nfkc_casefold(text: pd.Series) -> pd.Series:
    """Full compatibility folding, for scripts ``lower`` cannot fold."""
    return text.fillna("").map(lambda t: unicodedata.normalize("NFKC", t).casefold())


def normalize_text_nfkc(c: Column) -> Column:
    """As :func:`normalize_text`, with NFKC and full case folding first."""
    return F.trim(F.regexp_replace(nfkc_casefold(c), r"[^\p{L}\p{N}_]+", " "))


def content_hash(title: Column, body: Column) -> Column:
    return F.sha2(F.concat(normalize_text(title), F.lit("\n"), normalize_text(body)), 256)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 16-digit hex hashes, in two signed-safe halves."""

    def half(c: Column, start: int) -> Column:
        return F.conv(F.substring(c, start, 8), 16, 10).cast("bigint")

    bits = [F.bit_count(half(a, s).bitwiseXOR(half(b, s))) for s in (1, 9)]
    return bits[0] + bits[1]


def slugify(c: Column) -> Column:
    dashed = F.replace(normalize_text(c), F.lit(" "), F.lit("-"))
    kept = F.trim(F.replace(dashed, F.lit("_"), F.lit("")), F.lit("-"))
    cut = F.substring(kept, 1, V.SLUG_LENGTH)
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit("article"))


def pseudonym(c: Column) -> Column:
    return F.left(F.sha2(c, 256), F.lit(12))


def json_list(c: Column, element: str = "string") -> Column:
    """Decode a JSON list; text that is no JSON list becomes NULL."""
    return F.when(strip(c).rlike(r"^\["), F.from_json(c, f"array<{element}>"))


# --- token sets --------------------------------------------------------------


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two distinct arrays; 0 when either is empty."""
    either_empty = (F.size(a) == 0) | (F.size(b) == 0)
    share = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    return F.when(either_empty, F.lit(0.0)).otherwise(share)


def word_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normalize_text(c), " "), lambda t: t != ""))


def copy_tokens(c: Column) -> Column:
    """ASCII words and numbers, the unit of the copying check."""
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1))


def ngrams(tokens: Column, n: int) -> Column:
    """Distinct ``n``-token runs of an array, joined by spaces; none if shorter."""

    def runs(words: Column) -> Column:
        count = F.size(words) - n + 1
        starts = F.when(count >= 1, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " ")))

    # a one-element array, so that the tokens are cut once and not once per run
    return F.element_at(F.transform(F.array(tokens), runs), 1)


def number_tokens(c: Column) -> Column:
    """Distinct numeric values in a text; a comma inside a number is deleted."""
    raw = F.regexp_extract_all(c, F.lit(r"(\d+(?:[.,]\d+)?)"), F.lit(1))
    return F.array_distinct(F.transform(raw, lambda t: F.replace(t, F.lit(","), F.lit("")).cast("double")))


def evidence_number_tokens(c: Column) -> Column:
    """As :func:`number_tokens`, but a comma ends a number."""
    raw = F.regexp_extract_all(c, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1))
    return F.array_distinct(F.transform(raw, lambda t: t.cast("double")))


def proper_nouns(c: Column) -> Column:
    """Lower-cased capitalised words that do not open a sentence.

    White space before a word is dropped first, so the look-behind only has to
    test the one character that is left.
    """
    tight = F.regexp_replace(strip(c), r"\s+(?=[A-Z])", "\u0001")
    opener = r"(?<![.!?:;\"()\-])"
    pattern = rf"(?U)(?<=.){opener}\u0001([A-Z][a-z]{{{V.MIN_NAME_LENGTH - 1},}})\b"
    glued = rf"(?U)(?<=[^\w.!?:;\"()\-\u0001\s])([A-Z][a-z]{{{V.MIN_NAME_LENGTH - 1},}})\b"
    found = F.concat(
        F.regexp_extract_all(tight, F.lit(pattern), F.lit(1)),
        F.regexp_extract_all(tight, F.lit(glued), F.lit(1)),
    )
    return F.array_distinct(F.transform(found, F.lower))


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def display_number(c: Column) -> Column:
    """A whole number prints without decimals."""
    whole = c % 1 == 0
    # doubles of 1e15 and more in two exact halves, so all digits of the stored value are printed
    rest = c % 1e15
    large = F.concat(((c - rest) / 1e15).cast("bigint").cast("string"), F.lpad(rest.cast("bigint").cast("string"), 15, "0"))
    plain = F.regexp_replace(c.cast("decimal(38,12)").cast("string"), r"0+$", "")
    return F.when(whole & (F.abs(c) < 1e15), c.cast("bigint").cast("string")).when(whole, large).otherwise(plain)
