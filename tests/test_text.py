import hashlib
import unicodedata

import pytest
from pyspark.sql import functions as F

from corrob.functions import facts, text


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("url, expected", [
    ("https://example.com/story?id=123&utm_source=x#top", "https://example.com/story?id=123"),
    ("http://EXAMPLE.com/Path/", "https://example.com/Path"),
    ("https://e.com/s?b=2&a=1", "https://e.com/s?a=1&b=2"),
    ("  https://e.com  ", "https://e.com/"),
    ("http://h:80/", "https://h:80/"),
    ("https://h:443/a", "https://h/a"),
    ("http://user:pw@H:8080/a/b//?REF=1&q=a+b%2Fc&empty=&z=*~", "https://h:8080/a/b?q=a+b%2Fc&z=%2A~"),
    ("javascript:alert(1)", "javascript:alert(1)"),
    ("ftp://h/x", "ftp://h/x"),
    ("https://e.com/?q=%zz", "https://e.com/?q=%25zz"),
])
def test_canonical_url(spark, url, expected):
    assert one(spark, url, text.canonicalize_url) == expected


def test_url_hash_ignores_tracking(spark):
    a = one(spark, "https://e.com/s?id=1&utm_medium=y", text.url_hash)
    assert a == hashlib.sha256(b"https://e.com/s?id=1").hexdigest()


def test_normalize_matches_full_folding_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plain, full = text.normalize_text(F.col("text")), text.normalize_text_nfkc(F.col("text"))
    assert docs.filter(plain != full).count() == 0
    assert one(spark, "ﬁne Ⅻ", text.normalize_text_nfkc) == unicodedata.normalize("NFKC", "ﬁne Ⅻ").casefold()


def test_content_hash_ignores_case_and_punctuation(spark):
    rows = [("Earthquake strikes Japan!", "Twelve people were killed."),
            ("earthquake strikes japan", "twelve people were killed")]
    df = spark.createDataFrame(rows, "t string, b string")
    assert df.select(text.content_hash(F.col("t"), F.col("b"))).distinct().count() == 1


def test_strip_html_slug_and_sets(spark):
    assert one(spark, "<p>a&nbsp;b</p>&amp;", text.strip_html) == "a b &amp;"
    assert one(spark, None, text.strip_html) == ""
    assert one(spark, "Hello, World_1!", text.slugify) == "hello-world1"
    assert one(spark, "!!", text.slugify) == "article"
    assert one(spark, '["a","b"]', text.json_list) == ["a", "b"]
    assert one(spark, '{"a":1}', text.json_list) is None
    assert sorted(one(spark, "6,8 and 1,234,567 or 2.5", text.number_tokens)) == [2.5, 68.0, 567.0, 1234.0]
    assert one(spark, "x", lambda c: text.jaccard(F.array(c), F.array().cast("array<string>"))) == 0.0


def test_proper_nouns_skip_sentence_openers(spark):
    body = 'An event. Spokesperson Yuki Tanaka said "Kenji" and \'Naomi\' left.\n\nToday Japan woke (Osaka), Bob too.'
    assert sorted(one(spark, body, text.proper_nouns)) == ["japan", "naomi", "tanaka", "yuki"]
    assert one(spark, "Earthquake strikes\nAuthorities reported", text.proper_nouns) == ["authorities"]


def keys(spark, title, description=""):
    df = spark.createDataFrame([(title, description)], "title string, description string")
    return [r["fact_key"] for r in facts.explode_facts(df).orderBy("fact_pos").collect()]


@pytest.mark.parametrize("title, present", [
    ("12 killed in blast", "number:deaths:12"),
    ("Twelve killed after earthquake hits Japan", "number:deaths:12"),
    ("Magnitude 6.8 earthquake hits Japan", "number:magnitude:6.8"),
    ("Quake hit on 6 October 2025", "date:2025-10-06"),
    ("It struck on October 6, 2025 at noon", "date:2025-10-06"),
    ("1,200 dead in floods", "number:deaths:1200"),
    ("Japan Meteorological Agency says", "entity:japan meteorological agency"),
    ("award ceremony", "event_type:conflict"),
])
def test_facts_present(spark, title, present):
    assert present in keys(spark, title)


def test_facts_absent(spark):
    for title in ("The report number 4 was published", "1200 dead in floods"):
        assert not [k for k in keys(spark, title) if k.startswith("number")]


def test_facts_in_sql(spark):
    spark.createDataFrame([("12 killed in Japan", "")], "title string, description string").createOrReplaceTempView("some_reports")
    facts.facts_view(spark, "some_reports", "some_facts")
    rows = spark.sql("SELECT fact_key FROM some_facts").collect()
    assert {r[0] for r in rows} == {"number:deaths:12", "entity:japan"}


@pytest.mark.parametrize("value, shown", [
    (12.0, "12"), (6.8, "6.8"), (12345678.5, "12345678.5"), (1e15, "1" + "0" * 15), (12345678901234567890123.0, str(int(12345678901234567890123.0))),
    (0.25, "0.25"), (-3.0, "-3")])
def test_numbers_print_all_their_digits(spark, value, shown):
    assert spark.range(1).select(text.display_number(F.lit(value)).alias("s")).first()["s"] == shown
