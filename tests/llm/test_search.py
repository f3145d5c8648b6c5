"""Centroid clustering, ranked search and SimHash copies against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from corrob.llm import centroids, fingerprints, graph, ranked_search
from corrob.llm.wordhash import text_slices


def clash(df):
    return df.withColumns({c: F.lit("x") for c in ("id", "n", "m", "v", "fp", "key", "bag", "place", "root", "cluster", "members")})


# --- centroid clustering ----------------------------------------------------------


def lloyd(rows, k, dims, scale, rounds, prefix):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted((hashlib.sha256(f"{prefix}{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    cs = [v for _, v in seeds[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(cs))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        cs = [[sum(x) // len(groups[i]) for x in zip(*groups[i])] if i in groups else c for i, c in enumerate(cs)]
    found = [(i, *near(v)) for i, v in kept]
    inertia = Counter()
    for _, d, c in found:
        inertia[c] += d
    return sorted((str(i), c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, cs[c])).encode()).hexdigest())
                  for i, d, c in found)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")


@pytest.mark.parametrize("k", [1, 5, 500])
def test_clusters_equal_a_plain_loop(spark, k):
    rng = random.Random(k)
    rows = [(i, [float(np.float32(rng.gauss((i % 4) / 3, 0.2))) for _ in range(6)]) for i in range(150)]
    rows += [(150, rows[3][1]), (3, rows[3][1]), (None, rows[4][1]), (151, None), (152, []), (153, [0.0] * 5), (154, [0.0] * 5 + [None]),
             (155, [0.0] * 5 + [float("nan")]), (156, [0.0] * 5 + [float("-inf")]), (157, [-0.001, 0.001, -1.0, 1.0, 0.0, 2.5])]
    options = dict(k=k, dims=6, scale=256, rounds=5, prefix="2:")
    got = sorted((str(r["vec_id"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"])
                 for r in centroids.described(clash(vectors(spark, rows)), **options).collect())
    assert got == lloyd(rows, **options)


def test_clusters_of_nothing_and_of_huge_components(spark):
    assert centroids.described(vectors(spark, [(1, None), (2, [1.0])])).collect() == []
    assert centroids.described(vectors(spark, [])).columns == [
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    rows = centroids.described(vectors(spark, [(1, [3e38] * 64), (2, [-3e38] * 64), (3, [0.0] * 64)]), k=1).collect()
    assert len(rows) == 3 and all(r["distance"] >= 0 for r in rows)


# --- ranked search ------------------------------------------------------------------


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked(docs, items, top=10):
    def terms(text):
        return TERM.findall(re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))

    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n, length = len(bags), sum(sum(b.values()) for _, b in bags)
    having = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in dict.fromkeys(items):
        asked, found = Counter(terms(text)), []
        for d, b in bags:
            m = 25 + (75 * sum(b.values()) * n) // length
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * having[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 8 * m))
                        for t, times in asked.items() if t in b)
            if score > 0:
                found.append((-score, d is None, d))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(str(item), r + 1, d, -s) for r, (s, _, d) in enumerate(found[:top])]
    return sorted(out, key=str)


def asked(spark, docs, items, **options):
    found = ranked_search.search(clash(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)),
                                 clash(spark.createDataFrame(items, "item_id bigint, text string")), **options)
    return sorted(((str(r["item_id"]), r["rank"], r["doc_id"], r["score"]) for r in found.collect()), key=str)


@pytest.mark.parametrize("block", [ranked_search.BLOCK_BYTES, 300])
def test_ranks_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ranked_search, "BLOCK_BYTES", block)
    monkeypatch.setattr(ranked_search, "CELLS", 40)
    rng = random.Random(4)
    vocabulary = [f"{a}{b}" for a in "the über naïve42 Straße x".split() for b in "abcdefg"]
    docs = [(i, "; ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 8, 30])))) for i in range(250)]
    docs += [(1000 + i, docs[7][1]) for i in range(40)] + [(2000 + i, docs[9][1] + f" other{i:03d}") for i in range(40)]
    docs += [(None, docs[7][1]), (7, docs[7][1]), (3000, None), (3001, ""), (3002, "-- \x00 __"), (3003, "word " * 200_000 + "thea")]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(9)).upper() + " ÜBER thea THEA") for i in range(12)]
    items += [(3, items[3][1]), (None, "xa, xa xb"), (20, None), (21, "..."), (22, "nowhere"), (23, docs[7][1])]
    got = asked(spark, docs, items)
    assert got == ranked(docs, [i for i in items if i[1] is not None])
    assert Counter(i for i, *_ in got).most_common(1)[0][1] == 10


def test_search_of_nothing(spark):
    assert asked(spark, [(1, None)], [(1, "a")]) == [] == asked(spark, [(1, "a")], [(1, None)]) == asked(spark, [], [])


# --- SimHash copies -------------------------------------------------------------------


def plain_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda c: c[0].lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_hashes_equal_the_published_function():
    rng = random.Random(3)
    parts = [bytes(rng.randrange(256) for _ in range(rng.randrange(1, 150))) for _ in range(1500)]
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in parts])))
    got = fingerprints.xxh64(np.frombuffer(b"".join(parts), np.uint8), offsets[:-1], offsets[1:])
    assert [int(x) for x in got] == [xxhash.xxh64(p, seed=42).intdigest() for p in parts]


def test_fingerprints_equal_a_plain_loop():
    rng = random.Random(5)
    texts = ["", None, "One", "a  b\tC", "Ünï ÄB C d e f g", " x y z w ", "é" * 5000] + [
        " ".join(rng.choice(["the", "of", "Äpfel", "blue-ish", "X" * 40]) for _ in range(rng.randrange(60))) for _ in range(200)]
    got = [int(x) for _, _, data, offsets in text_slices(pa.array(texts, pa.large_string()), 500)
           for x in fingerprints.fingerprints(data, offsets)]
    assert got == [plain_fingerprint(t) for t in texts]


def test_code_is_perfect_and_near_segments_share_a_key():
    assert (np.bincount(fingerprints.codeword(np.arange(1 << 23))) == 1 << 11).all()
    rng = random.Random(6)
    a = np.array([rng.randrange(1 << 64) for _ in range(3000)], np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for _ in range(rng.randrange(3)):
            b[i] ^= np.uint64(1 << rng.randrange(64))
    found = []
    for fps in (a, b):
        row, key = fingerprints.keys(fps)
        assert max(np.bincount(row)) <= 18
        found.append([set() for _ in fps])
        for r, k in zip(row, key):
            found[-1][r].add(k)
    assert all(x & y for x, y in zip(*found))


def reached(fps):
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = sorted(parent)
    for i, x in enumerate(order):
        for y in order[:i]:
            if bin(x ^ y).count("1") <= 2:
                p, q = root(x), root(y)
                parent[max(p, q)] = min(p, q)
    return {f: root(f) for f in fps}


def test_components_of_dense_fingerprints_equal_all_pairs(spark):
    """Balls of fingerprints with chains between them: keys with many members in several components."""
    rng = random.Random(7)
    fps = set()
    for _ in range(6):
        centre = rng.randrange(1 << 64)
        for _ in range(120):
            x = centre
            for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 9])):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
        # one intact segment, all else far apart
        fps |= {(centre & ((1 << 43) - 1)) | (rng.randrange(1 << 21) << 43) for _ in range(60)}
    fps |= {0, 1, (1 << 63), (1 << 64) - 1}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = {r["fp"] % (1 << 64): r["root"] for r in fingerprints.fingerprint_components(
        spark.createDataFrame([(x,) for x in signed], "fp bigint")).collect()}
    groups = {}
    for f, r in reached(fps).items():
        groups.setdefault(r, set()).add(f)
    mine = {}
    for f in fps:
        mine.setdefault(got.get(f, ("alone", f)), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_copies_equal_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(6):
        base = [rng.choice(words) for _ in range(120)]
        for _ in range(25):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
                copy[rng.randrange(120)] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    rows += [(900, None), (901, ""), (902, " \t"), (903, "one"), (904, "ONE"), (905, "one two"), (5, rows[5][1]),
             (None, rows[9][1]), (None, "never seen before"), (906, "w " * 300_000)]
    prints = [plain_fingerprint(t) for _, t in rows]
    root, least = reached(prints), {}
    for (i, _), f in zip(rows, prints):
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    want = sorted(((i, f"{f:016x}", least.get(root[f])) for (i, _), f in zip(rows, prints)), key=str)
    df = clash(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in fingerprints.simhash_copies(df).collect()), key=str)
    assert got == want and len(set(least.values())) < len(set(prints)) < len(rows)
    assert fingerprints.simhash_copies(df.limit(0)).collect() == []


def test_no_table_of_fingerprints_goes_through_the_driver(rows_of, monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefgh") * 3 for _ in range(12)) for _ in range(60)]
    plans = []

    def seen(df, name, store=fingerprints.stored):
        df.collect()  # as Spark ran it, joins changed on the way included
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store(df, name)

    monkeypatch.setattr(fingerprints, "stored", seen)
    monkeypatch.setattr(graph, "stored", seen)
    out = fingerprints.simhash_copies(rows_of([(i, texts[i % 50]) for i in range(60)] + [(70, texts[0] + " x"), (71, None), (72, "")]))
    assert {r["component_id"] for r in out.filter("doc_id in (0, 50)").collect()} == {0}
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) >= 5 and not [p for p in plans if "Broadcast" in p]
