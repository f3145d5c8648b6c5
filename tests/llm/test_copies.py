"""Near copies, repeats, mixing, token shards and the pipeline against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corrob.llm import graph, mixing, nearcopies, repeats, token_shards


def clash(df):
    return df.withColumns({c: F.lit("x") for c in ("id", "kept", "n", "component", "packed", "doc", "share", "shard", "slot", "row")})


# --- near copies ----------------------------------------------------------------


def shingles(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)])


def linked(rows, k, percent):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, shingles(t, k))
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            x, y = sets[a], sets[b]
            if a < b and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), root(i)) for i in ids}


def varied(rng):
    """A group of copies with few and with many edits, exact copies, short and unrelated texts."""
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocabulary) for _ in range(90)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 6, 12])):
            words[rng.randrange(len(words))] = rng.choice(["the", "of", rng.choice(vocabulary)])
        rows.append(" ".join(words))
    rows += [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    rows += ["One two", "one TWO", "one  two\n", "", None, "é", "É", "x " * 400, "x x", "one"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_near_copies_equal_all_pairs(rows_of, k, percent):
    rows = varied(random.Random(k))
    got = nearcopies.near_copies(clash(rows_of(rows).repartition(3)), k, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == linked(rows, k, percent)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got) and len(got) == len(rows)


def test_near_copies_of_odd_rows(rows_of):
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "a b c d"), (3, None)]
    got = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in nearcopies.near_copies(rows_of(rows)).collect())
    assert got == Counter({(1, 1, True): 2, (None, None, True): 1, (2, 1, False): 1, (3, 3, True): 1})
    left = nearcopies.drop_near_copies(clash(rows_of(rows)))
    assert sorted((r["doc_id"] or 0 for r in left.collect())) == [0, 1, 3] and "component" in left.columns
    assert nearcopies.near_copies(rows_of([])).collect() == []


def test_estimates_and_merging_of_sketches():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    for shared in (0, 1000, 2500):
        x, y = np.unique(pool[:2500]), np.unique(np.concatenate([pool[:shared], pool[2500:2500 + 1500]]))
        u, v = nearcopies.registers(x), nearcopies.registers(y)
        true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        got = nearcopies.likeliest(u[None], v[None], np.array([len(x)]), np.array([len(y)]))[0]
        assert abs(got - true) < 0.2
        assert (np.maximum(u, v) == nearcopies.registers(np.union1d(x, y))).all()


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 200), (300, 300)]
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(4)).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}


# --- repeats ----------------------------------------------------------------------


def cut(rows):
    seen, out = set(), {}
    for i, text in sorted(r for r in rows if r[0] is not None):
        body = (text or "").encode()
        gone = bytearray(len(body))
        for a in range(len(body) - 99):
            if body[a:a + 100] in seen:
                gone[a:a + 100] = b"\1" * 100
            seen.add(body[a:a + 100])
        kept = bytes(c for c, g in zip(body, gone) if not g)
        runs = sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1]))
        out[i] = (len(body), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def test_repeats_equal_a_scan(rows_of):
    rng = random.Random(3)
    bases = ["".join(rng.choice("abé ") for _ in range(rng.randint(0, 700))) for _ in range(30)]
    texts = [None, "", "a" * 99, "a" * 100, "a" * 101, "x" * 5000, "abc" * 900]
    for _ in range(120):
        a, b, kind = rng.choice(bases), rng.choice(bases), rng.random()
        texts.append(a if kind < .3 else a[:rng.randint(0, len(a))] + b[rng.randint(0, len(b)):] if kind < .7 else a + "Z" + b + a)
    rows = list(enumerate(texts))
    got = repeats.remove_repeats(clash(rows_of(rows).repartition(5))).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == cut(rows)


@pytest.mark.parametrize("size", [1, 2, 3, 7])
def test_first_contexts_are_kept_over_batches(size):
    rng = random.Random(size)
    rows = sorted((rng.randrange(40), rng.randrange(3), doc, 5 << 16) for doc in range(200))

    def batches(n):
        for at in range(0, len(rows), n):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[at:at + n])], names=["gram", "context", "doc", "packed"])

    def ends(n):
        return {(r["gram"], r["doc"]) for b in repeats._first_of_runs(batches(n)) for r in b.to_pylist() if r["gram"] is not None}

    firsts = {}
    for gram, context, doc, _ in rows:
        firsts.setdefault(gram, {}).setdefault(context, doc)
    want = {(gram, doc) for gram, contexts in firsts.items() if len(contexts) > 1 for doc in contexts.values()}
    assert want <= ends(size) and want <= ends(len(rows))


def test_repeats_in_small_batches_equal_a_scan(spark, rows_of):
    rng = random.Random(8)
    shared = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(130, 300))) for _ in range(6)]
    rows = []
    for i in range(120):
        around = ["".join(rng.choice("ijklmnop") for _ in range(40)) for _ in range(2)]
        rows.append((i, rng.choice(shared) if rng.random() < .6 else around[0] + rng.choice(shared) + around[1]))
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "3")
    try:
        got = repeats.remove_repeats(rows_of(rows).repartition(5)).collect()
    finally:
        spark.conf.set(name, before)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == cut(rows)


def test_repeats_of_odd_rows(rows_of):
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefgh") for _ in range(300))
    rows = [(1, long), (1, long), (None, long), (2, "_" + long)]
    got = Counter((r["doc_id"], r["n_removed"]) for r in repeats.remove_repeats(rows_of(rows)).collect())
    assert got == Counter({(1, 0): 2, (None, 0): 1, (2, 300): 1})
    assert repeats.remove_repeats(rows_of([])).collect() == []


# --- mixing -----------------------------------------------------------------------


def filled(sizes):
    """Shares by weight, stopped at twice a source's size, the excess given to the others until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, out = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in out]
        share = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = [s for s in rest if share[s] > 2 * sizes[s]]
        if not over:
            return {**out, **share}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]


def test_mix_meets_its_targets(rows_of):
    rng = random.Random(8)
    rows = [(i, " ".join("w" for _ in range(int(rng.paretovariate(1.2) * 20) % 900)), rng.choice(["a", "a", "b", "é", "z", None])) for i in range(900)]
    rows += [(1000, None, "a"), (1001, "", "empty"), (None, "x y z", "b"), (5, rows[5][1], rows[5][2])]
    df = clash(rows_of(rows, "doc_id bigint, text string, source string"))
    got, again = mixing.mix(df).collect(), mixing.mix(df.repartition(7)).collect()
    assert len(got) == len(rows) and Counter(map(tuple, got)) == Counter(map(tuple, again))
    sizes, taken = Counter(), Counter()
    by_id = {i: s for i, _, s in rows}
    for i, text, source in rows:
        sizes[source] += len((text or "").split())
    want = filled(sizes)
    for r in got:
        source = by_id[r["doc_id"]]
        assert r["source_size"] == sizes[source] and abs(r["target"] - want[source]) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[source] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= max(5, 0.01 * want[s]) for s in sizes)
    copies = Counter(r["doc_id"] for r in mixing.mixed(df).collect())
    assert all(copies[r["doc_id"]] * r["size"] == r["taken"] for r in got if r["doc_id"] not in (5, None))
    assert mixing.mix(rows_of([], "doc_id bigint, text string, source string")).collect() == []


def test_documents_are_drawn_by_their_own_probability(rows_of):
    lengths = [4, 64] * 1000
    df = rows_of([(i, f"{i} " + "w " * (n - 1), "a") for i, n in enumerate(lengths)], "doc_id bigint, text string, source string")
    total = Counter((r["size"], r["taken"] // r["size"]) for r in mixing.mix(df).collect())
    worth = {n: (2.0 ** (n.bit_length() - 1)) ** mixing.PREFERENCE for n in (4, 64)}
    level = 1.5 * sum(lengths) / sum(n * worth[n] for n in lengths)
    for n in (4, 64):
        expected = level * worth[n]  # whole copies for certain, the fraction drawn
        whole = int(expected)
        assert set(k for size, k in total if size == n) == {whole, whole + 1}
        assert abs(total[n, whole + 1] / 1000 - (expected - whole)) < 0.06
    assert abs(sum(n * k * c for (n, k), c in total.items()) - 1.5 * sum(lengths)) <= 64


# --- token shards -------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 4097])
def test_slots_are_a_permutation(n):
    slots = token_shards.permute(np.arange(n), n)
    assert sorted(slots.tolist()) == list(range(n))
    assert n < 50 or (slots != token_shards.permute(np.arange(n), n, key=1)).any()


def test_shards_decode_to_the_texts(spark, rows_of, tmp_path):
    texts = ["hello world", None, "", "naïve 😀 text\n" * 50, "a" * 10_000, " " * 9000, "same", "same"]
    df = clash(rows_of([*enumerate(texts), (None, "no id")]).repartition(3))
    sequences = token_shards.training_order(df, length=64, rows_per_shard=8)
    token_shards.write_shards(sequences, str(tmp_path / "shards"))
    rows = {r["slot"]: r for r in spark.read.parquet(str(tmp_path / "shards")).collect()}
    assert sorted(rows) == list(range(len(rows)))
    assert all(len(r["tokens"]) == 128 and r["byte_offset"] == s % 8 * 128 and r["shard"] == s // 8 for s, r in rows.items())
    with open(token_shards.VOCABULARY, "rb") as file:
        encoding = token_shards._encoding(file.read())
    order = token_shards.permute(np.arange(len(rows)), len(rows))
    ids = np.concatenate([np.frombuffer(rows[s]["tokens"], "<u2")[:rows[s]["n_tokens"]] for s in order.tolist()])
    ends = np.flatnonzero(ids == 50256)
    decoded = [encoding.decode(ids[a:b].tolist()) for a, b in zip([0, *(ends + 1)], ends)]
    assert Counter(decoded) == Counter([t or "" for t in texts] + ["no id"])
    later = token_shards.read_from(spark, str(tmp_path / "shards"), 11, 8)
    assert sorted(r["slot"] for r in later.select("slot").collect()) == list(range(11, len(rows)))
    assert token_shards.training_order(rows_of([]), length=64).collect() == []


# --- the pipeline ---------------------------------------------------------------------


def test_pipeline_runs_and_keeps_whole_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns, name
        rows = docs.collect()
        assert rows and all(before[r["doc_id"]] == r["text"] for r in rows), name
        docs = spark.createDataFrame(rows, docs.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() > 0
