"""SQL with the same results as some of the queries of this package, for a second engine."""

from __future__ import annotations

from corrob.llm import quality as Q

_WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _quoted(text: str) -> str:
    """A string literal; control characters by code."""
    parts = [f"chr({ord(c)})" if ord(c) < 32 else "'" + c.replace("'", "''") + "'" for c in text]
    return "(" + " || ".join(parts) + ")"


def near_copies(k: int = 3, least_percent: int = 85) -> str:
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + {k - 1}), ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {k - 2}, 2))) AS i FROM w WHERE len(w) > 0) q),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {least_percent} * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other),
m AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)"""


def quality() -> str:
    rest, classes = "text", []
    for characters in Q.CLASSES:
        without = f"translate({rest}, {_quoted(characters)}, '')"
        classes.append(f"length({rest}) - length({without})")
        rest = without
    classes.append(f"length({rest})")
    commons = [f"len(list_filter(w, lambda x: x = '{word}'))" for word in Q.COMMON_WORDS]
    commons.append(f"len(w) - len(list_filter(w, lambda x: x IN ({', '.join(repr(c) for c in Q.COMMON_WORDS)})))")

    def means(name: str, n: int) -> str:
        return ", ".join(f"({name}{i} + {Q.PRIOR_DOCS} * sum({name}{i}) OVER () / sum(docs) OVER ()) / (docs + {Q.PRIOR_DOCS})" for i in range(n))

    def sums(name: str, n: int) -> str:
        return ", ".join(f"sum({name}[{i + 1}]) AS {name}{i}" for i in range(n))

    def distance(p: str, q: str) -> str:
        half = "CASE WHEN z[{a}] > 0 THEN z[{a}] * log2(2 * z[{a}] / (z[1] + z[2])) ELSE 0 END"
        return f"sqrt(greatest(list_sum(list_transform(list_zip({p}, {q}), lambda z: ({half.format(a=1)} + {half.format(a=2)}) / 2)), 0))"

    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 2), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2) q),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) q WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS j) o GROUP BY doc_id),
m AS (SELECT d.doc_id, lang, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
  length(text) - length(translate(text, '{Q.SYMBOLS}', '')) AS n_symbols,
  len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')))
    - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')))) AS n_dup_lines,
  coalesce(cov.n, 0) AS n_repeat_words, length(text) AS chars, [{', '.join(classes)}] AS classes, [{', '.join(commons)}] AS commons
  FROM d LEFT JOIN cov ON cov.doc_id = d.doc_id),
b AS (SELECT *, n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > {Q.MAX_REPEATED} * n_words AS base_failed,
  list_transform(classes, lambda x: x / greatest(list_sum(classes), 1)) AS p, list_transform(commons, lambda x: x / greatest(list_sum(commons), 1)) AS c FROM m),
s AS (SELECT lang, count(*) AS docs, {sums('p', len(classes))}, {sums('c', len(commons))} FROM b WHERE NOT base_failed GROUP BY lang),
r AS (SELECT lang AS of, [{means('p', len(classes))}] AS rp, [{means('c', len(commons))}] AS rc FROM s),
j AS (SELECT b.*, {distance('p', 'rp')} AS dp, {distance('c', 'rc')} AS dc FROM b LEFT JOIN r ON of IS NOT DISTINCT FROM lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce((chars >= {Q.MIN_CHARS_FOR_CLASSES} AND dp > {Q.MAX_CLASS_DISTANCE})
    OR (n_words >= {Q.MIN_WORDS_FOR_WORDS} AND dc > {Q.MAX_WORD_DISTANCE}), false) AS kept FROM j"""


def centroids(k: int = 40, dims: int = 64, scale: int = 256, rounds: int = 5, prefix: str = "2:") -> str:
    def assign(i: int) -> str:
        return f"""a{i} AS (SELECT vec_id, v, r, m.d AS distance, m.c AS cluster FROM (SELECT vec_id, r, any_value(x.v) AS v, min({{'d':
  list_sum(list_transform(list_zip(x.v, y.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'c': y.c}}) AS m
  FROM x, c{i} y GROUP BY vec_id, r) q)"""

    def move(i: int) -> str:
        return f"""e{i} AS (SELECT cluster AS c, j, sum(v[j]) AS s, count(*) AS n FROM a{i}, (SELECT unnest(range(1, {dims + 1})) AS j) t GROUP BY ALL),
n{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j)::BIGINT[] AS v FROM e{i} GROUP BY c),
c{i + 1} AS (SELECT c, coalesce(n{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN n{i} USING (c))"""

    steps = ",\n".join(f"{assign(i)},\n{move(i)}" for i in range(rounds))
    return f"""
WITH x AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda e: floor({scale} * CAST(e AS DOUBLE))::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dims}),
c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('{prefix}' || vec_id), v) - 1 AS INT) AS c, v FROM x WHERE vec_id IS NOT NULL
  ORDER BY sha256('{prefix}' || vec_id), v LIMIT {k}),
{steps},
{assign(rounds)}
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} c ON c.c = cluster"""


def ranked_search(top: int = 10) -> str:
    term = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

    def terms(table: str, key: str) -> str:
        return f"""SELECT {key}, term, count(*) AS tf FROM (SELECT {key},
  unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{term}')) AS term FROM {table}) q GROUP BY ALL"""

    return f"""
WITH t AS ({terms("documents", "doc_id")}), i AS ({terms("(SELECT DISTINCT * FROM benchmark)", "item_id")}),
n AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM t GROUP BY doc_id),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS len FROM n),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, s GROUP BY term),
f AS (SELECT item_id, doc_id, CAST(sum(i.tf * w * ((1000000000 * t.tf) // (1000 * t.tf + 8 * (25 + (75 * n * docs) // len)))) AS BIGINT) AS score
  FROM i JOIN t USING (term) JOIN w USING (term) JOIN n USING (doc_id), s GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM f WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {top}"""
