"""Queries over the driver's tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glyphmill.llm import decontam, hmm, lines, minhash, mixing, pages, pii, quality, ranked, resampling, substrings, suffixes, wavelet
from glyphmill.session import table


def _documents(op: Callable) -> Callable:
    return lambda spark, sf_dir: op(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_site_style_tree": lambda spark, d: pages.op1(table(spark, d, "pages")),
        "op2_entropy_mix": _documents(mixing.op2),
        "op3_weak_supervision": lambda spark, d: quality.op3(table(spark, d, "documents"), table(spark, d, "labels")),
        "op4_tensored_minhash": _documents(minhash.op4),
        "op5_wu_manber": lambda spark, d: decontam.op5(table(spark, d, "documents"), table(spark, d, "benchmark")),
        "op6_super_kmers": _documents(substrings.op6),
        "op7_hidden_markov": _documents(hmm.op7),
        "op8_semi_markov_crf": _documents(pii.op8),
        "op9_line_chunks": _documents(lines.op9),
        "op10_prefix_free_parsing": _documents(suffixes.op10),
        "op11_ranked_search": lambda spark, d: ranked.op11(table(spark, d, "documents"), table(spark, d, "benchmark")),
        "op12_wavelet_matrix": _documents(wavelet.op12),
        "op13_bucket_resampling": lambda spark, d: resampling.op13(table(spark, d, "documents"), table(spark, d, "benchmark")),
    }


OP4_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
  FROM words
), shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id
  WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs
), full_reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM sets
  UNION
  SELECT r.node, l.b FROM full_reach r JOIN links l ON r.seen = l.a
), comp AS (SELECT node, min(seen) AS component_id FROM full_reach GROUP BY node)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM sets s JOIN comp c ON s.doc_id = c.node
"""

OP5_SQL = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS m, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM item WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT m FROM windows
), places AS (
  SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS g
  FROM (SELECT doc_id, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM doc, lengths WHERE len(w) >= m)
), found AS (SELECT p.doc_id, p.i, p.m, x.item_id FROM places p JOIN windows x ON p.g = x.g AND p.m = x.m
), hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM (SELECT DISTINCT doc_id, i, m FROM found)) GROUP BY doc_id
), items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256,
  coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM doc d LEFT JOIN hit h USING (doc_id) LEFT JOIN items t USING (doc_id)
"""

OP6_SQL = r"""
WITH doc AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), places AS (
  SELECT doc_id, i, array_to_string(w[i : i + 49], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM doc WHERE len(w) >= 50)
), first AS (SELECT g, min(doc_id) AS d FROM places GROUP BY g
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM places JOIN first USING (g) WHERE d < doc_id
), lists AS (SELECT doc_id, list(j) AS js FROM gone GROUP BY doc_id
), named AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM doc
), kept AS (
  SELECT n.doc_id, string_agg(n.x, ' ' ORDER BY n.j) AS t FROM named n ANTI JOIN gone g ON n.doc_id = g.doc_id AND n.j = g.j GROUP BY n.doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(len(l.js), 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM doc d LEFT JOIN lists l USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""

OP11_SQL = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), sizes AS (SELECT doc_id, len(w) AS n FROM doc WHERE len(w) > 0
), total AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM sizes
), tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM doc) GROUP BY doc_id, term
), weight AS (
  SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * nd + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term, nd
), item AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), scores AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // l)))) AS BIGINT) AS score
  FROM item JOIN weight USING (term) JOIN tf USING (term) JOIN sizes USING (doc_id), total GROUP BY item_id, doc_id
), ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 50
"""

OP13_SQL = r"""
WITH tab AS (
  SELECT list_transform(range(16), lambda i: list_reduce([0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS tab
), doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), runs AS (
  SELECT doc_id, unnest([array_to_string(w[i : i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) AS f FROM doc, (SELECT unnest([1, 2, 3]) AS k)
), target_runs AS (
  SELECT unnest([array_to_string(w[i : i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) AS f FROM item, (SELECT unnest([1, 2, 3]) AS k)
), by_doc AS (SELECT doc_id, f, count(*) AS c FROM runs GROUP BY doc_id, f
), hexed AS (SELECT f, hex(encode(f)) AS hx FROM (SELECT f FROM by_doc UNION SELECT f FROM target_runs)
), nibbles AS (
  SELECT f, list_transform(range(len(hx)), lambda i: strpos('0123456789ABCDEF', hx[i + 2 - 2 * (i % 2)]) - 1) AS ns FROM hexed
), bucketed AS (
  SELECT f, xor(list_reduce(ns, lambda c, x: xor(tab[CAST(xor(c, x) & 15 AS INTEGER) + 1], c >> 4), 4294967295), 4294967295) % 10000 AS b FROM nibbles, tab
), s AS (SELECT b, CAST(sum(c) AS BIGINT) AS s FROM by_doc JOIN bucketed USING (f) GROUP BY b
), t AS (SELECT b, count(*) AS t FROM target_runs JOIN bucketed USING (f) GROUP BY b
), alls AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS sa, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS ta
), gains AS (
  SELECT b, CAST(floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (sa + 10000) / ((s::DOUBLE + 1) * (ta + 10000)))) AS BIGINT) AS g FROM s LEFT JOIN t USING (b), alls
), weights AS (SELECT doc_id, sum(g * c) AS weight, sum(c) AS n FROM by_doc JOIN bucketed USING (f) JOIN gains USING (b) GROUP BY doc_id
), scored AS (
  SELECT d.doc_id, len(w) AS words, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) AS BIGINT) + CAST(floor(-1000 * ln(-ln((('0x' || sha256('42:' || d.doc_id)[1:8])::BIGINT + 0.5) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM doc d LEFT JOIN weights x ON d.doc_id = x.doc_id
), able AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE words >= 20
)
SELECT s.doc_id, n_features, weight, score, CASE WHEN r <= 5 * n // 100 THEN r END AS rank FROM scored s LEFT JOIN able USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op13_bucket_resampling": OP13_SQL, "op11_ranked_search": OP11_SQL, "op4_tensored_minhash": OP4_SQL, "op5_wu_manber": OP5_SQL, "op6_super_kmers": OP6_SQL}
