"""Queries of state changes and page cascades, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.operators import discovery, ledger, lifecycle, markup, metrics
from glyphmill.plans.catalog import STATUS_SQL, _orders, query
from glyphmill.session import table

_COMMANDS_SQL = """SELECT l_orderkey AS job, l_linenumber AS seq, l_shipdate AS ts, CASE l_partkey % 7 WHEN 0 THEN 'cancel' WHEN 1 THEN 'finish' WHEN 2 THEN 'pause' ELSE 'request' END AS command,
  CASE l_suppkey % 4 WHEN 0 THEN 'DONE' WHEN 1 THEN 'FAILED' WHEN 2 THEN 'RESOLVING' ELSE 'DONE_WITH_ERRORS' END AS target, CASE WHEN l_suppkey % 3 = 0 THEN 'E' || l_suppkey END AS code, CASE WHEN l_partkey % 2 = 0 THEN l_partkey END AS size, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n
  FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey)"""


@query(f"""WITH RECURSIVE c AS ({_COMMANDS_SQL}), f AS (SELECT o_orderkey AS id, 0::BIGINT AS n, {STATUS_SQL} AS status, false AS asked, NULL::TIMESTAMP AS ended, NULL::VARCHAR AS code, NULL::BIGINT AS size, 0 AS applied FROM orders
  UNION ALL SELECT id, n, CASE WHEN ok AND command = 'cancel' THEN 'CANCELLED' WHEN ok AND command = 'finish' THEN target ELSE status END, asked OR (ok AND command IN ('request', 'cancel')), CASE WHEN ok AND command IN ('cancel', 'finish') THEN ts ELSE ended END,
    CASE WHEN ok AND command = 'finish' THEN coalesce(new_code, code) ELSE code END, CASE WHEN ok AND command = 'finish' THEN coalesce(new_size, size) ELSE size END, applied + CAST(ok AS INTEGER)
    FROM (SELECT f.id, c.n, f.status, f.asked, f.ended, f.code, f.size, f.applied, c.command, c.target, c.ts, c.code AS new_code, c.size AS new_size,
      CASE c.command WHEN 'finish' THEN c.target <> 'RESOLVING' WHEN 'pause' THEN false ELSE f.status NOT IN ('DONE', 'DONE_WITH_ERRORS', 'FAILED', 'CANCELLED') END AS ok FROM f JOIN c ON c.job = f.id AND c.n = f.n + 1))
  SELECT id, status, asked AS cancel_requested, ended AS finished_at, code AS error_code, size AS zip_size, CAST(applied AS BIGINT) AS applied FROM f QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC) = 1""")
def commanded_jobs(spark, d):
    """Orders as jobs, their lines as commands one after another."""
    none = lambda kind: F.lit(None).cast(kind)
    rows = _orders(spark, d).select(F.col("o_orderkey").alias("id"), "status", F.lit(False).alias("cancel_requested"), *[none(k).alias(c) for c, k in (("finished_at", "timestamp_ntz"), ("updated_at", "timestamp_ntz"), ("error_code", "string"), ("error_message", "string"), ("zip_name", "string"), ("zip_size", "long"))])
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    first = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_shipdate")).alias("l")).select("l_orderkey", "l_linenumber", "l.*")
    commands = first.select(
        F.col("l_orderkey").alias("job"), F.col("l_linenumber").alias("seq"), F.col("l_shipdate").cast("timestamp_ntz").alias("ts"),
        F.when(part % 7 == 0, "cancel").when(part % 7 == 1, "finish").when(part % 7 == 2, "pause").otherwise("request").alias("command"),
        F.when(supp % 4 == 0, "DONE").when(supp % 4 == 1, "FAILED").when(supp % 4 == 2, "RESOLVING").otherwise("DONE_WITH_ERRORS").alias("target"),
        F.when(supp % 3 == 0, F.concat(F.lit("E"), supp.cast("string"))).alias("error_code"), none("string").alias("error_message"), none("string").alias("zip_name"), F.when(part % 2 == 0, part).alias("zip_size"),
    )
    after, results = lifecycle.commanded(rows, commands)
    n = results.filter("result = 'applied'").groupBy("job").agg(F.count("*").alias("applied"))
    out = after.join(n, after["id"] == n["job"], "left")
    return out.select("id", "status", "cancel_requested", "finished_at", "error_code", "zip_size", F.coalesce("applied", F.lit(0)).alias("applied"))


@query("""WITH e AS (SELECT o_custkey AS job, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS position, 'old ' || o_orderkey AS name, 'DONE' AS status FROM orders WHERE o_custkey % 3 = 0 AND o_orderkey % 2 = 0),
  n AS (SELECT o_custkey AS job, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p, count(*) OVER (PARTITION BY o_custkey) AS available, CASE WHEN o_orderkey % 4 = 0 THEN '' WHEN o_orderkey % 4 > 1 THEN o_orderpriority END AS name FROM orders WHERE o_custkey NOT IN (SELECT job FROM e))
  SELECT job, position, name, status, NULL::BIGINT AS available FROM e UNION ALL SELECT job, CAST(p AS INTEGER), CASE WHEN coalesce(name, '') = '' THEN 'Style ' || p ELSE name END, 'QUEUED', CASE WHEN available > 5 THEN available END FROM n WHERE p <= 5""")
def registered_styles(spark, d):
    """Orders as styles of their customers, a third of whom have some already; five at most, with the number there were where that is more."""
    o, key = table(spark, d, "orders"), F.col("o_orderkey")
    from pyspark.sql import Window

    old = o.filter((F.col("o_custkey") % 3 == 0) & (key % 2 == 0))
    existing = old.select(F.col("o_custkey").alias("job"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("position"), F.concat(F.lit("old "), key.cast("string")).alias("name"), F.lit("DONE").alias("status"))
    specs = o.select(F.col("o_custkey").alias("job"), key.alias("seq"), F.when(key % 4 == 0, "").when(key % 4 > 1, F.col("o_orderpriority")).alias("name"))
    rows, events = lifecycle.registered(existing, specs, 5)
    return rows.join(events.select("job", "available"), "job", "left")


@query("""SELECT c_custkey AS id, count(o_orderkey) AS styles_total, count(o_orderkey) FILTER (o_orderstatus = 'F') AS styles_done, count(o_orderkey) FILTER (o_orderstatus = 'O') AS styles_failed,
  CASE WHEN count(o_orderkey) = 0 OR count(*) FILTER (o_orderstatus = 'F') = 0 THEN 'FAILED' WHEN count(*) FILTER (o_orderstatus = 'F') = count(o_orderkey) THEN 'DONE' ELSE 'DONE_WITH_ERRORS' END AS status,
  CASE WHEN count(o_orderkey) = 0 THEN 'NO_STYLES' WHEN count(*) FILTER (o_orderstatus = 'F') = 0 THEN 'STYLES_FAILED' END AS error_code FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_custkey % 4 > 0) ON o_custkey = c_custkey GROUP BY c_custkey""")
def collection_outcomes(spark, d):
    """Customers as jobs with their orders as styles; a quarter has none."""
    status = F.when(F.col("o_orderstatus") == "F", "DONE").when(F.col("o_orderstatus") == "O", "FAILED").otherwise("RESOLVING")
    children = table(spark, d, "orders").filter("o_custkey % 4 > 0").select(F.col("o_custkey").alias("job"), status.alias("status"))
    return lifecycle.outcomes(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), children)


@query("""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN p_brand || ' & co' WHEN p_size % 5 IN (1, 4) THEN p_name WHEN p_size % 5 = 2 THEN p_type END AS foundry, CASE WHEN p_size % 5 = 0 THEN 'itemDataLayer.brand' WHEN p_size % 5 IN (1, 4) THEN 'json-ld' WHEN p_size % 5 = 2 THEN 'data-brand' END AS source,
  p_size % 2 = 0 AS marked, CASE WHEN p_partkey % 2 = 0 THEN 'https://example.org/fonts/' || p_partkey ELSE 'https://example.org/p' END AS link FROM part""")
def foundry_cascade(spark, d):
    """Parts as pages that name a foundry in several places or in none."""
    n = F.col("p_size") % 5
    script = F.when(n == 0, F.format_string("<script>itemDataLayer . brand = '%s &amp;  co';</script>", "p_brand")).when(n == 4, "<script>itemDataLayer.brand=\" \"</script>").otherwise("")
    block = F.when(n.isin(0, 1, 4), F.format_string('<script type="application/ld+json">{"brand":{"name":"%s"}}</script>', "p_name")).otherwise("")
    attribute = F.when(n.isin(0, 1, 2, 4), F.format_string('<div DATA-BRAND="%s">', "p_type")).otherwise("")
    marker = F.when(F.col("p_size") % 2 == 0, '<font-render-image id="x">').otherwise("")
    link = F.when(F.col("p_partkey") % 2 == 0, F.format_string('<a href="/fonts/%d?x=1">', "p_partkey")).otherwise('<a href="/help">')
    rows = table(spark, d, "part").select("p_partkey", F.concat(attribute, block, script, marker, link).alias("page")).select("p_partkey", "page", markup.linked_data(markup.blocks(F.col("page"))).alias("l"))
    got = rows.select("p_partkey", markup.foundry(F.col("page"), F.col("l.brand")).alias("f"), markup.has_marker(F.col("page")).alias("marked"), markup.nearby_link(F.col("page"), "example.org", F.lit("https://example.org/p")).alias("link"))
    return got.select("p_partkey", F.col("f.value").alias("foundry"), "f.source", "marked", "link")


@query("""WITH g AS (SELECT l_orderkey AS model, CASE WHEN l_suppkey % 9 = 0 THEN '.notdef' ELSE 'g' || l_partkey END AS name, CASE WHEN l_suppkey % 3 > 0 THEN l_linenumber END AS listed, l_quantity * 20 - 100 AS advance, CASE WHEN l_suppkey % 4 > 0 THEN l_linenumber - 3 END AS x_min,
    row_number() OVER (PARTITION BY l_orderkey, CASE WHEN l_suppkey % 9 = 0 THEN '.notdef' ELSE 'g' || l_partkey END ORDER BY l_linenumber, l_suppkey, l_quantity) AS r FROM lineitem),
  a AS (SELECT model, name, listed, advance, x_min FROM g WHERE r = 1 UNION ALL SELECT model, '.notdef', NULL, 500, 50 FROM g GROUP BY model HAVING count(*) FILTER (name = '.notdef') = 0)
  SELECT model, CAST(row_number() OVER (PARTITION BY model ORDER BY name <> '.notdef', listed NULLS LAST, name) - 1 AS INTEGER) AS place, name, CAST(greatest(0, trunc(advance)) AS INTEGER) AS advance, CAST(coalesce(x_min, 0) AS INTEGER) AS lsb FROM a""")
def glyph_orders(spark, d):
    """Order lines as glyphs of a model, some without contours or outside the listing."""
    supp = F.col("l_suppkey")
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("model"), F.when(supp % 9 == 0, ".notdef").otherwise(F.concat(F.lit("g"), F.col("l_partkey").cast("string"))).alias("name"),
        F.struct("l_linenumber", "l_suppkey", "l_quantity").alias("o"), F.when(supp % 3 > 0, F.col("l_linenumber")).alias("listed"), (F.col("l_quantity") * 20 - 100).alias("advance"), F.when(supp % 4 > 0, F.col("l_linenumber") - 3).alias("x_min"),
    )
    first = rows.groupBy("model", "name").agg(F.min_by(F.struct("listed", "advance", "x_min"), "o").alias("v")).select("model", "name", "v.*")
    return lifecycle.glyph_order(first, "model")


@query("""WITH k AS (SELECT user_id AS style, CASE WHEN user_id % 5 > 0 AND event_type = 'click' THEN 'fast' WHEN user_id % 5 > 0 AND event_type = 'view' THEN 'refined' END AS via FROM events),
  s AS (SELECT style, count(*) FILTER (via = 'fast') AS fast, count(*) FILTER (via = 'refined') AS refined, count(via) AS frozen FROM k GROUP BY style), l AS (SELECT *, CASE style % 3 WHEN 0 THEN 'binary' WHEN 1 THEN 'fontmodel' ELSE 'partial' END AS status FROM s)
  SELECT style, fast, refined, frozen, CASE WHEN frozen = 0 THEN 'NO_GLYPHS_FROZEN' END AS error, CASE WHEN status = 'binary' AND frozen = 0 THEN 'binary entry with zero frozen glyphs' WHEN status = 'fontmodel' AND refined = 0 THEN 'fontmodel entry with zero reconstructed glyphs' END AS invalidated,
  CASE WHEN (status = 'binary' AND frozen = 0) OR (status = 'fontmodel' AND refined = 0) THEN 'miss' ELSE status END AS serve FROM l""")
def frozen_styles(spark, d):
    """A user's events as glyphs by the route that froze them, and whether a cached entry of such a style may be served."""
    user = F.col("user_id")
    via = F.when((user % 5 > 0) & (F.col("event_type") == "click"), "fast").when((user % 5 > 0) & (F.col("event_type") == "view"), "refined")
    sums = lifecycle.frozen_styles(table(spark, d, "events").select(user.alias("style"), via.alias("via")), "style", ["fast", "refined"])
    status = F.when(F.col("style") % 3 == 0, "binary").when(F.col("style") % 3 == 1, "fontmodel").otherwise("partial")
    out = lifecycle.hollow_hits(sums.withColumn("status", status).withColumn("reconstructed", F.col("refined")))
    return out.select("style", "fast", "refined", "frozen", "error", "invalidated", "serve")


@query("SELECT DISTINCT l_suppkey, l_partkey, CASE WHEN l_linestatus = 'O' THEN 'gate' ELSE 'UNKNOWN' END AS reason FROM lineitem WHERE l_returnflag = 'R'")
def style_failures(spark, d):
    """Returned lines as failed glyphs of a supplier's style, one row each."""
    return ledger.failures(table(spark, d, "lineitem"), "l_suppkey", "l_partkey", F.col("l_returnflag") == "R", F.when(F.col("l_linestatus") == "O", "gate"))


@query("""WITH b AS (SELECT l_returnflag, left(x, 2) AS block, count(*) AS n, sha256(string_agg(x, ',' ORDER BY x)) AS s FROM (SELECT l_returnflag, md5(l_orderkey || '-' || l_linenumber || '-' || l_partkey) AS x FROM lineitem) GROUP BY ALL)
  SELECT l_returnflag, CAST(sum(n) AS BIGINT) AS n, count(*) AS blocks, sha256(string_agg(block || ':' || s, ',' ORDER BY block)) AS sha256 FROM b GROUP BY l_returnflag""")
def manifest_blocks(spark, d):
    """Manifests of three keys that hold all order lines."""
    digest = F.md5(F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey")]))
    return ledger.manifest_by_blocks(table(spark, d, "lineitem"), "l_returnflag", digest)


@query("""WITH c AS (SELECT user_id, event_id % 17 AS key, event_id AS pos, CASE WHEN event_id % 3 = 0 THEN event_type || ' Bold' END AS name, 'p' || event_id % 2 AS pattern FROM events),
  s AS (SELECT user_id, key, min(pos) AS pos, arg_min(name, pos) FILTER (name IS NOT NULL) AS name, coalesce(arg_min(pattern, pos) FILTER (name IS NOT NULL), arg_min(pattern, pos)) AS name_source FROM c GROUP BY ALL),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY pos) AS INTEGER) AS index FROM s)
  SELECT user_id, index, key, pos, coalesce(name, 'Style ' || index) AS name, CASE WHEN name IS NOT NULL THEN 'Bold' END AS weight, name_source, name IS NULL AS synthesized FROM r""")
def page_styles(spark, d):
    """Events of a user as candidates of a page, a third of them with a name."""
    n = F.col("event_id")
    name = F.when(n % 3 == 0, F.concat("event_type", F.lit(" Bold"))).when(n % 3 == 1, " ")
    rows = table(spark, d, "events").select("user_id", (n % 17).alias("key"), n.alias("pos"), name.alias("name"), F.concat(F.lit("p"), (n % 2).cast("string")).alias("pattern"))
    return discovery.styles(rows, "user_id", "key", "pos", "name", "pattern")


@query("""WITH g AS (SELECT l_orderkey AS model, l_linenumber AS name, l_quantity - 2 AS advance, l_suppkey % 40 > 0 AS loads FROM lineitem), c AS (SELECT l_orderkey AS model, 60 + l_linenumber AS cp, CASE WHEN l_suppkey % 25 = 0 THEN -1 ELSE l_linenumber END AS name FROM lineitem WHERE l_orderkey % 8 > 0),
  o AS (SELECT model, count(*) AS glyphs, bool_or(NOT loads) AS broken, bool_or(advance < 0) AS negative FROM g GROUP BY model), m AS (SELECT model, count(DISTINCT cp) AS mapped, bool_or(name = -1) AS dangling FROM c GROUP BY model)
  SELECT model, glyphs, coalesce(mapped, 0) AS mapped, concat_ws(',', CASE WHEN mapped IS NULL THEN 'EMPTY_CMAP' END, CASE WHEN dangling THEN 'DANGLING_CMAP' END, CASE WHEN glyphs < 2 THEN 'TOO_FEW_GLYPHS' END, CASE WHEN broken THEN 'OUTLINE' END, CASE WHEN negative THEN 'NEGATIVE_ADVANCE' END) AS errors FROM o LEFT JOIN m USING (model)""")
def structural_checks(spark, d):
    """Orders as models with their lines as glyphs; an eighth has no cmap, some map to glyphs that aren't there."""
    rows, supp = table(spark, d, "lineitem"), F.col("l_suppkey")
    glyphs = rows.select(F.col("l_orderkey").alias("model"), F.col("l_linenumber").alias("name"), (F.col("l_quantity") - 2).alias("advance"), (supp % 40 > 0).alias("loads"))
    cmap = rows.filter("l_orderkey % 8 > 0").select(F.col("l_orderkey").alias("model"), (F.col("l_linenumber") + 60).alias("cp"), F.when(supp % 25 == 0, -1).otherwise(F.col("l_linenumber")).alias("name"))
    return metrics.structural(glyphs, cmap, "model").select("model", "glyphs", "mapped", F.array_join("errors", ",").alias("errors"))


@query("""WITH k AS (SELECT DISTINCT l_orderkey, 64 + l_linenumber AS cp FROM lineitem WHERE l_quantity > 2), s AS (SELECT unnest([65, 66, 67, 68]) AS cp)
  SELECT o_orderkey AS model, CAST(4 AS BIGINT) AS total, count(*) FILTER (k.cp IS NULL) AS empty, count(k.cp) / 4 > 0.8 AS passed FROM orders CROSS JOIN s LEFT JOIN k ON k.l_orderkey = o_orderkey AND k.cp = s.cp GROUP BY o_orderkey""")
def rendered_samples(spark, d):
    """Orders as models, their lines as the letters from A on, against a sample of four letters."""
    inks = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("model"), (F.col("l_linenumber") + 64).alias("cp"), F.greatest(F.col("l_quantity") - 2, F.lit(0.0)).alias("ink"))
    return metrics.rendered(table(spark, d, "orders").select(F.col("o_orderkey").alias("model")), inks, "model", "AB, CAD!")
