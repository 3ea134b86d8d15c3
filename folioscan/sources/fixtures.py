"""Stand-in tables with the shapes that the operators take, derived from the given tables.

Each is defined twice, as a DataFrame here and as SQL in FIXTURE_SQL (the
tables it needs, its query).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscan.storage import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page (from 0), text: the lines of documents as pages."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "text"))


def label_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, first_page, style, prefix, start."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    ranges = F.array(
        F.when(F.col("doc_id") % 10 != 9, F.struct(F.lit(0).alias("first_page"), F.lit("r").alias("style"), F.lit("").alias("prefix"), F.lit(1).cast("long").alias("start"))),
        F.struct(F.lit(3).alias("first_page"), F.lit("D").alias("style"), F.lit("").alias("prefix"), F.lit(1).cast("long").alias("start")),
        F.when(F.col("doc_id") % 3 == 0, F.struct(F.lit(6).alias("first_page"), F.lit("A").alias("style"), F.lit("A-").alias("prefix"), F.lit(1).cast("long").alias("start"))),
    )
    return docs.select("doc_id", F.explode(F.array_compact(ranges)).alias("r")).select("doc_id", "r.*")


def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, id, parent, ord, title, page: turns of conversations."""
    t = table(spark, sf_dir, "conversations")
    turn = F.col("turn").cast("int")
    parent = F.when(turn == 0, F.lit(None)).when(F.col("role") == "user", F.lit(0)).otherwise(turn - 1).cast("int")
    return t.select(F.col("conv_id").alias("doc_id"), turn.alias("id"), parent.alias("parent"), turn.alias("ord"), F.col("text").alias("title"), (turn * 2).alias("page"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page, ord, subtype, flags, target: hrefs of web pages, after the page's own URL."""
    t = table(spark, sf_dir, "pages")
    found = F.concat(F.array("url"), F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1))
    t = t.select((F.col("page_id") % 50).alias("doc_id"), F.col("page_id").cast("int").alias("page"), F.posexplode(found).alias("ord", "target"))
    return t.select("doc_id", "page", "ord", F.when((F.col("page") + F.col("ord")) % 7 == 0, F.lit("Widget")).otherwise(F.lit("Link")).alias("subtype"), ((F.col("page") * 3 + F.col("ord")) % 64).alias("flags"), "target")


def page_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page, media_box, crop_box, rotate: from parts."""
    t = table(spark, sf_dir, "part")
    doc, page = F.col("p_partkey") % 100, F.floor(F.col("p_partkey") / 100).cast("int")
    box = lambda *v: F.array(*(F.lit(x).cast("double") if not hasattr(x, "cast") else x.cast("double") for x in v))
    size = F.col("p_size")
    crop = F.when(page % 3 == 0, box(10, 20, size * 12 - 6, size * 16 - 8))
    return t.select(doc.alias("doc_id"), page.alias("page"), box(0, 0, size * 12, size * 16).alias("media_box"), crop.alias("crop_box"), (F.col("p_partkey") % 5 * 90).cast("int").alias("rotate"))


def rev_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, rev, origin, num, kind, generation, position: entries of line items, the newest last."""
    t = table(spark, sf_dir, "lineitem")
    order = W.partitionBy("l_orderkey").orderBy("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_linenumber")
    return t.select(
        F.col("l_orderkey").alias("doc_id"), F.row_number().over(order).alias("rev"), F.when(F.col("l_linestatus") == "O", "stream").otherwise("table").alias("origin"), F.col("l_linenumber").alias("num"),
        F.when(F.col("l_returnflag") == "R", "free").when(F.col("l_linestatus") == "O", "compressed").otherwise("inuse").alias("kind"), (F.col("l_quantity") % 4).cast("int").alias("generation"), F.col("l_partkey").alias("position"),
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, seq, num, op, value: changes to every fifth document."""
    t = table(spark, sf_dir, "lineitem").where("l_orderkey % 5 = 0")
    order = W.partitionBy("l_orderkey").orderBy(F.desc("l_shipdate"), "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_linenumber")
    op = F.when(F.col("l_returnflag") == "A", "set").when(F.col("l_returnflag") == "N", "add").otherwise("free")
    return t.select(F.col("l_orderkey").alias("doc_id"), F.row_number().over(order).alias("seq"), (F.col("l_linenumber") * 2 - 1).alias("num"), op.alias("op"), F.col("l_suppkey").cast("string").alias("value"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, url, sha256, license, categories, notes, password; every eleventh row breaks one rule or another."""
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    bad = lambda n: k % 121 == n * 11
    return d.select(
        F.when(bad(1), F.concat(F.lit(".d-"), k)).when(bad(2), F.concat(F.lit("d "), k)).when(bad(3), F.concat(F.lit("D-"), k - 1)).otherwise(F.concat(F.lit("d-"), k)).alias("id"),
        F.when(bad(4), F.lit("http://example.com/x")).otherwise(F.concat(F.lit("https://example.com/"), k)).alias("url"),
        F.when(bad(5), F.lit("abc")).otherwise(F.sha2("text", 256)).alias("sha256"),
        F.when(bad(6), F.lit(" ")).otherwise(F.concat(F.lit("license of "), F.col("source"))).alias("license"),
        F.when(bad(7), F.array().cast("array<string>")).when(bad(8), F.array(F.lit(" "))).otherwise(F.array("lang", "source")).alias("categories"),
        F.when(bad(9), F.lit("")).otherwise(F.lit("from the table")).alias("notes"),
        F.when(bad(10), F.repeat(F.lit("x"), 300)).when(k % 13 == 0, F.lit("open")).alias("password"),
    )


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, outcome, message, repairs, found_repairs, ms: of labelled documents."""
    t = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    k = F.col("doc_id")
    outcome = F.when(F.col("toxic") == 1, "Crashed").when((F.col("quality") == 1) & (k % 20 != 0), "Rendered").when(F.col("quality") == 1, "RenderFailed").when(k % 3 == 0, "Rejected").otherwise("Rendered")
    repairs = F.when(k % 4 == 0, F.array(F.lit("xref-rebuilt"), F.lit("length-fixed"))).when(k % 4 == 1, F.array(F.lit("length-fixed"))).otherwise(F.array().cast("array<string>"))
    message = F.when(k % 6 == 0, "password required").when(k % 6 == 1, "").otherwise("not a document")
    return t.select(F.concat(F.lit("d-"), k).alias("id"), outcome.alias("outcome"), message.alias("message"), repairs.alias("repairs"), (k % 5 != 0).alias("found_repairs"), F.col("n_chars").alias("ms"))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """report, side, os, arch, name, value, higher_is_better, tracked, floor: of events, by day."""
    t = table(spark, sf_dir, "events")
    day = F.to_date("ts")
    return t.select(
        day.cast("string").alias("report"), F.when(F.col("event_id") % 2 == 0, "previous").otherwise("current").alias("side"), F.lit("linux").alias("os"), F.lit("x86_64").alias("arch"),
        F.concat_ws("/", "event_type", (F.col("user_id") % 5).cast("string")).alias("name"), F.col("value"), F.col("event_type").isin("purchase", "view").alias("higher_is_better"), (F.col("event_type") != "signup").alias("tracked"), F.lit(5.0).alias("floor"),
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pid, seq, ts, line, ms, kind: events as lines of a process."""
    t = table(spark, sf_dir, "events")
    line = F.concat_ws(" ", F.col("event_id").cast("string"), F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "click", "DEBUG").otherwise(F.col("event_type")), F.col("props"))
    return t.select(F.col("user_id").alias("pid"), F.col("event_id").alias("seq"), "ts", line.alias("line"), F.col("value").alias("ms"), F.col("event_type").alias("kind"))


def ref_nodes_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: orders to parts, parts to suppliers, suppliers to nations, nations to regions, and regions back to orders."""
    li, su, na = (table(spark, sf_dir, n) for n in ("lineitem", "supplier", "nation"))
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    out = li.select(name("o", "l_orderkey").alias("src"), name("p", "l_partkey").alias("dst")).union(li.select(name("p", "l_partkey"), name("s", "l_suppkey")))
    out = out.union(su.select(name("s", "s_suppkey"), name("n", "s_nationkey"))).union(na.select(name("n", "n_nationkey"), name("r", "n_regionkey")))
    return out.union(na.select(name("r", "n_regionkey"), name("o", "n_nationkey"))).distinct()


def doc_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (doc_id, node, kind), edges (doc_id, src, dst) and roots (doc_id, node, open): the orders of a customer, numbered; each names two later ones, an earlier one and one that is missing."""
    t = table(spark, sf_dir, "orders")
    nodes = t.select(F.col("o_custkey").alias("doc_id"), F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long").alias("node"), F.get(F.array(*map(F.lit, KINDS)), (F.col("o_orderkey") % 7).cast("int")).alias("kind"), (F.col("o_orderstatus") == "O").alias("open"))
    nodes, n = stored(nodes, "doc-nodes"), F.col("node")  # the orders are numbered once for nodes, edges and roots
    edges = nodes.select("doc_id", n.alias("src"), F.explode(F.array(n * 2, n * 2 + 1, F.floor(n / 3), n + 1000)).alias("dst"))
    return nodes.select("doc_id", "node", "kind"), edges, nodes.where("node IN (1, 5)").select("doc_id", "node", "open")


#: Kinds of the nodes of reference graphs, by their numbers.
KINDS = ("JavaScript", "Launch", "URI", "SubmitForm", "GoToR", "GoTo", "Named")


def page_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, parent, pos, a, b, c, leaf: region, nation, customer, order, with attributes set here and there."""
    re_, na, cu, od = (table(spark, sf_dir, n) for n in ("region", "nation", "customer", "orders"))
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    none = F.lit(None).cast("string")
    row = lambda d, me, up, pos, a, b, c, leaf: d.select(me.alias("id"), up.alias("parent"), F.col(pos).cast("long").alias("pos"), a.alias("a"), b.alias("b"), c.alias("c"), F.lit(leaf).alias("leaf"))
    out = row(re_, name("r", "r_regionkey"), none, "r_regionkey", name("A", "r_regionkey"), none, none, False)
    out = out.union(row(na, name("n", "n_nationkey"), name("r", "n_regionkey"), "n_nationkey", none, F.when(F.col("n_nationkey") % 3 == 0, name("B", "n_nationkey")), none, False))
    out = out.union(row(cu, name("c", "c_custkey"), name("n", "c_nationkey"), "c_custkey", none, none, F.when(F.col("c_acctbal") < 0, name("C", "c_custkey")), False))
    return out.union(row(od, name("o", "o_orderkey"), name("c", "o_custkey"), "o_orderkey", none, F.when(F.col("o_orderkey") % 10 == 0, name("B", "o_orderkey")), none, True))


_PT = """SELECT doc_id, (i - 1)::INT AS page, t[i] AS text FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents))"""

FIXTURE_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "page_text": ((), _PT),
    "label_ranges": ((), """SELECT doc_id, 0 AS first_page, 'r' AS style, '' AS prefix, 1::BIGINT AS start FROM documents WHERE doc_id % 10 <> 9
UNION ALL SELECT doc_id, 3, 'D', '', 1 FROM documents UNION ALL SELECT doc_id, 6, 'A', 'A-', 1 FROM documents WHERE doc_id % 3 = 0"""),
    "outline": ((), """SELECT conv_id AS doc_id, turn::INT AS id, CASE WHEN turn = 0 THEN NULL WHEN role = 'user' THEN 0 ELSE turn - 1 END::INT AS parent, turn::INT AS ord, text AS title, (turn * 2)::INT AS page FROM conversations"""),
    "links": ((), """SELECT doc_id, page, ord, CASE WHEN (page + ord) % 7 = 0 THEN 'Widget' ELSE 'Link' END AS subtype, (page * 3 + ord) % 64 AS flags, target FROM
(SELECT page_id % 50 AS doc_id, page_id::INT AS page, (i - 1)::INT AS ord, l[i] AS target FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT page_id, list_concat([url], regexp_extract_all(html, 'href="([^"]*)"', 1)) AS l FROM pages)))"""),
    "page_boxes": ((), """SELECT p_partkey % 100 AS doc_id, (p_partkey // 100)::INT AS page, [0.0::DOUBLE, 0.0, p_size * 12, p_size * 16]::DOUBLE[] AS media_box,
CASE WHEN (p_partkey // 100) % 3 = 0 THEN [10.0::DOUBLE, 20.0, p_size * 12 - 6, p_size * 16 - 8]::DOUBLE[] END AS crop_box, (p_partkey % 5 * 90)::INT AS rotate FROM part"""),
    "rev_entries": ((), """SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_linenumber)::INT AS rev,
CASE WHEN l_linestatus = 'O' THEN 'stream' ELSE 'table' END AS origin, l_linenumber AS num, CASE WHEN l_returnflag = 'R' THEN 'free' WHEN l_linestatus = 'O' THEN 'compressed' ELSE 'inuse' END AS kind,
(l_quantity % 4)::INT AS generation, l_partkey AS position FROM lineitem"""),
    "changes": ((), """SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_linenumber)::INT AS seq,
l_linenumber * 2 - 1 AS num, CASE l_returnflag WHEN 'A' THEN 'set' WHEN 'N' THEN 'add' ELSE 'free' END AS op, l_suppkey::VARCHAR AS value FROM lineitem WHERE l_orderkey % 5 = 0"""),
    "manifest": ((), """SELECT CASE doc_id % 121 WHEN 11 THEN '.d-' || doc_id WHEN 22 THEN 'd ' || doc_id WHEN 33 THEN 'D-' || (doc_id - 1) ELSE 'd-' || doc_id END AS id,
CASE doc_id % 121 WHEN 44 THEN 'http://example.com/x' ELSE 'https://example.com/' || doc_id END AS url, CASE doc_id % 121 WHEN 55 THEN 'abc' ELSE sha256(text) END AS sha256,
CASE doc_id % 121 WHEN 66 THEN ' ' ELSE 'license of ' || source END AS license, CASE doc_id % 121 WHEN 77 THEN []::VARCHAR[] WHEN 88 THEN [' '] ELSE [lang, source] END AS categories,
CASE doc_id % 121 WHEN 99 THEN '' ELSE 'from the table' END AS notes, CASE WHEN doc_id % 121 = 110 THEN repeat('x', 300) WHEN doc_id % 13 = 0 THEN 'open' END AS password FROM documents"""),
    "outcomes": ((), """SELECT 'd-' || doc_id AS id, CASE WHEN toxic = 1 THEN 'Crashed' WHEN quality = 1 AND doc_id % 20 <> 0 THEN 'Rendered' WHEN quality = 1 THEN 'RenderFailed' WHEN doc_id % 3 = 0 THEN 'Rejected' ELSE 'Rendered' END AS outcome,
CASE doc_id % 6 WHEN 0 THEN 'password required' WHEN 1 THEN '' ELSE 'not a document' END AS message, CASE doc_id % 4 WHEN 0 THEN ['xref-rebuilt', 'length-fixed'] WHEN 1 THEN ['length-fixed'] ELSE []::VARCHAR[] END AS repairs,
doc_id % 5 <> 0 AS found_repairs, n_chars AS ms FROM labels JOIN documents USING (doc_id)"""),
    "metrics": ((), """SELECT (ts::DATE)::VARCHAR AS report, CASE WHEN event_id % 2 = 0 THEN 'previous' ELSE 'current' END AS side, 'linux' AS os, 'x86_64' AS arch, event_type || '/' || (user_id % 5) AS name, value,
event_type IN ('purchase', 'view') AS higher_is_better, event_type <> 'signup' AS tracked, 5.0::DOUBLE AS floor FROM events"""),
    "log_lines": ((), """SELECT user_id AS pid, event_id AS seq, ts, concat_ws(' ', event_id::VARCHAR, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'DEBUG' ELSE event_type END, props) AS line, value AS ms, event_type AS kind FROM events"""),
    "ref_edges": ((), """SELECT DISTINCT * FROM (SELECT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst FROM lineitem UNION ALL SELECT 'p' || l_partkey, 's' || l_suppkey FROM lineitem
UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || n_regionkey, 'o' || n_nationkey FROM nation)"""),
    "doc_nodes": ((), f"""SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS node, ({list(KINDS)})[o_orderkey % 7 + 1] AS kind, o_orderstatus = 'O' AS open FROM orders"""),
    "doc_edges": (("doc_nodes",), """SELECT doc_id, node AS src, unnest([node * 2, node * 2 + 1, node // 3, node + 1000]) AS dst FROM doc_nodes"""),
    "page_tree": ((), """SELECT 'r' || r_regionkey AS id, NULL::VARCHAR AS parent, r_regionkey::BIGINT AS pos, 'A' || r_regionkey AS a, NULL::VARCHAR AS b, NULL::VARCHAR AS c, false AS leaf FROM region
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey, NULL, CASE WHEN n_nationkey % 3 = 0 THEN 'B' || n_nationkey END, NULL, false FROM nation
UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_custkey, NULL, NULL, CASE WHEN c_acctbal < 0 THEN 'C' || c_custkey END, false FROM customer
UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, o_orderkey, NULL, CASE WHEN o_orderkey % 10 = 0 THEN 'B' || o_orderkey END, NULL, true FROM orders"""),
}
