"""Queries of trees, graphs, logs and streams."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.operators import graph, report, search
from folioscan.plans.book import Book
from folioscan.plans.text_queries import THE, _hits_sql
from folioscan.sources import fixtures as X
from folioscan.storage import fresh_path
from folioscan.streaming import logs

BOOK = Book()
query = BOOK.query

_TREE_SQL = """l0 AS (SELECT id, parent, a, b, c, leaf, 0 AS depth, [pos] AS path FROM page_tree WHERE parent IS NULL),
l1 AS (SELECT t.id, t.parent, coalesce(t.a, u.a) AS a, coalesce(t.b, u.b) AS b, coalesce(t.c, u.c) AS c, t.leaf, 1 AS depth, list_append(u.path, t.pos) AS path FROM page_tree t JOIN l0 u ON t.parent = u.id),
l2 AS (SELECT t.id, t.parent, coalesce(t.a, u.a) AS a, coalesce(t.b, u.b) AS b, coalesce(t.c, u.c) AS c, t.leaf, 2 AS depth, list_append(u.path, t.pos) AS path FROM page_tree t JOIN l1 u ON t.parent = u.id),
l3 AS (SELECT t.id, t.parent, coalesce(t.a, u.a) AS a, coalesce(t.b, u.b) AS b, coalesce(t.c, u.c) AS c, t.leaf, 3 AS depth, list_append(u.path, t.pos) AS path FROM page_tree t JOIN l2 u ON t.parent = u.id),
tree AS (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3)"""


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.walk(X.page_tree(spark, sf_dir), [], ["a", "b", "c"], ["leaf"])


@query(f"WITH {_TREE_SQL} SELECT id, depth, a, b, c, array_to_string(path, '/') AS path FROM tree WHERE leaf", using=("page_tree",))
def graph_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves in document order (path) with inherited attributes."""
    return _tree(spark, sf_dir).where("leaf").select("id", "depth", "a", "b", "c", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"))


@query(f"WITH {_TREE_SQL} SELECT path[1] AS root, count(*) AS n, count(b) AS with_b, bool_or(b = 'B0') AS has_b0 FROM tree WHERE leaf GROUP BY 1", using=("page_tree",))
def graph_inherited_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether any leaf of a root has a kind of its own or of an ancestor."""
    return _tree(spark, sf_dir).where("leaf").groupBy(F.get("path", F.lit(0)).alias("root")).agg(F.count("*").alias("n"), F.count("b").alias("with_b"), F.bool_or(F.col("b") == "B0").alias("has_b0"))


@query(f"""WITH {_TREE_SQL} SELECT l_partkey AS key, l_suppkey AS value, array_to_string(list_append(path, l_linenumber::BIGINT), '/') AS path FROM tree JOIN lineitem ON id = 'o' || l_orderkey""", using=("page_tree",))
def graph_key_value_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number tree whose leaves are orders, and whose pairs are their line items."""
    li = X.table(spark, sf_dir, "lineitem")
    pairs = li.select(F.concat(F.lit("o"), "l_orderkey").alias("id"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("key"), F.col("l_suppkey").alias("value"))
    return graph.key_tree(X.page_tree(spark, sf_dir), [], pairs).withColumn("path", F.array_join(F.col("path").cast("array<string>"), "/"))


_OUTLINE_SQL = """ot AS (SELECT doc_id, id, parent, title, page, 0 AS depth, [ord] AS path FROM outline WHERE parent IS NULL UNION ALL
SELECT o.doc_id, o.id, o.parent, o.title, o.page, depth + 1, list_append(path, o.ord) FROM outline o JOIN ot ON o.doc_id = ot.doc_id AND o.parent = ot.id WHERE depth < 64)"""


@query(f"WITH {_OUTLINE_SQL} SELECT doc_id, id, depth, row_number() OVER (PARTITION BY doc_id ORDER BY path) - 1 AS preorder FROM ot", using=("outline",))
def graph_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graph.walk(X.outline(spark, sf_dir).withColumn("pos", F.col("ord")), ["doc_id"], [])
    return graph.preorder(rows, ["doc_id"]).select("doc_id", "id", "depth", "preorder")


@query(f"WITH {_OUTLINE_SQL} SELECT doc_id, id, array_to_string(path, '/') AS path, len(path) AS n FROM ot", using=("outline",))
def graph_section_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graph.walk(X.outline(spark, sf_dir).withColumn("pos", F.col("ord")), ["doc_id"], [])
    return rows.select("doc_id", "id", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"), F.size("path").alias("n"))


@query("SELECT conv_id, text_key, turn::INT AS rank FROM (SELECT conv_id, turn, conv_id || ':' || (turn * 7 % 31) AS text_key FROM conversations)")
def graph_sibling_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that only name the next turn, ranked again."""
    key = lambda t: F.concat_ws(":", F.col("conv_id").cast("string"), (t * 7 % 31).cast("string"))
    t = X.table(spark, sf_dir, "conversations").select("conv_id", "turn")
    last = t.groupBy("conv_id").agg(F.max("turn").alias("m"))
    chain = t.join(last, "conv_id").select("conv_id", key(F.col("turn")).alias("text_key"), F.when(F.col("turn") < F.col("m"), key(F.col("turn") + 1)).alias("next"))
    return graph.chain_ranks(chain, "conv_id", "text_key", "next")


@query("""WITH RECURSIVE c AS (SELECT conv_id, turn, conv_id || ':' || turn AS text_key, conv_id || ':' || CASE WHEN turn < max(turn) OVER w THEN turn + 1 ELSE max(turn) OVER w // 2 END AS nxt FROM conversations WINDOW w AS (PARTITION BY conv_id)),
r AS (SELECT conv_id, text_key, nxt, 0 AS rank FROM c WHERE turn = 0 UNION ALL SELECT c.conv_id, c.text_key, c.nxt, rank + 1 FROM r JOIN c ON c.text_key = r.nxt WHERE rank < 100)
SELECT conv_id, text_key, min(rank)::BIGINT AS rank FROM r GROUP BY ALL""")
def graph_looped_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns whose last one names one in the middle again: the level ends there."""
    t = X.table(spark, sf_dir, "conversations").select("conv_id", "turn")
    key = lambda n: F.concat_ws(":", F.col("conv_id").cast("string"), n.cast("bigint").cast("string"))
    last = t.groupBy("conv_id").agg(F.max("turn").alias("m"))
    chain = t.join(last, "conv_id").select("conv_id", key(F.col("turn")).alias("text_key"), key(F.when(F.col("turn") < F.col("m"), F.col("turn") + 1).otherwise(F.floor(F.col("m") / 2))).alias("next"))
    first = t.where("turn = 0").select("conv_id", key(F.col("turn")).alias("text_key")).distinct()
    return graph.chain_ranks(chain, "conv_id", "text_key", "next", first)


#: Roots are the urgent orders; twelve levels hold all that they reach.
_REACHED_SQL = """rc AS (SELECT 'o' || o_orderkey AS node, 0 AS level FROM orders WHERE o_orderpriority = '1-URGENT' UNION SELECT dst, level + 1 FROM rc JOIN ref_edges ON src = node WHERE level < 12),
rl AS (SELECT node, min(level) AS level FROM rc GROUP BY node)"""


def _roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("o"), "o_orderkey").alias("node"), (F.col("o_orderstatus") == "O").alias("open"))


def _reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reached(X.ref_nodes_edges(spark, sf_dir), _roots(spark, sf_dir))


@query(f"WITH {_REACHED_SQL} SELECT node, level FROM rl", using=("ref_edges",))
def graph_reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reached(spark, sf_dir)


@query(f"WITH {_REACHED_SQL} SELECT node, level, row_number() OVER (PARTITION BY level ORDER BY node)::INT AS place FROM rl", using=("ref_edges",))
def graph_renumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.renumbered(_reached(spark, sf_dir)).withColumn("place", F.col("place").cast("int"))


_LEVELS = 12
_DISCOVERED_SQL = "d0 AS MATERIALIZED (SELECT node, row_number() OVER (ORDER BY node) AS place FROM (SELECT DISTINCT 'o' || o_orderkey AS node FROM orders WHERE o_orderpriority = '1-URGENT')), " + ", ".join(
    f"d{k} AS MATERIALIZED (SELECT dst AS node, row_number() OVER (ORDER BY min(place), dst) AS place FROM d{k - 1} JOIN ref_edges ON src = node WHERE " + " AND ".join(f"dst NOT IN (SELECT node FROM d{i})" for i in range(k)) + " GROUP BY dst)"
    for k in range(1, _LEVELS)
)


@query(f"WITH {_DISCOVERED_SQL} " + " UNION ALL ".join(f"SELECT node, {k} AS level, place FROM d{k}" for k in range(_LEVELS)), using=("ref_edges",))
def graph_discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the urgent orders reach, in the order of a breadth-first discovery."""
    return graph.discovered(X.ref_nodes_edges(spark, sf_dir), _roots(spark, sf_dir)).drop("number")


def graph_renumbered_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that all orders reach, by name inside a level."""
    roots = X.table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("node"))
    return graph.renumbered(graph.reached(X.ref_nodes_edges(spark, sf_dir), roots))


#: Queries without SQL.
WITHOUT_SQL = {"graph_renumbered_whole": graph_renumbered_whole}


_KIND_OF = X.KINDS


@query(f"""WITH {_REACHED_SQL}, ro AS (SELECT 'o' || o_orderkey AS node, 0 AS level FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' UNION SELECT dst, level + 1 FROM ro JOIN ref_edges ON src = node WHERE level < 12),
k AS (SELECT node, ({list(_KIND_OF)})[substr(node, 2)::BIGINT % 7 + 1] AS k, node IN (SELECT node FROM ro) AS o FROM rl)
SELECT bool_or(k = 'JavaScript' AND o) AS open_action_javascript, {', '.join(f"bool_or(k = '{k}') AS {n}" for k, n in graph.ACTIONS.items())}, count(*) AS actions FROM k""", using=("ref_edges",))
def graph_action_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of the actions that the roots reach; those of open orders run when the document is opened."""
    edges = X.ref_nodes_edges(spark, sf_dir)
    roots = _roots(spark, sf_dir)
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).union(roots.select("node")).distinct()
    kind = F.get(F.array(*map(F.lit, _KIND_OF)), (F.substring("node", 2, 20).cast("long") % 7).cast("int"))
    return graph.action_scan(nodes.withColumn("kind", kind), edges, roots)


_DOC_LEVELS = 9
_DOC_SQL = "d0 AS MATERIALIZED (SELECT doc_id, node, row_number() OVER (PARTITION BY doc_id ORDER BY node) AS place FROM doc_nodes WHERE node IN (1, 5)), " + ", ".join(
    f"d{k} AS MATERIALIZED (SELECT e.doc_id, dst AS node, row_number() OVER (PARTITION BY e.doc_id ORDER BY min(place), dst) AS place FROM d{k - 1} p JOIN doc_edges e ON p.doc_id = e.doc_id AND p.node = src SEMI JOIN doc_nodes n ON n.doc_id = e.doc_id AND n.node = dst "
    f"ANTI JOIN ({' UNION ALL '.join(f'SELECT doc_id, node FROM d{i}' for i in range(k))}) s ON s.doc_id = e.doc_id AND s.node = dst GROUP BY e.doc_id, dst)"
    for k in range(1, _DOC_LEVELS)
)


@query(f"WITH {_DOC_SQL}, dl AS ({' UNION ALL '.join(f'SELECT doc_id, node, {k} AS level, place FROM d{k}' for k in range(_DOC_LEVELS))}) SELECT doc_id, node, level, place, row_number() OVER (PARTITION BY doc_id ORDER BY level, place) AS number FROM dl", using=("doc_nodes", "doc_edges"))
def graph_document_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document's roots reach, numbered anew document by document; missing nodes are left out."""
    nodes, edges, roots = X.doc_graph(spark, sf_dir)
    return graph.discovered(edges, roots, ["doc_id"], nodes)


_FACTS_SQL = """fc AS (SELECT doc_id, node, open, 0 AS level FROM doc_nodes WHERE node IN (1, 5) UNION SELECT fc.doc_id, dst, fc.open, level + 1 FROM fc JOIN doc_edges e ON e.doc_id = fc.doc_id AND src = fc.node SEMI JOIN doc_nodes n ON n.doc_id = e.doc_id AND n.node = dst WHERE level < 10),
fa AS (SELECT doc_id, node, kind, bool_or(fc.open) AS open FROM fc JOIN doc_nodes USING (doc_id, node) GROUP BY ALL)"""


@query(f"""WITH {_FACTS_SQL} SELECT doc_id, coalesce(bool_or(kind = 'JavaScript' AND open), false) AS open_action_javascript, {', '.join(f"bool_or(kind = '{k}') AS {n}" for k, n in graph.ACTIONS.items())}, count(*) AS actions FROM fa GROUP BY doc_id""", using=("doc_nodes", "doc_edges"))
def graph_document_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of the actions of each document."""
    nodes, edges, roots = X.doc_graph(spark, sf_dir)
    return graph.action_scan(nodes, edges, roots, keys=["doc_id"])


_MET = {n: f"bool_or(kind = '{k}')" for k, n in graph.ACTIONS.items()} | {"open_action_javascript": "bool_or(kind = 'JavaScript' AND open)"}


@query(f"""WITH {_FACTS_SQL}, dc AS (SELECT c_custkey AS doc_id, c_custkey % 5 = 0 AS locked FROM customer)
SELECT doc_id, locked, {', '.join(f"CASE WHEN NOT locked THEN {'true' if f == 'complete' else f'coalesce({_MET[f]}, false)' if f in _MET else 'false'} END AS {f}" for f in report.FEATURES)} FROM dc LEFT JOIN fa USING (doc_id) GROUP BY doc_id, locked""", using=("doc_nodes", "doc_edges"))
def graph_document_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of documents from the actions that their graphs reach."""
    nodes, edges, roots = X.doc_graph(spark, sf_dir)
    facts = graph.action_facts(nodes, edges, roots, ["doc_id"]).select("doc_id", F.lit("action").alias("place"), F.col("kind").alias("what"), "open")
    documents = X.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), (F.col("c_custkey") % 5 == 0).alias("locked"))
    return report.features(facts, documents)


@query("""WITH RECURSIVE rf AS (SELECT o_orderkey AS src, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey * 3 % 1000 WHEN o_orderkey % 3 = 1 THEN o_orderkey // 2 ELSE NULL END AS dst FROM orders),
ch AS (SELECT src, dst, 1 AS n FROM rf WHERE dst IS NOT NULL UNION ALL SELECT ch.src, rf.dst, n + 1 FROM ch JOIN rf ON ch.dst = rf.src WHERE rf.dst IS NOT NULL AND n < 33)
SELECT a.src, b.dst AS value FROM (SELECT DISTINCT src FROM ch) a LEFT JOIN (SELECT src, dst FROM ch WHERE NOT EXISTS (SELECT 1 FROM rf WHERE rf.src = ch.dst AND rf.dst IS NOT NULL)) b ON a.src = b.src""")
def graph_dereferenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    refs = X.table(spark, sf_dir, "orders").select(k.alias("src"), F.when(k % 3 == 0, F.col("o_custkey") * 3 % 1000).when(k % 3 == 1, F.floor(k / 2)).alias("dst"))
    return graph.dereferenced(refs)


@query("SELECT pid, seq, line FROM log_lines QUALIFY row_number() OVER (PARTITION BY pid ORDER BY seq DESC) <= 20", using=("log_lines",))
def stream_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.tail(X.log_lines(spark, sf_dir), 20).select("pid", "seq", "line")


_BUDGET_SQL = """bg AS (SELECT pid, seq, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY pid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 500 AS forwarded FROM log_lines)
SELECT pid, seq, forwarded, NOT forwarded AND coalesce(lag(forwarded) OVER (PARTITION BY pid ORDER BY seq), true) AS cut FROM bg"""


@query(f"WITH {_BUDGET_SQL}", using=("log_lines",))
def stream_byte_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.budgeted(X.log_lines(spark, sf_dir), 500)


_STREAK_SQL = """g AS (SELECT pid, seq, kind, sum((kind = 'purchase')::INT) OVER (PARTITION BY pid ORDER BY seq) AS g FROM log_lines), s AS (SELECT pid, seq, row_number() OVER (PARTITION BY pid, g ORDER BY seq)::INT AS streak FROM g WHERE kind = 'error') SELECT pid, seq, streak, streak <= 3 AS restart FROM s"""


@query(f"WITH {_STREAK_SQL}", using=("log_lines",))
def stream_crash_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.crash_streaks(X.log_lines(spark, sf_dir))


@query("""WITH l AS (SELECT user_id AS session, max(event_id) // 1000 AS request FROM events WHERE event_type = 'click' GROUP BY user_id) SELECT session, request, event_id FROM (SELECT user_id AS session, event_id // 1000 AS request, event_id FROM events WHERE event_type = 'view') SEMI JOIN l USING (session, request)""")
def stream_latest_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = X.table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.floor(F.col("event_id") / 1000).alias("request"), "event_id", "event_type")
    return logs.latest_requests(e.where("event_type = 'click'"), e.where("event_type = 'view'")).select("session", "request", "event_id")


@query(f"""WITH {_hits_sql('(?i)the')}, p AS (SELECT doc_id, page, count(*) AS hits FROM hits GROUP BY ALL) SELECT doc_id, page, sum(hits) OVER (PARTITION BY doc_id ORDER BY page)::BIGINT AS hits_so_far, page + 1 AS pages_done FROM p""", using=("page_text",))
def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.hits(X.page_text(spark, sf_dir), THE).groupBy("doc_id", "page").agg(F.count("*").alias("hits"))
    return logs.progress(found)


@query("SELECT kind, count(*) AS samples, count(*) FILTER (ms > 50) AS over, max(ms) AS worst FROM log_lines GROUP BY kind", using=("log_lines",))
def report_time_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.over_budget(X.log_lines(spark, sf_dir), 50.0)


def _ran(spark: SparkSession, stream: DataFrame, label: str) -> DataFrame:
    """All that a stream yields from what is there now, from a Parquet sink in the shared folder."""
    out, check = fresh_path(spark, label), fresh_path(spark, f"{label}-checkpoint")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _streamed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = X.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", str(4 << 30)).parquet(f"{sf_dir}/{name}.parquet*")


@query(f"WITH {_hits_sql('(?i)the')} SELECT doc_id, page, first, count, match FROM hits", using=("page_text",))
def streaming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits of search_hits, as documents arrive."""
    pages = _streamed(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "text"))
    return _ran(spark, search.hits(pages, THE).drop("hay"), "streaming-search")


@query(f"WITH {_hits_sql('(?i)the')} SELECT count(*) AS hits, count(DISTINCT (doc_id, page)) AS pages FROM hits", using=("page_text",))
def streaming_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a running search reports batch by batch, added up."""
    pages = _streamed(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "text"))
    counts = progress_of(spark, search.hits(pages, THE, at=True), "streaming-progress")
    return spark.createDataFrame(counts, "batch long, hits long, pages long").agg(F.sum("hits").alias("hits"), F.sum("pages").alias("pages"))


def progress_of(spark: SparkSession, found: DataFrame, label: str) -> list[tuple[int, int, int]]:
    """batch, hits, pages of each batch of a search on a stream, as a listener is told while it runs."""
    seen = logs.SearchProgress()
    spark.streams.addListener(seen)
    try:
        marked = seen.observed(found.withColumn("first_of_page", F.col("at") == 0).drop("at", "hay"))
        query = marked.writeStream.format("parquet").option("path", fresh_path(spark, label)).option("checkpointLocation", fresh_path(spark, f"{label}-checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination()
        for _ in range(600):  # events come after the fact
            if str(query.id) in seen.done:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(seen)
    return seen.counts


@query(f"WITH {_hits_sql('(?i)the')} SELECT doc_id, page, first FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY page, first) <= 20", using=("page_text",))
def streaming_capped_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _streamed(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "text"))
    return logs.first_hits(_ran(spark, logs.stream_capped(search.hits(pages, THE), 20), "streaming-capped"), 20)


def _lines(events: DataFrame) -> DataFrame:
    line = F.concat_ws(" ", F.col("event_id").cast("string"), F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "click", "DEBUG").otherwise(F.col("event_type")), F.col("props"))
    return events.select(F.col("user_id").alias("pid"), F.col("event_id").alias("seq"), line.alias("line"), F.col("event_type").alias("kind"))


@query(f"WITH {_STREAK_SQL}", using=("log_lines",))
def streaming_crash_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ran(spark, logs.stream_streaks(_lines(_streamed(spark, sf_dir, "events"))), "streaming-streaks")


@query(f"WITH {_BUDGET_SQL}", using=("log_lines",))
def streaming_byte_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ran(spark, logs.stream_budget(_lines(_streamed(spark, sf_dir, "events")), 500), "streaming-budget")


@query("SELECT pid, seq, line FROM log_lines QUALIFY row_number() OVER (PARTITION BY pid ORDER BY seq DESC) <= 20", using=("log_lines",))
def streaming_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.newest_tail(_ran(spark, logs.stream_tail(_lines(_streamed(spark, sf_dir, "events")), 20), "streaming-tail"))


@query("""WITH l AS (SELECT user_id AS session, max(event_id) // 1000 AS request FROM events WHERE event_type = 'click' GROUP BY user_id) SELECT session, request, event_id FROM (SELECT user_id AS session, event_id // 1000 AS request, event_id FROM events WHERE event_type = 'view') SEMI JOIN l USING (session, request)""")
def streaming_latest_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _streamed(spark, sf_dir, "events").where("event_type IN ('click', 'view')")
    e = e.select(F.col("user_id").alias("session"), F.floor(F.col("event_id") / 1000).alias("request"), "event_id", (F.col("event_type") == "click").alias("asks"))
    return logs.latest_answers(_ran(spark, logs.stream_latest(e), "streaming-latest"))


@query("""SELECT id, text_len, version, linearized FROM (SELECT doc_id AS id, length(text) AS text_len, CASE WHEN doc_id % 4 <> 3 THEN '1.' || (doc_id % 8) END AS version, doc_id % 2 = 0 AS linearized FROM documents)""")
def source_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of raw files made of the documents."""
    from folioscan.sources.files import headers

    k = F.col("doc_id")
    head = F.concat(F.when(k % 4 != 3, F.concat(F.lit("%PDF-1."), k % 8)).otherwise(F.lit("%XYZ-1.0")), F.lit("\n1 0 obj "), F.when(k % 2 == 0, "/Linearized 1 ").otherwise("/Type "), F.lit("endobj\n/Linearized "), "text")
    d = X.table(spark, sf_dir, "documents")
    return headers(d.select(k.alias("id"), F.encode(head, "UTF-8").alias("content"))).join(d.select(k.alias("id"), F.length("text").alias("text_len")), "id")


_JSON_CAP = 700


@query(f"""WITH d AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS l, regexp_extract_all(text, '[A-Z][a-z]+') AS w FROM documents),
k AS (SELECT *, unnest(range(0, len(l) + len(w) + 1)) AS k FROM d), j AS (SELECT *, least(len(l), len(w)) AS v, greatest(k - abs(len(l) - len(w)), 0) AS b FROM k),
m AS (SELECT *, CASE WHEN len(l) > v THEN greatest(len(l) - k, v) ELSE v END - (b + 1) // 2 AS x, CASE WHEN len(w) > v THEN greatest(len(w) - k, v) ELSE v END - b // 2 AS y FROM j),
z AS (SELECT *, strlen('{{"doc_id":' || doc_id || ',"lines":{{"items":[],"total":' || len(l) || ',"truncated":' || (x < len(l)) || '}},"names":{{"items":[],"total":' || len(w) || ',"truncated":' || (y < len(w)) || '}}}}')
 + coalesce(list_sum(list_transform(l[1:x], lambda i: strlen(to_json(i)::VARCHAR) + 1)) - 1, 0) + coalesce(list_sum(list_transform(w[1:y], lambda i: strlen(to_json(i)::VARCHAR) + 1)) - 1, 0) AS n FROM m)
SELECT doc_id, len(l)::BIGINT AS total, x::INT AS kept_lines, y::INT AS kept_names, x < len(l) AS lines_truncated, n::INT AS n_bytes, md5(array_to_string(l[1:x], chr(10)) || array_to_string(w[1:y], chr(10))) AS items_md5
FROM z WHERE n <= {_JSON_CAP} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k) = 1""")
def source_json_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports with two lists in at most 700 bytes, read again: totals stay though the lists are cut."""
    from folioscan.sources.files import capped_json

    d = X.table(spark, sf_dir, "documents").select("doc_id", F.filter(F.split("text", "\n"), lambda x: x != "").alias("lines"), F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), 0).alias("names"))
    made = d.select("doc_id", capped_json(["doc_id"], {"lines": F.col("lines"), "names": F.col("names")}, _JSON_CAP).alias("json")).where("json is not null")
    part = "struct<items:array<string>,total:bigint,truncated:boolean>"
    read = made.withColumn("j", F.from_json("json", f"doc_id bigint, lines {part}, names {part}"))
    items = F.concat(F.array_join("j.lines.items", "\n"), F.array_join("j.names.items", "\n"))
    return read.select(
        "doc_id", F.col("j.lines.total").alias("total"), F.size("j.lines.items").alias("kept_lines"), F.size("j.names.items").alias("kept_names"), F.col("j.lines.truncated").alias("lines_truncated"), F.octet_length("json").alias("n_bytes"), F.md5(items).alias("items_md5")
    )


@query("""SELECT os, arch, 1 AS runs, name, max(value) AS value, 'ms' AS unit, higher_is_better, tracked, floor FROM metrics GROUP BY report, side, os, arch, name, higher_is_better, tracked, floor""", using=("metrics",))
def source_metric_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports written as metric files and read again."""
    from folioscan.sources.files import read_metrics, write_metrics

    path = fresh_path(spark, "metric-files")
    rows = X.metrics(spark, sf_dir).withColumn("report", F.concat_ws("/", "report", "side"))
    write_metrics(rows.groupBy("report", "os", "arch", "name", "higher_is_better", "tracked", "floor").agg(F.max("value").alias("value")).withColumn("unit", F.lit("ms")), path)
    return read_metrics(spark, path, lines=True)


@query("SELECT doc_id, string_agg(text, chr(12) ORDER BY page) AS text FROM page_text GROUP BY doc_id", using=("page_text",))
def source_written_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages of documents, written and read again."""
    from folioscan.operators.select import selected_text
    from folioscan.sources.files import write_text

    path, pages = fresh_path(spark, "written-text"), X.page_text(spark, sf_dir)
    write_text(selected_text(pages, pages.select("doc_id", "page", F.col("page").alias("ord"))), path)
    return spark.read.schema("doc_id long, text string").parquet(path)
