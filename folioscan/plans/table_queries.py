"""Queries of selection, lookups, revisions, reports and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.operators import lookup, report, revisions, select
from folioscan.plans.book import Book
from folioscan.sources import fixtures as X

BOOK = Book()
query = BOOK.query

SPECS = ("1-5,8,10-", "-3", "7", "2,2,1", "0", "5-3", "1,,2", "-", "99999", "", "1 2", " 1 - 3 , 2 ", "99999-0", "0-x", "1-2-3", "  ", ",", "2 -")


def _specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of the specs for each document, over its number of pages."""
    pages = X.page_text(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("pages"))
    return pages.select(F.col("doc_id").alias("spec_id"), "pages", F.get(F.array(*map(F.lit, SPECS)), (F.col("doc_id") % len(SPECS)).cast("int")).alias("spec"))


_WRONG = "CASE WHEN NOT regexp_full_match({x}, '[0-9]+') THEN 'Invalid' WHEN {x}::BIGINT = 0 THEN 'Zero' WHEN {x}::BIGINT > pages THEN 'OutOfRange' END"
_SPECS_SQL = f"""specs AS (SELECT doc_id AS spec_id, count(*) AS pages, ({list(SPECS)})[(doc_id % {len(SPECS)} + 1)::INT] AS spec FROM page_text GROUP BY doc_id),
pc AS (SELECT spec_id, pages, spec, (i - 1)::INT AS "at", trim(p[i]) AS piece FROM (SELECT spec_id, pages, spec, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT *, string_split(spec, ',') AS p FROM specs))),
pd AS (SELECT *, contains(piece, '-') AS has, trim(string_split(piece, '-')[1]) AS a, CASE WHEN contains(piece, '-') THEN trim(substr(piece, strpos(piece, '-') + 1)) ELSE '' END AS b FROM pc),
pa AS (SELECT *, {_WRONG.format(x="a")} AS wrong_a, {_WRONG.format(x="b")} AS wrong_b, CASE WHEN has AND a = '' THEN 1 ELSE try_cast(a AS BIGINT) END AS first,
  CASE WHEN NOT has THEN try_cast(a AS BIGINT) WHEN b = '' THEN pages ELSE try_cast(b AS BIGINT) END AS last FROM pd),
pp AS (SELECT *, CASE WHEN trim(spec) = '' THEN 'Empty' WHEN piece = '' THEN 'Invalid' WHEN NOT has THEN wrong_a WHEN contains(b, '-') THEN 'Invalid' WHEN a <> '' AND wrong_a IS NOT NULL THEN wrong_a
  WHEN b <> '' AND wrong_b IS NOT NULL THEN wrong_b WHEN a = '' AND b = '' THEN 'Invalid' WHEN first > last THEN 'Backwards' END AS problem FROM pa),
sp AS (SELECT spec_id, arg_min(problem, "at") FILTER (problem IS NOT NULL) AS problem FROM pp GROUP BY spec_id)"""


@query(f"WITH {_SPECS_SQL} SELECT spec_id, problem FROM sp", using=("page_text",))
def select_spec_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.spec_problems(select.spec_pieces(_specs(spark, sf_dir)))


_SPEC_PAGES_SQL = f"""{_SPECS_SQL}, sg AS (SELECT spec_id, n, min("at") AS "at" FROM (SELECT spec_id, "at", unnest(range(first, last + 1)) AS n FROM pp WHERE spec_id IN (SELECT spec_id FROM sp WHERE problem IS NULL)) GROUP BY spec_id, n),
sq AS (SELECT spec_id, (n - 1)::INT AS page, (row_number() OVER (PARTITION BY spec_id ORDER BY "at", n) - 1)::INT AS ord FROM sg)"""


@query(f"WITH {_SPEC_PAGES_SQL} SELECT * FROM sq", using=("page_text",))
def select_spec_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.spec_pages(select.spec_pieces(_specs(spark, sf_dir)))


@query(f"WITH {_SPEC_PAGES_SQL} SELECT doc_id, string_agg(text, chr(12) ORDER BY ord) AS text FROM page_text JOIN sq ON doc_id = spec_id AND page_text.page = sq.page GROUP BY doc_id", using=("page_text",))
def select_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = select.spec_pages(select.spec_pieces(_specs(spark, sf_dir))).withColumnRenamed("spec_id", "doc_id")
    return select.selected_text(X.page_text(spark, sf_dir), chosen)


_LABEL_SQL = """lr AS (SELECT *, lead(first_page, 1, 1000000000) OVER (PARTITION BY doc_id ORDER BY first_page) AS next_page FROM label_ranges),
lb AS (SELECT p.doc_id, p.page, CASE WHEN first_page IS NULL THEN (page + 1)::VARCHAR ELSE prefix || CASE style WHEN 'D' THEN n::VARCHAR WHEN 'A' THEN CASE WHEN (n - 1) // 26 < 8 THEN repeat(chr((65 + (n - 1) % 26)::INT), ((n - 1) // 26 + 1)::INT) ELSE n::VARCHAR END
ELSE (['i', 'ii', 'iii'])[n::INT] END END AS label FROM (SELECT p.doc_id, p.page, r.*, r.start + p.page - r.first_page AS n FROM page_text p LEFT JOIN lr r ON p.doc_id = r.doc_id AND p.page >= r.first_page AND p.page < r.next_page) p)"""


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.page_labels(X.page_text(spark, sf_dir), lookup.clean_ranges(X.label_ranges(spark, sf_dir)))


@query(f"WITH {_LABEL_SQL} SELECT * FROM lb", using=("page_text", "label_ranges"))
def lookup_page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir)


@query("""SELECT doc_id, first_page, CASE WHEN style IN ('D', 'r', 'A') AND first_page <> 3 THEN style END AS style, CASE WHEN length(prefix) > 64 THEN substr(prefix, 1, 64) || '…' ELSE prefix END AS prefix, 1::BIGINT AS start
FROM (SELECT doc_id, first_page, style, repeat('p', (doc_id % 100)::INT) || prefix AS prefix FROM label_ranges)""", using=("label_ranges",))
def lookup_clean_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges doubled (the later one loses), with starts below 1, unknown styles and long prefixes."""
    r = X.label_ranges(spark, sf_dir).withColumn("prefix", F.concat(F.repeat(F.lit("p"), (F.col("doc_id") % 100).cast("int")), "prefix"))
    r = r.withColumns({"style": F.when(F.col("first_page") == 3, "Q").otherwise(F.col("style")), "start": F.lit(-4).cast("long")})
    r = r.withColumn("ord", F.lit(1)).union(r.withColumn("start", F.lit(9).cast("long")).withColumn("ord", F.lit(2)))
    return lookup.clean_ranges(r, "ord")


@query(f"""WITH {_LABEL_SQL}, wanted AS (SELECT doc_id, unnest(['ii', 'II', '2', 'a-A', 'zz']) AS label FROM documents),
ex AS (SELECT doc_id, label, min(page) AS page FROM lb GROUP BY ALL), ci AS (SELECT doc_id, lower(label) AS l, min(page) AS page FROM lb GROUP BY ALL)
SELECT w.doc_id, w.label, coalesce(ex.page, ci.page) AS page FROM wanted w LEFT JOIN ex ON w.doc_id = ex.doc_id AND w.label = ex.label LEFT JOIN ci ON w.doc_id = ci.doc_id AND lower(w.label) = ci.l""", using=("page_text", "label_ranges"))
def lookup_find_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = X.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(*map(F.lit, ("ii", "II", "2", "a-A", "zz")))).alias("label"))
    return lookup.find_labels(_labels(spark, sf_dir), wanted)


@query(f"""WITH {_LABEL_SQL}, s AS (SELECT doc_id AS spec_id, doc_id, unnest(['i-2', 'A-A', 'A-A-A-B', '2-i', 'x']) AS piece, unnest([0, 1, 2, 3, 4]) AS "at" FROM documents),
f AS (SELECT doc_id, label, min(page) AS page FROM lb GROUP BY ALL),
t AS (SELECT spec_id, doc_id, "at", 0 AS cut, piece AS a, piece AS b FROM s UNION ALL SELECT spec_id, doc_id, "at", i, substr(piece, 1, i - 1), substr(piece, i + 1) FROM (SELECT *, unnest(range(1, length(piece) + 1)) AS i FROM s) WHERE substr(piece, i, 1) = '-'),
v AS (SELECT spec_id, "at", cut, x.page AS fp, y.page AS tp FROM t JOIN f x ON x.doc_id = t.doc_id AND x.label = t.a JOIN f y ON y.doc_id = t.doc_id AND y.label = t.b QUALIFY row_number() OVER (PARTITION BY spec_id, "at" ORDER BY cut) = 1)
SELECT s.spec_id, s."at"::INT AS "at", fp AS from_page, tp AS to_page, CASE WHEN fp IS NULL THEN 'Unknown' WHEN fp > tp THEN 'Backwards' END AS problem FROM s LEFT JOIN v ON s.spec_id = v.spec_id AND s."at" = v."at" """, using=("page_text", "label_ranges"))
def select_label_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = X.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("spec_id"), "doc_id", F.lit("i-2; A-A,A-A-A-B ,2-i;x").alias("spec"))
    return select.label_ranges_of(specs, _labels(spark, sf_dir))


@query("SELECT doc_id, count(*) AS n, sum(page) AS pages FROM page_text WHERE page % 2 = 1 GROUP BY doc_id", using=("page_text",))
def select_even_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.parity(X.page_text(spark, sf_dir), odd=False).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("page").alias("pages"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY ord) AS rn, count(*) OVER (PARTITION BY doc_id, page) AS n FROM links) SELECT doc_id, page, ord, rn::INT AS rn, n > 5 AS more FROM r WHERE rn BETWEEN 3 AND 5""", using=("links",))
def select_link_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third to fifth link of each page."""
    return select.level(X.links(spark, sf_dir), ["doc_id", "page"], ["ord"], 2, 3).select("doc_id", "page", "ord", "rn", "more")


@query("SELECT doc_id, page, ord FROM links WHERE subtype = 'Link' AND (flags & 34) = 0", using=("links",))
def select_visible_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.visible_links(X.links(spark, sf_dir)).select("doc_id", "page", "ord")


_SIZE_SQL = """sz AS (SELECT doc_id, page, (CASE WHEN rotate % 180 = 90 THEN h ELSE w END * 100)::BIGINT AS width, (CASE WHEN rotate % 180 = 90 THEN w ELSE h END * 100)::BIGINT AS height FROM
(SELECT *, abs(b[3] - b[1]) AS w, abs(b[4] - b[2]) AS h FROM (SELECT *, coalesce(crop_box, media_box) AS b FROM page_boxes)))"""


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = select.page_size(F.col("media_box"), F.col("crop_box"), F.col("rotate"))
    return X.page_boxes(spark, sf_dir).select("doc_id", "page", w.alias("width"), h.alias("height"))


@query(f"WITH {_SIZE_SQL} SELECT * FROM sz", using=("page_boxes",))
def select_page_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sizes(spark, sf_dir)


@query("""WITH b AS (SELECT doc_id, page, rotate, [least(b[1], b[3]), least(b[2], b[4]), greatest(b[1], b[3]), greatest(b[2], b[4])] AS b FROM (SELECT *, coalesce(crop_box, media_box) AS b FROM page_boxes))
SELECT doc_id, page, CASE rotate WHEN 90 THEN 30.0 - b[2] WHEN 180 THEN b[3] - 40.0 WHEN 270 THEN b[4] - 60.0 ELSE 20.0 - b[1] END AS x0, CASE rotate WHEN 90 THEN 20.0 - b[1] WHEN 180 THEN 30.0 - b[2] WHEN 270 THEN b[3] - 40.0 ELSE b[4] - 60.0 END AS y0,
CASE rotate WHEN 90 THEN 60.0 - b[2] WHEN 180 THEN b[3] - 20.0 WHEN 270 THEN b[4] - 30.0 ELSE 40.0 - b[1] END AS x1, CASE rotate WHEN 90 THEN 40.0 - b[1] WHEN 180 THEN 60.0 - b[2] WHEN 270 THEN b[3] - 20.0 ELSE b[4] - 30.0 END AS y1 FROM b""", using=("page_boxes",))
def select_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rect = select.rect_on_page([F.lit(v) for v in (20.0, 30.0, 40.0, 60.0)], F.coalesce("crop_box", "media_box"), F.col("rotate"))
    return X.page_boxes(spark, sf_dir).select("doc_id", "page", *(c.alias(n) for c, n in zip(rect, ("x0", "y0", "x1", "y1"), strict=True)))


@query("""SELECT o_orderkey AS mask_id, """ + ", ".join(f"(o_orderkey % 7 = 0 OR ({b}))::BOOLEAN AS {k}" for k, b in {**{k: f"(m >> {n - 1}) & 1 = 1" for k, n in select.PERMISSIONS.items()}, "print_high": "(m >> 2) & 1 = 1 AND (rev < 3 OR (m >> 11) & 1 = 1)"}.items()) + """ FROM (SELECT o_orderkey, (o_totalprice * 100)::BIGINT AS m, 2 + o_orderkey % 3 AS rev FROM orders)""")
def select_permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = X.table(spark, sf_dir, "orders").withColumns({"m": F.round(F.col("o_totalprice") * 100).cast("long"), "rev": 2 + F.col("o_orderkey") % 3})
    return o.select(F.col("o_orderkey").alias("mask_id"), *(c.alias(k) for k, c in select.permissions(F.col("m"), F.col("rev"), F.col("o_orderkey") % 7 == 0).items()))


_URIS = "CASE ord % 9 WHEN 1 THEN '' WHEN 2 THEN 'mailto:' WHEN 3 THEN 'mailto:a@b.example' WHEN 4 THEN 'javascript:x' WHEN 5 THEN 'http:///nohost' WHEN 6 THEN target || ' ' WHEN 7 THEN 'HTTPS://X.example/' ELSE target END"


@query(f"""WITH u AS (SELECT doc_id, page, ord, {_URIS} AS u FROM links), s AS (SELECT *, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1)) AS s FROM u)
SELECT doc_id, page, ord, CASE WHEN u = '' THEN 'empty' WHEN regexp_matches(u, '[\\x00-\\x20\\x7f]') THEN 'control or space' WHEN s = '' THEN 'invalid' WHEN s NOT IN ('http', 'https', 'mailto') THEN 'scheme' WHEN s = 'mailto' AND u = 'mailto:' THEN 'no address'
WHEN s <> 'mailto' AND regexp_extract(u, '^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:]*)', 1) = '' THEN 'no host' END AS problem FROM s""", using=("links",))
def select_uri_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.links(spark, sf_dir).select("doc_id", "page", "ord", select.uri_problem(F.expr(_URIS)).alias("problem"))


_KIND = "CASE WHEN ord % 5 = 0 THEN 'URI' WHEN ord % 5 = 1 THEN 'GoTo' WHEN ord % 5 = 2 THEN 'Named' ELSE 'Kind' || ord END"
_TARGET = "CASE WHEN ord % 5 = 2 AND page % 2 = 0 THEN 'NextPage' WHEN ord % 10 = 5 THEN repeat(target, 600) ELSE target END"


@query(f"""SELECT doc_id, page, ord, CASE WHEN k = 'URI' THEN CASE WHEN strlen(t) > 2048 THEN 'Inert:URI' ELSE 'Uri' END WHEN k = 'GoTo' THEN 'GoTo' WHEN k = 'Named' THEN CASE WHEN t = 'NextPage' THEN 'Named' ELSE 'Inert:Named:' || substr(t, 1, 64) END
ELSE 'Inert:' || substr(k, 1, 64) END AS action FROM (SELECT *, {_KIND} AS k, {_TARGET} AS t FROM links)""", using=("links",))
def select_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.links(spark, sf_dir).select("doc_id", "page", "ord", select.action_of(F.expr(_KIND), F.expr(_TARGET)).alias("action"))


@query("SELECT id, CASE WHEN outcome = 'Rejected' THEN CASE WHEN message = '' THEN 'unexplained' WHEN contains(message, 'password') THEN 'password' ELSE 'malformed' END END AS refusal FROM outcomes", using=("outcomes",))
def select_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.outcomes(spark, sf_dir).select("id", F.when(F.col("outcome") == "Rejected", select.refusal_of(F.col("message"))).alias("refusal"))


@query("""SELECT p.doc_id, p.page, arg_max(o.id, struct_pack(a := o.page, b := o.ord)) AS section FROM page_text p LEFT JOIN outline o ON p.doc_id = o.doc_id AND o.page <= p.page GROUP BY p.doc_id, p.page""", using=("page_text", "outline"))
def lookup_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.sections(X.page_text(spark, sf_dir), X.outline(spark, sf_dir))


_KINDS = {"d": "CASE n_nationkey % 3 WHEN 0 THEN 'ref' WHEN 1 THEN 'index' ELSE 'name' END", "t": "CASE c_custkey % 3 WHEN 0 THEN 'index' WHEN 1 THEN 'ref' ELSE 'name' END"}
_DEST_SQL = f"""dd AS (SELECT 'K' || n_nationkey AS key, n_nationkey::BIGINT AS value, {_KINDS['d']} AS value_kind FROM nation), dt AS (SELECT 'K' || (c_custkey + 10) AS key, c_custkey % 40 AS value, {_KINDS['t']} AS value_kind FROM customer),
w AS (SELECT 'K' || o_custkey AS key, o_orderkey % 2 = 0 AS is_name FROM orders),
fd AS (SELECT w.key, is_name, CASE WHEN is_name THEN coalesce(struct_pack(k := dd.value_kind, v := dd.value), NULL) END AS x, dd.value_kind AS dk, dd.value AS dv, dt.value_kind AS tk, dt.value AS tv FROM w LEFT JOIN dd ON w.key = dd.key LEFT JOIN dt ON w.key = dt.key),
fs AS (SELECT key, is_name, CASE WHEN is_name THEN CASE WHEN dk IS NOT NULL THEN dk ELSE tk END ELSE CASE WHEN tk IS NOT NULL THEN tk ELSE dk END END AS k, CASE WHEN is_name THEN CASE WHEN dk IS NOT NULL THEN dv ELSE tv END ELSE CASE WHEN tk IS NOT NULL THEN tv ELSE dv END END AS v FROM fd)"""


def _destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, c, o = (X.table(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    dests = n.select(F.concat(F.lit("K"), "n_nationkey").alias("key"), F.col("n_nationkey").cast("long").alias("value"), F.expr(_KINDS["d"]).alias("value_kind"))
    tree = c.select(F.concat(F.lit("K"), F.col("c_custkey") + 10).alias("key"), (F.col("c_custkey") % 40).alias("value"), F.expr(_KINDS["t"]).alias("value_kind"))
    return lookup.named_destinations(o.select(F.concat(F.lit("K"), "o_custkey").alias("key"), (F.col("o_orderkey") % 2 == 0).alias("is_name")), dests, tree)


@query(f"WITH {_DEST_SQL} SELECT key, is_name, CASE WHEN k <> 'name' THEN v END AS value, CASE WHEN k <> 'name' THEN k END AS value_kind FROM fs")
def lookup_named_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _destinations(spark, sf_dir)


@query(f"WITH {_DEST_SQL} SELECT key, is_name, CASE WHEN k = 'ref' AND v < (SELECT count(*) FROM nation) THEN v + 100 WHEN k = 'index' AND v < (SELECT count(*) FROM nation) THEN v END AS page FROM fs")
def lookup_destination_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = X.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("num"), (F.col("n_nationkey") + 100).cast("long").alias("page"))
    return lookup.destination_pages(_destinations(spark, sf_dir), objects)


@query("""WITH m AS (SELECT id, any_value(url) AS url, any_value(sha256) AS sha256, any_value(license) AS license FROM manifest GROUP BY id HAVING count(*) = 1),
s AS (SELECT CASE WHEN doc_id % 7 = 0 THEN 'stray-' || doc_id ELSE id END AS id, url, CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE sha256 END AS sha256, CASE WHEN doc_id % 11 = 1 THEN 'CC-BY-SA' ELSE license END AS license, password FROM (SELECT *, right(url, 1) AS e, coalesce(try_cast(regexp_extract(id, '[0-9]+$') AS BIGINT), 0) AS doc_id FROM manifest))
SELECT id, problem FROM (SELECT s.id, unnest(list_filter([CASE WHEN m.id IS NULL THEN 'stray' END, CASE WHEN m.id IS NOT NULL AND (m.url, m.sha256, m.license) IS DISTINCT FROM (s.url, s.sha256, s.license) THEN 'changed' END, CASE WHEN contains(s.license, '-SA') THEN 'share-alike' END, CASE WHEN s.password IS NOT NULL THEN 'password' END], lambda x: x IS NOT NULL)) AS problem FROM s LEFT JOIN m ON s.id = m.id)""", using=("manifest",))
def lookup_subset_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = X.manifest(spark, sf_dir)
    main = m.groupBy("id").agg(F.first("url").alias("url"), F.first("sha256").alias("sha256"), F.first("license").alias("license"), F.count("*").alias("n")).where("n = 1")
    k = F.coalesce(F.expr("try_cast(regexp_extract(id, '[0-9]+$', 0) as bigint)"), F.lit(0))
    subset = m.select(F.when(k % 7 == 0, F.concat(F.lit("stray-"), k)).otherwise(F.col("id")).alias("id"), "url", F.when(k % 5 == 0, "x").otherwise(F.col("sha256")).alias("sha256"), F.when(k % 11 == 1, "CC-BY-SA").otherwise(F.col("license")).alias("license"), "password")
    return lookup.subset_problems(subset, main)


@query("""WITH a AS (SELECT id, len(repairs) > 0 AS r FROM outcomes WHERE length(id) % 7 <> 3 OR found_repairs), b AS (SELECT id, found_repairs AS r FROM outcomes WHERE outcome <> 'Crashed')
SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'right only' WHEN b.id IS NULL THEN 'left only' ELSE 'differs' END AS problem FROM a FULL OUTER JOIN b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.r IS DISTINCT FROM b.r""", using=("outcomes",))
def lookup_repair_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = X.outcomes(spark, sf_dir)
    said = o.where((F.length("id") % 7 != 3) | F.col("found_repairs")).select("id", (F.size("repairs") > 0).alias("r"))
    return lookup.mismatches(said, o.where("outcome <> 'Crashed'").select("id", F.col("found_repairs").alias("r")), "id", ["r"])


@query("SELECT user_id AS session, event_id AS request FROM events e WHERE event_type = 'click' AND NOT EXISTS (SELECT 1 FROM events v WHERE v.event_type = 'view' AND v.user_id = e.user_id AND v.event_id % 50 = e.event_id % 50)")
def lookup_lost_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = X.table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("request"), (F.col("event_id") % 50).alias("slot"), "event_type")
    return lookup.lost_requests(e.where("event_type = 'click'"), e.where("event_type = 'view'"), ["session", "slot"]).select("session", "request")


@query("""WITH f AS (SELECT id, list_concat(CASE WHEN ms % 3 <> ms % 2 THEN ['page-count-mismatch'] ELSE [] END, list_concat(CASE WHEN message = 'password required' THEN ['cos-locked'] ELSE [] END, CASE WHEN len(repairs) > 0 AND NOT found_repairs THEN ['repairs-unseen'] ELSE [] END)) AS c FROM outcomes) SELECT id, unnest(c) AS code FROM f""", using=("outcomes",))
def lookup_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = {"page-count-mismatch": F.col("ms") % 3 != F.col("ms") % 2, "cos-locked": F.col("message") == "password required", "repairs-unseen": (F.size("repairs") > 0) & ~F.col("found_repairs")}
    return lookup.findings(X.outcomes(spark, sf_dir), checks)


_CROSS_SQL = """cw AS (SELECT doc_id AS id, page, length(text) % 17 <> 3 AS ok FROM page_text),
cd AS (SELECT id, count(*) - (id % 3 = 0)::INT AS pages, CASE WHEN id % 23 = 0 THEN 'cos-unreadable' WHEN id % 19 = 0 THEN 'cos-unsettled' WHEN id % 17 = 0 AND id % 2 = 1 THEN 'cos-locked' END AS ended FROM cw GROUP BY id),
cm AS (SELECT * FROM (SELECT *, coalesce(sum(ok::INT) OVER (PARTITION BY id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM cw JOIN cd USING (id)) WHERE ended IS NULL AND before <= pages),
ct AS (SELECT id, any_value(pages) AS pages, count(*) FILTER (ok) AS walked, count(*) FILTER (NOT ok) AS bad FROM cm GROUP BY id)"""


@query(f"""WITH {_CROSS_SQL} SELECT id, ended AS code, 1::BIGINT AS times FROM cd WHERE ended IS NOT NULL UNION ALL SELECT id, 'cos-page-unreadable', bad FROM ct WHERE bad > 0
UNION ALL SELECT cd.id, 'page-count-mismatch', 1 FROM cd LEFT JOIN ct USING (id) WHERE ended IS NULL AND coalesce(walked, 0) <> cd.pages UNION ALL SELECT id, 'xref-rebuilt', 1 FROM cd WHERE ended IS NULL AND id % 4 = 0""", using=("page_text",))
def lookup_cross_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as the pages that a second reader meets, against the count of a first one."""
    pages = X.page_text(spark, sf_dir).select(F.col("doc_id").alias("id"), "page", (F.length("text") % 17 != 3).alias("ok"))
    k = F.col("id")
    documents = pages.groupBy("id").agg((F.count("*") - (F.first("id") % 3 == 0).cast("int")).alias("pages"))
    state = F.when(k % 23 == 0, "unreadable").when(k % 19 == 0, "unsettled").when(k % 17 == 0, "locked")
    return lookup.cross_check(documents, documents.select("id", state.alias("state"), (k % 2 == 0).alias("unlocked")), pages, documents.where("id % 4 = 0").select("id", F.lit("xref-rebuilt").alias("code")))


@query("""SELECT id, CASE WHEN outcome = 'PasswordRequired' AND NOT bad THEN 'needs a password' WHEN outcome IN ('Crashed', 'Hung') THEN outcome END AS problem
FROM (SELECT id, CASE WHEN message = 'password required' AND outcome = 'Rejected' THEN 'PasswordRequired' ELSE outcome END AS outcome, ms % 2 = 0 AS bad FROM outcomes)""", using=("outcomes",))
def select_outcome_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.when((F.col("message") == "password required") & (F.col("outcome") == "Rejected"), "PasswordRequired").otherwise(F.col("outcome"))
    return X.outcomes(spark, sf_dir).select("id", select.outcome_problem(outcome, F.col("ms") % 2 == 0).alias("problem"))


@query("""SELECT event_id, purchase FROM (SELECT event_id, event_type, max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS purchase FROM events) WHERE event_type <> 'purchase'""")
def lookup_last_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last purchase of anyone before each other event: one group of all rows, spread over ranges."""
    e = X.table(spark, sf_dir, "events").select("event_id", "event_type")
    bought = e.where("event_type = 'purchase'").select(F.col("event_id").alias("purchase"))
    return lookup.as_of(e.where("event_type <> 'purchase'").select("event_id"), bought.withColumn("at", F.col("purchase")), [], "event_id", "at", ["purchase"], spread=True)


_EFFECTIVE = """ef AS (SELECT * FROM rev_entries QUALIFY row_number() OVER (PARTITION BY doc_id, num ORDER BY rev DESC) = 1)"""


@query(f"WITH {_EFFECTIVE} SELECT doc_id, num, rev, origin, kind, generation, position FROM ef", using=("rev_entries",))
def revision_effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisions.effective(X.rev_entries(spark, sf_dir))


@query("""WITH e AS (SELECT doc_id, (rev + 1) // 2 AS rev, origin, num, kind, generation, position FROM rev_entries)
SELECT doc_id, num, rev::INT AS rev, origin, kind, generation, position FROM e QUALIFY row_number() OVER (PARTITION BY doc_id, num ORDER BY rev DESC, CASE WHEN origin = 'table' AND kind <> 'free' THEN 0 WHEN origin = 'stream' AND kind <> 'free' THEN 1 WHEN origin = 'table' THEN 2 ELSE 3 END, position) = 1""", using=("rev_entries",))
def revision_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two entries to a revision: those of its table and of its stream have an order."""
    e = X.rev_entries(spark, sf_dir).withColumn("rev", F.floor((F.col("rev") + 1) / 2).cast("int"))
    return revisions.effective(e)


@query("SELECT doc_id, num, rev, kind FROM rev_entries WHERE rev <= 2 QUALIFY row_number() OVER (PARTITION BY doc_id, num ORDER BY rev DESC) = 1", using=("rev_entries",))
def revision_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisions.effective(X.rev_entries(spark, sf_dir), as_of=2).select("doc_id", "num", "rev", "kind")


@query(f"WITH {_EFFECTIVE} SELECT doc_id, count(*) AS in_use FROM ef WHERE kind <> 'free' GROUP BY doc_id", using=("rev_entries",))
def revision_in_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisions.in_use(X.rev_entries(spark, sf_dir))


_APPLIED = f"""{_EFFECTIVE}, lc AS (SELECT * FROM changes QUALIFY row_number() OVER (PARTITION BY doc_id, num ORDER BY seq DESC) = 1),
jn AS (SELECT coalesce(e.doc_id, c.doc_id) AS doc_id, coalesce(e.num, c.num) AS num, e.kind, e.generation, c.op, c.value FROM ef e FULL OUTER JOIN lc c ON e.doc_id = c.doc_id AND e.num = c.num),
ap AS (SELECT doc_id, num, CASE WHEN op IN ('set', 'add') THEN 'inuse' WHEN op = 'free' AND kind <> 'free' THEN 'free' ELSE kind END AS kind,
CASE WHEN op IN ('set', 'add') THEN CASE WHEN kind = 'compressed' THEN 0 ELSE coalesce(generation, 0) END WHEN op = 'free' AND kind <> 'free' THEN CASE WHEN kind = 'compressed' THEN 1 ELSE generation + 1 END ELSE generation END::INT AS generation, CASE WHEN op IN ('set', 'add') THEN value END AS value FROM jn)"""


@query(f"WITH {_APPLIED} SELECT * FROM ap WHERE kind IS NOT NULL", using=("rev_entries", "changes"))
def revision_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisions.applied(revisions.effective(X.rev_entries(spark, sf_dir)), X.changes(spark, sf_dir))


@query("""WITH t AS (SELECT doc_id, max(num) AS top FROM (SELECT doc_id, num FROM rev_entries UNION ALL SELECT doc_id, num + 3 FROM changes WHERE op = 'set') GROUP BY doc_id)
SELECT a.doc_id, a.seq, (coalesce(top, 0) + row_number() OVER (PARTITION BY a.doc_id ORDER BY a.seq))::INT AS num FROM changes a LEFT JOIN t ON a.doc_id = t.doc_id WHERE op = 'add'""", using=("rev_entries", "changes"))
def revision_allocated(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = X.changes(spark, sf_dir)
    return revisions.allocated(X.rev_entries(spark, sf_dir), c.where("op = 'add'"), c.where("op = 'set'").select("doc_id", (F.col("num") + 3).alias("num")))


@query("""WITH t AS (SELECT doc_id, max(num) AS top FROM (SELECT doc_id, num FROM rev_entries UNION ALL SELECT doc_id, num + 3 FROM changes WHERE op = 'set' UNION ALL SELECT o_orderkey, o_orderkey % 20 - 1 FROM orders) GROUP BY doc_id)
SELECT a.doc_id, a.seq, (greatest(coalesce(top, 0), 0) + row_number() OVER (PARTITION BY a.doc_id ORDER BY a.seq))::BIGINT AS num FROM changes a LEFT JOIN t ON a.doc_id = t.doc_id WHERE op = 'add'""", using=("rev_entries", "changes"))
def revision_allocated_sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New numbers where documents declare a size too."""
    c = X.changes(spark, sf_dir)
    sizes = X.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % 20).alias("size"))
    return revisions.allocated(X.rev_entries(spark, sf_dir), c.where("op = 'add'"), c.where("op = 'set'").select("doc_id", (F.col("num") + 3).alias("num")), sizes)


@query(f"WITH {_APPLIED} SELECT doc_id, num, lead(num, 1, 0) OVER (PARTITION BY doc_id ORDER BY num) AS next_free FROM ap WHERE kind = 'free'", using=("rev_entries", "changes"))
def revision_free_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisions.free_list(revisions.applied(revisions.effective(X.rev_entries(spark, sf_dir)), X.changes(spark, sf_dir)))


_RANGES = """rs AS (SELECT doc_id, rev, (rev - 1) * 100 + CASE WHEN position % 10 = 0 THEN 7 ELSE 0 END AS start, rev * 100 AS "end" FROM rev_entries)"""


@query(f"""WITH {_RANGES} SELECT doc_id, rev, start, "end", start <> lag("end", 1, 0) OVER (PARTITION BY doc_id ORDER BY rev) AS gap FROM rs""", using=("rev_entries",))
def revision_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = X.rev_entries(spark, sf_dir)
    return revisions.revision_ranges(e.select("doc_id", "rev", ((F.col("rev") - 1) * 100 + F.when(F.col("position") % 10 == 0, 7).otherwise(0)).alias("start"), (F.col("rev") * 100).alias("end")))


@query(f"""WITH {_APPLIED} SELECT e.doc_id, e.num FROM ef e LEFT JOIN ap a ON e.doc_id = a.doc_id AND e.num = a.num
WHERE (e.kind, e.generation) IS DISTINCT FROM (a.kind, a.generation) AND NOT EXISTS (SELECT 1 FROM changes c WHERE c.doc_id = e.doc_id AND c.num = e.num AND c.op <> 'set')""", using=("rev_entries", "changes"))
def revision_damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that differ although only freed and added ones were said to change."""
    before, c = revisions.effective(X.rev_entries(spark, sf_dir)), X.changes(spark, sf_dir)
    return revisions.damaged(before, revisions.applied(before, c), c.where("op <> 'set'"))


@query("SELECT doc_id, num, kind, position FROM rev_entries QUALIFY row_number() OVER (PARTITION BY doc_id, num ORDER BY position DESC, rev DESC) = 1", using=("rev_entries",))
def revision_recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisions.recovered(X.rev_entries(spark, sf_dir))


@query("""WITH h AS (SELECT doc_id, rev AS pos, CASE WHEN kind <> 'free' THEN num END AS root, CASE WHEN num % 2 = 0 THEN position END AS info, CASE WHEN num % 3 = 0 THEN position END AS file_id FROM rev_entries),
r AS (SELECT * FROM h WHERE root IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos DESC) = 1),
l AS (SELECT doc_id, arg_max(info, pos) FILTER (info IS NOT NULL) AS info, arg_max(file_id, pos) FILTER (file_id IS NOT NULL) AS file_id FROM h GROUP BY doc_id)
SELECT r.doc_id, r.root, r.pos, coalesce(r.info, l.info) AS info, coalesce(r.file_id, l.file_id) AS file_id FROM r JOIN l USING (doc_id)""", using=("rev_entries",))
def revision_best_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = X.rev_entries(spark, sf_dir)
    h = e.select("doc_id", F.col("rev").alias("pos"), F.when(F.col("kind") != "free", F.col("num")).alias("root"), F.when(F.col("num") % 2 == 0, F.col("position")).alias("info"), F.when(F.col("num") % 3 == 0, F.col("position")).alias("file_id"))
    return revisions.best_header(h, ["info", "file_id"])


FLAGS = report.FEATURES
PRIMES = (11, 31, 37, 41, 43, 47, 2, 59, 61, 67, 3, 71, 5, 7)
_SUMMARY_SQL = "su AS (SELECT doc_id, doc_id % 53 = 0 AS locked, " + ", ".join(f"CASE WHEN doc_id % 53 <> 0 THEN doc_id % {p} {'<>' if f == 'complete' else '='} 0 END AS {f}" for f, p in zip(FLAGS, PRIMES, strict=True)) + " FROM documents)"


def _summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fourteen flags by divisibility; locked documents have nulls."""
    k = F.col("doc_id")
    flags = {f: F.when(k % 53 != 0, (k % p != 0) if f == "complete" else (k % p == 0)) for f, p in zip(FLAGS, PRIMES, strict=True)}
    return X.table(spark, sf_dir, "documents").select("doc_id", (k % 53 == 0).alias("locked"), *(c.alias(f) for f, c in flags.items()))


@query(f"""WITH {_SUMMARY_SQL} SELECT doc_id, concat_ws(',', {', '.join(f"CASE WHEN {f} THEN '{f}' END" for f in report.RISKS)}) AS findings, concat_ws(',', {', '.join(f"CASE WHEN {f} THEN '{f}' END" for f in report.NOTES)}) AS notes,
CASE WHEN {' OR '.join(f'coalesce({f}, false)' for f in report.RISKS)} THEN 3 WHEN locked OR NOT coalesce(complete, false) THEN 1 ELSE 0 END AS code FROM su""")
def report_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.verdicts(_summaries(spark, sf_dir))


@query(f"WITH {_SUMMARY_SQL} " + " UNION ALL ".join(f"SELECT doc_id, {risky} AS risky, '{f}' AS id, '{t}' AS title FROM su WHERE {f}" for risky, rules in (("true", report.RISKS), ("false", report.NOTES)) for f, t in rules.items()))
def report_verdict_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings and notes with their titles."""
    return report.verdict_lines(_summaries(spark, sf_dir))


@query(f"WITH {_SUMMARY_SQL} SELECT count(*) AS documents, count(*) FILTER (NOT locked) AS reported, count(*) FILTER (doc_id % 4 = 0) AS repaired, count(*) FILTER (locked) AS locked, count(*) FILTER (NOT complete) AS incomplete FROM su")
def report_corpus_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.corpus_totals(_summaries(spark, sf_dir).withColumn("repaired", F.col("doc_id") % 4 == 0))


#: What is met in documents, by places; rows of the links table take them in turn.
_FACTS = (("action", "URI"), ("action", "GoTo"), ("annotation", "Link"), ("action", "JavaScript"), ("names", "Dests"), ("catalog", "AA"), ("action", "Launch"), ("names", "JavaScript"), ("form", "Sig"), ("action", "GoToR"), ("catalog", "OCProperties"), ("annotation", "FileAttachment"), ("form", "XFA"), ("catalog", "AcroForm"), ("action", "SubmitForm"), ("scan", "unreadable"), ("form", "AA"), ("names", "EmbeddedFiles"), ("annotation", "Sig"))
_FACTS_SQL = f"""fc AS (SELECT page AS doc_id, ({[p for p, _ in _FACTS]})[i] AS place, ({[w for _, w in _FACTS]})[i] AS what, flags % 2 = 0 AS open FROM (SELECT *, ((length(target) * 7 + ord) % {len(_FACTS)} + 1)::INT AS i FROM links)),
fd AS (SELECT doc_id, doc_id % 53 = 0 AS locked FROM (SELECT DISTINCT page AS doc_id FROM links)),
fe AS (SELECT doc_id, NOT bool_or(place = 'scan' AND what IN ('exhausted', 'unreadable')) AS complete, bool_or(place = 'action' AND what = 'JavaScript' AND open) AS open_action_javascript, bool_or(place = 'action' AND what = 'JavaScript') AS javascript_actions, bool_or(place = 'names' AND what = 'JavaScript') AS names_javascript,
bool_or(what = 'AA' AND place IN ('catalog', 'annotation', 'form')) AS additional_actions, bool_or(place = 'action' AND what = 'Launch') AS launch_actions, bool_or(place = 'action' AND what = 'URI') AS uri_actions, bool_or(place = 'action' AND what = 'SubmitForm') AS submit_form_actions, bool_or(place = 'action' AND what = 'GoToR') AS goto_remote_actions,
bool_or((place = 'names' AND what = 'EmbeddedFiles') OR (place = 'annotation' AND what = 'FileAttachment')) AS embedded_files, bool_or(place = 'catalog' AND what = 'AcroForm') AS acroform, bool_or(place = 'form' AND what = 'XFA') AS xfa, bool_or(place = 'catalog' AND what = 'OCProperties') AS optional_content, bool_or(what = 'Sig' AND place IN ('form', 'annotation')) AS signature_fields FROM fc GROUP BY doc_id),
ff AS (SELECT doc_id, locked, {', '.join(f"CASE WHEN NOT locked THEN {f} END AS {f}" for f in report.FEATURES)} FROM fd JOIN fe USING (doc_id))"""


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of web pages by what their links stand for; every 53rd page is locked."""
    links = X.links(spark, sf_dir)
    fact = F.get(F.array(*(F.struct(F.lit(p).alias("place"), F.lit(w).alias("what")) for p, w in _FACTS)), ((F.length("target") * 7 + F.col("ord")) % len(_FACTS)).cast("int"))
    facts = links.select(F.col("page").alias("doc_id"), fact.alias("f"), (F.col("flags") % 2 == 0).alias("open")).select("doc_id", "f.*", "open")
    documents = links.select(F.col("page").alias("doc_id")).distinct().withColumn("locked", F.col("doc_id") % 53 == 0)
    return report.features(facts, documents)


@query(f"WITH {_FACTS_SQL} SELECT * FROM ff", using=("links",))
def report_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir)


@query(f"WITH {_SUMMARY_SQL} " + " UNION ALL ".join(f"SELECT '{f}' AS feature, count(*) FILTER ({f}) AS documents FROM su" for f in (*FLAGS, "locked")))
def report_flag_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.flag_totals(_summaries(spark, sf_dir), [*FLAGS, "locked"])


@query(f"""WITH {_SIZE_SQL}, g AS (SELECT doc_id, width, height, count(*) AS pages, min(page) AS f FROM sz GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY f, width, height) AS r, count(*) OVER (PARTITION BY doc_id) AS n FROM g)
SELECT doc_id, width, height, pages, row_number() OVER (PARTITION BY doc_id ORDER BY pages DESC, width, height)::INT AS rank, n > 4 AS truncated FROM r WHERE r <= 4""", using=("page_boxes",))
def report_page_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.page_sizes(_sizes(spark, sf_dir), 4)


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, ord) AS r FROM links)
SELECT doc_id, string_agg(CASE WHEN length(target) > 12 THEN substr(target, 1, 12) || '…' ELSE target END, '|' ORDER BY r) FILTER (r <= 10) AS items, count(*) AS total, count(*) > 10 AS truncated FROM r GROUP BY doc_id""", using=("links",))
def report_bounded_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.bounded_list(X.links(spark, sf_dir), "doc_id", ["page", "ord"], "target", 10, 12).withColumn("items", F.array_join("items", "|"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, ord) AS r, count(*) OVER (PARTITION BY doc_id) AS n FROM links)
SELECT doc_id, r::INT AS ord, target AS message FROM r WHERE r <= 5 UNION ALL SELECT DISTINCT doc_id, 6, (n - 5) || ' more are not listed' FROM r WHERE n > 5""", using=("links",))
def report_problem_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.with_overflow(X.links(spark, sf_dir), "doc_id", ["page", "ord"], "target", 5)


@query(f"""WITH {_FACTS_SQL}, pt AS (SELECT page_id::INT AS doc_id, (i - 1)::INT AS page, length(l[i]) % 7 * 100 AS width, length(l[i]) % 5 * 100 AS height FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT page_id, string_split(html, '<') AS l FROM pages))),
g AS (SELECT doc_id, width, height, count(*) AS pages, min(page) AS f FROM pt GROUP BY ALL), gr AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY f, width, height) AS r, count(*) OVER (PARTITION BY doc_id) AS n FROM g),
sz AS (SELECT doc_id, string_agg(width || 'x' || height || 'x' || pages, '|' ORDER BY pages DESC, width, height) AS page_sizes, bool_or(n > 32) AS page_sizes_truncated FROM gr WHERE r <= 32 GROUP BY doc_id),
pn AS (SELECT doc_id, count(*) AS pages FROM pt GROUP BY doc_id), rv AS (SELECT doc_id, rev, (rev - 1) * 100 AS start, rev * 100 AS "end" FROM rev_entries), rn AS (SELECT doc_id, count(*) AS revisions, string_agg(start || '-' || "end", '|' ORDER BY rev) AS revision_ranges FROM rv GROUP BY doc_id),
ur AS (SELECT page AS doc_id, ord, CASE WHEN length(target) > 1024 THEN substr(target, 1, 1024) || '…' ELSE target END AS t, row_number() OVER (PARTITION BY page ORDER BY ord) AS r FROM links), ul AS (SELECT doc_id, string_agg(t, '|' ORDER BY r) FILTER (r <= 100) AS uris, count(*) AS uris_total, count(*) > 100 AS uris_truncated FROM ur GROUP BY doc_id),
el AS (SELECT doc_id, string_agg(t, '|' ORDER BY r) FILTER (r <= 100) AS files, count(*) AS files_total FROM (SELECT page AS doc_id, target AS t, row_number() OVER (PARTITION BY page ORDER BY ord) AS r FROM links WHERE subtype = 'Widget') GROUP BY doc_id),
pr AS (SELECT doc_id, string_agg(what, '|' ORDER BY r) AS problems FROM (SELECT doc_id, what, row_number() OVER (PARTITION BY doc_id ORDER BY what, open) AS r FROM fc WHERE place = 'scan') WHERE r <= 16 GROUP BY doc_id)
SELECT ff.doc_id, strlen(html) AS file_size, '1.' || (doc_id % 8) AS version, length(url)::BIGINT AS objects, coalesce(revisions, 0) AS revisions, doc_id % 4 = 0 AS repaired, CASE WHEN doc_id % 4 = 0 THEN 'xref-rebuilt' ELSE '' END AS repair_reasons, locked, CASE WHEN NOT locked THEN coalesce(pages, 0) END AS pages, {', '.join(report.FEATURES)},
coalesce(problems, '') AS problems, CASE WHEN NOT locked THEN url END AS title, CASE WHEN NOT locked THEN contains(html, '<p>') END AS tagged, doc_id % 2 = 0 AS linearized, CASE WHEN NOT locked THEN coalesce(page_sizes, '') END AS page_sizes, coalesce(page_sizes_truncated, false) AS page_sizes_truncated, coalesce(revision_ranges, '') AS revision_ranges,
CASE WHEN NOT locked THEN uris END AS uris, CASE WHEN NOT locked THEN uris_total END AS uris_total, CASE WHEN NOT locked THEN uris_truncated END AS uris_truncated, CASE WHEN NOT locked THEN coalesce(files, '') END AS attached, CASE WHEN NOT locked THEN coalesce(files_total, 0) END AS attached_total
FROM ff JOIN pages ON page_id = ff.doc_id LEFT JOIN pn USING (doc_id) LEFT JOIN sz USING (doc_id) LEFT JOIN rn USING (doc_id) LEFT JOIN ul USING (doc_id) LEFT JOIN el USING (doc_id) LEFT JOIN pr USING (doc_id)""", using=("links", "rev_entries"))
def report_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each web page, with lists as strings; what a locked one does not tell is null, not 0."""
    web, links = X.table(spark, sf_dir, "pages"), X.links(spark, sf_dir)
    flags = _features(spark, sf_dir)
    key = F.col("page_id").cast("int").alias("doc_id")
    documents = web.select(key, F.octet_length("html").cast("long").alias("file_size"), F.length("url").cast("long").alias("objects"), F.contains("html", F.lit("<p>")).alias("tagged"), F.col("url").alias("title"))
    documents = documents.withColumns({"locked": F.col("doc_id") % 53 == 0, "version": F.concat(F.lit("1."), F.col("doc_id") % 8), "linearized": F.col("doc_id") % 2 == 0})
    pages = web.select(key, F.posexplode(F.split("html", "<")).alias("page", "t"))
    pages = pages.select("doc_id", "page", (F.length("t") % 7 * 100).alias("width"), (F.length("t") % 5 * 100).alias("height"))
    revised = X.rev_entries(spark, sf_dir).select(F.col("doc_id").cast("int").alias("doc_id"), "rev", ((F.col("rev") - 1) * 100).alias("start"), (F.col("rev") * 100).alias("end"))
    targets = links.select(F.col("page").alias("doc_id"), "ord", "target", "subtype")
    listed = lambda rows: report.bounded_list(rows, "doc_id", ["ord"], "target")
    fact = ((F.length("target") * 7 + F.col("ord")) % len(_FACTS)) == [w for _, w in _FACTS].index("unreadable")
    problems = targets.where(fact).select("doc_id", "ord", F.lit("unreadable").alias("message"))
    repairs = documents.where("doc_id % 4 = 0").select("doc_id", F.lit(0).alias("ord"), F.lit("xref-rebuilt").alias("code"))
    rows = report.document_reports(documents, flags, pages, report.page_sizes(pages), revised, listed(targets), listed(targets.where("subtype = 'Widget'")), problems, repairs)
    flat = {c: F.array_join(c, "|") for c in ("repair_reasons", "problems", "page_sizes", "revision_ranges")}
    flat |= {"uris_total": F.col("uris.total"), "uris_truncated": F.col("uris.truncated"), "attached_total": F.col("attached.total")}
    return rows.withColumns(flat).withColumns({"uris": F.array_join("uris.items", "|"), "attached": F.array_join("attached.items", "|")})


_GATE_SQL = """og AS (SELECT id, CASE WHEN outcome = 'Rejected' AND message = 'password required' THEN 'PasswordRequired' ELSE outcome END AS outcome FROM outcomes),
mg AS (SELECT id, CASE WHEN contains(url, '7') THEN list_append(categories, 'malformed') ELSE categories END AS categories, password FROM manifest),
jg AS (SELECT o.id, outcome, coalesce(bad, false) AS bad, password FROM og o LEFT JOIN (SELECT id, bool_or(list_contains(categories, 'malformed')) AS bad, max(password) AS password FROM mg GROUP BY id) m USING (id))"""


def _gate_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest, with a category more for URLs that hold a seven."""
    more = F.when(F.contains("url", F.lit("7")), F.array_append("categories", F.lit("malformed"))).otherwise(F.col("categories"))
    return X.manifest(spark, sf_dir).withColumn("categories", more)


@query(f"""WITH {_GATE_SQL} SELECT *, opened_share >= 0.95 AND problems = 0 AS passed FROM (SELECT count(*) AS documents, count(*) FILTER (outcome IN ('Rendered', 'RenderFailed')) AS opened, count(*) FILTER (outcome = 'Rendered') AS rendered, count(*) FILTER (outcome IN ('Rendered', 'RenderFailed') AND password IS NOT NULL) AS protected,
count(*) FILTER (bad) AS malformed, count(*) FILTER (bad AND outcome IN ('Crashed', 'Hung')) AS malformed_bad, count(*) FILTER (outcome IN ('Crashed', 'Hung') OR (outcome = 'PasswordRequired' AND NOT bad)) AS problems, count(*) FILTER (outcome IN ('Rendered', 'RenderFailed'))::DOUBLE / greatest(count(*), 1) AS opened_share FROM jg)""", using=("outcomes", "manifest"))
def report_corpus_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = (F.col("outcome") == "Rejected") & (F.col("message") == "password required")
    outcomes = X.outcomes(spark, sf_dir).select("id", F.when(asked, "PasswordRequired").otherwise(F.col("outcome")).alias("outcome"))
    return report.corpus_gate(outcomes, _gate_manifest(spark, sf_dir))


@query(f"WITH {_GATE_SQL} SELECT *, documents >= 200 AND malformed >= 30 AS passed FROM (SELECT count(*) AS documents, count(*) FILTER (list_contains(categories, 'malformed')) AS malformed FROM mg)", using=("outcomes", "manifest"))
def report_manifest_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.manifest_targets(_gate_manifest(spark, sf_dir))


@query("SELECT license, count(*) AS documents FROM manifest GROUP BY 1", using=("manifest",))
def report_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.counted(X.manifest(spark, sf_dir), "license", "license")


@query(f"""WITH {_LABEL_SQL}, n AS (SELECT doc_id, count(*) AS pages, count(label) > 0 AS labelled FROM lb GROUP BY doc_id), o AS (SELECT doc_id, count(*) AS items, min(page) AS first FROM outline GROUP BY doc_id), l AS (SELECT doc_id, count(*) AS links, count(*) FILTER (subtype <> 'Link') AS inert, count(*) FILTER (target = '') AS unreadable FROM links GROUP BY doc_id)
SELECT sum(coalesce(items, 0))::BIGINT AS items, sum(coalesce(links, 0))::BIGINT AS links, sum(coalesce(inert, 0))::BIGINT AS inert_links, sum(coalesce(unreadable, 0))::BIGINT AS unreadable, count(*) FILTER (labelled) AS labelled, count(*) FILTER (first < pages) AS sectioned FROM n LEFT JOIN o USING (doc_id) LEFT JOIN l USING (doc_id)""", using=("page_text", "label_ranges", "outline", "links"))
def report_navigation_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals over documents; one has a section if an item stands at its last page or before."""
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    n = _labels(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("pages"), (F.count("label") > 0).alias("labelled"))
    o = X.outline(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("items"), F.min("page").alias("first"))
    l = X.links(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("links"), F.count_if(F.col("subtype") != "Link").alias("inert_links"), F.count_if(F.col("target") == "").alias("unreadable"))
    rows = n.join(o, "doc_id", "left").join(l, "doc_id", "left")
    return report.navigation_totals(rows.select("labelled", (F.col("first") < F.col("pages")).alias("sectioned"), *map(zero, ("items", "links", "inert_links", "unreadable"))))


@query("SELECT unnest(repairs) AS code, count(*) AS documents FROM outcomes GROUP BY 1", using=("outcomes",))
def report_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.counted(X.outcomes(spark, sf_dir), "repairs", "code")


@query("SELECT category, count(*) AS documents FROM (SELECT unnest(categories) AS category FROM manifest) GROUP BY 1", using=("manifest",))
def report_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.counted(X.manifest(spark, sf_dir), "categories", "category")


@query(f"""WITH {_LABEL_SQL}, n AS (SELECT doc_id, count(*) AS pages, count(label) AS labelled FROM lb GROUP BY doc_id), o AS (SELECT doc_id, count(*) AS items FROM outline GROUP BY doc_id), l AS (SELECT doc_id, count(*) AS links, count(*) FILTER (subtype <> 'Link') AS inert FROM links GROUP BY doc_id)
SELECT n.doc_id, pages, labelled, coalesce(items, 0) AS items, coalesce(links, 0) AS links, coalesce(inert, 0) AS inert FROM n LEFT JOIN o USING (doc_id) LEFT JOIN l USING (doc_id)""", using=("page_text", "label_ranges", "outline", "links"))
def report_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    n = _labels(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("pages"), F.count("label").alias("labelled"))
    o = X.outline(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("items"))
    l = X.links(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("links"), F.count_if(F.col("subtype") != "Link").alias("inert"))
    return n.join(o, "doc_id", "left").join(l, "doc_id", "left").select("doc_id", "pages", "labelled", zero("items"), zero("links"), zero("inert"))


@query("""WITH a AS (SELECT CASE WHEN p_partkey % 4 = 0 THEN 'pkg:' || p_name END AS purl, p_name AS name, p_brand AS version, 0 AS source, p_partkey AS pos FROM part UNION ALL SELECT NULL, s_name, '1', 1, s_suppkey FROM supplier UNION ALL SELECT 'pkg:' || p_name, p_name, p_type, 1, p_partkey + 1000000 FROM part WHERE p_partkey % 3 = 0)
SELECT name, version, source FROM a QUALIFY row_number() OVER (PARTITION BY coalesce(purl, concat_ws('@', name, version)) ORDER BY source, pos) = 1""")
def report_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = X.table(spark, sf_dir, "part"), X.table(spark, sf_dir, "supplier")
    purl = F.concat(F.lit("pkg:"), "p_name")
    first = p.select(F.when(F.col("p_partkey") % 4 == 0, purl).alias("purl"), F.col("p_name").alias("name"), F.col("p_brand").alias("version"), F.col("p_partkey").alias("pos"))
    second = s.select(F.lit(None).cast("string").alias("purl"), F.col("s_name").alias("name"), F.lit("1").alias("version"), F.col("s_suppkey").alias("pos"))
    second = second.union(p.where("p_partkey % 3 = 0").select(purl, "p_name", "p_type", F.col("p_partkey") + 1000000))
    return report.merged_inventory([first, second])


@query("SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY latest DESC, day DESC) <= 5 AS kept FROM (SELECT user_id, (ts::DATE)::VARCHAR AS day, max(ts) AS latest FROM events GROUP BY ALL)")
def report_kept_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = X.table(spark, sf_dir, "events").select("user_id", F.to_date("ts").cast("string").alias("day"), "ts")
    return report.kept_groups(e, "user_id", "day", "ts", 5)


@query("""WITH v AS (SELECT id, list_filter([CASE WHEN NOT regexp_full_match(id, '[A-Za-z0-9_\\-][A-Za-z0-9._\\-]{0,99}') THEN 'id' END, CASE WHEN NOT starts_with(url, 'https://') THEN 'url' END, CASE WHEN NOT regexp_full_match(sha256, '[0-9a-f]{64}') THEN 'sha256' END, CASE WHEN trim(license) = '' THEN 'license' END,
CASE WHEN trim(notes) = '' THEN 'notes' END, CASE WHEN len(categories) = 0 OR len(list_filter(categories, lambda x: trim(x) = '')) > 0 THEN 'categories' END, CASE WHEN strlen(password) > 256 THEN 'password' END], lambda x: x IS NOT NULL) AS p FROM manifest) SELECT id, unnest(p) AS problem FROM v""", using=("manifest",))
def source_manifest_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.manifest_problems(X.manifest(spark, sf_dir))


@query("SELECT lower(id) AS id, count(*) AS n FROM manifest GROUP BY 1 HAVING count(*) > 1", using=("manifest",))
def source_duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.manifest(spark, sf_dir).groupBy(F.lower("id").alias("id")).agg(F.count("*").alias("n")).where("n > 1")


_FILES = "fi AS (SELECT 'd-' || doc_id AS id, CASE WHEN doc_id % 17 = 0 THEN text || 'x' ELSE text END AS content FROM documents WHERE doc_id % 19 <> 0)"


@query(f"""WITH {_FILES} SELECT coalesce(m.id, f.id) AS id, CASE WHEN f.id IS NULL THEN 'missing' WHEN m.id IS NULL THEN 'unlisted' WHEN sha256(content) = m.sha256 THEN 'verified' ELSE 'corrupt' END AS status FROM manifest m FULL OUTER JOIN fi f ON m.id = f.id""", using=("manifest",))
def source_file_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _status(spark, sf_dir)


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscan.sources.files import file_status

    d, k = X.table(spark, sf_dir, "documents"), F.col("doc_id")
    files = d.where(k % 19 != 0).select(F.concat(F.lit("d-"), k).alias("id"), F.encode(F.when(k % 17 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), "UTF-8").alias("content"))
    return file_status(files, X.manifest(spark, sf_dir))


@query(f"""WITH {_FILES} SELECT status, count(*) AS files FROM (SELECT CASE WHEN f.id IS NULL THEN 'missing' WHEN m.id IS NULL THEN 'unlisted' WHEN sha256(content) = m.sha256 THEN 'verified' ELSE 'corrupt' END AS status FROM manifest m FULL OUTER JOIN fi f ON m.id = f.id) GROUP BY 1""", using=("manifest",))
def source_file_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _status(spark, sf_dir).groupBy("status").agg(F.count("*").alias("files"))


_BEST_SQL = """be AS (SELECT side, name, CASE WHEN bool_and(higher_is_better) THEN max(value) ELSE min(value) END AS value, bool_and(higher_is_better) AS higher_is_better, bool_and(tracked) AS tracked, max(floor) AS floor FROM metrics GROUP BY side, name)"""


@query(f"WITH {_BEST_SQL} SELECT * FROM be", using=("metrics",))
def gate_best_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.best_of(X.metrics(spark, sf_dir))


@query(f"""WITH {_BEST_SQL}, j AS (SELECT a.name, a.value AS previous, b.value AS current, CASE WHEN b.higher_is_better THEN a.value - b.value ELSE b.value - a.value END AS d, b.floor FROM be a JOIN be b USING (name) WHERE a.side = 'previous' AND b.side = 'current' AND a.tracked AND b.tracked AND a.value > 0)
SELECT name, previous, current, d / previous AS worse_by, d / previous > 0.1 AND d > floor AS failed FROM j""", using=("metrics",))
def gate_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.regressions(report.best_of(X.metrics(spark, sf_dir)))


@query("SELECT name, (list(value ORDER BY value))[(count(*) // 2 + 1)::INT] AS median FROM metrics GROUP BY name", using=("metrics",))
def gate_upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.upper_median(X.metrics(spark, sf_dir), "name", "value")


@query("SELECT name, count(*) AS work, min(value) AS best_ms, round(count(*) / sum(value), 6) AS per_second FROM metrics GROUP BY name", using=("metrics",))
def gate_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.throughput(X.metrics(spark, sf_dir), "name", F.lit(1), F.col("value"))


_PAIR_SQL = """pr AS (SELECT a.vec_id, a.embedding AS a, CASE WHEN a.vec_id % 50 = 0 THEN b.embedding[1:10] ELSE b.embedding END AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
df AS (SELECT vec_id, len(a) = len(b) AS same_size, CASE WHEN len(a) = len(b) THEN len(list_filter(list_transform(range(1, len(a) + 1), lambda i: abs(a[i]::DOUBLE - b[i]::DOUBLE)), lambda x: x > DELTA)) ELSE greatest(len(a), len(b)) END AS differing,
CASE WHEN len(a) = len(b) THEN list_max(list_transform(range(1, len(a) + 1), lambda i: abs(a[i]::DOUBLE - b[i]::DOUBLE))) ELSE 255.0 END AS worst, len(a) AS n FROM pr)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring vectors; every fiftieth pair has different sizes."""
    e = X.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("b"))
    return e.withColumnRenamed("e", "a").join(b, "vec_id").withColumn("b", F.when(F.col("vec_id") % 50 == 0, F.slice("b", 1, 10)).otherwise(F.col("b")))


@query(f"WITH {_PAIR_SQL.replace('DELTA', '0.05')} SELECT vec_id, same_size, differing::INT AS differing, CASE WHEN same_size THEN differing::DOUBLE / n ELSE 1.0 END AS ratio, worst FROM df")
def gate_array_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir)
    return p.select("vec_id", *(c.alias(k) for k, c in report.array_difference(F.col("a"), F.col("b"), 0.05).items()))


@query(f"""WITH {_PAIR_SQL.replace('DELTA', '0.1')}, o AS (SELECT *, CASE vec_id % 3 WHEN 0 THEN 'linux' WHEN 1 THEN 'windows' ELSE 'macos' END AS os FROM df),
t AS (SELECT *, CASE os WHEN 'linux' THEN 0.5 WHEN 'windows' THEN 0.6 ELSE 0.7 END AS base, CASE WHEN vec_id % 10 = 0 THEN 0.9 WHEN vec_id % 10 = 1 THEN 0.1 END AS allow, CASE WHEN same_size THEN differing::DOUBLE / n ELSE 1.0 END AS ratio FROM o)
SELECT vec_id, os, greatest(coalesce(allow, base), base)::DOUBLE AS most, ratio, same_size AND ratio <= greatest(coalesce(allow, base), base) AS passed FROM t""")
def gate_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences within a tolerance: the system's default, or the vector's own allowance where that is larger."""
    k = F.col("vec_id")
    p = _pairs(spark, sf_dir).withColumn("os", F.when(k % 3 == 0, "linux").when(k % 3 == 1, "windows").otherwise("macos"))
    defaults = spark.createDataFrame([("linux", 0.5), ("windows", 0.6), ("macos", 0.7)], "os string, most double")
    allowances = p.where(k % 10 < 2).select("os", k.alias("id"), F.when(k % 10 == 0, 0.9).otherwise(0.1).alias("most"))
    p = report.tolerances(p.withColumn("id", k), defaults, allowances)
    d = report.array_difference(F.col("a"), F.col("b"), 0.1)
    rows = p.select("vec_id", "os", "most", d["ratio"].alias("ratio"), d["same_size"].alias("same_size"))
    return rows.select("vec_id", "os", "most", "ratio", (F.col("same_size") & (F.col("ratio") <= F.col("most"))).alias("passed"))


@query(" UNION ALL ".join(f"(WITH {_PAIR_SQL.replace('DELTA', str(d))} SELECT vec_id, {d}::DOUBLE AS delta, CASE WHEN same_size THEN differing::DOUBLE / n ELSE 1.0 END AS ratio FROM df)" for d in (0.01, 0.02, 0.05, 0.1, 0.2, 0.4)))
def gate_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differing shares at six thresholds."""
    return report.ratios_at(_pairs(spark, sf_dir), "vec_id", "a", "b", [0.01, 0.02, 0.05, 0.1, 0.2, 0.4])


@query("""SELECT user_id, props, latest, row_number() OVER (PARTITION BY user_id ORDER BY latest DESC, props)::INT AS rank FROM (SELECT user_id, props, max(event_id) AS latest FROM events GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY latest DESC, props) <= 15""")
def report_recent_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.recent_items(X.table(spark, sf_dir, "events"), "user_id", "props", "event_id", 15)


def gate_text_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive documents of a language and source, by their whole comparable texts up to the published bound.

    DuckDB's levenshtein counts bytes, so there is no SQL.
    """
    return report.text_distances(X.table(spark, sf_dir, "documents"))


def gate_text_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.text_report(gate_text_distances(spark, sf_dir))


def gate_text_distances_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by all comparable characters, without a bound."""
    return report.text_distances(X.table(spark, sf_dir, "documents"), whole=True)


def gate_text_report_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.text_report(gate_text_distances_whole(spark, sf_dir))


#: Queries without SQL.
WITHOUT_SQL = {q.__name__: q for q in (gate_text_distances, gate_text_report, gate_text_distances_whole, gate_text_report_whole)}
