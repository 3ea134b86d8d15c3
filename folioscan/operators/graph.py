"""Trees and graphs, level by level: each level is one join, and what was visited is left out by an anti join."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscan.limits import LIMITS
from folioscan.storage import ranged, stored


#: Rows up to which a side of a join goes to all tasks.  Spark would go by the size of the stored files, which hold ten times the rows that their bytes let expect.
FEW = 100_000


def _sent(rows: DataFrame, n: int) -> DataFrame:
    """One side of a join, of n rows: to all tasks by way of the driver if they are few, else both sides are shuffled."""
    return F.broadcast(rows) if n <= FEW else rows.hint("merge")


class TooDeep(ValueError):
    """A tree goes on below the depth up to which it is walked."""


def walk(nodes: DataFrame, keys: list[str], inherited: list[str], carried: list[str] = (), depth: int = LIMITS.tree_depth, deeper: str = "raise") -> DataFrame:
    """keys, id, parent, depth, path (places from the root), carried and inherited columns of a tree (keys, id, parent, pos).

    An inherited attribute is the node's own or that of its nearest ancestor.  A
    node listed twice counts once, under its smallest path, as a walk in document
    order meets it; so shared children do not multiply and cycles end.  A node that
    is listed once, and whose ancestors are, is met once: it goes out with its level
    and is not looked at again.  Only what hangs from a node that is listed several
    times is compared with what is known of it, level by level.

    deeper: what nodes below ``depth`` do.  "raise" raises TooDeep; "list" adds a column
    cut and returns those just below it too, with cut true.
    """
    listed = [*keys, "id"]
    own = nodes.select(*listed, "parent", "pos", *inherited, *carried)
    several = own.groupBy(*listed).agg(F.count("*").alias("_n")).where("_n > 1").select(*listed, F.lit(True).alias("_many"))
    own = stored(own.join(several, listed, "left").withColumn("_many", F.coalesce("_many", F.lit(False))), "walk-nodes")
    contested = not own.where("_many").isEmpty()
    columns = ["parent", "depth", "_many", *inherited, *carried]
    least = lambda rows: rows.groupBy(*listed).agg(F.min_by(F.struct(*columns), "path").alias("_v"), F.min("path").alias("path")).select(*listed, "path", "_v.*")
    sides = lambda rows: (rows.where("not _many"), rows.where("_many")) if contested else (rows, None)
    level = own.where("parent is null").select(*listed, F.array("pos").alias("path"), "parent", F.lit(0).alias("depth"), "_many", *inherited, *carried)
    once, many = sides(level)
    level = stored(once.unionByName(least(many)) if contested else once, "walk")
    once, known = sides(level)
    out = once
    for k in range(1, depth + 2):
        up = level.select(*keys, F.col("id").alias("parent"), F.col("path").alias("_p"), F.col("_many").alias("_up"), *(F.col(c).alias(f"_{c}") for c in inherited))
        down = own.join(up, [*keys, "parent"])
        down = down.select(*listed, F.array_append("_p", F.col("pos")).alias("path"), "parent", F.lit(k).alias("depth"), (F.col("_many") | F.col("_up")).alias("_many"), *(F.coalesce(c, f"_{c}").alias(c) for c in inherited), *carried)
        if contested:
            once, many = sides(down)
            first = known.groupBy(*listed).agg(F.min("path").alias("_known"))
            many = least(many).join(first, listed, "left").where(F.col("_known").isNull() | (F.col("path") < F.col("_known"))).drop("_known")
            down = once.unionByName(many)
        level = stored(down, "walk")
        if level.isEmpty():
            break
        if k > depth and deeper == "raise":
            raise TooDeep(f"{level.count()} nodes stand deeper than {depth}")
        once, many = sides(level)
        out, known = out.unionByName(once), known.unionByName(many) if contested else None
    out = out.unionByName(least(known)) if contested else out
    cut = [(F.col("depth") > depth).alias("cut")] if deeper == "list" else []
    return out.select(*listed, "parent", "depth", "path", *inherited, *carried, *cut)


def key_tree(nodes: DataFrame, keys: list[str], pairs: DataFrame) -> DataFrame:
    """keys, key, value, path of a name or number tree: the pairs (keys, id, pos, key, value) of all nodes (keys, id, parent, pos).

    path is the place of a pair in document order: sorted by key, then path, they are
    the flattened tree, the first of equal keys first.
    """
    found = walk(nodes, keys, []).select(*keys, "id", "path")
    rows = found.join(pairs.select(*keys, "id", F.col("pos").cast("long").alias("_at"), "key", "value"), [*keys, "id"])
    return rows.select(*keys, "key", "value", F.array_append(F.col("path").cast("array<bigint>"), F.col("_at")).alias("path"))


def preorder(walked: DataFrame, keys: list[str], most: int | None = None) -> DataFrame:
    """Adds the place of each node in document order, from 0; at most so many."""
    out = walked.withColumn("preorder", F.row_number().over(W.partitionBy(*keys).orderBy("path")) - 1)
    return out if most is None else out.where(F.col("preorder") < most)


def chain_ranks(nexts: DataFrame, key: str, node: str, following: str, first: DataFrame | None = None) -> DataFrame:
    """key, node, rank (from 0) of chains in which each node names the next, from first (key, node), or else from the nodes that none names.

    Ranks below 2**k and pointers 2**k nodes ahead give the ranks below 2**(k+1): log n
    joins.  A chain that comes back to one of its nodes ends there; what no first
    node leads to has no rank.
    """
    ahead = stored(nexts.select(key, F.col(node).alias("n"), F.col(following).alias("to")), "chain")
    if first is None:
        named = ahead.where("to is not null").select(key, F.col("to").alias("n")).distinct()
        first = ahead.select(key, "n").join(named, [key, "n"], "left_anti")
    else:
        first = first.select(key, F.col(node).alias("n"))
    ranks = stored(first.distinct().withColumn("rank", F.lit(0).cast("long")), "chain-ranks")
    jump, step = ahead.where("to is not null"), 1
    while True:
        far = ranks.join(jump, [key, "n"]).groupBy(key, F.col("to").alias("n")).agg((F.min("rank") + step).alias("rank"))
        new = stored(far.join(ranks, [key, "n"], "left_anti"), "chain-ranks")
        if new.isEmpty():
            break
        ranks = ranks.union(new)
        over = jump.select(key, F.col("n").alias("to"), F.col("to").alias("_to"))
        jump, step = stored(jump.join(over, [key, "to"]).select(key, "n", F.col("_to").alias("to")), "chain"), 2 * step
    kept = ranks.join(ahead.select(key, "n"), [key, "n"], "left_semi")
    return kept.select(key, F.col("n").alias(node), "rank")


def reached(edges: DataFrame, roots: DataFrame, levels: int | None = None, keys: list[str] = (), nodes: DataFrame | None = None) -> DataFrame:
    """keys, node, level: what the roots reach, each node once, at its smallest level; all of it, or the first ``levels`` levels if only those are asked for.

    keys: columns that tell graphs apart, as of documents; all graphs are walked at
    once.  nodes (keys, node): what there is; nodes that are only named are left out.
    """
    keys = list(keys)
    return _walked(*_prepared(edges, roots, keys, nodes), keys, levels)


def _prepared(edges: DataFrame, roots: DataFrame, keys: list[str], nodes: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Edges (keys, node, dst) written once for all levels, and roots; those to nodes that are missing are left out here, once."""
    edges = edges.select(*keys, F.col("src").alias("node"), "dst")
    roots = roots.select(*keys, "node", *(c for c in roots.columns if c == "open"))
    if nodes is not None:
        there = nodes.select(*keys, "node").hint("merge")
        edges = edges.join(there.withColumnRenamed("node", "dst"), [*keys, "dst"], "left_semi").select(*keys, "node", "dst")
        roots = roots.join(there, [*keys, "node"], "left_semi")
    return stored(edges, "edges"), stored(roots, "roots")


def _walked(edges: DataFrame, roots: DataFrame, keys: list[str], levels: int | None, carried: list[str] = ()) -> DataFrame:
    """keys, node, carried, level: a node once for each value that is carried along from a root."""
    told = [*keys, "node", *carried]
    level = stored(roots.select(*told).distinct().withColumn("level", F.lit(0)), "frontier")
    seen, n = level, level.count()
    n_seen = n
    for k in count(1) if levels is None else range(1, levels):
        new = edges.join(_sent(level, n), [*keys, "node"]).select(*keys, F.col("dst").alias("node"), *carried).distinct()
        level = stored(new.join(_sent(seen.select(*told), n_seen), told, "left_anti").withColumn("level", F.lit(k)), "frontier")
        n = level.count()
        if not n:
            break
        seen, n_seen = seen.union(level), n_seen + n
    return seen


def renumbered(found: DataFrame) -> DataFrame:
    """node, level, place: places by name inside each level, counted range by range."""
    rows = ranged(found, ["level", "node"], "renumbered")
    before = W.partitionBy("level").orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    starts = rows.groupBy("level", "_p").agg(F.count("*").alias("_n")).select("level", "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(W.partitionBy("level", "_p").orderBy("node")) + F.col("_start")
    return rows.join(starts, ["level", "_p"]).withColumn("place", place).drop("_p", "_start")


def discovered(edges: DataFrame, roots: DataFrame, keys: list[str] = (), nodes: DataFrame | None = None) -> DataFrame:
    """keys, node, level, place (from 1 in its level), number (from 1) of what the roots reach, in the order of a breadth-first discovery.

    A level stands in the order of the first node before it that names a node, and
    then by name; roots by name.  Places are counted range by range, so no level and no
    graph has to fit anywhere; the number is the place after all earlier levels.
    keys and nodes as in reached().
    """
    keys = list(keys)
    edges, roots = _prepared(edges, roots, keys, nodes)
    level = _placed(roots.select(*keys, "node").distinct().withColumn("_by", F.lit(0).cast("long")), keys, 0)
    seen, n = level, level.count()
    n_seen = n
    for k in count(1):
        new = edges.join(_sent(level, n), [*keys, "node"]).groupBy(*keys, F.col("dst").alias("node")).agg(F.min("place").alias("_by"))
        level = _placed(new.join(_sent(seen.select(*keys, "node"), n_seen), [*keys, "node"], "left_anti"), keys, k)
        n = level.count()
        if not n:
            break
        seen, n_seen = seen.union(level), n_seen + n
    before = W.partitionBy(*keys).orderBy("level").rowsBetween(W.unboundedPreceding, -1)  # one row a level
    starts = seen.groupBy(*keys, "level").agg(F.count("*").alias("_n")).select(*keys, "level", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return seen.join(starts.hint("merge") if keys else starts, [*keys, "level"]).select(*keys, "node", "level", "place", (F.col("place") + F.col("_start")).alias("number"))


def _placed(rows: DataFrame, keys: list[str], level: int) -> DataFrame:
    """keys, node, level, place by _by and node: counts of ranges, then places inside a range."""
    rows = ranged(rows, [*keys, "_by", "node"], "renumbered")
    before = W.partitionBy(*keys).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    starts = rows.groupBy(*keys, "_p").agg(F.count("*").alias("_n"))
    starts = starts.select(*keys, "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(W.partitionBy(*keys, "_p").orderBy("_by", "node")) + F.col("_start")
    return stored(rows.join(starts.hint("merge") if keys else starts, [*keys, "_p"]).select(*keys, "node", F.lit(level).alias("level"), place.alias("place")), "frontier")


#: Flags of action kinds; fixed values.
ACTIONS = {"JavaScript": "javascript_actions", "Launch": "launch_actions", "URI": "uri_actions", "SubmitForm": "submit_form_actions", "GoToR": "goto_remote_actions"}


def action_facts(actions: DataFrame, edges: DataFrame, roots: DataFrame, keys: list[str] = (), depth: int = LIMITS.depth) -> DataFrame:
    """keys, node, kind, open of the actions (keys, node, kind) that roots (keys, node, open) reach over next actions (keys, src, dst), less than ``depth`` deep.

    open marks what runs when the document is opened; it is carried along, so one walk
    meets a node once from roots that are open and once from others, and each action
    that an open one reaches runs then.  Nodes without an action end a walk.
    """
    keys = list(keys)
    actions = stored(actions.select(*keys, "node", "kind"), "actions")
    edges, roots = _prepared(edges, roots.withColumn("open", F.coalesce("open", F.lit(False))), keys, actions)
    met = _walked(edges, roots, keys, depth, ["open"]).groupBy(*keys, "node").agg(F.bool_or("open").alias("open"))
    return met.join(actions.hint("merge"), [*keys, "node"]).select(*keys, "node", "kind", "open")


def action_scan(actions: DataFrame, edges: DataFrame, roots: DataFrame, depth: int = LIMITS.depth, keys: list[str] = ()) -> DataFrame:
    """keys and flags of the actions that action_facts() finds: a row for each graph with a root, or one row without keys."""
    keys = list(keys)
    flags = [F.coalesce(F.bool_or(F.col("kind") == kind), F.lit(False)).alias(name) for kind, name in ACTIONS.items()]
    on_open = F.coalesce(F.bool_or((F.col("kind") == "JavaScript") & F.col("open")), F.lit(False)).alias("open_action_javascript")
    found = action_facts(actions, edges, roots, keys, depth).groupBy(*keys).agg(on_open, *flags, F.count("*").alias("actions"))
    if not keys:
        return found
    none = {"open_action_javascript": False, **dict.fromkeys(ACTIONS.values(), False), "actions": 0}
    return roots.select(*keys).distinct().join(found.hint("merge"), keys, "left").fillna(none)


def dereferenced(refs: DataFrame, hops: int = LIMITS.depth) -> DataFrame:
    """src, value: where a chain of references (src, dst) ends within so many hops; null for a cycle.  Hops double each round."""
    jump = refs.select("src", "dst").where("dst is not null")
    ends = jump
    for _ in range(max(hops - 1, 1).bit_length()):
        far = ends.select(F.col("src").alias("dst"), F.col("dst").alias("_far"))
        ends = stored(ends.join(far, "dst", "left").select("src", F.coalesce("_far", "dst").alias("dst")), "deref")
    still = jump.select(F.col("src").alias("dst"), F.lit(True).alias("_more"))
    return ends.join(still, "dst", "left").select("src", F.when(F.col("_more").isNull(), F.col("dst")).alias("value"))
