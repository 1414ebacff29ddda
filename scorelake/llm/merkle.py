"""A Merkle manifest of a table by butterfly exchange: every row's leaf digest and its proof up to one root.

A row's leaf is the SHA-256 of its fields. The rows of one group (a tree) stand in key order; while a level has
more than one node, every ``FANOUT`` neighbours become the digest of their digests. The trees' roots, in group
order, are joined the same way into the root of the table.

Rows are dealt by range of (group, key), so a position is the rows of earlier ranges plus a rank inside one
range; a group with a third of all rows is many ranges. Blocks of ``FANOUT`` ** ``levels`` neighbouring leaves
are the partitions of the exchange. A block makes its own subtree. Then, round by round, the blocks of aligned
runs of up to ``FANOUT`` subtrees swap subtree roots: every block hears one member of each sibling subtree and
hashes their common ancestor itself. So all blocks of a subtree work out its ancestors redundantly, and after
the last round each holds its upper proof; nothing is passed down. Where sibling subtrees differ in size (the
last of a run, or trees of different groups), member q of m speaks to the members q, q + m, q + 2m, ... of the
sibling. A lone block beside a large sibling speaks to many: its calls are cut into stretches of ``STRETCH``
targets that are dealt over tasks before they are spread out.

Null fields are ``-``. Null groups form a tree of their own, the first; a null key stands before all others. Rows
with equal keys stand in the order of their leaves, so repeated rows may swap places without any digest changing.
Texts of any length are hashed whole. An empty table gives no rows. Only the named columns are read: others,
whatever their names, are ignored."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelake.llm.common import materialise

FANOUT = 8
LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
RANGE_ROWS = 1_000_000
STRETCH = 4096
_STEP = "struct<before:string,after:string>"


def sha256(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(values: Sequence[Column]) -> Column:
    """The digest of a row's fields: ``-`` for null, else the value's length in bytes, a colon and the value."""
    texts = [v.cast("string") for v in values]
    return sha256(*(F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts))


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf digest and a proof lead to."""
    return F.aggregate(proof, start, lambda node, step: sha256(step["before"], node, step["after"]))


def siblings(proof: Column) -> Column:
    """All digests of a proof, level by level, left to right, as one text."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["before"], step["after"])), "")


def _div(a: Column, n: int | Column) -> Column:
    return F.floor(a / n).cast("long")


def _ranges(df: DataFrame, rows: int) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // RANGE_ROWS))


def _trees(counts: DataFrame, width: int) -> DataFrame:
    """(tree, rows, blocks, index, first) of every tree: its place among the trees and its first block's
    number. ``counts`` has each tree's rows in each range; ranges follow tree order."""
    trees = counts.groupBy("tree").agg(F.sum("rows").alias("rows"), F.min("dealt").alias("home"))
    trees = trees.withColumn("blocks", _div(F.col("rows") + width - 1, width))
    homes = trees.groupBy("home").agg(F.count("*").alias("n"), F.sum("blocks").alias("b"))
    earlier = Window.orderBy("home").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    homes = homes.select("home", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}0") for c in ("n", "b")))
    inside = Window.partitionBy("home").orderBy("tree")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    return trees.join(homes, "home").select("tree", "rows", "blocks", (F.col("n0") + F.row_number().over(inside) - 1).alias("index"), (F.col("b0") + F.coalesce(F.sum("blocks").over(before), F.lit(0))).alias("first"))


def _with_ladder(trees: DataFrame, n: int) -> DataFrame:
    """Adds, for each level above the trees, the first block and the blocks of every member of the tree's run."""
    sizes = trees.select(F.col("index").alias("i"), "first", "blocks")
    out = trees.withColumn("ladder", F.array().cast("array<array<struct<base:bigint,size:bigint>>>"))
    reach = FANOUT
    while n > 1:
        runs = sizes.groupBy(_div(F.col("i"), FANOUT).alias("run")).agg(F.array_sort(F.collect_list(F.struct("i", F.col("first").alias("base"), F.col("blocks").alias("size")))).alias("members"))
        members = F.transform("members", lambda m: F.struct(m["base"].alias("base"), m["size"].alias("size")))
        out = out.withColumn("run", _div(F.col("index"), reach)).join(runs, "run").withColumn("ladder", F.concat("ladder", F.array(members))).drop("run", "members")
        sizes = runs.select(F.col("run").alias("i"), F.col("members")[0]["base"].alias("first"), F.aggregate("members", F.lit(0).cast("long"), lambda s, m: s + m["size"]).alias("blocks"))
        n, reach = -(-n // FANOUT), reach * FANOUT
    return out


def _subtree(blocks: DataFrame, levels: int) -> DataFrame:
    """Adds the nodes of every level inside a block, level_0 to level_``levels``; a level above a tree's root
    repeats the root."""
    out = blocks.withColumn("level_0", F.transform("members", lambda m: m["leaf"]))
    for k in range(levels):
        nodes = F.col(f"level_{k}")
        above = F.transform(F.sequence(F.lit(0), _div(F.size(nodes) - 1, FANOUT).cast("int")), lambda i: F.sha2(F.array_join(F.slice(nodes, i * FANOUT + 1, FANOUT), ""), 256))
        out = out.withColumn(f"level_{k + 1}", F.when(F.col("rows") > FANOUT ** k, above).otherwise(nodes))
    return out


def _inside(levels: int, place: Column, rows: Column) -> Column:
    """The proof of the leaf at ``place`` of a block, up to the block's root."""
    steps = []
    for k in range(levels):
        nodes, own = F.col(f"level_{k}"), _div(place, FANOUT ** k).cast("int")
        at = own % FANOUT
        step = F.struct(F.array_join(F.slice(nodes, own - at + 1, at), "").alias("before"), F.array_join(F.slice(nodes, own + 2, F.lit(FANOUT - 1) - at), "").alias("after"))
        steps.append(F.when(rows > FANOUT ** k, step))
    return F.filter(F.array(*steps), lambda s: s.isNotNull())


def _round(state: DataFrame, groups: Column, own: Column, active: Column) -> DataFrame:
    """One exchange: every block hears the root of each sibling subtree of its run (``groups``: first block and
    blocks of the run's subtrees; ``own``: the block's among them) and hashes the common ancestor."""
    now = state.withColumn("groups", groups).withColumn("own", own.cast("int")).withColumn("active", active)
    calls = now.where("active").select("block", "root", "own", F.col("groups")[F.col("own")].alias("mine"), F.posexplode("groups").alias("digit", "peer")).where("digit <> own")
    calls = calls.withColumn("q", F.col("block") - F.col("mine.base")).where("q < peer.size")
    calls = calls.withColumn("targets", _div(F.col("peer.size") - 1 - F.col("q"), F.col("mine.size")) + 1)
    calls = calls.select("root", "own", "targets", (F.col("peer.base") + F.col("q")).alias("to"), F.col("mine.size").alias("step"), F.explode(F.sequence(F.lit(0).cast("long"), _div(F.col("targets") - 1, STRETCH))).alias("part"))
    start = F.col("to") + F.col("part") * STRETCH * F.col("step")
    some = F.least(F.lit(STRETCH).cast("long"), F.col("targets") - F.col("part") * STRETCH)
    calls = calls.select(start.alias("to"), some.alias("some"), "step", F.struct(F.col("own").alias("digit"), "root").alias("call"))
    calls = calls.repartition(_ranges(state, 0), "to")
    heard = calls.select(F.explode(F.sequence(F.col("to"), F.col("to") + (F.col("some") - 1) * F.col("step"), F.col("step"))).alias("block"), "call")
    heard = heard.groupBy("block").agg(F.array_sort(F.collect_list("call")).alias("heard"))
    met = now.join(heard, "block", "left").withColumn("heard", F.coalesce("heard", F.array().cast("array<struct<digit:int,root:string>>")))
    side = lambda keep: F.array_join(F.transform(F.filter("heard", keep), lambda c: c["root"]), "")
    met = met.withColumn("step", F.struct(side(lambda c: c["digit"] < F.col("own")).alias("before"), side(lambda c: c["digit"] > F.col("own")).alias("after")))
    whole = F.when(F.size("heard") == F.size("groups") - 1, sha256(F.col("step.before"), F.col("root"), F.col("step.after"))).otherwise(F.raise_error(F.lit("a sibling was not heard")))
    met = met.withColumn("root", F.when(F.col("active"), whole).otherwise(F.col("root")))
    met = met.withColumn("path", F.when(F.col("active"), F.concat("path", F.array("step"))).otherwise(F.col("path")))
    return materialise(met.select(*state.columns))


def _stretch_of(span: int):
    """The first block and the blocks of a tree's h-th subtree of ``span`` blocks."""
    return lambda h: F.struct((F.col("first") + h * span).alias("base"), F.least(F.lit(span).cast("long"), F.col("blocks") - h * span).alias("size"))


def _exchanged(state: DataFrame, most_blocks: int, n_trees: int) -> DataFrame:
    """(block, path, subroot, root) after all rounds, inside the trees and then above them."""
    span = 1
    while most_blocks > span:
        count = _div(F.col("blocks") + span - 1, span)
        group = _div(F.col("block") - F.col("first"), span)
        low = group - group % FANOUT
        groups = F.transform(F.sequence(low, F.least(low + FANOUT, count) - 1), _stretch_of(span))
        state = _round(state, groups, group % FANOUT, count > 1)
        span *= FANOUT
    state, reach, level = state.withColumn("subroot", F.col("root")), 1, 0
    while n_trees > reach:
        state = _round(state, F.col("ladder")[level], _div(F.col("index"), reach) % FANOUT, F.lit(True))
        reach, level = reach * FANOUT, level + 1
    return state.select("block", "path", "subroot", "root")


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "lang", key: str = "doc_id", also: dict[str, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """(key, leaf, the columns ``also``, subroot, root, proof) of every row. ``proof`` is an array of the digests
    before and after the node at each level, as ``folded`` takes it. ``also`` are expressions over ``docs``, worked
    out in the pass that hashes."""
    also, width = also or {}, FANOUT ** levels
    extra = F.struct(F.lit(0).alias("_"), *(c.alias(k) for k, c in also.items()))
    rows = materialise(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{group}`").alias("tree"), leaf([F.col(f"`{c}`") for c in fields]).alias("leaf"), extra.alias("also"), F.monotonically_increasing_id().alias("n")))
    n = rows.count()
    ordered = materialise(rows.repartitionByRange(_ranges(rows, n), "tree", "key", "leaf", "n").withColumn("dealt", F.spark_partition_id()))
    counts = materialise(ordered.groupBy("dealt", "tree").agg(F.count("*").alias("rows")))
    trees = materialise(_trees(counts, width))
    n_trees, most = trees.agg(F.count("*"), F.max("blocks")).first()
    trees = materialise(_with_ladder(trees, n_trees))
    earlier = Window.partitionBy("tree").orderBy("dealt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("dealt", "tree", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("earlier")).alias("s")
    starts = materialise(starts.join(trees.alias("t"), F.expr("s.tree <=> t.tree")).select("dealt", "s.tree", "earlier", "rows", "blocks", "index", "first", "ladder"))
    facts = starts.select("dealt", "tree", "earlier", "rows", "first").alias("f")
    placed = ordered.alias("o").join(facts, F.expr("o.dealt = f.dealt AND o.tree <=> f.tree")).select("o.dealt", "key", "leaf", "also", "n", "earlier", "rows", "first")
    place = F.col("earlier") + F.row_number().over(Window.partitionBy("dealt", "first").orderBy("key", "leaf", "n")) - 1
    placed = placed.withColumn("place", place).withColumn("block", F.col("first") + _div(F.col("place"), width))
    blocks = materialise(placed.groupBy("block").agg(F.min("dealt").alias("dealt"), F.min("first").alias("first"), F.min("rows").alias("rows"), F.array_sort(F.collect_list(F.struct("place", "key", "leaf", "also"))).alias("members")))
    grown = _subtree(blocks, levels)
    state = grown.select("block", "dealt", "first", F.col(f"level_{levels}")[0].alias("root")).join(starts.select("dealt", "first", "blocks", "index", "ladder"), ["dealt", "first"])
    state = state.select("block", "first", "blocks", "index", "ladder", "root", F.array().cast(f"array<{_STEP}>").alias("path"))
    upper = _exchanged(materialise(state), most or 0, n_trees)
    whole = grown.join(upper, "block")
    each = F.transform("members", lambda m, j: F.struct(m["key"].alias("key"), m["leaf"].alias("leaf"), m["also"].alias("also"), F.concat(_inside(levels, j, F.col("rows")), F.col("path")).alias("proof")))
    out = whole.select("subroot", "root", F.explode(each).alias("x"))
    return out.select("x.key", "x.leaf", *(F.col(f"x.also.`{k}`") for k in also), "subroot", "root", "x.proof")
