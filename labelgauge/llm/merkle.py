"""A Merkle manifest of a data set: one tree per group of rows, one tree over the groups' roots.

Every ``FAN`` consecutive nodes become their hash, level by level, until one node is left in the group;
a group of one row keeps its leaf. Only every ``EVERY``-th level is stored. A proof (the siblings of a
row's nodes, from leaf to root) is made from the top down: each aligned subtree of FAN ** EVERY stored
nodes is laid out again, its missing levels worked out, the siblings given to the nodes below, and the
inner nodes discarded. So a task holds one subtree at a time, whatever the size of a group; a group with
a third of all rows is that many more subtrees.

Rows are numbered within their group by ranges of (group, order) that one partition holds: counts per
partition and group give each range its first number. Rows alike in all of group, order and leaf are
interchangeable, so ties need no rule. A null group comes first, then groups by the bytes of their
names; a null order comes first. An empty table has no root.
"""

import hashlib

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from labelgauge.session import shared_dir
from labelgauge.sources.writers import stored

#: Nodes under one parent, and the levels from one stored level to the next.
FAN, EVERY = 16, 2
BLOCK = FAN**EVERY


def field(value):
    """A value as hashed: ``-`` if null, else its length in bytes, ``:``, and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values):
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _group_key(group):
    """The group as text that keeps the order of bytes, null first and apart from the empty name."""
    return F.coalesce(F.concat(F.lit("1"), group.cast("string")), F.lit("0"))


def _levels(n):
    """How many levels lie above the n leaves of a group: the hexadecimal digits of n - 1."""
    return F.when(n > 1, F.length(F.hex(n - 1))).otherwise(0)


def numbered(rows, spark):
    """Rows (gid, at, node, ...) with their number in the group and the group's size, stored.

    Ranges of (gid, at, node) are cut to partitions, so no group and no key meets in one task; rows alike
    in all three are spread by the place they were read from.
    """
    cut = rows.withColumn("_tie", F.monotonically_increasing_id())
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    cut = cut.repartitionByRange(parts, "gid", "at", "node", "_tie").withColumn("part", F.spark_partition_id())
    cut = stored(cut, shared_dir(spark, "merkle-order"))
    sizes = cut.groupBy("gid", "part").agg(F.count("*").alias("c"))
    group = Window.partitionBy("gid")
    before = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("gid", "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("first"), F.sum("c").over(group).alias("n"))
    within = Window.partitionBy("gid", "part").orderBy("at", "node", "_tie")
    placed = cut.withColumn("nth", F.row_number().over(within)).join(sizes, ["gid", "part"])
    placed = placed.withColumn("pos", F.col("first") + F.col("nth") - 1).drop("first", "nth", "part", "_tie")
    return stored(placed, shared_dir(spark, "merkle-leaves"))


def _parents(nodes, levels):
    """An array of nodes, some levels up."""
    if not levels:
        return nodes
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FAN).cast("int"))
    up = F.transform(runs, lambda j: F.sha2(F.array_join(F.slice(nodes, j * FAN + 1, F.lit(FAN)), ""), 256))
    return _parents(up, levels - 1)


def stored_levels(leaves, spark):
    """Tables (gid, height, pos, node) of every EVERY-th level; each group ends with its root."""
    base = leaves.select("gid", _levels(F.col("n")).alias("height"), "pos", "node")
    tables, top = [base], base.agg(F.max("height")).first()[0] or 0
    while len(tables) <= (top - 1) // EVERY + (top > 0):
        below = EVERY * (len(tables) - 1)
        nodes = tables[-1].where(F.col("height") > below).groupBy("gid", "height", F.floor(F.col("pos") / BLOCK).alias("pos"))
        nodes = nodes.agg(F.sort_array(F.collect_list(F.struct("pos", "node"))).alias("s")).withColumn("d", F.col("s.node"))
        steps = [(F.col("height") >= below + k, _parents(F.col("d"), k)) for k in range(EVERY, 0, -1)]
        node = F.coalesce(*[F.when(ok, up[0]) for ok, up in steps])
        tables.append(stored(nodes.select("gid", "height", "pos", node.alias("node")), shared_dir(spark, "merkle-level")))
    return tables


def _roots(tables):
    """(gid, node): the root of each group."""
    out = tables[0].where("height = 0").select("gid", "node")
    for s, t in enumerate(tables[1:], 1):
        out = out.unionByName(t.where(F.col("height") <= EVERY * s).select("gid", "node"))
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def subtree_paths(nodes, levels):
    """Per node of an aligned subtree, the (before, after) texts of its siblings, level by level."""
    paths, rank = [[] for _ in nodes], list(range(len(nodes)))
    for _ in range(levels):
        runs = ["".join(nodes[i : i + FAN]) for i in range(0, len(nodes), FAN)]
        for i, at in enumerate(rank):
            cut = 64 * (at % FAN)
            paths[i].append((runs[at // FAN][:cut], runs[at // FAN][cut + 64 :]))
        nodes, rank = [sha(run) for run in runs], [at // FAN for at in rank]
    return paths


def folded(node, path):
    """The root that a node and its siblings give."""
    for before, after in path:
        node = sha(before + node + after)
    return node


PATH = "array<struct<before:string,after:string>>"
SIDES = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))


def _blocks(nodes, above, stride, each, schema):
    """``each(nodes of a block in order, their paths to the root, the row above)`` for every aligned subtree.

    ``above`` has a row (gid, pos, path, ...) per subtree. The path within the subtree is worked out anew
    from its stored nodes.
    """
    keyed = nodes.withColumn("block", F.floor(F.col("pos") / BLOCK)).groupBy("gid", "block")

    def one(left, right):
        if not left.num_rows or not right.num_rows:
            raise ValueError("a subtree and the node above it do not match")
        left = left.sort_by("pos")
        top = right.slice(0, 1).to_pylist()[0]
        levels = min(EVERY, left.column("height")[0].as_py() - EVERY * stride)
        rest = [(x["before"], x["after"]) for x in top["path"]]
        paths = [own + rest for own in subtree_paths(left.column("node").to_pylist(), max(levels, 0))]
        return each(left, paths, top)

    return keyed.cogroup(above.withColumnRenamed("pos", "block").groupBy("gid", "block")).applyInArrow(one, schema)


def _paths_down(tables, tops, spark):
    """Rows (gid, pos, path, subroot) above the blocks of the leaves, from those above the groups' roots."""

    def each(left, paths, top):
        sides = [[{"before": b, "after": a} for b, a in path] for path in paths]
        return pa.table({"gid": left.column("gid"), "pos": left.column("pos"), "path": pa.array(sides, SIDES), "subroot": pa.array([top["subroot"]] * len(paths), pa.string())})

    above = None
    for s in range(len(tables) - 1, 0, -1):
        ends = tables[s].where(F.col("height") <= EVERY * s).select("gid", "pos").join(tops, "gid")
        inner = tables[s].where(F.col("height") > EVERY * s)
        rows = ends.select("gid", "pos", "path", "subroot")
        if above is not None:
            rows = rows.unionByName(_blocks(inner, above, s, each, f"gid string, pos bigint, path {PATH}, subroot string"))
        above = stored(rows, shared_dir(spark, "merkle-path"))
    single = tables[0].where("height = 0").select("gid", "pos").join(tops, "gid").select("gid", "pos", "path", "subroot")
    single = stored(single, shared_dir(spark, "merkle-path"))
    return single if above is None else above.unionByName(single)


class Manifest:
    """The trees of a data set: ``root``, ``subroots()``, and ``proofs()`` with a check of each row.

    ``rows`` has ``group``, ``order`` and ``leaf`` columns; ``altered`` is the leaf to be checked against
    the proof (the row's own leaf where null or not given). Other columns in ``keep`` come along.
    """

    def __init__(self, rows, group="group", order="order", leaf="leaf", altered=None, keep=()):
        self.spark = rows.sparkSession
        shadow = F.col(altered) if altered else F.lit(None).cast("string")
        held = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in keep]).alias("held")
        plain = rows.select(_group_key(F.col(group)).alias("gid"), F.col(order).alias("at"), F.col(leaf).alias("node"), shadow.alias("shadow"), held)
        self.keep, self.leaves = keep, numbered(plain, self.spark)
        self.tables = stored_levels(self.leaves, self.spark)
        groups = _roots(self.tables).select(F.lit("").alias("gid"), F.col("gid").alias("at"), "node")
        self.groups = numbered(groups, self.spark)
        self.over = stored_levels(self.groups, self.spark)
        root = _roots(self.over).first()
        self.root = root and root["node"]

    def subroots(self):
        return self.groups.select(F.when(F.col("at") != "0", F.substr("at", F.lit(2))).alias("group"), F.col("node").alias("subroot"))

    def _above_groups(self):
        """(gid, path, subroot): the siblings between each group's root and the root."""
        start = self.spark.range(1).select(F.lit("").alias("gid"), F.array().cast(PATH).alias("path"), F.lit("").alias("subroot"))
        start = stored(start, shared_dir(self.spark, "merkle-path"))
        above = _paths_down(self.over, start, self.spark)
        leaves = self.over[0].join(self.groups.select("pos", F.col("at").alias("name")), "pos")

        def each(left, paths, top):
            sides = [[{"before": b, "after": a} for b, a in path] for path in paths]
            return pa.table({"gid": left.column("name"), "path": pa.array(sides, SIDES), "subroot": left.column("node")})

        return _blocks(leaves, above, 0, each, f"gid string, path {PATH}, subroot string")

    def proofs(self):
        """Per row: leaf, subroot, root, siblings' hash, and the root that the checked leaf leads to."""
        tops = stored(self._above_groups(), shared_dir(self.spark, "merkle-groups"))
        above = _paths_down(self.tables, tops, self.spark)
        leaves = self.leaves.withColumn("height", _levels(F.col("n")))
        kind = leaves.schema["held"].dataType.simpleString()

        def each(left, paths, top):
            nodes, shadows = left.column("node").to_pylist(), left.column("shadow").to_pylist()
            proof = [sha("".join(b + a for b, a in path)) for path in paths]
            ends = [folded(x if y is None else y, path) for x, y, path in zip(nodes, shadows, paths)]
            subroot = pa.array([top["subroot"]] * len(nodes), pa.string())
            return pa.table({"held": left.column("held"), "leaf": left.column("node"), "subroot": subroot, "proof_sha256": proof, "folded_root": ends})

        schema = f"held {kind}, leaf string, subroot string, proof_sha256 string, folded_root string"
        rows = _blocks(leaves, above, 0, each, schema)
        root = F.lit(self.root).cast("string")
        return rows.select(
            *[F.col(f"held.`{c}`") for c in self.keep], "leaf", "subroot", root.alias("root"), "proof_sha256",
            "folded_root", (F.col("folded_root") == root).alias("verified"),
        )
