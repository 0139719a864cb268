"""A Merkle manifest of a dataset: a content-addressed DAG of digests, and inclusion proofs by descent from its root.

Leaves are ranked within their group; every ``fanout`` consecutive nodes become the digest of their digests, level by level,
until one is left (the last run may be shorter, down to one node). The subroots of the groups, in order, form one more
tree of the same kind.

The tree is stored in records by digest: a record holds the nodes of ``levels`` levels below its digest, so a record
is what one task makes of at most ``fanout ** levels`` consecutive nodes, and building and descending take one round per
``levels`` levels. A proof descends from the root: a request looks its record up by digest, the digits of its rank
choose a child per level, the children not chosen are collected, and the child's digest is the next request. Requests that
share a prefix of their ranks are one request until they part, so the root is looked up once, not once per leaf. Reversed,
the collected segments are the path from the leaf to the root.

Defined cases: a null group is a group of its own, first in order; null ids come first in their group; rows that are
equal in group and id are ordered by their leaf, and equal leaves are leaves each; a null field is written ``-``, an
empty text ``0:``; an empty table has no rows and no root; columns other than the named ones are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import saved
from shelfmark.session import cut


@dataclass(frozen=True)
class Shape:
    fanout: int = 2
    levels: int = 8  # levels per record

    @property
    def width(self) -> int:
        return self.fanout**self.levels


def field(value: Column) -> Column:
    """Unambiguous form of one value: its length in bytes, a colon, the value; ``-`` for null."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def depth(total: Column, fanout: int) -> Column:
    """Levels above the leaves until one node is left."""
    out, power, d = F.when(total <= 1, 0), 1, 0
    while power < 1 << 62:
        power, d = power * fanout, d + 1
        out = out.when(total <= min(power, (1 << 63) - 1), d)
    return out


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``rank``, the 0-based place in the group, and ``total``, the group's rows.

    The rows are range-sorted and cut, so a large group is spread over many tasks; ranks are the rows of the group in
    earlier partitions plus the place in the partition."""
    keys = [F.col(group).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order]]
    placed = cut(rows.orderBy(*keys)).withColumn("_at", F.monotonically_increasing_id())
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    counts = placed.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    along = Window.partitionBy(group)
    counts = counts.select(
        F.col(group).alias("_group"), F.col("_part").alias("_of"), "_first", F.sum("_n").over(along).alias("total"),
        (F.sum("_n").over(along.orderBy("_part")) - F.col("_n")).alias("_before"),
    )
    found = placed.join(counts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_of")))
    return found.withColumn("rank", F.col("_before") + F.col("_at") - F.col("_first")).drop("_at", "_part", "_group", "_of", "_first", "_before")


def _raised(nodes: Column, levels: Column, shape: Shape) -> Column:
    """The node lists of a record: the given nodes, then each level above them; the last holds one digest."""

    def above(lists, _):
        last = F.element_at(lists, -1)
        runs = F.sequence(F.lit(0), F.floor((F.size(last) - 1) / F.lit(shape.fanout)).cast("int"))
        joined = F.transform(runs, lambda j: F.sha2(F.array_join(F.slice(last, j * shape.fanout + 1, shape.fanout), ""), 256))
        return F.concat(lists, F.array(joined))

    steps = F.slice(F.sequence(F.lit(1), F.lit(shape.levels)), F.lit(1), levels)
    return F.aggregate(steps, F.array(nodes), above)


@dataclass
class Forest:
    """``rounds`` from the leaves up: group, prefix, depth, root (digest), lists (the record), and in the first round payload."""

    shape: Shape
    rounds: list[DataFrame]

    def records(self) -> DataFrame:
        """digest, children: one row per inner node."""
        out = None
        for table in self.rounds:
            pair = F.arrays_zip(F.col("above").alias("digest"), F.transform(
                F.sequence(F.lit(0), F.size("above") - 1), lambda j: F.slice(F.col("below"), j * self.shape.fanout + 1, self.shape.fanout)
            ).alias("children"))
            lists = table.filter(F.size("lists") > 1)
            lists = lists.select("lists", F.explode(F.sequence(F.lit(1), F.size("lists") - 1)).alias("_l"))
            lists = lists.select(F.expr("lists[_l]").alias("above"), F.expr("lists[_l - 1]").alias("below")).select(F.inline(pair))
            out = lists if out is None else out.unionAll(lists)
        return out.dropDuplicates(["digest"])

    def roots(self) -> DataFrame:
        """group, root."""
        out = None
        for i, table in enumerate(self.rounds):
            top = table.filter((F.col("depth") <= (i + 1) * self.shape.levels) & (F.col("depth") > (i * self.shape.levels if i else -1))).select("group", "root")
            out = top if out is None else out.unionAll(top)
        return out


def build(leaves: DataFrame, shape: Shape = Shape()) -> Forest:
    """Trees of ``leaves``: group, rank, total, digest, payload."""
    leaves = cut(leaves.withColumn("depth", depth(F.col("total"), shape.fanout)).drop("total"))
    deepest = leaves.agg(F.max("depth")).first()[0] or 0
    rounds, nodes, done = [], leaves, 0
    while True:
        left = F.col("depth") - done
        item = F.struct("rank", "digest", *(["payload"] if done == 0 else []))
        prefix = F.floor(F.col("rank") / F.lit(shape.width)) if shape.fanout & (shape.fanout - 1) else F.shiftright("rank", shape.width.bit_length() - 1)
        runs = nodes.groupBy("group", prefix.cast("long").alias("prefix"), "depth").agg(F.sort_array(F.collect_list(item)).alias("items"))
        lists = _raised(F.col("items.digest"), F.greatest(F.lit(0), F.least(F.lit(shape.levels), left)), shape)
        columns = ["group", "prefix", "depth", lists.alias("lists")] + ([F.col("items.payload").alias("payload")] if done == 0 else [])
        table = runs.select(*columns).withColumn("root", F.element_at(F.element_at("lists", -1), 1))
        rounds.append(saved(table, f"merkle-{len(rounds)}"))
        done += shape.levels
        if done >= deepest:
            return Forest(shape, rounds)
        upper = rounds[-1].filter(F.col("depth") > done)
        nodes = upper.select("group", F.col("prefix").alias("rank"), "depth", F.col("root").alias("digest"))


def _unselected(lists: Column, child: Column, shape: Shape) -> Column:
    """(left, right) of a record's child, from the record's top level down: the digests beside the node chosen per level."""

    def beside(level):
        place = F.floor(child / F.pow(F.lit(float(shape.fanout)), level - 1)).cast("int")
        digit = F.pmod(place, F.lit(shape.fanout))
        run = F.slice(F.element_at(lists, level), place - digit + 1, shape.fanout)
        # a slice never reaches beyond the list, so the last run is short
        return F.struct(F.array_join(F.slice(run, F.lit(1), digit), "").alias("left"), F.array_join(F.slice(run, digit + 2, shape.fanout), "").alias("right"))

    down = F.reverse(F.slice(F.sequence(F.lit(1), F.lit(shape.levels)), F.lit(1), F.size(lists) - 1))
    return F.transform(down, beside)


def proofs(forest: Forest, start: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """group, rank, digest, payload, path of the leaves: path is an array of (left, right) from the leaf upwards.

    ``start`` has group, digest (the group's root) and path (from the overall root down to it). ``requests`` (group, rank)
    limits the descent to the leaves asked for; their prefixes are the requests of the rounds above."""
    shape, tops = forest.shape, len(forest.rounds)
    state = None
    for i in reversed(range(tops)):
        table, span = forest.rounds[i], shape.levels * (i + 1)
        begins = (F.col("depth") <= span) & (F.col("depth") > (span - shape.levels if i else -1))
        mine = table.filter(begins).select(F.col("group").alias("_g"), "prefix", "root")
        entering = start.join(mine, F.col("group").eqNullSafe(F.col("_g")) & (F.col("digest") == F.col("root")))
        entering = entering.select("group", F.col("digest").alias("subroot"), "prefix", "digest", "path")
        state = entering if state is None else state.unionAll(entering)
        if requests is not None:
            wanted = requests.select(F.col("group").alias("_g"), F.floor(F.col("rank") / F.lit(shape.width ** (i + 1))).cast("long").alias("_p")).distinct()
            state = state.join(wanted, F.col("group").eqNullSafe(F.col("_g")) & (F.col("prefix") == F.col("_p")), "left_semi")
        # content-addressed: whatever has this digest has these children
        records = table.groupBy(F.col("root").alias("digest")).agg(F.first("lists").alias("lists"))
        found = state.join(records, "digest")
        if i == 0:
            leaves = table.select(F.col("group").alias("_g"), F.col("prefix").alias("_p"), "payload")
            found = found.join(leaves, F.col("group").eqNullSafe(F.col("_g")) & (F.col("prefix") == F.col("_p")))
        children, last = F.element_at("lists", 1), i == 0

        def child(place):
            item = [F.element_at("payload", place + 1).alias("payload")] if last else []
            below = F.concat("path", _unselected(F.col("lists"), place, shape))
            return F.struct((F.col("prefix") * shape.width + place).alias("prefix"), F.element_at(children, place + 1).alias("digest"), below.alias("path"), *item)

        # the outer form keeps the array from being computed twice
        state = found.select("group", "subroot", F.inline_outer(F.transform(F.sequence(F.lit(0), F.size(children) - 1), child)))
    if requests is not None:
        asked = requests.select(F.col("group").alias("_g"), F.col("rank").alias("_p")).distinct()
        state = state.join(asked, F.col("group").eqNullSafe(F.col("_g")) & (F.col("prefix") == F.col("_p")), "left_semi")
    return state.select("group", F.col("prefix").alias("rank"), "digest", "subroot", "payload", F.reverse("path").alias("path"))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda own, step: F.sha2(F.concat(step["left"], own, step["right"]), 256))


def siblings(path: Column) -> Column:
    """All digests of a path, from the leaf upwards, each level from left to right."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "")


PATH = "array<struct<left: string, right: string>>"


def manifest(rows: DataFrame, group: str, order: list[str], leaf: Column, payload: Column, shape: Shape = Shape(), requests: DataFrame | None = None) -> DataFrame:
    """group, rank, leaf, payload, subroot, root, path of all rows, or of the requested (group, rank)."""
    leaves = rows.select(F.col(group).alias("group"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], leaf.alias("digest"), payload.alias("payload"))
    keys = [f"_o{i}" for i in range(len(order))] + ["digest"]
    forest = build(ranked(leaves, "group", keys).select("group", "rank", "total", "digest", "payload"), shape)
    subroots = cut(forest.roots())
    # the groups are the leaves of one more tree
    names = subroots.select(F.lit(0).alias("all"), "group", F.col("root").alias("digest"))
    over = ranked(names, "all", ["group"]).select(F.col("all").alias("group"), "rank", "total", "digest", F.struct("group").alias("payload"))
    top = build(over, shape)
    whole = top.roots()
    none = F.array().cast(PATH)
    start = proofs(top, whole.select("group", F.col("root").alias("digest"), none.alias("path")))
    start = cut(start.select(F.col("payload.group").alias("group"), "digest", F.reverse("path").alias("path")))
    found = proofs(forest, start, requests).withColumnRenamed("digest", "leaf")
    root = whole.first()
    return found.withColumn("root", F.lit(root["root"] if root else None).cast("string"))
