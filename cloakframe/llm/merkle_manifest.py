"""A Merkle manifest of a table: leaves, roots and the proof of every row, by sibling joins.

Nodes of a level are numbered within their tree. A run of ``ARITY`` nodes shares a
parent; the siblings of a node are found by equijoins with computed indices: with two
nodes to a run the index is flipped by XOR, with more each slot offset is one join.
The row in slot zero, which then holds its whole run, emits the parent. Levels are
written, so a lost executor repeats one level only; going down again, each node puts
its own siblings before the path of its parent.

There is one tree per language (leaves ascend by doc_id, rows of one doc_id by their
leaf), and one tree over the roots of the languages (null first, then by UTF-8 bytes).

Edge cases: every null value counts as ``-``, so null and empty differ; a null doc_id
comes first in its language and is never tampered with; repeated rows are leaves each on
their own (which of two equal leaves gets which place does not show, since their rows differ
in the place only); texts of any length are hashed whole in the scan; an empty table has no
rows and no root; columns besides the five named ones are ignored, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import materialize, width_for

ARITY = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BROADCAST_ROWS = 10_000
BROADCAST_BYTES = 4_000_000
_LOW_BITS = 33


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*[p.cast("binary") for p in parts]), 256)


def field(value: Column) -> Column:
    """A value with its length in bytes before it, so that no two rows spell the same; null as ``-``."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(changed_text: Column | None = None) -> Column:
    return digest(*[field(changed_text if c == "text" and changed_text is not None else F.col(c)) for c in FIELDS])


def ordered_leaves(rows: DataFrame) -> DataFrame:
    """``rows(lang, doc_id, leaf, ...)`` with ``tree`` (place of the language), ``i`` (place in it) and ``n`` (its rows).

    Rows are range-partitioned and written in order; what is combined afterwards is
    one row per pair of range and language, not per row.
    """
    order = [F.col("lang").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf")]
    width = width_for(rows.sparkSession, 0, 1)
    placed = rows.repartitionByRange(width, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = materialize(placed, "leaves")
    placed = placed.withColumn("_part", F.shiftright("_at", _LOW_BITS)).withColumn("_pos", F.col("_at").bitwiseAND(F.lit((1 << _LOW_BITS) - 1)))
    blocks = placed.groupBy("_part", "lang").agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n"))
    by_lang = Window.partitionBy("lang")
    before = by_lang.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).withColumn("n", F.sum("_n").over(by_lang))
    # a range that begins a language adds one tree; ranges are in order of languages, so trees follow (range, place)
    begins = blocks.where(F.col("_shift") == -F.col("_first")).select("_part", F.col("_first").alias("_begin"), F.col("lang").alias("_lang"))
    trees = _numbered(begins)
    blocks = blocks.join(trees, blocks["lang"].eqNullSafe(trees["_lang"])).select("_part", F.col("lang").alias("_lang"), "_shift", "n", "tree")
    blocks = materialize(blocks, "leafblocks")
    size = blocks.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("_lang")), F.lit(0))).first()
    if size[0] <= BROADCAST_ROWS and size[1] <= BROADCAST_BYTES:
        blocks = F.broadcast(blocks)
    joined = placed.join(blocks, (placed["_part"] == blocks["_part"]) & placed["lang"].eqNullSafe(blocks["_lang"]))
    return joined.withColumn("i", F.col("_pos") + F.col("_shift")).drop("_at", "_part", "_pos", "_shift", "_lang")


def _numbered(begins: DataFrame) -> DataFrame:
    """``_lang, tree``: languages numbered from 0; sums of ranges first, then places within a range."""
    ranges = begins.groupBy("_part").agg(F.count(F.lit(1)).alias("_m"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = ranges.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_m").over(earlier), F.lit(0)).alias("_o"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("_begin"))
    return begins.withColumn("_k", inside).join(F.broadcast(offsets), F.col("_part") == F.col("_p")).select("_lang", (F.col("_o") + F.col("_k") - 1).alias("tree"))


def with_siblings(nodes: DataFrame, arity: int = ARITY) -> DataFrame:
    """``nodes(tree, i, n, h)`` with ``p`` (parent), ``slot``, ``before`` and ``after``: digests of the run's other nodes, left and right.

    Every node sends its digest to the computed indices of its siblings, ``arity - 1`` rows at most, and is joined
    with what was sent to its own index; the join leaves them partitioned as the grouping needs them.
    """
    slot = F.pmod("i", F.lit(arity))
    shifted = lambda d: F.col("i").bitwiseXOR(F.lit(1).cast("long")) if arity == 2 else F.col("i") - slot + F.pmod(slot + d, F.lit(arity))
    targets = F.array(*[shifted(d) for d in range(1, arity)])
    sent = nodes.select("tree", "n", F.col("i").alias("_from"), F.explode(targets).alias("_to"), F.col("h").alias("_h"))
    sent = sent.where(F.col("_to") < F.col("n")).select(F.col("tree").alias("_tree"), "_from", "_to", "_h").hint("merge")
    met = nodes.join(sent, (nodes["tree"] == sent["_tree"]) & (nodes["i"] == sent["_to"]), "left")
    rest = [c for c in nodes.columns if c not in ("tree", "i")]
    runs = met.groupBy("tree", "i").agg(*[F.first(c).alias(c) for c in rest], F.array_sort(F.collect_list(F.when(F.col("_from").isNotNull(), F.struct("_from", "_h")))).alias("_run"))
    side = lambda kept: F.concat_ws("", F.transform(F.filter("_run", kept), lambda x: x["_h"]))
    before, after = side(lambda x: x["_from"] < F.col("i")), side(lambda x: x["_from"] > F.col("i"))
    return runs.select(*nodes.columns, F.expr(f"i div {arity}").alias("p"), slot.alias("slot"), before.alias("before"), after.alias("after"))


def grow(nodes: DataFrame, largest: int, arity: int = ARITY) -> list[DataFrame]:
    """All levels of all trees with their siblings, leaves first; the largest tree has ``largest`` leaves."""
    levels = []
    while True:
        # trees of one node are done: nothing is joined to them
        level = with_siblings(nodes.where("n > 1"), arity) if largest > 1 else None
        done = nodes.where("n = 1").select("*", F.lit(None).cast("long").alias("p"), F.lit(0).cast("long").alias("slot"), F.lit("").alias("before"), F.lit("").alias("after"))
        levels.append(materialize(done if level is None else level.unionByName(done), "level"))
        if largest <= 1:
            return levels
        first = levels[-1].where((F.col("slot") == 0) & (F.col("n") > 1))
        nodes = first.select("tree", F.col("p").alias("i"), F.expr(f"(n + {arity - 1}) div {arity}").alias("n"), digest(F.col("h"), F.col("after")).alias("h"))
        largest = -(-largest // arity)


def _step() -> Column:
    return F.array(F.struct("before", "after"))


def paths(levels: list[DataFrame], above: DataFrame | None = None) -> DataFrame:
    """The leaves of ``grow`` with ``path``, an array of ``(before, after)`` up to the root, and ``top``, their tree's root.

    ``above(tree, up)``: path of each tree's root within a tree over the trees.
    """
    known: DataFrame | None = None
    for level in reversed(levels):
        own = level.where("n = 1").withColumn("top", F.col("h"))
        if above is None:
            own = own.withColumn("path", F.array().cast("array<struct<before:string,after:string>>"))
        else:
            up = above.select(F.col("tree").alias("_t"), F.col("up").alias("path"))
            own = own.join(up, own["tree"] == up["_t"]).drop("_t")
        if known is None:
            known = own
        else:
            parents = known.select(F.col("tree").alias("_t"), F.col("i").alias("_i"), F.col("top"), F.col("path").alias("_up"))
            below = level.where("n > 1")
            below = below.join(parents, (below["tree"] == parents["_t"]) & (below["p"] == parents["_i"]))
            below = below.withColumn("path", F.concat(_step(), F.col("_up"))).drop("_t", "_i", "_up")
            known = below.unionByName(own, allowMissingColumns=True)
        if level is not levels[0]:
            known = materialize(known.select("tree", "i", "top", "path"), "paths")
    return known


def folded(start: Column, path: Column) -> Column:
    """The root that ``start`` leads to when it takes the place of its leaf."""
    return F.aggregate(path, start, lambda h, step: digest(step["before"], h, step["after"]))


def proof(path: Column) -> Column:
    return digest(F.concat_ws("", F.transform(path, lambda step: F.concat(step["before"], step["after"]))))


def manifest(docs: DataFrame, changed: Column | None = None, arity: int = ARITY) -> tuple[DataFrame, str | None]:
    """``doc_id, lang, leaf, changed_leaf, subroot, path`` of each row, and the root of the table (null if it is empty).

    ``changed``: the text to compare with, for example what a copy of the table holds; null where it has not changed.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars"), F.col("text").cast("string").alias("text"))
    changed = F.lit(None).cast("string") if changed is None else changed
    hashed = rows.select("doc_id", "lang", leaf().alias("leaf"), F.when(changed.isNotNull(), leaf(changed)).alias("changed_leaf"))
    leaves = materialize(ordered_leaves(hashed).withColumnRenamed("leaf", "h"), "places")
    trees = leaves.where("i = 0").select("tree", "n")
    sizes = trees.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    empty = "doc_id long, lang string, leaf string, changed_leaf string, subroot string, path array<struct<before:string,after:string>>"
    if not sizes[2]:
        return docs.sparkSession.createDataFrame([], empty), None
    levels = grow(leaves.select("tree", "i", "n", "h", "doc_id", "lang", "changed_leaf"), sizes[1], arity)
    tops = None
    for level in levels:
        found = level.where("n = 1").select(F.col("tree").alias("i"), "h")
        tops = found if tops is None else tops.unionByName(found)
    tops = tops.select(F.lit(0).cast("long").alias("tree"), "i", F.lit(sizes[0]).cast("long").alias("n"), "h")
    upper = grow(materialize(tops, "subroots"), sizes[0], arity)
    root = upper[-1].where("n = 1").first()["h"]
    above = materialize(paths(upper).select(F.col("i").alias("tree"), F.col("path").alias("up")), "upper")
    found = paths(levels, above)
    return found.select("doc_id", "lang", F.col("h").alias("leaf"), "changed_leaf", F.col("top").alias("subroot"), "path"), root


def tampered_text() -> Column:
    """The text with A-Z lower-cased where 3 divides the CRC-32 of the decimal doc_id; null elsewhere."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return F.when(hit, F.translate("text", string.ascii_uppercase, string.ascii_lowercase))


def verified_manifest(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` after tampering with some texts."""
    found, root = manifest(docs, tampered_text())
    top = F.lit(root).cast("string")
    out = found.select("doc_id", "leaf", "subroot", top.alias("root"), proof(F.col("path")).alias("proof_sha256"),
                       folded(F.coalesce("changed_leaf", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
