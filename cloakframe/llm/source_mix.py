"""Mixing sources to target weights, with DataFrame operations only.

The words of a source are one stream (documents in pseudorandom order), packed
into blocks of ``block`` words. Every output shard of ``slots`` blocks draws the
source of each slot, which makes its counts multinomial with the targets as
probabilities. Slots of a source are numbered over all shards; those above the
source's target go to sources still below theirs, so totals are exact to a block.
Slot number g of a source takes the block whose place in a pseudorandom
permutation of the source's blocks is g modulo their number: each block is taken
once before any is taken again, three times at most.

Targets share the sum of all sizes by weight (5, 2, 1, repeated over the sources
by code point, null last); none is above three times its source, the excess being
shared again by weight (water filling).

Edge cases: null texts and texts without words have size 0 and are never taken;
a null source is a source; repeated rows are documents of their own; without words nothing is taken.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import materialize

WEIGHTS = (5, 2, 1)
MOST = 3  # a document is taken so many times at most
BLOCK = 128  # words
SLOTS = 4096  # blocks in an output shard
IN_A_BUCKET = 500  # rows numbered together inside a source
WORD = r"[^\x20\x09-\x0D]+"


@dataclass
class Mix:
    sources: DataFrame  # sid, skey, source_size, target, blocks, wanted
    plan: DataFrame  # shard, sid, g (number of the slot among those of its source), block
    parts: DataFrame  # row, sid, block, first (word in the document), words


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A key that is never null; sorts by code point with null last."""
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))


def _before(name: str, window) -> Column:
    return F.coalesce(F.sum(name).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def targets(sized: DataFrame, block: int) -> DataFrame:
    """One row per source: its number, size, target, blocks and wanted blocks."""
    sums = sized.groupBy("skey").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("documents"))
    # windows over the sources, of which there are few
    rows = sums.withColumn("sid", F.row_number().over(Window.orderBy("skey")) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("sid") % len(WEIGHTS) + 1).cast("int"))
    rows = rows.withColumn("weight", weight).withColumn("most", MOST * F.col("source_size").cast("double"))
    everything = Window.partitionBy()
    by_level = Window.orderBy(F.col("most") / F.col("weight"), "sid")
    rows = rows.withColumn("total", F.sum("source_size").over(everything)).withColumn("full", _before("most", by_level))
    rows = rows.withColumn("open", F.sum("weight").over(everything) - _before("weight", by_level)).withColumn("place", F.row_number().over(by_level))
    level = (F.col("total") - F.col("full")) / F.col("open")
    fits = level * F.col("weight") <= F.col("most") * (1 + 1e-12)
    rows = rows.withColumn("level", F.min_by(F.when(fits, level), F.when(fits, F.col("place"))).over(everything))
    rows = rows.withColumn("target", F.least("most", F.coalesce("level", F.lit(0.0)) * F.col("weight")))
    rows = rows.withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    wanted = F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("blocks") / F.col("source_size"))).otherwise(0.0)
    return rows.withColumn("wanted", F.least(wanted.cast("long"), MOST * F.col("blocks"))).select("sid", "skey", "documents", "source_size", "target", "blocks", "wanted")


def _numbered(rows: DataFrame, buckets: Column, hashed: Column, order: list[str], amount: Column, name: str) -> DataFrame:
    """Sum of ``amount`` before each row of its source, in order of (bucket of the hash, hash, ``order``).

    A source is cut into ``buckets`` of a bounded number of rows, so a source of a
    third of all rows is many windows; one offset per bucket joins them.
    """
    placed = rows.withColumn("_h", hashed).withColumn("_bucket", F.pmod(F.col("_h"), F.greatest(buckets, F.lit(1)))).withColumn("_n", amount)
    inside = Window.partitionBy("sid", "_bucket").orderBy("_h", *order)
    local = placed.withColumn("_local", _before("_n", inside))
    sums = placed.groupBy("sid", "_bucket").agg(F.sum("_n").alias("_sum"))
    offsets = sums.select("sid", "_bucket", _before("_sum", Window.partitionBy("sid").orderBy("_bucket")).alias("_offset"))
    return local.join(_sorted(offsets), ["sid", "_bucket"]).withColumn(name, F.col("_local") + F.col("_offset")).drop("_h", "_bucket", "_n", "_local", "_offset")


def _exploded(rows: DataFrame, count: Column, name: str, chunk: int = 4096) -> DataFrame:
    """``name`` from 0 to ``count`` - 1 for each row, dealt out in chunks so that a large count is many tasks."""
    chunks = rows.where(count > 0).withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((count - 1) / chunk)))).repartition("sid", "_chunk")
    last = F.least(count - 1, (F.col("_chunk") + 1) * chunk - 1)
    return chunks.withColumn(name, F.explode(F.sequence(F.col("_chunk") * chunk, last))).drop("_chunk")


def _sorted(rows: DataFrame) -> DataFrame:
    """Keeps a side that grows with the words out of a broadcast: its size is estimated from the few sources it is made of."""
    return rows.hint("merge")


def mix(sized: DataFrame, block: int = BLOCK, slots: int = SLOTS, seed: int = 17) -> Mix:
    """The mix of ``sized``, a written table of ``row, skey, size, hash``.

    ``row`` is unique, ``hash`` orders the rows of a source; rows of equal hash are alike.
    """
    spark = sized.sparkSession
    sources = materialize(targets(sized, block), "sources")
    drawn = int(sources.agg(F.coalesce(F.sum("wanted"), F.lit(0))).first()[0])
    # where each document lies in its source's stream, and its share of each block
    # the sources become a broadcast only if their measured size allows
    placed = sized.where(F.col("size") > 0).join(sources.select("sid", "skey", "documents"), "skey")
    placed = _numbered(placed, F.ceil(F.col("documents") / IN_A_BUCKET), F.col("hash"), ["row"], F.col("size"), "start")
    end = F.col("start") + F.col("size")
    parts = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))))
    first = F.greatest(F.col("block") * block, F.col("start"))
    parts = parts.select("row", "sid", "block", (first - F.col("start")).alias("first"), (F.least((F.col("block") + 1) * block, end) - first).alias("words"))
    # the permutation of each source's blocks: ranks of their hashes
    blocks = _exploded(sources.select("sid", "blocks"), F.col("blocks"), "block")
    blocks = _numbered(blocks, F.ceil(F.col("blocks") / IN_A_BUCKET), F.xxhash64(F.lit(seed + 1), "sid", "block"), ["block"], F.lit(1), "place")
    # draws: slot number q of all shards takes a random one of all wanted blocks, and with it a source
    order = Window.orderBy("sid")
    owners = _exploded(sources.withColumn("_from", _before("wanted", order)).select("sid", "wanted", "_from"), F.col("wanted"), "_i")
    owners = owners.select("sid", (F.col("_from") + F.col("_i")).alias("ticket"))
    tickets = spark.range(drawn).select(F.floor(F.col("id") / slots).alias("shard"), F.pmod(F.xxhash64(F.lit(seed + 2), "id"), F.lit(max(drawn, 1))).alias("ticket"))
    counts = materialize(tickets.join(_sorted(owners), "ticket").groupBy("shard", "sid").agg(F.count(F.lit(1)).alias("n")), "draws")
    got = sources.join(counts.groupBy("sid").agg(F.sum("n").alias("got")), "sid", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    got = got.withColumn("over", F.greatest(F.col("got") - F.col("wanted"), F.lit(0))).withColumn("under", F.greatest(F.col("wanted") - F.col("got"), F.lit(0)))
    got = got.select("sid", "blocks", "wanted", "got", "under", _before("over", order).alias("over_from"), _before("under", order).alias("under_from"))
    # joins with the sources come before counts become slots
    by_shard = Window.partitionBy("sid").orderBy("shard")
    slotted = counts.withColumn("_first", _before("n", by_shard)).join(got.select("sid", "blocks", "wanted", "over_from"), "sid")
    slotted = slotted.withColumn("g", F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("n") - 1)))
    keep = slotted.where(F.col("g") < F.col("wanted")).select("shard", "sid", "blocks", "g")
    spare = slotted.where(F.col("g") >= F.col("wanted")).select("shard", (F.col("over_from") + F.col("g") - F.col("wanted")).alias("_t"))
    need = _exploded(got, F.col("under"), "_i").select("sid", "blocks", (F.col("under_from") + F.col("_i")).alias("_t"), (F.col("got") + F.col("_i")).alias("g"))
    taken = keep.unionByName(spare.join(_sorted(need), "_t").select("shard", "sid", "blocks", "g"))
    plan = taken.withColumn("place", F.pmod(F.col("g"), F.col("blocks"))).join(_sorted(blocks.select("sid", "place", "block")), ["sid", "place"])
    return Mix(sources, plan.select("shard", "sid", "g", "block"), parts)


def uses(found: Mix) -> DataFrame:
    """``row, first, words, uses`` of each part of a document that the mix takes."""
    often = found.plan.groupBy("sid", "block").agg(F.count(F.lit(1)).alias("uses"))
    return found.parts.join(_sorted(often), ["sid", "block"]).select("row", "first", "words", "uses")


def source_mix(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every document."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), source_key(F.col("source")).alias("skey"), word_count(F.col("text").cast("string")).alias("size"))
    # the order follows from the rows' own values, so that a rerun gives the same mix
    rows = materialize(named.withColumn("hash", F.xxhash64(F.lit(17), "doc_id", "skey", "size")).withColumn("row", F.monotonically_increasing_id()), "sized")
    found = mix(rows.select("row", "skey", "size", "hash"))
    taken = uses(found).groupBy("row").agg(F.sum(F.col("words") * F.col("uses")).alias("taken"))
    per_source = found.sources.select("skey", "source_size", "target")
    return (
        rows.join(per_source, "skey").join(taken, "row", "left")
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    )


def mixed_texts(docs: DataFrame) -> DataFrame:
    """``docs`` with the words the mix takes: whole texts as they are, parts cut at words, repeated parts repeated.

    Documents of which nothing is taken are gone; the other columns stay.
    """
    columns = docs.columns
    own = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])  # names that cannot clash
    name = {c: f"c{i}" for i, c in enumerate(columns)}
    text, source = F.col(name["text"]), F.col(name["source"])
    keyed = own.withColumn("skey", source_key(source)).withColumn("size", word_count(text))
    keyed = keyed.withColumn("hash", F.xxhash64(F.lit(17), name["doc_id"], "skey", name["text"])).withColumn("row", F.monotonically_increasing_id())
    rows = materialize(keyed, "keyed")
    found = mix(rows.select("row", "skey", "size", "hash"))
    parts = uses(found).groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("first", "words", "uses"))).alias("parts"), F.sum("words").alias("once"), F.max("uses").alias("most"))
    # a word with the white space after it, so that parts keep their line feeds
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"), F.lit(1))
    cut = lambda p: F.array_join(F.slice(F.col("_words"), (p["first"] + 1).cast("int"), p["words"].cast("int")), "")
    again = lambda p: F.concat(F.array_join(F.array_repeat(F.rtrim(cut(p)), p["uses"].cast("int")), "\n"), F.lit("\n"))
    joined = rows.join(parts, "row")
    whole = (F.col("once") == F.col("size")) & (F.col("most") == 1)
    some = joined.withColumn("_words", F.when(~whole, words))
    mixed = F.array_join(F.transform("parts", lambda p: F.when(p["uses"] == 1, cut(p)).otherwise(again(p))), "")
    return some.withColumn(name["text"], F.when(whole, text).otherwise(mixed)).select(*[F.col(name[c]).alias(c) for c in columns])
