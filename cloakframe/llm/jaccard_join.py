"""Documents whose sets of word n-grams are similar, by prefixes of token combinations.

Tokens are hashed word n-grams, ordered from rare to frequent by a census of the
whole corpus. Two sets at or above the threshold differ in so few tokens that a
prefix of this order must share some; tokens of fewer than ``FREQUENT`` sets are
signatures by themselves, more frequent ones only as pairs within a class (classes
by hash, as many as suit the size of the set). A class of pairs survives as many
missing tokens as it has beyond one, so prefixes are extended until all classes
together survive more than a similar set can miss. Tokens of one document only are
counted there, but never sent. Sets that share a signature are verified exactly.

Documents with equal sets are one set. Sets that share signatures form candidate
clusters; a cluster is compared in blocks of bounded size. Large clusters are
compared in two rounds: within blocks and with the first block, then only sets
outside the cluster's main component with all others. That gives every component
without all pairs of a group of copies.

Edge cases: a null text and a text without words have the empty set and link with
nothing; fewer words than the n-gram are one token; rows with the same doc_id are
one node; a null doc_id links with nothing; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import materialize
from .components import components, local_roots
from .shards import KEY_BITS, NO_ID, RANGE_BYTES, census, codes_of, in_order, parts, sharded
from .text import Scan, mix, settled, shingles

FREQUENT = 5  # code of the census (bits of the count) from which tokens count as frequent: 16 sets
BLOCK_SETS = 256
BLOCK_TOKENS = 400_000
_SHIFT = np.uint64(64 - KEY_BITS)
_PAIR = np.uint64(0xD6E8FEB86659FD93)


def token_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens of each document, sorted by (document, token)."""
    scan = Scan(texts, lower=True)
    first, last, counts = scan.words()
    return shingles(scan.hashes(first, last), counts, n)


def _keys(n: int) -> Callable:
    def keys(ids: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [token_sets(part, n)[1] >> _SHIFT for _, part in parts(texts)]
        return np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    return keys


def _bits(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(count.astype(np.float64))[1], 63)


def missing(size: int, per_cent: int) -> int:
    """Tokens of a set of ``size`` that a set at the threshold can lack, at most."""
    return size - -(-per_cent * size // 100)


def bands(size: int, per_cent: int) -> tuple[int, int]:
    """Two neighbouring bands of sizes; sets that can be similar share one."""
    b = int(np.log(size) / -np.log(per_cent / 100 - 0.01))
    return b, b + 1


def classes(band: int, per_cent: int) -> int:
    """Classes of frequent tokens in a band: about two tokens that a set can miss for each."""
    return max(1, int((100 / (per_cent - 1)) ** band * (1 - per_cent / 100) / 2))


def signatures(tokens: np.ndarray, code: np.ndarray, per_cent: int) -> np.ndarray:
    """Signatures of one set: of its tokens (uint64) and their census codes."""
    n = len(tokens)
    need = missing(n, per_cent) + 1
    order = np.lexsort((tokens, code))
    tokens, code = tokens[order], code[order]
    rare = code < FREQUENT
    singles = int(rare.sum())
    if singles >= need:
        use = tokens[:need][code[:need] > 1]
        return mix(use)
    out = [mix(tokens[:singles][code[:singles] > 1])]
    frequent = tokens[singles:]
    for band in bands(n, per_cent):
        m = classes(band, per_cent)
        which = (mix(frequent ^ np.uint64(band)) % np.uint64(m)).astype(np.int64)
        # a class counts from its second token on: extend until enough are covered
        by_class = np.argsort(which, kind="stable")
        again = np.zeros(len(frequent), bool)
        again[by_class[1:]] = which[by_class][1:] == which[by_class][:-1]
        covered = np.cumsum(again)
        end = int(np.searchsorted(covered, need - singles)) + 1
        some, own = frequent[:end], which[:end]
        order = np.argsort(own, kind="stable")
        some, own = some[order], own[order]
        step = 1
        while step < len(some):
            pair = np.flatnonzero(own[step:] == own[:-step])
            if not len(pair):
                break
            a, b = some[pair], some[pair + step]
            out.append(mix(mix(np.minimum(a, b)) * _PAIR + np.maximum(a, b) + np.uint64(band)))
            step += 1
    return np.unique(np.concatenate(out))


def _signer(n: int, per_cent: int, ranges: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        _, ids, texts = in_order(docs)
        sets = [(len(part), *token_sets(part, n)) for _, part in parts(texts)]
        known, place = np.unique(np.concatenate([np.zeros(0, np.uint64), *[token for _, _, token in sets]]) >> _SHIFT, return_inverse=True)
        codes, at = codes_of(known, answers, ranges)[place], 0
        size, one, two, sign, raw = [], [], [], [], []
        seen: set[tuple[int, int, int]] = set()
        for count, doc, token in sets:
            code, at = codes[at : at + len(token)], at + len(token)
            edge = np.searchsorted(doc, np.arange(count + 1))
            for i in range(count):
                own = token[edge[i] : edge[i + 1]]
                a, b = (int(own.sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(mix(own + np.uint64(1))))) if len(own) else (0, 0)
                mark = (len(own), a, b)
                found = signatures(own, code[edge[i] : edge[i + 1]], per_cent) if len(own) and mark not in seen and ids[len(size)] != NO_ID else own[:0]
                seen.add(mark)
                size.append(len(own))
                one.append(a - (1 << 64) if a >> 63 else a)
                two.append(b - (1 << 64) if b >> 63 else b)
                sign.append(found.view(np.int64))
                raw.append(own.tobytes() if len(found) else None)
        edges = pa.array(np.cumsum([0, *map(len, sign)]), pa.int32())
        flat = pa.array(np.concatenate([np.zeros(0, np.int64), *sign]))
        return pa.table({
            "doc_id": pa.array([None if x == NO_ID else x for x in ids.tolist()], pa.int64()), "n": pa.array(size, pa.int64()), "one": pa.array(one, pa.int64()), "two": pa.array(two, pa.int64()),
            "signs": pa.ListArray.from_arrays(edges, flat), "tokens": pa.array(raw, pa.binary()),
        })

    return run


def similar(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, per_cent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of linked sets, one from ``left`` and one from ``right`` (arrays of indexes of ``sets``)."""
    size = np.array([len(s) for s in sets])
    known, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), size)
    shared = np.bincount(column, minlength=len(known)) > 1
    keep = shared[column]
    column, row = (np.cumsum(shared) - 1)[column[keep]], row[keep]
    both = np.zeros((len(left), len(right)), np.float32)
    width = 4096
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    for start in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, [start, start + width])
        part = np.zeros((len(sets), width), np.float32)
        part[row[a:b], column[a:b] - start] = 1
        both += part[left] @ part[right].T
    inter = both.astype(np.int64)
    close = 100 * inter >= per_cent * (size[left][:, None] + size[right][None, :] - inter)
    a, b = np.nonzero(close)
    return left[a], right[b]


def _compare(per_cent: int, main: bool):
    """Links among the sets of a group as stars around the smallest id; ``main``: only those of an asking set with another one."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids = table.column("id").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("tokens").to_pylist()]
        everyone = np.arange(len(ids))
        left = np.flatnonzero(np.asarray(table.column("asks").to_pylist(), bool)) if main else everyone
        a, b = similar(sets, left, everyone, per_cent)
        root = local_roots(a, b, len(ids))
        at = np.flatnonzero(root != everyone)
        large = main or table.column("blocks")[0].as_py() > 1
        return pa.table({"a": pa.array(ids[at]), "b": pa.array(ids[root[at]]), "large": pa.array(np.full(len(at), large))})

    return run


def _blocks(sets: DataFrame) -> DataFrame:
    """``sets`` with the number of blocks of their cluster, and their block."""
    size = sets.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("all"))
    number = F.ceil(F.greatest(F.col("members") / BLOCK_SETS, F.col("all") / BLOCK_TOKENS)).cast("int")
    sized = sets.join(size.select("cluster", "members", number.alias("blocks")), "cluster")
    return sized.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))


def _verified(entries: DataFrame, per_cent: int) -> DataFrame:
    """``id, component`` of every set of ``entries`` (``id, n, tokens, cluster``) that is not the smallest of its component."""
    sets = materialize(_blocks(entries), "sets")
    # first round: every block with itself and with block 0
    targets = F.when((F.col("blocks") > 1) & (F.col("block") == 0), F.sequence(F.lit(1), F.col("blocks") - 1)).otherwise(F.array("block"))
    first = sets.withColumn("target", F.explode(targets)).select("cluster", "target", "blocks", "id", "tokens")
    links = materialize(first.groupBy("cluster", "target").applyInArrow(settled(_compare(per_cent, False)), "a long, b long, large boolean"), "links")
    done = links.where("not large").select(F.col("a").alias("id"), F.col("b").alias("component"))
    large = sets.where("blocks > 1")
    if large.isEmpty():
        return done
    # second round: sets outside the main component of a large cluster ask all sets of the cluster
    label = components(links.where("large"))
    labelled = large.join(label, "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")
    counts = labelled.groupBy("cluster", "label").count()
    main = counts.groupBy("cluster").agg(F.max(F.struct("count", "label")).alias("m")).select("cluster", F.col("m.label").alias("main"))
    marked = materialize(labelled.join(main, "cluster").withColumn("outside", F.col("label") != F.col("main")), "marked")
    outside = marked.where("outside").groupBy("cluster").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_SETS, F.sum("n") / BLOCK_TOKENS)).cast("int").alias("groups"))
    marked = marked.join(outside, "cluster")  # clusters of one component are done
    asks = marked.where("outside").withColumn("g", F.pmod(F.xxhash64("id", F.lit(1)), F.col("groups")).cast("int"))
    asks = asks.withColumn("target", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("cluster", "g", "target", "id", "tokens", F.lit(True).alias("asks"))
    told = marked.withColumn("g", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).select("cluster", "g", F.col("block").alias("target"), "id", "tokens", F.lit(False).alias("asks"))
    more = asks.unionByName(told).groupBy("cluster", "g", "target").applyInArrow(settled(_compare(per_cent, True)), "a long, b long, large boolean")
    return done.unionByName(components(label.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more.select("a", "b"))))


def jaccard_join(docs: DataFrame, n: int = 5, per_cent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document; linked from ``per_cent`` hundredths of Jaccard similarity on."""
    shards = sharded(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    ranges = shards.ranges(RANGE_BYTES)
    counts = census(shards, _keys(n), _bits, ranges)
    signed = shards.docs.groupBy("shard").cogroup(counts.groupBy("shard")).applyInArrow(
        settled(_signer(n, per_cent, ranges)), "doc_id long, n long, one long, two long, signs array<long>, tokens binary")
    rows = materialize(signed, "signed")
    whole = rows.where("n > 0 and doc_id is not null")
    sets = materialize(whole.groupBy("n", "one", "two").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies")), "sets")
    # the one document of each set that speaks for it
    senders = rows.where(F.size("signs") > 0).join(sets.select("n", "one", "two", F.col("id").alias("doc_id")), ["n", "one", "two", "doc_id"])
    senders = senders.select(F.col("doc_id").alias("id"), "n", "signs", "tokens")
    entries = senders.select("id", F.explode("signs").alias("sign"))
    common = entries.groupBy("sign").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("times")).where("times > 1").drop("times")
    clusters = components(entries.join(common, "sign").select(F.col("id").alias("a"), F.col("least").alias("b")))
    # the smallest id of a cluster is no row of the components
    heads = clusters.select(F.col("component").alias("id")).distinct().withColumn("cluster", F.col("id"))
    members = clusters.select("id", F.col("component").alias("cluster")).unionByName(heads)
    label = _verified(senders.select("id", "n", "tokens").join(members, "id"), per_cent)
    # a doc_id with several texts links the sets of all of them, and names the component of its empty ones
    kinds = F.struct("n", "one", "two")
    named = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min(kinds).alias("low"), F.max(kinds).alias("high"))
    several = materialize(named.where("low <> high").select("doc_id"), "several")
    repeated = not several.isEmpty()
    if repeated:
        held = rows.join(several, "doc_id", "left_semi").select("doc_id", "n", "one", "two").distinct().join(sets, ["n", "one", "two"])
        label = materialize(components(label.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(held.select(F.col("doc_id").alias("a"), F.col("id").alias("b")))), "label")
    placed = sets.join(label, "id", "left").select("n", "one", "two", F.coalesce("component", "id").alias("component_id"))
    shown = ("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    bare = (F.col("n") == 0) & F.col("doc_id").isNotNull()
    full = rows.where(~bare) if repeated else rows
    out = full.select("doc_id", "n", "one", "two").join(placed, ["n", "one", "two"], "left").select(*shown)
    if not repeated:
        return out
    by_id = label.select(F.col("id").alias("doc_id"), F.col("component").alias("component_id"))
    return out.unionByName(rows.where(bare).select("doc_id", "n").join(by_id, "doc_id", "left").select(*shown))
