"""Removal of byte strings that a document with a smaller id holds too, by suffix arrays.

Two documents can share a string of ``LENGTH`` bytes only if they share the
smallest hash among its ``GRAM``-byte grams. So each document is cut into pieces,
runs of string starts with the same smallest hash, and only pieces whose hash a
census finds in two documents or more go on: equal pieces of a shard as one, to the
range of their hash. There, in turns, pieces are cut into blocks of bounded size. The
suffixes of a block that start a string are sorted to that depth by refinement of
unsorted groups (Larsson and Sadakane), Kasai's walk gives the common prefix of
neighbours, and prefixes of ``LENGTH`` or more join strings into classes with a
smallest document id. Blocks are merged by binary search of the classes of one in
the others. What is found goes back to the shards as spans of their documents.

A hash found more than ``HOT`` times (a passage of a third of all documents) is not
one group: its pieces are cut into single strings, dealt out by the hash of the whole string.

Edge cases: a null text is an empty one; a null doc_id counts as larger than any
other; rows with the same doc_id remove nothing from each other; shorter texts are kept whole; other columns stay as they are.
"""

from __future__ import annotations

import hashlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .shards import KEY_BITS, RANGE_BYTES, census, codes_of, in_order, packed, parts, sharded, unpacked
from .text import Scan, distinct, owner, settled

LENGTH = 50
GRAM = 20
LONGEST_RUN = 256  # string starts in a piece
HOT = 16_384  # documents of a hash above which its strings are dealt out one by one, each with all its bytes
BLOCK = 2_000_000  # bytes of pieces in a suffix array, at most 2**21 with the last piece
MATCH_BYTES = 4_000_000  # of the documents' text, matched at a time; a range is matched in turns
PART_BYTES = 100_000  # of text cut into pieces at a time
_SHIFT = np.uint64(64 - KEY_BITS)


def pieces(scan: Scan) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First string start, number of starts, key and document of each piece."""
    h = scan.grams(GRAM)
    window = LENGTH - GRAM + 1
    low, reach = h, 1
    while 2 * reach <= window:
        low = np.minimum(low[:-reach], low[reach:]) if len(low) > reach else low[:0]
        reach *= 2
    if window > reach and len(low) > window - reach:
        low = np.minimum(low[: len(low) - (window - reach)], low[window - reach :])
    starts = np.maximum(scan.size - LENGTH + 1, 0)
    doc = owner(starts)
    at = scan.start[doc] + np.arange(len(doc)) - (np.cumsum(starts) - starts)[doc]
    key = low[at] >> _SHIFT if len(at) else np.zeros(0, np.uint64)
    new = np.ones(len(at), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    run = np.diff(np.append(first, len(at)))
    cuts = -(-run // LONGEST_RUN)
    own = owner(cuts)
    offset = LONGEST_RUN * (np.arange(len(own)) - (np.cumsum(cuts) - cuts)[own])
    begin = first[own] + offset
    return at[begin], np.minimum(run[own] - offset, LONGEST_RUN), key[begin], doc[begin]


def _keys(ids: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    found = []
    for _, part in parts(texts, PART_BYTES):
        _, _, key, doc = pieces(Scan(part))
        found.append(distinct(doc, key)[1])
    return np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _kind(count: np.ndarray) -> np.ndarray:
    return np.where(count < 2, 0, np.where(count <= HOT, 1, 2))


def same_strings(buf: np.ndarray, start: np.ndarray, size: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Number of the first string equal to each one; equal hashes are confirmed byte by byte."""
    order = np.lexsort((np.arange(len(h)), size, h))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (size[order][1:] != size[order][:-1])
    first = np.empty(len(h), np.int64)
    first[order] = order[np.flatnonzero(fresh)][np.cumsum(fresh) - 1] if len(h) else order
    copies = np.flatnonzero(first != np.arange(len(h)))
    for at in range(0, len(copies), 50_000):
        some = copies[at : at + 50_000]
        own = owner(size[some])
        step = np.arange(len(own)) - (np.cumsum(size[some]) - size[some])[own]
        wrong = buf[start[some][own] + step] != buf[start[first[some]][own] + step]
        bad = some[np.unique(own[wrong])]
        first[bad] = bad
    return first


def _take(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    own = owner(size)
    return buf[start[own] + np.arange(len(own)) - (np.cumsum(size) - size)[own]]


def _sender(ranges: int, turns: int):
    def send(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        _, ids, texts = in_order(docs)
        cut = [(base, part, *pieces(Scan(part))) for base, part in parts(texts, PART_BYTES)]
        known, place = np.unique(np.concatenate([np.zeros(0, np.uint64), *[k for *_, k, _ in cut]]), return_inverse=True)
        kind, done = codes_of(known, answers, ranges)[place], 0
        out = {n: [] for n in ("text", "starts", "hash", "range", "id", "doc", "place")}
        for base, part, at, n, k, doc in cut:
            scan = Scan(part)
            code, done = kind[done : done + len(k)], done + len(k)
            hot = np.flatnonzero(code == 2)
            own = owner(n[hot])
            single = at[hot][own] + np.arange(len(own)) - (np.cumsum(n[hot]) - n[hot])[own]
            warm = code == 1
            at = np.concatenate([at[warm], single])
            docs_ = np.concatenate([doc[warm], doc[hot][own]])
            n = np.concatenate([n[warm], np.ones(len(single), np.int64)])
            h = scan.hashes(at, at + n + LENGTH - 1)
            where = np.concatenate([k[warm], h[warm.sum() :] >> _SHIFT]) % np.uint64(ranges * turns)
            for name, value in (("text", _take(scan.buf, at, n + LENGTH - 1)), ("starts", n), ("hash", h), ("range", where),
                                ("id", ids[base + docs_]), ("doc", base + docs_), ("place", at - scan.start[docs_])):
                out[name].append(value)
        all_ = {n: np.concatenate(v) if v else np.zeros(0, np.int64) for n, v in out.items()}
        n = all_["starts"].astype(np.int64)
        size = n + LENGTH - 1
        begin = np.cumsum(size) - size
        first = same_strings(all_["text"], begin, size, all_["hash"]) if len(n) else n
        order = np.lexsort((first, all_["range"]))
        which = all_["range"].astype(np.int64)
        found, edge = np.unique(which[order] // turns, return_index=True)
        rows = []
        for a, b in pairwise([*edge, len(n)]):
            some = order[a:b]
            lead = some[first[some] == some]
            times = np.diff(np.append(np.flatnonzero(first[some] == some), len(some)))
            rows.append((packed((which[lead] % turns).astype("<u2")), packed(n[lead].astype("<u2")), packed(times.astype("<u4")), packed(np.diff(all_["id"][some], prepend=0)),
                         packed(np.diff(all_["doc"][some], prepend=0).astype("<i4")), packed(all_["place"][some].astype("<u4")),
                         packed(_take(all_["text"], begin[lead], size[lead]))))
        columns = zip(*rows, strict=True) if rows else [[]] * 7
        names = ("turn", "starts", "times", "id", "doc", "place", "text")
        shard = key[0].as_py()
        return pa.table({"range": pa.array(found.astype(np.int64)), "shard": pa.array([shard] * len(found), pa.int32()), **{k: pa.array(list(c), pa.binary()) for k, c in zip(names, columns, strict=True)}})

    return send


def string_order(buf: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Positions with ``left >= LENGTH`` bytes to the end of their piece, sorted by their first ``LENGTH`` bytes.

    A rank is the place of a group of equal prefixes in the order. Each round
    doubles the depth of the prefixes by the ranks of the positions they reach;
    groups of one are settled and take no part in later rounds.
    """
    n = len(buf)
    bits = np.uint64(max(1, int(n).bit_length()))
    mask = np.uint64((1 << int(bits)) - 1)
    depth = min(5, (64 - int(bits)) // 8)
    at = np.flatnonzero(left >= depth).astype(np.uint64)
    word = np.zeros(len(at), np.uint64)
    for j in range(depth):
        word = (word << np.uint64(8)) | buf[at.astype(np.int64) + j].astype(np.uint64)
    key = (word << bits) | at
    key.sort()
    order = (key & mask).astype(np.int64)
    group = key >> bits
    while True:
        start = np.ones(len(order), bool)
        start[1:] = group[1:] != group[:-1]
        place = np.maximum.accumulate(np.where(start, np.arange(len(order)), 0))
        if depth >= LENGTH or not len(order):
            return order
        rank = np.zeros(n, np.uint64)
        rank[order] = place.astype(np.uint64)
        step = min(depth, LENGTH - depth)
        depth += step
        stay = left[order] >= depth
        order, place = order[stay], place[stay]
        start = np.ones(len(order), bool)
        start[1:] = place[1:] != place[:-1]
        alone = start & np.append(start[1:], True)
        slots = np.flatnonzero(~alone)
        open_ = order[slots]
        # three numbers of at most 21 bits: group, rank of what follows, position
        packed_key = (place[slots].astype(np.uint64) << (bits + bits)) | (rank[open_ + step] << bits) | open_.astype(np.uint64)
        packed_key.sort()
        order[slots] = (packed_key & mask).astype(np.int64)
        group = np.empty(len(order), np.uint64)
        group[:] = place.astype(np.uint64) << bits
        group[slots] = packed_key >> bits


def common_prefixes(buf: np.ndarray, order: np.ndarray, begin: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Common prefix (up to ``LENGTH``) of each position in ``order`` with the one before, by Kasai's walk.

    All pieces walk at once, one start after the other: what was common at a start
    is common at the next one but for one byte, so only bytes beyond are compared.
    """
    n = len(buf)
    before = np.full(n + 1, -1, np.int64)
    before[order[1:]] = order[:-1]
    rank = np.full(n + 1, n + 1, np.int64)  # above all where a position is no start
    rank[order] = np.arange(len(order))
    out = np.zeros(n, np.int64)
    alive = np.argsort(-starts, kind="stable")
    begin, starts = begin[alive], starts[alive]
    common = np.zeros(len(begin), np.int64)
    last = np.full(len(begin), -1, np.int64)
    for t in range(int(starts.max(initial=0))):
        m = int(np.searchsorted(-starts, -t, side="left"))
        i = begin[:m] + t
        j = before[i]
        # the walk carries over only while the neighbour's next position is a start as well, and still before this one:
        # neighbours with all bytes in common may change sides at the byte that comes into view
        carried = (last[:m] >= 0) & (rank[last[:m] + 1] < rank[i])
        h = np.where(carried, np.maximum(common[:m] - 1, 0), 0)
        h[j < 0] = 0
        active = np.flatnonzero((j >= 0) & (h < LENGTH))
        while len(active):
            same = buf[i[active] + h[active]] == buf[j[active] + h[active]]
            h[active[same]] += 1
            active = active[same]
            active = active[h[active] < LENGTH]
        out[i], common[:m], last[:m] = h, h, j
    return out[order]


def _words(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number; bytes beyond the end are zero."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    out = np.zeros(len(buf), np.uint64)
    for j in range(8):
        out <<= np.uint64(8)
        out |= padded[j : j + len(buf)]
    return out


_STEPS = [*range(0, LENGTH - 8, 8), LENGTH - 8]  # eight bytes each cover a string


def _compare(words: np.ndarray, a: np.ndarray, b: np.ndarray, steps: list[int]) -> np.ndarray:
    """Sign of the comparison of the strings at a with those at b, by their bytes at ``steps``."""
    sign = np.zeros(len(a), np.int8)
    todo = np.arange(len(a))
    for j in steps:
        x, y = words[a[todo] + j], words[b[todo] + j]
        sign[todo] = (x > y).astype(np.int8) - (x < y)
        todo = todo[x == y]
        if not len(todo):
            break
    return sign


def search(words: np.ndarray, sorted_at: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each string in a sorted list of strings by binary search, and whether it is there.

    The first eight bytes are searched for all strings at once; within equal ones the search goes on by whole strings.
    """
    heads = words[sorted_at]
    low, high = np.searchsorted(heads, words[at], "left"), np.searchsorted(heads, words[at], "right")
    last = high.copy()
    while (open_ := np.flatnonzero(low < high)).size:
        middle = (low[open_] + high[open_]) // 2
        sign = _compare(words, sorted_at[middle], at[open_], _STEPS[1:])
        low[open_] = np.where(sign < 0, middle + 1, low[open_])
        high[open_] = np.where(sign < 0, high[open_], middle)
    hit = low < last
    hit[hit] = _compare(words, sorted_at[low[hit]], at[hit], _STEPS[1:]) == 0
    return low, hit


def smallest_ids(buf: np.ndarray, begin: np.ndarray, starts: np.ndarray, ids: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """For each string start of the pieces, in order, the smallest id of a piece that holds the same string."""
    size = starts + LENGTH - 1
    first = np.cumsum(starts) - starts
    out = np.empty(int(starts.sum()), np.int64)
    block_of = (np.cumsum(size) - size) // block
    blocks = []
    for b in np.unique(block_of):
        own = np.flatnonzero(block_of == b)
        low, high = begin[own[0]], begin[own[-1]] + size[own[-1]]
        left = _left(begin[own] - low, size[own], high - low)
        order = string_order(buf[low:high], left)
        common = common_prefixes(buf[low:high], order, begin[own] - low, starts[own])
        fresh = common < LENGTH
        fresh[:1] = True
        piece = own[np.searchsorted(begin[own] - low, order, side="right") - 1]
        lead = np.flatnonzero(fresh)
        least = np.minimum.reduceat(ids[piece], lead)
        which = np.cumsum(fresh) - 1
        blocks.append((order[lead] + low, least, first[piece] + order + low - begin[piece], which))
    if len(blocks) == 1:
        _, least, target, which = blocks[0]
        out[target] = least[which]
        return out
    # one block after the other: its classes take the numbers of equal ones, new ones are put in their place
    words = _words(buf)
    at, least = blocks[0][:2]
    number = np.arange(len(at))
    numbers = [number]
    for more_at, more_least, _, _ in blocks[1:]:
        place, hit = search(words, at, more_at)
        own = np.empty(len(more_at), np.int64)
        own[hit] = number[place[hit]]
        own[~hit] = len(least) + np.arange(int((~hit).sum()))
        np.minimum.at(least, own[hit], more_least[hit])
        least = np.concatenate([least, more_least[~hit]])
        at, number = np.insert(at, place[~hit], more_at[~hit]), np.insert(number, place[~hit], own[~hit])
        numbers.append(own)
    for own, (_, _, target, which) in zip(numbers, blocks, strict=True):
        out[target] = least[own[which]]
    return out


def _left(begin: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    """Bytes from each position to the end of its piece; pieces stand one after the other."""
    return np.repeat(begin + size, size) - np.arange(n)


def _smallest_grams(buf: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The hash that a piece was cut by: the smallest one of its first string, a part of the bytes at a time."""
    out = [np.zeros(0, np.uint64)]
    for own in np.split(np.arange(len(begin)), np.flatnonzero(np.diff(begin // PART_BYTES)) + 1):
        if len(own):
            scan, low = Scan([]), begin[own[0]]
            scan.buf = buf[low : begin[own[-1]] + size[own[-1]]]
            h = scan.grams(GRAM) >> _SHIFT
            out.append(h[(begin[own] - low)[:, None] + np.arange(LENGTH - GRAM + 1)].min(axis=1))
    return np.concatenate(out)


def _hashes(buf: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of each piece, a million bytes at a time."""
    out = [np.zeros(0, np.uint64)]
    for own in np.split(np.arange(len(begin)), np.flatnonzero(np.diff(begin // 1_000_000)) + 1):
        if len(own):
            scan, low = Scan([]), begin[own[0]]
            scan.buf = buf[low : begin[own[-1]] + size[own[-1]]]
            out.append(scan.hashes(begin[own] - low, begin[own] - low + size[own]))
    return np.concatenate(out)


def _gone(starts: np.ndarray, times: np.ndarray, buf: np.ndarray, ids: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts whose string a smaller id holds, of every occurrence: its number, the first and the last start.

    ``starts`` and ``times`` (occurrences) are of the pieces in ``buf``, ``ids`` of the occurrences.
    """
    size = starts + LENGTH - 1
    begin = np.cumsum(size) - size
    first = same_strings(buf, begin, size, _hashes(buf, begin, size))
    lead = np.flatnonzero(first == np.arange(len(first)))
    piece = np.searchsorted(lead, first)[owner(times)]  # of each occurrence
    least = np.full(len(lead), np.iinfo(np.int64).max)
    np.minimum.at(least, piece, ids)
    n = starts[lead]
    # a piece without another one of its hash shares its strings with no other
    found, offset = np.repeat(least, n), np.cumsum(n) - n
    _, kind, kinds = np.unique(_smallest_grams(buf, begin[lead], size[lead]), return_inverse=True, return_counts=True)
    some = np.flatnonzero(kinds[kind] > 1)
    if len(some):
        own = owner(n[some])
        at = offset[some][own] + np.arange(len(own)) - (np.cumsum(n[some]) - n[some])[own]
        text, size = _take(buf, begin[lead[some]], size[lead[some]]), size[lead[some]]
        found[at] = smallest_ids(text, np.cumsum(size) - size, n[some], least[some], block)
    out = []
    for a in range(0, len(piece), 100_000):
        p = piece[a : a + 100_000]
        own = owner(n[p])
        step = np.arange(len(own)) - (np.cumsum(n[p]) - n[p])[own]
        gone = found[offset[p][own] + step] < ids[a : a + 100_000][own]
        new = gone.copy()
        new[1:] &= ~gone[:-1] | (own[1:] != own[:-1])
        end = gone.copy()
        end[:-1] &= ~gone[1:] | (own[1:] != own[:-1])
        out.append((a + own[new], step[new], step[end]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _match(block: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("shard")
        cols = {n: [unpacked(x, t) for x in table.column(n).to_pylist()] for n, t in (("turn", "<u2"), ("starts", "<u2"), ("times", "<u4"), ("id", "<i8"), ("doc", "<i4"), ("place", "<u4"), ("text", "u1"))}
        shard = np.repeat(table.column("shard").to_numpy(), [len(x) for x in cols["place"]])
        ids = np.concatenate([np.cumsum(x) for x in cols["id"]])
        doc = np.concatenate([np.cumsum(x, dtype=np.int64) for x in cols["doc"]])
        turn, starts, times, place, buf = (np.concatenate(cols.pop(n)) for n in ("turn", "starts", "times", "place", "text"))
        starts, times = starts.astype(np.int64), times.astype(np.int64)
        size = starts + LENGTH - 1
        begin = np.cumsum(size) - size
        turn_of, out = np.repeat(turn, times), []
        for t in np.unique(turn):
            piece, at = np.flatnonzero(turn == t), np.flatnonzero(turn_of == t)
            own, low, high = _gone(starts[piece], times[piece], _take(buf, begin[piece], size[piece]), ids[at], block)
            where = place[at[own]].astype(np.int64)
            out.append((shard[at[own]], doc[at[own]], where + low, where + high + LENGTH))
        where, doc, low, high = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.lexsort((low, doc, where))
        which, edge = np.unique(where[order], return_index=True)
        rows = []
        for a, b in pairwise([*edge, len(order)]):
            some = order[a:b]
            rows.append((packed(np.diff(doc[some], prepend=0).astype("<i4")), packed(low[some].astype("<u4")), packed((high - low)[some].astype("<u4"))))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
        return pa.table({"shard": pa.array(which, pa.int32()), **{k: pa.array(list(c), pa.binary()) for k, c in zip(("doc", "low", "size"), columns, strict=True)}})

    return run


def _remover(columns: list[str], with_text: bool):
    def run(docs: pa.Table, spans: pa.Table) -> pa.Table:
        docs, _, texts = in_order(docs)
        none = np.zeros(0, np.int64)
        doc = np.concatenate([none, *[np.cumsum(unpacked(x, "<i4"), dtype=np.int64) for x in spans.column("doc").to_pylist()]])
        low = np.concatenate([none, *[unpacked(x, "<u4").astype(np.int64) for x in spans.column("low").to_pylist()]])
        high = low + np.concatenate([none, *[unpacked(x, "<u4").astype(np.int64) for x in spans.column("size").to_pylist()]])
        order = np.argsort(doc, kind="stable")
        doc, low, high = doc[order], low[order], high[order]
        edge = np.searchsorted(doc, np.arange(len(texts) + 1))
        out = {n: [] for n in ("n_removed", "n_spans", "kept_sha256", "spans", "text")}
        for i, text in enumerate(texts):
            kept, runs = text, []
            if edge[i] < edge[i + 1]:
                depth = np.zeros(len(text) + 1, np.int32)
                np.add.at(depth, low[edge[i] : edge[i + 1]], 1)
                np.add.at(depth, high[edge[i] : edge[i + 1]], -1)
                gone = np.concatenate([[False], np.cumsum(depth[:-1]) > 0, [False]])
                turns = np.flatnonzero(gone[1:] != gone[:-1])
                runs = turns.reshape(-1, 2).tolist()
                raw = np.frombuffer(text, np.uint8)
                stay = ~gone[1:-1]
                kept = raw[stay].tobytes()
                if with_text:  # a character stays unless all its bytes go
                    letter = np.cumsum((raw & 0xC0) != 0x80)
                    whole = raw[np.bincount(letter, stay)[letter] > 0].tobytes()
            out["n_removed"].append(len(text) - len(kept))
            out["n_spans"].append(len(runs))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["spans"].append([{"start": a, "end": b} for a, b in runs])
            out["text"].append((whole if runs else text).decode() if with_text else None)
        for name in ("n_removed", "n_spans"):
            docs = docs.append_column(name, pa.array(out[name], pa.int64()))
        docs = docs.append_column("n_bytes", pa.array([len(t) for t in texts], pa.int64())).append_column("kept_sha256", pa.array(out["kept_sha256"], pa.string()))
        docs = docs.append_column("spans", pa.array(out["spans"], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))
        if with_text:
            at = docs.schema.get_field_index("text")
            docs = docs.set_column(at, "text", pa.array(out["text"], pa.string()))
        return docs.select([*columns, "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return run


def suffix_dedup(docs: DataFrame, with_text: bool = False, block: int = BLOCK) -> DataFrame:
    """``docs`` with ``n_bytes, n_removed, n_spans, kept_sha256, spans`` (starts and ends of removed runs in bytes).

    ``with_text`` replaces ``text`` by what is kept; there a character whose bytes are removed only in part stays.
    Columns of these names in ``docs`` are replaced. ``docs`` is read twice: once for its size, once for its rows.
    """
    stats = StructType([
        StructField("n_bytes", LongType()), StructField("n_removed", LongType()), StructField("n_spans", LongType()), StructField("kept_sha256", StringType()),
        StructField("spans", ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))),
    ])
    others = [c for c in docs.columns if c not in {"doc_id", "text", *stats.names}]
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.struct(F.lit(0).alias("none"), *[F.col(c) for c in others]).alias("others"))  # out of the way of names used here
    shards = sharded(base)
    ranges = shards.ranges(RANGE_BYTES)
    turns = max(1, -(-shards.bytes // (ranges * MATCH_BYTES)))
    counts = census(shards, _keys, _kind, ranges)
    sent = shards.docs.groupBy("shard").cogroup(counts.groupBy("shard")).applyInArrow(
        settled(_sender(ranges, turns)), "range long, shard int, turn binary, starts binary, times binary, id binary, doc binary, place binary, text binary")
    spans = sent.groupBy("range").applyInArrow(settled(_match(block)), "shard int, doc binary, low binary, size binary")
    schema = StructType([*base.schema.fields, *stats.fields])
    found = shards.docs.groupBy("shard").cogroup(spans.groupBy("shard")).applyInArrow(settled(_remover(base.columns, with_text)), schema)
    named = [F.col(c) if c in {"doc_id", "text"} else F.col("others").getField(c).alias(c) for c in docs.columns if c not in stats.names]
    return found.select(*named, *stats.names)


__all__ = ["common_prefixes", "pieces", "search", "smallest_ids", "string_order", "suffix_dedup"]
