"""Encoding and decoding with a byte-pair piece model, every piece traced to bytes of the source.

A text is normalised by the model's compiled character map: at each place the longest prefix
that the map's trie knows is replaced, anything else stays, and every code point that comes out
remembers the byte of the source it came from. Spaces become the piece symbol, white space in
front is added as the model says. The normalised text is cut where no piece can reach across
(before each run of the space symbol), equal segments are encoded once per slice, and the pieces
of all segments are put together again; the ends of pieces in the normalised text, looked up
in the record, are byte offsets in the source. Pieces of one text tile it: piece ``k`` covers
``edges[k]`` to ``edges[k + 1]``, and of the byte pieces of a character the last one covers it.

Merges follow the best score, then the leftmost place. Many short segments merge in step, one
merge of each at a time in numpy; long ones are cut where no piece holds the two neighbouring
characters, and what is still long goes through a heap.

Edge cases: a null text is an empty one and has no pieces; an unknown character becomes its
UTF-8 bytes; a text of any length is encoded whole (a run without white space whose neighbours
all occur in pieces needs about 300 bytes of memory for each of its characters; other long texts go
through windows of ``SLICE_BYTES`` characters); repeated rows
are encoded each on their own; an empty table gives no rows; other columns are ignored, whatever
their names. Decoding null ids gives null, an empty list the empty text.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import settled_map, slices

SPACE_SYMBOL = "▁"
_SPACE = ord(SPACE_SYMBOL)
LONG = 48  # symbols of a segment that still merges in step with others
SLICE_BYTES = 1_000_000
_FAR = np.int32(1 << 30)


# --- the model file


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Number and value of the fields of a serialized message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


class CharacterMap:
    """The compiled map of a model: a double-array trie over UTF-8 and its replacement texts."""

    def __init__(self, blob: bytes) -> None:
        size = int.from_bytes(blob[:4], "little")
        self.unit = np.frombuffer(blob, "<u4", size // 4, 4).astype(np.int64)
        self.texts = blob[4 + size :]
        self._known: dict[int, np.ndarray] = {}

    def _offset(self, unit: np.ndarray) -> np.ndarray:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def replacement(self, value: int) -> np.ndarray:
        if value not in self._known:
            text = self.texts[value : self.texts.index(b"\0", value)].decode()
            self._known[value] = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
        return self._known[value]

    def longest(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length in bytes and value of the longest known prefix at each start (length 0: none), all starts in step."""
        length, value = np.zeros(len(start), np.int64), np.full(len(start), -1, np.int64)
        row, at = np.arange(len(start)), start.copy()
        node = np.full(len(start), self._offset(self.unit[:1])[0], np.int64)
        while len(row):
            live = at < end[row]
            row, at, node = row[live], at[live], node[live]
            byte = buf[at].astype(np.int64)
            node = node ^ byte
            inside = node < len(self.unit)
            unit = self.unit[np.where(inside, node, 0)]
            live = inside & ((unit & ((1 << 31) | 0xFF)) == byte)
            row, at, node, unit = row[live], at[live] + 1, node[live], unit[live]
            node = node ^ self._offset(unit)
            leaf = (unit >> 8) & 1 == 1
            length[row[leaf]] = at[leaf] - start[row[leaf]]
            value[row[leaf]] = self.unit[node[leaf]] & ((1 << 31) - 1)
        return length, value


def ragged(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Indices ``first[i], first[i] + 1, ...`` of all runs, one run after the other."""
    total = int(count.sum())
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(total)


class PieceModel:
    """Pieces, scores and switches of a model file, and the tables that encoding needs."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as file:
            data = file.read()
        pieces, trainer, rules = [], {}, {}
        for number, value in _fields(data):
            if number == 1:
                pieces.append(dict(_fields(value)))
            elif number in (2, 3):
                (trainer if number == 2 else rules).update(_fields(value))
        self.kind = np.array([p.get(3, 1) for p in pieces])  # 1 normal, 2 unknown, 3 control, 4 user defined, 5 unused, 6 byte
        self.piece = [p[1].decode() for p in pieces]
        score = np.array([np.frombuffer(p[2], "<f4")[0] if 2 in p else 0.0 for p in pieces])
        if trainer.get(3, 1) != 2 or not trainer.get(35, 0) or np.isin(self.kind, (4, 5)).any() or trainer.get(24, 0):
            raise ValueError("only byte-pair models with byte pieces, without own or unused symbols and with white space in front, are supported")
        self.map = CharacterMap(rules[2]) if rules.get(2) else None
        self.dummy, self.trim, self.escape = (bool(rules.get(k, 1)) for k in (3, 4, 5))
        self.unknown = trainer.get(44, " ⁇ ".encode()).decode()
        self._tables(score)

    def _tables(self, score: np.ndarray) -> None:
        normal = np.flatnonzero(self.kind == 1)
        self.number = {self.piece[i]: int(i) for i in normal}
        self.bytes = np.zeros(256, np.int64)
        for i in np.flatnonzero(self.kind == 6):
            self.bytes[int(self.piece[i][3:-1], 16)] = i
        n = len(self.piece)
        chars = sorted({c for p in self.number for c in p} - self.number.keys())
        symbol = self.number | {c: n + k for k, c in enumerate(chars)}  # a character may occur in pieces without being one
        self.of_char = np.full(0x110000, -1, np.int32)
        for text, i in symbol.items():
            if len(text) == 1:
                self.of_char[ord(text)] = i
        self.letters = np.array([len(p) if k == 1 else 0 for p, k in zip(self.piece, self.kind, strict=True)], np.int32)
        self.size = n
        by_score = {s: r for r, s in enumerate(sorted({*score[normal].tolist()}, reverse=True))}
        rank = np.full(n, _FAR, np.int32)
        rank[normal] = [by_score[s] for s in score[normal].tolist()]
        self.rank = rank
        pairs = {(symbol[p[:k]] << 32) | symbol[p[k:]]: i for p, i in self.number.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol}
        self.merges = pairs
        keys = np.array(sorted(pairs), np.int64)
        self.pair_key, self.pair_to = keys, np.array([pairs[k] for k in keys.tolist()], np.int32)
        neighbours = {(ord(a) << 21) | ord(b) for p in self.number for a, b in pairwise(p)}
        self.neighbours = np.array(sorted(neighbours), np.int64)
        self.splits = not any((k & 0x1FFFFF) == _SPACE and (k >> 21) != _SPACE for k in neighbours)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols makes, -1 if none."""
        if not len(self.pair_key):
            return np.full(len(left), -1, np.int32)
        key = (left.astype(np.int64) << 32) | right
        key[(left < 0) | (right < 0)] = -1
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_to[at], np.int32(-1))


# --- normalisation


class Normalised:
    """Code points of a slice of texts after normalisation, the source byte of each, and where texts begin."""

    def __init__(self, texts: list[str], model: PieceModel, inner: bool = False) -> None:
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), "<u4").astype(np.int64)
        chars = np.array([len(t) for t in texts], np.int64)
        width = (1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(width)])
        edge = np.concatenate([[0], np.cumsum(chars)])
        begin = ends[edge[:-1]]
        self.bytes = ends[edge[1:]] - begin  # length of each source
        doc = np.repeat(np.arange(len(texts)), chars)
        source = ends[:-1] - begin[doc]
        if model.map is not None:
            points, source, doc = self._mapped(model.map, joined, points, source, doc, ends, ends[edge[1:]])
        if model.trim:
            space = points == 0x20
            again = np.ones(len(points), bool)  # at the start of a text, or behind a space
            again[1:] = (doc[1:] != doc[:-1]) | space[:-1]
            keep = ~(space & again)
            first = self._first_kept(doc, source, len(texts), keep)
            points, source, doc = points[keep], source[keep], doc[keep]
        else:
            first = np.zeros(len(texts), np.int64)
        if model.escape:
            points = np.where(points == 0x20, _SPACE, points)
        if model.dummy and not inner:
            counts = np.bincount(doc, minlength=len(texts))
            full = np.flatnonzero(counts)
            at = (np.cumsum(counts) - counts)[full]
            points, doc = np.insert(points, at, _SPACE if model.escape else 0x20), np.insert(doc, at, full)
            source = np.insert(source, at, first[full])
        self.end = self.bytes.copy()
        if model.trim:
            points, source, doc = self._trimmed(points, source, doc, _SPACE if model.escape else 0x20, len(texts))
        self.points, self.source = points, source
        self.counts = np.bincount(doc, minlength=len(texts)).astype(np.int64)
        self.first = np.cumsum(self.counts) - self.counts

    @staticmethod
    def _mapped(known: CharacterMap, joined: str, points, source, doc, ends, last):
        buf = np.frombuffer(joined.encode(), np.uint8)
        length, value = known.longest(buf, ends[:-1], last[doc])
        stop = np.searchsorted(ends, ends[:-1] + length)  # number of the character behind the prefix
        keep = np.ones(len(points), bool)
        reach = 0
        for i in np.flatnonzero(stop - np.arange(len(points)) > 1).tolist():
            if i >= reach:  # a place inside an earlier prefix is no start
                reach = int(stop[i])
                keep[i + 1 : reach] = False
        hit = keep & (length > 0)
        kinds, which = np.unique(value[hit], return_inverse=True)
        news = [known.replacement(int(v)) for v in kinds]
        sizes = np.array([len(x) for x in news], np.int64)
        count = np.ones(len(points), np.int64)
        count[hit] = sizes[which] if len(kinds) else 0
        count[~keep] = 0
        # replacements lie behind the text itself
        pool = np.concatenate([points, *news]) if news else points
        begin = np.arange(len(points))
        if len(kinds):
            begin[hit] = (len(points) + np.cumsum(sizes) - sizes)[which]
        owner = np.repeat(np.arange(len(points)), count)
        return pool[ragged(begin, count)], source[owner], doc[owner]

    @staticmethod
    def _first_kept(doc, source, n, keep):
        first = np.zeros(n, np.int64)
        at = np.flatnonzero(keep)[::-1]
        first[doc[at]] = source[at]
        return first

    def _trimmed(self, points, source, doc, symbol, n):
        """Without the space symbols at the end of each text; its record ends where they began."""
        solid = np.flatnonzero(points != symbol)
        last = np.full(n, -1, np.int64)
        last[doc[solid]] = solid
        keep = np.arange(len(points)) <= last[doc]
        gone = np.flatnonzero(~keep)[::-1]
        self.end[doc[gone]] = source[gone]
        return points[keep], source[keep], doc[keep]


# --- merging


def _flat(lists: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(lists) if lists else np.zeros(0, np.int32)


def merge_in_step(symbols: np.ndarray, counts: np.ndarray, model: PieceModel) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of each segment after all merges, and how many are left; one merge of each segment at a time."""
    seg = np.repeat(np.arange(len(counts)), counts)
    sym = symbols.astype(np.int32)
    made = np.full(len(sym), -1, np.int32)  # piece of a symbol and the next one of its segment
    if len(sym):
        made[:-1] = model.merged(sym[:-1], sym[1:])
        made[:-1][seg[1:] != seg[:-1]] = -1
    done_sym, done_seg = [], []
    while len(sym):
        first = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
        rank = np.where(made >= 0, model.rank[made], _FAR)
        key = (rank.astype(np.int64) << 32) | np.arange(len(sym))
        best = np.minimum.reduceat(key, first)
        open_ = (best >> 32) < _FAR
        if not open_.all():
            over = np.repeat(~open_, np.diff(np.append(first, len(sym))))
            done_sym.append(sym[over])
            done_seg.append(seg[over])
            if over.all():
                break
        at = best[open_] & 0xFFFFFFFF
        sym[at] = made[at]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        if not open_.all():
            keep &= ~over
        place = np.cumsum(keep) - 1
        at = place[at]
        sym, seg, made = sym[keep], seg[keep], made[keep]
        after = at[at + 1 < len(sym)]
        after = after[seg[after] == seg[after + 1]]
        made[at] = -1
        made[after] = model.merged(sym[after], sym[after + 1])
        ahead = at[at > 0] - 1
        ahead = ahead[seg[ahead] == seg[ahead + 1]]
        made[ahead] = model.merged(sym[ahead], sym[ahead + 1])
    sym, seg = _flat(done_sym), _flat(done_seg).astype(np.int64)
    order = np.argsort(seg, kind="stable")
    return sym[order], np.bincount(seg, minlength=len(counts)).astype(np.int64)


def merge_long(symbols: np.ndarray, model: PieceModel) -> np.ndarray:
    """The same for one long segment, by a heap of (rank, place)."""
    sym = symbols.tolist()
    n = len(sym)
    ahead, after = list(range(-1, n - 1)), list(range(1, n + 1))
    rank, merges = model.rank.tolist(), model.merges
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int, j: int) -> None:
        if i >= 0 and j < n and sym[i] >= 0 and sym[j] >= 0:
            piece = merges.get((sym[i] << 32) | sym[j])
            if piece is not None:
                heapq.heappush(heap, (rank[piece], i, sym[i], sym[j]))

    for i in range(n - 1):
        offer(i, i + 1)
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        if sym[i] != left or j >= n or sym[j] != right:
            continue
        sym[i] = merges[(left << 32) | right]
        sym[j] = -2  # merged into its neighbour
        after[i] = after[j]
        if after[j] < n:
            ahead[after[j]] = i
        offer(ahead[i], i)
        offer(i, after[i])
    out = np.array(sym, np.int32)
    return out[out != -2]


def encode_segments(points: np.ndarray, counts: np.ndarray, model: PieceModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of each segment's pieces, how many code points each covers, and the number of pieces of each segment."""
    begin = np.cumsum(counts) - counts
    long = counts > LONG
    parent = np.arange(len(counts))
    if long.any():  # cut where no piece holds the two neighbours
        cut = np.zeros(len(points), bool)
        cut[begin[counts > 0]] = True
        inside = ragged(begin[long] + 1, counts[long] - 1)
        pair = (points[inside - 1] << 21) | points[inside]
        at = np.minimum(np.searchsorted(model.neighbours, pair), max(len(model.neighbours) - 1, 0))
        cut[inside] = model.neighbours[at] != pair if len(model.neighbours) else True
        begin_part = np.flatnonzero(cut)
        parent = np.repeat(np.arange(len(counts)), counts)[begin_part]
        part = np.diff(np.append(begin_part, len(points)))
    else:
        begin_part, part = begin, counts
    symbols = model.of_char[points]
    short = part <= LONG
    sym, left = merge_in_step(symbols[ragged(begin_part[short], part[short])], part[short], model)
    if not short.all():
        found = {int(k): merge_long(symbols[begin_part[k] : begin_part[k] + part[k]], model) for k in np.flatnonzero(~short)}
        sizes = np.zeros(len(part), np.int64)
        sizes[short] = left
        sizes[list(found)] = [len(x) for x in found.values()]
        out = np.empty(int(sizes.sum()), np.int32)
        first = np.cumsum(sizes) - sizes
        out[ragged(first[short], left)] = sym
        for k, x in found.items():
            out[first[k] : first[k] + len(x)] = x
        sym, left = out, sizes
    pieces = np.bincount(np.repeat(parent, left), minlength=len(counts)).astype(np.int64)
    known = (sym >= 0) & (sym < model.size)
    if known.all():
        return sym, model.letters[sym], pieces
    # unknown characters, each one symbol, become their bytes; the last of them covers the character
    covers = np.ones(len(sym), np.int64)
    covers[known] = model.letters[sym[known]]
    place = np.cumsum(covers) - covers
    alone = np.flatnonzero(~known)
    raw = [chr(c).encode() for c in points[place[alone]].tolist()]
    wide = np.ones(len(sym), np.int64)
    wide[alone] = [len(x) for x in raw]
    ids = np.repeat(np.where(known, sym, 0), wide)
    cover = np.repeat(covers, wide)
    first = np.cumsum(wide) - wide
    at = ragged(first[alone], wide[alone])
    ids[at] = model.bytes[np.frombuffer(b"".join(raw), np.uint8)]
    cover[at] = 0
    cover[first[alone] + wide[alone] - 1] = 1
    owner = np.repeat(np.arange(len(counts)), pieces)
    return ids, cover, np.bincount(np.repeat(owner, wide), minlength=len(counts)).astype(np.int64)


def encode_texts(texts: list[str], model: PieceModel, inner: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts, how many each has, and the byte edges of their pieces (one more than pieces per text).

    ``inner``: the texts continue others, so nothing is put before them.
    """
    normal = Normalised(texts, model, inner)
    points = normal.points
    begins = np.zeros(len(points), bool)
    if model.splits and len(points):
        begins[1:] = (points[1:] == _SPACE) & (points[:-1] != _SPACE)
    begins[normal.first[normal.counts > 0]] = True
    start = np.flatnonzero(begins)
    raw = points.astype("<u4").tobytes()
    offsets = np.append(start, len(points)).astype(np.int64) * 4
    column = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw)])
    distinct = column.dictionary_encode()
    which = distinct.indices.to_numpy()
    words = distinct.dictionary
    size = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64) // 4
    flat = np.frombuffer(b"".join(words.to_pylist()), "<u4").astype(np.int64)
    ids, cover, pieces = encode_segments(flat, size, model)
    count = pieces[which]
    take = ragged((np.cumsum(pieces) - pieces)[which], count)
    ids, cover = ids[take], cover[take]
    # pieces of a text: those of its segments
    home = np.searchsorted(normal.first + normal.counts, start, side="right")
    tokens = np.bincount(home, weights=count, minlength=len(texts)).astype(np.int64)
    reach = np.concatenate([[0], np.cumsum(cover)])  # edges among all code points, for texts one after the other
    source = np.append(normal.source, 0)
    first = np.cumsum(tokens) - tokens
    edges = source[reach[ragged(first, tokens + 1)]]
    last = np.cumsum(tokens + 1) - 1
    edges[last] = normal.end
    return ids.astype(np.int32), tokens, edges.astype(np.int32)


def windows(text: str, model: PieceModel, length: int = SLICE_BYTES) -> Iterator[str]:
    """A long text in parts of about ``length`` characters, cut before spaces that no piece reaches across.

    Models that trim or replace look across such places, so their texts stay whole.
    """
    at = 0
    while model.map is None and not model.trim and model.splits and len(text) - at > length:
        cut = at + length
        while True:
            cut = text.find(" ", cut)
            if cut < 0 or text[cut - 1] not in (" ", SPACE_SYMBOL):
                break
            cut += 1
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def encode_long(text: str, model: PieceModel, length: int = SLICE_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``encode_texts`` of one long text, a window at a time."""
    ids, edges, base = [], [np.zeros(1, np.int32)], 0
    for number, part in enumerate(windows(text, model, length)):
        found, _, ends = encode_texts([part], model, inner=number > 0)
        ids.append(found)
        if number == 0:
            edges[0] = ends[:1]
        edges.append(ends[1:] + np.int32(base))
        base += int(ends[-1])
    out = np.concatenate(ids)
    return out, np.array([len(out)]), np.concatenate(edges)


# --- decoding


class Surfaces:
    """What each id stands for, as bytes, and how lists of ids become texts."""

    def __init__(self, model: PieceModel) -> None:
        shown = [b"" if k == 3 else model.unknown.encode() if k == 2 else bytes([int(p[3:-1], 16)]) if k == 6 else p.replace(SPACE_SYMBOL, " ").encode()
                 for p, k in zip(model.piece, model.kind.tolist(), strict=True)]
        self.table = pa.array(shown, pa.large_binary())
        self.is_byte, self.silent = model.kind == 6, model.kind == 3
        self.spaced = np.array([k == 1 and p.startswith(SPACE_SYMBOL) for p, k in zip(model.piece, model.kind.tolist(), strict=True)])
        self.alone = np.array([p == SPACE_SYMBOL for p in model.piece])
        self.strips, self.trim = model.dummy or model.trim, model.trim

    def texts(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        taken = self.table.take(pa.array(ids, pa.int32()))
        edge = np.frombuffer(taken.buffers()[1], np.int64, len(ids) + 1, taken.offset * 8)
        data = taken.buffers()[2].to_pybytes() if len(ids) and taken.buffers()[2] is not None else b""
        at = np.concatenate([[0], np.cumsum(counts)])
        broken = np.concatenate([[0], np.cumsum(self.silent[ids])])  # byte pieces on both sides of a silent one are two runs
        out = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            gone = self._stripped(ids[a:b])
            try:
                text = data[edge[a] + gone : edge[b]].decode()
            except UnicodeDecodeError:
                text = None
            out.append(self._repaired(ids[a:b], data, edge[a : b + 1], gone) if text is None or broken[b] > broken[a] else text)
        return out

    def _stripped(self, ids: np.ndarray) -> int:
        """Spaces to leave out: the one that encoding has put in front (if the model trims, one of each piece of nothing else, too)."""
        if not self.strips:
            return 0
        gone = 0
        for i in ids:
            if self.silent[i]:
                continue
            if not self.spaced[i]:
                break
            gone += 1
            if not self.trim or not self.alone[i]:
                break
        return gone

    def _repaired(self, ids: np.ndarray, data: bytes, edge: np.ndarray, gone: int) -> str:
        """Runs of byte pieces, with a replacement character for every byte that is no part of a character."""
        raw, out = data[edge[0] : edge[-1]], []
        kinds = self.is_byte[ids]
        cuts = np.flatnonzero(np.diff(kinds)) + 1
        for a, b in pairwise([0, *cuts.tolist(), len(ids)]):
            part = raw[edge[a] - edge[0] : edge[b] - edge[0]]
            if kinds[a]:
                while part:
                    size = next((n for n in (1, 2, 3, 4) if _is_character(part[:n])), 0)
                    out.append(part[:size].decode() if size else "�")
                    part = part[max(size, 1) :]
            else:
                out.append(part.decode())
        return "".join(out)[gone:]


def _is_character(raw: bytes) -> bool:
    try:
        return len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


# --- on tables


_models: dict[str, PieceModel] = {}


def piece_model(path: str) -> PieceModel:
    """The model of a file, read once per worker."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def _encode(path: str):
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("edges", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for part in slices(batches, budget=SLICE_BYTES):
            texts = [t or "" for t in part.column("text").to_pylist()]
            one = len(texts) == 1 and len(texts[0]) > SLICE_BYTES
            ids, tokens, edges = encode_long(texts[0], model) if one else encode_texts(texts, model)
            at = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
            columns = [part.column("doc_id"), pa.ListArray.from_arrays(at(tokens), pa.array(ids)), pa.ListArray.from_arrays(at(tokens + 1), pa.array(edges))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def encode_pieces(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, ids, edges``: piece ``k`` of a text covers its bytes ``edges[k]`` to ``edges[k + 1]``; ``model``: the file's path."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(settled_map(_encode(model)), "doc_id long, ids array<int>, edges array<int>")


def _decode(path: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surfaces = Surfaces(piece_model(path))
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(batch.schema.get_field_index("ids"))), 0)
            ends = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64)
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, side="right")))
                part = batch.slice(at, to - at)
                counts, at = np.diff(ends[at:to], prepend=ends[at - 1] if at else 0), to
                lists = part.column(batch.schema.get_field_index("ids"))
                texts = surfaces.texts(lists.flatten().to_numpy(zero_copy_only=False), counts)
                valid = pc.is_valid(lists).to_pylist()
                text = pa.array([t if v else None for t, v in zip(texts, valid, strict=True)], pa.string())
                columns = [part.column(batch.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*columns, text], names=[*keep, "text"])

    return run


def decode_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """``encoded`` (with ``ids``) and the ``text`` its ids stand for; an own column ``text`` is replaced."""
    keep = [c for c in encoded.columns if c != "text"]
    fields = encoded.select(*keep).schema.add("text", "string")
    return encoded.select(*keep).mapInArrow(settled_map(_decode(model, keep)), fields)
