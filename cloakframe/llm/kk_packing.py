"""Packing tokens into windows by multiway differencing (Karmarkar and Karp).

Texts are tokenized whole, and id 2 closes each document. Whole windows are cut
off long documents; what is left of each is cut into pieces of ``PIECE`` tokens at
most. Pieces are dealt at random into groups of about ``GROUP_TOKENS`` tokens. In a
group every piece starts as a partial partition with one filled window; the two
partial partitions with the largest spread are merged, the fullest window of one
with the emptiest of the other, until one is left. Starting from the fewest windows
that could hold the tokens, their number rises as long as one exceeds the capacity.

Edge cases: a null text is an empty one, whose only id is the closing one; repeated
rows are packed each on their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import os
import zlib
from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import materialize
from .text import settled, settled_map, slices

CAPACITY = 4096
PIECE = 1024
GROUP_TOKENS = 2_000_000
CACHED_WORDS = 500_000
SLICE_BYTES = 2_000_000
END = np.array([2], "<u4").tobytes()
_TOGETHER = 200  # words of letters that are encoded as one text
_MARKS = ".,;:!?"


class WordIds:
    """Ids of words as bytes, kept between calls for the words of late (two generations of ``CACHED_WORDS``).

    Words are what stands between spaces, tabs and line feeds; the tokenizer drops
    white space and never joins over it, so a text's ids are those of its words.
    It also splits letters from the marks behind them, so those are looked up apart.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    def of(self, words: Collection[str]) -> dict[str, bytes]:
        """A table that holds all ``words`` until the next call."""
        if len(self.young) > CACHED_WORDS:
            self.young, self.old = {"": b""}, self.young
        young, old = self.young, self.old
        unknown = [w for w in words if w not in young]
        marked: list[tuple[str, str, str]] = []
        new: set[str] = set()
        for w in unknown:
            if w in old:
                young[w] = old[w]
                continue
            core = w.rstrip(_MARKS)
            if len(core) < len(w) and core.isalpha():
                marked.append((w, core, w[len(core) :]))
                new.update(marked[-1][1:])
            else:
                new.add(w)
        self._encode([w for w in new if w not in young])
        for w, core, marks in marked:
            young[w] = young[core] + young[marks]
        return young

    def _encode(self, words: list[str]) -> None:
        letters = [w for w in words if w.isalpha()]
        rest = [w for w in words if not w.isalpha()]
        chunks = [letters[i : i + _TOGETHER] for i in range(0, len(letters), _TOGETHER)]
        for chunk, found in zip(chunks, self._ids([" ".join(c) for c in chunks]), strict=True):
            last = np.flatnonzero(self.ends[found]) + 1
            if len(last) != len(chunk):  # some letter becomes more than one part: each word by itself
                rest += chunk
                continue
            for w, a, b in zip(chunk, [0, *last[:-1].tolist()], last.tolist(), strict=True):
                self.young[w] = found[a:b].tobytes()
        for w, found in zip(rest, self._ids(rest), strict=True):
            self.young[w] = found.tobytes()

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


_known: dict[str, WordIds] = {}


def word_ids(path: str, words: list[str]) -> dict[str, bytes]:
    if path not in _known:
        _known[path] = WordIds(path)
    return _known[path].of(words)


def text_ids(path: str, texts: pa.Array) -> tuple[bytes, np.ndarray]:
    """The ids of all texts one after the other as bytes, closing ids included, and where each text begins and the last ends.

    Words are made distinct in Arrow, so each is looked up once per slice, and its ids are gathered for all its places.
    """
    spaced = pc.fill_null(texts.cast(pa.string()), "")
    for white in ("\n", "\t", "\r"):
        spaced = pc.replace_substring(spaced, white, " ")
    split = pc.split_pattern(spaced, " ")  # at least one part for each text
    words = split.flatten().dictionary_encode()
    last = len(words.dictionary)  # the closing id is one more word, behind each text
    one = pa.ListArray.from_arrays(pa.array([0, last], pa.int32()), words.dictionary)
    distinct = pc.binary_join(one, " ")[0].as_py().split(" ") if last else []  # no word holds a space
    known = word_ids(path, distinct)
    rows = [*map(known.__getitem__, distinct), END]
    size = np.concatenate([[0], np.cumsum(np.fromiter(map(len, rows), np.int64, len(rows)))])
    table = pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(size.tobytes()), pa.py_buffer(b"".join(rows))])
    counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    edge = np.cumsum(counts)
    index = np.insert(words.indices.to_numpy(zero_copy_only=False).astype(np.int64), edge, last)
    gathered = table.take(pa.array(index))
    offsets = np.frombuffer(gathered.buffers()[1], np.int64, len(index) + 1, gathered.offset * 8)
    return gathered.buffers()[2].to_pybytes(), offsets[np.concatenate([[0], edge + np.arange(1, len(counts) + 1)])]


def pieces_of(ids: bytes, capacity: int = CAPACITY, piece: int = PIECE) -> list[tuple[int, int, int]]:
    """``start, length, crc32`` of the pieces of a document's ids."""
    n = len(ids) // 4
    whole = n // capacity * capacity
    cuts = [*range(0, whole, capacity), *range(whole, n, piece), n]
    return [(a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]


def _tokenize(path: str):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, budget=SLICE_BYTES):
            data, edge = text_ids(path, part.column("text"))
            out = []
            for doc, a, b in zip(part.column("doc_id").to_pylist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                out += [(doc, *p, (b - a) // 4) for p in pieces_of(data[a:b])]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)
        if path in _known:  # the worker lives on: between tasks it keeps one generation only
            _known[path].old = {}

    return run


def difference(sizes: np.ndarray, k: int) -> np.ndarray:
    """Window of each item when ``k`` windows are made as equal as differencing makes them."""
    n = len(sizes)
    left, right = [], []  # inner nodes n, n + 1, ... of the trees of items that share a window
    heap = [(-int(s), i, np.array([s], np.int64), np.array([i], np.int64)) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    number = n
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        over = max(0, len(a) + len(b) - k)  # windows that both fill
        values = np.concatenate([a, b[: len(b) - over]])
        nodes = np.concatenate([x, y[: len(y) - over]])
        if over:
            # a descends: its last ``over`` windows meet the smallest of b in opposite order
            at = np.arange(len(a) - 1, len(a) - over - 1, -1)
            values[at] += b[len(b) - over :]
            left += nodes[at].tolist()
            right += y[len(y) - over :].tolist()
            nodes[at] = n + len(left) - over + np.arange(over)
        order = np.argsort(-values, kind="stable")
        values, nodes = values[order], nodes[order]
        if len(values) == k:
            values = values - values[-1]
        spread = int(values[0] - (values[-1] if len(values) == k else 0))
        number += 1
        heapq.heappush(heap, (-spread, number, values, nodes))
    out = np.zeros(n, np.int64)
    if heap:
        for window, node in enumerate(heap[0][3].tolist()):
            stack = [node]
            while stack:
                i = stack.pop()
                if i < n:
                    out[i] = window
                else:
                    stack += [left[i - n], right[i - n]]
    return out


def pack(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Window of each item; the fewest windows that differencing fits under ``capacity``, from the least possible on."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window = difference(sizes, k)
        if np.bincount(window, sizes, k).max(initial=0) <= capacity:
            return window
        k += 1


def _pack_group(table: pa.Table) -> pa.Table:
    table = table.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("row", "ascending")])
    sizes = table.column("length").to_numpy()
    window = pack(sizes)
    order = np.lexsort((np.arange(len(sizes)), window))
    ends = np.cumsum(sizes[order])
    first = np.searchsorted(window[order], np.arange(window.max() + 1))
    offset = np.zeros(len(sizes), np.int64)
    offset[order] = ends - sizes[order] - np.concatenate([[0], ends])[first][window[order]]
    sequence = 2 * ((table.column("pack")[0].as_py() << 24) + window)
    keep = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    return table.select(keep).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))


def kk_packing(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` of every piece; ``tokenizer``: the file's path."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    pieces = materialize(named.mapInArrow(settled_map(_tokenize(tokenizer)), fields).withColumn("row", F.monotonically_increasing_id()), "pieces")
    whole = pieces.where(F.col("length") == CAPACITY).select(*fields.replace(" long", "").split(", "), (2 * F.col("row") + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < CAPACITY)
    tokens = rest.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    groups = max(1, -(-tokens // GROUP_TOKENS))
    dealt = rest.withColumn("pack", F.pmod(F.xxhash64("row"), F.lit(groups)))
    packed = dealt.groupBy("pack").applyInArrow(settled(_pack_group), f"{fields}, sequence_id long, offset long")
    return whole.unionByName(packed)
