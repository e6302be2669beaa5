"""Small frames with every awkward row, and brute-force helpers."""

from __future__ import annotations

import random
import re

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: names that operators use inside
CLASHING = "score double, shard int, row long, size long, hash long, key string, n long, id long, label int, host string, kept string, cluster long, range long"


def prose(rng: random.Random, words: int, alphabet: str = "abcdefgh") -> str:
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 7))) for _ in range(words))


def awkward(seed: int = 3) -> list[tuple]:
    """Nulls in every column, empty and very long texts, copies, near copies, repeated rows, odd characters."""
    rng = random.Random(seed)
    base = prose(rng, 120)
    words = base.split()
    near = [" ".join(words[:i] + ["other"] + words[i + 1 :]) for i in (60, 61, 3)]
    line = prose(rng, 20)
    texts = [
        None, "", " \n\t ", "one", "two words", base, base, *near, base.upper(), prose(rng, 20_000), line + "\n" + prose(rng, 80), prose(rng, 40) + "\n" + line,
        "é" * 200, "x" * 300, "x" * 300 + " y", "ab " * 100, "<|endoftext|> it's 12 Ünïcödé 日本語     ß", "\x00" * 60 + "tail", "\x00" * 60 + "tale", "123 456 !!",
        *[prose(rng, rng.randint(3, 300)) for _ in range(60)],
    ]
    rows = [(i, t, "en" if i % 3 else ("fr" if i % 2 else None), f"s{i % 4}" if i % 7 else None, len(t) if t else None) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, base, None, None, None), (None, None, None, None, None)]
    return rows


def frame(spark, rows: list[tuple], clash: bool = True):
    from pyspark.sql import functions as F
    from pyspark.sql.types import _parse_datatype_string

    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if clash:
        for field in _parse_datatype_string(CLASHING).fields:
            df = df.withColumn(field.name, F.lit(None).cast(field.dataType))
    return df


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode())


def folded(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))))


class Union:
    def __init__(self) -> None:
        self.up: dict = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def shingle_set(text: str | None, n: int) -> frozenset:
    w = folded(text)
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_components(rows: list[tuple], n: int, per_cent: int) -> dict:
    """doc_id -> (allowed set sizes, component) by comparing all pairs."""
    sets = [(r[0], shingle_set(r[1], n)) for r in rows if r[0] is not None]
    union = Union()
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            both = len(x & y)
            if both and 100 * both >= per_cent * (len(x) + len(y) - both):
                union.join(a, b)
    return {a: union.find(a) for a, _ in sets}


def brute_removed(rows: list[tuple], length: int) -> list[tuple]:
    """(doc_id, n_bytes, removed, spans, kept) of every row."""
    far = 1 << 62
    keyed = [(far if r[0] is None else r[0], r[0], (r[1] or "").encode()) for r in rows]
    seen: dict[bytes, int] = {}
    for k, _, t in keyed:
        for i in range(len(t) - length + 1):
            s = t[i : i + length]
            seen[s] = min(seen.get(s, far), k)
    out = []
    for k, d, t in keyed:
        gone, reach = bytearray(len(t)), 0
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] < k:
                for j in range(max(i, reach), i + length):
                    gone[j] = 1
                reach = i + length
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((d, len(t), sum(gone), spans, bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return out
