"""Language of whole texts by a linear-chain conditional random field over words.

Each word has hashed features: two to four byte n-grams, prefixes and suffixes of
one to four bytes, the word itself, and its log shares in a lexicon of frequent
training words. A matrix of learned transitions joins neighbouring words.
Sequences are runs of ``RUN`` words, and every run of a text is labelled by
forward-backward. Documents carry one label, so training sequences are put
together from spans of different documents; that teaches changes of language.
A document's language is the one with the largest sum of marginals over its
words with a letter, and its score is that language's share.

Edge cases: a null text and one without a letter are ``und`` with score 0;
without labelled documents all are. Equal sums go to the label first in code-point order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import held_out
from .fitting import Model, fit, sample_of, with_texts
from .text import LOWER, SPACE, Scan, as_bytes, mix, owner, slices

SAMPLE_ROWS = 2000  # labelled documents the model is fitted on, at most
RUN = 32  # words in a sequence
RUNS_OF_A_DOCUMENT = 6  # training spans cut from one document of the sample
BITS = 16
LEXICON = 20_000
_FOLD = LOWER.copy()
_FOLD[SPACE] = 10
_MASK = np.uint64((1 << BITS) - 1)
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


class Words:
    """Words of many documents, the distinct ones among them, and the features of those."""

    def __init__(self, texts: list[bytes]) -> None:
        scan = Scan(texts)
        letters = np.concatenate([[0], np.cumsum(_LETTER[scan.buf] | (scan.buf >= 128))])
        scan.buf = _FOLD[scan.buf]
        first, last, self.counts = scan.words()
        self.hash, at, self.form = np.unique(scan.hashes(first, last), return_index=True, return_inverse=True)
        first, last = first[at], last[at]
        self.has_letter = letters[last] > letters[first]
        found = [(self.hash, np.arange(len(at)))]
        size = last - first
        for k in (1, 2, 3, 4):
            able = np.flatnonzero(size >= k)
            found.append((mix(scan.hashes(first[able], first[able] + k) ^ np.uint64(0xA1)), able))
            found.append((mix(scan.hashes(last[able] - k, last[able]) ^ np.uint64(0xB2)), able))
        for k in (2, 3, 4):
            grams = scan.grams(k)
            spread = np.maximum(size - k + 1, 0)
            own = owner(spread)
            place = first[own] + np.arange(len(own)) - (np.cumsum(spread) - spread)[own]
            found.append((grams[place], own))
        self.feature = np.concatenate([(h & _MASK).astype(np.int64) for h, _ in found])
        self.word = np.concatenate([w for _, w in found])
        order = np.argsort(self.word, kind="stable")
        self.feature, self.word = self.feature[order], self.word[order]
        self.edge = np.searchsorted(self.word, np.arange(len(at) + 1))


def emissions(model: Model, words: Words) -> np.ndarray:
    """Scores of the labels for each distinct word."""
    weights = model["weights"]
    k, n = weights.shape[1], len(words.hash)
    out = np.stack([np.bincount(words.word, weights[words.feature, j], n) for j in range(k)], 1) if n else np.zeros((0, k))
    return out + model["scale"] * looked_up(model, words.hash)


def looked_up(model: Model, h: np.ndarray) -> np.ndarray:
    known = model["lexicon"]
    out = np.zeros((len(h), model["weights"].shape[1]))
    if len(known):
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        hit = known[at] == h
        out[hit] = model["shares"][at[hit]]
    return out


def forward_backward(scores: np.ndarray, valid: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of (sequence, place, label), expected moves, and log of the sums, for padded sequences."""
    n, length, k = scores.shape
    top = scores.max(2, keepdims=True)
    p = np.where(valid[:, :, None], np.exp(scores - top), 1.0)
    a = np.exp(moves)
    forward, backward, scale = np.zeros_like(p), np.ones_like(p), np.ones((n, length))
    for t in range(length):
        now = p[:, t] * (forward[:, t - 1] @ a if t else 1.0)
        now = np.where(valid[:, t, None], now, forward[:, t - 1] if t else now)
        scale[:, t] = np.where(valid[:, t], now.sum(1), 1.0)
        forward[:, t] = now / now.sum(1, keepdims=True)
    for t in range(length - 2, -1, -1):
        now = (p[:, t + 1] * backward[:, t + 1]) @ a.T
        backward[:, t] = np.where(valid[:, t + 1, None], now / np.maximum(scale[:, t + 1, None], 1e-300), 1.0)
    marginal = forward * backward
    marginal /= np.maximum(marginal.sum(2, keepdims=True), 1e-300)
    expected = np.zeros((k, k))
    for t in range(1, length):
        on = valid[:, t]
        if on.any():
            right = p[on, t] * backward[on, t] / scale[on, t, None]
            expected += a * (forward[on, t - 1].T @ right)
    logs = np.where(valid, np.log(np.maximum(scale, 1e-300)) + top[:, :, 0], 0.0).sum(1)
    return marginal, expected, logs


def runs(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence and place of each word when every document is cut into runs, and the number of runs."""
    pieces = -(-counts // RUN)
    place = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(np.cumsum(pieces) - pieces, counts) + place // RUN, place % RUN, int(pieces.sum())


def train(texts: list[bytes], labels: list[str]) -> Model:
    names = sorted(set(labels))
    k = len(names)
    y = np.searchsorted(names, labels)
    rng = np.random.default_rng(5)
    words = Words(texts)
    model: Model = {"names": np.array(names), "weights": np.zeros((1 << BITS, k)), "moves": np.zeros((k, k)), "scale": np.array(0.5)}
    own = np.repeat(y, words.counts)
    table = np.stack([np.bincount(words.form[own == j], minlength=len(words.hash)) for j in range(k)], 1).astype(float)
    often = np.flatnonzero(table.sum(1) >= 3)
    often = np.sort(often[np.argsort(-table[often].sum(1), kind="stable")[:LEXICON]])
    share = (table[often] + 0.1) / np.maximum(table.sum(0), 1)
    model["lexicon"], model["shares"] = words.hash[often], np.log(share / share.sum(1, keepdims=True)) - np.log(1 / k)
    # sequences of one to three spans, each of another document
    first = np.cumsum(words.counts) - words.counts
    spans = [(i, s) for i in range(len(texts)) for s in rng.permutation(max(1, words.counts[i] // RUN))[:RUNS_OF_A_DOCUMENT] if words.counts[i]]
    spans = [spans[i] for i in rng.permutation(len(spans))]
    rows = []
    while spans:
        cuts = np.sort(rng.integers(1, RUN, rng.integers(0, 3)))
        pieces = []
        for size in np.diff(np.concatenate([[0], cuts, [RUN]])):
            if spans and size:
                i, s = spans.pop()
                at = first[i] + s * RUN
                take = min(int(size), int(first[i] + words.counts[i] - at))
                pieces.append((np.arange(at, at + take), np.full(take, y[i])))
        rows.append((np.concatenate([p[0] for p in pieces]), np.concatenate([p[1] for p in pieces])))
    sum_w, sum_m, sum_s = np.full((1 << BITS, k), 1e-6), np.full((k, k), 1e-6), 1e-6
    lex = looked_up(model, words.hash)
    for _ in range(4):
        for batch in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 128)):
            valid = np.zeros((len(batch), RUN), bool)
            form, gold = np.zeros((len(batch), RUN), np.int64), np.zeros((len(batch), RUN), np.int64)
            for r, b in enumerate(batch):
                at, g = rows[b]
                valid[r, : len(at)], form[r, : len(at)], gold[r, : len(at)] = True, words.form[at], g
            ids, place = np.unique(form[valid], return_inverse=True)
            spread = words.edge[ids + 1] - words.edge[ids]
            of = owner(spread)
            feature = words.feature[words.edge[ids][of] + np.arange(len(of)) - (np.cumsum(spread) - spread)[of]]
            score = np.stack([np.bincount(of, model["weights"][feature, j], len(ids)) for j in range(k)], 1) + model["scale"] * lex[ids]
            full = np.zeros((len(batch), RUN, k))
            full[valid] = score[place]
            marginal, expected, _ = forward_backward(full, valid, model["moves"])
            wrong = marginal[valid]
            wrong[np.arange(len(place)), gold[valid]] -= 1
            step = np.stack([np.bincount(place, wrong[:, j], len(ids)) for j in range(k)], 1)
            seen = np.zeros((k, k))
            both = valid[:, 1:]
            np.add.at(seen, (gold[:, :-1][both], gold[:, 1:][both]), 1)
            g_scale = float((step * lex[ids]).sum()) / len(batch)
            sum_s += g_scale**2
            model["scale"] = model["scale"] - 0.05 * g_scale / np.sqrt(sum_s)
            g_moves = (expected - seen) / len(batch) + 1e-3 * model["moves"]
            sum_m += g_moves**2
            model["moves"] = model["moves"] - 0.2 * g_moves / np.sqrt(sum_m)
            for j in range(k):
                g = np.bincount(feature, step[of, j], 1 << BITS) / len(batch)
                touched = np.flatnonzero(g)
                sum_w[touched, j] += g[touched] ** 2
                model["weights"][touched, j] -= 0.1 * g[touched] / np.sqrt(sum_w[touched, j])
    return model


def label(model: Model, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the label of each document (-1 without a word with a letter), its share, and the label of each word."""
    words = Words(texts)
    n, k = len(texts), model["weights"].shape[1]
    sequence, place, rows = runs(words.counts)
    score = emissions(model, words)
    full, valid = np.zeros((rows, RUN, k)), np.zeros((rows, RUN), bool)
    full[sequence, place], valid[sequence, place] = score[words.form], True
    marginal = forward_backward(full, valid, model["moves"])[0][sequence, place] if rows else np.zeros((0, k))
    letters = words.has_letter[words.form]
    doc = owner(words.counts)
    for d in np.unique(doc[letters]):  # bytes above 127 may be signs: a text without A-Z is looked at by character
        if not _LETTER[np.frombuffer(texts[d], np.uint8)].any() and not any(c.isalpha() for c in texts[d].decode()):
            letters[doc == d] = False
    sums = np.stack([np.bincount(doc[letters], marginal[letters, j], n) for j in range(k)], 1)
    best = sums.argmax(1)
    share = sums[np.arange(n), best] / np.maximum(sums.sum(1), 1e-300)
    return np.where(sums.sum(1) > 0, best, -1), share, marginal.argmax(1)


def language(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document; fitted on at most ``rows`` documents outside the held-out part."""
    learn = docs.where(~held_out("doc_id", 4, 2))
    model = fit(with_texts(docs, sample_of(learn, "doc_id", "lang", rows)), train)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = as_bytes(part.column("text"))
            best, share = np.full(len(texts), -1), np.zeros(len(texts))
            if model is not None:
                best, share, _ = label(model.value, texts)
            names = [str(model.value["names"][i]) if i >= 0 else "und" for i in best]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(np.clip(share, 0.0, 1.0))], schema=schema)

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return named.mapInArrow(run, "doc_id long, lang_pred string, score double").select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
