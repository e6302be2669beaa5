"""Each operator against brute force on a frame of awkward rows, and on an empty table."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cloakframe.llm import suffix_dedup as sd
from cloakframe.llm.components import components
from cloakframe.llm.embedding_dups import embedding_dups
from cloakframe.llm.jaccard_join import bands, classes, jaccard_join, missing, signatures
from cloakframe.llm.kk_packing import CAPACITY, difference, kk_packing, pack
from cloakframe.llm.language_crf import language
from cloakframe.llm.line_rules import line_rules, strip_lines
from cloakframe.llm.minimax_shards import minimax_shards
from cloakframe.llm.quality_svm import quality
from cloakframe.llm.shards import RANGE_BYTES, packed, sharded
from cloakframe.llm.source_mix import mixed_texts, source_mix
from cloakframe.llm.text import Scan, shingles
from cloakframe.llm.toxicity_bag import toxicity

from .frames import SCHEMA, awkward, brute_components, brute_removed, folded, frame, prose, shingle_set, words_of

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def rows():
    return awkward()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return frame(spark, [])


def labelled(spark, rows, column):
    data = [(r[0], i % 2 if column == "quality" else None, i % 2 if column == "toxic" else None) for i, r in enumerate(rows)]
    return spark.createDataFrame([*data, (None, 1, 1), (10**9, 1, 1)], "doc_id long, quality int, toxic int")


def held(doc_id, parts, rest):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % parts == rest


# --- text helpers


def test_words_and_shingles_match_plain_python(rows):
    texts = [(r[1] or "").encode() for r in rows]
    scan = Scan(texts, lower=True)
    first, last, counts = scan.words()
    raw = scan.buf.tobytes()
    found = [raw[a:b] for a, b in zip(first, last, strict=True)]
    assert found == [w for r in rows for w in folded(r[1])]
    doc, h = shingles(scan.hashes(first, last), counts, 3)
    assert Counter(doc.tolist()) == Counter({i: len(shingle_set(r[1], 3)) for i, r in enumerate(rows) if shingle_set(r[1], 3)})
    assert len(set(h.tolist())) == len(frozenset().union(*[shingle_set(r[1], 3) for r in rows]))


# --- 1 and 7: scores


@pytest.mark.parametrize(("score", "column", "parts", "rest"), [(quality, "quality", 4, 2), (toxicity, "toxic", 5, 0)])
def test_scores_have_a_row_per_document(spark, docs, nothing, rows, score, column, parts, rest):
    got = score(docs, labelled(spark, rows, column)).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert all(0 <= r.score <= 1 and r.held_out == held(r.doc_id, parts, rest) for r in got)
    none = labelled(spark, rows, column).where("false")
    assert {r.score for r in score(docs, none).collect()} == {0.5}
    one = labelled(spark, rows, column).where(f"{column} = 1")
    assert all(r.score > 0.5 for r in score(docs, one).collect())
    assert score(nothing, none).count() == 0


def test_quality_learns_held_out_junk(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, 60) if i % 3 else " ".join(w + "###" for w in prose(rng, 60).split()), "en", "s", 1) for i in range(400)]
    labels = spark.createDataFrame([(r[0], int(r[0] % 3 > 0), 0) for r in rows], "doc_id long, quality int, toxic int")
    got = [r for r in quality(frame(spark, rows), labels).collect() if r.held_out]
    assert len(got) > 50 and sum(r.predicted == int(r.doc_id % 3 > 0) for r in got) >= 0.97 * len(got)


def test_toxicity_finds_words_and_unseen_spellings(spark):
    rng = random.Random(2)
    bad = ["grumblefoo", "snarkwort", "blightish"]

    def text(i):
        words = prose(rng, 80).split()
        if i % 4 == 0:
            for w in bad[:2] + [bad[2]]:
                words.insert(rng.randrange(len(words)), w)
        return " ".join(words)

    rows = [(i, text(i), "en", "s", 1) for i in range(600)]
    rows += [(1000 + i, prose(rng, 40) + (" grumblefooo snarkworts" if i % 2 else ""), "en", "s", 1) for i in range(40)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(600)], "doc_id long, quality int, toxic int")
    got = toxicity(frame(spark, rows), labels).collect()
    known = [r for r in got if r.doc_id < 600 and r.held_out]
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in known) >= 0.95 * len(known)
    new = {r.doc_id: r.score for r in got if r.doc_id >= 1000}
    assert np.mean([new[1000 + i] for i in range(1, 40, 2)]) > np.mean([new[1000 + i] for i in range(0, 40, 2)]) + 0.3


# --- 2: repeated strings


def check_removed(got, rows):
    want = Counter((d, n, g, s, hashlib.sha256(k).hexdigest()) for d, n, g, s, k in brute_removed(rows, 50))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


def test_suffix_dedup_matches_brute_force(docs, nothing, rows):
    check_removed(sd.suffix_dedup(docs).collect(), rows)
    assert sd.suffix_dedup(nothing).count() == 0


def test_rows_without_id_are_spread_over_shards(spark):
    """A third of the rows without doc_id fill no shard; repeated texts stay together and the others keep their shard."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 2900).alias("text"))
    shards = sharded(df)
    sizes = [r["count"] for r in shards.docs.groupBy("shard").count().collect()]
    assert max(sizes) < 2 * 3000 / shards.count
    texts = shards.docs.where("doc_id is null").groupBy("text").agg(F.count_distinct("shard").alias("n"))
    assert texts.where("n > 1").isEmpty()


def test_suffix_dedup_with_small_blocks_and_hot_strings(spark, monkeypatch):
    rng = random.Random(4)
    common, passage = prose(rng, 30), prose(rng, 25)
    rows = [(i, f"{prose(rng, rng.randint(0, 40))} {common if i % 2 else passage}{prose(rng, rng.randint(0, 30))}", "en", "s", 1) for i in range(120)]
    monkeypatch.setattr(sd, "HOT", 20)
    counts = sd._kind(np.array([1, 2, 20, 21]))
    assert counts.tolist() == [0, 1, 1, 2]
    check_removed(sd.suffix_dedup(frame(spark, rows), block=2000).collect(), rows)


def test_suffix_dedup_matches_ranges_in_turns(spark, monkeypatch, rows):
    monkeypatch.setattr(sd, "MATCH_BYTES", 2000)
    check_removed(sd.suffix_dedup(frame(spark, rows)).collect(), rows)
    assert sd._kind(np.array([513, 10_000])).tolist() == [1, 1]  # in one group: its strings, one by one, hold several times the bytes


def test_pieces_alone_in_their_hash_need_no_suffix_array(monkeypatch):
    rng = np.random.default_rng(5)
    piece = rng.integers(97, 122, 70).astype(np.uint8)
    monkeypatch.setattr(sd, "smallest_ids", None)
    own, low, high = sd._gone(np.array([21, 21]), np.array([1, 2]), np.concatenate([piece, piece]), np.array([7, 3, 9]), sd.BLOCK)
    assert own.tolist() == [0, 2] and low.tolist() == [0, 0] and high.tolist() == [20, 20]


def test_few_rows_between_shards_and_ranges(spark):
    shards = sharded(spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a"), 100_000).alias("text")))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert shards.count <= max(4 * width, 300 // 8 + 1) and shards.ranges(RANGE_BYTES) <= max(width, 300 // 16 + 1)


def test_kept_text_keeps_whole_characters(spark):
    text = "é" * 60
    rows = [(1, "x" + text, None, None, 1), (2, "ä" + text[:25] + "ö", None, None, 1), (3, None, None, None, None)]
    got = {r.doc_id: r for r in sd.suffix_dedup(frame(spark, rows), with_text=True).collect()}
    assert got[1].text == "x" + text and got[2].text == "äö" and got[3].text == ""
    assert got[2].n_removed == 51 and [tuple(s) for s in got[2].spans] == [(2, 53)]  # the first byte of ö is that of é


@pytest.mark.parametrize("seed", range(4))
def test_string_order_and_prefixes(seed):
    rng = np.random.default_rng(seed)
    starts = rng.integers(1, 40, 60)
    size = starts + sd.LENGTH - 1
    parts = [rng.integers(97, 97 + (2 if seed % 2 else 4), n).astype(np.uint8) for n in size]
    for i in range(20, 60):  # shared stretches
        n = min(len(parts[i]), len(parts[i - 20]))
        parts[i][:n] = parts[i - 20][:n]
    buf, begin = np.concatenate(parts), np.cumsum(size) - size
    order = sd.string_order(buf, sd._left(begin, size, len(buf)))
    strings = [buf[i : i + sd.LENGTH].tobytes() for i in order]
    assert strings == sorted(strings) and len(strings) == starts.sum()
    common = sd.common_prefixes(buf, order, begin, starts)
    for i in range(1, len(order)):
        same = next((j for j in range(sd.LENGTH) if strings[i][j] != strings[i - 1][j]), sd.LENGTH)
        assert common[i] == same
    ids = rng.integers(0, 30, len(parts))
    least = defaultdict(lambda: 10**9)
    for p in range(len(parts)):
        for j in range(starts[p]):
            s = parts[p][j : j + sd.LENGTH].tobytes()
            least[s] = min(least[s], int(ids[p]))
    want = [least[parts[p][j : j + sd.LENGTH].tobytes()] for p in range(len(parts)) for j in range(starts[p])]
    for block in (1 << 20, 700, 100):
        assert sd.smallest_ids(buf, begin, starts, ids, block).tolist() == want


# --- 3: shards


def test_minimax_shards(docs, nothing, rows):
    got = minimax_shards(docs).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 1, None if r[1] is None else zlib.crc32(r[1].encode())) for r in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    homes = defaultdict(set)
    for r in got:
        homes[(r.size, r.text_crc32)].add(r.shard)
    assert all(len(h) == 1 for h in homes.values())
    assert minimax_shards(nothing).count() == 0


@pytest.mark.parametrize("big", [0, 40_000])
def test_minimax_capacity_is_the_smallest(spark, big):
    rng = random.Random(big)
    rows = [(i, prose(rng, rng.randint(1, 60)) + f" {i}", None, None, 1) for i in range(600)] + [(i, "z" * 99, None, None, 1) for i in range(1000, 1000 + big // 100)]
    got = minimax_shards(frame(spark, rows)).collect()
    order = {}
    for _, t, *_ in rows:
        order.setdefault(int(hashlib.sha256(t.encode()).hexdigest()[:15], 16), 0)
        order[int(hashlib.sha256(t.encode()).hexdigest()[:15], 16)] += len(t) + 1
    sizes = [order[k] for k in sorted(order)]

    def fits(capacity):
        shards, room = 1, capacity
        for s in sizes:
            if s > room:
                shards, room = shards + 1, capacity
            room -= s
        return shards <= 8 and capacity >= max(sizes)

    low, high = 1, sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    sums = Counter()
    for r in got:
        sums[r.shard] += r.size
    assert max(sums.values()) == low and len(sums) >= 7


# --- 4: similar sets


@pytest.mark.parametrize(("n", "per_cent"), [(3, 90), (5, 80), (1, 80)])
def test_jaccard_join_matches_brute_force(docs, nothing, rows, n, per_cent):
    got = jaccard_join(docs, n, per_cent).collect()
    want = brute_components(rows, n, per_cent)
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert Counter((r.doc_id, r.n_shingles) for r in got) == Counter((r[0], len(shingle_set(r[1], n))) for r in rows)
    assert all(r.component_id is None for r in got if r.doc_id is None)
    assert jaccard_join(nothing, n, per_cent).count() == 0


def test_jaccard_join_of_a_large_group_of_near_copies(spark, monkeypatch):
    import cloakframe.llm.jaccard_join as jj

    rng = random.Random(9)
    base = prose(rng, 100).split()
    line = prose(rng, 30)
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = prose(rng, 1)
        rows.append((i, " ".join(words), "en", "s", 1))
    rows += [(200 + i, line + " " + prose(rng, rng.randint(1, 12)), "en", "s", 1) for i in range(60)]
    monkeypatch.setattr(jj, "BLOCK_SETS", 16)
    got = {r.doc_id: r.component_id for r in jaccard_join(frame(spark, rows), 3, 90).collect()}
    assert got == brute_components(rows, 3, 90)


@pytest.mark.parametrize("block", [256, 2])
def test_jaccard_join_links_the_texts_of_one_doc_id(spark, monkeypatch, block):
    import cloakframe.llm.jaccard_join as jj

    monkeypatch.setattr(jj, "BLOCK_SETS", block)
    rng = random.Random(4)
    a, b, c, d, e = (prose(rng, 60) for _ in range(5))
    near = lambda text: text + " more"
    # 3 - 5 - 9 by equal texts; 1 - 20 - 2 by near ones, where 20 alone holds two sets; 30 with an empty text, and 31 of empty texts only
    texts = [(3, a), (5, a), (5, b), (9, b), (9, None), (1, c), (20, near(c)), (20, near(d)), (2, d), (30, e), (30, None), (31, None), (31, ""), (25, near(e)), (None, a), (None, None)]
    got = jaccard_join(frame(spark, [(i, t, "en", "s", 1) for i, t in texts]), 3, 80).collect()
    assert Counter((r.doc_id, r.n_shingles) for r in got) == Counter((i, len(shingle_set(t, 3))) for i, t in texts)
    assert {(r.doc_id, r.component_id) for r in got} == {(3, 3), (5, 3), (9, 3), (1, 1), (20, 1), (2, 1), (30, 25), (25, 25), (31, 31), (None, None)}


def test_signatures_cut_each_text_into_tokens_once(monkeypatch):
    import cloakframe.llm.jaccard_join as jj

    texts = [b"a b c d e f g h", b"a b c d e f g x", b""]
    known, counts = jj._keys(2)(np.array([1, 2, 3]), texts)
    seen, token_sets = [], jj.token_sets
    monkeypatch.setattr(jj, "token_sets", lambda part, n: seen.extend(part) or token_sets(part, n))
    answers = pa.table({"range": [0], "codes": pa.array([packed(jj._bits(counts).astype(np.uint8))], pa.binary())})
    out = jj._signer(2, 70, 1)(pa.table({"doc_id": [1, 2, 3], "text": [t.decode() for t in texts]}), answers)
    assert seen == texts
    assert out.column("n").to_pylist() == [7, 7, 0]
    first, second, none = out.column("signs").to_pylist()
    assert set(first) & set(second) and none == []


@pytest.mark.parametrize("per_cent", [80, 90])
def test_similar_sets_always_share_a_signature(per_cent):
    rng = np.random.default_rng(per_cent)
    vocabulary = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    code = dict(zip(vocabulary.tolist(), rng.integers(2, 9, 3000).tolist(), strict=True))
    for size in (2, 3, 5, 9, 10, 11, 20, 40, 100, 400):
        for _ in range(30):
            x = rng.choice(vocabulary, size, replace=False)
            lose = int(rng.integers(0, missing(size, per_cent) + 1))
            y = np.concatenate([x[lose:], rng.choice(vocabulary, int(rng.integers(0, 3)), replace=False)])
            x, y = np.unique(x), np.unique(y)
            inter = len(np.intersect1d(x, y))
            if 100 * inter >= per_cent * (len(x) + len(y) - inter):
                assert set(bands(len(x), per_cent)) & set(bands(len(y), per_cent))
                a, b = (signatures(s, np.array([code[t] for t in s.tolist()]), per_cent) for s in (x, y))
                assert len(np.intersect1d(a, b)), (size, lose)
    assert classes(1, per_cent) == 1


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3), (200, 300)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 30)}, 300: 200}


# --- 5: mixing


def brute_targets(rows):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(words_of(r[1]))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, full = {}, set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        target = {s: 3.0 * sizes[s] for s in full} | {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        more = {s for s in open_ if target[s] > 3 * sizes[s] * (1 + 1e-12)}
        if not more:
            return sizes, target
        full |= more


def test_source_mix(docs, nothing, rows):
    got = source_mix(docs).collect()
    sizes, target = brute_targets(rows)
    source = {r[0]: r[3] for r in rows}
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], len(words_of(r[1]))) for r in rows)
    taken = Counter()
    for r in got:
        s = source[r.doc_id]
        taken[s] += r.taken
        assert r.source_size == sizes[s] and abs(r.target - target[s]) < 1e-6 and 0 <= r.taken <= 3 * r.size
    assert all(abs(taken[s] - target[s]) <= 3 * 128 for s in sizes)
    assert sorted(map(tuple, source_mix(docs).collect()), key=str) == sorted(map(tuple, got), key=str)
    assert source_mix(nothing).count() == 0


def test_source_mix_caps_small_sources(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, 200), None, "a" if i < 3 else ("b" if i < 60 else None), 1) for i in range(90)]
    got = source_mix(frame(spark, rows)).collect()
    _, target = brute_targets(rows)
    sums = Counter()
    for r in got:
        sums["a" if r.doc_id < 3 else ("b" if r.doc_id < 60 else None)] += r.taken
    assert target["a"] == 1800 and sums["a"] == 1800 and all(r.taken <= 3 * r.size for r in got)
    assert all(abs(sums[s] - target[s]) < 200 for s in target)


def test_mixed_texts_hold_what_the_mix_takes(docs, nothing):
    taken = Counter()
    for r in source_mix(docs).collect():
        taken[r.doc_id] += r.taken
    got = mixed_texts(docs)
    assert got.columns == docs.columns
    words = Counter()
    for r in got.collect():
        words[r.doc_id] += len(words_of(r.text))
    assert sum(words.values()) == pytest.approx(sum(taken.values()), rel=0.05)
    assert mixed_texts(nothing).count() == 0


# --- 6: language


def test_language(spark, docs, nothing, rows):
    got = language(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    text = {r[0]: r[1] for r in rows}
    for r in got:
        letters = any(c.isalpha() for c in text[r.doc_id] or "") if r.doc_id is not None else None
        assert 0 <= r.score <= 1 and r.held_out == held(r.doc_id, 4, 2) and r.lang_pred in {"en", "fr", "und"}
        if letters is not None:
            assert (r.lang_pred == "und") == (not letters)
    assert {r.lang_pred for r in language(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language(nothing).count() == 0


def test_language_learns_and_labels_mixed_text(spark):
    rng = random.Random(8)
    kinds = {"aa": "abcde", "bb": "efghi", "cc": "ijklm"}
    rows = [(i, prose(rng, rng.randint(1, 90), kinds[k]), k, "s", 1) for i in range(300) for k in [sorted(kinds)[i % 3]]]
    rows += [(900, prose(rng, 70, kinds["aa"]) + " " + prose(rng, 30, kinds["bb"]), None, "s", 1)]
    got = {r.doc_id: r for r in language(frame(spark, rows)).collect()}
    wrong = [i for i in range(300) if got[i].held_out and got[i].lang_pred != rows[i][2]]
    assert len(wrong) <= 2 and got[900].lang_pred == "aa" and 0.6 < got[900].score < 0.8


# --- 8: packing


def test_kk_packing_covers_every_id_once(docs, nothing, rows):
    got = kk_packing(docs, VOCABULARY).collect()
    tokenizer = Tokenizer.from_file(VOCABULARY)
    want = Counter()
    for d, t, *_ in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want[(d, len(ids))] += 1
        for r in (r for r in got if r.doc_id == d and r.doc_tokens == len(ids)):
            assert r.ids_crc32 in {zlib.crc32(np.array([*tokenizer.encode(x[1] or "", add_special_tokens=False).ids, 2], "<u4")[r.start : r.start + r.length].tobytes()) for x in rows if x[0] == d}
    covered = Counter()
    windows = defaultdict(list)
    for r in got:
        covered[(r.doc_id, r.doc_tokens)] += r.length
        windows[r.sequence_id].append((r.offset, r.length))
    assert covered == Counter({k: k[1] * n for k, n in want.items()})
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= CAPACITY
    assert kk_packing(nothing, VOCABULARY).count() == 0


def test_word_ids_equal_whole_texts(rows, monkeypatch):
    import cloakframe.llm.kk_packing as kk

    monkeypatch.setattr(kk, "CACHED_WORDS", 40)
    known = kk.WordIds(VOCABULARY)
    odd = ["İstanbul ΑΣ ΑΣ. ﬁne e\u0301tude don't it's' we've!! x.y a... <|startoftext|>, ²x Ⅷ ab١", "THE the The the, the. the... (the) 中文。 a\u00a0b a\u001fb"]
    for text in [r[1] or "" for r in rows] + odd:
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        table = known.of(set(words))
        assert np.frombuffer(b"".join(table[w] for w in words), "<u4").tolist() == known.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(3))
def test_differencing_is_near_equal_and_packs_tightly(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 1025, 1500)
    window = difference(sizes, 200)
    sums = np.bincount(window, sizes, 200)
    assert len(window) == 1500 and sums.max() - sums.min() <= 200
    packed = pack(sizes)
    sums = np.bincount(packed, sizes)
    assert sums.max() <= CAPACITY and sizes.sum() >= 0.97 * CAPACITY * len(sums)
    assert difference(np.array([5]), 3).tolist() == [0]
    assert sorted(np.bincount(difference(np.array([4, 3, 2]), 3), minlength=3)) == [1, 1, 1]


# --- 9: vectors


def test_embedding_dups_match_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(40, 16))
    vectors = [(base[i % 40] + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.2])).tolist() for i in range(400)]
    rows = [(i, [float(x) for x in np.float32(v)], 1) for i, v in enumerate(vectors)]
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [1.0, None] * 8, 1), (503, [float("nan")] * 16, 1), (504, [float("inf")] + [1.0] * 15, 1), (505, [], 1), (506, [1.0, 2.0], 1), (507, [2.0, 4.0], 1)]
    rows += [(0, rows[0][1], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1L as id", "'k' as key", "2 as copies")
    good = [(i, np.array(v, float)) for i, v, _ in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    from .frames import Union

    union, links = Union(), Counter()
    for a, (i, x) in enumerate(good):
        for j, y in good[:a]:
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.95:
                union.join(i, j)
                links[i] += 1
                links[j] += 1
    got = embedding_dups(df).collect()
    assert Counter(r.vec_id for r in got) == Counter(r[0] for r in rows)
    for r in got:
        if r.vec_id:  # the repeated id counts links of both its rows
            assert r.component_id == union.find(r.vec_id) and r.kept == (r.vec_id == r.component_id)
    missed = sum(links[r.vec_id] - r.n_links for r in got if r.vec_id)
    assert 0 <= missed <= 0.02 * sum(links.values()) and all(r.n_links <= links[r.vec_id] for r in got if r.vec_id)
    assert embedding_dups(df.where("false")).count() == 0


def test_embedding_dups_cut_a_crowded_code_into_blocks(spark, monkeypatch):
    import cloakframe.llm.embedding_dups as ed

    monkeypatch.setattr(ed, "BLOCK", 16)
    rng = np.random.default_rng(1)
    x = np.ones(8) + rng.normal(size=(150, 8)) * 0.15
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = ((u @ u.T) >= 0.95).sum(1) - 1
    got = {r.vec_id: r.n_links for r in embedding_dups(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    assert sum(got.values()) >= 0.98 * want.sum() and all(got[i] <= want[i] for i in got)


# --- 10: line rules


def brute_measures(text):
    t = text or ""
    w = words_of(t)
    seen, dup = set(), 0
    for line in t.encode().split(b"\n"):
        if words_of(line.decode()):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = set()
    for i in range(len(w) - 4):
        if grams[tuple(w[i : i + 5])] > 1:
            inside.update(range(i, i + 5))
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), dup, len(inside)


def test_line_rules(spark, docs, nothing, rows):
    more = [(3000 + i, t, None, "s", 1) for i, t in enumerate(["a b\nc d\na b\n\n\na b", "a b c d e a b c d e f", "#x | <y> && \n%", "é ü\né ü", "1 2 3 4 5 6 7 8 9 10 11 12"])]
    got = line_rules(frame(spark, rows + more)).collect()
    want = Counter((r[0], *brute_measures(r[1])) for r in rows + more)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and (not r.base_failed or not r.kept)
    assert line_rules(nothing).count() == 0


def test_line_rules_remove_frequent_lines_per_host(spark):
    rng = random.Random(5)
    line = "Subscribe to our 24 newsletters now and here"
    rows = [(i, f"{line.upper() if i % 2 else line}\n{prose(rng, 40)}", None, "a", 1) for i in range(12)]
    rows += [(100 + i, f"{line}\n{prose(rng, 40)}", None, "b", 1) for i in range(3)]
    rows += [(200, f"{line}  \n subscribe to our 99 newsletters now AND here\n{line}\nleft over", None, "a", 1)]
    found = line_rules(frame(spark, rows), max_docs=5)
    got = {r.doc_id: r for r in found.collect()}
    assert all(got[i].removed_words == 8 and got[i].kept for i in range(12))
    assert all(got[100 + i].removed_words == 0 for i in range(3))
    assert got[200].removed_words == 24 and not got[200].kept
    left = {r.doc_id: r.text for r in strip_lines(frame(spark, rows), found).collect()}
    assert left[0] == rows[0][1].split("\n")[1] and left[100] == rows[12][1] and 200 not in left


def test_every_query_is_registered(spark):
    import __spark_entry__ as entry

    names = {n.split("_")[0] for n in entry.queries() if n.startswith("op") and n[2].isdigit()}
    assert names == {f"op{i}" for i in range(1, 11)} and "pipeline" in entry.queries()
    assert SCHEMA
