"""The corpus pipeline, stage by stage, against brute force over a small folder of tables."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp

from .frames import SCHEMA, brute_components, brute_removed, frame, prose, words_of


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    passage, base = prose(rng, 60), prose(rng, 200)
    rows = []
    for i in range(240):
        kind = i % 8
        text = prose(rng, rng.randint(20, 200))
        if kind == 0:
            text = " ".join(w + "###" for w in text.split())  # junk
        elif kind == 1:
            words = base.split()
            words[rng.randrange(200)] = "edit"
            text = " ".join(words)
        elif kind == 2:
            text = text + "\n" + passage + "\n" + prose(rng, 30)
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
    rows += [(300, None, None, None, None), (301, "", "en", "s0", 0), rows[9], (None, prose(rng, 50), "en", None, 1)]
    path = str(tmp_path_factory.mktemp("tables"))
    frame(spark, rows, clash=False).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i % 8 > 0), 0) for i in range(240)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows


def collected(df):
    return [tuple(r[c] for c in cp.COLUMNS) for r in df.collect()]


def test_stages(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert [name for name, _ in cp.STAGES] == ["quality_classifier", "near_duplicates", "repeated_strings", "mix_sources", "packing"]

    docs = cp.materialize(cp.quality_classifier(spark, docs, path), "test")
    kept = collected(docs)
    assert docs.columns == list(cp.COLUMNS) and set(kept) <= set(rows)
    assert {r[0] for r in kept} >= {i for i in range(240) if i % 8} and sum(1 for r in kept if r[0] is not None and r[0] < 240 and r[0] % 8 == 0) <= 1

    before = kept
    docs = cp.materialize(cp.near_duplicates(spark, docs, path), "test")
    kept = collected(docs)
    component = brute_components(before, 5, 80)
    assert Counter(r[0] for r in kept) == Counter([d for d, c in component.items() if d == c] + [r[0] for r in before if r[0] is None])
    assert set(kept) <= set(before)

    before = kept
    docs = cp.materialize(cp.repeated_strings(spark, docs, path), "test")
    kept = collected(docs)
    want = {d: k.decode() for d, _, _, _, k in brute_removed(before, 50)}  # the texts are ASCII, so no character is cut
    assert {r[0]: r[1] for r in kept} == want and all(r[4] == len(r[1]) for r in kept)
    assert sum(len(r[1]) for r in kept) < sum(len(r[1] or "") for r in before)

    before = {r[0]: r for r in kept}
    docs = cp.materialize(cp.mix_sources(spark, docs, path), "test")
    kept = collected(docs)
    assert len({r[0] for r in kept}) == len(kept)
    sums, sizes = Counter(), Counter()
    for r in before.values():
        sizes[r[3]] += len(words_of(r[1]))
    for r in kept:
        old, new = Counter(words_of(before[r[0]][1])), Counter(words_of(r[1]))
        assert new and set(new) <= set(old) and all(new[w] <= 3 * old[w] for w in new) and r[2:4] == before[r[0]][2:4] and r[4] == len(r[1])
        sums[r[3]] += sum(new.values())
    weight = dict(zip(sorted(sizes, key=lambda s: (s is None, s or "")), (5, 2, 1, 5), strict=True))
    assert sums[None] == 3 * sizes[None] and sums["s0"] > sums["s1"] > sums["s2"]
    rest = sum(sizes.values()) - 3 * sizes[None]
    assert all(abs(sums[s] - rest * weight[s] / 8) <= 3 * 128 for s in ("s0", "s1", "s2"))

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    covered = Counter()
    for r in cp.packing(spark, docs, path).collect():
        covered[(r.doc_id, r.doc_tokens)] += r.length
    assert covered == Counter({(r[0], n): n for r in kept for n in [len(tokenizer.encode(r[1], add_special_tokens=False).ids) + 1]})


def test_run_is_the_chain_of_stages(spark, folder):
    got = cp.run(spark, folder[0])
    again = cp.run(spark, folder[0])
    key = lambda df: sorted((str(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in df.collect())
    first = key(got)
    assert first == key(again) and np.all([n <= 4096 for _, _, n, _, _ in first])


def test_stages_of_nothing(spark, folder):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in cp.STAGES:
        docs = cp.materialize(stage(spark, docs, folder[0]), "test")
    assert docs.count() == 0
