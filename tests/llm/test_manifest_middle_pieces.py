"""Merkle manifest, fill-in-the-middle and piece encoding against plain Python and the tokenizer's own library."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from cloakframe.llm import fill_middle as fm
from cloakframe.llm import merkle_manifest as mm
from cloakframe.llm import piece_codec as pieces
from cloakframe.llm.text import SPACE

from .frames import awkward, frame, prose

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def rows():
    return awkward()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return frame(spark, [])


# --- 11: manifest


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_field(x) -> str:
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def brute_leaf(r, text) -> str:
    return sha(*[brute_field(x) for x in (r[0], r[3], r[2], r[4], text)])


def brute_tree(hashes: list[str], arity: int) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root, and for each leaf its (left, right) siblings from the bottom up."""
    paths, place, level = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(level) > 1:
        for leaf, i in enumerate(place):
            run = i // arity * arity
            paths[leaf].append(("".join(level[run:i]), "".join(level[i + 1 : run + arity])))
        place = [i // arity for i in place]
        level = [sha(*level[k : k + arity]) for k in range(0, len(level), arity)]
    return level[0], paths


def brute_manifest(rows, arity=mm.ARITY) -> Counter:
    by_lang: dict = {}
    for r in rows:
        changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or "")
        by_lang.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, brute_leaf(r, r[1]), brute_leaf(r, lower) if changed else None, r[0]))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {lang: brute_tree([x[2] for x in sorted(by_lang[lang], key=lambda x: x[:3])], arity) for lang in langs}
    root, upper = brute_tree([trees[lang][0] for lang in langs], arity)
    out = Counter()
    for k, lang in enumerate(langs):
        for x, path in zip(sorted(by_lang[lang], key=lambda x: x[:3]), trees[lang][1], strict=True):
            h = x[3] or x[2]
            for left, right in path + upper[k]:
                h = sha(left, h, right)
            proof = sha(*[left + right for left, right in path + upper[k]])
            out[(x[4], x[2], trees[lang][0], root, proof, h, h == root)] += 1
    return out


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def test_manifest_is_that_of_plain_python(docs, rows):
    got = Counter(tuple(r[c] for c in COLUMNS) for r in mm.verified_manifest(docs).collect())
    assert got == brute_manifest(rows)
    assert {r[6] for r in got} == {True, False}


def test_manifest_of_one_row_and_of_none(spark, nothing):
    one = [(7, "ABC", None, None, 3)]
    got = [tuple(r[c] for c in COLUMNS) for r in mm.verified_manifest(frame(spark, one)).collect()]
    assert Counter(got) == brute_manifest(one) and got[0][1] == got[0][3] and got[0][4] == sha()
    assert mm.verified_manifest(nothing).count() == 0


def test_many_languages_and_a_hot_one(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, 3), f"l{i}" if i < 70 else "hot", "s", i) for i in range(300)]
    got = Counter(tuple(r[c] for c in COLUMNS) for r in mm.verified_manifest(frame(spark, rows)).collect())
    assert got == brute_manifest(rows)


@pytest.mark.parametrize("arity", [2, 3])
def test_other_arities(spark, docs, rows, arity):
    found, root = mm.manifest(docs, arity=arity)
    assert root == next(iter(brute_manifest(rows, arity)))[3]
    assert {r[0] for r in found.select(mm.folded(F.col("leaf"), F.col("path"))).collect()} == {root}


# --- 12: fill in the middle


def brute_middle(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'-' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    if not text or any(m in text for m in fm.MARKERS) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_middles_and_their_way_back(spark, rows, nothing):
    marked = [(900, "a <P> b", None, None, None), (901, "a <M", None, None, None), (902, "P>x<" * 30, None, None, None), (903, "<<S" * 40 + "é" * 9, None, None, None)]
    every = [*rows, *marked]
    found = fm.fill_middle(frame(spark, every))
    got = Counter(tuple(r) for r in found.collect())
    assert got == Counter(brute_middle(r[0], r[1]) for r in every)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    back = Counter((r.doc_id, r.text) for r in fm.restore_middle(found).collect())
    assert back == Counter((r[0], r[1] or "") for r in every)
    assert fm.fill_middle(nothing).count() == 0


def word_begins(text: bytes) -> list[int]:
    inside = ~SPACE[np.frombuffer(text, np.uint8)]
    return [i for i in range(len(text)) if inside[i] and (i == 0 or not inside[i - 1])]


@pytest.mark.parametrize("units", ["chars", "words"])
def test_cuts_do_not_depend_on_chunks(rows, units):
    texts = [(r[1] or "").encode() for r in rows] + [b"x" * 20_000, ("é " * 9_000).encode(), b" " * 5_000 + b"end"]
    memory = fm.Memory(fm.UNITS[units])
    for text, doc in zip(texts, fm.counted(texts, memory), strict=True):
        assert b"".join(doc.chunks) == text and all(len(c) <= fm.LONGEST for c in doc.chunks)
        begins = word_begins(text) if units == "words" else [i for i, c in enumerate(text) if c & 0xC0 != 0x80]
        assert doc.n == len(begins)
        for k in {0, 1, 2, doc.n // 3, doc.n // 2, doc.n - 1, doc.n}:
            want = 0 if k <= 0 or not begins else len(text) if k >= doc.n else begins[k]
            assert doc.cut(k) == want


def test_equal_passages_share_chunks_and_blocks_do_not_show(monkeypatch):
    rng = random.Random(8)
    passage = prose(rng, 3_000).encode()
    texts = [prose(rng, 400).encode() + passage, passage + b"!", b"\n" * 77 + passage]
    found = [set(d.chunks) for d in fm.counted(texts, fm.Memory(fm.UNITS["chars"]))]
    shared = set.intersection(*found)
    assert sum(map(len, shared)) > 0.8 * len(passage)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    first = np.cumsum([0, *map(len, texts[:-1])])
    whole = fm.chunk_ends(raw, first)
    monkeypatch.setattr(fm, "BLOCK", 1_001)
    assert np.array_equal(whole, fm.chunk_ends(raw, first))


def test_a_full_memory_forgets_and_stays_right(monkeypatch):
    monkeypatch.setattr(fm, "CACHE_BYTES", 2_000)
    rng = random.Random(9)
    texts = [prose(rng, 200).encode() for _ in range(40)]
    memory = fm.Memory(fm.UNITS["words"])
    for _ in range(2):
        assert [d.n for d in fm.counted(texts, memory)] == [len(t.split()) for t in texts]
    assert sum(map(len, memory.young)) + sum(map(len, memory.old)) < 12_000


def test_markers_must_be_told_apart(docs):
    for markers in (("<P>", "<P>", "<M>"), ("<P>", "<P>x", "<M>"), ("ab", "bc", "<M>"), ("", "a", "b")):
        with pytest.raises(ValueError, match="marker"):
            fm.fill_middle(docs, markers=markers)


# --- 13: pieces


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def odd_texts(seed: int, letters: str, count: int = 150) -> list[str]:
    rng = random.Random(seed)
    fixed = ["", " ", "  a", "a  ", " ▁ ", "▁", "日本語 と", "x" * 300, "ab" * 200 + " c", "the " * 100, "😀😀", " " * 50]
    return fixed + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 120))) for _ in range(count)]


LETTERS = " abcdefgh  éß日本語▁\n\t\x00<>0123456789’😀क्षि ﬁ①Ａ　"


def same_as_library(model, library, texts):
    ids, tokens, edges = pieces.encode_texts(texts, model)
    decoded = pieces.Surfaces(model).texts(ids, tokens)
    at = np.cumsum([0, *tokens])
    for k, text in enumerate(texts):
        want = library.encode(text)
        assert ids[at[k] : at[k + 1]].tolist() == want, text
        assert decoded[k] == library.decode(want), text
        proto = library.encode(text, return_type="proto").pieces
        assert edges[at[k] + k : at[k + 1] + k + 1].tolist()[:-1] == [p.begin for p in proto]
        assert not proto or edges[at[k + 1] + k] == proto[-1].end


def test_pieces_and_offsets_are_the_library_s(library):
    same_as_library(pieces.piece_model(MODEL), library, odd_texts(1, LETTERS))


def _number(tag: int, value: int) -> bytes:
    return bytes([tag << 3, value])


def _message(tag: int, data: bytes) -> bytes:
    size, out = len(data), b""
    while size > 127:
        out, size = out + bytes([size & 127 | 128]), size >> 7
    return bytes([tag << 3 | 2]) + out + bytes([size]) + data


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize(("dummy", "trim"), [(True, True), (True, False), (False, True)])
def test_character_maps_of_other_models(tmp_path, rule, dummy, trim):
    normalizer = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()
    charsmap = next(v for n, part in pieces._fields(normalizer) if n == 3 for m, v in pieces._fields(part) if m == 2)
    with open(MODEL, "rb") as file:
        data = file.read()
    # of a field that comes twice the last value counts
    data += _message(3, _message(2, charsmap) + _number(3, dummy) + _number(4, trim))
    path = str(tmp_path / "other.model")
    with open(path, "wb") as file:
        file.write(data)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    same_as_library(pieces.PieceModel(path), library, odd_texts(2, LETTERS + "ﷺ½™ﾊﾞｶﾞé한글한İǅ ​¨̈"))


def test_any_ids_decode_as_in_the_library(library):
    model, rng = pieces.piece_model(MODEL), random.Random(3)
    pick = lambda: rng.choice([rng.randrange(model.size), rng.randrange(3, 259), rng.randrange(3, 259), 0, 1, 2, model.number["▁"], model.number["▁▁"]])
    lists = [[pick() for _ in range(rng.randint(0, 12))] for _ in range(800)]
    got = pieces.Surfaces(model).texts(np.array([x for y in lists for x in y], np.int32), np.array(list(map(len, lists))))
    assert got == [library.decode(x) for x in lists]


def test_windows_and_heap_change_nothing(library):
    model = pieces.piece_model(MODEL)
    rng = random.Random(4)
    for text in [prose(rng, 60), " ".join(odd_texts(5, LETTERS, 10)), "  ".join(["a b", "▁ c", " d"] * 5)]:
        ids, n, edges = pieces.encode_long(text, model, 7)
        whole = pieces.encode_texts([text], model)
        assert ids.tolist() == library.encode(text) == whole[0].tolist() and edges.tolist() == whole[2].tolist() and n[0] == len(ids)
    for text in ["the" * 500, "".join(rng.choice("abcde") for _ in range(3_000))]:
        assert pieces.encode_texts([text], model)[0].tolist() == library.encode(text)


def test_pieces_of_a_table(docs, rows, nothing, library):
    found = pieces.decode_pieces(pieces.encode_pieces(docs, MODEL), MODEL)
    got = Counter((r.doc_id, tuple(r.ids), r.text, r.edges[0] if r.ids else 0, r.edges[-1]) for r in found.collect())
    want = Counter()
    for r in rows:
        ids = library.encode(r[1] or "")
        want[(r[0], tuple(ids), library.decode(ids), 0, len((r[1] or "").encode()))] += 1
    assert got == want
    assert pieces.decode_pieces(pieces.encode_pieces(nothing, MODEL), MODEL).count() == 0


def test_decoding_null_and_no_ids(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, [], "y")], "doc_id long, ids array<int>, text string")
    assert {r.doc_id: r.text for r in pieces.decode_pieces(df, MODEL).collect()} == {1: None, 2: ""}
