import random
import sys
import zlib
from itertools import pairwise

import numpy as np
import pytest
from conftest import odd_rows
from tokenizers import Tokenizer

from concord.llm import scan, tokenfile
from concord.llm.bpe import vocabulary


def library():
    t = Tokenizer.from_file(vocabulary(tokenfile.VOCABULARY))
    t.encode_special_tokens = True
    return t


ALPHABET = ["a", "S", "t", "Re", "ve", "'", "'", "ll", "d", "m", " ", "  ", "\n", "\t", "1", "9", ".", "É", "é", "　", "中", "́", "\0", "İ", "ΑΣ", "😀", "\x85", "\x1c", "ß", "<|endoftext|>", "Ᲊ", "ﬁ", "Ǆ"]


def test_ids_equal_the_library():
    rng = random.Random(3)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 30))) for _ in range(4000)] + ["", " ", "'S", "x" * 500]
    theirs = library()
    for text, ids in zip(texts, tokenfile.encoder(vocabulary(tokenfile.VOCABULARY)).encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
def test_pages(n):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 400, n).astype(np.uint32)
    ids[rng.random(n) < 0.05] = 2**32 - 1
    ids[100:300] = 7
    lengths = np.array([n // 3, 0, n - n // 3], np.uint32)
    doc_ids = np.array([-5, 0, 1 << 60])
    page = tokenfile.pack(doc_ids, lengths, ids)
    a, b, c = tokenfile.unpack(page)
    assert a.tolist() == doc_ids.tolist() and b.tolist() == lengths.tolist() and c.tolist() == ids.tolist()
    for k in range(-(-n // tokenfile.BLOCK)):
        assert tokenfile.block(page, k).tolist() == ids[k * tokenfile.BLOCK : (k + 1) * tokenfile.BLOCK].tolist()


@pytest.mark.parametrize("page", [1, 300, 1 << 16])
def test_files(make, page):
    rows, theirs = odd_rows(), library()
    got = [tuple(r) for r in tokenfile.read(tokenfile.write(make(rows), page=page)).orderBy("start").collect()]
    expected, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*theirs.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        expected.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == expected


def test_empty_table(make):
    assert tokenfile.read(tokenfile.write(make([]))).collect() == []


def test_markers_are_the_tokens_they_name(make):
    theirs = Tokenizer.from_file(vocabulary(tokenfile.VOCABULARY))
    rng = random.Random(4)
    texts = ["".join(rng.choices([*ALPHABET, "<|startoftext|>", "<|ENDOFTEXT|>", "<|"], k=rng.randint(0, 12))) for _ in range(2000)] + ["end <|endoftext|> next"]
    for text, ids in zip(texts, tokenfile.encoder(vocabulary(tokenfile.VOCABULARY)).ids(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids, text
    rows = [(1, "end <|endoftext|> next"), (2, "word")]
    got = [tuple(r) for r in tokenfile.read(tokenfile.write(make(rows))).orderBy("start").collect()]
    ids = [np.array([*theirs.encode(t, add_special_tokens=False).ids, 1], "<u4") for _, t in rows]
    assert 49407 in ids[0]
    assert got == [(1, 0, len(ids[0]), zlib.crc32(ids[0].tobytes())), (2, len(ids[0]), len(ids[1]), zlib.crc32(ids[1].tobytes()))]


def test_words_are_those_of_the_machine():
    rng = random.Random(6)
    for _ in range(300):
        texts = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 30))).lower() for _ in range(10)] + ["", "'", "'s's'll've'rex", "a''s", "'"]
        points, starts, ends = scan.located(scan.word_level(), texts)
        kinds = scan.classes()[points[starts]]
        kept = (kinds != scan.SPACE) & (kinds != scan.BLANK)
        kept[ends] = False
        expected = [[p for p, k in zip(scan.cut(points, starts)[a:b], kept[a:b], strict=True) if k] for a, b in pairwise([0, *(ends + 1).tolist()])]
        number, pieces = scan.distinct(*scan.words(texts)[:2])
        named, stops = [scan.texts(pieces)[n] for n in number], scan.words(texts)[2].tolist()
        assert [named[a:b] for a, b in pairwise([0, *stops])] == expected
        assert scan.texts(pieces.slice(1)) == scan.texts(pieces)[1:]


def test_a_run_of_texts_asks_the_library_once():
    words, calls = tokenfile.WordBPE(vocabulary(tokenfile.VOCABULARY)), []
    texts = [" ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}qzv{chr(97 + k % 26)}" for k in range(60)) for i in range(600)]
    list(words.encode([texts[0], "é"]))  # tables are made
    sys.setprofile(lambda frame, event, f: calls.append(f.__name__) if event == "c_call" and "tokenizers" in str(type(getattr(f, "__self__", None))) else None)
    try:
        got = list(words.encode(texts))
    finally:
        sys.setprofile(None)
    assert 0 < len(calls) <= 3, len(calls)
    theirs = library()
    assert [np.frombuffer(x, "<u4").tolist() for x in got[::50]] == [theirs.encode(t, add_special_tokens=False).ids for t in texts[::50]]


@pytest.mark.parametrize("marked", [True, False])
def test_frequent_pieces_stay_known(monkeypatch, marked):
    monkeypatch.setattr(tokenfile, "KNOWN", 60)
    words, theirs = tokenfile.WordBPE(vocabulary(tokenfile.VOCABULARY)), library()
    if not marked:
        words.last[:] = False
    for i in range(30):
        text = "the same words " + " ".join(f"{'abcdefghij'[i % 10]}x{'klmnopqrst'[k]}{'uvw'[i // 10]}" for k in range(10)) + " " + "é" * (20 + i)
        assert [np.frombuffer(x, "<u4").tolist() for x in words.encode([text, ""])] == [theirs.encode(text, add_special_tokens=False).ids, []]
        known = scan.texts(words.known)
        assert {"the", "same", "words"} <= set(known) and len(known) == len(set(known)) == len(words.size) == len(words.used) <= 60
        assert max(map(len, known)) <= tokenfile.CACHED_LENGTH and words.size.sum() == len(words.ids_of)


@pytest.mark.parametrize("width", range(33))
def test_pages_of_each_width(width):
    rng = np.random.default_rng(width)
    for n in (1, 128, 700):
        ids = rng.integers(0, 1 << width, n, dtype=np.uint64).astype(np.uint32)
        ids[rng.random(n) < 0.05] = 2**32 - 1
        page = tokenfile.pack(np.arange(1), np.array([n]), ids)
        assert tokenfile.unpack(page)[2].tolist() == ids.tolist()
        assert [i for k in range(-(-n // tokenfile.BLOCK)) for i in tokenfile.block(page, k).tolist()] == ids.tolist()
