import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken
from conftest import odd_rows

from concord.llm import bpe, scan


def library():
    with open(bpe.vocabulary(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


ALPHABET = ["a", "s", "t", "re", "ve", "'", "'", "ll", "d", "m", " ", "  ", "\n", "\t", "1", "9", ".", "é", "　", "中", "́", "\0", "İ", "😀", "\x85", "\x1c"]


def test_pieces_and_ids_equal_the_library():
    rng = random.Random(3)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 40))) for _ in range(8000)] + ["", " ", "\n", "'", "''s", "a" * 3000]
    ours, theirs = bpe.encoder(bpe.vocabulary()), library()
    for text, ids in zip(texts, ours.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == theirs.encode_ordinary(text), text
        assert ours.decode(ids) == text.encode()


def test_segments_change_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "SEGMENT", 23)
    rng = random.Random(4)
    ours, theirs = bpe.encoder(bpe.vocabulary()), library()
    for _ in range(800):
        text = "".join(rng.choices(ALPHABET, k=rng.randint(0, 200)))
        assert [np.frombuffer(x, "<u4").tolist() for x in ours.encode([text])] == [theirs.encode_ordinary(text)]


def test_scan_equals_stepping():
    rng = np.random.default_rng(1)
    for machine in (scan.byte_level(), scan.word_level()):
        for n in (0, 1, 63, 64, 65, 5000):
            symbols = rng.integers(0, 9, n).astype(np.uint8)
            state, expected = 0, []
            for i, x in enumerate(symbols):
                if machine.starts[state, x]:
                    expected.append(i)
                state = machine.apply[machine.element[x], state]
            assert machine.boundaries(symbols).tolist() == expected


def test_cutting_with_and_without_a_free_mark(monkeypatch):
    text = "ab" + "".join(map(chr, scan.NONCHARACTERS)) + "é中"
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    starts = np.array([0, 1, 5, len(text) - 1])
    expected = [text[:1], text[1:5], text[5:-1], text[-1:]]
    assert scan.cut(points, starts) == expected
    assert scan.cut(points[:40], np.array([0, 3])) == [text[:3], text[3:40]]
    assert "".join(scan.cut(points[:1], np.array([0]))) == "a"


def test_offsets():
    text = "It's  two\nlines 中文 12"
    found = bpe.encoder(bpe.vocabulary()).offsets(text)
    assert "".join(text[a:b] for a, b, _ in found) == text
    assert sum(n for *_, n in found) == len(library().encode_ordinary(text))


def test_digests_and_round_trip(make):
    rows, theirs = odd_rows(), library()
    docs = make(rows)
    got = sorted(map(tuple, bpe.digests(docs).collect()), key=str)
    expected = []
    for i, t in rows:
        ids = theirs.encode_ordinary(t or "")
        expected.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(expected, key=str)
    back = bpe.decode(bpe.encode(docs, keep=("lang", "n")))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(((i, t or "") for i, t in rows), key=str)


def test_rows_keep_their_offsets(make):
    rows, ours = odd_rows(), bpe.encoder(bpe.vocabulary())
    for r in bpe.encode(make(rows), digests=True).collect():
        raw = np.array(r.ids, "<u4").tobytes()
        assert (r.piece_ends[-1:] or [0]) == [len(r.ids)] == [r.n_tokens]
        text = ours.decode(raw, r.piece_ends)
        assert text == ours.decode(raw) and hashlib.sha256(text).hexdigest() == r.decoded_sha256
        # Any run of pieces is decoded by itself.
        cut = len(r.piece_ends) // 2
        assert ours.decode(raw, r.piece_ends, 0, cut) + ours.decode(raw, r.piece_ends, cut) == text
    without = bpe.encode(make(rows)).drop("piece_ends")
    assert sorted(map(tuple, bpe.decode(without).collect()), key=str) == sorted(((i, t or "") for i, t in rows), key=str)


def test_a_run_of_pieces(make):
    rows = [(1, "It's two words"), (2, "one"), (3, None)]
    encoded = bpe.encode(make(rows))
    assert sorted(map(tuple, bpe.decode(encoded, first=1, last=3).collect())) == [(1, "'s two"), (2, ""), (3, "")]


def test_empty_table(make):
    assert bpe.digests(make([])).collect() == []
