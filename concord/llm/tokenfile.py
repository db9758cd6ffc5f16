"""Token ids in binary blocks: patched frame of reference, and their writer and reader.

A page holds whole documents' ids, at least PAGE of them unless it is a shard's last.
Within it, each BLOCK ids have their minimum subtracted and are packed at the width that holds
COVER of them; the others' full differences are exceptions with their places. The starts of the
blocks' packed bytes are the page's index. A page (little-endian):

    magic 'PFR1' | documents, ids, blocks, packed bytes, exceptions: 5 x u32
    doc_id: documents x i64 | document lengths: documents x u32
    minimum: blocks x u32 | width: blocks x u8 | start: blocks x u32 | exceptions: blocks x u16
    packed bytes | exception places: u8 each | exception differences: u32 each

A file is a Parquet table whose rows are pages: shard, page, first (ids of the shard before it), ids and data.
Shards are ranges of doc_id in ascending order, each written by one task in sorted order.

Null texts are empty ones and hold the end id alone. Rows of one doc_id stand together, by text; null ids stand first, marked NO_ID.
An empty table gives a file without pages. Only doc_id and text are read, so other columns clash with nothing.
"""

from __future__ import annotations

import struct
import unicodedata
import zlib
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scan
from .bpe import CACHED_LENGTH, vocabulary
from .common import bounded_batches, partitions, text_or_empty, written

BLOCK, PAGE, COVER, END_ID = 128, 1 << 16, 0.9, 1
VOCABULARY = "word_bpe_49k.json"
MAGIC = b"PFR1"
NO_ID = -(1 << 63)
RUN, KNOWN = 1 << 22, 250_000


def _bits(x: np.ndarray) -> np.ndarray:
    """Bits that each number needs."""
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


def _narrow(x: np.ndarray, w: int) -> np.ndarray:
    """The bytes of numbers, a multiple of eight, of w bits each. Up to 16 bits, eight of them are two words, made of halves of four."""
    if w > 16:
        bits = np.unpackbits(x.astype("<u4").view(np.uint8), bitorder="little").reshape(-1, 32)
        return np.packbits(bits[:, :w], bitorder="little")
    eight = x.reshape(-1, 8).astype("<u8")
    eight <<= np.arange(8, dtype=np.uint64) % np.uint64(4) * np.uint64(w)
    half = eight[:, 0::4] | eight[:, 1::4] | eight[:, 2::4] | eight[:, 3::4]
    words = np.empty((len(half), 2), "<u8")
    words[:, 0] = half[:, 0] | half[:, 1] << np.uint64(4 * w)
    words[:, 1] = half[:, 1] >> np.uint64(64 - 4 * w)
    return words.view(np.uint8)[:, :w].reshape(-1)


def _wide(packed: np.ndarray, w: int) -> np.ndarray:
    """The numbers again."""
    if w > 16:
        bits = np.zeros((len(packed) * 8 // w, 32), np.uint8)
        bits[:, :w] = np.unpackbits(packed, bitorder="little").reshape(-1, w)
        return np.packbits(bits, bitorder="little").view("<u4")
    room = np.zeros((len(packed) // w, 16), np.uint8)
    room[:, :w] = packed.reshape(-1, w)
    half = room.view("<u8")
    half[:, 1] = half[:, 0] >> np.uint64(4 * w) | half[:, 1] << np.uint64(64 - 4 * w)
    out = np.empty((len(half), 2, 4), np.uint32)
    for k in range(4):
        out[:, :, k] = half >> np.uint64(k * w) & np.uint64((1 << w) - 1)
    return out.reshape(-1)


def pack(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    padded = np.empty(blocks * BLOCK, np.uint32)
    padded[:n] = ids
    padded[n:] = ids[-1] if n else 0
    grid = padded.reshape(blocks, BLOCK)
    least = grid.min(axis=1) if blocks else np.zeros(0, np.uint32)
    rest = grid - least[:, None]
    width = _bits(np.sort(rest, axis=1)[:, int(np.ceil(COVER * BLOCK)) - 1]) if blocks else np.zeros(0, np.uint8)
    over = rest > ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)[:, None]
    start = np.concatenate([[0], np.cumsum(width.astype(np.int64) * (BLOCK // 8))])
    packed = np.zeros(int(start[-1]), np.uint8)
    low = np.where(over, 0, rest)
    for w in np.unique(width[width > 0]).tolist():
        at = np.flatnonzero(width == w)
        size = w * BLOCK // 8
        packed[start[at][:, None] + np.arange(size)] = _narrow(low[at], w).reshape(len(at), size)
    where = np.flatnonzero(over)
    parts = (
        doc_ids.astype("<i8"), lengths.astype("<u4"), least.astype("<u4"), width.astype("u1"), start[:-1].astype("<u4"), np.bincount(where // BLOCK, minlength=blocks).astype("<u2"),
        packed, (where % BLOCK).astype("u1"), rest.reshape(-1)[where].astype("<u4"),
    )
    return MAGIC + struct.pack("<5I", len(doc_ids), n, blocks, len(packed), len(where)) + b"".join(p.tobytes() for p in parts)


def unpack(page: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, lengths and ids of a page."""
    if page[:4] != MAGIC:
        raise ValueError("not a page")
    docs, n, blocks, size, exceptions = struct.unpack_from("<5I", page, 4)
    at = 24

    def take(kind, count):
        nonlocal at
        out = np.frombuffer(page, kind, count, at)
        at += out.nbytes
        return out

    doc_ids, lengths, least, width, start, counts = take("<i8", docs), take("<u4", docs), take("<u4", blocks), take("u1", blocks), take("<u4", blocks), take("<u2", blocks)
    packed, places, rest = take("u1", size), take("u1", exceptions), take("<u4", exceptions)
    grid = np.zeros((blocks, BLOCK), np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        own = np.flatnonzero(width == w)
        rows = packed[start[own].astype(np.int64)[:, None] + np.arange(w * BLOCK // 8)]
        grid[own] = _wide(rows.reshape(-1), w).reshape(len(own), BLOCK)
    grid[np.repeat(np.arange(blocks), counts), places] = rest
    return doc_ids, lengths, (grid + least[:, None]).reshape(-1)[:n]


def block(page: bytes, k: int) -> np.ndarray:
    """The ids of one block, reached by the index of block starts."""
    docs, n, blocks, size, exceptions = struct.unpack_from("<5I", page, 4)
    at = 24 + 12 * docs
    least, width, start = (np.frombuffer(page, kind, blocks, at + skip * blocks) for kind, skip in (("<u4", 0), ("u1", 4), ("<u4", 5)))
    counts = np.frombuffer(page, "<u2", blocks, at + 9 * blocks)
    at += 11 * blocks
    w, first = int(width[k]), int(counts[:k].sum())
    bits = np.unpackbits(np.frombuffer(page, np.uint8, w * BLOCK // 8, at + int(start[k])), bitorder="little").reshape(BLOCK, w)
    values = (bits.astype(np.uint32) << np.arange(w, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)
    places = np.frombuffer(page, np.uint8, int(counts[k]), at + size + first)
    values[places] = np.frombuffer(page, "<u4", int(counts[k]), at + size + exceptions + 4 * first)
    return (values + least[k])[: n - k * BLOCK]


class WordBPE:
    """Ids as the tokenizers library gives them: its normalisation by Python's Unicode tables, pieces by arrays, each new piece by the library's model.

    A run of texts asks once for each of its different pieces, and the library once for all that are new. Pieces are held
    in columns; when there are too many, those used least lately go, so that frequent ones stay and memory is bounded.

    A text with a code point that Python's tables don't know goes to the library whole. encode() takes markers
    such as <|endoftext|> for ordinary text; ids() reads them as the library does by itself, as the tokens they name.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.whole = Tokenizer.from_file(path)
        self.markers = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.model = self.whole.model
        self.bulk = Tokenizer(self.model)
        self.bulk.pre_tokenizer = CharDelimiterSplit("\n")
        suffix, tokens = self.model.end_of_word_suffix, self.whole.get_vocab()
        self.last = np.zeros(max(tokens.values()) + 1, bool)
        self.last[[i for token, i in tokens.items() if suffix and token.endswith(suffix)]] = True
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = iter(range(256, 512))
        self.letters = [chr(b) if b in printable else chr(next(others)) for b in range(256)]
        self.known, self.ids_of = pa.array([], pa.large_binary()), np.zeros(0, np.uint32)
        self.size, self.used, self.runs = np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    @staticmethod
    def normal(text: str) -> str | None:
        if not text.isascii():
            if scan.unknown()[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any():
                return None
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # str.lower() looks at a sigma's place, the library doesn't
        return text.lower()

    def _library(self, text: str, ordinary: bool) -> bytes:
        self.whole.encode_special_tokens = ordinary
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, texts: list[str]):
        """As encode(), but texts that hold a marker go to the library whole and hold its token."""
        marked = [any(m in t for m in self.markers) for t in texts]
        rest = self.encode(["" if m else t for t, m in zip(texts, marked, strict=True)])
        for text, m, own in zip(texts, marked, rest, strict=True):
            yield self._library(text, False) if m else own

    def encode(self, texts: list[str]):
        """The ids of each text as little-endian unsigned 32-bit integers."""
        for run in scan.groups(texts, RUN):
            normal = [self.normal(t) for t in run]
            points, starts, ends = scan.words([t or "" for t in normal])
            number, pieces = scan.distinct(points, starts)
            at = self.places(pieces)
            ids, after = joined(self.ids_of, self.size, at[number])
            self._forget()
            raw, a = ids.tobytes(), 0
            for text, own, b in zip(run, normal, (4 * after[ends]).tolist(), strict=True):
                yield self._library(text, True) if own is None else raw[a:b]
                a = b

    def places(self, pieces: pa.Array) -> np.ndarray:
        """The places of different pieces among those known, as all of them are from now on."""
        at = pc.fill_null(pc.index_in(pieces, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            added = pieces.take(pa.array(new))
            ids, size = self._made(scan.texts(added))
            at[new] = len(self.known) + np.arange(len(new))
            self.known = pa.concat_arrays([self.known, added])
            self.ids_of, self.size = np.concatenate([self.ids_of, ids]), np.concatenate([self.size, size])
            self.used = np.concatenate([self.used, np.zeros(len(new), np.int64)])
        self.runs += 1
        self.used[at] = self.runs
        return at

    def _made(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces and each one's number of them, parted behind ids that end a piece; one by one if the vocabulary doesn't mark these."""
        letters = [p if p.isascii() and p.isprintable() else "".join([self.letters[b] for b in p.encode()]) for p in pieces]
        ids = np.array(self.bulk.encode_batch_fast(["\n".join(letters)], add_special_tokens=False)[0].ids, np.uint32)
        stops = np.flatnonzero(self.last[ids]) + 1
        if len(stops) == len(pieces):
            return ids, np.diff(stops, prepend=0)
        each = [[t.id for t in self.model.tokenize(p)] for p in letters]
        return np.array([i for own in each for i in own], np.uint32), np.array([len(own) for own in each], np.int64)

    def _forget(self) -> None:
        """Long pieces always; if too many others are known, the half used least lately."""
        kept = pc.binary_length(self.known).to_numpy() <= 4 * CACHED_LENGTH
        if kept.all() and len(kept) <= KNOWN:
            return
        kept = np.flatnonzero(kept)
        if len(kept) > KNOWN:
            kept = np.sort(kept[np.argsort(self.used[kept], kind="stable")[-KNOWN // 2 :]])
        self.ids_of, _ = joined(self.ids_of, self.size, kept)
        self.known, self.size, self.used = self.known.take(pa.array(kept)), self.size[kept], self.used[kept]


def joined(ids: np.ndarray, size: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ids holds lists of these sizes: list n for each n in number, one after the other, and how many ids there are before each and in all."""
    own = size[number]
    after = np.concatenate([[0], np.cumsum(own)])
    places = np.repeat((np.cumsum(size) - size)[number] - after[:-1], own)
    places += np.arange(len(places))
    return ids[places], after


@lru_cache(2)
def encoder(path: str) -> WordBPE:
    return WordBPE(path)


PAGES = "shard int, page int, first long, ids long, data binary"


def _pages(batches, path, end_id, page):
    from pyspark import TaskContext

    words, shard, number, first = encoder(path), TaskContext.get().partitionId(), 0, 0
    doc_ids: list = []
    parts: list = []
    size = 0
    end = struct.pack("<I", end_id)

    def made():
        ids = [np.frombuffer(p, "<u4") for p in parts]
        data = pack(np.array(doc_ids, np.int64), np.array([len(x) for x in ids], np.uint32), np.concatenate(ids))
        return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "page": pa.array([number], pa.int32()), "first": pa.array([first], pa.int64()), "ids": pa.array([size], pa.int64()), "data": pa.array([data], pa.binary())})

    for batch in batches:
        for doc_id, ids in zip(batch["doc_id"].to_pylist(), words.ids(batch["text"].to_pylist()), strict=True):
            doc_ids.append(NO_ID if doc_id is None else doc_id)
            parts.append(ids + end)
            size += len(parts[-1]) // 4
            if size >= page:
                yield made()
                number, first, size, doc_ids, parts = number + 1, first + size, 0, [], []
    if parts:
        yield made()


def write(docs: DataFrame, path: str | None = None, end_id: int = END_ID, page: int = PAGE) -> DataFrame:
    """Writes the pages to the shared folder; returns the table as read from there."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    return written(rows.mapInArrow(partial(_pages, path=path or vocabulary(VOCABULARY), end_id=end_id, page=page), PAGES), "token-pages")


def _read(batches):
    for batch in batches:
        for base, first, data in zip(batch["base"].to_pylist(), batch["first"].to_pylist(), batch["data"].to_pylist(), strict=True):
            doc_ids, lengths, ids = unpack(data)
            ends = np.cumsum(lengths, dtype=np.int64)
            raw = ids.astype("<u4").tobytes()
            crc = [zlib.crc32(memoryview(raw)[4 * a : 4 * b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            names = ["doc_id", "start", "n_tokens", "ids_crc32"]
            doc = pa.array(doc_ids, mask=doc_ids == NO_ID)
            yield pa.RecordBatch.from_arrays([doc, pa.array(base + first + ends - lengths), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())], names)


def read(pages: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the pages."""
    bounded_batches(pages.sparkSession)
    # One row a shard goes to the window, and each page needs its shard's row.
    sizes = pages.groupBy("shard").agg(F.sum("ids").alias("n"))
    before = sizes.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return pages.join(F.broadcast(before), "shard").select("base", "first", "data").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(spark.read.parquet(f"{sf_dir}/documents.parquet")))
