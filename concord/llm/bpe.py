"""Byte-level BPE encoding and decoding.

Pieces come from array scans (scan.py), their ids from a bounded cache over pair
merging. Encoded rows keep where pieces end among their ids; by these offsets any run of
pieces is decoded by itself, and all of them give the text back.

Null texts are empty texts; empty texts have no ids; rows repeat as they came;
columns besides doc_id and text are ignored. An empty table gives an empty result. A text is taken whole: one longer
than SEGMENT code points is cut where a piece starts, which changes no piece.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache, partial
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scan
from .common import bounded_batches, text_or_empty

SEGMENT = 1 << 20
CACHED, CACHED_LENGTH = 400_000, 40
VOCABULARY = "byte_bpe_50k.tiktoken"


class MergeCache(dict):
    """What short keys are made into. It starts anew when full, so memory is bounded."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key: str | bytes) -> bytes:
        value = self.make(key)
        if len(key) <= CACHED_LENGTH:
            if len(self) >= CACHED:
                self.clear()
            self[key] = value
        return value


def as_bytes(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return pack(f"<{len(ids)}I", *ids)


class ByteBPE:
    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        core = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.known = MergeCache(lambda piece: as_bytes(core.encode_single_piece(piece.encode())))
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            self.bytes_of[i] = piece

    def pieces(self, texts: list[str]) -> list[list[bytes]]:
        """The ids of each piece of each text."""
        points, starts, ends = scan.located(scan.byte_level(), texts)
        found = list(map(self.known.__getitem__, scan.cut(points, starts)))
        out, a = [], 0
        for b in ends.tolist():
            out.append(found[a:b])
            a = b + 1
        return out

    def _long(self, text: str) -> list[bytes]:
        """A text in segments. Each ends before the last piece whose start no missing character can change; the next begins there."""
        out, at, size = [], 0, SEGMENT
        while at < len(text):
            part = text[at : at + size]
            _, starts, _ = scan.located(scan.byte_level(), [part])
            starts = starts[:-1]
            if at + size >= len(text):
                cut = len(part)
            else:
                starts = starts[: np.searchsorted(starts, len(part) - 3)]
                cut = int(starts[-1])
                if cut == 0:
                    size *= 2
                    continue
                starts = starts[:-1]
            places = starts.tolist()
            out += map(self.known.__getitem__, [part[a:b] for a, b in zip(places, [*places[1:], cut], strict=True)])
            at, size = at + cut, SEGMENT
        return out

    def in_pieces(self, texts: list[str]) -> Iterator[list[bytes]]:
        """The ids of each piece of each text, as little-endian unsigned 32-bit integers."""
        for run in scan.groups(texts, SEGMENT):
            if len(run) == 1 and len(run[0]) > SEGMENT:
                yield self._long(run[0])
            else:
                yield from self.pieces(run)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        return map(b"".join, self.in_pieces(texts))

    def offsets(self, text: str) -> list[tuple[int, int, int]]:
        """Per piece: where it starts and ends in the text (code points), and its number of ids."""
        _, starts, _ = scan.located(scan.byte_level(), [text])
        return [(a, b, len(ids) // 4) for a, b, ids in zip(starts[:-1].tolist(), starts[1:].tolist(), self.pieces([text])[0], strict=True)]

    def decode(self, ids: bytes, ends: Sequence[int] | None = None, first: int = 0, last: int | None = None) -> bytes:
        """The bytes that ids stand for. With the number of ids up to the end of each piece, those of pieces first to last (from 0, last not included) only."""
        if ends is not None:
            stops = [0, *ends]
            last = len(ends) if last is None else min(last, len(ends))
            ids = ids[4 * stops[min(first, last)] : 4 * stops[last]]
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(2)
def encoder(path: str) -> ByteBPE:
    return ByteBPE(path)


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _digests(batches, path):
    bpe = encoder(path)
    for batch in batches:
        n, ids_sha, text_sha = [], [], []
        for pieces in bpe.in_pieces(batch["text"].to_pylist()):
            ids = b"".join(pieces)
            n.append(len(ids) // 4)
            ids_sha.append(hashlib.sha256(ids).hexdigest())
            text_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate([*parts, np.zeros(0, np.int32)]), pa.int32()))


def _ids(batches, path, digests):
    bpe = encoder(path)
    for batch in batches:
        for first, run in _runs(batch["text"]):
            ids, ends, ids_sha, text_sha = [], [], [], []
            for pieces in bpe.in_pieces(run):
                raw = b"".join(pieces)
                ids.append(np.frombuffer(raw, "<i4"))
                ends.append(np.cumsum(np.fromiter(map(len, pieces), np.int32, len(pieces)) // 4, dtype=np.int32))
                if digests:
                    ids_sha.append(hashlib.sha256(raw).hexdigest())
                    text_sha.append(hashlib.sha256(bpe.decode(raw)).hexdigest())
            columns = {c: batch[c].slice(first, len(run)) for c in batch.schema.names if c != "text"} | {"ids": _lists(ids), "piece_ends": _lists(ends)}
            if digests:
                columns |= {"n_tokens": pa.array([len(x) for x in ids], pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _runs(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Texts in runs of about a million code points, and the place of each run's first: what goes back to the JVM at once is bounded, too."""
    at = 0
    for run in scan.groups(texts.to_pylist(), SEGMENT):
        yield at, run
        at += len(run)


def _texts(batches, path, first, last):
    bpe = encoder(path)
    for batch in batches:
        rows = zip(batch["ids"].to_pylist(), batch["piece_ends"].to_pylist(), strict=True)
        texts = [bpe.decode(np.array(x or [], "<u4").tobytes(), ends, first, last).decode("utf-8", "replace") for x, ends in rows]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: one pass, no shuffle; the ids are decoded where they were made."""
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(partial(_digests, path=path or vocabulary()), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str | None = None, keep: tuple[str, ...] = (), digests: bool = False) -> DataFrame:
    """doc_id, the columns in keep, ids (array of int) and piece_ends (number of ids up to the end of each piece); with digests also n_tokens, ids_sha256 and decoded_sha256."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, text_or_empty().alias("text"))
    kinds = ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes if c != "text")
    more = ", n_tokens long, ids_sha256 string, decoded_sha256 string" * digests
    return rows.mapInArrow(partial(_ids, path=path or vocabulary(), digests=digests), f"{kinds}, ids array<int>, piece_ends array<int>{more}")


def decode(encoded: DataFrame, path: str | None = None, first: int = 0, last: int | None = None) -> DataFrame:
    """doc_id and text from doc_id, ids and piece_ends. first, last: of the pieces (from 0, last not included), of which a text may have fewer; whole texts need no piece_ends."""
    bounded_batches(encoded.sparkSession)
    ends = F.lit(None).cast("array<int>") if (first, last) == (0, None) else F.col("piece_ends")
    rows = encoded.select("doc_id", "ids", ends.alias("piece_ends"))
    return rows.mapInArrow(partial(_texts, path=path or vocabulary(), first=first, last=last), "doc_id long, text string")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("doc_id", F.col("doc_id").cast("long")))
