"""Encoding of the whole corpus with a public byte-level BPE vocabulary.

Documents are split into pre-tokens block by block; a block's distinct words leave it once each, with all their positions
packed as binary deltas, and meet in one shuffle by word. There every distinct word is encoded once, its ids are joined back
to the rows of all blocks that hold it, and a second shuffle by block puts the ids in order. A word as frequent as " the"
is one row a block; where its positions take more than ``WIDE`` bytes it is spread by block over ``SPREAD`` reducers (and encoded
once in each), so what one word brings to one reducer is at most ``WIDE`` bytes a block. Decoding joins the ids with the table of token bytes.

Defined results: null and empty texts give an empty list; strings that look like special tokens are ordinary text; texts of
any length are whole (a text longer than ``BLOCK_CHARS`` is a block of its own); repeated texts are encoded alike; an empty
table gives no rows; rows whose doc_id is null keep a null doc_id; only the two named columns are read.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the vocabulary files lie; a parameter of every function here.
TOKENIZERS = "/opt/tokenizers"
#: Split pattern of the vocabulary (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A block ends when its texts have so many characters together.
BLOCK_CHARS = 8_000_000

#: A word whose positions in a block take more bytes than this doesn't meet all its others: it is spread over so many reducers.
WIDE, SPREAD = 64, 4096

_PACKED = "block long, word string, at binary, salt int"


@functools.lru_cache(maxsize=4)
def vocabulary(folder: str, name: str = "byte_bpe_50k"):
    """The vocabulary as an encoder without special tokens; one per worker."""
    import tiktoken

    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _deltas(at: np.ndarray) -> bytes:
    """Sorted positions as the width of a delta (1, 2 or 4 bytes) and the deltas."""
    d = np.diff(at, prepend=0).astype(np.uint32)
    m = int(d[1:].max()) if len(d) > 1 else 0
    kind = np.uint8 if m < 1 << 8 else np.uint16 if m < 1 << 16 else np.uint32
    return d[:1].tobytes() + bytes([np.dtype(kind).itemsize]) + d[1:].astype(kind).tobytes()


def _positions(b: bytes) -> np.ndarray:
    kind = {1: np.uint8, 2: np.uint16, 4: np.uint32}[b[4]]
    return np.cumsum(np.concatenate([np.frombuffer(b, np.uint32, 1), np.frombuffer(b, kind, offset=5)]), dtype=np.int64)


def _pack(folder: str):
    """Rows of one block: each distinct word with its positions, and one row without word for the documents and their lengths."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(PATTERN).findall
        number = TaskContext.get().partitionId() << 32
        docs: list[int | None] = []
        counts: list[int] = []
        codes: dict[str, int] = {}
        flat: list[int] = []
        chars = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal docs, counts, codes, flat, chars, number
            if not docs:
                return
            at = np.array(flat, dtype=np.int64)
            order = np.argsort(at, kind="stable")
            ends = np.cumsum(np.bincount(at, minlength=len(codes))) if len(at) else np.zeros(len(codes), dtype=np.int64)
            packed = [_deltas(order[e - s : e]) for e, s in zip(ends, np.diff(ends, prepend=0), strict=True)]
            ids = np.array([-1 if x is None else x for x in docs], dtype=np.int64)
            none = np.array([x is None for x in docs], dtype=np.uint8)
            head = np.int64(len(docs)).tobytes() + ids.tobytes() + np.array(counts, dtype=np.int64).tobytes() + none.tobytes()
            own = 1 + ((number >> 32) * 2654435761 + (number & 0xFFFFFFFF)) % SPREAD
            salt = [own if len(x) > WIDE else 0 for x in (head, *packed)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([number] * (len(codes) + 1), pa.int64()), pa.array([None, *codes], pa.string()), pa.array([head, *packed], pa.binary()), pa.array(salt, pa.int32())],
                ["block", "word", "at", "salt"],
            )
            docs, counts, codes, flat, chars, number = [], [], {}, [], 0, number + 1

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = find(text) if text else []
                docs.append(doc)
                counts.append(len(words))
                flat.extend([codes.setdefault(w, len(codes)) for w in words])
                chars += len(text or "")
                if chars >= BLOCK_CHARS:
                    yield from flush()
        yield from flush()

    return pack


def _encode(folder: str):
    """The ids of each row's word. Rows come sorted by word: a word is encoded once, however many rows hold it."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = vocabulary(folder).encode_ordinary
        last, ids = None, b""
        for b in batches:
            out = []
            for w in b.column(1).to_pylist():
                if w is None:
                    out.append(None)
                    continue
                if w != last:
                    last, ids = w, np.array(one(w), dtype=np.int32).tobytes()
                out.append(ids)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary()), b.column(2)], ["block", "ids", "at"])

    return encode


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of each block, their ids in order. Rows come sorted by block; only one block is held at a time."""
    held: list[tuple[bytes | None, bytes]] = []
    block = None

    def build() -> pa.RecordBatch:
        head = next(a for i, a in held if i is None)
        n = int(np.frombuffer(head, np.int64, 1)[0])
        docs, counts = np.frombuffer(head, np.int64, n, 8), np.frombuffer(head, np.int64, n, 8 + 8 * n)
        none = np.frombuffer(head, np.uint8, n, 8 + 16 * n).astype(bool)
        words = [(np.frombuffer(i, np.int32), _positions(a)) for i, a in held if i is not None]
        total = int(counts.sum())
        lengths = np.zeros(total + 1, dtype=np.int64)
        for ids, at in words:
            lengths[at + 1] = len(ids)
        start = np.cumsum(lengths)
        flat = np.empty(int(start[-1]), dtype=np.int32)
        for ids, at in words:
            s = start[at]
            for k, x in enumerate(ids):
                flat[s + k] = x
        ends = start[np.concatenate([[0], np.cumsum(counts)])]
        kind = pa.int32() if ends[-1] < 2**31 else None
        assert kind is not None, "a block's ids must fit one list column"
        lists = pa.ListArray.from_arrays(pa.array(ends, kind), pa.array(flat))
        return pa.RecordBatch.from_arrays([pa.array(docs, mask=none), lists], ["doc_id", "ids"])

    for b in batches:
        for k, i, a in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if k != block and held:
                yield build()
                held = []
            block = k
            held.append((i, a))
    if held:
        yield build()


def encode_corpus(documents: DataFrame, tokenizers: str = TOKENIZERS) -> DataFrame:
    """(doc_id long, ids array<int>): every document's ids, without special tokens."""
    packed = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pack(tokenizers), _PACKED)
    # the row of a block's documents has no word; it takes a reducer by its block instead of all meeting in one
    by_word = packed.repartition(F.coalesce("word", F.concat(F.lit("\x00"), F.col("block").cast("string"))), "salt").sortWithinPartitions("word")
    coded = by_word.mapInArrow(_encode(tokenizers), "block long, ids binary, at binary")
    return coded.repartition("block").sortWithinPartitions("block").mapInArrow(_assemble, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def token_bytes(spark: SparkSession, tokenizers: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """(id int, bytes binary): the vocabulary's fixed table, one row a token."""
    enc = vocabulary(tokenizers, name)
    return spark.createDataFrame([(i, bytearray(b)) for b, i in enc._mergeable_ranks.items()], "id int, bytes binary")


def decode_corpus(encoded: DataFrame, tokens: DataFrame) -> DataFrame:
    """(doc_id, text): the ids joined with the token bytes and put together again; an empty list gives an empty text. doc_id must be unique."""
    rows = encoded.select("doc_id", F.posexplode_outer("ids").alias("pos", "id"))
    # the token table has a fixed size: the vocabulary's
    rows = rows.join(F.broadcast(tokens), "id", "left")
    got = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.hex("bytes").alias("x")))).alias("xs"))
    joined = F.decode(F.unhex(F.array_join(F.transform("xs", lambda s: F.coalesce(s["x"], F.lit(""))), "")), "UTF-8")
    return got.select("doc_id", F.coalesce(joined, F.lit("")).alias("text"))
