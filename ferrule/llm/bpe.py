"""Byte-level BPE by a global shuffle of distinct words.

Texts are split into pre-tokens, and each block of documents keeps a
dictionary of its distinct pre-tokens with, per document, their numbers in
order: the exploded (pre-token, position) relation in dictionary coding. Only
dictionary entries are shuffled, by word: a block's words are dealt to parts by
hash, and those of one part move as one pressed list. Each distinct word of a
part is encoded once; the ids go back to the blocks in the order of the list, and
the documents are put together by position. A word that is in every document
costs one entry a block.

Decoding joins ids with the table of token bytes.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm._common import stage_buckets, tidied, tidy

#: White space as the tokenizer's regular expressions define it, without \x1c-\x1f.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A block's dictionary is closed at this many distinct words; so many encoded words a task remembers.
MOST_WORDS, MOST_KNOWN = 450_000, 300_000
#: Parts for each partition of the shuffle, so that hashing evens out.
PARTS = 2
#: A byte that UTF-8 doesn't have stands between the words of a list.
BETWEEN = b"\xff"


@lru_cache(maxsize=2)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=2)
def _token_bytes(path: str) -> dict[int, bytes]:
    return {i: b for b, i in _ranks(path).items()}


@lru_cache(maxsize=2)
def _whole_piece_encoder(path: str) -> Callable[[str], list[int]]:
    import tiktoken

    ranks = _ranks(path)
    return tiktoken.Encoding("piece", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@lru_cache(maxsize=2)
def _splitter(pattern: str):
    import regex

    return regex.compile(pattern.replace("[^\\s", f"[^{SPACE}").replace("\\S", f"[^{SPACE}]").replace("\\s", f"[{SPACE}]"))


def pre_tokens(text: str, pattern: str) -> list[str]:
    """The matches of ``pattern`` in ``text``, in order."""
    return _splitter(pattern).findall(text)


def _code_blocks(pattern: str, parts: int):
    """Rows (block, id, codes) of texts and (block, part, words, numbers) of the lists of the block's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        find, press = _splitter(pattern).findall, zstandard.ZstdCompressor(level=6).compress
        task = TaskContext.get().partitionId()
        serial = 0

        class Numbers(dict):
            def __missing__(self, word):
                self[word] = n = len(self)
                return n

        words, rows, size = Numbers(), [], 0

        def close():
            nonlocal serial, words, rows, size
            block = (task << 24) + serial
            serial += 1
            listed = [w.encode() for w in words]
            part = np.fromiter((crc32(w) % parts for w in listed), np.int64, len(listed))
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[order], prepend=-1, append=-1))
            lists = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                at = order[a:b]
                lists.append((int(part[at[0]]), press(BETWEEN.join([listed[i] for i in at])), press(_pack(np.diff(at, prepend=0).astype(np.uint32)))))
            n, k = len(rows), len(lists)
            some = list(zip(*lists, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array([block] * (n + k), pa.int64()), pa.array([r[0] for r in rows] + [None] * k, pa.int64()), pa.array([r[1] for r in rows] + [None] * k, pa.binary()),
                 *(pa.array([None] * n + list(c), t) for c, t in zip(some, (pa.int32(), pa.binary(), pa.binary()), strict=True))],
                names=["block", "id", "codes", "part", "words", "numbers"],
            )
            words, rows, size = Numbers(), [], 0

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes = np.fromiter(map(words.__getitem__, find(text or "")), np.uint32)
                rows.append((key, _pack(codes)))
                size += len(rows[-1][1])
                if len(words) >= MOST_WORDS or size >= 24_000_000:
                    yield from close()
        if rows:
            yield from close()

    return run


def _pack(codes: np.ndarray) -> bytes:
    """Little-endian base-128 numbers; words seen early in a block have small numbers."""
    if not len(codes):
        return b""
    width = 1 + (codes >= 1 << 7) + (codes >= 1 << 14) + (codes >= 1 << 21) + (codes >= 1 << 28)
    at = np.cumsum(width) - width
    out = np.zeros(int(width.sum()), np.uint8)
    for j in range(int(width.max())):
        has = width > j
        byte = (codes[has] >> np.uint32(7 * j)) & np.uint32(127)
        out[at[has] + j] = byte | ((width[has] > j + 1).astype(np.uint32) << np.uint32(7))
    return out.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.int64)
    last = np.flatnonzero(b < 128)
    first = np.concatenate(([0], last[:-1] + 1))
    place = np.arange(len(b)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((b & 127).astype(np.int64) << (7 * place), first)


def _encode_words(path: str):
    """Rows (part, block, words): each distinct word is encoded once, and a list's ids are answered in its order, as counts and planes of bytes, pressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, press, open_ = _whole_piece_encoder(path), zstandard.ZstdCompressor(level=6).compress, zstandard.ZstdDecompressor().decompress

        class Known(dict):
            def __missing__(self, word):
                self[word] = ids = array("I", encode(word.decode())).tobytes()
                return ids

        known = Known()
        for batch in batches:
            counts, ids = [], []
            for words in batch.column(2).to_pylist():
                found = [known[w] for w in open_(words).split(BETWEEN)]
                counts.append(press(_pack(np.fromiter(map(len, found), np.uint32, len(found)) // 4)))
                ids.append(press(np.ascontiguousarray(np.frombuffer(b"".join(found), np.uint8).reshape(-1, 4).T).tobytes()))
                if len(known) > MOST_KNOWN:
                    known.clear()
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), pa.array(counts, pa.binary()), pa.array(ids, pa.binary())], names=["block", "part", "counts", "ids"])

    return run


def _joined(docs: DataFrame, vocabulary: str, pattern: str, id_column: str, text_column: str, finish: Callable[[Block, np.ndarray], tuple], fields: list) -> DataFrame:
    parts = PARTS * max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    coded = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    coded = stage_buckets(
        coded.mapInArrow(tidied(_code_blocks(pattern, parts)), "block long, id long, codes binary, part int, words binary, numbers binary"), "bpe-blocks", "block"
    )
    found = coded.where("part is not null").select("part", "block", "words").repartition("part").mapInArrow(tidied(_encode_words(vocabulary)), "block long, part int, counts binary, ids binary")
    texts = coded.select("block", "id", "codes", "part", "numbers")
    schema = ", ".join(f"{name} {kind}" for name, _, kind in fields)
    return texts.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_assemble(vocabulary, finish, fields), schema)


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_tokens, ids) of every row of ``docs``.

    ``vocabulary`` is the path of a rank file (base64 token and rank a line),
    ``pattern`` splits the text. Null and empty texts have no tokens; rows that
    repeat an id, and null ids, are encoded each; other columns are ignored. A
    long text is encoded whole, an empty table gives an empty one.
    """
    fields = [(id_column, pa.int64(), "long"), ("n_tokens", pa.int64(), "long"), ("ids", pa.list_(pa.int32()), "array<int>")]
    return _joined(docs, vocabulary, pattern, id_column, text_column, Block.encoded, fields)


def token_digests(docs: DataFrame, vocabulary: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): digests of the ids and of the text decoded from them."""
    fields = [(id_column, pa.int64(), "long"), ("n_tokens", pa.int64(), "long"), ("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string")]
    return _joined(docs, vocabulary, pattern, id_column, text_column, Block.digest, fields)


def decode(encoded: DataFrame, vocabulary: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """(id, decoded): the bytes of each row's ids, joined with the token table in the worker.

    The table has one row a token, so its size is that of the vocabulary. Null
    ids give null; an id outside the vocabulary is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _token_bytes(vocabulary)
        for batch in batches:
            out = [None if ids is None else b"".join([table[i] for i in ids]) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[id_column, "decoded"])

    rows = encoded.select(F.col(id_column).cast("long").alias(id_column), F.col(ids_column).alias("ids"))
    return rows.mapInArrow(run, f"{id_column} long, decoded binary")


class Block:
    """A block's dictionary: the ids of each word number as stretches of one array, and their texts and bytes."""

    def __init__(self, starts: np.ndarray, counts: np.ndarray, ids: np.ndarray, table: dict[int, bytes]):
        self.starts, self.counts, self.ids, self.table = starts, counts, ids, table
        self.said: list[str] = []
        self.spelled: list[bytes] = []

    def encoded(self, numbers: np.ndarray) -> tuple:
        n = self.counts[numbers]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.starts[numbers], n)
        return len(at), self.ids[at].astype(np.int32)

    def digest(self, numbers: np.ndarray) -> tuple:
        """Each number's ids are joined with the token table once a block; the pieces follow in order."""
        if not self.said:
            flat, names, table = self.ids.tolist(), _names(len(self.table)), self.table
            for a, n in zip(self.starts.tolist(), self.counts.tolist(), strict=True):
                ids = flat[a : a + n]
                self.said.append(names[ids[0]] if n == 1 else " ".join([names[i] for i in ids]))
                self.spelled.append(table[ids[0]] if n == 1 else b"".join([table[i] for i in ids]))
        ids_digest, text_digest = hashlib.sha256(), hashlib.sha256()
        for a in range(0, len(numbers), 100_000):
            piece = numbers[a : a + 100_000].tolist()
            ids_digest.update(((" " if a else "") + " ".join([self.said[n] for n in piece])).encode())
            text_digest.update(b"".join([self.spelled[n] for n in piece]))
        return int(self.counts[numbers].sum()), ids_digest.hexdigest(), text_digest.hexdigest()


class _Names(dict):
    def __missing__(self, i: int) -> str:
        self[i] = name = str(i)
        return name


@lru_cache(maxsize=2)
def _names(size: int) -> dict[int, str]:
    return _Names()


def _assemble(path: str, finish: Callable[[Block, np.ndarray], tuple], fields: list):
    schema = pa.schema([(name, kind) for name, kind, _ in fields])

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        open_ = zstandard.ZstdDecompressor().decompress
        numbers = {part: np.cumsum(_unpack(open_(x))) for part, x in zip(texts.column("part").to_pylist(), texts.column("numbers").to_pylist(), strict=True) if part is not None}
        size = sum(map(len, numbers.values()))
        starts, counts, ids, at = np.zeros(size, np.int64), np.zeros(size, np.int64), [], 0
        for part, n, planes in zip(*(found.column(c).to_pylist() for c in ("part", "counts", "ids")), strict=True):
            n = _unpack(open_(n))
            counts[numbers[part]], starts[numbers[part]] = n, at + np.cumsum(n) - n
            ids.append(np.ascontiguousarray(np.frombuffer(open_(planes), np.uint8).reshape(4, -1).T).view(np.uint32).ravel())
            at += len(ids[-1])
        block = Block(starts, counts, np.concatenate(ids) if ids else np.zeros(0, np.uint32), _token_bytes(path))
        out = [(key, *finish(block, _unpack(codes))) for key, codes in zip(texts.column("id").to_pylist(), texts.column("codes").to_pylist(), strict=True) if codes is not None]
        del block, ids, starts, counts, numbers
        tidy()
        columns = zip(*out, strict=True) if out else [[]] * len(schema)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run
