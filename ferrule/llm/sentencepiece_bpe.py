"""Piece encoding by vectorised merge rounds over flat arrays.

A text is escaped and cut into segments, runs of spaces with the word behind
them; a task encodes each distinct segment once, all new ones of a batch
together. They lie end to end in one array of symbols, cut further wherever two
neighbouring characters stand together in no piece, since no merge can cross
such a place. Every round takes the least pair rank of each word
(``minimum.reduceat``), merges all its occurrences from the left at once,
closes the gaps, and looks up only the pairs that are new. Words without a pair
leave the arrays; rounds end when none is left.

Merging at once gives what one merge after the other gives, as long as a merged
piece can't at once be part of another merge of the same or a better rank. Pieces
that can (``Vocabulary.eager``) are merged singly: only the leftmost of a
word in a round. A word that is not done after MOST_ROUNDS rounds (such as a very
long run of spaces, whose pieces all have one rank) goes on from where it is with a
heap of its pairs, in the same order of merges.

Decoding joins the ids with the table of piece bytes.

The model file is read as plain fields: a BPE model with byte fallback, the
identity normaliser and neither user-defined nor unused pieces; others are an error.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm._common import tidied

SPACE = "▁"
#: Rounds before a word's remaining merges are made by a heap.
MOST_ROUNDS = 96
#: Encoded segments that a task remembers: so many, and so many bytes of them.
MOST_KNOWN, MOST_KNOWN_BYTES = 300_000, 64 << 20
#: Code points that are encoded together; a longer segment stands alone.
MOST_TOGETHER = 1 << 19
NONE = np.int64(np.iinfo(np.int64).max)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a message in the protocol buffer wire format."""

    def number(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[i]
            i, value, shift = i + 1, value | (b & 127) << shift, shift + 7
            if b < 128:
                return value, i

    i = 0
    while i < len(data):
        tag, i = number(i)
        if tag & 7 == 0:
            value, i = number(i)
        else:
            n, i = {1: (8, i), 5: (4, i)}[tag & 7] if tag & 7 != 2 else number(i)
            value, i = data[i : i + n], i + n
        yield tag >> 3, value


class Vocabulary:
    """Pieces of a model, and of every pair of symbols that makes a piece its rank and what it makes.

    Symbols are piece ids; from ``size`` on characters of pieces that are no
    pieces themselves; below zero (-1 - code point) any other character.
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            model = list(_fields(f.read()))
        trainer, normaliser = ({k: v for name, m in model if name == part for k, v in _fields(m)} for part in (2, 3))
        pieces = [dict(_fields(m)) for name, m in model if name == 1]
        kinds = [p.get(3, 1) for p in pieces]
        if trainer.get(3) != 2 or not trainer.get(35) or trainer.get(24) or normaliser.get(2) or not normaliser.get(3, 1) or normaliser.get(4, 1) or not normaliser.get(5, 1) or set(kinds) & {4, 5}:
            raise ValueError(f"{path}: only BPE models with byte fallback, an escaped dummy prefix, no normalisation and no user-defined or unused pieces")
        self.size = len(pieces)
        texts = [p[1].decode() for p in pieces]
        self.control = {k for k, kind in enumerate(kinds) if kind == 3}
        self.unknown = {k for k, kind in enumerate(kinds) if kind == 2}
        self.byte = {k: int(texts[k][1:-1], 16) for k, kind in enumerate(kinds) if kind == 6}
        self.byte_ids = np.zeros(256, np.uint32)
        for k, b in self.byte.items():
            self.byte_ids[b] = k
        self.begin, self.end = texts.index("<s>"), texts.index("</s>")
        self.texts, self.bytes = texts, [t.replace(SPACE, " ").encode() for t in texts]
        spelled = [b"" if k in self.control else bytes([self.byte[k]]) if k in self.byte else b for k, b in enumerate(self.bytes)]
        self.piece_width = np.array([len(b) for b in spelled])
        self.piece_begin, self.piece_bytes = np.cumsum(self.piece_width) - self.piece_width, np.frombuffer(b"".join(spelled), np.uint8)
        normal = {texts[k]: k for k, kind in enumerate(kinds) if kind == 1}
        extra = sorted({c for t in normal for c in t} - set(normal))
        symbols = normal | {c: self.size + k for k, c in enumerate(extra)}
        self.spelled = {self.size + k: self.byte_ids[list(c.encode())] for k, c in enumerate(extra)}

        singles = sorted(c for c in symbols if len(c) == 1)
        self.classes = np.zeros(0x110000, np.int32)
        self.classes[[ord(c) for c in singles]] = np.arange(1, len(singles) + 1)
        self.class_symbols = np.array([-1] + [symbols[c] for c in singles], np.int64)
        self.near = np.zeros((len(singles) + 1,) * 2, bool)
        for t in normal:
            at = self.classes[[ord(c) for c in t]]
            self.near[at[:-1], at[1:]] = True

        scores = np.array([struct.unpack("<f", p.get(2, b"\0\0\0\0"))[0] for p in pieces], np.float32)
        rank_of = np.unique(-scores, return_inverse=True)[1]
        rows = [(symbols[t[:k]] << 32 | symbols[t[k:]], int(rank_of[i]), i) for t, i in normal.items() for k in range(1, len(t)) if t[:k] in symbols and t[k:] in symbols]
        rows.sort()
        self.keys, self.ranks, self.made = (np.array(x, np.int64) for x in zip(*rows, strict=True))
        best = np.full(self.size + len(extra), NONE)
        np.minimum.at(best, self.keys >> 32, self.ranks)
        np.minimum.at(best, self.keys & 0xFFFFFFFF, self.ranks)
        self.eager = best[: self.size] <= rank_of

    def start(self, points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol of each character, and whether a word begins there: at ``ends``, and where no piece has it behind the one before."""
        kind = self.classes[points]
        cut = np.ones(len(points), bool)
        cut[1:] = ~self.near[kind[:-1], kind[1:]]
        cut[ends[:-1]] = True
        return np.where(kind > 0, self.class_symbols[kind], -1 - points.astype(np.int64)), cut

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and outcome of each pair; the rank is NONE where there is none."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        there = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(there, self.ranks[at], NONE), self.made[at]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _merged(v: Vocabulary, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols after all merges within words, and the place where each began; ``word`` rises."""
    place = np.arange(len(sym))
    done: list[tuple[np.ndarray, np.ndarray]] = []
    rank, made = np.full(len(sym), NONE), np.zeros(len(sym), np.int64)
    inner = np.flatnonzero(word[1:] == word[:-1])
    rank[inner], made[inner] = v.pairs(sym[inner], sym[inner + 1])
    rounds = 0
    while len(sym):
        first = np.flatnonzero(np.diff(word, prepend=-1))
        length = np.diff(first, append=len(sym))
        least = np.minimum.reduceat(rank, first)
        if (over := least == NONE).any():
            gone = np.repeat(over, length)
            done.append((place[gone], sym[gone]))
            stay = ~gone
            place, sym, word, rank, made = place[stay], sym[stay], word[stay], rank[stay], made[stay]
            continue
        if (rounds := rounds + 1) > MOST_ROUNDS:
            for a, n in zip(first.tolist(), length.tolist(), strict=True):
                kept, symbols = _one_by_one(v, sym[a : a + n].tolist())
                done.append((place[a : a + n][kept], np.array(symbols, np.int64)))
            break
        hit = np.flatnonzero(rank == np.repeat(least, length))
        # Of neighbouring pairs every second one, from the left.
        run = np.flatnonzero(np.diff(hit, prepend=-2) > 1)
        nth = np.arange(len(hit)) - np.repeat(run, np.diff(run, append=len(hit)))
        hit = hit[nth % 2 == 0]
        # Up to the first piece of a word that could go on merging at once.
        eager = v.eager[made[hit]]
        if eager.any():
            before = np.cumsum(eager) - eager
            of_word = word[hit]
            begins = np.flatnonzero(np.diff(of_word, prepend=-1))
            hit = hit[before == np.repeat(before[begins], np.diff(begins, append=len(hit)))]
        sym[hit] = made[hit]
        stay = np.ones(len(sym), bool)
        stay[hit + 1] = False
        news = np.zeros(len(sym) + 1, bool)
        news[hit] = True
        news[hit[hit > 0] - 1] = True
        # The pair before a merge begins at the symbol before, which may be the start of another merge.
        news[hit[hit > 1] - 2] |= ~stay[hit[hit > 1] - 1]
        place, sym, word, rank, made, news = place[stay], sym[stay], word[stay], rank[stay], made[stay], news[:-1][stay]
        changed = np.flatnonzero(news)
        rank[changed] = NONE
        changed = changed[changed + 1 < len(sym)]
        changed = changed[word[changed] == word[changed + 1]]
        rank[changed], made[changed] = v.pairs(sym[changed], sym[changed + 1])
    if not done:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place, sym = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(place)
    return sym[order], place[order]


def _one_by_one(v: Vocabulary, sym: list[int]) -> tuple[list[int], list[int]]:
    """The places kept and their symbols after the merges of one word, the best pair first, the leftmost of equals."""
    n = len(sym)
    after, before, heap = [*range(1, n), -1], [-1, *range(n - 1)], []

    def offer(at: np.ndarray) -> None:
        left, right = np.array([sym[i] for i in at], np.int64), np.array([sym[after[i]] for i in at], np.int64)
        ranks, made = v.pairs(left, right)
        for i, r, m, a, b in zip(at, ranks.tolist(), made.tolist(), left.tolist(), right.tolist(), strict=True):
            if r != NONE:
                heapq.heappush(heap, (r, i, m, a, b))

    alive = [True] * n
    offer(list(range(n - 1)))
    while heap:
        _, i, m, a, b = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j < 0 or sym[i] != a or sym[j] != b:
            continue
        sym[i], alive[j], after[i] = m, False, after[j]
        if after[i] >= 0:
            before[after[i]] = i
        offer([k for k in (before[i], i) if k >= 0 and after[k] >= 0])
    kept = [i for i in range(n) if alive[i]]
    return kept, [sym[i] for i in kept]


def encode_segments(v: Vocabulary, segments: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The ids of blocks of escaped segments end to end, and where each segment's ids end."""
    a = 0
    while a < len(segments):
        b, n = a + 1, len(segments[a])
        while b < len(segments) and n + len(segments[b]) <= MOST_TOGETHER:
            b, n = b + 1, n + len(segments[b])
        yield _encode_together(v, segments[a:b])
        a = b


def _encode_together(v: Vocabulary, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(s) for s in segments])
    start, cut = v.start(points, ends)
    sym, place = _merged(v, start, np.cumsum(cut))
    width = np.ones(len(sym), np.int64)
    spelled = {k: _spelled(v, symbol) for k, symbol in ((k, int(sym[k])) for k in np.flatnonzero((sym < 0) | (sym >= v.size)).tolist())}
    for k, ids in spelled.items():
        width[k] = len(ids)
    out = np.repeat(sym, width).astype(np.uint32)
    at = np.cumsum(width) - width
    for k, ids in spelled.items():
        out[at[k] : at[k] + width[k]] = ids
    return out, np.append(at, len(out))[np.searchsorted(place, ends)]


def _spelled(v: Vocabulary, symbol: int) -> np.ndarray:
    if symbol not in v.spelled:
        v.spelled[symbol] = v.byte_ids[list(chr(-1 - symbol).encode())]
    return v.spelled[symbol]


_SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def escaped(text: str) -> list[str]:
    """Segments of a text with its spaces escaped and one put before it; an empty text has none."""
    return _SEGMENT.findall(SPACE + text.replace(" ", SPACE)) if text else []


class _Known:
    """Segments encoded so far, each with a number: their ids as stretches of one array."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.forget()

    def forget(self) -> None:
        class Numbers(dict):
            def __missing__(self, segment: str) -> int:
                self[segment] = n = len(self)
                return n

        self.numbers, self.ids, self.ends = Numbers(), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def encoded(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ``segments`` end to end, and how many each has."""
        if len(self.numbers) > MOST_KNOWN or self.ids.nbytes > MOST_KNOWN_BYTES:
            self.forget()
        before = len(self.numbers)
        number = np.fromiter(map(self.numbers.__getitem__, segments), np.int64, len(segments))
        if len(self.numbers) > before:
            blocks = [(self.ids, self.ends)]
            for ids, ends in encode_segments(self.v, list(islice(self.numbers, before, None))):
                blocks.append((ids, blocks[-1][1][-1] + ends))
            self.ids, self.ends = (np.concatenate(x) for x in zip(*blocks, strict=True))
        count = np.diff(self.ends)[number]
        return self.ids[_stretches(self.ends[number], count)], count


def _stretches(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of each stretch, end to end."""
    upto = np.cumsum(count)
    return np.arange(upto[-1] if len(upto) else 0) + np.repeat(begin - upto + count, count)


#: Segments of texts that are looked up together.
MOST_SEGMENTS = 400_000


def _pieces(path: str, fields: list[tuple[str, pa.DataType]], finish):
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(vocabulary(path))

        def flush(keys, segments, sizes):
            if not keys:  # a batch without rows, or whose last row has filled up the segments before
                return []
            ids, count = known.encoded(segments)
            upto = np.append(0, np.cumsum(count))[np.append(0, np.cumsum(sizes))]
            return zip(keys, *finish(known.v, ids, upto), strict=True)

        for batch in batches:
            out, keys, segments, sizes = [], [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = escaped(text.as_py() or "")
                keys.append(key)
                sizes.append(len(found))
                segments += found
                if len(segments) >= MOST_SEGMENTS:
                    out += flush(keys, segments, sizes)
                    keys, segments, sizes = [], [], []
            out += flush(keys, segments, sizes)
            columns = zip(*out, strict=True) if out else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return tidied(run)


def _rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"))


def encode(docs: DataFrame, model: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_tokens, ids) of every row of ``docs``, with begin and end ids.

    ``model`` is the path of a model file. Null and empty texts have the begin
    and end ids alone; rows that repeat an id, and null ids, are encoded each;
    equal texts give equal ids; other columns are ignored, whatever their names. A long text is
    encoded whole; an empty table gives an empty one.
    """

    def finish(v: Vocabulary, ids: np.ndarray, upto: np.ndarray) -> tuple:
        own = [np.concatenate([[v.begin], ids[a:b], [v.end]]).astype(np.int32) for a, b in pairwise(upto.tolist())]
        return map(len, own), own

    fields = [(id_column, pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))]
    return _rows(docs, id_column, text_column).mapInArrow(_pieces(model, fields, finish), f"`{id_column}` long, n_tokens long, ids array<int>")


def token_digests(docs: DataFrame, model: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): digests of the ids, as little-endian 32-bit numbers, and of the text decoded from them; rows as in ``encode``."""

    def finish(v: Vocabulary, ids: np.ndarray, upto: np.ndarray) -> tuple:
        begin, end = (struct.pack("<I", i) for i in (v.begin, v.end))
        said = v.piece_bytes[_stretches(v.piece_begin[ids], v.piece_width[ids])].tobytes()
        heard = np.append(0, np.cumsum(v.piece_width[ids]))[upto].tolist()
        spelled, upto = ids.astype("<u4").tobytes(), upto.tolist()
        digests = [hashlib.sha256(b"".join([begin, spelled[4 * a : 4 * b], end])).hexdigest() for a, b in pairwise(upto)]
        # Every text begins with the space that encoding put before it.
        texts = [hashlib.sha256(said[a + (b > a) : b]).hexdigest() for a, b in pairwise(heard)]
        return [b - a + 2 for a, b in pairwise(upto)], digests, texts

    fields = [(id_column, pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    return _rows(docs, id_column, text_column).mapInArrow(_pieces(model, fields, finish), f"`{id_column}` long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode_ids(v: Vocabulary, ids: list[int]) -> str:
    """The text of ids: control ids give nothing, unknown ones " ⁇ ", bytes that are no UTF-8 U+FFFD each, the first space goes."""
    out: list[bytes] = []
    run = bytearray()
    first = True

    def close() -> None:
        k = 0
        while k < len(run):
            n = next((n for n in (1, 2, 3, 4) if _whole(bytes(run[k : k + n]))), 0)
            out.append(bytes(run[k : k + n]) if n else "�".encode())
            k += n or 1
        run.clear()

    for i in ids:
        if not 0 <= i < v.size:
            raise ValueError(f"id {i} is outside the vocabulary")
        if i in v.byte:
            run.append(v.byte[i])
            continue
        if run:
            close()
            first = False
        if i in v.control:
            continue
        text = b" \xe2\x81\x87 " if i in v.unknown else v.bytes[i]
        if first and text.startswith(b" ") and i not in v.unknown:
            text = text[1:]
        first = False
        out.append(text)
    close()
    return b"".join(out).decode()


def _whole(data: bytes) -> bool:
    try:
        return len(data.decode()) == 1
    except UnicodeDecodeError:
        return False


def decode(encoded: DataFrame, model: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """(id, decoded): the text of each row's ids. Null ids give null, no ids an empty text; an id outside the vocabulary is an error; repeated rows and null keys are decoded each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for batch in batches:
            out = [None if ids is None else decode_ids(v, ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[id_column, "decoded"])

    rows = encoded.select(F.col(f"`{id_column}`").cast("long").alias(id_column), F.col(f"`{ids_column}`").alias("ids"))
    return rows.mapInArrow(run, f"`{id_column}` long, decoded string")
