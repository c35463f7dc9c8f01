"""Hierarchical multi-length packing.

Documents become token ids, and the ids fill sequences of several context sizes (tiers: powers of two
up to ``max_tokens``).  Each task packs the documents it reads in blocks of bounded size:

1. a document longer than the largest tier gives full sequences; what remains is routed like a
   document to the smallest tier that holds it;
2. from the longest tier on, the longest piece of a tier opens a sequence and the gap is filled by the
   best fitting pieces of this and the shorter tiers; only if none fits, a piece is cut;
3. what is left when a block ends is cut into sequences of powers of two.

So every sequence is exactly as long as a power of two and nothing is padded.  The sequences of a tier
are dealt into step groups of equal tokens, balanced by attention cost (the sum of squared lengths).

No shuffle: a task needs its own rows only, so a hot source or a long document changes nothing.  A
lost task is repeated over the same file split and gives the same sequences, because ids are made of the
partition's number and a counter.

Defined cases: null and empty texts are the end token alone, repeated rows are packed each, an empty
table gives no rows, a null doc_id stays null, extra columns are dropped.
"""

from __future__ import annotations

import bisect
import re
from array import array
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import records, slices

PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int64()), ("step_group", pa.int64())])
PIECES_DDL = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier long, step_group long"
#: Tokens that a block holds at most, but for one document more.
BLOCK_TOKENS = 1 << 21
#: Words, and parts of words, whose ids a worker remembers at most, and as many older ones.
REMEMBERED = 150_000
_PART = regex.compile(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: The same for lower-cased ASCII.
_ASCII_PART = re.compile(r"[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes with: printable Latin-1 as it is, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Ids(dict):
    """word -> its ids as little-endian 32-bit integers.  White space always ends a token of the vocabulary in use, so the ids of
    a text are those of its words, one after another.  A word of the Latin blocks is lower-cased, cut into runs of letters, digits
    and marks, and these go to the tokenizer's model; any other word, and one that holds an added token's text, goes through the whole
    tokenizer, which gives that text the added token's id.

    A run is remembered as the word that it is.  When REMEMBERED are held they become the older ones, the older ones before them go,
    and a word that is met again moves back: words in use stay through any number of words that come once."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters, self.older = self.tokenizer.model, _byte_letters(), {}
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.normalized or len(t.content.split()) != 1 for t in added):
            raise ValueError("added tokens that take or hold white space can't be found word by word")
        self.added = tuple(t.content for t in added)
        #: A character that each added token has, or none: most words are told by it.
        self.mark = min(set.intersection(*map(set, self.added)), default="") if self.added else ""

    def __missing__(self, word: str) -> bytes:
        found = self.older.pop(word, None)
        if found is None:
            found = self.made(word)
        if len(self) >= REMEMBERED:
            self.older = self.copy()
            self.clear()
        self[word] = found
        return found

    def made(self, word: str) -> bytes:
        if not word.isascii() and (max(word) >= "\u0250" or "\u0130" in word) or "'" in word or self.mark in word and any(map(word.__contains__, self.added)):
            return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        low = word.lower()
        if not low.isalpha():
            parts = (_ASCII_PART if low.isascii() else _PART).findall(low)
            if parts != [word]:
                return b"".join(map(self.__getitem__, parts))
        elif low != word:
            return self[low]
        return array("I", [t.id for t in self.model.tokenize(low.encode().decode("latin-1").translate(self.letters))]).tobytes()

    def of(self, text: str | None, end: bytes) -> bytes:
        return b"".join(map(self.__getitem__, (text or "").replace("\n", " ").split(" "))) + end


@cache
def ids_of(path: str) -> Ids:
    """One for all tasks of a worker."""
    return Ids(path)


class Piece:
    __slots__ = ("doc", "ids", "start", "total")

    def __init__(self, doc: int | None, ids: bytes, start: int, total: int) -> None:
        self.doc, self.ids, self.start, self.total = doc, ids, start, total

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.ids[: 4 * n], self.start, self.total), Piece(self.doc, self.ids[4 * n :], self.start + n, self.total)


def pack_block(pieces: list[Piece], tiers: list[int]) -> list[tuple[int, list[Piece]]]:
    """Sequences (size, pieces) that together hold all ids of ``pieces``; each is full."""
    top, out, rest = tiers[-1], [], []
    for p in pieces:
        while len(p) >= top:
            head, p = p.cut(top)
            out.append((top, [head]))
        if len(p):
            rest.append(p)
    pool = sorted(rest, key=len)
    sizes = [len(p) for p in pool]
    left = sum(sizes)

    def take(i: int, most: int) -> Piece:
        """The piece at ``i``, or its first ``most`` ids; the rest of it goes back."""
        sizes.pop(i)
        piece = pool.pop(i)
        if len(piece) > most:
            piece, tail = piece.cut(most)
            at = bisect.bisect_left(sizes, len(tail))
            sizes.insert(at, len(tail))
            pool.insert(at, tail)
        return piece

    for tier, below in zip(reversed(tiers), [*reversed(tiers[:-1]), 0], strict=True):
        # as long as a piece was routed to the tier; what doesn't fit whole is only cut if nothing does
        while left >= tier and sizes and sizes[-1] > below:
            sequence, gap = [], tier
            while gap:
                sequence.append(take(max(0, bisect.bisect_right(sizes, gap) - 1), gap))
                gap -= len(sequence[-1])
            left -= tier
            out.append((tier, sequence))
    size = top
    while left:  # less than the smallest tier, or than the tier of a last long piece: powers of two
        while size > left:
            size //= 2
        sequence, gap = [], size
        while gap:
            sequence.append(take(len(pool) - 1, gap))
            gap -= len(sequence[-1])
        left -= size
        out.append((size, sequence))
    return out


def step_groups(sequences: list[tuple[int, list[Piece]]], step_tokens: int) -> list[int]:
    """For each sequence its group: within a size, as many sequences each as fill a step, dealt to
    and fro in order of their attention cost."""
    by_size: dict[int, list[int]] = {}
    for k, (size, _) in enumerate(sequences):
        by_size.setdefault(size, []).append(k)
    out, base = [0] * len(sequences), 0
    for size in sorted(by_size, reverse=True):
        own = sorted(by_size[size], key=lambda k: -sum(len(p) ** 2 for p in sequences[k][1]))
        groups = -(-len(own) * size // max(size, step_tokens))
        for rank, k in enumerate(own):
            lap, at = divmod(rank, groups)
            out[k] = base + (groups - 1 - at if lap % 2 else at)
        base += groups
    return out


def packer(tokenizer: str, end: int, max_tokens: int, min_tier: int, step_tokens: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    tiers = [max_tokens >> k for k in range(max_tokens.bit_length()) if max_tokens >> k >= min_tier][::-1]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, last, base, n, group = ids_of(tokenizer), end.to_bytes(4, "little"), TaskContext.get().partitionId() << 36, 0, 0
        block: list[Piece] = []

        def flush() -> pa.RecordBatch:
            nonlocal n, group
            sequences, out = pack_block(block, tiers), [[] for _ in PIECES]
            groups = step_groups(sequences, step_tokens)
            for (size, pieces), g in zip(sequences, groups, strict=True):
                offset = 0
                for p in pieces:
                    for column, value in zip(out, (p.doc, p.start, len(p), p.ids, p.total, base + n, offset, size, base + group + g), strict=True):
                        column.append(value)
                    offset += len(p)
                n += 1
            group += max(groups) + 1
            block.clear()
            return records(PIECES, out)

        held = 0
        for batch in slices(batches, "text"):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                b = ids.of(text, last)
                block.append(Piece(doc, b, 0, len(b) // 4))
                held += len(b) // 4
                if held >= BLOCK_TOKENS:
                    yield flush()
                    held = 0
        if block:
            yield flush()

    return pack


def pack(docs: DataFrame, tokenizer: str, *, end: int = 2, max_tokens: int = 4096, min_tier: int = 256, step_tokens: int = 64 * 4096) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset, tier (the sequence's length) and step_group."""
    if max_tokens & (max_tokens - 1):
        raise ValueError("max_tokens must be a power of two")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(packer(tokenizer, end, max_tokens, min_tier, step_tokens), PIECES_DDL)
