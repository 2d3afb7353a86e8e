"""Best-fit packing of tokenized documents into sequences of bounded length.

Bounded-space online best-fit: a packer keeps a fixed number of open bins in a bitset keyed by free space. A piece goes
to the open bin with the least sufficient space; if none has room and all bins are in use, the fullest closes first.
What lies in bins still open at the end is packed once more, longest piece first, with the same bitset.

Tokenizing is one narrow pass; only rows of a few numbers per piece are dealt to packers. The number of packers follows
the total of tokens, so a packer's share and memory are the same at every size, and each wastes at most about a bin.

Defined results: a null text is an empty one and gives the end token alone; repeated rows are packed each on its own;
an empty table gives no rows; null ids are kept; other columns are ignored.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, keep, worker_cache

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PACKED = f"{PIECES}, sequence_id bigint, offset bigint"
#: Words whose ids a Python worker remembers from task to task; beyond that it forgets all and starts anew.
CACHED_WORDS = 250_000
#: Marks that the tokenizer cuts from a letter or digit before them, as one run, wherever they stand.
MARKS = b"!#$%&*,.:;?|"
#: Words of ASCII and lower-case Latin-1 letters alone: normalizing leaves them as they are and nothing cuts them, so
#: they go to the tokenizer's merge model directly, in the alphabet that stands for bytes there.
LETTERS = re.compile(rb"(?:[a-z]|\xc3[\xa0-\xb6\xb8-\xbf])+").fullmatch
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
ALPHABET = {b: chr(b) for b in _SHOWN} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in _SHOWN)}


def _stem(word: bytes) -> bytes:
    """The word without marks at its end, if that ends in an ASCII or Latin-1 letter or digit; else the word."""
    stem = word.rstrip(MARKS)
    if stem and stem != word:
        last = stem[-1]
        if 48 <= last <= 57 or 97 <= last <= 122 or last >= 128 and stem[-2:-1] == b"\xc3" and last not in (0x97, 0xB7):
            return stem
    return word


class WordTokenizer:
    """Ids of whole texts, word by word: the tokenizer drops white space and never joins across it, so the ids of a
    text are those of its white-space separated words in order, and each distinct word is tokenized once per worker.
    The tokenizer lower-cases, so words that differ in the case of A-Z are one."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.key = Tokenizer.from_file(path), ("tokens", path)
        self.model = self.tokenizer.model

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        cut = [(t or "").encode().translate(LOWER).split() for t in texts]
        cache = worker_cache(self.key, CACHED_WORDS)
        missing = set().union(*cut).difference(cache)
        marked = [(w, stem, w[len(stem) :]) for w in missing if (stem := _stem(w)) is not w]
        whole = []
        for word in missing.difference(m[0] for m in marked).union(x for m in marked for x in m[1:]).difference(cache):
            if LETTERS(word):
                cache[word] = array("I", [x.id for x in self.model.tokenize(word.decode("latin-1").translate(ALPHABET))]).tobytes()
            else:
                whole.append(word)
        for k in range(0, len(whole), 20_000):
            part = whole[k : k + 20_000]
            for word, found in zip(part, self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)):
                cache[word] = array("I", found.ids).tobytes()
        for word, stem, marks in marked:
            cache[word] = cache[stem] + cache[marks]
        for text in cut:
            yield b"".join(map(cache.__getitem__, text))


def pieces(docs: DataFrame, tokenizer: str, most: int = 4096, end_id: int = 1) -> DataFrame:
    """Pieces of at most ``most`` tokens of every document's ids and end token; only longer documents are cut."""
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordTokenizer(tokenizer)
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                for doc, ids in zip(part.column(0).to_pylist(), coder.encode(part.column(1).to_pylist())):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * most)):
                        chunk = ids[at : at + 4 * most]
                        for column, value in zip(rows, (doc, piece, at // 4, len(chunk) // 4, zlib.crc32(chunk))):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(cut, PIECES)


class BestFit:
    """Open bins by free space. Bit s of ``spaces`` says that some open bin has s free tokens."""

    def __init__(self, size: int, most_open: int | None):
        self.size, self.most_open = size, most_open
        self.spaces, self.bins, self.open = 0, {}, 0

    def _take(self, space: int) -> list:
        stack = self.bins[space]
        items = stack.pop()
        if not stack:
            del self.bins[space]
            self.spaces ^= 1 << space
        self.open -= 1
        return items

    def add(self, length: int, item) -> list | None:
        """Place an item; returns the items of a bin that this closes."""
        fitting, closed = self.spaces >> length, None
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            items = self._take(space)
        else:
            if self.open == self.most_open:
                closed = self._take((self.spaces & -self.spaces).bit_length() - 1)
            space, items = self.size, []
        items.append(item)
        space -= length
        if space == 0:  # full; as items are shorter than a bin, it was open before and none has closed for it
            return items
        self.bins.setdefault(space, []).append(items)
        self.spaces |= 1 << space
        self.open += 1
        return closed

    def rest(self) -> list[list]:
        return [items for stack in self.bins.values() for items in stack]


def pack_stream(items, size: int, most_open: int):
    """Closed bins, each a list of items; an item is a tuple whose last element is its length."""
    packer = BestFit(size, most_open)
    for item in items:
        if item[-1] == size:  # a full piece is a sequence of its own
            yield [item]
        elif closed := packer.add(item[-1], item):
            yield closed
    last = BestFit(size, None)
    for item in sorted((i for b in packer.rest() for i in b), key=lambda i: -i[-1]):
        if closed := last.add(item[-1], item):
            yield closed
    yield from last.rest()


def pack(cut: DataFrame, most: int = 4096, most_open: int = 512, packer_tokens: int = 16_000_000) -> DataFrame:
    """Sequence and offset of every piece. ``cut`` must be a stored table: it is read twice."""
    total = cut.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    dealt = cut.repartition(max(1, math.ceil(total / packer_tokens))).sortWithinPartitions(F.xxhash64("doc_id", "piece"), "doc_id", "piece", "length", "ids_crc32")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number = TaskContext.get().partitionId() << 32, 0

        def items():
            for batch in batches:
                d, p, s, n, c = (batch.column(x).to_pylist() for x in ("doc_id", "piece", "start", "length", "ids_crc32"))
                yield from zip(d, p, s, c, n)

        def emit(rows: list) -> pa.RecordBatch:
            columns = list(zip(*rows))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

        rows: list = []
        for items_of_bin in pack_stream(items(), most, most_open):
            at = 0
            for d, p, s, c, n in items_of_bin:
                rows.append((d, p, s, n, c, base + number, at))
                at += n
            number += 1
            if len(rows) >= 50_000:
                yield emit(rows)
                rows = []
        if rows:
            yield emit(rows)

    return dealt.mapInArrow(run, PACKED)


def pack_documents(docs: DataFrame, tokenizer: str, most: int = 4096, most_open: int = 512, packer_tokens: int = 16_000_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    return pack(keep(pieces(docs, tokenizer, most), "pieces"), most, most_open, packer_tokens)
