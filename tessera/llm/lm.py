"""Language-model scores from an Elias-Fano n-gram trie of order two.

Counting: word counts by the hash of the word, then bigram counts by word ids; both are combined inside each task before
they are dealt out, and bigrams are dealt by a hash of both words, so that a word or pair that a third of the corpus
holds is a row or a share like others. Nothing is pruned.

Model: interpolation (Jelinek-Mercer). P(w|h) = (1-l) c(h,w)/c(h) + l P(w), where l depends on the power of two that
c(h) lies in and maximises the leave-one-out likelihood of the training bigrams; P(w) is the word's share of the tokens,
discounted by the share of words seen once (Good-Turing), which goes to the one unknown word type. A text starts after
an end token.

Trie: the first level holds the words, as sorted hashes with counts; a word's id is its place there. The second level is
cut into shards by the hash of the pair. A shard has a monotone Elias-Fano sequence of pointers, one per word id, to its
followers, whose ids are stored relative to their context as one monotone sequence; a follower is found by successor
search within its context's range. Next to it stands its smoothed log-probability, quantised to 16 bits. Files are
memory-mapped; scoring is one narrow pass.

Defined results: a null, empty or blank text is the end token alone; rows without an id are training rows; repeated rows
count each; without training rows every token is unknown, and the score is the base score; an empty table gives none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import crc_remainder, keep, plain_words, shared_folder
from tessera.llm.eliasfano import EliasFano, map_arrays, write_arrays

#: No word holds a line feed, so this is nobody else's hash.
END = xxhash.xxh64_intdigest(b"\n")
GRID = np.array([0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.98, 0.995])
CLASSES = 40
STEP = 2048  #: quantised log10 probabilities are multiples of 1/2048
SCORES = "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double"


def _hashes(text: str | None) -> np.ndarray:
    words = plain_words(text)
    found = np.empty(len(words) + 1, np.uint64)
    found[:-1] = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    found[-1] = END
    return found


def _groups(batches: Iterator[pa.RecordBatch], column: int, most: int = 1_000_000) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Ids (the first column) and token hashes of rows, some million tokens at a time."""
    ids, tokens, held = [], [], 0
    for batch in batches:
        for k in range(batch.num_rows):
            ids.append(batch.column(0)[k].as_py())
            tokens.append(_hashes(batch.column(column)[k].as_py()))
            held += len(tokens[-1])
            if held >= most:
                yield ids, tokens
                ids, tokens, held = [], [], 0
    if ids:
        yield ids, tokens


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def _counted(groups, most: int = 8_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct keys and their counts over a task's groups of keys, in as few pieces as the memory allows."""
    kept, held = [], 0
    for keys in groups:
        kept.append(np.unique(keys, return_counts=True))
        held += len(kept[-1][0])
        if held > most:
            kept = [_summed(*map(np.concatenate, zip(*kept)))]
            held = len(kept[0][0])
            if held > most // 2:
                yield kept.pop()
                held = 0
    if kept:
        yield _summed(*map(np.concatenate, zip(*kept)))


@dataclass(frozen=True)
class Vocabulary:
    """Where the first level lies: one file per range of hashes, and the number of words before each."""

    folder: str
    bits: int
    starts: tuple[int, ...]
    words: int
    tokens: int
    once: int

    def unknown(self) -> float:
        return (self.once + 1) / (self.tokens + 2)

    def open(self) -> OpenVocabulary:
        return OpenVocabulary(self)


class OpenVocabulary:
    def __init__(self, v: Vocabulary):
        self.v = v
        self.files = [map_arrays(f"{v.folder}/words-{b}") if v.starts[b + 1] > v.starts[b] else None for b in range(2**v.bits)]

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of sorted distinct hashes; -1 and 0 for unknown words."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        cuts = np.searchsorted(hashes, np.arange(2**self.v.bits, dtype=np.uint64) << np.uint64(64 - self.v.bits)) if self.v.bits else np.zeros(1, np.int64)
        for b, (i, j) in enumerate(zip(cuts, [*cuts[1:], len(hashes)])):
            if i < j and (f := self.files[b]) is not None:
                at = np.minimum(np.searchsorted(f["hashes"], hashes[i:j]), len(f["hashes"]) - 1)
                known = f["hashes"][at] == hashes[i:j]
                ids[i:j] = np.where(known, at + self.v.starts[b], -1)
                counts[i:j] = np.where(known, f["counts"][at], 0)
        return ids, counts

    def counts_of(self, ids: np.ndarray) -> np.ndarray:
        """Counts of sorted ids."""
        out = np.zeros(len(ids), np.int64)
        cuts = np.searchsorted(ids, self.v.starts)
        for b, (i, j) in enumerate(zip(cuts, cuts[1:])):
            if i < j:
                out[i:j] = self.files[b]["counts"][ids[i:j] - self.v.starts[b]]
        return out

    def share(self, counts: np.ndarray) -> np.ndarray:
        """P(w) by count; unknown words share one type."""
        return np.where(counts > 0, (1 - self.v.unknown()) * counts / max(1, self.v.tokens), self.v.unknown())


def vocabulary(train: DataFrame, folder: str, file_words: int = 1_000_000) -> Vocabulary:
    """Count the words of the training texts and store the first level."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, counts in _counted(np.concatenate(t) for _, t in _groups(batches, 1)):
            for k in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + 100_000].view(np.int64)), pa.array(counts[k : k + 100_000])], names=["hash", "n"])

    counted = keep(train.mapInArrow(count, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n")), "words")
    words, tokens, once = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum((F.col("n") == 1).cast("bigint")), F.lit(0))).first()
    bits = max(0, math.ceil(math.log2(max(1, words / file_words))))
    part = F.shiftrightunsigned("hash", 64 - bits) if bits else F.lit(0).cast("bigint")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        now = None

        def done():
            keys, counts = map(np.concatenate, zip(*held))
            order = np.argsort(keys)
            write_arrays(f"{folder}/words-{now}", {"hashes": keys[order], "counts": counts[order].astype(np.uint32 if counts.max() < 2**32 else np.uint64)})
            return pa.RecordBatch.from_pydict({"part": [now], "n": [len(keys)]})

        for batch in batches:
            parts, keys, counts = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            for p in np.unique(parts):
                if now is not None and p != now:
                    yield done()
                    held = []
                now = int(p)
                held.append((keys[parts == p].view(np.uint64), counts[parts == p]))
        if held:
            yield done()

    rows = counted.select(part.alias("part"), "hash", "n").repartition(2**bits, "part").sortWithinPartitions("part").mapInArrow(store, "part bigint, n bigint").collect()
    sizes = dict((r.part, r.n) for r in rows)
    return Vocabulary(folder, bits, tuple(np.concatenate([[0], np.cumsum([sizes.get(b, 0) for b in range(2**bits)])]).tolist()), words, tokens, once)


def _mixed(keys: np.ndarray) -> np.ndarray:
    """A hash of a pair's key, by which pairs are dealt to shards."""
    x = keys ^ (keys >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _pair_keys(tokens: list[np.ndarray], level: OpenVocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all tokens of a group of texts: context id, word id, context count, word count."""
    flat = np.concatenate(tokens)
    distinct, at = np.unique(flat, return_inverse=True)
    ids, counts = level.look_up(distinct)
    end = int(np.searchsorted(distinct, np.uint64(END)))
    before = np.empty_like(at)
    before[1:] = at[:-1]
    before[np.concatenate([[0], np.cumsum([len(t) for t in tokens])[:-1]])] = end
    return ids[before], ids[at], counts[before], counts[at]


def bigrams(train: DataFrame, v: Vocabulary, shards: int) -> DataFrame:
    """Stored rows (shard, keys, counts): the distinct pairs of a shard in order, packed; a key is h * V + w."""
    packer_level = 1

    def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
        steps = np.diff(keys, prepend=np.uint64(0))
        body = len(keys).to_bytes(8, "little") + np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes() + np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype(np.uint64).tobytes()
        return zstandard.ZstdCompressor(level=packer_level).compress(body)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = v.open()

        def keys():
            for _, tokens in _groups(batches, 1):
                h, w, _, _ = _pair_keys(tokens, level)
                yield h.astype(np.uint64) * np.uint64(v.words) + w.astype(np.uint64)

        for found, counts in _counted(keys()):
            shard = (_mixed(found) % np.uint64(shards)).astype(np.int64)
            for s in range(shards):
                if (mine := shard == s).any():
                    yield pa.RecordBatch.from_pydict({"shard": [s], "data": [pack(found[mine], counts[mine])]})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None

        def done():
            return pa.RecordBatch.from_pydict({"shard": [now], "data": [pack(*_summed(*map(np.concatenate, zip(*held))))]})

        for batch in batches:
            for s, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if now is not None and s != now:
                    yield done()
                    held = []
                now = s
                held.append(unpack(data.as_buffer()))
                if sum(len(k) for k, _ in held) > 4 * max(1_000_000, len(held[0][0])):
                    held = [_summed(*map(np.concatenate, zip(*held)))]
        if held:
            yield done()

    kind = "shard bigint, data binary"
    return keep(train.mapInArrow(count, kind).repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(merge, kind), "bigrams")


def unpack(data) -> tuple[np.ndarray, np.ndarray]:
    body = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(body[:8], "little")
    steps = np.ascontiguousarray(np.frombuffer(body, np.uint8, 8 * n, 8).reshape(8, n).T).view(np.uint64).reshape(-1)
    counts = np.frombuffer(body, np.uint8, n, 8 + 8 * n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(body, np.uint64, -1, 8 + 9 * n)
    return np.cumsum(steps, dtype=np.uint64), counts


def _class(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(counts.astype(float))[1], CLASSES - 1)


def _parts(keys: np.ndarray, v: Vocabulary, level: OpenVocabulary):
    """Context ids and counts and word shares of a shard's keys."""
    h, w = (keys // np.uint64(v.words)).astype(np.int64), (keys % np.uint64(v.words)).astype(np.int64)
    order = np.argsort(w, kind="stable")
    cw = np.empty(len(w), np.int64)
    cw[order] = level.counts_of(w[order])
    return h, w, level.counts_of(h), level.share(cw)


def weights(pairs: DataFrame, v: Vocabulary) -> np.ndarray:
    """The weight of P(w) for each class of context counts, by leave-one-out likelihood."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, total = v.open(), np.zeros((CLASSES, len(GRID)))
        for batch in batches:
            for data in batch.column(1):
                keys, counts = unpack(data.as_buffer())
                _, _, ch, share = _parts(keys, v, level)
                kind, rest = _class(ch), (counts - 1) / np.maximum(1, ch - 1)
                for g, weight in enumerate(GRID):
                    total[:, g] += np.bincount(kind, counts * np.log((1 - weight) * rest + weight * share), CLASSES)
        yield pa.RecordBatch.from_pydict({"sums": [total.tobytes()]})

    found = pairs.mapInArrow(sums, "sums binary").collect()  # one small matrix per partition of stored shards
    total = sum((np.frombuffer(r.sums).reshape(CLASSES, -1) for r in found), np.zeros((CLASSES, len(GRID))))
    return GRID[np.where(total.any(axis=1), total.argmax(axis=1), len(GRID) - 1)]


def build(pairs: DataFrame, v: Vocabulary, mix: np.ndarray) -> None:
    """Store the second level."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = v.open()
        for batch in batches:
            for shard, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys, counts = unpack(data.as_buffer())
                h, w, ch, share = _parts(keys, v, level)
                weight = mix[_class(ch)]
                logs = np.log10((1 - weight) * counts / ch + weight * share)
                context, first = np.unique(h, return_index=True)
                last = w[np.append(first[1:], len(h)) - 1] if len(h) else w
                base = np.concatenate([[0], np.cumsum(last + 1)[:-1]]) if len(h) else last  # so that followers of later contexts are larger
                pointers = np.searchsorted(h, np.arange(v.words + 1))
                arrays = EliasFano.encode(pointers).arrays("pointers") | EliasFano.encode(w + np.repeat(base, np.diff(np.append(first, len(h))))).arrays("followers")
                size = write_arrays(f"{v.folder}/pairs-{shard}", arrays | {"codes": np.minimum(np.round(-logs * STEP), 65535).astype(np.uint16)})
                yield pa.RecordBatch.from_pydict({"shard": [shard], "bytes": [size]})

    pairs.mapInArrow(store, "shard bigint, bytes bigint").agg(F.sum("bytes")).first()


class Shard:
    """A mapped shard of the second level."""

    def __init__(self, uri: str):
        arrays = map_arrays(uri)
        self.pointers, self.followers, self.codes = EliasFano.decode(arrays, "pointers"), EliasFano.decode(arrays, "followers"), arrays["codes"]

    def look_up(self, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        """log10 P(w|h) of pairs that the shard holds, NaN for others. Equal contexts stand together."""
        out = np.full(len(h), np.nan)
        new = np.concatenate([[True], h[1:] != h[:-1]])
        context = h[new]
        first, end = self.pointers.at(context), self.pointers.at(context + 1)
        # the range before ends at its last follower: the base of this context is one more than that
        base = np.zeros(len(context), np.int64)
        inner = np.flatnonzero((first < end) & (first > 0))
        base[inner] = self.followers.at(first[inner] - 1) + 1
        of = np.cumsum(new) - 1
        some = np.flatnonzero((first < end)[of])
        first, end, target = first[of[some]], end[of[some]], w[some] + base[of[some]]
        at = self.followers.successor(first, end, target)
        inside = np.flatnonzero(at < end)
        hit = inside[self.followers.at(at[inside]) == target[inside]]
        out[some[hit]] = self.codes[at[hit]] / -STEP
        return out


def score(docs: DataFrame, modulus: int = 7, remainder: int = 2, shard_tokens: int = 4_000_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    held_out = F.coalesce(crc_remainder(F.col("doc_id"), modulus) == remainder, F.lit(False))
    train, folder = rows.where(~held_out), shared_folder(docs.sparkSession, "trie")
    v = vocabulary(train, folder)
    shards = max(1, math.ceil(v.tokens / shard_tokens))
    pairs = bigrams(train, v, shards)
    mix = weights(pairs, v)
    build(pairs, v, mix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, opened, scale = v.open(), {}, v.tokens + v.words + 1
        for ids, tokens in _groups(batches, 1):
            h, w, ch, cw = _pair_keys(tokens, level)
            base = np.log10((cw + 1) / scale)
            if v.tokens:
                logs = np.log10(level.share(cw)) + np.where(ch > 0, np.log10(mix[_class(ch)]), 0.0)
                known = np.flatnonzero((h >= 0) & (w >= 0))
                keys, at = np.unique(h[known].astype(np.uint64) * np.uint64(v.words) + w[known].astype(np.uint64), return_inverse=True)
                found, shard = np.full(len(keys), np.nan), _mixed(keys) % np.uint64(shards)
                for s in range(shards):
                    mine = np.flatnonzero(shard == np.uint64(s))
                    if len(mine):
                        opened.setdefault(s, None)
                        opened[s] = opened[s] or Shard(f"{v.folder}/pairs-{s}")
                        found[mine] = opened[s].look_up((keys[mine] // np.uint64(v.words)).astype(np.int64), (keys[mine] % np.uint64(v.words)).astype(np.int64))
                seen = found[at]
                logs[known] = np.where(np.isnan(seen), logs[known], seen)
            else:
                logs = base
            starts = np.concatenate([[0], np.cumsum([len(t) for t in tokens])[:-1]])
            add = lambda x: np.add.reduceat(x, starts)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(t) for t in tokens], pa.int64()), pa.array(add((cw > 0).astype(np.int64))), pa.array(add(base)), pa.array(add(logs))], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    scored = rows.mapInArrow(run, SCORES)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(v.tokens).cast("bigint").alias("train_tokens"), "base_score", "score")
