"""Repeated passages across documents by collinear chaining of shared k-mer seeds.

Copies: of documents with equal texts the one with the smallest id stands for all; the others each get one row, and only
the representatives go on.

Seeds: the k-word shingles that two documents hold. With ``e`` edits, n words with a share s of equal words have at least
s n - (k - 1) (e + 1) of them: 7 for 50 words, 0.8 and k = 4, however the edits lie. A first pass over the texts deals
40 bits of each distinct shingle hash to shards and stores those that come twice; the second keeps only such seeds, and of
runs of k or more of them, word after word, only those with the smallest hash of k neighbours (so that any two documents
that share such a run keep the same seeds of it, one in k at least).

Matching: each seed hash has one canonical occurrence, the first by (doc_id, position); every other document's occurrence
is matched with that one. Where the canonical occurrences of two seeds of a document, some words apart, do not follow
each other as its own do, the two together are a seed of a second round, which has first occurrences of its own: so a
passage is found whose parts come first in different documents. The far seed of such a pair is the one with the smallest
hash of a few neighbours, and both lie in runs. A passage that thousands of documents share thus costs each of them one
set of matches, and no group is expanded into pairs.

Chaining: the matches of a document with one earlier document are chained in order, with gap costs, by a Fenwick tree
over prefix maxima; one has the words of two seeds apart at least. A chain whose seeds alone are long and similar enough is a passage, and chains inside it are dropped.
Alignment: chains are cut at long gaps and aligned on word hashes, exactly along diagonals, with small edits at the ends
and a longest common subsequence in between; where that is too short or too little alike, the ends are those common
subsequences that make the longest passage. Passages that are long and similar enough are returned, but for those inside
another passage of their document; a chain whose words are all in passages of better chains is not followed. So each word
that a repeated passage holds lies in a returned one. Of a document's words
only those of spans that chains name are moved.

Defined results: null and blank texts, texts shorter than a seed and repeats within one document give nothing (nor
does a seed that the same document has up to 8 words earlier: of "a a a a ..." the first seed counts); rows that share
an id are one document each in seeding but cannot match each other; rows without an id take no part; an empty table gives
none; the first document of a passage has no row for it; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import discard, free_name, keep, plain_words, shared_folder, worker_cache
from tessera.llm.common import words as split_words
from tessera.llm.contain import bounded
from tessera.llm.eliasfano import map_arrays, write_arrays

SEEDS = "hash bigint, doc bigint, pos int, run boolean"
CHAINS = "doc bigint, first bigint, p array<int>, q array<int>, keys array<bigint>, lead boolean"
PASSAGES = "doc_id bigint, start int, end int, source_id bigint, source_start int, source_end int, matched int"
#: Words that are fetched beyond a chain at either side, to find where the passage ends.
MARGIN = 48
SHARDS = 256
#: Least words between the two seeds of a pair, and the places from there on that the second is chosen from.
APART, CHOICE = (10, 20, 40), 6
#: Of a run of matches word by word, one in so many is chained, for all of them.
THIN = 16
#: Ends of the spans that are fetched are multiples of this, so that partners of one passage ask for the same words.
ROUND = 64


def word_hashes(text: str | None) -> np.ndarray:
    words = plain_words(text)
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all seeds of a text, by position."""
    n = max(0, len(words) - k + 1)
    h = np.zeros(n, np.uint64)
    for j in range(k if n else 0):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[j : n + j]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _hashed(batches: Iterator[pa.RecordBatch], k: int, most: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Ids and seed hashes of texts, about ``most`` seeds at a time."""
    worker_cache(None, 0)  # what an earlier stage of a pipeline has left
    ids, found, held = [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids.append(doc)
            found.append(shingles(word_hashes(text.as_py()), k))
            held += len(found[-1])
            if held >= most:
                yield np.array(ids, np.int64), found
                ids, found, held = [], [], 0
    if ids:
        yield np.array(ids, np.int64), found


def _packed(values: np.ndarray) -> bytes:
    """Increasing numbers as the compressed bytes of their steps, all lowest bytes first."""
    steps = np.diff(values, prepend=np.uint32(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).reshape(-1), dtype=np.uint32)


def store_shared(docs: DataFrame, k: int, folder: str) -> None:
    """Store, by shard, 32 further bits of the seed hashes that two texts hold."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in _hashed(batches, k, 1_000_000):
            keys, n = np.unique(np.concatenate([np.unique(h) for h in found]) >> np.uint64(24), return_counts=True)
            cuts = np.searchsorted(keys, np.arange(SHARDS + 1, dtype=np.uint64) << np.uint64(32))
            low = keys.astype(np.uint32)
            parts = [(low[i:j], n[i:j] > 1) for i, j in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_pydict({"shard": list(range(SHARDS)), "once": [_packed(x[~m]) for x, m in parts], "more": [_packed(x[m]) for x, m in parts]})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, once, more = None, [], []

        def done():
            x = np.sort(np.concatenate(once + [y for y in more for _ in range(2)]))
            size = write_arrays(f"{folder}/seeds-{now}", {"low": np.unique(x[1:][x[1:] == x[:-1]])})
            return pa.RecordBatch.from_pydict({"shard": [now], "bytes": [size]})

        for batch in batches:
            for s, a, b in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if now is not None and s != now:
                    yield done()
                    once, more = [], []
                now = s
                once.append(_unpacked(a))
                more.append(_unpacked(b))
        if now is not None:
            yield done()

    counted = docs.mapInArrow(count, "shard bigint, once binary, more binary").repartition(64, "shard").sortWithinPartitions("shard")
    counted.mapInArrow(merge, "shard bigint, bytes bigint").agg(F.sum("bytes")).first()


def tandem(hashes: np.ndarray, rows: np.ndarray, most: int = 8) -> np.ndarray:
    """Which seeds the same text has up to ``most`` words earlier."""
    found = np.zeros(len(hashes), bool)
    for period in range(1, min(most, len(hashes) - 1) + 1):
        found[period:] |= (hashes[period:] == hashes[:-period]) & (rows[period:] == rows[:-period])
    return found


def thinned(hashes: np.ndarray, places: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which seeds to keep, and which lie in runs of k or more neighbours. Of a run, a seed stays if it has the smallest
    hash (the first of equals) of any k neighbours; others all stay."""
    n = len(hashes)
    if not n:
        return np.zeros(0, bool), np.zeros(0, bool)
    begins = np.flatnonzero(np.concatenate([[True], (places[1:] != places[:-1] + 1) | (rows[1:] != rows[:-1])]))
    lengths = np.diff(np.append(begins, n))
    in_run = np.repeat(lengths >= k, lengths)
    kept = ~in_run
    left = np.repeat(begins + lengths, lengths) - np.arange(n)  # neighbours from here on, with this one
    starts = np.flatnonzero(in_run & (left >= k))
    if len(starts):
        window = hashes[starts[:, None] + np.arange(k)]
        kept[starts + window.argmin(axis=1)] = True
    return kept, in_run


def seeds(docs: DataFrame, k: int, folder: str) -> DataFrame:
    """The seeds of texts that another text has, too (or, rarely, a hash with the same 40 bits); ``folder`` holds those bits."""
    store_shared(docs, k, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = None
        for ids, found in _hashed(batches, k, 500_000):
            files = files or [map_arrays(f"{folder}/seeds-{s}")["low"] for s in range(SHARDS)]
            hashes, sizes = np.concatenate(found), np.array([len(h) for h in found])
            places = np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            order = np.argsort(hashes)
            keys = hashes[order] >> np.uint64(24)
            cuts = np.searchsorted(keys, np.arange(SHARDS + 1, dtype=np.uint64) << np.uint64(32))
            low, known = keys.astype(np.uint32), np.zeros(len(keys), bool)
            for f, i, j in zip(files, cuts, cuts[1:]):
                if i < j and len(f):
                    known[i:j] = f[np.minimum(np.searchsorted(f, low[i:j]), len(f) - 1)] == low[i:j]
            rows, at = np.repeat(np.arange(len(sizes)), sizes), np.sort(order[known])
            at = at[~tandem(hashes, rows)[at]]
            kept, in_run = thinned(hashes[at], places[at], rows[at], k)
            at, in_run = at[kept], in_run[kept]
            docs_of = np.repeat(ids, sizes)
            for c in range(0, len(at), 200_000):
                x = at[c : c + 200_000]
                yield pa.RecordBatch.from_arrays([pa.array(hashes[x].view(np.int64)), pa.array(docs_of[x]), pa.array(places[x].astype(np.int32)), pa.array(in_run[c : c + 200_000])], names=["hash", "doc", "pos", "run"])

    return docs.mapInArrow(run, SEEDS)


def chain(p: list[int], q: list[int], k: int = 5, gap_cost: float = 0.05, weights: list[int] | None = None) -> list[list[int]]:
    """Disjoint chains of matches (p, q), as index lists, best first: p and q increase strictly. The score of a chain is
    k words per match (or its weight) less a cost per word between matches; the best predecessor is a prefix maximum over
    smaller q, kept in a Fenwick tree of (score + cost * (p + q)) while p increases."""
    order = sorted(range(len(p)), key=lambda i: (p[i], -q[i]))  # of equal p, none can follow another
    ranks = sorted(set(q))
    tree: list[tuple[float, int]] = [(float("-inf"), -1)] * (len(ranks) + 1)
    score, before = [0.0] * len(p), [-1] * len(p)
    for i in order:
        at = bisect_left(ranks, q[i])
        best, node = (float("-inf"), -1), at
        while node:
            best = max(best, tree[node])
            node &= node - 1
        gain = best[0] - gap_cost * (p[i] + q[i])
        score[i] = (weights[i] if weights else k) + max(0.0, gain)
        before[i] = best[1] if gain > 0 else -1
        value, node = (score[i] + gap_cost * (p[i] + q[i]), i), at + 1
        while node <= len(ranks):
            if value > tree[node]:
                tree[node] = value
            node += node & -node
    used, chains = [False] * len(p), []
    for i in sorted(range(len(p)), key=lambda i: -score[i]):
        path = []
        while i >= 0 and not used[i]:
            used[i] = True
            path.append(i)
            i = before[i]
        if path:
            chains.append(path[::-1])
    return chains


def pair_keys(first: np.ndarray, p: np.ndarray, q: np.ndarray, covered: list[tuple[int, int]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, positions and lengths of the pairs of a document's seeds (sorted by position) whose canonical occurrences do
    not follow each other as they do, unless they lie in a span of ``covered``."""
    mark = first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ q.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    mark ^= mark >> np.uint64(29)
    starts, ends = np.array(sorted(covered), np.int64).reshape(-1, 2).T
    reach = np.concatenate([[-1], np.maximum.accumulate(ends)])[np.searchsorted(starts, p, side="right")]
    top = np.uint64(2**64 - 1)
    keys, places, lengths = [], [], []
    for apart in APART:
        # of the few seeds from ``apart`` words on, the one with the smallest mark
        begin = np.searchsorted(p, p + apart)
        at, least = np.zeros(len(p), np.int64), np.full(len(p), top)
        for step in range(CHOICE):
            j = np.minimum(begin + step, len(p) - 1)
            better = (begin + step < len(p)) & (p[j] < p + apart + CHOICE) & (mark[j] < least)
            at, least = np.where(better, j, at), np.where(better, mark[j], least)
        gap = p[at] - p
        here = np.flatnonzero((least < top) & ((first[at] != first) | (q[at] - q != gap)) & (reach < p[at] + k))
        h = (mark[here] ^ gap[here].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(31)) ^ mark[at[here]]) * np.uint64(0x9E3779B97F4A7C15)
        keys.append(h ^ (h >> np.uint64(32)))
        places.append(p[here])
        lengths.append(gap[here])
    return np.concatenate(keys).view(np.int64), np.concatenate(places), np.concatenate(lengths)


def chains(matches: DataFrame, k: int, least: int, least_words: int, similarity: float, pairs: bool, longest_gap: int = 40) -> DataFrame:
    """doc, first (the earlier document) and the chained positions p and q in both, cut at gaps over ``longest_gap`` words,
    of chains of at least ``least`` matches and the words of two seeds apart that do not lie inside a chain that is a passage by its seeds alone; ``lead``:
    those that are not wholly among the words of better ones.
    ``pairs``: and rows with keys, at positions p and of lengths q, for the second round.
    A document's matches are as many as its shared seeds, and all meet in one task."""

    def one(doc: int, first: np.ndarray, p: np.ndarray, q: np.ndarray, run: np.ndarray, out: list) -> None:
        every, found = (first[run], p[run], q[run]), []
        other = first != doc
        first, p, q = first[other], p[other], q[other]
        order = np.lexsort((p, q - p, first))  # along diagonals
        first, p, q = first[order], p[order], q[order]
        cuts = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1], [True]])) if len(first) else []
        for i, j in zip(cuts, cuts[1:]):
            if j - i >= least:
                _chain_one(int(first[i]), p[i:j], q[i:j], found)
        spans, end = [], -1
        for x in sorted((x for x in found if x[3]), key=lambda x: (x[1][0], -x[1][-1], x[0])):
            if x[1][-1] + k > end:  # else inside one that is found
                end = x[1][-1] + k
                spans.append((x[1][0], end))
                out.append((doc, x[0], x[1], x[2], None, True))
        starts, ends = np.array(spans, np.int64).reshape(-1, 2).T
        hidden = np.zeros(int(p.max()) + k if len(p) else 0, bool)
        for x in sorted((x for x in found if not x[3]), key=lambda x: (-x[4], x[1][0], x[0], x[2][0])):
            s, e = x[1][0], x[1][-1] + k
            at = int(np.searchsorted(starts, s, side="right")) - 1
            if at < 0 or ends[at] < e:
                out.append((doc, x[0], x[1], x[2], None, not hidden[s:e].all()))
                pad = max(0, least_words - (e - s)) // 2  # a passage has so many words at least
                hidden[max(0, s - pad) : e + pad] = True
        if pairs and len(every[0]):
            keys, places, lengths = pair_keys(*every, spans, k)
            if len(keys):
                out.append((doc, None, places.tolist(), lengths.tolist(), keys.tolist(), None))

    def _chain_one(first: int, p: np.ndarray, q: np.ndarray, found: list) -> None:
        # matches near each other on a diagonal are chained by a few, for as many equal words as they stand for
        same = (q[1:] - p[1:] == q[:-1] - p[:-1]) & (p[1:] - p[:-1] <= k)
        begins = np.flatnonzero(np.concatenate([[True], ~same]))
        offset = p - np.repeat(p[begins], np.diff(np.append(begins, len(p))))
        slot = np.concatenate([[-1], offset[:-1] // THIN])
        slot[begins] = -1
        taken = np.flatnonzero((offset // THIN != slot) | np.append(~same, True))
        words = np.add.reduceat(np.append(np.where(same, np.minimum(k, p[1:] - p[:-1]), k), k), taken).tolist()
        sizes = np.diff(np.append(taken, len(p))).tolist()
        p, q = p[taken].tolist(), q[taken].tolist()
        for path in chain(p, q, k, weights=words):
            cut = 0
            for j in range(1, len(path) + 1):
                if j == len(path) or max(p[path[j]] - p[path[j - 1]], q[path[j]] - q[path[j - 1]]) > longest_gap:
                    part = path[cut:j]
                    if sum(sizes[i] for i in part) >= least and sum(words[i] for i in part) >= 2 * k:
                        x, y = [p[i] for i in part], [q[i] for i in part]
                        n, m = x[-1] + k - x[0], y[-1] + k - y[0]
                        equal = sum(words[i] for i in part)
                        found.append((first, x, y, min(n, m) >= least_words and equal >= similarity * max(n, m), equal))
                    cut = j

    def emit(out: list) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["doc", "first", "p", "q", "keys", "lead"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], []
        for batch in batches:
            doc, *rest = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(4))
            rest.append(batch.column(4).to_numpy(zero_copy_only=False).astype(bool))
            cuts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1], [True]])) if len(doc) else []
            for i, j in zip(cuts, cuts[1:]):
                if doc[i] != now:
                    if held:
                        one(now, *map(np.concatenate, zip(*held)), out)
                    now, held = int(doc[i]), []
                    if len(out) > 500:
                        yield emit(out)
                        out = []
                held.append([x[i:j] for x in rest])
        if held:
            one(now, *map(np.concatenate, zip(*held)), out)
        if out:
            yield emit(out)

    ordered = matches.select("doc", "first", "p", "q", "run").repartition("doc").sortWithinPartitions("doc", "p", "first", "q")
    return ordered.mapInArrow(run, CHAINS)


def _run_length(a: np.ndarray, b: np.ndarray) -> int:
    """Equal words at the start of both."""
    n = min(len(a), len(b))
    size = 32
    while size < n and (a[:size] == b[:size]).all():
        size *= 2
    size = min(size, n)
    differ = np.flatnonzero(a[:size] != b[:size])
    return int(differ[0]) if len(differ) else size


def _extend(a: np.ndarray, b: np.ndarray, most_edits: int = 6, step: int = 4, sure: int = 4) -> tuple[int, int, int]:
    """Words of a and b and equal words of a greedy alignment from their starts: runs of equal words with small edits
    between them, each followed by at least ``sure`` equal words; runs must pay for their edits."""
    i = j = matched = 0
    edits, best = 0.0, (0, 0, 0)
    while True:
        n = _run_length(a[i:], b[j:])
        i, j, matched = i + n, j + n, matched + n
        edits = max(0.0, edits - n / 4)
        if n:
            best = (i, j, matched)
        options = [(x + y, x, y) for x in range(step + 1) for y in range(step + 1) if x + y and _run_length(a[i + x : i + x + sure], b[j + y : j + y + sure]) == sure]
        if not options:
            return best
        _, x, y = min(options, key=lambda o: (max(o[1], o[2]), o))
        edits += max(x, y)
        if edits > most_edits:
            return best
        i, j = i + x, j + y


def _common(a: np.ndarray, b: np.ndarray) -> tuple[list[tuple[int, int, int]], int]:
    """Ends in both of common subsequences from their starts, each with its longest one's words, at equal words; and the
    words of the longest one of all. Bits of ``row`` that are 0 are the steps of a row of the usual table."""
    masks: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    every = (1 << len(a)) - 1
    row, ends = every, [(0, 0, 0)]
    for j, w in enumerate(b.tolist(), 1):
        mask = masks.get(w, 0)
        if mask:
            u = row & mask
            row = ((row + u) | (row - u)) & every
            while mask:
                i = (mask & -mask).bit_length()
                mask &= mask - 1
                ends.append((i, j, i - (row & ((1 << i) - 1)).bit_count()))
    return ends, len(a) - row.bit_count()


def _fewer(ends: np.ndarray) -> np.ndarray:
    """Of ends that reach equally far in the longer part, which is the same one, that with the most equal words."""
    i, j, equal = ends.T
    far, side = np.maximum(i, j), np.sign(i - j)
    order = np.lexsort((-np.minimum(i, j), -equal, side, far))
    new = np.concatenate([[True], (np.diff(far[order]) != 0) | (np.diff(side[order]) != 0)])
    return ends[order[new]]


def _best_ends(a: np.ndarray, b: np.ndarray, inner: tuple[int, int, int, int, int], least_words: int, similarity: float) -> tuple[int, int, int, int, int] | None:
    """The longest passage around an aligned middle (its extents and equal words) that is long and similar enough."""
    s, e, t, u, matched = inner
    left = _fewer(np.array(_common(a[max(0, s - MARGIN) : s][::-1], b[max(0, t - MARGIN) : t][::-1])[0]))
    right = _fewer(np.array(_common(a[e : e + MARGIN], b[u : u + MARGIN])[0]))
    n = e - s + left[:, :1] + right[:, 0]
    m = u - t + left[:, 1:2] + right[:, 1]
    equal = matched + left[:, 2:] + right[:, 2]
    good = (np.minimum(n, m) >= least_words) & (equal >= similarity * np.maximum(n, m))
    if not good.any():
        return None
    x, y = divmod(int(np.where(good, np.minimum(n, m), -1).argmax()), len(right))
    return s - int(left[x, 0]), e + int(right[y, 0]), t - int(left[x, 1]), u + int(right[y, 1]), int(equal[x, y])


def passage(a: np.ndarray, b: np.ndarray, p: list[int], q: list[int], k: int, least_words: int, similarity: float) -> tuple[int, int, int, int, int] | None:
    """Extent in both and equal words of the passage along a chain, None if it is not long or similar enough."""

    def enough(s: int, e: int, t: int, u: int, matched: int) -> bool:
        return min(e - s, u - t) >= least_words and matched >= similarity * max(e - s, u - t)

    found = align(a, b, p, q, k)
    if enough(*found):
        return found
    return _best_ends(a, b, align(a, b, p, q, k, ends=False), least_words, similarity)


def align(a: np.ndarray, b: np.ndarray, p: list[int], q: list[int], k: int, ends: bool = True) -> tuple[int, int, int, int, int]:
    """Extent in both word sequences and equal words of the alignment along a chain of matches; without ``ends``, of its
    middle: what lies before the first match and after the last run of equal words is left out."""
    left = _extend(a[: p[0]][::-1], b[: q[0]][::-1]) if ends else (0, 0, 0)
    i, j, matched = p[0], q[0], left[2]
    for x, y in zip(p, q):
        if x < i or y < j:  # inside the run so far
            continue
        if x > i or y > j:  # a gap
            matched += int(_common(a[i:x], b[j:y])[1])
            i, j = x, y
        n = _run_length(a[i:], b[j:])
        i, j, matched = i + n, j + n, matched + n
    right = _extend(a[i:], b[j:]) if ends else (0, 0, 0)
    return p[0] - left[0], i + right[0], q[0] - left[1], j + right[1], matched + right[2]


def _fetch_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc, s, e, words: word hashes (32 bits each) of requested spans. Only documents that are asked for are moved; the
    spans of one document are distinct pairs of multiples of ``ROUND``, and each is a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                words = word_hashes(batch.column(1)[k].as_py()).astype(np.uint32)
                asked = [(x["s"], x["e"]) for x in batch.column(2)[k].as_py()]
                for c in range(0, len(asked), 1000):
                    part = asked[c : c + 1000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([batch.column(0)[k].as_py()] * len(part), pa.int64()), *(pa.array(x, pa.int32()) for x in zip(*part)), pa.array([words[s:e].tobytes() for s, e in part], pa.binary())],
                        names=["doc", "s", "e", "words"],
                    )

    asked = keep(spans.distinct().groupBy("doc").agg(F.collect_list(F.struct("s", "e")).alias("spans")), "spans")
    ids = bounded(asked.select(F.col("doc").alias("doc_id")))
    texts = docs.join(ids, "doc_id", "left_semi")
    words = keep(texts.join(asked, F.col("doc_id") == F.col("doc")).select("doc", "text", "spans").mapInArrow(run, "doc bigint, s int, e int, words binary"), "span-words")
    discard(docs.sparkSession, asked)
    return words


def copies(docs: DataFrame, least_words: int) -> tuple[DataFrame, DataFrame]:
    """Documents without those whose whole text a document with a smaller id has, and the passages of these."""
    digests = docs.select("doc_id", F.xxhash64("text").alias("h"), F.crc32(F.col("text").cast("binary")).alias("c"), F.length("text").alias("n"))
    groups = keep(digests.groupBy("h", "c", "n").agg(F.min("doc_id").alias("source_id"), F.max("doc_id").alias("last")).where("last > source_id").drop("last"), "copy-groups")
    members = keep(digests.join(groups, ["h", "c", "n"]).where("doc_id > source_id").select("doc_id", "source_id").distinct(), "copies")
    rest = docs.join(bounded(members.select("doc_id")), "doc_id", "left_anti")
    sizes = docs.join(bounded(groups.select(F.col("source_id").alias("doc_id")).distinct()), "doc_id", "left_semi").select(F.col("doc_id").alias("source_id"), F.size(split_words("text")).alias("end")).dropDuplicates(["source_id"])
    zero = F.lit(0)
    return rest, members.join(sizes, "source_id").where(F.col("end") >= least_words).select("doc_id", zero.alias("start"), "end", "source_id", zero.alias("source_start"), F.col("end").alias("source_end"), F.col("end").alias("matched"))


def first_holders(held: DataFrame, label: str, shared_only: bool) -> tuple[DataFrame, DataFrame]:
    """Rows (hash, doc, pos) with the first document and position, (first, q), of their hash, and the stored table of these
    firsts; ``shared_only``: if a later document has it."""
    firsts = held.groupBy("hash").agg(F.min(F.struct("doc", "pos")).alias("f"), *([F.max("doc").alias("last")] if shared_only else []))
    firsts = firsts.where("f.doc < last") if shared_only else firsts
    shared = keep(firsts.select("hash", F.col("f.doc").alias("first"), F.col("f.pos").alias("q")), label)
    return held.join(shared, "hash"), shared


def repeated_passages(docs: DataFrame, least_words: int = 50, similarity: float = 0.8, k: int = 4, least: int = 2) -> DataFrame:
    """doc_id, start, end, source_id, source_start, source_end, matched: passages, in words, that an earlier document has."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    docs, whole = copies(docs, least_words)
    folder = shared_folder(spark, "seed-hashes")
    held = keep(seeds(docs, k, folder), "seeds")
    discard(spark, folder)
    matches, firsts = first_holders(held, "shared-seeds", False)
    once = keep(chains(matches.select("doc", "first", F.col("pos").alias("p"), "q", "run"), k, least, least_words, similarity, True), "first-chains")
    discard(spark, held, firsts)
    pairs = once.where("keys IS NOT NULL").select("doc", F.explode(F.arrays_zip("keys", "p", "q")).alias("x")).select(F.col("x.keys").alias("hash"), "doc", F.col("x.p").alias("pos"), F.col("x.q").alias("length"))
    paired, firsts = first_holders(pairs, "shared-pairs", True)
    paired = paired.where("doc <> first").select("doc", "first", F.explode(F.array(F.lit(0), F.col("length"))).alias("step"), "pos", "q")
    paired = paired.select("doc", "first", (F.col("pos") + F.col("step")).alias("p"), (F.col("q") + F.col("step")).alias("q"), F.lit(False).alias("run")).distinct()
    linked = once.where("keys IS NULL").unionByName(chains(paired, k, 2, least_words, similarity, False)).drop("keys")

    def ends(name: str, first: str, last: str) -> list:
        """Before and after a chain, with its margins, in multiples of ``ROUND``."""
        before, after = F.greatest(F.lit(0), F.col(name)[0] - MARGIN), F.element_at(name, -1) + k + MARGIN
        return [(F.floor(before / ROUND) * ROUND).cast("int").alias(first), (F.ceil(after / ROUND) * ROUND).cast("int").alias(last)]

    linked = keep(linked.select("*", *ends("p", "ps", "pe"), *ends("q", "qs", "qe")), "chains")
    discard(spark, once, firsts)
    # chains among the words of better ones are aligned only if those words are not all in the passages of these
    found, words = aligned(docs, linked.where("lead"), k, least_words, similarity)
    leading = keep(found, "leading-passages")
    discard(spark, words)
    order = W.partitionBy("doc_id").orderBy("start", F.desc("end"), "source_id", "source_start")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    apart = leading.select("doc_id", "start", "end", F.coalesce(F.col("start") > F.max("end").over(before), F.lit(True)).cast("int").alias("new"), "source_id", "source_start")
    spans = apart.withColumn("span", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0))).groupBy("doc_id", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    inside = spans.groupBy(F.col("doc_id").alias("in_doc")).agg(F.collect_list(F.struct("start", "end")).alias("inside"))
    hidden = F.exists("inside", lambda x: (x["start"] <= F.col("p")[0]) & (x["end"] >= F.element_at("p", -1) + k))
    rest = keep(linked.where("NOT lead").join(inside, F.col("doc") == F.col("in_doc"), "left").where(~F.coalesce(hidden, F.lit(False))).drop("in_doc", "inside"), "other-chains")
    discard(spark, linked)
    found = leading.unionByName(aligned(docs, rest, k, least_words, similarity)[0])
    return found.withColumn("reach", F.max("end").over(before)).where("reach IS NULL OR reach < end").drop("reach").unionByName(whole)


def aligned(docs: DataFrame, linked: DataFrame, k: int, least_words: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The passages along chains, and the stored words that they are read from."""
    both = linked.select(F.col("doc"), F.col("ps").alias("s"), F.col("pe").alias("e")).unionByName(linked.select(F.col("first").alias("doc"), F.col("qs").alias("s"), F.col("qe").alias("e")))
    words = _fetch_spans(docs, both)
    a = words.select(F.col("doc").alias("a_doc"), F.col("s").alias("a_s"), F.col("e").alias("a_e"), F.col("words").alias("a"))
    b = words.select(F.col("doc").alias("b_doc"), F.col("s").alias("b_s"), F.col("e").alias("b_e"), F.col("words").alias("b"))
    paired = linked.join(a, (F.col("doc") == F.col("a_doc")) & (F.col("ps") == F.col("a_s")) & (F.col("pe") == F.col("a_e"))).select("doc", "first", "p", "q", "ps", "qs", "qe", "a")
    paired = paired.join(b, (F.col("first") == F.col("b_doc")) & (F.col("qs") == F.col("b_s")) & (F.col("qe") == F.col("b_e"))).select("doc", "first", "p", "q", "ps", "qs", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                x, y = np.frombuffer(r["a"], np.uint32), np.frombuffer(r["b"], np.uint32)
                found = passage(x, y, [v - r["ps"] for v in r["p"]], [v - r["qs"] for v in r["q"]], k, least_words, similarity)
                if found:
                    s, e, t, u, matched = found
                    out.append((r["doc"], s + r["ps"], e + r["ps"], r["first"], t + r["qs"], u + r["qs"], matched))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=[x.split()[0] for x in PASSAGES.split(", ")])

    return paired.mapInArrow(run, PASSAGES), words


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans, in word positions; white space goes with the word after it."""
    data = text.encode()
    blank = np.isin(np.frombuffer(data, np.uint8), np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
    starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    ends = np.flatnonzero(~blank & np.concatenate([blank[1:], [True]])) + 1
    kept, at = [], 0
    for s, e in sorted(spans):
        e = min(e, len(ends))
        if s >= e:
            continue
        start, end = int(ends[s - 1]) if s else 0, int(ends[e - 1])
        if start > at:
            kept.append(data[at:start])
        at = max(at, end)
    kept.append(data[at:])
    return b"".join(kept).decode()


def without_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """Documents without their repeated passages; documents of which nothing is left go. Others stay as they are.

    Only documents with passages are joined with their spans, and only by id; the rest is a broadcast filter within its
    bound, or one shuffle of the texts beyond it."""
    names, kinds = docs.columns, docs.schema
    key, cuts = free_name("_id", names), free_name("_spans", names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [cut_words(t, [(s["start"], s["end"]) for s in spans]) for t, spans in zip(batch.column("text").to_pylist(), batch.column(cuts).to_pylist())]
            alive = pa.array([bool(t.strip(" \t\n\x0b\x0c\r")) for t in texts], pa.bool_())
            columns = [pa.array(texts, batch.schema.field(n).type) if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(alive)

    spans = keep(passages.select(F.col("doc_id").alias(key), "start", "end").distinct().groupBy(key).agg(F.collect_list(F.struct("start", "end")).alias(cuts)), "cuts")
    ids = bounded(spans.select(key))
    hit = F.col("doc_id") == F.col(key)
    untouched = docs.join(ids, hit, "left_anti")
    cut = docs.join(ids, hit, "left_semi").join(spans, hit).select(*names, cuts).mapInArrow(run, kinds)
    if "n_chars" in names:
        cut = cut.withColumn("n_chars", F.length("text").cast(kinds["n_chars"].dataType)).select(*names)
    return untouched.unionByName(cut)
