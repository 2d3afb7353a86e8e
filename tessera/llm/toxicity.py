"""Toxicity by compression distance.

Two zstandard dictionaries: one trained on ordinary text; the other holds the same and, after it, fragments that toxic
text has and ordinary text has not. A window is one word between spaces, compressed after a short carrier that both
dictionaries hold (without it, so short a window would be stored as it is). A window's distance is the share of its
bytes that the toxic dictionary saves over the ordinary one; a document's is its largest, and an isotonic fit on
training rows that no dictionary has seen turns it into a score. Near copies are one training document.

Training rows are at most ``per_class`` toxic and twice as many ordinary documents, taken in the order of a hash of their
id; of each, at most ``WORDS`` distinct words and ``PIECES`` pieces of eight words, taken by hash; of the pieces, at most
``SAMPLES`` train the ordinary dictionary, and fragments take at most ``extra`` bytes. A third of the documents, whole,
calibrate. Scoring covers every window of every whole text. Defined results: null and blank texts have the distance 0;
rows without an id are scored and not held out; an id with several labels is toxic if one says so; labels other than 0 and
1 are ignored; repeated rows are scored each; without training rows all scores are 0; an empty table gives none; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import calibration
from tessera.llm.common import crc_remainder, plain_words, worker_cache

LEVEL = 19
GRAM = 6
CARRIER = 20
CACHED_WORDS = 120_000
WORDS, PIECES, SAMPLES = 4096, 128, 60_000


@dataclass(frozen=True)
class Dictionaries:
    ordinary: bytes
    toxic: bytes

    def carrier(self) -> bytes:
        return self.ordinary[-CARRIER:]


class Distances:
    """Distances of windows, each distinct word compressed once per worker."""

    def __init__(self, dictionaries: Dictionaries):
        self.carrier = dictionaries.carrier()
        self.coders = [self._coder(d) for d in (dictionaries.ordinary, dictionaries.toxic)]
        self.key = ("toxicity", zlib.crc32(dictionaries.toxic))

    @staticmethod
    def _coder(content: bytes) -> zstandard.ZstdCompressor:
        data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_checksum=False, write_content_size=False, write_dict_id=False)

    def of(self, texts: list[str | None]) -> list[float]:
        cut = [set(plain_words(t)) for t in texts]
        cache = worker_cache(self.key, CACHED_WORDS)
        missing = list(set().union(*cut).difference(cache))
        for k in range(0, len(missing), 50_000):
            part = missing[k : k + 50_000]
            windows = [self.carrier + b" " + w + b" " for w in part] + [self.carrier]  # the batch call wants two or more
            plain, toxic = (c.multi_compress_to_buffer(windows, threads=1) for c in self.coders)
            for w, a, b in zip(part, plain, toxic):
                cache[w] = (len(a) - len(b)) / (len(w) + 2)
        return [max(map(cache.__getitem__, words), default=0.0) for words in cut]


def _grams(words: set[bytes]) -> set[bytes]:
    return {p[i : i + GRAM] for w in words for p in (b" " + w + b" ",) for i in range(max(1, len(p) - GRAM + 1))}


def digest(text: str | None) -> tuple[int, list[bytes], list[bytes]]:
    """What training takes from a text: a key that near copies mostly share (their smallest shingle hash), distinct words,
    and pieces."""
    words = plain_words(text)
    key = min(zlib.crc32(b" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4)))
    pieces = [b" " + b" ".join(words[i : i + 8]) + b" " for i in range(0, len(words), 8)]
    return key, sorted(set(words), key=lambda w: (zlib.crc32(w), w))[:WORDS], sorted(pieces, key=lambda p: (zlib.crc32(p), p))[:PIECES]


def train(texts: list[str | None], toxic: list[int], content: int = 12_288, extra: int = 8192) -> Dictionaries:
    return train_on([(*digest(t), y) for t, y in zip(texts, toxic)], content, extra)


def train_on(digests: list[tuple[int, list[bytes], list[bytes], int]], content: int = 12_288, extra: int = 8192) -> Dictionaries:
    """The two dictionaries. Fragments are the spans of a toxic document's words that are covered by byte sequences
    which far more toxic than ordinary documents hold."""
    seen: set[int] = set()
    counts, totals, docs = (Counter(), Counter()), [0, 0], []
    ordinary: list[bytes] = []
    for key, words, pieces, label in digests:
        if key in seen:
            continue
        seen.add(key)
        distinct = set(words)
        counts[label].update(_grams(distinct))
        totals[label] += 1
        if label:
            docs.append(distinct)
        else:
            ordinary += pieces[: SAMPLES - len(ordinary)]
    least = max(6, 0.008 * totals[1])
    telling = {g for g, n in counts[1].items() if n >= least and n * (totals[0] + 1) > 8 * totals[1] * (counts[0][g] + 0.5)}
    fragments: Counter = Counter()
    for distinct in docs:
        for word in distinct:
            p = b" " + word + b" "
            at = [i for i in range(max(1, len(p) - GRAM + 1)) if p[i : i + GRAM] in telling]
            if at:
                fragments[p[at[0] : at[-1] + GRAM]] += 1
    try:
        base = zstandard.train_dictionary(content, ordinary, k=32, d=6).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: they are the dictionary
        base = b"".join(ordinary)[-content:] or b" " * CARRIER
    return Dictionaries(base, base + b"".join(f for f, _ in sorted(fragments.items(), key=lambda x: (x[1], x[0])))[-extra:])


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 5, per_class: int = 4000) -> tuple[Dictionaries, tuple[list[float], list[float]]]:
    """Dictionaries and calibration from labelled rows whose crc32 remainder is not 0."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(_chosen(labels, modulus, per_class)), "doc_id").select("doc_id", "text", "toxic")
    aside = F.crc32(F.concat(F.lit("calibrate "), F.col("doc_id").cast("string")).cast("binary")) % 3 == 0

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(zip(*map(digest, batch.column(1).to_pylist()))) or [()] * 3
            kinds = (pa.int64(), pa.list_(pa.binary()), pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(found, kinds)), batch.column(2)], names=["doc_id", "key", "words", "pieces", "toxic"])

    found = rows.where(~aside).mapInArrow(digests, "doc_id bigint, key bigint, words array<binary>, pieces array<binary>, toxic int").toArrow()
    order = sorted(range(found.num_rows), key=lambda i: (zlib.crc32(str(found["doc_id"][i].as_py()).encode()), found["doc_id"][i].as_py()))
    dictionaries = train_on([tuple(found[c][i].as_py() for c in ("key", "words", "pieces", "toxic")) for i in order])
    del found

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distances = Distances(dictionaries)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(distances.of(batch.column(1).to_pylist()), pa.float64())], names=["toxic", "distance"])

    rated = rows.where(aside).mapInArrow(measured, "toxic int, distance double").collect()
    return dictionaries, calibration.isotonic(np.array([r.distance for r in rated], float), np.array([r.toxic for r in rated], int))


def _chosen(labels: DataFrame, modulus: int, per_class: int) -> DataFrame:
    """At most 3 * per_class ids with their label, in the order of a hash; a first cut by another hash keeps the sort small."""
    marked = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic IN (0, 1)")
    marked = marked.where(crc_remainder(F.col("doc_id"), modulus) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r.toxic: r.n for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    taken = []
    for label, most in ((0, 2 * per_class), (1, per_class)):
        share = min(1.0, 2 * most / max(1, sizes.get(label, 0)))
        near = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1
        taken.append(marked.where((F.col("toxic") == label) & near).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    return taken[0].unionByName(taken[1])


def score(docs: DataFrame, labels: DataFrame, modulus: int = 5, per_class: int = 4000) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    dictionaries, knots = fit(docs, labels, modulus, per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distances = Distances(dictionaries)
        for batch in batches:
            found = []
            for k in range(0, batch.num_rows, 500):
                found += distances.of(batch.column(1).slice(k, 500).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(calibration.apply(knots, np.array(found, float)))], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, score double")
    held_out = F.coalesce(crc_remainder(F.col("doc_id"), modulus) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
