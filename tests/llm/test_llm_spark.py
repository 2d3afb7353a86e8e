"""Operators as Spark jobs, against brute force on small tables with awkward rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import contain, html, lm, packing, passages, quality, simhash, topk, toxicity, warc
from tessera.llm.catalogue import tokenizer_path
from tessera.llm.common import shared_folder
from tessera.llm.components import _round, components
from tessera.llm.simhash import fingerprint, plain_words

DOCS = "doc_id long, text string, lang string, source string, n_chars long, hash string, fp int"


def documents(spark, texts, start=0):
    """With extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1) for i, t in enumerate(texts, start)], DOCS)


def words(r, n):
    return [f"w{r.randrange(5000)}" for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(7)
    out = [" ".join(words(r, r.randint(1, 120))) for _ in range(60)]
    base = words(r, 400)
    for k in range(30):  # near copies of one text, more than the bound on keys below
        w = list(base)
        w[r.randrange(400)] = f"e{k}"
        out.append(" ".join(w))
    return out + [out[0], out[0], None, "", " \n\t", "one", "One", " ".join(words(r, 30_000))]


def test_simhash(spark, texts):
    rows = documents(spark, texts).unionByName(documents(spark, [None], 5).withColumn("doc_id", F.lit(None).cast("long")))
    f = [fingerprint(plain_words(t)) for t in texts]
    parent = list(range(len(f)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(f)):
        for j in range(i):
            if (f[i] ^ f[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    for most in (2, 64):
        found = {r.doc_id: r for r in simhash.near_duplicates(rows, most=most).collect()}
        assert len(found) == len(texts) + 1 and found[None].component_id is None
        assert all(found[i].fingerprint == f"{f[i]:016x}" and found[i].component_id == find(i) for i in range(len(f)))


@pytest.mark.parametrize("few", [0, 10**6])
def test_components(spark, few):
    r = random.Random(8)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 2000), (7, 7)] + [(3000 + r.randrange(40), 3000 + r.randrange(40)) for _ in range(30)]
    parent = {x: x for e in edges for x in e}
    for a, b in edges * 100:
        parent[a] = parent[b] = min(parent[a], parent[b])
    expected = {x: p for x, p in parent.items() if x != p}
    df = spark.createDataFrame(edges, "u long, v long").repartition(5)
    assert {r.node: r.root for r in components(df, few).collect()} == expected
    assert _round(spark.createDataFrame([(2, 1), (3, 2)], "u long, v long")).count() > 0
    assert components(df.limit(0), few).count() == 0


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    found = packing.pack_documents(documents(spark, texts), tokenizer_path(), packer_tokens=20_000).collect()
    by_doc, by_sequence = {}, {}
    for r in found:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, t in enumerate(texts):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.start for r in pieces] == list(range(0, len(ids), 4096)) and sum(r.length for r in pieces) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in pieces)
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert packing.pack_documents(documents(spark, texts).limit(0), tokenizer_path()).count() == 0


def test_scores(spark):
    r = random.Random(9)
    texts, labels = [], []
    for k in range(300):
        bad, rude = k % 3 == 0, k % 4 == 0
        w = words(r, 60)
        texts.append(" ".join((["spam"] * 40 if bad else w) + w[:20] + (["vilewretch", "horridlout"] if rude else [])))
        labels.append((k, int(not bad), int(rude)))
    docs = documents(spark, [*texts, None, "", " "])
    marks = spark.createDataFrame([*labels, (299, None, None)], "doc_id long, quality int, toxic int")
    for module, column, modulus, held in ((quality, 1, 3, 1), (toxicity, 2, 5, 0)):
        found = {x.doc_id: x for x in module.score(docs, marks).collect()}
        assert len(found) == 303 and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in found.values())
        assert all(x.held_out == (zlib.crc32(str(i).encode()) % modulus == held) for i, x in found.items())
        aside = [i for i in range(300) if found[i].held_out]
        assert sum(found[i].predicted == labels[i][column] for i in aside) >= 0.95 * len(aside)
        assert module.score(docs, marks.limit(0)).agg(F.max("score")).first()[0] == 0
        assert module.score(docs.limit(0), marks).count() == 0


def test_warc(spark):
    big = "é" * 600
    rows = [(1, "http://a/é b", big), (2, None, big), (3, "http://c\r\nX: y", "small"), (4, "http://d", "small"), (5, "u", None), (6, "u", big + "<p>"), (7, "u", ""), (None, "u", big), (2, "v", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    import hashlib

    found = sorted(warc.archive_pages(pages, split_bytes=150).collect(), key=str)
    assert len(found) == len(rows)
    for (page, _, text), r in [(x, next(f for f in found if f.page_id == x[0])) for x in rows]:
        data = (text or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 2) if page == 1 else ("response", None))
        assert r.payload == (None if page == 1 else data)
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_warc_counts_records(spark):
    folder = shared_folder(spark, "warc-test")
    pages = spark.createDataFrame([(k, "u", f"page {k}") for k in range(5)], "page_id long, url string, html string")
    manifest = warc.write_archives(warc.plan_records(pages), folder)
    assert warc.read_archives(manifest, folder).count() == 5
    with pytest.raises(ValueError, match="records of"):
        warc.read_archives(manifest.withColumn("records", F.col("records") + 1), folder)


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>Hello there, world.</article>"), (2, None, None), (2, None, "")], "page_id long, url string, html string")
    assert sorted(tuple(r) for r in html.extract(pages).select("page_id", "text", "n_chars").collect()) == [(1, "Hello there, world.", 19), (2, "", 0), (2, "", 0)]


def test_top_k(spark):
    r = random.Random(10)
    rows = [(i, [r.uniform(-1, 1) for _ in range(6)]) for i in range(300)] + [(i, [0.5] * 6) for i in range(300, 420)]
    rows += [(500, None), (501, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (502, [float("nan")] * 6), (550, [1.0, 2.0]), (551, [1.0, 1.0]), (None, [1.0] * 6), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    good = {}
    for i, e in rows:
        if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            good[i] = [math.floor(256 * float(np.float32(x))) for x in e]
    for shard in (50, 10_000):
        found = sorted((x.query_id, x.rank, x.vec_id, x.score) for x in topk.top_k(df, shard_rows=shard, block_rows=4, leaf=8).collect())
        expected = []
        for q in sorted(i for i in good if i % 50 == 0):
            best = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q and len(v) == len(good[q]))[:5]
            expected += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
        assert found == expected
    assert topk.top_k(df.limit(0)).count() == 0


def test_language_model(spark, texts):
    found = {r.doc_id: r for r in lm.score(documents(spark, texts), shard_tokens=3000).collect()}
    tokens = {i: [*(t or "").lower().split(), "\n"] for i, t in enumerate(texts)}
    train = [t for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for t in train for w in t)
    pairs = Counter(p for t in train for p in zip(["\n", *t], t))
    n, v = sum(c.values()), len(c)
    once = sum(x == 1 for x in c.values())
    unknown = (once + 1) / (n + 2)
    share = lambda w: (1 - unknown) * c[w] / n if c[w] else unknown
    kind = lambda h: min(math.frexp(c[h])[1], lm.CLASSES - 1)
    likely = np.zeros((lm.CLASSES, len(lm.GRID)))
    for (h, w), m in pairs.items():
        likely[kind(h)] += m * np.log((1 - lm.GRID) * (m - 1) / max(1, c[h] - 1) + lm.GRID * share(w))
    mix = lm.GRID[np.where(likely.any(axis=1), likely.argmax(axis=1), len(lm.GRID) - 1)]
    for i, t in tokens.items():
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)
        full = sum(math.log10((1 - mix[kind(h)]) * pairs[h, w] / c[h] + mix[kind(h)] * share(w)) if c[h] else math.log10(share(w)) for h, w in zip(["\n", *t], t))
        r = found[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(w in c for w in t), n)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(full, abs=len(t) / lm.STEP)
    empty = lm.score(documents(spark, [None, "a b"]).where("doc_id < 0"))
    assert empty.count() == 0


def test_containment(spark):
    r = random.Random(11)
    items = [words(r, n) for n in (3, 5, 12, 30, 80, 200)]
    docs = [words(r, 150) for _ in range(20)] + [items[0], items[0][:2]]
    docs[1][20:20] = items[3]
    docs[2][5:5] = items[4][:70]
    docs[3][5:5] = items[4][:60]
    docs[4] = docs[4] * 50 + items[5] + items[2]
    edited = list(items[5])
    for k in (50, 120, 160):
        edited[k] = "edit"
    docs[5][0:0] = edited
    rows = [(i, " ".join(w)) for i, w in enumerate(docs)] + [(900, None), (901, ""), (None, " ".join(items[3]))]
    benchmark = spark.createDataFrame([(i, " ".join(w).upper()) for i, w in enumerate(items)] + [(50, None), (51, "")], "item_id long, text string")

    def shingles(w):
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    expected = {(d, i) for d, w in enumerate(docs) for i, x in enumerate(items) if 100 * len(shingles(w) & shingles(x)) >= 80 * len(shingles(x))}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(x.doc_id, x.item_id) for x in contain.contaminated(df, benchmark).collect()} == expected and (5, 5) in expected
    assert contain.contaminated(df, benchmark.limit(0)).count() == contain.contaminated(df.limit(0), benchmark).count() == 0


def test_passages(spark):
    r = random.Random(12)
    docs = [words(r, 300) for _ in range(30)]
    shared, at = [f"p{k}" for k in range(80)], {}
    for i in (3, 10, 20, 25):
        w = list(shared)
        if i > 3:
            for k in r.sample(range(80), 3):
                w[k] = f"edit{i}"
        at[i] = r.randrange(200)
        docs[i][at[i] : at[i]] = w
    df = documents(spark, [*(" ".join(w) for w in docs), None, "", "a b", "x " * 20_000])
    found = {p.doc_id: p for p in passages.repeated_passages(df).collect()}
    assert set(found) == {10, 20, 25} and all(p.source_id == 3 for p in found.values())
    assert all(abs(p.start - at[i]) <= 5 and abs(p.end - at[i] - 80) <= 5 for i, p in found.items())
    left = {x.doc_id: x for x in passages.without_passages(df, passages.repeated_passages(df)).collect()}
    assert len(left) == 34 and sum("p40" in (x.text or "") for x in left.values()) <= 2 and left[0].text == " ".join(docs[0])
    assert passages.repeated_passages(df.limit(0)).count() == 0


def test_passages_whose_parts_come_first_elsewhere(spark):
    r = random.Random(21)
    parts = [[f"m{r.randrange(10**9)}" for _ in range(45)] for _ in range(4)]
    docs = [words(r, 60) + part + words(r, 60) for part in parts]
    docs += [words(r, 40 + k) + sum(parts, []) + words(r, 50) for k in range(2)]
    found = [p for p in passages.repeated_passages(documents(spark, map(" ".join, docs))).collect() if p.doc_id == 5]
    assert [(p.start, p.end, p.source_id, p.source_start, p.source_end, p.matched) for p in found] == [(41, 221, 4, 40, 220, 180)]


def test_passages_at_the_least_similarity(spark):
    r = random.Random(22)
    docs, want = [], set()
    for k in range(60):
        n = r.choice((50, 55, 80))
        one = [f"m{r.randrange(10**9)}" for _ in range(n)]
        two = list(one)
        # the first words are equal and so are the last, so that the passage has all n words
        edits = range(4, n - 1, 5) if k % 2 else r.sample(range(1, n - 1), n // 5)
        for i in edits:
            two[i] = f"e{r.randrange(10**9)}"
        want.add(2 * k + 1)
        docs += [words(r, 60) + w + words(r, 60) for w in (one, two)]
    rows = passages.repeated_passages(documents(spark, map(" ".join, docs))).collect()
    assert {p.doc_id for p in rows} == want and all(p.source_id == p.doc_id - 1 and p.matched >= 40 for p in rows)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(13)
    texts = [" ".join(words(r, 200)) for _ in range(60)]
    texts[40] = texts[2]
    benchmark = " ".join(words(r, 40))
    texts[41] += " " + benchmark
    for k in range(0, 40, 4):
        texts[k] += " vilewretch horridlout"
    documents(spark, texts).drop("hash", "fp").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, benchmark)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns, name
        ids = {x.doc_id for x in after.select("doc_id").collect()}
        if name == "near_duplicates":
            assert 40 not in ids and 2 in ids
        if name == "benchmark_leaks":
            assert ids == {x.doc_id for x in docs.select("doc_id").collect()} - {41}
        docs = corpus_pipeline.keep(after, name)
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {x.doc_id for x in packed.collect()} == {x.doc_id for x in docs.collect()}


def test_top_k_of_large_components_and_other_columns(spark):
    r = random.Random(23)
    rows = [(i, [r.uniform(-1e6, 1e6) * 10 ** r.randrange(8) for _ in range(4)], 0, 0) for i in range(120)]
    rows += [(i, [3.0, 4.0, 5.0, 6.0], 0, 0) for i in range(120, 300)] + [(400, [], 0, 0), (450, [], 0, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, leaf int, shard int")
    good = {i: [math.floor(256 * x) for x in e] for i, e, _, _ in rows}
    for shard in (40, 10_000):
        found = sorted((x.query_id, x.rank, x.vec_id, x.score) for x in topk.top_k(df, shard_rows=shard, leaf=8).collect())
        expected = []
        for q in sorted(i for i in good if i % 50 == 0):
            best = sorted((-max(topk.LOW, min(topk.HIGH, sum(a * b for a, b in zip(good[q], v)))), i) for i, v in good.items() if i != q and len(v) == len(good[q]))[:5]
            expected += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
        assert found == expected


def test_top_k_skips_leaves_of_clustered_vectors():
    r = np.random.default_rng(24)
    x = np.round(np.concatenate([r.normal(c, 2, (256, 16)) for c in r.normal(0, 200, (16, 16))]))
    tree = topk.KDTree(x, np.arange(len(x)), leaf=64)
    found = {}
    for q, i, s in tree.search_all(x[::50], np.arange(len(x))[::50], 5, np.full(len(x[::50]), topk.LOW)):
        found.setdefault(q, []).append((-s, i))
    for n, q in enumerate(range(0, len(x), 50)):
        assert sorted(found[n]) == sorted((-int(x[q] @ x[i]), i) for i in range(len(x)) if i != q)[:5]
    assert tree.visited < 0.2 * len(x[::50]) * len(tree.leaves)
