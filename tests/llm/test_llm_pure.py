"""Operators without Spark, against plain versions."""

import io
import random
import zlib

import numpy as np
import pytest
import xxhash

from tessera.llm import calibration, html, packing, passages, simhash, toxicity, topk, warc
from tessera.llm.eliasfano import EliasFano, map_arrays, write_arrays


@pytest.mark.parametrize(("n", "top"), [(1, 5), (10, 10), (1000, 100), (5000, 10**9), (300, 2**40)])
def test_elias_fano(n, top, tmp_path):
    r = np.random.default_rng(n)
    values = np.sort(r.integers(0, top, n))
    uri = f"file://{tmp_path}/a"
    write_arrays(uri, EliasFano.encode(values).arrays("x") | {"y": np.arange(3, dtype=np.uint16)})
    arrays = map_arrays(uri)
    e = EliasFano.decode(arrays, "x")
    assert (e.at(np.arange(n)) == values).all() and arrays["y"].tolist() == [0, 1, 2]
    target = r.integers(0, top + 2, 200)
    assert (e.successor(np.zeros(200, np.int64), np.full(200, n), target) == np.searchsorted(values, target)).all()
    assert EliasFano.encode(np.zeros(0)).at(np.zeros(0, np.int64)).tolist() == []


@pytest.mark.parametrize("text", ["", "one", "one two", "A b C d a b c", "é É ß " * 300, " \t\n"])
def test_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).split()
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    expected = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(simhash.plain_words(text)) == expected


def test_packing_is_gapless_and_near_the_bound():
    r = random.Random(1)
    items = [(i, max(1, min(64, int(r.lognormvariate(2.5, 1))))) for i in range(3000)]
    bins = list(packing.pack_stream(iter(items), 64, 32))
    assert sorted(i for b in bins for i in b) == items and all(sum(i[-1] for i in b) <= 64 for b in bins)
    assert len(bins) <= 1.02 * sum(i[1] for i in items) / 64 + 1


def test_isotonic():
    xs, ys = calibration.isotonic(np.array([1, 2, 3, 4, 5.0]), np.array([0, 1, 0, 1, 1]))
    assert ys == sorted(ys) and calibration.apply((xs, ys), np.array([0, 2.5, 9])).tolist() == [0.0, 0.5, 1.0]
    assert calibration.isotonic(np.zeros(0), np.zeros(0)) == ([0.0], [0.0])


def test_toxicity_on_words():
    r = random.Random(2)
    syllables = ["tion", "and", "er", "in", "th", "ea", "on", "re", "st", "ly"]
    texts = [" ".join("".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(80)) for _ in range(400)]
    labels = [int(k % 5 == 0) for k in range(400)]
    for k in range(0, 400, 5):
        texts[k] += " " + r.choice(["vilewretch", "badfool", "horridlout"])
    d = toxicity.train(texts[:300], labels[:300])
    found = toxicity.Distances(d).of(texts[300:] + [None, "", " \n"])
    assert min(f for f, y in zip(found, labels[300:]) if y) > max(f for f, y in zip(found, labels[300:]) if not y)
    assert found[-3:] == [0.0] * 3


def test_kd_tree():
    r = np.random.default_rng(3)
    x = r.integers(-9, 9, (400, 5))
    x[100:250] = x[0]  # many copies of one vector
    ids = r.permutation(1000)[:400]
    tree = topk.KDTree(x, ids, leaf=8)
    for j in range(0, 400, 40):
        q = x[j].astype(float)
        found = sorted(tree.search(q, int(ids[j]), 5, tree.bounds(q[None])[0], topk.LOW), reverse=True)
        expected = sorted(((float(x[i] @ x[j]), -int(ids[i])) for i in range(400) if i != j), reverse=True)[:5]
        assert found == expected


def test_minimum_cut_is_minimal():
    r = random.Random(4)
    for _ in range(40):
        n = r.randint(1, 7)
        terminals = [(r.randint(0, 9), r.randint(0, 9)) for _ in range(n)]
        edges = [(a, b, r.randint(0, 5)) for a in range(n) for b in range(a + 1, n) if r.random() < 0.5]

        def cost(sides):
            return sum(b if s else a for s, (a, b) in zip(sides, terminals)) + sum(c for a, b, c in edges if sides[a] != sides[b])

        assert cost(html.minimum_cut(terminals, edges)) == min(cost([m >> k & 1 for k in range(n)]) for m in range(2**n))


def test_main_text():
    page = (
        "<html><head><title>T</title><script>x='</p>'</script></head><body><header><a href=/>Home</a></header><nav><ul><li><a href=a>Menu</a></ul></nav><div class='cookie-notice'>We use cookies, many of them, to help.</div>"
        "<article><h1>Head &amp; line</h1><p>First <b>bold</b>word,\n and more&nbsp;text.<br>Next<p>Short.<aside class=sidebar><p>Related stuff to read here today.</p></aside><form><input><p>Your mail</p></form></article>"
        "<div id='comments'><p>I disagree with this article, strongly.</p></div><footer>&copy; Somebody 2020.</footer>"
    )
    assert html.main_text(page) == "Head & line\nFirst boldword, and more text. Next\nShort."
    assert html.main_text(None) == html.main_text("") == html.main_text("<p>") == ""


def _member(k, size):
    body = bytes(random.Random(k).choices(range(256), k=size))
    record = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:{k}>\r\nContent-Length: {size}\r\n\r\n".encode() + body + b"\r\n\r\n"
    coder = zlib.compressobj(6, zlib.DEFLATED, 31)
    return coder.compress(record) + coder.flush(), body


def test_main_text_of_unclosed_elements():
    body = "<p>" + "An article's long sentence, which is kept. " * 5 + "</p>"
    kept = html.main_text(f"<body>{body}</body>")
    assert kept.startswith("An article")
    for page in (
        f"<html><head><title>x</title><body>{body}", f"<head><meta a=b><script>var x = '<p>';</script>{body}", f"<svg/>{body}", f'<math a="b"/>{body}',
        f"<noscript>{body}", f"<select>{body}", f"<button>{body}<button>b</button>", f"<object>{body}", f"<head><title>x</title></head>{body}",
    ):
        assert html.main_text(page) == kept, page


def test_long_headers_are_found():
    r = random.Random(5)
    urls = ["http://a/" + "".join(map(chr, (r.randrange(0x4E00, 0x9FA5) for _ in range(n)))) for n in (10, 3000, 60_000)]
    for url in urls:
        data = b"".join(warc._record(k, url, b"<p>x", "d", None, 4) for k in range(3))
        assert [f["warc-record-id"] for _, f, _ in warc.scan_range(io.BytesIO(data), len(data), 0, len(data))] == [f"<urn:x-page:{k}>" for k in range(3)]


def test_ranges_own_each_record_once():
    members = [_member(k, 40 + 700 * (k % 4)) for k in range(40)]
    # raw gzip magic inside stored data must not be taken for a record
    fake = zlib.compressobj(0, zlib.DEFLATED, 31)
    text = b"WARC/1.1\r\nWARC-Type: x\r\nWARC-Record-ID: <urn:x-page:99>\r\nContent-Length: 40\r\n\r\n" + (warc.MAGIC + b"abcdefg") * 4 + b"\r\n\r\n"
    data = b"".join(m for m, _ in members) + fake.compress(text) + fake.flush()
    for step in (100, 333, 5000, len(data)):
        found = [(at, f, b) for s in range(0, len(data), step) for at, f, b in warc.scan_range(io.BytesIO(data), len(data), s, min(len(data), s + step), chunk=512, probe=256)]
        assert [b for _, _, b in found[:-1]] == [b for _, b in members] and len(found) == 41


def test_chain_and_alignment():
    r = random.Random(5)
    a = [r.randrange(10**6) for _ in range(200)]
    b = a[20:170]
    b[40] = -1
    del b[80]
    x, y = np.array(a, np.uint32), np.array([v % 2**32 for v in b], np.uint32)
    found = passages.align(x, y, [30, 120], [10, 99], 5)
    assert found == (20, 170, 0, 149, 148)
    assert passages.chain([0, 10, 20, 5], [0, 10, 20, 100])[0] == [0, 1, 2]
    assert passages.cut_words("a b\nc  d e", [(1, 3)]) == "a  d e" and passages.cut_words(" a b", [(0, 2)]) == ""
