"""Word kernels, codecs, digests, the packing plan and the salvage reader against plain versions."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from nearfold.llm import anchors, blobs, digest, packing, pfor, pieces, warc, words

TEXTS = ["", "a b  c\n d", " \t\n", "é ü\x0bx\x0cy\rz", "word" * 50, "a b c", "one two three four five six one two three four five six", "x" * 3000, None]


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@given(st.lists(st.text(alphabet="ab \n\té　", max_size=40) | st.none(), max_size=8))
@settings(max_examples=60, deadline=None)
def test_words(texts):
    got = [[] for _ in texts]
    seen = {}
    for t in words.text_slices(pa.array(texts, pa.string()), 30):
        w = words.find_words(t)
        h = words.hash_words(t, w)
        for i in range(len(t)):
            for k in range(w.bound[i], w.bound[i + 1]):
                x = t.buf[w.start[k] : w.end[k]].tobytes().decode()
                got[t.first + i].append(x)
                assert seen.setdefault(x, h[k]) == h[k]
    assert got == [split(t) for t in texts]
    assert len(set(seen.values())) == len(seen)


def test_long_word(monkeypatch):
    monkeypatch.setattr(words, "_LONG", 16)
    texts = ["short " + "w" * 100 + " tail", "w" * 100, "w" * 99 + "v"]
    by = {}
    for t in words.text_slices(pa.array(texts)):
        w = words.find_words(t)
        for a, b, h in zip(w.start, w.end, words.hash_words(t, w)):
            by.setdefault(t.buf[a:b].tobytes(), set()).add(int(h))
    assert all(len(v) == 1 for v in by.values()) and len(set.union(*by.values())) == len(by) == 4


def mirrored(n):
    """Words of two letters that cancel out in every polynomial modulo a power of two: each is the other's complement."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [8, 64, 256, 512, 1024, 2048, 1 << 16])
def test_mirrored_words(n):
    pair = mirrored(n)
    for t in words.text_slices(pa.array([" ".join(pair)])):
        w = words.find_words(t)
        for seed in (0, 1):
            h = words.hash_words(t, w, seed)
            assert h[0] != h[1]


def test_mirrored_windows():
    """The same two words in mirrored order, in windows of 32 and 50."""
    for k in (32, 50):
        a, b = mirrored(64)
        texts = [" ".join(a[:k]), " ".join(b[:k])]
        for t in words.text_slices(pa.array(texts)):
            w = words.find_words(t)
            h, _ = words.long_grams(words.hash_words(t, w), w, k)
            assert len(h) == 2 and h[0] != h[1]


@pytest.mark.parametrize("n", [64, 1024, 2048])
@pytest.mark.parametrize(("name", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_mirrored_ids(name, spaced, n):
    texts = ["x " + t for t in mirrored(n)] * 2
    e = pieces.TextEncoder(name, spaced)
    for first, ids, bound in e(pa.array(texts)):
        for i in range(len(bound) - 1):
            assert ids[bound[i] : bound[i + 1]].tolist() == e.tokenizer.encode(texts[first + i], add_special_tokens=False).ids


def test_pieces_with_one_hash(monkeypatch):
    """Where the first hash can't tell pieces apart, the second one does."""
    real = words.hash_words
    monkeypatch.setattr(pieces, "hash_words", lambda t, w, seed=0: real(t, w, seed) if seed else real(t, w) & np.uint64(3))
    e = pieces.TextEncoder("byte_bpe_50k.json", True, most=50)
    texts = ["one two three four five six seven one two", "eight nine ten one eleven", "two two two twelve"]
    for _ in range(3):
        for first, ids, bound in e(pa.array(texts)):
            for i in range(len(bound) - 1):
                assert ids[bound[i] : bound[i + 1]].tolist() == e.tokenizer.encode(texts[first + i], add_special_tokens=False).ids


@pytest.mark.parametrize("k", [2, 5, 25, 50])
def test_grams(k):
    rng = random.Random(k)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(80))) for _ in range(30)]
    for f in (words.grams, words.long_grams):
        seen = {}
        for t in words.text_slices(pa.array(texts), 200):
            w = words.find_words(t)
            s, at = f(words.hash_words(t, w), w, k)
            want = [(i, j) for i in range(len(t)) for j in range(max(0, len(split(texts[t.first + i])) - k + 1))]
            assert len(s) == len(want)
            for (i, j), h in zip(want, s.tolist()):
                x = tuple(split(texts[t.first + i])[j : j + k])
                assert seen.setdefault(x, h) == h
        assert len(set(seen.values())) == len(seen)


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=400))
@settings(max_examples=60, deadline=None)
def test_pfor(ids):
    x = np.array(ids, "<u4")
    image = pfor.write_image(np.array([5, -1]), np.array([False, True]), np.array([len(x), 0]), x)
    docs, nulls, counts, got = pfor.read_image(image)
    assert got.tolist() == ids and docs.tolist() == [5, -1] and nulls.tolist() == [0, 1] and counts.tolist() == [len(ids), 0]
    for lo, hi in ((0, len(ids)), (3, 200), (127, 129), (300, 10_000)):
        assert pfor.read_span(image, lo, hi).tolist() == ids[lo:hi]


def test_pfor_is_small():
    x = (np.random.default_rng(1).zipf(1.3, 50_000) % 50_000).astype("<u4")
    assert len(pfor.write_image(np.zeros(1, np.int64), np.zeros(1, bool), np.array([len(x)]), x)) < 3 * len(x)
    with pytest.raises(ValueError):
        pfor.read_image(b"nope" * 20)


@given(st.lists(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 9)), max_size=200), st.integers(0, 4))
@settings(max_examples=60, deadline=None)
def test_blobs(items, bits):
    h = np.array([a for a, _ in items], np.uint64)
    key = np.sort(blobs.packed(h, np.array([b for _, b in items], np.int64)))
    h50, place = blobs.unpacked(key)
    edges = blobs.cut_ranges(h50, bits)
    back = []
    for p in range(1 << bits):
        a, b = edges[p], edges[p + 1]
        if a < b:
            steps, places, _ = blobs.encode(h50[a:b], place[a:b], bits, p)
            x, y = blobs.decode(steps, places, bits, p)
            back += list(zip(x.tolist(), y.tolist()))
    assert back == list(zip(h50.tolist(), place.tolist()))


ODD = ["a  b", "a \n b", "a   b ", "x <|endoftext|> y", "  a", "a ", "\n\n", "", "́x ý ́z", "İstanbul ΟΔΟΣ, it's 'll don't' x'", "a b", "a b", "q\x1c \x1cb 1.2.3 ,,, (a).", "one.Two,three;;", "a.̸b", "Ünï—.x", None]


@pytest.mark.parametrize(("name", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder(name, spaced):
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice("ab.,! \n\t'sé1中　") for _ in range(rng.randrange(40))) for _ in range(400)]
    e = pieces.TextEncoder(name, spaced, most=300)
    for _ in range(2):
        for first, ids, bound in e(pa.array(texts, pa.string())):
            for i in range(len(bound) - 1):
                want = e.tokenizer.encode(texts[first + i] or "", add_special_tokens=False).ids
                assert ids[bound[i] : bound[i + 1]].tolist() == want, texts[first + i]
    ids, bound = pieces.with_end(np.array([1, 2, 3]), np.array([0, 2, 2, 3]), 9)
    assert ids.tolist() == [1, 2, 9, 9, 3, 9] and bound.tolist() == [0, 3, 4, 6]


def test_cut():
    assert packing.cut(5, 8) == [(0, 5)] and packing.cut(8, 8) == [(0, 8)]
    assert packing.cut(9, 8) == [(0, 1), (1, 8)] and packing.cut(16, 8) == [(0, 8), (8, 8)]


@pytest.mark.parametrize("seed", range(6))
def test_plan(seed):
    rng = np.random.default_rng(seed)
    capacity = [16, 64, 2048][seed % 3]
    n = rng.integers(1, capacity + 1, rng.integers(1, 3000))
    lengths, counts = np.unique(n, return_counts=True)
    runs, sequences = packing.plan(lengths, counts, capacity)
    used = np.zeros((sequences, capacity), np.int8)
    ranks = {}
    for length, a, b, first, offset in runs.tolist():
        ranks.setdefault(length, []).append((a, b))
        for k in range(b - a):
            used[first + k, offset : offset + length] += 1
    assert used.max() == 1
    for x, c in zip(lengths.tolist(), counts.tolist()):
        spans = sorted(ranks[x])
        assert spans[0][0] == 0 and spans[-1][1] == c and all(p[1] == q[0] for p, q in zip(spans, spans[1:]))
    filled = used.sum(axis=1)
    assert all(used[i, : filled[i]].all() for i in range(sequences))  # no gaps
    bins = []
    for x in sorted(n.tolist(), reverse=True):  # plain best fit, longest first
        fits = [i for i, r in enumerate(bins) if r >= x]
        if fits:
            bins[min(fits, key=lambda i: bins[i])] -= x
        else:
            bins.append(capacity - x)
    assert sequences <= len(bins) * 1.02 + 3


def test_configuration():
    value, made = packing.best_configuration(np.array([7, 5, 3]), np.array([0.7, 0.5, 0.3]), 15)
    assert value == pytest.approx(1.5) and made @ np.array([7, 5, 3]) == 15


def test_digest():
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(400)).encode() for _ in range(6)]
    ranks = digest.ranks_of(digest.count_entropies(texts))
    d = digest.digests(texts, ranks)
    assert [digest.to_text(x) for x in d] == [digest.to_text(digest.digests([t], ranks)[0]) for t in texts]
    edited = texts[0][: len(texts[0]) * 3 // 4] + texts[1][:600]
    assert digest.likeness(d[0], digest.digests([edited], ranks)[0]) > 0.4
    assert all(digest.likeness(d[0], x) < 0.05 for x in d[1:]) and digest.likeness(d[0], d[0]) == 1
    back = digest.from_text(digest.to_text(d[0]))
    assert digest.likeness(back, d[0]) == 1 and digest.from_text("")[1].shape[0] == 0
    none, short = digest.digests([b"", b"x"], ranks)
    assert digest.likeness(none, none) == 1 and digest.likeness(none, short) == 0 and digest.to_text(none) == ""
    long = digest.digests([b" ".join(texts) * 40], ranks)[0]
    assert len(long[0]) > 1 and 0 <= digest.likeness(long, d[0]) <= 1 and digest.likeness(long, d[0]) == digest.likeness(d[0], long)


def plain_features(text, counts):
    """The places of a text's features, window by window."""
    n = len(text) - digest.SIZE + 1
    if n < 1:
        return []
    entropy = digest._entropies(np.frombuffer(text, np.uint8)).tolist()
    order = sorted(range(1001), key=lambda e: (counts[e], e))
    rank = {e: k for k, e in enumerate(order)}
    points = [0] * n
    for last in range(n + digest.STRETCH - 1):
        stretch = [i for i in range(max(0, last - digest.STRETCH + 1), min(n, last + 1)) if entropy[i] >= 100]
        if stretch:
            points[min(stretch, key=lambda i: (rank[entropy[i]], i))] += 1
    return [i for i in range(n) if points[i] >= digest.POINTS]


@pytest.mark.parametrize("part", [64, 1000, 1 << 18])
def test_digest_features(monkeypatch, part):
    """Whatever the parts that a long text is cut into, its features are those of the definition."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghij kl,.") for _ in range(rng.randrange(2, 12))) for _ in range(60)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(n)).encode() for n in (0, 3, 30, 400)] + [b"a" * 500, b"x" * 40 + b" ".join(w.encode() for w in vocabulary) + b"y" * 90]
    monkeypatch.setattr(digest, "_PART", part)
    counts = digest.count_entropies(texts)
    plain = Counter()
    for t in texts:
        if len(t) >= digest.SIZE:
            plain.update(digest._entropies(np.frombuffer(t, np.uint8)).tolist())
    assert {e: n for e, n in enumerate(counts.tolist()) if n} == plain
    ranks = digest.ranks_of(counts)
    for t, d in zip(texts, digest.digests(texts, ranks)):
        places = plain_features(t, counts)
        buf = np.frombuffer(t, np.uint8)
        h = digest._hashed(buf, np.array(places, np.int64)) if places else np.array([words.hash_bytes(t)] if t else [], np.uint64)
        filters = [h[k : k + digest.MOST] for k in range(0, len(h), digest.MOST)]
        assert d[0].tolist() == [len(f) for f in filters]
        for got, f in zip(d[1], filters):
            bits = np.zeros(digest.BITS, bool)
            for j in range(digest.PER_FEATURE):
                bits[((f >> np.uint64(11 * j)) & np.uint64(digest.BITS - 1)).astype(int)] = True
            assert np.unpackbits(got).astype(bool).tolist() == bits.tolist()


def test_entropy():
    import math
    from collections import Counter

    raw = bytes(random.Random(3).choices(b"abcdeeeee  f\n", k=300))
    got = digest._entropies(np.frombuffer(raw, np.uint8))
    for s in range(len(raw) - digest.SIZE + 1):
        c = Counter(raw[s : s + digest.SIZE])
        h = -sum(v / digest.SIZE * math.log2(v / digest.SIZE) for v in c.values())
        assert abs(got[s] - 1000 * h / math.log2(digest.SIZE)) <= 1.001


def records(n=6):
    out = []
    for i in range(n):
        body = (f"payload {i} WARC/1.1\r\n" * (i + 1)).encode()
        import hashlib

        head = {"WARC-Type": "response", "WARC-Record-ID": f"<urn:page:{i}>", "WARC-Payload-Digest": "sha256:" + hashlib.sha256(body).hexdigest()}
        out.append((head, body))
    return out


def read(data):
    got = list(warc.read_archive(data))
    return [x.headers["warc-record-id"] for x in got if isinstance(x, warc.Record)], [(x.start, x.end) for x in got if isinstance(x, warc.Gap)]


def ids(*n):
    return [f"<urn:page:{i}>" for i in n]


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    parts = [warc.format_record(h, b) for h, b in records()]
    parts = [warc.member(p) for p in parts] if packed else parts
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).tolist()
    whole = b"".join(parts)
    assert read(whole) == (ids(*range(6)), [])
    assert read(b"") == ([], [])
    flipped = bytearray(whole)
    flipped[at[2] + len(parts[2]) // 2] ^= 0xFF
    got, gaps = read(bytes(flipped))
    assert got == ids(0, 1, 3, 4, 5) and gaps[0][0] == at[2] and gaps[-1][1] == at[3]
    junk = whole[: at[1]] + b"junk \x1f\x8b\x08 WARC/1.1\r\n" + whole[at[1] :]
    got, gaps = read(junk)
    assert got == ids(*range(6)) and gaps and gaps[0][0] == at[1]
    got, gaps = read(whole[: at[5] + len(parts[5]) // 2])
    assert got == ids(0, 1, 2, 3, 4) and gaps[-1][1] == at[5] + len(parts[5]) // 2
    got, gaps = read(whole[: at[3] + 20] + whole[at[4] :])
    assert got == ids(0, 1, 2, 4, 5) and (gaps or not packed)
    both = whole[: at[2]] + warc.format_record(*records()[2]) + whole[at[3] :] if packed else whole
    assert read(both)[0] == ids(*range(6))


@pytest.mark.parametrize("cut_off", [True, False])
def test_salvage_within_a_member(cut_off):
    """An archive packed as one stream gives the records before the damage, and the gap begins after them."""
    rng = random.Random(7)
    noise = [({"WARC-Type": "response", "WARC-Record-ID": f"<urn:page:{i}>"}, rng.randbytes(30_000)) for i in range(12)]
    plain = [warc.format_record(h, b) for h, b in noise]
    whole = warc.member(b"".join(plain))
    at = len(whole) * 2 // 3
    data = whole[:at] if cut_off else whole[:at] + bytes(16) + whole[at + 16 :]
    tail = warc.member(warc.format_record(*records()[0]))
    got, gaps = read(data + tail if not cut_off else data)
    assert got[: 7] == [i for i in ids(*range(7))] or [x for x in got if x in ids(*range(12))][:7] == ids(*range(7))
    assert gaps and gaps[0][0] > len(whole) // 2 and gaps[-1][1] == len(data)


def test_digest_check():
    h, b = records(1)[0]
    bad = warc.format_record(h, b).replace(b"payload 0", b"payload 9")
    assert read(bad)[0] == [] and read(warc.member(bad))[0] == []
    with pytest.raises(ValueError):
        warc.parse_record(b"WARC/1.1\r\nContent-Length: x\r\n\r\n")
    assert zlib.crc32(b"") == 0


def test_runs_of_windows():
    doc = np.array([0] * 9000 + [1, 1, 1, 2])
    place = np.concatenate([np.arange(9000) + 7, [5, 3, 4, 0]])
    marks = np.array([5, (1 << 24) - 1, 0], np.uint64)
    shuffled = np.random.default_rng(1).permutation(len(doc))
    who, items = anchors._runs(doc[shuffled], place[shuffled], marks)
    assert who.tolist() == [0, 0, 0, 1, 2]
    back = []
    for w, x in zip(who.tolist(), items.tolist()):
        assert x >> 40 == marks[w]
        back += [(w, (x & ((1 << 28) - 1)) + k) for k in range(x >> 28 & 4095)]
    assert back == sorted(zip(doc.tolist(), place.tolist()))
    none = anchors._runs(np.zeros(0, np.int64), np.zeros(0, np.int64), marks)
    assert len(none[0]) == len(none[1]) == 0
