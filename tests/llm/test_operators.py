"""The corpus operators against brute force, round trips and awkward inputs."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import common, fingerprints, jpeg, line_dedup, mixing, near_dedup, packing, pii, toxicity, url_filter, warc
from quillon.llm.common import Scratch
from quillon.llm.tokens import word_bpe

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, b string, row string, lines string"


def table(spark, texts, ids=None):
    """Documents with extra columns whose names the operators use inside."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, "x", "y", "z") for i, t in zip(ids, texts)], SCHEMA)


def words(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lam mu nu xi".split()) + str(rng.randrange(40)) for _ in range(n))


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return set(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else ({tuple(w)} if w else set())


def corpus(seed=3):
    rng = random.Random(seed)
    texts = [None, "", "   \n", "One two", "one TWO", "solo"]
    for _ in range(25):
        base = words(rng, rng.randrange(8, 160)).split()
        texts.append(" ".join(base))
        for _ in range(rng.randrange(6)):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = "new" + str(rng.randrange(99))
            texts.append(" ".join(copy))
    return texts + [words(rng, 30_000)]


def brute_components(texts):
    sets, parent = [shingle_set(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in range(len(texts))}


def test_near_duplicates_equal_brute_force(spark):
    texts = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(table(spark, texts)).collect()}
    assert got == brute_components(texts)


@pytest.mark.parametrize("block, part", [(16, 4), (1024, 256)])
def test_hot_cloud_of_near_copies(spark, monkeypatch, block, part):
    monkeypatch.setattr(near_dedup, "BLOCK", block)  # buckets in many blocks and parts, or in one
    monkeypatch.setattr(near_dedup, "PART", part)
    rng = random.Random(5)
    base = words(rng, 120).split()
    texts = []
    for _ in range(150):
        copy = list(base)
        for _ in range(rng.randrange(9)):
            copy[rng.randrange(120)] = "e" + str(rng.randrange(999))
        texts.append(" ".join(copy))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(table(spark, texts)).collect()}
    assert got == brute_components(texts)


def test_near_duplicates_odd_rows(spark):
    a, b = "a b c d e f g h", "p q r s t u v w"
    got = sorted(map(tuple, near_dedup.near_duplicates(table(spark, [a, a, b, a, b, None], [None, 4, 4, 2, 9, 4])).collect()), key=str)
    assert got == sorted([(None, 4, None, True), (4, 4, 2, False), (4, 4, 2, False), (2, 4, 2, True), (9, 4, 2, False), (4, 0, 4, True)], key=str)
    assert near_dedup.near_duplicates(table(spark, [])).count() == 0


def test_recall_at_the_threshold(spark):
    rng = random.Random(21)
    texts = []
    for _ in range(200):  # pairs of 100 shingles that share 86 of 114: resemblance 0.754
        a = words(rng, 104).split()
        b = [*a[:90], *words(rng, 14).split()]
        texts += [" ".join(a), " ".join(b)]
    expected = brute_components(texts)
    linked = {i for i in range(0, 400, 2) if expected[i + 1][1] == i}
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(table(spark, texts)).collect()}
    found = {i for i in linked if got[i + 1] == i}
    assert len(linked) > 150 and len(found) >= 0.99 * len(linked)
    assert all(got[i + 1] == i + 1 for i in range(0, 400, 2) if i not in linked)


def test_word_hashes_have_no_structure():
    a = "a"
    while len(a) < 2048:
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    raw = f"{a} {b} Ab aB".encode()
    h, first = common.word_hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert len(h) == 4 and h[0] != h[1] and h[2] == h[3] and first.tolist() == [0, 4]


def test_odd_sketch_estimates():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 2000).astype(np.uint64)
    s = near_dedup.signatures([np.sort(x), np.sort(np.concatenate((x[:1800], x[:200] + np.uint64(1))))])
    z = int(np.bitwise_count(np.bitwise_xor(*near_dedup.odd_sketches(s)).view(np.uint64)).sum())
    estimate = 1 + 512 / (4 * 128) * np.log(1 - 2 * z / 512)
    assert abs(estimate - 1800 / 2200) < 0.15


def test_media_round_trip(spark):
    texts = [None, "", "x" * 576, "é" * 1000, words(random.Random(1), 5000), "same", "same"]
    got = {r.doc_id: r for r in jpeg.read_media(jpeg.store_media(table(spark, texts))).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
        assert got[i].tail_crc32 == zlib.crc32(padded[-32:])
    assert got[5].feature == got[6].feature and got[5].media_sha256 == got[6].media_sha256
    assert jpeg.read_media(jpeg.store_media(table(spark, []))).count() == 0


def test_media_beyond_one_image(monkeypatch):
    monkeypatch.setattr(jpeg, "MOST_ROWS", 3)
    raw = np.random.default_rng(0).integers(0, 256, 576 * 8, dtype=np.uint8)
    (media,) = jpeg.encode(raw, [8])
    thumbs = jpeg.thumbnails(jpeg.parse(media))
    assert len(thumbs) == 3 and b"".join(t.tobytes() for t in thumbs) == raw.tobytes()
    with pytest.raises(ValueError):
        jpeg.parse(b"no image")


def plain_decode(media):
    """Samples of a stored image, bit by bit from its own tables: an independent reader."""
    width, tables, at, segments = 0, {}, 2, []
    while media[at + 1] != 0xD9:
        marker, size = media[at + 1], int.from_bytes(media[at + 2 : at + 4], "big")
        body, at = media[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xC0:
            width = int.from_bytes(body[3:5], "big") // 8
        if marker == 0xC4:
            codes, code, k = {}, 0, 17
            for length in range(1, 17):
                for _ in range(body[length]):
                    codes[format(code, f"0{length}b")] = body[k]
                    code, k = code + 1, k + 1
                code *= 2
            tables[body[0]] = codes
        if marker == 0xDA:
            rest = media[at : media.rindex(b"\xff\xd9")]
            segments = [p.replace(b"\xff\x00", b"\xff") for p in re.split(rb"\xff[\xd0-\xd7]", rest, flags=re.S)]
            at += len(rest)
    out = bytearray()
    for segment in segments:
        bits, k, before = "".join(format(x, "08b") for x in segment), 0, 0

        def symbol(codes):
            nonlocal k
            n = next(n for n in range(1, 17) if bits[k : k + n] in codes)
            k += n
            return codes[bits[k - n : k]]

        for _ in range(width):
            size = symbol(tables[0x00])
            if size:
                raw = bits[k : k + size]
                before += int(raw, 2) - (0 if raw[0] == "1" else (1 << size) - 1)
                k += size
            out.append(before + 128)
            assert symbol(tables[0x10]) == 0
    return np.frombuffer(bytes(out), np.uint8).reshape(-1, width)


def test_media_features_by_another_decoder(spark):
    texts = ["", "plain text " * 200, words(random.Random(3), 400)]
    stored = {r.doc_id: bytes(r.media) for r in jpeg.store_media(table(spark, texts)).collect()}
    got = {r.doc_id: r for r in jpeg.read_media(jpeg.store_media(table(spark, texts))).collect()}
    for i, t in enumerate(texts):
        thumb = plain_decode(stored[i]).astype(float)
        assert thumb.astype(np.uint8).tobytes().rstrip(b"\xff") == t.encode()
        rows, cols = ([n * k // parts for k in range(parts + 1)] for parts, n in zip((8, 9), thumb.shape))
        cell = lambda a, b: thumb[rows[a] : max(rows[a + 1], rows[a] + 1), cols[b] : max(cols[b + 1], cols[b] + 1)].mean()  # noqa: E731, B023
        cells = [[cell(a, b) for b in range(9)] for a in range(8)]
        mean = np.mean([c for row in cells for c in row[:8]])
        bits = ["".join("1" if c > mean else "0" for row in cells for c in row[:8]), "".join("1" if b > a else "0" for row in cells for a, b in zip(row, row[1:]))]
        assert got[i].feature == f"{8 * thumb.shape[1]}x{8 * thumb.shape[0]}:{int(bits[0], 2):016x}:{int(bits[1], 2):016x}"
        assert (got[i].media_bytes, got[i].media_sha256) == (len(stored[i]), hashlib.sha256(stored[i]).hexdigest())


def test_corrupt_media_raise():
    raw = np.random.default_rng(0).integers(0, 256, 576 * 8, dtype=np.uint8)
    (media,) = jpeg.encode(raw, [8])
    rng = random.Random(2)
    for _ in range(40):
        at = rng.randrange(300, len(media) - 200)
        garbage = media[:at] + bytes(rng.randrange(256) for _ in range(150)) + media[at + 150 :]
        cut = media[: rng.randrange(200, len(media) - 2)]
        for bad in (garbage, cut, cut + b"\xff\xd9"):
            with pytest.raises(ValueError):
                jpeg.thumbnails(jpeg.parse(bad), exact=True)


def test_scans_of_one_component_each():
    code = lambda d: "00" if not d else format(0b010 + abs(d).bit_length() - 1, "03b") + format(d if d > 0 else d + (1 << abs(d).bit_length()) - 1, f"0{abs(d).bit_length()}b")
    seg = jpeg._segment
    media = b"\xff\xd8" + seg(0xDB, bytes([0] + [8] * 64)) + seg(0xC0, bytes([8, 0, 8, 0, 8, 3, 1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0])) + seg(0xC4, bytes([0, *jpeg.DC_CODES_OF_LENGTH, *range(12)])) + seg(0xC4, bytes([0x10, 1] + [0] * 15 + [0]))
    for component, d in ((1, 10), (2, 100), (3, -20)):
        bits = code(d) if abs(d).bit_length() < 6 else "11110" + format(d, "07b")
        bits += "0"
        bits += "1" * (-len(bits) % 8)
        media += seg(0xDA, bytes([1, component, 0, 0, 63, 0])) + bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    (thumb,) = jpeg.thumbnails(jpeg.parse(media + b"\xff\xd9"))
    assert thumb.tolist() == [[138]]


def test_colour_image_with_ac_terms():
    """A 4:2:0 scan with AC symbols, written bit by bit: the luminance DCs come back."""
    dc = [3, -2, 5, 0]
    bits = ""
    tables = {0: jpeg.huffman(jpeg.DC_CODES_OF_LENGTH, range(12))}
    code = lambda n: next(format(w >> (16 - int(tables[0][1][w])), f"0{int(tables[0][1][w])}b") for w in range(1 << 16) if tables[0][0][w] == n and tables[0][1][w])
    value = lambda d: format(d if d > 0 else d + (1 << abs(d).bit_length()) - 1, f"0{abs(d).bit_length()}b") if d else ""
    before = 0
    for d in dc:  # four luminance blocks, each with one AC term of size 1 after a run of 0
        bits += code(abs(d - before).bit_length()) + value(d - before) + "10" + "1" + "0"
        before = d
    for _ in range(2):
        bits += code(0) + "0"
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    seg = jpeg._segment
    media = b"".join((
        b"\xff\xd8", seg(0xDB, bytes([0] + [8] * 64)), seg(0xC0, bytes([8, 0, 16, 0, 16, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])), seg(0xC4, bytes([0, *jpeg.DC_CODES_OF_LENGTH, *range(12)])),
        seg(0xC4, bytes([0x10, 1, 1] + [0] * 14 + [0x00, 0x01])), seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])), scan, b"\xff\xd9",
    ))
    (thumb,) = jpeg.thumbnails(jpeg.parse(media))
    assert thumb.tolist() == [[131, 126], [133, 128]]


def brute_passages(texts, min_words=50):
    """Words left after deleting every run of words seen at an earlier place, by direct comparison."""
    seen, left = set(), []
    for t in texts:
        own = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        cut = set()
        for i in range(len(own) - min_words + 1):
            run = tuple(own[i : i + min_words])
            if run in seen:
                cut |= set(range(i, i + min_words))
            seen.add(run)
        left.append([w for i, w in enumerate(own) if i not in cut])
    return left


def test_passages_equal_brute_force(spark):
    rng = random.Random(11)
    pool = [words(rng, rng.randrange(0, 25)) for _ in range(60)]
    passage = [words(rng, 20) for _ in range(4)]
    texts = [None, "", words(rng, 80), words(rng, 30_000)]
    for _ in range(40):
        lines = [rng.choice(pool) for _ in range(rng.randrange(1, 12))]
        if rng.random() < 0.6:
            at = rng.randrange(len(lines) + 1)
            lines[at:at] = passage[: rng.randrange(2, 5)]
        texts.append("\n".join(lines))
    texts += [texts[2], "\n".join(passage * 3), texts[3][5000:90_000]]
    df = line_dedup.drop_repeated_passages(table(spark, texts), count_col="gone", words_col="dropped")
    assert df.columns[:-2] == SCHEMA.replace(" bigint", "").replace(" string", "").split(", ")
    got = {r.doc_id: r for r in df.collect()}
    expected = brute_passages(texts)
    assert [(got[i].text or "").split() for i in range(len(texts))] == expected
    assert all(got[i].dropped == len((t or "").split()) - len(e) for i, (t, e) in enumerate(zip(texts, expected)))
    assert got[len(texts) - 3].text == "" and got[0].text is None


def test_passages_odd_rows(spark):
    long = words(random.Random(2), 60)
    got = [tuple(r) for r in line_dedup.drop_repeated_passages(table(spark, [long, long, long, "keep", long], [None, 5, 6, None, 5])).select("doc_id", "text").collect()]
    assert sorted(got, key=str) == sorted([(None, long), (5, long), (5, long), (6, ""), (None, "keep")], key=str)


def test_passages_inside_lines_go(spark, tmp_path):
    rng = random.Random(12)
    passage = [f"é{k}" for k in words(rng, 60).split()]
    texts = [None, "", words(rng, 30) + " " + " ".join(passage) + " " + words(rng, 70)]
    for k in range(8):  # other lines, other breaks, at either end
        body = words(rng, 40).split()
        body[(at := rng.randrange(41)) : at] = passage[k : k + 52]
        texts.append("\n".join(" ".join(body[i : i + 9 + k]) for i in range(0, len(body), 9 + k)))
    texts += [" ".join(passage), "kept " + " ".join(passage[:49]), texts[2]]
    docs = table(spark, texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in line_dedup.op3_line_dedup(spark, str(tmp_path)).collect()}
    seen, expected = set(), []
    for t in texts:  # by direct comparison of all runs of 50 words
        own = (t or "").split()
        cut = set()
        for i in range(len(own) - 49):
            run = tuple(own[i : i + 50])
            if run in seen:
                cut |= set(range(i, i + 50))
            seen.add(run)
        expected.append([w for i, w in enumerate(own) if i not in cut])
    assert [(rows[i].text or "").split() for i in range(len(texts))] == expected
    assert rows[0].text is None and rows[len(texts) - 3].text == rows[len(texts) - 1].text == "" and rows[len(texts) - 1].lines_deleted == 1
    assert len(expected[3]) == 40 and rows[2].text == texts[2]
    assert line_dedup.drop_repeated_passages(table(spark, [])).count() == 0


def test_erase_keeps_line_breaks():
    cases = [("a\nR r\nb", "a\nb"), ("a R r b", "a b"), ("a R r\nb", "a\nb"), ("a\nR r b", "a\nb"), ("R r\nb", "b"), ("a\nR r", "a"), ("a R\nr b", "a b"), ("a\n\n  R r\n\nb", "a\n\nb"), (" R r ", "")]
    for text, left in cases:
        assert line_dedup.erase(text, [(text.index("R"), text.index("r") + 1)]) == left


def test_url_filter(spark):
    cases = [
        ("https://A.Example.COM/en/7/x?q=/en/", ("a.example.com", "/en/7/x", "example.com/en/7", "allow")), ("http://example.com/en/8", ("example.com", "/en/8", "com/en/", "block")),
        ("http://x.org/es/#f", ("x.org", "/es/", "org/es/", "block")), ("http://xorg/es/", ("xorg", "/es/", None, None)), ("no scheme", ("", "", None, None)), (None, ("", "", None, None)),
        ("http://example.net/de/8", ("example.net", "/de/8", "example.net/de/8", "allow")), ("http://h?x=://y/z", ("h", "", None, None)),
    ]
    df = spark.createDataFrame([(i, u, "a", "b") for i, (u, _) in enumerate(cases)], "page_id bigint, url string, host string, score string")
    model = url_filter.train(url_filter.labelled_urls())
    weights, bias = model
    for r in url_filter.judge(df, model).collect():
        url, (host, path, rule, verdict) = cases[r.page_id]
        score = bias + sum(weights[b] for b in url_filter.buckets(*url_filter.split_url(url)))
        assert (r.host, r.path, r.rule, r.score) == (host, path, rule, score)
        assert r.verdict == (verdict or ("block" if score > 0 else "allow"))


def test_url_regression_learns():
    rows = url_filter.labelled_urls()
    assert 100 < len(rows) < 200 and len({u for u, _ in rows}) == len(rows)
    rng, right = random.Random(0), 0
    rng.shuffle(rows)
    for k in range(8):  # each host is in one fold only
        weights, bias = url_filter.train([t for i, t in enumerate(rows) if i % 8 != k])
        right += sum((bias + sum(weights[b] for b in url_filter.buckets(*url_filter.split_url(u))) > 0) == y for u, y in rows[k::8])
    assert right >= 0.75 * len(rows)
    assert url_filter.train([("http://a", True)])[1] == -1


def test_url_odd_rows(spark):
    model = url_filter.train(url_filter.labelled_urls())
    url = "http://h.example.com/" + "x" * 50_000
    df = spark.createDataFrame([(None, url), (4, url), (4, url), (4, None)], "page_id bigint, url string")
    rows = url_filter.judge(df, model).collect()
    assert len(rows) == 4 and len({(r.path, r.verdict) for r in rows if r.host}) == 1
    assert url_filter.judge(df.limit(0), model).count() == 0


def brute_bins(items, capacity):
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in {b: n for n, b in enumerate(bins)}.values():
            if bins[k] + items[i] <= capacity:
                bins[k] += items[i]
                go(i + 1, bins)
                bins[k] -= items[i]
        go(i + 1, [*bins, items[i]])

    items = sorted(items, reverse=True)
    go(0, [])
    return best[0]


def test_packing_is_optimal_on_small_inputs():
    rng = random.Random(4)
    for _ in range(150):
        capacity = rng.choice([10, 30, 100])
        counts = collections.Counter(rng.randint(1, capacity) for _ in range(rng.randrange(11)))
        patterns = packing.pack(counts, capacity)
        used = collections.Counter()
        for n, shape in patterns:
            assert sum(a * b for a, b in shape) <= capacity
            for size, k in shape:
                used[size] += n * k
        assert used == counts and sum(n for n, _ in patterns) == brute_bins(list(counts.elements()), capacity)


def test_packing_equals_brute_force_on_some_dozen_pieces():
    rng = random.Random(9)
    for _ in range(25):
        items = [rng.randint(420, 900) for _ in range(rng.randrange(12, 19))]
        patterns, bound, proven = packing.packing(collections.Counter(items), 2048)
        best = brute_bins(items, 2048)
        assert proven and packing.used(patterns) == best >= bound
    hard = [430, 476, 522, 546, 617, 632, 685, 686, 692, 700, 717, 726, 742, 762, 781, 834, 853, 855, 863, 871, 881, 885, 894, 895]
    patterns, bound, proven = packing.packing(collections.Counter(hard), 2048)
    assert (packing.used(patterns), bound, proven) == (9, 9, True)


def test_fillings_are_all_undominated_ones():
    rng = random.Random(5)
    for _ in range(60):
        counts = collections.Counter(rng.randint(1, 12) for _ in range(rng.randrange(1, 9)))
        room, sizes = rng.randint(1, 30), None
        sizes = sorted(counts)
        every = set()
        for pick in itertools.product(*[range(counts[s] + 1) for s in sizes]):
            rest = room - sum(s * n for s, n in zip(sizes, pick))
            spare = [s for s, n in zip(sizes, pick) if counts[s] > n]
            if rest >= 0 and not any(x <= rest for x in spare) and not any(s < x <= s + rest for s, n in zip(sizes, pick) if n for x in spare):
                every.add((rest, tuple((s, n) for s, n in zip(sizes[::-1], pick[::-1]) if n)))
        got = set(packing.fillings(counts, sizes, room))
        assert got <= every and len(got) == len(set(got))
        assert min(w for w, _ in got) == min(w for w, _ in every)
        slack = min(w for w, _ in every)
        assert {f for f in got if f[0] <= slack} == {f for f in packing.fillings(counts, sizes, room, slack) if f[0] <= slack}


def test_ids_equal_the_tokenizer_for_every_plain_character():
    bpe, rng = word_bpe(packing.VOCABULARY), random.Random(1)
    chars = [chr(c) for c in range(0x2200) if bpe.chunks(chr(c)) is not None or bpe.chunks(chr(c).lower()) is not None]
    texts = ["Əliyev", "HAUSA: ƁARAWO ƊAN", *chars, *[f"a{c}b {c}{c} 1{c}2" for c in chars]]
    texts += ["".join(rng.choice(chars) if rng.random() < 0.5 else rng.choice("abc ABC 'stmdl.,1\n\t") for _ in range(rng.randrange(1, 14))) for _ in range(5000)]
    for text, coded in zip(texts, bpe.encode_batch(texts)):
        assert coded == np.array(bpe.own.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_packing_closes_gaps_on_many_pieces():
    rng = random.Random(1)
    counts = collections.Counter(rng.randint(307, 819) for _ in range(3000))
    counts[2048] = 5
    patterns = packing.pack(counts, 2048)
    held = collections.Counter()
    for n, shape in patterns:
        assert sum(a * b for a, b in shape) <= 2048
        for size, k in shape:
            held[size] += n * k
    greedy = min(sum(n for n, _ in f(counts, 2048)) for f in (packing.best_fit, packing.complete))
    assert held == counts and packing.lower_bound(counts, 2048) <= sum(n for n, _ in patterns) < greedy


def test_exact_packing_tries_every_filling():
    counts = collections.Counter([50, 48, 48, 47, 45, 30, 20, 7, 5])
    assert sum(n for n, _ in packing.pack(counts, 100)) == 3


def test_packed_documents(spark):
    texts = [None, "", "Hello, don't stop", words(random.Random(6), 6000), "日本語 Σας", "same text", "same text"]
    rows = packing.pack_documents(table(spark, texts)).collect()
    bpe = word_bpe(packing.VOCABULARY)
    for i, t in enumerate(texts):
        ids = bpe.own.encode(t or "", add_special_tokens=False).ids + [0]
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert sum(r.length for r in own) == len(ids)
        for k, r in enumerate(own):
            assert (r.piece, r.start) == (k, 2048 * k)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for sequence in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == sequence), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert packing.pack_documents(table(spark, [])).count() == 0
    odd = packing.pack_documents(table(spark, ["a", "a", None], [None, 3, 3])).collect()
    assert sorted((r.doc_id is None, r.length) for r in odd) == [(False, 1), (False, 2), (True, 2)]


def test_fingerprints(spark):
    texts = [None, "", "a b c d e f g h", words(random.Random(8), 900), words(random.Random(9), 50), "same one", "same one"]
    ids = [5, 600, 7, 100_000, -3, 2_000_000_000, 9]
    got = {r.doc_id: r for r in fingerprints.compare_neighbours(table(spark, texts, ids)).collect()}
    order = sorted(zip(ids, texts))
    order = sorted(((i, t or "") for i, t in zip(ids, texts)))
    for k, (i, t) in enumerate(order):
        n = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        a, b = shingle_set(t), shingle_set(edited)
        assert abs(got[i].near_edited - (len(a & b) / len(a | b) if a | b else 1)) < 0.2
    assert got[2_000_000_000].fingerprint == got[9].fingerprint
    alone = fingerprints.compare_neighbours(table(spark, ["only one text here now ok"])).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0
    assert fingerprints.compare_neighbours(table(spark, [])).count() == 0


def brute_neighbours(rows):
    """(id, n_chars, edited_sha256) of each row, in order, rows of one id by their hash."""
    out = []
    for k, (i, t) in enumerate(rows):
        n, half = rows[(k + 1) % len(rows)][1], len(t) // 2
        out.append((i, len(t), hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("many", [True, False])
def test_neighbours_of_any_ids(spark, many):
    rng = random.Random(31)
    ids = [rng.getrandbits(64) - (1 << 63) for _ in range(700)]
    texts = [words(rng, rng.randrange(1, 40)) for _ in ids]
    ids += [None] * 600 + [77] * 300  # one text of them all, and 300 texts of one id
    texts += ["all the same text"] * 600 + [f"text {k} of it" for k in range(300)]
    docs = table(spark, texts, ids)
    hashes = {r.text: r.h for r in docs.selectExpr("text", "xxhash64(text) as h").collect()}
    rows = sorted(zip(ids, texts), key=lambda r: (-(1 << 63) if r[0] is None else r[0], hashes[r[1]]))
    got = fingerprints.compare_neighbours(docs, range_bytes=2000 if many else 1 << 30).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=key) == sorted(brute_neighbours(rows), key=key)


def test_likenesses_are_exact_on_small_texts(spark):
    texts = [words(random.Random(k), 60) for k in range(4)]
    texts[2] = texts[1][:300] + texts[2][300:]
    got = {r.doc_id: r for r in fingerprints.compare_neighbours(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        n, half = texts[(i + 1) % 4], len(t) // 2
        a, b, c = (shingle_set(x) for x in (t, t[: len(t) - half] + n[:half], n))
        exact = lambda x, y: len(x & y) / len(x | y)
        assert got[i].near_edited == exact(a, b) or len(a | b) > fingerprints.K  # sets of at most K together are whole
        assert got[i].near_next == exact(a, c) or len(a | c) > fingerprints.K
        assert len(fingerprints.from_text(got[i].fingerprint)) == len(a)


def test_sketches_merge_and_estimate(spark):
    rng = np.random.default_rng(2)
    x = np.unique(rng.integers(0, 2**63, 9000).astype(np.uint64) * np.uint64(2))
    a, b = fingerprints.sketch(x[:6000]), fingerprints.sketch(np.sort(rng.permutation(x)[:6000]))
    assert (fingerprints.from_text(fingerprints.to_text(a)) == a).all()
    whole = np.sort(rng.permutation(x))
    parts = [fingerprints.sketch(np.sort(p)) for p in np.array_split(rng.permutation(x), 5)]
    assert (fingerprints.merge(parts) == fingerprints.sketch(whole)).all()
    assert abs(fingerprints.distinct(fingerprints.sketch(whole)) / len(whole) - 1) < 0.3
    assert fingerprints.containment(b, fingerprints.sketch(whole)) > 0.8
    df = spark.createDataFrame([("k", fingerprints.to_text(p)) for p in parts], "key string, fingerprint string")
    assert fingerprints.merge_fingerprints(df, "key").first().fingerprint == fingerprints.to_text(fingerprints.merge(parts))


def test_warc_round_trip(spark):
    html = [None, "", "<p>" * 400, "<p>" * 400, "<p>" * 400, "short", "short", "é" * 999, "x" * 200_000]
    df = spark.createDataFrame([(i, f"http://h/{i}\r\nX: y", h, "w") for i, h in enumerate(html)], "page_id bigint, url string, html string, sha256 string")
    headers, payloads = warc.write_archive(df, Scratch(spark, "t"))
    records = {int(re.search(rb"X-Page-ID: (\d+)", r.record)[1]): bytes(r.record) for r in warc.read_records(headers, payloads).collect()}
    got = {r.page_id: r for r in warc.index_records(warc.read_records(headers, payloads)).collect()}
    names = set()
    for i, h in enumerate(html):
        raw, revisit = (h or "").encode(), i in (2, 3)
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].verified) == (len(raw), hashlib.sha1(raw).hexdigest(), True)
        assert (got[i].record_type, got[i].refers_to) == (("revisit", 4) if revisit else ("response", None))
        head, _, rest = records[i].partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert rest == (b"" if revisit else raw) + b"\r\n\r\n" and int(fields["Content-Length"]) == len(rest) - 4
        assert re.fullmatch(r"<urn:uuid:[0-9a-f]{8}-[0-9a-f]{4}-3[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}>", fields["WARC-Record-ID"])
        assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", fields["WARC-Date"]) and fields["WARC-Target-URI"] == f"http://h/{i}%0D%0AX: y"
        assert ("WARC-Profile" in fields) == ("WARC-Refers-To" in fields) == revisit
        names.add(fields["WARC-Record-ID"])
    assert len(names) == len(html) and payloads.count() == 5
    broken = payloads.withColumn("payload", F.when(F.octet_length("payload") == 5, F.lit(b"shorT")).otherwise(F.col("payload")))
    assert {r.page_id for r in warc.index_records(warc.read_records(headers, broken)).where("not verified").collect()} == {5, 6}
    assert warc.read_records(*warc.write_archive(df.limit(0), Scratch(spark, "t"))).count() == 0
    odd = spark.createDataFrame([(None, "u", "z" * 1500), (3, "u", "z" * 1500), (3, "u", "z" * 1500)], "page_id bigint, url string, html string")
    rows = warc.index_records(warc.read_records(*warc.write_archive(odd, Scratch(spark, "t")))).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in rows) == [(0, "revisit", 3), (3, "response", 0), (3, "response", 0)]


def test_toxicity_held_out(spark):
    rng = random.Random(1)
    texts, marks = [], []
    for k in range(400):
        toxic = k % 4 == 0
        body = words(rng, 40).split()
        if toxic:
            bad = rng.choice(["idiot", "moron", "stupid"])
            at = rng.randrange(len(bad) - 1)
            for _ in range(4):
                body.insert(rng.randrange(40), bad if rng.random() < 0.5 else bad[:at] + bad[at] + bad[at:])
        texts.append(" ".join(body))
        marks.append(int(toxic))
    docs = table(spark, [*texts, None, ""])
    labels = spark.createDataFrame([(i, m) for i, m in enumerate(marks)] + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for i, r in got.items())
    test = [i for i in range(400) if got[i].held_out]
    assert sum(got[i].predicted == marks[i] for i in test) >= 0.9 * len(test)
    assert 0 <= got[400].score == got[401].score <= 1
    left = toxicity.drop_toxic(docs, model)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i, r in got.items() if r.predicted == 0}
    odd = table(spark, [texts[0]] * 3 + [words(rng, 20_000)], [None, 9, 9, 10])
    rows = toxicity.score_toxicity(odd, model).collect()
    assert len(rows) == 4 and len({r.score for r in rows if r.doc_id != 10}) == 1 and next(r.held_out for r in rows if r.doc_id is None)
    again = toxicity.train(docs.unionAll(docs), labels.unionAll(labels))
    assert (again[0] == model[0]).all() and again[1] == model[1]
    none = toxicity.train(docs, labels.where("toxic = 0"))
    assert toxicity.score_toxicity(docs, none).where("predicted = 1").count() == 0


def test_toxicity_scores_equal_a_plain_sum(spark):
    rng = random.Random(4)
    texts = [None, "", "  ", "a", "you idiot", "ünï cödé wörds", words(rng, 30), words(rng, 3000), "A  b\tC"]

    def grams(text):
        s = b" " + bytes(32 if x in b" \t\n\x0b\x0c\r" else x + 32 if 65 <= x <= 90 else x for x in text.encode()) + b" "
        for n in toxicity.GRAMS:
            for i in range(len(s) - n + 1):
                g = s[i : i + n]
                if 32 in g[1:-1]:
                    continue
                h = sum(x * pow(0x01000193, k, 1 << 32) for k, x in enumerate(g)) % (1 << 32)
                x = (h ^ h >> 15) * 0x9E3779B1 % (1 << 32)
                x ^= x >> 13
                x = (x * 0x01000193 + n - 1) % (1 << 32)
                yield x * 0x9E3779B1 % (1 << 32) >> (32 - toxicity.BUCKETS_LOG2)

    e, w, b = toxicity.fit(toxicity.row_counts([t.encode() for t in texts[4:8]]), np.array([True, False, False, True]), 0.3, epochs=5)
    model = toxicity.fold(e, w, b)
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(table(spark, texts), model).collect()}
    for i, t in enumerate(texts):
        own = list(grams(t or ""))
        mean = e[own].astype(float).mean(axis=0) if own else np.zeros(e.shape[1])
        z = mean @ w.astype(float) + b
        assert abs(got[i] - 1 / (1 + np.exp(z[0] - z[1]))) < 1e-4


def plain_base(text):
    """Base spans as the rules read, with Python's own regular expressions."""
    digits = lambda v: re.sub("[^0-9]", "", v)

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0

    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True), "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 12 <= len(digits(v)) <= 19 and luhn(digits(v))), "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(digits(v)) <= 15),
    }
    found = [(m.start(), k, m.end(), kind) for k, (kind, (rule, holds)) in enumerate(rules.items()) for m in re.finditer(rule, text) if holds(m[0])]
    return sorted(found)


def plain_pii(texts, confident, doubt=1.0):
    """All of the extraction in plain Python: (base, spans) of each text."""
    digits = lambda v: len(re.sub("[^0-9]", "", v))
    forms = {
        "email": lambda v: re.fullmatch("[^@]+@[^@]+", v), "ip": lambda v: re.fullmatch(r"[0-9]+(\.[0-9]+){3}", v),
        "card": lambda v: re.fullmatch(r"[0-9]+([\x20-][0-9]+)*", v) and 12 <= digits(v) <= 19, "phone": lambda v: re.fullmatch(r"\+?[0-9\x20().-]+", v) and 9 <= digits(v) <= 15,
    }
    letter = "[^\\W0-9_]"
    places, base = [], [plain_base(t) for t in texts]
    for i, t in enumerate(texts):
        pattern = r"(?:%s|[0-9._%%+-])+@(?:(?:%s|[0-9_%%+-])+(?:\.(?:%s|[0-9_%%+-])+)*)?|\+?\(?[0-9]+(?:[\x20().-]{1,2}\(?[0-9]+)*" % (letter, letter, letter)
        found = list(re.finditer(pattern, t))
        for k, m in enumerate(found):
            before = t[found[k - 1].end() if k else 0 : m.start()]
            after = t[m.end() : found[k + 1].start() if k + 1 < len(found) else len(t)]
            left, right = re.search(f"({letter}+)(?:(?!{letter}).)*$", before, re.S), re.search(f"{letter}+", after)
            pats = [c + w.lower() for c, w in (("<", left and left[1]), (">", right and right[0])) if w]
            kinds = {kind for kind in forms if forms[kind](m[0])}
            hits = [b for b in base[i] if b[0] < m.end() and b[2] > m.start()]
            same = [b for b in hits if (b[0], b[2]) == m.span()]
            if kinds and (same or not hits):
                places.append((i, *m.span(), m[0], pats, kinds, min((b[1] for b in same), default=None)))
    order = list(forms)
    seed = {}
    for *_, v, _, _, s in places:
        if s is not None:
            seed[v] = min(s, seed.get(v, 9))
    edges = {(p, v, k) for _, _, _, v, pats, kinds, s in places for p in pats for k in {order.index(x) for x in kinds} | ({s} - {None})}
    accepted = {}
    while True:
        n, own = collections.Counter((p, k) for p, _, k in edges), collections.Counter((p, k) for p, v, k in edges if seed.get(v) == k or (v not in seed and accepted.get(v) == k))
        high = {x: round(own[x] / (n[x] + doubt), 9) for x in n if round(own[x] / (n[x] + doubt), 9) >= confident}
        new = {}
        for v in {v for _, v, _ in edges if v not in seed and v not in accepted}:
            q = {}
            for p, x, k in edges:
                if x == v and (p, k) in high:
                    q[k] = q.get(k, 1.0) * max(1 - high[p, k], 1e-9)
            if q:
                new[v] = max(q, key=lambda k: (round(1 - q[k], 9), -k))
        if not new:
            break
        accepted |= new
    out = []
    for i in range(len(texts)):
        spans = [(s, k, e, kind) for s, k, e, kind in base[i]] + [(s, accepted[v], e, order[accepted[v]]) for j, s, e, v, _, _, own in places if j == i and own is None and v in accepted]
        out.append((",".join(f"{kind}:{s}:{e}" for s, _, e, kind in base[i]), ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in sorted(spans))))
    return out


def test_pii_equals_plain_python(spark):
    rng = random.Random(17)
    good = ["4111111111111111", "5500005555555559", "4012888888881881", "6011111111111117", "4222222222222220", "4111 1111 1111 1111"]
    makers = [
        lambda: rng.choice(good), lambda: str(rng.randrange(10**15, 10**16)), lambda: ".".join(str(rng.randrange(300)) for _ in range(4)), lambda: f"u{rng.randrange(30)}@mail{rng.randrange(3)}" + rng.choice([".example.com", "", ".", "@x"]),
        lambda: f"+{rng.randrange(1, 99)} ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}", lambda: f"({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}", lambda: str(rng.randrange(3000)), lambda: "".join(rng.choice("0123456789.+-() @aé") for _ in range(rng.randrange(1, 24))),
    ]
    cues = ["account", "Konto", "host", "call", "mail", "the", "número", "ledger"]
    texts = [None, ""]
    for _ in range(250):
        parts = []
        for _ in range(rng.randrange(1, 9)):
            cue = rng.randrange(len(cues))
            parts.append(cues[cue] + rng.choice([" ", ": ", ", "]) + (makers[cue]() if cue < 5 and rng.random() < 0.8 else rng.choice(makers)()) + rng.choice(["", ".", ",", "!"]))
        texts.append(" ".join(parts))
    expected = plain_pii([t or "" for t in texts], 0.4)
    got = {r.doc_id: r for r in pii.find_pii(table(spark, texts), confident=0.4).collect()}
    for i, (base, spans) in enumerate(expected):
        assert (got[i].base_sha256, got[i].spans) == (hashlib.sha256(base.encode()).hexdigest(), spans), texts[i]
    assert sum(base != spans for base, spans in expected) > 5


def test_pii_spans(spark):
    texts = [None, "", "mail a@b.c@d.example.org x_y@z.w!", "ip 1.2.3.4.5.6.7.8 and 1.2.3.999", "card 4111 1111-1111 1111, 1234567890123", "tel +1 (017) 555-7713 +12", "é a@b.co", "9" * 3000 + " " + "a" * 3000]
    got = {r.doc_id: r for r in pii.find_pii(table(spark, texts)).collect()}
    assert [tuple(got[i][1:5]) for i in range(8)] == [(0, 0, 0, 0), (0, 0, 0, 0), (2, 0, 0, 0), (0, 2, 0, 0), (0, 0, 1, 0), (0, 0, 0, 1), (1, 0, 0, 0), (0, 0, 0, 0)]
    assert got[6].spans == "email:2:8" and got[0].spans == ""
    assert got[6].base_sha256 == hashlib.sha256(b"email:2:8").hexdigest()
    assert pii.find_pii(table(spark, [])).count() == 0


def test_pii_bootstrap_discovers(spark):
    good = ["4111111111111111", "5500005555555559", "4012888888881881", "6011111111111117", "4222222222222220"]
    texts = [f"account {c}" for c in good] + ["account 4111111111111112", "order 4111111111111113"]
    got = {r.doc_id: r for r in pii.find_pii(table(spark, texts), confident=0.6).collect()}
    assert got[5].spans == "card:8:24" and got[5].n_card == 0 and got[5].n_added == 1
    assert got[6].spans == ""


def test_pii_discovered_identifiers_seed_new_patterns(spark):
    good = ["4111111111111111", "5500005555555559", "4012888888881881", "6011111111111117", "4222222222222220", "4111 1111 1111 1111", "5105105105105100", "378282246310005", "30569309025904"]
    bad = ["4111111111111112", "4111111111111114", "4111111111111115"]  # no check sum holds
    texts = [f"account {c}" for c in good + bad[:2]] + [f"ledger {c}" for c in bad] + ["desk 4111111111111119"]
    got = {r.doc_id: r for r in pii.find_pii(table(spark, texts), confident=0.5).collect()}
    assert [got[i].spans for i in (9, 10)] == ["card:8:24"] * 2  # the first hop
    assert [got[i].spans for i in (11, 12, 13)] == ["card:7:23"] * 3  # the last of them only by the second
    assert got[14].spans == ""


def test_pii_phones_with_spaces_seed(spark):
    texts = [f"call +1 ({k}) 555-1234" for k in range(200, 209)] + ["call (743) 555-3824", "by (743) 555-3825"]
    got = {r.doc_id: r for r in pii.find_pii(table(spark, texts)).collect()}
    assert got[9].spans == "phone:5:19" and got[10].spans == ""


def test_pii_odd_rows(spark):
    texts = ["a@b.co", "a@b.co", None, "word " * 20_000 + "1.2.3.4 " + "x" * 100_000 + "@" + "9" * 100_000]
    rows = pii.find_pii(table(spark, texts, [None, 5, 5, 6])).collect()
    assert sorted((str(r.doc_id), r.spans) for r in rows) == [("5", ""), ("5", "email:0:6"), ("6", "ip:100000:100007"), ("None", "email:0:6")]


def plain_rake(cells, targets, sweeps):
    w = {c: n / sum(cells.values()) for c, n in cells.items()}
    for _ in range(sweeps):
        for d in range(3):
            now = collections.Counter()
            for c, x in w.items():
                now[c[d]] += x
            w = {c: x * targets[d][c[d]] / now[c[d]] for c, x in w.items()}
    ratio = {c: w[c] / cells[c] for c in w}
    return {c: r / max(ratio.values()) for c, r in ratio.items()}


def mixed_docs(spark):
    rng = random.Random(3)
    cues = ["sun rain wind snow cloud storm", "code loop stack heap byte cache", "bread milk salt flour egg oven"]
    rows = []
    for i in range(1500):
        cue = rng.choice(cues).split()
        rows.append((i, " ".join(rng.choice(cue) for _ in range(rng.randrange(5, 30))), rng.choice(["en", "en", "fr", None]), rng.choice(["a"] * 6 + ["b"] * 2 + [None]), 1, 1.0, "t"))
    return spark.createDataFrame([*rows, (9000, None, "en", "a", 0, 0.0, "t"), (9001, "", "xx", "a", 0, 0.0, "t")], "doc_id bigint, text string, lang string, source string, n_chars bigint, p double, topic string")


def test_mixing_equals_plain_raking(spark):
    docs = mixed_docs(spark)
    rows = mixing.mix(docs, tolerance=1e-5).collect()
    assert all(r.mix_kept and r.mix_p == 1.0 and r.mix_topic is None for r in rows if r.doc_id >= 9000)
    cells = collections.Counter()
    for r in rows:
        if r.mix_tokens:
            cells[r.source, r.lang, r.mix_topic] += r.mix_tokens
    targets = []
    for d in range(3):
        own = collections.Counter()
        for c, n in cells.items():
            own[c[d]] += n
        share = {k: n**mixing.TEMPERATURE for k, n in own.items()}
        targets.append({k: x / sum(share.values()) for k, x in share.items()})
    expected = plain_rake(cells, targets, 60)
    for r in rows:
        if r.mix_tokens:
            assert abs(r.mix_p - expected[r.source, r.lang, r.mix_topic]) < 1e-4
            mark = int(hashlib.md5(f"mix:{r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
            assert r.mix_kept == (mark < r.mix_p)
    assert len({r.mix_topic for r in rows if r.mix_tokens}) >= 3
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_meets_given_targets(spark):
    docs = mixed_docs(spark)
    given = spark.createDataFrame([("a", 1.0), ("b", 2.0), (None, 1.0), ("absent", 9.0)], "value string, weight double")
    langs = spark.createDataFrame([("en", 3.0), ("fr", 1.0)], "value string, weight double")
    rows = mixing.mix(docs, targets={"source": given, "lang": langs}, tolerance=1e-5).collect()
    for d, want in (("source", {"a": 0.25, "b": 0.5, None: 0.25}), ("lang", {"en": 0.75, "fr": 0.25, None: 0.0})):
        kept = collections.Counter()
        for r in rows:
            kept[r[d]] += r.mix_tokens * r.mix_p
        for k, share in want.items():
            assert abs(kept[k] / sum(kept.values()) - share) < 1e-4
    with pytest.raises(ValueError):
        mixing.mix(docs, targets={"source": given.where("value = 'absent'")})


def test_topics_and_odd_rows(spark):
    docs = mixed_docs(spark)
    topic = collections.defaultdict(collections.Counter)
    for r in mixing.mix(docs).collect():
        if r.mix_tokens:
            topic[next(k for k, cue in enumerate(("sun rain wind snow cloud storm", "code loop stack heap byte cache", "bread milk salt flour egg oven")) if r.text.split()[0] in cue.split())][r.mix_topic] += 1
    assert len({c.most_common(1)[0][0] for c in topic.values()}) == 3
    assert all(c.most_common(1)[0][1] > 0.9 * sum(c.values()) for c in topic.values())
    odd = table(spark, ["same words here"] * 3 + [words(random.Random(1), 20_000)], [None, 4, 4, 5])
    rows = mixing.mix(odd).collect()
    assert len(rows) == 4 and len({r.mix_kept for r in rows if r.doc_id == 4}) == 1


def test_pipeline_equals_its_operators(spark):
    import corpus_pipeline as pipeline

    sf = "/root/testdata/sf0.001"
    rows = pipeline.run(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.train(frame, spark.read.parquet(f"{sf}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.score_toxicity(frame, model).collect() if r.predicted}
    left = [(r.doc_id, r.text, r.source, r.lang) for r in docs if r.doc_id not in bad]
    cut = line_dedup.drop_repeated_passages(spark.createDataFrame([x[:2] for x in left], "doc_id bigint, text string")).collect()
    cut = {r.doc_id: r.text for r in cut}
    assert [(cut[x[0]] or "").split() for x in left] == brute_passages([x[1] for x in left], line_dedup.MIN_WORDS)
    left = [(i, cut[i], s, g) for i, old, s, g in left if cut[i] or cut[i] == old]
    parts = brute_components([x[1] for x in left])
    left = [x for k, x in enumerate(left) if parts[k][2]]
    mixed = mixing.mix(spark.createDataFrame(left, "doc_id bigint, text string, source string, lang string"))
    final = {r.doc_id: r.text for r in mixed.where("mix_kept").collect()}
    assert {r.doc_id for r in rows} == set(final)
    bpe = word_bpe(packing.VOCABULARY)
    assert sum(r.length for r in rows) == sum(len(bpe.own.encode(t, add_special_tokens=False).ids) + 1 for t in final.values())
