"""Decontamination, licences, urls, pieces and audio against plain-Python versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from allelia.llm import audio, decontam, licences, pieces, urls

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def invented(rng, n, vocab=40):
    return " ".join(rng.choice([f"w{rng.randrange(vocab)}", f"É{rng.randrange(9)}x", "The", "of,"]) for _ in range(n))


# decontamination


def brute_matches(docs, items, size):
    out = {}
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for i, t in items:
            v = words(t)
            for s in range(max(1, len(v) - size + 1) if v else 0):
                g = v[s : s + size]
                for p in range(len(w) - len(g) + 1):
                    if w[p : p + len(g)] == g:
                        hit.update(range(p, p + len(g)))
                        found.add(str(i))
        ids = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[d] = (len(w), len(hit), len(found), ids, len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("limit", [200_000, 30])
def test_decontamination_against_brute_force(spark, limit):
    rng = random.Random(3)
    items = [(k, invented(rng, rng.choice([3, 13, 20]), 12)) for k in range(12)] + [(20, ""), (21, None), (22, "..."), (3, "the of the"), (23, "THE  of-the")]
    docs = [(k, invented(rng, rng.randrange(60), 12)) for k in range(40)]
    docs += [(100 + k, f"{invented(rng, 5)} {items[k][1]} {invented(rng, 9)} {items[k][1]}") for k in range(12)]
    docs += [(200, None), (201, ""), (202, "!!"), (203, " ".join(["the of the"] * 3000))]
    found = decontam.matches(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"), limit=limit)
    got = {r.doc_id: (r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(sorted(r["items"])).encode()).hexdigest(), 20 * r.n_hit >= r.n_words and r.n_hit > 0) for r in found.collect()}
    assert got == brute_matches(docs, items, decontam.WINDOW)


def test_decontamination_spans_and_near_matches(spark):
    wide = " ".join(f"v{i}" for i in range(300))  # windows of more than 255 words
    many = decontam.matches(spark.createDataFrame([(1, wide), (2, wide + " more")], DOCS), spark.createDataFrame([(1, wide)], "item_id long, text string"), size=300).collect()
    assert [r.n_hit for r in many] == [300, 300]
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = [(1, f"x y {item} z"), (2, "x " + item.replace("delta", "delta extra")), (3, item.replace("beta", "other"))]
    found = {r.doc_id: r for r in decontam.matches(spark.createDataFrame(docs, DOCS), spark.createDataFrame([("i", item)], "item_id string, text string"), gap=2).collect()}
    assert [(m.start, m.end, m.exact) for m in found[1].matches if m.exact] == [(2, 12, True)] and found[1].n_hit == 10
    assert found[2].n_hit == 0 and any(not m.exact for m in found[2].matches) and any(not m.exact for m in found[3].matches)


def test_near_matches_against_brute_force(spark):
    """Every start at which four fifths of a window's words stand within two places of where they belong, words dropped, added and shifted."""
    rng, gap, share = random.Random(11), 2, 0.8
    items = [(k, invented(rng, rng.choice([5, 13, 16]), 30)) for k in range(6)] + [(9, ""), (10, None)]
    docs = [(k, invented(rng, rng.randrange(40), 30)) for k in range(20)] + [(90, None), (91, "")]
    for k in range(60):
        w = words(items[k % 6][1])
        for _ in range(rng.randrange(4)):
            p = rng.randrange(len(w))
            w = w[:p] + (w[p + 1 :] if rng.random() < 0.5 else ["extra", *w[p:]])
        docs.append((100 + k, " ".join([invented(rng, rng.randrange(3)), *w, invented(rng, rng.randrange(4))])))
    want = {}
    for d, text in docs:
        doc, exact, near = words(text or ""), set(), set()
        for item, t in items:
            own = words(t or "")
            for win in {tuple(own[s : s + decontam.WINDOW]) for s in range(max(len(own) - decontam.WINDOW + 1, min(len(own), 1)))}:
                for s in range(-len(win) - gap, len(doc) + gap):
                    hits = sum(any(0 <= p < len(doc) and doc[p] == x for p in range(s + i - gap, s + i + gap + 1)) for i, x in enumerate(win))
                    if s >= 0 and tuple(doc[s : s + len(win)]) == win:
                        exact.add((item, win, s))
                    if hits >= share * len(win) - 1e-9:
                        near.add((item, win, max(s, 0)))
        near -= exact
        ids = sorted({str(i) for i, _, _ in near})
        want[d] = (len(doc), len(exact), len(near), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest())
    found = decontam.near_digests(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"))
    got = {r.doc_id: (r.n_words, r.n_exact, r.n_near, r.n_near_items, r.near_items_sha256) for r in found.collect()}
    assert sum(n for _, _, n, _, _ in want.values()) > 100 and got == want


def test_decontamination_edge_tables(spark):
    none, item = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b c", 5, "keep"), (1, "a b c", 5, "keep")], "doc_id long, text string, n_words int, items string")
    assert [r.n_hit for r in decontam.matches(docs, none).collect()] == [0, 0]
    rows = decontam.matches(docs, item).collect()
    assert [(r.n_words, r.n_hit, r["items"]) for r in rows] == [(3, 2, ["1"])] * 2
    assert decontam.digests(spark.createDataFrame([], DOCS), item).collect() == []
    blank = spark.createDataFrame([(1, ""), (2, None), (3, "...")], "item_id long, text string")
    same = spark.createDataFrame([(1, "a " * 70_000), (None, None)], DOCS)  # more places of one word than two bytes count
    assert [r.n_hit for r in decontam.matches(same, blank).collect()] == [0, 0]
    assert sorted((r.n_words, r.n_hit) for r in decontam.digests(same, spark.createDataFrame([(1, "a a a")], "item_id long, text string")).collect()) == [(0, 0), (70_000, 70_000)]
    assert sorted(r.doc_id or 0 for r in decontam.without_contaminated(same, item).collect()) == [0, 1]


# licences


def test_licences_against_brute_force(spark):
    rng = random.Random(5)
    lines = [p for p, _ in licences.BASE] + [t for t, _, _ in licences.TEMPLATES] + ["Licensed under CC BY-NC 4.0.", "the MIT\nLicense", "cc by cc by", "mit licenses"]
    docs = [(k, " ".join([invented(rng, rng.randrange(12)), *rng.sample(lines, rng.randrange(3)), invented(rng, 4)])) for k in range(80)] + [(90, None), (91, ""), (92, "cc " * 5000 + "by")]
    got = {r.doc_id: r for r in licences.digests(spark.createDataFrame(docs, DOCS)).collect()}
    for d, text in docs:
        w, places, labels = words(text), [], set()
        for phrase, label in licences.BASE:
            p = phrase.split()
            at = [s for s in range(len(w) - len(p) + 1) if w[s : s + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        r = got[d]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(places), ",".join(sorted(labels)))
        assert (r.first_word, r.last_word) == ((min(places), max(places)) if places else (None, None))
        assert labels <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[90].n_words == 0 and got[90].labels == "" and got[90].score == 0


def brute_labels(text, share=licences.SHARE):
    """Labels and best score: every template at every place, a part of it beyond the text's ends counts as missing."""
    w, labels, best = words(text), set(), 0.0
    for t, label, phrases in [(p, x, (p,)) for p, x in licences.BASE] + [*licences.TEMPLATES, *licences.TEXTS]:
        v = words(t)
        must = set()
        for phrase in map(str.split, phrases):
            at = next(i for i in range(len(v)) if v[i : i + len(phrase)] == phrase)
            must |= {*range(at, at + len(phrase))}
        for s in range(-len(v), len(w)):
            hit = {k for k in range(len(v)) if 0 <= s + k < len(w) and w[s + k] == v[k]}
            score = len(hit) / len(v)
            if must <= hit and score >= (1 if (t, label) in licences.BASE else share):
                labels.add(label)
                best = max(best, score)
    return ",".join(sorted(labels)), best


def test_licence_labels_and_scores_against_brute_force(spark):
    """Whole licence texts and openings, cut at either end and with words altered, between other words."""
    rng = random.Random(15)
    texts = [t for t, _, _ in licences.TEMPLATES + licences.TEXTS] + [p for p, _ in licences.BASE]
    docs = [(0, None), (1, "")]
    for k in range(110):
        w = rng.choice(texts).split()
        for _ in range(rng.choice([0, 1, len(w) // 9, len(w) // 6, len(w) // 4])):
            w[rng.randrange(len(w))] = f"other{k}"
        w = w[rng.choice([0, 0, len(w) // 12]) : len(w) - rng.choice([0, 0, len(w) // 12])]
        docs.append((10 + k, f"{invented(rng, rng.randrange(9))} {' '.join(w)} {invented(rng, rng.randrange(9))}"))
    got = {r.doc_id: (r.labels, r.score) for r in licences.digests(spark.createDataFrame(docs, DOCS)).collect()}
    for d, t in docs:
        labels, best = brute_labels(t)
        assert got[d][0] == labels and abs(got[d][1] - best) < 1e-12, (d, t, got[d], labels, best)
    assert len({x for x, _ in got.values()}) > 12


def test_licence_templates_need_their_key_phrase(spark):
    full = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    docs = [(1, full), (2, full.replace("permitted", "allowed")), (3, full.replace("source", "object")), (4, "Licensed under CC BY-NC 4.0.")]
    got = {r.doc_id: r for r in licences.digests(spark.createDataFrame(docs, DOCS)).collect()}
    assert got[1].labels == "bsd" and got[1].score == 1 and got[2].labels == "bsd" and got[2].score < 1 and got[3].labels == ""
    assert got[4].labels == "cc-by,cc-by-nc-4.0"


# urls


def brute_rule(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest, re.S)[0]
        path = re.match(r"[^?#]*", rest[len(host) :], re.S)[0]
        host = host.translate(LOWER)
    fits = [(h.count("."), len(p), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits) if fits else (0, 0, 0, None, "allow")
    return host, path, best[3], best[4]


def test_urls_against_brute_force(spark):
    rng = random.Random(1)
    hosts = ["com", "Example.com", "www.example.com", "a.www.example.com", "xexample.com", "foo.net", "net", "org", "example.com:80", ""]
    paths = ["", "/", "/en", "/en/", "/en/a/b", "/es/x", "/fr/", "/english/", "?q=/en/", "#/en/", "//en/"]
    pages = [(k, f"{s}{h}{p}") for k, (s, h, p) in enumerate((s, h, p) for s in ("http://", "", "a://b://") for h in hosts for p in paths)] + [(900, None), (901, ""), (902, "http://com/\nx")]
    df = spark.createDataFrame([(i, u, "x") for i, u in pages], "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path, r["rule"], r.verdict) for r in urls.judge(df).collect()}
    assert got == {i: brute_rule(u, urls.RULES) for i, u in pages}
    joined = urls.judge_by_join(df, spark.createDataFrame(urls.RULES, "verdict string, host string, path string"))
    assert {r.page_id: (r.host, r.path, r["rule"], r.verdict) for r in joined.collect()} == got
    rules = [(rng.choice(["allow", "block"]), rng.choice(["com", "net", "www.example.com", "example.com"]), rng.choice(["/", "/e", "/en/", "/en/a", "/es/"])) for _ in range(9)]
    assert {r.page_id: (r.host, r.path, r["rule"], r.verdict) for r in urls.judge(df, rules).collect()} == {i: brute_rule(u, rules) for i, u in pages}
    assert {r.page_id: (r.host, r.path, r["rule"], r.verdict) for r in urls.judge_by_join(df, spark.createDataFrame(rules, "verdict string, host string, path string")).collect()} == {i: brute_rule(u, rules) for i, u in pages}
    odd = [("block", "com", "/e"), ("allow", "example.com", ""), ("block", "WWW.example.com", "/en/a"), ("allow", "net", "/es"), ("block", "\u212aelvin.net", "/")]
    more = pages + [(950, "http://a.com/english"), (951, "http://example.com"), (952, "http://\u212aelvin.net/x")]
    lower = [(v, h.translate(LOWER), p) for v, h, p in odd]
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in more], "page_id long, url string, size string, whole string")
    for out in (urls.judge(df, odd), urls.judge_by_join(df, spark.createDataFrame(odd, "verdict string, host string, path string"))):
        assert {r.page_id: (r.host, r.path, r["rule"], r.verdict) for r in out.collect()} == {i: brute_rule(u, lower) for i, u in more}
        assert out.columns[:4] == df.columns
    assert urls.judge(df.limit(0)).collect() == [] == urls.judge_by_join(df.limit(0), spark.createDataFrame(odd, "verdict string, host string, path string")).collect()
    with pytest.raises(ValueError, match="judge_by_join"):
        urls.judge(df, [("allow", f"h{k}.com", "/") for k in range(urls.MAX_RULES + 1)])


def test_very_long_urls(spark):
    """A path and a host of a million characters are judged whole."""
    pages = [(1, "http://www.example.com/en/" + "a/" * 500_000), (2, "http://example.com/en/" + "b" * 1_000_000), (3, f"http://{'x' * 1_000_000}.net/es/"), (4, "c" * 1_000_000 + "://com/x"), (5, "d" * 1_000_000)]
    got = {r.page_id: (r["rule"], r.verdict, len(r.path)) for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string")).collect()}
    assert got == {1: ("www.example.com/en/", "allow", 1_000_004), 2: ("example.com/en/", "block", 1_000_004), 3: ("net/es/", "block", 4), 4: ("com/", "allow", 2), 5: (None, "allow", 0)}


# pieces


def test_pieces_equal_the_library(spark):
    sentencepiece, tokenizers = pytest.importorskip("sentencepiece"), pytest.importorskip("public_tokenizers")
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(2)
    parts = ["a", "b", " ", "  ", "▁", "é", "漢", "😀", "\n", "\t", "the", "ing", "<0x41>", "<s>", "\x00", "aaaa", "    ", "ﬁ", "00", "ü", "\u0301", "tokenization"]
    texts = ["", " ", " " * 300, "a" * 5000, " " * 1000 + "x", "x" + " " * 77] + ["".join(rng.choices(parts, k=rng.randrange(1, 80))) for _ in range(500)]
    docs = spark.createDataFrame([*enumerate(texts), (9000, None), (9001, "twice"), (9001, "twice")], DOCS)
    coded = pieces.decode(pieces.encode(docs.withColumn("ids", F.lit(1))), text="back").collect()
    assert len(coded) == len(texts) + 3
    for r in coded:
        text = texts[r.doc_id] if r.doc_id < len(texts) else {9000: "", 9001: "twice"}[r.doc_id]
        want = sp.encode(text)
        assert list(r.ids) == want and r.back == sp.decode(want)
    assert pieces.digests(docs.limit(0)).collect() == []


def test_pieces_decode_any_ids():
    sentencepiece, tokenizers = pytest.importorskip("sentencepiece"), pytest.importorskip("public_tokenizers")
    import numpy as np

    sp, m, rng = sentencepiece.SentencePieceProcessor(model_file=tokenizers.path("piece_bpe_32k.model")), pieces.model(None), random.Random(4)
    for _ in range(2000):
        ids = [rng.choice([rng.randint(3, 258), rng.randint(259, 31999), 0, 1, 2]) for _ in range(rng.randint(0, 9))]
        assert m.decode(np.array(ids, np.int64), np.array([0, len(ids)]))[0].decode() == sp.decode(ids)


# audio


def test_crc_and_header():
    assert audio.crc16(b"123456789") == 0xAEE7  # CRC-16/CMS
    h = audio.Header(bytes((0xFF, 0xFB, 0x90, 0x64)))
    assert (h.version, h.layer, h.kbps, h.hz, h.size, h.samples, h.protected) == (1, 3, 128, 44100, 417, 1152, False)
    assert not audio.Header(b"\xff\xff\xff\xff").ok and not audio.Header(b"\x00\x00\x00\x00").ok


def test_audio_round_trip(spark):
    rng = random.Random(6)
    texts = ["", "x", "y" * 64, "z" * 65, "é" * 1000, "".join(chr(rng.randrange(32, 9000)) for _ in range(20_000)), "\xff\xfb" * 500]
    docs = spark.createDataFrame([*enumerate(texts), (50, None), (50, None)], DOCS)
    got = sorted(audio.digests(docs).collect(), key=lambda r: r.doc_id)
    for r in got:
        raw = (texts[r.doc_id] if r.doc_id < 50 else "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
    whole = audio.inspect(audio.store(docs.withColumn("media", F.lit(3)))).where("doc_id = 5").first()
    assert hashlib.sha256(whole.media).hexdigest() == got[5].media_sha256 and whole.crc_wrong == 0 and whole.crc_checked == whole.vbr_frames + 1
    assert whole.samples == 1152 * whole.vbr_frames == 1152 * len(whole.frame_offsets) and whole.duration_us == whole.samples * 1_000_000 // 32_000
    assert audio.digests(docs.limit(0)).collect() == []


def test_audio_resynchronises_and_reads_tags():
    stream = audio.write_stream(bytes(range(256)) * 40)
    base = audio.read_stream(stream)
    at = base["offsets"][3]
    broken = audio.read_stream(stream[:at] + b"\xff\x00junk\xff\xfb" + stream[at:])
    assert broken["samples"] == base["samples"] and broken["skipped"] == 8 and broken["data"] == base["data"]
    flipped = bytearray(stream)
    flipped[at + 8] ^= 1  # in the side information
    assert audio.read_stream(bytes(flipped))["wrong"] == 1
    tagged = stream + b"APETAGEX" + (2000).to_bytes(4, "little") + (32).to_bytes(4, "little") + bytes(16) + b"TAG" + b"A title".ljust(125, b"\0")
    assert audio.read_stream(tagged)["tags"]["TIT2"] == "A title" and audio.read_stream(tagged)["samples"] == base["samples"]
    assert base["table"]["frames"] == len(base["offsets"]) and len(base["table"]["toc"]) == 100
    assert audio.read_stream(b"")["samples"] == 0 and audio.read_stream(b"\xff" * 99)["samples"] == 0


def plain_crc(bits):
    """CRC-16 with polynomial 8005 over a string of 0 and 1, as a long division of polynomials."""
    rest = [int(b) for b in bits] + [0] * 16
    rest[:16] = [b ^ 1 for b in rest[:16]]
    for i in range(len(bits)):
        if rest[i]:
            for k in (0, 1, 14, 16):
                rest[i + k] ^= 1
    return int("".join(map(str, rest[-16:])), 2)


def test_crc_of_layers_one_and_two():
    """Frames with random allocations; the covered bits are counted by a plain walk over the standard's tables."""
    rng = random.Random(17)
    two = {27: [4] * 11 + [3] * 12 + [2] * 4, 30: [4] * 11 + [3] * 12 + [2] * 7, 8: [4] * 2 + [3] * 6, 12: [4] * 2 + [3] * 10, 0: [4] * 4 + [3] * 7 + [2] * 19}
    cases = [(0xFE, 0xC4, 32, 1, 27), (0xFE, 0x54, 0, 1, 0), (0xFC, 0x84, 0, 2, 27), (0xFC, 0xA0, 0, 2, 30), (0xFC, 0x18, 0, 2, 12), (0xFC, 0x20, 0, 2, 8), (0xF4, 0x80, 0, 2, 0)]
    for second, third, _, layer, limit in cases:
        for mode in (0x00, 0x60, 0x40, 0xC0):
            head = bytes((0xFF, second, third, mode))
            h = audio.Header(head)
            assert h.ok and h.layer == layer and h.protected
            channels, bound = (1 if mode == 0xC0 else 2), {0x60: 12, 0x40: 4}.get(mode, 32)
            if layer == 2:
                each = h.kbps / channels
                key = 0 if h.version != 1 else (12 if h.hz == 32000 else 8) if each <= 48 else 27 if h.hz == 48000 or each < 96 else 30
            body = bytes(rng.choice([0, rng.randrange(256)]) for _ in range(h.size - 6))
            bits = "".join(f"{b:08b}" for b in body)
            if layer == 1:
                n = sum(4 * (channels if k < bound else 1) for k in range(32))
            else:
                at, chosen = 0, 0
                for k, w in enumerate(two[key]):
                    for _ in range(channels if k < bound else 1):
                        chosen += (int(bits[at : at + w], 2) > 0) * (channels if k >= bound else 1)
                        at += w
                n = at + 2 * chosen
            crc = plain_crc("".join(f"{b:08b}" for b in head[2:]) + bits[:n])
            frame = head + crc.to_bytes(2, "big") + body
            found = audio.read_stream(frame * 3)
            assert (found["checked"], found["wrong"], len(found["offsets"]), found["samples"]) == (3, 0, 3, 3 * (384 if layer == 1 else 1152)), (second, third, mode)
            flipped = bytearray(frame * 3)
            flipped[h.size + 6] ^= 0x80
            assert audio.read_stream(bytes(flipped))["wrong"] == 1


def test_variable_bitrate_tables():
    """A VBRI table's groups of frames, and an MPEG-2 stream; frames are found by a walk with their known sizes."""
    sizes = [(104, 1), (208, 4), (417, 9), (208, 4)] * 6  # 44.1 kHz without padding, by bitrate index
    frames = [bytes((0xFF, 0xFB, i << 4, 0xC0)) + bytes(n - 4) for n, i in sizes]
    groups = [sum(len(f) for f in frames[k : k + 4]) for k in range(0, 24, 4)]
    vbri = b"VBRI" + (1).to_bytes(2, "big") + bytes(4) + sum(map(len, frames)).to_bytes(4, "big") + (24).to_bytes(4, "big") + (6).to_bytes(2, "big") + (1).to_bytes(2, "big") + (2).to_bytes(2, "big") + (4).to_bytes(2, "big") + b"".join(g.to_bytes(2, "big") for g in groups)
    first = (bytes((0xFF, 0xFB, 0x90, 0xC0)) + bytes(32) + vbri).ljust(417, b"\0")
    found = audio.read_stream(first + b"".join(frames))
    starts = np.append(0, np.cumsum([len(f) for f in frames]))[:-1] + 417
    assert found["table"]["kind"] == "VBRI" and found["table"]["frames"] == 24 and found["offsets"] == starts.tolist() and found["samples"] == 24 * 1152
    assert [417 + p for p in audio.seek_points(found["table"])] == starts[::4].tolist()
    low = bytes((0xFF, 0xF3, 0x80, 0xC0)) + bytes(204)  # MPEG-2, 64 kbit/s, 22.05 kHz
    found = audio.read_stream(b"junk" + low * 5)
    assert found["samples"] == 5 * 576 and found["hz"] == 22050 and found["skipped"] == 4
    own = audio.read_stream(audio.write_stream(bytes(range(256)) * 90))
    points, total = audio.seek_points(own["table"]), own["table"]["bytes"]
    step = total / 256
    for k in range(100):
        real = own["offsets"][k * len(own["offsets"]) // 100] - own["offsets"][0]
        assert real - step <= points[k] <= real


def test_altered_licence_templates_against_brute_force():
    """Any words outside the key phrases may be altered, also all of the rarest ones."""
    rng = random.Random(12)
    for seed in range(6):
        index = licences.Index()
        rng.seed(seed)
        index.weigh(1000, {int(h): rng.randrange(900) for h in index.vocab.view(np.int64)})
        for k, want in enumerate(index.terms[len(licences.BASE) :], len(licences.BASE)):
            free = np.flatnonzero(~index.must[k])
            for r in [free[np.isin(free, index.rare[k])], *(np.array(rng.sample(free.tolist(), rng.randrange(len(free) + 1)), int) for _ in range(8))]:
                term = np.concatenate([[-1, -1], want, [-1]])
                term[2 + r] = -1
                score = (len(want) - len(r)) / len(want)
                row, start, found = index.scan(term, np.array([0, len(term)]), licences.SHARE)[k]
                assert list(zip(row, start, found)) == ([(0, 2, score)] if score >= licences.SHARE else [])
