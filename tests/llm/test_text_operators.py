"""Operators of the llm subpackage against brute-force versions, the libraries and round trips."""

import time
import hashlib
import json
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from tokenizers import Tokenizer

from cityjobs.llm import decontam, media, pieces, ppm, queries, simhash, token_store, warc
from cityjobs.llm.common import prepare, scratch

ODD = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today"),
    (2, "The quick brown fox jumps over the lazy dog near the old river bank today"),
    (2, "The quick brown fox jumps over the lazy dog near the old river bank today"),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (6, "  two  spaces\nand\ttabs ▁ mark "),
    (7, "é ü ß ﬁ Ａ x́ \U0001f600  nbsp em"),
    (8, "one"),
    (9, "<s> it's I'LL 123 <|endoftext|> </s>"),
    (10, "\x00nul \x1c sep \x85 next"),
    (11, "word " * 3000),
    (12, "x" * 5000),
    (13, "Ça va? " * 40),
]


@pytest.fixture(scope="module")
def docs(spark):
    prepare(spark)
    rows = [(i, t, "en", "s", 0 if t is None else len(t)) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def split(text):
    return re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow_fingerprint(text):
    words = split(text)
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(docs):
    for row in simhash.fingerprints(docs.where("doc_id <> 11")).collect():
        texts = [t for i, t in ODD if i == row["doc_id"]]
        assert row["fp"] & (2**64 - 1) == slow_fingerprint(texts[0])


def slow_components(fps):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(fps))]


@pytest.mark.parametrize("split_at", [2048, 40])
def test_links_connect_all(spark, split_at):
    prepare(spark)
    rng = np.random.default_rng(1)
    fps = [int(x) for x in rng.integers(0, 1 << 63, 150, dtype=np.uint64)]
    for _ in range(250):  # chains and dense groups
        fps.append(fps[int(rng.integers(120, len(fps)))] ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 6)), replace=False)))
    fps = sorted(set(fps) | {0})
    want = slow_components(fps)
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    edges = simhash.links(df, split=split_at)
    assert edges.where("bit_count(a ^ b) > 4").count() == 0
    roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    groups, got = defaultdict(set), defaultdict(set)
    for f, w in zip(fps, want):
        groups[w].add(f)
        got[roots.get(simhash.signed(f), simhash.signed(f))].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))


def test_components_name_their_roots_too(spark):
    prepare(spark)
    edges = spark.createDataFrame([(7, 3), (7, 9), (-4, 2), (5, 5), (9, 3)], "a long, b long")
    rows = sorted(tuple(r) for r in simhash.components(edges).select("node", "root").collect())
    assert rows == [(-4, -4), (2, -4), (3, 3), (7, 3), (9, 3)]


def test_near_duplicates_and_edges(spark, docs):
    rows = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert {(1, 1), (2, 1), (3, 3), (4, 3), (5, 3)} <= rows
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect() if r["doc_id"] < 6) == [1, 3]


def test_op1_query_on_odd_rows_and_near_copies(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, t) for i, t in ODD if i != 11] + [(None, "Ça va? " * 40), (-7, "\x0b \x0c")]
    for k in range(60):
        words = [f"w{i}" for i in range(300)]
        words[int(rng.integers(300))] = f"q{k}"
        rows.append((100 + k, " ".join(words)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    fps = [slow_fingerprint(t) for _, t in rows]
    group = slow_components(fps)
    least = {g: min((r[0] for r, h in zip(rows, group) if h == g and r[0] is not None), default=None) for g in group}
    assert len(set(fps)) > 10 + len(set(group))
    want = sorted((str(r[0]), f"{f:016x}", str(least[g])) for r, f, g in zip(rows, fps, group))
    got = queries.op1_simhash(spark, str(tmp_path)).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got) == want


def slow_ppm(train, texts):
    count = defaultdict(Counter)
    for t in train:
        data = bytes(5) + t + b"\n"
        for i in range(5, len(data)):
            for k in range(6):
                count[data[i - k : i]][data[i]] += 1

    def cost(context, s):
        excluded, total = set(), 0.0
        for k in range(5, -1, -1):
            seen = {x: n for x, n in count[context[5 - k :]].items() if x not in excluded}
            if not seen:
                continue
            t = sum(seen.values())
            if s in seen:
                return total + math.log10((2 * seen[s] - 1) / (2 * t))
            total += math.log10(len(seen) / (2 * t))
            excluded |= set(seen)
        return total - math.log10(252 - len(excluded))

    out = []
    for t in texts:
        data = bytes(5) + t + b"\n"
        out.append(sum(cost(data[i - 5 : i], data[i]) for i in range(5, len(data))))
    return out, cost


def test_ppm_against_byte_by_byte(docs):
    got = ppm.score_documents(docs).collect()
    assert len(got) == len(ODD)
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    canonical = {i: " ".join(split(t)).encode() for i, t in ODD}
    train = [canonical[i] for i, _ in ODD if not held(i)]
    want, cost = slow_ppm(train, [canonical[i] for i, _ in ODD])
    want = {i: w for (i, _), w in zip(ODD, want)}
    words = Counter(w for t in train for w in t.split(b" ") if w)
    words_n, kinds = sum(words.values()) + len(train), len(words) + 1
    for r in got:
        assert r["held_out"] == held(r["doc_id"])
        assert r["score"] == pytest.approx(want[r["doc_id"]], rel=1e-6)
        own = [w for w in canonical[r["doc_id"]].split(b" ") if w]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own) + 1, sum(words[w] > 0 for w in own) + 1, words_n)
        base = sum(math.log10((n + 0.5) / (words_n + 0.5 * (kinds + 1))) for n in [words[w] for w in own] + [len(train)])
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
    symbols = [b for b in range(256) if b not in (9, 11, 12, 13)]
    assert sum(10 ** cost(b" the ", s) for s in symbols) == pytest.approx(1)


def test_ppm_long_texts_and_nothing(spark, docs, monkeypatch):
    assert ppm.score_documents(docs.limit(0)).count() == 0
    whole = {(len(s), h) for s, h in [(b"", 0)]}
    text = b"ab cd " * 50
    keys = ppm.codes(ppm.segments(text))[0]
    monkeypatch.setattr(ppm, "PIECE", 40)
    cut = ppm.segments(text)
    assert len(cut) > 3 and whole
    assert np.array_equal(ppm.codes(cut)[0], keys)
    assert len(ppm.words(cut)[0]) == 100 and len(set(ppm.words(cut)[0].tolist())) == 2


def test_sentencepiece_is_the_library(docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = pieces.digests(docs, path).collect()
    assert len(got) == len(ODD)
    texts = dict(ODD)
    for r in got:
        ids = model.encode(texts[r["doc_id"]] or "", add_bos=True, add_eos=True)
        assert r["n_tokens"] == len(ids), texts[r["doc_id"]]
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(model.decode(ids).encode()).hexdigest()


def test_token_store_is_the_library(spark, docs):
    path, out = public_tokenizers.path("word_bpe_49k.json"), scratch(spark, "t")
    tokenizer = Tokenizer.from_file(path)
    token_store.write_tokens(docs, out, path)
    got = sorted(token_store.digests(token_store.read_tokens(spark, out)).collect())
    start = 0
    for r, (doc_id, text) in zip(got, sorted(ODD, key=lambda x: (x[0], x[1] or ""))):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (doc_id, start, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    token_store.write_tokens(docs.limit(0), out + "0", path)
    assert token_store.read_tokens(spark, out + "0").count() == 0


def test_media_round_trip(docs):
    texts = dict(ODD)
    for r in media.digests(docs).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        pad = raw + b"\xff" * ((-len(raw)) % 576 or (0 if raw else 576))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(pad)) and len(pad) % 576 == 0
        assert r["payload_sha256"] == hashlib.sha256(pad).hexdigest() and r["tail_crc32"] == zlib.crc32(pad[-32:])
    row = media.media(docs.where("doc_id = 11")).first()
    assert media.read(row["wav"]).rstrip(b"\xff") == ("word " * 3000).encode()
    assert row["pair_times"] == sorted(row["pair_times"]) and len(row["pair_times"]) == len(row["pair_codes"]) > 0
    tone = (128 + 100 * np.sin(2 * np.pi * 36 * np.arange(5760) / 576)).astype(np.uint8)
    assert set(media.peaks(tone)[:, 0]) == {36}


def test_media_short_unequal_texts_have_unequal_features(spark):
    rng = np.random.default_rng(3)
    words = "the quick brown fox jumps over a lazy dog near old river banks while seven grey cats sleep".split()
    texts = [" ".join(rng.choice(words, n)) for n in (4, 6, 8, 12, 20, 40, 60, 90) for _ in range(20)] + ["", "x" * 576, "y" * 288 + "x" * 288]
    assert max(map(len, texts)) <= 576 and len(set(texts)) == len(texts)
    rows = media.digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len({r["feature"] for r in rows}) == len(texts)


def test_warc_records(spark):
    page = '<html><head><title>A &amp; B</title><script>x="<p>"</script></head><body><p>One<b>two</b><p>Three &lt;<a href="/x?a=1&amp;b=2">go</a></body>'
    pages = spark.createDataFrame([(1, "http://a/\r\nX: y", page), (2, None, None), (2, None, None)], "page_id long, url string, html string")
    rows = warc.derivatives(pages).collect()
    assert len(rows) == 6 and len({r["record_id"] for r in rows}) == 4
    by = {r["record_type"]: r for r in rows if r["page_id"] == 1}
    source = warc.response(1, "http://a/X: y", page.encode(), "1970-01-01T00:00:00Z")
    for r in by.values():
        assert r["refers_to"] == source["fields"]["WARC-Record-ID"] and r["source_digest"] == warc.digest(page.encode())
        head, _, block = bytes(r["record"]).partition(b"\r\n\r\n")
        block = block[:-4]
        assert len(block) == r["content_length"] and warc.digest(block) == r["block_digest"]
        assert head.startswith(b"WARC/1.0\r\nWARC-Type: " + r["record_type"].encode())
    text = bytes(by["conversion"]["record"]).partition(b"\r\n\r\n")[2][:-4].decode()
    assert text == "Onetwo\nThree <go"
    found = json.loads(bytes(by["metadata"]["record"]).partition(b"\r\n\r\n")[2])
    html = found["Envelope"]["Payload-Metadata"]["HTTP-Response-Metadata"]["HTML-Metadata"]
    assert html == {"Title": "A & B", "Links": [{"path": "A@/href", "url": "/x?a=1&b=2"}]}


def slow_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_decontamination_against_alignment(spark):
    prepare(spark)
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdeé"), int(rng.integers(2, 8))))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [prose(n) for n in (12, 20, 30, 45)] + ["abc", ""]
    rows = []
    for i in range(160):
        item = list(items[i % 4])
        for _ in range(int(rng.integers(0, len(item) // 6))):
            at = int(rng.integers(0, len(item)))
            item[at : at + int(rng.integers(0, 2))] = list("xyz"[: int(rng.integers(0, 2))])
        rows.append((i, prose(int(rng.integers(0, 60))) + " " + "".join(item) + " " + prose(int(rng.integers(0, 60)))))
    rows += [(200, None), (201, ""), (202, items[0]), (203, "x ABC y"), (204, items[1] + "\n" + items[2].upper())]
    bench = spark.createDataFrame([*enumerate(items), (9, None)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    block = decontam.Items(list(range(4)), [decontam.canonical(t.encode()) for t in items[:4]])
    want = {}
    for doc_id, text in rows:
        for i in range(4):
            d = slow_distance(block.texts[i], decontam.canonical((text or "").encode()))
            if d <= block.edits[i]:
                want[doc_id, i] = d
    assert len(want) > 80
    assert {k: v for k, v in got.items() if k[1] != 4} == want
    assert [k for k in got if k[1] == 4 and k[0] >= 200] == [(203, 4)]


def test_long_items_with_few_edits_take_time_in_proportion():
    rng = np.random.default_rng(8)
    took = []
    for n in (6_000, 24_000):
        item = " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(n // 7)).encode()
        text = b"xx yy " * 10 + item[: n // 2] + b"Z" + item[n // 2 + 1 :] + b" zz ww" * 10
        start = time.perf_counter()
        found = decontam.search([decontam.canonical(text)], decontam.Items([1], [decontam.canonical(item)]))
        took.append(time.perf_counter() - start)
        assert found == [(0, 0, 1, 60, 60 + len(item))]
    assert took[1] < 9 * took[0]


def slow_peaks(samples, frame, hop, points):
    """The strongest local maxima of each frame by the transform's own sum, one frequency after the other."""
    out = []
    for lo in range(0, len(samples) - frame + 1, hop):
        x = [(v - 128.0) * (0.5 - 0.5 * math.cos(2 * math.pi * k / (frame - 1))) for k, v in enumerate(samples[lo : lo + frame])]
        size = [round(abs(sum(v * complex(math.cos(2 * math.pi * f * k / points), -math.sin(2 * math.pi * f * k / points)) for k, v in enumerate(x))), media.DIGITS) for f in range(points // 2 + 1)]
        local = [(-size[f], f) for f in range(1, points // 2) if size[f - 1] < size[f] >= size[f + 1] and size[f] > media.FLOOR]
        out.append(([f for _, f in sorted(local)] + [-1] * 3)[:3])
    return out


def slow_pairs(found, least):
    """(time, code): each peak of a frame with the strongest of the next three frames, from `least` frames on."""
    return sorted((t, a << 20 | found[t + d][0] << 8 | d) for t in range(len(found)) for d in range(least, 4) if t + d < len(found) for a in found[t] if a >= 0 and found[t + d][0] >= 0)


@pytest.mark.parametrize("text", ["", "ab", "Grüezi mitenand, das isch en churze Text.", "some words and more of them " * 50])
def test_landmarks_are_those_of_plain_sums(text):
    samples = media.padded(text.encode())
    want = [(t * 9, c) for t, c in slow_pairs(slow_peaks(samples, 576, 288, 576), 1)]
    quiet = [128] * 32 + [128 if v == 255 else v for v in samples] + [128] * 32
    want += [(t, c | 128) for t, c in slow_pairs(slow_peaks(quiet, 64, 32, 576), 0)]
    times, codes = media.landmarks(np.frombuffer(samples, np.uint8))
    assert list(zip(times.tolist(), codes.tolist())) == sorted(want)
    assert len(want) > 10 or len(text) < 3


def test_long_payloads_have_long_frames_alone(spark):
    samples = np.frombuffer(media.padded(b"words of a text " * 400), np.uint8)
    times, codes = media.landmarks(samples)
    assert len(samples) > 8 * 576 and len(times) and not (times % 9).any() and not (codes & 128).any()
    rows = media.digests(spark.createDataFrame([(1, "words of a text " * 400), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert rows[0]["pair_times"] == times.tolist() and rows[0]["pair_codes"] == codes.tolist() and rows[1]["pair_times"] == []
    key = xxhash.xxh64(times.astype("<i4").tobytes() + codes.astype("<i8").tobytes()).hexdigest()
    assert rows[0]["feature"].endswith(f"pairs={len(times)};xxh64={key}")
