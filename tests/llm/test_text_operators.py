"""BPE, sharding, quality, SimHash, repeats, packing against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from labelforge.llm import bpe, packing, quality, repeats, sharding, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


# ---- BPE

def test_bpe_matches_the_tokenizer(docs, texts, tokenizer):
    tok = Tokenizer.from_str(tokenizer)
    got = Counter((r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["decoded"]) for r in bpe.encode_decode(docs, tokenizer).collect())
    want = Counter()
    for i, t in texts:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want[(i, len(ids), np.array(ids, "<u4").tobytes(), tok.decode(ids, skip_special_tokens=False))] += 1
    assert got == want


def test_bpe_empty_table(empty, tokenizer):
    assert bpe.encode_decode(empty, tokenizer).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_joins_are_repaired_wherever_chunks_end(tokenizer, seed):
    r, c, tok = random.Random(seed), bpe.codec(tokenizer), Tokenizer.from_str(tokenizer)
    pool = ["the", " ", "  ", "\n", "'s", "é", "日", "<|endoftext|>", "1", "!", "tion", "\xa0", "\x85", "a"]
    for _ in range(60):
        t = "".join(r.choice(pool) for _ in range(r.randint(1, 60)))
        cuts = sorted({0, len(t), *(r.randint(0, len(t)) for _ in range(4))})
        at = [len(t[:x].encode()) for x in cuts]
        known = [(a, b - a, c.encode([t.encode()[a:b]])[0]) for a, b in zip(at, at[1:]) if b > a and r.random() < 0.7]
        assert bpe.stitch(c, t.encode(), known).tolist() == tok.encode(t, add_special_tokens=False).ids


def test_chunks_depend_on_content_only():
    r = random.Random(1)
    shared = bytes(r.choice(b"abcdefgh ") for _ in range(20000))
    a, b = b"x" * 777 + shared, bytes(r.choice(b"xyz") for _ in range(3001)) + shared
    cut = lambda t: {t[x:y] for x, y in zip([0, *bpe.chunk_bounds(t)], bpe.chunk_bounds(t))}
    assert len(cut(a) & cut(b)) > 5
    assert bpe.chunk_bounds(a, block=4096) == bpe.chunk_bounds(a)
    assert bpe.chunk_bounds(b"") == []


# ---- sharding

@pytest.mark.parametrize("shards", [1, 3, 16])
def test_shards_are_balanced_and_gapless(docs, texts, shards):
    got = sharding.shard(docs, shards).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(texts)
    for r in got:
        b = (r["text"] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(b) + 1, zlib.crc32(b))
    size = Counter()
    for s in range(shards):
        rows = [r for r in got if r["shard"] == s]
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
        size[s] = sum(r["size"] for r in rows)
    largest = max(r["size"] for r in got)
    assert max(size.values()) - sum(size.values()) / shards <= largest


def test_bytes_near_equal_and_large_groups_split(spark):
    rows = [(i, "same text " * 20) for i in range(2000)] + [(10000 + i, f"text {i} " * (i % 40 + 1)) for i in range(4000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 16, cell_rows=100).toPandas()
    b = got.groupby("shard")["size"].sum()
    assert len(b) == 16 and b.max() / b.min() < 1.03
    for _, x in got.groupby("shard"):
        assert sorted(x.slot) == list(range(len(x)))


def test_shards_of_nothing(empty):
    assert sharding.shard(empty, 16).count() == 0


# ---- quality

def base(t):
    t = t or ""
    ws = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    win = Counter(tuple(ws[k:k + 8]) for k in range(len(ws) - 7))
    cov = {j for k in range(len(ws) - 7) if win[tuple(ws[k:k + 8])] > 1 for j in range(k, k + 8)}
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), dup, len(cov),
            len(ws) < 20 or 100 * len(cov) > 30 * len(ws))


def test_quality_counts_and_score(spark, docs, texts):
    trusted = [i for i in range(0, 30)]
    labels = spark.createDataFrame([(i,) for i in trusted], "doc_id long")
    got = quality.judge(docs, labels).select(
        "doc_id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", F.col("kept")).collect()
    gram = lambda w: xxhash.xxh64_intdigest(w[-3:].encode(), 42)
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    raw, target = Counter(), Counter()
    for i, t in texts:
        for w in WORD.findall(t or ""):
            at = signed(gram(w)) % quality.BUCKETS
            raw[at] += 1
            target[at] += i in trusted
    n, m, k = sum(raw.values()), sum(target.values()), quality.BUCKETS
    share = lambda c, total: (c + quality.SMOOTHING * total / k) / (total + quality.SMOOTHING * total)
    weight = lambda w: np.log(share(target[signed(gram(w)) % k], m) / share(raw[signed(gram(w)) % k], n))
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(texts)
    for r in got:
        assert tuple(r)[2:8] == base(r["text"]), r["doc_id"]
        ws = WORD.findall(r["text"] or "")
        want = sum(map(weight, ws)) / len(ws) if ws else 0.0
        assert r["score"] == pytest.approx(want, abs=1e-9)
        assert r["kept"] == (not r["base_failed"] and r["score"] >= quality.THRESHOLD)


def test_quality_without_trusted_or_rows(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long")
    got = quality.judge(docs, none).collect()
    assert all(r["kept"] == (not r["base_failed"]) for r in got)
    assert quality.judge(empty, none).count() == 0
    kept = quality.keep_good(docs, none)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)


# ---- SimHash

def test_simhash_components(docs, texts):
    fps = []
    for i, t in texts:
        ws = WORD.findall(lower(t or ""))
        sh = [" ".join(ws[k:k + 4]) for k in range(max(1, len(ws) - 3))] if ws else []
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    comp = components(fps, [i for i, _ in texts], 4)
    want = Counter((i, format(f, "016x"), c) for (i, _), f, c in zip(texts, fps, comp))
    got = Counter(tuple(r) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(set(comp))


def components(fps, ids, most):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= most:
                root[find(a)] = find(b)
    least = {}
    for x, i in enumerate(ids):
        if i is not None:
            least[find(x)] = min(i, least.get(find(x), i))
    return [least.get(find(x)) for x in range(len(fps))]


@pytest.mark.parametrize("most", [3, 4])
def test_crowded_buckets_lose_no_link(spark, most, monkeypatch):
    """A chain of near fingerprints, far more than a bucket compares in pairs."""
    r = random.Random(5)
    start, fps = r.getrandbits(64), []
    for c in range(3):
        f = start ^ (((1 << 20) - 1) << (20 * c))
        for _ in range(60):
            fps.append(f)
            for b in r.sample(range(64), most):
                f ^= 1 << b
    fps += [r.getrandbits(64) for _ in range(200)]
    monkeypatch.setattr(simhash, "PAIRWISE", 4)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame(list(enumerate(signed)), "doc_id long, _fp long")
    got = {r["_fp"]: r["component_id"] for r in simhash.components(df, most).collect()}
    assert [got[s] for s in signed] == components(fps, list(range(len(fps))), most)


def test_simhash_of_nothing(empty):
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one(empty).count() == 0


@pytest.mark.parametrize("n", [10, 10**4, 10**6, 10**9])
def test_thresholds_satisfy_the_pigeonhole_principle(n):
    for m in (2, 3, 4, 5):
        widths = [64 // m + (i < 64 % m) for i in range(m)]
        _, t = simhash.allocate(widths, [n * n / 2 ** (w + 1) for w in widths], n, 4)
        assert sum(t) == 4 - m + 1 and min(t) >= -1


# ---- repeats

def removed(rows, least=50):
    key = lambda i: (1, 0) if i is None else (0, i)
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - least + 1):
            w = b[p:p + least]
            first[w] = min(first.get(w, key(i)), key(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - least + 1):
            if first[b[p:p + least]] < key(i):
                gone[p:p + least] = b"\x01" * least
        out.append((i, len(b), bytes(x for x, g in zip(b, gone) if not g),
                    tuple((m.start(), m.end() - m.start()) for m in re.finditer(rb"\x01+", bytes(gone)))))
    return Counter(out)


@pytest.mark.parametrize("block_bytes", [1 << 22, 20_000])
def test_repeats_are_removed_exactly(docs, texts, block_bytes):
    got = Counter((r["doc_id"], r["n_bytes"], bytes(r["kept"]), tuple((s["start"], s["length"]) for s in r["spans"]))
                  for r in repeats.remove_repeats(docs, block_bytes=block_bytes).collect())
    assert got == removed(texts)


def test_repeats_random_small_alphabet(spark):
    r = random.Random(3)
    pieces = ["".join(r.choice("ab ") for _ in range(r.randint(20, 120))) for _ in range(12)]
    rows = [(i, "".join(r.choice(pieces) for _ in range(r.randint(0, 6)))) for i in range(120)]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=4000)
    assert Counter((x["doc_id"], x["n_bytes"], bytes(x["kept"]), tuple((s["start"], s["length"]) for s in x["spans"]))
                   for x in got.collect()) == removed(rows)


def test_runs_of_a_text_do_not_depend_on_its_neighbours(monkeypatch):
    r = random.Random(0)
    monkeypatch.setattr(repeats, "SLICE", 3000)
    some = [bytes(r.choice(b"abc ") for _ in range(r.choice([0, 10, 49, 50, 51, 200, 2950, 3001, 9000]))) for _ in range(40)]

    def runs(ts):
        x = repeats.Runs(ts)
        start = x.ends - [len(t) for t in ts]
        assert (x.last - x.first + 1).sum() == sum(max(0, len(t) - 49) for t in ts)
        return Counter((ts[k], int(a - start[k]), int(b - start[k]), int(h)) for a, b, h, k in zip(x.first, x.last, x.hash, x.text))
    want = runs(some)
    for _ in range(3):
        r.shuffle(some)
        assert runs(some) == want


def test_maximal_repeats_have_all_occurrences():
    r = random.Random(2)
    some = ["".join(r.choice("ab") for _ in range(30)).encode() for _ in range(40)]
    got = set()
    for size, whose, offset in repeats.maximal_repeats(some, 10):
        at = list(zip(whose.tolist(), offset.tolist()))
        s = some[at[0][0]][at[0][1]:at[0][1] + size]
        every = [(k, p) for k, t in enumerate(some) for p in range(len(t) - size + 1) if t[p:p + size] == s]
        assert sorted(at) == every
        got.add(s)
    windows = Counter(t[p:p + 10] for t in some for p in range(21))
    assert {w for w, n in windows.items() if n > 1} <= {s[p:p + 10] for s in got for p in range(len(s) - 9)}


def test_repeats_as_stage_and_empty(docs, empty):
    out = repeats.keep_first(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    rows = out.collect()
    assert len(rows) == docs.count() and all(r["_text"] == "other" and r["slot"] == 7 for r in rows)
    assert [r["text"] for r in rows if r["doc_id"] == 500] == [None]
    assert all(r["n_chars"] == len(r["text"]) for r in rows if r["text"] is not None)
    assert repeats.remove_repeats(empty).count() == 0 and repeats.keep_first(empty).count() == 0


# ---- packing

def test_pieces_and_sequences(docs, texts, tokenizer):
    tok = Tokenizer.from_str(tokenizer)
    got = packing.pack(docs, tokenizer).collect()
    want = Counter()
    for i, t in texts:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        first = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        starts = [0, *range(first, len(ids), 1024)]
        for k, (x, y) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            want[(i, k, x, y - x, zlib.crc32(np.array(ids[x:y], "<u4").tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    room = {}
    for r in got:
        room.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in room.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r["length"] for r in got)
    assert len(room) <= -(-total // 1024) + 2


def test_packing_of_nothing(empty, tokenizer):
    assert packing.pack(empty, tokenizer).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_configurations_hold_each_piece_once(seed):
    r = np.random.default_rng(seed)
    count = np.zeros(1025, np.int64)
    np.add.at(count, r.integers(1, [1025, 300, 60, 1025][seed], [50, 5000, 20000, 100000][seed]), 1)
    configs = packing.configurations(count)
    held = np.zeros(1025, np.int64)
    for c, n in configs:
        assert sum(a * b for a, b in c.items()) <= 1024
        for a, b in c.items():
            held[a] += b * n
    assert (held == count).all()
    bound = -(-int((count * np.arange(1025)).sum()) // 1024)
    assert sum(n for _, n in configs) <= max(1.01 * bound + 2, sum(packing.best_fit(count, 1024).values()) + 1)


def test_pricing_is_an_exact_knapsack():
    r = random.Random(1)
    for _ in range(20):
        price = np.zeros(31)
        for n in r.sample(range(1, 31), 6):
            price[n] = r.random() * n
        best = [0.0] * 31
        for room in range(1, 31):
            best[room] = max([best[room - 1], *(best[room - n] + price[n] for n in range(1, room + 1) if price[n])])
        got = packing.best_configuration(price, 30)
        assert sum(n * k for n, k in got.items()) <= 30
        assert sum(price[n] * k for n, k in got.items()) == pytest.approx(best[30])


def test_ids_equal_those_of_the_tokenizer(tokenizer):
    tok, ids_of, r = Tokenizer.from_str(tokenizer), packing.encoder(tokenizer), random.Random(3)
    pool = [chr(c) for c in [*range(32, 127), 9, 10, 13, 0, 0x85, 0xA0, 0x3000, 0x200B, 0xE9, 0x301, 0x65E5, 0x1F600, 0x660, 0xB2]]
    for _ in range(2000):
        t = "".join(r.choice(pool) if r.random() < 0.5 else r.choice([" ", "the", "'s", "<|endoftext|>", "\n"]) for _ in range(r.randint(0, 40)))
        assert ids_of(t.encode()).tolist() == tok.encode(t, add_special_tokens=False).ids
    long = " ".join(r.choice(["the", "of", "tion"]) for _ in range(400000))
    assert ids_of(long.encode()).tolist() == tok.encode(long, add_special_tokens=False).ids


def test_sha_of_ids_is_little_endian():
    assert hashlib.sha256(np.array([1, 258], "<u4").tobytes()).digest() == hashlib.sha256(b"\1\0\0\0\2\1\0\0").digest()
