"""Repeated rows in shards, crowded anchors, the graph's audit, long texts, and the
digests of the registered queries."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from labelforge.llm import bpe, neardup, queries, repeats, sharding

from .conftest import prose
from .test_text_operators import removed

SMALL = "/root/testdata/sf0.001"


# ---- op1

def test_texts_over_a_mebibyte(spark, tokenizer):
    r = random.Random(8)
    words = [prose(i, 1) for i in range(500)]
    long = " ".join(r.choice(words) for _ in range(340_000))
    assert len(long.encode()) > 2 * bpe.CALL_BYTES
    rows = [(1, long), (2, "x" * (bpe.CALL_BYTES + 5)), (3, long[:400_000] + "é" + long[400_000:]), (4, "\n \t" * 500_000)]
    tok = Tokenizer.from_str(tokenizer)
    got = {x["doc_id"]: x for x in bpe.encode_decode(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer).collect()}
    for i, t in rows:
        ids = tok.encode(t, add_special_tokens=False).ids
        assert bytes(got[i]["ids"]) == np.array(ids, "<u4").tobytes() and got[i]["n_tokens"] == len(ids)
        assert got[i]["decoded"] == tok.decode(ids, skip_special_tokens=False)


def test_decoding_gathers_bytes(tokenizer):
    c, tok, r = bpe.codec(tokenizer), Tokenizer.from_str(tokenizer), np.random.default_rng(3)
    for n in (0, 1, 7, 5000, bpe.CALL_BYTES // 4 + 3):
        ids = r.integers(0, 50_000, n).astype(np.uint32)
        assert c.decode(ids) == tok.decode(ids.tolist(), skip_special_tokens=False)


# ---- op2

def test_repeated_rows_are_dealt_out(spark):
    rows = [(None, "the same row " * 8)] * 1000 + [(i, f"text {i} " * 12) for i in range(2000)]
    rows += [(7, None)] * 900 + [(None, None)] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sharding.shard(df, 16, cell_rows=100).toPandas()
    assert len(got) == len(rows)
    size = got.groupby("shard")["size"].sum()
    assert len(size) == 16 and size.max() <= 1.03 * size.min()
    for _, x in got.groupby("shard"):
        assert sorted(x.slot) == list(range(len(x)))
    assert Counter((None if np.isnan(i) else int(i), t) for i, t in zip(got.doc_id, got.text)) == Counter(rows)
    again = sharding.shard(df, 16, cell_rows=100)
    assert again.agg(F.count_distinct("shard", "slot")).first()[0] == len(rows)


def test_one_row_alone_many_times(spark):
    got = sharding.shard(spark.createDataFrame([(1, "x")] * 5000, "doc_id long, text string"), 4).groupBy("shard").count().toPandas()
    assert len(got) == 4 and got["count"].max() <= 1.05 * got["count"].min()


# ---- op7

@pytest.mark.parametrize("crowd", [0, 3])
@pytest.mark.parametrize("block_bytes", [1 << 22, 20_000])
def test_windows_of_crowded_anchors_apart(docs, texts, block_bytes, crowd):
    got = Counter((r["doc_id"], r["n_bytes"], bytes(r["kept"]), tuple((s["start"], s["length"]) for s in r["spans"]))
                  for r in repeats.remove_repeats(docs, block_bytes=block_bytes, crowd=crowd).collect())
    assert got == removed(texts)


def test_a_stock_phrase_in_many_surroundings(spark):
    r = random.Random(5)
    noise = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    rows = [(i, noise(60) + "a frequent stock phrase " + noise(60)) for i in range(400)]
    rows += [(1000 + i, rows[i][1][20:120]) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = removed(rows)
    for crowd in (repeats.CROWD, 50):
        got = Counter((x["doc_id"], x["n_bytes"], bytes(x["kept"]), tuple((s["start"], s["length"]) for s in x["spans"]))
                      for x in repeats.remove_repeats(df, block_bytes=8000, crowd=crowd).collect())
        assert got == want


def test_crowds_are_told_from_copies():
    r = random.Random(6)
    noise = lambda n: bytes(r.choice(b"abcdefghijklmnopqrstuvwxyz ") for _ in range(n))

    def crowded(texts, crowd):
        """Which of the anchors of 20 blocks the bucket calls crowded."""
        asked = []
        for k in range(20):
            h, several, told = repeats._anchors(repeats.Runs(texts(k)), np.arange(k * 100, k * 100 + len(texts(k))))
            asked.append(h.tobytes() + told.tobytes() + np.packbits(several).tobytes())
        answer = repeats._answer_anchors(crowd)(repeats._table(0, [0] * 20, [b""] * 20, asked))
        n = [len(repeats._entries(x)[0]) for x in asked]
        bits = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=2 * m)[m:] for x, m in zip(answer.column("shared"), n)]
        return sum(int(b.sum()) for b in bits)

    fired = []
    for phrase in (noise(24) for _ in range(10)):  # whose smallest hash is small by chance
        different = [[noise(60) + phrase + noise(60) for _ in range(30)] for _ in range(20)]
        fired.append(crowded(lambda k: different[k], 200))
        assert crowded(lambda k: different[k], 5000) == 0
        copy = noise(60) + phrase + noise(60)
        assert crowded(lambda k: [copy] * 30, 20) == 0
    assert any(fired)


# ---- op9

def clustered(n, dim=24, share=0.05, seed=4):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim))
    m = int(n * share)
    x[:m] = x[n - m:] + 0.05 * r.normal(size=(m, dim))
    return neardup.unit(r.permutation(x)).astype(np.float32)


@pytest.mark.parametrize("share", [0.0, 0.005, 0.05])
def test_searches_go_through_the_graph(monkeypatch, share):
    """Also where few or no vectors link, all searches take the graph."""
    x = clustered(4000, share=share)
    world = neardup.SmallWorld(x)
    seen = []
    local = neardup.SmallWorld._local
    monkeypatch.setattr(neardup.SmallWorld, "_local", lambda self, q, k, *a: (k == 0 and seen.append(len(q)), local(self, q, k, *a))[1])
    a, b, beam = neardup.audited_search(world, x, 0.98, own=np.arange(len(x)))
    assert beam < len(x) // 4 and sum(seen) >= len(x)
    want = set(map(tuple, np.argwhere(x @ x.T >= 0.98).tolist()))
    got = set(zip(a.tolist(), b.tolist()))
    assert len(want & got) >= 0.999 * len(want) and got <= want | {(i, j) for i, j in got if x[i] @ x[j] >= 0.98 - 1e-6}


def test_probes_are_as_far_as_told():
    x = clustered(300)
    y = neardup.turned(x, 0.985)
    assert np.allclose((x * y).sum(axis=1), 0.985, atol=1e-5) and np.allclose((y * y).sum(axis=1), 1, atol=1e-5)
    assert (neardup.turned(np.ones((3, 1), np.float32), 0.985) == 1).all()


def test_registered_vectors_take_the_graph_and_find_their_links(spark):
    """The whole query on the given table, against brute force."""
    from labelforge.sources.tables import table

    rows = table(spark, SMALL, "embeddings").collect()
    got = {r["vec_id"]: r["n_links"] for r in queries.op9_small_world(spark, SMALL).collect()}
    for label in {r["label"] for r in rows}:
        mine = [r for r in rows if r["label"] == label]
        x = neardup.unit(np.array([r["embedding"] for r in mine], np.float64))
        n = (x @ x.T >= 0.98).sum(axis=1) - 1
        assert [got[r["vec_id"]] for r in mine] == n.tolist()


# ---- the registered queries' own columns

@pytest.fixture(scope="module")
def small(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def held(i, mod, rest):
    return zlib.crc32(str(i).encode()) % mod == rest


def test_op1_digests(spark, small, tokenizer):
    tok = Tokenizer.from_str(tokenizer)
    got = {r["doc_id"]: r for r in queries.op1_bpe_chunk_reuse(spark, SMALL).collect()}
    assert set(got) == set(small)
    for i, t in small.items():
        ids = tok.encode(t, add_special_tokens=False).ids
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op2_columns(spark, small):
    got = queries.op2_histogram_sort(spark, SMALL).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in small.items()}
    assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}


def test_op4_and_op5_hold_out_their_rows(spark, small):
    for name in ("op4_compression_distance", "op5_cross_parsing"):
        got = queries.QUERIES[name](spark, SMALL).collect()
        assert {r["doc_id"]: r["held_out"] for r in got} == {i: held(i, 3, 1) for i in small}
        assert all(0 <= r["score"] <= 1 for r in got)
        if name.startswith("op4"):
            assert all(r["predicted"] == int(r["score"] >= 0.7) for r in got)


def test_op7_digests(spark, small):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.op7_interval_tree(spark, SMALL).collect()}
    want = {i: (n, sum(s[1] for s in spans), len(spans), hashlib.sha256(kept).hexdigest()) for (i, n, kept, spans) in removed(list(small.items()))}
    assert got == want


def test_op8_pieces(spark, small, tokenizer):
    tok = Tokenizer.from_str(tokenizer)
    got = queries.op8_configuration_program(spark, SMALL).collect()
    of = {}
    for r in got:
        of.setdefault(r["doc_id"], []).append(r)
    seqs = {}
    for i, t in small.items():
        ids = tok.encode(t, add_special_tokens=False).ids + [2]
        pieces = sorted(of[i], key=lambda r: r["piece"])
        assert [p["start"] for p in pieces] == np.cumsum([0] + [p["length"] for p in pieces])[:-1].tolist() and sum(p["length"] for p in pieces) == len(ids)
        for p in pieces:
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[p["start"]:p["start"] + p["length"]], "<u4").tobytes())
            seqs.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for s in seqs.values():
        s.sort()
        assert [o for o, _ in s] == np.cumsum([0] + [n for _, n in s])[:-1].tolist() and sum(n for _, n in s) <= 1024

