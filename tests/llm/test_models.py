"""Toxicity, language identification, the suffix tree, embeddings, the pipeline."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelforge.llm import langid, lm, neardup, toxicity
from labelforge.llm.common import connected_components, crc_mod_is

from .conftest import prose

INSULTS = ["grubworm", "nincom", "blighter", "ratbag"]


# ---- toxicity

@pytest.fixture(scope="module")
def labelled(spark):
    r, rows = random.Random(4), []
    for i in range(700):
        ws = prose(i, 60).split()
        bad = i % 5 == 0
        for _ in range(4 if bad else 0):
            ws.insert(r.randint(0, len(ws)), r.choice(INSULTS))
        rows.append((i, " ".join(ws), int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxic_documents_are_found_on_held_out_rows(labelled):
    held = crc_mod_is(F.col("doc_id"), 3, 1)
    model = toxicity.fit(labelled.where(~held), labelled.where(~held).select("doc_id", "toxic"))
    got = toxicity.score(labelled.where(held), model).collect()
    hit = [r["_score"] >= toxicity.TOXIC for r in got if r["toxic"]]
    false = [r["_score"] >= toxicity.TOXIC for r in got if not r["toxic"]]
    assert sum(hit) >= 0.9 * len(hit) and sum(false) <= 0.02 * len(false)
    assert all(0 <= r["_score"] <= 1 for r in got)


def test_toxicity_of_odd_texts_and_without_labels(spark, labelled, docs, empty):
    labels = labelled.select("doc_id", "toxic")
    model = toxicity.fit(labelled, labels.union(spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int")))
    got = toxicity.score(docs, model)
    assert got.count() == docs.count() and got.where("_score is null or _score < 0 or _score > 1").count() == 0
    assert toxicity.score(empty, model).count() == 0
    none = toxicity.fit(labelled, labels.where("toxic = 0"))
    assert {r["_score"] for r in toxicity.score(docs, none).collect()} == {0.0}
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns


def test_windows_cover_the_whole_text():
    ws = toxicity.words_of(prose(1, 1000) + " LAST")
    assert b" ".join(w.strip() for w in toxicity.windows(ws)) == b" ".join(ws) and ws[-1] == b"last"
    assert toxicity.windows([]) == [] and toxicity.features([])[0] == 0


# ---- languages

def greedy(sample: bytes, text: bytes) -> int:
    n, at = 0, 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in sample:
            end += 1
        at, n = max(end - 1, at + 1), n + 1
    return n


def test_automaton_parses_like_substring_search():
    r = random.Random(1)
    for _ in range(30):
        sample = bytes(r.choice(b"abcd") for _ in range(r.randint(1, 200)))
        some = [bytes(r.choice(b"abcde") for _ in range(r.randint(0, 50))) for _ in range(9)]
        columns, lengths, whose = langid.segments(some, 1000)
        got = np.bincount(whose, langid.Automaton(sample).phrases(columns, lengths), len(some))
        assert got.tolist() == [greedy(sample, t) for t in some]


def language(k, seed, n=80):
    r = random.Random(f"{k}{seed}")
    parts = [["the", "ing", "ed", "of"], ["der", "sch", "ung", "zu"], ["ción", "ado", "que", "el"]][k]
    return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(n))


def test_languages_of_held_out_rows(spark):
    rows = [(i, language(i % 3, i), ["en", "de", "es"][i % 3]) for i in range(300)]
    rows += [(1000, None, "en"), (1001, "12 34 !!", "en"), (1002, "", "de"), (1003, language(1, 5), None), (None, language(2, 8), "es"),
             (1004, language(0, 1, 50000), "en")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = crc_mod_is(F.col("doc_id"), 3, 1)
    got = langid.identify(d, langid.fit(d.where(~held))).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    assert all(by[i]["lang_pred"] == l for i, _, l in rows[:300])
    assert [by[i]["lang_pred"] for i in (1000, 1001, 1002, 1003, None, 1004)] == ["und", "und", "und", "de", "es", "en"]
    assert all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in langid.identify(d, []).collect()} == {"und"}
    assert langid.fit(d.where("false")) == [] and langid.identify(d.where("false"), []).count() == 0


# ---- the suffix tree

def tokens(t):
    return (t or "").encode().lower().split()


@pytest.mark.parametrize("block_bytes", [1 << 22, 30_000])
def test_base_counts_and_score(docs, texts, block_bytes):
    import zlib

    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    c = Counter()
    for i, t in texts:
        if not held(i):
            c.update(tokens(t))
            c[b""] += 1
    n, v = sum(c.values()), len(c)
    want = []
    for i, t in texts:
        ws = [*tokens(t), b""]
        want.append((i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)))
    got = lm.score(docs, lm.held_out(), block_bytes=block_bytes).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:5], round(r[5], 5))
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)
    assert all(r["score"] < 0 for r in got)


def test_tree_learns(spark):
    d = spark.createDataFrame([(i, "abcabcabc " * 20) for i in range(50)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm.score(d, lm.held_out()).collect()}
    assert all(r["score"] / 200 > -0.1 for r in got.values())
    assert lm.score(d.where("false"), lm.held_out()).count() == 0
    assert lm.score(d, F.lit(True)).where("train_tokens <> 0 or n_known <> 0").count() == 0


# ---- embeddings

def brute(rows, least=0.98):
    ok = {}
    for k, (v, e, l) in enumerate(rows):
        if l is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e):
            ok[k] = np.array(e, float)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    n = [0] * len(rows)
    for a in ok:
        for b in ok:
            if a < b and rows[a][2] == rows[b][2] and len(ok[a]) == len(ok[b]):
                x, y = ok[a] / np.abs(ok[a]).max(), ok[b] / np.abs(ok[b]).max()
                if x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= least:
                    n[a] += 1
                    n[b] += 1
                    root[find(a)] = find(b)
    low = {}
    for k, (v, _, _) in enumerate(rows):
        if v is not None:
            low[find(k)] = min(v, low.get(find(k), v))
    return Counter((rows[k][0], n[k], low.get(find(k)), rows[k][0] == low.get(find(k))) for k in range(len(rows)))


@pytest.mark.parametrize("shard_rows,block_rows", [(16384, 1024), (60, 40)])
def test_links_components_and_odd_vectors(spark, shard_rows, block_rows):
    r = np.random.default_rng(3)
    rows, nid = [], iter(range(10**6))
    for l in range(2):
        for _ in range(60):
            rows.append((next(nid), r.normal(size=16).tolist(), l))
        for _ in range(3):
            c = r.normal(size=16)
            rows += [(next(nid), (c + r.normal(size=16) * 0.08).tolist(), l) for _ in range(25)]
    copy = rows[5][1]
    rows += [(next(nid), copy, 0) for _ in range(9)] + [(next(nid), [2 * x for x in copy], 0), (next(nid), copy, 1), (next(nid), copy, None)]
    rows += [(next(nid), None, 0), (next(nid), [], 0), (next(nid), [0.0] * 16, 0), (next(nid), [float("nan")] + [1.0] * 15, 0),
             (next(nid), [None] + [1.0] * 15, 0), (next(nid), [float("inf")] * 16, 1), (next(nid), [1.0, 2.0], 0), (next(nid), [1.0, 2.0], 0),
             (None, [5.0, 1.0], 0), (None, None, None), rows[7], (next(nid), [1e300] * 16, 1), (next(nid), [1e-300] * 16, 1)]
    d = spark.createDataFrame([(*x, "extra") for x in rows], "vec_id long, embedding array<double>, label int, kept string")
    got = Counter(tuple(x) for x in neardup.near_duplicates(d, shard_rows=shard_rows, block_rows=block_rows).collect())
    assert got == brute(rows)
    assert neardup.near_duplicates(d.where("false")).count() == 0


def test_graph_search_finds_a_crowd():
    r = np.random.default_rng(1)
    x = r.normal(size=(1500, 32))
    x[:400] = x[0] + 0.05 * r.normal(size=(400, 32))
    x = neardup.unit(r.permutation(x)).astype(np.float32)
    world = neardup.SmallWorld(x)
    assert len(world.layers) > 1
    a, b, beam = neardup.audited_search(world, x, 0.98)
    want = {(i, j) for i, j in zip(*np.nonzero(x @ x.T >= 0.98))}
    assert len(want & set(zip(a.tolist(), b.tolist()))) >= 0.99 * len(want) and beam < 1500


# ---- components

@pytest.mark.parametrize("seed", range(3))
def test_connected_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(200)] + [(500 + i, 501 + i) for i in range(60)] + [(900, 901 + i) for i in range(90)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert Counter(map(tuple, got)) == Counter((x, find(x)) for x in linked)


# ---- the pipeline

def test_pipeline_against_its_stages(spark, tmp_path, labelled):
    import corpus_pipeline
    from labelforge.llm import quality
    from tests.llm.test_text_operators import base, components, removed

    r = random.Random(8)
    rows = [(x["doc_id"], x["text"] + "\n" + prose(x["doc_id"] + 5000, 30)) for x in labelled.collect()]
    passage = prose(123456, 40)
    rows += [(2000 + i, prose(2000 + i, 30) + " " + passage) for i in range(20)] + [(3000 + i, prose(9, 100)) for i in range(5)]
    rows += [(4000, None), (4001, ""), (4002, "too short"), (4003, "again and " * 50)]
    r.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labelled.select("doc_id", F.lit(1).alias("quality"), "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    # toxic: the model by itself; the scoring function one text at a time
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    model = toxicity.fit(docs, labels)
    gains = model.gains()
    rows = [(i, t) for i, t in sorted(rows) if toxicity.value(model.curve, toxicity.features(gains(toxicity.words_of(t)))) < 0.7]
    clean = docs.join(spark.createDataFrame([(i,) for i, _ in rows], "doc_id long"), "doc_id", "left_semi")
    good = {x["doc_id"]: x["score"] for x in quality.judge(clean, labels.where("quality = 1")).select("doc_id", "score").collect()}
    rows = [(i, t) for i, t in rows if not base(t)[5] and good[i] >= quality.THRESHOLD]
    from labelforge.llm.simhash import fingerprint
    comp = components([fingerprint((t or "").encode()) for _, t in rows], [i for i, _ in rows], 4)
    rows = [x for x, c in zip(rows, comp) if x[0] == c]
    left = {i: kept.decode("utf-8", "ignore") for i, _, kept, _ in removed(rows)}
    from labelforge.llm.packing import encoder
    from labelforge.llm.queries import tokenizer_json
    ids = encoder(tokenizer_json())
    assert {x["doc_id"] for x in got} == set(left)
    total = Counter()
    for x in got:
        total[x["doc_id"]] += x["length"]
    assert total == Counter({i: len(ids(t.encode())) + 1 for i, t in left.items()})
    hit = [x["doc_id"] for x in labelled.where("toxic = 1").collect() if x["doc_id"] in left]
    assert len(hit) < 14 and not {4000, 4001, 4002, 4003} & set(left)


def test_stages_on_odd_documents_and_nothing(spark, docs, empty, tmp_path, labelled):
    import corpus_pipeline

    labelled.select("doc_id", F.lit(1).alias("quality"), "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        for d in (docs, empty):
            stage(spark, d, str(tmp_path)).count()
