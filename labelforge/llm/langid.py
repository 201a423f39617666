"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text knows every substring of
that text. A document is parsed against each automaton into longest matches
(phrases); phrases times log2 of the sample's length over the document's length
is the cross entropy, and the language that needs fewest wins.

The automata are fitted on a bounded sample: up to ``SAMPLE_DOCS`` passages of
each language, of ``SAMPLE_BYTES`` over all languages together; they are built
on the driver and broadcast. Documents are parsed whole, many segments at a
time.

Defined results: a null text, or one without a letter, gives ``und`` with score
0; without any labelled text every document gives ``und``; ties go to the
smaller language name; labels that are null teach nothing; repeated rows are
rows of their own; extra columns are ignored.
"""

from __future__ import annotations

from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from labelforge.llm.common import bounded_batches

#: Passages of a language that its automaton is built on, at most.
SAMPLE_DOCS = 64
#: Bytes of the passages of all languages together, at most.
SAMPLE_BYTES = 160_000
#: Bytes that one parse runs over before it starts anew.
SEGMENT = 1024
#: Bytes over which a lead in bits counts for the score.
SCORE_BYTES = 24

#: Letters in lower case, everything else of ASCII as one space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Automaton:
    """Suffix automaton of a byte string, as a table: next[state, symbol] or
    -1. Symbols are numbered by ``symbol``; 0 stands for all that don't occur."""

    def __init__(self, text: bytes):
        seen = sorted(set(text))
        self.symbol = np.zeros(256, np.uint8)
        self.symbol[seen] = np.arange(1, len(seen) + 1) if len(seen) < 256 else np.arange(256)
        self.length = len(text)
        code = self.symbol[np.frombuffer(text, np.uint8)].tolist()
        nxt: list[dict[int, int]] = [{}]
        link, size, last = [-1], [0], 0
        for c in code:
            cur = len(nxt)
            nxt.append({})
            size.append(size[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if size[p] + 1 == size[q]:
                    link[cur] = q
                else:
                    twin = len(nxt)
                    nxt.append(dict(nxt[q]))
                    size.append(size[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = twin
                        p = link[p]
                    link[q] = link[cur] = twin
            last = cur
        self.next = np.full((len(nxt), int(self.symbol.max()) + 1), -1, np.int32)
        for s, row in enumerate(nxt):
            for c, t in row.items():
                self.next[s, c] = t

    def phrases(self, columns: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Phrases of each segment; ``columns`` holds the bytes by place and
        segment, the segments in order of falling length."""
        table, width = self.next.ravel(), self.next.shape[1]
        codes = self.symbol[columns]
        state = np.zeros(len(lengths), np.int64)
        count = np.zeros(len(lengths), np.int64)
        live = len(lengths)
        for at in range(len(columns)):
            while live and lengths[live - 1] <= at:
                live -= 1
            if not live:
                break
            c = codes[at, :live]
            to = table[state[:live] * width + c]
            ends = np.flatnonzero(to < 0)
            if len(ends):  # the phrase ends before c, which starts the next one
                count[ends] += state[ends] > 0
                fresh = table[c[ends]]
                count[ends] += fresh < 0  # c occurs nowhere: a phrase by itself
                to[ends] = np.maximum(fresh, 0)
            state[:live] = to
        return count + (state > 0)


def segments(texts: list[bytes], size: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes by place and segment, lengths, number of the text), longest first."""
    whose = np.repeat(np.arange(len(texts)), [-(-len(t) // size) for t in texts])
    lengths = np.array([min(size, len(t) - a) for t in texts for a in range(0, len(t), size)], np.int64)
    order = np.argsort(-lengths, kind="stable")
    flat = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else lengths
    deep = int(lengths.max(initial=0))
    at = np.minimum(starts[order][None, :] + np.arange(deep)[:, None], max(len(flat) - 1, 0))
    return flat[at] if len(flat) else np.empty((0, 0), np.uint8), lengths[order], whose[order]


def predict(model: list[tuple[str, Automaton]], texts: list[str | None], batch_bytes: int = 1 << 21) -> tuple[list[str], list[float]]:
    names, scores = [], []
    at = 0
    while at < len(texts):
        end, size, part = at, 0, []
        while end < len(texts) and (end == at or size < batch_bytes):
            t = texts[end]
            part.append(t.encode().translate(FOLD) if t is not None and any(map(str.isalpha, t)) else b"")
            size += len(part[-1])
            end += 1
        columns, lengths, whose = segments(part)
        sizes = np.array([max(1, len(p)) for p in part])
        cost = np.array([np.bincount(whose, a.phrases(columns, lengths), len(part)) * log2(max(2, a.length)) / sizes
                         for _, a in model]) if model else np.zeros((0, len(part)))
        if len(model):
            best = cost.argmin(axis=0)
            weight = np.exp2(np.maximum(-SCORE_BYTES * (cost - cost.min(axis=0)), -1000))
            sure = 1 / weight.sum(axis=0)
        for i, p in enumerate(part):
            known = bool(p) and bool(model)
            names.append(model[best[i]][0] if known else "und")
            scores.append(float(sure[i]) if known else 0.0)
        at = end
    return names, scores


def fit(labelled: DataFrame, docs_per_lang: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> list[tuple[str, Automaton]]:
    """Automata of the languages of (text, lang) rows with both. The sample of
    a language has one passage of each of ``docs_per_lang`` hash buckets."""
    rows = labelled.where("lang is not null and length(text) > 0").select("lang", "text")
    langs = max(1, rows.select(F.approx_count_distinct("lang")).first()[0])
    chars = max(16, sample_bytes // langs // docs_per_lang)
    h = F.xxhash64("text")
    start = F.pmod(h, F.greatest(F.length("text") - chars, F.lit(1))).cast("int") + 1
    picked = (rows.select("lang", F.substring("text", start, F.lit(chars)).alias("piece"), h.alias("h"))
              .groupBy("lang", F.pmod("h", F.lit(docs_per_lang)).alias("bucket")).agg(F.min(F.struct("h", "piece")).alias("p"))
              .select("lang", "bucket", "p.piece").orderBy("lang", "bucket").collect())
    share = sample_bytes // langs
    pieces: dict[str, list[bytes]] = {}
    for r in picked:
        pieces.setdefault(r["lang"], []).append(r["piece"].encode().translate(FOLD))
    return [(k, Automaton(b" ".join(v)[:share])) for k, v in sorted(pieces.items())]


def identify(docs: DataFrame, model: list[tuple[str, Automaton]]) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs`` (doc_id, text)."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            names, scores = predict(shared.value, b.column("text").to_pylist())
            yield pa.record_batch([b.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                  ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
