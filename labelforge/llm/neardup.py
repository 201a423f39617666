"""Near-duplicate embeddings by navigable small-world graphs.

Vectors of one label (and length) are dealt into shards of bounded rows. Each
shard gets a hierarchical navigable small-world graph: every layer holds a
sixteenth of the nodes below it, a node links to near and diverse neighbours,
and a search walks down from the top with a beam. Every shard searches every
shard of its label, in blocks of queries; what lies in range is followed to the
last neighbour in range. Each pair of shards is audited once against brute force:
queries that have links, and probes made of the searched shard's own nodes; as long as one of
them misses more than its share the beam doubles, and all searches of the pair
take that beam through the graph. Links are verified by cosine in double
precision; a link that either of its vectors finds counts for both. Components
are joined.

Equal vectors of a label are one node with a number of copies. A search returns
a count of links for each query and the edges of a spanning forest, never all
pairs.

Defined results: a vector that is null, empty, zero, or holds a null or
non-finite component, or has no label, links with nothing and is its own
component; vectors of different length don't link; repeated rows are copies
and link; a null vec_id is the component's name only if no member has one; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from labelforge.llm.common import bounded_batches, connected_components, saved, sorted_join

LEAST_COSINE = 0.98
#: Rows of a shard, about, and of a block of queries.
SHARD_ROWS = 16_384
BLOCK_ROWS = 1_024
#: Links of a node when it is inserted, half of them diverse.
LINKS = 12
#: Beam of an insertion, and the first beam of a search.
BEAM = 24
#: Queries with links, and probes, that are audited for a pair of shards; queries
#: looked at for links; and the share of its links that each audited one must find.
AUDITED = 64
DRAWN = 1024
RECALL = 0.999
LAYER = 16  # each layer has one node in so many of the layer below
SLACK = 1e-4  # single precision finds candidates; double decides


class Graph:
    """One layer: neighbours of local nodes, in both directions."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.a = np.empty(0, np.int32)
        self.b = np.empty(0, np.int32)
        self.start = np.zeros(len(x) + 1, np.int64)
        self.to = np.empty(0, np.int32)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.a, self.b = np.concatenate([self.a, a, b]), np.concatenate([self.b, b, a])
        key = np.unique(self.a.astype(np.int64) * len(self.x) + self.b)
        self.a, self.b = (key // len(self.x)).astype(np.int32), (key % len(self.x)).astype(np.int32)
        self.start = np.concatenate([[0], np.cumsum(np.bincount(self.a, minlength=len(self.x)))])
        self.to = self.b

    def around(self, query: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, neighbour) for each neighbour of each (query, node)."""
        n = self.start[node + 1] - self.start[node]
        total = int(n.sum())
        at = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.start[node], n)
        return np.repeat(query, n), self.to[at].astype(np.int64)

    def similar(self, q: np.ndarray, query: np.ndarray, node: np.ndarray) -> np.ndarray:
        out = np.empty(len(query), np.float32)
        for s in range(0, len(query), 1 << 16):
            e = s + (1 << 16)
            out[s:e] = np.einsum("ij,ij->i", q[query[s:e]], self.x[node[s:e]])
        return out

    def search(self, q: np.ndarray, entry: np.ndarray, beam: int, at_least: float | None = None):
        """The beam's nodes and similarities for each query, best first, and
        all (query, node) seen with similarity ``at_least``, if given, followed
        until no neighbour in range is left."""
        nq, n = len(q), len(self.x)
        seen = np.zeros((nq, n), bool)
        done = np.zeros((nq, n), bool)
        rows = np.arange(nq)
        ids = np.full((nq, beam), -1, np.int64)
        sims = np.full((nq, beam), -np.inf, np.float32)
        near: list[tuple[np.ndarray, np.ndarray]] = []

        def take(query: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Looks at unseen nodes; puts them into the beams."""
            nonlocal ids, sims
            key = np.unique((query * n + node)[~seen[query, node]])
            query, node = key // n, key % n
            if not len(key):
                return query, node
            seen[query, node] = True
            s = self.similar(q, query, node)
            if at_least is not None:
                keep = s >= at_least
                near.append((query[keep], node[keep]))
            count = np.bincount(query, minlength=nq)
            place = np.arange(len(key)) - np.repeat(np.cumsum(count) - count, count)
            more = np.full((nq, int(count.max())), -1, np.int64)
            value = np.full(more.shape, -np.inf, np.float32)
            more[query, place], value[query, place] = node, s
            every, ids_all = np.concatenate([sims, value], 1), np.concatenate([ids, more], 1)
            best = np.argsort(-every, axis=1, kind="stable")[:, :beam]
            ids, sims = ids_all[rows[:, None], best], every[rows[:, None], best]
            return near[-1] if at_least is not None else (query, node)

        e = entry.shape[1]
        take(*(v[np.repeat(entry.ravel() >= 0, 1)] for v in (np.repeat(rows, e), entry.ravel())))
        while True:
            open_ = (ids >= 0) & ~done[rows[:, None], np.maximum(ids, 0)]
            first = open_ & (np.cumsum(open_, axis=1) <= 4)  # the best four at once
            query, k = np.nonzero(first)
            if not len(query):
                break
            node = ids[query, k]
            done[query, node] = True
            take(*self.around(query, node))
        if at_least is not None:
            parts = [np.concatenate(p) for p in zip(*near)] if near else [np.empty(0, np.int64)] * 2
            fresh = ~done[parts[0], parts[1]]
            front = [p[fresh] for p in parts]
            while len(front[0]):
                done[front[0], front[1]] = True
                found = [take(*self.around(front[0][s:s + 8192], front[1][s:s + 8192]))
                         for s in range(0, len(front[0]), 8192)]
                front = [np.concatenate(p) for p in zip(*found)]
                fresh = ~done[front[0], front[1]]
                front = [p[fresh] for p in front]
        parts = [np.concatenate(p) for p in zip(*near)] if near else [np.empty(0, np.int64)] * 2
        return ids, sims, parts


class SmallWorld:
    """The layers over unit vectors ``x``; layers[0] holds all nodes."""

    def __init__(self, x: np.ndarray, edges: list[tuple[np.ndarray, np.ndarray]] | None = None):
        self.x = x
        h = (np.arange(1, len(x) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
        self.nodes = [np.arange(len(x))]
        while len(self.nodes[-1]) > 4 * LAYER:
            self.nodes.append(self.nodes[-1][h[self.nodes[-1]] % (LAYER ** len(self.nodes)) == 0])
            if len(self.nodes[-1]) == 0:
                self.nodes.pop()
                break
        self.layers = [Graph(x[n]) for n in self.nodes]
        if edges is not None:
            for g, (a, b) in zip(self.layers, edges):
                g.add(a, b)
            return
        for k in reversed(range(len(self.layers))):
            self._build(k)

    def _entry(self, q: np.ndarray, above: int, width: int = 4) -> np.ndarray:
        """Entry points (global nodes) found in the layers from the top down to
        ``above``; the top is looked at whole."""
        top = len(self.layers) - 1
        s = q @ self.x[self.nodes[top]].T
        ids = self.nodes[top][np.argsort(-s, axis=1, kind="stable")[:, :width]]
        for k in range(top - 1, above - 1, -1):
            ids = self._local(q, k, ids, 8)[0][:, :width]
            ids = np.where(ids >= 0, self.nodes[k][np.maximum(ids, 0)], -1)
        return ids

    def _local(self, q, k, ids, beam, at_least=None):
        local = np.where(ids >= 0, np.searchsorted(self.nodes[k], np.maximum(ids, 0)), -1)
        return self.layers[k].search(q, local, beam, at_least)

    def _build(self, k: int) -> None:
        g, nodes, top = self.layers[k], self.nodes[k], k == len(self.layers) - 1
        n, at = len(nodes), 0
        while at < n:
            end = min(n, at + (64 if at == 0 else min(at, 512)))
            q = g.x[at:end]
            inner = q @ q.T  # this batch among itself
            np.fill_diagonal(inner, -np.inf)
            own = np.argsort(-inner, axis=1, kind="stable")[:, :BEAM]
            ids, sims = own + at, np.take_along_axis(inner, own, 1)
            if at:
                # a layer's own nodes stand in for the layers above them
                entry = self._entry(q, k + 1) if not top else nodes[np.zeros((len(q), 1), np.int64)]
                local = np.searchsorted(nodes, np.maximum(entry, 0))
                start = np.concatenate([np.where((entry >= 0) & (local < at), local, -1),
                                        np.zeros((len(q), 1), np.int64)], axis=1)
                old, old_sims, _ = g.search(q, start, BEAM)
                ids, sims = np.concatenate([ids, old], 1), np.concatenate([sims, old_sims], 1)
            order = np.argsort(-sims, axis=1, kind="stable")
            ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
            keep = self._choose(g.x, ids, sims)
            row, col = np.nonzero(keep & (ids >= 0) & np.isfinite(sims))
            g.add((row + at).astype(np.int32), ids[row, col].astype(np.int32))
            at = end

    @staticmethod
    def _choose(x: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> np.ndarray:
        """Half of a node's links go to candidates that are nearer to it than to
        all chosen before, the rest to the nearest of the others."""
        c = x[np.maximum(ids, 0)]
        among = np.einsum("bij,bkj->bik", c, c)
        chosen = np.zeros(ids.shape, bool)
        nearest = np.full(ids.shape, -np.inf, np.float32)  # of each to the chosen
        for k in range(ids.shape[1]):
            pick = (ids[:, k] >= 0) & (sims[:, k] > nearest[:, k]) & (chosen.sum(axis=1) < LINKS // 2)
            chosen[:, k] = pick
            nearest = np.where(pick[:, None], np.maximum(nearest, among[:, k]), nearest)
        rest = (ids >= 0) & ~chosen & np.isfinite(sims)
        return chosen | rest & (np.cumsum(rest, axis=1) <= LINKS - chosen.sum(axis=1)[:, None])

    def in_range(self, q: np.ndarray, at_least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        if beam >= len(self.x):  # as wide as the shard: everything is looked at
            found = [np.nonzero(q[s:s + 256] @ self.x.T >= at_least) for s in range(0, len(q), 256)]
            return (np.concatenate([a + s for (a, _), s in zip(found, range(0, len(q), 256))]),
                    np.concatenate([b for _, b in found]))
        return tuple(self._local(q, 0, self._entry(q, 1) if len(self.layers) > 1 else self._entry(q, 0), beam, at_least)[2])


def audited_beam(world: SmallWorld, q: np.ndarray, at_least: float, recall: float = RECALL, own: np.ndarray | None = None) -> int:
    """The beam with which each audited query finds ``recall`` of its links in
    ``world``, by brute force over the whole shard. Audited are ``AUDITED`` of the queries
    that have links (drawn evenly, ``DRAWN`` looked at: links may be rare),
    and as many probes made of the shard's own nodes, each turned so far that it just links to
    its node: where no query has a link, these still measure the graph. ``own``
    is each query's own node or -1."""
    n = len(world.x)
    order = np.unique(np.linspace(0, len(q) - 1, min(AUDITED, len(q))).astype(int))
    order = np.concatenate([order, np.setdiff1d(np.linspace(0, len(q) - 1, min(DRAWN, len(q))).astype(int), order)])
    probes = [turned(world.x[np.unique(np.linspace(0, n - 1, min(AUDITED, n)).astype(int))], at_least + 0.25 * (1 - at_least))]
    truth = [_in_range(probes[0], world.x, at_least + 1e-6)]
    linked = 0
    for s in range(0, len(order), AUDITED):
        some = order[s:s + AUDITED]
        x, y = _in_range(q[some], world.x, at_least + 1e-6)
        if own is not None:
            other = own[some[x]] != y
            x, y = x[other], y[other]
        with_links = np.unique(x)
        if len(with_links):
            probes.append(q[some[with_links]])
            truth.append((np.searchsorted(with_links, x), y))
            linked += len(with_links)
        if linked >= AUDITED:
            break
    at = np.cumsum([0] + [len(p) for p in probes])
    key = np.concatenate([(x + k) * n + y for k, (x, y) in zip(at, truth)])
    probes = np.concatenate(probes)
    wanted = np.bincount(key // n, minlength=len(probes))
    beam = BEAM
    while beam < n:
        a, b = world.in_range(probes, at_least, beam)
        hit = key[np.isin(key, a * n + b)]
        if (np.bincount(hit // n, minlength=len(probes)) >= recall * wanted).all():
            break
        beam *= 2
    return beam


def _in_range(q: np.ndarray, x: np.ndarray, at_least: float) -> tuple[np.ndarray, np.ndarray]:
    return np.nonzero(q @ x.T >= at_least)


def _searched(world: SmallWorld, q: np.ndarray, at_least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    return world.in_range(q, at_least, beam) if beam < len(world.x) else _in_range(q, world.x, at_least)


def turned(x: np.ndarray, cosine: float) -> np.ndarray:
    """Unit vectors at ``cosine`` to the unit vectors ``x``, each turned its own way."""
    if x.shape[1] < 2:
        return x
    u = np.random.default_rng(x.shape[1]).normal(size=x.shape)
    u -= (u * x).sum(axis=1, keepdims=True) * x
    u /= np.sqrt((u * u).sum(axis=1, keepdims=True))
    return (cosine * x + np.sqrt(1 - cosine * cosine) * u).astype(np.float32)


def audited_search(world: SmallWorld, q: np.ndarray, at_least: float, recall: float = RECALL,
                   own: np.ndarray | None = None, step: int = BLOCK_ROWS) -> tuple[np.ndarray, np.ndarray, int]:
    """All (query, node) in range that the graph finds, in blocks of ``step``
    queries, and the one beam that passed the audit. Only where no smaller beam
    passes is it as wide as the shard, and all nodes are looked at."""
    beam = audited_beam(world, q, at_least, recall, own)
    found = [_searched(world, q[s:s + step], at_least, beam) for s in range(0, len(q), step)]
    return (np.concatenate([a + s for (a, _), s in zip(found, range(0, len(q), step))]),
            np.concatenate([b for _, b in found]), beam)


def found_links(world: SmallWorld, x: np.ndarray, reps: np.ndarray, q: np.ndarray, q_reps: np.ndarray,
                least: float, recall: float, step: int) -> np.ndarray:
    """A row of bits for each query: the nodes of ``x`` it links to, by its own search."""
    order = np.argsort(reps)
    at = order[np.minimum(np.searchsorted(reps, q_reps, sorter=order), len(reps) - 1)]
    own = np.where(reps[at] == q_reps, at, -1)
    bits = np.zeros((len(q), (len(x) + 7) // 8), np.uint8)
    beam = audited_beam(world, q.astype(np.float32), least - SLACK, recall, own)
    for s in range(0, len(q), step):
        part = q[s:s + step]
        a, b = _searched(world, part.astype(np.float32), least - SLACK, beam)
        a, b = _verified(part, x, a, b, least)
        row = np.zeros((len(part), len(x)), bool)
        row[a, b] = own[s + a] != b
        bits[s:s + step] = np.packbits(row, axis=1)
    return bits


def joined_links(there: np.ndarray, back: np.ndarray, nodes: int, step: int):
    """(from, links) for each ``step`` queries: the links (query, node) that
    either side found; ``back`` has a row for each node."""
    for s in range(0, len(there), step):
        e = min(len(there), s + step)
        yield s, (np.unpackbits(there[s:e], axis=1, count=nodes)
                  | np.unpackbits(back[:, s // 8:(e + 7) // 8], axis=1, count=e - s).T).astype(bool)


def unit(x: np.ndarray) -> np.ndarray:
    # scaled first, so that neither huge nor tiny components leave the range
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(table: pa.Table) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in table.column("embedding").chunks])
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(table.num_rows, -1)


def _pack(table: pa.Table) -> dict:
    order = np.argsort(table.column("rep").to_numpy(), kind="stable")
    return {"reps": table.column("rep").to_numpy()[order], "copies": table.column("copies").to_numpy()[order],
            "x": _matrix(table)[order]}


GROUP = "label {label}, dim int, shard int, shards int, reps binary, copies binary, vectors binary, edges array<binary>"


def _row(table: pa.Table, data: dict, edges: list[bytes], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist([{
        **{c: table.column(c)[0].as_py() for c in ("label", "dim", "shard", "shards")},
        "reps": data["reps"].astype(np.int64).tobytes(), "copies": data["copies"].astype(np.int64).tobytes(),
        "vectors": data["x"].tobytes(), "edges": edges}], schema=schema)


def near_duplicates(vectors: DataFrame, least_cosine: float = LEAST_COSINE, shard_rows: int = SHARD_ROWS,
                    block_rows: int = BLOCK_ROWS, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``
    (vec_id, embedding, label)."""
    bounded_batches(vectors.sparkSession)
    numbers = F.col("embedding").cast("array<double>")
    v = vectors.select("vec_id", "label", numbers.alias("embedding"))
    good = (F.col("label").isNotNull() & (F.size("embedding") > 0)
            & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
            & F.exists("embedding", lambda x: x != 0))
    v = v.withColumn("good", F.coalesce(good, F.lit(False)))
    # a node's own number: vec_ids may be null or repeated
    nodes = saved(v.where("good").groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
                  .withColumns({"dim": F.size("embedding"), "rep": F.xxhash64("label", "embedding")}), "vector-nodes")
    # a shard of a label, by hash
    sizes = nodes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"))
    sized = nodes.join(sizes, ["label", "dim"]).withColumns({
        "shards": F.ceil(F.col("n") / shard_rows).cast("int")})
    sized = sized.withColumn("shard", F.pmod(F.xxhash64("rep"), "shards").cast("int"))
    label = vectors.schema["label"].dataType.simpleString()
    form = GROUP.format(label=label)
    arrow = pa.schema([("label", _arrow_type(label)), ("dim", pa.int32()), ("shard", pa.int32()), ("shards", pa.int32()),
                       ("reps", pa.binary()), ("copies", pa.binary()), ("vectors", pa.binary()), ("edges", pa.list_(pa.binary()))])

    def build(table: pa.Table) -> pa.Table:
        data = _pack(table)
        world = SmallWorld(unit(data["x"]).astype(np.float32))
        edges = [np.stack([g.a, g.b]).tobytes() for g in world.layers]
        return _row(table, data, edges, arrow)

    columns = ["label", "dim", "shard", "shards", "rep", "copies", "embedding"]
    index = saved(sized.select(columns).groupBy("label", "dim", "shard").applyInArrow(build, form), "vector-shards")
    step = (block_rows + 7) // 8 * 8

    def search(table: pa.Table) -> pa.Table:
        row = table.to_pylist()[0]
        one, two = ((*(np.frombuffer(row[side + c], np.int64) for c in ("reps", "copies")),
                     unit(np.frombuffer(row[side + "vectors"], np.float64).reshape(-1, row["dim"])), row[side + "edges"])
                    for side in ("q_", ""))

        def found(queries, nodes):
            world = SmallWorld(nodes[2].astype(np.float32), [tuple(np.frombuffer(e, np.int32).reshape(2, -1)) for e in nodes[3]])
            return found_links(world, nodes[2], nodes[0], queries[2], queries[0], least_cosine, recall, step)

        (q_reps, q_copies, *_), (reps, copies, *_) = one, two
        same = row["q_shard"] == row["shard"]
        there = found(one, two)
        back = there if same else found(two, one)
        out, theirs = [], np.zeros(len(reps), np.int64)
        for s, linked in joined_links(there, back, len(reps), step):
            a, b = np.nonzero(linked)
            out.append((q_reps[s:s + len(linked)], linked @ copies, q_reps[s:s + len(linked)]))
            names, roots = _forest(q_reps[s + a], reps[b])
            out.append((names, np.zeros(len(names), np.int64), roots))
            theirs += q_copies[s:s + len(linked)] @ linked
        if not same:
            out.append((reps, theirs, reps))
        reps_, links_, to_ = (np.concatenate(p).astype(np.int64) for p in zip(*out))
        some = (links_ > 0) | (reps_ != to_)
        return pa.table({"rep": reps_[some], "links": links_[some], "to": to_[some]})

    # every pair of shards of a label once, dealt out by the second
    first = index.select("label", "dim", F.col("shard").alias("q_shard"), F.explode(F.sequence("shard", F.col("shards") - 1)).alias("shard"),
                         *[F.col(c).alias(f"q_{c}") for c in ("reps", "copies", "vectors", "edges")])
    asked = sorted_join(first, index.select("label", "dim", "shard", "reps", "copies", "vectors", "edges"), ["label", "dim", "shard"])
    found = saved(asked.groupBy("label", "dim", "shard", "q_shard").applyInArrow(search, "rep long, links long, to long"), "vector-links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comps = connected_components(found.select(F.col("rep").alias("a"), F.col("to").alias("b")), "vector-components")
    named = saved(sorted_join(sorted_join(nodes.select("label", "embedding", "rep", "first", "copies"), links, "rep", "left"),
                              comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")),
                  "vector-members")
    # a table of its own, so that Spark can split a large component's rows
    least = saved(named.groupBy("component").agg(F.min("first").alias("component_id")), "vector-names")
    named = sorted_join(named, least, "component").select(
        "label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id",
        F.lit(True).alias("good"))
    named = saved(named, "vector-named")
    return sorted_join(v, named, ["label", "embedding", "good"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _arrow_type(name: str) -> pa.DataType:
    return {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "smallint": pa.int16(), "tinyint": pa.int8()}[name]


def _verified(q: np.ndarray, x: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    keep = np.zeros(len(a), bool)
    for s in range(0, len(a), 1 << 16):
        e = s + (1 << 16)
        keep[s:e] = np.einsum("ij,ij->i", q[a[s:e]], x[b[s:e]]) >= least
    return a[keep], b[keep]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the links (a, b) with the smallest node it is joined to."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    root = np.arange(len(names))
    while len(x):
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        while (new[new] != new).any():
            new = new[new]
        new = new[root]
        if (new == root).all():
            break
        root = new
    return names, names[root]
