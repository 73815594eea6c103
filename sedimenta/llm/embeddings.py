"""Embedding near-duplicates with hierarchical navigable small-world graphs.

Vectors of one label are dealt by a hash of id and vector to shards of at most about
``SHARD_BYTES``, and every shard gets a graph of its own, so that runs over the same rows
build the same graphs.  Every vector queries every shard of its label: for a pair of shards
one task searches the vectors of one in the graph of the other, which moves each shard once
a pair, as queries or as a graph.  A search keeps a beam; a query whose whole beam passes
the threshold has more links than the beam holds and is compared with the whole shard.  A
task's beams are widened until an audit finds the wanted recall, averaged over queries;
should even wide beams fail, the task compares with the whole shard.  The audit looks at two
sets of queries: some of the task's own that have links to other vectors, and probes planted
beside indexed vectors within the threshold, so that there is always something to find.
Links found are verified by cosine in double precision; a task returns link counts, a
spanning forest of its links, never the links of a dense group, and what its audit found.
The forests' connected components are the classes.

Defined results: vectors that are null, empty, zero or hold null or non-finite components,
and rows with a null label, have no links; vectors of different lengths are not compared;
a row with a null id links as any other, its component is the smallest id of its class (null
if there is none) and it is kept; repeated rows are vectors of their own that link as any
others; vectors that tie are all linked, whatever their order; vectors may be of any length;
columns other than the three named are not read; an empty table gives no rows.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, settle
from .components import connected_components

#: Bytes of a shard's vectors in double precision.
SHARD_BYTES = 16 << 20
DEGREE = 16
BUILD_BEAM = 48
BEAM = 48
#: Own queries with links and planted probes of an audit; own queries are looked at in
#: ``DRAWS`` draws of ``AUDIT`` at most, so that data without links cost no scan.
AUDIT = 32
DRAWS = 8
PROBES = 128
RECALL = 0.99
#: Beams of 1 / WHOLE of a shard that miss the recall give way to the whole shard.
WHOLE = 8
#: Queries that are searched or compared in one step.
STEP = 256


def _top(ids: np.ndarray, sims: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` best columns of each row, best first; repeats and -1 count last."""
    order = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


class Graph:
    """Levels of neighbour lists; level 0 holds all vectors with twice the degree."""

    def __init__(self, vectors: np.ndarray, degree: int = DEGREE, build_beam: int = BUILD_BEAM, batch: int = 64):
        self.v = vectors.astype(np.float32)
        n = len(vectors)
        u = (mix(np.arange(1, n + 1, dtype=np.uint64)) >> np.uint64(11)).astype(np.float64) / (1 << 53)
        level = np.minimum((-np.log(np.maximum(u, 1e-12)) / math.log(degree)).astype(int), 8)
        order = np.argsort(-level, kind="stable")  # upper levels first: the entry point is on top
        self.level, self.entry = level, int(order[0]) if n else -1
        self.links = [np.full((n, 2 * degree if l == 0 else degree), -1, np.int32) for l in range(int(level.max()) + 1 if n else 1)]
        self.present = [np.zeros(n, bool) for _ in self.links]
        done = 0
        while done < n:
            size = min(batch, max(1, done))  # a batch is never larger than the graph
            new = order[done : done + size]
            found = self._descend(self.v[new], build_beam, collect=True) if done else {}
            for l in range(len(self.links) - 1, -1, -1):
                own = np.flatnonzero(level[new] >= l)
                if not len(own):
                    continue
                ids = found.get(l, (np.full((len(new), 1), -1), np.full((len(new), 1), -np.inf)))
                among = self.v[new] @ self.v[new[own]].T
                among[own, np.arange(len(own))] = -np.inf
                cand = np.concatenate((ids[0], np.broadcast_to(new[own], (len(new), len(own)))), axis=1)
                sims = np.concatenate((ids[1], among), axis=1)
                for i in own:
                    self._connect(l, int(new[i]), *self._choose(cand[i], sims[i], degree))
                self.present[l][new[own]] = True
            done += size

    def _choose(self, cand: np.ndarray, sims: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Near and diverse: a candidate closer to a chosen one than to the vector waits
        until the rest is chosen."""
        keep = np.isfinite(sims) & (cand >= 0)
        cand, sims = cand[keep], sims[keep]
        order = np.argsort(-sims, kind="stable")[: 4 * most]
        cand, sims = cand[order], sims[order]
        if len(cand) <= most:
            return cand, sims
        among = self.v[cand] @ self.v[cand].T
        chosen: list[int] = []
        waiting: list[int] = []
        for i in range(len(cand)):
            if len(chosen) >= most:
                break
            (waiting if chosen and among[i, chosen].max() > sims[i] else chosen).append(i)
        chosen += waiting[: most - len(chosen)]
        return cand[chosen], sims[chosen]

    def _connect(self, l: int, node: int, near: np.ndarray, sims: np.ndarray) -> None:
        links = self.links[l]
        width = links.shape[1]
        before = links[node][(links[node] >= 0) & ~np.isin(links[node], near)]  # of its own batch
        row = np.concatenate((near, before))[:width]
        links[node, : len(row)], links[node, len(row) :] = row, -1
        for other in near.tolist():
            row = links[other]
            if (row == node).any():
                continue
            free = np.flatnonzero(row < 0)
            if len(free):
                row[free[0]] = node
            else:
                cand = np.append(row, node)
                kept, _ = self._choose(cand, self.v[cand] @ self.v[other], width)
                row[:] = -1
                row[: len(kept)] = kept

    def _beam(self, l: int, q: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of all queries in step; ``start``: entry columns per query."""
        links, n = self.links[l], len(self.v)
        rows = np.arange(len(q))[:, None]
        seen = np.zeros((len(q), n + 1), bool)
        seen[rows, start] = True
        sims = np.where(start >= 0, np.einsum("ijk,ik->ij", self.v[start], q), -np.inf)
        ids, sims = _top(start, sims, beam)
        open_ = ids >= 0
        active = np.arange(len(q))
        while len(active):
            best = np.argmax(np.where(open_[active], sims[active], -np.inf), axis=1)
            some = open_[active, best]
            active, best = active[some], best[some]
            if not len(active):
                break
            open_[active, best] = False
            near = links[ids[active, best]]
            fresh = ~seen[active[:, None], near] & (near >= 0)
            seen[active[:, None], near] = True
            near = np.where(fresh, near, -1)
            got = np.where(fresh, np.einsum("ijk,ik->ij", self.v[near], q[active]), -np.inf)
            all_ids = np.concatenate((ids[active], near), axis=1)
            all_sims = np.concatenate((sims[active], got), axis=1)
            all_open = np.concatenate((open_[active], fresh), axis=1)
            order = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            width = order.shape[1]
            if width > ids.shape[1]:
                grow = ((0, 0), (0, width - ids.shape[1]))
                ids, sims, open_ = np.pad(ids, grow, constant_values=-1), np.pad(sims, grow, constant_values=-np.inf), np.pad(open_, grow)
            ids[active, :width] = np.take_along_axis(all_ids, order, 1)
            sims[active, :width] = np.take_along_axis(all_sims, order, 1)
            open_[active, :width] = np.take_along_axis(all_open, order, 1) & np.isfinite(sims[active, :width])
        return ids, sims

    def _descend(self, q: np.ndarray, beam: int, collect: bool = False):
        q = q.astype(np.float32)
        start = np.full((len(q), 1), self.entry)
        found = {}
        for l in range(len(self.links) - 1, -1, -1):
            if not self.present[l].any():
                continue
            ids, sims = self._beam(l, q, start, beam if l == 0 or collect else 1)
            found[l] = (ids, sims)
            start = ids
        return found if collect else found[0]

    def search(self, q: np.ndarray, beam: int) -> np.ndarray:
        """Ids (-1: none) of the beam at the end, per query."""
        out = [self._descend(q[i : i + 256], beam)[0] for i in range(0, len(q), 256)]
        width = max(x.shape[1] for x in out)
        return np.concatenate([np.pad(x, ((0, 0), (0, width - x.shape[1])), constant_values=-1) for x in out])

    def pack(self) -> bytes:
        to = io.BytesIO()
        np.savez(to, entry=self.entry, **{f"links{i}": x for i, x in enumerate(self.links)}, **{f"present{i}": x for i, x in enumerate(self.present)})
        return to.getvalue()

    @classmethod
    def unpack(cls, data: bytes, vectors: np.ndarray) -> Graph:
        own = cls.__new__(cls)
        with np.load(io.BytesIO(data)) as f:
            own.v, own.entry = vectors.astype(np.float32), int(f["entry"])
            n = sum(k.startswith("links") for k in f.files)
            own.links, own.present = [f[f"links{i}"] for i in range(n)], [f[f"present{i}"] for i in range(n)]
        return own


def _probes(index: np.ndarray, least: float) -> np.ndarray:
    """Vectors at a cosine halfway between ``least`` and 1 to indexed ones, spread over the shard."""
    at = np.unique(np.linspace(0, len(index) - 1, min(PROBES, len(index))).astype(int))
    cosine = min(1.0, max(0.0, (1 + least) / 2))
    aside = np.random.default_rng(len(index)).normal(size=(len(at), index.shape[1]))
    aside -= np.einsum("ij,ij->i", aside, index[at])[:, None] * index[at]
    length = np.linalg.norm(aside, axis=1)[:, None]
    aside = np.where(length > 1e-9, aside / np.maximum(length, 1e-9), 0)
    out = cosine * index[at] + math.sqrt(1 - cosine * cosine) * aside
    return out / np.linalg.norm(out, axis=1)[:, None]


class Audit(NamedTuple):
    """What an audit has seen: the beam that passed (0: the whole shard), the number of own
    queries with links, and the recall of these and of the planted probes."""

    beam: int
    own: int
    own_recall: float
    probe_recall: float


def _recall(got: np.ndarray, truth: np.ndarray) -> float:
    """The mean share of true links found, over the queries that have any."""
    some = truth.any(axis=1)
    return float(((got & truth)[some].sum(axis=1) / truth[some].sum(axis=1)).mean()) if some.any() else 1.0


def _scan(index: np.ndarray, queries: np.ndarray, least: float) -> np.ndarray:
    return queries @ index.T >= least


def _search(graph: Graph, index: np.ndarray, queries: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector) pairs with cosine >= ``least`` in the beams, and whose beam is full."""
    ids = graph.search(queries, beam)
    sims = np.einsum("ijk,ik->ij", index[ids], queries)
    ok = (ids >= 0) & (sims >= least)
    r, c = np.nonzero(ok)
    return r, ids[r, c], ok.sum(axis=1) >= min(beam, len(index))


def _audit(graph: Graph, index: np.ndarray, queries: np.ndarray, least: float, recall: float, same: bool) -> Audit:
    """Widen the beam until own queries and probes find their links; ``same``: the queries
    are the index, and finding oneself says nothing."""
    n = len(index)
    order = np.random.default_rng(len(queries)).permutation(len(queries))
    own, seen = [], 0
    for at in range(0, min(len(order), AUDIT * DRAWS), AUDIT):
        draw = order[at : at + AUDIT]
        truth = _scan(index, queries[draw], least)
        if same:
            truth[np.arange(len(draw)), draw] = False
        some = truth.any(axis=1)
        own.append((draw[some], truth[some]))
        seen += int(some.sum())
        if seen >= AUDIT:
            break
    mine = np.concatenate([d for d, _ in own]) if own else np.zeros(0, np.int64)
    truth = np.concatenate([t for _, t in own]) if own else np.zeros((0, n), bool)
    probes = _probes(index, least)
    planted = _scan(index, probes, least)

    def found(q: np.ndarray, beam: int) -> np.ndarray:
        out = np.zeros((len(q), n), bool)
        if len(q):
            r, c, full = _search(graph, index, q, least, beam)
            out[r, c] = True
            out[full] = _scan(index, q[full], least)
        return out

    beam = min(BEAM, n)
    while True:
        at = Audit(beam, seen, _recall(found(queries[mine], beam), truth), _recall(found(probes, beam), planted))
        if min(at.own_recall, at.probe_recall) >= recall:
            return at
        beam *= 2
        if beam * WHOLE >= n:
            return Audit(0, seen, 1.0, 1.0)


def _steps(graph: Graph, index: np.ndarray, queries: np.ndarray, least: float, beam: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, vector, queries compared with the whole shard) step by step."""
    for at in range(0, len(queries), STEP):
        q = queries[at : at + STEP]
        if beam:
            r, c, full = _search(graph, index, q, least, beam)
            r, c = r[~full[r]], c[~full[r]]
        else:
            r, c, full = np.zeros(0, np.int64), np.zeros(0, np.int64), np.ones(len(q), bool)
        dense = np.flatnonzero(full)
        x, y = np.nonzero(_scan(index, q[dense], least))
        yield np.concatenate((r, dense[x])) + at, np.concatenate((c, y)), dense + at


def _links(graph: Graph, index: np.ndarray, queries: np.ndarray, least: float, recall: float) -> tuple[np.ndarray, np.ndarray]:
    """All (query, vector) pairs that the graph finds."""
    beam = _audit(graph, index, queries, least, recall, index is queries).beam
    steps = list(_steps(graph, index, queries, least, beam))
    return np.concatenate([x for x, _, _ in steps]), np.concatenate([y for _, y, _ in steps])


class Forest:
    """Links that join what earlier ones have not joined."""

    def __init__(self, n: int):
        self.root, self.edges = np.arange(n), []

    def join(self, x: int, others: np.ndarray) -> None:
        roots, first = np.unique(self.root[others], return_index=True)
        new = roots != self.root[x]
        if new.any():
            self.edges += [(x, int(others[i])) for i in first[new]]
            self.root[np.isin(self.root, roots[new])] = self.root[x]

    def join_pairs(self, a: np.ndarray, b: np.ndarray) -> None:
        """Each node in turn; ``a`` is sorted."""
        ends = np.flatnonzero(np.append(a[1:] != a[:-1], True)) + 1 if len(a) else np.zeros(0, np.int64)
        for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=False):
            self.join(int(a[lo]), b[lo:hi])


def _within(graph: Graph, v: np.ndarray, least: float, recall: float) -> tuple[np.ndarray, list, Audit]:
    """(links a vector, forest, audit) of one shard.  A pair is a link if either end finds
    the other.  Queries compared with the whole shard have exact counts, and the links among
    them are not held; all others have fewer links than a beam and are held as pairs."""
    n, audit = len(v), _audit(graph, v, v, least, recall, True)
    counts, forest, held, dense = np.zeros(n, np.int64), Forest(n), [], np.zeros(n, bool)
    for x, y, whole in _steps(graph, v, v, least, audit.beam):
        dense[whole] = True
        some = (x != y) & ~dense[x]
        held.append(np.minimum(x[some], y[some]) * n + np.maximum(x[some], y[some]))
    for at in range(0, n, STEP):
        own = np.flatnonzero(dense[at : at + STEP]) + at
        if len(own):
            row = _scan(v, v[own], least)
            row[np.arange(len(own)), own] = False
            counts[own] = row.sum(axis=1)
            for x, links in zip(own.tolist(), row, strict=True):
                forest.join(x, np.flatnonzero(links))
            x, y = np.nonzero(row & ~dense)
            x = own[x]
            held.append(np.minimum(x, y) * n + np.maximum(x, y))
    pairs = np.unique(np.concatenate(held)) if held else np.zeros(0, np.int64)
    a, b = pairs // n, pairs % n
    for ends in (a, b):
        np.add.at(counts, ends[~dense[ends]], 1)
    forest.join_pairs(a, b)
    return counts, forest.edges, audit


def _across(graph: Graph, index: np.ndarray, queries: np.ndarray, least: float, recall: float) -> tuple[np.ndarray, np.ndarray, list, Audit]:
    """(links a query, links a vector, forest over queries and then vectors, audit)."""
    audit = _audit(graph, index, queries, least, recall, False)
    mine, theirs, forest = np.zeros(len(queries), np.int64), np.zeros(len(index), np.int64), Forest(len(queries) + len(index))
    for x, y, _ in _steps(graph, index, queries, least, audit.beam):
        mine += np.bincount(x, minlength=len(queries))
        theirs += np.bincount(y, minlength=len(index))
        order = np.argsort(x, kind="stable")
        forest.join_pairs(x[order], y[order] + len(queries))
    return mine, theirs, forest.edges, audit


def _unit(raw: np.ndarray, dim: int) -> np.ndarray:
    v = np.frombuffer(raw, np.float64).reshape(-1, dim)
    return v / np.linalg.norm(v, axis=1)[:, None]


AUDITED = "label {}, dim int, i int, j int, queries long, vectors long, beam int, own_queries long, own_recall double, probe_recall double"


def find_links(
    rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    least: float = 0.93, shard: int | None = None, recall: float = RECALL,
) -> tuple[DataFrame, DataFrame]:
    """(``vec_id, n_links, component_id, kept`` per row, the audit of every pair of shards);
    ``shard``: vectors a shard, by ``SHARD_BYTES`` unless given."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    every = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    every = settle(every.withColumn("row", F.monotonically_increasing_id()), "vectors")  # fixed once written
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    good = every.where(F.col("label").isNotNull() & F.col("v").isNotNull()).where(fine).withColumn("dim", F.size("v"))
    most = F.lit(shard) if shard else F.greatest(F.lit(1), F.floor(F.lit(SHARD_BYTES) / (8 * F.col("dim"))))
    groups = settle(good.groupBy("label", "dim").agg(F.count("*").alias("m")).select("label", "dim", F.ceil(F.col("m") / most).cast("int").alias("shards")), "vector-groups")
    dealt = good.join(groups, ["label", "dim"]).withColumn("h", F.xxhash64("vec_id", "v")).withColumn("s", F.pmod("h", "shards").cast("int"))
    kind = every.schema["label"].dataType.simpleString()

    def build(batches):
        at, keys, ids, vs = None, None, [], []

        def flush():
            v = np.concatenate(vs)
            scaled = v / np.abs(v).max(axis=1)[:, None]  # large components would overflow their squares
            graph = Graph(scaled / np.linalg.norm(scaled, axis=1)[:, None])
            columns = [pa.array([at[0]], keys), pa.array([at[1]], pa.int32()), pa.array([at[2]], pa.int32())]
            columns += [pa.array([x], pa.binary()) for x in (np.concatenate(ids).tobytes(), scaled.tobytes(), graph.pack())]
            return pa.RecordBatch.from_arrays(columns, names=["label", "dim", "s", "rows", "vectors", "graph"])

        for batch in batches:
            keys = batch.schema.field("label").type
            names = list(zip(*(batch.column(c).to_pylist() for c in ("label", "dim", "s")), strict=True))
            ends = [i + 1 for i in range(len(names)) if i + 1 == len(names) or names[i] != names[i + 1]]
            for a, b in zip([0, *ends], ends, strict=False):
                if names[a] != at:
                    if ids:
                        yield flush()
                    at, ids, vs = names[a], [], []
                ids.append(batch.column("row")[a:b].to_numpy().astype(np.int64))
                vs.append(batch.column("v")[a:b].flatten().to_numpy().reshape(-1, at[1]).astype(np.float64))
        if ids:
            yield flush()

    ordered = dealt.select("label", "dim", "s", "h", "row", "v").repartitionByRange(parts, "label", "dim", "s").sortWithinPartitions("label", "dim", "s", "h", "row").drop("h")
    shards = settle(ordered.mapInArrow(build, f"label {kind}, dim int, s int, rows binary, vectors binary, graph binary"), "vector-shards")

    pairs = groups.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).withColumn("j", F.explode(F.sequence(F.col("i"), F.col("shards") - 1)))
    pairs = settle(pairs.select("label", "dim", "i", "j"), "vector-pairs")
    left = shards.select("label", "dim", F.col("s").alias("i"), *[F.col(c).alias(f"{c}_i") for c in ("rows", "vectors")])
    right = shards.select("label", "dim", F.col("s").alias("j"), *[F.col(c).alias(f"{c}_j") for c in ("rows", "vectors", "graph")])
    # A pair a task: a batch never holds many shards.
    tasks = pairs.join(left, ["label", "dim", "i"]).join(right, ["label", "dim", "j"]).repartition(max(parts, pairs.count()))

    def match(batches):
        for batch in batches:
            for t in range(batch.num_rows):  # one pair of shards in memory at a time
                get = lambda c: batch.column(c)[t].as_py()  # noqa: B023, E731
                dim, same = get("dim"), get("i") == get("j")
                a, b = _unit(get("vectors_i"), dim), _unit(get("vectors_j"), dim)
                rows_a, rows_b = (np.frombuffer(get(c), np.int64) for c in ("rows_i", "rows_j"))
                graph = Graph.unpack(get("graph_j"), b)
                if same:
                    counts, edges, audit = _within(graph, b, least, recall)
                    both = rows_b
                else:
                    *ends, edges, audit = _across(graph, b, a, least, recall)
                    both, counts = np.concatenate((rows_a, rows_b)), np.concatenate(ends)
                linked = np.flatnonzero(counts)
                ends = np.array(edges, np.int64).reshape(-1, 2)
                n, m = len(linked), len(ends)
                told = {"label": get("label"), "dim": dim, "i": get("i"), "j": get("j"), "queries": len(a), "vectors": len(b), "beam": audit.beam, "own_queries": audit.own, "own_recall": audit.own_recall, "probe_recall": audit.probe_recall}
                kinds = pa.struct([("label", batch.schema.field("label").type), ("dim", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("queries", pa.int64()), ("vectors", pa.int64()), ("beam", pa.int32()), ("own_queries", pa.int64()), ("own_recall", pa.float64()), ("probe_recall", pa.float64())])
                column = lambda own, before, after: pa.concat_arrays([pa.nulls(before, pa.int64()), pa.array(own), pa.nulls(after, pa.int64())])
                yield pa.RecordBatch.from_arrays(
                    [column(both[linked], 0, m + 1), column(counts[linked], 0, m + 1), column(both[ends[:, 0]], n, 1), column(both[ends[:, 1]], n, 1), pa.array([None] * (n + m) + [told], kinds)],
                    names=["row", "n", "a", "b", "audit"],
                )

    told = AUDITED.format(kind).replace(" ", ":").replace(",:", ",")
    found = settle(tasks.mapInArrow(match, f"row long, n long, a long, b long, audit struct<{told}>"), "vector-links")
    counts = found.where("row is not null").groupBy("row").agg(F.sum("n").alias("n_links"))
    classes = connected_components(found.where("a is not null").select("a", "b"), "vector").withColumnRenamed("id", "row")
    named = classes.join(every.select("row", "vec_id"), "row")
    least_ids = named.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    linked = classes.join(least_ids, "component").select("row", "component_id", F.lit(True).alias("linked"))
    out = every.select("vec_id", "row").join(counts, "row", "left").join(linked, "row", "left")
    component = F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("vec_id"))
    kept = F.coalesce(F.col("vec_id") == component, F.lit(True))
    result = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), kept.alias("kept"))
    return result, found.where("audit is not null").select("audit.*")


def link_embeddings(rows: DataFrame, **options) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row; for the options see :func:`find_links`."""
    return find_links(rows, **options)[0]
