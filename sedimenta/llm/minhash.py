"""MinHash near-duplicates with fast similarity sketches, banding and exact verification.

Sketch.  Rounds of hashed bin placement: in each of the first t rounds every shingle
falls into a hashed bin, in the next t rounds all of them into one bin each, so every
coordinate is filled after 2t rounds at the latest; a coordinate holds the least (round,
hash).  Two sketches agree in a coordinate with the sets' Jaccard similarity, and their
agreement is concentrated.

Candidates.  Documents with equal shingle sets are one class, represented by its smallest
id.  Representatives that agree in a whole band share a bucket.  First every member is
checked against one centre, the member of its buckets that shares most buckets with others,
and components are formed.  Then members of one bucket that are still in different
components are compared block by block, by sizes, sketches and hashed sets, and a block
returns a spanning forest of the links it finds.  So a large group costs one check a
member, while no pair of a bucket that could join two components is left out.

Verification counts whole shingle sets of the words themselves.

Defined results: a null, empty or blank text has no shingles and is linked with nothing;
fewer than k words are one shingle; repeated rows link as copies; a row with a null id is
kept, and its component is that of its copies if any, else null; rows that share an id
are one vertex with the links of each; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BY_SPACE, LOWER, blocks, mix, settle, shingle_hashes, span_hashes, text_buffer, word_spans
from .components import connected_components

ROWS = 4
#: Chance that a pair exactly at the threshold shares no band.
MISS = 1e-6
STAR = 256
BLOCK = 512


def bands_for(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """Fast similarity sketches (len(sets) x t) of arrays of distinct 64-bit hashes; an
    empty set's row is meaningless."""
    n = len(sets)
    out = np.full(n * t, np.iinfo(np.uint64).max, np.uint64)
    sizes = np.fromiter((len(s) for s in sets), np.int64, n)
    values = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    rows = np.repeat(np.arange(n), sizes)
    for i in range(2 * t):
        if not len(values):
            break
        h = mix(values + np.uint64((0xD1B54A32D192ED03 * (i + 1)) & 0xFFFFFFFFFFFFFFFF))
        bins = ((h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else i - t
        np.minimum.at(out, rows * t + bins, (np.uint64(i) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF)))
        done = (out.reshape(n, t) != np.iinfo(np.uint64).max).all(axis=1)
        if done.any():
            left = ~done[rows]
            values, rows = values[left], rows[left]
    return out.reshape(n, t)


def _sets(buf: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    starts, ends, first = word_spans(buf, offsets, BY_SPACE)
    hashes = span_hashes(buf, starts, ends)
    every = shingle_hashes(hashes, k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        own = every[a : b - k + 1] if b - a >= k else shingle_hashes(hashes[a:b], b - a) if b > a else every[:0]
        out.append(np.unique(own))
    return out


def signature_table(docs: DataFrame, k: int, bands: int, rows: int = ROWS) -> DataFrame:
    """``doc_id, n_shingles, digest`` (of the set), ``bands`` (64-bit keys) and ``sketch``
    (16 bits a coordinate) per row."""
    t = bands * rows

    def sign(batches):
        for batch in batches:
            buf, offsets = text_buffer(batch.column("t"))
            counts, digests, keys, packed = [], [], [], []
            for a, b in blocks(offsets):
                sets = _sets(LOWER[buf[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a], k)
                sk = mix(sketches(sets, t).reshape(-1)).reshape(len(sets), bands, rows)
                key = np.zeros((len(sets), bands), np.uint64)
                for r in range(rows):
                    key = mix(key * np.uint64(0x9FB21C651E98DF25) + sk[:, :, r])
                key = mix(key + np.arange(bands, dtype=np.uint64))
                keys.append(key.astype(np.int64))
                counts += [len(s) for s in sets]
                digests += [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                packed += [x.tobytes() for x in sk.reshape(len(sets), t).astype(np.uint16)]
            flat = np.concatenate(keys).reshape(-1) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()),
                 pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, bands, dtype=np.int32), pa.array(flat)), pa.array(packed, pa.binary())],
                names=["doc_id", "n_shingles", "digest", "bands", "sketch"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("t")).mapInArrow(
        sign, "doc_id long, n_shingles long, digest binary, bands array<long>, sketch binary"
    )


def shingle_set(text: str | None, k: int) -> set:
    """The exact shingle set: words are runs of anything but ASCII white space, A-Z lower-cased."""
    w = text.encode().lower().split() if text else []
    return set(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else {tuple(w)} if w else set()


def _verify(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs ``(c, x)`` with 100 * common >= percent * union.  A centre's partners are
    dealt to parts of about ``STAR``, each with a copy of the centre's text."""
    sizes = pairs.groupBy("c").agg(F.ceil(F.count("*") / F.lit(STAR)).cast("int").alias("parts"))
    dealt = settle(pairs.join(sizes, "c").select("c", "x", "parts", F.pmod(F.xxhash64("x"), F.col("parts")).cast("int").alias("part")), "near-pairs")
    seats = dealt.select("c", "part", F.col("x").alias("id"), F.lit(1).alias("seat")).unionByName(
        dealt.select("c", "part").distinct().select("c", "part", F.col("c").alias("id"), F.lit(0).alias("seat"))
    )
    rows = seats.join(texts, "id")

    def check(batches):
        at, centre = None, []
        for batch in batches:
            cs, parts, seats_, ids = (batch.column(n).to_numpy() for n in ("c", "part", "seat", "id"))
            found_c, found_x = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                if (cs[i], parts[i]) != at:
                    at, centre = (cs[i], parts[i]), []
                own = shingle_set(text, k)
                if seats_[i] == 0:
                    centre.append(own)
                    continue
                for s in centre:
                    common = len(s & own)
                    if common and 100 * common >= percent * (len(s) + len(own) - common):
                        found_c.append(cs[i])
                        found_x.append(ids[i])
                        break
            yield pa.RecordBatch.from_arrays([pa.array(found_c, pa.int64()), pa.array(found_x, pa.int64())], names=["a", "b"])

    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select("c", "part", "seat", "id", "text").repartition(n, "c", "part").sortWithinPartitions("c", "part", "seat").mapInArrow(check, "a long, b long")


def _hashed_sets(texts: DataFrame, k: int) -> DataFrame:
    """``x, hashes``: the set of each text as sorted 32-bit hashes."""

    def hashed(batches):
        for batch in batches:
            buf, offsets = text_buffer(batch.column("text"))
            out = []
            for a, b in blocks(offsets):
                out += [np.unique((s >> np.uint64(32)).astype(np.uint32)).tobytes() for s in _sets(LOWER[buf[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a], k)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], names=["x", "hashes"])

    return texts.select("id", F.col("text").cast("string").alias("text")).mapInArrow(hashed, "x long, hashes binary")


def _agreement(percent: int, t: int) -> float:
    """The share of equal coordinates that a pair at the threshold falls short of with a
    chance of ``MISS``."""
    p, total = percent / 100, 0.0
    for i in range(t + 1):
        total += math.exp(math.lgamma(t + 1) - math.lgamma(i + 1) - math.lgamma(t - i + 1) + i * math.log(p) + (t - i) * math.log1p(-p))
        if total > MISS:
            return i / t
    return p


def _block_links(rows: list[list], percent: int) -> tuple[list[int], list[int]]:
    """Links between components within one block of [x, comp, n, sketch, hashes]: those that
    join what earlier ones have not.  A link that two hash collisions could have made is
    returned but joins nothing here."""
    xs, comps = [r[0] for r in rows], np.array([r[1] for r in rows])
    ns = np.array([r[2] for r in rows], float)
    sketch = np.stack([np.frombuffer(r[3], np.uint16) for r in rows])
    sets = [np.frombuffer(r[4], np.uint32) for r in rows]
    floor, least = _agreement(percent, sketch.shape[1]), percent / 100
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while parent.setdefault(c, c) != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    out_a, out_b = [], []
    for i in range(len(xs) - 1):
        j = np.flatnonzero((comps[i + 1 :] != comps[i]) & (np.minimum(ns[i + 1 :], ns[i]) >= least * np.maximum(ns[i + 1 :], ns[i]))) + i + 1
        if not len(j):
            continue
        agree = (sketch[j] == sketch[i]).mean(axis=1)
        j, agree = j[agree >= floor], agree[agree >= floor]
        for o in j[np.argsort(-agree, kind="stable")].tolist():
            if root(int(comps[i])) == root(int(comps[o])):
                continue
            common = len(np.intersect1d(sets[i], sets[o], assume_unique=True))
            union = ns[i] + ns[o] - common
            if 100 * (common + 2) < percent * (union - 2):
                continue
            out_a.append(min(xs[i], xs[o]))
            out_b.append(max(xs[i], xs[o]))
            if 100 * (common - 2) >= percent * (union + 2):
                parent[root(int(comps[i]))] = root(int(comps[o]))
    return out_a, out_b


def _cross_pairs(live: DataFrame, places: DataFrame, signs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of a bucket that join different components.  Only members outside a bucket's
    largest component are compared with all others, in blocks of about ``BLOCK``; the
    largest component is never compared with itself."""
    placed = live.join(places.withColumnRenamed("id", "x"), "x", "left").select("key", "x", F.coalesce("component", "x").alias("comp"))
    sizes = placed.groupBy("key", "comp").agg(F.count("*").alias("m"))
    mixed = sizes.groupBy("key").agg(F.max(F.struct("m", "comp")).alias("top"), F.sum("m").alias("all"), F.count("*").alias("comps")).where("comps > 1")
    mixed = mixed.select("key", F.col("top.comp").alias("big"), F.ceil((F.col("all") - F.col("top.m")) / BLOCK).cast("int").alias("no"), F.ceil(F.col("top.m") / BLOCK).cast("int").alias("ng"))
    members = placed.join(mixed, "key").withColumn("other", F.col("comp") != F.col("big"))
    own = F.pmod(F.xxhash64("x"), F.when(F.col("other"), F.col("no")).otherwise(F.col("ng"))).cast("int")
    members = settle(members.withColumn("own", own), "near-mixed")
    # tasks (i, j): blocks of others; (i, -1 - j): a block of others with one of the largest component
    to_others = members.where("other").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("no") - 1))).select("key", "x", "comp", F.least("own", "j").alias("i"), F.greatest("own", "j").alias("j"))
    to_big = members.where("other").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("ng") - 1))).select("key", "x", "comp", F.col("own").alias("i"), (-1 - F.col("j")).alias("j"))
    big = members.where("not other").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("no") - 1))).select("key", "x", "comp", "i", (-1 - F.col("own")).alias("j"))
    tasks = to_others.unionByName(to_big).unionByName(big)
    # A bucket with the members of another one brings no new pairs.
    same = members.groupBy("key").agg(F.count("*").alias("m"), F.sum(F.xxhash64("x").cast("decimal(38,0)")).alias("h")).groupBy("m", "h").agg(F.min("key").alias("key"))
    tasks = tasks.join(same.select("key"), "key", "left_semi")
    rows = tasks.join(signs.select(F.col("doc_id").alias("x"), "n_shingles", "sketch"), "x").join(sets, "x")

    def search(batches):
        at, own = None, []
        for batch in batches:
            out_a, out_b = [], []
            columns = [batch.column(n).to_pylist() for n in ("key", "i", "j", "x", "comp", "n_shingles", "sketch", "hashes")]
            for key, i, j, *row in zip(*columns, strict=True):
                if (key, i, j) != at:
                    a, b = _block_links(own, percent) if len(own) > 1 else ([], [])
                    out_a, out_b, own, at = out_a + a, out_b + b, [], (key, i, j)
                own.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["c", "x"])
        if len(own) > 1:
            a, b = _block_links(own, percent)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["c", "x"])

    n = int(live.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = rows.select("key", "i", "j", "x", "comp", "n_shingles", "sketch", "hashes").repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return cut.mapInArrow(search, "c long, x long").distinct()


def near_duplicates(docs: DataFrame, *, k: int = 5, percent: int = 80, rows: int = ROWS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row of ``docs(doc_id, text)``."""
    bands = bands_for(percent / 100, rows)
    signs = settle(signature_table(docs, k, bands, rows), "near-signs")
    known = signs.where("doc_id is not null and n_shingles > 0")
    classes = settle(known.groupBy("digest").agg(F.min("doc_id").alias("rep")), "near-classes")
    reps = settle(
        known.join(classes.select(F.col("rep").alias("doc_id"), F.col("digest").alias("d")), "doc_id").where("digest = d").dropDuplicates(["doc_id", "digest"]).drop("d"), "near-reps"
    )
    postings = reps.select(F.col("doc_id").alias("x"), F.explode("bands").alias("key"))
    shared = postings.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    live = settle(postings.join(shared, "key"), "near-live")
    degrees = live.groupBy("x").agg(F.sum("m").alias("degree"))
    centres = live.join(degrees, "x").groupBy("key").agg(F.max(F.struct("degree", (-F.col("x")).alias("neg"))).alias("top")).select("key", "top.degree", (-F.col("top.neg")).alias("c"))
    best = F.max(F.struct("degree", (-F.col("c")).alias("neg"))).alias("best")
    stars = live.join(centres, "key").groupBy("x").agg(best).select((-F.col("best.neg")).alias("c"), "x").where("c <> x")
    needed = live.select(F.col("x").alias("id")).distinct()
    texts = settle(docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(needed, "id", "left_semi"), "near-texts")
    # Rows that share an id, or a class through another row of that id, are one vertex.
    same = known.join(classes, "digest").where("rep <> doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    links = settle(_verify(stars, texts, k, percent), "near-links")
    places = settle(connected_components(links, "near-first"), "near-places")
    rest = settle(_cross_pairs(live, places, reps, _hashed_sets(texts, k), percent), "near-rest")
    more = settle(_verify(rest, texts, k, percent), "near-more")
    final = settle(connected_components(places.select(F.col("component").alias("a"), F.col("id").alias("b")).unionByName(more), "near-final"), "near-final")
    # Smallest id of a class is its representative, so copies only look their class up.
    multi = same.join(known.groupBy("doc_id").agg(F.countDistinct("digest").alias("own")).where("own > 1").select(F.col("doc_id").alias("b")), "b", "left_semi")
    if not multi.isEmpty():
        final = settle(connected_components(final.select(F.col("component").alias("a"), F.col("id").alias("b")).unionByName(multi.select("a", "b")), "near-multi"), "near-final")
    named = classes.join(final.withColumnRenamed("id", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    out = signs.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("digest")).alias("digest")).join(named, "digest", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, *, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the documents whose component has a smaller id; rows that share an
    id stay or go together."""
    found = settle(near_duplicates(docs.select("doc_id", "text"), k=k, percent=percent), "near-report")
    gone = found.where("not kept").select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti")  # one plan at every size
