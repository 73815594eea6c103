"""Removal of long repeated strings by blockwise suffix sorting with difference covers.

Every 400-byte string that starts at two places of the corpus is to be found.  Suffixes
are dealt to buckets, buckets are sorted one block at a time, each to a depth of 400
bytes, and neighbours that agree to that depth repeat.

Buckets.  The least of the hashed 16-byte strings within a 400-byte string (its anchor)
depends on that string alone, so equal strings have equal anchors at equal offsets.
Consecutive starts with one anchor are a run.  Runs whose anchor is alone in the corpus
hold no repeats.  Equal runs, by a 128-bit digest of their bytes, are one class with their
number as its weight: a compression of copies, so that a thousand of them are sorted once.
Classes are cut into slabs of starts aligned to the anchor, and a slab's bucket is the
string that all its 400-byte strings share.  A bucket of more than ``LARGEST`` slabs is cut
into narrower slabs with longer shared strings; what is large even then is dealt to
sub-blocks of ``LARGEST`` slabs.  Each is sorted as any block, one start a distinct string
stands for it, and the standing ones are bucketed by their whole string and sorted again: a
string has at most one of them a sub-block, however many slabs hold it.  A slab alone in its
bucket needs no sorting: its starts share an anchor at different offsets, so its strings
differ from each other, and any other place of theirs would have a slab in the bucket.  They
repeat if the class's weight says so.

Sorting.  Positions of a block whose residue modulo 31 lies in a difference cover are
ranked by their first 341 bytes, by doubling.  Suffixes are sorted by bucket and first 31
bytes; a tie between i and j goes to the cover: with d such that i + d and j + d are both
sampled, their ranks decide, and the bytes from 336 to 400 after them.  So ties of any
length cost no more than short ones, and memory is that of one block.

Defined results: a null text is an empty one; texts of fewer than 400 bytes lose nothing;
repeated rows repeat all their strings; rows with a null id are treated as any; whole texts
are treated, however long, and the runs of a text that are equal are one row; strings that
tie are all removed, whatever their order; columns other than the two named are not read; an
empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, blocks, hot_keys, join_hot, mix, text_buffer

LENGTH = 400
GRAM = 16
SLABS = (128, 16)
LARGEST = 4096
BLOCK = 1 << 20
#: Runs from which an anchor or a class may be hot.
LEAST_HOT = 500

#: A perfect difference cover: each residue is the difference of exactly one pair.
PERIOD = 31
COVER = (0, 1, 3, 8, 12, 18)
RANKED = 341
TAIL = tuple(range(336, 400, 8))


def _shift_table() -> np.ndarray:
    """[r, s]: the least d with r + d and s + d both in the cover."""
    inside = np.isin(np.arange(2 * PERIOD) % PERIOD, COVER)
    out = np.zeros((PERIOD, PERIOD), np.int64)
    for r in range(PERIOD):
        for s in range(PERIOD):
            out[r, s] = next(d for d in range(PERIOD) if inside[r + d] and inside[s + d])
    return out


SHIFT = _shift_table()


# --- runs -----------------------------------------------------------------------


def _words(buf: np.ndarray, kind: str) -> np.ndarray:
    """Eight bytes from every position on, as numbers."""
    return np.ndarray((max(0, len(buf) - 7),), kind, buf, strides=(1,))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchored_runs(buf: np.ndarray, offsets: np.ndarray):
    """(row, start in the row, starts, anchor's offset from the start, anchor's hash, place
    in ``buf``) of the runs of all rows."""
    none = tuple(np.zeros(0, np.int64) for _ in range(6))
    if len(buf) < LENGTH:
        return none
    buf = np.ascontiguousarray(buf)
    word = _words(buf, "<u8")
    grams = len(buf) - GRAM + 1
    h = mix(word[:grams] * np.uint64(0x9FB21C651E98DF25) + mix(word[8 : 8 + grams]))
    bits = np.uint64(max(20, int(len(buf)).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    least = _sliding_min((h & ~low) | np.arange(grams, dtype=np.uint64), LENGTH - GRAM + 1)
    anchor = (least & low).astype(np.int64)
    sizes = np.diff(offsets)
    starts = np.maximum(sizes - LENGTH + 1, 0)
    rows = np.repeat(np.arange(len(sizes)), starts)
    if not len(rows):
        return none
    places = np.arange(len(rows)) - np.repeat(np.cumsum(starts) - starts, starts) + np.repeat(offsets[:-1], starts)
    own = anchor[places]
    cut = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (rows[1:] != rows[:-1]))))
    n = np.diff(np.concatenate((cut, [len(rows)])))
    place = places[cut]
    return rows[cut], place - offsets[rows[cut]], n, own[cut] - place, h[own[cut]].astype(np.int64), place


def _occurrences(docs: DataFrame) -> DataFrame:
    """``h, d, starts, n, off, k1, k2``: the runs of all rows; (h, d) is a run's class, and
    a row's runs of one class are together."""

    def cut(batches):
        for batch in batches:
            buf, offsets = text_buffer(batch.column("t"))
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            for a, b in blocks(offsets):
                part = np.ascontiguousarray(buf[offsets[a] : offsets[b]])
                row, start, n, off, h, place = anchored_runs(part, offsets[a : b + 1] - offsets[a])
                raw = memoryview(part.tobytes())
                digests = [hashlib.blake2b(raw[p : p + m + LENGTH - 1], digest_size=16).digest() for p, m in zip(place.tolist(), n.tolist(), strict=True)]
                key = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
                order, same = np.arange(len(row)), np.zeros(max(0, len(row) - 1), bool)
                if len(np.unique(mix(h.view(np.uint64)) + row.astype(np.uint64))) < len(row):
                    order = np.lexsort((start, key[:, 1], key[:, 0], row))
                    same = (row[order][1:] == row[order][:-1]) & (key[order][1:] == key[order][:-1]).all(axis=1)
                head = np.flatnonzero(np.append([True], ~same)) if len(order) else order
                one = order[head]
                starts = pa.ListArray.from_arrays(pa.array(np.append(head, len(order)).astype(np.int32)), pa.array(start[order].astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[one]), pa.array([digests[i] for i in one.tolist()], pa.binary()), starts, pa.array(n[one].astype(np.int32)), pa.array(off[one].astype(np.int32)), pa.array(k1[a + row[one]]), pa.array(k2[a + row[one]])],
                    names=["h", "d", "starts", "n", "off", "k1", "k2"],
                )

    return docs.select("k1", "k2", "t").mapInArrow(cut, "h long, d binary, starts array<int>, n int, off int, k1 long, k2 long")


# --- slabs -----------------------------------------------------------------------

SLAB = "bucket long, h long, d binary, first int, n int, off int, w long, bytes binary"


def _slabs(h, d, first, n, off, w, data: bytes, width: int) -> list[tuple]:
    """Cut a run of starts into slabs of ``width`` offsets from the anchor."""
    out, t = [], 0
    while t < n:
        slab = (off - t) // width
        stop = min(n, off - slab * width + 1)
        core = off - slab * width  # where the slab's shared string begins in ``data``
        key = int.from_bytes(hashlib.blake2b(data[core : core + LENGTH - width + 1], digest_size=8).digest(), "little", signed=True)
        out.append((key, h, d, first + t, stop - t, off - t, w, data[t : stop + LENGTH - 1]))
        t = stop
    return out


def _slab_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
    names = [x.split()[0] for x in SLAB.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _cut_texts(texts: DataFrame) -> DataFrame:
    """Slabs of the classes in ``runs`` (h, d, w, start, n, off) of each text."""

    def cut(batches):
        for batch in batches:
            buf, offsets = text_buffer(batch.column("t"))
            rows = []
            for i, runs in enumerate(batch.column("runs")):
                text = buf[offsets[i] : offsets[i + 1]].tobytes()
                for r in runs.as_py():
                    data = text[r["start"] : r["start"] + r["n"] + LENGTH - 1]
                    rows += _slabs(r["h"], r["d"], 0, r["n"], r["off"], r["w"], data, SLABS[0])
                if len(rows) > 4000:
                    yield _slab_batch(rows)
                    rows = []
            yield _slab_batch(rows)

    return texts.mapInArrow(cut, SLAB)


def _narrow(slabs: DataFrame, width: int) -> DataFrame:
    def cut(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                rows += _slabs(r["h"], r["d"], r["first"], r["n"], r["off"], r["w"], r["bytes"], width)
            yield _slab_batch(rows)

    return slabs.mapInArrow(cut, SLAB)


# --- blockwise suffix sorting ----------------------------------------------------


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks by the keys, the first one first; equal rows have equal ranks."""
    order = np.lexsort(keys[::-1])
    step = np.zeros(len(order), bool)
    for k in keys:
        own = k[order]
        step[1:] |= own[1:] != own[:-1]
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.cumsum(step)
    return ranks


def _sample_ranks(text: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Per position, the rank of a sampled suffix by its first 341 bytes (0: not sampled).
    ``text`` ends in enough zeros for all reads."""
    n = len(text) - LENGTH
    at = np.flatnonzero(np.isin(np.arange(n) % PERIOD, COVER))
    ranks = np.zeros(len(text), np.int64)
    ranks[at] = _dense(word[at], word[at + 8], word[at + 16], word[at + 23]) + 1
    for step in (31, 62, 124, 93):  # 62, 124, 248 and 341 bytes
        _, back = np.unique((ranks[at] << 32) | ranks[at + step], return_inverse=True)
        ranks[at] = back + 1
    return ranks


def string_classes(members: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """``members``: (bucket, starts, weight, bytes).  For all starts in a row: the rank of
    the 400 bytes from there among those of the bucket, and their total weight."""
    sizes = np.array([len(m[3]) for m in members])
    counts = np.array([m[1] for m in members])
    base = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    text = np.frombuffer(b"".join(m[3] for m in members) + bytes(2 * LENGTH), np.uint8)
    word = _words(text, ">u8").astype(np.uint64)
    ranks = _sample_ranks(text, word)
    own = np.repeat(np.arange(len(members)), counts)
    at = np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts) + base[own]
    bucket = np.array([m[0] for m in members], np.int64)[own]
    weight = np.array([m[2] for m in members], np.int64)[own]

    head = _dense(bucket, word[at], word[at + 8], word[at + 16], word[at + 23])
    residue = at % PERIOD
    by_cover = ranks[at + SHIFT[residue, residue]]
    order = np.lexsort((by_cover, head))
    # Among suffixes that tie in head and cover rank, the last bytes decide.
    tied = np.zeros(len(order), bool)
    same = (head[order][1:] == head[order][:-1]) & (by_cover[order][1:] == by_cover[order][:-1])
    tied[1:] |= same
    tied[:-1] |= same
    some = order[tied]
    order[tied] = some[np.lexsort((*[word[at[some] + t] for t in reversed(TAIL)], by_cover[some], head[some]))]
    # Cover ranks of different residues do not compare as they are: sort such heads by pairs.
    ends = np.flatnonzero(np.concatenate((head[order][1:] != head[order][:-1], [True]))) + 1
    begins = np.concatenate(([0], ends[:-1]))
    r = residue[order]
    mixed = np.flatnonzero((np.minimum.reduceat(r, begins) != np.maximum.reduceat(r, begins)) if len(r) else np.zeros(0, bool))

    def compare(x: int, y: int) -> int:
        i, j = int(at[x]), int(at[y])
        d = int(SHIFT[i % PERIOD, j % PERIOD])
        if ranks[i + d] != ranks[j + d]:
            return -1 if ranks[i + d] < ranks[j + d] else 1
        p, q = text[i + TAIL[0] : i + LENGTH].tobytes(), text[j + TAIL[0] : j + LENGTH].tobytes()
        return (p > q) - (p < q)

    for g in mixed.tolist():
        order[begins[g] : ends[g]] = sorted(order[begins[g] : ends[g]].tolist(), key=functools.cmp_to_key(compare))

    i, j = at[order[:-1]], at[order[1:]]
    d = SHIFT[i % PERIOD, j % PERIOD]
    equal = (head[order[:-1]] == head[order[1:]]) & (ranks[i + d] == ranks[j + d])
    for t in TAIL:
        equal &= word[i + t] == word[j + t]
    ranked = np.concatenate(([0], np.cumsum(~equal)))
    classes, totals = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    classes[order], totals[order] = ranked, np.bincount(ranked, weight[order]).astype(np.int64)[ranked]
    return classes, totals


def repeated_starts(members: list[tuple]) -> np.ndarray:
    """For all starts in a row: whether their strings have a total weight of two or more."""
    return string_classes(members)[1] >= 2


def _ranges(names: list[tuple], members: list[tuple], flags: np.ndarray) -> list[tuple]:
    """(h, d, first, n) of the flagged starts."""
    out, p = [], 0
    for (h, d, first), m in zip(names, members, strict=True):
        own = flags[p : p + m[1]]
        p += m[1]
        edges = np.flatnonzero(np.diff(np.concatenate(([0], own.view(np.int8), [0])))).tolist()
        out += [(h, d, first + x, y - x) for x, y in zip(edges[::2], edges[1::2], strict=True)]
    return out


def _blocks_of_buckets(batches):
    """(names, members) of whole buckets, of about ``BLOCK`` bytes or one bucket."""
    members, names, seen, size, last = [], [], set(), 0, None
    for batch in batches:
        for r in zip(*(batch.column(c).to_pylist() for c in ("bucket", "h", "d", "first", "n", "w", "bytes")), strict=True):
            if r[0] != last:
                if size > BLOCK:
                    yield names, members
                    members, names, size = [], [], 0
                last, seen = r[0], set()
            if r[1:4] not in seen:  # repeated rows bring the same class twice
                seen.add(r[1:4])
                members.append((r[0], r[4], r[5], r[6]))
                names.append(r[1:4])
                size += len(r[6])
    if members:
        yield names, members


def _alone(bucket: np.ndarray) -> np.ndarray:
    """Which rows of a batch are seen to be alone in their bucket; not the first and the last."""
    same = bucket[1:] == bucket[:-1]
    out = np.zeros(len(bucket), bool)
    out[1:-1] = ~same[:-1] & ~same[1:]
    return out


def _dealt(slabs: DataFrame) -> DataFrame:
    n = int(slabs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return slabs.drop("off").repartition(n, "bucket").sortWithinPartitions("bucket")


def _sort_buckets(slabs: DataFrame) -> DataFrame:
    """``h, d, first, n``: ranges of repeated starts, from blocks of whole buckets."""

    names = ["h", "d", "first", "n"]

    def search(batches):
        whole = []

        def others():
            for batch in batches:
                alone = _alone(batch.column("bucket").to_numpy())
                whole.append(batch.select(names).filter(pa.array(alone & (batch.column("w").to_numpy() >= 2))))
                yield batch.filter(pa.array(~alone))

        for own, members in _blocks_of_buckets(others()):
            yield from whole
            whole.clear()
            out = _ranges(own, members, repeated_starts(members))
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.binary(), pa.int32(), pa.int32()), strict=True)], names=names)
        yield from whole

    return _dealt(slabs).mapInArrow(search, "h long, d binary, first int, n int")


def _sort_in_parts(slabs: DataFrame, sizes: DataFrame, keep: Scratch) -> DataFrame:
    """The same for buckets that no task should hold, in sub-blocks of about ``LARGEST``
    slabs; ``sizes``: ``bucket, m``, the large buckets."""
    part = F.pmod(F.xxhash64(F.lit(3), "h", "d", "first"), F.ceil(F.col("m") / LARGEST))
    parts = slabs.join(sizes, "bucket").withColumn("bucket", F.xxhash64("bucket", part)).drop("m")

    def stand(batches):
        for names, members in _blocks_of_buckets(batches):
            classes, totals = string_classes(members)
            rows = [(None, h, d, first, 0, n, 0) for h, d, first, n in _ranges(names, members, totals >= 2)]
            _, one = np.unique(classes, return_index=True)
            counts = np.array([m[1] for m in members])
            owner, base = np.repeat(np.arange(len(members)), counts), np.cumsum(counts) - counts
            for i, k in zip(one.tolist(), owner[one].tolist(), strict=True):
                t = i - int(base[k])
                key = hashlib.blake2b(members[k][3][t : t + LENGTH], digest_size=8).digest()
                rows.append((int.from_bytes(key, "little", signed=True), *names[k], t, 0, min(int(totals[i]), 2)))
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["bucket", "h", "d", "first", "t", "n", "w"])

    found = keep.settle(_dealt(parts).mapInArrow(stand, "bucket long, h long, d binary, first int, t int, n int, w long"), "standing")
    # Only strings that stand in several sub-blocks are looked at again, with their bytes.
    standing = found.where("bucket is not null")
    again = standing.join(standing.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1").select("bucket"), "bucket", "left_semi")
    again = again.groupBy("h", "d", "first").agg(F.collect_list(F.struct("bucket", "t", "w")).alias("strings"))

    def cut(batches):
        for batch in batches:
            rows = [(x["bucket"], r["h"], r["d"], r["first"] + x["t"], 1, 0, x["w"], r["bytes"][x["t"] : x["t"] + LENGTH]) for r in batch.to_pylist() for x in r["strings"]]
            yield _slab_batch(rows)

    strings = slabs.select("h", "d", "first", "bytes").join(again, ["h", "d", "first"]).mapInArrow(cut, SLAB)
    return found.where("bucket is null").select("h", "d", "first", "n").unionByName(_sort_buckets(strings))


def _repeats(slabs: DataFrame, keep: Scratch, level: int = 0) -> DataFrame:
    large = keep.settle(slabs.groupBy("bucket").agg(F.count("*").alias("m")).where(F.col("m") > LARGEST), f"large-{level}")
    keep.sweep()  # the texts' shuffle goes once a later job has run
    if large.isEmpty():
        return _sort_buckets(slabs)
    small = _sort_buckets(slabs.join(large, "bucket", "left_anti"))
    hot = slabs.join(large, "bucket", "left_semi")
    if level + 1 == len(SLABS):
        return small.unionByName(_sort_in_parts(hot, large, keep))
    narrow = keep.settle(_narrow(hot, SLABS[level + 1]), f"slabs-{level + 1}")
    return small.unionByName(_repeats(narrow, keep, level + 1))


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (the remaining bytes) per row."""
    keep = Scratch(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("t"))
    # A row is known by its id and its text's hash; rows alike in both are alike in all.
    rows = rows.select("doc_id", "t", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k1"), F.xxhash64("t").alias("k2"))
    occurrences = keep.settle(_occurrences(rows), "runs")
    anchors = keep.settle(occurrences.groupBy("h").agg(F.sum(F.size("starts")).alias("m"), F.count("*").alias("runs")).where("m > 1"), "anchors")
    live = keep.settle(join_hot(occurrences, anchors.select("h"), ["h"], hot_keys(anchors, ["h"], "runs", LEAST_HOT)), "live")
    keep.drop("runs", "anchors")
    keep.sweep()
    classes = live.groupBy("h", "d").agg(F.sum(F.size("starts")).alias("w"), F.count("*").alias("runs"), F.min(F.struct("k1", "k2", F.col("starts")[0].alias("start"), "n", "off")).alias("at"))
    classes = keep.settle(classes, "classes")
    keep.sweep()
    wanted = classes.groupBy(F.col("at.k1").alias("k1"), F.col("at.k2").alias("k2")).agg(
        F.collect_list(F.struct("h", "d", "w", F.col("at.start").alias("start"), F.col("at.n").alias("n"), F.col("at.off").alias("off"))).alias("runs")
    )
    slabs = keep.settle(_cut_texts(rows.select("k1", "k2", "t").join(wanted, ["k1", "k2"]).select("t", "runs")), "slabs")
    keep.sweep()
    repeats = _repeats(slabs, keep).groupBy("h", "d").agg(F.collect_set(F.struct("first", "n")).alias("ranges"))
    repeats = keep.settle(repeats, "repeats")
    keep.drop("slabs")
    hot = hot_keys(classes, ["h", "d"], "runs", LEAST_HOT)
    marked = join_hot(live.select("h", "d", "starts", "k1", "k2"), repeats, ["h", "d"], hot)
    marks = marked.select("k1", "k2", F.explode("starts").alias("start"), "ranges").select("k1", "k2", "start", F.explode("ranges").alias("r"))
    marks = marks.select("k1", "k2", (F.col("start") + F.col("r.first")).alias("x"), F.col("r.n").alias("m"))
    marks = keep.settle(marks.distinct().groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("x", "m"))).alias("marks")), "marks")
    keep.drop("live", "classes", "repeats")
    keep.sweep()

    def cut(batches):
        for batch in batches:
            buf, offsets = text_buffer(batch.column("t"))
            removed, spans, kept = [], [], []
            for i, marks in enumerate(batch.column("marks").to_pylist()):
                text = buf[offsets[i] : offsets[i + 1]]
                if not marks:
                    removed.append(0)
                    spans.append(0)
                    kept.append(text.tobytes())
                    continue
                begin = np.array([m["x"] for m in marks])
                change = np.zeros(len(text) + 1, np.int32)
                np.add.at(change, begin, 1)
                np.add.at(change, begin + np.array([m["m"] for m in marks]) + LENGTH - 1, -1)
                gone = np.cumsum(change[:-1]) > 0
                removed.append(int(gone.sum()))
                spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                kept.append(text[~gone].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    joined = rows.join(marks, ["k1", "k2"], "left").select("doc_id", "t", "marks")
    return joined.mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def report(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
