"""Benchmark decontamination.

The benchmark's words become small integers, its windows (runs of ``n`` words; a
shorter item is one window) become a hash set of integer n-grams that is broadcast.
Documents are scanned block-wise: words are looked up in the vocabulary, windows of
known words are hashed, candidates are verified word by word, and hit words marked.

The set is broadcast only while its measured size is at most ``max_broadcast_bytes``.  A
larger benchmark streams through the driver and is cut into parts of at most that size; the
documents are scanned once a part, each part is taken from the executors before the next is
sent, and the parts' hits are joined to the documents by a 128-bit hash of the text.  No
task ever holds more than one part, and no part of the benchmark is dropped.

Defined results: a null or empty text has no words and is clean; whole texts are scanned,
however long; a null or wordless item has no windows; an item without an id hits words but is
not listed; items that share a window are each listed, in the order of their ids as strings;
repeated rows are each reported; an empty benchmark hits nothing; columns other than the ids
and texts are not read, and those of ``clean`` pass through under any name; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BY_ALNUM, LOWER, blocks, mix, settle, text_buffer, word_spans

WINDOW = 10
MAX_BROADCAST_BYTES = 64 << 20
#: Columns of the hits of a benchmark in parts.
RANGES, ITEMS = "__leak_ranges", "__leak_items"


def item_words(text: str | None) -> list[bytes]:
    if not text:
        return []
    data = LOWER[np.frombuffer(text.encode(), np.uint8)]
    starts, ends, _ = word_spans(data, np.array([0, len(data)]), BY_ALNUM)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def _gram_hash(ids: np.ndarray, n: int) -> np.ndarray:
    size = len(ids) - n + 1
    h = np.zeros(size, np.uint64)
    for i in range(n):
        h = h * np.uint64(0x9FB21C651E98DF25) + ids[i : i + size].astype(np.uint64)
    return mix(h)


class WindowIndex:
    """Windows by length: sorted hashes, the words as vocabulary numbers, the items."""

    def __init__(self, items: list[tuple], n: int):
        self.vocabulary: dict[bytes, int] = {}
        grams: dict[int, dict[tuple, list]] = {}
        for item, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            k = min(n, len(ids))
            for i in range(len(ids) - k + 1 if k else 0):
                own = grams.setdefault(k, {}).setdefault(tuple(ids[i : i + k]), [])
                if not own or own[-1] != item:
                    own.append(item)
        self.lengths = {}
        for k, found in grams.items():
            words = np.array(list(found), np.int64).reshape(-1, k)
            hashes = np.concatenate([_gram_hash(row, k) for row in words]) if len(words) else np.zeros(0, np.uint64)
            order = np.argsort(hashes, kind="stable")
            owners = list(found.values())
            self.lengths[k] = (hashes[order], words[order], [owners[i] for i in order])

    def scan(self, ids: np.ndarray) -> tuple[np.ndarray, set]:
        """(hit mask of the words, items with a window that occurs)."""
        hit, items = np.zeros(len(ids), bool), set()
        known = ids > 0
        if not known.any():
            return hit, items
        run = np.concatenate(([0], np.cumsum(known)))
        for k, (hashes, words, owners) in self.lengths.items():
            if len(ids) < k:
                continue
            at = np.flatnonzero(run[k:] - run[:-k] == k)
            if not len(at):
                continue
            h = _gram_hash(ids, k)[at]
            low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            for p, a, b in zip(at[low < high].tolist(), low[low < high].tolist(), high[low < high].tolist(), strict=True):
                for w in range(a, b):
                    if (words[w] == ids[p : p + k]).all():
                        hit[p : p + k] = True
                        items.update(owners[w])
        return hit, items


def _parts(items: list[tuple], n: int, most: int) -> Iterator[WindowIndex]:
    """Indexes over consecutive items, each of at most ``most`` bytes by a safe estimate."""
    part, size = [], 0
    for item, words in items:
        cost = sum(len(w) + 100 for w in words) + max(1, len(words) - n + 1) * (n * 8 + 200)
        if part and size + cost > most:
            yield WindowIndex(part, n)
            part, size = [], 0
        part.append((item, words))
        size += cost
    yield WindowIndex(part, n)


def _masks(batch: pa.RecordBatch, text: str, index: WindowIndex | None):
    """Blocks of a batch as (first row, text bytes, offsets, word starts, ends, first words,
    hit masks and items per row); without an index the hits come from its columns."""
    buf, offsets = text_buffer(batch.column(text))
    for a, b in blocks(offsets):
        part = LOWER[buf[offsets[a] : offsets[b]]]
        local = offsets[a : b + 1] - offsets[a]
        starts, ends, first = word_spans(part, local, BY_ALNUM)
        found = []
        if index is None:
            for i, (ranges, items) in enumerate(zip(batch.column(RANGES)[a:b].to_pylist(), batch.column(ITEMS)[a:b].to_pylist(), strict=True)):
                hit = np.zeros(first[i + 1] - first[i], bool)
                for r in ranges or []:
                    hit[r["x"] : r["y"]] = True
                found.append((hit, set(items or [])))
        else:
            raw = part.tobytes()
            get = index.vocabulary.get
            ids = np.fromiter((get(raw[x:y], 0) for x, y in zip(starts.tolist(), ends.tolist(), strict=True)), np.int64, len(starts))
            found = [index.scan(ids[first[i] : first[i + 1]]) for i in range(b - a)]
        yield a, buf[offsets[a] : offsets[b]].tobytes(), local, starts, ends, first, found


def _runs(mask: np.ndarray) -> tuple[list[int], list[int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0])))).tolist()
    return edges[::2], edges[1::2]


def _with_hits(docs: DataFrame, text: str, benchmark: DataFrame, item_col: str, item_text_col: str, window: int, most: int):
    """(docs, the broadcast index) or, for a benchmark of several parts, (docs with the
    columns of their hits, None)."""
    spark = docs.sparkSession
    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(item_text_col).alias("t")).toLocalIterator()
    parts = _parts(((r.i, item_words(r.t)) for r in rows), window, most)
    one, more = next(parts), next(parts, None)
    if more is None:
        return docs, spark.sparkContext.broadcast(one)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    keys = F.xxhash64(body).alias("k1"), F.xxhash64(F.lit(1), body).alias("k2")
    texts = docs.select(*keys, body.alias("t"))
    hits = None
    for index in chain((one, more), parts):
        share = spark.sparkContext.broadcast(index)

        def scan(batches, share=share):
            for batch in batches:
                at, ranges, items = [], [], []
                for a, _, _, _, _, _, found in _masks(batch, "t", share.value):
                    for i, (hit, own) in enumerate(found):
                        if hit.any():
                            at.append(a + i)
                            ranges.append([{"x": x, "y": y} for x, y in zip(*_runs(hit), strict=True)])
                            items.append(sorted(x for x in own if x is not None))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("k1").take(pa.array(at, pa.int64())), batch.column("k2").take(pa.array(at, pa.int64())), pa.array(ranges, pa.list_(pa.struct([("x", pa.int64()), ("y", pa.int64())]))), pa.array(items, pa.list_(pa.string()))],
                    names=["k1", "k2", "ranges", "items"],
                )

        own = settle(texts.mapInArrow(scan, "k1 long, k2 long, ranges array<struct<x:long,y:long>>, items array<string>"), "leak-part")
        hits = own if hits is None else hits.unionAll(own)
        share.destroy()
    hits = hits.groupBy("k1", "k2").agg(F.array_distinct(F.flatten(F.collect_set("ranges"))).alias(RANGES), F.array_distinct(F.flatten(F.collect_set("items"))).alias(ITEMS))
    hits = settle(hits, "leaks").withColumnsRenamed({"k1": "__k1", "k2": "__k2"})
    joined = docs.withColumns({"__k1": keys[0], "__k2": keys[1]}).join(hits, ["__k1", "__k2"], "left")
    return joined.select(*docs.columns, RANGES, ITEMS), None


def scan_documents(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, hit_spans, items`` where hit_spans are
    [start, end) character ranges of maximal runs of hit words in the whole text and
    items the sorted ids (as strings) of the items with occurring windows."""
    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    rows, share = _with_hits(kept, "t", benchmark, item_col, item_text_col, window, max_broadcast_bytes)

    def scan(batches):
        for batch in batches:
            n_words, n_hit, spans, items = [], [], [], []
            for _, raw, local, starts, ends, first, found in _masks(batch, "t", share.value if share else None):
                for i, (hit, own) in enumerate(found):
                    n_words.append(len(hit))
                    n_hit.append(int(hit.sum()))
                    items.append(sorted(x for x in own if x is not None))
                    out = []
                    text = raw[local[i] : local[i + 1]] if n_hit[-1] else b""
                    for x, y in zip(*_runs(hit), strict=True):
                        s, e = starts[first[i] + x] - local[i], ends[first[i] + y - 1] - local[i]
                        c = len(text[:s].decode())
                        out.append({"start": c, "end": c + len(text[s:e].decode())})
                    spans.append(out)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array(items, pa.list_(pa.string()))],
                names=["doc_id", "n_words", "n_hit", "hit_spans", "items"],
            )

    kind = kept.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"doc_id {kind}, n_words long, n_hit long, hit_spans array<struct<start:long,end:long>>, items array<string>")


def digest_columns(found: DataFrame) -> DataFrame:
    """The per-document report of a scan."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, action: str = "drop", max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """The documents' own columns without contaminated rows (``drop``), or with hit
    spans cut out of the text, and ``n_chars`` to match (``cut``).  While the benchmark is one
    part, one scan of ``docs`` does this and moves no text between executors."""
    rows, share = _with_hits(docs, "text", benchmark, "item_id", "text", window, max_broadcast_bytes)
    names = docs.columns

    def scan(batches):
        for batch in batches:
            keep, texts = [], []
            for _, raw, local, starts, ends, first, found in _masks(batch, "text", share.value if share else None):
                for i, (hit, _) in enumerate(found):
                    keep.append(action == "cut" or not hit.any())
                    if action == "cut":
                        data = raw[local[i] : local[i + 1]]
                        out, at = [], 0
                        for x, y in zip(*_runs(hit), strict=True):
                            out.append(data[at : starts[first[i] + x] - local[i]])
                            at = int(ends[first[i] + y - 1] - local[i])
                        texts.append(b"".join([*out, data[at:]]).decode())
            batch = batch.select(names)
            if action == "cut":
                valid = batch.column("text").is_valid().to_pylist()
                fresh = pa.array([t if ok else None for t, ok in zip(texts, valid, strict=True)], batch.schema.field("text").type)
                batch = batch.set_column(names.index("text"), batch.schema.field("text"), fresh)
                if "n_chars" in names:
                    field = batch.schema.field("n_chars")
                    sizes = [None if t is None else len(t) for t in fresh.to_pylist()]
                    batch = batch.set_column(names.index("n_chars"), field, pa.array(sizes, field.type))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(scan, docs.schema)
