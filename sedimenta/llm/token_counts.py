"""Token counts of flat token files that have no index.

A flat file is nothing but ids of a fixed width, each document followed by the
end-of-document id.  Fixed-size blocks of the files are scanned independently for that
id with vectorised comparisons; a block reports its separators and the ids after its
last one, and a prefix scan over the blocks' summaries (one row a block) carries the
open document across block bounds.

Defined results: a null or empty text is a document of 0 tokens; a file that does not
end in a separator has one more, unfinished document, reported with ``closed`` false;
an empty file has no documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, shared_dir, text_buffer
from .files import new_file, opened, read_file
from .tokens import default_vocabulary, encoder

END_NAME = "<|endoftext|>"
BLOCK_BYTES = 4 << 20


def write_flat(docs: DataFrame, *, vocabulary: str | None = None, end_name: str = END_NAME) -> tuple[DataFrame, str, int, int]:
    """Write flat files in the order of the scan: (rows ``doc_id, file, ordinal``, folder,
    bytes an id, end id).  An end id inside a text (its name spelled out) is split off
    by encoding such texts with special names as ordinary text."""
    path = vocabulary or default_vocabulary()
    code = encoder(path)
    end, width = code.tokenizer.token_to_id(end_name), 2 if code.vocabulary_size <= 1 << 16 else 4
    folder = shared_dir(docs.sparkSession, "flat-tokens")

    def write(batches):
        own = encoder(path)
        own.tokenizer.encode_special_tokens = True
        own._forget()
        stream = name = None
        count = 0
        try:
            for batch in batches:
                if stream is None and batch.num_rows:
                    stream, name = new_file(folder, "flat", ".ids")
                for a in range(0, batch.num_rows, 512):
                    rows = batch.slice(a, 512)
                    buf, offsets = text_buffer(rows.column("t"))
                    data, cuts = buf.tobytes(), offsets.tolist()
                    ids, _ = own.encode([data[x:y] for x, y in zip(cuts, cuts[1:], strict=False)], end)
                    stream.write(ids.astype(f"<u{width}").tobytes())
                    n = rows.num_rows
                    yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([name] * n), pa.array(np.arange(count, count + n))], names=["doc_id", "file", "ordinal"])
                    count += n
        finally:
            own.tokenizer.encode_special_tokens = False
            own._forget()
            if stream is not None:
                stream.close()

    rows = docs.select("doc_id", F.col("text").cast("string").alias("t"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return settle(rows.mapInArrow(write, f"doc_id {kind}, file string, ordinal long"), "flat-manifest"), folder, width, end


def count_flat(files: DataFrame, folder: str, width: int, end: int, *, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``file, ordinal, start, n_tokens, closed`` per document of the flat files named in
    ``files.file``: ids before it in its file, and its ids without the separator."""
    block = max(width, block_bytes // width * width)

    def cut(batches):
        for batch in batches:
            system, path = opened(folder)
            for name in batch.column("file").to_pylist():
                size = system.get_file_info(f"{path}/{name}").size
                at = np.arange(0, size, block)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(np.minimum(block, size - at))], names=["file", "at", "size"])

    def scan(batches):
        for batch in batches:
            for name, at, size in zip(*(batch.column(c).to_pylist() for c in ("file", "at", "size")), strict=True):
                with read_file(folder, name) as source:
                    ids = np.frombuffer(source.read_at(size, at), f"<u{width}")
                found = np.flatnonzero(ids == end).astype(np.int64)
                last = int(found[-1]) + 1 if len(found) else 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([at]), pa.array([len(found)], pa.int64()), pa.array([len(ids) - last], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([found], pa.list_(pa.int64()))],
                    names=["file", "at", "seps", "tail", "ids", "found"],
                )

    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = files.select("file").distinct().mapInArrow(cut, "file string, at long, size long").repartition(n, "file", "at")
    scanned = settle(cuts.mapInArrow(scan, "file string, at long, seps long, tail long, ids long, found array<long>"), "flat-scan")

    order = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    summary = scanned.select(
        "file", "at", "seps",
        F.coalesce(F.sum("seps").over(order), F.lit(0)).alias("before"),
        F.coalesce(F.sum("ids").over(order), F.lit(0)).alias("offset"),
        F.max(F.when(F.col("seps") > 0, F.col("at"))).over(order).alias("anchor"),
        F.max("at").over(whole).alias("final"), "tail", "ids",
    )
    # The place after the last separator before the block.
    anchors = summary.select(F.col("file").alias("f"), F.col("at").alias("a"), (F.col("offset") + F.col("ids") - F.col("tail")).alias("carry"))
    carried = summary.join(anchors, (summary.file == anchors.f) & (summary.anchor == anchors.a), "left").select(
        "file", "at", "before", "offset", F.coalesce("carry", F.lit(0)).alias("carry"), "tail", "ids", "seps", (F.col("at") == F.col("final")).alias("ends")
    )
    joined = scanned.select("file", "at", "found").join(carried, ["file", "at"])
    rows = joined.select("file", "before", "offset", "carry", "found", F.posexplode("found").alias("k", "sep"))
    rows = rows.select(
        "file", (F.col("before") + F.col("k")).alias("ordinal"),
        F.when(F.col("k") == 0, F.col("carry")).otherwise(F.col("offset") + F.element_at("found", F.col("k")) + 1).alias("start"),
        (F.col("offset") + F.col("sep")).alias("stop"), F.lit(True).alias("closed"),
    )
    open_start = F.when(F.col("seps") > 0, F.col("offset") + F.col("ids") - F.col("tail")).otherwise(F.col("carry"))
    tails = carried.where("ends").select(
        "file", (F.col("before") + F.col("seps")).alias("ordinal"), open_start.alias("start"), (F.col("offset") + F.col("ids")).alias("stop"), F.lit(False).alias("closed")
    ).where("stop > start")
    return rows.unionByName(tails).select("file", "ordinal", "start", (F.col("stop") - F.col("start")).alias("n_tokens"), "closed")


def count_documents(docs: DataFrame, *, vocabulary: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, n_tokens, file_start`` of every document, counted from its flat file."""
    manifest, folder, width, end = write_flat(docs, vocabulary=vocabulary)
    counts = count_flat(manifest, folder, width, end, block_bytes=block_bytes)
    return manifest.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens", F.col("start").alias("file_start"))
