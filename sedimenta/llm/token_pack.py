"""Token-id files with fixed-width bit packing.

Format (little-endian): magic ``SDTK``, u8 version, u8 bits, u16 zero, u32 ids a block,
u32 reserved; then blocks, each ``ceil(count * bits / 8)`` bytes with id k in bits
[k*bits, (k+1)*bits) counted from the least significant bit; then the block offsets as
u64, one more than there are blocks; then a footer: u64 ids, u64 place of the offsets,
magic.  A block can be unpacked on its own, so any id range is read without the rest.

Documents are range-partitioned by ``doc_id`` (nulls first; repeated ids by their text's
hash), each partition writes one file, and the partitions' sizes give every file's place.

Defined results: a null or empty text is the end id alone; repeated rows are encoded
each; an empty table has no files and no rows.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, shared_dir, text_buffer
from .files import new_file, read_file
from .tokens import default_vocabulary, encoder

MAGIC = b"SDTK"
BLOCK_IDS = 1 << 16
END_ID = 1
HEADER = struct.Struct("<4sBBHII")
FOOTER = struct.Struct("<QQ4s")


def bits_for(vocabulary_size: int) -> int:
    return max(1, int(vocabulary_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each; whole bytes are copied, other widths go bit by bit."""
    ids = np.ascontiguousarray(ids, "<u4")
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id does not fit {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    wide = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(wide.reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, count: int, bits: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype(np.uint32)
    wide = np.zeros((count, 32), np.uint8)
    wide[:, :bits] = np.unpackbits(raw, count=count * bits, bitorder="little").reshape(count, bits)
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").reshape(-1).astype(np.uint32)


class PackedWriter:
    def __init__(self, stream, bits: int, block_ids: int = BLOCK_IDS):
        self.stream, self.bits, self.block_ids = stream, bits, block_ids
        self.rest: list[np.ndarray] = []
        self.waiting = self.total = 0
        self.at = HEADER.size
        self.offsets = [self.at]
        stream.write(HEADER.pack(MAGIC, 1, bits, 0, block_ids, 0))

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.stream.write(data)
        self.at += len(data)
        self.offsets.append(self.at)

    def write(self, ids: np.ndarray) -> None:
        self.rest.append(ids)
        self.waiting += len(ids)
        self.total += len(ids)
        if self.waiting >= self.block_ids:
            flat = np.concatenate(self.rest)
            whole = len(flat) // self.block_ids * self.block_ids
            for i in range(0, whole, self.block_ids):
                self._block(flat[i : i + self.block_ids])
            self.rest, self.waiting = [flat[whole:]], len(flat) - whole

    def close(self) -> None:
        if self.waiting:
            self._block(np.concatenate(self.rest))
        self.stream.write(np.array(self.offsets, "<u8").tobytes())
        self.stream.write(FOOTER.pack(self.total, self.at, MAGIC))
        self.stream.close()


class PackedReader:
    def __init__(self, source):
        self.source = source
        size = source.size()
        magic, version, self.bits, _, self.block_ids, _ = HEADER.unpack(source.read_at(HEADER.size, 0))
        self.total, place, tail = FOOTER.unpack(source.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC or tail != MAGIC or version != 1:
            raise ValueError("not a packed token file")
        count = -(-self.total // self.block_ids) + 1
        self.offsets = np.frombuffer(source.read_at(8 * count, place), "<u8").astype(np.int64)

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids [start, stop), from the blocks that hold them alone."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        a, b = start // self.block_ids, (stop - 1) // self.block_ids
        data = self.source.read_at(int(self.offsets[b + 1] - self.offsets[a]), int(self.offsets[a]))
        out = []
        for i in range(a, b + 1):
            count = min(self.block_ids, self.total - i * self.block_ids)
            lo, hi = int(self.offsets[i] - self.offsets[a]), int(self.offsets[i + 1] - self.offsets[a])
            out.append(unpack(data[lo:hi], count, self.bits))
        return np.concatenate(out)[start - a * self.block_ids : stop - a * self.block_ids]


def write_packed(
    docs: DataFrame, *, vocabulary: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, str]:
    """Write the documents' ids; returns (manifest, folder).  The manifest has a row per
    document: ``doc_id, part, file, place (of its first id in the file), n``."""
    path = vocabulary or default_vocabulary()
    folder = shared_dir(docs.sparkSession, "tokens")

    def write(batches):
        from pyspark import TaskContext

        code = encoder(path)
        part = TaskContext.get().partitionId()
        writer = name = None
        for batch in batches:
            if writer is None and batch.num_rows:
                stream, name = new_file(folder, f"part-{part:06d}", ".sdtk")
                writer = PackedWriter(stream, bits_for(code.vocabulary_size))
            for a in range(0, batch.num_rows, 512):
                own = batch.slice(a, 512)
                buf, offsets = text_buffer(own.column("t"))
                data = buf.tobytes()
                cuts = offsets.tolist()
                ids, bounds = code.encode([data[x:y] for x, y in zip(cuts, cuts[1:], strict=False)], end_id)
                place = writer.total
                writer.write(ids)
                n = own.num_rows
                yield pa.RecordBatch.from_arrays(
                    [own.column("doc_id"), pa.array([part] * n, pa.int32()), pa.array([name] * n), pa.array(bounds[:-1] + place), pa.array(np.diff(bounds))],
                    names=["doc_id", "part", "file", "place", "n"],
                )
        if writer is not None:
            writer.close()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    ordered = rows.repartitionByRange(_parts(docs), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), F.xxhash64("t")
    )
    return settle(ordered.mapInArrow(write, f"doc_id {kind}, part int, file string, place long, n long"), "token-manifest"), folder


def _parts(docs: DataFrame) -> int:
    return int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def located(manifest: DataFrame) -> DataFrame:
    """The manifest with ``base``: the number of ids in all parts before a row's part.
    One row a part goes through the running sum, never one a document."""
    sizes = manifest.groupBy("part").agg(F.sum("n").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(F.col("part").alias("p"), F.coalesce(F.sum("ids").over(before), F.lit(0)).cast("long").alias("base"))
    return manifest.join(bases, manifest.part == bases.p).drop("p")


def read_digests(manifest: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32``, from the files alone once the manifest
    has said where each document lies."""

    def read(batches):
        readers: dict[str, PackedReader] = {}
        for batch in batches:
            files = batch.column("file").to_pylist()
            place, n = batch.column("place").to_numpy(), batch.column("n").to_numpy()
            crc = np.zeros(batch.num_rows, np.int64)
            a = 0
            while a < batch.num_rows:
                b = a  # consecutive rows of a file, up to a few blocks, in one read
                while b < batch.num_rows and files[b] == files[a] and (b == a or (place[b] == place[b - 1] + n[b - 1] and place[b] + n[b] - place[a] <= 4 * BLOCK_IDS)):
                    b += 1
                if files[a] not in readers:
                    readers.clear()
                    readers[files[a]] = PackedReader(read_file(folder, files[a]))
                data = memoryview(readers[files[a]].read(int(place[a]), int(place[b - 1] + n[b - 1])).astype("<u4").tobytes())
                for i in range(a, b):
                    x = int(place[i] - place[a]) * 4
                    crc[i] = zlib.crc32(data[x : x + int(n[i]) * 4])
                a = b
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(batch.column("base").to_numpy() + place), pa.array(n), pa.array(crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"]
            )

    rows = located(manifest)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(read, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def token_report(docs: DataFrame, **options) -> DataFrame:
    manifest, folder = write_packed(docs, **options)
    return read_digests(manifest, folder)
