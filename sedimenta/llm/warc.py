"""WARC archives with a globally ordered capture index.

Writing.  Payload digests decide, per digest, which page is the response: the one of the
largest ``page_id``; the others of at least ``least_revisit`` bytes become revisits.  Each
task writes one archive of gzip members, a record each, and one run of its index, sorted
by (URL key, timestamp, page id).

Merging.  While there are more than ``FAN_IN`` runs, tasks merge ``FAN_IN`` of them each to
one longer run.  Samples of the last runs' keys cut the key space into ranges.  A task merges
one range of all these runs with a loser tree, reading every run a block at a time from its
first key of the range, so memory and opened files are bounded; a URL with very many
captures is cut between captures.  Ranges in order are the global capture histories.

Reading.  Entries of the merged index are followed to their records, which are parsed and
whose payloads are checked against their digests.

Defined results: a null html is an empty payload; a null url has the empty key; a null
page id sorts first and is kept; repeated rows are captures of their own, and of equal
payloads and page ids one row is the response; captures that tie in key and time are in the
order of their page ids; payloads are kept whole, however long; columns other than page_id,
url and html are not read; an empty table writes no archives.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import json
import re
import struct
import zlib
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hot_keys, join_hot, settle, shared_dir
from .files import new_file, read_file

EPOCH = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
RUN_BLOCK = 256
SAMPLES = 16
#: Runs that one task merges at a time; more are merged in rounds.
FAN_IN = 64
#: Pages from which a payload may be hot.
LEAST_HOT = 500


def url_key(url: str | None) -> str:
    """Host labels reversed, then the path, as capture indexes sort URLs."""
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^#]*)", url or "")
    if not m:
        return url or ""
    host = m[1].rpartition("@")[2].lower()
    host = re.sub(r"^www\d*\.", "", host.partition(":")[0])
    return ",".join(reversed(host.split("."))) + ")" + (m[2].lower() or "/")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page: int | None, url: str, when: str, payload: bytes, refers_to: int | None, refers_url: str) -> bytes:
    """One WARC/1.1 record; a revisit keeps its payload's length and digest, not the payload."""
    identity = lambda p: f"<urn:page:{'' if p is None else p}>"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {identity(page)}", f"WARC-Date: {when}", f"WARC-Target-URI: {_one_line(url)}", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", f"WARC-Payload-Length: {len(payload)}"]
    body = payload
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {identity(refers_to)}", f"WARC-Refers-To-Target-URI: {_one_line(refers_url)}"]
        body = b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _one_line(url: str) -> str:
    return re.sub(r"[\r\n]+", " ", url)


def parse(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    size = int(fields["Content-Length"])
    payload = rest[:size]
    revisit = fields["WARC-Type"] == "revisit"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and (payload_digest(payload) != digest or len(payload) != int(fields["WARC-Payload-Length"])):
        raise ValueError("a payload does not match its digest")
    page = lambda x: int(p) if (p := x[len("<urn:page:") : -1]) else None
    return {"page_id": page(fields["WARC-Record-ID"]), "payload_bytes": int(fields["WARC-Payload-Length"]), "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": page(fields["WARC-Refers-To"]) if revisit else None, "payload": payload}


# --- sorted runs -------------------------------------------------------------
# A run is blocks of RUN_BLOCK JSON lines, each block deflated, then a JSON directory
# [[place, size, first key], ...] and its length as u32.


def write_run(stream, entries: list[list]) -> list[list]:
    """Write sorted entries ``[key, time, page, file, offset, size]``; returns sampled keys."""
    entries.sort(key=_key)
    return write_sorted(stream, iter(entries))


def write_sorted(stream, entries) -> list[list]:
    """The same for an iterator of entries in order, a block in memory at a time."""
    directory, at = [], 0
    while block := list(islice(entries, RUN_BLOCK)):
        data = zlib.compress("\n".join(json.dumps(e) for e in block).encode(), 1)
        directory.append([at, len(data), block[0][:3]])
        stream.write(data)
        at, last = at + len(data), block
    tail = json.dumps(directory).encode()
    stream.write(tail + struct.pack("<I", len(tail)))
    if len(directory) < SAMPLES:
        firsts = [d[2] for d in directory] + ([e[:3] for e in last[1:: max(1, RUN_BLOCK // SAMPLES)]] if directory else [])
        return firsts[: 2 * SAMPLES]
    return [directory[i][2] for i in np.unique(np.linspace(0, len(directory) - 1, SAMPLES).astype(int)).tolist()]


def _key(e) -> tuple:
    return (e[0], e[1], -1 if e[2] is None else e[2])


def read_run(folder: str, name: str, low: tuple | None, high: tuple | None):
    """Entries with low <= key < high in order, a block in memory at a time."""
    with read_file(folder, name) as source:
        size = source.size()
        (length,) = struct.unpack("<I", source.read_at(4, size - 4))
        directory = json.loads(source.read_at(length, size - 4 - length))
        first = 0
        if low is not None:
            firsts = [_key(d[2]) for d in directory]
            while first + 1 < len(firsts) and firsts[first + 1] < low:
                first += 1
        for at, count, _ in directory[first:]:
            for line in zlib.decompress(source.read_at(count, at)).decode().split("\n"):
                entry = json.loads(line)
                k = _key(entry)
                if high is not None and k >= high:
                    return
                if low is None or k >= low:
                    yield k, entry


def merge(runs: list):
    """K-way merge of sorted iterators of (key, entry) by a loser tree: inner nodes keep
    the loser of their match, and the winner's path alone is replayed."""
    heads = [next(r, None) for r in runs]
    k = len(heads)
    if not k:
        return
    wins = lambda a, b: heads[b] is None or (heads[a] is not None and (heads[a][0], a) < (heads[b][0], b))
    losers, winners = [0] * k, [0] * k + list(range(k))  # leaf i is node k + i
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if wins(a, b) else (b, a)
    winner = winners[1] if k > 1 else 0
    while heads[winner] is not None:
        yield heads[winner][1]
        heads[winner] = next(runs[winner], None)
        node = (k + winner) // 2
        while node:
            if wins(losers[node], winner):
                losers[node], winner = winner, losers[node]
            node //= 2


# --- operator -------------------------------------------------------------------


def write_archives(pages: DataFrame, *, least_revisit: int = 0) -> tuple[DataFrame, str]:
    """Write archives and runs for ``pages(page_id, url, html)``: (manifest with a row an
    archive ``archive, run, samples``, folder)."""
    spark = pages.sparkSession
    folder = shared_dir(spark, "warc")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1("html"))
    best = rows.groupBy("sha").agg(F.count("*").alias("n"), F.max(F.struct("page_id", "url")).alias("best")).where("n > 1")
    best = settle(best.select(F.col("sha").alias("s"), F.col("best.page_id").alias("keeper"), F.col("best.url").alias("keeper_url"), "n"), "warc-keepers")
    # Pages of a payload that very many share, such as the empty one, stay where they are.
    hot = hot_keys(best, ["s"], "n", LEAST_HOT)
    dealt = join_hot(rows.withColumnRenamed("sha", "s"), best, ["s"], hot, "left").select("page_id", "url", "html", "keeper", "keeper_url", F.when(F.col("n").isNotNull(), F.col("s")).alias("s"))
    # of rows with the keeper's id and payload one is the response
    twins = dealt.where(F.col("page_id").eqNullSafe(F.col("keeper")) & F.col("s").isNotNull()).select("s").groupBy("s").count().where("count > 1").select(F.col("s").alias("twin"))

    def write(batches):
        archive = run = None
        entries, at = [], 0
        for batch in batches:
            for page, url, html, keeper, keeper_url, grouped, extra in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "keeper", "keeper_url", "s", "extra")), strict=True):
                if archive is None:
                    archive, name = new_file(folder, "pages", ".warc.gz")
                payload = html.encode()
                revisit = grouped is not None and (page != keeper or extra) and len(payload) >= least_revisit
                when = (EPOCH + datetime.timedelta(seconds=page or 0)).strftime("%Y-%m-%dT%H:%M:%SZ") if abs(page or 0) < 1 << 36 else EPOCH.strftime("%Y-%m-%dT%H:%M:%SZ")
                packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                data = packer.compress(record("revisit" if revisit else "response", page, url, when, payload, keeper, keeper_url or "")) + packer.flush()
                archive.write(data)
                entries.append([url_key(url), when, page, name, at, len(data)])
                at += len(data)
        if archive is not None:
            archive.close()
            run, run_name = new_file(folder, "run", ".cdx")
            samples = write_run(run, entries)
            run.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([run_name]), pa.array([[json.dumps(s) for s in samples]])], names=["archive", "run", "samples"])

    if twins.isEmpty():
        dealt = dealt.withColumn("extra", F.lit(False))
    else:
        order = Window.partitionBy("s", "page_id").orderBy("url")
        twin = dealt.join(twins, dealt.s == twins.twin, "left")
        ranked = twin.where("twin is not null").withColumn("extra", F.row_number().over(order) > 1)
        dealt = twin.where("twin is null").withColumn("extra", F.lit(False)).unionByName(ranked).drop("twin")
    return settle(dealt.repartition(n).mapInArrow(write, "archive string, run string, samples array<string>"), "warc-manifest"), folder


def ranges(manifest: DataFrame, parts: int) -> list[tuple]:
    """(low, high) keys of ``parts`` ranges of about equal size, from a bounded sample of
    every run."""
    keys = sorted({_key(json.loads(s)) for r in manifest.select("samples").toLocalIterator() for s in r.samples})
    cuts = sorted({keys[len(keys) * i // parts] for i in range(1, parts)}) if keys else []
    return list(zip([None, *cuts], [*cuts, None], strict=True))


def merge_rounds(manifest: DataFrame, folder: str, fan_in: int) -> DataFrame:
    """``run, samples`` of at most ``fan_in`` runs that hold what those of the manifest hold:
    in each round a task merges ``fan_in`` runs to one."""
    spark = manifest.sparkSession
    runs = manifest.select("run", "samples")
    while (count := runs.count()) > fan_in:
        names = sorted(r.run for r in runs.select("run").toLocalIterator())  # one short name an archive
        groups = [(names[i : i + fan_in],) for i in range(0, count, fan_in)]
        jobs = spark.createDataFrame(groups, "runs array<string>").repartition(len(groups))

        def join(batches):
            for batch in batches:
                for own in batch.column("runs").to_pylist():
                    stream, name = new_file(folder, "run", ".cdx")
                    samples = write_sorted(stream, merge([read_run(folder, r, None, None) for r in own]))
                    stream.close()
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([[json.dumps(s) for s in samples]])], names=["run", "samples"])

        runs = settle(jobs.mapInArrow(join, "run string, samples array<string>"), "warc-runs")
    return runs


def capture_histories(manifest: DataFrame, folder: str) -> DataFrame:
    """``part, seq, url_key, time, page_id, file, offset, size``: in the order of (part,
    seq) the captures of all archives by URL key, timestamp and page id."""
    spark = manifest.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    manifest = merge_rounds(manifest, folder, FAN_IN)
    runs = [r.run for r in manifest.select("run").toLocalIterator()]
    encode = lambda k: None if k is None else json.dumps(list(k))
    cut = [(i, encode(a), encode(b)) for i, (a, b) in enumerate(ranges(manifest, parts))] if runs else []
    jobs = spark.createDataFrame(cut, "part int, low string, high string").repartition(max(1, len(cut)), "part")
    names = spark.sparkContext.broadcast(runs)

    def follow(batches):
        decode = lambda s: None if s is None else tuple(json.loads(s))
        for batch in batches:
            for part, low, high in zip(*(batch.column(c).to_pylist() for c in ("part", "low", "high")), strict=True):
                out, seq = [], 0
                for e in merge([read_run(folder, r, decode(low), decode(high)) for r in names.value]):
                    out.append((part, seq, *e))
                    seq += 1
                    if len(out) == 4096:
                        yield _entries(out)
                        out = []
                if out:
                    yield _entries(out)

    return jobs.mapInArrow(follow, "part int, seq long, url_key string, time string, page_id long, file string, offset long, size long")


def _entries(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    names = ("part", "seq", "url_key", "time", "page_id", "file", "offset", "size")
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))


def read_records(index: DataFrame, folder: str, *, payloads: bool = False) -> DataFrame:
    """Follow index entries to their records: ``part, seq, url_key, page_id, payload_bytes,
    payload_digest, record_type, refers_to`` and, if asked for, ``payload``."""

    def read(batches):
        for batch in batches:
            files, offsets, sizes = (batch.column(c).to_pylist() for c in ("file", "offset", "size"))
            got: list[dict] = [{}] * batch.num_rows
            source = last = None
            for i in sorted(range(batch.num_rows), key=lambda i: (files[i], offsets[i])):
                if files[i] != last:
                    if source is not None:
                        source.close()
                    source, last = read_file(folder, files[i]), files[i]
                got[i] = parse(zlib.decompress(source.read_at(sizes[i], offsets[i]), 31))
            if source is not None:
                source.close()
            columns = [batch.column(c) for c in ("part", "seq", "url_key")]
            columns += [pa.array([g[c] for g in got], k) for c, k in (("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()))]
            if payloads:
                columns.append(pa.array([g["payload"] for g in got], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["part", "seq", "url_key", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads)

    return index.mapInArrow(read, "part int, seq long, url_key string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads)


def archive_report(pages: DataFrame, *, least_revisit: int = 0) -> DataFrame:
    """Write, merge, read back: ``page_id, payload_bytes, payload_digest, record_type,
    refers_to`` per page."""
    manifest, folder = write_archives(pages, least_revisit=least_revisit)
    rows = read_records(capture_histories(manifest, folder), folder)
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
