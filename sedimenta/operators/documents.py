"""Documents as DataFrames: extraction, visible text, segments, statistics, phrases.

Kernels run per Arrow batch over whole texts; each function names its id and content
columns, and every output keeps the id."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import Refused
from ..functions import markup, segments
from ..functions.json import closed
from ..functions.text import content_statistics, media_type, stable_urn

# --- routing --------------------------------------------------------------------


def extractor_for(media: Column | str) -> Column:
    """html, xml, json, pdf, image or text by the base media type, else null."""
    m = media_type(media)
    return (
        F.when(m == "text/html", "html").when(m.isin("application/xml", "text/xml") | m.endswith("+xml"), "xml").when((m == "application/json") | m.endswith("+json"), "json")
        .when(m == "application/pdf", "pdf").when(m.startswith("image/"), "image").when(m.startswith("text/"), "text")
    )


def segmenter_for(kind: Column, bounded: bool = False) -> Column:
    text = F.lit("bounded" if bounded else "paragraph")
    return F.when(kind.isin("text", "html", "xml"), text).when(kind == "json", "record").when(kind == "pdf-text", "page").when(kind == "image", "whole-image")


# --- extraction --------------------------------------------------------------------

EXTRACTED = "elements long, codepoints long, lines long, root string, width int, height int, problem string"


def _image_size(data: bytes) -> tuple[int, int]:
    """Width and height from a PNG, GIF, BMP or JPEG header."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and data[12:16] == b"IHDR":
        return struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return struct.unpack("<HH", data[6:10])
    if data[:2] == b"BM":
        return tuple(map(abs, struct.unpack("<ii", data[18:26])))
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            mark = data[at + 1]
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                return struct.unpack(">HH", data[at + 5 : at + 9])[::-1]
            at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0] if mark != 0xFF and not 0xD0 <= mark <= 0xD9 else 2
    raise Refused("an image header is not understood")


def extract_one(kind: str | None, data: bytes) -> dict:
    """Facts of one file by its kind; ``problem`` says why there are none."""
    out: dict = dict.fromkeys(f.split()[0] for f in EXTRACTED.split(", "))
    try:
        if kind == "image":
            out["width"], out["height"] = _image_size(data)
        elif kind == "xml":
            data.decode()
            root, out["elements"] = markup.read_xml(data)
            out["root"] = next((p.tag for p in root.parts if isinstance(p, markup.Element)), None)
        elif kind == "html":
            _, out["elements"], out["codepoints"] = markup.read_html(data.decode())
        elif kind == "json":
            closed(data.decode())
        elif kind == "text":
            text = data.decode()
            out["codepoints"], out["lines"] = len(text), len(text.splitlines())
        else:
            out["problem"] = "no extractor for this media type" if kind != "pdf" else "no PDF reader is installed"
    except (Refused, UnicodeDecodeError, struct.error) as error:
        out["problem"] = str(error)
    return out


def extract(files: DataFrame, *, key: str, content: str, media: str) -> DataFrame:
    """``key, kind`` and the extracted facts per file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            facts = pd.DataFrame([extract_one(k, b or b"") for k, b in zip(pdf["kind"], pdf["content"], strict=True)], columns=[f.split()[0] for f in EXTRACTED.split(", ")])
            for c in ("elements", "codepoints", "lines", "width", "height"):
                facts[c] = facts[c].astype("Int64")
            yield pd.concat([pdf[["key", "kind"]].reset_index(drop=True), facts], axis=1)

    rows = files.select(F.col(key).alias("key"), extractor_for(media).alias("kind"), F.col(content).cast("binary").alias("content"))
    return rows.mapInPandas(run, f"key {rows.schema['key'].dataType.simpleString()}, kind string, {EXTRACTED}").withColumnRenamed("key", key)


def visible_text(files: DataFrame, *, key: str, content: str, kind: str = "html") -> DataFrame:
    """``key, text, blocks`` (array of struct(kind, level, start, end)) per file; a file that
    shows nothing, or does not parse, has a null text and a ``problem``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, data in zip(pdf["key"], pdf["content"], strict=True):
                try:
                    seen = markup.visible_html((data or b"").decode()) if kind == "html" else markup.visible_xml(data or b"")
                    empty = not seen.text.strip()
                    blocks = [dict(zip(("kind", "level", "start", "end"), b, strict=True)) for b in seen.blocks]
                    out.append((k, None if empty else seen.text, [] if empty else blocks, "no visible text" if empty else None))
                except (Refused, UnicodeDecodeError) as error:
                    out.append((k, None, [], str(error)))
            yield pd.DataFrame(out, columns=["key", "text", "blocks", "problem"])

    rows = files.select(F.col(key).alias("key"), F.col(content).cast("binary").alias("content"))
    kind_ = rows.schema["key"].dataType.simpleString()
    return rows.mapInPandas(run, f"key {kind_}, text string, blocks array<struct<kind:string,level:int,start:long,end:long>>, problem string").withColumnRenamed("key", key)


def visible_blocks(seen: DataFrame, key: str) -> DataFrame:
    """One segment per block of visible text: ``key, ordinal, kind, level, start, end, text``."""
    each = seen.select(key, F.col("text").cast("binary").alias("__raw"), F.posexplode("blocks").alias("ordinal", "b"))
    text = F.substring(F.col("__raw"), (F.col("b.start") + 1).cast("int"), (F.col("b.end") - F.col("b.start")).cast("int")).cast("string")
    return each.select(key, "ordinal", "b.kind", "b.level", "b.start", "b.end", text.alias("text"))


# --- segments --------------------------------------------------------------------------


def _ranges(docs: DataFrame, key: str, text: str, cut: Callable[[str], list[tuple[int, int]]]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, t in zip(pdf["key"], pdf["text"], strict=True):
                if t:
                    at = segments.byte_places(t)
                    out += [(k, i, at[a], at[b], t[a:b]) for i, (a, b) in enumerate(cut(t))]
            yield pd.DataFrame(out, columns=["key", "ordinal", "start", "end", "text"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInPandas(run, f"key {kind}, ordinal int, start long, end long, text string").withColumnRenamed("key", key)


def paragraph_segments(docs: DataFrame, *, key: str, text: str) -> DataFrame:
    """``key, ordinal, start, end, text`` of blank-line paragraphs, in bytes."""
    return _ranges(docs, key, text, segments.paragraphs)


def record_segments(docs: DataFrame, *, key: str, text: str) -> DataFrame:
    """The same of the members of top-level JSON arrays."""
    return _ranges(docs, key, text, segments.json_records)


def page_segments(pages: DataFrame, *, key: str, page_array: str) -> DataFrame:
    """One segment per page of an array of page texts, empty ones included."""
    return pages.select(key, F.posexplode(page_array).alias("ordinal", "text"))


def whole_segments(files: DataFrame, *, key: str, content: str) -> DataFrame:
    return files.select(key, F.lit(0).alias("ordinal"), F.lit(0).cast("long").alias("start"), F.octet_length(content).cast("long").alias("end"), F.col(content).alias("content"))


def bounded_segments(docs: DataFrame, *, key: str, text: str, bounds: segments.Bounds = segments.Bounds(), count: segments.Counter = segments.words) -> DataFrame:
    """``key, ordinal, start, end, headings, tokens, text`` of bounded segments."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, t in zip(pdf["key"], pdf["text"], strict=True):
                raw = (t or "").encode()
                out += [(k, i, a, b, list(h), n, raw[a:b].decode()) for i, (a, b, h, n) in enumerate(segments.bounded(t or "", bounds, count).segments)]
            yield pd.DataFrame(out, columns=["key", "ordinal", "start", "end", "headings", "tokens", "text"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInPandas(run, f"key {kind}, ordinal int, start long, end long, headings array<string>, tokens long, text string").withColumnRenamed("key", key)


def segment_coverage(docs: DataFrame, *, key: str, text: str, bounds: segments.Bounds = segments.Bounds(), count: segments.Counter = segments.words) -> DataFrame:
    """Bytes covered, duplicated, excluded and left, per document."""
    names = ["representation_bytes", "covered_bytes", "duplicated_bytes", "excluded_bytes", "uncovered_bytes", "segment_count"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(k, *segments.bounded(t or "", bounds, count).coverage.values()) for k, t in zip(pdf["key"], pdf["text"], strict=True)]
            yield pd.DataFrame(out, columns=["key", *names])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInPandas(run, f"key {kind}, " + ", ".join(f"{n} long" for n in names)).withColumnRenamed("key", key)


def interval_coverage(spans: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Covered and duplicated lengths of intervals per key, by a running maximum."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    seen = spans.select(key, start, end, F.coalesce(F.max(end).over(w), F.col(start)).alias("__before"))
    fresh = F.greatest(F.col(end) - F.greatest(F.col(start), F.col("__before")), F.lit(0))
    return seen.groupBy(key).agg(F.sum(fresh).alias("covered"), (F.sum(F.col(end) - F.col(start)) - F.sum(fresh)).alias("duplicated"))


def segment_identity(rows: DataFrame, key: str, segmenter: str) -> DataFrame:
    """Adds ``content_digest, segment_id``: the id follows from document, segmenter, place
    and content."""
    from ..functions.text import sha256_digest

    out = rows.withColumn("content_digest", sha256_digest("text"))
    parts = F.concat_ws("|", F.lit(segmenter), F.col(key).cast("string"), F.col("ordinal").cast("string"), F.col("start").cast("string"), F.col("end").cast("string"), "content_digest")
    return out.withColumn("segment_id", stable_urn("segment", parts))


def unfaithful_segments(rows: DataFrame, docs: DataFrame, *, key: str, text: str) -> DataFrame:
    """Segments whose text is not the document's bytes at their place."""
    raw = docs.select(F.col(key).alias("__k"), F.col(text).cast("binary").alias("__raw"))
    there = F.substring(F.col("__raw"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")).cast("string")
    return rows.join(raw, rows[key] == raw["__k"], "left").where(~there.eqNullSafe(F.col("text"))).select(*rows.columns)


def segment_statistics(rows: DataFrame, keys: list[str], content: str = "text") -> DataFrame:
    return rows.select(*keys, *content_statistics(content))


def split_segments(rows: DataFrame, key: str, content_id: Column) -> DataFrame:
    """Rows whose key ends in ``:metadata`` with the content row that they name."""
    meta = rows.where(F.col(key).endswith(":metadata")).select(key, F.col("value").alias("metadata"), content_id.alias("__c"))
    content = rows.select(F.col(key).alias("__c"), F.col("value").alias("content"))
    return meta.join(content, "__c", "left").drop("__c").orderBy(key)


# --- phrases ---------------------------------------------------------------------------


def phrase_matches(docs: DataFrame, phrases: list[tuple[str, str]], *, key: str, text: str, case_sensitive: bool = False, most: int = 1024) -> DataFrame:
    """``key, start, end, term, phrase, quote`` of all overlapping matches on word bounds.
    The vocabulary is a bounded parameter (at most 256 phrases of 128 characters)."""
    if len(phrases) > 256 or any(not p.strip() or len(p) > 128 for _, p in phrases):
        raise Refused("a vocabulary passes its bounds")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(k, *m) for k, t in zip(pdf["key"], pdf["text"], strict=True) for m in segments.phrase_matches(t or "", phrases, case_sensitive=case_sensitive, most=most)]
            yield pd.DataFrame(out, columns=["key", "start", "end", "term", "phrase", "quote"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInPandas(run, f"key {kind}, start long, end long, term string, phrase string, quote string").withColumnRenamed("key", key)


# --- processors -----------------------------------------------------------------------


def process(rows: DataFrame, callback: Callable[[dict], list[dict]], *, allowed: list[str], schema: str, most_bytes: int = 1 << 20, media: tuple[str, list[str]] | None = None) -> DataFrame:
    """Runs a callback per row with the permitted fields alone; output that the schema does
    not name, or that passes ``most_bytes``, refuses.  ``media``: (column, admitted types)."""
    import json

    from pyspark.sql.types import StructType

    names = StructType.fromDDL(schema).names
    if media:
        from .guards import refuse_any

        refuse_any(rows.where(~media_type(media[0]).isin(media[1])), "a media type is not admitted")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                for got in callback(row):
                    if set(got) != set(names) or len(json.dumps(got, default=str)) > most_bytes:
                        raise Refused("a processor's output breaks its contract")
                    out.append(got)
            yield pd.DataFrame(out, columns=names)

    return rows.select(*allowed).mapInPandas(run, schema)
