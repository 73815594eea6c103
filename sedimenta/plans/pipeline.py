"""A document run: capture, extract, segment and process what a catalog selected, without
doing again what retained results already hold."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import LimitExceeded, Refused
from ..functions import segments
from ..functions.text import sha256_digest, stable_urn
from ..operators import documents
from ..operators.closure import operation_order
from ..operators.shared import settled


@dataclass(frozen=True)
class Processor:
    """``make(segments) -> DataFrame`` with a column ``segment_id``; it runs after the
    processors it names, whose outputs it gets by name."""

    name: str
    version: str
    make: Callable[[DataFrame, dict[str, DataFrame]], DataFrame]
    after: tuple[str, ...] = ()


STATISTICS = Processor("content-statistics", "1", lambda s, _: documents.segment_statistics(s, ["segment_id"]))


def capture(items: DataFrame, files: DataFrame, *, most_bytes: int) -> DataFrame:
    """``item, locator, media, content, content_digest`` of active items' candidates among
    ``files(locator, media, content)``; a total beyond ``most_bytes`` refuses."""
    wanted = items.where("state = 'active'").select("item", F.explode("candidates").alias("locator"))
    got = wanted.join(files, "locator").select("item", "locator", "media", F.col("content").cast("binary").alias("content"))
    got = got.withColumn("content_digest", sha256_digest("content"))
    total = got.agg(F.sum(F.octet_length("content")).alias("n")).first().n or 0
    if total > most_bytes:
        raise LimitExceeded(f"captured files hold {total} bytes")
    return got


def representations(captured: DataFrame) -> DataFrame:
    """``representation_id, item, kind, text``: visible text of HTML and XML, plain text and
    JSON as they are; each distinct content is read once."""
    kinds = captured.withColumn("kind", documents.extractor_for("media"))
    distinct = kinds.select("content_digest", "kind", "content").dropDuplicates(["content_digest", "kind"])
    html = documents.visible_text(distinct.where("kind = 'html'"), key="content_digest", content="content").select("content_digest", F.lit("html").alias("kind"), "text")
    xml = documents.visible_text(distinct.where("kind = 'xml'"), key="content_digest", content="content", kind="xml").select("content_digest", F.lit("xml").alias("kind"), "text")
    plain = distinct.where("kind in ('text', 'json')").select("content_digest", "kind", F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).alias("text"))
    text = html.unionByName(xml).unionByName(plain).where("text is not null")
    out = kinds.select("item", "locator", "content_digest", "kind").join(text, ["content_digest", "kind"])
    return out.withColumn("representation_id", stable_urn("representation", F.concat_ws("|", "content_digest", "kind"))).select("representation_id", "item", "locator", "kind", "text")


def run(
    items: DataFrame, files: DataFrame, processors: list[Processor], *, retained: dict[str, DataFrame] | None = None, bounds: segments.Bounds | None = None,
    most_bytes: int = 1 << 40, most_rows: int = 1 << 40,
) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """(segments, outputs by processor, summary per item).  ``retained`` holds outputs of an
    earlier run by processor: segments they cover are not processed again."""
    by = {p.name: p for p in processors}
    if len(by) != len(processors):
        raise Refused("a processor is named twice")
    order = operation_order({p.name: list(p.after) for p in processors})
    reps = settled(representations(capture(items, files, most_bytes=most_bytes)), "representations")
    texts = reps.select("representation_id", "kind", "text").dropDuplicates(["representation_id"])
    cut = (
        documents.bounded_segments(texts.where("kind <> 'json'"), key="representation_id", text="text", bounds=bounds).select("representation_id", "ordinal", "start", "end", "text")
        if bounds else documents.paragraph_segments(texts.where("kind <> 'json'"), key="representation_id", text="text")
    )
    records = documents.record_segments(texts.where("kind = 'json'"), key="representation_id", text="text")
    found = settled(documents.segment_identity(cut.unionByName(records), "representation_id", "bounded/1" if bounds else "paragraph/1"), "segments")
    outputs: dict[str, DataFrame] = {}
    rows = found.count()
    for name in order:
        p, held = by[name], (retained or {}).get(name)
        todo = found if held is None else found.join(held.select("segment_id").distinct(), "segment_id", "left_anti")
        fresh = p.make(todo, outputs).withColumn("processor", F.lit(f"{p.name}/{p.version}"))
        if held is not None:
            fresh = held.join(found.select("segment_id").distinct(), "segment_id", "left_semi").unionByName(fresh)
        outputs[name] = settled(fresh, f"output-{name}")
        rows += outputs[name].count()
        if rows > most_rows:
            raise LimitExceeded(f"a run makes more than {most_rows} rows")
    per = reps.join(found.select("representation_id", "segment_id"), "representation_id", "left").groupBy("item").agg(F.count_distinct("representation_id").alias("representations"), F.count("segment_id").alias("segments"))
    active = items.select("item", "state").join(per, "item", "left")
    return found, outputs, active.select("item", "state", F.coalesce("representations", F.lit(0)).alias("representations"), F.coalesce("segments", F.lit(0)).alias("segments"))
