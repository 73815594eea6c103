"""Source catalogs end to end: normalise records, join, sample, decide, account, publish.

A policy is data: which columns hold what, and which rules decide.  Three are made here;
others are made the same way."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Refused
from ..functions import text
from ..functions.json import json_string
from ..operators import catalog, selections
from ..operators.guards import refuse_any, unique
from ..sources.control import require
from ..sources.layers import Layer, LayerStore

#: Fixed value: records of a publisher's own trials.
FIXTURE_PREFIXES = ("TRAIN-", "ERULE-", "TEST-")
#: What a publisher's restriction says about a missing rendition.
RESTRICTIONS = ("attachment-withheld", "confidential-business-information", "copyrighted", "personal-information")


@dataclass(frozen=True)
class Sample:
    partition: str
    strata: tuple[str, ...]
    seed: str
    limit: int


@dataclass(frozen=True)
class Policy:
    """``fields`` maps a normalised name to (source column, kind: text, date, instant, url,
    rin or strings); ``joins`` maps a name to a source column looked up in the index given
    to ``build`` under that name."""

    name: str
    item: str
    fields: dict[str, tuple[str, str]]
    required: tuple[str, ...] = ()
    joins: dict[str, str] = field(default_factory=dict)
    families: tuple[str, ...] = ()
    withdrawn: str | None = None
    restriction: str | None = None
    fixtures: bool = False
    sample: Sample | None = None
    budget: int | None = None
    owner: tuple[str, str] | None = None


def register_documents(item: str = "document_number") -> Policy:
    """A register of dated documents: selected if it has its required fields and a rendition."""
    fields = {"title": ("title", "text"), "published": ("publication_date", "date"), "agencies": ("agencies", "strings"), "topics": ("topics", "strings"), "rin": ("regulation_id", "rin"), "page": ("html_url", "url")}
    return Policy("register-documents", item, fields, ("title", "published"), families=("xml", "html", "text", "pdf"))


def docket_documents(item: str = "document_id", *, sample: Sample | None = None, budget: int | None = None) -> Policy:
    """Filings of dockets: trials, withdrawals, samples, metadata, renditions and a budget."""
    fields = {"title": ("title", "text"), "posted": ("posted_date", "instant"), "agency": ("agency_id", "text"), "docket": ("docket_id", "text"), "kind": ("document_type", "text")}
    return Policy("docket-documents", item, fields, ("title", "posted", "agency"), {"docket": "docket_id", "register-document": "register_number"}, ("register", "content", "attachment"), "withdrawn", "restrict_reason", True, sample, budget, ("docket_id", "agency_id"))


def supplied_records(item: str = "record_id") -> Policy:
    """A caller's own records: each with a rendition is selected."""
    return Policy("supplied-records", item, {"title": ("title", "text")}, families=("supplied",))


_KINDS = {
    "text": text.text_value, "date": text.date_value, "instant": text.utc_instant_date,
    "url": lambda c: _plain(c, text.http_url(c)), "rin": lambda c: _plain(c, text.rin(c)),
}


def _plain(c, value: Column) -> Column:
    c = text.col(c)
    return F.struct(value.alias("value"), F.when(c.isNotNull() & value.isNull(), F.array(c)).otherwise(F.array().cast("array<string>")).alias("unparseable"))


def normalised(records: DataFrame, policy: Policy) -> Column:
    """Array of struct(field, source, outcome, values, unparseable), in the policy's order."""
    out = []
    for name, (source, kind) in policy.fields.items():
        if source not in records.columns:
            values, bad = F.array().cast("array<string>"), F.array().cast("array<string>")
        elif kind == "strings":
            s = text.string_set(source)
            values, bad = s["values"], s["unparseable"]
        else:
            s = _KINDS[kind](source)
            values, bad = F.array_compact(F.array(s["value"])), s["unparseable"]
        outcome = text.normalization_outcome(F.get(values, 0), bad, F.size(values) > 0)
        out.append(F.struct(F.lit(name).alias("field"), F.lit(source).alias("source"), outcome.alias("outcome"), values.alias("values"), bad.alias("unparseable")))
    return F.array(*out)


def _field(name: str) -> Column:
    return F.element_at(F.filter("normalized", lambda f: f["field"] == name), 1)


def build(records: DataFrame, renditions: DataFrame, policy: Policy, indexes: dict[str, DataFrame] | None = None) -> DataFrame:
    """One row per item: ``item, normalized, joins, family, candidates, disposition,
    reason_code, decisions``.  ``renditions(item, family, locator)``; an item filed twice
    refuses, unless the policy says how its owner is found."""
    rows = records.withColumnRenamed(policy.item, "item")
    refuse_any(rows.where("item is null or item = ''").select("item"), "a record has no id")
    if policy.owner:
        rows = catalog.owned_records(rows, "item", *policy.owner)
    else:
        unique(rows, ["item"])
    rows = rows.withColumn("normalized", normalised(rows, policy))
    names = []
    for name, source in policy.joins.items():
        if indexes is None or name not in indexes:
            raise Refused(f"no index for the join {name}")
        rows = catalog.exact_join(rows, F.col(source), indexes[name], f"join_{name}")
        names.append(f"join_{name}")
    kind = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("join", "source_value", "outcome", "matched")]))
    struct = lambda n: F.struct(F.lit(n[5:]).alias("join"), F.col(f"{n}.source_value").cast("string").alias("source_value"), F.col(f"{n}.outcome").alias("outcome"), F.col(f"{n}.matched").cast("string").alias("matched"))
    rows = rows.withColumn("joins", F.array(*[struct(n) for n in names]).cast(kind) if names else F.array().cast(kind))
    chosen = catalog.prefer_rendition(renditions, "item", "family", "locator", list(policy.families)).withColumnRenamed("locators", "candidates")
    rows = rows.join(chosen, "item", "left")
    withdrawn = F.coalesce(F.col(policy.withdrawn), F.lit(False)) if policy.withdrawn else F.lit(False)
    rules = []
    if policy.fixtures:
        rules.append(("fixture", ~F.col("item").rlike("^(" + "|".join(FIXTURE_PREFIXES) + ")"), "excluded", "publisher-test-record"))
    if policy.withdrawn:
        rules.append(("withdrawn", ~withdrawn, "deleted", "withdrawn"))
    if policy.sample:
        s = policy.sample
        year = lambda c: F.substring(text.iso_date(c), 1, 4) if c.endswith("date") else F.col(c)
        drawn = catalog.stratified_sample(rows.where(~withdrawn), item="item", partition=s.partition, strata=[year(c) for c in s.strata], seed=s.seed, limit=s.limit)
        rows = rows.join(drawn.select("item", F.lit(True).alias("drawn")), "item", "left")
        rules.append(("sample", F.col("drawn"), "excluded", "not-drawn"))
    for name in policy.required:
        rules.append((f"metadata:{name}", _field(name)["outcome"] == "normalized", "failed", "metadata-missing"))
    if policy.restriction:
        known = F.col(policy.restriction).isin(*RESTRICTIONS)
        rules.append(("restriction", F.col("family").isNotNull() | F.col(policy.restriction).isNull() | known, "failed", "unread-restriction"))
    rules.append(("rendition", F.col("family").isNotNull(), "unavailable", "no-rendition"))
    out = catalog.decide(rows, rules)
    if policy.budget is not None:
        out = catalog.apply_budget(out, F.col("disposition") == "selected", text.utf16_key("item"), policy.budget)
        late = (F.col("disposition") == "selected") & ~F.col("in_budget")
        out = out.withColumn("reason_code", F.when(late, "budget-exhausted").otherwise(F.col("reason_code"))).withColumn("disposition", F.when(late, "excluded").otherwise(F.col("disposition"))).drop("in_budget")
    return out.select("item", "normalized", "joins", "family", "candidates", "disposition", "reason_code", "decisions")


def account(rows: DataFrame) -> dict:
    """Counts by disposition and reason, join coverage, and digests of the universe and the
    selected items in UTF-16 order."""
    tally = [tuple(r) for r in catalog.tally(rows).orderBy("disposition", "reason_code").collect()]
    coverage = catalog.join_coverage(rows.select(F.explode("joins").alias("j")).select("j.join", "j.outcome"))
    catalog.refuse_collapsed(coverage)

    def digest(part: DataFrame) -> dict:
        encoded = part.select(json_string(F.col("item")).alias("e"), text.utf16_key("item").alias("k"))
        d = selections.stream_digest(encoded, "e", ["k"]).first()
        return {"count": d.members, "digest": d.digest}

    return {"dispositions": tally, "joins": [r.asDict() for r in coverage.orderBy("join").collect()], "universe": digest(rows), "selected": digest(rows.where("disposition = 'selected'"))}


class Catalogs:
    """Published catalogs in a workspace: a layer, its account, and a pointer per name."""

    def __init__(self, store: LayerStore):
        self.store, self.files = store, store.files

    def publish(self, name: str, rows: DataFrame, *, supersedes: str | None = None) -> str:
        layer = self.store.write(rows, kind="catalog", key=["item"])
        body = {"layer": layer.id, "account": account(self.store.relation(layer)), "supersedes": supersedes}
        self.files.create(f"catalogs/{layer.id}.json", body)
        self.files.advance(f"catalog-{name}", layer.id, supersedes)
        return layer.id

    def open(self, catalog_id: str) -> tuple[DataFrame, dict]:
        require(self.files.exists(f"catalogs/{catalog_id}.json"), f"no catalog {catalog_id}")
        layer: Layer = self.store.open(catalog_id)
        return self.store.relation(layer), self.files.read(f"catalogs/{catalog_id}.json")["account"]

    def verify(self, catalog_id: str) -> None:
        """The account, made again, is the published one."""
        import json

        rows, claimed = self.open(catalog_id)
        require(json.loads(json.dumps(account(rows))) == claimed, "a catalog differs from its account")

    def preview(self, catalog_id: str, previous: str | None = None) -> DataFrame:
        """Changes by kind since the previous catalog, or all as added."""
        flat = lambda c: self.open(c)[0].select("item", F.col("normalized").cast("string").alias("normalized"), "family", "disposition", "reason_code")
        newer = flat(catalog_id)
        return catalog.preview(flat(previous) if previous else newer.limit(0), newer, "item")


def processing_items(rows: DataFrame) -> DataFrame:
    """A catalog's rows as items to process: ``item, state, candidates``."""
    state = F.when(F.col("disposition") == "selected", "active").when(F.col("disposition") == "deleted", "deleted").otherwise("excluded")
    return rows.select("item", state.alias("state"), F.coalesce("candidates", F.array().cast("array<string>")).alias("candidates"))
