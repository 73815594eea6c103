"""A workspace: states, batches and datasets in one folder.

States are manifests; publishing one is the last step of a call, so a call that stops
before it leaves nothing behind but unreferenced folders, and a retry of a batch returns
what was published."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Refused
from ..functions.json import patch_udf
from ..operators import selections, states
from ..sources.control import digest, require
from ..sources.layers import LayerStore


@dataclass(frozen=True)
class State:
    id: str
    members: str
    entities: tuple[str, ...]
    base: str | None
    edited: str | None


class Workspace:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.layers = LayerStore(spark, root)
        self.files = self.layers.files

    # --- publishing ------------------------------------------------------------------

    def _publish(self, members: str, entities: list[str], base: str | None, edited: str | None, note: dict) -> State:
        body = {"members": members, "entities": entities, "base": base, "edited": edited, "note": note}
        name = digest(body)
        self.files.create(f"states/{name}.json", body)
        return State(name, members, tuple(entities), base, edited)

    def open(self, state_id: str) -> State:
        require(self.files.exists(f"states/{state_id}.json"), f"no state {state_id}")
        body = self.files.read(f"states/{state_id}.json")
        require(digest(body) == state_id, "a state differs from its name")
        return State(state_id, body["members"], tuple(body["entities"]), body["base"], body["edited"])

    def _once(self, batch: str, inputs: dict, make) -> State:
        """Runs a batch once; the same batch with the same input returns its state, with
        other input it refuses."""
        name = f"batches/{hashlib.sha256(batch.encode()).hexdigest()}.json"
        if self.files.exists(name):
            old = self.files.read(name)
            require(old["inputs"] == inputs, f"batch {batch} ran with other input")
            return self.open(old["state"])
        state = make()
        if not self.files.create(name, {"inputs": inputs, "state": state.id, "batch": batch}):
            return self._once(batch, inputs, make)
        return state

    @staticmethod
    def _fingerprint(rows: DataFrame | None) -> list | None:
        if rows is None:
            return None
        f = selections.fingerprint(rows, sorted(rows.columns)).first()
        return [f.rows, str(f.hash_sum)]

    # --- states ----------------------------------------------------------------------

    def create(self, rows: DataFrame, batch: str) -> State:
        """A state of ``rows(member_key, value)``."""

        def make() -> State:
            members, entities = states.create(rows, batch)
            m = self.layers.write(members, kind="membership", key=["member_key"], check=False)
            e = self.layers.write(entities, kind="entities", key=["occurrence_id"], check=False)
            return self._publish(m.id, [e.id], None, None, {"batch": batch})

        return self._once(batch, {"rows": self._fingerprint(rows)}, make)

    def upsert(self, base: State, rows: DataFrame, batch: str, *, removals: DataFrame | None = None, dataset: str | None = None) -> State:
        """``rows`` added or replaced, ``removals`` gone, the rest shared with the base.  With a
        dataset, its pointer moves from the base to the result, or the call refuses."""

        def make() -> State:
            if dataset is not None:
                require(self.files.current(dataset) == base.id, f"{dataset} has moved on")
            if rows.isEmpty() and (removals is None or removals.isEmpty()):
                raise Refused("a batch is empty")
            old = self.members(base)
            states.unique(rows, ["member_key"])
            minted = states.mint(rows, batch)
            if removals is not None:
                states.refuse_any(removals.join(old, "member_key", "left_anti"), "a removal names no member")
            m = self.layers.apply(self.layers.open(base.members), minted.select("member_key", "occurrence_id"), removals)
            e = self.layers.write(minted.select("occurrence_id", "value"), kind="entities", key=["occurrence_id"], check=False)
            keys = rows.select("member_key") if removals is None else rows.select("member_key").unionByName(removals.select("member_key"))
            edited = self.layers.write(keys, kind="edited", key=["member_key"], check=False)
            return self._publish(m.id, [e.id, *base.entities], base.id, edited.id, {"batch": batch})

        state = self._once(batch, {"base": base.id, "rows": self._fingerprint(rows), "removals": self._fingerprint(removals)}, make)
        if dataset is not None and self.files.current(dataset) != state.id:
            self.files.advance(dataset, state.id, base.id)
        return state

    def revise(self, base: State, edits: DataFrame, batch: str) -> State:
        """Ordered edits ``(member_key, sequence, action, occurrence_id)`` of occurrences that
        the base's entities hold."""

        def make() -> State:
            old = self.members(base)
            states.refuse_any(states.unavailable_puts(edits, self.entities(base)), "a put names an unknown occurrence")
            states.unique(edits, ["member_key", "sequence"])
            states.refuse_any(states.invalid_edits(old, edits), "a remove names no live key")
            last = states.latest_edits(edits)
            gone = last.where("action = 'remove'").select("member_key").join(old, "member_key", "left_semi")
            m = self.layers.apply(self.layers.open(base.members), last.where("action = 'put'").select("member_key", "occurrence_id"), gone)
            edited = self.layers.write(last.select("member_key"), kind="edited", key=["member_key"], check=False)
            return self._publish(m.id, list(base.entities), base.id, edited.id, {"batch": batch})

        return self._once(batch, {"base": base.id, "edits": self._fingerprint(edits)}, make)

    def edit_values(self, base: State, patches: DataFrame, batch: str) -> State:
        """``patches(member_key, operations)``: JSON Patch texts on members' values."""
        named = patches.join(self.rows(base), "member_key", "left")
        states.refuse_any(named.where("value is null").select("member_key"), "a patch names no member")
        return self.upsert(base, named.select("member_key", patch_udf("value", "operations").alias("value")), batch)

    def from_occurrences(self, source: State, members: DataFrame, batch: str) -> State:
        """A state of ``(member_key, occurrence_id)`` over occurrences that a state holds."""
        states.unique(members, ["member_key"])
        states.refuse_any(states.incomplete_members(members, self.entities(source)), "an occurrence is unknown")
        m = self.layers.write(members.select("member_key", "occurrence_id"), kind="membership", key=["member_key"], check=False)
        return self._publish(m.id, list(source.entities), None, None, {"batch": batch})

    def checkpoint(self, state: State) -> State:
        """The same membership over one layer of the entities it uses."""
        used = states.checkpoint_order(self.members(state), self.entities(state)).select("occurrence_id", "value")
        e = self.layers.write(used, kind="entities", key=["occurrence_id"], check=False)
        m = self.layers.compact(self.layers.open(state.members))
        return self._publish(m.id, [e.id], state.base, state.edited, {"checkpoint": state.id})

    # --- reading ---------------------------------------------------------------------

    def members(self, state: State) -> DataFrame:
        return self.layers.relation(self.layers.open(state.members))

    def entities(self, state: State) -> DataFrame:
        parts = [self.layers.relation(self.layers.open(e)) for e in state.entities]
        return reduce(DataFrame.unionByName, parts).dropDuplicates(["occurrence_id"]) if len(parts) > 1 else parts[0]

    def rows(self, state: State, keys: DataFrame | None = None) -> DataFrame:
        """``member_key, occurrence_id, value``; with ``keys``, those, absent ones as null."""
        members = self.members(state) if keys is None else states.named_scope(self.members(state), keys)
        return states.keyed_values(members, self.entities(state))

    def certified_keys(self, older: State, newer: State) -> DataFrame | None:
        """Keys edited on the way from ``older`` to ``newer``, where the way is recorded."""
        keys, at = None, newer
        while at.id != older.id:
            if at.base is None or at.edited is None:
                return None
            own = self.layers.relation(self.layers.open(at.edited))
            keys, at = own if keys is None else keys.unionByName(own), self.open(at.base)
        return keys

    def differing(self, older: State, newer: State) -> DataFrame:
        return states.differing(self.members(older), self.members(newer), self.certified_keys(older, newer))

    def compare(self, older: State, newer: State, *, sample: int = 100) -> tuple[DataFrame, DataFrame]:
        keys = self.certified_keys(older, newer)
        a, b = self.members(older), self.members(newer)
        if keys is not None:
            a, b = (s.join(keys.distinct(), "member_key", "left_semi") for s in (a, b))
        return states.compare(a, b, self.entities(older), self.entities(newer), sample=sample)

    def changes(self, older: State, newer: State) -> DataFrame:
        diff = self.differing(older, newer).select("member_key", F.col("newer_id").alias("occurrence_id"))
        return diff.join(self.entities(newer), "occurrence_id", "left").select("member_key", "occurrence_id", "value")

    # --- datasets, inspection, removal -------------------------------------------------

    def select_current(self, dataset: str, state: State, expected: State | None) -> None:
        self.files.advance(dataset, state.id, expected.id if expected else None)

    def current(self, dataset: str) -> State | None:
        target = self.files.current(dataset)
        return self.open(target) if target else None

    def inspect(self, state: State) -> dict:
        body = self.files.read(f"states/{state.id}.json")
        return {**body, "id": state.id, "rows": self.members(state).count(), "parts": [len(self.layers.open(x).parts) for x in (state.members, *state.entities)]}

    def protected(self, keep: list[State]) -> set[str]:
        """Folders that states (and their bases) reach."""
        out: set[str] = set()
        for state in keep:
            at: State | None = state
            while at is not None:
                for layer in (at.members, *at.entities, *([at.edited] if at.edited else [])):
                    out.update(self.layers.paths(self.layers.open(layer)))
                at = self.open(at.base) if at.base else None
        return out

    def remove_unreferenced(self, keep: list[State]) -> list[str]:
        """Deletes data folders that no kept state reaches; returns their names."""
        held = {p.rpartition("/")[2] for p in self.protected(keep)}
        gone = [n for n in self.files.names("data") if n not in held]
        for n in gone:
            self.files.delete(f"data/{n}")
        return gone

    def export(self, state: State, destination: str) -> str:
        """Copies a state's rows with a manifest that pins their number and fingerprint."""
        rows = self.rows(state)
        rows.write.parquet(f"{destination.rstrip('/')}/rows")
        from ..sources.control import Files

        files = Files(self.spark, destination)
        written = self.spark.read.schema(rows.schema).parquet(files.path("rows"))
        body = {"state": state.id, "schema": rows.schema.jsonValue(), "fingerprint": self._fingerprint(written)}
        require(files.create("manifest.json", body), "the destination holds an export")
        return digest(body)


def open_export(spark: SparkSession, path: str, *, expected_pin: str) -> DataFrame:
    """An export's rows, after its pin, number and fingerprint are checked; no workspace."""
    from pyspark.sql.types import StructType

    from ..sources.control import Files

    files = Files(spark, path)
    body = files.read("manifest.json")
    require(digest(body) == expected_pin, "the export is not the pinned one")
    rows = spark.read.schema(StructType.fromJson(body["schema"])).parquet(files.path("rows"))
    require(Workspace._fingerprint(rows) == body["fingerprint"], "the export's rows have changed")
    return rows
