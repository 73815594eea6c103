"""Operations: what was asked, what ran, what came of it, and what need not run again.

Control records are small files in the workspace.  An operation's meaning is the digest of
its definition and of its labelled dependency evidence, without any ids, so two requests
that mean the same share a result."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import Refused
from ..functions.json import canonical
from ..sources.control import Files, digest, require


def correspondence(definition: dict, evidence: dict[str, str]) -> str:
    """Digest of an operation's meaning; evidence maps a dependency's label to its digest."""
    meaning = {k: v for k, v in definition.items() if k not in ("id", "created")}
    return digest([json.loads(canonical(meaning)), sorted(evidence.items())])


def fold(dependencies: list[dict], corrections: list[dict]) -> dict[str, str]:
    """Labelled evidence after corrections in order: an omission drops a label that is there,
    a supplement adds one that is not."""
    out = {d["label"]: d["digest"] for d in dependencies}
    require(len(out) == len(dependencies), "a dependency label is repeated")
    for c in corrections:
        if c["kind"] == "omit":
            require(c["label"] in out, f"no dependency {c['label']}")
            del out[c["label"]]
        elif c["kind"] == "supplement":
            require(c["label"] not in out, f"{c['label']} is declared already")
            out[c["label"]] = c["digest"]
        else:
            raise Refused(f"unknown correction {c['kind']}")
    return out


def correspondence_column(definition: str, evidence: str) -> F.Column:
    """The same for rows of canonical definition and ``map<label, digest>`` columns."""
    pairs = F.array_sort(F.map_entries(evidence))
    one = F.transform(pairs, lambda p: F.concat(F.lit('["'), p["key"], F.lit('","'), p["value"], F.lit('"]')))
    return F.sha2(F.concat(F.lit("["), F.col(definition), F.lit(",["), F.array_join(one, ","), F.lit("]]")), 256)


def resolve_many(requests: DataFrame, results: DataFrame, *, admitted: F.Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(reused, to run): ``requests(request_id, correspondence)`` with a retained result
    ``(correspondence, result_id, outcome, available)`` that succeeded and is available, of
    the least id if there are several; the others, once per meaning, have to run."""
    usable = results.where("outcome = 'success' and available")
    usable = usable.where(admitted) if admitted is not None else usable
    best = usable.groupBy("correspondence").agg(F.min("result_id").alias("result_id"))
    reused = requests.join(best, "correspondence")
    missing = requests.join(best, "correspondence", "left_anti")
    return reused, missing.groupBy("correspondence").agg(F.min("request_id").alias("request_id"), F.count("*").alias("requests"))


@dataclass(frozen=True)
class Result:
    correspondence: str
    outcome: str
    output: Any
    attempts: int


class Operations:
    """Attempts and results under ``operations/`` of a workspace's files."""

    def __init__(self, files: Files):
        self.files = files

    def _folder(self, key: str) -> str:
        return f"operations/{key}"

    def result(self, key: str) -> Result | None:
        name = f"{self._folder(key)}/result.json"
        return Result(**self.files.read(name)) if self.files.exists(name) else None

    def checkpoints(self, key: str) -> list[Any]:
        return [self.files.read(f"{self._folder(key)}/checkpoints/{n}") for n in self.files.names(f"{self._folder(key)}/checkpoints")]

    def run_once(self, definition: dict, evidence: dict[str, str], produce: Callable[[Callable[[Any], None], list[Any]], Any]) -> Result:
        """The retained result of this meaning, or that of a new attempt.  ``produce(save,
        saved)`` may save progress; an attempt after a failure gets what was saved.  A
        failed attempt is recorded and may be tried again."""
        key = correspondence(definition, evidence)
        done = self.result(key)
        if done is not None:
            return done
        attempt = len(self.files.names(f"{self._folder(key)}/attempts"))
        require(self.files.create(f"{self._folder(key)}/attempts/{attempt:06d}.json", {"definition": definition, "evidence": evidence}), "an attempt is under way")

        def save(progress: Any) -> None:
            n = len(self.files.names(f"{self._folder(key)}/checkpoints"))
            require(self.files.create(f"{self._folder(key)}/checkpoints/{n:08d}.json", progress), "progress is saved by another attempt")

        output = produce(save, self.checkpoints(key))
        body = {"correspondence": key, "outcome": "success", "output": output, "attempts": attempt + 1}
        if not self.files.create(f"{self._folder(key)}/result.json", body):
            return self.result(key)
        return Result(**body)

    def inspect(self, key: str) -> dict:
        return {"attempts": len(self.files.names(f"{self._folder(key)}/attempts")), "checkpoints": len(self.checkpoints(key)), "result": self.result(key)}


def selected_outputs(members: DataFrame, selections: DataFrame, results: DataFrame) -> DataFrame:
    """``member_key, occurrence_id, result_id, output`` of members with their selected
    results; a selection made for another occurrence of the member, or of a result that
    is not there, refuses."""
    from ..operators.guards import refuse_any

    joined = selections.withColumnRenamed("occurrence_id", "selected_for").join(members, "member_key", "left")
    refuse_any(joined.where(~F.col("selected_for").eqNullSafe(F.col("occurrence_id"))).select("member_key"), "a selection is stale")
    full = joined.join(results, "result_id", "left")
    refuse_any(full.where("output is null").select("member_key", "result_id"), "a selected result is missing")
    return full.select("member_key", "occurrence_id", "result_id", "output")
