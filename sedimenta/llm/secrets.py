"""Secret scans with an incremental blob ledger, in DataFrame operations alone.

Every historical version of a text is addressed by its content (SHA-256).  A ledger keeps
which (blob, rule, rule version) has been scanned and what was found; a run scans only
pairs that the ledger lacks, one text a blob, and joins the findings back to every path
that holds the blob.

Positions come from the pieces between matches: splitting by a rule gives the pieces,
extracting by it the matches, and their running lengths in code points the places.

Defined results: a null text is an empty one, which holds no secrets; copies and repeated
rows each get their blob's findings; a null path is kept; an empty table writes an empty
ledger part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_dir


@dataclass(frozen=True)
class Rule:
    """``least`` characters of ``group`` make a match a finding; ``version`` changes
    whenever the pattern or the bound does.  ``hint`` is a plain text that every match
    holds, if there is one."""

    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1
    hint: str = ""


#: The kinds in their order, their patterns and least lengths.
RULES = (
    Rule("assign", r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, hint="AKIA"),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)

FINDING = T.StructType([T.StructField("start", T.LongType()), T.StructField("order", T.IntegerType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())])
LEDGER = T.StructType([T.StructField("blob", T.StringType()), T.StructField("rule", T.StringType()), T.StructField("version", T.IntegerType()), T.StructField("found", T.ArrayType(FINDING))])


def findings(text: Column, rule: Rule, order: int) -> Column:
    """Sorted array of findings of one rule in ``text``."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    valued = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    pieces = F.split(text, rule.pattern, -1)
    # (place so far, findings so far), over piece and match in turn
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(T.ArrayType(FINDING)).alias("found"))
    steps = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(whole)).alias("piece"), whole.alias("match"), valued.alias("value"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.char_length(x["piece"])
        end = start + F.char_length(x["match"])
        one = F.array(F.struct(start.cast("long").alias("start"), F.lit(order).alias("order"), end.cast("long").alias("end"), F.lit(rule.kind).alias("kind")))
        return F.struct(end.cast("long").alias("at"), F.when(F.char_length(x["value"]) >= rule.least, F.concat(state["found"], one)).otherwise(state["found"]).alias("found"))

    return F.aggregate(steps, begin, step, lambda s: s["found"])


def _matches(text: Column, rule: Rule) -> Column:
    hinted = F.contains(text, F.lit(rule.hint)) if rule.hint else F.lit(True)
    return hinted & text.rlike(rule.pattern)


def read_ledger(spark: SparkSession, ledger: str | None) -> DataFrame:
    return spark.read.schema(LEDGER).parquet(ledger) if ledger else spark.createDataFrame([], LEDGER)


def scan(paths: DataFrame, *, path_col: str, text_col: str, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, str]:
    """Scan what the ledger at ``ledger`` lacks, append to it (or begin one in the shared
    folder), and return (``path, blob, found`` with findings of all rules by place, the
    ledger's folder)."""
    spark = paths.sparkSession
    rows = paths.select(F.col(path_col).alias("path"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("blob", F.sha2("text", 256))
    one = rows.groupBy("blob").agg(F.min(F.struct(F.col("path").isNull().alias("n"), "path")).alias("first"))
    texts = rows.join(one.select(F.col("blob").alias("b"), F.col("first.path").alias("p")), (F.col("blob") == F.col("b")) & F.col("path").eqNullSafe(F.col("p")), "left_semi")
    old = read_ledger(spark, ledger)
    done = old.groupBy("blob").agg(F.collect_set(F.concat_ws(":", "rule", "version")).alias("done"))
    todo = (texts.join(done, "blob", "left") if ledger else texts.withColumn("done", F.lit(None).cast("array<string>"))).select("blob", "text", F.coalesce("done", F.array().cast("array<string>")).alias("done"))
    results = F.array(*[
        F.struct(
            F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"),
            F.when(F.array_contains("done", f"{r.kind}:{r.version}"), F.lit(None).cast(T.ArrayType(FINDING)))
            .when(_matches(F.col("text"), r), findings(F.col("text"), r, i)).otherwise(F.array().cast(T.ArrayType(FINDING))).alias("found"),
        )
        for i, r in enumerate(rules)
    ])
    fresh = todo.select("blob", F.explode(results).alias("r")).where("r.found is not null").select("blob", "r.rule", "r.version", "r.found").distinct()
    ledger = ledger or shared_dir(spark, "blob-ledger")
    fresh.write.mode("append").parquet(ledger)
    current = F.array(*[F.lit(f"{r.kind}:{r.version}") for r in rules])
    known = read_ledger(spark, ledger).where(F.array_contains(current, F.concat_ws(":", "rule", "version")) & (F.size("found") > 0))
    merged = known.distinct().groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("found"))).alias("found"))
    out = rows.select("path", "blob").join(merged, "blob", "left")
    return out.select("path", "blob", F.coalesce("found", F.array().cast(T.ArrayType(FINDING))).alias("found")), ledger


def report(found: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans``."""
    text = lambda fs: F.array_join(F.transform(fs, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")
    base = F.filter("found", lambda f: f["kind"].isin(*[r.kind for r in RULES]))
    count = lambda kind: F.size(F.filter("found", lambda f: f["kind"] == kind)).cast("long")
    return found.select(
        F.col("path").alias("doc_id"), *[count(r.kind).alias(f"n_{r.kind}") for r in RULES],
        F.sha2(text(base), 256).alias("base_sha256"), text(F.col("found")).alias("spans"),
    )
