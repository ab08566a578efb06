"""Secret scans over an incremental, content-addressed blob ledger.

Every historical version of a file is addressed by the SHA-256 of its bytes. The
ledger holds one row per finding, and one row without span for a blob that a
rule version scanned without a finding, so a blob and rule-version pair that is
in the ledger is never scanned again. Findings are joined back to all paths and
versions that ever held the blob. Only DataFrame functions run.

Spans need positions, which Spark's regular expressions do not give: the pieces
between the matches and the matches themselves alternate, so running sums of
their lengths are the positions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written


@dataclass(frozen=True)
class Rule:
    """A pattern; matches are leftmost and do not overlap. A match is a finding
    if its ``group`` has ``least`` characters at least."""
    kind: str
    pattern: str
    least: int
    group: int = 0
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base rules, in their order.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
)


class BlobLedger:
    """Parquet table (blob binary, rule string, start int, end int) at a shared path.

    One append per scan makes it atomic: a run that dies before its append is
    scanned again, one that dies after it is not.
    """

    SCHEMA = "blob binary, rule string, start int, end int"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        spark.createDataFrame([], self.SCHEMA).write.mode("append").parquet(path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def append(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)


def _pattern(rule: Rule) -> str:
    """A run of one character class that must have a least length can say so in
    the pattern: the same findings, without one match per shorter run."""
    if rule.group == 0 and rule.pattern == "[0-9a-f]+":
        return f"[0-9a-f]{{{rule.least},}}"
    return rule.pattern


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """(blob, text, todo array of rule keys) -> (blob, rule, start, end).

    Positions are code points, the end exclusive. A pair without a finding gives
    one row without span. Each text is searched whole, once per rule.
    """
    cols = ["blob", "todo", "text"]
    for i, r in enumerate(rules):
        due = F.array_contains("todo", r.key)
        blobs = blobs.select(*cols, F.when(due, F.regexp_extract_all("text", F.lit(_pattern(r)), F.lit(0))).alias(f"m{i}"))
        cols.append(f"m{i}")
    found = []
    for i, r in enumerate(rules):
        groups = F.regexp_extract_all("text", F.lit(_pattern(r)), F.lit(r.group)) if r.group else F.col(f"m{i}")
        pieces = F.slice(F.split("text", _pattern(r), -1), F.lit(1), F.size(f"m{i}"))
        lens = F.transform(F.arrays_zip(pieces.alias("p"), F.col(f"m{i}").alias("m"), groups.alias("g")),
                           lambda x: F.struct(F.length(x["p"]).alias("p"), F.length(x["m"]).alias("m"),
                                              F.length(x["g"]).alias("g")))
        found.append(F.when(F.col(f"m{i}").isNotNull(), F.struct(
            F.lit(r.key).alias("rule"), F.lit(r.least).alias("least"),
            F.when(F.size(f"m{i}") > 0, lens).alias("lens"))))
    by_rule = (blobs.select("blob", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("x"))
               .select("blob", "x.rule", "x.least", F.posexplode_outer("x.lens").alias("pos", "n")))
    run = Window.partitionBy("blob", "rule").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = (F.sum("n.p").over(run) + F.sum("n.m").over(run)).cast("int")
    spans = by_rule.select("blob", "rule", "n", "least", end.alias("e"))
    real = F.col("n.g") >= F.col("least")
    return spans.select("blob", "rule", F.when(real, F.col("e") - F.col("n.m")).alias("start"),
                        F.when(real, F.col("e")).alias("end"))


def scan_versions(versions: DataFrame, ledger: BlobLedger, rules: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """Scan what the ledger has not seen; return the findings of all versions.

    ``versions``: columns path (any type), version, text; a null text counts as
    empty, other columns are ignored. Returns path, version, blob and findings,
    one row per input row (repeated rows too): findings is an array of
    struct(start, kind number, end, kind) by start, then by the rules' order;
    it is empty where nothing was found. Texts are reduced to one copy per blob
    with map-side combining before they are shuffled; a blob that a third of all
    paths hold is scanned once, and the join back to its paths can be split.
    """
    blob = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("blob")
    keys = F.array(*[F.lit(r.key) for r in rules])
    texts = versions.select(blob, F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["blob"])
    seen = (ledger.read().filter(F.col("rule").isin([r.key for r in rules]))
            .groupBy("blob").agg(F.collect_set("rule").alias("seen")))
    due = (texts.join(seen, "blob", "left")
           .withColumn("todo", F.array_except(keys, F.coalesce("seen", F.array().cast("array<string>"))))
           .filter(F.size("todo") > 0))
    ledger.append(scan_blobs(due.select("blob", "todo", "text"), rules))
    order = F.element_at(F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.key), F.lit(i))]),
                         F.col("rule"))
    kind = F.substring_index("rule", "@", 1)
    per_blob = (ledger.read().filter(F.col("start").isNotNull() & F.col("rule").isin([r.key for r in rules]))
                .distinct().groupBy("blob")
                .agg(F.array_sort(F.collect_list(F.struct("start", order.alias("no"), "end", kind.alias("kind"))))
                     .alias("findings")))
    none = F.array().cast("array<struct<start:int,no:int,end:int,kind:string>>")
    return (versions.select("path", "version", blob).join(written(per_blob), "blob", "left")
            .withColumn("findings", F.coalesce("findings", none)))
