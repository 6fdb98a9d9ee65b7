"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every version of a text is a blob named by its SHA-256, and the ledger knows which blobs were scanned under which rule
version. A scan looks at unseen pairs of blob and rule version alone, each once however many paths hold it; findings are kept
by blob and joined back to all paths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gossamer.checkpoints import fresh_path, written
from gossamer.llm.common import quoted, table


@dataclass(frozen=True)
class Rule:
    """A pattern for Java's engine; ``group`` has at least ``least`` characters in a match that counts, others are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    #: Change it with the pattern: blobs are scanned again for the new version.
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


BASE = (
    Rule("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{32,}", 0, 32),
)
#: Formats that issuers publish, beside the base.
FURTHER = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", r"\bgh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"\bxox[abposr]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + FURTHER

#: A row for each scan of a blob: the rule versions it was scanned under, and what they found (code points from 0, end exclusive).
LEDGER = "blob string, rules array<string>, hits array<struct<rule:string,start:bigint,end:bigint>>"


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _hits(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, rule, at, gap, size, checked) of every match: characters since the match before, in it, and in its group."""
    # Matches alone have no place, but what ``split`` leaves between them has the lengths that lead to it.
    parts = []
    for r in rules:
        found = F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))
        lengths = lambda a: F.transform(a, F.length)
        group = lengths(F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group))) if r.group else lengths(found)
        todo = F.array_contains("rules", r.name) & F.col("text").rlike(r.pattern)
        whole = F.arrays_zip(
            lengths(F.slice(F.split("text", r.pattern, -1), F.lit(1), F.size(found))).alias("gap"), lengths(found).alias("size"), group.alias("checked")
        )
        parts.append(F.when(todo, F.struct(F.lit(r.name).alias("rule"), whole.alias("hits"))))
    by_rule = blobs.select("blob", F.explode(F.array_compact(F.array(*parts))).alias("r"))
    return by_rule.select("blob", F.col("r.rule").alias("rule"), F.posexplode("r.hits").alias("at", "h")).select("blob", "rule", "at", "h.gap", "h.size", "h.checked")


def ledger_at(spark: SparkSession, path: str) -> DataFrame:
    """The ledger kept at ``path``; without rows where there is none yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(LEDGER)])
    return spark.read.schema(LEDGER).parquet(path)


def scan(paths: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan all versions in ``paths`` (text) under ``rules``, keep the outcome in the ledger at path ``ledger`` and return the whole ledger.

    Only pairs of blob and rule version that the ledger does not have are scanned, each blob once however many rows hold it, and a blob and
    its findings enter the ledger in one row, so that a scan that fails leaves out both. Texts are moved only to meet unseen blobs.
    Findings are leftmost and non-overlapping for each rule. A null text is the empty blob.
    """
    spark = paths.sparkSession
    text = F.col("text").cast("string")
    names, none = F.array(*[F.lit(r.name) for r in rules]), F.array().cast("array<string>")
    blobs = paths.select(blob_of(text).alias("blob"), F.coalesce(text, F.lit("")).alias("text"))
    seen = ledger_at(spark, ledger).select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    todo = blobs.select("blob").distinct().join(seen, "blob", "left").select("blob", F.array_except(names, F.coalesce("seen", none)).alias("rules"))
    todo = written(todo.where(F.size("rules") > 0), "unseen-blobs")
    # One row a blob; copies of a text meet in the partial aggregation of each input partition first.
    unseen = blobs.groupBy("blob").agg(F.first("text").alias("text")).join(todo, "blob") if seen.isEmpty() else blobs.join(todo, "blob").groupBy("blob").agg(F.first("text").alias("text"), F.first("rules").alias("rules"))
    order = Window.partitionBy("blob", "rule").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    after = F.sum(F.col("gap") + F.col("size")).over(order).cast("long")
    least = F.create_map(*[x for r in rules for x in (F.lit(r.name), F.lit(r.least))])
    placed = _hits(unseen, rules).withColumn("end", after).where(F.col("checked") >= least[F.col("rule")])
    found = placed.groupBy("blob").agg(F.collect_list(F.struct("rule", (F.col("end") - F.col("size")).alias("start"), "end")).alias("hits"))
    empty = F.array().cast("array<struct<rule:string,start:bigint,end:bigint>>")
    todo.join(found, "blob", "left").select("blob", "rules", F.coalesce("hits", empty).alias("hits")).write.mode("append").parquet(ledger)
    return ledger_at(spark, ledger)


def findings_of(ledger: DataFrame) -> DataFrame:
    """(blob, rule, start, end) of every finding in a ledger."""
    return ledger.select("blob", F.explode("hits").alias("hit")).select("blob", "hit.*")


def by_blob(findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, marks): the findings of a blob under these rules as an array of (start, place of the rule, end, kind), sorted."""
    place = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.name), F.lit(i))])
    kind = F.create_map(*[x for r in rules for x in (F.lit(r.name), F.lit(r.kind))])
    mine = findings.withColumn("place", place[F.col("rule")]).where("place is not null")
    return mine.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "place", "end", kind[F.col("rule")].alias("kind")))).alias("marks"))


def joined(marks: Column) -> Column:
    return F.concat_ws(",", F.transform(marks, lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["end"].cast("string"))))


def find_secrets(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, blob, marks) for every row of docs; ``marks`` is empty, not null, where nothing was found.

    ``ledger`` is the path of a ledger to go on with; without one a new ledger begins in the shared folder. A null text counts as
    empty; repeated rows get equal results; further columns are not looked at; an empty table gives no rows.
    """
    path = ledger or fresh_path(docs.sparkSession, "secret-ledger")
    found = findings_of(scan(docs.select("text"), path, rules))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), blob_of(F.col("text").cast("string")).alias("blob"))
    none = F.array().cast("array<struct<start:bigint,place:int,end:bigint,kind:string>>")
    # Written first, so that the join deals both sides anew and a blob with very many paths can be split.
    return own.join(written(by_blob(found, rules), "findings"), "blob", "left").select("doc_id", "blob", F.coalesce("marks", none).alias("marks"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of every text. The query begins a ledger of its own, so that it scans every blob whenever it runs; edge cases as in
    ``find_secrets``."""
    found = find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("marks", lambda m: m["place"] < len(BASE))
    count = lambda k: F.size(F.filter("marks", lambda m: m["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("marks")).alias("spans"),
    )


def redact(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES, mask: str = "[REDACTED]") -> DataFrame:
    """docs with every finding, overlapping ones as one, replaced by the mask; all columns and rows stay, whatever they are called, null
    texts too.

    ``ledger`` as in ``find_secrets``. Blobs without findings are not looked at again. The mask itself is no secret, so a second run changes
    nothing. Repeated rows get equal texts; an empty table gives no rows.
    """
    path = ledger or fresh_path(docs.sparkSession, "secret-ledger")
    scan(docs.select("text"), path, rules)
    mine = [r.name for r in rules]
    found = findings_of(ledger_at(docs.sparkSession, path)).where(F.col("rule").isin(mine))
    reach = Window.partitionBy("blob").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.col("start") > F.max("end").over(reach), F.lit(True))
    run = F.sum(F.when(first, 1).otherwise(0)).over(Window.partitionBy("blob").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0))
    merged = found.withColumn("run", run).groupBy("blob", "run").agg(F.min("start").alias("a"), F.max("end").alias("b"))
    cuts = written(merged.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("cuts")), "cuts")
    # all columns of docs travel in one, where no name of theirs meets one from here
    own = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("own"), F.col("text").cast("string").alias("text"))
    marked = own.withColumn("blob", blob_of(F.col("text"))).join(cuts, "blob", "left")
    at = lambda i: F.element_at("cuts", i)
    pieces = F.transform(
        F.sequence(F.lit(1), F.size("cuts") + 1),
        lambda i: F.substring(
            "text",
            F.when(i == 1, 1).otherwise(at(F.greatest(i - 1, F.lit(1)))["b"] + 1).cast("int"),
            F.when(i > F.size("cuts"), F.lit(2**31 - 1)).otherwise(at(F.least(i, F.size("cuts")))["a"] - F.when(i == 1, 0).otherwise(at(F.greatest(i - 1, F.lit(1)))["b"])).cast("int"),
        ),
    )
    masked = F.when(F.col("cuts").isNull(), F.col("text")).otherwise(F.array_join(pieces, mask))
    return marked.select(*[masked.alias("text") if c == "text" else F.col("own").getField(c).alias(c) for c in docs.columns])


def _oracle() -> str:
    """The query in DuckDB SQL: the same places, from what lies between the matches."""
    parts = []
    for place, r in enumerate(RULES):
        pattern = r.pattern.replace("(?<![0-9a-f])", "").replace("'", "''")  # a run of 32 or more begins where the run does
        parts.append(
            f"SELECT doc_id, '{r.kind}' AS kind, {place} AS place, {r.least} AS least, regexp_extract_all(text, '{pattern}') AS ms, regexp_extract_all(text, '{pattern}', {r.group}) AS gs,"
            f" string_split_regex(text, '{pattern}') AS gaps FROM d WHERE regexp_matches(text, '{pattern}')"
        )
    ends = "list_sum(list_transform(gaps[1:i], lambda g: length(g))) + list_sum(list_transform(ms[1:i], lambda g: length(g)))"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), m AS ({" UNION ALL ".join(parts)}),
h AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m), s AS (SELECT doc_id, kind, place, CAST({ends} AS BIGINT) AS stop, length(ms[i]) AS size FROM h WHERE length(gs[i]) >= least),
a AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
 string_agg(kind || ':' || (stop - size) || ':' || stop, ',' ORDER BY stop - size, place, stop) FILTER (WHERE place < {len(BASE)}) AS base, string_agg(kind || ':' || (stop - size) || ':' || stop, ',' ORDER BY stop - size, place, stop) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a ON a.doc_id = d.doc_id"""


ORACLE = _oracle()
