"""Secret scans with an incremental blob ledger.

Every version of a text is addressed by the SHA-256 of its content. The ledger, a Parquet table in a
shared folder, records for each blob which rule versions have scanned it and what they found. An update
scans only pairs of blob and rule version that the ledger lacks, one representative text per blob,
appends to the ledger, and findings are joined back to all paths that hold the blob.

All work is done by SQL functions. A rule's matches are found by ``regexp_extract_all``; ``split`` by the
same rule gives the text between them, and a running sum of both lengths gives positions in code points.

Defined results: a null text is the empty text; rows repeated in full are versions with equal findings;
a null path is a path like any other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framespan.llm.common import cut, row_key, scratch


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds leftmost non-overlapping matches; those whose ``group`` is shorter than ``least`` are dropped."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}:{self.version}"


#: Fixed patterns of the contract, in the order in which kinds are listed. A run shorter than the least length
#: holds no longer match inside it, so the length is part of the pattern where the match is one run.
BASE_RULES = [
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", 1, r"[0-9a-f]{32,}"),
]
MORE_RULES = [
    Rule("private_key", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge_token", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
]
RULES = BASE_RULES + MORE_RULES

_LEDGER = "blob binary, rules array<string>, findings array<struct<start:int,kind:int,end:int,name:string>>"


def _pieces(text: Column, rule: Rule, number: int) -> Column:
    """One struct per match: its number in the text, and the lengths before it, of it and of its group."""
    pattern = F.lit(rule.pattern)
    between = F.split(text, rule.pattern, -1)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    group = whole if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    zipped = F.arrays_zip(F.slice(between, F.lit(1), F.size(whole)).alias("b"), whole.alias("w"), group.alias("g"))
    return F.transform(
        zipped,
        lambda x, i: F.struct(F.lit(number).alias("kind"), i.alias("nth"), F.length(x["b"]).alias("before"), F.length(x["w"]).alias("whole"), F.length(x["g"]).alias("inner")),
    )


class BlobLedger:
    """The ledger at ``path`` (a folder that all executors reach)."""

    def __init__(self, spark: SparkSession, path: str, rules: list[Rule] = RULES):
        self.spark, self.path, self.rules = spark, path, rules

    def read(self) -> DataFrame:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], _LEDGER)
        return self.spark.read.schema(_LEDGER).parquet(self.path)

    def address(self, versions: DataFrame, path_col: str, text_col: str) -> DataFrame:
        """(path, text, blob, _k0, _k1) of each version."""
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        return versions.select(F.col(path_col).alias("path"), text.alias("text")).select("*", F.unhex(F.sha2("text", 256)).alias("blob"), *row_key(F.col("path"), F.col("text")))

    def update(self, versions: DataFrame, path_col: str, text_col: str) -> DataFrame:
        """Scan what is unseen and return (path, blob) of all versions."""
        addressed = self.address(versions, path_col, text_col)
        paths = cut(addressed.select("path", "blob", "_k0", "_k1"))
        one = paths.groupBy("blob").agg(F.min(F.struct("_k0", "_k1")).alias("_w")).select("blob", "_w.*")
        done = self.read().groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("_done"))
        wanted = F.array(*[F.lit(r.key) for r in self.rules])
        missing = F.array_except(wanted, F.coalesce("_done", F.array().cast("array<string>")))
        todo = cut(one.join(done, "blob", "left").select("blob", "_k0", "_k1", missing.alias("_todo")).where(F.size("_todo") > 0))
        unseen = addressed.select("text", "_k0", "_k1").join(todo.hint("shuffle_hash"), ["_k0", "_k1"])
        text = F.col("text")
        found = [
            F.when(F.array_contains("_todo", r.key) & text.rlike(r.pattern), _pieces(text, r, k)).otherwise(F.array()) for k, r in enumerate(self.rules)
        ]
        rows = unseen.select("blob", F.inline(F.concat(*found))).distinct()
        before = Window.partitionBy("blob", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
        end = F.sum(F.col("before") + F.col("whole")).over(before).cast("int")
        least = F.element_at(F.array(*[F.lit(r.least) for r in self.rules]), F.col("kind") + 1)
        name = F.element_at(F.array(*[F.lit(r.kind) for r in self.rules]), F.col("kind") + 1)
        spans = rows.select("blob", "kind", "inner", "whole", end.alias("end")).where(F.col("inner") >= least)
        spans = spans.select("blob", F.struct((F.col("end") - F.col("whole")).alias("start"), "kind", "end", name.alias("name")).alias("f"))
        per_blob = spans.groupBy("blob").agg(F.sort_array(F.collect_list("f")).alias("findings"))
        nothing = F.array().cast("array<struct<start:int,kind:int,end:int,name:string>>")
        new = todo.join(per_blob, "blob", "left").select("blob", F.col("_todo").alias("rules"), F.coalesce("findings", nothing).alias("findings"))
        new.write.mode("append").parquet(self.path)
        return paths.select("path", "blob")

    def findings(self, paths: DataFrame) -> DataFrame:
        """(path, blob, findings) of all versions, by the current version of each rule."""
        current = F.array(*[F.lit(r.key) for r in self.rules])
        names = F.array(*[F.lit(r.kind) for r in self.rules])
        kept = F.transform(
            F.filter("findings", lambda f: F.exists(F.array_intersect("rules", current), lambda k: F.split_part(k, F.lit(":"), F.lit(1)) == f["name"])),
            lambda f: F.struct(f["start"].alias("start"), F.array_position(names, f["name"]).cast("int").alias("kind"), f["end"].alias("end"), f["name"].alias("name")),
        )
        per_blob = self.read().where(F.size("findings") > 0).select("blob", kept.alias("f")).where(F.size("f") > 0)
        per_blob = per_blob.groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list("f"))).alias("findings"))
        return paths.join(per_blob, "blob", "left").select("path", "blob", F.coalesce("findings", F.array().cast("array<struct<start:int,kind:int,end:int,name:string>>")).alias("findings"))


def scan(versions: DataFrame, path_col: str = "doc_id", text_col: str = "text", ledger: BlobLedger | None = None) -> DataFrame:
    """(path, blob, findings) for each version; ``ledger`` None means a new, empty one."""
    ledger = ledger or BlobLedger(versions.sparkSession, scratch(versions.sparkSession, "ledger"))
    return ledger.findings(ledger.update(versions, path_col, text_col))


def report(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of the base spans and all spans as text."""
    base = [r.kind for r in BASE_RULES]

    def text(items: Column) -> Column:
        return F.array_join(F.transform(items, lambda f: F.concat_ws(":", f["name"], f["start"], f["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("findings", lambda f: f["name"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("path", *[count(kind) for kind in base], F.sha2(text(F.filter("findings", lambda f: f["name"].isin(base))), 256).alias("base_sha256"), text(F.col("findings")).alias("spans"))


def report_sql(rules: list[Rule] = RULES, base: int = len(BASE_RULES)) -> str:
    """The same report in DuckDB SQL, from the same patterns."""
    def quoted(p: str) -> str:
        return "'" + p.replace("'", "''") + "'"

    parts = " UNION ALL ".join(
        f"SELECT doc_id, {k} AS kind, '{r.kind}' AS name, {r.least} AS least, string_split_regex(t, {quoted(r.pattern)}) AS b, "
        f"regexp_extract_all(t, {quoted(r.pattern)}) AS w, regexp_extract_all(t, {quoted(r.pattern)}, {r.group}) AS g FROM d"
        for k, r in enumerate(rules)
    )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, kind, name, least, unnest(generate_series(1, len(w))) AS i, b, w, g FROM ({parts}) WHERE len(w) > 0),
l AS (SELECT doc_id, kind, name, least, i, length(b[i]) + length(w[i]) AS step, length(w[i]) AS n, length(g[i]) AS inner_n FROM m),
s AS (SELECT *, CAST(sum(step) OVER (PARTITION BY doc_id, kind ORDER BY i) AS BIGINT) AS e FROM l),
f AS (SELECT doc_id, kind, name, e - n AS a, e, name || ':' || (e - n) || ':' || e AS txt FROM s WHERE inner_n >= least),
r AS (SELECT doc_id, count(*) FILTER (WHERE name = 'assign') AS n_assign, count(*) FILTER (WHERE name = 'access') AS n_access, count(*) FILTER (WHERE name = 'hex') AS n_hex,
        string_agg(txt, ',' ORDER BY a, kind) FILTER (WHERE kind < {base}) AS basic, string_agg(txt, ',' ORDER BY a, kind) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(basic, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN r ON d.doc_id = r.doc_id"""
