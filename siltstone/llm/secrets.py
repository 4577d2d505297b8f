"""Secrets in every version of every path, through a ledger of blobs.

Each version's text is addressed by its SHA-256, the blob. The ledger is a folder of three tables: ``paths``
(path, version, blob of everything seen), ``scanned`` (blob and the rules, with their versions, that were run
on it) and ``findings`` (blob, rule, spans). A load hashes its texts, keeps one row of every blob for which
some rule version is not yet in ``scanned``, runs just the missing rules on it and joins the blob's findings
back to all paths that hold it. A text that was seen under another path or in an earlier load is not scanned
again; a rule whose version rises is run again on every blob of the load, and only that rule.

``findings`` is written before ``scanned``, so a load that fails in between is scanned again and its repeated
findings, which are equal, count once.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import tokens
from siltstone.session import path_exists


@dataclass(frozen=True)
class Rule:
    """A kind of secret: all leftmost non-overlapping matches whose ``group`` has ``least`` characters or more.

    ``hint`` is a text without which nothing matches. A changed rule needs a higher ``version``.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    version: int = 1
    hint: str = ""

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: The kinds in the order in which spans with the same start are listed. Fixed patterns of the first three.
RULES = (
    Rule("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, hint="AKIA"),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[^-]*(?:-----END (?:[A-Z]+ )*PRIVATE KEY-----)?", hint="PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hint="eyJ"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", hint="gh"),
    Rule("login", r"""[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\x00-\x20/:@"'<>]+:[^\x00-\x20/:@"'<>]+@[A-Za-z0-9.-]+""", hint="://"),
)

SPANS = "array<struct<kind:string,start:long,end:long>>"
#: Parts of a group of equal texts when findings are handed back to its paths.
SALTS = 16


def spans(text: str, rules: tuple[Rule, ...]) -> list[tuple[str, int, int]]:
    """All spans of one text, in code points, end exclusive."""
    out = []
    for rule in rules:
        if rule.hint in text:
            for m in re.finditer(rule.pattern, text):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    out.append((rule.kind, m.start(), m.end()))
    return out


def _scanner(rules: tuple[Rule, ...]):
    by_name = {r.name: r for r in rules}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in tokens.slices(batch, "text"):
                found = []
                for text, todo in zip(rows.column("text"), rows.column("todo").to_pylist()):
                    named = tuple(by_name[name] for name in todo)
                    found.append([dict(zip(("kind", "start", "end"), s)) for s in spans(text.as_py() or "", named)])
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([rows.column("blob"), rows.column("todo"), pa.array(found, kind)], ["blob", "todo", "spans"])

    return scan


class Ledger:
    """The tables of a ledger in a folder of the shared file system."""

    SCHEMAS = {
        "paths": "path string, version long, blob binary",
        "scanned": "blob binary, rules array<string>",
        "findings": f"blob binary, rules array<string>, spans {SPANS}",
    }

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        at = f"{self.folder}/{name}"
        empty = self.spark.createDataFrame([], self.SCHEMAS[name])
        if not path_exists(self.spark, at):
            return empty
        return self.spark.read.schema(empty.schema).parquet(at).select(empty.columns)

    def add(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.folder}/{name}")

    def unseen(self, versions: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
        """One row (path, version, blob, todo) of every blob of the load that some rule has not seen.

        Copies combine before the shuffle, so a text that a third of all rows hold is one row a task.
        """
        names = F.array(*(F.lit(r.name) for r in rules))
        blobs = versions.groupBy("blob").agg(F.min(F.struct("path", "version")).alias("at"))
        seen = self.table("scanned").groupBy(F.col("blob").alias("of")).agg(F.array_distinct(F.flatten(F.collect_set("rules"))).alias("rules"))
        todo = F.array_except(names, F.coalesce("rules", F.array().cast("array<string>")))
        return blobs.join(seen, F.col("blob") == F.col("of"), "left").select("at.path", "at.version", "blob", todo.alias("todo")).where(F.size("todo") > 0)

    def load(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Scan what is new of (path, version, text) rows; returns (path, version, blob, spans) of every row of the load.

        Null texts count as empty, null paths and versions are kept; rows that repeat are returned as often as
        given. ``spans`` are ordered by start, then by the order of the rules.
        """
        if len({r.kind for r in rules}) < len(rules):
            raise ValueError("two rules of one kind")
        rows = versions.select(
            F.col("path").cast("string").alias("path"),
            F.col("version").cast("long").alias("version"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        ).withColumn("blob", F.unhex(F.sha2("text", 256)))
        at = f"load={uuid.uuid4().hex}"
        rows.select("path", "version", "blob").write.parquet(f"{self.folder}/paths/{at}")
        now = self.spark.read.parquet(f"{self.folder}/paths/{at}")
        wanted = f"{self.folder}/wanted/{at}"
        self.unseen(now, rules).write.parquet(wanted)
        todo = self.spark.read.parquet(wanted).select(*(F.col(c).alias(f"w_{c}") for c in ("path", "version", "blob")), "todo")
        same = F.col("blob") == F.col("w_blob")
        for c in ("path", "version"):
            same = same & F.col(c).eqNullSafe(F.col(f"w_{c}"))
        found = rows.join(todo, same).select("blob", "text", "todo").mapInArrow(_scanner(rules), f"blob binary, todo array<string>, spans {SPANS}")
        self.add("findings", found.where(F.size("spans") > 0).select("blob", F.col("todo").alias("rules"), "spans"))
        self.add("scanned", todo.select(F.col("w_blob").alias("blob"), F.col("todo").alias("rules")))
        return self.joined(now, rules)

    def joined(self, paths: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """The findings of the given rules for (path, version, blob) rows, none where nothing is found.

        One row of spans a blob; the side of the findings is repeated for each part of the paths.
        """
        rank = F.create_map(*(F.lit(x) for k, r in enumerate(rules) for x in (r.kind, k)))
        versions = F.create_map(*(F.lit(x) for r in rules for x in (r.kind, r.name)))
        each = self.table("findings").select(F.col("blob").alias("of"), "rules", F.explode("spans").alias("s"))
        valid = each.where(F.array_contains("rules", F.try_element_at(versions, F.col("s.kind"))))
        keyed = F.struct(F.col("s.start").alias("start"), rank[F.col("s.kind")].alias("rank"), F.col("s.kind").alias("kind"), F.col("s.end").alias("end"))
        ordered = valid.groupBy("of").agg(F.sort_array(F.collect_set(keyed)).alias("all"))
        listed = F.transform("all", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
        by_blob = ordered.select("of", listed.alias("spans"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
        salted = paths.withColumn("salt", F.pmod(F.xxhash64("path", "version"), F.lit(SALTS)).cast("int"))
        met = salted.join(by_blob, (F.col("blob") == F.col("of")) & (F.col("salt") == F.col("part")), "left")
        return met.select("path", "version", "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))

    def history(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """The findings of every path and version that any load has seen, each once."""
        return self.joined(self.table("paths").distinct(), rules)


def joined_text(found: str | Column, kinds: list[str] | None = None) -> Column:
    """Spans as kind:start:end joined by commas, of some kinds or of all."""
    column = F.col(found) if isinstance(found, str) else found
    if kinds is not None:
        column = F.filter(column, lambda s: s["kind"].isin(kinds))
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
