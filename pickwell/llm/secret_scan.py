"""Secret scans over an incremental ledger of content-addressed blobs, in DataFrame functions only.

A blob is a text, addressed by its SHA-256; every historical version of a path is one. The ledger is a
Parquet folder with a row for each scanned pair of blob and rule version, findings inside.
A scan reads the texts of unseen pairs only and appends to the ledger; findings are joined
back to all paths that hold the blob.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pickwell.llm.common import SMALL_ROWS, texts_of
from pickwell.sources.files import exists


class Rule(NamedTuple):
    """``pattern`` has two groups, a head and a value, which together are the whole match.
    Matches are leftmost and do not overlap; those with a value under ``least`` are dropped."""

    kind: str
    pattern: str
    least: int


# Runs are greedy, so asking a run for its least length inside the pattern finds the same matches as
# dropping short ones later wherever no shorter match can hide a longer one: true for
# access and hex, not for assign.
RULES = (
    Rule("assign", r"""(?i)((?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 8),
    Rule("access", r"()(AKIA[A-Z0-9]{12,})", 16),
    Rule("hex", r"()([0-9a-f]{32,})", 32),
)

LEDGER = "blob string, rule_version string, findings array<struct<start:int,kind:string,rank:int,stop:int>>"
_OPEN, _MID, _CLOSE, _OTHER = "\u0001", "\u0002", "\u0003", "\u0004"


def version_of(rules: tuple[Rule, ...]) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def blob_of(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def matches(text: Column, rule: Rule, rank: int) -> Column:
    """Array of ``(start, kind, rank, stop)`` in code points, stop exclusive.

    Matches are marked by control characters (a text's own are first replaced by another, one for
    one, which no rule matches); lengths between marks give the places.
    """
    clean = F.translate(text, _OPEN + _MID + _CLOSE, _OTHER * 3)
    marked = F.regexp_replace(clean, F.lit(rule.pattern), F.lit(f"{_OPEN}$1{_MID}$2{_CLOSE}"))
    parts = F.split(marked, _OPEN)
    empty = F.array().cast("array<struct<start:int,kind:string,rank:int,stop:int>>")

    def step(acc: Column, part: Column) -> Column:
        middle, end = F.instr(part, _MID), F.instr(part, _CLOSE)
        stop = acc["at"] + end - 2
        hit = F.struct(
            acc["at"].alias("start"), F.lit(rule.kind).alias("kind"), F.lit(rank).alias("rank"), stop.alias("stop")
        )
        found = F.when(end - middle - 1 >= rule.least, F.concat(acc["found"], F.array(hit))).otherwise(acc["found"])
        return F.struct((acc["at"] + F.length(part) - 2).alias("at"), found.alias("found"))

    spans = F.aggregate(
        F.slice(parts, 2, F.size(parts)),
        F.struct(F.length(parts[0]).alias("at"), empty.alias("found")),
        step,
        lambda acc: acc["found"],
    )
    return F.when(F.regexp_like(text, F.lit(rule.pattern)), spans).otherwise(empty)


def scan_text(text: Column, rules: tuple[Rule, ...]) -> Column:
    """All findings of a text by start, then in the order of the rules."""
    found = F.concat(*(matches(text, rule, i) for i, rule in enumerate(rules)))
    return F.array_sort(found, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["rank"] - b["rank"]))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger as a frame; one that was never written is empty."""
    if exists(spark, path):
        return spark.read.schema(LEDGER).parquet(path)
    return spark.createDataFrame([], LEDGER)


def scan_unseen(
    docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Scan blobs that the ledger lacks for this rule version and append them.

    Unseen blobs are found on narrow rows (blob, one holder's id); only the holders' texts are
    then taken, so copies are scanned once and no copied blob makes a hot key. Null texts
    count as empty, null ids are ids like others, repeated rows count once. A ledger has one writer at
    a time and one row for a blob and rule version, so joins with it need no grouping.
    """
    version = version_of(rules)
    rows = texts_of(docs, id_col, text_col).withColumn("blob", blob_of(F.col("text")))
    seen = read_ledger(docs.sparkSession, ledger).where(F.col("rule_version") == version).select("blob").distinct()
    unseen = (
        rows.groupBy("blob").agg(F.min("doc_id").alias("holder"))
        .join(seen, "blob", "left_anti")
        .select(F.col("blob").alias("unseen"), "holder")
    )
    fresh = rows.join(
        unseen.hint("shuffle_hash"),
        (F.col("blob") == F.col("unseen")) & F.col("doc_id").eqNullSafe(F.col("holder")),
        "left_semi",
    )
    scanned = fresh.select("blob", F.lit(version).alias("rule_version"), scan_text(F.col("text"), rules).alias("findings"))
    scanned.dropDuplicates(["blob"]).write.mode("append").parquet(ledger)


def findings(
    docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, findings`` of every row, by its blob; null findings where the blob was not scanned."""
    known = read_ledger(docs.sparkSession, ledger).where(F.col("rule_version") == version_of(rules)).select("blob", "findings")
    rows = texts_of(docs, id_col, text_col).select("doc_id", blob_of(F.col("text")).alias("blob"))
    return rows.join(known, "blob", "left").select("doc_id", "findings")


def span_list(found: Column) -> Column:
    return F.array_join(
        F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ","
    )


def report(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts per kind, the spans and their digest."""
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long")
    spans = span_list(F.col("findings"))
    return found.select(
        "doc_id", *(count(r.kind).alias(f"n_{r.kind}") for r in rules),
        F.sha2(F.encode(spans, "UTF-8"), 256).alias("base_sha256"), spans.alias("spans"),
    )


def redacted(text: Column, found: Column, by: str) -> Column:
    """The text with ``by`` for each stretch that findings cover."""

    def step(acc: Column, hit: Column) -> Column:
        before = F.concat(acc["out"], F.substring(text, acc["at"] + 1, hit["start"] - acc["at"]), F.lit(by))
        return F.struct(
            F.greatest(acc["at"], hit["stop"]).alias("at"), F.when(hit["start"] >= acc["at"], before).otherwise(acc["out"]).alias("out")
        )

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(found, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def redact(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, by: str = "[secret]") -> DataFrame:
    """``docs`` with the findings of their texts replaced, and ``n_chars``, if there, to match; other columns as they are. Null texts
    stay null; rows that repeat an id are each redacted by their own text.

    Blobs with findings are few; up to a counted number they are broadcast, so that texts stay where they are.
    """
    known = read_ledger(docs.sparkSession, ledger).where((F.col("rule_version") == version_of(rules)) & (F.size("findings") > 0))
    known = known.select(F.col("blob").alias("_secret_blob"), F.col("findings").alias("_secret_found"))
    total = known.agg(F.sum(F.size("_secret_found"))).first()[0] or 0
    text = F.coalesce(docs["text"], F.lit(""))
    joined = docs.join(known if total > SMALL_ROWS else F.broadcast(known), blob_of(text) == known["_secret_blob"], "left")
    found = known["_secret_found"]
    new = F.when(found.isNull(), docs["text"]).otherwise(redacted(text, found, by))
    changed = {"text": new}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(found.isNull(), docs["n_chars"]).otherwise(F.length(new).cast("long"))
    return joined.select(*(changed.get(c, docs[c]).alias(c) for c in docs.columns))
