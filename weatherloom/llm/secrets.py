"""Secret scans with a ledger of contents already scanned.

Every version of every path is addressed by the SHA-256 of its text. The ledger, a Parquet folder
that only grows, holds for each content the rules (with their versions) that have been applied to
it and what they found. A scan looks at each content once, and at those rules alone that the ledger
does not have for it; findings are then joined back to all paths and versions of the content.
"""

import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rows import free_name
from ..plans.sizing import written


class Rule(NamedTuple):
    """A pattern, the group whose length counts, its least length, and what a text must hold."""

    kind: str
    version: int
    pattern: re.Pattern
    group: int
    least: int
    hints: tuple[str, ...] = ()

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The base rules, in the order in which equal starts are listed, then our own.
RULES = (
    Rule(
        "assign",
        1,
        re.compile(
            r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
            re.IGNORECASE | re.ASCII,
        ),
        2,
        6,
        ("passw", "secret", "token", "key"),
    ),
    Rule("access", 1, re.compile(r"AKIA[A-Z0-9]+"), 0, 20, ("akia",)),
    Rule("hex", 1, re.compile(r"[0-9a-f]+"), 0, 24),
    Rule("pem", 1, re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"), 0, 1, ("private key",)),
    Rule("github", 1, re.compile(r"gh[pousr]_[A-Za-z0-9]+"), 0, 40, ("gh",)),
)

FOUND = "array<struct<kind: string, start: int, end: int>>"
_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
LEDGER_SCHEMA = f"blob string, rules array<string>, found {FOUND}"
# Long runs alone can pass the hex rule; this finds whether there is one.
_HEX_RUN = re.compile(r"[0-9a-f]{24}")


def find_secrets(text: str, rules) -> list[dict]:
    """Spans of all matches, leftmost and without overlap per kind, in code points."""
    lowered, found = text.lower(), []
    for rule in rules:
        if rule.hints and not any(hint in lowered for hint in rule.hints):
            continue
        if rule.kind == "hex" and not _HEX_RUN.search(text):
            continue
        for match in rule.pattern.finditer(text):
            if len(match[rule.group]) >= rule.least:
                found.append({"kind": rule.kind, "start": match.start(), "end": match.end()})
    return found


def _scan_udf(rules):
    by_key = {rule.key: rule for rule in rules}

    @F.arrow_udf(FOUND)
    def scan(texts: pa.Array, keys: pa.Array) -> pa.Array:
        found = (
            find_secrets(text.as_py(), [by_key[k] for k in wanted])
            for text, wanted in zip(texts, keys.to_pylist())
        )
        return pa.array(found, _FOUND)

    return scan


def address(text) -> F.Column:
    """The address of a content. A missing text is an empty one."""
    return F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256)


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """(blob, rules, found) of all scans so far; empty before the first one."""
    try:
        return spark.read.schema(LEDGER_SCHEMA).parquet(ledger)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER_SCHEMA)


def update_ledger(versions: DataFrame, ledger: str, rules=RULES) -> DataFrame:
    """Scan what the ledger does not know yet, and append it.

    Returns the addressed versions (path, blob), with one row for each of the given ones, written to
    scratch. `versions` needs `path` and `text`. The text of one path per content is looked at, so
    contents are moved once, in rows of their own, and no group of copies is ever gathered. A missing
    text is an empty content, a missing path a path like any other; repeated rows stay, an empty table
    adds nothing, and other columns are not looked at.
    """
    spark = versions.sparkSession
    texts = versions.select("path", address("text").alias("blob"), "text")
    addressed = written(texts.select("path", "blob"), "addressed-versions")
    known = (
        read_ledger(spark, ledger)
        .groupBy("blob")
        .agg(F.flatten(F.collect_set("rules")).alias("known"))
    )
    wanted = F.array(*[F.lit(rule.key) for rule in rules])
    unseen = (
        addressed.groupBy("blob")
        .agg(F.min("path").alias("path"))
        .join(known, "blob", "left")
        .select(
            "blob",
            F.col("path").alias("first_path"),
            F.array_except(wanted, F.coalesce("known", F.array().cast("array<string>"))).alias(
                "rules"
            ),
        )
        .where(F.size("rules") > 0)
    )
    todo = texts.join(
        unseen.hint("shuffle_hash"),
        (texts["blob"] == unseen["blob"]) & texts["path"].eqNullSafe(unseen["first_path"]),
    ).select(unseen["blob"], "rules", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    scanned = todo.select("blob", "rules", _scan_udf(rules)("text", "rules").alias("found"))
    scanned.write.mode("append").parquet(ledger)
    return addressed


def _span(f):
    return F.struct(f["kind"].alias("kind"), f["start"].alias("start"), f["end"].alias("end"))


def findings(addressed: DataFrame, ledger: str, rules=RULES) -> DataFrame:
    """(path, blob, found) for every addressed version; `found` in order of start, then rule.

    Only findings of the given rules and versions count. A content that repeated rows had scanned
    twice gives its findings once.
    """
    spark = addressed.sparkSession
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    wanted = F.array(*[F.lit(rule.key) for rule in rules])
    rows = read_ledger(spark, ledger).where(F.arrays_overlap("rules", wanted))
    # A version of a rule that is no longer wanted may stand beside a wanted one in a row.
    kinds = F.transform(
        F.array_intersect("rules", wanted), lambda key: F.substring_index(key, "@", 1)
    )
    found = rows.select(
        "blob",
        F.filter("found", lambda f: F.array_contains(kinds, f["kind"])).alias("found"),
    ).where(F.size("found") > 0)
    merged = found.groupBy("blob").agg(
        F.array_sort(
            F.transform(
                F.array_distinct(F.flatten(F.collect_list("found"))),
                lambda f: F.struct(
                    f["start"].alias("start"),
                    order[f["kind"]].alias("rank"),
                    f["kind"].alias("kind"),
                    f["end"].alias("end"),
                ),
            )
        ).alias("found")
    )
    # A content that a third of all paths share is split by Spark's adaptive skew join: the side of
    # the paths has a few bytes per row, the other side one row per content with findings.
    return addressed.join(merged, "blob", "left").select(
        "path",
        "blob",
        F.coalesce(F.transform("found", _span), F.array().cast(FOUND)).alias("found"),
    )


def redact(documents: DataFrame, found: DataFrame, mark: str = "[secret]") -> DataFrame:
    """`documents` with every found span of `text` replaced by `mark`, and n_chars counted anew.

    `found` is a result of `findings`. Rows are joined by content, so ids play no part. Overlapping
    spans are one. A missing text stays missing; an empty table or one without findings is returned
    as it is, and repeated rows stay.
    """
    blob, own_spans = free_name(documents, "own_blob"), free_name(documents, "own_spans")
    spans = (
        found.where(F.size("found") > 0)
        .select(F.col("blob").alias(blob), F.col("found").alias(own_spans))
        .dropDuplicates([blob])
    )
    own = documents.withColumn(blob, address("text"))
    joined = own.join(written(spans, "secret-spans"), blob, "left")
    spans_or_none = F.coalesce(own_spans, F.array().cast(FOUND))
    redacted = _redact_udf(mark)(F.coalesce("text", F.lit("")), spans_or_none)
    text = F.when(F.col(own_spans).isNull(), F.col("text")).otherwise(redacted)
    joined = joined.withColumn("text", text)
    if "n_chars" in documents.columns:
        length = F.length("text").cast(documents.schema["n_chars"].dataType)
        joined = joined.withColumn(
            "n_chars", F.when(F.col(own_spans).isNull(), F.col("n_chars")).otherwise(length)
        )
    return joined.select(*documents.columns)


def _redact_udf(mark: str):
    @F.arrow_udf("string")
    def redacted(texts: pa.Array, spans: pa.Array) -> pa.Array:
        result = []
        for text, found in zip(texts, spans.to_pylist()):
            text, pieces, at = text.as_py(), [], 0
            for span in found:
                if span["start"] >= at:
                    pieces += [text[at : span["start"]], mark]
                at = max(at, span["end"])
            result.append("".join([*pieces, text[at:]]))
        return pa.array(result, pa.string())

    return redacted
