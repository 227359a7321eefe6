"""Secret scans over an incremental blob ledger.

A blob is a text named by its SHA-256.  The ledger has one row for each (blob,
rule, rule version) that has been scanned; a run scans only pairs that the
ledger lacks, and findings, kept by blob, are joined back to every path (row)
that holds the blob.  DataFrame functions only.

Positions come without Python: ``split`` and ``regexp_extract_all`` walk the
same matches, so the lengths of pieces and matches, summed in order, give each
match's place in code points.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_hot, materialize

# Keyword, separator and value patterns of the scan contract; letters of keywords in either case.
ASSIGN_KEYS = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = f"({ASSIGN_KEYS})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"


@dataclass(frozen=True)
class Rule:
    """A pattern; a match counts if group ``group`` has ``least`` characters.  ``version`` changes when the pattern does."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1


BASE = (Rule("assign", ASSIGN, 2, 8), Rule("access", "AKIA[A-Z0-9]+", 0, 16), Rule("hex", "[0-9a-f]+", 0, 32))
#: Publicly documented token shapes beyond the base kinds.
#: Repeats before a literal are bounded, so a scan takes time in proportion to the text.
MORE = (
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,1000}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", version=2),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", version=2),
)
RULES = BASE + MORE


def blobs(docs: DataFrame, text_col: str) -> DataFrame:
    """``blob, text``: every distinct text once (a null text is empty)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.sha2(text.cast("binary"), 256).alias("blob"), text.alias("text"))


def _lengths(rule: Rule):
    """Arrays of the lengths of matches, of the pieces before them and of whether they count; null where nothing can match."""
    text, pattern = F.col("text"), F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, 0)
    sizes = F.transform(found, lambda m: F.struct(F.length(m).alias("size"), (F.length(F.regexp_extract(m, rule.pattern, rule.group) if rule.group else m) >= rule.least).alias("ok")))
    return F.struct(F.lit(rule.kind).alias("rule"), F.lit(rule.version).alias("version"), sizes.alias("found"), F.transform(F.split(text, rule.pattern, -1), lambda p: F.length(p)).alias("gaps"))


def _may_match(rule: Rule):
    probe = {"hex": "[0-9a-f]{32}", "access": "AKIA[A-Z0-9]{12}"}.get(rule.kind, rule.pattern)
    return F.col("text").rlike(probe)


def scan(unseen: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``blob, rule, version, start, stop``: counting matches (leftmost, non-overlapping for each rule) in the blobs of ``unseen``.

    ``unseen`` has ``blob, text, missing``; a rule runs on a blob only if ``missing``, an array of ``(rule, version)``, names it.
    """
    wanted = lambda r: F.exists("missing", lambda m: (m["rule"] == r.kind) & (m["version"] == r.version))
    tasks = F.filter(F.array(*(F.when(wanted(r) & _may_match(r), _lengths(r)) for r in rules)), lambda x: x.isNotNull())
    hit = unseen.select("blob", F.explode(tasks).alias("r"))
    each = hit.select("blob", "r.rule", "r.version", F.posexplode(F.arrays_zip(F.col("r.found").alias("m"), F.slice(F.col("r.gaps"), F.lit(1), F.size("r.found")).alias("gap"))).alias("i", "x"))
    flat = each.select("blob", "rule", "version", "i", F.col("x.m.size").alias("size"), F.col("x.m.ok").alias("ok"), F.col("x.gap").alias("gap"))
    upto = Window.partitionBy("blob", "rule", "version").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("gap") + F.col("size")).over(upto)
    return flat.withColumn("stop", stop).where("ok").select("blob", "rule", "version", (F.col("stop") - F.col("size")).alias("start"), "stop")


def update_ledger(docs: DataFrame, seen: DataFrame | None = None, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """Scan what the ledger ``seen`` (``blob, rule, version``) lacks, and nothing else.

    Returns the new ledger rows and the new findings, to be appended to the
    stored tables.  A pair's row appears whether or not anything was found.
    Copies of a blob are dropped before the shuffle, which moves each text once for each map task at most.
    """
    history = blobs(docs, text_col)
    names = F.array(*(F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version")) for r in rules))
    once = history.groupBy("blob").agg(F.first("text").alias("text"))
    pairs = history.select("blob").distinct().select("blob", F.inline(names))
    if seen is None:
        return pairs, materialize(scan(once.withColumn("missing", names), rules), "findings")
    new = materialize(pairs.join(seen.select("blob", "rule", "version").distinct(), ["blob", "rule", "version"], "left_anti"), "ledger")
    missing = new.groupBy("blob").agg(F.collect_list(F.struct("rule", "version")).alias("missing"))  # one entry for each rule at most
    return new, materialize(scan(once.join(missing, "blob"), rules), "findings")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", findings: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings joined back to all rows: ``doc_id, blob`` and the span columns.

    ``findings`` are those stored for the rows' blobs; without them the rows are
    scanned as new.  Spans are ``kind:start:end`` in code points, end exclusive,
    by start and then by the order of the rules; ``base_sha256`` is over those of
    the base kinds.  A null or empty text has none; repeated rows and null ids
    keep a row each; other columns are not read, whatever their names; a very long
    text is scanned whole, in time in proportion to its length; an empty table gives no rows.
    """
    if findings is None:
        findings = update_ledger(docs, None, text_col, rules)[1]
    rank = F.element_at(F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i)))), F.col("rule"))
    item = F.struct(F.col("start").cast("long").alias("start"), rank.alias("rank"), F.concat_ws(":", "rule", F.col("start").cast("string"), F.col("stop").cast("string")).alias("span"))
    by_blob = findings.groupBy("blob").agg(F.sort_array(F.collect_list(item)).alias("items"))
    rows = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256).alias("blob")), "paths")
    # A blob may have a third of all paths: they are dealt out.
    paths = rows.groupBy("blob").agg(F.count("*").alias("n"))
    joined = join_hot(rows, by_blob.join(paths, "blob"), "blob", F.xxhash64("doc_id"), rows.count(), "left")
    items = F.coalesce("items", F.array().cast("array<struct<start:bigint,rank:int,span:string>>"))
    spans = lambda keep: F.array_join(F.transform(F.filter(items, keep) if keep else items, lambda x: x["span"]), ",")
    count = lambda k: F.size(F.filter(items, lambda x: x["rank"] == k)).cast("long")
    base = spans(lambda x: x["rank"] < len(BASE))
    return joined.select("doc_id", "blob", *(count(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE)), F.sha2(base.cast("binary"), 256).alias("base_sha256"), spans(None).alias("spans"))


def op1(spark, sf_dir: str) -> DataFrame:
    """``find_secrets`` over all documents as new blobs."""
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("blob")
