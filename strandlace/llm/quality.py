"""Host-level quality rules.

Each document is measured and judged by every rule; failures are counted by host
and rule, each rule's rates are shrunk with a beta prior fitted to all hosts by
moments, and the host verdicts go back to the documents:

* a host whose shrunk rate of some rule is over ``reject_rate`` is rejected as a whole;
* a host whose shrunk rate of a rule is under ``trust`` times the prior's mean is trusted for this rule;
* a document that fails a rule goes, unless its host is trusted for it; failures of the base
  rules are final whatever the host.

DataFrame functions only.

Everything about a document is computed inside its row: five-word windows are
hashed in place, and only a text that has a window twice sorts them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, join_hot, materialize

WINDOW = 5

#: Rules over the measures; those of BASE are final, the others depend on the host.
RULES = {
    "short": "n_words < 10",
    "repeats": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "lines": "2 * n_dup_lines > n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 12 * n_words",
}
BASE = ("short", "repeats")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, keep: list[Column] | None = None) -> DataFrame:
    """The measures of each row: ``doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kept = keep or []
    rows = docs.select(F.col(id_col).cast("long").alias("_sl_id"), (host if host is not None else F.col("source")).cast("string").alias("_sl_host"), text.alias("_sl_text"), *kept)
    more = [f"`{c}`" for c in rows.columns[3:]]
    t = F.col("_sl_text")
    rows = rows.select("_sl_id", "_sl_host", *more, F.array_remove(F.split(t, f"[{SPACE}]+", -1), "").alias("_sl_words"), F.filter(F.split(t, "\n", -1), lambda line: line.rlike(f"[^{SPACE}]")).alias("_sl_lines"), (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).alias("_sl_symbols"))
    words, n = F.col("_sl_words"), F.size("_sl_words")
    gram = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW))))
    rows = rows.select(
        "_sl_id", "_sl_host", *more,
        n.cast("long").alias("_sl_n"),
        F.length(F.array_join(words, "")).cast("long").alias("_sl_chars"),
        F.col("_sl_symbols").cast("long"),
        (F.size("_sl_lines") - F.size(F.array_distinct("_sl_lines"))).cast("long").alias("_sl_dups"),
        F.size("_sl_lines").cast("long").alias("_sl_line_count"),
        F.when(n >= WINDOW, gram).alias("_sl_grams"),
    )
    grams = F.col("_sl_grams")
    rows = rows.withColumn("_sl_sorted", F.when(F.size(F.array_distinct(grams)) < F.size(grams), F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i")))))).drop("_sl_grams")
    s = F.col("_sl_sorted")
    twin = F.filter(s, lambda x, j: F.get(s, j - 1)["g"].eqNullSafe(x["g"]) | F.get(s, j + 1)["g"].eqNullSafe(x["g"]))
    rows = rows.withColumn("_sl_at", F.array_sort(F.transform(twin, lambda x: x["i"]))).drop("_sl_sorted")
    at = F.col("_sl_at")
    step = F.transform(at, lambda p, k: F.when(k == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), p - F.get(at, k - 1))))
    repeats = F.coalesce(F.aggregate(step, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")
    return rows.select(F.col("_sl_id").alias("doc_id"), F.col("_sl_host").alias("host"), F.col("_sl_n").alias("n_words"), F.col("_sl_chars").alias("word_chars"), F.col("_sl_symbols").alias("n_symbols"), F.col("_sl_dups").alias("n_dup_lines"), repeats.alias("n_repeat_words"), F.col("_sl_line_count").alias("n_lines"), *more)


def base_failed() -> Column:
    return F.expr(" OR ".join(f"({RULES[r]})" for r in BASE))


def host_rates(measured: DataFrame) -> DataFrame:
    """``host, docs`` and for each rule ``<rule>_rate``, the failure rate shrunk with the rule's beta prior, and ``<rule>_mean``, the prior's mean.

    A prior's mean and variance are those of the hosts' raw rates (method of
    moments); where the variance leaves no proper prior, one of two documents'
    weight at the mean stands in.
    """
    hosts = measured.groupBy("host").agg(F.count("*").alias("docs"), *(F.sum(F.expr(f"CAST({e} AS BIGINT)")).alias(r) for r, e in RULES.items()))
    raw = {r: F.col(r) / F.col("docs") for r in RULES}
    moments = hosts.agg(*(F.avg(x).alias(f"{r}_m") for r, x in raw.items()), *(F.var_pop(x).alias(f"{r}_v") for r, x in raw.items())).first()  # one row
    out = []
    for r in RULES:
        m, v = moments[f"{r}_m"], moments[f"{r}_v"]
        m = 0.5 if m is None else min(max(m, 1e-6), 1 - 1e-6)
        weight = m * (1 - m) / v - 1 if v else 0.0
        if not 0 < weight < 1e9:
            weight = 2.0
        out += [((F.col(r) + F.lit(m * weight)) / (F.col("docs") + F.lit(weight))).alias(f"{r}_rate"), F.lit(m).alias(f"{r}_mean")]
    return hosts.select("host", "docs", *out)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, reject_rate: float = 0.5, trust: float = 0.5, broadcast_hosts: int = 10_000, keep: list[Column] | None = None) -> DataFrame:
    """The measures of each row with ``failed`` (its rules, comma-joined), ``host_rejected``, ``host_trusted`` (rules), ``base_failed`` and ``kept``.

    Null and empty texts have no words and fail; null hosts are one host that is
    never rejected or trusted as such; identical rows and null ids keep a row each;
    a very long text is measured whole; a rate that equals a threshold does not pass it; an empty table
    gives no rows; columns in ``keep`` are passed on and may have any name but those of the measures.
    """
    measured = materialize(measure(docs, id_col, text_col, host, keep), "measures")
    rejected = F.greatest(*(F.col(f"{r}_rate") for r in RULES)) > reject_rate
    trusted = F.array_compact(F.array(*(F.when(F.col(f"{r}_rate") < trust * F.col(f"{r}_mean"), F.lit(r)) for r in RULES if r not in BASE)))
    told = host_rates(measured).where(F.col("host").isNotNull()).select("host", rejected.alias("host_rejected"), trusted.alias("host_trusted"), F.col("docs").alias("n"))
    told = told.where(F.col("host_rejected") | (F.size("host_trusted") > 0))
    if told.limit(broadcast_hosts + 1).count() <= broadcast_hosts:  # few hosts stand out; the documents then stay in place
        out = measured.join(F.broadcast(told.drop("n")), "host", "left")
    else:
        out = join_hot(measured, told, "host", F.xxhash64("doc_id", "n_words", "word_chars"), measured.count(), "left")
    failed = F.array_compact(F.array(*(F.when(F.expr(e), F.lit(r)) for r, e in RULES.items())))
    out = out.withColumns({"host_rejected": F.coalesce("host_rejected", F.lit(False)), "host_trusted": F.coalesce("host_trusted", F.array().cast("array<string>")), "_sl_failed": failed, "base_failed": base_failed()})
    kept = ~F.col("base_failed") & ~F.col("host_rejected") & (F.size(F.array_except("_sl_failed", "host_trusted")) == 0)
    return out.withColumns({"kept": kept, "failed": F.array_join("_sl_failed", ","), "host_trusted": F.array_join("host_trusted", ",")}).drop("_sl_failed")


def op7(spark, sf_dir: str) -> DataFrame:
    """``judge`` over all documents; a document's host is its source."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("host")
