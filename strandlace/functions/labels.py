"""Column functions for labels, ticks and escapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_kb(n: Column) -> Column:
    return (
        F.when(n >= 1_000_000, F.concat(F.format_string("%.1f", n / 1e6), F.lit("M")))
        .when(n >= 10_000, F.concat(F.floor(n / 1000).cast("string"), F.lit("k")))
        .when(n >= 1000, F.concat(F.format_string("%.1f", n / 1e3), F.lit("k")))
        .otherwise(n.cast("string"))
    )


def nice_tick_step(least: Column) -> Column:
    """The smallest 1, 2, 5 or 10 times a power of ten that reaches ``least`` (1 at least)."""
    t = F.greatest(F.lit(1.0), least.cast("double"))
    base = F.pow(F.lit(10.0), F.floor(F.log10(t)))
    return F.when(base >= t, base).when(base * 2 >= t, base * 2).when(base * 5 >= t, base * 5).otherwise(base * 10).cast("long")


def xml_escape(s: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(raw), F.lit(entity))
    return s


def iso_utc(seconds: Column) -> Column:
    """Seconds since 1970 as UTC text, whatever the session's time zone."""
    part = lambda x, by: F.lpad(F.pmod(F.floor(seconds / by), F.lit(x)).cast("string"), 2, "0")
    day = F.date_from_unix_date(F.floor(seconds / 86400).cast("int")).cast("string")
    return F.concat(day, F.lit("T"), part(24, 3600), F.lit(":"), part(60, 60), F.lit(":"), part(60, 1), F.lit("Z"))


def sha256(s: Column) -> Column:
    return F.sha2(s.cast("binary"), 256)


def truncate(s: Column, most: int, mark: str = ".") -> Column:
    return F.when(F.length(s) > most, F.concat(F.substring(s, 1, most - 1), F.lit(mark))).otherwise(s)


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def wrap(s: Column, width: int = 60) -> Column:
    """Lines of ``width`` letters."""
    return F.regexp_replace(s, f"(.{{{width}}})(?=.)", "$1\n")


def coordinate(record: Column, pos: Column, records: Column) -> Column:
    """1-based position, after the record's name where there are several."""
    return F.when(records > 1, F.concat(record, F.lit(":"), (pos + 1).cast("string"))).otherwise((pos + 1).cast("string"))


def nice_step(span: Column) -> Column:
    """The smallest 1, 2, 5 or 10 times a power of ten that reaches an eighth of ``span``; 1 for spans under 8."""
    target = span.cast("double") / 8
    base = F.pow(F.lit(10.0), F.floor(F.log10(F.greatest(target, F.lit(1.0)))))
    big = F.when(base >= target, base).when(2 * base >= target, 2 * base).when(5 * base >= target, 5 * base).otherwise(10 * base)
    return F.when(target < 1, F.lit(1)).otherwise(big).cast("long")


def alignment_text(kind: str, q_name: Column, q: Column, s_name: Column, s: Column, q_lo: Column, s_lo: Column) -> Column:
    """An excerpt pair as text: ``fasta`` (two wrapped records), ``stockholm`` or ``plain`` (two padded rows)."""
    if kind == "fasta":
        lines = lambda x: F.when(F.length(x) > 0, F.concat(wrap(x, 60), F.lit("\n"))).otherwise("")
        head = lambda name, lo, x: F.concat(F.lit(">"), name, F.lit(":"), (lo + 1).cast("string"), F.lit(".."), (lo + F.length(x)).cast("string"), F.lit(" (length "), F.length(x).cast("string"), F.lit(")\n"))
        return F.concat(head(q_name, q_lo, q), lines(q), head(s_name, s_lo, s), lines(s))
    width = F.greatest(F.length(q_name), F.length(s_name)) + 2
    mark = ":" if kind == "plain" else ""
    row = lambda name, x: F.concat(F.rpad(F.concat(name, F.lit(mark)), width, F.lit(" ")), x, F.lit("\n"))
    rows = F.concat(row(q_name, q), row(s_name, s))
    return rows if kind == "plain" else F.concat(F.lit("# STOCKHOLM 1.0\n"), rows, F.lit("//\n"))
