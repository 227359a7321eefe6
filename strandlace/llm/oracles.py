"""DuckDB SQL for the queries that SQL can express.

The others: SimHash groups are connected components, the language model is
trained by exchange, licence rules and the tokenizer are code, proximity needs
nearest postings, and DuckDB has no XXH64 with a seed of 42 for the shards.
They are tested against brute force in ``tests/llm``.
"""

from __future__ import annotations

from .quality import BASE as BASE_RULES
from .quality import RULES as QUALITY_RULES
from .quality import WINDOW
from .secrets import BASE, RULES

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _secrets() -> str:
    parts = []
    for k, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        ok = f"length(regexp_extract(m[i], '{p}', {r.group})) >= {r.least}"
        parts.append(f"""
SELECT rid, {k} AS rank, '{r.kind}' AS kind, CAST(stop - length(m[i]) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM (
  SELECT *, list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))) AS stop FROM (
    SELECT rid, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT rid, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS g FROM d))) WHERE {ok}""")
    span = "kind || ':' || start || ':' || stop"
    counts = ", ".join(f"count(s.rid) FILTER (rank = {k}) AS n_{r.kind}" for k, r in enumerate(BASE))
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), s AS ({" UNION ALL ".join(parts)})
SELECT doc_id, {counts}, sha256(coalesce(string_agg({span}, ',' ORDER BY start, rank) FILTER (rank < {len(BASE)}), '')) AS base_sha256, coalesce(string_agg({span}, ',' ORDER BY start, rank), '') AS spans
FROM d LEFT JOIN s USING (rid) GROUP BY rid, doc_id"""


def _lines() -> str:
    return r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, i, ls[i:i + 2] AS w FROM (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS i FROM d)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS n FROM w WHERE regexp_matches(array_to_string(w, ''), '[^\x20\x09-\x0D]')),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM r, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1),
l AS (SELECT d.doc_id, len(ls) AS n_lines, x.i, ls[x.i] AS line FROM d, LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS i) x)
SELECT doc_id, CAST(any_value(n_lines) AS BIGINT) AS n_lines, count(g.i) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '') AS text
FROM l LEFT JOIN gone g USING (doc_id, i) GROUP BY doc_id"""


def _substrings() -> str:
    return f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
w AS (SELECT doc_id, i, hash(array_to_string(ws[i:i + 19], ' ')) AS h, array_to_string(ws[i:i + 19], ' ') AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d WHERE len(ws) >= 20)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h, w ORDER BY doc_id, i) AS n FROM w),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM r, (SELECT unnest(range(0, 20)) AS k) WHERE n > 1),
t AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM d),
k AS (SELECT doc_id, count(*) AS n_words, count(g.i) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY t.i) FILTER (g.i IS NULL), '') AS kept FROM t LEFT JOIN gone g USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""


def _quality() -> str:
    sums = ", ".join(f"sum(({e})::INT) AS {r}" for r, e in QUALITY_RULES.items())
    moments = ", ".join(f"least(greatest(avg({r} / n), 1e-6), 1 - 1e-6) AS {r}_m, var_pop({r} / n) AS {r}_v" for r in QUALITY_RULES)
    weights = ", ".join(f"{r}_m, CASE WHEN {r}_v > 0 AND {r}_m * (1 - {r}_m) / {r}_v - 1 > 0 AND {r}_m * (1 - {r}_m) / {r}_v - 1 < 1e9 THEN {r}_m * (1 - {r}_m) / {r}_v - 1 ELSE 2.0 END AS {r}_w" for r in QUALITY_RULES)
    rate = {r: f"({r} + {r}_m * {r}_w) / (n + {r}_w)" for r in QUALITY_RULES}
    trusted = ", ".join(f"CASE WHEN {rate[r]} < 0.5 * {r}_m THEN '{r}' END" for r in QUALITY_RULES if r not in BASE_RULES)
    failed = ", ".join(f"CASE WHEN {e} THEN '{r}' END" for r, e in QUALITY_RULES.items())
    return f"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM (SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM d WHERE len(ws) >= {WINDOW}))),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM g, (SELECT unnest(range(0, {WINDOW})) AS k) WHERE n > 1 GROUP BY doc_id),
m AS (SELECT doc_id, host, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines
  FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d) LEFT JOIN c USING (doc_id)),
h AS (SELECT host, count(*) AS n, {sums} FROM m GROUP BY host),
p AS (SELECT {moments} FROM h),
q AS (SELECT {weights} FROM p),
v AS (SELECT host, greatest({", ".join(rate.values())}) > 0.5 AS bad, list_filter([{trusted}], lambda x: x IS NOT NULL) AS good FROM h, q WHERE host IS NOT NULL),
f AS (SELECT *, {QUALITY_RULES["short"]} OR {QUALITY_RULES["repeats"]} AS base_failed, list_filter([{failed}], lambda x: x IS NOT NULL) AS fails FROM m LEFT JOIN v USING (host))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed, coalesce(bad, false) AS host_rejected, coalesce(array_to_string(good, ','), '') AS host_trusted, array_to_string(fails, ',') AS failed,
  NOT base_failed AND NOT coalesce(bad, false) AND len(list_filter(fails, lambda x: NOT coalesce(list_contains(good, x), false))) = 0 AS kept FROM f"""


def _chats() -> str:
    escaped = lambda c: rf"regexp_replace({c}, '([<\[])(\\*/?(?:s>|INST\]|TURN\]))', '\1\\\2', 'g')"
    name = escaped("replace(replace(role, '\\', '\\\\'), chr(10), '\\n')")
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, i, ['user', 'assistant'][i + 1], '</s>[INST] ok [/INST]' FROM (SELECT unnest([0, 1]) AS i)),
o AS (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn NULLS LAST, role, md5(text)) AS l,
  sum(length({escaped("text")}) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 4 ELSE 16 + length({name}) END) AS formatted_chars FROM t GROUP BY conv_id),
a AS (SELECT *, array_to_string(list_transform(l, lambda x: x.role || chr(10) || x.text || chr(10)), '') AS told, array_to_string(list_transform(list_filter(l, lambda x: x.role = 'assistant'), lambda x: x.text), '') AS loss FROM o)
SELECT conv_id, CAST(len(l) AS BIGINT) AS n_turns, sha256(told) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM a"""


def _codes(parts: int = 8, size: int = 16, rounds: int = 6) -> str:
    distance = "list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    step = f"SELECT p.rid, p.part, min(struct_pack(d := {distance}, entry := b.entry)) AS a, any_value(p.v) AS v FROM p JOIN {{books}} AS b USING (part) GROUP BY p.rid, p.part"
    told = [f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT rid, vec_id, q, CAST(part AS BIGINT) AS part, q[part * (len(q) // {parts}) + 1:(part + 1) * (len(q) // {parts})] AS v FROM k, (SELECT unnest(range(0, {parts})) AS part)),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id, q) - 1 AS entry, v FROM p QUALIFY entry < {size})"""]
    for r in range(rounds):
        told.append(f"a{r} AS MATERIALIZED ({step.format(books=f'b{r}')})")
        told.append(f"m{r} AS (SELECT part, entry, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS v FROM (SELECT part, a.entry AS entry, i, sum(v[i]) AS s, count(*) AS n FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM a{r}) GROUP BY ALL) GROUP BY part, entry)")
        told.append(f"b{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m{r}.v, b{r}.v) AS v FROM b{r} LEFT JOIN m{r} USING (part, entry))")
    told.append(f"f AS ({step.format(books=f'b{rounds}')})")
    told.append("c AS (SELECT rid, string_agg(lpad(lower(to_hex(a.entry)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(a.d) AS BIGINT) AS error FROM f GROUP BY rid)")
    told.append("l AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM c JOIN k USING (rid) GROUP BY label)")
    told.append(f"h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})")
    return ",\n".join(told) + "\nSELECT k.vec_id, code, error, label_error, codebooks_sha256 FROM k JOIN c USING (rid) JOIN l ON k.label IS NOT DISTINCT FROM l.label, h"


ORACLES: dict[str, str] = {"op1_secret_ledger": _secrets(), "op3_line_windows": _lines(), "op6_recompression": _substrings(), "op7_host_quality": _quality(), "op11_chat_bytes": _chats(), "op12_vantage_codes": _codes()}
