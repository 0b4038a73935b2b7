"""DuckDB SQL of the quality rules: measures, exact binomial tests of the grids, verdicts."""

from __future__ import annotations

from .quality_rules import SIGNALS


def quality_rules_sql(alpha: float = 0.05, delta: float = 0.05, good_cost: int = 20) -> str:
    risk = alpha / len(SIGNALS)
    cells = " UNION ALL ".join(f"SELECT '{s}' AS signal, lang, good, {s} AS v, unnest([{', '.join(map(str, grid))}]::DOUBLE[]) AS cutoff FROM lab" for s, grid in SIGNALS.items())
    measured = ", ".join(f"min({s}) AS {s}" for s in SIGNALS)
    columns = ", ".join(f"max(cutoff) FILTER (signal = '{s}') AS cut_{s}" for s in SIGNALS)
    failed = "coalesce(" + ", ".join(f"CASE WHEN {s} > cut_{s} THEN '{s}' END" for s in SIGNALS) + ")"
    return rf"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM doc),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM (SELECT r, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: hash(w[i:i + 4]))) AS s FROM w WHERE len(w) >= 5)),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM g WHERE n > 1) GROUP BY r),
m0 AS (SELECT r, doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, len(l) AS lines, len(regexp_extract_all(t, '[A-Z]')) AS upper_n, len(regexp_extract_all(t, '[!?]')) AS marks, t FROM w LEFT JOIN rep USING (r)),
m AS (SELECT *, coalesce(n_symbols / nullif(word_chars, 0), 0.0) AS symbol_share, coalesce(upper_n / nullif(word_chars, 0), 0.0) AS upper_share, coalesce(n_repeat_words / nullif(n_words, 0), 0.0) AS repeat_share,
  coalesce(n_dup_lines / nullif(lines, 0), 0.0) AS dup_line_share, coalesce(marks / nullif(word_chars, 0), 0.0) AS mark_share, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m0),
lab AS (SELECT lang, bool_and(good) AS good, {measured} FROM m JOIN (SELECT doc_id, min(quality) > 0 AS good FROM labels WHERE quality IS NOT NULL GROUP BY 1) USING (doc_id) WHERE NOT base_failed GROUP BY lang, t),
cell AS (SELECT signal, lang, cutoff, count(*) FILTER (good) AS n, count(*) FILTER (good AND v > cutoff) AS k, count(*) FILTER (NOT good AND v > cutoff) AS bad FROM ({cells}) GROUP BY ALL),
ok AS (SELECT signal, lang, cutoff, bad - {good_cost} * k AS gain FROM cell WHERE k < n * {risk} AND bad - {good_cost} * k > 0
  AND ln(list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({risk}) + (n - j) * ln(1 - {risk}))))) <= ln({delta} / ({len(SIGNALS)} * (SELECT count(*) FROM (SELECT DISTINCT lang FROM lab))))),
best AS (SELECT signal, lang, cutoff FROM (SELECT *, row_number() OVER (PARTITION BY signal, lang ORDER BY gain DESC, cutoff DESC) AS o FROM ok) WHERE o = 1),
cut AS (SELECT lang AS of, {columns} FROM best GROUP BY 1)
SELECT doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {", ".join(SIGNALS)}, base_failed, coalesce({failed}, '-') AS failed_signal, NOT base_failed AND {failed} IS NULL AS kept
FROM m LEFT JOIN cut ON lang IS NOT DISTINCT FROM of
"""
