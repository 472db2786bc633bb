"""SQL of the training-data queries that SQL can express, written apart from the operators."""

from __future__ import annotations

import math

from .license_scan import NOTICES, PHRASES
from .quality_rules import GAMMA, NONE, RATES

_rates = list(RATES)
_value = lambda b: f"CASE WHEN {b} <= 0 THEN 0.0 ELSE pow({GAMMA}, {b} - 1.0) END"
_nth = lambda what, q: f"list_sort(list(b) FILTER ({what}))[CAST(ceil(count(*) FILTER ({what}) * {q}::DOUBLE) AS INT)]"
_wide = math.ceil(math.log(16.0) / math.log(GAMMA))
_unit = "CASE rate " + " ".join(f"WHEN '{r}' THEN CASE WHEN {whole} > 0 THEN 10000.0 / {whole} ELSE 0.0 END" for r, whole in RATES.items() if whole) + " ELSE 0.0 END"


def _fences(level: str, by: str, last: bool) -> str:
    """fence and jump of every rate and group: medians of units, then quartiles and the first wide gap of sorted buckets."""
    group = f"{by}, rate" if by else "rate"
    units = f"(SELECT *, quantile_disc(unit_bucket, 0.5) OVER (PARTITION BY {group}) AS u FROM sketch)"
    held = f"(SELECT {group}, u, greatest(bucket, u) AS b FROM {units})"
    steps = f"(SELECT *, lead(b) OVER (PARTITION BY {group} ORDER BY b) AS after, row_number() OVER (PARTITION BY {group} ORDER BY b) AS nth, count(*) OVER (PARTITION BY {group}) AS total FROM {held})"
    shown = "b > u OR u = 0"
    q = (
        f"SELECT {group}, count(*) AS total, count(*) FILTER ({shown}) AS showing, {_nth(shown, 0.25)} AS q1, {_nth(shown, 0.75)} AS q3, "
        f"min(b + after) FILTER (nth >= ceil(total * 0.75::DOUBLE) AND after - b >= {_wide}) AS ends FROM {steps} GROUP BY {group}"
    )
    fence = f"coalesce(CASE WHEN q3 IS NOT NULL THEN {_value('(q3 + 4.0 * (q3 - q1))')} END, {NONE})"
    jump = f"coalesce(CASE WHEN ends IS NOT NULL THEN {_value('ends / 2.0')} END, {NONE})"
    if not last:
        fence, jump = f"CASE WHEN showing >= 200 THEN {fence} END", f"CASE WHEN total >= 200 THEN {jump} END"
    return f"{level} AS (SELECT {group}, {fence} AS fence, {jump} AS jump FROM ({q}))"


QUALITY = rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
i AS (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3),
rep AS (SELECT rid, i FROM i QUALIFY count(*) OVER (PARTITION BY rid, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rid),
c AS (SELECT w.rid, doc_id, lang, source, len(ws) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
 len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words FROM w LEFT JOIN cov ON w.rid = cov.rid),
m AS (SELECT *, CASE WHEN word_chars > 0 THEN CAST(floor(n_symbols * 10000 / word_chars) AS BIGINT) ELSE 0 END AS symbol_rate, CASE WHEN n_lines > 0 THEN CAST(floor(n_dup_lines * 10000 / n_lines) AS BIGINT) ELSE 0 END AS dup_line_rate,
 CASE WHEN n_words > 0 THEN CAST(floor(n_repeat_words * 10000 / n_words) AS BIGINT) ELSE 0 END AS repeat_rate, CASE WHEN n_words > 0 THEN CAST(floor(word_chars * 100 / n_words) AS BIGINT) ELSE 0 END AS word_length FROM c),
u AS (SELECT lang, source, word_chars, n_lines, n_words, unnest([{', '.join(f"'{r}'" for r in _rates)}]) AS rate, unnest([{', '.join(_rates)}]) AS v FROM m WHERE n_words >= 50 AND 100 * n_repeat_words <= 50 * n_words),
e AS (SELECT *, {_unit} AS one FROM u),
sketch AS (SELECT lang, source, rate, CASE WHEN v <= 0 THEN 0 ELSE 1 + CAST(ceil(ln(v) / ln({GAMMA})) AS INT) END AS bucket, CASE WHEN one <= 0 THEN 0 ELSE 1 + CAST(ceil(ln(one) / ln({GAMMA})) AS INT) END AS unit_bucket FROM e),
{_fences('f1', 'lang, source', False)}, {_fences('f2', 'lang', False)}, {_fences('f3', '', True)},
lim AS (SELECT f1.lang, f1.source, f1.rate, least(coalesce(f1.fence, f2.fence, f3.fence), coalesce(f1.jump, f2.jump, f3.jump)) AS fence FROM f1 JOIN f2 ON f1.lang IS NOT DISTINCT FROM f2.lang AND f1.rate = f2.rate JOIN f3 ON f1.rate = f3.rate),
p AS (SELECT lang, source, {', '.join(f"max(fence) FILTER (rate = '{r}') AS {r}_limit" for r in RATES)} FROM lim GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
 NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND {' AND '.join(f'{r} <= {r}_limit' for r in _rates)} AS kept, {', '.join(_rates)}, {', '.join(f'round({r}_limit, 3) AS {r}_limit' for r in _rates)}
FROM m LEFT JOIN p ON m.lang IS NOT DISTINCT FROM p.lang AND m.source IS NOT DISTINCT FROM p.source"""

_templates = [
    f"({n}, '{label}', {n < len(PHRASES)}, {len(w)}, {at}, '{' '.join(w[at : at + 3])}')"
    for n, (label, words) in enumerate([*PHRASES, *NOTICES])
    for w in [words.split()]
    for at in range(len(w) - 2)
]

LICENSE = rf"""WITH t(template, label, exact, nw, tp, gram) AS (VALUES {', '.join(_templates)}),
w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT rid, ws, unnest(range(0, len(ws) - 2)) AS pos FROM w WHERE len(ws) >= 3),
hit AS (SELECT rid, template, label, exact, nw, tp, pos - tp AS dg FROM i JOIN t ON t.gram = ws[pos + 1] || ' ' || ws[pos + 2] || ' ' || ws[pos + 3]),
step AS (SELECT *, lag(dg) OVER (PARTITION BY rid, template ORDER BY dg, tp) AS before FROM hit),
span AS (SELECT *, sum(CASE WHEN before IS NULL OR (exact AND dg <> before) OR (NOT exact AND dg - before > 8) THEN 1 ELSE 0 END) OVER (PARTITION BY rid, template ORDER BY dg, tp) AS span FROM step),
stretch AS (SELECT s.rid, s.template, s.span, s.dg + s.tp AS at, len(list_distinct(flatten(list([o.tp, o.tp + 1, o.tp + 2])))) AS near FROM span s JOIN span o ON s.rid = o.rid AND s.template = o.template AND s.span = o.span
 WHERE NOT s.exact AND o.dg + o.tp BETWEEN s.dg + s.tp AND s.dg + s.tp + 2 * s.nw - 3 GROUP BY s.rid, s.template, s.span, s.dg, s.tp),
best AS (SELECT rid, template, span, max(near) AS near FROM stretch GROUP BY ALL),
pair AS (SELECT DISTINCT a.template, b.template AS other FROM t a JOIN t b ON a.gram = b.gram AND a.label <> b.label WHERE NOT a.exact AND NOT b.exact),
lacks AS (SELECT p.template, p.other, a.tp FROM pair p JOIN t a ON a.template = p.template WHERE NOT EXISTS (SELECT 1 FROM t b WHERE b.template = p.other AND b.gram = a.gram)),
needed AS (SELECT template, count(DISTINCT other) AS n_others FROM lacks GROUP BY template),
won AS (SELECT s.rid, s.template, s.span, count(DISTINCT l.other) AS n_won FROM span s JOIN lacks l ON s.template = l.template AND s.tp = l.tp GROUP BY ALL),
merged AS (SELECT rid, template, label, exact, nw, span, min(dg + tp) AS f, len(list_distinct(flatten(list([tp, tp + 1, tp + 2])))) AS covered FROM span GROUP BY ALL),
judged AS (SELECT m.*, covered / nw AS share, CASE WHEN exact THEN covered = nw ELSE near / nw >= 0.6 AND coalesce(n_won, 0) = coalesce(n_others, 0) END AS verified
 FROM merged m LEFT JOIN best b ON m.rid = b.rid AND m.template = b.template AND m.span = b.span LEFT JOIN needed d ON m.template = d.template LEFT JOIN won ON m.rid = won.rid AND m.template = won.template AND m.span = won.span),
told AS (SELECT rid, count(*) FILTER (exact AND verified) AS n_base, min(f) FILTER (exact AND verified) AS first_word, max(f) FILTER (exact AND verified) AS last_word,
 string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact AND verified) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (verified) AS labels, max(share) AS score FROM judged GROUP BY rid)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0.0), 9) AS score FROM w LEFT JOIN told ON w.rid = told.rid"""

TOPK = """WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.rid <> c.rid WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s QUALIFY rank <= 5"""

ORACLE_SQL = {"op1_quality_rules": QUALITY, "op3_license_scan": LICENSE, "op4_exact_topk": TOPK}
