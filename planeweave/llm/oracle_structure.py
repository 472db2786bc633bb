"""SQL of the operators on conversations, cut texts and shared lines, written apart from the operators."""

from __future__ import annotations

_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER, _LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"

LINES = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS nr FROM d),
k AS (SELECT *, translate(trim(line, {_WHITE}), {_UPPER}, {_LOWER}) AS key FROM l),
s AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= 5),
m AS (SELECT k.*, s.key IS NOT NULL AND k.doc_id IS DISTINCT FROM s.last AS gone FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY nr) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY rid, doc_id"""

_group = lambda k: f"CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), {8 * k + 1}, 8) AS BIGINT)"
_part = lambda a, b: f"array_to_string(list_slice(ts, {a} + 1, {b}), '')"

MIDDLE = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {', '.join(f'{_group(k)} AS h{k + 1}' for k in range(4))} FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS ts FROM d),
c AS (SELECT *, len(ts) AS n, least(h1 % (len(ts) + 1), h2 % (len(ts) + 1)) AS a, greatest(h1 % (len(ts) + 1), h2 % (len(ts) + 1)) AS b FROM w),
p AS (SELECT *, {_part('0', 'a')} AS prefix, {_part('a', 'b')} AS middle, {_part('b', 'n')} AS suffix,
 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
 sha256(t) AS restored_sha256 FROM p"""

#: Bit by bit over the bytes of a short ASCII string.
_crc = lambda s: (
    "xor(4294967295, list_reduce(list_transform(string_split(" + s + ", ''), lambda x: CAST(ascii(x) AS BIGINT)), "
    "lambda c, x: list_reduce(range(8), lambda b, k: xor(b >> 1, 3988292384 * (b & 1)), xor(c, x)), 4294967295))"
)
# Costs to go of the four states (start, behind s, behind u, behind a) with their least audit and the
# lines that it leaves, row by row from the last to the first.
_then, _turn = (3, 3, 4, 3), ("user", "user", "assistant", "user")
_best = lambda c, w, r: f"{{'c': CAST({c} AS BIGINT), 'w': {w}, 'r': {r}}}"


def _added(e: str, q: int, depth: int) -> tuple[str, str, str]:
    """Cost, audit and lines if ``depth`` turns are inserted before going on from where they lead."""
    if depth == 0:
        return f"{e}[{q}].c", f"{e}[{q}].w", f"{e}[{q}].r"
    c, w, r = _added(e, _then[q - 1], depth - 1)
    return f"2 + {c}", f"'I' || {w}", f"list_prepend('{_turn[q - 1]}:', {r})"


def _edits(q: int) -> str:
    to = _then[q - 1]
    go = {"s": {1: 2}, "u": {1: 3, 2: 3, 4: 3}, "a": {3: 4}}
    out = [_best(f"3 + e[{q}].c", f"'D' || e[{q}].w", f"e[{q}].r")]
    far = _best("1000000000", "''", "CAST([] AS VARCHAR[])")
    line = "x.r || ':' || x.t"
    for initial, ends in go.items():
        if q in ends:
            n = ends[q]
            keep = _best(f"x.short + e[{n}].c", f"'K' || e[{n}].w", f"list_prepend({line}, e[{n}].r)")
            out.append(f"CASE WHEN x.f NOT IN (1, 2) AND left(x.r, 1) = '{initial}' THEN {keep} ELSE {far} END")
    given = _best(f"2 + x.short + e[{to}].c", f"'R' || e[{to}].w", f"list_prepend('{_turn[q - 1]}:' || x.t, e[{to}].r)")
    out.append(f"CASE WHEN x.f NOT IN (1, 2) THEN {given} ELSE {far} END")
    return f"list_min([{', '.join(out)}])"


_after = "[" + ", ".join(f"list_min([{', '.join(_best(*_added('y', q, k)) for k in range(3))}])" for q in range(1, 5)) + "]"
_closed = lambda states: f"list_transform([[{', '.join(states)}]], lambda y: {_after})[1]"
_ends = _closed([_best(0 if q in (1, 4) else 1000000000, "''", "CAST([] AS VARCHAR[])") for q in range(1, 5)])

REPAIR = f"""WITH g AS (SELECT conv_id, turn, coalesce(role, ' ') AS fr, coalesce(text, ' ') AS ft, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS ids FROM conversations),
h AS (SELECT *, {_crc('ids')} % 20 AS kind FROM g),
d AS (SELECT *, CASE kind WHEN 4 THEN 'user' ELSE fr END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(ft, '.!?', '') ELSE ft END AS text, unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE kind <> 0),
o AS (SELECT *, row_number() OVER byturn AS pos, lag(left(role, 1)) OVER byturn AS before, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, fr, ft, copy) AS nth, right(rtrim(text, {_WHITE}), 1) AS last
 FROM d WINDOW byturn AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, fr, ft, copy)),
f AS (SELECT *, CASE WHEN last = '' THEN 1 WHEN nth > 1 THEN 2 WHEN last NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM o),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
 count(*) FILTER (before IS NOT NULL AND before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal,
 list_reduce(list({{'r': role, 't': text, 'f': fault, 'short': CASE WHEN fault = 3 THEN 1 ELSE 0 END}} ORDER BY pos DESC), lambda e, x: {_closed([_edits(q) for q in range(1, 5)])}, {_ends})[1] AS best FROM f GROUP BY conv_id),
a AS (SELECT DISTINCT conv_id FROM conversations)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.w, '') AS audit,
 sha256(coalesce(array_to_string(best.r, chr(10)), '')) AS repaired_sha256 FROM a LEFT JOIN c ON a.conv_id IS NOT DISTINCT FROM c.conv_id"""

ORACLE_SQL = {"op11_conversation_repair": REPAIR, "op12_fill_in_middle": MIDDLE, "op13_line_dedup": LINES}
