"""Conversations, cut texts and shared lines against brute force on small tables with hostile rows."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from planeweave.llm import conversation_repair, fill_in_middle, line_dedup
from planeweave.llm.conversation_repair import Automaton

WHITE = " \t\n\x0b\f\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- lines


def plain_lines(rows, shortest, shared):
    strip = lambda line: line.strip(WHITE).translate({c: c + 32 for c in range(65, 91)})
    held = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(strip(line)) >= shortest:
                held.setdefault(strip(line), set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        gone = [len(held.get(strip(x), ())) >= shared and i != max(held[strip(x)], key=lambda d: (d is not None, d or 0)) for x in lines]
        kept = "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)
        out.append((i, len(lines), sum(gone), kept))
    return Counter(out)


def lined():
    g = np.random.default_rng(3)
    common = [f"A line that Many documents share, number {k} Ünder all É" for k in range(4)]
    rows = []
    for i in range(60):
        own = [f"own line {i} {k} with enough characters to count as long" for k in range(int(g.integers(0, 5)))]
        lines = [*own, *g.choice(common, int(g.integers(0, 4))), "", "short"]
        g.shuffle(lines)
        rows.append((i, "\n".join(str(x) if g.random() < 0.5 else f"  \t{x.upper() if x.isascii() else x}\r" for x in lines)))
    rows += [(61, None), (62, ""), (63, "\n\n"), (64, common[0]), (64, common[0] + "\n" + common[1]), (65, "\n".join(common * 50)), (66, common[2] + " "), (None, common[0]), (None, common[0])]
    four = "exactly four documents hold this line of some length"
    rows += [(70 + k, f"{four}\n{four}") for k in range(4)] + [(73, four)]
    five = "exactly five documents hold this line of some length"
    return [*rows, *((80 + k, five) for k in range(4)), (None, five)]


@pytest.mark.parametrize("few", [0, 1000])
def test_lines_that_many_documents_share(spark, few):
    rows = lined()
    given = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, lines string, gone int, hash string").repartition(3)
    found = Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.line_dedup(given, few=few).collect())
    assert found == plain_lines(rows, 40, 5)
    assert any(r[2] for r in found) and line_dedup.line_dedup(given.limit(0)).count() == 0
    assert {(r.doc_id, r.kept_sha256) for r in line_dedup.digest(given).collect()} == {(i, sha(t)) for i, _, _, t in found}


def test_lines_at_other_thresholds(spark):
    rows = [(i, t) for i, t in lined() if i is not None]
    given = spark.createDataFrame(rows, "doc_id long, text string")
    for shortest, shared in ((1, 2), (5, 3), (60, 1)):
        found = Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.line_dedup(given, shortest, shared).collect())
        assert found == plain_lines(rows, shortest, shared)


# --- texts cut in three


def plain_middle(i, text):
    text = text or ""
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n = len(tokens)
    h = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_texts_cut_in_three(spark):
    g = np.random.default_rng(5)
    bits = ["word", "é", " ", "\n", "\t\r", "\x1f", "\x00", " ", "日本語", "<", "P>", "<S", "x" * 70, "\U0001f600"]
    rows = [(i, "".join(g.choice(bits, int(g.integers(1, 60))))) for i in range(300)]
    rows += [(i + 400, t) for i, t in enumerate(["", None, " ", "   \n", "a", " a", "a ", "<P> in it", "half <M> way", "日", "<"])]
    rows += [(500, "long text é " * 40000), (501, " " * 5000), (None, "no id at all"), rows[3], rows[3]]
    given = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], "doc_id long, text string, n int, form string, named string").repartition(3)
    made = fill_in_middle.fill_in_middle(given).collect()
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made) == Counter((i, *plain_middle(i, t)) for i, t in rows)
    assert {r.form for r in made} == {"plain", "psm", "spm"}
    told = Counter((i, sha(t or "")) for i, t in rows)
    assert Counter((r.doc_id, r.restored_sha256) for r in fill_in_middle.digest(given).collect()) == told
    assert fill_in_middle.digest(given.limit(0)).count() == 0


def test_bits_of_rank():
    g = np.random.default_rng(6)
    for width in (1, 2, 3, 17, 64, 1000):
        flags = g.random(width) < 0.4
        flags[int(g.integers(width))] = True
        bits = int("".join("01"[int(f)] for f in flags), 2)
        assert [fill_in_middle.ranked_bit(bits, width, k) for k in range(bits.bit_count())] == np.flatnonzero(flags).tolist()


# --- conversations

NEXT, ROLE = {"0": "u", "s": "u", "u": "a", "a": "u"}, {"u": "user", "a": "assistant"}


def plain_repair(rows):
    """Least (cost, audit, lines) over all edits; rows: (role, text, fault)."""
    known = {}

    def go(at, state, budget):
        """``budget``: turns that may still be inserted before the next row."""
        if (at, state, budget) not in known:
            found = []
            if at == len(rows) and state in "0a":
                found.append((0, "", ()))
            if budget:
                c, w, lines = go(at, NEXT[state], budget - 1)
                found.append((c + 2, "I" + w, (ROLE[NEXT[state]] + ":", *lines)))
            if at < len(rows):
                role, text, fault = rows[at]
                c, w, lines = go(at + 1, state, 4)
                found.append((c + 3, "D" + w, lines))
                if fault not in (1, 2):
                    short, to = int(fault == 3), role[:1]
                    if (state + to) in ("0s", "0u", "su", "ua", "au"):
                        c, w, lines = go(at + 1, to, 4)
                        found.append((c + short, "K" + w, (f"{role}:{text}", *lines)))
                    c, w, lines = go(at + 1, NEXT[state], 4)
                    found.append((c + 2 + short, "R" + w, (f"{ROLE[NEXT[state]]}:{text}", *lines)))
            known[at, state, budget] = min(found, default=(10**9, "", ()))
        return known[at, state, budget]

    for at in range(len(rows), -1, -1):  # no deep recursion for long conversations
        for budget, state in itertools.product(range(5), "0sua"):
            go(at, state, budget)
    return go(0, "0", 4)


def plain_conversations(given):
    talks = {}
    for i, turn, role, text in given:
        role, text = " " if role is None else role, " " if text is None else text
        rows = talks.setdefault(i, [])
        kind = zlib.crc32(f"{' ' if i is None else i}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            now = "user" if kind == 4 else role, "" if kind == 1 else re.sub(r"[.!?]", "", text) if kind == 2 else text
            rows += [((turn is not None, turn or 0, role, text, c), turn, *now) for c in range(1 + (kind == 3))]
    out = Counter()
    for i, rows in talks.items():
        rows.sort(key=lambda r: r[0])
        seen, told, faults = set(), [], Counter()
        for _, _, role, text in rows:
            end = text.rstrip(WHITE)
            fault = 1 if not end else 2 if (role, text) in seen else 3 if end[-1] not in ".!?" else 0
            seen.add((role, text))
            told.append((role, text, fault))
            faults[fault] += 1
        turns = {r[1] for r in rows if r[1] is not None}
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(told))
        cost, audit, lines = plain_repair(told)
        out[i, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults[1], faults[2], faults[3], illegal, cost, audit, sha("\n".join(lines))] += 1
    return out


def talks():
    g = np.random.default_rng(8)
    roles, texts = ["system", "user", "assistant", "tool", "", None, "ü"], ["Yes.", "No", "", " \n", "Why?", "Über alles!  \n", None, "a.b", "..."]
    p = [0.1, 0.35, 0.35, 0.05, 0.05, 0.05, 0.05]
    rows = []
    for i in range(150):
        for turn in range(int(g.integers(1, 9))):
            t = None if g.random() < 0.05 else turn + int(g.integers(0, 2)) * int(g.integers(0, 3))
            rows.append((i, t, roles[g.choice(7, p=p)], f"{texts[g.integers(9)] or ''}" if g.random() < 0.3 else f"text {g.integers(40)}{g.choice(['.', '', '! '])}"))
    rows += [(None, t, "user", "x.") for t in (None, 1, 1)] + [(200, None, None, None), (201, 5, "user", "x" * 200000 + "."), (-5, 2, "assistant", "minus.")]
    rows += [(300, t, roles[g.choice(7, p=p)], f"line {g.integers(300)}{g.choice(['.', ''])}") for t in range(700)]
    lost = next(t for t in range(100) if zlib.crc32(f"400:{t}".encode()) % 20 == 0)
    return [*rows, (400, lost, "user", "gone."), *rows[:5]]


def test_conversations(spark):
    rows = talks()
    given = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "conv_id long, turn long, role string, text string, lost string, copy int, fault string").repartition(3)
    found = Counter(tuple(r) for r in conversation_repair.conversation_repair(given).collect())
    assert found == plain_conversations(rows)
    assert conversation_repair.conversation_repair(given.limit(0)).count() == 0
    whole = {r.conv_id: r for r in conversation_repair.conversation_repair(given.where("conv_id = 400"), damage=False).collect()}
    assert whole[400].audit == "KI" and whole[400].repaired_sha256 == sha("user:gone.\nassistant:")
    lost = {r.conv_id: r for r in conversation_repair.conversation_repair(given.where("conv_id = 400")).collect()}
    assert tuple(lost[400])[1:] == (0, 0, 0, 0, 0, 0, "", sha(""))


def test_repairs_of_random_symbols():
    g = np.random.default_rng(2)
    automaton, roles = Automaton(), ["other", "system", "user", "assistant"]
    for _ in range(800):
        symbols = bytes(g.integers(0, 9, int(g.integers(0, 12))).tolist())
        rows = [("user", "", 1) if s == 0 else (roles[(s - 1) // 2], "t", 3 * ((s - 1) % 2)) for s in symbols]
        cost, edits = automaton.repair(symbols)
        assert (cost, b"".join(edits).decode()) == plain_repair(rows)[:2]
    assert len(automaton.vectors) < 40  # vectors repeat, so that the table is small


def test_long_conversations_wait_on_disk(monkeypatch):
    monkeypatch.setattr(conversation_repair, "HELD", 100)
    talk, rows = conversation_repair._Conversation(1), []
    for k in range(80):
        role, text = ("user", "assistant")[k % 3 % 2], f"text {k}."
        talk.add(k, role[0], 0, role.encode(), text.encode())
        rows.append((role, text, 0))
    cost, audit, lines = plain_repair(rows)
    assert talk.finish(Automaton())[-3:] == (cost, audit, sha("\n".join(lines)))
