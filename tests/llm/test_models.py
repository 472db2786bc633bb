"""Models and searches: held-out accuracy, gradients, exact recursions and exact results."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from planeweave.llm import exact_topk, language_id, lattice_lm
from planeweave.llm.queries import tokenizer

SHAPE = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def pieces():
    return lattice_lm.Pieces(tokenizer("byte_bpe_50k.tiktoken"))


def all_segmentations(word, ids, scores):
    word = b" " + word
    total = [0.0] + [-math.inf] * len(word)
    for j in range(1, len(word) + 1):
        parts = [total[i] + scores[ids[word[i:j]]] for i in range(j) if word[i:j] in ids]
        top = max(parts)
        total[j] = top + math.log(sum(math.exp(p - top) for p in parts))
    return total[-1]


def test_lattice_recursions(pieces):
    ids = {p: i for i, p in enumerate(pieces.pieces)}
    words = [b"a", b"the", b"internationalization", "ciónmente".encode(), b"y" * 90, b"abc12" * 70, "ñ".encode() * 150]
    got = lattice_lm.log_likelihoods(words, pieces, pieces.order)
    assert got == pytest.approx([all_segmentations(w, ids, pieces.order) for w in words])
    uses = lattice_lm.expected_counts(words, np.ones(len(words)), pieces, pieces.order)
    assert sum(uses[i] * len(p) for p, i in ids.items()) == pytest.approx(sum(len(w) + 1 for w in words))


def test_lattice_lm(spark, pieces):
    g = np.random.default_rng(2)
    vocabulary = ["".join(g.choice(list("abcdeé"), int(g.integers(1, 9)))) for _ in range(300)]
    rows = [(i, " ".join(g.choice(vocabulary, int(g.integers(0, 60)))), "x") for i in range(80)] + [(100, None, "x"), (101, "", "x"), (102, "Zq" * 400, "x"), (None, "abc", "x")]
    rows.append(rows[0])
    docs = spark.createDataFrame(rows, SHAPE).repartition(3)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    words = lambda t: (t or "").encode().lower().split()
    counts, ends = Counter(), 0
    for i, t, _ in rows:
        if not held(i):
            counts.update(words(t))
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    counts[None] = ends
    for hot in (10, lattice_lm.HOT):
        lattice_lm.HOT, old = hot, lattice_lm.HOT
        try:
            found = lattice_lm.lattice_lm(docs, tokenizer("byte_bpe_50k.tiktoken")).collect()
        finally:
            lattice_lm.HOT = old
        assert len(found) == len(rows)
        told = {i: t for i, t, _ in rows}
        for r in found:
            w = [*words(told[r.doc_id]), None]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(w), sum(counts[x] > 0 for x in w), n)
            assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w))
            assert r.score < 0
        if hot == 10:
            first = {r.doc_id: r.score for r in found}
    assert {r.doc_id: r.score for r in found} == pytest.approx(first)
    assert lattice_lm.lattice_lm(docs.limit(0), tokenizer("byte_bpe_50k.tiktoken")).count() == 0


def test_network_gradients():
    g = np.random.default_rng(0)
    net = language_id.Network(["a", "b", "c"], 4)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    cells, labels = g.integers(0, 257, (9, 5)), np.array([0, 1, 2, 0, 1])
    _, slopes = net.gradients(cells, labels)
    for name, w in net.w.items():
        at = tuple(int(g.integers(s)) for s in w.shape)
        at = (int(cells[0, 0]), at[1]) if name[0] == "x" else at
        w[at] += 1e-4
        up, _ = net.gradients(cells, labels)
        w[at] -= 2e-4
        down, _ = net.gradients(cells, labels)
        w[at] += 1e-4
        assert (up - down) / 2e-4 == pytest.approx(slopes[name][at], rel=1e-3, abs=1e-8), name


def test_language_id(spark):
    g = np.random.default_rng(5)
    make = {"aa": "ka lo mi ne".split(), "bb": "stra gru ölb ärt".split(), "cc": "ción ña que ell".split()}
    text = lambda k, n: " ".join("".join(g.choice(make[k], 3)) for _ in range(n))
    rows = [(i, text(k, int(g.integers(1, 120))), k) for i, k in enumerate(g.choice(list(make), 400))]
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 !?", "bb"), (1003, text("bb", 4000), None), (None, text("cc", 9), "cc")]
    docs = spark.createDataFrame(rows, SHAPE)
    found = {r.doc_id: r for r in language_id.language_id(docs, per_language=120, steps=120).collect()}
    assert len(found) == len(rows)
    held = [(i, k) for i, _, k in rows[:400] if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(found[i].held_out for i, _ in held) and sum(found[i].lang_pred == k for i, k in held) >= 0.97 * len(held)
    assert [found[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "bb"]
    assert all(0 <= r.score <= 1 for r in found.values())
    assert {r.lang_pred for r in language_id.language_id(docs.where("lang is null")).collect()} == {"und"}
    assert language_id.language_id(docs.limit(0)).count() == 0


def test_clashing_columns_and_repeated_rows(spark):
    """Other columns named like an operator's own change nothing; equal rows get equal results."""
    g = np.random.default_rng(6)
    rows = [(i, " ".join(g.choice(["ab", "cde", "fgh", "ij"], 30)), "xy"[i % 2]) for i in range(60)]
    rows += rows[:3]
    plain = spark.createDataFrame(rows, SHAPE)
    more = plain.selectExpr("*", "1 as n", "'z' as word", "2 as row", "3 as held_out", "4 as score", "5 as k_lang", "6 as salt", "7 as lp", "8 as rare")
    told = lambda df, run: Counter(tuple(r) for r in run(df).collect())
    for run in (lambda df: lattice_lm.lattice_lm(df, tokenizer("byte_bpe_50k.tiktoken")), lambda df: language_id.language_id(df, per_language=20, steps=5)):
        found = told(plain, run)
        assert found == told(more, run) and sum(found.values()) == 63
        assert all(n == 2 for k, n in found.items() if k[0] < 3)


def test_many_languages_share_the_sample(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST", 12)
    docs = spark.createDataFrame([(i, f"some text {i}", f"l{i % 5}") for i in range(100)] + [(1000 + i, "more", f"m{i}") for i in range(40)], SHAPE)
    sample = language_id.training_sample(docs, 1500)
    assert len(sample) <= 12 and {f"l{k}" for k in range(5)} <= set(sample["lang"])


def test_exact_topk(spark):
    g = np.random.default_rng(7)
    exact_topk.SHARD, old = 64, exact_topk.SHARD
    try:
        vectors = [(i, [float(x) for x in g.normal(0, 0.2, 8)]) for i in range(260)]
        vectors += [(i, vectors[3][1]) for i in range(260, 300)] + [(300, None), (350, [None, 1.0]), (301, [float("nan")] * 8), (302, [float("inf")] * 8), (303, []), (0, vectors[1][1])]
        found = exact_topk.exact_topk(spark.createDataFrame([(*v, 9) for v in vectors], "vec_id long, embedding array<double>, score int")).collect()
    finally:
        exact_topk.SHARD = old
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = Counter()
    for at, (i, q) in enumerate(whole):
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for n, (j, v) in enumerate(whole) if n != at)[:5]
            want.update((i, rank, j, -s) for rank, (s, j) in enumerate(best, 1))
    assert Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == want
    few = exact_topk.exact_topk(spark.createDataFrame([(0, [1.0]), (7, [1e200])], "vec_id long, embedding array<double>")).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in few] == [(0, 1, 7)]
    assert exact_topk.exact_topk(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_blocks_below_the_kth_are_not_scored(monkeypatch):
    g = np.random.default_rng(1)
    rows = np.floor(g.normal(0, 4, (40 * exact_topk.BLOCK, 4)))
    rows[: exact_topk.BLOCK] += 200
    scored = []
    monkeypatch.setattr(exact_topk, "products", lambda q, r, f=exact_topk.products: scored.append(len(r)) or f(q, r))
    query, n = np.array([[9.0, 9.0, 9.0, 9.0]]), exact_topk.BLOCK
    ids = np.arange(len(rows))
    blocks = [exact_topk.Block(ids[a : a + n], ids[a : a + n], rows[a : a + n]) for a in range(0, len(rows), n)]
    bounds = exact_topk.upper_bounds(query, np.array([b.rows.max(axis=0) for b in blocks]), np.array([b.rows.min(axis=0) for b in blocks]))
    (found,) = exact_topk.best(blocks, bounds, np.array([-1]), query, np.array([-np.inf]), 5)
    assert len(scored) == 1
    assert [(s, i) for s, i, _ in found] == sorted((-int(x), i) for i, x in enumerate(rows @ query[0]))[:5]


def test_only_blocks_that_may_count_are_sent(spark, monkeypatch):
    """Clusters in order of id: of all (query, shard) and (group, block) pairs few survive the first k-th score."""
    monkeypatch.setattr(exact_topk, "SHARD", 256)
    monkeypatch.setattr(exact_topk, "GROUP", 8)
    g = np.random.default_rng(3)
    base = np.eye(16) * 8
    vectors = [(i, (base[i // 256] + g.normal(0, 0.05, 16)).tolist()) for i in range(16 * 256)]
    sent = []
    monkeypatch.setattr(exact_topk, "surviving", lambda *a, f=exact_topk.surviving: sent.append(exact_topk.written(f(*a))) or sent[-1])
    found = exact_topk.exact_topk(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).collect()
    queries, shards = len([i for i, _ in vectors if i % 50 == 0]), 16
    kept = sent[0].where("query is not null").count()
    assert queries <= kept <= 1.5 * queries < queries * shards / 8
    whole = np.floor(256 * np.array([v for _, v in vectors]))
    for i in range(0, len(vectors), 50):
        scores = whole @ whole[i]
        want = sorted((-int(s), j) for j, s in enumerate(scores) if j != i)[:5]
        assert sorted((r["rank"], r.vec_id, r.score) for r in found if r.query_id == i) == [(n, j, -s) for n, (s, j) in enumerate(want, 1)]


@pytest.mark.parametrize("share", [-1.0, 2.0])
def test_both_plans_give_the_same(spark, monkeypatch, share):
    """Clusters in random order, with and without looking beforehand for what may be left out."""
    monkeypatch.setattr(exact_topk, "OPEN", share)
    monkeypatch.setattr(exact_topk, "SHARD", 256)
    monkeypatch.setattr(exact_topk, "GROUP", 16)
    g = np.random.default_rng(13)
    centres = g.normal(0, 1, (12, 10))
    v = centres[g.integers(12, size=3000)] + g.normal(0, 0.05, (3000, 10))
    found = exact_topk.exact_topk(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(5)).collect()
    whole = np.floor(256 * v).astype(np.int64)
    got = {}
    for r in found:
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for i in range(0, 3000, 50):
        want = sorted((-int(s), j) for j, s in enumerate(whole @ whole[i]) if j != i)[:5]
        assert sorted(got[i]) == [(n, j, -s) for n, (s, j) in enumerate(want, 1)]


def test_bounds_hold_and_balls_are_tight():
    g = np.random.default_rng(17)
    rows = np.floor(200 * (g.normal(0, 1, 24) + g.normal(0, 0.05, (400, 24))))
    q = np.floor(200 * g.normal(0, 1, (50, 24)))
    centre = rows.mean(axis=0)
    ends = rows.max(axis=0)[None], rows.min(axis=0)[None]
    ball = centre[None], np.array([np.linalg.norm(rows - centre, axis=1).max()])
    both, terms = exact_topk.upper_bounds(q, *ends, *ball)[:, 0], exact_topk.upper_bounds(q, *ends)[:, 0]
    assert (both >= (q @ rows.T).max(axis=1)).all() and (both <= terms).all() and (both < terms).mean() > 0.9


def test_rows_of_one_id_are_candidates_of_each_other(spark):
    rows = [(0, [2.0]), (0, [3.0]), (7, [1.0])]
    found = exact_topk.exact_topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert Counter((r["rank"], r.vec_id, r.score) for r in found) == Counter([(1, 0, 512 * 768), (2, 7, 512 * 256), (1, 0, 512 * 768), (2, 7, 768 * 256)])
