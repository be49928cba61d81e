"""Best products of vector blocks against dense arithmetic."""

import numpy as np
import pytest

from rekindle.operators import ranked, topk


def dense_lists(scores, hidden, k):
    out = set()
    for r, row in enumerate(scores):
        free = [c for c in range(len(row)) if (r, c) not in hidden]
        out |= {(r, c) for c in sorted(free, key=lambda c: (-row[c], c))[:k]}
    return out


@pytest.mark.parametrize("whole", [False, True])
def test_kernel_is_the_dense_ranking(monkeypatch, whole):
    """Tiles, rows that stop early, ties, tiny and huge values; whole numbers have many ties."""
    monkeypatch.setattr(ranked, "ROWS", 7)
    monkeypatch.setattr(ranked, "FIRST", 8)
    monkeypatch.setattr(ranked, "TILE", 32)
    rng = np.random.default_rng(3)
    for turn in range(60):
        m, n, d, k = (int(rng.integers(1, x)) for x in (30, 200, 9, 12))
        u, v = rng.normal(size=(m, d)), rng.normal(size=(n, d)) * rng.exponential(size=(n, 1))
        if whole:
            u, v = np.round(u), np.round(v)
            u[0] = 0
        else:
            v *= 10.0 ** [0, -12, 25][turn % 3]
            u *= 10.0 ** [0, 0, 0, 25][turn % 4]
        hidden = set(zip(rng.integers(0, m, 60).tolist(), rng.integers(0, n, 60).tolist()))
        block = ranked.Block(v)
        keys = np.sort(np.array([r * n + block.place[c] for r, c in hidden]))
        row, code, score = ranked.best_of_block(u, block, keys, k, np.full(m, -np.inf))
        scores = np.round(np.einsum("ud,id->uid", u, v).sum(2) if whole else np.array([np.einsum("d,id->i", x, v) for x in u]), 10)
        assert np.allclose(score, scores[row, code], rtol=1e-9, atol=1e-9)
        got, want = (np.array(sorted(x), np.int64).reshape(-1, 2) for x in (set(zip(row.tolist(), code.tolist())), dense_lists(scores, hidden, k)))
        assert len(got) == len(want) and np.allclose(scores[got[:, 0], got[:, 1]].sum(), scores[want[:, 0], want[:, 1]].sum())
        if whole:
            assert (got == want).all()


def test_scores_below_the_floor_are_left_out():
    u, v = np.eye(2), np.arange(20.0).reshape(10, 2)
    row, code, score = ranked.best_of_block(u, ranked.Block(v), np.zeros(0, np.int64), 4, np.array([14.0, -np.inf]))
    assert list(zip(row, code)) == [(0, 9), (0, 8), (0, 7), (1, 9), (1, 8), (1, 7), (1, 6)]


def test_cells_are_not_rounded_one_by_one(monkeypatch):
    """Only cells that can be among the best are formed in double precision."""
    rng = np.random.default_rng(1)
    u, v = rng.normal(size=(400, 20)), rng.normal(size=(20_000, 20))
    formed = []
    plain = np.round
    monkeypatch.setattr(ranked.np, "round", lambda x, *a: formed.append(np.size(x)) or plain(x, *a))
    row, _, _ = ranked.best_of_block(u, ranked.Block(v), np.zeros(0, np.int64), 10, np.full(400, -np.inf))
    assert len(row) == 4000 and sum(formed) < 400 * 20_000 / 50


def test_passes_over_blocks_give_the_same_lists(spark, planted, monkeypatch):
    """Many passes, fewer items than k in a block, a user without seen items, an id that is not text."""
    rng = np.random.default_rng(8)
    p, q = np.round(rng.normal(size=(60, 6)), 1), np.round(rng.normal(size=(40, 6)), 1)
    users = spark.createDataFrame([(f"u{i:02d}", v.tolist()) for i, v in enumerate(p)], "userID string, vec array<double>")
    items = spark.createDataFrame([(f"i{i:02d}", v.tolist()) for i, v in enumerate(q)], "itemID string, vec array<double>")
    seen = planted[0].filter("userID <> 'u05'")
    once = {(r.userID, r["rank"]): (r.itemID, r.score) for r in topk.factor_top(users, items, seen, 5).collect()}
    monkeypatch.setattr(topk, "AT_ONCE", 2)
    many = {(r.userID, r["rank"]): (r.itemID, r.score) for r in topk.factor_top(users, items, seen, 5, 400).collect()}
    assert many == once and len(once) == 300
    assert "FlatMapCoGroups" not in topk.factor_top(users, items, seen, 5, 700)._jdf.queryExecution().toString()
