"""Exact best products of a block of vectors with few operations per cell.

Every cell is formed once in single precision, whose error has a bound; only cells that may still be among the best are
formed in double precision, rounded and ranked. Vectors of a block come longest first, so a row stops where no later one can be long enough.
"""

from __future__ import annotations

import numpy as np

# Scores are rounded before ranking, so ties do not depend on the order of a distributed sum.
SCORE_DIGITS = 10
ROWS = 512  # left vectors that meet a tile at once
FIRST, TILE = 1024, 8192  # right vectors of the first tile and of the largest one
ROUNDING = 10.0 ** -SCORE_DIGITS  # a rounded score moves by at most half of this
LARGEST = 1e30  # products beyond this leave single precision


class Block:
    """Right vectors, longest first; ``code[place]`` is the place of a vector in the order of the ids."""

    def __init__(self, matrix: np.ndarray):
        norm = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
        self.code = np.argsort(-norm, kind="stable")
        self.place = np.empty(len(matrix), np.int64)
        self.place[self.code] = np.arange(len(matrix))
        self.exact, self.norm = matrix[self.code], norm[self.code]
        self.most = float(np.abs(matrix).max(initial=0.0)) * max(1, matrix.shape[1])
        self.rough = None

    def rounded(self, dtype) -> np.ndarray:
        if self.rough is None or self.rough.dtype != dtype:
            self.rough = self.exact.astype(dtype)
        return self.rough


class _Best:
    """The best (row, place) of some rows so far: exact scores, and the score a new one has to reach."""

    def __init__(self, users: np.ndarray, block: Block, hidden: np.ndarray, k: int, floor: np.ndarray):
        self.users, self.block, self.hidden, self.k, self.floor = users, block, hidden, k, floor.copy()
        self.row, self.at, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.pending, self.waiting = [], 0

    def add(self, row: np.ndarray, at: np.ndarray) -> None:
        self.pending.append((row, at))
        self.waiting += len(row)

    def settle(self) -> None:
        """Score what is pending, keep the k best of each row and raise the floors."""
        row, at = (np.concatenate(x) for x in zip(*self.pending))
        self.pending, self.waiting = [], 0
        key = row * len(self.block.code) + at
        if len(self.hidden):
            found = np.minimum(np.searchsorted(self.hidden, key), len(self.hidden) - 1)
            free = self.hidden[found] != key
            row, at = row[free], at[free]
        score = np.empty(len(row))
        for lo in range(0, len(row), 1 << 16):
            part = slice(lo, lo + (1 << 16))
            score[part] = np.einsum("ij,ij->i", self.users[row[part]], self.block.exact[at[part]])
        score = np.round(score, SCORE_DIGITS) + 0.0
        keep = score >= self.floor[row]
        row, at, score = (np.concatenate(x) for x in ((self.row, row[keep]), (self.at, at[keep]), (self.score, score[keep])))
        order = np.lexsort((self.block.code[at], -score, row))
        row, at, score = row[order], at[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        last = place == self.k - 1
        self.floor[row[last]] = np.maximum(self.floor[row[last]], score[last])
        keep = place < self.k
        self.row, self.at, self.score = row[keep], at[keep], score[keep]


def best_of_block(users: np.ndarray, block: Block, hidden: np.ndarray, k: int, floor: np.ndarray):
    """``(row, code, score)`` of the k best products of each user with the block, ties to the smaller code.

    ``hidden``: sorted row * size of the block + place of the pairs left out. Scores are rounded; those below the user's ``floor`` are left
    out too. A product that is not a number is never among the best.
    """
    n, dim = block.exact.shape
    if not n or not len(users):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    safe = float(np.abs(users).max(initial=0.0)) * block.most < LARGEST  # false for NaN too
    dtype = np.float32 if safe else np.float64
    right, rough = block.rounded(dtype), users.astype(dtype)
    # error of a product in the rough type: (dim + 2) roundings of terms whose sum is at most the lengths' product
    norm = np.sqrt(np.einsum("ij,ij->i", users, users))
    error = (dim + 8) * float(np.finfo(dtype).eps) * norm
    cells = np.empty(ROWS * max(FIRST, TILE), dtype)  # written again by every tile
    marks = np.empty(len(cells), bool)
    out = []
    for low in range(0, len(users), ROWS):
        high = min(low + ROWS, len(users))
        first, last = np.searchsorted(hidden, (low * n, high * n))
        best = _Best(users[low:high], block, hidden[first:last] - low * n, k, floor[low:high])
        rows, mine = np.arange(high - low), rough[low:high]
        start, width = 0, FIRST
        while start < n:
            stop = min(n, start + width)
            longest = block.norm[start]
            slack = error[low:high] * longest + 2 * ROUNDING
            needed = best.floor - slack
            able = ~(norm[low + rows] * longest * (1 + 1e-9) < needed[rows])  # a NaN stays
            if not able.all():
                rows = rows[able]
                mine = rough[low:high][rows]
                if not len(rows):
                    break
            shape = (len(rows), stop - start)
            tile = cells[:shape[0] * shape[1]].reshape(shape)
            with np.errstate(all="ignore"):
                np.matmul(mine, right[start:stop].T, out=tile)
            if start == 0 and stop > k:
                place = best.hidden % n
                shown = best.hidden[place < stop]
                line = np.searchsorted(rows, shown // n)
                line_ok = line < len(rows)
                line_ok[line_ok] = rows[line[line_ok]] == (shown // n)[line_ok]
                tile[line[line_ok], (shown % n)[line_ok]] = -np.inf
                kth = np.partition(np.where(np.isnan(tile), -np.inf, tile), stop - k, axis=1)[:, stop - k].astype(float)
                needed[rows] = np.maximum(needed[rows], kth - 2 * slack[rows])
            cut = np.nextafter(needed[rows].astype(dtype), dtype(-np.inf))
            hit = np.flatnonzero(np.greater_equal(tile, cut[:, None], out=marks[:tile.size].reshape(shape)))
            line, at = np.divmod(hit, stop - start)
            best.add(rows[line], at + start)
            if start == 0 or best.waiting > 4 * k * len(rows) or stop == n:
                best.settle()
            start, width = stop, min(2 * width, TILE)
        if best.pending:
            best.settle()
        out.append((best.row + low, block.code[best.at], best.score))
    return tuple(np.concatenate(x) for x in zip(*out))
