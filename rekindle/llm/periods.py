"""Periodic runs of words, by a dictionary of basic factors.

A run is a stretch of words with smallest period q that repeats at least three times and cannot be made longer. For each
power of two L, every factor of L words gets a name; the next factor is named by the pair of its halves. The distance of a
factor to its successor (the next place of the same name) proposes a period if it is at most 2 L. Neighbours with the same distance form
one proposal, which is extended word by word in both directions; equal stretches are kept once.

No run is missed: one of period q has at least q + L words for the least L >= q, so all its factors of L words but the last ones have their
successor at distance q exactly (a nearer one would give a smaller period). Factors that are unique in their document are
left out on the next level, which is why ordinary prose costs little beyond L = 4.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rekindle.llm.base import map_rows, pieces_of, table, texts_of

LEAST, TIMES = 24, 3  # words of a run, and repeats of its period
WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id bigint, text string, starts array<bigint>, lengths array<bigint>, periods array<bigint>"


def words_of(raw: bytes) -> list[bytes]:
    return raw.split()  # bytes split at 20 and 09-0D only


def _named(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A number for each pair, equal for equal pairs."""
    pairs = first * (int(second.max(initial=0)) + 1) + second
    return np.unique(pairs, return_inverse=True)[1].astype(np.int64)


def _successors(at: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distance from each place to the next one of its name (0: none), and whether its name is met twice; ``at`` ascends."""
    order = np.argsort(names, kind="stable")
    same = names[order[1:]] == names[order[:-1]]
    distance, twice = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
    distance[order[:-1][same]] = (at[order[1:]] - at[order[:-1]])[same]
    twice[order[:-1][same]] = twice[order[1:][same]] = True
    return distance, twice


def _reach(x: np.ndarray, y: np.ndarray) -> int:
    """How many leading cells are equal, compared in growing pieces."""
    at, size = 0, 32
    while at < len(x):
        differ = x[at:at + size] != y[at:at + size]
        if differ.any():
            return at + int(differ.argmax())
        at, size = at + size, size * 2
    return len(x)


def _extended(x: np.ndarray, a: int, b: int, q: int, low: int, high: int) -> tuple[int, int]:
    """The longest stretch around [a, b) inside [low, high) that keeps period q."""
    b += _reach(x[b:high], x[b - q:high - q])
    a -= _reach(x[low:a][::-1], x[low + q:a + q][::-1])
    return a, b


def find_runs(ids: np.ndarray, offsets: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each document, by start and then period.

    ``ids`` are the word numbers of several documents, one after the other; ``offsets`` says where each starts and where the last ends.
    """
    if times < 3:
        raise ValueError("a period must repeat at least three times")
    sizes = np.diff(offsets)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.repeat(offsets[1:], sizes)
    found: set[tuple[int, int, int]] = set()
    at = np.flatnonzero(sizes[doc] >= least)  # places whose factor of the present length may matter
    names = _named(doc[at], ids[at]) if len(at) else at
    length, widest = 1, int(sizes.max(initial=0)) // times
    while len(at):
        distance, twice = _successors(at, names)
        jump = np.zeros(len(ids) + 1, np.int64)
        jump[at] = distance
        near = (distance > 0) & (distance <= 2 * length)
        far = near & (distance > length)  # longer than the factor: two equal jumps in a row make it a progression
        near[far] = jump[at[far] + distance[far]] == distance[far]
        places, gaps = at[near], distance[near]
        if len(places):
            new = np.flatnonzero(np.concatenate([[True], (np.diff(places) != 1) | (np.diff(gaps) != 0)]))
            last = np.append(new[1:], len(places)) - 1
            for a, z, q in zip(places[new].tolist(), places[last].tolist(), gaps[new].tolist()):
                low, high = int(offsets[doc[a]]), int(ends[a])
                if high - low < times * q:
                    continue
                a, b = _extended(ids, a, z + length + q, q, low, high)
                if b - a >= max(least, times * q):
                    found.add((a, b, q))
        if length >= widest:
            break
        # the factor twice as long can only be met twice where both its halves are
        name = np.full(len(ids) + length, -1, np.int64)
        name[at[twice]] = names[twice]
        at = at[twice]
        at = at[at + 2 * length <= ends[at]]
        at = at[name[at + length] >= 0]
        names = _named(name[at], name[at + length]) if len(at) else at
        length *= 2
    out: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    for a, b, q in sorted(found, key=lambda r: (r[0], r[2])):
        out[doc[a]].append((a - int(offsets[doc[a]]), b - a, q))
    return out


def dropped(runs: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """Which of n words lie in a run after its first period."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:n]) > 0


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length over period, then the smallest start and period."""
    return max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


def _mapped(docs: DataFrame, least: int, times: int, finish: Callable, schema: str) -> DataFrame:
    def make():
        def work(batch):
            keys, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for part in pieces_of(texts):
                words = [words_of(t.encode()) for t in texts[part]]
                offsets = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
                flat = pa.array([w for found in words for w in found], pa.binary())
                ids = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
                yield finish(keys[part], texts[part], words, find_runs(ids, offsets, least, times))

        return work

    return map_rows(docs, make, schema)


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, text, and starts, lengths, periods (in words) of all runs of each text, by start and then period.

    A run has at least ``least`` words and ``times`` (3 or more) repeats of its period. Null and empty texts have no runs and come
    back as empty text; repeated rows are each judged; other columns are ignored; an empty table gives no rows. A text of any length is read whole by one task, in
    memory that grows with its words; no rows are shuffled.
    """

    def finish(keys, texts, words, runs):
        parts = [[[r[i] for r in found] for found in runs] for i in range(3)]
        return {"doc_id": keys, "text": texts, "starts": parts[0], "lengths": parts[1], "periods": parts[2]}

    return _mapped(texts_of(df, id_col, text_col), least, times, finish, SCHEMA)


def collapsed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, text, and starts, lengths, periods of the runs; text holds the words outside them and one period of each, joined by spaces.

    Rows are treated as by :func:`periodic_runs`.
    """

    def finish(keys, texts, words, runs):
        parts = [[[r[i] for r in found] for found in runs] for i in range(3)]
        kept = []
        for found, some in zip(words, runs):
            gone = dropped(some, len(found)) if some else None
            kept.append(b" ".join(found if gone is None else [w for w, g in zip(found, gone) if not g]).decode())
        return {"doc_id": keys, "text": kept, "starts": parts[0], "lengths": parts[1], "periods": parts[2]}

    return _mapped(texts_of(df, id_col, text_col), least, times, finish, SCHEMA)


def digests(found: DataFrame) -> DataFrame:
    """Of the rows of :func:`collapsed`: doc_id, n_runs, start, length, period, exponent_milli (strongest run), runs_sha256, collapsed_sha256."""

    def make():
        def work(batch):
            out = {c: [] for c in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")}
            columns = (batch.column(c).to_pylist() for c in ("text", "starts", "lengths", "periods"))
            for text, *parts in zip(*columns):
                runs = list(zip(*parts))
                best = strongest(runs)
                told = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
                for name, value in zip(("start", "length", "period", "exponent_milli"), told):
                    out[name].append(value)
                out["n_runs"].append(len(runs))
                listed = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
                out["runs_sha256"].append(hashlib.sha256(listed.encode()).hexdigest())
                out["collapsed_sha256"].append(hashlib.sha256(text.encode()).hexdigest())
            yield {"doc_id": batch.column("doc_id"), **out}

        return work

    schema = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"
    return map_rows(found, make, schema)


def planted(text: Column, doc_id: Column) -> Column:
    """The text with the periodic tail that the number of the document gives one in ten of them; a null id leaves it alone.

    With h the CRC-32 of the decimal id and g = h / 10, words from a = g % n on repeat the 1 + (n - a) / (3 + g % 8) words there.
    """
    h = F.crc32(doc_id.cast("bigint").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("bigint")
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.greatest(F.size(words), F.lit(1)).cast("bigint")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8)).cast("bigint")
    root = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    copies = F.flatten(F.array_repeat(root, F.ceil((n - a) / p).cast("int")))
    tail = F.slice(F.concat(F.slice(words, F.lit(1), a.cast("int")), copies), F.lit(1), n.cast("int"))
    return F.when((h % 10 == 0) & text.rlike(WORD), F.array_join(tail, " ")).otherwise(text)


def op12_periods(spark, folder: str) -> DataFrame:
    docs = texts_of(table(spark, folder, "documents"))
    return digests(collapsed(docs.select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text"))))
