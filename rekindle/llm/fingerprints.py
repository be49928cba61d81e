"""Document fingerprints by order MinHash.

Every k-mer of code points is numbered by its occurrence. Each of m hash functions orders the numbered k-mers; the
l smallest are listed in text order, and the list is hashed to one of the m signature values. So a signature
value survives only if the chosen k-mers stay and keep their order: likeness follows the edit distance, not only the
shared k-mers.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rekindle.llm.base import map_rows, table, texts_of
from rekindle.session import local_table, materialise

K, L, M = 12, 2, 32
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * ODD[3]
    x = x ^ (x >> np.uint64(29))
    x = x * ODD[4]
    return x ^ (x >> np.uint64(32))


def kmer_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all k-mers; a shorter text is one k-mer, an empty one has none."""
    n = len(points)
    if not n:
        return np.zeros(0, np.uint64)
    unit = mixed(points.astype(np.uint64) + np.uint64(1))
    size, width, done, powers = min(k, n), 1, None, unit
    at, step = 0, ODD[0]
    while size:  # binary parts of the length, from the lowest; wider hashes come by doubling
        if size & 1:
            part = powers[at:]
            done = part if done is None else done[:n - at - width + 1] * step + part[:n - at - width + 1]
            at += width
        size >>= 1
        if size:
            powers = powers[:-width] * step + powers[width:]
            width *= 2
            step = np.uint64(int(step) * int(step) * int(ODD[1]) % 2**64 | 1)
    return mixed(done[:n - min(k, n) + 1])


def numbered(kmers: np.ndarray) -> np.ndarray:
    """Hashes of (k-mer, occurrence number)."""
    ordered = np.sort(kmers)
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return kmers
    repeated = np.unique(ordered[1:][same])
    at = np.searchsorted(repeated, kmers)
    at[at == len(repeated)] = 0
    places = np.flatnonzero(repeated[at] == kmers)
    groups = at[places]
    order = np.argsort(groups, kind="stable")
    sorted_groups = groups[order]
    first = np.searchsorted(sorted_groups, sorted_groups, "left")
    occurrence = np.empty(len(places), np.uint64)
    occurrence[order] = (np.arange(len(places)) - first).astype(np.uint64)
    out = kmers.copy()
    out[places] = np.where(occurrence > 0, mixed(kmers[places] + occurrence * ODD[2]), kmers[places])
    return out


class Sketcher:
    def __init__(self, k: int = K, l: int = L, m: int = M, seed: int = 1):
        self.k, self.l, self.m = k, l, m
        self.factors = np.random.default_rng(seed).integers(0, 1 << 63, m, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def sketch(self, text: str) -> np.ndarray:
        """m values of 32 bits; zeros for the empty text."""
        kmers = kmer_hashes(np.frombuffer(text.encode("utf-32-le"), np.uint32), self.k)
        n = len(kmers)
        if not n:
            return np.zeros(self.m, np.uint32)
        keys = numbered(kmers)
        take = min(self.l, n)
        bound = np.uint64(int(2**64 * (take + 24) / n)) if n > 4 * (take + 24) else None
        chosen = np.empty((self.m, take), np.int64)
        for j in range(self.m):
            ranks = keys * self.factors[j]
            low = np.flatnonzero(ranks < bound) if bound is not None else None
            if low is None or len(low) < take:
                low = np.arange(n)
            order = np.argsort(ranks[low], kind="stable")[:take] if len(low) < 512 else np.argpartition(ranks[low], take - 1)[:take]
            chosen[j] = np.sort(low[order])
        value = np.full(self.m, n < self.l, np.uint64)
        for i in range(take):
            value = mixed(value * ODD[1] + kmers[chosen[:, i]])
        out = (value >> np.uint64(32)).astype(np.uint32)
        return np.maximum(out, 1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal signature values, 0 to 1."""
    return float((a == b).mean())


def fingerprint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, l: int = L, m: int = M) -> DataFrame:
    """doc_id, fingerprint (m times 8 hex digits) of each whole text.

    Null and empty texts have the fingerprint of zeros; a text shorter than k is one k-mer. Equal texts have equal fingerprints.
    Other columns are ignored, repeated rows are done each, an empty table gives an empty table.
    """

    def make():
        sketcher = Sketcher(k, l, m)

        def work(batch):
            yield {"doc_id": batch.column("doc_id"), "fingerprint": [sketcher.sketch(t).astype(">u4").tobytes().hex() for t in batch.column("text").to_pylist()]}

        return work

    return map_rows(texts_of(df, id_col, text_col), make, "doc_id bigint, fingerprint string")


def half_replaced(text: str, following: str) -> str:
    """The last floor(n / 2) code points replaced by the first as many (or all) of ``following``."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(sketcher: Sketcher, doc_id, text: str, own, following: str, other) -> dict:
    edited = half_replaced(text, following)
    changed = sketcher.sketch(edited)
    return {
        "doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(edited.encode()).hexdigest(),
        "fingerprint": own.astype(">u4").tobytes().hex(), "edited_fingerprint": changed.astype(">u4").tobytes().hex(),
        "near_edited": likeness(own, changed), "near_next": likeness(own, other),
    }


def edited_neighbours(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, l: int = L, m: int = M) -> DataFrame:
    """Compares each document with its half-replaced text and with the next document in descending doc_id (after the last: the first).

    Rows are range-partitioned by id, so each task meets a document's successor right after it; only the first
    and last document of each partition are written out, and a small join on the partition number closes these gaps.
    Ties of doc_id are in order of text, a null doc_id comes last, a single document follows itself. An empty table gives no rows.
    """
    spark = df.sparkSession
    docs = texts_of(df, id_col, text_col)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.repartitionByRange(parts, F.desc("doc_id")).sortWithinPartitions(F.desc("doc_id"), "text")
    names = [c.split()[0] for c in RESULT.split(", ")]

    def make():
        sketcher = Sketcher(k, l, m)
        part = TaskContext.get().partitionId()

        def edge(kind, doc_id, text):
            return dict.fromkeys(names) | {"doc_id": doc_id, "kind": kind, "part": part, "text": text}

        held = []

        def work(batch):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                sketch = sketcher.sketch(text)
                if held:
                    before, old, own = held.pop()
                    rows.append(_compare(sketcher, before, old, own, text, sketch) | {"kind": 0, "part": part, "text": None})
                else:
                    rows.append(edge(1, doc_id, text))
                held.append((doc_id, text, sketch))
            if rows:
                yield {c: [r[c] for r in rows] for c in rows[0]}

        def end():
            if held:
                doc_id, text, _ = held.pop()
                row = edge(2, doc_id, text)
                yield {c: [row[c]] for c in row}

        return work, end

    schema = RESULT + ", kind int, part int, text string"
    done = materialise(map_rows(ordered, make, schema))
    edges = done.filter("kind > 0").select("doc_id", "kind", "part", "text")
    used = [r["part"] for r in edges.filter("kind = 1").select("part").orderBy("part").collect()]  # one number per partition
    if not used:
        return done.select(*names)
    after = local_table(spark, list(zip(used, used[1:] + used[:1])), "part int, following int")
    firsts = edges.filter("kind = 1").select(F.col("part").alias("following"), F.col("text").alias("next_text"))
    pairs = edges.filter("kind = 2").join(after, "part").join(firsts, "following").select("doc_id", "text", "next_text")

    def make_pairs():
        sketcher = Sketcher(k, l, m)

        def work(batch):
            rows = [
                _compare(sketcher, i, t, sketcher.sketch(t), f, sketcher.sketch(f))
                for i, t, f in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "next_text")))
            ]
            if rows:
                yield {c: [r[c] for r in rows] for c in names}

        return work

    return done.filter("kind = 0").select(*names).unionByName(map_rows(pairs, make_pairs, RESULT))


def op5_fingerprints(spark, folder: str) -> DataFrame:
    return edited_neighbours(table(spark, folder, "documents"))
