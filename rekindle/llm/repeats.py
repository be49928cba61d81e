"""Removal of repeated byte strings, by sampled suffixes and names.

A byte goes if a string of ``length`` bytes that covers it also starts somewhere else. The method replaces that of a
difference cover (sorted triples, recursion on names, merge), which was never built or measured: its disk was only reckoned (see README).

1. Sample. The cover is chosen by content: each start takes the position with the smallest hash among the next ``window`` ones. Equal
   strings take the same position, and starts that take the same one form a run.
2. Names of samples. Each sampled suffix is named by its first length - window + 1 bytes, which all starts of its run contain.
   A run whose name is met once holds no repeat.
3. Names of runs. All bytes that a run's strings cover get a name in turn. A run whose name is met twice is repeated as a whole.
4. Remaining starts. The other runs of a shared sample, and one run for each repeated name there, list their starts one
   by one under the digest of the whole string. Equal neighbours in the order of the digests are repeats.

Names are digests: 64 bits where they only rule out, 128 bits (for a run, those of its sample and its whole) where they decide.
"""

from __future__ import annotations

import gc
import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rekindle.llm.base import map_rows, small_enough, table, texts_of
from rekindle.session import materialise

LENGTH, WINDOW = 400, 128
BLOCK = 1 << 22
WHOLE, PARTIAL, SHOWN = 1, 2, 3
HIGH = np.uint64(0xFFFFFFFF00000000)
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def sliding_least(x: np.ndarray, window: int) -> np.ndarray:
    """Minimum of every ``window`` neighbours."""
    n = len(x) - window + 1
    padded = np.full(-(-len(x) // window) * window, TOP)
    padded[:len(x)] = x
    blocks = padded.reshape(-1, window)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[window - 1:window - 1 + n])


def runs(raw: bytes, length: int, window: int):
    """(sample, first start, last start) of each run of starts; long texts in blocks, which only split runs."""
    last = len(raw) - length
    for at in range(0, last + 1, BLOCK):
        n = min(BLOCK, last + 1 - at)
        x = np.frombuffer(raw, np.uint8, n + window + 6, at).astype(np.uint64)
        x = x[:-1] | x[1:] << np.uint64(8)
        x = x[:-2] | x[2:] << np.uint64(16)
        x = x[:-4] | x[4:] << np.uint64(32)
        x = x * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xD6E8FEB86659FD93)
        key = x[:n + window - 1] & HIGH | np.arange(n + window - 1, dtype=np.uint64)
        sample = (sliding_least(key, window) & ~HIGH).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], sample[1:] != sample[:-1]]))
        ends = np.concatenate([first[1:], [n]]) - 1
        yield from zip((sample[first] + at).tolist(), (first + at).tolist(), (ends + at).tolist())


def signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def halves(digest: int) -> tuple[int, int]:
    return digest >> 64, digest & (1 << 64) - 1


def settled(high: np.ndarray, low: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combine equal digests of a batch before they are shuffled.

    Returns the count that each row stands for, and whether it needs no further look: of equal rows all but one are
    known repeats, and that one stands for two.
    """
    order = np.lexsort((low, high))
    h, l = high[order], low[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (l[1:] != l[:-1])]) if len(h) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    total = np.add.reduceat(many[order], starts) if len(starts) else np.zeros(0, np.int64)
    count, known = many.copy(), np.zeros(len(high), bool)
    count[order] = np.minimum(np.repeat(total, np.diff(np.append(starts, len(h)))), 2) if len(starts) else 0
    known[order] = ~new
    return count, known


def _runs(docs: DataFrame, length: int, window: int) -> DataFrame:
    """core, name, key, lo, size, many of each run (size: starts after the first).

    Runs agree only if both digests do, that of the sample and that of the whole. A known repeat gets a core of its
    own and counts twice.
    """

    def make():
        def work(batch):
            core, name, key, lo, size = [], [], [], [], []
            for k, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                raw = text.encode()
                if len(raw) < length:
                    continue
                for a, first, last in runs(raw, length, window):
                    core.append(xxhash.xxh3_64_intdigest(raw[a:a + length - window + 1]))
                    name.append(xxhash.xxh3_64_intdigest(raw[first:last + length], a - first + 1))
                    key.append(k)
                    lo.append(first)
                    size.append(last - first)
            if not core:
                return
            core, name, key, lo = signed(core), signed(name), np.array(key, np.int64), np.array(lo, np.int64)
            many, known = settled(core, name, np.ones(len(core), np.int64))
            core, name = np.where(known, own_digest(key, lo), core), np.where(known, key, name)
            yield {"core": core, "name": name, "key": key, "place": lo << 16 | np.array(size, np.int64) << 2 | np.where(known, 2, many)}

        return work

    rows = map_rows(docs.select("key", "text"), make, "core bigint, name bigint, key bigint, place bigint")
    return rows.repartition("core").select(
        "core", "name", "key", F.shiftright("place", 16).alias("lo"), F.shiftright("place", 2).bitwiseAND(F.lit(0x3FFF)).alias("size"),
        F.col("place").bitwiseAND(F.lit(3)).alias("many"),
    )


def own_digest(key: np.ndarray, lo: np.ndarray) -> np.ndarray:
    return (key * np.int64(-7046029254386353131)) ^ (lo * np.int64(-4417276706812531889))


def _judged(found: DataFrame) -> DataFrame:
    """key, lo, hi, kind of the runs that hold repeats or may (WHOLE, PARTIAL) or whose starts others must see (SHOWN)."""
    core, name = Window.partitionBy("core"), Window.partitionBy("core", "name")
    rows = found.withColumn("same", F.sum("many").over(name)).withColumn("at", F.row_number().over(name.orderBy("key", "lo")))
    rows = rows.withColumn("names", F.sum((F.col("at") == 1).cast("int")).over(core))
    kinds = F.when(F.col("same") > 1, F.when((F.col("names") > 1) & (F.col("at") == 1), F.array(F.lit(WHOLE), F.lit(SHOWN))).otherwise(F.array(F.lit(WHOLE))))
    kinds = kinds.when(F.col("names") > 1, F.array(F.lit(PARTIAL))).otherwise(F.array().cast("array<int>"))
    return rows.select("key", "lo", (F.col("lo") + F.col("size")).alias("hi"), F.explode(kinds).alias("kind"))


def covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open spans as maximal runs."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(s) for s in out]


def _result(doc_id, raw: bytes, spans: list[tuple[int, int]]) -> dict:
    kept, at = hashlib.sha256(), 0
    gone = covered(spans)
    for a, b in gone:
        kept.update(raw[at:a])
        at = b
    kept.update(raw[at:])
    return {"doc_id": doc_id, "n_bytes": len(raw), "n_removed": sum(b - a for a, b in gone), "n_spans": len(gone), "kept_sha256": kept.hexdigest(), "gone": [x for s in gone for x in s]}


FIRST = f"kind int, key bigint, {RESULT}, gone array<bigint>, text string, told array<struct<lo: bigint, hi: bigint, kind: int>>"
NAMES = ["kind", "key", *[c.split()[0] for c in RESULT.split(", ")], "gone", "text", "told"]
FINISHED, OPEN, SEEN = 0, 1, 2


def _untouched(docs: DataFrame) -> DataFrame:
    """Results of documents without any repeat."""

    def make():
        def work(batch):
            rows = [_result(i, t.encode(), []) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())]
            if rows:
                yield {c: [r[c] for r in rows] for c in rows[0]}

        return work

    return map_rows(docs.select("doc_id", "text"), make, f"{RESULT}, gone array<bigint>")


def _first_look(joined: DataFrame, length: int) -> DataFrame:
    """FINISHED documents, OPEN ones with their text and spans so far, and texts that others must only see (SEEN)."""

    def make():
        def work(batch):
            rows = []
            for key, doc_id, text, told in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "text", "told"))):
                spans = [(t["lo"], t["hi"] + length) for t in told if t["kind"] == WHOLE]
                rest = [t for t in told if t["kind"] != WHOLE]
                is_open = any(t["kind"] == PARTIAL for t in rest)
                row = {"key": key, "text": None, "told": None} | _result(doc_id, text.encode(), spans)
                if is_open:
                    rows.append(row | {"kind": OPEN, "text": text, "told": rest})
                    continue
                rows.append(row | {"kind": FINISHED})
                if rest:
                    rows.append(dict.fromkeys(NAMES) | {"kind": SEEN, "key": key, "text": text, "told": rest})
            if rows:
                yield {c: [r[c] for r in rows] for c in NAMES}

        return work

    return map_rows(joined, make, FIRST)


def _starts(texts: DataFrame, length: int) -> DataFrame:
    """h1, h2 (digest of the string), key, start, many of each start in the told runs; known repeats get a digest of their own."""

    def make():
        def work(batch):
            out = []
            for key, text, told in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "told"))):
                raw = text.encode()
                for t in told:
                    many = 1 if t["kind"] == PARTIAL else 2
                    out += [(*halves(xxhash.xxh3_128_intdigest(raw[s:s + length])), key, s, many) for s in range(t["lo"], t["hi"] + 1)]
            if not out:
                return
            h1, h2, key, start, many = zip(*out)
            h1, h2, key, start = signed(h1), signed(h2), np.array(key, np.int64), np.array(start, np.int64)
            many, known = settled(h1, h2, np.array(many, np.int64))
            h1, h2 = np.where(known, own_digest(key, start), h1), np.where(known, key, h2)
            yield {"h1": h1, "h2": h2, "key": key, "place": start << 2 | np.where(known, 2, many)}

        return work

    rows = map_rows(texts, make, "h1 bigint, h2 bigint, key bigint, place bigint").repartition("h1", "h2")
    return rows.select("h1", "h2", "key", F.shiftright("place", 2).alias("start"), F.col("place").bitwiseAND(F.lit(3)).alias("many"))


def _second_look(joined: DataFrame, length: int) -> DataFrame:
    def make():
        def work(batch):
            rows = []
            for doc_id, text, gone, starts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "gone", "starts"))):
                rows.append(_result(doc_id, text.encode(), list(zip(gone[::2], gone[1::2])) + [(s, s + length) for s in starts or []]))
            if rows:
                yield {c: [r[c] for r in rows] for c in rows[0]}

        return work

    return map_rows(joined, make, f"{RESULT}, gone array<bigint>")


def release(spark) -> None:
    """Let Spark drop the shuffle files of frames that are gone."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def find_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, gone (begin, end, begin, end ... of the removed bytes) of each row.

    Null and empty texts, and those under ``length`` bytes, lose nothing. Rows with equal text lose all of it from ``length`` bytes on,
    repeated rows too; rows that repeat a doc_id with other texts, or have none, are told apart by their text. Other
    columns are ignored, an empty table gives no rows. ``window`` (at most length - 7) sets the density of the samples.
    """
    if not 1 <= window <= min(length - 7, 1 << 14):
        raise ValueError("window must lie between 1 and length - 7, and not above 16384")
    spark = df.sparkSession
    docs = texts_of(df, id_col, text_col)
    once = docs.agg(F.count_distinct("doc_id") == F.count(F.lit(1))).first()[0]
    docs = docs.withColumn("key", F.col("doc_id") if once else F.xxhash64("doc_id", "text"))
    told = materialise(_judged(_runs(docs, length, window)).groupBy("key").agg(F.collect_list(F.struct("lo", "hi", "kind")).alias("told")))
    release(spark)
    touched = small_enough(told.select("key"))  # few: only the texts that hold repeats are shuffled
    first = materialise(_first_look(docs.join(touched, "key", "left_semi").join(told, "key"), length))
    release(spark)
    starts = _starts(first.filter(F.col("kind").isin(OPEN, SEEN)).select("key", "text", "told"), length)
    same = F.sum("many").over(Window.partitionBy("h1", "h2"))
    repeated = starts.withColumn("same", same).filter("same > 1").groupBy("key").agg(F.collect_list("start").alias("starts"))
    closed = _second_look(first.filter(F.col("kind") == OPEN).select("key", "doc_id", "text", "gone").join(repeated, "key", "left"), length)
    columns = [c.split()[0] for c in RESULT.split(", ")] + ["gone"]
    quiet = _untouched(docs.join(touched, "key", "left_anti"))
    return first.filter(F.col("kind") == FINISHED).select(*columns).unionByName(closed).unionByName(quiet)


def op2_repeats(spark, folder: str) -> DataFrame:
    return find_repeats(table(spark, folder, "documents")).drop("gone")
