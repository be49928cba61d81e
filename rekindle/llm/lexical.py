"""Ranked lexical search: term-at-a-time over short lists, then document-at-a-time with skipping over long ones.

One pass turns each document into its length and the occurrences of the items' terms (the forward rows); its counts give the
term weights. A task then turns its documents into segments of inverted lists. For an item, the lists of a segment are
ordered by length. The short ones are summed term by term into one accumulator per document; the accumulators, ordered by
document, act as one more list with a bound, the largest sum. Documents are then visited in order, in blocks: only lists that can
lift a document over the tenth best score so far name candidates, all others are probed by binary search, which skips, and a
candidate is left as soon as its sum and the bounds of the lists to come fall below that score. The tenth score carries over from one
segment of a task to the next. Scores are whole numbers, so bounds are exact and nothing is lost.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rekindle.llm.base import map_rows, table, texts_of
from rekindle.session import discard, materialise

TOP = 10
B = 75  # part of a document's length in the normalisation, of 100
BLOCK = 512  # candidates visited at once
SEGMENT = 2_000_000  # occurrences held in a task's segment
ITEMS = 2_000  # items searched in one pass
SHORT = 1 / 16  # lists of at most this part of a segment's documents are short
SALTS = 64
#: Bytes that belong to no term, and A-Z, as blanks and lower-case letters
LOWER = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of all other characters, A-Z lower-cased."""
    return text.encode().translate(LOWER).split()


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def length_part(terms, n: int, total: int):
    """m of a document with ``terms`` terms, of n documents with ``total`` terms."""
    return 100 - B + (B * terms * n) // total


def forward_rows(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms of the document), terms and tfs (those of the vocabulary) of documents with a term."""
    share = docs.sparkSession.sparkContext.broadcast(vocabulary)  # terms of at most ITEMS items

    def make():
        known = share.value

        def work(batch):
            out = {"doc_id": [], "n": [], "terms": [], "tfs": []}
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                found = terms_of(text)
                if found:
                    counts = Counter(filter(known.__contains__, found))
                    out["doc_id"].append(doc_id)
                    out["n"].append(len(found))
                    out["terms"].append([known[t] for t in counts])
                    out["tfs"].append(list(counts.values()))
            yield out

        return work

    return map_rows(docs, make, "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>")


class Best:
    """The best (score, document) pairs of an item so far; of equal scores the smaller document, none last."""

    def __init__(self, top: int):
        self.top, self.heap = top, []

    @property
    def least(self) -> int:
        """A score below this one cannot enter."""
        return self.heap[0][0] if len(self.heap) == self.top else 1

    def offer(self, score: int, doc_id: int | None) -> None:
        entry = (score, doc_id is not None, -(doc_id or 0))
        if len(self.heap) < self.top:
            heapq.heappush(self.heap, entry)
        elif entry > self.heap[0]:
            heapq.heapreplace(self.heap, entry)


class Segment:
    """Inverted lists over some documents: places of documents (ascending) and what a term adds to their scores."""

    def __init__(self, doc_ids: list, terms: np.ndarray, places: np.ndarray, adds: np.ndarray):
        self.doc_ids = doc_ids
        order = np.argsort(terms, kind="stable")
        self.places, self.adds = places[order], adds[order]
        names, starts = np.unique(terms[order], return_index=True)
        self.lists = dict(zip(names.tolist(), zip(starts.tolist(), np.append(starts[1:], len(order)).tolist())))

    def search(self, item: list[tuple[int, int]], best: Best) -> None:
        """Offer the documents of the segment that can be among the best for an item's (term, occurrences)."""
        short, long = [], []
        for term, times in item:
            if term in self.lists:
                a, b = self.lists[term]
                (short if b - a <= len(self.doc_ids) * SHORT else long).append((self.places[a:b], self.adds[a:b] * times))
        lists = []
        if short:  # term at a time
            at, inverse = np.unique(np.concatenate([p for p, _ in short]), return_inverse=True)
            sums = np.zeros(len(at), np.int64)
            np.add.at(sums, inverse, np.concatenate([s for _, s in short]))
            lists.append((at, sums))
        lists += long
        bounds = [int(s.max()) for _, s in lists]
        order = sorted(range(len(lists)), key=bounds.__getitem__)
        lists, bounds = [lists[i] for i in order], [bounds[i] for i in order]
        below = np.concatenate([[0], np.cumsum(bounds)])  # what the first lists can add together
        if not lists or below[-1] < best.least:
            return
        low, size = 0, len(self.doc_ids)
        while low < size:  # document at a time, a block of candidates after the other
            needed = int(np.searchsorted(below, best.least, "left")) - 1  # lists before it alone stay below the tenth score
            if needed >= len(lists):
                return
            leading = lists[needed:]
            cuts = [int(np.searchsorted(p, low)) for p, _ in leading]
            high = min((int(p[c + BLOCK]) for (p, _), c in zip(leading, cuts) if c + BLOCK < len(p)), default=size)
            high = max(high, low + 1)
            parts = [(p[c:], s[c:]) for (p, s), c in zip(leading, cuts)]
            parts = [(p[:k], s[:k]) for p, s in parts for k in [int(np.searchsorted(p, high))]]
            sums = np.zeros(high - low, np.int64) if high - low <= 64 * BLOCK else None
            if sums is not None:
                for p, s in parts:
                    sums[p - low] += s
                at = np.flatnonzero(sums)
                sums, at = sums[at], at + low
            else:
                at, inverse = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
                sums = np.zeros(len(at), np.int64)
                np.add.at(sums, inverse, np.concatenate([s for _, s in parts]))
            for i in range(needed - 1, -1, -1):
                keep = sums + below[i + 1] >= best.least
                at, sums = at[keep], sums[keep]
                if not len(at):
                    break
                p, s = lists[i]
                where = np.minimum(np.searchsorted(p, at), len(p) - 1)
                sums = sums + np.where(p[where] == at, s[where], 0)
            keep = sums >= best.least
            for place, score in zip(at[keep].tolist(), sums[keep].tolist()):
                if score >= best.least:
                    best.offer(score, self.doc_ids[place])
            low = high


def _segments(rows: DataFrame, items: dict[int, list[tuple[int, int]]], weights: np.ndarray, n: int, total: int, top: int) -> DataFrame:
    """item, doc_id, score: the best documents of each task for each item."""
    share = rows.sparkSession.sparkContext.broadcast((items, weights))

    def make():
        wanted, weight_of = share.value
        best = {item: Best(top) for item in wanted}
        held: dict[str, list] = {"doc_ids": [], "terms": [], "places": [], "adds": []}
        size = 0

        def flush() -> None:
            nonlocal size
            if size:
                segment = Segment(held["doc_ids"], *(np.concatenate(held[c]) for c in ("terms", "places", "adds")))
                for item, terms in wanted.items():
                    segment.search(terms, best[item])
            for values in held.values():
                values.clear()
            size = 0

        def work(batch) -> Iterator[dict]:
            nonlocal size
            counts = np.diff(batch.column("terms").offsets.to_numpy())
            terms = batch.column("terms").flatten().to_numpy().astype(np.int64)
            tf = batch.column("tfs").flatten().to_numpy()
            m = np.repeat(length_part(batch.column("n").to_numpy(), n, total), counts)
            held["terms"].append(terms)
            held["adds"].append(weight_of[terms] * (1_000_000_000 * tf // (1000 * tf + 8 * m)))
            held["places"].append(np.repeat(np.arange(len(counts)) + len(held["doc_ids"]), counts))
            held["doc_ids"] += batch.column("doc_id").to_pylist()
            size += len(terms)
            if size >= SEGMENT:
                flush()
            return iter(())

        def end() -> Iterator[dict]:
            flush()
            told = [(item, -d if some else None, score) for item, b in best.items() for score, some, d in b.heap if score > 0]
            yield {"item": [t[0] for t in told], "doc_id": [t[1] for t in told], "score": [t[2] for t in told]}

        return work, end

    return map_rows(rows, make, "item bigint, doc_id bigint, score bigint")


def _ranked(found: DataFrame, group: list[str], top: int) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text", block: int = ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents with the highest scores above 0 for each item.

    Equal scores go by ascending doc_id, null last; each row is a document, repeated ones too. Documents and items without a
    term (null and empty texts among them) take no part; a repeated term of an item counts each time; items that repeat a row each get their ranks
    under one id only once. Of an item_id with several texts each text is searched, and the best documents of all of them are ranked. Other columns are ignored; empty tables give no
    rows. Items pass in blocks of ``block``, each one pass over all documents; only a block's items and its vocabulary reach the driver.
    """
    spark = docs.sparkSession
    docs = texts_of(docs, id_col, text_col)
    queries = texts_of(items, item_col, item_text_col).filter("text <> '' AND doc_id IS NOT NULL").distinct()
    number = F.row_number().over(Window.partitionBy("part").orderBy("doc_id", "text"))
    parts = max(1, -(-queries.count() // block))
    queries = materialise(queries.withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts))).withColumn("item", number))
    out = None
    for part in range(parts):
        texts = {r["item"]: (r["doc_id"], terms_of(r["text"])) for r in queries.filter(F.col("part") == part).collect()}
        vocabulary: dict[bytes, int] = {}
        for _, terms in texts.values():
            for term in terms:
                vocabulary.setdefault(term, len(vocabulary))
        wanted = {item: [(vocabulary[t], k) for t, k in Counter(terms).items()] for item, (_, terms) in texts.items() if terms}
        if not wanted and out is not None:
            continue
        rows = materialise(forward_rows(docs, vocabulary))
        n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        weights = np.full(len(vocabulary) + 1, weight(n, 0), np.int64)
        for r in rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # as many as the block's terms
            weights[r["term"]] = weight(n, r["count"])
        best = _segments(rows, wanted, weights, n, max(total, 1), top)
        best = _ranked(best.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS))), ["item", "salt"], top)
        names = queries.filter(F.col("part") == part).select("item", F.col("doc_id").alias("item_id"))
        best = materialise(best.join(F.broadcast(names), "item").select("item_id", "salt", "doc_id", "score"))
        discard(rows)
        out = best if out is None else out.unionByName(best)
    return _ranked(out, ["item_id"], top).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op13_search(spark, folder: str) -> DataFrame:
    return search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


_TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
SQL = rf"""
WITH words AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
items AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY item_id, term),
hits AS (SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM items) GROUP BY doc_id, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM hits, totals GROUP BY term, docs),
scores AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) AS BIGINT) AS score
  FROM items JOIN hits USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), totals GROUP BY item_id, doc_id
),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
