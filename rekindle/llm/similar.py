"""N-gram Jaccard join: grouped prefixes, exact verification, connected components.

A document is the set of its distinct word n-grams, as 64-bit hashes. In one global order, from rare to frequent, two sets
that are similar enough share a token of their prefixes. Documents with the same set fall into one class and
classes with the same prefix and size into one group, so copies meet only once. Groups that share a prefix
token are compared in two ways. First each group meets one centre per token, which links nearly all near copies without forming
their pairs. Then every pair of classes that shares a token, still lies in two components and may be similar is formed.
Parity bitmaps give an exact lower bound of the difference, which drops the other pairs before texts are compared.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rekindle.llm.base import map_rows, table, texts_of
from rekindle.llm.components import merged
from rekindle.llm.fingerprints import ODD, mixed
from rekindle.session import discard, materialise

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class Measure:
    """Words per n-gram, and the least Jaccard similarity as a fraction of whole numbers."""

    words: int = 4
    part: int = 85
    whole: int = 100

    def linked(self, both: int, a: int, b: int) -> bool:
        return self.whole * both >= self.part * (a + b - both)

    def most_different(self, a, b):
        """Largest symmetric difference of two similar sets of these sizes."""
        return a + b - 2 * -(-self.part * (a + b) // (self.part + self.whole))

    def prefix(self, n: int) -> int:
        return n - -(-self.part * n // self.whole) + 1

    def sizes_fit(self, a: Column, b: Column) -> Column:
        return (F.least(a, b) * self.whole) >= (F.greatest(a, b) * self.part)


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of lower-cased words; fewer words are one n-gram, none give nothing."""
    found = text.encode().translate(LOWER).split()  # bytes split at 20 and 09-0D only
    if not found:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    size = min(words, len(found))
    out = np.full(len(found) - size + 1, size, np.uint64)
    for i in range(size):
        out = mixed(out * ODD[0] + hashes[i:len(found) - size + 1 + i])
    return np.unique(out)


def parity(tokens: np.ndarray) -> np.ndarray:
    """Bit string of a power-of-two length near the set's size; each token flips the bit its low bits name."""
    bits = 1 << max(6, (len(tokens) - 1).bit_length())
    return np.packbits(np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little")


def sketch(tokens: np.ndarray) -> np.ndarray:
    """The same parities in a fixed length, 512 bits as eight numbers."""
    return np.packbits(np.bincount((tokens & np.uint64(511)).astype(np.int64), minlength=512) & 1, bitorder="little").view(np.int64)


def least_different(a: np.ndarray, b: np.ndarray) -> int:
    """Lower bound of the symmetric difference; the longer string is folded, which keeps parities."""
    while len(a) > len(b):
        a = a[:len(a) // 2] ^ a[len(a) // 2:]
    while len(b) > len(a):
        b = b[:len(b) // 2] ^ b[len(b) // 2:]
    return int(np.bitwise_count(a ^ b).sum())


def frequent_tokens(docs: DataFrame, measure: Measure, sample_rows: int = 16_000, least: int = 4, most: int = 300_000) -> tuple[np.ndarray, np.ndarray]:
    """Sorted tokens in at least ``least`` of about ``sample_rows`` documents, and their counts; at most ``most``.

    They only shape the global order (frequent ones last). Any order gives the same links, a good one fewer comparisons.
    """
    total = docs.count()
    if total > sample_rows:
        docs = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(sample_rows / total * (1 << 30)))

    def make():
        def work(batch):
            found = [shingles(t, measure.words) for t in batch.column("text").to_pylist()]
            tokens, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), [])
            yield {"token": tokens.view(np.int64), "n": n}

        return work

    counts = map_rows(docs, make, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    found = counts.orderBy(F.desc("n"), "token").limit(most).select("token", "n").toArrow()
    tokens, n = (np.array(found.column(c).to_numpy()) for c in ("token", "n"))
    order = np.argsort(tokens)
    return tokens[order], n[order]


def profiles(docs: DataFrame, measure: Measure, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, n, d1, d2 (digest of the set), prefix (tokens in global order), bits and sketch (parity strings)."""
    share = docs.sparkSession.sparkContext.broadcast(frequent)  # bounded by ``most``

    def make():
        known, ranks = share.value

        def work(batch):
            out = {c: [] for c in ("n", "d1", "d2", "prefix", "bits", "sketch")}
            for text in batch.column("text").to_pylist():
                tokens = shingles(text, measure.words)
                digest = xxhash.xxh3_128_intdigest(tokens.tobytes())
                signed = tokens.view(np.int64)
                count = np.zeros(len(tokens), np.int64)
                if len(known) and len(tokens):
                    at = np.minimum(np.searchsorted(known, signed), len(known) - 1)
                    count = np.where(known[at] == signed, ranks[at], 0)
                take = measure.prefix(len(tokens)) if len(tokens) else 0
                first = np.lexsort((tokens, count))[:take]
                out["n"].append(len(tokens))
                out["d1"].append((digest >> 64) - (1 << 63))
                out["d2"].append((digest & (1 << 64) - 1) - (1 << 63))
                out["prefix"].append(signed[first])
                out["bits"].append(parity(tokens).tobytes())
                out["sketch"].append(sketch(tokens))
            yield {"doc_id": batch.column("doc_id")} | out

        return work

    return map_rows(docs, make, "doc_id bigint, n int, d1 bigint, d2 bigint, prefix array<bigint>, bits binary, sketch array<bigint>")


class Join:
    """The tables of one join: profiles of documents, classes of equal sets, postings of shared prefix tokens."""

    def __init__(self, docs: DataFrame, measure: Measure):
        self.docs, self.measure = docs, measure
        self.profiles = materialise(profiles(docs, measure, frequent_tokens(docs, measure)))
        known = self.profiles.filter("n > 0 AND doc_id IS NOT NULL")
        self.classes = materialise(known.groupBy("d1", "d2").agg(
            F.min("doc_id").alias("cls"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits"), F.first("sketch").alias("sketch"),
        ))
        # groups of equal prefix and size have one posting per token, under their smallest class
        grouped = self.classes.withColumns({"g1": F.xxhash64("n", "prefix"), "g2": F.xxhash64("prefix", "n")})
        heads = grouped.groupBy("g1", "g2").agg(F.min(F.struct("cls", "n", "prefix")).alias("g"))
        self.members = materialise(grouped.join(heads, ["g1", "g2"]).select(F.col("g.cls").alias("head"), "cls"))
        heads = heads.select("g.*")
        rows = heads.select("cls", "n", F.posexplode("prefix").alias("pos", "token"))
        shared = rows.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("token"))).filter("df > 1").drop("df")
        self.postings = materialise(shared)
        # a text without edits of its own shares most of its prefix with its near copies: a good centre for them
        share = F.count(F.lit(1)) / F.first(F.lit(self.measure.part) * F.col("n"))
        self.central = materialise(self.postings.groupBy("cls").agg(share.alias("share")))
        self.tables = [self.profiles, self.classes, self.members, self.postings, self.central]

    def close(self) -> None:
        for df in self.tables:
            discard(df)

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Those (a, b) of ``pairs`` whose sets are similar."""
        measure = self.measure
        side = lambda k: self.classes.select(F.col("cls").alias(k), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"bits{k}"))
        sized = pairs.join(side("a"), "a").join(side("b"), "b").filter(measure.sizes_fit(F.col("na"), F.col("nb")))

        def make_filter():
            def work(batch):
                cols = [batch.column(c).to_pylist() for c in ("na", "nb", "bitsa", "bitsb")]
                keep = [
                    least_different(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)) <= measure.most_different(m, n)
                    for m, n, x, y in zip(*cols)
                ]
                at = np.flatnonzero(keep)
                yield {"a": batch.column("a").take(at), "b": batch.column("b").take(at)}

            return work

        near = materialise(map_rows(sized, make_filter, "a bigint, b bigint"))
        wanted = near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        if near.count() * 2 <= BROADCAST_ROWS:
            wanted = F.broadcast(wanted)
        texts = materialise(self.docs.join(wanted, "doc_id", "left_semi"))
        text = lambda k: texts.select(F.col("doc_id").alias(k), F.col("text").alias(f"text{k}"))
        full = near.join(text("a"), "a").join(text("b"), "b")

        def make_check():
            kept: dict[str, np.ndarray] = {}

            def tokens(t: str) -> np.ndarray:
                if t not in kept:
                    while len(kept) > 16:
                        kept.pop(next(iter(kept)))
                    kept[t] = shingles(t, measure.words)
                return kept[t]

            def work(batch):
                keep = []
                for x, y in zip(batch.column("texta").to_pylist(), batch.column("textb").to_pylist()):
                    s, t = tokens(x), tokens(y)
                    keep.append(measure.linked(len(np.intersect1d(s, t, assume_unique=True)), len(s), len(t)))
                at = np.flatnonzero(keep)
                yield {"a": batch.column("a").take(at), "b": batch.column("b").take(at)}

            return work

        out = materialise(map_rows(full, make_check, "a bigint, b bigint"))
        discard(near)
        discard(texts)
        return out

    def placed(self, rows: DataFrame, roots: DataFrame | None) -> DataFrame:
        """``rows`` with the component of their cls."""
        if roots is None:
            return rows.withColumn("comp", F.col("cls"))
        return rows.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("comp", F.coalesce("root", "cls")).drop("root")

    def member_pairs(self) -> DataFrame:
        """Classes of equal prefix and size against the first class of their group."""
        return self.members.filter("head <> cls").select(F.col("head").alias("a"), F.col("cls").alias("b"))

    def group_pairs(self, roots: DataFrame | None) -> DataFrame:
        """Pairs inside a group that lie in different components."""
        return self._crossing(self.placed(self.members, roots).select(F.col("head").alias("token"), "cls", "comp", F.lit(0).alias("pos")))

    def star_pairs(self) -> DataFrame:
        """Each posting against the class of its token and size band that shares most of its own prefix."""
        band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(self.measure.whole / self.measure.part)))
        rows = self.postings.join(self.central, "cls").withColumn("band", band)
        centre = F.min(F.struct(-F.col("share"), "cls")).over(Window.partitionBy("token", "band"))["cls"]
        return self._pairs(rows.withColumn("centre", centre).filter("centre <> cls"), "cls", "centre")

    def sampled_pairs(self, roots: DataFrame, salt: int) -> DataFrame:
        """Each posting outside the largest component of its token and size band against one random class inside."""
        band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(self.measure.whole / self.measure.part)) + F.lit(salt / 2))
        rows = self.placed(self.postings, roots).withColumn("band", band)
        several = self._largest(rows, "token", "band")
        inside = F.min(F.when(F.col("comp") == F.col("major"), F.struct(F.xxhash64("token", "cls", F.lit(salt)).alias("h"), "cls")))
        rows = rows.join(several, ["token", "band"])
        rows = rows.withColumn("centre", inside.over(Window.partitionBy("token", "band"))["cls"]).filter("comp <> major")
        return self._pairs(rows, "cls", "centre")

    @staticmethod
    def _pairs(rows: DataFrame, x: str, y: str) -> DataFrame:
        return rows.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()

    @staticmethod
    def _largest(rows: DataFrame, *keys: str) -> DataFrame:
        """keys, major: the component with most rows, of keys with several components."""
        counts = rows.groupBy(*keys, "comp").agg(F.count(F.lit(1)).alias("rows"))
        found = counts.groupBy(*keys).agg(F.max(F.struct("rows", "comp")).alias("m"), F.count(F.lit(1)).alias("comps"))
        return found.filter("comps > 1").select(*keys, F.col("m.comp").alias("major"))

    def cross_pairs(self, roots: DataFrame | None) -> DataFrame:
        """All pairs of classes that share a token in places where they can be similar, and lie in different components."""
        rows = self.postings.select(F.col("cls").alias("head"), "token", "pos").join(self.members, "head").drop("head")
        return self._crossing(self.placed(rows, roots))

    def _crossing(self, rows: DataFrame) -> DataFrame:
        """Pairs of equal token and different component that their positions, sizes and sketches allow to be similar."""
        rows = rows.join(self.classes.select("cls", "n", "sketch"), "cls")
        rows = rows.join(self._largest(rows, "token"), "token")
        # pairs inside the largest component of a token are not even looked at
        left = rows.filter("comp <> major").select("token", *[F.col(c).alias(f"{c}_x") for c in ("cls", "n", "pos", "comp", "sketch")])
        right = rows.select("token", "major", *[F.col(c).alias(f"{c}_y") for c in ("cls", "n", "pos", "comp", "sketch")])
        need = F.ceil((F.col("n_x") + F.col("n_y")) * self.measure.part / (self.measure.part + self.measure.whole) - 1e-6)
        most = F.least(F.col("n_x") - F.col("pos_x"), F.col("n_y") - F.col("pos_y"))
        differ = F.aggregate(F.zip_with("sketch_x", "sketch_y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, n: acc + n)
        on = (left["token"] == right["token"]) & (F.col("comp_x") != F.col("comp_y"))
        on = on & ((F.col("comp_y") == F.col("major")) | (F.col("cls_x") < F.col("cls_y")))
        on = on & self.measure.sizes_fit(F.col("n_x"), F.col("n_y")) & (most >= need) & (differ <= F.col("n_x") + F.col("n_y") - 2 * need)
        return self._pairs(left.join(right, on), "cls_x", "cls_y")


def link(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", measure: Measure | None = None, sampled_rounds: int = 1) -> DataFrame:
    """doc_id, n_shingles, component_id of each document; component_id is the smallest doc_id reachable by links.

    Two documents link when their sets have at least the measure's similarity. Null and empty texts have an empty set, which links with
    nothing: they are components of their own. A row without doc_id is linked with nothing and has no component; rows that share a doc_id
    are one node. Other columns are ignored, an empty table gives no rows. Texts are read whole.
    """
    measure = measure or Measure()
    docs = texts_of(df, id_col, text_col)
    job = Join(docs, measure)
    roots = None
    steps = [lambda r: job.member_pairs().unionByName(job.star_pairs())]
    steps += [lambda r, s=s: job.sampled_pairs(r, s) for s in range(sampled_rounds)]
    steps += [lambda r: job.group_pairs(r).unionByName(job.cross_pairs(r))]
    for pairs_of in steps:
        roots = merged(roots, job.verified(pairs_of(roots)))
    known = job.profiles.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), "d1", "d2")
    owner = job.classes.select("d1", "d2", "cls").join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("d1", "d2", F.coalesce("root", "cls").alias("component"))
    out = known.join(owner, ["d1", "d2"], "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id")
    )
    return out


def op7_jaccard(spark, folder: str) -> DataFrame:
    return link(table(spark, folder, "documents"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_distinct([array_to_string(words[i:i + 3], ' ') FOR i IN range(1, len(words) - 2)]) END AS grams
  FROM w
), g AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
met AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared, any_value(x.n + y.n) AS total
  FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM met WHERE 100 * shared >= 85 * (total - shared)
), sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id, doc_id AS root FROM s
  UNION SELECT sides.b, reach.root FROM reach JOIN sides ON sides.a = reach.doc_id
), least_root AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.grams) AS BIGINT) AS n_shingles, component_id FROM s JOIN least_root USING (doc_id)
"""
