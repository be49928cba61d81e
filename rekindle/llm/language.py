"""Language identification: known words first, then character n-grams that get shorter.

A word of the model scores by its log frequency in each language. A word that the model does not hold
backs off: its longest n-grams that are known score, n falling from 5 to 1. A text's score is the sum over all
its words.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rekindle.llm.base import map_rows, table
from rekindle.session import discard, local_table, materialise

WORD = re.compile(r"[^\W\d_]+")
LONGEST = 5
HELD = 100_000  # counts that a task holds before it passes them on
UNKNOWN = "und"


@dataclass
class Model:
    """Languages, and rows of log frequencies per language of words and n-grams (``^`` and ``$`` mark the ends of a word)."""

    languages: list[str]
    words: dict[str, int]
    word_logs: np.ndarray
    grams: dict[str, int]
    gram_logs: np.ndarray


def grams_of(word: str, n: int) -> list[str]:
    marked = f"^{word}$"
    return [marked[i:i + n] for i in range(len(marked) - n + 1)]


def _count_words(rows: DataFrame) -> DataFrame:
    def make():
        counts: dict[str, Counter] = {}

        def told():
            flat = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
            counts.clear()
            yield {"lang": [f[0] for f in flat], "key": [f[1] for f in flat], "n": [f[2] for f in flat]}

        def work(batch):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                counts.setdefault(lang, Counter()).update(WORD.findall(text.lower()))
            if sum(map(len, counts.values())) > HELD:
                yield from told()

        return work, told

    return map_rows(rows, make, "lang string, key string, n bigint").groupBy("lang", "key").agg(F.sum("n").alias("n"))


def _count_grams(words: DataFrame) -> DataFrame:
    def make():
        def work(batch):
            counts: Counter = Counter()
            for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "key", "n"))):
                if len(word) <= 64:  # longer ones are no words of a language
                    for size in range(1, LONGEST + 1):
                        for gram in grams_of(word, size):
                            counts[lang, gram] += n
            yield {"lang": [k[0] for k in counts], "key": [k[1] for k in counts], "n": list(counts.values())}

        return work

    return map_rows(words, make, "lang string, key string, n bigint").groupBy("lang", "key").agg(F.sum("n").alias("n"))


def _bucket() -> Column:
    """Number that grows with a count: exact below 1024, in steps of 0.4 % above."""
    return F.when(F.col("n") < 1024, F.col("n")).otherwise(1024 + F.floor(F.log(F.col("n") / 1024.0) * 256)).cast("int")


def _shares(sizes: dict[str, int], most: int) -> dict[str, int]:
    """Equal parts of ``most``; what a language with fewer keys leaves over goes to the others."""
    out, left = {}, most
    for done, lang in enumerate(sorted(sizes, key=lambda x: (sizes[x], x))):
        out[lang] = min(sizes[lang], left // (len(sizes) - done))
        left -= out[lang]
    return out


def _kept(counts: DataFrame, most: int) -> pa.Table:
    """lang, key, n of the keys that are frequent enough in some language, in all languages.

    Each language gives its most frequent keys within its share of ``most``, and of equally frequent ones all or none.
    """
    spans: dict[str, list[tuple[int, int]]] = {}
    for r in counts.groupBy("lang", _bucket().alias("b")).agg(F.count(F.lit(1)).alias("keys")).collect():
        spans.setdefault(r["lang"], []).append((r["b"], r["keys"]))
    shares = _shares({lang: sum(k for _, k in found) for lang, found in spans.items()}, most)
    least = []
    for lang, found in spans.items():
        taken, bound = 0, None
        for b, keys in sorted(found, reverse=True):
            taken += keys
            if taken > shares[lang]:
                break
            bound = b
        if bound is not None:
            least.append((lang, bound))
    limits = local_table(counts.sparkSession, least, "lang string, least int")  # a row for each language
    chosen = counts.join(F.broadcast(limits), "lang").filter(_bucket() >= F.col("least")).select("key").distinct()
    return counts.join(F.broadcast(chosen), "key", "left_semi").select("lang", "key", "n").toArrow()  # chosen: at most ``most``


def _totals(counts: DataFrame, group: Column) -> dict[tuple[str, int], int]:
    found = counts.groupBy("lang", group.alias("g")).agg(F.sum("n").alias("n")).collect()
    return {(r["lang"], r["g"]): r["n"] for r in found}


def _logs(rows: pa.Table, totals: dict[tuple[str, int], int], languages: list[str], group) -> tuple[dict[str, int], np.ndarray]:
    """Log of (n + 1/2) over the language's full total plus 1/2 for each key, within each group of keys (all words; n-grams of one length).

    A key that a language does not hold so has comparable mass in large and small languages.
    """
    coded = rows.column("key").combine_chunks().dictionary_encode()
    keys = coded.dictionary.to_pylist()
    counts = np.zeros((len(keys), len(languages)))
    at = pc.index_in(rows.column("lang"), value_set=pa.array(languages, pa.string())).to_numpy()
    counts[coded.indices.to_numpy(), at] = rows.column("n").to_numpy()
    groups = np.fromiter(map(group, keys), np.int64, len(keys))
    sizes = np.bincount(groups)
    full = np.array([[totals.get((lang, g), 0) for lang in languages] for g in range(len(sizes))], float).reshape(len(sizes), len(languages))
    logs = np.log((counts + 0.5) / (full + 0.5 * sizes[:, None])[groups]) if keys else counts
    return dict(zip(keys, range(len(keys)))), logs.astype(np.float32)


def train(labelled: DataFrame, max_words: int = 100_000, max_grams: int = 150_000) -> Model:
    """Model of all rows (lang, text) with non-null lang and text.

    Bounds, both parameters: the model holds at most ``max_words`` words and ``max_grams`` n-grams, each language's most
    frequent ones in equal shares. They bound what the driver and the tasks hold; words beyond them are scored through
    their n-grams. Every language that has a word is in the model.
    """
    labelled = labelled.filter("lang IS NOT NULL AND text IS NOT NULL")
    words = materialise(_count_words(labelled))
    sums = _totals(words, F.lit(0))
    languages = sorted({lang for lang, _ in sums})
    known = _logs(_kept(words, max_words), sums, languages, lambda k: 0)
    grams = materialise(_count_grams(words))
    shorter = _logs(_kept(grams, max_grams), _totals(grams, F.length("key")), languages, len)
    discard(words)
    discard(grams)
    return Model(languages, *known, *shorter)


class Scorer:
    """Scores texts; words that the model does not hold are scored by their n-grams once and kept for a while."""

    KEPT = 200_000

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.index = dict(self.model.words)
        self.rows = self.model.word_logs

    def _learn(self, words: list[str]) -> None:
        flat, counts, grams = [], [], self.model.grams
        for word in words:
            known: list[int] = []
            for n in range(min(LONGEST, len(word) + 2), 0, -1):
                known = [grams[g] for g in grams_of(word, n) if g in grams]
                if known:
                    break
            flat += known
            counts.append(len(known))
        counts = np.array(counts)
        logs = np.zeros((len(words), self.rows.shape[1]), np.float32)
        some = np.flatnonzero(counts)
        if len(some):
            starts = (np.cumsum(counts) - counts)[some]
            logs[some] = np.add.reduceat(self.model.gram_logs[flat], starts, axis=0) / counts[some, None]
        size = len(self.index)
        if size + len(words) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((len(words) + (1 << 15), self.rows.shape[1]), np.float32)])
        self.rows[size:size + len(words)] = logs
        self.index.update(zip(words, range(size, size + len(words))))

    def predict(self, text: str | None) -> tuple[str, float]:
        words = WORD.findall(text.lower()) if text else []
        if not words or not self.model.languages or not any(c.isalpha() for w in words for c in w):
            return UNKNOWN, 0.0
        if len(self.index) > len(self.model.words) + self.KEPT:
            self._forget()
        missing = [w for w in set(words) if w not in self.index]
        if missing:
            self._learn(missing)
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        total = self.rows[at].sum(axis=0, dtype=np.float64)
        best = int(total.argmax())  # ties: the first language in order of name
        return self.model.languages[best], float(1.0 / np.exp(np.maximum(total - total[best], -700)).sum())


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, lang_pred, score of each row; only id and text are read.

    ``und`` with score 0 if the text is null or has no letter, or if no language was learned. The score is the posterior of
    the language under equal priors. Texts are read whole; repeated rows get the same answer.
    """
    share = df.sparkSession.sparkContext.broadcast(model)  # bounded by max_words and max_grams

    def make():
        scorer = Scorer(share.value)

        def work(batch):
            texts = batch.column("text")
            told = []
            for text in texts.to_pylist():
                told.append(scorer.predict(text))
            yield {"doc_id": batch.column("doc_id"), "text": texts, "lang_pred": [t[0] for t in told], "score": [t[1] for t in told]}

        return work

    rows = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_rows(rows, make, "doc_id bigint, text string, lang_pred string, score double")


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def learn(docs: DataFrame) -> Model:
    """Model of the documents that are not held out and have a language."""
    return train(docs.filter(~held_out()).select("lang", "text"))


def op6_language(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return predict(docs, learn(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
