"""Toxicity: a learned lexicon, matched with errors, and windows of context.

1. Lexicon. Entries are words and stems (beginnings of words, written with a trailing ``*``) that speak for label 1 in the labelled
   rows outside quotation marks: the lower bound of their log-likelihood ratio is positive, and some toxic row holds them among its most telling ones.
2. Matching. The entries form a trie. A Levenshtein automaton runs over its nodes with as many edits as an entry forgives
   (a swap of neighbours is one edit). States are sets of (node, edits); their transitions are computed once and kept.
   Only entries that decide a text on their own forgive errors, more of them the longer they are. Words that
   clean labelled rows hold are spelt as meant, so they match exactly or not at all.
3. Context. The words around a match of a deciding entry, and whether quotation marks enclose it, tell abuse from quotation: each lifts or lowers the match's
   weight by what matches with it meant in the labelled rows.
4. Score. A logistic model of the strongest match, all matches together and the text's length. It is fitted on one half of the
   labelled rows with the lexicon of the other half, so that entries do not vouch for the rows they come from.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rekindle.llm.base import map_rows, table
from rekindle.llm.language import held_out
from rekindle.session import broadcast_if_small, discard, materialise

JOINTS = "@$*'’"  # between letters they belong to the word
TOKEN = re.compile(rf"\w+(?:[{JOINTS}]\w+)*")
PARTS = re.compile(f"({TOKEN.pattern})")  # splits into what stands between tokens and the tokens, in turn
QUOTED = re.compile(r"[\"“„«‹][^\"“”„«»‹›\n]{1,200}[\"“”»›]")
STEMS = (4, 5, 6)
PICKS = 8  # entries that a toxic row may nominate
HELD = 200_000  # counts that a task holds before it passes them on
REACH = 5  # words of context on each side
Z = 2.0
MOST_TOXIC, MOST_CLEAN = 20_000, 80_000
THRESHOLD = 0.7
QUOTE = "\""
#: Characters that open or close a quotation
MARKS = frozenset("\"“”„«»‹›")
#: Matches (toxic, clean) that stand for what is not yet seen: in quotation marks, and with a context word
QUOTED_PRIOR, WORD_PRIOR = (1.0, 4.0), 4.0


def edits_for(entry: str) -> int:
    """Errors that an entry forgives: none below 5 letters, one below 8 (and in stems of 6), else two."""
    if entry.endswith("*"):
        return 1 if len(entry) > 6 else 0
    return 0 if len(entry) < 5 else 1 if len(entry) < 8 else 2


@dataclass
class Node:
    children: dict[str, int] = field(default_factory=dict)
    word: str | None = None
    stem: str | None = None
    edits: int = 0  # most that an entry at or below this node forgives


class Matcher:
    """Levenshtein automaton over the trie of a lexicon; transitions are made when first needed.

    Entries with evidence of at least ``forgiving`` may be misspelt; the others, and those too short, are looked up as they are.
    """

    KEPT = 1_000_000  # nodes in all states that are remembered

    def __init__(self, entries: dict[str, float], forgiving: float = 0.0):
        self.nodes = [Node()]
        self.forgiven = {e: edits_for(e) for e, value in entries.items() if value >= forgiving and edits_for(e)}
        self.words = frozenset(e for e in entries if not e.endswith("*"))
        self.stems = [(n, found) for n in reversed(STEMS) if (found := frozenset(e[:-1] for e in entries if e.endswith("*") and len(e) == n + 1))]
        for entry, edits in sorted(self.forgiven.items()):
            at, stem = 0, entry.endswith("*")
            for c in entry[:-1] if stem else entry:
                self.nodes[at].edits = max(self.nodes[at].edits, edits)
                at = self.nodes[at].children.setdefault(c, len(self.nodes))
                if at == len(self.nodes):
                    self.nodes.append(Node())
            self.nodes[at].edits = max(self.nodes[at].edits, edits)
            if stem:
                self.nodes[at].stem = entry
            else:
                self.nodes[at].word = entry
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.moves: list[dict[str, int]] = []
        self.kept = 0
        self.first = self._number({(0, None): 0}, None)

    def _number(self, live: dict, stem: tuple[int, str] | None) -> int:
        """The state of these (node, letter of a swap still to come) -> edits, closed under letters left out of the word."""
        todo = list(live.items())
        while todo:
            (node, swap), edits = todo.pop()
            if swap is None:
                for child in self.nodes[node].children.values():
                    if edits < self.nodes[child].edits and edits + 1 < live.get((child, None), 9):
                        live[child, None] = edits + 1
                        todo.append(((child, None), edits + 1))
        for (node, swap), edits in live.items():
            entry = self.nodes[node].stem
            if entry and swap is None and edits <= self.forgiven[entry]:
                stem = min(stem or (9, ""), (edits, entry), key=lambda s: (s[0], -len(s[1]), s[1]))
        if not live and stem is None:
            return -1  # nothing can match any more
        key = (frozenset((n, s, e) for (n, s), e in live.items()), stem)
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(key)
            self.kept += 1 + len(live)
            self.moves.append({})
        return self.numbers[key]

    def _move(self, state: int, c: str) -> int:
        live: dict[tuple[int, str | None], int] = {}

        def reach(node: int, swap: str | None, edits: int) -> None:
            if edits <= self.nodes[node].edits and edits < live.get((node, swap), 9):
                live[node, swap] = edits

        places, stem = self.states[state]
        for node, swap, edits in places:
            if swap is not None:
                if c == swap:
                    reach(node, None, edits)
                continue
            reach(node, None, edits + 1)  # a letter too many
            for letter, child in self.nodes[node].children.items():
                reach(child, None, edits if letter == c else edits + 1)
                if letter != c and c in self.nodes[child].children:
                    reach(self.nodes[child].children[c], letter, edits + 1)  # two letters swapped
        return self._number(live, stem)

    def find(self, word: str) -> tuple[int, str] | None:
        """(edits, entry) of the match with the fewest edits; whole words before stems, then the longest stem, then by name."""
        if word in self.words:
            return 0, word
        for n, stems in self.stems:
            if word[:n] in stems and len(word) > n:
                return 0, word[:n] + "*"
        if self.kept > self.KEPT:
            self._forget()
        state, moves = self.first, self.moves
        for c in word:
            after = moves[state].get(c)
            if after is None:
                after = moves[state][c] = self._move(state, c)
            if after < 0:
                return None
            state = after
        places, stem = self.states[state]
        best = (stem[0], 1, stem[1]) if stem else None
        for node, swap, edits in places:
            entry = self.nodes[node].word
            if entry and swap is None and edits <= self.forgiven[entry] and (best is None or (edits, 0, entry) < best):
                best = (edits, 0, entry)
        return best and (best[0], best[2])


def keys_of(words) -> set[str]:
    """Words and stems of a text."""
    out = set(words)
    for n in STEMS:
        out.update([stem + "*" for stem in {word[:n] for word in words if len(word) > n}])
    return out


def used(text: str) -> set[str]:
    """Words and stems of a text outside quotation marks: what is quoted says nothing about the words that are meant."""
    return keys_of(set(tokens_of(QUOTED.sub(" ", text))))


def tokens_of(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


@dataclass
class Model:
    """Evidence of the entries, the least that forgives errors, words spelt as meant, weights of context, and the logistic model."""

    entries: dict[str, float] = field(default_factory=dict)
    forgiving: float = 0.0
    meant: frozenset[str] = frozenset()
    context: dict[str, float] = field(default_factory=dict)
    weights: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)
    constant: float | None = 0.0  # score of every text where there is nothing to learn from

    def decides(self, entry: str) -> bool:
        return self.entries[entry] >= self.forgiving


class Scorer:
    """Matches and scores of texts by a model."""

    KEPT = 200_000

    def __init__(self, model: Model):
        self.model, self.matcher = model, Matcher(model.entries, model.forgiving)
        self.seen: set[str] = set()
        self.found: dict[str, tuple[int, str]] = {}
        self.hits: set[str] = set()  # the keys of ``found``

    def hit(self, words: set[str]) -> set[str]:
        """The words that match an entry."""
        if len(self.seen) > self.KEPT:
            for kept in (self.seen, self.found, self.hits):
                kept.clear()
        new = words - self.seen
        self.seen |= new
        for word in new:
            found = self.matcher.find(word)
            if found and not (found[0] and word in self.model.meant):
                self.found[word] = found
                self.hits.add(word)
        return words & self.hits

    def matches(self, text: str) -> tuple[list[tuple[int, int, str, int]], int]:
        """(start, end, entry, edits) of all matches in code points of the lower-cased text, and the number of words."""
        parts = PARTS.split(text.lower())
        words = parts[1::2]
        hits = self.hit(set(words))
        if not hits:
            return [], len(words)
        ends = list(accumulate(map(len, parts)))
        return [(ends[2 * k], ends[2 * k + 1], *self.found[w][::-1]) for k, w in enumerate(words) if w in hits], len(words)

    @staticmethod
    def window(low: str, start: int, end: int) -> set[str]:
        """Context of a match: the words on both sides, and QUOTE if marks on both sides enclose it."""
        before, after = low[max(0, start - 24 * REACH):start], low[end:end + 24 * REACH]
        out = set(TOKEN.findall(before)[-REACH:] + TOKEN.findall(after)[:REACH])
        if sum(c in MARKS for c in before) % 2 and any(c in MARKS for c in after):
            out.add(QUOTE)
        return out

    def features(self, text: str, found: list[tuple[int, int, str, int]], n: int) -> tuple[float, float, float]:
        """Strongest match, sum over the distinct matched words, log of the number of words."""
        best: dict[str, float] = {}
        low = text.lower() if found else ""
        for start, end, entry, edits in found:
            value = self.model.entries[entry] * 0.8 ** edits
            if self.model.decides(entry):  # quotation lowers such a match, nothing lifts it above one without context
                tilt = sum(self.model.context.get(w, 0.0) for w in self.window(low, start, end))
                value *= 2 / (1 + math.exp(-min(tilt, 0.0)))
            word = low[start:end]
            best[word] = max(best.get(word, 0.0), value)
        return max(best.values(), default=0.0), sum(best.values()), math.log1p(n)

    def judged(self, text: str) -> tuple[float, list[tuple[int, int, str, int]]]:
        """Score and matches."""
        found, n = self.matches(text)
        if self.model.constant is not None:
            return self.model.constant, found
        z = float(np.dot(self.model.weights, (1.0, *self.features(text, found, n))))
        return 1 / (1 + math.exp(-max(min(z, 700), -700))), found


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (the constant first) of a logistic regression by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-3
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (weight * (y - p)) - penalty @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _sampled(labelled: DataFrame, toxic: int, clean: int, most_toxic: int, most_clean: int) -> DataFrame:
    """At most about ``most_toxic`` and ``most_clean`` labelled ids, by a hash of the id."""
    place = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30))
    limit = F.when(F.col("toxic") == 1, int(min(1.0, most_toxic / max(toxic, 1)) * (1 << 30))).otherwise(int(min(1.0, most_clean / max(clean, 1)) * (1 << 30)))
    return labelled.filter(place < limit).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2)).cast("int"))


def _key_counts(rows: DataFrame) -> DataFrame:
    """key, and the toxic and clean rows of each half that hold it (t0, t1, c0, c1)."""

    def make():
        counts = [Counter(), Counter(), Counter(), Counter()]  # by 2 * (label is 0) + half

        def told():
            names = list(set().union(*counts))
            out = {"key": names} | {c: [counts[i][k] for k in names] for i, c in enumerate(("t0", "t1", "c0", "c1"))}
            for c in counts:
                c.clear()
            yield out

        def work(batch):
            for text, toxic, half in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "half"))):
                counts[2 * (1 - toxic) + half].update(used(text))
                if sum(map(len, counts)) > HELD:
                    yield from told()

        return work, told

    found = map_rows(rows.select("text", "toxic", "half"), make, "key string, t0 bigint, t1 bigint, c0 bigint, c1 bigint")
    return found.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("t0", "t1", "c0", "c1")])


def evidence(t: Column, c: Column, toxic: int, clean: int) -> Column:
    """Lower bound of the log-likelihood ratio of a key that t of ``toxic`` and c of ``clean`` rows hold."""
    ratio = F.log((t + 0.5) / (toxic + 1.0)) - F.log((c + 0.5) / (clean + 1.0))
    return ratio - Z * F.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))


def _nominated(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Distinct keys among the PICKS most telling ones of some toxic row; of equal ones the longest."""

    def make():
        def work(batch):
            ids, keys = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                found = used(text)
                ids += [i] * len(found)
                keys += found
            yield {"row": np.array(batch.column("row").to_pylist(), np.int64)[ids], "key": keys}

        return work

    numbered = rows.filter("toxic = 1").select(F.xxhash64("doc_id", "text").alias("row"), "text")
    held = map_rows(numbered, make, "row bigint, key string").join(broadcast_if_small(keys), "key")
    best = held.groupBy("row").agg(F.slice(F.sort_array(F.collect_set(F.struct("e", F.length("key").alias("n"), "key")), False), 1, PICKS).alias("best"))
    return best.select(F.explode("best").alias("b")).select("b.key", "b.e").distinct()


def pruned(entries: dict[str, float]) -> dict[str, float]:
    """Without idle entries: those that a stem of more evidence covers, and stems that a longer entry of the same evidence covers."""
    cover = lambda entry: [entry[:n] + "*" for n in STEMS if len(entry.rstrip("*")) > n]
    idle = {stem for e, value in entries.items() for stem in cover(e) if entries.get(stem) == value}
    return {e: v for e, v in entries.items() if e not in idle and all(entries.get(stem, 0.0) <= v for stem in cover(e))}


def _near(rows: DataFrame, model: Model) -> frozenset[str]:
    """Words of clean labelled rows that the automaton would take for a misspelt entry."""
    share = rows.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(share.value)

        def work(batch):
            found = set()
            for text in batch.column("text").to_pylist():
                found |= {word for word in scorer.hit(set(tokens_of(text))) if scorer.found[word][0]}
            yield {"word": list(found)}

        return work

    found = map_rows(rows.filter("toxic = 0").select("text"), make, "word string").distinct()
    return frozenset(r["word"] for r in found.collect())  # near one of the entries, from the bounded sample


def _context(rows: DataFrame, model: Model) -> dict[str, float]:
    """Log-odds by which a context word, or quotation marks, shift what a match of a deciding entry means."""
    share = rows.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(share.value)

        def work(batch):
            counts = [Counter(), Counter()]
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                found, _ = scorer.matches(text)
                low = text.lower()
                for start, end, entry, _ in found:
                    if not share.value.decides(entry):
                        continue
                    counts[toxic].update(scorer.window(low, start, end) | {""})
            names = list(counts[0].keys() | counts[1].keys())
            yield {"word": names, "clean": [counts[0][w] for w in names], "toxic": [counts[1][w] for w in names]}

        return work

    found = map_rows(rows.select("text", "toxic"), make, "word string, clean bigint, toxic bigint")
    found = found.groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = {r["word"]: (r["toxic"], r["clean"]) for r in found.filter(f"clean >= 3 OR word IN ('', '{QUOTE}')").collect()}  # of the bounded sample
    toxic, clean = counts.pop("", (0, 0))
    base = (toxic + 1) / (toxic + clean + 2)
    quoted = counts.pop(QUOTE, (0, 0))
    odds = lambda t, c: math.log(t / c) - math.log(base / (1 - base))
    out = {w: odds(t + WORD_PRIOR * base, c + WORD_PRIOR * (1 - base)) for w, (t, c) in counts.items()}
    return {w: v for w, v in out.items() if abs(v) > 0.5} | {QUOTE: min(odds(quoted[0] + QUOTED_PRIOR[0], quoted[1] + QUOTED_PRIOR[1]), 0.0)}


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN) -> Model:
    """Model of the documents whose id is labelled (``doc_id``, ``toxic`` 0 or 1) in ``labels``.

    The classifier is fitted on at most about ``most_toxic`` labelled ids of label 1 and ``most_clean`` of label 0, chosen by a
    hash of the id; its lexicon holds at most PICKS entries per toxic row of these. Null ids and labels, and null and empty texts, teach
    nothing; an id with several labels counts as toxic if one of them says so; rows that repeat an id are all read. With labels of
    one kind only, every text scores that kind's share.
    """
    labelled = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.max(F.col("toxic").cast("int")).alias("toxic"))
    sums = labelled.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count(F.lit(1))).first()
    if not sums[0] or sums[0] == sums[1]:
        return Model(constant=float(bool(sums[0])))
    chosen = materialise(_sampled(labelled, sums[0], sums[1] - sums[0], most_toxic, most_clean))
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("text <> ''")
    rows = materialise(texts.join(F.broadcast(chosen), "doc_id"))  # a bounded number of ids
    sizes = {(r["toxic"], r["half"]): r["n"] for r in rows.groupBy("toxic", "half").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = ([sizes.get((x, h), 0) for h in (0, 1)] for x in (1, 0))
    if not sum(toxic) or not sum(clean):
        return Model(constant=float(sum(toxic) > 0))
    counts = materialise(_key_counts(rows).filter("t0 + t1 >= 2"))
    halves = [  # the lexicon that is kept, and the one that only the other half's calibration sees
        counts.select("key", evidence(F.col("t0") + F.col("t1"), F.col("c0") + F.col("c1"), sum(toxic), sum(clean)).alias("e")),
        counts.select("key", evidence(F.col("t0"), F.col("c0"), toxic[0], clean[0]).alias("e")),
    ]
    prior, models = math.log(sums[0] / (sums[1] - sums[0])), []
    for keys, part in zip(halves, (rows, rows.filter("half = 0"))):
        entries = {r["key"]: r["e"] for r in _nominated(part, keys.filter("e > 0")).collect()}  # at most PICKS for each sampled toxic row
        model = Model(pruned(entries), math.log(THRESHOLD / (1 - THRESHOLD)) - prior, constant=None)
        model.meant = _near(part, model)
        model.context = _context(part, model)
        models.append(model)
    model, half = models
    share = rows.sparkSession.sparkContext.broadcast(half)

    def make():
        scorer = Scorer(share.value)

        def work(batch):
            found = [scorer.features(t, *scorer.matches(t)) for t in batch.column("text").to_pylist()]
            yield {"a": [f[0] for f in found], "b": [f[1] for f in found], "c": [f[2] for f in found], "toxic": batch.column("toxic")}

        return work

    seen = map_rows(rows.filter("half = 1").select("text", "toxic"), make, "a double, b double, c double, toxic int").toArrow()  # of the bounded sample
    x = np.column_stack([np.array(seen.column(c).to_numpy()) for c in "abc"])
    y = seen.column("toxic").to_numpy().astype(float)
    if len(y) and 0 < y.sum() < len(y):
        share_of = {1: sums[0] / max(sum(toxic), 1), 0: (sums[1] - sums[0]) / max(sum(clean), 1)}  # ids that a sampled row stands for
        scale = np.where(y == 1, share_of[1], share_of[0])
        model.weights = tuple(logistic(x, y, scale * len(y) / scale.sum()).tolist())
    else:  # too few rows to calibrate: the entries alone
        model.weights = (prior, 1.0, 0.0, 0.0)
    discard(counts)
    discard(rows)
    discard(chosen)
    return model


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, score (0 to 1), matches (start, end, entry, edits) of each row; only id and text are read.

    Null and empty texts score as a text without matches and words. Texts are read whole; repeated rows get the same score;
    other columns are ignored; an empty table gives no rows.
    """
    share = df.sparkSession.sparkContext.broadcast(model)  # bounded by the sample it is fitted on

    def make():
        scorer = Scorer(share.value)

        def work(batch):
            for at in range(0, batch.num_rows, 1_000):  # matches of a thousand rows are held at once
                part = batch.slice(at, 1_000)
                judged = [scorer.judged(text or "") for text in part.column("text").to_pylist()]
                columns = list(zip(*(m for _, found in judged for m in found))) or [()] * 4
                arrays = [pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.int32()))]
                ends = np.cumsum([0] + [len(found) for _, found in judged])
                matches = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(arrays, ["start", "end", "entry", "edits"]))
                yield {"doc_id": part.column("doc_id"), "text": part.column("text"), "score": [s for s, _ in judged], "matches": matches}

        return work

    rows = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_rows(rows, make, "doc_id bigint, text string, score double, matches array<struct<start: bigint, end: bigint, entry: string, edits: int>>")


def op11_toxicity(spark, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = train(docs, labels.filter(~held_out()))
    found = predict(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("matches").alias("n_matches"))
