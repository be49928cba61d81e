"""Packing token sequences: first-fit decreasing with a tournament tree, in randomised groups of documents.

Each document is tokenised once. Groups are chosen by a hash, so that every group holds a like mix of lengths
and about the same number of tokens. Within a group full sequences are cut off first, the remainders go first-fit
decreasing into bins, gaps worth a cut are filled from the emptiest bins, and the one bin that stays partly empty is cut
into powers of two, which need no padding.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from rekindle.llm.base import map_rows, pieces_of, ragged, schema_of, table, texts_of

CHUNK = re.compile(r"[^ \t\n\r]+")
#: texts in which lower-casing and the split below are the tokenizer's own, and its split of them into words
PLAIN = re.compile(r"[\x00-\x1b\x20-\x7eÀ-ÖØ-öø-ÿ]*")
WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
LINE = 0  # code of the line ends between chunks
WORD_OR_LINE = re.compile(WORD.pattern + r"|\n")
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, `offset` bigint"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Codes(dict):
    """word -> number, given in order of first use; ``new`` are the words that no ids are known for yet."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = code = len(self)
        self.new.append(word)
        return code


class Words:
    """Token ids of texts; each distinct word is tokenised once and kept for a while.

    Words are those of the tokenizer's own split where that is sure to be known (plain Latin text), else runs of non-space characters.
    Only for tokenizers that drop white space and never join tokens across it, as word-piece tables with word ends do.
    """

    KEPT = 500_000
    GROUP = 4_000_000  # characters whose distinct chunks are looked up together
    JOINED, AT_ONCE = 256, 16_384  # words that are tokenised as one text, and in one call

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        table = json.loads(self.tokenizer.to_str())
        split = json.dumps(table.get("pre_tokenizer") or {})
        self.known_split = r"'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in split
        suffix = table["model"].get("end_of_word_suffix")
        vocabulary = self.tokenizer.get_vocab()
        self.ends = None
        if suffix:
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[n for token, n in vocabulary.items() if token.endswith(suffix)]] = True
        self._forget()

    def plain(self, text: str) -> bool:
        return self.known_split and "<|" not in text and bool(PLAIN.fullmatch(text))

    def _forget(self) -> None:
        self.code = Codes()
        self.code["\n"] = LINE
        self.begin, self.count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.flat, self.used = np.zeros(1 << 18, self.width), 0

    def _tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and their number in each."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), self.width, int(counts.sum())), counts

    def _word_tokens(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of the known split; joined by spaces they are far cheaper, and word ends tell them apart."""
        if self.ends is not None:
            texts = [" ".join(words[k:k + self.JOINED]) for k in range(0, len(words), self.JOINED)]
            step = self.AT_ONCE // self.JOINED
            ids = np.concatenate([self._tokens(texts[k:k + step])[0] for k in range(0, len(texts), step)])
            last = np.flatnonzero(self.ends[ids])
            if len(last) == len(words) and last[-1] == len(ids) - 1:
                return ids, np.diff(last, prepend=-1)
        return self._tokens(words)

    def _learn(self, tokens: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> None:
        if not self.code.new:
            return
        ids, counts = tokens(self.code.new)
        size, need = len(self.code), self.used + len(ids)
        while need > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        while size > len(self.begin):
            self.begin, self.count = np.resize(self.begin, 2 * len(self.begin)), np.resize(self.count, 2 * len(self.count))
        self.flat[self.used:need] = ids
        self.begin[size - len(counts):size], self.count[size - len(counts):size] = np.cumsum(counts) - counts + self.used, counts
        self.used, self.code.new = need, []

    def _ids(self, codes: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """Ids of the texts whose words end before the places ``ends`` of ``codes``."""
        counts = self.count[codes]
        ids = self.flat[ragged(self.begin[codes], counts)]
        return np.split(ids, np.append(0, np.cumsum(counts))[ends[:-1]])

    def _plain_ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of plain texts: split at white space, of which every distinct chunk is split into words once."""
        lists = pc.ascii_split_whitespace(pa.array([t.lower() for t in texts], pa.large_string()))
        chunks = lists.flatten().dictionary_encode()
        words = WORD_OR_LINE.findall("".join(f"{c}\n" for c in chunks.dictionary.to_pylist()))
        codes = np.fromiter(map(self.code.__getitem__, words), np.int64, len(words))
        self._learn(self._word_tokens)
        upto = np.flatnonzero(codes == LINE) + 1  # a chunk's words end with the line, which has no ids
        sizes = np.diff(upto, prepend=0)
        at = chunks.indices.to_numpy()
        words_of = codes[ragged((upto - sizes)[at], sizes[at])]
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        return self._ids(words_of, np.append(0, np.cumsum(sizes[at]))[offsets[1:]])

    def _other_ids(self, texts: list[str]) -> list[np.ndarray]:
        codes = [np.fromiter(map(self.code.__getitem__, CHUNK.findall(t)), np.int64) for t in texts]
        self._learn(self._tokens)
        return self._ids(np.concatenate(codes), np.cumsum([len(c) for c in codes]))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, without special tokens."""
        out: list[np.ndarray] = [None] * len(texts)
        for group in pieces_of(texts, self.GROUP):
            if len(self.code) > self.KEPT:
                self._forget()
            plain, other = [], []
            for k in range(group.start, group.stop):
                (plain if self.plain(texts[k]) else other).append(k)
            for places, ids_of in ((plain, self._plain_ids), (other, self._other_ids)):
                if places:
                    for k, ids in zip(places, ids_of([texts[k] for k in places])):
                        out[k] = ids
        return out


class Tournament:
    """Remaining capacities of bins; finds the first bin with room for a piece in logarithmic time."""

    def __init__(self, bins: int, capacity: int):
        self.size = 1 << max(0, bins - 1).bit_length()
        self.best = [capacity] * (2 * self.size)

    def place(self, need: int) -> int:
        best, at = self.best, 1
        while at < self.size:
            at *= 2
            if best[at] < need:
                at += 1
        found = at - self.size
        best[at] -= need
        while at > 1:
            at //= 2
            best[at] = max(best[2 * at], best[2 * at + 1])
        return found


def pack(lengths: list[int], capacity: int, least: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) that hold each token once; ``least`` is the smallest gap that is filled by a cut."""
    done, rest = [], []
    for doc, n in enumerate(lengths):
        done += [[(doc, s, capacity)] for s in range(0, n - capacity + 1, capacity)]
        if n % capacity:
            rest.append((doc, n - n % capacity, n % capacity))
    rest.sort(key=lambda p: -p[2])
    tree, bins = Tournament(len(rest), capacity), []
    for piece in rest:
        at = tree.place(piece[2])
        if at == len(bins):
            bins.append([])
        bins[at].append(piece)
    fill = lambda b: sum(p[2] for p in b)
    bins.sort(key=fill, reverse=True)
    room = [capacity - fill(b) for b in bins]
    i, j = 0, len(bins) - 1
    while i < j:
        if room[i] < least:
            i += 1
            continue
        doc, start, n = bins[j].pop()
        cut = min(n, room[i])
        bins[i].append((doc, start, cut))
        room[i] -= cut
        room[j] += cut
        if n > cut:
            bins[j].append((doc, start + cut, n - cut))
        if not bins[j]:
            bins.pop()
            j -= 1
    if bins and room[len(bins) - 1] >= least:  # at most one: powers of two need no padding
        last = bins.pop()
        left = fill(last)
        while left:
            need = 1 << (left.bit_length() - 1)
            left -= need
            bins.append([])
            while need:
                doc, start, n = last.pop(0)
                cut = min(n, need)
                bins[-1].append((doc, start, cut))
                need -= cut
                if n > cut:
                    last.insert(0, (doc, start + cut, n - cut))
    return done + bins


def tokenise(docs: DataFrame, path: str, end_id: int, groups: int) -> DataFrame:
    """grp, doc_id, ids (packed little-endian unsigned integers, ``end_id`` last) of each document."""

    def make():
        words = Words(path)

        def work(batch):
            ids = [np.append(i, np.array(end_id, words.width)).tobytes() for i in words.encode(batch.column("text").to_pylist())]
            yield {"grp": batch.column("grp"), "doc_id": batch.column("doc_id"), "ids": ids}

        return work

    placed = docs.withColumn("grp", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int"))
    return map_rows(placed, make, "grp int, doc_id bigint, ids binary")


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = 4096,
                   end_id: int = 2, group_bytes: int = 8_000_000, least: int = 16) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and ``end_id``; null and empty texts are the end alone. Groups hold about ``group_bytes`` of text each, at any
    size of the table; rows of equal id and text share a group, other columns are ignored, an empty table gives no
    pieces. Texts of any length are cut. A gap below ``least`` tokens stays as padding rather than cut a document for it.
    """
    docs = texts_of(df, id_col, text_col)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-size // group_bytes))
    path = tokenizer or default_tokenizer()
    target = to_arrow_schema(schema_of(PIECES))
    width = Words(path).width

    def packed(rows: pa.Table) -> pa.Table:
        ids = [np.frombuffer(b, width) for b in rows.column("ids").to_pylist()]
        names = rows.column("doc_id").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (-len(ids[i]), names[i] is None, names[i] or 0, ids[i].tobytes()))
        ids, names = [ids[i] for i in order], [names[i] for i in order]
        base = int(rows.column("grp")[0].as_py()) << 32
        out = []
        for at, sequence in enumerate(pack([len(i) for i in ids], capacity, least)):
            offset = 0
            for doc, start, n in sequence:
                crc = zlib.crc32(ids[doc][start:start + n].astype("<u4").tobytes())
                out.append((names[doc], start, n, crc, len(ids[doc]), base + at, offset))
                offset += n
        return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), target)], schema=target)

    return tokenise(docs, path, end_id, groups).groupBy("grp").applyInArrow(packed, PIECES)


def op10_packing(spark, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"))
