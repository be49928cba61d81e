"""Secret scans: fixed patterns, and two character Markov models compared by log-likelihood ratio.

The first model learns random strings from the values that the fixed patterns find, the second ordinary
identifiers from all other character runs of the corpus. A long run that no pattern covers is reported
(kind ``markov``) when the ratio speaks for the random model.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rekindle.llm.base import map_rows, table, texts_of

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS, HEX, LONG = re.compile(rb"AKIA[A-Z0-9]+"), re.compile(rb"[0-9a-f]{16,}"), re.compile(rb"[A-Za-z0-9+/_=-]{20,}")
KEYWORDS = (b"passw", b"secret", b"token", b"api")
RUN = 16  # shortest run that can hold an access key, a hexadecimal or a long string
LEARN = 8  # shortest run of an ordinary identifier
ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
SIZE = len(ALPHABET) + 1
THRESHOLD = 0.5
CODE = np.zeros(256, np.uint8)
CODE[np.frombuffer(ALPHABET, np.uint8)] = np.arange(1, SIZE)


def runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the bytes, and start and end of each run of alphabet bytes."""
    codes = CODE[data]
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = codes > 0
    edges = np.flatnonzero(np.diff(inside))
    return codes, edges[::2], edges[1::2]


def base_spans(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) in bytes. Hex and access matches lie inside long runs."""
    found = []
    if b"=" in raw or b":" in raw:
        low = raw.lower()
        if any(k in low for k in KEYWORDS):
            found += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(raw) if m.end(2) - m.start(2) >= 12]
    for s, e in zip(starts[ends - starts >= RUN].tolist(), ends[ends - starts >= RUN].tolist()):
        part = raw[s:e]
        found += [(s + m.start(), 1, s + m.end(), s + m.start()) for m in ACCESS.finditer(part) if m.end() - m.start() >= 18]
        found += [(s + m.start(), 2, s + m.end(), s + m.start()) for m in HEX.finditer(part)]
    return sorted(found)


def _pairs(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> None:
    """Add the transitions inside the given runs; code 0 stands before each run."""
    mask = np.zeros(len(codes) + 1, np.int8)
    np.add.at(mask, starts, 1)
    np.add.at(mask, ends, -1)
    inside = np.cumsum(mask[:-1]) > 0
    before = np.concatenate([[0], codes[:-1]]).astype(np.int64)
    before[starts] = 0
    counts += np.bincount(before[inside] * SIZE + codes[inside], minlength=SIZE * SIZE)


def _count(docs: DataFrame) -> DataFrame:
    def make():
        def work(batch):
            counts = np.zeros((2, SIZE * SIZE), np.int64)
            for text in batch.column("text").to_pylist():
                raw = text.encode()
                if not raw:
                    continue
                codes, s, e = runs(np.frombuffer(raw, np.uint8))
                found = base_spans(raw, s, e)
                long = e - s >= LEARN
                s, e = s[long], e[long]
                if found:
                    values = np.array([(f[3], f[2]) for f in found])
                    _pairs(codes, values[:, 0], values[:, 1], counts[0])
                    free = ~((s[:, None] < values[:, 1]) & (e[:, None] > values[:, 0])).any(axis=1) if len(found) < 64 else _free(s, e, values)
                    s, e = s[free], e[free]
                if len(s):
                    _pairs(codes, s, e, counts[1])
            label, pair = np.nonzero(counts)
            yield {"label": label.astype(np.int32), "pair": pair.astype(np.int32), "n": counts[label, pair]}

        return work

    return map_rows(docs, make, "label int, pair int, n bigint")


def _free(s: np.ndarray, e: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which runs touch none of the values, by counting value starts and ends before them."""
    begins, stops = np.sort(values[:, 0]), np.sort(values[:, 1])
    return np.searchsorted(begins, e, "left") == np.searchsorted(stops, s, "right")


def train(docs: DataFrame) -> np.ndarray | None:
    """Log-likelihood ratio of each transition (random over ordinary), from all documents.

    Labelled by the fixed patterns: their values are random strings, all other runs of 8 or more
    characters ordinary ones. The driver gets at most 2 x 69 x 69 counts. None without both kinds.
    """
    totals = _count(docs).groupBy("label", "pair").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros((2, SIZE * SIZE))
    for row in totals:
        counts[row["label"], row["pair"]] = row["n"]
    if not counts.sum(axis=1).all():
        return None
    pairs = counts.reshape(2, SIZE, SIZE)
    single = pairs.sum(axis=1, keepdims=True) + 0.5
    single /= single.sum(axis=2, keepdims=True)  # a rare context falls back to the frequency of the character
    p = np.log((pairs + 5 * single) / (pairs.sum(axis=2, keepdims=True) + 5))
    return p[0] - p[1]


def find(raw: bytes, ratio: np.ndarray | None, threshold: float) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """(start, kind, end) in code points, in order of start and kind, and the bytes."""
    data = np.frombuffer(raw, np.uint8)
    codes, s, e = runs(data)
    spans = [(a, k, b) for a, k, b, _ in base_spans(raw, s, e)]
    if ratio is not None:
        taken = [(a, b) for a, _, b in spans]
        for a, b in zip(s[e - s >= 20].tolist(), e[e - s >= 20].tolist()):
            for m in LONG.finditer(raw[a:b]):
                x, y = a + m.start(), a + m.end()
                part = codes[x:y]
                score = ratio[np.concatenate([[0], part[:-1]]), part].sum()
                if score > threshold * len(part) and not any(x < q and y > p for p, q in taken):
                    spans.append((x, 3, y))
    if not spans:
        return [], data
    spans.sort()
    if len(raw) and data.max() > 127:
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        spans = [(int(points[a]), k, int(points[b])) for a, k, b in spans]
    return spans, data


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, model: np.ndarray | None = None) -> DataFrame:
    """doc_id, text, kinds, starts, ends: all secrets of each document, in code points, ordered by start and kind.

    ``threshold`` is the log-likelihood ratio per character above which a run of 20 or more characters counts.
    ``model`` defaults to :func:`train` over the same documents. Null and empty texts have no spans, repeated
    rows are scanned each, other columns are ignored, an empty table gives an empty table. A text of any length
    is scanned whole.
    """
    docs = texts_of(docs, id_col, text_col)
    ratio = train(docs) if model is None else model

    def make():
        def work(batch):
            kinds, starts, ends = [], [], []
            for text in batch.column("text").to_pylist():
                spans = find(text.encode(), ratio, threshold)[0] if text else []
                kinds.append([KINDS[k] for _, k, _ in spans])
                starts.append([a for a, _, _ in spans])
                ends.append([b for _, _, b in spans])
            yield {"doc_id": batch.column("doc_id"), "text": batch.column("text"), "kinds": kinds, "starts": starts, "ends": ends}

        return work

    return map_rows(docs, make, "doc_id bigint, text string, kinds array<string>, starts array<bigint>, ends array<bigint>")


def masked(text: str, spans: list[tuple[int, int]], mark: str = "[SECRET]") -> str:
    """``text`` with ``mark`` for each span; overlapping spans, in order of start, are replaced together."""
    out, at = [], 0
    for a, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(scanned: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """doc_id, text of the scanned rows with each secret replaced by ``mark``."""

    def make():
        def work(batch):
            columns = (batch.column(c).to_pylist() for c in ("text", "starts", "ends"))
            yield {"doc_id": batch.column("doc_id"), "text": [masked(t, list(zip(a, b)), mark) for t, a, b in zip(*columns)]}

        return work

    return map_rows(scanned.select("doc_id", "text", "starts", "ends"), make, "doc_id bigint, text string")


def digests(scanned: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov."""
    told = F.transform(F.arrays_zip("kinds", "starts", "ends"), lambda s: F.concat_ws(":", s["kinds"], s["starts"], s["ends"]))
    count = lambda kind: F.size(F.filter("kinds", lambda k: k == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.array_join(F.filter("_told", lambda s: ~s.startswith("markov:")), ",")
    return scanned.withColumn("_told", told).select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        F.array_join("_told", ",").alias("spans"), count("markov"),
    )


def op8_secrets(spark, folder: str) -> DataFrame:
    return digests(scan(table(spark, folder, "documents")))
