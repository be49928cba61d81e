"""SentencePiece encoding that keeps byte offsets, and decoding.

A text is first normalised by this module: the longest prefix that the model's compiled character map knows
is replaced, else one character stays, and every normalised byte records the source byte it came
from. The normalised text falls into chunks that no piece can cross (a run of word marks and what follows up to the
next one); each distinct chunk is encoded once per task by the library, whose own normaliser is switched off for it.
Piece lengths add up to normalised offsets, and the alignment projects them to spans of the original bytes.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
from pyspark.sql import DataFrame

from rekindle.llm.base import map_rows, pieces_of, ragged, table, texts_of

MARK = "▁"
MARK_BYTES = MARK.encode()
#: about a hundred characters that end before a word mark, after another character: no piece crosses there
SEGMENT = re.compile(f"(?s).{{64}}{MARK}*[^{MARK}]*|.+")
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class CharacterMap:
    """Longest-prefix lookup in a compiled map: a double-array trie and the replacement strings."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4:4 + size], "<u4").tolist()
        self.strings = blob[4 + size:]
        self.first = self._first_bytes()

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def _first_bytes(self) -> frozenset[int]:
        """Bytes that any key starts with."""
        root = self._offset(self.units[0])
        return frozenset(b for b in range(256) if (root ^ b) < len(self.units) and self.units[root ^ b] & 0x800000FF == b)

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """Replacement and length of the longest key that ``data`` has at ``at``."""
        if data[at] not in self.first:
            return None
        node, found = self._offset(self.units[0]), None
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = (self.units[node] & 0x7FFFFFFF, i + 1 - at)
        if found is None:
            return None
        return self.strings[found[0]:self.strings.index(b"\0", found[0])], found[1]


class Codec:
    """Encoder and decoder of one model file."""

    def __init__(self, model: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(model, "rb") as file:
            proto = sentencepiece_model_pb2.ModelProto.FromString(file.read())
        self._setup(proto, sentencepiece)

    @classmethod
    def of_proto(cls, proto) -> Codec:
        import sentencepiece

        codec = cls.__new__(cls)
        codec._setup(proto, sentencepiece)
        return codec

    def _setup(self, proto, library) -> None:
        spec = proto.normalizer_spec
        self.map = CharacterMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        if proto.trainer_spec.treat_whitespace_as_suffix or any(p.type == USER_DEFINED for p in proto.pieces):
            raise ValueError("models with user-defined pieces or white space as a suffix are not supported")
        self.chunked = not any(MARK in p.piece.lstrip(MARK) for p in proto.pieces if p.type == NORMAL)
        inner = type(proto)()
        inner.CopyFrom(proto)
        inner.normalizer_spec.precompiled_charsmap = b""
        inner.normalizer_spec.name = "identity"
        inner.normalizer_spec.add_dummy_prefix = inner.normalizer_spec.remove_extra_whitespaces = inner.normalizer_spec.escape_whitespaces = False
        self.library = library.SentencePieceProcessor(model_proto=inner.SerializeToString())
        unknown = (proto.trainer_spec.unk_surface or " ⁇ ").encode()
        out, widths = [], []
        for p in proto.pieces:
            raw = p.piece.encode()
            out.append({UNKNOWN: unknown, CONTROL: b""}.get(p.type, bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else p.piece.replace(MARK, " ").encode()))
            widths.append(1 if p.type == BYTE else len(raw))
        self.widths = np.array(widths)  # bytes of normalised text; an unknown piece is set per chunk
        self.unknown = next((i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN), -1)
        self.mark = next((i for i, p in enumerate(proto.pieces) if p.piece == MARK), -1)
        self.raw_space = {i for i, p in enumerate(proto.pieces) if p.type == BYTE and p.piece == "<0x20>"}
        self.bytes = np.frombuffer(b"".join(out), np.uint8)
        self.sizes = np.array([len(x) for x in out])
        self.starts = np.cumsum(self.sizes) - self.sizes

    # -- normalising ----------------------------------------------------------------------

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes and its end the source byte offset."""
        raw = text.encode()
        if self.map is None and not self.squeeze:
            if not raw:
                return "", np.zeros(1, np.int64)
            data = np.frombuffer(raw, np.uint8)
            width = np.where(data == 32, 3 if self.escape else 1, 1)
            lead = (3 if self.escape else 1) if self.prefix else 0
            align = np.concatenate([np.zeros(lead, np.int64), np.repeat(np.arange(len(raw)), width), [len(raw)]])
            out = (" " if self.prefix else "") + text
            return (out.replace(" ", MARK) if self.escape else out), align
        return self._normalise_mapped(raw)

    def _step(self, raw: bytes, at: int) -> tuple[bytes, int]:
        found = self.map.longest(raw, at) if self.map else None
        if found:
            return found
        lead = raw[at]
        size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return raw[at:at + size], size

    def _normalise_mapped(self, raw: bytes) -> tuple[str, np.ndarray]:
        space = MARK_BYTES if self.escape else b" "
        at, end = 0, len(raw)
        if self.squeeze:
            while at < end:
                new, size = self._step(raw, at)
                if new != b" ":
                    break
                at += size
        if at == end:
            return "", np.full(1, end)
        out, align = bytearray(), []

        def put(piece: bytes, source: int) -> None:
            out.extend(piece)
            align.extend([source] * len(piece))

        if self.prefix:
            put(space, at)
        after_space = self.squeeze
        while at < end:
            new, size = self._step(raw, at)
            while after_space and new.startswith(b" "):
                new = new[1:]
            for i in range(len(new)):
                put(space if new[i] == 32 else new[i:i + 1], at)
            if new:
                after_space = self.squeeze and new.endswith(b" ")
            at += size
        if self.squeeze:
            while out.endswith(space):
                end = align[-len(space)]
                del out[-len(space):], align[-len(space):]
        return out.decode(), np.array([*align, end], np.int64)

    # -- encoding and decoding ------------------------------------------------------------

    def _widths(self, chunk: str, ids: np.ndarray) -> np.ndarray:
        widths = self.widths[ids]
        if self.unknown < 0 or not (ids == self.unknown).any():
            return widths
        data, at = chunk.encode(), 0  # an unknown piece covers what the library merges up to the next known piece
        pieces = self.library.id_to_piece(ids.tolist())
        for i, piece in enumerate(pieces):
            if ids[i] == self.unknown:
                stop = data.find(pieces[i + 1].encode(), at + 1) if i + 1 < len(pieces) else len(data)
                widths[i] = stop - at
            at += widths[i]
        return widths

    def encode_all(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text its ids, and begin and end of each piece in bytes of the source text.

        Texts go to the library in groups of half a million characters (or one text), as short segments.
        """
        for group in pieces_of(texts, 500_000):
            normal = [self.normalise(t) for t in texts[group]]
            parts = [SEGMENT.findall(n) if self.chunked else [n] * bool(n) for n, _ in normal]
            found = iter(self.library.encode(list(chain.from_iterable(parts)), num_threads=1))
            for (_, align), own in zip(normal, parts):
                yield self._placed(own, list(islice(found, len(own))), align)

    def _placed(self, parts: list[str], found: list[list[int]], align: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = np.fromiter(chain.from_iterable(found), np.int32)
        if not len(ids):
            return ids, np.zeros(0, np.int64), np.zeros(0, np.int64)
        widths = self.widths[ids]
        if self.unknown >= 0 and (ids == self.unknown).any():
            widths = np.concatenate([self._widths(p, np.array(f, np.int32)) for p, f in zip(parts, found)])
        ends = np.cumsum(widths, dtype=np.int64)
        begins = np.concatenate([[0], ends[:-1]])
        return ids, align[begins], align[ends]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return next(self.encode_all([text]))

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids; the space that encoding put before the text goes, byte pieces join to characters."""
        raw = self.bytes[ragged(self.starts[ids], self.sizes[ids])].tobytes()
        marks = 0
        if self.squeeze:  # pieces that are one mark also go while nothing precedes them
            while marks < len(ids) and ids[marks] == self.mark:
                marks += 1
        raw = raw[marks:]
        if (self.prefix or self.squeeze) and raw.startswith(b" ") and ids[marks] not in self.raw_space:
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """doc_id, ids, begins, ends of each row: piece ids and their byte spans in the source text.

    Null and empty texts have no pieces. Other columns are ignored, repeated rows are encoded each, an empty table gives an
    empty table. Texts are encoded whole. ``model`` is the path of a
    BPE or unigram model file that every executor has.
    """
    path = model or default_model()

    def make():
        codec = Codec(path)

        def work(batch):
            done = list(codec.encode_all(batch.column("text").to_pylist()))
            yield {"doc_id": batch.column("doc_id"), "ids": [d[0] for d in done], "begins": [d[1] for d in done], "ends": [d[2] for d in done]}

        return work

    return map_rows(texts_of(df, id_col, text_col), make, "doc_id bigint, ids array<int>, begins array<bigint>, ends array<bigint>")


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """doc_id, text of each row of ids; null ids give an empty text."""
    path = model or default_model()

    def make():
        codec = Codec(path)

        def work(batch):
            yield {"doc_id": batch.column("doc_id"), "text": [codec.decode(np.array(i or [], np.int64)) for i in batch.column("ids").to_pylist()]}

        return work

    return map_rows(df.selectExpr(f"CAST({id_col} AS BIGINT) AS doc_id", f"{ids_col} AS ids"), make, "doc_id bigint, text string")


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, covered_bytes, spans_crc32 of encoding and decoding each row.

    The same as digests over :func:`encode` and :func:`decode`, without moving the ids between processes.
    ``covered_bytes`` are the source bytes inside the span of some piece.
    """
    path = model or default_model()

    def make():
        codec = Codec(path)
        names = np.array([str(i) for i in range(len(codec.sizes))], object)

        def work(batch):
            out = {"doc_id": batch.column("doc_id"), "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "covered_bytes": [], "spans_crc32": []}
            for ids, begins, ends in codec.encode_all(batch.column("text").to_pylist()):
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(",".join(names[ids]).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
                out["covered_bytes"].append(int((ends - begins).sum()))
                out["spans_crc32"].append(zlib.crc32(ends.tobytes(), zlib.crc32(begins.tobytes())))
            yield out

        return work

    return map_rows(texts_of(df, id_col, text_col), make,
                    "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, covered_bytes bigint, spans_crc32 bigint")


def op1_sentencepiece(spark, folder: str) -> DataFrame:
    return digests(table(spark, folder, "documents"))
