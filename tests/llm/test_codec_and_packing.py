"""SentencePiece codec against the library; packing against the tokenizer."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Tokenizer

from rekindle.llm import packing, pieces

ODD = ["a", "b", " ", "  ", "\n", "\t", "▁", "é", "é", "漢", "🙂", "</s>", "<s>", "<0x0A>", "\0", "　", "ﬁ", "Ａ", "½", "the", "​", "\x7f", "\xa0", "①", "ｶﾞ"]


def odd_texts(n, pool, seed=1, most=30):
    rng = random.Random(seed)
    return ["".join(rng.choice(pool) for _ in range(rng.randint(0, most))) for _ in range(n)] + ["", " ", "   ", "\n"]


def models():
    with open(pieces.default_model(), "rb") as file:
        plain = sentencepiece_model_pb2.ModelProto.FromString(file.read())
    rules = sentencepiece_model_pb2.ModelProto.FromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    for mapped, squeeze, prefix in ((False, False, True), (True, False, True), (True, True, True), (True, True, False), (False, True, True)):
        model = sentencepiece_model_pb2.ModelProto()
        model.CopyFrom(plain)
        if mapped:
            model.normalizer_spec.precompiled_charsmap = rules.normalizer_spec.precompiled_charsmap
            model.normalizer_spec.name = "nmt_nfkc"
        model.normalizer_spec.remove_extra_whitespaces = squeeze
        model.normalizer_spec.add_dummy_prefix = prefix
        yield model


@pytest.mark.parametrize("model", list(models()), ids=["plain", "mapped", "mapped-squeezed", "mapped-no-prefix", "squeezed"])
def test_codec_equals_the_library(model):
    codec, library = pieces.Codec.of_proto(model), sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    for text in odd_texts(800, ODD):
        ids, begins, ends = codec.encode(text)
        assert codec.normalise(text)[0] == library.normalize(text)
        assert ids.tolist() == library.encode(text)
        assert codec.decode(ids) == library.decode(ids.tolist())
        assert (begins <= ends).all() and (ends[:-1] <= begins[1:]).all()


def test_spans_name_the_source_bytes():
    codec = pieces.Codec(pieces.default_model())
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    for text in odd_texts(300, ODD, seed=2) + ["A longer text, with words. " * 30]:
        raw, (ids, begins, ends) = text.encode(), codec.encode(text)
        told = library.encode(text, return_type="proto").pieces
        for piece, a, b in zip(told, begins.tolist(), ends.tolist()):
            if not piece.piece.startswith("<0x"):
                assert raw[a:b].decode().replace(" ", "▁") == piece.surface.replace(" ", "▁")
        assert not raw or (begins[0] == 0 and ends[-1] == len(raw))


def test_codec_frames(spark, messy):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    encoded = pieces.encode(messy)
    want = sorted((str(r.doc_id), library.encode(r.text or "")) for r in messy.collect())
    assert sorted((str(r.doc_id), r.ids) for r in encoded.collect()) == want
    assert sorted((str(r.doc_id), r.text) for r in pieces.decode(encoded).collect()) == sorted((i, library.decode(ids)) for i, ids in want)
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.digests(messy).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {(None if i == "None" else int(i), len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))) for i, ids in want}
    assert pieces.digests(messy.limit(0)).count() == 0


def test_words_equal_the_tokenizer():
    words, whole = packing.Words(packing.default_tokenizer()), Tokenizer.from_file(packing.default_tokenizer())
    pool = ["a", "B", " ", "\n", "\t", "É", "́", "漢", "🙂", "<|endoftext|>", "\x1c", "\x0b", "\x85", "\xa0", "'s", "'", "1", "23", "İ", "Σ", "!", "?", "　", "\0"]
    texts = odd_texts(2000, pool, most=20)
    assert [i.tolist() for i in words.encode(texts)] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_plain_chunks_are_split_once_and_words_tokenised_together():
    """Repeated chunks cost one lookup per group of texts, and new words go to the tokenizer many at a time."""
    words, whole = packing.Words(packing.default_tokenizer()), Tokenizer.from_file(packing.default_tokenizer())
    calls, encode = [], words.tokenizer.encode_batch_fast

    class Counted:
        def encode_batch_fast(self, texts, **how):
            calls.append(len(texts))
            return encode(texts, **how)

    words.tokenizer = Counted()
    pool = ["can't", "'sally", "!'s", "x1y", "</w>", "</", "w>", "Ärger", "ß", "a.b", "''", "don'T", "12", "\x01", "\x0c", "\v", "", "   ", "\r\n"]
    texts = [" ".join(rng) for rng in (random.Random(n).choices(pool + [f"w{k}q" for k in range(900)], k=n % 60) for n in range(600))] + ["", "\n", "x"]
    want = [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert [i.tolist() for i in words.encode(texts)] == want
    assert sum(calls) < 20, calls
    words.GROUP, words.KEPT = 300, 50
    assert [i.tolist() for i in words.encode(texts)] == want


@pytest.mark.parametrize("seed", range(6))
def test_pack_holds_each_token_once(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([1, 3, 17, 64, rng.randint(1, 300)]) for _ in range(rng.randint(0, 200))]
    packed = packing.pack(lengths, 64, 4)
    cells = [(d, s + i) for seq in packed for d, s, n in seq for i in range(n)]
    assert sorted(cells) == [(d, i) for d, n in enumerate(lengths) for i in range(n)]
    sizes = [sum(p[2] for p in seq) for seq in packed]
    assert all(0 < s <= 64 for s in sizes)
    assert sum(64 - s for s in sizes if s & (s - 1)) <= 3 * len(sizes)


def test_tournament_finds_the_first_bin_with_room():
    rng, tree, plain = random.Random(3), packing.Tournament(50, 10), [10] * 50
    for _ in range(50):
        need = rng.randint(1, 10)
        at = next(i for i, room in enumerate(plain) if room >= need)
        plain[at] -= need
        assert tree.place(need) == at


def check_packing(rows, documents):
    whole = Tokenizer.from_file(packing.default_tokenizer())
    ids = sorted((str(k), whole.encode(t or "", add_special_tokens=False).ids + [2]) for k, t in documents)
    sequences, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
        docs[str(r.doc_id)].append(r)
    for pieces_of in sequences.values():
        at = 0
        for r in sorted(pieces_of, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert sum(r.length for r in rows) == sum(len(i) for _, i in ids)
    once = {k: i for k, i in ids if sum(k == x for x, _ in ids) == 1}
    for key, tokens in once.items():
        at = 0
        for r in sorted(docs[key], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(tokens)
            assert r.ids_crc32 == zlib.crc32(np.array(tokens[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(tokens)
    totals = [sum(r.length for r in s) for s in sequences.values()]
    return sum(4096 - t for t in totals if t & (t - 1)) / sum(totals)


def test_packing_of_documents(spark, messy):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert check_packing(packing.pack_documents(docs, group_bytes=100_000).collect(), docs.select("doc_id", "text").collect()) < 0.01
    check_packing(packing.pack_documents(messy).collect(), messy.select("doc_id", "text").collect())
    assert packing.pack_documents(messy.limit(0)).count() == 0
