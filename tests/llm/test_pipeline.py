"""The stages of the pipeline against plain Python, each on its own input."""

import random

import pytest

import corpus_pipeline
from rekindle.llm import language, secrets, similar
from tests.llm.test_codec_and_packing import check_packing
from tests.llm.test_pair_operators import linked_by_hand

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(11)
    english = ["the", "house", "is", "near", "river", "and", "people", "walk", "along", "water", "with", "their", "children", "every", "morning", "before", "work", "starts"]
    german = ["das", "haus", "steht", "nahe", "fluss", "und", "leute", "gehen", "entlang", "wasser", "mit", "ihren", "kindern", "jeden", "morgen", "bevor", "arbeit", "beginnt"]
    text = lambda words, n: " ".join(rng.choice(words) + rng.choice(["", "", "s", "en"]) for _ in range(n))
    passage = text(english, 90)
    rows = []
    for i in range(60):
        lang, words = ("en", english) if i % 2 else ("de", german)
        body = text(words, 120)
        if i % 10 == 3:
            body = f"{body} {passage} {text(words, 20)}"
        if i % 10 == 5:
            body += " password=abcdef0123456789ab and more"
        rows.append((i, body, lang, f"src{i % 3}", len(body)))
    rows += [(100 + i, rows[i][1] + " end", rows[i][2], "copy", len(rows[i][1]) + 4) for i in range(0, 60, 7)]
    rows += [(200, "12345 !!!", "en", "junk", 9), (201, None, None, None, None), (202, "", "en", "junk", 0), (None, text(english, 40), "en", "x", 1), rows[2]]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), COLUMNS).repartition(3)


def texts(df):
    assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    return sorted((str(r.doc_id), r.text or "") for r in df.collect())


def test_stages(spark, docs):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language", "similar", "repeats", "secrets", "packing"]
    before = texts(docs)
    after = corpus_pipeline.language_stage(spark, docs, "")
    kept = texts(after)
    assert kept == [r for r in before if r[0] not in ("200", "201", "202")]

    after = corpus_pipeline.similar_stage(spark, after, "")
    groups = linked_by_hand([(int(k), t) for k, t in kept if k != "None"])
    want = sorted({(k, t) for k, t in kept if k == "None" or groups[int(k)][1] == int(k)})
    assert texts(after) == want and len(want) < len(kept)

    after = corpus_pipeline.repeats_stage(spark, after, "")
    cut, shared, size = [], [t.encode() for _, t in want], corpus_pipeline.REPEAT
    seen = {}
    for raw in shared:
        for s in range(len(raw) - size + 1):
            seen[raw[s:s + size]] = seen.get(raw[s:s + size], 0) + 1
    for (key, _), raw in zip(want, shared):
        gone = bytearray(len(raw))
        for s in range(len(raw) - size + 1):
            if seen[raw[s:s + size]] > 1:
                gone[s:s + size] = b"\1" * size
        at = 0
        while at < len(raw):  # spans of fewer words than a passage stay
            end = at
            while end < len(raw) and gone[end] == gone[at]:
                end += 1
            if gone[at] and len(raw[at:end].split()) < corpus_pipeline.PASSAGE:
                gone[at:end] = bytes(end - at)
            at = end
        cut.append((key, bytes(b for b, g in zip(raw, gone) if not g).decode()))
    assert texts(after) == sorted(cut) and cut != want

    after = corpus_pipeline.secrets_stage(spark, after, "")
    masked = texts(after)
    assert [k for k, _ in masked] == [k for k, _ in sorted(cut)]
    for (_, new), (_, old) in zip(masked, sorted(cut)):
        spans = secrets.find(old.encode(), None, 0.0)[0]
        assert (new == old) == (not spans) and ("[SECRET]" in new) == bool(spans) and "abcdef0123456789ab" not in new
    assert all(r.n_chars == len(r.text) for r in after.filter("text LIKE '%SECRET%'").collect())

    check_packing(corpus_pipeline.packing_stage(spark, after, "").collect(), [(k, t) for k, t in masked])


def test_stages_on_empty_and_null_tables(spark, docs):
    for source in (docs.limit(0), docs.filter("doc_id = 201")):
        df = source
        for name, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, "")
        assert df.count() == 0
    assert corpus_pipeline.secrets_stage(spark, docs, "").filter("text IS NULL").count() == 1


def test_run_equals_its_stages(spark):
    folder = "/root/testdata/sf0.001"
    df = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, folder)
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) == sorted(map(tuple, df.collect()))


def test_language_stage_keeps_what_the_operator_accepts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.language_stage(spark, docs, "").select("doc_id").collect()}
    told = language.predict(docs, language.learn(docs)).collect()
    assert kept == {r.doc_id for r in told if r.lang_pred != "und" and r.score >= 0.5}


def test_similar_stage_removes_copies_between_the_two_measures(spark):
    rng = random.Random(7)
    words = [f"w{rng.randint(0, 10**9)}" for _ in range(200)]
    more = lambda n: [f"x{rng.randint(0, 10**9)}" for _ in range(n)]
    rows = [
        (1, " ".join(words)), (2, " ".join(words + more(43))),  # 196 of 239 five-word shingles: 0.820
        (3, " ".join(words[::-1])), (4, " ".join(words[::-1] + more(55))),  # 196 of 251: 0.781
    ]
    docs = spark.createDataFrame([(k, t, "en", "x", len(t)) for k, t in rows], COLUMNS)
    assert {r.doc_id for r in similar.link(docs).filter("doc_id = component_id").collect()} == {1, 2, 3, 4}
    assert {k for k, _ in texts(corpus_pipeline.similar_stage(spark, docs, ""))} == {"1", "3", "4"}


def test_repeats_stage_cuts_passages_of_over_50_words(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7)))
    passage, line, own = " ".join(word() for _ in range(52)), " ".join(word() for _ in range(42)), [" ".join(word() for _ in range(80)) for _ in range(6)]
    assert len(passage) < 400 and len(line) > corpus_pipeline.REPEAT
    rows = [(1, f"{own[0]}\n{passage}\n{own[1]}"), (2, f"{own[2]}\t{passage}"), (3, f"{own[3]}. {line}"), (4, f"{line}, {own[4]}"), (None, f"{passage} {own[5]}"), (5, None), (6, "")]
    docs = spark.createDataFrame([(k, t, "en", "x", len(t or "")) for k, t in rows], COLUMNS).selectExpr("*", "1 AS gone", "2 AS row", "3 AS size")
    got = corpus_pipeline.repeats_stage(spark, docs, "")
    assert got.columns == docs.columns
    kept = {r.doc_id: r.text for r in got.collect()}
    assert passage[5:-5] not in " ".join(t or "" for t in kept.values()) and all(any(o[5:-5] in (t or "") for t in kept.values()) for o in own)
    assert (kept[3], kept[4], kept[5], kept[6]) == (rows[2][1], rows[3][1], None, "")
