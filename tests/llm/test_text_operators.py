"""Language ID, secret scans, fingerprints, chat formatting and URL filters."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rekindle.llm import chat, fingerprints, language, secrets, urls

SMALL = "/root/testdata/sf0.01"


# -- language ID --------------------------------------------------------------------------


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    told = language.op6_language(spark, SMALL).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(told) == docs.count()
    assert {r.held_out for r in told} == {True, False}
    tested = [r for r in told if r.held_out and r.lang]
    assert np.mean([r.lang == r.lang_pred for r in tested]) > 0.95
    assert all(0 <= r.score <= 1 for r in told)


def test_language_backs_off_to_shorter_grams():
    model = language.Model(["a", "b"], {"ab": 0}, np.array([[-1.0, -9.0]], np.float32), {"^x": 0, "z": 1}, np.array([[-7.0, -2.0], [-3.0, -4.0]], np.float32))
    scorer = language.Scorer(model)
    assert scorer.predict("ab")[0] == "a"
    assert scorer.predict("xz")[0] == "b"  # ^x is longer than z
    assert scorer.predict("zzz")[0] == "a"
    assert scorer.predict("qqq") == ("a", 0.5)  # nothing known: equal scores, first language
    assert scorer.predict("12 ?!")[0] == scorer.predict(None)[0] == scorer.predict("²")[0] == "und"


def test_language_edges(spark, messy):
    model = language.learn(messy)
    got = [(r.doc_id, r.lang_pred) for r in language.predict(messy, model).collect()]
    assert sorted(k for k, p in got if p == "und") == [2, 3, 4]
    assert len(got) == messy.count()
    nothing = language.learn(messy.limit(0))
    assert {r.lang_pred for r in language.predict(messy, nothing).collect()} == {"und"}
    assert language.predict(messy.limit(0), model).count() == 0


def test_language_of_few_labelled_rows(spark):
    rng = random.Random(3)
    words = {lang: ["".join(rng.choice(letters) for _ in range(6)) for _ in range(1500)] for lang, letters in (("aa", "abcdefgh"), ("bb", "ijklmnop"))}
    words["xx"] = ["".join(rng.choice("qrstuvwxyz") for _ in range(6)) for _ in range(30)]
    text = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    rows = [(lang, text(lang, 60)) for lang in ("aa", "bb") for _ in range(300)] + [("xx", text("xx", 12)) for _ in range(3)]
    labelled = spark.createDataFrame(rows, "lang string, text string")
    for bounds in ({}, {"max_words": 90, "max_grams": 600}):
        model = language.train(labelled, **bounds)
        assert model.languages == ["aa", "bb", "xx"]  # none is cut
        assert len(model.words) <= bounds.get("max_words", 10**6) and len(model.grams) <= bounds.get("max_grams", 10**6)
        scorer = language.Scorer(model)
        for lang in words:  # and none takes the texts of another
            assert [scorer.predict(text(lang, 40))[0] for _ in range(40)] == [lang] * 40


def test_language_counts_every_row(spark):
    labelled = spark.range(60_000).selectExpr("CASE WHEN id % 20000 = 7 THEN 'xx' ELSE 'en' END AS lang", "IF(id % 20000 = 7, 'zulu', 'the house') AS text")
    model = language.train(labelled)
    logs = dict(zip(model.words, np.exp(model.word_logs.astype(float)).tolist()))
    assert set(logs) == {"the", "house", "zulu"}
    assert logs["zulu"] == pytest.approx([0.5 / (119994 + 1.5), 3.5 / (3 + 1.5)], rel=1e-4)
    assert logs["the"] == pytest.approx([59997.5 / (119994 + 1.5), 0.5 / (3 + 1.5)], rel=1e-4)


# -- secret scans --------------------------------------------------------------------------


def base_by_text(text):
    """The base rules on code points, with the patterns as they are written."""
    found = []
    letters = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    words = "|".join(letters(w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
    for kind, pattern, least in (
        ("assign", f"({words})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 12), ("access", "(AKIA[A-Z0-9]+)", 18), ("hex", "([0-9a-f]+)", 16),
    ):
        found += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m.group(2 if kind == "assign" else 1)) >= least]
    return sorted(found, key=lambda f: (f[0], secrets.KINDS.index(f[1])))


def secret_texts():
    rng = random.Random(4)
    pool = ["password", "Passwd", "TOKEN", "ſecret", "api_key", "APIKEY", "secret", "=", ":", " ", "  ", '"', "'", "abcdef0123456789", "AKIA", "AKIAABCDEFGHIJ1234", "é", "漢", "xyz", "0123", "A1b2", "\n", ".", "token=token=abcdefghijkl"]
    return ["".join(rng.choice(pool) for _ in range(rng.randint(0, 14))) for _ in range(1500)]


def test_base_rules_by_brute_force():
    for text in secret_texts():
        spans, _ = secrets.find(text.encode(), None, 0.5)
        assert [(a, secrets.KINDS[k], b) for a, k, b in spans] == base_by_text(text)


def test_secret_query_by_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = secrets.op8_secrets(spark, SMALL).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        base = base_by_text(texts[r.doc_id] or "")
        told = [f"{k}:{a}:{b}" for a, k, b in base]
        assert hashlib.sha256(",".join(told).encode()).hexdigest() == r.base_sha256
        count = Counter(k for _, k, _ in base)
        assert (r.n_assign, r.n_access, r.n_hex) == (count["assign"], count["access"], count["hex"])
        assert [s for s in r.spans.split(",") if s and not s.startswith("markov")] == told


def test_markov_models_tell_random_strings_from_identifiers(spark):
    rng = random.Random(9)
    draw = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    words = ["configuration", "management", "interface", "operation", "sequence", "container", "element"]
    name = lambda: "_".join(rng.choice(words) for _ in range(3))
    train = [(i, f"{name()} {name()} token={draw(30)}") for i in range(300)]
    model = secrets.train(spark.createDataFrame(train, "doc_id long, text string"))
    hit = lambda s: len(secrets.find(s.encode(), model, secrets.THRESHOLD)[0])
    assert np.mean([hit(draw(30)) for _ in range(200)]) > 0.9
    assert np.mean([hit(name()) for _ in range(200)]) < 0.05


def test_secret_edges(spark, messy):
    scanned = secrets.scan(messy)
    assert scanned.count() == messy.count() and all(r.spans == "" for r in secrets.digests(scanned).collect())
    assert secrets.scan(messy.limit(0)).count() == 0
    assert secrets.masked("ab secret cd", [(3, 9), (5, 7)], "#") == "ab # cd"
    rows = spark.createDataFrame([(1, "é password=abcdef0123456789 z")], "doc_id long, text string")
    assert secrets.redact(secrets.scan(rows)).first().text == "é [SECRET] z"


# -- fingerprints ----------------------------------------------------------------------------


def sketch_by_hand(sketcher, text):
    kmers = fingerprints.kmer_hashes(np.array([ord(c) for c in text], np.uint32), sketcher.k)
    if not len(kmers):
        return [0] * sketcher.m
    seen, keys = Counter(), []
    for x in kmers.tolist():
        o = seen[x]
        seen[x] += 1
        keys.append(x if not o else int(fingerprints.mixed(np.array([x], np.uint64) + np.array([o], np.uint64) * fingerprints.ODD[2])[0]))
    out = []
    for factor in sketcher.factors.tolist():
        ranks = [k * factor % 2**64 for k in keys]
        chosen = sorted(sorted(range(len(keys)), key=ranks.__getitem__)[:sketcher.l])
        value = np.array([len(kmers) < sketcher.l], np.uint64)
        for i in chosen:
            value = fingerprints.mixed(value * fingerprints.ODD[1] + kmers[i:i + 1])
        out.append(max(1, int(value[0] >> np.uint64(32))))
    return out


def test_sketch_by_hand():
    rng, sketcher = random.Random(1), fingerprints.Sketcher()
    for text in ["", "a", "hello", "abc" * 50, "the same line\n" * 40, "é漢" * 300, "".join(rng.choice("abcdefgh ") for _ in range(3000))]:
        assert sketcher.sketch(text).tolist() == sketch_by_hand(sketcher, text)


def test_fingerprints_follow_the_edit_distance():
    rng, sketcher = random.Random(2), fingerprints.Sketcher(m=64)
    text = "".join(rng.choice("abcdefghij") for _ in range(2000))
    close = text[:1000] + "zz" + text[1000:]
    far = text[:1000] + "".join(rng.choice("abcdefghij") for _ in range(1000))
    blocks = [text[i:i + 40] for i in range(0, 2000, 40)]
    rng.shuffle(blocks)
    like = lambda t: fingerprints.likeness(sketcher.sketch(text), sketcher.sketch(t))
    assert like(text) == 1 and like(close) > 0.9 > like(far) > 0.05
    assert like("".join(blocks)) < like(close)  # the same k-mers in another order


def test_edited_neighbours(spark, messy):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r for r in fingerprints.edited_neighbours(docs).collect()}
    order, sketcher = sorted(docs.collect(), reverse=True), fingerprints.Sketcher()
    assert len(got) == len(order)
    for (key, text), (_, following) in zip(order, order[1:] + order[:1]):
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        own, other = sketcher.sketch(text), sketcher.sketch(following)
        r = got[key]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == own.astype(">u4").tobytes().hex()
        assert r.near_next == fingerprints.likeness(own, other)
        assert r.near_edited == fingerprints.likeness(own, sketcher.sketch(edited))
    assert fingerprints.edited_neighbours(messy).count() == messy.count()
    assert fingerprints.edited_neighbours(messy.limit(0)).count() == 0
    one = fingerprints.edited_neighbours(messy.filter("doc_id = 6")).first()
    assert one.near_next == 1.0 and one.n_chars == 1
    assert fingerprints.fingerprint(messy).filter("doc_id = 5").select("fingerprint").distinct().count() == 1


# -- chat formatting -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def turns(spark):
    rng = random.Random(6)
    pool = ["<|turn|>", "<|turn+|>", "<|end|>", "<|end|>\n", "\n", "<", "|", "\\", "<\\|", "<\\\\|", "a", "é漢🙂", " ", "end|>"]
    roles = ["user", "assistant", "system", "", "a\nb", "\\", "\\n", "<|end|>\n", None]
    rows = [(c, t, rng.choice(roles), "".join(rng.choice(pool) for _ in range(rng.randint(0, 8)))) for c in range(60) for t in range(rng.randint(1, 6))]
    rows += [(100, None, "assistant", None), (100, 3, "user", None), (None, 1, "user", "x"), (101, 1, "assistant", "b"), (101, 1, "assistant", "a"), (101, 1, "assistant", "a")]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS at", "'x' AS rendered", "2 AS begin")


def test_loss_text_is_what_the_mask_covers(spark):
    rows = spark.createDataFrame(
        [(1, 0, "user", "q"), (1, 1, "assistant", "a<|end|>\nb <\\| é"), (1, 2, "assistant", ""), (1, 3, "assistant", "plain <\\| 😀"), (2, 0, "assistant", "x" * 9)],
        "conv_id long, turn long, role string, text string",
    )
    formatted = chat.format_conversations(rows)
    expected = {1: "a<|end|>\nb <\\| éplain <\\| 😀", 2: "x" * 9}
    for r in chat.digests(formatted).collect():
        assert (r.loss_chars, r.loss_sha256) == (len(expected[r.conv_id]), hashlib.sha256(expected[r.conv_id].encode()).hexdigest())
    shifted = formatted.withColumn("loss_spans", F.transform("loss_spans", lambda s: F.struct((s["start"] - 1).alias("start"), s["length"])))
    for r in chat.digests(shifted).collect():
        assert r.loss_sha256 != hashlib.sha256(expected[r.conv_id].encode()).hexdigest()


def test_chat_round_trip(turns):
    source = {}
    for r in turns.collect():
        source.setdefault(r.conv_id, []).append((r.turn is None, r.turn or 0, r.role or "", r.text or ""))
    formatted = chat.format_conversations(turns)
    back = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    assert set(back) == set(source)
    for key, rows in source.items():
        want = [(role, text) for _, _, role, text in sorted(rows)]
        assert [(t.role, t.text) for t in back[key].turns] == want
        spans = [back[key].formatted[s.start:s.start + s.length] for s in back[key].loss_spans]
        told = [t for r, t in want if r == "assistant"]
        assert len(spans) == len(told)
        assert all(s in (t, re.sub(r"<(\\*)\|", r"<\1\\|", t)) for s, t in zip(spans, told))
    assert chat.format_conversations(turns.limit(0)).count() == 0


def test_plain_turns_stay_plain(spark):
    rows = spark.createDataFrame([(1, 0, "user", "hi <|turn|> <|end|>"), (1, 1, "assistant", "a<|end|>\nb")], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(rows).first().formatted == "<|turn|>user\nhi <|turn|> <|end|><|end|>\n<|turn+|>assistant\na<\\|end|>\nb<|end|>\n"


# -- URL filters -----------------------------------------------------------------------------


def judged_by_hand(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    fit = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fit, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[2] == "block"), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


def test_urls_by_hand(spark):
    rng = random.Random(8)
    rules = [*urls.RULES, ("a.example.net", "/en/x", "block"), ("org", "/", "block"), ("example.org", "/fr/deep/", "block")]
    parts = ["http://", "://", "example", ".", "net", "org", "com", "a.", "/", "en/", "/fr/", "deep/", "x", "?q=/en/", "#top", "EXAMPLE.NET", "É", "/en/x", "//"]
    given = ["".join(["https://"] * (rng.random() < 0.7) + [rng.choice(parts) for _ in range(rng.randint(0, 8))]) for _ in range(1500)]
    given += [None, "", "://", "http://net/", "http://xnet/", "http://example.net", "http://" + "a." * 5000 + "net/" + "en/" * 5000]
    df = spark.createDataFrame(list(enumerate(given)) + [(0, given[0])], "page_id long, url string").selectExpr("*", "'h' AS host", "'d' AS digest", "'s' AS short")
    for used in (urls.RULES, rules, []):
        got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(df, used).collect())
        assert got == sorted((i, *judged_by_hand(u, used)) for i, u in list(enumerate(given)) + [(0, given[0])])
    assert urls.judge(df.limit(0)).count() == 0
