"""Toxicity: the automaton against edit distance, learning on planted terms, odd cases."""

import random
import zlib

import numpy as np
import pytest

from cytoquill.llm import toxicity

from .data import no_docs, odd_docs, odd_rows, words


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


def test_near_equals_edit_distance():
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abc") for _ in range(n))
    entries = [(text(rng.randrange(4, 13)), rng.random() < 0.3, 1.0) for _ in range(60)]
    entries = list({e[:2]: e for e in entries}.values())
    lexicon = toxicity.Lexicon(entries)
    hits = 0
    for _ in range(400):
        word = text(rng.randrange(1, 14))
        expected = set()
        for i, (entry, stem, _) in enumerate(entries):
            d = min(distance(entry, word[:k]) for k in range(len(word) + 1)) if stem else distance(entry, word)
            if d <= toxicity.edits_allowed(entry, stem):
                expected.add(i)
        assert set(lexicon.near(word)) == expected, word
        assert (lexicon._word(word) is not None) == bool(expected), word
        hits += len(expected)
    assert hits > 50


def labelled(spark):
    rng = random.Random(8)
    rows, labels = odd_rows(), []
    for i in range(1000, 1400):
        text, toxic = words(rng, 60).split(), int(i % 4 == 0)
        if toxic:
            for _ in range(4):
                text[rng.randrange(60)] = rng.choice(["scoundrel", "wretchedly", "poltroon", "nincompoop"])
        rows.append((i, " ".join(text), "en", "s", 1))
        labels.append((i, 1, toxic))
    labels += [(1000, 1, 1), (5, None, 0), (None, 1, 1), (6, 1, None)]
    return odd_docs(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), rows


def test_held_out_rows_are_found(spark):
    docs, labels, rows = labelled(spark)
    model = toxicity.train(docs, labels)
    found = toxicity.score(docs, model).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        if (r["doc_id"] or 0) >= 1000:
            assert r["predicted"] == int(r["doc_id"] % 4 == 0)
        else:
            assert r["predicted"] == 0
    assert model.lexicon.match("Scoundrel,") and not model.lexicon.match("w12")
    clean = toxicity.without_toxic(docs, model)
    assert clean.columns == docs.columns and clean.count() == len(rows) - 100


def test_misspellings_hit():
    lexicon = toxicity.Lexicon([("scoundrel", False, 5.0), ("idiot", False, 4.0)])
    assert lexicon.match("SCOUNDREL!") == (0, True)
    assert {w: lexicon.match(w) for w in ("scoundrl", "scuondrel", "idoot", "idiots")} == {"scoundrl": (0, False), "scuondrel": (0, False), "idoot": (1, False), "idiots": (1, False)}
    assert lexicon.match("idols") is None and lexicon.match("") is None


def test_candidates_miss_no_hit():
    rng = random.Random(9)
    entries = [(w, s, 1.0) for w, s in (("scoundrel", False), ("idiot", False), ("übelwicht", False), ("poltro", True), ("wret", True), ("ärgster", True))]
    lexicon = toxicity.Lexicon(entries)
    texts = []
    for _ in range(500):
        word = list(rng.choice(entries)[0] + rng.choice(["", "", "xy"]))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(word) + 1)
            word[at : at + rng.randrange(2)] = rng.choice(["", "a", "ß", "o"])
        texts.append(f"so {rng.choice(['', '“', '(', '…', '12'])}{''.join(word)}{rng.choice(['', '”', '!', '’s', '»»»»»'])} there".upper() if rng.random() < 0.3 else f"a “{''.join(word)}” b")
    expected = {i for i, t in enumerate(texts) if any(lexicon.match(w) is not None for w in t.split())}
    assert {i for i, _ in lexicon.candidates(texts)} == expected and 100 < len(expected) < 500


def test_veiled_and_short_spellings_hit():
    words = ["idiot", "moron", "loser", "trash", "stupid", "scum"]
    lexicon = toxicity.Lexicon([(w, False, 4.0) for w in words])
    veiled = {"id1ot": 0, "m0ron": 1, "l0ser": 2, "tr@sh": 3, "stu*id": 4, "STU*ID!": 4, "(m0ron)": 1, "you,m0ron": 1}
    assert {t: lexicon.match(t) for t in veiled} == {t: (i, False) for t, i in veiled.items()}
    assert lexicon.match("scvm") == lexicon.match("scuum") == (5, False)
    for text in ("you are an id1ot", "so tr@sh here", "a stu*id one"):
        found = lexicon.all_features([text])[0]
        assert found[0] > 0 and found[1] == 0, text
    # Other slips are hits of less worth, and none where clean texts hold them as often.
    assert 0 < lexicon.all_features(["some scvm here"])[0][0] < lexicon.all_features(["some scum here"])[0][0]
    lexicon.trust = toxicity.trust(np.full(6, 5.0), np.full(6, 50.0), 100, 1000)
    assert not lexicon.all_features(["some scvm here"])[0].any()
    assert lexicon.all_features(["it is 10 % of 3.5, see a/b-c 2nd e.g. x@y.zz"])[0].any() == False  # noqa: E712


def test_rare_terms_are_entries(spark):
    """Sixty terms, each in a sixtieth of the toxic documents."""
    rng = random.Random(3)
    terms = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(4)) for _ in range(60)]
    rows, labels = [], []
    for i in range(3000):
        text, toxic = words(rng, 40).split(), int(i % 4 == 0)
        if toxic:
            text[rng.randrange(40)] = terms[i // 4 % 60]
        rows.append((i, " ".join(text), "en", "s", 1))
        labels.append((i, 1, toxic))
    docs, labels = odd_docs(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = toxicity.train(docs, labels)
    found = toxicity.score(docs, model).where("held_out").collect()
    assert sum(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in found) >= 0.98 * len(found)
    assert len(model.lexicon.entries) >= 58


def test_quotation_is_told_apart():
    lexicon = toxicity.Lexicon([("scoundrel", False, 5.0)])
    plain, quoted = lexicon.all_features(["you are a scoundrel and so on", 'he wrote "you are a scoundrel" and so on'])
    assert plain[0] > 0 == plain[2] and quoted[2] > 0 == quoted[0]


def test_no_labels(spark):
    docs, labels, rows = labelled(spark)
    for none in (labels.where("false"), labels.where("toxic = 0")):
        found = toxicity.score(docs, toxicity.train(docs, none)).collect()
        assert len(found) == len(rows) and {r["score"] for r in found} == {0.0}
    assert toxicity.score(no_docs(spark), toxicity.train(no_docs(spark), labels)).count() == 0


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.01"])
def test_held_out_accuracy(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    right = sum(r["predicted"] == r["toxic"] for r in found) / len(found)
    wrong_clean = sum(r["predicted"] for r in found if r["toxic"] == 0)
    assert right >= 0.95 and wrong_clean == 0


@pytest.mark.parametrize("shipped", [-1, 4_000_000])
def test_scores_do_not_depend_on_how_tokens_are_looked_up(spark, monkeypatch, shipped):
    monkeypatch.setattr(toxicity, "SHIPPED", shipped)
    docs, labels, rows = labelled(spark)
    rows = [*rows, (5000, "you nincompop , you p0ltroon! \u201cscoundrel\u201d wretchedlY " + "x" * 5000, "en", "s", 0)]
    docs = odd_docs(spark, rows)
    model = toxicity.train(docs, labels)
    assert model.lexicon.complete == (shipped > 0)
    plain = toxicity.ToxicityModel(toxicity.Lexicon(model.lexicon.entries), model.weights)
    plain.lexicon.trust = model.lexicon.trust
    expected = sorted(zip([r[0] for r in rows], plain.scores([r[1] for r in rows]).tolist(), strict=True), key=repr)
    assert sorted(((r["doc_id"], r["score"]) for r in toxicity.score(docs, model).collect()), key=repr) == expected
    other = odd_docs(spark, [(1, "a poltron and a scoundrel", None, None, 0), (2, "nothing", None, None, 0)])
    found = {r["doc_id"]: r["score"] for r in toxicity.score(other, model).collect()}
    assert found == dict(zip([1, 2], plain.scores(["a poltron and a scoundrel", "nothing"]).tolist(), strict=True))
