"""Languages: held-out accuracy, mixtures, odd cases."""

import unicodedata
import zlib

import numpy as np

from cytoquill.llm import languages

from .data import no_docs, odd_docs, odd_rows

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_mixtures(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, table = languages.learn(docs)
    found = languages.identify(docs, names, table).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(found) > 100
    assert sum(r["lang_pred"] == r["lang"] for r in found) / len(found) >= 0.98
    # Halves of two languages give both, with the longer one first.
    text = {r["lang"]: r["text"] for r in docs.where("n_chars BETWEEN 1000 AND 3000").orderBy("doc_id").collect()}
    model = languages.LanguageModel(names, table)
    main, score, chosen = model.infer(" ".join(text["de"].split()[:80] + text["fr"].split()[:50]))
    assert main == "de" and set(chosen) == {"de", "fr"} and 0.5 < score < 0.75


def test_mixture_is_a_maximum():
    import numpy as np

    rng = np.random.default_rng(2)
    words = rng.uniform(0.01, 1, (200, 3))
    words /= words.max(axis=1, keepdims=True)
    share, fit = languages.mixture(words, 500)
    for _ in range(200):
        other = np.abs(share + rng.normal(0, 0.02, 3))
        other /= other.sum()
        assert np.log(words @ other).sum() <= fit + 1e-3


def test_odd_rows(spark):
    rows = odd_rows() + [(900, "1234 -- !!", "en", "s", 1), (901, "\u00bd \u00b2 \u2167 _", "en", "s", 1), (902, "\u00bd \u00aa", "en", "s", 1)]
    docs = odd_docs(spark, rows)
    names, table = languages.learn(docs)
    assert names == ["de", "en", "fr"] or names == ["de", "en"]
    found = languages.identify(docs, names, table).collect()
    assert len(found) == len(rows)
    text = {r[0]: r[1] for r in rows}
    for r in found:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
        if r["doc_id"] is not None:
            assert (r["lang_pred"] == "und") == (not any(unicodedata.category(c).startswith("L") for c in text[r["doc_id"]] or ""))


def test_empty(spark):
    names, table = languages.learn(no_docs(spark))
    assert names == [] and languages.identify(no_docs(spark), names, table).count() == 0
    assert {r["lang_pred"] for r in languages.identify(odd_docs(spark), names, table).collect()} == {"und"}


def test_equal_languages_go_to_the_first_by_name():
    table = np.log(np.random.default_rng(1).dirichlet(np.ones(1 << languages.BITS)))
    model = languages.LanguageModel(["aa", "bb", "cc"], np.stack([table, table, table - 3]))
    assert model.infer("some words of one kind or another")[0] == "aa"
