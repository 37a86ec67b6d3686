"""BPE: ids and decoding against the tokenizers library, and the automaton on its own."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cytoquill.llm import bpe

from .data import no_docs, odd_docs, odd_rows, words

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def peer():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def hard_texts():
    rng = random.Random(6)
    letters = "aab  \t\n'sdtrevlmé  \u0085​\x1c\x00<|endoftext|>١٢½Ⅷ漢字🙂\U0001d538.,!-_#İßﬁ﻿"
    out = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    out += ["<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", " <|endoftext|>\n", "it's we'll I'd 's", "   lead", "trail   ", "a" * 3000, "ab" * 2000, " " * 500]
    return out + [words(rng, 300)]


def digest(ids):
    return hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


@pytest.mark.parametrize("limit", [0, 50, 50_000])
def test_equals_library(spark, peer, limit):
    rows = odd_rows() + [(10_000 + i, t, "en", "s", len(t)) for i, t in enumerate(hard_texts())]
    found = bpe.encode(odd_docs(spark, rows), PATH, limit, with_ids=True).collect()
    expected = []
    for r in rows:
        ids = peer.encode(r[1] or "", add_special_tokens=False).ids
        expected.append((r[0], len(ids), digest(ids), hashlib.sha256(peer.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted((tuple(r[:4]) for r in found), key=repr) == sorted(expected, key=repr)
    assert all(digest(r["ids"]) == r["ids_sha256"] for r in found)


def test_automaton_numbers_strings_in_order(tmp_path):
    rng = random.Random(1)
    strings = sorted({bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 9))) for _ in range(500)})
    path = tmp_path / "lexicon"
    path.write_bytes(bpe.compile_lexicon({s: [i, i + 1] for i, s in enumerate(strings)}))
    lexicon = bpe.Lexicon(str(path))
    asked = strings + [b"", b"d", b"abcabcabcabc", b"ab\xff"]
    lengths = np.array([len(s) for s in asked], np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    number = lexicon.numbers(np.frombuffer(b"".join(asked), np.uint8), starts, lengths)
    assert number.tolist() == [strings.index(s) if s in strings else -1 for s in asked]
    # Shared endings: fewer states than a trie has.
    assert len(lexicon.final) < len({s[:i] for s in strings for i in range(len(s) + 1)}) / 2


def test_decoding_replaces_broken_bytes_and_refuses_unknown_ids(peer, tmp_path):
    path = tmp_path / "none"
    path.write_bytes(bpe.compile_lexicon({}))
    encoder = bpe.Encoder(bpe.Vocabulary(PATH), bpe.Lexicon(str(path)))
    ids = peer.encode("é🙂", add_special_tokens=False).ids
    for part in (ids[:1], ids[1:], ids[:-1]):
        assert encoder.decode(np.array(part)) == peer.decode(part, skip_special_tokens=False)
    with pytest.raises(ValueError):
        encoder.decode(np.array([60_000]))


def test_empty(spark):
    assert bpe.encode(no_docs(spark), PATH).count() == 0


real = bpe.shared_file


def test_lexicon_does_not_depend_on_the_documents(spark, monkeypatch):
    """Nothing is counted or sampled: the same lexicon is compiled for every table, whatever its size."""
    made = []
    monkeypatch.setattr(bpe, "shared_file", lambda session, data, name: made.append(data) or real(session, data, name))
    for docs in (no_docs(spark), odd_docs(spark, odd_rows())):
        bpe.encode(docs, PATH, 500)
    assert made[0] == made[1]
    vocabulary = bpe.Vocabulary(PATH)
    assert len(bpe.frequent_pieces(vocabulary, 500)) == 500
