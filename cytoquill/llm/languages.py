"""Language identification by mixture inference.

Every learned language has a table of byte trigram likelihoods. The words of a document come from an unknown
mixture of the languages; expectation-maximisation over the words' likelihoods estimates its proportions, and the set of
languages is the one whose likelihood, less half the logarithm of the number of words for each further language, is
greatest, found by leaving out the language with the smallest proportion again and again. Each estimate takes at most STEPS
rounds, or fewer once proportions move by less than 0.0001.

Counts are taken over all documents with a language outside the held-out part.

Defined results: `und` with score 0 for NULL texts and texts without a letter; with no learned language every text is
`und`; ties go to the first language by name; repeated rows are separate rows; a NULL doc_id is not held out and
never trains; an empty table gives an empty result; only doc_id, text and lang are read, so further columns cannot
clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoquill.llm.tables import columns
from cytoquill.llm.toxicity import held_out

BITS = 14
#: Learned languages, at most; more would not fit one task's tables, and are refused.
MOST_LANGUAGES = 1_000
STEPS = 12
#: Texts are looked up in pieces of this many bytes.
PIECE = 1 << 18
_LETTER = regex.compile(r"\p{L}")
_PLAIN = np.full(256, 0x20, np.uint8)
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[128:] = np.arange(128, 256)


def trigrams(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram around every byte of a word, and the starts of words among them."""
    b = _PLAIN[np.frombuffer(b"  " + data + b" ", np.uint8)].astype(np.uint32)
    inside = b[1:-1] != 0x20
    grams = (b[:-2] * np.uint32(2654435761) + b[1:-1] * np.uint32(2246822519) + b[2:] * np.uint32(3266489917)) >> np.uint32(32 - BITS)
    starts = np.flatnonzero(np.diff(np.concatenate(([False], inside)).astype(np.int8)) == 1)
    where = np.cumsum(inside) - 1
    return grams[inside].astype(np.int64), where[starts]


def _pieces(text: str) -> Iterator[bytes]:
    data = text.lower().encode("utf-8", "surrogatepass")
    at = 0
    while len(data) - at > PIECE:
        end = data.rfind(b" ", at, at + PIECE)
        end = at + PIECE if end <= at else end
        yield data[at:end]
        at = end
    yield data[at:]


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order of name, and the log-likelihoods of trigram buckets (languages x buckets)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                into = held.setdefault(lang, np.zeros(1 << BITS, np.int64))
                for piece in _pieces(text):
                    into += np.bincount(trigrams(piece)[0], minlength=1 << BITS)
        for lang, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(counts[at])], ["lang", "bucket", "held"])

    rows = columns(docs, doc_id="bigint", text="string", lang="string").where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL").where(~held_out(F.col("doc_id"), 4, 2))
    sums = rows.select("text", "lang").mapInArrow(count, "lang string, bucket bigint, held bigint").groupBy("lang", "bucket").agg(F.sum("held").alias("held"))
    found = sums.groupBy("lang").agg(F.collect_list(F.struct("bucket", "held")).alias("counts")).orderBy("lang").limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    table = np.full((len(found), 1 << BITS), 0.5)
    for i, r in enumerate(found):
        pairs = np.array([(c["bucket"], c["held"]) for c in r["counts"]], np.int64).reshape(-1, 2)
        table[i, pairs[:, 0]] += pairs[:, 1]
    return [r["lang"] for r in found], np.log(table / table.sum(axis=1, keepdims=True))


def mixture(likelihood: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Proportions and log-likelihood of a mixture; rows are words scaled to a largest likelihood of 1."""
    k = likelihood.shape[1]
    share = np.full(k, 1.0 / k)
    for _ in range(steps):
        joint = likelihood * share
        new = (joint / joint.sum(axis=1, keepdims=True)).mean(axis=0)
        done = np.abs(new - share).max() < 1e-4
        share = new
        if done:
            break
    return share, float(np.log(np.maximum(likelihood @ share, 1e-300)).sum())


class LanguageModel:
    def __init__(self, names: list[str], table: np.ndarray):
        self.names, self.table = names, np.ascontiguousarray(table.T)

    def word_scores(self, text: str) -> np.ndarray:
        out = []
        for piece in _pieces(text):
            grams, starts = trigrams(piece)
            if len(starts):
                out.append(np.add.reduceat(self.table[grams], starts, axis=0))
        return np.concatenate(out) if out else np.zeros((0, len(self.names)))

    def infer(self, text: str | None) -> tuple[str, float, list[str]]:
        """The main language, its proportion in the whole mixture, and the selected set."""
        if text is None or not self.names or not _LETTER.search(text):
            return "und", 0.0, []
        words = self.word_scores(text)
        if not len(words):
            return "und", 0.0, []
        scaled = np.exp(np.maximum(words - words.max(axis=1, keepdims=True), -40.0))
        cost = 0.5 * np.log(len(words) + 1)
        kept = np.arange(len(self.names))
        whole, fit = mixture(scaled)
        share = whole
        while len(kept) > 1:
            # Of equally small ones the last by name goes.
            fewer = np.delete(kept, len(share) - 1 - np.argmin(share[::-1]))
            small, small_fit = mixture(scaled[:, fewer])
            if small_fit + cost < fit:
                break
            kept, share, fit = fewer, small, small_fit
        main = kept[int(np.argmax(share))]
        return self.names[main], float(min(1.0, max(0.0, whole[main]))), [self.names[i] for i in kept]


def identify(docs: DataFrame, names: list[str], table: np.ndarray) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, lang_pred, score, languages (the selected set)."""
    shared = docs.sparkSession.sparkContext.broadcast(LanguageModel(names, table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.infer(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("out"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([",".join(f[2]) for f in found], pa.string())],
                ["doc_id", "held_out", "lang_pred", "score", "languages"],
            )

    rows = columns(docs, doc_id="bigint", text="string").withColumn("out", held_out(F.col("doc_id"), 4, 2))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double, languages string")
