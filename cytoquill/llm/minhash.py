"""Document fingerprints by MinHash over word shingles.

A signature keeps, for each of many universal hash permutations, the smallest value over the shingles of a text
(16 bits of it are stored). The share of equal places estimates the Jaccard similarity of two shingle sets.
Bands of a signature are joined in Spark to find near copies, and candidates are verified by exact Jaccard
similarity (`near_duplicates`).

Defined results: NULL is an empty text; texts without words share one signature and are like each other (1.0) and
unlike any other (0.0); a text of fewer words than a shingle is one shingle; equal texts have equal fingerprints;
documents are ordered by doc_id (NULL last) and, where equal, by text, so repeated rows follow each other; a table
of one row is its own successor; an empty table gives an empty result; only doc_id and text are read, so further
columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoquill.llm import jaccard
from cytoquill.llm.hashing import mix, shingle_hashes, word_hashes
from cytoquill.llm.tables import columns, parts_for

SHINGLE = 5
PERMUTATIONS = 128
BANDS = 32
SIMILARITY = 80
#: Documents that are fingerprinted in order by one task.
RUN_ROWS = 4_000

_rng = np.random.Generator(np.random.PCG64(7))
_MULTIPLY = _rng.integers(0, 1 << 62, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_EMPTY = np.zeros(PERMUTATIONS, np.uint16)


def signature(shingles: np.ndarray) -> np.ndarray:
    """16 bits of the smallest value under each permutation; zeros if there is no shingle."""
    if not len(shingles):
        return _EMPTY
    least = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 512):
        np.minimum(least, (shingles[at : at + 512, None] * _MULTIPLY + _ADD).min(axis=0), out=least)
    # High bits of the smallest values are all zero, so the kept bits come from below.
    return ((least >> np.uint64(20)) & np.uint64(0xFFFF)).astype(np.uint16)


def signatures(texts: list[str | None], n: int = SHINGLE) -> list[np.ndarray]:
    out = []
    for first, last, words, bounds in word_hashes(texts):
        out += [signature(shingle_hashes(words[bounds[i] : bounds[i + 1]], n)) for i in range(last - first)]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity, corrected for places that agree by chance."""
    if a is _EMPTY or b is _EMPTY:
        return float(a is b)
    chance = 2.0**-16
    return max(0.0, (float(np.mean(a == b)) - chance) / (1 - chance))


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as many characters, or all, from the start of the one that follows."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _fingerprint_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (run, order); the last row of a run is the first document of the next one (`ahead`)."""
    previous = None
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512).to_pydict()
            texts = [t or "" for t in part["text"]]
            marks = signatures(texts)
            held = ([previous] if previous else []) + list(zip(part["run"], part["doc_id"], texts, marks, part["ahead"], strict=True))
            pairs = [(a, b) for a, b in zip(held, held[1:], strict=False) if not a[4] and a[0] == b[0]]
            previous = held[-1]
            if not pairs:
                continue
            changed = [edited(a[2], b[2]) for a, b in pairs]
            new = signatures(changed)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array([a[1] for a, _ in pairs], pa.int64()),
                    "n_chars": pa.array([len(a[2]) for a, _ in pairs], pa.int64()),
                    "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
                    "fingerprint": [a[3].tobytes().hex() for a, _ in pairs],
                    "edited_fingerprint": [m.tobytes().hex() for m in new],
                    "near_edited": [likeness(a[3], m) for (a, _), m in zip(pairs, new, strict=True)],
                    "near_next": [likeness(a[3], b[3]) for a, b in pairs],
                }
            )


def _run_bounds(ids: DataFrame, each: int) -> list[int]:
    """Existing doc_ids at which runs of about `each` rows start; the first is the smallest."""
    rows = ids.count()
    runs = parts_for(rows, each)
    steps = F.array(*(F.lit(i / runs) for i in range(runs)))
    found = ids.agg(F.min("doc_id").alias("least"), F.percentile_approx("doc_id", steps, F.lit(max(10_000, 20 * runs))).alias("cuts")).first()
    return sorted({found["least"], *(found["cuts"] or [])} - {None})


def fingerprint_in_order(docs: DataFrame, each: int = RUN_ROWS) -> DataFrame:
    """Fingerprint every text, its edited text, and compare with the document that follows by doc_id.

    Documents are cut into runs at existing doc_ids. The first document of a run also goes, as a last row, to the run
    before it (and the very first to the last), so every run knows what follows and texts move once.
    """
    text = columns(docs, doc_id="bigint", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    bounds = _run_bounds(text.select("doc_id"), each)
    inner = np.array(bounds[1:], np.int64)

    @F.pandas_udf("int")
    def run_of(ids: pd.Series) -> pd.Series:
        at = np.full(len(ids), len(inner), np.int32)  # NULL comes last
        known = ids.notna().to_numpy()
        at[known] = np.searchsorted(inner, ids[known].astype("int64"), side="right")
        return pd.Series(at)

    runs = max(1, len(bounds))
    first = text.where(F.col("doc_id").isin(bounds)) if bounds else text
    first = first.groupBy("doc_id").agg(F.min("text").alias("text"))
    ahead = first.select(F.pmod(run_of("doc_id") - 1, F.lit(runs)).cast("int").alias("run"), F.lit(True).alias("ahead"), "doc_id", "text")
    rows = text.select(run_of("doc_id").alias("run"), F.lit(False).alias("ahead"), "doc_id", "text").unionAll(ahead)
    ordered = rows.repartitionById(runs, F.col("run")).sortWithinPartitions("run", "ahead", F.col("doc_id").asc_nulls_last(), "text")
    return ordered.mapInArrow(_fingerprint_run, _OUT)


def near_duplicates(docs: DataFrame, percent: int = SIMILARITY, bands: int = BANDS) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id (smallest doc_id reachable by links).

    Two documents link if a band of their signatures is equal and their exact Jaccard similarity reaches `percent`. The bands are
    joined in Spark, texts with equal shingle sets as one, and no candidate pair that could connect two components is left
    out; what is missed is what no band shows (at 0.8, less than one link in a million).
    """
    width = PERMUTATIONS // bands

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, buckets, owners = set(), [], []
            for grams in jaccard.gram_sets(batch.column("text").to_pylist(), SHINGLE):
                own = jaccard.class_of(grams)
                if own and own not in seen:
                    seen.add(own)
                    parts = signature(grams).astype(np.uint64).reshape(bands, width)
                    names = mix((parts * _MULTIPLY[:width]).sum(axis=1, dtype=np.uint64) + _ADD[:bands])
                    buckets.append(names.view(np.int64))
                    owners.append(np.full(bands, own, np.int64))
            if buckets:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(buckets)), pa.array(np.concatenate(owners))], ["segment", "class"])

    classes = jaccard.document_classes(docs, SHINGLE)
    rows = columns(docs, text="string").mapInArrow(banded, "segment bigint, class bigint")
    shared = jaccard.keep_shared(rows, bands * classes.count())
    return jaccard.name_components(classes, jaccard.link_classes(docs, classes, SHINGLE, percent, shared))


def exact_jaccard(a: str, b: str, n: int = SHINGLE) -> float:
    sets = []
    for _, _, words, bounds in word_hashes([a]):
        sets.append(np.unique(shingle_hashes(words[bounds[0] : bounds[1]], n)))
    for _, _, words, bounds in word_hashes([b]):
        sets.append(np.unique(shingle_hashes(words[bounds[0] : bounds[1]], n)))
    both = len(np.intersect1d(*sets, assume_unique=True))
    return both / max(1, len(sets[0]) + len(sets[1]) - both)
