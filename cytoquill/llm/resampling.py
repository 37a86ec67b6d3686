"""Quality by importance resampling: hashed n-gram models of target and raw text, and Gumbel top-k.

Both models are distributions over hashed word unigrams and bigrams: the target's from documents labelled as good,
the raw one from all documents. A document's importance is the logarithm of the ratio of its likelihoods under the two;
adding Gumbel noise and keeping the k greatest is sampling without replacement in proportion to importance.

The target takes at most SAMPLE labelled documents, those with the smallest hashes of their doc_id; the raw model
counts every document. What a task gathers is one table of BUCKETS counts per partition.

Defined results: NULL, empty and wordless texts have importance 0; with no target rows every importance is 0 and
the sample is uniform; ties of the noisy score go to the smaller doc_id (NULL last), then to the smaller text hash, and rows still equal are ranked in any order; repeated rows are
separate rows with one noisy score between them, so all of them are kept but where the cut falls among them; an empty table gives an empty result; only doc_id and text are read, so
further columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoquill.llm.hashing import shingle_hashes, word_hashes
from cytoquill.llm.tables import columns, cut_lineage, hash_order, unit

BUCKETS = 1 << 14
#: Labelled documents that make the target, at most.
SAMPLE = 20_000
#: Share of all documents that the sample keeps.
KEEP = 0.5
#: Equal steps of the noisy score in which the cut of the top k is first looked up.
STEPS = 4096
SMOOTH = 1.0


def gram_buckets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Buckets of the word unigrams and bigrams of every text."""
    for first, last, words, bounds in word_hashes(texts):
        for i in range(last - first):
            own = words[bounds[i] : bounds[i + 1]]
            pairs = shingle_hashes(own, 2) if len(own) > 1 else own[:0]
            yield (np.concatenate([own, pairs]) % np.uint64(BUCKETS)).astype(np.int64)


def _counts(rows: DataFrame) -> np.ndarray:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for grams in gram_buckets(batch.column("text").to_pylist()):
                held += np.bincount(grams, minlength=BUCKETS)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], ["bucket", "held"])

    sums = rows.select("text").mapInArrow(count, "bucket bigint, held bigint").groupBy("bucket").agg(F.sum("held").alias("held"))
    out = np.zeros(BUCKETS)
    for r in sums.collect():  # at most BUCKETS rows
        out[r["bucket"]] = r["held"]
    return out


def importance(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Logarithm of target over raw likelihood of every bucket; zeros without a target."""
    text = columns(docs, doc_id="bigint", text="string")
    good = columns(labels, doc_id="bigint", quality="int").where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    picked = cut_lineage(good.orderBy(*hash_order(F.col("doc_id"))).limit(sample))
    target, raw = _counts(text.join(F.broadcast(picked), "doc_id")), _counts(text)
    if not target.sum():
        return np.zeros(BUCKETS)
    # Smoothing follows the raw model, so that buckets the target has hardly seen say little.
    prior = (raw + SMOOTH) / (raw + SMOOTH).sum()
    mass = SMOOTH * BUCKETS
    return np.log((target + mass * prior) / (target.sum() + mass)) - np.log(prior)


def score(docs: DataFrame, ratio: np.ndarray, seed: str = "resample") -> DataFrame:
    """One row per row of `docs`: doc_id, n_grams, importance, noisy. Stored."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(len(g), float(shared.value[g].sum())) for g in gram_buckets(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("mark"), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "mark", "n_grams", "importance"]
            )

    rows = columns(docs, doc_id="bigint", text="string").select("doc_id", "text", F.xxhash64("text").alias("mark"))
    scored = rows.mapInArrow(run, "doc_id bigint, mark bigint, n_grams bigint, importance double").withColumn("row", F.monotonically_increasing_id())
    noise = -F.log(-F.log(unit(F.lit(seed), F.col("doc_id"), F.col("mark"))))
    return cut_lineage(scored.withColumn("noisy", F.col("importance") + noise))


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """Add `kept`: whether a row is among the k greatest by `noisy`.

    A histogram finds the step in which the cut lies; only rows of that step are ranked, in finer steps while it holds too
    many, so no task sorts the table.
    """
    order = [F.col("noisy").desc(), F.col("doc_id").asc_nulls_last(), F.col("mark").asc_nulls_last(), F.col("row")]
    ends = scored.agg(F.min("noisy").alias("low"), F.max("noisy").alias("high"), F.count(F.lit(1)).alias("rows")).first()
    if k >= ends["rows"] or k <= 0:
        return scored.withColumn("kept", F.lit(k > 0))
    low, high, wanted = ends["low"], ends["high"], k
    while True:
        width = (high - low) / STEPS
        step = F.least(F.lit(STEPS - 1), F.floor((F.col("noisy") - low) / width).cast("int")) if width > 0 else F.lit(0)
        inside = scored.where((F.col("noisy") >= low) & (F.col("noisy") <= high))
        above = 0
        for r in sorted(inside.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):  # at most STEPS rows
            if above + r["count"] >= wanted:
                break
            above += r["count"]
        edge = inside.where(step == r["step"])
        ends = edge.agg(F.min("noisy").alias("low"), F.max("noisy").alias("high"), F.count(F.lit(1)).alias("rows")).first()
        wanted -= above
        low, high = ends["low"], ends["high"]
        if ends["rows"] <= 10_000 or low == high:
            break
    # Rows equal in score beyond what one sort takes are told apart by doc_id in the same way they would be ranked.
    last = edge.orderBy(*order).limit(wanted)
    cut = last.orderBy(*[F.col("noisy").asc(), F.col("doc_id").desc_nulls_first(), F.col("mark").desc_nulls_first(), F.col("row").desc()]).first()
    rank = F.struct(F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1)), F.coalesce("mark", F.lit((1 << 63) - 1)), F.col("row"))
    top = (1 << 63) - 1
    at = F.struct(F.lit(cut["doc_id"] if cut["doc_id"] is not None else top).cast("bigint"), F.lit(cut["mark"] if cut["mark"] is not None else top).cast("bigint"), F.lit(cut["row"]).cast("bigint"))
    return scored.withColumn("kept", (F.col("noisy") > cut["noisy"]) | ((F.col("noisy") == cut["noisy"]) & (rank <= at)))


def resample(docs: DataFrame, labels: DataFrame, keep: float = KEEP, sample: int = SAMPLE, seed: str = "resample") -> DataFrame:
    """One row per row of `docs`: doc_id, n_grams, importance, noisy, kept."""
    scored = score(docs, importance(docs, labels, sample), seed)
    return top_k(scored, round(keep * scored.count())).select("doc_id", "n_grams", "importance", "noisy", "kept")
