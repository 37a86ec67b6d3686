"""Ranked lexical search of many queries at once, by multi-query common-subexpression evaluation.

A query (item) is a sum over its terms, and items share terms. Sets of terms that several items hold are mined first: again and
again the pairs of partial sums that most items share become partial sums of their own. The result is a DAG whose leaves
are terms, whose inner nodes are sums shared by at least two items, and in which every item is a short list of nodes.

Documents are tokenised once into postings of the items' terms (a stored table), from which the corpus statistics are
aggregated. Scoring goes over the postings in blocks of documents: every node of the DAG is accumulated once per block, for
all its documents, and the items are read off. A task keeps its best k documents of each item, and a ranked window joins
the tasks' lists. All scores are 64-bit integers, so the order of summation does not matter.

Terms are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased, held as 64-bit hashes.

Defined results: NULL, empty and wordless texts have no terms, score nothing and do not count in N; items without terms have
no results; repeated rows of documents are documents of their own (equal scores and ids share no rank); repeated rows of items are
items of their own; NULL doc_ids come last among equal scores; an empty table gives an empty result. Only doc_id, item_id and text are
read, so further columns cannot clash. Very long texts are hashed piece by piece.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cytoquill.llm.hashing import NOT_ALNUM, word_hashes
from cytoquill.llm.tables import columns, load_arrays, query_chunks, shared_arrays, stored

#: Results of an item.
BEST = 10
#: Characters of items that are evaluated together; more items take more rounds over the documents.
CHUNK_CHARS = 400_000
#: Accumulators held at once: nodes of the DAG times documents of a block.
ACCUMULATORS = 4_000_000

_POSTINGS = "doc_id bigint, n bigint, terms array<int>, times array<int>"


def terms_of(texts: Sequence[str]) -> list[np.ndarray]:
    """Term hashes of every text, repeats included, as signed numbers."""
    out = []
    for first, last, words, bounds in word_hashes(texts, NOT_ALNUM):
        out += [words[bounds[i] : bounds[i + 1]].view(np.int64) for i in range(last - first)]
    return out


class Plan:
    """A sharing DAG over items. A leaf is a term with its repeats in an item; node numbers ascend from leaves to sums."""

    def __init__(self, items: list[np.ndarray]):
        self.terms = np.unique(np.concatenate([np.zeros(0, np.int64), *items]))
        counted = [np.unique(np.searchsorted(self.terms, hashes), return_counts=True) for hashes in items]
        leaves = sorted({leaf for terms, times in counted for leaf in zip(terms.tolist(), times.tolist(), strict=True)})
        numbers = {leaf: i for i, leaf in enumerate(leaves)}
        self.leaf_terms = np.array([t for t, _ in leaves], np.int64)
        self.leaf_times = np.array([q for _, q in leaves], np.int64)
        lists = [[numbers[leaf] for leaf in zip(terms.tolist(), times.tolist(), strict=True)] for terms, times in counted]
        self.sums: list[tuple[int, int]] = []
        level = [0] * len(leaves)
        while True:
            holders = Counter(node for nodes in lists for node in nodes)
            for nodes in lists:
                nodes.sort(key=lambda node: (-holders[node], node))
            shared = Counter(pair for nodes in lists for pair in zip(nodes, nodes[1:], strict=False))
            chosen: dict[tuple[int, int], int] = {}
            used: set[int] = set()
            for pair, times in sorted(shared.items(), key=lambda entry: (-entry[1], entry[0])):
                if times < 2:
                    break
                if not used.intersection(pair):
                    used.update(pair)
                    chosen[pair] = len(leaves) + len(self.sums)
                    self.sums.append(pair)
                    level.append(1 + max(level[pair[0]], level[pair[1]]))
            if not chosen:
                break
            for k, nodes in enumerate(lists):
                out, i = [], 0
                while i < len(nodes):
                    pair = tuple(nodes[i : i + 2])
                    out.append(chosen.get(pair, nodes[i]))
                    i += 2 if pair in chosen else 1
                lists[k] = out
        self.lists, self.level = lists, level

    def arrays(self) -> dict[str, np.ndarray]:
        """The plan as arrays: leaves by term, sums by level, and the nodes of every item that has any."""
        leaves = len(self.leaf_terms)
        order = np.argsort(np.array(self.level[leaves:], np.int64), kind="stable")
        place = np.arange(leaves + len(order))
        place[leaves + order] = leaves + np.arange(len(order))
        sums = place[np.array(self.sums, np.int64).reshape(-1, 2)[order]]
        items = [i for i, nodes in enumerate(self.lists) if nodes]
        return {
            "terms": self.terms,
            "leaf_terms": self.leaf_terms,
            "leaf_times": self.leaf_times,
            "sums": sums,
            "levels": np.array(self.level[leaves:], np.int64)[order],
            "items": np.array(items, np.int64),
            "nodes": place[np.array([n for i in items for n in self.lists[i]], np.int64)],
            "bounds": np.cumsum([0] + [len(self.lists[i]) for i in items]),
        }


def _postings(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = load_arrays(name)["terms"]
        for batch in batches:
            sizes, found, times, ends = [], [], [], [np.zeros(1, np.int64)]
            for first, last, words, bounds in word_hashes(batch.column("text").to_pylist(), NOT_ALNUM):
                rows = last - first
                at = np.minimum(np.searchsorted(terms, words.view(np.int64)), len(terms) - 1) if len(terms) else np.zeros(0, np.int64)
                known = np.flatnonzero(terms[at] == words.view(np.int64)) if len(terms) else at
                row = np.searchsorted(bounds, known, side="right") - 1
                pairs, count = np.unique(row * len(terms) + at[known], return_counts=True)
                sizes.append(np.diff(bounds))
                found.append(pairs % max(1, len(terms)))
                times.append(count)
                ends.append(ends[-1][-1] + np.searchsorted(pairs, np.arange(1, rows + 1) * len(terms)))
            if sizes:
                lists = pa.array(np.concatenate(ends).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array(np.concatenate(sizes).astype(np.int64)),
                        pa.ListArray.from_arrays(lists, pa.array(np.concatenate(found).astype(np.int32))),
                        pa.ListArray.from_arrays(lists, pa.array(np.concatenate(times).astype(np.int32))),
                    ],
                    ["doc_id", "n", "terms", "times"],
                )

    return run


class _Best:
    """The k best (score, doc_id) of every item so far."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, np.int64)
        self.held = [np.zeros((0, 4), np.int64)]
        self.size = 0

    def add(self, scores: np.ndarray, ids: np.ndarray, unknown: np.ndarray) -> None:
        """Scores of all items over further documents; those under an item's k-th best are passed over, ties are kept."""
        item, doc = np.nonzero(scores >= self.least[:, None])
        self.held.append(np.stack([item, -scores[item, doc], unknown[doc], ids[doc]], axis=1))
        self.size += len(item)
        if self.size > 8 * self.k * len(self.least) + 100_000:
            self.cut()

    def cut(self) -> np.ndarray:
        rows = np.concatenate(self.held)
        rows = rows[np.lexsort(rows.T[::-1])]
        first = np.searchsorted(rows[:, 0], rows[:, 0])
        rows = rows[np.arange(len(rows)) - first < self.k]
        count = np.bincount(rows[:, 0], minlength=len(self.least))
        full = np.flatnonzero(count == self.k)
        self.least[full] = -rows[np.cumsum(count)[full] - 1, 1]
        self.held, self.size = [rows], len(rows)
        return rows


def evaluate(plan: dict[str, np.ndarray], leaf_values: np.ndarray) -> np.ndarray:
    """Scores (items x documents) from the values of the leaves: every shared sum is made once."""
    leaves = len(plan["leaf_terms"])
    nodes = np.concatenate([leaf_values, np.zeros((len(plan["sums"]), leaf_values.shape[1]), np.int64)])
    for cut in np.split(np.arange(len(plan["sums"])), np.flatnonzero(np.diff(plan["levels"])) + 1):
        nodes[leaves + cut] = nodes[plan["sums"][cut, 0]] + nodes[plan["sums"][cut, 1]]
    return np.add.reduceat(nodes[plan["nodes"]], plan["bounds"][:-1], axis=0)


def _score(name: str, k: int, documents: int, words: int):
    """`documents` and `words`: N and L of the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = load_arrays(name)
        leaf_terms, weights = plan["leaf_terms"], plan["weights"][plan["leaf_terms"]] * plan["leaf_times"]
        first = np.searchsorted(leaf_terms, np.arange(len(plan["terms"]) + 1))
        width = max(1, ACCUMULATORS // max(1, len(leaf_terms) + len(plan["sums"])))
        best = _Best(len(plan["items"]), k)
        for batch in batches if len(plan["items"]) else ():
            for at in range(0, batch.num_rows, width):
                part = batch.slice(at, width)
                size = part.column("n").to_numpy()
                lists, times = part.column("terms"), part.column("times").flatten().to_numpy()
                held = lists.value_lengths().to_numpy()
                doc = np.repeat(np.arange(len(size)), held)
                m = 25 + (75 * size * documents) // words
                value = (1_000_000_000 * times.astype(np.int64)) // (1000 * times.astype(np.int64) + 8 * m[doc])
                # A term gives one leaf for each number of repeats that an item has of it.
                term = lists.flatten().to_numpy()
                count = first[term + 1] - first[term]
                leaf = np.repeat(first[term] - np.cumsum(count) + count, count) + np.arange(count.sum())
                values = np.zeros((len(leaf_terms), len(size)), np.int64)
                values[leaf, np.repeat(doc, count)] = np.repeat(value, count) * weights[leaf]
                ids = part.column("doc_id")
                best.add(evaluate(plan, values), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64))
        rows = best.cut()
        item = plan["items"][rows[:, 0]]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(item),
                pa.array(plan["item_ids"][item], mask=~plan["named"][item]),
                pa.array(rows[:, 3], mask=rows[:, 2] == 1),
                pa.array(-rows[:, 1]),
            ],
            ["item", "item_id", "doc_id", "score"],
        )

    return run


_FOUND = "item bigint, item_id bigint, doc_id bigint, score bigint"


def _search(docs: DataFrame, items: list, k: int) -> DataFrame:
    spark = docs.sparkSession
    plan = Plan(terms_of([r["text"] for r in items])).arrays()
    postings = stored(columns(docs, doc_id="bigint", text="string").mapInArrow(_postings(shared_arrays(spark, "terms", terms=plan["terms"])), _POSTINGS), "postings")
    total = postings.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("words")).first()
    documents, words = total["documents"], total["words"] or 0
    df = np.zeros(len(plan["terms"]), np.int64)
    # At most as many rows as the items have terms.
    for row in postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        df[row["term"]] = row["count"]
    plan["weights"] = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * held + 1))) for held in df.tolist()], np.int64)
    plan["item_ids"] = np.array([r["item_id"] or 0 for r in items], np.int64)
    plan["named"] = np.array([r["item_id"] is not None for r in items], bool)
    scored = postings.where("size(terms) > 0").mapInArrow(_score(shared_arrays(spark, "sharing-plan", **plan), k, documents, max(1, words)), _FOUND)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item with a score above 0."""
    found = None
    for rows in query_chunks(items, CHUNK_CHARS):
        part = _search(docs, rows, k)
        found = part if found is None else found.unionAll(part)
    return found
