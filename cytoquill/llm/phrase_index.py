"""Benchmark passages in training text, by a distributed positional inverted index.

The index is a table in the shared folder. One row is a segment of whole documents: its sorted terms, for each the
ascending positions at which it stands, and where the documents begin. Segments are built, stored and searched in
parallel and nothing is moved between them, so a term or passage that a third of all rows hold costs each segment its own
share only.

Test items are cut into windows of consecutive words. In a segment, a window starts from the positions of its rarest
term, shifted by the term's offset in the window; then the lists of the next rarer terms, shifted by theirs, are intersected
with what is left. Most windows end at once, because a term of theirs is missing. An exact match is an intersection without
tolerance. A proximity match allows a slop: there is a start from which every word of the window stands within `slop` words of its
place, in the same document.

Terms are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased, and are held as 64-bit hashes: a false match needs
a wrong word with an equal hash at every differing place of a window.

Defined results: NULL, empty and wordless texts have no words and no hits; an item without words has no window; one with fewer
words than a window is one window; repeated rows of documents are separate rows of the result; repeated items count once by item_id; items
with a NULL item_id count as one item, which no list names; an empty table of documents gives an empty result, one of items
no hits. Only doc_id, item_id and text are read, so further columns cannot clash. A document is never split, so a segment
with a very long text is as large as the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoquill.llm.hashing import NOT_ALNUM, word_hashes
from cytoquill.llm.tables import columns, load_arrays, query_chunks, shared_arrays, stored

#: Consecutive words of a window.
WINDOW = 10
#: A segment is closed at so many words or documents.
SEGMENT_WORDS, SEGMENT_DOCUMENTS = 1 << 19, 1 << 16
#: Segments of a file of the index: one batch of a scan stays small.
SEGMENTS_PER_FILE = 16
#: Characters of test items that are shipped to the executors as one file.
CHUNK_CHARS = 4_000_000
#: Candidates that one step of a search holds; more windows take more steps.
STEP = 2_000_000

_INDEX = "doc_ids array<bigint>, starts array<int>, terms array<bigint>, ends array<int>, positions array<int>"
_LISTS = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
_NAMES = ["doc_ids", "starts", "terms", "ends", "positions"]


def _segment(ids: list[int | None], held: list[np.ndarray]) -> pa.RecordBatch:
    sizes = np.array([len(h) for h in held], np.int64)
    words = np.concatenate(held).view(np.int64)
    order = np.argsort(words, kind="stable").astype(np.int32)
    sorted_words = words[order]
    first = np.flatnonzero(np.diff(sorted_words, prepend=sorted_words[:1] + 1)) if len(words) else np.zeros(0, np.int64)
    starts = np.zeros(len(ids) + 1, np.int32)
    np.cumsum(sizes, out=starts[1:])
    parts = [ids, starts, sorted_words[first], np.append(first[1:], len(words))[: len(first)].astype(np.int32), order]
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(p)], pa.array(p, kind)) for p, kind in zip(parts, _LISTS, strict=True)], _NAMES)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, held, size = [], [], 0
    for batch in batches:
        names, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        for first, last, words, bounds in word_hashes(texts, NOT_ALNUM):
            for i in range(last - first):
                ids.append(names[first + i])
                held.append(words[bounds[i] : bounds[i + 1]])
                size += len(held[-1])
                if size >= SEGMENT_WORDS or len(ids) >= SEGMENT_DOCUMENTS:
                    yield _segment(ids, held)
                    ids, held, size = [], [], 0
    if ids:
        yield _segment(ids, held)


def build(docs: DataFrame) -> DataFrame:
    """The index of all texts, stored as Parquet."""
    rows = columns(docs, doc_id="bigint", text="string").mapInArrow(_segments, _INDEX)
    return stored(rows, "phrase-index", compression="zstd", maxRecordsPerFile=str(SEGMENTS_PER_FILE))


def _window_arrays(rows: list, window: int) -> dict[str, np.ndarray]:
    """Words of items as numbers of sorted terms, and every window: first word, length, item among `ids`, place in the item."""
    owners = {}
    words, starts, lengths, owner, within = [np.zeros(0, np.uint64)], [], [], [], []
    at = 0
    for first, last, hashes, bounds in word_hashes([r["text"] for r in rows], NOT_ALNUM):
        for i in range(last - first):
            n = int(bounds[i + 1] - bounds[i])
            length = min(window, n)
            count = n - length + 1 if n else 0
            mine = owners.setdefault(rows[first + i]["item_id"], len(owners))
            starts.append(at + np.arange(count))
            lengths.append(np.full(count, length))
            owner.append(np.full(count, mine))
            within.append(np.arange(count))
            words.append(hashes[bounds[i] : bounds[i + 1]])
            at += n
    terms, numbers = np.unique(np.concatenate(words).view(np.int64), return_inverse=True)
    none = [np.zeros(0, np.int64)]
    ids = list(owners)
    return {
        "terms": terms,
        "words": numbers.astype(np.int64),
        "starts": np.concatenate(none + starts),
        "lengths": np.concatenate(none + lengths),
        "owner": np.concatenate(none + owner),
        "within": np.concatenate(none + within),
        "ids": np.array([0 if i is None else i for i in ids], np.int64),
        "named": np.array([i is not None for i in ids], bool),
    }


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of every run."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


class Segment:
    """The postings of one segment."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        ids, *parts = (batch.column(name)[row].values for name in _NAMES)
        self.ids = ids
        self.starts, self.terms, self.ends, self.positions = (p.to_numpy(zero_copy_only=False) for p in parts)

    def search(self, windows: dict[str, np.ndarray], width: int, slop: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(window, start, document) of every match, in steps of bounded size."""
        terms = windows["terms"]
        if not len(self.terms) or not len(terms):
            return
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        begins = np.where(at > 0, self.ends[at - 1], 0).astype(np.int64)
        counts = np.where(self.terms[at] == terms, self.ends[at] - begins, 0)
        # All postings of test terms as ascending (term, position) keys: a look-up is one binary search.
        postings = self.positions[_spread(begins, counts)].astype(np.int64)
        keys = (np.repeat(np.arange(len(terms)), counts) << 32) | postings
        offsets = np.cumsum(counts) - counts
        # Places past the end of a short window repeat its first word.
        places = np.arange(width)[None, :]
        places = np.where(places < windows["lengths"][:, None], places, 0)
        grid = windows["words"][windows["starts"][:, None] + places]
        alive = np.flatnonzero((counts[grid] > 0).all(axis=1))
        if not len(alive):
            return
        rare = np.argsort(counts[grid[alive]], axis=1, kind="stable")
        grid, places = np.take_along_axis(grid[alive], rare, 1), np.take_along_axis(places[alive], rare, 1)
        per = counts[grid[:, 0]] * (2 * slop + 1)
        step = (np.cumsum(per) - per) // STEP
        for cut in np.split(np.arange(len(alive)), np.flatnonzero(np.diff(step)) + 1):
            which = np.repeat(cut, counts[grid[cut, 0]])
            found = postings[_spread(offsets[grid[cut, 0]], counts[grid[cut, 0]])]
            doc = np.searchsorted(self.starts, found, side="right") - 1
            start = found - places[which, 0]
            if slop:
                which, doc = np.repeat(which, 2 * slop + 1), np.repeat(doc, 2 * slop + 1)
                start = (start[:, None] + np.arange(-slop, slop + 1)).ravel()
            low, high = self.starts[doc].astype(np.int64), self.starts[doc + 1].astype(np.int64)
            keep = (start >= low) & (start + windows["lengths"][alive[which]] <= high)
            which, start, doc, low, high = which[keep], start[keep], doc[keep], low[keep], high[keep]
            for r in range(1, width):
                if not len(which):
                    break
                term, place = grid[which, r] << 32, start + places[which, r]
                spot = np.searchsorted(keys, term | np.maximum(place - slop, low))
                ok = keys[np.minimum(spot, len(keys) - 1)] <= (term | np.minimum(place + slop, high - 1))
                ok &= spot < len(keys)
                which, start, doc, low, high = which[ok], start[ok], doc[ok], low[ok], high[ok]
            if len(which):
                yield alive[which], start, doc


_HITS = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items array<bigint>"


def _hits(names: list[str], width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                segment = Segment(batch, row)
                documents, size = len(segment.ids), int(segment.starts[-1])
                change = np.zeros(size + 1, np.int64)
                pairs = [np.zeros((0, 3), np.int64)]
                for name in names:
                    windows = load_arrays(name)
                    for which, start, doc in segment.search(windows, width):
                        np.add.at(change, start, 1)
                        np.add.at(change, start + windows["lengths"][which], -1)
                        item = windows["owner"][which]
                        pairs.append(np.unique(np.stack([doc, windows["named"][item], windows["ids"][item]], axis=1), axis=0))
                hit = np.zeros(size + 1, np.int64)
                np.cumsum(np.cumsum(change[:-1]) > 0, out=hit[1:])
                pairs = np.unique(np.concatenate(pairs), axis=0)
                named = pairs[pairs[:, 1] == 1]
                ends = np.searchsorted(named[:, 0], np.arange(documents + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        segment.ids,
                        pa.array(np.diff(segment.starts).astype(np.int64)),
                        pa.array(np.diff(hit[segment.starts])),
                        pa.array(np.bincount(pairs[:, 0], minlength=documents)),
                        pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(named[:, 2])),
                    ],
                    ["doc_id", "n_words", "n_hit", "n_items", "items"],
                )

    return run


def _shipped(items: DataFrame, window: int) -> list[str]:
    return [shared_arrays(items.sparkSession, "windows", **_window_arrays(rows, window)) for rows in query_chunks(items, CHUNK_CHARS)]


def contamination(index: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: its words, those inside any occurrence of a window, and the items whose windows occur."""
    return index.mapInArrow(_hits(_shipped(items, window), window), _HITS)


_MATCHES = "doc_id bigint, item_id bigint, item_word bigint, position bigint"


def matches(index: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0) -> DataFrame:
    """Every match of a window: document, item, first word of the window in the item, and of the match in the document.

    With a slop, the first start of each window in a document is given. Positions count words from 0.
    """
    names = _shipped(items, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                segment = Segment(batch, row)
                for name in names:
                    windows = load_arrays(name)
                    for which, start, doc in segment.search(windows, window, slop):
                        if slop:
                            order = np.lexsort((start, which, doc))
                            new = np.diff(doc[order], prepend=-1).astype(bool) | np.diff(which[order], prepend=-1).astype(bool)
                            which, start, doc = which[order][new], start[order][new], doc[order][new]
                        item = windows["owner"][which]
                        yield pa.RecordBatch.from_arrays(
                            [
                                segment.ids.take(pa.array(doc)),
                                pa.array(windows["ids"][item], mask=~windows["named"][item]),
                                pa.array(windows["within"][which]),
                                pa.array(start - segment.starts[doc]),
                            ],
                            ["doc_id", "item_id", "item_word", "position"],
                        )

    return index.mapInArrow(run, _MATCHES)


def digest_columns(found: DataFrame) -> DataFrame:
    """Items as one digest, and whether a document holds any."""
    texts = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", texts).cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
