"""Byte-level BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The pieces that the vocabulary itself holds (the commonest of what the pre-tokenizer cut its training texts into) are
compiled into an automaton that shares beginnings and endings. Every transition carries how many pieces come before it, so the sum along a piece's path is
its number, and that number points to the piece's ids. The automaton is written once into the shared folder as flat
arrays, shipped to every executor by Spark and memory-mapped by its workers; all distinct pieces of a batch walk
it at once, one byte per numpy step. Pieces outside it are merged exactly, by the rank of their byte pairs.

A batch is cut into pieces, the distinct pieces are encoded, and ids are gathered for all texts together.

The vocabulary is a tokenizer file; its path is a parameter. Special tokens found in a text are taken as such.

Defined results: NULL is an empty text, with no ids and an empty decoding; repeated rows are separate rows; rows with a NULL
doc_id are encoded like others; an empty table gives an empty result; only doc_id and text are read, so further columns cannot
clash. Ids outside the vocabulary are refused when decoding.
"""

from __future__ import annotations

import hashlib
import heapq
import io
import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from cytoquill.llm.tables import columns, shared_file

#: Pieces in the lexicon, at most.
LEXICON = 50_000
#: Pieces of at most so many bytes are merged by plain search.
SHORT = 24
_NEVER = (1 << 62, -1)
#: Bytes of text that are encoded together.
TOGETHER = 1 << 21
# Fixed value: the published pre-tokenizer pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary file: itself if printable, else one from
    256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Vocabulary:
    """Ids and merge ranks of a byte-level BPE file, by bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        byte_of = {letter: b for b, letter in byte_letters().items()}
        raw = lambda token: bytes(byte_of[c] for c in token)
        self.ids = {raw(token): i for token, i in data["model"]["vocab"].items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        self.ranks = {(self.ids[raw(a)], self.ids[raw(b)]): (rank, self.ids[raw(a + b)]) for rank, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        size = 1 + max([*self.ids.values(), *self.special.values()])
        self.bytes: list[bytes] = [b""] * size
        for token, i in self.ids.items():
            self.bytes[i] = token
        for text, i in self.special.items():
            self.bytes[i] = text.encode()
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a piece: the pair of lowest rank, leftmost first, is merged until none is left.

        Pairs of a long piece wait in a heap and its parts are linked in a list, so it takes n log n steps.
        """
        parts = [self.byte_ids[b] for b in piece]
        n = len(parts)
        if n <= SHORT:
            found = [self.ranks.get(pair, _NEVER) for pair in zip(parts, parts[1:], strict=False)]
            while found:
                best = min(found)
                if best is _NEVER:
                    break
                i = found.index(best)
                parts[i : i + 2] = [best[1]]
                del found[i]
                if i:
                    found[i - 1] = self.ranks.get((parts[i - 1], parts[i]), _NEVER)
                if i < len(found):
                    found[i] = self.ranks.get((parts[i], parts[i + 1]), _NEVER)
            return parts
        after, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []
        for i in range(n - 1):
            if (found := self.ranks.get((parts[i], parts[i + 1]))) is not None:
                heap.append((found[0], i, parts[i], parts[i + 1], found[1]))
        heapq.heapify(heap)
        while heap:
            _, i, left, right, new = heapq.heappop(heap)
            j = after[i] if parts[i] == left else n
            if j >= n or parts[j] != right:
                continue
            parts[i], parts[j], after[i] = new, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (found := self.ranks.get((parts[a], parts[b]))) is not None:
                    heapq.heappush(heap, (found[0], a, parts[a], parts[b], found[1]))
        return [p for p in parts if p >= 0]


def compile_lexicon(entries: dict[bytes, Sequence[int]]) -> bytes:
    """A minimal acyclic automaton over byte strings with a number on every transition, and the ids by number.

    Strings are added in order; as soon as a branch cannot grow any more, its states are replaced by equal ones met before
    (same finality and same transitions), which leaves the smallest automaton.
    """
    words = sorted(w for w in entries if w)
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def freeze(final: bool, edges: list[tuple[int, int]]) -> int:
        key = (final, tuple(edges))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    path: list[list] = [[False, []]]  # finality and frozen transitions of each state of the open branch
    last = b""
    for word in words:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        for at in range(len(last), common, -1):
            final, edges = path.pop()
            path[-1][1].append((last[at - 1], freeze(final, edges)))
        path += [[False, []] for _ in word[common:]]
        path[-1][0] = True
        last = word
    for at in range(len(last), 0, -1):
        final, edges = path.pop()
        path[-1][1].append((last[at - 1], freeze(final, edges)))
    root = freeze(*path[0])
    count = np.zeros(len(states), np.int64)
    source, byte, target, skip = [], [], [], []
    for s, (final, edges) in enumerate(states):  # targets are frozen before their sources
        total = int(final)
        for b, t in edges:
            source.append(s)
            byte.append(b)
            target.append(t)
            skip.append(total)
            total += count[t]
        count[s] = total
    # Transitions sit in one table, row by row; a row starts at its state's offset and is sorted by byte.
    keys = np.array(source, np.int64) * 256 + np.array(byte, np.int64)
    lengths = [len(entries[w]) for w in words]
    arrays = {
        "keys": keys,
        "target": np.array(target, np.int64),
        "skip": np.array(skip, np.int64),
        "final": np.array([f for f, _ in states], np.int64),
        "starts": np.concatenate(([0], np.cumsum(lengths, dtype=np.int64))).astype(np.int64),
        "ids": np.array([i for w in words for i in entries[w]], np.int64),
        "root": np.array([root], np.int64),
    }
    head = json.dumps({k: len(v) for k, v in arrays.items()}).encode().ljust(1024)
    out = io.BytesIO()
    out.write(head)
    for v in arrays.values():
        out.write(v.tobytes())
    return out.getvalue()


class Lexicon:
    """A compiled lexicon, memory-mapped."""

    def __init__(self, path: str):
        mapped = np.memmap(path, np.uint8, "r")
        at = 1024
        for name, size in json.loads(mapped[:1024].tobytes()).items():
            setattr(self, name, mapped[at : at + 8 * size].view(np.int64))
            at += 8 * size

    def numbers(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The number of every piece (a stretch of `data`), -1 if it is not in the lexicon."""
        number = np.zeros(len(starts), np.int64)
        state = np.full(len(starts), self.root[0], np.int64)
        alive = np.arange(len(starts)) if len(self.keys) else np.zeros(0, np.int64)
        number[lengths == 0] = -1
        if not len(self.keys):
            number[:] = -1
        step = 0
        while len(alive):
            ended = lengths[alive] == step
            out = alive[ended]
            number[out] = np.where(self.final[state[out]] == 1, number[out], -1)
            alive = alive[~ended]
            wanted = state[alive] * 256 + data[starts[alive] + step]
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            there = self.keys[at] == wanted
            number[alive[~there]] = -1
            alive, at = alive[there], at[there]
            number[alive] += self.skip[at]
            state[alive] = self.target[at]
            step += 1
        return number


class Encoder:
    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.pieces = regex.compile(PATTERN).findall
        special = "|".join(regex.escape(t) for t in sorted(vocabulary.special, key=len, reverse=True))
        self.split = regex.compile(f"({special})").split if special else None
        self.tokens = np.array(vocabulary.bytes, object)
        self.merged: dict[bytes, list[int]] = {}

    def cut(self, text: str) -> list[str]:
        """The pieces of a text; a special token is a piece of its own, marked by a leading NUL pair that no piece of letters has."""
        if self.split is None or not any(t in text for t in self.vocabulary.special):
            return self.pieces(text)
        out = []
        for i, part in enumerate(self.split(text)):
            out += [f"\0\0{part}"] if i % 2 else self.pieces(part)
        return out

    def piece_ids(self, pieces: pa.Array) -> list[np.ndarray | list[int]]:
        """Ids of distinct pieces: by the lexicon, else merged."""
        raw = pieces.cast(pa.large_binary())
        bounds = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
        data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
        number = self.lexicon.numbers(data, bounds[:-1], np.diff(bounds))
        starts, ids = self.lexicon.starts, self.lexicon.ids
        out: list = [None] * len(raw)
        for i, n in enumerate(number.tolist()):
            if n >= 0:
                out[i] = ids[starts[n] : starts[n + 1]]
            else:
                piece = data[bounds[i] : bounds[i + 1]].tobytes()
                if piece.startswith(b"\0\0") and (special := self.vocabulary.special.get(piece[2:].decode("utf-8", "replace"))) is not None:
                    out[i] = [special]
                    continue
                found = self.merged.get(piece)
                if found is None:
                    found = self.vocabulary.merge(piece)
                    if len(self.merged) < 200_000 and len(piece) < 100:
                        self.merged[piece] = found
                out[i] = found
        return out

    def encode(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """Ids of every text."""
        cut = [self.cut(t) if t else [] for t in texts]
        counts = np.array([len(c) for c in cut], np.int64)
        flat = pa.array([p for c in cut for p in c], pa.large_string()).dictionary_encode()
        if not len(flat):
            return [np.zeros(0, np.uint32) for _ in texts]
        by_piece = self.piece_ids(flat.dictionary)
        lengths = np.array([len(p) for p in by_piece], np.int64)
        table = np.concatenate([np.asarray(p, np.int64) for p in by_piece]).astype(np.uint32)
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        which = flat.indices.to_numpy(zero_copy_only=False)
        size = lengths[which]
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) - np.repeat(ends - size, size) + np.repeat(offsets[which], size)
        per_text = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]
        return np.split(table[at], per_text[1:-1])

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special tokens included; bytes that are not UTF-8 become replacement characters."""
        if len(ids) and int(ids.max()) >= len(self.tokens):
            raise ValueError("an id is outside the vocabulary")
        return b"".join(self.tokens[ids].tolist()).decode("utf-8", "replace")


def frequent_pieces(vocabulary: Vocabulary, limit: int = LEXICON) -> list[bytes]:
    """The first `limit` tokens of the vocabulary in order of their ids, which is the order they were learned in.

    No text is looked at, so the lexicon is the same for every input. The ids of a text do not depend on it: a piece
    outside is merged by the rules.
    """
    return [token for token, _ in sorted(vocabulary.ids.items(), key=lambda x: x[1])[:limit]]


def build_lexicon(spark: SparkSession, path: str, limit: int = LEXICON) -> str:
    """Compile the frequent pieces into the shared folder; returns the file's name for SparkFiles."""
    vocabulary = Vocabulary(path)
    return shared_file(spark, compile_lexicon({p: vocabulary.merge(p) for p in frequent_pieces(vocabulary, limit)}), "bpe-lexicon")


_encoders: dict[str, Encoder] = {}


def _encoder(vocabulary: Vocabulary, name: str) -> Encoder:
    """One encoder per worker process."""
    if name not in _encoders:
        _encoders.clear()
        _encoders[name] = Encoder(vocabulary, Lexicon(SparkFiles.get(name)))
    return _encoders[name]


def encode(docs: DataFrame, path: str, limit: int = LEXICON, with_ids: bool = False) -> DataFrame:
    """One row per row of `docs`: doc_id, n_tokens, ids_sha256, decoded_sha256, and the ids if wanted."""
    spark = docs.sparkSession
    name = build_lexicon(spark, path, limit)
    vocabulary = spark.sparkContext.broadcast(Vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary.value, name)
        for batch in batches:
            doc_ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            first, size = 0, 0
            for i, text in enumerate(texts):
                size += len(text or "")
                if size < TOGETHER and i + 1 < len(texts):
                    continue
                ids = encoder.encode(texts[first : i + 1])
                held = {
                    "doc_id": doc_ids.slice(first, i + 1 - first),
                    "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                    "ids_sha256": [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids],
                    "decoded_sha256": [hashlib.sha256(encoder.decode(x).encode()).hexdigest() for x in ids],
                }
                if with_ids:
                    offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                    held["ids"] = pa.ListArray.from_arrays(offsets, np.concatenate(ids).astype(np.int32))
                yield pa.RecordBatch.from_pydict(held)
                first, size = i + 1, 0

    kind = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return columns(docs, doc_id="bigint", text="string").mapInArrow(run, kind)
