"""Toxicity: a lexicon learned from labels, matched through Levenshtein automata, scored with the context of each hit.

The lexicon holds words and word beginnings that are far commoner in toxic than in clean training documents. It is
kept as a trie; a word of a text is an automaton that accepts everything within a few edits of it (its states are
bit sets of positions per number of errors), and walking both together finds all entries that the word could be a
misspelling of. Hits are counted apart by context: alone, near other hits, between quotation marks. A logistic
model over these counts, fitted on the training rows, gives the score. Digits and symbols inside a word may stand for
letters; other misspellings count by how much more often toxic training documents hold them.

Labels are read only for training; the fit takes at most SAMPLE labelled documents of each class, those with the
smallest hashes of their doc_id. Scores depend on the text alone.

Defined results: NULL, empty and wordless texts have no hits and get the score of a document without any; with no
training rows of both classes every score is 0; repeated labels of a document count once, as the larger; repeated
documents are separate rows; a NULL doc_id is not held out and never trains; an empty table gives an empty result; only doc_id
and text are read, so further columns cannot clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import erfc, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytoquill.llm.tables import columns, cut_lineage, hashed_sample

#: Labelled documents of each class that are fitted on, at most.
SAMPLE = 20_000
#: Entries of the lexicon, at most.
LEXICON = 2_000
#: An entry occurs in at least this many documents of the toxic sample, however large that is, ...
LEAST_DOCUMENTS = 3
#: ... its share there is at least this many times that in the clean sample, ...
LEAST_LIFT = 10.0
#: ... and at most this share of all entries would pass by chance.
FALSE_SHARE = 0.05
#: A longer term that this share of a beginning's documents hold stands in for it.
SAME_TERM = 0.9
#: Entries that each toxic document of the sample should hold, where it can.
COVER = 4
#: A misspelling worth less of a hit than this is none.
LEAST_TRUST = 0.1
#: Lengths of word beginnings that may become entries.
STEMS = range(4, 8)
#: Words on either side that make the context of a hit.
WINDOW = 6
THRESHOLD = 0.7
#: Characters of tokens that hit, up to which they are shipped to all workers at once; beyond, every worker looks tokens up itself.
SHIPPED = 4_000_000
#: Texts that are taken apart together in a worker.
TEXTS = 256
#: Longer tokens are not remembered by a worker.
LONG_TOKEN = 1_000
_LETTERS = re.compile(r"[^\W\d_]+")
#: Punctuation between words that are written without a space.
_STOPS = re.compile(r"""[\s.,;:?/\\()\[\]{}<>"“”„«»‹›…=&-]+""")
_QUOTES = "\"“”„«»‹›"


def edits_allowed(entry: str, stem: bool) -> int:
    """Entries under 4 letters must be spelled right, longer ones may have one or two wrong letters."""
    return 0 if len(entry) < 4 else 1 if len(entry) < 9 else 2


def trust(toxic: np.ndarray, clean: np.ndarray, toxic_rows: int, clean_rows: int) -> np.ndarray:
    """How much of a hit a slip in each entry is, from 0 to 1, by the shares of documents that hold one in both classes.

    Without any seen, a slip is worth most of a hit; as common in clean documents as in toxic ones, nothing.
    """
    a, b = (toxic + 1) / (toxic_rows + 1), (clean + 0.25) / (clean_rows + 1)
    rows = max(toxic_rows, clean_rows) + 1
    a = np.where(toxic + clean == 0, 1 / rows, a)
    b = np.where(toxic + clean == 0, 0.25 / rows, b)
    return np.clip(2 * a / (a + b) - 1, 0.0, 1.0)


def _shorter(word: str) -> list[str]:
    """A word, and what one letter less leaves of it."""
    return [word, *(word[:i] + word[i + 1 :] for i in range(len(word)))]


class Lexicon:
    """A trie of entries and the search for those near a word."""

    def __init__(self, entries: list[tuple[str, bool, float]]):
        self.entries = entries
        self.root: dict = {}
        self.exact: dict[str, int] = {}
        self.stems: dict[str, int] = {}
        self.known: dict[str, tuple[int, bool] | None] = {}
        self.veiled: set[str] = set()
        #: Whether `known` holds all hits of a table's tokens, so that any other token of it hits nothing.
        self.complete = False
        # Tests that every word within d edits of an entry passes: one of d + 1 parts of the entry stands unchanged, at
        # most d places off; with one edit, both have a letter less in common.
        self.less: set[str] = set()
        self.less_stems: set[str] = set()
        ends: dict[int, set[str]] = {}
        spots: tuple[dict, dict] = ({}, {})
        for i, (text, stem, _) in enumerate(entries):
            d, node = edits_allowed(text, stem), self.root
            for letter in text:
                node["edits"] = max(node.get("edits", 0), d)
                node = node.setdefault(letter, {})
            node["edits"] = max(node.get("edits", 0), d)
            node.setdefault("", []).append(i)
            (self.stems if stem else self.exact)[text] = i
            if d == 1:
                (self.less_stems if stem else self.less).update(_shorter(text))
            cuts = [len(text) * j // (d + 1) for j in range(d + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False) if d else ():
                if a == 0:
                    spots[d - 1].setdefault((0, b), set()).add(text[:b])
                elif d == 1 and not stem:
                    ends.setdefault(b - a, set()).add(text[a:])
                # An edit before the part may move it, one behind it does not.
                for j in range(max(0, a - d), a + d + 1) if a and (stem or d == 2) else range(1, d + 1) if d == 2 else ():
                    spots[d - 1].setdefault((j, b - a), set()).add(text[a:b])
        self.spots = [[(j, j + k, held) for (j, k), held in sorted(at.items())] for at in spots]
        self.ends = sorted(ends.items())
        self.stem_lengths = sorted({len(s) for s in self.stems})
        lengths = [len(t) for t, stem, _ in entries if stem and edits_allowed(t, stem) == 1]
        self.near_lengths = sorted({n + k for n in lengths for k in (-1, 0, 1)})
        self.longest = max((len(t) for t, _, _ in entries), default=0)
        none = np.zeros(len(entries))
        self.trust = trust(none, none, 0, 0)

    def match(self, token: str, misspelled: bool = True) -> tuple[int, bool] | None:
        """The entry that a token of a text hits, and whether it is spelled as such.

        A lexicon is asked either for all hits or for those spelled right, never for both.
        """
        try:
            return self.known[token]
        except KeyError:
            pass
        found, veiled = self.look_up(token, misspelled)
        if self.complete:
            return found
        if len(self.known) > 500_000:
            self.known.clear()
        if veiled:
            self.veiled.add(token)
        if len(token) <= LONG_TOKEN:
            self.known[token] = found
        return found

    def look_up(self, token: str, misspelled: bool = True) -> tuple[tuple[int, bool] | None, bool]:
        """What a token hits, and whether only digits and symbols between its letters differ from an entry's."""
        found, veiled = None, False
        lowered = token.lower()
        words = _LETTERS.findall(lowered)
        for word in words:
            hit = self._word(word, misspelled)
            if hit is not None and (found is None or (hit[1], self.entries[hit[0]][2]) > (found[1], self.entries[found[0]][2])):
                found = hit
        if misspelled and len(words) > 1 and not (found and found[1]):
            # Digits and symbols between letters may stand for letters.
            near = {i: w for w in _veiled_words(lowered) if self._may_be_near(w) for i in self.near(w)}
            if near:
                best = max(near, key=lambda i: (_STOPS.search(near[i]) is None, self.entries[i][2], -i))
                found = best, False
                veiled = _STOPS.search(near[best]) is None
        return found, veiled

    def _word(self, word: str, misspelled: bool = True) -> tuple[int, bool] | None:
        if word in self.exact:
            return self.exact[word], True
        for n in self.stem_lengths:
            if word[:n] in self.stems and len(word) >= n:
                return self.stems[word[:n]], True
        if not misspelled or not self._may_be_near(word):
            return None
        near = self.near(word)
        return (max(near, key=lambda i: (self.entries[i][2], -i)), False) if near else None

    def _may_be_near(self, word: str) -> bool:
        """False only if no entry is near; costs no walk."""
        for a, b, held in self.spots[1]:
            if word[a:b] in held:
                return True
        for a, b, held in self.spots[0]:
            if word[a:b] in held:
                break
        else:
            for k, held in self.ends:
                if word[-k:] in held:
                    break
            else:
                return False
        n = len(word)
        if n <= self.longest + 1 and not self.less.isdisjoint(_shorter(word)):
            return True
        return any(k <= n and not self.less_stems.isdisjoint(_shorter(word[:k])) for k in self.near_lengths)

    def near(self, word: str, most: int = 2) -> list[int]:
        """Entries within their allowed edits of the word (stems: of a beginning of it).

        Bit i of a state's k-th number says that the trie path can spell the first i letters of the word with k
        errors.
        """
        # What is longer than any entry and its edits can only hold a beginning.
        word = word[: self.longest + most + 1]
        n = len(word)
        places: dict[str, int] = {}
        for i, letter in enumerate(word):
            places[letter] = places.get(letter, 0) | 1 << i + 1
        full, last = (1 << n + 1) - 1, 1 << n
        start = [(1 << k + 1) - 1 & full for k in range(most + 1)]
        out, stack = [], [(self.root, start)]
        while stack:
            node, state = stack.pop()
            for letter, below in node.items():
                if letter == "edits":
                    continue
                if letter == "":
                    for i in below:
                        text, stem, _ = self.entries[i]
                        reached = state[edits_allowed(text, stem)]
                        if reached if stem else reached & last:
                            out.append(i)
                    continue
                here = places.get(letter, 0)
                new = [(state[0] << 1) & here]
                for k in range(1, most + 1):
                    # match; letter too many in the entry; wrong letter; letter missing in the entry
                    step = (state[k] << 1) & here | state[k - 1] | state[k - 1] << 1
                    new.append((step | new[k - 1] | new[k - 1] << 1) & full)
                if new[below["edits"]]:
                    stack.append((below, new))
        return out

    def candidates(self, texts: list[str], of_table: bool = False) -> Iterator[tuple[int, dict[str, tuple[int, bool]]]]:
        """(number of the text, its tokens that hit and what they hit) over texts that hold any.

        Texts of the table whose hits are all known only meet those (`of_table`); else every distinct token is looked up once
        and then remembered.
        """
        if of_table and self.complete:
            hitting = self.known.keys()
            for i, text in enumerate(texts):
                if hits := hitting & set(text.split()):
                    yield i, {t: self.known[t] for t in sorted(hits)}
            return
        for i, text in enumerate(texts):
            if len(self.veiled) > 500_000:
                self.known.clear()
                self.veiled.clear()
            hits = {t: h for t in set(text.split()) if (h := self.match(t)) is not None}
            if hits:
                yield i, hits

    def all_features(self, texts: list[str | None], of_table: bool = False) -> np.ndarray:
        out = np.zeros((len(texts), FEATURES))
        for i, hits in self.candidates([t or "" for t in texts], of_table):
            out[i] = self.features(texts[i], hits)
        return out

    def features(self, text: str, hits: dict[str, tuple[int, bool]]) -> list[float]:
        """Counts of hits by kind and context; `hits` are the tokens of the text that hit, and their entries.

        Digits and symbols (but not punctuation) between the letters of an entry are no slip, so such a token counts as
        spelled right. Other misspellings count by the trust in their entry; without any, they are no hits.
        """
        tokens = text.split()
        right = {t for t, h in hits.items() if h[1] or t in self.veiled}
        hit_tokens = {t: 1.0 if t in right else self.trust[h[0]] for t, h in hits.items()}
        hit_tokens = {t: worth for t, worth in hit_tokens.items() if worth >= LEAST_TRUST}
        if not hit_tokens:
            return [0.0] * FEATURES
        at = [i for i, t in enumerate(tokens) if t in hit_tokens]
        quoted = _inside_quotes(tokens) if any(q in text for q in _QUOTES) else ()
        exact = fuzzy = cited = close = 0
        for j, i in enumerate(at):
            if i in quoted:
                cited += 1
            elif tokens[i] in right:
                exact += 1
            else:
                fuzzy += hit_tokens[tokens[i]]
            if j and i - at[j - 1] <= WINDOW or j + 1 < len(at) and at[j + 1] - i <= WINDOW:
                close += 1
        held: dict[int, float] = {}
        for t, worth in hit_tokens.items():
            held[hits[t][0]] = max(held.get(hits[t][0], 0.0), worth)
        weight = sum(self.entries[i][2] * worth for i, worth in sorted(held.items()))
        share = len(at) / len(tokens)
        return [np.log1p(exact + fuzzy), np.log1p(fuzzy), np.log1p(cited), np.log1p(close), np.log1p(sum(held.values())), min(weight, 40.0) / 10, np.log1p(100 * share)]


FEATURES = 7


def _veiled_words(token: str) -> set[str]:
    """Stretches of a lower-case token that have digits or symbols between letters: all of it, and those without punctuation."""
    out = set()
    for part in [token, *_STOPS.split(token)]:
        ends = [m.span() for m in _LETTERS.finditer(part)]
        if len(ends) > 1:
            out.add(part[ends[0][0] : ends[-1][1]])
    return out


def _inside_quotes(tokens: list[str]) -> set[int]:
    """Places between an opening and a closing quotation mark at most 4 windows apart."""
    marks = [i for i, t in enumerate(tokens) for c in t if c in _QUOTES]
    out: set[int] = set()
    for a, b in zip(marks[::2], marks[1::2], strict=False):
        if b - a <= 4 * WINDOW:
            out.update(range(a, b + 1))
    return out


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic) of the training sample; the label ids are bounded by `sample` per class, so they are broadcast."""
    usable = columns(labels, doc_id="bigint", toxic="int").where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held_out(F.col("doc_id"), 3, 1))
    once = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    once = cut_lineage(once)
    picked = hashed_sample(once.where("toxic = 1"), sample, "doc_id").unionAll(hashed_sample(once.where("toxic = 0"), sample, "doc_id"))
    return columns(docs, doc_id="bigint", text="string").join(F.broadcast(cut_lineage(picked)), "doc_id").select("text", "toxic")


def learn_lexicon(rows: DataFrame, limit: int = LEXICON) -> Lexicon | None:
    """Document frequencies per class of all words and word beginnings; the entries are the commonest that pass."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def counted() -> pa.RecordBatch:
            terms = list(seen[0].keys() | seen[1].keys())
            return pa.RecordBatch.from_pydict({"term": terms, "clean": pa.array([seen[0][t] for t in terms], pa.int64()), "toxic": pa.array([seen[1][t] for t in terms], pa.int64())})

        for batch in batches:
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
                text = text.as_py()
                words = set(_LETTERS.findall((text or "").lower()))
                seen[toxic].update({w[:40] for w in words if len(w) >= 3} | {w[:n] + "*" for w in words for n in STEMS if len(w) >= n})
                if len(seen[0]) + len(seen[1]) > 200_000:
                    yield counted()
                    seen[0].clear()
                    seen[1].clear()
        yield counted()

    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return None
    totals = rows.mapInArrow(count, "term string, clean bigint, toxic bigint").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    lift = ((F.col("toxic") + 0.5) / (sizes[1] + 1)) / ((F.col("clean") + 0.5) / (sizes[0] + 1))
    # How much better two rates explain the counts than one does (likelihood ratio).
    both, toxic_share = F.col("toxic") + F.col("clean"), sizes[1] / (sizes[0] + sizes[1])
    ratio = F.col("toxic") * F.log(F.col("toxic") / (both * toxic_share)) + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / (both * (1 - toxic_share)))).otherwise(0)
    tried = cut_lineage(totals.where(F.col("toxic") >= LEAST_DOCUMENTS).withColumn("lift", lift).withColumn("ratio", ratio))
    best = tried.where(F.col("lift") >= LEAST_LIFT).orderBy(F.col("ratio").desc(), F.length("term"), "term").limit(limit).collect()
    best = _significant(best, tried.count())
    return _covering(rows, Lexicon(_choose(best))) if best else None


def _significant(best: list, tried: int) -> list:
    """The first of the terms, ordered by likelihood ratio, of which at most FALSE_SHARE pass by chance among all tried."""
    chance = np.array([0.5 * erfc(sqrt(max(r["ratio"], 0.0))) for r in best])
    passed = np.flatnonzero(chance <= FALSE_SHARE * np.arange(1, len(best) + 1) / max(tried, 1))
    return best[: passed[-1] + 1] if len(passed) else []


def _covering(rows: DataFrame, lexicon: Lexicon) -> Lexicon | None:
    """The entries that toxic documents need: greedily, until each holds COVER of them or further ones help fewer than LEAST_DOCUMENTS.

    Words that a group of copies happens to share add nothing once the terms that make it toxic are in. At most the
    sampled documents' lists of entries reach the driver.
    """
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield pd.DataFrame({"held": [sorted({h[0] for t in set((x or "").split()) if (h := shared.value.match(t, False)) is not None}) for x in part["text"]]})

    lists = rows.where("toxic = 1").mapInPandas(held, "held array<int>").groupBy("held").count().toPandas()
    has = np.zeros((len(lists), len(lexicon.entries)), bool)
    for i, ids in enumerate(lists["held"]):
        has[i, list(ids)] = True
    copies, need, chosen = lists["count"].to_numpy(), np.minimum(COVER, has.sum(axis=1)), []
    gain = copies @ has if len(lists) else np.zeros(len(lexicon.entries), int)
    while gain.max(initial=0) >= LEAST_DOCUMENTS:
        best = int(np.argmax(gain))
        chosen.append(best)
        here = has[:, best] & (need > 0)
        need[here] -= 1
        full = here & (need == 0)
        gain -= copies[full] @ has[full]
        gain[chosen] = 0
    return Lexicon([lexicon.entries[i] for i in sorted(chosen)]) if chosen else None


def _choose(best: list) -> list[tuple[str, bool, float]]:
    """Entries among the terms that passed: short ones first, and nothing that begins like one chosen already.

    Where nearly all documents of a beginning hold one longer beginning or word, that is the entry: it says more, and
    long entries may be misspelled.
    """
    found = {(r["term"].rstrip("*"), r["term"].endswith("*")): (r["toxic"], float(np.log(r["lift"]))) for r in best}
    entries, taken = [], set()
    for text, stem in sorted(found, key=lambda k: (len(k[0]), not k[1], k[0])):
        if any(text[:n] in taken for n in STEMS):
            continue
        if stem:
            taken.add(text)
        while stem:
            longer = [k for k in found if k[0].startswith(text) and (len(k[0]) == len(text) + 1 if k[1] else True) and k != (text, stem)]
            near = [k for k in longer if found[k][0] >= SAME_TERM * found[text, stem][0]]
            if not near:
                break
            text, stem = max(near, key=lambda k: (not k[1], found[k][0], k[0]))
        entries.append((text, stem, found[text, stem][1]))
    return entries


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 100) -> np.ndarray:
    """Weights of a ridge logistic model by Newton steps, constant first."""
    x = np.column_stack([np.ones(len(x)), x])
    w, keep = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-7:
            break
    return w


def know_tokens(docs: DataFrame, lexicon: Lexicon) -> None:
    """Look every distinct token of a table up once, and let the lexicon know those that hit.

    Tokens become distinct in the task, then over the table, and are walked where they lie. Results do not depend on
    whether the hits are few enough to be shipped.
    """
    lexicon.known, lexicon.veiled, lexicon.complete = {}, set(), False
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: set[str] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                for text in batch.column("text").slice(at, TEXTS).to_pylist():
                    held.update(text.split())
                    if len(held) > 100_000:
                        yield pa.RecordBatch.from_pydict({"token": list(held)})
                        held.clear()
        yield pa.RecordBatch.from_pydict({"token": pa.array(list(held), pa.string())})

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [(t, *found) for t in batch.column("token").to_pylist() if (found := shared.value.look_up(t))[0] is not None]
            yield pa.RecordBatch.from_pydict(
                {
                    "token": pa.array([t for t, _, _ in hits], pa.string()),
                    "entry": pa.array([h[0] for _, h, _ in hits], pa.int32()),
                    "right": pa.array([h[1] for _, h, _ in hits], pa.bool_()),
                    "veiled": pa.array([v for _, _, v in hits], pa.bool_()),
                }
            )

    tokens = columns(docs, text="string").where("text IS NOT NULL").mapInArrow(distinct, "token string")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A walk costs far more than its few bytes suggest, so partitions are not merged by size.
    once = tokens.repartition(parts, "token").dropDuplicates(["token"])
    hits = cut_lineage(once.mapInArrow(walk, "token string, entry int, right boolean, veiled boolean"))
    if (hits.agg(F.sum(F.length("token") + 1)).first()[0] or 0) <= SHIPPED:
        rows = hits.orderBy("token").collect()
        lexicon.known = {r["token"]: (r["entry"], r["right"]) for r in rows}
        lexicon.veiled = {r["token"] for r in rows if r["veiled"]}
        lexicon.complete = True


class ToxicityModel:
    def __init__(self, lexicon: Lexicon | None, weights: np.ndarray | None, known: DataFrame | None = None):
        self.lexicon, self.weights = lexicon, weights
        self.docs = known  # the table whose tokens the lexicon knows

    def __getstate__(self) -> dict:
        return {"lexicon": self.lexicon, "weights": self.weights, "docs": None}

    def over(self, docs: DataFrame) -> ToxicityModel:
        """The model, knowing the tokens of a table."""
        if self.lexicon is not None and (self.docs is None or not self.docs.sameSemantics(docs)):
            know_tokens(docs, self.lexicon)
            self.docs = docs
        return self

    def scores(self, texts: list[str | None], of_table: bool = False) -> np.ndarray:
        if self.lexicon is None or self.weights is None:
            return np.zeros(len(texts))
        x = self.lexicon.all_features(texts, of_table)
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -30, 30)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    """Learn the lexicon and the weights. The features of at most 2 x `sample` rows reach the driver."""
    rows = cut_lineage(training_rows(docs, labels, sample))
    lexicon = learn_lexicon(rows)
    if lexicon is None:
        return ToxicityModel(None, None)
    # The sample is part of the table, so its tokens are known as well.
    know_tokens(docs, lexicon)
    _learn_trust(rows, lexicon)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield pd.DataFrame({"toxic": part["toxic"], "x": list(shared.value.all_features(part["text"].tolist(), True))})

    found = rows.mapInPandas(features, "toxic int, x array<double>").groupBy("toxic", "x").count().toPandas()
    x = np.repeat(np.stack(found["x"].to_numpy()), found["count"], axis=0)
    return ToxicityModel(lexicon, fit_logistic(x, np.repeat(found["toxic"].to_numpy(float), found["count"])), docs)


def _learn_trust(rows: DataFrame, lexicon: Lexicon) -> None:
    """Count the sampled documents of each class that hold a misspelling of each entry."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)

    def slips(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            lexicon, toxic = shared.value, part["toxic"].tolist()
            counts = Counter((toxic[i], k) for i, hits in lexicon.candidates([t or "" for t in part["text"]], True) for k in {h[0] for t, h in hits.items() if not h[1] and t not in lexicon.veiled})
            yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["toxic", "entry", "n"])

    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    seen = np.zeros((2, len(lexicon.entries)))
    for r in rows.mapInPandas(slips, "toxic int, entry int, n bigint").groupBy("toxic", "entry").agg(F.sum("n").alias("n")).collect():
        seen[r["toxic"], r["entry"]] = r["n"]
    lexicon.trust = trust(seen[1], seen[0], sizes[1], sizes[0])


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model.over(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            found = np.concatenate([shared.value.scores(texts.slice(at, TEXTS).to_pylist(), True) for at in range(0, batch.num_rows, TEXTS)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("out"), pa.array(found), pa.array((found >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = columns(docs, doc_id="bigint", text="string").withColumn("out", held_out(F.col("doc_id"), 3, 1))
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """`docs` without the rows whose text is scored toxic; all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model.over(docs))

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series(np.concatenate([shared.value.scores(texts.iloc[at : at + TEXTS].tolist(), True) for at in range(0, len(texts), TEXTS)] or [np.zeros(0)]) < THRESHOLD)

    return docs.where(clean(F.col("text").cast("string")))
