"""Toxicity by a learned lexicon, misspellings by Levenshtein automata, and context windows.

The lexicon is learned from labelled rows: words and word stems that occur far more in toxic rows
than chance allows. Its trie is intersected with Levenshtein automata of distance 1 into one
automaton that is made deterministic as words ask for it, so a word costs its letters. Around each
hit a window tells quotation (quote marks, words of reporting) from abuse; a logistic regression on
the strength, number and density of a text's hits gives the score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace
from heapq import nsmallest
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwing.llm.bpe import portions
from lapwing.llm.common import sample_by_hash, stored

#: Labelled rows that the lexicon is learned from at most, and lengths of a stem.
SAMPLE, STEM = 10_000, (3, 9)
#: Shortest entry that also matches misspelled, words in a window on each side, and words remembered.
FUZZY, WINDOW, MEMO = 5, 6, 150_000
#: Chance of a false entry that learning allows for.
LEVEL = 0.02
#: Marks and words of quotation.
QUOTES = "\"“”„«»‹›‘’"
REPORTS = frozenset("quote quoted quotes said says called calls word words term terms wrote zitat zitiert sagte wort terme mot dit citation dijo palabra cita".split())
#: Numbers that describe the hits of a text.
FEATURES = 5
WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Entry:
    """A word or, if `stem`, the begin of words, with what an exact and a misspelled hit weigh (log lift)."""

    text: str
    stem: bool
    exact: float
    fuzzy: float


@dataclass
class Lexicon:
    entries: list[Entry] = field(default_factory=list)
    spared: set[str] = field(default_factory=set)  # clean words that look like misspelled entries
    weights: list[float] = field(default_factory=lambda: [-2.0, *[0.0] * FEATURES])  # bias first

    def pack(self) -> dict:
        return {"entries": [asdict(e) for e in self.entries], "spared": sorted(self.spared), "weights": self.weights}

    @staticmethod
    def unpack(d: dict) -> Lexicon:
        return Lexicon([Entry(**e) for e in d["entries"]], set(d["spared"]), d["weights"])


class Automaton:
    """Trie of the entries with up to one edit; its deterministic states come up as they are needed."""

    def __init__(self, entries: list[Entry]) -> None:
        self.entries = entries
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.fuzzy = [False]  # does the node lead to an entry that may be misspelled?
        for k, e in enumerate(entries):
            node = 0
            for c in e.text:
                nxt = self.children[node].get(c)
                if nxt is None:
                    nxt = self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.fuzzy.append(False)
                node = nxt
                self.fuzzy[node] |= len(e.text) >= FUZZY
            self.ends[node].append(k)
        self.fuzzy[0] = any(len(e.text) >= FUZZY for e in entries)
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.start = self._state({(0, 0)})

    def _state(self, pairs: set[tuple[int, int]]) -> int:
        for node, edits in list(pairs):  # a letter of the entry left out
            if edits == 0:
                pairs |= {(c, 1) for c in self.children[node].values() if self.fuzzy[c]}
        key = frozenset(pairs)
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
        return self.ids[key]

    def _move(self, state: int, c: str) -> int:
        out = set()
        for node, edits in self.sets[state]:
            if c in self.children[node]:
                out.add((self.children[node][c], edits))
            if edits == 0 and self.fuzzy[node]:
                out.add((node, 1))  # a letter too many
                out |= {(n, 1) for x, n in self.children[node].items() if x != c and self.fuzzy[n]}  # another letter
        to = self.moves[state][c] = self._state(out) if out else -1
        return to

    def match(self, word: str) -> dict[int, int]:
        """Entries that the word (or, for stems, its begin) spells, with the edits (0 or 1) it takes."""
        found: dict[int, int] = {}
        state = self.start
        last = len(word) - 1
        for k, c in enumerate(word):
            to = self.moves[state].get(c)
            state = self._move(state, c) if to is None else to
            if state < 0:
                return found
            for node, edits in self.sets[state]:
                for e in self.ends[node]:
                    if (k == last or self.entries[e].stem) and (edits == 0 or len(self.entries[e].text) >= FUZZY) and edits < found.get(e, 2):
                        found[e] = edits
        return found


def _features(words: set[str]) -> set[str]:
    """The words' stems; a word stands for itself as its longest."""
    return {w[:k] for w in words for k in range(STEM[0], min(STEM[1], len(w)) + 1)} | {w for w in words if len(w) > STEM[1]}


def _tail(n: int, k: int, p: float) -> float:
    """Log of a bound on the chance of k or more of n at probability p."""
    q = k / n
    return 0.0 if q <= p else -n * (q * math.log(q / p) + ((1 - q) * math.log((1 - q) / (1 - p)) if q < 1 else 0))


def learn(rows: Iterator[tuple[str, int]]) -> Lexicon:
    """Lexicon of (text, toxic) rows; toxic rows come first."""
    toxic: list[set[str]] = []
    clean_words: Counter[str] = Counter()
    hits, misses, n = Counter(), Counter(), [0, 0]
    seen: set[tuple] = set()
    for text, label in rows:
        words = set(WORD.findall((text or "").lower()))
        if len(words) >= 10:  # near copies of a row tell nothing new: two of three retained hashes tell them
            low = nsmallest(3, (zlib.crc32(w.encode()) for w in words))
            marks = {*combinations(low, 2)}
            if marks & seen:
                continue
            seen |= marks
        n[label] += 1
        if label:
            toxic.append(words)
            hits.update(_features(words))
        else:
            clean_words.update(words)
            misses.update(f for f in _features(words) if f in hits)
    if not n[1] or not n[0]:
        return Lexicon()
    p = n[1] / sum(n)
    sizes = Counter(hits[f] + misses[f] for f in hits)
    upto, tested = 0, {}
    for size in sorted(sizes, reverse=True):
        upto += sizes[size]
        tested[size] = upto
    chance = {f: _tail(k + misses[f], k, p) for f, k in hits.items() if k >= 3 and misses[f] <= 1.5 * k}
    good = [f for f, c in chance.items() if c + math.log(tested[hits[f] + misses[f]]) < math.log(LEVEL)]
    forms = set().union(*toxic)
    chosen: list[Entry] = []
    covered: set[str] = set()  # chosen ones and all that they begin with
    for f in sorted(good, key=lambda f: (chance[f], -len(f), f)):  # of a stem and what continues it the surest, then the longest
        begins = {f[:k] for k in range(STEM[0], len(f) + 1)}
        if f in covered or any(e.text in begins for e in chosen):
            continue
        covered |= begins
        lift = math.log((hits[f] + 0.5) / (misses[f] + 0.5) * (n[0] + 1) / (n[1] + 1))
        chosen.append(Entry(f, any(w != f and w.startswith(f) for w in forms), lift, 0.0))
    probe = Automaton(chosen)
    looks = {w: m for w in clean_words if (m := [e for e, d in probe.match(w).items() if d])}
    half = Counter(e for w, found in looks.items() if clean_words[w] == 1 for e in found)  # rare clean words that look misspelled: there are more unseen
    return Lexicon([replace(e, fuzzy=0.8 * e.exact / (1 + 0.25 * half[k])) for k, e in enumerate(chosen)], set(looks))


class Scorer:
    """Scores texts; remembers what pieces between white space are."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon, self.automaton = lexicon, Automaton(lexicon.entries)
        self.clean: set[str] = set()
        self.hot: dict[str, tuple[float, str]] = {}

    def _hit(self, piece: str) -> tuple[float, str] | None:
        """Weight and spelling of the best hit among the piece's words, and the piece as one word."""
        best = None
        words = WORD.findall(piece)
        core = piece.strip("".join(c for c in set(piece) if not c.isalnum())) if len(words) > 1 or not piece.isalpha() else piece
        for w in {*words, core}:
            for e, edits in self.automaton.match(w).items():
                entry = self.lexicon.entries[e]
                weight = entry.exact if edits == 0 else 0.0 if w in self.lexicon.spared else entry.fuzzy
                if weight > 0 and (best is None or weight > best[0]):
                    best = weight, entry.text
        return best

    def features(self, text: str) -> tuple[list[float], list[str], int]:
        """What describes the hits, terms found, and hits that are quotations."""
        pieces = text.lower().split()
        distinct = set(pieces)
        if len(self.clean) + len(self.hot) + len(distinct) > MEMO:
            self.clean.clear()
            self.hot.clear()
        for p in distinct - self.clean:
            if p not in self.hot:
                hit = self._hit(p)
                if hit:
                    self.hot[p] = hit
                else:
                    self.clean.add(p)
        found = distinct & self.hot.keys()
        strength, quoted, terms = 0.0, 0, set()
        at = [k for k, p in enumerate(pieces) if p in found] if found else []
        near = {k for x, y in pairwise(at) if y - x <= WINDOW for k in (x, y)}
        for k in at:
            weight, term = self.hot[pieces[k]]
            if k not in near and self._is_quoted(pieces, k):
                weight *= 0.2
                quoted += 1
            terms.add(term)
            strength += weight
        n = len(pieces)
        return [min(strength, 60) / 10, math.log1p(strength), 10 * strength / (n + 30), math.log1p(n), min(len(terms), 10) / 5], sorted(terms), quoted

    @staticmethod
    def _is_quoted(pieces: list[str], k: int) -> bool:
        """Quote marks on both sides within the window, and a word of reporting before or after."""
        before, after = pieces[max(0, k - WINDOW) : k + 1], pieces[k : k + 1 + WINDOW]
        marked = any(c in QUOTES for p in before for c in p[:1]) and any(c in QUOTES for p in after for c in p.rstrip(".,;:!?")[-1:])
        return marked and any(p.strip(".,;:!?" + QUOTES) in REPORTS for p in before + after)


def held_out(doc_id) -> F.Column:
    """Rows that labels are never learned from: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> list[float]:
    """Weights, bias first, of a ridge logistic regression by Newton's method."""
    x = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + ridge * len(y) * np.eye(len(w)), x.T @ (y - q) - ridge * len(y) * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Lexicon:
    """Lexicon from at most `sample` labelled rows that aren't held out, chosen by a hash of the id.

    Null labels and ids are left out; with no labelled rows of both kinds the lexicon is empty.
    """
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    known = sample_by_hash(stored(known.where(F.col("id").isNotNull() & ~held_out(F.col("id"))), "labels"), F.col("id"), sample)
    rows = stored(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id").select("text", "label"), "labelled")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = learn((t.as_py(), y.as_py()) for b in batches for t, y in zip(b.column("text"), b.column("label"), strict=True)).pack()
        yield pa.RecordBatch.from_pylist([{"entries": got["entries"], "spared": got["spared"]}], schema=pa.schema([("entries", pa.list_(pa.struct([("text", pa.string()), ("stem", pa.bool_()), ("exact", pa.float64()), ("fuzzy", pa.float64())]))), ("spared", pa.list_(pa.string()))]))

    # the sample is bounded, so one task learns from it; toxic rows first
    one = rows.repartition(1).sortWithinPartitions(F.desc("label"))
    got = one.mapInArrow(run, "entries array<struct<text string, stem boolean, exact double, fuzzy double>>, spared array<string>").first()
    if not got or not got["entries"]:
        return Lexicon()
    lexicon = Lexicon.unpack(got.asDict(True) | {"weights": Lexicon().weights})
    described = features(rows, lexicon, "label", "text").select("label", "features").collect()  # bounded by the sample
    lexicon.weights = logistic(np.array([r["features"] for r in described]), np.array([r["label"] for r in described], float))
    return lexicon


def features(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, features array<double>, terms array<string>, n_quoted long) of every whole text."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    packed = lexicon.pack()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Lexicon.unpack(packed))
        for batch in batches:
            for part, texts in portions(batch, "text"):
                got = [scorer.features(t) for t in texts]
                arrays = [pa.array([g[k] for g in got], kind) for k, kind in enumerate((pa.list_(pa.float64()), pa.list_(pa.string()), pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column("id"), *arrays], ["id", "features", "terms", "n_quoted"])

    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, features array<double>, terms array<string>, n_quoted long")
    return out.select(F.col("id").alias(id_col), "features", "terms", "n_quoted")


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score double, terms array, n_quoted long) of every whole text.

    Null and empty texts have no hits and score as such. Ids may be null or repeat; each row gives a
    row. Other columns are left out.
    """
    bias, *weights = lexicon.weights
    z = sum((F.get("features", F.lit(k)) * w for k, w in enumerate(weights)), F.lit(bias))
    return features(docs, lexicon, id_col, text_col).select(id_col, (1 / (1 + F.exp(-z))).alias("score"), "terms", "n_quoted")


def keep_clean(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of `docs` that score below `limit`, with all their columns; no shuffle."""
    packed, weights = lexicon.pack(), np.array(lexicon.weights)
    z = math.log(limit / (1 - limit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Lexicon.unpack(packed))
        for batch in batches:
            for part, texts in portions(batch, text_col):
                yield part.filter(pa.array([weights[0] + weights[1:] @ np.array(scorer.features(t)[0]) < z for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
