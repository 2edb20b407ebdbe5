"""Quality classifier trained on weak labels.

Overlapping heuristic labellers vote on every document (good, poor or nothing). Expectation
maximisation over the counts of all vote patterns estimates how each votes on good and poor
documents, without any true label; the posterior of a pattern is the weak label of its documents.
A linear model on hashed word shapes learns from the weak labels and scores every document.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwing.llm.bpe import portions
from lapwing.llm.common import sample_by_hash, stored

#: Buckets of the hashed model, documents that it learns from at most, and pieces that a task remembers.
BUCKETS, SAMPLE, MEMO = 512, 10_000, 150_000
LABELLERS = ("symbols", "capitals", "repeats", "variety", "tables", "plain words", "plain pairs", "letters", "sentences")
SYMBOLS = frozenset("#$%&*@^~=+<>\\_{}[]")
_LETTERS, _DIGITS, _AGAIN = re.compile(r"[^\W\d_]+"), re.compile(r"\d+"), re.compile(r"(.)\1{2,}")


def shape(piece: str) -> tuple[int, int]:
    """Hash bucket of a word's shape, and flags: 1 symbols, 2 capitals, 4 no letters or digits, 8 a plain word, 16 ends a sentence."""
    core = piece.rstrip(".,;:!?#$%&*")
    if core.isalpha():  # most words: letters, then a few marks
        s, tail = "A" if core[0].isupper() else "a", piece[len(core) :]
        flags = (sum(c in SYMBOLS for c in tail[-3:]) >= 2) * 1 + (len(core) > 1 and core.isupper()) * 2 + (len(tail) < 2 and tail not in SYMBOLS and core[1:].islower() | (len(core) == 1)) * 8 + (tail[-1:] in (".", "?", "!")) * 16
        return zlib.crc32((s + _AGAIN.sub(r"\1\1\1", tail)[:11]).encode()) % BUCKETS, flags
    s = _DIGITS.sub("0", _LETTERS.sub(lambda m: "A" if m[0].isupper() else "a", piece))
    s = _AGAIN.sub(r"\1\1\1", s)[:12]
    letters = [c for c in piece if c.isalpha()]
    flags = (sum(c in SYMBOLS for c in piece[-3:]) >= 2) * 1 + (len(letters) > 1 and all(c.isupper() for c in letters)) * 2 + (not any(c.isalnum() for c in piece)) * 4 + (piece[-1] in ".?!…") * 16
    return zlib.crc32(s.encode()) % BUCKETS, flags


def votes(share: dict[str, float], n: int) -> list[int]:
    """The labellers' votes: 1 good, -1 poor, 0 nothing."""

    def high_is_good(x: float, good: float, poor: float) -> int:
        return 1 if x > good else -1 if x < poor else 0

    return [
        -1 if share["symbols"] > 0.2 else 0,
        -1 if share["capitals"] > 0.4 and n >= 3 else 0,
        -1 if share["repeats"] > 0.3 and n >= 5 else 0,
        -1 if share["variety"] < 0.25 and 30 <= n < 2000 else 0,
        -1 if share["tables"] > 0.15 else 0,
        high_is_good(share["plain"], 0.9, 0.65),
        high_is_good(share["pairs"], 0.8, 0.5),
        high_is_good(share["letters"], 0.9, 0.82),
        1 if 0.01 < share["sentences"] < 0.6 else 0,
    ]


class Describer:
    def __init__(self) -> None:
        self.memo: dict[str, tuple[int, int]] = {}

    def __call__(self, text: str) -> tuple[list[int], list[int], list[float]]:
        """Votes, and the hashed features as indices and values."""
        pieces = text.split()
        n = len(pieces)
        distinct = set(pieces)
        if len(self.memo) + len(distinct) > MEMO:
            self.memo.clear()
        for p in distinct.difference(self.memo):
            self.memo[p] = shape(p)
        counts = Counter(map(self.memo.__getitem__, pieces))
        m = max(n, 1)
        flag = lambda bit: sum(c for (_, f), c in counts.items() if f & bit) / m
        plain = [self.memo[p][1] & 8 for p in pieces]
        pairs = sum(1 for a, b, p, q in zip(plain, plain[1:], pieces, pieces[1:], strict=False) if a and b and p != q)
        solid = "".join(pieces)
        chars = len(solid) - sum(map(str.isdigit, solid))
        lower = sum(map(str.islower, solid))
        share = {"symbols": flag(1), "capitals": flag(2), "tables": flag(4), "plain": flag(8), "sentences": flag(16)}
        share |= {"repeats": sum(map(eq, pieces, pieces[1:])) / m, "variety": len(distinct) / m, "pairs": pairs / max(n - 1, 1), "letters": lower / max(chars, 1)}
        if n < 4:  # too short for shares: what its words are must do
            share |= {"pairs": share["plain"], "letters": share["plain"], "sentences": 0.1 if share["plain"] else 0.0}
        hashed: Counter[int] = Counter()
        for (bucket, _), c in counts.items():
            hashed[bucket] += math.log1p(100 * c / m) / 5
        for name in ("repeats", "variety", "pairs"):  # shares as steps, hashed with the rest
            hashed[zlib.crc32(f"{name}{int(share[name] * 10)}".encode()) % BUCKETS] += 1
        return votes(share, n), list(hashed), list(hashed.values())


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, votes array<int>, at array<int>, x array<double>) of every whole text; null counts as empty."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Describer()
        for batch in batches:
            for part, texts in portions(batch, "text"):
                got = [of(t) for t in texts]
                arrays = [pa.array([g[k] for g in got], pa.list_(kind)) for k, kind in enumerate((pa.int32(), pa.int32(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([part.column("id"), *arrays], ["id", "votes", "at", "x"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, votes array<int>, at array<int>, x array<double>")


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good by pattern, votes' probabilities (class, labeller, vote + 1), share of good.

    Begins from the belief that a document with a poor vote is poor.
    """
    good = np.where((patterns < 0).any(1), 0.1, 0.9)
    model, share = np.zeros((2, patterns.shape[1], 3)), 0.5
    for _ in range(rounds):
        share = (good @ counts + 1) / (counts.sum() + 2)
        for c, w in ((0, (1 - good) * counts), (1, good * counts)):
            for v in (-1, 0, 1):
                model[c, :, v + 1] = ((patterns == v) * w[:, None]).sum(0) + 0.5
        model /= model.sum(2, keepdims=True)
        log = [np.log(model[c, np.arange(patterns.shape[1]), patterns + 1]).sum(1) for c in (0, 1)]
        after = 1 / (1 + np.exp(np.clip(log[0] - log[1] + math.log((1 - share) / share), -500, 500)))
        if np.abs(after - good).max() < 1e-6:
            break
        good = after
    return good, model, share


def train(rows: list[tuple[list[int], list[float], float]], rounds: int = 20, ridge: float = 1e-4) -> np.ndarray:
    """Weights of the hashed model (bias last) on (indices, values, weak label), by AdaGrad over blocks."""
    w, seen = np.zeros(BUCKETS + 1, np.float32), np.full(BUCKETS + 1, 1e-8, np.float32)
    dense = np.zeros((len(rows), BUCKETS + 1), np.float32)
    for k, (at, x, _) in enumerate(rows):
        dense[k, at] = x
    dense[:, -1] = 1
    y = np.array([r[2] for r in rows], np.float32)
    for _ in range(rounds):
        for lo in range(0, len(rows), 512):
            x = dense[lo : lo + 512]
            q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (q - y[lo : lo + 512]) / len(x) + ridge * w
            seen += g * g
            w -= 0.3 * g / np.sqrt(seen)
    return w


def classify_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row per row of `docs`: (id, score double, weak double, votes array<int>, keep boolean).

    score is the linear model's probability of a good document, weak the posterior from the votes,
    keep is score >= 0.5. Null and empty texts get no votes but the first ones and are scored by
    their few features. Ids may be null or repeat; no documents give no rows; other columns are left
    out. Vote patterns are counted over all documents (3 to the number of labellers at most); the
    linear model learns from at most `sample` documents, chosen by a hash of id and features, so copies
    count as often as they come.
    """
    described = stored(describe(docs, id_col, text_col), "described")
    counted = described.groupBy("votes").count().collect()
    if not counted:
        return described.select(F.col("id").alias(id_col), F.lit(0.0).alias("score"), F.lit(0.0).alias("weak"), "votes", F.lit(False).alias("keep"))
    patterns = np.array([r["votes"] for r in counted])
    good, _, _ = expectation_maximisation(patterns, np.array([r["count"] for r in counted], float))
    spark = docs.sparkSession
    weak = spark.createDataFrame([(list(map(int, p)), float(g)) for p, g in zip(patterns, good, strict=True)], "votes array<int>, weak double")
    labelled = described.join(F.broadcast(weak), "votes")
    chosen = sample_by_hash(labelled, F.struct("id", "at", "x"), sample).select("at", "x", "weak").collect()
    weights = train([(r["at"], r["x"], r["weak"]) for r in chosen])
    w = F.lit(weights.tolist())
    z = F.aggregate(F.arrays_zip("at", "x"), F.get(w, F.lit(BUCKETS)), lambda s, f: s + f["x"] * F.get(w, f["at"]))
    scored = labelled.withColumn("score", 1 / (1 + F.exp(-z)))
    return scored.select(F.col("id").alias(id_col), "score", "weak", "votes", (F.col("score") >= 0.5).alias("keep"))
