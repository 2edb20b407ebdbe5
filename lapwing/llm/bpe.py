"""BPE encoding and decoding with a pair occurrence index.

The distinct words of a partition are laid out as one array of symbols. An index maps every
adjacent pair that has a merge rank to all its positions. The active ranks are applied in
ascending order, each to all its positions at once; a merge only creates pairs of higher rank, so
one ascending pass gives what word-by-word merging gives. Each merge updates the lists of the
pairs on its left and right.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of pieces that a task remembers at most, characters that it handles at once, and bytes of decoded texts in a batch.
MEMO_BYTES, CHARS, BATCH_BYTES = 48 << 20, 1_500_000, 32 << 20
#: White_Space of Unicode.
SPACES = "\t\n\x0b\x0c\r \x85\xa0  -     　"


def vocabulary_path(name: str) -> str:
    """Place of a public vocabulary file on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _newer(kind: str) -> list[int]:
    """Code points that Python has no category for yet and the tokenizers library has: the library is asked."""
    import regex
    from tokenizers.pre_tokenizers import ByteLevel

    is_kind, cut, like = regex.compile(rf"\p{{{kind}}}"), ByteLevel(add_prefix_space=False), {"L": "a", "N": "1"}[kind]
    new = (chr(i) for i in range(0x110000) if unicodedata.category(chr(i)) == "Cn")
    return [ord(c) for c in new if is_kind.match(c) and len(cut.pre_tokenize_str(like + c)) == 1]


def _ranges(kind: str) -> str:
    """The code points of a general category letter, as the inside of a character class."""
    hits = [i for i in range(0x110000) if unicodedata.category(chr(i))[0] == kind]
    hits = sorted(hits + _newer(kind))
    cuts = [0, *(k for k in range(1, len(hits)) if hits[k] != hits[k - 1] + 1), len(hits)]
    return "".join(f"\\U{hits[a]:08x}-\\U{hits[b - 1]:08x}" for a, b in zip(cuts, cuts[1:], strict=False))


@lru_cache(1)
def word_pattern() -> re.Pattern:
    letters, numbers = _ranges("L"), _ranges("N")
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{SPACES}{letters}{numbers}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte: printable Latin-1 stands for itself, the rest follow from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Vocabulary:
    """Merge ranks, special strings and bytes of a byte-level BPE file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids, alphabet = spec["model"]["vocab"], byte_alphabet()
        back = {c: b for b, c in alphabet.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.text = [b""] * size
        for token, i in ids.items():
            self.text[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.text[i] = token.encode()
        self.of_byte = np.array([ids[alphabet[b]] for b in range(256)], np.int32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left, right = (np.array([ids[m[k]] for m in merges], np.int64) for k in (0, 1))
        self.left, self.right = left.astype(np.int32), right.astype(np.int32)
        self.merged = np.array([ids[a + b] for a, b in merges], np.int32)
        self.base = size
        key = left * size + right
        self.order = np.argsort(key, kind="stable").astype(np.int32)
        self.keys = key[self.order]
        self.lengths = np.array([len(t) for t in self.text], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(self.text), np.uint8)
        self.split = re.compile("|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it never merges."""
        key = a.astype(np.int64) * self.base + b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.order[at], -1)

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian int32 bytes."""
        if not words:
            return []
        size = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(size)
        n = int(ends[-1])
        token = np.empty(n + 1, np.int32)
        token[:n] = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        token[n] = -1
        follows = np.arange(1, n + 1, dtype=np.int32)
        before = np.arange(-1, n - 1, dtype=np.int32)
        full = ends[size > 0]
        follows[full - 1] = n  # n: no neighbour
        before[np.concatenate(([0], full[:-1]))] = n
        before = np.append(before, n)
        follows = np.append(follows, n)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(at: np.ndarray) -> None:
            """Enters the pairs that begin at these positions."""
            rank = self.ranks(token[at], token[follows[at]])
            keep = rank >= 0
            at, rank = at[keep], rank[keep]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, part in zip(rank[np.concatenate(([0], cut))].tolist(), np.split(at, cut), strict=True):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(heap, r)

        at = np.flatnonzero(follows[:n] != n).astype(np.int32)
        for lo in range(0, len(at), 1 << 20):
            add(at[lo : lo + (1 << 20)])
        while heap:
            r = heapq.heappop(heap)
            parts = index.pop(r)
            at = np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0]
            a, b = self.left[r], self.right[r]
            at = at[(token[at] == a) & (token[follows[at]] == b)]  # others were merged away meanwhile
            if a == b and len(at) > 1:  # of an overlapping run every second one
                first = np.concatenate(([True], follows[at[:-1]] != at[1:]))
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(first, place, 0))) % 2 == 0]
            if not len(at):
                continue
            gone = follows[at]
            after = follows[gone]
            token[at] = self.merged[r]
            token[gone] = -1
            follows[at] = after
            before[after] = at
            before[n] = n
            left = before[at]
            add(np.concatenate((left[left != n], at[after != n])))
        alive = token[:n] >= 0
        ids = token[:n][alive].tobytes()
        upto = np.concatenate(([0], np.cumsum(alive)))[np.concatenate(([0], ends))] * 4
        return [ids[x:y] for x, y in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


#: A space between two characters that aren't white space always begins a word, whatever stands around.
STABLE = re.compile(r"(?<=\S) (?=\S)")
UNSTABLE = re.compile(r" \s|\A\s"), re.compile(r"\s |\s\Z")


class Pieces:
    """Cuts texts at stable boundaries and remembers what each piece gives."""

    def __init__(self, most: int = MEMO_BYTES) -> None:
        self.body: dict[str, object] = {}  # by pieces that follow a space
        self.head: dict[str, object] = {}  # by pieces that begin a text
        self.most, self.held = most, 0

    def cut(self, text: str) -> list[str]:
        """Pieces between stable boundaries, each but the first without the space before it."""
        return STABLE.split(text) if any(u.search(text) for u in UNSTABLE) else text.split(" ")

    def learn(self, cuts: list[list[str]], values: Callable[[list[str]], Iterable]) -> None:
        """Remembers the pieces not seen before, with the values of their texts; forgets all others first if they would be too many bytes together."""
        body: set[str] = set()
        for c in cuts:
            body.update(c[1:])
        head = {c[0] for c in cuts}
        cost = lambda pieces: sum(map(len, pieces)) * 6 + 250 * len(pieces)  # noqa: E731  of a text, its value and their place
        added = cost(body - self.body.keys()) + cost(head - self.head.keys())
        if self.held and self.held + added > self.most:
            self.body.clear()
            self.head.clear()
            self.held, added = 0, cost(body) + cost(head)
        self.held += added
        for memo, keys, space in ((self.body, body, " "), (self.head, head, "")):
            new = list(keys - memo.keys())
            memo.update(zip(new, values([space + p for p in new]), strict=True))


class Encoder:
    def __init__(self, path: str) -> None:
        self.vocab, self.pieces = vocabulary(path), Pieces()

    def _ids(self, texts: list[str]) -> list[bytes]:
        find, split = word_pattern().findall, self.vocab.split
        apart = [(t, split.split(t), split.findall(t)) for t in texts if split.search(t)] if split else []
        whole = texts if not apart else [t for t in texts if not split.search(t)] + [p for _, parts, _ in apart for p in parts]
        cut = list(map(find, whole))
        words = list(set().union(*cut))
        of = dict(zip(words, self.vocab.encode_words([w.encode() for w in words]), strict=True)).__getitem__
        ids = [of(c[0]) if len(c) == 1 else b"".join(map(of, c)) for c in cut]
        if not apart:
            return ids
        known = dict(zip(whole, ids, strict=True))
        mark = {t: np.int32(i).tobytes() for t, i in self.vocab.special.items()}
        for t, parts, marks in apart:
            known[t] = b"".join(x for p, m in zip(parts, [*marks, None], strict=True) for x in (known[p], mark[m] if m else b""))
        return [known[t] for t in texts]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as int32 bytes."""
        cuts = [self.pieces.cut(t) for t in texts]
        self.pieces.learn(cuts, self._ids)
        body, head = self.pieces.body.__getitem__, self.pieces.head
        return [b"".join((head[c[0]], *map(body, c[1:]))) for c in cuts]


def portions(batch: pa.RecordBatch, text: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch of at most CHARS characters (or one row), with their texts; null is empty."""
    start, total, texts = 0, 0, []
    for k, t in enumerate(batch.column(text)):
        t = t.as_py() or ""
        if texts and total + len(t) > CHARS:
            yield batch.slice(start, len(texts)), texts
            start, total, texts = k, 0, []
        texts.append(t)
        total += len(t)
    if texts:
        yield batch.slice(start, len(texts)), texts


def encode(docs: DataFrame, vocab: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(id, ids array<int>) of every whole text, with `decoded` also what `decode` makes of the ids.

    Null text counts as empty and gives no ids; special strings of the file inside a text give their
    id. Rows repeat as often as they come and ids may be null; other columns are left out, so their
    names can't clash. `vocab`: a file name of the public vocabularies, or a path. Decoded in the same
    pass, ids don't go through a second Python worker, which would hold a vocabulary and batches of its own.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(vocab if "/" in vocab else vocabulary_path(vocab))
        for batch in batches:
            for part, texts in portions(batch, "text"):
                got = coder.encode(texts)
                ends = np.cumsum([0, *map(len, got)]) // 4
                ids = np.frombuffer(b"".join(got), np.int32)
                out = pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))], ["id", "ids"])
                if decoded:
                    del got
                    out = _decoded(out, [_text(coder.vocab, ids[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)])
                yield out

    kind = f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>"
    out = rows.mapInArrow(run, kind + ", decoded string" if decoded else kind)
    return out.select(F.col("id").alias(id_col), *out.columns[1:])


def decode(encoded: DataFrame, vocab: str = "byte_bpe_50k.json", id_col: str = "doc_id") -> DataFrame:
    """(id, ids, decoded string): the bytes of all ids in order, read as UTF-8, special ids included.

    Bytes that aren't UTF-8 become U+FFFD. Null ids count as none.
    """
    rows = encoded.select(F.col(id_col).alias("id"), "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(vocab if "/" in vocab else vocabulary_path(vocab))
        for batch in batches:
            start, held, texts = 0, 0, []
            for k, ids in enumerate(batch.column("ids")):
                text = _text(v, ids.values.to_numpy(zero_copy_only=False) if ids.is_valid else np.empty(0, np.int32))
                size = 4 * len(text) if not text.isascii() else len(text)
                if texts and held + size > BATCH_BYTES:  # an array of strings holds 2 GB at most
                    yield _decoded(batch.slice(start, len(texts)), texts)
                    start, held, texts = k, 0, []
                texts.append(text)
                held += size
            if texts:
                yield _decoded(batch.slice(start, len(texts)), texts)

    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>, decoded string")
    return out.select(F.col("id").alias(id_col), "ids", "decoded")


def _text(v: Vocabulary, ids: np.ndarray) -> str:
    return b"".join(_bytes(v, ids[k : k + 500_000]) for k in range(0, len(ids), 500_000)).decode("utf-8", "replace")


def _decoded(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([part.column("id"), part.column("ids"), pa.array(texts, pa.string())], ["id", "ids", "decoded"])


def _bytes(v: Vocabulary, ids: np.ndarray) -> bytes:
    size = v.lengths[ids]
    upto = np.cumsum(size)
    where = np.repeat(v.starts[ids] - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0)
    return v.blob[where].tobytes()
