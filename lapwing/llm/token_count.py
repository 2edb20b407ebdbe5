"""Token counts with overlap resynchronisation.

Huge documents are encoded in overlapping chunks with offsets and spliced at a boundary that is
proven stable: a space between two characters that aren't white space starts a word of the
pre-tokeniser whatever stands before or after, so both chunks agree on what follows and what
precedes it, once each has it as a token's begin. Where an overlap holds no such boundary it is
widened, up to the rest of the document. Shorter documents are cut at the same kind of boundary
into pieces that a task remembers, so each distinct piece is encoded once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapwing.llm.bpe import STABLE, Pieces, portions, vocabulary_path

#: Characters from which a document is huge, of a chunk, and of the first overlap.
HUGE, CHUNK, OVERLAP = 32_768, 16_384, 128


@lru_cache(4)
def library(path: str):
    """Encoder of a file: texts to their numbers of tokens, text to its token begins."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return (lambda texts: list(map(len, model.encode(texts, num_threads=1)))), None
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    fast = lambda texts: list(map(len, t.encode_batch_fast(texts, add_special_tokens=False)))
    begins = lambda text: np.array([a for a, _ in t.encode(text, add_special_tokens=False).offsets], np.int64)
    return fast, begins


def count_huge(text: str, begins, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text by overlapping chunks; `begins` gives the begin of each token of a string."""
    total, start, end = 0, 0, min(chunk, len(text))
    here = begins(text[:end])  # of the chunk from start to end; begins from 0
    while end < len(text):
        width = overlap
        while True:
            left = max(start + 1, end - width)
            upto = min(len(text), left + chunk + width)
            after = begins(text[left:upto])
            cut = next((m.start() for m in STABLE.finditer(text, left, min(end, upto)) if m.start() + 1 < end and _has(here, m.start() - start) and _has(after, m.start() - left)), None)
            if cut is not None:
                break
            if left == start + 1:  # no boundary in all of the chunk: it grows to the right
                end = min(len(text), end + chunk)
                here = begins(text[start:end])
                if end == len(text):
                    return total + len(here)
                width = overlap
            else:
                width *= 2
        total += int(np.searchsorted(here, cut - start))
        here, start, end = after[np.searchsorted(after, cut - left) :] + (left - cut), cut, upto
    return total + len(here)


def _has(begins: np.ndarray, at: int) -> bool:
    k = int(np.searchsorted(begins, at))
    return k < len(begins) and begins[k] == at


def count_tokens(docs: DataFrame, vocab: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text", huge: int = HUGE) -> DataFrame:
    """(id, n_bytes long, n_tokens long) of every whole text.

    Null text counts as empty: 0 and 0. Ids may be null or repeat; each row gives a row. Other
    columns are left out. Special strings inside a text count as the library's default has it.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fast, begins = library(vocab if "/" in vocab else vocabulary_path(vocab))
        pieces = Pieces()
        for batch in batches:
            for part, texts in portions(batch, "text"):
                if begins is None:  # a unigram or sentence model has no boundary of this kind
                    counts = fast(texts)
                else:
                    short = [k for k, t in enumerate(texts) if len(t) < huge]
                    counts = [0 if len(t) < huge else count_huge(t, begins) for t in texts]
                    cuts = [pieces.cut(texts[k]) for k in short]
                    pieces.learn(cuts, fast)
                    body = pieces.body.__getitem__
                    for k, c in zip(short, cuts, strict=True):
                        counts[k] = pieces.head[c[0]] + sum(map(body, c[1:]))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens")
