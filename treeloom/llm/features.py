"""Token counts, hashed vectors, curve keys and topics of documents, in one pass over whole texts."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.runtime import ship

#: Where the public tokenizers' files are, and the one used unless another path is given.
TOKENIZER = os.environ.get("TREELOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")

#: Fixed value: how the 50k byte-level vocabularies split text before they merge bytes, in the form that never backtracks far.
SPLIT_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

DIMENSIONS = 3
BITS = 10
HASHED = 256
TOPIC_BITS = 4

_WORD = re.compile(r"\w+")


_LONG_GAP = re.compile(r"(?<![^\S\x1c-\x1f])[^\S\x1c-\x1f]{1000,}+(?=[\S\x1c-\x1f])")


def _parts(text: str) -> Iterator[str]:
    """The text cut where the split pattern cuts it anyway: around long white space, of which the last character goes with what follows."""
    start = 0
    for gap in _LONG_GAP.finditer(text):
        yield text[start : gap.start()]
        yield text[gap.start() : gap.end() - 1]
        start = gap.end() - 1
    yield text[start:]


@lru_cache(maxsize=2)
def _counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts tokens by a vocabulary file: .tiktoken ranks, a .json tokenizer, or a .model of pieces."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        ranked = tiktoken.Encoding("ranks", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [sum(len(ranked.encode_ordinary(part)) for part in _parts(t)) for t in texts]
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in pieces.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda texts: [len(e.ids) for e in t.encode_batch_fast(texts, add_special_tokens=False)]


def token_counts(texts: list[str], path: str = TOKENIZER) -> list[int]:
    return _counter(path)(texts)


@lru_cache(maxsize=1)
def _projection() -> np.ndarray:
    """Random directions from the hashed space to the curve's dimensions and the topic bits."""
    return np.random.default_rng(6).standard_normal((HASHED, DIMENSIONS + TOPIC_BITS))


@lru_cache(maxsize=200_000)
def _slot(word: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word) % HASHED


def project(texts: list[str]) -> np.ndarray:
    """Each text's hashed word counts, damped and normalised, in a few random directions; 0 for texts without words."""
    counts = np.zeros((len(texts), HASHED))
    for i, t in enumerate(texts):
        slots = [_slot(w) for w in _WORD.findall(t.lower())]
        if slots:
            counts[i] = np.bincount(slots, minlength=HASHED)
    damped = np.log1p(counts)
    damped -= damped.mean(axis=1, keepdims=True)
    norm = np.linalg.norm(damped, axis=1, keepdims=True)
    return (damped / np.where(norm == 0, 1, norm)) @ _projection()


def hilbert_keys(grid: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of each row of integer coordinates (Skilling's transform, all rows at once)."""
    x = grid.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(on, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _featurer(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            if not texts:
                continue
            axes = project(texts)
            # coordinates are about normal with variance 1, so their distribution function spreads them evenly
            even = 1 / (1 + np.exp(-1.702 * axes[:, :DIMENSIONS]))
            grid = np.minimum((even * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
            topic = ((axes[:, DIMENSIONS:] > 0) << np.arange(TOPIC_BITS)).sum(axis=1)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "source": batch.column("source"),
                    "lang": batch.column("lang"),
                    "tokens": pa.array(token_counts(texts, path), pa.int64()),
                    "curve": pa.array(hilbert_keys(grid), pa.int64()),
                    "topic": pa.array(topic, pa.int32()),
                }
            )

    return run


def document_features(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str | None = None, lang: str | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, lang, tokens, curve, topic) of every document whose text is not null or empty."""
    ship(docs.sparkSession)
    none = F.lit(None).cast("string")
    rows = docs.where(F.length(text) > 0).select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(text).cast("string").alias("text"),
        (F.col(source).cast("string") if source else none).alias("source"),
        (F.col(lang).cast("string") if lang else none).alias("lang"),
    )
    return rows.mapInArrow(_featurer(tokenizer), "doc_id bigint, source string, lang string, tokens bigint, curve bigint, topic int")
