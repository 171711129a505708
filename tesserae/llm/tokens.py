"""Token counts by a public tokenizer."""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary file is found unless a path is given.
TOKENIZER_PATH = os.environ.get("TESSERAE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")

#: Fixed value: the split pattern that belongs to this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoding(vocabulary: bytes):
    """The byte-level BPE of a rank file: one token in base64 and its rank a line."""
    import tiktoken

    pairs = (line.split() for line in vocabulary.splitlines() if line)
    return tiktoken.Encoding("counted", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})


_ENCODINGS: dict = {}


def _encoding(key: str, vocabulary):
    """One encoding per worker process, kept between tasks."""
    if key not in _ENCODINGS:
        _ENCODINGS.clear()
        _ENCODINGS[key] = encoding(vocabulary.value)
    return _ENCODINGS[key]


def token_counts(documents: DataFrame, text: str = "text", tokenizer_path: str = TOKENIZER_PATH, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(``keep``, n_tokens) of every document, whole texts; null and empty texts have none.

    The vocabulary file is read once, on the driver, and broadcast (it is under 2 MB).
    """
    with open(tokenizer_path, "rb") as file:
        content = file.read()
    vocabulary, key = documents.sparkSession.sparkContext.broadcast(content), hashlib.sha256(content).hexdigest()
    kept = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(key, vocabulary).encode_ordinary
        for batch in batches:
            counts = [len(encode(t)) if t else 0 for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, pa.array(counts, pa.int64())], [*kept, "n_tokens"])

    schema = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in kept)
    return documents.select(*[F.col(f"`{c}`") for c in kept], F.col(text).alias("_text")).mapInArrow(run, f"{schema}, n_tokens bigint")
