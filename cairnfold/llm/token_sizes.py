"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that goes with the vocabulary: it cuts text before merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_loaded: dict[tuple[str, str], object] = {}


def encoding(vocabulary: str = VOCABULARY, pattern: str = PATTERN):
    """The tokenizer of a rank file, loaded once in a process. On an executor it is the file sent along."""
    if (vocabulary, pattern) not in _loaded:
        import tiktoken

        sent = SparkFiles.get(os.path.basename(vocabulary)) if SparkFiles._is_running_on_worker else vocabulary
        with open(sent if os.path.exists(sent) else vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _loaded[vocabulary, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _loaded[vocabulary, pattern]


def token_sizes(docs: DataFrame, text: str, keep: list[str], vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """Columns ``keep`` and ``n_tokens`` of whole texts; a null or empty text has 0. Strings that look like
    special tokens are ordinary text. A column of ``keep`` must not be called n_tokens."""
    if "n_tokens" in keep:
        raise ValueError("n_tokens is the name of the result")
    docs.sparkSession.sparkContext.addFile(vocabulary)
    cols = [*keep, text] if text not in keep else keep
    at = len(keep) if text not in keep else keep.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary, pattern)
        for batch in batches:
            n = [len(enc.encode_ordinary(x)) if x else 0 for x in batch.column(at).to_pylist()]
            kept = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*cols).mapInArrow(run, f"{schema}, n_tokens bigint")
