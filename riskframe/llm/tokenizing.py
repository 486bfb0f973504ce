"""Text sizes in tokens of a public byte-level tokenizer."""

from __future__ import annotations

import base64
import os

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.runtime import map_arrow

TOKENIZERS = os.environ.get("RISKFRAME_TOKENIZERS", "/opt/tokenizers")

#: Fixed value: how the byte-level vocabulary splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_pieces = regex.compile(PATTERN)
_made: dict[int, object] = {}


def encoder(vocabulary: bytes):
    """The tokenizer of a vocabulary file's bytes, made once per process."""
    key = hash(vocabulary)
    if key not in _made:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        _made[key] = tiktoken.Encoding("riskframe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        _made[key].sizes = _Sizes(_made[key])
    return _made[key]


class _Sizes(dict):
    """Tokens of each piece that the pattern makes; merging never crosses its ends. Emptied when it has grown to its size."""

    def __init__(self, enc):
        super().__init__()
        self.enc = enc

    def __missing__(self, piece: str) -> int:
        if len(self) >= 300_000:
            self.clear()
        self[piece] = out = len(self.enc.encode_ordinary(piece))
        return out


def count(enc, text: str | None) -> int:
    """Tokens of a text, piece by piece; 0 for null and empty texts."""
    return sum(map(enc.sizes.__getitem__, _pieces.findall(text))) if text else 0


def shared_vocabulary(spark, tokenizer: str | None = None):
    """The bytes of a vocabulary file in tiktoken's format (under 1 MB), read by the driver and shared with the workers."""
    with open(tokenizer or f"{TOKENIZERS}/byte_bpe_50k.tiktoken", "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def sized(documents: DataFrame, keep: list[str], tokenizer: str | None = None) -> DataFrame:
    """The kept columns and ``tokens``, the size of text, of every document.

    tokenizer is the path of a vocabulary in tiktoken's format. The driver reads it and shares its bytes (under
    1 MB), so that workers need no file.
    """
    shared = shared_vocabulary(documents.sparkSession, tokenizer)

    def run(batches):
        enc = encoder(shared.value)
        for b in batches:
            sizes = [count(enc, t) for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(sizes, pa.int64())], names=[*keep, "tokens"])

    rows = documents.select(*keep, F.col("text"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return map_arrow(rows, run, f"{types}, tokens long")
