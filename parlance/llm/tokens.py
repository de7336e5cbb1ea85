"""Sizes of texts in tokens of a public tokenizer. Tokenizers are read from files, never trained."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Where the vocabulary files lie on every machine, and the one that counts by default.
FOLDER = os.environ.get("PARLANCE_TOKENIZERS", "/opt/tokenizers")
FILE = "byte_bpe_multi_50k.tiktoken"
#: The usual split of a text ahead of byte-level merges.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def encoder(path: str):
    """A function from texts to token counts. The file's ending names the library: .tiktoken, .json or .model."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(own.encode_ordinary(t)) for t in texts]
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.encode_special_tokens = True
        return lambda texts: [len(x) for x in own.encode_batch(texts, add_special_tokens=False)]
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(x) for x in own.encode(texts, num_threads=1)]


_ENCODERS: dict[str, object] = {}


def token_counts(df: DataFrame, text: str, keep: list[str], path: str | None = None) -> DataFrame:
    """`keep` and `tokens`: the whole text's number of tokens, 0 for NULL and empty texts."""
    path = path or os.path.join(FOLDER, FILE)
    schema = T.StructType([df.schema[k] for k in keep]).add("tokens", T.IntegerType())
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ENCODERS:
            _ENCODERS[path] = encoder(path)
        count = _ENCODERS[path]
        for b in batches:
            sizes = count([t or "" for t in b.column(len(keep)).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(i).cast(arrow.field(i).type) for i in range(len(keep))] + [pa.array(sizes, pa.int32())], schema=arrow)

    return df.select(*keep, text).mapInArrow(run, schema)
