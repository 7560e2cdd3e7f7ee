"""Token counts of a public tokenizer, as a column beside the key; the text never leaves the map stage."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import ship

#: Default vocabulary (ranks of a byte-level BPE); a parameter everywhere.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that cuts text before the merges, fixed with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


_sent: set[tuple[str, str]] = set()


@lru_cache(maxsize=4)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), vocabulary: str = VOCABULARY) -> DataFrame:
    """key, the columns of keep, n_tokens (long). Null and empty texts have 0 tokens. The file of the
    vocabulary is sent to executors that don't have it at this path."""

    spark = df.sparkSession
    ship(spark)
    if os.path.exists(vocabulary) and (sent := (spark.sparkContext.applicationId, vocabulary)) not in _sent:
        spark.sparkContext.addFile(vocabulary)
        _sent.add(sent)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(vocabulary if os.path.exists(vocabulary) else SparkFiles.get(os.path.basename(vocabulary))).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=[*b.schema.names[:-1], "n_tokens"])

    src = df.select(key, *keep, F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]) + ", n_tokens bigint"
    return src.mapInArrow(count, schema)
