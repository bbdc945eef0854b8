"""Byte-pair tokens by a public vocabulary file, which is sent to the workers; nothing is trained."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the published splitting pattern of this vocabulary
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The vocabulary of a file; on a worker its shipped copy."""
    import base64

    import tiktoken

    with open(SparkFiles.get(os.path.basename(path)) if TaskContext.get() else path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_token_count(docs: DataFrame, text: str, out: str = "n", path: str = TOKENIZER, end: bool = True) -> DataFrame:
    """``docs`` with the number of a text's tokens, and one for the end mark; a null text has the end mark only."""
    docs.sparkSession.sparkContext.addFile(path)

    @pandas_udf(IntegerType())
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = tokenizer(path).encode_ordinary
        for batch in texts:
            yield batch.map(lambda t: len(encode(t)) if t else 0).astype("int32") + int(end)

    return docs.withColumn(out, count(F.col(text)))
