"""Token counts by rank-synchronous merging of ragged arrays (see `bpe`).

One narrow stage. Each worker reads the tokenizer file once, counts texts in batches of a bounded number of bytes
(beside the longest single text) and remembers a bounded number of pre-tokens.

Defined results: a null or empty text has no tokens; special strings inside a text count as the one token they are to
the library; of pairs that tie in rank the leftmost merges first; a null id is carried through; repeated rows are counted
each for itself; a very long text is counted in parts; an empty table gives an empty result; other columns are not read,
so their names may clash with ours.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from fairlead.llm.media import in_batches, skinny

LIMIT = 512
BATCH_BYTES = 2_000_000
FILE = "byte_bpe_50k.json"


def tokenizer_path(name: str = FILE) -> str:
    """Where this machine keeps the public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counts(
    docs: DataFrame, file: str = FILE, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from fairlead.llm.bpe import Encoder

        encoder = Encoder(tokenizer_path(file))
        for ids, raws in in_batches(batches, BATCH_BYTES):
            n = encoder.count([r.decode() for r in raws])
            columns = [pa.array(ids, pa.int64()), pa.array([len(r) for r in raws], pa.int64()), pa.array(n), pa.array(n > limit)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return skinny(docs, id_col, text_col).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_token_counts": op5_token_counts}
ORACLES: dict[str, str] = {}
