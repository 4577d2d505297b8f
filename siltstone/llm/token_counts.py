"""Token counts: batches of texts are encoded inside Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import tokens


def count_tokens(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with ``n_bytes`` (UTF-8) and ``n_tokens`` of each whole text.

    One row per input row, repeated rows included; null and empty texts have 0 of both. Other columns are
    dropped. Each Arrow batch is handled in slices of about equal bytes, long texts are split where no token
    can reach across, and no ids leave the worker. The result needs no shuffle.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(path)
        for batch in batches:
            for part in tokens.slices(batch, "__text"):
                texts = part.column("__text")
                n = encoder.counts(texts)
                size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], size, pa.array(n, pa.int64())], [*part.schema.names[:-1], "n_bytes", "n_tokens"]
                )

    rows = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.select(*keep).dtypes)
    return rows.mapInArrow(counted, f"{schema}, n_bytes long, n_tokens long")
