"""A bit filter over ids, of a fixed size: spares rows a shuffle that a join by id would not keep.

It never decides: rows whose bit is set still go through the exact join. With more ids than bits it
spares less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import prepare

BITS = 1 << 27


def _bit():
    return F.pmod(F.xxhash64("doc_id"), F.lit(BITS))


def bits_of(rows: DataFrame, bit):
    """Broadcast bits, of which those are on that the rows name (from 0): BITS / 8 bytes, whatever their number."""
    held = rows.groupBy(F.bitmap_bucket_number(bit + 1).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit + 1)).alias("bits"))
    on = bytearray(BITS // 8)
    for r in held.toLocalIterator():
        on[(r.k - 1) * 4096 : r.k * 4096] = r.bits
    return rows.sparkSession.sparkContext.broadcast(bytes(on))


def id_bits(ids: DataFrame):
    """Broadcast bits of ids(doc_id long)."""
    return bits_of(ids.where("doc_id is not null"), _bit())


def is_on(held: bytes, at: np.ndarray) -> np.ndarray:
    """Whether bits (from 0) are on."""
    bits = np.frombuffer(held, np.uint8)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def with_bit(docs: DataFrame, bits, on: bool) -> DataFrame:
    """The rows of docs (with a long column doc_id, null: bit not set) whose bit is set, or isn't."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column(batch.num_columns - 1)
            known = ~p.is_null().to_numpy(zero_copy_only=False)
            p = p.fill_null(0).to_numpy()
            keep = (is_on(bits.value, p) & known) == on
            yield batch.select(range(batch.num_columns - 1)).filter(pa.array(keep))

    bit = F.when(F.col("doc_id").isNotNull(), _bit())
    return docs.select(*(F.col(f"`{c}`") for c in docs.columns), bit.alias("_bit")).mapInArrow(run, docs.schema)


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is in gone(doc_id); rows without an id stay."""
    bits = id_bits(gone)
    return with_bit(docs, bits, False).union(with_bit(docs, bits, True).join(gone, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns)))
