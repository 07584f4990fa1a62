"""A broadcast bit set with an upper bound on its size, to leave rows behind before they move."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each entry, and the log of the largest size (2^30 bits are 128 MB on the driver and on each executor). Beyond
#: it more rows pass by chance: they cost work, and results stay the same.
BITS, MAX_LOG = 16, 30
#: Log of the bits in a page, which one group of Spark builds.
PAGE_LOG = 16


def _page(table: pa.Table) -> pa.Table:
    bits = np.zeros(1 << PAGE_LOG, np.uint8)
    bits[table.column("bit").to_numpy()] = 1
    return pa.table({"page": table.column("page").slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})


class BitSet:
    """May-hold test on 64-bit hashes. False hits cost work and never change results."""

    def __init__(self, hashes: DataFrame, column: str):
        """hashes: a written table. Spark builds the pages; the driver puts their bytes together."""
        n = max(hashes.count(), 1)
        self.log = int(np.clip(np.ceil(np.log2(n * BITS)), PAGE_LOG, MAX_LOG))
        place = F.shiftrightunsigned(F.col(column), 64 - self.log)
        bit = hashes.select(F.shiftright(place, PAGE_LOG).cast("int").alias("page"), (place % (1 << PAGE_LOG)).cast("int").alias("bit"))
        pages = bit.groupBy("page").applyInArrow(_page, "page int, bits binary").toArrow()
        out = np.zeros((1 << (self.log - PAGE_LOG), (1 << PAGE_LOG) // 8), np.uint8)
        for page, bits in zip(pages.column("page").to_pylist(), pages.column("bits")):
            out[page] = np.frombuffer(bits.as_buffer(), np.uint8)
        self.bits = hashes.sparkSession.sparkContext.broadcast(out.ravel())

    def may_hold(self, h: np.ndarray) -> np.ndarray:
        bit = h >> np.uint64(64 - self.log)
        return (self.bits.value[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0
