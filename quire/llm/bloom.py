"""A fixed-size membership filter that is made where the keys are and sent to every task.

The filter has ``2 ** BITS`` bits (8 MB) whatever the input, two for a key, so its broadcast is bounded; where many keys
saturate it, more rows pass and the exact join behind it does the work.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textvec import U, mix

BITS = 26


def _bits(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each key."""
    first = mix(keys)
    return first >> U(64 - BITS), mix(first + U(0x9E3779B97F4A7C15)) >> U(64 - BITS)


def _words(batches):
    for batch in batches:
        keys = np.asarray(batch.column(0)).view(U)
        if len(keys):
            at = np.unique(np.concatenate(_bits(keys)))
            word, first = np.unique(at >> U(6), return_index=True)
            value = np.bitwise_or.reduceat(U(1) << (at & U(63)), first)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(value.view(np.int64))], names=["w", "v"])


def _whole(batches):
    """The filter, from its different words (at most 2 ** (BITS - 6) rows whatever the input)."""
    table = np.zeros(1 << (BITS - 6), dtype=U)
    for batch in batches:
        table[np.asarray(batch.column(0))] = np.asarray(batch.column(1)).view(U)
    yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()], pa.binary())], names=["t"])


def make(keys: DataFrame) -> np.ndarray:
    """The filter of a one-column table of long keys without nulls."""
    words = keys.mapInArrow(_words, "w long, v long").groupBy("w").agg(F.bit_or("v").alias("v"))
    got = words.repartition(1).mapInArrow(_whole, "t binary").toArrow().column("t")
    return np.frombuffer(got[0].as_py(), dtype=U) if len(got) else np.zeros(1 << (BITS - 6), dtype=U)


def maybe(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the keys (uint64) may have been put in."""
    one, two = (((table[(at >> U(6)).astype(np.int64)] >> (at & U(63))) & U(1)).astype(bool) for at in _bits(keys))
    return one & two
