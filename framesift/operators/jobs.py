"""Arrow jobs: user-supplied detectors and blending of rasters."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def payloads(column: pa.Array) -> list[memoryview] | list[np.ndarray]:
    """The values of an array without nulls, as views of its buffers: memoryviews of a binary column, numpy arrays of an array column."""
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        values = column.values.to_numpy(zero_copy_only=False)
    else:
        data = column.buffers()[2]
        values = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    wide = pa.types.is_large_list(column.type) or pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    edges = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    values = values if pa.types.is_list(column.type) or pa.types.is_large_list(column.type) else memoryview(values)
    return [values[i:j] for i, j in zip(edges, edges[1:])]


def apply_detector(
    images: DataFrame, load: Callable[[], Callable[[list], list]], schema: str, key: str, payload: str, batch_size: int = 16, batch_bytes: int = 64 << 20, retries: int = 0
) -> DataFrame:
    """Runs a detector over image rows: key, found (array of `schema` structs) and error.

    load() gives the detector, once a task; it takes a list of payloads and returns a list of lists of dicts. Payloads are bytes or arrays of numbers,
    which it gets as memoryviews or read-only numpy arrays over the Arrow buffers. A detector's batch has at most `batch_size` payloads and, but for a larger one alone, `batch_bytes`
    bytes, whatever Arrow batches they came in; results leave a detector's batch at a time. So besides the Arrow batch that is being read (which
    Spark bounds by spark.sql.execution.arrow.maxRecordsPerBatch and maxBytesPerBatch) and what is left of the one before, a task holds one detector's batch.

    A failing batch is tried again `retries` times; then its rows get its message as error and no detections, and the rest goes on. A detector that returns
    another number of results fails so too. Rows without payload are left out.
    """
    if not 1 <= batch_size <= 64:
        raise ValueError("batch_size is from 1 to 64")
    kind = images.schema[key].dataType.simpleString()
    item = T.ArrayType(T._parse_datatype_string(schema))
    arrow, key_type = to_arrow_type(item), to_arrow_type(images.schema[key].dataType)

    def detected(detector, part):
        for left in range(retries, -1, -1):
            try:
                found = list(detector(part))
                if len(found) != len(part):
                    raise ValueError(f"{len(found)} results for {len(part)} images")
                return found, None
            except Exception as e:  # a detector may fail on any image; its batch is reported, not lost silently
                if not left:
                    return [[]] * len(part), f"{type(e).__name__}: {e}"

    def run(batches):
        detector, keys, waiting, size = None, [], [], 0

        def flush():
            found, error = detected(detector, waiting)
            return pa.RecordBatch.from_arrays([pa.array(keys, key_type), pa.array(found, arrow), pa.array([error] * len(waiting), pa.string())], [key, "found", "error"])

        for b in batches:
            detector = detector or load()
            for k, one in zip(b.column(0).to_pylist(), payloads(b.column(1))):
                if waiting and (len(waiting) == batch_size or size + one.nbytes > batch_bytes):
                    yield flush()
                    keys, waiting, size = [], [], 0
                keys.append(k)
                waiting.append(one)
                size += one.nbytes
        if waiting:
            yield flush()

    rows = images.where(F.col(payload).isNotNull()).select(key, payload)
    return rows.mapInArrow(run, f"`{key}` {kind}, found {item.simpleString()}, error string")


def blend(original: Column, restored: Column, strength: float) -> Column:
    """strength * restored + (1 - strength) * original of two pixel arrays, rounded down into 0..255."""
    if strength <= 0:
        return original
    if strength >= 1:
        return restored
    mixed = F.zip_with(original, restored, lambda o, r: r * F.lit(float(strength)) + o * F.lit(1.0 - strength))
    return F.transform(mixed, lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(x).cast("int"))))
