"""Deals Python kernels out over rows by Arrow batches: narrow, one row in memory at a time beside its batch, which is bounded by
bytes. Kernels of which one takes what another yields run in one pass, so what lies between them never leaves the worker."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

Step = tuple[list[int], int, Callable[..., Iterable[tuple]]]


def weight(value: object) -> int:
    """About the bytes of memory that a value takes in Python."""
    if isinstance(value, (bytes, bytearray, str)):
        return 56 + len(value)
    return 56 + sum(map(weight, value)) if isinstance(value, (list, tuple)) else 32


def fields(struct: dict | tuple) -> tuple:
    """A struct's values: one read from a table comes as a dict, one that a kernel before yielded as a tuple."""
    return tuple(struct.values()) if isinstance(struct, dict) else struct


def yielded(values: tuple | list, steps: list[Step]) -> Iterator[tuple]:
    """What the steps, one after another, make of a row."""
    if not steps:
        yield tuple(values)
        return
    (pick, keep, kernel), *rest = steps
    taken = [values[i] for i in pick]
    for found in kernel(*taken[keep:]):
        yield from yielded((*taken[:keep], *found), rest)


def flat_map(df: DataFrame, kernel: Callable[..., Iterable[tuple]], schema: str, keep: int = 0, most: int = 50_000, columns: list[str] | None = None, most_bytes: int = 4 << 20) -> DataFrame:
    """Rows (first ``keep`` columns of df, then what kernel(*other columns) yields), with ``schema`` naming all of them.

    columns: those of df to be taken, in this order; if df is itself a flat_map(), both run in one pass (unless it is cached). Rows leave in
    batches of at most ``most`` rows and, but for one row that is larger, about ``most_bytes``.
    """
    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    arrow = to_arrow_schema(kind)
    passed = vars(df).get("_passed") if columns and not df.is_cached else None
    if passed:
        source, steps = passed[0], [*passed[1], ([df.columns.index(c) for c in columns], keep, kernel)]
    else:
        source = df.select(*columns) if columns else df
        steps = [(list(range(len(source.columns))), keep, kernel)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            nonlocal held
            made = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
            out.clear()
            held = 0
            return made

        for b in batches:
            arrays = list(b.columns)
            for i in range(b.num_rows):
                for row in yielded([c[i].as_py() for c in arrays], steps):
                    size = weight(row)
                    if out and (len(out) >= most or held + size > most_bytes):
                        yield batch()
                    out.append(row)
                    held += size
            del b, arrays  # before the next batch is read
        if out:
            yield batch()

    made = source.mapInArrow(rows, kind)
    made._passed = (source, steps)
    return made
