"""Images in Arrow batches: pages are rows that Spark deals out; a task works off its batch with numpy, without Python objects
for pixels. Images of one size are stacked, so that small pages share their numpy calls."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Pixels of a stack at most, but for a larger single image.
STACK_PIXELS = 2_000_000
#: The same for operators with many arrays of a stack's size.
PART_PIXELS = 500_000

#: What a stack (pages, height, width) becomes: an array of the same shape, or one for each field of a struct.
Stencil = Callable[[np.ndarray], np.ndarray | dict[str, np.ndarray]]


def _images(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column, and where each row's begin and end."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy(zero_copy_only=False)


def _stacks(heights: list, widths: list, known: np.ndarray, most: int = STACK_PIXELS) -> Iterator[np.ndarray]:
    """Rows of one size, in groups of bounded size."""
    by_size: dict[tuple[int, int], list[int]] = {}
    for i in np.flatnonzero(known):
        by_size.setdefault((heights[i], widths[i]), []).append(int(i))
    for (h, w), rows in by_size.items():
        n = max(1, most // max(1, h * w))
        for k in range(0, len(rows), n):
            yield np.array(rows[k : k + n])


def map_images(rasters: DataFrame, of: Stencil, kind: str = "double", name: str = "g", most: int = STACK_PIXELS) -> DataFrame:
    """(page_id, width, height, name) of rasters (page_id, width, height, g): the array that of() makes of each page's image.

    kind: the elements' type; a struct's fields are those of of()'s result. A page without an array stays without. most: a stack's pixels.
    """
    arrow = {"double": pa.float64(), "int": pa.int32()}.get(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offsets = _images(batch.column(3))
            widths, heights = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            known = batch.column(3).is_valid().to_numpy(zero_copy_only=False)
            made: dict[str, np.ndarray] = {}
            total = int(offsets[-1])
            for rows in _stacks(heights, widths, known, most):
                h, w = heights[rows[0]], widths[rows[0]]
                at = offsets[rows][:, None] + np.arange(h * w)[None]
                found = of(values[at].reshape(len(rows), h, w).astype(float))
                for field, result in (found if isinstance(found, dict) else {"": found}).items():
                    made.setdefault(field, np.zeros(total))[at] = result.reshape(len(rows), h * w)
            flat = {f: pa.array(v.astype(arrow.to_pandas_dtype() if arrow else float)) for f, v in made.items()}
            if arrow:
                inner = flat.get("", pa.array([], arrow))
            else:
                fields = [c.split(":")[0] for c in kind.removeprefix("struct<").removesuffix(">").split(",")]
                inner = pa.StructArray.from_arrays([flat.get(f, pa.array([], pa.float64())) for f in fields], names=fields)
            starts = pa.array(offsets, pa.int32()) if known.all() else pa.array([o if ok else None for o, ok in zip(offsets.tolist(), known, strict=False)] + [total], pa.int32())
            lists = pa.ListArray.from_arrays(starts, inner)
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), lists], names=["page_id", "width", "height", name])

    page = rasters.schema["page_id"].dataType.simpleString()
    return rasters.select("page_id", "width", "height", "g").mapInArrow(run, f"page_id {page}, width int, height int, {name} array<{kind}>")


def per_page(rasters: DataFrame, of: Callable[[np.ndarray], list], schema: str) -> DataFrame:
    """Rows that of() makes from each page's image (a float array, rows first), with the page's id in front.

    of() returns one array or list for each column of schema. A page without an array gives no rows.
    """
    names = [c.strip().split()[0] for c in schema.split(",")]
    kinds = [{"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}[c.strip().split()[1]] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offsets = _images(batch.column(3))
            widths, heights = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            pages, found = [], []
            for i, (w, h) in enumerate(zip(widths, heights, strict=True)):
                if batch.column(3)[i].is_valid:
                    columns = of(values[offsets[i] : offsets[i + 1]].astype(float).reshape(h, w))
                    pages.append(np.full(len(columns[0]), i))
                    found.append(columns)
            if found:
                taken = batch.column(0).take(pa.array(np.concatenate(pages), pa.int64()))
                yield pa.record_batch([taken, *[pa.array(np.concatenate([np.asarray(c[k]) for c in found])).cast(t) for k, t in enumerate(kinds)]], names=["page_id", *names])

    page = rasters.schema["page_id"].dataType.simpleString()
    return rasters.select("page_id", "width", "height", "g").mapInArrow(run, f"page_id {page}, {schema}")


def per_stack(rasters: DataFrame, of: Callable[[np.ndarray], tuple], schema: str, most: int = PART_PIXELS) -> DataFrame:
    """Rows that of() makes from stacks of pages, with the page's id in front: as per_page, but pages of one size share the calls.

    of() returns the number of each row's page in the stack, and an array for each column of schema. most: a stack's pixels.
    """
    names = [c.strip().split()[0] for c in schema.split(",")]
    kinds = [{"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}[c.strip().split()[1]] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offsets = _images(batch.column(3))
            heights, widths = batch.column(2).to_pylist(), batch.column(1).to_pylist()
            for rows in _stacks(heights, widths, batch.column(3).is_valid().to_numpy(zero_copy_only=False), most):
                h, w = heights[rows[0]], widths[rows[0]]
                at = offsets[rows][:, None] + np.arange(h * w)[None]
                page, *columns = of(values[at].reshape(len(rows), h, w).astype(float))
                if len(page):
                    taken = batch.column(0).take(pa.array(rows[page]))
                    yield pa.record_batch([taken, *[pa.array(c).cast(t) for c, t in zip(columns, kinds, strict=True)]], names=["page_id", *names])

    page = rasters.schema["page_id"].dataType.simpleString()
    return rasters.select("page_id", "width", "height", "g").mapInArrow(run, f"page_id {page}, {schema}")
