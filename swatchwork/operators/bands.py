"""Pictures in bands of rows or columns: pixels are packed where they lie, so that what is shuffled is a few
compressed bytes a row of pixels, and a band meets its neighbours and the bands of other pictures in one group.

A group is bounded by the band's height and the canvas's width; pixels do not go through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from swatchwork.runtime import by_shuffle, spread, united

BAND = 128
_FOLD = 1 << 16  # pixels that a worker gathers before it packs them
_INDEX = ["doc_id", "side", "band"]

#: Columns of one picture in a band, by name; pixels of neighbouring bands within the halo too.
Pixels = dict[str, np.ndarray]


def _packer(side: int, along: str, band: int, halo: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pieces(rows: pa.Table) -> pa.RecordBatch:
        codec, rows = pa.Codec("zstd", 1), rows.combine_chunks()
        doc = rows.column("doc_id").combine_chunks().dictionary_encode()
        code, at = doc.indices.to_numpy(), rows.column(along).to_numpy().astype(np.int64)
        own, every = at // band, np.arange(len(at))
        low, high = every[at % band < halo], every[at % band >= band - halo]
        row, to = np.r_[every, low, high], np.r_[own, own[low] - 1, own[high] + 1]
        order = np.lexsort((row, to, code[row]))
        row, to = row[order], to[order]
        cuts = np.flatnonzero(np.r_[True, (np.diff(code[row]) != 0) | (np.diff(to) != 0)])
        plain = rows.drop_columns(["doc_id"])
        sizes, blobs = [], []
        for a, b in zip(cuts, np.r_[cuts[1:], len(row)]):
            part = plain.take(pa.array(row[a:b])).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema) as out:
                out.write_table(part)
            raw = sink.getvalue()
            sizes.append(raw.size)
            blobs.append(codec.compress(raw, asbytes=True))
        names = doc.dictionary.take(pa.array(code[row[cuts]]))
        return pa.RecordBatch.from_arrays([names, pa.array(np.full(len(cuts), side), pa.int32()), pa.array(to[cuts], pa.int64()), pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())], [*_INDEX, "size", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= _FOLD:
                yield pieces(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield pieces(pa.Table.from_batches(held))

    return run


def packed(pictures: list[DataFrame], halo: int = 0, band: int = BAND, along: str = "y", first: int = 0) -> DataFrame:
    """Pieces ``doc_id, side, band, size, blob`` of the pictures (doc_id, y, x or other columns of numbers), ``side``
    being a picture's place in the list, from ``first`` on. A piece is in each band that it lies in or is within ``halo`` of, which is
    less than ``band``. Rows without a document or a place are left out. All pictures have one type of doc_id."""

    def one(side: int, px: DataFrame) -> DataFrame:
        kind = dict(px.dtypes)["doc_id"]
        rows = px.filter(F.col("doc_id").isNotNull() & F.col(along).isNotNull())
        return rows.mapInArrow(_packer(side, along, band, halo), f"doc_id {kind}, side int, band long, size long, blob binary")

    return reduce(united, [one(k, px) for k, px in enumerate(pictures, first)])


def by_band(pieces: DataFrame, kernel: Callable[..., dict[str, object]], columns: str, facts: DataFrame | None = None) -> DataFrame:
    """What ``kernel`` makes of each band: doc_id and ``columns`` (DDL).

    ``kernel(pictures, band)`` gets the pixels of every side that the band has, by side, and gives arrays by
    column. ``facts``, one row a document, is a third argument where it is given, as a dict; documents without
    one have no rows then.
    """
    kind = dict(pieces.dtypes)["doc_id"]
    ddl = f"doc_id {kind}, {columns}"
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    known = [] if facts is None else [c for c in facts.columns if c != "doc_id"]
    if facts is not None:
        pieces = pieces.join(by_shuffle(facts), "doc_id")

    def run(rows: pa.Table) -> pa.Table:
        codec = pa.Codec("zstd")
        sides: dict[int, list[pa.Table]] = {}
        for side, size, blob in zip(rows.column("side").to_pylist(), rows.column("size").to_pylist(), rows.column("blob").to_pylist()):
            sides.setdefault(side, []).append(pa.ipc.open_stream(codec.decompress(blob, decompressed_size=size)).read_all())
        pictures = {side: {c: v.to_numpy() for c, v in zip(t.column_names, t.columns)} for side, t in ((s, pa.concat_tables(ts)) for s, ts in sides.items())}
        extra = [{c: rows.column(c)[0].as_py() for c in known}] if known else []
        found = kernel(pictures, rows.column("band")[0].as_py(), *extra)
        n = len(next(iter(found.values())))
        doc = rows.column("doc_id").slice(0, 1).combine_chunks().take(pa.array(np.zeros(n, np.int64)))
        arrays = [doc, *(pa.array(found[f.name], from_pandas=True).cast(f.type) for f in list(schema)[1:])]
        return pa.Table.from_arrays(arrays, schema=schema)

    return spread(pieces, "doc_id", "band").groupBy("doc_id", "band").applyInArrow(run, ddl)


class Grid:
    """The plane that the given pixels lie in, with ``pad`` empty places around them."""

    def __init__(self, *pixels: Pixels | None, pad: int = 1):
        ys, xs = (np.concatenate([p[c] for p in pixels if p is not None]) for c in "yx")
        self.y, self.x, self.pad = int(ys.min()) - pad, int(xs.min()) - pad, pad
        self.shape = (int(ys.max()) - self.y + pad + 1, int(xs.max()) - self.x + pad + 1)

    def at(self, p: Pixels) -> tuple[np.ndarray, np.ndarray]:
        return p["y"].astype(np.int64) - self.y, p["x"].astype(np.int64) - self.x

    def mask(self, p: Pixels | None, where: np.ndarray | None = None) -> np.ndarray:
        """True where the picture has a pixel (of those ``where``)."""
        out = np.zeros(self.shape, bool)
        if p is not None:
            y, x = self.at(p)
            out[(y, x) if where is None else (y[where], x[where])] = True
        return out

    def plane(self, p: Pixels | None, values: np.ndarray | str, empty: float = 0) -> np.ndarray:
        """The picture's ``values``, a column or one number a pixel."""
        if p is None:
            return np.full(self.shape, empty)
        values = p[values] if isinstance(values, str) else values
        out = np.full(self.shape, empty, values.dtype)
        out[self.at(p)] = values
        return out

    def rows_of(self, band: int, height: int = BAND) -> np.ndarray:
        """Which rows of the plane are the band's own, as a column."""
        return ((np.arange(self.shape[0]) + self.y) // height == band)[:, None]


def moved(plane: np.ndarray, dy: int, dx: int, empty: float = 0) -> np.ndarray:
    """What the plane has ``dy, dx`` further on; ``empty`` where that is beyond it."""
    out = np.full_like(plane, empty)
    h, w = plane.shape
    if abs(dy) < h and abs(dx) < w:
        out[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)] = plane[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)]
    return out


def eroded(mask: np.ndarray, offsets: list[tuple[int, int]]) -> np.ndarray:
    out = np.ones_like(mask)
    for dy, dx in offsets:
        out &= moved(mask, dy, dx, False)
    return out


def summed(plane: np.ndarray, offsets: list[tuple[int, int]]) -> np.ndarray:
    return sum(moved(plane, dy, dx) for dy, dx in offsets)


def filled(shape: tuple[int, int], y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> np.ndarray:
    """The mask of runs."""
    edge = np.zeros((shape[0], shape[1] + 1), np.int32)
    np.add.at(edge, (y, x0), 1)
    np.add.at(edge, (y, x1 + 1), -1)
    return np.cumsum(edge, axis=1)[:, :-1] > 0


def runs(mask: np.ndarray, grid: Grid) -> Pixels:
    """Maximal runs ``y, x0, x1`` of the mask's rows."""
    edge = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    y, x0 = np.nonzero(edge == 1)
    _, x1 = np.nonzero(edge == -1)
    return {"y": y + grid.y, "x0": x0 + grid.x, "x1": x1 - 1 + grid.x}
