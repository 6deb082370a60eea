"""Functions on Arrow batches that can be declared before there is a session."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

#: Bytes of a batch, as Arrow has it, that a function gets at a time: what it makes of them is what a worker holds beside the batch.
PIECE_BYTES = 1 << 20


def by_pieces(f: Callable[..., pa.Array]) -> Callable[..., pa.Array]:
    """f on pieces of its arrays of about PIECE_BYTES, one after the other; f must treat each row on its own."""

    @wraps(f)
    def on_arrays(*arrays: pa.Array) -> pa.Array:
        rows, size = len(arrays[0]), sum(a.nbytes for a in arrays)
        step = max(1, rows * PIECE_BYTES // max(1, size))
        made = [f(*[a.slice(k, step) for a in arrays]) for k in range(0, max(rows, 1), step)]
        return pa.concat_arrays([c for m in made for c in (m.chunks if isinstance(m, pa.ChunkedArray) else [m])]) if len(made) > 1 else made[0]

    return on_arrays


def arrow(kind: str) -> Callable[[Callable], Callable[..., Column]]:
    """Declares a pandas function of rows with a result of the given type; it is made when it is put on columns."""

    def declare(f: Callable) -> Callable[..., Column]:
        @wraps(f)
        def on_columns(*columns: Column | str) -> Column:
            own = to_arrow_type(DataType.fromDDL(kind))

            def made(*arrays: pa.Array) -> pa.Array:
                out = f(*[a.to_pandas(maps_as_pydicts="strict") for a in arrays])
                if isinstance(out, pd.DataFrame):
                    return pa.StructArray.from_arrays([pa.Array.from_pandas(out[x.name], type=x.type) for x in own], fields=list(own))
                return pa.Array.from_pandas(out, type=own)

            made.__name__ = f.__name__
            return F.arrow_udf(by_pieces(made), kind)(*columns)

        return on_columns

    return declare


def batch(kind: str) -> Callable[[Callable], Callable[..., Column]]:
    """As arrow(), for a function of Arrow arrays: nothing becomes a Python object."""

    def declare(f: Callable) -> Callable[..., Column]:
        @wraps(f)
        def on_columns(*columns: Column | str) -> Column:
            return F.arrow_udf(by_pieces(f), kind)(*columns)

        return on_columns

    return declare
