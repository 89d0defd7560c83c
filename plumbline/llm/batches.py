"""Arrow batches in and out of ``mapInArrow`` for the operators that need Python."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows an operator handles at a time. Arrow batches may hold more; texts are not bounded.
SLICE = 256

Columns = dict[str, list]


def map_rows(
    df: DataFrame,
    keep: Sequence[str],
    reads: Sequence[str],
    added: str,
    make: Callable[[], Callable[[Columns], Columns]],
) -> DataFrame:
    """``keep`` as it is, and the ``added`` columns made from ``reads``, slice by slice.

    ``make`` runs once per task and returns the function from the columns read to those added, so
    that tables are loaded and caches start there. Kept columns pass through untouched.
    """
    new = StructType.fromDDL(added)
    kind = StructType([df.schema[c] for c in keep] + new.fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, types = make(), to_arrow_schema(new)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                made = work({c: part[c].to_pylist() for c in reads})
                columns = [part[c] for c in keep] + [pa.array(made[f.name], type=f.type) for f in types]
                yield pa.RecordBatch.from_arrays(columns, names=kind.names)

    return df.select(*dict.fromkeys([*keep, *reads])).mapInArrow(run, kind)
