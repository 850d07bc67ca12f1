"""Row-wise operators: a function of a slice of texts, mapped over Arrow
batches. No shuffle, no state between slices, so any lost task just reruns."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textarrays import SLICE_BYTES, slices


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def map_texts(docs: DataFrame, make: Callable[[], Callable[[pa.Array], list]], fields: list[tuple[str, str]],
              *, id_col: str = "doc_id", text_col: str = "text", carry: str | None = None, new_text: str | None = None,
              most: int = SLICE_BYTES) -> DataFrame:
    """(id, *fields) for every row of docs. ``make`` is called once in a task
    and returns the function from a slice's text column to one Arrow array per
    field. ``carry`` names a struct column that keeps all columns of docs; the
    text then travels once, inside it, and the field ``new_text``, if given,
    takes its place there instead of becoming a column."""
    text = F.col(quoted(text_col)).cast("string")
    if carry:
        row = F.struct(*[text.alias(c) if c == text_col else F.col(quoted(c)) for c in docs.columns])
        src = docs.select(F.col(quoted(id_col)).alias("id"), row.alias("row"))
        place = docs.columns.index(text_col)
    else:
        src = docs.select(F.col(quoted(id_col)).alias("id"), text.alias("text"))
    schema = T.StructType([T.StructField(id_col, src.schema["id"].dataType)])
    if carry:
        schema.add(carry, src.schema["row"].dataType)
    order = [n for n, _ in fields]
    replaced = order.index(new_text) if new_text else None
    for f in T.DataType.fromDDL(", ".join(f"{quoted(n)} {t}" for n, t in fields if n != new_text)):
        schema.add(f)
    names = [f.name for f in schema]

    def run(batches):
        fn = make()
        for batch in batches:
            whole = batch.column("row").field(place) if carry else batch.column("text")
            for a, b in slices(whole, most):
                made = fn(whole.slice(a, b - a))
                first = [batch.column("id").slice(a, b - a)]
                if carry:
                    kept = batch.column("row").slice(a, b - a)
                    if replaced is not None:
                        parts = kept.flatten()
                        parts[place] = made.pop(replaced)
                        kept = pa.StructArray.from_arrays(parts, fields=list(kept.type))
                    first.append(kept)
                yield pa.RecordBatch.from_arrays(first + made, names)

    return src.mapInArrow(run, schema)


def carried(rows: DataFrame, like: DataFrame, *, row: str = "row", text_col: str = "text", count_col: str = "n_chars") -> DataFrame:
    """The carried rows as they are in ``like``: its columns and types, with
    the text's count of characters anew where there is such a column."""
    def column(c: str):
        if c == count_col:
            return F.length(F.col(f"{quoted(row)}.{quoted(text_col)}")).cast(like.schema[c].dataType)
        return F.col(f"{quoted(row)}.{quoted(c)}")
    return rows.select(*[column(c).alias(c) for c in like.columns])
