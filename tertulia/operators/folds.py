"""Sequential folds over ordered rows: state that no window expresses.

Rows of an entity are sorted within a task and streamed through a small state, so memory does
not grow with the entity. A fold is sequential by its rule; an entity is one task's stream.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegralType

BATCH_ROWS = 10_000
#: Integer entities that differ only in so many low bits are one group: small entities share its overhead.
BLOCK_BITS = 4
BLOCK = "__block"


def block_of(df: DataFrame, entity: str) -> Column:
    """The group of an entity: several neighbouring integers, else the entity itself."""
    return F.shiftright(entity, BLOCK_BITS) if isinstance(df.schema[entity].dataType, IntegralType) else F.col(entity)


def streamed(df: DataFrame, columns: list[str], schema: str, fold: Callable[[], tuple[Callable, Callable]], entity: str = "interview_id", order: list[str] = ["pos"]) -> DataFrame:  # noqa: B006
    """Rows that a fold gives: fold() makes, for each entity, step(*row) and finish(), both of which give lists of output tuples.

    columns are passed to step in order, the entity first; output tuples have the entity and what
    schema says.
    The groups are declared to the planner, so no plan, however it is changed while it runs, may
    cut an entity apart; rows that arrive out of order raise RuntimeError.
    """
    schema = f"`{entity}` {df.schema[entity].dataType.simpleString()}, {schema}"
    arrow = _arrow_schema(schema, df.sparkSession)
    places = [columns.index(c) + 1 for c in order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, step, finish, out, started = None, None, None, None, [], False
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns[1:])):
                key = [(row[k] is not None, row[k]) for k in places]
                if not started or row[0] != now:
                    if started:
                        out += finish()
                    now, started = row[0], True
                    step, finish = fold()
                elif key < last:
                    raise RuntimeError(f"rows of {entity} {now} out of order: {last}, then {key}")
                last = key
                out += step(*row)
                if len(out) >= BATCH_ROWS:
                    yield _batch(out, arrow)
                    out = []
        if started:
            out += finish()
        yield _batch(out, arrow)

    ready = df.select(block_of(df, entity).alias(BLOCK), entity, *columns)
    return ready.repartition(BLOCK).sortWithinPartitions(BLOCK, entity, *order).groupBy(BLOCK).applyInArrow(_typed(run), schema)


def _typed(run: Callable) -> Callable:
    """run with the type hints by which batches are streamed, not collected, for each group."""
    run.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _arrow_schema(schema: str, spark) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))
