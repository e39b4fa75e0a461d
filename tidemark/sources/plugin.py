"""A Python source as a Spark data source: an object that starts into a sink, read as a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tidemark.session import ship


class Sink:
    """What a source emits: rows as dicts, lists of them, or Arrow batches and tables."""

    def __init__(self):
        self.emitted: list = []

    def emit(self, values) -> None:
        self.emitted.append(values)


class _Part(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)
        self.number = number


class _Reader(DataSourceReader):
    def __init__(self, start: Callable, parts: int, schema: pa.Schema):
        self.start, self.parts, self.schema = start, parts, schema

    def partitions(self):
        return [_Part(i) for i in range(self.parts)]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        sink = Sink()
        for _ in self.start(sink, partition.number, self.parts) or ():  # a generator: what it has emitted so far goes on
            yield from self._out(sink)
        yield from self._out(sink)

    def _out(self, sink: Sink) -> Iterator[pa.RecordBatch]:
        emitted, sink.emitted = sink.emitted, []
        for values in emitted:
            if isinstance(values, pa.RecordBatch):
                yield values
            elif isinstance(values, pa.Table):
                yield from values.to_batches()
            else:
                yield pa.RecordBatch.from_pylist([values] if isinstance(values, dict) else list(values), self.schema)


def read_source(spark: SparkSession, start: Callable, schema: StructType, parts: int = 1, name: str = "python_source") -> DataFrame:
    """Rows that ``start(sink, part, parts)`` emits, for every part of ``parts``, on the executors. As a generator it may
    yield to hand on what it has emitted; a part that is lost is started anew."""
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(spark)
    shape, arrow = schema, to_arrow_schema(schema)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self):
            return shape

        def reader(self, schema):
            return _Reader(start, parts, arrow)

    spark.dataSource.register(Source)
    return spark.read.format(name).load()
