"""Live boundaries. A generator becomes a streaming source through the Python Data Source API; devices and network protocols are contracts only."""

from __future__ import annotations

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "stream string, sequence long, pts_ns long, value double"


class Tick(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


def tick(n: int, rate: int) -> tuple[str, int, int, float]:
    return ("tick", n, n * 1_000_000_000 // rate, float(n % 100))


class TickReader(DataSourceReader):
    def __init__(self, options: dict):
        self.rows, self.rate, self.parts = (int(options.get(k, d)) for k, d in (("rows", 100), ("rate", 10), ("partitions", 4)))

    def partitions(self) -> list[Tick]:
        step = -(-self.rows // self.parts)
        return [Tick(i, min(self.rows, i + step)) for i in range(0, self.rows, step)]

    def read(self, partition: Tick):
        return (tick(n, self.rate) for n in range(partition.start, partition.end))


class TickStreamReader(DataSourceStreamReader):
    """A reading is a function of its offset, so a batch that is run again gives the same rows."""

    def __init__(self, options: dict):
        self.rate, self.batch, self.at = int(options.get("rate", 10)), int(options.get("batch", 50)), 0

    def initialOffset(self) -> dict:
        return {"n": 0}

    def latestOffset(self) -> dict:
        self.at += self.batch
        return {"n": self.at}

    def partitions(self, start: dict, end: dict) -> list[Tick]:
        return [Tick(start["n"], end["n"])]

    def read(self, partition: Tick):
        return (tick(n, self.rate) for n in range(partition.start, partition.end))

    def commit(self, end: dict) -> None:
        del end


class TickSource(DataSource):
    """spark.dataSource.register(TickSource); spark.read or readStream .format("framewright-tick")."""

    @classmethod
    def name(cls) -> str:
        return "framewright-tick"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TickReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TickStreamReader(self.options)
