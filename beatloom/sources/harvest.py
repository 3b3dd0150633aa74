"""A source of recorded answers: ``spark.read.format("recorded_answers")`` over a folder of JSON documents.

Each harvester of a media site is a function of a request; here its answers lie
as files, one document for each request (``request``, ``kind``, ``response``).
New sites are new kinds: ``operators.responses`` reads what they answered.
Files are read by the executors, one file a partition.

Defined cases: a missing or empty folder gives no rows; a broken document gives a
row with its path in ``request``, kind ``error`` and no response.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAME = "recorded_answers"


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, folder: str, kind: str | None):
        self.folder, self.kind = folder, kind

    def partitions(self) -> list[_File]:
        folder = Path(self.folder.removeprefix("file://"))
        return [_File(str(p)) for p in sorted(folder.glob("*.json"))] if folder.is_dir() else []

    def read(self, partition: _File) -> Iterator[tuple]:
        if not isinstance(partition, _File):
            return
        try:
            document = json.loads(Path(partition.path).read_text(encoding="utf-8"))
            row = (str(document["request"]), str(document["kind"]), json.dumps(document["response"], ensure_ascii=False))
        except (ValueError, KeyError, TypeError):
            row = (partition.path, "error", None)
        if self.kind is None or row[1] == self.kind:
            yield row


class RecordedAnswers(DataSource):
    """Options: ``path`` (a folder that all executors see) and ``kind`` (only answers of that kind)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "request string, kind string, response string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options["path"], self.options.get("kind"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordedAnswers)
