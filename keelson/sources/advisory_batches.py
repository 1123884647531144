"""Answers to batches of advisory questions as a data source: a partition is a few batches.

Questions are put to the service in batches, and an answer belongs to the question at its place, so
an answer of another length than its batch is worth nothing and fails the read. The source reads
staged files: each batch is a folder ``batch=<n>`` under ``questions`` and one under ``answers``, with one
JSON document each. Paths may be of any file system that pyarrow opens.

    spark.dataSource.register(AdvisoryBatches)
    spark.read.format("advisory_batches").load(root)
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.advisories import osv_ecosystem
from ..operators import enrich

SCHEMA = "batch long, ecosystem string, name string, version string, osv_id string"


class AnswerMismatch(ValueError):
    """An answer that cannot be laid beside its questions."""


def paired(batch: int, questions: dict, answers: dict) -> Iterator[tuple]:
    """A row for every advisory that a question got, and one without an id for a question that got none."""
    asked, told = questions["queries"], answers.get("results") if isinstance(answers, dict) else None
    if not isinstance(told, list):
        raise AnswerMismatch(f"batch {batch}: no list of results")
    if len(asked) != len(told):
        raise AnswerMismatch(f"batch {batch}: {len(told)} results for {len(asked)} questions")
    for question, result in zip(asked, told):
        found = result.get("vulns") if isinstance(result, dict) else None
        ids = [v["id"] for v in found or () if isinstance(v, dict) and isinstance(v.get("id"), str)]
        package = question["package"]
        for osv_id in ids or [None]:
            yield batch, package["ecosystem"], package["name"], question["version"], osv_id


@dataclass
class Batches(InputPartition):
    """(number, files of questions, files of answers) of each batch."""

    listed: list[tuple[int, list[str], list[str]]]


class BatchReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.root = options["path"].rstrip("/")
        self.per_task = int(options.get("batchesPerTask", "16"))

    def _filesystem(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root if ":" in self.root else f"file://{self.root}")

    def partitions(self) -> list[Batches]:
        """From the names of files alone; a batch without an answer fails here."""
        from pyarrow import fs

        files, base = self._filesystem()

        def listed(part: str) -> dict[int, list[str]]:
            found: dict[int, list[str]] = {}
            for entry in files.get_file_info(fs.FileSelector(f"{base}/{part}", recursive=True)):
                name = entry.path.rsplit("/", 2)
                if entry.type == fs.FileType.File and not name[2].startswith(("_", ".")):
                    found.setdefault(int(name[1].removeprefix("batch=")), []).append(entry.path)
            return found

        questions, answers = listed("questions"), listed("answers")
        if lost := sorted(set(questions) - set(answers)):
            raise AnswerMismatch(f"{len(lost)} batches have no answer, {lost[0]} the first")
        every = [(n, sorted(questions[n]), sorted(answers[n])) for n in sorted(questions)]
        return [Batches(every[i : i + self.per_task]) for i in range(0, len(every), self.per_task)]

    def read(self, partition: Batches) -> Iterator[tuple]:
        files, _ = self._filesystem()

        def document(number: int, names: list[str]):
            text = b"".join(files.open_input_stream(name).read() for name in names)
            try:
                return json.loads(text)
            except ValueError as error:
                raise AnswerMismatch(f"batch {number}: {error}") from error

        for number, asked, told in partition.listed:
            yield from paired(number, document(number, asked), document(number, told))


class AdvisoryBatches(DataSource):
    @classmethod
    def name(cls) -> str:
        return "advisory_batches"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BatchReader:
        return BatchReader(self.options)


def questions(targets: DataFrame, size: int = enrich.BATCH) -> DataFrame:
    """batch and document: the questions of each batch, ``size`` at most, in a fixed order. ``targets``: ecosystem, name, version."""
    asked = enrich.batches(targets.where("version IS NOT NULL").distinct(), "ecosystem", "name", "version", size=size)
    query = F.struct(F.struct(F.col("name"), osv_ecosystem(F.col("ecosystem")).alias("ecosystem")).alias("package"), F.col("version"))
    return asked.groupBy("batch").agg(F.to_json(F.struct(F.sort_array(F.collect_list(query)).alias("queries"))).alias("document"))


def stage(documents: DataFrame, root: str, part: str) -> None:
    """Writes one file a batch; ``documents``: batch, document."""
    documents.select("batch", "document").repartition("batch").write.partitionBy("batch").text(f"{root}/{part}")


def advisories(occurrences: DataFrame, answers: DataFrame, documents: DataFrame, *key: str) -> DataFrame:
    """Occurrences with the advisories of their package and version: key, osv_id and the advisory's document.

    ``documents``: osv_id, document, one read of each id whatever the number of packages that share it; an
    id without a document is dropped. ``answers`` as the source gives them.
    """
    spelled = occurrences.withColumn("__e", osv_ecosystem(F.col("ecosystem")))
    found = answers.where("osv_id IS NOT NULL").select(F.col("ecosystem").alias("__e"), "name", F.col("version").alias("resolved_version"), "osv_id").distinct()
    read = documents.join(found.select("osv_id").distinct(), "osv_id", "left_semi").where("document IS NOT NULL")
    once = read.groupBy("osv_id").agg(F.min("document").alias("document"))
    return spelled.join(found, ["__e", "name", "resolved_version"]).join(once, "osv_id").select(*key, "osv_id", "document")
