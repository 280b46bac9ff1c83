"""A sink that writes a corpus as folders of files: ``<work>/manifest.json`` and ``<work>/chapters/<chapter>.json``.

Tasks write below a folder of the job's own, each file under a name of the task's own that is then changed to the file's, so a task that
is run again replaces what its forerunner left. Only when all tasks are done are the works' folders moved to their places, one
rename a work; a job that fails leaves the corpus as it was.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "quire_corpus"
COLUMNS = ("work_id", "chapter_id", "json")


@dataclass
class Written(WriterCommitMessage):
    """How many files a task has written."""

    files: int


def opened(folder: str):
    """The file system of ``folder`` and the path within it: any that pyarrow knows, or a mounted one."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else os.path.abspath(folder))


def safe(name: str | None, what: str) -> str:
    """``name`` if it can be a file's."""
    if not name or "/" in name or "\\" in name or "\0" in name or name.startswith("."):
        raise ValueError(f"{what} {name!r} can't be the name of a file")
    return name


class CorpusWriter(DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool) -> None:
        self.folder, self.overwrite, self.staging = folder.rstrip("/"), overwrite, f".staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        files, base = opened(self.folder)
        made: set[str] = set()
        count = 0
        for row in iterator:
            work = safe(row["work_id"], "work")
            name = "manifest.json" if row["chapter_id"] is None else f"chapters/{safe(row['chapter_id'], 'chapter')}.json"
            path = f"{base}/{self.staging}/{work}/{name}"
            where = path.rpartition("/")[0]
            if where not in made:
                files.create_dir(where, recursive=True)
                made.add(where)
            mine = f"{where}/.{uuid.uuid4().hex}"
            with files.open_output_stream(mine) as out:
                out.write(row["json"].encode())
            files.move(mine, path)
            count += 1
        return Written(count)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        files, base = opened(self.folder)
        staging = f"{base}/{self.staging}"
        works = [f.base_name for f in files.get_file_info(fs.FileSelector(staging, allow_not_found=True))]
        there = [w for w in works if files.get_file_info(f"{base}/{w}").type != fs.FileType.NotFound]
        if there and not self.overwrite:
            self.abort(messages)
            raise ValueError(f"works that are there already: {', '.join(sorted(there)[:5])}")
        for work in works:
            if work in there:
                files.move(f"{base}/{work}", f"{staging}/.old-{work}")
            files.move(f"{staging}/{work}", f"{base}/{work}")
        if works:
            files.delete_dir(staging)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        files, base = opened(self.folder)
        if files.get_file_info(f"{base}/{self.staging}").type != fs.FileType.NotFound:
            files.delete_dir(f"{base}/{self.staging}")


class CorpusFolders(DataSource):
    """``df.write.format("quire_corpus").mode("overwrite").save(folder)`` for rows of ``COLUMNS``.

    A null ``chapter_id`` is the work's manifest. With ``overwrite`` each work that is written replaces its folder, others stay; without, a work that is
    there already is an error. Of rows with one work and chapter one file is left. A null, empty or path-like work or chapter
    id is an error, and nothing is changed.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ", ".join(f"{c} string" for c in COLUMNS)

    def writer(self, schema: StructType, overwrite: bool) -> CorpusWriter:
        return CorpusWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CorpusFolders)
