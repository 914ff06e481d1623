"""A sink of whole files with a commit protocol, as a Python data source.

Each task writes its files (output_name, content) and a list of them into a staging folder of its attempt, and removes that folder if it fails. When all tasks are
done, the driver moves each attempt's files to their names and its list to `_status`; if the job fails, it removes the staging folder. So a failing task leaves nothing, an attempt that ran beside another one leaves
nothing either, and the rows of `_status` say what is there. The driver holds one task's list at a time.

Files of one name: the list that is moved last wins, so callers give each name once. Null contents are empty files; a null name is refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

STATUS = "doc_id string, output_path string, n_bytes bigint"
MOVERS = 16


@dataclass
class Staged(WriterCommitMessage):
    folder: str


class FileWriter(DataSourceWriter):
    def __init__(self, folder: str, job: str):
        self.folder, self.job = folder.rstrip("/"), job
        self.staging = f"{self.folder}/_staging/{job}"

    def write(self, iterator: Iterator) -> Staged:
        system, own = fs.FileSystem.from_uri(f"{self.staging}/{uuid.uuid4().hex}")
        system.create_dir(own, recursive=True)
        try:
            with system.open_output_stream(f"{own}/list") as listed:
                for k, row in enumerate(iterator):
                    if not row["output_name"]:
                        raise ValueError(f"a file without a name: {row['doc_id']}")
                    data = bytes(row["content"] or b"")
                    with system.open_output_stream(f"{own}/{k}") as f:
                        f.write(data)
                    listed.write((json.dumps({"doc_id": row["doc_id"], "output_path": f"{self.folder}/{row['output_name']}", "n_bytes": len(data)}) + "\n").encode())
        except BaseException:
            system.delete_dir(own)
            raise
        return Staged(own)

    def commit(self, messages: list[Staged | None]) -> None:
        system, root = fs.FileSystem.from_uri(self.folder)
        system.create_dir(f"{root}/_status/{self.job}", recursive=True)
        with ThreadPoolExecutor(MOVERS) as pool:
            for m in messages:
                if m is None:
                    continue
                with system.open_input_stream(f"{m.folder}/list") as f:
                    names = [json.loads(line)["output_path"].removeprefix(f"{self.folder}/") for line in f.read().splitlines()]
                list(pool.map(lambda x, m=m: system.move(f"{m.folder}/{x[0]}", f"{root}/{x[1]}"), enumerate(names)))
                system.move(f"{m.folder}/list", f"{root}/_status/{self.job}/{m.folder.rpartition('/')[2]}.json")
        self._clear()

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, path = fs.FileSystem.from_uri(self.staging)
        if system.get_file_info(path).type == fs.FileType.Directory:
            system.delete_dir(path)


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quire_files"

    def schema(self) -> str:
        return "doc_id string, output_name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"], self.options.get("job") or uuid.uuid4().hex)


def save(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, output_name, content -> the files in a folder (a URI that driver and executors can write), and doc_id, output_path, n_bytes of those that this commit has left."""
    spark, job = files.sparkSession, uuid.uuid4().hex
    spark.dataSource.register(FileSink)
    files.select("doc_id", "output_name", "content").write.format("quire_files").option("path", folder).option("job", job).mode("append").save()
    return status(spark, folder, job)


def status(spark: SparkSession, folder: str, job: str = "") -> DataFrame:
    """doc_id, output_path, n_bytes of the files that commits, or one of them, have left in a folder."""
    return spark.read.schema(STATUS).option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").json(f"{folder.rstrip('/')}/_status/{job}")
