"""Model folders as a data source: ``spark.read.format("model_folders")`` and ``df.write.format("model_folders")``.

A run is a folder with one folder a model: completions.jsonl (a file, or a folder of parts) and, once its figures are
made, metrics.json. Reading makes one partition a part file; a filter on model_tag is pushed down to the listing, so
that other folders aren't opened; folders without metrics.json are passed over. Writing lets every task write parts of
its own under a name of the job, and the commit moves them into place; a job that fails leaves nothing. Paths are any
URL that pyarrow's file systems know, and plain local or shared ones.

Options: path; tags, a comma-separated list of folders (all by default); unfinished=true reads folders without
metrics.json too.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "model_tag string, occupation string, stereotype string, split string, template_id int, template_split string, sample_id long, completion string, truncated boolean, n_new_tokens long, reason string, usable boolean"
TAG, TEXTS, METRICS = "model_tag", "completions.jsonl", "metrics.json"
#: Columns that are made when reading, and not stored.
MADE = (TAG, "usable")


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path.rstrip("/"))


def _listed(store, path: str, folders: bool) -> list[str]:
    from pyarrow import fs

    kind = fs.FileType.Directory if folders else fs.FileType.File
    found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted(f.path for f in found if f.type == kind and not f.base_name.startswith(("_", ".")))


@dataclass
class Part(InputPartition):
    tag: str
    file: str


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # tag and temporary file


class FolderReader(DataSourceReader):
    def __init__(self, path: str, fields: list[str], tags: list[str] | None, unfinished: bool) -> None:
        self.path, self.fields, self.tags, self.unfinished = path, fields, tags, unfinished

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality and membership of model_tag choose the folders; what else there is goes back to Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == (TAG,):
                own = [f.value] if isinstance(f, EqualTo) else list(f.value)
                self.tags = own if self.tags is None else [t for t in self.tags if t in own]
            else:
                yield f

    def partitions(self) -> list[Part]:
        from pyarrow import fs

        store, root = _store(self.path)
        out = []
        for folder in _listed(store, root, True):
            tag = folder.rsplit("/", 1)[-1]
            if self.tags is not None and tag not in self.tags:
                continue
            if not self.unfinished and store.get_file_info(f"{folder}/{METRICS}").type == fs.FileType.NotFound:
                continue
            texts = store.get_file_info(f"{folder}/{TEXTS}")
            if texts.type == fs.FileType.File:
                out.append(Part(tag, texts.path))
            elif texts.type == fs.FileType.Directory:
                out += [Part(tag, f) for f in _listed(store, texts.path, False)]
        return out or [Part("", "")]

    def read(self, partition: Part) -> Iterator[tuple]:
        if not partition.file:
            return
        store, _ = _store(self.path)
        with store.open_input_stream(partition.file) as raw:
            rest = b""
            while True:
                block = raw.read(1 << 20)
                *lines, rest = (rest + block).split(b"\n")
                if not block:
                    lines = [rest]
                for line in lines:
                    if line.strip():
                        yield self._row(partition.tag, json.loads(line))
                if not block:
                    return

    def _row(self, tag: str, held: dict) -> tuple:
        made = held | {TAG: tag, "usable": held.get("reason") is None}
        return tuple(made.get(f) for f in self.fields)


class FolderWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex[:12]

    def write(self, rows: Iterator[Row]) -> Written:
        store, root = _store(self.path)
        out, task = {}, uuid.uuid4().hex[:12]
        try:
            for r in rows:
                held = r.asDict(recursive=True)
                tag = held.pop(TAG)
                if not tag or "/" in tag or tag.startswith(("_", ".")):
                    raise ValueError(f"not a folder's name: {tag!r}")
                if tag not in out:
                    folder = f"{root}/_job-{self.job}/{tag}"
                    store.create_dir(folder)
                    out[tag] = (f"{folder}/part-{task}.jsonl", store.open_output_stream(f"{folder}/part-{task}.jsonl"))
                text = json.dumps({k: v for k, v in held.items() if k not in MADE and v is not None}, ensure_ascii=False)
                out[tag][1].write(text.encode() + b"\n")
        finally:
            for _, stream in out.values():
                stream.close()
        return Written([(tag, file) for tag, (file, _) in out.items()])

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, root = _store(self.path)
        files = [f for m in messages if m for f in m.files]
        for tag in sorted({t for t, _ in files}):
            there = store.get_file_info(f"{root}/{tag}/{TEXTS}")
            if self.overwrite and there.type == fs.FileType.Directory:
                store.delete_dir(there.path)
            store.create_dir(f"{root}/{tag}/{TEXTS}")
        for tag, file in files:
            store.move(file, f"{root}/{tag}/{TEXTS}/{file.rsplit('/', 1)[-1]}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, root = _store(self.path)
        if store.get_file_info(f"{root}/_job-{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/_job-{self.job}")


class ModelFolders(DataSource):
    @classmethod
    def name(cls) -> str:
        return "model_folders"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FolderReader:
        tags = self.options.get("tags")
        return FolderReader(self.options["path"], schema.names, tags.split(",") if tags else None, self.options.get("unfinished", "false") == "true")

    def writer(self, schema: StructType, overwrite: bool) -> FolderWriter:
        if TAG not in schema.names:
            raise ValueError(f"a column {TAG} names the folder of each row")
        return FolderWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ModelFolders)
