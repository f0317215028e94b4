"""Documents as files: one file each, under its name, visible only when the whole write has succeeded."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .export import export_subtitles, safe_names


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    n: int


class _Writer(DataSourceWriter):
    """Tasks write into folders of their own, attempt by attempt; the driver moves what the successful ones wrote."""

    def __init__(self, path: str, extension: str, replace: bool):
        self.path, self.extension, self.replace = path.rstrip("/"), extension, replace
        self.pending = f"{self.path}/_pending-{uuid.uuid4().hex}"

    def _at(self, uri: str) -> tuple[object, str]:
        from pyarrow import fs

        return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)

    def write(self, iterator: Iterator[Row]) -> _Written:
        files, folder = self._at(f"{self.pending}/{uuid.uuid4().hex}")
        n = 0
        for row in iterator:
            if n == 0:
                files.create_dir(folder, recursive=True)
            name = f"{row['file_name']}.{self.extension}"
            if posixpath.basename(name) != name or row["document"] is None:
                raise ValueError(f"no file can be made of {name!r}")
            with files.open_output_stream(f"{folder}/{name}") as out:
                out.write(row["document"].encode("utf-8"))
            n += 1
        return _Written(folder if n else "", n)

    def commit(self, messages: list[_Written | None]) -> None:
        from pyarrow import fs

        files, path = self._at(self.path)
        moves = []
        for m in messages:
            if m is not None and m.n:
                found = files.get_file_info(fs.FileSelector(m.folder))
                moves += [(f.path, f"{path}/{f.base_name}") for f in found]
        targets = [to for _, to in moves]
        taken = [f.path for f in files.get_file_info(targets) if f.type != fs.FileType.NotFound] if targets and not self.replace else []
        if len(set(targets)) < len(targets) or taken:
            self.abort(messages)
            raise FileExistsError(f"names that are taken: {taken[:3] or 'two documents of one name'}")
        files.create_dir(path, recursive=True)
        for source, to in moves:
            files.move(source, to)
        self._drop()

    def abort(self, messages: list[_Written | None]) -> None:
        self._drop()

    def _drop(self) -> None:
        from pyarrow import fs

        files, folder = self._at(self.pending)
        if files.get_file_info(folder).type == fs.FileType.Directory:
            files.delete_dir(folder)


class DocumentFiles(DataSource):
    """df.write.format("document_files").option("extension", "srt").mode("append").save(path), of file_name and document, strings.

    A task that fails, or a job that is stopped by an error, leaves no file. In append mode a name that is taken is an error;
    overwrite replaces files of the same names and leaves others. The folder must be one that driver and executors share and
    that pyarrow reaches. The driver moves files one by one, as Spark's own commit does, and holds their names.
    """

    @classmethod
    def name(cls) -> str:
        return "document_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if missing := {"file_name", "document"} - set(schema.names):
            raise ValueError(f"columns are missing: {sorted(missing)}")
        return _Writer(self.options["path"], self.options.get("extension", "txt"), overwrite)


def write_subtitles(cues: DataFrame, names: DataFrame, path: str, fmt: str, mode: str = "append", **export: object) -> None:
    """cues as for export_subtitles(), names: media_id, name. One file an item with a cue to show, under its safe name, all or none.

    Names are made safe among all items of names, so an item's file name doesn't depend on which of them have cues.
    """
    spark = cues.sparkSession
    spark.dataSource.register(DocumentFiles)
    documents = export_subtitles(cues, fmt, **export).join(safe_names(names).select("media_id", "file_name"), "media_id")
    documents.select("file_name", "document").write.format("document_files").option("extension", fmt).mode(mode).save(path)
