"""ZIP archives as a data source: ``spark.read.format("zip_entries").option("path", folder).load()``.

An archive is read in splits of ``split_bytes`` of its file: a task reads the archive's directory and takes the entries that begin in its split, one after the other, through a file that it seeks
in, so no task holds an archive, and a large archive is read by many tasks. Nothing but the list of files and their sizes passes the driver.

path, name, encoding, text, reason: an entry is accepted (reason null) or refused on its own: name, extension, too_large (``entry_bytes``, by its header and again while it is inflated), not_utf8, corrupt, blank. An archive that is
no ZIP file, or that cannot be read, is one row without a name (corrupt, unreadable); so is one whose entries are larger in sum than ``unzipped_bytes`` (too_large). Directories have no row. No archives: no rows.
Options: path (a file or a folder; folders below are read too), extensions (comma-separated), entry_bytes, unzipped_bytes, split_bytes.
"""

from __future__ import annotations

import unicodedata
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from docloom.shipping import ship
from docloom.sources.files import UNZIPPED_BYTES, UPLOAD_BYTES, detect_zip_name

SCHEMA = "path string, name string, encoding string, text string, reason string"
PIECE = 1 << 20


@dataclass
class Split(InputPartition):
    uri: str
    start: int
    end: int


class ZipReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.extensions = tuple(options.get("extensions", ".md,.txt").split(","))
        self.entry_bytes = int(options.get("entry_bytes", UPLOAD_BYTES))
        self.unzipped_bytes = int(options.get("unzipped_bytes", UNZIPPED_BYTES))
        self.split_bytes = int(options.get("split_bytes", 64 << 20))

    def partitions(self) -> list[Split]:
        from pyarrow.fs import FileSelector, FileSystem, FileType

        fs, root = FileSystem.from_uri(self.path)
        found = fs.get_file_info([root])[0]
        files = fs.get_file_info(FileSelector(root, recursive=True)) if found.type == FileType.Directory else [found]
        zips = [f for f in sorted(files, key=lambda f: f.path) if f.type == FileType.File and f.path.lower().endswith(".zip")]
        base = self.path[: len(self.path) - len(root)] if self.path.endswith(root) else ""
        return [Split(base + f.path, at, at + self.split_bytes) for f in zips for at in range(0, max(1, f.size), self.split_bytes)]

    def read(self, split: Split | None) -> Iterator[tuple]:
        from pyarrow.fs import FileSystem

        if split is None:  # Spark asks once where there are no partitions
            return
        first = split.start == 0  # rows about the whole archive come from its first split
        try:
            fs, path = FileSystem.from_uri(split.uri)
            with fs.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                entries = [i for i in z.infolist() if not i.is_dir()]
                if sum(i.file_size for i in entries) > self.unzipped_bytes:
                    if first:
                        yield split.uri, None, None, None, "too_large"
                    return
                for i in entries:
                    if split.start <= i.header_offset < split.end:
                        yield (split.uri, *self.entry(z, i))
        except (zipfile.BadZipFile, ValueError):  # a seek before the start of a short file is a ValueError
            if first:
                yield split.uri, None, None, None, "corrupt"
        except OSError:
            if first:
                yield split.uri, None, None, None, "unreadable"

    def entry(self, z: zipfile.ZipFile, i: zipfile.ZipInfo) -> tuple:
        name, encoding = detect_zip_name(i.filename, i.flag_bits)
        base = name.replace("\\", "/").rsplit("/", 1)[-1].strip()
        text = None
        if not base or base.startswith(".") or "\0" in base or len(base.encode()) > 255:
            reason = "name"
        elif not base.lower().endswith(self.extensions):
            reason = "extension"
        else:
            text, reason = self.text(z, i)
        return base, encoding, text, reason

    def text(self, z: zipfile.ZipFile, i: zipfile.ZipInfo) -> tuple[str | None, str | None]:
        if i.file_size > self.entry_bytes:
            return None, "too_large"
        body = bytearray()
        try:
            with z.open(i) as f:
                while piece := f.read(PIECE):
                    body += piece
                    if len(body) > self.entry_bytes:  # whatever its header says
                        return None, "too_large"
            text = body.decode("utf-8")
        except UnicodeDecodeError:
            return None, "not_utf8"
        except (zipfile.BadZipFile, zlib.error, EOFError, OSError, ValueError, RuntimeError):  # broken, encrypted, or of an unknown method
            return None, "corrupt"
        return (unicodedata.normalize("NFC", text), None) if text.strip() else (None, "blank")


class ZipEntries(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zip_entries"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ZipReader:
        return ZipReader(self.options)


def read_zips(spark: SparkSession, path: str, **options) -> DataFrame:
    ship(spark)
    spark.dataSource.register(ZipEntries)
    return spark.read.format("zip_entries").options(path=path, **options).load()


def write_zips(entries: DataFrame, folder: str) -> DataFrame:
    """One archive for each value of archive, <folder>/<archive>.zip, of the rows' name and text (null: empty), by name: archive, entries. A task streams one archive at a time to its file."""

    def run(batches):
        import pyarrow as pa
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        now, out, z, n, told = None, None, None, 0, []

        def close():
            if z is not None:
                z.close()
                out.close()
                told.append((now, n))

        for b in batches:
            for r in b.to_pylist():
                if z is None or r["archive"] != now:
                    close()
                    now, n, out = r["archive"], 0, fs.open_output_stream(f"{root}/{r['archive']}.zip")
                    z = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                z.writestr(r["name"], (r["text"] or "").encode())
                n += 1
        close()
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in told], pa.string()), pa.array([c for _, c in told], pa.int64())], ["archive", "entries"])

    ship(entries.sparkSession)
    dealt = entries.select(entries["archive"].cast("string").alias("archive"), "name", "text").repartition("archive").sortWithinPartitions("archive", "name")
    return dealt.mapInArrow(run, "archive string, entries long")
