"""Readers of files and the catalog of stored tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import text
from . import office

LOADED = "path string, title string, content string, source_path string, file_type string, error string"

#: OCR and PDF readers of the caller: (bytes) -> text.
OPTIONAL: dict[str, Callable[[bytes], str]] = {}


def decode_csv(data: bytes) -> str:
    """Strict decoding in the order UTF-8 (with mark), GBK, GB18030; else UTF-8 without what can't be read."""
    for name in ("utf-8-sig", "utf-8", "gbk", "gb18030"):
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "ignore")


def _pdf(data: bytes) -> str:
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise ValueError("no PDF reader is installed") from e
    import io

    return "\n\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages)


def read_bytes(kind: str | None, name: str, data: bytes) -> str:
    """Text of one file; unknown kinds and blank texts raise."""
    if kind in OPTIONAL:
        out = OPTIONAL[kind](data)
    elif kind in ("md", "txt"):
        out = data.decode("utf-8", "ignore")
    elif kind == "csv":
        out = decode_csv(data)
    elif kind == "xlsx":
        office.check_workbook(name, data)
        out = office.workbook_text(data)
    elif kind == "docx":
        out = office.word_text(data)
    elif kind == "pdf":
        out = _pdf(data)
    else:
        raise ValueError(f"no reader for {name}")
    if not out.strip():
        raise ValueError("the file is blank")
    return out


def load_files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """Loaded documents of a folder, a file or any URI that Spark reads (s3, hdfs, http through a Hadoop connector).

    One failing file doesn't stop the others: its row has null content and what went wrong. Lock files (~$) are left out.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    own = files.filter(~F.col("path").rlike(r"/~\$[^/]*$")).select("path", "content", text.file_type_of(F.col("path")).alias("kind"), text.title_from_path(F.col("path")).alias("title"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = []
            for path, data, kind, title in df.itertuples(index=False):
                try:
                    out.append((path, title, read_bytes(kind, path.rpartition("/")[2], bytes(data)), path, kind, None))
                except Exception as e:  # each file for itself
                    out.append((path, title, None, path, kind, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "title", "content", "source_path", "file_type", "error"])

    return own.mapInPandas(run, LOADED)


def load_text(spark: SparkSession, content: str, title: str = "") -> DataFrame:
    """One document of a given text; blank text raises."""
    if not content.strip():
        raise ValueError("the text is blank")
    return spark.createDataFrame([(None, title, content, None, "txt", None)], LOADED)


#: For a part of a table the rows that go and those that stay.
Rewrite = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


class Conflict(RuntimeError):
    """Another writer has published since the version that a change was made from."""


class Catalog:
    """The stored tables as parquet under one folder, in versions.

    A version is one small manifest, versions/<n>, which names for each table the folders of rows that make it. A
    manifest never changes: it is written under another name and renamed into place, which fails if it is there already
    (on file systems whose rename is one step, as HDFS's and local ones').
    So a reader sees all of a version or nothing of it, a crash leaves the version before, and of two writers of the same
    number one gets a ``Conflict``. Tables that a change doesn't touch and rows that it only adds to are not written
    again: the new manifest names their folders.
    """

    TABLES = {"sources": schemas.SOURCES, "documents": schemas.DOCUMENTS, "chunks": schemas.CHUNKS, "events": schemas.EVENTS, "entities": schemas.ENTITIES, "links": schemas.LINKS, "vectors": schemas.VECTORS}

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path("versions").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """Number of the present version, the largest manifest; 0 before the first."""
        fs, place = self._fs(), self._path("versions")
        names = [f.getPath().getName() for f in fs.listStatus(place)] if fs.exists(place) else []
        return max((int(n) for n in names if n.isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict[str, list[str]]:
        """For each table the folders that make it in a version (the present one, if none is given)."""
        v = self.version() if version is None else version
        if v == 0:
            return {n: [] for n in self.TABLES}
        stream = self._fs().open(self._path(f"versions/{v}"))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self._frame(name, self.manifest(version)[name])

    def _frame(self, name: str, parts: list[str]) -> DataFrame:
        schema = T.StructType.fromDDL(self.TABLES[name])
        return self.spark.read.schema(schema).parquet(*(f"{self.folder}/{p}" for p in parts)) if parts else self.spark.createDataFrame([], schema)

    def all(self, version: int | None = None) -> dict[str, DataFrame]:
        """All tables of one version."""
        parts = self.manifest(version)
        return {n: self._frame(n, parts[n]) for n in self.TABLES}

    def publish(self, tables: dict[str, DataFrame] | None = None, added: dict[str, DataFrame] | None = None, rewritten: dict[str, Rewrite] | None = None, base: int | None = None) -> int:
        """A new version: ``tables`` are replaced, rows ``added`` are put beside the old ones, other tables stay as they are.

        ``rewritten`` gives for a part of a table the rows that go and those that stay: parts in which none goes aren't touched.
        ``base`` is the version that the change was made from, the present one if it isn't given; if there is a
        later one in the end, nothing is published and a ``Conflict`` raised.
        """
        base = self.version() if base is None else base
        parts = self.manifest(base)
        folder = f"data/{base + 1}-{uuid.uuid4().hex}"
        for name, change in (rewritten or {}).items():
            if name in (tables or {}):
                continue
            for k, part in enumerate(parts[name]):
                hit, kept = change(self._frame(name, [part]))
                if not hit.isEmpty():
                    parts[name][k] = self._write(kept, name, f"{folder}/{name}-part{k}")
        for name, df in (tables or {}).items():
            parts[name] = [self._write(df, name, f"{folder}/{name}-all")]
        for name, df in (added or {}).items():
            parts[name] = [*parts[name], self._write(df, name, f"{folder}/{name}-new")]
        self._commit(base + 1, parts)
        return base + 1

    def _write(self, df: DataFrame, name: str, place: str) -> str:
        out = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(self.TABLES[name]).fields])
        # Vectors are searched by collection: rows of one stand together, so that the others are skipped by the statistics of the files.
        (out.sortWithinPartitions("collection") if name == "vectors" else out).write.parquet(f"{self.folder}/{place}")
        return place

    def _commit(self, version: int, parts: dict[str, list[str]]) -> None:
        fs = self._fs()
        fs.mkdirs(self._path("versions"))
        temporary, final = self._path(f"versions/.{version}-{uuid.uuid4().hex}"), self._path(f"versions/{version}")
        stream = fs.create(temporary, False)
        stream.write(bytearray(json.dumps(parts).encode()))
        stream.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(temporary, final, self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            fs.delete(temporary, False)
            if fs.exists(final):
                raise Conflict(f"version {version} is there already") from e
            raise

    def compact(self, name: str) -> int:
        """A version in which a table of many parts is one again."""
        base = self.version()
        return self.publish({name: self.read(name, base)}, base=base)

    def clean(self, keep: int = 2) -> int:
        """Delete the manifests but the last ``keep`` and the data that only they name; gives the number of folders deleted."""
        fs, now = self._fs(), self.version()
        used = {p for v in range(max(1, now - keep + 1), now + 1) if fs.exists(self._path(f"versions/{v}")) for x in self.manifest(v).values() for p in x}
        gone = 0
        for f in fs.listStatus(self._path("data")) if fs.exists(self._path("data")) else []:
            top = f.getPath().getName()
            if int(top.split("-")[0]) > now:  # of a writer at work
                continue
            for t in fs.listStatus(f.getPath()):
                if f"data/{top}/{t.getPath().getName()}" not in used:
                    gone += fs.delete(t.getPath(), True)
        for v in range(1, now - keep + 1):
            fs.delete(self._path(f"versions/{v}"), False)
        return gone
