"""A study folder as a data source: files found by their names, tables read with the names' entities as columns.

`spark.read.format("study_tree")` lists a tree, one row per file with the entities of its name and, for text tables, the header,
which tasks take from the first bytes of each file. With the option `columns`, a JSON list of names, it reads the tables
themselves. Filters on entity columns (`file_subject`, `file_session`, ...) are pushed into the listing: folders of other
subjects and sessions are never opened. Partitions are runs of files of about `partitionBytes` bytes (a file also counts
FILE_COST, so many small files are shared out too).
`df.write.format("study_tree")` writes one table per value of `source_file`, each by a temporary file that is renamed.

Paths are local or mounted folders, or URIs that pyarrow's file systems open. Hidden files and those that begin with `_` are left out.
"""

from __future__ import annotations

import fnmatch
import io
import json
import os
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import csv, fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage

from .files import DATATYPES, ENTITIES, identity_from_path, normalise_columns

NAMES = tuple(ENTITIES) + ("suffix", "datatype", "extension")
PARTITION_BYTES = 64 << 20
FILE_COST = 1 << 20
HEAD = 1 << 16
FOLDER_KEYS = {"sub": "subject", "ses": "session"}


def entities_of(path: str) -> dict[str, str | None]:
    """Entities of a file name, its suffix, data type (the folder it lies in) and extension."""
    folder, name = posixpath.split(path)
    stem, dot, _ = name.partition(".")
    pairs = dict(p.split("-", 1) for p in reversed(stem.split("_")) if "-" in p)
    out: dict[str, str | None] = {n: pairs.get(k) or None for n, k in ENTITIES.items()}
    last = stem.rsplit("_", 1)[-1] if "_" in stem else ""
    kind = posixpath.basename(folder)
    both = next((e for e in (".nii.gz", ".tsv.gz") if name.endswith(e)), None)
    return out | {"suffix": last if re.fullmatch(r"[a-zA-Z0-9]+", last) else None, "datatype": kind if kind in DATATYPES else "unknown",
                  "extension": both or (posixpath.splitext(name)[1] if dot else "")}


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


def visible(name: str) -> bool:
    return not name.startswith((".", "_"))


def walk(system: fs.FileSystem, folder: str, pattern: list[str], wanted: dict[str, set[str]]) -> Iterator[tuple[str, int]]:
    """(path, size) of the files under a folder; pattern holds globs for the next levels. A folder named after another subject or
    session than the wanted ones is not opened."""
    for info in sorted(system.get_file_info(fs.FileSelector(folder)), key=lambda i: i.path):
        name = info.base_name
        if not visible(name) or pattern and not fnmatch.fnmatchcase(name, pattern[0]):
            continue
        if info.type == fs.FileType.Directory:
            key, _, value = name.partition("-")
            if value in wanted.get(FOLDER_KEYS.get(key, ""), {value}):
                yield from walk(system, info.path, pattern[1:], wanted)
        elif info.type == fs.FileType.File and len(pattern) <= 1 and all(entities_of(info.path)[k] in v for k, v in wanted.items()):
            yield info.path, info.size


def listed(paths: list[str], wanted: dict[str, set[str]]) -> Iterator[tuple[str, str, int]]:
    """(root, path, size) of all files of paths, which are files, folders or globs; each file once."""
    seen = set()
    for given in paths:
        system, path = opened(given)
        parts = path.split("/")
        fixed = next((i for i, p in enumerate(parts) if any(c in p for c in "*?[")), len(parts))
        base, pattern = "/".join(parts[:fixed]) or "/", parts[fixed:]
        info = system.get_file_info(base)
        found = walk(system, base, pattern, wanted) if info.type == fs.FileType.Directory else [(base, info.size)] if info.type == fs.FileType.File and not pattern else []
        for file, size in found:
            if (given.partition("://")[0], file) not in seen and all(entities_of(file)[k] in v for k, v in wanted.items()):
                seen.add((given.partition("://")[0], file))
                yield given, file, size


@dataclass
class Files(InputPartition):
    files: list[tuple[str, str, int]]


def tables_in(stream: pa.NativeFile) -> Iterator[pa.RecordBatch]:
    """Batches of text columns; n/a and empty are missing."""
    options = {"parse_options": csv.ParseOptions(delimiter="\t"), "read_options": csv.ReadOptions(use_threads=False)}
    head = stream.read(HEAD)
    if not head.strip():
        return
    names = header_of(head).split("\t")
    convert = csv.ConvertOptions(column_types={n: pa.string() for n in names}, null_values=["n/a", ""], strings_can_be_null=True, quoted_strings_can_be_null=False)
    yield from csv.open_csv(Joined(head, stream), convert_options=convert, **options)


class Joined(io.RawIOBase):
    """A stream with the bytes that were read from it in front."""

    def __init__(self, head: bytes, rest: pa.NativeFile):
        self.head, self.rest = head, rest

    def readable(self) -> bool:
        return True

    def readinto(self, out) -> int:
        data = self.head[:len(out)]
        self.head = self.head[len(out):]
        data = data or self.rest.read(len(out))
        out[:len(data)] = data
        return len(data)


def padded(text: bytes) -> Iterator[pa.RecordBatch]:
    """The same for a table whose lines differ in length: short lines are filled up, long ones cut, as Spark's own reader does."""
    lines = text.decode("utf-8-sig", "replace").splitlines()
    names = lines[0].split("\t")
    rows = [(line.split("\t") + [""] * len(names))[:len(names)] for line in lines[1:] if line]
    clean = lambda v: None if v in ("n/a", "") else v
    yield pa.record_batch([pa.array([clean(r[i]) for r in rows], pa.string()) for i in range(len(names))], names=names)


def header_of(head: bytes) -> str:
    return head.decode("utf-8-sig", "replace").splitlines()[0].replace('"', "") if head.strip() else ""


class StudyReader(DataSourceReader):
    def __init__(self, paths: list[str], schema: T.StructType, columns: list[str] | None, size: int):
        self.paths, self.schema, self.columns, self.size, self.wanted = paths, schema, columns, size, {}

    def pushFilters(self, filters):
        """Equality and membership of entities choose the files, whose names hold for all their rows."""
        def name(f) -> str | None:
            own = f.attribute[0] if isinstance(f, (EqualTo, In, IsNotNull)) and len(f.attribute) == 1 else ""
            return own.removeprefix("file_") if own.startswith("file_") and own.removeprefix("file_") in NAMES else None

        for f in filters:
            if name(f) and not isinstance(f, IsNotNull):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[name(f)] = self.wanted.get(name(f), values) & values
        return [f for f in filters if name(f) not in self.wanted]  # a wanted value is no missing one

    def partitions(self):
        bins, size = [[]], 0
        for file in listed(self.paths, self.wanted):
            if bins[-1] and size + file[2] + FILE_COST > self.size:
                bins.append([])
                size = 0
            bins[-1].append(file)
            size += file[2] + FILE_COST
        return [Files(b) for b in bins]

    def read(self, partition: Files):
        schema = pa.schema([(f.name, pa.int64() if f.name == "size" else pa.string()) for f in self.schema])
        for given, path, size in partition.files:
            system, _ = opened(given)
            shown = path if "://" not in given else f"{given.partition('://')[0]}://{path}"
            fixed = {f"file_{k}": v for k, v in entities_of(path).items()} | {"source_file": shown}
            if self.columns is None:
                text = path.endswith((".tsv", ".tsv.gz", ".csv"))
                head = ""
                if text:
                    with system.open_input_stream(path) as stream:
                        head = header_of(stream.read(HEAD))
                fixed |= {"size": size, "header": head or None}
                yield pa.RecordBatch.from_pylist([fixed], schema)
                continue
            for batch in self._tables(system, path):
                own = dict(zip(batch.schema.names, batch.columns))
                yield pa.record_batch([own[n] if n in self.columns and n in own else pa.array([fixed.get(n)] * batch.num_rows, pa.string()) for n in schema.names], schema=schema)

    @staticmethod
    def _tables(system: fs.FileSystem, path: str) -> Iterator[pa.RecordBatch]:
        try:
            with system.open_input_stream(path) as stream:
                batches = tables_in(stream)
                first = next(batches, None)
        except pa.ArrowInvalid:
            first = None
            with system.open_input_stream(path) as stream:
                yield from padded(stream.read())
            return
        if first is not None:
            with system.open_input_stream(path) as stream:
                yield from tables_in(stream)


class StudyWriter(DataSourceWriter):
    """Rows of a partition that follow one another and have the same source_file go to one table under the root."""

    def __init__(self, root: str, schema: T.StructType):
        self.root, self.names = root, [f.name for f in schema]

    def write(self, iterator):
        system, root = opened(self.root)
        at, out, done = None, None, set()
        mark = uuid.uuid4().hex

        def close():
            if out is not None:
                out.close()
                system.move(hidden(at), f"{root}/{at}")

        def hidden(name):
            return f"{root}/{posixpath.dirname(name)}/.{mark}-{posixpath.basename(name)}"

        keep = [n for n in self.names if n != "source_file"]
        for row in iterator:
            if row["source_file"] != at:
                close()
                at = row["source_file"]
                if at in done:
                    raise ValueError(f"rows of {at} are not together")
                done.add(at)
                system.create_dir(posixpath.dirname(f"{root}/{at}"), recursive=True)
                out = system.open_output_stream(hidden(at), compression="gzip" if at.endswith(".gz") else None)
                out.write(("\t".join(keep) + "\n").encode())
            values = [row[n] for n in keep]
            out.write(("\t".join("n/a" if v is None or v == "" else re.sub(r"[\t\r\n]", " ", str(v)) for v in values) + "\n").encode())
        close()
        return WriterCommitMessage()


class StudyTree(DataSource):
    @classmethod
    def name(cls):
        return "study_tree"

    def _paths(self) -> list[str]:
        return json.loads(self.options["paths"]) if "paths" in self.options else [self.options["path"]]

    def _columns(self) -> list[str] | None:
        return json.loads(self.options["columns"]) if "columns" in self.options else None

    def schema(self):
        text = [T.StructField(n, T.StringType()) for n in (*(self._columns() or ()), "source_file", *[f"file_{n}" for n in NAMES])]
        return T.StructType(text if self._columns() is not None else [*text, T.StructField("size", T.LongType()), T.StructField("header", T.StringType())])

    def reader(self, schema):
        return StudyReader(self._paths(), schema, self._columns(), int(self.options.get("partitionBytes", PARTITION_BYTES)))

    def writer(self, schema, overwrite):
        return StudyWriter(self._paths()[0], schema)


def _source(spark: SparkSession):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StudyTree)
    return spark.read.format("study_tree")


def study_files(spark: SparkSession, paths, where: Column | str | None = None) -> DataFrame:
    """One row per file: source_file, the entities of its name (file_...), size, and the header of text tables."""
    found = _source(spark).option("paths", json.dumps([paths] if isinstance(paths, str) else list(paths))).load()
    return found if where is None else found.where(where)


def study_tables(spark: SparkSession, paths, schema: T.StructType | None = None, where: Column | str | None = None, **options) -> DataFrame:
    """The tables under paths (files, folders, globs), stacked by column name: absent columns and n/a are missing, all columns are text
    unless a schema names types. Subject and session come from the file name where it has them.

    `where` filters on file_ columns and chooses the files. Headers come from the first bytes of the files; what reaches the
    driver is each different header once.
    """
    heads = [r.header for r in study_files(spark, paths, where).where("header is not null").select("header").distinct().orderBy("header").collect()]
    if not heads:
        raise FileNotFoundError(f"no table with a header in {paths}")
    columns = list(dict.fromkeys(c for h in heads for c in h.split("\t")))
    df = _source(spark).options(**options).option("paths", json.dumps([paths] if isinstance(paths, str) else list(paths))).option("columns", json.dumps(columns)).load()
    df = df if where is None else df.where(where)
    df = df.select(*[F.col(f"`{c}`") for c in columns], "source_file")
    for f in schema or ():
        df = df.withColumn(f.name, (F.col(f.name) if f.name in df.columns else F.lit(None)).try_cast(f.dataType))
    return normalise_columns(identity_from_path(df))


def write_study(df: DataFrame, root: str, order: list[str] = ()) -> None:
    """One tab-separated table per value of source_file, a path under root; 'n/a' for missing values. Rows of a file are brought
    together and ordered; a retried task writes the same files again."""
    _source(df.sparkSession)
    df.repartition("source_file").sortWithinPartitions("source_file", *order).write.format("study_tree").option("path", root).mode("append").save()
