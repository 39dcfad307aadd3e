"""Station archives as a data source: partitions from the zip directories, members read line by line."""

from __future__ import annotations

import fnmatch
import gzip
import io
import re
import zipfile
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from stationflow.sources.station_files import exact_slots, section

#: station.year.anything.zip
_NAME = re.compile(r"^(\w+)\.(\d{4})\.")
_COMPARE = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}


def name_parts(archive: str) -> tuple[str | None, int | None]:
    """Station (upper case) and year of an archive's name, where it has them."""
    m = _NAME.match(archive)
    return (m[1].upper(), int(m[2])) if m else (None, None)


class ArchivePart(InputPartition):
    """Some members of one archive; all of them where ``members`` is None."""

    def __init__(self, path: str, members: list[str] | None):
        self.path, self.members = path, members


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.glob = options["path"], options.get("glob", "*.zip")
        self.part_bytes, self.most_planned = int(options.get("partBytes", 64 << 20)), int(options.get("mostPlanned", 2000))
        self.wanted: list[tuple[str, object, type]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Conditions on station and year decide by the archives' names alone; the others go back to Spark."""
        for f in filters:
            if type(f) in _COMPARE and f.attribute in (("station",), ("year",)):
                self.wanted.append((f.attribute[0], f.value, type(f)))
            else:
                yield f

    def _keeps(self, archive: str) -> bool:
        station, year = name_parts(archive)
        have = {"station": station, "year": year}
        return all(have[c] is not None and _COMPARE[kind](have[c], value) for c, value, kind in self.wanted)

    def _open(self, path: str) -> zipfile.ZipFile:
        store, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        return zipfile.ZipFile(store.open_input_file(at))

    def partitions(self) -> Sequence[InputPartition]:
        """Archives are listed, and parted by the size of their members as their directories say, which is all that is read here.

        Beyond ``mostPlanned`` archives their directories are left to the tasks: a partition is an archive.
        """
        store, at = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        prefix = self.path[: len(self.path) - len(at)] if self.path.endswith(at) else ""
        found = store.get_file_info(fs.FileSelector(at, recursive=True)) if store.get_file_info(at).type == fs.FileType.Directory else [store.get_file_info(at)]
        paths = sorted(prefix + f.path for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, self.glob) and self._keeps(f.base_name))
        if len(paths) > self.most_planned:
            return [ArchivePart(p, None) for p in paths]
        out: list[InputPartition] = []
        for p in paths:
            try:
                with self._open(p) as box:
                    members = [(m.filename, m.compress_size) for m in box.infolist() if not m.is_dir()]
            except (OSError, ValueError, zipfile.BadZipFile):
                continue
            group, size = [], 0
            for name, n in members:
                if group and size + n > self.part_bytes:
                    out.append(ArchivePart(p, group))
                    group, size = [], 0
                group.append(name)
                size += n
            if group:
                out.append(ArchivePart(p, group))
        return out

    def read(self, partition: ArchivePart) -> Iterator[pa.RecordBatch]:
        archive = partition.path.rsplit("/", 1)[-1]
        station, year = name_parts(archive)
        try:
            box = self._open(partition.path)
        except (OSError, ValueError, zipfile.BadZipFile):
            return
        rows: list[tuple] = []
        with box:
            for member in partition.members if partition.members is not None else box.namelist():
                if not _sound(box, member):
                    continue
                with box.open(member) as raw:
                    lines = io.TextIOWrapper(gzip.GzipFile(fileobj=raw) if member.endswith(".gz") else raw, "utf-8", "replace")
                    for t in section(lines, "TROP/SOLUTION"):
                        if len(t) >= 5:
                            rows.append((archive, member, station, year, t[0], t[1], _number(t[2]), _number(t[4])))
                            if len(rows) >= 20_000:
                                yield _batch(rows)
                                rows = []
        if rows:
            yield _batch(rows)


def _number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


_ARROW = pa.schema([("archive", pa.string()), ("member", pa.string()), ("station", pa.string()), ("year", pa.int32()), ("site", pa.string()), ("epoch", pa.string()), ("total", pa.float64()), ("wet", pa.float64())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def _sound(box: zipfile.ZipFile, member: str) -> bool:
    """Whether a member can be read to its end, so that a broken one gives no rows at all. Nothing of it is kept."""
    try:
        with box.open(member) as raw:
            data = gzip.GzipFile(fileobj=raw) if member.endswith(".gz") else raw
            while data.read(1 << 20):
                pass
        return True
    except (OSError, EOFError, ValueError, zipfile.BadZipFile, zipfile.zlib.error):
        return False


class StationArchives(DataSource):
    """Records of zips of gzipped text. Options: path, glob, partBytes (of a partition, compressed), mostPlanned.

    station and year come from an archive's name (NULL where it doesn't say), site from the record. A task holds some thousand
    rows and never a member; broken archives and members are left out.
    """

    @classmethod
    def name(cls) -> str:
        return "station_archives"

    def schema(self) -> str:
        return "archive string, member string, station string, year int, site string, epoch string, total double, wet double"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def archives(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The records of all archives below ``path``, on any store that Arrow reads."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StationArchives)
    return spark.read.format("station_archives").options(path=path, **options).load()


def ingest_archives(spark: SparkSession, path: str, step_s: int, start: str, end: str, closed: bool = True, **options: str) -> DataFrame:
    """What ``ingest_station_archives`` gives, with no archive or member in memory; years outside the range aren't opened."""
    rows = archives(spark, path, **options)
    return exact_slots(rows, step_s, start, end, closed)
