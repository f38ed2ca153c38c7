"""Yearly station archives: ZIPs of Latin-1 text files with a short preamble.

Python only unzips; one row per member then carries the text, and Spark parses preamble and
readings. ``StationArchive`` is a data source whose partitions are ranges of an archive's members: the list of members
is read from the archive's end, and a task seeks to its own members, so no task holds an archive and a large one is
read by many. It reads any store that Arrow opens; ``archive_members`` takes whole files through Spark's own reader for
stores that only Spark opens.
"""

from __future__ import annotations

import io
import json
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.columns import decimal_comma, tolerant_date
from ..functions.text import ascii_upper
from ..operators.quality import guarded

# Preamble keys and the zero-based positions of the readings used.
PREAMBLE = {
    "station_code": "CODIGO (WMO)", "station_name": "ESTACAO", "station_uf": "UF",
    "station_latitude": "LATITUDE", "station_longitude": "LONGITUDE", "station_altitude_m": "ALTITUDE",
}
READINGS = {
    "precipitacao_mm": 2, "radiacao_kj_m2": 6, "temperatura_c": 7, "temperatura_max_c": 9,
    "temperatura_min_c": 10, "umidade_pct": 15, "vento_m_s": 18,
}
MINIMUM_FIELDS = 19
PREAMBLE_LINES = 10


# Unpacked bytes of the members that one task reads.
RANGE_BYTES = 32 << 20
MEMBER_SCHEMA = "archive string, member string, text string"


def opened_store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri("file://" + path.removeprefix("file:") if path.startswith("file:/") and "://" not in path else path)


def _is_text(name: str) -> bool:
    return name.lower().endswith(".csv")


def _read_member(archive: zipfile.ZipFile, name: str) -> str:
    try:
        return archive.read(name).decode("latin1")
    except (zipfile.BadZipFile, zlib.error, EOFError):
        return ""  # damaged: kept as a member, listed as skipped


@dataclass
class MemberRange(InputPartition):
    """Members of one archive for one task; none for a file that is no archive."""

    archive: str
    names: list[str]


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = json.loads(options["archives"]) if "archives" in options else [options["path"]]
        self.most = int(options.get("rangebytes", RANGE_BYTES))

    def archives(self) -> Iterator[str]:
        for path in self.paths:
            store, at = opened_store(path)
            if store.get_file_info(at).type != pafs.FileType.Directory:
                yield path
                continue
            for info in sorted(store.get_file_info(pafs.FileSelector(at, recursive=True)), key=lambda i: i.path):
                if info.type == pafs.FileType.File and info.path.lower().endswith(".zip"):
                    yield f"{path.rstrip('/')}/{info.path[len(at.rstrip('/')) + 1:]}"

    def partitions(self) -> list[MemberRange]:
        """Ranges of members in order of name, from the directories at the archives' ends."""
        out: list[MemberRange] = []
        for path in self.archives():
            store, at = opened_store(path)
            try:
                with store.open_input_file(at) as file, zipfile.ZipFile(file) as archive:
                    members = sorted((i.filename, i.file_size) for i in archive.infolist() if _is_text(i.filename))
            except (zipfile.BadZipFile, pa.ArrowInvalid):  # no archive, or too short for one
                out.append(MemberRange(path, []))
                continue
            names, size = [], 0
            for name, n in members:
                if names and size + n > self.most:
                    out.append(MemberRange(path, names))
                    names, size = [], 0
                names.append(name)
                size += n
            out.append(MemberRange(path, names))
        return out

    def read(self, partition: MemberRange) -> Iterator[tuple[str, str, str]]:
        if not partition.names:
            yield partition.archive, "", ""  # one unusable member without a name
            return
        store, at = opened_store(partition.archive)
        with store.open_input_file(at) as file, zipfile.ZipFile(file) as archive:
            for name in partition.names:
                yield partition.archive, name, _read_member(archive, name)


class StationArchive(DataSource):
    """``spark.read.format("station_archive")``: ``archive, member, text`` of the text files in ZIP archives.

    Options: ``path`` (an archive or a folder of archives) or ``archives`` (a JSON list of either), and ``rangeBytes``.
    """

    @classmethod
    def name(cls) -> str:
        return "station_archive"

    def schema(self) -> str:
        return MEMBER_SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


def member_ranges(spark: SparkSession, path: str | list[str], *, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``archive, member, text`` read by ranges of members."""
    spark.dataSource.register(StationArchive)
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.format("station_archive").option("archives", json.dumps(paths)).option("rangeBytes", str(range_bytes)).load()


def _unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            try:
                archive = zipfile.ZipFile(io.BytesIO(content))
            except zipfile.BadZipFile:  # the whole file: one unusable member without a name
                yield pd.DataFrame({"archive": [path], "member": [""], "text": [""]})
                continue
            with archive:
                for name in filter(_is_text, sorted(archive.namelist())):
                    yield pd.DataFrame({"archive": [path], "member": [name], "text": [_read_member(archive, name)]})


def archive_members(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``archive, member, text`` for every text file of the ZIP archives, spread again by member."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    members = files.mapInPandas(_unzip, MEMBER_SCHEMA)
    return members.repartition("archive", "member")


def _preamble(lines: Column, key: str) -> Column:
    hit = F.filter(
        F.slice(lines, 1, PREAMBLE_LINES),
        lambda line: ascii_upper(line).startswith(f"{key}:;") | ascii_upper(line).startswith(f"{key} "),
    )
    return F.trim(F.regexp_extract(F.try_element_at(hit, F.lit(1)), r"^[^;]*;(.*)$", 1))


def parsed_members(members: DataFrame) -> DataFrame:
    """Members with station metadata, their reading lines and whether they are usable."""
    lines = F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")
    read = members.withColumn("_lines", lines)
    header = F.filter(
        F.transform(F.col("_lines"), lambda line, i: F.struct(i.alias("i"), line.alias("line"))),
        lambda x: ascii_upper(F.substring(x.line, 1, 60)).rlike("^DATA") & ascii_upper(x.line).contains(";HORA"),
    )
    placed = read.withColumn("_header", F.try_element_at(header, F.lit(1))["i"])
    named = placed.withColumns(
        {
            name: decimal_comma(_preamble(F.col("_lines"), key)) if name.split("_")[1] in
            ("latitude", "longitude", "altitude") else _preamble(F.col("_lines"), key)
            for name, key in PREAMBLE.items()
        }
    ).withColumn(
        "_body", F.expr("slice(_lines, _header + 2, greatest(size(_lines) - _header - 1, 0))")
    )
    width = F.size(F.split(F.try_element_at("_body", F.lit(1)), ";"))
    complete = F.col("_header").isNotNull() & (width >= MINIMUM_FIELDS)
    for name in PREAMBLE:
        complete = complete & F.col(name).isNotNull()
    dated = F.exists("_body", lambda line: tolerant_date(F.get(F.split(line, ";"), F.lit(0))).isNotNull())
    return named.withColumn("usable", F.coalesce(complete & dated, F.lit(False))).drop("_lines", "text")


def hourly_readings(members: DataFrame) -> DataFrame:
    """Hourly readings of all usable members; broken members are left out."""
    good = parsed_members(members).where("usable")
    rows = good.select("archive", "member", *PREAMBLE, F.explode("_body").alias("_line"))
    fields = F.split("_line", ";")
    return rows.where(F.trim("_line") != "").select(
        "archive", "member", *PREAMBLE, tolerant_date(fields[0]).alias("data"),
        *[decimal_comma(F.get(fields, F.lit(i))).alias(n) for n, i in READINGS.items()],
    ).where("data is not null")


def checked_readings(members: DataFrame) -> DataFrame:
    """Hourly readings of all usable members; an archive without any fails the job."""
    archives = parsed_members(members).groupBy("archive").agg(F.max("usable").alias("_any"))
    return guarded(hourly_readings(members), archives, ~F.col("_any"), F.concat(F.lit("archive without a usable member: "), "archive"))


def skipped_members(members: DataFrame) -> DataFrame:
    return parsed_members(members).where("not usable").select("archive", "member")
