"""Sources and sinks: trees of source files, parser output, checkpoints, rewritten text."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom import schemas
from symloom.sources import statelog


def read_sources(spark: SparkSession, root: str, pattern: str = "*.js") -> DataFrame:
    """``path, source`` of every file below ``root`` whose name fits, one row a file."""
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("source"))


def filter_sources(sources: DataFrame) -> DataFrame:
    """Without installed packages and minified files."""
    name = F.element_at(F.split("path", "/"), -1)
    return sources.where(~F.contains("path", F.lit("node_modules")) & ~F.contains(name, F.lit(".min.")))


def explode_lines(sources: DataFrame) -> DataFrame:
    """``path, line, text``: lines counted from 0; a last newline gives a last empty line."""
    return sources.select("path", F.posexplode(F.split("source", "\n", -1)).alias("line", "text"))


def program_scopes(lines: DataFrame) -> DataFrame:
    """The whole-file scope of each file, from its lines; sums and maxima only."""
    last = lines.groupBy("path").agg(F.max("line").alias("end_row"), F.max_by(F.length("text"), "line").alias("end_col"))
    none = F.lit(None).cast("string")
    return last.select("path", F.lit("scope_0").alias("scope_id"), F.lit(0).alias("scope_seq"), F.lit("program").alias("scope_type"), F.lit(0).alias("start_row"), F.lit(0).alias("start_col"), "end_row", "end_col", none.alias("parent_id"), F.array().cast("array<string>").alias("children"))


def scope_seq(scope_id: Column) -> Column:
    """The number in a scope id; scopes count up in the order of the text."""
    return F.nullif(F.regexp_extract(scope_id, r"([0-9]+)$", 1), F.lit("")).cast("int")


def flatten_parse(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scopes and bindings of parser output ``(path, scopes)``, with the parser's defaults."""
    rows = parsed.select("path", F.explode("scopes").alias("key", "s"))
    zero = F.lit(0)
    start, end = F.col("s.range.start"), F.col("s.range.end")
    scopes = rows.select(
        "path", F.col("key").alias("scope_id"), scope_seq(F.col("key")).alias("scope_seq"), F.coalesce("s.type", F.lit("block")).alias("scope_type"),
        F.coalesce(start["row"], zero).alias("start_row"), F.coalesce(start["column"], zero).alias("start_col"), F.coalesce(end["row"], zero).alias("end_row"), F.coalesce(end["column"], zero).alias("end_col"),
        F.col("s.parentId").alias("parent_id"), F.coalesce("s.children", F.array().cast("array<string>")).alias("children"),
    )
    own = rows.select("path", F.col("key").alias("scope_id"), scope_seq(F.col("key")).alias("_seq"), F.posexplode("s.bindings").alias("_i", "b"))
    column = F.coalesce("b.column", zero)
    # scopes count up in text order, so (scope, place) orders a file's bindings
    bindings = own.select(
        "path", "scope_id", (F.col("_seq") * 1000000 + F.col("_i")).cast("long").alias("binding_seq"), F.coalesce("b.name", F.lit("")).alias("name"), F.coalesce("b.line", zero).alias("line"), column.alias("column"),
        (column + F.length(F.coalesce("b.name", F.lit("")))).alias("end_column"), F.coalesce("b.type", F.lit("variable")).alias("binding_type"), F.lit(True).alias("is_declaration"),
        F.coalesce("b.isObfuscated", F.lit(False)).alias("is_obfuscated"), F.coalesce("b.referenceLines", F.array().cast("array<int>")).alias("reference_lines"),
    )
    return scopes, bindings


def read_parse_files(spark: SparkSession, root: str) -> DataFrame:
    """``path, scopes, error`` of every file of a folder of parser output, one JSON object a file.

    A file that is no JSON object, empty ones too, has null scopes and an error; every file has a
    row. An object without scopes has an empty map, as the parser's own reader takes it.
    """
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(root)
    rows = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("_text"))
    rows = rows.withColumn("_p", F.from_json("_text", schemas.SCOPE_JSON))
    object_ = F.coalesce(F.schema_of_variant(F.try_parse_json("_text")).startswith("OBJECT"), F.lit(False))
    scopes = F.when(object_, F.coalesce("_p.scopes", F.create_map().cast(rows.schema["_p"].dataType["scopes"].dataType)))
    return rows.select("path", scopes.alias("scopes"), F.when(~object_, F.lit("parser output is not a JSON object")).alias("error"))


def read_parse_json(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Scopes and bindings of a folder of parser output; for files that cannot be read there are
    none (``read_parse_files`` tells which, ``parse_or_pattern`` reads their sources by pattern)."""
    return flatten_parse(read_parse_files(spark, root).where("error is null").select("path", "scopes"))


def output_path(path: Column, root: Column | None = None, out: Column | None = None) -> Column:
    """Where a rewritten file goes: beside its source, or at the same place below ``out``."""
    if out is None:
        return F.regexp_replace(path, r"^(.*?[^/])(\.[^./]*)?$", "$1.deobfuscated.js")
    relative = F.when(path.startswith(F.concat(root, F.lit("/"))), F.substr(path, F.length(root) + 2)).otherwise(F.element_at(F.split(path, "/"), -1))
    return F.concat(out, F.lit("/"), relative)


#: Most files of one task that stand at the same time in ``pass_sources``.
FILES_AT_ONCE = 10_000


def _located(path: str) -> tuple[pa_fs.FileSystem, str]:
    return pa_fs.FileSystem.from_uri(path) if "://" in path else (pa_fs.LocalFileSystem(), path.removeprefix("file:"))


def _put(system: pa_fs.FileSystem, place: str, source: str | None) -> None:
    with system.open_output_stream(place, compression=None) as f:
        f.write((source or "").encode("utf-8", "surrogatepass"))


def _put_whole(system: pa_fs.FileSystem, place: str, source: str | None) -> None:
    folder, _, name = place.rpartition("/")
    # a folder that no reader of sources enters; what a failed task leaves stays there
    system.create_dir(f"{folder}/_parts", recursive=True)
    beside = f"{folder}/_parts/{name}.{uuid.uuid4().hex}"
    _put(system, beside, source)
    system.move(beside, place)


def write_sources(files: DataFrame) -> int:
    """Write every ``path, source`` as a file of that name, by the tasks that hold the rows.

    Paths are those of a file system that Arrow knows (a local or shared folder, or a URI such as
    ``hdfs://`` or ``s3://``). A file is written to a folder ``_parts`` beside its place and moved
    there, so that a task that is run again leaves a whole file; of rows that share a path one
    stays. Returns the files.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for path, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                _put_whole(*_located(path), source)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return files.select("path", "source").mapInArrow(put, "n long").agg(F.sum("n")).first()[0] or 0


def _passed(batches: Iterator[pa.RecordBatch], folder: str, at_once: int) -> Iterator[pa.RecordBatch]:
    system, base = _located(folder)
    for batch in batches:
        for start in range(0, batch.num_rows, at_once):
            own = uuid.uuid4().hex  # a task that is run again, or twice, meets no file of the other
            root = f"{base}/{own}"
            system.create_dir(root, recursive=True)
            try:
                # only this task reads the tree, once all is written: files need not be moved to their places
                made: set[str] = set()
                for path, source in zip(*(c.to_pylist() for c in batch.slice(start, at_once).columns), strict=True):
                    if (below := path.rpartition("/")[0]) not in made:
                        system.create_dir(f"{root}/{below}", recursive=True)
                        made.add(below)
                    _put(system, f"{root}/{path}", source)
                names, texts = [], []
                for found in system.get_file_info(pa_fs.FileSelector(root, recursive=True)):
                    if found.type == pa_fs.FileType.File:
                        with system.open_input_stream(found.path, compression=None) as f:
                            texts.append(f.read().decode("utf-8"))
                        names.append(found.path.split(f"/{own}/", 1)[1])
            finally:
                system.delete_dir(root)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], names=["path", "source"])


def pass_sources(files: DataFrame, folder: str, at_once: int = FILES_AT_ONCE) -> DataFrame:
    """``path, source`` of the files that ``write_sources`` makes of the rows, read back; none stays.

    A file takes at least a block of its file system, however short it is, so millions of them need a
    disk of many times their text. Here a task writes ``at_once`` rows as a tree below ``folder``, reads
    the files that stand there, and takes the tree away before it writes the next. Paths are relative
    and have to differ. For trees that are to stay, ``write_sources`` and ``read_sources``.
    """
    # by number: Spark would put rows of a few bytes into one task, but a file costs the same however short
    dealt = files.select("path", "source").repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")
    return dealt.mapInArrow(lambda batches: _passed(batches, folder, at_once), "path string, source string")


def write_table(files: DataFrame, out: str) -> None:
    """Write ``path, source`` as a new table of whole files; a folder that exists is an error."""
    files.select("path", "source").write.parquet(out)


def write_state(state: DataFrame, folder: str) -> None:
    """Append checkpoint rows as JSON lines."""
    state.write.mode("append").json(folder)


def newest_state(state: DataFrame) -> DataFrame:
    """The newest row of each input file."""
    rows = F.struct(*[F.col(c) for c in state.columns])
    return state.groupBy("input_file").agg(F.max_by(rows, "updated_at").alias("s")).select("s.*")


def read_state(spark: SparkSession, folder: str) -> DataFrame:
    """The newest readable checkpoint of each input file; unreadable rows count as absent, as does
    a folder that is not there. The folder has JSON lines or a log (``statelog``)."""
    if statelog.versions(spark, folder):
        names = [c.split()[0] for c in spark.createDataFrame([], schemas.STATE).columns]
        return statelog.read_log(spark, folder).select(*names)
    try:
        spark.read.format("text").load(folder).schema  # noqa: B018
    except AnalysisException:
        return spark.createDataFrame([], schemas.STATE)
    rows = spark.read.schema(schemas.STATE).option("mode", "DROPMALFORMED").json(folder)
    return newest_state(rows.where("input_file is not null"))
