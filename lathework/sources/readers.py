"""Readers that tolerate what line-based and per-file inputs bring."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lathework.operators.ordering import with_row_index
from lathework.session import materialize, path_object

#: A task that reads whole files gets about so many bytes, and so many files.
_TASK_BYTES, _TASK_FILES = 1 << 25, 1 << 13
#: Bytes of files that become one Arrow batch, about.
_BATCH_BYTES = 1 << 22


def _name(status) -> str:
    return status.getPath().getName()


def _other_names(spark: SparkSession, path: str, kinds: Sequence[str], recursive: bool) -> list[str]:
    """Names in a folder that end in none of ``kinds``; folders are looked into if ``recursive``.

    A folder whose names all fit is told by two counts, however many files it holds: only of other folders do names come to Python.
    """
    files, folder = path_object(spark, path)
    if not files.exists(folder):
        return []
    glob = spark.sparkContext._jvm.org.apache.hadoop.fs.GlobFilter
    seen, fit = glob("[^._]*"), glob("{" + ",".join("*" + re.sub(r"([^\w.])", r"\\\1", kind) for kind in kinds) + "}")
    there = files.listStatus(folder, seen)
    if len(there) == len(files.listStatus(folder, glob("[^._]*", fit))):
        return []
    other = []
    for status in there:
        name = _name(status)
        if recursive and status.isDirectory():
            other += _other_names(spark, status.getPath().toString(), kinds, recursive)
        elif not name.endswith(tuple(kinds)):
            other.append(name)
    return other


def refuse_other_kinds(spark: SparkSession, path: str, kinds: Sequence[str], recursive: bool = False) -> None:
    """An error if a folder holds a file whose name ends in none of ``kinds``; names that begin with a dot or an underscore do not count."""
    other = sorted(_other_names(spark, path, kinds, recursive))
    if other:
        raise _refused(len(other), kinds, other[:5])


def _refused(count: int, kinds: Sequence[str], names: Sequence[str]) -> ValueError:
    return ValueError(f"{count} files are none of {', '.join(kinds)}: {', '.join(names)}")


def read_json_dir(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    glob: str | None = None,
    lines: str = "*.jsonl",
    refuse: Sequence[str] = (),
    seen: Observation | None = None,
) -> DataFrame:
    """All JSON Lines files (``lines``) and ``.json`` files (an object or an array of objects) of a folder.

    Malformed lines, and lines and elements that hold no object, are skipped; ``seen`` is told how many ``records`` there were and how many of them were ``bad``
    by the pass that reads them (blank lines do not count). A missing folder is an error, as is a file of none of the kinds ``refuse`` lists, if any; a folder
    without such files gives no rows. With ``glob`` the files it matches are read as JSON Lines alone,
    which keeps large files divisible.
    """
    files, folder = path_object(spark, path)
    if not files.exists(folder):
        raise FileNotFoundError(path)
    if refuse:
        refuse_other_kinds(spark, path, refuse)
    found = spark.read.option("pathGlobFilter", glob or lines).text(path)
    if not glob:
        whole = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
        found = found.unionByName(_elements(whole))
    return _objects(found, schema, seen)


def _elements(whole: DataFrame) -> DataFrame:
    """Array files as one row per element, object files as they are."""
    parsed = whole.select("value", F.try_parse_json("value").alias("v"))
    is_list = F.schema_of_variant("v").startswith("ARRAY")
    items = F.when(is_list, F.try_variant_get("v", "$", "array<variant>"))
    return parsed.select(F.explode(F.coalesce(items, F.array("v"))).alias("v")).select(
        F.to_json("v").alias("value")
    )


def _objects(lines: DataFrame, schema: T.StructType | str, seen: Observation | None = None) -> DataFrame:
    good = F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(False))
    filled = F.coalesce(F.length(F.btrim("value", F.lit(" \t\r\n"))) > 0, F.lit(True))
    parsed = lines.select("value", good.alias("good"), filled.alias("filled"))
    if seen is not None:
        parsed = parsed.observe(seen, F.count_if("filled").alias("records"), F.count_if(F.col("filled") & ~F.col("good")).alias("bad"))
    return parsed.where("good").select(F.from_json("value", schema).alias("r")).select("r.*")


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split of a table partitioned by ``split``; the other partitions are not opened."""
    return spark.read.parquet(path).where(F.col("split") == split)


def read_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    sep: str = ",",
    header: bool = True,
    multi_line: bool = False,
) -> DataFrame:
    """Delimited text with a stated schema; values with line breaks need ``multi_line``, one task per file."""
    return spark.read.csv(path, schema=schema, sep=sep, header=header, multiLine=multi_line, escape='"')


def read_documents(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """``path, text`` of each ``.txt`` file that is not empty, with ``recursive`` those in folders below too; a file of another kind is an error.

    Folders are listed by tasks, a task for each folder at most, into a written table, and files are opened through ``pyarrow.fs``, so that the driver
    holds no file names. Where ``pyarrow.fs`` has no such file system, or the path is a pattern or a file, Spark lists the files in the driver.
    """
    files, folder = path_object(spark, path)
    if files.exists(folder) and files.getFileStatus(folder).isDirectory():
        base = folder.makeQualified(files.getUri(), files.getWorkingDirectory()).toString().rstrip("/")
        if _opens(base):
            shown = re.sub("^file:/+", "file:/", files.getFileStatus(folder).getPath().toUri().toString().rstrip("/"))
            return _read_files(spark, base, shown, ".txt", recursive)
    refuse_other_kinds(spark, path, [".txt"], recursive)
    texts = spark.read.option("pathGlobFilter", "*.txt").option("recursiveFileLookup", recursive).text(path, wholetext=True)
    return texts.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _store(base: str) -> tuple[fs.FileSystem, str]:
    """The file system of a qualified path, and the path in it."""
    return (fs.LocalFileSystem(), "/" + base[5:].lstrip("/")) if base.startswith("file:/") else fs.FileSystem.from_uri(base)


def _opens(base: str) -> bool:
    try:
        store, root = _store(base)
        return store.get_file_info(root).type == fs.FileType.Directory
    except (OSError, pa.ArrowException):
        return False


def _listing(spark: SparkSession, base: str, kind: str, recursive: bool) -> DataFrame:
    """``name, size, what, passed`` of what is in a folder, by paths relative to it: ``file`` (ends in ``kind``), ``other`` or ``folder``.

    Names that Spark takes for hidden ones are left out. ``passed``: below a name with an underscore, where other kinds do not matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(base)
        for batch in batches:
            for above, passed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                place = f"{above}/" if above else ""
                found = store.get_file_info(fs.FileSelector(f"{root}/{above}".rstrip("/") or "/"))
                for start in range(0, len(found), 4096):
                    rows = []
                    for info in found[start : start + 4096]:
                        name, inside = info.base_name, info.type == fs.FileType.Directory
                        if name.startswith(".") or (name.startswith("_") and "=" not in name):
                            continue
                        below = passed or name.startswith("_")
                        if inside and recursive:
                            rows.append((place + name, 0, "folder", below))
                        elif not inside and name.endswith(kind) and info.size != 0:
                            rows.append((place + name, info.size or 0, "file", below))
                        elif not below and not name.endswith(kind):
                            rows.append((place + name, 0, "other", below))
                    columns = zip(*rows) if rows else [()] * 4
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.bool_()))],
                        names=["name", "size", "what", "passed"],
                    )

    folders = spark.createDataFrame([("", False)], "name string, passed boolean")
    found = None
    while True:
        here = materialize(folders.mapInArrow(run, "name string, size long, what string, passed boolean"), "listing")
        found = here if found is None else found.unionByName(here)
        folders = here.where("what = 'folder'").select("name", "passed")
        if not folders.head(1):
            return found
        folders = folders.repartition(2 * spark.sparkContext.defaultParallelism)


def _read_files(spark: SparkSession, base: str, shown: str, kind: str, recursive: bool) -> DataFrame:
    found = _listing(spark, base, kind, recursive)
    is_file = F.col("what") == "file"
    sums = found.agg(F.count_if(F.col("what") == "other").alias("other"), F.count_if(is_file).alias("n"), F.sum("size").alias("bytes")).first()
    if sums["other"]:
        last = F.substring_index("name", "/", -1).alias("name")
        names = found.where("what = 'other'").select(last).orderBy("name").limit(5).collect()
        raise _refused(sums["other"], [kind], [row["name"] for row in names])
    parts = max(-(-(sums["bytes"] or 0) // _TASK_BYTES), -(-sums["n"] // _TASK_FILES), min(sums["n"], spark.sparkContext.defaultParallelism), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(base)
        for batch in batches:
            paths, texts, held = [], [], 0
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(f"{root.rstrip('/')}/{name}", compression=None) as file:
                    texts.append(file.read())
                # as a Java URI shows it
                paths.append("".join(c if c > "\x9f" and not c.isspace() else quote(c, safe="/_-!.~'()*,;:$&+=@") for c in f"/{name}"))
                held += len(texts[-1])
                if held >= _BATCH_BYTES or len(texts) >= 1024:
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.binary())], names=["path", "text"])
                    paths, texts, held = [], [], 0
            if texts:
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.binary())], names=["path", "text"])

    read = found.where(is_file).select("name").repartition(int(parts)).mapInArrow(run, "path string, text binary")
    return read.select(F.concat(F.lit(shown), "path").alias("path"), F.col("text").cast("string").alias("text"))


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, line_number, line`` in file order.

    Large files are read in parallel blocks: a line's place is its block's start, then its place within
    the block.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__at"),
        F.col("value").alias("line"),
    )
    numbered = with_row_index(lines, ["__block", "__at"], within=["path"], name="line_number")
    return numbered.select("path", "line_number", "line")


def join_binaries(table: DataFrame, path_column: str, folder: str, glob: str = "*") -> DataFrame:
    """Rows with the bytes of the file their relative path names; nothing is decoded."""
    spark = table.sparkSession
    files, root = path_object(spark, folder)
    base = root.makeQualified(files.getUri(), files.getWorkingDirectory()).toString().rstrip("/") + "/"
    payloads = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(folder)
        .select(F.replace("path", F.lit(base), F.lit("")).alias(path_column), "length", "content")
    )
    return table.join(payloads, path_column)


