"""Writing the folder layouts that the file readers expect: many files of given names, or a folder a key, in one distributed write.

Rows go to files by a path column; Spark writes one folder of part files per path, and the driver gives each part its name
through the file system of the target (a rename per file; no data passes the driver). Works on any file
system that Spark writes to."""

from __future__ import annotations

import re
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: what Spark writes as %XX in the name of a folder, and its folder for null and empty keys
ESCAPED = frozenset([*map(chr, range(1, 32)), *"\"#%'*/:=?\\\x7f{[]^"])
NO_KEY = "__HIVE_DEFAULT_PARTITION__"
#: types that Arrow writes to Parquet as Spark does, those of a key, and codecs by Spark's names
PLAIN = ("bigint", "int", "smallint", "tinyint", "double", "float", "boolean", "string", "binary", "date")
KEYS = ("bigint", "int", "smallint", "tinyint", "boolean", "string", "date")
CODECS = {"snappy": "snappy", "zstd": "zstd", "gzip": "gzip", "none": "none", "uncompressed": "none"}
#: bytes of a folder's rows that a task holds before they go to its file, and bytes a checksum of Hadoop's local files
ROW_GROUP = 64 << 20
SUMMED = 512


def write_files(df: DataFrame, place: str, path_col: str, order: list[str], fmt: str = "csv") -> int:
    """Writes ``df`` to ``place``/{value of ``path_col``}, rows by ``order``; csv files get a header, text files hold the one other
    column. Returns the number of files. Columns of ``order`` that start with an underscore are not written. One file is one
    task's stream, so a file may be larger than memory; different files are spread."""
    spark = df.sparkSession
    parts = f"{place}/_parts"
    keep = [c for c in df.columns if c not in order or not c.startswith("_")]
    rows = df.repartition(path_col).sortWithinPartitions(path_col, *order).select(*keep)
    writer = rows.write.partitionBy(path_col)
    writer.option("header", True).csv(parts) if fmt == "csv" else writer.text(parts)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    files = path(parts).getFileSystem(conf)
    n = 0
    for folder in files.listStatus(path(parts)):
        if not folder.isDirectory():
            continue
        name = unquote(folder.getPath().getName().split("=", 1)[1])
        for part in files.listStatus(folder.getPath()):
            if part.getPath().getName().startswith("part-"):
                target = path(f"{place}/{name}")
                files.mkdirs(target.getParent())
                if files.exists(target) or not files.rename(part.getPath(), target):
                    raise OSError(f"{target} is there already or can't be written")
                n += 1
    files.delete(path(parts), True)
    return n


def write_folders(df: DataFrame, place: str, key: str, tasks: int) -> None:
    """Writes ``df`` as Parquet to ``place``/``key``=value, one file a folder, over what is there, by ``tasks`` tasks.

    Spark's writer makes the folders on any file system. On a local (or mounted) one Hadoop starts a process for the mode of each folder
    and file, four a key, which takes far longer than the rows; there the tasks make the same layout themselves: names, types, modes,
    checksums beside the files and in their pages, rows by all columns, ``_SUCCESS`` at the end. A file gets its name when it is whole, and the
    same name and bytes in a repeated task. Types that Arrow stores otherwise go by Spark's writer."""
    spark, kinds = df.sparkSession, dict(df.dtypes)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    files, local = _local(spark, place)
    codec = CODECS.get(spark.conf.get("spark.sql.parquet.compression.codec").lower())
    others = [c for c in df.columns if c != key]
    rows = df.repartition(tasks, f"`{key}`")
    if local is None or codec is None or kinds.get(key) not in KEYS or not others or any(kinds[c] not in PLAIN for c in others):
        out = rows.write.mode("overwrite").option("mapreduce.fileoutputcommitter.algorithm.version", "2")  # tasks move their own folders, not the driver
        out.partitionBy(key).parquet(place)
        return
    name = F.col(f"`{key}`").cast("string")
    rows = rows.select(F.when(name != "", name).otherwise(NO_KEY).alias(key), *[f"`{c}`" for c in others])
    rows = rows.sortWithinPartitions(*[f"`{c}`" for c in [key, *others]])
    footer = {"org.apache.spark.version": spark.version, "org.apache.spark.sql.parquet.row.metadata": T.StructType([df.schema[c] for c in others]).json()}
    mask = jvm.org.apache.hadoop.fs.permission.FsPermission.getUMask(conf).toShort()
    files.delete(path(place), True)
    files.mkdirs(path(place))
    rows.mapInArrow(_folder_writer(local, key, codec, footer, mask), "folders long").collect()  # a number a task
    files.create(path(f"{place}/_SUCCESS")).close()


def read_folders(spark: SparkSession, place: str, key: str, schema: str, tasks: int) -> DataFrame:
    """The files of ``place``/``key``=value with the columns of ``schema``, ``key`` (a text there) among them, read by ``tasks`` tasks.

    Spark's discovery of partitions looks each folder up in a linked list: the driver's time grows with the square of their number. On a local
    (or mounted) file system each task lists the folders and reads those that are its own by a hash of the name; on others Spark reads the files
    as they are listed and the key comes from their paths. Columns that a file lacks are null."""
    fields = T.StructType.fromDDL(schema)
    rest = T.StructType([f for f in fields if f.name != key])
    _, local = _local(spark, place)
    if local is None or any(f.dataType.simpleString() not in PLAIN for f in rest):
        rows = spark.read.schema(rest).option("recursiveFileLookup", True).parquet(place)
        name = F.regexp_extract("_metadata.file_path", f"/{re.escape(_path_text(key))}=([^/]*)/[^/]*$", 1)
        for _ in range(2):  # of the path, then of the folder's name
            name = F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))
        rows = rows.withColumn(key, F.when(name != NO_KEY, name))
    else:
        rows = spark.range(0, tasks, 1, tasks).mapInArrow(_folder_reader(local, key, to_arrow_schema(rest), tasks), T.StructType([*rest, T.StructField(key, T.StringType())]))
    return rows.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in fields])


def _local(spark: SparkSession, place: str):
    """The file system of ``place``, and its path there if that is a local one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    target = files.makeQualified(path).toUri()
    return files, target.getPath() if target.getScheme() == "file" else None


def _path_text(text: str) -> str:
    return "".join(f"%{ord(c):02X}" if c in ESCAPED else c for c in text)


def _folder_writer(place: str, key: str, codec: str, footer: dict, mask: int):
    """The tasks of ``write_folders``: rows sorted by their first column, the folder."""
    # the function takes these along, so that workers need no module of this package
    escaped, group, summed, job, top = ESCAPED, ROW_GROUP, SUMMED, uuid.uuid4(), f"{place}/{_path_text(key)}="

    def write(batches):
        import os
        import zlib

        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        task = TaskContext.get()
        file = f"part-{task.partitionId():05d}-{job}.c000{'' if codec == 'none' else f'.{codec}'}.parquet"
        draft = f"_{file}.{task.taskAttemptId()}"

        class Sink:
            """A file, and Hadoop's checksums of it beside it."""

            def __init__(self, at):
                self.data, self.sums, self.rest, self.closed = open(at, "wb"), open(f"{at}.crc", "wb"), b"", False
                self.sums.write(b"crc\0" + summed.to_bytes(4, "big"))

            def add(self, n):
                self.sums.write(b"".join(zlib.crc32(self.rest[i:min(i + summed, n)]).to_bytes(4, "big") for i in range(0, n, summed)))
                self.rest = self.rest[n:]

            def write(self, piece):
                self.rest += piece
                self.add(len(self.rest) // summed * summed)
                return self.data.write(piece)

            def flush(self):
                pass

            def close(self):
                if not self.closed:
                    self.add(len(self.rest))
                    for f in (self.data, self.sums):
                        os.fchmod(f.fileno(), 0o666 & ~mask)
                        f.close()
                    self.closed = True

        def runs():
            for batch in batches:
                if batch.num_rows:
                    names, start = pc.run_end_encode(batch.column(0)), 0
                    rows = pa.Table.from_arrays(batch.columns[1:], schema=pa.schema([*batch.schema][1:], footer))
                    for name, end in zip(names.values.to_pylist(), names.run_ends.to_pylist()):
                        yield name, rows.slice(start, end - start)
                        start = end

        def store(name, rows, following):
            """Writes a folder of ``rows`` and all that follow with its name; returns the run after it."""
            folder = top + "".join(f"%{ord(c):02X}" if c in escaped else c for c in name)
            try:
                os.mkdir(folder)
                os.chmod(folder, 0o777 & ~mask)
            except FileExistsError:  # of a repeated task, or of null and empty keys
                pass
            held, size, after = [rows], rows.nbytes, None
            sink = Sink(f"{folder}/{draft}")
            with pq.ParquetWriter(sink, rows.schema, compression=codec, store_schema=False, write_page_checksum=True) as out:
                for after in following:
                    if after[0] != name:
                        break
                    if size > group:
                        out.write_table(pa.concat_tables(held))
                        held, size = [], 0
                    held.append(after[1])
                    size += after[1].nbytes
                    after = None
                out.write_table(pa.concat_tables(held))
            sink.close()
            os.replace(f"{folder}/{draft}.crc", f"{folder}/.{file}.crc")
            os.replace(f"{folder}/{draft}", f"{folder}/{file}")
            return after

        n, left = 0, runs()
        run = next(left, None)
        while run is not None:
            run = store(*run, left)
            n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["folders"])

    return write


def _folder_reader(place: str, key: str, schema, tasks: int):
    """The tasks of ``read_folders``: a row for each, its number; ``schema`` is Arrow's, without the key."""
    first, no_key, lot = f"{_path_text(key)}=", NO_KEY, 10_000

    def read(batches):
        import os
        import zlib
        from urllib.parse import unquote

        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        def pieces():
            own = {x for b in batches for x in b.column(0).to_pylist()}
            with os.scandir(place) as found:
                folders = [f.name for f in found if f.name.startswith(first) and zlib.crc32(os.fsencode(f.name)) % tasks in own]
            for folder in folders:
                name = unquote(folder[len(first):])
                for at in os.listdir(f"{place}/{folder}"):
                    if at[0] not in "._":
                        with open(f"{place}/{folder}/{at}", "rb") as f, pq.ParquetFile(f, page_checksum_verification=True) as file:
                            for rows in file.iter_batches(lot, columns=schema.names, use_threads=False):
                                yield None if name == no_key else name, rows

        def joined(held):
            columns = [pa.concat_arrays([r.column(f.name).cast(f.type) if f.name in r.schema.names else pa.nulls(r.num_rows, f.type) for _, r in held])
                       for f in schema]
            ends, end = [], 0
            for _, r in held:
                ends.append(end := end + r.num_rows)
            names = pa.RunEndEncodedArray.from_arrays(pa.array(ends, pa.int32()), pa.array([x for x, _ in held], pa.string()))
            return pa.RecordBatch.from_arrays([*columns, pc.run_end_decode(names)], names=[*schema.names, key])

        held, n = [], 0
        for name, rows in pieces():
            if rows.num_rows:
                held.append((name, rows))
                n += rows.num_rows
            if n >= lot:
                yield joined(held)
                held, n = [], 0
        if held:
            yield joined(held)

    return read
