"""Text files as documents, by glob patterns; small tables dealt to all cores."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed value: folders that are never entered
IGNORED = ("node_modules", ".git", "dist", ".next", ".turbo")


#: Bytes that are worth a task of their own; a table that fills all cores with so much each is read as it lies.
SPREAD_BYTES = 256 << 10


def spread(df: DataFrame) -> DataFrame:
    """A small table dealt to all cores: one row group is one task otherwise, however costly its texts are.

    Decided by the size that the planner knows; beyond 64 times ``SPREAD_BYTES`` a core nothing is moved.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if size > 64 * SPREAD_BYTES * cores else df.repartition(max(1, min(cores, size // SPREAD_BYTES)))


def glob_pattern(glob: str) -> str:
    """An anchored pattern: ``?`` one character and ``*`` a run of them within a name, ``**`` any run of folders."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i]))
            i += 1
    return f"^{out}$"


def static_root(glob: str) -> str:
    """The part of a pattern before its first wildcard, up to a folder."""
    head = re.split(r"[*?]", glob, maxsplit=1)[0]
    return head if head == glob else head.rpartition("/")[0] or ("/" if head.startswith("/") else ".")


def match_paths(paths: DataFrame, globs: Sequence[str], path_col: str = "path") -> DataFrame:
    """Rows whose path fits one of the patterns and lies in no ignored folder."""
    ignored = "(^|/)(" + "|".join(re.escape(x) for x in IGNORED) + ")/"
    fits = F.lit(False)
    for g in globs:
        fits = fits | F.col(path_col).rlike(glob_pattern(g))
    return paths.filter(fits & ~F.col(path_col).rlike(ignored))


def list_files(spark: SparkSession, globs: Sequence[str], cwd: str = ".") -> list[str]:
    """Paths of files that fit a pattern, each once and sorted; ignored folders are never entered, hidden names are.

    A pattern without a wildcard is a path; one that names no file gives nothing. Listing goes through the driver's
    file system, as Spark's own does.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path_of = lambda x: jvm.org.apache.hadoop.fs.Path(x)
    bare = lambda st: re.sub("^file:/+", "/", st.getPath().toString())
    found: set[str] = set()
    for g in globs:
        g = g if g.startswith("/") or "://" in g else f"{cwd.rstrip('/')}/{g}"
        g = g if "://" in g else posixpath.abspath(g)
        literal = not re.search(r"[*?]", g)
        root = path_of(static_root(g))
        fs = root.getFileSystem(conf)
        if not fs.exists(root):
            continue
        if literal:
            st = fs.getFileStatus(root)
            found |= {bare(st)} if st.isFile() else set()
            continue
        fits, folders = re.compile(glob_pattern(g), re.S), [root]
        while folders:
            for st in fs.listStatus(folders.pop()):
                if st.isDirectory():
                    if st.getPath().getName() not in IGNORED:
                        folders.append(st.getPath())
                elif fits.match(bare(st)):
                    found.add(bare(st))
    return sorted(found)


def _hidden(path: str) -> bool:
    """Whether Spark's sources pass a file over by its name."""
    name = path.rpartition("/")[2]
    return name.startswith((".", "_"))


def read_files(spark: SparkSession, globs: Sequence[str], cwd: str = ".") -> DataFrame:
    """path, text of every file that fits a pattern, each once.

    Files are read by Spark's text source; the few whose names it passes over (``_x``, ``.x``) by their paths on the
    workers. Bytes that aren't UTF-8 become replacement characters there.
    """
    paths = list_files(spark, globs, cwd)
    shown, hidden = [p for p in paths if not _hidden(p)], [p for p in paths if _hidden(p)]
    out = spark.createDataFrame([], "path string, text string")
    if shown:
        read = spark.read.text([_escaped(p) for p in shown], wholetext=True)
        out = read.select(F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^file:/+", "/").alias("path"), F.col("value").alias("text"))
    if hidden:
        import pyarrow as pa
        from pyarrow import fs

        def read_one(path: str) -> str:
            store, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
            with store.open_input_stream(at, compression=None) as f:
                return f.read().decode("utf-8", "replace")

        def work(batches):
            for b in batches:
                for p in b.column("path").to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([read_one(p)])], names=["path", "text"])

        names = spark.createDataFrame([(p,) for p in hidden], "path string").repartition(min(len(hidden), spark.sparkContext.defaultParallelism))
        out = out.unionByName(names.mapInArrow(work, "path string, text string")) if shown else names.mapInArrow(work, "path string, text string")
    return out


def _escaped(path: str) -> str:
    """A path as a pattern of Spark's sources that means just itself."""
    return re.sub(r"[\\{}\[\]*?,]", lambda m: "\\" + m.group(0), path)
