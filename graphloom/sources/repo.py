"""Repositories: root, files, version-control history."""

from __future__ import annotations

import fnmatch
import os
import re
import subprocess
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.shipping import shipped


def repo_root(start: str | Path) -> Path:
    """The nearest folder from ``start`` up with a ``.git`` in it, file or folder."""
    at = Path(start).resolve()
    for folder in (at, *at.parents):
        if (folder / ".git").exists():
            return folder
    raise FileNotFoundError(f"no repository around {start}")


def ignore_pattern(lines: list[str]) -> str | None:
    """One regular expression for relative paths that the ignore patterns (without negation) exclude; null if there are none."""
    out = []
    for line in lines:
        glob = line.strip()
        if not glob or glob.startswith(("#", "!")):
            continue
        body = fnmatch.translate(glob.strip("/")).removeprefix("(?s:").removesuffix(")\\z").removesuffix(")\\Z")
        body = body.replace(".*", "[^/]*") if "**" not in glob else body
        ahead = "^" if glob.startswith("/") or "/" in glob.strip("/") else "(?:^|/)"
        out.append(f"{ahead}{body}{'/' if glob.endswith('/') else '(?:/|$)'}")
    return "|".join(out) or None


def glob_regex(glob: str) -> str:
    """A glob of an ignore file as a regular expression of Java; ``*`` and ``?`` stop at ``/``, and ``**`` doesn't."""
    out, k = [], 0
    while k < len(glob):
        c = glob[k]
        if glob.startswith("**/", k) and (k == 0 or glob[k - 1] == "/"):
            out.append("(?:.*/)?")
            k += 3
            continue
        if glob.startswith("**", k):
            out.append(".*")
            k += 2
            continue
        if c == "[" and (end := glob.find("]", k + 2)) > 0:
            inside = glob[k + 1 : end]
            out.append("[" + ("^" if inside[0] in "!^" else "") + re.sub(r"([\\[&])", r"\\\1", inside.lstrip("!^") if inside[0] in "!^" else inside) + "]")
            k = end + 1
            continue
        if c == "\\" and k + 1 < len(glob):
            k, c = k + 1, glob[k + 1]
            out.append(re.escape(c))
        else:
            out.append("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c))
        k += 1
    return "".join(out)


def ignore_rules(folder: str, text: str) -> list[tuple[str, bool, bool]]:
    """``(regular expression of a whole path, excluded or let in again, folders only)`` of an ignore file in a folder ("" is the root)."""
    out = []
    base = re.escape(f"{folder}/") if folder else ""
    for line in text.splitlines():
        line = re.sub(r"(?<!\\) +$", "", line)
        if not line or line.startswith("#"):
            continue
        back, line = line.startswith("!"), line.removeprefix("!")
        folders, glob = line.endswith("/"), line.rstrip("/")
        anchored = "/" in glob
        if glob := glob.removeprefix("/"):
            out.append((f"^{base}{'' if anchored else '(?:.*/)?'}{glob_regex(glob)}$", not back, folders))
    return out


def is_ignored(path: Column, rules: list[tuple[str, bool, bool]]) -> Column:
    """Whether a path, or a folder that it lies in, is excluded: the last rule that fits each of them counts."""
    runs: list[tuple[list[str], bool, bool]] = []
    for regex, excluded, folders in rules:  # neighbours of one effect in one expression
        if runs and runs[-1][1:] == (excluded, folders):
            runs[-1][0].append(regex)
        else:
            runs.append(([regex], excluded, folders))

    def state(at: Column, folder: bool) -> Column:
        out = F.lit(False)
        for regexes, excluded, folders in runs:
            if folder or not folders:
                out = F.when(at.rlike("|".join(regexes)), F.lit(excluded)).otherwise(out)
        return out

    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return state(path, False) | ((F.size(parts) > 1) & F.exists(above, lambda d: state(d, True)))


def skipped_by_reader(path: str, size: int) -> bool:
    """Spark's file readers leave out empty files, and names of files or folders that begin with ``_`` or ``.``."""
    return size == 0 or any(x.startswith(".") or (x.startswith("_") and "=" not in x) or x.endswith("._COPYING_") for x in path.split("/"))


def _listing(spark: SparkSession, root: str) -> Iterator[tuple[str, int]]:
    """Relative path and size of every file but those in ``.git``. Symbolic links are not followed."""
    if local := _local(root):
        for folder, names, files in os.walk(local):
            rel = os.path.relpath(folder, local).replace(os.sep, "/")
            names[:] = [n for n in names if not (rel == "." and n == ".git")]
            for f in files:
                if os.path.isfile(full := os.path.join(folder, f)):
                    yield f if rel == "." else f"{rel}/{f}", os.path.getsize(full)
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    todo = [("", path)]
    while todo:
        above, folder = todo.pop()
        for x in fs.listStatus(folder):
            rel = f"{above}{x.getPath().getName()}"
            if x.isDirectory():
                todo += [] if rel == ".git" else [(f"{rel}/", x.getPath())]
            else:
                yield rel, x.getLen()


def _local(root: str) -> str | None:
    """The plain path of a root that lies in a local or mounted file system."""
    return re.sub(r"^file:/*", "/", root) if re.match(r"^(file:|/)", root) else None


def _left_out(spark: SparkSession, root: str) -> DataFrame:
    """``path, content`` of the files that Spark's readers skip. Under a plain path the executors open them; in another store the driver
    reads them one by one through Hadoop's file system, as no reader of Spark returns such names."""
    names = [p for p, n in _listing(spark, root) if skipped_by_reader(p, n)]
    schema = "path string, content binary"
    if not names:
        return spark.createDataFrame([], schema)
    if local := _local(root):

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for path in batch.column(0).to_pylist():  # a batch a file: contents may be large
                    with open(f"{local.rstrip('/')}/{path}", "rb") as f:
                        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([f.read()], pa.binary())], names=["path", "content"])

        return shipped(spark.createDataFrame([(n,) for n in names], "path string")).mapInArrow(read, schema)
    jvm, base = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    rows = []
    for n in names:
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(base, f"./{n}"))
        rows.append((n, bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))))
        stream.close()
    return spark.createDataFrame(rows, schema)


def discover(spark: SparkSession, root: str, ignored: list[str] | None = None, ignore_files: tuple[str, ...] = (".gitignore",)) -> DataFrame:
    """``path`` (relative), ``language, content_hash, line_count, content`` of all files but ignored ones and those in ``.git``.

    Hidden and empty files count. The folder can be on any store that Spark reads; most files are listed and read by Spark, the
    others (see ``skipped_by_reader``) are listed by the driver. What the ``ignore_files`` of any folder exclude is left out, those
    of inner folders going before those of outer ones, and of one folder the later names before the earlier.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/").split(":", 1)[-1].lstrip("/")) + "/", "")
    hidden = _left_out(spark, root)
    files = files.select(rel.alias("path"), "content").unionByName(hidden).filter(~F.col("path").rlike(r"^\.git/"))
    lists = files.filter(F.substring_index("path", "/", -1).isin(*ignore_files)) if ignore_files else files.limit(0)
    found = [("/".join(r.path.split("/")[:-1]), r.path.rsplit("/", 1)[-1], bytes(r.content or b"")) for r in lists.toLocalIterator()]
    found.sort(key=lambda x: (x[0].count("/") + bool(x[0]), x[0], ignore_files.index(x[1])))
    if rules := [rule for folder, _, content in found for rule in ignore_rules(folder, content.decode("utf-8", "replace"))]:
        files = files.filter(~is_ignored(F.col("path"), rules))
    if pattern := ignore_pattern(ignored or []):
        files = files.filter(~F.col("path").rlike(pattern))
    text = F.col("content").cast("string")
    return files.select("path", T.language(F.col("path")).alias("language"), F.sha2("content", 256).alias("content_hash"), T.line_count(text).alias("line_count"), "content")


def read_file(spark: SparkSession, root: str, path: str) -> DataFrame:
    """``content`` of one file, whatever its name."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(jvm.org.apache.hadoop.fs.Path(root), f"./{path}")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return spark.createDataFrame([], "content binary")
    stream = fs.open(at)
    try:
        return spark.createDataFrame([(bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)),)], "content binary")
    finally:
        stream.close()


def parse_log(log: str) -> list[tuple[str, str, str, str, str, list[str]]]:
    """Commits of ``git log --name-only`` whose headers begin with a record separator and have unit separators."""
    out = []
    for record in log.split("\x1e")[1:]:
        head, *names = record.strip("\n").split("\n")
        commit, author, email, date, message = head.split("\x1f", 4)
        out.append((commit, author, email, date, message, [n for n in names if n]))
    return out


def git_history(spark: SparkSession, root: str, limit: int = 0) -> tuple[DataFrame, DataFrame]:
    """Commits and their files of a local clone. ``limit`` 0: all."""
    command = ["git", "-C", root, "log", "--pretty=format:%x1e%H%x1f%an%x1f%ae%x1f%ai%x1f%s", "--name-only", *([f"-{limit}"] if limit else [])]
    rows = parse_log(subprocess.run(command, capture_output=True, text=True, check=True).stdout)
    commits = spark.createDataFrame([(k, *r[:5]) for k, r in enumerate(rows)], "id long, commit_hash string, author_name string, author_email string, authored_date string, message string")
    files = spark.createDataFrame([(k, f) for k, r in enumerate(rows) for f in r[5]], "commit_id long, item string")
    return commits, files


def changed_lines(patch: str) -> list[int]:
    """Lines of the new file that a patch adds, or beside which it removes; removals don't move the place."""
    out: set[int] = set()
    at = 0
    for line in patch.split("\n"):
        if m := re.match(r"@@ -\S+ \+(\d+)", line):
            at = int(m[1])
        elif at and line.startswith("+") and not line.startswith("+++"):
            out.add(at)
            at += 1
        elif at and line.startswith("-") and not line.startswith("---"):
            out.add(at)
        elif at and not line.startswith("\\"):
            at += 1
    return sorted(out)


def changed_symbols(patch: str, symbols: list[tuple[str, int, int]]) -> list[str]:
    """Names of the symbols (name, first, last line) that a patch touches."""
    lines = changed_lines(patch)
    return [name for name, first, last in symbols if any(first <= n <= last for n in lines)]
