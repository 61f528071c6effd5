"""Source trees: C and C++ files, and the functions in them."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.kept import numbered

# Suffixes of source files, caps, and the shape of a function's head at the start of a line.
SUFFIXES = (".c", ".h", ".cc", ".cpp")
MAX_FILES, MAX_FUNCTIONS = 2000, 5000
HEAD = re.compile(r"(?P<ret>^[A-Za-z_][\w\s\*\(\)]*?)\s+(?P<name>[A-Za-z_]\w*)\s*\((?P<args>[^;{}]*)\)\s*\{", re.MULTILINE)


def read_tree(spark: SparkSession, root: str, max_files: int | None = MAX_FILES) -> DataFrame:
    """(file_path, content, order) of source files below root; order is that of a walk that lists a folder's files before its subfolders, both sorted.

    file_path is relative to root. max_files keeps the first files of that order; None keeps all.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    suffix = F.lit(False)
    for s in SUFFIXES:
        suffix = suffix | F.col("path").endswith(s)
    files = files.filter(suffix)
    base = re.sub("^[a-z0-9+]+:/*", "/", root).rstrip("/") + "/"
    plain = F.regexp_replace("path", "^[a-zA-Z0-9+]+:/*", "/")
    relative = F.when(F.startswith(plain, F.lit(base)), F.substring(plain, F.lit(len(base) + 1), F.lit(1 << 30))).otherwise(plain)
    parts = F.split(relative, "/")
    rows = files.select(relative.alias("file_path"), "content", F.slice(parts, F.lit(1), F.size(parts) - 1).alias("_dirs"), F.element_at(parts, -1).alias("_file"))
    if max_files is not None:
        first = rows.select("file_path", "_dirs", "_file").orderBy("_dirs", "_file").limit(max_files)
        rows = rows.join(F.broadcast(first.select("file_path")), "file_path", "left_semi") if max_files <= 100_000 else rows.join(first.select("file_path"), "file_path", "left_semi")
    return rows.select("file_path", "content", F.struct("_dirs", "_file").alias("order"))


def body_end(text: str, at: int) -> int:
    """End of the block that opens at a brace: braces in strings and comments count too; an open block ends with the text."""
    depth = 0
    for m in re.compile("[{}]").finditer(text, at):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.end()
    return len(text)


def functions_in(text: str) -> Iterator[tuple[int, str, int, int, str]]:
    """(number in the file, name, first line, last line, body) of each function."""
    for k, m in enumerate(HEAD.finditer(text)):
        end = body_end(text, m.end() - 1)
        yield k, m["name"], text.count("\n", 0, m.start()) + 1, text.count("\n", 0, end) + 1, text[m.end() - 1 : end]


FOUND = "file_path string, _at int, function_name string, start_line int, end_line int, source_code string"


def _extract(order_field: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["file_path", "_at", "function_name", "start_line", "end_line", "source_code"]
        for batch in batches:
            rows = []
            for path, content in zip(batch["file_path"], batch["content"], strict=True):
                text = bytes(content or b"").decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n")
                rows += [(path, *f) for f in functions_in(text)]
            yield pd.DataFrame(rows, columns=names).astype({"_at": "int32", "start_line": "int32", "end_line": "int32"})

    return run


def extract_functions(files: DataFrame, backend: str | None = "regex", max_functions: int | None = MAX_FUNCTIONS, library: str | None = None, include_dirs: Sequence[str] = (), extra_args: Sequence[str] = ()) -> DataFrame:
    """Functions of (file_path, content, order), with ids from 1 in the order of files and of text.

    Backends: regex (the default, also for null); clang where its bindings are installed, with the library, include
    folders and further arguments that are given. Bytes that are no UTF-8
    are dropped. Files are parsed on the executors. With a cap the ids come from one window over at most that many
    rows; without one (None) from sorted partitions, so that no task sees all rows.
    """
    backend = (backend or "regex").lower()
    if backend == "clang":
        try:
            import clang.cindex  # noqa: F401
        except ImportError as e:
            raise RuntimeError("the clang backend needs clang's Python bindings; the regex backend needs nothing") from e
        from .clang_tree import extract

        found = extract(files, library, include_dirs, extra_args)
    elif backend == "regex":
        found = files.select("file_path", "content").mapInPandas(_extract(True), FOUND)
    else:
        raise ValueError(f"unknown backend {backend!r}")
    found = found.join(files.select("file_path", "order"), "file_path")
    if max_functions is not None:
        first = found.orderBy("order", "_at").limit(max_functions)
        out = first.withColumn("function_id", F.row_number().over(Window.orderBy("order", "_at")))
    else:
        out = numbered(found, "function_id", ["order", "_at"], first=1).withColumn("function_id", F.col("function_id").cast("int"))
    return out.select("function_id", "function_name", "file_path", "start_line", "end_line", "source_code")


def blocks(rows: DataFrame, ident: str, text: str) -> DataFrame:
    """Functions of texts that are already in a table: (ident, at, function_name, start_line, end_line, source_code)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(i, *f) for i, t in zip(batch[ident], batch[text], strict=True) for f in functions_in(t or "")]
            yield pd.DataFrame(out, columns=[ident, "at", "function_name", "start_line", "end_line", "source_code"]).astype({ident: "int64", "at": "int32", "start_line": "int32", "end_line": "int32"})

    return rows.select(F.col(ident).cast("bigint").alias(ident), text).mapInPandas(run, f"{ident} bigint, at int, function_name string, start_line int, end_line int, source_code string")
