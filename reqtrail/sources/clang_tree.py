"""Function extraction by libclang, for installations that have it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame

from .tree import FOUND


# Options of the parser.
OPTIONS = ("PARSE_INCOMPLETE", "PARSE_DETAILED_PROCESSING_RECORD")


def definitions(cindex, index, path: str, raw: bytes, args: Sequence[str]) -> Iterator[tuple]:
    """(path, number, name, first line, last line, whole text) of the definitions at the top level that lie in the file itself.

    Bytes that are no UTF-8 are dropped before the file is parsed, so that places in the parsed text are places in
    what the text is cut from. Where a place gives nothing, the lines do. A file that cannot be parsed gives no row.
    """
    text = raw.decode("utf-8", "ignore")
    clean, options = text.encode(), 0
    for name in OPTIONS:
        options |= getattr(cindex.TranslationUnit, name)
    try:
        unit = index.parse(path, args=list(args), unsaved_files=[(path, text)], options=options)
    except Exception:  # noqa: BLE001  whatever the bindings raise
        return
    at = 0
    for c in unit.cursor.get_children():
        first, last = c.extent.start, c.extent.end
        if c.kind != cindex.CursorKind.FUNCTION_DECL or not c.is_definition() or not first.file or str(first.file) != path:
            continue
        body = clean[first.offset : last.offset].decode("utf-8", "ignore").strip()
        body = body or "\n".join(text.splitlines()[first.line - 1 : last.line]).strip()
        yield path, at, c.spelling, first.line, last.line, body
        at += 1


def extract(files: DataFrame, library: str | None = None, include_dirs: Sequence[str] = (), extra_args: Sequence[str] = ()) -> DataFrame:
    """Definitions of each file of (file_path, content); see definitions()."""
    args = [f"-I{d}" for d in include_dirs] + list(extra_args)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from clang import cindex

        if library and not cindex.Config.loaded:
            cindex.Config.set_library_file(library)
        index = cindex.Index.create()
        for batch in batches:
            rows = [r for path, content in zip(batch["file_path"], batch["content"], strict=True) for r in definitions(cindex, index, path, bytes(content or b""), args)]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in FOUND.split(", ")]).astype({"_at": "int32", "start_line": "int32", "end_line": "int32"})

    return files.select("file_path", "content").mapInPandas(run, FOUND)
