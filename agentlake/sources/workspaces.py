"""Directory trees as tables.

Spark's own file source leaves out names starting with ``.`` or ``_`` and empty
files, which a workspace may well contain, so listing and reading run as tasks here.
Roots must lie on storage all executors see: a shared path, or a URI that
``pyarrow.fs`` understands.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentlake.operators.rules import filter_workspace_files
from agentlake.operators.transfers import manifest_order

_FOUND = "run_id string, root string, path string, size bigint, is_dir boolean"
_BATCH_ROWS = 4096
_BATCH_BYTES = 2 << 20


def _is_local(uri: str) -> bool:
    return "://" not in uri and not uri.startswith("file:")


def _local(uri: str) -> str:
    return uri[len("file:"):].replace("//", "/", 1) if uri.startswith("file:") else uri


def _children(root: str, rel: str, links: bool) -> Iterator[tuple[str, int, bool]]:
    """``(relative path, size, is_dir)`` of one directory; of the file itself for a file root."""
    if _is_local(root) or root.startswith("file:"):
        base = _local(root)
        if os.path.isfile(base):
            yield os.path.basename(base), os.path.getsize(base), False
            return
        with os.scandir(os.path.join(base, rel)) as entries:
            for entry in entries:
                path = os.path.join(rel, entry.name)
                if entry.is_dir(follow_symlinks=False):
                    yield path, 0, True
                elif entry.is_file(follow_symlinks=links):
                    yield path, entry.stat().st_size, False
    else:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        for info in store.get_file_info(fs.FileSelector(f"{base}/{rel}" if rel else base)):
            yield os.path.join(rel, info.base_name), info.size or 0, info.type == fs.FileType.Directory


def _read(root: str, path: str) -> bytes:
    """Bytes of one file, line ends as newlines. Failed reads fail the task."""
    if _is_local(root) or root.startswith("file:"):
        base = _local(root)
        with open(base if os.path.isfile(base) else os.path.join(base, path), "rb") as handle:
            raw = handle.read()
    else:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        with store.open_input_stream(f"{base}/{path}") as handle:
            raw = handle.read()
    return raw.replace(b"\r\n", b"\n").replace(b"\r", b"\n") if b"\r" in raw else raw


def _texts(contents: list[bytes]) -> pa.Array:
    """The contents as strings; undecodable ones are empty. Never held as Python text."""
    raw = pa.array(contents, pa.binary())
    try:
        return raw.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.concat_arrays([_text(raw.slice(i, 1)) for i in range(len(raw))])


def _text(one: pa.Array) -> pa.Array:
    try:
        return one.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([""])


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``run_id, path, content`` of listed files, in batches of ``_BATCH_BYTES`` or one file more."""

    def taken(rows, contents):
        return pa.RecordBatch.from_arrays(
            [pa.array([r["run_id"] for r in rows], pa.string()), pa.array([r["path"] for r in rows], pa.string()), _texts(contents)],
            ["run_id", "path", "content"],
        )

    for batch in batches:
        rows, contents, held = [], [], 0
        for row in batch.select(["run_id", "root", "path"]).to_pylist():
            rows.append(row)
            contents.append(_read(row["root"], row["path"]))
            held += len(contents[-1])
            if held >= _BATCH_BYTES:
                out = taken(rows, contents)
                rows, contents, held = [], [], 0
                yield out
                out = None
        if rows:
            yield taken(rows, contents)
    pa.default_memory_pool().release_unused()


def _expander(links: bool, deep: bool):
    """Replace directory rows by their children, or by everything below them."""

    def expand(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                if not row.is_dir:
                    out.append(tuple(row))
                    continue
                pending = [row.path]
                while pending:
                    for path, size, is_dir in _children(row.root, pending.pop(), links):
                        if is_dir and deep:
                            pending.append(path)
                        else:
                            out.append((row.run_id, row.root, path, size, is_dir))
                    if len(out) >= _BATCH_ROWS:
                        yield pd.DataFrame(out, columns=pdf.columns)
                        out = []
            yield pd.DataFrame(out, columns=pdf.columns)

    return expand


def _spread(df: DataFrame) -> DataFrame:
    # A fixed count: rows are tiny, so adaptive coalescing would put them in one task.
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, "run_id", "path")


def _list_files(roots: DataFrame, links: bool) -> DataFrame:
    """All files below ``roots(run_id, root)``.

    The first two levels are listed one directory per row and spread again, so one
    large root is walked by many tasks.
    """
    found = roots.selectExpr("CAST(run_id AS STRING) AS run_id", "root", "'' AS path", "0L AS size", "true AS is_dir")
    for deep in (False, False, True):
        found = _spread(found).mapInPandas(_expander(links, deep), _FOUND)
    return found


def scan_manifest(roots: DataFrame) -> DataFrame:
    """``(run_id, path, size, ord)`` of every file, without symlinks or content.

    ``ord`` is the file's position in its run, depth first, siblings by name. A root may be
    a single file. The list is spread once more, so that ordering it reads no directory again.
    """
    return manifest_order(list_files(roots), ("run_id",))


def list_files(roots: DataFrame) -> DataFrame:
    """``(run_id, path, size)`` of every file, in no order."""
    return _spread(_list_files(roots, links=False)).select("run_id", "path", "size")


def scan_workspaces(roots: DataFrame) -> DataFrame:
    """``(run_id, path, content)`` of every file not named ``.*`` or ``_exec_tmp*``."""
    listed = filter_workspace_files(_list_files(roots, links=True))
    return _spread(listed).mapInArrow(_contents, "run_id string, path string, content string")


def roots_table(df: DataFrame, run_id: str, prefix: str) -> DataFrame:
    """Roots named after a key column: ``<prefix><run_id>``."""
    return df.select(F.col(run_id).cast("string").alias("run_id")).distinct().withColumn(
        "root", F.concat(F.lit(prefix), F.col("run_id"))
    )
