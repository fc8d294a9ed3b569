"""Atomic and idempotent writers."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _publish(write, dest: Path) -> None:
    dest.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=dest.parent, prefix=f".{dest.name}.")
    try:
        with os.fdopen(handle, "wb") as f:
            write(f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, dest)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


def csv(df: DataFrame, dest: str, columns: list[str]) -> None:
    """One CSV file in this column order: absent columns and nulls are empty, others are left out.

    ``dest`` is a local path, replaced at once, or an address that Spark's writers can open (``scheme://...``), whose old file is
    taken away just before the new one gets its name.
    """
    picked = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns])
    if "://" in dest:
        _remote_csv(picked, dest)
        return
    target = Path(dest)
    target.parent.mkdir(parents=True, exist_ok=True)
    folder = tempfile.mkdtemp(dir=target.parent, prefix=f".{target.name}.")
    try:
        _write_csv(picked, f"{folder}/out")
        part = next(Path(f"{folder}/out").glob("part-*.csv"), None)
        if part is None:
            _publish(lambda f: f.write((",".join(columns) + "\n").encode()), target)
        else:
            os.replace(part, target)
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def _write_csv(df: DataFrame, folder: str) -> None:
    df.coalesce(1).write.mode("overwrite").csv(folder, header=True, quote='"', escape='"', emptyValue="", nullValue="", lineSep="\n")


def _remote_csv(df: DataFrame, dest: str) -> None:
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path
    target, made = path(dest), path(f"{dest}.{uuid.uuid4().hex}")
    store = target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    try:
        _write_csv(df, made.toString())
        parts = [f.getPath() for f in store.listStatus(made) if f.getPath().getName().startswith("part-")]
        if not parts:  # an empty table has no part
            out = store.create(path(made, "part-0.csv"), True)
            out.write(bytearray((",".join(df.columns) + "\n").encode()))
            out.close()
            parts = [path(made, "part-0.csv")]
        store.delete(target, False)
        if not store.rename(parts[0], target):
            raise OSError(f"could not write {dest}")
    finally:
        store.delete(made, True)


def json_document(value, dest: str) -> None:
    """Indented UTF-8 JSON, published whole."""
    _publish(lambda f: f.write((json.dumps(value, indent=2, ensure_ascii=False) + "\n").encode()), Path(dest))


def blob(dest: str, content: bytes) -> str:
    """"created", or "existing" where the same bytes are there; other bytes are an error."""
    path = Path(dest)
    if path.exists():
        if hashlib.sha256(path.read_bytes()).digest() == hashlib.sha256(content).digest():
            return "existing"
        raise FileExistsError(dest)
    _publish(lambda f: f.write(content), path)
    return "created"


def blobs(df: DataFrame, folder: str, name_col: str, content_col: str) -> None:
    """Every row's bytes as a file, from the tasks, each idempotently."""

    def write(rows) -> None:
        for r in rows:
            blob(f"{folder}/{r[name_col]}", bytes(r[content_col]))

    df.select(name_col, content_col).foreachPartition(write)


def labels(audit: DataFrame, folder: str) -> None:
    """One label file for every accepted row of an audit table."""

    def write(rows) -> None:
        for r in rows:
            _publish(lambda f: f.write((r["label_line"] + "\n").encode()), Path(folder) / f"{r['source_asset_id']}.txt")

    audit.where("status = 'accepted'").select("source_asset_id", "label_line").foreachPartition(write)


def prepare_output(folder: str, overwrite: bool = False) -> Path:
    """An empty output folder; one with files is refused, or emptied if ``overwrite``."""
    path = Path(folder)
    if path.exists() and any(path.iterdir()):
        if not overwrite:
            raise FileExistsError(f"not empty: {folder}")
        shutil.rmtree(path)
    path.mkdir(parents=True, exist_ok=True)
    return path
