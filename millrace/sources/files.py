"""Files: csv, tsv, json, parquet, orc, text, Arrow IPC (feather) and numpy, all read as Spark jobs over many files."""

from __future__ import annotations

import csv
import io

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = {"csv": "csv", "tsv": "tsv", "tab": "tsv", "json": "json", "ndjson": "json", "jsonl": "json", "parquet": "parquet", "pq": "parquet", "orc": "orc", "txt": "text", "feather": "feather", "arrow": "feather", "npy": "numpy", "npz": "numpy"}


def format_of(uri: str, given: str | None = None) -> str:
    """The extension wins over a stored format."""
    last = uri.rstrip("/").rsplit("/", 1)[-1].lower()
    for end in (".gz", ".bz2", ".zst"):
        last = last.removesuffix(end)
    return EXTENSIONS.get(last.rsplit(".", 1)[-1] if "." in last else "", given or "parquet")


def _sample(spark: SparkSession, uri: str, n: int = 50) -> list[str]:
    return [r.value for r in spark.read.text(uri).limit(n).collect()]


def sniff_delimiter(lines: list[str]) -> str:
    try:
        return csv.Sniffer().sniff("\n".join(lines[:20]), delimiters=",;\t|").delimiter
    except csv.Error:
        return ","


def has_header(lines: list[str], sep: str) -> bool:
    """A vote by column: the first row looks like names where at least 70 % of the rest looks like data."""
    rows = list(csv.reader(io.StringIO("\n".join(lines)), delimiter=sep))
    if len(rows) < 2:
        return bool(rows) and all(x and not _data(x) for x in rows[0])

    votes = 0
    for i, name in enumerate(rows[0]):
        rest = [r[i] for r in rows[1:] if i < len(r) and r[i] != ""]
        like = sum(_data(x) for x in rest) / len(rest) if rest else 0
        named = bool(name) and not _data(name)
        votes += 1 if named and like >= 0.7 else -1 if not named else 0
    distinct = len(set(rows[0])) == len(rows[0]) and all(rows[0])
    repeated = any(r == rows[0] for r in rows[1:])
    return votes > 0 or votes == 0 and distinct and not repeated and all(not _data(x) for x in rows[0])


def _data(x: str) -> bool:
    x = x.strip()
    try:
        float(x.replace(",", ""))
        return True
    except ValueError:
        return x.lower() in ("true", "false") or len(x) >= 8 and x[:4].isdigit() and x[4] in "-/"


def read(spark: SparkSession, uri: str, format: str | None = None, schema: str | None = None, **options) -> DataFrame:
    """One or many files. csv without ``sep`` or ``header`` finds them out from the first lines."""
    kind = format_of(uri, format)
    reader = spark.read.schema(schema) if schema else spark.read
    if kind in ("csv", "tsv"):
        sep, header = options.pop("sep", "\t" if kind == "tsv" else None), options.pop("header", None)
        if sep is None or header is None:
            lines = _sample(spark, uri)
            sep = sep or sniff_delimiter(lines)
            header = has_header(lines, sep) if header is None else header
        return reader.options(**{"inferSchema": schema is None, **options}).csv(uri, sep=sep, header=header)
    if kind == "json":
        if "multiLine" not in options:
            first = next((x.strip() for x in _sample(spark, uri, 5) if x.strip()), "")
            options["multiLine"] = first.startswith("[") or first == "{"
        return reader.options(**options).json(uri)
    if kind == "feather":
        return read_feather(spark, uri)
    if kind == "numpy":
        return read_numpy(spark, uri, **options)
    return reader.options(**options).format(kind).load(uri)


def write(df: DataFrame, uri: str, format: str | None = None, mode: str = "overwrite", compression: str | None = None, **options) -> None:
    """parquet, csv, tsv, json (a line each), orc, text or feather; parquet is written with zstd unless told otherwise."""
    kind = format_of(uri, format)
    if kind == "feather":
        return write_feather(df, uri, mode)
    w = df.write.mode(mode).options(**options)
    if compression or kind == "parquet":
        w = w.option("compression", compression or "zstd")
    if kind in ("csv", "tsv"):
        return w.csv(uri, sep=options.get("sep", "\t" if kind == "tsv" else ","), header=options.get("header", True))
    return w.format({"ndjson": "json"}.get(kind, kind)).save(uri)


def _binary(spark: SparkSession, uri: str) -> DataFrame:
    return spark.read.format("binaryFile").load(uri).select("path", "content")


def read_feather(spark: SparkSession, uri: str) -> DataFrame:
    """Arrow IPC files; the first one gives the schema."""
    from pyspark.sql.pandas.types import from_arrow_schema

    files = _binary(spark, uri)
    first = files.limit(1).first()
    if first is None:
        raise ValueError(f"no files at {uri}")
    schema = from_arrow_schema(pa.ipc.open_file(io.BytesIO(first.content)).schema)

    def load(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                source = pa.ipc.open_file(io.BytesIO(content))
                for i in range(source.num_record_batches):
                    yield source.get_batch(i)

    return files.select("content").mapInArrow(load, schema)


def write_feather(df: DataFrame, uri: str, mode: str = "overwrite") -> None:
    """One Arrow IPC file for each partition that has rows, written by the tasks through Arrow's file systems.

    Each attempt of a task writes a file of its own in a hidden folder; only the files of attempts whose results Spark took are
    moved to their places (one move a partition), so retried and speculative tasks leave nothing behind. Files of earlier
    writes are replaced (overwrite) or kept (append); error raises if there are any, and ignore does nothing then.
    """
    import uuid

    from pyarrow import fs

    def place() -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)

    job = uuid.uuid4().hex
    store, base = place()
    store.create_dir(base, recursive=True)
    old = [f.path for f in store.get_file_info(fs.FileSelector(base)) if f.path.endswith(".feather")]
    if old and mode in ("error", "errorifexists"):
        raise FileExistsError(f"{uri} holds data")
    if old and mode == "ignore":
        return

    def save(batches):
        store, base = place()
        store.create_dir(f"{base}/_temporary-{job}", recursive=True)
        name, writer = uuid.uuid4().hex, None
        for batch in batches:
            if batch.num_rows and writer is None:
                out = store.open_output_stream(f"{base}/_temporary-{job}/{name}")
                writer = pa.ipc.new_file(out, batch.schema)
            if batch.num_rows:
                writer.write_batch(batch)
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"name": pa.array([name])})

    done = [r.name for r in df.mapInArrow(save, "name string").collect()]
    if mode == "overwrite":
        for path in old:
            store.delete_file(path)
    for k, name in enumerate(done):
        store.move(f"{base}/_temporary-{job}/{name}", f"{base}/part-{k:05d}-{job}.feather")
    if done:
        store.delete_dir(f"{base}/_temporary-{job}")


def read_numpy(spark: SparkSession, uri: str, member: str | None = None) -> DataFrame:
    """.npy and .npz files: (path, row, value or values) with a row for each first index."""

    def load(frames):
        import numpy as np
        import pandas as pd

        for pdf in frames:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                if not isinstance(a, np.ndarray):
                    a = a[member or a.files[0]]
                a = np.atleast_1d(a).astype(float)
                flat = a.reshape(len(a), -1)
                yield pd.DataFrame({"path": path, "row": np.arange(len(a)), "values": list(flat)})

    return _binary(spark, uri).mapInPandas(load, "path string, row long, values array<double>")


def refresh(spark: SparkSession, uri: str, staged: str, format: str | None = None, **options) -> DataFrame:
    """Read the source again and write it next to the staged copy; the new folder is returned, and readers move to it when it is whole."""
    from datetime import UTC, datetime

    path = f"{staged.rstrip('/')}/v={datetime.now(UTC):%Y%m%dT%H%M%S%f}"
    read(spark, uri, format, **options).write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)
