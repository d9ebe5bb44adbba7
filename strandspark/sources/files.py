"""Files by URI from within tasks: parts of them, and files of one's own naming."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path in it."""
    if uri.startswith("file:/") and not uri.startswith("file://"):  # as Hadoop writes local paths
        uri = f"file://{uri[5:]}"
    return fs.FileSystem.from_uri(uri)


def opened(uri: str):
    """A file that any part can be read of."""
    system, path = located(uri)
    return system.open_input_file(path)


def write_named(rows: DataFrame, folder: str) -> int:
    """A file `folder/name` for each row (name, value), subfolders as named; how many. A task that runs again writes the same files again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, path = located(f"{folder}/{name}")
                system.create_dir(path.rpartition("/")[0], recursive=True)
                with system.open_output_stream(path) as out:
                    out.write(value.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return sum(r.n for r in rows.select("name", "value").mapInArrow(run, "n long").groupBy().sum("n").withColumnRenamed("sum(n)", "n").na.fill(0).collect())
