"""Named text files, written by the tasks that hold their rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_texts(rows: DataFrame, base: str, path: str = "path", content: str = "content") -> int:
    """Writes one file per row under ``base``; returns their number. A retried task writes them anew."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(base) if ":" in base else (fs.LocalFileSystem(), base)
        for batch in batches:
            for name, text in zip(*(c.to_pylist() for c in batch.columns)):
                target = f"{root}/{name}"
                system.create_dir(target.rpartition("/")[0], recursive=True)
                with system.open_output_stream(target) as out:
                    out.write((text or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    written = rows.select(path, content).mapInArrow(write, "n long")
    return written.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
