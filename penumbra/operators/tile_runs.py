"""Long runs of a job over tiles: finished tiles are skipped, each run has a time-out, and every tile has a status."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tile_runs(tiles: DataFrame, finished: DataFrame, work: Callable[[dict], None], key: str = "tile", timeout: float = 3600.0) -> DataFrame:
    """(key, status, seconds) for each row of tiles: skip, done, STUCK beyond timeout seconds, or ERR(exit<code>) where work raised or died.

    finished: the keys that have a result, as a scan of the sink gives them; another run over the same sink therefore goes on where
    this one stopped. work gets a row of tiles as a dict, in a process of its own that is killed at the time-out, and leaves its
    result in shared storage; it may run again where an executor is lost, so it should replace what it left. Tiles are dealt
    out evenly. A null key is never finished; repeated tiles each run; an empty table gives no rows.
    """
    name = tiles.schema[key].name
    ready = finished.select(key).distinct()
    schema = tiles.select(key).schema.add("status", "string").add("seconds", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import multiprocessing
        import time

        fork = multiprocessing.get_context("fork")
        for b in batches:
            keys = b.column(b.schema.get_field_index(name))
            for i in range(b.num_rows):
                began = time.monotonic()
                p = fork.Process(target=work, args=(b.slice(i, 1).to_pylist()[0],))
                p.start()
                p.join(timeout)
                status = "STUCK" if p.is_alive() else "done" if p.exitcode == 0 else f"ERR(exit{p.exitcode})"
                if status == "STUCK":
                    p.kill()
                    p.join()
                yield pa.RecordBatch.from_arrays([keys.slice(i, 1), pa.array([status]), pa.array([time.monotonic() - began])], names=[name, "status", "seconds"])

    todo = tiles.join(ready, key, "left_anti")
    todo = todo.repartition(4 * tiles.sparkSession.sparkContext.defaultParallelism)
    skipped = tiles.join(ready, key, "left_semi").select(key, F.lit("skip").alias("status"), F.lit(0.0).alias("seconds"))
    return skipped.unionByName(todo.mapInArrow(run, schema))
