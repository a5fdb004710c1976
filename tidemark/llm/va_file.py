"""Exact top-k inner products over vector-approximation files.

Vectors of whole numbers are cut into blocks. A block has two Arrow files: the approximations
(one byte a component, the number of an equal-width cell between the block's bounds) and the exact
vectors. A search scans the approximations for bounds on every score, keeps the rows whose upper
bound reaches the k-th best lower bound, and reads exact vectors in the order of their bounds until
the k-th result is at least the next upper bound. Queries, also from files, pass in groups.

Copies of one vector share a score, and ties go to the smaller id, so a block keeps one row per
distinct vector with its k + 1 smallest ids (one may be the query itself). No copy beyond these can
be a result, and a vector held by a third of all rows costs one row a block.

Scores are exact: where a bound on |q| |v| passes 2^62 the products are summed in Python's integers, and bounds
carry the rounding error of doubles. A component whose floor has no place in 64 bits is an error that names its vector,
as is a score of more than 38 digits.

Defined cases: vectors that are null, empty, hold null or non-finite components, or lack an id take
no part, and neither do vectors of another length than a query; equal rows count as one candidate;
an empty table or no query gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from . import shared_files

MANIFEST = "vectors_path string, cells_path string, dim int, n_vectors long"
RESULT = "query_id long, vec_id long, score string"
#: Distinct vectors of a block, queries of a group, and cells of a component.
BLOCK, GROUP, CELLS = 32_768, 256, 256


def whole_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and floor(scale * x) of each component, for vectors that take part."""
    scaled = lambda x: F.lit(float(scale)) * x.cast("double")
    too_large = F.raise_error(F.concat(F.lit("a component is beyond 64 bits in vector "), F.col("vec_id").cast("string"))).cast("long")
    # 2^63 is a double; the largest double below it is a whole number.
    parts = F.transform("embedding", lambda x: F.when(F.abs(scaled(x)) < 2.0**63, F.floor(scaled(x))).otherwise(too_large))
    sound = F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf"))
    )
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding"))
    return rows.filter("vec_id IS NOT NULL AND size(embedding) > 0").filter(sound).select("vec_id", parts.alias("v"))


def write_va_file(vectors: DataFrame, folder: str, k: int) -> DataFrame:
    """Write blocks of (vec_id, v array<long>) under ``folder``; returns the manifest."""

    def close(rows: dict, dim: int):
        import numpy as np
        import pyarrow as pa

        exact = np.array(list(rows), dtype=f"V{8 * dim}").view(np.int64).reshape(-1, dim)
        low, high = exact.min(axis=0), exact.max(axis=0)
        # Differences as unsigned numbers: those of 64-bit numbers may pass 63 bits.
        width = (high.view(np.uint64) - low.view(np.uint64)) // CELLS + 1
        cells = ((exact.view(np.uint64) - low.view(np.uint64)) // width).astype(np.uint8)
        width = width.astype(np.int64)
        paths = [shared_files.new_name(folder, label, ".arrow") for label in ("vectors", "cells")]
        meta = {"low": low.tobytes(), "width": width.tobytes()}
        tables = (
            pa.table({"v": pa.FixedSizeListArray.from_arrays(pa.array(exact.ravel()), dim),
                      "ids": pa.array([sorted(x) for x in rows.values()], pa.list_(pa.int64()))}),
            pa.table({"cells": pa.FixedSizeListArray.from_arrays(pa.array(cells.ravel()), dim)}).replace_schema_metadata(meta),
        )
        for path, t in zip(paths, tables):
            with shared_files.create(path) as sink, pa.ipc.new_file(sink, t.schema) as writer:
                writer.write_table(t)
        return {"vectors_path": paths[0], "cells_path": paths[1], "dim": dim, "n_vectors": len(rows)}

    def write(batches: Iterator) -> Iterator:
        import heapq

        import numpy as np
        import pyarrow as pa

        blocks: dict[int, dict] = {}
        done = []
        for batch in batches:
            lists = batch.column("v")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            values = lists.values.to_numpy()
            for at, vec_id in enumerate(batch.column("vec_id").to_pylist()):
                one = values[offsets[at] : offsets[at + 1]]
                rows = blocks.setdefault(len(one), {})
                ids = rows.setdefault(one.tobytes(), [])
                if vec_id not in ids:
                    ids.append(vec_id)
                    if len(ids) > k + 1:
                        ids[:] = heapq.nsmallest(k + 1, ids)
                if len(rows) >= BLOCK:
                    done.append(close(blocks.pop(len(one)), len(one)))
        done += [close(rows, dim) for dim, rows in blocks.items()]
        yield pa.RecordBatch.from_pylist(
            done, schema=pa.schema([("vectors_path", pa.string()), ("cells_path", pa.string()), ("dim", pa.int32()), ("n_vectors", pa.int64())])
        )

    return shared_files.committed(vectors.mapInArrow(write, MANIFEST), folder)


def _groups(folder: str, dim: int) -> Iterator[tuple]:
    """(query ids, matrix of whole numbers) of at most GROUP queries of one length, from the folder's files."""
    import numpy as np
    import pyarrow.dataset as ds

    store, path = shared_files.file_system(folder)
    data = ds.dataset(path, filesystem=store, format="parquet")
    for batch in data.to_batches(columns=["vec_id", "v"], filter=ds.field("dim") == dim, batch_size=GROUP):
        if batch.num_rows:
            yield batch.column("vec_id").to_numpy(), batch.column("v").flatten().to_numpy().reshape(-1, dim)


def _search(block: dict, queries: str, k: int) -> Iterator[list[tuple]]:
    import numpy as np
    import pyarrow as pa

    cells_file = pa.ipc.open_file(shared_files.open_random(block["cells_path"]))
    exact_file = pa.ipc.open_file(shared_files.open_random(block["vectors_path"]))
    dim, meta = block["dim"], cells_file.schema.metadata
    low, width = (np.frombuffer(meta[x], np.int64) for x in (b"low", b"width"))
    cells = cells_file.read_all().column("cells").combine_chunks().values.to_numpy().reshape(-1, dim)
    # The whole numbers of a cell lie within half of (width - 1) of its middle.
    middle = low + cells * width.astype(np.float64) + (width - 1) / 2
    exact = exact_file.read_all()
    vectors = exact.column("v").combine_chunks().values.to_numpy().reshape(-1, dim)
    ids = exact.column("ids").combine_chunks()
    largest = np.maximum(np.abs(low.astype(np.float64)), np.abs(low + width.astype(np.float64) * CELLS))
    for query_ids, whole_q in _groups(queries, dim):
        q = whole_q.astype(np.float64)
        reach = np.abs(q) @ largest
        slack = np.abs(q) @ ((width - 1) / 2) + 0.5 + reach * (dim + 8) * 2.0**-52
        centre = q @ middle.T
        found = []
        for at, query_id in enumerate(query_ids.tolist()):
            upper = centre[at] + slack[at]
            # k + 1 distinct vectors: one may be the query's own row.
            m = min(k + 1, len(upper))
            lower_kth = np.partition(centre[at], -m)[-m] - slack[at]
            near = np.flatnonzero(upper >= lower_kth)
            near = near[np.argsort(-upper[near], kind="stable")]
            best: list[tuple[int, int]] = []
            fits = reach[at] < 2.0**62
            whole = whole_q[at] if fits else whole_q[at].tolist()
            for row in near.tolist():
                if len(best) >= k and upper[row] < -best[k - 1][0]:
                    break
                score = int(vectors[row] @ whole) if fits else sum(a * b for a, b in zip(vectors[row].tolist(), whole))
                best += [(-score, x) for x in ids[row].as_py() if x != query_id]
                best.sort()
                del best[k:]
            found += [(query_id, x, str(-s)) for s, x in best]
        yield found


def top_k(manifest: DataFrame, queries: DataFrame, folder: str, k: int) -> DataFrame:
    """The k best (score descending, then vec_id) of every query (vec_id, v) over all blocks, without itself.

    ``score`` is a whole number of up to 38 digits.
    """
    place = f"{folder}/queries"
    queries.withColumn("dim", F.size("v")).write.mode("overwrite").parquet(place)

    def search(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for block in batch.to_pylist():
                for found in _search(block, place, k):
                    columns = zip(*found) if found else ([], [], [])
                    kinds = pa.int64(), pa.int64(), pa.string()
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["query_id", "vec_id", "score"])

    near = shared_files.one_task_each(manifest, "vectors_path").mapInArrow(search, RESULT)
    near = near.withColumn("score", F.col("score").cast("decimal(38,0)"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    rows = near.distinct().withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return rows.select("query_id", "rank", "vec_id", "score")


def search(spark: SparkSession, vectors: DataFrame, is_query, k: int = 5, scale: int = 256) -> DataFrame:
    """top_k of the rows for which ``is_query`` holds, over all rows of ``vectors``."""
    folder = scratch_path(spark, "va-file")
    rows = whole_vectors(vectors, scale)
    return top_k(write_va_file(rows, folder, k), rows.filter(is_query).distinct(), folder, k)
