"""Plans on Structured Streaming: whatever looks at one row at a time runs unchanged."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..registry import REGISTRY, Scope


def check_streamable(plan: Any) -> list[str]:
    """Steps that need more than one row, which an unbounded input never completes."""
    out = []
    for i, s in enumerate(plan.steps, 1):
        op = REGISTRY[s.operation]
        if op.scope(s.params) is not Scope.ROW or op.ordered(s.params) or s.operation == "col_add_uuid":
            out.append(f"Step {i} ({s.operation}): not possible on a stream")
    return out


def transform_stream(plan: Any, stream: DataFrame) -> DataFrame:
    """The plan on a streaming frame."""
    if not stream.isStreaming:
        raise ValueError("the frame is not a stream")
    if found := check_streamable(plan):
        raise ValueError("\n".join(found))
    return plan.transform(stream)


def stream_table(spark: SparkSession, plan: Any, path: str, work: str) -> DataFrame:
    """Run the plan over the files at ``path`` as a stream until all are processed.

    The result is written as Parquet below ``work``, beside the stream's checkpoint, and read from there; a
    restart with the same folder goes on where the stream stopped.
    """
    schema = spark.read.parquet(path).schema
    # a single file is a source by its folder and name
    folder, _, name = path.rpartition("/")
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    stream = source.parquet(path) if not name.endswith(".parquet") or _is_folder(spark, path) else source.option("pathGlobFilter", name).parquet(folder)
    result = transform_stream(plan, stream)
    running = result.writeStream.format("parquet").option("path", f"{work}/result").option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{work}/result")


def _is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
