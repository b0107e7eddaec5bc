"""Event-driven parts as Structured Streaming: touched files, rule cues, gain rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusindex.operators.decisions import cue_messages
from corpusindex.operators.logs import gain_rows

# The extensions whose files count as touched, sources first, then those of builds, settings and styles.
EXTENSIONS = {
    "java": (".java", ".yml", ".yaml", ".properties"),
    "angular": (".ts", ".html", ".scss"),
    "node": (".ts", ".js", ".mjs", ".cjs", ".html", ".scss"),
    "react": (".ts", ".js", ".mjs", ".cjs", ".tsx", ".jsx", ".html", ".scss"),
    "python": (".py", ".pyi", ".toml", ".cfg"),
}


def of_language(touches: DataFrame, lang: str) -> DataFrame:
    """Touches (repo, file, ts) of the language's sources and of what belongs to them."""
    keep = F.lit(False)
    for extension in EXTENSIONS[lang]:
        keep = keep | F.col("file").endswith(extension)
    return touches.where(keep)


def touch_queue(stream: DataFrame, lang: str, drain: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Drain all waiting touches: each micro-batch's distinct (repo, file) go to `drain`.

    Distinct per batch is enough, as draining a file twice gives the same facts, and it keeps no state.
    """

    def batch(touched: DataFrame, number: int) -> None:
        drain(touched.select("repo", "file").distinct(), number)

    return of_language(stream, lang).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cue_stream(messages: DataFrame, opted_in: DataFrame) -> DataFrame:
    """Messages of opted-in repos that state a standing rule; `opted_in` is a static table of repos."""
    return cue_messages(messages).join(opted_in.select("repo").distinct(), "repo", "left_semi")


def gain_stream(operations: DataFrame) -> DataFrame:
    return gain_rows(operations)


def append_sink(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
