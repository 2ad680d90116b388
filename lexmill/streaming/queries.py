"""Streams: queries answered as they arrive, and word counts kept up to date."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lexmill.plans.search import CLI_TOP_N, Lexicon
from lexmill.session import shared_path
from lexmill.sources.readers import word_counts


def answer_stream(queries: DataFrame, lexicon: Lexicon, sink: Callable[[DataFrame, int], None], top_n: int = CLI_TOP_N, together: int = 50) -> DataStreamWriter:
    """queries: a stream of (query_id, query). Each batch's distinct queries are searched and their flat rows, with the
    query's id, go to the sink, which gets a frame for each `together` of them: it must append. A batch may hold any
    number of queries; the driver sees them slice by slice."""

    def answer(batch: DataFrame, epoch: int) -> None:
        lines = batch.filter(F.trim("query") != "").select("query_id", "query").distinct().toLocalIterator()
        while part := list(islice(lines, together)):
            results = [lexicon.search(line["query"], top_n=top_n).rows().withColumn("query_id", F.lit(line["query_id"])) for line in part]
            sink(reduce(DataFrame.unionByName, results), epoch)

    return queries.writeStream.foreachBatch(answer)


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Run an aggregating stream over what its source holds now and read its last complete result, which each batch
    writes anew; nothing of it passes through the driver."""
    spark = stream.sparkSession
    path = shared_path(spark, name)
    writer = stream.writeStream.outputMode("complete").foreachBatch(lambda df, epoch: df.write.mode("overwrite").parquet(f"{path}/out"))
    query = writer.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def running_counts(ngrams: DataFrame) -> DataFrame:
    """word_counts over a stream of n-gram lines; complete or update mode keeps a total for each word."""
    return word_counts(ngrams)
