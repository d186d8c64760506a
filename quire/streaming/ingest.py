"""File-stream ingest: documents that arrive as Parquet become repaired paragraphs, document by document, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quire.operators.text import lacks_space, restore_spaces
from quire.plans.dialect import Spark
from quire.plans.views import paras

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def repaired(documents: DataFrame) -> DataFrame:
    """doc_id, para, text and whether a space was restored, of a batch or a stream of documents."""
    d = Spark()
    inner = paras(d).replace("FROM documents", "FROM {documents}")
    sql = f"SELECT doc_id, para, CASE WHEN {lacks_space(d, 'text')} THEN {restore_spaces(d, 'text')} ELSE text END AS text, {lacks_space(d, 'text')} AS mended FROM ({inner})"
    documents.createOrReplaceTempView("quire_ingest")
    return documents.sparkSession.sql(sql.replace("{documents}", "quire_ingest"))


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Append the repaired paragraphs of all files in ``source`` that are new since the last run to ``target``."""
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    return repaired(stream).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
