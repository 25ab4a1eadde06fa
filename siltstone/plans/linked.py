"""Links between the chunks and the entities of the trade tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables as T


def links(spark: SparkSession, sf: str) -> DataFrame:
    """(entity_id, chunk_id): a part is named in the chunks of the document of its number, a supplier in those of twenty."""
    chunks = T.places(spark, sf)
    part = chunks.select(F.concat(F.lit("part:"), F.col("doc_id").cast("string")).alias("entity_id"), "chunk_id")
    supplier = chunks.select(F.concat(F.lit("supplier:"), F.expr("doc_id div 20").cast("string")).alias("entity_id"), "chunk_id")
    return part.union(supplier)


LINKS_SQL = "links AS (SELECT 'part:' || doc_id AS entity_id, chunk_id FROM chunks UNION SELECT 'supplier:' || (doc_id // 20), chunk_id FROM chunks)"
