"""The library's functions under names that Spark SQL can call."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .. import ensure_importable
from ..operators import chunking


class _Chunks:
    def eval(self, markdown: str, title: str, page_type: str):
        for k, (label, text) in enumerate(chunking.chunk_texts(markdown, title, chunking.strategy_of(page_type))):
            yield k, label, text


def register(spark: SparkSession) -> None:
    """chunk_markdown(markdown, title, page_type) -> rows (chunk_index, section_heading, content), for LATERAL joins;
    token_count(text) and content_hash(text) as SQL functions that run in the JVM."""
    ensure_importable(spark)
    spark.udtf.register("chunk_markdown", F.udtf(_Chunks, returnType="chunk_index int, section_heading string, content string"))
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION token_count(t STRING) RETURNS INT RETURN regexp_count(t, r'[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}]')")
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION content_hash(t STRING) RETURNS STRING RETURN sha2(lower(trim(regexp_replace(t, r'[\s\p{Z}]+', ' '))), 256)")
