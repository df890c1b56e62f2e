"""text_chunks(text, lang) for SQL users."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from textreuse.operators.chunks import paragraph_spans, sentence_spans


@udtf(returnType="chunk_type string, chunk_index int, start_pos int, end_pos int, text string")
class TextChunks:
    """Paragraphs, then sentences, of a text."""

    def eval(self, text: str, lang: str):
        n, english = 0, (lang or "").lower() == "en"
        for kind, spans in (("paragraph", paragraph_spans), ("sentence", sentence_spans)):
            for a, z in spans(text or "", english):
                yield kind, n, a, z, text[a:z]
                n += 1


def register(spark: SparkSession) -> None:
    """select c.* from documents, lateral text_chunks(text, lang) c"""
    spark.udtf.register("text_chunks", TextChunks)
