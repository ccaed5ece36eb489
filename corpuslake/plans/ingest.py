"""Document ingest: quality gate, chunking, metadata, embedding in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.operators import chunking as ck
from corpuslake.operators import textstats as ts
from corpuslake.operators import vectors as vx

STRATEGIES = {
    "sentences": lambda d: ck.split_sentences(d),
    "structured": lambda d: ck.chunk_structured(d),
    "recursive": lambda d: ck.split_recursive(d),
    "fixed": lambda d: ck.split_fixed(d),
}


def ingest(docs: DataFrame, strategy: str = "sentences", encoder=None, gate: bool = True) -> DataFrame:
    """Chunk table (text, source, metadata columns, embedding) of documents (doc_id, text, source)."""
    kept = docs
    if gate:
        keep = ts.quality_gate(ck.paragraphs(docs)).where("keep").select("doc_id")
        kept = docs.join(keep, "doc_id", "left_semi")
    # only kept documents have chunks, so their columns come from all without a second gate
    chunks = ck.finish_chunks(STRATEGIES[strategy](kept), docs, strategy)
    return vx.embed(chunks, encoder=encoder).withColumn(
        "chunk_id", F.concat_ws("#", "source", F.col("chunk_index").cast("string"))
    )
