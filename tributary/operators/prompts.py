"""Cited prompts for retrieval-augmented generation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The wording around sources and question.
HEAD = (
    "Answer the question using ONLY the numbered sources, citing inline like [1]. "
    "If they don't answer it, say so.\n\nSources:\n"
)
QUESTION = "\nQuestion: "
TAIL = "\nAnswer:"


def cited_prompts(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """``(query_id, prompt)`` from ``hits(query_id, rank, text)`` and ``queries(query_id, query)``.

    A query's hits are its top k, so the list gathered per query is bounded. A query without hits
    still gets a prompt, with no sources in it.
    """
    sources = hits.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("sources")
    )
    listed = F.transform(
        F.coalesce("sources", F.expr("cast(array() as array<struct<rank:int,text:string>>)")),
        lambda s: F.concat(F.lit("["), s["rank"].cast("string"), F.lit("] "), s["text"], F.lit("\n")),
    )
    prompt = F.concat(
        F.lit(HEAD), F.array_join(listed, ""), F.lit(QUESTION), F.col("query"), F.lit(TAIL)
    )
    return queries.join(sources, "query_id", "left").select("query_id", prompt.alias("prompt"))
