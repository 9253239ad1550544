"""Context blocks, prompts and templates over a table of queries and their hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.functions import text

# The formats of context blocks and prompts.
NO_RESULTS = "No relevant information found."
HEADER = "Retrieved Information:\n"
DEFAULT_TEMPLATE = ("Based on the following retrieved information:\n\n"
                    "{retrieved_info}\n\n"
                    "Query: {query}")
BLOCK_SPLIT = r"\n?\d+\. \[Score: [\d.]+\]\n?\s*"


def hit_arrays(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Every query with its hits in rank order (an empty array when there are none).

    A query has at most top_k hits, so the arrays are bounded.
    """
    fields = ["rank", "doc_id", "score", "content", "metadata"]
    # A map cannot be compared, so the sort looks at the rank alone.
    grouped = hits.groupBy("query_id").agg(F.collect_list(F.struct(*fields)).alias("hits"))
    in_order = F.array_sort("hits", lambda a, b: F.signum(a["rank"] - b["rank"]).cast("int"))
    joined = queries.join(grouped.withColumn("hits", in_order), "query_id", "left")
    nothing = F.array().cast(grouped.schema["hits"].dataType)
    return joined.withColumn("hits", F.coalesce("hits", nothing))


def summary(queries: DataFrame, hits: DataFrame, hybrid: bool, reranked: bool) -> DataFrame:
    """Per query: number of results, how they were found, and the results. Queries without hits stay."""
    arrays = hit_arrays(queries, hits)
    results = F.transform("hits", lambda h: F.struct(h["content"].alias("content"), h["score"].alias("score"),
                                                     h["metadata"].alias("metadata")))
    return arrays.select("query_id", F.size("hits").cast("bigint").alias("num_results"),
                         F.lit(hybrid).alias("hybrid"), F.lit(reranked).alias("reranked"),
                         results.alias("results"))


def context_block(hits: Column) -> Column:
    """Numbered text block of an array of hits; metadata is a JSON line, left out when empty."""

    def entry(hit: Column) -> Column:
        lines = [F.concat(hit["rank"].cast("string"), F.lit(". [Score: "), F.coalesce(text.two_decimals(hit["score"]), F.lit("0.00")), F.lit("]")),
                 F.concat(F.lit("   "), hit["content"]),
                 F.when(F.size(hit["metadata"]) > 0, F.concat(F.lit("   Metadata: "), F.to_json(hit["metadata"]))),
                 F.lit("")]
        return F.concat_ws("\n", *lines)

    block = F.concat(F.lit(HEADER + "\n"), F.array_join(F.transform(hits, entry), "\n"))
    return F.when(F.size(hits) == 0, F.lit(NO_RESULTS)).otherwise(block)


def context_blocks(queries: DataFrame, hits: DataFrame) -> DataFrame:
    arrays = hit_arrays(queries, hits)
    return arrays.select(*queries.columns, context_block(F.col("hits")).alias("retrieved_info"),
                         F.size("hits").cast("bigint").alias("num_results"))


def contexts(hits: Column) -> Column:
    """Context strings from the hits themselves, one empty string when there are none."""
    found = F.array_remove(F.transform(hits, lambda h: text.strip(h["content"])), "")
    return F.when(F.size(found) == 0, F.array(F.lit(""))).otherwise(found)


def split_block(block: Column) -> Column:
    """Context strings from a text block, for blocks that were stored as text only."""
    parts = F.transform(F.split(block, BLOCK_SPLIT), text.strip)
    found = F.filter(parts, lambda p: (p != "") & (p != NO_RESULTS))
    return F.when(F.size(found) == 0, F.array(F.lit(""))).otherwise(found)


def augment(info: Column, query: Column, template: str = DEFAULT_TEMPLATE) -> Column:
    """Fill ``{retrieved_info}`` and ``{query}``. Placeholders inside documents stay as they are."""
    parts: list[Column] = []
    for i, piece in enumerate(template.split("{retrieved_info}")):
        if i:
            parts.append(info)
        for j, text_piece in enumerate(piece.split("{query}")):
            if j:
                parts.append(query)
            if text_piece:
                parts.append(F.lit(text_piece))
    return F.coalesce(F.concat(*parts), F.lit(""))


def merge_context(context: Column, info: Column) -> Column:
    """Request context plus ``retrieved_info``, which wins over a key of that name."""
    kept = F.map_filter(context, lambda key, _: key != "retrieved_info")
    return F.map_concat(kept, F.create_map(F.lit("retrieved_info"), info))


def prompt(message: Column, context: Column, system_prompt: str = "") -> Column:
    """``System``, ``Context`` and ``User`` parts with blank lines between; empty parts are left out."""
    system = [F.lit(f"System: {system_prompt}")] if system_prompt else []
    shown = F.when(F.size(context) > 0, F.concat(F.lit("Context: "), F.to_json(context)))
    return F.concat_ws("\n\n", *system, shown, F.concat(F.lit("User: "), message))
