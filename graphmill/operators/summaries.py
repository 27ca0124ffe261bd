"""Retrieval summaries: which are current, and making the others with a text and an embedding model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmill.functions.models import EmbeddingModel, TextModel, checked_vectors
from graphmill.functions.scalar import first_filled, prefixed_sha256
from graphmill.model import as_edges, as_nodes
from graphmill.operators.merge import delete_nodes, union_keep_first

TARGET_TYPES = ("Module", "File", "Entity")
LEAD = "Summarise this node of a code graph in one paragraph for search: what it is, where it lies, what it is for, and the words people would look for."


def local_summary() -> Column:
    """What a node's own columns say, by type."""
    filled = lambda *c: F.concat_ws(" ", "node_type", *(F.nullif(F.col(x), F.lit("")) for x in c))
    return (
        F.when(F.col("node_type") == "Entity", filled("kind_norm", "display_name", "qualified_name", "kind_raw"))
        .when(F.col("node_type") == "File", filled("language", "relative_path", "zone"))
        .when(F.col("node_type") == "Module", filled("name", "root_path", "ecosystem", "zone"))
        .otherwise(F.concat_ws(" ", "node_type", "id"))
    )


def summary_prompt() -> Column:
    return F.concat_ws("\n", F.lit(LEAD), F.concat(F.lit("Node: "), "id"), F.concat(F.lit("About: "), local_summary()))


def target_hash() -> Column:
    return first_filled("semantic_hash", "content_hash")


def summary_id() -> Column:
    return F.concat(F.lit("summary:"), "id", F.lit(":retrieval"))


def targets(nodes: DataFrame, text_model: str, embedding_model: str, dimensions: int | None) -> DataFrame:
    """Summarised node types with `current`: whether the node's own summary fits its hash, the models and the dimensions.

    A module has no hash, so only models and dimensions count for it.
    """
    own = nodes.filter("node_type = 'Summary'").select(
        F.col("id").alias("summary_id"), "purpose", "summary_model", "embedding_model", "embedding_dimensions", F.col("source_hash").alias("summary_hash"), F.size("embedding").alias("length")
    )
    wanted = nodes.filter(F.col("node_type").isin(*TARGET_TYPES)).withColumn("summary_id", summary_id()).withColumn("target_hash", target_hash())
    joined = wanted.drop("purpose", "summary_model", "embedding_model", "embedding_dimensions").join(own, "summary_id", "left")
    fits = (
        (F.col("target_hash").isNull() | F.col("target_hash").eqNullSafe(F.col("summary_hash"))) & (F.col("purpose") == "retrieval") & (F.col("summary_model") == text_model)
        & (F.col("embedding_model") == embedding_model) & F.col("embedding_dimensions").eqNullSafe(F.col("length"))
    )
    if dimensions is not None:
        fits = fits & (F.col("embedding_dimensions") == dimensions)
    return joined.select(*wanted.columns[: len(nodes.columns)], "target_hash", F.coalesce(fits, F.lit(False)).alias("current"))


def embedded(rows: DataFrame, model: EmbeddingModel, batch: int = 25) -> DataFrame:
    """rows (..., text) with `embedding`, in requests of at most `batch` texts, checked for count, type and length."""
    import pyarrow as pa
    from pyspark.sql import types as T

    def embed(batches):
        for part in batches:
            texts = part.column("text").to_pylist()
            out = []
            for at in range(0, len(texts), batch):
                asked = texts[at : at + batch]
                out += list(checked_vectors(model.embed(asked), len(asked), model.dimensions))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.list_(pa.float32()))], [*part.schema.names, "embedding"])

    return rows.mapInArrow(embed, T.StructType([*rows.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))]))


def attach(nodes: DataFrame, edges: DataFrame, text_model: TextModel, embedding_model: EmbeddingModel, batch: int = 25) -> tuple[DataFrame, DataFrame]:
    """The graph with a current retrieval summary for each module, file and entity: stale ones go, missing ones are made.

    Only targets without a current summary reach the models.
    """
    judged = targets(nodes, text_model.name, embedding_model.name, embedding_model.dimensions)
    old = judged.filter("not current").select(summary_id().alias("id"))
    kept_nodes, kept_edges = delete_nodes(nodes, edges, old)
    asked = judged.filter("not current").select("id", "target_hash", summary_prompt().alias("prompt"))
    made = embedded(written_rows(asked, text_model), embedding_model, batch)
    fresh = made.select(
        summary_id().alias("id"), F.lit("Summary").alias("node_type"), "text", F.lit("retrieval").alias("purpose"),
        F.coalesce("target_hash", prefixed_sha256(F.concat_ws("\n", "id", "text"))).alias("source_hash"), F.lit(text_model.name).alias("summary_model"), F.lit(embedding_model.name).alias("embedding_model"),
        F.size("embedding").alias("embedding_dimensions"), "embedding",
    )
    describes = judged.select(F.lit("DESCRIBES").alias("edge_type"), summary_id().alias("source_id"), F.col("id").alias("target_id"), F.lit("retrieval").alias("kind"), F.lit("summaries").alias("provenance"), F.lit(1.0).alias("confidence"))
    return union_keep_first([kept_nodes, as_nodes(fresh)]), union_keep_first([kept_edges, as_edges(describes)])


def written_rows(prompts: DataFrame, model: TextModel) -> DataFrame:
    """(id, target_hash, text): the model's answers, one line each; a blank answer is an error."""
    import pyarrow as pa

    def generate(batches):
        for part in batches:
            out = [" ".join(x.strip() for x in t.splitlines() if x.strip()) for t in model.generate(part.column("prompt").to_pylist())]
            if len(out) != part.num_rows or not all(out):
                raise ValueError("the text model left a prompt without an answer")
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("target_hash"), pa.array(out, pa.string())], ["id", "target_hash", "text"])

    return prompts.mapInArrow(generate, "id string, target_hash string, text string")
