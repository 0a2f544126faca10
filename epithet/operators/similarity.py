"""Vectors of terms, groups and categories, and their cosine similarities.

Vectors come from a table (text, vector); no model is run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epithet.functions.vectors import dot, has_direction, mean_pool, norm


def cosine_to(df: DataFrame, other: DataFrame, on: str, vector: str = "vector") -> DataFrame:
    """Cosine of each row's vector to every vector ``other`` has for its key.

    Other columns of both sides are kept.  Vectors without a direction are dropped and
    norms are taken before the join, so a pair costs one dot product.
    """

    def prepared(side: DataFrame, to: str, length: str) -> DataFrame:
        kept = side.where(has_direction(F.col(vector)))
        return kept.withColumn(length, norm(F.col(vector))).withColumnRenamed(vector, to)

    pairs = prepared(df, vector, "_norm").join(prepared(other, "_target", "_target_norm"), on)
    sim = dot(F.col(vector), F.col("_target")) / (F.col("_norm") * F.col("_target_norm"))
    return pairs.withColumn("cosine_sim", sim).drop("_target", "_norm", "_target_norm")


def term_category_similarity(top: DataFrame, members: DataFrame, vectors: DataFrame) -> DataFrame:
    """(grp, category, pos, term, cosine_sim): each top term against its own category.

    ``top`` holds at most k terms per group and pos and ``members`` one row per group,
    so both are small beside ``vectors`` and Catalyst or AQE ships them, not the table.
    """
    terms = top.join(members, "grp").select("grp", "category", "pos", "term")
    with_term = terms.join(vectors.select(F.col("text").alias("term"), "vector"), "term")
    categories = members.select("category").distinct()
    with_category = categories.join(vectors.select(F.col("text").alias("category"), "vector"), "category")
    sims = cosine_to(with_term, with_category, "category")
    return sims.select("grp", "category", "pos", "term", "cosine_sim")


def group_documents(top: DataFrame) -> DataFrame:
    """Pseudo-document per (grp, pos): its top terms in rank order."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "term")))
    return top.groupBy("grp", "pos").agg(
        F.transform(ordered, lambda r: r["term"]).alias("terms")
    ).select("grp", "pos", "terms", F.array_join("terms", " ").alias("text"))


def category_documents(group_docs: DataFrame, members: DataFrame) -> DataFrame:
    """Pseudo-document per (category, pos): its members' documents in group order."""
    ordered = F.array_sort(F.collect_list(F.struct("grp", "terms")))
    return (
        group_docs.join(members, "grp")
        .groupBy("category", "pos")
        .agg(F.flatten(F.transform(ordered, lambda r: r["terms"])).alias("terms"))
        .select("category", "pos", "terms", F.array_join("terms", " ").alias("text"))
    )


def document_vectors(
    docs: DataFrame, key: str, vectors: DataFrame, max_terms: int | None = None
) -> DataFrame:
    """Mean vector of each pseudo-document's terms.

    ``max_terms`` is an embedding model's input length; by default nothing is cut.
    """
    terms = F.slice("terms", 1, max_terms) if max_terms else F.col("terms")
    words = docs.select(key, "pos", F.explode(terms).alias("term"))
    joined = words.join(vectors.select(F.col("text").alias("term"), "vector"), "term")
    return mean_pool(joined, [key, "pos"], "vector")


def category_contrast(
    group_vectors: DataFrame, category_vectors: DataFrame, members: DataFrame, salts: int = 64
) -> DataFrame:
    """(grp, category, category_type, pos, cosine_sim): each group against every category.

    Groups whose own category has no document are left out.  The category vectors of a pos are one
    matrix row (categories are bounded by the taxonomy), and a group takes its products with all of them
    in its own row.  Groups are spread over ``salts`` copies of the matrix, so a pos is not one task.
    """
    vector = F.col("vector")
    length = F.when(has_direction(vector), norm(vector))
    rows = category_vectors.select("pos", F.struct("category", "vector", length.alias("norm")).alias("c"))
    matrix = rows.groupBy("pos").agg(F.collect_list("c").alias("matrix"))
    copies = matrix.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    own = group_vectors.join(members.withColumnRenamed("category", "own"), "grp").where(has_direction(vector))
    placed = own.withColumns({"norm": norm(vector), "salt": F.pmod(F.hash("grp"), F.lit(salts))})
    met = placed.join(copies, ["pos", "salt"])

    def product(c: Column) -> Column:
        kind = F.when(c["category"] == F.col("own"), "own").otherwise("other")
        sim = dot(vector, c["vector"]) / (F.col("norm") * c["norm"])
        return F.struct(c["category"].alias("category"), kind.alias("category_type"), sim.alias("cosine_sim"))

    known = F.exists("matrix", lambda c: c["category"] == F.col("own"))
    directed = F.filter("matrix", lambda c: c["norm"].isNotNull())
    products = F.when(known, F.transform(directed, product))
    return met.select("grp", "pos", F.explode(products).alias("p")).select(
        "grp", "p.category", "p.category_type", "pos", "p.cosine_sim"
    )
