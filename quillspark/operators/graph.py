"""The evidence graph as two tables: nodes(node_id, node_type, name, paper_id) and edges(source_id, target_id, relation_type, paper_id, confidence)."""
from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def edges(methods: DataFrame, datasets: DataFrame) -> DataFrame:
    """USED_IN / PROPOSED_BY, EVALUATED_ON and COMPARED_WITH edges of methods(paper_id, id, role) and datasets(paper_id, id)."""
    paper = F.concat(F.lit("paper_"), F.col("paper_id").cast("string"))
    role = F.when(F.col("role") == "proposed", "PROPOSED_BY").otherwise("USED_IN")
    cols = lambda s, t, r, c: [s.alias("source_id"), t.alias("target_id"), r.alias("relation_type"), F.col("paper_id"), F.lit(c).alias("confidence")]
    use = methods.select(*cols(F.col("id"), paper, role, 0.95)).unionByName(datasets.select(*cols(F.col("id"), paper, F.lit("USED_IN"), 0.95)))
    own = methods.where("role = 'proposed'").select("paper_id", F.col("id").alias("m"))
    on = own.join(datasets.select("paper_id", F.col("id").alias("d")), "paper_id").select(*cols(F.col("m"), F.col("d"), F.lit("EVALUATED_ON"), 0.90))
    others = methods.where("role IN ('baseline', 'compared')").select("paper_id", F.col("id").alias("o"))
    against = own.join(others, "paper_id").where("m <> o").select(*cols(F.col("m"), F.col("o"), F.lit("COMPARED_WITH"), 0.92))
    return use.unionByName(on).unionByName(against)


def numbered(found: DataFrame) -> DataFrame:
    """edges with edge_id: numbered within their paper, so that no task numbers them all."""
    order = Window.partitionBy("paper_id").orderBy("relation_type", "source_id", "target_id")
    return found.withColumn("edge_id", F.concat_ws("_", F.lit("edge"), F.col("paper_id").cast("string"), F.row_number().over(order).cast("string")))


def lookup(found: DataFrame, node: str, way: str = "both") -> DataFrame:
    out, into = F.col("source_id") == node, F.col("target_id") == node
    return found.where({"out": out, "in": into, "both": out | into}[way])


def pattern(found: DataFrame, source: str | None = None, target: str | None = None, relation: str | None = None) -> DataFrame:
    """Edges that fit the parts of a triple that are given; relations in any letter case."""
    for column, value in (("source_id", source), ("target_id", target)):
        if value is not None:
            found = found.where(F.col(column) == value)
    return found if relation is None else found.where(F.upper("relation_type") == relation.upper())


def ego_network(found: DataFrame, node: str) -> DataFrame:
    """(node_id, edges): a node's neighbours, itself among them."""
    near = lookup(found, node).select(F.explode(F.array("source_id", "target_id")).alias("node_id"))
    return near.groupBy("node_id").agg(F.count(F.lit(1)).alias("edges"))


def ego_edges(found: DataFrame, nodes: DataFrame, node: str) -> DataFrame:
    """The edges of a node's network; a node that nodes(node_id) lacks is an error, one without edges has none."""
    if nodes.where(F.col("node_id") == node).isEmpty():
        raise LookupError(f"no node {node}")
    return lookup(found, node)
