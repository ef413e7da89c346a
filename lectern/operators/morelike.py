"""Documents like a given one, by its most telling words."""

from __future__ import annotations

from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.plans.ast import MoreLike, OrNear, Term

if TYPE_CHECKING:
    from lectern.plans.compile import Compiler


def telling_words(compiler: Compiler, node: MoreLike, doc_id: int) -> DataFrame:
    """Rows (term, weight): term frequency times idf times field boost, summed over fields; the best come first, ties by word.

    Only the target's own words are looked up in the dictionary.
    """
    boosts = dict(zip(node.fields, node.boosts or (1.0,) * len(node.fields)))
    postings, docs = compiler.index.postings, compiler.index.doc_count
    most = node.max_df if node.max_df is not None else max(5, docs // 20)
    length = F.length("term")
    own = (
        postings.where((F.col("doc_id") == doc_id) & F.col("field").isin(*[f for f in node.fields if boosts[f]]) & length.between(node.min_length, node.max_length) & ~F.col("term").isin(*(compiler.index.stop_words or [""])))
        .groupBy("field", "term")
        .agg(F.count("*").alias("tf"))
        .where(F.col("tf") >= node.min_tf)
    )
    if compiler.index.terms is not None:
        df = compiler.index.terms.where(F.col("field").isin(*node.fields)).select("field", "term", "df")
    else:  # one document's own terms alone go to all tasks
        df = postings.where(F.col("field").isin(*node.fields)).join(F.broadcast(own.select("field", "term")), ["field", "term"], "left_semi").groupBy("field", "term").agg(F.countDistinct("doc_id").alias("df"))
    boost = F.lit(0.0)
    for name, b in boosts.items():
        boost = F.when(F.col("field") == name, b).otherwise(boost)
    weight = F.col("tf") * (1 + F.log(F.lit(float(docs)) / (F.col("df") + 1))) * boost
    return own.join(df, ["field", "term"]).where(F.col("df").between(node.min_df, most)).groupBy("term").agg(F.sum(weight).alias("weight")).orderBy(F.desc(F.round("weight", 6)), "term").limit(node.most_terms)


def more_like(compiler: Compiler, node: MoreLike) -> DataFrame:
    """Spans of documents that hold the target's most telling words; the target itself is left out. Without a target there are none."""
    target = compiler.spans(node.child).agg(F.min("doc_id").alias("d")).first()
    empty = compiler.index.documents.where(F.lit(False)).select("doc_id", F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(0.0).alias("score"))
    if target is None or target.d is None:
        return empty
    chosen = telling_words(compiler, node, target.d).collect()
    parts = []
    for name, boost in zip(node.fields, node.boosts or (1.0,) * len(node.fields)):
        if boost and chosen:
            near = compiler.resolve(OrNear(tuple(Term(r.term, name, r.weight) for r in chosen), 10))
            parts.append(compiler._ornear(near).withColumn("score", F.col("score") * boost))
    return reduce(DataFrame.unionByName, parts).where(F.col("doc_id") != target.d) if parts else empty

