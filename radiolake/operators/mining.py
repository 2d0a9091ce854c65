"""Templates of whole log tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radiolake.functions.drain import WILD, DrainTree
from radiolake.functions.text import masked


def mine(lines: DataFrame, by: str, body: str, us: str, similarity: float = 0.4) -> DataFrame:
    """``by, template, n, first_us, last_us`` from parse trees, one per source, number of words and first word.

    Lines are masked and counted first, map-side, so that a tree sees each distinct masked line once (in order of first
    appearance), however many lines a source has. A tree parts its lines by their number of words and their first word anyway (words with digits go one way), so these
    parts of a source are mined apart from one another; only the tree's bound on the branches of its first level falls away. Null bodies are no lines.
    """
    distinct = lines.filter(F.col(body).isNotNull()).groupBy(F.col(by).alias("source"), masked(F.col(body)).alias("m")).agg(F.count(F.lit(1)).alias("n"), F.min(us).alias("first_us"), F.max(us).alias("last_us"))

    words = F.split(F.trim("m"), r"\s+")
    distinct = distinct.withColumns({"words": F.size(words), "first": F.when(F.get(words, F.lit(0)).rlike(r"\d"), WILD).otherwise(F.get(words, F.lit(0)))})

    def tree(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["first_us", "m"], kind="stable")
        t = DrainTree(similarity=similarity)
        groups, names = [], {}
        for m in pdf["m"]:
            g, _, template = t.add(m)
            groups.append(g)
            names[g] = template
        out = pdf.assign(g=groups).groupby("g").agg(n=("n", "sum"), first_us=("first_us", "min"), last_us=("last_us", "max")).reset_index()
        return out.assign(source=pdf["source"].iloc[0], template=out["g"].map(names))[["source", "template", "n", "first_us", "last_us"]]

    kind = distinct.schema["source"].dataType.simpleString()
    return distinct.groupBy("source", "words", "first").applyInPandas(tree, f"source {kind}, template string, n long, first_us long, last_us long").withColumnRenamed("source", by)
