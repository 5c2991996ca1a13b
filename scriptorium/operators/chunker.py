"""A chunker trained on tagged sentences: the commonest chunk tag by tag, refined by the tag before it; productions of its tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START = "<S>"


def train(sentences: DataFrame, tags: str = "tags", chunks: str = "chunks") -> dict[str, str]:
    """Chunk tag by ``tag`` and by ``chunk before|tag``, from sentences with an array of tags and one of chunk tags. The pairs
    are bounded by the two tag sets; of a pair the commonest chunk tag is kept, the first in alphabet among equals, and
    only where it differs from that of the tag alone."""
    before = F.concat(F.array(F.lit(START)), F.slice(chunks, 1, F.greatest(F.size(chunks) - 1, F.lit(0))))
    rows = sentences.where(F.size(tags) == F.size(chunks)).select(F.explode(F.arrays_zip(F.col(tags).alias("t"), F.col(chunks).alias("c"), before.alias("b"))).alias("x")).select("x.*")
    best = lambda df: df.groupBy("k", "c").agg(F.count(F.lit(1)).alias("n")).groupBy("k").agg(F.min_by("c", F.struct(-F.col("n"), "c")).alias("c"))
    one = {r.k: r.c for r in best(rows.select(F.col("t").alias("k"), "c")).collect()}
    two = {r.k: r.c for r in best(rows.select(F.concat_ws("|", "b", "t").alias("k"), "c")).collect()}
    return one | {k: c for k, c in two.items() if one.get(k.split("|", 1)[1]) != c}


def chunk_tags(tags: Column, model: dict[str, str], unknown: str = "O") -> Column:
    """Chunk tags of an array of tags, from left to right: by the chunk tag before and the tag, else by the tag."""
    m = F.create_map(*(F.lit(x) for pair in sorted(model.items()) for x in pair)) if model else F.create_map(F.lit(""), F.lit(unknown))
    last = lambda a: F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(START))
    step = lambda a, t: F.concat(a, F.array(F.coalesce(F.try_element_at(m, F.concat_ws("|", last(a), t)), F.try_element_at(m, t), F.lit(unknown))))
    return F.aggregate(tags, F.array().cast("array<string>"), step)


def productions(tags: Column, chunks: Column) -> Column:
    """Productions of the tree of a sentence: a phrase per run B-X I-X ... as ``X->tag_tag``, and the sentence as ``S->`` its phrases
    and the tags outside of them."""
    pairs = F.arrays_zip(tags.alias("t"), chunks.alias("c"))
    start = F.array().cast("array<struct<name:string,parts:string>>")

    def step(a: Column, p: Column) -> Column:
        kind, name = F.substring(p["c"], 1, 1), F.substring(p["c"], 3, 100)
        last = F.try_element_at(a, F.lit(-1))
        goes_on = (kind == "I") & (last["name"] == name)
        grown = F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(last["name"].alias("name"), F.concat_ws("_", last["parts"], p["t"]).alias("parts"))))
        new = F.when(kind == "O", F.struct(F.lit("").alias("name"), p["t"].alias("parts"))).otherwise(F.struct(name.alias("name"), p["t"].alias("parts")))
        return F.when(F.coalesce(goes_on, F.lit(False)), grown).otherwise(F.concat(a, F.array(new)))

    tree = F.aggregate(pairs, start, step)
    phrases = F.transform(F.filter(tree, lambda x: x["name"] != ""), lambda x: F.concat(x["name"], F.lit("->"), x["parts"]))
    whole = F.concat(F.lit("S->"), F.array_join(F.transform(tree, lambda x: F.when(x["name"] == "", x["parts"]).otherwise(x["name"])), "_"))
    return F.concat(phrases, F.array(whole))
