"""Benchmark decontamination: windows of documents that reach a Jaccard similarity with an item, without misses.

Texts are compared as lower-cased runs of letters and digits. A window of a document has as many words as the item
it may hold (fewer at the document's end) and may start at any word. Its similarity is the Jaccard coefficient of the
sets of shingles (GRAM words, fewer for items of fewer words). A window that reaches `similarity` holds at least
ceil(similarity * a) of an item's a shingles, so it holds one of any a - ceil(similarity * a) + 1 of them; the ones that
the fewest items have are looked up in the documents, and every window around a hit is verified. (No radius of a SimHash
gives such a bound: a few changed words can turn every bit whose vote is close. Blocks of a radius of 11 bits found 141 of
160 changed items.) Items of equal words are compared once.

DataFrame functions only. The item side is broadcast only if it has at most SMALL shingles, else both
sides are shuffled. Null and empty texts match nothing, as do null or empty items; rows with a null doc_id
are not compared; repeated rows give one match per document id; extra columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, packed, skew_join, unpacked, without

GRAM = 5
SIMILARITY = 0.8
SMALL = 200_000


def _words(text: Column) -> Column:
    """Hashes of the words of a text."""
    cut = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(cut, lambda w: w != ""), lambda w: F.xxhash64(w))


def _grams(words: str, size: int) -> str:
    """SQL: the hashes of each run of `size` words, in order."""
    run = ", ".join(f"{words}[i + {j}]" for j in range(size))
    return f"case when size({words}) >= {size} then transform(sequence(0, size({words}) - {size}), i -> xxhash64({run})) else cast(array() as array<bigint>) end"


def _small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """df with a broadcast hint if it has at most `most` rows; otherwise Spark shuffles both sides."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def items_of(benchmark: DataFrame) -> DataFrame:
    """item_id, key (of its words), n (words), g (shingle length) and grams (distinct) of each item that has words."""
    items = benchmark.where("item_id is not null").select(F.col("item_id"), _words(F.col("text").cast("string")).alias("w"))
    items = items.withColumn("n", F.size("w")).where("n > 0").withColumn("g", F.least("n", F.lit(GRAM)))
    by_size = " ".join(f"when g = {g} then {_grams('w', g)}" for g in range(1, GRAM + 1))
    items = items.select("item_id", F.xxhash64("w").alias("key"), "n", "g", F.expr(f"array_distinct(case {by_size} end)").alias("grams"))
    return materialize(items.dropDuplicates(["item_id", "key"]), "items")


def rare_grams(texts: DataFrame, similarity: float) -> DataFrame:
    """(g, h, key): of each text's a shingles the a - ceil(similarity * a) + 1 that the fewest texts have."""
    each = texts.select("key", "g", F.explode("grams").alias("h"))
    held = each.groupBy("g", "h").agg(F.count("*").alias("texts"))
    listed = each.join(held, ["g", "h"]).groupBy("key", "g").agg(F.sort_array(F.collect_list(F.struct("texts", "h"))).alias("x"))
    # rounding may only lengthen the list
    count = f"size(x) - greatest(1, cast(ceil({similarity}D * size(x) - 1e-9D) as int)) + 1"
    return materialize(listed.select("g", "key", F.explode(F.expr(f"slice(x, 1, {count})")).alias("y")).select("g", "y.h", "key"), "rare")


def match(documents: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, similarity (of the best window), start (its first word, from 0) and n_windows, for each
    document and item of which a window reaches `similarity`."""
    items = items_of(benchmark)
    contents = materialize(items.dropDuplicates(["key"]).drop("item_id"), "contents")
    sizes = [r["g"] for r in contents.select("g").distinct().collect()]  # at most GRAM numbers
    texts = documents.where("doc_id is not null and text is not null").select("doc_id", F.col("text").cast("string").alias("text"))
    worded = texts.select("doc_id", _words(F.col("text")).alias("w"))

    hits = None
    for g in sizes:
        found = worded.select("doc_id", F.posexplode(F.expr(_grams("w", g))).alias("pos", "h")).withColumn("g", F.lit(g))
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        none = documents.select("doc_id").join(items.select("item_id"), F.lit(False))
        return none.selectExpr("doc_id", "item_id", "0D as similarity", "0 as start", "0L as n_windows")
    hits = hits.join(_small(rare_grams(contents, similarity)), ["g", "h"])
    hits = hits.groupBy("doc_id", "key").agg(F.collect_set("pos").alias("pos")).join(contents, "key")
    near = hits.groupBy("doc_id", "g").agg(F.collect_list(F.struct("key", "n", "grams", "pos")).alias("at"))
    near = materialize(near, "near")

    # all windows around the hits; documents without a hit are left out before any exchange, if the ids are few
    ids = near.select("doc_id").distinct()
    rows = skew_join(texts.join(_small(ids), "doc_id", "left_semi"), near, "doc_id").select("doc_id", "g", _words(F.col("text")).alias("w"), "at")
    by_size = " ".join(f"when g = {g} then {_grams('w', g)}" for g in sizes)
    rows = rows.select("doc_id", "g", F.expr(f"case {by_size} end").alias("own"), "at").select("doc_id", "g", "own", F.inline("at"))
    starts = "array_distinct(flatten(transform(pos, p -> sequence(greatest(p - (n - g), 0), p))))"
    jaccard = "transform(array(size(array_intersect(v, grams))), c -> c / (size(grams) + size(array_distinct(v)) - c))[0]"
    scored = f"transform({starts}, s -> transform(array(slice(own, s + 1, n - g + 1)), v -> struct({jaccard} as similarity, -s as s))[0])"
    found = rows.select("doc_id", "key", F.expr(f"filter({scored}, x -> x.similarity >= {similarity}D)").alias("good")).where("size(good) > 0")
    found = found.join(items.select("key", "item_id"), "key").groupBy("doc_id", "item_id")
    found = found.agg(F.max(F.array_max("good")).alias("best"), F.flatten(F.collect_list("good.s")).alias("starts"))
    n_windows = F.size(F.array_distinct("starts")).cast("long").alias("n_windows")
    return found.select("doc_id", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.s")).alias("start"), n_windows)


def decontaminate(documents: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """documents without those whose text holds an item. Rows are told apart by their texts, so that rows without an id
    are compared too, and a clean row stays though its id has a row that goes; rows with a null text stay."""
    text = F.col("text").cast("string")
    key = F.struct(F.xxhash64(text), F.xxhash64(F.lit("text"), text))  # 128 bits
    texts = documents.where("text is not null").select(key.alias("doc_id"), text.alias("text"))
    hit = match(texts, benchmark, similarity).select("doc_id").distinct().select(F.col("doc_id.col1").alias("__h1"), F.col("doc_id.col2").alias("__h2"))
    keyed = packed(documents, "text").withColumns({"__h1": F.xxhash64(text), "__h2": F.xxhash64(F.lit("text"), text)})
    return unpacked(without(keyed, hit, ["__h1", "__h2"]), documents.columns)


def oracle_sql(similarity: float = SIMILARITY) -> str:
    """match() in DuckDB's SQL: every window of each document that shares a shingle with an item, for small tables."""
    words = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
    grams = "list_transform(range(1, len(w) - g + 2), lambda p: array_to_string(w[p:p + g - 1], ' '))"
    return f"""
WITH i AS (SELECT item_id, w, len(w) AS n, least(len(w), {GRAM}) AS g FROM (SELECT item_id, {words} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL) WHERE len(w) > 0),
k AS (SELECT item_id, n, g, list_distinct({grams}) AS grams FROM i),
o AS (SELECT doc_id, g, {grams} AS own FROM (SELECT doc_id, {words} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL) CROSS JOIN (SELECT DISTINCT g FROM k) WHERE len(w) >= g),
c AS (SELECT DISTINCT doc_id, item_id FROM (SELECT doc_id, g, unnest(own) AS h FROM o) JOIN (SELECT item_id, g, unnest(grams) AS h FROM k) USING (g, h)),
x AS (SELECT doc_id, item_id, s, grams, own[s + 1:s + n - g + 1] AS v FROM (SELECT *, unnest(range(len(own))) AS s FROM c JOIN k USING (item_id) JOIN o USING (doc_id, g))),
y AS (SELECT doc_id, item_id, s, len(list_intersect(v, grams)) AS shared, len(list_distinct(v)) AS b, len(grams) AS a FROM x),
z AS (SELECT doc_id, item_id, s, shared / (a + b - shared) AS similarity FROM y WHERE shared / (a + b - shared) >= {similarity})
SELECT doc_id, item_id, max(similarity) AS similarity, arg_max(s, (similarity, -s))::INT AS start, count(DISTINCT s) AS n_windows FROM z GROUP BY doc_id, item_id
"""
