"""Benchmark decontamination: size-partitioned MinHash containment search.

Items are partitioned by how many distinct five-word shingles they have, in classes that
double. Under one random order of shingles (their hash), an item is sketched by its
smallest values; how many follows from its class, so that a document that holds 0.8 or
more of an item's shingles holds one of the sketch's: with q shingles and at most
q - ceil(0.8 q) of them missing, one more than those can't all be missing. A document
needs no sketch: each shingle of its whole text probes the items' sketches, so a short
item inside a long document is found as surely as in a short one. Candidate pairs are
verified by exact containment of shingles as text.

Plain DataFrame functions throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import only, table
from kinweave.plans.staging import staged

WIDTH, NEED = 5, (4, 5)  # shingle words; containment 4/5
#: Sketch rows up to which all executors get them; beyond, the join shuffles.
BROADCAST_ROWS = 200_000


def words(text: F.Column) -> F.Column:
    """Lower-case runs of letters and digits."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def _windows(name: str, width: int, of) -> F.Column:
    """``of`` applied to every ``width`` consecutive words."""
    array = F.col(name)
    return F.when(
        F.size(array) >= width,
        F.transform(F.sequence(F.lit(0), F.size(array) - width), lambda i: of(*(F.get(array, i + j) for j in range(width)))),
    ).otherwise(F.array())


def shingle_text(name: str, width: int) -> F.Column:
    return _windows(name, width, lambda *w: F.concat_ws(" ", *w)).cast("array<string>")


def shingle_hash(name: str, width: int) -> F.Column:
    return _windows(name, width, lambda *w: F.xxhash64(*w)).cast("array<long>")


def item_sketches(items: DataFrame) -> DataFrame:
    """``(key, item_id, width, shingles, q, sketch)``. An item shorter than a shingle is one
    shingle of its own width; items without words are left out."""
    split = items.where("item_id is not null").select("item_id", words(F.col("text")).alias("w"), F.xxhash64("item_id", "text").alias("key")).where("size(w) > 0").dropDuplicates(["key"])
    sized = split.withColumn("width", F.least(F.size("w"), F.lit(WIDTH)))
    text, number = shingle_text("w", WIDTH), shingle_hash("w", WIDTH)
    for n in range(1, WIDTH):
        text = F.when(F.col("width") == n, shingle_text("w", n)).otherwise(text)
        number = F.when(F.col("width") == n, shingle_hash("w", n)).otherwise(number)
    full = sized.select("key", "item_id", "width", F.array_distinct(text).alias("shingles"), F.array_sort(F.array_distinct(number)).alias("order")).withColumn("q", F.size("shingles"))
    bound = (F.lit(2) ** (F.floor(F.log2("q")) + 1) - 1).cast("int")  # the largest size of the item's class
    missing = bound - F.ceil(bound * NEED[0] / NEED[1]).cast("int")
    return full.select("key", "item_id", "width", "shingles", "q", F.slice("order", 1, missing + 1).alias("sketch"))


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``(doc_id, item_id, n_shingles, n_found, containment)`` of pairs at 0.8 or more.

    Null and empty texts hold nothing. Rows without doc_id or item_id are not reported.
    Rows that share a doc_id, or an item_id, count as their best match. Empty tables
    give an empty result.
    """
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    sketches = staged(item_sketches(items), "sketches")
    probes = sketches.select("key", "width", F.explode("sketch").alias("h"))
    sizes = sketches.groupBy("width").agg(F.sum(F.size("sketch")).alias("n")).collect()  # a row for each width, five at most
    if sum(r["n"] for r in sizes) <= BROADCAST_ROWS:
        probes = F.broadcast(probes)
    split = docs.select("doc_id", words(F.col("text")).alias("w"))
    # Shingles of all widths that items have, in one pass; those of another width than the item's fail the verification.
    every = F.concat(*(shingle_hash("w", width) for width in sorted(r["width"] for r in sizes) or [WIDTH]))
    hashes = split.select("doc_id", F.explode(F.array_distinct(every)).alias("h"))
    found = staged(hashes.join(probes, "h").select("doc_id", "key").distinct(), "candidates")
    candidates = found.join(sketches.select("key", "item_id", "width", "shingles", "q"), "key")
    # Only texts with a candidate travel, as far as a filter of bounded size can tell.
    joined = only(docs, found, "doc_id").join(candidates, "doc_id").withColumn("w", words(F.col("text")))
    held = shingle_text("w", WIDTH)
    for n in range(1, WIDTH):
        held = F.when(F.col("width") == n, shingle_text("w", n)).otherwise(held)
    exact = joined.select("doc_id", "item_id", F.col("q").cast("long").alias("n_shingles"), F.size(F.array_intersect("shingles", held)).cast("long").alias("n_found"))
    # The bound comes after the aggregation: a filter on the count itself would be pushed
    # below the projection that splits the text, and split it again for every shingle.
    share = F.col("n_found") / F.col("n_shingles")
    best = exact.groupBy("doc_id", "item_id").agg(F.max(F.struct(share.alias("containment"), "n_shingles", "n_found")).alias("b"))
    best = best.select("doc_id", "item_id", "b.n_shingles", "b.n_found", "b.containment")
    return best.where(F.col("n_found") * NEED[1] >= F.col("n_shingles") * NEED[0])


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, and rows without doc_id."""
    gone = contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM documents WHERE doc_id IS NOT NULL
), i AS (
  SELECT item_id, text, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM benchmark WHERE item_id IS NOT NULL
), sized AS (
  SELECT *, least(len(w), 5) AS n FROM i WHERE w <> ['']
), items AS (
  SELECT DISTINCT item_id, text, n, array_to_string(w[p:p + n - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS p FROM sized)
), ds AS (
  SELECT DISTINCT doc_id, n, array_to_string(w[p:p + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM sized) WHERE w <> [''] AND len(w) >= n)
), q AS (
  SELECT item_id, text, count(*) AS q FROM items GROUP BY item_id, text
), m AS (
  SELECT doc_id, item_id, text, count(*) AS m FROM ds JOIN items USING (n, s) GROUP BY doc_id, item_id, text
), best AS (
  SELECT doc_id, item_id, max(row(CAST(m AS DOUBLE) / q, q, m)) AS b FROM m JOIN q USING (item_id, text) GROUP BY doc_id, item_id
)
SELECT doc_id, item_id, b[2] AS n_shingles, b[3] AS n_found, b[1] AS containment FROM best WHERE b[3] * 5 >= b[2] * 4
"""
