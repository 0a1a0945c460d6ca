"""Removal of lines that many sites share, by sketches of the sites of each line."""

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import packed, read, settled

#: A line on so many distinct sites is boilerplate, however long. Sketches of the sites have 2 ** LG_K buckets.
MIN_SITES, LG_K = 10, 12

ORACLE = f"""
WITH normal AS (
  SELECT source, lower(trim(line, ' ' || chr(9) || chr(13))) AS line
  FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)
), boiler AS (
  SELECT line FROM normal WHERE line <> ''
  GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}
), b AS (
  SELECT list(line) AS ls FROM boiler
), done AS (
  SELECT doc_id, string_split(text, chr(10)) AS p,
         list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(coalesce(ls, []), lower(trim(x, ' ' || chr(9) || chr(13))))) AS kept
  FROM documents, b WHERE text IS NOT NULL
)
SELECT doc_id, len(p) - len(kept) AS removed_lines, array_to_string(kept, chr(10)) AS text
FROM done WHERE len(kept) < len(p) AND len(list_filter(kept, lambda x: trim(x, ' ' || chr(9) || chr(13)) <> '')) > 0
"""


def _normal(line: Column) -> Column:
    return F.lower(F.btrim(line, F.lit(" \t\r")))


def _hashed(docs: DataFrame, site: str) -> DataFrame:
    """(site, t1, t2, lines): of every text its site, two hashes of it, and the hashes of its distinct lines but blank ones."""
    lines = F.array_distinct(F.transform(F.filter(F.transform(F.split(docs["text"], "\n"), _normal), lambda x: F.length(x) > 0), lambda x: F.xxhash64(x)))
    return docs.where(docs["text"].isNotNull()).select(docs[site].cast("string").alias("site"), F.xxhash64(docs["text"]).alias("t1"), F.xxhash64(docs["text"], F.lit(1)).alias("t2"), lines.alias("lines"))


def _spread(hashed: DataFrame, min_sites: int, lg_k: int) -> DataFrame:
    lines = hashed.select("site", F.explode("lines").alias("line_hash"))
    margin = math.ceil(min_sites * 3 * 1.04 / math.sqrt(2**lg_k)) + 1
    spread = lines.groupBy("line_hash").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("sites")).where(F.col("sites") >= min_sites - margin)
    sure = spread.where(F.col("sites") > min_sites + margin).select("line_hash")
    near = spread.where(F.col("sites") <= min_sites + margin).select("line_hash")
    exact = lines.join(near, "line_hash", "left_semi").groupBy("line_hash").agg(F.countDistinct("site").alias("sites")).where(F.col("sites") >= min_sites).select("line_hash")
    return sure.unionByName(exact)


def boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """(line_hash) of the lines that stand on at least `min_sites` distinct sites.

    A HyperLogLog sketch of the sites of each line is merged by the aggregation. Beyond three standard errors (and one
    site) around the threshold the sketch decides; the lines within get an exact count. Lines of any length count. Blank
    lines are never boilerplate; a null site isn't a site; null texts have no lines, an empty table gives no rows.
    """
    return _spread(_hashed(docs, site), min_sites, lg_k)


def line_dedup(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """(row, removed, kept): each row of `docs` as a struct, how many lines of its text went, and the text that is left.

    docs has text and the site's column; whatever other columns it has, of whatever names, stay in row. Lines are compared trimmed
    and in lower case, and split once, into hashes that are written to the shared folder. All occurrences of boilerplate go, however long they are.
    A text of boilerplate alone is a copied document rather than a page with boilerplate: to take all its lines would lose it from
    every site, so it stays whole, for near dedup. Null and empty texts stay as they are. Every row gives one row, by its text alone,
    whatever its doc_id; equal texts are treated alike. An empty table gives no rows.
    """
    hashed = settled(_hashed(docs, site))
    bad = _spread(hashed, min_sites, lg_k)
    at = hashed.select("t1", "t2", F.explode("lines").alias("line_hash"))
    of = at.join(bad, "line_hash", "left_semi").groupBy("t1", "t2").agg(F.collect_set("line_hash").alias("bad"))  # as large as the text at most
    text = docs["text"]
    found = packed(docs, text=text, t1=F.xxhash64(text), t2=F.xxhash64(text, F.lit(1))).join(of, ["t1", "t2"], "left")
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda x: ~F.array_contains("bad", F.xxhash64(_normal(x))))
    found = found.select("row", "text", F.when(F.col("bad").isNotNull(), kept).alias("left"))
    some = F.col("left").isNotNull() & F.exists("left", lambda x: F.length(_normal(x)) > 0)
    return found.select("row", F.when(some, F.size(lines) - F.size("left")).otherwise(0).alias("removed"), F.when(some, F.array_join("left", "\n")).otherwise(F.col("text")).alias("kept"))


def without_boilerplate(docs: DataFrame, **options) -> DataFrame:
    """`docs` with the boilerplate lines taken out of text, and n_chars, if there is one, counted anew where lines went; see line_dedup()."""
    done = line_dedup(docs, **options)
    row = {c: F.col("row")[c] for c in docs.columns}
    new = {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("removed") > 0, F.length("kept").cast(dict(docs.dtypes)["n_chars"])).otherwise(row["n_chars"])
    return done.select(*[new.get(c, row[c]).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return done.where("removed > 0").select("row.doc_id", F.col("removed").cast("long").alias("removed_lines"), F.col("kept").alias("text"))
