"""Order-dependent filters of a question's few retrieved chunks, as folds over one small array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlark.config import DEFAULTS, Config
from auditlark.functions import text as T

CHUNK = "struct<distance:double,chunk_id:bigint,module:string,similarity:double,semantic:double,keyword:double,boost:double,text:string>"


def collected(rows: DataFrame) -> DataFrame:
    """Scored rows -> (query_id, question, top, chunks): chunks by distance then id; top is the best similarity."""
    keyword = F.col("keyword") if "keyword" in rows.columns else F.lit(None)
    parts = F.struct(F.col("distance").cast("double").alias("distance"), F.col("chunk_id").cast("long").alias("chunk_id"), "module", F.col("similarity").cast("double").alias("similarity"), F.col("semantic").cast("double").alias("semantic"), keyword.cast("double").alias("keyword"), F.col("boost").cast("double").alias("boost"), "text")
    return rows.groupBy("query_id", "question").agg(F.max("similarity").alias("top"), F.array_sort(F.collect_list(parts)).alias("chunks"))


def _none() -> Column:
    return F.expr(f"cast(array() as array<{CHUNK}>)")


def deduplicated(chunks: Column | str, c: Config = DEFAULTS) -> Column:
    """Drops blank chunks, reading-list entries, and those that hold or are held by a kept one of the same module."""

    def fold(kept: Column, x: Column) -> Column:
        t = F.lower(T.strip(x["text"]))
        twin = F.exists(kept, lambda y: y["module"].eqNullSafe(x["module"]) & (F.contains(F.lower(T.strip(y["text"])), t) | F.contains(t, F.lower(T.strip(y["text"])))))
        return F.when((t == "") | T.is_reference_entry(x["text"], c) | twin, kept).otherwise(F.array_append(kept, x))

    return F.aggregate(T.col(chunks), _none(), fold)


def gap_filtered(chunks: Column | str, c: Config = DEFAULTS) -> Column:
    """The first chunk, then those within the gap to it: the narrow one in a kept module, the wide one in a new."""

    def fold(kept: Column, x: Column) -> Column:
        name = lambda y: F.coalesce(F.nullif(y["module"], F.lit("")), F.lit("Unknown"))
        gap = F.get(kept, 0)["similarity"] - x["similarity"]
        known = F.exists(kept, lambda y: name(y) == name(x))
        fits = (F.size(kept) == 0) | ((F.size(kept) < c.most_kept) & F.when(known, gap <= c.same_gap).otherwise(gap <= c.cross_gap))
        return F.when(fits, F.array_append(kept, x)).otherwise(kept)

    return F.aggregate(T.col(chunks), _none(), fold)


def cleaned(chunks: Column | str, c: Config = DEFAULTS) -> Column:
    return F.filter(T.col(chunks), lambda x: ~T.is_noisy(x["text"], c) & ~T.is_low_information(x["text"], c))


def modules_of(chunks: Column | str, c: Config = DEFAULTS) -> Column:
    """Distinct modules of the chunks that are similar enough, in their order; unknown and empty ones don't count."""
    similar = F.filter(T.col(chunks), lambda x: (x["similarity"] >= c.module_similarity) & x["module"].isNotNull() & (T.strip(x["module"]) != "") & ~F.lower(T.strip(x["module"])).isin("unknown", "none"))
    return F.array_distinct(F.transform(similar, lambda x: T.strip(x["module"])))
