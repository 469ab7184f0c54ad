"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.llm.common import flag_in, join_hot, lower_az, maybe_in, written

PREFIX_CHARS = 64


def _keyed(rows: DataFrame, prefix_chars: int) -> DataFrame:
    """rows with _n (length) and _p (prefix hash, which covers the length); null text is empty."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    return rows.withColumn("_text", text).withColumn("_n", F.octet_length("_text").cast("long")).withColumn("_p", F.xxhash64(lower_az(F.substring("_text", 1, prefix_chars)), "_n"))


def _shared_prefixes(levels: DataFrame) -> DataFrame:
    """(_p, _rows) of the prefix hashes that occur repeatedly, among lengths that do. A length or prefix of any number of
    rows is one pre-aggregated row a task: lengths are counted by prefix first, so rows themselves never meet by length."""
    prefixes = levels.groupBy("_n", "_p").agg(F.count("*").alias("_rows"))
    lengths = prefixes.groupBy("_n").agg(F.sum("_rows").alias("_of"), F.count("*").alias("_w")).where("_of > 1").select("_n", "_w")
    return join_hot(written(prefixes), written(lengths), "_n", "_w").groupBy("_p").agg(F.sum("_rows").alias("_rows")).where("_rows > 1")


def keep_last(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """docs with one row of each set of equal texts (but for the case of A-Z): one with the largest id. All columns stay as
    they are, whatever their names.

    Null text counts as empty; very long texts are hashed whole; an empty table gives no rows. Only rows whose prefix hash may be shared move; each task first reduces its rows of a text to one, so a group of any
    size is a row a task. Of repeated ids in a group any one row stays; a null id stays only where no real one is.
    """
    keyed = _keyed(docs.withColumn("_row", F.struct(*docs.columns)).select("_row", F.col(f"_row.{text_col}").alias("_text")), prefix_chars)
    flagged = flag_in(keyed, "_p", _shared_prefixes(keyed.select("_n", "_p")))
    key = F.col(f"_row.{id_col}")
    last = flagged.where("_flag").groupBy("_n", F.sha2(lower_az(F.col("_text")), 256).alias("_sha")).agg(F.max_by("_row", F.struct(key.isNotNull(), key)).alias("_row"))
    return flagged.where("not _flag").select("_row.*").unionByName(last.select("_row.*"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS, digest_all: bool = False) -> DataFrame:
    """Every input row with keep_id, group_size, kept and text_sha256 beside its id.

    Texts are equal when identical after lower-casing A-Z. Rows are narrowed level by level: byte lengths that occur
    once drop out, then (length, prefix hash) pairs that occur once; only rows of pairs that survive have their whole
    text hashed (all rows with digest_all, for callers that need the digest as a column). The levels shuffle a few
    dozen bytes a row and count with map-side combining, so a length or text shared by a third of the rows is one
    pre-aggregated row; the text itself is never shuffled.

    Null text counts as empty. A null id never stays over a real one; a group of null ids alone keeps them (keep_id
    null). Repeated rows count each towards group_size and carry the same verdict. An empty table gives no rows.
    text_sha256 is null for rows that no level needed to read, unless digest_all. Other columns are ignored.
    """
    keyed = _keyed(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")), prefix_chars)
    full = F.sha2(lower_az(F.col("_text")), 256)
    levels = written(keyed.select("doc_id", "_n", "_p", *([full.alias("text_sha256")] if digest_all else [])))
    prefixes = written(_shared_prefixes(levels.select("_n", "_p")))
    # A bitmap of fixed size tells which rows to read in full; the join on _p after it is exact.
    read = maybe_in(levels if digest_all else keyed, "_p", prefixes)
    if not digest_all:
        read = written(read.select("doc_id", "_n", "_p", full.alias("text_sha256")))
    marked = written(join_hot(read, prefixes, "_p", "_rows"))
    groups = written(marked.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1"))
    met = join_hot(levels if digest_all else marked, groups.withColumn("_weight", F.col("group_size")), "text_sha256", "_weight", "left")
    out = met.select("doc_id", "text_sha256", "keep_id", "group_size")
    if not digest_all:
        alone = levels.join(prefixes, "_p", "left_anti")
        out = out.unionByName(alone.select("doc_id", F.lit(None).cast("string").alias("text_sha256"), F.lit(None).cast(groups.schema["keep_id"].dataType).alias("keep_id"), F.lit(None).cast("long").alias("group_size")))
    size = F.coalesce("group_size", F.lit(1).cast("long"))
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), size.alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), "text_sha256")
