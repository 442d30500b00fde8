"""Operator 4: exact duplicates with a split between frequent and other digests.

Native: DataFrame and SQL functions only.

1. Each text is normalised (white-space runs become one space), hashed with
   SHA-256 and written as a narrow table (row, doc_id, digest).
2. A frequent-items sketch (``approx_top_k``, a mergeable Misra-Gries summary
   of bounded size) names digests that may hold more than ``share`` of the
   rows.  The sketch only routes rows; a wrong or missing item costs time only.
3. Of these at most ``limit`` digests the exact winners and sizes are
   aggregated with map-side combining, then broadcast: their rows never
   meet in one task.
4. All other digests go through ordinary shuffles of the narrow table: one
   aggregate with map-side combining finds those that occur again, and a left
   join tells their rows.  No group is ever gathered in one task.

Null text counts as empty.  Of equal texts the row with the smallest doc_id
stays; a null doc_id comes last, and of repeated rows (ties in doc_id too)
exactly one stays.  Texts are taken whole at any length.  Columns other than
doc_id and text may have any names; they are not read and stay as they are.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalake.llm.common import SPACE, own_column, written

#: A digest with this share of the rows is looked for by the sketch.
SHARE = 1 / 1000
#: The most digests that are treated as frequent (bounds the broadcast).
LIMIT = 1024
TRACKED = 16384


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(doc_id).alias("doc_id"),
        F.unhex(F.sha2(normalised(F.col(text)), 256)).alias("digest"),
    )


def frequent(table: DataFrame, share: float = SHARE, limit: int = LIMIT) -> list[int]:
    """64-bit hashes of digests that may hold ``share`` of the rows; at most ``limit``."""
    got = table.agg(
        F.expr(f"approx_top_k(xxhash64(digest), {limit}, {TRACKED})").alias("top"), F.count(F.lit(1)).alias("n")
    ).first()
    return [x["item"] for x in got["top"] or [] if x["count"] > max(1, share * got["n"])]


def decide(table: DataFrame, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """(row, doc_id, keep_id, group_size, kept, digest) for a written ``digests`` table."""
    hot = frequent(table, share, limit)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    is_hot = F.xxhash64("digest").isin(hot) if hot else F.lit(False)

    rest = table.filter(~is_hot)
    again = rest.groupBy("digest").agg(first.alias("best"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    alone = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    light = rest.join(again, "digest", "left").select(
        "row", "doc_id", "digest", F.coalesce("best", alone).alias("best"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size")
    )
    parts = light
    if hot:
        # At most as many rows as hashes in `hot`, but for collisions of 64 bits.
        winners = table.filter(is_hot).groupBy("digest").agg(first.alias("best"), F.count(F.lit(1)).alias("group_size"))
        parts = light.unionByName(table.filter(is_hot).join(F.broadcast(winners), "digest"))
    return parts.select(
        "row",
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        "digest",
    )


def exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    table = written(digests(docs, text, doc_id), "digests")
    return decide(table).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose text an earlier row has; all columns stay."""
    decided = written(decide(written(digests(docs, text, doc_id), "digests")), "decided")
    ids = decided.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("ids")).first()
    if ids["n"] == ids["ids"]:  # ids are unique and never null: they name the rows
        mark = own_column(docs, "gone")
        # Written, so that its size is known to the join.
        gone = written(decided.filter(~F.col("kept")).select(F.col("doc_id").alias(mark)), "gone")
        return docs.join(gone, docs[doc_id] == gone[mark], "left_anti")
    # Repeated or null ids: rows are named by id and digest, and of rows that are
    # equal in both, one stays if any of them was kept.
    mark, named, of = (own_column(docs, c) for c in ("digest_of_text", "id_of_row", "digest_of_row"))
    state = decided.groupBy(F.col("doc_id").alias(named), F.col("digest").alias(of)).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("copies")).filter("kept")
    marked = docs.withColumn(mark, F.unhex(F.sha2(normalised(F.col(text)), 256)))
    on = marked[doc_id].eqNullSafe(F.col(named)) & (marked[mark] == F.col(of))
    single = marked.join(state.filter("copies = 1").select(named, of), on, "left_semi")
    several = marked.join(state.filter("copies > 1").select(named, of), on, "left_semi").dropDuplicates([doc_id, mark])
    return single.unionByName(several).drop(mark)
