"""Line dedup: repeated lines go, except where the largest document id holds them.

Every sizeable line of every document becomes a row (hash, document, position), written once. The rows are range-partitioned by
hash and then document, and sorted by hash, document and position, so that even a line held by a third of all documents
spreads over many tasks; there the documents of a line stream by in order, and leave one row per partition with
their number and the last of them. The lines of three documents or more are a table that is broadcast where it is small and else joined
as Spark splits skewed joins, so no task has to hold a frequent line. What a document loses comes back
as a bitmap of 64-line words, of which only words with a dropped line are stored; text crosses the network
once, to meet its bitmap.

Defined cases: a null or empty text is one empty line; short lines are never dropped; rows that share a document id
count as one document, each with its own bitmap (by its text); a null id counts as the smallest id; other columns
are carried along, but for those named like an added one; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import BLANKS, ascii_lower, hash128, id_key, release, settle, without

#: Repeated lines that are broadcast at most (24 bytes each).
BROADCAST_KEYS = 1 << 20


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(BLANKS)))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.withColumns({"_ld_doc": id_key(F.col(id_col)), "_ld_row": F.xxhash64(F.col(text_col))})


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(_ld_doc, _ld_row, keep): documents that lose lines, with bit p % 64 of word p // 64 set where line p stays.

    Words without a dropped line are left out of ``keep``. The table is written to shared storage.
    """
    key1, key2 = hash128(F.col("key"))
    hashed = (
        _rows(docs.select(id_col, text_col), id_col, text_col)
        .select("_ld_doc", "_ld_row", F.posexplode(lines_of(F.col(text_col))).alias("pos", "line"))
        .select("_ld_doc", "_ld_row", "pos", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select(key1.alias("h1"), key2.alias("h2"), "_ld_doc", "_ld_row", "pos")
    )
    lines = settle(hashed, "lines")
    ordered = lines.select("h1", "h2", "_ld_doc", "pos").repartitionByRange("h1", "h2", "_ld_doc").sortWithinPartitions("h1", "h2", "_ld_doc", "pos")
    shared = settle(
        ordered.groupBy("h1", "h2", "_ld_doc")
        .agg(F.lit(1).alias("one"))
        .groupBy("h1", "h2")
        .agg(F.count("one").alias("n_docs"), F.max("_ld_doc").alias("last"))
        .where(F.col("n_docs") >= min_docs)
        .select("h1", "h2", "last"),
        "shared",
    )
    few = shared.count() <= BROADCAST_KEYS
    dropped = lines.join(F.broadcast(shared) if few else shared, ["h1", "h2"]).where(F.col("_ld_doc") != F.col("last"))
    bitmaps = settle(
        dropped.select("_ld_doc", "_ld_row", F.shiftright("pos", 6).alias("word"), F.expr("shiftleft(1L, pos & 63)").alias("bit"))
        .repartition("_ld_doc", "_ld_row")
        .groupBy("_ld_doc", "_ld_row", "word")
        .agg(F.bitwise_not(F.bit_or("bit")).alias("bits"))
        .groupBy("_ld_doc", "_ld_row")
        .agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("keep")),
        "bitmaps",
    )
    release(lines, shared)
    return bitmaps


def dropped_positions(keep: str) -> Column:
    """Positions, ascending, that a keep bitmap drops."""
    return F.expr(f"flatten(transform({keep}, w -> filter(transform(sequence(0, 63), b -> w.word * 64 + b), p -> (shiftrightunsigned(w.bits, p & 63) & 1) = 0)))")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Documents with ``text_col`` rewritten, plus n_lines and n_dropped (long) and the bitmap ``keep`` (null: all stay)."""
    docs = without(docs, ("n_lines", "n_dropped", "keep"))
    bitmaps = keep_bitmaps(docs, id_col, text_col, min_chars, min_docs)
    met = _rows(docs, id_col, text_col).join(bitmaps, ["_ld_doc", "_ld_row"], "left")
    # Only documents that lose lines are split again.
    some, text = F.col("keep").isNotNull(), F.coalesce(F.col(text_col), F.lit(""))
    lost = met.withColumns({"_ld_lines": F.when(some, lines_of(F.col(text_col))), "_ld_lost": F.when(some, dropped_positions("keep"))})
    kept = F.expr("array_join(transform(array_except(sequence(0, size(_ld_lines) - 1), _ld_lost), i -> _ld_lines[i]), '\n')")
    return lost.withColumns(
        {
            text_col: F.when(some, kept).otherwise(F.col(text_col)),
            "n_lines": (F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long"),
            "n_dropped": F.when(some, F.size("_ld_lost")).otherwise(0).cast("long"),
        }
    ).select(*docs.columns, "n_lines", "n_dropped", "keep")
