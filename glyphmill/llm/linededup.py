"""Line dedup with DataFrame functions only: hashes of lines are range-partitioned, sorted by document and position
within each partition and streamed; what comes back is a run-length compressed keep bitmap per document, not text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm.common import BLANKS, unused, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A key that holds more than this part of all lines is counted by partial aggregation and broadcast:
#: there can be at most HEAVY_PARTS such keys, whatever the input.
HEAVY_PARTS = 8192


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line: Column, min_chars: int, min_words: int) -> Column:
    """Two 64-bit hashes with different seeds; null if the key is too short to count."""
    key = F.translate(F.trim(line, F.lit(BLANKS)), UPPER, LOWER)
    counts = F.length(key) >= max(min_chars, 2 * min_words - 1)
    if min_words > 1:  # lines of fewer characters aren't split
        counts &= F.size(F.split(key, f"[{BLANKS}]+")) >= min_words
    return F.when(counts, F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")))


def _row_key(text: Column) -> Column:
    """With the id, tells documents apart; exact repeats of a row are one document."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keep_bitmaps(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, min_words: int = 0, keep_first: bool = False) -> DataFrame:
    """For each document with a dropped line: doc_id, text_hash, n_lines, n_dropped, keep_runs.

    A line's key is the line without ASCII white space at its ends and with A-Z lower-cased. Keys of at least
    min_chars code points and min_words words (parted by ASCII white space) that are found in at least min_docs documents lose all their lines, or with keep_first
    all but the first by document and position. keep_runs: array of (start, length) runs of kept lines.
    Exact repeats of a row count as one document. No group is gathered: a key with more than 1/8192 of all lines, in however
    few documents, is decided by a partial count and a broadcast of at most 8192 keys, other keys in the sorted stream, where the
    window over a key spills to disk. A very long text is one row of hashes, 16 bytes a line.
    """
    keyed = written(
        docs.select(
            F.col(id_col).alias("doc_id"), _row_key(F.col(text_col)).alias("text_hash"),
            F.transform(_lines(F.col(text_col)), lambda x: _key(x, min_chars, min_words)).alias("keys"),
        ),
        "lines-keyed",
    )
    lines = keyed.select("doc_id", "text_hash", F.posexplode("keys").alias("pos", "key")).where(F.col("key").isNotNull()).select("doc_id", "text_hash", "pos", "key.*")

    counts = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_rows"))
    total = keyed.agg(F.sum(F.size(F.filter("keys", lambda k: k.isNotNull())))).first()[0] or 0
    heavy = written(counts.where(F.col("n_rows") > total / HEAVY_PARTS).select("h1", "h2"), "lines-heavy")
    # exact repeats of a row must not count twice, so that heavy keys are counted over distinct documents
    heavy_keys = F.broadcast(heavy)
    documents_of = lines.join(heavy_keys, ["h1", "h2"]).select("h1", "h2", "doc_id", "text_hash").distinct().groupBy("h1", "h2").agg(
        F.count(F.lit(1)).alias("n_docs"), F.min(F.struct("doc_id", "text_hash")).alias("first")
    )
    heavy_lines = lines.join(F.broadcast(documents_of), ["h1", "h2"]).where(F.col("n_docs") >= min_docs)
    if keep_first:
        own = F.struct("doc_id", "text_hash")
        first_pos = F.broadcast(
            heavy_lines.where(own.eqNullSafe(F.col("first"))).groupBy("h1", "h2").agg(F.min("pos").alias("first_pos"))
        )
        heavy_lines = heavy_lines.join(first_pos, ["h1", "h2"]).where(~(own.eqNullSafe(F.col("first")) & (F.col("pos") == F.col("first_pos"))))

    light = lines.join(heavy_keys, ["h1", "h2"], "left_anti").repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", "doc_id", "text_hash", "pos")
    stream = Window.partitionBy("h1", "h2").orderBy("doc_id", "text_hash", "pos")
    before = F.lag(F.struct("doc_id", "text_hash")).over(stream)
    light = (
        light.withColumn("new_doc", (before.isNull() | ~before.eqNullSafe(F.struct("doc_id", "text_hash"))).cast("int"))
        .withColumn("seen", F.row_number().over(stream))
        .withColumn("n_docs", F.sum("new_doc").over(Window.partitionBy("h1", "h2")))
        .where(F.col("n_docs") >= min_docs)
    )
    if keep_first:
        light = light.where(F.col("seen") > 1)
    dropped = light.select("doc_id", "text_hash", "pos").unionByName(heavy_lines.select("doc_id", "text_hash", "pos"))
    marks = dropped.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("pos")).alias("drops"))
    sizes = keyed.select("doc_id", "text_hash", F.size("keys").alias("n_lines")).distinct()
    same = marks["doc_id"].eqNullSafe(sizes["doc_id"]) & (marks["text_hash"] == sizes["text_hash"])
    both = sizes.join(marks, same, "inner").select(sizes["doc_id"], sizes["text_hash"], "n_lines", "drops")
    ends = F.arrays_zip(F.concat(F.array(F.lit(-1)), F.col("drops")).alias("a"), F.concat(F.col("drops"), F.array("n_lines")).alias("b"))
    runs = F.filter(
        F.transform(ends, lambda e: F.struct((e["a"] + 1).alias("start"), (e["b"] - e["a"] - 1).alias("length"))),
        lambda r: r["length"] > 0,
    )
    return both.select("doc_id", "text_hash", "n_lines", F.size("drops").alias("n_dropped"), runs.alias("keep_runs"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, min_words: int = 0, keep_first: bool = False) -> DataFrame:
    """docs with the kept lines, joined by a line feed, in text_col, and the columns n_lines long and n_dropped long.

    A null or empty text is one empty line and comes back as an empty text. Rows with a null id and repeated rows are
    each returned; see keep_bitmaps for how they count. Ties for the first occurrence go to the smaller id, then
    text hash, then position. Other columns stay as they are, whatever their names, unless they are named n_lines or n_dropped,
    which are replaced. Very long texts are cut into lines like others. An empty table gives no rows.
    """
    bitmaps = keep_bitmaps(docs, id_col=id_col, text_col=text_col, min_docs=min_docs, min_chars=min_chars, min_words=min_words, keep_first=keep_first)
    return with_kept_lines(docs, bitmaps, id_col=id_col, text_col=text_col)


def with_kept_lines(docs: DataFrame, bitmaps: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What dedup_lines gives for the rows of keep_bitmaps."""
    own = dict(zip(bitmaps.columns, unused(docs.columns, bitmaps.columns), strict=True))
    marks = bitmaps.select(*[F.col(c).alias(n) for c, n in own.items()])
    on = F.col(id_col).eqNullSafe(F.col(own["doc_id"])) & (_row_key(F.col(text_col)) == F.col(own["text_hash"]))
    lines, runs = _lines(F.col(text_col)), F.col(own["keep_runs"])
    kept = F.array_join(F.flatten(F.transform(runs, lambda r: F.slice(lines, r["start"] + 1, r["length"]))), "\n")
    out = docs.drop("n_lines", "n_dropped").join(marks, on, "left")
    return out.withColumns(
        {
            "n_lines": F.size(lines).cast("long"),
            "n_dropped": F.coalesce(own["n_dropped"], F.lit(0)).cast("long"),
            text_col: F.when(runs.isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(kept),
        }
    ).drop(*own.values())
