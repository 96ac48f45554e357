"""Line de-duplication with DataFrame functions only.

A line's key is the line without ASCII white space at both ends, A-Z in lower
case.  A key of at least ``min_chars`` code points that at least ``min_docs``
documents hold is a repeated line; it stays in the largest doc_id that holds it
and goes everywhere else.

Keys are carried as 128 hash bits.  They are range-partitioned, and sorted
within by document (largest first) and position, so the first rank of a key is
the document that keeps it.  A key that holds more rows than a partition's share
would fill its range alone; such keys (there is at most one for each partition,
and a frequent-items sketch finds them) take another exact way: aggregated with
partial sums, and joined back by a broadcast of one row each.  A key's result
does not depend on the way it takes.

The result is a run-length coded bitmap of kept lines per document; ``apply``
makes texts of it.

Edge cases: a null or empty text is one empty line, which is too short to be a
key.  Rows with a null doc_id drop nothing and count for nothing.  Rows with the
same doc_id count as one document; each is filtered by its own text, so that
repeated rows lose the same lines and ties don't arise.  Texts of any length are
read whole.  An empty table gives an empty result.  Other columns are carried in
a struct, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kilnwork.llm.shared import drop, stored

MIN_CHARS, MIN_DOCS = 20, 3
#: A key with more rows than this many partitions' share of all counts as hot.
HOT_PARTITIONS = 1.0
#: Tracked items of the sketch for each partition, so that it finds every hot key; and the sketch's limits.
_TRACKED, _LEAST, _MOST = 16, 20_000, 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANKS = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(_BLANKS)), _UPPER, _LOWER)


def keyed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, doc_id, copy, pos) of every line that is long enough; copy tells texts of the same doc_id apart."""
    lines = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("copy"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    keys = lines.select("doc_id", "copy", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return keys.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "copy", "pos")


def hot_keys(keys: DataFrame) -> list[int]:
    """First hash halves that may hold more than a partition's share of all rows; at most one for each partition or so."""
    parts = _parts(keys)
    tracked = min(_MOST, max(_LEAST, _TRACKED * parts))
    row = keys.agg(F.count("*").alias("n"), F.expr(f"approx_top_k(h1, {min(2 * parts, tracked)}, {tracked})").alias("top")).first()
    return [x["item"] for x in row["top"] or [] if x["count"] > HOT_PARTITIONS * row["n"] / parts]


def _parts(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def dropped_lines(keys: DataFrame, min_docs: int) -> DataFrame:
    """(doc_id, copy, pos) of every line that goes."""
    hot = hot_keys(keys)
    is_hot = F.col("h1").isin(hot) if hot else F.lit(False)
    parts = _parts(keys)
    by_key = Window.partitionBy("h1", "h2")
    ranked = keys.where(~is_hot).repartitionByRange(parts, "h1", "h2").withColumn("rank", F.dense_rank().over(by_key.orderBy(F.desc("doc_id"))))
    cold = ranked.withColumn("n_docs", F.max("rank").over(by_key)).where((F.col("rank") > 1) & (F.col("n_docs") >= min_docs)).select("doc_id", "copy", "pos")
    if not hot:
        return cold
    rows = keys.where(is_hot)
    stats = rows.select("h1", "h2", "doc_id").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper")).where(F.col("n_docs") >= min_docs)
    # About one row for each partition; whole keys that share a first half are as good as none.
    warm = rows.join(F.broadcast(stats), ["h1", "h2"]).where(F.col("doc_id") != F.col("keeper")).select("doc_id", "copy", "pos")
    return cold.unionAll(warm)


def bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Runs of dropped lines by (doc_id, copy) for documents that lose any; a stored table.

    ``dropped`` is an array of (first, length), sorted: the run-length code of the bitmap.
    """
    keys, path = stored(keyed_lines(docs, min_chars), "line-keys")
    rows = dropped_lines(keys, min_docs)
    of_doc = Window.partitionBy("doc_id", "copy")
    # Repeated rows give a position more than once; the dense rank numbers positions, whatever their copies.
    runs = rows.select("doc_id", "copy", "pos", (F.col("pos") - F.dense_rank().over(of_doc.orderBy("pos"))).alias("run")).groupBy("doc_id", "copy", "run").agg(F.min("pos").alias("first"), (F.max("pos") - F.min("pos") + 1).alias("length"))
    found, _ = stored(runs.groupBy("doc_id", "copy").agg(F.array_sort(F.collect_list(F.struct("first", "length"))).alias("dropped")), "line-runs")
    drop(docs.sparkSession, path)
    return found


def apply(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """docs' columns but text as a struct ``doc``, and a struct ``line_dedup``.

    That has n_lines, n_dropped, kept_runs, kept_text (empty for a null text) and
    had_text.  Texts cross the join once, as arrays of lines.
    """
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    left = docs.select(others.alias("doc"), F.split("text", "\n", -1).alias("lines"), F.col("doc_id").alias("doc_key"), F.xxhash64("text").alias("copy_key"))
    right = runs.select(F.col("doc_id").alias("right_doc"), F.col("copy").alias("right_copy"), "dropped")
    joined = left.join(right, (F.col("doc_key") == F.col("right_doc")) & (F.col("copy_key") == F.col("right_copy")), "left")
    had_text = F.col("lines").isNotNull()
    n_lines = F.when(had_text, F.size("lines")).otherwise(1)
    gone = F.coalesce("dropped", F.array().cast("array<struct<first:int,length:int>>"))
    kept = F.transform(
        F.sequence(F.lit(0), F.size(gone)),
        lambda i: F.struct(
            F.when(i == 0, 0).otherwise(F.get(gone, i - 1)["first"] + F.get(gone, i - 1)["length"]).alias("first"),
            F.when(i == F.size(gone), n_lines).otherwise(F.get(gone, i)["first"]).alias("end"),
        ),
    )
    joined = joined.select("doc", "lines", "dropped", F.filter(kept, lambda r: r["end"] > r["first"]).alias("kept_runs"))
    n_dropped = F.coalesce(F.aggregate("dropped", F.lit(0), lambda a, r: a + r["length"]), F.lit(0))
    text = F.array_join(F.flatten(F.transform("kept_runs", lambda r: F.slice(F.col("lines"), r["first"] + 1, r["end"] - r["first"]))), "\n")
    whole = F.coalesce(F.array_join("lines", "\n"), F.lit(""))
    fields = {"n_lines": n_lines.cast("long"), "n_dropped": n_dropped.cast("long"), "kept_runs": F.col("kept_runs"), "kept_text": F.when(F.col("dropped").isNull(), whole).otherwise(text), "had_text": had_text}
    return joined.select("doc", F.struct(*[c.alias(name) for name, c in fields.items()]).alias("line_dedup"))
