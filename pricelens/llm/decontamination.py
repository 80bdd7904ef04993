"""Benchmark passages in documents: a prefix-filtered join of word shingles.

The documents' shingles are matched with the benchmark's once; that gives every benchmark shingle
its frequency over all documents. A window of an item can only occur where all its shingles do, so
its rarest one is its prefix: only places that match it become candidates, at the one start its
position in the window allows and with room for the whole window. A candidate is verified by
the shingles that tile the window, compared word by word.

Defined cases: null text has no words; an item without words has no window, one shorter than a
window is one window; an item with a null id counts as the item ''; documents without words have
no hit; equal rows get equal results; empty tables give an empty table or no hits; other columns
are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens.llm.tables import same_row, with_row_key, written

WINDOW, SHINGLE = 10, 5
#: What stands between item words once A-Z are lower-cased, and before.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def item_words(text: str) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lower, BETWEEN), "")


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """(item_id, content, size): the windows of each item; content is its words joined by a space."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), item_words("text").alias("w"))
    items = items.where(F.size("w") > 0).withColumn("size", F.least(F.size("w"), F.lit(window)))
    starts = items.select("*", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)).alias("k"))
    return starts.select("item_id", F.concat_ws(" ", F.slice("w", F.col("k"), F.col("size"))).alias("content"), "size").distinct()


def _window_shingles(windows: DataFrame, shingle: int) -> DataFrame:
    """(content, size, length, offset, shingle): all shingles of each window; length is their size."""
    w = windows.select("content", "size").distinct().withColumn("w", F.split("content", " "))
    w = w.withColumn("length", F.least(F.col("size"), F.lit(shingle)))
    w = w.select("*", F.explode(F.sequence(F.lit(0), F.col("size") - F.col("length"))).alias("offset"))
    return w.select("content", "size", "length", "offset", F.concat_ws(" ", F.slice("w", F.col("offset") + 1, F.col("length"))).alias("shingle"))


def _matches(docs: DataFrame, shingles: DataFrame, most: int) -> DataFrame:
    """(doc_id, row_hash, place, shingle): where shingles of the windows stand in the documents."""
    out = None
    for n in range(1, most + 1):
        mine = shingles.where(F.col("length") == n)
        if mine.isEmpty():
            continue
        names = [f"w{i}" for i in range(n)]
        keys = written(mine.select(F.xxhash64(*[F.element_at(F.split("shingle", " "), i + 1) for i in range(n)]).alias("key")).distinct(), "keys")
        words = docs.select("doc_id", "row_hash", item_words("text").alias("w"))
        shifted = [F.slice("w", i + 1, F.greatest(F.size("w") - i, F.lit(0))) for i in range(n)]
        rows = words.select("doc_id", "row_hash", F.posexplode(F.arrays_zip(*[c.alias(x) for c, x in zip(shifted, names)])).alias("place", "z"))
        rows = rows.select("doc_id", "row_hash", "place", "z.*")
        rows = rows.where(F.col(names[-1]).isNotNull()).withColumn("key", F.xxhash64(*names))
        found = rows.join(keys, "key", "left_semi").select("doc_id", "row_hash", "place", F.concat_ws(" ", *names).alias("shingle"))
        found = found.join(mine.select("shingle").distinct(), "shingle", "left_semi")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.select("doc_id", "row_hash", F.lit(0).alias("place"), F.lit("").alias("shingle")).where("false")


def occurrences(docs: DataFrame, windows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, row_hash, start, size, content): each place where a window stands in a document."""
    shingles = written(_window_shingles(windows, shingle), "shingles")
    matches = written(_matches(docs, shingles, shingle).distinct(), "matches")
    often = matches.groupBy("shingle").agg(F.count("*").alias("n"))
    ranked = shingles.join(often, "shingle")  # a window with a shingle that no document has cannot occur
    whole = shingles.groupBy("content").count()
    prefix = ranked.groupBy("content", "size", "length").agg(F.min(F.struct("n", "offset", "shingle")).alias("rare"), F.count("*").alias("have"))
    prefix = prefix.join(whole, "content").where("have = count").select("content", "size", "length", "rare.offset", "rare.shingle")
    candidates = matches.join(prefix, "shingle").select("doc_id", "row_hash", (F.col("place") - F.col("offset")).alias("start"), "size", "length", "content")
    candidates = candidates.where("start >= 0")
    # Shingles that tile the window: at 0, length, 2 * length, ... and at the end.
    last = F.col("size") - F.col("length")
    tiles = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.col("length")), F.array(last)))
    needed = candidates.select("*", F.size(tiles).alias("tiles"), F.explode(tiles).alias("offset")).join(
        shingles.select("content", "offset", "shingle"), ["content", "offset"]
    )
    needed = needed.withColumn("place", F.col("start") + F.col("offset"))
    there = needed.join(
        matches.withColumnRenamed("doc_id", "there_id"),
        needed["doc_id"].eqNullSafe(F.col("there_id"))
        & (needed["row_hash"] == matches["row_hash"])
        & (needed["place"] == matches["place"])
        & (needed["shingle"] == matches["shingle"]),
        "left_semi",
    )
    return there.groupBy("doc_id", "row_hash", "start", "size", "content", "tiles").count().where("count = tiles").drop("tiles", "count")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    docs = with_row_key(docs.select("doc_id", "text"))
    windows = written(item_windows(benchmark, window), "windows")
    found = written(occurrences(docs, windows), "occurrences")
    covered = found.select("doc_id", "row_hash", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("place")).distinct()
    hit = covered.groupBy("doc_id", "row_hash").agg(F.count("*").alias("n_hit"))
    items = found.join(windows.select("content", "item_id"), "content").select("doc_id", "row_hash", "item_id").distinct()
    items = items.groupBy("doc_id", "row_hash").agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    both = written(hit.join(items.withColumnRenamed("doc_id", "i"), F.col("doc_id").eqNullSafe(F.col("i")) & (hit["row_hash"] == items["row_hash"])).select("doc_id", hit["row_hash"], "n_hit", "items"), "hits")
    parts = F.split(F.coalesce("text", F.lit("")), BETWEEN_ANY_CASE)
    sizes = docs.select("doc_id", "row_hash", F.size(F.array_remove(parts, "")).cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    return sizes.join(both, same_row(sizes, both), "left").select(
        sizes["doc_id"],
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.coalesce("items", none)), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that hold no window of a benchmark item, as they are. Repeated rows and ids are judged by their own
    text, a very long one as a whole; columns of any name come back unchanged."""
    keyed = with_row_key(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")))
    found = written(occurrences(keyed.select("doc_id", "row_hash", "text"), written(item_windows(benchmark, window), "windows")), "occurrences")
    hit = found.select("doc_id", "row_hash").distinct()
    return keyed.join(hit, same_row(keyed, hit), "left_anti").select("_row.*")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, least(10, len(w)) AS l, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS g
      FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) t(k) WHERE len(w) > 0),
s AS (SELECT DISTINCT l FROM v),
x AS (SELECT doc_id, l, k, array_to_string(w[k : k + l - 1], ' ') AS g FROM d, s, unnest(range(1, len(w) - l + 2)) t(k) WHERE len(w) >= l),
o AS (SELECT x.doc_id, x.k, x.l, v.item_id FROM x JOIN v ON x.l = v.l AND x.g = v.g),
h AS (SELECT doc_id, count(DISTINCT k + j) AS n_hit FROM o, unnest(range(0, l)) t(j) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
      FROM (SELECT DISTINCT doc_id, item_id FROM o) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""
