"""Importance resampling of documents towards a target text: hashed n-gram weights and a Gumbel draw.

A 256-byte table lower-cases A-Z and blanks every byte between words, ``bytes.split`` yields the words,
and the crc32 of a run of words is carried on as the seed of the longer run, so no n-gram is ever put
together. Counters reduce the buckets inside a task; one row per bucket and task is shuffled. A bucket's
gain is the log ratio of its smoothed shares in the target and in the documents, a document's weight the mean
gain of its features, and its score the weight with Gumbel noise from its id: the highest scores are a
draw without replacement in proportion to the weights.

Ranks come from counted scores: how many rows score higher is known from the counts, and only rows
of equal score are ordered among themselves.

Texts are cut into pieces of ``PIECE`` bytes at a blank, with the last words carried over, so a very long text
needs no more memory than its bytes; it is counted whole. Defined cases: null and empty texts have no words, weight 0 and no
rank; a null doc_id draws its noise as the id '' would; repeated rows are rows, each with a rank of its own; equal scores go by
doc_id (null first), then by the smaller weight, then by fewer features; empty documents give an empty table; an
empty target makes every gain the smoothed one; other columns are not read, except by ``draw``, which carries them in
one struct, so no name can clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pricelens.llm.tables import written

LONGEST, BUCKETS = 2, 10_000
LEAST_WORDS, PERCENT, SEED = 20, 25, 7
#: Scores that share one coarse step of the ranking.
STEP = 256
PIECE = 1 << 20


def _blanked(c: int) -> int:
    if 65 <= c <= 90:
        return c + 32
    return c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32


TABLE = bytes(_blanked(c) for c in range(256))


def runs(text: bytes, longest: int = LONGEST, piece: int = PIECE) -> Iterator[tuple[int, list[int]]]:
    """Per piece of a text: its number of words, and the crc32 of each run of 1 to ``longest`` words that ends in it."""
    carried: list[bytes] = []
    at = 0
    while at < len(text):
        cut = at + piece
        # Cut at a blank byte, so that no word is torn.
        while cut < len(text) and TABLE[text[cut]] != 32:
            cut += 1
        fresh = text[at:cut].translate(TABLE).split()
        words = carried + fresh
        seeds = [crc32(w) for w in words]
        found = seeds[len(carried) :]
        for size in range(2, longest + 1):
            seeds = [crc32(w, crc32(b" ", seed)) for seed, w in zip(seeds, words[size - 1 :])]
            found += seeds[max(0, len(carried) - size + 1) :]
        yield len(fresh), found
        carried = words[max(0, len(words) - longest + 1) :] if longest > 1 else []
        at = cut


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    for value in batch.column("text").cast(pa.binary()):
        yield value.as_py() or b""


def _bucket_counts(longest: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[int] = Counter()
        for batch in batches:
            for text in _texts(batch):
                for _, found in runs(text, longest):
                    counts.update([c % buckets for c in found])
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["bucket", "n"])

    return run


def _weights(gains: list[int], longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(gains)
        for batch in batches:
            columns: tuple[list[int], list[int], list[int]] = ([], [], [])
            for text in _texts(batch):
                words = features = total = 0
                for n, found in runs(text, longest):
                    words += n
                    features += len(found)
                    total += sum([gains[c % size] for c in found])
                for column, value in zip(columns, (words, features, total // features if features else 0)):
                    column.append(value)
            rest = [n for n in batch.schema.names if n != "text"]
            arrays = [*(batch.column(n) for n in rest), *(pa.array(c, pa.int64()) for c in columns)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*rest, "n_words", "n_features", "weight"])

    return run


def bucket_counts(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of the features of a column ``text``."""
    counted = texts.select("text").mapInArrow(_bucket_counts(longest, buckets), "bucket int, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> list[int]:
    """A whole number per bucket: 1000 times the log ratio of its smoothed shares. ``buckets`` numbers reach the driver."""
    mine = bucket_counts(docs, longest, buckets).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    wanted = bucket_counts(target, longest, buckets).select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t"))
    both = written(mine.union(wanted).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "buckets")
    sums = both.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("all_s"), F.coalesce(F.sum("t"), F.lit(0)).alias("all_t")).first()
    filled = docs.sparkSession.range(buckets).join(both, F.col("id") == F.col("bucket"), "left")
    s, t = (F.coalesce(n, F.lit(0)).cast("double") for n in ("s", "t"))
    ratio = (t + 1) * F.lit(float(sums["all_s"] + buckets)) / ((s + 1) * F.lit(float(sums["all_t"] + buckets)))
    rows = filled.select("id", F.floor(1000 * F.log(ratio)).alias("gain")).collect()
    return [r["gain"] for r in sorted(rows)]


def noise(doc_id: str, seed: int = SEED) -> Column:
    """1000 times a Gumbel number fixed by the id, floored."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def weighed(docs: DataFrame, target: DataFrame, keep: list[str], longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """The columns ``keep`` of docs (doc_id, text and others) with n_words, n_features, weight and score."""
    narrow = docs.select(*keep, "text")
    schema = StructType([f for f in narrow.schema.fields if f.name != "text"])
    for name in ("n_words", "n_features", "weight"):
        schema = schema.add(name, "long")
    out = narrow.mapInArrow(_weights(gains(docs, target, longest, buckets), longest), schema)
    return out.withColumn("score", F.col("weight") + noise("doc_id", seed))


def ranked(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``rows`` with ``rank``: 1, 2, 3 ... down the scores of the drawn ``percent`` of the rows with enough words, else null."""
    able = F.col("n_words") >= least_words
    counts = written(rows.where(able).groupBy("score").agg(F.count("*").alias("n")), "scores")
    coarse = F.floor(F.col("score") / STEP)
    # Few rows: the range of scores over STEP, whatever the number of documents.
    steps = counts.groupBy(coarse.alias("step")).agg(F.sum("n").alias("n"))
    higher = F.sum("n").over(Window.orderBy(F.desc("step"))) - F.col("n")
    steps = steps.select("step", higher.alias("higher"))
    inside = F.sum("n").over(Window.partitionBy("step").orderBy(F.desc("score"))) - F.col("n")
    above = counts.withColumn("step", coarse).withColumn("inside", inside).join(steps, "step")
    above = written(above.select(F.col("score").alias("at"), (F.col("higher") + F.col("inside")).alias("above")), "above")
    number = counts.agg(F.sum("n")).first()[0] or 0
    most = percent * number // 100
    drawn = above.where(F.col("above") < most)
    placed = rows.join(drawn, able & (F.col("score") == F.col("at")), "left")
    order = Window.partitionBy("score", F.col("above").isNull(), F.when(F.col("above").isNull(), F.xxhash64("doc_id"))).orderBy("doc_id", "weight", "n_features")
    place = (F.col("above") + F.row_number().over(order)).cast("long")
    return placed.withColumn("rank", F.when(place <= most, place)).drop("at", "above")


def resample(docs: DataFrame, target: DataFrame) -> DataFrame:
    """Per document: doc_id, n_features, weight, score, rank."""
    rows = written(weighed(docs, target, ["doc_id"]), "weighed")
    return ranked(rows).select("doc_id", "n_features", "weight", "score", "rank")


def draw(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """The drawn documents, all their columns as they are."""
    carried = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    rows = written(weighed(carried, target, ["doc_id", "_row"]), "weighed")
    return ranked(rows, percent, least_words).where("rank is not null").select("_row.*")


#: crc32 byte by byte: the table of its 256 steps, then a fold over the bytes of each distinct feature.
ORACLE = r"""
WITH RECURSIVE bits(k, i, v) AS (
  SELECT 0, CAST(range AS BIGINT), CAST(range AS BIGINT) FROM range(256)
  UNION ALL SELECT k + 1, i, CASE WHEN v % 2 = 1 THEN xor(3988292384, v // 2) ELSE v // 2 END FROM bits WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
f AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM d),
q AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM b),
u AS (SELECT DISTINCT g FROM (SELECT g FROM f UNION ALL SELECT g FROM q)),
h AS (SELECT g, hex(encode(g)) AS x FROM u),
y AS (SELECT g, list_transform(range(1, length(x), 2), lambda i: CAST(instr('0123456789ABCDEF', x[i]) * 16 + instr('0123456789ABCDEF', x[i + 1]) - 17 AS BIGINT)) AS bytes FROM h),
c AS (SELECT g, xor(list_reduce(list_prepend(4294967295, bytes), lambda s, o: xor(s // 256, t[(xor(s, o) % 256) + 1])), 4294967295) % 10000 AS bucket FROM y, tab),
s AS (SELECT bucket, count(*) AS s FROM f JOIN c USING (g) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM q JOIN c USING (g) GROUP BY bucket),
n AS (SELECT (SELECT count(*) FROM f) AS ss, (SELECT count(*) FROM q) AS tt),
v AS (SELECT range AS bucket, CAST(floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * (ss + 10000) / ((coalesce(s, 0) + 1) * CAST(tt + 10000 AS DOUBLE)))) AS BIGINT) AS gain
      FROM range(10000) LEFT JOIN s ON s.bucket = range LEFT JOIN t ON t.bucket = range, n),
m AS (SELECT doc_id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS total FROM f JOIN c USING (g) JOIN v USING (bucket) GROUP BY doc_id),
r AS (SELECT d.doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features,
             coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0) AS weight,
             CAST('0x' || substr(sha256('7:' || d.doc_id), 1, 8) AS BIGINT) AS hh
      FROM d LEFT JOIN m USING (doc_id)),
e AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((hh + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM r),
k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM e WHERE words >= 20)
SELECT e.doc_id, e.n_features, CAST(e.weight AS BIGINT) AS weight, CAST(e.score AS BIGINT) AS score,
       CASE WHEN rank <= (SELECT count(*) FROM k) * 25 // 100 THEN rank END AS rank
FROM e LEFT JOIN k USING (doc_id)
"""
