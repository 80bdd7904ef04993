"""Language of a text: known words first, character n-grams for the others.

A word seen in training scores by its log frequency in each language. Another word scores by
the longest of its n-grams (5 down to 1, with the word's borders) that were seen, discounted per step.
The model is learned from a bounded sample of labelled rows, ``PER_LANGUAGE`` documents of each
language in hash order, and holds at most ``WORDS`` words and ``GRAMS`` n-grams of a language, so
it may be broadcast; every document is scored on its whole text.

Defined cases: null text, text without letters and an empty sample give ``und`` with score 0; rows
with a null lang or doc_id teach nothing; ties go to the first language in order; repeated rows are rows;
an empty table gives an empty table; other columns are never inputs of a prediction.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pricelens.llm.tables import written

PER_LANGUAGE, WORDS, GRAMS = 2000, 30_000, 30_000
#: Buckets of document hashes, as a power of two, that the sample is counted in.
SAMPLE_BITS = 12
LONGEST = 5
DISCOUNT = 0.5
#: Words that a long text's score counts for, and the score below which the corpus filter rejects.
EVIDENCE, MIN_SCORE = 30, 0.5
#: Vectors of unknown words that a task remembers.
CACHE = 100_000
WORD = re.compile(r"[^\W\d_]+")


def _top(counts: DataFrame, name: str, most: int) -> pa.Table:
    """(lang, name, n) of the ``most`` most frequent of each language, as Arrow columns: rows as objects would fill the driver."""
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), name))
    return counts.withColumn("rank", rank).where(F.col("rank") <= most).select("lang", name, "n").toArrow()


#: Words or n-grams, and a row of log frequencies per language for each.
Vectors = tuple[pa.Array, np.ndarray]


def _vectors(rows: pa.Table, name: str, langs: list[str], totals: dict[str, int]) -> Vectors:
    coded = pc.dictionary_encode(rows.column(name).combine_chunks())
    at = {x: i for i, x in enumerate(langs)}
    table = np.zeros((len(coded.dictionary), len(langs)))
    table[np.asarray(coded.indices), [at[x] for x in rows.column("lang").to_pylist()]] = np.asarray(rows.column("n"))
    size = np.array([totals[x] for x in langs], float) + len(table)
    return coded.dictionary, np.log((table + 1) / size)


def learn(docs: DataFrame) -> dict:
    """The model from doc_id, text and lang of labelled documents."""
    known = docs.where("lang is not null and text is not null").select("doc_id", "lang")
    # Which hash buckets hold the first documents of a language is counted, so only few rows are ordered.
    known = known.withColumn("h", F.xxhash64("doc_id")).withColumn("bucket", F.shiftright("h", 64 - SAMPLE_BITS))
    counts = written(known.groupBy("lang", "bucket").agg(F.count("*").alias("n")), "hash_counts")
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("bucket")) - F.col("n")
    first = written(counts.withColumn("before", before).where(F.col("before") < PER_LANGUAGE).select("lang", "bucket"), "first")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    ids = known.join(first, ["lang", "bucket"], "left_semi").withColumn("rank", rank).where(F.col("rank") <= PER_LANGUAGE)
    ids = written(ids.select("doc_id").distinct(), "sample")
    sample = docs.where("lang is not null and text is not null").join(ids, "doc_id", "left_semi")
    words = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    words = written(words.groupBy("lang", "word").agg(F.count("*").alias("n")), "words")
    langs = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    totals = {r["lang"]: r["n"] for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    padded = words.select("lang", "n", F.concat(F.lit(" "), "word", F.lit(" ")).alias("w"))
    grams = []
    for size in range(1, LONGEST + 1):
        each = F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - size + 1), lambda i: F.substring(F.col("w"), i, F.lit(size))))
        grams.append(padded.where(F.length("w") >= size).select("lang", "n", each.alias("gram")))
    table = grams[0]
    for g in grams[1:]:
        table = table.unionByName(g)
    table = written(table.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    sums = {(r["lang"], r["size"]): r["n"] for r in table.groupBy("lang", F.length("gram").alias("size")).agg(F.sum("n").alias("n")).collect()}
    by_size = []
    top = _top(table, "gram", GRAMS)
    for size in range(1, LONGEST + 1):
        rows = top.filter(pc.equal(pc.utf8_length(top.column("gram")), size))
        by_size.append(_vectors(rows, "gram", langs, {x: sums.get((x, size), 0) for x in langs}))
    return {"langs": langs, "words": _vectors(_top(words, "word", WORDS), "word", langs, totals), "grams": by_size}


def _indexed(vectors: Vectors) -> tuple[dict[str, int], np.ndarray]:
    return {x: i for i, x in enumerate(vectors[0].to_pylist())}, vectors[1]


def _backoff(word: str, grams: list[tuple[dict[str, int], np.ndarray]], n: int) -> np.ndarray:
    padded = f" {word} "
    for step, size in enumerate(range(min(LONGEST, len(padded)), 0, -1)):
        index, table = grams[size - 1]
        hits = [index[g] for i in range(len(padded) - size + 1) if (g := padded[i : i + size]) in index]
        if hits:
            return DISCOUNT**step * table[hits].mean(axis=0)
    return np.zeros(n)


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = model.value["langs"]
        index, table = _indexed(model.value["words"])
        grams = [_indexed(g) for g in model.value["grams"]]
        cache: dict[str, np.ndarray] = {}
        for batch in batches:
            column = batch.column("text") if "text" in batch.schema.names else batch.column("_row").field("text")
            predicted, scores = [], []
            for i in range(batch.num_rows):
                words = Counter(WORD.findall((column[i].as_py() or "").lower()))
                if not words or not langs:
                    predicted.append("und")
                    scores.append(0.0)
                    continue
                at, times, total, n = [], [], np.zeros(len(langs)), 0
                for word, c in words.items():
                    n += c
                    if (k := index.get(word)) is not None:
                        at.append(k)
                        times.append(c)
                        continue
                    if (v := cache.get(word)) is None:
                        if len(cache) >= CACHE:
                            cache.clear()
                        v = cache[word] = _backoff(word, grams, len(langs))
                    total += c * v
                if at:
                    total += np.array(times, float) @ table[at]
                mean = total / n * min(n, EVIDENCE)
                odds = np.exp(mean - mean.max())
                best = int(np.argmax(odds))
                predicted.append(langs[best])
                scores.append(float(odds[best] / odds.sum()))
            keep = batch.schema.names
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in keep), pa.array(predicted, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"]
            )

    return run


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """docs with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_predict(shared), StructType([*docs.schema.fields]).add("lang_pred", "string").add("score", "double"))


def held_out(docs: DataFrame):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def identify(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score; learned from those not held out."""
    model = learn(docs.where(~held_out(docs)))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out(docs).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The documents whose language is one of those learned, with at least ``min_score``. Repeated rows and ids
    are rows like others, a very long text is scored whole, and columns of any name come back unchanged."""
    carried = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    learned = learn(docs.select("doc_id", "text", "lang").where(~held_out(docs)))
    return predict(carried, learned).where(f"lang_pred <> 'und' and score >= {min_score}").select("_row.*")
