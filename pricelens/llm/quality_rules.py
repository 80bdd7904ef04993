"""Quality rules: fixed base rules, then robust multivariate outliers.

The minimum covariance determinant of four log-transformed statistics is estimated per language
and source: from two starts (all rows; the rows around the medians) concentration steps keep the
three quarters of the rows with the least distance and estimate mean and covariance again, until
the group's determinant stops falling, and the start that ends with the smaller determinant counts. A document fails when its squared Mahalanobis
distance is over ``CUTOFF``. The quarters are cut on counted distance classes, so no group is
sorted or gathered: a step is two aggregations with partial sums, however large a group is.
``FLOORS`` are standard deviations that each statistic has at least: most documents have no
symbol and no repeat at all, which would make any of them an outlier. They are no larger than what
the least count makes: the mean word length of 10 words is known to about 0.13, one symbol in
1,250 characters is 0.08, one repeated line in 250 words 0.34, and the shortest repeat, six words
in 250, 1.23.

Defined cases: null text is empty; documents without words have statistics 0 and fail the base
rules; null languages and sources count as ''; sources with fewer than ``LEAST_ROWS`` rows are
estimated together per language, and if those are too few as well, only the base rules hold;
repeated rows are rows; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelens.llm.tables import written

FEATURES = ("f1", "f2", "f3", "f4")
FLOORS = (0.13, 0.08, 0.34, 0.6)
KEEP_SHARE, LEAST_ROWS = 0.75, 40
#: Of the log determinant, by which a further step has to lower it.
LEAST_FALL = 1e-6
#: Of the covariance of the three quarters of normal rows nearest to their mean, in 4 dimensions.
CONSISTENCY = 1.485
#: Chi-square with 4 degrees of freedom at 0.9999.
CUTOFF = 23.51
#: Distance classes to a factor e.
CLASSES = 32


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeated_words(words: Column) -> Column:
    """Words in 5-word windows found twice or more."""

    def of(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(w) - 4), lambda i: F.xxhash64(*[F.element_at(w, i + j) for j in range(5)]))
        return let(windows, lambda k: F.when(F.size(F.array_distinct(k)) < F.size(k), covered(k)).otherwise(F.lit(0)))

    def covered(k: Column) -> Column:
        ordered = F.sort_array(F.transform(k, lambda x, i: F.struct(x.alias("k"), i.alias("i"))))
        places = let(
            ordered,
            lambda s: F.sort_array(F.transform(F.filter(s, lambda x, i: (F.get(s, i - 1)["k"] == x["k"]) | (F.get(s, i + 1)["k"] == x["k"])), lambda x: x["i"])),
        )
        return let(places, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(5), F.coalesce(F.get(p, i + 1) - x, F.lit(5)))), F.lit(0), lambda a, x: a + x))

    return F.when(F.size(words) >= 5, let(words, of)).otherwise(F.lit(0)).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base statistics."""
    gap = r"[\x20\x09-\x0D]+"
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), text.alias("t"), F.array_remove(F.split(text, gap), "").alias("w"), lines.alias("l"))
    return words.select(
        "doc_id", "lang", "source",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("t", gap, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("w")).alias("n_repeat_words"),
    )


def _distance(x: DataFrame) -> Column:
    """Squared Mahalanobis distance from the columns f*, m* and the Cholesky factor l**."""
    z: list[Column] = []
    for i in range(4):
        left = F.col(FEATURES[i]) - F.col(f"m{i}")
        for j in range(i):
            left = left - F.col(f"l{i}{j}") * z[j]
        z.append(left / F.col(f"l{i}{i}"))
    return sum((v * v for v in z[1:]), z[0] * z[0])


def _estimate(rows: DataFrame) -> DataFrame:
    """Per group: means m*, Cholesky factor l** of the floored covariance and log determinant."""
    sums = rows.groupBy("lang", "group").agg(
        F.count("*").alias("rows"),
        *[F.avg(f).alias(f"m{i}") for i, f in enumerate(FEATURES)],
        *[F.covar_pop(FEATURES[i], FEATURES[j]).alias(f"c{i}{j}") for i in range(4) for j in range(i + 1)],
    )
    for i in range(4):
        for j in range(i + 1):
            value = F.col(f"c{i}{j}") * CONSISTENCY + (F.lit(FLOORS[i] ** 2) if i == j else F.lit(0.0))
            for k in range(j):
                value = value - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            sums = sums.withColumn(f"l{i}{j}", F.sqrt(value) if i == j else value / F.col(f"l{j}{j}"))
    det = sum((F.log(F.col(f"l{i}{i}")) for i in range(1, 4)), F.log("l00"))
    return sums.select("lang", "group", *[f"m{i}" for i in range(4)], *[f"l{i}{j}" for i in range(4) for j in range(i + 1)], det.alias("det"))


def _concentrate(rows: DataFrame, distance: Column) -> DataFrame:
    """The estimate from the share of each group's rows with the least distance."""
    graded = rows.withColumn("grade", F.floor(F.log(distance + 1e-9) * CLASSES))
    counts = graded.groupBy("lang", "group", "grade").agg(F.count("*").alias("n"))
    group = Window.partitionBy("lang", "group")
    upto = counts.withColumns({"upto": F.sum("n").over(group.orderBy("grade")), "all": F.sum("n").over(group)})
    cut = upto.where(F.col("upto") >= F.ceil(F.col("all") * KEEP_SHARE)).groupBy("lang", "group").agg(F.min("grade").alias("cut"))
    return written(_estimate(graded.join(cut, ["lang", "group"]).where("grade <= cut")), "estimate")


def _settled(rows: DataFrame, start: DataFrame) -> DataFrame:
    """The estimates after as many concentration steps as lower each group's determinant."""
    values = [c for c in start.columns if c not in ("lang", "group")]
    falls = F.col("next.det") < F.col("det") - LEAST_FALL
    done: DataFrame | None = None
    while not start.isEmpty():
        joined = rows.join(start, ["lang", "group"])
        after = _concentrate(joined.select(*rows.columns, _distance(joined).alias("d")), F.col("d"))
        step = written(start.join(after.select("lang", "group", F.struct(*values).alias("next")), ["lang", "group"]), "step")
        ended = step.where(~falls).drop("next")
        done = ended if done is None else done.unionByName(ended)
        start = step.where(falls).select("lang", "group", "next.*")
    return start if done is None else done


def mcd(rows: DataFrame) -> DataFrame:
    """Per (lang, group) of rows with f1-f4: the estimate of the smaller determinant."""
    ends = []
    medians = rows.groupBy("lang", "group").agg(*[F.percentile_approx(f, 0.5, 10_000).alias(f"q{i}") for i, f in enumerate(FEATURES)])
    apart = sum((((F.col(FEATURES[i]) - F.col(f"q{i}")) / FLOORS[i]) ** 2 for i in range(1, 4)), ((F.col("f1") - F.col("q0")) / FLOORS[0]) ** 2)
    for start in (written(_estimate(rows), "estimate"), _concentrate(rows.join(medians, ["lang", "group"]), apart)):
        ends.append(_settled(rows, start))
    values = [c for c in ends[0].columns if c not in ("lang", "group")]
    both = ends[0].unionByName(ends[1]).groupBy("lang", "group").agg(F.min_by(F.struct(*values), "det").alias("e"))
    return written(both.select("lang", "group", "e.*"), "mcd")


def judge(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, the base statistics, base_failed, kept and the squared distance."""
    base = statistics(docs)
    n = F.greatest(F.col("n_words"), F.lit(1))
    base = base.withColumns({
        "f1": F.log1p(F.col("word_chars") / n),
        "f2": F.log1p(100 * F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        "f3": F.log1p(100 * F.col("n_dup_lines") / n),
        "f4": F.log1p(100 * F.col("n_repeat_words") / n),
        "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
    })
    base = written(base, "statistics")
    sizes = base.where("n_words > 0").groupBy("lang", "source").agg(F.count("*").alias("n"))
    named = sizes.select("lang", "source", F.when(F.col("n") >= LEAST_ROWS, F.concat(F.lit("="), "source")).otherwise(F.lit("*")).alias("group"))
    base = base.join(written(named, "groups"), ["lang", "source"], "left")
    rows = base.where("n_words > 0").select("lang", "group", *FEATURES)
    big = rows.groupBy("lang", "group").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_ROWS).drop("n")
    found = mcd(written(rows.join(big, ["lang", "group"], "left_semi"), "rows"))
    out = base.join(found, ["lang", "group"], "left")
    out = out.withColumn("distance", _distance(out))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(True))).alias("kept"), "distance",
    )
