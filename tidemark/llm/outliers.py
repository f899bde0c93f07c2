"""Quality rules by robust multivariate outliers: minimum covariance determinant per language and source, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm.common import drop, save, whole_row, with_missing

#: Share of a group's rows that the determinant is minimised over, and what makes its covariance consistent for four
#: normal variables: 0.75 / P(chi2(6) <= chi2(4) quantile 0.75).
SHARE, CONSISTENT = 0.75, 1.485
#: Concentration steps, and the least rows of a group; smaller sources use their language's estimate.
STEPS, LEAST = 4, 50
#: Squared distance beyond which a document is rejected: a normal vector of four lies beyond it once in 10**13.
CUT = 64.0
#: Least standard deviation of each transformed statistic; a group whose rows all agree isn't a needle.
FLOORS = (0.06, 0.35, 0.55, 0.55)
X = tuple(f"x{i}" for i in range(len(FLOORS)))
#: Bins per unit of statistic and of log distance.
FINE = 64
GROUP = ("g_lang", "g_source")


def _once(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.transform(F.array(value), use)[0]


def _covered(hashes: Column, width: int) -> Column:
    """Positions inside windows of the given width that occur twice or more."""
    size = F.size(hashes)

    def repeated(windows: Column) -> Column:
        def runs(pairs: Column) -> Column:
            next_to = lambda x, i: F.coalesce(F.get(pairs, i)["h"] == x["h"], F.lit(False))
            return F.filter(F.transform(pairs, lambda x, i: F.when(next_to(x, i - 1) | next_to(x, i + 1), x["i"])), lambda x: x.isNotNull())

        def total(at: Column) -> Column:
            steps = F.transform(at, lambda p, i: F.least(F.lit(width), F.coalesce(F.get(at, i + 1) - p, F.lit(width))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a + b)

        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), _once(F.sort_array(_once(pairs, runs)), total)).otherwise(F.lit(0).cast("long"))

    windows = F.transform(F.sequence(F.lit(1), size - (width - 1)), lambda i: F.xxhash64(F.slice(hashes, i, width)))
    return F.when(size > width, _once(windows, repeated)).otherwise(F.lit(0).cast("long"))


def statistics(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, key (a hash of the text), lang, source, the counts of the base rules, base_failed, the transformed statistics, and more columns of docs."""
    kept = docs.select(*more).columns if more else []
    d = with_missing(docs, *more, doc_id="long", text="string", lang="string", source="string").withColumn("text", F.coalesce("text", F.lit("")))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^ \x09-\x0D]"))
    hashes = F.transform(F.filter(F.split("text", r"[ \x09-\x0D]+", -1), lambda x: x != ""), lambda x: F.xxhash64(x))
    words = _once(hashes, lambda h: F.struct(F.size(h).cast("long").alias("n_words"), _covered(h, 8).alias("n_repeat_words")))
    line_counts = _once(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    d = d.select(
        *kept, "doc_id", F.xxhash64("text").alias("key"), "lang", "source",
        F.length(F.translate("text", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        words.alias("w"), line_counts.alias("l"),
    )
    d = d.select(*kept, "doc_id", "key", "lang", "source", "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    n = F.greatest("n_words", F.lit(1))
    share = lambda a, b: F.log1p(100.0 * a / b)
    return d.withColumn("base_failed", failed).select(
        "*",
        F.log((F.col("word_chars") + 1.0) / n).alias("x0"),
        share(F.col("n_symbols"), n).alias("x1"),
        share(F.col("n_dup_lines"), F.greatest("n_lines", F.lit(1))).alias("x2"),
        share(F.col("n_repeat_words"), n).alias("x3"),
    ).drop("n_lines")


def _quantile_bins(binned: DataFrame, keys: tuple[str, ...], share: float) -> DataFrame:
    """The least bin at which a group has the given share of its rows; counts are exact and combine before the shuffle."""
    counts = binned.groupBy(*keys, "bin").agg(F.count("*").alias("c"))
    upto = W.partitionBy(*keys).orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    every = W.partitionBy(*keys)
    run = counts.select(*keys, "bin", F.sum("c").over(upto).alias("upto"), F.sum("c").over(every).alias("n"))
    return run.where(F.col("upto") >= F.ceil(F.col("n") * share)).groupBy(*keys).agg(F.min("bin").alias("bin"), F.max("n").alias("n"))


def _moments(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Mean and covariance per group, with floors on the diagonal, as the inverse of its Cholesky factor and the log determinant."""
    p = len(X)
    m = rows.groupBy(*keys).agg(
        *[F.avg(x).alias(f"m{i}") for i, x in enumerate(X)],
        *[F.covar_pop(X[i], X[j]).alias(f"s{i}{j}") for i in range(p) for j in range(i + 1)],
    )
    for j in range(p):  # Cholesky, column by column
        diagonal = F.col(f"s{j}{j}") + FLOORS[j] ** 2
        for k in range(j):
            diagonal = diagonal - F.col(f"l{j}{k}") * F.col(f"l{j}{k}")
        m = m.withColumn(f"l{j}{j}", F.sqrt(F.greatest(diagonal, F.lit(FLOORS[j] ** 2 / 4))))
        for i in range(j + 1, p):
            v = F.col(f"s{i}{j}")
            for k in range(j):
                v = v - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            m = m.withColumn(f"l{i}{j}", v / F.col(f"l{j}{j}"))
    logdet = sum((F.log(f"l{j}{j}") for j in range(p)), F.lit(0.0))
    return m.select(*keys, *[f"m{i}" for i in range(p)], *[f"l{i}{j}" for i in range(p) for j in range(i + 1)], logdet.alias("logdet"))


def _distance() -> Column:
    """Squared Mahalanobis distance by forward substitution."""
    z: list[Column] = []
    for i, x in enumerate(X):
        v = F.col(x) - F.col(f"m{i}")
        for k in range(i):
            v = v - F.col(f"l{i}{k}") * z[k]
        z.append(v / F.col(f"l{i}{i}"))
    return sum((v * v for v in z), F.lit(0.0))


def _medians(long: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return _quantile_bins(long.withColumn("bin", F.floor(F.col("v") * FINE)), (*keys, "j"), 0.5).select(*keys, "j", ((F.col("bin") + 0.5) / FINE).alias("q"))


def estimates(rows: DataFrame) -> DataFrame:
    """Per group the estimate of the least determinant found: n, means, Cholesky factor.

    Two deterministic starts, medians with median deviations and all rows' mean
    and covariance, each go through concentration steps: the SHARE of rows
    nearest to the estimate gives the next one. The nearest rows are found by
    exact counts per bin of log distance, so no group is sorted or gathered.
    """
    long = rows.select(*GROUP, F.posexplode(F.array(*X)).alias("j", "v"))
    med = save(_medians(long, GROUP), "medians")
    off = long.join(med, [*GROUP, "j"]).withColumn("v", F.abs(F.col("v") - F.col("q")))
    mad = _medians(off, GROUP).withColumnRenamed("q", "mad")
    scale = F.greatest(1.4826 * F.col("mad"), F.element_at(F.array(*[F.lit(f) for f in FLOORS]), F.col("j") + 1))
    wide = med.join(mad, [*GROUP, "j"]).withColumn("scale", scale).groupBy(*GROUP).agg(
        *[F.max(F.when(F.col("j") == i, F.col("q"))).alias(f"m{i}") for i in range(len(X))],
        *[F.max(F.when(F.col("j") == i, F.col("scale"))).alias(f"l{i}{i}") for i in range(len(X))],
    )
    for i in range(len(X)):
        for k in range(i):
            wide = wide.withColumn(f"l{i}{k}", F.lit(0.0))
    robust = wide.withColumn("logdet", F.lit(0.0)).withColumn("start", F.lit(0))
    plain = _moments(rows, GROUP).withColumn("start", F.lit(1))
    now = save(robust.unionByName(plain), "starts")
    for _ in range(STEPS):
        near = rows.join(now, [*GROUP]).withColumn("bin", F.floor(F.log1p(_distance()) * FINE))
        keys = (*GROUP, "start")
        cut = save(_quantile_bins(near.select(*keys, "bin"), keys, SHARE).withColumnRenamed("bin", "cut"), "cuts")
        kept = near.select(*keys, "bin", *X).join(cut, [*keys]).where("bin <= cut")
        now = save(_moments(kept, keys).join(cut.select(*keys, "n"), [*keys]), "steps")
    best = W.partitionBy(*GROUP).orderBy("logdet", "start")
    return now.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r", "start")


def _grouped(statistics: DataFrame) -> DataFrame:
    return statistics.withColumn("g_lang", F.coalesce("lang", F.lit("\x00"))).withColumn("g_source", F.coalesce("source", F.lit("\x00")))


def _known_groups(s: DataFrame) -> DataFrame:
    """Saved estimates of every language and source, and of every language, that has LEAST rows."""
    passed = s.where("not base_failed").select("g_lang", F.explode(F.array("g_source", F.lit("\x00all"))).alias("g_source"), *X)
    return save(estimates(passed).where(F.col("n") >= LEAST), "estimates")


def _judged(s: DataFrame, found: DataFrame) -> DataFrame:
    """s with distance and kept. Estimates are one row a group: each row is judged where it lies."""
    parts = [f"m{i}" for i in range(len(X))] + [f"l{i}{j}" for i in range(len(X)) for j in range(i + 1)]
    own = found.where("g_source <> '\x00all'").select(*GROUP, F.struct(*parts).alias("own"))
    language = found.where("g_source = '\x00all'").select("g_lang", F.struct(*parts).alias("language"))
    judged = s.join(own, [*GROUP], "left").join(language, "g_lang", "left").withColumn("e", F.coalesce("own", "language"))
    judged = judged.select(*s.columns, *[F.col(f"e.{c}").alias(c) for c in parts]).withColumn("distance", _distance() / CONSISTENT)
    return judged.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUT, F.lit(True)))


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, key (a hash of the text), the base counts, base_failed, distance, kept.

    A document is kept if the base rules pass and its squared Mahalanobis
    distance from its group's estimate is at most CUT. Estimates use the rows
    that pass the base rules, of each language and source and of each language
    over all sources; a source with fewer than LEAST rows takes its language's,
    and a language with fewer rejects none (distance null).

    Defined results: null and empty texts have no words and fail the base rules;
    null languages or sources are groups of their own; repeated rows count each;
    other columns are ignored.
    """
    s = _grouped(save(statistics(docs), "statistics"))
    return _judged(s, _known_groups(s)).select(
        "doc_id", "key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", *GROUP, "kept"
    )


def accepted(docs: DataFrame) -> DataFrame:
    """Rows of docs that the quality rules keep, with all their columns, whatever their names.

    Statistics are taken twice, for the estimates and again where a row is judged,
    so texts are neither written nor joined back.
    """
    s = save(statistics(docs), "statistics")
    found = _known_groups(_grouped(s))
    drop(s)
    return _judged(_grouped(statistics(docs, whole_row(docs))), found).where("kept").select("row.*")
