"""Quality rules: base counts, then robust multivariate outliers, with DataFrame and SQL functions only.

Base counts come from whole texts.  Documents that pass the base rules get a vector of transformed statistics (see
``VECTOR``).  For each language and source the minimum-covariance-determinant estimate of location and scatter is
found by concentration steps from four deterministic starts: coordinate medians with absolute deviations; mean with covariance;
covariance of the hyperbolic tangents of the standardised values; covariance of their directions.  A step keeps the share
``SHARE`` of the group nearest to the estimate and estimates again.  After ``TRIALS`` steps from all starts the one with the
smallest determinant goes on, until no group's determinant moves by more than ``SETTLED`` (in its logarithm) or ``MOST_STEPS``
are done; one reweighting step follows.  A document is rejected when
its squared Mahalanobis distance passes ``CUTOFF``, the chi-square quantile that a normal document passes with
probability ``TAIL``.  Text statistics have heavier tails than the normal, so the probability is far out.

Groups under ``LEAST`` documents use the estimate from all documents of their language, and a language under ``LEAST`` that
from the whole table; if that is also smaller, nothing more is rejected.  ``FLOORS`` (a standard deviation for each statistic, below which spread
counts as noise) keep the scatter regular where most documents share a value.

Work grows with the rows: a step reads narrow rows once and is one hash aggregate, by bins of the distance, of counts and sums, so
a hot group is summed on the map side and never gathered; the bins up to the share add up to the next estimate.  Medians come from histograms too (``PER_UNIT`` bins), so
no verdict depends on the partitioning.  Estimates are a row a group and start; they are broadcast after a count
(``MOST_BROADCAST``), and joined by an exchange, salted on the rows' side, beyond it.

Edge cases: a null, empty or blank text has no words and fails the base rule; null language or source is a group of
its own, and so is a table without these columns; repeated rows and ids count and are judged one by one; an empty table
gives no rows; other columns are not read; the words of a text are an array of one row, so a text needs memory of some ten
times its size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, saved

SHARE = 0.75
TRIALS = 2
MOST_STEPS = 20
SETTLED = 1e-6
LEAST = 60
TAIL = 3e-12
PER_UNIT = 1024
MOST_BROADCAST = 20_000
SALTS = 16
ROWS_A_TASK = 500_000
GROUPS_A_TASK = 2_000
BINS_PER_OCTAVE = 64
VECTOR = ("ln(1 + n_words)", "ln(word_chars / n_words)", "ln(1 + 20 * n_symbols / n_words)", "sqrt((n_repeat_words + n_dup_lines) / n_words)")
FLOORS = (0.5, 0.1, 0.25, 0.08)
P = len(VECTOR)
X = [f"x{i}" for i in range(P)]
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, whatever number of times the body uses it."""
    return F.transform(F.array(value), body)[0]


def group_column(docs: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`").cast("string") if name in docs.columns else F.lit(None).cast("string")


def row_key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """A hash of all that a verdict depends on."""
    return F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string"), group_column(docs, "lang"), group_column(docs, "source"))


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """doc_id, row (see ``row_key``), the kept columns (null where the table lacks them), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    own = [group_column(docs, c).alias(c) for c in keep]
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), row_key(docs, id_col, text_col).alias("row"), *own, F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    worded = texts.withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+", -1), ""))
    hashed = worded.select(
        "doc_id", "row", *keep,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n", -1), lambda l: l.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.when(F.size("words") >= 9, F.transform(F.sequence(F.lit(1), F.size("words") - 7), lambda i: F.xxhash64(F.slice("words", i, 8)))).alias("windows"),
    )

    def covered(windows: Column) -> Column:
        """Words in windows whose hash isn't alone: sort (hash, place), compare neighbours, add up the runs."""
        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        def twice(s: Column) -> Column:
            last = F.size(s) - 1
            hit = lambda k: F.when((k > 0) & (s[F.greatest(k - 1, F.lit(0))].h == s[k].h) | (k < last) & (s[F.least(k + 1, last)].h == s[k].h), s[k].i)
            return F.sort_array(F.array_compact(F.transform(F.sequence(F.lit(0), last), hit)))
        return F.aggregate(
            let(pairs, twice), F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
            lambda a, i: F.struct((i + 8).alias("end"), (a.n + i + 8 - F.greatest(i, a.end)).alias("n")), lambda a: a.n,
        )

    counted = hashed.select(
        "doc_id", "row", *keep, "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("windows")) < F.size("windows"), covered(F.col("windows"))).otherwise(0).cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def chi2_tail(x: float, dof: int) -> float:
    """Probability beyond x, for an even number of degrees of freedom."""
    return math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dof // 2))


def chi2_cut(tail: float, dof: int) -> float:
    """The value that is passed with the probability ``tail``."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_tail(mid, dof) > tail else (low, mid)
    return low


CUTOFF = chi2_cut(TAIL, P)


def consistency(share: float) -> float:
    """Factor that makes the scatter of the nearest share of a normal sample an estimate of the whole's."""
    return share / (1 - chi2_tail(chi2_cut(1 - share, P), P + 2))


@dataclass(frozen=True)
class Sizes:
    """How the estimates are joined and how many tasks their small tables take (Spark's own count may be far above)."""

    few: bool
    tasks: int


def _sums() -> list[Column]:
    return [F.sum(x).alias(f"e{i}") for i, x in enumerate(X)] + [F.sum(F.col(X[i]) * F.col(X[j])).alias(f"q{i}{j}") for i, j in PAIRS]


def _estimated(sums: DataFrame, factor: float) -> DataFrame:
    """sums: g, start, n, e<i>, q<i><j>.  Location and scatter of each (g, start), with floors."""
    mean = [F.col(f"e{i}") / F.col("n") for i in range(P)]
    scatter = [(factor * (F.col(f"q{i}{j}") / F.col("n") - mean[i] * mean[j]) + (FLOORS[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}") for i, j in PAIRS]
    return _factored(sums.select("g", "start", *[m.alias(f"m{i}") for i, m in enumerate(mean)], *scatter))


def _moments(rows: DataFrame, factor: float, sizes: Sizes) -> DataFrame:
    return _estimated(rows.groupBy("g", "start").agg(F.count("*").alias("n"), *_sums()).coalesce(sizes.tasks), factor)


def _factored(est: DataFrame) -> DataFrame:
    """Add the Cholesky factor l<i><j> and the log determinant, column by column."""
    for j in range(P):
        rest = F.col(f"c{j}{j}")
        for k in range(j):
            rest = rest - F.col(f"l{j}{k}") * F.col(f"l{j}{k}")
        est = est.withColumn(f"l{j}{j}", F.sqrt(F.greatest(rest, F.lit(FLOORS[j] ** 2 / 4))))
        for i in range(j + 1, P):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            est = est.withColumn(f"l{i}{j}", rest / F.col(f"l{j}{j}"))
    det = F.lit(0.0)
    for j in range(P):
        det = det + F.log(f"l{j}{j}")
    return est.withColumn("logdet", det).select("g", "start", "logdet", *[f"m{i}" for i in range(P)], *[f"l{i}{j}" for i, j in PAIRS])


def _distance() -> Column:
    """Squared Mahalanobis distance of x from m by forward substitution in l."""
    solved, total = [], F.lit(0.0)
    for i in range(P):
        rest = F.col(X[i]) - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * solved[j]
        solved.append(rest / F.col(f"l{i}{i}"))
        total = total + solved[i] * solved[i]
    return total


def _with(rows: DataFrame, est: DataFrame, sizes: Sizes) -> DataFrame:
    """rows joined with the estimates of their g: broadcast where they are few, else dealt by g and a salt."""
    if sizes.few:
        return rows.join(F.broadcast(est), "g")
    salted = est.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(*X), F.lit(SALTS)).cast("int")).join(salted, ["g", "salt"]).drop("salt")


def _medians(rows: DataFrame, values: list[Column], name: str, sizes: Sizes) -> DataFrame:
    """g and the median of each value, to a bin's width: <name>0.."""
    each = rows.select("g", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.floor(v * PER_UNIT).alias("bin")) for i, v in enumerate(values)])).alias("e")).select("g", "e.i", "e.bin")
    bins = each.groupBy("g", "i", "bin").agg(F.count("*").alias("n")).coalesce(sizes.tasks)
    order = Window.partitionBy("g", "i").orderBy("bin")
    placed = bins.select("g", "i", "bin", F.sum("n").over(order).alias("upto"), F.sum("n").over(Window.partitionBy("g", "i")).alias("size")).coalesce(sizes.tasks)
    middle = placed.where(2 * F.col("upto") >= F.col("size")).groupBy("g").agg(*[((F.min(F.when(F.col("i") == i, F.col("bin"))) + 0.5) / PER_UNIT).alias(f"{name}{i}") for i in range(len(values))])
    return saved(middle.coalesce(sizes.tasks))


def _starts(vectors: DataFrame, sizes: Sizes) -> DataFrame:
    """The four estimates that the steps begin with."""
    middle = _medians(vectors, [F.col(x) for x in X], "m", sizes)
    spread = _medians(_with(vectors, middle, sizes), [F.abs(F.col(x) - F.col(f"m{i}")) for i, x in enumerate(X)], "a", sizes)
    location = [f"m{i}" for i in range(P)]
    scales = [F.sqrt((1.4826 * F.col(f"a{i}")) ** 2 + FLOORS[i] ** 2).alias(f"s{i}") for i in range(P)]
    scale = saved(middle.join(F.broadcast(spread) if sizes.few else spread, "g").select("g", *location, *scales).coalesce(sizes.tasks))
    diagonal = [(F.col(f"s{i}") ** 2 if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in PAIRS]
    robust = _factored(scale.select("g", F.lit(0).alias("start"), *location, *diagonal))
    classic = _moments(vectors.withColumn("start", F.lit(1)), 1.0, sizes)
    z = [(F.col(x) - F.col(f"m{i}")) / F.col(f"s{i}") for i, x in enumerate(X)]
    norm = F.sqrt(F.greatest(reduce(Column.__add__, [v * v for v in z]), F.lit(1e-12)))
    bent = F.array(*[F.struct(F.lit(k).alias("start"), *[f(v).alias(f"u{i}") for i, v in enumerate(z)]) for k, f in ((2, F.tanh), (3, lambda v: v / norm))])
    moved = _with(vectors, scale, sizes).select("g", F.struct(*location, *[f"s{i}" for i in range(P)]).alias("scale"), F.explode(bent).alias("b")).select("g", "scale", "b.*").groupBy("g", "start")
    sums = moved.agg(F.first("scale").alias("scale"), *[F.avg(f"u{i}").alias(f"e{i}") for i in range(P)], *[F.avg(F.col(f"u{i}") * F.col(f"u{j}")).alias(f"q{i}{j}") for i, j in PAIRS]).coalesce(sizes.tasks)
    sums = sums.select("g", "start", "scale.*", *[f"e{i}" for i in range(P)], *[f"q{i}{j}" for i, j in PAIRS])
    own = [(F.col(f"s{i}") * F.col(f"s{j}") * (F.col(f"q{i}{j}") - F.col(f"e{i}") * F.col(f"e{j}")) + (FLOORS[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}") for i, j in PAIRS]
    return saved(robust.unionByName(classic).unionByName(_factored(sums.select("g", "start", *location, *own))).coalesce(sizes.tasks))


def _step(vectors: DataFrame, est: DataFrame, sizes: Sizes) -> DataFrame:
    """The estimates from the share of each (g, start) that is nearest to est."""
    bin_of = F.floor(F.log2(_distance() + 1e-9) * BINS_PER_OCTAVE).cast("int")
    near = _with(vectors, est, sizes).select("g", "start", *X, bin_of.alias("bin"))
    bins = near.groupBy("g", "start", "bin").agg(F.count("*").alias("n"), *_sums()).coalesce(sizes.tasks)
    group = Window.partitionBy("g", "start")
    placed = bins.select("*", F.sum("n").over(group.orderBy("bin")).alias("upto"), F.sum("n").over(group).alias("size"))
    sums = placed.where(F.col("upto") - F.col("n") < SHARE * F.col("size")).groupBy("g", "start").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in (*(f"e{i}" for i in range(P)), *(f"q{i}{j}" for i, j in PAIRS))])
    return saved(_estimated(sums.coalesce(sizes.tasks), consistency(SHARE)))


def robust_distances(rows: DataFrame) -> DataFrame:
    """rows: any columns with g, pools (the groups each row belongs to, narrow to wide) and x0..; adds d2 (null where g is null)."""
    groups = saved(rows.groupBy("g").agg(F.count("*").alias("n")).where("g is not null").coalesce(1))
    many, of_rows = groups.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    sizes = Sizes(4 * many <= MOST_BROADCAST, 1 + many // GROUPS_A_TASK)
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, 3 * of_rows // ROWS_A_TASK)
    members = rows.select(F.explode("pools").alias("g"), *X)
    vectors = saved(members.join(F.broadcast(groups.select("g")) if sizes.few else groups.select("g"), "g", "left_semi").coalesce(tasks))
    est = _starts(vectors, sizes)
    for k in range(MOST_STEPS):
        new = _step(vectors, est, sizes)
        if k == TRIALS - 1:
            order = Window.partitionBy("g").orderBy(F.round("logdet", 9), "start")
            est = saved(new.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place").coalesce(sizes.tasks))
            continue
        before = est.select("g", "start", F.col("logdet").alias("before"))
        moved = new.join(F.broadcast(before) if sizes.few else before, ["g", "start"]).agg(F.max(F.abs(F.col("logdet") - F.col("before")))).first()[0]
        est = new
        if moved is None or k >= TRIALS and moved <= SETTLED:
            break
    weighed = _with(vectors, est, sizes).where(_distance() <= chi2_cut(0.025, P)).select("g", "start", *X)
    final = saved(_moments(weighed, consistency(0.975), sizes))
    measured = _with(rows.where("g is not null"), final, sizes).withColumn("d2", _distance()).select(*rows.columns, "d2")
    return measured.unionByName(rows.where("g is null").withColumn("d2", F.lit(None).cast("double")))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance (squared)."""
    counts = saved(base_counts(docs, id_col, text_col))
    sizes = counts.where("not base_failed").groupBy("lang", "source").agg(F.count("*").alias("size"))
    sizes = sizes.withColumn("lang_size", F.sum("size").over(Window.partitionBy("lang")))
    whole = sizes.select(F.sum("size").alias("all_size"))
    own, of_lang, of_all = F.to_json(F.struct("lang", "source")), F.to_json(F.struct("lang")), F.lit("all")
    named = F.when(F.col("size") >= LEAST, own).when(F.col("lang_size") >= LEAST, of_lang).when(F.col("all_size") >= LEAST, of_all)
    groups = sizes.crossJoin(whole).select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), named.alias("g"), F.array(own, of_lang, of_all).alias("pools"))
    grouped = counts.join(groups, counts.lang.eqNullSafe(groups.g_lang) & counts.source.eqNullSafe(groups.g_source), "left")
    vector = [F.when(~F.col("base_failed"), F.expr(v)).alias(x) for x, v in zip(X, VECTOR, strict=True)]
    rows = saved(grouped.select("doc_id", "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "g", "pools", *vector))
    measured = robust_distances(rows.where("not base_failed"))
    out = ["doc_id", "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    kept = measured.select(*out, F.coalesce(F.col("d2") <= CUTOFF, F.lit(True)).alias("kept"), F.col("d2").alias("distance"))
    return kept.unionByName(rows.where("base_failed").select(*out, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance")))


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are kept."""
    good = judge(docs, id_col, text_col).where("kept").select(F.col("row").alias("__row")).distinct()
    marked = docs.withColumn("__row", row_key(docs, id_col, text_col))
    return marked.join(good, "__row", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir)).drop("row")


QUERIES = {"op2_quality_rules": op2_quality_rules}
ORACLE: dict[str, str] = {}
