"""Operator 10: quality rules with robust multivariate outliers per language and source.

Word, symbol and repetition statistics are taken natively from each whole text. Documents that pass the fixed
base rules become vectors of transformed statistics, in units of the corpus's medians and median deviations. Each group,
a language's source, gets a minimum-covariance-determinant estimate: from several deterministic starts the
nearest three quarters of the group are taken again and again, until the determinant of their scatter falls no more, and
the start that ends lowest is kept. Vectors far out by Mahalanobis distance are rejected.

A group of any size is judged alike: its mean and scatter are drawn towards the corpus's medians and scales, as by PRIOR
more rows. Scatters are regularised towards the unit matrix, as small or constant statistics would make them singular.

Each concentration step is two aggregations over the vectors: counts of distances in fixed bins, which give the
distance that the nearest three quarters of a group don't exceed, and sums and products over those. Only
sums of that kind are shuffled, so a group of any size costs no task more than its share.

Defined results: null text has no words and fails; null language or source is a group of its own; an empty table gives
an empty result; repeated rows count, and come back, as often as they come; other columns are carried through, but for
those named as one of the result's or as a working column (WORKING), which the operator's own replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, small_join, stored, words

SYMBOLS = "#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Share of a group that an estimate rests on; factor that makes its scatter consistent for normal vectors of five
#: parts: 0.75 / F7(q), q the 0.75 quantile of the chi-squared law with 5 degrees, F7 that law's distribution with 7.
KEEP_SHARE, CONSISTENT = 0.75, 1.41
#: Least scale of each transformed statistic; weight of the unit matrix; rows that the corpus counts for in each group;
#: most steps, which no start has needed; by how much the logarithm of a determinant must fall for another step.
LEAST_SCALE = (0.5, 0.1, 0.1, 0.25, 0.25)
RIDGE, PRIOR, MOST_STEPS, LEAST_FALL = 0.25, 50.0, 30, 1e-3
FEW_ROWS = 50_000  # so many estimates are broadcast, more are joined by shuffle
WORKING = ("_text", "_w", "_p", "_s", "_lines", "_n_lines", "_lang", "_source", "_x", "_z", "_d2", "_mu", "_inv", "_c", "_start", "_det")
#: Squared distance from which a vector is rejected: the chi-squared law with 5 degrees leaves 1e-7 beyond 41.
CUT = 41.0
P = len(LEAST_SCALE)
GRID = 256


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The five base statistics as columns, each over the whole text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    w, p = F.col("_w"), F.col("_p")
    n = F.size(w)
    mask = F.lit((1 << 31) - 1)

    # Each 3-word window as 33 bits of hash and 31 bits of place: sorted, equal windows are neighbours. What
    # neighbours by hash is compared word by word afterwards.
    window = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    packed = F.transform(F.sequence(F.lit(0), n - 3), lambda i: window(i).bitwiseAND(F.lit(~((1 << 31) - 1))).bitwiseOR(i.cast("long")))
    same = lambda x, y: F.coalesce(F.shiftright(x, 31) == F.shiftright(y, 31), F.lit(False))
    alike = F.filter(p, lambda x, i: same(x, F.get(p, i - 1)) | same(x, F.get(p, i + 1)))
    spelled = F.array_sort(F.transform(alike, lambda x: _spelled(w, x.bitwiseAND(mask).cast("int"))))
    s = F.col("_s")
    again = F.filter(s, lambda x, i: F.coalesce(x["win"] == F.get(s, i - 1)["win"], F.lit(False)) | F.coalesce(x["win"] == F.get(s, i + 1)["win"], F.lit(False)))
    places = F.array_sort(F.transform(again, lambda x: x["at"]))
    covered = F.aggregate(
        places,
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return (
        docs.withColumn("_w", words(F.col(text_col)))
        .withColumn("_lines", lines)
        .withColumn("_p", F.when(n >= 4, F.array_sort(packed)).otherwise(F.array().cast("array<bigint>")))
        .withColumn("_s", spelled)
        .withColumns({
            "n_words": n.cast("long"),
            "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_n_lines": F.size("_lines").cast("long"),
            "n_repeat_words": F.when(F.size("_s") == 0, 0).otherwise(covered).cast("long"),
        })
        .drop("_w", "_p", "_s", "_lines")
    )


def _spelled(w: Column, i: Column) -> Column:
    return F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("win"), i.alias("at"))


def _vector() -> list[Column]:
    """Length, word length, and the shares of symbols, repeated lines and repeated words, with logarithms for the sizes."""
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return [F.log1p("n_words"), F.log1p(F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))), share("n_symbols", "word_chars"), share("n_dup_lines", "_n_lines"), share("n_repeat_words", "n_words")]


def _quantile(df: DataFrame, value: str, keys: list[str], q: float) -> DataFrame:
    """Upper edge of the bin in which the share q is reached: counts of bins 1/256 wide, so nothing but counts is shuffled. At most a few thousand bins a group."""
    bins = df.groupBy(*keys, F.ceil(F.col(value) * GRID).alias("_bin")).count()
    run = Window.partitionBy(*keys).orderBy("_bin")
    total = Window.partitionBy(*keys)
    cum = bins.withColumn("_cum", F.sum("count").over(run)).withColumn("_all", F.sum("count").over(total))
    return cum.where(F.col("_cum") >= F.ceil(F.col("_all") * q)).groupBy(*keys).agg((F.min("_bin") / GRID).alias("_q"), F.max("_all").alias("_all"))


def _scaled(vectors: DataFrame) -> DataFrame:
    """vectors with _z in place of _x: each statistic less its median over all, by its scaled median deviation."""
    long = vectors.select(F.posexplode("_x").alias("_f", "_v"))
    medians = {r["_f"]: r["_q"] for r in _quantile(long, "_v", ["_f"], 0.5).collect()}  # P rows
    middle = [float(medians.get(f, 0.0)) for f in range(P)]
    off = long.withColumn("_v", F.abs(F.col("_v") - F.get(F.array(*[F.lit(m) for m in middle]), F.col("_f"))))
    deviations = {r["_f"]: r["_q"] for r in _quantile(off, "_v", ["_f"], 0.5).collect()}
    scale = [max(float(deviations.get(f, 0.0)) * 1.4826, LEAST_SCALE[f]) for f in range(P)]
    z = F.array(*[(F.get("_x", F.lit(f)) - middle[f]) / scale[f] for f in range(P)])
    return vectors.withColumn("_z", z).drop("_x")


def _estimates(moments: DataFrame, keys: list[str], weight: float) -> DataFrame:
    """(keys, _start, _mu, _inv, _det) of sums over vectors: centre and rows of the inverse Cholesky factor of the scatter, both drawn to mean 0 and the unit matrix, and the logarithm of the determinant."""
    w = F.col("_k") / (F.col("_k") + F.lit(weight))
    lower = [(i, j) for i in range(P) for j in range(i + 1)]
    own = lambda i: F.col(f"_s{i}") / F.col("_k")
    c = lambda i, j: w * CONSISTENT * (F.col(f"_s{i}{j}") / F.col("_k") - own(i) * own(j)) + (1 - w) * float(i == j)
    e = moments.withColumns({f"_c{i}{j}": c(i, j) * (1 - RIDGE) + (RIDGE if i == j else 0.0) for i, j in lower})

    def less(i: int, j: int) -> Column:
        left = F.col(f"_c{i}{j}")
        for k in range(j):
            left = left - F.col(f"_l{i}{k}") * F.col(f"_l{j}{k}")
        return left

    for j in range(P):  # column by column, so that few projections lie on each other
        e = e.withColumn(f"_l{j}{j}", F.sqrt(F.greatest(less(j, j), F.lit(1e-6))))
        if j + 1 < P:
            e = e.withColumns({f"_l{i}{j}": less(i, j) / F.col(f"_l{j}{j}") for i in range(j + 1, P)})
    e = e.withColumns({f"_v{i}{i}": 1 / F.col(f"_l{i}{i}") for i in range(P)})
    for d in range(1, P):
        e = e.withColumns({f"_v{i}{i - d}": -sum((F.col(f"_l{i}{k}") * F.col(f"_v{k}{i - d}") for k in range(i - d, i)), F.lit(0.0)) / F.col(f"_l{i}{i}") for i in range(d, P)})
    det = sum((2 * F.ln(f"_l{i}{i}") for i in range(P)), F.lit(0.0))
    return e.select(*keys, "_start", F.array(*[w * own(i) for i in range(P)]).alias("_mu"), F.array(*[F.col(f"_v{i}{j}") for i, j in lower]).alias("_inv"), det.alias("_det"))


def _distance(z: Column, mu: Column, inv: Column) -> Column:
    total = F.lit(0.0)
    at = 0
    for i in range(P):
        y = F.lit(0.0)
        for j in range(i + 1):
            y = y + F.get(inv, F.lit(at)) * (F.get(z, F.lit(j)) - F.get(mu, F.lit(j)))
            at += 1
        total = total + y * y
    return total


def _moments(z: DataFrame, keys: list[str]) -> DataFrame:
    part = lambda i: F.get("_z", F.lit(i))
    sums = [F.sum(part(i)).alias(f"_s{i}") for i in range(P)] + [F.sum(part(i) * part(j)).alias(f"_s{i}{j}") for i in range(P) for j in range(i + 1)]
    return z.groupBy(*keys, "_start").agg(F.count("*").alias("_k"), *sums)


def least_determinants(z: DataFrame, keys: list[str], weight: float = PRIOR) -> DataFrame:
    """z (stored): keys, _z. (keys, _mu, _inv, _det): the estimate of each group that ends with the least determinant.

    Starts: all vectors of the group; those nearest to the corpus's medians; those nearest by the last three statistics.
    """
    whole = _estimates(_moments(z.withColumn("_start", F.lit(0)), keys), keys, weight)
    far = F.lit(float("inf"))
    diagonal = lambda *d: F.array(*[F.lit(float(d[i]) if i == j else 0.0) for i in range(P) for j in range(i + 1)])
    best = whole.withColumn("_det", far)
    for k, inv in enumerate((diagonal(1, 1, 1, 1, 1), diagonal(0, 0, 1, 1, 1))):
        best = best.unionByName(whole.select(*keys, F.lit(k + 1).alias("_start"), F.array(*[F.lit(0.0)] * P).alias("_mu"), inv.alias("_inv"), far.alias("_det")))
    now = best = stored(best, "quality-estimates")
    both = [*keys, "_start"]
    few = best.limit(FEW_ROWS + 1).count() <= FEW_ROWS  # as many rows as any of the joined tables below has
    meet = lambda left, right, on: left.join(F.broadcast(right) if few else right, on)
    for _ in range(MOST_STEPS):
        dist = meet(z, now.select(*both, "_mu", "_inv"), keys).withColumn("_l", F.log1p(_distance(F.col("_z"), F.col("_mu"), F.col("_inv")))).select(*both, "_z", "_l")
        near = meet(dist, _quantile(dist, "_l", both, KEEP_SHARE).select(*both, "_q"), both).where(F.ceil(F.col("_l") * GRID) <= F.round(F.col("_q") * GRID))
        found = _estimates(_moments(near, keys), keys, weight).select(*both, F.struct("_mu", "_inv", "_det").alias("_new"))
        # Starts whose determinant falls no more have ended; the others go on from where they are.
        both_of = best.select(*both, F.struct("_mu", "_inv", "_det").alias("_old")).join(F.broadcast(found) if few else found, both, "left")
        fell = F.coalesce(F.col("_new._det") < F.col("_old._det") - LEAST_FALL, F.lit(False))
        best = stored(both_of.select(*both, F.when(fell, F.col("_new")).otherwise(F.col("_old")).alias("_e"), fell.alias("_fell")).select(*both, "_e.*", "_fell"), "quality-estimates")
        now, best = best.where("_fell").drop("_fell"), best.drop("_fell")
        if not now.limit(1).count():
            break
    return best.groupBy(*keys).agg(F.min_by(F.struct("_mu", "_inv", "_det"), F.struct("_det", "_start")).alias("_e")).select(*keys, "_e.*")


def outlier_distances(vectors: DataFrame, weight: float = PRIOR) -> DataFrame:
    """vectors (stored): _lang, _source, _x, and what else is to be kept. Adds _d2, the squared distance of each."""
    scaled = stored(_scaled(vectors), "quality-vectors")
    own = stored(least_determinants(scaled.select("_lang", "_source", "_z"), ["_lang", "_source"], weight).drop("_det"), "quality-least")
    return small_join(scaled, own, ["_lang", "_source"]).withColumn("_d2", _distance(F.col("_z"), F.col("_mu"), F.col("_inv"))).drop("_z", "_mu", "_inv")


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cut: float = CUT, weight: float = PRIOR) -> DataFrame:
    """docs without their text, with the five statistics, base_failed, distance2 and kept."""
    n = F.col("n_words")
    failed = (n < 50) | (100 * F.col("n_repeat_words") > 50 * n)
    own = {*STATS, "base_failed", "distance2", "kept", *WORKING} - {text_col, lang_col, source_col}
    kept_cols = [c for c in docs.columns if c != text_col and c not in own]
    stats = with_statistics(docs.select(*kept_cols, F.col(text_col).alias("_text")), "_text").drop("_text")
    lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in (lang_col, source_col))
    stats = stored(stats.withColumns({"base_failed": failed, "_lang": lang, "_source": source, "_x": F.array(*_vector())}).drop("_n_lines"), "quality-statistics")
    judged = outlier_distances(stats.where(~F.col("base_failed")), weight).withColumn("kept", F.col("_d2") <= cut)
    out = judged.unionByName(stats.where("base_failed").drop("_x").withColumns({"_d2": F.lit(None).cast("double"), "kept": F.lit(False)}))
    return out.select(*kept_cols, *STATS, "base_failed", F.col("_d2").alias("distance2"), "kept")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir).select("doc_id", "text", "lang", "source")).select("doc_id", *STATS, "base_failed", "kept")
