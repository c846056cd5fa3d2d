"""Operator 7: mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells of source, language and topic by their number of words. The cells' weights are
raked: scaled to the source targets, then to those of languages, then of topics, again and again, until all three
marginals hold to within TOLERANCE of a share (or MOST_TURNS are over, which raises an error if the caller asks for
that). The ratio of a cell's fitted share to its present one is what its documents are worth; each document
is kept with a probability in proportion to it (at most 1), decided by a hash of its id, so that a rerun keeps the
same documents. The factor follows from a budget of words, so that no single cell sets the size of the sample; cells
worth more than they hold are kept whole, and `shortfall` tells what they lack.

Only cell sums move: each turn sums the cells by one of the three keys. Documents
are joined to their cell's probability, by broadcast while the cells were counted to be few.

Defined results: null and blank texts weigh nothing and are kept with their cell's probability; null source,
language or topic are values of their own; a value without a target keeps its present share (given targets are shares;
they are scaled to sum to 1 over the values present); an empty table gives an empty result; repeated rows share one fate; other columns
are carried through, but for those in WORKING, which the operator's own replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, small_join, stored, unit_hash, words

KEYS = ("_source", "_lang", "_topic")
TURNS, MOST_TURNS, TOLERANCE, FEW_CELLS = 12, 600, 1e-4, 100_000
WORKING = ("_source", "_lang", "_topic", "_weight", "_p", "_want", "_kept", "_w", "_fit", "_ratio", "_all", "_best")


def topic_of(text: Column) -> Column:
    """The topic where no classifier's label is at hand: a document's form by length, in three bands of characters."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n < 1000, "short").when(n < 4000, "middle").otherwise("long")


def tempered(cells: DataFrame, key: str, power: float) -> DataFrame:
    """Targets (key, target), up to a factor: present shares raised to a power below 1, which lifts small values and lowers large ones."""
    return cells.groupBy(key).agg(F.pow(F.sum("_w"), F.lit(power)).alias("target"))


def _scaled(cells: DataFrame, key: str, target: DataFrame) -> DataFrame:
    """(key, key_target) for all values present, summing to 1; a value without a target has its present share. Rows of one value count together; targets for values that no cell has are left out."""
    total = F.broadcast(cells.agg(F.sum("_w").alias("_all")))  # one row
    target = target.groupBy(key).agg(F.sum("target").alias("target"))
    sums = cells.groupBy(key).agg(F.sum("_w").alias("_now")).join(target, key, "left").crossJoin(total)
    want = sums.select(key, F.coalesce("target", F.col("_now") / F.col("_all")).alias("_t"))
    one = F.broadcast(want.agg(F.sum("_t").alias("_sum")))  # one row
    return stored(want.crossJoin(one).select(key, (F.col("_t") / F.col("_sum")).alias(key + "_target")), "mix-targets")


def absent_targets(cells: DataFrame, key: str, target: DataFrame) -> DataFrame:
    """(key, target): targets above 0 that can't be met, as no words have their value."""
    return target.where("target > 0").join(cells.select(key).distinct(), key, "left_anti")


def residual(fitted: DataFrame, keys: list[str]) -> float:
    """The largest distance of a marginal of _fit from its target."""
    worst = 0.0
    for key in keys:
        off = fitted.groupBy(key).agg(F.abs(F.sum("_fit") - F.max(key + "_target")).alias("off")).agg(F.max("off")).head()[0]
        worst = max(worst, off or 0.0)
    return worst


def fit(cells: DataFrame, targets: dict[str, DataFrame], turns: int = TURNS, tolerance: float = TOLERANCE, strict: bool = False) -> DataFrame:
    """cells (stored): the three keys and _w, positive. targets: (key, target) for each key. Adds _fit, shares that meet the targets.

    A turn scales the cells to each of the three in order; their sums are window sums over the cells. Up to
    FEW_CELLS cells, counted, are taken as one partition, so that no turn shuffles. After every `turns` turns the cells
    are written and the residual is looked at: fitting goes on while it is above `tolerance`, MOST_TURNS turns at most.
    Targets that contradict each other over the cells that there are leave a residual: the last key's then hold, or
    `strict` raises an error.
    """
    state = cells.withColumn("_fit", F.col("_w"))
    for key, target in targets.items():
        state = small_join(state, _scaled(cells, key, target), [key])
    state = stored(state, "mix-cells")
    few = state.count() <= FEW_CELLS
    turns, done = min(turns, TURNS), 0  # more of them in one plan would nest too deeply
    while True:
        state = state.coalesce(1) if few else state
        for _ in range(turns):
            for key in targets:
                total = F.sum("_fit").over(Window.partitionBy(key))
                state = state.withColumn("_fit", F.coalesce(F.try_divide(F.col("_fit") * F.col(key + "_target"), total), F.lit(0.0)))
        state, done = stored(state, "mix-fit"), done + turns
        off = residual(state, list(targets))
        if off <= tolerance:
            break
        if done >= MOST_TURNS:
            if strict:
                raise ValueError(f"the targets can't be met together: {off:.3g} is left after {done} turns")
            break
    return state.select(*cells.columns, "_fit")


def budget_scale(ratio: DataFrame, share: float) -> float | None:
    """The factor c at which the sum of _w * min(1, c * _ratio) over the stored cells is `share` of all words; None where that is everything.

    Newton's steps from below on a concave sum: each only adds to the cells that are kept whole, so they end.
    """
    c, before = 0.0, -1
    while True:
        whole = F.col("_ratio") * F.lit(c) >= 1
        now = ratio.agg(F.sum("_w").alias("all"), F.coalesce(F.sum(F.when(whole, F.col("_w"))), F.lit(0.0)).alias("whole"), F.sum(F.when(~whole, F.col("_w") * F.col("_ratio"))).alias("rest"), F.count_if(whole).alias("n")).head()
        if now["all"] is None or share >= 1:
            return None
        if now["n"] == before or not now["rest"]:
            return c
        c, before = (share * now["all"] - now["whole"]) / now["rest"], now["n"]


def shortfall(mixed: DataFrame) -> DataFrame:
    """(source, language, topic, words, wanted, missing) for the cells of `mix` that hold fewer words than the budget asks of them."""
    cells = mixed.where("_want > 1").groupBy(*KEYS).agg(F.sum("_weight").alias("words"), F.sum(F.col("_weight") * F.col("_want")).alias("wanted"))
    return cells.withColumn("missing", F.col("wanted") - F.col("words"))


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, power: float = 0.8, seed: int = 7, least: float = 0.0, share: float | None = None, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None) -> DataFrame:
    """docs with _weight (words), _want (copies asked for), _p (probability) and _kept. targets: {"source" | "lang" | "topic": (value, target)}; those not given are tempered shares.

    share: the budget as a share of all words, met in expectation; cells with _want above 1 are kept whole and fall
    short. Without a budget the cell worth most is kept whole and the others in proportion, so the kept weights meet
    the targets in expectation, but one small cell can shrink the sample. `least` is a floor under the probabilities,
    which trades closeness for size.
    """
    named = (text_col, id_col, source_col, lang_col, topic_col)
    docs = docs.drop(*[c for c in WORKING if c not in named])
    topic = F.col(topic_col) if topic_col else topic_of(F.col(text_col))
    null = F.lit("\x00null")
    keyed = docs.withColumns({"_source": F.coalesce(F.col(source_col).cast("string"), null), "_lang": F.coalesce(F.col(lang_col).cast("string"), null), "_topic": F.coalesce(topic.cast("string"), null), "_weight": F.size(words(F.col(text_col))).cast("double")})
    cells = stored(keyed.groupBy(*KEYS).agg(F.sum("_weight").alias("_w")).where("_w > 0"), "mix-weights")
    given = {f"_{name}": t.select(F.coalesce(F.col(t.columns[0]).cast("string"), null).alias(f"_{name}"), F.col(t.columns[1]).cast("double").alias("target")) for name, t in (targets or {}).items()}
    wanted = {key: given[key] if key in given else tempered(cells, key, power) for key in KEYS}
    fitted = fit(cells, wanted)
    ratio = fitted.crossJoin(F.broadcast(fitted.agg(F.sum("_w").alias("_all")))).withColumn("_ratio", F.col("_fit") / (F.col("_w") / F.col("_all"))).drop("_all")
    if share is None:
        worth = ratio.crossJoin(F.broadcast(ratio.agg(F.max("_ratio").alias("_best")))).withColumn("_want", F.col("_ratio") / F.col("_best"))
    else:
        ratio = stored(ratio, "mix-ratios")
        scale = budget_scale(ratio, share)
        worth = ratio.withColumn("_want", F.lit(1.0) if scale is None else F.col("_ratio") * F.lit(scale))
    chance = stored(worth.select(*KEYS, "_want", F.greatest(F.lit(least), F.least(F.lit(1.0), F.col("_want"))).alias("_p")), "mix-chances")
    out = small_join(keyed, chance, list(KEYS), "left").withColumns({"_want": F.coalesce("_want", F.lit(1.0)), "_p": F.coalesce("_p", F.lit(1.0))})
    return out.withColumn("_kept", unit_hash(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))) < F.col("_p"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mix with their weight and probability; without a budget, as its SQL has it."""
    mixed = mix(documents(spark, sf_dir).select("doc_id", "text", "lang", "source"))
    return mixed.where("_kept").select("doc_id", F.col("_weight").cast("long").alias("n_words"), F.round("_p", 6).alias("p"))


def sample_sql(docs: str, keep: str, power: float = 0.8, seed: int = 7, turns: int = TURNS) -> str:
    """DuckDB: CTEs that end in `mixed` (doc_id, n_words, p, kept) over the view or CTE `docs`; keep: further columns of it, as `, d.text` or empty."""
    steps = []
    state = "mix_f0"
    for turn in range(turns):
        for key in KEYS:
            name = f"mix_f{turn + 1}{key}"
            steps.append(f"{name} as materialized (select s._source, s._lang, s._topic, s._w, s._fit * t.target / n.now as _fit from {state} s join mix_t{key} t using ({key}) join (select {key}, sum(_fit) as now from {state} group by 1) n using ({key}))")
            state = name
    targets = ", ".join(f"mix_t{k} as (select {k}, pow(w, {power}) / sum(pow(w, {power})) over () as target from (select {k}, sum(_w) as w from mix_cells group by 1))" for k in KEYS)
    return f"""
    mix_docs as (select d.doc_id{keep}, coalesce(d.source, chr(1) || 'null') as _source, coalesce(d.lang, chr(1) || 'null') as _lang,
        case when length(coalesce(d.text, '')) < 1000 then 'short' when length(coalesce(d.text, '')) < 4000 then 'middle' else 'long' end as _topic,
        len(regexp_extract_all(coalesce(d.text, ''), '[^\\x20\\x09-\\x0D]+'))::double as _weight from {docs} d),
    mix_cells as (select _source, _lang, _topic, sum(_weight) as _w from mix_docs group by 1, 2, 3 having sum(_weight) > 0),
    {targets},
    mix_f0 as (select *, _w / sum(_w) over () as _fit from mix_cells),
    {", ".join(steps)},
    mix_r as (select _source, _lang, _topic, _fit / (_w / sum(_w) over ()) as ratio from {state}),
    mix_p as (select *, ratio / max(ratio) over () as p from mix_r),
    mixed as (select d.*, coalesce(p.p, 1.0) as p,
        ('0x' || substr(md5({seed} || '|' || coalesce(d.doc_id::varchar, '')), 1, 13))::bigint / pow(16, 13) < coalesce(p.p, 1.0) as kept
        from mix_docs d left join mix_p p using (_source, _lang, _topic))"""


def oracle() -> str:
    return f"with {sample_sql('documents', '')} select doc_id, _weight::bigint as n_words, round(p, 6) as p from mixed where kept"
