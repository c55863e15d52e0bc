"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.checkpoint import materialise
from tidemark.llm._bpe import DEFAULT_VOCABULARY, encoding

#: Rows of the rate table that may be broadcast: about 40 bytes each, so 20 MB at most.
BROADCAST_ROWS = 500_000
_NULL = "\u0000null"
#: The most that a multiplier changes in a step, and beyond which none grows: where constraints contradict each other they would grow for ever.
STEP, MOST_TILT = 5.0, 40.0
#: Shares may be so far from what is asked for, at most, to count as met.
MET = 1e-6


def _level(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(_NULL))


def _tilt(lam: np.ndarray) -> Column:
    """The sum of the multipliers of a cell's levels (numbers in ``on``); one literal for each level."""
    table = F.array(*[F.lit(float(v)) for v in lam])
    return F.aggregate("on", F.lit(0.0), lambda t, i: t + F.get(table, i))


def _dual(cells: DataFrame, first: list[int], target: np.ndarray, ridge: float, tol: float, most: int) -> tuple[np.ndarray, float]:
    """Newton's method on log sum(share exp(lambda . x)) - target . lambda + ridge/2 |lambda|^2.

    ``cells`` has share and on. The sums are Spark aggregates over cells, one job for
    each try, scaled by the largest term of the try before. No multiplier changes by
    more than STEP at once, nor grows beyond MOST_TILT. Also returns how far the farthest share is from its target.
    """
    k = len(target)

    def sums(lam: np.ndarray, shift: float) -> tuple[float, np.ndarray, np.ndarray, float]:
        w = cells.select("on", (F.ln("share") + _tilt(lam)).alias("lw"))
        both = w.select(F.explode("on").alias("i"), "on", "lw").select("i", F.explode("on").alias("j"), "lw")
        both = both.groupBy("i", "j").agg(F.sum(F.exp(F.col("lw") - F.lit(shift))).alias("w"), F.max("lw").alias("top"))
        cross, top = np.zeros((k, k)), -np.inf
        for i, j, v, t in both.toLocalIterator():
            cross[i, j], top = v, max(top, t)
        z = sum(cross[k, k] for k in first)  # each cell has one level of the first axis
        p = np.diag(cross) / z
        return np.log(z) + shift - target @ lam + ridge / 2 * lam @ lam, p, cross / z, top

    lam = np.zeros(k)
    value, p, cross, top = sums(lam, 0.0)
    for _ in range(most):
        gradient = p - target + ridge * lam
        if np.abs(gradient).max() < tol or np.abs(lam).max() > MOST_TILT:
            break
        step = np.linalg.lstsq(cross - np.outer(p, p) + ridge * np.eye(k), -gradient, rcond=None)[0]
        step *= min(1.0, STEP / max(np.abs(step).max(), 1e-300))
        size = 1.0
        while size > 1e-6:
            tried = sums(lam + size * step, top)
            if tried[0] <= value + 1e-4 * size * (gradient @ step) + 1e-13:
                break
            size /= 2
        else:
            break
        lam = lam + size * step
        value, p, cross, top = tried
    return lam, float(np.abs(p - target).max())


def mixing_rates(
    docs: DataFrame,
    targets: dict[str, float] | None = None,
    balance: tuple[str, ...] = ("lang",),
    budget: float | None = None,
    tokens: Column | None = None,
    source_col: str = "source",
    ridge: float = 1e-9,
    tol: float = 1e-8,
    iterations: int = 60,
) -> DataFrame:
    """The table (source, each of ``balance``, rate, met): how often a document of each cell should be seen.

    ``met`` is whether all shares are within MET of what is asked for; if not, there is a
    warning too. A target for a source that has no tokens is an error. Null columns are
    values of their own, null texts have no tokens, ties play no part; without any tokens, the table is empty.
    """
    spark = docs.sparkSession
    axes = [source_col, *balance]
    names = [f"axis{k}" for k in range(len(axes))]
    count = F.ceil(F.octet_length(F.col("text")) / 4) if tokens is None else tokens
    work = docs.select(*[_level(a).alias(n) for a, n in zip(axes, names, strict=True)], F.coalesce(count.cast("double"), F.lit(0.0)).alias("tokens"))
    cells = work.groupBy(*names).agg(F.sum("tokens").alias("tokens")).where(F.col("tokens") > 0)
    if targets is not None:
        wanted = [str(s) for s, w in targets.items() if w > 0]
        cells = cells.where(F.col("axis0").isin(wanted))
    cells = materialise(cells.withColumn("cell", F.concat_ws("\u0001", *names)), "mixing-cells")
    total = cells.agg(F.sum("tokens")).first()[0]
    if not total:
        return cells.select(*names, F.lit(0.0).alias("rate"), F.lit(True).alias("met"))
    shared = cells.select("cell", *names, (F.col("tokens") / F.lit(total)).alias("share"))
    marks = shared.select("cell", "share", F.posexplode(F.array(*names)).alias("axis", "value"))
    # one row for each value of each constraint column; these are the unknowns of the dual
    values = [tuple(r) for r in marks.groupBy("axis", "value").agg(F.sum("share").alias("share")).orderBy("axis", "value").collect()]
    target = np.array([s for _, _, s in values])
    mine = [k for k, (axis, _, _) in enumerate(values) if axis == 0]
    if targets is not None and (absent := set(wanted) - {values[k][1] for k in mine}):
        raise ValueError(f"no tokens in sources {sorted(absent)}")
    wish = np.array([1.0 if targets is None else float(targets[values[k][1]]) for k in mine])
    target[mine] = wish / wish.sum()
    numbers = spark.createDataFrame([(k, axis, value) for k, (axis, value, _) in enumerate(values)], "level int, axis int, value string")
    levels = marks.select("cell", "axis", "value").join(numbers, ["axis", "value"]).groupBy("cell").agg(F.collect_list("level").alias("on"))
    coded = materialise(cells.join(levels, "cell").select(*names, "tokens", (F.col("tokens") / F.lit(total)).alias("share"), "on"), "mixing-levels")
    lam, off = _dual(coded.select("share", "on"), mine, target, ridge, tol, iterations)
    if off > MET:
        warnings.warn(f"the constraints can't all be met: a share is off by {off:.3g}", stacklevel=2)
    tilted = coded.withColumn("tilt", F.exp(_tilt(lam)))
    z = tilted.agg(F.sum(F.col("tokens") * F.col("tilt"))).first()[0]
    scale = (total if budget is None else budget) / z
    # ten digits, so that the order in which sums were added doesn't show
    return materialise(tilted.select(*names, F.round(F.col("tilt") * F.lit(scale), 10).alias("rate"), F.lit(off <= MET).alias("met")), "mixing-rates")


def balanced_copies(
    docs: DataFrame,
    targets: dict[str, float] | None = None,
    balance: tuple[str, ...] = ("lang",),
    budget: float | None = None,
    tokens: Column | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    seed: int = 17,
    keep_columns: bool = False,
    rates: DataFrame | None = None,
) -> DataFrame:
    """Copies of each document so that the sources' shares of tokens meet ``targets``.

    Among all weightings of the documents whose tokens are divided over sources as the
    targets say (equally where there are none), and over the values of the ``balance``
    columns as they are now, the one with the least relative entropy to the corpus is
    taken: a document's rate is exp of a sum of multipliers, found by Newton's method on
    the convex dual, scaled to ``budget`` tokens (those of the corpus where not given).
    Copies are floor(rate + u), with u in [0, 1) a hash of doc_id, so their mean is the rate.
    ``tokens`` is a column; without it a token is four bytes of UTF-8 (``balanced_ids`` counts real ones). Where the
    constraints contradict each other, multipliers stop at e**40, what is met is a compromise, ``met`` is false and a warning says so.
    The dual has one unknown for each source and balance value, solved on the driver:
    meant for thousands of sources, not millions.

    Returns doc_id, source, tokens, rate, met, copies for each row; with ``keep_columns`` the
    input's columns, each row as often as it has copies.

    - null or empty text: 0 tokens, rate 0, 0 copies. A source not among the targets: rate 0.
    - null source or balance value: a value of its own. Null doc_id: u is that of the null.
    - a target for a source without tokens: an error. met is null where there are no tokens of that source and balance value.
    - repeated rows: each counts, all with the same u. Empty table: empty result.
    - other columns play no part, whatever their names.
    """
    axes = [source_col, *balance]
    rates = mixing_rates(docs, targets, balance, budget, tokens, source_col) if rates is None else rates
    few = rates.count() <= BROADCAST_ROWS
    names = [f"axis{k}" for k in range(len(axes))]
    count = F.coalesce((F.ceil(F.octet_length(F.col("text")) / 4) if tokens is None else tokens).cast("bigint"), F.lit(0).cast("bigint"))
    if keep_columns:
        packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), count.alias("tokens"), *[_level(a).alias(n) for a, n in zip(axes, names, strict=True)])
    else:
        packed = docs.select(F.struct(F.col(id_col), F.col(source_col)).alias("row"), count.alias("tokens"), *[_level(a).alias(n) for a, n in zip(axes, names, strict=True)])
    joined = packed.join(F.broadcast(rates) if few else rates, names, "left")
    rate = F.when(F.col("tokens") > 0, F.coalesce("rate", F.lit(0.0))).otherwise(F.lit(0.0))
    u = F.pmod(F.xxhash64(F.col("row")[id_col], F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    done = joined.select("row", "tokens", rate.alias("rate"), "met").withColumn("copies", F.floor(F.col("rate") + u).cast("int"))
    if not keep_columns:
        return done.select(F.col("row")[id_col].alias("doc_id"), F.col("row")[source_col].alias("source"), "tokens", "rate", "met", "copies")
    return done.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def balanced_ids(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, text_col: str = "text", keep_columns: bool = False, **how) -> DataFrame:
    """``balanced_copies`` over the token ids that the vocabulary gives; each text is encoded once, to be counted.

    With ``keep_columns`` only the sums by source and balance value are kept of the counts, and no text is stored.
    """

    @F.pandas_udf("bigint")
    def counted(texts: pd.Series) -> pd.Series:
        coder = encoding(vocabulary)
        return pd.Series([0 if t is None else len(coder.encode_ordinary(t)) for t in texts], dtype="int64")

    name = "n_ids"
    while name in docs.columns:
        name += "_"
    work = docs.withColumn(name, counted(F.col(text_col)))
    if keep_columns:
        asked = {k: how[k] for k in ("targets", "balance", "budget", "source_col") if k in how}
        some = (F.octet_length(text_col) > 0).cast("int")  # a text has ids if it has bytes
        return balanced_copies(docs, tokens=some, keep_columns=True, rates=mixing_rates(work, tokens=F.col(name), **asked), **how)
    sized = materialise(work.drop(text_col), "mixing-tokens")
    return balanced_copies(sized, tokens=F.col(name), **how)


def op10_entropy_balancing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text")
    return balanced_ids(docs)
