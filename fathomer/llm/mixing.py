"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted in tokens by cell (source, language, topic). Raking scales the cells' weights until
their sums by source, by language and by topic meet the targets: it ends when a sweep over the margins changes no share by more than
``SETTLED`` (or after ``MOST_SWEEPS``), with a warning that names the largest miss if the targets contradict each other. Each document is then kept with the
probability c * raked / actual of its cell, where c = min(fraction, the largest value at which no probability exceeds 1): the
expected margins of the kept tokens are the raked ones exactly, and where a rare cell is to grow much, fewer tokens than
``fraction`` are kept. The draw is a fixed function of doc_id (md5), so it is repeatable and needs no shuffle of texts.

Targets: a share for each value of a margin; values without one share the rest in proportion to
actual_share ** power of the margin (temperature smoothing, which shrinks hot values). Topics are the labels of ``embeddings`` by vec_id = doc_id; documents
without one have topic -1.

Defined results: a null or empty text has 0 tokens and is kept if its cell keeps anything at all (its draw is the
same as any); a null source or language is the value '' of its margin; a null doc_id draws as the
key 'null'; repeated rows of one doc_id are drawn alike; several labels of one doc_id count as the least. Cells
whose tokens are 0 have probability 0 for documents with tokens (there are none) and 1 for empty ones. Extra columns pass through.
Probabilities are rounded to nine digits before the draw.

The fit is a function of cells only. They come to the driver if there are at most ``DRIVER_CELLS``; beyond that the
same sweeps run as Spark aggregations over a written table, with the same probabilities.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import frames

SETTLED = 1e-13
#: A larger miss of a target is told in a warning.
MISS = 1e-6
MOST_SWEEPS = 500
#: Sweeps of the SQL version, which has no test of convergence.
SQL_SWEEPS = 40
DRIVER_CELLS = 1_000_000
FRACTION = 0.8
POWER = {"source": 0.8, "lang": 0.9, "topic": 0.9}
#: Target shares by margin; values that aren't named share the rest.
TARGETS: dict[str, dict[str, float]] = {"source": {}, "lang": {"en": 0.58, "de": 0.16}, "topic": {}}
MARGINS = ("source", "lang", "topic")


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\r\n]+")), F.lit(0)).cast("long")


def _targets(margin: str, values: np.ndarray, actual: np.ndarray) -> np.ndarray:
    named = TARGETS[margin]
    share = actual / max(actual.sum(), 1)
    given = np.array([named.get(str(v), -1.0) for v in values])
    smooth = np.where(given < 0, np.where(share > 0, share, 1.0) ** POWER[margin] * (share > 0), 0.0)
    rest = 1 - given[given >= 0].sum()
    out = np.where(given >= 0, given, rest * smooth / max(smooth.sum(), 1e-300)) * (share > 0)
    return out / max(out.sum(), 1e-300)


def rake(codes: list[np.ndarray], weight: np.ndarray, targets: list[np.ndarray], most: int | None = None) -> np.ndarray:
    """Raked shares of the cells: codes[m] is each cell's value of margin m."""
    x = weight / max(weight.sum(), 1e-300)
    for _ in range(MOST_SWEEPS if most is None else most):
        was = x
        for code, t in zip(codes, targets):
            s = np.bincount(code, x, len(t))
            x = x * (t / np.where(s > 0, s, 1.0))[code]
        if np.abs(x - was).max(initial=0.0) <= SETTLED:
            break
    miss = max((float(np.abs(np.bincount(c, x, len(t)) - t).max(initial=0.0)) for c, t in zip(codes, targets)), default=0.0)
    _tell(miss)
    return x


def _tell(miss: float) -> None:
    if miss > MISS:
        warnings.warn(f"the targets can't all be met; the largest miss of a target is {miss:.3g}", stacklevel=3)


def _probability(ratio: Column, c: float) -> Column:
    return F.round(F.least(F.lit(1.0), F.lit(c) * ratio), 9)


def _scale(fraction: float, most: float | None) -> float:
    return min(fraction, 1 / most) if most else fraction


def _on_driver(cells: DataFrame, fraction: float) -> DataFrame:
    import pandas as pd

    pdf = cells.toPandas().sort_values(list(MARGINS), ignore_index=True)
    w = pdf["weight"].to_numpy(float)
    codes, targets = [], []
    for m in MARGINS:
        values, code = np.unique(pdf[m].to_numpy(), return_inverse=True)
        codes.append(code)
        targets.append(_targets(m, values, np.bincount(code, w, len(values))))
    ratio = np.where(w > 0, rake(codes, w, targets) * w.sum() / np.where(w > 0, w, 1), 0.0)
    out = pd.DataFrame({**{m: pdf[m] for m in MARGINS}, "weight": w, "ratio": ratio})
    back = cells.sparkSession.createDataFrame(out, "source string, lang string, topic int, weight double, ratio double")
    p = F.when(F.col("weight") > 0, _probability(F.col("ratio"), _scale(fraction, float(ratio.max(initial=0.0))))).otherwise(1.0)
    return back.select(*MARGINS, p.alias("p"))


def _on_cluster(cells: DataFrame, fraction: float) -> DataFrame:
    """The same sweeps where the cells are too many for the driver."""
    total = cells.agg(F.sum("weight")).first()[0] or 0
    x = cells.where("weight > 0").withColumn("x", F.col("weight") / F.lit(float(max(total, 1))))
    targets = {}
    for m in MARGINS:
        share = x.groupBy(m).agg(F.sum("x").alias("share"))
        names = TARGETS[m]
        given = F.coalesce(*[F.when(F.col(m).cast("string") == k, F.lit(v)) for k, v in names.items()], F.lit(-1.0))
        t = share.withColumn("g", given).withColumn("s", F.when(F.col("g") < 0, F.pow("share", F.lit(POWER[m]))).otherwise(0.0))
        sums = t.agg(F.sum("s").alias("all_s"), F.sum(F.when(F.col("g") >= 0, F.col("g")).otherwise(0.0)).alias("all_g"))
        t = t.crossJoin(F.broadcast(sums)).withColumn("t", F.when(F.col("g") >= 0, F.col("g")).otherwise((1 - F.col("all_g")) * F.col("s") / F.greatest("all_s", F.lit(1e-300))))
        norm = F.broadcast(t.agg(F.sum("t").alias("all_t")))
        targets[m] = frames.cut(t.crossJoin(norm).select(m, (F.col("t") / F.col("all_t")).alias("t")))
    for _ in range(MOST_SWEEPS):
        x = x.withColumn("was", F.col("x"))
        for m in MARGINS:
            s = x.groupBy(m).agg(F.sum("x").alias("sx")).join(targets[m], m).select(m, (F.col("t") / F.col("sx")).alias("f"))
            x = x.join(s, m).withColumn("x", F.col("x") * F.col("f")).drop("f")
        x = frames.cut(x)
        if (x.agg(F.max(F.abs(F.col("x") - F.col("was")))).first()[0] or 0.0) <= SETTLED:
            break
    _tell(max((x.groupBy(m).agg(F.sum("x").alias("sx")).join(targets[m], m).agg(F.max(F.abs(F.col("sx") - F.col("t")))).first()[0] or 0.0 for m in MARGINS)))
    x = x.withColumn("ratio", F.col("x") * F.lit(float(total)) / F.col("weight"))
    c = _scale(fraction, x.agg(F.max("ratio")).first()[0])
    kept = x.select(*MARGINS, _probability(F.col("ratio"), c).alias("p"))
    return kept.union(cells.where("weight <= 0").select(*MARGINS, F.lit(1.0)))


def _keyed(docs: DataFrame, topics: DataFrame) -> DataFrame:
    """docs with _fx_source, _fx_lang, _fx_topic."""
    t = topics.where("vec_id is not null and label is not null").groupBy(F.col("vec_id").alias("_fx_vec")).agg(F.min("label").cast("int").alias("_fx_label"))
    t = frames.small(t, 32, topics.count())
    keyed = docs.join(t, F.col("doc_id").cast("bigint") == F.col("_fx_vec"), "left")
    return keyed.withColumns({"_fx_source": F.coalesce("source", F.lit("")), "_fx_lang": F.coalesce("lang", F.lit("")), "_fx_topic": F.coalesce("_fx_label", F.lit(-1))})


def probabilities(docs: DataFrame, topics: DataFrame, fraction: float = FRACTION, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """(source, lang, topic, p) of every cell."""
    narrow = docs.select("doc_id", "source", "lang", tokens(F.col("text")).alias("_fx_tokens"))
    cells = _keyed(narrow, topics).groupBy(*[F.col(f"_fx_{m}").alias(m) for m in MARGINS]).agg(F.sum("_fx_tokens").alias("weight"))
    cells = frames.written(cells, "cells")
    return _on_driver(cells, fraction) if cells.count() <= driver_cells else _on_cluster(cells, fraction)


def _drawn(docs: DataFrame, topics: DataFrame, fraction: float) -> DataFrame:
    p = frames.written(probabilities(docs, topics, fraction), "mix").select(*[F.col(m).alias(f"_fx_{m}") for m in MARGINS], F.col("p").alias("_fx_p"))
    keyed = _keyed(docs, topics).join(frames.small(p, 64), [f"_fx_{m}" for m in MARGINS])
    return keyed.where(frames.uniform(F.col("doc_id")) < F.col("_fx_p"))


def sample(docs: DataFrame, topics: DataFrame, fraction: float = FRACTION) -> DataFrame:
    """The drawn documents: doc_id, source, lang, topic, n_tokens, p."""
    out = _drawn(docs.select("doc_id", "source", "lang", "text"), topics, fraction)
    return out.select("doc_id", "source", "lang", F.col("_fx_topic").alias("topic"), tokens(F.col("text")).alias("n_tokens"), F.col("_fx_p").alias("p"))


@frames.shielded
def mix(docs: DataFrame, topics: DataFrame, fraction: float = FRACTION) -> DataFrame:
    """The drawn documents, columns as they were."""
    return _drawn(docs, topics, fraction).select(*docs.columns)


def _target_sql(m: str) -> str:
    given = " ".join(f"WHEN '{k}' THEN {v}" for k, v in TARGETS[m].items())
    named = f"CASE CAST({m} AS VARCHAR) {given} ELSE -1.0 END" if given else "-1.0"
    return f"""
    g_{m} AS (SELECT {m}, sum(w) / (SELECT sum(w) FROM cells) AS s, {named}::DOUBLE AS g FROM cells GROUP BY {m}),
    h_{m} AS (SELECT {m}, CASE WHEN g >= 0 THEN g ELSE
        (1 - (SELECT coalesce(sum(g), 0) FROM g_{m} WHERE g >= 0)) * pow(s, {POWER[m]}) / (SELECT sum(pow(s, {POWER[m]})) FROM g_{m} WHERE g < 0) END AS t FROM g_{m} WHERE s > 0),
    t_{m} AS (SELECT {m}, t / (SELECT sum(t) FROM h_{m}) AS t FROM h_{m})"""


SQL = f"""
WITH RECURSIVE top AS (SELECT vec_id, min(label) AS label FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL GROUP BY vec_id),
doc AS (SELECT doc_id, d.source AS raw_source, d.lang AS raw_lang, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(label, -1)::INTEGER AS topic,
    coalesce(len(regexp_extract_all(text, '[^ \\t\\r\\n]+')), 0)::BIGINT AS n_tokens
    FROM documents d LEFT JOIN top ON top.vec_id = d.doc_id),
cells AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS w FROM doc GROUP BY ALL),
{",".join(_target_sql(m) for m in MARGINS)},
sweep AS (
    SELECT 0 AS k, source, lang, topic, w, w / sum(w) OVER () AS x, t_source.t AS ts, t_lang.t AS tl, t_topic.t AS tt
    FROM cells JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic) WHERE w > 0
    UNION ALL
    SELECT k + 1, source, lang, topic, w, x2 * tt / sum(x2) OVER (PARTITION BY topic), ts, tl, tt FROM (
        SELECT *, x1 * tl / sum(x1) OVER (PARTITION BY lang) AS x2 FROM (
            SELECT *, x * ts / sum(x) OVER (PARTITION BY source) AS x1 FROM sweep WHERE k < {SQL_SWEEPS}))),
fitted AS (SELECT source, lang, topic, w, x * (SELECT sum(w) FROM cells) / w AS ratio FROM sweep WHERE k = {SQL_SWEEPS}),
c AS (SELECT least({FRACTION}, 1 / max(ratio)) AS c FROM fitted),
prob AS (SELECT source, lang, topic, round(least(1.0, (SELECT c FROM c) * ratio), 9) AS p FROM fitted
    UNION ALL SELECT source, lang, topic, 1.0 FROM cells WHERE w <= 0)
SELECT doc_id, raw_source AS source, raw_lang AS lang, topic, n_tokens, p FROM doc JOIN prob USING (source, lang, topic)
WHERE ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 < p
"""
