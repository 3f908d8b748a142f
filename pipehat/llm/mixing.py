"""Mixing sources to target weights by iterative proportional fitting.

Token weights of cells (source, language, topic) are raked in turn until the margins by source,
language and topic match their targets within ``TOLERANCE``; documents are then sampled with a probability that their
cell's weight calls for. All of it is DataFrame functions; the cell table, not the documents, takes
part in the iterations, and its margins are sums with partial aggregation.

Targets are given as a table (dimension, value, share), or are each margin's own shares to a power. Topics are a
given column, or come from rules by marker text and length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, forget, written

#: The topic of a text is the first whose marker it contains, else by its number of tokens.
TOPICS = (("legal", "icense"), ("markup", " | "), ("contact", "@"))
BRIEF, BRIEF_TOKENS, OTHER = "brief", 100, "general"
DIMENSIONS = ("source", "lang", "topic")
#: Targets: each margin's share of tokens to this power, made to sum to 1. Below 1, small groups gain.
TEMPERS = {"source": 0.5, "lang": 0.7, "topic": 0.9}
#: Raking ends when no margin is off by more than this share of its goal, or after so many sweeps if the targets contradict each other.
TOLERANCE, MOST_SWEEPS = 1e-10, 24
RATE = 0.5
NONE = "(none)"
TOKEN = r"[^ \t\n\r\f\x0B]+"


def topic(text: Column, tokens: Column, topics: tuple[tuple[str, str], ...] = TOPICS) -> Column:
    """The topic by rules: the first whose marker the text contains, else by its number of tokens."""
    rest = F.when(tokens < BRIEF_TOKENS, BRIEF).otherwise(OTHER)
    for name, marker in reversed(topics):
        rest = F.when(text.contains(marker), name).otherwise(rest)
    return rest


def described(docs: DataFrame, topics: tuple[tuple[str, str], ...] | str = TOPICS) -> DataFrame:
    """``docs`` with mix_tokens, and source, lang and topic filled in, as mix_source, mix_lang and mix_topic; ``topics`` are rules or the name of a column."""
    text = F.coalesce(F.col("text"), F.lit(""))
    tokens = F.regexp_count(text, F.lit(TOKEN)).cast("long")
    named = F.coalesce(F.col(topics).cast("string"), F.lit(NONE)) if isinstance(topics, str) else topic(text, F.col("mix_tokens"), topics)
    own = [c for c in docs.columns if c in ("mix_tokens", "mix_source", "mix_lang", "mix_topic")]
    return docs.drop(*own).withColumns({"mix_tokens": tokens}).withColumns(
        {"mix_source": F.coalesce(F.col("source"), F.lit(NONE)), "mix_lang": F.coalesce(F.col("lang"), F.lit(NONE)), "mix_topic": named}
    )


def with_goals(cells: DataFrame, tempers: dict[str, float], targets: DataFrame | None = None) -> DataFrame:
    """``cells`` with ``goal_<dimension>``: the tokens that the whole margin of the cell's value should have.

    A value's share is that of ``targets`` (dimension, value, share; of a repeated value, the sum; null values are NONE); values that it does not name share what is left of 1 by their
    tokens to the power of the dimension's temper. Shares are made to sum to 1 over the values that have tokens; a value without tokens has goal 0.
    """
    for d in DIMENSIONS:
        own = cells.groupBy(F.col(d).alias("value")).agg(F.sum("tokens").alias("t"))
        if targets is not None:
            given = targets.where(F.col("dimension") == d).groupBy(F.coalesce(F.col("value").cast("string"), F.lit(NONE)).alias("named")).agg(F.sum(F.col("share").cast("double")).alias("given"))
            own = own.join(given, F.col("value") == F.col("named"), "left").drop("named")
        else:
            own = own.withColumn("given", F.lit(None).cast("double"))
        some = F.col("t") > 0
        own = own.select("value", "t", F.when(some, F.col("given")).alias("given"), F.when(some & F.col("given").isNull(), F.pow(F.col("t"), F.lit(tempers[d]))).alias("free"))
        whole = own.agg(F.coalesce(F.sum("free"), F.lit(0.0)).alias("whole_free"), F.coalesce(F.sum("given"), F.lit(0.0)).alias("whole_given"), F.sum("t").cast("double").alias("whole_t"))  # one row
        left = F.greatest(F.lit(1.0) - F.col("whole_given"), F.lit(0.0))
        total = F.col("whole_given") + F.when(F.col("whole_free") > 0, left).otherwise(0.0)
        share = F.coalesce("given", F.when(F.col("whole_free") > 0, F.col("free") / F.col("whole_free") * left), F.lit(0.0))
        goals = own.crossJoin(F.broadcast(whole)).select("value", F.when(total > 0, share / total * F.col("whole_t")).otherwise(0.0).alias(f"goal_{d}"))
        cells = cells.join(goals, F.col(d) == F.col("value")).drop("value")
    return cells


def margins(cells: DataFrame) -> DataFrame:
    """(dimension, value, goal, weight, error) of each margin of raked ``cells``; ``error`` is the share of the goal by which the weight is off."""
    parts = [cells.groupBy(F.lit(d).alias("dimension"), F.col(d).alias("value")).agg(F.first(f"goal_{d}").alias("goal"), F.sum("weight").alias("weight")) for d in DIMENSIONS]
    error = F.when(F.col("goal") > 0, F.abs(F.col("weight") / F.col("goal") - 1)).otherwise(F.col("weight"))
    return parts[0].union(parts[1]).union(parts[2]).withColumn("error", error)


def raked(cells: DataFrame, most_sweeps: int = MOST_SWEEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` (source, lang, topic, tokens and goals) with ``weight``: tokens raked to the goals of all margins in turn.

    A cell without tokens keeps weight 0. Margins are partial sums, and of one row for each value; the driver gets the largest
    error of each sweep. ``margins`` says how far off each is in the end: targets that contradict each other can't all be met.
    """
    now, kept = cells.withColumn("weight", F.col("tokens").cast("double")), None
    for _ in range(most_sweeps):
        for d in DIMENSIONS:
            margin = now.groupBy(F.col(d).alias("value")).agg(F.sum("weight").alias("margin"), F.first(f"goal_{d}").alias("goal"))
            factor = margin.select("value", F.when(F.col("margin") > 0, F.col("goal") / F.col("margin")).otherwise(0.0).alias("factor"))
            now = now.join(factor, F.col(d) == F.col("value")).withColumn("weight", F.col("weight") * F.col("factor")).drop("value", "factor")
        now = written(now, "weights")
        if kept is not None:
            forget(kept)
        kept = now
        if (margins(now).agg(F.max("error")).first()[0] or 0.0) <= tolerance:
            break
    return now


def raked_cells(docs: DataFrame, tempers: dict[str, float] = TEMPERS, targets: DataFrame | None = None) -> DataFrame:
    """The raked cells of ``described`` documents, with their goals."""
    cells = written(docs.groupBy(*(F.col(f"mix_{d}").alias(d) for d in DIMENSIONS)).agg(F.sum("mix_tokens").alias("tokens")), "cells")
    goals = written(with_goals(cells, tempers, targets), "goals")
    out = raked(goals)
    forget(cells, goals)
    return out


def _rates(cells: DataFrame, rate: float, prefix: str) -> DataFrame:
    """The dimensions of each cell, its probability and weight, all named with ``prefix`` in front."""
    share = F.when(F.col("tokens") > 0, F.col("weight") * rate / F.col("tokens")).otherwise(0.0)
    rates = cells.select(*DIMENSIONS, share.alias("share"))
    probability = F.round(F.least("share", F.lit(1.0)), 6)
    weight = F.when(probability > 0, F.round(F.col("share") / probability, 6)).otherwise(0.0)
    return rates.select(*(F.col(d).alias(prefix + d) for d in DIMENSIONS), probability.alias(f"{prefix}probability"), weight.alias(f"{prefix}weight"))


def draw(doc_id: Column) -> Column:
    """A number from 0 to 1 for an id, from its MD5."""
    return F.conv(F.substring(F.md5(doc_id.cast("string").cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def mixed(docs: DataFrame, tempers: dict[str, float] = TEMPERS, rate: float = RATE, targets: DataFrame | None = None, topics: tuple[tuple[str, str], ...] | str = TOPICS) -> DataFrame:
    """``docs`` (doc_id, text, source, lang, ...) with mix_tokens, mix_source, mix_lang, mix_topic, probability, weight and sampled.

    ``targets`` and ``topics`` as in ``with_goals`` and ``described``. A document is sampled if its draw (by its id alone) is below its cell's probability, which is
    ``rate`` times the cell's raked weight over its tokens, and 1 at most; ``weight`` is what the
    document counts for if sampled, over 1 only where the probability would have been. Null source
    or lang is a value of its own, null text is empty; a document without tokens has probability 0
    unless its cell has tokens. A null id draws 0 and is sampled wherever the probability is over 0.
    Repeated rows are sampled together, ties at the probability are not sampled, very long texts count all their tokens. Columns of the seven names
    above are replaced, all others stay whatever their names are. An empty table gives an empty result.
    """
    rows = described(docs.drop("probability", "weight", "sampled"), topics)
    cells = raked_cells(rows, tempers, targets)
    prefix = "cell_"
    while any(c.lower().startswith(prefix) for c in rows.columns):
        prefix += "_"
    rates = _rates(cells, rate, prefix)
    alike = [F.col(f"mix_{d}") == F.col(prefix + d) for d in DIMENSIONS]
    out = rows.join(rates, alike[0] & alike[1] & alike[2])
    out = out.withColumnsRenamed({f"{prefix}probability": "probability", f"{prefix}weight": "weight"}).drop(*(prefix + d for d in DIMENSIONS))
    return out.withColumn("sampled", F.coalesce(draw(F.col("doc_id")), F.lit(0.0)) < F.col("probability"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its probability and whether it is sampled; see ``mixed`` for nulls, empty and very long texts, ties and repeated rows."""
    out = mixed(documents(spark, sf_dir, "doc_id", "text", "source", "lang"))
    return out.select("doc_id", F.col("mix_source").alias("source"), F.col("mix_lang").alias("lang"), F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("n_tokens"), "probability", "weight", "sampled")


def _op3_sql() -> str:
    topics = " ".join(f"WHEN contains(text, '{marker}') THEN '{name}'" for name, marker in TOPICS)
    parts = [
        f"d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang, CAST(len(regexp_extract_all(coalesce(text, ''), '{TOKEN}')) AS BIGINT) AS n_tokens FROM documents)",
        f"e AS (SELECT doc_id, source, lang, n_tokens, CASE {topics} WHEN n_tokens < {BRIEF_TOKENS} THEN '{BRIEF}' ELSE '{OTHER}' END AS topic FROM d)",
        "w0 AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::DOUBLE AS weight FROM e GROUP BY ALL)",
        "whole AS (SELECT sum(tokens)::DOUBLE AS whole FROM w0)",
    ]
    for d in DIMENSIONS:
        parts.append(f"p_{d} AS (SELECT {d} AS value, pow(sum(tokens)::DOUBLE, {TEMPERS[d]}) AS p FROM w0 GROUP BY 1 HAVING sum(tokens) > 0)")
        parts.append(f"t_{d} AS MATERIALIZED (SELECT value, p / (SELECT sum(p) FROM p_{d}) AS share FROM p_{d})")
    k = 0
    for _ in range(MOST_SWEEPS):
        for d in DIMENSIONS:
            parts.append(f"f{k} AS (SELECT m.{d} AS value, CASE WHEN m.margin > 0 THEN coalesce(t.share, 0) * (SELECT whole FROM whole) / m.margin ELSE 0 END AS factor FROM (SELECT {d}, sum(weight) AS margin FROM w{k} GROUP BY 1) m LEFT JOIN t_{d} t ON t.value = m.{d})")
            parts.append(f"w{k + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, weight * factor AS weight FROM w{k} JOIN f{k} ON value = {d})")
            k += 1
    parts.append(f"s AS (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN weight * {RATE} / tokens ELSE 0 END AS share FROM w{k})")
    parts.append("r AS (SELECT *, round(least(share, 1.0), 6) AS probability FROM s)")
    return (
        "WITH " + ",\n".join(parts) + "\nSELECT doc_id, e.source, e.lang, e.topic, n_tokens, probability, CASE WHEN probability > 0 THEN round(share / probability, 6) ELSE 0 END AS weight, "
        "coalesce(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0, 0) < probability AS sampled\n"
        "FROM e JOIN r ON e.source = r.source AND e.lang = r.lang AND e.topic = r.topic"
    )


OP3_SQL = _op3_sql()
