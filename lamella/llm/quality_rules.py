"""Quality rules with risk-controlled thresholds.

Each rule compares one measure of a text with a cutoff. Labelled documents are
a holdout: for every stratum and rule, a cutoff is used only if an exact
binomial test shows that it rejects less than the allowed share of good
documents. Cutoffs of a rule are tested from the mildest on until one fails
(fixed-sequence testing, which needs no correction along the sequence), and the
level is divided by the number of strata and rules (Bonferroni). So with
probability 1 - ``delta`` no stratum loses more than ``risk`` of its good
documents to all rules together.

``certified_jointly`` makes the same promise from fewer labels: it tests what
all rules reject together, along one fixed sequence of cutoffs.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamella.llm.common import map_batches, materialise, prepare, words_of

SYMBOLS, WINDOW = "#*$%&|<>", 8
UPPER = bytes(range(65, 91))


class CutoffRule(NamedTuple):
    """Rejects where ``measure`` is over the cutoff; ``cutoffs`` go from mild to strict."""

    measure: str
    cutoffs: tuple[float, ...]


RULES = (
    CutoffRule("symbols_per_word", (3.0, 2.0, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2)),
    CutoffRule("upper_per_char", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2)),
    CutoffRule("marks_per_word", (3.0, 2.0, 1.5, 1.0, 0.8, 0.6, 0.4)),
    CutoffRule("repeat_share", (0.3, 0.25, 0.2, 0.15, 0.1)),
    CutoffRule("dup_line_share", (0.9, 0.7, 0.5, 0.4, 0.3, 0.2)),
)
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_marks long"


def repeated_words(words: Sequence[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    if len(known) == len(words):
        return 0
    # Ranks of pairs, then of pairs of those, and so on give exact window identities without hashing.
    rank, span = ids, 1
    while span < window:
        step = min(span, window - span)
        pairs = rank[:-step] * (int(rank.max()) + 1) + rank[step:]
        rank = np.unique(pairs, return_inverse=True)[1]
        span += step
    twice = np.bincount(rank)[rank] > 1
    ends = np.zeros(len(words) + 1, np.int64)
    ends[:n] += twice
    ends[window : window + n] -= twice
    return int((np.cumsum(ends)[:-1] > 0).sum())


def measure_text(text: str | None) -> tuple[int, ...]:
    """The columns of ``MEASURES`` for one text; a null text measures as an empty one."""
    if not text:
        return (0,) * 8
    words = words_of(text)
    raw = text.encode("utf-8", "surrogatepass")
    blanks = sum(map(text.count, " \t\n\v\f\r"))
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)]
    upper = len(raw) - len(raw.translate(None, UPPER))
    return (
        len(words), len(text) - blanks, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
        repeated_words(words), len(lines), upper, text.count("!") + text.count("?"),
    )


def _measured(rows: DataFrame, text_col: str, carried: Sequence[str]) -> DataFrame:
    """``carried`` columns and the measures of every whole text; a struct column is carried as it is."""
    prepare(rows.sparkSession)
    names = [*carried, *(x.split()[0] for x in MEASURES.split(", "))]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        table = np.array([measure_text(x) for x in batch.column(text_col).to_pylist()], np.int64).reshape(batch.num_rows, 8)
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), *(pa.array(table[:, i]) for i in range(8))], names)

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in carried)
    return map_batches(rows, run, f"{schema}, {MEASURES}").withColumns(measure_columns())


def measured(docs: DataFrame, id_col: str, text_col: str, stratum_col: str) -> DataFrame:
    """id, stratum and the measures of every whole text."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), F.col(text_col).alias("text"))
    return _measured(rows, "text", ["id", "stratum"])


def _verdict(found: DataFrame, chosen: DataFrame, rules: Sequence[CutoffRule], least_words: int, most_repeat_percent: int) -> DataFrame:
    """``found`` with base_failed, broken_rules and kept.

    The cutoffs have a row for each stratum; the join's other side is split by
    rows where the cutoffs are small enough to be sent to all tasks.
    """
    cuts = chosen.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cuts")).withColumnRenamed("stratum", "of")
    broken = F.array_compact(F.array(*(F.when(F.col(r.measure) > F.col("cuts")[r.measure], F.lit(r.measure)) for r in rules)))
    base = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat_percent * F.col("n_words"))
    judged = found.join(cuts, F.col("stratum") == F.col("of"), "left").withColumns({"base_failed": base, "broken_rules": F.coalesce(broken, F.array().cast("array<string>"))})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0))


def measure_columns() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols_per_word": F.col("n_symbols") / words,
        "upper_per_char": F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)),
        "marks_per_word": F.col("n_marks") / words,
        "repeat_share": F.col("n_repeat_words") / words,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
    }


def binomial_cdf(x: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= x), summed from the largest term down until terms no longer count."""
    if x >= n:
        return 1.0
    log_p, log_q, total = math.log(p), math.log1p(-p), 0.0
    for i in range(x, -1, -1):
        term = math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * log_p + (n - i) * log_q)
        total += term
        if i < n * p and term < total * 1e-17:
            break
    return min(1.0, total)


def _trials(found: DataFrame, labels: DataFrame, rules: Sequence[CutoffRule]) -> DataFrame:
    """The good labelled documents, each once in a stratum: rows that share an id are one trial, rejected if any row is."""
    good = labels.filter("good").select(F.col("id").alias("label_id")).distinct()
    return found.join(good, F.col("id") == F.col("label_id")).groupBy("stratum", "label_id").agg(*(F.max(m).alias(m) for m in dict.fromkeys(r.measure for r in rules)))


def certified_cutoffs(found: DataFrame, labels: DataFrame, rules: Sequence[CutoffRule], risk: float, delta: float) -> DataFrame:
    """For each stratum and rule with a certified cutoff: stratum, rule, cutoff, n_good, n_rejected, p_value.

    ``labels`` has id and good (boolean). The test of a cutoff that rejects x
    of n good documents: P(Bin(n, risk / rules) <= x) <= delta / (strata * rules),
    which says the same as that the exact upper confidence bound of the share
    is at most risk / rules.
    """
    tests = [(k, j, c) for k, r in enumerate(rules) for j, c in enumerate(r.cutoffs)]
    held = _trials(found, labels, rules)
    counts = held.groupBy("stratum").agg(
        F.count("*").alias("n"), *(F.sum((F.col(rules[k].measure) > c).cast("long")).alias(f"x{i}") for i, (k, _, c) in enumerate(tests))
    )
    counts = materialise(counts, "quality-counts")
    level = delta / max(1, counts.count() * len(rules))
    share = risk / len(rules)
    rows = counts.select(
        "stratum",
        "n",
        F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(rules[k].measure).alias("rule"), F.lit(j).alias("j"), F.lit(c).alias("cutoff"), F.col(f"x{i}").alias("x")) for i, (k, j, c) in enumerate(tests)))).alias("t"),
    ).select("stratum", "n", "t.*")

    @F.pandas_udf("double")
    def p_value(x: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([binomial_cdf(int(a), int(b), share) for a, b in zip(x, n, strict=True)])

    along = Window.partitionBy("stratum", "k").orderBy("j")
    tested = rows.withColumn("p_value", p_value("x", "n")).withColumn("all_pass", F.max(F.col("p_value") > level).over(along) == F.lit(False))
    last = Window.partitionBy("stratum", "k").orderBy(F.desc("j"))
    best = tested.filter("all_pass").withColumn("place", F.row_number().over(last)).filter("place = 1")
    return best.select("stratum", "rule", "cutoff", F.col("n").alias("n_good"), F.col("x").alias("n_rejected"), "p_value")


def joint_sequence(rules: Sequence[CutoffRule]) -> list[tuple[int, int]]:
    """(rule, cutoff) in the order in which cutoffs are added: every rule's mildest, then every rule's next, and so on."""
    return sorted(((k, j) for k, r in enumerate(rules) for j in range(len(r.cutoffs))), key=lambda x: (x[1], x[0]))


def certified_jointly(found: DataFrame, labels: DataFrame, rules: Sequence[CutoffRule], risk: float, delta: float) -> DataFrame:
    """Like ``certified_cutoffs``, but all rules of a stratum are tested together.

    Each step of ``joint_sequence`` adds a cutoff. Its test is P(Bin(n, risk) <= x)
    <= delta / strata, where x of the stratum's n good documents are rejected
    by any cutoff so far; the first step that fails ends the sequence.
    ``n_rejected`` and ``p_value`` are those of the last step.
    """
    steps = joint_sequence(rules)
    held = _trials(found, labels, rules)
    first = F.least(F.lit(len(steps)), *(F.when(F.col(rules[k].measure) > rules[k].cutoffs[j], t) for t, (k, j) in enumerate(steps)))
    counts = held.withColumn("first", first).groupBy("stratum").agg(F.count("*").alias("n"), *(F.sum((F.col("first") <= t).cast("long")).alias(f"x{t}") for t in range(len(steps))))
    counts = materialise(counts, "quality-counts")
    level = delta / max(1, counts.count())
    listed = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(rules[k].measure).alias("rule"), F.lit(j).alias("j"), F.lit(rules[k].cutoffs[j]).alias("cutoff"), F.col(f"x{t}").alias("x")) for t, (k, j) in enumerate(steps)))
    rows = counts.select("stratum", "n", F.explode(listed).alias("s")).select("stratum", "n", "s.*")

    @F.pandas_udf("double")
    def p_value(x: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([binomial_cdf(int(a), int(b), risk) for a, b in zip(x, n, strict=True)])

    along = Window.partitionBy("stratum").orderBy("t")
    tested = rows.withColumn("p_value", p_value("x", "n")).withColumn("all_pass", F.max(F.col("p_value") > level).over(along) == F.lit(False))
    whole = Window.partitionBy("stratum")
    passed = tested.filter("all_pass").withColumns({"x": F.max("x").over(whole), "p_value": F.max_by("p_value", "t").over(whole)})
    best = passed.withColumn("place", F.row_number().over(Window.partitionBy("stratum", "rule").orderBy(F.desc("j")))).filter("place = 1")
    return best.select("stratum", "rule", "cutoff", F.col("n").alias("n_good"), F.col("x").alias("n_rejected"), "p_value")


def judge(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "lang",
    label_id_col: str = "doc_id",
    good: str = "quality = 1",
    rules: Sequence[CutoffRule] = RULES,
    risk: float = 0.05,
    delta: float = 0.05,
    least_words: int = 20,
    most_repeat_percent: int = 30,
    joint: bool = False,
) -> DataFrame:
    """Measures and verdict of every document.

    Returns id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_lines, n_upper, n_marks, base_failed, broken_rules (array) and kept. The
    base rule (too few words or too much repetition) is not a matter of labels.
    Null and empty texts have no words and fail it. A null stratum is one of
    its own (the empty name). Labels are only counted, never fitted to; a
    stratum without enough labels to certify a cutoff has no rule but the
    base. With ``joint`` the rules of a stratum are certified together, for
    which 86 good labels in each of four strata can do. Repeated rows are judged alike, one by one; a document that
    occurs or is labelled several times counts once, as good if any label says
    so and as rejected if any row is.
    """
    found = materialise(measured(docs, id_col, text_col, stratum_col), "quality")
    marks = labels.select(F.col(label_id_col).alias("id"), F.expr(good).alias("good"))
    chosen = (certified_jointly if joint else certified_cutoffs)(found, marks, rules, risk, delta)
    names = [x.split()[0] for x in MEASURES.split(", ")]
    judged = _verdict(found, chosen, rules, least_words, most_repeat_percent)
    return judged.select(F.col("id").alias(id_col), *names, "base_failed", "broken_rules", "kept")


def keep(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "lang",
    label_id_col: str = "doc_id",
    good: str = "quality = 1",
    rules: Sequence[CutoffRule] = RULES,
    risk: float = 0.05,
    delta: float = 0.05,
    least_words: int = 20,
    most_repeat_percent: int = 30,
    joint: bool = False,
) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns; texts are measured again rather than shuffled."""
    marks = labels.select(F.col(label_id_col).alias("id"), F.expr(good).alias("good"))
    found = materialise(measured(docs, id_col, text_col, stratum_col), "quality")
    chosen = materialise((certified_jointly if joint else certified_cutoffs)(found, marks, rules, risk, delta), "quality-cutoffs")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"))
    return _verdict(_measured(rows, "text", ["row", "stratum"]), chosen, rules, least_words, most_repeat_percent).filter("kept").select("row.*")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, strata by language, at most 5 % of good documents rejected in each with 95 % confidence."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return judge(docs, labels).drop("broken_rules")


def _oracle() -> str:
    measures = {
        "symbols_per_word": "n_symbols / greatest(n_words, 1)",
        "upper_per_char": "n_upper / greatest(word_chars, 1)",
        "marks_per_word": "n_marks / greatest(n_words, 1)",
        "repeat_share": "n_repeat_words / greatest(n_words, 1)",
        "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    }
    grid = ", ".join(f"('{r.measure}', {j}, {c}::DOUBLE)" for r in RULES for j, c in enumerate(r.cutoffs))
    by_rule = " ".join(f"WHEN '{k}' THEN {v}" for k, v in measures.items())
    blanks = r"'[\x20\x09-\x0D]'"
    return rf"""
WITH split AS (
  SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, win) AS times
  FROM (SELECT doc_id, p, w[p:p + 7] AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS p FROM split))
), repeated AS (
  SELECT doc_id, count(DISTINCT spot) AS n FROM (SELECT doc_id, unnest(range(p, p + 8)) AS spot FROM windows WHERE times > 1) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) AS n, count(DISTINCT line) AS d
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM split) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), m AS (
  SELECT s.doc_id, stratum, len(w)::BIGINT AS n_words, length(regexp_replace(text, {blanks}, '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(l.n - l.d, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(l.n, 0)::BIGINT AS n_lines,
         length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_upper, length(regexp_replace(text, '[^!?]', '', 'g'))::BIGINT AS n_marks
  FROM split s LEFT JOIN lines l USING (doc_id) LEFT JOIN repeated r USING (doc_id)
), grid(rule, j, cutoff) AS (VALUES {grid}),
valued AS (SELECT m.*, rule, j, cutoff, CASE rule {by_rule} END AS v FROM m, grid),
counted AS (
  SELECT stratum, rule, j, cutoff, count(DISTINCT doc_id) AS n, count(DISTINCT doc_id) FILTER (WHERE v > cutoff) AS x
  FROM valued WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY ALL
), tested AS (
  SELECT *, list_sum(list_transform(range(0, x + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.05 / 5) + (n - i) * ln(1 - 0.05 / 5))))
         <= 0.05 / ((SELECT count(DISTINCT stratum) FROM counted) * 5) AS ok
  FROM counted
), chosen AS (
  SELECT stratum, rule, max(j) AS j
  FROM (SELECT *, bool_and(ok) OVER (PARTITION BY stratum, rule ORDER BY j) AS so_far FROM tested) WHERE so_far GROUP BY stratum, rule
), broken AS (SELECT DISTINCT doc_id FROM valued JOIN chosen USING (stratum, rule, j) WHERE v > cutoff)
SELECT * EXCLUDE (stratum), n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND doc_id NOT IN (SELECT doc_id FROM broken) AS kept
FROM m
"""


ORACLE_SQL = _oracle()
