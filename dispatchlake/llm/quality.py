"""Quality rules of documents, and verdicts on hosts that bind their documents."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dispatchlake.llm.common import SPACE_BYTES, map_slices, staged, text_key, whole

WINDOW = 5
#: Documents that the prior of a host's failure rate is worth at the least.
LEAST_WEIGHT = 20.0
#: Share of a host's documents that may fail a rule, and how many standard errors the host must be above it.
TOLERATED, SURE = 0.05, 1.28
SYMBOLS = b"#*$%&|<>"

#: Base rules reject a document by themselves. The others bind only where the host has failed them.
BASE_RULES = {
    "short": "n_words < 10",
    "repeats": "100 * n_repeat_words > 20 * n_words",
}
HOST_RULES = {
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 12 * n_words",
}
RULES = BASE_RULES | HOST_RULES

#: Spread of the hosts' rates beyond chance, as the correlation within a host, and the weight of a prior with that spread.
WITHIN = "coalesce((squares - all_n * mean * mean) / nullif(mean * (1 - mean), 0) - (hosts - 1), 0) / nullif(all_n - square_n / all_n - (hosts - 1), 0)"
WEIGHT = f"greatest({LEAST_WEIGHT}, 1 / greatest(coalesce({WITHIN}, 0), 1 / (all_n + 1)) - 1)"

MEASURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


def measure_text(text: bytes) -> tuple[int, int, int, int, int, int]:
    """The figures of ``MEASURES`` for one text in UTF-8."""
    words = text.split()
    n = len(words)
    characters = len(text.decode("utf-8", "replace")) - (len(text) - len(text.translate(None, SPACE_BYTES)))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [line for line in text.split(b"\n") if line.strip()]
    repeated = 0
    windows = list(zip(*(words[i:] for i in range(WINDOW))))
    if len(set(windows)) < len(windows):
        times = Counter(windows)
        covered = 0  # words before this position are counted
        for i, window in enumerate(windows):
            if times[window] > 1:
                repeated += i + WINDOW - max(i, covered)
                covered = i + WINDOW
    return n, characters, symbols, len(lines), len(lines) - len(set(lines)), repeated


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per document: ``doc_id``, ``text_key``, ``host`` and the figures of ``MEASURES``."""
    source = docs.select(F.col(id_col).alias("doc_id"), text_key(text_col).alias("text_key"), F.col(host_col).cast("string").alias("host"), whole(text_col).cast("binary").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [measure_text(text) for text in batch.column("text").to_pylist()]
        figures = [pa.array(column, pa.int64()) for column in (zip(*rows) if rows else [[]] * 6)]
        return pa.RecordBatch.from_arrays([*batch.columns[:3], *figures], names=["doc_id", "text_key", "host", *(m.split()[0] for m in MEASURES.split(", "))])

    return map_slices(source, f"doc_id {kind}, text_key long, host string, {MEASURES}", work)


def host_rates(measured: DataFrame) -> DataFrame:
    """Failures of every rule by host, the rate shrunk towards all hosts, and its standard error.

    The prior of a rule is a beta distribution with the mean of all hosts. Its
    weight in documents comes from the moments of a beta-binomial over the
    hosts' own sizes: the less the rates spread beyond chance, the more it is
    worth, from ``LEAST_WEIGHT`` up to all documents. A host of few documents
    stays near the mean; a large one keeps its own rate. ``error`` is the
    standard deviation of the host's posterior.
    Hosts are summed in every task before the shuffle, so a host that holds a
    third of all rows is no more work than another.
    """
    counts = measured.where("host IS NOT NULL").groupBy("host").agg(F.count("*").alias("n"), *(F.count_if(F.expr(test)).alias(rule) for rule, test in RULES.items()))
    by_rule = counts.select("host", "n", F.explode(F.create_map(*(x for rule in RULES for x in (F.lit(rule), F.col(rule))))).alias("rule", "failed"))
    totals = by_rule.groupBy("rule").agg(
        F.count("*").alias("hosts"),
        F.sum("n").alias("all_n"),
        F.sum(F.col("n") * F.col("n")).alias("square_n"),
        (F.sum("failed") / F.sum("n")).alias("mean"),
        F.sum(F.col("failed") * F.col("failed") / F.col("n")).alias("squares"),
    )
    priors = totals.select("rule", "mean", F.expr(WEIGHT).alias("weight"))
    rates = by_rule.join(priors, "rule").withColumn("rate", F.expr("(failed + mean * weight) / (n + weight)"))
    return rates.select("host", "rule", "n", "failed", "rate", F.expr("sqrt(rate * (1 - rate) / (n + weight + 1))").alias("error"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", tolerated: float = TOLERATED, sure: float = SURE) -> DataFrame:
    """Figures, rule failures and verdict of every document.

    A document is rejected when it fails a base rule, or when it fails another
    rule that its host fails too. A host fails a rule when its rate is above
    ``tolerated`` for sure: by ``sure`` standard errors of its posterior (1.28
    is a probability of 0.9). Elsewhere such a document is an exception on a
    good host and stays, as does any document that fails no rule.

    Defined results: a null or empty text has no words, so it fails ``short``;
    a null host has no verdict; repeated rows are each judged and each count;
    other columns of ``docs`` are not read, so their names do not matter; an
    empty table gives an empty result.
    """
    measured = staged(measure(docs, id_col, text_col, host_col))
    flagged = host_rates(measured).where(F.col("rate") - sure * F.col("error") > tolerated)
    verdicts = staged(flagged.groupBy("host").agg(*(F.max(F.col("rule") == rule).alias(f"_{rule}") for rule in RULES)))
    bound = [F.expr(test) & F.coalesce(F.col(f"_{rule}"), F.lit(False)) for rule, test in HOST_RULES.items()]
    failed = F.array_compact(F.array(*(F.when(F.expr(test), F.lit(rule)) for rule, test in RULES.items())))
    base_failed = F.expr(" OR ".join(f"({test})" for test in BASE_RULES.values()))
    host_failed = F.array_compact(F.array(*(F.when(F.col(f"_{rule}"), F.lit(rule)) for rule in RULES)))
    judged = measured.join(verdicts, "host", "left")
    return judged.select(
        "doc_id",
        "text_key",
        "host",
        *(m.split()[0] for m in MEASURES.split(", ")),
        failed.alias("failed_rules"),
        host_failed.alias("host_rules"),
        base_failed.alias("base_failed"),
        (~base_failed & ~(bound[0] | bound[1] | bound[2])).alias("kept"),
    )
