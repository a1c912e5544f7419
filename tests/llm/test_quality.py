"""Quality rules by their plain definitions."""

from __future__ import annotations

import random
import re

from dispatchlake.llm import quality
from dispatchlake.llm.queries import QUERIES


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines), sum(line in lines[:i] for i, line in enumerate(lines)), len(covered)


def test_measures():
    rng = random.Random(7)
    texts = ["", " \n\t", "a " * 30, "é😀 \x0b \x0c\x1c x\x85y", "#*$%&|<>" * 3] + ["".join(rng.choice(["a ", "b ", "c\n", "d", "#", "\n", "é "]) for _ in range(rng.randint(0, 120))) for _ in range(200)]
    for text in texts:
        assert quality.measure_text(text.encode()) == plain(text), repr(text)


def test_verdicts(spark):
    good = "the quick brown fox jumps over the lazy dog and then sleeps well tonight"
    odd = "# # # the quick brown fox jumps over the lazy dog and sleeps"
    rows = [(i, good if i % 3 else odd, "bad") for i in range(60)] + [(100 + i, good, "fine") for i in range(300)]
    rows += [(500, odd, "fine"), (501, odd, None), (502, None, "fine"), (503, "", None), (504, good, "new"), (None, good, "bad"), (505, "w " * 50_000, "fine")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("kept", docs_column())
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert len(got) == len(rows)
    assert all(got[i].kept == bool(i % 3) for i in range(60)) and got[0].host_rules == ["symbols"] and got[0].failed_rules == ["symbols"]
    assert got[500].kept and got[501].kept and got[504].kept and got[None].kept
    assert got[502].base_failed and got[503].base_failed and got[505].base_failed and not got[502].kept
    rates = {(r.host, r.rule): r.rate for r in quality.host_rates(quality.measure(docs)).collect()}
    assert 0.25 < rates["bad", "symbols"] < 0.34 and rates["new", "symbols"] > 0
    assert quality.judge(docs.where("false")).count() == 0


def test_weight_follows_the_spread_of_hosts(spark):
    """Hosts that differ by chance alone give a prior worth many documents; hosts that differ, one of few."""
    from pyspark.sql import functions as F

    def figures(rates):
        rows = [(h, i, int(i % 100 < rate)) for h, rate in enumerate(rates) for i in range(400)]
        frame = spark.createDataFrame(rows, "h long, i long, bad int")
        zero = [F.lit(0).cast("long").alias(c) for c in ("n_lines", "n_dup_lines", "n_repeat_words")]
        return frame.select(F.col("h").cast("string").alias("host"), F.lit(20).alias("n_words"), F.lit(100).alias("word_chars"), (F.col("bad") * 20).alias("n_symbols"), *zero)

    alike = {r.host: r for r in quality.host_rates(figures([7] * 10)).where("rule = 'symbols'").collect()}
    assert all(abs(r.rate - 0.07) < 1e-9 and r.rate - 1.28 * r.error > 0.05 for r in alike.values())
    apart = {r.host: r for r in quality.host_rates(figures([0, 1, 2, 3, 40])).where("rule = 'symbols'").collect()}
    assert apart["4"].rate > 0.35 and apart["0"].rate < 0.01
    assert [h for h, r in sorted(apart.items()) if r.rate - 1.28 * r.error > 0.05] == ["4"]


def test_host_verdicts_decide(spark):
    """On sf0.1 the hosts' verdicts reject documents that no base rule does, and hardly one that is labelled good."""
    folder = "/root/testdata/sf0.1"
    got = QUERIES["op4_quality_rules"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id", "left").collect()
    by_host = [r for r in got if not r.base_failed and not r.kept]
    assert len(by_host) == 698
    assert sum(r.quality == 0 for r in by_host) > 250 and not any(r.quality == 1 for r in by_host)
    good = [r.kept for r in got if r.quality == 1 and r.n_words >= 10]
    assert sum(good) >= 0.98 * len(good)


def docs_column():
    from pyspark.sql import functions as F

    return F.lit("clash")
