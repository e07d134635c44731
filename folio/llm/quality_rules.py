"""Operator 9: quality rules, with verdicts on hosts that come back to their documents. Native.

Document rules: too few words, too many words in repeated three-word windows (these two reject a
document by themselves), too many symbols, too many repeated lines. A host's failure rate counts
the documents that fail any rule. Rates of hosts with few documents say little, so each is shrunk:
a beta prior is fitted to all hosts by weighted moments (mean: failures over documents; variance: that between
hosts, what sampling alone explains taken out), and the posterior mean is the host's rate. The prior counts as
one document at least and ``MOST_PRIOR`` at most, so that a host with many speaks for itself. A host is distrusted if its rate is over
``distrust``, or over ``multiple`` times the prior's mean: however many documents hosts have, those stay trusted whose
true rate is under it. There a document that fails any rule goes; a document that fails none stays wherever it
comes from.

Only counts are aggregated (partial sums before the shuffle, whatever the host's share of the
rows). Distrusted hosts are broadcast if there are at most ``broadcast_hosts``; more are joined by
host and a salt, so that a host with a third of all documents is spread over ``salts`` keys.

Nulls: a null text has no words and fails; documents without a host form one host. Repeated rows
count as often as they come. Empty tables give no rows. Windows are compared by a 64-bit hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.shared import stage
from folio.llm.text_stats import with_counts

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOL_PERCENT = 10  # of word characters
MAX_DUP_LINE_PERCENT = 30
DISTRUST = 0.5
MULTIPLE = 1.25
MOST_PRIOR = 50.0


def rule_failures() -> dict:
    """Rule → condition on the columns of ``_counts``."""
    c = lambda name: F.col(f"_counts.{name}")
    return {
        "few_words": c("n_words") < MIN_WORDS,
        "repeats": 100 * c("n_repeat_words") > MAX_REPEAT_PERCENT * c("n_words"),
        "symbols": 100 * c("n_symbols") > MAX_SYMBOL_PERCENT * c("word_chars"),
        "dup_lines": 100 * c("n_dup_lines") > MAX_DUP_LINE_PERCENT * c("n_lines"),
    }


def judged(docs: DataFrame, host: str = "source") -> DataFrame:
    """Adds ``_counts`` and ``_judged`` (host, base_failed, any_failed)."""
    rules = rule_failures()
    every = rules["few_words"] | rules["repeats"] | rules["symbols"] | rules["dup_lines"]
    flags = F.struct(F.coalesce(F.col(host), F.lit("")).alias("host"), (rules["few_words"] | rules["repeats"]).alias("base_failed"), every.alias("any_failed"))
    return with_counts(docs).withColumn("_judged", flags)


def host_verdicts(rows: DataFrame, distrust: float = DISTRUST, multiple: float = MULTIPLE) -> DataFrame:
    """One row for each host: n_docs, n_failed, rate (shrunk) and distrusted."""
    hosts = rows.groupBy(F.col("_judged.host").alias("host")).agg(F.count("*").alias("n_docs"), F.sum(F.col("_judged.any_failed").cast("long")).alias("n_failed"))
    hosts = stage(hosts, "hosts")
    n, f, m = F.col("n_docs"), F.col("n_failed"), F.col("m")
    # one row each: the sums for the mean, and those for the variance around it
    prior = hosts.agg(F.sum(f).alias("f"), F.sum(n).alias("n"), F.sum(n * n).alias("nn"), F.count("*").alias("k"), F.sum(f * f / n).alias("ff"))
    prior = prior.select("k", "n", "nn", (F.col("f") / F.col("n")).alias("m"), (F.col("ff") - F.col("f") * F.col("f") / F.col("n")).alias("ss"))
    total = F.col("n")
    between = (F.col("ss") - (F.col("k") - 1) * m * (1 - m)) / F.when(F.col("k") > 1, total - F.col("nn") / total)
    weight = F.least(F.lit(MOST_PRIOR), F.greatest(F.lit(1.0), m * (1 - m) / F.when(F.col("v") > 0, F.col("v")) - 1))  # alpha + beta
    prior = prior.withColumn("v", between).select("m", F.when(F.col("v") > 0, weight).otherwise(F.lit(MOST_PRIOR)).alias("w"))
    rated = hosts.join(F.broadcast(prior)).withColumn("rate", (f + m * F.col("w")) / (n + F.col("w")))
    worse = (F.col("rate") > distrust) | (F.col("rate") > multiple * m)
    return rated.select("host", "n_docs", "n_failed", "rate", worse.alias("distrusted"))


def with_verdicts(rows: DataFrame, verdicts: DataFrame, *, broadcast_hosts: int = 100_000, salts: int = 32) -> DataFrame:
    """Adds ``kept`` to the rows of ``judged``."""
    bad = verdicts.filter("distrusted").select(F.col("host").alias("_host"))
    small = bad.limit(broadcast_hosts + 1).count() <= broadcast_hosts
    rows = rows.withColumn("_salt", F.lit(0) if small else F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int"))
    bad = F.broadcast(bad.withColumn("_key", F.lit(0))) if small else bad.withColumn("_key", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    joined = rows.join(bad, (F.col("_judged.host") == F.col("_host")) & (F.col("_salt") == F.col("_key")), "left")
    lost = F.col("_judged.base_failed") | (F.col("_host").isNotNull() & F.col("_judged.any_failed"))
    return joined.withColumn("kept", ~lost).drop("_host", "_key", "_salt")


def quality_report(docs: DataFrame, **limits: float) -> DataFrame:
    """doc_id, host, the counts, base_failed, any_failed and kept of every document."""
    rows = stage(judged(docs.select("doc_id", "text", "source")).select("doc_id", "_counts", "_judged"), "judged")
    got = with_verdicts(rows, host_verdicts(rows, **limits))
    return got.select("doc_id", "_counts.*", F.col("_judged.host").alias("host"), F.col("_judged.base_failed").alias("base_failed"), F.col("_judged.any_failed").alias("any_failed"), "kept")


def keep_good_documents(docs: DataFrame, **limits: float) -> DataFrame:
    """The documents that the rules keep, with their own columns.

    The documents are stored with their flags in between, so each text is counted once.
    """
    columns = [F.col(f"_doc.`{c}`") for c in docs.columns]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), "text", "source")
    rows = stage(judged(packed).select("_doc", "_judged"), "judged")
    return with_verdicts(rows, host_verdicts(rows, **limits)).filter("kept").select(*columns)
