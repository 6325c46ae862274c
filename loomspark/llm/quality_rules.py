"""Quality rules for documents and for the hosts that they come from.

Every document gets counts and a verdict of its own. Failures are then summed by host; a host's failure rate
is shrunk towards all hosts' by a beta prior whose two parameters are fitted, by moments, to the hosts'
rates. Hosts whose shrunk rate is surely high are rejected, and the verdict joins back to their documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm import batch
from loomspark.llm.store import Scratch

SYMBOLS = "#*$%&|<>"
#: A host goes if its shrunk failure rate, less so many posterior deviations, is over this.
HOST_RATE = 0.5
DEVIATIONS = 2.0
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeated(words: batch.Words) -> np.ndarray:
    """Per row, words that are in a window of WINDOW words that the row has at least twice."""
    values, per_row = batch.shingles(words, WINDOW, whole_if_short=False)
    row = np.repeat(np.arange(len(per_row)), per_row)
    order = np.lexsort((values, row))
    v, r = values[order], row[order]
    same = (v[1:] == v[:-1]) & (r[1:] == r[:-1])
    twice = np.zeros(len(v), bool)
    twice[1:] |= same
    twice[:-1] |= same
    # A window's words: those from its place among the row's words on.
    first_word = np.concatenate(([0], np.cumsum(words.counts)))[:-1]
    first_window = np.concatenate(([0], np.cumsum(per_row)))[:-1]
    start = order[twice] + (first_word - first_window)[r[twice]]
    covered = np.zeros(len(words.hash) + 1, np.int64)
    np.add.at(covered, start, 1)
    np.add.at(covered, start + WINDOW, -1)
    bounds = np.concatenate((first_word, [len(words.hash)]))
    return _sums(np.cumsum(covered)[:-1] > 0, bounds)


def _duplicate_lines(text: str | None) -> int:
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def _measure(batches):
    for b in batches:
        column = b.column("text")
        for chunk in batch.chunks(column):
            words = batch.words_of(chunk)
            chars = (chunk.data & 0xC0) != 0x80
            lines = [_duplicate_lines(t) for t in column.slice(chunk.first, chunk.rows).to_pylist()]
            counts = [words.counts, _sums(chars & ~batch.SPACE[chunk.data], chunk.offsets), _sums(_SYMBOL[chunk.data], chunk.offsets), np.array(lines), _repeated(words)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(chunk.first, chunk.rows), b.column("host").slice(chunk.first, chunk.rows), *(pa.array(x.astype(np.int64)) for x in counts)], ["doc_id", "host", *_COUNTS])


def document_rules(documents: DataFrame, host: str = "source") -> DataFrame:
    """documents (doc_id, text, host) -> (doc_id, host, counts, base_failed), a row for each row.

    Words are runs without ASCII white space. Null texts are empty and fail, having no words."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", F.col(host).cast("string").alias("host"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(_measure, f"doc_id {kind}, host string, " + ", ".join(f"{c} long" for c in _COUNTS))
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def host_verdicts(rules: DataFrame) -> DataFrame:
    """rules (host, base_failed) -> (host, n, failed, rate, rejected). Null is a host of its own.

    Rows are summed per host before they shuffle. The prior comes from one row of moments over the hosts; with
    fewer than two hosts, or no spread beyond chance, it is worth as many documents as the average host has."""
    hosts = rules.groupBy("host").agg(F.count("*").alias("n"), F.count_if("base_failed").alias("failed"))
    raw = hosts.withColumn("p", F.col("failed") / F.col("n"))
    moments = raw.agg(F.avg("p").alias("mean"), F.var_pop("p").alias("spread"), F.avg("n").alias("size"), F.avg(F.lit(1.0) / F.col("n")).alias("chance"))
    # Of the rates' variance, what binomial sampling explains is taken off.
    center = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("mean")))
    within = center * (1 - center)
    between = F.col("spread") - within * F.col("chance")
    strength = F.when(between > 1e-9, F.greatest(F.lit(1.0), within / between - 1)).otherwise(F.col("size"))
    prior = moments.select((center * strength).alias("a"), ((1 - center) * strength).alias("b"))
    a, b = F.col("a") + F.col("failed"), F.col("b") + F.col("n") - F.col("failed")
    rate = a / (a + b)
    deviation = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    # One row, by construction of the aggregate: a broadcast of two numbers.
    joined = hosts.withColumn("one", F.lit(1)).join(F.broadcast(prior.withColumn("one", F.lit(1))), "one", "left")
    return joined.select("host", "n", "failed", rate.alias("rate"), (rate - DEVIATIONS * deviation > HOST_RATE).alias("rejected"))


def apply_rules(documents: DataFrame, host: str = "source") -> DataFrame:
    """document_rules with host_rate and kept: false if the document fails or its host is rejected.

    Counts are written once, so that every text is read and measured once; the verdicts then join rows without texts.
    A host with a third of all documents is a skewed join, which adaptive execution splits."""
    scratch = Scratch(documents.sparkSession, "rules")
    rules = scratch.save(document_rules(documents, host), "counts")
    verdicts = host_verdicts(rules).select(F.col("host").alias("_host"), F.col("rate").alias("host_rate"), F.col("rejected").alias("host_rejected"))
    joined = rules.join(verdicts, F.col("host").eqNullSafe(F.col("_host")), "left").drop("_host")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce("host_rejected", F.lit(False)))
