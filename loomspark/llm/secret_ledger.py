"""Secret scans over a blob ledger, in built-in functions only.

Every version of every path is addressed by the SHA-256 of its content. A ledger holds which blobs have been
scanned under which version of each rule; a run scans only pairs that it lacks, each blob once however many
paths have it, and joins the findings of all blobs back to all paths.

Only rows whose content may occur again shuffle with their content (a Bloom filter of repeated blobs says
which); the rest are scanned where they are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.exact_dedup import flag_repeats, repeat_filter
from loomspark.llm.store import Scratch


@dataclass(frozen=True)
class Rule:
    """A kind of secret: leftmost matches of a pattern that do not overlap; those whose `group` is shorter
    than `least` characters are dropped. `needle` is a literal that every match contains, if there is one.
    Patterns must not look around their matches. A changed rule needs a new version."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    needle: str = ""
    version: int = 1


#: In the order in which spans of the same start are listed.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=8),
    Rule("access", r"AKIA[A-Z0-9]+", least=16, needle="AKIA"),
    Rule("hex", r"[0-9a-f]{32,}", least=32),
)
#: Kinds beyond the base: key blocks, and tokens that announce their issuer.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]*PRIVATE KEY-----)?", needle="PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", least=40, needle="gh"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", least=15, needle="xox"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=40, needle="eyJ"),
)
RULES = BASE_RULES + MORE_RULES
SPAN = "struct<start:bigint,ord:int,end:bigint,kind:string>"


def rule_spans(text: Column, rule: Rule, order: int) -> Column:
    """array<SPAN> of one rule in a text that is not null; offsets in code points, end exclusive.

    The text between matches comes from a split by the same pattern, so positions are running sums and
    the cost is linear in the text."""
    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    steps = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), matches.alias("match"))
    steps = F.slice(steps, F.lit(1), F.size(matches))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["match"])
        span = F.struct(start.cast("bigint").alias("start"), F.lit(order).alias("ord"), end.cast("bigint").alias("end"), F.lit(rule.kind).alias("kind"))
        good = F.length(F.regexp_extract(x["match"], rule.pattern, rule.group)) >= rule.least
        return F.struct(end.cast("bigint").alias("at"), F.when(good, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
    none = F.array().cast(f"array<{SPAN}>")
    found = F.when(text.rlike(rule.pattern), F.aggregate(steps, begin, step, lambda acc: acc["out"])).otherwise(none)
    return F.when(text.contains(rule.needle), found).otherwise(none) if rule.needle else found


def _current(rules: Sequence[Rule]) -> Column:
    return F.array(*(F.concat_ws("@", F.lit(r.kind), F.lit(str(r.version))) for r in rules))


@dataclass
class Scan:
    """ledger (blob, rule): every pair scanned by now. findings (blob, rule, start, end, kind): of all of
    them. by_path: the versions with blob and spans, those of all current rules by start, then kind."""

    ledger: DataFrame
    findings: DataFrame
    by_path: DataFrame


def fresh_findings(versions: DataFrame, rules: Sequence[Rule], ledger: DataFrame | None, scratch: Scratch) -> DataFrame:
    """(blob, rules, spans) of the blobs of versions (blob, content) that some rule has not scanned yet."""
    held = versions.select("blob", "content")
    if ledger is not None:
        known = ledger.where(F.array_contains(_current(rules), F.col("rule"))).groupBy("blob").agg(F.collect_set("rule").alias("done"))
        held = held.join(known, "blob", "left")
    else:
        held = held.withColumn("done", F.array().cast("array<string>"))
    held = held.withColumn("rules", F.array_except(_current(rules), F.coalesce("done", F.array().cast("array<string>")))).where("size(rules) > 0").drop("done")
    flagged = flag_repeats(held, repeat_filter(held.select("blob"), "blob"), "blob")
    once = flagged.where("not maybe").drop("maybe").unionByName(flagged.where("maybe").drop("maybe").dropDuplicates(["blob"]))
    text, none = F.col("content"), F.array().cast(f"array<{SPAN}>")
    spans = [rule_spans(text, r, i) if ledger is None else F.when(F.array_contains("rules", f"{r.kind}@{r.version}"), rule_spans(text, r, i)).otherwise(none) for i, r in enumerate(rules)]
    return scratch.save(once.select("blob", "rules", F.array_sort(F.flatten(F.array(*spans))).alias("spans")), "found")


def scan(versions: DataFrame, ledger: DataFrame | None = None, findings: DataFrame | None = None, rules: Sequence[Rule] = RULES) -> Scan:
    """versions (path, version, content) -> a Scan. ledger and findings are those of earlier runs.

    Null content counts as empty. Repeated rows, and paths that share content, share one scan and each get
    its findings. An empty table gives empty tables. Further columns of versions are ignored. A ledger without
    its findings is refused: the spans of blobs that it knows would be missing."""
    if ledger is not None and findings is None:
        raise ValueError("a ledger needs the findings of the runs that filled it")
    scratch = Scratch(versions.sparkSession, "secrets")
    content = F.coalesce(F.col("content").cast("string"), F.lit(""))
    held = versions.select("path", "version", content.alias("content")).withColumn("blob", F.sha2(F.col("content").cast("binary"), 256))
    found = fresh_findings(held, rules, ledger, scratch)
    pairs = found.select("blob", F.explode("rules").alias("rule"))
    kinds = F.create_map(*(F.lit(x) for r in rules for x in (r.kind, f"{r.kind}@{r.version}")))
    news = found.select("blob", F.explode("spans").alias("s")).select("blob", kinds[F.col("s.kind")].alias("rule"), "s.start", "s.end", "s.kind")
    every, known = (news, pairs) if findings is None else (findings.unionByName(news), pairs)
    if ledger is not None:
        known = ledger.unionByName(pairs)
    orders = F.create_map(*(F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)))
    if findings is None:
        of_blob = found.where("size(spans) > 0").select("blob", "spans")
    else:
        current = every.where(F.array_contains(_current(rules), F.col("rule")))
        of_blob = current.groupBy("blob").agg(F.array_sort(F.collect_set(F.struct("start", orders[F.col("kind")].cast("int").alias("ord"), "end", "kind"))).alias("spans"))
    paths = held.select("path", "version", "blob").join(of_blob, "blob", "left")
    paths = paths.withColumn("spans", F.coalesce("spans", F.array().cast(f"array<{SPAN}>")))
    return Scan(known, every, paths)


def span_string(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, or run of overlapping spans, replaced by a mark."""
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        joined = F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], gap, F.lit(mark)))
        return F.struct(F.greatest(acc["at"], s["end"]).cast("bigint").alias("at"), joined.alias("out"))

    return F.aggregate(spans, begin, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))


def redact_documents(documents: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """documents with the secrets in `text` replaced, and n_chars, where there is one, brought in line.

    Every row stays. Rows whose content has no finding go straight through; the others, and chance hits of
    the filter that tells them apart, shuffle to meet their findings. Null texts stay null."""
    scratch = Scratch(documents.sparkSession, "redact")
    columns = documents.columns
    held = documents.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("content"))
    held = held.withColumn("blob", F.sha2(F.col("content").cast("binary"), 256))
    found = fresh_findings(held, rules, None, scratch).where("size(spans) > 0").select("blob", "spans")
    flagged = flag_repeats(held, repeat_filter(found.select("blob"), "blob", least=1), "blob")
    some = flagged.where("maybe").join(found, "blob", "left")
    clean = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(redacted(F.col("content"), F.col("spans")))
    changed = {"text": clean}
    if "n_chars" in columns:
        changed["n_chars"] = F.when(F.col("spans").isNull(), F.col("row.n_chars")).otherwise(F.length(clean).cast(documents.schema["n_chars"].dataType))
    some = some.select(*(changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in columns))
    return flagged.where("not maybe").select("row.*").unionByName(some)
