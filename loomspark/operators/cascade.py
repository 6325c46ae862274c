"""Resolution by a cascade of steps, each of which must leave exactly one candidate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions.names import symbol_variants, without_comments


def resolve(candidates: DataFrame, ref: str, target: str, steps: Sequence[tuple[str, str]]) -> DataFrame:
    """candidates (ref, target, flags) -> (ref, target, step, candidates).

    steps: (name, boolean column) in order. A reference is resolved by the first step for which exactly one of
    its candidates holds; else it is 'ambiguous', or 'missing' if it has none at all (a null target). One
    aggregate a reference: sums of flags and the only holder of each step."""
    counts = [F.sum(F.when(F.col(c) & F.col(target).isNotNull(), 1).otherwise(0)).alias(f"n_{i}") for i, (_, c) in enumerate(steps)]
    only = [F.min(F.when(F.col(c), F.col(target))).alias(f"t_{i}") for i, (_, c) in enumerate(steps)]
    held = candidates.groupBy(ref).agg(F.count(target).alias("candidates"), *counts, *only)
    step, found = F.when(F.col("candidates") == 0, "missing"), F.lit(None)
    for i, (name, _) in enumerate(steps):
        step = step.when(F.col(f"n_{i}") == 1, name)
    step = step.otherwise("ambiguous")
    for i in range(len(steps) - 1, -1, -1):
        found = F.when(F.col(f"n_{i}") == 1, F.col(f"t_{i}")).otherwise(found)
    return held.select(ref, found.alias(target), step.alias("step"), "candidates")


#: An instance made in code: its type's name, with or without a namespace.
MADE = r"\bnew\s+([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)\s*[({]"
IMPORTED = r"(?m)^\s*using\s+([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)\s*;"


def symbol_uses(files: DataFrame, keys: list[str]) -> DataFrame:
    """files (keys, content) -> (keys, symbol, line, qualifiers, imports): a row for each symbol that a file makes by its
    bare name, with the first line of that, from 1; the namespaces that the file names it with elsewhere; and the file's
    imports. Comments count for nothing; a null content has no rows."""
    held = files.select(*keys, without_comments(F.col("content")).alias("code"))
    found = lambda pattern, group: F.regexp_extract_all("code", F.lit(pattern), F.lit(group))
    held = held.select(*keys, found(MADE, 0).alias("matches"), F.split("code", MADE, -1).alias("between"), found(MADE, 1).alias("names"), F.array_distinct(found(IMPORTED, 1)).alias("imports"))
    held = held.select("*", F.array_distinct("names").alias("made"))

    def use(symbol):
        # What stands before the first match of a symbol: the texts between matches up to it, and the matches before it.
        at = F.array_position("names", symbol).cast("int")
        before = F.concat(F.array_join(F.slice("between", F.lit(1), at), ""), F.array_join(F.slice("matches", F.lit(1), at - 1), ""))
        end = F.concat(F.lit("."), symbol)
        named = F.filter("made", lambda x: F.endswith(x, end))
        line = F.regexp_count(before, F.lit("\n")) + 1
        return F.struct(symbol.alias("symbol"), line.cast("long").alias("line"), F.transform(named, lambda x: F.left(x, F.length(x) - F.length(end))).alias("qualifiers"))

    bare = F.filter("made", lambda x: ~F.contains(x, F.lit(".")))
    # An outer explode: of an inner one the optimiser infers a filter that repeats, below, all that makes the array.
    return held.select(*keys, F.explode_outer(F.transform(bare, use)).alias("use"), "imports").where("use is not null").select(*keys, "use.*", "imports")


def resolve_scopes(uses: DataFrame, classes: DataFrame, keys: list[str], page: str = "page") -> DataFrame:
    """uses (keys with page, symbol, namespace, qualifiers, imports, ...), classes (page, symbol, namespace; a page declares a
    symbol once) -> uses (keys, symbol, line) with target, step and candidates.

    Candidates are the other pages that declare the symbol; a use without any gives no row. The first step that leaves
    exactly one resolves it: the symbol itself, a namespace that it is named with, the page's own, the imported ones
    together; else it is ambiguous, without a target. Candidates are never listed: classes are counted by symbol and by
    symbol and namespace, with the smallest and the largest page of each, which tells the only one beside the page itself.
    So the work grows with uses and their namespaces, however many pages declare a symbol."""
    counts = [F.count("*").alias("n"), F.min(page).alias("low"), F.max(page).alias("high")]
    declared = classes.select(page, "symbol", "namespace").distinct()
    own = declared.select(page, "symbol", F.col("namespace").alias("declared_in"))
    held = uses.join(own, [page, "symbol"], "left").join(declared.groupBy("symbol").agg(*counts), "symbol")

    def others(itself):
        return (F.col("n") - itself.cast("long")).alias("others"), F.when(itself & (F.col("low") == F.col(page)), F.col("high")).otherwise(F.col("low")).alias("other")

    every, only = others(F.col("declared_in").isNotNull())
    held = held.select(*keys, "symbol", "line", "namespace", "qualifiers", "imports", "declared_in", every.alias("candidates"), only.alias("only")).where("candidates > 0")
    scope = lambda i, space: F.struct(F.lit(i).alias("step"), space.alias("space"))
    scopes = F.concat(F.transform("qualifiers", lambda x: scope(1, x)), F.array(scope(2, F.col("namespace"))), F.transform("imports", lambda x: scope(3, x)))
    # One chain of joins: uses are made once, a use that is not open stays as one row without a scope.
    rest = [*keys, "symbol", "line", "candidates", "only"]
    rows = held.select(*rest, "declared_in", F.explode_outer(F.when(F.col("candidates") > 1, F.array_distinct(scopes))).alias("scope")).select(*rest, "declared_in", "scope.*")
    met = rows.join(declared.withColumnRenamed("namespace", "space").groupBy("symbol", "space").agg(*counts), ["symbol", "space"], "left")
    met = met.select(*rest, "step", *others(F.coalesce(F.col("declared_in") == F.col("space"), F.lit(False))))
    mine = lambda i: (F.col("step") == i) & (F.col("others") > 0)
    found = [F.when(F.sum(F.when(mine(i), F.col("others"))) == 1, F.min(F.when(mine(i), F.col("other")))).alias(f"found_{i}") for i in (1, 2, 3)]
    wide = met.groupBy(*keys, "symbol").agg(*(F.first(c).alias(c) for c in ("line", "candidates", "only")), *found)
    unique = F.when(F.col("candidates") == 1, F.col("only"))
    step = F.when(unique.isNotNull(), "unique_symbol")
    for i, name in enumerate(("qualified_symbol", "same_namespace", "imported_namespace"), 1):
        step = step.when(F.col(f"found_{i}").isNotNull(), name)
    return wide.select(*keys, "symbol", "line", F.coalesce(unique, "found_1", "found_2", "found_3").alias("target"), step.otherwise("ambiguous").alias("step"), "candidates")


def symbol_pages(symbols: DataFrame, pages: DataFrame) -> DataFrame:
    """symbols (symbol), pages (page, class_name, stem) -> (symbol, pages): the pages whose class or file stem is a variant of
    the symbol, each once, ascending; none for a symbol without any. Repeated symbols and nulls count once and not at all.

    Each page stands under its two names once, so a page is met at most as often as a symbol has variants."""
    asked = symbols.select("symbol").where("symbol is not null").distinct()
    named = pages.select("page", F.explode(F.array_distinct(F.array("class_name", "stem"))).alias("name")).where("name is not null and name != ''").distinct()
    met = asked.select("symbol", F.explode(symbol_variants(F.col("symbol"))).alias("name")).join(named, "name")
    found = met.groupBy("symbol").agg(F.array_sort(F.collect_set("page")).alias("pages"))
    return asked.join(found, "symbol", "left").select("symbol", F.coalesce("pages", F.array().cast(f"array<{pages.schema['page'].dataType.simpleString()}>")).alias("pages"))
