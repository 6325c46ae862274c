"""Components found in code: candidate files, scored occurrences, a fallback by declarations and texts, and greedy
one-to-one matching of items to what was found.

Tables: components (project, component, source_name, symbols, tags, texts, hints), the last four arrays of strings;
files (project, file, content). Nothing crosses projects, and every join is on an equal key.
"""

from __future__ import annotations

import gc
import re
import uuid
from collections.abc import Callable, Iterable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.operators.graph import cut
from loomspark.operators.phrases import PHRASE_BYTES, _automaton, _firsts, first_matches, occurrences

MATCH = "item long, occurrence long, score long, status string, confidence double"
#: Confidence by outcome: several pieces of evidence, one, a hit of the fallback only, a tie.
SEVERAL, SINGLE, FALLBACK, AMBIGUOUS = 0.95, 0.75, 0.7, 0.4


#: Scores: a tag of the component, its declaration, one of its texts; more for a preferred file, for the source name
#: near the tag, and for each text near it.
TAG, DECLARATION, TEXT = 10, 12, 5
PREFERRED, NAMED, HINTED = 5, 8, 3
#: What counts as near a tag: so many characters from it to the left and to the right.
BEFORE, AFTER = 300, 500
_TAG = re.compile(r"<([A-Z][A-Za-z0-9_.]*)\b")
#: The look-ahead leaves the name for the next match: in `const let x` both words follow a keyword.
_DECLARATION = re.compile(r"\b(?:function|class|const|let|var)\s+(?=(\w+))")
HITS = ["project", "component", "kind", "file", "symbol", "position", "line", "score", "evidence", "preferred", "has_preferred"]


def _scan(files: DataFrame, keys: list[str], find: Callable[[str], Iterable[tuple]], found: dict[str, pa.DataType]) -> DataFrame:
    """Rows of keys and what find yields of each content, which is none for a null one."""
    sql = {pa.string(): "string", pa.int64(): "long"}

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                row, hits = [], []
                for i, content in enumerate(part.column("content").to_pylist()):
                    for hit in find(content or ""):
                        row.append(i)
                        hits.append(hit)
                columns = zip(*hits, strict=True) if hits else [[] for _ in found]
                held = [part.column(k).take(pa.array(row, pa.int32())) for k in keys]
                yield pa.RecordBatch.from_arrays([*held, *(pa.array(c, t) for c, t in zip(columns, found.values(), strict=True))], [*keys, *found])

    schema = ", ".join([f"`{k}` {files.schema[k].dataType.simpleString()}" for k in keys] + [f"{k} {sql[t]}" for k, t in found.items()])
    return files.select(*keys, F.col("content").cast("string").alias("content")).mapInArrow(run, schema)


def tag_occurrences(files: DataFrame, keys: list[str], before: int = BEFORE, after: int = AFTER) -> DataFrame:
    """(keys, tag, position, line, snippet): each opening tag that begins with a capital, its place from 0, its line from
    1, and what stands around it."""

    def find(content: str):
        line, last = 1, 0
        for m in _TAG.finditer(content):
            line += content.count("\n", last, m.start())
            last = m.start()
            yield m[1], last, line, content[max(0, last - before) : last + after]

    return _scan(files, keys, find, {"tag": pa.string(), "position": pa.int64(), "line": pa.int64(), "snippet": pa.string()})


def declarations(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, symbol, position, line): where a file first declares each symbol, as an inverted index of it. A symbol is one
    word, as in code; names with points or spaces are declared nowhere."""

    def find(content: str):
        line, last, seen = 1, 0, set()
        for m in _DECLARATION.finditer(content):
            line += content.count("\n", last, m.start())
            last = m.start()
            if m[1] not in seen:
                seen.add(m[1])
                yield m[1], last, line

    return _scan(files, keys, find, {"symbol": pa.string(), "position": pa.int64(), "line": pa.int64()})


def _names() -> Column:
    """A component's names, in order: the source's, then the symbols; null and empty ones are none."""
    every = F.concat(F.array("source_name"), F.coalesce("symbols", F.array().cast("array<string>")))
    return F.array_distinct(F.filter(every, lambda x: x != ""))


def _stem() -> Column:
    return F.lower(F.regexp_extract("file", r"([^/]*?)(\.[^./]*)?$", 1))


def candidate_files(components: DataFrame, files: DataFrame) -> DataFrame:
    """(project, component, file, preferred): files that a component's hints name, which are preferred, and files whose
    stem is one of its names in any case. A component without rows here may be anywhere if it has a name at all."""
    there = files.select("project", "file").distinct()
    hinted = components.select("project", "component", F.explode("hints").alias("file")).join(there.hint("merge"), ["project", "file"])
    named = components.select("project", "component", F.explode(F.transform(_names(), lambda x: F.lower(x))).alias("stem")).join(there.withColumn("stem", _stem()).hint("merge"), ["project", "stem"])
    both = hinted.select("project", "component", "file", F.lit(True).alias("preferred")).unionByName(named.select("project", "component", "file", F.lit(False).alias("preferred")))
    return both.groupBy("project", "component", "file").agg(F.max("preferred").alias("preferred"))


def _allowed(hits: DataFrame, components: DataFrame, candidates: DataFrame) -> DataFrame:
    """Hits in a component's candidate files; in any file if it has none but a name. With preferred and has_preferred. Candidates grow with the code and are never broadcast."""
    some = candidates.groupBy("project", "component").agg(F.max("preferred").alias("has_preferred"))
    known = components.select("project", "component", (F.size(_names()) > 0).alias("named")).join(some, ["project", "component"], "left")
    joined = hits.join(known, ["project", "component"]).join(candidates.hint("merge"), ["project", "component", "file"], "left")
    anywhere = F.col("has_preferred").isNull() & F.col("named")
    kept = joined.where(F.col("preferred").isNotNull() | anywhere)
    return kept.withColumn("preferred", F.coalesce("preferred", F.lit(False))).withColumn("has_preferred", F.coalesce("has_preferred", F.lit(False)))


def occurrence_hits(components: DataFrame, files: DataFrame, candidates: DataFrame) -> DataFrame:
    """HITS of the components' tags. Evidence counts the tag, the preferred file, the name and each text near it."""
    spots = tag_occurrences(files, ["project", "file"])
    asked = components.select("project", "component", "source_name", "texts", F.explode(F.array_distinct("tags")).alias("tag"))
    held = _allowed(spots.join(asked, ["project", "tag"]), components, candidates)
    near = F.lower("snippet")
    named = F.coalesce((F.col("source_name") != "") & near.contains(F.lower("source_name")), F.lit(False)).cast("int")
    texts = F.size(F.filter(F.coalesce("texts", F.array().cast("array<string>")), lambda t: near.contains(F.lower(t))))
    own = F.col("preferred").cast("int")
    score, evidence = TAG + PREFERRED * own + NAMED * named + HINTED * texts, 1 + own + named + texts
    return held.select("project", "component", F.lit("tag").alias("kind"), "file", F.col("tag").alias("symbol"), "position", "line", score.cast("long").alias("score"), evidence.cast("long").alias("evidence"), "preferred", "has_preferred")


def fallback_hits(components: DataFrame, files: DataFrame, candidates: DataFrame) -> DataFrame:
    """HITS of declarations of the components' names, and of their texts in any case: the first of each in each file.

    Declarations are an index of (file, symbol), texts one search for all of them; both join on what they found."""
    keys = ["project", "file"]
    names = components.select("project", "component", F.explode(_names()).alias("symbol"))
    declared = declarations(files, keys).join(names, ["project", "symbol"]).select("project", "component", F.lit("symbol").alias("kind"), "file", "symbol", "position", "line")
    texts = components.select("project", "component", F.explode(F.array_distinct("texts")).alias("symbol")).withColumn("phrase", F.lower("symbol"))
    folded = files.select(*keys, F.lower("content").alias("text"))
    found = first_matches(folded, texts.select("phrase"), keys, lines=True)
    written = found.join(texts, ["project", "phrase"]).select("project", "component", F.lit("text").alias("kind"), "file", "symbol", (F.col("position") - 1).alias("position"), "line")
    held = _allowed(declared.unionByName(written), components, candidates)
    score = F.when(F.col("kind") == "symbol", DECLARATION).otherwise(TEXT) + PREFERRED * F.col("preferred").cast("int")
    return held.select("project", "component", "kind", "file", "symbol", "position", "line", score.cast("long").alias("score"), F.lit(1).cast("long").alias("evidence"), "preferred", "has_preferred")


#: Bytes of the components that every task may hold; of more of them, hits are joined.
COMPONENT_BYTES = PHRASE_BYTES
#: Hits that a task gathers before they become a batch.
BATCH_HITS = 65536


class _Index:
    """Components by project and by what a file may hold of theirs."""

    def __init__(self, rows: list) -> None:
        self.rows = rows
        self.hints, self.stems, self.tags, self.names, self.texts = {}, {}, {}, {}, {}
        for r in rows:
            for held, wanted in ((self.hints, r["hints"]), (self.stems, r["stems"]), (self.tags, r["tags"]), (self.names, r["names"]), (self.texts, r["phrases"])):
                for x in dict.fromkeys(wanted or ()):
                    if x is not None:
                        held.setdefault((r["project"], x), []).append(r)


_INDEXED: dict[str, _Index] = {}


def _index(key: str, rows: list) -> _Index:
    """The index of these components, built once in a Python worker."""
    if key not in _INDEXED:
        _INDEXED.clear()
        _INDEXED[key] = _Index(rows)
    return _INDEXED[key]


def _file_hits(index: _Index, automaton, project, file, stem, content: str) -> list[tuple]:
    """HITS of one file: its tags, declarations and texts are each looked for once, whatever components ask for them."""
    preferred = {id(r) for r in index.hints.get((project, file), ())}
    here = preferred | {id(r) for r in index.stems.get((project, stem), ())}
    # Of an ASCII text the lower case has the same places.
    low, plain, out = content.lower(), content.isascii(), []
    asking = lambda held, x: [r for r in held.get((project, x), ()) if id(r) in here or (r["has_preferred"] is None and r["names"])]
    line, last, asked = 1, 0, {}
    for m in _TAG.finditer(content):
        tag, at = m[1], m.start()
        if tag not in asked:
            asked[tag] = asking(index.tags, tag)
        if not asked[tag]:
            continue
        line += content.count("\n", last, at)
        last = at
        begin = max(0, at - BEFORE)
        near, begin, end = (low, begin, at + AFTER) if plain else (content[begin : at + AFTER].lower(), 0, None)
        for r in asked[tag]:
            own = id(r) in preferred
            named = bool(r["source"]) and near.find(r["source"], begin, end) >= 0
            said = sum(t is not None and near.find(t, begin, end) >= 0 for t in r["lowered"] or ())
            out.append((project, r["component"], "tag", file, tag, at, line, TAG + PREFERRED * own + NAMED * named + HINTED * said, 1 + own + named + said, own, bool(r["has_preferred"])))
    declared = {}
    for m in _DECLARATION.finditer(content):
        declared.setdefault(m[1], m.start())
    found = [(at, "symbol", x, r) for x, at in declared.items() for r in asking(index.names, x)]
    if automaton is not None:
        for at, phrase in _firsts(occurrences(automaton, low)):
            found += [(at, "text", x, r) for r in asking(index.texts, phrase) for x, y in dict.fromkeys(zip(r["texts"], r["lowered"], strict=True)) if y == phrase]
    # Lines of texts are those of the folded text, in which they were found.
    for kind, text, base in (("symbol", content, DECLARATION), ("text", low, TEXT)):
        line, last = 1, 0
        for at, symbol, r in sorted(((at, x, r) for at, k, x, r in found if k == kind), key=lambda f: f[0]):
            line += text.count("\n", last, at)
            last = at
            own = id(r) in preferred
            out.append((project, r["component"], kind, file, symbol, at, line, base + PREFERRED * own, 1, own, bool(r["has_preferred"])))
    return out


def _marked(found: list[tuple]) -> list[tuple]:
    """A file's HITS, each with whether another component has one at its place."""
    who: dict[int, set] = {}
    for h in found:
        who.setdefault(h[5], set()).add(h[1])
    return [(*h, len(who[h[5]]) > 1) for h in found]


def _contending(found: list[tuple]) -> list[tuple]:
    """Of marked HITS those that claims may look at. A place that nobody else has found is free whatever others claim. So of a
    component's hits of one score, in order, the best free one is none behind the first such place, the last free one
    none before the last such place, and those two say whether free ones are in several files; and no worse score matters."""
    of, out = {}, []
    for h in found:
        of.setdefault((h[0], h[1]), {}).setdefault((h[2] != "tag", -h[7]), []).append(h)
    for levels in of.values():
        for level in sorted(levels):
            rows = sorted(levels[level], key=lambda h: (h[3], h[5]))
            own = [i for i, h in enumerate(rows) if not h[11]]
            if own:
                out += rows[: own[0] + 1] + rows[max(own[-1], own[0] + 1) :]
                break
            out += rows
    return out


def _search(files: DataFrame, known: list, claims: bool = False) -> DataFrame:
    """HITS of files, each read once, with known components in every task; for claims only those that they may look at."""
    sc, key = files.sparkSession.sparkContext, uuid.uuid4().hex
    held = sc.broadcast(known)
    kinds = {c: files.schema["project" if c == "project" else "file"].dataType.simpleString() for c in ("project", "file")}
    types = ["string", "string", "string", "string", "string", "long", "long", "long", "long", "boolean", "boolean"]
    schema = ", ".join(f"{c} {kinds.get(c, t)}" for c, t in zip(HITS, types, strict=True))
    arrow = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}

    def run(batches):
        index = _index(key, held.value)
        phrases = sorted({x for _, x in index.texts if x})
        automaton, hits, project_type, file_type = _automaton(key, phrases) if phrases else None, [], None, None

        def batch(rows: list) -> pa.RecordBatch:
            of = [project_type if c == "project" else file_type if c == "file" else arrow[t] for c, t in zip(HITS, types, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*(r[: len(HITS)] for r in rows), strict=True), of, strict=True)], HITS)

        for b in batches:
            project_type, file_type = b.schema.field("project").type, b.schema.field("file").type
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                for row in zip(*(part.column(c).to_pylist() for c in ("project", "file", "stem", "content")), strict=True):
                    if row[0] is not None:
                        found = _file_hits(index, automaton, *row[:3], row[3] or "")
                        hits += _marked(found) if claims else found
                    if len(hits) >= BATCH_HITS:
                        hits = _contending(hits) if claims else hits
                        if len(hits) >= BATCH_HITS // 2:
                            yield batch(hits)
                            hits = []
        if hits:
            yield batch(_contending(hits) if claims else hits)

    rows = files.select("project", "file", _stem().alias("stem"), F.col("content").cast("string").alias("content"))
    return rows.mapInArrow(run, schema)


def hits(components: DataFrame, files: DataFrame, there: DataFrame | None = None, limit: int = COMPONENT_BYTES, claims: bool = False) -> DataFrame:
    """All HITS before any claim: occurrences, and what counts only where no occurrence is free. there (project, file): the
    files without their contents, if those are made more cheaply. For claims, where a file is one row, hits go that `greedy`
    never needs, with file and position as what is claimed; its result is that of all hits.

    Components of up to limit bytes, counted before they are collected, are held by every task, which reads each file once
    and gives its hits; nothing is joined with what surrounds a tag. More of them are joined."""
    components = cut(components)
    there = cut((files if there is None else there).select("project", "file").distinct())
    candidates = candidate_files(components, there)
    lowered = F.transform("texts", lambda t: F.lower(t))
    known = components.where("project is not null and component is not null").select("project", "component", F.lower("source_name").alias("source"), _names().alias("names"), "tags", "texts", "hints", lowered.alias("lowered"))
    size = known.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*known.columns)))), F.lit(0))).first()[0]
    if size > limit:
        return occurrence_hits(components, files, candidates).unionByName(fallback_hits(components, files, candidates)).select(*HITS)
    some = candidates.groupBy("project", "component").agg(F.max("preferred").alias("has_preferred"))
    phrases = F.filter(F.array_distinct("lowered"), lambda x: x != "")
    rows = known.join(some.hint("merge"), ["project", "component"], "left").withColumns({"stems": F.transform("names", lambda x: F.lower(x)), "phrases": phrases})
    found = [r.asDict() for r in rows.collect()]
    # What made components and names was shuffled once; its files go when the driver no longer holds the plans.
    gc.collect()
    files.sparkSession.sparkContext._jvm.System.gc()
    return _search(files, found, claims)


def with_ties(scored: DataFrame) -> DataFrame:
    """scored (item, file, score, preferred) with `tied`: before any claim, an item's best score is that of several
    files, and the item has no preferred file."""
    best = W.partitionBy("item")
    top = scored.withColumn("top", F.max("score").over(best) == F.col("score"))
    files = F.size(F.collect_set(F.when(F.col("top"), F.col("file"))).over(best))
    preferred = F.max(F.when(F.col("preferred"), 1).otherwise(0)).over(best)
    return top.withColumn("tied", (files > 1) & (preferred == 0)).drop("top")


def claim(items: list[tuple], candidates: dict) -> list[tuple]:
    """Of items in order, with candidates[item] = [(score, file, place, occurrence, evidence, preferred, fallback)], one
    row each as in MATCH. preferred says that the item has a preferred file, whichever the candidate's is.

    An item takes, of the occurrences that nobody has claimed, the best one, then the first by file and place. It is
    ambiguous, and claims nothing, if that score is held by occurrences of several files and the item has no preferred
    file at all. Fallback candidates count only where no other is free. An item without candidates is not found."""
    claimed, out = set(), []
    for item in items:
        every = candidates.get(item, [])
        preferred = any(c[5] for c in every)
        for fallback in (False, True):
            free = sorted((c for c in every if c[6] == fallback and c[3] not in claimed), key=lambda c: (-c[0], c[1], c[2]))
            if free:
                break
        if not free:
            out.append((item, None, None, "NOT_FOUND", 0.0))
            continue
        score, _, _, occurrence, evidence = free[0][:5]
        if not preferred and len({c[1] for c in free if c[0] == score}) > 1:
            out.append((item, None, score, "AMBIGUOUS", AMBIGUOUS))
            continue
        claimed.add(occurrence)
        out.append((item, occurrence, score, "MATCHED", FALLBACK if fallback else SEVERAL if evidence > 1 else SINGLE))
    return out


def greedy(items: DataFrame, scored: DataFrame, project: str, keyed: bool = False) -> DataFrame:
    """items (project, item), scored (project, item, occurrence, file, score, evidence, preferred, fallback) -> MATCH, a row
    for each item, with its project if keyed. Later claims depend on earlier ones, so a project is one task's group."""
    kind = items.schema[project].dataType.simpleString()

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        held: dict = {}
        for r in right.itertuples():
            held.setdefault(r.item, []).append((int(r.score), r.file, int(r.occurrence), int(r.occurrence), int(r.evidence), bool(r.preferred), bool(r.fallback)))
        frame = pd.DataFrame(claim(sorted(set(left["item"].tolist())), held), columns=["item", "occurrence", "score", "status", "confidence"])
        if keyed:
            frame.insert(0, project, key[0])
        return frame.astype({"occurrence": "Int64", "score": "Int64"})

    # Named anew, as the two may stem from one table.
    left, right = (df.select(*(F.col(c).alias(c) for c in df.columns)) for df in (items, scored))
    return left.groupBy(project).cogroup(right.groupBy(project)).applyInPandas(run, f"{project} {kind}, {MATCH}" if keyed else MATCH)
