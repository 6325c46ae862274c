"""Candidate files, scores, fallback and claims against a plain version that goes item by item, as the survey states it."""

import contextlib
import io
import random
import re

import pytest
from pyspark.sql import functions as F

from loomspark.operators import matching as M

WORDS = ["Card", "card", "Grid", "View", "grid view", "open", "Ünit", "x.y"]
COMPONENTS = "project string, component string, source_name string, symbols array<string>, tags array<string>, texts array<string>, hints array<string>"


def plan(rows):
    held = io.StringIO()
    with contextlib.redirect_stdout(held):
        rows.explain()
    return held.getvalue()


def make(seed):
    rng = random.Random(seed)
    pick = lambda n: [rng.choice(WORDS) for _ in range(rng.randint(0, n))]
    files = []
    for project in "pq":
        for i in range(7):
            piece = lambda: rng.choice([f"<{rng.choice(WORDS)} ", f"const {rng.choice(WORDS)} = 1\n", "let const View;", f"function  {rng.choice(WORDS)}(", rng.choice(WORDS), "\n", "</Card>", "x" * rng.randint(0, 400)])
            files.append((project, f"src/{rng.choice('ab')}{i}/{rng.choice(['Card', 'GRID', 'other', 'View.test'])}.tsx", "".join(piece() for _ in range(rng.randint(0, 40)))))
    files.append(("p", "empty.ts", None))
    components = []
    for project in "pqr":
        for i in range(14):
            hints = [rng.choice(files)[1] if rng.random() < 0.5 else "gone.tsx" for _ in range(rng.randint(0, 2))]
            components.append((project, f"c{i:02d}", rng.choice([None, "", *WORDS]), pick(2) if rng.random() < 0.9 else None, pick(2), pick(2), hints))
    return components, files


def plain(component, files):
    """(has_preferred, hits) of a component; hits as (kind, file, symbol, position, line, score, evidence, preferred)."""
    project, _, source, symbols, tags, texts, hints = component
    files = {f: c or "" for p, f, c in files if p == project}
    names = [n for n in dict.fromkeys([source, *(symbols or [])]) if n]
    preferred = {h for h in hints if h in files}
    stems = {f for f in files if f.rsplit("/", 1)[-1].rsplit(".", 1)[0].lower() in {n.lower() for n in names}}
    where = preferred | stems if preferred else stems or (set(files) if names else set())
    out = []
    for f in where:
        text, own = files[f], f in preferred
        line = lambda at: text.count("\n", 0, at) + 1  # noqa: B023, E731
        for m in re.finditer(r"<([A-Z][A-Za-z0-9_.]*)\b", text):
            if m[1] in tags:
                near = text[max(0, m.start() - 300) : m.start() + 500].lower()
                named, said = bool(source) and source.lower() in near, sum(t.lower() in near for t in texts)
                out.append(("tag", f, m[1], m.start(), line(m.start()), 10 + 5 * own + 8 * named + 3 * said, 1 + own + named + said, own))
        for n in names:
            if m := re.search(rf"\b(?:function|class|const|let|var)\s+{re.escape(n)}\b", text):
                out.append(("symbol", f, n, m.start(), line(m.start()), 12 + 5 * own, 1, own))
        for t in dict.fromkeys(texts):
            if (at := text.lower().find(t.lower())) >= 0:
                out.append(("text", f, t, at, line(at), 5 + 5 * own, 1, own))
    return bool(preferred), out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_hits(spark, seed):
    components, files = make(seed)
    # The index has whole words only, so a name with a point in it is found as a text but not as a declaration.
    want = [(c[0], c[1], *h, has) for c in components for has, hits in [plain(c, files)] for h in hits if not (h[0] == "symbol" and not re.fullmatch(r"\w+", h[2]))]
    got = M.hits(spark.createDataFrame(components, COMPONENTS), spark.createDataFrame(files, "project string, file string, content string"))
    assert got.columns == M.HITS
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert {w[2] for w in want} == {"tag", "symbol", "text"} and any(w[-1] for w in want)
    none = spark.createDataFrame([], COMPONENTS)
    assert M.hits(none, spark.createDataFrame(files, "project string, file string, content string")).count() == 0


def plain_claims(components, found):
    """Item by item: a free tag, else a free declaration or text; the best, unless several files share its score."""
    taken, out = set(), {}
    for c in sorted(components, key=lambda c: (c[0], c[1])):
        has, hits = found[c[0], c[1]]
        result = ("NOT_FOUND", None, 0.0)
        for tags in (True, False):
            free = [h for h in hits if (h[0] == "tag") == tags and (c[0], h[1], h[3]) not in taken]
            if not free:
                continue
            top = max(h[5] for h in free)
            best = sorted((h for h in free if h[5] == top), key=lambda h: (h[1], h[3]))
            if len({h[1] for h in best}) > 1 and not has:
                result = ("AMBIGUOUS", None, 0.4)
            else:
                taken.add((c[0], best[0][1], best[0][3]))
                # Of equal places the one with most evidence is the same place; only tags have more than one.
                result = ("MATCHED", (best[0][1], best[0][3]), 0.7 if not tags else 0.95 if best[0][6] > 1 else 0.75)
            break
        out[c[0], c[1]] = result
    return out


@pytest.mark.parametrize("seed", [4, 5])
def test_claims_of_hits(spark, seed):
    components, files = make(seed)
    word = lambda x: bool(re.fullmatch(r"\w+", x or ""))
    components = [(*c[:2], c[2] if word(c[2]) else None, [s for s in c[3] or [] if word(s)], *c[4:]) for c in components]
    found = {(c[0], c[1]): plain(c, files) for c in components}
    number = {f: i for i, f in enumerate(sorted({f for _, f, _ in files}))}
    place = F.create_map(*(F.lit(x) for pair in number.items() for x in pair))[F.col("file")].cast("long") * (1 << 32) + F.col("position")
    hits = M.hits(spark.createDataFrame(components, COMPONENTS), spark.createDataFrame(files, "project string, file string, content string"))
    item = F.substring("component", 2, 9).cast("long")
    rows = hits.select("project", item.alias("item"), place.alias("occurrence"), "file", "score", "evidence", F.col("has_preferred").alias("preferred"), (F.col("kind") != "tag").alias("fallback"))
    items = spark.createDataFrame([(c[0], int(c[1][1:])) for c in components], "project string, item long")
    got = {(r["project"], f"c{r['item']:02d}"): (r["status"], r["occurrence"], r["confidence"]) for r in M.greedy(items, rows, "project", keyed=True).collect()}
    want = plain_claims(components, found)
    assert got == {k: (s, None if at is None else number[at[0]] * (1 << 32) + at[1], c) for k, (s, at, c) in want.items()}
    assert {s for s, _, _ in want.values()} == {"MATCHED", "AMBIGUOUS", "NOT_FOUND"}


def test_claims_need_few_hits():
    rng, kinds = random.Random(7), ["tag", "tag", "text"]
    for _ in range(300):
        # A place has one file; components share places or not.
        places = [(f"f{rng.randint(0, 3)}", i) for i in range(rng.randint(1, 12))]
        found = list({(c, *rng.choice(places), rng.choice(kinds), rng.randint(1, 2)) for c in "abcd" for _ in range(rng.randint(0, 6))})
        has = {c: rng.random() < 0.3 for c in "abcd"}
        hits = [("p", c, kind, file, "s", at, 1, score, 1, False, has[c]) for c, file, at, kind, score in found]
        marked = [h for f in {h[3] for h in hits} for h in M._marked([x for x in hits if x[3] == f])]
        half = len(marked) // 2
        few = M._contending(M._contending(marked[:half]) + marked[half:])
        assert len(few) <= len(marked)
        claims = []
        for rows in (marked, few):
            held = {}
            for h in rows:
                held.setdefault(h[1], []).append((h[7], h[3], h[5], (h[3], h[5]), h[8], h[10], h[2] != "tag"))
            claims.append(M.claim(list("abcd"), held))
        assert claims[0] == claims[1]
    alone = [("p", "a", "tag", f"f{i:03d}", "s", i, 1, 13, 1, False, False, False) for i in range(500)]
    assert M._contending(alone) == [alone[0], alone[-1]]


@pytest.mark.parametrize("seed", [1, 6])
def test_held_components_give_the_joined_hits(spark, seed):
    components, files = make(seed)
    there = spark.createDataFrame(files, "project string, file string, content string")
    held, joined = (M.hits(spark.createDataFrame(components, COMPONENTS), there, limit=limit) for limit in (1 << 20, 0))
    assert sorted(map(tuple, held.collect()), key=repr) == sorted(map(tuple, joined.collect()), key=repr)
    assert "Join" in plan(joined) and "Join" not in plan(held) and "Exchange" not in plan(held)


def test_lines_around_a_tag_are_not_shuffled(spark):
    from loomspark.queries.matching import component_candidates

    # Lines are dealt by their parts and by their suppliers, parts and suppliers once each.
    assert plan(component_candidates(spark, "/root/testdata/sf0.001")).count("Exchange") == 4


@pytest.mark.parametrize("seed", [4, 8])
def test_few_hits_give_the_same_claims(spark, seed):
    components, files = make(seed)
    components = [(*c[:2], c[2] or "", *c[3:]) for c in components]
    code = spark.createDataFrame([(p, f, c * 3 if c else c) for p, f, c in files], "project string, file string, content string")
    items = spark.createDataFrame([(c[0], int(c[1][1:])) for c in components], "project string, item long")
    got = []
    for claims in (False, True):
        hits = M.hits(spark.createDataFrame(components, COMPONENTS), code, claims=claims)
        place = F.pmod(F.xxhash64("file"), F.lit(1 << 30)) * (1 << 16) + F.col("position")
        rows = hits.select("project", F.substring("component", 2, 9).cast("long").alias("item"), place.alias("occurrence"), "file", "score", "evidence", F.col("has_preferred").alias("preferred"), (F.col("kind") != "tag").alias("fallback"))
        got.append((hits.count(), sorted(map(tuple, M.greedy(items, rows, "project", keyed=True).collect()), key=repr)))
    assert got[0][1] == got[1][1] and got[1][0] < got[0][0]
