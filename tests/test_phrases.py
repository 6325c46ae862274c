"""Phrase search against one alternation pattern, whatever the number of automata."""

import random
import re

import pytest

from loomspark.operators import phrases as P

SCHEMA = "id long, text string, phrase int, position string"


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(1)
    made = [(i, "".join(rng.choice("abc é.") for _ in range(rng.randint(0, 60)))) for i in range(80)]
    rows = [*made, made[3], made[3], (made[3][0], "abab"), (None, "abcab"), (None, "abcab"), (500, None), (501, "")]
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).cache()


@pytest.fixture(scope="module")
def phrases(spark):
    rng = random.Random(2)
    made = {"".join(rng.choice("abc é.") for _ in range(rng.randint(1, 6))) for _ in range(60)} | {"a", "ab", "abc", "bca", "c é"}
    return spark.createDataFrame([(p,) for p in [*sorted(made), "ab", "", None]], "phrase string").cache()


def alternation(phrases):
    listed = sorted({r["phrase"] for r in phrases.collect() if r["phrase"]}, key=lambda x: (-len(x), x))
    return listed, re.compile("|".join(map(re.escape, listed)))


@pytest.mark.parametrize("limit", [1 << 20, 150, 40, 1])
def test_longest_equals_one_pattern(texts, phrases, limit):
    _, pattern = alternation(phrases)
    want = [(r["id"], m.start() + 1, m.group()) for r in texts.collect() for m in pattern.finditer(r["text"] or "")]
    got = P.longest_matches(texts, phrases, ["id"], limit).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("limit", [1 << 20, 60])
def test_first_equals_find(texts, phrases, limit):
    listed, _ = alternation(phrases)
    want = [(r["id"], r["text"].find(p) + 1, p) for r in texts.collect() if r["text"] for p in listed if p in r["text"]]
    got = P.first_matches(texts, phrases, ["id"], limit).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_nothing_to_find(texts, phrases):
    for none in (phrases.limit(0), phrases.where("phrase is null or phrase = ''")):
        assert P.longest_matches(texts, none, ["id"]).collect() == [] and P.first_matches(texts, none, ["id"]).collect() == []
    assert P.longest_matches(texts.limit(0), phrases, ["id"]).collect() == []
