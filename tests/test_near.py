"""Near texts against a loop over all pairs, with the matching of the standard library."""

import difflib
import random

import pytest

from sparkweir.operators import near


def alike(a, b):
    x, y = sorted((" ".join((t or "").lower().split()) for t in (a, b)), key=lambda t: (len(t), t))
    if x == y or len(x) >= 24 and x in y:
        return True
    return bool(x) and difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() >= 0.86


def texts(seed, n):
    rnd = random.Random(seed)
    base = ["no unit price is given for item", "the term of delivery is missing", "warranty period", "Цена не указана", "ab", "abc", "x"]
    out = [None, "", "  ", "a", "A ", "ab", "abcdef", "abcdeg", "abcdefg", "aaaaaaa", "aaaaaaaa", "aaaaaaba"]
    for _ in range(n):
        t = list(rnd.choice(base) + rnd.choice(["", " of the table", " 12", " number " + str(rnd.randrange(40))]))
        for _ in range(rnd.choice([0, 1, 2, 4, 8])):
            i = rnd.randrange(len(t) + 1)
            t[i : i + rnd.randint(0, 1)] = rnd.choice(["", "q", " ", "É"])
        out.append(("".join(t), "".join(t).upper())[rnd.random() < 0.2])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_lists_without_near_texts(spark, seed):
    rnd = random.Random(seed)
    groups = {g: rnd.sample(every := texts(seed, 70), len(every)) for g in (1, 2, None)}
    rows = [(g, p, t, "x", "y") for g, some in groups.items() for p, t in enumerate(some)]
    got = {(r.g, r.at): (r.kept, r.near) for r in near.without_near(spark.createDataFrame(rows, "g int, at int, text string, k string, grams string").repartition(3), "g", "at", "text").collect()}
    assert len(got) == len(rows)
    for g, some in groups.items():
        kept = []
        for p, t in enumerate(some):
            close = [o for o in range(p) if alike(some[o], t)]
            stays = not any(o in kept for o in close)
            kept += [p] * stays
            assert got[g, p][0] == stays, (g, p, t)
            firsts = {o for o in close if not any(" ".join((some[o] or "").lower().split()) == " ".join((some[b] or "").lower().split()) for b in range(o))}
            assert firsts <= set(got[g, p][1]) <= set(close)


def test_matching_is_that_of_blocks():
    rnd = random.Random(4)
    for _ in range(300):
        a, b = ("".join(rnd.choice("abcdé ") for _ in range(rnd.randint(0, 40))) for _ in range(2))
        assert near.matching(a, b) == sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())


def test_near_texts_of_no_rows(spark):
    assert near.without_near(spark.createDataFrame([], "g int, at int, text string"), "g", "at", "text").count() == 0
