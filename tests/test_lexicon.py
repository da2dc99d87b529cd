"""A lexicon as a table, and rules over it, against plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sparkweir.operators import lexicon
from sparkweir.operators.lexicon import Rule

LEXICON = "group string, phrase string"


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower().replace("ё", "е"))


def counted(text, phrases):
    """Hits by (group, phrase, open), with the first place."""
    out, w = {}, words(text)
    for group, phrase in phrases:
        p, is_open = words(phrase), (phrase or "").rstrip().endswith("*")
        at = [i for i in range(len(w) - len(p) + 1) if p and w[i : i + len(p) - 1] == p[:-1] and (w[i + len(p) - 1].startswith(p[-1]) if is_open else w[i + len(p) - 1] == p[-1])]
        if at:
            out[group, " ".join(p), len(p[-1]) if is_open else 0] = (len(at), at[0])
    return out


def sample(seed, phrases):
    rnd = random.Random(seed)
    stems = ["".join(rnd.choice("abcdeёё1") for _ in range(rnd.randint(2, 5))) for _ in range(60)]
    lex = [(rnd.choice(["g1", "g2", "g3"]), " ".join(rnd.choice(stems) for _ in range(rnd.randint(1, 4))) + rnd.choice(["", "", "*"])) for _ in range(phrases)]
    lex += [("g1", None), ("g1", ""), ("g1", "--"), ("g4", stems[0]), ("g4", stems[0].upper()), ("g5", stems[0])]
    texts = [rnd.choice([" ", "-", ", ", "\n"]).join(rnd.choice(stems) + rnd.choice(["", "x", "S"]) for _ in range(rnd.randint(0, 120))) for _ in range(80)] + [None, "", "...", stems[0]]
    return lex, texts


@pytest.mark.parametrize("phrases", [3, 2000])
def test_hits_equal_a_plain_search(spark, phrases):
    lex, texts = sample(phrases, phrases)
    df = spark.createDataFrame([*enumerate(texts), (None, texts[0])], "id int, t string").withColumn("w", F.lit("w")).withColumn("k", F.lit("k"))
    got = {}
    for r in lexicon.hits(df, spark.createDataFrame(lex, LEXICON), "id", "t").collect():
        got.setdefault(r.id, {})[r.group, r.phrase, r.open] = (r.n, r.first)
    assert got == {i: found for i, t in enumerate(texts) if (found := counted(t, lex))}


RULES = [
    Rule("noise", any=("noise",), unless=("core",)),
    Rule("strong", any=("goods",), all=("delivery",), least=2),
    Rule("titled", title=("goods",)),
    Rule("weak", any=("goods",)),
    Rule("any",),
]


@pytest.mark.parametrize(
    "title, text, decision, signals",
    [
        (None, None, "any", []),
        ("", "", "any", []),
        ("goods", None, "titled", []),
        ("Goods", "noise here", "noise", ["noise"]),
        ("x", "noise of the core goods", "weak", ["core", "goods", "noise"]),
        ("x", "goods, delivery", "weak", ["delivery", "goods"]),
        ("x", "goods and goods, delivered soon", "strong", ["delivery", "goods"]),
        ("goods", "goods and goods, noise, delivered soon", "noise", ["delivery", "goods", "noise"]),
        ("x", "goodsy", "any", []),
        ("x", "good s", "any", []),
    ],
)
def test_the_first_rule_wins_unless_it_is_overridden(spark, title, text, decision, signals):
    lex = spark.createDataFrame([("noise", "noise"), ("core", "core"), ("goods", "goods"), ("delivery", "deliver*")], LEXICON)
    df = spark.createDataFrame([(1, title, text, "d"), (None, title, text, "d")], "id int, title string, text string, groups string")
    got = {r.id: r for r in lexicon.decide(df, lex, "id", "title", "text", RULES, "none").collect()}
    assert (got[1].decision, got[1].signals, got[1].groups) == (decision, signals, "d")
    assert got[None].decision == "any" and got[None].signals == []


def test_empty_lexicons_and_tables(spark):
    df = spark.createDataFrame([(1, "a", "b")], "id int, title string, text string")
    none = spark.createDataFrame([], LEXICON)
    assert [r.decision for r in lexicon.decide(df, none, "id", "title", "text", [Rule("x", any=("g",))], "none").collect()] == ["none"]
    assert lexicon.decide(df.limit(0), spark.createDataFrame([("g", "a")], LEXICON), "id", "title", "text", [], "none").count() == 0
