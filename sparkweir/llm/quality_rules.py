"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each rule compares one measure of a text with a cut-off. A setting is a set of
rules at one step of strictness. Labelled holdout rows choose the setting, per
stratum: it is certified if, with the exact binomial tail, so few good rows
would be rejected by any of its rules that a false-rejection rate above the
limit is implausible; the level is divided by the number of tests (all strata
and settings), so that with the stated confidence the rules of every stratum
keep the limit together. Of the certified settings the one that rejects most
rows is taken, in a tie the one with fewer good rows among them, then the
first; without one nothing is rejected in that stratum by rules.

Texts: null and empty ones have no words; whole texts are measured, however
long. Rows whose stratum is null form a stratum of their own; strata without
labels have no cut-offs. Labels other than 0 and 1 and labels of unknown ids
are ignored. Rows come one to one, repeated ids included, each of which counts
where its id is labelled good. Empty tables give an empty result, or one by
the base rules alone. Only the named columns are read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_BREAK, stored, unused

#: Fixed value: characters that count as symbols.
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
#: SQL: hash of the window that ends in the word c, at i of a text's words.
HASH = "xxhash64(words[i], words[i + 1], c)"

#: Measures that are too high in bad texts, with their candidate cut-offs from strict to lax: rows above are rejected.
RULES: dict[str, tuple[float, ...]] = {
    "symbols_per_char": (0.005, 0.01, 0.02, 0.05, 0.1, 0.2),
    "dup_line_share": (0.05, 0.1, 0.2, 0.3, 0.5, 0.8),
    "repeat_share": (0.05, 0.1, 0.15, 0.2, 0.3, 0.4),
    "chars_per_word": (8.0, 9.0, 10.0, 12.0, 15.0, 20.0),
}
STEPS = 6
#: Every set of rules at every step.
SETTINGS = tuple((rules, step) for n in range(len(RULES), 0, -1) for rules in combinations(RULES, n) for step in range(STEPS))
#: Limit of the false-rejection rate of all rules together in a stratum, and the level of all tests together.
LIMIT, LEVEL = 0.02, 0.05


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{WORD_BREAK}+"), lambda w: w != "")


def _with(value: str, name: str, body: str) -> str:
    """SQL: body, where name stands for the value, which is computed once, wherever the optimizer moves the expression to."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _same(v: str, k: str) -> str:
    """SQL: the window w has the same words as the one at k of v."""
    return "(" + " and ".join(f"words[w.i + {d}] = words[get({v}, {k}).i + {d}]" for d in range(3)) + ")"


def _n_repeat_words() -> str:
    """SQL: the number of words in windows that occur again, from the array words.

    The places of repeated windows are found by sorting the windows by hash
    and place and comparing the words of neighbours. Should two kinds of
    windows share a hash, they are sorted by their words as well.
    """
    every = f"""sort_array(transform(if(size(words) > 2, slice(words, 3, size(words) - 2), cast(array() as array<string>)),
        (c, i) -> named_struct('h', {HASH}, 'i', i)))"""
    again = "filter(every, (w, k) -> w.h <=> get(every, k - 1).h or w.h <=> get(every, k + 1).h)"
    by_words = f"""if(exists(transform(again, (w, k) -> w.h <=> get(again, k - 1).h and not {_same("again", "k - 1")}), x -> x),
        transform(sort_array(transform(again, w -> named_struct('h', w.h, 'a', words[w.i], 'b', words[w.i + 1], 'c', words[w.i + 2], 'i', w.i))), w -> named_struct('h', w.h, 'i', w.i)),
        again)"""
    places = f"""sort_array(transform(filter(sorted, (w, k) ->
        (w.h <=> get(sorted, k - 1).h and {_same("sorted", "k - 1")}) or (w.h <=> get(sorted, k + 1).h and {_same("sorted", "k + 1")})), w -> w.i))"""
    covered = "aggregate(places, named_struct('n', 0L, 'end', 0), (s, i) -> named_struct('n', s.n + (i + 3 - greatest(i, s.end)), 'end', i + 3)).n"
    return _with(every, "every", _with(again, "again", _with(by_words, "sorted", _with(places, "places", covered))))


def measures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, *more), all within a text's row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    (name,) = unused(df, "_words")
    df = df.select(
        F.col(id_col),
        *more,
        words(F.col(text_col)).alias(name),
        F.length(F.translate(text, WHITE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
    )
    repeated = F.expr(_with(f"`{name}`", "words", _n_repeat_words()))
    return df.select(F.col(id_col), *more, F.size(name).cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", repeated.cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rates() -> dict[str, Column]:
    """The rules' measures, from the counts."""
    share = lambda a, b: F.when(b > 0, a / F.greatest(b, F.lit(1))).otherwise(0.0)
    n = F.col("n_words")
    return {
        "symbols_per_char": share(F.col("n_symbols"), F.col("word_chars")),
        "dup_line_share": share(10 * F.col("n_dup_lines"), n),
        "repeat_share": share(F.col("n_repeat_words"), n),
        "chars_per_word": share(F.col("word_chars"), n),
    }


def _ln_factorial(m: Column) -> Column:
    """Exact below 20, above by Stirling's series, whose error there is under 1e-12."""
    m = m.cast("double")
    series = m * F.log(m) - m + 0.5 * F.log(2 * F.pi() * m) + 1 / (12 * m) - 1 / (360 * m**3) + 1 / (1260 * m**5)
    exact = F.aggregate(F.sequence(F.lit(1), F.least(m, F.lit(20.0)).cast("int")), F.lit(0.0), lambda s, i: s + F.log(i.cast("double")))
    return F.when(m < 1, F.lit(0.0)).when(m < 20, exact).otherwise(series)


def _tail(n: Column, k: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), by the ratio of successive terms from k downwards.

    The largest term is at k while k < n p, where alone the tail can be small;
    terms further than twelve standard deviations below it are too small to
    show in a double.
    """
    first = F.exp(_ln_factorial(n) - _ln_factorial(k) - _ln_factorial(n - k) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p)))
    last = F.greatest(F.lit(1), k - F.ceil(12 * F.sqrt(n * p * (1 - p))) - 40).cast("long")
    down = F.when(k > 0, F.sequence(k, F.least(last, F.greatest(k, F.lit(1))), F.lit(-1).cast("long")))
    start = F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("term"))

    def add(state, i):
        term = state["term"] * i / (n - i + 1) * ((1 - p) / p)
        return F.struct((state["sum"] + term).alias("sum"), term.alias("term"))

    series = F.coalesce(F.aggregate(down, start, add)["sum"], F.lit(1.0))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(first * series)


def certify(measured: DataFrame, labels: DataFrame, id_col: str, stratum_col: str, label_col: str = "quality", limit: float = LIMIT, level: float = LEVEL) -> DataFrame:
    """(_stratum, cutoffs): a map from each rule of the chosen setting to its cut-off.

    Rows that the base rules keep are counted by the step at which each rule
    begins to reject them, so that settings are looked at in that small table.
    """
    good = labels.where(F.col(label_col) == 1).select(F.col(id_col).alias("_good")).distinct()
    kept = measured.where(~base_failed()).select(F.col(id_col).alias("_id"), F.col(stratum_col).alias("_stratum"), *[_first_step(rate, RULES[rule]).alias(rule) for rule, rate in rates().items()])
    marked = kept.join(good, F.col("_id") == F.col("_good"), "left")
    counts = marked.groupBy("_stratum", *RULES).agg(F.count("*").alias("n"), F.count("_good").alias("good"))
    sizes = counts.groupBy("_stratum").agg(F.sum("good").alias("size")).where("size > 0")
    tests = sizes.agg((F.count("*") * len(SETTINGS)).alias("_tests"))
    reached = F.array(*[F.struct(F.lit(i).alias("setting"), F.exists(F.array(*rules), lambda s: s >= step).alias("rejects")) for i, (rules, step) in enumerate(SETTINGS)])
    each = counts.select("_stratum", "n", "good", F.inline(reached)).groupBy("_stratum", "setting").agg(F.sum(F.when(F.col("rejects"), F.col("n")).otherwise(0)).alias("rejected"), F.sum(F.when(F.col("rejects"), F.col("good")).otherwise(0)).alias("k"))
    known = sizes.select(F.col("_stratum").alias("_of"), "size")
    tried = each.where("rejected > 0").join(known, F.col("_stratum").eqNullSafe(F.col("_of"))).join(F.broadcast(tests))
    certified = tried.where(_tail(F.col("size"), F.col("k"), limit) <= level / F.col("_tests"))
    best = certified.groupBy("_stratum").agg(F.max_by("setting", F.struct("rejected", -F.col("k"), -F.col("setting"))).alias("setting"))
    maps = [F.create_map(*[F.lit(x) for rule in rules for x in (rule, RULES[rule][step])]) for rules, step in SETTINGS]
    return best.select("_stratum", F.element_at(F.array(*maps), F.col("setting") + 1).alias("cutoffs"))


def _first_step(rate: Column, cuts: tuple[float, ...]) -> Column:
    """The laxest step, counted from the strictest, whose cut-off the rate exceeds, or -1."""
    out = F.lit(-1)
    for step, cut in enumerate(cuts):
        out = F.when(rate > cut, F.lit(step)).otherwise(out)
    return out


def apply(df: DataFrame, labels: DataFrame, stratum_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measures with base_failed, kept and rejected_by (the rules that reject)."""
    measured = stored(measures(df, id_col, text_col, stratum_col))
    # A row per stratum; stored, so that its size is known and Spark broadcasts it only where it is small.
    cutoffs = stored(certify(measured, labels, id_col, stratum_col))
    joined = measured.join(cutoffs, measured[stratum_col].eqNullSafe(cutoffs["_stratum"]), "left")
    rejected = F.filter(F.array(*[F.when(rate > F.coalesce(F.try_element_at("cutoffs", F.lit(rule)), F.lit(float("inf"))), F.lit(rule)) for rule, rate in rates().items()]), lambda r: r.isNotNull())
    return joined.select(*measured.columns, base_failed().alias("base_failed"), rejected.alias("rejected_by")).withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))
