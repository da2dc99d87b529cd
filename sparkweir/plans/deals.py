"""Predicates over deals, with documents as deals: the first 120 characters are the title."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import deals
from .registry import query, table

#: The groups of words of the queries: our own, in the languages of the documents.
GROUPS = {
    "goods": ["the ", "der "], "supply": ["to ", "für "], "generic": ["and ", "que "], "works": ["ing ", "ung "], "service": ["!!", "***"], "vertical": [" | ", "###"],
    "building": ["that ", "nicht "], "site": ["with ", "auf "], "systems": ["from ", "von "], "maker": ["@", "http"], "ban": ["not ", "ein "], "lifted": ["or ", "zu "], "extension": ["for ", "para "], "no_equivalent": ["licen", "$$$"],
}
MODEL = "[a-z]{2,}-?[0-9]{3,}"


def _has(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _count(words: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains(b, '{w}') AS INTEGER)" for w in words) + ")"


#: SQL: t_group and b_group for each group, and the predicates one upon the other.
_SQL = f"""WITH d AS (SELECT doc_id, n_chars, lower(substr(text, 1, 120)) AS t, lower(substr(text, 1, 120) || ' ' || text) AS b FROM documents),
f AS (SELECT doc_id, n_chars, {", ".join(f"{_has('t', w)} AS t_{g}, {_has('b', w)} AS b_{g}" for g, w in GROUPS.items())}, {_count(GROUPS["goods"])} AS n_goods, {_count(GROUPS["maker"])} AS n_makers, regexp_matches(b, '{MODEL}') AS model FROM d),
g AS (SELECT *, b_vertical AND NOT t_goods AS excluded, t_works AND b_goods AND NOT t_service AS infra,
    NOT (t_supply AND t_goods) AND ((t_building AND (t_site OR b_systems)) OR (t_site AND (b_building OR b_systems))) AND (b_works OR b_systems) AS outside FROM f),
h AS (SELECT *, NOT (outside OR excluded OR (t_service AND NOT t_goods)) AND t_supply AND b_goods AS intent, CASE WHEN t_supply AND t_goods THEN FALSE WHEN infra THEN FALSE ELSE t_service END AS noise FROM g),
k AS (SELECT *, intent OR (t_goods AND NOT (noise OR excluded OR outside)) AS wanted, b_ban AND NOT b_lifted AS banned, b_extension AND b_maker AND NOT (t_supply AND NOT t_extension) AS more,
    CAST(n_makers = 1 AS INTEGER) + CAST(model AS INTEGER) + CAST(b_no_equivalent AS INTEGER) >= 2 AS tailor FROM h) """


def _deals(spark, sf_dir):
    title, text = F.substring("text", 1, 120), F.col("text")
    body = F.lower(F.concat_ws(" ", title, text))
    count = lambda words: sum((F.contains(F.col("b"), F.lit(w)).cast("int") for w in words[1:]), F.contains(F.col("b"), F.lit(words[0])).cast("int"))
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", deals.flags(title, text, GROUPS).alias("deal"), body.alias("b"))
    return d.select("doc_id", "n_chars", "deal", count(GROUPS["goods"]).alias("n_goods"), count(GROUPS["maker"]).alias("n_makers"), F.col("b").rlike(MODEL).alias("model"))


_DEAL = deals.Deal("deal")
_PREDICATES = {
    "excluded_vertical": ("K03", "excluded", lambda: deals.excluded_vertical(_DEAL)),
    "full_deal": ("K04", "b_goods AND COALESCE(NULLIF(n_chars, 0) >= 1500, t_supply)", lambda: deals.full_deal(_DEAL, F.nullif("n_chars", F.lit(0)), F.lit(1500))),
    "generic_guard": ("K05", "NOT (t_generic AND NOT t_goods) OR n_goods >= 2", lambda: deals.generic_guard(_DEAL, F.col("n_goods"))),
    "infra_project": ("K06", "infra", lambda: deals.infra_project(_DEAL)),
    "service_noise": ("K07", "noise", lambda: deals.service_noise(_DEAL)),
    "target_goods": ("K08", "wanted", lambda: deals.target(_DEAL)),
    "exact_goods": ("K09", "wanted AND (b_maker OR model)", lambda: deals.exact(_DEAL, F.col("model"))),
    "domestic_restriction": ("K10", "banned", lambda: deals.domestic_restriction(_DEAL)),
    "incumbent_extension": ("K11", "more", lambda: deals.incumbent_extension(_DEAL)),
    "non_core": ("K12", "outside", lambda: deals.non_core(_DEAL)),
    "tailored": ("K13", "tailor", lambda: deals.tailored(_DEAL, F.col("model"), F.col("n_makers"))),
}


def _register(name: str, row: str, sql: str, predicate) -> None:
    def run(spark, sf_dir):
        return _deals(spark, sf_dir).select("doc_id", predicate().alias("holds"))

    run.__name__ = f"k_{name}"
    query(row, f"{_SQL} SELECT doc_id, {sql} AS holds FROM k")(run)


for _name, (_row, _sql, _predicate) in _PREDICATES.items():
    _register(_name, _row, _sql, _predicate)


@query(
    "K16",
    _SQL + """SELECT doc_id, concat_ws(',', CASE WHEN banned THEN 'restricted' END, CASE WHEN tailor THEN 'tailored' END, CASE WHEN more THEN 'incumbent' END, CASE WHEN noise THEN 'service' END, CASE WHEN outside THEN 'not_core' END,
    CASE WHEN n_chars <= 200 THEN 'price_unknown' END, CASE WHEN doc_id % 9 = 8 THEN 'deadline_unknown' END, CASE WHEN doc_id % 9 <= 2 THEN 'deadline_near' END) AS warnings FROM k""",
)
def k_selection_warnings(spark, sf_dir):
    price = F.when(F.col("n_chars") > 200, F.col("n_chars"))
    days = F.when(F.col("doc_id") % 9 != 8, F.col("doc_id") % 9)
    found = deals.warnings(_DEAL, F.col("model"), F.col("n_makers"), price, days)
    return _deals(spark, sf_dir).select("doc_id", F.array_join(found, ",").alias("warnings"))
