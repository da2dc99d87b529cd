"""Exact top-k, importance resampling and the filter audit against plain loops, with nulls, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkweir.llm import exact_topk, filter_audit, importance_resampling
from sparkweir.llm.oracle import ORACLE_SQL
from sparkweir.llm.queries import QUERIES

# --- exact top-k


def best_of(rows, k=5, scale=256):
    """rows: (id, vector). For each query, its rows of (id, rank, other, score)."""
    usable = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, q) in enumerate(usable):
        if i is None or i % 50:
            continue
        others = [(-max(-exact_topk.LONG, min(exact_topk.LONG, sum(a * b for a, b in zip(q, c)))), j is None, j or 0, j) for n, (j, c) in enumerate(usable) if n != at and len(c) == len(q)]
        out += [(i, rank, j, -score) for rank, (score, _, _, j) in enumerate(sorted(others, key=lambda x: x[:3])[:k], 1)]
    return out


def plain(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


VECTORS = "vec_id long, embedding array<float>, n int, block string, score string, rank string, id string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 7, "b", "s", "r", "i") for i, v in rows], VECTORS)


def searched(spark, rows, **settings):
    found = exact_topk.search(vectors(spark, rows).repartition(3), F.col("vec_id") % 50 == 0, **settings)
    assert found.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    return plain(tuple(r) for r in found.collect())


def sample_vectors(seed=3, n=700, dims=20):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(6, dims))
    rows = [(i, (centres[i % 6] + 0.3 * rnd.normal(size=dims)).astype(np.float32).tolist()) for i in range(n)]
    rows += [(n + i, rows[100][1]) for i in range(40)]  # ties
    rows += [(50, rows[3][1]), (50, rows[50][1]), (None, rows[100][1]), (None, rows[7][1])]  # repeated and null ids
    rows += [(2000, None), (2050, [None] + rows[0][1][1:]), (2100, [float("nan")] * dims), (2150, [float("inf")] + rows[0][1][1:]), (2200, []), (2201, []), (2250, [1.5, -2.5]), (2251, [-0.001, 3.0]), (2300, [1.0] * 7)]
    return rows


@pytest.mark.parametrize("settings", [{}, {"block": 64}, {"block": 32, "group_bytes": 1500}])
def test_topk_equals_a_plain_search(spark, settings):
    rows = sample_vectors()
    assert searched(spark, rows, **settings) == plain(best_of(rows))


def test_topk_of_large_components_and_negative_ids(spark):
    rnd = random.Random(5)
    rows = [(i, [rnd.choice([1e12, -1e12, 3e7, 0.25]) for _ in range(4)]) for i in range(-120, 60)] + [(1000, [3e38] * 4), (1001, [3e38] * 4), (1050, [-3e38] * 4)]
    assert searched(spark, rows, block=40) == plain(best_of(rows))


def test_topk_of_an_empty_table_and_of_one_row(spark):
    assert searched(spark, []) == []
    assert searched(spark, [(0, [1.0])]) == []
    assert searched(spark, [(0, [1.0]), (1, [2.0])]) == [(0, 1, 1, 256 * 512)]


def test_bounds_never_lose_a_place():
    rnd = np.random.default_rng(1)
    for _ in range(30):
        q, c = rnd.integers(-300, 300, (9, 24)).astype(float), rnd.integers(-300, 300, (24, 200)).astype(float)
        scores = q @ c
        least = np.sort(scores, 1)[:, -rnd.integers(1, 30)]
        where, what, got = exact_topk.reaching(q, exact_topk._left(q.T).T, c, exact_topk._left(c), least, (np.array([2]), np.array([3])), 5)
        found = set(zip(where.tolist(), what.tolist(), got.tolist()))
        for i in range(9):
            row = scores[i].copy()
            if i == 2:
                row[3] = -np.inf
            fifth = max(np.sort(row)[-5], least[i])
            assert {(i, j, row[j]) for j in np.flatnonzero(row >= fifth)} <= found
        assert all(scores[i, j] == s for i, j, s in found) and (2, 3) not in {x[:2] for x in found}


# --- importance resampling


def words_of(text):
    return [w for w in "".join(c.lower() if "A" <= c <= "Z" else c if c in "abcdefghijklmnopqrstuvwxyz0123456789" or ord(c) > 127 else " " for c in text or "").split(" ") if w]


def features_of(text, n=2):
    w = words_of(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def resampled(docs, target, least=20, percent=25):
    s, t = (Counter(b for x in texts for b in features_of(x)) for texts in ([x for _, x in docs], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (all_s + 10000.0) / ((s[b] + 1.0) * (all_t + 10000.0))))
    rows = []
    for i, text in docs:
        f = features_of(text)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(text))))
    fit = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): i for i, r in enumerate(fit[: percent * len(fit) // 100], 1)}
    return [(*r[:4], rank.get(id(r))) for r in rows]


DOCS = "doc_id long, text string, id string, fit string, place string, buckets string, n_words string, score string"


def texts(spark, rows):
    return spark.createDataFrame([(i, t, "i", "f", "p", "b", "w", "s") for i, t in rows], DOCS)


def documents(seed=4, n=240):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeéB1") for _ in range(rnd.randint(1, 6))) for _ in range(400)]
    rows = [(i, rnd.choice([" ", "\n", ", ", "-"]).join(rnd.choice(words[: rnd.choice([40, 400])]) for _ in range(rnd.randint(0, 90)))) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, " .,\t"), (n + 3, "É ß \x7f \xa0 日本"), (n + 4, " ".join(rnd.choice(words) for _ in range(40000))), (None, rows[3][1]), (None, None)]
    return rows, [" ".join(rnd.choice(words[:60]) for _ in range(30)) for _ in range(8)] + [None, ""]


def test_resampling_equals_a_plain_loop(spark):
    rows, target = documents()
    found = importance_resampling.resample(texts(spark, rows).repartition(5), spark.createDataFrame([(t,) for t in target], "text string"))
    assert [k for _, k in found.dtypes] == ["bigint"] * 5
    assert plain(tuple(r) for r in found.collect()) == plain(resampled(rows, target))


def test_resampling_of_repeated_ids_and_rows(spark):
    rows, target = documents(6, 60)
    rows = [(i if i is None or i % 3 else 9, t) for i, t in rows] + rows[:5] * 2
    target = spark.createDataFrame([(t,) for t in target], "text string")
    found = [tuple(r) for r in importance_resampling.resample(texts(spark, rows).repartition(4), target).collect()]
    expected = resampled(rows, [r.text for r in target.collect()])
    assert plain(r[:4] for r in found) == plain(r[:4] for r in expected)
    # Rows that agree in all that counts may change places: ranks and the scores at them are the same.
    assert sorted((r[4], r[3], r[0]) for r in found if r[4]) == sorted((r[4], r[3], r[0]) for r in expected if r[4])


def test_resampling_of_empty_tables(spark):
    rows, target = documents(7, 30)
    empty = spark.createDataFrame([], "text string")
    assert importance_resampling.resample(texts(spark, []), spark.createDataFrame([(t,) for t in target], "text string")).count() == 0
    assert plain(tuple(r) for r in importance_resampling.resample(texts(spark, rows), empty).collect()) == plain(resampled(rows, []))


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_ring_gives_every_run(n):
    words = documents()[0][5][1].encode().split()
    got = Counter(importance_resampling.ring_scan(words, n).tolist())
    assert got == Counter(zlib.crc32(b" ".join(words[i : i + k])) for k in range(1, n + 1) for i in range(len(words) - k + 1))


# --- filter audit


def fails(text, copy):
    w = [x for x in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if x]
    return {
        "A": len(w) < 100,
        "B": 100 * len(set(w)) < 80 * len(w),
        "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
        "D": any(c in "#$%&*|" for c in text),
        "E": copy,
    }


def audited(docs, labels):
    """Every order, filter by filter, row by row."""
    good, toxic = ({i for i, *x in labels if x[k] == 1} for k in (0, 1))
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    rows = [(p or "", i in good and i is not None, i in toxic and i is not None, fails(t or "", i is not None and first[t or ""] < i)) for i, t, p in docs]
    out, total = {}, Counter()
    for part in {r[0] for r in rows}:
        for order in itertools.permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                failing = [r for r in rows if r[0] == part and r[3][f]]
                removed = [r for r in left if r[3][f]]
                left = [r for r in left if not r[3][f]]
                total[part, f] += len(removed)
                out[part, "".join(order), step] = [len(left), len(removed), len(failing) - len(removed), sum(sum(r[3].values()) == 1 for r in failing), sum(r[1] for r in removed), sum(r[2] for r in removed)]
    return sorted((p, o, s, *v, total[p, o[s - 1]]) for (p, o, s), v in out.items())


def audit_documents():
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdeéXY") for _ in range(rnd.randint(1, 6))) for _ in range(600)] + ["#x", "50%", "a|b", "\xa0x"]
    rows = [(i, rnd.choice([" ", "\n", "\t\x0b "]).join(rnd.choice(words[rnd.choice([0, 300, 570]) :]) for _ in range(rnd.choice([5, 99, 100, 101, 140]))).lower() if i % 3 else "WORD " * 3 + "x" * (i % 9) * 30, rnd.choice(["de", "fr", None, ""])) for i in range(120)]
    rows += [(200 + i, rows[i % 7][1], rnd.choice(["de", "xx"])) for i in range(60)]  # copies
    rows += [(300, None, "de"), (301, "", "de"), (302, None, None), (None, rows[4][1], "de"), (None, rows[4][1], "de"), (5, rows[5][1], "de"), (5, rows[6][1], "fr"), (3, rows[9][1], "de"), (-4, rows[9][1], "it")]
    rows.append((400, " ".join(f"w{i}" for i in range(60000)), "long"))
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in list(range(0, 120, 2)) + list(range(200, 230)) + [4, 5, 5, None]]
    return rows, labels


AUDITED = "doc_id long, text string, lang string, id string, part string, mask string, digest string, words string, quality string"


def test_audit_equals_running_every_order(spark):
    rows, labels = audit_documents()
    docs = spark.createDataFrame([(*r, "i", "p", "m", "d", "w", "q") for r in rows], AUDITED).repartition(4)
    found = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(tuple(r) for r in found.collect()) == audited(rows, labels)


def test_audit_of_empty_tables(spark):
    rows, labels = audit_documents()
    docs = lambda some: spark.createDataFrame([(*r, "i", "p", "m", "d", "w", "q") for r in some], AUDITED)
    known = lambda some: spark.createDataFrame(some, "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs([]), known(labels)).count() == 0
    assert sorted(tuple(r) for r in filter_audit.audit(docs(rows[:20]), known([])).collect()) == audited(rows[:20], [])


def test_matrices_are_32_by_600():
    orders, matrices = filter_audit.incidence()
    assert len(orders) == 120 and {m.shape for m in matrices.values()} == {(32, 600)}
    # A document is kept or removed at some step of each order, and each failing filter removes it or comes too late.
    mask = np.arange(32)
    assert (matrices["removed"].reshape(32, 120, 5).sum(2) == (mask > 0)[:, None]).all()
    assert ((matrices["removed"] + matrices["redundant"]).reshape(32, 120, 5).sum(2) == np.bitwise_count(mask)[:, None]).all()


@pytest.mark.parametrize("name", ["op11_exact_topk", "op13_filter_audit"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    connection = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        connection.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    cursor = connection.execute(ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(tuple(r) for r in QUERIES[name](spark, sf).select(*columns).collect()) == sorted(cursor.fetchall())
