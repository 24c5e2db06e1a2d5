"""Distinctive terms and term frequencies against brute force."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vellumspark.functions.text import clean_terms
from vellumspark.llm.distinctive import count_terms, least_score, log_entropy
from vellumspark.llm.frequency import term_frequencies

TEXTS = [
    ("a", "Alpha beta alpha. ALPHA gam-\nma [1, 2] www.x.y"),
    ("b", "beta beta delta_1 mail me@x.org"),
    ("c", "beta alpha epsilon epsilon epsilon"),
    ("d", None),
    ("e", ""),
    ("f", "  \n "),
    ("g", "beta " * 3000),
    ("g2", "beta " * 3000),
]
TOKENS = {"a": "alpha beta alpha alpha gamma".split(), "b": "beta beta delta_1 mail".split(), "c": "beta alpha epsilon epsilon epsilon".split(), "g": ["beta"] * 3000, "g2": ["beta"] * 3000}


def test_log_entropy_against_formula(spark):
    df = spark.createDataFrame([(k, t, "term", 3) for k, t in TEXTS], "id string, text string, term string, tf int")
    records = df.agg(F.count(F.lit(1)).alias("n"))
    got = {(r.id, r.term): r for r in log_entropy(count_terms(df, ["id"], clean_terms(F.col("text"))), records).collect()}
    n = len(TEXTS)
    counts = {(k, t): c for k, ts in TOKENS.items() for t, c in Counter(ts).items()}
    assert got.keys() == counts.keys()
    for (k, t), tf in counts.items():
        spread = [c for (_, u), c in counts.items() if u == t]
        entropy = -sum(c / sum(spread) * math.log(c / sum(spread)) for c in spread)
        weight = 1 - entropy / math.log(n)
        r = got[k, t]
        assert (r.tf, r.df, r.gf) == (tf, len(spread), sum(spread))
        assert r.weight == pytest.approx(weight, abs=1e-9) and r.score == pytest.approx(math.log2(1 + tf) * weight, abs=1e-9)


def test_no_score_is_below_its_bound(spark):
    rng = random.Random(12)
    df = spark.createDataFrame([(i, " ".join(f"t{min(int(rng.paretovariate(0.7)), 60)}" for _ in range(40))) for i in range(50)], "id int, text string")
    scored = log_entropy(count_terms(df, ["id"], clean_terms(F.col("text"))), df.agg(F.count(F.lit(1)).alias("n"))).withColumn("least", least_score(3, 8, F.col("n")))
    rows = scored.collect()
    assert all(r.score >= r.least for r in rows if r.tf >= 3 and r.df <= 8)
    assert any(r.score < r.least for r in rows)  # terms that everyone has


def test_kinds_apart_lone_record_and_empty_table(spark):
    df = spark.createDataFrame([("x", "1", ["t", "t", None]), ("y", "1", ["t"]), ("y", "2", ["t", "u"]), ("y", "3", None)], "kind string, id string, terms array<string>")
    records = df.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    got = {(r.kind, r.id, r.term): (r.tf, r.df, r.weight) for r in log_entropy(count_terms(df, ["kind", "id"], F.col("terms")), records, ["kind"]).collect()}
    assert got["x", "1", "t"] == (2, 1, 1.0) and got["y", "1", "t"][:2] == (1, 2) and got["y", "2", "u"] == (1, 1, 1.0)
    assert got["y", "1", "t"][2] == pytest.approx(1 - math.log(2) / math.log(3))
    none = df.limit(0)
    assert log_entropy(count_terms(none, ["kind", "id"], F.col("terms")), none.groupBy("kind").agg(F.count(F.lit(1)).alias("n")), ["kind"]).count() == 0


@pytest.mark.parametrize("flush", [1, 3, 200_000])
def test_last_seen_counters(spark, flush):
    rows = [(["a", "b", "a"],), (["b"],), (["b", "c", None],), (None,), ([],), (["b", "b"],), (["b", "b"],)] * 3
    df = spark.createDataFrame(rows, "terms array<string>").repartition(4)
    got = {r.term: (r.occurrences, r.records, r.mark) for r in term_frequencies(df, "terms", rare_records=3, common_share=0.6, flush=flush).collect()}
    assert got == {"a": (6, 3, "rare"), "b": (21, 15, "common"), "c": (3, 3, "rare")}


def test_frequencies_of_nothing(spark):
    assert term_frequencies(spark.createDataFrame([], "terms array<string>, term string"), "terms").count() == 0
