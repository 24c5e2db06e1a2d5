import random

import pytest

from vellumspark.llm.leakage import leaked_items, words_of


def brute(docs, items):
    grams = {}
    for i, t in items:
        w = words_of(t or "")
        n = min(10, len(w))
        grams[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
    out = {}
    for d, t in docs:
        if t:
            w = words_of(t)
            own = {tuple(w[k : k + n]) for n in range(1, 11) for k in range(len(w) - n + 1)}
            for i, g in grams.items():
                if own & g:
                    out[d, i] = len(own & g), round(len(own & g) / len(g), 9)
    return out


def tables():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)] + ["Été", "über", "naïve"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([2, 5, 10, 40])))) for i in range(30)]
    docs = []
    for d in range(40):
        parts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 30, 400])))]
        for _ in range(rng.randrange(3)):
            w = items[rng.randrange(30)][1].split()
            n = rng.choice([9, 10, 11, len(w)])
            a = rng.randrange(max(1, len(w) - n + 1))
            parts += [", ".join(w[a : a + n]).upper(), " ".join(rng.choice(words) for _ in range(20))]
        docs.append((d, " \n".join(parts)))
    docs += [(100, None), (101, ""), (102, "short text"), (103, docs[3][1])]
    items += [(200, None), (201, ""), (202, items[4][1])]
    return docs, items


@pytest.mark.parametrize("bits", [1 << 27, 64])
def test_against_brute_force(spark, bits):
    docs, items = tables()
    got = leaked_items(spark.createDataFrame(docs * 2, "id bigint, text string"), "id", "text", spark.createDataFrame([(i, t) for i, t in items] * 2, "item_id bigint, text string"), "item_id", "text", filter_bits=bits)
    assert {(r.id, r.item_id): (r.windows, round(r.contained, 9)) for r in got.collect()} == brute(docs, items)
    assert brute(docs, items)


def test_accents_composed_or_not_and_empty_tables(spark):
    plain = "Déjà vu naïve café über Straße Ångström crème brûlée one two three"
    docs = spark.createDataFrame([("d", "xx " + "".join(c + "́" if c == "e" else c for c in "Deja vu naive cafe uber STRASSE Angstrom creme brulee one two three"))], "doc string, t string")
    items = spark.createDataFrame([("i", plain)], "item string, t string")
    assert [(r.doc, r["item"]) for r in leaked_items(docs, "doc", "t", items, "item", "t").collect()] == [("d", "i")]
    assert leaked_items(docs.limit(0), "doc", "t", items, "item", "t").count() == 0
    assert leaked_items(docs, "doc", "t", items.limit(0), "item", "t").count() == 0
