import random

import pytest

from vellumspark.operators.hierarchy import descendants, hierarchy

SCHEMA = "doc_id string, section_id string, parent_id string, depth int"


def brute(rows):
    ids = {}
    for d, s, _ in rows:
        k = (d, s.strip().lower())
        ids[k] = min(ids.get(k, s), s)
    up = {(d, s): (d, ids[(d, p.strip().lower())]) if p and (d, p.strip().lower()) in ids else None for d, s, p in rows}
    out = {}
    for k in up:
        path, x = [k], k
        while up[x] is not None and up[x] not in path:
            x = up[x]
            path.append(x)
        if up[x] is None:
            out[k] = [n for _, n in reversed(path)]
        else:
            out[k] = "on" if up[x] == k else "below"
    return out


def check(spark, rows, task_nodes):
    tree = hierarchy(spark.createDataFrame([(*r, 7) for r in rows], SCHEMA), ["doc_id"], "section_id", "parent_id", task_nodes)
    got = {(r.doc_id, r.section_id): r for r in tree.collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    for k, w in want.items():
        r = got[k]
        if isinstance(w, str):
            assert r.circle == w and r.depth is None
        else:
            assert (r.circle, r.path, r.root, r.depth) == (None, w, w[0], len(w))
    below = {k: {n for n, w in want.items() if n[0] == k[0] and not isinstance(w, str) and k[1] in w[:-1]} for k, w in want.items() if not isinstance(w, str)}
    for k, names in below.items():
        r = got[k]
        assert names == {n for n, x in got.items() if n[0] == k[0] and x.root == r.root and x.circle is None and r.first < x.first <= r.last}
    pairs = {(r.doc_id, r.ancestor, r.descendant) for r in descendants(tree, ["doc_id"], "section_id").collect()}
    assert pairs == {(k[0], k[1], n) for k, names in below.items() for _, n in names}


@pytest.mark.parametrize("task_nodes", [200_000, 45, 0])
def test_random_forests(spark, task_nodes):
    rng = random.Random(5)
    rows = []
    for d in range(6):
        n = rng.choice([1, 5, 40, 90])
        for i in range(n):
            p = rng.choice([None, "", " ", "gone", f"s{rng.randrange(n)}", f" S{rng.randrange(max(1, i))} ", f"s{max(0, i - 1)}"])
            rows.append((f"d{d}", f"s{i}", p))
    check(spark, rows, task_nodes)


@pytest.mark.parametrize("task_nodes", [200_000, 0])
def test_deep_branch_wide_star_and_circles(spark, task_nodes):
    rows = [("a", f"s{i}", f"s{i - 1}" if i else None) for i in range(70)]
    rows += [("b", "hub", None)] + [("b", f"x{i}", "HUB") for i in range(150)]
    rows += [("c", "p", "q"), ("c", "q", "r"), ("c", "r", "p"), ("c", "t", "q"), ("c", "u", "t"), ("c", "self", "self"), ("c", "ok", None)]
    check(spark, rows, task_nodes)


@pytest.mark.parametrize("rows", [[], [(None, "a", None), (None, "b", "a"), ("", "b", "a"), ("d", None, "a"), ("d", "a", None)]])
def test_empty_tables_null_groups_null_nodes(spark, rows):
    tree = hierarchy(spark.createDataFrame([(*r, 7) for r in rows], SCHEMA), ["doc_id"], "section_id", "parent_id")
    got = {(r.doc_id, r.section_id): (r.depth, r.path) for r in tree.collect()}
    assert got == ({} if not rows else {(None, "a"): (1, ["a"]), (None, "b"): (2, ["a", "b"]), ("", "b"): (1, ["b"]), ("d", "a"): (1, ["a"])})
