"""Tables of queries over postings in blocks: the rows of the SQL, and no list of all pairs."""

import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from vellumspark.operators import blocks, bm25
from vellumspark.plans import search

WORDS = [f"w{i}" for i in range(40)]
CHUNKS = "chunk_id VARCHAR, content_text VARCHAR, embed_text VARCHAR, token_count INT, char_count INT, paper_id VARCHAR, paper_title VARCHAR, section_title VARCHAR, section_id VARCHAR, page_numbers INT[], source_block_ids VARCHAR[], chunk_type VARCHAR, is_reference BOOLEAN, indexed_at TIMESTAMP"
QUERIES = "query_id BIGINT, query_label VARCHAR, query_text VARCHAR, filter_paper_id VARCHAR, min_page INT, max_page INT, asked_at TIMESTAMP"


def some_text(rng, n):
    return " ".join(WORDS[min(int(rng.expovariate(0.12)), len(WORDS) - 1)] for _ in range(n))


@pytest.fixture(scope="module")
def made(tmp_path_factory):
    """400 chunks, many of which tie; 60 queries, a third of them with filters."""
    rng, folder, con = random.Random(5), tmp_path_factory.mktemp("made"), duckdb.connect()
    con.execute(f"CREATE TABLE chunks ({CHUNKS}); CREATE TABLE search_queries ({QUERIES})")
    rows = [[f"c{i}", "x", "Compare " + some_text(rng, rng.randint(0, 9)), 1, 1, rng.choice(["p1", "p2", "p3", None]), "t", "s", "i", rng.choice([[1], [2, 3], [3, 1], [7], [], None, [4, None]]), [], "prose", False, "2021-01-01"] for i in range(400)]
    rows += [["twice", text, embed, 1, 1, paper, "t", "s", "i", [2], [], "prose", False, "2021-01-01"] for text, embed, paper in (("a", "zebra", "p1"), ("b", "apple", "p2"))]
    rows += [["e1", "x", "", 1, 1, "p1", "t", "s", "i", [1], [], "prose", False, "2021-01-01"], ["e2", "x", None, 1, 1, "p1", "t", "s", "i", [1], [], "prose", False, None]]
    asked = [[i, "l", "compare " + some_text(rng, rng.randint(1, 4)), *((None, None, None) if i % 3 else (rng.choice(["p1", "", None, "p9"]), rng.choice([None, 2, 3]), rng.choice([None, 1, 3]))), "2023-01-01"] for i in range(60)]
    asked += [[90, "l", "zebra", "p1", None, None, "2023-01-01"], [91, "l", "apple", None, None, None, "2023-01-01"], [92, "l", "", None, None, None, "2023-01-01"], [93, "l", None, None, 1, None, "2023-01-01"]]
    con.executemany(f"INSERT INTO chunks VALUES ({', '.join('?' * 14)})", rows)
    con.executemany(f"INSERT INTO search_queries VALUES ({', '.join('?' * 7)})", asked)
    for t in ("chunks", "search_queries"):
        con.execute(f"COPY {t} TO '{folder}/{t}.parquet' (FORMAT parquet)")
    return str(folder), con


def held_against_sql(spark, made, name, monkeypatch):
    """Rows as in the SQL; how many scores were ranked for them."""
    ranked = []

    def spy(scores, k=25):
        ranked.append(scores)
        return rank_hits(scores, k)

    rank_hits = bm25.rank_hits
    for module in (bm25, blocks):
        monkeypatch.setattr(module, "rank_hits", spy)
    folder, con = made
    got = sorted(map(tuple, search.QUERIES[name](spark, folder).select("query_id", "chunk_id", "score", "rank").collect()))
    want = sorted(con.execute(search.ORACLES[name]).fetchall())
    assert len(got) > 500 and [(q, c, r) for q, c, _, r in got] == [(q, c, r) for q, c, _, r in want]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in want], abs=1e-9)
    return ranked[0].count(), len(got)


def test_queries_with_filters_are_as_in_sql_without_all_pairs(spark, made, monkeypatch):
    scored, hits = held_against_sql(spark, made, "bm25_search_filtered", monkeypatch)
    assert scored < 4 * hits


def test_a_table_of_queries_is_as_in_sql_without_all_pairs(spark, made, monkeypatch):
    scored, hits = held_against_sql(spark, made, "bm25_batch", monkeypatch)
    assert scored < 4 * hits


def by_brute_force(chunks, queries, idf, mean, k):
    """k best by rounded score, then by chunk; queries: paper, least, most, weights of terms."""
    out = {}
    for q, (paper, least, most, terms) in queries.items():
        hits = []
        for name, own, first, last, tf, n in chunks:
            if (paper is None or own == paper) and (least is None or (last is not None and last >= least)) and (most is None or (first is not None and first <= most)):
                raw = sum(idf[t] * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * n / mean)) for t in terms if tf[t])
                if raw > 0:
                    hits.append((-round(raw, 4), name))
        out[q] = sorted(hits)[:k]
    return out


@pytest.mark.parametrize("tokens, seed", [(1, 1), (60, 2), (700, 3), (10**6, 4)])
def test_blocks_of_any_size_give_the_best(tmp_path, monkeypatch, tokens, seed):
    monkeypatch.setattr(blocks, "TOKENS", tokens)
    rng = random.Random(seed)
    texts = [some_text(rng, rng.randint(0, 12)) for _ in range(30)]
    rows = [(f"c{i}", rng.choice(texts), rng.choice(["p1", "p2", None]), *rng.choice([(1, 1), (2, 5), (None, None)])) for i in range(300)]
    rng.shuffle(rows)
    columns = [pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()))]
    batch = pa.RecordBatch.from_arrays(columns, names=["a", "b", "c", "d", "e"])
    packed = pa.Table.from_batches(blocks._pack(iter([batch.slice(0, 130), batch.slice(130)])))
    pq.write_table(packed, tmp_path / "b.parquet")
    df, total = Counter(), sum(packed.column("n").drop_null().to_pylist())
    for t, n in zip(packed.column("term").to_pylist(), packed.column("df").to_pylist()):
        df[t] += n or 0
    chunks = [(n, p, a, z, Counter(text.split()), len(text.split())) for n, text, p, a, z in rows]
    mean = sum(packed.column("tokens").drop_null().to_pylist()) / total
    assert total == 300 and mean == sum(c[5] for c in chunks) / 300 and all(df[t] == sum(t in c[4] for c in chunks) for t in WORDS)
    idf = defaultdict(float, {t: math.log(1 + (300 - df[t] + 0.5) / (df[t] + 0.5)) for t in WORDS if df[t]})
    queries = {q: (rng.choice([None, None, "p1", "p9"]), rng.choice([None, 2]), rng.choice([None, 1]), rng.sample(WORDS[:15], rng.randint(1, 4))) for q in range(60)}
    asked = sorted((q, -idf[t], t, p, a, z) for q, (p, a, z, terms) in queries.items() for t in terms if df[t])
    table = pa.table([pa.array([r[0] for r in asked]), pa.array([r[3] for r in asked], pa.string()), pa.array([r[4] for r in asked], pa.int64()), pa.array([r[5] for r in asked], pa.int64()), pa.array([r[2] for r in asked]), pa.array([-r[1] for r in asked])], names=["query_id", "paper", "least", "most", "term", "weight"])
    got = defaultdict(list)
    for out in blocks._search(iter(table.to_batches()), [f"file://{tmp_path}/b.parquet"], 5, 1.5, 0.75, max(1.0, mean), True):
        for q, name, raw in zip(*(c.to_pylist() for c in out.columns)):
            got[q].append((-round(raw, 4), name))
    want = by_brute_force(chunks, queries, idf, max(1.0, mean), 5)
    assert {q: sorted(h)[:5] for q, h in got.items()} == {q: h for q, h in want.items() if h}


def test_of_many_equal_scores_the_first_are_kept():
    names, best = [f"c{i:03}" for i in range(500)], blocks._Best()
    random.Random(3).shuffle(names)
    for i in range(0, 500, 50):
        best.add(np.array(names[i : i + 50], object), np.ones(50), 5)
    assert len(best.names) <= 70 and set(sorted(names)[:5]) <= set(best.names)
