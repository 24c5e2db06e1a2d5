"""Operators of chunking, search, layout and storage on small fixtures."""

import datetime
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from vellumspark.operators import bm25, dense, hybrid, layout, pooling, store
from vellumspark.operators.chunking import ChunkingConfig, chunk_bounds, chunk_documents
from vellumspark.operators.embedding import embed
from vellumspark.operators.enrichment import read_atom_entry, read_work
from vellumspark.operators.filters import SearchFilter, compile_where
from vellumspark.operators.summary import summarise
from vellumspark.operators.tfidf import inverse_document_frequency, term_frequency, tfidf
from vellumspark.plans import layouts
from vellumspark.sources.documents import read_files
from vellumspark.streaming.ingest import upsert_stream


def walk(tokens, c):
    """The chunking steps one by one."""
    out, i = [], 0
    while i < len(tokens):
        if out and sum(tokens[i:]) < c.min_tokens:
            out[-1][2] = i
            break
        a, total = i, 0
        while i < len(tokens):
            if i == a and tokens[i] >= c.max_tokens:
                i += 1
                break
            if total + tokens[i] > c.max_tokens:
                break
            total += tokens[i]
            i += 1
        out.append([a, i, len(tokens)])
        if i < len(tokens) and c.overlap_tokens > 0:
            steps, got = 0, 0
            while i - 1 - steps >= 0 and got + tokens[i - 1 - steps] <= c.overlap_tokens:
                got += tokens[i - 1 - steps]
                steps += 1
            if 0 < steps < i - a:
                i -= steps
    return [tuple(x) for x in out]


def test_chunk_bounds_against_the_steps():
    assert chunk_bounds([20, 15, 12, 10], ChunkingConfig(35, 18, 30)) == [(0, 2, 4), (1, 3, 2)]
    rng = random.Random(1)
    for _ in range(800):
        c = ChunkingConfig(rng.choice([10, 35, 60]), rng.choice([0, 5, 18, 40]), rng.choice([0, 10, 30]))
        tokens = [rng.choice([1, 2, 5, 9, 20, 70]) for _ in range(rng.randrange(25))]
        assert chunk_bounds(tokens, c) == walk(tokens, c)


def test_chunks_keep_pages_blocks_and_references(spark):
    long = "Alpha beta gamma delta epsilon zeta eta theta iota kappa."
    blocks = spark.createDataFrame([("d", "b1", 1, "paragraph", long, 3, "s1"), ("d", "b2", 2, "paragraph", long, 4, "s1"), ("d", "b3", 3, "paragraph", "Lin K. A paper of note, 2001.", 5, "s2"), ("d", "b4", 4, "paragraph", None, 5, "s2"), ("d", "b5", 5, "paragraph", "two words", 5, "s2")], "doc_id string, block_id string, ordinal bigint, block_type string, text string, page_number int, section_id string")
    sections = spark.createDataFrame([("d", "s1", "Method"), ("d", "s2", "References")], "doc_id string, section_id string, title string")
    papers = spark.createDataFrame([("d", "p", "A Title")], "doc_id string, paper_id string, title string")
    got = {r.chunk_id: r for r in chunk_documents(blocks, sections, papers).collect()}
    a, b = got["p_s1_c1"], got["p_s2_c1"]
    assert a.page_numbers == [3, 4] and a.source_block_ids == ["b1", "b2"] and a.embed_text.startswith("[Document: A Title | Section: Method | Pages 3-4]\n\nAlpha")
    assert b.is_reference and b.chunk_type == "reference" and not a.is_reference and a.token_count == 26 and a.section_id == "s1"
    assert chunk_documents(blocks.limit(0), sections, papers).count() == 0


def test_tfidf_goldens(spark):
    df = spark.createDataFrame([(1, ["transformer", "model", "transformer", "attention"]), (2, ["transformer"]), (3, ["transformer"]), (4, [])], "id int, tokens array<string>")
    tf = term_frequency(df, ["id"], "tokens")
    assert {r.term: r.tf for r in tf.where("id = 1").collect()} == {"transformer": 0.5, "model": 0.25, "attention": 0.25}
    three = df.where("id < 4").agg(F.count(F.lit(1)).alias("n"))
    idf = {r.term: r.idf for r in inverse_document_frequency(tf, three).collect()}
    assert idf["transformer"] == pytest.approx(1.0) and idf["model"] == pytest.approx(math.log(2) + 1)
    assert {r.term: r.tfidf for r in tfidf(tf.where("id = 1"), spark.createDataFrame([("transformer", 1.0)], "term string, idf double")).collect()} == {"transformer": 0.5, "model": 0.0, "attention": 0.0}


def chunk_table(spark):
    rows = [("a", "the sparse encoder beats wmt-14", "p1", "Method", [1]), ("b", "a dense decoder and the encoder", "p2", "Method", [2, 9]), ("c", "nothing here", "p2", "Data", None), ("d", None, "p1", None, [3])]
    return spark.createDataFrame(rows, "chunk_id string, embed_text string, paper_id string, section_title string, page_numbers array<int>")


def test_bm25(spark):
    chunks = chunk_table(spark)
    index = bm25.BM25Index.build(chunks)
    assert bm25.search(index, chunks, "zebra quark").count() == 0
    hits = bm25.search(index, chunks, "encoder").collect()
    assert [(r.chunk_id, r.rank) for r in hits] == [("a", 1), ("b", 2)] and hits[0].score > hits[1].score
    assert [r.chunk_id for r in bm25.search(index, chunks, "WMT-14", search_filter=SearchFilter(paper_id="p1")).collect()] == ["a"]
    assert [r.chunk_id for r in bm25.search(index, chunks, "encoder", search_filter=SearchFilter(min_page=3, max_page=5)).collect()] == ["b"]
    assert bm25.search(index, chunks, "encoder", filter_paper_id="none").count() == 0
    assert all(r.idf > 0 for r in index.idf().collect())
    twice = bm25.search(index, chunks, "encoder encoder").collect()[0].score
    assert twice == pytest.approx(2 * hits[0].score, abs=1e-3)


def scores_of(spark, index):
    asked = spark.createDataFrame(list(enumerate(["dense decoder", "encoder encoder", "WMT-14", "brand new"])), "query_id int, query_text string")
    return sorted(map(tuple, bm25.rank_hits(bm25.score_queries(index, asked)).collect()))


def test_bm25_kept_in_segments(spark, tmp_path):
    chunks = chunk_table(spark)
    kept = bm25.StoredBM25(spark, str(tmp_path / "i"), buckets=2)
    kept.fit(chunks)
    # another chunk, an empty one, and one that is there already with another text
    more = spark.createDataFrame([("n", "brand new encoder text"), ("e", ""), ("z", None), ("a", "dense dense decoder")], "chunk_id string, embed_text string")
    kept.add(more)
    now = more.unionByName(chunks.where("chunk_id <> 'a'").select("chunk_id", "embed_text"))
    want = scores_of(spark, bm25.BM25Index.build(now))
    assert scores_of(spark, kept.index()) == want and kept.index().corpus.first().n_chunks == now.count()
    assert kept.remove(spark.createDataFrame([("n",), ("gone",)], "chunk_id string")) == 1
    kept.compact()
    want = scores_of(spark, bm25.BM25Index.build(now.where("chunk_id <> 'n'")))
    assert want and scores_of(spark, kept.index()) == want and len(list((tmp_path / "i" / "postings").glob("segment=*"))) == 1
    kept.fit(chunks)
    assert scores_of(spark, kept.index()) == scores_of(spark, bm25.BM25Index.build(chunks))


def test_bm25_queries_with_filters_of_their_own(spark):
    chunks = chunk_table(spark)
    asked = spark.createDataFrame([(1, "encoder", None, None, None), (2, "encoder", "p1", None, None), (3, "encoder", "", 3, 5), (4, "encoder", "none", None, None)], "query_id int, query_text string, filter_paper_id string, min_page int, max_page int")
    got = {}
    for r in bm25.search_each(bm25.BM25Index.build(chunks), chunks, asked).collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert {k: sorted(v) for k, v in got.items()} == {1: ["a", "b"], 2: ["a"], 3: ["b"]}


def test_fusion_rerank_and_assembly(spark):
    ranks = lambda *ids: spark.createDataFrame([(1, i, 1.0, r) for r, i in enumerate(ids, 1)], "query_id int, chunk_id string, score double, rank int")
    fused = hybrid.fuse(ranks("x", "y"), ranks("y", "z")).orderBy("position").collect()
    assert [(r.chunk_id, r.rrf_score) for r in fused] == [("y", 0.032522), ("x", 0.016393), ("z", 0.016129)]
    with pytest.raises(ValueError):
        hybrid.fuse(ranks("x"), ranks("y"), k=-1)
    rows = spark.createDataFrame([(1, "m", "dense text", 0.5, 1, "sparse words"), (1, "z", "sparse words here", 0.3, 2, "sparse words"), (1, "a", "none", 0.5, 3, "sparse words"), (2, "q", "b", 0.1, 1, "  "), (2, "p", "a", 0.1, 2, "  ")], "query_id int, chunk_id string, content_text string, rrf_score double, position int, query_text string")
    got = [(r.query_id, r.chunk_id, r.cross_score) for r in hybrid.rerank(rows).orderBy("query_id", "rank").collect()]
    assert got == [(1, "z", 2.0), (1, "a", 0.0), (1, "m", 0.0), (2, "q", None), (2, "p", None)]
    assert hybrid.rerank(rows, 0).count() == 0
    payload = spark.createDataFrame([("y", "text y")], "chunk_id string, content_text string")
    other = spark.createDataFrame([("x", "old x"), ("z", "old z")], "chunk_id string, content_text string")
    table = hybrid.fuse(ranks("x", "y"), ranks("y", "z"))
    assert {r.chunk_id: r.content_text for r in hybrid.assemble(table, payload, other).collect()} == {"x": "old x", "y": "text y", "z": "old z"}
    with pytest.raises(Exception, match="unknown to both"):
        hybrid.assemble(table, payload).collect()


def test_dense_search_and_filters(spark):
    rows = spark.createDataFrame([("b1", [1.0, 0.0, 0.0, 0.0], "p1", 1, "A"), ("b2", [0.0, 1.0, 0.0, 0.0], "p1", 3, "B"), ("b3", [0.0, 0.0, 0.0, 0.0], "p2", 4, None)], "block_id string, embedding array<double>, paper_id string, page_number int, section_title string")
    top = dense.nearest_to_one(rows, [1.0, 0.1, 0.0, 0.0], 2).collect()
    assert top[0].block_id == "b1" and top[0].score >= 0.99 and top[0].rank == 1
    assert dense.nearest_to_one(rows, [1.0, 0.0, 0.0, 0.0], 5, SearchFilter(min_page=2, max_page=5).on_page()).first().block_id == "b2"
    assert rows.where(compile_where({"paper_id": "p1", "page_number": {"$gte": 2}})).first().block_id == "b2"
    assert rows.where(compile_where({"$or": [{"section_title": "A"}, {"paper_id": {"$in": ["p2"]}}]})).count() == 2
    assert SearchFilter(paper_id="a").scoped("b").paper_id == "b"
    queries = spark.createDataFrame([(1, [0.0, 1.0, 0.0, 0.0])], "query_id int, query_vector array<double>")
    assert dense.nearest_to_each(rows, queries, 1, "block_id").first().block_id == "b2"
    odd = rows.select("block_id", "embedding").union(spark.createDataFrame([("n", None), ("s", [1.0]), ("q", [None, 1.0, 0.0, 0.0]), ("i", [float("nan"), 0.0, 0.0, 0.0]), ("b0", [0.0, 2.0, 0.0, 0.0])], "block_id string, embedding array<double>"))
    asked = queries.union(spark.createDataFrame([(2, None), (3, [0.0] * 4)], "query_id int, query_vector array<double>"))
    for parts in (1, 50_000):
        got = [(r.query_id, r.block_id, r.score) for r in dense.nearest_to_each(odd, asked, 3, "block_id", part_rows=parts, part_queries=parts).orderBy("query_id", "rank").collect()]
        assert got == [(1, "b0", 1.0), (1, "b2", 1.0), (1, "b1", 0.0), (3, "b0", 0.0), (3, "b1", 0.0), (3, "b2", 0.0)]
    assert dense.nearest_to_each(rows.limit(0), queries, 1, "block_id").count() == 0


def test_nearest_to_a_text_and_best_sentence(spark):
    embed = lambda c: F.array(F.length(c).cast("double"), F.lit(1.0))
    rows = spark.createDataFrame([("b1", [4.0, 1.0], None, None), ("b2", [1.0, 9.0], "p2", 7)], "block_id string, embedding array<double>, paper_id string, page_number int")
    near = dense.nearest_to_text(rows, "four", embed).collect()
    assert [(r.block_id, r.paper_id, r.page_number) for r in near] == [("b1", "unknown", 1), ("b2", "p2", 7)]
    assert dense.nearest_to_text(rows, " ", embed).count() == 0
    # a filter is used instead of a where
    assert [r.block_id for r in dense.nearest_to_text(rows, "four", embed, where={"paper_id": "none"}, search_filter=SearchFilter(min_page=5)).collect()] == ["b2"]
    assert [r.block_id for r in dense.nearest_to_text(rows, "four", embed, where={"paper_id": "p2"}).collect()] == ["b2"]
    sentences = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [3.0, 3.0]), (None, [1.0, 1.0])], "id int, vector array<double>")
    asked = spark.createDataFrame([("x", [1.0, 1.0]), ("y", [0.0, 0.0])], "query_id string, query_vector array<double>")
    assert {(r.query_id, r.id, r.similarity) for r in dense.best_sentence(sentences, asked).collect()} == {("x", 2, 1.0), ("y", 1, 0.0)}


def test_store(spark, tmp_path):
    schema = "id string, paper_id string, v int"
    make = lambda rows: spark.createDataFrame(rows, schema)
    kept = store.Collection(spark, str(tmp_path / "c"), schema, ["id"])
    assert kept.read().count() == 0
    kept.upsert(make([("a", "p", 1), ("b", "q", 1)]))
    kept.upsert(make([("a", "p", 2), ("c", None, 1)]))
    assert sorted((r.id, r.v) for r in kept.read().collect()) == [("a", 2), ("b", 1), ("c", 1)]
    assert kept.delete_paper("p") == 1 and kept.delete_paper("p") == 0 and kept.read().count() == 2
    # a write touches the buckets of its keys alone, and files that nothing names are gone
    kept.upsert(make([(str(i), "p", 1) for i in range(100)]))
    before = kept._state()[1]
    kept.upsert(make([("7", "p", 2)]))
    after = kept._state()[1]
    assert sum(before[k] != after[k] for k in before) == 1
    assert len(kept._numbers()) == 2 and set(kept._names("data")) == {v for n in kept._numbers() for v in kept._manifest(n).values()}
    assert kept.remove(make([("7", "p", 0), ("8", "p", 0), ("no", "p", 0)]).select("id")) == 2
    kept.clear()
    kept.upsert(make([]))
    assert kept.read().count() == 0
    table = spark.createDataFrame([("p", 1, "S", {"title": "T", "x": None}), ("p", 2, None, None)], "paper_id string, page_number int, section_title string, metadata map<string,string>")
    got = store.prepare_blocks(table).orderBy("page_number").collect()
    assert got[0].metadata == {"title": "T", "paper_id": "p", "paper_title": "T", "page_number": "1", "section_title": "S"} and got[1].paper_title == "p"


def test_stream_is_last_write_wins_and_idempotent(spark, tmp_path):
    schema = "id string, v int, ts timestamp_ntz"
    source = tmp_path / "in"
    rows = lambda *r: spark.createDataFrame(list(r), "id string, v int, t string").selectExpr("id", "v", "cast(t as timestamp_ntz) ts").coalesce(1).write.mode("append").parquet(str(source))
    kept = store.Collection(spark, str(tmp_path / "c"), schema, ["id"])
    run = lambda: upsert_stream(spark.readStream.schema(schema).parquet(str(source)), kept, "ts", str(tmp_path / "s"), once=True).awaitTermination()
    rows(("a", 1, "2020-01-01"), ("a", 2, "2020-01-02"), ("b", 1, "2020-01-01"))
    run()
    run()
    rows(("a", 9, "2019-01-01"), ("b", 5, "2020-02-01"))
    run()
    assert sorted((r.id, r.v) for r in kept.read().collect()) == [("a", 2), ("b", 5)]


def span(text, bold=False, size=10.0):
    return (text, size, "Serif-Bold" if bold else "Serif", 0)


def test_layout_pipeline(spark):
    raw = [
        ("d", "t", 1, "The Long Paper", 1, [0.0, 0.0, 100.0, 10.0], [span("The Long Paper", True, 16.0)]),
        ("d", "u", 2, "Title Goes On", 1, [0.0, 12.0, 100.0, 22.0], [span("Title Goes On", True, 16.0)]),
        ("d", "v", 3, "An Author", 1, [0.0, 60.0, 100.0, 70.0], [span("An Author", True, 11.0)]),
        ("d", "w", 4, "Abstract", 1, [0.0, 100.0, 100.0, 110.0], [span("Abstract", True, 12.0)]),
        ("d", "x", 5, "We show it. ", 1, [0.0, 150.0, 100.0, 160.0], [span("We show it.")]),
        ("d", "y", 6, "1 Introduction", 2, [0.0, 0.0, 100.0, 10.0], [span("1 Introduction", True, 12.0)]),
        ("d", "z", 7, "Main idea. It is so", 2, [0.0, 50.0, 100.0, 60.0], [span("Main"), span("x")]),
        ("d", "i", 8, "Our method. It is so", 2, [0.0, 90.0, 100.0, 99.0], [span("Our method.", True), span(" "), span("It is so")]),
        ("d", "s", 9, "1.1 Detail", 2, [0.0, 120.0, 100.0, 130.0], [span("1.1 Detail", True, 12.0)]),
        ("d", "e", 10, "  ", 2, [0.0, 140.0, 100.0, 150.0], []),
    ]
    df = spark.createDataFrame(raw, "doc_id string, block_id string, ordinal bigint, text string, page_number int, bbox array<double>, spans array<struct<text:string,font_size:double,font:string,flags:int>>")
    sections, blocks = layout.detect_sections(df)
    got = {r.title: (r.level, r.parent_id, r.section_id) for r in sections.collect()}
    assert got == {"The Long Paper Title Goes On": (2, None, "sec_1"), "Abstract": (2, None, "sec_2"), "1 Introduction": (1, None, "sec_3"), "Our method.": (2, "sec_3", "sec_4"), "1.1 Detail": (2, "sec_3", "sec_5")}
    kinds = {r.block_id: (r.block_type, r.section_id, r.text) for r in blocks.collect()}
    assert kinds["v"] == ("paragraph", "sec_1", "An Author") and kinds["i_p"] == ("paragraph", "sec_4", "It is so") and kinds["x"][1] == "sec_2" and "e" not in kinds


def test_paragraph_of_an_inline_heading_is_whole(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(100_020))
    now = datetime.datetime(2024, 1, 1)
    row = ("d", "d_block_2", "paragraph", text, 1, "s", [0.0, 0.0, 9.0, 9.0], now)  # an ordinal divisible by 7 is laid out with an inline heading
    spark.createDataFrame([row], "doc_id string, block_id string, block_type string, text string, page_number int, section_id string, bbox array<double>, extracted_at timestamp").write.parquet(f"{tmp_path}/content_blocks.parquet")
    got = {r.block_id: r.text for r in layouts.q_inline_heading_split(spark, str(tmp_path)).collect()}
    assert got == {"d_block_2_h": "w0 w1 w2", "d_block_2_p": text[len("w0 w1 w2 ") :]}


def test_hierarchy_windows_against_a_stack(spark):
    rng = random.Random(3)
    rows = [(f"d{d}", i, 0, rng.choice([None, 1, 2, 3, 4, 6])) for d in range(12) for i in range(40)]
    got = {(r.doc_id, r.ordinal): (r.section_id, r.parent_id) for r in layout.section_hierarchy(spark.createDataFrame(rows, "doc_id string, ordinal bigint, part int, level int")).collect()}
    for d, group in itertools.groupby(rows, key=lambda r: r[0]):
        stack, n, last = [], 0, None
        for _, i, _, level in group:
            if level is None:
                assert got[d, i] == (last, None)
                continue
            while stack and stack[-1][0] >= level:
                stack.pop()
            n += 1
            last = f"sec_{n}"
            assert got[d, i] == (last, stack[-1][1] if stack else None)
            stack.append((level, last))


def test_headings_deeper_than_twelve_have_parents(spark):
    rows = [("d", i, 0, level) for i, level in enumerate([*range(1, 41), None, 14, 13, 40])]
    got = {r.ordinal: (r.section_id, r.parent_id) for r in layout.section_hierarchy(spark.createDataFrame(rows, "doc_id string, ordinal bigint, part int, level int")).collect()}
    assert all(got[i] == (f"sec_{i + 1}", f"sec_{i}" if i else None) for i in range(40))
    assert [got[i] for i in range(40, 44)] == [("sec_40", None), ("sec_41", "sec_13"), ("sec_42", "sec_12"), ("sec_43", "sec_42")]


def test_summary(spark):
    par = lambda i, title, text: ("d", title, i, text)
    rows = [par(1, "Abstract", "We propose the sparse encoder for dense retrieval tasks. It is nice and warm today here. We thank the sparse encoder people."), par(2, "Method", "The sparse encoder reads tokens in order. Nothing else matters here at all."), par(3, "References", "The sparse encoder reads tokens in order.")]
    df = spark.createDataFrame(rows, "doc_id string, title string, ordinal bigint, text string")
    assert summarise(df, 1).first().summary == "We propose the sparse encoder for dense retrieval tasks."
    assert "tokens in order" in summarise(df, 2, ["method"]).first().summary
    assert summarise(df.limit(0)).count() == 0


def test_pooling_and_analogies(spark):
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 1.0]), ("d", [1.0, 0.1])], "word string, vector array<double>")
    tokens = spark.createDataFrame([(1, ["A", "b", "zzz"]), (2, ["b", "a"]), (3, ["zzz"]), (4, [])], "id int, tokens array<string>")
    got = {r.id: r.vector for r in pooling.pool(tokens, vectors, 2).collect()}
    assert got == {1: [0.5, 0.5], 2: [0.5, 0.5], 3: [0.0, 0.0], 4: [0.0, 0.0]}
    weights = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("c", 0.0)], "word string, weight double")
    assert {r.id: r.vector for r in pooling.pool(tokens, vectors, 2, weights).collect()}[1] == [0.75, 0.25]
    assert [r.word for r in pooling.most_similar(vectors, ["a"], k=2).collect()] == ["d", "c"]
    with pytest.raises(Exception, match="unknown word"):
        pooling.most_similar(vectors, ["nope"]).collect()
    with pytest.raises(ValueError):
        pooling.train(tokens.limit(0))


def test_embedding_records_and_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "sparse encoder model"), (2, "model encoder sparse"), (3, None)], "id int, t string")
    got = {r.id: r.v for r in df.select("id", embed(F.col("t")).alias("v")).collect()}
    assert got[1] == got[2] and sum(x * x for x in got[1]) == pytest.approx(1, abs=1e-5) and not any(got[3])
    work = '{"title":["T"],"DOI":"10.1/x","published":{"date-parts":[[2019,5]]},"author":[{"given":"A","family":"B"},{"family":"C"}]}'
    r = spark.createDataFrame([(work,)], "j string").select(read_work(F.col("j")).alias("w")).first().w
    assert (r.title, str(r.published), r.doi, r.authors) == ("T", "2019-05-01", "10.1/x", ["A B", "C"])
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/1706.03762v5</id><title>A\n T</title><published>2017-06-12T00:00:00Z</published><author><name>A B</name></author></entry></feed>'
    e = spark.createDataFrame([(atom,)], "x string").select(read_atom_entry(F.col("x")).alias("e")).first().e
    assert (e.title, str(e.published), e.doi, e.authors, e.arxiv_id) == ("A T", "2017-06-12", "10.48550/arXiv.1706.03762", ["A B"], "1706.03762")
    (tmp_path / "a.pdf").write_bytes(b"abc")
    (tmp_path / "b.txt").write_bytes(b"abc")
    rows = read_files(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and rows[0].doc_id == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
