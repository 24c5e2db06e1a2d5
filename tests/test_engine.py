import datetime

import pytest

from vellumspark.operators.engine import SCHEMA, HybridSearchEngine
from vellumspark.operators.filters import SearchFilter
from vellumspark.operators.hybrid import overlap_score
from vellumspark.operators.parsing import parse_documents
from vellumspark.operators.store import Collection


def chunks(spark, *rows):
    return spark.createDataFrame(list(rows), "chunk_id string, content_text string, embed_text string, paper_id string, paper_title string, section_title string, page_numbers array<int>, indexed_at timestamp")


def row(i, text, paper, pages=(1,), day=1):
    return (i, text, f"[Document: T | Section: S | Page 1]\n\n{text}", paper, "T", "S", list(pages), datetime.datetime(2020, 1, day))


def test_index_search_delete(spark, tmp_path):
    engine = HybridSearchEngine(Collection(spark, str(tmp_path / "c"), SCHEMA, ["chunk_id"]), scorer=overlap_score)
    engine.index(chunks(spark, row("a", "sparse encoder for WMT-14", "p1"), row("b", "dense decoder of tables", "p2", (3, 4)), row("c", "sparse encoder and dense decoder", "p2", (5,))))
    engine.index(chunks(spark, row("a", "sparse encoder for WMT-14", "p1", day=2)))
    assert engine.collection.read().count() == 3
    ask = lambda *q: spark.createDataFrame(list(enumerate(q)), "query_id int, query_text string")
    hits = engine.search(ask("sparse encoder WMT-14", "dense decoder", "  "), top_k=2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.chunk_id) for r in hits] == [(0, "a"), (0, "c"), (1, "b"), (1, "c")]
    assert {r.chunk_id for r in engine.search(ask("sparse encoder"), filter_paper_id="p2").collect()} == {"b", "c"}
    assert {r.chunk_id for r in engine.search(ask("encoder"), search_filter=SearchFilter(min_page=5), rerank=False).collect()} == {"c"}
    assert engine.search(ask("encoder"), top_k=0).count() == 0
    with pytest.raises(ValueError):
        engine.search(ask("x"), rrf_k=-1)
    assert engine.delete_paper("p2") == 2 and engine.search(ask("dense decoder")).count() == 1


def test_parse_documents(spark):
    span = lambda t, bold=False, size=10.0: (t, size, "Serif-Bold" if bold else "Serif", 0)
    raw = [
        ("d", "b0", 0, "The Paper", 1, [0.0, 0.0, 9.0, 9.0], [span("The Paper", True, 16.0)]),
        ("d", "b1", 1, "Ann Lee* Bo Ray", 1, [0.0, 50.0, 9.0, 59.0], [span("Ann Lee*", True), span("Bo Ray", True)]),
        ("d", "b2", 2, "arXiv:1706.03762 [cs.CL] 12 Jun 2017", 1, [0.0, 90.0, 9.0, 99.0], [span("arXiv:1706.03762 [cs.CL] 12 Jun 2017")]),
        ("d", "b3", 3, "See doi 10.1145/12345.6 now", 2, [0.0, 0.0, 9.0, 9.0], [span("See doi 10.1145/12345.6 now")]),
    ]
    blocks = spark.createDataFrame(raw, "doc_id string, block_id string, ordinal bigint, text string, page_number int, bbox array<double>, spans array<struct<text:string,font_size:double,font:string,flags:int>>")
    embedded = spark.createDataFrame([("d", "x.PDF", None, 2)], "doc_id string, title string, author string, total_pages int")
    papers, sections, content = parse_documents(blocks, embedded)
    p = papers.first()
    assert (p.title, p.authors, str(p.publication_date), p.doi, p.arxiv_id, p.total_pages) == ("The Paper", ["Ann Lee", "Bo Ray"], "2017-06-12", "10.1145/12345.6", "1706.03762", 2)
    assert sections.count() == 1 and content.count() == 4
    known = spark.createDataFrame([("10.1145/12345.6", "Real Title", ["A B"], None, "10.1145/12345.6")], "doi string, title string, authors array<string>, published date, found_doi string")
    assert parse_documents(blocks, embedded, by_doi=known)[0].first().title == "Real Title"
