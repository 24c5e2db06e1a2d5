"""What a language model or a service plugs into, and word vectors as a model."""

import random

import pytest
from pyspark.sql import functions as F

from vellumspark.functions import annotate as an
from vellumspark.functions.prose import is_prose, lemmas, prose_sentences, without_stopwords
from vellumspark.functions.stopwords import GENERAL_STOPWORDS, SEARCH_STOPWORDS
from vellumspark.functions.text import tokenize
from vellumspark.operators import indexing, store, word2vec
from vellumspark.operators.keywords import document_keywords
from vellumspark.operators.summary import summarise
from vellumspark.sources.records import fetch_records


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("x")).first().x


def test_general_stop_words(spark):
    assert one(spark, "However the model and whereas a paper shows This toward us", without_stopwords(tokenize(F.col("t")))) == ["model", "paper", "shows"]
    assert {"model", "paper", "find"} & {*SEARCH_STOPWORDS} and not {"model", "paper", "find", "theirs"} & {*GENERAL_STOPWORDS}
    assert len(GENERAL_STOPWORDS) == 305 and {"show", "whereupon", "us", "the"} < {*GENERAL_STOPWORDS}
    assert one(spark, "The models found", lemmas(F.col("t"), lemma=lambda t: F.regexp_replace(t, "s$", ""))) == ["model", "found"]


def test_annotated_text_by_rule(spark):
    doc = one(spark, "The Cats sat. A dog!", an.annotate(F.col("t"), lemma=lambda t: F.regexp_replace(t, "s$", "")))
    assert [[(t.text, t.stop, t.punct) for t in s] for s in doc] == [[("The", True, False), ("Cats", False, False), ("sat", False, False), (".", False, True)], [("A", True, False), ("dog", False, False), ("!", False, True)]]
    first = F.get(an.annotate(F.col("t"), lemma=lambda t: F.regexp_replace(t, "s$", "")), F.lit(0))
    assert one(spark, "The Cats sat.", F.transform(an.without_stops(first), lambda t: t["text"])) == ["Cats", "sat", "."]
    assert one(spark, "The Cats sat.", an.token_lemmas(first)) == ["The", "Cat", "sat", "."]
    assert one(spark, "The Cats sat.", an.clean_lemmas(first)) == ["cat", "sat"]
    assert one(spark, None, an.annotate(F.col("t"))) == []


def test_annotated_text_by_a_model(spark):
    def model():  # workers can't import this module
        def run(texts):
            token = lambda w: {"text": w, "lemma": w.lower(), "pos": "VERB" if w.endswith("s") else "NOUN", "stop": False, "punct": False, "space": False}
            return [[[token(w) for w in s.split()] for s in t.split("|") if s] for t in texts]

        return run

    rows = spark.createDataFrame([("Dog runs|Blue sky",), (None,)], "t string").select(an.annotate_with(F.col("t"), model).alias("d"))
    got = [r.x for r in rows.select(F.transform("d", lambda s: F.struct(an.sentence_text(s).alias("s"), an.has_verb(s).alias("v"))).alias("x")).collect()]
    assert [[tuple(s) for s in d] for d in got] == [[("Dog runs", True), ("Blue sky", False)], []]


def test_verbs_and_sentences_of_a_model_reach_prose_and_summaries(spark):
    has_verb = lambda s: F.contains(s, F.lit(" is "))
    assert one(spark, "This encoder is good here. Plain noun phrase only.", prose_sentences(F.col("t"), has_verb)) == ["This encoder is good here."]
    assert one(spark, "Plain noun phrase", is_prose(F.col("t"))) and not one(spark, "Plain noun phrase", is_prose(F.col("t"), has_verb))
    paragraphs = spark.createDataFrame([("d", "Abstract", 1, "Sparse encoders rank documents; Dense encoders is better.")], "doc_id string, title string, ordinal bigint, text string")
    split = lambda t: F.split(t, "; ")
    assert summarise(paragraphs, has_verb=has_verb, split=split).first().summary == "Dense encoders is better."
    words = {r.term for r in document_keywords(paragraphs, lemma=lambda t: F.regexp_replace(t, "s$", "")).collect()}
    assert {"encoder", "document"} <= words and "encoders" not in words


def sentences(spark, n=400):
    rng = random.Random(3)
    topics = ["cat dog pet fur paw tail".split(), "bond stock fund bank loan rate".split()]
    return spark.createDataFrame([([rng.choice(topics[i % 2]) for _ in range(8)],) for i in range(n)], "tokens array<string>")


@pytest.mark.parametrize("partitions", [1, 3])
def test_cbow_and_look_ups(spark, tmp_path, partitions):
    made = word2vec.WordVectors.train(sentences(spark).unionByName(spark.createDataFrame([(["once"],), (None,), ([],)], "tokens array<string>")), size=16, epochs=12, partitions=partitions)
    assert made.vocab_size() == 12 and made.architecture_name == "cbow" and made.has_word("Cat") and not made.has_word("once")
    assert [r.word for r in made.vocabulary().limit(2).collect()] == ["bank", "bond"] and len(made.get_vector("dog")) == 16
    assert made.similarity("cat", "dog") > made.similarity("cat", "bank") + 0.2
    assert {r.word for r in made.most_similar(["cat"], k=3).collect()} <= {"dog", "pet", "fur", "paw", "tail"}
    with pytest.raises(KeyError):
        made.get_vector("once")
    if partitions == 1:
        made.save(str(tmp_path / "new" / "w"))
        again = word2vec.WordVectors.load(spark, str(tmp_path / "new" / "w"))
        assert again.get_vector("dog") == made.get_vector("dog") and again.architecture_name == "cbow"
        with pytest.raises(FileNotFoundError):
            word2vec.WordVectors.load(spark, str(tmp_path / "none"))
        with pytest.raises(ValueError):
            word2vec.WordVectors.train(sentences(spark).limit(0))
        with pytest.raises(ValueError):
            word2vec.WordVectors.train(sentences(spark), architecture="x")


def test_sentence_similarity_and_totals(spark):
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "word string, vector array<double>")
    pairs = spark.createDataFrame([(1, ["a"], ["A", "zz"]), (2, ["a"], ["b"]), (3, ["zz"], ["a"])], "id int, a array<string>, b array<string>")
    assert {r.id: r.similarity for r in word2vec.sentence_similarity(pairs, vectors, 2).collect()} == {1: 1.0, 2: 0.0, 3: 0.0}
    lists = spark.createDataFrame([(["a", "b"],), (["a"],), ([],)], "tokens array<string>")
    assert tuple(word2vec.corpus_totals(lists).first()) == (3, 3, 2) and tuple(word2vec.corpus_totals(lists.limit(0)).first()) == (0, 0, 0)


def test_documents_are_parsed_embedded_and_stored(spark, tmp_path):
    span = lambda t, bold: (t, 12.0 if bold else 10.0, "Serif-Bold" if bold else "Serif", 0)
    texts = [("1 Method", True), ("We train a sparse encoder on the large collection today.", False), ("Too short to keep.", False)]
    raw = spark.createDataFrame([("d", f"b{i}", i, t, 1, [0.0, 80.0 * i, 9.0, 80.0 * i + 9], [span(t, b)]) for i, (t, b) in enumerate(texts)], "doc_id string, block_id string, ordinal bigint, text string, page_number int, bbox array<double>, spans array<struct<text:string,font_size:double,font:string,flags:int>>")
    embedded = spark.createDataFrame([("d", "A Title", "Ann Lee", 1)], "doc_id string, title string, author string, total_pages int")
    kept = store.Collection(spark, str(tmp_path / "c"), indexing.SCHEMA, ["paper_id", "block_id"], buckets=2)
    assert indexing.index_documents(raw, embedded, kept) == 1 and indexing.index_documents(raw, embedded, kept) == 1
    row = kept.read().collect()
    assert len(row) == 1 and (row[0].paper_id, row[0].block_id, row[0].section_title, row[0].metadata["paper_title"]) == ("a_title", "b1", "1 Method", "A Title") and len(row[0].embedding) == 64


def test_records_are_fetched_in_batches(spark):
    answers = lambda: lambda addresses: [None if a.endswith("10.9/none") else f"<{a}>" for a in addresses]
    keys = spark.createDataFrame([("10.1/a b",), ("10.1/a b",), (None,), ("",), ("10.9/none",)], "doi string")
    assert [tuple(r) for r in fetch_records(keys, "doi", "https://x.invalid/{}", answers).collect()] == [("10.1/a b", "<https://x.invalid/10.1/a%20b>")]
