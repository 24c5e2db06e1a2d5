import datetime
import random

import pytest
from pyspark.sql import functions as F

from vellumspark.llm.queries import p10_found, p10_levels
from vellumspark.llm.reading import BUCKETS, fit, fit_languages, item_table, language_label, length_code, measures, reading_levels, word_code

EASY = "the cat sat on a mat and we saw it run to the red box at noon".split()
HARD = "notwithstanding considerable institutional heterogeneity representational expressiveness systematically presupposes of and the methodological".split()


def corpus(rng):
    rows = []
    for d in range(120):
        ease = d / 120
        sentences = []
        for _ in range(6):
            n = int(6 + 24 * ease)
            sentences.append(" ".join(rng.choice(HARD if rng.random() < ease else EASY) for _ in range(n)).capitalize() + ".")
        rows.append((d, " ".join(sentences)))
    return rows


def levels_of(df, judged):
    items = item_table(df, ["doc_id", "lang"], "text").cache()
    known = item_table(judged, ["level"], "text").select("level", "codes", "tf", "forms")
    return {r.doc_id: r for r in reading_levels(items, ["doc_id"], fit(items, known, "level", *fit_languages(items, "doc_id", "lang"))).collect()}


FRENCH = "Le chat de la maison est dans le jardin avec les amis."


def test_levels_follow_the_mixture_and_agree_with_held_out_judgements(spark):
    rng = random.Random(6)
    rows = corpus(rng)
    judged = [(1 + round(4 * d / 120), t, "r") for d, t in rows if d % 4 == 0] + [(None, "x", "r"), (3, None, "r")]
    more = [(500, None, "en"), (501, "", "en"), (502, "12 34", None), (503, FRENCH, None), *[(600 + i, FRENCH, "fr-XX") for i in range(12)]]
    # every seventh label is wrong or missing
    df = spark.createDataFrame([*[(d, t, ("EN" if d % 7 else ("fr", None)[d % 2])) for d, t in rows], *more], "doc_id bigint, text string, lang string").withColumn("codes_", F.lit("x"))
    got = levels_of(df, spark.createDataFrame(judged, "level int, text string, rater string"))
    held = [(d, got[d].level) for d, _ in rows if d % 4]
    order = sorted(held, key=lambda x: x[1])
    place = {d: i for i, (d, _) in enumerate(order)}
    shift = sum((place[d] - i) ** 2 for i, (d, _) in enumerate(held))
    n = len(held)
    assert 1 - 6 * shift / (n * (n * n - 1)) > 0.95
    assert got[500].level is None and got[501].level is None
    assert got[0].lang == "en" and got[503].lang == "fr" and got[501].n_words == 0


def test_without_judgements_and_without_documents(spark):
    rows = corpus(random.Random(7))[::6]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("lang", F.lit("en"))
    none = spark.createDataFrame([], "level int, text string")
    levels = {k: r.level for k, r in levels_of(df, none).items()}
    assert levels[0] < levels[60] < levels[114]
    assert levels_of(df.limit(0), none) == {}


def test_measures():
    (words, lengths, letters), nothing = measures(["It is a test 3.5 long. Is it?", None])
    assert nothing == ([], [], 0)
    assert words == ["it", "is", "a", "test", "long", "is", "it"] and lengths == [6, 2] and letters == 17
    assert 0 <= word_code("word") < BUCKETS < length_code(1) < length_code(4095) < length_code(4096) == length_code(8191) < length_code(10**9)


def test_labels(spark):
    given = ["en", "EN", " en-XX", "und", "", None, "eng", "zh_Hans", "1"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, x string")
    assert [r.y for r in df.select("i", language_label(F.col("x")).alias("y")).orderBy("i").collect()] == ["en", "en", "en", None, None, None, None, "zh", None]


def test_the_fit_settles(spark):
    df = spark.createDataFrame(corpus(random.Random(9)), "doc_id bigint, text string")
    items = item_table(df, ["doc_id"], "text").cache()
    none = items.limit(0).select(F.lit(1).alias("level"), "codes", "tf", "forms")
    rough, fine = fit(items, none, "level"), fit(items, none, "level", settled=1e-5)
    assert rough.rounds < fine.rounds < 100 and abs(rough.deviation - fine.deviation).max() < 2e-3
    # words of hard texts are harder than their form, those of easy ones are not
    assert fine.deviation[word_code("of")] > fine.deviation[word_code("on")]


def test_bands_are_sides_of_the_scale(spark, tmp_path):
    """A band is the side of 0 that a level lies on; the exact limits only take rows away."""
    now, rng = datetime.datetime(2024, 1, 1), random.Random(2)
    text = lambda words, n: " ".join(" ".join(rng.choice(words) for _ in range(n)).capitalize() + "." for _ in range(15))
    texts = [text(EASY, 6) for _ in range(20)] + [text(EASY, 11) for _ in range(20)] + [text([w for w in HARD if len(w) > 3], 26) for _ in range(20)] + [text(HARD, 19) for _ in range(20)]
    spark.createDataFrame([(i, t, "en", now) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, loaded_at timestamp").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, reader_level int, rater string").write.parquet(f"{tmp_path}/doc_labels.parquet")
    levels = {r.doc_id: r.level for r in p10_levels(spark, str(tmp_path)).collect()}
    assert all((v < 0) == (i < 40) for i, v in levels.items())
    assert max(levels[i] for i in range(20)) < min(levels[i] for i in range(20, 80))
    assert {(r.doc_id, r.band) for r in p10_found(spark, str(tmp_path)).collect()} == {(i, 1) for i in range(20)} | {(i, 3) for i in range(40, 60)}


@pytest.mark.parametrize("others", [[], ["Das ist ein Haus und der Hund ist nicht in dem Garten. " * 9] * 90], ids=["alone", "with foreign documents"])
@pytest.mark.parametrize("band, words, lengths", [(1, EASY, [4, 6, 8]), (3, [w for w in HARD if len(w) > 3], [24, 28, 32])], ids=["all easy", "all hard"])
def test_bands_do_not_hang_on_the_other_documents(spark, tmp_path, band, words, lengths, others):
    rng = random.Random(band)
    sentence = lambda n: " ".join(["the", *(rng.choice(words) for _ in range(n - 1))]).capitalize() + "."
    texts = [" ".join(sentence(lengths[d % 3]) for _ in range(15)) for d in range(60)]
    now = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([(i, t, "en" if i < 60 else "de", now) for i, t in enumerate([*texts, *others])], "doc_id bigint, text string, lang string, loaded_at timestamp").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, reader_level int, rater string").write.parquet(f"{tmp_path}/doc_labels.parquet")
    assert {(r.doc_id, r.band) for r in p10_found(spark, str(tmp_path)).collect()} == {(i, band) for i in range(60)}
