"""Boundaries by hand in several scripts, the transducer against a plain walk, and placement."""

import random
import time

import numpy as np
import pytest

from vellumspark.llm.sentences import ANY, ENDS, NEXT, OUT, SYMBOL, chunk_ends, chunk_function, chunk_places, functions_before, sentence_bounds, sentence_ends, states_before

CASES = [
    ["Heading of a section", "\n\n", "It was run at 9 a.m. and 5 p.m. on the sample.", " ", "We thank Dr. Smith and J. K. Rowe."],
    ["The run ended at 5 p.m.", " ", "This layer holds.", " ", "We tried lists, tables, etc.", " ", "The rest is left."],
    ["According to Lin et al. Theorem 24 covers it.", " ", "The U.S. edition (cf. Tab. 8) is v2.1.3.", "\xa0", "See Fig. 3 and Eq. (2)."],
    ['The report says "it is stable." and then turns on.', " ", '"The metric is global."', " ", "This holds.", " ", "“Is it dense?” asks the reviewer."],
    ["(The sample was run on No. 12 of the set.)", "In contrast, it\nfalls to 3.5.", " ", "Is it dense?!", " ", "Yes!"],
    ["The curve rises ... then falls.", " ", "It stays at https://a.invalid/b?c=1 and x.y@z.invalid here."],
    ["Am 3. Mai wurde z. B. die Messung wiederholt.", " ", "Dr. Kel schreibt: „Die Länge ist zu hoch.“", " ", "Laut Abb. 5 sinkt er, d. h. er fällt."],
    ["« Le résultat est stable. »", " ", "Les vecteurs, p. ex. ceux du modèle, restent.", " ", "Pourquoi ?", " ", "On répète."],
    ["¿Por qué cambia?", " ", "¡El índice cabe!", " ", "Según el Sr. Lin, la fig. 4 cae."],
    ["评审说：“模型还不够好。”", "“排序稳定吗？”他问道。", "准确率从7.0升到54.4，语料没有变化。", "向量很长……但是索引很短。", "这个非常重要！"],
    ["査読者は「見出しが足りない。」と書いた。", "「索引は正しいか？」という問いが残る。", "本稿では比較する。", " ", "We end."],
    ["हर वाक्य में एक सूचक होता है।", " ", "डॉ. Lin ने जाँच की।", " ", "क्या यह स्थिर है?"],
    ["يقول د. Lin إن الملخص مستقر.", " ", "لماذا يتغير الملخص؟", " ", "نقارن النموذج."],
    ["เวกเตอร์ดีขึ้น", " ", "ประโยคไม่เปลี่ยนแปลง", "\n\n", "ผลดีขึ้น"],
    ["References", "\n\n", 'J. K. Lin and M. Rowe, "index and query," Proc. Conf. Test Syst., vol. 2, pp. 10–20, 2011.', "\n\n", '[3] P. Kel et al., "Is it. Good," tech. rep., 2015.', "\n", 'Kel, R., Lin, T. and Rowe, L., "A case," J. Test Lett., no. 5, 2016.'],
    ["2. Method", "\n \n", "It grew to 200.", "\n", "The rest fell in\n2018.", "  ", "With that it ends"],
]


@pytest.mark.parametrize("parts", CASES)
def test_boundaries(parts):
    text, want = "", []
    for p in parts:
        text += p
        if not p.isspace():
            want.append(len(text))
    got = sentence_ends([text])[0]
    assert [text[a:b] for a, b in zip([0, *got], got)] == [text[a:b] for a, b in zip([0, *want], want)]


def test_edges_and_batches():
    assert sentence_ends([None, "", "  \n\n ", "a", " a. ", "...", "\n\nx\n\n\n\ny  "]) == [[], [], [], [1], [3], [3], [3, 8]]
    texts = ["".join(c) for c in CASES]
    assert sentence_ends(texts) == [sentence_ends([t])[0] for t in texts]
    long = " ".join(["The layer holds 3.5 points."] * 20_000)
    assert len(sentence_ends([long])[0]) == 20_000


@pytest.mark.parametrize("block", [1, 3, 128])
def test_scan_equals_walk(block):
    rng = random.Random(block)
    symbols = np.array([rng.randrange(1, len(NEXT)) for _ in range(1000)])
    state, walked = OUT, []
    for s in symbols:
        walked.append(state)
        state = NEXT[s][state]
    assert states_before(symbols, block).tolist() == walked
    before, whole = functions_before(symbols[:500], block)
    assert whole[OUT] == walked[500] and states_before(symbols[500:], block, entry=whole[OUT]).tolist() == walked[500:]
    assert NEXT.shape == ENDS.shape and len(SYMBOL) == len(ANY) and min(min(r) for r in SYMBOL) >= 0


LONG = "\n\n".join("".join(c) for c in CASES * 6)


@pytest.mark.parametrize("size", [60, 333, 2_000])
def test_chunks_of_any_length_give_the_same(size):
    state, got, places = OUT, [], chunk_places(LONG, size)
    for i, (low, start, stop, high) in enumerate(places):
        own = LONG[low:high], start - low, None if i + 1 == len(places) else stop - low
        got += [low + e for e in chunk_ends(*own, state)]
        state = chunk_function(*own)[state]
    assert len(places) > 1 and got == sentence_ends([LONG])[0]


@pytest.mark.parametrize("part", ["12. Xyz ", "Foo bar 12. Baz qux ", "1. A\n\n", "“他说。”“", "et al. 2. "])
def test_time_is_linear(part):
    def took(n):
        began = time.process_time()
        sentence_ends([part * n])
        return time.process_time() - began

    took(2_000)
    assert took(80_000) < 10 * max(0.05, took(20_000))


def test_long_texts_go_to_several_tasks(spark):
    rows = [("a", LONG), ("a", LONG), (None, LONG + " More."), ("b", "One. Two."), ("c", "9" * 900), ("d", None)]
    df = spark.createDataFrame(rows, "id string, text string")
    got = sorted(map(tuple, sentence_bounds(df, ["id"], "text", chunk_chars=500).collect()), key=str)
    assert got == sorted(map(tuple, sentence_bounds(df, ["id"], "text").collect()), key=str)
    assert len(got) == 2 * len(sentence_ends([LONG])[0]) + len(sentence_ends([LONG + " More."])[0]) + 3


def test_bounds_in_a_table(spark):
    df = spark.createDataFrame([("a", "One. \U0001f642 Two!  ", 1), ("a", "One. \U0001f642 Two!  ", 1), ("n", None, 1), ("e", "", 1), ("b", " \n", 1)], "id string, text string, n int")
    got = sorted(tuple(r) for r in sentence_bounds(df, ["id"], "text").collect())
    assert got == [("a", 0, 0, 4), ("a", 0, 0, 4), ("a", 1, 5, 11), ("a", 1, 5, 11)]
    assert sentence_bounds(df.limit(0), ["id"], "text").count() == 0
