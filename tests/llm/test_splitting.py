import random
import time

import pytest

from vellumspark.llm.splitting import Limits, oversized, pieces_hold, split_items, split_text


def tokens(t):
    n = len(t.split())
    return 0 if not n else max(1, n * 13 // 10)


def prose(rng, words):
    out = []
    while words > 0:
        n = rng.randrange(4, 25)
        out.append(" ".join("w" * rng.randrange(1, 9) for _ in range(n)).capitalize() + ".")
        words -= n
    return out


def texts():
    rng = random.Random(1)
    yield "\n\n".join(" ".join(prose(rng, 80)) for _ in range(12))
    yield " ".join(prose(rng, 900))
    yield "\n".join(f"- item {i} " + "x " * 30 for i in range(40))
    yield "# A\n\n" + " ".join(prose(rng, 300)) + "\n\n## B\n\n" + " ".join(prose(rng, 100)) + "\n\n# C\n\n" + " ".join(prose(rng, 400))
    yield "|".join(f"{i}.{i % 7}" for i in range(3000))
    yield "เวกเตอร์" * 900
    yield "准确率从七升到五，语料没有变化。" * 400
    yield "a" * 10_000
    yield "é" * 6000
    yield "a " * 5000
    yield " " * 5000
    yield "word\xa0" * 400
    yield ", ".join(["clause of words"] * 400)


@pytest.mark.parametrize("n,text", list(enumerate(texts())))
@pytest.mark.parametrize("limits", [Limits(), Limits(tokens=60, chars=500, overlap_tokens=10), Limits(overlap_tokens=0)])
def test_pieces_keep_the_limits_tile_the_text_and_overlap(n, text, limits):
    pieces = split_text(text, limits)
    assert len(pieces) > 1 and oversized(text, limits)
    assert "".join(text[b:c] for _, b, c in pieces) == text
    for i, (a, b, c) in enumerate(pieces):
        assert a <= b < c and tokens(text[a:c]) <= limits.tokens and c - a <= limits.chars
        if i and limits.overlap_tokens:
            least = pieces[i - 1][1]
            assert a >= least and (a == least or tokens(text[a:b]) >= 0.4 * limits.overlap_tokens or b - a >= 0.4 * limits.overlap_chars or not text[a:b].strip())
            assert tokens(text[a:b]) <= limits.overlap_tokens and b - a <= limits.overlap_chars
        else:
            assert a == b


def test_natural_places():
    rng = random.Random(2)
    paragraphs = [" ".join(prose(rng, 60)) + "\n\n" for _ in range(12)]
    starts = {sum(map(len, paragraphs[:i])) for i in range(13)}
    assert all(b in starts for _, b, _ in split_text("".join(paragraphs)))
    sentences = [s + " " for s in prose(rng, 900)]
    starts = {sum(map(len, sentences[:i])) for i in range(len(sentences) + 1)}
    assert all(b in starts and a in starts for a, b, _ in split_text("".join(sentences)))


def test_siblings_alone_are_merged():
    rng = random.Random(3)
    a, b = "# A\n\n" + " ".join(prose(rng, 330)) + "\n\n", "## B\n\n" + " ".join(prose(rng, 30)) + "\n\n"
    c, d = "# C\n\n" + " ".join(prose(rng, 40)) + "\n\n", "# D\n\n" + " ".join(prose(rng, 40)) + "\n\n"
    text = a + b + c + d
    new = [(x, y) for _, x, y in split_text(text)]
    starts = [x for x, _ in new]
    assert len(a) in starts and len(a + b) in starts and new[-1] == (len(a + b), len(text))


def test_deep_nesting_takes_linear_time():
    def took(depth):
        text = "".join(f"{'.'.join(['1'] * (i % 40 + 1))} Head of part\n\n" + "word " * 60 + "\n\n" for i in range(depth))
        began = time.process_time()
        pieces = split_text(text)
        assert "".join(text[b:c] for _, b, c in pieces) == text
        return time.process_time() - began

    nested = "".join(f"{'.'.join(['1'] * (i + 1))} Head\n\nbody of it\n\n" for i in range(1500))
    began = time.process_time()
    assert "".join(nested[b:c] for _, b, c in split_text(nested)) == nested
    assert time.process_time() - began < 20
    took(200)
    assert took(8_000) < 10 * max(0.05, took(2_000))


def test_limits_are_exact():
    assert split_text(" ".join(["w"] * 231)) == [(0, 0, 461)]
    assert len(split_text(" ".join(["w"] * 232))) == 2
    assert split_text("w" * 2400) == [(0, 0, 2400)] and len(split_text("w" * 2401)) == 2


def test_table(spark):
    df = spark.createDataFrame([("a", "short", 1), ("b", "x " * 400, 1), ("b", "x " * 400, 1), ("c", None, 1), ("d", "", 1)], "id string, t string, n int")
    got = split_items(df, ["id"], "t").collect()
    assert sorted((r.id, r.n) for r in got) == [("a", 0), *sorted([("b", i) for i in range(3)] * 2)]
    for r in got:
        assert r.piece == {"a": "short", "b": "x " * 400}[r.id][r.start_char : r.end_char]
    assert split_items(df.limit(0), ["id"], "t").count() == 0
    assert {tuple(r) for r in pieces_hold(df, ["id"], "t").collect()} == {("a", True, True, True), ("b", True, True, True)}
