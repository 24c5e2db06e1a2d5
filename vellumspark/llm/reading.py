"""Reading level by a Rasch-style latent difficulty model, fitted over the whole corpus.

Items are words and, for what sentences ask of a reader, sentences by their length. Document d has a level t_d, item w a
difficulty b_w, and each occurrence is a half-success of a Rasch trial between the two: a reader of just that level would
follow the item as often as not. The log-likelihood is

    sum over occurrences of  (log logistic(t_d - b_w) + log logistic(b_w - t_d)) / 2

with b_w = r_w + u_w (the linear logistic test model): r_w is what the item's form suggests, letters of a word or words of
a sentence, and u_w how much more difficult it is than that. Each occurrence also meets r_w itself FORM_WEIGHT times, so
form keeps the same say whatever the size of the corpus. The sum is concave in levels and difficulties together; they are
found in turn until they settle (alternating maximisation), one pass over all documents a round.

The scale is absolute: a text of EASY_TEXT (words a sentence, letters a word) has form -HALF_RANGE, one of HARD_TEXT has
+HALF_RANGE, and readers' judgements set how much sentences weigh against words.

Items are numbered by hashing into BUCKETS, so what tasks share is a table of that size however many words there are;
items of one bucket have their own r_w and share u_w. The language of a text is told by a naive Bayes classifier over the
same numbers, fitted on the labels that documents bear.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumspark.llm.sentences import sentence_ends

LETTERS = re.compile(r"[^\W\d_]+")
#: Numbers of words; sentences up to LENGTHS words have one for each length, longer ones one for each doubling.
BUCKETS, LENGTHS = 1 << 20, 1 << 12
#: Words share their number for languages with the three next to it.
LANGUAGE_SHIFT = 2
#: (words a sentence, letters a word) of the texts that fix the scale, and their distance from its middle in logits.
EASY_TEXT, HARD_TEXT, HALF_RANGE = (10.0, 3.8), (21.0, 8.5), 0.5
#: How often each occurrence meets its form, besides its document.
FORM_WEIGHT = 2.0
#: Rounds end when no difficulty moves more than this.
SETTLED = 1e-3
MOST_ROUNDS = 100
#: Labelled documents that the languages are learnt from, about; and how many a language must have among them.
LABELLED, LEAST_LABELLED = 50_000, 10
KNOWN_WORDS = 500_000

MEASURES = "n_words bigint, words_per_sentence double, letters_per_word double"
ITEMS = "codes array<int>, tf array<float>, forms array<float>"


def measures(texts: Sequence[str | None]) -> Iterator[tuple[list[str], list[int], int]]:
    """For each text its lower-case runs of letters; the words between blanks of each sentence; letters."""
    for text, ends in zip(texts, sentence_ends(texts), strict=True):
        if not text:
            yield [], [], 0
            continue
        lengths, at = [], 0
        for e in ends:
            lengths.append(len(text[at:e].split()))
            at = e
        runs = LETTERS.findall(text)
        yield [w.lower() for w in runs], lengths, sum(map(len, runs))


def word_code(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS


def length_code(words: int) -> int:
    return BUCKETS + (words if words < LENGTHS else LENGTHS + int(math.log2(words)))


def _place(value: float, easy: float, hard: float) -> float:
    """-1 at the easy text's value, 1 at the hard one's."""
    return (2 * value - easy - hard) / (hard - easy)


def word_form(letters: int) -> float:
    return _place(letters, EASY_TEXT[1], HARD_TEXT[1])


def length_form(words: int) -> float:
    return _place(words, EASY_TEXT[0], HARD_TEXT[0])


def item_table(corpus: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """keys, codes, tf, forms, n_words, words_per_sentence, letters_per_word: what all later passes need of the texts, so that these are read once.

    One entry for each different word with its occurrences, and for each length of sentence; all sentences together weigh
    as much as all words. Null and empty texts have no entries.
    """
    struct = ", ".join((ITEMS, MEASURES)).replace(" ", ":").replace(",:", ",")

    @F.arrow_udf(f"struct<{struct}>")
    def look(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, int] = {}
        for column in batches:
            codes, tf, forms, sizes, counts, lengths_, letters_ = [], [], [], [0], [], [], []
            if len(known) > KNOWN_WORDS:
                known.clear()
            texts = column.to_pylist()
            for t, (words, lengths, letters) in zip(texts, measures(texts), strict=True):
                for w, c in Counter(words).items():
                    code = known.get(w)
                    if code is None:
                        code = known[w] = word_code(w)
                    codes.append(code)
                    tf.append(c)
                    forms.append(word_form(len(w)))
                lengths = [n for n in lengths if n]
                share = len(words) / len(lengths) if lengths else 0
                if share:
                    for n, c in Counter(lengths).items():
                        codes.append(length_code(n))
                        tf.append(c * share)
                        forms.append(length_form(n))
                sizes.append(len(codes))
                n = len(t.split()) if t else 0
                counts.append(n)
                lengths_.append(n / len(lengths) if lengths else None)
                letters_.append(letters / len(words) if words else None)
            offsets = pa.array(sizes, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(values, kind)) for values, kind in ((codes, pa.int32()), (tf, pa.float32()), (forms, pa.float32()))]
            yield pa.StructArray.from_arrays([*lists, pa.array(counts, pa.int64()), pa.array(lengths_, pa.float64()), pa.array(letters_, pa.float64())], ["codes", "tf", "forms", "n_words", "words_per_sentence", "letters_per_word"])

    return corpus.select(*keys, look(F.col(text)).alias("_r")).select(*keys, "_r.*")


class _Batch:
    """Entries of many documents: `code`, `tf`, `form` of each, and `row` its document."""

    def __init__(self, codes: pa.ListArray, tf: pa.ListArray, forms: pa.ListArray):
        self.sizes = np.asarray(pc.fill_null(pc.list_value_length(codes), 0), dtype=np.int64)
        self.code, self.tf, self.form = np.asarray(codes.flatten(), dtype=np.int64), np.asarray(tf.flatten(), dtype=float), np.asarray(forms.flatten(), dtype=float)
        self.row = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.is_word = self.code < BUCKETS

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, values, len(self.sizes))


class Model:
    """Weights of words and sentences (2 together), deviations of items from their form, and languages with their logarithms of word shares."""

    def __init__(self, weights: tuple[float, float], languages: Sequence[str] = (), shares: np.ndarray | None = None):
        self.weights, self.languages, self.shares = weights, list(languages), shares
        self.deviation = np.zeros(BUCKETS + LENGTHS + 64, np.float32)
        self.rounds = 0

    def difficulties(self, b: _Batch) -> np.ndarray:
        return HALF_RANGE * b.form * np.where(b.is_word, *self.weights) + self.deviation[b.code]

    def levels(self, b: _Batch) -> tuple[np.ndarray, np.ndarray]:
        """The documents' levels, the maxima for these difficulties, by Newton steps until they settle; and the difficulty of each entry. NaN without items."""
        d, total = self.difficulties(b), b.sums(b.tf)
        with np.errstate(invalid="ignore", divide="ignore"):
            t = np.where(total > 0, b.sums(b.tf * d) / total, 0.0)
        for _ in range(50):
            h = np.tanh((t[b.row] - d) / 2)
            step = np.clip(b.sums(b.tf * h) / np.maximum(1e-9, b.sums(b.tf * (1 - h * h)) / 2), -1.0, 1.0)
            t -= step
            if np.abs(step).max(initial=0) < 1e-7:
                break
        return np.where(total > 0, t, np.nan), d

    def language(self, b: _Batch) -> list[str | None]:
        """The language in which each document's words are most likely; None without words that tell."""
        if not self.languages:
            return [None] * len(b.sizes)
        at = b.is_word
        evidence = self.shares[:, b.code[at] >> LANGUAGE_SHIFT] * b.tf[at]
        scores = np.array([np.bincount(b.row[at], e, len(b.sizes)) for e in evidence])
        some = np.bincount(b.row[at], minlength=len(b.sizes)) > 0
        return [self.languages[i] if s else None for i, s in zip(scores.argmax(axis=0), some & (scores.max(axis=0) > scores.min(axis=0) if len(scores) > 1 else True), strict=True)]


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, _Batch]]:
    for batch in batches:
        if batch.num_rows:
            yield batch, _Batch(*(batch.column(batch.schema.get_field_index(n)) for n in ("codes", "tf", "forms")))


def _form_means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mean forms of a judged document's words and sentences, with the judgement."""
    for batch, b in _batches(batches):
        means = []
        for at in (b.is_word, ~b.is_word):
            means.append(b.sums(b.tf * b.form * at) / np.maximum(1e-9, b.sums(b.tf * at)))
        yield pa.record_batch([*[pa.array(m) for m in means], batch.column(0).cast(pa.float64())], names=["a", "b", "y"])


def _emitted(names: Sequence[str], sums: Sequence[np.ndarray]) -> pa.RecordBatch:
    at = np.flatnonzero(np.abs(sums[-1]) > 0)
    return pa.record_batch([pa.array(at, pa.int64()), *[pa.array(s[at]) for s in sums]], names=["code", *names])


def _deviation_sums(model):
    """For each number: sums over its occurrences of the push from its documents' levels and of the slope; one row for each number a task has met."""

    def run(batches):
        m = model.value
        push, slope = np.zeros((2, len(m.deviation)))
        for _, b in _batches(batches):
            t, d = m.levels(b)
            h = np.tanh((d - t[b.row]) / 2)
            own = np.tanh(m.deviation[b.code] / 2)
            push += np.bincount(b.code, b.tf * (h + FORM_WEIGHT * own), len(push))
            slope += np.bincount(b.code, b.tf * ((1 - h * h) + FORM_WEIGHT * (1 - own * own)) / 2, len(push))
        yield _emitted(("push", "slope"), (push, slope))

    return run


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of each word number under each label."""
    counts: dict[str, np.ndarray] = {}
    size = BUCKETS >> LANGUAGE_SHIFT
    for batch, b in _batches(batches):
        labels = np.array(batch.column(0).to_pylist(), dtype=object)[b.row]
        for label in set(labels[b.is_word]):
            at = b.is_word & (labels == label)
            counts[label] = counts.get(label, 0) + np.bincount(b.code[at] >> LANGUAGE_SHIFT, b.tf[at], size)
    for label, sums in counts.items():
        part = _emitted(("n",), (sums,))
        yield part.append_column("label", pa.array([label] * part.num_rows, pa.string()))


def language_label(label: Column) -> Column:
    """The two letters that a label begins with, in lower case; null for none and for 'und'."""
    low = F.lower(F.trim(label))
    return F.when(~low.startswith("und"), F.nullif(F.regexp_extract(low, "^([a-z]{2})(?:[^a-z]|$)", 1), F.lit("")))


def fit_languages(items: DataFrame, key: str, label: str, labelled: int = LABELLED, least: int = LEAST_LABELLED) -> tuple[list[str], np.ndarray | None]:
    """Languages that at least `least` of about `labelled` labelled documents bear, and the logarithm of each word number's share in each.

    Wrong labels are outvoted: shares are smoothed by the word's share in all languages together.
    """
    rows = items.withColumn("_l", language_label(F.col(label))).where("_l is not null and size(codes) > 0")
    n = rows.count()
    if n > labelled:
        rows = rows.where(F.pmod(F.xxhash64(F.col(key)), F.lit(1_000_000)) < math.ceil(1_000_000 * labelled / n))
    known = sorted(r[0] for r in rows.groupBy("_l").count().where(F.col("count") >= least).collect())  # labels of two letters
    if not known:
        return [], None
    counted = rows.where(F.col("_l").isin(known)).select("_l", "codes", "tf", "forms").mapInArrow(_word_counts, "code long, n double, label string").groupBy("label", "code").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(known), BUCKETS >> LANGUAGE_SHIFT))
    at = np.array([known.index(x) for x in counted.column("label").to_pylist()], dtype=np.int64)
    counts[at, counted.column("code").to_numpy()] = counted.column("n").to_numpy()
    share = counts / counts.sum(axis=1, keepdims=True)
    return known, np.log(0.95 * share + 0.05 * share.mean(axis=0) + 1e-9).astype(np.float32)


def fit(items: DataFrame, judged: DataFrame, level: str, languages: Sequence[str] = (), shares: np.ndarray | None = None, settled: float = SETTLED) -> Model:
    """Weights from all judged rows, then alternation over all documents until no deviation moves more than `settled`.

    `items` is an item_table that is cheap to read again; `judged` has `level` and the items. Null levels are left out.
    Without 20 judgements words and sentences weigh the same. What reaches the driver is one row for each number.
    """
    context = items.sparkSession.sparkContext
    rows = judged.where(F.col(level).isNotNull() & (F.size("codes") > 0)).select(F.col(level).cast("double").alias("_y"), "codes", "tf", "forms").mapInArrow(_form_means, "a double, b double, y double")
    sums = rows.agg(F.count(F.lit(1)), *[F.sum(x) for x in "aby"], *[F.sum(F.col(x) * F.col(z)) for x in "ab" for z in "aby"]).first()
    weights = (1.0, 1.0)
    if sums[0] >= 20:
        count, mean = sums[0], np.array(sums[1:4]) / sums[0]
        cross = np.array(sums[4:]).reshape(2, 3) / count - np.outer(mean[:2], mean)
        slopes = np.linalg.solve(cross[:, :2] + 1e-3 * np.eye(2), cross[:, 2])
        # more letters and longer sentences never make a text easier, and neither is left out
        slopes = np.maximum(slopes, 0.25 * max(slopes.max(), 1e-6))
        weights = tuple((2 * slopes / slopes.sum()).tolist())
    model = Model(weights, languages, shares)
    moved = math.inf
    while moved > settled and model.rounds < MOST_ROUNDS:
        shared = context.broadcast(model)
        found = items.select("codes", "tf", "forms").mapInArrow(_deviation_sums(shared), "code long, push double, slope double").groupBy("code").agg(F.sum("push").alias("push"), F.sum("slope").alias("slope")).toArrow()
        shared.unpersist()
        step = np.clip(found.column("push").to_numpy() / found.column("slope").to_numpy(), -1.0, 1.0)
        model.deviation[found.column("code").to_numpy()] -= step
        moved, model.rounds = float(np.abs(step).max(initial=0)), model.rounds + 1
    return model


def reading_levels(items: DataFrame, keys: Sequence[str], model: Model) -> DataFrame:
    """keys, level, lang, n_words, words_per_sentence, letters_per_word: one row for each row of `items`.

    level is null for null texts and texts without words, below 0 for texts that are nearer to EASY_TEXT than to
    HARD_TEXT; lang is null where no word tells.
    """
    shared = items.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<level:double,lang:string>")
    def look(codes: pa.Array, tf: pa.Array, forms: pa.Array) -> pa.Array:
        b = _Batch(codes, tf, forms)
        found = np.round(shared.value.levels(b)[0], 6)
        return pa.StructArray.from_arrays([pa.array(found, pa.float64(), mask=np.isnan(found)), pa.array(shared.value.language(b), pa.string())], ["level", "lang"])

    return items.select(*keys, look("codes", "tf", "forms").alias("_f"), "n_words", "words_per_sentence", "letters_per_word").select(*keys, "_f.level", "_f.lang", "n_words", "words_per_sentence", "letters_per_word")
