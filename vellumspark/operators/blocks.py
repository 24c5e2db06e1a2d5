"""BM25 of a table of queries over postings in blocks of chunks: the k best of each query, without listing all pairs of a query and a posting.

A block holds some thousands of chunks: who they are, and of each term the chunks that hold it. A task has a group of
queries and goes through all blocks, so that nothing but the k best of a query leaves it. What a query has found so far
bounds what the next blocks must show: terms that together cannot lift a chunk to the k-th score are looked up only for
chunks that its other terms have lifted far enough, and blocks that cannot are passed over. Results are those of
`bm25.score_queries` with `bm25.rank_hits`.
"""

from __future__ import annotations

import re
from array import array
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from vellumspark.functions.stopwords import SEARCH_STOPWORDS
from vellumspark.functions.text import TERM
from vellumspark.operators.bm25 import K1, B, query_terms, rank_hits
from vellumspark.tables import measured, written

CHUNKS, TOKENS = 1 << 16, 1 << 22  # a block's most; its last chunk may go beyond the tokens
WINDOW = 1.001e-4  # scores that are further apart differ after rounding to 4 places
FEW, MANY = 1_000, 50_000  # terms of a group's queries

# The first row of a block has its chunks and no term, the others one term each; numbers lie in binary columns.
_SCHEMA = "n bigint, tokens bigint, chunk_ids array<string>, papers array<string>, lens binary, pages binary, term string, df bigint, ids binary, tfs binary"
_ARROW = pa.schema(
    [("n", pa.int64()), ("tokens", pa.int64()), ("chunk_ids", pa.list_(pa.string())), ("papers", pa.list_(pa.string())), ("lens", pa.binary()), ("pages", pa.binary()), ("term", pa.string()), ("df", pa.int64()), ("ids", pa.binary()), ("tfs", pa.binary())]
)
_NEVER, _ALWAYS = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def build(chunks: DataFrame, text: str = "embed_text") -> DataFrame:
    """Blocks of current chunks (chunk_id, paper_id, page_numbers, text), written below the checkpoint folder. Chunks without terms count in the corpus."""
    rows = chunks.select("chunk_id", F.lower(text), "paper_id", F.array_min("page_numbers").cast("bigint"), F.array_max("page_numbers").cast("bigint"))
    return written(rows.mapInArrow(_pack, _SCHEMA))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    find = re.compile(TERM).findall
    numbers: dict[str, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    parts, lens, tokens = [], [], array("i")
    for batch in batches:
        begin = 0
        for row, text in enumerate(batch.column(1).to_pylist(), 1):
            found = find(text) if text else ()
            tokens.extend(map(numbers.__getitem__, found))
            lens.append(len(found))
            if len(lens) == CHUNKS or len(tokens) >= TOKENS:
                yield from _block([*parts, batch.slice(begin, row - begin)], lens, tokens, list(numbers))
                parts, lens, tokens, begin = [], [], array("i"), row
                numbers.clear()
        if begin < batch.num_rows:
            parts.append(batch.slice(begin))
    if lens:
        yield from _block(parts, lens, tokens, list(numbers))


def _block(parts: list[pa.RecordBatch], lens: list[int], tokens: array, terms: list[str]) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(parts).combine_chunks()
    whole = lambda i: rows.column(i).combine_chunks().cast(pa.string())
    pages = np.stack([rows.column(3).fill_null(_ALWAYS).to_numpy(), rows.column(4).fill_null(_NEVER).to_numpy()])
    head = {"n": [len(lens)], "tokens": [len(tokens)], "chunk_ids": [whole(0)], "papers": [whole(2)], "lens": [np.array(lens, "<i4").tobytes()], "pages": [pages.astype("<i8").tobytes()]}
    yield _row(head, 1)
    key = np.frombuffer(tokens, np.int32).astype(np.int64) << 16
    key |= np.repeat(np.arange(len(lens)), lens)
    key.sort()
    at = np.flatnonzero(np.diff(key, prepend=-1))
    tfs, key = np.diff(at, append=len(key)).astype("<i4"), key[at]
    ends = np.searchsorted(key >> 16, np.arange(len(terms) + 1))
    cells = lambda x: pa.Array.from_buffers(pa.binary(), len(terms), [None, pa.py_buffer((ends * x.itemsize).astype(np.int32)), pa.py_buffer(x)])
    if terms:
        yield _row({"term": terms, "df": np.diff(ends), "ids": cells((key & 0xFFFF).astype("<u2")), "tfs": cells(tfs)}, len(terms))


def _row(cells: dict, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cells[f.name], f.type) if f.name in cells and not isinstance(cells[f.name], pa.Array) else cells.get(f.name, pa.nulls(n, f.type)) for f in _ARROW], schema=_ARROW)


def best_hits(
    blocks: DataFrame, queries: DataFrame, k: int = 25, query_id: str = "query_id", text: str = "query_text", filter_stopwords: bool = True, k1: float = K1, b: float = B, filters: tuple[Column, Column, Column] | None = None
) -> DataFrame:
    """query_id, chunk_id, score, rank of each query over the chunks of `blocks`. `filters` are columns of the queries (paper, least and greatest page; null doesn't filter): some page of a chunk reaches each bound.

    Chunks and queries without an id are no hits where there are filters, as they join nothing.
    """
    corpus = blocks.where("term is null").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens")).first()
    n, mean = corpus["n"] or 0, (corpus["tokens"] or 0) / (corpus["n"] or 1)
    df = blocks.where("term is not null").groupBy("term").agg(F.sum("df").alias("df"))
    idf = df.select("term", F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    none = F.lit(None)
    paper, least, most = filters or (none, none, none)
    asked = queries.where(F.col(query_id).isNotNull()) if filters else queries
    asked = asked.select(F.col(query_id).alias("query_id"), paper.cast("string").alias("paper"), least.cast("bigint").alias("least"), most.cast("bigint").alias("most"), F.explode(query_terms(F.col(text), SEARCH_STOPWORDS, filter_stopwords)).alias("term"))
    times = asked.groupBy(*asked.columns).agg(F.count(F.lit(1)).alias("times"))
    weighted, seen = measured(times.join(idf, "term").select("query_id", "paper", "least", "most", "term", (F.col("times") * F.col("idf")).alias("weight")), n=F.count(F.lit(1)))
    rows = seen["n"] or 0
    groups = max(1, min(2 * blocks.sparkSession.sparkContext.defaultParallelism, rows // FEW), rows // MANY)
    lying = weighted.repartition(groups, "query_id").sortWithinPartitions("query_id", F.col("weight").desc(), "term")
    files, named = blocks.inputFiles(), filters is not None
    kind = StructType([weighted.schema["query_id"], StructField("chunk_id", StringType()), StructField("raw", DoubleType())])
    return rank_hits(lying.mapInArrow(lambda batches: _search(batches, files, k, k1, b, max(1.0, mean), named), kind), k)


class _Best:
    """A query's hits so far: at least its k best, all that rounding may place among them, and the score below which nothing is."""

    __slots__ = ("names", "scores")

    def __init__(self) -> None:
        self.names, self.scores = np.empty(0, object), np.empty(0)

    def add(self, names: np.ndarray, scores: np.ndarray, k: int) -> float:
        names, scores = np.concatenate((self.names, names)), np.concatenate((self.scores, scores))
        least = _least(scores, k)
        if least > 0:
            keep = scores >= least
            names, scores = names[keep], scores[keep]
            if len(scores) > 4 * k:  # of equal scores none but the first k can be wanted
                order = sorted(range(len(scores)), key=lambda i: (-scores[i], names[i] is None, (names[i] or "").encode()))
                same = np.cumsum(np.diff(scores[order], prepend=np.inf) != 0)
                order = np.array(order)[np.arange(len(order)) - np.searchsorted(same, same) < k]
                names, scores = names[order], scores[order]
        self.names, self.scores = names, scores
        return least


def _least(scores: np.ndarray, k: int) -> float:
    return np.partition(scores, len(scores) - k)[len(scores) - k] - WINDOW if len(scores) >= k else 0.0


def _read(files: Sequence[str], wanted: pa.Array) -> Iterator[tuple[dict, list[str], list, list]]:
    """Of each block the first row, and the terms among `wanted` with numbers of chunks and of occurrences."""
    from pyarrow.fs import FileSystem

    for file in files:
        system, path = FileSystem.from_uri(file.replace("s3a:", "s3:", 1))
        with system.open_input_file(path) as source:
            table = pq.ParquetFile(source).read()
        heads = np.flatnonzero(pc.is_null(table.column("term")).to_numpy())
        use = pc.is_in(table.column("term"), value_set=wanted).to_numpy()
        use[heads] = False
        for begin, end in zip(heads.tolist(), [*heads[1:].tolist(), table.num_rows], strict=True):
            found = table.select(["term", "ids", "tfs"]).slice(begin, end - begin).filter(pa.array(use[begin:end]))
            head = table.select(["chunk_ids", "papers", "lens", "pages"]).slice(begin, 1)
            yield {c: head.column(c)[0] for c in head.column_names}, found.column("term").to_pylist(), found.column("ids").to_pylist(), found.column("tfs").to_pylist()


def _search(batches: Iterator[pa.RecordBatch], files: Sequence[str], k: int, k1: float, b: float, mean: float, named: bool) -> Iterator[pa.RecordBatch]:
    """query_id, chunk_id, raw of the hits that may be among a query's k best; rows (query_id, paper, least, most, term, weight) lie by query, heaviest terms first."""
    batches = [x for x in batches if x.num_rows]
    if not batches or k < 1:
        return
    rows = pa.Table.from_batches(batches).combine_chunks()
    code = lambda c: rows.column(c).combine_chunks().dictionary_encode()
    starts = np.flatnonzero(np.diff(code("query_id").indices.fill_null(-1).to_numpy(), prepend=-2))
    first = rows.take(pa.array(starts))
    papers, least, most = (first.column(c).to_pylist() for c in ("paper", "least", "most"))
    bounds, terms, weight = [*starts.tolist(), rows.num_rows], code("term"), rows.column("weight").to_numpy()
    term, wanted = terms.indices.to_numpy(), terms.dictionary
    number = {t: i for i, t in enumerate(wanted.to_pylist())}
    weights, term_of = weight.tolist(), term.tolist()
    best, floor = [_Best() for _ in starts], np.zeros(len(starts))
    for head, names, ids, tfs in _read(files, wanted):
        lens = np.frombuffer(head["lens"].as_py(), "<i4")
        length = k1 * (1 - b + b * lens / mean)
        where: list = [None] * len(number)
        what: list = [None] * len(number)
        top = np.zeros(len(number))
        for t, i, f in zip(names, ids, tfs, strict=True):
            i, f = np.frombuffer(i, "<u2").astype(np.intp), np.frombuffer(f, "<i4").astype(np.float64)
            where[number[t]], what[number[t]] = i, f * (k1 + 1) / (f + length[i])
            top[number[t]] = what[number[t]].max()
        chunk_ids = np.array(head["chunk_ids"].as_py(), object)
        allowed = _Allowed(head, chunk_ids, named)
        bound = top[term] * weight
        sums = np.add.reduceat(bound, starts)
        bound, acc = bound.tolist(), np.empty(len(lens))
        for q in np.flatnonzero((sums > 0) & (sums >= floor)).tolist():
            paper = allowed.paper(papers[q]) if papers[q] is not None else None
            if paper is not None and not len(paper):
                continue
            low, rest, r, end = floor[q], sums[q], bounds[q], bounds[q + 1]
            acc.fill(0)
            while r < end and rest >= low:
                if bound[r]:
                    t = term_of[r]
                    acc[where[t]] += weights[r] * what[t]
                    rest -= bound[r]
                r += 1
            enough = max(low - (rest if r < end else 0) - 1e-9, 1e-300)
            at = np.flatnonzero(acc >= enough) if paper is None else paper[acc[paper] >= enough]
            if named:
                at = allowed.pages(at, least[q], most[q])
            score = acc[at]
            for r in range(r, end):
                if not len(at):
                    break
                if bound[r]:
                    t = term_of[r]
                    place = np.minimum(np.searchsorted(where[t], at), len(where[t]) - 1)
                    score += np.where(where[t][place] == at, weights[r] * what[t][place], 0.0)
            low = max(low, _least(score, k))
            at, score = at[score >= low], score[score >= low]
            if len(at):
                floor[q] = max(low, best[q].add(chunk_ids[at], score, k))
    ids = first.column("query_id").combine_chunks()
    for begin in range(0, len(best), 1000):
        some = best[begin : begin + 1000]
        of = np.repeat(np.arange(begin, begin + len(some)), [len(x.scores) for x in some])
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(of)), pa.array(np.concatenate([x.names for x in some]), pa.string()), pa.array(np.concatenate([x.scores for x in some]))], names=["query_id", "chunk_id", "raw"])


class _Allowed:
    """Which chunks of a block a query's filters let through."""

    def __init__(self, head: dict, chunk_ids: np.ndarray, named: bool):
        self.kept: dict = {}
        if named:
            coded = head["papers"].values.dictionary_encode()
            self.codes, self.names = coded.indices.fill_null(-1).to_numpy(), {x: i for i, x in enumerate(coded.dictionary.to_pylist())}
            self.first, self.last = np.frombuffer(head["pages"].as_py(), "<i8").reshape(2, -1)
            self.known = None if all(x is not None for x in chunk_ids) else np.array([x is not None for x in chunk_ids])

    def paper(self, name: str) -> np.ndarray:
        if name not in self.kept:
            self.kept[name] = np.flatnonzero(self.codes == self.names[name]) if name in self.names else np.empty(0, np.intp)
        return self.kept[name]

    def pages(self, at: np.ndarray, least: int | None, most: int | None) -> np.ndarray:
        if self.known is not None:
            at = at[self.known[at]]
        if least is not None:
            at = at[(self.last[at] >= least) & (self.last[at] != _NEVER)]
        if most is not None:
            at = at[(self.first[at] <= most) & (self.first[at] != _ALWAYS)]
        return at
