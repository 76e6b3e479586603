"""Ranked lexical search: an inverted index in shards of documents, and WAND over each shard.

A shard holds the postings of some documents, sorted by document. For a query, each of its terms has a maximum impact in the
shard: no document gets more from it. Pivot selection adds these maxima up: a document is scored only if the maxima of the terms that it holds
exceed the score of the worst of the best so far, the heap's threshold; all others are skipped. Terms whose maxima together stay below the threshold
cannot make a pivot by themselves, so their postings are not read but looked up for the pivots of the others. Cursors
move a window of documents at a time, in numpy; the threshold rises after each. The shards' heaps are merged by Spark.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .work import Workspace, table

#: A shard ends at so many documents or postings.
SHARD_DOCS, SHARD_POSTINGS = 200_000, 2_000_000
#: Distinct query terms, and their bytes, up to which an index can be made of them alone: they are sent to every task.
SENT_TERMS, SENT_BYTES = 200_000, 8 << 20
#: Rows (query, term) that are searched in one pass over the index.
PASS_TERMS = 200_000
#: Documents by which cursors move.
WINDOW = 4096
#: Bytes of a text that are split together.
PIECE = 1 << 20

#: Every byte that is no part of a term is a space, and A-Z are lower-cased; bytes of other characters stay.
_FOLD = bytes(b if b > 127 or chr(b).isdigit() or chr(b).islower() else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))

SHARD = (
    "shard string, n_docs long, n_terms long, doc_id array<long>, length array<long>, "
    "terms array<binary>, starts array<int>, posts array<int>, counts array<long>"
)


def term_counts(text: str | None) -> tuple[Counter, int]:
    """How often each term (UTF-8) occurs in a text, and how many there are."""
    data, at, counts = (text or "").encode("utf-8").translate(_FOLD), 0, Counter()
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        counts.update(data[at:end].split())
        at = end
    return counts, counts.total()


class ShardWriter:
    """Documents of a shard in memory."""

    def __init__(self):
        self.ids, self.lengths, self.terms = [], [], {}
        self.posts: tuple[list[int], list[int], list[int]] = ([], [], [])  # of each posting its term, document and count

    def add(self, doc_id: int | None, counts: Counter, length: int, wanted: frozenset | None) -> None:
        if not length:
            return
        place, terms = len(self.ids), self.terms
        self.ids.append(doc_id)
        self.lengths.append(length)
        held = list(counts if wanted is None else wanted & counts.keys())
        for column, values in zip(self.posts, ([terms.setdefault(term, len(terms)) for term in held], [place] * len(held), [counts[term] for term in held]), strict=True):
            column += values

    def full(self) -> bool:
        return len(self.ids) >= SHARD_DOCS or len(self.posts[0]) >= SHARD_POSTINGS

    def close(self, name: str) -> tuple:
        # Documents in order of their ids, those without one last; terms by bytes; a term's postings by document.
        known = np.array([x is not None for x in self.ids])
        ids = np.array([x if x is not None else 0 for x in self.ids], "i8")
        order = np.lexsort((ids, ~known))
        place = np.empty(len(order), "i8")
        place[order] = np.arange(len(order))
        terms = sorted(self.terms)
        number = np.empty(len(terms), "i8")
        number[[self.terms[t] for t in terms]] = np.arange(len(terms))
        term, doc, count = (np.array(column, "i8") for column in self.posts)
        term, doc = number[term], place[doc]
        by = np.lexsort((doc, term))
        starts = np.searchsorted(term[by], np.arange(len(terms) + 1)).astype("i4")
        lengths = np.array(self.lengths, "i8")[order]
        return name, len(order), int(lengths.sum()), [self.ids[k] for k in order], lengths, terms, starts, doc[by].astype("i4"), count[by]


def index_shards(docs: DataFrame, ws: Workspace, wanted: frozenset | None = None) -> DataFrame:
    """The saved index of ``docs`` (``doc_id, text``), a row for each shard: nothing is shuffled. ``wanted``: the only terms that get postings; lengths and counts are
    those of whole texts all the same."""
    schema = T._parse_datatype_string(SHARD)
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        kinds = [pa.string(), pa.int64(), pa.int64(), *(pa.list_(kind) for kind in (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64()))]
        writer = ShardWriter()

        def closed() -> pa.RecordBatch:
            nonlocal made, writer
            row, made, writer = writer.close(f"{task}-{made}"), made + 1, ShardWriter()
            return pa.RecordBatch.from_arrays([pa.array([value], kind) for value, kind in zip(row, kinds, strict=True)], names=names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                writer.add(doc_id, *term_counts(text.as_py()), wanted)
                if writer.full():
                    yield closed()
        if writer.ids:
            yield closed()

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return ws.save(slim.mapInArrow(run, schema), "index")


def query_terms(queries: DataFrame, id_column: str) -> DataFrame:
    """``item_id, term``: the distinct terms of each item, of all its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, terms = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = list(term_counts(text)[0])
                items += [item] * len(found)
                terms += found
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(terms, pa.binary())], names=["item_id", "term"])

    return queries.select(F.col(id_column).cast("long").alias("item_id"), "text").mapInArrow(run, "item_id long, term binary").distinct()


def impacts(counts: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a posting adds for each unit of its term's weight."""
    if 90 * int(lengths.max(initial=0)) * n_docs < 1 << 63:
        m = 10 + 90 * lengths * n_docs // n_terms
    else:
        m = np.array([10 + 90 * int(n) * n_docs // n_terms for n in lengths], "i8")
    return 1_000_000_000 * counts // (1000 * counts + 8 * m)


def best(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` documents of the highest scores above 0, the first of equal ones, and their scores: WAND over ``lists``, of each term its documents, ascending, and
    their impacts, all in 64 bits."""
    lists = sorted((x for x in lists if len(x[0])), key=lambda x: int(x[1].max()))
    most = np.array([x[1].max() for x in lists], "i8")
    before = np.cumsum(most)  # what a document can get from this term and those of lower maxima
    heap_docs, heap_scores, threshold = np.zeros(0, "i8"), np.zeros(0, "i8"), 0
    cursors = [0] * len(lists)
    at = 0
    while at < n_docs:
        end = min(n_docs, at + WINDOW)
        pivot = int(np.searchsorted(before, threshold, "right"))  # terms before it can't exceed the threshold together
        if pivot == len(lists):
            break
        bound = np.zeros(end - at, "i8")
        score = np.zeros(end - at, "i8")
        for t in range(pivot, len(lists)):
            docs, impact = lists[t]
            stop = cursors[t] + int(np.searchsorted(docs[cursors[t] :], end))
            here = docs[cursors[t] : stop] - at
            bound[here] += most[t]
            score[here] += impact[cursors[t] : stop]
            cursors[t] = stop
        below = int(before[pivot - 1]) if pivot else 0
        open_docs = np.flatnonzero((bound > 0) & (bound + below > threshold))
        # The other terms from the highest maximum down; who can't reach the threshold any more is skipped.
        for t in range(pivot - 1, -1, -1):
            open_docs = open_docs[score[open_docs] + before[t] > threshold]
            if not len(open_docs):
                break
            docs, impact = lists[t]
            place = np.searchsorted(docs, open_docs + at)
            held = place < len(docs)
            held[held] = docs[place[held]] == open_docs[held] + at
            score[open_docs[held]] += impact[place[held]]
        open_docs = open_docs[score[open_docs] > threshold]
        if len(open_docs):
            heap_docs, heap_scores = np.concatenate([heap_docs, open_docs + at]), np.concatenate([heap_scores, score[open_docs]])
            if len(heap_docs) > k:
                kept = np.lexsort((heap_docs, -heap_scores))[:k]
                heap_docs, heap_scores = heap_docs[kept], heap_scores[kept]
            if len(heap_docs) == k:
                threshold = int(heap_scores.min())
        at = end
    return heap_docs, heap_scores


def search_shards(index: DataFrame, weights: dict[bytes, list[tuple[int, int]]], n_items: int, totals: tuple[int, int], k: int) -> DataFrame:
    """``item, doc_id, score``: each shard's best documents for each item. ``weights``: of each term the items that have it, by number, and its weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                column = lambda name, kind: batch.column(name)[row].values.to_numpy(zero_copy_only=False).astype(kind)  # noqa: B023, E731
                starts, docs, lengths = column("starts", "i8"), column("posts", "i8"), column("length", "i8")
                gain = impacts(column("counts", "i8"), lengths[docs], *totals)
                lists: list[list] = [[] for _ in range(n_items)]
                for t, term in enumerate(batch.column("terms")[row].as_py()):
                    part = slice(starts[t], starts[t + 1])
                    for item, weight in weights.get(term, ()):
                        if weight:
                            lists[item].append((docs[part], weight * gain[part]))
                ids = batch.column("doc_id")[row].values
                for item, own in enumerate(lists):
                    if own:
                        found, scores = best(own, len(lengths), k)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), item)), ids.take(pa.array(found)), pa.array(scores)], names=["item", "doc_id", "score"])

    return index.select("doc_id", "length", "terms", "starts", "posts", "counts").mapInArrow(run, "item long, doc_id long, score long")


def search(docs: DataFrame, queries: DataFrame, ws: Workspace, k: int = 10, id_column: str = "item_id") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents of ``docs`` (``doc_id, text``) that score highest for each item of ``queries`` (``id_column, text``).

    The index is made of the queries' terms alone where these are counted as few, else of all terms. Queries are searched in
    passes of a bounded number of terms, so what is sent to tasks does not grow with them. A shard's heap sends ``k`` rows an item at most.

    Rows of ``queries`` with one id are one item, a null id like others; an item without terms, or whose terms no document has, gives no
    rows. Null and empty texts are no documents. Of equal scores the smaller doc_id goes first, rows without one last; repeated rows are documents
    each. Texts are indexed whole. Empty tables give an empty result. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    terms = ws.save(query_terms(queries, id_column), "terms")
    size = terms.agg(F.count_distinct("term").alias("n"), F.sum(F.octet_length("term")).alias("bytes")).first()
    few = size["n"] <= SENT_TERMS and (size["bytes"] or 0) <= SENT_BYTES
    wanted = frozenset(bytes(r["term"]) for r in terms.select("term").distinct().collect()) if few else None
    index = index_shards(docs, ws, wanted)
    found = index.agg(F.sum("n_docs").alias("n_docs"), F.sum("n_terms").alias("n_terms")).first()
    totals = (found["n_docs"] or 0, found["n_terms"] or 0)
    if not totals[0]:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    spans = F.transform("terms", lambda term, i: F.struct(term.alias("term"), (F.element_at("starts", i + 2) - F.element_at("starts", i + 1)).alias("df")))
    held = index.select(F.explode(spans).alias("x")).groupBy("x.term").agg(F.sum("x.df").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(totals[0]) + 2) / (2 * F.col("df") + 1))).cast("long")
    weighed = ws.save(terms.join(held, "term").select("item_id", "term", weight.alias("weight")), "weights")
    passes = -(-weighed.count() // PASS_TERMS)
    found = None
    for number in range(passes):
        of_items = F.pmod(F.xxhash64("item_id"), F.lit(passes)) == number
        rows = weighed.filter(of_items).collect()
        items = sorted({r["item_id"] for r in rows}, key=lambda x: (x is not None, x))
        place, weights = {item: i for i, item in enumerate(items)}, {}
        for r in rows:
            weights.setdefault(bytes(r["term"]), []).append((place[r["item_id"]], r["weight"]))
        named = F.broadcast(spark.createDataFrame(list(enumerate(items)), "item long, item_id long"))
        here = search_shards(index, weights, len(items), totals, k).join(named, "item").select("item_id", "doc_id", "score")
        found = here if found is None else found.unionByName(here)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Workspace(spark, "lexical"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE = f"""
    WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, {_TERMS} AS terms FROM documents),
    c AS (SELECT count(*)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0),
    tf AS (SELECT row_no, term, count(*)::BIGINT AS tf FROM (SELECT row_no, unnest(terms) AS term FROM d) GROUP BY 1, 2),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark)),
    w AS (SELECT item_id, term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM q JOIN df USING (term), c),
    s AS (SELECT item_id, row_no, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(terms) * n_docs) // n_terms)))) AS BIGINT) AS score
          FROM w JOIN tf USING (term) JOIN d USING (row_no), c GROUP BY 1, 2, 3),
    r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10"""
