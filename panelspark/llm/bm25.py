"""Exact top-k BM25 search over sharded inverted indexes with block-max pruning.

Documents are dealt to shards of a bounded number of postings and documents. Within a shard they are ordered so that
documents of like words stand together (by bisection along the direction in which they differ most, then by length),
and cut into blocks; every term's postings have the largest impact of the term in each block. Long lists have their
blocks laid out in full, beside their block maxima; in short ones, with far fewer postings than there are blocks, a
block's maximum is as a rule its one posting, which is summed as it is.
For a query, the block maxima of its terms add up to a bound on the scores in each block. Runs of neighbouring blocks
are visited in order of their bounds: a query skips those whose bound is below its k-th best score so far, and this
limit rises with every run. This is block-max WAND with the lists aligned on blocks and pivots taken for a run of
blocks, not a document, at a time; the queries that can reach a run share a matrix product.
Bounds are single precision rounded up; what may be among the best is scored again in double precision, so the result
is exact. Shards use the corpus's own document frequencies and mean length, and their lists are merged by score.

Of S shards, about the square root of S answer first. The k-th best score of their merged lists is each query's first
limit in all the others, which prunes there, and makes them give only hits that are at least as good.

Queries are whole texts, each distinct term weighted by its count in the query. Every shard reads the queries from a
shared table a batch at a time, so they are neither broadcast nor copied for each shard.

Defined cases: a null or empty document has no words and matches nothing; very long texts are indexed and asked whole; a
null or empty query gives no rows; fewer than k rows come back where fewer documents share a term with the query; ties
(scores equal to nine digits) go to the smaller doc_id, null first; rows that repeat a doc_id are hits of their own;
other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, run_hashes, small_batches, stored, text_chunks, word_spans

K1, B = 1.2, 0.75
#: Postings of one shard: what one task indexes and holds in memory.
POSTINGS = 2_000_000
#: Documents of one shard, where they are short.
DOCUMENTS = 8192
#: Documents of a block.
BLOCK = 16
#: Documents of like words, and the terms by which they are told.
CLUSTER, LIKENESS = 128, 256
#: Lists of terms in more than this share of a shard's documents are long: a block has one of their postings or more on average.
LONG = 1 / 16
#: Cells (documents times terms) of the long lists that a shard lays out in full.
DENSE = 8_000_000
#: Queries that a shard reads together, and those of them that it answers together.
READ, TOGETHER = 256, 256
#: Blocks that are visited together.
RUN = 8
#: Queries whose short lists are summed together: their postings stay in the processor's cache.
SUMMED = 8
#: Stands for a null doc_id; null comes first among ties.
NULL_ID = np.iinfo(np.int64).min

_GAP = np.ones(256, dtype=bool)
_GAP[np.r_[48:58, 97:123, 128:256]] = False


def _terms(column: pa.Array) -> Iterator[tuple[int, list[tuple[np.ndarray, np.ndarray]], np.ndarray]]:
    """(first row, distinct terms and counts of each text, word counts)."""
    for first, raw, offsets in text_chunks(column):
        lowered = LOWER[raw]
        starts, ends, words = word_spans(lowered, offsets, _GAP)
        keys = run_hashes(lowered, starts, ends)
        found = []
        for a, b in zip(words[:-1].tolist(), words[1:].tolist()):
            own = np.sort(keys[a:b])
            edges = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if b > a else np.zeros(0, np.int64)
            found.append((own[edges], np.diff(np.append(edges, b - a)).astype(np.int32)))
        yield first, found, np.diff(words)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each term, for each run of texts; the null term has the texts and their words."""
    for batch in batches:
        for _, found, sizes in _terms(batch.column(0)):
            keys, counts = np.unique(np.concatenate([t for t, _ in found]), return_counts=True)
            terms = pa.array(np.append(keys.view(np.int64), 0), mask=np.arange(len(keys) + 1) == len(keys))
            words = np.zeros(len(keys) + 1, dtype=np.int64)
            words[-1] = sizes.sum()
            yield pa.RecordBatch.from_arrays([terms, pa.array(np.append(counts, len(found)).astype(np.int64)), pa.array(words)], names=["term", "df", "words"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """shard, doc_id, words, and the terms and counts as packed integers, of the texts with words."""
    for batch in batches:
        for first, found, sizes in _terms(batch.column(2)):
            packed = [pa.array([t.tobytes() for t, _ in found], type=pa.binary()), pa.array([c.astype(np.uint16 if c.max(initial=0) < 65536 else np.uint32).tobytes() for _, c in found], type=pa.binary())]
            rows = pa.RecordBatch.from_arrays([*(batch.column(k).slice(first, len(found)) for k in (0, 1)), pa.array(sizes.astype(np.int64)), *packed], names=["shard", "doc_id", "size", "terms", "counts"])
            yield rows.filter(pa.array(sizes > 0))


def _clustered(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The rows of x in an order in which like ones are near each other, by length within a cluster."""
    out: list[np.ndarray] = []
    waiting = [np.arange(len(x))]
    while waiting:
        rows = waiting.pop()
        if len(rows) <= CLUSTER:
            out.append(rows[np.argsort(sizes[rows], kind="stable")])
            continue
        own = x[rows]
        own = own - own.mean(axis=0)
        way = own[np.argmax((own * own).sum(axis=1))]
        for _ in range(6):  # towards the direction of the largest variance
            way = own.T @ (own @ way)
            way = way / max(float(np.sqrt(way @ way)), 1e-30)
        along = own @ way
        order = np.argsort(along, kind="stable")
        cut = int((along < 0).sum())
        if min(cut, len(rows) - cut) < CLUSTER // 4:
            cut = len(rows) // 2
        waiting += [rows[order[cut:]], rows[order[:cut]]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


class ShardIndex:
    """The inverted index of one shard, with impacts tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / mean)).

    Documents with equal terms and counts are one row with several ids. Rows of like words are cut into blocks together.
    """

    def __init__(self, batches: Iterator[pa.RecordBatch], mean: float):
        """From batches (shard, doc_id, size, terms, counts) of one shard."""
        rows: dict[tuple[bytes, bytes], int] = {}
        ids, row_of, by_row = [], [], []
        for batch in batches:
            at = [rows.setdefault(key, len(rows)) for key in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            ids.append(batch.column(1).fill_null(NULL_ID).to_numpy())
            row_of.append(np.array(at, dtype=np.int64))
            by_row.append(batch.column(2).to_numpy())
        n = self.n = len(rows)
        self.doc_ids, row_of, by_row = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ids, row_of, by_row))
        doc_ids, sizes = self.doc_ids, np.zeros(n)
        sizes[row_of] = by_row
        terms, counts = [t for t, _ in rows], [c for _, c in rows]
        del rows, ids, by_row
        lengths = np.array([len(t) // 8 for t in terms], dtype=np.int64)
        keys = np.frombuffer(b"".join(terms), dtype=np.uint64)
        common, df = np.unique(keys, return_counts=True)
        common = np.sort(common[np.argsort(-df, kind="stable")[:LIKENESS]])
        likeness = np.zeros((n, max(1, len(common))), dtype=np.float32)
        if len(common):
            at = np.minimum(np.searchsorted(common, keys), len(common) - 1)
            there = common[at] == keys
            likeness[np.repeat(np.arange(n), lengths)[there], at[there]] = 1
            likeness /= np.maximum(1, np.sqrt(likeness.sum(axis=1, keepdims=True)))
        order = _clustered(likeness, sizes)
        del common, df, likeness, keys
        place = np.empty(n, dtype=np.int64)
        place[order] = np.arange(n)
        some = order
        # The ids of each row, in order.
        members = np.lexsort((doc_ids, place[row_of])) if n else np.zeros(0, np.int64)
        self.members = members
        self.first_member = np.searchsorted(place[row_of][members], np.arange(n + 1))
        self.n_blocks = -(-max(n, 1) // BLOCK)
        self.norm = np.ones(self.n_blocks * BLOCK)
        self.norm[:n] = K1 * (1 - B + B * sizes[some] / mean)
        lengths = np.array([len(terms[k]) // 8 for k in some.tolist()], dtype=np.int64)
        keys = np.frombuffer(b"".join([terms[k] for k in some.tolist()]), dtype=np.uint64)
        tf = np.concatenate([np.frombuffer(counts[k], dtype=np.uint16 if 2 * m == len(counts[k]) else np.uint32).astype(np.uint32) for k, m in zip(some.tolist(), lengths.tolist())]) if n else np.zeros(0, np.uint32)
        order = np.argsort(keys, kind="stable")
        tf = tf[order]
        self.docs = np.repeat(np.arange(n, dtype=np.int32), lengths)[order]
        keys = keys[order]
        edges = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        self.keys = keys[edges]
        self.starts = np.append(edges, len(keys))
        del keys, order
        #: The impact of each posting.
        self.each = self._impact(tf, self.docs)
        # Long lists, as many as DENSE cells hold, have their blocks laid out in full.
        df = np.diff(self.starts)
        often = np.argsort(-df, kind="stable")[: max(1, DENSE // len(self.norm))]
        often = often[df[often] > LONG * len(self.norm)]
        self.column = np.full(len(self.keys), -1, dtype=np.int64)
        self.column[often] = np.arange(len(often))
        self.counts = np.zeros((len(self.norm), len(often)), dtype=np.uint16 if tf.max(initial=0) < 65536 else np.uint32)
        self.impacts = np.zeros((len(self.norm), len(often)), dtype=np.float32)
        for k, t in enumerate(often.tolist()):
            own = slice(self.starts[t], self.starts[t + 1])
            self.counts[self.docs[own], k] = tf[own]
            self.impacts[self.docs[own], k] = self.each[own]
        # Upper bounds, rounded up.
        self.block_max = np.nextafter(self.impacts.reshape(self.n_blocks, BLOCK, -1).max(axis=1), np.float32(4))
        #: Scores computed, those that a bound called for, and all there were: what pruning saved.
        self.scored = self.reached = self.open = 0

    def _impact(self, tf: np.ndarray, docs: np.ndarray) -> np.ndarray:
        return tf * (K1 + 1) / (tf + self.norm[docs])

    def search(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, limits: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (terms, weights) the ids and scores of the best k documents with a positive score.

        Where a limit is given, documents with a lower score aren't wanted.
        """
        limits = np.zeros(len(queries)) if limits is None else limits
        if not self.n or not len(self.keys) or not queries:
            return [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
        m, width = len(queries), len(self.norm)
        owner = np.repeat(np.arange(m), [len(t) for t, _ in queries])
        terms, weights = np.concatenate([t for t, _ in queries]), np.concatenate([w for _, w in queries])
        at = np.minimum(np.searchsorted(self.keys, terms), len(self.keys) - 1)
        there = self.keys[at] == terms
        owner, at, weights = owner[there], at[there], weights[there]
        column = self.column[at]
        # In short lists a block's maximum is its posting, so they are summed as they are, for some queries at a time.
        short = column < 0
        sums = np.zeros((m, width))
        for a in range(0, m, SUMMED):
            own = slice(*np.searchsorted(owner, (a, a + SUMMED)))
            lists = at[own][short[own]]
            starts, counts = self.starts[lists], self.starts[lists + 1] - self.starts[lists]
            ends = np.cumsum(counts)
            places = np.repeat(starts - (ends - counts), counts) + np.arange(counts.sum())
            docs = self.docs[places]
            cell = np.repeat((owner[own][short[own]] - a) * width, counts) + docs
            sums[a : a + SUMMED] = np.bincount(cell, weights=self.each[places] * np.repeat(weights[own][short[own]], counts), minlength=min(SUMMED, m - a) * width).reshape(-1, width)
        exact = np.zeros((m, self.impacts.shape[1]))
        exact[owner[~short], column[~short]] = weights[~short]
        # What single precision may be off by, relative to a sum of positive numbers.
        slack = (self.impacts.shape[1] + 8) * 2.0**-23
        bounds = (exact.astype(np.float32) @ self.block_max.T) * (1 + slack) + sums.reshape(m, self.n_blocks, BLOCK).max(axis=2) * (1 + slack)
        out: list[tuple[np.ndarray, np.ndarray]] = [None] * m
        alike = np.argsort(bounds.argmax(axis=1), kind="stable")
        for a in range(0, m, TOGETHER):
            own = alike[a : a + TOGETHER]
            for x, found in zip(own.tolist(), self._best(exact[own], sums[own], bounds[own], limits[own], slack, k)):
                out[x] = found
        return out

    def _best(self, exact: np.ndarray, sums: np.ndarray, bounds: np.ndarray, limits: np.ndarray, slack: float, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """The best k of some queries, from their weights in the long lists, their sums over the short ones and their bounds."""
        m = len(exact)
        wanted = exact.astype(np.float32)
        # Runs of blocks of like words, in order of their bounds; a run is passed over by each query whose limit it can't reach.
        edges = np.arange(0, self.n_blocks, RUN)
        tops = np.maximum.reduceat(bounds, edges, axis=1)
        # Ranks are by scores rounded to nine digits, so a limit is a rounding step below the score.
        limit, best = np.maximum(limits - 1e-8, 0), np.zeros((m, k))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for run in np.argsort(-tops.max(axis=0), kind="stable").tolist():
            asking = np.flatnonzero((tops[:, run] >= limit * (1 - 2 * slack)) & (tops[:, run] > 0))
            if not len(asking):
                continue
            first, last = RUN * run * BLOCK, min(RUN * (run + 1), self.n_blocks) * BLOCK
            scores = wanted[asking] @ self.impacts[first:last].T + sums[asking, first:last]
            self.scored += scores.size
            # Most queries have nothing here that is good enough.
            some = np.flatnonzero(scores.max(axis=1) >= limit[asking] * (1 - 2 * slack))
            asking, scores = asking[some], scores[some]
            top = np.partition(np.concatenate((best[asking], scores), axis=1), scores.shape[1], axis=1)[:, -k:]
            best[asking] = top
            limit[asking] = np.maximum(top.min(axis=1) - 1e-8, limit[asking])
            q, d = np.nonzero((scores >= (limit[asking] * (1 - 2 * slack))[:, None]) & (scores > 0))
            found.append((asking[q], first + d, scores[q, d]))
        self.reached += int(((bounds >= limit[:, None] * (1 - 2 * slack)) & (bounds > 0)).sum()) * BLOCK
        self.open += m * len(self.norm)
        if not found:
            return [(np.zeros(0, np.int64), np.zeros(0))] * m
        q, d, s = (np.concatenate(x) for x in zip(*found))
        stay = s >= limit[q] * (1 - 2 * slack)
        q, d = q[stay], d[stay]
        # The candidates' scores in double precision, by the counts themselves.
        score = sums[q, d]
        for a in range(0, len(q), 1000):
            own = slice(a, a + 1000)
            tf = self.counts[d[own]].astype(np.float64)
            score[own] += (tf * (K1 + 1) / (tf + self.norm[d[own]][:, None]) * exact[q[own]]).sum(axis=1)
        score = np.round(score, 9)  # sums in another order may differ in the last bits
        # A row's ids in order, k of them at most: more can't be among the best k.
        copies = np.minimum(self.first_member[d + 1] - self.first_member[d], k)
        ends = np.cumsum(copies)
        ids = self.doc_ids[self.members[np.repeat(self.first_member[d] - (ends - copies), copies) + np.arange(copies.sum())]]
        q, score = np.repeat(q, copies), np.repeat(score, copies)
        ranked = np.lexsort((ids, -score, q))
        q, ids, score = q[ranked], ids[ranked], score[ranked]
        first = np.searchsorted(q, np.arange(m + 1))
        return [(ids[a : min(a + k, b)], score[a : min(a + k, b)]) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]


def search(docs: DataFrame, queries: DataFrame, k: int = 10, postings: int = POSTINGS) -> DataFrame:
    """query_id, rank (from 1), doc_id and score of the best k documents of each query row's whole text.

    A shard has about `postings` postings and at most about DOCUMENTS documents: what one task indexes and holds in memory.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = F.col("text").cast("string").alias("text")
    frequency = docs.select(text).mapInArrow(_frequencies, "term long, df long, words long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("words").alias("words"))
    frequency = stored(frequency, "frequencies")
    row = frequency.agg(F.sum(F.when(F.col("term").isNull(), F.col("df"))).alias("total"), F.sum("words").alias("words"), F.sum(F.when(F.col("term").isNotNull(), F.col("df"))).alias("postings")).first()
    total, mean_size, shards = row["total"] or 0, max(1.0, (row["words"] or 0) / max(1, row["total"] or 0)), max(1, -(-(row["postings"] or 0) // postings), -(-(row["total"] or 0) // DOCUMENTS))
    asked = queries.select(F.col("doc_id").cast("long").alias("query_id"), text).withColumn("query", F.monotonically_increasing_id())

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, found, _ in _terms(batch.column(2)):
                lengths = np.array([len(t) for t, _ in found])
                rows = np.repeat(np.arange(first, first + len(found)), lengths)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.array(np.concatenate([t for t, _ in found]).view(np.int64)), pa.array(np.concatenate([c for _, c in found]))],
                    names=["query", "query_id", "term", "tf"],
                )

    each = stored(asked.select("query", "query_id", "text").mapInArrow(opened, "query long, query_id long, term long, tf int"), "query_terms")
    held = stored(frequency.select("term", "df").join(each.select("term").distinct(), "term", "left_semi"), "query_frequencies")
    idf = F.log1p((F.lit(float(total)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = each.join(held, "term").select("query", "query_id", "term", (idf * F.col("tf")).alias("weight"))
    grouped = weighted.groupBy("query").agg(F.first("query_id").alias("query_id"), F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights"))
    grouped = stored(grouped.repartition(max(1, total // 500_000)), "weights")
    tied = F.xxhash64("doc_id", "text")
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).select(F.pmod(tied, F.lit(shards)).cast("int").alias("shard"), "doc_id", "text")

    def lists(rows: DataFrame, first: int, count: int, asked: DataFrame) -> DataFrame:
        """The best k of each of `count` shards from the first on; a partition is a shard."""
        path = asked._panelspark_path

        def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = ShardIndex(batches, mean_size)
            if not index.n:
                return
            store, base = pafs.FileSystem.from_uri(path)
            for batch in ds.dataset(base, filesystem=store, format="parquet").to_batches(batch_size=READ, columns=["query", "query_id", "terms", "weights", "least"]):
                if not batch.num_rows:
                    continue
                names, query_ids, terms, weights, least = batch.columns
                found = index.search([(t.values.to_numpy().view(np.uint64), w.values.to_numpy()) for t, w in zip(terms, weights)], k, least.to_numpy())
                rows_of = np.repeat(np.arange(len(found)), [len(ids) for ids, _ in found])
                ids = np.concatenate([ids for ids, _ in found])
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(rows_of)), query_ids.take(pa.array(rows_of)), pa.array(ids, mask=ids == NULL_ID), pa.array(np.concatenate([x for _, x in found]))],
                    names=["query", "query_id", "doc_id", "score"],
                )

        own = rows.filter((F.col("shard") >= first) & (F.col("shard") < first + count)).mapInArrow(_counted, "shard int, doc_id long, size long, terms binary, counts binary")
        return own.repartitionById(count, F.col("shard") - first).mapInArrow(searched, "query long, query_id long, doc_id long, score double")

    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first()))
    ahead = math.isqrt(shards - 1) + 1
    best = lists(dealt, 0, ahead, stored(grouped.withColumn("least", F.lit(0.0)), "asked_first")).withColumn("rank", rank).filter(F.col("rank") <= k)
    if ahead < shards:
        best = stored(best, "first_lists")
        reached = best.filter(F.col("rank") == k).select("query", F.col("score").alias("least"))
        asked = stored(grouped.join(reached, "query", "left").withColumn("least", F.coalesce("least", F.lit(0.0))), "asked")
        rest = lists(dealt, ahead, shards - ahead, asked)
        best = best.drop("rank").unionByName(rest).withColumn("rank", rank).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "doc_id", "score")
