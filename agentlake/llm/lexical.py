"""Ranked lexical search by MaxScore with bounds of term pairs.

Documents are indexed in blocks: a block holds the postings of its documents for the terms
that queries ask for (let through by a bitmap of fixed size, then joined exactly). Of every
query, the terms are put in order of their weight, and neighbours in that order form pairs.
Before any query is answered, each block's intersection lists are computed: for a pair, the
documents of the block with both terms, and the highest joint impact among them.

A block then answers a query term by term, the heaviest first. What the terms still to come
can add is bounded by the sum of their pairs' bounds, where a pair adds no more than its
joint maximum in this block or the greater of both single maxima: less than two independent
maxima whenever no document has both at their best. Once that bound falls below the kth
score known so far, no new document is admitted, and documents that cannot reach it are
dropped. The kth score starts from the intersection lists of all blocks: a pair whose list
holds k documents gives k scores at least as high as their joint impacts.

Scores are integers throughout, so results do not depend on the order of additions. Terms
are compared by 64-bit hashes; two given terms share one with a probability near 2^-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agentlake.llm.common import bit_filter, passes, slices, written
from agentlake.llm.words import Words

#: Bytes of a term: ASCII letters and digits, and all bytes of other characters.
TERM_BYTES = np.zeros(256, bool)
TERM_BYTES[128:] = True
for _low, _high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)):
    TERM_BYTES[_low : _high + 1] = True
#: Documents, and postings, after which a block is closed.
BLOCK_DOCS, BLOCK_POSTINGS = 8192, 1 << 20
#: Queries that a block answers in one group, and blocks that one copy of them serves.
QUERIES, SHARE = 256, 64

_BLOCK = "block bigint, ids binary, lengths binary, terms binary, starts binary, docs binary, tfs binary"


def _i64(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int64)


def _term_table(texts: pa.Array) -> tuple[Words, np.ndarray]:
    words = Words(texts, lower=True, alphabet=TERM_BYTES)
    return words, words.hashes.view(np.int64)


def query_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """``item_id, term, repeats`` of every query; ``term`` is a hash.

    Rows without an id are left out; of a repeated id, the smallest non-null text counts.
    """
    one = items.select(F.col(key).cast("bigint").alias("item_id"), F.col(text).cast("string").alias("text")).where("item_id IS NOT NULL")
    one = one.groupBy("item_id").agg(F.min("text").alias("text"))

    def run(batches):
        for part in slices(batches):
            words, terms = _term_table(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("item_id").take(pa.array(words.rows)), pa.array(terms)], ["item_id", "term"])

    return one.mapInArrow(run, "item_id bigint, term bigint").groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("repeats"))


def _packed_block(number: int, parts: list[tuple]) -> pa.RecordBatch:
    """One row: postings of all slices, by term and then by document; documents are numbered by ascending id."""
    ids = np.concatenate([p[0] for p in parts])
    lengths = np.concatenate([p[1] for p in parts])
    shift = np.cumsum([0, *[len(p[0]) for p in parts]])
    docs = np.concatenate([p[2] + s for p, s in zip(parts, shift, strict=False)])
    terms = np.concatenate([p[3] for p in parts])
    tfs = np.concatenate([p[4] for p in parts])
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    docs = place[docs]
    by = np.lexsort((docs, terms))
    docs, terms, tfs = docs[by], terms[by], tfs[by]
    first = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]]) if len(terms) else np.zeros(0, np.int64)
    cells = [ids[order], lengths[order], terms[first], np.r_[first, len(terms)].astype(np.int64)]
    columns = [pa.array([number], pa.int64()), *[pa.array([c.astype(np.int64).tobytes()], pa.binary()) for c in cells]]
    columns += [pa.array([c.astype(np.int32).tobytes()], pa.binary()) for c in (docs, tfs)]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _BLOCK.split(", ")])


def index(docs: DataFrame, wanted: np.ndarray, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Blocks of postings, and ``term, n, total``: documents per term, and with a null term documents and words of all.

    ``wanted`` is a bitmap of terms (``bit_filter``). Every document with a term counts,
    repeated rows each time; documents without an id count, but are not in the blocks.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches):
        from pyspark import TaskContext

        number, parts, held, postings = TaskContext.get().partitionId() << 32, [], 0, 0
        for part in slices(batches):
            words, terms = _term_table(part.column("text"))
            keep = np.flatnonzero(passes(wanted, terms))
            row, term = words.rows[keep], terms[keep]
            by = np.lexsort((term, row))
            row, term = row[by], term[by]
            new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (term[1:] != term[:-1])]) if len(row) else np.zeros(0, np.int64)
            tf = np.diff(np.r_[new, len(row)])
            ids = part.column("doc_id")
            missing = ids.is_null().to_numpy(zero_copy_only=False)
            # Documents without an id stay only as counts, under a number below all others.
            parts.append((ids.fill_null(0).to_numpy(zero_copy_only=False), np.where(missing, -1, 1) * words.counts, row[new], term[new], tf))
            held, postings = held + part.num_rows, postings + len(new)
            if held >= BLOCK_DOCS or postings >= BLOCK_POSTINGS:
                yield _packed_block(number, parts)
                number, parts, held, postings = number + 1, [], 0, 0
        if parts:
            yield _packed_block(number, parts)

    blocks = written(rows.mapInArrow(run, _BLOCK), "postings")

    def count(batches):
        found, n, total = [], 0, 0
        for batch in batches:
            for terms, starts, lengths in zip(*[batch.column(c).to_pylist() for c in ("terms", "starts", "lengths")], strict=True):
                found.append((_i64(terms), np.diff(_i64(starts))))
                words = np.abs(_i64(lengths))
                n, total = n + int((words > 0).sum()), total + int(words.sum())
        terms = np.concatenate([f[0] for f in found] or [np.zeros(0, np.int64)])
        df = np.concatenate([f[1] for f in found] or [np.zeros(0, np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([n], pa.int64()), pa.array([total], pa.int64())], ["term", "n", "total"])
        yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(df), pa.array(np.zeros(len(df), np.int64))], ["term", "n", "total"])

    counts = blocks.select("terms", "starts", "lengths").mapInArrow(count, "term bigint, n bigint, total bigint")
    return blocks, written(counts.groupBy("term").agg(F.sum("n").alias("n"), F.sum("total").alias("total")), "frequencies")


def weighted(terms: DataFrame, frequencies: DataFrame, n: int) -> DataFrame:
    """``item_id, term, repeats, weight`` of terms that documents hold; weights of 0 add nothing and are left out."""
    weight = F.floor(1000 * F.log((2 * F.lit(n) + 2) / (2 * F.col("n") + 1))).cast("bigint").alias("weight")
    return terms.join(frequencies.where("term IS NOT NULL").select("term", "n"), "term").select("item_id", "term", "repeats", weight).where("weight > 0")


def _packed_queries(terms: DataFrame) -> DataFrame:
    """``item_id, terms, repeats, weights, kth``: terms by descending weight times repeats; no kth score is known yet."""
    order = F.struct((-F.col("weight") * F.col("repeats")).alias("o"), F.col("term"), F.col("repeats"), F.col("weight"))
    lists = terms.groupBy("item_id").agg(F.sort_array(F.collect_list(order)).alias("l"))
    return lists.select(
        "item_id", F.col("l.term").alias("terms"), F.col("l.repeats").alias("repeats"), F.col("l.weight").alias("weights"), F.lit(0).cast("bigint").alias("kth")
    )


def _dealt(queries: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every group of queries beside every block, as one row per pair: ``block, qb`` and the queries of the group.

    Numbers are dealt by hash, and a group of queries is copied once per ``SHARE`` blocks, so
    that no key holds more than about that many rows.
    """
    n, b = queries.count(), blocks.count()
    groups, shares = max(1, -(-n // QUERIES)), max(1, -(-b // SHARE))
    packed = queries.withColumn("qb", F.pmod(F.xxhash64("item_id"), F.lit(groups))).groupBy("qb").agg(
        F.collect_list(F.struct("item_id", "terms", "repeats", "weights", "kth")).alias("queries")
    )
    copies = packed.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    seats = blocks.select("block", F.pmod(F.xxhash64("block"), F.lit(shares)).cast("int").alias("share"))
    seats = seats.withColumn("qb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))))
    return seats.join(copies, ["qb", "share"]).drop("share")


class Block:
    """Postings of a block with the impacts of their terms."""

    def __init__(self, row: dict, n: int, total: int):
        self.ids, lengths = _i64(row["ids"]), _i64(row["lengths"])
        self.terms, self.starts = _i64(row["terms"]), _i64(row["starts"])
        docs = np.frombuffer(row["docs"], np.int32)
        tf = np.frombuffer(row["tfs"], np.int32).astype(np.int64)
        m = 75 + (25 * np.abs(lengths) * n) // max(1, total)
        self.docs = docs
        # What a posting adds for a weight of one; nothing where the document has no id.
        self.gain = np.where(lengths[docs] > 0, (1_000_000_000 * tf) // (1000 * tf + 12 * m[docs]), 0)
        self.most = np.maximum.reduceat(self.gain, self.starts[:-1]) if len(self.terms) else self.gain

    def find(self, terms: np.ndarray) -> np.ndarray:
        """Rows of ``terms`` in the block, -1 for those it does not have."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def postings(self, at: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.starts[at], self.starts[at + 1])
        return self.docs[part], self.gain[part]


def _pairs_of(query: dict) -> list[tuple[int, int]]:
    """Positions of neighbouring terms."""
    return [(i, i + 1) for i in range(0, len(query["terms"]) - 1, 2)]


def pair_lists(blocks: DataFrame, queries: DataFrame, n: int, total: int, k: int) -> DataFrame:
    """``block, qb, a, b, size, most, top``: the intersection list of every pair of neighbouring query terms in every block.

    ``most`` is the highest joint impact of the documents that hold both terms, ``top`` the
    ``k`` highest. Pairs without a common document have no row.
    """

    def run(group):
        row = group.to_pylist()[0]
        block, seen, out = Block(row, n, total), set(), []
        for query in row["queries"]:
            at = block.find(np.array(query["terms"], np.int64))
            for i, j in _pairs_of(query):
                pair = (query["terms"][i], query["terms"][j])
                if at[i] < 0 or at[j] < 0 or pair in seen:
                    continue
                seen.add(pair)
                (d, g), (e, h) = block.postings(at[i]), block.postings(at[j])
                _, x, y = np.intersect1d(d, e, assume_unique=True, return_indices=True)
                joint = query["weights"][i] * g[x] + query["weights"][j] * h[y]
                joint = joint[(g[x] > 0) & (h[y] > 0)]
                if len(joint):
                    top = np.sort(np.partition(joint, -k)[-k:] if len(joint) > k else joint)[::-1]
                    out.append((row["block"], row["qb"], *pair, len(joint), int(top[0]), top.tolist()))
        return pa.Table.from_pylist([dict(zip(_PAIR.names, o, strict=True)) for o in out], _PAIR)

    joined = _dealt(queries, blocks).join(blocks, "block")
    return joined.groupBy("block", "qb").applyInArrow(run, "block bigint, qb bigint, a bigint, b bigint, size bigint, most bigint, top array<bigint>")


_PAIR = pa.schema([("block", pa.int64()), ("qb", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("size", pa.int64()), ("most", pa.int64()), ("top", pa.list_(pa.int64()))])


def _kth_known(lists: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``item_id, kth``: the best kth joint impact among the pairs of a query, over all blocks.

    Only the ``k`` highest impacts of a pair are kept, also below the shuffle. Groups of
    queries are kept apart, as a pair that two of them ask for is listed for each.
    """
    best = Window.partitionBy("qb", "a", "b").orderBy(F.desc("joint"))
    tops = lists.select("qb", "a", "b", F.explode("top").alias("joint")).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k)
    kth = tops.groupBy("qb", "a", "b").agg(F.min("joint").alias("joint"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k)
    pairs = queries.where("size(terms) > 1").select(
        "item_id", F.expr("inline(transform(sequence(0, size(terms) div 2 - 1), i -> struct(terms[2 * i] AS a, terms[2 * i + 1] AS b)))")
    )
    return kth.join(pairs, ["a", "b"]).groupBy("item_id").agg(F.max("joint").alias("kth"))


def rest_bounds(singles: np.ndarray, pairs: dict[int, int]) -> np.ndarray:
    """What the terms from each position on can add at most; ``pairs`` bounds positions ``i, i + 1`` together."""
    rest = np.zeros(len(singles) + 1, np.int64)
    for i in range(len(singles) - 1, -1, -1):
        rest[i] = rest[i + 1] + singles[i]
        if i in pairs:
            rest[i] = rest[i + 2] + pairs[i]
    return rest


def search_block(block: Block, query: dict, joint: dict[tuple[int, int], int], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of the block (ascending) that may be among the query's best ``k``, with their whole scores."""
    terms = np.array(query["terms"], np.int64)
    repeats, weights = np.array(query["repeats"], np.int64), np.array(query["weights"], np.int64)
    at = block.find(terms)
    each = np.where(at >= 0, weights * block.most[at], 0) if len(block.terms) else np.zeros(len(terms), np.int64)
    pairs = {}
    for i, j in _pairs_of(query):
        both = max(joint.get((query["terms"][i], query["terms"][j]), 0), int(each[i]), int(each[j]))
        same = min(repeats[i], repeats[j])
        pairs[i] = int(same * both + (repeats[i] - same) * each[i] + (repeats[j] - same) * each[j])
    rest = rest_bounds(repeats * each, pairs)
    score, kth = np.zeros(len(block.ids), np.int64), max(int(query["kth"]), 1)
    i = 0
    while i < len(terms) and rest[i] >= kth:
        if at[i] >= 0:
            docs, gain = block.postings(at[i])
            score[docs] += repeats[i] * weights[i] * gain
            if len(score) > k:
                kth = max(kth, int(np.partition(score, -k)[-k]))
        i += 1
    # No document without a score so far can reach the kth one.
    left = np.flatnonzero(score + rest[i] >= kth) if i else np.zeros(0, np.int64)
    left = left[score[left] > 0]
    known = score[left]
    for i in range(i, len(terms)):
        keep = known + rest[i] >= kth
        left, known = left[keep], known[keep]
        if at[i] >= 0 and len(left):
            docs, gain = block.postings(at[i])
            to = np.minimum(np.searchsorted(docs, left), len(docs) - 1)
            known = known + np.where(docs[to] == left, repeats[i] * weights[i] * gain[to], 0)
            if len(known) > k:
                kth = max(kth, int(np.partition(known, -k)[-k]))
    keep = known >= kth
    return left[keep], known[keep]


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """``item_id, rank, doc_id, score``: every query's ``k`` documents with the highest scores above 0, ties by ascending id.

    Null texts have no terms. Documents without an id count in the statistics and are never
    returned; rows that repeat an id are documents of their own, so an id may be returned
    more than once. Queries without terms, and empty tables, give no rows.
    """
    terms = written(query_terms(items), "query-terms")
    blocks, frequencies = index(docs, bit_filter(terms, "term"))
    counted = frequencies.where("term IS NULL").first()
    n, total = (counted.n, counted.total) if counted else (0, 0)
    if not n:
        return docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    terms = written(weighted(terms, frequencies, n), "weighted")
    queries = written(_packed_queries(terms), "queries")
    lists = written(pair_lists(blocks, queries, n, total, k), "pair-lists")
    queries = written(queries.drop("kth").join(_kth_known(lists, queries, k), "item_id", "left").fillna(0, ["kth"]), "queries")
    joints = lists.groupBy("block", "qb").agg(F.collect_list(F.struct("a", "b", "most")).alias("pairs"))

    def run(group):
        row = group.to_pylist()[0]
        block = Block(row, n, total)
        joint = {(p["a"], p["b"]): p["most"] for p in row["pairs"] or ()}
        out = []
        for query in row["queries"]:
            left, score = search_block(block, query, joint, k)
            best = np.lexsort((left, -score))[:k]  # documents are numbered by id
            out.append((np.full(len(best), query["item_id"]), block.ids[left[best]], score[best]))
        cells = [np.concatenate([o[c] for o in out]).astype(np.int64) for c in range(3)]
        return pa.Table.from_arrays([pa.array(c) for c in cells], ["item_id", "doc_id", "score"])

    joined = _dealt(queries, blocks).join(joints, ["block", "qb"], "left").join(blocks, "block")
    found = joined.groupBy("block", "qb").applyInArrow(run, "item_id bigint, doc_id bigint, score bigint")
    # A limit per query that Spark also applies below the shuffle.
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
