"""Removal of passages that repeat across documents, by prefix-partitioned suffix trees.

The suffixes of interest are those with at least ``WINDOW`` words; they are compared over
their first ``WINDOW``. Suffixes are dealt to groups by a prefix of content-chosen place: of
the word 8-grams that begin in the first 25 words of a suffix, the one with the smallest
hash. Equal suffixes choose alike, and neighbouring suffixes share their choice, so a run of
them travels as one stretch of text. The length of the prefix varies: groups small enough
for memory go by their 8 words; the prefixes that most suffixes have are extended to the
whole window, where a group is one node of the tree and only its smallest document is kept,
combined before the shuffle. What begins with a prefix of one document only is no repeat.

In a group a suffix tree is built top-down: each level splits its nodes by the next words of
their suffixes, and nodes of a single document are leaves and not extended. The nodes left
at the depth of a window are the repeats.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentlake.llm.common import bit_filter, list_array, passes, ranges, slices, written
from agentlake.llm.words import Words, mix

WINDOW = 50
GRAM, REACH = 8, 25
#: Suffixes of a run at most; below WINDOW, so that all of them overlap.
LONGEST = 48
#: Depths at which nodes are split, in words.
DEPTHS = (8, 16, 32, 50)
#: Suffix runs of one prefix that a task takes, and the number of prefixes that may be
#: extended, which bounds what is broadcast: a prefix beyond it has at most one
#: ``EXTENDED``th of all runs.
GROUP, EXTENDED = 2048, 1 << 18
#: Bytes of suffix runs that a task builds trees for at once.
_CHUNK = 4 << 20
_SLICE = 4 << 20


class Runs:
    """Runs of neighbouring suffixes with one prefix, of the texts of an Arrow column.

    ``prefix``: hash of the chosen 8-gram; ``first``: index of the run's first word among all
    words; ``n``: number of suffixes; ``rows``: row of the text.
    """

    def __init__(self, texts: pa.Array):
        self.words = words = Words(texts)
        grams = np.full(len(words.hashes), np.iinfo(np.uint64).max, np.uint64)
        hashes, at = words.windows(GRAM)
        grams[at] = hashes
        begins = np.flatnonzero(words.place + WINDOW <= np.repeat(words.counts, words.counts))
        # The leftmost smallest of REACH neighbours, by doubling.
        best = np.arange(len(grams))
        size = 1
        while size * 2 <= REACH:
            best = self._least(grams, best, size)
            size *= 2
        if size < REACH:
            best = self._least(grams, best, REACH - size)
        chosen = grams[best[begins]]
        new = np.ones(len(begins), bool)
        new[1:] = (chosen[1:] != chosen[:-1]) | (begins[1:] != begins[:-1] + 1)
        # Of a text with a period, a long run chooses the same; it is cut.
        whole = np.flatnonzero(new)
        new[(np.arange(len(begins)) - np.repeat(whole, np.diff(np.append(whole, len(begins))))) % LONGEST == 0] = True
        starts = np.flatnonzero(new)
        self.first = begins[starts]
        self.n = np.diff(np.append(starts, len(begins)))
        self.prefix = chosen[starts].view(np.int64)
        self.rows = words.rows[self.first]

    @staticmethod
    def _least(grams, best, step):
        if step >= len(best):
            return best
        other = best.copy()
        other[: len(best) - step] = best[step:]
        return np.where(grams[other] < grams[best], other, best)


def _named(words: Words, depth: int) -> np.ndarray:
    """A name for the ``depth`` words from every word on, by doubling; equal words, equal names.

    Names that would reach over a text's end are never looked at.
    """
    names, size = words.hashes, 1
    with np.errstate(over="ignore"):
        while size < depth:
            step = min(size, depth - size)
            after = np.zeros_like(names)
            after[: max(0, len(names) - step)] = names[step:]
            names = mix(names * np.uint64(0x9E3779B97F4A7C15) + mix(after + np.uint64(step)))
            size += step
    return names


def _repeated(prefix: np.ndarray, docs: np.ndarray, n: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes that begin in a smaller document too, as (run, offset in the run), by a tree per prefix."""
    words = Words(texts)
    run = np.repeat(np.arange(len(n)), n)
    offset = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    at = words.first[run] + offset
    node, doc = prefix[run], docs[run]
    names = {d: _named(words, d) for d in DEPTHS}
    for depth in DEPTHS:
        below = names[depth][at]
        order = np.lexsort((below, node))
        new = np.ones(len(order), bool)
        a, b = node[order], below[order]
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        starts = np.flatnonzero(new)
        if not len(starts):
            break
        own = doc[order]
        low, high = np.minimum.reduceat(own, starts), np.maximum.reduceat(own, starts)
        child = np.cumsum(new) - 1
        inner = (low < high)[child]
        if depth == DEPTHS[-1]:
            hit = inner & (own > low[child])
            picked = order[hit]
            return run[picked], offset[picked]
        keep = order[inner]
        node = child[inner]
        run, offset, at, doc = run[keep], offset[keep], at[keep], doc[keep]
    return np.zeros(0, np.int64), np.zeros(0, np.int64)


def _covered(owner: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring window starts as ``owner, first word, end``."""
    order = np.lexsort((start, owner))
    owner, start = owner[order], start[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (start[1:] > start[:-1] + 1)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(owner)) - 1 if len(owner) else at
    return owner[at], start[at], start[last] + WINDOW


def shared_prefixes(rows: DataFrame) -> DataFrame:
    """``prefix, n``: prefixes that suffixes of more than one document have, with their number of runs."""

    def run(batches):
        for part in slices(batches, "text", _SLICE):
            runs = Runs(part.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array(runs.prefix), part.column("id").take(pa.array(runs.rows))], ["prefix", "id"])

    found = rows.select("id", "text").mapInArrow(run, "prefix bigint, id bigint")
    return found.groupBy("prefix").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high").select("prefix", "n")


def _stretches(rows: DataFrame, state, extended: bool) -> DataFrame:
    """Of the suffix runs with shared prefixes: stretches of text, or for extended prefixes the names of the suffixes."""

    def run(batches):
        bits, hot = state.value
        for part in slices(batches, "text", _SLICE):
            runs = Runs(part.column("text"))
            good = passes(bits, runs.prefix)
            good &= np.isin(runs.prefix, hot) == extended
            first, n, row, words = runs.first[good], runs.n[good], runs.rows[good], runs.words
            at = words.place[first]
            keys = pa.array(row)
            if extended:
                names = _named(words, WINDOW)[ranges(first, n)].view(np.int64)
                ends = np.cumsum(n)
                offset = np.arange(len(names)) - np.repeat(ends - n, n)
                with np.errstate(over="ignore"):
                    mixed = mix(names.view(np.uint64) + offset.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                    body = np.add.reduceat(mixed, ends - n).view(np.int64) if len(n) else np.zeros(0, np.int64)
                columns = [part.column("id").take(keys), part.column("tag").take(keys), pa.array(at.astype(np.int64)), pa.array(body), list_array(names, ends, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "tag", "start", "body", "names"])
                continue
            begin, size = words.starts[first], words.ends[first + n + WINDOW - 2] - words.starts[first]
            raw = np.frombuffer(part.column("text").buffers()[2] or b"", np.uint8)
            base = np.frombuffer(part.column("text").buffers()[1], np.int32)[part.column("text").offset]
            body = raw[ranges(begin + base, size)]
            ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            texts = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(body)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(runs.prefix[good]), part.column("id").take(keys), part.column("tag").take(keys), pa.array(at.astype(np.int64)), pa.array(n.astype(np.int32)), texts],
                ["prefix", "id", "tag", "start", "n", "body"],
            )

    kinds = "id bigint, tag bigint, start bigint, body bigint, names array<bigint>" if extended else "prefix bigint, id bigint, tag bigint, start bigint, n int, body binary"
    return rows.mapInArrow(run, kinds)


def _trees(stretches: DataFrame) -> DataFrame:
    """``id, tag, first, end``: stretches of words covered by windows that a smaller document has too."""

    def judge(table: pa.Table):
        prefix, ids = table.column("prefix").to_numpy(), table.column("id").to_numpy()
        start = table.column("start").to_numpy()
        run, offset = _repeated(prefix, ids, table.column("n").to_numpy().astype(np.int64), table.column("body").combine_chunks())
        owner, first, end = _covered(run, start[run] + offset)
        keys = pa.array(owner)
        arrays = [table.column("id").take(keys).combine_chunks(), table.column("tag").take(keys).combine_chunks(), pa.array(first), pa.array(end)]
        return pa.RecordBatch.from_arrays(arrays, ["id", "tag", "first", "end"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= _CHUNK:
                table = pa.Table.from_batches(held)
                prefix = table.column("prefix").to_numpy()
                cut = int(np.searchsorted(prefix, prefix[-1]))  # the last prefix may go on
                if cut:
                    yield judge(table.slice(0, cut))
                    table = table.slice(cut)
                held, size = table.to_batches(), table.nbytes if cut else 0
        if held:
            yield judge(pa.Table.from_batches(held))

    dealt = stretches.repartition("prefix").sortWithinPartitions("prefix")
    return dealt.mapInArrow(run, "id bigint, tag bigint, first bigint, end bigint")


def _named_repeats(runs: DataFrame) -> DataFrame:
    """As ``_trees``, for runs whose suffixes have names over the whole window.

    Equal runs are one, with their smallest and largest document, before their suffixes are
    compared; the verdicts go back to the runs. All suffixes of a run overlap, so what its
    repeats cover is one stretch.
    """
    bodies = runs.groupBy("body").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.first("names").alias("names"))
    suffixes = bodies.select("body", "low", "high", F.posexplode("names").alias("at", "name"))
    nodes = suffixes.groupBy("name").agg(F.min("low").alias("least"), F.max("high").alias("most")).where("least < most").select("name", "least")
    marks = suffixes.select("body", "at", "name").join(nodes, "name").groupBy("body").agg(F.collect_list(F.struct("at", "least")).alias("marks"))
    hits = runs.select("id", "tag", "start", "body").join(marks, "body").withColumn("at", F.expr("transform(filter(marks, m -> m.least < id), m -> m.at)"))
    return hits.where("size(at) > 0").selectExpr("id", "tag", "start + array_min(at) AS first", f"start + array_max(at) + {WINDOW} AS end")


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, tag, first, end``: words (from 0, end exclusive) of documents that lie in a window which also starts in a document with a smaller key.

    ``tag`` is the text's hash, which tells rows apart that repeat a key. Passages of one
    text come in several, possibly overlapping stretches. Rows without a key or text have none.
    """
    rows = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.xxhash64(text).alias("tag"), F.col(text).alias("text"))
    shared = written(shared_prefixes(rows), "prefixes")
    hot = shared.where(F.col("n") > GROUP).orderBy(F.col("n").desc(), "prefix").limit(EXTENDED).select("prefix").toPandas()["prefix"].to_numpy(np.int64)
    state = docs.sparkSession.sparkContext.broadcast((bit_filter(shared, "prefix"), hot))
    found = _trees(_stretches(rows, state, extended=False))
    if len(hot):
        found = found.unionAll(_named_repeats(written(_stretches(rows, state, extended=True), "suffixes")))
    return written(found, "passages")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_words, n_removed, kept``: every row's words without the repeated passages.

    ``kept`` are the words left, unchanged, joined by single spaces. Null and blank texts have
    no words. Rows without a key are compared with nothing and stay whole.
    """
    passages = repeated_passages(docs, key, text)
    # Neighbouring starts of one document are combined before they meet.
    per_doc = passages.groupBy("id", "tag").agg(F.collect_set(F.struct("first", "end")).alias("spans"))
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("tag"))
    joined = rows.join(per_doc, (F.col("key") == F.col("id")) & (rows["tag"] == per_doc["tag"]), "left")

    def run(batches):
        for part in slices(batches, "text"):
            total, gone, kept = [], [], []
            for value, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
                words = value.encode().split()
                total.append(len(words))
                if spans:
                    drop = np.zeros(len(words) + 1, np.int64)
                    np.add.at(drop, [s["first"] for s in spans], 1)
                    np.add.at(drop, [s["end"] for s in spans], -1)
                    stay = np.cumsum(drop[:-1]) == 0
                    words = [w for w, s in zip(words, stay, strict=True) if s]
                gone.append(total[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["key", "n_words", "n_removed", "kept"]
            )

    out = joined.select("key", "text", "spans").mapInArrow(run, f"key {kind}, n_words bigint, n_removed bigint, kept string")
    return out.withColumnRenamed("key", key)
