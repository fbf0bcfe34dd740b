"""Near-duplicate texts: n-gram Jaccard join by grouped prefixes, and their components.

A document's set are the hashes of its distinct 5-word shingles. Sets are put in one global
order, in which shingles known to be frequent come last. Two sets with a Jaccard similarity
of at least t share an element among the first n - ceil(t n) + 1 of each, their prefixes.
Documents with equal sets count as one; sets with the same prefix and size form one group.
Groups that share a prefix element, and whose sizes and positions allow the similarity, are
candidates; their members are compared by their whole sets.

Links are only needed up to components. So candidates are verified in two rounds: first
each group against the hub of every prefix element, its group with the smallest document;
then what is left in different components. A group of copies of any size thus costs pairs
in proportion to its size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from agentlake.llm.common import bit_filter, list_array, passes, settle, slices, written
from agentlake.llm.graph import components
from agentlake.llm.words import Words, mix

WORDS = 5
#: The similarity as a fraction: 100 * intersection >= 75 * union.
PART, WHOLE = 75, 100
#: Shingles that may be moved to the end of the order, those with the highest counts. The
#: number bounds what is broadcast; others stay where their hash puts them.
FREQUENT = 1 << 17
#: Elements that two sets must share early in their prefixes, if these reach so far.
EARLY = 8
#: A task reports shingles that at least so many documents of one of its slices hold.
REPORTED = 4
_SLICE = 2 << 20


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, one after another, and their numbers.

    A text of fewer than five words has one shingle, its whole sequence; one without words
    has none. Hashes fill 63 bits.
    """
    words = Words(texts, lower=True)
    hashes, first = words.windows(WORDS)
    rows = words.rows[first]
    short = np.flatnonzero((words.counts > 0) & (words.counts < WORDS))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(WORDS - 1):
                some = words.counts[short] > k
                whole[some] = mix(whole[some] + words.hashes[words.first[short[some]] + k] + np.uint64(k + 1))
        hashes, rows = np.concatenate([hashes, whole]), np.concatenate([rows, short])
    hashes = (hashes >> np.uint64(1)).astype(np.int64)
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    hashes, rows = hashes[new], rows[new]
    return hashes, np.bincount(rows, minlength=len(words.counts))


def least_overlap(n: int | np.ndarray):
    """ceil(t n): what a set of n elements must share with any similar one."""
    return -(-PART * n // WHOLE)


def frequent_shingles(docs: DataFrame, most: int = FREQUENT) -> np.ndarray:
    """Shingles that many documents hold, sorted; a bounded number.

    Every document is read. A task sums up slices of its texts and reports what at least
    ``REPORTED`` of a slice's documents share; the sums over all tasks rank the shingles. The
    order they give only affects the amount of work, never the result.
    """

    def run(batches):
        for part in slices(batches, "text", _SLICE):
            hashes, _ = shingle_sets(part.column("text"))
            hashes.sort()
            starts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
            counts = np.diff(np.append(starts, len(hashes)))
            many = counts >= REPORTED
            yield pa.RecordBatch.from_arrays([pa.array(hashes[starts[many]]), pa.array(counts[many])], ["h", "n"])

    sums = docs.select("text").mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    top = sums.orderBy(F.col("n").desc(), "h").limit(most).toPandas()
    # In ascending order of counts, so that the rarest of them come first.
    top = top.sort_values(["n", "h"])
    return top["h"].to_numpy(np.int64)


def _ordered(hashes: np.ndarray, counts: np.ndarray, frequent: np.ndarray, rank: np.ndarray):
    """Each set in the global order: positions of the elements, and the sets' bounds."""
    ends = np.cumsum(counts)
    rows = np.repeat(np.arange(len(counts)), counts)
    at = np.searchsorted(frequent, hashes)
    at[at == len(frequent)] = 0
    known = frequent[at] == hashes if len(frequent) else np.zeros(len(hashes), bool)
    late = np.where(known, rank[at] + 1 if len(frequent) else 0, 0)
    return np.lexsort((hashes, late, rows)), ends


def _prefixes(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """``id, n, set, prefix, like``: size, fingerprint of the whole set, the prefix in the global order, its digest.

    Written, like all that needs a broadcast here: nothing reads that again, so no node keeps it.
    """
    order = np.argsort(frequent)
    table = docs.sparkSession.sparkContext.broadcast((frequent[order], order))  # at most FREQUENT of each

    def run(batches):
        known, rank = table.value
        for part in slices(batches, "text", _SLICE):
            hashes, counts = shingle_sets(part.column("text"))
            place, ends = _ordered(hashes, counts, known, rank)
            starts = ends - counts
            some = counts > 0
            prefix = np.where(some, counts - least_overlap(counts) + 1, 0)
            inside = np.arange(len(hashes)) - np.repeat(starts, counts) < np.repeat(prefix, counts)
            print_ = [np.zeros(len(counts), np.uint64) for _ in range(2)]
            if len(hashes):
                for k, out in enumerate(print_):
                    out[some] = np.add.reduceat(mix(hashes.astype(np.uint64) + np.uint64(k + 1)), starts[some])
            packed = pa.array([a.tobytes() + b.tobytes() for a, b in zip(*print_, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(counts.astype(np.int64)), packed, list_array(hashes[place][inside], np.cumsum(prefix), pa.int64())],
                ["id", "n", "set", "prefix"],
            )

    sets = docs.mapInArrow(run, "id bigint, n bigint, set binary, prefix array<bigint>")
    out = written(sets.withColumn("like", F.xxhash64("n", "prefix")), "prefixes")
    table.destroy()
    return out


def packed_sets(hashes: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Sorted sets cut to as many leading bits as give gaps of about 2^15, as 16-bit gaps.

    A gap of 65535 or more is written as that many 65535 and the rest.
    """
    bits = np.minimum(63, 15 + np.ceil(np.log2(np.maximum(counts, 1))).astype(np.int64))
    starts = np.cumsum(counts) - counts
    values = hashes >> np.repeat(63 - bits, counts)
    gaps = np.diff(values, prepend=0)
    some = starts[counts > 0]
    gaps[some] = values[some]
    over = gaps // 65535
    width = over + 1
    out = np.full(int(width.sum()), 65535, np.uint16)
    out[np.cumsum(width) - 1] = gaps - over * 65535
    ends = np.concatenate([[0], np.cumsum(width)])[np.cumsum(counts)]
    return [out[e - w : e].tobytes() for e, w in zip(ends, np.diff(ends, prepend=0), strict=True)]


def _unpacked(body: bytes) -> np.ndarray:
    codes = np.frombuffer(body, np.uint16).astype(np.int64)
    return np.cumsum(codes)[codes < 65535]


def _about_shared(x: bytes, y: bytes) -> tuple[int, int, int]:
    """Sizes of two packed sets, and how many elements of the first the second seems to have, never too few."""
    a, b = _unpacked(x), _unpacked(y)
    of = [15 + int(np.ceil(np.log2(max(1, len(v))))) for v in (a, b)]
    a, b = a >> max(0, of[0] - of[1]), b >> max(0, of[1] - of[0])
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return len(a), len(b), int((b[at] == a).sum())


def _sets_of(docs: DataFrame, ids: DataFrame, packed: bool) -> DataFrame:
    """``id, size, elements`` of the documents in ``ids``, and of few others.

    Written, so that both sides of a pair read them and no task runs two Python workers.
    """
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(ids, "id"))  # FILTER_BITS

    def run(batches):
        for part in slices(batches, "text", _SLICE):
            keys = part.column("id").fill_null(-1).to_numpy()
            part = part.filter(pa.array(passes(bits.value, keys)))
            if not part.num_rows:
                continue
            hashes, counts = shingle_sets(part.column("text"))
            elements = pa.array(packed_sets(hashes, counts), pa.binary()) if packed else list_array(hashes, np.cumsum(counts), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(counts.astype(np.int64)), elements], ["id", "size", "elements"])

    out = written(docs.mapInArrow(run, f"id bigint, size bigint, elements {'binary' if packed else 'array<bigint>'}"), "sets")
    bits.destroy()
    return out


def _compared(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs ``a, b`` of documents whose sets are similar, by their whole sets.

    ``pairs``: ``a, na, b, nb`` with the sizes, which tell rows of a repeated key apart. First by packed
    sets, which can only overstate what two sets share; pairs that are similar by a narrow margin are
    decided by all bits.
    """
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()

    def beside(pairs, elements):
        of_a = elements.withColumnsRenamed({"id": "a", "size": "na", "elements": "x"})
        of_b = elements.withColumnsRenamed({"id": "b", "size": "nb", "elements": "y"})
        return pairs.join(of_a, ["a", "na"]).join(of_b, ["b", "nb"])

    def judge(batches):
        for batch in batches:
            verdicts = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                n, m, shared = _about_shared(x, y)
                over = shared - -(-PART * (n + m) // (PART + WHOLE))
                # By chance one element in 2^14 or fewer seems shared.
                verdicts.append(0 if over < 0 else 1 if over < 8 + n // 2048 else 2)
            keys = [batch.column(c) for c in ("a", "na", "b", "nb")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(verdicts, pa.int32())], ["a", "na", "b", "nb", "verdict"])

    judged = beside(pairs, _sets_of(docs, ids, packed=True)).mapInArrow(judge, "a bigint, na bigint, b bigint, nb bigint, verdict int")
    judged = written(judged.where("verdict > 0"), "judged")
    narrow = judged.where("verdict = 1").drop("verdict")
    close = beside(narrow, _sets_of(docs, narrow.select(F.explode(F.array("a", "b")).alias("id")).distinct(), packed=False))
    shared = F.size(F.array_intersect("x", "y"))
    sure = close.where(WHOLE * shared >= PART * (F.col("na") + F.col("nb") - shared))
    return judged.where("verdict = 2").select("a", "b").unionAll(sure.select("a", "b"))


def _similar_sizes(a: str, b: str):
    return (F.col(a) * WHOLE >= F.col(b) * PART) & (F.col(b) * WHOLE >= F.col(a) * PART)


def distinct_documents(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``(nodes, extra)``: ``id, text`` rows in which an id has one text only, and the rows that were renamed for it.

    Of an id with several texts, that with the smallest digest keeps the id. The others, and
    all texts of rows without an id, get numbers above all ids: ``extra`` has ``id, digest,
    node`` for every distinct text of these ids, None if there are none. Rows that repeat an
    id with an equal text stay as they are.
    """
    spread = rows.groupBy("id").agg(F.min(F.xxhash64("text")).alias("low"), F.max(F.xxhash64("text")).alias("high"))
    settle(rows.sparkSession)
    several = written(spread.where("id IS NULL OR low <> high").select("id"), "several")
    if several.isEmpty():
        return rows, None
    again = several.select(F.col("id").alias("again"))
    same = F.col("id").eqNullSafe(F.col("again"))
    digest = F.sha2("text", 256).alias("digest")
    texts = rows.join(again, same).select("id", "text", digest).dropDuplicates(["id", "digest"])
    top = rows.select(F.greatest(F.lit(0).cast("bigint"), F.max("id"))).first()[0] or 0
    if top >= 1 << 62:
        raise ValueError("ids above 2^62 leave no numbers for their further texts")
    least = texts.where("id IS NOT NULL").groupBy("id").agg(F.min("digest").alias("least"))
    number = F.lit(top + 1) + F.monotonically_increasing_id()
    # A written table, so that numbers do not change when it is read again.
    node = F.when(F.col("digest") == F.col("least"), F.col("id")).otherwise(number)
    extra = written(texts.join(least, "id", "left").withColumn("node", node).drop("least"), "extra")
    nodes = rows.join(again, same, "left_anti").unionByName(extra.select(F.col("node").alias("id"), "text"))
    return nodes, extra.select("id", "digest", "node")


def near_duplicate_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_shingles, component_id`` for every row of ``docs``.

    Keys are integers. Null, empty and blank texts have no shingles and link with nothing.
    Rows without a key link with nothing and come back with a null component. Rows that
    repeat a key are one document, linked by all its texts; each has its own ``n_shingles``.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    nodes, extra = distinct_documents(rows.where("id IS NOT NULL"))
    if extra is None:
        return _named(_components_of(rows), key)
    part = written(_components_of(nodes, extra.where("node <> id").select(F.col("node").alias("a"), F.col("id").alias("b"))), "nodes")
    # The least number of a component is an id: texts with other numbers are linked to theirs.
    renamed = extra.withColumnRenamed("id", "key").join(part.dropDuplicates(["id"]), F.col("node") == F.col("id")).select("key", "digest", "n", "component")
    again = extra.select("id").distinct()
    digests = rows.join(again, "id").select("id", F.sha2("text", 256).alias("digest"))
    of_extra = digests.join(renamed, (F.col("id") == F.col("key")) & (digests["digest"] == renamed["digest"])).select("id", "n", "component")
    others = part.join(extra.select(F.col("node").alias("id")), "id", "left_anti").select("id", "n", "component")
    keyless = _components_of(rows.where("id IS NULL")) if not rows.where("id IS NULL").isEmpty() else others.limit(0)
    return _named(others.unionByName(of_extra).unionByName(keyless), key)


def _named(found: DataFrame, key: str) -> DataFrame:
    return found.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def keep_one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near-duplicate texts.

    Every distinct text of a key, and of rows without a key, is judged by itself, so a key
    with one copied text keeps its others. Of a group, a text under its own key with the
    smallest number stays. Of rows that repeat key and text, the least by their other
    columns stays; texts without shingles are no copies of each other.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    nodes, extra = distinct_documents(rows)
    part = written(_components_of(nodes), "nodes")
    gone = part.where("id <> component").select("id").distinct()
    if extra is not None:
        moved = extra.select(F.col("id").alias("key"), "digest", "node")
        bad = gone.join(moved, F.col("id") == F.col("node")).select("key", "digest")
        renamed = extra.select(F.col("id").alias("key")).distinct()
        given = F.col(key).cast("bigint")
        digest = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
        some = docs.join(renamed, given.eqNullSafe(F.col("key")), "left_semi").join(bad, given.eqNullSafe(F.col("key")) & (digest == F.col("digest")), "left_anti")
        docs = docs.join(renamed, given.eqNullSafe(F.col("key")), "left_anti")
        gone = gone.join(extra.select(F.col("node").alias("id")), "id", "left_anti")
    kept = docs.join(gone.withColumnRenamed("id", "gone"), F.col(key).cast("bigint") == F.col("gone"), "left_anti")
    return _least(kept if extra is None else kept.unionByName(some), [key, text])


def _least(df: DataFrame, by: list[str]) -> DataFrame:
    """One row of each value of ``by``, the least by the other columns."""
    rest = [c for c in df.columns if c not in by]
    if not rest:
        return df
    one = df.groupBy(*by).agg(F.min(F.struct(*[F.col(c) for c in rest])).alias("row"))
    return one.select(*[F.col(c) if c in by else F.col("row").getField(c).alias(c) for c in df.columns])


def _components_of(rows: DataFrame, ties: DataFrame | None = None) -> DataFrame:
    """``id, n, component`` for every row; an id has one text. ``ties`` are further links ``a, b``."""
    sets = _prefixes(rows, frequent_shingles(rows))
    usable = sets.where("id IS NOT NULL AND n > 0")
    # Equal sets are one, with the smallest id; of these, those of one size and prefix one group.
    same = usable.groupBy("n", "set").agg(F.min("id").alias("id"), F.first("like").alias("like"))
    distinct = written(same.groupBy("id").agg(F.min(F.struct("n", "like")).alias("own")).select("id", "own.*"), "distinct")
    group_of = distinct.groupBy("like").agg(F.min("id").alias("group"))
    members = written(distinct.join(group_of, "like").select("group", "id", "n", "like"), "members")
    # The first document of each group brings the group's prefix.
    heads = members.where("group = id").select("id", "like")
    prefixes = usable.select("id", "like", "n", "prefix").join(heads.withColumnRenamed("like", "own"), "id").where("like = own").dropDuplicates(["id"])
    seats = prefixes.select(F.col("id").alias("group"), "n", F.posexplode("prefix").alias("pos", "h"))
    # Beyond the FREQUENT ones no shingle is in more than one FREQUENT-th of all seats.
    holders = Window.partitionBy("h")
    postings = written(
        seats.withColumn("holders", F.count(F.lit(1)).over(holders)).withColumn("hub", F.min(F.struct("group", "n", "pos")).over(holders))
        .where("holders > 1").drop("holders"),
        "postings",
    )

    # First round: every group against the hub of each of its elements, every member of a
    # group against the group's head.
    near = postings.where(F.col("hub.group") != F.col("group")).selectExpr(
        "hub.group AS a", "hub.n AS na", "hub.pos AS pa", "group AS b", "n AS nb", "pos AS pb"
    )
    inner = members.where("group <> id").selectExpr("group AS a", "n AS na", "id AS b", "n AS nb")
    columns = ["a", "na", "b", "nb"]
    first = written(near.where(_possible() & _early()).select(columns).unionAll(inner).distinct(), "pairs")
    links = written(_compared(first, rows), "links")

    # Second round: pairs still in different components, all members of both groups.
    settle(rows.sparkSession)
    part = components(links)
    placed = written(
        members.join(part.withColumnRenamed("node", "id"), "id", "left").select("group", "id", "n", F.coalesce("component", "id").alias("part")), "parts"
    )
    groups = placed.groupBy("group").agg(F.min("part").alias("low"), F.max("part").alias("high"))
    seated = postings.drop("hub").join(groups, "group")
    spans = seated.withColumn("least", F.min("low").over(holders)).withColumn("most", F.max("high").over(holders))
    open_ = written(spans.where("least <> most").drop("least", "most"), "open")
    left = open_.select("h", *[F.col(c).alias(f"{c}_a") for c in ("group", "n", "pos", "low", "high")])
    right = open_.select("h", *[F.col(c).alias(f"{c}_b") for c in ("group", "n", "pos", "low", "high")])
    apart = (F.col("low_a") != F.col("low_b")) | (F.col("high_a") != F.col("high_b")) | (F.col("low_a") != F.col("high_a"))
    met = left.join(right, "h").where((F.col("group_a") < F.col("group_b")) & apart).selectExpr(
        "group_a AS ga", "group_b AS gb", "n_a AS na", "n_b AS nb", "pos_a AS pa", "pos_b AS pb"
    )
    within = groups.where("low <> high").selectExpr("group AS ga", "group AS gb")
    # All that a pair in different components shares is among these, so it can be counted.
    counted = met.where(_possible() & _early()).groupBy("ga", "gb").agg(F.first(_asked()).alias("asked"), F.count(F.lit(1)).alias("c"))
    pairs = counted.where("c >= asked").select("ga", "gb").unionAll(within)
    of_a = placed.selectExpr("group AS ga", "id AS x", "n AS nx", "part AS px")
    of_b = placed.selectExpr("group AS gb", "id AS y", "n AS ny", "part AS py")
    expanded = pairs.join(of_a, "ga").join(of_b, "gb").where("px <> py")
    ordered = expanded.selectExpr(
        "least(x, y) AS a", "IF(x < y, nx, ny) AS na", "greatest(x, y) AS b", "IF(x < y, ny, nx) AS nb"
    ).distinct()
    done = first.selectExpr("least(a, b) AS a", "IF(a < b, na, nb) AS na", "greatest(a, b) AS b", "IF(a < b, nb, na) AS nb")
    rest = written(ordered.join(done, columns, "left_anti"), "pairs")
    links = written(links.unionAll(_compared(rest, rows)), "links")

    settle(rows.sparkSession)
    # Documents with equal sets are linked too.
    reps = same.select("n", "set", F.col("id").alias("rep"))
    equal = usable.select("id", "n", "set").join(reps, ["n", "set"]).where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    part = components(links.unionAll(equal) if ties is None else links.unionAll(equal).unionAll(ties))
    out = sets.select("id", "n").join(part.withColumnRenamed("node", "id"), "id", "left")
    return out.select("id", "n", F.coalesce("component", "id").alias("component"))


def _overlap():
    """What sets of sizes ``na`` and ``nb`` must share to be similar."""
    return F.ceil((F.col("na") + F.col("nb")) * PART / (PART + WHOLE))


def _asked():
    """Number of elements to be shared early, as far as the prefixes reach, up to ``EARLY``."""
    return F.least(F.lit(EARLY), _overlap() - F.ceil(F.greatest("na", "nb") * PART / WHOLE) + 1)


def _early():
    """Whether an element stands early enough: similar sets share k of the first n - overlap + k of each."""
    return (F.col("pa") < F.col("na") - _overlap() + _asked()) & (F.col("pb") < F.col("nb") - _overlap() + _asked())


def _possible():
    """Sizes ``na, nb`` and positions ``pa, pb`` of a shared element that allow the similarity.

    At most the elements before it and those after it in the shorter of both are shared.
    """
    after = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    return _similar_sizes("na", "nb") & (after + F.least("pa", "pb") >= _overlap())
