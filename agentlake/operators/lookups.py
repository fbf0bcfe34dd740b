"""Documentation lookups and substring search across tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentlake.functions.binding import let
from agentlake.functions.text import usable_lookup

# Fixed value: tag of text from the secondary source.
SECONDARY_TAG = "[Context7]"
GRAM = 8


def skip_failed_lookup(results: DataFrame, text: str = "text") -> DataFrame:
    return results.where(usable_lookup(F.col(text)))


def lookup_docs(requests: DataFrame, primary: DataFrame, secondary: DataFrame, key: str) -> DataFrame:
    """``answer`` per request ``(key, library, topic)``: usable primary, then secondary text.

    Both sources hold at most one row ``(key, text)`` per request. Secondary text is
    tagged; a request with neither gets a not-found message.
    """
    first = skip_failed_lookup(primary).select(key, F.col("text").alias("_p"))
    second = skip_failed_lookup(secondary).select(key, F.concat(F.lit(SECONDARY_TAG + "\n"), F.col("text")).alias("_s"))
    nothing = F.concat(
        F.lit("No documentation found for '"), F.col("library"), F.lit("' - '"), F.col("topic"), F.lit("'")
    )
    joined = requests.join(first, key, "left").join(second, key, "left")
    found = F.nullif(F.concat_ws("\n\n", "_p", "_s"), F.lit(""))
    return joined.withColumn("answer", F.coalesce(found, nothing)).drop("_p", "_s")


def _words(text: str) -> Column:
    return F.split(text, r"\s+")


def _grams(words: Column) -> Column:
    """Hashes of all runs of eight words, by doubling: 1, 2, 4, then 8 words."""

    def double(hashes, step):
        def joined(h):
            later = F.slice(h, F.lit(step + 1), F.greatest(F.size(h) - step, F.lit(0)))
            return F.zip_with(h, later, lambda a, b: F.xxhash64(a, b))

        return let(hashes, joined)

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    step = 1
    while step < GRAM:
        hashes = double(hashes, step)
        step *= 2
    # The last hashes lack words; a text shorter than eight words has none.
    return let(hashes, lambda h: F.slice(h, F.lit(1), F.greatest(F.size(h) - (GRAM - 1), F.lit(0))))


def contained_in(patterns: DataFrame, texts: DataFrame, pattern: str, text: str, pid: str, tid: str) -> DataFrame:
    """All ``(pid, tid)`` where the pattern text occurs inside the other text.

    There is no equality to join on, so one is derived: every text holding a pattern
    also holds each of the pattern's keys. Keys are, by pattern length, runs of eight
    words inside the pattern, single words inside it, or its characters; inner words
    of a pattern are whole words of any text around it. A pattern is looked up by the
    one of its keys that the fewest texts have, so wording that many patterns and texts
    share brings no flood of pairs. Only pairs meeting on that key are tested with
    ``contains``. Patterns must be non-empty, ids unique.
    """
    words = _words(pattern)
    inner = F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))
    size, length = F.size(words), F.length(pattern)

    def hashed(values):
        return F.transform(values, lambda w: F.xxhash64(w))

    def windows(value, regex):
        return hashed(F.regexp_extract_all(value, F.lit(regex), F.lit(1)))

    threes, ones = "(?s)(?=(...))", "(?s)(.)"
    kinds = [
        (size >= GRAM + 2, _grams(inner), _grams(_words(text))),
        ((size >= 3) & (size < GRAM + 2), hashed(inner), hashed(_words(text))),
        ((size < 3) & (length >= 3), windows(F.col(pattern), threes), windows(F.col(text), threes)),
        ((size < 3) & (length < 3), windows(F.col(pattern), ones), windows(F.col(text), ones)),
    ]
    pairs = None
    for applies, wanted_keys, offered_keys in kinds:
        wanted = patterns.where(applies).select(pid, F.explode(F.array_distinct(wanted_keys)).alias("_key"))
        offered = texts.select(tid, F.explode(F.array_distinct(offered_keys)).alias("_key"))
        # Spread evenly and kept whole, this shuffle serves both the count and the
        # pairs, so the texts are cut into keys once.
        hits = offered.join(wanted.select("_key").distinct(), "_key", "left_semi").repartition(tid, "_key")
        counts = hits.groupBy("_key").agg(F.count(tid).alias("_texts"))
        rarest = wanted.join(counts, "_key", "left").groupBy(pid).agg(
            F.min(F.struct(F.coalesce("_texts", F.lit(0)).alias("n"), "_key")).alias("_best")
        )
        looked_up = rarest.where("_best.n > 0").select(pid, F.col("_best._key").alias("_key"))
        found = hits.join(looked_up, "_key").select(pid, tid)
        pairs = found if pairs is None else pairs.unionByName(found)
    candidates = pairs.join(patterns.select(pid, F.col(pattern).alias("_pattern")), pid)
    checked = texts.select(tid, F.col(text).alias("_text")).join(candidates, tid)
    return checked.where(F.contains("_text", "_pattern")).select(pid, tid)
