"""Token streams: vocabularies, decoding, special tokens.

``vocab(id, token)`` has unique ids; ``tokens(stream_id, pos, id)`` has one row per
position, counted from 0 within its stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agentlake.functions.bytes import SPM_SPACE, byte_alphabet, byte_level_bytes, decode_text, spm_bytes
from agentlake.functions.json_text import canonical_text
from agentlake.functions.text import THINK_MARKERS
from agentlake.operators import scans

# Token of unknown ids, and what a cleaned space may not stand before.
UNKNOWN_TOKEN = "!"
TIGHT = [".", "?", "!", ",", "n't", "'m", "'s", "'ve", "'re"]

# Decoder descriptions that mark an SPM vocabulary, with and without the strip step.
SPM_DECODER = (
    '{"type":"Sequence","decoders":[{"type":"Replace","pattern":{"String":"▁"},"content":" "},'
    '{"type":"ByteFallback"},{"type":"Fuse"},{"type":"Strip","content":" ","start":1,"stop":0}]}'
)
SPM_DECODER_NO_STRIP = (
    '{"type":"Sequence","decoders":[{"type":"Replace","pattern":{"String":"▁"},"content":" "},'
    '{"type":"ByteFallback"},{"type":"Fuse"}]}'
)

SEGMENT = 1 << 16


def vocab_bytes(spark: SparkSession) -> DataFrame:
    """The 256 bytes and their printable characters: ``(byte, char)``."""
    rows = F.array(*[F.lit(c) for c in byte_alphabet()])
    return spark.range(1).select(F.posexplode(rows).alias("byte", "char"))


KINDS = ("byte_level", "spm", "spm_no_strip", "naive")


def unknown_piece(kind: str) -> str:
    """What an id outside the vocabulary decodes to; unknown kinds raise."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {', '.join(KINDS)}, not {kind!r}")
    return UNKNOWN_TOKEN if kind == "byte_level" else ""


def vocab_pieces(vocab: DataFrame, kind: str) -> DataFrame:
    """The vocabulary with the bytes of each token: ``(id, piece)``.

    Done once per vocabulary entry, not per occurrence. ``naive`` tokens are plain text.
    """
    unknown_piece(kind)
    token = F.col("token")
    if kind == "byte_level":
        piece = byte_level_bytes(token)
    else:
        piece = F.encode(token, "UTF-8") if kind == "naive" else spm_bytes(token)
    return vocab.select("id", piece.alias("piece"))


def vocab_join(tokens: DataFrame, vocab: DataFrame, columns: tuple[str, ...] = ("token",)) -> DataFrame:
    """Tokens with the wanted vocabulary columns, NULL for unknown ids.

    A vocabulary that measures small is broadcast by Spark; beyond that the join
    shuffles on ``id`` and adaptive execution splits the partitions of frequent ids.
    """
    return tokens.join(vocab.select("id", *columns), "id", "left")


def token_text(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """Tokens with their vocabulary text, ``!`` where the id is unknown."""
    joined = vocab_join(tokens, vocab)
    return joined.withColumn("token", F.coalesce("token", F.lit(UNKNOWN_TOKEN)))


def decoder_kind(decoder: Column, canonical) -> Column:
    """Detokenizer for a decoder description: spm, spm_no_strip, byte_level or naive.

    ``canonical`` is ``json_text.canonical_json``: the descriptions must be equal in
    depth and type, whatever their key order.
    """
    text = canonical(decoder)
    return (
        F.when(text == canonical_text(SPM_DECODER), "spm")
        .when(text == canonical_text(SPM_DECODER_NO_STRIP), "spm_no_strip")
        .when(F.get_json_object(decoder, "$.type") == "ByteLevel", "byte_level")
        .otherwise("naive")
    )


_TIGHT_HEX = "|".join(t.encode().hex().upper() for t in TIGHT)
_X = "[0-9A-F]"
_Y = f"[89AB]{_X}"
# A space can only go behind a whole character: well-formed ones of one to four bytes.
_WHOLE = [
    f"[0-7]{_X}",
    f"(?:C[2-9A-F]|D{_X}){_Y}",
    f"(?:E0[AB]{_X}|E[1-9A-CEF]{_Y}|ED[89]{_X}){_Y}",
    f"(?:F0[9AB]{_X}|F[1-3]{_Y}|F48{_X}){_Y}{_Y}",
]
#: Marks that change nothing, in token bytes in hex, each piece behind ``|``: of pieces that go on
#: with a character, and of empty ones, unless these come after a lone space and show it.
IDLE_MARK = r"(?<!\|20)\|(?=\||$)|\|(?=[89AB])"
#: What becomes ``|`` then: a space in front of punctuation that opens a printable piece. It stays
#: behind a lone space and a replacement character. Java and Python read the pattern alike.
TIGHT_SPACE = (
    r"(?<!\|20)(?<!EFBFBD)(?:" + "|".join(f"(?<={w})" for w in _WHOLE) + rf")\|20(?:\|(?={_TIGHT_HEX})|(?={_TIGHT_HEX}))"
)
#: Token bytes in hex before which a text can be cut, and both parts decoded on their own:
#: what starts a character and, cleaned, does not decide on a space at the cut.
OPENS = "(?=[0-7C-F])"
OPENS_CLEAN = f"{OPENS}(?!20(?:[|]|$))(?!(?:20)?(?:{_TIGHT_HEX}))"


def detokenize(
    tokens: DataFrame,
    vocab: DataFrame,
    kind: str,
    trim_space: bool = True,
    clean: bool = False,
    segment: int = SEGMENT,
) -> DataFrame:
    """Text of every stream: ``(stream_id, segment, text)``, for a ``kind`` of ``KINDS``.

    A stream longer than ``segment`` tokens comes as several rows whose texts in order
    make the whole, so no task holds a stream of unknown length. A row begins at the
    first token at or after a multiple of ``segment`` before which the text may be cut;
    where a block of that many tokens has none, its row is missing and the one before
    goes on. So the text does not depend on ``segment``. A leading space is dropped for
    ``byte_level`` and, with ``trim_space``, ``spm``, there after all leading tokens that
    are just a space. ``clean`` (byte level) drops spaces before punctuation.

    Tokens are read and shuffled once. What a block holds before its first opening token
    goes to its owner, the last block before that has one.
    """
    unknown = F.encode(F.lit(unknown_piece(kind)), "UTF-8")
    clean, strip = clean and kind == "byte_level", trim_space and kind == "spm"
    may_open = lambda piece: F.hex(piece).rlike("^" + (OPENS_CLEAN if clean else OPENS))
    pieces = vocab_pieces(vocab, kind).withColumn("opens", may_open(F.col("piece")))
    rows = vocab_join(tokens, pieces, ("piece", "opens")).select(
        "stream_id", "pos", F.floor(F.col("pos") / segment).cast("bigint").alias("block"),
        F.coalesce("piece", unknown).alias("piece"), F.coalesce("opens", may_open(unknown)).alias("opens"),
    )
    if not clean:
        rows = rows.where((F.length("piece") > 0) | (F.col("pos") == 0))
    space = F.col("piece") == F.encode(F.lit(" "), "UTF-8") if strip else F.lit(False)
    upto = Window.partitionBy("stream_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("own", F.max((F.col("block") == 0) | F.col("opens")).over(upto)).withColumn(
        "shown", F.max((F.length("piece") > 0) & ~space).over(upto)
    )
    body = "concat('|', listagg(hex(piece), '|') WITHIN GROUP (ORDER BY pos))" if clean else "listagg(piece) WITHIN GROUP (ORDER BY pos)"
    parts = marked.groupBy("stream_id", "block", "own").agg(
        F.expr(body).alias("body"), F.count_if(space & ~F.col("shown")).alias("spaces"), F.max("shown").alias("shown")
    )
    # Both uses below take all of a block's column of every block, and their filters stand above a
    # generator, so Spark makes the parts, and shuffles what they are made of, once.
    blocks = parts.groupBy("stream_id", "block").agg(F.collect_list(F.struct("own", "body", "spaces", "shown")).alias("parts"))
    blocks = blocks.select(F.struct("stream_id", "block").alias("at"), "parts").repartition("at")
    owned = _heads(blocks)
    own = blocks.select("at", F.inline_outer(F.filter("parts", lambda part: part["own"]))).where("own")
    whole = own.join(owned, F.col("at") == F.col("_owner"), "left").select("at.*", "body", "spaces", "heads", "leads")
    raw = F.concat("body", F.coalesce("heads", F.lit("") if clean else F.encode(F.lit(""), "UTF-8")))
    if clean:
        tight = F.regexp_replace(F.regexp_replace(raw, IDLE_MARK, ""), TIGHT_SPACE, "|")
        raw = F.unhex(F.replace(tight, F.lit("|"), F.lit("")))
    text = decode_text(raw)
    if kind in ("spm", "spm_no_strip"):
        text = F.replace(text, F.lit(SPM_SPACE), F.lit(" "))
    out = whole.withColumn("text", text)
    if strip or kind == "byte_level":
        rest = F.expr("substring(text, CAST(spaces AS INT) + 1)")
        opened = F.when(rest.startswith(" "), F.substring(rest, F.lit(2), F.length(rest))).otherwise(rest)
        out = out.withColumn("text", F.when(F.col("leads"), opened).otherwise(F.col("text")))
    return out.select("stream_id", F.col("block").alias("segment"), "text")


def _heads(blocks: DataFrame) -> DataFrame:
    """Per owning block what it gains, and whether nothing is shown before it.

    ``(_owner, heads, leads)``; a block has at most two parts, of which only the few bytes
    before the opening token travel.
    """
    slim = F.transform("parts", lambda p: F.struct(p["own"].alias("own"), p["shown"].alias("shown"), F.when(~p["own"], p["body"]).alias("head")))
    parts = blocks.select("at.*", F.inline_outer(slim))
    before = Window.partitionBy("stream_id").orderBy("block", "own").rowsBetween(Window.unboundedPreceding, 0)
    strictly = Window.partitionBy("stream_id").orderBy("block", "own").rowsBetween(Window.unboundedPreceding, -1)
    chained = parts.select(
        "stream_id", "block", "own", "head",
        F.last(F.when(F.col("own"), F.col("block")), ignorenulls=True).over(before).alias("owner"),
        F.coalesce(F.max("shown").over(strictly), F.lit(False)).alias("seen"),
    )
    gained = chained.groupBy("stream_id", "owner").agg(
        F.expr("listagg(head) WITHIN GROUP (ORDER BY block)").alias("heads"),
        F.max(F.col("own") & ~F.col("seen")).alias("leads"),
    )
    return gained.select(F.struct("stream_id", F.col("owner").alias("block")).alias("_owner"), "heads", "leads")


#: Every text that a cast takes for an integer; it passes over white space and control characters at the ends.
INTEGER = r"\A[\x00-\x20\x7F]*[+-]?[0-9]+[\x00-\x20\x7F]*\z"


def resolve_eos(specs: DataFrame, vocab: DataFrame) -> DataFrame:
    """Specs ``(…, spec)`` with ``eos_id``: integer text is an id, other text a token.

    Unknown tokens get ``error``.
    """
    # Only what reads as an integer is cast: a cast that fails costs more than all the rest of a row.
    as_id = F.when(F.col("spec").rlike(INTEGER), F.trim("spec").try_cast("bigint"))
    # Tokens are distinct, so each partition's share of them is hashed, and the specs need no sort.
    ids = vocab.select(F.col("token").alias("spec"), F.col("id").alias("_id")).hint("shuffle_hash")
    joined = specs.join(ids, "spec", "left")
    error = F.concat(F.lit("'"), F.col("spec"), F.lit("' is not a token for this tokenizer"))
    return (
        joined.withColumn("eos_id", F.coalesce(as_id, "_id"))
        .withColumn("error", F.when(F.col("eos_id").isNull(), error))
        .drop("_id")
    )


def marker_support(models: DataFrame, vocab: DataFrame) -> DataFrame:
    """Which think markers and whether tool calling each model's vocabulary allows.

    ``models(model, tool_start, tool_end, start_pieces, end_pieces)`` gives the tool
    delimiters and how many tokens each encodes to; ``vocab(model, token)``. The first
    marker pair wholly in the vocabulary wins. A delimiter that is neither in the
    vocabulary nor made of several tokens disables tool calls. Only marker tokens
    reach the join, already reduced to one row per model.
    """
    token = F.col("token")
    marks = [m for pair in THINK_MARKERS for m in pair]
    delimiters = models.select("model", F.explode(F.array("tool_start", "tool_end")).alias("token")).distinct()
    found_delimiters = (
        vocab.join(delimiters, ["model", "token"], "left_semi")
        .groupBy("model", "token").agg(F.lit(1).alias("_one"))
        .groupBy("model").agg(F.collect_set("token").alias("_found"))
    )
    found_marks = vocab.where(token.isin(marks)).groupBy("model").agg(
        *[F.bool_or(token == mark).alias(f"_m{i}") for i, mark in enumerate(marks)]
    )
    joined = models.join(found_marks, "model", "left").join(found_delimiters, "model", "left")
    chain = None
    for i, (start, end) in enumerate(THINK_MARKERS):
        both = F.col(f"_m{2 * i}") & F.col(f"_m{2 * i + 1}")
        value = F.struct(F.lit(start).alias("s"), F.lit(end).alias("e"))
        chain = F.when(both, value) if chain is None else chain.when(both, value)

    def usable(delimiter, pieces):
        known = F.coalesce(F.array_contains("_found", F.col(delimiter)), F.lit(False))
        return F.col(delimiter).isNull() | (F.col(delimiter) == "") | known | (F.col(pieces) > 1)

    tools = F.col("tool_start").isNotNull() & usable("tool_start", "start_pieces") & usable("tool_end", "end_pieces")
    return joined.select(
        "model", chain["s"].alias("think_start"), chain["e"].alias("think_end"), tools.alias("tool_calling")
    )


def last_segment(reads: DataFrame, key: str, order: str, text: str = "text") -> DataFrame:
    """Characters new since the previous read of a growing text: ``(key, order, segment)``."""
    lengths = reads.withColumn("_n", F.length(text))
    seen = scans.previous(lengths, [key], order, "_n", "_seen")
    segment = F.substring(F.col(text), F.coalesce("_seen", F.lit(0)) + 1, F.greatest(F.length(text), F.lit(1)))
    return seen.select(key, order, segment.alias("segment"))
