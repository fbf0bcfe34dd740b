"""Token decoding: byte table, batch segments and streams against a plain decoder."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from agentlake.functions import bytes as B
from agentlake.functions import json_text as J
from agentlake.functions import text as T
from agentlake.operators import tokens as K
from agentlake.streaming.detokenize import next_text, stream_detokenize
from agentlake.streaming.run import drain

TEXTS = [
    "Hello world, it's fine. Naïve café — “quoted” 日本語 🙂!",
    "  two spaces lead",
    " one space leads",
    "trailing ",
    "",
    "a",
    "tabs\tand\nnewlines ? and ! do n't",
]


def test_byte_table(spark):
    table = {r.byte: r.char for r in K.vocab_bytes(spark).collect()}
    assert len(table) == 256 and len(set(table.values())) == 256
    assert (table[0], table[32], table[172], table[173]) == ("Ā", "Ġ", "¬", "Ń")


def test_byte_level_round_trip(spark):
    texts = TEXTS + ["\0nul", "".join(map(chr, range(1, 600)))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    token = B.byte_level_token(F.col("t"))
    for row in df.select("t", token.alias("k"), B.byte_level_bytes(token).alias("b")).collect():
        assert bytes(row.b) == row.t.encode()
        assert not set(row.k) & set(" \n\t\0")


def test_byte_level_bytes_outside_the_alphabet(spark):
    df = spark.createDataFrame([("<｜a b｜>",), ("Ġé日",)], "t string")
    got = [bytes(r[0]) for r in df.select(B.byte_level_bytes(F.col("t"))).collect()]
    # "é" is the byte E9 in the alphabet, "日" is not part of it.
    assert got == ["<｜a b｜>".encode(), b" \xe9" + "日".encode()]


def split_bytes(text, rng):
    """The text's bytes cut anywhere, as a vocabulary of arbitrary pieces would."""
    raw, out = text.encode(), []
    while raw:
        n = rng.randint(1, 4)
        out.append(raw[:n])
        raw = raw[n:]
    return out


def token_tables(spark, streams, kind):
    """Tables for streams given as lists of pieces."""
    alphabet = B.byte_alphabet()
    pieces = sorted({p for stream in streams for p in stream})

    def token(piece):
        if kind == "byte_level":
            return "".join(alphabet[b] for b in piece)
        if kind == "naive":
            return piece.decode()
        if len(piece) == 1 and piece[0] >= 128:
            return f"<0x{piece[0]:02X}>"
        return piece.decode().replace(" ", "▁")

    vocab = spark.createDataFrame([(i, token(p)) for i, p in enumerate(pieces)], "id bigint, token string")
    ids = {p: i for i, p in enumerate(pieces)}
    rows = [
        (s, pos, ids[p], pos == len(stream) - 1) for s, stream in enumerate(streams) for pos, p in enumerate(stream)
    ]
    return spark.createDataFrame(rows, "stream_id bigint, pos bigint, id bigint, is_end boolean"), vocab


def plain_decode(pieces, kind, clean=False):
    """Piece by piece: hold unfinished text, trim spaces where a shown part opens."""
    text, held = "", b""

    def show(part):
        trims = not text and kind in ("byte_level", "spm")
        if part.startswith(" ") and (trims or (clean and part[1:].startswith(tuple(K.TIGHT)))):
            return part[1:]
        return part

    for piece in pieces:
        held += piece
        part = held.decode("utf-8", "replace")
        if not part.endswith("�") and not (kind == "byte_level" and piece == b" "):
            text, held = text + show(part), b""
    return text + show(held.decode("utf-8", "replace"))


def streams_for(kind, rng):
    if kind == "byte_level":
        streams = [split_bytes(t, rng) for t in TEXTS if t]
        streams += [[b"\xe2\x82", b"\xac"], [b"a", b"\xff", b"b", b"\xe2", b" ", b"."], [b"\x80", b"\x80", b"x"]]
        streams += [[b" ", b" ", b".", b" ", b".", b"x", b" .", b" ", b"'", b"s", b" 's", b" "]]
    else:
        streams = [[w for w in t.replace(" ", "| ").encode().split(b"|") if w] for t in TEXTS if t]
        streams += [[b" ", b" ", b" a", b" b"], [b"\xe2", b"\x82", b"\xac", b" x"], [b"  ", b"y"], [b" "]]
    streams.append([rng.choice([b"a", b" b", b"\xc3", b"\xa9", b" ", b"c."]) for _ in range(300)])
    if kind == "naive":
        return [[p for p in stream if p.isascii()] or [b"x"] for stream in streams]
    # Empty pieces between the bytes of a character, and before anything is shown.
    streams.append([b"\xe2", *[b""] * 70, b"\x82", b"", b"\xac", b" x", b" ", b"."])
    streams.append([b"", b"", b"", b" ", b" ", b"", b"", b" ", b" y", b" z"])
    streams.append([b"hi", b" ", b".", b" ", b"", b".", b" ", b" a", b" ", b"n't", b" ", b"n", b"'t"])
    streams.append([rng.choice([b"", b" ", b".", b" .", b"'s", b"a", b" b", b"\xe2", b"\x82", b"\xac"]) for _ in range(400)])
    return streams


CASES = [("byte_level", False), ("byte_level", True), ("spm", False), ("spm_no_strip", False), ("naive", False)]


@pytest.mark.parametrize("kind, clean", CASES)
@pytest.mark.parametrize("segment", [2, 7, 1 << 16])
def test_detokenize_in_segments(spark, kind, clean, segment):
    streams = streams_for(kind, random.Random(5))
    tokens, vocab = token_tables(spark, streams, kind)
    got = {}
    for row in K.detokenize(tokens, vocab, kind, clean=clean, segment=segment).orderBy("stream_id", "segment").collect():
        got[row.stream_id] = got.get(row.stream_id, "") + row.text
    for s, stream in enumerate(streams):
        assert got[s] == plain_decode(stream, kind, clean), stream


def test_unknown_kind(spark):
    tokens, vocab = token_tables(spark, [[b"a"]], "spm")
    with pytest.raises(ValueError):
        K.detokenize(tokens, vocab, "wordpiece")


@pytest.mark.parametrize("kind, clean", CASES)
def test_stream_equals_plain(spark, tmp_path, kind, clean):
    """Batches in shuffled order, and text keys."""
    streams = streams_for(kind, random.Random(7))
    tokens, vocab = token_tables(spark, streams, kind)
    tokens = tokens.withColumn("stream_id", F.concat(F.lit("s"), "stream_id"))
    source = str(tmp_path / "in")
    for part in (2, 0, 1):
        tokens.where(f"pos % 3 = {part}").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(tokens.schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = drain(spark, stream_detokenize(stream, vocab, kind, clean=clean), str(tmp_path / "run"), partitions=2)
    got = {}
    for row in out.orderBy("stream_id", "from_pos").collect():
        got[row.stream_id] = got.get(row.stream_id, "") + row.segment
    for s, stream_pieces in enumerate(streams):
        assert got[f"s{s}"] == plain_decode(stream_pieces, kind, clean), stream_pieces


@pytest.mark.parametrize("kind, clean", CASES)
def test_text_does_not_depend_on_batches(kind, clean):
    rng = random.Random(8)
    for stream in streams_for(kind, rng):
        held, started, text, at = "", False, "", 0
        while at < len(stream):
            to = min(len(stream), at + rng.randint(1, 4))
            part, held, started = next_text(
                kind, kind in ("byte_level", "spm"), clean, pd.Series(stream[at:to]), held, started, to == len(stream)
            )
            text, at = text + part, to
        assert text == plain_decode(stream, kind, clean), stream


def test_unknown_ids(spark):
    tokens, vocab = token_tables(spark, [[b"a", b" b"]], "byte_level")
    extra = tokens.unionByName(spark.createDataFrame([(0, 2, 99, True)], tokens.schema))
    assert K.detokenize(extra, vocab, "byte_level").first().text == "a b!"


def test_resolve_eos_and_markers(spark):
    vocab = spark.createDataFrame([(7, "</s>"), (8, "12")], "id bigint, token string")
    specs = spark.createDataFrame([("</s>",), ("12",), (" 5 ",), ("nope",)], "spec string")
    got = {r.spec: (r.eos_id, r.error) for r in K.resolve_eos(specs, vocab).collect()}
    assert got == {"</s>": (7, None), "12": (12, None), " 5 ": (5, None), "nope": (None, "'nope' is not a token for this tokenizer")}


def test_resolve_eos_casts_only_integers(spark):
    """Ids are those of the cast alone; a cast that fails raises inside Spark, tens of times the time of a row."""
    import time

    odd = ["5", " 5 ", "+5", "-5", "\t7\n", "\x00 8\x7f", "007", "5.", "5.0", ".5", "1e3", "0x1f", "+", "-", "", " ", "- 5", "5 5", "5a", "\u0663", "\u00a05",
           "\x855", "9223372036854775807", "9223372036854775808", "-9223372036854775808", "1" * 40, "0" * 40 + "1", "<none-3>", None]
    specs = spark.createDataFrame([(s,) for s in odd], "spec string").withColumn("want", F.trim("spec").try_cast("bigint"))
    vocab = spark.createDataFrame([], "id bigint, token string")
    assert all(r.eos_id == r.want for r in K.resolve_eos(specs, vocab).collect())
    rows = spark.range(400_000).coalesce(1)

    def seconds(spec):
        started = time.time()
        K.resolve_eos(rows.select(spec.alias("spec")), vocab).write.format("noop").mode("overwrite").save()
        return time.time() - started

    number, word = F.col("id").cast("string"), F.concat(F.lit("w"), F.col("id").cast("string"))
    seconds(number), seconds(word)
    assert seconds(word) < 4 * seconds(number) + 0.5


def test_resolve_eos_sorts_no_specs(spark):
    specs = spark.range(50).select(F.concat(F.lit("w"), F.col("id") % 5).alias("spec"))
    vocab = spark.range(3).select("id", F.concat(F.lit("w"), F.col("id")).alias("token"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = K.resolve_eos(specs, vocab)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "Sort" not in plan
        assert out.groupBy("eos_id").count().orderBy("eos_id").collect() == [(None, 20), (0, 10), (1, 10), (2, 10)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize(
    "decoder, kind",
    [
        (K.SPM_DECODER, "spm"),
        (K.SPM_DECODER_NO_STRIP, "spm_no_strip"),
        ('{"k": 1, "type": "ByteLevel"}', "byte_level"),
        (K.SPM_DECODER.replace('"start":1', '"start":1.0'), "naive"),
        ("[1]", "naive"),
        (None, "naive"),
    ],
)
def test_decoder_kind(spark, decoder, kind):
    df = spark.createDataFrame([(decoder,)], "d string")
    assert df.select(K.decoder_kind(F.col("d"), J.canonical_json)).first()[0] == kind


@pytest.mark.parametrize(
    "tokens, kept",
    [([1, 5, 2], [5]), ([1], []), ([2], []), ([5, 2], [5]), ([5], [5]), ([], []), ([1, 2, 2], [2]), ([1, 1], [1])],
)
def test_strip_bos_eos(spark, tokens, kept):
    df = spark.createDataFrame([(tokens,)], "t array<int>")
    assert df.select(T.strip_bos_eos(F.col("t"), F.lit(1), F.lit(2))).first()[0] == kept


def test_naive_stream_shows_whole_lines(spark, tmp_path):
    from agentlake.streaming.detokenize import stream_detokenize
    from agentlake.streaming.run import drain

    vocab = spark.createDataFrame([(0, "ab"), (1, "c\nd"), (2, "\n"), (3, "é")], "id bigint, token string")
    ids = [0, 1, 0, 3, 2, 0, 0, 1, 3]
    rows = [(s, p, i, p == len(ids) - 1) for s in (1, 2) for p, i in enumerate(ids)]
    tokens = spark.createDataFrame(rows, "stream_id bigint, pos bigint, id bigint, is_end boolean")
    source = str(tmp_path / "in")
    for part in ("pos = 1", "pos = 0", "pos IN (2, 3)", "pos > 4", "pos = 4"):
        tokens.where(part).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(tokens.schema).option("maxFilesPerTrigger", 1).parquet(source)
    got = drain(spark, stream_detokenize(stream, vocab, "naive"), str(tmp_path / "run"), partitions=2).collect()
    for s in (1, 2):
        own = sorted((r.from_pos, r.segment) for r in got if r.stream_id == s)
        assert own == [(0, "abc\n"), (4, "dabé\nababc\ndé")]


def test_too_many_waiting_tokens_fail_the_stream(spark, tmp_path):
    from agentlake.streaming.detokenize import stream_detokenize
    from agentlake.streaming.run import drain

    vocab = spark.createDataFrame([(0, "ab")], "id bigint, token string")
    spark.range(1, 30).selectExpr("77L AS stream_id", "id AS pos", "0L AS id", "false AS is_end").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("stream_id bigint, pos bigint, id bigint, is_end boolean").parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="stream 77: 29 tokens wait for position 0"):
        drain(spark, stream_detokenize(stream, vocab, "byte_level", most_waiting=20), str(tmp_path / "run"), partitions=1)


def test_detokenize_joins_and_decodes_once(spark):
    """The parts of blocks serve both the texts and what blocks gain from those after them."""
    tokens, vocab = token_tables(spark, [[b"a", b" b"], [b"c"]], "byte_level")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = K.detokenize(tokens, vocab, "byte_level")
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "ReusedExchange" in plan
    assert plan.count("SortMergeJoin") == 2, "one with the vocabulary, one of blocks"


def test_streams_of_tokens_share_entries_of_the_state(spark, tmp_path, monkeypatch):
    from agentlake.streaming import buckets

    monkeypatch.setattr(buckets, "BUCKETS", 2)
    vocab = spark.createDataFrame([(0, "ab"), (1, "Ġc")], "id bigint, token string")
    tokens = spark.range(400).selectExpr("id % 100 AS stream_id", "id div 100 AS pos", "id % 2 AS id", "id >= 300 AS is_end")
    source, run = str(tmp_path / "in"), str(tmp_path / "run")
    tokens.where("pos = 1 OR pos = 3").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(tokens.schema).parquet(source)
    assert drain(spark, stream_detokenize(stream, vocab, "byte_level"), run, partitions=2).count() == 0
    assert spark.read.format("statestore").option("stateVarName", "text").load(f"{run}/checkpoint").count() == 2
    tokens.where("pos = 0 OR pos = 2").coalesce(1).write.mode("append").parquet(source)
    got = drain(spark, stream_detokenize(stream, vocab, "byte_level"), run, partitions=2).collect()
    assert sorted(map(tuple, got)) == [(s, 0, "abababab" if s % 2 == 0 else "c c c c") for s in range(100)]
    assert spark.read.format("statestore").option("stateVarName", "text").load(f"{run}/checkpoint").count() == 0


class Held:
    """State of a processor, with the bytes that were written to it."""

    def __init__(self):
        self.kept, self.written, self.reads = {}, 0, 0

    def getValueState(self, *schema):
        return self

    getMapState = getValueState

    def getValue(self, key):
        self.reads += 1
        return self.kept[key]

    def updateValue(self, key, value):
        self.kept[key] = value
        self.written += len(value[0])

    def removeKey(self, key):
        del self.kept[key]


def arriving(*runs):
    """Rows of a bucket for runs of ``(stream, positions, pieces, ends)``."""
    import numpy as np

    from agentlake.streaming.buckets import packed
    from agentlake.streaming.detokenize import _pack

    packs = [
        packed(([stream], [len(pos)], _pack(np.array(pos), np.array([len(p) for p in pieces]), np.array(ends, np.uint8), b"".join(pieces))))
        for stream, pos, pieces, ends in runs
    ]
    return pd.DataFrame({"pack": packs})


def processor(**options):
    from agentlake.streaming.detokenize import DetokenizeProcessor

    own, state = DetokenizeProcessor("byte_level", False, False, **{"most": 1 << 20} | options), Held()
    own.init(state)
    return own, state


def test_waiting_tokens_are_written_once():
    own, state = processor()
    held, rng, n = {}, random.Random(3), 60
    pieces = [bytes(rng.choices(range(97, 123), k=6)) for _ in range(100 * n + 1)]
    sizes = []
    for i in range(n):
        pos = list(range(1 + 100 * i, 101 + 100 * i))
        before = state.written
        assert not list(own.take(held, arriving(("s", pos, [pieces[p] for p in pos], [0] * 100)), None))
        sizes.append(state.written - before)
    # A batch writes what it brings, whatever waits already, and reads nothing.
    assert max(sizes) < 2 * min(sizes) and state.reads == 0 and len(state.kept) == n
    got = list(own.take(held, arriving(("s", [0], [pieces[0]], [0])), None))
    assert got == [("s", 0, b"".join(pieces).decode())]
    assert not state.kept and held["s"][1] == len(pieces)
    assert list(own.take(held, arriving(("s", [len(pieces)], [b"!"], [1])), None)) == [("s", len(pieces), "!")] and not held


def test_entries_of_waiting_tokens_do_not_pile_up():
    own, state = processor()
    held = {}
    many = [b"x"] * 20
    list(own.take(held, arriving(("a", range(1, 21), many, [0] * 20), ("b", [1, 2], [b"y", b"z"], [0, 1]), (None, [2], [b"w"], [1])), None))
    # Of what a release leaves, less than half is written again, with what is new.
    assert list(own.take(held, arriving(("a", [0], [b"-"], [0]), ("c", [5], [b"v"], [0])), None)) == [("a", 0, "-" + "x" * 20)]
    assert len(state.kept) == 1 and {s: [r[:2] for r in k[5]] for s, k in held.items()} == {"a": [], "b": [(1, 2)], None: [(2, 1)], "c": [(5, 1)]}
    # Ends before its waiting tokens; a position that repeats counts once.
    assert list(own.take(held, arriving(("c", [0, 1], [b"p", b"q"], [0, 1]), ("b", [0, 1], [b"o", b"y"], [0, 0])), None)) == [("c", 0, "pq"), ("b", 0, "oyz")]
    assert set(held) == {"a", None}
    assert list(own.take(held, arriving((None, [0, 1], [b"k", b"l"], [0, 0])), None)) == [(None, 0, "klw")]
    assert not state.kept


@pytest.mark.parametrize("seed", range(5))
def test_waiting_tokens_of_many_streams_in_any_order(seed):
    rng, (own, state), held, got = random.Random(seed), processor(), {}, {}
    texts = {s: [bytes([97 + rng.randrange(26)]) for _ in range(rng.randint(1, 60))] for s in range(12)}
    tokens = [(s, p) for s, t in texts.items() for p in range(len(t))]
    rng.shuffle(tokens)
    while tokens:
        batch, tokens = tokens[:40], tokens[40:]
        runs = [(s, [p], [texts[s][p]], [int(p == len(texts[s]) - 1)]) for s, p in batch]
        for s, at, text in own.take(held, arriving(*runs), None):
            got.setdefault(s, {})[at] = text
    assert {s: "".join(t for _, t in sorted(parts.items())) for s, parts in got.items()} == {s: b"".join(t).decode() for s, t in texts.items()}
    assert not held and not state.kept


def test_tokens_travel_once_for_an_id_and_packed_by_bucket(spark):
    from agentlake.streaming.buckets import unpacked
    from agentlake.streaming.detokenize import _by_bucket, _by_id, _unpack

    rows = [(s, p, p % 3 if p else None, p == 9 or None, (s or 0) % 2) for s in (1, 2, None) for p in reversed(range(10))]
    tokens = spark.createDataFrame(rows, "stream_id bigint, pos bigint, id bigint, is_end boolean, bucket smallint").coalesce(1)
    grouped = tokens.mapInArrow(_by_id, "id bigint, streams array<bigint>, at binary")
    assert sorted((r.id if r.id is not None else -1, len(r.streams)) for r in grouped.collect()) == [(-1, 3), (0, 9), (1, 9), (2, 9)]
    packs = grouped.withColumn("piece", F.encode(F.coalesce(F.col("id").cast("string"), F.lit("")), "UTF-8")).mapInArrow(_by_bucket, "bucket bigint, pack binary")
    got = {}
    for r in packs.collect():
        streams, counts, run = unpacked(r.pack)
        pos, pieces, ends = _unpack(run)
        got[r.bucket] = (sorted(map(str, streams)), counts.tolist(), pos.tolist(), ends.tolist())
        assert len(pieces) == len(pos)
    line, end = list(range(10)), [0] * 9 + [1]
    assert got == {0: (["2", "None"], [10, 10], line * 2, end * 2), 1: (["1"], [10], line, end)}


def test_one_kind_at_a_time_is_in_shuffle_files(spark, sf_dir):
    import time

    from agentlake.plans import all_queries

    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {b for b in blocks.getAllBlocks().mkString(" ").split() if b.startswith("shuffle_")}
    before = shuffled()
    found = all_queries()[0]["detokenize_by_kind"](spark, sf_dir)
    # What is left to do moves whole texts, not tokens; what moved these is gone.
    assert "hashpartitioning(id" not in found._jdf.queryExecution().executedPlan().toString()
    deadline = time.time() + 20
    while shuffled() - before and time.time() < deadline:
        time.sleep(0.2)
    assert not shuffled() - before
    assert {(r.kind, r.n) for r in found.groupBy("kind").agg(F.countDistinct("stream_id").alias("n")).collect()} == {(k, 50) for k in K.KINDS}
