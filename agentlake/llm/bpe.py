"""Byte-pair encoding and decoding over tables of distinct words.

A text is split into words at ASCII white space, which no token of the supported tokenizers
crosses. Each task keeps a table of the distinct words it has met: a word is encoded once, and
its ids are joined to every position where the word stands, as a gather over whole batches.
Decoding joins ids to pieces the same way, in the same pass. Both are maps over the rows, so
there is no shuffle, and a lost task is simply run again. A task's table is emptied at
``TABLE_WORDS`` words or ``TABLE_BYTES`` bytes, which bounds its memory on any input.

One table for the whole corpus, joined back through shuffles, gives the same ids but moves
more than the texts themselves: see the README for its figures.

The tokenizer file is opened where it is installed on each executor.
"""

from __future__ import annotations

import hashlib
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agentlake.llm.common import bound_batches, list_array, ranges, slices
from agentlake.llm.words import Words

TABLE_WORDS, TABLE_BYTES = 1 << 17, 8 << 20
#: Words encoded in one go.
WORDS_AT_ONCE = 4096
#: Token ids turned into text in one go.
IDS_AT_ONCE = 1 << 20
_TAIL = ".,;:"

@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def check_words(path: str) -> None:
    """Fails for a tokenizer whose tokens cross ASCII white space, or depend on what stands beyond it."""
    tokenizer = load_tokenizer(path)
    for parts in (["ab", "cd."], ["It's", "12", "é,"], ["a", "<|endoftext|>", "B"], ["'", "s", "!!"]):
        alone = [i for p in parts for i in tokenizer.encode(p, add_special_tokens=False).ids]
        for gap in (" ", "\n", " \t "):
            if tokenizer.encode(gap + gap.join(parts) + gap, add_special_tokens=False).ids != alone:
                raise ValueError(f"{path}: tokens depend on white space, so words cannot be encoded by themselves")


@lru_cache(maxsize=4)
def splits_tail(path: str) -> bool:
    """Whether the tokenizer lower-cases and parts letters from the punctuation behind them, so that both can be encoded alone."""
    tokenizer = load_tokenizer(path)

    def ids(text):
        return tokenizer.encode(text, add_special_tokens=False).ids

    return all(ids(body.upper() + tail) == ids(body) + ids(tail) for body in ("ab", "x", "it's", "a1b") for tail in (".", ",;", "..:"))


class WordTable:
    """Ids of the distinct words met so far."""

    def __init__(self, path: str):
        self.tokenizer, self.halves = load_tokenizer(path), splits_tail(path)
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.parts: dict[str, list[int]] = {}
        self.size = 0
        self.starts, self.lengths, self.flat = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))

    def rows(self, words: list[bytes]) -> np.ndarray:
        """Row of each of the distinct ``words``; those not met before are encoded."""
        new = [w for w in words if w not in self.index]
        if len(self.index) + len(new) > TABLE_WORDS or self.size + sum(map(len, new)) > TABLE_BYTES:
            self.clear()
            new = words
        if new:
            self._add(new)
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def _add(self, new: list[bytes]) -> None:
        split = [self._split(w.decode()) for w in new]
        missing = list(dict.fromkeys(p for parts in split for p in parts if p not in self.parts))
        for at in range(0, len(missing), WORDS_AT_ONCE):
            some = missing[at : at + WORDS_AT_ONCE]
            for part, encoded in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.parts[part] = encoded.ids
        ids = [[i for p in parts for i in self.parts[p]] for parts in split]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for row in ids for i in row), np.int32, int(lengths.sum()))
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
        self.size += sum(map(len, new))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, flat])

    def _split(self, word: str) -> tuple[str, ...]:
        """An ASCII word as its lower-case body and the punctuation behind it, where the tokenizer parts them."""
        if not self.halves or not word.isascii() or "<" in word:  # other letters, and what may be a special token
            return (word,)
        lower = word.lower()
        body = lower.rstrip(_TAIL)
        return (body, lower[len(body) :]) if body and len(body) < len(lower) and body[-1].isalpha() else (lower,)


def _struct(names: list[str]):
    return F.struct(*[F.col(n) for n in names]) if names else F.struct(F.lit(None).cast("int").alias("none"))


def _pieces(tokenizer: str) -> pa.Array:
    """The piece of every id, and a null behind them."""
    tok = load_tokenizer(tokenizer)
    return pa.array([*map(tok.id_to_token, range(tok.get_vocab_size(with_added_tokens=True))), None], pa.string())


def _joined(pieces: pa.Array, ids: pa.Array):
    """Texts of a list column of ids, a part of the rows at a time: ids joined to their pieces by position."""
    size = len(pieces) - 1
    flat = ids.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))
    known = (flat >= 0) & (flat < size)
    if not known.all():
        ends, flat = np.concatenate([[0], np.cumsum(known)])[ends], flat[known]
    done = 0
    while done < len(ends):
        first = 0 if done == 0 else int(ends[done - 1])
        stop = max(done + 1, int(np.searchsorted(ends, first + IDS_AT_ONCE, side="right")))
        own = pieces.take(pa.array(flat[first : int(ends[stop - 1])].astype(np.int64)))
        yield pc.binary_join(list_array(own, ends[done:stop] - first, pa.string()), " ")
        done = stop


def _digests(texts) -> pa.Array:
    return pa.array([hashlib.sha256(t.as_buffer()).hexdigest() for part in texts for t in part], pa.string())


def encode(docs: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", decoded_sha256: str | None = None) -> DataFrame:
    """``docs`` without its text, with ``ids``, the token ids of the whole text (array<int>).

    ``tokenizer`` is the path of a file whose tokens do not cross white space, which is
    checked. Ids equal those of the tokenizers library without added special tokens. A null
    or blank text has no ids. With ``decoded_sha256``, a column of that name has the SHA-256
    of the text that ``decode`` gives for the ids, without the text leaving the task.
    Columns that already have these names are replaced; other columns are kept, whatever
    their names.
    """
    check_words(tokenizer)
    bound_batches(docs.sparkSession)
    new = [ids] + ([decoded_sha256] if decoded_sha256 else [])
    docs = docs.drop(*[n for n in new if n != text])
    others = [c for c in docs.columns if c != text]
    given = docs.select(F.col(text).alias("text"), _struct(others).alias("row"))
    fields = [given.schema["row"], T.StructField("ids", T.ArrayType(T.IntegerType()))]
    fields += [T.StructField("decoded", T.StringType())] if decoded_sha256 else []

    def run(batches):
        table = WordTable(tokenizer)
        pieces = _pieces(tokenizer) if decoded_sha256 else None
        for part in slices(batches, "text"):
            words = Words(part.column("text"))
            _, first, number = np.unique(words.hashes, return_index=True, return_inverse=True)
            data = words.data
            rows = table.rows([data[words.starts[i] : words.ends[i]].tobytes() for i in first])[number]
            lengths = table.lengths[rows]
            ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(words.counts)]
            coded = list_array(table.flat[ranges(table.starts[rows], lengths)], ends, pa.int32())
            out = [part.column("row"), coded] + ([_digests(_joined(pieces, coded))] if decoded_sha256 else [])
            yield pa.RecordBatch.from_arrays(out, [f.name for f in fields])

    whole = given.mapInArrow(run, T.StructType(fields))
    columns = [F.col("row").getField(c).alias(c) for c in others]
    return whole.select(*columns, F.col("ids").alias(ids), *([F.col("decoded").alias(decoded_sha256)] if decoded_sha256 else []))


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with ``text``, the pieces of ``ids`` joined by spaces, special tokens kept.

    Equals the library's ``decode`` for a tokenizer without a decoder. Unknown ids have no
    piece and leave nothing; null ids give an empty text. An existing column ``text`` is
    replaced; other columns are kept, whatever their names.
    """
    df = df.drop(text)
    given = df.select(F.col(ids).alias("ids"), _struct(df.columns).alias("row"))

    def run(batches):
        pieces = _pieces(tokenizer)
        for batch in batches:
            done = 0
            for texts in _joined(pieces, batch.column("ids")):
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(done, len(texts)), texts], ["row", "text"])
                done += len(texts)

    out = given.mapInArrow(run, T.StructType([T.StructField("row", given.schema["row"].dataType), T.StructField("text", T.StringType())]))
    return out.select(*[F.col("row").getField(c).alias(c) for c in df.columns], F.col("text").alias(text))
