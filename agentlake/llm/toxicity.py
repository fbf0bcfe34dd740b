"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as a learnt vector of its hashed form joined with a character vector, the
maximum per dimension over learnt vectors of its hashed character n-grams (3 to 5, with the
word's borders), so unseen forms of known stems are recognised. Two gated recurrent units
read a window of words in both directions, attention pools their states, and a linear layer
gives the window's logit. A document is scored over all its overlapping windows; the highest
one counts.

Training sees labels of whole documents only: in every pass each document is represented by
its highest window and one drawn at random. Embeddings start from smoothed log odds.
"""

from __future__ import annotations

import warnings
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agentlake.llm.common import give_back, ranges, settle, slices, written
from agentlake.llm.words import Words

#: Words of a window, and between the starts of two: each word but the outer ones is in two windows.
WINDOW, STRIDE = 32, 16
#: Words that training reads of a text, and bytes of such a word. Scores and the threshold read whole texts.
EXCERPT, LETTERS = 1024, 256
WORD_BUCKETS, GRAM_BUCKETS = 1 << 16, 1 << 18
DIM, HIDDEN = 4, 8
GRAMS = (3, 4, 5)
_TRIM = b".,;:!?\"'()[]"
#: Distinct words a task remembers before it starts anew.
TABLE_WORDS = 1 << 17
#: Distinct words hashed in one go.
WORDS_AT_ONCE = 1 << 12
#: Windows scored in one go.
BATCH = 1024
#: Texts whose words and n-grams training counts in one go.
TEXTS_AT_ONCE = 32
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def word_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every word, and the buckets of its n-grams as one array with each word's start in it."""
    joined = b"".join(b"^" + w + b"$" for w in words)
    data = np.frombuffer(joined, np.uint8).astype(np.uint64) + np.uint64(1)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(lengths) - lengths
    left = np.repeat(starts + lengths, lengths) - np.arange(len(data))  # bytes to the word's end
    rolling, found, owner = np.zeros(len(data), np.uint64), [], []
    row = np.repeat(np.arange(len(words)), lengths)
    with np.errstate(over="ignore"):
        for n in range(max(GRAMS)):
            shifted = np.zeros_like(data)
            shifted[: max(0, len(data) - n)] = data[n:]
            rolling = rolling * _MULT + shifted
            # The empty word has its two borders for an n-gram, as every word needs one.
            good = left >= n + 1 if n + 1 in GRAMS else (lengths[row] == 2) & (left == 2) if n == 1 else None
            if good is not None:
                found.append((_mix(rolling[good] + np.uint64(n)) % np.uint64(GRAM_BUCKETS)).astype(np.int64))
                owner.append(row[good])
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(lengths.max(initial=1)), _MULT)]))
        place = np.arange(len(data)) - np.repeat(starts, lengths)
        whole = np.add.reduceat(_mix(data) * power[place], starts) if len(words) else np.zeros(0, np.uint64)
        buckets = (_mix(whole) % np.uint64(WORD_BUCKETS)).astype(np.int64)
    owner, found = np.concatenate(owner), np.concatenate(found)
    order = np.argsort(owner, kind="stable")
    return buckets, found[order], np.searchsorted(owner[order], np.arange(len(words)))


def bare(word: bytes) -> bytes:
    """The lower-case word without punctuation at its ends."""
    return word.decode().lower().encode().strip(_TRIM)


class WordIndex:
    """Rows of the distinct bare words of a run of texts, looked up by the words as written."""

    def __init__(self):
        self.written: dict[bytes, int] = {}
        self.words: dict[bytes, int] = {}

    def add(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Row of every word of ``texts``, one text after another, and the texts' numbers of words."""
        words = Words(texts)
        _, first, number = np.unique(words.hashes, return_index=True, return_inverse=True)
        data, rows = words.data, np.zeros(len(first), np.int64)
        for k, i in enumerate(first):
            w = data[words.starts[i] : words.ends[i]].tobytes()
            row = self.written.get(w)
            if row is None:
                row = self.written[w] = self.words.setdefault(bare(w), len(self.words))
            rows[k] = row
        return rows[number], words.counts


def numbered(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct bare words of ``texts``, the row of every word among them, and the texts' numbers of words.

    Rows follow the hashes of the words as written, so they do not depend on the slices that
    the texts are read in.
    """
    written, known, hashes, counts = [], np.zeros(0, np.uint64), [], []
    for part in slices(iter([pa.RecordBatch.from_arrays([texts], ["text"])])):
        words = Words(part.column("text"))
        found, first = np.unique(words.hashes, return_index=True)
        new = ~np.isin(found, known)
        data = words.data
        written += [data[words.starts[i] : words.ends[i]].tobytes() for i in first[new]]
        known = np.concatenate([known, found[new]])
        hashes.append(words.hashes)
        counts.append(words.counts)
    order, distinct, rows = np.argsort(known), {}, np.zeros(len(known), np.int32)
    for k, i in enumerate(order):
        rows[k] = distinct.setdefault(bare(written[i]), len(distinct))
    del written
    known = known[order]
    flat = np.concatenate([rows[np.searchsorted(known, h)] for h in hashes] or [rows])
    return list(distinct), flat, np.concatenate(counts or [np.zeros(0, np.int64)])


def window_starts(n: int, window: int = WINDOW, stride: int = STRIDE) -> np.ndarray:
    """Starts of overlapping windows that together cover ``n`` words."""
    return np.arange(0, max(1, n - window + stride), stride) if n else np.zeros(0, np.int64)


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Network:
    """Parameters, forward and backward pass."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        normal = lambda *shape, s=0.3: rng.normal(0, s, shape).astype(np.float32)
        self.word, self.gram = normal(WORD_BUCKETS, DIM, s=0.02), normal(GRAM_BUCKETS, DIM, s=0.02)
        x, h = 2 * DIM, HIDDEN
        self.small = {}
        for way in "fb":
            self.small |= {f"W{way}": normal(x, 3 * h), f"U{way}": normal(h, 3 * h), f"b{way}": np.zeros(3 * h, np.float32)}
        self.small |= {"A": normal(2 * h, h), "v": normal(h), "o": normal(2 * h), "c": np.full(1, -1.0, np.float32)}

    # Words
    def looked_up(self, buckets, grams, starts):
        """Input vectors of words, given as ``word_grams`` does."""
        return np.concatenate([self.word[buckets], np.maximum.reduceat(self.gram[grams], starts)], 1)

    def vectors(self, words: list[bytes]) -> np.ndarray:
        """Input vectors of distinct words."""
        x = np.zeros((len(words), 2 * DIM), np.float32)
        for i in range(0, len(words), WORDS_AT_ONCE):
            part = slice(i, i + WORDS_AT_ONCE)
            x[part] = self.looked_up(*word_grams(words[part]))
        return x

    # Windows
    def _unit(self, way: str, inputs, at, live, keep: bool):
        """States of one direction; ``at`` (windows, time) indexes rows of the projected ``inputs``."""
        h_size, steps = HIDDEN, at.shape[1]
        u = self.small[f"U{way}"]
        h = np.zeros((len(at), h_size), np.float32)
        states, tape = np.zeros((steps, len(at), h_size), np.float32), []
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            p, q = inputs[at[:, t]], h @ u
            gates = _sigmoid(p[:, : 2 * h_size] + q[:, : 2 * h_size])
            z, r = gates[:, :h_size], gates[:, h_size:]
            new = np.tanh(p[:, 2 * h_size :] + r * q[:, 2 * h_size :])
            m = live[:, t : t + 1]
            after = h + m * (1 - z) * (new - h)
            if keep:
                tape.append((t, h, z, r, new, q[:, 2 * h_size :]))
            states[t] = h = after
        return states, tape

    def forward(self, x, at, live, keep: bool = False):
        """Logits of windows: ``at`` indexes word vectors ``x``, ``live`` is 0 for padding."""
        s, live = self.small, live.astype(np.float32)
        forth, tape_f = self._unit("f", x @ s["Wf"] + s["bf"], at, live, keep)
        back, tape_b = self._unit("b", x @ s["Wb"] + s["bb"], at, live, keep)
        states = np.concatenate([forth, back], 2)
        keys = np.tanh(states @ s["A"])
        score = np.where(live.T > 0, keys @ s["v"], -1e9)
        attention = np.exp(score - score.max(0))
        attention /= attention.sum(0)
        pooled = (attention[:, :, None] * states).sum(0)
        logit = pooled @ s["o"] + s["c"][0]
        return (logit, (states, keys, attention, pooled, tape_f, tape_b)) if keep else logit

    def backward(self, x, at, live, kept, error):
        """Gradients of the small parameters and of the word vectors, for ``error`` = d loss / d logit."""
        s, h_size, live = self.small, HIDDEN, live.astype(np.float32)
        states, keys, attention, pooled, tape_f, tape_b = kept
        g = {"o": pooled.T @ error, "c": error.sum(keepdims=True)}
        d_pooled = error[:, None] * s["o"]
        d_attention = (states * d_pooled).sum(2)
        d_states = attention[:, :, None] * d_pooled
        d_score = attention * (d_attention - (attention * d_attention).sum(0))
        d_keys = d_score[:, :, None] * s["v"] * (1 - keys * keys)
        g["v"] = (keys * d_score[:, :, None]).sum((0, 1))
        g["A"] = np.einsum("tni,tnj->ij", states, d_keys)
        d_states = d_states + d_keys @ s["A"].T
        d_x = np.zeros_like(x)
        for way, tape, part in (("f", tape_f, slice(0, h_size)), ("b", tape_b, slice(h_size, None))):
            u, w = s[f"U{way}"], s[f"W{way}"]
            d_u, d_inputs = np.zeros_like(u), np.zeros((len(x), 3 * h_size), np.float32)
            d_h = np.zeros((len(at), h_size), np.float32)
            for t, h, z, r, new, q in reversed(tape):
                d_after = d_h + d_states[t][:, part]
                m = live[:, t : t + 1]
                d_new = d_after * m * (1 - z) * (1 - new * new)
                d_z = -d_after * m * (new - h) * z * (1 - z)
                d_r = d_new * q * r * (1 - r)
                d_p = np.concatenate([d_z, d_r, d_new], 1)
                d_q = np.concatenate([d_z, d_r, d_new * r], 1)
                np.add.at(d_inputs, at[:, t], d_p)
                d_u += h.T @ d_q
                d_h = d_after * (1 - m * (1 - z)) + d_q @ u.T
            g |= {f"U{way}": d_u, f"W{way}": x.T @ d_inputs, f"b{way}": d_inputs.sum(0)}
            d_x += d_inputs @ w.T
        return g, d_x

    def score_windows(self, x, at, live) -> np.ndarray:
        out = [np.zeros(0, np.float32)]
        for i in range(0, len(at), BATCH):
            # Word vectors of these windows only, so that projections stay small.
            used, place = np.unique(at[i : i + BATCH], return_inverse=True)
            out.append(self.forward(x[used], place.reshape(-1, at.shape[1]), live[i : i + BATCH]))
        return np.concatenate(out)


def windows_of(counts: np.ndarray, docs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For documents of ``counts`` words that lie one after another: positions and liveness per window, and its document.

    With ``docs`` only the windows of these documents.
    """
    docs = np.arange(len(counts)) if docs is None else docs
    starts = [window_starts(int(counts[d])) for d in docs]
    doc = np.repeat(docs, [len(s) for s in starts])
    first = (np.concatenate(starts) if starts else np.zeros(0)).astype(np.int32)
    before = (np.cumsum(counts) - counts).astype(np.int32)
    place = first[:, None] + np.arange(WINDOW, dtype=np.int32)
    live = place < counts[doc][:, None]
    at = np.where(live, place + before[doc][:, None], before[doc][:, None])
    return at, live, doc


def train(texts: list[str], labels: list[int], passes: int = 6, most: int = 1500, seed: int = 7) -> Network:
    """A network fitted to whole-document labels. With one class only it scores below one half everywhere.

    Embeddings start from all texts, the passes take up to ``most`` of each class. The bias is
    set last (``centred``), over these texts here and over whole texts in ``fit``.
    """
    net, rng = Network(seed), np.random.default_rng(seed)
    distinct, flat, counts = numbered(pa.array(texts, pa.string()))
    y = np.array(labels, np.float32)
    if not len(flat) or y.min() == y.max():
        return net
    _log_odds(net, distinct, flat, counts, y)
    give_back()
    used_docs = np.zeros(len(y), bool)
    for side in (0, 1):
        used_docs[np.flatnonzero((y == side) & (counts > 0))[:most]] = True
    runs = [np.flatnonzero(used_docs)[i : i + TEXTS_AT_ONCE] for i in range(0, int(used_docs.sum()), TEXTS_AT_ONCE)]
    at, live, doc = (np.concatenate(c) for c in zip(*[_windows(flat, counts, run) for run in runs], strict=True))
    groups = [np.flatnonzero(doc == d) for d in np.unique(doc)]
    owner = np.array([doc[g[0]] for g in groups])
    weight = np.where(y > 0, 0.5 / max(1, y[owner].sum()), 0.5 / max(1, (1 - y[owner]).sum())) * len(owner)
    state, step = {}, 0
    for turn in range(passes):
        x = None
        x = net.vectors(distinct)
        # Before anything is learnt, the word with the highest log odds tells which window matters.
        logits = (x[:, 0] + x[:, DIM])[at].max(1, initial=-np.inf, where=live) if turn == 0 else net.score_windows(x, at, live)
        chosen = [g[logits[g].argmax()] for g in groups]
        extra = [rng.choice(g) for g, d in zip(groups, owner, strict=True) if y[d] == 0]
        picked = np.array(chosen + extra)
        # A clean word stays clean however often it is repeated.
        clean = np.array([p for p in picked if y[doc[p]] == 0])
        echo = rng.choice(clean, max(1, len(clean) // 2))
        run = np.where(rng.random((len(echo), WINDOW)) < 0.9, at[echo, rng.integers(0, WINDOW, len(echo))][:, None], at[echo])
        at_all, live_all = np.concatenate([at[picked], run]), live[np.concatenate([picked, echo])]
        doc_all = doc[np.concatenate([picked, echo])]
        picked = rng.permutation(len(doc_all))
        rate = 0.02 if turn < passes * 2 // 3 else 0.005
        size = min(256, max(16, len(picked) // 16))  # few documents still give steps enough
        for i in range(0, len(picked), size):
            rows = picked[i : i + size]
            used, place = np.unique(at_all[rows], return_inverse=True)
            place, here = place.reshape(len(rows), WINDOW), live_all[rows]
            buckets, grams, starts = word_grams([distinct[j] for j in used])
            own = np.concatenate([net.word[buckets], x[used][:, DIM:]], 1)
            logit, kept = net.forward(own, place, here, keep=True)
            truth = y[doc_all[rows]]
            error = ((_sigmoid(logit) - truth) * weight[doc_all[rows]] / len(rows)).astype(np.float32)
            g, d_x = net.backward(own, place, here, kept, error)
            step += 1
            for name, value in g.items():
                _adam(net.small[name], value, state, name, rate, step)
            np.subtract.at(net.word, buckets, 2 * d_x[:, :DIM])
            word_at = np.repeat(np.arange(len(used)), np.diff(np.append(starts, len(grams))))
            for k in range(DIM):  # the maximum's gradient goes to the n-gram that gave it
                hit = net.gram[grams, k] == own[word_at, DIM + k]
                np.subtract.at(net.gram[:, k], grams[hit], 2 * d_x[word_at[hit], DIM + k])
            x[used] = net.looked_up(buckets, grams, starts)
    at = live = doc = x = None
    top, x = np.full(len(y), -np.inf), net.vectors(distinct)
    for i in range(0, len(y), TEXTS_AT_ONCE):
        at, live, doc = _windows(flat, counts, np.arange(i, min(i + TEXTS_AT_ONCE, len(y))))
        np.maximum.at(top, doc, net.score_windows(x, at, live))
    return centred(net, top[counts > 0], y[counts > 0])


def _windows(flat: np.ndarray, counts: np.ndarray, docs: np.ndarray):
    """Words, liveness and documents of the windows of ``docs``."""
    at, live, doc = windows_of(counts, docs)
    return flat[at], live, doc


def centred(net: Network, logits: np.ndarray, y: np.ndarray) -> Network:
    """Sets the bias so that one half lies midway between the highest clean and the lowest toxic documents, but for few."""
    clean, toxic = logits[y == 0], logits[y > 0]
    if len(clean) and len(toxic):
        net.small["c"] -= np.float32((np.quantile(clean, 0.998) + np.quantile(toxic, 0.01)) / 2)
    return net


def _log_odds(net: Network, distinct, flat, counts, y) -> None:
    """Starts the first dimension of both embeddings from log odds over the documents that hold a bucket."""
    ends = np.cumsum(counts)
    totals = [np.zeros((2, size)) for size in (WORD_BUCKETS, GRAM_BUCKETS)]
    for i in range(0, len(counts), TEXTS_AT_ONCE):
        own = counts[i : i + TEXTS_AT_ONCE]
        words = flat[ends[i] - counts[i] : ends[i + len(own) - 1]]
        used, words = np.unique(words, return_inverse=True)
        if not len(used):
            continue
        buckets, grams, starts = word_grams([distinct[j] for j in used])
        lengths = np.diff(np.append(starts, len(grams)))
        pairs = _distinct(np.repeat(np.arange(len(own)), own) * len(used) + words)
        d, w = pairs // len(used), pairs % len(used)
        gram_doc, gram = np.repeat(d, lengths[w]), grams[ranges(starts[w], lengths[w])]
        for total, size, doc, key in ((totals[0], WORD_BUCKETS, d, buckets[w]), (totals[1], GRAM_BUCKETS, gram_doc, gram)):
            once = _distinct(doc * size + key)
            toxic = y[i + once // size]
            total[1] += np.bincount(once % size, toxic, size)
            total[0] += np.bincount(once % size, 1 - toxic, size)
    for embedding, (good, bad) in zip((net.word, net.gram), totals, strict=True):
        odds = np.log((bad + 0.3) / (y.sum() + 0.6)) - np.log((good + 0.3) / ((1 - y).sum() + 0.6))
        # Less 1.5 standard errors: buckets of few documents say nothing.
        sure = np.maximum(np.abs(odds) - 1.5 * np.sqrt(1 / (bad + 0.3) + 1 / (good + 0.3)), 0)
        embedding[:, 0] = np.sign(odds) * sure / 2


def _distinct(values: np.ndarray) -> np.ndarray:
    values.sort()
    return values[np.concatenate([[True], values[1:] != values[:-1]])]


def _adam(parameter, gradient, state, name, rate, step):
    m, v = state.setdefault(name, [np.zeros_like(parameter), np.zeros_like(parameter)])
    m += 0.1 * (gradient - m)
    v += 0.01 * (gradient * gradient - v)
    parameter -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)


def held_out(key: str = "doc_id"):
    """Rows that labels are never learnt from: crc32 of the key as text, modulo 5, is 0."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def excerpt(text: str) -> str:
    """The text itself up to ``EXCERPT`` words, else as many of its windows, chosen by hash, in their order."""
    words = [w for w in text.encode().split() if len(w) <= LETTERS]
    if len(words) > EXCERPT:
        starts = range(0, len(words), WINDOW)
        chosen = sorted(starts, key=lambda i: (zlib.crc32(b" ".join(words[i : i + WINDOW])), i))[: EXCERPT // WINDOW]
        words = [w for i in sorted(chosen) for w in words[i : i + WINDOW]]
    return b" ".join(words).decode()


@F.pandas_udf(T.StringType())
def excerpts(texts: pd.Series) -> pd.Series:
    return texts.map(excerpt).astype(object)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", key: str = "doc_id", sample: int = 2000) -> Network:
    """A network learnt on a bounded sample of labelled rows that are not held out.

    ``sample`` rows of each class at most, those with the smallest hashes of their keys, with
    texts of any length: keys are chosen first, and only the chosen rows' texts are fetched.
    The driver trains on excerpts of at most ``EXCERPT`` words. The threshold is set on the
    scores of the same rows' whole texts, which Spark computes. Rows with a null key, label
    or text are not used; a key labelled both ways counts as toxic, and of rows that repeat
    a key the one with the smallest text is used. Without usable texts of both classes
    nothing can be learnt: a warning is given, and every text scores below one half.
    """
    usable = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key))
    once = usable.groupBy(F.col(key).alias("key")).agg((F.max(label) > 0).cast("int").alias("y"))
    given = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    there = once.join(given.select("key").distinct(), "key")
    order = F.xxhash64("key")
    few = written(there.where("y = 1").orderBy(order, "key").limit(sample).unionAll(there.where("y = 0").orderBy(order, "key").limit(sample)), "sample")
    # At most two samples of keys, whatever the tables' sizes.
    rows = written(given.join(F.broadcast(few), "key").groupBy("key").agg(F.min("text").alias("text"), F.first("y").alias("y")), "sample-texts")
    got = rows.select("key", "y", excerpts("text").alias("text")).orderBy(order, "key").collect()
    if len({r.y for r in got}) < 2:
        warnings.warn("no labelled texts of both classes: toxicity cannot be learnt", stacklevel=2)
    net = train([r.text for r in got], [r.y for r in got])
    del got
    settle(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    scored = score(rows.where("length(trim(text)) > 0"), shared, column="logit", logits=True).select("y", "logit").where("logit IS NOT NULL").collect()
    shared.destroy()
    return centred(net, np.array([r.logit for r in scored]), np.array([r.y for r in scored]))


def score(docs: DataFrame, network: Network | Broadcast, text: str = "text", column: str = "score", logits: bool = False) -> DataFrame:
    """``docs`` with ``column``, the toxicity of the whole text (0 to 1; with ``logits`` before the sigmoid).

    Null, empty and blank texts have no windows and score 0 (no logit). An existing column of
    that name is replaced; other columns are kept, whatever their names. A network that is
    broadcast already is used as it is.
    """
    if text != column:
        docs = docs.drop(column)
    given = docs.select(F.col(text).alias("text"), F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    # Of fixed size: two hashed tables.
    net = network if isinstance(network, Broadcast) else docs.sparkSession.sparkContext.broadcast(network)
    schema = T.StructType([given.schema["row"], T.StructField("score", T.DoubleType())])

    def run(batches):
        model = net.value
        index, x = WordIndex(), np.zeros((0, 2 * DIM), np.float32)
        for part in slices(batches, "text"):
            if len(index.written) > TABLE_WORDS:
                index, x = WordIndex(), x[:0]
            flat, counts = index.add(part.column("text"))
            if len(index.words) > len(x):
                x = np.concatenate([x, model.vectors(list(index.words)[len(x) :])])
            scores = np.full(len(counts), -np.inf)
            at, live, doc = windows_of(counts)
            if len(at):
                np.maximum.at(scores, doc, model.score_windows(x, flat[at], live).astype(np.float64))
            out = pa.array(scores, pa.float64(), mask=counts == 0) if logits else pa.array(np.where(counts > 0, _sigmoid(np.clip(scores, -60, 60)), 0.0))
            yield pa.RecordBatch.from_arrays([part.column("row"), out], ["row", "score"])

    out = given.mapInArrow(run, schema)
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c != column], F.col("score").alias(column))
