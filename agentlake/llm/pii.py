"""Personal data in texts: fixed patterns, extended by a skip-chain conditional random field.

The patterns give the base spans. The field labels the words that hold a digit or an at
sign, or are alike one under a base span of their document. Neighbouring words share a
transition potential (the chain); words of one document that repeat, or are alike after
punctuation is taken off, share a potential for equal labels (the skips). Words that are
alike some under base spans share it with all of these through one hub, however many stand
between. Labels follow from loopy sum-product message passing over the graphs of a whole
slice of documents at once, until messages no longer change, with the words under base
spans held at their labels. So an address that is written out once is also found where it
is only half written, before or later on.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentlake.llm.common import slices, whole_row, written

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
# The patterns of the base spans.
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_NODE = re.compile(r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_EDGE = "()[]{}<>\"'.,;:!?*#$%&=|"
FEATURES = 1 << 12


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        n = n * 2 if i % 2 else n
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str):
    """Matches of the address pattern, tried only where an at sign can end a local part.

    The pattern's first part is one run of address characters up to an at sign, so a match
    starts at the run's beginning, or where the previous match ended.
    """
    pattern, done, at = PATTERNS["email"], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text[start - 1]):
            start -= 1
        m = pattern.match(text, start) if start < at else None
        if m:
            yield m.start(), m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` in code points, by kind and then start."""
    found = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    if not any(d in text for d in "0123456789"):
        return found
    for m in PATTERNS["ip"].finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split(".")):
            found.append(("ip", m.start(), m.end()))
    for kind, least, most in (("card", 16, 19), ("phone", 8, 15)):
        if kind == "phone" and "+" not in text:
            continue
        for m in PATTERNS[kind].finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            if least <= len(digits) <= most and (kind == "phone" or luhn(digits)):
                found.append((kind, m.start(), m.end()))
    return found


def _shape(word: str) -> str:
    """Letters as a, runs of digits with their length up to 7, other characters as they are."""
    return re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", lambda m: f"9{min(7, len(m.group()))}", word.strip(_EDGE)))[:24]


def _hash(text: str) -> int:
    return zlib.crc32(text.encode()) % FEATURES


class Graph:
    """Words with a digit or an at sign, or alike a base span's, in a run of texts.

    Features, chain and skip edges, labels of base spans, and ``hub``: which labels the base
    words have that share a key with a word. ``free``: the skips by other keys only.
    """

    def __init__(self, texts: list[str]):
        self.base: list[list[tuple[str, int, int]]] = []
        doc, where, label, words, chain, skip, given, features, hub = [], [], [], [], [], [], [], [], []
        for d, text in enumerate(texts):
            spans = base_spans(text)
            self.base.append(spans)
            if "@" not in text and not any(c in text for c in "0123456789"):
                continue
            ordered = sorted(spans, key=lambda s: (s[1], s[2]))
            last: dict[str, int] = {}
            before, at = None, 0
            nodes, known = [], {}
            for m in _NODE.finditer(text):
                while at < len(ordered) and ordered[at][2] <= m.start():
                    at += 1
                over = [s for s in ordered[at : at + 4] if s[1] < m.end() and s[2] > m.start()]
                kind = LABELS.index(over[0][0]) if over else 0
                nodes.append((m.start(), m.end(), kind))
                if kind:
                    for key in _keys(m.group()):
                        known.setdefault(key, set()).add(kind)
            nodes = sorted(nodes + _alike(text, known))
            for start, end, kind in nodes:
                node, word = len(words), text[start:end]
                doc.append(d)
                where.append((start, end))
                words.append(word)
                label.append(kind)
                shape = _shape(word)
                near = text[max(0, start - 24) : start].split()
                features.append([_hash("s" + shape), _hash("k" + re.sub(r"\d", "", shape)), _hash("p" + (near[-1].lower() if near else "^")), _hash("n" + str(sum(c.isdigit() for c in word)))])
                if before is not None and start - where[before][1] == 1:
                    chain.append((before, node))
                before = node
                kinds = set()
                for key in _keys(word):
                    kinds |= known.get(key, set())
                    if key in last:
                        skip.append((last[key], node))
                        if key in known:
                            given.append((last[key], node))
                    last[key] = node
                hub.append([k in kinds for k in range(len(LABELS))])
        self.doc, self.where, self.words = doc, where, words
        self.label = np.array(label, np.int64)
        self.features = np.array(features, np.int64).reshape(-1, 4)
        self.chain = np.array(chain, np.int64).reshape(-1, 2)
        self.skip = np.array(sorted(set(skip)), np.int64).reshape(-1, 2)
        self.free = np.array(sorted(set(skip) - set(given)), np.int64).reshape(-1, 2)
        self.hub = np.array(hub, bool).reshape(-1, len(LABELS))


def _alike(text: str, known: dict[str, set[int]]) -> list[tuple[int, int, int]]:
    """Words without a digit or an at sign that share a key with a base span's word."""
    bare = [k[1:] for k in known if k[0] == "w" and not _NODE.search(k[1:])]
    lower = text.lower()
    if not any(lower.count(k) > 1 for k in bare):
        return []
    return [(m.start(), m.end(), 0) for m in _WORD.finditer(text) if not _NODE.search(m.group()) and not known.keys().isdisjoint(_keys(m.group()))]


def _keys(word: str) -> set[str]:
    """What two alike words share: the bare word, its digits if there are six or more, an address's local part."""
    bare = word.strip(_EDGE).lower()
    digits = re.sub("[^0-9]", "", word)
    keys = {"w" + bare} if len(bare) >= 5 else set()
    if len(digits) >= 6:
        keys.add("d" + digits)
    local = bare.partition("@")[0]
    if len(local) >= 5:
        keys.add("w" + local)
    return keys


class Field:
    """Weights: words' features by label, transitions along the chain, and for equal labels over skips."""

    def __init__(self, unary, transition, equal: float):
        self.unary, self.transition, self.equal = unary, transition, equal

    @classmethod
    def fit(cls, graph: Graph, steps: int = 200, rate: float = 1.0, decay: float = 1e-4) -> Field:
        """Maximises the pseudo-likelihood of the base labels, each given its neighbours' ones."""
        n, k = len(graph.label), len(LABELS)
        unary, transition, equal = np.zeros((FEATURES, k)), np.zeros((k, k)), 5.0
        if not n:
            return cls(unary, transition, equal)
        truth = np.eye(k)[graph.label]
        weight = np.where(graph.label > 0, max(1.0, (graph.label == 0).sum() / max(1, (graph.label > 0).sum()) / 4), 1.0)[:, None]
        a, b = graph.chain.T
        c, d = graph.skip.T
        same = np.zeros((n, k))
        np.add.at(same, c, truth[d])
        np.add.at(same, d, truth[c])
        # Repeats of labelled words that no pattern found are what the field is to decide.
        weight = np.where((graph.label == 0) & (graph.hub.any(1) | (same[:, 1:].sum(1) > 0)), 0.0, weight[:, 0])[:, None]
        for _ in range(steps):
            score = unary[graph.features].sum(1) + equal * same
            np.add.at(score, b, transition[graph.label[a]])
            np.add.at(score, a, transition.T[graph.label[b]])
            p = np.exp(score - score.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            error = (truth - p) * weight / max(1.0, weight.sum())
            grad = np.zeros_like(unary)
            np.add.at(grad, graph.features.ravel(), np.repeat(error, graph.features.shape[1], 0))
            unary += 20 * rate * (grad - decay * unary)
            step = np.zeros_like(transition)
            np.add.at(step, graph.label[a], error[b])
            np.add.at(step.T, graph.label[b], error[a])
            transition += rate * (step - decay * transition)
            equal = float(np.clip(equal + rate * (error * same).sum(), 4.0, 8.0))
        return cls(unary, transition, equal)

    def marginals(self, graph: Graph, damping: float = 0.3, tolerance: float = 1e-3) -> np.ndarray:
        """Label probabilities by loopy message passing; words under base spans keep their label.

        A hub is held at the labels of its base words, so its message is the same from the
        start. The others pass until they change by less than ``tolerance``. After as many
        rounds as evidence needs through the longest document they are damped more and more,
        so that ones that turn in circles end too.
        """
        n, k = len(graph.label), len(LABELS)
        if not n:
            return np.zeros((0, k))
        own = self.unary[graph.features].sum(1) + self.equal * graph.hub
        own -= own.max(1, keepdims=True)
        held = graph.label > 0
        own[held] = np.where(np.eye(k)[graph.label[held]] > 0, 0.0, -30.0)
        # What words share with base spans' words reaches them from the hub.
        rest = graph.free
        # Every edge in both directions; the first half's reverses are the second half.
        source = np.concatenate([graph.chain[:, 0], rest[:, 0], graph.chain[:, 1], rest[:, 1]])
        target = np.concatenate([graph.chain[:, 1], rest[:, 1], graph.chain[:, 0], rest[:, 0]])
        e, m = len(source) // 2, len(graph.chain)
        back = np.concatenate([np.arange(e, 2 * e), np.arange(e)])
        potentials = np.stack([self.transition, self.transition.T, np.eye(k) * self.equal])
        which = np.repeat([0, 2, 1, 2], [m, e - m, m, e - m])
        messages, belief = np.zeros((2 * e, k)), own.copy()
        longest = int(np.bincount(graph.doc).max())
        active, done, share = np.arange(2 * e), 0, 1 - damping
        while len(active):
            new = np.empty((len(active), k))
            for low in range(0, len(active), 1 << 14):
                some = active[low : low + (1 << 14)]
                joint = (belief[source[some]] - messages[back[some]])[:, :, None] + potentials[which[some]]
                top = joint.max(1, keepdims=True)
                new[low : low + len(some)] = np.log(np.exp(joint - top).sum(1)) + top[:, 0]
            new -= new.max(1, keepdims=True)
            change = share * (new - messages[active])
            messages[active] += change
            np.add.at(belief, target[active], change)
            # What changed goes on from its target, and what has not settled is asked again.
            moved = np.abs(change).max(1) >= tolerance
            touched = np.zeros(n, bool)
            touched[target[active[moved]]] = True
            again = touched[source]
            again[active[moved]] = True
            active = np.flatnonzero(again)
            done += 1
            if done > 100 + 2 * longest:
                share *= 0.9
        p = np.exp(belief - belief.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def spans(self, texts: list[str], sure: float = 0.8) -> list[list[tuple[str, int, int, bool]]]:
        """``(kind, start, end, is base)`` for every text, by kind and then start."""
        graph = Graph(texts)
        p = self.marginals(graph)
        found = [[(*s, True) for s in spans] for spans in graph.base]
        best = p.argmax(1)
        last = None
        for i in np.flatnonzero((graph.label == 0) & (best > 0) & (p.max(1, initial=0) >= sure)):
            d, (start, end), word = graph.doc[i], graph.where[i], graph.words[i]
            start += len(word) - len(word.lstrip(_EDGE))
            end -= len(word) - len(word.rstrip(_EDGE))
            if start >= end:
                continue
            kind = LABELS[best[i]]
            if last and last == (d, kind, i - 1) and graph.where[i][0] - graph.where[i - 1][1] == 1:
                found[d][-1] = (kind, found[d][-1][1], end, False)
            else:
                found[d].append((kind, start, end, False))
            last = (d, kind, i)
        return [sorted(f, key=lambda s: (KINDS.index(s[0]), s[1], s[2])) for f in found]


def fit_field(docs: DataFrame, text: str = "text", key: str = "doc_id", sample: int = 2000, longest: int = 4000) -> Field:
    """A field learnt from the base spans of at most ``sample`` passages of up to ``longest`` characters.

    Of the texts of any length with a digit or an at sign, those with the smallest hashes of
    their keys. A longer text gives the passage that a hash of its key begins. The keys are
    chosen first, so that the driver gets no more texts than are learnt from.
    """
    usable = docs.where(F.col(text).rlike("[0-9@]"))
    # Rows that repeat a key are told apart by their texts.
    own = [F.xxhash64(F.col(key)).alias("h"), F.xxhash64(F.col(key), F.col(text)).alias("t")]
    chosen = written(usable.select(*own).orderBy("h", "t").limit(sample).distinct(), "sample")
    start = F.pmod(F.xxhash64(F.col(key), F.lit(1)), F.greatest(F.length(text) - longest, F.lit(0)) + 1) + 1
    passages = usable.select(*own, F.substring(F.col(text), start.cast("int"), F.lit(longest)).alias("passage"))
    rows = passages.join(F.broadcast(chosen), ["h", "t"], "left_semi").dropDuplicates(["h", "t"])  # at most sample rows
    return Field.fit(Graph([r.passage for r in rows.orderBy("h", "t").collect()]))


SPANS = "array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def find_personal_data(docs: DataFrame, field: Field, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, spans`` for every row.

    Spans are by kind and start, in code points, ends exclusive; ``base`` tells those of the
    patterns. A null text has no spans.
    """

    def run(batches):
        for part in slices(batches, "text"):
            found = field.spans(part.column("text").to_pylist())
            rows = [[{"kind": k, "start": s, "end": e, "base": b} for k, s, e, b in row] for row in found]
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(rows, _SPANS)], ["key", "spans"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, spans {SPANS}")
    return out.withColumnRenamed("key", key)


def masked(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """``docs`` with ``[KIND]`` in place of every span of ``text``. Null texts stay null.

    Where spans overlap, the one that starts first stands for all, of these the longest.
    Other columns are kept, whatever their names.
    """
    others = [c for c in docs.columns if c != text]
    given = docs.select(F.col(text).alias("text"), F.col(text).isNotNull().alias("given"), whole_row(others).alias("row"))

    def run(batches):
        for part in slices(batches, "text"):
            texts = part.column("text").to_pylist()
            clean = [mask(t, spans) for t, spans in zip(texts, field.spans(texts), strict=True)]
            yield part.set_column(part.schema.get_field_index("text"), "text", pa.array(clean, pa.string()))

    out = given.mapInArrow(run, given.schema)
    clean = F.when(F.col("given"), F.col("text"))
    return out.select(*[(clean if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns])


def mask(text: str, spans) -> str:
    out, done = [], 0
    for kind, start, end, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
            done = end
        elif end > done:
            done = end
    return "".join([*out, text[done:]])
