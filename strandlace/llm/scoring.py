"""LM scoring with Brown class-based n-grams.

Every word of ``classed_from`` training tokens or more gets a class:

1. The ``clustered`` most frequent words are clustered by exchange, word by word, on their bigram counts.
2. All words of the exchange table (the ``classed`` most frequent) then move in Spark rounds: a pass counts the classes
   beside each word, each word goes to the class that raises the likelihood most (all words in
   the first round, every other word in later ones), and a round that does not raise the
   likelihood of the whole corpus is taken back and ends the rounds.
3. Every other word, however many there are, takes the class that predicts it best after
   the classes before it; these classes stay in a table in the shared folder.

Text ends and words of fewer tokens (the tail) have a class of their own.  A token's
probability is its class's transition probability (interpolated with the class
frequencies) times its emission by the class.  The transition's context is the class of the
word before if the exchange table has it, and the tail otherwise.  Unseen words share the tail's
Good-Turing mass over as many types as were seen.

Texts are tokenised once; all passes read the stored symbols.  Counts cover all
training tokens: they are summed map-side and then by word.
Words among the ``table`` most frequent are scored from a broadcast table of
that fixed size, all others by a join on the word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, discard, identified, ints, lean, materialize, mix, steps

_U = np.uint64
#: The symbol of a text's end; a word can't hold a space.
END = xxhash.xxh64_intdigest(b" ")
_END = END.to_bytes(8, "little")
_SIGNED_END = int(np.uint64(END).view(np.int64))


#: Bytes of symbols that one step of a pass holds.
SYMBOL_BYTES = 2 << 20


def _tokenise(batches):
    x = xxhash.xxh64_digest
    for b in steps(batches):
        symbols = [b"".join(map(x, t.lower().split())) for t in column(b, "text").to_pylist()]
        # Digests are big-endian; symbols are little-endian integers.
        rows = [np.frombuffer(s, ">u8").astype("<u8").tobytes() + _END for s in symbols]
        yield pa.RecordBatch.from_arrays([column(b, "doc_id"), column(b, "held_out"), pa.array(rows, pa.binary())], names=["doc_id", "held_out", "symbols"])


def _symbols(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Token symbols of all rows, each closed by END, and the rows' offsets."""
    col = column(batch, "symbols")
    offsets = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].copy().view(_U)
    return data, (offsets - offsets[0]) // 8


class Finder:
    """Places of symbols in a sorted table, by hashing: words that collide go to a further, smaller round."""

    def __init__(self, words: np.ndarray) -> None:
        self.words, self.rounds = words, []
        left = np.arange(len(words))
        while len(left):
            shift = _U(64 - max(8, int(16 * len(left)).bit_length()))
            factor = mix(np.array([len(self.rounds)]), 3)[0] | _U(1)
            slot = self._slot(words[left], factor, shift)
            table = np.zeros(1 << int(64 - shift), np.int32)
            table[slot] = left
            self.rounds.append((factor, shift, table))
            left = left[table[slot] != left]

    @staticmethod
    def _slot(h: np.ndarray, factor: np.uint64, shift: np.uint64) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (h * factor) >> shift

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether the table has each symbol, and its place (0 where not)."""
        at, hit = np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        open_ = np.arange(len(h))
        for factor, shift, table in self.rounds:
            place = table[self._slot(h[open_], factor, shift)]
            ok = self.words[place] == h[open_]
            at[open_[ok]] = place[ok]
            hit[open_[ok]] = True
            open_ = open_[~ok]
        return hit, at


def _look_up(finder: Finder, values: np.ndarray, h: np.ndarray, other: int) -> np.ndarray:
    """The value of each symbol, or ``other``."""
    hit, at = finder.find(h)
    return np.where(hit, values[at] if len(values) else other, other)


def _before(c: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The class before each token; END (class 0) comes before each text."""
    before = np.empty_like(c)
    before[1:] = c[:-1]
    before[offsets[:-1]] = 0
    return before


def _parts(total: np.ndarray):
    """``key, n`` of the non-zero counts, in batches."""
    got = np.flatnonzero(total)
    for part in range(0, len(got), 1 << 20):
        p = got[part : part + (1 << 20)]
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(total[p], pa.int64())], names=["key", "n"])


def _tally(batches):
    for b in steps(batches, "symbols", 2 * SYMBOL_BYTES):
        word, n = np.unique(_symbols(b)[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64), pa.int64()), pa.array(n, pa.int64())], names=["word", "n"])


def _bigrams(train: DataFrame, words: np.ndarray, ids: np.ndarray, size: int) -> np.ndarray:
    """``size`` squared counts of ids (0 to size - 1; other words are ``size - 1``) side by side; at most as many rows come to the driver."""

    def run(batches):
        total, finder = np.zeros(size * size, np.int64), Finder(words)
        for b in steps(batches, "symbols", SYMBOL_BYTES):
            h, offsets = _symbols(b)
            i = _look_up(finder, ids, h, size - 1)
            total += np.bincount(_before(i, offsets) * size + i, minlength=size * size)
        yield from _parts(total)

    pairs = train.select("symbols").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size * size, np.int64)
    out[pairs["key"].to_numpy(np.int64)] = pairs["n"].to_numpy(np.int64)
    return out.reshape(size, size)


def exchange_classes(bigrams: np.ndarray, classes: int, sweeps: int = 5) -> np.ndarray:
    """Exchange clustering.

    ``bigrams[a, b]`` counts a before b.  Row 0 (END) and the last row (tail)
    stay in classes 0 and ``classes + 1``; each other word moves to the class of 1
    to ``classes`` that raises the class bigram likelihood most, until a sweep moves none.
    """
    n = len(bigrams)
    k = classes + 2
    own = 1 + np.arange(n) % classes
    own[0], own[-1] = 0, k - 1
    b = bigrams.astype(np.float64)
    onehot = np.zeros((n, k))
    onehot[np.arange(n), own] = 1
    right, left = b @ onehot, b.T @ onehot  # word before class, word after class
    g = onehot.T @ right
    xlogx = lambda x: x * np.log(np.maximum(x, 1e-300))

    for _ in range(sweeps):
        moved = 0
        for w in range(1, n - 1):
            a, self_n = own[w], b[w, w]
            r, c = right[w].copy(), left[w].copy()
            if not r.any() and not c.any():
                continue
            # Take w out of its class; its pairs with itself are kept apart.
            r[a] -= self_n
            c[a] -= self_n
            g[a] -= r
            g[:, a] -= c
            g[a, a] -= self_n
            row, col = g.sum(axis=1) + c, g.sum(axis=0) + r  # neighbours keep their pairs with w wherever it goes
            t_r, t_c = r.sum() + self_n, c.sum() + self_n
            into = np.arange(1, classes + 1)
            gain = (xlogx(g[into] + r) - xlogx(g[into])).sum(axis=1) + (xlogx(g[:, into] + c[:, None]) - xlogx(g[:, into])).sum(axis=0)
            d = g[into, into]
            gain -= xlogx(d + r[into]) + xlogx(d + c[into]) - 2 * xlogx(d)
            gain += xlogx(d + r[into] + c[into] + self_n) - xlogx(d)
            gain -= xlogx(row[into] + t_r) - xlogx(row[into]) + xlogx(col[into] + t_c) - xlogx(col[into])
            to = int(into[np.argmax(gain)])
            if gain[to - 1] <= gain[a - 1] + 1e-9:
                to = a
            g[to] += r
            g[:, to] += c
            g[to, to] += self_n
            if to != a:
                moved += 1
                own[w] = to
                right[:, a] -= b[:, w]
                right[:, to] += b[:, w]
                left[:, a] -= b[w]
                left[:, to] += b[w]
        if not moved:
            break
    return own


def likelihood(joint: np.ndarray) -> float:
    """The class bigram log likelihood, up to a constant of the words' own counts."""
    x = lambda v: float((v * np.log(np.maximum(v, 1e-300))).sum())
    return x(joint) - x(joint.sum(axis=1)) - x(joint.sum(axis=0))


def _contexts(words: np.ndarray, cls: np.ndarray, k: int):
    """Counts of the classes beside each of the sorted ``words``: one row for each word and task, of slots (c for class c before, k + c
    for class c after) and their counts."""
    n = len(words)

    def run(batches):
        total, finder = np.zeros(n * 2 * k, np.int32), Finder(words)
        for b in steps(batches, "symbols", SYMBOL_BYTES):
            h, offsets = _symbols(b)
            hit, at = finder.find(h)
            c = np.where(hit, cls[at], k - 1)
            before = _before(c, offsets)
            word = np.flatnonzero(hit & (h != _U(END)))  # not an END, so the next token is of the same text
            place = at[word] * (2 * k)
            for slots in (place + before[word], place + k + c[word + 1]):
                got, times = np.unique(slots, return_counts=True)
                total[got] += times.astype(np.int32)
        for low in range(0, n, 1 << 13):
            part = total[low * 2 * k : (low + (1 << 13)) * 2 * k].reshape(-1, 2 * k)
            row, slot = np.nonzero(part)
            if len(row):
                entries = np.column_stack((slot, part[row, slot])).astype("<i4")
                cut = np.flatnonzero(np.diff(row)) + 1
                blobs = [e.tobytes() for e in np.split(entries, cut)]
                yield pa.RecordBatch.from_arrays([pa.array(low + row[np.concatenate(([0], cut))], pa.int64()), pa.array(blobs, pa.binary())], names=["word", "slots"])

    return lean(run)


def _summed(batches, size: int, packed: bool):
    """``words, matrix``: the summed counts by slot of whole words; rows come sorted by word."""
    word, held = None, None
    for b in batches:
        if b.num_rows == 0:
            continue
        w = ints(b, "word")
        head = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
        owner = np.cumsum(np.concatenate(([False], w[1:] != w[:-1])))
        out = np.zeros((len(head), size))
        if packed:
            blobs = column(b, "slots").to_pylist()
            entries = np.frombuffer(b"".join(blobs), "<i4").reshape(-1, 2)
            owner = np.repeat(owner, [len(x) // 8 for x in blobs])
            np.add.at(out, (owner, entries[:, 0]), entries[:, 1])
        else:
            np.add.at(out, (owner, ints(b, "slot")), ints(b, "n"))
        words = w[head]
        if held is not None and words[0] == word:
            out[0] += held
        elif held is not None:
            yield np.array([word]), held[None]
        word, held = words[-1], out[-1].copy()
        if len(words) > 1:
            yield words[:-1], out[:-1]
    if held is not None:
        yield np.array([word]), held[None]


def best_classes(own: np.ndarray, left: np.ndarray, right: np.ndarray, joint: np.ndarray) -> np.ndarray:
    """The class (1 and on; the last is the tail) that raises the likelihood most for each word.

    ``own`` are the words' present classes, ``left[w]`` and ``right[w]`` count the classes before and after word w,
    ``joint`` the class bigrams.  Words are judged independently of each other.
    """
    x = lambda v: v * np.log(np.maximum(v, 1e-300))
    row, col = joint.sum(axis=1), joint.sum(axis=0)
    n_left, n_right = left.sum(axis=1), right.sum(axis=1)
    gain = np.full((len(left), len(joint)), -np.inf)
    for a in range(1, len(joint)):
        sign = np.where(own == a, -1.0, 1.0)  # in its own class a word's counts are already there

        def add(now, more, sign=sign):
            s = sign if more.ndim == 1 else sign[:, None]
            return s * (x(np.maximum(now + s * more, 0)) - x(now))

        gain[:, a] = add(joint[a], right).sum(axis=1) + add(joint[:, a], left).sum(axis=1) - add(row[a], n_right) - add(col[a], n_left)
    best = np.argmax(gain, axis=1)
    stay = np.take_along_axis(gain, own[:, None], axis=1)[:, 0]
    return np.where(np.take_along_axis(gain, best[:, None], axis=1)[:, 0] > stay + 1e-9, best, own)


def _move(own: np.ndarray, joint: np.ndarray):
    k = len(joint)

    def run(batches):
        for word, both in _summed(batches, 2 * k, True):
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(best_classes(own[word], both[:, :k], both[:, k:], joint), pa.int64())], names=["word", "class"])

    return lean(run)


def exchange_rounds(train: DataFrame, words: np.ndarray, core: np.ndarray, k: int, rounds: int) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Classes of the sorted ``words``, their class bigrams, and the likelihood after each round, which rises.

    ``core`` are the starting classes; words of the last class start outside all classes.
    """
    now, best, history = core.copy(), None, []
    deal = (mix(words, 5) & _U(1)).astype(np.int64)
    for r in range(rounds + 1):
        joint = _bigrams(train, words, now, k).astype(np.float64)
        value = likelihood(joint)
        if best is not None and value <= history[-1] + 1e-9 * abs(history[-1]):
            break
        best = now.copy(), joint
        history.append(value)
        if r < rounds:
            rows = train.mapInArrow(_contexts(words, now, k), "word long, slots binary").repartition(F.col("word")).sortWithinPartitions("word")
            moved = rows.mapInArrow(_move(now, joint), "word long, class long").toPandas()  # one row a word of the table
            at, to = moved["word"].to_numpy(np.int64), moved["class"].to_numpy(np.int64)
            may = (now[at] == k - 1) if r == 0 else deal[at] == r % 2
            now[at[may]] = to[may]
    return *best, history


def _tail_contexts(words: np.ndarray, cls: np.ndarray, k: int):
    """``word, slot, n``: the classes before each word that the exchange table lacks."""

    def run(batches):
        finder = Finder(words)
        for b in steps(batches, "symbols", 2 * SYMBOL_BYTES):
            h, offsets = _symbols(b)
            c = _look_up(finder, cls, h, k)  # k: not in the table
            at = np.flatnonzero(c == k)
            before = np.minimum(_before(c, offsets)[at], k - 1)
            order = np.lexsort((before, h[at]))
            word, slot = h[at][order], before[order]
            head = np.flatnonzero(np.concatenate((np.ones(min(len(word), 1), bool), (word[1:] != word[:-1]) | (slot[1:] != slot[:-1]))))
            n = np.diff(np.append(head, len(word)))
            yield pa.RecordBatch.from_arrays([pa.array(word[head].view(np.int64)), pa.array(slot[head].astype(np.int32)), pa.array(n.astype(np.int64))], names=["word", "slot", "n"])

    return lean(run)


def _predict(joint: np.ndarray, least: int):
    """The class of each word of ``least`` tokens or more that predicts it best after the classes before it; these classes and their counts."""
    k = len(joint)

    def run(batches):
        for word, left in _summed(batches, k, False):
            enough = left.sum(axis=1) >= least
            word, left = word[enough], left[enough]
            if len(word):
                to = best_classes(np.full(len(left), k - 1), left, np.zeros_like(left), joint)
                row, slot = np.nonzero(left)
                entries = np.column_stack((slot, left[row, slot])).astype("<i8")
                blobs = [e.tobytes() for e in np.split(entries, np.flatnonzero(np.diff(row)) + 1)]
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(to, pa.int64()), pa.array(blobs, pa.binary())], names=["word", "class", "slots"])

    return lean(run)


def _moved(k: int):
    """Class bigrams of the words that got classes: ``key`` is class before times k plus class."""

    def run(batches):
        total = np.zeros(k * k, np.int64)
        for b in batches:
            blobs = column(b, "slots").to_pylist()
            entries = np.frombuffer(b"".join(blobs), "<i8").reshape(-1, 2)
            np.add.at(total, entries[:, 0] * k + np.repeat(ints(b, "class"), [len(x) // 16 for x in blobs]), entries[:, 1])
        yield from _parts(total)

    return lean(run)


def _fitting(sizes: list[tuple[int, int]], room: int) -> int:
    """The lowest of the bins, listed from the highest with their sizes, down to which ``room`` words hold them all."""
    least = 2**40
    for b, n in sizes:
        room -= n
        if room < 0:
            break
        least = b
    return least


@dataclass
class Model:
    """A fitted model.  ``counts`` (word, count) and ``classes`` (word, class: words of ``classed_from`` tokens beyond the exchange table) are stored tables;
    ``words`` to ``context`` are the sorted broadcast table; ``step`` the log10 transitions; ``unseen`` the tail's mass of unseen words."""

    counts: DataFrame
    classes: DataFrame
    words: np.ndarray
    count: np.ndarray
    own: np.ndarray
    context: np.ndarray
    joint: np.ndarray
    step: np.ndarray
    unseen: float
    total: int
    types: int
    history: list[float]

    def emission(self, count, own):
        """log10 probability of a word of the table by its class."""
        mass = np.maximum(self.joint.sum(axis=0), 1.0)
        share = count / mass[own]
        return np.log10(np.where(own == len(self.joint) - 1, share * (1 - self.unseen), share))


def fit(symbols: DataFrame, clustered: int = 1000, classes: int = 40, classed: int = 1 << 16, classed_from: int = 5, table: int = 1 << 18, rounds: int = 3, back_off: float = 5.0) -> Model:
    """The model of the rows of ``symbols`` that are not held out."""
    train = symbols.where(~F.col("held_out")).select("symbols")
    k = classes + 2
    counts = materialize(train.mapInArrow(lean(_tally), "word long, n long").groupBy("word").agg(F.sum("n").alias("count")), "word-counts")
    total, types, single = counts.agg(F.sum("count"), F.count("*"), F.sum(((F.col("count") == 1) & (F.col("word") != _SIGNED_END)).cast("long"))).first()
    total, single = total or 0, single or 0
    # The tables hold the words whose counts lie in the highest bins of 1/64 octave that fit them together.
    octave = F.floor(F.log2("count") * 64)
    sizes = sorted(((b, n) for b, n in counts.groupBy(octave.alias("bin")).agg(F.count("*")).collect()), reverse=True)  # 4,096 rows at most
    least, least_classed = _fitting(sizes, table), _fitting(sizes, classed)
    often = (octave >= least_classed) & (F.col("count") >= classed_from)
    top = counts.where((octave >= least) | often | (F.col("word") == _SIGNED_END)).withColumn("often", often).toPandas().sort_values(["count", "word"], ascending=[False, True])
    word, n, moves = top["word"].to_numpy(np.int64).view(_U), top["count"].to_numpy(np.int64), top["often"].to_numpy(bool) & (top["word"].to_numpy(np.int64) != _SIGNED_END)

    # 1. The core, word by word; id 0 is END, the last id everything else.
    named = np.concatenate((np.array([END], _U), word[moves][:clustered]))
    order = np.argsort(named)
    core = exchange_classes(_bigrams(train, named[order], order.astype(np.int64), len(named) + 1), classes)
    # 2. The exchange table.
    key = np.unique(np.concatenate((word[moves], named)))
    start = np.full(len(key), k - 1, np.int64)
    start[np.searchsorted(key, named)] = core[:-1]
    cls, joint, history = exchange_rounds(train, key, start, k, rounds)
    # 3. All other words of enough tokens.
    slots = train.mapInArrow(_tail_contexts(key, cls, k), "word long, slot int, n long").repartition(F.col("word")).sortWithinPartitions("word")
    rest = materialize(slots.mapInArrow(_predict(joint, classed_from), "word long, class long, slots binary"), "word-classes")
    moved = rest.select("class", "slots").mapInArrow(_moved(k), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas()  # k squared rows at most
    for at, some in zip(moved["key"].to_numpy(np.int64), moved["n"].to_numpy(np.int64), strict=True):
        joint[at // k, at % k] += some
        joint[at // k, k - 1] -= some

    prior = (joint.sum(axis=0) + 1) / (joint.sum() + k)
    step = np.log10((joint + back_off * prior) / (joint.sum(axis=1, keepdims=True) + back_off))
    tail = float(joint[:, -1].sum())
    unseen = min((single + 0.5) / (tail + 1), 0.999) if tail else 1.0
    order = np.argsort(word)
    word, n = word[order], n[order]
    context = _look_up(Finder(key), cls, word, k - 1)
    own = context.copy()
    known = rest.join(counts.where(octave >= least), "word").select("word", "class").toPandas()  # words of the table
    own[np.searchsorted(word, known["word"].to_numpy(np.int64).view(_U))] = known["class"].to_numpy(np.int64)
    return Model(counts, rest.select("word", "class"), word, n, own, context, joint, step, unseen, int(total), int(types), history)


def _score(m: dict):
    def run(batches):
        part, row = TaskContext.get().partitionId() << 40, 0
        words, count, own, context, emit, step = (m[x] for x in ("words", "count", "own", "context", "emit", "step"))
        tail, finder = len(step) - 1, Finder(words)
        for b in steps(batches, "symbols", SYMBOL_BYTES):
            h, offsets = _symbols(b)
            if len(words):
                hit, at = finder.find(h)
                base = np.where(hit, np.log10(count[at] + 1.0), 0.0)
                before = _before(np.where(hit, context[at], tail), offsets)
                score = np.where(hit, step[before, own[at]] + emit[at], 0.0)
            else:
                hit, base, score, before = np.zeros(len(h), bool), np.zeros(len(h)), np.zeros(len(h)), _before(np.full(len(h), tail), offsets)
            add = lambda x: np.add.reduceat(x, offsets[:-1])
            n = len(offsets) - 1
            uid = part + row + np.arange(n)
            row += n
            # Words beyond the table: one row for each document, word and class before.
            doc = np.repeat(np.arange(n), np.diff(offsets))[~hit]
            rare, slot = h[~hit], before[~hit]
            order = np.lexsort((slot, rare, doc))
            doc, rare, slot = doc[order], rare[order], slot[order]
            head = np.ones(len(doc), bool)
            head[1:] = (doc[1:] != doc[:-1]) | (rare[1:] != rare[:-1]) | (slot[1:] != slot[:-1])
            first = np.flatnonzero(head)
            times = np.diff(np.append(first, len(doc)))
            none = [None] * len(first)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate((uid, uid[doc[first]])), pa.int64()),
                    pa.concat_arrays([column(b, "doc_id"), pa.array(none, pa.int64())]),
                    pa.concat_arrays([column(b, "held_out"), pa.array(none, pa.bool_())]),
                    pa.array(np.diff(offsets).tolist() + none, pa.int64()),
                    pa.array(add(hit.astype(np.int64)).tolist() + none, pa.int64()),
                    pa.array(add(base).tolist() + none, pa.float64()),
                    pa.array(add(score).tolist() + none, pa.float64()),
                    pa.array([None] * n + rare[first].view(np.int64).tolist(), pa.int64()),
                    pa.array([None] * n + slot[first].tolist(), pa.int32()),
                    pa.array([None] * n + times.tolist(), pa.int64()),
                ],
                names=["uid", "doc_id", "held_out", "n_tokens", "hits", "base", "score", "word", "slot", "times"],
            )

    return lean(run)


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored symbols of each row: ``doc_id, held_out, symbols``."""
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    rows = identified(docs, id_col, text_col).select("doc_id", "text", held.alias("held_out"))
    return materialize(rows.mapInArrow(lean(_tokenise), "doc_id long, held_out boolean, symbols binary"), "symbols")


def score(symbols: DataFrame, model: Model) -> DataFrame:
    """The rows of ``score_documents`` for stored symbols under a fitted model."""
    k = len(model.joint)
    sent = {"words": model.words, "count": model.count, "own": model.own, "context": model.context, "emit": model.emission(model.count, model.own), "step": model.step}
    schema = "uid long, doc_id long, held_out boolean, n_tokens long, hits long, base double, score double, word long, slot int, times long"
    scored = materialize(symbols.mapInArrow(_score(sent), schema), "scores")
    mass = np.maximum(model.joint.sum(axis=0), 1.0)
    table = lambda x: F.array(*(F.lit(float(v)) for v in x))
    own = F.coalesce("class", F.lit(k - 1)).cast("int")
    step = F.get(table(model.step.ravel()), F.col("slot") * k + own)
    seen = F.log10(F.col("count") * F.when(own == k - 1, F.lit(1 - model.unseen)).otherwise(1.0) / F.get(table(mass), own))
    never = F.lit(float(np.log10(model.unseen / (model.types + 1))))
    rare = scored.where("word is not null").select("uid", "word", "slot", "times").join(model.counts, "word", "left").join(model.classes, "word", "left")
    rare = rare.groupBy("uid").agg(
        F.sum(F.when(F.col("count").isNotNull(), F.col("times")).otherwise(0)).alias("known"),
        F.sum(F.col("times") * F.log10(F.coalesce("count", F.lit(0)) + 1.0)).alias("rare_base"),
        F.sum(F.col("times") * (step + F.when(F.col("count").isNull(), never).otherwise(seen))).alias("rare_score"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = scored.where("word is null").drop("word", "slot", "times").join(rare, "uid", "left")
    n_tokens, total = F.col("n_tokens"), F.col("score") + zero("rare_score")
    base = F.col("base") + zero("rare_base") - n_tokens * F.lit(float(np.log10(model.total + model.types + 1)))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("hits") + zero("known")).cast("long").alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), base.alias("base_score"), total.alias("score"), F.pow(F.lit(10.0), -total / n_tokens).alias("perplexity"))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity`` for each row; ``options`` are those of ``fit``.

    Rows whose crc32 of the id's text leaves 2 by 7 are held out and not learned
    from.  ``base_score`` is the add-one unigram, ``score`` the class model's
    log10 probability of the text and its end; ``perplexity`` is per token.  A
    null or empty text is its end alone; a null id counts as the empty string; repeated rows
    count, and are scored, each by itself; words of equal counts go by their hashes; without training rows only the
    end and unknown words are left, at the prior's probabilities.  A very long text is
    scored whole; an empty table gives no rows; other columns are not read, whatever their names.
    """
    symbols = tokens(docs, id_col, text_col)
    out = score(symbols, fit(symbols, **options))
    discard(symbols)
    return out


def op4(spark, sf_dir: str) -> DataFrame:
    """``score_documents`` over all documents."""
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
