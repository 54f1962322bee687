"""Toxicity by noisy-channel deobfuscation.

Toxic words hide behind leetspeak, separators, spacing and repetition. Every noisy token gives a
lattice: at each character the letters that it may stand for, a mark that may be dropped, a repetition
that may collapse. Neighbouring tokens whose border the model would rather drop, and neighbouring single
characters, make a run with one lattice, in which spaces may be dropped or put in. A character trigram model, counted over all documents, weighs the paths, and Viterbi
decoding restores the likeliest one. Restored words of the whole text are scored by a sparse logistic
model, fitted on at most TRAINING labelled documents (only those whose crc32 of doc_id mod 4 isn't 2).

Lang, source and doc_id are never inputs of a score. Only letters a to z are restored and weighed;
others stay as they are. Defined results: null and empty texts get the model's score of no words;
repeated rows get equal scores; without labels of both kinds every score is that of the bias (6e-6, or
1 less that); an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.session import ship

from .common import Rows, descend, labelled_texts, over_texts, sigmoid, table

#: Most labelled documents that the fit collects.
TRAINING = 12_000
THRESHOLD = 0.3
#: Standard errors from which a feature counts as telling, and its least log odds ratio: words of the
#: language that most toxic texts are in, or of long texts, lift the odds a little.
TELLING, LIFT = 3.0, 1.0
#: Telling features whose weight is below this share of the largest are dropped, and the rest fitted again.
LEAST = 0.1
#: Lengths of the beginnings of words that count as features.
STEMS = (4, 5, 6)
REMEMBERED = 300_000

#: Letters that a character may stand for (fixed values of leetspeak).
LEET = {
    "4": "a", "@": "a", "8": "b", "(": "c", "3": "e", "6": "g", "9": "g", "#": "h", "1": "il", "!": "i", "|": "il",
    "0": "o", "5": "s", "$": "s", "7": "t", "+": "t", "2": "z",
}
#: Marks put between letters.
DROPPED = set("*.-_~^'`/\\,:;=")
#: Log probabilities of the channel: a substituted letter, a dropped mark, a collapsed repetition, a
#: character that stands for itself though it might stand for a letter.
SUBSTITUTE, DROP, COLLAPSE, STAY = -1.5, -0.7, -0.5, -6.0
#: Likewise, within a run of tokens: a dropped space, and one put in.
CLOSE, OPEN = -1.5, -6.0
#: Symbols of the language model: border, a to z, any other.
SYMBOLS, OTHER = 28, 27

#: Tokens that the channel may have changed: letters with a character of LEET or DROPPED, or one repeated.
MARKS = "[" + re.escape("".join(sorted({*LEET, *DROPPED}))) + "]"
NOISY = re.compile(rf"[a-z].*{MARKS}|{MARKS}.*[a-z]|([a-z])\1", re.S)
LEETED = re.compile("[" + re.escape("".join(sorted(LEET))) + "]")
EDGES = "\"'().,;:?[]{}<>«»„“”"
WITHOUT = str.maketrans("", "", "".join(sorted(DROPPED)))
AGAIN = re.compile(r"(.)\1+", re.S)


def symbol_table() -> np.ndarray:
    codes = np.full(256, OTHER, np.int32)
    codes[[ord(c) for c in " \t\n\x0b\x0c\r"]] = 0
    for i in range(26):
        codes[97 + i] = codes[65 + i] = 1 + i
    return codes


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of all SYMBOLS^3 trigrams over all texts; each task adds up to at most that many rows.
    Texts are counted a few at a time, so that their codes stay small."""

    def work(batches):
        codes = symbol_table()
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 32):
                raw = " ".join(t for t in batch.column("text").slice(i, 32).to_pylist() if t).encode("ascii", "replace")
                s = codes[np.frombuffer(b"  " + raw + b"  ", np.uint8)]
                total += np.bincount(s[:-2] * SYMBOLS**2 + s[1:-1] * SYMBOLS + s[2:], minlength=SYMBOLS**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["gram", "n"])

    ship(docs.sparkSession)
    rows = docs.select("text").mapInArrow(work, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(SYMBOLS**3)
    for r in rows:  # SYMBOLS^3 at most
        counts[r["gram"]] = r["n"]
    return counts


class Restorer:
    """Viterbi decoding of tokens under the trigram model."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
        two = c.sum(axis=0)
        one = two.sum(axis=0)
        uni = (one + 1) / (one.sum() + SYMBOLS)
        bi = (two + 20 * uni) / (two.sum(axis=1, keepdims=True) + 20)
        tri = (c + 20 * bi) / (c.sum(axis=2, keepdims=True) + 20)
        log = np.log(tri)
        self.log, self.flat = log, log.ravel().tolist()
        kept = log[:, :, :1, None] + log[None, :, 0, :, None] + log[None, None, 0]
        closed = CLOSE + log[:, :, :, None] + log[None]
        #: By the last two symbols of a word and the first two of the next: whether the space between goes.
        self.joins = (closed > kept).reshape(SYMBOLS**2, SYMBOLS**2)

    def options(self, token: str, i: int) -> list[tuple[str, float]]:
        """(output, log probability of the channel) for one character."""
        c, out = token[i], []
        if "a" <= c <= "z":
            out.append((c, 0.0))
            if i and token[i - 1] == c:
                out.append(("", COLLAPSE))
            return out
        out += [(x, SUBSTITUTE) for x in LEET.get(c, "")]
        if c in DROPPED or c in LEET:
            out.append(("", DROP if c in DROPPED else 4 * DROP))
        return [*out, (c, STAY)] if out else [(c, 0.0)]

    def decode(self, token: str, spaced: bool = False) -> str:
        """The likeliest reading; spaced: of a run of tokens, where spaces go and come."""
        flat, before = self.flat, ""
        states: dict[int, tuple[float, tuple]] = {0: (0.0, ())}  # number of the last two symbols: score, back-pointers
        for i, c in enumerate(token):
            if spaced and c != " " and before != " ":
                for k, (score, path) in list(states.items()):
                    if last := k % SYMBOLS:
                        total = score + OPEN + flat[k * SYMBOLS]
                        if (known := states.get(last * SYMBOLS)) is None or total > known[0]:
                            states[last * SYMBOLS] = (total, (path, " "))
            if "a" <= c <= "z" and c != before:
                options = ((c, 0.0),)
            else:
                options = ((" ", 0.0), ("", CLOSE)) if spaced and c == " " else self.options(token, i)
            after: dict[int, tuple[float, tuple]] = {}
            for out, cost in options:
                if not out:
                    for k, (score, path) in states.items():
                        if (known := after.get(k)) is None or score + cost > known[0]:
                            after[k] = (score + cost, path)
                    continue
                s = 0 if out == " " else ord(out) - 96 if "a" <= out <= "z" else OTHER
                for k, (score, path) in states.items():
                    key, total = k % SYMBOLS * SYMBOLS + s, score + cost + flat[k * SYMBOLS + s]
                    if (known := after.get(key)) is None or total > known[0]:
                        after[key] = (total, (path, out))
            states, before = after, c
        best = max(((score + (flat[k * SYMBOLS] if k % SYMBOLS or not spaced else 0.0), path) for k, (score, path) in states.items()), key=lambda x: x[0])
        out, path = [], best[1]
        while path:
            path, c = path
            out.append(c)
        return "".join(reversed(out))

    def restore(self, token: str) -> str:
        """The word that a lower-cased token stands for."""
        token = token.strip(EDGES)
        return self.decode(token) if NOISY.search(token) else token


class Features:
    """Features of a text: its restored words, and their beginnings (with a hyphen), which inflected forms
    share. Tokens are numbered and remembered up to a bound. weights: the features that count; null: all."""

    def __init__(self, restorer: Restorer, weights: dict[str, float] | None = None):
        self.restorer, self.weights = restorer, weights
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, tuple[str, tuple[str, ...], int, int, int]] = {}
        self.runs_known: dict[tuple[str, ...], tuple[str, ...]] = {}

    def features(self, word: str) -> list[str]:
        parts = [word, *(f"{word[:k]}-" for k in STEMS if len(word) >= k)] if word else []
        return parts if self.weights is None else [p for p in parts if p in self.weights]

    def token(self, bare: str) -> tuple[str, tuple[str, ...], int, int, int]:
        """A stripped token's word, features, numbers of the first two and last two symbols of what counts
        at its ends (the word, or the token without marks where no character stands for another), and
        the length of that."""
        if (found := self.known.get(bare)) is None:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            word = self.restorer.restore(bare)
            ends = word if LEETED.search(bare) else bare.translate(WITHOUT)
            s = [ord(c) - 96 if "a" <= c <= "z" else OTHER for c in (ends[:2] + ends[-2:] if len(ends) > 1 else ends)]
            head, tail = (s[0] * SYMBOLS + s[1], s[-2] * SYMBOLS + s[-1]) if len(s) > 1 else (s[0] * SYMBOLS, s[0]) if s else (0, 0)
            found = self.known[bare] = word, tuple(self.features(word)), head, tail, len(ends)
        return found

    def runs(self, text: str, spelled: bool = False) -> list[tuple[str, ...]]:
        """Neighbouring tokens that share a lattice, or single ones; those without a word are left out.
        spelled: only runs of single characters are put together."""
        found: list[list[str]] = []
        joins, tail, size = self.restorer.joins, 0, 0
        for t in text.lower().split():
            t = t.strip(EDGES)
            _, _, head, end, length = self.token(t)
            if not length:
                continue
            if found and (size == length == 1 or not spelled and joins[tail, head]):
                found[-1].append(t)
            else:
                found.append([t])
            tail, size = end, length
        return [tuple(r) for r in found]

    def run(self, run: tuple[str, ...]) -> tuple[str, ...]:
        """The words of a run of tokens."""
        if (words := self.runs_known.get(run)) is None:
            words = tuple(self.restorer.decode(" ".join(run), spaced=True).split())
            if len(run) <= 8:
                if len(self.runs_known) > REMEMBERED:
                    self.runs_known.clear()
                self.runs_known[run] = words
        return words

    def of_run(self, run: tuple[str, ...]) -> set[str]:
        found = {f for t in run for f in self.token(t)[1]}
        return found if len(run) == 1 else found | {f for w in self.run(run) for f in self.features(w)}

    def __call__(self, text: str, spelled: bool = False) -> set[str]:
        """Distinct features of the text."""
        return {f for r in self.runs(text, spelled) for f in self.of_run(r)}

    def restored(self, text: str) -> str:
        return " ".join(w for r in self.runs(text) for w in (self.run(r) if len(r) > 1 else [self.token(r[0])[0]]))


#: Kinds of characters besides the symbols 0 to OTHER: letters in disguise, marks.
DISGUISED, MARK = 30, 31
#: Characters that are looked at together.
CHUNK = 1 << 18


def kinds() -> tuple[np.ndarray, np.ndarray]:
    """Kind of each character, and whether it may stand at the edge of a token."""
    kind, edge = np.full(0x110000, OTHER, np.uint8), np.zeros(0x110000, bool)
    kind[[c for c in range(0x3001) if chr(c).isspace()]] = 0
    kind[97:123] = np.arange(1, 27)
    kind[[ord(c) for c in LEET]] = DISGUISED
    kind[[ord(c) for c in DROPPED]] = MARK
    edge[[ord(c) for c in EDGES]] = True
    return kind, edge


class Searched:
    """Features that count, of many texts: equal to Features with weights, but only lattices that may
    spell one of them are decoded.

    A lattice without disguised letters spells only what its characters without marks, spaces and
    repetitions hold, so an automaton over the features finds all that may; one with disguised letters is
    always decoded. Tokens, their ends and the runs they make are found for a chunk of texts at a time."""

    def __init__(self, restorer: Restorer, weights: dict[str, float]):
        self.features, self.kinds, self.edges = Features(restorer, weights), *kinds()
        self.wanted = ahocorasick.Automaton()
        for w in weights:
            if word := AGAIN.sub(r"\1", w.removesuffix("-").translate(WITHOUT)):
                self.wanted.add_word(word, len(word))
        self.wanted.make_automaton()

    def __call__(self, texts: list[str]) -> list[set[str]]:
        out, held, size = [], [], 0
        for t in texts:
            held.append(t.lower())
            size += len(t)
            if size > CHUNK:
                out += self.chunk(held)
                held, size = [], 0
        return out + self.chunk(held) if held else out

    def chunk(self, texts: list[str]) -> list[set[str]]:
        found: list[set[str]] = [set() for _ in texts]
        text = " ".join(texts)
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.kinds[code]
        written = kind > 0
        token = np.cumsum(written & ~np.concatenate([[False], written[:-1]])) - 1  # of each character
        # first and last character of each token within its edges
        inner = np.flatnonzero(written & ~self.edges[code])
        if not len(inner):
            return found
        first, last = ends_of(token[inner])
        number = token[inner[first]]  # tokens that have any
        begin, end = inner[first], inner[last]
        new = np.full(token[-1] + 1, -1)
        new[number] = np.arange(len(number))
        # what counts at its ends: all but marks
        kept = np.flatnonzero((kind > 0) & (kind != MARK))
        at = new[token[kept]]
        within = (at >= 0) & (kept >= begin[at]) & (kept <= end[at])
        kept, at = kept[within], at[within]
        disguised = np.zeros(len(number), bool)
        disguised[at[kind[kept] == DISGUISED]] = True
        first, last = ends_of(at)
        symbol = np.minimum(kind[kept], OTHER).astype(np.int32)
        size = np.zeros(len(number), np.int64)
        size[at[first]] = last - first + 1
        head, tail = np.zeros(len(number), np.int32), np.zeros(len(number), np.int32)
        two = last > first
        head[at[first]] = symbol[first] * SYMBOLS + np.where(two, symbol[np.minimum(first + 1, len(symbol) - 1)], 0)
        tail[at[first]] = np.where(two, symbol[np.maximum(last - 1, 0)] * SYMBOLS, 0) + symbol[last]
        bare = lambda i: text[begin[i] : end[i] + 1]
        for i in np.flatnonzero(disguised).tolist():
            head[i], tail[i], size[i] = self.features.token(bare(i))[2:]
        # runs of the tokens that have a word
        some = np.flatnonzero(size)
        if not len(some):
            return found
        starts = np.cumsum([0] + [len(t) + 1 for t in texts])
        of = np.searchsorted(starts, begin[some], side="right") - 1
        lone = size[some] == 1
        close = self.features.restorer.joins[tail[some[:-1]], head[some[1:]]] | (lone[:-1] & lone[1:])
        close &= of[:-1] == of[1:]
        run = np.concatenate([[0], np.cumsum(~close)])
        place = np.full(len(number), -1)
        place[some] = np.arange(len(some))
        # the runs that may spell a feature that counts
        letters = code[kept]
        fresh = np.concatenate([[True], letters[1:] != letters[:-1]])
        group = np.flatnonzero(fresh)
        later = np.append(group[1:], len(letters)) - 1  # last character of each repetition
        look = letters[group].tobytes().decode("utf-32-le", "surrogatepass")
        hits = np.array([(e - n + 1, e) for e, n in self.wanted.iter(look)] if len(self.wanted) else [], dtype=np.int64).reshape(-1, 2)
        low, high = place[at[later[hits[:, 0]]]], place[at[group[hits[:, 1]]]]
        low, high = np.minimum(low, high), np.maximum(low, high)  # a repetition over both
        # a token of its own spells words from its beginning on; within a run, spaces may be put in
        beginning = np.zeros(len(number), np.int64)
        beginning[at[first]] = first
        alone = np.bincount(run)[run] == 1
        use = (low >= 0) & (run[low] == run[high])
        use &= ~alone[low] | (beginning[some[low]] >= group[hits[:, 0]]) & (beginning[some[low]] <= later[hits[:, 0]])
        asked = np.unique(np.concatenate([run[low[use]], run[place[np.flatnonzero(disguised & (size > 0))]]]))
        begins, until = np.searchsorted(run, asked), np.searchsorted(run, asked, side="right")
        for lo, hi in zip(begins.tolist(), until.tolist(), strict=True):
            found[of[lo]] |= self.features.of_run(tuple(bare(i) for i in some[lo:hi].tolist()))
        return found


def ends_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first and the last of each stretch of equal keys."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.flatnonzero(keys[1:] != keys[:-1])
    return np.concatenate([[0], change + 1]), np.append(change, len(keys) - 1)


def counted(sample: DataFrame, counts) -> DataFrame:
    """(feature, a, b): in how many toxic and other texts of the sample each feature is found; read from
    single tokens and letters spelled out."""

    def work(batches):
        features, total = Features(Restorer(counts.value)), {}
        for batch in batches:
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for f in features(text, spelled=True):
                    both = total.setdefault(f, [0, 0])
                    both[label <= 0] += 1
        names = list(total)
        for i in range(0, len(names), 10_000):
            part = names[i : i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([total[f][k] for f in part], pa.int64()) for k in (0, 1))], names=["feature", "a", "b"])

    return sample.mapInArrow(work, "feature string, a long, b long").groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def telling(features: DataFrame, toxic: int, other: int) -> DataFrame:
    """Features whose share among toxic texts differs from that among the others by TELLING standard
    errors of the log odds ratio and by LIFT or more, and that occur in three texts at least."""
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    c, d = F.lit(toxic) - F.col("a") + 0.5, F.lit(other) - F.col("b") + 0.5
    odds, error = F.log(a / c) - F.log(b / d), F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    return features.where((F.abs(odds) >= F.greatest(F.lit(LIFT), TELLING * error)) & (F.col("a") + F.col("b") >= 3)).select("feature")


def fit(sample: DataFrame, counts, steps: int = 400, penalty: float = 2e-4) -> dict[str, float]:
    """Weights of the telling features; that of "" is the bias. sample: a row for each different text.

    Texts stay where they are; the driver gets the telling features, and their numbers for each text."""
    size = {r["label"] > 0: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, other = size.get(True, 0), size.get(False, 0)
    if not toxic or not other:
        return {"": 12.0 if toxic else -12.0}
    names = sorted(r["feature"] for r in telling(counted(sample, counts), toxic, other).collect())

    def work(batches):
        searched, number = Searched(Restorer(counts.value), dict.fromkeys(names, 1.0)), {f: i + 1 for i, f in enumerate(names)}
        for batch in batches:
            found = [sorted(number[f] for f in fs) for fs in searched(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("__key"), batch.column("label"), pa.array(found, pa.list_(pa.int32()))], names=["key", "label", "found"])

    rows = sample.mapInArrow(work, "key string, label long, found array<int>").toPandas().sort_values("key", kind="stable")
    labels = (rows["label"].to_numpy() > 0).astype(np.float64)
    found = [np.asarray(f, np.int64) for f in rows["found"]]

    def fitted(kept: np.ndarray) -> np.ndarray:
        """The bias, and the weights of the features of these numbers, which count from 1."""
        column = np.zeros(len(names) + 1, np.int64)
        column[kept] = np.arange(1, len(kept) + 1)
        x = Rows([(c, np.ones(len(c))) for c in (np.concatenate([[0], column[f][column[f] > 0]]) for f in found)], len(kept) + 1)
        shrunk = np.full(len(kept) + 1, penalty)
        shrunk[0] = 0
        start = np.zeros(len(kept) + 1)
        start[0] = math.log((labels.mean() + 1e-6) / (1 - labels.mean() + 1e-6))
        return descend(lambda v: x.back(sigmoid(x.times(v)) - labels) / len(labels) + shrunk * v, start, steps, 0.05)

    size = np.abs(fitted(np.arange(1, len(names) + 1))[1:])
    kept = np.flatnonzero(size >= LEAST * size.max(initial=0.0)) + 1
    return dict(zip(["", *(names[k - 1] for k in kept)], fitted(kept).tolist(), strict=True))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs: doc_id, text; labels: doc_id, toxic -> doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    out_of = lambda c: F.coalesce(F.crc32(c.cast("string").cast("binary")) % 4 == 2, F.lit(False))
    counts = spark.sparkContext.broadcast(trigram_counts(docs))  # SYMBOLS^3 numbers
    sample = labelled_texts(docs, labels, "toxic", TRAINING, ~out_of(F.col("__id")))
    model = spark.sparkContext.broadcast(fit(sample, counts))

    def make():
        weights = model.value
        searched = Searched(Restorer(counts.value), {f: w for f, w in weights.items() if f})

        def work(batch):
            scores = sigmoid([weights[""] + sum(sorted(weights[f] for f in fs)) for fs in searched(batch)])
            return {"score": pa.array(scores, pa.float64()), "predicted": pa.array((scores >= THRESHOLD).astype(np.int32), pa.int32())}

        work.done = searched.features.forget
        return work

    rows = docs.select("doc_id", out_of(F.col("doc_id")).alias("held_out"), "text")
    return over_texts(rows, make, "doc_id long, held_out boolean, score double, predicted int")


def query(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
