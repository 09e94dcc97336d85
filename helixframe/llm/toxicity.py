"""Toxicity scoring behind a noisy-channel decoder.

Words that look disguised (leetspeak, letters kept apart by spaces or marks, letters repeated) become a
lattice of what each character may stand for. A Viterbi search over a character trigram model finds the
likeliest reading, and the restored text is what is scored. The language model counts all documents and
stays a table: each distinct disguised token of the corpus is decoded once, in blocks of bounded length, and a
block is joined with just the counts that its lattices can ask for. The restored forms are joined to the texts
that hold the tokens. Nothing that grows with the corpus goes to the driver or to every task.

The score: words and word stems that are far more frequent in labelled toxic documents than in others
(counted over one part of the sample), summed up in a few numbers per document (how many, how strong,
how dense), weighed by logistic regression (fitted on the other part). Only texts are inputs of a score, and
each distinct text is scored once.

Defined results: null and empty texts have no feature and get the lowest score; without a labelled
example of both kinds every score is 0; every input row gives one row.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE, fresh_name, lean, raw, ship, slices, written
from .learning import CUT, MAX_LABELLED, best_cut, crc_of, fold, labelled_texts, newton, to_unit

#: Letters that a character may stand for in leetspeak.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "(": "c", "€": "e", "£": "l"}
#: Marks that only keep letters apart, and marks at a word's ends.
APART = ".-_*~'·"
ENDS = ".,;:!?\"'()[]{}%&#*$@+|<>=~«»„“”¿¡…-_"
#: Costs of the channel in nats: a letter stands for itself at none.
LEET_COST, APART_COST, REPEAT_COST, LITERAL_COST, UNSEEN = 1.0, 0.4, 0.3, 4.0, 1e-3
#: How many words or trigrams a task counts before it sends them on, and how many words and costs it remembers.
WORDS_HELD, REMEMBERED = 200_000, 80_000
#: Code points of the tokens that are decoded together, and the most tasks that blocks are dealt to.
BLOCK, MAX_TASKS = 50_000, 20_000
#: Of the marks at a word's ends, those that may be letters, and of them those that are usual there as marks.
LEET_MARKS = frozenset(ENDS) & frozenset(LEET) | {"€", "£"}
USUAL = (frozenset("("), frozenset("!"))
PLAIN_ENDS = "".join(c for c in ENDS if c not in LEET_MARKS)
AMOUNT = re.compile(r"[-+($€£|!]*[\d.,:/-]+[-+$€£|!%)]*").fullmatch
SPACED = re.compile(r"(?<!\S)(?:[^\W_]|[@$!|+(€£])(?:\s+(?:[^\W_]|[@$!|+(€£])){2,}(?!\S)")
REPEATED = re.compile(r"(.)\1\1")


class Counts(Mapping):
    """Counts by strings of up to three characters, as sorted codes and their counts."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        order = np.argsort(codes, kind="stable")
        self.codes, self.counts = codes[order], counts[order]

    @staticmethod
    def code(s: str) -> int:
        n = 0
        for c in s:
            n = n << 21 | ord(c)
        return n

    def __getitem__(self, s: str) -> int:
        code = self.code(s)
        i = int(np.searchsorted(self.codes, code))
        if i == len(self.codes) or self.codes[i] != code:
            raise KeyError(s)
        return int(self.counts[i])

    def __len__(self) -> int:
        return len(self.codes)

    def __iter__(self) -> Iterator[str]:
        return ("".join(chr(n >> k & 0x1FFFFF) for k in (42, 21, 0) if n >> k) for n in self.codes.tolist())


@dataclass
class CharModel:
    """Character trigrams; "^" and "$" stand for a word's ends."""

    tri: Mapping[str, float] = field(default_factory=dict)
    bi: Mapping[str, float] = field(default_factory=dict)
    size: int = 30
    known: dict[tuple[str, str], float] = field(default_factory=dict, repr=False)  # costs asked for so far

    @classmethod
    def of(cls, counts: dict[str, int]) -> CharModel:
        return cls.of_codes(np.array([Counts.code(t) for t in counts], dtype=np.int64), np.array(list(counts.values()), dtype=np.int64))

    @classmethod
    def of_codes(cls, codes: np.ndarray, counts: np.ndarray) -> CharModel:
        tri = Counts(codes, counts)
        before, at = np.unique(tri.codes >> 21, return_index=True)
        sums = np.add.reduceat(tri.counts, at) if len(at) else tri.counts
        return cls(tri, Counts(before, sums), len(np.unique(tri.codes & 0x1FFFFF)) + 1)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def cost(self, before: str, c: str) -> float:
        """-log P(c | the two characters before)."""
        got = self.known.get((before, c))
        if got is None:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            got = self.known[before, c] = -math.log((self.tri.get(before + c, 0) + UNSEEN) / (self.bi.get(before, 0) + UNSEEN * self.size))
        return got

    def word_cost(self, word: str) -> float:
        s = "^^" + word + "$"
        return float(sum(self.cost(s[i - 2 : i], s[i]) for i in range(2, len(s))))


def readings(token: str) -> list[list[tuple[str, float]]]:
    """The lattice: for each run of one character, what it may be read as, with the channel's cost.

    Marks at the ends may also be no letter: those that are usual there at no cost."""
    first, last = len(token) - len(token.lstrip(ENDS)), len(token.rstrip(ENDS))
    out = []
    for m in re.finditer(r"(.)\1*", token, re.S):
        c, n = m[1], len(m[0])
        if c.isalpha():
            opts = [(c * k, REPEAT_COST * (n - k)) for k in sorted({1, min(n, 2)})] if n > 2 else [(c * n, 0.0)]
        else:
            opts = [(c * n, LITERAL_COST * n)]
            opts += [(x * k, LEET_COST * k) for x in LEET.get(c, "") for k in sorted({1, min(n, 2)})]
            if m.end() <= first or m.start() >= last:
                unusual = c in LEET_MARKS and c not in USUAL[m.start() >= last]
                opts.append(("", LITERAL_COST if unusual else 0.0))
            elif c in APART:
                opts.append(("", APART_COST))
        out.append(opts)
    return out


def viterbi(lattice: list[list[tuple[str, float]]], lm: CharModel) -> tuple[str, float]:
    """The likeliest reading and its cost. A state is the last two characters read; a blank ends a word and begins one."""
    best: dict[str, tuple[float, tuple]] = {"^^": (0.0, ())}
    for opts in [*lattice, [("$", 0.0)]]:
        after: dict[str, tuple[float, tuple]] = {}
        for state, (cost, done) in best.items():
            for text, extra in opts:
                c, s = cost + extra, state
                for x in text:
                    if x == " ":
                        c += lm.cost(s, "$")
                        s = "^^"
                    else:
                        c += lm.cost(s, x)
                        s = s[1] + x
                if s not in after or c < after[s][0]:
                    after[s] = (c, (done, text))
        best = after
    state = min(best, key=lambda s: (best[s][0], s))
    cost, done = best[state]
    parts = []
    while done:
        done, text = done
        parts.append(text)
    return "".join(reversed(parts))[:-1], cost


def spells(core: str) -> bool:
    """Whether a token without letters may be a word: it has different marks that may be letters, and is no amount."""
    return len(set(core) & set(LEET)) > 1 and any(c in "@$€£" for c in core) and not AMOUNT(core)


class Plain(dict):
    """The form of a word (lower case) that needs no decoding, or None where it does; remembers the first words it meets."""

    def __missing__(self, word: str) -> str | None:
        core = word.strip(PLAIN_ENDS)
        if core.isalpha():
            out = None if REPEATED.search(core) else core
        elif spells(core) or any(map(str.isalpha, core)):
            out = None
        else:
            out = word.strip(ENDS)
        if len(self) < REMEMBERED:
            self[word] = out
        return out

    def parts(self, text: str) -> tuple[Counter, Counter]:
        """The words of a text as they are, and the tokens to decode: words, or letters kept apart by one blank each."""
        low, odd = text.lower(), Counter()
        tokens = low.split()

        def take(m: re.Match) -> str:
            letters = m[0].split()
            if few_numbers(letters):
                return m[0]
            odd[" ".join(letters)] += 1
            return " "

        if letters_apart(tokens):
            tokens = SPACED.sub(take, low).split()
        words = Counter(map(self.__getitem__, tokens))
        if words.pop(None, 0):
            odd.update(w for w in tokens if self[w] is None)
        return words, odd


def letters_apart(tokens: list[str]) -> bool:
    """Whether three tokens of one character follow each other, without which SPACED finds nothing."""
    return b"\1\1\1" in bytes(map((1).__eq__, map(len, tokens)))


def few_numbers(letters: list[str]) -> bool:
    return len(letters) < 4 and not any(x.isalpha() for x in letters)


def apart(letters: list[str]) -> list[list[tuple[str, float]]]:
    """The lattice of letters kept apart: words where the model finds them likelier than as many words."""
    lattice = []
    for before, c in zip(["", *letters], letters, strict=False):
        opts = readings(f"x{c}x")[1] if not c.isalpha() else [(c, 0.0)]
        if before == c:
            opts = [*opts, ("", REPEAT_COST)]
        lattice += ([[("", 0.0), (" ", 0.0)]] if before else []) + [opts]
    return lattice


class Restorer(dict):
    """Restored form by word as written (lower case); forgets when it has become large."""

    def __init__(self, lm: CharModel):
        super().__init__()
        self.lm, self.plain = lm, Plain()

    def __missing__(self, word: str) -> str:
        if len(self) > REMEMBERED:
            self.clear()
        out = self.plain[word]
        if out is None:
            out = viterbi(readings(word.strip(PLAIN_ENDS)), self.lm)[0].strip(ENDS)
        self[word] = out
        return out

    def words(self, text: str) -> list[str]:
        """The words of the restored text."""
        low = SPACED.sub(self._joined, text.lower())
        return [self[w] for w in low.split()]

    def form(self, token: str) -> list[str]:
        """The words that a token of Plain.parts stands for."""
        if " " not in token:
            return [self[token]]
        return [self[w] for w in viterbi(apart(token.split(" ")), self.lm)[0].split()]

    def _joined(self, m: re.Match) -> str:
        letters = m[0].split()
        return m[0] if few_numbers(letters) else viterbi(apart(letters), self.lm)[0]


def asked_for(token: str) -> set[int]:
    """The codes of all trigrams, and of the two characters before, whose counts the decoder may ask for.

    The words that letters kept apart give may be decoded again: a run may shrink and a mark may go, so any
    place of their lattice may also be read as nothing."""
    lattice = [[*opts, ("", 0.0)] for opts in apart(token.split(" "))] if " " in token else readings(token.strip(PLAIN_ENDS))
    states, out = {"^^"}, set()
    for opts in [*lattice, [("$", 0.0)]]:
        after = set()
        for state in states:
            for text, _ in opts:
                s = state
                for x in text:
                    out.add(s + ("$" if x == " " else x))
                    s = "^^" if x == " " else s[1] + x
                after.add(s)
        states = after
    codes = {Counts.code(t) for t in out}
    return codes | {c >> 21 for c in codes}


def said(texts: DataFrame) -> DataFrame:
    """(w, n): the words of all texts, lower case, with their counts, and letters kept apart with a count of none."""
    ship(texts.sparkSession)

    def count(batches: Iterator) -> Iterator:
        seen: Counter = Counter()

        def out():
            return pa.RecordBatch.from_pydict({"w": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

        for b in batches:
            for held in slices(b.column(0)):
                for text in held:
                    low = text.decode("utf-8", "replace").lower()
                    seen.update(tokens := low.split())
                    for m in SPACED.finditer(low) if letters_apart(tokens) else ():
                        if not few_numbers(letters := m[0].split()):
                            seen.setdefault(" ".join(letters), 0)
                    if len(seen) > WORDS_HELD:
                        yield out()
                        seen.clear()
        yield out()

    counted = texts.mapInArrow(lean(count), "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
    return written(counted, "words")


def gram_counts(words: DataFrame) -> DataFrame:
    """(code, n): the trigrams of words made of letters, by code, and the sums of those that begin alike, by the code of two."""

    def trigrams(batches: Iterator) -> Iterator:
        got: Counter = Counter()

        def out():
            return pa.RecordBatch.from_pydict({"code": pa.array(list(got), pa.int64()), "n": pa.array(list(got.values()), pa.int64())})

        for b in batches:
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = w.strip(ENDS)
                if w.isalpha():
                    s = "^^" + w + "$"
                    for i in range(len(s) - 2):
                        code = Counts.code(s[i : i + 3])
                        got[code] += n
                        got[code >> 21] += n
                if len(got) > WORDS_HELD:
                    yield out()
                    got.clear()
        yield out()

    return written(words.mapInArrow(lean(trigrams), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")), "trigrams")


def odd_tokens(words: DataFrame) -> DataFrame:
    """(token): the words that need decoding."""

    def pick(batches: Iterator) -> Iterator:
        plain = Plain()
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([w for w in b.column(0).to_pylist() if " " in w or plain[w] is None], pa.string())], names=["token"])

    return words.select("w").mapInArrow(lean(pick), "token string")


@dataclass
class Language:
    """The character model of a corpus as a table of counts by code, and its size: how many characters may follow."""

    grams: DataFrame
    size: int

    @classmethod
    def of(cls, words: DataFrame) -> Language:
        grams = gram_counts(words)
        ends = grams.where(F.col("code") >= 1 << 42).select(F.col("code").bitwiseAND(0x1FFFFF).alias("c")).distinct()
        return cls(grams, ends.count() + 1)

    def forms(self, tokens: DataFrame) -> DataFrame:
        """(token, words) of distinct tokens. A block is decoded with the counts that it may ask for and no others."""
        size = self.size
        length = tokens.agg(F.sum(F.char_length("token").cast("long"))).first()[0] or 0
        blocks = length // BLOCK + 1
        tokens = tokens.withColumn("block", F.pmod(F.xxhash64("token"), F.lit(blocks)))
        tokens = written(tokens.repartition(min(blocks, MAX_TASKS), "block"), "tokens")

        def ask(batches: Iterator) -> Iterator:
            wanted: set = set()

            def out():
                cols = list(zip(*wanted, strict=True)) or [()] * 2
                return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["block", "code"])

            for b in batches:
                for token, block in rows_of(b):
                    wanted.update((block, code) for code in asked_for(token))
                    if len(wanted) > WORDS_HELD:
                        yield out()
                        wanted.clear()
            yield out()

        def decode(held: pa.Table, counts: pa.Table) -> pa.Table:
            codes, n = counts["code"].to_numpy(), counts["n"].to_numpy()
            three = codes >= 1 << 42
            restore = Restorer(CharModel(Counts(codes[three], n[three]), Counts(codes[~three], n[~three]), size))
            names = held["token"].to_pylist()
            return pa.table({"token": pa.array(names, pa.string()), "words": pa.array([restore.form(t) for t in names], pa.list_(pa.string()))})

        counts = tokens.mapInArrow(lean(ask), "block long, code long").distinct().join(self.grams, "code")
        spread = [df.repartition(min(blocks, MAX_TASKS), "block").groupBy("block") for df in (tokens, counts.select("block", "code", "n"))]
        return written(spread[0].cogroup(spread[1]).applyInArrow(decode, "token string, words array<string>"), "forms")


def restored(odd: DataFrame, forms: DataFrame, key: str) -> DataFrame:
    """(key, got): what the tokens of each key stand for, with their counts. odd: one row a key, a map of counts by token."""
    rows = odd.select(key, F.explode("odd").alias("token", "times")).join(forms, "token")
    return rows.groupBy(key).agg(F.collect_list(F.struct("words", "times")).alias("got"))


def with_restored(words: Counter, got: list | None) -> Counter:
    for g in got or []:
        for w in g["words"]:
            words[w] += g["times"]
    return words


def rows_of(b: pa.RecordBatch) -> Iterator[tuple]:
    """The rows of a batch, a slice of them as Python objects at a time."""
    for i in range(0, b.num_rows, SLICE):
        yield from zip(*(c.slice(i, SLICE).to_pylist() for c in b.columns), strict=True)


def stem(word: str) -> str:
    return "^" + word[:5]


@dataclass
class Model:
    language: Language
    weights: dict[str, float]
    coef: np.ndarray
    cut: float

    def weight(self, word: str) -> float:
        return max(self.weights.get(word, 0.0), self.weights.get(stem(word), 0.0))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"language": None}  # tables stay on the driver

    def known(self, words: Counter) -> Counter:
        return Counter({w: c for w, c in words.items() if w in self.weights or stem(w) in self.weights})

    def summary(self, words: Counter, n: int) -> list[float]:
        """Few numbers from the known words and the number of all: what is found, how strong, how dense."""
        got = sorted(((self.weight(w), c) for w, c in self.known(words).items()), reverse=True)
        total = sum(w * c for w, c in got)
        return [1.0, np.log1p(sum(c for _, c in got)), got[0][0] if got else 0.0, sum(w for w, _ in got[:3]), total / (1 + n) ** 0.5, 10 * total / (10 + n)]

    def score(self, rows: np.ndarray) -> np.ndarray:
        return to_unit(rows @ self.coef, self.cut, 1.0) if len(self.weights) else np.zeros(len(rows))


#: How many numbers a summary has.
WIDTH = 6


def odd_of(b: pa.Array, plain: Plain) -> pa.Array:
    return pa.array([list(plain.parts(t or "")[1].items()) for t in b.to_pylist()], pa.map_(pa.string(), pa.int64()))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", keep=None, limit: int = MAX_LABELLED, language: Language | None = None, forms: DataFrame | None = None) -> Model:
    """docs: doc_id, text. labels: doc_id and the label column; keep: which of its rows may be learned from.

    language and forms, if the caller has them: the character model of docs and the forms of its tokens."""
    ship(docs.sparkSession)
    language = language or Language.of(said(docs.select(F.col("text").cast("string"))))
    texts = labelled_texts(docs, labels, label, keep, limit)

    def odd(batches: Iterator) -> Iterator:
        plain = Plain()
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                part = b.slice(i, SLICE)
                yield pa.RecordBatch.from_arrays([part.column(0), odd_of(part.column(1), plain)], names=["doc_id", "odd"])

    tokens = texts.select("doc_id", "text").mapInArrow(lean(odd), "doc_id long, odd map<string,long>")
    if forms is None:
        forms = language.forms(tokens.select(F.explode("odd").alias("token", "times")).select("token").distinct())
    texts = written(texts.join(restored(tokens, forms, "doc_id"), "doc_id", "left").withColumn("part", fold(F.col("doc_id"), 3)), "labelled-words")

    def count(batches: Iterator) -> Iterator:
        """For each word and stem: documents and occurrences by label. The empty word counts documents and words."""
        plain = Plain()
        seen: dict[str, list[int]] = {}

        def add(key: str, y: int, times: int) -> None:
            row = seen.setdefault(key, [0, 0, 0, 0])
            row[y] += 1
            row[2 + y] += times

        def out():
            cols = list(zip(*seen.values(), strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *(pa.array(c, pa.int64()) for c in cols)], names=["f", "d0", "d1", "c0", "c1"])

        for b in batches:
            for text, y, got in rows_of(b):
                words = with_restored(plain.parts(text or "")[0], got)
                words.pop("", None)
                stems: Counter = Counter()
                for w, c in words.items():
                    if len(w) > 5:
                        stems[stem(w)] += c
                for k, c in (*words.items(), *stems.items()):
                    add(k, y, c)
                add("", y, words.total())
            if len(seen) > WORDS_HELD:
                yield out()
                seen.clear()
        yield out()

    sums = [F.sum(c).alias(c) for c in ("d0", "d1", "c0", "c1")]
    counts = texts.where("part > 0").select("text", "label", "got").mapInArrow(lean(count), "f string, d0 long, d1 long, c0 long, c1 long").groupBy("f").agg(*sums)
    counts = written(counts, "label-counts")
    total = counts.where("f = ''").first()
    if total is None or not total["d0"] or not total["d1"]:
        return Model(language, {}, np.zeros(WIDTH), 0.0)
    odds = F.log((F.col("c1") + 0.5) / (total["c1"] + 1)) - F.log((F.col("c0") + 0.5) / (total["c0"] + 1))
    least = max(2, min(8, total["d1"] // 50))
    best = counts.where((F.col("f") != "") & (F.col("d1") >= least)).withColumn("w", odds).where("w > 1.5").select("f", "w").collect()  # words of the bounded sample
    model = Model(language, {r["f"]: min(6.0, r["w"]) for r in best}, np.zeros(WIDTH), 0.0)

    def summaries(batches: Iterator) -> Iterator:
        plain = Plain()
        for b in batches:
            found = [with_restored(plain.parts(t or "")[0], got) for t, _, got in rows_of(b)]
            rows = [model.summary(words, words.total()) for words in found]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), b.column(1)], names=["x", "label"])

    rows = texts.where("part = 0").select("text", "label", "got").mapInArrow(lean(summaries), "x array<double>, label int").collect()  # of the bounded sample
    if not rows:
        return model
    x, y = np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows])
    model.coef = newton(x, y, 1.0)

    def f1(pred, y):
        hit = (pred & (y == 1)).sum()
        return 2 * hit / max(1, pred.sum() + (y == 1).sum())

    model.cut = best_cut(x @ model.coef, y, f1) if y.any() else 1e9
    return model


def text_key(text: Column) -> Column:
    """Equal for equal texts; a null text is an empty one."""
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def scores(docs: DataFrame, model: Model, text_col: str = "text", forms: DataFrame | None = None) -> DataFrame:
    """(key, score, predicted), one row a distinct text. forms: of the tokens of docs, if the caller has them."""
    ship(docs.sparkSession)
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    if forms is None:
        forms = model.language.forms(odd_tokens(said(texts)))
    counts = pa.map_(pa.string(), pa.int64())

    def look(batches: Iterator) -> Iterator:
        plain = Plain()
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                part = b.slice(i, SLICE)
                found = [plain.parts(t.decode("utf-8", "replace")) for t in raw(part.column(1))]
                cols = [pa.array([words.total() for words, _ in found], pa.int64()), pa.array([list(model.known(words).items()) for words, _ in found], counts), pa.array([list(odd.items()) for _, odd in found], counts)]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=["key", "n", "known", "odd"])

    def rate(batches: Iterator) -> Iterator:
        for b in batches:
            for i in range(0, b.num_rows, SLICE):
                part, rows = b.slice(i, SLICE), []
                for n, known, got in zip(*(part.column(j).to_pylist() for j in (1, 2, 3)), strict=True):
                    again = with_restored(Counter(), got)
                    rows.append(model.summary(Counter(dict(known)) + again, n + again.total()))
                s = model.score(np.array(rows).reshape(-1, WIDTH))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64()), pa.array((s >= CUT).astype(np.int32), pa.int32())], names=["key", "score", "predicted"])

    shape = "key string, n long, known map<string,long>, odd map<string,long>"
    seen = texts.select(text_key(F.col("text")).alias("key"), "text").mapInArrow(lean(look), shape)
    seen = written(seen.dropDuplicates(["key"]), "text-words")
    joined = seen.drop("odd").join(restored(seen, forms, "key"), "key", "left")
    return written(joined.select("key", "n", "known", "got").mapInArrow(lean(rate), "key string, score double, predicted int"), "text-scores")


def score(docs: DataFrame, model: Model, text_col: str = "text", forms: DataFrame | None = None) -> DataFrame:
    """Adds score (double) and predicted (int)."""
    held = [c for c in docs.columns if c not in ("score", "predicted")]
    key = fresh_name(docs, "__key")
    by_text = scores(docs, model, text_col, forms).withColumnRenamed("key", key)
    return docs.select(*held).withColumn(key, text_key(F.col(f"`{text_col}`"))).join(by_text, key).select(*[F.col(f"`{c}`") for c in held], "score", "predicted")


def text_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, score, predicted) by distinct text of docs; labels of held-out rows are never learned from."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    words = said(docs.select("text"))
    language = Language.of(words)
    forms = language.forms(odd_tokens(words))
    model = fit(docs, labels, keep=crc_of(F.col("doc_id"), 4) != 2, language=language, forms=forms)
    return scores(docs, model, forms=forms)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The input columns with held_out, score and predicted."""
    held = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    key = fresh_name(docs, "__key")
    by_text = text_scores(docs, labels).withColumnRenamed("key", key)
    rows = docs.select(*held).withColumn(key, text_key(F.col("text"))).join(by_text, key)
    return rows.select(*[F.col(f"`{c}`") for c in held], "score", "predicted", (crc_of(F.col("doc_id"), 4) == 2).alias("held_out"))
