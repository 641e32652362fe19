"""Language identification: known words first, then ever shorter character n-grams.

For every language the model holds the negative log10 relative frequency of its words and of the character n-grams of
its words (with a space at either end), counted over all training texts. A word that any language knows is scored by
its word frequencies; a word that none knows is scored by its n-grams of the greatest length of which any is known,
averaged. A language that lacks the word or n-gram gets a penalty. A text has the language with the smallest mean.

An entry must have at least ``floor`` of its language's tokens (or n-grams of that length), so a language has at most
1 / floor entries of each kind whatever the corpus: that bounds the model that is broadcast.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.common import map_batches, narrow, stage


def _ranges(*categories: str) -> str:
    """The characters of some Unicode categories up to U+FFFF, as ranges of a pattern's character class."""
    at = [c for c in range(0x80, 0x10000) if unicodedata.category(chr(c)) in categories]
    starts = [c for i, c in enumerate(at) if i == 0 or at[i - 1] != c - 1]
    ends = [c for i, c in enumerate(at) if i + 1 == len(at) or at[i + 1] != c + 1]
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(starts, ends, strict=True))


#: Words: letters, and the marks that follow them; numerals such as superscripts and fractions are no letters.
_ASCII_WORD = re.compile(r"[^\W\d_]+")
_LETTER, _MARK = rf"[^\W\d_{_ranges('No', 'Nl')}]", f"[{_ranges('Mn', 'Mc', 'Me')}]"
_WORD = re.compile(f"{_LETTER}+(?:{_MARK}+{_LETTER}*)*")
_BEYOND = re.compile(r"[\U00010000-\U0010ffff]")
#: Smallest share of a language's tokens that an entry must have; 1 / FLOOR is the largest number of entries.
FLOOR = 1 / 50_000
LONGEST = 5
#: Score for what a language lacks: beyond the rarest entry that can be held.
PENALTY = 7.0
UNDETERMINED = "und"


def _words(text: str) -> list[str]:
    """Words in lower case. Beyond U+FFFF only letters make words; marks and numerals there part them."""
    text = text.lower()
    if text.isascii():
        return _ASCII_WORD.findall(text)
    return _WORD.findall(_BEYOND.sub(lambda m: m[0] if m[0].isalpha() else " ", text))


def _grams(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i:i + n] for i in range(len(padded) - n + 1)]


def word_counts(docs: DataFrame, lang: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(lang, word, n) over all texts whose language is not null; counted per task before the shuffle."""
    rows = narrow(docs, id_col, text_col, lang=lang.cast("string")).where("lang IS NOT NULL").select("lang", "text")

    def build():
        held: dict[str, Counter] = {}
        size = 0

        def flush():
            nonlocal size
            for name, counter in held.items():
                if counter:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(counter), pa.string()), pa.array(counter.keys(), pa.string()), pa.array(counter.values(), pa.int64())],
                        names=["lang", "word", "n"])
            held.clear()
            size = 0

        def work(batch):
            nonlocal size
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(name, Counter()).update(_words(text))
            size = sum(map(len, held.values()))
            if size > 400_000:
                yield from flush()

        work.finish = flush
        return work

    return map_batches(rows, build, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", floor: float = FLOOR, longest: int = LONGEST) -> DataFrame:
    """The model as a table (lang, size, gram, score): size 0 for words, 1 to ``longest`` for n-grams.

    All texts with a language are counted; entries below the share ``floor`` are left out (see the module). No rows
    if no text has a language and a letter.
    """
    counts = stage(word_counts(docs, docs[lang_col], id_col, text_col), "words")
    grams = _gram_counts(counts, longest)
    both = counts.select("lang", F.lit(0).alias("size"), F.col("word").alias("gram"), "n").unionByName(grams)
    both = stage(both, "grams")
    totals = both.groupBy("lang", "size").agg(F.sum("n").alias("total"))  # languages * (longest + 1) rows
    return (both.join(F.broadcast(totals), ["lang", "size"]).where(F.col("n") >= F.col("total") * F.lit(floor))
            .select("lang", "size", "gram", F.log10(F.col("total") / F.col("n")).alias("score")))


def _gram_counts(counts: DataFrame, longest: int) -> DataFrame:
    def build():
        held: dict[tuple[str, int], dict[str, int]] = {}
        size = 0

        def flush():
            nonlocal size
            for (name, n), counter in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(counter), pa.string()), pa.array([n] * len(counter), pa.int32()), pa.array(counter.keys(), pa.string()),
                     pa.array(counter.values(), pa.int64())], names=["lang", "size", "gram", "n"])
            held.clear()
            size = 0

        def work(batch):
            nonlocal size
            for name, word, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for n in range(1, longest + 1):
                    counter = held.setdefault((name, n), {})
                    for g in _grams(word, n):
                        counter[g] = counter.get(g, 0) + times
            size = sum(map(len, held.values()))
            if size > 400_000:
                yield from flush()

        work.finish = flush
        return work

    return map_batches(counts, build, "lang string, size int, gram string, n bigint").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))


class Scorer(dict):
    """Looks words up: word -> its row of scores. The words that no language knows are remembered (a memo of bounded size)."""

    def __init__(self, langs: list[str], tables: list[dict[str, np.ndarray]], memo: int = 200_000):
        words = tables[0] if tables else {}
        super().__init__(zip(words, range(len(words)), strict=True))
        self.langs, self.tables, self.memo, self.known = langs, tables, memo, len(words)
        self.unknown = np.full(len(langs), PENALTY)
        self.scores = np.concatenate([np.reshape([*words.values()], (len(words), len(langs))), np.empty((1_000, len(langs)))])
        self.long: list[str] = []

    def backoff(self, word: str) -> np.ndarray:
        for n in range(len(self.tables) - 1, 0, -1):
            table, grams = self.tables[n], _grams(word, n)
            if grams and any(g in table for g in grams):
                return sum((table.get(g, self.unknown) for g in grams), np.zeros(len(self.langs))) / len(grams)
        return self.unknown

    def word(self, word: str) -> np.ndarray:
        out = self.tables[0].get(word)
        return self.scores[self[word]] if out is None else out

    def __missing__(self, word: str) -> int:
        at = len(self)
        if at == len(self.scores):
            self.scores = np.concatenate([self.scores, np.empty_like(self.scores)])
        self.scores[at] = self.backoff(word)
        self[word] = at
        if len(word) > 40:
            self.long.append(word)
        return at

    def forget(self) -> None:
        """Drops the words that no language knows."""
        for word in list(self)[self.known:]:
            del self[word]
        self.scores = self.scores[:self.known + self.memo]
        self.long = []

    def text(self, text: str) -> tuple[str, float]:
        words = _words(text)
        if not words or not self.langs:
            return UNDETERMINED, 0.0
        counts = Counter(words)
        times = np.fromiter(counts.values(), float, len(counts))
        places = np.fromiter(map(self.__getitem__, counts), np.int64, len(counts))
        mean = times @ self.scores[places] / len(words)
        if len(self) - self.known > self.memo or len(self.long) > 1_000:
            self.forget()
        weights = np.power(10.0, mean.min() - mean)
        best = int(np.argmin(mean))  # equal means: the language that comes first by name
        return self.langs[best], float(weights[best] / weights.sum())


def scorer_tables(model: DataFrame) -> tuple[list[str], list[tuple[list[str], np.ndarray]]]:
    """The model in a form that is quick to send: names, and for each size the grams and a matrix of scores. Collected
    on the driver: at most languages * (longest + 1) / floor entries."""
    table = model.toArrow().to_pandas()
    langs = sorted(table["lang"].unique())
    where = {name: i for i, name in enumerate(langs)}
    out = []
    for n in range(int(table["size"].max()) + 1 if len(table) else 0):
        part = table[table["size"] == n]
        grams = sorted(part["gram"].unique())
        at = {g: i for i, g in enumerate(grams)}
        scores = np.full((len(grams), len(langs)), PENALTY)
        scores[part["gram"].map(at).to_numpy(int), part["lang"].map(where).to_numpy(int)] = part["score"].to_numpy()
        out.append((grams, scores))
    return langs, out


def predict(docs: DataFrame, model: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, lang_pred, score (the share of the language's likelihood per word, 0 to
    1). Null texts, texts without a letter and an empty model give ``und`` and 0. Only the text is looked at, so repeated
    rows and rows of one id are scored alike, each for itself; equal means go to the language that comes first by name,
    long texts are scored whole, an empty table gives none, and other columns play no part."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(scorer_tables(model))
    rows = narrow(docs, id_col, text_col)

    def build():
        langs, tables = sent.value
        score = Scorer(langs, [dict(zip(grams, scores, strict=True)) for grams, scores in tables])

        def work(batch):
            found = [score.text(t) for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                                              names=["doc_id", "lang_pred", "score"])

        return work

    return map_batches(rows, build, "doc_id bigint, lang_pred string, score double")
