"""Token counts of every prefix of a text, by prefix dynamic programming over a byte-pair model's pieces.

The count of a prefix is the count of the prefix before its last token, plus one; the last token is the unique one that
may follow (see :class:`broadsheet.llm.sentencepiece.PieceTable`). So one pass over a text yields the exact count that
the library would give for each of its prefixes, each as a difference of one byte to the one before. Total, truncation
and budget questions are sums over these differences; the text is not encoded again for any of them.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet.llm.common import map_batches, narrow
from broadsheet.llm.sentencepiece import SPACE, PieceTable, read_model

_RUNS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Words up to so many characters are remembered.
MEMO_CHARS = 40


class PrefixCounts:
    """Differences of the token count from each prefix of a text to the next (signed bytes, one a character)."""

    def __init__(self, table: PieceTable, memo: int = 400_000):
        self.table, self.memo = table, memo
        self.words: dict[str, bytes] = {}
        spaces = {len(p): table.scores[i] for p, i in table.ids.items() if not p.strip(SPACE)}
        self.longest = max(spaces, default=0)
        others = [table.scores[i] for p, i in table.ids.items() if len(p) > 1 and p.strip(SPACE)]
        #: tokens of runs of spaces: joined last and from the left, so a run is longest pieces and then what is left
        self.of_spaces = [len(table.merge(SPACE * n)) for n in range(3 * self.longest + 1)]
        if len({s for n, s in spaces.items() if n > 1}) > 1 or others and spaces.get(2, -np.inf) >= min(others) or any(
                self.of_spaces[n + self.longest] != self.of_spaces[n] + 1 for n in range(2 * self.longest)):
            raise ValueError("only models that join runs of spaces last, from the left, are read")
        if max(map(len, table.ids), default=0) > 30:  # a difference is at most a few of the longest piece's length
            raise ValueError("a piece is too long for differences of one byte")
        self.lone = table.ids[SPACE]

    def spaces(self, n: int) -> int:
        """Tokens of a run of ``n`` spaces."""
        return n // self.longest + self.of_spaces[n % self.longest]

    def last_tokens(self, run: str) -> tuple[list[int], list[int]]:
        """For each prefix of a run of known characters (spaces only as its first): its last token, and its count."""
        table = self.table
        n, memo, limit = len(run), table.compatible, table.memo
        last, count = [-1] * (n + 1), [0] * (n + 1)
        for end, (length, token) in table.automaton.iter(run):
            end += 1
            if last[end] >= 0:
                continue
            start = end - length
            before = last[start]
            if before < 0 and start:
                continue
            pair = before << 32 | token
            good = memo.get(pair)
            if good is None:
                if len(memo) >= limit:
                    memo.clear()
                good = memo[pair] = table.fits(before, token)
            if good:
                last[end], count[end] = token, count[start] + 1
        return last, count

    def counts(self, run: str) -> list[int]:
        """Count of each prefix, from the empty one: known characters as above, unknown ones by their bytes."""
        letters = self.table.letters
        if letters.issuperset(run):
            return self.last_tokens(run)[1]
        out, start = [0], 0
        for i in range(len(run) + 1):
            if i < len(run) and run[i] in letters:
                continue
            if i > start:
                done = out[-1]
                out += [done + c for c in self.last_tokens(run[start:i])[1][1:]]
            if i < len(run):
                out.append(out[-1] + len(run[i].encode("utf-8", "replace")))
            start = i + 1
        return out

    def lone_first(self, run: str) -> list[bool]:
        """For each prefix of a run that starts with a space: is that space a token of its own?"""
        known = 0
        while known < len(run) and run[known] in self.table.letters:
            known += 1
        last, _ = self.last_tokens(run[:known])
        out = [False, True]
        for end in range(2, known + 1):
            start = end - len(self.table.pieces[last[end]])
            out.append(out[start] if start else False)
        return out + out[-1:] * (len(run) - known)

    def run(self, run: str) -> bytes:
        """Differences over spaces and the characters after them."""
        word = run.lstrip(SPACE)
        n = len(run) - len(word)
        if n == 0 or n == 1 and word:
            counts = self.counts(run)
        else:
            counts = [self.spaces(k) for k in range(n + 1)]
            if word:
                # letters join before spaces do, so the last space goes with the word if the word's first token takes it
                with_all, without = self.spaces(n) - 1, self.spaces(n - 1)
                tail = zip(self.counts(SPACE + word), self.lone_first(SPACE + word), strict=True)
                counts += [c + (with_all if lone else without) for c, lone in list(tail)[2:]]
        return bytes([(b - a) & 255 for a, b in zip(counts, counts[1:])])

    def word(self, word: str) -> bytes:
        """``run`` of a word with one space before it, remembered."""
        out = self.words.get(word)
        if out is None:
            out = self.run(SPACE + word)
            if len(word) <= MEMO_CHARS:
                if len(self.words) >= self.memo:
                    self.words.clear()
                self.words[word] = out
        return out

    def of(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.table.dummy_prefix:
            return b"".join(map(self.run, _RUNS.findall(text.replace(" ", SPACE))))
        if SPACE not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            out = b"".join(map(self.word, text.split(" ")))
        else:
            out = b"".join(map(self.run, _RUNS.findall(SPACE + text.replace(" ", SPACE))))
        # the space that encoding puts first is no character of the text: its count goes to the first one
        return np.array([np.frombuffer(out[:2], np.int8).sum()], np.int8).tobytes() + out[2:]


_COUNTERS: dict[int, PrefixCounts] = {}


def _counter(model: bytes) -> PrefixCounts:
    """One for each model and worker process."""
    key = hash(model)
    if key not in _COUNTERS:
        _COUNTERS[key] = PrefixCounts(PieceTable(model))
    return _COUNTERS[key]


def counts_of(steps: bytes) -> np.ndarray:
    """Token count of each prefix, from the empty one to the whole text."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int64)])


def fitting(steps: bytes, limit: int) -> int:
    """Characters of the longest prefix with at most ``limit`` tokens (a longer prefix may have fewer tokens)."""
    if limit < 0:
        return -1
    return int(np.flatnonzero(counts_of(steps) <= limit)[-1])


def prefix_table(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_chars, n_tokens (without begin and end), steps (binary: a
    signed byte for each character, how the count changes with it). Made to be stored, about as large as the texts; the
    functions below answer from it alone.

    A narrow pass: no shuffle, memory for one chunk of texts and bounded memos. Null and empty texts count nothing;
    repeated rows and null ids stay as they are; an empty table gives none; other columns are not looked at.
    """
    model = read_model(model_path)

    def build():
        counter = _counter(model)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1)
            steps = [counter.of(t) for t in texts.to_pylist()]
            total = [int(np.frombuffer(s, np.int8).sum(dtype=np.int64)) for s in steps]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.compute.binary_length(texts).cast(pa.int64()), pa.array(map(len, steps), pa.int64()), pa.array(total, pa.int64()), pa.array(steps, pa.binary())],
                names=["doc_id", "n_bytes", "n_chars", "n_tokens", "steps"])

        return work

    return map_batches(narrow(docs, id_col, text_col), build, "doc_id bigint, n_bytes bigint, n_chars bigint, n_tokens bigint, steps binary")


def tokens_before(chars: Column, steps: Column | str = "steps") -> Column:
    """Tokens of the prefix of ``chars`` characters (the whole text where it is shorter), from stored steps."""
    @F.arrow_udf(T.LongType())
    def count(rows: pa.Array, at: pa.Array) -> pa.Array:
        return pa.array([None if s is None or n is None else int(np.frombuffer(s, np.int8)[:max(0, n)].sum(dtype=np.int64))
                         for s, n in zip(rows.to_pylist(), at.to_pylist(), strict=True)], pa.int64())

    return count(F.col(steps) if isinstance(steps, str) else steps, chars.cast("bigint"))


def fitting_chars(limit: Column, steps: Column | str = "steps") -> Column:
    """Characters of the longest prefix with at most ``limit`` tokens, from stored steps (-1 for a negative limit)."""
    @F.arrow_udf(T.LongType())
    def fit(rows: pa.Array, most: pa.Array) -> pa.Array:
        return pa.array([None if s is None or n is None else fitting(s, n) for s, n in zip(rows.to_pylist(), most.to_pylist(), strict=True)], pa.int64())

    return fit(F.col(steps) if isinstance(steps, str) else steps, limit.cast("bigint"))


def truncated(text: Column | str, limit: Column, steps: Column | str = "steps") -> Column:
    """The longest prefix of ``text`` (null: empty) with at most ``limit`` tokens."""
    text = F.col(text) if isinstance(text, str) else text
    return F.substring(F.coalesce(text, F.lit("")), F.lit(1), F.greatest(fitting_chars(limit, steps), F.lit(0)).cast("int"))


def within_budget(table: DataFrame, limit: int) -> DataFrame:
    """``prefix_table``'s rows without their steps, with over_limit (more than ``limit`` tokens) and limit_chars
    (characters of the longest prefix that has at most so many)."""
    return table.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"),
                        F.when(F.col("n_tokens") > limit, fitting_chars(F.lit(limit))).otherwise(F.col("n_chars")).alias("limit_chars"))
