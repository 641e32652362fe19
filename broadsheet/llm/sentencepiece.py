"""SentencePiece encoding and decoding (byte-pair models) by a table of every prefix's last token.

Byte-pair merging has one encoding for each text, and every prefix of a text has a unique last token: the one whose
own start is a prefix with a last token that may stand before it. So the encoder goes through the matches that an
automaton of all pieces finds, takes for each end the match whose predecessor is compatible (merging the two strings
gives just the two tokens), and then reads the ids backwards from the end. The time is linear in the text.
"""

from __future__ import annotations

import heapq
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.common import map_batches, narrow

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class PieceTable:
    """A byte-pair model's pieces, the automaton over them, and the compatibility of pairs (a memo)."""

    def __init__(self, model: bytes, memo: int = 400_000):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto.FromString(model)
        spec, trainer = proto.normalizer_spec, proto.trainer_spec
        if trainer.model_type != trainer.BPE or spec.precompiled_charsmap or spec.remove_extra_whitespaces or trainer.treat_whitespace_as_suffix:
            raise ValueError("only byte-pair models whose text is not normalised are read")
        if any(p.type == USER_DEFINED for p in proto.pieces) or not trainer.byte_fallback:
            raise ValueError("only byte-pair models with byte fallback and without user-defined pieces are read")
        self.dummy_prefix, self.bos, self.eos = spec.add_dummy_prefix, trainer.bos_id, trainer.eos_id
        self.pieces = [p.piece for p in proto.pieces]
        self.types = [p.type for p in proto.pieces]
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (NORMAL, UNUSED)}
        self.scores = [p.score for p in proto.pieces]
        self.cost = {p: -self.scores[i] for p, i in self.ids.items()}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece spans words")
        self.letters = {p for p in self.ids if len(p) == 1}
        if any(not self.letters.issuperset(p) for p in self.ids):
            raise ValueError("a piece holds a character that is no piece")
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if piece == SPACE or SPACE * 2 not in piece:
                self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        self.compatible: dict[int, bool] = {}
        self.chunks: dict[str, bytes] = {}
        self.memo = memo
        #: bytes that each id decodes to, end to end, for the decoder
        text = [b"" if t in (CONTROL, UNKNOWN) else bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(SPACE, " ").encode()
                for p, t in zip(self.pieces, self.types, strict=True)]
        for i, t in enumerate(self.types):
            if t == UNKNOWN:
                text[i] = trainer.unk_surface.encode()
        self.flat = np.frombuffer(b"".join(text), np.uint8)
        self.lengths = np.array([len(x) for x in text], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.is_byte = np.array([t == BYTE for t in self.types])

    def merge(self, text: str) -> list[int]:
        """Merging by score, leftmost first among equals: what an encoding is by definition."""
        n = len(text)
        pieces, left, right = list(text), list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[float, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (t := self.ids.get(pieces[i] + pieces[j])) is not None:
                heapq.heappush(heap, (-self.scores[t], i, pieces[i] + pieces[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, piece = heapq.heappop(heap)
            j = right[i]
            if not pieces[i] or j < 0 or pieces[i] + pieces[j] != piece:
                continue
            pieces[i], pieces[j] = piece, ""
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [self.ids[p] for p in pieces if p]

    def fits(self, before: int, token: int) -> bool:
        """May ``token`` follow ``before`` (-1: the start)? True when merging their strings gives just them."""
        if before < 0:
            return self.merge_short(self.pieces[token]) == [self.pieces[token]]
        return self.merge_short(self.pieces[before] + self.pieces[token]) == [self.pieces[before], self.pieces[token]]

    def merge_short(self, text: str) -> list[str]:
        """``merge`` for strings of one or two pieces, where a plain search for the best pair is quickest."""
        parts, cost, none = list(text), self.cost.get, float("inf")
        costs = [cost(a + b, none) for a, b in zip(parts, parts[1:])]
        while costs and (best := min(costs)) != none:
            i = costs.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i:
                costs[i - 1] = cost(parts[i - 1] + parts[i], none)
            if i < len(costs):
                costs[i] = cost(parts[i] + parts[i + 1], none)
        return parts

    def known(self, chunk: str) -> list[int]:
        """Ids of a chunk of known characters, through the table of each prefix's last token."""
        if SPACE * 2 in chunk:  # pieces of spaces only share one score, so pairs of them do not decide
            return self.merge(chunk)
        n, memo = len(chunk), self.compatible
        last, lengths = [-1] * (n + 1), [0] * (n + 1)
        for end, (length, token) in self.automaton.iter(chunk):
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
                if len(memo) >= self.memo:
                    memo.clear()
                good = memo[pair] = self.fits(before, token)
            if good:
                last[end], lengths[end] = token, length
        ids = []
        while n > 0:
            ids.append(last[n])
            n -= lengths[n]
        ids.reverse()
        return ids

    def chunk(self, chunk: str) -> bytes:
        """Ids (32-bit, little-endian) of one chunk: spaces, then other characters. Unknown ones become bytes."""
        out: list[int] = []
        if self.letters.issuperset(chunk):
            out = self.known(chunk)
        else:
            start = 0
            for i, c in enumerate(chunk):
                if c not in self.letters:
                    if i > start:
                        out += self.known(chunk[start:i])
                    out += [self.bytes[b] for b in c.encode("utf-8", "replace")]
                    start = i + 1
            if start < len(chunk):
                out += self.known(chunk[start:])
        return np.array(out, "<u4").tobytes()

    def word(self, word: str) -> bytes:
        """Ids of a word with one space before it, remembered."""
        out = self.chunks.get(word)
        if out is None:
            out = self.chunk(SPACE + word)
            if len(word) <= 40:
                if len(self.chunks) >= self.memo:
                    self.chunks.clear()
                self.chunks[word] = out
        return out

    def encode(self, text: str, bos: bool = True, eos: bool = True) -> bytes:
        head, tail = (np.array([i] * on, "<u4").tobytes() for i, on in ((self.bos, bos), (self.eos, eos)))
        if not text:
            return head + tail
        if self.dummy_prefix and SPACE not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            return head + b"".join(map(self.word, text.split(" "))) + tail
        spaced = (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)
        return head + b"".join(map(self.chunk, _CHUNK.findall(spaced))) + tail

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 text of packed ids. The space that encoding puts first is taken away again."""
        i = np.frombuffer(ids, "<u4").astype(np.int64)
        lengths = self.lengths[i]
        total = int(lengths.sum())
        if not total:
            return b""
        shift = self.starts[i] - (np.cumsum(lengths) - lengths)
        out = self.flat[np.repeat(shift, lengths) + np.arange(total)].tobytes()
        first = i[np.argmax(lengths > 0)]
        if self.dummy_prefix and not self.is_byte[first] and out[:1] == b" ":
            out = out[1:]
        try:
            out.decode()
        except UnicodeDecodeError:
            out = _repaired(out)
        return out


def _repaired(data: bytes) -> bytes:
    """Each byte that starts no whole character becomes U+FFFD."""
    out, i = [], 0
    while i < len(data):
        for n in (1, 2, 3, 4):
            try:
                out.append(data[i:i + n].decode())
                i += n
                break
            except UnicodeDecodeError:
                pass
        else:
            out.append("�")
            i += 1
    return "".join(out).encode()


_TABLES: dict[int, PieceTable] = {}


def _table(model: bytes) -> PieceTable:
    """One table for each model and worker process."""
    key = hash(model)
    if key not in _TABLES:
        _TABLES[key] = PieceTable(model)
    return _TABLES[key]


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", bos: bool = True, eos: bool = True,
                  keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of ``docs``: doc_id, ids (binary: the ids as little-endian unsigned 32-bit integers),
    decoded (the text that these ids decode to), then the columns named in ``keep``.

    A narrow pass: no shuffle, memory for one chunk of texts and bounded memos. The model (under a megabyte) is read on
    the driver and travels with the task. Null and empty texts have only the begin and end ids and decode to the empty
    text; repeated rows and null ids stay as they are; an empty table gives none.
    """
    model = read_model(model_path)
    rows = narrow(docs, id_col, text_col, **{f"kept_{c}": docs[c] for c in keep})
    schema = "doc_id bigint, ids binary, decoded string" + "".join(f", kept_{c} {docs.schema[c].dataType.simpleString()}" for c in keep)

    def build():
        table = _table(model)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [table.encode(t, bos, eos) for t in batch.column(1).to_pylist()]
            text = [table.decode(x).decode() for x in ids]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(text, pa.string()), *batch.columns[2:]],
                                              names=["doc_id", "ids", "decoded", *[f"kept_{c}" for c in keep]])

        return work

    return map_batches(rows, build, schema).withColumnsRenamed({f"kept_{c}": c for c in keep})


def digests(coded: DataFrame) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of ``encode_decode``'s rows."""
    return coded.select("doc_id", (F.length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
