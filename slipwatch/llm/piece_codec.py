"""SentencePiece encoding through the table of each prefix's last token.

In byte-pair encodings the last token of every prefix of a text is unique. An automaton
finds all pieces that end at a position; the one whose encoding stays in place beside the
last token before it is that prefix's last token. The ids are then read backwards. The
compatibility of two tokens depends on the two alone and is kept in a bounded table.

No piece holds a space mark after another character, and some characters occur in no longer
piece, so no merge crosses such a place: texts are cut there into chunks, which are encoded
once per worker while a bounded memory of chunks has room.

Defined results: null text counts as empty; an empty text encodes to the begin and end ids;
characters outside the vocabulary become byte tokens.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slipwatch.llm.common import give_back

MARK = "▁"
REMEMBER = 1_000_000  # chunks a worker remembers, about 230 MB, and four times as many token pairs
LONG_CHUNK = 64  # longer chunks are encoded anew each time


class PieceTable:
    """Encoder over the pieces of one model file; one per Python worker."""

    def __init__(self, model_file: str, remember: int = REMEMBER) -> None:
        self.room, self.pair_room = remember, 4 * remember
        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        sp = self.library
        self.begin, self.end, self.unknown = sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.first, self.last = struct.pack("<I", self.begin), struct.pack("<I", self.end)
        n = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(n)]
        self.ids = {sp.id_to_piece(i): i for i in range(n) if not special[i]}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces with a space mark inside are not supported")
        # Line ends and tabs that are part of no longer piece stand alone.
        alone = "".join(c for c in "\n\t\r" if not any(c in p and len(p) > 1 for p in self.ids))
        own = f"|[{re.escape(alone)}]" if alone else ""
        self.cut = re.compile(f"{MARK}*[^{MARK}{re.escape(alone)}]+|{MARK}+{own}")
        self.piece = {i: p for p, i in self.ids.items()}
        # Equal scores share a rank; characters exist before any merge.
        order = {s: r for r, s in enumerate(sorted(set(self.score.values()), reverse=True))}
        self.rank = {p: order[s] if len(p) > 1 else -1 for p, s in self.score.items()}
        self.halves: dict[str, tuple[str, str]] = {}
        self.automaton = ahocorasick.Automaton()
        # A piece whose own encoding is not itself can never come out of merges.
        for p, i in self.ids.items():
            last = [("", "")]
            if self._merged(p, last) == [p]:
                self.automaton.add_word(p, (len(p), i))
                if len(p) > 1:
                    self.halves[p] = last[0]
        self.automaton.make_automaton()
        # Undoing merges by rank is right only where both halves are made before the whole.
        self.irregular: set[str] = set()
        for p in sorted(self.halves, key=len):
            a, b = self.halves[p]
            if max(self.rank[a], self.rank[b]) >= self.rank[p] or a in self.irregular or b in self.irregular:
                self.irregular.add(p)
        spoken = {i: p.replace(MARK, " ") for i, p in self.piece.items()}
        spoken |= {i: chr(b) for b, i in enumerate(self.bytes) if b < 128} | {self.begin: "", self.end: ""}
        self.spoken = spoken
        self.pairs: dict[int, bool] = {}
        self.chunks: dict[str, bytes] = {}

    def _merged(self, text: str, last: list[tuple[str, str]] | None = None) -> list[str]:
        """Symbols after all merges by score, the leftmost first among equals; `last` gets the last merge."""
        score, parts = self.score, list(text)
        after = [*range(1, len(parts)), -1]
        before = list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (s := score.get(both := parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-s, i, both))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            if not parts[i] or (j := after[i]) < 0 or parts[i] + parts[j] != both:
                continue
            if last is not None:
                last[0] = parts[i], parts[j]
            parts[i], parts[j], after[i] = both, "", after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the encoding of both tokens' text is the two tokens.

        Undoes the merges of both, the latest first; the tokens clash if the symbols that
        meet at the border could have merged before the merge just undone.
        """
        a, b = self.piece[left], self.piece[right]
        if a in self.irregular or b in self.irregular:
            return self._merged(a + b) == [a, b]
        rank, halves, limit = self.rank, self.halves, len(self.rank)
        while True:
            if rank.get(a + b, limit) < limit:
                return False
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:  # the left merge goes first among equals, so the right one is undone first
                limit, a = ra, halves[a][1]
            else:
                limit, b = rb + 1, halves[b][0]

    def chunk_ids(self, chunk: str) -> bytes:
        """Ids of a chunk as little-endian unsigned integers.

        `last` and `size` hold the last token of the prefix that ends at each character
        (-1: a character that no piece holds); the ids follow from the end backwards.
        """
        n = len(chunk)
        last, size, pairs = [-1] * n, [0] * n, self.pairs
        known = pairs.get
        for end, (length, token) in self.automaton.iter(chunk):
            if size[end]:
                continue
            start = end - length
            if start < 0 or last[start] < 0:
                last[end], size[end] = token, length
                continue
            key = last[start] << 32 | token
            ok = known(key)
            if ok is None:
                ok = self.compatible(last[start], token)
                if len(pairs) < self.pair_room:
                    pairs[key] = ok
            if ok:
                last[end], size[end] = token, length
        ids, at = [], n - 1
        while at >= 0:
            if size[at]:
                ids.append(last[at])
                at -= size[at]
            else:
                ids += [self.bytes[b] for b in reversed(chunk[at].encode("utf-8"))]
                at -= 1
        ids.reverse()
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text with begin and end ids, as little-endian unsigned integers."""
        chunks = self.chunks
        cut = self.cut.findall(MARK + text.replace(" ", MARK)) if text else []
        out = [self.first, *map(chunks.get, cut), self.last]
        if None in out:
            for k, chunk in enumerate(cut, 1):
                if out[k] is None:
                    ids = chunks.get(chunk) or self.chunk_ids(chunk)
                    # Frequent chunks come early, so what is remembered stays.
                    if len(chunk) <= LONG_CHUNK and len(chunks) < self.room:
                        chunks[chunk] = ids
                    out[k] = ids
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of the ids; the library joins byte tokens beyond ASCII into characters."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        try:
            return "".join([self.spoken[i] for i in numbers]).removeprefix(" ")
        except KeyError:
            return self.library.decode(numbers)


@lru_cache(maxsize=2)
def table(model_file: str, remember: int = REMEMBER) -> PieceTable:
    return PieceTable(model_file, remember)


def encode_pieces(docs: DataFrame, model_file: str, text: str = "text", out: str = "piece_ids") -> DataFrame:
    """Adds `out`: the ids of each whole text as binary (little-endian unsigned 32-bit); other columns stay.

    `model_file` must be readable under the same path on every executor.
    """

    @F.pandas_udf("binary")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = table(model_file)
        for texts in parts:
            yield pd.Series([codec.encode(t) for t in texts.fillna("")], dtype=object)

    return docs.withColumn(out, run(F.col(f"`{text}`")))


def decode_pieces(docs: DataFrame, model_file: str, ids: str = "piece_ids", out: str = "decoded") -> DataFrame:
    """Adds `out`: the text of binary ids, as the library decodes them; null ids give null."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = table(model_file)
        for rows in parts:
            yield pd.Series([None if x is None else codec.decode(x) for x in rows], dtype=object)

    return docs.withColumn(out, run(F.col(f"`{ids}`")))


def round_trip(
    docs: DataFrame, model_file: str, text: str = "text", keep_ids: bool = False, remember: int = REMEMBER, keep_table: bool = True
) -> DataFrame:
    """Adds n_tokens, ids_sha256 and decoded_sha256: encoding and decoding in one pass over each text.

    With `keep_ids` the ids come too, as binary column piece_ids; the decoded text stays in
    the worker either way. A worker keeps the table and up to `remember` chunks, also after
    this job; without `keep_table` it drops them at the end of each task.
    """
    made = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", piece_ids binary" * keep_ids
    names = [x.split()[0] for x in made.split(", ")]

    @F.pandas_udf(made)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = table(model_file, remember) if keep_table else PieceTable(model_file, remember)
        for texts in parts:
            rows = []
            for t in texts.fillna(""):
                ids = codec.encode(t)
                back = codec.decode(ids).encode("utf-8")
                row = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest(), ids)
                rows.append(row[: len(names)])
            yield pd.DataFrame(rows, columns=names)
        if not keep_table:
            del codec
            give_back()

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    return docs.select(*kept, run(F.col(f"`{text}`")).alias("_trip")).select(*kept, "_trip.*")
