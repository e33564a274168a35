"""Byte-level BPE as a lazily determinised transducer, and streaming decoding.

A sequence of tokens is the encoding of its bytes exactly if every two neighbours are the encoding of
their own bytes. So the merges compile into a nondeterministic transducer: walk a token's bytes, emit it
where it may follow the token before. Determinised, a state is the set of tokens under way at a byte; its
moves name the tokens that end there. States and moves are built when a text first needs them. Exactly
one of the ending tokens may follow the one that ends where it starts, so a register of the last tokens
decides between them, and a token goes out once every token still under way agrees on it.
"""

from __future__ import annotations

import base64
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import FIRST, Chunked, Held, Remembered, by_batch, kept, lists, mapped


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    """Contents of a rank file: `base64 rank` per line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines())}


class Transducer:
    """Encoder of one piece of text; at most `most_states` states and `most_pairs` pairs are remembered."""

    def __init__(self, ranks: dict[bytes, int], most_states: int = 150_000, most_pairs: int = 500_000, step: int = 4096):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"{len(missing)} single bytes have no token")
        self.ranks, self.most_states, self.most_pairs, self.step = ranks, most_states, most_pairs, step
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self.grow: dict[int, int] = {}  # node * 256 + byte -> node of the byte tree
        self.end: dict[int, tuple[int, int]] = {}  # node -> token that ends there, its length
        self.inner = set()
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                self.inner.add(node)
                node = self.grow.setdefault(node << 8 | byte, len(self.grow) + 1)
            self.end[node] = (rank, len(token))
        self.pairs: dict[int, bool] = {}
        self.halves: dict[int, tuple | None] = {}
        self._restart()

    def _restart(self) -> None:
        self.states: list[tuple] = [()]
        self.numbers: dict[tuple, int] = {(): 0}
        self.moves: dict[int, tuple[int, tuple, int]] = {}  # state * 256 + byte -> move

    def _move(self, state: int, byte: int) -> tuple[int, tuple, int]:
        """Build one move: the tokens under way after this byte, longest first, and those that end.

        One of these must fit, so the shortest needs no test: it is taken if no longer one fits.
        """
        nodes = [self.grow[n << 8 | byte] for n in (*self.states[state], 0) if n << 8 | byte in self.grow]
        *ends, shortest = [self.end[n] for n in nodes if n in self.end]
        after = tuple(n for n in nodes if n in self.inner)
        kept = True
        if after not in self.numbers:
            if len(self.states) >= self.most_states:
                self._restart()
                kept = False
            self.numbers[after] = len(self.states)
            self.states.append(after)
        move = (self.numbers[after], tuple(ends), shortest[0])
        if kept:
            self.moves[state << 8 | byte] = move
        return move

    def merged(self, piece: bytes, until: int = 1) -> list[bytes]:
        """Plain merging, lowest rank first and then leftmost, until so many parts are left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > until:
            found = [(self.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.ranks]
            if not found:
                break
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def split(self, token: int) -> tuple | None:
        """The two tokens whose merge made this one; () for a byte, None if merging never makes it."""
        known = self.halves.get(token, 0)
        if known == 0:
            whole = self.tokens[token]
            parts = self.merged(whole, 2)
            if len(parts) == 1:
                known = ()
            elif len(parts) == 2 and self.merged(whole) == [whole]:
                known = (self.ranks[parts[0]], self.ranks[parts[1]])
            else:
                known = None
            self.halves[token] = known
        return known

    def _free(self, left: int, right: int) -> bool:
        """Do the merges inside both tokens come before every merge across their border?

        The two are taken apart again, the later merge first; each pair that touched at the border for a
        while must not merge before what really came next.
        """
        tokens, ranks, limit = self.tokens, self.ranks, None
        while True:
            across = ranks.get(tokens[left] + tokens[right])
            if across is not None and (limit is None or across < limit):
                return False
            a, b = self.split(left), self.split(right)
            if a is None or b is None:
                return False
            if not a and not b:
                return True
            if not a or b and right >= left:
                if max(b) >= right:
                    raise ArithmeticError
                limit, right = right + 1, b[0]  # of equal ranks, the merge across is the left one
            else:
                if max(a) >= left:
                    raise ArithmeticError
                limit, left = left, a[1]

    def follows(self, before: int, token: int) -> bool:
        """Is (before, token) the encoding of its own bytes? -1 stands before the first token."""
        if len(self.pairs) >= self.most_pairs:
            self.pairs.clear()
        if before < 0:
            known = self.split(token) is not None
        else:
            try:
                known = self._free(before, token)
            except ArithmeticError:  # a part with a higher rank than the whole: merge in full
                pair = [self.tokens[before], self.tokens[token]]
                known = self.merged(b"".join(pair)) == pair
        self.pairs[before << 20 | token] = known
        return known

    def _back(self, lasts: list[int], at: int) -> list[int]:
        """The tokens of the reading that is complete at a place, from the start of the register."""
        out = []
        while at > 0:
            out.append(lasts[at])
            at -= len(self.tokens[lasts[at]])
        return out[::-1]

    def _agreed(self, lasts: list[int]) -> int:
        """The last place that every reading still under way passes."""
        n, shared = len(lasts) - 1, None
        for at in range(max(0, n - self.longest), n + 1):
            places = {0}
            while at > 0:
                places.add(at)
                at -= len(self.tokens[lasts[at]])
            shared = places if shared is None else shared & places
        return max(shared)

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        pairs, follows = self.pairs, self.follows
        state, out, lasts, at = 0, [], [-1], 0  # lasts[i]: the token that ends at place i
        for byte in piece:
            state, ends, found = self.moves.get(state << 8 | byte) or self._move(state, byte)
            at += 1
            for token, length in ends:
                before = lasts[at - length]
                known = pairs.get(before << 20 | token)
                if known or known is None and follows(before, token):
                    found = token
                    break
            lasts.append(found)
            if at >= self.step and (agreed := self._agreed(lasts)) > 0:
                out += self._back(lasts, agreed)
                lasts = lasts[agreed:]
                at -= agreed
        return out + self._back(lasts, at)


class Encoder:
    """Whole texts: pieces by the pattern; ids of pieces and of ` word` chunks are remembered, bounded."""

    def __init__(self, raw: bytes, pattern: str, most: int = 500_000):
        self.transducer = Transducer(parse_ranks(raw))
        self.pattern = regex.compile(pattern)
        self.pieces = Remembered(lambda x: array("I", self.transducer.encode(x.encode())).tobytes(), most // 4)
        self.chunks = Chunked(self._chunks, self.plain, most, odd=FIRST)

    def plain(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))

    def _chunks(self, new: list[str], known: dict) -> None:
        """Ids of ` word`, which no neighbour can change, and of a first word; None if white space touches their ends."""
        for word in new:
            first = word[:1] == FIRST
            inner = word[1:] if first else word
            free = bool(inner) and not inner[0].isspace() and not inner[-1].isspace()
            known[word] = self.plain(inner if first else " " + word) if free else None

    def encode(self, texts: pa.Array) -> list[bytes]:
        """32-bit ids of each text."""
        return self.chunks.encode(texts)


class Utf8Stream:
    """Text out of bytes that arrive in any cut.

    States of the machine: 0 between characters, else the number of bytes that the character under way still
    needs. Whole characters go out, the bytes of an unfinished one wait.
    """

    # bytes that follow a lead byte; bytes that can't lead or that stand for themselves have none
    FOLLOW = bytes(1 if 0xC2 <= b < 0xE0 else 2 if 0xE0 <= b < 0xF0 else 3 if 0xF0 <= b < 0xF5 else 0 for b in range(256))

    def __init__(self):
        self.state, self.waiting = 0, b""

    def feed(self, data: bytes) -> str:
        data = self.waiting + data
        end, self.state = len(data), 0
        # the state at the end depends on the last three bytes alone: a character has at most four
        for at in range(max(0, end - 3), end):
            byte = data[at]
            if self.state and 0x80 <= byte < 0xC0:
                self.state -= 1
            else:
                self.state, start = self.FOLLOW[byte], at
        self.waiting = data[start:] if self.state else b""
        return data[: end - len(self.waiting)].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.waiting, self.state = self.waiting, b"", 0
        return rest.decode("utf-8", "replace")


def encoder(held: Held, pattern: str) -> Encoder:
    return kept("encoder", (held, pattern), lambda: Encoder(held.raw, pattern))


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, tokens array<int>) per row. Null text is empty and has no tokens; an empty table stays empty.

    Rows are independent, so repeated rows are encoded each; other columns are ignored. The rank file is
    read once by the driver and travels with the task.
    """
    held = Held.read(ranks_path)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = encoder(held, pattern)
        made = own.encode(batch.column(1))
        flat = np.frombuffer(b"".join(made), np.int32)
        counts = np.array([len(x) // 4 for x in made], np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), lists(flat, counts)], [id_column, "tokens"])

    kind = docs.schema[id_column].dataType.simpleString()
    chosen = docs.select(id_column, F.coalesce(F.col(text), F.lit("")).alias(text))
    return chosen.transform(mapped, by_batch(run), f"`{id_column}` {kind}, tokens array<int>")


def decode(encoded: DataFrame, ranks_path: str, step: int = 4096) -> DataFrame:
    """`encoded` (any columns, `tokens array<int>` among them) with a column `decoded string`.

    Null tokens decode to an empty text. Ids go through the byte table `step` at a time and through the
    UTF-8 machine, so a character whose bytes lie in two steps comes out whole; bytes that are no UTF-8
    become U+FFFD.
    """
    held = Held.read(ranks_path)

    def run(batches):
        ranks = parse_ranks(held.raw)
        table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        for batch in batches:
            made = []
            for ids in batch.column("tokens"):
                values = ids.values.to_numpy(zero_copy_only=False) if ids.is_valid else np.zeros(0, np.int32)
                stream = Utf8Stream()
                parts = [
                    stream.feed(b"".join(map(table.__getitem__, values[i : i + step].tolist())))
                    for i in range(0, len(values), step)
                ]
                made.append("".join(parts) + stream.close())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], [*batch.schema.names, "decoded"])

    kinds = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in encoded.schema)
    return encoded.transform(mapped, run, f"{kinds}, decoded string")
