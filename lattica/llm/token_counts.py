"""Token counts by a compiled finite-state transducer.

The tokenizer file (pre-tokenizer pattern, byte alphabet, ranked merges, word ends) is
compiled into a deterministic transducer over the bytes of a piece. After a prefix, merging
is decided by the last token of each of the prefix's recent ends, as two neighbours stand in
a byte-pair encoding exactly if the encoding of their concatenation is the two. A state is
that window, cut to the longest suffix that still begins a token; a transition carries by how
much the token count changes (it may fall, when a byte completes a merge), and a closing
transition does so for a byte that ends its piece. States are determinised when first
visited, and whole runs of short pieces are remembered in a bounded table.

The pre-tokenizer is a machine over characters (`Walk`): its states are what kind of piece is open
(letters, others, a quote that may begin a contraction), the transducer's state in that piece and
the byte that waits to know whether it is the last. Its transitions carry counts too.

A long text is cut into chunks. White space and digits send the machine to its start state whatever
state it was in. So a chunk's state map is: up to its first such character it has to be walked from
the entry state, once that is known; from there on count and exit state are constants. Two maps
compose by walking the second's beginning from the first's exit state; if the first has no constant
part, beginnings are laid end to end. That is associative, and done as a prefix scan over pairs.

Null and empty texts have no tokens. Special strings inside a text count one token each, as
the library has it by default. Rows with equal or null ids are counted each on their own;
columns other than doc_id and text aren't read. Counting needs no shuffle.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T

LIMIT = 2048
#: Characters in a chunk, and pieces and states that a worker remembers at most.
CHUNK = 1 << 16
MEMO = 400_000
MOST_STATES = 300_000
#: White space as the tokenizer's pattern language has it.
SPACE = "\t-\r \x85\xa0  -     　"


def _byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """Counts the tokens of pieces. End-of-piece bytes are symbols of their own (256 + byte)."""

    def __init__(self, merges: list[tuple[str, str]], suffix: str):
        letters = _byte_letters()

        def symbols(s: str) -> tuple[int, ...]:
            closed = bool(suffix) and s.endswith(suffix)
            out = [letters[c] for c in (s[: -len(suffix)] if closed else s)]
            if closed:
                out[-1] += 256
            return tuple(out)

        self.rank: dict[tuple, int] = {}
        self.tokens = {(i,) for i in range(512)}
        for i, (a, b) in enumerate(merges):
            a, b = symbols(a), symbols(b)
            self.rank.setdefault((a, b), i)
            self.tokens.add(a + b)
        self.prefixes = {t[:k] for t in self.tokens for k in range(len(t))}
        self.pairs: dict[tuple, bool] = {}
        self.reset()

    def reset(self) -> None:
        start = ((), (None,), (0,))
        self.states, self.number = [start], {start: 0}
        self.step: dict[int, tuple[int, int]] = {}

    def encode(self, s: tuple) -> list[tuple]:
        """The encoding by its definition; only ever run on two tokens laid end to end."""
        parts = [(x,) for x in s]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            pair = parts[best], parts[best + 1]
            if pair not in self.rank:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(pair[0] + pair[1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def together(self, a: tuple, b: tuple) -> bool:
        key = a, b
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) > 4 * MOST_STATES:
                self.pairs.clear()
            known = self.pairs[key] = self.encode(a + b) == [a, b]
        return known

    def grow(self, state: int, symbol: int) -> tuple[int, int]:
        """A transition: (next state, change of the token count)."""
        text, last, count = self.states[state]
        text += (symbol,)
        for k in range(len(text)):  # the only token that ends here and follows its predecessor
            token = text[k:]
            if token in self.tokens and (last[k] is None and self.whole(token) or last[k] is not None and self.together(last[k], token)):
                break
        else:
            raise AssertionError("no token ends here")
        change = count[k] + 1
        if symbol >= 256:
            return 0, change
        last, count = (*last, token), (*(c - change for c in count), 0)
        cut = 0
        while text[cut:] not in self.prefixes:
            cut += 1
        key = text[cut:], last[cut:], count[cut:]
        if (to := self.number.get(key)) is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
        return to, change

    @lru_cache(maxsize=100_000)  # noqa: B019  one machine a worker
    def whole(self, token: tuple) -> bool:
        return self.encode(token) == [token]

    def move(self, state: int, symbol: int) -> tuple[int, int]:
        """(next state, change of the count) by a symbol."""
        key = state * 512 + symbol
        if (arc := self.step.get(key)) is None:
            arc = self.step[key] = self.grow(state, symbol)
        return arc

    def count(self, piece: bytes) -> int:
        if len(self.states) > MOST_STATES:
            self.reset()
        state, total, step = 0, 0, self.step
        end = len(piece) - 1
        for i, b in enumerate(piece):
            key = state * 512 + (b if i < end else b + 256)
            if (arc := step.get(key)) is None:
                arc = step[key] = self.grow(state, key % 512)
            state = arc[0]
            total += arc[1]
        return total


#: Open pieces: none, letters, others, a quote, and a quote with the first letter of 're, 've, 'll.
NONE, LETTERS, OTHERS, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L = range(7)
_SECOND = {"r": QUOTE_R, "v": QUOTE_V, "l": QUOTE_L}
_THIRD = {QUOTE_R: ("r", "e"), QUOTE_V: ("v", "e"), QUOTE_L: ("l", "l")}


class Walk:
    """The pre-tokenizer over characters, with the transducer inside a piece. A state is (open piece,
    state of the transducer as its window of last tokens, waiting byte or -1)."""

    def __init__(self, machine: Transducer, space: str):
        self.machine, self.space = machine, set(space)
        self.start = (NONE, machine.states[0], -1)
        self.kinds: dict[str, int] = {}

    def kind(self, c: str) -> int:
        """0 white space, 1 a letter, 2 a digit, 3 another character."""
        k = self.kinds.get(c)
        if k is None:
            k = 0 if c in self.space else 1 if regex.match(r"\p{L}", c) else 2 if regex.match(r"\p{N}", c) else 3
            if len(self.kinds) < 100_000:
                self.kinds[c] = k
        return k

    def _feed(self, window: tuple, waiting: int, data: bytes) -> tuple[tuple, int, int]:
        """More bytes of an open piece: (window, waiting byte, count)."""
        m, total = self.machine, 0
        for b in data:
            if waiting >= 0:
                if len(m.states) > MOST_STATES:
                    m.reset()
                if (state := m.number.get(window)) is None:
                    state = m.number[window] = len(m.states)
                    m.states.append(window)
                state, change = m.move(state, waiting)
                window, total = m.states[state], total + change
            waiting = b
        return window, waiting, total

    def close(self, state: tuple) -> int:
        """The change of the count when the open piece ends here."""
        mode, window, waiting = state
        if mode in _THIRD:  # the quote was a piece, and a letter after it is one
            return self.machine.count(b"'") + self.machine.count(_THIRD[mode][0].encode())
        if waiting < 0:
            return 0
        m = self.machine
        if (number := m.number.get(window)) is None:
            number = m.number[window] = len(m.states)
            m.states.append(window)
        return m.move(number, waiting + 256)[1]

    def run(self, state: tuple, text: str) -> tuple[tuple, int]:
        """(state after the text, change of the count)."""
        m, first, total = self.machine, self.start[1], 0
        mode, window, waiting = state
        for c in text:
            k = self.kind(c)
            if mode in _THIRD:
                letter, last = _THIRD[mode]
                if c == last:
                    total += m.count(f"'{letter}{last}".encode())
                    mode, window, waiting = self.start
                    continue
                total += m.count(b"'")
                mode, (window, waiting, more) = LETTERS, self._feed(first, -1, letter.encode())
                total += more
            elif mode == QUOTE:
                if c in "stmd":
                    total += m.count(f"'{c}".encode())
                    mode, window, waiting = self.start
                    continue
                if c in _SECOND:
                    mode, window, waiting = _SECOND[c], first, -1
                    continue
                mode = OTHERS
            if (mode == LETTERS and k == 1) or (mode == OTHERS and k == 3):
                window, waiting, more = self._feed(window, waiting, c.encode())
                total += more
                continue
            total += self.close((mode, window, waiting))
            mode, window, waiting = self.start
            if k == 2:
                total += m.count(c.encode())
            elif k:
                mode = LETTERS if k == 1 else QUOTE if c == "'" else OTHERS
                window, waiting, more = self._feed(first, -1, c.encode())
                total += more
        return (mode, window, waiting), total


class Counter:
    """Counts the tokens of texts as the tokenizer file's library does."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.machine = Transducer(merges, model["end_of_word_suffix"] or "")
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern = split["pattern"]["Regex"].replace(r"[^\s", f"[^{SPACE}")
        self.pieces = regex.compile(pattern, regex.V0).findall
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]))
        self.walk = Walk(self.machine, SPACE.replace("\t-\r", "\t\n\x0b\x0c\r").replace("\u2000-\u200a", "".join(map(chr, range(0x2000, 0x200B)))))
        self.reset = regex.compile(rf"[{SPACE}]|\p{{N}}")
        self.memo: dict[str, int] = {}

    def plain(self, text: str) -> int:
        """Tokens of normalised text that starts and ends at piece borders."""
        memo, found = self.memo, self.pieces(text)
        try:
            return sum(map(memo.__getitem__, found))
        except KeyError:
            pass
        if len(memo) > MEMO:
            memo.clear()
        total = 0
        for p in found:
            n = memo.get(p)
            if n is None:
                n = self.machine.count(p.encode())
                if len(p) <= 32:
                    memo[p] = n
            total += n
        return total

    def chunk_map(self, chunk: str) -> tuple[list[str], int | None, tuple | None]:
        """(beginning, count, exit state): the beginning reaches to the first character that resets the
        machine and has to be walked from the entry state; count and exit state are None if the
        whole chunk is beginning."""
        first = self.reset.search(chunk)
        if first is None:
            return [chunk], None, None
        begin, last = first.end(), first.end()
        for c in reversed(range(begin, len(chunk))):
            if self.walk.kind(chunk[c]) in (0, 2):
                last = c + 1
                break
        state, tail = self.walk.run(self.walk.start, chunk[last:])
        return [chunk[:begin]], self.plain(chunk[begin:last]) + tail, state

    def compose(self, a, b):
        if a[2] is None:
            return a[0] + b[0], b[1], b[2]
        state, total = a[2], a[1]
        for part in b[0]:
            state, more = self.walk.run(state, part)
            total += more
        return (a[0], total, state) if b[2] is None else (a[0], total + b[1], b[2])

    def normalise(self, text: str) -> str:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)

    def run(self, text: str) -> int:
        text = self.normalise(text)
        if len(text) <= CHUNK:
            return self.plain(text)
        maps = [([], 0, self.walk.start), *(self.chunk_map(text[i : i + CHUNK]) for i in range(0, len(text), CHUNK))]
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0][1] + self.walk.close(maps[0][2])

    def count(self, text: str) -> int:
        if "<|" not in text:
            return self.run(text)
        at = total = 0
        for m in self.special.finditer(text):
            total += self.run(text[at : m.start()]) + 1
            at = m.end()
        return total + self.run(text[at:])


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row; `path` names the tokenizer file,
    which every executor has."""

    def run(batches):
        own = counter(path)
        for batch in batches:
            texts = batch.column(1).fill_null("")
            data, offsets = T.text_buffers(texts)
            n = np.array([own.count(t) for t in texts.to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    T.small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(T.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
