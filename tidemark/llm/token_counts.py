"""Token counts by a compiled finite-state transducer, without making the tokens.

For a vocabulary whose merges are properly ordered, the tokens of a string are the only sequence in which each adjacent
pair encodes to itself, and the tokens of a prefix end in one determined token.  So what a word's beginning leaves for
its future is finite: the longest suffix that begins some token, and, for each place in it, the last token that ends
there and how many tokens there were.  These are the states of a deterministic transducer; each transition carries the
change of the number of tokens.  States and transitions are compiled when they are first needed and kept in arrays.
Word splitting (letters, single numbers, other characters, contractions) is part of the same transducer.

Texts are laid out in chunks of equal length, which are run together, one character of every chunk at a time.  White
space, numbers and any change between letters and signs (but for a letter after a quote) reset the transducer, so a
chunk's state map is constant but for the run before the first of them.  The maps are composed by a prefix scan (a constant
map absorbs what stands left of it); then the beginnings run again from the states that the scan gives them, and chunks
without a reset (letters after quotes alone) in rounds, each from its left neighbour's end.  A run of LONG letters or signs
is a word of its own and meets ever new states, so it goes through the transducer's core alone, whose states are not kept;
a table of them would grow with the run.

Defined results: a null text is empty and has no tokens; equal texts have equal counts, and repeated rows are all kept;
special strings inside texts count one each, as the library does by default; an empty table gives no rows; other columns
are kept, whatever their names; a text of any length is one row of one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import word_bpe
from tidemark.llm.common import blocks, table
from tidemark.sources.shipping import ship

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Characters in a chunk, and cells of the transition table beyond which a worker compiles anew.
CHUNK, MOST_CELLS = 1024, 24_000_000
#: Bytes of text in a block.
BLOCK = 4 << 20
#: Letters or signs in a row that are not laid out, and pairs of tokens whose fit is kept.
LONG, MOST_FITS = 512, 1_000_000
#: States that every table has: before the first reset of a chunk (at its start, after a letter, after a sign, after a
#: quote), and between words.
WAITING, BETWEEN, AFTER_LETTER, AFTER_SIGN, AFTER_QUOTE = range(5)

_SPACE, _LETTER, _NUMBER, _OTHER = range(4)


class WordStates:
    """Core of the transducer: the beginning of a word as a state, one byte as a step.

    A state is (suffix, ends): ``ends[i]`` is (last token before suffix[i:], or -1 at the word's start; number of
    tokens there, less the number here).
    """

    EMPTY = (b"", ((-1, 0),))

    def __init__(self, bpe: word_bpe.WordBpe):
        self.bpe = bpe
        self.inner: dict[bytes, int] = {}
        self.last: dict[bytes, int] = {}
        for at, token in enumerate(bpe.tokens):
            if token and token not in bpe.specials:
                ends = token.endswith(word_bpe.WORD_END)
                data = bytes(map(bpe.bytes_of.__getitem__, token.removesuffix(word_bpe.WORD_END) if ends else token))
                (self.last if ends else self.inner)[data] = at
        self.begins = {data[:n] for found in (self.inner, self.last) for data in found for n in range(len(data))}
        self.parts = {new: (a, b) for a, b, new in bpe.merges}
        self.made = {new: r for r, (_, _, new) in enumerate(bpe.merges)}
        self.never = len(bpe.merges)
        self._fits: dict[int, bool] = {}
        self._edges: dict[tuple[int, int], tuple[list[int], list[int]]] = {}
        self._sound: dict[int, bool] = {}
        self.clear()

    def clear(self) -> None:
        self._steps: dict = {}
        self._finishes: dict = {}

    def _edge(self, token: int, side: int) -> tuple[list[int], list[int]]:
        """Parts of a token at one of its ends, from the byte up, and the rank at which each is merged away."""
        key = (token, side)
        if (known := self._edges.get(key)) is None:
            parts, gone = [token], [self.never]
            while (made := self.parts.get(parts[-1])) is not None:
                gone.append(self.made[parts[-1]])
                parts.append(made[side])
            known = self._edges[key] = parts[::-1], gone[::-1]
        return known

    def sound(self, token: int) -> bool:
        """Whether the token's own string encodes to it."""
        if (known := self._sound.get(token)) is None:
            parts = self.parts.get(token)
            known = self._sound[token] = parts is None or (self.sound(parts[0]) and self.sound(parts[1]) and self._apart(*parts, self.made[token]))
        return known

    def _apart(self, left: int, right: int, until: int) -> bool:
        """Whether no merge before rank ``until`` joins what stands on either side of the border of two sound tokens."""
        parts, gone = self._edge(left, 1)
        others, lost = self._edge(right, 0)
        rank, size = self.bpe.rank, self.bpe.size
        i = j = 0
        while True:
            # At equal ranks the left pair is merged first.
            now = rank.get(parts[i] * size + others[j], self.never)
            if now < until and now < gone[i] and now <= lost[j]:
                return False
            if gone[i] <= lost[j]:
                if gone[i] >= until:
                    return True
                i += 1
            else:
                if lost[j] >= until:
                    return True
                j += 1

    def fits(self, left: int, token: int) -> bool:
        """Whether the string of both (of ``token`` alone, if ``left`` is -1) encodes to just these; ``left`` is sound."""
        key = (left + 1) * self.bpe.size + token
        if (known := self._fits.get(key)) is None:
            if len(self._fits) >= MOST_FITS:
                self._fits.clear()
            known = self._fits[key] = self.sound(token) and (left < 0 or self._apart(left, token, self.never))
        return known

    def count(self, data: bytes) -> int:
        """The number of tokens of a whole word, states of which are dropped as soon as they are passed."""
        inner, begins, fits = self.inner, self.begins, self.fits
        first, before, counts = 0, [-1], [0]  # of the places from ``first`` on: the token that ends there, tokens up to it
        for end in range(1, len(data) + 1):
            tokens = inner if end < len(data) else self.last
            for at in range(len(before)):
                if (token := tokens.get(data[first + at : end])) is not None and fits(before[at], token):
                    break
            else:
                raise AssertionError("every byte is a token")
            before.append(token)
            counts.append(counts[at] + 1)
            passed = 0
            while data[first + passed : end] not in begins:
                passed += 1
            if passed:
                del before[:passed], counts[:passed]
                first += passed
        return counts[-1]

    def _ending(self, state, data: bytes, tokens: dict[bytes, int]) -> tuple[int, int]:
        """The last token when ``data`` (suffix and a byte more) ends in one of ``tokens``, and the change of the count."""
        for at, (left, count) in enumerate(state[1]):
            if at < len(data) and (token := tokens.get(data[at:])) is not None and self.fits(left, token):
                return token, count + 1
        raise AssertionError("every byte is a token")

    def step(self, state, byte: int):
        if (known := self._steps.get((state, byte))) is None:
            data = state[0] + bytes([byte])
            token, more = self._ending(state, data, self.inner)
            ends = (*((left, count - more) for left, count in state[1]), (token, 0))
            at = next(i for i in range(len(data) + 1) if data[i:] in self.begins)
            known = self._steps[state, byte] = (data[at:], ends[at:]), more
        return known

    def push(self, state, data: bytes):
        total = 0
        for byte in data:
            state, more = self.step(state, byte)
            total += more
        return state, total

    def finish(self, state, data: bytes) -> int:
        """The change of the count when the word ends with the character ``data``."""
        if (known := self._finishes.get((state, data))) is None:
            core, total = self.push(state, data[:-1])
            known = self._finishes[state, data] = total + self._ending(core, core[0] + data[-1:], self.last)[1]
        return known


class Transducer:
    """States: the five above, ("w", class, core, pending character) in a word, and ("'", ...) after a leading quote."""

    def __init__(self, path: str):
        self.bpe = word_bpe.load(path)
        self.words = WordStates(self.bpe)
        #: Of each code point; 0: none yet.  White space has one column, and so have numbers of equal count.
        self.column = np.zeros(0x110000, np.int32)
        self.shared: dict = {}
        self.chars: list[str] = [""]
        self.kinds: list[int] = [_SPACE]
        self.width = 64
        self._clear()

    def _clear(self) -> None:
        self.words.clear()
        self.states: list = [WAITING, BETWEEN, AFTER_LETTER, AFTER_SIGN, AFTER_QUOTE]
        self.number: dict = {state: state for state in self.states}
        self._grow(1 << 14, self.width)

    def _grow(self, rows: int, width: int) -> None:
        """``goes`` has the next state plus 1 (0: not compiled), ``adds`` the tokens."""
        goes, adds = np.zeros((rows, width), np.int32), np.zeros((rows, width), np.int16)
        if hasattr(self, "goes") and len(self.states) > 5:
            n, m = min(rows, self.goes.shape[0]), self.goes.shape[1]
            goes[:n, :m], adds[:n, :m] = self.goes[:n], self.adds[:n]
        self.goes, self.adds, self.width = goes, adds, width

    def _kind(self, char: str) -> int:
        if ord(char) < 256:
            for kind, members in ((_LETTER, word_bpe.LETTERS), (_NUMBER, word_bpe.NUMBERS), (_SPACE, word_bpe.SPACES)):
                if _in(char, members):
                    return kind
            return _OTHER
        two = [piece for piece, _ in self.bpe.library.pre_tokenizer.pre_tokenize_str(char + char)]  # how the library itself takes it
        return _SPACE if not two else _NUMBER if len(two) == 2 else _LETTER if len(self.bpe.library.pre_tokenizer.pre_tokenize_str("a" + char)) == 1 else _OTHER

    def columns(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        found = self.column[codes]
        if not found.all():
            for code in np.unique(codes[found == 0]):
                char, kind = chr(code), self._kind(chr(code))
                like = kind if kind == _SPACE else (kind, self._begin(char, kind)) if kind == _NUMBER else char
                if like not in self.shared:
                    self.shared[like] = len(self.chars)
                    self.chars.append(char)
                    self.kinds.append(kind)
                self.column[code] = self.shared[like]
            if len(self.chars) > self.width:
                self._grow(self.goes.shape[0], len(self.chars) + 32)
            found = self.column[codes]
        return found

    def _begin(self, char: str, kind: int):
        if kind == _SPACE:
            return BETWEEN, 0
        if kind == _NUMBER:
            return BETWEEN, self.words.finish(WordStates.EMPTY, char.encode())
        if char == "'":
            return ("'", ""), 0
        return ("w", kind, WordStates.EMPTY, char), 0

    def _compile(self, state, char: str, kind: int):
        if state == BETWEEN or (state == AFTER_LETTER and kind == _OTHER) or (state == AFTER_SIGN and kind == _LETTER):
            return self._begin(char, kind)
        if state in (WAITING, AFTER_LETTER, AFTER_SIGN, AFTER_QUOTE):
            return (BETWEEN if kind in (_SPACE, _NUMBER) else AFTER_LETTER if kind == _LETTER else AFTER_QUOTE if char == "'" else AFTER_SIGN), 0
        words = self.words
        if state[0] == "'":
            said = "'" + state[1] + char
            if said in word_bpe.CONTRACTIONS:
                core, more = words.push(WordStates.EMPTY, said[:-1].encode())
                return BETWEEN, more + words.finish(core, said[-1].encode())
            if not state[1] and any(x.startswith(said) for x in word_bpe.CONTRACTIONS):
                return ("'", char), 0
            if not state[1] and kind == _OTHER:
                core, more = words.push(WordStates.EMPTY, b"'")
                return ("w", _OTHER, core, char), more
            quote = words.finish(WordStates.EMPTY, b"'")  # a word of its own; what follows it begins anew
            after = ("w", _LETTER, WordStates.EMPTY, state[1]) if state[1] else BETWEEN
            to, more = self._compile(after, char, kind)
            return to, quote + more
        _, own, core, pending = state
        if kind == own:
            core, more = words.push(core, pending.encode("utf-8", "surrogatepass"))
            return ("w", own, core, char), more
        done = words.finish(core, pending.encode("utf-8", "surrogatepass"))
        to, more = self._begin(char, kind)
        return to, done + more

    def _fill(self, state: np.ndarray, column: np.ndarray) -> None:
        for key in np.unique(state.astype(np.int64) * (1 << 21) + column):
            at, col = int(key >> 21), int(key & ((1 << 21) - 1))
            to, more = self._compile(self.states[at], self.chars[col], self.kinds[col])
            if (number := self.number.get(to)) is None:
                number = self.number[to] = len(self.states)
                self.states.append(to)
                if number >= self.goes.shape[0]:
                    self._grow(self.goes.shape[0] * 2, self.width)
            self.goes[at, col], self.adds[at, col] = number + 1, more

    def _run(self, cols: np.ndarray, state: np.ndarray, adds: np.ndarray, steps: np.ndarray | None = None) -> np.ndarray:
        """Run lanes (columns of ``cols``) from ``state``; write the tokens of each step to ``adds``; end states.

        ``steps``: how many steps each lane takes, descending; all, if None.
        """
        state = state.copy()
        for t in range(cols.shape[0] if steps is None else int(steps[0]) if len(steps) else 0):
            n = len(state) if steps is None else int(np.searchsorted(-steps, -t, side="left"))
            own, col = state[:n], cols[t, :n]
            at = own.astype(np.int64) * self.width + col
            to = self.goes.ravel()[at]
            if not to.all():
                missing = to == 0
                self._fill(own[missing], col[missing])
                at = own.astype(np.int64) * self.width + col
                to = self.goes.ravel()[at]
            adds[t, :n] = self.adds.ravel()[at]
            state[:n] = to - 1
        return state

    def _long(self, cols: np.ndarray) -> list[tuple[int, int]]:
        """Runs of LONG characters of one kind that are words by themselves (no quote can belong to a contraction)."""
        kinds = np.array(self.kinds, np.int8)[cols]
        # Such a run covers a multiple of LONG / 2 together with its successor: only there one is looked for.
        step = LONG // 2
        marks = kinds[::step]
        if not ((marks[1:] == marks[:-1]) & (marks[1:] != _SPACE) & (marks[1:] != _NUMBER)).any():
            return []
        edges = np.concatenate([[0], np.flatnonzero(kinds[1:] != kinds[:-1]) + 1, [len(kinds)]])
        far = np.flatnonzero((np.diff(edges) >= LONG) & np.isin(kinds[edges[:-1]], (_LETTER, _OTHER)))
        quote = self.column[ord("'")]
        found = []
        for start, end in zip(edges[far], edges[far + 1], strict=True):
            if not (start and cols[start - 1] == quote) and not (kinds[start] == _OTHER and quote and (cols[start:end] == quote).any()):
                found.append((int(start), int(end)))
        return found

    def count(self, texts: list[str | None]) -> np.ndarray:
        """The number of tokens of each text."""
        if len(self.states) * self.width > MOST_CELLS:
            self._clear()
        parts, special = [], np.zeros(len(texts), np.int64)
        lengths = np.zeros(len(texts), np.int64)
        for at, text in enumerate(texts):
            segments = self.bpe.segments(text or "")
            special[at] = len(segments) // 2
            for segment in segments[::2]:
                parts.append(self.bpe.normal(segment))
                lengths[at] += len(parts[-1]) + 1
        if not texts:
            return special
        joined = "\n".join([*parts, ""])
        cols = self.columns(joined)
        ends_of = np.cumsum(lengths)
        for start, end in self._long(cols):
            special[np.searchsorted(ends_of, start, side="right")] += self.words.count(joined[start:end].encode("utf-8", "surrogatepass"))
            cols[start:end] = self.column[ord("\n")]
        lanes = -(-len(cols) // CHUNK)
        space = self.column[ord("\n")]
        laid = np.full(lanes * CHUNK, space, np.int32)
        laid[: len(cols)] = cols
        laid = np.ascontiguousarray(laid.reshape(lanes, CHUNK).T)
        adds = np.zeros((CHUNK, lanes), np.int16)

        # Constant part of every chunk's map; only the first chunk's beginning is known from the start.
        entry = np.full(lanes, WAITING, np.int32)
        entry[0] = BETWEEN
        ends = self._run(laid, entry, adds)
        kinds = np.array(self.kinds, np.int8)[laid]
        resets = (kinds == _SPACE) | (kinds == _NUMBER)
        resets[1:] |= ((kinds[:-1] == _LETTER) & (kinds[1:] == _OTHER)) | ((kinds[:-1] == _OTHER) & (kinds[1:] == _LETTER) & (laid[:-1] != self.shared.get("'", -1)))
        reset = resets.any(axis=0)
        head = np.where(reset, resets.argmax(axis=0) + 1, CHUNK)
        # The scan: the map up to a chunk is the constant of the last chunk that has one, followed by the open ones.
        fixed = reset.copy()
        fixed[0] = True
        source = np.maximum.accumulate(np.where(fixed, np.arange(lanes), -1))
        depth = np.arange(lanes) - source  # open chunks since then, this one included
        before = np.arange(1, lanes)
        rounds = depth[before - 1]  # a chunk can begin when its left neighbour's end is known
        for r in range(int(rounds.max()) + 1 if lanes > 1 else 0):
            own = before[rounds == r]
            own = own[np.argsort(-head[own], kind="stable")]
            begun = np.zeros((int(head[own[0]]), len(own)), np.int16)
            out = self._run(laid[: begun.shape[0], own], ends[own - 1], begun, head[own])
            for lane, column in zip(own, begun.T, strict=True):
                adds[: head[lane], lane] = column[: head[lane]]
            ends[own] = np.where(reset[own], ends[own], out)
        flat = np.ascontiguousarray(adds.T).ravel()[: len(cols)]
        return np.add.reduceat(flat, np.concatenate([[0], np.cumsum(lengths)[:-1]]), dtype=np.int64) + special


def _in(char: str, members: str) -> bool:
    """Whether ``char`` is in the ranges of ``members``, written as inside a pattern's brackets."""
    at = 0
    while at < len(members):
        if members[at + 1 : at + 2] == "-" and at + 2 < len(members):
            if members[at] <= char <= members[at + 2]:
                return True
            at += 3
        elif members[at] == char:
            return True
        else:
            at += 1
    return False


_transducers: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """A worker's transducer; it outlives a task, and so does what it has compiled."""
    if path not in _transducers:
        _transducers.clear()
        _transducers[path] = Transducer(path)
    return _transducers[path]


def count_tokens(df: DataFrame, path: str, text: str = "text", into: str = "n_tokens") -> DataFrame:
    """``df`` with the number of tokens of ``text`` (a column of the name ``into`` is replaced)."""
    ship(df.sparkSession)
    df = df.drop(into)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = transducer(path)
        for batch in batches:
            for block in blocks(batch, text, BLOCK):
                counts = own.count(block.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*block.columns, pa.array(counts, pa.int64())], [*names, into])

    return df.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{into}` long")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = transducer(path)
        for batch in batches:
            for block in blocks(batch, most=BLOCK):
                counts = own.count(block.column("text").to_pylist())
                size = pc.fill_null(pc.binary_length(block.column("text")), 0)
                yield pa.RecordBatch.from_arrays(
                    [block.column("doc_id"), size.cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(counts > LIMIT)],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return documents.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
