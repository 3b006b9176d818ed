"""Token counts by finite-state transducers.

A byte-level BPE tokenizer is compiled into two deterministic transducers
whose transitions carry what they emit:

* the *splitter* reads character classes and emits pre-token boundaries, one
  character late where a boundary depends on the next character.  It has
  twelve states.  A text is cut into chunks; each chunk is run from every
  state, which gives its state map, and the maps compose in a parallel prefix
  scan, so every chunk learns the state it starts in;
* the *counter* reads the bytes of a pre-token.  Its transitions carry the
  change of the token count.  The last token of a prefix's encoding is unique,
  and the encoding without it is the encoding of the shorter prefix, so a state
  is the set of last tokens that a longer token could still reach back to.  As
  no token is longer than some bound, the states are finite in number; they
  are built when first reached, and the table is begun anew when it is full.

Both run over many chunks or pre-tokens in step, as numpy table lookups.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import worker

# --- the splitter ---------------------------------------------------------

#: Character classes: space, other white space, number, other, apostrophe,
#: other letter, and the letters of contractions.
(SPACE, WHITE, NUMBER, OTHER, QUOTE, LETTER, L_STMD, L_R, L_V, L_L, L_E) = range(11)
CLASSES = 11
#: States: at a start; in letters, numbers, others; one space, one other white;
#: more white ending in space, in other; after a starting apostrophe; and after
#: that with r, v, l.
(START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, SPACE_1, WHITE_1, SPACE_N, WHITE_N, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L) = range(12)
STATES = 12
#: Emissions: a boundary before this character, and before the last one.
HERE, LAST = 1, 2


def _fresh(kind: int) -> int:
    """The state after a pre-token begins with this class."""
    if kind == SPACE:
        return SPACE_1
    if kind == WHITE:
        return WHITE_1
    if kind == NUMBER:
        return IN_NUMBERS
    if kind == OTHER:
        return IN_OTHERS
    if kind == QUOTE:
        return QUOTED
    return IN_LETTERS


def _run_of(kind: int) -> int:
    return {NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, QUOTE: IN_OTHERS}.get(kind, IN_LETTERS)


def _step(state: int, kind: int) -> tuple[int, int]:
    """(next state, emission)."""
    white = kind in (SPACE, WHITE)
    letter = kind >= LETTER
    if state == START:
        return _fresh(kind), HERE
    if state in (IN_LETTERS, IN_NUMBERS, IN_OTHERS):
        same = (
            (state == IN_LETTERS and letter)
            or (state == IN_NUMBERS and kind == NUMBER)
            or (state == IN_OTHERS and kind in (OTHER, QUOTE))
        )
        return (state, 0) if same else (_fresh(kind), HERE)
    if state in (SPACE_1, WHITE_1, SPACE_N, WHITE_N):
        if white:
            return (SPACE_N if kind == SPACE else WHITE_N), 0
        split = LAST if state in (SPACE_N, WHITE_N) else 0
        if state in (SPACE_1, SPACE_N):
            return _run_of(kind), split  # the space leads the next run
        return _fresh(kind), split | HERE
    if state == QUOTED:
        if kind == L_STMD:
            return START, 0
        if kind in (L_R, L_V, L_L):
            # Either half of a contraction, or a letter run that began here.
            return {L_R: QUOTED_R, L_V: QUOTED_V, L_L: QUOTED_L}[kind], 0
        return (IN_OTHERS, 0) if kind in (OTHER, QUOTE) else (_fresh(kind), HERE)
    if (state in (QUOTED_R, QUOTED_V) and kind == L_E) or (state == QUOTED_L and kind == L_L):
        return START, 0
    return (IN_LETTERS, LAST) if letter else (_fresh(kind), LAST | HERE)


NEXT = np.array([[_step(s, k)[0] for k in range(CLASSES)] for s in range(STATES)], np.uint8)
EMIT = np.array([[_step(s, k)[1] for k in range(CLASSES)] for s in range(STATES)], np.uint8)

_CLASS_OF: dict[str, np.ndarray] = {}


def classes_of(path: str) -> np.ndarray:
    """The class of every code point, as the library's own splitter sees it.

    Unicode versions differ in which code points are letters and numbers, so
    the candidates are put to the library: a letter joins an ``a`` before it.
    """
    if path not in _CLASS_OF:
        import regex
        from tokenizers import Tokenizer

        split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        table = np.full(0x110000, OTHER, np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for pattern, lead, kind in ((r"[\p{L}\p{Cn}]", "a", LETTER), (r"[\p{N}]", "1", NUMBER)):
            asked = regex.findall(pattern, every)
            for k in range(0, len(asked), 50_000):
                some = asked[k : k + 50_000]
                begun = np.zeros(3 * len(some) + 1, bool)
                begun[[start for _, (start, _) in split("".join(f"{lead}{c}\n" for c in some))]] = True
                code = np.frombuffer("".join(some).encode("utf-32-le"), np.uint32)
                table[code[~begun[1 : 3 * len(some) : 3]]] = kind
        table[np.frombuffer("".join(regex.findall(r"\s", every)).encode("utf-32-le"), np.uint32)] = WHITE
        table[ord(" ")] = SPACE
        table[ord("'")] = QUOTE
        for letters, kind in (("stmd", L_STMD), ("r", L_R), ("v", L_V), ("l", L_L), ("e", L_E)):
            for letter in letters:
                table[ord(letter)] = kind
        _CLASS_OF[path] = table
    return _CLASS_OF[path]


#: Characters of a chunk.
CHUNK = 512


def chunk_maps(kinds: np.ndarray) -> np.ndarray:
    """State maps of chunks: kinds is (steps, chunks), filled up with CLASSES
    where a chunk is shorter; the result is (states, chunks)."""
    table = np.concatenate([NEXT, np.arange(STATES, dtype=np.uint8)[:, None]], axis=1).ravel()
    width = CLASSES + 1
    maps = np.repeat(np.arange(STATES, dtype=np.intp)[:, None], kinds.shape[1], axis=1)
    open_ = np.arange(kinds.shape[1])  # chunks whose map is not yet one state
    one = np.zeros(kinds.shape[1], np.intp)
    closed = np.zeros(kinds.shape[1], bool)
    for step, row in enumerate(kinds):
        if len(open_):
            maps[:, open_] = table[maps[:, open_] * width + row[open_]]
        if closed.any():
            one = np.where(closed, table[one * width + row], one)
        if len(open_) and (step < 8 or step % 16 == 0):
            met = (maps[:, open_] == maps[0, open_]).all(0)
            if met.any():
                one[open_[met]] = maps[0, open_[met]]
                closed[open_[met]] = True
                open_ = open_[~met]
    maps[:, closed] = one[closed]
    return maps


def scan_maps(maps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The state each chunk starts in; ``first`` marks a text's first chunk.

    An inclusive scan of map composition in log2 steps; a first chunk's map
    forgets what came before.
    """
    maps = maps.copy()
    maps[:, first] = maps[START, first]
    n, step = maps.shape[1], 1
    while step < n:
        maps[:, step:] = np.take_along_axis(maps[:, step:], maps[:, :-step], axis=0)
        step *= 2
    before = np.full(n, START, np.intp)
    before[1:] = maps[START, :-1]
    before[first] = START
    return before


def boundaries(kinds: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether a pre-token begins at each character.

    kinds: classes of all texts one after another; starts: where texts begin
    (each holds a character).
    """
    n = len(kinds)
    lengths = np.diff(np.append(starts, n))
    per = -(-lengths // CHUNK)
    first = np.cumsum(per) - per
    chunks = int(per.sum())
    text = np.repeat(np.arange(len(starts)), per)
    begin = starts[text] + (np.arange(chunks) - first[text]) * CHUNK
    size = np.minimum(CHUNK, starts[text] + lengths[text] - begin)
    by_size = np.argsort(-size, kind="stable")  # chunks still running are a prefix
    steps = int(size.max()) if chunks else 0
    grid = np.full((steps, chunks), CLASSES, np.uint8)
    running = np.searchsorted(-size[by_size], -np.arange(steps), "left")
    for step in range(steps):
        live = by_size[: running[step]]
        grid[step, live] = kinds[begin[live] + step]
    is_first = np.zeros(chunks, bool)
    is_first[first] = True
    state = scan_maps(chunk_maps(grid), is_first)
    nexts = np.concatenate([NEXT, np.arange(STATES, dtype=np.uint8)[:, None]], axis=1).ravel().astype(np.intp)
    emits = np.concatenate([EMIT, np.zeros((STATES, 1), np.uint8)], axis=1).ravel()
    here = np.zeros(n + 1, bool)
    for step in range(steps):
        live = by_size[: running[step]]
        at = begin[live] + step
        cell = state[live] * (CLASSES + 1) + grid[step, live]
        said = emits[cell]
        state[live] = nexts[cell]
        here[at[said & HERE > 0]] = True
        here[at[said & LAST > 0] - 1] = True
    return here[:n]


# --- the counter ----------------------------------------------------------


class Counter:
    """The token-count transducer of one byte-level BPE vocabulary.

    Bytes are written as the letters that the vocabulary uses for them.
    Transitions stand in an open-addressed table keyed by state and byte.
    """

    #: Transitions after which the table is begun anew.
    KEPT = 1_500_000
    SLOTS = 1 << 22

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.path = path
        self.merge = Tokenizer.from_file(path).model.tokenize
        self.letter = [letter for _, letter in sorted(_byte_letters().items())]
        known = set(self.letter)
        # Only tokens that merging makes of their own bytes occur in encodings.
        self.made = {
            t: i
            for t, i in told["model"]["vocab"].items()
            if known.issuperset(t) and [x.id for x in self.merge(t)] == [i]
        }
        self.longest = max(map(len, self.made), default=1)
        self.starts = {t[:k] for t in self.made for k in range(1, len(t) + 1)}
        self.special = [t["content"] for t in told["added_tokens"]]
        self.fits: dict[str, bool] = {}
        self.anew()

    def _fit(self, left: str, right: str) -> bool:
        """Whether the two tokens stand side by side in an encoding."""
        key = f"{left} {right}"
        fit = self.fits.get(key)
        if fit is None:
            if len(self.fits) > 300_000:
                self.fits.clear()
            ids = [x.id for x in self.merge(left + right)]
            fit = self.fits[key] = ids == [self.made[left], self.made[right]]
        return fit

    def anew(self) -> None:
        """Begin with the start state alone.

        A state is (tail, last tokens, counts): ``tail`` the longest end of the
        prefix that a token may begin with; for the prefixes that end 0 to
        len(tail) bytes back, the last token and the count less the present
        one.  They are left out where no token begins.  An empty last token is
        the empty prefix.
        """
        self.of: dict = {}
        self.states: list = []
        self.keys = np.full(self.SLOTS, -1, np.int64)
        self.next = np.zeros(self.SLOTS, np.int32)
        self.delta = np.zeros(self.SLOTS, np.int16)
        self.used = 0
        self._state(("", ("",), (0,)))

    def _state(self, key) -> int:
        at = self.of.setdefault(key, len(self.states))
        if at == len(self.states):
            self.states.append(key)
        return at

    def _slot(self, cells: np.ndarray) -> np.ndarray:
        mixed = cells.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(42)).astype(np.int64)

    def _find(self, cells: np.ndarray) -> np.ndarray:
        """The slot of each cell, or of the empty slot where it belongs."""
        slot = self._slot(cells)
        held = self.keys[slot]
        off = np.flatnonzero((held != cells) & (held >= 0))
        while len(off):
            slot[off] = (slot[off] + 1) & (self.SLOTS - 1)
            held = self.keys[slot[off]]
            off = off[(held != cells[off]) & (held >= 0)]
        return slot

    def _build(self, cell: int) -> None:
        state, byte = divmod(cell, 256)
        tail, lasts, counts = self.states[state]
        grown = tail + self.letter[byte]
        n = len(grown)
        for size in range(min(n, self.longest), 0, -1):
            token = grown[n - size :]
            before = lasts[size - 1]
            if token in self.made and before is not None and (not before or self._fit(before, token)):
                break
        else:
            raise ValueError("a byte without a token")
        now = counts[size - 1] + 1
        kept = next((k for k in range(n, 0, -1) if grown[n - k :] in self.starts), 0)
        ends, sums = [token], [0]
        for k in range(1, kept + 1):
            live = grown[n - k :] in self.starts
            ends.append(lasts[k - 1] if live else None)
            sums.append(counts[k - 1] - now if live else 0)
        slot = (cell * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 42
        while self.keys[slot] >= 0:
            slot = (slot + 1) & (self.SLOTS - 1)
        self.keys[slot] = cell
        self.next[slot] = self._state((grown[n - kept :], tuple(ends), tuple(sums)))
        self.delta[slot] = now
        self.used += 1

    def counts(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token raw[start:end], all in step."""
        if self.used > self.KEPT:
            self.anew()
        size = end - start
        order = np.argsort(-size, kind="stable")
        at, left = start[order], size[order]
        running = np.searchsorted(-left, -np.arange(int(left[0]) if len(left) else 0), "left")
        state = np.zeros(len(order), np.int64)
        total = np.zeros(len(order), np.int64)
        for step, live in enumerate(running):
            cell = state[:live] * 256 + raw[at[:live] + step]
            slot = self._find(cell)
            missing = np.flatnonzero(self.keys[slot] < 0)
            if len(missing):
                for c in np.unique(cell[missing]).tolist():
                    self._build(c)
                slot[missing] = self._find(cell[missing])
            total[:live] += self.delta[slot]
            state[:live] = self.next[slot]
        out = np.empty(len(order), np.int64)
        out[order] = total
        return out


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes bytes as letters: printable Latin-1 as itself,
    the others from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: Characters handled in step.
STEP_CHARS = 1_000_000


def count_tokens(texts: list[str], counter: Counter) -> np.ndarray:
    """Tokens of whole texts; each special string counts one."""
    parts, owner, special = [], [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        pieces = [text]
        for string in sorted(counter.special, key=len, reverse=True):
            if string in text:
                split = [p.split(string) for p in pieces]
                special[i] += sum(len(s) - 1 for s in split)
                pieces = [x for s in split for x in s]
        for piece in pieces:
            if piece:
                parts.append(piece)
                owner.append(i)
    if not parts:
        return special
    chars = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    starts = np.cumsum(lengths) - lengths
    begin = np.flatnonzero(boundaries(classes_of(counter.path)[chars], starts))
    raw = np.frombuffer("".join(parts).encode(), np.uint8)
    lead = np.flatnonzero((raw & 0xC0) != 0x80)  # the first byte of each character
    first = lead[begin]
    counts = counter.counts(raw, first, np.append(first[1:], len(raw)))
    part = np.searchsorted(starts, begin, "right") - 1
    sums = np.zeros(len(texts), np.int64)
    np.add.at(sums, np.array(owner)[part], counts)
    return sums + special


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of (doc_id, text) rows.

    Null and empty texts have no bytes and no tokens; repeated rows each get a
    row; other columns are ignored; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = worker.kept("token_transducer")
        if tokenizer not in counters:
            counters[tokenizer] = Counter(tokenizer)
        counter = counters[tokenizer]
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            n_bytes = np.zeros(len(texts), np.int64)
            n_tokens = np.zeros(len(texts), np.int64)
            at = 0
            while at < len(texts):
                to, chars = at, 0
                while to < len(texts) and (to == at or chars + len(texts[to]) <= STEP_CHARS):
                    chars += len(texts[to])
                    to += 1
                n_bytes[at:to] = [len(t.encode()) for t in texts[at:to]]
                n_tokens[at:to] = count_tokens(texts[at:to], counter)
                at = to
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )
