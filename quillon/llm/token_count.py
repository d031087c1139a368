"""Token counts by compiled finite-state transducers (operator 7).

Two deterministic transducers are compiled from a byte-level BPE vocabulary.

*Splitter.* A dense table over 12 states and 11 character classes whose transitions say where pieces begin. Text is cut
into chunks of equal length; each chunk gets its map from start states to end states (all states are carried until the
map is constant), a parallel prefix scan composes the maps, and a second pass over all chunks in lockstep emits.

*Counter.* A transducer over the bytes of a piece. Its transitions carry emitted-token counts: the change in the number
of tokens when one more byte is known (negative where a byte merges earlier tokens). It is compiled lazily, state by
state, and thrown away beyond a bound; the sum over a path is the piece's token count. A new state's last token is the
one suffix token that can follow the last token of the shorter prefix, which is decided on the merge trees' spines.

Null and empty text count 0 tokens. Special strings inside a text are single tokens. Very long pieces are linear time.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quillon.llm.bytelevel import Vocabulary, printable_bytes
from quillon.llm.common import map_text, table

#: Characters counted in one pass; pieces that are new in it are sorted, so that neighbours share states.
STRETCH_CHARS = 4_000_000
# Character classes of the splitter.
LETTER, STMD, RV, ELL, EE, NUMBER, SPACE, WHITE, QUOTE, OTHER, END = range(11)
# States of the splitter: nothing read; a contraction is complete; letters; digits; other signs; a lone quote at the start
# of a piece; quote and r or v; quote and l; one space; more white space that ends in a space; one other white character;
# more white space that ends in another white character.
START, DONE, IN_L, IN_N, IN_O, QUOTED, QUOTE_RV, QUOTE_L, SP1, SPN, WS1, WSN = range(12)
HERE, BACK = 1, 2  # a piece begins at this character, at the one before


def _step(state: int, c: int) -> tuple[int, int]:
    """Next state and where pieces begin."""
    letters = c in (LETTER, STMD, RV, ELL, EE)
    if c == END:
        return START, BACK if state in (QUOTE_RV, QUOTE_L) else 0
    if state == QUOTED:
        if c == STMD:
            return DONE, 0
        if c == RV:
            return QUOTE_RV, 0
        if c == ELL:
            return QUOTE_L, 0
    if state in (QUOTE_RV, QUOTE_L):
        if c == (EE if state == QUOTE_RV else ELL):
            return DONE, 0
        after, begin = _step(IN_L, c)
        return after, begin | BACK
    if c in (SPACE, WHITE):
        if state in (SP1, SPN, WS1, WSN):
            return (SPN if c == SPACE else WSN), 0
        return (SP1 if c == SPACE else WS1), HERE
    inside = IN_L if letters else IN_N if c == NUMBER else IN_O
    if state == SP1:
        return inside, 0
    if state == SPN:
        return inside, BACK
    if state == WSN:
        return (QUOTED if c == QUOTE else inside), HERE | BACK
    if state == inside or state == QUOTED and c in (QUOTE, OTHER):
        return inside, 0
    return (QUOTED if c == QUOTE else inside), HERE


@lru_cache(maxsize=1)
def splitter() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Next state and emission, both flat over state * 11 + class, and the class of every code point."""
    cells = [_step(s, c) for s in range(12) for c in range(11)]
    classes = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, (i for i in range(0x110000) if not 0xD800 <= i < 0xE000)))
    for pattern, c in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", WHITE)):
        for m in regex.finditer(pattern, every):
            a, b = ord(every[m.start()]), ord(every[m.end() - 1])
            classes[a : b + 1] = c
    classes[0xD800:0xE000] = OTHER
    for chars, c in (("stmd", STMD), ("rv", RV), ("l", ELL), ("e", EE), (" ", SPACE), ("'", QUOTE)):
        classes[[ord(x) for x in chars]] = c
    return np.array([x[0] for x in cells], np.uint8), np.array([x[1] for x in cells], np.uint8), classes


def begins(classes: np.ndarray, width: int = 1024) -> np.ndarray:
    """True where a piece begins. classes: one END after each text."""
    step, emit, _ = splitter()
    n = len(classes)
    rows = -(-n // width)
    padded = np.full(rows * width, END, np.uint8)
    padded[:n] = classes
    grid = np.ascontiguousarray(padded.reshape(rows, width).T)  # grid[j]: character j of every chunk
    wide = step.astype(np.int16)
    # Maps of chunks: all start states are carried as long as some chunk's map is not constant.
    maps = np.tile(np.arange(12, dtype=np.int16), (rows, 1))
    j = 0
    while j < width:
        maps = wide[maps * 11 + grid[j][:, None]]
        j += 1
        if j % 8 == 0 and (maps == maps[:, :1]).all():
            break
    ends = maps[:, 0]
    for k in range(j, width):
        ends = wide[ends * 11 + grid[k]]
    if j < width:
        maps = np.repeat(ends[:, None], 12, axis=1)
    # Inclusive prefix scan by composition: after it, row i maps a start state over chunks 0..i.
    gap = 1
    while gap < rows:
        maps[gap:] = np.take_along_axis(maps[gap:], maps[:-gap].astype(np.int64), axis=1)
        gap *= 2
    state = np.concatenate([[START], maps[:-1, START]]).astype(np.int16)
    out = np.empty((width, rows), np.uint8)
    for k in range(width):
        cell = state * 11 + grid[k]
        out[k] = emit[cell]
        state = wide[cell]
    marks = out.T.reshape(-1)
    starts = (marks & HERE) > 0
    starts[:-1] |= (marks[1:] & BACK) > 0
    return starts[:n]


class Counter:
    """The byte transducer of one vocabulary, compiled as pieces need it."""

    def __init__(self, vocab: Vocabulary, most_states: int = 500_000, longest_kept: int = 64):
        byte_of = {c: b for b, c in enumerate(printable_bytes())}
        self.ids: dict[bytes, int] = {}
        for i, t in enumerate(vocab.tokens):
            if t not in vocab.specials:
                self.ids[bytes(byte_of[c] for c in t)] = i
        self.rank = {(a, b): r for r, (a, b, _) in enumerate(vocab.merges)}
        self.made = {c: (r, a, b) for r, (a, b, c) in enumerate(vocab.merges)}
        lengths: dict[bytes, set[int]] = {}  # of tokens of over 3 bytes, by their last 4
        for t in self.ids:
            if len(t) > 3:
                lengths.setdefault(t[-4:], set()).add(len(t))
        self.lengths = {k: sorted(v) for k, v in lengths.items()}
        self.spines: tuple[dict, dict] = ({}, {})
        self.fits: dict[int, bool] = {}
        self.most_states, self.longest_kept = most_states, longest_kept
        self.reset()

    def reset(self) -> None:
        self.next: dict[int, int] = {}
        self.last = [-1]
        self.sum = [0]  # of the transitions' emitted counts on the way to the state
        if len(self.fits) > self.most_states:
            self.fits.clear()

    def spine(self, token: int, right: bool) -> list[tuple[int, float]]:
        """The nodes at one edge of a token's merge tree, leaf first, each with the rank of the merge that consumes it."""
        known = self.spines[right]
        if token not in known:
            out, node, eaten = [], token, float("inf")
            while True:
                out.append((node, eaten))
                if node not in self.made:
                    break
                eaten, a, b = self.made[node]
                node = b if right else a
            known[token] = out[::-1]
        return known[token]

    def follows(self, u: int, t: int) -> bool:
        """Whether u, t stay two tokens when their bytes stand together: no pair across the border merges in time."""
        key = u << 20 | t
        if (got := self.fits.get(key)) is None:
            left, right = self.spine(u, True), self.spine(t, False)
            i = j = 0
            got = True
            while True:
                (x, x_eaten), (y, y_eaten) = left[i], right[j]
                r = self.rank.get((x, y))
                # On equal ranks the leftmost pair merges first.
                if r is not None and r < x_eaten and r <= y_eaten:
                    got = False
                    break
                if x_eaten <= y_eaten:
                    if i + 1 == len(left):
                        break
                    i += 1
                else:
                    j += 1
            self.fits[key] = got
        return got

    def last_token(self, piece: bytes, i: int, last: Callable[[int], int]) -> tuple[int, int]:
        """The last token of piece[:i] and its length; last(k): that of piece[:k], -1 for k = 0."""
        for n in (2, 3, *self.lengths.get(piece[max(0, i - 4) : i], ())):
            if n > i:
                break
            if (t := self.ids.get(piece[i - n : i])) is not None:
                u = last(i - n)
                if u < 0 or self.follows(u, t):
                    return t, n
        return self.ids[piece[i - 1 : i]], 1

    def count(self, piece: bytes) -> int:
        n = len(piece)
        if n > self.longest_kept:
            last, sums = [-1] * (n + 1), [0] * (n + 1)
            for i in range(1, n + 1):
                last[i], k = self.last_token(piece, i, last.__getitem__)
                sums[i] = sums[i - k] + 1
            return sums[n]
        if len(self.last) > self.most_states:
            self.reset()
        nxt, last, sums, ids, fits, lengths = self.next, self.last, self.sum, self.ids, self.fits, self.lengths
        state, path, i = 0, [0], 0
        for b in piece:
            i += 1
            key = state << 8 | b
            if key in nxt:
                state = nxt[key]
                path.append(state)
                continue
            # last_token() with the path's states, written out: this is the compiler's inner loop
            for k in (2, 3, *lengths[end]) if (end := piece[i - 4 : i]) in lengths and i > 3 else (2, 3):
                if k > i:
                    continue
                part = piece[i - k : i]
                if part in ids:
                    t, u = ids[part], last[path[i - k]]
                    if u < 0 or (fits[fit] if (fit := u << 20 | t) in fits else self.follows(u, t)):
                        break
            else:
                k = 1
                t = ids[piece[i - 1 : i]]
            state = nxt[key] = len(last)
            last.append(t)
            sums.append(sums[path[i - k]] + 1)
            path.append(state)
        return sums[state]


class TokenCounter:
    """Counts of whole texts. Pieces seen before in a task are looked up; the memory for them is bounded."""

    def __init__(self, path: str, most_pieces: int = 150_000):
        vocab = Vocabulary.load(path)
        self.counter = Counter(vocab)
        self.specials = regex.compile("|".join(map(regex.escape, sorted(vocab.specials, key=len, reverse=True)))) if vocab.specials else None
        self.most_pieces = most_pieces
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def counts(self, texts: list[str]) -> list[int]:
        parts, owner, extra = [], [], [0] * len(texts)
        for i, t in enumerate(texts):
            cut = self.specials.split(t) if self.specials and self.specials.search(t) else [t]
            extra[i] = len(cut) - 1
            parts += cut
            owner += [i] * len(cut)
        whole = "\0".join(parts) + "\0"  # the zero after each part is read as END
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        classes = splitter()[2][points]
        sizes = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
        ends = np.cumsum(sizes) - 1
        classes[ends] = END
        starts = np.flatnonzero(begins(classes))
        stops = np.minimum(np.append(starts[1:], len(whole)), ends[np.searchsorted(ends, starts)])
        pieces = [whole[a:b] for a, b in zip(starts.tolist(), stops.tolist())]
        if len(self.known) > self.most_pieces:
            self.older, self.known = self.known, {}
        known, older, count = self.known, self.older, self.counter.count
        for p in sorted(set(pieces).difference(known)):  # sorted: neighbours share states
            known[p] = older[p] if p in older else count(p.encode("utf-8", "surrogatepass"))
        each = np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))
        total = np.bincount(np.searchsorted(ends, starts), weights=each, minlength=len(parts))
        sums = np.array(extra, np.int64)
        np.add.at(sums, np.array(owner, np.int64), total.astype(np.int64))
        return sums.tolist()


def token_counts(docs: DataFrame, tokenizer_path: str, *, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, n_bytes (UTF-8), n_tokens and whether n_tokens exceeds limit. Null text counts as empty.

    Rows keep their number and multiplicity; other columns are not read, whatever their names.
    """

    def make():
        counter = TokenCounter(tokenizer_path)

        def f(texts: list[str]) -> dict[str, list]:
            n = counter.counts(texts)
            return {"n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

        return f

    schema = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    return map_text(docs, schema, make, text_col=text_col, keep=(id_col,), chunk=STRETCH_CHARS)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
