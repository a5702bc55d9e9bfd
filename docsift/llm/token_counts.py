"""Token counts of a byte-level BPE vocabulary by compiled finite-state transducers.

Two deterministic transducers do the work of the tokenizer library:

* The word transducer cuts a text into pre-tokens. It is definite: whether it cuts before a character depends on
  the classes of three characters before and one after it, so its state is those classes.
* The piece transducer reads the bytes of a pre-token. Its transitions carry the number of tokens that they emit.
  States and transitions are compiled when first needed and kept. A state is what can still matter: the longest
  suffix that begins some vocabulary entry, and for each place in it the last token of the encoding up to there
  and that encoding's length relative to now. The encoding of a prefix has a unique last token: the one that ends
  there and is compatible with the last token before it.

A long text is cut into chunks. A chunk's state map is (head, count, tail): what stands before its first certain cut,
the tokens between its first and last certain cut, and what stands after. Maps compose associatively, so chunks are
summarised apart and combined by a prefix scan.

Null texts count as empty: 0 bytes, 0 tokens. Repeated rows and ids are kept as they are.
"""

import json
from bisect import bisect_left
from functools import cache
from itertools import accumulate, compress, count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docsift.llm.common import slices, tidied

CHUNK = 1 << 20
MOST_PIECES, MOST_STATES = 400_000, 120_000

LETTER, NUMBER, SPACE, WHITE, APOSTROPHE, OTHER, ONE, R, V, L, E = range(11)
#: Code points of the White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@cache
def classes() -> np.ndarray:
    """The class of each code point."""
    import regex

    out = np.full(0x110000, OTHER, np.uint8)
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER)):
        out[[ord(c) for c in regex.findall(pattern, everything)]] = kind
    out[WHITE_SPACE] = WHITE
    for c, kind in ((" ", SPACE), ("'", APOSTROPHE), ("r", R), ("v", V), ("l", L), ("e", E)):
        out[ord(c)] = kind
    out[[ord(c) for c in "stmd"]] = ONE
    return out


@cache
def cut_table() -> tuple[np.ndarray, np.ndarray]:
    """For classes of neighbours a, b: whether they belong to different runs; and each class's kind of run."""
    kind = np.array([LETTER, NUMBER, SPACE, SPACE, OTHER, OTHER, LETTER, LETTER, LETTER, LETTER, LETTER], np.uint8)
    cut = kind[:, None] != kind[None, :]
    cut[SPACE] = False  # a blank joins what follows it
    cut[:, [SPACE, WHITE]] = kind[:, None] != SPACE
    return cut, kind


def starts(text: str) -> np.ndarray:
    """Where the pre-tokens of text begin."""
    c = classes()[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    n = len(c)
    if not n:
        return np.empty(0, np.int64)
    cut, kind = cut_table()
    at = np.empty(n, bool)
    at[0] = True
    at[1:] = cut[c[:-1], c[1:]]
    white = kind[c] == SPACE
    # of a run of white space before something else, the last character stands apart
    at[1:-1] |= white[:-2] & white[1:-1] & ~white[2:]
    # a contraction: an apostrophe that begins a pre-token, then one of the endings
    for i in np.flatnonzero(c == APOSTROPHE).tolist():
        if i and c[i - 1] in (SPACE, APOSTROPHE, OTHER) or i + 1 >= n:
            continue
        a, b = c[i + 1], c[i + 2] if i + 2 < n else OTHER
        size = 2 if a == ONE else 3 if a in (R, V) and b == E or a == L == b else 0
        if size:
            at[i + 1 : i + size] = False
            if i + size < n:
                at[i + size] = True
    return np.flatnonzero(at)


class Pieces(dict):
    """Token counts of pre-tokens. A missing one is run through the piece transducer."""

    def __init__(self, merges: list[tuple[bytes, bytes]], tokens: set[bytes]):
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.merges, self.made = merges, {a + b: i for i, (a, b) in enumerate(merges)}
        self.tokens = tokens
        self.longest = max(map(len, tokens))
        self.prefixes = {t[:k] for t in tokens for k in range(1, len(t))} | tokens
        self.sorted = sorted(tokens)
        self.begin: dict[bytes, list[bytes] | tuple | None] = {}
        self.fits: dict[tuple[bytes | None, bytes], tuple] = {}
        self.older: dict[str, int] = {}
        self.reset()

    def reset(self) -> None:
        #: A state: (suffix, ((last token, tokens relative to now) or None for each place in it)). The first is the start.
        self.states: list = [(b"", ((None, 0),))]
        self.number = {self.states[0]: 0}
        #: Its transitions: byte -> (the next state's transitions, emitted tokens); under -1 its number.
        self.moves: list[dict] = [{-1: 0}]

    def compatible(self, a: bytes | None, b: bytes) -> bool:
        """Whether b can follow a in an encoding.

        Merges are undone from the latest to the earliest, on the side that made it. If the parts that then meet have
        a merge that comes before what was undone last, the encoding would have joined them, and a and b can't meet.
        """
        if a is None:
            return True
        before = 1 << 30
        while True:
            if self.rank.get((a, b), before) < before:
                return False
            i, j = self.made.get(a, -1), self.made.get(b, -1)
            if i < 0 and j < 0:
                return True
            if i > j:
                a, before = self.merges[i][1], i
            else:  # of equal merges, the one further left comes first
                b, before = self.merges[j][0], j + 1

    def future(self, place: tuple, begun: bytes) -> tuple | None:
        """What can still come of a place after which begun was read: the entries that fit there, or if those are many, its token.

        Places with equal futures are the same state, whatever their tokens.
        """
        if (entries := self.begin.get(begun)) is None:
            i, j = bisect_left(self.sorted, begun), bisect_left(self.sorted, begun + b"\xff\xff")
            entries = self.begin[begun] = self.sorted[i:j] if j - i <= 40 else ()
            if i == j:
                entries = self.begin[begun] = None
        if entries is None:
            return None
        if not entries:
            return place
        if (fits := self.fits.get((place[0], begun))) is None:
            fits = self.fits[place[0], begun] = tuple(compress(count(), [self.compatible(place[0], e) for e in entries]))
        return (fits, place[1]) if fits else None

    def compile(self, moves: dict, byte: int) -> tuple[dict, int]:
        """The transition by byte from the state that has these: the next state's and the tokens that it emits."""
        suffix, places = self.states[moves[-1]]
        now = suffix + bytes([byte])
        for k in range(len(now), 0, -1):
            token = now[-k:]
            place = places[len(now) - k] if token in self.tokens else None  # places[j] is j bytes after the suffix's start
            if place and self.compatible(place[0], token):
                break
        else:
            raise AssertionError("every byte is a token")
        emitted = place[1] + 1
        keep = next(k for k in range(len(now), -1, -1) if not k or now[-k:] in self.prefixes)
        rest = now[len(now) - keep :]
        after = tuple((p[0], p[1] - emitted) if p else None for p in [*places, (token, emitted)][len(now) - keep :])
        key = rest, tuple(p and self.future(p, rest[j:]) for j, p in enumerate(after))
        if (to := self.number.get(key)) is None:
            to = self.number[key] = len(self.states)
            self.moves.append({-1: to})
            self.states.append((rest, tuple(p if k else None for p, k in zip(after, key[1], strict=True))))
        moves[byte] = self.moves[to], emitted
        return moves[byte]

    def __missing__(self, piece: str) -> int:
        if len(self) > MOST_PIECES:  # keep the counts of one generation before this
            self.older = dict(self)
            self.clear()
        if (total := self.older.get(piece)) is None:
            if len(self.states) > MOST_STATES:
                self.reset()
                self.fits.clear()
            total, moves = 0, self.moves[0]
            for byte in piece.encode():
                moves, emitted = moves.get(byte) or self.compile(moves, byte)
                total += emitted
        if len(piece) <= 64:
            self[piece] = total
        return total


class Map(NamedTuple):
    """A chunk's state map; without a certain cut, all of it is head and tail is None."""

    head: str
    count: int
    tail: str | None


class Counter:
    """Counts tokens as the tokenizer file's library does, special strings included."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        if model["type"] != "BPE" or file["pre_tokenizer"]["type"] != "ByteLevel" or file["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("only byte-level BPE without a prefix space is compiled")
        back = self.characters()
        raw = lambda s: bytes(back[c] for c in s)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.special = [t["content"] for t in file["added_tokens"]]
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        vocabulary = {raw(t) for t in model["vocab"] if all(c in back for c in t)}
        self.pieces = Pieces([(raw(a), raw(b)) for a, b in pairs], vocabulary)

    @staticmethod
    def characters() -> dict[str, int]:
        """Printable stand-ins of bytes, as byte-level vocabularies write them: 33-126, 161-172, 174-255, the rest from 256 on."""
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(own)]
        return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}

    def plain(self, text: str) -> int:
        """Of a text that begins and ends at certain cuts."""
        if not text:
            return 0
        at = starts(text).tolist()
        return sum(map(self.pieces.__getitem__, [text[a:b] for a, b in zip(at, [*at[1:], len(text)], strict=True)]))

    def summary(self, chunk: str) -> Map:
        """A cut is certain where white space follows anything else."""
        c = classes()[np.frombuffer(chunk.encode("utf-32-le"), np.uint32)]
        white = (c == SPACE) | (c == WHITE)
        sure = np.flatnonzero(white[1:] & ~white[:-1]) + 1
        if not len(sure):
            return Map(chunk, 0, None)
        return Map(chunk[: sure[0]], self.plain(chunk[sure[0] : sure[-1]]), chunk[sure[-1] :])

    def compose(self, a: Map, b: Map) -> Map:
        if a.tail is None:
            if b.tail is None:
                return self.summary(a.head + b.head)
            whole = self.summary(a.head + b.head)
            if whole.tail is None:
                return Map(whole.head, b.count, b.tail)
            return Map(whole.head, whole.count + self.plain(whole.tail) + b.count, b.tail)
        if b.tail is None:
            middle = self.summary(a.tail + b.head)
            if middle.tail is None:
                return Map(a.head, a.count, middle.head)
            return Map(a.head, a.count + self.plain(middle.head) + middle.count, middle.tail)
        return Map(a.head, a.count + self.plain(a.tail + b.head) + b.count, b.tail)

    def count(self, text: str, chunk: int = CHUNK) -> int:
        if self.split and any(s in text for s in self.special):
            parts = self.split.split(text)
            return sum(self.count(p, chunk) for p in parts if p) + len(parts) - 1
        if len(text) <= chunk:
            return self.plain(text)
        maps = map(self.summary, (text[i : i + chunk] for i in range(0, len(text), chunk)))
        for last in accumulate(maps, self.compose):  # the running compositions; the last is the text's
            pass
        return self.plain(last.head) + last.count + self.plain(last.tail or "")


@cache
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row. path: the tokenizer file, which every executor has at that place.

    No shuffle: one pass over the texts. Empty table: no rows.
    """
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))

    @tidied
    def run(batches):
        count = counter(path)
        for batch in batches:
            for part in slices(batch, 1):
                sizes, tokens = [], []
                for text in part.column(1).to_pylist():
                    sizes.append(len(text.encode()) if text else 0)
                    tokens.append(count.count(text) if text else 0)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([t > limit for t in tokens], pa.bool_())],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return source.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
