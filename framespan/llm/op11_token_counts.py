"""Token counts by finite-state transducers compiled from a byte-level BPE vocabulary.

Two deterministic transducers stand for the tokenizer. The first splits text into pieces: its states know the class
of the last character (letter, number, white space, other) and its transitions emit piece borders; as it looks two
characters back and three ahead at most, it runs over whole arrays of characters at once. The second
reads the bytes of a piece: a state is the set of vocabulary prefixes that are open at this point, each with the last token
before it and the count up to there; a transition carries the change of the number of tokens. A sequence of
tokens is the tokenizer's own exactly if each two neighbours are (merging their joint bytes gives them back), so of the tokens that
could end at a byte exactly one fits what precedes it, and reading a byte needs no look at earlier text. States and
transitions are compiled when they are first met and kept; the tables are emptied when full.

Texts are cut into chunks. The map of a chunk is (head, count, tail): after a letter that no letter follows, and a few such
class changes, the first transducer is in one state whatever came before, so between the first and the last of these places the count is
fixed; only head and tail wait for the neighbours. Maps compose associatively, and a prefix scan over the
chunks of a task gives the counts, in the order of the scan and without a shuffle.

Classes of characters are asked of the library (its Unicode tables are newer than Python's). Strings of special tokens
inside a text are one token each and split it, which is the library's default.

Defined results: null and empty texts have no tokens; rows repeated in full get a row each; an empty table gives no rows; other
columns are ignored; a very long text is worked on chunk by chunk, and a single piece without any border (a megabyte of letters) runs through the second
transducer byte by byte.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of a chunk, and of the arrays that are worked on at once.
CHUNK = 65_536
SLAB = 1_000_000
#: Entries that a task's tables of states and of counted pieces hold before they are emptied.
STATES, PIECES = 150_000, 500_000

LETTER, NUMBER, SPACE, OTHER, NONE = range(5)


# --- vocabulary ----------------------------------------------------------------------------------------


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else the next free letter from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def character_classes() -> np.ndarray:
    """Class of each code point as the library's own patterns see it."""
    from tokenizers import Regex, normalizers

    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text = "".join(map(chr, points))
    classes = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern, mark in ((LETTER, r"\p{L}", ""), (NUMBER, r"\p{N}", ""), (SPACE, r"\s", "")):
        changed = normalizers.Replace(Regex(pattern), mark).normalize_str(text)
        classes[[c for c, a, b in zip(points, text, changed) if a != b]] = kind
    return classes


class Vocabulary(NamedTuple):
    """What executors need of a tokenizer file; a few megabytes whatever the corpus."""

    key: str
    classes: bytes
    tokens: list[bytes]
    merges: list[tuple[bytes, bytes]]
    specials: list[str]


def read_vocabulary(path: str) -> Vocabulary:
    """A byte-level BPE file of the library ``tokenizers``; other kinds are refused."""
    with open(path, encoding="utf-8") as file:
        raw = file.read()
    spec = json.loads(raw)
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    if not plain or spec["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        raise ValueError("not a plain byte-level BPE file")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        raise ValueError("added tokens that reach beyond their string are not supported")
    letter = byte_letters()
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    plain_bytes = {t: bytes(letter[c] for c in t) for t in model["vocab"] if all(c in letter for c in t)}
    specials = sorted((t["content"] for t in spec["added_tokens"]), key=lambda t: (-len(t), t))
    return Vocabulary(
        hashlib.sha256(raw.encode()).hexdigest(),
        character_classes().tobytes(),
        sorted(set(plain_bytes.values()) - {t.encode() for t in specials}),
        [(plain_bytes[a], plain_bytes[b]) for a, b in merges],
        specials,
    )


# --- transducer of the bytes of a piece ----------------------------------------------------------------


class PieceTransducer:
    """Bytes in, changes of the token count out. Tokens are numbered: a byte by its value, a merged token by 256 + rank of its merge."""

    def __init__(self, tokens: list[bytes], merges: list[tuple[bytes, bytes]]):
        number = {bytes([b]): b for b in range(256)} | {a + b: 256 + at for at, (a, b) in enumerate(merges)}
        if len(number) < 256 + len(merges) or not number.keys() >= set(tokens):
            raise ValueError("every token of more than one byte must have one merge of its own")
        self.halves = [(b, b) for b in range(256)] + [(number[a], number[b]) for a, b in merges]
        self.joint = {pair: at for at, pair in enumerate(self.halves) if at >= 256}
        self.whole = [True] * 256  # whether the token's own bytes come out as this token
        for at, (a, b) in enumerate(self.halves[256:], 256):
            self.whole.append(self.whole[a] and self.whole[b] and self._apart(a, b, at))
        self.child: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for t in tokens:
            node = 0
            for b in t:
                if b not in self.child[node]:
                    self.child[node][b] = len(self.child)
                    self.child.append({})
                    self.token.append(-1)
                node = self.child[node][b]
            self.token[node] = number[t]
        self.fit: dict[tuple[int, int], bool] = {}
        self._empty()

    def _empty(self) -> None:
        start = ((0, -1, 0),)
        self.states, self.number, self.moves = [start], {start: 0}, [{}]

    def _apart(self, a: int, b: int, limit: int) -> bool:
        """Whether no merge joins the neighbours a and b, or parts of them, before merge ``limit``.

        Undoes the merges next to the border, newest first: while two parts face each other there, their
        joint merge must not come before the merge that takes one of them away. Of equal merges the left one comes first.
        """
        while True:
            if self.joint.get((a, b), limit) < limit:
                return False
            if a < 256 and b < 256:
                return True
            if a > b:
                limit, a = a, self.halves[a][1]
            else:
                limit, b = b + 1, self.halves[b][0]

    def fits(self, a: int, b: int) -> bool:
        """Whether the tokenizer leaves two tokens side by side (``a`` = -1: nothing before)."""
        found = self.fit.get((a, b))
        if found is None:
            if len(self.fit) > 4 * STATES:
                self.fit.clear()
            found = self.fit[a, b] = self.whole[b] and (a < 0 or self._apart(a, b, 1 << 60))
        return found

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        """The transition of a state on a byte, derived once: next state and change of the count."""
        child, token, fit = self.child, self.token, self.fit
        open_, ended, change = [], -1, 0
        for node, last, count in self.states[state]:
            node = child[node].get(byte)
            if node is None:
                continue
            if ended < 0 and token[node] >= 0:
                fits = fit.get((last, token[node]))
                if fits or fits is None and self.fits(last, token[node]):
                    ended, change = token[node], count + 1
            if child[node]:
                open_.append((node, last, count))
        if ended < 0:
            raise ValueError("the vocabulary lacks single bytes")
        after = (*[(node, last, count - change) for node, last, count in open_], (0, ended, 0))
        number = self.number.get(after)
        if number is None:
            if len(self.states) >= STATES:
                self._empty()
            number = self.number.setdefault(after, len(self.states))
            if number == len(self.states):
                self.states.append(after)
                self.moves.append({})
        return number, change

    def count(self, word: bytes) -> int:
        state = total = 0
        for byte in word:
            move = self.moves[state].get(byte)
            if move is None:
                held = self.states
                move = self._compile(state, byte)
                if held is self.states:
                    self.moves[state][byte] = move
            state = move[0]
            total += move[1]
        return total


# --- transducer of the characters, and maps of chunks --------------------------------------------------


class ChunkMap(NamedTuple):
    """What a chunk does to whatever surrounds it; ``tail`` is None where no place in it is independent of the surroundings."""

    head: str
    count: int = 0
    tail: str | None = None


class Tokenizer:
    """Both transducers of one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.classes = np.frombuffer(vocabulary.classes, np.uint8)
        self.bytes = PieceTransducer(vocabulary.tokens, vocabulary.merges)
        self.known: dict[str, int] = {}

    def _borders(self, text: str, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces begin, and where they do so whatever the surroundings, in sections that begin at ``starts``."""
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.classes[code]
        n = len(code)
        before, after = np.full(n, NONE, np.uint8), np.full(n, NONE, np.uint8)
        before[1:], after[:-1] = kind[:-1], kind[1:]
        before[starts] = NONE
        after[starts[1:] - 1] = NONE
        blank, quote = np.zeros(n, bool), np.zeros(n, bool)
        blank[1:], quote[1:] = code[:-1] == 32, code[:-1] == 39
        change = kind != before
        begins = change & ~((before == SPACE) & blank)
        begins |= (before == SPACE) & (kind == SPACE) & (after != SPACE) & (after != NONE)
        sure = change & (before != NONE) & (before != SPACE) & ~((before == OTHER) & (kind == LETTER) & quote)
        for at in np.flatnonzero((code == 39) & begins):
            two, three = text[at + 1 : at + 2], text[at + 1 : at + 3]
            size = 2 if two in ("s", "t", "m", "d") and two else 3 if three in ("re", "ve", "ll") else 0
            if size and not (before[at + 1 : at + size] == NONE).any():
                begins[at + 1] = False
                if at + size < n:
                    begins[at + size] = True
        return begins, sure

    def _piece(self, piece: str) -> int:
        found = self.known.get(piece)
        if found is None:
            if len(self.known) >= PIECES:
                self.known.clear()
            found = self.known[piece] = self.bytes.count(piece.encode("utf-8", "surrogatepass"))
        return found

    def maps(self, texts: list[str], opens: list[bool], closes: list[bool]) -> list[ChunkMap]:
        """The map of each chunk; an open or closing end (of a section of text) is a sure place too."""
        out = [ChunkMap("", 0, "") if o or c else ChunkMap("") for o, c in zip(opens, closes)]
        full = [i for i, t in enumerate(texts) if t]
        if not full:
            return out
        text = "".join(texts[i] for i in full)
        sizes = np.array([len(texts[i]) for i in full])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        begins, sure = self._borders(text, starts)
        begin = np.flatnonzero(begins)
        edges = [*begin.tolist(), len(text)]
        pieces = [text[a:b] for a, b in zip(edges, edges[1:])]
        counts = list(map(self.known.get, pieces))
        if None in counts:
            counts = [self._piece(p) if c is None else c for p, c in zip(pieces, counts)]
        upto = np.concatenate([[0], np.cumsum(np.array(counts, np.int64))])
        safe = np.flatnonzero(sure)
        for i, a, size in zip(full, starts.tolist(), sizes.tolist()):
            b = a + size
            left, right = a, b
            if not (opens[i] and closes[i]):
                inner = safe[np.searchsorted(safe, a + 1) : np.searchsorted(safe, b)]
                if not len(inner) and not opens[i] and not closes[i]:
                    out[i] = ChunkMap(text[a:b])
                    continue
                left = a if opens[i] else int(inner[0]) if len(inner) else b
                right = b if closes[i] else int(inner[-1]) if len(inner) else a
            count = int(upto[np.searchsorted(begin, right)] - upto[np.searchsorted(begin, left)])
            out[i] = ChunkMap(text[a:left], count, text[right:b])
        return out

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """The map of two neighbouring chunks; associative."""
        if a.tail is None and b.tail is None:
            return ChunkMap(a.head + b.head)
        if a.tail is None:
            return ChunkMap(a.head + b.head, b.count, b.tail)
        if b.tail is None:
            return ChunkMap(a.head, a.count, a.tail + b.head)
        seam = a.tail + b.head
        return ChunkMap(a.head, a.count + (self.maps([seam], [True], [True])[0].count if seam else 0) + b.count, b.tail)

    def scan(self, maps: list[ChunkMap]) -> list[ChunkMap]:
        """All prefixes of the composition, pairs first: as many levels as the logarithm of the number of chunks."""
        if len(maps) < 2:
            return maps
        pairs = [self.compose(a, b) for a, b in zip(maps[::2], maps[1::2])]
        through = self.scan(pairs)
        out = [maps[0]]
        for at in range(1, len(maps)):
            out.append(through[at // 2] if at % 2 else self.compose(through[at // 2 - 1], maps[at]))
        return out


_TOKENIZERS: dict[str, Tokenizer] = {}


def tokenizer(vocabulary: Vocabulary) -> Tokenizer:
    """The compiled tokenizer of this process; workers keep it from task to task."""
    if vocabulary.key not in _TOKENIZERS:
        _TOKENIZERS[vocabulary.key] = Tokenizer(vocabulary)
    return _TOKENIZERS[vocabulary.key]


# --- on Spark --------------------------------------------------------------------------------------------


def chunks(text: Column, specials: list[str], size: int = CHUNK) -> Column:
    """The chunks of a text in order: (chunk, opens, closes), sections being what lies between special strings."""
    quoted = "|".join(rf"\Q{s}\E" for s in specials)

    def of_section(section: Column) -> Column:
        cut = F.when(section == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(section, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)))
        return F.transform(cut, lambda c, i: F.struct(c.alias("chunk"), (i == 0).alias("opens"), (i == F.size(cut) - 1).alias("closes")))

    whole = F.array(F.struct(text.alias("chunk"), F.lit(True).alias("opens"), F.lit(True).alias("closes")))
    simple = F.octet_length(text) <= size
    for s in specials:
        simple = simple & ~F.contains(text, F.lit(s))
    sections = F.split(text, quoted, -1) if specials else F.array(text)
    return F.when(simple, whole).otherwise(F.flatten(F.transform(sections, of_section)))


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(id, n_bytes, n_tokens) for every row; ``path`` is the driver's, executors get the vocabulary by broadcast."""
    vocabulary = read_vocabulary(path)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = tokenizer(shared.value)
        carried, total = ChunkMap("", 0, ""), 0  # of the section and of the text that is being read
        for batch in batches:
            texts, opens, closes, ends = (batch.column(i) for i in (2, 3, 4, 5))
            opens, closes, ends = opens.to_pylist(), closes.to_pylist(), ends.to_pylist()
            rows, counts, at = [], [], 0
            while at < batch.num_rows:
                stop, size, slab = at, 0, []
                while stop < batch.num_rows and size < SLAB:
                    slab.append(texts[stop].as_py())
                    size += len(slab[-1])
                    stop += 1
                maps = machine.maps(slab, opens[at:stop], closes[at:stop])
                first = 0
                while first < len(maps):
                    last = first
                    while not closes[at + last] and last + 1 < len(maps):
                        last += 1
                    through = maps[first:last + 1] if opens[at + first] else [carried, *maps[first:last + 1]]
                    carried = machine.scan(through)[-1]
                    if closes[at + last]:
                        total += carried.count
                        if ends[at + last]:
                            rows.append(at + last)
                            counts.append(total)
                            total = 0
                        else:
                            total += 1  # the special token that ends this section
                    first = last + 1
                at = stop
            if rows:
                picked = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([picked.column(0), picked.column(1), pa.array(counts, pa.int64())], names=schema.names)

    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    cut = docs.select(F.col(f"`{id_col}`").alias("_id"), F.octet_length(text).cast("long").alias("_bytes"), chunks(text, vocabulary.specials, chunk).alias("_chunks"))
    rows = cut.select("_id", "_bytes", F.posexplode("_chunks").alias("_at", "_c"), (F.size("_chunks") - 1).alias("_last"))
    return rows.select("_id", "_bytes", "_c.chunk", "_c.opens", "_c.closes", (F.col("_at") == F.col("_last")).alias("_ends")).mapInArrow(run, schema)
