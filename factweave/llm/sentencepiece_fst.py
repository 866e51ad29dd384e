"""SentencePiece encoding and decoding as weighted finite-state transducers.

Three machines are compiled from a model file into arc tables. The *normaliser* reads characters and
writes characters, with U+2581 for white space; its states know whether a text has begun and whether
white space is pending, for the dummy prefix and for models that drop extra white space. The *piece
machine* is a prefix tree whose paths from the root read a piece and write its id. The *byte machine*
reads a character that is no piece and writes its UTF-8 bytes, or the unknown id if the model has no
byte pieces. An input composed with all three is a lattice: states are positions in the normalised
text, arcs are pieces or bytes. Its shortest path in the tropical semiring is found by relaxing the arcs of
one position after another; arcs are composed when their position is taken from the queue.

*Weights.* In a unigram model an arc costs the negative score of its piece. In a BPE model the result
is no sum of piece scores; its merges are arc weights of a machine over pairs of pieces: b after a costs 0 if
merging the text a + b by the model's ranks ends in the two pieces a and b, and infinity otherwise. A
segmentation is the BPE one exactly if every neighbouring pair is such, so one path is finite, and
each position has one finite predecessor. Pairs are decided by replaying the merges inside a and
inside b in rank order and watching the boundary for a merge that would come first.

Where no piece holds U+2581 after another character, no arc crosses the place before it, so the
composition is taken from there to there; each Python worker remembers the path by normaliser state
and part.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from factweave.llm.common import small_batches

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # kinds of pieces, and of models, in the file format
UNIGRAM, BPE = 1, 2
MODEL = "piece_bpe_32k.model"
REMEMBERED, LONGEST_KEY = 250_000, 40
_RUNS = re.compile("(?s) +|[^ ]+").findall


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol-buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else 4 if kind == 5 else 8
        yield tag >> 3, data[at : at + size]
        at += size


class Normaliser:
    """Arc table (state, is it a space) -> (written before the character, is the character written, next state).

    States: 0, nothing written yet; 1, within the text; 2, white space pending. A space is written as
    U+2581. What is pending at the end is dropped.
    """

    def __init__(self, prefix: bool, collapse: bool):
        first = SPACE if prefix else ""
        if collapse:
            self.arcs = {(0, True): ("", False, 0), (0, False): (first, True, 1), (1, True): ("", False, 2), (1, False): ("", True, 1), (2, True): ("", False, 2), (2, False): (SPACE, True, 1)}
        else:
            self.arcs = {(0, True): (first, True, 1), (0, False): (first, True, 1), (1, True): ("", True, 1), (1, False): ("", True, 1)}

    def compose(self, text: str, state: int) -> tuple[str, int]:
        """What the machine writes for a text from a state, and the state it ends in.

        Runs of characters on an arc that copies them and stays where it is are taken at once.
        """
        out, arcs = [], self.arcs
        for run in _RUNS(text):
            space = run[0] == " "
            at = 0
            while at < len(run):
                before, kept, after = arcs[state, space]
                many = len(run) - at if after == state and not before else 1
                out.append(before)
                if kept:
                    out.append((SPACE if space else run[at]) * many if space or many == 1 else run[at:])
                at, state = at + many, after
        return "".join(out), state


def piece_arcs(pieces: dict[str, int]) -> dict:
    """The prefix tree as arc tables: a state maps a character to (next state, piece that ends there or -1)."""
    root: dict = {}
    for text, i in pieces.items():
        state = root
        for c in text[:-1]:
            state = state.setdefault(c, ({}, -1))[0]
        after = state.get(text[-1], ({}, -1))[0]
        state[text[-1]] = (after, i)
    return root


class Transducer:
    """A compiled model; ``encode`` and ``decode`` work on one text."""

    def __init__(self, model: bytes):
        self.prefix, collapse = True, False
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte_id: dict[int, int] = {}
        self.out: list[bytes] = []
        self.names: list[str] = []
        self.unknown, kind_of_model = 0, UNIGRAM
        for field, value in _fields(model):
            if field == 1:
                own = dict(_fields(value))
                text, kind = own[1].decode(), own.get(3, NORMAL)
                number = len(self.out)
                self.out.append(text.replace(SPACE, " ").encode())
                self.names.append(text)
                if kind == BYTE:
                    code = int(text[1:-1], 16)
                    self.byte_id[code], self.out[-1] = number, bytes([code])
                elif kind == UNKNOWN:
                    self.unknown, self.out[-1] = number, " ⁇ ".encode()
                elif kind == CONTROL:
                    self.out[-1] = b""
                elif kind == NORMAL:
                    self.id[text], self.score[text] = number, float(np.frombuffer(own.get(2, b"\0\0\0\0"), "<f4")[0])
                else:
                    raise ValueError("pieces defined by the user are not supported")
            elif field == 2:
                kind_of_model = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                own = dict(_fields(value))
                if own.get(2):
                    raise ValueError("models with a compiled character map are not supported")
                self.prefix, collapse = bool(own.get(3, 1)), bool(own.get(4, 1))
        if kind_of_model not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        self.merging = kind_of_model == BPE
        self.replayed: dict[str, list[tuple[float, str, str]] | None] = {}
        self.follows: dict[tuple[str, str], bool] = {}
        self.normaliser = Normaliser(self.prefix, collapse)
        self.pieces = piece_arcs({text: i for text, i in self.id.items() if not self.merging or self.merges(text) is not None})
        self.longest = max(map(len, self.id), default=1)
        self.lacking = -min(self.score.values(), default=0.0) + 10.0  # cost of a character without a piece
        several = [text for text in self.id if len(text) > 1]
        loose = "".join(c for c in "\n\t\r" if not any(c in text for text in several))
        if any(SPACE in text.lstrip(SPACE) for text in several):
            self.parts = re.compile("(?s).+")
        else:  # parts begin at a run of white space, or are a character that stands alone
            self.parts = re.compile(f"[ {SPACE}]+[^ {SPACE}{loose}]*|[{loose}]|[^ {SPACE}{loose}]+" if loose else f"[ {SPACE}]+[^ {SPACE}]*|[^ {SPACE}]+")
        self.known: tuple[dict[str, tuple[bytes, int]], ...] = ({}, {}, {})
        self.older: tuple[dict[str, tuple[bytes, int]], ...] = ({}, {}, {})

    def merges(self, piece: str) -> list[tuple[float, str, str]] | None:
        """The merges that build a piece: (rank, first and last symbol after it); None if they don't.

        The list starts with the state before any merge.
        """
        if piece not in self.replayed:
            symbols, steps = list(piece), [(0.0, piece[0], piece[-1])]
            while len(symbols) > 1:
                ranks = [self.score.get(a + b, -np.inf) for a, b in zip(symbols, symbols[1:], strict=False)]
                best = max(range(len(ranks)), key=ranks.__getitem__)  # the leftmost of equals
                if ranks[best] == -np.inf:
                    break
                symbols[best : best + 2] = [symbols[best] + symbols[best + 1]]
                steps.append((ranks[best], symbols[0], symbols[-1]))
            self.replayed[piece] = steps if len(symbols) == 1 else None
        return self.replayed[piece]

    def may_follow(self, a: str, b: str) -> bool:
        """Weight of piece (or single character) b after a in a BPE model: True for 0, False for infinity."""
        if (good := self.follows.get((a, b))) is not None:
            return good
        left, right = self.merges(a), self.merges(b)
        i, j, never = 1, 1, -np.inf
        last, first = left[0][2], right[0][1]
        good = True
        while True:
            cross = self.score.get(last + first, never)
            inside_a = left[i][0] if i < len(left) else never
            inside_b = right[j][0] if j < len(right) else never
            if cross > inside_a and cross >= inside_b:
                good = False
                break
            if inside_a == never and inside_b == never:
                break
            if inside_a >= inside_b:
                last = left[i][2]
                i += 1
            else:
                first = right[j][1]
                j += 1
        if len(self.follows) >= REMEMBERED:
            self.follows.clear()
        self.follows[a, b] = good
        return good

    def shortest_path(self, part: str) -> tuple[list[int], list[int]]:
        """The tropical shortest path of a normalised part's lattice: its ends, and piece ids (-1: bytes).

        Of equal paths the first found stays. The queue of arcs to be relaxed goes by position, a
        topological order, in a unigram model. In a BPE model all finite paths weigh the same, so any
        order gives a shortest path once the end is reached: the last and longest arc comes first.
        """
        back, via = (self._finite if self.merging else self._cheapest)(part)
        ends, pieces, at = [], [], len(part)
        while at:
            ends.append(at)
            pieces.append(via[at])
            at = back[at]
        return ends[::-1], pieces[::-1]

    def _cheapest(self, part: str) -> tuple[list[int], list[int]]:
        size, never = len(part), float("inf")
        cost, back, via = [0.0] + [never] * size, [-1] * (size + 1), [0] * (size + 1)
        for at in range(size):
            state, bare = self.pieces, True
            for end in range(at, size):
                state, piece = state.get(part[end], (None, -1))
                if state is None:
                    break
                if piece >= 0:
                    bare &= end > at
                    weight = cost[at] - self.score[self.names[piece]]
                    if weight < cost[end + 1]:
                        cost[end + 1], back[end + 1], via[end + 1] = weight, at, piece
            if bare and cost[at] + self.lacking < cost[at + 1]:
                cost[at + 1], back[at + 1], via[at + 1] = cost[at] + self.lacking, at, -1
        return back, via

    def _finite(self, part: str) -> tuple[list[int], list[int]]:
        size, names, follows, longest = len(part), self.names, self.follows, self.longest
        back, via = [-1] * (size + 1), [0] * (size + 1)
        at, before, queue = 0, "", []  # before: text of the arc that reaches a position, the pair machine's state
        while back[size] < 0:
            state, end, arcs = self.pieces, at, []
            for c in part[at : at + longest]:
                arc = state.get(c)
                if arc is None:
                    break
                state, piece = arc
                end += 1
                if piece >= 0:
                    arcs.append((end, piece))
            if not arcs or arcs[0][0] != at + 1:
                arcs.insert(0, (at + 1, -1))
            queue.append((at, before, arcs))
            while True:
                start, left, arcs = queue[-1]
                if not arcs:
                    queue.pop()
                    continue
                at, piece = arcs.pop()
                if back[at] < 0:
                    before = names[piece] if piece >= 0 else part[start]
                    good = follows.get((left, before)) if left else True
                    if good or good is None and self.may_follow(left, before):
                        back[at], via[at] = start, piece
                        break
        return back, via

    def solve(self, raw: str, state: int) -> tuple[bytes, int]:
        """Ids (uint16) of a part from a normaliser state, and the state after it."""
        part, state = self.normaliser.compose(raw, state)
        ends, pieces = self.shortest_path(part)
        if -1 in pieces:
            out: list[int] = []
            for end, piece in zip(ends, pieces, strict=True):
                if piece >= 0:
                    out.append(piece)
                elif self.byte_id:
                    out += [self.byte_id[c] for c in part[end - 1].encode("utf-8", "surrogatepass")]
                else:
                    out.append(self.unknown)
            pieces = out
        return array("H", pieces).tobytes(), state

    def encode(self, text: str) -> np.ndarray:
        found, known, state = [], self.known, 0
        for part in self.parts.findall(text):
            got = known[state].get(part)
            if got is None:
                got = self.older[state].get(part) or self.solve(part, state)
                if len(part) <= LONGEST_KEY:
                    if len(known[state]) >= REMEMBERED:
                        self.older[state].clear()
                        self.older[state].update(known[state])
                        known[state].clear()
                    known[state][part] = got
            found.append(got[0])
            state = got[1]
        ids = np.frombuffer(b"".join(found), np.uint16)
        if not self.byte_id and len(ids):
            ids = ids[np.concatenate([[True], (ids[1:] != self.unknown) | (ids[:-1] != self.unknown)])]  # once for a run
        return ids

    def decode(self, ids: np.ndarray) -> str:
        """The inverse transducer: pieces to text, bytes joined, the dummy prefix taken off."""
        text = b"".join(map(self.out.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


@cache
def transducer(path: str | None = None) -> Transducer:
    import public_tokenizers

    with open(path or public_tokenizers.path(MODEL), "rb") as f:
        return Transducer(f.read())


def encode(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """docs without the text, with ``ids`` (binary, uint16) and ``decoded``.

    Null and empty texts have no ids. Decoding gives the text back, but for U+2581 in it, which the
    format cannot tell from a space. Columns of those names are replaced. ``path`` is the model file
    on every executor.
    """
    from pyspark.sql.types import BinaryType, StringType, StructField, StructType

    small_batches(docs.sparkSession)
    rest = docs.drop("ids", "decoded")
    names = [n for n in rest.columns if n != text]
    schema = StructType([*[rest.schema[n] for n in names], StructField("ids", BinaryType()), StructField("decoded", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for b in batches:
            if b.num_rows:
                ids = [machine.encode(t or "") for t in b.column(text).to_pylist()]
                back = [machine.decode(i) for i in ids]
                yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array([i.tobytes() for i in ids], pa.binary()), pa.array(back, pa.string())], names=schema.names)

    return rest.mapInArrow(run, schema)


_DIGEST = "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string"


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: how many ids, their crc32 (little-endian unsigned 32-bit), the decoded text's digest."""
    done = encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.frombuffer(x, np.uint16) for x in b.column("ids").to_pylist()]
            crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
            sha = [hashlib.sha256(t.encode()).hexdigest() for t in b.column("decoded").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array(crc, pa.int64()), pa.array(sha)], names=[f.split()[0] for f in _DIGEST.split(", ")])

    return done.mapInArrow(digest, _DIGEST)
