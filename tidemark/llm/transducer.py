"""Byte-level BPE by ranks through a lazily determinised transducer.

The transducer that is made deterministic reads bytes and writes tokens. One of its configurations is the last token
written and the bytes read since, as a node in the tree of token labels. It goes on to the node of the next byte and,
where that node ends a token which may follow the last one, also to the root, with that token written. Every prefix of
a word ends just one path at the root. A deterministic state is the set of all configurations alive, each with the
tokens that it has written and the others have not; what all of them have written is emitted, so a token comes out as
soon as no reading of the bytes after it can change it. No configuration stays longer than the longest token, which
bounds the lookahead. States and arcs are made when a word first needs them, and forgotten when there are too many.

Two tokens may stand side by side if no merge takes place across the boundary between them: this is decided from the
merges that made the tokens, once for each pair that turns up.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import Encoder, word_encoder
from .common import gathered, small_batches, texts

#: Deterministic states that a worker remembers at most.
STATES = 250_000
#: Pairs of tokens that a worker remembers at most.
PAIRS = 1_000_000
#: Keys of a deterministic state, besides its arcs by byte: its configurations, and the tokens open at its end.
SET, OPEN = -1, -2


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file: a line holds the bytes in base64 and the rank, which is the id."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    """Encodes words by ``ranks``: at every step the two neighbours that spell the token of least rank become one, the
    leftmost ones first. As in every vocabulary made by merges, a token of several bytes must come from two tokens of
    lower ranks by the merges before it (``ValueError`` if not): so merges take place in the order of ranks."""

    def __init__(self, ranks: dict[bytes, int], states: int = STATES, pairs: int = PAIRS):
        if any(bytes([b]) not in ranks for b in range(256)) or len(set(ranks.values())) < len(ranks) or b"" in ranks:
            raise ValueError("ranks must be distinct, hold every byte and no empty token")
        self.ranks, self.limit, self.pair_limit = ranks, states, pairs
        self.labels = {i: x for x, i in ranks.items()}
        #: When a token is made: its rank, bytes before all. The two tokens that make it; none for bytes.
        self.made = {i: -1 if len(x) == 1 else i for x, i in ranks.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merges: dict[tuple[int, int], int] = {}
        for label, i in sorted(ranks.items(), key=lambda x: x[1]):
            if len(label) > 1:
                halves = self._reduced(label, i)
                if len(halves) != 2:
                    raise ValueError(f"token {i} is not made of two tokens of lower ranks")
                self.halves[i] = (halves[0], halves[1])
                self.merges[self.halves[i]] = i
        #: The next node for a node and a byte; the token that ends at a node, or -1; whether a node goes on.
        self.steps: dict[int, int] = {}
        self.ends = array("i", [-1])
        self.inner = bytearray(1)
        for i, label in self.labels.items():
            node = 0
            for byte in label:
                self.inner[node] = 1
                node = self.steps.setdefault(node << 8 | byte, len(self.ends))
                if node == len(self.ends):
                    self.ends.append(-1)
                    self.inner.append(0)
            self.ends[node] = i
        self.beside: dict[tuple[int, int], bool] = {}
        self.states: dict[tuple[tuple[int, int, tuple[int, ...]], ...], dict] = {}
        self._forget()

    def _reduced(self, label: bytes, below: int) -> list[int]:
        """Tokens of ``label`` after all merges of a rank less than ``below``."""
        ranks, out = self.ranks, [self.ranks[label[k : k + 1]] for k in range(len(label))]
        parts = [label[k : k + 1] for k in range(len(label))]
        while len(parts) > 1:
            least, at = min((ranks.get(a + b, below), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if least >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            out[at : at + 2] = [least]
        return out

    def _state(self, alive: tuple[tuple[int, int, tuple[int, ...]], ...]) -> dict:
        """The deterministic state of a set of configurations; a full memory is emptied first."""
        state = self.states.get(alive)
        if state is None:
            if len(self.states) >= self.limit:
                self._forget()
            state = self.states[alive] = {SET: alive, OPEN: alive[-1][2]}
        return state

    def _forget(self) -> None:
        """Start with the initial state alone: nothing written, nothing read. States are unlinked, as they can be cyclic."""
        for state in self.states.values():
            state.clear()
        self.states.clear()
        self.start = self._state(((-1, 0, ()),))

    def adjacent(self, a: int, b: int) -> bool:
        """Whether ``a`` and ``b`` can stand side by side.

        Back in time, ``a`` falls into its halves and ``b`` into its own; the boundary meets the right edge of the one
        and the left edge of the other. A merge across it takes place if two tokens that were there at one time have
        one that comes before either was taken up by its own side; of equal ranks the left one comes first."""
        known = self.beside.get((a, b))
        if known is not None:
            return known
        x, y, x_until, y_until, free = a, b, float("inf"), float("inf"), True
        made, halves, merges = self.made, self.halves, self.merges
        while True:
            across = merges.get((x, y))
            if across is not None and across < x_until and across <= y_until:
                free = False
                break
            if made[x] < 0 and made[y] < 0:
                break
            if made[x] > made[y]:
                x, x_until = halves[x][1], made[x]
            else:
                y, y_until = halves[y][0], made[y]
        if len(self.beside) >= self.pair_limit:
            self.beside.clear()
        self.beside[a, b] = free
        return free

    def _move(self, state: dict, byte: int) -> tuple[dict, tuple[int, ...]]:
        """The arc from a state by a byte: where it leads and what it emits."""
        steps, ends, inner, beside = self.steps.get, self.ends, self.inner, self.beside.get
        alive: list[tuple[int, int, tuple[int, ...]]] = []
        ended = None
        for q, node, rest in state[SET]:
            node = steps(node << 8 | byte)
            if node is None:
                continue
            if inner[node]:
                alive.append((q, node, rest))
            token = ends[node]
            if token >= 0 and ended is None:
                free = q < 0 or beside((q, token))
                if free is None:
                    free = self.adjacent(q, token)
                if free:
                    ended = (token, 0, (*rest, token))
        alive.append(ended)  # every prefix has its tokens
        emitted = alive[0][2]
        if len(alive) == 1:
            alive = [(ended[0], 0, ())]
        elif emitted:
            shared = 0
            for column in zip(*(rest for _, _, rest in alive), strict=False):
                if len(set(column)) > 1:
                    break
                shared += 1
            emitted = emitted[:shared]
            if shared:
                alive = [(q, node, rest[shared:]) for q, node, rest in alive]
        arc = (self._state(tuple(alive)), emitted)
        if state:  # else it was forgotten meanwhile
            state[byte] = arc
        return arc

    def written(self, word: bytes) -> Iterator[tuple[int, tuple[int, ...]]]:
        """How many bytes were read, and the tokens emitted then, as a stream; at the end what was still open."""
        state = self.start
        for k, byte in enumerate(word, 1):
            state, tokens = state.get(byte) or self._move(state, byte)
            if tokens:
                yield k, tokens
        if state[OPEN]:
            yield len(word), state[OPEN]

    def encode(self, word: bytes) -> list[int]:
        """The ids of a word."""
        whole = self.ranks.get(word)
        if whole is not None:
            return [whole]
        state, out = self.start, []
        for byte in word:
            arc = state.get(byte)
            if arc is None:
                arc = self._move(state, byte)
            state, tokens = arc
            if tokens:
                out += tokens
        out += state[OPEN]
        return out


def _utf8_tables() -> tuple[bytes, list[list[int]]]:
    """Classes of bytes and moves between states of well-formed UTF-8: 0 is a boundary, 1 to 3 are bytes still to come,
    4 to 7 are first bytes whose second one is limited, -1 is an error."""
    kinds = bytearray(256)
    for b in range(256):
        kinds[b] = 0 if b < 0x80 else 1 if b < 0x90 else 2 if b < 0xA0 else 3 if b < 0xC0 else 4 if b < 0xC2 else 5 if b < 0xE0 else 6 if b == 0xE0 else 8 if b == 0xED else 7 if b < 0xF0 else 9 if b == 0xF0 else 10 if b < 0xF4 else 11 if b == 0xF4 else 4
    begin = [0, -1, -1, -1, -1, 1, 4, 2, 5, 6, 3, 7]
    rows = [begin] + [[-1] * 12 for _ in range(7)]
    for state, second in ((1, (0, 0, 0)), (2, (1, 1, 1)), (3, (2, 2, 2)), (4, (-1, -1, 1)), (5, (1, 1, -1)), (6, (-1, 2, 2)), (7, (2, -1, -1))):
        rows[state][1:4] = second
    return bytes(kinds), rows


KINDS, MOVES = _utf8_tables()


class Utf8Stream:
    """Text of a stream of bytes: characters come out when they are complete.

    Ill-formed bytes become U+FFFD, one for each longest beginning of a character that cannot go on."""

    def __init__(self):
        self.state, self.held = 0, bytearray()

    def feed(self, data: bytes) -> str:
        """The characters that ``data`` completes."""
        state, held, out = self.state, self.held, []
        for byte in data:
            after = MOVES[state][KINDS[byte]]
            if after < 0 and state:  # the character breaks off before this byte
                out.append(f"{self._complete(held, len(held) - self._open(held))}�")
                held.clear()
                after = MOVES[0][KINDS[byte]]
            if after < 0:
                out.append(f"{self._complete(held, len(held))}�")
                held.clear()
                state = 0
                continue
            held.append(byte)
            state = after
        out.append(self._complete(held, len(held) - (self._open(held) if state else 0)))
        self.state = state
        return "".join(out)

    @staticmethod
    def _open(held: bytearray) -> int:
        """Bytes of the character that ``held`` ends within."""
        n = 1
        while held[-n] & 0xC0 == 0x80:
            n += 1
        return n

    @staticmethod
    def _complete(held: bytearray, n: int) -> str:
        text = held[:n].decode()
        del held[:n]
        return text

    def finish(self) -> str:
        """What is left when the stream ends: U+FFFD if it ends within a character."""
        left, self.state = bool(self.held), 0
        self.held.clear()
        return "�" if left else ""


class Decoder:
    """Text and bytes of token ids, however they are dealt out.

    From a boundary, most tokens lead to a boundary; their labels are joined as they are. Only those between a token
    that ends within a character and the next boundary pass through the byte machine."""

    def __init__(self, labels: dict[int, bytes]):
        self.labels = labels
        self.whole = {i for i, x in labels.items() if self._whole(x)}

    @staticmethod
    def _whole(label: bytes) -> bool:
        state = 0
        for byte in label:
            state = MOVES[state][KINDS[byte]]
            if state < 0:
                return False
        return state == 0

    def raw(self, ids: Iterable[int]) -> bytes:
        """The bytes of ``ids``."""
        return b"".join(map(self.labels.__getitem__, ids))

    def stream(self, chunks: Iterable[list[int]]) -> Iterator[str]:
        """The text of each chunk of ids as far as its characters are complete; in the end, what is left."""
        machine, labels, whole = Utf8Stream(), self.labels, self.whole
        for ids in chunks:
            if not machine.state and whole.issuperset(ids):
                yield self.raw(ids).decode()
                continue
            out: list[str] = []
            clean: list[bytes] = []
            for i in ids:
                if not machine.state and i in whole:
                    clean.append(labels[i])
                else:
                    if clean:
                        out.append(b"".join(clean).decode())
                        clean.clear()
                    out.append(machine.feed(labels[i]))
            yield "".join(out) + b"".join(clean).decode()
        yield machine.finish()

    def text(self, ids: list[int]) -> str:
        """The text of a whole list of ids."""
        return "".join(self.stream([ids]))


@contextmanager
def uncollected():
    """No cycle collection meanwhile: it would walk all remembered states again and again, which are unlinked by hand."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def rank_encoder(transducer: Transducer) -> Encoder:
    """Whole texts to ids (little-endian 32-bit): each distinct word passes the transducer once as long as it is remembered."""
    return word_encoder(lambda words: [array("I", transducer.encode(w.encode())).tobytes() for w in words], {})


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and ``ids`` (binary, little-endian unsigned 32-bit integers) of each row's whole text.

    ``path`` is a rank file; words are split as its public pattern says, and special tokens are ordinary text. Null
    texts count as empty: no ids. Repeated rows give repeated results, an empty table an empty one; null and any other
    ids of documents pass through. The merges are compiled on the driver and broadcast (their size is the vocabulary's);
    no row moves between partitions."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(Transducer(load_ranks(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = rank_encoder(shared.value)
        for batch in gathered(batches):
            with uncollected():
                ids = encode(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return texts(docs).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary")


def decoded(rows: DataFrame, path: str, chunk: int = 4096) -> DataFrame:
    """``doc_id``, ``ids``, ``bytes`` (what the ids stand for) and ``text`` (decoded as a stream of ``chunk`` ids at a
    time, U+FFFD for ill-formed bytes) of rows with ``doc_id`` and ``ids``; null ids count as none, unknown ones raise."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast({i: x for x, i in load_ranks(path).items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            raw, out = [], []
            for x in batch.column("ids").to_pylist():
                ids = memoryview(x or b"").cast("I")
                raw.append(decoder.raw(ids))
                out.append("".join(decoder.stream(ids[k : k + chunk].tolist() for k in range(0, len(ids), chunk))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(raw, pa.binary()), pa.array(out, pa.string())], ["doc_id", "ids", "bytes", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary, bytes binary, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256`` (of the decimal ids with spaces between), ``decoded_sha256`` and
    ``whole`` (whether the decoded stream is the text again) of each row's whole text, encoded and decoded by ``path``."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(Transducer(load_ranks(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = shared.value
        encode, decoder = rank_encoder(transducer), Decoder(transducer.labels)
        decimal = {i: str(i).encode() for i in transducer.labels}.__getitem__
        sha = hashlib.sha256
        for batch in gathered(batches):
            sizes, first, second, same = [], [], [], []
            given = batch.column("text").to_pylist()
            with uncollected():
                all_ids = encode(given)
            for text, x in zip(given, all_ids, strict=True):
                ids = memoryview(x).cast("I").tolist() if x else []
                out = decoder.text(ids)
                sizes.append(len(ids))
                first.append(sha(b" ".join(map(decimal, ids))).hexdigest())
                second.append(sha(decoder.raw(ids) if "�" in out else out.encode()).hexdigest())
                same.append(out == text)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string()), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "whole"])

    return texts(docs).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, whole boolean")
