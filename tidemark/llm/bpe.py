"""BPE encoding and decoding through a tokenization automaton.

The automaton reads *tokens* and accepts exactly the token sequences that the merge list produces. It starts with one
state in which every byte loops. Each merge ``(a, b)`` adds one gadget: the state behind ``a`` is copied without its
arc on ``b`` (the two may no longer stand side by side), and every state that has an arc on ``a`` gets an arc on
``ab`` that leads to the state ``b`` led to before the copy. The state reached depends on the last token only, so the
automaton is deterministic, and each prefix of a word ends exactly one accepted path. All rows of arcs are built once, as ranges of
token numbers, and words are encoded by looking arcs up in them.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import gathered, small_batches, texts

#: Entries after which a worker's memory of words starts afresh.
MEMORY = 700_000
#: The same where most pieces are encoded a batch at a time and only odd ones are remembered, for as long as a worker lives.
LIBRARY_MEMORY = 50_000
#: Pieces that one call of the library takes.
PART = 20_000
#: Pre-split of byte-level BPE with white space spelled out: fixed values of the vocabulary's public format.
SPACE = r"\t\n\v\f\r \x85\xa0  -     　"
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Pieces of letters only, in ranges where every character is one.
LETTERS = r"^[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]+$"
#: Marks that follow words; neither letters, numbers nor white space.
MARKS = ".,;:!?*$%&#"
#: A space beside other white space: only there can a space fail to begin a word.
WIDE = r"\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}"
IRREGULAR = rf" [\t\n\v\f\r {WIDE}]|[\t\n\v\f\r {WIDE}] "


def byte_symbols() -> dict[str, int]:
    """The printable symbol that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """Merges compiled by successive gadgets into a table; ``labels`` are the bytes that each token's arc emits.

    Tokens are numbered so that each token is followed by those that were made with it on the left, the latest merge
    first. An arc on ``b`` that is lost takes with it the arcs on all tokens that are made from ``b`` later: one range of
    numbers. A state's row is the sorted list of ranges it has no arc on; all other arcs exist."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]], special: dict[str, int]):
        self.labels, self.special = labels, special
        rank: dict[int, int] = {}
        children: dict[int, list[int]] = {}
        for when, (a, _, ab) in enumerate(merges):
            if ab in rank:
                raise ValueError(f"two merges make token {ab}")
            rank[ab] = when
            children.setdefault(a, []).append(ab)
        live = {t for t, x in labels.items() if len(x) == 1}
        size = max(labels, default=0) + 1
        self.number = array("i", [-1]) * size
        until = array("i", [-1]) * size  # the last number among those made from a token
        count = 0
        stack = [(t, False) for t in sorted(live, reverse=True)]
        while stack:
            t, done = stack.pop()
            if done:
                until[t] = count - 1
                continue
            self.number[t] = count
            count += 1
            stack.append((t, True))
            stack += [(x, False) for x in children.get(t, ())]  # the latest comes off first
        rows: dict[int, tuple[list[int], list[int]]] = {t: ([], []) for t in live}
        for when, (a, b, ab) in enumerate(merges):
            if a not in live or b not in live:
                continue
            lows, highs = rows[a]
            at = bisect_right(lows, self.number[b])
            if at and highs[at - 1] >= self.number[b]:
                continue  # the arc is gone: this merge never applies
            rows[ab] = (list(rows[b][0]), list(rows[b][1]))
            live.add(ab)
            made = children.get(b, [])
            later = bisect_left(made, when, key=rank.__getitem__)  # where a is b, the token made now too
            lows.insert(at, self.number[b])
            highs.insert(at, until[made[later]] if later < len(made) else self.number[b])
        #: The ranges of state ``t`` are ``low[i]`` to ``high[i]`` for ``first[t] <= i < first[t + 1]``.
        self.first, self.low, self.high = array("i", [0]), array("i"), array("i")
        for t in range(size):
            for low, high in zip(*rows.get(t, ((), ())), strict=True):
                if len(self.low) > self.first[t] and self.high[-1] == low - 1:
                    self.high[-1] = high
                else:
                    self.low.append(low)
                    self.high.append(high)
            self.first.append(len(self.low))
        #: Labels byte by byte: the next node for a node and a byte; the token that ends at a node, or -1.
        self.steps: dict[int, int] = {}
        self.ends: list[int] = [-1]
        for t in sorted(live):
            node = 0
            for byte in labels[t]:
                node = self.steps.setdefault(node << 8 | byte, len(self.ends))
                if node == len(self.ends):
                    self.ends.append(-1)
            self.ends[node] = t

    @classmethod
    def load(cls, path: str) -> Automaton:
        """From a tokenizer file with a byte-level BPE model."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if model.get("type", "BPE") != "BPE" or spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE without normaliser, prefix space or dropout is supported")
        vocab, symbols = model["vocab"], byte_symbols()
        labels = {i: bytes(symbols[c] for c in s) for s, i in vocab.items() if set(s) <= symbols.keys()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        return cls(labels, merges, special)

    def arc(self, state: int, token: int) -> bool:
        """Whether the state behind the token ``state`` has an arc on ``token``."""
        x = self.number[token]
        at = bisect_right(self.low, x, self.first[state], self.first[state + 1]) - 1
        return at < self.first[state] or self.high[at] < x

    def encode_word(self, word: bytes) -> list[int]:
        """The token ids on the one accepted path that spells ``word``.

        Each prefix is spelt by one accepted path, so its state is known when its end is reached, and a place that has
        its state is never looked at again. The state at the end of ``word`` leads back to its beginning."""
        n, step, ends, number, first, low, high = len(word), self.steps.get, self.ends, self.number, self.first, self.low, self.high
        states = [-1] * (n + 1)
        for i in range(n):
            state = states[i]
            if state >= 0:
                begin, end = first[state], first[state + 1]
            elif i:
                continue
            node = 0
            for j in range(i, n):
                node = step(node << 8 | word[j])
                if node is None:
                    break
                token = ends[node]
                if token >= 0 and states[j + 1] < 0:
                    if i:
                        x = number[token]
                        at = bisect_right(low, x, begin, end) - 1
                        if at >= begin and high[at] >= x:
                            continue
                    states[j + 1] = token
            if states[n] >= 0:
                break
        path: list[int] = []
        while n:
            if states[n] < 0:
                raise ValueError(f"no accepted path spells {word!r}")
            path.append(states[n])
            n -= len(self.labels[states[n]])
        return path[::-1]

    def decode(self, ids: list[int]) -> bytes:
        """The labels of the arcs on a path, one after the other."""
        labels = self.labels
        return b"".join([labels[i] for i in ids])


class Encoder:
    """Whole texts to ids, as little-endian unsigned 32-bit integers.

    A space between two characters that are not white space always begins a word, so texts are cut there and each
    distinct piece is encoded once as long as it is remembered. A key of the memory is a piece without the space
    before it; a piece that has none is kept under a key that begins with a space. ``encode_many`` maps keys to ids."""

    def __init__(self, encode_many, special: dict[str, int], encode_array=None, limit: int = MEMORY):
        self.encode_many, self.encode_array, self.limit = encode_many, encode_array, limit
        self.split = regex.compile("(" + "|".join(map(regex.escape, special)) + ")").split if special else None
        self.special = {k: v.to_bytes(4, "little") for k, v in special.items()}
        self.words = regex.compile(WORDS).findall
        self.memory: dict[str, bytes] = {}

    def _values(self, keys: list[str]) -> list[bytes]:
        """Ids of distinct keys; new ones are encoded and remembered."""
        memory = self.memory
        if len(memory) > self.limit:
            memory.clear()
        values = list(map(memory.get, keys))
        missing = [k for k, v in zip(keys, values, strict=True) if v is None]
        if missing:
            found = dict(zip(missing, self.encode_many(missing), strict=True))
            memory.update(found)
            values = [v if v is not None else found[k] for k, v in zip(keys, values, strict=True)]
        return values

    def _remembered(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each key has, and all ids in a row."""
        keys = keys.to_pylist()
        asked = [k for k in keys if k]
        known = dict(zip(asked, self._values(asked), strict=True)) | {"": b""}
        values = list(map(known.__getitem__, keys))
        return np.fromiter(map(len, values), np.int64, len(values)) // 4, np.frombuffer(b"".join(values), "<u4")

    def _regular(self, texts: list[str]) -> list[bytes]:
        """Texts where every space begins a word: cut at spaces, look up distinct pieces, put their ids in line."""
        pieces = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        ends = pieces.offsets.to_numpy()
        coded = pieces.flatten().dictionary_encode()
        at = coded.indices.to_numpy().copy()
        pieces = coded.dictionary
        # a text's first piece has no space before it; an empty last one is the space that ends the text
        extra: dict[str, int] = {}
        for i in np.flatnonzero(ends[1:] - ends[:-1] > 1).tolist():
            if not pieces[at[ends[i + 1] - 1]].as_py():
                at[ends[i + 1] - 1] = extra.setdefault("  ", len(pieces) + len(extra))
        for i in ends[:-1].tolist():
            word = pieces[at[i]].as_py()
            at[i] = extra.setdefault(" " + word if word else "", len(pieces) + len(extra))
        sizes, ids = (self.encode_array or self._remembered)(pieces)
        more = self._remembered(pa.array(list(extra), pa.large_string()))
        sizes, ids = np.concatenate((sizes, more[0])), np.concatenate((ids, more[1]))
        n = sizes[at]
        line = ids[spread((np.cumsum(sizes) - sizes)[at], n)].tobytes()
        cuts = (np.concatenate(([0], np.cumsum(n)))[ends] * 4).tolist()
        return [line[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _plain(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        odd = pc.match_substring_regex(pa.array(texts, pa.large_string()), IRREGULAR).to_pylist()
        regular = [i for i, x in enumerate(odd) if not x]
        if regular:
            for i, x in zip(regular, self._regular([texts[i] for i in regular]), strict=True):
                out[i] = x
        for i, text in enumerate(texts):
            if out[i] is None:
                keys = [key_of(w) for w in self.words(text)]
                distinct = list(dict.fromkeys(keys))
                known = dict(zip(distinct, self._values(distinct), strict=True))
                out[i] = b"".join(map(known.__getitem__, keys))
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        if self.split is None or not any(x in text for text in texts for x in self.special):
            return self._plain(texts)
        parts = [self.split(text) for text in texts]
        plain = iter(self._plain([x for p in parts for x in p if x not in self.special]))
        return [b"".join([self.special.get(x) or next(plain) for x in p]) for p in parts]


def spread(begins: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``n[i]`` places that follow each other from each ``begins[i]`` on, in 32 bits where they fit."""
    until = np.cumsum(n)
    total = int(until[-1]) if len(until) else 0
    kind = np.int32 if total < 1 << 31 and (not len(begins) or int(begins.max()) < 1 << 31) else np.int64
    out = np.repeat((begins - until + n).astype(kind), n)
    out += np.arange(total, dtype=kind)
    return out


def key_of(word: str) -> str:
    """The memory key of a word that the pre-split gave."""
    return word[1:] if word[0] == " " and not word[1:2].isspace() and len(word) > 1 else " " + word


def piece_of(key: str) -> str:
    """The piece of text behind a memory key."""
    return key[1:] if key[0] == " " else " " + key


def word_encoder(encode_words, special: dict[str, int], limit: int = MEMORY) -> Encoder:
    """An encoder that splits pieces into words and gives distinct new words to ``encode_words``, many at a time."""
    split = regex.compile(WORDS).findall

    def many(keys: list[str]) -> list[bytes]:
        memory = encoder.memory
        known: dict[str, bytes] = {}
        parts: dict[str, list[str]] = {}
        new: dict[str, None] = {}
        for k in keys:
            if k.isalpha():
                new[k] = None
                continue
            stem = k.rstrip(MARKS)
            if stem.isalpha():  # a word and the marks behind it
                parts[k] = words = [stem, " " + k[len(stem) :]]
            else:
                parts[k] = words = [key_of(w) for w in split(piece_of(k))]
            for w in words:
                if w not in new:
                    ids = memory.get(w)
                    if ids is None:
                        new[w] = None
                    else:
                        known[w] = ids
        known.update(zip(new, encode_words(list(map(piece_of, new))), strict=True))
        return [known[k] if k not in parts else b"".join([known[w] for w in parts[k]]) for k in keys]

    encoder = Encoder(many, special, limit=limit)
    return encoder


def automaton_encoder(automaton: Automaton) -> Encoder:
    """An encoder that runs each word through the automaton."""
    return word_encoder(lambda words: [array("I", automaton.encode_word(w.encode())).tobytes() for w in words], automaton.special)


def library_encoder(tokenizer, special: dict[str, int]) -> Encoder:
    """An encoder that gives words to the tokenizers library, whose model encodes many in one call.

    The words are already split, so they go in as the model's own byte symbols with white space between them."""
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import WhitespaceSplit

    model = Tokenizer(tokenizer.model)
    model.pre_tokenizer = WhitespaceSplit()
    symbols = {b: c for c, b in byte_symbols().items()}
    spaced = symbols | {0x20: " " + symbols[0x20]}
    sizes = np.array([len(tokenizer.id_to_token(i) or "") for i in range(tokenizer.get_vocab_size())])

    begins = np.array([(tokenizer.id_to_token(i) or "").startswith("Ġ") for i in range(tokenizer.get_vocab_size())])

    def run(encoder, text: str) -> np.ndarray:
        return np.array(encoder.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def words(lengths: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Words given as symbols with spaces between: a token's symbols are its bytes, so a word ends with its last byte."""
        ids = run(model, text)
        ends = np.searchsorted(np.cumsum(sizes[ids]), np.cumsum(lengths)) + 1
        return np.diff(ends, prepend=0), ids

    def encode(words_: list[str]) -> list[bytes]:
        if not words_:
            return []
        raw = [w.encode() for w in words_]
        n, ids = words(np.array([len(x) for x in raw]), " ".join([x.decode("latin-1").translate(symbols) for x in raw]))
        whole, cuts = ids.tobytes(), [0, *(np.cumsum(n) * 4).tolist()]
        return [whole[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def letters(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of letters that each follow one space."""
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(pieces)], pa.int32()), pieces), pa.scalar(" ", pieces.type))[0].as_py()
        return words(pc.binary_length(pieces).to_numpy() + 1, symbols[0x20] + text.encode().decode("latin-1").translate(spaced))

    def others(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Any other pieces that each follow one space and hold none."""
        ids = run(tokenizer, " " + " ".join(pieces.to_pylist()))
        return np.diff(np.flatnonzero(begins[ids]), append=len(ids)), ids

    def by_parts(encode_some, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        done = [encode_some(pieces.slice(start, PART)) for start in range(0, len(pieces), PART)]
        return np.concatenate([np.zeros(0, np.int64), *(n for n, _ in done)]), np.concatenate([np.zeros(0, "<u4"), *(ids for _, ids in done)])

    def array_(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pieces that each follow one space and hold none. Marks behind letters are words of their own, so the
        distinct words before them go to the model; whatever is left is split by the library."""
        stems = pc.utf8_rtrim(pieces, characters=MARKS)
        lettered = pc.match_substring_regex(stems, LETTERS)
        filled = pc.greater(pc.binary_length(pieces), 0)
        odd = pc.and_(filled, pc.invert(lettered))
        coded = stems.filter(lettered).dictionary_encode()
        tails = pc.replace_substring_regex(pieces.filter(lettered), LETTERS[:-1], "").dictionary_encode()
        parts = []  # where pieces lie, the sizes and ids of what they may be, and which one each of them is
        at = np.flatnonzero(lettered.to_numpy(zero_copy_only=False))
        parts.append((at, *by_parts(letters, coded.dictionary), coded.indices.to_numpy()))
        keys = pa.array([" " + x if x else "" for x in tails.dictionary.to_pylist()], pa.large_string())
        parts.append((at, *encoder._remembered(keys), tails.indices.to_numpy()))
        at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        parts.append((at, *by_parts(others, pieces.filter(odd)), np.arange(len(at))))
        counts = np.zeros(len(pieces), np.int64)
        for at, n, _, which in parts:
            counts[at] += n[which]
        places = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), "<u4")
        for at, n, ids, which in parts:
            out[spread(places[at], n[which])] = ids[spread((np.cumsum(n) - n)[which], n[which])]
            places[at] += n[which]
        return counts, out

    encoder = word_encoder(encode, special, LIBRARY_MEMORY)
    encoder.encode_array = array_
    return encoder


@lru_cache(maxsize=2)
def worker_encoder(spec: str) -> Encoder:
    """The library's encoder of a tokenizer file's text, made once for each Python worker."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(spec)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return library_encoder(tokenizer, {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()})


def encode_documents(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` (and ``ids``, binary) of each row's whole text.

    Ids are those of the tokenizer file ``path``, whose automaton is compiled once and broadcast (its size is that of
    the vocabulary, whatever the data). Null texts count as empty: no tokens. Repeated rows give repeated results; an
    empty table gives an empty result; no row moves between partitions."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(Automaton.load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        encode = automaton_encoder(automaton)
        labels = {**automaton.labels, **{i: s.encode() for s, i in automaton.special.items()}}
        emit = labels.__getitem__
        sha = hashlib.sha256
        for batch in gathered(batches):
            ids = encode(batch.column("text").to_pylist())
            decoded = [b"".join(map(emit, memoryview(x).cast("I"))) if x else b"" for x in ids]
            columns = [batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([sha(x).hexdigest() for x in ids]), pa.array([sha(x).hexdigest() for x in decoded])]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(ids, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts(docs).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids)
