"""Operator 2: BPE encoding and decoding as a bounded-lookahead streaming transducer.

For a prefix of a word, BPE's encoding ends in exactly one token, and left of any
token boundary the encoding is that of the shorter prefix alone. So the
transducer keeps, for each recent position, the last token of the prefix that
ends there; a token may follow another if BPE applied to the two leaves them as
they are. No token is longer than ``lookahead`` symbols, a figure computed from
the merge list; hence every continuation has a boundary among the last
``lookahead`` positions, and a token that lies on the back paths of all of them
can never change: it is emitted and forgotten. Memory per word is constant, and
the memo tables are bounded.

Decoding feeds the tokens' bytes, piece by piece, to an incremental UTF-8 state
machine. ``style="joined"`` gives what the tokenizers library gives for a file
without a decoder (token strings joined by blanks); ``style="text"`` undoes the
byte alphabet and the word ends.

The vocabulary file's path is a parameter; the driver reads it and broadcasts
its contents, at most ``MAX_FILE_BYTES``. Defined results: a null text is empty
and has no tokens; repeated rows each get a row; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import codecs
import json
import os
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

MAX_FILE_BYTES = 64 << 20
MEMO_WORDS = 800_000
MEMO_PREFIXES = 400_000
MEMO_PAIRS = 1_000_000
CHUNK = 1 << 12


def byte_alphabet() -> list[str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others
    follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        out[b] = chr(b) if b in plain else chr(256 + extra)
        extra += b not in plain
    return out


class Vocabulary:
    """Contents of a tokenizer file: tokens, merges, added tokens, split pattern."""

    def __init__(self, spec: dict):
        model = spec["model"]
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] \
                or [x["type"] for x in splits] != ["Split", "ByteLevel"] or model.get("unk_token"):
            raise ValueError("only word-level BPE files with NFC, blanks, lower case and byte symbols are supported")
        self.tokens: dict[str, int] = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.rank = {}
        for r, (a, b) in enumerate(pairs):
            left, right = self.tokens[a], self.tokens[b]
            self.rank[left, right] = (r, self.tokens[a + b])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.tokens.items()} | {i: s for s, i in self.added.items()}
        self.pattern: str = splits[0]["pattern"]["Regex"]

    @staticmethod
    def load(path: str) -> Vocabulary:
        if os.path.getsize(path) > MAX_FILE_BYTES:
            raise ValueError(f"{path}: larger than the broadcast bound MAX_FILE_BYTES")
        with open(path, encoding="utf-8") as f:
            return Vocabulary(json.load(f))

    def symbols(self, token: str) -> list[str]:
        """Base symbols of a token; the word end belongs to the last one."""
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[:-len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    def sufficient_lookahead(self) -> int:
        """Symbols of the longest token that the merges can make."""
        made = {self.strings[out] for _, out in self.rank.values()}
        return max((len(self.symbols(s)) for s in made), default=1)

    def reach(self) -> dict[str, int]:
        """Symbols of the longest token by its last two symbols."""
        out: dict[str, int] = {}
        for s in self.tokens:
            symbols = self.symbols(s)
            if len(symbols) > 1:
                end = "".join(symbols[-2:])
                out[end] = max(out.get(end, 0), len(symbols))
        return out


class Transducer:
    """Emits the tokens of one word after another; ``push`` takes a symbol,
    ``close`` ends the word. Both return the ids that have become stable.
    ``push`` may be given a word's symbols one by one or many at once."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.lookahead = vocabulary.sufficient_lookahead()
        self.reach = vocabulary.reach()
        self._pair: dict[tuple[int | None, int], bool] = {}
        self._prefix: dict[str, tuple[int, int]] = {}  # last token and its start, for prefixes of words
        self._reset()

    def _reset(self) -> None:
        # position 0 is the last stable boundary; last token and its start by position
        self.text, self.last, self.back, self.left = "", [None], [0], None

    def _plain(self, ids: list[int]) -> list[int]:
        """BPE by repeatedly joining the leftmost pair of least rank."""
        get, never = self.v.rank.get, (1 << 60, 0)
        steps = [get(p, never) for p in zip(ids, ids[1:], strict=False)]
        while steps:
            step = min(steps)
            if step is never:
                break
            i = steps.index(step)
            ids[i:i + 2] = [step[1]]
            del steps[i]
            if i:
                steps[i - 1] = get((ids[i - 1], ids[i]), never)
            if i < len(steps):
                steps[i] = get((ids[i], ids[i + 1]), never)
        return ids

    def _base(self, token: int) -> list[int]:
        return [self.v.tokens[s] for s in self.v.symbols(self.v.strings[token])]

    def _fits(self, a: int | None, b: int) -> bool:
        """May token b follow token a (None: start a word)?"""
        ok = self._pair.get((a, b))
        if ok is None:
            if len(self._pair) >= MEMO_PAIRS:
                self._pair.clear()
            if a is None:
                ok = self._plain(self._base(b)) == [b]
            else:
                ok = self._fits(None, b) and self._plain(self._base(a) + self._base(b)) == [a, b]
            self._pair[a, b] = ok
        return ok

    def _find(self, prefix: str, end: str) -> tuple[int, int]:
        """Last token of a prefix, and where it starts."""
        i, last, pair, get = len(prefix), self.last, self._pair, self.v.tokens.get
        for j in range(max(0, i - self.reach.get(prefix[-2:] + end, 1)), i):
            t = get(prefix[j:] + end)
            if t is not None:
                before = last[j] if j else self.left
                fits = pair.get((before, t))
                if fits or fits is None and self._fits(before, t):
                    return t, j
        raise ValueError(f"symbol {prefix[-1]!r} is not in the vocabulary")

    def _path(self, at: int) -> list[int]:
        out = []
        while at:
            out.append(self.last[at])
            at = self.back[at]
        return out[::-1]

    def push(self, symbols: str) -> list[int]:
        """Take further symbols; the last one waits, as the word may end with it."""
        out: list[int] = []
        text, last, back, memo = self.text + symbols, self.last, self.back, self._prefix
        while len(last) < len(text):
            i = len(last)
            prefix = text[:i]
            found = memo.get(prefix) if self.left is None and i <= 16 else None
            if found is None:
                found = self._find(prefix, "")
                if self.left is None and i <= 16:
                    if len(memo) >= MEMO_PREFIXES:
                        memo.clear()
                    memo[prefix] = found
            last.append(found[0])
            back.append(found[1])
            if i >= 4 * self.lookahead:
                open_ = set(range(i - self.lookahead + 1, i + 1))
                while len(open_) > 1:
                    top = max(open_)
                    open_.discard(top)
                    open_.add(back[top])
                at = open_.pop()
                if at:
                    stable = self._path(at)
                    out += stable
                    self.left = stable[-1]
                    text = text[at:]
                    last = self.last = [None, *last[at + 1:]]
                    back = self.back = [0, *(b - at for b in back[at + 1:])]
        self.text = text
        return out

    def close(self) -> list[int]:
        out: list[int] = []
        if self.text:
            t, j = self._find(self.text, self.v.suffix)
            out = [*self._path(j), t]
        self._reset()
        return out


class Encoder:
    """Text to ids, word by word."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.machine = Transducer(vocabulary)
        self.letters = dict(enumerate(byte_alphabet()))
        self.memo: dict[str, tuple[int, ...]] = {}
        # \s of the file's pattern means Unicode White_Space
        self.split = regex.compile(vocabulary.pattern.replace(r"\s", r"\p{White_Space}"))
        # in lower-cased ASCII the classes are these; the standard module is faster
        plain = vocabulary.pattern.replace(r"\s", r"\x09-\x0D\x20").replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9")
        self.split_ascii = re.compile(plain)
        self.blanks = regex.compile(r"\p{White_Space}+")
        special = sorted(vocabulary.added, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None

    def word(self, word: str) -> tuple[int, ...]:
        ids = self.memo.get(word)
        if ids is None:
            symbols = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)
            out: list[int] = []
            for k in range(0, len(symbols), CHUNK):
                out += self.machine.push(symbols[k:k + CHUNK])
            ids = tuple(out + self.machine.close())
            if len(word) <= 64:
                if len(self.memo) >= MEMO_WORDS:
                    self.memo.clear()
                self.memo[word] = ids
        return ids

    def normalise(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            # each character on its own: no final sigma
            text = self.blanks.sub(" ", text).replace("Σ", "σ")
            return text.lower()
        return text.lower()

    def encode(self, text: str) -> np.ndarray:
        parts = [text] if self.special is None or "<|" not in text else self.special.split(text)
        out = []
        for p in parts:
            if p in self.v.added:
                out.append((self.v.added[p],))
            else:
                p = self.normalise(p)
                words = (self.split_ascii if p.isascii() else self.split).findall(p)
                ids = list(map(self.memo.get, words))
                out += ids if None not in ids else [self.word(w) if i is None else i
                                                    for w, i in zip(words, ids, strict=True)]
        return np.fromiter(chain.from_iterable(out), np.int32)


class Decoder:
    """Ids to text through an incremental UTF-8 state machine."""

    def __init__(self, vocabulary: Vocabulary, style: str = "joined"):
        if style not in ("joined", "text"):
            raise ValueError(f"unknown style {style!r}")
        byte_of = {c: bytes([b]) for b, c in enumerate(byte_alphabet())}
        self.pieces: dict[int, bytes] = {}
        for i, s in vocabulary.strings.items():
            if style == "joined" or s in vocabulary.added:
                self.pieces[i] = s.encode() + b" " * (style == "joined")
            else:
                ends = bool(vocabulary.suffix) and s.endswith(vocabulary.suffix)
                body = s[:len(s) - len(vocabulary.suffix)] if ends else s
                self.pieces[i] = b"".join(byte_of[c] for c in body) + b" " * ends
        self.trim = style == "joined"

    def decode(self, ids) -> str:
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        out = []
        for k in range(0, len(ids), 8 * CHUNK):
            piece = b"".join(map(self.pieces.__getitem__, ids[k:k + 8 * CHUNK]))
            out.append(machine.decode(piece))
        out.append(machine.decode(b"", True))
        text = "".join(out)
        return text[:-1] if self.trim else text.removesuffix(" ")


_CODERS: dict[tuple, tuple[Encoder, Decoder]] = {}


def _coders(vocabulary: Vocabulary, path: str, style: str) -> tuple[Encoder, Decoder]:
    """One pair per worker process, so that later tasks find its bounded memos filled."""
    key = (path, len(vocabulary.tokens), len(vocabulary.rank), style)
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Encoder(vocabulary), Decoder(vocabulary, style)
    return _CODERS[key]


def _broadcast(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast(Vocabulary.load(path))


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", style: str = "joined") -> DataFrame:
    """``key, ids, decoded``: token ids of every text and what they decode to."""
    vocabulary = _broadcast(docs.sparkSession, path)
    rows = docs.select(key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, dec = _coders(vocabulary.value, path, style)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                b = batch.slice(k, 256)
                ids = [enc.encode(t or "") for t in b.column(1).to_pylist()]
                ends = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
                     pa.array([dec.decode(x.tolist()) for x in ids], pa.string())], names=[key, "ids", "decoded"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {kind}, ids array<int>, decoded string")


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids", style: str = "text") -> DataFrame:
    """``key, text`` of stored ids; null ids decode to the empty text."""
    vocabulary = _broadcast(encoded.sparkSession, path)
    rows = encoded.select(key, ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dec = Decoder(vocabulary.value, style)
        for b in batches:
            texts = [dec.decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {kind}, text string")
