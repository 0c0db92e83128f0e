"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

For a word, an Aho-Corasick automaton over the whole vocabulary gives the longest token that starts at each place. The
encoder takes the longest token that is compatible with the one before it; where none fits it steps back, and a place
from which no way on was found is not tried again, so the time is linear in the word. Two tokens are compatible
if no merge across their border would come before the merges that make the two; this is found by walking the two spines
at the border in the order of merge ranks, and is kept in a table of pairs. The result is what merging by rank gives.

Texts within Latin-1 are cut into pre-tokens at once; others go through the vocabulary's own normaliser and
pre-tokenizer by chunks between ASCII white space, which neither crosses. Each worker keeps bounded tables of what it has encoded. Decoding copies each id's bytes from one buffer by a table of offsets.

Edge cases: null and empty texts have no ids and decode to the empty text. Texts are encoded whole, however long. The strings of special
tokens within a text become their ids, as in the tokenizers library. Rows are independent: there is no shuffle, repeated rows are encoded each, and there are no ties. An empty
table stays empty. Columns that bear the names of the results are replaced by these; others stay, whatever their names.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from confab.llm.common import texts_of

#: Words and pairs that a worker keeps before it starts its tables anew (of chunks, a quarter), and the longest word kept: some 150 MB together.
KEPT, KEPT_LENGTH = 800_000, 64
_NEVER = 1 << 60
#: Moves a word's last character to a private range, so that "x at the word's end" is one symbol.
_END = 0x10000


def byte_marks() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable bytes stand for themselves, the rest follow from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Vocabulary:
    """A tokenizers file with a BPE model whose words end in a suffix: encodes chunks, decodes ids."""

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        model, self.suffix = spec["model"], spec["model"].get("end_of_word_suffix") or ""
        ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.marks = str.maketrans(dict(enumerate(byte_marks())))
        size = max([*ids.values(), *self.special.values()]) + 1
        names = [""] * size
        for t, i in [*ids.items(), *self.special.items()]:
            names[i] = t
        # the offset table for decoding
        raw = [t.encode() for t in names]
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
        # merges
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            made = ids[a + b]
            self.rank[ids[a], ids[b]] = r
            self.parts.setdefault(made, (ids[a], ids[b], r))
        self._left: dict[int, list[tuple[int, int]]] = {}
        self._right: dict[int, list[tuple[int, int]]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, bytes] = {}
        self.chunks: dict[bytes, bytes] = {}
        units = {i: self._units(t) for t, i in ids.items()}
        live: dict[str, int] = {}
        for i in sorted(units, key=lambda i: self.parts[i][2] if i in self.parts else -1):
            if i not in self.parts:
                if len(units[i]) == 1:
                    live[units[i]] = i
            elif units[self.parts[i][0]] in live and units[self.parts[i][1]] in live and self._apart(*self.parts[i]):
                live[units[i]] = i
        self.length = {i: len(u) for u, i in live.items()}
        self.shorter: dict[int, int | None] = {}
        self.trie = ahocorasick.Automaton()
        for u, i in live.items():
            self.trie.add_word(u, (i, len(u)))
            self.shorter[i] = next((live[u[:n]] for n in range(len(u) - 1, 0, -1) if u[:n] in live), None)
        self.trie.make_automaton()

    def _units(self, token: str) -> str:
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return body[:-1] + chr(ord(body[-1]) + _END)
        return token

    def _spine(self, token: int, side: int, kept: dict) -> list[tuple[int, int]]:
        """From the outermost symbol at one side up to the token: each piece and the rank at which it goes into the next."""
        if token not in kept:
            out, at, rank = [], token, _NEVER
            while True:
                out.append((at, rank))
                if at not in self.parts:
                    break
                rank = self.parts[at][2]
                at = self.parts[at][side]
            kept[token] = out[::-1]
        return kept[token]

    def _apart(self, a: int, b: int, until: int = _NEVER) -> bool:
        """Whether no merge across the border of a and b comes before both are whole; merges of rank ``until`` and later don't count."""
        left, right = self._spine(a, 1, self._left), self._spine(b, 0, self._right)
        i = j = 0
        while True:
            (x, gone_x), (y, gone_y) = left[i], right[j]
            across = self.rank.get((x, y), _NEVER)
            if across < until and across < gone_x and across <= gone_y:
                return False  # of equal ranks the leftmost merge comes first
            if gone_x == gone_y == _NEVER:
                return True
            if gone_x <= gone_y:
                i += 1
            else:
                j += 1

    def _compatible(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > KEPT:
                self.pairs.clear()
            known = self.pairs[a, b] = self._apart(a, b)
        return known

    def encode_word(self, word: str) -> list[int]:
        """``word``: byte marks of one pre-token."""
        units = word[:-1] + chr(ord(word[-1]) + _END) if self.suffix else word
        n, length, pairs = len(units), self.length, self.pairs
        longest: list[int | None] = [None] * n
        for end, (token, size) in self.trie.iter(units):
            longest[end - size + 1] = token
        dead, out, at, last = set(), [], 0, -1
        token = longest[0]
        while at < n:
            while token is not None:
                end = at + length[token]
                if end not in dead:
                    if last < 0:
                        break
                    fits = pairs.get((last, token))
                    if self._compatible(last, token) if fits is None else fits:
                        break
                token = self.shorter[token]
            if token is None:  # no way on from here
                dead.add(at)
                token = out.pop()
                at -= length[token]
                last = out[-1] if out else -1
                token = self.shorter[token]
            else:
                out.append(token)
                at, last = end, token
                token = longest[at] if at < n else None
        return out

    def _word(self, piece: str, marked: bool = False) -> bytes:
        """The packed ids of one pre-token; ``marked``: it is in byte marks already."""
        if len(self.words) > KEPT:
            self.words.clear()
        marks = piece if marked or piece.isascii() and piece.isalnum() else piece.encode().decode("latin-1").translate(self.marks)
        ids = self.encode_word(marks)
        out = struct.pack(f"<{len(ids)}i", *ids)
        if len(piece) <= KEPT_LENGTH:
            self.words["\uffff" + piece if marked else piece] = out
        return out

    def encode_chunk(self, chunk: bytes) -> bytes:
        """The ids, as little-endian 32-bit numbers, of any text without ASCII white space."""
        out = []
        text = chunk.decode()
        for part in self.special_split.split(text) if self.special_split and "<" in text else (text,):
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
            elif part:
                normal = self.library.normalizer.normalize_str(part)
                out += [self.words.get("\uffff" + p) or self._word(p, True) for p, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]
        return b"".join(out)

    def encode(self, text: bytes) -> bytes:
        """The ids of a whole UTF-8 text, as little-endian 32-bit numbers."""
        plain = text.decode()
        try:
            if "<" in plain and any(t in plain for t in self.special):
                raise ValueError
            plain.encode("latin-1")
        except ValueError:  # beyond Latin-1, or with special tokens: by chunks
            words, known = text.split(), self.chunks
            if len(known) > KEPT // 4:
                known.clear()
            own = {w: self.encode_chunk(w) for w in {*words}.difference(known)}
            known.update((w, x) for w, x in own.items() if len(w) <= KEPT_LENGTH)
            return b"".join([own[w] if w in own else known[w] for w in words])
        pieces, known = _LATIN.findall(plain.lower()), self.words
        try:
            return b"".join(map(known.__getitem__, pieces))
        except KeyError:
            for p in {*pieces}.difference(known):
                self._word(p)
        try:
            return b"".join(map(known.__getitem__, pieces))
        except KeyError:  # the table was started anew in between, or a word is too long to be kept
            return b"".join(known.get(p) or self._word(p) for p in pieces)

    def decode(self, ids: np.ndarray) -> bytes:
        """The ids' tokens joined by spaces, as the library does for a vocabulary without a decoder."""
        if not len(ids):
            return b""
        starts, lengths = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(lengths + 1)
        place = np.arange(ends[-1]) - np.repeat(ends - lengths - 1 - starts, lengths + 1)
        gaps = ends - 1
        place[gaps] = 0
        out = self.bytes[place]
        out[gaps] = 32
        return out[:-1].tobytes()


#: The pre-tokenizer's pattern, for lower-case texts within Latin-1 (where no character changes under NFC).
_LATIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\x09-\x0d\x20\x85\xa0a-z0-9\xaa\xb5\xba\xdf-\xf6\xf8-\xff\xb2\xb3\xb9\xbc-\xbe]+")
_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The worker's own copy, read once."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with the text's ids (array of int) in place of the text and, if asked for, the text that these decode to."""
    keep = [f for f in docs.schema if f.name not in (text, ids, decoded)]
    out = T.StructType([*keep, T.StructField(ids, T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded, T.StringType())] if decoded else []))
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for whole in batches:
            for at in range(0, max(1, whole.num_rows), 1024):
                batch = whole.slice(at, 1024)
                packed = [vocab.encode(x) for x in texts_of(batch, text)]
                flat = np.frombuffer(b"".join(packed), "<i4")
                ends = np.cumsum([0, *(len(x) // 4 for x in packed)])
                columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())))
                if decoded:
                    columns.append(pa.array([vocab.decode(flat[a:b]).decode() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[*names, ids, *([decoded] if decoded else [])])

    return docs.select(*[f"`{n}`" for n in names], f"`{text}`").mapInArrow(run, out)
