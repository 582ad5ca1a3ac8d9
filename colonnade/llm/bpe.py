"""BPE encoding and decoding: a segment tree over the ranks of adjacent pairs.

A leaf holds rank * width + position of the pair that starts there, an inner node the smaller of its children. So the root
names the lowest-rank merge, the leftmost of equals. A merge changes three leaves, each mended up to the root, until no pair
has a rank. Words are independent, so the trees of many words are kept as rows of one array and stepped together.
"""

from __future__ import annotations

import hashlib
import json
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame, functions as F

from colonnade.llm.frames import map_rows

NONE = np.iinfo(np.int64).max
#: Bytes, about, that a Python worker spends on each of its tables of known words and pieces; beyond, those not met lately go.
KNOWN_BYTES = 24_000_000
#: What an entry takes beside its strings.
ENTRY_BYTES = 300
#: Characters of text that are worked on together.
CHUNK_CHARS = 2_000_000
#: What is white space for ``str.split`` but not for the vocabulary's patterns.
ODD_SPACE = regex.compile("[\x1c-\x1f]")
WHITE = regex.compile(r"\s+")
#: Pieces that are merged together at least; fewer, and so all very long ones, are merged one by one.
TOGETHER = 16

# The library lower-cases by Unicode 17 ...
LATER_LOWER = {
    0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B,
    **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)},
}
# ... but tells letters and digits by Unicode 16, to which these are neither.
LATER_LETTERS = (
    "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 "
    "10ED9-10EEE 11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 "
    "18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 "
    "1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
LATER_DIGITS = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"
LATER = "".join("-".join(f"\\U{int(end, 16):08X}" for end in r.split("-")) for r in f"{LATER_LETTERS} {LATER_DIGITS}".split())
IS_LATER = regex.compile(f"[{LATER}]")
HAS_LATER_CASE = regex.compile("[" + "".join(map(chr, LATER_LOWER)) + "]")


class WordBpe:
    """The vocabulary of a tokenizers file of the kind "lower-cased words, byte-level symbols, merges, word ends"."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.ids = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(split)
        older = regex.sub(r"\\p\{(L|N)\}", lambda m: f"[{m[0]}--[{LATER}]]", split)
        self.older_letters = regex.compile(older, regex.V1)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        letters = _byte_letters()
        self.inner = np.array([self.ids[c] for c in letters])
        self.last = np.array([self.ids[c + self.end] for c in letters])
        pairs = [(self.ids[a], self.ids[b], self.ids[a + b]) for a, b in model["merges"]]
        self.span = max(self.tokens) + 1
        keys = np.array([a * self.span + b for a, b, _ in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([c for _, _, c in pairs], np.int64)
        self.rank_of = dict(zip(self.keys.tolist(), self.ranks.tolist()))
        self.merged_list = self.merged.tolist()
        self.known: dict[str, tuple[bytes, str]] = {}
        self.older: dict[str, tuple[bytes, str]] = {}
        self.known_pieces: dict[str, tuple[bytes, str]] = {}
        self.older_pieces: dict[str, tuple[bytes, str]] = {}
        self.size = self.pieces_size = 0

    def forget(self) -> None:
        """Drops what is known of words; the vocabulary stays."""
        self.known, self.older, self.known_pieces, self.older_pieces = {}, {}, {}, {}
        self.size = self.pieces_size = 0

    @classmethod
    def load(cls, path: str) -> WordBpe:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it has none or where a side is missing (-1)."""
        key = left * self.span + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.keys[at] == key), self.ranks[at], NONE)

    def merge_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Token ids of each piece (a word in bytes)."""
        out: list = [None] * len(pieces)
        sizes = np.array([len(p) for p in pieces])
        wide = np.maximum(1, np.ceil(np.log2(np.maximum(sizes, 1))).astype(int))
        for bits in np.unique(wide):
            rows = np.flatnonzero(wide == bits)
            step = max(1, (1 << 19) >> bits)
            for at in range(0, len(rows), step):
                some = rows[at:at + step]
                if len(some) < TOGETHER:
                    for i in some:
                        out[i] = self._merge_one(pieces[i], 1 << int(bits))
                    continue
                for i, ids in zip(some, self._merge([pieces[i] for i in some], 1 << int(bits))):
                    out[i] = ids
        return out

    def _merge(self, pieces: list[bytes], width: int) -> Iterator[list[int]]:
        n = len(pieces)
        size = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        place = np.arange(width)
        inside = place < size[:, None]
        symbol = np.where(inside, self.inner[raw], -1)
        rows = np.arange(n)
        symbol[rows, size - 1] = self.last[raw[rows, size - 1]]
        # One column more on either side, for neighbours that do not exist.
        after = np.where(place + 1 < size[:, None], place + 1, width).astype(np.int32)
        before = np.broadcast_to(np.where(place > 0, place - 1, width), (n, width)).astype(np.int32)
        after, before, symbol = (np.column_stack([x, np.full(n, fill, x.dtype)]) for x, fill in ((after, width), (before, width), (symbol, -1)))

        def leaf(left, right, position):
            found = self.rank(left, right)
            return np.where(found == NONE, NONE, np.where(found == NONE, 0, found) * width + position)

        tree = np.full((n, 2 * width), NONE, np.int64)
        tree[:, width:] = leaf(symbol[:, :width], symbol[:, 1:], place)
        level = width
        while level > 1:
            level //= 2
            tree[:, level:2 * level] = np.minimum(tree[:, 2 * level:4 * level:2], tree[:, 2 * level + 1:4 * level:2])
        live = np.flatnonzero(tree[:, 1] != NONE)
        while len(live):
            root = tree[live, 1]
            at = root % width
            gone = after[live, at]
            behind, ahead = before[live, at], after[live, gone]
            made = self.merged[root // width]
            symbol[live, at] = made
            symbol[live, gone] = -1
            after[live, at] = ahead
            before[live, ahead] = at
            before[:, width] = width
            tree[live, width + gone] = NONE
            tree[live, width + at] = leaf(made, symbol[live, ahead], at)
            has = behind < width
            tree[live[has], width + behind[has]] = leaf(symbol[live, behind], made, behind)[has]
            touched = np.concatenate([live, live, live[has]])
            node = (np.concatenate([gone, at, behind[has]]) + width) >> 1
            while node[0]:
                tree[touched, node] = np.minimum(tree[touched, 2 * node], tree[touched, 2 * node + 1])
                node >>= 1
            live = live[tree[live, 1] != NONE]
        flat = symbol[:, :width]
        kept = flat >= 0
        ids, ends = flat[kept].tolist(), np.cumsum(kept.sum(axis=1)).tolist()
        return (ids[a:b] for a, b in zip([0, *ends], ends))

    def _merge_one(self, piece: bytes, width: int) -> list[int]:
        """Token ids of one piece by the same tree, stepped in plain numbers: a merge takes microseconds however long the piece."""
        size, span, merged = len(piece), self.span, self.merged_list
        rank_of = self.rank_of.get
        first = self.inner[np.frombuffer(piece, np.uint8)]
        first[-1] = self.last[piece[-1]]
        levels = np.full(2 * width, NONE, np.int64)
        found = self.rank(first[:-1], first[1:])
        levels[width:width + size - 1] = np.where(found == NONE, NONE, np.where(found == NONE, 0, found) * width + np.arange(size - 1))
        level = width
        while level > 1:
            level //= 2
            levels[level:2 * level] = np.minimum(levels[2 * level:4 * level:2], levels[2 * level + 1:4 * level:2])
        tree, symbol = array("q", levels.tobytes()), array("q", first.tobytes())
        # ``size`` stands behind the last symbol and -1 before the first one; neither has a pair.
        after, before = array("q", range(1, size + 1)), array("q", range(-1, size))

        def put(place: int, value: int) -> None:
            node = width + place
            tree[node] = value
            while node > 1:
                node >>= 1
                left, right = tree[2 * node], tree[2 * node + 1]
                least = left if left < right else right
                if tree[node] == least:
                    break
                tree[node] = least

        none = int(NONE)
        while tree[1] != none:
            rank, at = divmod(tree[1], width)
            gone, behind = after[at], before[at]
            ahead = after[gone]
            made = symbol[at] = merged[rank]
            symbol[gone] = -1
            after[at] = ahead
            before[ahead] = at
            put(gone, none)
            rank = rank_of(made * span + symbol[ahead]) if ahead < size else None
            put(at, none if rank is None else rank * width + at)
            if behind >= 0:
                rank = rank_of(symbol[behind] * span + made)
                put(behind, none if rank is None else rank * width + behind)
        return [s for s in symbol if s >= 0]

    def normal(self, text: str) -> str:
        """Composed and lower-cased character by character (a final sigma gets no form of its own)."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            if HAS_LATER_CASE.search(text):
                text = text.translate(LATER_LOWER)
        return text.lower()

    def _pieces_of(self, word: str) -> list[str]:
        """The pieces of a normal word; the two commonest forms need no pattern."""
        if not word.isascii() and IS_LATER.search(word):
            return self.older_letters.findall(word)
        if word.isalpha():
            return [word]
        if word[-1] in ".,!?;:" and word[:-1].isalpha():
            return [word[:-1], word[-1]]
        return self.pieces.findall(word)

    def learn(self, words: Iterable[str]) -> None:
        """Adds the encoding of each word (a run without white space) to the known ones."""
        words = list(words)
        found = [self._pieces_of(self.normal(w)) for w in words]
        distinct = {p for pieces in found for p in pieces}
        coded, rest = self._recalled(distinct, self.known_pieces, self.older_pieces)
        name = self.tokens.__getitem__
        for piece, ids in zip(rest, self.merge_pieces([p.encode("utf-8", "surrogatepass") for p in rest])):
            coded[piece] = _little(ids), " ".join(map(name, ids))
        if self.pieces_size > KNOWN_BYTES:
            self.older_pieces, self.known_pieces, self.pieces_size = self.known_pieces, {}, 0
        self.known_pieces.update(coded)
        self.pieces_size += sum(ENTRY_BYTES + 3 * len(p) for p in coded)
        for word, pieces in zip(words, found):
            if len(pieces) == 1:
                self.known[word] = coded[pieces[0]]
            else:
                self.known[word] = b"".join([coded[p][0] for p in pieces]), " ".join([coded[p][1] for p in pieces])

    @staticmethod
    def _recalled(wanted, known: dict, older: dict) -> tuple[dict, list]:
        """What is known of ``wanted``, and what is not."""
        got, missing = {}, []
        for word in wanted:
            pair = known.get(word) or older.get(word)
            if pair is None:
                missing.append(word)
            else:
                got[word] = pair
        return got, missing

    def recall(self, wanted: set[str]) -> None:
        """Makes every wanted word known. Of the known words, those not met lately go first."""
        missing = [w for w in wanted if w not in self.known]
        if self.size > KNOWN_BYTES:
            self.older, self.known, self.size = self.known, {}, 0
            missing = wanted
        self.size += sum(ENTRY_BYTES + 3 * len(w) for w in missing)
        got, missing = self._recalled(missing, {}, self.older)
        self.known.update(got)
        self.learn(missing)

    def words(self, text: str) -> list[str]:
        return [w for w in WHITE.split(text) if w] if ODD_SPACE.search(text) else text.split()

    def parts(self, text: str) -> list[tuple[bool, str]]:
        """(is a special token, string); special tokens are found in the text as it is."""
        if self.specials is None or "<" not in text:
            return [(False, text)]
        return [(i % 2 == 1, part) for i, part in enumerate(self.specials.split(text)) if part]

    def encode_many(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """For each text its ids as little-endian 32-bit integers, and the text that these decode to."""
        split = [[(s, part if s else self.words(part)) for s, part in self.parts(text)] for text in texts]
        self.recall({w for parts in split for s, words in parts if not s for w in words})
        known = self.known
        for parts in split:
            ids, out = [], []
            for special, part in parts:
                if special:
                    ids.append(self.special[part].to_bytes(4, "little"))
                    out.append(part)
                else:
                    pairs = [known[w] for w in part]
                    ids.append(b"".join([p[0] for p in pairs]))
                    out += [p[1] for p in pairs if p[1]]
            yield b"".join(ids), " ".join(out)

    def decode(self, ids: bytes) -> str:
        """The tokens of ``ids`` joined by a space, which is how a vocabulary without a decoder gives text back."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _little(ids: list[int]) -> bytes:
    values = array("I", ids)
    if sys.byteorder == "big":
        values.byteswap()
    return values.tobytes()


def _byte_letters() -> list[str]:
    """A printable character for each byte: itself where it is one, else the next free one from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


_LOADED: dict[str, WordBpe] = {}


def vocabulary(path: str) -> WordBpe:
    """One copy per Python worker; what is known of words lives as long as a partition."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe.load(path)
    return _LOADED[path]


def _encoded(rows: Iterable[tuple], path: str) -> Iterator[tuple]:
    """(id, ids, decoded text) of rows (id, text), a bounded amount of text at a time."""
    held, size = [], 0

    def flush():
        coder = vocabulary(path)
        for (doc, _), (ids, text) in zip(held, coder.encode_many([t or "" for _, t in held])):
            yield doc, ids, text

    try:
        for doc, text in rows:
            held.append((doc, text))
            size += len(text or "")
            if size > CHUNK_CHARS:
                yield from flush()
                held, size = [], 0
        yield from flush()
    finally:
        # A worker goes on to other partitions and stages.
        vocabulary(path).forget()


def encode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``ids`` (binary: little-endian unsigned 32-bit integers) and ``decoded`` of every row, in one pass.

    A null or empty text has no ids and decodes to an empty text. Repeated rows give repeated results, null ids stay null,
    other columns are not read, an empty table gives no rows. ``vocabulary_path`` has to exist on every executor.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shape = f"id {source.schema['id'].dataType.simpleString()}, ids binary, decoded string"
    return map_rows(source, lambda rows: _encoded(rows, vocabulary_path), shape, 1024)


def digests(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if asked for, ``ids`` of every row; nothing is shuffled."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def rows(found: Iterable[tuple]) -> Iterator[tuple]:
        for doc, ids, text in _encoded(found, vocabulary_path):
            plain = text.encode("utf-8", "surrogatepass")
            row = doc, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(plain).hexdigest()
            yield (*row, ids) if with_ids else row

    shape = f"id {source.schema['id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return map_rows(source, rows, shape + ", ids binary" if with_ids else shape)
