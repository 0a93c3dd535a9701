"""BPE encoding and decoding by a pair occurrence index.

The new words of a chunk of a partition are laid out as one linked list of symbols. An index maps
each mergeable pair (by its rank) to all its positions. Active ranks are applied in ascending order;
each application rewrites its positions at once and adds the pairs it makes to the lists of their ranks.

Vocabulary files are read where they are (``path``), never copied. The file must be a word-level BPE
of the ``tokenizers`` library with an end-of-word suffix, NFC and lower-casing.

Defined results: a null or empty text has no tokens and decodes to "". Repeated rows each give a row.
A null id is returned as it is. Texts of any length are encoded whole. Columns other than the id and
the text are not looked at, whatever their names.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import parts, ship

#: Text of a chunk; the index is built over the words that are new in it.
CHUNK = 1 << 20
#: Bytes of words and ids that a worker keeps; beyond it the store is emptied, which costs time only.
STORE_BYTES = 4 << 20

# How this kind of file cuts text, and its special tokens.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# Unicode moved on between the library's tables and those here. Code points that are letters
# or digits only in the newer ones, and capitals whose small letter only the library knows.
LATER = """558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE
11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20
18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2
1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"""
SMALL = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
SMALL |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}


def _span(wanted=lambda c: True) -> str:
    """The later code points that are wanted, as they stand in a character class."""
    spans = [[int(x, 16) for x in span.split("-")] for span in LATER.split()]
    return "".join("-".join(f"\\U{c:08X}" for c in span) for span in spans if wanted(span[0]))


_LATER = _span()
#: As PIECES, with the later code points counted as signs.
OLD_PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{_LATER}]]+|[\p{{N}}--[{_LATER}]]|[[^\s\p{{L}}\p{{N}}]||[{_LATER}]]+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself, or the next of those from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class PairIndexBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"{path} is not a word-level BPE with NFC and lower-casing")
        vocab = dict(model["vocab"])
        end = model["end_of_word_suffix"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (vocab | self.special).items()}
        self.inner = np.array([vocab[c] for c in byte_symbols()], dtype=np.int64)
        self.final = np.array([vocab[c + end] for c in byte_symbols()], dtype=np.int64)
        self.pieces = regex.compile(PIECES)
        self.old_pieces = regex.compile(OLD_PIECES, regex.V1)
        # All beyond U+FFFF in one range: a class of many ranges there is slow, and the slower pattern is right for any text.
        low = "".join(chr(c) for c in SMALL if c <= 0xFFFF)
        self.rare = re.compile(f"[{_span(lambda c: c <= 0xFFFF)}{low}\U00010000-\U0010FFFF]")
        self.marks = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")")

        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], dtype=np.int64)
        right = np.array([vocab[b] for _, b in merges], dtype=np.int64)
        self.left, self.right = left, right
        self.made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        self.size = max(self.tokens) + 1
        rank_of = np.full(self.size, -1, dtype=np.int64)
        rank_of[self.made] = np.arange(len(merges))
        ranks = np.arange(len(merges))
        if len(set(self.made.tolist())) != len(merges) or (rank_of[left] >= ranks).any() or (rank_of[right] >= ranks).any():
            raise ValueError(f"{path}: a merge needs a token that a later merge makes, so ranks can't be applied in order")
        keys = left * self.size + right
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.store: dict[str, bytes] = {}
        self.stored = 0

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it can't be merged."""
        keys = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((a >= 0) & (b >= 0) & (self.keys[at] == keys), self.order[at], -1)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word, packed as little-endian unsigned 32-bit numbers."""
        if not words:
            return []
        coded = [w.encode() for w in words]
        lengths = np.array([len(w) for w in coded], dtype=np.int64)
        stops = np.cumsum(lengths)
        raw = np.frombuffer(b"".join(coded), dtype=np.uint8)
        n = len(raw)
        # One place more at the end stands for "no neighbour"; its symbol is -1.
        symbol = np.append(self.inner[raw], -1)
        symbol[stops - 1] = self.final[raw[stops - 1]]
        after = np.arange(1, n + 2)
        after[stops - 1] = n
        before = np.arange(-1, n)
        before[stops - lengths] = n
        before = np.append(before, n)[: n + 1]

        first = self.ranks(symbol[:n], symbol[after[:n]])
        places = np.flatnonzero(first >= 0)
        places = places[np.argsort(first[places], kind="stable")]
        index: dict[int, list[np.ndarray]] = {}
        self._add(index, [], first[places], places)
        active = list(index)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            found = index.pop(rank)
            at = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
            a, b, made = self.left[rank], self.right[rank], self.made[rank]
            at = at[symbol[at] == a]
            to = after[at]
            fits = symbol[to] == b
            at, to = at[fits], to[fits]
            if a == b and len(at) > 1:
                free = self._apart(at, to)
                at, to = at[free], to[free]
            if not len(at):
                continue
            symbol[at] = made
            symbol[to] = -1
            beyond = after[to]
            after[at] = beyond
            before[beyond] = at
            before[n] = n
            prior = before[at]
            new = np.concatenate([self.ranks(symbol[prior], symbol[at]), self.ranks(symbol[at], symbol[beyond])])
            where = np.concatenate([prior, at])
            fits = new >= 0
            if fits.any():
                new, where = new[fits], where[fits]
                if len(new) > 1:
                    by = np.argsort(new, kind="stable")
                    new, where = new[by], where[by]
                self._add(index, active, new, where)
        kept = symbol[:n] >= 0
        out = symbol[:n][kept].astype("<u4").tobytes()
        ends = (np.cumsum(kept)[stops - 1] * 4).tolist()
        return [out[x:y] for x, y in zip([0, *ends[:-1]], ends, strict=True)]

    @staticmethod
    def _add(index: dict, active: list, ranks: np.ndarray, places: np.ndarray) -> None:
        """Add places, sorted by rank, to the lists of their ranks; ranks new to the index become active."""
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        begins = [0, *cuts.tolist()]
        for x, y, rank in zip(begins, [*begins[1:], len(ranks)], ranks[begins].tolist() if len(ranks) else [], strict=False):
            held = index.get(rank)
            if held is None:
                index[rank] = [places[x:y]]
                heapq.heappush(active, rank)
            else:
                held.append(places[x:y])

    @staticmethod
    def _apart(at: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Of pairs of equal symbols, those that a scan from the left would merge."""
        free = np.ones(len(at), dtype=bool)
        used = -1
        order = np.argsort(at)
        for k in order.tolist():
            if at[k] == used:
                free[k] = False
            else:
                used = to[k]
        return free

    def cut(self, text: str) -> list[str]:
        """Words of a text; a special token stands as its own text after a NUL."""
        if "<|" in text and self.marks.search(text):
            out: list[str] = []
            for k, piece in enumerate(self.marks.split(text)):
                out += ["\0" + piece] if k % 2 else self._pieces(piece)
            return out
        return self._pieces(text)

    def _pieces(self, text: str) -> list[str]:
        """Pieces of a text after NFC and lower-casing every character by itself."""
        if text.isascii():
            return self.pieces.findall(text.lower())
        text = unicodedata.normalize("NFC", text)
        if self.rare.search(text):
            return self.old_pieces.findall(text.translate(SMALL).replace("Σ", "σ").lower())
        return self.pieces.findall(text.replace("Σ", "σ").lower())

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The packed ids of each text."""
        cut = [self.cut(t or "") for t in texts]
        if not self.store or self.stored > STORE_BYTES:
            self.stored = 0
            self.store = {"\0" + t: np.uint32(i).astype("<u4").tobytes() for t, i in self.special.items()}
        new = list({w for words in cut for w in words if w not in self.store})
        ids = self.encode_words(new)
        self.store.update(zip(new, ids, strict=True))
        self.stored += sum(map(len, new)) + sum(map(len, ids))
        get = self.store.__getitem__
        return [b"".join(map(get, words)) for words in cut]

    def decode(self, ids: bytes) -> str:
        """The tokens of packed ids, joined by spaces."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text's ids (binary, little-endian unsigned 32 bits each) and the text they decode to.

    Returns id, ids, n_tokens, decoded. The vocabulary must be at ``path`` on every worker.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = PairIndexBpe(path)
        for batch in batches:
            for part in parts(batch, most=CHUNK):
                ids = bpe.encode(part.column("text").to_pylist())
                for x in range(0, len(ids), 500):
                    own = ids[x : x + 500]
                    yield pa.record_batch(
                        [part.column("id").slice(x, 500), pa.array(own, pa.binary()), pa.array([len(i) // 4 for i in own], pa.int64()), pa.array([bpe.decode(i) for i in own], pa.string())],
                        names=["id", "ids", "n_tokens", "decoded"],
                    )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids binary, n_tokens bigint, decoded string")
