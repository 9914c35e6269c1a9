"""Byte-pair encoding with forced boundaries, and decoding.

Reads a vocabulary file of the `tokenizers` library (BPE model with a byte-level alphabet and
an end-of-word suffix, as word_bpe_49k.json).  A pair of bytes that occurs inside no token of
the vocabulary can never be joined by a merge, so each such place in a word is a certain cut.
The fragments between cuts are encoded on their own and concatenated; only a word's last
fragment carries the end-of-word suffix.  The ids are those of the library's own encoder.

Nulls count as empty texts.  Whole texts are encoded, however long.
"""
from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .shared import column_of, quoted

#: Fragments longer than this are merged pass by pass.
_LONG = 64
#: What the library's pattern engine takes for white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"

#: Characters outside these ranges may be letters in one Unicode version and unassigned in
#: another; texts that hold any are split into words by the library's own front end.
UNSURE = regex.compile(
    r"[^\x00-\u0377\u0400-\u052f\u2000-\u206f\u20a0-\u20bd\u2100-\u218b\u3000-\u303f\u3041-\u3096"
    r"\u30a0-\u30ff\u4e00-\u9fa5\uac00-\ud7a3\uff01-\uff9f\U0001f300-\U0001f64f]")


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(shifted)}


class _Words(dict):
    """word -> ids as little-endian 32-bit integers, made on first use; entries of about `most` bytes are kept.

    When full, its entries become the old ones and the older ones go; old entries that are used come back.
    """

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.held, self.old = make, most // 2, 0, {}

    def __missing__(self, word):
        out = self.old.get(word) or self.make(word)
        size = 250 + 4 * len(word if isinstance(word, str) else word[0]) + len(out)
        if size > self.most >> 4:
            return out  # very long words aren't kept
        if self.held + size > self.most:
            self.old = dict(self)
            self.clear()
            self.held = 0
        self[word] = out
        self.held += size
        return out


class ForcedBoundaryBPE:
    def __init__(self, path: str, cached_bytes: int = 160 << 20):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        # The rank of a pair of ids, held in one number (ids have 32 bits), and the id that each merge makes.
        self.ranks = {self.vocab[a] << 32 | self.vocab[b]: i for i, (a, b) in enumerate(pairs)}
        self.made = [self.vocab[a + b] for a, b in pairs]
        to_char = byte_alphabet()
        self.inner = [self.vocab.get(to_char[b]) for b in range(256)]
        self.final = [self.vocab.get(to_char[b] + self.suffix) for b in range(256)]
        self.to_char, self.to_byte = to_char, {c: b for b, c in to_char.items()}
        self.path, self.front = path, None
        self.inside = self._inside(self.to_byte)
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"].replace(r"\s", WHITE))
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.words = _Words(self._word, cached_bytes)
        self.fragments = _Words(self._merge, cached_bytes // 4)

    def _inside(self, to_byte: dict[str, int]) -> np.ndarray:
        """inside[a, b]: some token has byte b right after byte a."""
        inside = np.zeros((256, 256), bool)
        for token in self.vocab:
            body = token[:-len(self.suffix)] if self.suffix and token.endswith(self.suffix) else token
            codes = [to_byte[c] for c in body if c in to_byte]
            inside[codes[:-1], codes[1:]] = True
        return inside

    def fragments_of(self, word: str) -> list[bytes]:
        """The word's UTF-8 bytes, cut at every pair that no token holds."""
        raw = word.encode("utf-8", "surrogatepass")
        if len(raw) < 2:
            return [raw]
        codes = np.frombuffer(raw, np.uint8)
        cuts = np.flatnonzero(~self.inside[codes[:-1], codes[1:]]) + 1
        bounds = [0, *cuts.tolist(), len(raw)]
        return [raw[a:b] for a, b in zip(bounds, bounds[1:])]

    def _word(self, word: str) -> bytes:
        parts = self.fragments_of(word)
        if len(parts) == 1:
            return self._merge((parts[0], True))
        last = len(parts) - 1
        return b"".join(self.fragments[p, i == last] for i, p in enumerate(parts))

    def _merge(self, key: tuple[bytes, bool]) -> bytes:
        raw, last = key
        if not raw:
            return b""
        ids = [self.inner[b] for b in raw]
        if last:
            ids[-1] = self.final[raw[-1]]
        if None in ids:  # bytes that the vocabulary lacks are left out
            ids = [i for i in ids if i is not None]
        if len(ids) > _LONG:
            return array("I", self._merge_long(ids)).tobytes()
        rank, made, none = self.ranks.get, self.made, len(self.made)
        ranks = [rank(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            ids[i] = merged = made[best]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 32 | merged, none)
            if i < len(ranks):
                ranks[i] = rank(merged << 32 | ids[i + 1], none)
        return array("I", ids).tobytes()

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same merges, all places of a pair in one pass: a pass for each pair used, not for each place."""
        rank, none = self.ranks.get, len(self.made)
        while len(ids) > 1:
            ranks = [rank(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
            best = min(ranks)
            if best == none:
                break
            out, i, n = [], 0, len(ids)
            while i < n:
                if i < n - 1 and ranks[i] == best:
                    out.append(self.made[best])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def _plain(self, text: str) -> bytes:
        if UNSURE.search(text):
            return b"".join(map(self.words.__getitem__, self._library_words(text)))
        text = unicodedata.normalize("NFC", text)
        # Letter by letter, as the library does: no special rule for a word-final sigma.
        text = text.replace("Σ", "σ").lower()
        return b"".join(map(self.words.__getitem__, self.pattern.findall(text)))

    def _library_words(self, text: str) -> list[str]:
        if self.front is None:
            from tokenizers import Tokenizer
            self.front = Tokenizer.from_file(self.path)
        words = self.front.pre_tokenizer.pre_tokenize_str(self.front.normalizer.normalize_str(text))
        return [bytes(map(self.to_byte.__getitem__, w)).decode("utf-8") for w, _ in words]

    def encode(self, text: str) -> bytes:
        """Ids of the text as little-endian unsigned 32-bit integers."""
        if self.marks is None or not self.marks.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.marks.finditer(text):
            out += [self._plain(text[at:m.start()]), array("I", [self.added[m[0]]]).tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        """The tokens' names joined by blanks, as the library decodes without a decoder."""
        return " ".join(map(self.names.__getitem__, array("I", ids)))


@lru_cache(maxsize=2)
def load(path: str) -> ForcedBoundaryBPE:
    """One encoder for each worker and file."""
    return ForcedBoundaryBPE(path)


def encode_decode(docs: DataFrame, path: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if kept, ids (array of int) and decoded of every row, repeated ones too."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                ids = [bpe.encode(t or "") for t in part.column(1).to_pylist()]
                texts = [bpe.decode(x) for x in ids]
                cols = [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                        pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in texts], pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    cols += [pa.array([np.frombuffer(x, np.int32) for x in ids], pa.list_(pa.int32())),
                             pa.array(texts, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if keep_ids:
        schema += ", ids array<int>, decoded string"
    return docs.select(F.col(quoted(column_of(docs, "doc_id"))).cast("long").alias("doc_id"), F.col(quoted(column_of(docs, "text")))).mapInArrow(run, schema)
