"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches."""

from __future__ import annotations

import base64
import codecs
import re
from array import array
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import pieces

#: Two blanks together, or one at an end: such texts are encoded in one go, others word by word.
ROUGH = re.compile(r"^\s|\s\s|\s$")
#: Words whose ids a worker remembers, in each of two generations, and single matches.
MOST_WORDS = 100_000


def byte_chars() -> list[str]:
    """The character that stands for each byte: itself if printable Latin-1, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in set(plain))
    out = {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}
    return [out[b] for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}


def last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that lower ranks leave of a token; None where it is not reached in one merge."""
    parts = [token[i : i + 1] for i in range(len(token))]
    own = ranks[token]
    while len(parts) > 2:
        best, at = min((ranks.get(a + b, own), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if best >= own:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


class Codec:
    """Encodes and decodes by a rank file, each match of ``pattern`` separately, without special tokens."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks = read_ranks(path)
        chars = byte_chars()
        name = {t: "".join([chars[b] for b in t]) for t in ranks}
        merges = [(name[m[0]], name[m[1]]) for t in sorted(ranks, key=ranks.get) if len(t) > 1 and (m := last_merge(t, ranks)) and m[0] in ranks and m[1] in ranks]
        self.tokenizer = Tokenizer(models.BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        # the byte table in reverse: all tokens' bytes in one array, and where each begins
        back = {c: b for b, c in enumerate(chars)}
        by_id: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for text, r in self.tokenizer.get_vocab().items():
            by_id[r] = bytes([back[c] for c in text])
        self.sizes = np.array([len(b) for b in by_id], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(by_id), np.uint8)
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.matches: dict[str, bytes] = {}
        self.chars = chars
        self.pattern = regex.compile(pattern)
        self.plain = self.pattern.findall(" Abc") == [" Abc"]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def merge(self, text: str) -> bytes:
        """Ids of one match of the pattern: its bytes' characters through the library's model."""
        name = "Ġ" + text[1:] if text[0] == " " and text.isascii() else "".join([self.chars[b] for b in text.encode("utf-8")])
        return array("I", [t.id for t in self.tokenizer.model.tokenize(name)]).tobytes()

    def match(self, text: str) -> bytes:
        """As merge, remembered: of a word with a blank where words are, else by itself."""
        got = self.words.get(text[1:]) if text[0] == " " else self.matches.get(text)
        if got is None:
            got = self.merge(text)
            if text[0] != " ":
                if len(self.matches) > MOST_WORDS:
                    self.matches.clear()
                self.matches[text] = got
        return got

    def learn(self, words: list[str]) -> None:
        """Ids of these words, each with a blank before it.

        Letters alone are one match; in other printable ASCII the pattern's matches are found here, where no
        engine can differ on classes; the rest go through the library's splitting, and offsets tell whose
        ids are whose.
        """
        rest = []
        for w in words:
            if w.isascii() and w.isprintable():
                self.words[w] = self.merge(" " + w) if w.isalpha() and self.plain else b"".join([self.match(m) for m in self.pattern.findall(" " + w)])
            else:
                rest.append(w)
        for at in range(0, len(rest), 5000):
            some = rest[at : at + 5000]
            got = self.tokenizer.encode(" " + " ".join(some), add_special_tokens=False)
            begin = np.cumsum([0, *(len(w) + 1 for w in some)])
            starts = np.fromiter((a for a, _ in got.offsets), np.int64, len(got))
            cuts = np.searchsorted(starts, begin)
            raw = np.array(got.ids, "<u4").tobytes()
            for w, a, b in zip(some, (cuts[:-1] * 4).tolist(), (cuts[1:] * 4).tolist()):
                self.words[w] = raw[a:b]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        A blank between two other characters always begins a match of the pattern or stands alone before
        one, never inside; so texts are cut there and words that come again are not encoded again. Words met
        in this generation or the one before are remembered.
        """
        cut = [None if ROUGH.search(t) else t.split(" ") for t in texts]
        if len(self.words) > MOST_WORDS:
            self.older, self.words = self.words, {}
        known, older, new = self.words, self.older, []
        for w in set().union(*[c[1:] for c in cut if c]):
            if w not in known:
                if w in older:
                    known[w] = older[w]
                else:
                    new.append(w)
        self.learn(new)
        return [self.whole(t) if c is None else self.whole(c[0]) + b"".join([known[w] for w in c[1:]]) for t, c in zip(texts, cut)]

    def decode(self, ids: bytes) -> bytes:
        """The bytes of the tokens. Characters split over tokens come together again here."""
        i = np.frombuffer(ids, "<u4").astype(np.int64)
        sizes = self.sizes[i]
        ends = np.cumsum(sizes)
        if not len(i) or not ends[-1]:
            return b""
        return self.flat[np.repeat(self.starts[i] - (ends - sizes), sizes) + np.arange(ends[-1])].tobytes()

    def decode_stream(self, parts: Iterator[bytes]) -> Iterator[str]:
        """Text of ids that come in parts; a character split between parts waits for its end."""
        waiting = codecs.getincrementaldecoder("utf-8")("replace")
        for part in parts:
            yield waiting.decode(self.decode(part))
        yield waiting.decode(b"", final=True)

    def offsets(self, text: str, ids: bytes) -> list[tuple[int, int]]:
        """(first, end) code points of each token; tokens that share a split character all cover it."""
        raw = np.frombuffer(text.encode("utf-8"), np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        ends = np.cumsum(self.sizes[np.frombuffer(ids, "<u4").astype(np.int64)])
        begins = np.concatenate([[0], ends[:-1]])
        return [(int(char[a]), int(char[b - 1]) + 1) for a, b in zip(begins, ends)]


@cache
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per row: doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit), decoded (binary).

    ``path`` of a rank file, on every executor. Whole texts are encoded, without special tokens: their
    strings in a text are ordinary text. Null and empty texts have no tokens. Rows keep their number,
    repeats included; columns other than doc_id and text are ignored; an empty table stays empty.
    """
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for rows, texts in pieces(batch, "text"):
                ids = c.encode(texts)
                back = [c.decode(i) for i in ids]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(back, pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return d.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary, decoded binary")
