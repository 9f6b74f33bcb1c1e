"""Operator 4: BPE encoding and decoding by a prefix-sharing trie.

The state of a prefix is the last token of its encoding; with it the encoding of the prefix is that
of the prefix without this token, and the token. The last token is the one token that ends the
prefix and may follow the last token of what is left, so states go from parent to child in a trie:
distinct words in order are its leaves, one depth-first walk gives every node its state (only the branch it is on is
held), and words that share a prefix share its work. Besides its state a node has the place where its longest ending begins that begins a token; the tokens
that end this ending are all that end the prefix, and a child's ending begins no earlier. A pair of tokens may follow
each other when undoing their merges, latest first, never meets a merge across the pair that would have come earlier.

Each task walks the tries of the words that are new to it, block by block, and keeps the ids of words met lately. Normalisation, splitting and special
tokens follow the tokenizer file (NFC, white space, lower case, words and signs). Decoding joins the
tokens' texts with a space, as the library does for a file without a decoder.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pitchside.llm.text import blocks, give_back

END = "</w>"
#: Texts with other characters (or with \x1c-\x1f, white space to Python alone) are normalised and split by
#: the library itself: its Unicode tables differ from Python's for some scripts.
SIMPLE = re.compile("[\x00-\x1b\x20-\u024f]*")
#: Words whose ids a process keeps (twice as many at most, some 200 bytes each) and bytes of text in a block.
CACHED_WORDS, BLOCK_BYTES = 150_000, 1 << 20
#: The same for a job in which other stages' processes stay beside this one: some 40 MB less, a third more time.
LIGHT_WORDS, LIGHT_BYTES = 50_000, 1 << 18
#: Pairs of tokens whose test a process keeps.
CACHED_PAIRS = 300_000


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(hidden)) for b in range(256)]


def _simple_class(kind: str) -> str:
    """Characters of a general category in SIMPLE texts and their lower cases, to stand in a character class."""
    chars = {x for c in map(chr, range(0x250)) for x in c + c.lower()}
    return "".join(re.escape(c) for c in sorted(chars) if unicodedata.category(c)[0] == kind)


class TrieBpe:
    """Encoder for one tokenizer file (BPE with an end-of-word suffix)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END or spec["decoder"]:
            raise ValueError("a BPE file with word ends and without a decoder is needed")
        self.vocab: dict[str, int] = model["vocab"]
        self.text_of = {i: t for t, i in self.vocab.items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        # Ranks: single symbols first, then tokens in the order of their merges.
        made = [a + b for a, b in merges]
        merged = set(made)
        singles = [t for t in self.vocab if t not in merged]
        self.rank = {t: i for i, t in enumerate([*singles, *made])}
        n = len(singles)
        pairs = [(self.rank[a], self.rank[b]) for a, b in merges]
        self.pair = {p: n + i for i, p in enumerate(pairs)}
        self.parts = [(i, i) for i in range(n)] + pairs
        self.raw_id = [np.uint32(self.vocab[t]).tobytes() for t in self.rank]  # in the order of ranks
        self.sizes = [len(t.removesuffix(END)) for t in self.rank]  # in the order of ranks
        # Tokens that end a beginning of a token, the longest first: inside a word, and at its end (found when first asked for).
        self.inside: dict[str, tuple[tuple[int, int], ...] | None] = {t[:n]: None for t in map(lambda t: t.removesuffix(END), self.rank) for n in range(1, len(t) + 1)}
        self.at_end: dict[str, tuple[tuple[int, int], ...]] = {}
        self.ending: list[tuple[int, int] | None] = [None] * len(self.rank)  # (size, rank), one for all beginnings that a token ends
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text_of |= {i: t for t, i in self.special.items()}
        self.special_re = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.simple_re = re.compile(reduce(lambda p, kind: p.replace(f"\\p{{{kind}}}", _simple_class(kind)), "LN", split["pattern"]["Regex"]))
        # The library normalises and splits alone: its own copy of the vocabulary would double a process's memory while it is read.
        library = Tokenizer.from_str(json.dumps(spec | {"added_tokens": [], "model": {"type": "BPE", "vocab": {}, "merges": []}}))
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        self.chars = byte_chars()
        self.byte_of = {c: b for b, c in enumerate(self.chars)}
        self.fits: dict[int, bool] = {}  # by left * 2^32 + right
        self.cached_words = CACHED_WORDS
        self.ids: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def may_follow(self, left: int, right: int) -> bool:
        """Whether two tokens (ranks) stand side by side in some encoding."""
        if (known := self.fits.get(left << 32 | right)) is not None:
            return known
        a, b, limit = left, right, 1 << 60
        while True:
            if self.pair.get((a, b), limit) < limit:
                ok = False
                break
            if a > b:
                limit, a = a, self.parts[a][1]
                if a == limit:
                    limit, b = b + 1, self.parts[b][0]
                    if b + 1 == limit:
                        ok = True
                        break
            else:
                limit, b = b + 1, self.parts[b][0]
                if b + 1 == limit:
                    limit, a = a, self.parts[a][1]
                    if a == limit:
                        ok = True
                        break
        if len(self.fits) > CACHED_PAIRS:
            self.fits.clear()
        self.fits[left << 32 | right] = ok
        return ok

    def _endings(self, part: str, end: str) -> tuple[tuple[int, int], ...]:
        """(size, rank) of the tokens that end ``part`` (with ``end``, of the whole word), the longest first."""
        found = [(len(part) - i, self.rank.get(part[i:] + end)) for i in range(len(part))]
        return tuple(self._ending(size, token) for size, token in found if token is not None)

    def _ending(self, size: int, token: int) -> tuple[int, int]:
        if (known := self.ending[token]) is None or known[0] != size:
            known = self.ending[token] = (size, token)
        return known

    def _last(self, endings: tuple[tuple[int, int], ...], d: int, states: list[int]) -> int:
        """The last token of a prefix of ``d`` characters, from the tokens that end it and the states of shorter prefixes."""
        fits = self.fits
        for size, token in endings:
            if size == d:
                return token
            left = states[d - size]
            ok = fits.get(left << 32 | token)
            if ok or ok is None and self.may_follow(left, token):
                return token
        raise ValueError(f"no token ends a prefix of {d} characters")

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Token ranks of each distinct word, by one depth-first walk of their trie."""
        out: dict[str, list[int]] = {}
        inside, at_end, sizes, last = self.inside, self.at_end, self.sizes, self._last
        # The branch of the word before: state and beginning of the longest ending at each depth.
        before, states, begins = "", [-1], [0]
        for word in sorted(words):
            d, shared = 0, min(len(word), len(before))
            while d < shared and word[d] == before[d]:
                d += 1
            del states[d + 1:], begins[d + 1:]
            before, begin = word, begins[d]
            for d in range(d + 1, len(word) + 1):
                while (part := word[begin:d]) not in inside:
                    begin += 1
                if (endings := inside[part]) is None:
                    endings = inside[part] = self._endings(part, "")
                states.append(last(endings, d, states))
                begins.append(begin)
            d, part = len(word), word[begin:]
            if (endings := at_end.get(part)) is None:
                endings = at_end[part] = self._endings(part, END)
            token = last(endings, d, states)
            found, at = [token], d - sizes[token]
            while at:
                found.append(states[at])
                at -= sizes[states[at]]
            out[word] = found[::-1]
        return out

    def _words(self, text: str) -> list[str]:
        """The words of a text without special tokens, normalised."""
        if not SIMPLE.fullmatch(text):
            pieces = self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(text))
            return [bytes([self.byte_of[c] for c in w]).decode() for w, _ in pieces]
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        return self.simple_re.findall(text.lower())

    def words(self, text: str) -> list[str]:
        """The words of a text; a special token is its text after a line end, with which no word begins."""
        if self.special_re is None or "<" not in text:
            return self._words(text)
        out: list[str] = []
        for i, part in enumerate(self.special_re.split(text)):
            out += ["\n" + part] if i % 2 else self._words(part)
        return out

    def learn(self, words: set[str]) -> None:
        """Encodings of the words; the new ones from one trie. Those not met for long are forgotten."""
        if len(self.ids) > self.cached_words:
            self.ids, self.older = {}, self.ids
        new = []
        for w in words:
            if w not in self.ids:
                if (known := self.older.get(w)) is not None:
                    self.ids[w] = known
                elif w[0] == "\n":
                    self.ids[w] = np.uint32(self.special[w[1:]]).tobytes()
                else:
                    new.append(w)
        raw_id = self.raw_id
        spelt = {w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(self.chars): w for w in new}
        for spelling, ranks in self.encode_words(spelt).items():
            self.ids[spelt[spelling]] = b"".join([raw_id[r] for r in ranks])

    def decode(self, ids: bytes) -> str:
        """The tokens' texts, a space between them."""
        return " ".join(map(self.text_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        words = [self.words(t) for t in texts]
        self.learn(set().union(*words))
        return [b"".join(map(self.ids.__getitem__, w)) for w in words]


_encoders: dict[str, TrieBpe] = {}


def encoder(path: str) -> TrieBpe:
    if path not in _encoders:
        _encoders[path] = TrieBpe(path)
        give_back(0)   # what reading the file took, half as much again
    return _encoders[path]


def forget_encoders() -> None:
    """Drop this process's encoders. A function of the module: a task's own code would see a copy of ``_encoders``."""
    _encoders.clear()
    give_back()


def encode_documents(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", keep_encoder: bool = True) -> DataFrame:
    """(id_col, ``ids`` binary: little-endian unsigned 32-bit token ids, ``decoded`` string) of every row.

    Null and empty texts have no ids and an empty decoded text. Rows are encoded one by one, so repeated
    rows give repeated results and an empty table an empty result; other columns are not read.
    ``tokenizer_path`` must exist on every executor. A worker keeps its encoder and the ids of recent words for its next
    task, some 120 MB; without ``keep_encoder`` it keeps fewer ids and drops all after each task, for a job of several stages.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tokenizer_path)
        bpe.cached_words = CACHED_WORDS if keep_encoder else LIGHT_WORDS
        for batch, raw in blocks(batches, "_text", BLOCK_BYTES if keep_encoder else LIGHT_BYTES):
            ids = bpe.encode_batch([r.decode() for r in raw])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.binary()), pa.array(map(bpe.decode, ids), pa.string())], names=[id_col, "ids", "decoded"])
        if not keep_encoder:
            del bpe
            forget_encoders()

    rows = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, ids binary, decoded string")
