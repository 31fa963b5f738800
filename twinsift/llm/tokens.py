"""Token ids by a fixed public vocabulary file, quickly over large texts."""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
from array import array
from collections.abc import Callable
from functools import lru_cache

#: A name among the public tokenizers, or a path.
DEFAULT_VOCABULARY = "word_bpe_49k.json"


def located(vocabulary: str) -> str:
    """The path of a vocabulary on this machine: itself, or that of the public tokenizer of this name."""
    if os.path.sep in vocabulary:
        return vocabulary
    import public_tokenizers

    return str(public_tokenizers.path(vocabulary))


#: The vocabulary's mark for the end of a word, and the byte that stands for it here.
WORD_END, END = "</w>", b"\xff"

#: Characters up to U+017F but for controls that some libraries hold for white space,
#: and U+0130, whose lower case is two characters. Texts of these alone are composed already.
_PLAIN = re.compile(r"[\t\n\r -~\xa0-įı-ſ]*")


def _of(kind: str) -> str:
    """The plain characters of a kind, and what their lower case may be."""
    return "".join(map(re.escape, (chr(c) for c in range(0x180) if unicodedata.category(chr(c))[0] == kind)))


class _Memory(dict):
    """Remembers what ``find`` gave for the latest ``most`` keys or more, twice that at most."""

    def __init__(self, find: Callable[[str], bytes], most: int):
        super().__init__()
        self.find, self.most, self.older = find, most, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.find(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        if len(key) <= 48:
            self[key] = value
        return value


class ChunkedEncoder:
    """Encodes texts by the word vocabulary, remembering the ids of chunks between white space.

    The vocabulary's rules drop white space, lower the case, and split at letters,
    numbers and others, so no token reaches over a chunk's end. Its merges run in
    tiktoken, with a byte that UTF-8 never holds for the end of a word; that gives
    the same ids because every entry of the vocabulary is what its own symbols
    merge to (a test holds that). Texts with characters past U+017F go to the
    tokenizer whole. Strings of special tokens in a text are ordinary text. Memory
    is bounded and never changes a result.
    """

    def __init__(self, path: str = DEFAULT_VOCABULARY, most: int = 100_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        path = located(path)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        letter, number = _of("L"), _of("N")
        # The vocabulary's own splitting pattern, with its classes spelled out for the plain characters.
        self.split = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^\s{letter}{number}]+").findall
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        ranks = entry_bytes(vocabulary)
        self.merge = Encoding("words", pat_str=".+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.chunks = _Memory(self._chunk, most)
        self.size = self.tokenizer.get_vocab_size()

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers; none for a null text."""
        if not text:
            return b""
        if _PLAIN.fullmatch(text):
            return b"".join(map(self.chunks.__getitem__, text.split()))
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _chunk(self, chunk: str) -> bytes:
        low = chunk.lower()
        if low.isalpha():
            return _packed(self.merge(low.encode() + END))
        head, tail = low[:-1], low[-1]
        if head.isalpha() and not tail.isalpha():  # the pattern makes two pieces of these
            return _packed(self.merge(head.encode() + END)) + self.chunks[tail]
        ids: list[int] = []
        for piece in self.split(low):
            ids += self.merge(piece.encode() + END)
        return _packed(ids)


@lru_cache(maxsize=1)
def encoder(vocabulary: str = DEFAULT_VOCABULARY) -> ChunkedEncoder:
    """The encoder of this process: tasks that a worker runs one after the other share it, and its memory."""
    return ChunkedEncoder(vocabulary)


def entry_bytes(vocabulary: dict[str, int]) -> dict[bytes, int]:
    """The vocabulary's entries as bytes, END for a word's end: printable bytes stand for themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in shown} | {chr(0x100 + n): b for n, b in enumerate(b for b in range(256) if b not in shown)}
    out = {}
    for entry, at in vocabulary.items():
        ends = entry.endswith(WORD_END) and entry != WORD_END
        out[bytes(byte[c] for c in entry.removesuffix(WORD_END if ends else "")) + END * ends] = at
    return out


def _packed(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder != "little":
        packed.byteswap()
    return packed.tobytes()
