"""Exact token ids of whole texts with a public tokenizer, each distinct word encoded once.

Both pre-tokenizers in use always cut where white space begins after other characters and look at
nothing before that cut. So the ids of a text are those of its chunks (white space and the run of
other characters after it), one after another, and a word that comes again need not be encoded
again. A special token's own string in a text becomes that token, as the library has it. The tokenizers library encodes every chunk; a chunk that is plainly one word, or one word
and marks after it, goes straight to its merge model, which skips the cost of a whole encoding.
"""

from __future__ import annotations

import os
import re
from array import array
from operator import attrgetter

from gapspark.llm.common import worker_state

#: Python counts these as white space or not differently from the tokenizers' own patterns.
ODD_SPACE = re.compile("[\x1c-\x1f᠎]")
CHUNK = re.compile(r"\s*\S+|\s+")
#: One word of Latin letters, with marks after it that never join a word.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([.,!?;:$%&*#]*)")
#: Longer chunks are encoded but not remembered.
LONG_CHUNK = 48
TOKEN_ID = attrgetter("id")


def byte_letters() -> dict[int, str]:
    """Printable stand-ins of byte-level vocabularies: printable bytes stand for themselves, the
    others follow from code 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Marks(dict):
    def __init__(self, owner: Encoder):
        super().__init__()
        self.owner = owner

    def __missing__(self, marks: str) -> bytes:
        ids = self.owner.pieces(marks)
        if len(marks) <= LONG_CHUNK and len(self) < self.owner.room:
            self[marks] = ids
        return ids


class Words(dict):
    """Ids of ``lead + word`` as little-endian unsigned 32-bit bytes, remembered up to ``room``."""

    def __init__(self, owner: Encoder, lead: str):
        super().__init__()
        self.owner, self.lead = owner, lead

    def __missing__(self, word: str) -> bytes:
        ids = self.owner.word(self.lead, word)
        if len(self) < self.owner.room and len(word) <= LONG_CHUNK:
            self[word] = ids
        return ids


class Encoder:
    """Encodes texts; ``keep_space`` tells whether white space reaches the ids.

    Without it the vocabulary is one of lower-case words and white space is dropped. A text with
    control characters that Python and the tokenizers class differently is encoded as a whole.
    """

    def __init__(self, path: str, keep_space: bool, room: int = 700_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.keep_space, self.room = keep_space, room
        self.letters = byte_letters()
        self.first, self.inner = Words(self, ""), Words(self, " ")
        self.marks = Marks(self)
        self.newline = self.whole("\n")

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, lead: str, word: str) -> bytes:
        if word.isalpha() and word.isascii():
            end = len(word)
        elif plain := PLAIN.fullmatch(word):
            end = plain.end(1)
        else:
            return self.whole(lead + word)
        known = self.inner if lead else self.first
        if not self.keep_space:
            lead, word = "", word.lower()
        if end == len(word):
            return self.pieces(lead + word)
        return (known.get(word[:end]) or self.pieces(lead + word[:end])) + self.marks[word[end:]]

    def pieces(self, word: str) -> bytes:
        """Ids of what is one pre-token, spelled in the vocabulary's stand-ins for bytes."""
        if word.isascii():  # printable but for the space
            word = word.replace(" ", self.letters[32])
        else:
            word = word.encode().decode("latin-1").translate(self.letters)
        return array("I", map(TOKEN_ID, self.model.tokenize(word))).tobytes()

    def encode(self, text: str) -> bytes:
        if ODD_SPACE.search(text):
            return self.whole(text)
        if not self.keep_space:
            return b"".join(map(self.first.__getitem__, text.split()))
        lines = []
        for line in text.split("\n"):
            words = line.split()
            if not words or " ".join(words) != line:  # runs of white space: the general way
                return b"".join(map(self.first.__getitem__, CHUNK.findall(text)))
            lines.append(self.first[words[0]] + b"".join(map(self.inner.__getitem__, words[1:])))
        return self.newline.join(lines)


def encoder(path: str, keep_space: bool) -> Encoder:
    """The worker's encoder for a file, kept from task to task."""
    key = ("encoder", path, keep_space)
    if key not in (state := worker_state()):
        state[key] = Encoder(path, keep_space)
    return state[key]
