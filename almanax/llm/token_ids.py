"""Token ids of whole texts by a byte-level BPE with word ends, as little-endian unsigned 32-bit bytes.

A text is parted at the six ASCII blanks, which no token crosses, so the ids of a text are those of its chunks one after
another. Ids of chunks, and of the words that the tokenizer's own rule finds in them, are kept in bounded tables.
"""

from __future__ import annotations

import re
from functools import cache

from tokenizers import Tokenizer

_LETTERS = "a-zß-öø-ÿāăąćĉċčďđēĕėęěĝğġģĥħĩīĭįłńņňŋōŏőœŕŗřśŝşšţťŧũūŭůűųŵŷźżžſ"  # composed small letters
#: The tokenizer's own word rule, for chunks of these letters and of printable ASCII; fixed values.
_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")
_PLAIN = re.compile(rf"[\x21-\x7e{_LETTERS}]+")


def _byte_letters() -> list[str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others are numbered from 256."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)]


class _Words(dict):
    """Ids of words; a new one goes to the tokenizer's model."""

    def __init__(self, tokenizer: Tokenizer, most: int) -> None:
        super().__init__()
        self.tokenize, self.most, self.letters = tokenizer.model.tokenize, most, _byte_letters()
        self.raw = [i.to_bytes(4, "little") for i in range(tokenizer.get_vocab_size())]

    def __missing__(self, word: str) -> bytes:
        if len(self) > self.most:
            self.clear()
        letters = word if word.isascii() else "".join([self.letters[b] for b in word.encode()])
        raw = self.raw
        self[word] = out = b"".join([raw[t.id] for t in self.tokenize(letters)])
        return out


class TokenIds(dict):
    """Ids of chunks between blanks. most_chunks and most_words bound the tables; a full one is emptied."""

    def __init__(self, path: str, most_chunks: int = 800_000, most_words: int = 500_000) -> None:
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.special = re.compile("|".join(re.escape(t.content.lower()) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)")
        self.words, self.most = _Words(self.tokenizer, most_words), most_chunks

    def of(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.encode().split()))

    def __missing__(self, chunk: bytes) -> bytes:
        if len(self) > self.most:
            self.clear()
        text = chunk.decode()
        small = text.lower()
        if _PLAIN.fullmatch(small) and not self.special.search(small):
            words = self.words
            out = b"".join([words[w] for w in _WORDS.findall(small)])
        else:
            raw = self.words.raw
            out = b"".join([raw[i] for i in self.tokenizer.encode(text, add_special_tokens=False).ids])
        self[chunk] = out
        return out


@cache
def token_ids(path: str) -> TokenIds:
    """One for each worker process, so tables last from task to task."""
    return TokenIds(path)
