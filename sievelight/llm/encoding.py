"""Encoding of whole texts with a tokenizer file, piece by piece.

A byte-level BPE whose pre-tokenizer never lets a token cross a single space
between two non-blank characters gives the same ids for a text and for the
pieces cut in front of such spaces.  Pieces repeat far more often than texts,
so each worker keeps the ids of the pieces it has met and asks the library
only for new ones.  A tokenizer of any other make, and a text with a special
string in it, goes to the library whole.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from array import array
from functools import lru_cache

#: Pieces, and words without their punctuation, that a worker remembers;
#: beyond them the library is asked again.
CACHE_PIECES, CACHE_WORDS = 120_000, 300_000
#: A piece longer than this is not remembered.
LONGEST_CACHED = 40
#: Bits of the hash by which a worker knows that it has met a piece before.  Most pieces come once, and only those
#: that come again are remembered.
MET_BITS = 22
#: Letters up to here belong to one class in every version of Unicode.
_LAST_PLAIN = "\u024f"
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_CUT = re.compile(r"(?<=\S) (?=\S)")
_OTHER_BLANKS = re.compile(r"[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


class _Remembered(dict):
    """Ids of pieces; ``learn`` makes those that are missing."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, piece):
        return self.learn(piece)


class PieceEncoder:
    """Ids of whole texts, without begin, end or added special tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path = path
        self.kind = "sentencepiece" if path.endswith(".model") else "tokenizers"
        if self.kind == "sentencepiece":
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_file=path)
            self.specials, self.by_piece, vocab = (), False, self.library.vocab_size()
        else:
            from tokenizers import Tokenizer
            from tokenizers.pre_tokenizers import ByteLevel

            self.library = Tokenizer.from_file(path)
            self.library.no_truncation()
            self.library.no_padding()
            with open(path, encoding="utf-8") as f:
                config = json.load(f)
            self.specials = tuple(t["content"] for t in config.get("added_tokens") or ())
            pre = config.get("pre_tokenizer") or {}
            self.by_piece = (
                config.get("normalizer") is None
                and pre.get("type") == "ByteLevel"
                and pre.get("use_regex", False)
                and not pre.get("add_prefix_space", True)
                and not any(" " in s for s in self.specials)
            )
            vocab = self.library.get_vocab_size(with_added_tokens=True)
            self.model = self.library.model
            self.bytes_of = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        #: Type code of the id arrays: two bytes where every id fits.
        self.code = "H" if vocab <= 1 << 16 else "I"
        self.width = array(self.code).itemsize
        self.met = bytearray(1 << MET_BITS)
        #: Pieces by themselves, and pieces that follow a space.
        self.bare, self.spaced = _Remembered(self._learn_bare), _Remembered(self._learn_spaced)
        self.words: dict[str, bytes] = {}

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian integers of ``self.code``."""
        if not text:
            return b""
        if not self.by_piece or any(s in text for s in self.specials):
            return self._whole(text)
        # a plain split is safe unless a space meets another blank or an end
        if text[0] == " " or text[-1] == " " or "  " in text or " \n" in text or "\n " in text or _OTHER_BLANKS.search(text):
            pieces = _CUT.split(text)
        else:
            pieces = text.split(" ")
        first = self.bare[pieces[0]]
        return first + b"".join(map(self.spaced.__getitem__, pieces[1:]))

    def count(self, text: str | None) -> int:
        """The number of ids."""
        return len(self.encode(text)) // self.width

    def _whole(self, text: str) -> bytes:
        if self.kind == "sentencepiece":
            return array(self.code, self.library.encode(text, num_threads=1)).tobytes()
        return array(self.code, self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _again(self, piece: str) -> bool:
        """Whether a piece with this hash was met before."""
        at = hash(piece) & ((1 << MET_BITS) - 1)
        if self.met[at]:
            return True
        self.met[at] = 1
        return False

    def _learn_bare(self, piece: str) -> bytes:
        ids = self._make(piece, "")
        if len(self.bare) < CACHE_PIECES and len(piece) <= LONGEST_CACHED and self._again(piece):
            self.bare[piece] = ids
        return ids

    def _learn_spaced(self, piece: str) -> bytes:
        ids = self._make(piece, " ")
        if len(self.spaced) < CACHE_PIECES and len(piece) <= LONGEST_CACHED and self._again(piece):
            self.spaced[piece] = ids
        return ids

    def _make(self, piece: str, lead: str) -> bytes:
        """Ids of ``lead`` and a piece that is not remembered as a whole."""
        if "\n" in piece:
            first, *rest = piece.split("\n")
            if first and all(rest) and not any(r[0].isspace() or r[-1].isspace() for r in (first, *rest)):
                # a lone newline between two other characters is a token of its own
                head = self.spaced[first] if lead else self.bare[first]
                return self.bare["\n"].join([head, *map(self.bare.__getitem__, rest)])
            return self._whole(lead + piece)
        word = piece.rstrip(_PUNCTUATION)
        if word.isalpha() and (word.isascii() or max(word) <= _LAST_PLAIN):
            ids = self._word(lead + word)
            return ids if len(word) == len(piece) else ids + self.bare[piece[len(word) :]]
        return self._whole(lead + piece)

    def _word(self, word: str) -> bytes:
        """Ids of a run of letters, maybe led by a space: one pre-token."""
        found = self.words.get(word)
        if found is None:
            mapped = word.replace(" ", "\u0120") if word.isascii() else self.bytes_of(word)[0][0]
            found = array(self.code, [t.id for t in self.model.tokenize(mapped)]).tobytes()
            if len(self.words) < CACHE_WORDS and len(word) <= LONGEST_CACHED and self._again(word):
                self.words[word] = found
        return found


@lru_cache(maxsize=4)
def encoder(path: str) -> PieceEncoder:
    """The worker's own encoder for a file; it lives as long as the worker, or until ``forget_encoders``."""
    return PieceEncoder(path)


def forget_encoders() -> None:
    """Free the encoders of a worker that goes on to other work; one with all its pieces has some 70 MB."""
    if encoder.cache_info().currsize:
        encoder.cache_clear()
        gc.collect()  # an encoder and what it remembers refer to each other


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer file and of the library that reads it."""
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    h = hashlib.sha256(f"{library.__name__} {library.__version__}\n".encode())
    with open(path, "rb") as f:
        for block in iter(lambda: f.read(1 << 20), b""):
            h.update(block)
    return h.hexdigest()
