"""Public vocabularies over whole texts. The ids are always the library's own."""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

#: Words that a worker keeps; later ones are encoded anew each time. This bounds its memory and changes no result.
CACHE_LIMIT = 450_000
MARK = "▁"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordVocabulary:
    """A byte-level tokenizers file that lower-cases, drops white space and merges within pre-tokens only.

    No token spans ASCII white space, and a run of letters or digits ends for sure before an ASCII sign, so a text's ids
    are those of its words in turn, and each distinct word is encoded once. Commas and full stops are words of their own
    where a letter, a digit or white space stands before each. A word of ASCII or Latin-1 letters is one pre-token and
    goes straight to the library's model; any other goes through all of its steps. ids() gives little-endian unsigned
    32-bit bytes, without special tokens.
    """

    #: A comma or full stop that may belong to a run of signs.
    _RUN = re.compile(rb"(?:[\x00-\x08\x0e-\x1f!-/:-@\[-`{-\x7f]|[\x80-\xff](?<!\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]))[.,]")

    def __init__(self, path: str, cache_limit: int = CACHE_LIMIT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.encoder = Tokenizer.from_file(path)
        self.encoder.no_truncation()
        self.encoder.no_padding()
        self.merge = self.encoder.model.tokenize
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.byte_chars = {b: level.pre_tokenize_str(chr(b))[0][0][-1] for b in range(0x80, 0xC0)} | {0xC3: level.pre_tokenize_str("é")[0][0][0]}
        self.limit, self.words = cache_limit, {}
        for probe in ("ab cd,ef\n gh's", "Élan, ÿßµ.", "X!y"):
            if np.frombuffer(self.ids([probe.encode()])[0], "<u4").tolist() != self._whole(probe):
                raise ValueError("this vocabulary doesn't keep words apart")

    def _whole(self, text: str) -> list[int]:
        return self.encoder.encode(text, add_special_tokens=False).ids

    def _encode(self, word: bytes) -> bytes:
        if word.isalpha():
            ids = [t.id for t in self.merge(word.lower().decode())]
        else:
            s = word.decode("utf-8", "replace")
            if s.isalpha() and "¿" < min(x for x in s if x > "z") and max(s) <= "ÿ" if not s.isascii() else False:
                ids = [t.id for t in self.merge(s.lower().encode().decode("latin-1").translate(self.byte_chars))]
            else:
                ids = self._whole(s)
        return array("I", ids).tobytes()

    def ids(self, texts: list[bytes]) -> list[bytes]:
        out = []
        for t in texts:
            if b"<|" not in t:
                t = t.lower()
                if not self._RUN.search(t):
                    t = t.replace(b",", b" ,").replace(b".", b" .")
            words = t.split()
            unknown = set(words).difference(self.words)
            encode = self._encode
            self.words.update([(w, encode(w)) for w in unknown])
            out.append(b"".join(map(self.words.__getitem__, words)))
            if len(self.words) > self.limit:
                for w in unknown:
                    del self.words[w]
        return out


_loaded: dict[str, WordVocabulary] = {}


def word_vocabulary(path: str) -> WordVocabulary:
    """One for each worker process, so that a later task finds the words of an earlier one."""
    if path not in _loaded:
        _loaded[path] = WordVocabulary(path)
    return _loaded[path]


def drop_vocabularies() -> None:
    """For tasks that come after the encoding: their workers need no words any more."""
    _loaded.clear()


class PieceVocabulary:
    """A sentencepiece model."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.encoder = SentencePieceProcessor(model_file=path)
        self.size = self.encoder.vocab_size()
        self.is_byte = np.array([self.encoder.is_byte(i) for i in range(self.size)])
        pieces = [self.encoder.id_to_piece(i) for i in range(self.size) if not self.is_byte[i]]
        #: No piece has the word mark behind another character, so no token spans the place before a space that follows
        #: a character other than a space or the mark: what stands on either side is encoded on its own.
        self.words_end_tokens = not any(MARK in p.lstrip(MARK) for p in pieces)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self.encoder.encode(texts, num_threads=1, return_type="numpy")

    def token_starts(self, text: str) -> list[int]:
        """Where in the text each token begins, in characters."""
        return [begin for begin, _ in self.encoder.encode(text, return_type="offset_mapping")["offsets"]]
