"""Token ids of whole texts with a public tokenizer file, with caches of chunks and words in each worker."""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache
from pathlib import Path

from .shared import held

DEFAULT_VOCABULARY = "word_bpe_49k.json"
CHUNK_ENTRIES, WORD_ENTRIES = 120_000, 300_000
#: Letters that are letters in every version of Unicode and lower-case to one letter, then signs that begin no contraction.
WORD_AND_SIGNS = re.compile(r"([A-Za-zÀ-ÖØ-Þà-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else the next free one from U+0100."""
    prints = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    spare = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(spare)) for b in range(256)]


def drops_white_space(config: dict) -> bool:
    """Whether a tokenizer lower-cases, then keeps what its split pattern finds and drops the rest, white space included."""
    normal = [x.get("type") for x in (config.get("normalizer") or {}).get("normalizers", [])]
    steps = (config.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (
        normal == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in steps] == ["Split", "ByteLevel"]
        and steps[0].get("invert") and steps[0].get("behavior") == "Removed" and not steps[1].get("add_prefix_space")
        and r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" in steps[0]["pattern"].get("Regex", "")
    )


class WordEncoder(dict):
    """Ids of lower-case words of letters, straight from the vocabulary's merges."""

    def __init__(self, tokenizer):
        super().__init__()
        self.model, self.letters = tokenizer.model, byte_letters()

    def __missing__(self, word: str) -> bytes:
        spelt = word if word.isascii() else "".join([self.letters[b] for b in word.encode()])
        ids = array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()
        if len(self) < WORD_ENTRIES and len(word) <= 48:
            self[word] = ids
        return ids


class ChunkEncoder(dict):
    """Ids of the chunks between ASCII spaces and line feeds, as little-endian unsigned 32-bit bytes.

    Where the vocabulary drops white space its pre-tokenizer never joins characters across it, so a text's
    ids are those of its chunks, one after another; likewise a word of letters and the signs behind it are
    encoded apart. Frequent chunks come first and stay; when a cache is full, others are encoded each time.
    Other vocabularies encode whole texts.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.by_chunk = drops_white_space(json.loads(Path(path).read_text(encoding="utf-8")))
        self.words = WordEncoder(self.tokenizer)

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes() if text else b""

    def __missing__(self, chunk: str) -> bytes:
        if found := WORD_AND_SIGNS.fullmatch(chunk):
            word, signs = found.groups()
            ids = self.words[word.lower()] + self[signs] if signs else self.words[word.lower()]
        else:
            ids = self._whole(chunk)
        if len(self) < CHUNK_ENTRIES and len(chunk) <= 64:
            self[chunk] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_chunk:
            return self._whole(text)
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def encoder(path: str) -> ChunkEncoder:
    return held(("encoder", path), lambda: ChunkEncoder(path))


@lru_cache(maxsize=4)
def vocabulary_size(path: str) -> int:
    """One more than the largest id of the vocabulary file."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values()) + 1
