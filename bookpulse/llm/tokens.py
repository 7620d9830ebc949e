"""Token ids of whole texts through the tokenizers library, one library call per distinct word."""

from __future__ import annotations

import json
import os
import struct

from bookpulse.llm.common import RUN_BYTES, runs

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks share the machine already

#: Bytes of keys, ids and table slots of the words that a worker keeps, and of one word.
KNOWN_BYTES, _ENTRY_BYTES = 160_000_000, 210
#: Bytes of the longest word that is kept.
_LONG = 64

#: Bytes that the library drops as white space and that end a word.
_TO_SPACE = bytes(32 if chr(b) in " \t\n\r\x0b\x0c" else b for b in range(256))
_TAIL = b".,;:!?)"
#: Byte-level vocabularies write bytes that are no printable Latin-1 character as the characters from U+0100 on.
_BYTE_LEVEL = {
    b: 256 + i for i, b in enumerate(b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE))
}
_WORKER: dict[str, WordEncoder] = {}


def tokenizer_file() -> str:
    """The vocabulary that the registered queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoder(path: str) -> WordEncoder:
    """The encoder of this worker; it keeps its words from task to task."""
    if path not in _WORKER:
        _WORKER[path] = WordEncoder(path)
    return _WORKER[path]


class WordEncoder:
    """Encode texts to little-endian unsigned 32-bit ids, equal to the library's for the whole text.

    Tokenizers that drop white space give a word the same ids wherever it stands, so words
    are looked up; other tokenizers get whole texts. The table is keyed by the core of a word
    (lower case, no punctuation after it), which is a word itself, and by other spellings once
    their core is known, so words seen once take one place only. A full table admits nothing
    and forgets nothing, until so many words were not found that the texts must have
    changed; then it starts anew.
    """

    def __init__(self, path: str, known_bytes: int = KNOWN_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = _drops_space(path)
        self.limit = known_bytes // _ENTRY_BYTES
        self.known: dict[bytes, bytes] = {}
        self.missed = 0

    def encode(self, data: bytes) -> bytes:
        if not self.by_word:
            return self._library(data)
        if len(data) <= RUN_BYTES:
            return self._run(data)
        return b"".join(map(self._run, runs(data.translate(_TO_SPACE))))

    def _run(self, data: bytes) -> bytes:
        words = data.split()
        found = list(map(self.known.get, words))
        at = 0
        for _ in range(found.count(None)):
            at = found.index(None, at)
            found[at] = self._word(words[at])
        return b"".join(found)

    def _library(self, data: bytes) -> bytes:
        return _packed(self.tokenizer.encode(data.decode(), add_special_tokens=False).ids)

    def _word(self, word: bytes) -> bytes:
        if word.isalpha() and word.islower():  # a to z
            return self._core(word)
        core, tail = _parts(word)
        if core == word:
            return self._core(word)
        ids = self.known.get(core)
        seen = ids is not None
        if not seen:
            ids = self._core(core)
        if tail:
            ids += self.known.get(tail) or self._core(tail)
        if seen and len(self.known) < self.limit and len(word) <= _LONG:
            self.known[word] = ids
        return ids

    def _core(self, core: bytes) -> bytes:
        """Ids of a core or a tail, which is kept if there is room."""
        if core in self.known:
            return self.known[core]
        tokenize = self.tokenizer.model.tokenize
        if core.isalpha():  # a to z: nothing to normalize or to split
            ids = _packed([t.id for t in tokenize(core.decode())])
        elif (text := core.decode()).isalpha() and max(text) < "\u0250" and text == text.lower():
            # Latin lower-case letters, written as byte-level vocabularies have them.
            ids = _packed([t.id for t in tokenize(core.decode("latin-1").translate(_BYTE_LEVEL))])
        else:
            ids = self._library(core)
        if len(self.known) < self.limit and len(core) <= _LONG:
            self.known[core] = ids
        else:
            self.missed += 1
            if self.missed > 4 * self.limit:
                self.known, self.missed = {}, 0
        return ids


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _parts(word: bytes) -> tuple[bytes, bytes]:
    """Lower-cased word and punctuation after it, where both surely keep their ids."""
    if b"<" in word:
        return word, b""  # may hold the string of a special token
    core = word.rstrip(_TAIL)
    if not core or not core[-1:].isalpha():
        core = word
    tail = word[len(core):]
    if core.isascii():
        return core.lower(), tail
    if core[:1].isupper() and core[1:2].isalpha():
        return core[:1].lower() + core[1:], tail
    return core, tail


def _drops_space(path: str) -> bool:
    """True if texts are lower-cased and split at white space before anything looks across it."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    steps = [x.get("type") for x in (model.get("normalizer") or {}).get("normalizers", [])]
    split = (model.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    first, second = split[0], split[-1]
    return (
        steps == ["NFC", "Replace", "Lowercase"]
        and first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
        and r"[^\s\p{L}\p{N}]+" in first.get("pattern", {}).get("Regex", "")
        and len(split) == 2 and second.get("type") == "ByteLevel"
        and not second.get("use_regex", True) and not second.get("add_prefix_space", True)
        and not any(t["lstrip"] or t["rstrip"] or t["normalized"] for t in model["added_tokens"])
    )
