"""Token ids of a public tokenizer, inside tasks."""

from __future__ import annotations

import json
import os
import re
import struct

#: Fixed values of the word_bpe vocabulary's pre-tokenizer: its contractions,
#: letter runs, single digits and symbol runs, for characters up to U+024F.
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
#: Texts with other characters (or a special token's text) go through the whole tokenizer:
#: those where NFC, white space or number classes could differ from PIECE.
OTHER = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\xac\xae-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]|<\|")


#: Bytes that byte-level tokenizers show as themselves; the others, in order, as U+0100 and up.
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]


class WordCache(dict):
    """Ids of a white-space-delimited word (little-endian unsigned 32-bit bytes),
    made on first use. Byte-pair merges never cross a piece's end, so a text's
    ids are its pieces' ids in order. Emptied when its words and ids pass ``limit``
    bytes (with about ``ENTRY`` bytes of overhead each), so memory stays bounded."""

    ENTRY = 320

    def __init__(self, tokenizer, limit: int):
        super().__init__()
        self.model, self.limit, self.used = tokenizer.model, limit, 0
        self.shown = {b: b for b in SHOWN}
        self.shown |= {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in self.shown)}

    def __missing__(self, word: str) -> bytes:
        if self.used >= self.limit:
            self.clear()
            self.used = 0
        plain = word.isascii() and word.isalpha()  # one piece, whose bytes show as themselves
        pieces = [word] if plain else PIECE.findall(word)
        if len(pieces) == 1 and pieces[0] == word:
            found = self.model.tokenize(word if plain else word.encode().decode("latin-1").translate(self.shown))
            out = struct.pack(f"<{len(found)}I", *[t.id for t in found])
        else:
            out = b"".join([self[p] for p in pieces])
        self[word] = out
        self.used += self.ENTRY + len(word) + len(out)
        return out


class TextTokenizer:
    """``ids(text)``: the tokenizer's ids as little-endian unsigned 32-bit bytes,
    equal to ``Tokenizer.encode(text, add_special_tokens=False)``.

    Words are looked up if the tokenizer lower-cases, drops white space and splits words as
    ``PIECE`` does (``splits_words``); otherwise each text is encoded whole.
    """

    def __init__(self, model: str, limit: int = 256 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(model)
        self.words = WordCache(self.tokenizer, limit) if splits_words(model) else None

    def ids(self, text: str) -> bytes:
        if self.words is None or OTHER.search(text):
            found = self.tokenizer.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(found)}I", *found)
        return b"".join(map(self.words.__getitem__, text.lower().split()))


#: Fixed values of the word_bpe file: what it does to a text before byte-pair merges.
WORD_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
WORD_SPLITTERS = [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]


def splits_words(model: str) -> bool:
    """True if the tokenizer file normalises and splits texts as ``PIECE`` does, with plain byte-pair merges."""
    file = json.loads(model)
    steps = lambda part, key: (file.get(part) or {}).get(key)
    return (steps("normalizer", "normalizers") == WORD_NORMALIZERS and steps("pre_tokenizer", "pretokenizers") == WORD_SPLITTERS
            and file["model"]["type"] == "BPE" and not file["model"].get("ignore_merges") and not file["model"].get("dropout"))


def id_width(model: str) -> int:
    """Bytes that hold every id of the tokenizer: 2 up to 65,536 ids, else 4."""
    file = json.loads(model)
    vocab = file["model"]["vocab"]
    ids = list(vocab.values()) if isinstance(vocab, dict) else range(len(vocab))
    return 2 if max([*ids, *[t["id"] for t in file.get("added_tokens") or []]], default=0) < 1 << 16 else 4


_LOADED: dict[tuple, TextTokenizer] = {}


def loaded(model: str, limit: int) -> TextTokenizer:
    """The worker's tokenizer of this model: its tasks share the word cache. Another's goes."""
    key = (hash(model), len(model), limit)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = TextTokenizer(model, limit)
    return _LOADED[key]


def forget() -> None:
    """Give back the worker's tokenizer and its cache to the system: tasks of later stages need neither."""
    if _LOADED:
        _LOADED.clear()
        give_back()


def give_back() -> None:
    """Return freed memory to the system; allocators keep it otherwise, in each of an executor's workers."""
    import ctypes
    import gc

    import pyarrow as pa
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def read_model(path: str) -> str:
    """The tokenizer file's text; it has a fixed size and travels with the task's code."""
    with open(path, encoding="utf-8") as f:
        return f.read()
