"""Shared tokenizer plumbing: the vocabulary file, pre-tokens of words, and the
assembly of per-text id lists.

The public word-BPE file normalises (NFC, white space, lower case), splits words
into pre-tokens that never hold white space, and merges inside a pre-token.  So
the ids of a text are the ids of its white-space-separated words one after the
other, and a batch needs each distinct word once.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .util import process_cache, text_slices, words_of

# Text encoded at once: a distinct word is encoded once per slice, so larger
# slices cost less; about 15 times this in memory.
TOKEN_BYTES = 6 << 20

# The contractions of the file's pre-token pattern.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"


def _class(inside) -> str:
    """Ranges, for a character class, of the code points in ``inside``."""
    codes = np.array(sorted(inside), np.int64)
    breaks = np.flatnonzero(np.diff(codes) > 1)
    starts = np.concatenate([codes[:1], codes[breaks + 1]])
    ends = np.concatenate([codes[breaks], codes[-1:]])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends))


def _character_tables() -> tuple[str, dict[int, str]]:
    """The pre-token pattern, and the characters whose lower case in the
    library is not Python's.  Both are read off the library's own Unicode
    tables: Python and the regex module follow other Unicode versions."""
    from tokenizers import Regex
    from tokenizers.normalizers import Lowercase
    from tokenizers.pre_tokenizers import Split

    plain = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and c != 10]
    every = "".join(plain)

    def has(pattern: str) -> set[int]:
        kept = Split(Regex(f"[^{pattern}]"), "removed").pre_tokenize_str(every)
        return {ord(c) for part, _ in kept for c in part}

    letters, numbers, spaces = _class(has(r"\p{L}")), _class(has(r"\p{N}")), _class(has(r"\s") | {10})
    # Contractions, runs of letters, single numbers, runs of anything else that
    # is no white space, and the line feed that parts two words here.
    pattern = f"{CONTRACTIONS}|[{letters}]+|[{numbers}]|[^{spaces}{letters}{numbers}]+|\\n"
    lowered = Lowercase().normalize_str("\n".join(plain)).split("\n")
    return pattern, {ord("Σ"): "σ"} | {ord(c): t for c, t in zip(plain, lowered) if t != c.lower()}


class Source:
    """What the tasks need of a tokenizer file: its text and the character
    tables.  Made on the driver once; of fixed size."""

    def __init__(self, file: str, pattern: str, odd: dict[int, str]):
        self.file, self.odd = file, odd
        self.name = hashlib.sha1(file.encode()).hexdigest()  # what workers remember is kept by file
        self.pattern = re.compile(pattern)
        self.has_odd = re.compile("[" + _class(odd) + "]")
        spec = json.loads(file)
        self.specials: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}

    def plain(self) -> tuple[str, str, dict[int, str]]:
        """What ``Source(*plain)`` is made of again in a worker: a broadcast names
        classes by their module, which executors need not have."""
        return self.file, self.pattern.pattern, self.odd

    def lower(self, text: str) -> str:
        """Lower case character by character, as the library has it."""
        if not text.isascii() and self.has_odd.search(text):
            text = text.translate(self.odd)
        return text.lower()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@functools.cache
def load(path: str | None = None) -> Source:
    """The tokenizer file and its tables, for the tasks (made on the driver)."""
    with open(path or default_path(), encoding="utf-8") as f:
        return Source(f.read(), *_character_tables())


def _byte_symbols() -> dict[int, str]:
    """Byte -> printable symbol: printable Latin-1 bytes stand for themselves,
    the others for the code points from 256 on, in order."""
    table, extra = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            table[b] = chr(b)
        else:
            table[b], extra = chr(extra), extra + 1
    return table


BYTE_SYMBOLS = _byte_symbols()


def pre_tokens(words: list[str], source: Source) -> tuple[list[str], np.ndarray]:
    """Pre-tokens of all words, in byte symbols, and their number per word.
    No word holds a line feed (ASCII white space separates words)."""
    out: list[str] = []
    specials = source.specials
    sizes = np.zeros(len(words), np.int64)
    if not words:
        return out, sizes
    odd = [i for i, w in enumerate(words) if "<|" in w and any(s in w for s in specials)]
    if not odd:
        return _plain_pre_tokens(words, source)
    # a special token in a text splits its word; the parts are ordinary words
    cut = re.compile("(" + "|".join(map(re.escape, specials)) + ")")
    parts: list[str] = []
    owner: list[int] = []
    odd_set = set(odd)
    for i, w in enumerate(words):
        mine = [p for p in cut.split(w) if p] if i in odd_set else [w]
        parts += mine
        owner += [i] * len(mine)
    flat, counts = _plain_pre_tokens(["" if p in specials else p for p in parts], source)
    at = 0
    for p, o, n in zip(parts, owner, counts):
        mine = [p] if p in specials else flat[at : at + n]
        at += n
        out += mine
        sizes[o] += len(mine)
    return out, sizes


def _plain_pre_tokens(words: list[str], source: Source) -> tuple[list[str], np.ndarray]:
    text = "\n".join(words)
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    found = source.pattern.findall(source.lower(text) + "\n")
    is_end = np.fromiter((t == "\n" for t in found), bool, len(found))
    ends = np.flatnonzero(is_end)
    sizes = np.diff(np.concatenate([[-1], ends])) - 1
    joined = "\n".join(t for t in found if t != "\n")
    if not joined:
        return [], sizes
    symbols = BYTE_SYMBOLS | {10: "\n"}
    return joined.encode().decode("latin-1").translate(symbols).split("\n"), sizes


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges [start, start + size)."""
    total = int(sizes.sum())
    begin = np.cumsum(sizes) - sizes
    return np.repeat(starts - begin, sizes) + np.arange(total)


def word_ids(words: list[str], encode) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words one after the other, and their number per word.
    ``encode`` maps pre-tokens to (ids, ids per pre-token) and has a ``source``."""
    flat, sizes = pre_tokens(words, encode.source)
    ids, counts = encode(flat)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    total = np.concatenate([[0], np.cumsum(counts)])
    return ids, total[ends[1:]] - total[ends[:-1]]


REMEMBERED_WORDS = 400_000  # about 20 MB


class WordMemory:
    """Ids of the words of earlier slices, ``REMEMBERED_WORDS`` at most: a word
    is encoded once for several slices and tasks.  When it is full, a quarter is
    left free again; the words that were met last stay."""

    def __init__(self):
        self.words, self.ids, self.sizes = pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.met, self.calls = np.zeros(0, np.int64), 0

    def __call__(self, words: pa.Array, encode) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct words -> ids of many words, and each word's start and number."""
        words = words.cast(pa.large_string())
        at = pc.index_in(words, self.words)
        new = words.filter(at.is_null())
        ids, sizes = word_ids(new.to_pylist(), encode)
        place = pc.fill_null(at, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        place[place < 0] = len(self.words) + np.arange(len(new))
        all_ids, all_sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
        starts = np.cumsum(all_sizes) - all_sizes
        self.calls += 1
        met = np.concatenate([self.met, np.zeros(len(new), np.int64)])
        met[place] = self.calls
        all_words = pa.concat_arrays([self.words, new])
        if len(all_words) <= REMEMBERED_WORDS:
            self.words, self.ids, self.sizes, self.met = all_words, all_ids, all_sizes, met
        else:
            stay = np.sort(np.argsort(-met, kind="stable")[: REMEMBERED_WORDS * 3 // 4])
            self.words, self.sizes, self.met = all_words.take(pa.array(stay)), all_sizes[stay], met[stay]
            self.ids = all_ids[ragged(starts[stay], self.sizes)]
        return all_ids, starts[place], all_sizes[place]


def text_ids(texts: pa.Array, encode, memory: WordMemory | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, and their number per text."""
    words, rows = words_of(texts)
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    ids, starts, sizes = (memory or WordMemory())(coded.dictionary, encode)
    per_word = sizes[codes]
    out = ids[ragged(starts[codes], per_word)].astype(np.int32)
    return out, np.bincount(rows, weights=per_word, minlength=len(texts)).astype(np.int64)


class LibraryEncoder:
    """Ids of pre-tokens by the tokenizers library, many pre-tokens a call.

    The pre-tokens are normalised and split already, so the file's own
    normaliser and splitter are left out; a merged pre-token ends where the
    vocabulary string has the word-end mark.
    """

    def __init__(self, source: Source):
        from tokenizers import Tokenizer

        self.source, self.specials = source, source.specials
        spec = json.loads(source.file)
        vocab, mark = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.is_end = np.zeros(max(*vocab.values(), *self.specials.values()) + 1, bool)
        self.is_end[[i for t, i in vocab.items() if t.endswith(mark)]] = True
        self.is_end[list(self.specials.values())] = True
        spec |= {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "truncation": None, "padding": None}
        self.tokenizer = Tokenizer.from_str(json.dumps(spec))

    def __call__(self, flat: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not flat:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # words that differ in case or punctuation share pre-tokens: each is encoded once
        coded = pa.array(flat, pa.large_string()).dictionary_encode()
        each = coded.dictionary.to_pylist()
        lines = [" ".join(each[i : i + 2000]) for i in range(0, len(each), 2000)]
        ids = np.concatenate([np.array(e.ids, np.int64) for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)])
        ends = np.flatnonzero(self.is_end[ids])
        sizes = np.diff(np.concatenate([[-1], ends]))
        codes = coded.indices.to_numpy(zero_copy_only=False)
        counts = sizes[codes]
        return ids[ragged((ends + 1 - sizes)[codes], counts)], counts


def library_encoder(source: Source) -> LibraryEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return process_cache("library_encoder_" + source.name, lambda: LibraryEncoder(source))


def with_ids(docs: DataFrame, make_encoder, source: Source) -> DataFrame:
    """``doc_id`` and ``ids`` of ``docs`` (``doc_id``, ``text`` without nulls)."""
    shared = docs.sparkSession.sparkContext.broadcast(source.plain())  # of fixed size

    def run(batches):
        encode = make_encoder(Source(*shared.value))
        for batch in text_slices(batches, limit=TOKEN_BYTES):
            ids, sizes = text_ids(batch.column("text"), encode)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(offsets, pa.array(ids))], names=["doc_id", "ids"])

    return docs.mapInArrow(run, "doc_id long, ids array<int>")
