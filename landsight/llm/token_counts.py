"""Token counts that follow edits.

A document's pre-tokens (white-space-separated words, which no token crosses)
are kept in blocks; a segment tree over the blocks holds characters and tokens
of every subtree.  An edit is found by descending on characters; only the
touched stretch, widened to the white space around it (the boundary context),
is encoded again, and the sums on the path to the root are updated.  What an
edit changes in a text does not depend on counts, so the touched words of many
edits wait and are encoded in one call.

``build_trees`` counts every document once and returns its text with the
tree's leaves: a table to be stored.  ``edit_trees`` applies a batch of edits to
stored trees and returns such a table again, for the next batch: the inner sums
are added up from the leaves, and no untouched word is split or encoded.

Edits are applied in order; positions are code points of the text as it is by
then, cut to its length.

Defined results: a null or empty text has no tokens and can be edited into one;
a null insertion deletes; documents without edits keep their count; repeated
rows are counted each; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import TOKEN_BYTES, Source, library_encoder, load, ragged, word_ids
from .util import keyed_texts, process_cache, string_bytes, table, text_slices, words_of, written

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
BLOCK_WORDS = 64
LARGE_BLOCK = 64 * BLOCK_WORDS  # characters
REMEMBERED = 300_000  # words whose count a worker remembers; those met before as many again
WAITING = 1 << 20  # characters of touched words that wait for their count

EDITS = "array<struct<start:long,stop:long,insert:string>>"


class Counter:
    """Tokens of words, remembered between texts.  When ``REMEMBERED`` words are
    known they become the earlier ones, from which words met again come back."""

    def __init__(self, encode):
        self.encode, self.known, self.earlier = encode, {}, {}

    def learn(self, words: list[str]) -> None:
        """Encode the words not known yet, in one call."""
        if len(self.known) > REMEMBERED:
            self.known, self.earlier = {}, self.known
        new = list(dict.fromkeys(w for w in words if w not in self.known))
        if self.earlier:
            again = list(map(self.earlier.get, new))
            self.known.update((w, n) for w, n in zip(new, again) if n is not None)
            new = [w for w, n in zip(new, again) if n is None]
        if new:
            self.known.update(zip(new, word_ids(new, self.encode)[1].tolist()))

    def counts(self, words: list[str]) -> np.ndarray:
        found = list(map(self.known.get, words))
        if None in found:
            self.learn(words)
            found = list(map(self.known.get, words))
        return np.array(found, np.int64)


def flat_leaves(texts: pa.Array, counter: Counter) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points and tokens of every block, text after text, and the number
    of blocks of each text.  A block holds ``BLOCK_WORDS`` words and begins with
    one (the first with the text)."""
    n = len(texts)
    flat, rows = words_of(texts)
    coded = flat.dictionary_encode()
    tokens = counter.counts(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
    data, offsets = string_bytes(texts)
    space = (data == 0x20) | (data - np.uint8(9) < 5)  # 9 to 13; smaller ones wrap around
    begins = ~space
    begins[1:] &= space[:-1]
    inside = offsets[:-1][np.diff(offsets) > 0]
    begins[inside] = ~space[inside]  # a text's first byte follows no other
    starts = np.flatnonzero(begins)  # the words' first bytes, in the order of ``flat``
    first = np.searchsorted(rows, np.arange(n + 1))  # a text's first word
    blocks = np.maximum(-(-np.diff(first) // BLOCK_WORDS), 1)
    of = np.repeat(np.arange(n), blocks)
    word = first[of] + BLOCK_WORDS * ragged(np.zeros(n, np.int64), blocks)  # a block's first word
    is_first = np.concatenate([[True], of[1:] != of[:-1]])[: len(of)]
    at = offsets[of]
    at[~is_first] = starts[word[~is_first]]
    ends = np.append(at[1:], len(data))
    sums = np.concatenate([[0], np.cumsum(tokens)])
    sizes = np.zeros(len(at), np.int64)
    full = ends > at  # a block of an empty text has no byte
    if full.any():
        sizes[full] = np.add.reduceat((data & 0xC0) != 0x80, at[full], dtype=np.int64)
    return sizes, sums[np.append(word[1:], len(tokens))] - sums[word], blocks


def leaves_of(texts: pa.Array, counter: Counter) -> list[tuple[np.ndarray, np.ndarray]]:
    """Code points and tokens of the blocks of each text."""
    sizes, sums, blocks = flat_leaves(texts, counter)
    ends = np.cumsum(blocks).tolist()
    return [(sizes[a:b], sums[a:b]) for a, b in zip([0, *ends], ends)]


class CountTree:
    """Blocks of text in order, with a segment tree of their sizes and counts.

    Block borders lie at white space, so the tokens of a block do not depend on
    its neighbours.  ``leaves`` are the sizes and counts of its blocks, as
    stored; without them the text is counted.
    """

    def __init__(self, text: str, counter: Counter, leaves: tuple | None = None):
        self.counter = counter
        self.encoded_words = 0
        # by block, the words that edits put in and took out, not counted yet
        self.waiting: dict[int, tuple[list[str], list[str]]] = {}
        self.waiting_chars = 0
        sizes, sums = leaves or leaves_of(pa.array([text]), counter)[0]
        ends = np.cumsum(sizes).tolist() or [0]
        self.blocks = [text[a:b] for a, b in zip([0, *ends], ends)]
        self.leaves = 1 << max(0, (len(self.blocks) - 1).bit_length())
        self.chars = [0] * (2 * self.leaves)
        self.tokens = [0] * (2 * self.leaves)
        for i, (n, s) in enumerate(zip(sizes, sums)):
            self.chars[self.leaves + i], self.tokens[self.leaves + i] = int(n), int(s)
        for i in range(self.leaves - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def stored(self) -> tuple[list[int], list[int]]:
        """The leaves, to be stored: empty blocks go, and a block that edits
        have made much larger than the others is cut anew."""
        self.settle()
        sizes, sums = [], []
        for i, block in enumerate(self.blocks):
            if len(block) > LARGE_BLOCK:
                n, s = leaves_of(pa.array([block]), self.counter)[0]
                sizes += n.tolist()
                sums += s.tolist()
            elif block:
                sizes.append(len(block))
                sums.append(self.tokens[self.leaves + i])
        return sizes, sums

    @property
    def total(self) -> int:
        self.settle()
        return self.tokens[1]

    def _find(self, position: int) -> tuple[int, int]:
        """Block and place in it of a position (the last block at the end)."""
        if position >= self.chars[1]:
            last = len(self.blocks) - 1
            while last and not self.blocks[last]:
                last -= 1
            return last, len(self.blocks[last])
        i = 1
        while i < self.leaves:
            i *= 2
            if position >= self.chars[i]:
                position -= self.chars[i]
                i += 1
        return i - self.leaves, position

    def _set(self, block: int, text: str, tokens: int) -> None:
        self.blocks[block] = text
        i = self.leaves + block
        self._add(block, len(text) - self.chars[i], tokens - self.tokens[i])

    def _add(self, block: int, chars: int, tokens: int) -> None:
        i = self.leaves + block
        while i:
            self.chars[i] += chars
            self.tokens[i] += tokens
            i //= 2

    def settle(self) -> None:
        """Count the words that wait, and update the sums above their blocks."""
        for block, (new, old) in self.waiting.items():
            counts = self.counter.counts(new + old)
            self._add(block, 0, int(counts[: len(new)].sum()) - int(counts[len(new) :].sum()))
        self.waiting, self.waiting_chars = {}, 0

    def edit(self, start: int, stop: int, insert: str) -> None:
        size = self.chars[1]
        start = min(max(start, 0), size)
        stop = min(max(stop, start), size)
        first, a = self._find(start)
        last, b = self._find(stop)
        b += sum(self.chars[self.leaves + i] for i in range(first, last))
        text = "".join(self.blocks[first : last + 1])
        # Boundary context: a block ends in white space unless it is the last,
        # so only the word after the edit may be cut off from its end.
        while last + 1 < len(self.blocks) and not re.search(f"[{SPACE}]", text[b:]):
            last += 1
            text += self.blocks[last]
        # only the touched words are encoded again
        left, right = a, b
        while left and text[left - 1] not in SPACE:
            left -= 1
        while right < len(text) and text[right] not in SPACE:
            right += 1
        old = WORDS.findall(text[left:right])
        new = WORDS.findall(text[left:a] + insert + text[b:right])
        self.encoded_words += len(new)
        tokens = sum(self.tokens[self.leaves + i] for i in range(first, last + 1))
        self._set(first, text[:a] + insert + text[b:], tokens)
        put, taken = self.waiting.setdefault(first, ([], []))
        put += new
        taken += old
        for i in range(first + 1, last + 1):
            self._set(i, "", 0)
            for mine, theirs in zip((put, taken), self.waiting.pop(i, ())):
                mine += theirs
        self.waiting_chars += 2 * (right - left) + len(insert)
        if self.waiting_chars > WAITING:
            self.settle()

    def text(self) -> str:
        return "".join(self.blocks)


def edited(texts: list[str], leaves: list[tuple], edits: list[list[tuple] | None], counter: Counter) -> list[CountTree]:
    """The tree of each text after its edits (start, stop, insertion)."""
    trees, waiting, chars = [], [], 0
    for text, mine, some in zip(texts, leaves, edits):
        tree = CountTree(text, counter, mine)
        for start, stop, insert in some or ():
            tree.edit(start or 0, stop or 0, insert or "")
        trees.append(tree)
        waiting.append(tree)
        chars += tree.waiting_chars
        if chars > WAITING:
            _settle(waiting, counter)
            waiting, chars = [], 0
    _settle(waiting, counter)
    return trees


def _settle(trees: list[CountTree], counter: Counter) -> None:
    """Encode what waits in many trees in one call."""
    counter.learn([w for tree in trees for words in tree.waiting.values() for part in words for w in part])
    for tree in trees:
        tree.settle()


TREES = "doc_id long, text string, block_chars array<long>, block_tokens array<long>"
COUNTED = "n_tokens_before long, n_tokens long, n_edits long, words_encoded long"


def _lists(parts: list) -> pa.Array:
    return _list_array(np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int64), [*map(len, parts)])


def _list_array(values: np.ndarray, sizes) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(values))


def _edits(column: pa.Array) -> list[list[tuple] | None]:
    """The edits of each row; None without any."""
    every = list(zip(*(part.to_pylist() for part in column.flatten().flatten())))
    ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)).tolist()
    return [every[a:b] or None for a, b in zip([0, *ends], ends)]


def _worker_counter(plain: tuple) -> Counter:
    source = Source(*plain)
    return process_cache("token_counter_" + source.name, lambda: Counter(library_encoder(source)))


def build_trees(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The tree of every document: ``doc_id``, ``text``, and its leaves
    ``block_chars`` and ``block_tokens``."""
    shared = docs.sparkSession.sparkContext.broadcast(load(path).plain())  # of fixed size

    def run(batches):
        counter = _worker_counter(shared.value)
        for batch in text_slices(batches, limit=TOKEN_BYTES):
            sizes, sums, blocks = flat_leaves(batch.column("text"), counter)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text"), _list_array(sizes, blocks), _list_array(sums, blocks)],
                names=["doc_id", "text", "block_chars", "block_tokens"],
            )

    return keyed_texts(docs).mapInArrow(run, TREES)


def edit_trees(trees: DataFrame, path: str | None = None) -> DataFrame:
    """``trees`` (as ``build_trees`` or this function made them, with a column
    ``edits``; see ``attach_edits``) after their edits, with tokens before and
    after, the number of edits, and the words that were encoded again."""
    shared = trees.sparkSession.sparkContext.broadcast(load(path).plain())  # of fixed size
    ready = trees.select("doc_id", "text", "block_chars", "block_tokens", F.col("edits").cast(EDITS).alias("edits"))
    names = ["doc_id", "text", "block_chars", "block_tokens", "n_tokens_before", "n_tokens", "n_edits", "words_encoded"]

    def run(batches):
        counter = _worker_counter(shared.value)
        for batch in text_slices(batches):
            # a list column's values and where each row's begin
            sizes, sums = batch.column("block_chars"), batch.column("block_tokens")
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(sizes).to_numpy(zero_copy_only=False))]).astype(np.int64)
            sizes, sums = (c.flatten().to_numpy(zero_copy_only=False) for c in (sizes, sums))
            leaves = [(sizes[a:b], sums[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            texts, edits = batch.column("text").to_pylist(), _edits(batch.column("edits"))
            touched = [i for i, some in enumerate(edits) if some]
            trees = dict(zip(touched, edited(*([some[i] for i in touched] for some in (texts, leaves, edits)), counter)))
            out = {k: [] for k in names[1:]}
            for i, (text, mine, some) in enumerate(zip(texts, leaves, edits)):
                before, encoded = int(mine[1].sum()), 0
                total = before
                if some:
                    tree = trees.pop(i)
                    text, mine, total, encoded = tree.text(), tree.stored(), tree.total, tree.encoded_words
                for k, v in zip(names[1:], (text, *mine, before, total, len(some or ()), encoded)):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(out["text"], pa.string()), _lists(out["block_chars"]), _lists(out["block_tokens"]),
                    *(pa.array(out[k], pa.int64()) for k in names[4:]),
                ],
                names=names,
            )

    return ready.mapInArrow(run, f"{TREES}, {COUNTED}")


def count_edits(docs: DataFrame, path: str | None = None) -> DataFrame:
    """For ``docs`` with a column ``edits`` (start, stop, insert; see
    ``attach_edits``): tokens before and after the edits, words encoded again,
    and the edited text.  The trees are built and not kept."""
    shared = docs.sparkSession.sparkContext.broadcast(load(path).plain())  # of fixed size
    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("edits").cast(EDITS).alias("edits"))

    def run(batches):
        counter = _worker_counter(shared.value)
        for batch in text_slices(batches):
            leaves = leaves_of(batch.column("text"), counter)
            edits = _edits(batch.column("edits"))
            trees = edited(batch.column("text").to_pylist(), leaves, edits, counter)
            out = {
                "doc_id": batch.column("doc_id"),
                "n_tokens_before": [int(sums.sum()) for _, sums in leaves],
                "n_tokens": [tree.total for tree in trees],
                "n_edits": [len(some or ()) for some in edits],
                "words_encoded": [tree.encoded_words for tree in trees],
                "edited": [tree.text() for tree in trees],
            }
            yield pa.RecordBatch.from_pydict(
                out,
                pa.schema([("doc_id", pa.int64()), *((k, pa.int64()) for k in ("n_tokens_before", "n_tokens", "n_edits", "words_encoded")), ("edited", pa.string())]),
            )

    return ready.mapInArrow(run, f"doc_id long, {COUNTED}, edited string")


def attach_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """``docs`` (or trees) with each document's edits (``doc_id``, ``seq``,
    ``start``, ``stop``, ``insert``) in order of ``seq`` as the column ``edits``."""
    ordered = F.sort_array(F.collect_list(F.struct("seq", "start", "stop", "insert")))
    by_doc = edits.groupBy("doc_id").agg(ordered.alias("_edits"))  # one document's edits
    listed = F.transform("_edits", lambda e: F.struct(e["start"].alias("start"), e["stop"].alias("stop"), e["insert"].alias("insert")))
    leaves = ["block_chars", "block_tokens"] if {"block_chars", "block_tokens"} <= set(docs.columns) else []
    texts = docs.select("doc_id", "text", *leaves) if leaves else keyed_texts(docs)
    return texts.join(by_doc, "doc_id", "left").select("doc_id", "text", *leaves, listed.alias("edits"))


def revision(docs: DataFrame) -> DataFrame:
    """A revision of every document: a phrase from its own middle is repeated
    at the start, a stretch is cut, a word is split, and a line is added."""
    text = F.coalesce("text", F.lit(""))
    size = F.char_length(text).cast("long")
    place = F.crc32(F.col("doc_id").cast("string")) % F.greatest(size, F.lit(1))

    def edit(start, stop, insert):
        return F.struct(start.cast("long").alias("start"), stop.cast("long").alias("stop"), insert.alias("insert"))

    middle = F.substring(text, (size / 2).cast("int") + 1, F.lit(40))
    edits = F.array(
        edit(F.lit(0), F.lit(0), F.concat(middle, F.lit("\n"))),
        edit(place, place + 25, F.lit("")),
        edit(place + 7, place + 7, F.lit(" ")),
        edit(size, size, F.concat(F.lit("revised "), F.col("doc_id").cast("string"))),
    )
    return docs.withColumn("edits", edits)


def op4_token_counts(spark, sf_dir):
    # every document is counted once; the revision starts from the stored trees
    trees = written(build_trees(table(spark, sf_dir, "documents")), "token-trees")
    counted = edit_trees(revision(trees))
    return counted.select("doc_id", "n_tokens_before", "n_tokens", "n_edits", "words_encoded", F.sha2("text", 256).alias("edited_sha256"))
