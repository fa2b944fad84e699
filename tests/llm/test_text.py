"""Quality rules, packing, token counts, BPE, archives, toxicity, language ID."""

import base64
import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from landsight.llm import bpe, langid, packing, quality, token_counts, tokens, toxicity, warc

from .conftest import SF, prose

os.environ["TOKENIZERS_PARALLELISM"] = "false"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.default_path())


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


# ---- quality ---------------------------------------------------------------------------


def brute_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in collections.Counter(windows).items() if n > 1}
    marked = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(marked)


def host_moments(hosts):
    return len(hosts), sum(n for n, _ in hosts), sum(f for _, f in hosts), sum(n * n for n, _ in hosts), sum(f * f / n for n, f in hosts)


def test_rules_and_hosts(spark, odd_docs):
    for docs in (odd_docs, spark.read.parquet(f"{SF}/documents.parquet")):
        want = collections.Counter()
        hosts = collections.defaultdict(list)
        for r in docs.select("doc_id", "text", "source").collect():
            counts = brute_rules(r.text or "")
            failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
            hosts[r.source or ""].append(failed)
            want[(r.doc_id, *counts, failed, r.source or "")] += 1
        alpha, beta = quality.beta_prior(*host_moments([(len(f), sum(f)) for f in hosts.values()]))
        shrunk = {h: (sum(f) + alpha) / (len(f) + alpha + beta) for h, f in hosts.items()}
        got = quality.judge_hosts(docs).collect()
        names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host")
        assert collections.Counter(tuple(r[n] for n in names) for r in got) == want
        for r in got:
            assert r.host_rate == pytest.approx(shrunk[r.host])
            assert r.kept == (not r.base_failed and r.host_rate <= quality.MAX_HOST_RATE)
    assert quality.judge_hosts(odd_docs.where("false")).count() == 0


def test_a_bad_host_takes_its_good_documents_down_only_with_evidence(spark):
    good = prose(1, 80)
    rows = [(i, "too short", "bad") for i in range(40)] + [(99, good, "bad"), (100, "too short", "new"), (101, good, "new")]
    rows += [(200 + i, prose(i, 80), f"host{i % 4}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id: r.kept for r in quality.judge_hosts(docs).collect()}
    assert not kept[99] and kept[101] and not kept[100] and all(kept[200 + i] for i in range(40))


def test_beta_prior():
    assert quality.beta_prior(0, None, None, None, None) == (0.5, 0.5)
    for hosts in ([(10, 2)], [(1, 0), (1, 1)], [(4, 0), (9, 0)], [(50, 50), (50, 0)]):  # nothing measured, or 0 and 1 only
        assert sum(quality.beta_prior(*host_moments(hosts))) == 1.0
    assert quality.beta_prior(*host_moments([(10, 2)] * 5)) == pytest.approx((10.0, 40.0))  # no spread at all


def test_beta_prior_of_many_small_hosts():
    """The rates of hosts with few documents spread by chance; the prior is that
    of their true rates, whatever the number of documents."""
    rng = np.random.default_rng(8)
    for low, high in ((1, 4), (5, 40), (1, 400)):
        n = rng.integers(low, high, 40_000)
        f = rng.binomial(n, rng.beta(6, 14, len(n)))
        alpha, beta = quality.beta_prior(*host_moments(list(zip(n.tolist(), f.tolist()))))
        assert alpha == pytest.approx(6, rel=0.25) and beta == pytest.approx(14, rel=0.25)


# ---- tokens ----------------------------------------------------------------------------

STRANGE = [
    "", " ", "a<|startoftext|>b  <|endoftext|> <|endoftext|", "ΑΣ ΟΔΟΣ İI ﬁ", "it's WE'LL '’S 'd", "é é ́x 각 𝔘𝔫𝔦",
    "x y\x1cz\x85q r", "12345 ٣٤ ²Ⅷ", "a" * 3000, "\U0001f469‍\U0001f467!?...", "\x00\x01tab\tnew\nline",
]


def test_encoding_equals_the_library(spark, odd_docs, library):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(STRANGE)], "doc_id long, text string")
    for df in (docs, odd_docs, spark.read.parquet(f"{SF}/documents.parquet")):
        want = collections.Counter()
        for i, t in texts(df):
            ids = library.encode(t, add_special_tokens=False).ids
            want[(i, tuple(ids), library.decode(ids, skip_special_tokens=False))] += 1
        got = bpe.decode(bpe.encode(df)).collect()
        assert collections.Counter((r.doc_id, tuple(r.ids), r.decoded) for r in got) == want
    assert bpe.decode(bpe.encode(odd_docs.where("false"))).count() == 0


def test_both_encoders_agree_on_every_kind_of_character(library):
    import pyarrow as pa

    source = tokens.load()
    rng = random.Random(5)
    points = [c for c in range(0x3000) if c not in (0, 10)] + [rng.randrange(0x3000, 0xD800) for _ in range(3000)] + [rng.randrange(0xE000, 0x110000) for _ in range(3000)]
    parts = [f"ab{chr(c)}cD {chr(c)}x 1{chr(c)}2" for c in points]
    want = [e.ids for e in library.encode_batch(parts, add_special_tokens=False)]
    for encoder in (bpe.Bpe(source), tokens.LibraryEncoder(source)):
        ids, sizes = tokens.text_ids(pa.array(parts), encoder)
        ends = np.cumsum(sizes)
        assert [list(ids[e - n : e]) for e, n in zip(ends, sizes)] == want


def test_words_that_come_back_are_encoded_once(monkeypatch):
    """Words met in every slice stay remembered when the memory is full."""
    import pyarrow as pa

    monkeypatch.setattr(tokens, "REMEMBERED_WORDS", 40)
    seen = []

    class Encoder(tokens.LibraryEncoder):
        def __call__(self, flat):
            seen.extend(flat)
            return super().__call__(flat)

    encode, memory = Encoder(tokens.load()), tokens.WordMemory()
    common = [f"w{chr(97 + k)}x" for k in range(20)]
    for turn in range(12):
        texts = pa.array([" ".join(common), " ".join("z" * (2 + turn) + chr(97 + k) for k in range(15))])
        ids, sizes = tokens.text_ids(texts, encode, memory)
        alone = tokens.text_ids(texts, tokens.LibraryEncoder(tokens.load()))
        assert list(ids) == list(alone[0]) and list(sizes) == list(alone[1])
        assert len(memory.words) <= 40
    assert len(seen) == 20 + 12 * 15


def test_equal_pre_tokens_are_encoded_once():
    encode = tokens.LibraryEncoder(tokens.load())
    real, lines = encode.tokenizer, []

    class Spy:
        def encode_batch_fast(self, batch, **kw):
            lines.extend(batch)
            return real.encode_batch_fast(batch, **kw)

    want = encode(["stone"])[0].tolist() + encode(["river"])[0].tolist() + encode(["stone"])[0].tolist()
    encode.tokenizer = Spy()
    assert encode(["stone", "river", "stone"])[0].tolist() == want
    assert " ".join(lines).split() == ["stone", "river"]


def test_packing(spark, odd_docs, library):
    for docs in (odd_docs, spark.read.parquet(f"{SF}/documents.parquet")):
        whole = {}
        rows = 0
        for i, t in texts(docs):
            whole[i] = [*library.encode(t, add_special_tokens=False).ids, 2]
            rows += len(whole[i])
        packed = packing.pack(packing.pieces(docs)).collect()
        assert sum(p.length for p in packed) == rows
        by = collections.defaultdict(list)
        for p in packed:
            part = whole[p.doc_id][p.start : p.start + p.length]
            assert p.ids == part and p.doc_tokens == len(whole[p.doc_id])
            assert p.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
            by[p.sequence_id].append((p.offset, p.length))
        for places in by.values():
            places.sort()
            assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))]
            assert sum(n for _, n in places) <= 4096
        assert rows / (4096 * len(by)) > 0.95 or len(by) == -(-rows // 4096)
    got = {r.sequence_id: r.ids for r in packing.sequences(packing.pack(packing.pieces(odd_docs))).collect()}
    assert sum(map(len, got.values())) == sum(p.length for p in packing.pieces(odd_docs, keep_ids=False).collect())
    assert packing.pack_documents(odd_docs.where("false")).count() == 0


def test_best_fit_takes_the_tightest_window():
    rng = random.Random(2)
    lengths = sorted((rng.randrange(1, 101) for _ in range(400)), reverse=True)
    room, want = [], []
    for n in lengths:
        fits = [(r, k) for k, r in enumerate(room) if r >= n]
        if fits:
            want.append(min(fits)[0])
            room[min(fits)[1]] -= n
        else:
            want.append(100)
            room.append(100 - n)
    where, offset = packing.best_fit(lengths, 100)
    assert [100 - o for o in offset] == want and len(set(where)) == len(room)


# ---- edits -----------------------------------------------------------------------------


def test_counts_follow_edits(library):
    counter = token_counts.Counter(tokens.LibraryEncoder(tokens.load()))
    rng = random.Random(1)
    for text in ["", " ", "a", prose(1, 700), "  " + prose(2, 130).replace(" ", "\n"), "x" * 500, "é " * 300]:
        tree, now = token_counts.CountTree(text, counter), text
        for _ in range(25):
            a = rng.randint(0, len(now) + 3)
            b = a + rng.choice([0, 0, 1, 5, 30, 400, 3000])
            new = rng.choice(["", " ", "foo", "\n", "zz yy 'll", "Été " * 20])
            tree.edit(a, b, new)
            start = min(a, len(now))
            now = now[:start] + new + now[min(max(b, start), len(now)) :]
            assert tree.text() == now
        assert tree.total == len(library.encode(now, add_special_tokens=False).ids)


def test_only_touched_words_are_encoded():
    counter = token_counts.Counter(tokens.LibraryEncoder(tokens.load()))
    tree = token_counts.CountTree(prose(4, 5000), counter)
    tree.edit(9000, 9000, "new words here")
    assert tree.encoded_words <= 4


def test_edited_counts_of_a_table(spark, odd_docs, library):
    edits = spark.createDataFrame(
        [(4, 2, 0, 0, "second "), (4, 1, 5, 60, None), (6, 1, 100, 100, "x"), (1, 1, 0, 9, "born"), (77, 1, 0, 0, "no such document")],
        "doc_id long, seq int, start long, stop long, insert string",
    )
    got = {r.doc_id: r for r in token_counts.count_edits(token_counts.attach_edits(odd_docs, edits)).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 7, 8, 9} and got[1].edited == "born"
    plain = dict(texts(odd_docs))
    assert got[4].edited == "second " + plain[4][:5] + plain[4][60:]
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for i, r in got.items():
        assert (r.n_tokens_before, r.n_tokens) == (count(plain[i]), count(r.edited))
    revised = token_counts.count_edits(token_counts.revision(spark.read.parquet(f"{SF}/documents.parquet"))).collect()
    assert all(r.n_tokens == count(r.edited) and r.n_edits == 4 for r in revised)


def test_leaves_of_texts_laid_end_to_end():
    import pyarrow as pa

    counter = token_counts.Counter(tokens.LibraryEncoder(tokens.load()))
    some = ["", " é ", "ab", "cd", prose(1, 64), prose(2, 65) + "\n", "  " + prose(3, 200), "中文 " * 300, " ", "a\x1cb \u2003 c"]
    for text, (chars, sums) in zip(some, token_counts.leaves_of(pa.array(some), counter)):
        spans = [m.span() for m in token_counts.WORDS.finditer(text)]
        cuts = [0, *(a for a, _ in spans[64::64]), len(text)]
        assert chars.tolist() == [b - a for a, b in zip(cuts, cuts[1:])]
        words = [text[a:b] for a, b in spans]
        assert sums.tolist() == [int(counter.counts(words[k : k + 64]).sum()) for k in range(0, max(len(words), 1), 64)]


def test_later_edits_start_from_stored_trees(spark, odd_docs, library, monkeypatch):
    """Three rounds, each from the table the last one left: counts as of a full
    encoding, and only the touched words reach the encoder."""
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    trees = token_counts.build_trees(odd_docs)
    plain = {i: t for i, t in texts(odd_docs)}
    assert {(r.doc_id, r.text, sum(r.block_tokens), sum(r.block_chars)) for r in trees.collect()} == {(i, t, count(t), len(t)) for i, t in plain.items()}
    rounds = [
        [(4, 2, 0, 0, "second "), (4, 1, 5, 60, None), (6, 1, 100, 100, "x"), (1, 1, 0, 9, "born"), (77, 1, 0, 0, "no such document")],
        [(6, 1, 5000, 5000, " " + prose(77, 3000) + " "), (1, 1, 4, 4, " again"), (5, 1, 0, 10**9, "")],
        [(6, 1, 9000, 9004, "ed it"), (5, 1, 0, 0, "back"), (4, 1, 10**6, 0, " end"), (9, 1, 2, 3, "ﬁΣ")],
    ]
    for k, some in enumerate(rounds):
        edits = spark.createDataFrame(some, "doc_id long, seq int, start long, stop long, insert string")
        before = plain
        plain = dict(plain)
        for i, _, a, b, new in sorted(some, key=lambda e: e[:2]):
            if i in plain:
                t = plain[i]
                a, b = min(a, len(t)), min(max(a, b), len(t))
                plain[i] = t[:a] + (new or "") + t[b:]
        path = f"{token_counts.written.__globals__['fresh_path'](spark, 'test-trees')}"
        token_counts.edit_trees(token_counts.attach_edits(trees, edits)).write.parquet(path)
        trees = spark.read.parquet(path)
        for r in trees.collect():
            assert r.text == plain[r.doc_id] and (r.n_tokens_before, r.n_tokens) == (count(before[r.doc_id]), count(r.text)), (k, r.doc_id)
            assert sum(r.block_tokens) == r.n_tokens and sum(r.block_chars) == len(r.text) and max(r.block_chars, default=0) <= token_counts.LARGE_BLOCK
            touched = sum(len((new or "").split()) + 2 for i, _, _, _, new in some if i == r.doc_id)
            assert r.words_encoded <= touched
    assert token_counts.edit_trees(token_counts.revision(trees.where("false"))).count() == 0


def test_a_stored_tree_is_not_counted_again():
    """Of 5,000 words in the store, the encoder sees the edited ones only."""
    import pyarrow as pa

    encoder = tokens.LibraryEncoder(tokens.load())
    text = prose(4, 5000)
    leaves = token_counts.leaves_of(pa.array([text]), token_counts.Counter(encoder))[0]
    fresh = token_counts.Counter(encoder)
    tree = token_counts.CountTree(text, fresh, leaves)
    tree.edit(9000, 9000, "new words here")
    tree.stored()
    assert len(fresh.known) <= 6


class CountedCalls:
    """An encoder that notes what each of its calls was given."""

    def __init__(self):
        self.encode = tokens.LibraryEncoder(tokens.load())
        self.source, self.calls = self.encode.source, []

    def __call__(self, flat):
        self.calls.append(flat)
        return self.encode(flat)


def test_the_words_of_many_edits_are_encoded_in_one_call(library, monkeypatch):
    import pyarrow as pa

    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    rng = random.Random(5)
    some = [prose(k, 40 * k) for k in range(20)] + ["é " * 300, "x" * 500]
    edits = [[(rng.randint(0, 3000), rng.randint(0, 3000), f"new{i} w{k}ord ") for k in range(6)] for i in range(len(some))]
    edits[3] = None
    for waiting in (token_counts.WAITING, 50):
        monkeypatch.setattr(token_counts, "WAITING", waiting)
        encoder = CountedCalls()
        leaves = [token_counts.leaves_of(pa.array([t]), token_counts.Counter(encoder.encode))[0] for t in some]
        trees = token_counts.edited(some, leaves, edits, token_counts.Counter(encoder))
        if waiting > 50:
            assert len(encoder.calls) == 1
        for text, mine, tree in zip(some, edits, trees):
            for a, b, new in mine or ():
                a = min(a, len(text))
                text = text[:a] + new + text[min(max(a, b), len(text)) :]
            assert tree.text() == text and tree.total == count(text)
            # counts that waited came to the blocks where their words are now
            at = 0
            for size, n in zip(*tree.stored()):
                assert n == count(text[at : at + size])
                at += size
            assert at == len(text)


def test_words_met_again_are_not_encoded_again(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 3)
    encoder = CountedCalls()
    counter = token_counts.Counter(encoder)
    some = ["river", "stonefield", "riverstone", "clouds", "amberly", "norths"]
    first = counter.counts(some[:5])
    assert counter.counts([some[5], *some[:5]]).tolist()[1:] == first.tolist()
    assert encoder.calls == [some[:5], some[5:]]


# ---- archives --------------------------------------------------------------------------


def test_archives_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    rows = [(1, "http://a", None), (2, None, ""), (3, "u 3", prose(1, 50)), (4, "u", prose(1, 50)), (None, "u", prose(1, 50)), (6, "u", "é" * 70_000)]
    rows += [(10 + i, f"u{i}", prose(i % 20, 400)) for i in range(60)] + [(10, "u0", prose(0, 400))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("refers_to", F.lit("x")).withColumn("digest", F.lit(1))
    folder = str(tmp_path / "archives")
    made = warc.write_archives(pages, folder).collect()
    assert sum(m.records for m in made) == len(rows) and len(made) > 1
    first = {}
    for i, _, html in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        first.setdefault(html or "", i)
    want = collections.Counter()
    for i, _, html in rows:
        raw = (html or "").encode()
        leader = first.get(html or "")
        whole = i is None or i == leader
        want[(i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if whole else "revisit", None if whole else leader, raw if whole else None)] += 1
    got = warc.read_archives(spark, folder).collect()
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload and bytes(r.payload) if r.payload else r.payload if r.payload is None else b"") for r in got) == want
    assert {r.url for r in got if r.page_id == 3} == {"u 3"}
    empty = str(tmp_path / "none")
    assert warc.write_archives(pages.where("false"), empty).count() == 0 and warc.read_archives(spark, empty).count() == 0


def archive(records):
    return b"".join(a for a, _ in warc._archives(iter(records)))


def test_reader_refuses_what_is_damaged():
    records = [warc.record_bytes(i, "u", prose(i, 80).encode(), None) for i in range(30)]
    data = archive(records)
    assert [r["page_id"] for r in warc.read_archive(data)] == list(range(30))
    assert data[:4] == b"\x5d\x2a\x4d\x18"
    for broken in (data[4:], data[:-3], b"", data + b"junk!!!"):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(warc.read_archive(broken))
    good = records[0]
    for bad in (good.replace(b"WARC/1.1", b"WARC/9.9"), good[:-4], good.replace(b"WARC-Date", b"X-Date"), good.replace(b"river", b"rivex", 1) + b"",
                good.replace(b"WARC-Type: response", b"WARC-Type: other"), good.replace(b"\r\nWARC-Type", b"\r\nno colon\r\nWARC-Type")):
        if bad != good:
            with pytest.raises(ValueError):
                warc.parse_record(bad)


def test_reader_takes_a_compressed_dictionary():
    records = [warc.record_bytes(i, "u", prose(i, 80).encode(), None) for i in range(30)]
    data = archive(records)
    size = int.from_bytes(data[4:8], "little")
    packed = zstandard.ZstdCompressor().compress(data[8 : 8 + size])
    again = data[:4] + len(packed).to_bytes(4, "little") + packed + data[8 + size :]
    assert len(list(warc.read_archive(again))) == 30


# ---- models ----------------------------------------------------------------------------


def test_language_of_held_out_documents(spark, odd_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held_out = langid.crc_remainder("doc_id", 3) == langid.HELD_OUT
    model = langid.fit(docs, ~held_out)
    found = langid.predict(docs.where(held_out), model)
    hit = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert hit > 0.97
    odd = langid.predict(odd_docs, model)
    assert set(odd.columns) == set(odd_docs.columns)  # clashing names are replaced
    got = {r.doc_id: (r.lang_pred, r.score) for r in odd.collect()}
    assert [got[i] for i in (1, 2, 3)] == [("und", 0.0)] * 3
    assert all(0 <= s <= 1 for _, s in got.values())
    assert langid.predict(odd_docs.where("false"), model).count() == 0
    nothing = langid.fit(odd_docs, F.lit(False))
    assert {r.lang_pred for r in langid.predict(odd_docs, nothing).collect()} == {"und"}


def test_a_rare_language_is_learned_beside_a_common_one(spark):
    """The sample is bounded for each language: one with few documents keeps all."""
    rows = [(i, prose(i, 12), "en") for i in range(3000)] + [(5000 + i, " ".join(w[::-1] for w in prose(i, 12).split()), "xx") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, F.lit(True), train_docs=50)
    assert model.langs == ["en", "xx"] and np.exp(model.priors) == pytest.approx([3000 / 3004, 4 / 3004])
    hit = langid.predict(docs, model).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert hit > 0.99


def test_naive_bayes_equals_a_plain_one(spark):
    """Counts, log-probabilities and posteriors by loops over the n-grams."""
    import math

    rows = [(i, (prose(i, 9) if i % 3 else prose(i, 9)[::-1]) + " É1!", "en" if i % 3 else "xx") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, F.lit(True))

    def grams(text):
        chars = re.sub(r"[\W\d_]+", " ", text.lower())
        for n in langid.ORDERS:
            for k in range(len(chars) - n + 1):
                if n > 1 or chars[k] != " ":
                    code = 0
                    for c in chars[k : k + n]:
                        code = (code * 0x110001 + (0 if c == " " else ord(c)) + 1) % 2**64
                    yield int(langid.mix64(np.array([code + (n << 56)], np.uint64) if code + (n << 56) < 2**64 else np.array([(code + (n << 56)) % 2**64], np.uint64))[0]) % langid.BUCKETS

    counts = {k: collections.Counter() for k in ("en", "xx")}
    for _, t, k in rows:
        counts[k].update(grams(t))
    size = {k: sum(c.values()) + 0.1 * langid.BUCKETS for k, c in counts.items()}
    priors = {"en": 20 / 30, "xx": 10 / 30}
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    for i, t, _ in rows:
        logs = {k: math.log(priors[k]) + sum(math.log((counts[k][g] + 0.1) / size[k]) for g in grams(t)) for k in counts}
        best = max(sorted(logs), key=logs.get)
        assert got[i].lang_pred == best
        assert got[i].score == pytest.approx(1 / sum(math.exp(v - logs[best]) for v in logs.values()), abs=1e-3)


def test_language_counts_equal_a_plain_count():
    text = ["Ab, c!", "", "12", "ßé"]
    buckets, rows, has = langid.ngram_buckets(text)
    assert list(has) == [True, False, False, True]
    # a, b, ' ', c, ' ' -> 3 letters, 4 pairs, 3 triples; two letters, one pair
    assert list(np.bincount(rows, minlength=4)) == [3 + 4 + 3, 0, 0, 2 + 1]


def test_toxicity_of_held_out_documents(spark, odd_docs):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").repartition(4), spark.read.parquet(f"{d}/labels.parquet")
    held_out = langid.crc_remainder("doc_id", 4) == toxicity.HELD_OUT
    lexicon = toxicity.fit(docs, labels, ~held_out)
    judged = toxicity.score(docs.where(held_out), lexicon).join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in judged}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.85
    assert n.get((0, 1), 0) / (n[0, 0] + n.get((0, 1), 0)) < 0.02
    got = {r.doc_id: r.score for r in toxicity.score(odd_docs, lexicon).collect()}
    assert got[1] == got[2] == got[3] == lexicon.score("") and all(0 <= s <= 1 for s in got.values())
    assert toxicity.score(odd_docs.where("false"), lexicon).count() == 0
    assert toxicity.fit(docs, labels.where("toxic = 0"), F.lit(True)).terms == {}


def test_folding_matching_and_exceptions():
    lex = toxicity.Lexicon({"idiot": 3.0, "trash": 2.0}, ["trash can"], (-2.0, 1.0, 0.0))
    assert toxicity.fold("1DI0T, Тrаsh ｉｄｉｏｔ ab12 2024") == "idiot, trash idiot ab12 2024"
    assert lex.features("An 1d10t!")[0] == 3.0
    assert lex.features("idiotic trashy")[0] == 0.0
    assert lex.features("the trash can")[0] == 0.0 and lex.features("the trash")[0] == 2.0
    assert lex.features("trash " + "word " * 99)[1] < lex.features("trash")[1]
    assert lex.score("idiot") > lex.score("trash") > lex.score("")
