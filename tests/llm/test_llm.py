from __future__ import annotations

import random
import re
from collections import Counter
from hashlib import sha256
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import common, decontaminate, hashes, jaccard, language, licenses, pii, quality, repeats, sentencepieces, substrings, suffixes, tokens
from sparkloom.llm import queries as q
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns with names that operators use themselves.
CLASH = ["k", "t", "h", "x", "n", "s", "e", "words", "row", "here", "b", "comp", "own", "base", "held_out", "bad_id", "kept_id", "a.b", "text_hash"]
PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")


def words(rng, n, pool=400):
    return [f"w{rng.randrange(pool)}é" if rng.random() < 0.1 else f"W{rng.randrange(pool)}x" for _ in range(n)]


def corpus(seed=1, n=70):
    """Copies, near copies, shared passages, repeats inside a text, short and empty texts, a long one, nulls."""
    rng = random.Random(seed)
    texts = [" ".join(words(rng, rng.randint(1, 160))) for _ in range(n)]
    passage = " ".join(words(rng, 60))
    for i in range(0, n, 6):
        w = texts[i].split()
        texts.append(" ".join(w))
        for rate in (0.01, 0.03, 0.08):
            texts.append(" ".join(x if rng.random() > rate else "edit" for x in w))
        texts.append(f"{texts[i]}\n{passage}\n{texts[(i + 1) % n]}")
    texts += [f"a{i} {passage} b{i}" for i in range(12)]
    texts += [" ".join(words(rng, m, 30)) for m in range(0, 24) for _ in range(2)]
    base = words(rng, 14)
    texts += [" ".join([*base[:i], "zz", *base[i + 1 :]]) for i in range(14)] + [" ".join([*base, *base[:m]]) for m in range(6)]
    texts += ["", " \n\t", None, "one", "One", "one", "the the " * 300, "ab" * 300, "a" * 500, "▁ x  y▁", "é😀\x00 z", passage + " " + passage]
    texts.append(" ".join(words(rng, 6000, 3000)))
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


def frame(spark, docs, extra=False):
    df = spark.createDataFrame([(d, t, ("en", "de", None)[(d or 0) % 3], None if (d or 0) % 7 == 0 else "s", len(t or "")) for d, t in docs], SCHEMA)
    for c in CLASH if extra else ():
        df = df.withColumn(c, F.lit("clash"))
    return df.repartition(5)


def rows(df, *names):
    return sorted(map(tuple, df.select(*names).collect()), key=repr)


ITEMS = [(1, "W1x w2é w3 w4 w5 w6 w7 w8 w9 w10 w11"), (2, "zz top"), (3, ""), (4, None), (None, "edit W5x")]


@pytest.fixture(scope="module")
def docs():
    return corpus()


@pytest.mark.parametrize("extra", [False, True])
def test_decontaminate(spark, docs, extra):
    rng = random.Random(4)
    items = ITEMS + [(10 + i, " ".join(t.split()[a : a + 15])) for i, (_, t) in enumerate(docs[:40]) if (a := rng.randrange(20)) >= 0]
    df = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(frame(spark, docs, extra), df.withColumn("words", F.lit(1)) if extra else df)
    want = brute.decontaminate(docs, items)
    assert rows(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(want, key=repr)
    assert any(x[5] for x in want) and not all(x[5] for x in want)
    kept = decontaminate.clean(frame(spark, docs, extra), df)
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == [x[0] for x in want if not x[5]]


def test_decontaminate_spans(spark):
    """Overlapping windows merge; passages apart stay apart; items shorter than a window count whole, all lengths at once."""
    leak = [f"leak{i}" for i in range(40)]
    items = [(1, " ".join(leak[:25])), (2, " ".join(leak[15:])), (3, "three short words"), (4, "single"), (5, "a b c d e f g")]
    docs = [(1, " ".join(["x", *leak, "y"])), (2, " ".join([*leak[:12], "gap", *leak[20:32]])), (3, "some three short words and a single one"), (4, " ".join(leak[:9])), (5, "a b c d e f g a b c d e f g"), (6, "")]
    got = decontaminate.decontaminate(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), spans=True)
    assert {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in got.collect()} == {1: [(1, 41)], 2: [(0, 12), (13, 25)], 3: [(1, 4), (6, 7)], 4: [], 5: [(0, 14)], 6: []}
    assert rows(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(brute.decontaminate(docs, items), key=repr)


def test_clean_rows_of_one_id(spark):
    """A contaminated row takes no other row of its id along, null or not."""
    leak = " ".join(f"leak{i}" for i in range(12))
    docs = [(None, f"x {leak} y"), (None, "some clean text"), (None, None), (7, leak), (7, "another clean text"), (7, "another clean text"), (8, f"{leak} z")]
    kept = decontaminate.clean(frame(spark, docs, True), spark.createDataFrame([(1, leak)], "item_id long, text string"))
    assert rows(kept, "doc_id", "text") == sorted([docs[i] for i in (1, 2, 4, 5)], key=repr)


def test_decontaminate_without_broadcast(spark, docs, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    items = [(1, " ".join(docs[0][1].split()[:14])), (2, "edit")]
    got = decontaminate.decontaminate(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert rows(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(brute.decontaminate(docs, items), key=repr)


@pytest.mark.parametrize("extra", [False, True])
def test_substrings(spark, docs, extra):
    got = substrings.dedup(frame(spark, docs, extra))
    assert rows(got, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.substrings(docs), key=repr)


@pytest.mark.parametrize("bucket", [1, 2_000])
def test_suffixes(spark, docs, bucket, monkeypatch):
    """Whatever lies between two equal suffixes: other suffixes of a bucket, or its boundary."""
    monkeypatch.setattr(suffixes, "BUCKET_WINDOWS", bucket)
    got = suffixes.dedup(frame(spark, docs, True))
    assert rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.suffixes(docs), key=repr)


def test_suffixes_of_frequent_anchors(spark, monkeypatch):
    """One line before and after many different ones: each of its anchors has very many contexts."""
    rng = random.Random(3)
    line = "a line that very many of these documents have, word for word, in its whole length of over a hundred bytes."
    word = lambda: "".join(rng.choices("abcdefgh", k=60))
    docs = [(i, f"{word()} {line if i % 3 else line[:70]} {rng.choice((word(), 'x' * 60))}") for i in range(120)]
    monkeypatch.setattr(suffixes, "BUCKET_WINDOWS", 500)
    got = suffixes.dedup(frame(spark, docs))
    assert rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.suffixes(docs), key=repr)


def test_multikey_quicksort():
    import numpy as np

    rng = random.Random(1)
    for length, letters in ((8, b"ab"), (20, b"abcd"), (100, b"ab")):
        base = bytes(rng.choices(letters, k=900))
        data = base + base[:300] + bytes(rng.choices(letters, k=200)) + base[50:400] + b"\0" * 150
        columns = np.ndarray((len(data) + 1,), "<u8", data + bytes(8), strides=(1,))
        at = np.random.default_rng(2).permutation(len(data) - length + 1)
        order, group = suffixes.multikey_quicksort(columns, at, length)
        got, want = {}, {}
        for p, g in zip(at[order].tolist(), group.tolist(), strict=True):
            got.setdefault(g, set()).add(p)
        for p in at.tolist():
            want.setdefault(data[p : p + length], set()).add(p)
        assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def thue_morse(size):
    out = "a"
    while len(out) < size:
        out += out.translate(str.maketrans("ab", "ba"))
    return out, out.translate(str.maketrans("ab", "ba"))


def test_words_that_collide_in_polynomial_hashes(spark):
    """Two words on which any polynomial hash modulo a power of two agrees."""
    x, y = thue_morse(4096)
    docs = [(1, x), (2, y)] + [(10 + i, " ".join([f"w{j}" for j in range(34)] + [w])) for i, w in enumerate((x, y))] + [(20 + i, f"{w}{' z' * 40}") for i, w in enumerate((x, y))]
    d = frame(spark, docs)
    assert rows(jaccard.join(d), "doc_id", "n_shingles", "component_id") == sorted(brute.jaccard(docs), key=repr)
    assert rows(substrings.dedup(d), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.substrings(docs), key=repr)
    assert rows(suffixes.dedup(d), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.suffixes(docs), key=repr)
    assert len({int(h) for h in hashes.word_hashes(" ".join("a" * i for i in range(1, 200)).encode())}) == 199


@pytest.mark.parametrize("limit", [None, 0, 9, 17])
def test_jaccard(spark, docs, limit, monkeypatch):
    if limit is not None:
        monkeypatch.setattr(jaccard, "boundary", lambda *_: limit)
    monkeypatch.setattr(jaccard, "SAMPLE_DOCS", 100)
    monkeypatch.setattr(jaccard, "BLOCK", 3 if limit == 0 else 1000)
    want = sorted(brute.jaccard(docs), key=repr)
    assert rows(jaccard.join(frame(spark, docs, True)), "doc_id", "n_shingles", "component_id") == want
    if limit is None:
        kept = jaccard.keep_one(frame(spark, docs, True))
        assert len(kept.columns) == 5 + len(CLASH)
        assert sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(d for d, _, c in want if d == c)


def test_near_copies_of_one_text(spark, monkeypatch):
    """A large group of near copies, some of them near to few others only."""
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    rng = random.Random(9)
    base = words(rng, 120, 5000)
    docs = [(i, " ".join(w if rng.random() > rng.choice((0.005, 0.02, 0.04)) else f"e{rng.randrange(10**6)}" for w in base)) for i in range(150)]
    assert rows(jaccard.join(frame(spark, docs)), "doc_id", "n_shingles", "component_id") == sorted(brute.jaccard(docs), key=repr)


@pytest.mark.parametrize("short", [None, 0, 5])
def test_rows_of_short_lists_have_no_sketches(spark, short, monkeypatch):
    """Sets that share passages, and near copies, in lists of some sets: whatever is listed by sizes alone, the links are the same."""
    if short is not None:
        monkeypatch.setattr(jaccard, "SHORT_LIST", short)
    written, write = [], jaccard.Tables.write

    def watched(self, df):
        out = write(self, df)
        written.append(out.count() if {"h", "b"} <= set(df.columns) else 0)
        return out

    monkeypatch.setattr(jaccard.Tables, "write", watched)
    rng = random.Random(21)
    passages, base = [words(rng, 40, 10**6) for _ in range(12)], words(rng, 120, 10**6)
    docs = [(i, " ".join([*words(rng, 30, 10**6), *passages[i % 12], *words(rng, 30, 10**6)])) for i in range(60)]
    docs += [(100 + i, " ".join(w if rng.random() > rng.choice((0.005, 0.02, 0.04)) else f"e{rng.randrange(10**6)}" for w in base)) for i in range(40)]
    assert rows(jaccard.join(frame(spark, docs)), "doc_id", "n_shingles", "component_id") == sorted(brute.jaccard(docs), key=repr)
    assert (sum(written) > 0) == (short is not None)


def test_links_share_enough_of_their_prefixes(spark):
    """No linked pair shares fewer prefix shingles than ``_ENOUGH`` asks for, at any sizes; of equal sizes it asks for many."""
    rng = np.random.default_rng(8)
    levels, found = np.arange(1 << 16, dtype=np.uint64).astype(np.uint8), []
    for _ in range(4000):
        na = int(rng.integers(1, 250))
        nb = int(rng.integers(-(-8 * na // 10), na + 1))
        shared = -(-4 * (na + nb) // 9)
        if shared <= nb:
            every = np.unique(rng.integers(0, 1 << 63, na + nb - shared, dtype=np.uint64))
            # Those of the one set alone come first in the order, last, or anywhere.
            every = every[np.argsort(levels[jaccard._counter(every, 16)])] if rng.random() < 0.7 else rng.permutation(every)
            every = every[::-1] if rng.random() < 0.5 else every
            a, b = every[:na], every[na - shared :]
            a, b = (set(jaccard._own_postings(np.sort(x), levels, 0)[0].tolist()) for x in (a, b))
            found.append((len(a & b), na, nb))
    assert len(found) > 2000
    df = spark.createDataFrame(found, "m long, na long, nb long")
    assert df.where(f"NOT ({jaccard._ENOUGH})").isEmpty()
    assert spark.sql(f"SELECT {jaccard._ENOUGH} FROM VALUES (8, 90, 90), (9, 90, 90), (1, 100, 80) AS t(m, na, nb)").collect() == [(False,), (True,), (True,)]


def test_order_counts_all_documents(spark, monkeypatch):
    """Sizes and shingles are counted over every row, however few a sample would have."""
    monkeypatch.setattr(jaccard, "SAMPLE_DOCS", 10)
    seen = []
    monkeypatch.setattr(jaccard, "boundary", lambda sizes, extra: seen.append((sizes, extra)) or 0)
    rng = random.Random(3)
    docs = [(i, "the same five words here " + words(rng, 8, 10**6)[0] if i % 2 else " ".join(words(rng, 30, 10**6))) for i in range(400)] + [(900, None)]
    levels, limit = jaccard._order(frame(spark, docs).repartition(7))
    true = Counter(h for _, t in docs for h in jaccard.shingles(t).tolist())
    counters = Counter()
    for h, c in true.items():
        counters[h >> 48] += c
    assert (len(levels), limit) == (1 << 16, 0)
    assert levels.tolist() == jaccard._levels(np.array([counters[i] for i in range(1 << 16)])).tolist()
    assert sum(seen[0][0].values()) == 401 and seen[0][0][0] == 1 and max(true.values()) == 200


def test_centre_of_near_copies(spark):
    """``near`` of a set is the share of its prefix that is let through: the text itself before its near copies."""
    rng = random.Random(5)
    base = words(rng, 120, 10**6)
    places = [rng.sample(range(120), 2) for _ in range(12)]
    docs = [(1, " ".join(base))] + [(10 + i, " ".join(f"e{i}x{j}" if j in at else w for j, w in enumerate(base))) for i, at in enumerate(places)]
    rows_ = frame(spark, docs).select("doc_id", F.xxhash64("text").alias("t"), "text")
    levels, _ = jaccard._order(rows_)
    found = jaccard._scanned(rows_, spark.sparkContext.broadcast(levels), 0).cache()
    often = found.select(F.explode("hs").alias("h")).groupBy("h").count().where("count > 1")
    near = jaccard._postings(found, common.bloom(often, "h", often.count())).join(found.select("d1", "doc_id"), "d1")
    least = dict(near.groupBy("doc_id").agg(F.max("near")).collect())
    assert all(least[1] > v for d, v in least.items() if d != 1)


def variants(words_, n, at):
    """A text and one near to it."""
    other = list(words_)
    other[at] = f"edit{n}"
    return " ".join(words_), " ".join(other)


def test_jaccard_of_null_and_repeated_ids(spark):
    rng = random.Random(12)
    (a, a2), (b, b2), (c, c2), (e, e2) = (variants(words(rng, 80, 10**6), i, 7) for i in range(4))
    none, (f, f2) = "only null ids " * 3, variants(words(rng, 60, 10**6), 9, 5)
    docs = [(None, a), (5, a2), (None, b), (7, b2), (3, c), (3, e), (8, c2), (9, e2), (9, e2), (None, None), (None, ""), (None, none), (None, none), (11, ""), (11, ""), (4, f), (4, f2), (4, f)]
    want = [(None, 5), (5, 5), (None, 7), (7, 7), (3, 3), (3, 3), (8, 3), (9, 3), (9, 3), (None, None), (None, None), (None, None), (None, None), (11, 11), (11, 11), (4, 4), (4, 4), (4, 4)]
    for parts in (1, 8):
        assert rows(jaccard.join(frame(spark, docs).repartition(parts)), "doc_id", "component_id") == sorted(want, key=repr)
    kept = rows(jaccard.keep_one(frame(spark, docs)), "doc_id", "text")
    assert [x for x in kept if x[0] != 4] == sorted([(5, a2), (7, b2), (3, c), (3, e), (None, None), (None, ""), (None, none), (11, ""), (11, "")], key=repr)
    assert [x in ((4, f), (4, f2)) for x in kept if x[0] == 4] == [True]


def test_blocks_meet_once(spark, monkeypatch):
    """Each pair of a list that sizes allow is compared in one block pair, and few rows have one key."""
    monkeypatch.setattr(jaccard, "BLOCK", 20)
    rng = random.Random(7)
    sets = [(1, i, rng.randint(20, 400), i, [0]) for i in range(400)] + [(2, i, 50, i, [0]) for i in range(15)]
    x, y = jaccard._blocked(spark.createDataFrame(sets, "h long, id long, n int, comp long, b array<long>"))
    key = ["h", "lo", "hi", "i", "j"]
    met = x.join(y, key).where("lo < hi OR i < j OR a < b").select("h", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = [tuple(r) for r in met.collect()]
    assert len(pairs) == len(set(pairs))
    size = {(h, i): n for h, i, n, *_ in sets}
    want = {(h, a, b) for h, a, *_ in sets for b in range(a + 1, 400) if (h, b) in size and 10 * min(size[h, a], size[h, b]) >= 8 * max(size[h, a], size[h, b])}
    assert want <= set(pairs)
    assert x.groupBy(*key).count().agg(F.max("count")).first()[0] < 60


def test_subsets_cover_every_overlap():
    for n in range(1, 25):
        for m in range(n, 32):
            c = -(-4 * (n + m) // 9)
            linkable = c <= n
            assert (c in jaccard.subset_sizes(n) and c in jaccard.subset_sizes(m)) or not linkable


def test_quality(spark, docs):
    more = docs + [(9001, "ALL CAPS HERE " * 10), (9002, "fine words go here. " * 3 + "x\n" * 3), (9003, " ".join(f"a{i} a{i}" for i in range(30))), (9004, " ".join(f"word{i} ###" for i in range(40)))]
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    want = sorted(brute.quality(more), key=repr)
    df = frame(spark, more, True)
    order = quality.plan(df)
    assert {r.name for r in order} == {r.name for r in quality.RULES}
    # Texts that one rule rejects, at the end of the table: the sample has them, so the rule comes first.
    tail = spark.range(0, 3000, 1, 6).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 1500, F.lit("fine words go here for all of them to read " * 4)).otherwise(F.lit("words ### " * 40)).alias("text"))
    assert quality.plan(tail, sample_rows=300)[0].name == "symbols"
    for o in (order, order[::-1]):
        assert rows(quality.score(df, o), *names) == want
    assert sorted(r[0] for r in quality.keep(df).select("doc_id").collect()) == sorted(x[0] for x in want if x[-1])
    assert quality.score(df).where("kept AND n_repeat_words >= 0").count() == sum(x[-1] for x in want)


def test_tokens(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTES)
    more = docs + [(9001, "a<|endoftext|>b <|endoftext|>"), (9002, ("Some words, and more 12 34.\n\n  x " * 4000))]
    want = [(d, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 1024) for d, x in more]
    assert rows(tokens.count_tokens(frame(spark, more, True), BYTES), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)
    count = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    other = ["这是一个句子。那是另一个,真的!" * 9, "Это слово, и ещё 12 слов: да.", "ひらがなとカタカナ、漢字。" * 5, "if(a==b){return c['d'].e(f,g)}else{h=1}" * 4, "don't we'll it's I'm", "x  y\n\n z\t", "नमस्ते दुनिया। ठीक", "a<|endoftext|>b<|endoftext|> c", "مرحبا، بالعالم", "é́a b", "한국어 문장, 이다."]
    for size in (1, 7, 60):
        for x in other + [x for _, x in docs if x and len(x) < 3000]:
            cut = list(tokens.pieces(x, BYTES, size))
            assert "".join(cut) == x and sum(map(count, cut)) == count(x), x
    assert max(len(p.encode()) for p in tokens.pieces("一句话。" * 100_000, BYTES)) < 2 * tokens.PIECE_BYTES


def test_sentencepieces(spark, docs, monkeypatch):
    v = sentencepieces.Vocabulary(PIECES)
    more = docs + [(9001, "  lead  and trail  "), (9002, "x" * 900), (9003, "é" * 200 + "\n\n\t😀ﬁ"), (9004, "<s> </s> <0x41>")]
    want = []
    for d, t in more:
        ids = v.library.encode(t or "", add_eos=True)
        want.append((d, len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(v.library.decode(ids)), t))
    got = sentencepieces.encode_decode(frame(spark, more, True), PIECES, texts=True)
    assert rows(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted([x[:4] for x in want], key=repr)
    assert got.agg(F.sum("n_corrected")).first()[0] == 0
    monkeypatch.setattr(sentencepieces, "TABLE_CHUNKS", 10)
    again = [v.run([t]) for _, t in more]
    assert [sha256(a[0][0].encode()).hexdigest() for a in again] == [x[2] for x in want]
    for c in ("▁" + "ab" * 100, "▁▁▁", "▁" + "é😀" * 60):
        assert [s for s in v._heap(c) if s] == v._scan(c)


def test_language(spark):
    rng = random.Random(2)
    stems = {"en": ["the", "and", "ing", "tion", "of", "er"], "de": ["der", "und", "ung", "sch", "ein", "ß"], "fr": ["les", "et", "eau", "ment", "é", "que"]}
    say = lambda lang, n: " ".join("".join(rng.choices(stems[lang], k=rng.randint(1, 3))) for _ in range(n))
    data = [(i, say(lang, 30), lang, "s", 1) for i, lang in enumerate(["en", "de", "fr"] * 60)]
    data += [(900, None, "en", None, 1), (901, "12 34!", "de", None, 1), (902, "", None, None, 1), (903, say("de", 30) + " " + say("fr", 60), None, None, 1), (None, say("en", 30), "en", None, 1)]
    got = {r["doc_id"]: r for r in language.identify(spark.createDataFrame(data, SCHEMA).withColumn("held_out", F.lit("x"))).collect()}
    for d, t, lang, *_ in data[:180]:
        assert got[d]["lang_pred"] == lang and 0.5 < got[d]["score"] <= 1
        assert got[d]["held_out"] == (crc32(str(d).encode()) % 5 == 0)
    assert [got[d]["lang_pred"] for d in (900, 901, 902)] == ["und"] * 3 and got[None]["lang_pred"] == "en"
    model = language.learn(spark.createDataFrame(data, SCHEMA))
    for d, text in ((0, data[0][1]), (1, data[1][1]), (903, data[183][1]), (904, "a"), (905, "the the und")):
        said, score = model.infer(text)
        want, sure = brute.language(model, text)
        assert [x for x, _ in said] == [x for x, _ in want] and abs(score - sure) < 1e-6 and all(abs(u - v) < 1e-6 for (_, u), (_, v) in zip(said, want, strict=True))
    assert model.infer("a")[1] < 0.9 < model.infer(data[0][1])[1]
    mixed = dict(x.split(":") for x in got[903]["languages"].split(","))
    assert set(mixed) == {"de", "fr"} and abs(float(mixed["fr"]) - 2 / 3) < 0.12
    empty = language.identify(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0
    assert language.identify(spark.createDataFrame([(1, "abc", None, None, 3)], SCHEMA)).first()["lang_pred"] == "und"
    with pytest.raises(ValueError, match="languages"):
        language.learn(spark.range(language.MOST_LANGUAGES * 2).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.col("id").cast("string").alias("lang")))


def test_language_on_held_out(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    right = language.identify(d).where("held_out").join(d, "doc_id").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.95


# Notices as projects carry them, written out here.
MIT = """MIT License

Copyright (c) 2020 A. Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
GPL = """/* This program is free software{0} you can redistribute it and/or modify
 * it under the terms of the GNU {1}General Public License as published by
 * the Free Software Foundation{2} either version {3} of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU {1}General Public License for more details.
 */
"""
APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS.
# See the License for the specific language governing permissions and
# limitations under the License.
"""


def test_licenses(spark):
    mozilla = "// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy of the MPL was not distributed with this\n// file, You can obtain one at https://mozilla.org/MPL/2.0/.\nint x;"
    texts = [
        (MIT, "MIT"), (BSD, "BSD-2-Clause"), (BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be\n   used to endorse or promote products derived from this software without\n   specific prior written permission.\n", "BSD-3-Clause"),
        (GPL.format(":", "", ",", 3), "GPL-3.0-or-later"), (GPL.format(";", "", ";", 2), "GPL-2.0-or-later"), (GPL.format(":", "Affero ", ",", 3), "AGPL-3.0-or-later"), (APACHE, "Apache-2.0"), (mozilla, "MPL-2.0"),
        (MIT.replace("\n", "\r\n"), "MIT"), ("".join(f" * {x}\n" for x in MIT.split("\n")), "MIT"), (MIT + "\n" + APACHE, "Apache-2.0,MIT"),
        ("This program is free software: it was written in a weekend.", ""), ("This program is free software.", ""), (GPL.format(":", "", ",", 3).replace("General", "Special"), ""), (MIT.replace("obtaining a copy", "making a copy"), ""),
        ("x\nReleased under the MIT License.\ny", "MIT"), ("It is not released under the MIT License.", ""), ("SPDX-License-Identifier: LGPL-2.1-or-later", "LGPL-2.1-or-later"), ("Licensed under CC BY-NC-SA 4.0.", "CC-BY-NC-SA-4.0"),
        ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0-only"), ("This work is licensed under the GNU General Public License,\nversion 3 or later.", "GPL-3.0-or-later"),
        (None, ""), ("", ""), ("Nothing. At all", ""), ("| bar | none |", ""), ("word " * 40_000 + "\n" + MIT, "MIT"),
    ]
    docs = [(i, t) for i, (t, _) in enumerate(texts)] + [(7, "Nothing. At all"), (None, MIT)]
    got = rows(licenses.scan(frame(spark, docs, True)), "doc_id", "licenses")
    assert got == sorted([*((i, x) for i, (_, x) in enumerate(texts)), (7, ""), (None, "MIT")], key=repr)


def test_license_gap_and_positions(spark):
    s = licenses.SENTENCES
    far = "\n".join([s[62], *["something else"] * (licenses.GAP + 1), s[63]])
    near = "\n".join(["first", s[40], "2001", s[41], *["a line"] * licenses.GAP, s[42], s[43]])
    got = rows(licenses.scan(frame(spark, [(1, far), (2, near)])), "doc_id", "licenses", "sentence_ids", "positions", "n_known")
    assert got == [(1, "MPL-2.0", "<62><63>", f"0,{licenses.GAP + 2}", 2), (2, "BSD-3-Clause", "<40><41><42><43>", f"1,3,{licenses.GAP + 4},{licenses.GAP + 5}", 4)]
    assert len({n for n, _ in licenses.RULES}) >= 30 and all(re.search(licenses._MAY, s) for s in licenses.KNOWN)
    whole = re.compile(licenses._alternatives())
    assert all(whole.fullmatch(s) and not whole.fullmatch(s + "x") for s in licenses.KNOWN)


def test_licenses_same_as_sql(spark, duck):
    """The query's SQL finds sentences by joins."""
    import duckdb

    texts = [MIT, BSD, APACHE, *(GPL.format(":", a, ",", 3) for a in ("", "Affero ")), GPL.format(";", "", ";", 2), "plain\ntext", None, "", f"{MIT}\n{APACHE}\n\nReleased under the MIT License. Released under\nthe MIT License.", "Licensed under\nCC BY\n4.0.\nx", "Licensed under CC BY 4.0. Licensed under CC0 1.0 Universal."]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    names = ("doc_id", "n_sentences", "n_known", "sentence_ids", "positions", "licenses")
    assert rows(licenses.scan(frame(spark, list(enumerate(texts)))), *names) == sorted(con.sql(f"SELECT {', '.join(names)} FROM ({licenses.ORACLE})").fetchall(), key=repr)


PII = ["mail a.b+c@x-y.example.com, a@b@c.d e@f", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8", "4111 1111 1111 1111 and 4111111111111112", "+1 (234) 555-6789 +12 +1234567890123456", "", None, "token = \"f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda\" x", "plain words"]


def test_pii(spark):
    rng = random.Random(6)
    docs = list(enumerate(PII))
    docs += [(100 + i, "".join(rng.choice(["a", "@", ".", "1", "22", "-", "+", "b.c", " ", "(", "é", "4111", "0", "\n"]) for _ in range(rng.randint(1, 60)))) for i in range(300)]
    docs += [(900 + i, f"key = \"{sha256(str(i).encode()).hexdigest()[:40]}\"") for i in range(20)] + [(950, "x" * 50_000), (951, "1" * 50_000), (952, "a@" * 9_000)]
    got = {r["doc_id"]: r for r in pii.find_pii(frame(spark, docs, True)).collect()}
    for d, t in docs:
        base = sorted(brute.base_spans(t or "") if len(t or "") < 1000 else [], key=lambda x: (pii.ORDER[x[0]], x[1]))
        said = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert got[d]["base_sha256"] == brute.sha(said), t
        assert [got[d][f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in base) for k in pii.KINDS]
        assert set(said.split(",")) - {""} <= set(got[d]["spans"].split(","))
    assert got[7]["spans"] == "" and "secret:" in got[900]["spans"]
    clean = {r["doc_id"]: r["text"] for r in pii.redact(frame(spark, docs)).collect()}
    assert clean[0] == "mail <email>, a@<email> e@f" and clean[5] is None and clean[7] == "plain words" and "f3ef4d" not in clean[6]


def iban(rng):
    flat = "".join(rng.choices("0123456789", k=18))
    check = 98 - int(flat + "131400") % 97  # D is 13, E is 14
    return f"DE{check:02d}{flat}"


def planted(rng, n):
    """(text, kind, span, whether it is personal data): what a wide pattern may match, half of it harmless."""
    hexa = lambda k: "".join(rng.choices("0123456789abcdef", k=k))
    num = lambda k: "".join(rng.choices("0123456789", k=k))
    letters = lambda k: "".join(rng.choices("abcdefghijklmnopqrstuvw", k=k))
    kinds = [
        lambda: ("secret", "token = \"", hexa(40), "\"", True),
        lambda: ("secret", "api_key: ", hexa(200), " end", True),
        lambda: ("secret", "a long word ", letters(26), " here", False),
        lambda: ("secret", "password: ", f"{letters(5)}{num(3)}!", " ok", True),
        lambda: ("secret", "password: ", letters(8), " ok", False),
        lambda: ("email", "contact: ", f"{letters(6)} [at] {letters(7)} [dot] com", " now", True),
        lambda: ("ip", "host ", ":".join(hexa(4) for _ in range(8)), " up", True),
        lambda: ("iban", "IBAN ", iban(rng), " please", True),
        lambda: ("iban", "code ", f"QX99{num(18)}", " please", False),
        lambda: ("phone", "Call ", f"020 7{num(3)} {num(4)}", " today", True),
        lambda: ("ssn", "my ssn ", f"12{rng.randint(1, 8)}-4{rng.randint(1, 9)}-{rng.randint(1000, 9999)}", " is", True),
        lambda: ("ssn", "part no ", f"9{num(2)}-00-{num(4)}", " is", False),
    ]
    for i in range(n):
        kind, before, span, after, true = kinds[i % len(kinds)]()
        yield f"Some words, {before}{span}{after} and more.", kind, (12 + len(before), 12 + len(before) + len(span)), true


def test_added_spans_of_planted_data(spark):
    """Accuracy on spans that are known, without their labels having been seen."""
    rng = random.Random(21)
    made = list(planted(rng, 1200))
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(frame(spark, [(i, t) for i, (t, *_) in enumerate(made)])).collect()}
    said = {i: f"{kind}:{s}:{e}" in got[i].split(",") for i, (_, kind, (s, e), _) in enumerate(made)}
    for kind in {m[1] for m in made}:
        of = [(said[i], m[3]) for i, m in enumerate(made) if m[1] == kind]
        assert sum(a == b for a, b in of) >= 0.95 * len(of), (kind, [made[i] for i, m in enumerate(made) if m[1] == kind and said[i] != m[3]][:5])
    trust = pii.reliabilities(frame(spark, [(i, t) for i, (t, *_) in enumerate(made)]))
    assert set(trust) >= {m[1] for m in made} and all(0.55 <= trust[k][n] <= 0.99 for k in trust for n in pii.LABELERS)


def test_candidates():
    x = "".join(random.Random(5).choices("abcdefghijkmnopqrstuvwxyzABCDEFGH", k=200))
    for text, kind, span in (
        (f"key = {x}", "secret", x), (f"the token: '{x}'", "secret", x), ("password: hunter2 ok", "secret", "hunter2"), ("Call 020 7946 0958", "phone", "020 7946 0958"),
        ("at 12 Baker Street, London", "address", "12 Baker Street"), ("in der Lindenstraße 12a", "address", "Lindenstraße 12a"), ("Dear Mr. Jones, hi", "name", "Jones"),
        ("write to jane at example dot com", "email", "jane at example dot com"), ("from fe80::1ff:fe23:4567:890a on", "ip", "fe80::1ff:fe23:4567:890a"), ("by Maria Garcia Ana Lopez", "name", "Ana Lopez"),
    ):
        assert (kind, text.index(span), text.index(span) + len(span)) in pii.candidates(text, pii.base_spans(text)), text
    assert pii.candidates("no such thing is in here, www.example.com/" + "a" * 19, []) == [] and pii.candidates("", []) == []


def test_pii_sample_of_each_kind(spark, monkeypatch):
    """A rare kind keeps its spans when a frequent one has more candidates than the sample."""
    docs = [(i, f"key = \"{sha256(str(i).encode()).hexdigest()[:40]}\"") for i in range(400)]
    docs += [(1000 + i, f"contact: jane.doe{i} [at] example [dot] com") for i in range(4)]
    found = lambda: [r for r in rows(pii.find_pii(frame(spark, docs)), "doc_id", "spans") if "email:" in r[1]]
    whole = found()
    assert len(whole) == 4
    monkeypatch.setattr(pii, "SAMPLE", 20)
    assert found() == whole
    assert not any("jane" in r["text"] for r in pii.redact(frame(spark, docs)).collect())


def test_em_and_classifier():
    import numpy as np

    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.3
    votes = np.stack([np.where(rng.random(4000) < a, 2 * truth - 1, 1 - 2 * truth) for a in (0.95, 0.8, 0.6)], 1)
    p, accuracy, share = pii.em(votes, np.ones(4000))
    assert abs(share - 0.3) < 0.05 and accuracy[0] > accuracy[1] > accuracy[2] and ((p > 0.5) == truth).mean() > 0.93
    x = np.stack([np.ones(4000), truth + 0.1 * rng.standard_normal(4000)], 1)
    assert ((x @ pii.logistic(x, p) > 0) == truth).mean() > 0.95


def test_empty_tables(spark):
    d, b = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    for out in (
        decontaminate.decontaminate(d, b), substrings.dedup(d), quality.score(d), jaccard.join(d), tokens.count_tokens(d, BYTES), language.identify(d),
        licenses.scan(d), sentencepieces.encode_decode(d, PIECES), suffixes.dedup(d), pii.find_pii(d), pii.redact(d), jaccard.keep_one(d), quality.keep(d), decontaminate.clean(d, b),
    ):
        assert out.count() == 0
    one = spark.createDataFrame([(1, "some words", None, None, None)], SCHEMA)
    assert decontaminate.decontaminate(one, b).first()["n_hit"] == 0


def test_nulls_and_repeated_rows(spark):
    t = " ".join(f"word{i}" for i in range(60))
    docs = [(None, t), (5, t), (5, t), (6, None), (None, None), (7, t + " more")]
    d = frame(spark, docs)
    assert rows(substrings.dedup(d), "doc_id", "n_words", "n_removed") == sorted([(None, 60, 60), (5, 60, 60), (5, 60, 60), (6, 0, 0), (None, 0, 0), (7, 61, 60)], key=repr)
    assert rows(suffixes.dedup(d), "doc_id", "n_removed") == sorted([(None, 0), (5, len(t)), (5, len(t)), (6, 0), (None, 0), (7, len(t))], key=repr)
    assert rows(jaccard.join(d), "doc_id", "component_id") == sorted([(None, 5), (5, 5), (5, 5), (6, 6), (None, None), (7, 5)], key=repr)
    assert len(rows(decontaminate.decontaminate(d, spark.createDataFrame([(1, t)], "item_id long, text string")), "doc_id", "n_hit")) == 6
    for out in (quality.score(d), tokens.count_tokens(d, BYTES), language.identify(d), licenses.scan(d), sentencepieces.encode_decode(d, PIECES), pii.find_pii(d)):
        assert out.count() == 6


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(240)] + [(i, i + 1) for i in range(400, 460)] + [(500, x) for x in range(501, 560)]
    root = {v: v for e in edges for v in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = common.components(spark, spark.createDataFrame(edges, "a long, b long"), common.Tables(spark, "t"))
    loops = {a for a, b in edges if a == b} - {v for a, b in edges if a != b for v in (a, b)}
    assert rows(got, "v", "comp") == sorted([(v, find(v)) for v in root if v not in loops], key=repr)
    assert common.components(spark, spark.createDataFrame([], "a long, b long"), common.Tables(spark, "t")).count() == 0


def test_bit_field(spark):
    import numpy as np

    df = spark.range(0, 5000, 7)
    field = common.bloom(df, "id", df.count())
    assert common.maybe_in(field, np.arange(0, 5000, 7)).all()
    assert common.maybe_in(field, np.arange(10**6, 10**6 + 10_000)).mean() < 0.1


def test_runs_depend_on_content_alone():
    import numpy as np

    rng = np.random.default_rng(5)
    a = rng.integers(0, 2**63, 300, dtype=np.uint64)
    b = np.concatenate([rng.integers(0, 2**63, 41, dtype=np.uint64), a[100:200]])
    for length, gram in ((35, 8), (100, 32), (20, 20)):
        if length > 100:
            continue
        x, y = (repeats.runs(v, length, gram) for v in (a, b))
        at = lambda r: {s: p - s for _, p, f, e in zip(*r, strict=True) for s in range(f, e + 1)}
        u, v = at(x), at(y)
        assert sorted(u) == list(range(300 - length + 1))
        assert all(u[100 + i] == v[41 + i] for i in range(100 - length + 1))


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_queries_same_as_sql(same_rows, name):
    same_rows(q.queries()[name], q.oracle_sql()[name])


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    kept = [(d, docs[d]) for d, *_, ok in brute.quality(list(docs.items())) if ok]
    kept = [(d, docs[d]) for d, _, c in brute.jaccard(kept) if d == c]
    kept = [(d, docs[d]) for d, *_, bad in brute.decontaminate(kept, items) if not bad]
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(got) == {d for d, _ in kept}
    v = sentencepieces.Vocabulary(PIECES)
    # The spans that the operator finds in what is left, taken out by hand.
    spans = {r["doc_id"]: [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in r["spans"].split(",") if x)] for r in pii.find_pii(spark.createDataFrame(kept, "doc_id long, text string")).collect()}
    assert any(spans.values()) and all(set(brute.base_spans(t)) <= set(spans[d]) for d, t in kept)
    for d, t in kept:
        at, parts = 0, []
        for k, s, e in sorted(spans[d], key=lambda x: (x[1], -x[2])):
            if s >= at:
                parts += [t[at:s], f"<{k}>"]
            at = max(at, e)
        ids = v.library.encode("".join([*parts, t[at:]]), add_eos=True)
        assert got[d]["ids_sha256"] == brute.sha(" ".join(map(str, ids)))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "benchmark_decontamination", "personal_data", "sentencepiece"]


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Null and repeated ids, null and empty texts, repeated rows, columns that clash, and empty tables, through all stages."""
    import corpus_pipeline

    rng = random.Random(31)
    say = lambda n: " ".join("".join(rng.choices("abcdefghijklmnoprstuw", k=rng.randint(2, 8))) for _ in range(n)) + "."
    a, b, c, e, leak = say(60), say(60), say(60), say(60), say(30)
    secret = f"{c} token = \"{sha256(b'x').hexdigest()[:40]}\" and mail x.y@example.com"
    docs = [(1, a), (1, a), (3, a), (None, b), (None, e), (None, None), (2, ""), (None, ""), (4, f"{say(40)} {leak} {say(10)}"), (5, secret), (5, say(50)), (6, "short text")]
    frame(spark, docs, True).drop("a.b").write.parquet(str(tmp_path / "odd" / "documents.parquet"))
    spark.createDataFrame([(1, leak), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "odd" / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    assert sorted((r["doc_id"] or 0) for r in got) == [0, 0, 1, 5, 5]
    v = sentencepieces.Vocabulary(PIECES)
    digests = {r["ids_sha256"] for r in got}
    for t in (a, b, e, f"{c} token = \"<secret>\" and mail <email>"):
        assert brute.sha(" ".join(map(str, v.library.encode(t, add_eos=True)))) in digests
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "none" / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_scratch_clears_what_operators_leave(spark):
    import os

    def left():
        root = common.shared_dir(spark).removeprefix("file://")
        return {d for d in os.listdir(root) if d.startswith(("substrings-", "pii-"))}

    docs, before = frame(spark, [(i, f"key = {sha256(str(i).encode()).hexdigest()}") for i in range(4)]), left()
    with common.scratch(spark):
        assert substrings.dedup(docs).count() == pii.find_pii(docs).count() == 4
        assert left() > before
    assert left() == before


def test_redact_keeps_clashing_columns(spark):
    docs = [(1, "mail a@b.example.com"), (None, None), (2, "")]
    got = pii.redact(frame(spark, docs, True))
    assert got.columns == frame(spark, docs, True).columns
    assert rows(got, "doc_id", "text", "k", "base", "`a.b`") == sorted([(1, "mail <email>", "clash", "clash", "clash"), (None, None, "clash", "clash", "clash"), (2, "", "clash", "clash", "clash")], key=repr)
