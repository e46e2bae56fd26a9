"""Itemsets, the transducer lexicon and the prefix trie against brute force."""

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import public_tokenizers as V
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quirefold.llm import itemsets, lexicon, prefix_trie, queries

WORD_BPE = V.path("word_bpe_49k.json")


def brute_closed(rows, least):
    """{frequent closed set: support}, all frequent sets with their supports, and the number of baskets."""
    baskets = defaultdict(set)
    for b, i in rows:
        if b is not None and i is not None:
            baskets[b].add(i)
    support = defaultdict(int)
    for items in baskets.values():
        for n in range(1, len(items) + 1):
            for s in itertools.combinations(sorted(items), n):
                support[s] += 1
    support = {s: n for s, n in support.items() if n >= least}
    closed = {s: n for s, n in support.items() if not any(set(s) < set(t) and n == m for t, m in support.items())}
    return closed, support, len(baskets)


def brute_rules(closed, support, total, confidence):
    out = {}
    for s, n in closed.items():
        out[s] = []
        for c in s if len(s) > 1 else ():
            a = support[tuple(x for x in s if x != c)]
            if 100 * n >= confidence * a and n * total > a * support[c,]:
                out[s].append((c, a, support[c,]))
    return out


def basket_rows(seed, baskets, universal=False):
    rnd = random.Random(seed)
    rows = []
    for b in range(baskets):
        items = {rnd.randrange(1, 9) for _ in range(rnd.randrange(1, 5))}
        if rnd.random() < 0.4:
            items |= {20, 21, 22}  # always together
        if 3 in items:
            items.add(4)  # implied
        if rnd.random() < 0.06:
            items |= set(range(1, 13))  # large
        if universal:
            items.add(99)
        rows += [(b, i) for i in items] * rnd.choice([1, 1, 2])
    return rows + [(None, 1), (3, None), (None, None)]


@pytest.mark.parametrize(("seed", "baskets", "universal", "least"), [(1, 60, False, 5), (2, 60, True, 6), (3, 7, True, 7), (4, 150, False, 12), (5, 4, False, 1)])
def test_closed_itemsets(spark, seed, baskets, universal, least):
    rows = basket_rows(seed, baskets, universal)
    frame = spark.createDataFrame([(*r, 0) for r in rows], "b long, i long, support int")
    closed, support, total = brute_closed(rows, least)
    found, single, n = itemsets.closed_itemsets(frame, "b", "i", least_count=least)
    got = {tuple(r["items"]): r["support"] for r in found.collect()}
    assert n == total and got == closed and found.count() == len(closed)
    rules = brute_rules(closed, support, total, 30)
    assert {tuple(r["items"]): [tuple(x) for x in r["rules"]] for r in itemsets.with_rules(found, single, n).collect()} == rules


def test_itemsets_of_nothing(spark):
    frame = spark.createDataFrame([(None, 1), (1, None)], "b long, i long")
    found = itemsets.closed_itemsets(frame, "b", "i", least_count=1)
    assert itemsets.with_rules(*found).count() == 0


def test_a_share_of_baskets_is_asked_for(spark):
    frame = spark.range(100).select(F.col("id").alias("b"), F.expr("if(id < 30, 1, if(id < 50, 2, 3))").cast("long").alias("i"))
    found, _, _ = itemsets.closed_itemsets(frame, "b", "i", least_count=2, least_share=(1, 4))
    assert sorted((tuple(r["items"]), r["support"]) for r in found.collect()) == [((1,), 30), ((3,), 50)]


def brute_trie(seqs):
    """{sequence: (conv, depth, parent conv, n, children, leaves, saved, ends)} of {conv: [(role, text)]}."""
    members = defaultdict(list)
    for c, turns in seqs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for s in members:
        if s:
            children[s[:-1]].append(s)

    def below(s):
        yield s
        for k in children[s]:
            yield from below(k)

    out = []
    for s, m in members.items():
        ends = sorted(c for c in m if len(seqs[c]) == len(s))
        out.append(
            (min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(children[s]), sum(not children[x] for x in below(s)),
             sum((len(members[x]) - 1) * len(x[-1][1]) for x in below(s) if x), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest())
        )
    return sorted(out, key=str)


def ordered(df):
    return sorted(map(tuple, df.collect()), key=str)


def in_many_parts(spark, n=7):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", n)


@pytest.fixture
def parts(spark):
    yield lambda n: in_many_parts(spark, n)
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("n", [1, 3, 13])
def test_prefix_trie(spark, parts, monkeypatch, n):
    parts(n)
    monkeypatch.setattr(prefix_trie, "ROWS", 5)
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    rnd = random.Random(n)
    seqs = {}
    for c in range(120):
        seqs[c * 7 % 1000 - 50] = [("user", rnd.choice(["a", "bb", ""])) for _ in range(rnd.choice([0, 1, 2, 3, 6]))]
    for c in range(2000, 2060):
        seqs[c] = [("user", "hot"), ("bot", "ccc"), ("user", "d"), ("bot", "long tail")]
    for c in range(3000, 3010):
        seqs[c] = [("user", "hot"), ("bot", "ccc"), ("user", f"{c}")]
    seqs[4000] = [("x", "y")] * 300
    rows = [(c, t, *x) for c, turns in seqs.items() for t, x in enumerate(turns)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    empty = spark.createDataFrame([(c,) for c, turns in seqs.items() if not turns], "conv long")
    found = prefix_trie.sequences(frame)
    found = found.unionByName(empty.select("conv", F.array().cast(found.schema["turns"].dataType).alias("turns")))
    assert ordered(prefix_trie.prefix_trie(found)) == brute_trie(seqs)


def test_trie_of_odd_rows(spark):
    rows = [(1, None, None, "a"), (1, 2, "u", None), (1, 2, "u", None), (1, 1, "z", "é\U00010000"), (2, 1, None, "a"), (None, 1, "u", "lost"), (3, 5, "", "a"), (3, 5, "", "")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, conv int")
    seqs = {1: [("", "a"), ("z", "é\U00010000"), ("u", ""), ("u", "")], 2: [("", "a")], 3: sorted([("", "a"), ("", "")], key=lambda t: hashlib.sha256(f"0:{t[1]}".encode()).digest())}
    assert ordered(prefix_trie.prefix_trie(prefix_trie.sequences(frame))) == brute_trie(seqs)
    assert prefix_trie.prefix_trie(prefix_trie.sequences(frame.limit(0))).count() == 0
    only = prefix_trie.sequences(frame.filter("conv_id = 2")).withColumn("turns", F.slice("turns", 1, 0))
    assert ordered(prefix_trie.prefix_trie(only)) == brute_trie({2: []})


def test_rebuilt_conversations(spark, tmp_path):
    rnd = random.Random(5)
    turns = {c: [("ua"[k % 2], rnd.choice("abc")) for k in range(rnd.randrange(1, 7))] for c in [*range(100, 125), 205, 207, 300, 301, 399]}
    spark.createDataFrame([(c, k, *t) for c, x in turns.items() for k, t in enumerate(x)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    seqs = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        seqs[c] = turns.get(c - c % 100, [])[:h] + own[h:]
    assert ordered(queries.op13_patricia_trie(spark, str(tmp_path))) == brute_trie(seqs)


def transducer():
    rnd = random.Random(3)
    words = sorted({bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(1, 9))) for _ in range(800)} | {b"walking", b"talking", b"a" * 99})
    built = lexicon.Builder()
    ids = {w: tuple(rnd.randrange(5) for _ in range(rnd.randrange(0, 4))) for w in words}
    for w in words:
        built.add(w, ids[w])
    return built, words, ids


def test_lexicon_file(tmp_path):
    built, words, ids = transducer()
    (tmp_path / "x").write_bytes(built.pack())
    found = lexicon.Lexicon(str(tmp_path / "x"))
    assert found.get(words) == [list(ids[w]) for w in words]
    known = set(words)
    every = {bytes(w) for n in range(7) for w in itertools.product(b"abc", repeat=n)}
    assert found.get([b"", *(every - known), b"zz", words[0]]) == [None] * (len(every - known) + 2) + [list(ids[words[0]])]
    plain = {w: (1,) for w in [b"walking", b"talking", b"talks", b"walks"]}
    small = lexicon.Builder()
    for w in sorted(plain):
        small.add(w, plain[w])
    small.pack()
    assert len(small.frozen) == 7  # alk, then ing or s, are shared
    (tmp_path / "e").write_bytes(lexicon.Builder().pack())
    assert lexicon.Lexicon(str(tmp_path / "e")).get([b"a", b""]) == [None, None]


def expected(texts):
    plain = Tokenizer.from_file(WORD_BPE)
    plain.no_truncation()
    plain.no_padding()
    out = []
    for t in texts:
        ids = plain.encode(t or "", add_special_tokens=False).ids
        out.append((ids, plain.decode(ids, skip_special_tokens=False)))
    return out


ODD = [
    None, "", " ", "Hello, World's  they'LL 12 x3<|endoftext|>y <|startoftext|>", "ΟΔΟΣ ΑΣ İstanbul ǅ ﬁ", "é ́x á̀", "\x1c\x1d a\x85b\xa0c　d", "日本語's 한국어 한",
    "‍﻿ \x00\x7f", "👩‍👩‍👧 naïve", "a<|endoftext|>́b", "'S 's's", "<|", "a" * 5000, "z<|endoftext|" * 3, "x\r\n\t\x0b\x0cy", "١٢٣ ⅷ ²",
]


@pytest.fixture(scope="module")
def lexicons(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    return [lexicon.compile_lexicon(docs, WORD_BPE, most=n) for n in (30_000, 0)]


def test_word_bpe(spark, data, lexicons):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("text").collect()
    texts = ODD + [r.text for r in docs][:120] + [" ".join(r.text or "" for r in docs)]
    frame = spark.createDataFrame([(i, t, "mine", t) for i, t in enumerate(texts)], "k int, text string, ids string, n_tokens string")
    want = expected(texts)
    for lex in lexicons:
        coded = lexicon.encode(frame, WORD_BPE, lex)
        assert coded.columns == ["k", "text", "ids", "n_tokens", "_ids"]
        got = {r.k: r._ids for r in coded.collect()}
        assert [got[i] for i in range(len(texts))] == [ids for ids, _ in want]
        back = {r.k: r.decoded for r in lexicon.decode(coded, WORD_BPE, lex, ids="_ids").collect()}
        assert [back[i] for i in range(len(texts))] == [t for _, t in want]
        trip = {r.k: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in lexicon.round_trip(frame, WORD_BPE, lex).collect()}
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert [trip[i] for i in range(len(texts))] == [(len(ids), digest(" ".join(map(str, ids))), digest(t)) for ids, t in want]
    assert lexicon.round_trip(frame.limit(0), WORD_BPE, lexicons[0]).count() == 0
    odd = spark.createDataFrame([([320, None, -1, 10**6, 49407],), (None,), ([],)], "ids array<int>")
    plain = Tokenizer.from_file(WORD_BPE)
    assert [r.decoded for r in lexicon.decode(odd, WORD_BPE, lexicons[0]).collect()] == [plain.decode([320, 49407], skip_special_tokens=False), "", ""]


def test_word_bpe_of_all_letters(tmp_path):
    """All code points alone, and within words, as the library takes them."""
    with open(WORD_BPE, "rb") as f:
        words = lexicon.Words(f.read())
    (tmp_path / "e").write_bytes(lexicon.Builder().pack())
    codec = lexicon.Codec(words, lexicon.Lexicon(str(tmp_path / "e")))
    points = [chr(c) for c in range(0, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = []
    for a in range(0, len(points), 257):
        part = points[a : a + 257]
        texts.append(" ".join(f"{c} a{c}B {c}́ 1{c}'S" for c in part))
    plain = Tokenizer.from_file(WORD_BPE)
    for t, e in zip(texts[::3], plain.encode_batch(texts[::3], add_special_tokens=False), strict=True):
        assert [int(i) for i in next(codec.encode([t.encode()]))[0].split()] == e.ids


def test_words_merged_together_and_alone():
    with open(WORD_BPE, "rb") as f:
        words = lexicon.Words(f.read())
    rnd = random.Random(8)
    some = ["".join(rnd.choice("abcdeiounrst'.") for _ in range(rnd.randrange(1, 40))) for _ in range(3000)] + ["aaaaaaa", "a" * 150, "Ã©tÃ©", "日", "a日b", "x"]
    assert words.merge_all(some) == [words.merge(w) for w in some]
    assert words.merge_all([]) == []


def test_lexicon_counts_all_words(spark):
    frame = spark.createDataFrame([("b a A",), ("a b's",), (None,), ("x" * 200,)], "text string")
    assert {r.word: r.n for r in lexicon.word_counts(frame, WORD_BPE).collect()} == {"a": 3, "b": 2, "'s": 1}




def test_bpe_of_all_letters():
    """Every third code point in eight positions, as the library encodes it; among them all on which editions differ."""
    import regex
    import tiktoken

    from quirefold.llm import bpe

    with open(V.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = bpe.parse_ranks(f.read())
    codec = bpe.Codec(ranks, V.PATTERN)
    plain = tiktoken.Encoding("own", pat_str=V.PATTERN, mergeable_ranks=ranks, special_tokens={})
    differ = [chr(c) for c in set(map(ord, regex.findall(r"[\p{L}\p{N}]", "".join(bpe._points(0, 0x110000))))) - bpe.library_members(r"\p{L}") - bpe.library_members(r"\p{N}")]
    points = differ[::5] + bpe._points(0, 0x110000)[::12] + ["\U00018da7", "\U00016ea7", "\U00010ee7"]
    texts = [f"{c} a{c} {c}a {c}{c} 1{c}2 .{c} {c}. \n{c}'s" for c in points]
    for a in range(0, len(texts), 500):
        part = texts[a : a + 500]
        got = [memoryview(ids).cast("I").tolist() for ids in codec.encode(part)]
        assert got == plain.encode_ordinary_batch(part, num_threads=2)
