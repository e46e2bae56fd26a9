"""Operators that compare rows: exact, near and substring duplicates, components, and the pipeline."""

import random
import zlib

import helpers
import numpy as np
import public_tokenizers as V
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quirefold.llm import exact_dedup, graph, minhash_dedup, queries, quality, substring_dedup
from quirefold.llm.store import materialize, read_table

DOCS = [(1, "a b"), (2, "ab"), (3, "a  b"), (3, "a  b"), (4, None), (5, ""), (6, " \n"), (7, "x" * 300 + "y"), (8, "x" * 300 + "z"), (9, "ü"), (10, "u"), (None, "lone"), (11, "q"), (11, "ab")]


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "z", "z") for d, t in docs], "doc_id long, text string, _sha string, keep_id string")


def test_exact_duplicates(spark):
    expected = helpers.exact(DOCS)
    groups = {r.text_sha256: (r.keep_id, r.group_size) for r in exact_dedup.duplicate_groups(frame(spark, DOCS)).collect()}
    assert groups == {v[3]: v[:2] for v in expected.values() if v[1] > 1}
    left = exact_dedup.drop_duplicates(frame(spark, DOCS))
    assert left.columns == ["doc_id", "text", "_sha", "keep_id"]
    got = sorted((str(r.doc_id), str(r.text)) for r in left.collect())
    once = sorted({(str(DOCS[i][0]), str(DOCS[i][1])) for i, v in expected.items() if v[2]})
    assert got == once
    assert exact_dedup.drop_duplicates(frame(spark, DOCS).limit(0)).count() == 0


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(1000, i) for i in range(1001, 1200)] + [(i, i + 1) for i in range(2000, 2040)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def near_copies(seed, groups, copies, words):
    """Texts with edits on both sides of the threshold, equal ones, and unrelated ones."""
    rnd, docs = random.Random(seed), {}
    for _ in range(groups):
        base = [f"w{rnd.randrange(5000)}" for _ in range(words)]
        for _ in range(copies):
            text = list(base)
            for _ in range(rnd.choice([0, 1, 2, 3, 4, 6, 9])):
                text[rnd.randrange(len(text))] = f"e{rnd.randrange(10**6)}"
            docs[len(docs)] = " ".join(text) if rnd.random() < 0.8 else "  ".join(text).upper()
    docs |= {len(docs) + i: t for i, t in enumerate([None, "", "a", "A", "a b c", "A b  C", "x y z w v", "\n"])}
    return docs


def test_near_duplicates(spark):
    docs = near_copies(1, 12, 12, 150)
    expected = helpers.near(docs, 4)
    rows = minhash_dedup.near_duplicates(spark.createDataFrame([(k, t, "z") for k, t in docs.items()], "doc_id long, text string, component_id string"), k=4)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows.collect()}
    assert got == {k: (len(helpers.shingles(t, 4)), expected[k], expected[k] == k) for k, t in docs.items()}
    assert len(set(expected.values())) < len(docs)


def test_exact_step_resolves_what_stars_miss(spark, monkeypatch):
    """Texts around the threshold, over many small blocks: links between members of which neither is a centre."""
    for name, value in (("BLOCK_SHINGLES", 2000), ("BLOCK_ROWS", 8), ("BLOCK_TEXTS", 4), ("SMALL_TABLE", 2)):
        monkeypatch.setattr(minhash_dedup, name, value)
    planned = []
    monkeypatch.setattr(minhash_dedup, "_exact_block", lambda *a, own=minhash_dedup._exact_block: planned.append(1) or own(*a))
    rnd = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    docs = {}
    for i in range(150):
        text = list(base)
        for _ in range(rnd.choice([0, 1, 2, 3, 4, 5])):
            text[rnd.randrange(len(text))] = f"e{rnd.randrange(10**6)}"
        docs[i] = " ".join(text)
    expected = helpers.near(docs, 5)
    assert 1 < len(set(expected.values())) < 120
    rows = minhash_dedup.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), k=5)
    assert {r.doc_id: r.component_id for r in rows.collect()} == expected
    assert planned


BASE = " ".join(f"b{i}" for i in range(60))
#: (id, text): repeated ids with the same and with other texts, and rows without id.
ODD = [(1, BASE), (1, BASE + " x"), (1, "other words"), (None, BASE + " y"), (None, "lone"), (2, BASE), (2, BASE), (3, None), (3, ""), (None, None), (4, "other  words")]


def test_null_and_repeated_ids_are_documents_of_their_own(spark):
    rows = spark.createDataFrame([(d, t, "z") for d, t in ODD], "doc_id long, text string, _ROW string")
    numbered = dict(enumerate(t for _, t in ODD))
    near = minhash_dedup.near_duplicates(rows, 5)
    least = {c: min((ODD[i][0] for i, x in helpers.near(numbered, 5).items() if x == c and ODD[i][0] is not None), default=None) for c in range(len(ODD))}
    expected = sorted(str((ODD[i][0], len(helpers.shingles(t, 5)), least[helpers.near(numbered, 5)[i]])) for i, t in numbered.items())
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in near.collect()) == expected
    left = minhash_dedup.drop_near_duplicates(rows, 5)
    assert left.columns == rows.columns
    assert sorted(str((r.doc_id, r.text)) for r in left.collect()) == sorted(map(str, [(1, BASE), (1, "other words"), (None, "lone"), (3, None), (3, ""), (None, None)]))
    wanted = helpers.repeats(numbered, 20)
    got = sorted(str((r.doc_id, r.n_words, r.n_removed, r.kept_sha256)) for r in substring_dedup.repeated_passages(rows, 20).collect())
    assert got == sorted(str((ODD[i][0], *v[:3])) for i, v in wanted.items())
    cleaned = substring_dedup.remove_repeats(rows, 20)
    assert cleaned.columns == rows.columns and cleaned.count() == len(ODD)
    assert sorted(str(helpers.WORD.findall(r.text or "")) for r in cleaned.collect()) == sorted(str(v[3]) for v in wanted.values())


def test_exact_duplicates_keep_the_most_code_points(spark):
    rows = spark.createDataFrame([(1, "a b c"), (1, "a  b  c"), (1, "abc"), (2, "x" * 200_000), (3, "x" * 200_000 + "\n"), (None, "q"), (None, "q ")], "doc_id long, text string")
    left = sorted((str(r.doc_id), len(r.text), r.text[:7]) for r in exact_dedup.drop_duplicates(rows).collect())
    assert left == [("1", 7, "a  b  c"), ("3", 200_001, "xxxxxxx"), ("None", 2, "q ")]


def test_very_long_texts_and_frames_without_rows(spark):
    rnd = random.Random(8)
    long = " ".join(f"v{rnd.randrange(10**6)}" for _ in range(60_000))
    rows = spark.createDataFrame([(1, long), (2, long + " end"), (3, long.replace("v1", "u1")), (4, "v")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(rows).collect()}
    assert got == helpers.near({r.doc_id: r.text for r in rows.collect()}, 5)
    assert minhash_dedup.near_duplicates(rows.limit(0)).count() == 0 and minhash_dedup.drop_near_duplicates(rows.limit(0)).count() == 0
    assert {r.doc_id: r.n_removed for r in substring_dedup.repeated_passages(rows.filter("doc_id <> 3")).collect()} == {1: 60_000, 2: 60_000, 4: 0}


def test_pipeline_runs_on_odd_tables(spark, tmp_path):
    prose = [" ".join(f"word{(i * j) % 97}" for j in range(60 + i)) for i in range(1, 8)]
    odd = [(i, t, "en", "z", "z") for i, t in enumerate(prose)] + [(0, prose[0], None, "z", "z"), (0, prose[1] + "\n", "en", "z", "z"), (None, prose[2], "en", "z", None), (8, None, None, None, None), (9, "", "en", "z", "z")]
    schema = "doc_id long, text string, lang string, _sha string, spans string"
    for name, rows in (("odd", odd), ("empty", [])):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        if name == "empty":
            assert out.count() == 0
        docs, kept = read_table(spark, f"{tmp_path}/{name}", "documents"), None
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, docs if kept is None else kept, "")
            assert kept.columns == docs.columns


def test_tensored_bands_find_pairs_at_the_threshold():
    rnd = np.random.default_rng(0)
    missed = 0
    for _ in range(2000):
        shared, a, b = (rnd.integers(0, 1 << 63, n, dtype=np.uint64) for n in (160, 20, 20))
        g = np.concatenate([np.sort(np.concatenate([shared, x])) for x in (a, b)])
        hashes = minhash_dedup.min_hashes(g, np.array([0, 180, 360]), 2 * minhash_dedup.SIDE * minhash_dedup.ROWS_PER_BAND)
        same = np.equal(*minhash_dedup.band_keys(hashes, minhash_dedup.SIDE, minhash_dedup.ROWS_PER_BAND))
        matches = ((hashes[: minhash_dedup.SKETCH, 0] & 255) == (hashes[: minhash_dedup.SKETCH, 1] & 255)).sum()
        missed += not (same[: minhash_dedup.SIDE].any() and same[minhash_dedup.SIDE :].any() and matches >= minhash_dedup.least_matches(80))
    assert missed <= 8


def test_repeated_passages(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 150)
    monkeypatch.setattr(substring_dedup, "TASK_WORDS", 400)
    rnd = random.Random(9)
    docs = {i: " ".join(rnd.choice("abcd") for _ in range(rnd.choice([0, 1, 3, 4, 5, 9, 40, 200]))) for i in range(50)}
    passage = " ".join(f"p{i}" for i in range(20))
    docs |= {100 + i: f"u{i} v{i} {passage}\nx{i} y{i}" for i in range(40)} | {200: None, 201: docs[3], 202: " ".join("ab" for _ in range(60))}
    expected = helpers.repeats(docs, 6)
    rows = spark.createDataFrame([(k, t, "z") for k, t in docs.items()], "doc_id long, text string, spans string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.repeated_passages(rows, 6).collect()}
    assert got == {k: v[:3] for k, v in expected.items()}
    cleaned = substring_dedup.remove_repeats(rows, 6)
    assert cleaned.columns == ["doc_id", "text", "spans"]
    assert {r.doc_id: helpers.WORD.findall(r.text or "") for r in cleaned.collect()} == {k: v[3] for k, v in expected.items()}
    assert substring_dedup.repeated_passages(rows.limit(0), 6).count() == 0


def test_suffix_automaton_matching_statistics():
    rnd = random.Random(4)
    for _ in range(60):
        texts = [[rnd.randrange(3) for _ in range(rnd.randrange(1, 25))] for _ in range(4)]
        automaton, known = substring_dedup.SuffixAutomaton(), set()
        for t in texts:
            automaton.add(t)
            known |= {tuple(t[i:j]) for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        probe = [rnd.randrange(3) for _ in range(30)]
        for length in (1, 3, 5):
            assert automaton.matches(probe, length) == [e for e in range(length, 31) if tuple(probe[e - length : e]) in known]


@pytest.fixture(scope="module")
def stages(spark, data):
    """Input and output of each stage over a small corpus."""
    docs, out = read_table(spark, data, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        after = materialize(stage(spark, docs, data), "test")
        out.append((name, docs, after))
        docs = after
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_pipeline_stages_against_brute_force(stages):
    assert [name for name, _, _ in stages] == [n for n, _ in corpus_pipeline.STAGES]
    (_, raw, good), (_, _, once), (_, _, apart), (_, _, clean), (_, _, packed) = stages
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns
    rejected = set(texts(raw)) - set(texts(good))
    failed = {d for d, t in texts(raw).items() if (c := helpers.base_counts(t)) and (c[0] < 50 or 100 * c[4] > 50 * c[0])}
    assert failed <= rejected and len(rejected - failed) <= 0.05 * len(texts(raw))
    rows = list(texts(good).items())
    assert set(texts(once)) == {rows[i][0] for i, v in helpers.exact(rows).items() if v[2]}
    assert set(texts(apart)) == {d for d, c in helpers.near(texts(once), 5).items() if c == d}
    expected = helpers.repeats(texts(apart), 35)
    assert {d: helpers.WORD.findall(t or "") for d, t in texts(clean).items()} == {d: v[3] for d, v in expected.items()}
    assert clean.filter(F.col("n_chars") != F.length("text")).count() == 0
    lengths = packed.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id for r in lengths} == set(texts(clean))
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 1024


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_registered_queries_with_sql(spark, data):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "sale_lines", "conversations"):
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, data)
        cursor = con.execute(sql)
        names = [c[0] for c in cursor.description]
        assert sorted(names) == sorted(df.columns)
        got = sorted((tuple(str(r[n]) for n in names) for r in df.collect()))
        assert got == sorted(tuple(map(str, r)) for r in cursor.fetchall()), name


def test_quality_rules_keep_clean_documents(spark, data):
    judged = quality.judge(read_table(spark, data, "documents"), V.path("piece_bpe_32k.model"))
    labels = read_table(spark, data, "labels").filter("quality = 1 and toxic = 0")
    clean = judged.join(labels, "doc_id").filter(~F.col("measures")["base_failed"])
    assert clean.count() > 20 and clean.filter(~F.col("measures")["kept"]).count() == 0


def test_quality_rules_reject_junk_and_keep_clean_documents(spark, data):
    """Bands fitted on the table itself separate labelled junk from clean text, which fixed wide ones do not."""
    larger = data.replace("sf0.001", "sf0.01")
    judged = queries.op1_tokeniser_fertility(spark, larger).filter("not base_failed")
    r = judged.join(read_table(spark, larger, "labels"), "doc_id").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"), F.sum((~F.col("kept")).cast("int")).alias("gone")).collect()
    bad = [(x.n, x.gone) for x in r if x.quality == 0]
    clean = [(x.n, x.gone) for x in r if (x.quality, x.toxic) == (1, 0)]
    assert sum(n for n, _ in bad) > 20 and sum(g for _, g in bad) > 0.5 * sum(n for n, _ in bad)
    assert clean[0][0] > 200 and clean[0][1] < 0.03 * clean[0][0]


def test_bands_are_fitted_by_language_else_script(spark):
    fields = "n_words long, n_repeat_words long, chars_per_token double, byte_share double, entropy_share double, script string"
    good = [(90, 0, 2.0 + i % 9 / 100, 0.0, 0.7 + i % 7 / 100, "latin") for i in range(120)]
    rows = [("xx", m) for m in good] + [(None, m[:2] + (1.0 + m[2], 0.0, 0.7, "cjk")) for m in good] + [("en", good[0])] * 5
    fitted = quality.fit_bands(spark.createDataFrame(rows, f"lang string, m struct<{fields}>"), "m", "lang")
    assert 1.8 < fitted["languages"]["xx"].min_chars_per_token < 2.0 and 2.08 < fitted["languages"]["xx"].max_chars_per_token < 2.7
    assert 2.6 < fitted["scripts"]["cjk"].min_chars_per_token < 3.0 and fitted["scripts"]["latin"] == quality.SCRIPT_BANDS["latin"]
    few, fixed = fitted["languages"]["en"], quality.LANGUAGE_BANDS["en"]  # by its rows and by the fixed band
    assert few.max_chars_per_token == pytest.approx((5 * (2 + quality.FENCE * quality.MIN_SPREAD * 2) + quality.PRIOR_DOCUMENTS * fixed.max_chars_per_token) / (5 + quality.PRIOR_DOCUMENTS))
    assert fitted["languages"]["de"] == quality.LANGUAGE_BANDS["de"]  # no rows


def test_saved_bands_give_the_same_verdict_in_any_table(spark, data, tmp_path):
    docs, path = read_table(spark, data, "documents").select("doc_id", "lang", "text"), V.path("piece_bpe_32k.model")
    measured = quality.measure(docs, path)
    quality.save_bands(spark, quality.fit_bands(measured, "measures", "lang"), f"{tmp_path}/bands")
    bands = quality.load_bands(spark, f"{tmp_path}/bands")
    verdicts = lambda df: {r.doc_id: r.measures["kept"] for r in quality.judge(df, path, **bands).collect()}
    whole = verdicts(docs)
    assert whole == {r.doc_id: r.measures["kept"] for r in quality.judge(docs, path).collect()}
    part = verdicts(docs.filter("doc_id % 7 = 0"))
    assert part and part == {k: whole[k] for k in part}


def test_verdicts_against_brute_force(spark, data):
    """Bands by plain quartiles over the registered query's own measures decide as the query does."""
    larger = data.replace("sf0.001", "sf0.01")
    rows = [r.asDict(recursive=True) for r in quality.judge(read_table(spark, larger, "documents").select("doc_id", "lang", "text"), V.path("piece_bpe_32k.model"), ranks_path=V.path("byte_bpe_50k.tiktoken"), pattern=V.PATTERN).collect()]
    names = ("chars_per_token", "byte_share", "entropy_share", "bpe_chars_per_token", "bpe_entropy_share")
    limits = {}
    for lang in {r["lang"] for r in rows}:
        own = [r["measures"] for r in rows if r["lang"] == lang and not r["measures"]["base_failed"]]
        b = quality.LANGUAGE_BANDS[lang]
        given = {"chars_per_token": (b.min_chars_per_token, b.max_chars_per_token), "bpe_chars_per_token": (b.min_bpe_chars_per_token, b.max_bpe_chars_per_token)}
        given |= {"byte_share": (0, b.max_byte_share), "entropy_share": (b.min_entropy_share, 9), "bpe_entropy_share": (b.min_bpe_entropy_share, 9)}
        for n in names:
            low, mid, high = np.quantile([round(m[n], quality.FIT_DECIMALS) for m in own], [0.25, 0.5, 0.75])
            reach = quality.FENCE * max(high - low, quality.MIN_SPREAD * mid)
            own_limits = low - reach, max(high + reach, b.max_byte_share if n == "byte_share" else 0)
            limits[lang, n] = tuple((len(own) * x + quality.PRIOR_DOCUMENTS * y) / (len(own) + quality.PRIOR_DOCUMENTS) for x, y in zip(own_limits, given[n]))
    rejected = 0
    for r in rows:
        m, lang = r["measures"], r["lang"]
        inside = not m["base_failed"] and m["byte_share"] <= limits[lang, "byte_share"][1]
        inside = inside and any(limits[lang, n][0] <= m[n] <= limits[lang, n][1] for n in ("chars_per_token", "bpe_chars_per_token")) and any(limits[lang, n][0] <= m[n] for n in ("entropy_share", "bpe_entropy_share"))
        edge = not m["base_failed"] and any(abs(m[n] - x) < 1e-9 for n in names for x in limits[lang, n])
        assert edge or m["kept"] == inside
        rejected += not m["kept"] and not m["base_failed"]
    assert rejected > 20


def test_piece_checksums_of_registered_packing(spark, data):
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(V.path("byte_bpe_50k.json"))
    docs = texts(read_table(spark, data, "documents").limit(40))
    ids = {d: theirs.encode(t or "", add_special_tokens=False).ids + [2] for d, t in docs.items()}
    rows = [r for r in queries.op5_residual_packing(spark, data).collect() if r.doc_id in docs]
    for r in rows:
        assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
