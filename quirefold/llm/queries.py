"""The registered queries of this subpackage: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm import bpe, exact_dedup, hosts, html_extract, itemsets, lexicon, licenses, minhash_dedup, packing, prefix_trie, quality, substring_dedup, warc
from quirefold.llm.store import materialize, read_table
from quirefold.sources.shared import spread

#: op3's ordered policy.
URL_RULES = [
    hosts.Rule("block", "com", "/en/"),
    hosts.Rule("allow", "example.com", "/en/7"),
    hosts.Rule("allow", "net", "/de/"),
    hosts.Rule("block", "example.net", "/de/8"),
    hosts.Rule("block", "org", "/es/"),
]


def op1_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    path = public_tokenizers.path
    judged = quality.judge(docs, path("piece_bpe_32k.model"), carry=("doc_id", "lang"), ranks_path=path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN)
    return judged.select("doc_id", f"{judged.columns[-1]}.*").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_tokens", "chars_per_token", "byte_share", "entropy", "bpe_tokens", "bpe_chars_per_token", "bpe_entropy"
    )


def op2_chunked_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(spread(read_table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    found = warc.records(manifest)
    return found.select(F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op3_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    labels = read_table(spark, sf_dir, "labels")
    known = F.col("quality").isNotNull() & F.col("toxic").isNotNull()
    outcomes = labels.select(F.col("doc_id").alias("page_id"), F.when(known, (F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    return hosts.filter_urls(pages, outcomes, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op4_progressive_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    groups = exact_dedup.duplicate_groups(docs).withColumnRenamed("text_sha256", "_sha")
    rows = docs.select("doc_id", exact_dedup.content_sha(F.col("text")).alias("text_sha256"))
    keep = F.when(F.col("_sha").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    joined = rows.join(groups, F.col("text_sha256") == F.col("_sha"), "left")
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def op5_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    path = public_tokenizers.path
    packed = packing.pack_documents(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(spread(read_table(spark, sf_dir, "documents").select("doc_id", "text")), length=35)


def op7_two_tier_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_licence_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(spread(read_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op9_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return minhash_dedup.near_duplicates(docs, k=4, percent=80)


def op10_boosted_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(spread(read_table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_key_itemsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "sale_lines").filter(~F.col("flag").eqNullSafe("returned")).select("sale_id", "item_id")
    found = itemsets.with_rules(*itemsets.closed_itemsets(lines, "sale_id", "item_id"))
    text = F.array_join(F.transform("rules", lambda r: F.concat_ws(":", r["c"], r["a"], r["s"])), ";")
    best = F.array_min(F.transform("rules", lambda r: F.struct(r["a"], r["c"])))["c"]
    return found.select(
        F.array_join("items", ",").alias("items"), F.size("items").cast("long").alias("n_items"), "support", F.size("rules").cast("long").alias("n_rules"), best.alias("best_item"), F.sha2(text, 256).alias("rules_sha256")
    )


def op12_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    path = public_tokenizers.path("word_bpe_49k.json")
    return lexicon.round_trip(docs, path, lexicon.compile_lexicon(docs, path))


def op13_patricia_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = materialize(prefix_trie.sequences(read_table(spark, sf_dir, "conversations")), "conversations")
    first = own.select(F.col("conv").alias("_base"), F.slice("turns", 1, 5).alias("_first"))
    rows = own.withColumn("_base", F.col("conv") - F.col("conv") % 100).withColumn("_h", (F.crc32(F.col("conv").cast("string").cast("binary")) % 6).cast("int"))
    borrowed = F.coalesce(F.slice("_first", F.lit(1), F.col("_h")), F.slice("turns", 1, 0))
    rest = F.slice("turns", F.col("_h") + 1, F.size("turns"))
    return prefix_trie.prefix_trie(rows.join(first, "_base", "left").select("conv", F.concat(borrowed, rest).alias("turns")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    all_of_them = (
        op1_tokeniser_fertility,
        op2_chunked_warc,
        op3_host_reputation,
        op4_progressive_dedup,
        op5_residual_packing,
        op6_suffix_automata,
        op7_two_tier_bpe,
        op8_licence_sentences,
        op9_tensored_minhash,
        op10_boosted_html,
        op11_key_itemsets,
        op12_transducer_bpe,
        op13_patricia_trie,
    )
    return {f.__name__: f for f in all_of_them}


def _op3_sql() -> str:
    rules = sorted(URL_RULES, key=lambda r: -len(r.name))
    fits = [(f"(host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}')", r) for r in rules]
    case = lambda what: "case " + " ".join(f"when {cond} then '{what(r)}'" for cond, r in fits) + " end"
    low, high = hosts.STRENGTH_BOUNDS
    two = ", ".join(f"'{s}'" for s in sorted(hosts.SUFFIXES))
    address = "regexp_matches(name, '^[0-9]+([.][0-9]+)*$') or starts_with(name, '[')"

    def level(k: int, keys: str, parent: str, on: str) -> str:
        return f"""
        c{k} as (select {keys}, sum(n) n, sum(good) good from hosts group by all),
        p{k} as (select c{k}.*, {parent}.post prior from c{k} {on}),
        m{k} as (select sum(n * pow(good / n - prior, 2)) s, sum(prior * (1 - prior)) q, sum(prior * (1 - prior) * (n - 1)) e from p{k} where n > 0),
        r{k} as (select coalesce(case when e > 0 then (s - q) / e end, 0) rho from m{k}),
        k{k} as (select case when rho <= 1 / ({high} + 1) then {high} when rho >= 1 / ({low} + 1) then {low} else 1 / rho - 1 end s from r{k}),
        l{k} as (select p{k}.*, s * prior + good a, s * (1 - prior) + n - good b, (s * prior + good) / (s + n) post from p{k}, k{k})"""

    return f"""
    with rows0 as (
        select page_id, translate(coalesce(regexp_extract(url, '{hosts.URL_PATTERN}', 1), ''), '{hosts.UPPER}', '{hosts.LOWER}') host,
            coalesce(regexp_extract(url, '{hosts.URL_PATTERN}', 2), '') path from pages),
    good as (select doc_id, count(*) n, sum(case when quality = 1 and toxic = 0 then 1 else 0 end) good from labels
        where quality is not null and toxic is not null group by doc_id),
    hosts0 as (select host, coalesce(sum(n), 0)::double n, coalesce(sum(good), 0)::double good from rows0 left join good on page_id = doc_id group by host),
    named as (select *, regexp_replace(regexp_replace(host, '^.*@', ''), '(:[0-9]*|[.])$', '') as name from hosts0),
    hosts1 as (select *, string_split(name, '.') parts, array_to_string(array_slice(string_split(name, '.'), -2, -1), '.') two from named),
    hosts as (select host, n, good, case when {address} then name when two in ({two}) then two else parts[-1] end suffix,
        case when {address} then name when two in ({two}) then array_to_string(array_slice(parts, -3, -1), '.') else two end as domain from hosts1),
    g as (select (sum(good) + 1) / (sum(n) + 2) post from hosts),
    {level(0, "suffix", "g", ", g")},
    {level(1, "suffix, domain", "l0", "join l0 using (suffix)")},
    {level(2, "suffix, domain, host", "l1", "join l1 using (suffix, domain)")},
    bound as (select host, 1 / (1 + exp(-(ln(a / b) + 1.96 * sqrt(1 / a + 1 / b)))) good_upper from l2)
    select page_id, host, path, {case(lambda r: r.name)} as rule,
        coalesce({case(lambda r: r.verdict)}, case when good_upper < 0.5 then 'block' else 'allow' end) as verdict
    from rows0 left join bound using (host)"""


def _op8_sql() -> str:
    every = {sentence: name for name, sentence in licenses.SENTENCES.items()} | {sentence: names[0] for names, sentence in licenses.WORDINGS if len(names) == 1 and licenses.STOP not in sentence}
    known = "[" + ", ".join(f"'{s}'" for s in every) + "]"
    of = "map([" + ", ".join(f"'{s}'" for s in every) + "], [" + ", ".join(f"'{n}'" for n in every.values()) + "])"
    rules = [r for r in licenses.RULES if set(r.sequence) <= set(every.values())]
    raw = [f"regexp_matches(spaced, '{licenses.rule_pattern(r)}')" for r in rules]
    hit = [h + "".join(f" and not {o}" for o, other in zip(raw, rules, strict=True) if other.licence in r.unless) for h, r in zip(raw, rules, strict=True)]
    names = list(dict.fromkeys(r.licence for r in rules))
    found = ", ".join("case when " + " or ".join(f"({h})" for h, r in zip(hit, rules, strict=True) if r.licence == n) + f" then '{n}' end" for n in names)
    used = " || ".join(f"case when {h} then [" + ", ".join(f"'{s}'" for s in r.sequence) + "] else [] end" for h, r in zip(hit, rules, strict=True))
    return f"""
    with cut as (select doc_id, text, string_split(regexp_replace(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '{licenses.SENTENCE_END}', '\\1' || chr(10), 'g'), chr(10)) parts from documents),
    norm as (select doc_id, text, list_transform(parts, lambda s: trim(regexp_replace(s, '{licenses.NOT_NORMAL}', ' ', 'g'))) parts from cut),
    ids as (select doc_id, text, list_transform(list_filter(parts, lambda s: list_contains({known}, s)), lambda s: {of}[s]) ids from norm),
    spaced as (select doc_id, text, ids, ' ' || array_to_string(ids, '  ') || ' ' spaced from ids)
    select doc_id, len(ids)::bigint n_known, case when len(ids) > 0 then array_to_string(ids, ' ') end sentence_ids,
        nullif(array_to_string(list_filter([{found}], lambda x: x is not null), ' '), '') licences,
        nullif(array_to_string(list_filter(list_transform(regexp_extract_all(text, '{licenses.SPDX_EXPRESSION}', 1), lambda x: trim(regexp_replace(regexp_replace(x, '[ \\t]+', ' ', 'g'), '[ -]+$', ''))), lambda x: x <> ''), '; '), '') expressions,
        len(list_filter(ids, lambda x: not list_contains({used}, x))) > 0 as unresolved
    from spaced"""


OP11_SQL = """
    with recursive lines as materialized (select distinct sale_id b, item_id i from sale_lines where flag is distinct from 'returned' and sale_id is not null and item_id is not null),
    total as (select count(distinct b) n from lines),
    single as materialized (select i, count(*) s, list(b) own from lines group by i having count(*) >= 12 and count(*) * 10000 >= (select n from total)),
    kept as (select b, i from lines semi join single using (i)),
    pair as materialized (select x.i a, y.i c from kept x join kept y on x.b = y.b and x.i < y.i group by all having count(*) >= 12 and count(*) * 10000 >= (select n from total)),
    sets as (
        select [i] items, i last, own, s from single
        union all
        select * from (select list_append(sets.items, c) items, c as last, list_intersect(sets.own, single.own) own, len(list_intersect(sets.own, single.own))::bigint s
            from sets join pair on a = last join single on single.i = c) where s >= 12 and s * 10000 >= (select n from total)),
    every as materialized (select items, s from sets),
    parts as materialized (select items, s, c, list_filter(items, lambda x: x <> c) rest from (select items, s, unnest(items) c from every where len(items) > 1)),
    closed as (select items, s from every anti join (select distinct rest, s from parts) p on every.items = p.rest and every.s = p.s),
    rules as (select parts.items, c, r.s a, single.s from parts semi join closed using (items) join every r on r.items = rest join single on single.i = c
        where 100 * parts.s >= 30 * r.s and parts.s * (select n from total) > r.s * single.s),
    by_set as (select items, count(*) n_rules, first(c order by a, c) best_item, string_agg(c || ':' || a || ':' || s, ';' order by c) t from rules group by items)
    select array_to_string(closed.items, ',') items, len(closed.items)::bigint n_items, closed.s support, coalesce(n_rules, 0) n_rules, best_item, sha256(coalesce(t, '')) rules_sha256
    from closed left join by_set using (items)"""


OP13_SQL = """
    with said as (select conv_id c, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) rn,
        md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) t, length(coalesce(text, '')) chars from conversations where conv_id is not null),
    convs as (select c, c - c % 100 base, count(*) n, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(c::varchar, ''), lambda x: ascii(x)::bigint)),
        lambda r, b: list_reduce(list_prepend(xor(r, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: case when x % 2 = 1 then xor(x >> 1, 3988292384) else x >> 1 end))) % 6 h from said group by c),
    given as (select convs.c, h, convs.n, least(h, coalesce(b.n, 0)) taken from convs left join (select c as bc, n from convs) b on b.bc = base),
    rebuilt as (
        select g.c, rn d, t, chars from given g join convs using (c) join said s on s.c = base and rn <= g.h
        union all select g.c, rn - g.h + taken, t, chars from given g join said s on s.c = g.c and rn > g.h),
    ways as (select c, d, chars, array_to_string(list(t) over (partition by c order by d), '') k from rebuilt),
    path as materialized (select c, d, chars, k, left(k, 32 * (d - 1)::int) up from ways union all select c, 0, 0, '', null from convs),
    nodes as materialized (select k, d, any_value(up) up, any_value(chars) chars, min(c) c, count(*) n from path group by k, d),
    kids as (select up k, count(*) n_children from nodes where up is not null group by 1),
    below as (select p.k, sum((n.n - 1) * n.chars)::bigint saved_tokens, count(*) filter (where n.k not in (select k from kids)) n_leaves
        from nodes n join path p on p.c = n.c and p.d <= n.d group by 1),
    ends as (select k, sha256(string_agg(c::varchar, ',' order by c)) ends_sha256 from (select c, arg_max(k, d) k from path group by c) group by 1)
    select nodes.c conv_id, nodes.d::bigint depth, a.c parent_conv_id, nodes.n n_convs, coalesce(n_children, 0) n_children, n_leaves, saved_tokens, coalesce(ends_sha256, sha256('')) ends_sha256
    from nodes left join (select k up, c from nodes) a using (up) left join kids using (k) join below using (k) left join ends using (k)"""


def oracle_sql() -> dict[str, str]:
    white = r"[\x20\x09-\x0D]"
    return {
        "op2_chunked_warc": """
            with d as (select page_id, strlen(coalesce(html, '')) payload_bytes, sha256(coalesce(html, '')) payload_digest from pages),
            f as (select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) else page_id end first_id from d)
            select page_id, payload_bytes, payload_digest, case when page_id = first_id then 'response' else 'revisit' end record_type,
                case when page_id <> first_id then first_id end refers_to from f""",
        "op3_host_reputation": _op3_sql(),
        "op4_progressive_dedup": f"""
            with d as (select doc_id, length(coalesce(text, '')) points, sha256(regexp_replace(coalesce(text, ''), '{white}', '', 'g')) text_sha256 from documents)
            select doc_id, first_value(doc_id) over w keep_id, count(*) over (partition by text_sha256) group_size,
                doc_id = first_value(doc_id) over w as kept, text_sha256
            from d window w as (partition by text_sha256 order by points desc, doc_id)""",
        "op8_licence_sentences": _op8_sql(),
        "op11_key_itemsets": OP11_SQL,
        "op13_patricia_trie": OP13_SQL,
    }
