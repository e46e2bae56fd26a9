"""The catalogue of registered queries over the driver's tables, with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirefold.functions import text as X
from quirefold.operators import blocks as B
from quirefold.operators import headings as H
from quirefold.operators import learning as N
from quirefold.operators import lines as L
from quirefold.operators import metadata as M
from quirefold.operators import pages as P
from quirefold.operators import report as RP
from quirefold.operators import sites as S
from quirefold.operators import tables as T
from quirefold.plans import adapters as A
from quirefold.sources import appended as AP
from quirefold.sources import office as OF
from quirefold.sources import pdf_marks as PM
from quirefold.sources import readers as R
from quirefold.sources import word as WD
from quirefold.sources.shared import fresh_path, materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Least similarity of a heading and its line in the catalogue's section queries.
LEAST = 0.1

#: Folders that the Word files of documents are dealt to.
WORD_FOLDERS = 1000


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def r6(c) -> F.Column:
    return F.round(c, 6)


# ---- lines -------------------------------------------------------------------------------------------------------


@query(f"with {A.LINES} select * from lines")
def doc_lines(spark, d):
    return A.lines(spark, d)


WORDS = "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))::bigint"


@query(
    f"""with {A.LINES}, n as (select *, min(line_on_page) over p lo, max(line_on_page) over p hi from lines window p as (partition by doc_id, page_num))
    select doc_id, page_num, line_on_page, {WORDS} word_count, case when regexp_matches(text, '(\\s|^)[0-9]+(\\s|$)') then 1 else 0 end contains_num,
        case when regexp_matches(text, '^[0-9]+.*?\\s[\\p{{L}}\\p{{N}}_]') then 1 else 0 end starts_num, case when contains(text, chr(9)) then 1 else 0 end contains_tab,
        case when contains(lower(text), 'page') then 1 else 0 end contains_page,
        round(case when hi = lo then 0.0 else (line_on_page - lo) / (hi - lo)::double end, 6) normed_line_num from n"""
)
def line_features(spark, d):
    rows = A.lines(spark, d)
    place = L.min_max(F.col("line_on_page"), "doc_id", "page_num")
    return rows.select("doc_id", "page_num", "line_on_page", *L.text_flags(F.col("text")), r6(place).alias("normed_line_num"))


@query(f"with {A.BOXES} select doc_id, page_num, ord, text from boxes where not (\"left\" < 0.04 and width < 0.02)")
def margin_noise_filter(spark, d):
    return L.drop_margin_noise(A.boxes(spark, d)).select("doc_id", "page_num", "ord", "text")


# The fold of line reconstruction as a recursive expression: one step for each box of a page.
WALK = """walk(doc_id, page_num, ord, n, fy, pl, pw, lo, hi, pos) as (
        select doc_id, page_num, ord, 1::bigint, t, l, w, 0::bigint, 0::bigint, 0::bigint from base where ord = 1
        union all
        select b.doc_id, b.page_num, b.ord,
            case when level or slope then s.n else s.n + 1 end, case when level or slope then s.fy else t end,
            case when level and l < s.pl then s.pl else l end, case when level and l < s.pl then s.pw else w end,
            case when level and l < s.pl then s.lo - 1 when level or slope then s.lo else 0 end,
            case when level and l < s.pl then s.hi when level or slope then s.hi + 1 else 0 end,
            case when level and l < s.pl then s.lo - 1 when level or slope then s.hi + 1 else 0 end
        from walk s join (select * from base) b on b.doc_id = s.doc_id and b.page_num = s.page_num and b.ord = s.ord + 1,
            lateral (select t >= s.fy - 0.0075::double and t <= s.fy + 0.0075::double as level) x1,
            lateral (select not level and l > s.pl + s.pw and abs(s.fy - t) / (l - (s.pl + s.pw)) < 0.014::double as slope) x2)"""
PLACED = f"""{A.BOXES}, base as (select doc_id, page_num, ord, "left" l, top t, width w from boxes), {WALK}"""


@query(
    f"""with recursive {PLACED}
    select doc_id, page_num, n line_num, string_agg(text, ' ' || chr(9) order by pos) as text, count(*) n_boxes, round(avg(confidence), 6) confidence,
        round(sum(width), 6) words_width, round(min("left"), 6) "left", round(avg(top), 6) top,
        round(max_by("left" + width, case when pos >= 0 then pos end) - min("left"), 6) width
    from walk join boxes using (doc_id, page_num, ord) group by doc_id, page_num, n"""
)
def line_reconstruct(spark, d):
    m = L.merge_lines(L.assign_lines(A.boxes(spark, d)))
    return m.select("doc_id", "page_num", "line_num", "text", "n_boxes", *[r6(c).alias(c) for c in ("confidence", "words_width", "left", "top", "width")])


@query(
    f"""with recursive {PLACED},
    m as (select doc_id, page_num, n line_num, sum(width) ww, min("left") l, max_by("left" + width, case when pos >= 0 then pos end) - min("left") w
        from walk join boxes using (doc_id, page_num, ord) group by all),
    c as (select *, 0.5 - abs(l + w / 2 - 0.5) ce from m),
    k as (select *, min(ce) over (partition by doc_id) lo, max(ce) over (partition by doc_id) hi from c)
    select doc_id, page_num, line_num, round(ww / w, 6) words2width, round(case when hi = lo then 0 else (ce - lo) / (hi - lo) end, 6) centrality from k"""
)
def line_dataset(spark, d):
    f = L.line_features(L.merge_lines(L.assign_lines(A.boxes(spark, d))))
    return f.select("doc_id", "page_num", "line_num", r6("words2width").alias("words2width"), r6("centrality").alias("centrality"))


@query(
    """with b as (select o_orderkey id, o_custkey doc_id, 1::bigint page_num, o_orderkey ord, case when o_orderkey % 7 = 0 then 'PAGE' else 'LINE' end block_type from orders),
    e as (select x.id src, 'CHILD' as type, y.id dst from b x join b y on y.id = x.id + 1 where x.id % 7 = 0)
    select id, row_number() over (partition by doc_id, page_num order by ord) line_num from b where block_type = 'LINE' and exists (select 1 from e where e.dst = b.id)"""
)
def page_child_lines(spark, d):
    k = F.col("o_orderkey")
    blocks = A.table(spark, d, "orders").select(k.alias("id"), F.col("o_custkey").alias("doc_id"), F.lit(1).cast("long").alias("page_num"), k.alias("ord"), F.when(k % 7 == 0, "PAGE").otherwise("LINE").alias("block_type"))
    edges = blocks.filter("id % 7 = 0").select(F.col("id").alias("src"), F.lit("CHILD").alias("type"), F.lit(0).alias("ord"), (F.col("id") + 1).alias("dst"))
    return L.child_lines(blocks, edges).select("id", F.col("line_num").cast("long").alias("line_num"))


# ---- pages -------------------------------------------------------------------------------------------------------

TOC = """toc as (select doc_id, page_num, count(*) num_children, max(case when contains(lower(text), 'licensed') then 1 else 0 end) contains_contents_word,
    max(case when contains(lower(text), 'of the') then 1 else 0 end) contains_toc_phrase, max(case when contains(lower(text), 'la ') then 1 else 0 end) contains_list_of
    from lines group by doc_id, page_num)"""


def _toc(spark, d):
    return P.contents_features(A.lines(spark, d), ("licensed",), ("of the",), ("la ",))


@query(f"with {A.LINES}, {TOC} select * from toc")
def page_toc_features(spark, d):
    return _toc(spark, d)


@query(
    f"""with {A.BOXES} select doc_id, page_num, round(median(confidence), 6) med_confidence, round(avg(confidence), 6) avg_confidence, round(max(confidence) - min(confidence), 6) range_confidence,
        round(quantile_cont(confidence, 0.75) - quantile_cont(confidence, 0.25), 6) iqr_confidence, median(length(text)) med_line_len,
        max(case when contains(lower(text), 'purchase') then 1 else 0 end) contains_fig_word, max(case when regexp_matches(text, '(Figure|FIGURE)\\s\\d+\\.*\\s*\\w*') then 1 else 0 end) contains_fig_ln,
        coalesce(max(case when regexp_matches(text, '(Figure|FIGURE)\\s\\d+') then ord end), min(case when contains(lower(text), 'purchase') then ord end), -1) fig_pos
    from boxes group by doc_id, page_num"""
)
def page_fig_features(spark, d):
    f = P.figure_features(A.boxes(spark, d), "purchase")
    return f.select("doc_id", "page_num", *[r6(c).alias(c) for c in ("med_confidence", "avg_confidence", "range_confidence", "iqr_confidence")], "med_line_len", "contains_fig_word", "contains_fig_ln", "fig_pos")


@query(
    f"""with {A.LINES}, k as (select * from lines where length(text) > 120), c as (select doc_id, page_num, count(*) n_lines from k group by all),
    s as (select doc_id, unnest(generate_series(1, max(page_num))) page_num from c group by doc_id)
    select s.doc_id, s.page_num, coalesce(n_lines, 0) n_lines from s left join c using (doc_id, page_num)"""
)
def page_spine(spark, d):
    return P.page_spine(A.lines(spark, d).filter("length(text) > 120"))


@query(
    f"""with {A.LINES}, {TOC} select doc_id, page_num, score from (select doc_id, page_num, num_children * (1 + contains_list_of)::bigint score,
        row_number() over (partition by doc_id order by num_children * (1 + contains_list_of) desc, page_num) k from toc where contains_toc_phrase = 1) where k = 1"""
)
def best_toc_page(spark, d):
    score = (F.col("num_children") * (1 + F.col("contains_list_of"))).cast("long")
    return P.best_page(_toc(spark, d), F.col("contains_toc_phrase") == 1, score)


@query(
    f"""with recursive {A.LINES}, {TOC}, f as (select doc_id, page_num, contains_toc_phrase f0, greatest(contains_toc_phrase, contains_list_of, (num_children < 5)::int) f1 from toc),
    walk(doc_id, page_num, is_toc) as (select doc_id, page_num, f0 from f where page_num = 1 union all
        select f.doc_id, f.page_num, case when walk.is_toc = 1 then f1 else f0 end from walk join f on f.doc_id = walk.doc_id and f.page_num = walk.page_num + 1)
    select doc_id, page_num, is_toc from walk"""
)
def toc_carry(spark, d):
    flags = _toc(spark, d).select("doc_id", "page_num", F.col("contains_toc_phrase").alias("f0"), F.greatest("contains_toc_phrase", "contains_list_of", (F.col("num_children") < 5).cast("int")).alias("f1"))
    return P.carry(flags)


@query(
    f"""with {A.LINES}, {TOC} select a.doc_id, a.page_num, a.contains_toc_phrase toc, case when b.doc_id is null then 0 else 1 end prev_toc
    from toc a left join (select distinct doc_id, page_num from toc where contains_toc_phrase = 1) b on a.doc_id = b.doc_id and a.page_num = b.page_num + 1"""
)
def tag_prev(spark, d):
    return P.tag_after_contents(_toc(spark, d).select("doc_id", "page_num", F.col("contains_toc_phrase").alias("toc")))


@query(f"with {A.LINES}, {TOC} select doc_id, line_num from lines where not exists (select 1 from toc where toc.doc_id = lines.doc_id and toc.page_num = lines.page_num and contains_toc_phrase = 1)")
def drop_toc_lines(spark, d):
    rows = A.lines(spark, d)
    return L.without(rows, _toc(spark, d).filter("contains_toc_phrase = 1"), ["doc_id", "page_num"]).select("doc_id", "line_num")


# ---- scalars -----------------------------------------------------------------------------------------------------


@query(
    f"""with {A.NUMBERED}, p as (select line_id, text, regexp_extract(text, '{X.PREFIX}', 1) prefix, regexp_extract(text, '(\\t[0-9]+)$', 1) page from numbered)
    select line_id, prefix, substr(text, length(prefix) + 1) rest, page, left(text, length(text) - length(page)) body from p"""
)
def split_prefix_pagenum(spark, d):
    t = F.col("text")
    (prefix, rest), (body, page) = X.split_prefix(t), X.split_page_number(t)
    return A.numbered_lines(spark, d).select("line_id", prefix.alias("prefix"), rest.alias("rest"), page.alias("page"), body.alias("body"))


def _coded(s: str, keep: bool) -> str:
    other = "regexp_replace({}, '[0-9]', '', 'g')" if keep else "''"
    seg = f"string_split({s}, '.')"
    before, after = other.format("regexp_extract(x, '^([^1-9]*)', 1)"), other.format("regexp_extract(x, '^[^1-9]*(.*)$', 1)")
    rank = f"len(list_filter({seg}[1:i], lambda y: regexp_matches(y, '[1-9]')))"
    return f"array_to_string(list_transform({seg}, lambda x, i: case when regexp_matches(x, '[1-9]') then {before} || ' cyfra' || {rank}::varchar || ' ' || {after} else {other.format('x')} end), ' punkt ')"


@query(f"with {A.NUMBERED} select line_id, {_coded('text', False)} coded, {_coded('text', True)} coded_words from numbered")
def num2cyfra(spark, d):
    t = F.col("text")
    return A.numbered_lines(spark, d).select("line_id", X.coded_number(t).alias("coded"), X.coded_number(t, remove_words=False).alias("coded_words"))


@query(
    f"""with {A.NUMBERED}, p as (select line_id, regexp_extract(text, '{X.PREFIX}', 1) prefix, regexp_extract(text, '(\\t[0-9]+)$', 1) page, text from numbered)
    select line_id, {_coded('prefix', False)} || substr(left(text, length(text) - length(page)), length(prefix) + 1) || {_coded('page', False)} processed from p"""
)
def processed_text(spark, d):
    t = F.col("text")
    prefix, rest = X.split_prefix(X.split_page_number(t)[0])
    return A.numbered_lines(spark, d).select("line_id", F.concat(X.coded_number(prefix), rest, X.coded_number(X.split_page_number(t)[1])).alias("processed"))


def _shapes(literal: bool) -> str:
    months = ", ".join(f"'{m}'" for m in X.MONTHS)
    core = "case when starts_with(t, chr(9)) then regexp_replace(t, '^\\t+|\\t+$', '', 'g') else t end"
    small = "c || ' '" if literal else "'smallNum '"
    kind = f"""case when regexp_matches(c, '^[0-9][0-9]?$') then {small} when regexp_matches(c, '^[0-9]{{3}}$') then 'mediumNum ' when regexp_matches(c, '^[0-9]+$') then 'bigNum '
        when c in ({months}) then 'month ' when c = 'page' then 'page ' when c = 'appendix' then 'appendix ' when regexp_matches(c, '^[a-z]+$') then 'word ' when not regexp_matches(c, '^\\s*$') then 'mix ' else '' end"""
    parts = "string_split(regexp_replace(lower(text), '[!-/:-@\\[-`{-~]', ' ', 'g'), ' ')"
    pairs = f"list_transform({parts}, lambda t: {{'tab': case when starts_with(t, chr(9)) then 'tab ' else '' end, 'c': {core}}})"
    return f"array_to_string(list_transform({pairs}, lambda p: p.tab || {kind.replace('(c,', '(p.c,').replace('when c ', 'when p.c ').replace('then c ', 'then p.c ')}), '')"


@query(f"with {A.NUMBERED} select line_id, {_shapes(False)} shapes, {_shapes(True)} shapes_literal from numbered")
def token_shapes(spark, d):
    t = F.col("text")
    return A.numbered_lines(spark, d).select("line_id", X.token_shapes(t).alias("shapes"), X.token_shapes(t, literal_small=True).alias("shapes_literal"))


@query("select p_partkey, replace(trim(regexp_replace(lower(p_name || ' #' || p_type || '. '), '[!-/:-@\\[-`{-~]', '', 'g')), chr(10), '') normed from part")
def norm_string(spark, d):
    text = F.concat("p_name", F.lit(" #"), "p_type", F.lit(". "))
    return A.table(spark, d, "part").select("p_partkey", X.normalized_header(text).alias("normed"))


_SITE = "case {0} % 4 when 0 then c_name when 1 then c_mktsegment when 2 then 'Unnamed: 3' end"


@query(f"with t as (select c_custkey, {_SITE.format('c_custkey')} v from customer) select c_custkey, case when v is null then 'invalid_nan' when not regexp_matches(lower(v), '\\p{{Nd}}') then 'invalid_no_num' when contains(lower(v), 'unnamed') then 'invalid_nan' else 'valid' end klass from t")
def validate_site(spark, d):
    k = F.col("c_custkey") % 4
    v = F.when(k == 0, F.col("c_name")).when(k == 1, F.col("c_mktsegment")).when(k == 2, "Unnamed: 3")
    return A.table(spark, d, "customer").select("c_custkey", X.site_name_class(v).alias("klass"))


@query(
    """with t as (select o_orderkey, case o_orderkey % 6 when 0 then o_custkey::varchar || 'E' when 1 then 'AMG ' || o_custkey::varchar when 2 then o_orderpriority when 3 then '  ' when 4 then '20 deg S' end v from orders)
    select o_orderkey, case when v is null or trim(v) = '' then 'invalid_nan' when regexp_matches(regexp_replace(replace(trim(lower(v)), 'amg', ''), '[snewm]', '', 'g'), '\\p{Ll}') then 'invalid' else 'valid' end klass,
        case when v is null or regexp_matches(lower(v), '\\p{Ll}') then 'invalid' else 'valid' end number_class from t"""
)
def validate_loc(spark, d):
    k, c = F.col("o_orderkey") % 6, F.col("o_custkey").cast("string")
    v = F.when(k == 0, F.concat(c, F.lit("E"))).when(k == 1, F.concat(F.lit("AMG "), c)).when(k == 2, F.col("o_orderpriority")).when(k == 3, "  ").when(k == 4, "20 deg S")
    return A.table(spark, d, "orders").select("o_orderkey", X.location_class(v).alias("klass"), X.number_class(v).alias("number_class"))


@query(f"with {A.NUMBERED} select line_id, case when regexp_matches(text, '^[0-9]+\\.[0-9]+\\s+[\\p{{L}}\\p{{N}}_]+') then 2 when regexp_matches(text, '^[0-9]+\\.*\\s+[\\p{{L}}\\p{{N}}_]+') then 1 else 0 end rule from numbered")
def rule_headings(spark, d):
    return A.numbered_lines(spark, d).select("line_id", X.rule_heading(F.col("text")).alias("rule"))


@query(
    f"""with {A.NUMBERED}, t as (select line_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') w from numbered),
    g as (select *, list_filter(w, lambda x: regexp_matches(x, '^[0-9]+$')) n from t)
    select line_id, case when len(n) = 1 then n[1] when len(n) > 1 then w[-(line_id % 5 + 1)] end page_number from g"""
)
def page_number_pick(spark, d):
    position = (F.col("line_id") % 5 + 1).cast("int")
    return A.numbered_lines(spark, d).select("line_id", X.page_number(F.col("text"), position).alias("page_number"))


@query("select o_orderkey, case when length(o_custkey::varchar) < 3 then lpad(o_custkey::varchar, 3, '0') else o_custkey::varchar end padded, 'json' extension, regexp_extract('cr_' || o_orderkey::varchar || '_' || o_custkey::varchar || '_x.json', 'cr_([0-9]+)_([0-9]+)', 2) file_num from orders")
def name_parts(spark, d):
    c = F.col("o_custkey").cast("string")
    name = F.concat(F.lit("cr_"), F.col("o_orderkey").cast("string"), F.lit("_"), c, F.lit("_x.json"))
    return A.table(spark, d, "orders").select("o_orderkey", X.padded_number(c).alias("padded"), X.file_extension(name).alias("extension"), F.regexp_extract(name, "cr_([0-9]+)_([0-9]+)", 2).alias("file_num"))


# ---- headings and sections ---------------------------------------------------------------------------------------

_COUNTS = "select {k}, len(w)::bigint size, u.word, count(*) n from (select {k}, list_filter(regexp_split_to_array(lower({t}), '\\s+'), lambda x: x <> '') w from {f}), unnest(w) u(word) group by all"
PAIRS = f"""{A.LINES}, {A.HEADINGS}, lw as ({_COUNTS.format(k="doc_id, line_num", t="text", f="lines")}),
    hw as ({_COUNTS.format(k="doc_id, heading_id, level", t="regexp_replace(heading, '\\t[0-9]+$', '')", f="headings")}),
    shared as (select doc_id, line_num, heading_id, level, lw.size ls, hw.size hs, sum(least(lw.n, hw.n)) b from lw join hw using (doc_id, word) group by all),
    pairs as (select doc_id, line_num, heading_id, level, b / (ls + hs - b) similarity from shared),
    best as (select doc_id, line_num, similarity, level, heading_id from (select *, row_number() over (partition by doc_id, line_num order by similarity desc, level, heading_id) k from pairs) where k = 1),
    matched as (select doc_id, heading_id, line_num, similarity, level from (select *, row_number() over (partition by doc_id, heading_id order by similarity desc, line_num) k from best where similarity >= {LEAST}) where k = 1)"""


def _best(spark, d, every: bool = False):
    lines = A.lines(spark, d)
    return H.best_heading(H.similarities(lines, A.headings(spark, d)), lines if every else None)


def _matched(spark, d):
    return H.match_headings(_best(spark, d), LEAST)


@query(f"with {PAIRS} select doc_id, line_num, heading_id, round(similarity, 6) similarity from pairs")
def heading_similarity(spark, d):
    return H.similarities(A.lines(spark, d), A.headings(spark, d)).select("doc_id", "line_num", "heading_id", r6("similarity").alias("similarity"))


@query(f"with {PAIRS} select doc_id, line_num, coalesce(level, 0) as level, coalesce(heading_id, 0) heading_id, coalesce(round(similarity, 6), 0) similarity from lines left join best using (doc_id, line_num)")
def best_heading_per_line(spark, d):
    return _best(spark, d, every=True).withColumn("similarity", r6("similarity"))


@query(f"with {PAIRS} select doc_id, line_num, heading_id, level, round(similarity, 6) similarity from pairs where similarity >= 0.3")
def similar_headings(spark, d):
    """Pairs of a line and a heading of a least similarity."""
    return H.similar_at_least(A.lines(spark, d), A.headings(spark, d), 0.3).withColumn("similarity", r6("similarity"))


@query(f"with {PAIRS} select doc_id, heading_id, line_num, level, round(similarity, 6) similarity from matched")
def match_headings(spark, d):
    return _matched(spark, d).withColumn("similarity", r6("similarity"))


SECTIONS = f"""{PAIRS}, assigned as (select lines.doc_id, lines.line_num, last_value(m.heading_id ignore nulls) over (partition by lines.doc_id order by lines.line_num) heading_id, m.heading_id own, text
        from lines left join matched m using (doc_id, line_num)),
    sections as (select doc_id, line_num, heading_id, text from assigned where heading_id is not null and own is null)"""


@query(f"with {SECTIONS} select doc_id, line_num, heading_id from sections")
def section_lines(spark, d):
    return H.section_lines(A.lines(spark, d), _matched(spark, d)).select("doc_id", "line_num", "heading_id")


@query(f"with {SECTIONS} select doc_id, heading_id, count(*) n_lines, string_agg(text, chr(10) order by line_num) as content from sections group by all")
def section_text(spark, d):
    return H.section_texts(H.section_lines(A.lines(spark, d), _matched(spark, d)))


@query(f"with {SECTIONS} select doc_id, count(distinct heading_id) n_sections, count(*) n_lines, to_json({{'doc': doc_id, 'lines': count(*)}})::varchar report from sections group by doc_id")
def report_json(spark, d):
    rows = H.section_lines(A.lines(spark, d), _matched(spark, d)).groupBy("doc_id").agg(F.countDistinct("heading_id").alias("n_sections"), F.count(F.lit(1)).alias("n_lines"))
    return rows.withColumn("report", F.to_json(F.struct(F.col("doc_id").alias("doc"), F.col("n_lines").alias("lines"))))


@query(
    f"""with {PAIRS}, {TOC}, heads as (select matched.*, page_num from matched join lines using (doc_id, line_num)),
    tocs as (select doc_id, min(page_num) page_num from toc where contains_toc_phrase = 1 group by doc_id)
    select doc_id, 0::bigint ord, null::bigint parent, -1::bigint heading_id, 1::bigint page_num from (select distinct doc_id from heads)
    union all select doc_id, 1, null, -2, page_num from tocs where doc_id in (select doc_id from heads)
    union all select doc_id, row_number() over o + 1, case when level = 2 then last_value(case when level = 1 then heading_id end ignore nulls) over o end, heading_id, page_num from heads window o as (partition by doc_id order by line_num)"""
)
def bookmark_tree(spark, d):
    heads = _matched(spark, d).join(A.lines(spark, d).select("doc_id", "line_num", "page_num"), ["doc_id", "line_num"])
    tocs = _toc(spark, d).filter("contains_toc_phrase = 1").groupBy("doc_id").agg(F.min("page_num").alias("page_num"))
    return H.bookmarks(heads, tocs)


@query(f"with {A.BOXES} select doc_id, ord, round(595.0 * \"left\", 6) x0, round(842.0 * (1 - top), 6) y0, round(595.0 * (\"left\" + width), 6) x1, round(842.0 * (1 - top) - 842.0 * height, 6) y1 from boxes")
def toc_links(spark, d):
    rows = H.link_rectangles(A.boxes(spark, d), 595.0, 842.0)
    return rows.select("doc_id", "ord", *[r6(c).alias(c) for c in ("x0", "y0", "x1", "y1")])


# ---- tables and sites --------------------------------------------------------------------------------------------


@query("select o_custkey cell_id, string_agg(case when o_orderkey % 5 = 0 then 'X' else o_orderpriority end || ' ', '' order by o_orderkey) cell from orders group by o_custkey")
def cell_text(spark, d):
    words = A.table(spark, d, "orders").select(F.col("o_custkey").alias("cell_id"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("text"), (F.col("o_orderkey") % 5 == 0).alias("selected"))
    return T.cell_texts(words, ["cell_id"])


@query(f"with {A.CELLS} select table_id, row, string_agg(value || '`', '' order by col) line from cells group by all")
def table_rows(spark, d):
    return T.row_texts(A.cells(spark, d))


def _framed(spark, d):
    """(file_id, content): each table as the framed text of a file."""
    cells = A.cells(spark, d)
    head = cells.select("table_id", F.lit(0).cast("long").alias("row"), "col", F.lit(None).cast("string").alias("header"), F.col("header").alias("value")).distinct()
    return T.table_texts(cells.unionByName(head)).select(F.col("table_id").alias("file_id"), F.regexp_replace("content", "^Table: ", "Table: Table_").alias("content"))


@query(f"with {A.CELLS} select table_id file_id, 1 table_num, row, col, header, value from cells")
def cells_by_table_function(spark, d):
    """Tables written as framed text and read back by the table function, line by line."""
    texts = _framed(spark, d)
    return T.cells_of_lines(texts.select("file_id", F.posexplode(F.split("content", "\n")).alias("n", "line")))


@query(f"with {A.CELLS}, f as (select *, row_number() over (order by table_id) k from (select distinct table_id from cells)) select table_id file_id, 1 table_num, row, col, header, value from cells")
def table_text_round_trip(spark, d):
    """Tables written as framed text and read back."""
    return T.parse_table_text(_framed(spark, d))


@query(f"with {A.CELLS}, e as (select distinct table_id, 0::bigint as row, col, header as value from cells union all select table_id, row, col, value from cells) select table_id, count(*) n_tokens, string_agg(value, ' ' order by row, col) as content from e where regexp_matches(value, '^[A-z]+') and not contains(value, 'Unnamed:') and value <> 'nan' group by table_id")
def content_tokens(spark, d):
    return T.content_tokens(A.cells(spark, d))


@query("select event_id % 97 doc_id, 'k' || (event_id % 5)::varchar as key, max_by((props::json ->> '$.k')::varchar, event_id) as value from events group by all")
def kv_pairs(spark, d):
    k = F.col("event_id")
    pairs = A.table(spark, d, "events").select((k % 97).alias("doc_id"), F.concat(F.lit("k"), (k % 5).cast("string")).alias("key"), k.alias("ord"), F.get_json_object("props", "$.k").alias("value"))
    return T.key_values(pairs, ["doc_id"])


@query("select user_id doc_id, min_by((props::json ->> '$.k')::varchar, event_id) as value from events where regexp_matches(event_type, '(?i)^P.*SE$') group by user_id")
def kv_search(spark, d):
    pairs = A.table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("key"), F.col("event_id").alias("ord"), F.get_json_object("props", "$.k").alias("value"))
    return T.search_key(pairs, ["doc_id"], "^P.*SE$")


@query(f"with {A.BLOCK_CELLS} select doc_id, file_num, table_num, row, 1::bigint col, c1 as text from block_cells union all select doc_id, file_num, table_num, row, 2, c2 from block_cells")
def cells_from_blocks(spark, d):
    """Tables of the block graph: table to cells to words."""
    return B.table_cells(A.blocks(spark, d)).select("doc_id", "file_num", "table_num", "row", "col", "text")


@query(f"with {A.BLOCK_CELLS} select doc_id, file_num, p || ' ' as key, max_by(k::varchar || ' ' || case when k % 5 = 0 then 'X ' else '' end, k) as value from block_rows group by doc_id, file_num, p")
def kv_from_blocks(spark, d):
    """Forms of the block graph: key to value to words."""
    return B.key_values(A.blocks(spark, d))


@query(
    f"""with {A.BLOCK_CELLS}, t as (select doc_id, file_num, table_num, 'Table: Table_' || table_num::varchar || chr(10) || chr(10) || string_agg(c1 || '`' || c2 || '`' || chr(10), '' order by k) || repeat(chr(10), 5) as content from block_cells group by doc_id, file_num, table_num),
    w as (select doc_id, file_num, string_agg(content, '' order by table_num) as content from t group by doc_id, file_num)
    select doc_id, file_num, coalesce(content, '{T.NO_TABLE}') as content from (select distinct doc_id, file_num from block_rows) left join w using (doc_id, file_num)"""
)
def tables_text_from_blocks(spark, d):
    """The framed text of all tables of a response, or the mark that there are none."""
    return B.table_files(A.blocks(spark, d))


@query(f"with {A.BLOCK_CELLS} select doc_id, file_num, 'l-' || k::varchar id, p || ' ' || k::varchar as text, row_number() over (partition by doc_id, file_num order by k) line_num from block_rows where k % 7 <> 0")
def page_lines_from_blocks(spark, d):
    return B.page_lines(A.blocks(spark, d)).select("doc_id", "file_num", "id", "text", "line_num")


# A file is one page here, so it stands where the walk has the page.
@query(
    f"""with recursive {A.BLOCK_CELLS}, boxes as (select doc_id, file_num page_num, row_number() over (partition by doc_id, file_num order by k) ord, p || ' ' || k::varchar as text, k % 3 * 0.3::double + 0.1 as "left", (n // 2) * 0.02::double top
        from block_rows where k % 7 <> 0 and k % 11 <> 0), base as (select doc_id, page_num, ord, "left" l, top t, 0.2::double w from boxes), {WALK}
    select doc_id, page_num file_num, n line_num, string_agg(text, ' ' || chr(9) order by pos) as text, count(*) n_boxes, round(count(*) * 0.2::double, 6) words_width, round(min("left"), 6) "left", round(avg(top), 6) top
    from walk join boxes using (doc_id, page_num, ord) group by doc_id, page_num, n"""
)
def clean_lines_from_blocks(spark, d):
    """Reconstructed lines of each file of a report, from blocks of several result pages."""
    found = RP.clean_lines(A.blocks(spark, d))
    return found.select("doc_id", "file_num", "line_num", "text", "n_boxes", *[r6(c).alias(c) for c in ("words_width", "left", "top")])


# Words of the driver's tables stand for the domain's terms.
TERMS = {"site": ("p names, p_type, standard",), "geo": ("p size, psizes",), "grid": ("retail price, p_retail_prices, standard anodized tin",)}


def _sql_norm(c: str) -> str:
    return f"replace(trim(regexp_replace(lower({c}), '[!-/:-@\\[-`{{-~]', '', 'g')), chr(10), '')"


_VOCAB = "vocab0(kind, list) as (values " + ", ".join(f"('{k}', '{t}')" for k, ts in TERMS.items() for t in ts) + f"), vocab as (select distinct kind, {_sql_norm('term')} term from vocab0, unnest(string_split(list, ',')) u(term) where {_sql_norm('term')} <> '')"
_CHARS = "select {k}, length({t}) size, c as word, count(*) n from {f}, unnest(string_split({t}, '')) u(c) where c <> '' group by all"
MATCHES = f"""{A.CELLS}, {_VOCAB}, names as (select distinct header from cells union select distinct p_type from part),
    normed as (select header, {_sql_norm('header')} t from names), fine as (select * from normed where t <> 'nan' and not contains(t, 'unnamed')),
    hc as ({_CHARS.format(k='header', t='t', f='fine')}), vc as ({_CHARS.format(k='kind, term', t='term', f='vocab')}),
    hv as (select header, kind, term, hc.size a, vc.size b, sum(least(hc.n, vc.n)) s from hc join vc using (word) group by all),
    matches as (select header, kind, max(s / (a + b - s)) similarity from hv group by all having max(s / (a + b - s)) >= 0.8),
    roles as (select header, min_by(kind, case kind when 'site' then 1 when 'geo' then 2 else 3 end) as role from matches group by header)"""


def _roles(spark, d):
    names = A.cells(spark, d).select("header").distinct().unionByName(A.table(spark, d, "part").select(F.col("p_type").alias("header")).distinct())
    return S.match_headers(names, S.vocabulary(spark, TERMS))


@query(f"with {MATCHES} select header, kind, round(similarity, 6) similarity from matches")
def fuzzy_headers(spark, d):
    return _roles(spark, d).withColumn("similarity", r6("similarity"))


_SLOTS = """known as (select cells.*, role from cells join roles using (header)),
    slots as (select *, row_number() over (partition by table_id, role order by col) o, max(col) over (partition by table_id, role) m from (select distinct table_id, role, col from known)),
    wide as (select k.table_id, row, max(case when s.role = 'site' and s.col = m then value end) site_name, max(case when s.role = 'grid' and o = 1 then value end) grid_loc_1, max(case when s.role = 'grid' and o = 2 then value end) grid_loc_2,
        max(case when s.role = 'geo' and o = 1 then value end) geo_loc_1, max(case when s.role = 'geo' and o = 2 then value end) geo_loc_2,
        max(case when s.role = 'site' and s.col = m then header end) site_name_source, max(case when s.role = 'grid' and o = 1 then header end) grid_loc_1_source, max(case when s.role = 'grid' and o = 2 then header end) grid_loc_2_source,
        max(case when s.role = 'geo' and o = 1 then header end) geo_loc_1_source, max(case when s.role = 'geo' and o = 2 then header end) geo_loc_2_source from known k join slots s using (table_id, col) group by all),
    by_column as (select * from wide where site_name is not null and regexp_matches(lower(site_name), '\\p{Nd}') and not contains(lower(site_name), 'unnamed'))"""


def _site_cells(spark, d):
    """Cells in which the type column holds site names with digits."""
    numbered = F.when((F.col("header") == "p_type") & (F.col("row") % 3 > 0), F.concat("value", F.lit(" "), F.col("row").cast("string"))).otherwise(F.col("value"))
    return A.cells(spark, d).withColumn("value", numbered)


_SITE_CELLS = MATCHES.replace("cells as (select brand", "cells0 as (select brand", 1).replace(f", {_VOCAB}", f", cells as (select table_id, row, col, header, case when header = 'p_type' and row % 3 > 0 then value || ' ' || row::varchar else value end as value from cells0), {_VOCAB}", 1)


@query(f"with {_SITE_CELLS}, {_SLOTS} select * from by_column")
def column_extract(spark, d):
    return S.extract_columns(_site_cells(spark, d), S.header_roles(_roles(spark, d)))


_KEYS = """every as (select distinct table_id, 0::bigint as row, col::bigint col, header as value from cells union all select table_id, row, col, value from cells),
    marked as (select c.*, role, case when value is null then 'nan' when not regexp_matches(lower(value), '\\p{Nd}') then 'no_num' when contains(lower(value), 'unnamed') then 'nan' else 'valid' end k,
        case when value is null or trim(value) = '' then 'nan' when regexp_matches(regexp_replace(replace(trim(lower(value)), 'amg', ''), '[snewm]', '', 'g'), '\\p{Ll}') then 'bad' else 'valid' end l,
        case when lead(c.col) over (partition by table_id, row order by c.col) = c.col + 1 then lead(value) over (partition by table_id, row order by c.col) end x
        from every c left join roles on c.value = roles.header),
    walked as (select *, first_value(case when k <> 'nan' then {'v': value, 'k': k, 'x': x} end ignore nulls) over right_of r, first_value(case when k <> 'nan' then {'v': value, 'k': k, 'x': x} end ignore nulls) over below w,
        first_value(case when l <> 'nan' then {'v': value, 'l': l} end ignore nulls) over right_of lr, first_value(case when l <> 'nan' then {'v': value, 'l': l} end ignore nulls) over below lw
        from marked window right_of as (partition by table_id, row order by col rows between 1 following and unbounded following), below as (partition by table_id, col order by row rows between 1 following and unbounded following)),
    named as (select *, case when r.k = 'valid' then r.v when r.k = 'no_num' and r.x is not null and not regexp_matches(lower(r.x), '\\p{Ll}') then r.v || ' ' || r.x end rv,
        case when w.k = 'valid' then w.v when w.k = 'no_num' and w.x is not null and not regexp_matches(lower(w.x), '\\p{Ll}') then w.v || ' ' || w.x end wv from walked where role = 'site'),
    chosen as (select table_id, value source, coalesce(rv, wv) site_name, row_number() over (partition by table_id order by row desc, col desc) o from named),
    places as (select table_id, role, value source, coalesce(case when lr.l = 'valid' then lr.v end, case when lw.l = 'valid' then lw.v end) v, row_number() over (partition by table_id, role order by row, col) o from walked where role in ('geo', 'grid')),
    placed as (select table_id, """ + ", ".join(f"max(case when role = '{k}' and o = {i} then v end) {k}_loc_{i}, max(case when role = '{k}' and o = {i} then source end) {k}_loc_{i}_source" for k in ("grid", "geo") for i in (1, 2)) + """ from places group by table_id),
    by_key as (select table_id, site_name, source site_name_source, """ + ", ".join(f"{k}_loc_{i}, {k}_loc_{i}_source" for k in ("grid", "geo") for i in (1, 2)) + """ from chosen left join placed using (table_id) where o = 1 and site_name is not null)"""


@query(f"with {MATCHES}, {_KEYS} select * from by_key")
def key_extract(spark, d):
    return S.extract_keys(A.cells(spark, d), S.header_roles(_roles(spark, d)))


@query(f"with {_SITE_CELLS.replace('select distinct p_type from part', 'select distinct value from cells')}, {_SLOTS}, {_KEYS} select distinct table_id, {', '.join(S.VALUES + S.SOURCES)} from (select * exclude (row) from by_column union all by name select * from by_key)")
def site_extract(spark, d):
    """Both modes over all tables, with locations and sources."""
    return S.extract_sites(_site_cells(spark, d), S.vocabulary(spark, TERMS))


@query(f"with {_SITE_CELLS}, {_SLOTS}, {_KEYS} select distinct * from (select table_id, site_name from by_column union all select table_id, site_name from by_key)")
def site_union_dedup(spark, d):
    cells, roles = _site_cells(spark, d), S.header_roles(_roles(spark, d))
    return S.finalize(S.extract_columns(cells, roles).select("table_id", "site_name").unionByName(S.extract_keys(cells, roles).select("table_id", "site_name")))


@query("select a.vec_id, b.vec_id other_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) similarity from embeddings a join embeddings b on b.vec_id = a.vec_id + 1 or b.vec_id = a.vec_id + 10")
def cosine_pairs(spark, d):
    e = A.table(spark, d, "embeddings")
    other = e.select(F.col("vec_id").alias("other_id"), F.col("embedding").alias("_o"))
    near = e.select("vec_id", "embedding", F.explode(F.array(F.col("vec_id") + 1, F.col("vec_id") + 10)).alias("other_id"))
    return near.join(other, "other_id").select("vec_id", "other_id", r6(T.cosine(F.col("embedding"), F.col("_o"))).alias("similarity"))


@query(
    f"""with {A.CELLS}, n as (select table_id, row, col, c, count(*) n from cells, unnest(string_split(value, '')) u(c) where c <> '' group by all),
    s as (select table_id, row, col, sqrt(sum(n * n)) s from n group by all)
    select a.table_id, a.row, a.col, b.col other_col, round(sum(a.n * b.n) / (any_value(x.s) * any_value(y.s)), 6) similarity from n a join n b on a.table_id = b.table_id and a.row = b.row and a.c = b.c and a.col < b.col
        join s x on x.table_id = a.table_id and x.row = a.row and x.col = a.col join s y on y.table_id = a.table_id and y.row = a.row and y.col = b.col group by a.table_id, a.row, a.col, b.col"""
)
def cell_similarity(spark, d):
    return T.row_similarity(A.cells(spark, d)).withColumn("similarity", r6("similarity"))


@query(
    f"""with {A.CELLS}, every as (select table_id, row, col, value from cells union all select distinct table_id, 0, col, header from cells),
    n as materialized (select table_id, row, col, c, count(*) n from every, unnest(string_split(lower(value), '')) u(c) where c <> '' group by all),
    s as materialized (select table_id, row, col, sqrt(sum(n * n)) s from n group by all),
    p as (select a.table_id, 'row' line, a.row, a.col, b.row other_row, b.col other_col from every a join every b on a.table_id = b.table_id and a.row = b.row where a.col < b.col
        union all select a.table_id, 'column', a.row, a.col, b.row, b.col from every a join every b on a.table_id = b.table_id and a.col = b.col where a.row < b.row),
    d as (select a.table_id, 'row' line, a.row, a.col, b.row other_row, b.col other_col, sum(a.n * b.n) d from n a join n b on a.table_id = b.table_id and a.row = b.row and a.c = b.c where a.col < b.col group by all
        union all select a.table_id, 'column', a.row, a.col, b.row, b.col, sum(a.n * b.n) from n a join n b on a.table_id = b.table_id and a.col = b.col and a.c = b.c where a.row < b.row group by all),
    x as (select p.*, d, s.s from p left join d using (table_id, line, row, col, other_row, other_col) left join s using (table_id, row, col))
    select x.table_id, line, x.row, x.col, other_row, other_col, round(coalesce(d / (x.s * y.s), 0), 6) similarity
    from x left join s y on y.table_id = x.table_id and y.row = other_row and y.col = other_col"""
)
def cell_line_similarity(spark, d):
    return T.line_similarity(A.cells(spark, d)).withColumn("similarity", r6("similarity"))


@query("select o_orderkey, (o_orderdate + interval 20 day)::date::varchar received from orders where o_orderdate::date > date '1996-02-10' and contains(o_orderdate::date::varchar, '1998')")
def date_sanity(spark, d):
    day = F.to_date("o_orderdate")
    return A.table(spark, d, "orders").filter((day > F.to_date(F.lit("1996-02-10"))) & day.cast("string").contains("1998")).select("o_orderkey", F.date_add(day, 20).cast("string").alias("received"))


# ---- metadata ----------------------------------------------------------------------------------------------------


@query(f"with {A.REPORTS} select repno, rstatus, rtype, repdate::varchar repdate, submitby from reports where not contains(rstatus, 'P') and repdate > date '1995-06-01' and contains(submitby, 'B') and (contains(rtype, 'HIGH') or contains(rtype, 'URGENT') or contains(rtype, 'LOW')) and not contains(rtype, '1')")
def report_filter(spark, d):
    return M.filter_reports(M.open_reports(A.reports(spark, d), "P"), "1995-06-01", "B", ["HIGH", "URGENT", "LOW"], ["1"]).withColumn("repdate", F.col("repdate").cast("string"))


@query(f"with {A.REPORTS} select repno, rtype from reports order by (repno * 2654435761) % 4294967296, repno limit 20")
def report_sample(spark, d):
    return M.sample_ids(A.reports(spark, d).select("repno", "rtype"), "repno", 20)


@query(f"with {A.REPORTS} select rtype, count(*) n, count(distinct submitby) n_submitters, min(repdate)::varchar first_date, max(repdate)::varchar last_date from reports group by rtype")
def type_counts(spark, d):
    return A.reports(spark, d).groupBy("rtype").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("submitby").alias("n_submitters"), F.min("repdate").cast("string").alias("first_date"), F.max("repdate").cast("string").alias("last_date"))


@query(f"with {A.REPORTS} select distinct submitby from reports")
def distinct_submitters(spark, d):
    return A.reports(spark, d).select("submitby").distinct()


@query(
    """with c as (select o_orderpriority rtype, o_custkey % 10 rating, count(*) n from orders group by all), m as (select rtype, min_by(rating, (-n, rating)) as mode from c group by rtype)
    select o_orderpriority rtype, round(avg(o_totalprice), 4) mean, round(median(o_totalprice), 4) median, any_value(m.mode) as mode from orders join m on rtype = o_orderpriority group by o_orderpriority"""
)
def rating_stats(spark, d):
    rows = A.table(spark, d, "orders").select(F.col("o_orderpriority").alias("rtype"), "o_totalprice", (F.col("o_custkey") % 10).alias("rating"))
    means = rows.groupBy("rtype").agg(F.round(F.avg("o_totalprice"), 4).alias("mean"))
    middle = M.exact_quantiles(rows, "rtype", "o_totalprice", {"median": 0.5}).withColumn("median", F.round("median", 4))
    return means.join(middle, "rtype").join(M.modes(rows, "rtype", "rating"), "rtype")


@query("with r as (select min(n_chars) lo, max(n_chars) hi from documents) select least(floor((n_chars - lo) / ((hi - lo) / 9::double)) + 1, 9)::bigint bucket, count(*) n from documents, r group by all")
def histogram_lengths(spark, d):
    return M.histogram(A.table(spark, d, "documents"), "n_chars", 9)


@query(f"with {A.REPORTS} select extract(year from repdate)::int as year, count(*) n from reports group by all")
def histogram_dates(spark, d):
    return A.reports(spark, d).groupBy(F.year("repdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))


@query("select lang, count(*) n, sum(n_chars)::bigint total, round(avg(n_chars), 4) mean, round(stddev_samp(n_chars), 4) std, min(n_chars) least, quantile_cont(n_chars, 0.25) q1, quantile_cont(n_chars, 0.5) q2, quantile_cont(n_chars, 0.75) q3, max(n_chars) most from documents group by lang")
def describe_lengths(spark, d):
    rows = A.table(spark, d, "documents").select("lang", "n_chars")
    sums = rows.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("total"), F.round(F.avg("n_chars"), 4).alias("mean"), F.round(F.stddev_samp("n_chars"), 4).alias("std"),
        F.min("n_chars").alias("least"), F.max("n_chars").alias("most"),
    )
    return sums.join(M.exact_quantiles(rows, "lang", "n_chars", {"q1": 0.25, "q2": 0.5, "q3": 0.75}), "lang")


@query(f"with {A.REPORTS} select repno, case when repdate > date '1997-01-01' then (repdate - 36525)::date else repdate end::varchar fixed from reports")
def date_repair(spark, d):
    return A.reports(spark, d).select("repno", M.repair_date(F.col("repdate"), "1997-01-01").cast("string").alias("fixed"))


@query("select doc_id, lang, source, quality, case when contains(lower(source), '1') then 1 else 0 end has_one from documents join labels using (doc_id)")
def eval_join(spark, d):
    docs = A.table(spark, d, "documents").select("doc_id", "lang", "source")
    return docs.join(A.table(spark, d, "labels").select("doc_id", "quality"), "doc_id").withColumn("has_one", X.contains_word(F.col("source"), "1"))


@query(
    f"""with {A.LABELLED}, prev as (select doc_id // 2 doc_id, y from labelled), u as (select doc_id, min(y) y from prev group by doc_id having count(*) = 1)
    select documents.doc_id, y, case when y is not null then 'legacy' end tag_method from documents left join u using (doc_id)"""
)
def migrate_labels(spark, d):
    previous = A.labelled(spark, d).select(F.floor(F.col("doc_id") / 2).alias("doc_id"), "y")
    return M.migrate_labels(A.table(spark, d, "documents").select("doc_id"), previous, ["doc_id"])


@query("select doc_id from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id and toxic = 1)")
def sanitise_docs(spark, d):
    return L.without(A.table(spark, d, "documents").select("doc_id"), A.table(spark, d, "labels").filter("toxic = 1"), ["doc_id"])


@query("select page_id, url from pages p where exists (select 1 from labels l where l.doc_id = p.page_id and toxic = 1)")
def files_to_archive(spark, d):
    bad = A.table(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("page_id"))
    return A.table(spark, d, "pages").select("page_id", "url").join(bad, "page_id", "left_semi")


@query("select distinct o_orderkey doc_id, lpad(l_linenumber::varchar, 3, '0') file_num from orders join lineitem on l_orderkey = o_orderkey")
def id_list_match(spark, d):
    files = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("n"))
    listed = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"))
    found = L.with_ids(files, listed, "doc_id").distinct()
    return found.select("doc_id", X.padded_number(F.col("n").cast("string")).alias("file_num"))


@query("select s_nationkey file_id, coalesce(a.n, 0) n_first, coalesce(b.n, 0) n_second from (select distinct s_nationkey from supplier) f left join (select s_nationkey k, count(*) n from supplier where s_acctbal > 0 group by 1) a on a.k = s_nationkey left join (select c_nationkey k, count(*) n from customer where c_acctbal > 5000 group by 1) b on b.k = s_nationkey")
def service_table_counts(spark, d):
    s, c = A.table(spark, d, "supplier"), A.table(spark, d, "customer")
    count = lambda df, k, n: df.groupBy(F.col(k).alias("file_id")).agg(F.count(F.lit(1)).alias(n))
    files = s.select(F.col("s_nationkey").alias("file_id")).distinct()
    both = files.join(count(s.filter("s_acctbal > 0"), "s_nationkey", "n_first"), "file_id", "left").join(count(c.filter("c_acctbal > 5000"), "c_nationkey", "n_second"), "file_id", "left")
    return both.fillna(0, ["n_first", "n_second"])


@query("select doc_id, source, n_chars from (select *, row_number() over (partition by source, lang order by n_chars desc, doc_id) k from documents) where k = 1")
def dedup_keep_first(spark, d):
    """First row of each key after a sort, as an aggregate: no key is gathered in one task."""
    docs = A.table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")
    top = F.max(F.struct("n_chars", (-F.col("doc_id")).alias("d"))).alias("_t")
    return docs.groupBy("source", "lang").agg(top).select((-F.col("_t.d")).alias("doc_id"), "source", F.col("_t.n_chars").alias("n_chars"))


_PREDICTED = "select doc_id, quality y, case when contains(text, '!!') or contains(text, '###') then 0 else 1 end predicted from labels join documents using (doc_id)"


def _predicted(spark, d):
    rule = F.when(F.col("text").contains("!!") | F.col("text").contains("###"), 0).otherwise(1)
    return A.table(spark, d, "labels").join(A.texts(spark, d), "doc_id").select("doc_id", F.col("quality").alias("y"), rule.alias("predicted"))


@query(f"select y, predicted, count(*) n from ({_PREDICTED}) group by all")
def confusion(spark, d):
    return M.confusion(_predicted(spark, d))


@query(f"select round(avg(case when y = predicted then 1.0 else 0.0 end), 6) accuracy from ({_PREDICTED})")
def accuracy(spark, d):
    return _predicted(spark, d).agg(F.round(F.avg(F.when(F.col("y") == F.col("predicted"), 1.0).otherwise(0.0)), 6).alias("accuracy"))


@query(
    f"""with p as ({_PREDICTED}), l as (select distinct y as label from p union select distinct predicted from p),
    c as (select label, (select count(*) from p where y = label) support, (select count(*) from p where predicted = label) np, (select count(*) from p where y = label and predicted = label)::double hit from l),
    s as (select label, support, coalesce(case when np > 0 then hit / np end, 0) "precision", coalesce(case when support > 0 then hit / support end, 0) recall from c)
    select label, support::bigint support, round("precision", 6) "precision", round(recall, 6) recall, round(coalesce(case when "precision" + recall > 0 then 2 * "precision" * recall / ("precision" + recall) end, 0), 6) f1 from s"""
)
def class_report(spark, d):
    r = M.class_report(_predicted(spark, d))
    return r.select(F.col("label"), "support", *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


@query(f"with {A.LABELLED} select doc_id, case when tag_method is null or tag_method = 'auto' or y is null then (doc_id % 2)::bigint else y end y, case when tag_method is null or tag_method = 'auto' or y is null then 'auto' else tag_method end tag_method from labelled")
def auto_tag(spark, d):
    return M.auto_tag(A.labelled(spark, d), (F.col("doc_id") % 2).cast("long"))


@query(f"with {A.LABELLED} select doc_id, case when doc_id % 5 < 2 and y = 0 and (tag_method is null or tag_method <> 'manual') then null else y end y, tag_method from labelled")
def check_tags(spark, d):
    return M.reset_suspicious(A.labelled(spark, d), F.col("doc_id") % 5 < 2)


@query(f"with {A.LABELLED} select doc_id, round(1 - (0.5 + (doc_id * 37 % 100) / 200.0), 6) uncertainty from labelled order by 1 - (0.5 + (doc_id * 37 % 100) / 200.0::double) desc, doc_id limit 25")
def uncertain_topk(spark, d):
    certainty = F.lit(0.5) + (F.col("doc_id") * 37 % 100) / F.lit(200.0)
    return M.uncertain(A.labelled(spark, d), certainty, "doc_id", 25).select("doc_id", r6("uncertainty").alias("uncertainty"))


@query("select doc_id from documents where contains(lower(text), 'licensed') or contains(lower(text), 'released')")
def keyword_pool(spark, d):
    return M.keyword_pool(A.table(spark, d, "documents"), "text", ["licensed", "released"]).select("doc_id").distinct()


@query("select doc_id, case when (doc_id * 2654435761) % 4294967296 % 100 >= 20 then 'train' else 'test' end split from labels")
def train_test_split(spark, d):
    train, test = N.hold_out(A.table(spark, d, "labels").select("doc_id"), "doc_id")
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


@query("with w as (select doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) w from documents) select count(distinct w) n_words, (select max(n)::bigint from (select count(*) n from w group by doc_id)) longest from w")
def corpus_vocab(spark, d):
    """Distinct words and the longest document; words are counted by an aggregate of their own, not by one task."""
    words = A.texts(spark, d).select("doc_id", X.tokens(F.lower("text")).alias("w"))
    distinct = words.select(F.explode("w").alias("x")).distinct().agg(F.count(F.lit(1)).alias("n_words"))
    longest = words.agg(F.max(F.size("w")).cast("long").alias("longest"))
    return distinct.withColumn("_k", F.lit(1)).join(longest.withColumn("_k", F.lit(1)), "_k").drop("_k")


@query(f"with {A.CELLS}, v as (select table_id, row, col, value from cells union all select distinct table_id, 0, col, header from cells), n as (select table_id, row, col, c, count(*) n from v, unnest(string_split(lower(value), '')) u(c) where c <> '' group by all), s as (select table_id, row, col, sqrt(sum(n * n)) s from n group by all), p as (select a.table_id, a.row r, a.col c, b.row r2, b.col c2 from s a join s b on a.table_id = b.table_id and (a.row < b.row or a.row = b.row and a.col < b.col)), d as (select a.table_id, a.row r, a.col c, b.row r2, b.col c2, sum(a.n * b.n) d from n a join n b on a.table_id = b.table_id and a.c = b.c and (a.row < b.row or a.row = b.row and a.col < b.col) group by all) select p.table_id, count(*) n_pairs, round(max(coalesce(d, 0) / (x.s * y.s)), 6) closest, round(avg(coalesce(d, 0) / (x.s * y.s)), 6) average from p left join d using (table_id, r, c, r2, c2) join s x on x.table_id = p.table_id and x.row = r and x.col = c join s y on y.table_id = p.table_id and y.row = r2 and y.col = c2 group by p.table_id")
def cell_table_similarity(spark, d):
    """All pairs of cells of each table, headers included, summed up by table."""
    return T.table_similarity_summary(A.cells(spark, d)).withColumns({c: r6(c) for c in ("closest", "average")})


_FILES = "file_cells as (select *, p_brand file_id, split_part(table_id, '-', 2)::bigint + 1 table_num from cells join (select distinct p_brand from part) on starts_with(table_id, p_brand || '-'))"


def _file_cells(spark, d):
    """Cells by file (a brand) and number of the table within it."""
    parts = F.split("table_id", "-")
    return A.cells(spark, d).select(parts[0].alias("file_id"), (parts[1].cast("long") + 1).alias("table_num"), "row", "col", "header", "value")


def _chosen_tables(spark, d):
    """What stands for a prediction: tables with a cell of a certain text."""
    return _file_cells(spark, d).filter("value = 'hot bolt' and file_id <> 'Brand#1'").select("file_id", "table_num").distinct()


_CHOSEN = f"{A.CELLS}, {_FILES}, chosen as (select distinct file_id, table_num from file_cells where value = 'hot bolt' and file_id <> 'Brand#1')"


@query(f"with {_CHOSEN} select file_id, table_num, row, col, value from file_cells semi join chosen using (file_id, table_num)")
def selected_tables(spark, d):
    """The tables that a classifier chose."""
    return T.selected_tables(_file_cells(spark, d), _chosen_tables(spark, d)).select("file_id", "table_num", "row", "col", "value")


@query(
    f"""with {_CHOSEN}, kept as (select * from file_cells semi join chosen using (file_id, table_num)), every as (select distinct file_id, table_num, 0::bigint as row, col, header as value from kept union all select file_id, table_num, row, col, value from kept),
    lines as (select file_id, table_num, row, string_agg(value, ',' order by col) line from every group by all), bodies as (select file_id, table_num, string_agg(line, chr(10) order by row) body from lines group by all),
    numbered as (select *, row_number() over (partition by file_id order by table_num) k from bodies), texts as (select file_id, string_agg('Table: Table ' || k::varchar || chr(10) || body || chr(10) || '""' || chr(10), '' order by k) content from numbered group by file_id)
    select file_id, coalesce(content, '{T.NO_TABLES}' || chr(10)) as content from (select distinct file_id from file_cells) left join texts using (file_id)"""
)
def table_csv(spark, d):
    """Chosen tables of each file as text with banners, or the mark that there are none."""
    cells = _file_cells(spark, d)
    return T.table_files(T.selected_tables(cells, _chosen_tables(spark, d)), cells)


@query("with k as (select 'cr_' || (o_custkey % 97)::varchar || '_' || o_orderkey::varchar || '.' || case o_orderkey % 3 when 0 then 'pdf' when 1 then 'tif.gz' else 'txt' end as key from orders), w as (select distinct 'cr_' || (o_custkey % 89)::varchar || '_' || o_orderkey::varchar prefix from orders) select prefix, min(key) as key from w join k on split_part(key, '.', 1) = prefix group by prefix")
def first_keys(spark, d):
    """The first key of each wanted prefix."""
    o = A.table(spark, d, "orders")
    name = lambda n: F.concat(F.lit("cr_"), (F.col("o_custkey") % n).cast("string"), F.lit("_"), F.col("o_orderkey").cast("string"))
    ending = F.when(F.col("o_orderkey") % 3 == 0, "pdf").when(F.col("o_orderkey") % 3 == 1, "tif.gz").otherwise("txt")
    return R.first_with_prefix(o.select(F.concat(name(97), F.lit("."), ending).alias("key")), o.select(name(89).alias("prefix")).distinct())


@query("select o_custkey::varchar doc_id, case when o_orderkey % 3 = 0 then '1' else o_orderkey::varchar end file_num from orders where o_orderkey % 4 <> 1")
def numbered_names(spark, d):
    """Document and file numbers of names, those with letters left out."""
    o = A.table(spark, d, "orders")
    k = F.col("o_orderkey")
    doc = F.concat(F.col("o_custkey").cast("string"), F.when(k % 4 == 1, "a").otherwise(""))
    key = F.concat(F.lit("docs/cr_"), doc, F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("_"), k.cast("string"))), F.lit(".docx"))
    return R.numbered_names(o.select(key.alias("key")))


@query(f"with {A.NUMBERED}, t as (select line_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') w from numbered) select line_id, array_to_string(list_transform(w, lambda x: case when regexp_matches(x, '^[0-9]') then 'smallNum' else x end), ' ') words from t")
def num2word(spark, d):
    return A.numbered_lines(spark, d).select("line_id", X.number_words(F.col("text")).alias("words"))


@query(f"with {A.LABELLED} select doc_id, coalesce(a, y) y, case when a is not null then 'manual' else tag_method end tag_method from labelled left join (select doc_id, toxic::bigint a from labels where doc_id % 7 = 0) using (doc_id)")
def teach_labels(spark, d):
    """Human answers become labels."""
    answers = A.table(spark, d, "labels").filter("doc_id % 7 = 0").select("doc_id", F.col("toxic").cast("long").alias("answer"))
    return N.teach(A.labelled(spark, d), answers, ["doc_id"], "y")


@query(f"with {A.LABELLED} select doc_id, case when tag_method = 'auto' then null else y end y, tag_method from labelled")
def reset_auto_tags(spark, d):
    return N.reset_auto(A.labelled(spark, d), "y")


@query(
    f"""with {A.LINES}, {TOC}, p as (select doc_id, page_num, contains_toc_phrase toc, case when page_num % 2 = 0 then 'auto' end tag_method from toc),
    a as (select p.*, case when b.doc_id is null then 0 else 1 end prev_toc from p left join (select distinct doc_id, page_num from p where toc = 1) b on p.doc_id = b.doc_id and p.page_num = b.page_num + 1)
    select doc_id, page_num, prev_toc, tag_method, case when prev_toc = 1 and tag_method = 'auto' and toc = 0 then null else toc end toc from a"""
)
def tag_prev_reset(spark, d):
    """Pages after a contents page; their automatic labels 0 are asked again."""
    pages = _toc(spark, d).select("doc_id", "page_num", F.col("contains_toc_phrase").alias("toc"), F.when(F.col("page_num") % 2 == 0, "auto").alias("tag_method"))
    return P.tag_after_contents(pages)


_TOC_PAGE = "toc_page as (select doc_id, min(page_num) page_num from toc where contains_toc_phrase = 1 group by doc_id)"


def _toc_page(spark, d):
    return _toc(spark, d).filter("contains_toc_phrase = 1").groupBy("doc_id").agg(F.min("page_num").alias("page_num"))


@query(
    f"""with {A.LINES}, {TOC}, {_TOC_PAGE}, body as (select * from lines anti join toc_page using (doc_id, page_num)), {A.HEADINGS},
    lw as ({_COUNTS.format(k="doc_id, line_num", t="text", f="body")}), hw as ({_COUNTS.format(k="doc_id, heading_id, level", t="regexp_replace(heading, '\\t[0-9]+$', '')", f="headings")}),
    shared as (select doc_id, line_num, heading_id, level, lw.size ls, hw.size hs, sum(least(lw.n, hw.n)) b from lw join hw using (doc_id, word) group by all),
    best as (select * from (select *, row_number() over (partition by doc_id, line_num order by b / (ls + hs - b) desc, level, heading_id) k from shared) where k = 1)
    select doc_id, line_num, page_num, case when regexp_matches(text, '^[0-9]+.*?\\s[\\p{{L}}\\p{{N}}_]') then 1 else 0 end contains_num, coalesce(round(b / (ls + hs - b), 6), 0) matches_heading, coalesce(level, 0) matches_type, coalesce(heading_id, 0) matches_id
    from body left join best using (doc_id, line_num)"""
)
def intext_frame(spark, d):
    """Features of body lines for the in-text heading model."""
    out = RP.intext_frame(A.lines(spark, d), _toc_page(spark, d), A.headings(spark, d))
    return out.select("doc_id", "line_num", "page_num", "contains_num", r6("matches_heading").alias("matches_heading"), "matches_type", "matches_id")


@query(
    f"""with {A.LINES}, {TOC}, {_TOC_PAGE}, t as (select * from lines semi join toc_page using (doc_id, page_num)), p as (select *, regexp_extract(text, '(\\t[0-9]+)$', 1) page from t), q as (select *, left(text, length(text) - length(page)) body from p),
    r as (select *, regexp_extract(body, '{X.PREFIX}', 1) prefix from q)
    select doc_id, line_num, prefix section_prefix, substr(body, length(prefix) + 1) section_text, page section_page, {_coded('prefix', False)} || substr(body, length(prefix) + 1) || {_coded('page', False)} processed from r"""
)
def toc_heading_frame(spark, d):
    """Lines of contents pages, taken apart for their model."""
    rows = A.lines(spark, d).withColumn("left", F.lit(0.0)).withColumn("top", F.lit(0.0))
    return RP.toc_heading_frame(rows, _toc_page(spark, d)).drop("left", "top", "text")


_PLACED = "*, (line_num % 7) / 10.0::double \"left\", line_on_page / 10.0::double top, 0.5::double width, 0.01::double height"


def _placed_lines(spark, d):
    rows = A.lines(spark, d)
    return rows.select("*", ((F.col("line_num") % 7) / 10).alias("left"), (F.col("line_on_page") / 10).alias("top"), F.lit(0.5).alias("width"), F.lit(0.01).alias("height"))


@query(
    f"""with {PAIRS}, placed as (select {_PLACED} from lines), heads as (select matched.doc_id, matched.heading_id, page_num from matched join lines using (doc_id, line_num))
    select doc_id, heading_id, heads.page_num, round(595.0 * "left", 6) x0, round(842.0 * (1 - top), 6) y0, round(595.0 * ("left" + width), 6) x1, round(842.0 * (1 - top) - 842.0 * height, 6) y1
    from heads join placed using (doc_id) where placed.page_num = heading_id and line_on_page = 1"""
)
def toc_link_boxes(spark, d):
    """Links from the contents' lines to the pages of their headings."""
    places = A.headings(spark, d).join(A.lines(spark, d).filter("line_on_page = 1").select("doc_id", F.col("page_num").alias("heading_id"), "page_num", "line_num"), ["doc_id", "heading_id"])
    found = _matched(spark, d).select("doc_id", "heading_id", "line_num").join(A.lines(spark, d).select("doc_id", "line_num", "page_num"), ["doc_id", "line_num"])
    rows = RP.toc_link_boxes(places, found, _placed_lines(spark, d).filter("line_on_page = 1"), 595.0, 842.0)  # headings are first lines
    return rows.select("doc_id", "heading_id", "page_num", *[r6(c).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query(f"with {A.LINES} select doc_id, page_num, line_num, round((line_num % 7) / 10.0::double, 6) \"left\", 'marginal' kind from lines where line_on_page = 1 or line_on_page = 5")
def boxes_at_pages(spark, d):
    """Boxes of marked lines by page, as an overlay draws them."""
    marks = A.lines(spark, d).filter("line_on_page in (1, 5)").select("doc_id", "page_num", "line_num", F.lit("marginal").alias("kind"))
    return RP.boxes_at_pages(_placed_lines(spark, d), marks).select("doc_id", "page_num", "line_num", r6("left").alias("left"), "kind")


@query(
    f"""with {SECTIONS}, {TOC}, heads as (select matched.*, page_num from matched join lines using (doc_id, line_num)),
    tocs as (select doc_id, min(page_num) page_num from toc where contains_toc_phrase = 1 group by doc_id),
    marks as (select doc_id, 0::bigint ord, null::bigint parent, -1::bigint heading_id, 1::bigint page_num from (select distinct doc_id from heads)
        union all select doc_id, 1, null, -2, page_num from tocs where doc_id in (select doc_id from heads)
        union all select doc_id, row_number() over o + 1, case when level = 2 then last_value(case when level = 1 then heading_id end ignore nulls) over o end, heading_id, page_num from heads window o as (partition by doc_id order by line_num)),
    bookmarks as (select doc_id, '[' || string_agg('{{"ord":' || ord || case when parent is not null then ',"parent":' || parent else '' end || ',"heading_id":' || heading_id || ',"page_num":' || page_num || '}}', ',' order by ord) || ']' b from marks group by doc_id),
    texts as (select doc_id, heading_id, count(*) n_lines, string_agg(text, chr(10) order by line_num) as content from sections group by all),
    parts as (select doc_id, '[' || string_agg('{{"heading_id":' || heading_id || ',"n_lines":' || n_lines || ',"content":' || to_json(content)::varchar || '}}', ',' order by heading_id) || ']' t from texts group by doc_id),
    pages as (select doc_id, max(page_num) n_pages from lines group by doc_id)
    select doc_id, '{{"doc_id":' || doc_id || ',"n_pages":' || n_pages || case when tocs.page_num is not null then ',"toc_page":' || tocs.page_num else '' end || coalesce(',"sections":' || t, '') || coalesce(',"bookmarks":' || b, '') || '}}' as report
    from pages left join tocs using (doc_id) left join parts using (doc_id) left join bookmarks using (doc_id)"""
)
def report_objects(spark, d):
    """Each document as one JSON object: pages, contents page, sections and bookmarks."""
    matched = materialize(_matched(spark, d), "matched")
    lines = A.lines(spark, d)
    heads = matched.join(lines.select("doc_id", "line_num", "page_num"), ["doc_id", "line_num"])
    tree = H.bookmarks(heads, _toc_page(spark, d))
    return RP.report_objects(H.section_texts(H.section_lines(lines, matched)), tree, _toc_page(spark, d), lines)


_NAMED = f"""{SECTIONS}, {TOC}, named as (select matched.doc_id, matched.heading_id, matched.level, matched.line_num, page_num, heading from matched join lines using (doc_id, line_num)
        join headings on headings.doc_id = matched.doc_id and headings.heading_id = matched.heading_id)"""


def _named_headings(spark, d):
    """Matched headings with their text and page."""
    lines = A.lines(spark, d).select("doc_id", "line_num", "page_num")
    return _matched(spark, d).join(A.headings(spark, d).select("doc_id", "heading_id", "heading"), ["doc_id", "heading_id"]).join(lines, ["doc_id", "line_num"])


@query(
    f"""with {_NAMED}, marks as (select doc_id, 0 k, null::bigint above, 'Title Page' title, 1::bigint page_num from (select distinct doc_id from named)
        union all select doc_id, 1, null, 'Table of Contents', min(page_num) from toc where contains_toc_phrase = 1 and doc_id in (select doc_id from named) group by doc_id
        union all select doc_id, row_number() over o + 1, case when level = 2 then last_value(case when level = 1 then line_num end ignore nulls) over o end, heading, page_num from named window o as (partition by doc_id order by line_num)),
    placed as (select *, row_number() over (partition by doc_id order by k) - 1 ord from marks),
    tops as (select doc_id, line_num, row_number() over (partition by doc_id order by line_num) + 1 k from named)
    select m.doc_id, m.ord, p.ord parent, m.title, m.page_num from placed m left join tops t on t.doc_id = m.doc_id and t.line_num = m.above left join placed p on p.doc_id = m.doc_id and p.k = t.k"""
)
def pdf_outlines(spark, d):
    """The bookmark tree put into a PDF file of each document, and read back from the files."""
    named = materialize(_named_headings(spark, d), "named")
    tree = materialize(H.bookmarks(named, _toc_page(spark, d)), "tree")
    above = tree.select("doc_id", F.col("heading_id").alias("parent"), F.col("ord").alias("_above"))
    titles = named.select("doc_id", "heading_id", "heading")
    fixed = F.when(F.col("heading_id") == -1, "Title Page").when(F.col("heading_id") == -2, "Table of Contents")
    marks = tree.join(above, ["doc_id", "parent"], "left").join(titles, ["doc_id", "heading_id"], "left").select("doc_id", "ord", F.col("_above").alias("parent"), F.coalesce(fixed, F.col("heading")).alias("title"), "page_num")
    counts = A.lines(spark, d).groupBy("doc_id").agg(F.max("page_num").alias("n_pages"))
    links = spark.createDataFrame([], "doc_id bigint, page_num bigint, x0 double, y0 double, x1 double, y1 double, to_page bigint")
    return PM.outlines(PM.add_marks(A.pdfs(counts), marks, links), content="marked")


@query(
    f"""with {_NAMED}, written as (select s.doc_id, n.line_num ord, n.heading, string_agg(s.text, '' order by s.line_num) as body from sections s join named n using (doc_id, heading_id) group by all),
    parts as (select doc_id, 2 * ord as place, heading as text from written union all select doc_id, 2 * ord + 1, body from written)
    select doc_id, row_number() over (partition by doc_id order by place) as place, trim(regexp_replace(text, '\\s+', ' ', 'g')) as text from parts where regexp_matches(text, '\\S')"""
)
def word_sections(spark, d):
    """Sections written as Word files, and the paragraphs read back from the files."""
    named = materialize(_named_headings(spark, d), "named")
    lines = H.section_lines(A.lines(spark, d), named).join(named.select("doc_id", "heading_id", F.col("line_num").alias("ord"), "heading", "level"), ["doc_id", "heading_id"])
    folder = fresh_path(spark, "word")
    files = materialize(WD.write_sections(lines, folder, folders=WORD_FOLDERS), "files")
    read = OF.word_documents_of(files, folder).filter("kind = 'paragraph'").withColumn("doc_id", F.regexp_extract("path", r"cr_([0-9]+)\.docx$", 1).cast("bigint"))
    kept = read.filter(F.col("text").rlike(r"\S"))
    return kept.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("row")).alias("place"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"))


@query(f"with {A.REPORTS} select repno, rtype, submitby from reports")
def appended_rows(spark, d):
    """Reports appended to one CSV data set in two jobs, and read back."""
    rows, path = A.reports(spark, d).select("repno", "rtype", "submitby"), fresh_path(spark, "appended")
    for k in (0, 1):
        AP.append(rows.filter(F.col("repno") % 2 == k), path)
    return AP.read(spark, path, rows.schema)


@query("select page_id, regexp_extract(html, '<title>(.*?)</title>', 1) title, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) h1, len(regexp_extract_all(html, '<li>'))::bigint n_nav, regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1) footer from pages")
def html_outline(spark, d):
    h = F.col("html")
    return A.table(spark, d, "pages").select("page_id", F.regexp_extract(h, "<title>(.*?)</title>", 1).alias("title"), F.regexp_extract(h, "(?s)<h1>(.*?)</h1>", 1).alias("h1"), F.size(F.regexp_extract_all(h, F.lit("<li>"), F.lit(0))).cast("long").alias("n_nav"), F.regexp_extract(h, "(?s)<footer>(.*?)</footer>", 1).alias("footer"))


FLAGSHIP = section_lines


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from quirefold.plans import learning

    return QUERIES | learning.QUERIES


def oracle_sql() -> dict[str, str]:
    from quirefold.plans import learning

    return SQL | learning.SQL
