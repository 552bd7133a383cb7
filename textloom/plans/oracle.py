"""SQL for DuckDB that gives the rows of plans.queries. Its expressions have no look-around: borders are consumed instead."""

from __future__ import annotations

from textloom.plans.dirty import DIRTY

WS = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
ND = r"\p{Nd}"
L = "[A-Za-zА-Яа-яЁё]"

# Fixed values, held apart from the engine's own so that a slip in either shows. The first pattern here also counts
# the city's name, whose matches count() takes off again.
PATTERNS = {
    "stalin": [r"\bсталин\w*", r"\bиосиф\s+виссарионович", r"\bджугашвили"],
    "weak_stalin": [r"\bкоба\b"],
    "cult": [
        r"культ\s+личности",
        r"вождь\s+народ(?:а|ов)?",
        r"великий\s+вождь",
        r"отец\s+народ(?:а|ов)?",
        r"гениальн\w*\s+вождь",
        r"мудр\w*\s+(?:руководств|вождь|сталин)",
    ],
    "repression": [
        r"\bрепресс\w*",
        r"\bгулаг\w*",
        r"\bнквд\b",
        r"\bогпу\b",
        r"\bнкгб\b",
        r"\bбольшой\s+террор",
        r"\bмассов\w+\s+террор",
        r"\bполитическ\w+\s+террор",
        r"\bчистк[аи]\b",
        r"\bраскулачива\w*",
        r"\bвраг\w*\s+народа",
        r"\bтройк[аи]\b",
        r"\bлагер[яьей]\w*",
        r"\bссылк\w*",
        r"\bдепортац\w*",
        r"\bвыселен\w*",
        r"\bрасстрел\w*",
        r"\bарест\w*(?:\s+\w+){0,2}\s*(?:1930|1937|1938|194\d)",
    ],
    "events": [
        r"коллективизаци[яи]",
        r"индустриализаци[яи]",
        r"пятилет\w*\s*план",
        r"первая\s+пятилетка",
        r"вторая\s+пятилетка",
        r"стахановск\w*",
        r"ударни[кч]\w*",
        r"социалистическ\w+\s+соревнован\w*",
        r"голод\w*\s*(?:1932|1933|голодомор)",
        r"голодомор",
    ],
    "trials": [
        r"московск\w+\s+процесс",
        r"показательн\w+\s+процесс",
        r"дело\s+врач\w*",
        r"ленинградское\s+дело",
        r"антипартийн\w+\s+групп\w*",
        r"троцкист\w*",
        r"зиновьев\w*",
        r"каменев\w*",
        r"бухарин\w*",
        r"рыков\w*",
        r"тухачевск\w*",
        r"ежов\w*",
        r"берия",
        r"ягода",
    ],
}
WEIGHTS = {"stalin": 3, "weak_stalin": 1, "cult": 2, "repression": 2, "trials": 1, "events": 1}
STRONG = ["stalin", "cult", "repression", "events", "trials"]
RANKED = ["repression", "cult", "events", "trials"]
KEY_YEARS = "1929 1930 1932 1933 1934 1936 1937 1938 1939 1946 1948 1949 1952 1953".split()
ABBREVIATIONS = (
    "млрд. проч. напр. акад. проф. т.д. т.п. т.е. т.н. т.к. тыс. млн. руб. чел. гг. вв. др. см. ср. ок. им. г. в."
).split()
MAX_CHARS, MAX_SENTENCES, MIN_SEGMENT_WORDS, MIN_PARAGRAPH_WORDS = 1500, 5, 15, 8


def sub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, '{pattern}', {to}, 'g')"


def strip(x: str) -> str:
    return sub(x, f"^{WS}+|{WS}+$", "''")


def words(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[A-Za-zА-Яа-яЁё0-9]+'))"


def tokens(x: str) -> str:
    return rf"len(regexp_extract_all({x}, '[^\t-\r\x1c-\x20\x{{85}}\p{{Z}}]+'))"


def normalized(x: str) -> str:
    nl = "chr(10)"
    x = f"replace(replace({x}, chr(13)||{nl}, {nl}), chr(13), {nl})"
    x = f"replace(replace(replace({x}, chr(160), ' '), chr(8203), ''), chr(12), {nl}||{nl})"
    x = f"translate({x}, '‐‑‒–—―', '------')"
    x = sub(x, r"[ \t]+", "' '")
    x = sub(x, rf"(?m)^{WS}*-?{WS}*{ND}{{1,4}}{WS}*-?{WS}*$", "''")
    x = sub(x, rf"(?i)(^|[^\p{{L}}\p{{N}}_])стр\.?{WS}*{ND}{{1,4}}([^\p{{L}}\p{{N}}_]|$)", r"'\1\2'")
    n = rf"{ND}{{1,3}}"
    x = sub(x, rf"\[{WS}*(?:см\.?{WS}*)?{n}(?:{WS}*[-–—]{WS}*{n})?(?:{WS}*[,;]{WS}*{n})*{WS}*\]", "''")
    x = sub(x, r"\n{3,}", f"{nl}||{nl}")
    x = sub(x, rf"({L})-{WS}*\n{WS}*({L})", r"'\1\2'")
    x = f"replace(replace(replace({x}, {nl}||{nl}, chr(1)), {nl}, ' '), chr(1), {nl}||{nl})"
    x = sub(x, r"[ \t]+", "' '")
    return f"array_to_string(list_transform(string_split({x}, {nl}), lambda l: {strip('l')}), {nl})"


def repaired(x: str) -> str:
    y = sub(x, r"([тТгГ])\.", r"'\1'||chr(2)")
    y = sub(y, r"\.([А-ЯЁA-Z])", r"'.'||chr(10)||chr(10)||'\1'")
    y = sub(f"replace({y}, chr(2), '.')", rf"§{WS}*({ND}+)", r"chr(10)||chr(10)||'§ \1'")
    return f"case when len(string_split({x}, chr(10))) - 1 < 20 and length({x}) > 10000 then {y} else {x} end"


def form(x: str) -> str:
    x = f"translate(lower({x}), 'ё', 'е')"
    return strip(sub(sub(x, r"[^\p{L}\p{N}_\t-\r\x1c-\x20\x{85}\p{Z}]", "' '"), f"{WS}+", "' '"))


def sentence_list(x: str) -> str:
    for a in ABBREVIATIONS:
        x = f"regexp_replace({x}, '(?i){a.replace('.', r'\.')}', '{a.rstrip('.').replace('.', '`')}`', 'g')".replace("`", "'||chr(3)||'")
    x = sub(x, rf'([.!?][»")\]]?){WS}+', r"'\1'||chr(2)")
    return f"list_filter(list_transform(string_split({x}, chr(2)), lambda s: {strip('replace(s, chr(3), chr(46))')}), lambda s: s <> '')"


def paragraph_list(x: str) -> str:
    return rf"list_filter(list_transform(string_split_regex({x}, '\n{WS}*\n'), lambda p: {strip('p')}), lambda p: p <> '' and {words('p')} >= {MIN_PARAGRAPH_WORDS})"


DIRTY_CTE = f"dirty as materialized (select doc_id, lang as period, {DIRTY} as raw from documents)"
NORM_CTE = f"""{DIRTY_CTE}, lines as materialized (select doc_id, period, raw, {normalized('raw')} as x from dirty),
norm as materialized (select doc_id, period, raw, {strip(f'({repaired("x")})')} as text from lines)"""
PAR_CTE = f"""{NORM_CTE}, pars as materialized (select doc_id, period, {paragraph_list('text')} as ps from norm),
par as materialized (select doc_id, period, unnest(ps) as paragraph, unnest(range(len(ps)))::int as paragraph_idx from pars)"""
SEG_CTE = f"""{PAR_CTE}, sen as materialized (select *, {sentence_list('paragraph')} as ss from par),
kind as materialized (select *, (length(paragraph) <= {MAX_CHARS} and len(ss) <= {MAX_SENTENCES}) or len(ss) <= 2 as short from sen),
fold as (
  select doc_id, paragraph_idx, list_transform(ss, lambda s: length(s)) as ls, 1 as i, 1 as cnt, length(ss[1]) + 1 as size, 0 as cut from kind where not short
  union all
  select doc_id, paragraph_idx, ls, i + 1, case when fu then 1 else cnt + 1 end, case when fu then ls[i + 1] else size + ls[i + 1] + 1 end, case when fu then 1 else 0 end
  from (select *, (size + ls[i + 1] > {MAX_CHARS} and cnt >= 2) or cnt >= {MAX_SENTENCES} as fu from fold where i < len(ls))
), numbered as (select doc_id, paragraph_idx, i, sum(cut) over (partition by doc_id, paragraph_idx order by i) as g from fold),
counted_cuts as (select doc_id, paragraph_idx, g, count(*) as n from numbered group by all),
sized as (select *, max(g) over (partition by doc_id, paragraph_idx) as last from counted_cuts),
mapped as (
  select s.doc_id, s.paragraph_idx, s.g, case when s.g = s.last and s.n = 1 and s.g > 0 and p.n < {MAX_SENTENCES} then s.g - 1 else s.g end as h
  from sized s left join sized p on s.doc_id = p.doc_id and s.paragraph_idx = p.paragraph_idx and p.g = s.g - 1
), packed as (
  select k.doc_id, k.period, k.paragraph_idx, m.h as segment_idx, string_agg(k.ss[n.i], ' ' order by n.i) as text, count(*) as sentence_count
  from numbered n join mapped m using (doc_id, paragraph_idx, g) join kind k using (doc_id, paragraph_idx) group by all
), every as (
  select doc_id, period, paragraph_idx, 0 as segment_idx, paragraph as text, len(ss) as sentence_count from kind where short
  union all select doc_id, period, paragraph_idx, segment_idx, text, sentence_count from packed
), seg as materialized (select doc_id, period, paragraph_idx, segment_idx::int as segment_idx, text, length(text) as char_count, {words('text')} as word_count, sentence_count from every where {words('text')} >= {MIN_SEGMENT_WORDS})"""


def spelled_out(pattern: str) -> str:
    """The pattern over doubled non-word characters: a border takes one of them, or the end of the text."""
    for sign, spelled in ((r"\b", None), (r"\w", WORD), (r"\s", WS), (r"\d", ND)):
        if spelled is None:
            pattern = ("(?:^|[^W])" + pattern[2:]) if pattern.startswith(sign) else pattern
            pattern = (pattern[:-2] + "(?:$|[^W])") if pattern.endswith(sign) else pattern
        else:
            pattern = pattern.replace(sign, spelled)
    return "(?:" + pattern.replace("[^W]", r"[^\p{L}\p{N}_]") + ")"


def count(category: str) -> str:
    """Matches of a category in `d`, the folded text with every character that is in no word doubled."""
    n = f"len(regexp_extract_all(d, '(?i){'|'.join(map(spelled_out, PATTERNS[category]))}'))"
    city = rf" - len(regexp_extract_all(d, '(?i)(?:^|[^\p{{L}}\p{{N}}_])сталинград{WORD}*'))" if category == "stalin" else ""
    return n + city


YEARS = rf"list_sort(list_distinct(regexp_extract_all(d, '(?:^|[^\p{{Nd}}])({'|'.join(KEY_YEARS)})(?:[^\p{{Nd}}]|$)', 1)))"
_counts = ", ".join(f"{count(c)} as n_{c}" for c in PATTERNS)
_score = " + ".join(f"n_{c} * {w}" for c, w in WEIGHTS.items())
_best = f"greatest({', '.join(f'n_{c} * {WEIGHTS[c]}' for c in RANKED)})"
_most = "greatest(" + ", ".join(f"case when n_{c} * {WEIGHTS[c]} = best then n_{c} else -1 end" for c in RANKED) + ")"
_ties = " + ".join(f"(case when n_{c} * {WEIGHTS[c]} = best and n_{c} = most then 1 else 0 end)" for c in RANKED)
_name = " ".join(f"when n_{c} * {WEIGHTS[c]} = best and n_{c} = most then 'strong_{c}'" for c in RANKED)
SCORED_CTE = rf"""{SEG_CTE}, folded as (select *, translate(text, 'ёЁ', 'еЕ') as f from seg),
doubled as (select *, regexp_replace(f, '([^\p{{L}}\p{{N}}_])', '\1\1', 'g') as d, regexp_replace(f, '([^\p{{Nd}}])', '\1\1', 'g') as y from folded),
counted as (select * exclude (d, y, f), {_counts}, {YEARS.replace('(d,', '(y,')} as key_years from doubled),
gated as (select *, len(key_years) as n_key_years, greatest({', '.join(f'n_{c}' for c in STRONG)}) > 0 as strong, {_best} as best from counted),
ranked as (select *, {_most} as most, {_score} + case when strong then least(n_key_years, 3) else 0 end as score from gated),
scored as materialized (select *, case when n_stalin > 0 then 'stalin_direct' when strong and score >= 2 then case when {_ties} > 1 then 'strong_mixed' {_name} end end as reason from ranked)"""

KEYS = "doc_id, paragraph_idx, segment_idx"

#: Fuzzy deduplication by recursion over the rows of a period in order, on documents.
GRAMS_CTE = f"""forms as (select doc_id, lang as period, {form('text')} as form from documents where text is not null),
first as (select *, min(doc_id) over (partition by period, md5(form)) as kept_seq from forms),
sets as materialized (select doc_id, period, length(form) as len, list_distinct(list_transform(range(1, length(form) - 1), lambda i: substr(form, i, 3))) as grams from first where doc_id = kept_seq and length(form) >= 10),
pairs as materialized (
  select period, a, b, common / (na + nb - common)::double as similarity from (
    select x.period, x.doc_id as a, y.doc_id as b, len(x.grams) as na, len(y.grams) as nb, len(list_intersect(x.grams, y.grams)) as common
    from sets x join sets y on x.period = y.period and x.doc_id < y.doc_id and least(x.len, y.len) >= greatest(x.len, y.len) * 0.85
      and least(len(x.grams), len(y.grams)) >= greatest(len(x.grams), len(y.grams)) * 0.85
  ) where common / (na + nb - common)::double >= 0.85
), later as (select b, list(a) as before, dense_rank() over (order by b) as turn from pairs group by b),
walk as (
  select 0::bigint as turn, []::bigint[] as gone
  union all
  select w.turn + 1, case when len(list_filter(l.before, lambda p: not list_contains(w.gone, p))) > 0 then list_append(w.gone, l.b) else w.gone end
  from walk w join later l on l.turn = w.turn + 1
), removed as (select unnest(gone) as b from (select gone from walk order by turn desc limit 1)),
best as (select period, b as removed_seq, arg_min(a, (-similarity, a)) as kept_seq, max(similarity) as similarity from pairs where b in (from removed) and a not in (from removed) group by all)"""

#: The same without the cut to the first of equal forms: all pairs.
ALL_GRAMS_CTE = GRAMS_CTE.replace("where doc_id = kept_seq and length(form) >= 10", "where length(form) >= 10")
assert ALL_GRAMS_CTE != GRAMS_CTE

ROWS = "rows as (select vec_id as idx, 'p' || (vec_id % 5) as period, case when vec_id % 7 = 0 then -1 else label end as cluster, ((vec_id * 37) % 101) / 100.0::double as probability from embeddings)"

_sample = "md5(concat_ws(':', '42', doc_id, paragraph_idx, segment_idx))"


def _section(name: str, which: str, order: str) -> str:
    return f"select '{name}' as section, row_number() over (order by {order})::int as place, {KEYS}, score::int as score, md5(case when length(text) > 300 then left(text, 300) || '...' else text end) as text_md5 from scored where {which} qualify place <= 50"


_sections = " union all ".join(
    _section(*x)
    for x in (
        ("top_scoring", "reason is not null", f"score desc, {KEYS}"),
        ("borderline", "reason is not null and score = 2", KEYS),
        ("rejected_date_only", "not strong and n_key_years > 0", KEYS),
        ("random_retained", "reason is not null", f"{_sample}, {KEYS}"),
        ("random_rejected", "reason is null", f"{_sample}, {KEYS}"),
    )
)


def _cut(x: str, n: int) -> str:
    return f"md5(case when length({x}) > {n} then left({x}, {n}) || '...' else {x} end)"


ORACLE: dict[str, str] = {
    "sample_retained": f"with recursive {SCORED_CTE} select {KEYS}, score::int as score from scored where reason is not null order by {_sample}, {KEYS} limit 50",
    "quality_report": f"with recursive {SCORED_CTE} {_sections}",
    "quality_counts": f"with recursive {SCORED_CTE} select count(reason) as total_retained, count(*) - count(reason) as total_rejected, count(*) filter (where reason is not null and score = 2) as borderline_total, count(*) filter (where not strong and n_key_years > 0) as date_only_total from scored",
    "top_years_rejected": rf"with recursive {SCORED_CTE}, y as (select unnest(list_distinct(regexp_extract_all(regexp_replace(text, '([^\p{{Nd}}])', '\1\1', 'g'), '(?:^|[^\p{{Nd}}])(18\p{{Nd}}{{2}}|19\p{{Nd}}{{2}}|20\p{{Nd}}{{2}})(?:[^\p{{Nd}}]|$)', 1))) as year from scored where reason is null), c as (select year, count(*) as n from y group by year) select row_number() over (order by n desc, year)::int as place, year, n from c qualify place <= 20",
    "duplicate_samples": f"""with recursive {GRAMS_CTE}, log as (select 'exact' as section, period, doc_id as removed_seq, kept_seq, 1.0::double as similarity from first where doc_id <> kept_seq union all select 'fuzzy', period, removed_seq, kept_seq, round(similarity, 3) from best),
      every as (from log union all select 'fuzzy_low', * exclude (section) from log where section = 'fuzzy' and similarity < 0.9),
      placed as (select *, row_number() over (partition by section order by period, removed_seq)::int as place from every),
      named as (select p.*, r.text as rt, k.text as kt, r.form as rf, k.form as kf from placed p join (select d.doc_id, d.text, f.form from documents d join forms f using (doc_id)) r on p.removed_seq = r.doc_id join (select d.doc_id, d.text, f.form from documents d join forms f using (doc_id)) k on p.kept_seq = k.doc_id)
      select section, place, period, removed_seq, kept_seq, similarity, {_cut('rt', 150)} as removed_text, {_cut('kt', 150)} as kept_text, {_cut('rf', 100)} as removed_form, {_cut('kf', 100)} as kept_form
      from named where place <= case section when 'fuzzy_low' then 50 else 100 end""",
    "fuzzy_counters": f"with recursive {GRAMS_CTE} select 0::bigint as n_invalid, count(*) filter (where form = '') as n_empty, count(*) filter (where form <> '' and length(form) < 10) as n_short, count(*) filter (where length(form) >= 10) as n_compared from first where doc_id = kept_seq",
    "embedding_stats": "select 'p' || (vec_id % 5) as period, count(*) as n, max(len(embedding))::int as dim from embeddings group by rollup (1)",
    "normalize_docs": f"with {NORM_CTE} select doc_id, md5(text) as norm_md5, length(text)::int as norm_len from norm",
    "normalize_ocr_repair": f"with lines as (select doc_id, replace(text, chr(10), '') || '§ 12 раздел' as x from documents where text is not null), r as (select doc_id, {repaired('x')} as y from lines) select doc_id, (len(string_split(y, chr(10))) - 1)::int as n_breaks, md5(y) as text_md5 from r",
    "normalization_stats": rf"""with {NORM_CTE} select doc_id, period, length(raw)::int as original_chars, length(text)::int as normalized_chars,
      round(case when length(raw) = 0 then 0 else (length(raw) - length(text)) * 100.0 / length(raw) end::double, 6) as reduction_pct,
      len(string_split(raw, chr(10)))::int as original_lines, len(string_split(text, chr(10)))::int as normalized_lines,
      len(list_filter(string_split(text, chr(10)||chr(10)), lambda p: regexp_matches(p, '[^\t-\r\x1c-\x20\x{{85}}\p{{Z}}]')))::int as paragraphs from norm""",
    "corpus_totals": f"with {NORM_CTE} select sum(length(raw))::bigint as original_chars, sum(length(text))::bigint as normalized_chars from norm",
    "word_counts": f"select doc_id, {words('text')}::int as n_regex, {tokens('text')}::int as n_ws from documents",
    "folder_words": f"select sum({tokens('text')})::bigint as n_words from documents",
    "text_scalars": f"""with f as materialized (select doc_id, text, {form('text')} as form from documents)
      select doc_id, md5(form) as form_md5, case when length(text) > 150 then left(text, 150) || '...' else text end as short, replace(left(text, 150), chr(10), ' ') as line,
      case when length(form) >= 3 then len(list_distinct(list_transform(range(1, length(form) - 1), lambda i: substr(form, i, 3)))) when length(form) > 0 then 1 else 0 end::int as n_grams from f""",
    "paragraphs": f"with {PAR_CTE} select doc_id, paragraph_idx, {words('paragraph')}::int as n_words, md5(paragraph) as text_md5 from par",
    "sentences": f"with {NORM_CTE}, s as (select doc_id, {sentence_list('text')} as ss from norm) select doc_id, unnest(range(len(ss)))::int as sent_idx, unnest(ss) as text from s",
    "segments": f"with recursive {SEG_CTE} select {KEYS}, md5(text) as text_md5, char_count::int as char_count, word_count::int as word_count, sentence_count::int as sentence_count from seg",
    "segmentation_stats": f"with recursive {SEG_CTE} select period, count(*) as n_segments, sum(char_count)::bigint as n_chars, sum(word_count)::bigint as n_words, round(avg(word_count), 6) as avg_words from seg group by rollup (period)",
    "metadata_enrich": "select doc_id, lang, quality, toxic from documents left join labels using (doc_id)",
    "metadata_missing": "select doc_id from documents where doc_id not in (select doc_id from labels)",
    "subcorpora": f"""with m as (select d.lang as period, {tokens('d.text')} as w, case when l.doc_id is null then null when l.quality = 1 and l.toxic = 0 then 'Russie' when l.quality = 1 then 'URSS' else 'c' || l.toxic end as c from documents d left join labels l using (doc_id))
      select period, count(*) as n_docs, sum(w)::bigint as n_words, coalesce(array_to_string(list_sort(list(distinct c) filter (where c is not null)), ', '), '') as countries from m group by period""",
    "lexicon_counts": f"with recursive {SCORED_CTE} select {KEYS}, {', '.join(f'n_{c}::int as n_{c}' for c in PATTERNS)}, n_key_years::int as n_key_years, array_to_string(key_years, ',') as years from scored",
    "lexicon_filter": f"with recursive {SCORED_CTE} select {KEYS}, score::int as score, reason from scored where reason is not null",
    "lexicon_rejected": f"with recursive {SCORED_CTE} select {KEYS}, score::int as score, concat_ws(',', {', '.join(f'case when n_{c} > 0 then {chr(39)}{c}{chr(39)} end' for c in sorted(PATTERNS))}) as matched from scored where reason is null",
    "date_only": f"with recursive {SCORED_CTE} select {KEYS}, least(n_key_years, 3)::int as date_points, least(n_key_years, 3) >= 2 as date_strong, case when n_weak_stalin > 0 then 'date_plus_weak_stalin' else 'date_only_pure' end as date_reason from scored where not strong and n_key_years > 0",
    "filter_retention": f"with recursive {SCORED_CTE} select period, count(*) as n_segments, count(reason) as n_retained, round(count(reason) * 100.0 / count(*), 6) as retention_pct, count(*) filter (where not strong and n_key_years > 0) as n_date_only from scored group by rollup (period)",
    "filter_stats_reason": f"with recursive {SCORED_CTE} select reason, count(*) as n, round(count(*) * 100.0 / sum(count(*)) over (), 6) as pct from scored where reason is not null group by reason",
    "filter_stats_category": f"with recursive {SCORED_CTE} " + " union all ".join(f"select '{c}' as category, count(*) filter (where n_{c} > 0) as n_segments, coalesce(sum(n_{c}), 0)::bigint as n_matches from scored where reason is not null" for c in PATTERNS),
    "filter_stats_bucket": f"with recursive {SCORED_CTE} select (score // 5 * 5) || '-' || (score // 5 * 5 + 4) as bucket, count(*) as n from scored where reason is not null group by 1",
    "filter_stats_years": f"with recursive {SCORED_CTE} select year, count(*) as n, k as kept from (select unnest(key_years) as year, reason is not null as k from scored) group by year, k",
    "top_scoring": f"with recursive {SCORED_CTE} select {KEYS}, score::int as score from scored where reason is not null order by score desc, {KEYS} limit 50",
    "borderline": f"with recursive {SCORED_CTE} select {KEYS}, score::int as score from scored where reason is not null and score = 2 order by {KEYS} limit 50",
    "dedup_exact": f"with f as (select doc_id, lang as period, md5({form('text')}) as h from documents where text is not null) select period, min(doc_id) as doc_id from f group by period, h",
    "dedup_exact_log": f"with f as (select doc_id, lang as period, md5({form('text')}) as h from documents where text is not null), m as (select *, min(doc_id) over (partition by period, h) as kept_seq from f) select period, doc_id as removed_seq, kept_seq from m where doc_id <> kept_seq",
    "similar_pairs": f"with recursive {ALL_GRAMS_CTE} select period, a, b, round(similarity, 6) as similarity from pairs",
    "dedup_fuzzy_log": f"with recursive {GRAMS_CTE} select period, removed_seq, kept_seq, round(similarity, 6) as similarity from best",
    "dedup_fuzzy": f"with recursive {GRAMS_CTE} select doc_id from first where doc_id = kept_seq and doc_id not in (select removed_seq from best)",
    "dedup_stats": f"""with recursive {GRAMS_CTE}, j as (select f.period, f.doc_id, f.doc_id <> f.kept_seq as ex, b.removed_seq is not null as fz from first f left join best b on f.doc_id = b.removed_seq)
      select period, count(*) as n_input, count(*) filter (where ex) as n_exact, count(*) filter (where fz) as n_fuzzy, count(*) filter (where not ex and not fz) as n_output,
      round(count(*) filter (where ex or fz) * 100.0 / count(*), 6) as removed_pct from j group by rollup (period)""",
    "duplicate_report": f"with recursive {GRAMS_CTE} select (select count(*) from first where doc_id <> kept_seq) as n_exact, count(*) as n_fuzzy, count(*) filter (where round(similarity, 3) < 0.9) as n_low from best",
    "l2_normalize": "select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 6) as norm, round(embedding[1]::double / sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 6) as first from embeddings",
    "knn_cosine": "with v as (select vec_id, embedding::double[] as e from embeddings), s as (select q.vec_id as query_id, r.vec_id as id, round(list_cosine_similarity(q.e, r.e), 9) as c from v q join v r on q.vec_id <> r.vec_id where q.vec_id % 50 = 0), k as (select *, row_number() over (partition by query_id order by c desc, id) as place from s) select query_id, id, round(c, 6) as cosine, place::int as place from k where place <= 5",
    "centroid_representatives": "with c as (select label, list(x order by pos) as center from (select label, pos, avg(x) as x from (select label, unnest(embedding)::double as x, unnest(range(len(embedding))) as pos from embeddings where label <> -1) group by all) group by label), d as (select e.label as cluster, vec_id as id, list_distance(e.embedding::double[], c.center) as distance from embeddings e join c using (label)), k as (select *, row_number() over (partition by cluster order by round(distance, 9), id) as place from d) select cluster, id, round(distance, 6) as distance, place::int as place from k where place <= 15",
    "medoid_representatives": "with s as (select label from embeddings where label <> -1 group by label having count(*) <= 200), t as (select a.label as cluster, a.vec_id as id, sum(list_distance(a.embedding::double[], b.embedding::double[])) as total from embeddings a join embeddings b using (label) where a.label in (from s) group by all), k as (select *, row_number() over (partition by cluster order by round(total, 9), id) as place from t) select cluster, id, round(total, 6) as total, place::int as place from k where place <= 15",
    "cluster_sizes": f"with {ROWS} select cluster, count(*) as n from rows where cluster <> -1 group by cluster",
    "cluster_stats": f"with {ROWS} select count(distinct cluster) filter (where cluster <> -1) as n_clusters, count(*) filter (where cluster = -1) as n_noise, count(*) filter (where cluster <> -1) as n_clustered, round(count(*) filter (where cluster = -1) * 100.0 / count(*), 2) as noise_pct from rows",
    "period_totals": f"with {ROWS} select period, count(*) as n from rows group by period",
    "period_distribution": f"with {ROWS} select period, cluster, count(*) as n, round(count(*) * 100.0 / sum(count(*)) over (partition by period), 2) as pct from rows where cluster <> -1 group by period, cluster",
    "dominant_cluster": f"with {ROWS}, p as (select period, cluster, round(count(*) * 100.0 / sum(count(*)) over (partition by period), 2) as pct from rows where cluster <> -1 group by period, cluster) select period, cluster, pct from p qualify row_number() over (partition by period order by pct desc, cluster) = 1",
    "probability_summary": f"with {ROWS} select round(avg(probability), 6) as mean, round(median(probability), 6) as median, min(probability) as min, max(probability) as max, count(*) filter (where probability > 0.8) as n_high, count(*) filter (where probability < 0.5) as n_low from rows where cluster <> -1",
    "probability_representatives": f"with {ROWS} select cluster, idx as id, place::int as place from (select *, row_number() over (partition by cluster order by probability desc, idx) as place from rows where cluster <> -1) where place <= 15",
    "top_clusters": f"with {ROWS} select cluster, count(*) as n from rows where cluster <> -1 group by cluster order by n desc, cluster limit 4",
    "core_points": f"with {ROWS}, k as (select * from rows where cluster <> -1 and coalesce(probability, 0) >= 0.8), t as (select cluster from k group by cluster order by count(*) desc, cluster limit 4) select idx, cluster, 'core' as layer from k where cluster in (from t) union all select idx, cluster, 'noise' from rows where cluster = -1",
    "prob_histogram": f"with {ROWS}, k as (select probability as p, min(probability) over () as lo, max(probability) over () as hi from rows where cluster <> -1) select least(floor((p - lo) / ((hi - lo) / 30)), 29)::int as bin, count(*) as n from k group by 1",
    "heatmap": f"with {ROWS}, k as (select * from rows where cluster <> -1), t as (select cluster from k group by cluster order by count(*) desc, cluster limit 4), g as (select period, cluster, count(k.idx) as n from (select distinct period from k) cross join t left join k using (period, cluster) group by all) select period, cluster, n, round(n * 100.0 / sum(n) over (partition by period), 6) as pct from g",
    "cluster_colors": f"with {ROWS} select cluster, (dense_rank() over (order by cluster) - 1)::int as color from rows where cluster <> -1 group by cluster",
    "corpus_union": "select 'documents' as source, count(*) as n, sum(length(text))::bigint as n_chars from documents union all select 'benchmark', count(*), sum(length(text))::bigint from benchmark union all select 'conversations', count(*), sum(length(text))::bigint from conversations",
}
