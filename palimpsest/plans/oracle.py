"""DuckDB SQL of the registered queries, from the tables alone."""

from __future__ import annotations

_RAW = "regexp_extract_all(lower(text), '[a-z0-9_./:-]+')"


def _stem(t: str) -> str:
    return (
        f"case when length({t}) > 5 and ends_with({t}, 'ing') then left({t}, -3) when length({t}) > 4 and ends_with({t}, 'ed') then left({t}, -2)"
        f" when length({t}) > 4 and ends_with({t}, 'ies') then left({t}, -3) || 'y' when length({t}) > 4 and ends_with({t}, 'es') then left({t}, -2)"
        f" when length({t}) > 3 and ends_with({t}, 's') then left({t}, -1) else {t} end"
    )


_TOKENS = f"flatten(list_transform({_RAW}, lambda r: list_transform(list_concat([r], list_filter(regexp_split_to_array(r, '[./:-]+'), lambda p: p <> '' and p <> r)), lambda t: {_stem('t')})))"
_SPLIT_GOLD = r"list_filter(regexp_split_to_array(lower(regexp_replace(replace(text, '_', ' '), '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda w: w <> '')"


def _bm25(queries: str) -> str:
    """CTEs ending in scores(query, round_file, score) for a queries(query, text) select."""
    return f"""
docs as (select doc_id::varchar round_file, lang, {_TOKENS} t from documents),
stats as (select count(*) n, avg(len(t)) avgdl from docs),
terms as (select distinct query, unnest({_TOKENS}) term from ({queries})),
tf as (select round_file, dl, term, count(*) tf from (select round_file, len(t) dl, unnest(t) term from docs) group by all),
df as (select term, count(*) df from tf group by term),
scores as (select query, round_file, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) score
    from tf join df using (term) join terms using (term), stats group by query, round_file),"""


def _normalized(source: str = "scores") -> str:
    return f"""
scale as (select query, median(score) scale from (select query, score from {source} qualify row_number() over (partition by query order by score desc) <= 10) group by query),
norm as (select query, round_file, 1 / (1 + exp(-score / scale)) normalized from {source} join scale using (query)),"""


_BENCH = "select item_id::varchar query, text from benchmark"
_VEC = """
v as (select vec_id, (vec_id // 2)::varchar round_file, case when vec_id % 2 = 0 then ':prompt' else ':response' end suffix,
    case when label % 3 > 0 then 'm' || (label % 3) end model, embedding::double[] vector, 'index.h' || (vec_id % 3) shard, vec_id pos, label from embeddings),
q as (select vec_id::varchar query, vector, vec_id ts, label from v where vec_id % 100 = 0),"""
_DOT = "list_dot_product(q.vector, v.vector)"


def _top(source: str, k: int, least: str = "true", key: str = "round_file") -> str:
    return f"select *, row_number() over (partition by query order by score desc, {key}) as rank from (select * from {source} where {least}) qualify rank <= {k}"


def _hybrid() -> str:
    return f"""with {_VEC}{_bm25("select q.query, d.text from q join documents d on d.doc_id::varchar = q.query")}{_normalized()}
hit as (select distinct query from norm),
fused as (select q.query, v.round_file, {_DOT} semantic, coalesce(n.normalized, 0) lexical, case when h.query is null then 1.0 else 0.7 end a
    from q cross join v left join norm n on n.query = q.query and n.round_file = v.round_file left join hit h on h.query = q.query),
hybrid as (select query, round_file, round(max(a * semantic + (1 - a) * lexical), 6) score from fused group by query, round_file)"""


_TRUNC = """case when length(text) <= 400 then text else (
    with_head || chr(10) || '… [' || (length(text) - length(with_head) - length(with_tail)) || ' chars elided] …' || chr(10) || with_tail) end"""
_CUTS = """select *, case when h like '%' || chr(10) || '%' and length(h) - strpos(reverse(h), chr(10)) > 0 then left(h, length(h) - strpos(reverse(h), chr(10))) else h end with_head,
    case when strpos(tl, chr(10)) > 0 and strpos(tl, chr(10)) < length(tl) then substr(tl, strpos(tl, chr(10)) + 1) else tl end with_tail
    from (select *, left(text, 260) h, right(text, 140) tl from {})"""

_WS = "[\\s\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]"


def _trim(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^{_WS}+', ''), '{_WS}+$', '')"


_ROUNDS = f"""
m as (select conv_id session, turn pos, role, coalesce(text, '') text, sum((role = 'user')::int) over (partition by conv_id order by turn) r from conversations),
g as (select session, r, {_trim("max(text) filter (role = 'user')")} prompt, max(pos) filter (role = 'user') ts, count(*) n_messages,
    {_trim("coalesce(string_agg(text, chr(10) || chr(10) order by pos) filter (role = 'assistant' and text <> ''), '')")} response from m where r > 0 group by session, r),
rounds as (select session, row_number() over (partition by session order by r) - 1 turn_index, md5(prompt || response) || '.json' round_file, prompt, response, ts, n_messages from g)"""
_EVENTS = "e as (select 'e' || event_id round_file, event_id, user_id, epoch_us(ts) ts, event_type, value, props from events)"
_RATED = f"""with {_VEC}
near as (select q.query, v.vec_id::varchar round_file, {_DOT} score from q join v on v.vec_id < q.ts),
ranked as (select *, row_number() over (partition by query order by score desc, round_file) as rank from near qualify rank <= 5),
lab as (select q.query, v.vec_id::varchar label from q join v on v.vec_id < q.ts and v.label = q.label),
per as (select l.query, count(*) n_labels, (count(r.rank) > 0)::int hit, count(r.rank) / count(*) recall, coalesce(1 / min(r.rank), 0) mrr, min(r.rank) first_hit_rank
    from lab l left join ranked r on r.query = l.query and r.round_file = l.label group by l.query)"""
_DOUBLED = f"with {_VEC} x as (select vec_id, round_file, suffix, model, shard, pos from v union all select vec_id, round_file, suffix, model, 'index.a', pos from v where vec_id % 5 = 0)"


def _words(c: str) -> str:
    return f"len(list_filter(regexp_split_to_array({c}, '{_WS}+'), lambda w: w <> ''))"


_COVER = f"""with {_VEC}
r as (select distinct v.round_file, {_words("coalesce(d.text, '')")} < 20 short from v left join documents d on d.doc_id::varchar = v.round_file),
f as (select v.* from v join r using (round_file) where not (short and suffix = ':prompt'))"""


def _coverage(model: str, source: str = "f") -> str:
    return f"""by_suffix as (select round_file, suffix, bool_or(coalesce(model, '{model}') = '{model}') c, bool_or(coalesce(model, '{model}') <> '{model}') s from {source} group by all),
cov as (select round_file, true has_row, bool_or(s) has_stale, bool_and(c) covered from by_suffix group by round_file)"""


_DUPES = f"""with rec as (select md5({_trim("coalesce(text, '')")}) k, doc_id::varchar filename, doc_id % 2 = 1 recovered, doc_id mtime from documents),
keep as (select k, arg_min(filename, (recovered, mtime, filename)) keeper from rec group by k having count(*) > 1),
plan as (select keeper, filename from rec join keep using (k) where filename <> keeper and recovered and mtime >= 0)"""
_MARKED = f"""with {_ROUNDS},
own as (select round_file, prompt, response, turn_index from rounds qualify row_number() over (partition by round_file order by session, turn_index) = 1),
kept as (select round_file, turn_index = 0 flag from own where turn_index <> 2)"""
_TOOLS = "t as (select 'u' || user_id round_file, event_type tool_name, lower(event_type || ' ' || event_type || ' User ' || user_id) searchable from events)"
_CHAIN = f"""with recursive {_EVENTS},
p as (select round_file, lag(round_file) over (partition by user_id order by ts, event_id) parent, value from e),
walk as (select round_file target, 0 depth, round_file, parent, value from p
    union all select w.target, w.depth + 1, p.round_file, p.parent, p.value from walk w join p on p.round_file = w.parent)"""
_POS = f"""with {_EVENTS}, x as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as position from e qualify position <= 5),
p as (select position, count(*) presented, count(*) filter (value > 10) read from x group by position)"""
_TOPK = f"with {_VEC} s as (select q.query, v.vec_id, round({_DOT}, 6) score from q cross join v), topk as ({_top('s', 12, key='vec_id')})"
_LEX = f"""qw as (select item_id::varchar query, unnest(list_distinct({_SPLIT_GOLD})) w from benchmark),
dw as (select doc_id::varchar round_file, unnest(list_distinct({_SPLIT_GOLD})) w from documents),
lex as (select *, row_number() over (partition by query order by score desc, round_file) as rank from (select query, round_file, count(*) score from qw join dw using (w) group by all) qualify rank <= 12)"""

_SIZE = r"case when {0} < 1024 then regexp_replace(printf('%.2f', floor({0} / 1024 * 100 + 0.5) / 100), '\.?0+$', '') || 'KB' else floor({0} / 1024 + 0.5)::bigint || 'KB' end"

ORACLE: dict[str, str] = {
    "bm25_tokens": f"select doc_id, len(t) n_tokens, len(list_distinct(t)) n_terms, md5(array_to_string(t, ' ')) digest from (select doc_id, {_TOKENS} t from documents)",
    "bm25_term_freq": f"select term, sum(tf)::bigint tf, count(*) df, max(tf) most from (select doc_id, term, count(*) tf from (select doc_id, unnest({_TOKENS}) term from documents) group by all) group by term",
    "lexical_growth": f"""select term, sum(tf)::bigint tf, count(*) df, max(tf) most, any_value(turns) turns, any_value(n) n, any_value(avgdl) avgdl
        from (select doc_id, term, count(*) tf from (select doc_id, unnest({_TOKENS}) term from documents) group by all),
            (select 3::bigint turns, count(*) n, round(avg(len({_TOKENS})), 6) avgdl from documents) group by term""",
    "bm25_doc_stats": f"select count(*) n, round(avg(len({_TOKENS})), 6) avgdl from documents",
    "bm25_score": f"with {_bm25(_BENCH)[:-1]} select query, round_file, round(score, 6) score from scores",
    "bm25_score_unstored": f"with {_bm25(_BENCH)[:-1]} select query, round_file, round(score, 6) score from scores",
    "lexical_freshness": f"""select state, state = 'same' fresh, n, tokens from (values ('unwritten'), ('same'), ('added'), ('removed')) s(state),
        (select count(*) + 1 n, sum(len({_TOKENS}))::bigint + 3 tokens from documents)""",
    "bm25_normalized": f"with {_bm25(_BENCH)}{_normalized()[:-1]} select query, round_file, round(normalized, 6) normalized from norm",
    "text_match_top5": f"with {_bm25(_BENCH)}{_normalized()} x as (select query, round_file, round(normalized, 6) score from norm) {_top('x', 5, 'score >= 0.25')}",
    "text_match_scoped": f"with {_bm25(_BENCH)} scoped as (select s.* from scores s join docs d using (round_file) where d.lang = 'de'),{_normalized('scoped')} x as (select query, round_file, round(normalized, 6) score from norm) {_top('x', 5, 'score >= 0.25')}",
    "golden_token_counts": f"select doc_id, len(t) n_tokens, md5(array_to_string(t, ' ')) digest from (select doc_id, {_SPLIT_GOLD} t from documents)",
    "lexical_overlap": f"with {_LEX} select query, round_file, score, rank from lex",
    "topic_grouping": f"""with recursive {_VEC[:-1]},
        turns as (select label session, vec_id pos, vector v, row_number() over (partition by label order by vec_id) n from v),
        walk as (
            select session, pos, n, [v] topics, [1] sizes, 0 topic from turns where n = 1
            union all
            select session, pos, n, case when topic < len(topics) then list_transform(topics, lambda c, i: case when i = topic + 1 then list_transform(c, lambda x, j: x + (v[j] - x) / (sizes[i] + 1)) else c end)
                else list_append(topics, v) end,
                case when topic < len(topics) then list_transform(sizes, lambda c, i: case when i = topic + 1 then c + 1 else c end) else list_append(sizes, 1) end, topic
            from (select *, case when list_max(near) >= 0.3 then list_position(near, list_max(near)) - 1 else len(topics)::int end::int topic
                from (select w.session, t.pos, t.n, t.v, w.topics, w.sizes, list_transform(w.topics, lambda c: list_dot_product(c, t.v)) near
                    from walk w join turns t on t.session = w.session and t.n = w.n + 1)))
        select session, pos, topic from walk""",
    "vector_normalize": """select vec_id, round(sqrt(list_dot_product(v, v)), 6) norm, round(v[1], 6) as first from (
        select vec_id, list_transform(w, lambda x: case when m = 0 then x else x / m end) v from (select vec_id, w, sqrt(list_dot_product(w, w)) m from (select vec_id, list_transform(embedding::double[], lambda x: x * label) w from embeddings)))""",
    "vector_topk": f"{_TOPK} select query, vec_id, score, rank from topk",
    "vector_best_per_round": f"with {_VEC[:-1]} select query, round_file, round(max({_DOT}), 6) score from q cross join v group by query, v.round_file",
    "multi_model_search": f"""with {_VEC} mq as (select query, 'base' model, vector from q union all select query, 'm1', list_reverse(vector) from q),
        x as (select query, round_file, round(max(list_dot_product(mq.vector, v.vector)), 6) score from mq join v on coalesce(v.model, 'base') = mq.model group by query, round_file) {_top('x', 5, 'score >= 0.25')}""",
    "hybrid_search": f"{_hybrid()} {_top('hybrid', 5, 'score >= 0.25')}",
    "hybrid_no_lexical": f"with {_VEC} x as (select query, round_file, round(max({_DOT}), 6) score from q cross join v group by query, v.round_file) {_top('x', 5)}",
    "context_budget": """select vec_id, floor(2000 + greatest(0.0, least(1.0, (b - 0.3) / 0.7)) * (10240 - 2000))::bigint budget, floor(2000 + greatest(0.0, least(1.0, (b - 0.3) / 0.7)) * (2000 - 2000))::bigint small_window
        from (select vec_id, abs(embedding[1]::double * 3) b from embeddings)""",
    "context_select": f"""{_hybrid()}, ranked as ({_top('hybrid', 20)}),
        best as (select query, floor(2000 + greatest(0.0, least(1.0, (max(score) - 0.3) / 0.7)) * (2400 - 2000)) / 4 budget from ranked group by query),
        x as (select r.*, coalesce(d.text, '') as text, b.budget from ranked r join best b using (query) left join documents d on d.doc_id::varchar = r.round_file),
        y as ({_CUTS.format('x')}),
        c as (select *, ceil(length(rank || '. ' || round_file || ' [0.50 | 0 tools]:' || chr(10) || '  user: ' || replace({_TRUNC}, chr(10), chr(10) || '  ') || chr(10) || '  ---') / 4)::bigint as cost from y where score >= 0.05),
        u as (select *, sum(cost) over (partition by query order by rank) used from c)
        select query, round_file, rank, cost, used::bigint used from u where used <= budget""",
    "recency_list_select": f"""with {_EVENTS}, i as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as idx from e qualify idx <= 20),
        f as (select *, row_number() over (partition by user_id, event_type order by idx) = 1 lead from i),
        g as (select *, sum(lead::int) over (partition by user_id order by idx) seen from f),
        h as (select *, max(case when lead then seen end) over (partition by user_id, event_type) group_no, sum(ceil(value) + case when lead then 5 else 0 end) over (partition by user_id order by idx) + 20 used from g)
        select user_id session, event_id, idx as index, group_no::bigint group_no, used::bigint used from h where idx = 1 or used <= 200""",
    "prompt_truncate": f"select doc_id, length(t) n, md5(t) digest, ceil(length(t) / 4)::bigint tokens from (select doc_id, {_TRUNC} t from ({_CUTS.format('documents')}))",
    "sessionize_rounds": f"with {_ROUNDS} select session, turn_index, round_file, length(prompt) prompt_chars, length(response) response_chars, n_messages, false \"needsFollowup\" from rounds",
    "round_content_hash": f"with {_ROUNDS} select round_file, md5('{{\"p\":' || to_json(prompt) || ',\"r\":' || to_json(response) || ',\"t\":[]}}') key_digest from rounds",
    "round_parent_lag": f"with {_ROUNDS} select session, turn_index, lag(round_file) over (partition by session order by turn_index) \"parentId\" from rounds",
    "response_end_lead": f"with {_ROUNDS} select session, turn_index, ts \"userTimestamp\", lead(ts) over (partition by session order by turn_index) \"responseEndTimestamp\" from rounds",
    "prompt_only_rounds": f"with {_ROUNDS} select session, turn_index, round_file from rounds where response = ''",
    "related_parent": f"with {_EVENTS} select event_id, lag(round_file) over (partition by user_id, event_type order by ts, event_id) \"relatedParentId\" from e",
    "word_count_short": f"select doc_id, {_words('text')} words, {_words('text')} < 20 short, md5(array_to_string(list_slice(string_split(text, ' '), 1, 200), ' ')) first_words from documents",
    "tool_index_rows": f"with {_TOOLS} select round_file, tool_name, lower(searchable) searchable, count(*) n from t group by all",
    "tool_search": f"""with {_TOOLS}, k as (select * from (values ('a', 'click', 3), ('a', 'user', 3), ('a', 'error', 3), ('b', 'view', 3), ('b', 'purchase', 3)) k(query, keyword, total))
        select query, round_file, count(distinct keyword) matched, total::bigint total, round(count(distinct keyword) / total, 6) score, array_to_string(list_sort(list_distinct(list(tool_name))), ',') tools
        from t join k on contains(searchable, keyword) group by query, round_file, total""",
    "tool_summary": f"""with {_EVENTS}, n as (select user_id, event_type, count(*) c, sum(strlen(props)) b, min((ts, event_id)) f from e group by all)
        select user_id, sum(c)::bigint || ' tools (' || string_agg(event_type || '×' || c || ' (' || {_SIZE.format('b')} || ')', ', ' order by f) || ')' summary from n group by user_id""",
    "asof_candidates": f"with {_EVENTS} select a.round_file query, count(*) n from e a join e b on a.user_id = b.user_id and b.ts < a.ts group by a.round_file",
    "eval_hit_recall_mrr": f"{_RATED} select query, n_labels, hit, round(recall, 6) recall, round(mrr, 6) mrr, first_hit_rank from per",
    "eval_macro": f"{_RATED} select count(n_labels) query_count, count(*) filter (n_labels is null) empty_label_count, round(avg(hit), 6) hit_at_5, round(avg(recall), 6) recall_at_5, round(avg(mrr), 6) mrr from q left join per using (query)",
    "eval_golden": f"""{_RATED}, pick as (select l.query, case when q.label % 2 = 0 then arg_max(l.label, l.label::bigint) else arg_min(l.label, l.label::bigint) end main, case when q.label % 3 = 0 then 'similarity' else 'hybrid' end as mode from lab l join q using (query) group by l.query, q.label),
        one as (select p.query, p.mode, coalesce(1 / r.rank, 0) rr from pick p left join ranked r on r.query = p.query and r.round_file = p.main)
        select mode, count(*) query_count, round(avg(hit), 6) hit_at_5, round(avg(recall), 6) recall_at_5, round(avg(rr), 6) mrr from one join per using (query) group by mode""",
    "eval_skip_counts": f"""with r as (select case when {_words('text')} < 20 then 's' when doc_id % 2 <> 0 then 'e' when lang <> 'en' then 't' when l.doc_id is null then 'l' else '' end r from documents d left join labels l using (doc_id))
        select count(*) total_rounds, count(*) filter (r in ('', 'l')) replayed, count(*) filter (r = 's') skipped_short, count(*) filter (r = 'e') skipped_no_embedding, count(*) filter (r = 't') skipped_no_timestamp, count(*) filter (r = 'l') skipped_no_labels from r""".replace("documents d left join labels l using (doc_id)", "(select * from documents) d left join labels l on d.doc_id = l.doc_id").replace("when doc_id %", "when d.doc_id %"),
    "noise_rate": f"{_POS} select round(1 - sum(read) / sum(presented), 6) noise_rate from p",
    "chain_read_positions": f"{_POS} select position, presented \"presentedCount\", read \"readCount\", floor(100 * read / presented + 0.5)::bigint percent from p",
    "stats_upgrade": "select 2 as version, presented, read, count(*) n from (select case when c_custkey % 7 = 0 then 0 else floor(abs(c_acctbal))::bigint end presented, case when c_custkey % 7 = 0 then 0 else 2 end::bigint read from customer) group by all",
    "difficulty_classify": r"""select page_id, p is_path, case when p then 'hard' when page_id % 5 in (1, 2) then 'control' when page_id % 5 = 0 then 'miss' else 'hard' end difficulty from (
        select page_id, regexp_matches('see ' || regexp_extract(url, '^[a-z]+://[^/]*/?([^?#]*)', 1), '(?:^|\s)(?:[./~]?[-\w]+/[-\w./]+|[-\w]+\.[A-Za-z0-9]{1,10})(?:\s|$)') p from pages)""",
    "round_robin_pool": f"""{_TOPK}, {_LEX}, ch as (select query, 1 channel, rank, vec_id::varchar round_file from topk union all select query, 2, rank, round_file from lex
            union all select query, 3, unnest([1, 2, 3]), unnest([query::bigint + 1, query::bigint + 2, query::bigint + 3])::varchar from q),
        n as (select *, row_number() over (partition by query, round_file order by rank, channel) = 1 fresh from ch),
        stop as (select query, min(rank) stop from (select query, rank, bool_or(fresh) anew from n group by all) where not anew group by query)
        select query, round_file, row_number() over (partition by query order by rank, channel) as position from n left join stop using (query) where fresh and (stop is null or rank < stop) qualify position <= 20""",
    "shard_merge_dedupe": f"{_DOUBLED} select vec_id, round_file, suffix, model, shard from x qualify row_number() over (partition by round_file, suffix, model order by shard, pos) = 1",
    "shard_corrupt_skip": f"""with {_VEC} h as (select *, rtrim(translate(to_base64(unhex(sha256(vec_id::varchar))), '+/', '-_'), '=') stamp from v)
        select vec_id, label <> 7 ok, case when label <> 7 then round_file || '.json' end round_file, case when label <> 7 then suffix end suffix,
        case when label = 7 then null when suffix = ':prompt' then coalesce(model, 'base') else model end model, case when label <> 7 and suffix = ':prompt' then stamp end input_hash, case when label <> 7 then round(vector[1], 6) end as first from h""",
    "shard_summary": f"{_DOUBLED} select shard, count(*) n_rows, count(distinct round_file) n_rounds, md5(array_to_string(list_sort(list_distinct(list(round_file))), ',')) digest from x where shard <> 'index.h1' group by shard",
    "shard_names": """select name, starts_with(name, 'index.') and not starts_with(name, 'index.bm25.') and not ends_with(name, '.lock') and name not like '%.tmp.%' and not regexp_matches(name, '\\.bak\\.')
        or (starts_with(name, 'index.bm25.') and (name not like '%.json' ) and not ends_with(name, '.lock') and name not like '%.tmp.%' and not regexp_matches(name, '\\.bak\\.')) is_shard
        from (select unnest(['index.', 'index.bm25.', 'index-tools.', 'other.']) h, n from (select lower(translate(n_name, ' #', '__')) n from nation)) a, (select unnest(['', '.lock', '.tmp.1', '.bak.2', '.json', '.fulltext.csv']) t) b, lateral (select h || n || t as name)""",
    "coverage_classify": f"{_COVER}, {_coverage('m1')} select r.round_file, coalesce(has_row, false) has_row, coalesce(has_stale, false) has_stale, coalesce(covered, false) covered from r left join cov using (round_file)",
    "own_shard_stale": f"{_COVER}, own as (select * from f where shard = 'index.h1'), {_coverage('m2', 'own')} select round_file from cov where not covered",
    "pending_plan": f"{_COVER}, {_coverage('m1')} select count(*) filter (not coalesce(covered, false)) pending, count(*) filter (not coalesce(covered, false)) > 10 deferred from r left join cov using (round_file)",
    "erase_short": f"{_COVER} select vec_id from v join r using (round_file) where not short",
    "orphan_union": f"with {_VEC[:-1]} select round_file, suffix, case when suffix = ':prompt' then 'new' else model end model from v",
    "indexed_anti_join": "select doc_id from documents where doc_id not in (select vec_id // 2 from embeddings)",
    "bag_except": f"with {_VEC[:-1]} select round_file, suffix from v where vec_id % 5 = 0",
    "duplicate_keeper": f"{_DUPES} select * from plan",
    "foreign_guard": f"{_DUPES} select keeper, filename from plan where filename not in (select (vec_id // 2)::varchar from embeddings where vec_id % 3 <> 1)",
    "marker_twin": f"{_MARKED} select 'm' || o.round_file round_file, o.round_file twin, case when k.flag is null then 'twin-missing' when k.flag then 'duplicate' else 'twin-not-followup' end outcome from own o left join kept k using (round_file)",
    "stale_content": f"{_MARKED} select round_file target, 'm' || round_file files from own",
    "hash_migration": f"{_MARKED} select 'm' || o.round_file round_file, o.round_file target, case when k.round_file is null then 'rename' else 'delete' end as action from own o left join kept k using (round_file)",
    "input_stamps": """select doc_id::varchar round_file, case when doc_id % 2 = 0 then case when doc_id % 3 < 2 then 'current' else 'hash-mismatch' end else case when doc_id % 3 = 0 then 'current' else 'legacy' end end reason,
        rtrim(translate(to_base64(unhex(sha256(text))), '+/', '-_'), '=') current_hash from documents""",
    "working_memory": f"with {_EVENTS} select user_id session, row_number() over (partition by user_id order by ts, event_id) id, event_id from e qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 7",
    "parent_chain_recursive": f"{_CHAIN} select target, depth::bigint depth, round_file from walk",
    "origin_posterior": f"""{_CHAIN}, f as (select target, depth, round_file, least(1.0, value / 100) f, coalesce(product(1 - least(1.0, value / 100)) over (partition by target order by depth desc rows between unbounded preceding and 1 preceding), 1) clean from walk),
        og as (select target, depth, round_file, f * clean p, clean * (1 - f) after from f), o as (select target, arg_min(after, depth) outside, arg_min(p, depth) p_last, arg_max(round_file, (p, depth)) best, max(p) most, sum(case when p > 0 then p * ln(p) else 0 end) e from og group by target)
        select target, round(outside, 6) p_outside, round(-(e + case when outside > 0 then outside * ln(outside) else 0 end), 6) entropy, case when outside > most then 'outside_chain' else best end as top, round(p_last, 6) p_last from o""",
    "flag_rule": "select event_id, value / 10 >= 3 or (event_id % 10) / 10 >= 0.7 flagged from events",
    "fault_bins": """select case when event_id % 11 = 0 then event_type when event_id % 5 = 0 then 'no-fault-within-round' when event_id % 5 = 1 then 'external' when event_id % 5 = 3 and event_id % 2 = 0 then event_type else 'ambiguous' end bin,
        case when value >= 10 then 'x' else 'y' end best, count(*) n from events group by all""",
    "envelope_extract": f"select conv_id session, true was_envelope, md5(arg_max({_trim('text')}, turn)) digest from conversations where role = 'user' and {_trim('text')} <> '' group by conv_id",
    "excerpts": f"""select doc_id, case when length(f) <= 250 then f else {_trim('left(f, 249)')} || '…' end excerpt, {_SIZE.format('strlen(text)')} size from (select doc_id, text, {_trim(f"regexp_replace(text, '{_WS}+', ' ', 'g')")} f from documents)""",
    "detail_page": "select doc_id, md5(case when n <= 2 then '(empty)' else array_to_string(l[3:6], chr(10)) end) digest, 3::bigint first_line, least(n, 6) last_line, n total_lines, case when n > 6 then 7::bigint end next_line from (select doc_id, string_split(text, chr(10)) l, len(string_split(text, chr(10))) n from documents)",
    "detail_regex_match": """with l as (select doc_id, string_split(text, chr(10)) l from documents), x as (select doc_id, l, unnest(l) line, unnest(range(1, len(l) + 1)) line_no from l),
        h as (select doc_id, line_no, array_to_string(l[line_no:line_no + 1], chr(10)) c, row_number() over (partition by doc_id order by line_no) match_no, count(*) over (partition by doc_id) total from x where regexp_matches(line, '[Tt]h[aeiou]n'))
        select doc_id, match_no, line_no, md5(c) digest, least(total, 3) shown, total from h where match_no <= 3""",
    "message_sizes": "select session, tokens, case when tokens / 400 >= 1 then 3 when tokens / 400 >= 0.85 then 2 when tokens / 400 >= 0.7 then 1 else 0 end::bigint as level from (select conv_id session, sum(ceil(length(text) / 4))::bigint tokens from conversations where role <> 'system' group by conv_id)",
    "segment_rebuild": f"""with {_ROUNDS} select distinct round_file, (response <> '')::bigint + case when turn_index % 2 = 1 then 2 else 0 end n,
        md5(case when response = '' and turn_index % 2 = 0 then '' else concat_ws(chr(10), nullif(response, ''), case when turn_index % 2 = 1 then '[Tool call REDACTED: use get_tool_details("' || round_file || '", 0) to expand]' || chr(10) || '[Tool call REDACTED: use get_tool_details("' || round_file || '", 1) to expand]' end) end) digest from rounds""",
    "session_stream_backfill": f"with {_ROUNDS} select session, turn_index, round_file, prompt \"userPrompt\", response \"responseSequence\", false \"needsFollowup\", n_messages from rounds qualify lead(ts) over (partition by session order by turn_index) is not null",
}
