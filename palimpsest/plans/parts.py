"""Queries of single parts: text expressions, parsing of logs, bookkeeping. Each stands beside the SQL that it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.functions.noise import prompt_input
from palimpsest.operators import evaluate, golden, maintain, search, sessions
from palimpsest.plans import catalog as C
from palimpsest.plans.oracle import _EVENTS, _ROUNDS, _VEC, _WS, _trim
from palimpsest.plans.oracle import ORACLE as WHOLE
from palimpsest.sources import logs, shards
from palimpsest.sources import rounds as stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return register


def _long(c):
    return X.col(c).cast("long")


def _rounds(s, d):
    return sessions.rounds_of(C.messages(s, d), "session", "pos")


# -- text ------------------------------------------------------------------


@query("select conv_id session, coalesce(sum(ceil(length(text) / 4)) filter (role <> 'system'), 0)::bigint tokens from conversations group by conv_id")
def message_block_tokens(s, d):
    """Blocks of a session's messages; those of the system are blocks without text."""
    block = F.struct(F.col("role").alias("type"), F.when(F.col("role") != "system", F.col("text")).alias("text"))
    return C.messages(s, d).groupBy("session").agg(F.collect_list(block).alias("b")).select("session", X.message_tokens("b").alias("tokens"))


@query(f"""with {_ROUNDS} select distinct round_file, md5(concat_ws(chr(10) || chr(10), nullif(prompt, ''), nullif(response, ''),
    case when turn_index % 2 = 1 then concat_ws(chr(10), 'Read', 'Bash', 'Read', '{{"p": 1}}', 'sum', 'full', 'Bash', '', '', '') end)) digest from rounds""")
def round_search_text(s, d):
    """What the lexical index holds of rounds, of which every other one has two calls."""
    call = lambda *v: F.struct(*[F.lit(x).cast("string").alias(n) for n, x in zip(("name", "arguments", "result_summary", "result_full"), v)])
    calls = F.when(F.col("turn_index") % 2 == 1, F.array(call("Read", '{"p": 1}', "sum", "full"), call("Bash", None, None, None)))
    names = F.when(F.col("turn_index") % 2 == 1, F.array(F.lit("Read"), F.lit("Bash")))
    r = _rounds(s, d).withColumn("calls", calls).withColumn("names", names)
    return r.select("round_file", F.md5(X.round_text("userPrompt", "responseSequence", "names", "calls")).alias("digest")).distinct()


@query("""select conv_id session, md5(coalesce(string_agg(case role when 'user' then text when 'assistant' then '[thinking] ' || text || ' [/thinking]' end, ' ' order by turn) filter (role in ('user', 'assistant') and text <> ''), '')) digest
    from conversations group by conv_id""")
def message_blocks_text(s, d):
    """Each session as blocks: the user's words are text, the assistant's thinking, the rest neither."""
    kind = F.when(F.col("role") == "user", "text").when(F.col("role") == "assistant", "thinking").otherwise("other")
    m = C.messages(s, d).groupBy("session").agg(F.array_sort(F.collect_list(F.struct("pos", kind.alias("type"), "text"))).alias("b"))
    return m.select("session", F.md5(X.blocks_text("b")).alias("digest"))


@query("select doc_id, md5(case when doc_id % 2 = 0 then text else 'x Environment:' || chr(10) || text end) digest from documents")
def preamble_strip(s, d):
    """A prefix goes only where the text begins with exactly it."""
    t = F.concat(F.when(F.col("doc_id") % 2 == 0, "Environment:\n").otherwise("x Environment:\n"), "text")
    return C.documents(s, d).select("doc_id", F.md5(X.strip_prefix(t, "Environment:\n")).alias("digest"))


@query("""select r_regionkey, 'Current Task: ' || r_name || coalesce(chr(10) || 'Progress Made:' || chr(10) || '- ' || string_agg(n_name, chr(10) || '- ' order by n_name) filter (n_nationkey % 2 = 0), '')
    || chr(10) || 'Key Findings / Decisions:' || chr(10) || '- ' || r_name as text from region join nation on n_regionkey = r_regionkey group by r_regionkey, r_name""")
def checkpoint_render(s, d):
    """Regions as checkpoints: nations of even keys are progress, nothing is next."""
    none = F.array().cast("array<string>")
    n = C.table(s, d, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list(F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")))).alias("p"))
    x = C.table(s, d, "region").join(n, "r_regionkey")
    summary = F.struct(F.col("r_name").alias("currentTask"), F.col("p").alias("progressMade"), none.alias("currentState"), none.alias("nextSteps"), F.array("r_name").alias("keyFindings"))
    return x.select("r_regionkey", X.checkpoint_text(summary).alias("text"))


@query(f"with {_EVENTS} select user_id, arg_max(event_type, (ts, event_id)) filter (value > 5) task, coalesce(max(1) filter (value > 5), 0)::bigint n from e group by user_id")
def checkpoint_last_accepted(s, d):
    """Events as checkpoint calls of their user, accepted from a value over 5."""
    e = C.event_rounds(s, d)
    arguments = F.to_json(F.struct(F.col("event_type").alias("currentTask"), F.array(F.lit("p")).alias("progressMade")))
    call = F.struct("ts", "event_id", F.lit("make_checkpoint").alias("name"), arguments.alias("arguments"), F.when(F.col("value") > 5, "Checkpoint recorded.").otherwise("rejected").alias("result_summary"))
    x = e.groupBy("user_id").agg(F.array_sort(F.collect_list(call)).alias("calls")).withColumn("c", X.checkpoint_of_calls("calls"))
    return x.select("user_id", F.col("c.currentTask").alias("task"), _long(F.coalesce(F.size("c.progressMade"), F.lit(0))).alias("n"))


@query("select event_id, case when event_id % 5 < 2 then 'e' || event_id || '.json' end as round from events")
def expanded_rounds(s, d):
    """The round that arguments name, as a list's first element or under its key; other values and broken JSON name none."""
    file = F.concat(F.lit('"e'), F.col("event_id").cast("string"), F.lit('.json"'))
    forms = [F.concat(F.lit("["), file, F.lit(", 1]")), F.concat(F.lit('{"round": '), file, F.lit("}")), F.lit("[5]"), F.lit('{"round": {"a": 1}}'), F.lit("{")]
    a = F.get(F.array(*forms), (F.col("event_id") % 5).cast("int"))
    return C.event_rounds(s, d).select("event_id", X.expanded_round(a).alias("round"))


@query("select event_id, case when event_id % 2 = 0 then '{\"a\": {\"b\": ' || event_id || '}}' end as json from events")
def loose_json_parts(s, d):
    t = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('so } {"a": {"b": '), F.col("event_id").cast("string"), F.lit("}} then"))).otherwise("} none {")
    return C.event_rounds(s, d).select("event_id", X.loose_json(F.regexp_replace(t, "^so } ", "so ")).alias("json"))


@query("""select doc_id, md5(left('USER PROMPT:' || chr(10) || text || chr(10) || chr(10) || 'ASSISTANT RESPONSE:' || chr(10) || lang || case when doc_id % 3 > 0 then chr(10) || '[' || (doc_id % 3) || ' tool calls in the response were redacted]' else '' end, 700)) digest from documents""")
def judge_states(s, d):
    return C.documents(s, d).select("doc_id", F.md5(X.fault_state("text", "lang", F.col("doc_id") % 3, 700)).alias("digest"))


@query("select doc_id, contains(text, 'RECENCY LIST') or contains(text, 'ab') signal from documents")
def session_signals(s, d):
    return C.documents(s, d).select("doc_id", X.has_signal("text", ("RECENCY LIST", "ab")).alias("signal"))


_CLIP = r"(select doc_id, regexp_replace(text, '\[(?:Tool call )?REDACTED[^\]]*\]\n?', '', 'g') b from documents)"


@query(f"""with x as (select doc_id, b, hex(encode(b)) h from {_CLIP}),
    y as (select *, case when substr(h, 4001, 1) not in ('8', '9', 'A', 'B') then 0 when substr(h, 3999, 1) not in ('8', '9', 'A', 'B') then 1 when substr(h, 3997, 1) not in ('8', '9', 'A', 'B') then 2 else 3 end back from x),
    z as (select doc_id, case when strlen(b) <= 2000 then b else decode(unhex(substr(h, 1, 2 * (2000 - back)))) end t from y)
    select doc_id, strlen(t) n_bytes, md5(t) digest from z""")
def response_clip(s, d):
    """Texts as embedding inputs of at most 2000 bytes; of a character that the limit cuts, nothing is left."""
    t = C.documents(s, d).select("doc_id", X.response_input("text", 2000).alias("t"))
    return t.select("doc_id", _long(F.octet_length("t")).alias("n_bytes"), F.md5("t").alias("digest"))


@query("""select doc_id, kind, case
    when kind = 'fence' and 5 * n > 600 then 'a [CODE_BLOCK: ~' || 5 * n || ' chars, py, first line: "line", last line: "line"] b'
    when kind = 'fence' then 'a ' || chr(10) || '```py' || chr(10) || repeat('line' || chr(10), n) || '```' || chr(10) || ' b'
    when kind = 'json' and 3 * n + 9 > 600 then 'a [JSON_DUMP: ~' || 3 * n + 9 || ' chars] b' when kind = 'json' then 'a {"k": "' || repeat('ab ', n) || '"} b'
    when kind = 'repeat' and n > 200 then 'a [REPEAT: ''z'' × ' || n || '] b' when kind = 'repeat' then 'a ' || repeat('z', n) || ' b'
    when 2 * n > 200 then 'a [LONG_TOKEN: ~' || 2 * n || ' chars] b' else 'a ' || repeat('xy', n) || ' b' end as cleaned
    from (select doc_id, (doc_id % 317)::int n, unnest(['fence', 'json', 'repeat', 'token']) kind from documents)""".replace("'a [CODE_BLOCK", "'a ' || chr(10) || '[CODE_BLOCK").replace("last line: \"line\"] b'", "last line: \"line\"]' || chr(10) || ' b'"))
def noise_kinds(s, d):
    """Each kind of noise in sizes around its limit, between words that stay."""
    n = (F.col("doc_id") % 317).cast("int")
    put = lambda k, t: F.struct(F.lit(k).alias("kind"), F.concat(F.lit("a "), t, F.lit(" b")).alias("text"))
    kinds = [
        put("fence", F.concat(F.lit("\n```py\n"), F.repeat(F.lit("line\n"), n), F.lit("```\n"))),
        put("json", F.concat(F.lit('{"k": "'), F.repeat(F.lit("ab "), n), F.lit('"}'))),
        put("repeat", F.repeat(F.lit("z"), n)),
        put("token", F.repeat(F.lit("xy"), n)),
    ]
    x = C.documents(s, d).select("doc_id", F.explode(F.array(*kinds)).alias("k")).select("doc_id", "k.*")
    return x.select("doc_id", "kind", prompt_input(F.col("text")).alias("cleaned"))


# -- logs ------------------------------------------------------------------


def _lines(s, d, *made):
    """Each session's log: the JSON lines that `made` gives for its messages, in order."""
    lines = F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.array_compact(F.array(*made)).alias("l")))), lambda x: x["l"])), "\n")
    return C.messages(s, d).withColumn("text", F.coalesce("text", F.lit(""))).groupBy("session").agg(lines.alias("content")).select(F.col("session").cast("string").alias("path"), "content")


@query(f"""with {_ROUNDS},
    named as (select session, r, 'T' || (pos % 2) name, min(pos) first, count(*) n, string_agg('r' || pos, ',' order by pos) results from m where r > 0 and role = 'assistant' group by all),
    calls as (select session, r, sum(n)::bigint n_calls, string_agg(name, ',' order by first) names from named group by all),
    said as (select session, r, string_agg('r' || pos, ',' order by pos) results from m where r > 0 and role = 'assistant' group by all),
    turns as (select *, row_number() over (partition by session order by r) - 1 turn from g)
    select t.session::varchar session, t.turn::int turn_index, md5(t.prompt) prompt, md5(t.response) response, coalesce(n_calls, 0) n_calls, coalesce(names, '') names, coalesce(results, '') results,
        t.ts user_ts, coalesce(lead(t.ts) over (partition by t.session order by t.turn), 99) end_ts from turns t left join calls c on c.session = t.session and c.r = t.r left join said s on s.session = t.session and s.r = t.r""")
def host_log_rounds(s, d):
    """Conversations as logs of the host: every answer makes a call, whose result comes next; a broken line and other roles change nothing."""
    says = F.array(F.struct(F.lit("text").alias("type"), F.col("text")))
    entry = lambda **m: F.to_json(F.struct(F.lit("message").alias("type"), F.concat(F.lit("m"), F.col("pos").cast("string")).alias("id"), F.struct(*[v.alias(k) for k, v in m.items()]).alias("message")))
    call_id, name = F.concat(F.lit("c"), F.col("pos").cast("string")), F.concat(F.lit("T"), (F.col("pos") % 2).cast("string"))
    block = lambda kind, t, i, n: F.struct(F.lit(kind).alias("type"), t.alias("text"), i.alias("id"), n.alias("name"))
    none = F.lit(None).cast("string")
    asks, answers = F.col("role") == "user", F.col("role") == "assistant"
    calls = F.array(block("text", F.col("text"), none, none), block("toolCall", none, call_id, name))
    result = F.array(F.struct(F.lit("text").alias("type"), F.concat(F.lit("r"), F.col("pos").cast("string")).alias("text")))
    log = _lines(
        s, d,
        F.when(asks, entry(role=F.lit("user"), timestamp=F.col("pos"), content=says)),
        F.when(answers, entry(role=F.lit("assistant"), content=calls)),
        F.when(answers, entry(role=F.lit("toolResult"), toolCallId=call_id, content=result)),
        F.when(~asks & ~answers, entry(role=F.col("role"), content=says)),
        F.lit("{broken"),
    )
    r = sessions.parse_logs(log, now=99)
    joined = lambda f: F.array_join(F.transform("toolCalls", lambda c: c[f]), ",")
    return r.select(
        "session", F.col("turnIndex").alias("turn_index"), F.md5("userPrompt").alias("prompt"), F.md5("responseSequence").alias("response"), _long("toolCallCount").alias("n_calls"),
        F.array_join("toolCallNames", ",").alias("names"), joined("result_summary").alias("results"), F.col("userTimestamp").alias("user_ts"), F.col("responseEndTimestamp").alias("end_ts"),
    )


@query(f"""with m as (select conv_id session, turn pos, role, {_trim("coalesce(text, '')")} text, sum((role = 'user' and {_trim("coalesce(text, '')")} <> '')::int) over (partition by conv_id order by turn) r from conversations),
    g as (select session, r, max(text) filter (role = 'user') prompt, coalesce(string_agg(text, chr(10) || chr(10) order by pos) filter (role = 'assistant' and text <> ''), '') response from m where r > 0 group by all)
    select session::varchar session, (row_number() over (partition by session order by r) - 1)::int turn_index, md5(prompt) prompt, md5(response) response from g where prompt <> '' and length(response) >= 20""")
def import_log_rounds(s, d):
    """Conversations as logs of the import dialect: side chains, empty questions and rounds with short answers do not count."""
    entry = lambda kind, side, content: F.to_json(F.struct(F.lit(kind).alias("type"), F.lit(side).alias("isSidechain"), F.struct(content.alias("content")).alias("message")))
    said = X.trim_unicode("text")
    asks, answers = F.col("role") == "user", F.col("role") == "assistant"
    log = _lines(s, d, F.when(asks, entry("user", False, said)), F.when(answers, entry("assistant", False, F.array(F.struct(F.lit("text").alias("type"), said.alias("text"))))), F.when(~asks & ~answers, entry("user", True, said)))
    r = sessions.parse_logs(log, "import")
    return r.where("error is null").select("session", F.col("turnIndex").alias("turn_index"), F.md5("userPrompt").alias("prompt"), F.md5("responseSequence").alias("response"))


def _files(s, d):
    """Orders as log files: changed at their date, a seventh at an unknown time."""
    o = C.table(s, d, "orders")
    ms = F.datediff(F.col("o_orderdate"), F.lit("1970-01-01").cast("date")).cast("long") * 86_400_000
    return o.select(F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("path"), F.when(F.col("o_orderkey") % 7 != 0, ms).alias("modified_ms"))


_FILES = "f as (select 'f' || o_orderkey path, case when o_orderkey % 7 <> 0 then datediff('day', date '1970-01-01', o_orderdate::date) * 86400000 end ms from orders)"


@query(f"with {_FILES} select path from f where ms is null or ms > 700000000000")
def files_since(s, d):
    return stored.modified_after(_files(s, d), 700_000_000_000).select("path")


@query(f"with {_FILES} select path, ms::bigint modified_ms from f order by ms desc nulls last, path limit 25")
def files_newest_first(s, d):
    return logs.newest_first(_files(s, d), 25)


@query(f"with {_FILES} select greatest(max(ms), 5)::bigint examined_ms from f")
def files_examined(s, d):
    return logs.last_examined(_files(s, d), 5)


@query(f"""with {_ROUNDS}, x as (select round_file, min(ts) ts from rounds where turn_index > 0 and round_file not in (select round_file from rounds where turn_index = 0) group by round_file)
    select round_file, ts "userTimestamp" from x order by ts, round_file limit 40""")
def import_limited(s, d):
    """Of rounds that are not stored (first ones are), each once, the first forty."""
    r = _rounds(s, d)
    return logs.new_rounds(r.where("turn_index > 0"), r.where("turn_index = 0"), 40)


# -- bookkeeping -----------------------------------------------------------


def _saved(s, d):
    """Rounds, of which those of odd sessions have no words at turn 1, and those that are stored: of sessions divisible by three."""
    r = _rounds(s, d).withColumn("userPrompt", F.when((F.col("turn_index") == 1) & (F.col("session") % 2 == 1), " ").otherwise(F.col("userPrompt")))
    return r, r.where("session % 3 = 0")


@query(f"""with {_ROUNDS}, p as (select session, turn_index, round_file, ({_trim("case when turn_index = 1 and session % 2 = 1 then ' ' else prompt end")}) = '' blank,
        row_number() over (partition by round_file order by session, turn_index) = 1 fresh, round_file in (select round_file from rounds where session % 3 = 0) stored from rounds),
    q as (select *, coalesce(bool_or(blank and not stored) over (partition by session order by turn_index rows between unbounded preceding and 1 preceding), false) gap from p)
    select session, turn_index, round_file, case when stored or (not blank and not fresh) then 'dedup' when blank then 'no-prompt' when gap then 'blocked' else 'saved' end outcome from q""")
def persist_outcomes(s, d):
    r, old = _saved(s, d)
    return maintain.persist_outcomes(r, old)


@query(f"with {_ROUNDS} select distinct round_file from rounds where session % 3 <> 0 and prompt || chr(0) || response not in (select prompt || chr(0) || response from rounds where session % 3 = 0)")
def rounds_not_stored(s, d):
    """Rounds that are stored neither under their name nor, with other white space around, under another."""
    r = _rounds(s, d).select("session", "round_file", "userPrompt", "responseSequence")
    old = r.where("session % 3 = 0").withColumn("userPrompt", F.concat(F.lit(" "), "userPrompt")).withColumn("round_file", F.concat(F.lit("o"), "round_file"))
    return maintain.missing_rounds(r.where("session % 3 <> 0"), old).select("round_file").distinct()


@query(f"with {_VEC[:-1]} select round_file, round(coalesce(case when round_file::int % 2 = 0 then 7.0 end, min(vector[1]) filter (suffix = ':response')), 6) as first from v group by round_file")
def embedding_healed(s, d):
    """Rounds of even numbers have a vector of their own; the others get their response row's."""
    v = C.vectors(s, d)
    own = F.when(F.col("round_file").cast("int") % 2 == 0, F.array(F.lit(7.0)))
    r = v.select("round_file").distinct().withColumn("promptEmbedding", own)
    return maintain.heal_embedding(r, v).select("round_file", F.round(F.get("promptEmbedding", F.lit(0)), 6).alias("first"))


@query(f"with {_ROUNDS} select session, turn_index, 'b' || session || '-' || turn_index round_file, case when turn_index % 2 = 0 then round_file end target from rounds")
def broken_files_repaired(s, d):
    """Broken files find the round of a log by its entry's id; every other one is in no log."""
    r = _rounds(s, d).withColumn("id", F.concat_ws("-", "session", "turn_index"))
    found = maintain.repair_from_log(r.select(F.concat(F.lit("b"), "id").alias("round_file"), "id"), r.where("turn_index % 2 = 0").select("id", "round_file"))
    at = F.split(F.substring("round_file", 2, 100), "-")
    return found.select(_long(F.get(at, F.lit(0))).alias("session"), _long(F.get(at, F.lit(1))).alias("turn_index"), "round_file", "target")


def _written(s, d):
    """Vector rows as lines; those of label 7 are broken."""
    v = C.vectors(s, d)
    line = shards.format_line(F.col("vector"), F.concat("round_file", F.lit(".json"), "suffix"), F.col("model"), F.lit(None).cast("string"))
    return v.select("vec_id", "label", F.when(F.col("label") == 7, F.concat(F.lit("!"), line)).otherwise(line).alias("line"), "shard", F.col("pos").alias("line_no"))


@query(f"with {_VEC[:-1]} select shard, count(*) broken from v where label = 7 group by shard")
def shard_broken_counts(s, d):
    return shards.broken_rows(shards.parse_lines(_written(s, d)))


@query("select vec_id from embeddings where label = 7 or (vec_id // 2) % 3 <> 0")
def lines_without_files(s, d):
    """Lines of rounds divisible by three go; those that can not be read stay."""
    parsed = shards.parse_lines(_written(s, d)).withColumn("round_file", F.when(F.col("ok"), F.col("round_file")))
    gone = C.vectors(s, d).select(F.concat("round_file", F.lit(".json")).alias("round_file")).distinct().where("int(replace(round_file, '.json', '')) % 3 = 0")
    return shards.without_files(parsed, gone).select(F.col("pos").alias("vec_id"))


@query("""select own, shard, count(*) n from (select own, case when vec_id % 3 = 0 and own = 'index.new' then 'index.new' when vec_id % 3 = 0 then 'index.csv' else 'index.h' || (vec_id % 3) end shard
    from embeddings, (values ('index.new'), ('index.h1')) o(own)) group by all""")
def legacy_adopted(s, d):
    """Lines from before shards go to a host without a shard of its own, not to one that has it."""
    lines = C.vectors(s, d).select("vec_id", F.when(F.col("vec_id") % 3 == 0, shards.LEGACY).otherwise(F.col("shard")).alias("shard"))
    counted = lambda own: shards.adopt_legacy(lines, own).groupBy("shard").agg(F.count(F.lit(1)).alias("n")).select(F.lit(own).alias("own"), "shard", "n")
    return counted("index.new").union(counted("index.h1"))


@query(f"with {_VEC[:-1]} select vec_id, case when vec_id % 5 = 0 then 'late' else 'fresh' end as kind from v where shard = 'index.h1'")
def own_shard_replaced(s, d):
    """The own shard is written anew from what was read; rows that others have appended since (ids divisible by five) stay."""
    own = C.vectors(s, d).where("shard = 'index.h1'").select("vec_id", "shard", F.lit("late").alias("kind"))
    read = own.where("vec_id % 5 <> 0")
    return shards.replace_own(own, "index.h1", read.withColumn("kind", F.lit("fresh")), read).select("vec_id", "kind")


@query(f"with {_VEC[:-1]} select shard, round_file, count(*) n_rows from v where shard <> 'index.h1' group by all")
def shard_rounds(s, d):
    return maintain.shard_rounds(C.vectors(s, d), "index.h1")


@query(f"with {_VEC[:-1]} select count(distinct round_file) n_rounds from v")
def indexed_rounds(s, d):
    return evaluate.indexed_rounds(C.vectors(s, d).select(F.concat("round_file", F.lit(".json"), "suffix").alias("key")))


@query(f"with {_VEC[:-1]} select distinct coalesce(model, 'base') model from v")
def index_models(s, d):
    return search.models(C.vectors(s, d), "base")


@query("select item_id::varchar query, item_id || '-' || k as label from benchmark, range(4) t(k) where k >= 2")
def labels_outside_pool(s, d):
    """Of four labels a query, the two that its pool lacks."""
    q = C.text_queries(s, d).select("query", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")).select("query", F.concat_ws("-", "query", F.col("k").cast("string")).alias("label"), "k")
    return golden.check_labels(q.select("query", "label"), q.where("k < 2").select("query", F.col("label").alias("round_file")))


@query(f"""with {_EVENTS}, p as (select round_file, lag(round_file) over (partition by user_id order by ts, event_id) parent, 'e' || (event_id // 2) read from e)
    select round_file query, parent as label from p where parent is not null union select round_file, read from p where read <> round_file""")
def weak_labels(s, d):
    """A round's parent and the round it expanded (that of half its number)."""
    before = F.lag("round_file").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    e = C.event_rounds(s, d).withColumn("parentId", before)
    return evaluate.weak_labels(e.select("round_file", "parentId"), e.select(F.col("round_file").alias("query"), F.concat(F.lit("e"), F.floor(F.col("event_id") / 2).cast("string")).alias("label")))


@query(f"with {_EVENTS} select round_file query, (select count(*) from e where event_id % 10 = 0) - (event_id % 10 = 0)::int excluded from e")
def excluded_without_time(s, d):
    """How many rounds each query can not be answered from, as their time is unknown: events divisible by ten."""
    e = C.event_rounds(s, d)
    return evaluate.excluded_without_time(e.select("round_file", F.when(F.col("event_id") % 10 != 0, F.col("ts")).alias("ts")), e.select(F.col("round_file").alias("query")))


@query(f"""with {_EVENTS}, x as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as position from e qualify position <= 5)
    select position, count(*) "presentedCount", sum(case when value > 10 then 2 else 0 end)::bigint "readCount" from x group by position""")
def presented_reads(s, d):
    """Of each user the five newest events were presented at once; reads are joined by the hash that stood at a position: events over 10 were read twice."""
    e = C.event_rounds(s, d).select(F.col("user_id").alias("session"), F.lit(1).alias("shown"), F.struct("ts", "event_id").alias("pos"), "round_file", "value")
    shown = evaluate.presented(e.drop("value"))
    read = e.where("value > 10").select("session", "shown", F.col("round_file").alias("hash"))
    return evaluate.read_positions(shown, read.union(read)).select(_long("position").alias("position"), "presentedCount", "readCount")


@query("""select n_regionkey::varchar script, 'index.' || n_name shard, 1::bigint n_rows, case when n_regionkey = 1 then 'now' else 'then' end as at from nation where n_regionkey <> 2 and (n_regionkey <> 1 or n_nationkey % 2 = 0)""")
def backlog(s, d):
    """What scripts (regions) left of shards (nations): one has run again and left the even ones, one has done all of its own."""
    n = C.table(s, d, "nation").select(F.col("n_regionkey").cast("string").alias("script"), F.concat(F.lit("index."), "n_name").alias("shard"), F.lit(1).cast("long").alias("n_rows"), F.array(F.lit("r")).alias("rounds"), F.lit("then").alias("recorded_at"), "n_nationkey")
    b = maintain.record_backlog(n.drop("n_nationkey"), "1", n.where("script = '1' and n_nationkey % 2 = 0").select("shard", "n_rows", "rounds"), "now")
    done = [r[0] for r in n.where("script = '2'").select("shard").collect()]  # a host's shards, a few
    return maintain.clear_backlog(b, "2", done).select("script", "shard", "n_rows", F.col("recorded_at").alias("at"))


@query("""select c_custkey::varchar round_file, case when c_custkey % 3 = 0 then '' else c_name end "userPrompt", case when c_custkey % 2 = 0 then 0 else 4 end as "turnIndex", case when c_custkey % 5 = 0 then 0 else 1 end as names, false as follow from customer""")
def round_defaults(s, d):
    """Rounds as they are read singly: what is missing has its default."""
    c, k = C.table(s, d, "customer"), F.col("c_custkey")
    r = c.select(
        k.cast("string").alias("round_file"), F.when(k % 3 != 0, F.col("c_name")).alias("userPrompt"), F.when(k % 2 != 0, F.lit(4)).alias("turnIndex"),
        F.when(k % 5 != 0, F.array(F.lit("Read"))).alias("toolCallNames"), F.lit(None).cast("boolean").alias("needsFollowup"),
    )
    return stored.with_defaults(r).select("round_file", "userPrompt", "turnIndex", F.size("toolCallNames").alias("names"), F.col("needsFollowup").alias("follow"))


_SHUFFLED = """pool as (select query, list(round_file order by position) l from ({}) group by query),
    walk as (
        select query, l, len(l)::bigint as last, 1::ubigint as state, 0::ubigint as a, 0.0::double as u from pool
        union all
        select query, list_transform(l, lambda v, i: case when i = last then l[floor(f * last)::bigint + 1] when i = floor(f * last)::bigint + 1 then l[last] else v end), last - 1, state, x, f
        from (select *, (xor(x, x >> 14) & 4294967295::ubigint)::double / 4294967296 f from (
            select query, l, last, state, xor(y, (y + ((xor(y, y >> 7) * (y | 61::ubigint)) & 4294967295::ubigint)) & 4294967295::ubigint) x from (
                select query, l, last, state, (xor(state, state >> 15) * (state | 1::ubigint)) & 4294967295::ubigint y from (
                    select query, l, last, (state + 1831565813::ubigint) & 4294967295::ubigint state from walk where last > 1)))))
    select query, unnest(l) round_file, unnest(range(1, len(l) + 1))::int as position from walk where last <= 1"""


def shuffled_sql(pool: str) -> str:
    """The seeded shuffle (seed 1) of a pool's select (query, round_file, position)."""
    return "with recursive " + _SHUFFLED.format(pool)


_EMBEDDED = f"""with {_ROUNDS},
    short as (select *, len(regexp_extract_all(prompt, '[^\\s\\x{{0085}}\\x{{00A0}}]+')) < 20 short from rounds),
    texts as (select round_file, ':prompt' suffix, left(prompt, 8000) t from short where not short union all select round_file, ':response', response from short
        union all select round_file, ':combined', case when short then response else left(prompt, 8000) || chr(10) || chr(10) || response end from short),
    rows_ as (select round_file, suffix, t, row_number() over () id from texts),
    words as (select id, ('0x' || substr(md5('stub:' || w), 1, 16))::ubigint h from (select id, unnest(list_filter(regexp_split_to_array(lower(t), '{_WS}+'), lambda w: w <> '')) w from rows_)),
    dims as (select id, h % 64 k, sum(case when h >= 9223372036854775808::ubigint then 1 else -1 end) x from words group by all),
    sums as (select id, sum(x * x) norm2, sum(x * k) moment from dims group by id)
    select round_file, suffix, coalesce(norm2, 0)::double norm2, coalesce(moment, 0)::double moment from rows_ left join sums using (id)"""

ORACLE |= {"seeded_pool": shuffled_sql(WHOLE["round_robin_pool"]), "embed_stub": _EMBEDDED}
