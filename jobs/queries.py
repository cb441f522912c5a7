"""The jobs as queries: each runs twice into a folder of its own, and what stands there then is the result. And their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.digest import digest
from jobs.sweep import read_plans, sweep
from palimpsest.plans import oracle
from palimpsest.sources.scratch import scratch_path


def job1_digest(s: SparkSession, d: str) -> DataFrame:
    """Rounds of all conversations, by the incremental digest; the second run finds nothing new."""
    out = scratch_path(s, "job1")
    for _ in range(2):
        digest(s, f"{d}/conversations.parquet*", f"{out}/store", f"{out}/checkpoint")
    r = s.read.parquet(f"{out}/store/rounds")
    long = lambda c: c.cast("long")
    return r.select(
        "session", long(F.col("turn_index")).alias("turn_index"), "round_file", "parentId", "needsFollowup", "n_messages", long(F.length("userPrompt")).alias("prompt_chars"),
        long(F.length("responseSequence")).alias("response_chars"), "userTimestamp", "responseEndTimestamp", "outcome",
    )


def job2_sweep(s: SparkSession, d: str) -> DataFrame:
    """What the documents, as texts of a store, and the embeddings, as its vector rows, need: a row for each, `kind` tells which."""
    out = scratch_path(s, "job2")
    for _ in range(2):
        sweep(s, f"{d}/documents.parquet", f"{d}/embeddings.parquet", out)
    rounds, vectors = read_plans(s, out)
    a = rounds.select(F.lit("round").alias("kind"), "id", F.lit(None).cast("string").alias("suffix"), "action", "keeper", F.col("words").cast("long").alias("words"), "short", F.col("source").alias("of"))
    b = vectors.select(F.lit("vector").alias("kind"), "id", "suffix", "action", F.lit(None).cast("long").alias("keeper"), F.lit(None).cast("long").alias("words"), F.lit(None).cast("boolean").alias("short"), F.col("model").alias("of"))
    return a.unionByName(b)


QUERIES = {f.__name__: f for f in (job1_digest, job2_sweep)}
ORACLE = {
    "job1_digest": f"""with {oracle._ROUNDS} select session, turn_index, round_file, lag(round_file) over (partition by session order by turn_index) "parentId", false "needsFollowup", n_messages,
        length(prompt) prompt_chars, length(response) response_chars, ts "userTimestamp", lead(ts) over (partition by session order by turn_index) "responseEndTimestamp",
        case when response = '' then 'prompt-only' else 'stored' end outcome from rounds""",
    "job2_sweep": f"""with each as (select doc_id id, source, md5({oracle._trim("coalesce(text, '')")}) k, {oracle._words("coalesce(text, '')")} words, {oracle._trim("coalesce(text, '')")} = '' blank from documents),
        f as (select id, case when id is null then k end, arg_min(source, k) source, min(k) k, arg_min(words, k) words, arg_min(blank, k) blank, min(k) <> max(k) conflict from each group by 1, 2),
        keep as (select k, min(id) keeper from f where id is not null and not conflict and not blank group by k having count(*) > 1),
        v as (select vec_id // 2 id, case when vec_id % 2 = 0 then ':prompt' else ':response' end suffix, case when label % 3 > 0 then 'm' || (label % 3) end model from embeddings),
        s as (select id, suffix, bool_or(coalesce(model, 'm1') = 'm1') c, bool_or(coalesce(model, 'm1') <> 'm1') s from v join f using (id) where not (words < 20 and suffix = ':prompt') group by id, suffix),
        cov as (select id, bool_and(c) covered, bool_or(s) has_stale from s group by id),
        r as (select f.id, source, words, words < 20 short, keeper, case when f.id is null then 'nameless' when conflict then 'conflict' when blank then 'empty' when f.id <> keeper then 'duplicate'
            when covered then 'keep' when has_stale then 'reembed' else 'embed' end as action from f left join keep using (k) left join cov using (id)),
        has as (select distinct id, suffix, true has from v where coalesce(model, 'm1') = 'm1'),
        g as (select v.*, case when r.id is null then 'orphan' when r.action in ('empty', 'duplicate') then 'doomed' when short and v.suffix = ':prompt' then 'short'
            when coalesce(model, 'm1') <> 'm1' and has then 'stale' end as action from v left join r on r.id = v.id left join has on has.id = v.id and has.suffix = v.suffix)
        select 'round' kind, id, null::varchar suffix, action, case when action = 'duplicate' then keeper end keeper, words, short, source as "of" from r
        union all select 'vector', id, suffix, action, null, null, null, model from g where action is not null""",
}
