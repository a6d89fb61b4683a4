"""Registered streams: each runs over all of a table, by micro-batches, and stops; the SQL is a batch's.

The streams' rows and state are written to folders below ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.contract_queries import _OPERATIONS, _operations
from tidemark.sources.tables import shared_folder, table, written
from tidemark.streaming import hosts, incremental, runs, session_store, state

TTL_SECONDS = 2 * 24 * 3600
SLICES = 3


def _stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    operations = _operations(spark, sf_dir).select("user_id", "ts", "event_id", "op", "action_id")
    folder = shared_folder(spark, "session-store")
    told = runs.one_by_one(spark, runs.stretches(written(operations, "operations"), "ts", SLICES), session_store.OPERATIONS, lambda s: session_store.sessions(s, TTL_SECONDS), folder)
    return told, folder


def session_store_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir)[0].select("event_id", "user_id", "op", "status", "plan_step", "memory")


def live_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sessions that are left in the state when the stream has read everything."""
    _, folder = _stored(spark, sf_dir)
    held = runs.state_of(spark, folder, "session")
    memory = runs.state_of(spark, folder, "memory").groupBy(F.col("key.user_id").alias("user_id")).agg(F.count("*").alias("remembered"))
    found = held.select(F.col("key.user_id").alias("user_id"), F.col("value.plan_step").alias("plan_step"), F.col("value.last_action").alias("last_action"))
    return found.join(memory, "user_id", "left").select("user_id", "plan_step", "last_action", F.coalesce("remembered", F.lit(0)).alias("remembered"))


_MACHINE = f"""
    {_OPERATIONS},
    m as (
        select distinct user_id, cast(0 as bigint) as i, false as live, cast(null as timestamp) as seen, cast(null as bigint) as last, cast(0 as bigint) as steps, cast([] as varchar[]) as mem, cast(null as varchar) as status, cast(null as bigint) as event_id, cast(null as varchar) as op from n
        union all
        select m.user_id, n.i, case when n.op = 'create' then true when not ok then false else n.op <> 'delete' end, case when n.op = 'create' or (ok and (n.op = 'step' or hit)) then n.ts else m.seen end,
            case when n.op = 'create' then null when ok and n.op = 'step' then n.act else m.last end, case when n.op = 'create' then 0 when ok and n.op = 'step' then m.steps + 1 else m.steps end,
            case when n.op = 'create' then [] when ok and n.op = 'step' then list_append(m.mem, 'a' || n.act)[-5:] when ok and hit then list_transform(m.mem, lambda x: case when x = 'a' || n.act then x || '=ok' else x end) else m.mem end,
            case when n.op = 'create' then 'created' when not ok then 'session_expired' when n.op = 'step' then 'ok' when n.op = 'get' then 'found' when n.op = 'delete' then 'ended' when n.op = 'escalate' then 'unavailable' when hit then 'accepted' else 'invalid_request' end, n.event_id, n.op
        from m join n on n.user_id = m.user_id and n.i = m.i + 1, lateral (select m.live and coalesce(n.ts < m.seen + interval 2 day, false) as ok, n.op = 'feedback' and coalesce(n.act = m.last, false) as hit) x)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"session_store_stream": session_store_stream, "live_sessions": live_sessions}

SQL = {
    "session_store_stream": f"with recursive {_MACHINE} select event_id, user_id, op, status, case when live then steps end as plan_step, case when live then array_to_string(mem, ',') end as memory from m where i > 0",
    "live_sessions": f"""with recursive {_MACHINE}, ended as (select * from m where i > 0 qualify row_number() over (partition by user_id order by i desc) = 1)
        select user_id, steps as plan_step, 'a' || last as last_action, len(mem) as remembered from ended where live and seen + interval 2 day > (select max(ts) from events)""",
}


# --- incremental extraction over pages -------------------------------------------------------------------------------
TAGS, BATCHES, RECONCILE = "a|p|li|h1|h2|button|input|label", 4, 3
_PATTERN = f"<({TAGS})[^>]*>([^<]*)"
_CLEAN = "trim(regexp_replace({}, '[ \\t\\n\\r]+', ' '{}))"
_GROUP = "1000000 + cast(floor(i / 5) as bigint)"
#: One record at most for each of a page's tags (numbered i) in each batch (b); a kind is null where nothing happens.
_H = "(page_id * 31 + i * 17 + b * 7) % 23"
_NODE_RECORD = {
    "seq": "b * 10000000 + 2 * i + 1",
    "kind": f"case when page_id % 7 = 3 and b = 2 and i = 0 then 'text' when {_H} = 0 then 'text' when {_H} in (1, 4, 5) then 'attribute' when {_H} = 2 then 'remove' when {_H} = 3 then 'add' when {_H} = 6 and page_id % 5 = 0 and i % 10 = 0 then 'attribute' end",
    "node": f"case when {_H} = 3 and not (page_id % 7 = 3 and b = 2 and i = 0) then 2000000 + b * 100000 + i else i end",
    "parent": _GROUP,
    "tag": f"case when {_H} = 3 then 'button' end",
    "text": f"case when {_H} = 3 then 'new' else concat('text ', cast(b as varchar(9))) end",
    "label": f"case when {_H} = 1 then concat('label ', cast(b as varchar(9))) end",
    "labelled_by": f"case when {_H} = 5 then case when i % 3 = 0 then {_GROUP} else i + 1 end end",
    "disabled": f"case when {_H} = 4 then b % 2 = 1 when {_H} = 3 then false end",
    "field": f"case when {_H} = 1 then 'label' when {_H} = 4 then 'disabled' when {_H} = 5 then 'labelled_by' when {_H} = 6 then 'class' end",
    "size": "case when page_id % 7 = 3 and b = 2 and i = 0 then 5000 else 1 end",
}
_GROUP_GONE = "(page_id * 7 + (g - 1000000) * 5 + b * 3) % 29 = 0"
_UNSTABLE = "case when page_id % 4 = 1 and b = 2 then 1 else 0 end"


def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as it is first read, in groups of five tags, then ``BATCHES`` batches of changes; each batch ends with a pass."""
    pages = table(spark, sf_dir, "pages")
    found = pages.select("page_id", F.posexplode(F.arrays_zip(*(F.expr(f"regexp_extract_all(html, '{_PATTERN}', {k})").alias(n) for k, n in ((1, "tag"), (2, "text"))))).alias("i", "x"))
    nodes = found.select("page_id", F.col("i").cast("bigint").alias("i"), "x.tag", F.expr(_CLEAN.format("x.text", "")).alias("text"))
    columns = [c.strip().split(" ") for c in incremental.RECORDS.split(",")]

    def records(rows: DataFrame, **given: str) -> DataFrame:
        return rows.select(*(F.expr(given.get(name, "null")).cast(kind).alias(name) for name, kind in columns))

    groups = nodes.select("page_id", F.expr(_GROUP).alias("g")).distinct()
    batch = lambda rows: rows.withColumn("b", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(BATCHES).cast("bigint"))))
    parts = [
        records(groups, page_id="page_id", batch="0", seq="g - 1000000", kind="'add'", node="g", tag="'div'", text="''", size="1"),
        records(nodes, page_id="page_id", batch="0", seq="5000000 + i", kind="'add'", node="i", parent=_GROUP, tag="tag", text="text", disabled="false", size="1"),
        records(batch(nodes.select("page_id", "i")), page_id="page_id", batch="b", **_NODE_RECORD).where("kind is not null"),
        records(batch(groups).where(_GROUP_GONE), page_id="page_id", batch="b", seq="b * 10000000 + 5000000 + g", kind="'remove'", node="g", size="1"),
        records(pages.select("page_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(BATCHES + 1).cast("bigint"))).alias("b")), page_id="page_id", batch="b", seq="b * 10000000 + 9000000", kind="'extract'", size=_UNSTABLE),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "incremental")
    records = written(page_records(spark, sf_dir), "page-records")
    parts = (records.where(F.col("batch").between(first, last)) for first, last in ((0, 1), (2, 2), (3, BATCHES + 1)))  # batch by batch, the first two and the last ones together
    return runs.one_by_one(spark, parts, incremental.RECORDS, lambda s: incremental.observations(s, max_records=64, reconcile_every=RECONCILE), folder)


def incremental_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _observed(spark, sf_dir).where("node is null").select("page_id", "batch", "status", "observation", "baseline", "is_full", "recomputed", "added", "changed", "removed")


def incremental_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _observed(spark, sf_dir).where("node is not null").select("page_id", "observation", "node", "change", "name", "disabled")


#: A full pass over each page after each batch, without any state: last values, what is left, and the differences between committed passes.
_FULL_PASSES = f"""
    nodes as (select page_id, i - 1 as i, tags[i] as tag, {_CLEAN.format("texts[i]", ", 'g'")} as text from (select page_id, tags, texts, unnest(generate_series(1, len(tags)))::bigint as i
        from (select page_id, regexp_extract_all(html, '{_PATTERN}', 1) as tags, regexp_extract_all(html, '{_PATTERN}', 2) as texts from pages))),
    groups as (select distinct page_id, {_GROUP} as g from nodes),
    batches as (select unnest(range(1, {BATCHES + 1})) as b),
    changes as (select * from (select page_id, b as batch, {", ".join(f"{v} as {k}" for k, v in _NODE_RECORD.items())} from (select page_id, i from nodes), batches) where kind is not null),
    gone_groups as (select page_id, b as batch, b * 10000000 + 5000000 + g as seq, g from groups, batches where {_GROUP_GONE}),
    born as (select page_id, i as node, 0 as batch, 5000000 + i as seq, {_GROUP} as parent, tag, text from nodes union all select page_id, node, batch, seq, parent, 'button', 'new' from changes where kind = 'add'),
    died as (select b.page_id, b.node, least(min(c.seq), min(g.seq)) as seq_at from born b left join changes c on c.page_id = b.page_id and c.node = b.node and c.kind = 'remove' and c.seq > b.seq
        left join gone_groups g on g.page_id = b.page_id and g.g = b.parent and g.seq > b.seq group by all),
    gone_at as (select page_id, g, min(seq) as seq_at from gone_groups group by all),
    moments as (select page_id, b, b * 10000000 + 9000000 as seq_at, {_UNSTABLE} = 0 as commits from (select page_id, unnest(range(0, {BATCHES + 2})) as b from pages)),
    commits as (select page_id, b, seq_at, row_number() over w as observation, lag(b) over w as before, lag(seq_at) over w as before_at from moments where commits window w as (partition by page_id order by b)),
    alive as (select m.page_id, m.b, x.node, x.parent, x.tag, x.seq, coalesce(arg_max(c.text, c.seq) filter (c.kind = 'text'), any_value(x.text)) as text, arg_max(c.label, c.seq) filter (c.field = 'label') as label,
            arg_max(c.labelled_by, c.seq) filter (c.field = 'labelled_by') as labelled_by, coalesce(arg_max(c.disabled, c.seq) filter (c.kind = 'attribute' and c.field = 'disabled'), false) as disabled
        from commits m join born x on x.page_id = m.page_id and x.seq < m.seq_at join died d on d.page_id = x.page_id and d.node = x.node and (d.seq_at is null or d.seq_at > m.seq_at)
            left join changes c on c.page_id = m.page_id and c.node = x.node and c.kind in ('text', 'attribute') and c.seq > x.seq and c.seq < m.seq_at group by all),
    group_texts as (select page_id, b, parent, string_agg(text, ' ' order by node) filter (text <> '') as text from alive group by all),
    live_groups as (select m.page_id, m.b, g.g from commits m join groups g using (page_id) left join gone_at d on d.page_id = g.page_id and d.g = g.g where d.seq_at is null or d.seq_at > m.seq_at),
    snapshots as (select a.page_id, a.b, a.node, a.parent, a.labelled_by, a.disabled, t.parent as by_parent,
            case when t.node is not null then t.text when lg.g is not null then coalesce(gt.text, '') when a.label is not null then a.label else a.text end as name
        from alive a left join alive t on t.page_id = a.page_id and t.b = a.b and t.node = a.labelled_by left join live_groups lg on lg.page_id = a.page_id and lg.b = a.b and lg.g = a.labelled_by
            left join group_texts gt on gt.page_id = a.page_id and gt.b = a.b and gt.parent = a.labelled_by where a.tag in ('a', 'button', 'input')),
    waiting as (select m.page_id, m.b, m.before, r.* exclude (page_id) from commits m join (
            select page_id, seq, kind, node, field, size, case when kind = 'add' then parent end as parent from changes union all
            select page_id, seq, 'remove', g, null, 1, null from gone_groups) r on r.page_id = m.page_id and r.seq < m.seq_at and r.seq > coalesce(m.before_at, -1)),
    -- a node's group is affected by its removal if it was still there
    affected as (
        select page_id, b, node from waiting union
        select page_id, b, parent from waiting where parent is not null union
        select w.page_id, w.b, x.parent from waiting w join born x on x.page_id = w.page_id and x.node = w.node join died d on d.page_id = x.page_id and d.node = x.node where w.kind = 'remove' and d.seq_at = w.seq union
        select w.page_id, w.b, x.node from waiting w join born x on x.page_id = w.page_id and x.parent = w.node join died d on d.page_id = x.page_id and d.node = x.node where w.kind = 'remove' and w.node between 1000000 and 1999999 and d.seq_at = w.seq),
    weights as (select page_id, b, seq, max(size) as size, count(*) as n from waiting group by all),
    counted as (select page_id, b, count(*) as n, bool_or(size > 64) as large, bool_or(kind = 'attribute' and field = 'class') as restyled from waiting group by all),
    passes as (select m.*, m.observation = 1 or coalesce(c.n > 64 or c.large or c.restyled, false) or (m.observation - 1) % {RECONCILE} = 0 as is_full from commits m left join counted c on c.page_id = m.page_id and c.b = m.b),
    touching as (select page_id, b, node from affected union select a.page_id, a.b, x.parent from affected a join alive x using (page_id, b, node)),
    looked as (select s.page_id, s.b, count(*) as n, count(*) filter (exists (select 1 from touching t where t.page_id = s.page_id and t.b = s.b and t.node in (s.node, s.labelled_by)) or exists (select 1 from affected t where t.page_id = s.page_id and t.b = s.b and t.node in (s.parent, s.by_parent))) as n_some from snapshots s group by all),
    differences as (select m.page_id, m.observation, coalesce(n.node, o.node) as node, case when o.node is null then 'added' when n.node is null then 'removed' else 'changed' end as change, n.name, n.disabled
        from (select c.page_id, c.observation, s.* exclude (page_id) from commits c join snapshots s on s.page_id = c.page_id and s.b = c.b) n
            full join (select c.page_id, c.observation, s.* exclude (page_id) from commits c join snapshots s on s.page_id = c.page_id and s.b = c.before) o on o.page_id = n.page_id and o.observation = n.observation and o.node = n.node
            join commits m on m.page_id = coalesce(n.page_id, o.page_id) and m.observation = coalesce(n.observation, o.observation)
        where o.node is null or n.node is null or (n.name, n.disabled) is distinct from (o.name, o.disabled) or n.labelled_by is distinct from o.labelled_by)
"""

QUERIES |= {"incremental_passes": incremental_passes, "incremental_changes": incremental_changes}
SQL |= {
    "incremental_passes": f"""with {_FULL_PASSES}
        select p.page_id, p.b as batch, 'complete' as status, p.observation, nullif(p.observation - 1, 0) as baseline, p.is_full, coalesce(case when p.is_full then l.n else l.n_some end, 0) as recomputed,
            (select count(*) from differences d where d.page_id = p.page_id and d.observation = p.observation and change = 'added') as added, (select count(*) from differences d where d.page_id = p.page_id and d.observation = p.observation and change = 'changed') as changed,
            (select count(*) from differences d where d.page_id = p.page_id and d.observation = p.observation and change = 'removed') as removed from passes p left join looked l on l.page_id = p.page_id and l.b = p.b
        union all
        select m.page_id, m.b, 'unstable', c.observation, null, coalesce(q.n > 64 or q.large or q.restyled, false) or c.observation % {RECONCILE} = 0, 0, 0, 0, 0
            from moments m join commits c on c.page_id = m.page_id and c.b = m.b - 1 left join (select w.page_id, count(*) as n, bool_or(size > 64) as large, bool_or(kind = 'attribute' and field = 'class') as restyled
                from waiting w where w.b = 3 and w.seq < 29000000 group by all) q on q.page_id = m.page_id where not m.commits""",
    "incremental_changes": f"with {_FULL_PASSES} select page_id, observation, node, change, name, disabled from differences",
}


# --- hosts, frames, sessions and replies -----------------------------------------------------------------------------
IDLE_SECONDS, FRAME, SESSION_SECONDS = 6 * 3600, "2 hours", 12 * 3600


def _micros(found: DataFrame, *columns: str) -> DataFrame:
    """Instants as microseconds of the epoch: the same number in every engine and time zone."""
    return found.withColumns({c: F.unix_micros(c) for c in columns})


def _in_time(spark: SparkSession, rows: DataFrame, schema: str, name: str, of: Callable[[DataFrame], DataFrame], slices: int = 2) -> DataFrame:
    return runs.one_by_one(spark, runs.stretches(rows, "ts", slices), schema, of, shared_folder(spark, name))


def idle_unloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views and signups as leases that are taken, clicks and purchases as leases that are given back."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type").isin("view", "signup"), "ACQUIRE").when(F.col("event_type").isin("click", "purchase"), "RELEASE").otherwise("OTHER")
    rows = e.select("user_id", "ts", "event_id", kind.alias("event"))
    return _micros(_in_time(spark, rows, hosts.LEASES, "idle-hosts", lambda s: hosts.idle_unloads(s, IDLE_SECONDS)), "released_at", "unloaded_at")


def coalesced_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests for frames of two hours. Every fiftieth comes to a second run of the stream, when its frame has been served."""
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    folder = shared_folder(spark, "frames")
    parts = (rows.where((F.col("event_id") % 50 == 7) == late) for late in (False, True))
    served = runs.one_by_one(spark, parts, "user_id bigint, ts timestamp, event_id bigint", lambda s: hosts.coalesced_frames(s, FRAME), folder)
    return _micros(served, "frame")


def closed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that have ended by the last event, from a stream."""
    rows = table(spark, sf_dir, "events").select("user_id", "ts")
    return _micros(_in_time(spark, rows, "user_id bigint, ts timestamp", "sessions", lambda s: state.sliding_sessions(s, SESSION_SECONDS)), "started", "touched")


def correlated_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views as requests; most have an answer of the same id within seconds, some two, some from another peer, some too late."""
    e = table(spark, sf_dir, "events").where("event_type = 'view'")
    asked = e.select(F.col("event_id").alias("id"), F.col("user_id").alias("peer"), F.col("ts").alias("asked"))
    answered = e.where("event_id % 3 > 0").select(F.col("event_id").alias("id"), (F.col("user_id") + F.when(F.col("event_id") % 7 == 0, 1).otherwise(0)).alias("peer"), (F.col("ts") + F.make_dt_interval(secs=F.col("event_id") % 90)).alias("answered"))
    answered = answered.unionByName(answered.where("id % 5 = 0"))
    folder = shared_folder(spark, "replies")
    answered.write.parquet(f"{folder}/answered")
    other = lambda: spark.readStream.schema("id bigint, peer bigint, answered timestamp").parquet(f"{folder}/answered")
    found = runs.one_by_one(spark, [asked], "id bigint, peer bigint, asked timestamp", lambda s: state.matched_replies(s, other(), "60 seconds"), folder)
    return _micros(found.select("id", "peer", "asked", "answered"), "asked", "answered")


QUERIES |= {"idle_unloads": idle_unloads, "coalesced_frames": coalesced_frames, "closed_sessions": closed_sessions, "correlated_replies": correlated_replies}
SQL |= {
    "idle_unloads": f"""
        with e as (select user_id, ts, event_id, case when event_type in ('view', 'signup') then 1 when event_type in ('click', 'purchase') then -1 else 0 end as d from events),
        t as (select *, sum(d) over w as t from e window w as (partition by user_id order by ts, event_id rows unbounded preceding)),
        l as (select *, t - least(min(t) over (partition by user_id order by ts, event_id rows unbounded preceding), 0) as leases from t),
        r as (select *, coalesce(lag(leases) over w, 0) as before, first_value(case when d = 1 then ts end ignore nulls) over (partition by user_id order by ts, event_id rows between 1 following and unbounded following) as taken from l window w as (partition by user_id order by ts, event_id)),
        u as (select user_id, ts as released_at, ts + interval {IDLE_SECONDS} second as unloaded_at from r where d = -1 and leases = 0 and before > 0 and coalesce(taken >= ts + interval {IDLE_SECONDS} second, true))
        select user_id, row_number() over (partition by user_id order by released_at) - 1 as generation, epoch_us(released_at) as released_at, epoch_us(unloaded_at) as unloaded_at from u where unloaded_at <= (select max(ts) from events)""",
    "coalesced_frames": """
        with e as (select user_id, time_bucket(interval 2 hour, ts) as frame, event_id % 50 = 7 as late from events), m as (select max(ts) as seen from events where event_id % 50 <> 7), n as (select max(ts) as seen from events)
        select epoch_us(frame) as frame, count(distinct user_id) as subscribers, count(*)::bigint as requests from e, m where not (late and frame + interval 2 hour <= m.seen) and frame + interval 2 hour <= (select seen from n) group by frame""",
    "closed_sessions": f"""
        with e as (select user_id, ts, coalesce(ts >= lag(ts) over w + interval {SESSION_SECONDS} second, true) as fresh from events window w as (partition by user_id order by ts)),
        s as (select user_id, ts, sum(case when fresh then 1 else 0 end) over (partition by user_id order by ts rows unbounded preceding) as k from e), g as (select user_id, k, min(ts) as started, max(ts) as touched, count(*) as events from s group by all)
        select user_id, epoch_us(started) as started, epoch_us(touched) as touched, events from g where touched + interval {SESSION_SECONDS} second <= (select max(ts) from events)""",
    "correlated_replies": """
        select event_id as id, user_id as peer, epoch_us(ts) as asked, epoch_us(ts + to_seconds(event_id % 90)) as answered from events where event_type = 'view' and event_id % 3 > 0 and event_id % 7 > 0 and event_id % 90 between 1 and 60""",
}
