"""SQL twins of the registered queries, for DuckDB on the same tables.

Each twin repeats the adapter view it needs as leading common table expressions
and states the operator in plain windows, joins and recursion, independent of how
the Spark side splits the work.
"""

from __future__ import annotations

VIEWS: dict[str, tuple[str, ...]] = {}
BODIES: dict[str, str] = {}
SQL: dict[str, str] = {}

EVENTS_NOW = "timestamp '2024-01-30 23:59:59'"
ORDERS_NOW = "timestamp '2001-08-01 12:00:00'"


def view(name: str, body: str, *needs: str) -> None:
    VIEWS[name], BODIES[name] = needs, body


def _order(names: tuple[str, ...], seen: list[str]) -> list[str]:
    for name in names:
        _order(VIEWS[name], seen)
        if name not in seen:
            seen.append(name)
    return seen


def twin(key: str, body: str, *needs: str) -> None:
    parts = [f"{name} as ({BODIES[name]})" for name in _order(needs, [])]
    SQL[key] = ("with recursive " + ", ".join(parts) + " " if parts else "") + body


def pick(values: tuple, index: str) -> str:
    shown = ", ".join("null" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"([{shown}])[cast(({index}) % {len(values)} as int) + 1]"


def micro(nano: str) -> str:
    """Nano dollars (an integer) to dollars with six decimals."""
    return f"cast(({nano} + 500) // 1000 as double) / 1e6"


def day(expr: str) -> str:
    return f"strftime(cast({expr} as date), '%Y-%m-%d')"


TOKENS = ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens")
SUMS = ", ".join(f"cast(coalesce(sum({c}), 0) as bigint) as {c}" for c in TOKENS)
VISIBLE = "greatest(total_tokens, input_tokens + output_tokens)"

# ------------------------------------------------------------------------- F1

view("ev", "select *, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k from events")
view(
    "f1",
    """select 'log' as runtime, cast(user_id as varchar) as thread_id, user_id, event_id as seq, k, event_type,
    '/w/p' || (user_id % 12) as project_path,
    case event_type when 'click' then 'gpt-5.4' when 'view' then 'gpt-5.4-mini' when 'purchase' then 'gpt-5.5'
      when 'signup' then 'gpt-5-codex' end as model, ts,
    i as input_tokens, (i * k) // 100 as cached_input_tokens, o as output_tokens, o // 4 as reasoning_output_tokens, i + o as total_tokens
    from (select *, cast(floor(value * 100) as bigint) as i, cast(floor(value * 10) as bigint) as o from ev)""",
    "ev",
)
view(
    "f1p",
    """select *, (input_tokens - bc) * pin + bc * pca + output_tokens * pout as nano from (
      select *, least(greatest(cached_input_tokens, 0), greatest(input_tokens, 0)) as bc,
        case event_type when 'click' then 2500 when 'view' then 750 when 'purchase' then 5000 when 'signup' then 1250 else 5000 end as pin,
        case event_type when 'click' then 250 when 'view' then 75 when 'purchase' then 500 when 'signup' then 125 else 500 end as pca,
        case event_type when 'click' then 15000 when 'view' then 4500 when 'purchase' then 30000 when 'signup' then 10000 else 30000 end as pout
      from f1)""",
    "f1",
)

TOOLS = ("exec_command", "apply_patch", "web_search", "view_image", "read_docs", "update_plan", "shell", "browser_click", "other")
view("calls", f"select thread_id, seq, {pick(TOOLS, 'k')} as tool_name, ts from f1", "f1")

# ------------------------------------------------------------------ F1c and F1f

view(
    "cnum",
    """select *, sum(case when event_type = 'signup' then 1 else 0 end) over w as epoch, row_number() over w as rn
    from f1 window w as (partition by thread_id order by ts, seq)""",
    "f1",
)
view(
    "ccum",
    """select *, sum(input_tokens) over w as ci, sum(cached_input_tokens) over w as cc, sum(output_tokens) over w as co,
    sum(reasoning_output_tokens) over w as cr, sum(total_tokens) over w as ct
    from cnum window w as (partition by thread_id, epoch order by ts, seq)""",
    "cnum",
)
view(
    "tokline",
    """select thread_id, user_id, rn, 2 * rn + c as line_no, ts, k,
      k <> 13 as has_cum, case when k <> 13 then ci end as s_i, case when k not in (13, 17) then cc end as s_c,
      case when k <> 13 then co end as s_o, case when k <> 13 then cr end as s_r,
      case when k = 13 then null when k = 19 then -1 else ct end as s_t,
      k % 5 <> 0 as has_last, case when k % 5 <> 0 then input_tokens end as l_i, case when k % 5 <> 0 then cached_input_tokens end as l_c,
      case when k % 5 <> 0 then output_tokens end as l_o, case when k % 5 <> 0 then reasoning_output_tokens end as l_r,
      case when k % 5 <> 0 then total_tokens end as l_t
    from ccum, (select unnest([0, 1]) as c) where c = 0 or k % 10 = 3""",
    "ccum",
)
view(
    "turnline",
    "select thread_id, 2 * rn - 1 as line_no, case when k % 8 <> 0 then model end as model from ccum where k % 4 = 0",
    "ccum",
)
FORK_COLUMNS = "rn, line_no, ts, k, has_cum, s_i, s_c, s_o, s_r, s_t, has_last, l_i, l_c, l_o, l_r, l_t"
view(
    "forkline",
    f"""select thread_id, {FORK_COLUMNS}, cast(null as varchar) as parent from tokline
    union all
    select cast(parent + 1000000 as varchar), {FORK_COLUMNS}, cast(parent as varchar) from (
      select *, case when user_id % 15 = 0 and rn <= greatest(20, (select count(*) from events) // 1000) then user_id when (user_id - 1) % 15 = 0 and rn > greatest(20, (select count(*) from events) // 1000) then user_id - 1 end as parent
      from tokline) where parent is not null""",
    "tokline",
)


def _walk(prefix: str, source: str) -> None:
    """Counted events of a counter log by recursion over its lines."""
    f = ("i", "c", "o", "r", "t")
    view(
        f"{prefix}line",
        f"""select *, has_cum and coalesce(s_i, 0) >= 0 and coalesce(s_c, 0) >= 0 and coalesce(s_o, 0) >= 0 and coalesce(s_r, 0) >= 0 and coalesce(s_t, 0) >= 0 as ok,
          has_last and least(coalesce(l_i, 0), coalesce(l_c, 0), coalesce(l_o, 0), coalesce(l_r, 0), coalesce(l_t, 0)) >= 0
            and greatest(coalesce(l_i, 0), coalesce(l_c, 0), coalesce(l_o, 0), coalesce(l_r, 0), coalesce(l_t, 0)) > 0 as own,
          row_number() over (partition by thread_id order by line_no) as pos from {source} where has_cum or has_last""",
        source,
    )
    fresh = "(not w.has or (w.v_t > l.s_t and w.v_i > l.s_i))"
    reset = f"coalesce({fresh}, not w.has)"
    new = {x: f"case when not l.ok then w.v_{x} when {reset} then coalesce(l.s_{x}, 0) else greatest(w.v_{x}, coalesce(l.s_{x}, w.v_{x})) end" for x in f}
    grown = " or ".join(f"({new[x]}) <> w.v_{x}" for x in f)
    emit = {
        x: f"""case when not l.ok then case when l.own then coalesce(l.l_{x}, 0) end
          when {reset} then case when l.own then coalesce(l.l_{x}, 0) else coalesce(l.s_{x}, 0) end
          when {grown} then case when l.own then coalesce(l.l_{x}, 0) else ({new[x]}) - w.v_{x} end end"""
        for x in f
    }
    zeros = ", ".join(f"cast(0 as bigint) as v_{x}" for x in f)
    nulls = ", ".join(f"cast(null as bigint) as d_{x}" for x in f)
    view(
        f"{prefix}walk",
        f"""select distinct thread_id, cast(0 as bigint) as pos, cast(null as bigint) as line_no, false as has, {zeros}, {nulls} from {prefix}line
        union all
        select l.thread_id, l.pos, l.line_no, w.has or l.ok, {', '.join(f'cast({new[x]} as bigint)' for x in f)}, {', '.join(f'cast({emit[x]} as bigint)' for x in f)}
        from {prefix}walk w join {prefix}line l on l.thread_id = w.thread_id and l.pos = w.pos + 1""",
        f"{prefix}line",
    )
    view(
        f"{prefix}delta",
        f"""select thread_id, line_no, d_i as input_tokens, d_c as cached_input_tokens, d_o as output_tokens, d_r as reasoning_output_tokens, d_t as total_tokens
        from {prefix}walk where d_i is not null and greatest(d_i, d_c, d_o, d_r, d_t) > 0""",
        f"{prefix}walk",
    )


_walk("c", "tokline")
_walk("k", "forkline")
view(
    "kidx",
    """select d.*, row_number() over (partition by d.thread_id order by d.line_no) as idx,
      struct_pack(a := has_cum, b := s_i, c := s_c, d := s_o, e := s_r, f := s_t, g := has_last, h := l_i, i := l_c, j := l_o, k := l_r, l := l_t) as ident, parent
    from kdelta d join forkline using (thread_id, line_no)""",
    "kdelta", "forkline",
)
view("kparent", "select thread_id, arg_max(parent, line_no) as parent_id from forkline where parent is not null group by thread_id", "forkline")
view(
    "kprefix",
    """select c.thread_id, p.parent_id, coalesce(min(case when q.ident is null or q.ident is distinct from c.ident then c.idx end) - 1, count(*)) as prefix
    from kidx c join kparent p on p.thread_id = c.thread_id left join kidx q on q.thread_id = p.parent_id and q.idx = c.idx
    group by c.thread_id, p.parent_id""",
    "kidx", "kparent",
)

# ------------------------------------------------------------------------- F2

view(
    "f2",
    """select cast(event_id as varchar) as interval_id, event_id, cast(user_id as varchar) as worker_id,
      (['main', 'subagent', 'automation'])[user_id % 3 + 1] as worker_kind, cast((user_id + event_id % 2) % 12 as varchar) as project_id,
      ts as start_at, ts + to_minutes(cast(floor(value) as bigint) + 1) as end_at,
      case event_type when 'error' then 'estimated' when 'view' then 'derived' else 'fact' end as quality, user_id % 3 <> 0 as is_autonomous,
      case when user_id % 3 = 1 then cast(user_id - 1 as varchar) end as parent_id
    from ev""",
    "ev",
)


def _intervals(prefix: str, zone: str | None) -> None:
    def start(n: int) -> str:
        if zone is None:
            return f"timestamp '2024-01-30 00:00:00' - interval {n - 1} day"
        return f"timezone('UTC', timezone('{zone}', timestamp '2024-01-30 00:00:00' - interval {n - 1} day))"

    view(
        f"{prefix}period",
        f"""select 'today' as period, 1 as n, {start(1)} as since union all select 'sevenDays', 7, {start(7)} union all select 'twentyEightDays', 28, {start(28)}""",
    )
    view(
        f"{prefix}clip",
        f"""select period, interval_id, event_id, worker_id, worker_kind, project_id, quality, is_autonomous,
          greatest(start_at, since) as start_at, least(end_at, {EVENTS_NOW}) as end_at
        from f2, {prefix}period where quality <> 'estimated' and end_at > since and start_at < {EVENTS_NOW}""",
        "f2", f"{prefix}period",
    )
    view(
        f"{prefix}mark",
        f"""select *, max(end_at) over (partition by period, worker_id order by start_at, interval_id rows between unbounded preceding and 1 preceding) as reach from {prefix}clip""",
        f"{prefix}clip",
    )
    view(
        f"{prefix}isl0",
        f"""select *, sum(case when reach is null or start_at > reach then 1 else 0 end) over (partition by period, worker_id order by start_at, interval_id) as g from {prefix}mark""",
        f"{prefix}mark",
    )
    view(
        f"{prefix}isl",
        f"""select period, worker_id, arg_min(interval_id, (start_at, interval_id)) as interval_id, arg_min(project_id, (start_at, interval_id)) as project_id,
          arg_min(worker_kind, (start_at, interval_id)) as worker_kind, min(start_at) as start_at, max(end_at) as end_at,
          case when bool_or(quality = 'derived') then 'derived' else 'fact' end as quality, bool_or(is_autonomous) as is_autonomous
        from {prefix}isl0 group by period, worker_id, g""",
        f"{prefix}isl0",
    )
    local = "d" if zone is None else f"timezone('UTC', timezone('{zone}', d))"
    view(
        f"{prefix}days",
        f"""select period, cast(d as date) as day, {local} as day_from, {local.replace('d)', "d + interval 1 day)") if zone else "d + interval 1 day"} as day_to
        from (select period, unnest(generate_series(timestamp '2024-01-30 00:00:00' - to_days(n - 1), timestamp '2024-01-30 00:00:00', interval 1 day)) as d from {prefix}period)""",
        f"{prefix}period",
    )
    view(
        f"{prefix}piece",
        f"""select i.period, day, worker_id, is_autonomous, greatest(start_at, day_from) as start_at, least(end_at, day_to) as end_at
        from {prefix}isl i join {prefix}days d on d.period = i.period and i.start_at < day_to and i.end_at > day_from""",
        f"{prefix}isl", f"{prefix}days",
    )
    view(
        f"{prefix}dayopen",
        f"""select period, day, sum(step) over (partition by period, day order by t) as n
        from (select period, day, t, sum(step) as step from (
          select period, day, start_at as t, 1 as step from {prefix}piece union all select period, day, end_at, -1 from {prefix}piece) group by period, day, t)""",
        f"{prefix}piece",
    )
    view(
        f"{prefix}points",
        f"""select d.period, {day('d.day')} as day, coalesce(a.agents, 0) as agents, coalesce(a.micros, 0) as micros, cast(coalesce(o.peak, 0) as bigint) as peak, coalesce(a.autonomous, false) as autonomous
        from {prefix}days d
        left join (select period, day, count(distinct worker_id) as agents, cast(sum(epoch_us(end_at) - epoch_us(start_at)) as bigint) as micros, bool_or(is_autonomous) as autonomous from {prefix}piece group by period, day) a on a.period = d.period and a.day = d.day
        left join (select period, day, max(n) as peak from {prefix}dayopen group by period, day) o on o.period = d.period and o.day = d.day""",
        f"{prefix}piece", f"{prefix}dayopen", f"{prefix}days",
    )


_intervals("u", None)
_intervals("z", "America/Los_Angeles")

view(
    "usweep",
    """select *, epoch_us(lead(t) over (partition by period order by t)) - epoch_us(t) as span, sum(step) over (partition by period order by t) as n
    from (select period, t, sum(step) as step from (select period, start_at as t, 1 as step from uisl union all select period, end_at, -1 from uisl) group by period, t)""",
    "uisl",
)
view(
    "uline",
    """select period, cast(coalesce(sum(case when n > 0 then span end), 0) as bigint) as active_micros,
      cast(coalesce(sum(case when n >= 2 then span end), 0) as bigint) as parallel_micros, cast(max(n) as bigint) as peak from usweep group by period""",
    "usweep",
)
view("uwork", "select period, cast(sum(epoch_us(end_at) - epoch_us(start_at)) as bigint) as worked_micros from uisl group by period", "uisl")
view(
    "pmark",
    """select *, max(end_at) over (partition by period, project_id order by start_at, end_at rows between unbounded preceding and 1 preceding) as reach from uisl""",
    "uisl",
)
view("pisl0", "select *, sum(case when reach is null or start_at > reach then 1 else 0 end) over (partition by period, project_id order by start_at, end_at) as g from pmark", "pmark")
view("pisl", "select period, project_id, min(start_at) as start_at, max(end_at) as end_at from pisl0 group by period, project_id, g", "pisl0")
view(
    "umulti",
    """select period, cast(coalesce(sum(case when n >= 2 then span end), 0) as bigint) as multi_micros from (
      select period, epoch_us(lead(t) over (partition by period order by t)) - epoch_us(t) as span, sum(step) over (partition by period order by t) as n
      from (select period, t, sum(step) as step from (select period, start_at as t, 1 as step from pisl union all select period, end_at, -1 from pisl) group by period, t)) group by period""",
    "pisl",
)
view(
    "ubase",
    """select period, sum(us) as worked, coalesce(sum(case when is_autonomous then us end), 0) as autonomous, coalesce(sum(case when worker_kind = 'subagent' then us end), 0) as delegated,
      coalesce(max(case when is_autonomous then us end), 0) as longest, count(distinct case when is_autonomous then cast(start_at as date) end) as autonomous_days,
      count(distinct worker_id) as agents, count(distinct project_id) as projects, sum(us * case quality when 'fact' then 10 else 9 end) as weighted
    from (select *, epoch_us(end_at) - epoch_us(start_at) as us from uisl) group by period""",
    "uisl",
)
view(
    "ueff",
    "select period, sum(least(us, 3600000000)) / 3600000000.0 as effective_workers from (select period, worker_id, sum(epoch_us(end_at) - epoch_us(start_at)) as us from uisl group by period, worker_id) group by period",
    "uisl",
)
view(
    "uact",
    "select period, count(case when micros >= 900000000 or (agents > 0 and autonomous) then 1 end) as active_days from upoints group by period",
    "upoints",
)
view(
    "umetric",
    """select p.period, cast(l.active_micros as double) as active, l.parallel_micros / cast(l.active_micros as double) as parallel_share, m.multi_micros / cast(l.active_micros as double) as multi_share,
      l.peak, w.worked_micros / cast(l.active_micros as double) as average_parallelism, b.worked / 3.6e9 as ai_hours, b.autonomous / cast(b.worked as double) as autonomous_share,
      b.delegated / cast(b.worked as double) as delegated_share, b.longest / 3.6e9 as longest, b.autonomous_days, b.agents, b.projects,
      cast(b.weighted as double) / 10 / b.worked as confidence, e.effective_workers, a.active_days,
      b.worked / 3.6e9 / a.active_days as daily_hours, b.autonomous_days / cast(a.active_days as double) as autonomous_day_share
    from uperiod p join uline l using (period) join uwork w using (period) join umulti m using (period) join ubase b using (period) join ueff e using (period) join uact a using (period)""",
    "uperiod", "uline", "uwork", "umulti", "ubase", "ueff", "uact",
)


def _log(x: str, ref: float) -> str:
    return f"least(1.0, ln(1 + {x}) / ln(1 + {ref}))"


def _lin(x: str, ref: float) -> str:
    return f"least(greatest({x} / {ref}, 0.0), 1.0)"


view(
    "udim",
    f"""select *, 100 * (0.7 * {_log('effective_workers', 12.0)} + 0.3 * {_log('peak', 6.0)}) as span,
      100 * (0.7 * {_log('daily_hours', 8.0)} + 0.3 * {_log('average_parallelism', 3.0)}) as leverage,
      100 * (0.45 * {_lin('delegated_share', 0.6)} + 0.35 * {_lin('parallel_share', 0.5)} + 0.2 * {_lin('multi_share', 0.35)}) as orchestration,
      100 * (0.5 * {_lin('autonomous_share', 0.6)} + 0.3 * {_log('longest', 2.0)} + 0.2 * {_lin('autonomous_day_share', 0.7)}) as autonomy from umetric""",
    "umetric",
)
view(
    "uscore",
    """select *, case when raw = 100 and (active_days < 28 or confidence < 0.95) then 99 else raw end as score from (
      select *, least(greatest(cast(round(core * maturity) as bigint), 0), 100) as raw from (
        select *, 100 * exp(0.3 * ln(greatest(span, 1) / 100) + 0.3 * ln(greatest(leverage, 1) / 100) + 0.25 * ln(greatest(orchestration, 1) / 100) + 0.15 * ln(greatest(autonomy, 1) / 100)) as core,
          case when active_days >= 28 then 1.0 else least(1.0, 0.2 + 0.8 * (1 - exp(-active_days / 6.0))) end as maturity from udim))""",
    "udim",
)

# ------------------------------------------------------------------------- F3

view(
    "f3",
    """select cast(o_orderkey as varchar) as thread_id, o_orderkey as n, case when o_orderkey % 13 <> 0 then o_orderpriority end as title,
      case when o_orderkey % 11 = 0 then '' else 'order ' || o_orderkey end as preview, case when c_nationkey = 0 then '' else '/w/' || n_name end as cwd,
      cast(floor(o_totalprice) as bigint) as tokens_used, o_orderdate - interval 1 day as created_at, u as updated_at,
      case when o_orderkey % 7 <> 0 then u + to_seconds(o_orderkey % 7200) end as recency_at, case when o_orderkey % 3 <> 0 then u end as archived_at,
      o_orderstatus = 'F' as archived, case o_orderkey % 5 when 0 then 'subagent' when 1 then 'automation' else 'user' end as thread_source,
      '/logs/' || (o_orderkey % 5000) || '.jsonl' as log_path
    from (select *, o_orderdate + to_seconds(o_orderkey % 86400) as u from orders) join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey""",
)
view(
    "boardt",
    """select * replace (mv as updated_at, mv - interval 1 day as created_at, case when recency_at is not null then mv + interval 20 minute end as recency_at, case when archived_at is not null then mv + interval 5 minute end as archived_at)
    from (select *, timestamp '2001-08-01 00:00:00' - to_days(cast(n % 3 as int)) + to_seconds(n * 7 % 43200) as mv from f3)""",
    "f3",
)
TITLE = """(select case when length(v) <= 48 then v else substr(v, 1, 45) || '...' end from (select regexp_replace(coalesce(
  nullif(regexp_replace({a}, '^\\s+|\\s+$', '', 'g'), ''), nullif(regexp_replace({b}, '^\\s+|\\s+$', '', 'g'), ''), 'Untitled'), '\\s+', ' ', 'g') as v))"""
view(
    "bopen",
    f"""select thread_id || case when moment >= {ORDERS_NOW} - interval 2 hour then 'active' else 'pending' end as item_id, thread_id, {TITLE.format(a='title', b='preview')} as title,
      regexp_extract(cwd, '([^/]+)/*$', 1) as detail, moment as updated_at, case when tokens_used > 0 then tokens_used end as tokens,
      case when moment >= {ORDERS_NOW} - interval 2 hour then 'active' else 'pending' end as column_kind,
      case when moment >= {ORDERS_NOW} - interval 2 hour then 'recentlyActive' else 'continueLater' end as display_state
    from (select *, coalesce(recency_at, updated_at) as moment from boardt) where not archived and thread_source <> 'subagent' and preview <> ''
      and (updated_at >= timestamp '2001-08-01' or recency_at >= timestamp '2001-08-01' or created_at >= timestamp '2001-08-01')""",
    "boardt",
)
view(
    "bdone",
    f"""select thread_id || 'done' as item_id, thread_id, {TITLE.format(a='title', b='preview')} as title, regexp_extract(cwd, '([^/]+)/*$', 1) as detail, moment as updated_at,
      case when tokens_used > 0 then tokens_used end as tokens, 'done' as column_kind, 'archived' as display_state
    from (select *, coalesce(archived_at, updated_at) as moment from boardt) where archived and thread_source <> 'subagent' and moment >= timestamp '2001-08-01'""",
    "boardt",
)
view("bitem", "select * from bopen union all select * from bdone", "bopen", "bdone")

# ------------------------------------------------------------------------- F4

view(
    "f4",
    """select runtime, event_id as snapshot_id, ts as captured_at, value as p_used, mins as p_mins, ts + to_minutes(mins) as p_reset,
      n_value as s_used, n_mins as s_mins, n_ts + to_minutes(n_mins) as s_reset, n_id from (
        select *, row_number() over w as rn, lead(event_id) over w as n_id, lead(value) over w as n_value, lead(mins) over w as n_mins, lead(ts) over w as n_ts
        from (select cast(user_id as varchar) as runtime, event_id, ts, value, ([300, 10080, 43800, 300, null, 1440])[k % 6 + 1] as mins from ev)
        window w as (partition by runtime order by ts, event_id)) where rn % 2 = 1""",
    "ev",
)
KIND = "case when {m} = 300 then 'fiveHour' when {m} = 10080 then 'sevenDay' when {m} between 40320 and 44640 then 'monthly' else 'unclassified' end"
view(
    "slots",
    f"""select runtime, snapshot_id, captured_at, 'primary' as slot, p_used as used_percent, p_mins as window_mins, p_reset as resets_at, {KIND.format(m='p_mins')} as kind from f4
    union all select runtime, snapshot_id, captured_at, 'secondary', s_used, s_mins, s_reset, {KIND.format(m='s_mins')} from f4 where n_id is not null""",
    "f4",
)
view(
    "uniq",
    """select runtime, snapshot_id, captured_at, count(case when kind = 'fiveHour' then 1 end) as "fiveHour_count", count(case when kind = 'sevenDay' then 1 end) as "sevenDay_count",
      count(case when kind = 'monthly' then 1 end) as monthly_count, count(case when kind = 'unclassified' then 1 end) as unclassified,
      case when count(case when kind = 'fiveHour' then 1 end) = 1 then max(case when kind = 'fiveHour' then used_percent end) end as "fiveHour_used",
      case when count(case when kind = 'sevenDay' then 1 end) = 1 then max(case when kind = 'sevenDay' then used_percent end) end as "sevenDay_used",
      case when count(case when kind = 'monthly' then 1 end) = 1 then max(case when kind = 'monthly' then used_percent end) end as monthly_used
    from slots group by runtime, snapshot_id, captured_at""",
    "slots",
)
view(
    "commit0",
    """select runtime, snapshot_id, captured_at, ok, case when ok then "fiveHour_used" end as "fiveHour_used", case when ok then "sevenDay_used" end as "sevenDay_used", case when ok then monthly_used end as monthly_used
    from (select *, unclassified = 0 and "fiveHour_count" <= 1 and "sevenDay_count" <= 1 and monthly_count <= 1 as ok from uniq)""",
    "uniq",
)
view(
    "lastq",
    f"""select runtime, captured_at, case when looked_at - captured_at > interval 900 second then 'stale' when has_quota then 'available' when n % 3 <> 0 then 'localOnly' when n % 2 = 0 then 'snapshotNeeded' else 'unavailable' end as status
    from (select user_id as n, cast(user_id as varchar) as runtime, case when user_id % 4 = 0 then {EVENTS_NOW} else max(ts) + interval 10 minute end as looked_at from ev group by user_id)
    left join (select runtime, captured_at, coalesce("fiveHour_used", "sevenDay_used", monthly_used) is not null as has_quota from (
      select *, row_number() over (partition by runtime order by captured_at desc, snapshot_id desc) as rn from commit0) where rn = 1 and cast(runtime as bigint) % 5 <> 0) using (runtime)""",
    "commit0", "ev",
)

# ------------------------------------------------------------------ F5, F6, F7

WIDE = "[\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}\\x{3040}-\\x{30FF}\\x{AC00}-\\x{D7AF}]"
BLANK = "[\\s\\p{Z}\\x0B\\x{85}]"


def text_tokens(column: str) -> str:
    seen = f"regexp_replace({column}, '{BLANK}', '', 'g')"
    narrow = f"length(regexp_replace({seen}, '{WIDE}', '', 'g'))"
    return f"(case when {column} = '' then 0 else greatest(1, cast(ceil({narrow} / 3.8::double + (length({seen}) - {narrow})) as bigint)) end)"


PATH = "regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)"
view("cat", f"select page_id, {PATH} as skill_path, cast(strlen(html) as bigint) as byte_count, {text_tokens('html')} as token_estimate from pages")
view(
    "loads",
    "select cast(user_id as varchar) as thread_id, event_id as seq, ts, coalesce(c.skill_path, '/missing/' || want) as skill_path from (select *, event_id % (select count(*) + 1 + count(*) // 10 from pages) as want from ev) left join cat c on c.page_id = want",
    "ev", "cat",
)
view(
    "skillrank",
    """select l.skill_path, regexp_extract(l.skill_path, '([^/]+)/+[^/]+/*$', 1) as name, l.skill_path as source_label, load_count, thread_count, last_loaded_at, byte_count, token_estimate
    from (select skill_path, count(*) as load_count, count(distinct thread_id) as thread_count, max(ts) as last_loaded_at from loads group by skill_path) l
    left join (select skill_path, min((byte_count, token_estimate)) as s, s[1] as byte_count, s[2] as token_estimate from cat group by skill_path) c using (skill_path)""",
    "loads", "cat",
)
view(
    "f6",
    f"""select *, n as input, n // 3 as cache_read, n // 5 as cache_create, case when role = 'assistant' then n else 0 end as output from (
      select 'c/' || lpad(cast(conv_id as varchar), 8, '0') as file_path, turn as line_no, conv_id, cast(conv_id as varchar) as session_id, role,
      timestamp '2024-01-01' + to_hours(cast(conv_id % 700 as int)) + to_minutes(cast(turn as int)) as ts, case when role <> 'system' then conv_id || '-' || (turn // 2) end as message_id,
      case when role = 'assistant' then {pick(('claude-opus-4', 'claude-sonnet-4', 'claude-haiku-4', 'unknown-model'), 'conv_id')} end as model,
      case when turn % 3 = 0 then '/w/c' || (conv_id % 8 + turn) end as cwd, '/w/c' || (conv_id % 8) as seed_project, {pick(TOOLS, 'turn')} as tool_name, {text_tokens('text')} as n from conversations)""",
)
view(
    "f6c",
    """select *, last_value(model ignore nulls) over w as c_model, coalesce(last_value(cwd ignore nulls) over w, seed_project) as project_path from f6
    window w as (partition by file_path order by line_no rows unbounded preceding)""",
    "f6",
)
view(
    "f6v",
    """select *, input + cache_create + cache_read as input_tokens, cache_create + cache_read as cached_input_tokens, output as output_tokens, cast(0 as bigint) as reasoning_output_tokens,
      input + cache_create + cache_read + output as total_tokens from f6c where input + output > 0""",
    "f6c",
)
view(
    "f6l",
    """select 'transcript' as runtime, session_id as thread_id, line_no as seq, project_path, c_model as model, ts, input_tokens, cached_input_tokens, output_tokens, reasoning_output_tokens, total_tokens,
      (input_tokens - cached_input_tokens) * p + cached_input_tokens * p // 10 + output_tokens * p * 5 as nano, file_path, line_no, message_id from (
      select *, case when c_model like '%opus%' then 15000 when c_model like '%sonnet%' then 3000 when c_model like '%haiku%' then 800 else 0 end as p,
        row_number() over (partition by coalesce(message_id, file_path || '#' || line_no) order by file_path, line_no) as nth from f6v) where nth = 1""",
    "f6v",
)
view(
    "f7",
    """select cast(user_id as varchar) as thread_id, event_id as event_seq, ts, k,
      case event_type when 'click' then 'turn/started' when 'purchase' then 'turn/completed' when 'view' then 'thread/status/changed' when 'error' then 'item/completed' else 'thread/list' end as method,
      case event_type when 'purchase' then (['completed', 'failed', 'interrupted'])[k % 3 + 1] when 'view' then (['active', 'active', 'idle', 'systemError'])[k % 4 + 1]
        when 'error' then case when k % 2 = 0 then 'failed' else 'completed' end when 'signup' then 'idle' end as status,
      case when event_type = 'view' and k % 4 = 1 then 'waitingOnUserInput' end as flag,
      case when event_type in ('click', 'purchase') then user_id || '-' || sum(case when event_type = 'click' then 1 else 0 end) over (partition by user_id order by event_id) end as turn_id,
      case when event_type = 'signup' then 'thread ' || user_id end as name from ev""",
    "ev",
)
STATE = """case method when 'turn/started' then 'running' when 'turn/completed' then case status when 'completed' then 'completed' when 'failed' then 'failed' when 'interrupted' then 'interrupted' else 'recorded' end
  when 'item/completed' then case when status = 'failed' then 'failed' end
  else case when status = 'active' and flag = 'waitingOnUserInput' then 'waitingInput' when status = 'active' then 'running' when status = 'idle' then 'idle' when status = 'systemError' then 'failed' else 'recorded' end end"""
FOLD = """select thread_id, arg_max(state, event_seq) as state, arg_max(name, event_seq) filter (name is not null) as name,
  arg_max(turn_id, event_seq) filter (turn_id is not null) as turn_id, arg_max(ts, event_seq) as updated_at, max(event_seq) as event_seq
  from (select *, {state} as state from {source}) where state is not null {extra} group by thread_id"""
view(
    "livee",
    "select * replace (cast(event_seq * 2 % (select count(*) from events) as varchar) as thread_id, timestamp '2001-08-01' + to_seconds(event_seq * 5 % 43200) as ts) from f7",
    "f7",
)
view("live", FOLD.format(state=STATE, source="livee", extra=""), "livee")
view(
    "merged",
    f"""select case when b.thread_id is not null then b.item_id else 'live-' || l.thread_id end as item_id, coalesce(b.thread_id, l.thread_id) as thread_id,
      case when b.thread_id is not null then b.title else coalesce(l.name, 'Live task') end as title,
      case when b.thread_id is null then l.updated_at when l.thread_id is null then b.updated_at else coalesce(l.updated_at, b.updated_at) end as updated_at, b.tokens,
      case when b.thread_id is null then case when l.state in ('running', 'waitingInput') then 'active' when l.state = 'completed' then 'done' else 'pending' end
        when l.thread_id is null then b.column_kind when b.display_state = 'archived' then 'done' when l.updated_at >= {ORDERS_NOW} - interval 2 hour then 'active' else 'pending' end as column_kind,
      case when b.thread_id is null then 'recentlyActive' when l.thread_id is null then b.display_state when b.display_state = 'archived' then 'archived'
        when l.updated_at >= {ORDERS_NOW} - interval 2 hour then 'recentlyActive' else 'continueLater' end as display_state,
      coalesce(l.state, 'recorded') as runtime_state, l.thread_id is not null as is_realtime
    from bitem b full outer join (select * from live where state not in ('recorded', 'disconnected')) l on l.thread_id = b.thread_id""",
    "bitem", "live",
)

# =============================================================== scans and sinks

twin(
    "s01_session_log_scan",
    """select thread_id, line_type, count(*) as line_count, cast(sum(line_no) as bigint) as line_no_sum, cast(sum(cum) as bigint) as cum_total, cast(sum(li) as bigint) as last_input,
      count(case when has_cum then 1 end) as with_cum, max(ts) as last_ts, max(parent) as parent, max(model) as model from (
      select thread_id, 'token_count' as line_type, line_no * 5 as line_no, s_t as cum, l_i as li, has_cum, ts, null as parent, null as model from forkline
      union all select thread_id, 'session_meta', line_no * 5 + 1, null, null, false, ts, parent, null from forkline where line_no % 5 = 0
      union all select thread_id, 'turn_context', line_no * 5 + 3, null, null, false, ts, null, 'gpt-5.' || (line_no % 3) from forkline where line_no % 7 = 0) group by thread_id, line_type""",
    "forkline",
)
twin(
    "s01_tool_calls",
    f"select thread_id, {pick(TOOLS, 'line_no')} as tool_name, count(*) as call_count, cast(sum(line_no * 5 + 4) as bigint) as seq_sum, max(ts) as last_ts from forkline where line_no % 4 < 2 group by 1, 2",
    "forkline",
)
twin(
    "s02_transcript_scan",
    f"""select session_id, line_no, ts, message_id, c_model as model, project_path, {', '.join(TOKENS)}, cast(1 as bigint) as tool_uses from f6v""",
    "f6v",
)
twin(
    "s03_threads_with_logs",
    """select log_path, thread_id, tokens_used, updated_at from (select *, row_number() over (partition by log_path order by updated_at, thread_id) as rn from f3 where tokens_used > 0) where rn = 1""",
    "f3",
)
STATUSES = ("in_progress", "Active", " running ", "pending", "failed", "ERROR", "blocked", "scheduled", "completed", "done", "success", "weird", None)
view(
    "taskdoc",
    f"""select '/tasks/' || n || '.json' as path, status,
      case when n % 5 = 4 then cast(n as varchar) when n % 3 = 0 then 'task ' || n when n % 3 = 1 then 'title ' || n else cast(n as varchar) end as title,
      case when n % 5 = 4 then date_trunc('millisecond', ts) when n % 2 = 0 then ts else ts + interval 1 hour end as updated_at,
      case when n % 5 = 4 then '/w/cwd/' when n % 4 = 0 then '/w/p' || (n % 9) end as project
    from (select event_id as n, ts, {pick(STATUSES, 'event_id')} as status from ev) where n % 10 <> 9""",
    "ev",
)
twin("s04_task_documents", "select * from taskdoc", "taskdoc")
twin(
    "s05_skill_counters",
    """select '/g/' || event_id as path, u.skill_name, u.load_count, u.last_loaded_at from (
      select event_id, unnest(case when event_id % 7 = 0 then [{'skill_name': 'only', 'load_count': greatest(k, 1), 'last_loaded_at': null}]
        else [{'skill_name': 'plain', 'load_count': greatest(k, 1), 'last_loaded_at': null}, {'skill_name': 'object', 'load_count': greatest(k - 5, 1), 'last_loaded_at': date_trunc('millisecond', ts)},
          {'skill_name': 'snake', 'load_count': 7, 'last_loaded_at': null}, {'skill_name': 'bare', 'load_count': 1, 'last_loaded_at': null}] end) as u from ev)""",
    "ev",
)
WEEK = ("SU", "MO", "TU", "WE", "TH", "FR", "SA")
view(
    "f8s",
    f"""select p_partkey as n, cast(p_partkey as varchar) as schedule_id, p_name as name, {pick(('WEEKLY', 'DAILY', 'HOURLY'), 'p_partkey')} as freq, {pick(('UTC', 'Asia/Shanghai', 'America/Los_Angeles'), 'p_partkey')} as zone,
      p_size % 24 as h, p_partkey % 60 as m, {pick(WEEK, 'p_partkey % 7')} as d1, {pick(WEEK, 'p_partkey % 7 + 2')} as d2 from part""",
)
twin(
    "s06_schedule_files",
    """select case when n % 4 <> 0 then 's' || n else cast(n as varchar) end as schedule_id, case when n % 3 <> 0 then 'say "' || name || '"' when n % 4 <> 0 then 's' || n else cast(n as varchar) end as name,
      case when n % 2 = 0 then 'heartbeat' else 'cron' end as kind,
      'DTSTART;TZID=' || zone || ':20240101T090000' || chr(10) || 'RRULE:FREQ=' || freq || ';BYHOUR=' || h || ';BYMINUTE=' || m || case when freq = 'WEEKLY' then ';BYDAY=' || d1 || ',' || d2 else '' end || case when n % 10 = 0 then ';INTERVAL=2' else '' end as rrule
    from f8s where n % 5 <> 0""",
    "f8s",
)
twin("s07_skill_catalog", "select page_id, skill_path, byte_count, token_estimate from cat", "cat")
twin(
    "s07_skill_files",
    f"select '/home/u/.agent/skills/' || page_id || '/SKILL.md' as skill_path, case when page_id % 11 <> 7 then cast(octet_length(encode(html)) as bigint) end as byte_count, case when page_id % 11 <> 7 then {text_tokens('html')} end as token_estimate from pages where html is not null",
)
twin(
    "s08_changed_files",
    """select 'd/' || doc_id as file_path, 'changed' as state from documents where doc_id % 7 <> 0 and (doc_id % 3 = 0 or doc_id % 5 = 0 or doc_id % 11 = 0)
    union all select 'd/' || doc_id, 'live' from documents where doc_id % 7 <> 0 and doc_id % 3 <> 0""",
)
twin(
    "s08_refreshed_store",
    "select message_id, model, count(*) as line_count, cast(sum(input) as bigint) as input, cast(sum(output) as bigint) as output, cast(sum(cache_read) as bigint) as cache_read from f6 where conv_id % 5 <> 1 group by 1, 2",
    "f6",
)
twin("s09_pruned_threads", "select thread_id, updated_at from f3 where updated_at >= timestamp '2001-08-01' - interval 34 day", "f3")
twin(
    "s10_runtime_union",
    f"""select runtime, thread_id, seq, project_path, model, ts, {', '.join(TOKENS)}, {micro('nano')} as cost_usd, 'detailed' as source_quality from f1p
    union all select runtime, thread_id, seq, project_path, model, ts, {', '.join(TOKENS)}, {micro('nano')}, 'detailed' from f6l""",
    "f1p", "f6l",
)
twin(
    "s11_snapshot_document",
    """select 2 as schema_version, '2024-01-30T23:59:59.000Z' as refreshed_at, cast(sum(total_tokens) as bigint) as lifetime_tokens, count(*) as token_events, 7 as day_count,
      least(8, count(distinct case when ts >= timestamp '2024-01-24' then project_path end)) as project_count, 9 as tool_count,
      least(20, (select count(distinct skill_path) from loads)) as skill_count,
      (select project_path from f1 where ts >= timestamp '2024-01-24' group by project_path order by sum(total_tokens) desc, substr(project_path, 4) limit 1) as first_project,
      (select tool_name from calls group by tool_name order by count(*) desc, tool_name limit 1) as first_tool, 3 as report_count from f1""",
    "f1", "loads", "calls",
)
twin(
    "s12_notifications",
    "select thread_id, event_seq, method, status, flag, turn_id, name, event_seq % 11 = 0 as hidden from f7 where event_seq % 7 <> 0",
    "f7",
)

twin(
    "s12_tailed_notifications",
    "select thread_id, event_seq, method, status, flag, turn_id, name, event_seq % 11 = 0 as hidden from f7 where event_seq % 7 <> 0",
    "f7",
)

# =================================================================== projections

twin(
    "p01_token_split",
    "select thread_id, seq, cached_input_tokens as billable_cached, input_tokens - cached_input_tokens as uncached, total_tokens as visible_total, input_tokens + output_tokens as split_total from f1",
    "f1",
)
MODELS = ("GPT-5.5-Pro", "gpt-5.5-2026", "chat-latest", " gpt-5.4-mini ", "gpt-5.4-nano-x", "openai/gpt-5.4-pro", "gpt-5.4", "gpt-5.3-codex", "gpt-5.2-chat",
          "gpt-5-codex-mini", "gpt-5", "gpt-4o", "Claude-Opus-4", "claude-sonnet-4", "claude-3-haiku", "", "   ", None)
view("mnames", f"select event_id, {pick(MODELS, 'event_id')} as model, event_id % {len(MODELS)} as m, case when event_id % 4 <> 0 then 'Thread-Model ' end as thread_model from ev", "ev")
twin(
    "p02_model_price",
    """select event_id, model,
      cast((case when m in (0, 5) then 30 when m in (1, 2) then 5 when m = 3 then 0.75 when m = 4 then 0.2 when m = 6 then 2.5 when m in (7, 8) then 1.75 when m in (9, 10) then 1.25 else 5 end) as double) as log_input,
      cast((case when m in (0, 5) then 30 when m in (1, 2) then 0.5 when m = 3 then 0.075 when m = 4 then 0.02 when m = 6 then 0.25 when m in (7, 8) then 0.175 when m in (9, 10) then 0.125 else 0.5 end) as double) as log_cached,
      cast((case when m in (0, 5) then 180 when m in (1, 2) then 30 when m = 3 then 4.5 when m = 4 then 1.25 when m = 6 then 15 when m in (7, 8) then 14 when m in (9, 10) then 10 else 30 end) as double) as log_output,
      cast((case m when 12 then 15 when 13 then 3 when 14 then 0.8 end) as double) as transcript_input,
      cast((case m when 12 then 1.5 when 13 then 0.3 when 14 then 0.08 end) as double) as transcript_cached,
      cast((case m when 12 then 75 when 13 then 15 when 14 then 4 end) as double) as transcript_output from mnames""",
    "mnames",
)
twin("p03_cost", f"select thread_id, seq, {micro('nano')} as cost_usd from f1p", "f1p")
twin(
    "p04_model_name",
    """select event_id, nullif(trim(model), '') as model_name, coalesce(lower(nullif(trim(model), '')), 'unrecorded-model') as model_id, coalesce(nullif(trim(model), ''), trim(thread_model)) as resolved from mnames""",
    "mnames",
)
twin(
    "p05_timestamp_parse",
    """select o_orderkey, case when o_orderkey % 7 = 2 then moment - interval 2 hour when o_orderkey % 7 in (0, 1, 3, 4) then moment end as parsed
    from (select *, o_orderdate + to_seconds(o_orderkey % 86400) as moment from orders)""",
)
LA_DAY = "cast(timezone('America/Los_Angeles', timezone('UTC', ts)) as date)"
twin(
    "p06_day_key",
    f"""select event_id, {day('ts')} as day_utc, {day(LA_DAY)} as day_la, timezone('UTC', timezone('America/Los_Angeles', cast({LA_DAY} as timestamp))) as day_start_la from ev""",
    "ev",
)
twin(
    "p07_project_identity",
    """select distinct cwd, 1 as ids, case when cwd = '' then 'uncategorized' else substr(cwd, 4) end as name, cwd as decoded from f3""",
    "f3",
)
twin(
    "p08_title",
    f"select doc_id, {TITLE.format(a='t', b='source')} as title from (select doc_id, source, case when doc_id % 3 <> 0 then text end as t from documents)",
)
TOOL_NAMES = ("exec_command", "write_stdin", "Bash", "apply_patch", "MultiEdit", "Write", "web_search", "page_snapshot", "view_image", "figma_get", "read_docs", "Grep",
              "mcp__x", "list_resources", "update_plan", "TodoWrite", "Task", "create_goal", "WebFetch", "other")
twin(
    "p09_tool_category",
    f"""select event_id, t as tool_name,
      case when n in (0, 1) then 'terminal' when n in (3, 4) then 'edit' when n in (6, 7, 18) then 'browser' when n in (8, 9) then 'visual' when n in (10, 12, 13) then 'docs' when n in (14, 17) then 'planning' else 'tool' end as log_category,
      case when n = 2 then 'terminal' when n in (1, 3, 4, 5, 15) then 'edit' when n in (10, 11) then 'docs' when n in (6, 18) then 'browser' when n = 16 then 'planning' when n = 12 then 'mcp' else 'tool' end as transcript_category
    from (select event_id, event_id % {len(TOOL_NAMES)} as n, {pick(TOOL_NAMES, 'event_id')} as t from ev)""",
    "ev",
)
twin(
    "p10_skill_paths",
    """select event_id, '/home/u/.agents/skills/s' || user_id || '/SKILL.md' as skill_path from ev
    union all select event_id, '/opt/skills/s' || k || '/SKILL.md' from ev where event_id % 2 = 0
    union all select event_id, '/SKILL.md' from ev where event_id % 3 = 0""",
    "ev",
)
twin("p11_text_tokens", f"select doc_id, {text_tokens('text')} as token_estimate from documents")
twin(
    "p12_skill_source",
    """select event_id, case event_id % 6 when 0 then 'fam' || k || '/plug' when 1 then 'ai-infra' when 2 then 'agents' when 3 then 'system' when 4 then 'personal' else '~/other/s' || k || '/SKILL.md' end as label,
      case when event_id % 6 = 0 then 'a' else 's' || k end as name from ev""",
    "ev",
)
twin(
    "p13_worker_kind",
    """select thread_id, kind, automation_id, case when kind = 'automation' and automation_id is not null then 'log:automation:' || automation_id else 'log:' || kind || ':' || thread_id end as worker_id,
      kind <> 'main' as is_autonomous, kind = 'subagent' as subagent_file from (
      select thread_id, case when thread_source = 'user' then 'main' else thread_source end as kind, case when thread_source = 'automation' and n % 2 = 0 then 'a' || (n % 40) end as automation_id from f3)""",
    "f3",
)
twin("p14_remaining_percent", "select snapshot_id, slot, round(greatest(0, least(100, 100 - used_percent)), 6) as remaining_percent from slots", "slots")
twin(
    "p15_value_progress",
    f"""select project_path, day, round(case when a <= 200 then 0.28 * (a / 200) else 0.28 + 0.72 * (ln(1 + (a - 200) / 200) / ln(1 + 46300 / 200.0)) end, 6) as fraction,
      case when cost >= 200 then 200 when cost >= 100 then 100 when cost >= 20 then 20 end as milestone
    from (select *, greatest(0, least(cost, 46500)) as a from (select project_path, {day('ts')} as day, cast(sum(nano) as double) / 1e9 * 300 as cost from f1p group by 1, 2))""",
    "f1p",
)
STATUS_COLUMN = "case when s in (0, 1, 2) then 'active' when s = 7 then 'scheduled' when s in (8, 9, 10) then 'done' else 'pending' end"
STATUS_STATE = "case when s in (0, 1, 2) then 'running' when s = 3 then 'pending' when s in (4, 5) then 'failed' when s = 6 then 'blocked' when s = 7 then 'scheduled' when s in (8, 9, 10) then 'completed' else 'unknown' end"
twin(
    "p16_task_state",
    f"""select thread_id, case when updated_at >= {ORDERS_NOW} - interval 2 hour then 'active' else 'pending' end as activity,
      case when updated_at >= {ORDERS_NOW} - interval 2 hour then 'recentlyActive' else 'continueLater' end as activity_state, {STATUS_COLUMN} as task_column, {STATUS_STATE} as task_state
    from (select *, n % 13 as s from f3)""",
    "f3",
)
twin("p17_visible_threads", "select thread_id from f3 where thread_source <> 'subagent' and n % 4 <> 0 and n % 6 <> 3", "f3")

# ====================================================================== sequences

twin("t01_counter_deltas", "select * from cdelta", "cdelta")
twin(
    "t02_carry_model",
    """select l.thread_id, l.line_no, coalesce((select arg_max(struct_pack(m := t.model), t.line_no) from turnline t where t.thread_id = l.thread_id and t.line_no < l.line_no).m,
      case when cast(l.thread_id as bigint) % 4 <> 0 then 'thread-model' end) as model from tokline l""",
    "tokline", "turnline",
)
twin("t03_carry_attributes", "select session_id, line_no, c_model as model, project_path from f6c", "f6c")
twin("t04_fork_parents", "select thread_id, arg_max(parent, line_no) as parent_id from forkline where parent is not null and line_no % 7 <> 0 group by thread_id", "forkline")
twin("t05_inherited_prefix", "select * from kprefix", "kprefix")
twin(
    "t06_fork_dedup",
    """select thread_id, cast(greatest(tokens - coalesce(base, 0), 0) as bigint) as tokens_used, greatest(n - coalesce(prefix, 0), 0) as token_events, coalesce(kept_deltas, 0) as kept_deltas, cast(coalesce(kept_tokens, 0) as bigint) as kept_tokens
    from (select k.thread_id, sum(total_tokens) as tokens, sum(case when idx <= prefix then total_tokens end) as base, count(case when prefix is null or idx > prefix then 1 end) as kept_deltas,
        sum(case when prefix is null or idx > prefix then total_tokens end) as kept_tokens, any_value(prefix) as prefix from kidx k left join kprefix p on p.thread_id = k.thread_id group by k.thread_id)
    join (select thread_id, count(*) as n from kline group by thread_id) using (thread_id)""",
    "kidx", "kprefix",
)
twin(
    "s13_ledger_by_path",
    """select thread_id, greatest(n - coalesce(prefix, 0), 0) as token_events, kept_deltas, cast(coalesce(kept_tokens, 0) as bigint) as kept_tokens
    from (select k.thread_id, count(case when prefix is null or idx > prefix then 1 end) as kept_deltas,
        sum(case when prefix is null or idx > prefix then total_tokens end) as kept_tokens, any_value(prefix) as prefix from kidx k left join kprefix p on p.thread_id = k.thread_id group by k.thread_id)
    join (select thread_id, count(*) as n from kline group by thread_id) using (thread_id)""",
    "kidx", "kprefix",
)
twin("t07_message_dedup", "select file_path, line_no, message_id, total_tokens from f6l", "f6l")
twin("t08_usage_vector", f"select file_path, line_no, {', '.join(TOKENS)} from f6v", "f6v")
twin(
    "t09_turn_pairs",
    f"""select user_id || ':' || turn as interval_id, event_id as line_no, start_at, ts as end_at, case when user_id % 3 = 2 and user_id % 2 = 1 then 'derived' else 'fact' end as quality, user_id % 3 <> 0 as is_autonomous
    from (select *, coalesce(last_value(case when event_type = 'click' then ts end ignore nulls) over (partition by user_id, turn order by event_id rows unbounded preceding),
        case when k % 2 = 0 then ts - to_microseconds(cast(round(value * 1000 * 1000) as bigint)) end) as start_at
      from (select *, user_id || '-' || (k % 5) as turn from ev where event_type in ('click', 'purchase')))
    where event_type = 'purchase' and start_at >= timestamp '2024-01-04 23:59:58' and ts <= {EVENTS_NOW} + interval 5 second and ts > start_at""",
    "ev",
)
twin(
    "t10_duration_marks",
    """select event_id, user_id || ':' || epoch_us(ts) as interval_id, ts - to_microseconds(us) as start_at, ts as end_at, 'fact' as quality
    from (select *, cast(round(value * 1000 * 1000) as bigint) as us from ev where event_type <> 'view' and user_id % 3 = 0) where us > 0""",
    "ev",
)
twin("t11_lifetimes", "select file_path, min(ts) as start_at, max(ts) as end_at, 'derived' as quality from f6 group by file_path having max(ts) >= min(ts) + interval 1 second", "f6")
view(
    "dworker",
    """select worker_id, coalesce(min(case when p is not null then event_id end), max(event_id)) as pick from (select *, parent_id as p from f2) group by worker_id""",
    "f2",
)
twin(
    "t12_distinct_work",
    """select 'worker' as what, f.worker_id as id, f.project_id, case when f.event_id % 3 = 0 then f.parent_id end as parent_id, cast(null as timestamp) as start_at
      from f2 f join (select worker_id, coalesce(min(case when parent_id is not null and event_id % 3 = 0 then event_id end), max(event_id)) as pick from f2 group by worker_id) w on w.pick = f.event_id
    union all select 'interval', id, project_id, null, start_at from (
      select *, worker_id || ':' || strftime(start_at, '%Y-%m-%d') as id, row_number() over (partition by worker_id || ':' || strftime(start_at, '%Y-%m-%d') order by event_id) as rn from f2) where rn = 1""",
    "f2",
)

view(
    "worked",
    """select *, sub and 1 = 1 as is_sub, min(case when folder is not null then line_no end) over (partition by session_id) as named_at, first_value(folder ignore nulls) over (partition by session_id order by line_no rows between unbounded preceding and unbounded following) as home
    from (select *, conv_id % 3 = 1 as sub, case when conv_id % 5 <> 0 and line_no > 0 then cwd end as folder from f6)""",
    "f6",
)
view(
    "worker6",
    """select session_id, is_sub, any_value(conv_id) as conv_id, any_value(home) as home, min(ts) as first_at, max(ts) as last_at,
      'transcript:' || case when is_sub then 'subagent' else 'main' end || ':' || session_id as worker_id, case when is_sub then 'subagent' else 'main' end as worker_kind, coalesce(substr(any_value(home), 4), 'uncategorized') as project_name
    from worked group by session_id, is_sub""",
    "worked",
)
twin(
    "t12_transcript_work",
    """select 'worker' as what, worker_id as id, worker_kind, project_name, case when is_sub then 'transcript:main:' || (conv_id - 1) end as parent_id, null::timestamp as start_at, null::timestamp as end_at from worker6
    union all select 'interval', session_id || ':' || epoch_us(ts), 'main', case when line_no >= named_at then substr(home, 4) else 'uncategorized' end, 'transcript:main:' || session_id, ts - to_microseconds(cast(round((line_no + 1) * 1500.5 * 1000) as bigint)), ts from worked where not is_sub and role = 'assistant'
    union all select 'interval', '/t/p/' || (conv_id - 1) || '/subagents/agent-' || session_id || '.jsonl:lifecycle', worker_kind, project_name, worker_id, first_at, last_at from worker6 where is_sub and last_at >= first_at + interval 1 second""",
    "worked", "worker6",
)

# ========================================================================== joins

twin("j01_thread_parents", "select thread_id, case when n % 5 = 0 then cast(n - 1 as varchar) end as parent_id from f3", "f3")
twin(
    "j02_fork_pairs",
    "select c.thread_id, p.parent_id, c.idx, c.line_no, q.line_no as parent_line from kidx c join kparent p on p.thread_id = c.thread_id join kidx q on q.thread_id = p.parent_id and q.idx = c.idx",
    "kidx", "kparent",
)
twin(
    "j03_adjusted_threads",
    """select k.thread_id, cast(sum(case when prefix is null or idx > prefix then total_tokens else 0 end) as bigint) as tokens_used from kidx k left join kprefix p on p.thread_id = k.thread_id group by k.thread_id""",
    "kidx", "kprefix",
)
twin(
    "j04_active_workers",
    """select distinct i.period, i.worker_id, f.worker_kind, f.project_id from uisl i join dworker w on w.worker_id = i.worker_id join f2 f on f.event_id = w.pick""",
    "uisl", "dworker", "f2",
)
twin("j05_skill_sizes", "select skill_path, load_count, byte_count, token_estimate from skillrank", "skillrank")
view(
    "jfiles",
    """select distinct unnest([
      case when k % 5 = 0 then '/home/u/.claude/skills/s' || k || '/SKILL.md' end, case when k % 3 = 0 then '/r/repo' || r || '/.claude/skills/s' || k || '/SKILL.md' end,
      case when k % 2 = 0 then '/r/repo' || r || '/pkg/app/.claude/skills/s' || k || '/SKILL.md' end, case when k % 4 = 0 then '/home/u/.claude/commands/c' || k || '.md' end,
      case when k % 3 = 1 then '/r/repo' || r || '/pkg/.claude/commands/c' || k || '.md' end, case when k % 3 = 2 then '/r/repo' || r || '/apps/web/.claude/skills/s' || k || '/SKILL.md' end,
      case when k % 2 = 1 then '/home/u/.claude/plugins/m1/plug' || (k % 4) || '/skills/s' || k || '/SKILL.md' end, case when k % 9 = 1 then '/home/u/.claude/plugins/m2/plug' || (k % 4) || '/skills/s' || k || '/SKILL.md' end]) as path
    from (select k, user_id % 6 as r from ev)""",
    "ev",
)
view(
    "jreq",
    """select distinct r, k, n, case n when 0 then 's' || k when 1 then 'c' || k when 2 then 'plug' || (k % 4) || ':s' || k when 3 then 'apps/web:s' || k when 4 then '../up' when 5 then '/s' || k else 'none' || k end as skill_name,
      '/r/repo' || r || '/pkg/app' as project_path from (select k, user_id % 6 as r, event_id % 7 as n from ev)""",
    "ev",
)
DIRS = "(case when r < 5 then ['/r/repo' || r || '/pkg/app', '/r/repo' || r || '/pkg', '/r/repo' || r] else ['/r/repo' || r || '/pkg/app'] end)"
view(
    "jcand",
    f"""select skill_name, project_path, u.rank, u.path from (select *, unnest(list_transform(range(len(paths)), lambda i: struct_pack(rank := i, path := paths[i + 1]))) as u from (
      select *, ['/home/u/.claude/skills/' || bare || '/SKILL.md'] || list_transform({DIRS}, lambda d: d || '/.claude/skills/' || bare || '/SKILL.md')
        || ['/home/u/.claude/commands/' || bare || '.md'] || list_transform({DIRS}, lambda d: d || '/.claude/commands/' || bare || '.md') as paths
      from (select *, ltrim(skill_name, '/') as bare from jreq where n in (0, 1, 5, 6))))""",
    "jreq",
)
view(
    "jqual",
    f"""select skill_name, project_path, list_distinct(list(path)) as hits from (
      select q.skill_name, q.project_path, f.path from (select *, split_part(skill_name, ':', 1) as space, split_part(skill_name, ':', 2) as tail, {DIRS} as dirs from jreq where n in (2, 3)) q
      join jfiles f on f.path = dirs[1] || '/' || space || '/.claude/skills/' || tail || '/SKILL.md' or f.path = dirs[-1] || '/' || space || '/.claude/skills/' || tail || '/SKILL.md'
        or (f.path like '/home/u/.claude/plugins/%' and f.path like '%/' || space || '/skills/' || tail || '/SKILL.md')) group by 1, 2""",
    "jreq", "jfiles",
)
twin(
    "j06_skill_names",
    """select a.skill_name, a.project_path, coalesce(b.path, case when len(c.hits) = 1 then c.hits[1] end) as resolved_path
    from (select distinct skill_name, project_path from jreq) a
    left join (select skill_name, project_path, arg_min(path, rank) as path from jcand where path in (select path from jfiles) group by 1, 2) b on b.skill_name = a.skill_name and b.project_path = a.project_path
    left join jqual c on c.skill_name = a.skill_name and c.project_path = a.project_path""",
    "jreq", "jcand", "jqual", "jfiles",
)
twin("j07_live_board", "select item_id, thread_id, title, updated_at, tokens, column_kind, display_state, runtime_state, is_realtime from merged", "merged")
twin(
    "j08_quota_carry",
    """select runtime, snapshot_id, ok, case when ok then "fiveHour_used" when has then g.a end as "fiveHour_used", case when ok then "sevenDay_used" when has then g.b end as "sevenDay_used",
      case when ok then monthly_used when has then g.c end as monthly_used, case when ok then 'available' when has then 'stale' else 'unavailable' end as status
    from (select *, coalesce(coalesce(g.a, g.b, g.c) is not null, false) as has from (
      select *, last_value(case when ok then struct_pack(a := "fiveHour_used", b := "sevenDay_used", c := monthly_used) end ignore nulls) over (partition by runtime order by captured_at, snapshot_id rows unbounded preceding) as g from commit0))""",
    "commit0",
)
view("pall", "select cwd, sum(tokens_used) as tokens, count(*) as thread_count, max(coalesce(recency_at, updated_at)) as last_active_at from f3 where tokens_used > 0 group by cwd", "f3")
view("pweek", "select cwd, sum(tokens_used) as tokens, count(*) as thread_count, max(coalesce(recency_at, updated_at)) as last_active_at from f3 where tokens_used > 0 and updated_at >= timestamp '2001-07-26' group by cwd", "f3")
view(
    "f3n",
    "select * replace (case when updated_at >= timestamp '2001-07-26' and cast(thread_id as bigint) % 3 = 0 then '/w/n' || (cast(thread_id as bigint) % 5) else cwd end as cwd) from f3",
    "f3",
)
view("palln", BODIES["pall"].replace("from f3 ", "from f3n "), "f3n")
view("pweekn", BODIES["pweek"].replace("from f3 ", "from f3n "), "f3n")
PID = "case when cwd = '' then 'uncategorized' else cwd end"
PNAME = "case when cwd = '' then 'uncategorized' else substr(cwd, 4) end"
twin(
    "j09_new_projects",
    f"select {PID} as project_id, w.thread_count, a.thread_count as all_threads from pweekn w join palln a using (cwd) where a.thread_count <= w.thread_count",
    "pweekn", "palln",
)
view(
    "dense",
    f"""select d.day, coalesce(tokens, 0) as tokens, coalesce(nano, 0) as nano, coalesce(input_tokens, 0) as input_tokens, coalesce(output_tokens, 0) as output_tokens, coalesce(total_tokens, 0) as total_tokens
    from (select cast(unnest(generate_series(timestamp '2024-01-30' - interval 190 day, timestamp '2024-01-30', interval 1 day)) as date) as day) d
    left join (select cast(ts as date) as day, cast(sum(nano) as hugeint) as nano, {SUMS}, cast(greatest(sum(total_tokens), sum(input_tokens) + sum(output_tokens)) as bigint) as tokens from f1p group by 1) u using (day)""",
    "f1p",
)
twin("j10_dense_days", f"select {day('day')} as day, tokens, {micro('nano')} as cost_usd, input_tokens from dense", "dense")

# ========================================================================== usage


def _rollup(source: str, today: str, week: str, month: str) -> str:
    rows = [f"""select '{name}' as usage_window, {SUMS}, cast(coalesce(sum(nano), 0) as hugeint) as nano from {source} where {test}"""
            for name, test in (("today", f"ts >= {today}"), ("seven_day", f"ts >= {week}"), ("month", f"ts >= {month}"), ("lifetime", "true"))]
    return f"""select usage_window, {', '.join(TOKENS)}, nano, {VISIBLE} as visible_tokens, (select count(distinct thread_id) from {source}) as parsed_files, (select count(*) from {source}) as token_events
      from ({' union all '.join(rows)})"""


UTC_STARTS = ("timestamp '2024-01-30'", "timestamp '2024-01-24'", "timestamp '2024-01-01'")
LA_STARTS = tuple(f"timezone('UTC', timezone('America/Los_Angeles', {s}))" for s in UTC_STARTS)
view("roll", _rollup("f1p", *UTC_STARTS), "f1p")
view("rollz", _rollup("f1p", *LA_STARTS), "f1p")
view("roll6", _rollup("f6l", *UTC_STARTS), "f6l")
ROLL = f"parsed_files, token_events, usage_window, {', '.join(TOKENS)}, {micro('nano')} as cost_usd, visible_tokens"
view(
    "caches",
    """select * from (select c_custkey as n, case when c_custkey % 4 = 0 then c_custkey % 7 else c_custkey % 5 end as today, case when c_custkey % 4 = 0 then c_custkey % 50 else 0 end as week,
      case when c_custkey % 4 = 0 then greatest(c_custkey % 7, c_custkey % 50) else c_custkey * 3 end as whole, case when c_custkey % 4 = 1 then (c_custkey % 100) / 4.0 else 0 end as cost from customer where c_custkey % 4 < 2) where whole > 0""",
)
twin(
    "s04_stats_fallback",
    f"""select 'some' as usage, {ROLL} from roll6
    union all select 'none', count(*), 0, w, cast(sum(v) as bigint), 0, 0, 0, cast(sum(v) as bigint), cast(case when w in ('month', 'lifetime') then sum(cost) else 0 end as double), cast(sum(v) as bigint)
      from (select unnest(['today', 'seven_day', 'month', 'lifetime']) as w, unnest([today, week, whole, whole]) as v, cost from caches) group by w""",
    "roll6", "caches",
)
twin("a01_window_rollup", f"select {ROLL} from roll", "roll")
twin("a01_window_rollup_la", f"select {ROLL} from rollz", "rollz")
view("daily", f"select cast(ts as date) as day, {SUMS}, cast(sum(nano) as hugeint) as nano from f1p group by 1", "f1p")
twin("a02_daily_usage", f"select {day('day')} as day, {', '.join(TOKENS)}, {micro('nano')} as cost_usd, {VISIBLE} as tokens from daily", "daily")
twin(
    "a03_daily_by_model",
    f"""select coalesce(model, 'unrecorded-model') as model_id, {day('ts')} as day, any_value(model) as model, cast(sum(total_tokens) as bigint) as tokens, {micro('sum(nano)')} as cost_usd, cast(sum(output_tokens) as bigint) as output_tokens
    from f1p group by 1, 2""",
    "f1p",
)
twin("a04_seven_day_strip", f"select {day('day')} as day, tokens from dense where day >= date '2024-01-24'", "dense")
twin(
    "a04_seven_day_threads",
    f"""select {day('d')} as day, cast(coalesce(sum(tokens_used), 0) as bigint) as tokens from (select unnest(generate_series(timestamp '2001-07-26', timestamp '2001-08-01', interval 1 day)) as d)
    left join f3 on cast(updated_at as date) = cast(d as date) group by d""",
    "f3",
)
view(
    "tot3",
    """select cast(sum(tokens_used) as bigint) as lifetime_tokens, cast(coalesce(sum(case when updated_at >= timestamp '2001-08-01' then tokens_used end), 0) as bigint) as today_tokens,
      cast(coalesce(sum(case when updated_at >= timestamp '2001-07-26' then tokens_used end), 0) as bigint) as seven_day_tokens, count(*) as thread_count, max(updated_at) as last_updated_at from f3""",
    "f3",
)
twin("a05_thread_totals", "select * from tot3", "tot3")
twin("a06_recent_threads", "select thread_id, title, tokens_used, updated_at, cwd, archived from f3 order by updated_at desc, thread_id limit 5", "f3")
view(
    "resumed",
    """select file_path, session_id, line_no, ts, message_id, model, cwd, seed_project, input + cache_create + cache_read + output as used from f6
    union all select 'd' || substr(file_path, 2), 'r' || session_id, line_no, ts + interval 1 minute, message_id, model, cwd, seed_project, case when conv_id % 3 = 0 then 0 else input + cache_create + cache_read + output end from f6 where conv_id % 4 = 0""",
    "f6",
)
view(
    "sessions6",
    """select session_id as thread_id, coalesce(nullif(regexp_extract(folder, '([^/]+)/*$', 1), ''), folder) as title, cast(coalesce(own, 0) as bigint) as tokens_used, updated_at, model, folder as cwd, false as archived
    from (select file_path, any_value(session_id) as session_id, max(ts) as updated_at, arg_max(model, line_no) filter (model is not null) as model, coalesce(arg_max(cwd, line_no) filter (cwd is not null), any_value(seed_project)) as folder from resumed group by file_path)
    left join (select file_path, sum(used) as own from (select *, row_number() over (partition by file_path, coalesce(message_id, '#' || line_no) order by line_no) as nth from resumed where used > 0) where nth = 1 group by file_path) using (file_path)""",
    "resumed",
)
RECENT6 = "select * from sessions6 order by updated_at desc, thread_id limit 12"
twin("a06_recent_transcripts", RECENT6, "sessions6")
twin(
    "a14_recent_threads",
    f"""select * from (select 'log' as runtime, thread_id, title, tokens_used, updated_at, cwd, archived from (select * from f3 order by updated_at desc, thread_id limit 5)
      union all select 'transcript', thread_id, title, tokens_used, updated_at - interval 8193 day, cwd, archived from ({RECENT6})) order by updated_at desc, runtime, thread_id limit 12""",
    "f3", "sessions6",
)
PROJECTS7 = f"""select project_path as project_id, substr(project_path, 4) as name, project_path as full_path, cast(sum(total_tokens) as bigint) as tokens, sum(nano) as nano, count(distinct thread_id) as thread_count,
  max(ts) as last_active_at, 'detailed' as source_quality from f1p where ts >= timestamp '2024-01-24' group by project_path having sum(total_tokens) > 0"""
twin("a07_recent_projects", f"select project_id, name, full_path, tokens, {micro('nano')} as cost_usd, thread_count, last_active_at, source_quality from ({PROJECTS7})", "f1p")
PROJECTS3 = f"""select {PID} as project_id, {PNAME} as name, cwd as full_path, cast(tokens as bigint) as tokens, thread_count, last_active_at, 'approximate' as source_quality from pall order by tokens desc, name, project_id limit 24"""
twin("a08_approximate_projects", PROJECTS3, "pall")
PROJECTS6 = """select project_path as project_id, substr(project_path, 4) as name, project_path as full_path, cast(sum(total_tokens) as bigint) as tokens, sum(nano) as nano, count(distinct thread_id) as thread_count,
  max(ts) as last_active_at, 'detailed' as source_quality from f6l group by project_path"""
twin(
    "a09_transcript_projects",
    f"select project_id, name, full_path, tokens, case when nano > 0 then {micro('nano')} end as cost_usd, thread_count, last_active_at, source_quality from ({PROJECTS6})",
    "f6l",
)
view(
    "share",
    """select tool_name, cast(sum(calls) as bigint) as call_count, cast(sum(case when st > 0 then round(st * (calls / ac)) else 0 end) as bigint) as t, sum(case when st > 0 then snano * (calls / ac) else 0 end) as c
    from (select thread_id, tool_name, cast(count(*) as double) as calls from calls group by 1, 2)
    join (select thread_id, cast(count(*) as double) as ac from calls group by 1) using (thread_id)
    left join (select thread_id, cast(sum(total_tokens) as bigint) as st, cast(sum(nano) as double) as snano from f1p group by 1) using (thread_id) group by tool_name""",
    "calls", "f1p",
)
LOGCAT = "case tool_name when 'exec_command' then 'terminal' when 'shell' then 'terminal' when 'apply_patch' then 'edit' when 'web_search' then 'browser' when 'browser_click' then 'browser' when 'view_image' then 'visual' when 'read_docs' then 'docs' when 'update_plan' then 'planning' else 'tool' end"
TRCAT = "case tool_name when 'shell' then 'terminal' when 'apply_patch' then 'edit' when 'read_docs' then 'docs' when 'web_search' then 'browser' when 'browser_click' then 'browser' else 'tool' end"
twin(
    "a10_tools_by_share",
    f"select tool_name, {LOGCAT} as category, call_count, case when t > 0 then t end as estimated_tokens, case when c > 0 then round(c / 1e9, 6) end as estimated_cost_usd from share",
    "share",
)
view(
    "flat6",
    """select tool_name, call_count, (select cast(sum(total_tokens) as bigint) from f6l) // total as each, (select cast(sum(nano) as double) / 1e9 from f6l) / total as ceach
    from (select tool_name, count(*) as call_count, cast(sum(count(*)) over () as bigint) as total from f6 group by tool_name)""",
    "f6", "f6l",
)
twin(
    "a11_tools_uniform",
    f"select tool_name, {TRCAT} as category, call_count, case when each > 0 then each * call_count end as estimated_tokens, case when ceach > 0 then round(ceach * call_count, 6) end as estimated_cost_usd from flat6",
    "flat6",
)
twin("a12_skill_usage", "select * from skillrank", "skillrank")
view(
    "mixed",
    """select case when path like '/%' then path else 'skill:' || name end as skill_id, name, path, source, load_count, case when source = 'global' then 0 else users end as thread_count,
      case when path like '/%' then k + 10 end as token_estimate, case when path like '/%' then k * 4 end as byte_count, last_loaded_at from (
      select path, name, source, count(*) as load_count, count(distinct user_id) as users, max(ts) as last_loaded_at, min(k) as k from (
        select *, 'n' || k as name, case when user_id % 3 = 0 then '/s/' || case when k % 8 = 0 and user_id % 2 = 0 then 'b' else 'a' end || '/n' || k else 'n' || k end as path,
          case when event_type = 'view' then 'global' else 'transcript' end as source from ev) group by path, name, source)""",
    "ev",
)
view(
    "mixedm",
    """select skill_id, min(name) as name, min(path) as path, case when bool_or(source = 'transcript') then 'transcript' else 'global' end as source,
      cast(greatest(coalesce(sum(load_count) filter (source = 'transcript'), 0), coalesce(max(load_count) filter (source = 'global'), 0)) as bigint) as load_count,
      cast(greatest(coalesce(sum(thread_count) filter (source = 'transcript'), 0), coalesce(max(thread_count) filter (source = 'global'), 0)) as bigint) as thread_count,
      max(token_estimate) as token_estimate, max(byte_count) as byte_count, max(last_loaded_at) as last_loaded_at
    from (select case when r.one is not null and m.path not like '/%' then r.one else m.skill_id end as skill_id, m.name, case when r.one is not null and m.path not like '/%' then r.one else m.path end as path, m.source, m.load_count, m.thread_count, m.last_loaded_at,
        case when r.one is not null and m.path not like '/%' then r.te else m.token_estimate end as token_estimate, case when r.one is not null and m.path not like '/%' then r.bc else m.byte_count end as byte_count
      from mixed m left join (select name, min(skill_id) as one, arg_min(token_estimate, (skill_id, token_estimate)) as te, arg_min(byte_count, (skill_id, token_estimate)) as bc from mixed where path like '/%' group by name having count(distinct skill_id) = 1) r on r.name = m.name)
    group by skill_id""",
    "mixed",
)
twin("a13_skill_merge", "select * from mixedm", "mixedm")
twin(
    "a14_runtime_windows",
    f"""select usage_window, parsed_files, token_events, {', '.join(TOKENS)}, {micro('nano')} as cost_usd, {VISIBLE} as visible_tokens from (
      select usage_window, cast(sum(parsed_files) as bigint) as parsed_files, cast(sum(token_events) as bigint) as token_events, {SUMS}, sum(nano) as nano from (
        select usage_window, parsed_files, token_events, {', '.join(TOKENS)}, nano from roll union all select usage_window, parsed_files, token_events, {', '.join(TOKENS)}, nano from roll6) group by usage_window)""",
    "roll", "roll6",
)
twin(
    "a14_runtime_days",
    f"""select day, cast(sum(tokens) as bigint) as tokens from (
      select day, {VISIBLE} as tokens from (select {day('ts')} as day, {SUMS} from f1p group by 1)
      union all select day, {VISIBLE} from (select {day('ts')} as day, {SUMS} from f6l group by 1)) group by day""",
    "f1p", "f6l",
)
twin(
    "a14_runtime_projects",
    f"""select project_id, min(name) as name, cast(sum(tokens) as bigint) as tokens, case when count(nano) > 0 then {micro('cast(sum(nano) as hugeint)')} end as cost_usd, cast(sum(thread_count) as bigint) as thread_count, max(last_active_at) as last_active_at,
      case when bool_or(source_quality = 'approximate') then 'approximate' else 'detailed' end as source_quality from (
      select regexp_replace(project_id, '^/w/[pc]', '/w/') as project_id, name, tokens, case when nano > 0 then nano end as nano, thread_count, last_active_at, source_quality from ({PROJECTS6})
      union all select regexp_replace(project_id, '^/w/[pc]', '/w/'), name, tokens, null, thread_count, last_active_at, source_quality from ({PROJECTS3})) group by project_id""",
    "f6l", "pall",
)
twin(
    "a14_runtime_tools",
    f"""select tool_name, arg_min(category, runtime) as category, cast(sum(call_count) as bigint) as call_count, cast(sum(et) as bigint) as estimated_tokens, round(sum(ec), 4) as estimated_cost_usd from (
      select 'log' as runtime, tool_name, {LOGCAT} as category, call_count, case when t > 0 then t end as et, case when c > 0 then round(c / 1e9, 6) end as ec from share
      union all select 'transcript', tool_name, {TRCAT}, call_count, case when each > 0 then each * call_count end, case when ceach > 0 then round(ceach * call_count, 6) end from flat6) group by tool_name""",
    "share", "flat6",
)
twin(
    "a14_runtime_skills",
    """select skill_id, arg_min(name, runtime) as name, cast(sum(load_count) as bigint) as load_count, cast(sum(thread_count) as bigint) as thread_count, arg_min(token_estimate, runtime) filter (token_estimate is not null) as token_estimate, max(last_loaded_at) as last_loaded_at from (
      select 'log' as runtime, skill_path as skill_id, name, load_count, thread_count, token_estimate, last_loaded_at from skillrank
      union all select 'transcript', skill_id, name, load_count, thread_count, token_estimate, last_loaded_at from mixedm) group by skill_id""",
    "skillrank", "mixedm",
)
twin(
    "a15_preferred_today",
    """select 'log' as runtime, visible_tokens as today_tokens from roll where usage_window = 'today' union all select 'transcript', today_tokens from tot3
    union all select 'all', (select visible_tokens from roll where usage_window = 'today') + today_tokens from tot3""",
    "roll", "tot3",
)
twin(
    "a16_source_guard",
    """select *, case when bool_or(suspicious) over () then 'approximate' else 'detailed' end as source from (
      select usage_window, visible_tokens * 5000 as detailed_tokens, approximate_tokens, approximate_tokens >= 1000000 and visible_tokens * 5000 - approximate_tokens >= 500000000 and cast(visible_tokens * 5000 as double) / approximate_tokens >= 8 as suspicious
      from (select r.*, case when usage_window = 'today' then today_tokens else seven_day_tokens end as approximate_tokens from roll r, tot3 where usage_window in ('today', 'seven_day')))""",
    "roll", "tot3",
)
twin(
    "a17_approximate_trend",
    f"""select {day('d')} as day, cast(coalesce(sum(tokens_used), 0) as bigint) as tokens, cast(0 as double) as cost_usd from (select unnest(generate_series(timestamp '2001-08-01' - interval 190 day, timestamp '2001-08-01', interval 1 day)) as d)
    left join f3 on cast(updated_at as date) = cast(d as date) group by d""",
    "f3",
)

# ========================================================================== trend

WEEK_TEST = "day >= date '2024-01-24'"
PREV_TEST = "day between date '2024-01-17' and date '2024-01-23'"


def _summary(source: str, peak: str, key: str = "", group: str = "") -> str:
    return f"""select {key} week_tokens, {micro('week_nano')} as week_cost, previous_tokens, {day('peak_day')} as peak_day, peak_tokens, active_days, range_tokens, week_tokens // 7 as daily_average,
      case when previous_tokens > 0 then round((cast(week_tokens as double) - previous_tokens) / previous_tokens * 100, 6) end as change_percent, previous_tokens = 0 and week_tokens > 0 as is_new
    from (select {key} cast(coalesce(sum(tokens) filter ({WEEK_TEST}), 0) as bigint) as week_tokens, cast(coalesce(sum(nano) filter ({WEEK_TEST}), 0) as hugeint) as week_nano, cast(coalesce(sum(tokens) filter ({PREV_TEST}), 0) as bigint) as previous_tokens,
      arg_max(day, (tokens, -epoch(day))) filter (tokens > 0 and {peak}) as peak_day, max(tokens) filter (tokens > 0 and {peak}) as peak_tokens, count(*) filter (tokens > 0) as active_days, cast(sum(tokens) as bigint) as range_tokens from {source} {group})"""


twin("a18_trend_summary", _summary("dense", WEEK_TEST), "dense")
twin("a18_trend_summary_transcript", _summary("(select * from dense where day >= date '2024-01-30' - 179)", "true"), "dense")
twin(
    "a19_projected_cost",
    f"""select {micro('n')} as month_cost, round(cast(n as double) / 1e9 / 30 * 31, 6) as projected_cost from (select cast(sum(nano) as hugeint) as n from dense where day >= date '2024-01-01')""",
    "dense",
)
twin("a20_active_days", "select count(*) filter (tokens > 0) as active_days from dense", "dense")
view(
    "grid",
    """select n // 7 as week_index, n % 7 as weekday_index, day, case when day <= date '2024-01-30' then coalesce(tokens, 0) end as tokens, day > date '2024-01-30' as is_future
    from (select n, date '2024-01-29' - 175 + cast(n as int) as day from (select unnest(range(182)) as n)) left join dense using (day)""",
    "dense",
)
view(
    "grid6",
    "select n // 7 as week_index, n % 7 as weekday_index, day, coalesce(tokens, 0) as tokens, false as is_future from (select n, date '2024-01-30' - 179 + cast(n as int) as day from (select unnest(range(180)) as n)) left join dense using (day)",
    "dense",
)
twin("a21_heat_grid", f"select week_index, weekday_index, {day('day')} as day, tokens, is_future from grid", "grid")
twin("a21_heat_grid_transcript", f"select week_index, weekday_index, {day('day')} as day, tokens, is_future from grid6", "grid6")


def _bounds(source: str, last: float, few: str, spare: tuple[str, ...]) -> str:
    cells = ", ".join(
        f"case when {few} then {s} else greatest(v[cast(round((len(v) - 1) * {q}) as int) + 1], 1) end as bound_{i}"
        for i, (s, q) in enumerate(zip(spare, (0.25, 0.5, 0.75, last)), start=1)
    )
    return f"select {cells} from (select coalesce(list(tokens order by tokens) filter (tokens > 0), []) as v from {source})"


view("bnd", _bounds("grid", 0.9, "len(v) < 5", tuple(f"greatest(greatest(coalesce(list_max(v), 1), 1) * {k} // 5, 1)" for k in (1, 2, 3, 4))), "grid")
twin("a22_heat_thresholds", "select * from bnd", "bnd")
twin("a22_heat_thresholds_transcript", _bounds("grid6", 0.95, "len(v) = 0", ("1", "10", "100", "1000")), "grid6")
twin(
    "a22_heat_levels",
    f"select {day('day')} as day, case when coalesce(tokens, 0) <= 0 then 0 when tokens <= bound_1 then 1 when tokens <= bound_2 then 2 when tokens <= bound_3 then 3 else 4 end as level from grid, bnd",
    "grid", "bnd",
)
view(
    "bymodel",
    """select coalesce(model || '-' || (seq % 4), 'unrecorded-model') as model_id, any_value(model || '-' || (seq % 4)) as model, cast(ts as date) as day, cast(sum(total_tokens) as bigint) as tokens, cast(sum(nano) as hugeint) as nano from f1p group by 1, 3""",
    "f1p",
)
twin("a23_model_trends", _summary("bymodel", WEEK_TEST, "model_id, model,", "group by model_id, model"), "bymodel")
twin(
    "a23_model_series",
    f"""select m.model_id, {day('d.day')} as day, coalesce(tokens, 0) as tokens, {micro('coalesce(nano, 0)')} as cost_usd from (select distinct coalesce(model, 'unrecorded-model') as model_id from f1p) m, dense d
    left join (select coalesce(model, 'unrecorded-model') as model_id, cast(ts as date) as day, cast(sum(total_tokens) as bigint) as tokens, cast(sum(nano) as hugeint) as nano from f1p group by 1, 2) u on u.model_id = m.model_id and u.day = d.day""".replace("coalesce(tokens, 0)", "coalesce(u.tokens, 0)").replace("coalesce(nano, 0)", "coalesce(u.nano, 0)"),
    "f1p", "dense",
)
twin("a24_window_series", f"select {day('day')} as day, tokens from dense where day > date '2024-01-30' - 60", "dense")
view(
    "topm",
    """select model_id, cast(sum(tokens) as bigint) as window_tokens, row_number() over (order by sum(tokens) desc, coalesce(sum(tokens) filter (day >= date '2024-01-24'), 0) desc, model_id) as rank
    from bymodel where day > date '2024-01-30' - 30 group by model_id having sum(tokens) > 0""",
    "bymodel",
)
twin(
    "a25_area_series",
    f"""select s.series_id, s.series_id = 'other-models' as is_aggregate, {day('d.day')} as day, coalesce(u.tokens, 0) as tokens, {micro('coalesce(u.nano, 0)')} as cost_usd
    from (select distinct case when rank <= 8 then model_id else 'other-models' end as series_id from topm) s cross join (select day from dense where day > date '2024-01-30' - 30) d
    left join (select case when rank <= 8 then b.model_id else 'other-models' end as series_id, day, cast(sum(tokens) as bigint) as tokens, cast(sum(nano) as hugeint) as nano from bymodel b join topm t on t.model_id = b.model_id group by 1, 2) u
      on u.series_id = s.series_id and u.day = d.day""",
    "topm", "bymodel", "dense",
)
twin(
    "a26_metric_summary",
    f"""select metric, round(r, 6) as recent_value, round(r / 7, 6) as daily_average_value, case when p > 0 then round((r - p) / p * 100, 6) end as change_percent, p <= 0 and r > 0 as is_new from (
      select 'tokens' as metric, cast(sum(tokens) filter ({WEEK_TEST}) as double) as r, cast(sum(tokens) filter ({PREV_TEST}) as double) as p from dense
      union all select 'cost_usd', cast(sum(nano) filter ({WEEK_TEST}) as double) / 1e9, cast(sum(nano) filter ({PREV_TEST}) as double) / 1e9 from dense)""",
    "dense",
)
twin(
    "a27_model_overview",
    """select (select model_id from topm where rank = 1) as top_model, (select window_tokens from topm where rank = 1) as top_model_tokens, count(*) filter (tokens > 0) as active_days, 30 as window_days,
      (select count(*) from topm) as active_models, cast(sum(tokens) as bigint) // 30 as daily_average from dense where day > date '2024-01-30' - 30""",
    "topm", "dense",
)
twin(
    "a28_project_overview",
    f"""select count(*) as active_projects, (select count(*) from (select * from pweekn order by tokens desc limit 24) w join palln a using (cwd) where a.thread_count <= w.thread_count) as new_projects, cast(sum(tokens) as bigint) as total_tokens,
      round((select max(tokens) from pweekn) / cast(sum(tokens) as double) * 100, 6) as top_one_share, round((select sum(tokens) from (select tokens from pweekn order by tokens desc limit 3)) / cast(sum(tokens) as double) * 100, 6) as top_three_share
    from (select * from pweekn order by tokens desc, {PNAME}, cwd limit 24)""",
    "pweekn", "palln",
)
twin(
    "a28_recently_active",
    f"""select {PID} as project_id, cast(tokens as bigint) as tokens, last_active_at from (select * from pweek order by tokens desc, {PNAME} limit 24) order by last_active_at desc, tokens desc limit 5""",
    "pweek",
)
twin(
    "a29_bar_ratio",
    f"""select {PID} as project_id, cast(tokens as bigint) as tokens, round(cast(tokens as double) / greatest(max(tokens) over (), 1), 6) as ratio from (select * from pall order by tokens desc, {PNAME} limit 8)""",
    "pall",
)
twin(
    "a30_operation_latency",
    """select operation, span_count, failures, v[cast(ceil(len(v) * 0.5) as int)] as p50_ms, v[cast(ceil(len(v) * 0.95) as int)] as p95_ms, v[-1] as max_ms from (
      select event_type as operation, count(*) as span_count, count(*) filter (k % 10 = 0) as failures, list(value order by value) filter (rn <= 256) as v
      from (select *, row_number() over (partition by event_type order by ts desc, event_id desc) as rn from ev) group by event_type)""",
    "ev",
)

# ====================================================================== intervals

twin("i01_period_clip", "select period, interval_id, start_at, end_at from uclip", "uclip")
twin("i02_worker_islands", "select * from uisl", "uisl")
twin(
    "i03_timeline",
    "select period, active_micros, parallel_micros, peak, worked_micros, round(worked_micros / cast(active_micros as double), 6) as average_parallelism from uline join uwork using (period)",
    "uline", "uwork",
)
twin("i04_multi_project", "select * from umulti", "umulti")
twin("i05_daily_points", "select period, day, agents, micros, peak from upoints", "upoints")
twin("i05_daily_points_la", "select period, day, agents, micros, peak from zpoints", "zpoints")
twin("i06_active_days", "select * from uact", "uact")
twin(
    "i07_work_measures",
    """select period, round(worked / 3.6e9, 6) as ai_hours, round(autonomous / 3.6e9, 6) as autonomous_hours, round(delegated / 3.6e9, 6) as delegated_hours, round(autonomous / cast(worked as double), 6) as autonomous_share,
      round(delegated / cast(worked as double), 6) as delegated_share, round(longest / 3.6e9, 6) as longest_autonomous_hours, autonomous_days, agents, projects from ubase""",
    "ubase",
)
twin("i08_effective_workers", "select period, round(cast(effective_workers as double), 6) as effective_workers from ueff", "ueff")
twin("i09_confidence", "select period, round(cast(weighted as double) / 10 / worked, 6) as confidence from ubase", "ubase")
twin(
    "i10_dimensions",
    """select period, u.dimension, round(u.score, 4) as score from (select period, unnest([{'dimension': 'span', 'score': span}, {'dimension': 'leverage', 'score': leverage}, {'dimension': 'orchestration', 'score': orchestration}, {'dimension': 'autonomy', 'score': autonomy}]) as u from udim)""",
    "udim",
)
twin("i11_composite", "select period, score, round(core, 4) as core, round(maturity, 6) as maturity, round(confidence, 6) as coverage from uscore", "uscore")
twin(
    "i12_rank_band",
    """select event_id, score, case when score >= 93 then 7 when score >= 80 then 6 when score >= 65 then 5 when score >= 50 then 4 when score >= 35 then 3 when score >= 20 then 2 when score >= 0 then 1 end as level,
      case when score >= 93 then 93 when score >= 80 then 80 when score >= 65 then 65 when score >= 50 then 50 when score >= 35 then 35 when score >= 20 then 20 when score >= 0 then 0 end as low,
      case when score >= 93 then 100 when score >= 80 then 92 when score >= 65 then 79 when score >= 50 then 64 when score >= 35 then 49 when score >= 20 then 34 when score >= 0 then 19 end as high,
      case when score >= 93 then null when score >= 80 then 93 when score >= 65 then 80 when score >= 50 then 65 when score >= 35 then 50 when score >= 20 then 35 when score >= 0 then 20 end as next_low
    from (select event_id, case when floor(value * 2) <= 100 then cast(floor(value * 2) as bigint) end as score from ev)""",
    "ev",
)
twin(
    "i13_project_contribution",
    """select i.period, i.project_id, arg_min('p' || f.project_id, (i.start_at, i.worker_id)) as project_name, count(distinct i.worker_id) as agents,
      round(sum(epoch_us(i.end_at) - epoch_us(i.start_at)) / 3.6e9, 6) as ai_hours, round(coalesce(sum(epoch_us(i.end_at) - epoch_us(i.start_at)) filter (i.is_autonomous), 0) / 3.6e9, 6) as autonomous_hours
    from uisl i join dworker w on w.worker_id = i.worker_id join f2 f on f.event_id = w.pick group by i.period, i.project_id""",
    "uisl", "dworker", "f2",
)
twin(
    "i14_report",
    """select period, score, case when score >= 93 then 7 when score >= 80 then 6 when score >= 65 then 5 when score >= 50 then 4 when score >= 35 then 3 when score >= 20 then 2 else 1 end as level,
      agents, peak, active_days, projects, round(ai_hours, 6) as ai_hours, round(parallel_share, 6) as parallel_share, round(multi_share, 6) as multi_share from uscore""",
    "uscore",
)

# ========================================================================== quota

twin("q01_slot_rows", "select runtime, snapshot_id, slot, used_percent, window_mins, resets_at, false as malformed from slots", "slots")
twin(
    "q01_limit_documents",
    """select event_id, case when event_id % 2 = 0 then 'main' when event_id % 9 = 0 then 'empty' else 'base' end as limit_id, not e as has_fields, not e and event_id % 5 = 1 as malformed,
      case when not e then value end as primary_used, case when not e then 300 end as primary_mins, case when e then null when event_id % 5 = 2 then 12.5 when event_id % 5 in (3, 4) then 3.0 end as secondary_used
    from (select *, event_id % 2 = 1 and event_id % 9 = 0 as e from ev)""",
    "ev",
)
twin("q02_window_kind", "select snapshot_id, slot, kind from slots", "slots")
twin("q03_unique_windows", 'select snapshot_id, "fiveHour_count", "sevenDay_count", monthly_count, unclassified, "fiveHour_used", "sevenDay_used", monthly_used from uniq', "uniq")
twin("q04_commit", 'select snapshot_id, ok, "fiveHour_used", "sevenDay_used", monthly_used from commit0', "commit0")
twin(
    "q05_diagnostics",
    """select snapshot_id, concat_ws(';', case when f > 1 then 'duplicate:fiveHour' end, case when s > 1 then 'duplicate:sevenDay' end, case when m > 1 then 'duplicate:monthly' end, case when missing then 'missing-duration' end, case when len(u) > 0 then 'unknown:' || array_to_string(u, ',') end) as messages
    from (select snapshot_id, count(*) filter (kind = 'fiveHour') as f, count(*) filter (kind = 'sevenDay') as s, count(*) filter (kind = 'monthly') as m, bool_or(window_mins is null) as missing,
      coalesce(list(distinct window_mins order by window_mins) filter (kind = 'unclassified' and window_mins is not null), []) as u from slots group by snapshot_id)""",
    "slots",
)
twin(
    "q06_reset_credits",
    """select event_id, case when n >= 0 then n end as total_count, d as details, array_to_string(string_split(d, ',')[1:least(2, greatest(n, 0))], ',') as inline_details,
      greatest(0, greatest(n, 0) - least(2, greatest(n, 0))) as hidden_count, greatest(0, greatest(n, 0) - least(3, greatest(n, 0))) as missing_count
    from (select event_id, k % 5 - 1 as n, case when k * 10 < 400 then 'c1,c0,c3' else 'c0,c1,c3' end as d from ev)""",
    "ev",
)
twin("q07_runtime_status", "select runtime, captured_at, status from lastq", "lastq")

# ========================================================================== board

twin("b01_open_threads", "select item_id, thread_id, title, detail, updated_at, tokens, column_kind, display_state from bopen", "bopen")
twin("b02_archived_today", "select item_id, thread_id, title, updated_at, tokens from bdone", "bdone")
twin(
    "b03_next_runs",
    f"""select schedule_id, freq as frequency, h as hour, m as minute, case when n % 10 <> 0 and freq <> 'HOURLY' then (
        select min(t) from (select timezone('UTC', timezone(zone, d + to_hours(cast(h as int)) + to_minutes(cast(m as int)))) as t, d from (
          select unnest(generate_series(cast(cast(timezone(zone, timezone('UTC', {EVENTS_NOW})) as date) as timestamp), cast(cast(timezone(zone, timezone('UTC', {EVENTS_NOW})) as date) as timestamp) + interval 8 day, interval 1 day)) as d))
        where t > {EVENTS_NOW} and (freq = 'DAILY' or (['SU', 'MO', 'TU', 'WE', 'TH', 'FR', 'SA'])[cast(dayofweek(d) as int) + 1] in (d1, d2))) end as next_run_at from f8s""",
    "f8s",
)
twin(
    "b04_task_board",
    f"""select path as item_id, title, coalesce(regexp_extract(project, '([^/]+)/*$', 1), '') as detail, updated_at, {STATUS_COLUMN} as column_kind, {STATUS_STATE} as display_state,
      case when s in (0, 1, 2) then 'running' when s in (4, 5) then 'failed' when s in (8, 9, 10) then 'completed' else 'recorded' end as runtime_state
    from (select *, cast(regexp_extract(path, '([0-9]+)', 1) as bigint) % 13 as s from taskdoc)""",
    "taskdoc",
)
twin(
    "b05_column_summary",
    """select c as column_kind, count(column_kind) as item_count, (select count(*) from bitem) as total_count from (select unnest(['active', 'pending', 'scheduled', 'done']) as c) left join bitem on column_kind = c group by c""",
    "bitem",
)
twin(
    "b06_attention",
    """select * from (select 'task-' || item_id || '-1' as attention_id, 1 as kind, thread_id, title, updated_at as since from merged where runtime_state = 'failed'
      union all select 'data-' || runtime || '-' || status, 2, null, runtime, captured_at from lastq where status in ('unavailable', 'stale', 'snapshotNeeded')) order by kind, since asc nulls last, attention_id limit 1""",
    "merged", "lastq",
)

# ====================================================================== streaming

# One row per phase of the connection, with the numbers of lists and losses known by its end.
view(
    "phases",
    """select phase, cut, case when first_list < cut then first_list end as list_1, case when second_list < cut then second_list end as list_2, case when lost < cut then lost end as lost
    from (select 2 * (n // 8) - 1 as first_list, 2 * (n * 3 // 8) - 1 as lost, 2 * (n * 5 // 8) - 1 as second_list,
      unnest([{'phase': 'listed', 'cut': 2 * (n * 3 // 8) - 1}, {'phase': 'lost', 'cut': 2 * (n * 4 // 8) - 1}, {'phase': 'opened', 'cut': 2 * (n * 5 // 8) - 1}, {'phase': 'end', 'cut': 2 * n + 1}], recursive := true)
      from (select count(*) as n from events))""",
)
view(
    "told",
    "select * from (select phase, list_1, list_2, lost, thread_id, 2 * event_seq as seq, method, name, turn_id, ts, case when 2 * event_seq > list_2 then 2 when 2 * event_seq > list_1 then 1 else 0 end as gen, "
    + STATE + """ as state from f7, phases where event_seq % 7 <> 0 and 2 * event_seq < cut and not (method = 'thread/list' and event_seq % 11 = 0)) where state is not null""",
    "f7", "phases",
)
view(
    "kept",
    """select t.* from told t join (
      select phase, thread_id, case when list_2 is not null and in_2 then case when in_1 then 0 else 1 end when list_2 is not null then 2 when in_1 then 0 else 1 end as since
      from (select phase, thread_id, any_value(list_2) as list_2, bool_or(method = 'thread/list' and gen = 1) as in_1, bool_or(method = 'thread/list' and gen = 2) as in_2 from told group by phase, thread_id)) s
      on s.phase = t.phase and s.thread_id = t.thread_id and t.gen >= s.since""",
    "told",
)
view(
    "seen",
    """select phase, thread_id, name, turn_id, updated_at, case when seq < lost and state in ('running', 'waitingInput') then 'disconnected' else state end as state, on_line
    from (select phase, thread_id, arg_max(state, seq) as state, arg_max(name, seq) filter (name is not null) as name, arg_max(turn_id, seq) filter (turn_id is not null) as turn_id, max(seq) as seq,
      arg_max(ts, seq) as updated_at, any_value(lost) as lost, coalesce(greatest(any_value(list_1), any_value(list_2)) > coalesce(any_value(lost), -1), false) as on_line from kept group by phase, thread_id)""",
    "kept",
)
twin("r01_live_state", "select thread_id, state, name, turn_id, updated_at, on_line and state not in ('recorded', 'disconnected') as is_realtime from seen where phase = 'end'", "seen")
twin("r02_list_replace", "select thread_id, state, name, turn_id, updated_at, on_line and state not in ('recorded', 'disconnected') as is_realtime from seen where phase = 'listed'", "seen")
twin("r03_disconnect", "select phase, thread_id, state, on_line and state not in ('recorded', 'disconnected') as is_realtime from seen", "seen")
twin("r04_stream_counters", f"select thread_id, count(*) as deltas, {SUMS} from cdelta group by thread_id", "cdelta")
twin("r05_daily_mart", f"select {day('day')} as day, {VISIBLE} as tokens, {micro('nano')} as cost_usd from daily", "daily")
view("dailyz", f"select cast(timezone('America/Los_Angeles', timezone('UTC', ts)) as date) as day, {SUMS}, cast(sum(nano) as hugeint) as nano from f1p group by 1", "f1p")
twin("r05_rezoned_mart", f"select {day('day')} as day, {VISIBLE} as tokens, {micro('nano')} as cost_usd from dailyz", "dailyz")
twin("r06_discovered_files", "select role as line_type, count(*) as line_count from conversations group by role")
