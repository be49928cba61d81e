"""The same queries as SQL for DuckDB, used to check the Spark results."""

from __future__ import annotations

from rekindle.catalogue import CATALOGUE
from rekindle.operators.roles import HINTS
from rekindle.plans.tables import ROLE_COLUMNS

INTER = """
inter as materialized (
  select "userID", "itemID", rating, timestamp from (
    select o_custkey::varchar as "userID", l_partkey::varchar as "itemID", l_quantity as rating,
           epoch_us(o_orderdate)::double as timestamp,
           row_number() over (partition by o_custkey, l_partkey order by o_orderdate desc, l_quantity desc) as rn
    from lineitem join orders on l_orderkey = o_orderkey)
  where rn = 1)"""


def bucket(ratio: float) -> str:
    return f"""('0x' || substr(md5("userID" || '|' || "itemID"), 1, 8))::bigint % 10000 < {int(ratio * 10000)}"""


def parts(source: str = "inter", ratio: float = 0.25) -> str:
    return f"""
train as materialized (select * from {source} where not ({bucket(ratio)})),
test as materialized (select * from {source} where {bucket(ratio)} and "userID" in (select "userID" from train)),
targets as (select distinct "userID" from test)"""


ORDERS = f"with {INTER}, {parts()}"

EVENT_INTER = """
inter as materialized (
  select "userID", "itemID", 1.0::double as rating, event_type, timestamp from (
    select user_id::varchar as "userID", json_extract_string(props, '$.k') as "itemID", event_type,
           epoch_us(ts)::double as timestamp,
           row_number() over (partition by user_id, json_extract_string(props, '$.k') order by ts desc, event_type desc) as rn
    from events where user_id is not null and json_extract_string(props, '$.k') is not null)
  where rn = 1)"""
EVENTS = f"with {EVENT_INTER}, {parts()}"

POPULAR = """
span as (select min(timestamp) as lo, max(timestamp) as hi from train),
popular as materialized (
  select "itemID", round(sum(pow(0.95::double, 1 - (timestamp - lo) / (case when hi > lo then hi - lo else 1 end))), 10) as score
  from train, span group by "itemID" having count(*) >= 5)"""


def top_unseen(scores: str, k: int = 10) -> str:
    """Ranked rows of ``scores(userID, itemID, score)`` that train does not hold."""
    return f"""
select "userID", "itemID", round(score, 6) as score, rn as rank from (
  select s.*, row_number() over (partition by "userID" order by score desc, "itemID") as rn
  from {scores} s anti join train using ("userID", "itemID")) where rn <= {k}"""


def core_rounds(n: int, min_user: int, min_item: int) -> str:
    """n unrolled rounds c0 … cn with the number of removed users u1 … and items i1 …"""
    out = ["c0 as materialized (select \"userID\", \"itemID\" from inter)"]
    for r in range(1, n + 1):
        p = f"c{r - 1}"
        out.append(f"""u{r} as materialized (select "userID" from {p} group by 1 having count(*) < {min_user})""")
        out.append(f"""m{r} as materialized (select * from {p} where "userID" not in (select "userID" from u{r}))""")
        out.append(f"""i{r} as materialized (select "itemID" from m{r} group by 1 having count(*) < {min_item})""")
        out.append(f"""c{r} as materialized (select * from m{r} where "itemID" not in (select "itemID" from i{r}))""")
    return ",\n".join(out)


ROUNDS = 12


def cosine(of: str, over: str, shrinkage: int, k: int) -> str:
    shrink = f" * (co / (co + {shrinkage}::double))" if shrinkage else ""
    return f"""
norms as materialized (select "{of}" as id, sqrt(sum(rating * rating)) as n from train group by 1),
dots as materialized (
  select a."{of}" as i, b."{of}" as j, sum(a.rating * b.rating) as d,
         count(*) filter (a.rating > 0 and b.rating > 0)::double as co
  from train a join train b on a."{over}" = b."{over}" and a."{of}" <> b."{of}" group by 1, 2),
sims as materialized (
  select i, j, d / (x.n * y.n){shrink} as sim from dots join norms x on x.id = i join norms y on y.id = j),
near as materialized (
  select i, j, sim from (select *, rank() over (partition by i order by sim desc) as r from sims) where r <= {k})"""


ITEM_SCORES = """
weights as (select i as j, sum(abs(sim)) as w from near group by 1),
scores as materialized (
  select h."userID", n.j as "itemID", round(sum(h.rating * n.sim) / (coalesce(any_value(w.w), 0) + 1e-9), 10) as score
  from train h join targets using ("userID") join near n on n.i = h."itemID" left join weights w on w.j = n.j
  group by 1, 2)"""

GENRES = """
genres as materialized (select distinct p_partkey::varchar as "itemID", unnest(string_split(p_name, ' ')) as g from part),
sizes as (select "itemID", count(*) as n from genres group by 1),
jaccard as materialized (
  select a."itemID" as a, b."itemID" as b, count(*)::double / (any_value(x.n) + any_value(y.n) - count(*)) as jaccard
  from genres a join genres b on a.g = b.g and a."itemID" < b."itemID"
  join sizes x on x."itemID" = a."itemID" join sizes y on y."itemID" = b."itemID" group by 1, 2)"""

FEATURES = """
rows_ as materialized (
  select t."userID", t."itemID", t.rating, p_brand, p_type, p_size
  from {source} t left join part on p_partkey::varchar = t."itemID")"""


def dominant(column: str, entity: str) -> str:
    return f"""
select id, v from (
  select "{entity}" as id, {column} as v, row_number() over (partition by "{entity}" order by count(*) desc, {column}) as rn
  from rows_ where {column} is not null group by 1, 2) where rn = 1"""


def cleaned(text: str) -> str:
    return f"coalesce(nullif(trim(regexp_replace(lower({text}), '[^a-z0-9]+', ' ', 'g')), ''), 'unknown')"


TFIDF = f"""
brand as ({dominant('p_brand', 'itemID')}), kind as ({dominant('p_type', 'itemID')}), size as ({dominant('p_size', 'itemID')}),
docs as materialized (
  select e.id, lower(concat_ws(' ', 'itemid ' || {cleaned('e.id')}, 'p_brand_' || {cleaned('brand.v')},
                               'p_type_' || {cleaned('kind.v')}, printf('p_size_%.3f', size.v::double))) as doc
  from (select distinct "itemID" as id from rows_) e
  left join brand using (id) left join kind using (id) left join size using (id)),
words as (select id, unnest(regexp_extract_all(doc, '[a-z0-9_]+')) as term from docs),
terms as materialized (select id, term, count(*) as tf from words group by 1, 2),
vocab as materialized (
  select term, count(*) as df from terms group by 1),
raw_ as materialized (
  select id, term, df, tf * (ln((1.0::double + (select count(distinct id) from terms)) / (1.0::double + df)) + 1) as w
  from terms join vocab using (term)),
lengths as (select id, sqrt(sum(w * w)) as n from raw_ group by 1),
tfidf as materialized (select id, term, df, w / n as weight from raw_ join lengths using (id))"""

RUNS = """
runs as materialized (
  select 'exp' || (user_id % 3) as experiment_id, event_type as algorithm,
         round(avg(case when value > 50 then 1.0::double else 0 end), 6) as metric, round(avg(value), 6) as elapsed_s,
         (case when event_type = 'purchase' then 0.9 when event_type in ('click', 'view') then 0.65 else 0.35 end)::double as scalability
  from events group by all),
scaled as (
  select *,
    case when min(metric) over w is null then 0 when min(metric) over w = max(metric) over w then 1
         else (metric - min(metric) over w) / (max(metric) over w - min(metric) over w) end as perf,
    case when min(elapsed_s) over w is null then 0 when min(elapsed_s) over w = max(elapsed_s) over w then 1
         else (max(elapsed_s) over w - elapsed_s) / (max(elapsed_s) over w - min(elapsed_s) over w) end as speed
  from runs window w as (partition by experiment_id)),
composed as (
  select experiment_id, algorithm, metric, elapsed_s, scalability, round(perf, 4) as performance_score,
         round(speed, 4) as speed_score,
         round(0.7::double * coalesce(perf, 0) + 0.2::double * coalesce(speed, 0)
               + 0.1::double * least(1, greatest(0, coalesce(scalability, 0.5))), 4) as composite_score
  from scaled),
board as materialized (
  select *, row_number() over (partition by experiment_id order by composite_score desc, performance_score desc nulls last,
                               speed_score desc nulls last, algorithm) as rank
  from composed)"""

SELECTION = """
signals as (
  select *,
    case when metric between 0 and 1 then metric * 100 end as s0,
    case when composite_score between 0 and 1 then composite_score * 100 end as s1,
    case when metric is null then null when max(metric) over w - min(metric) over w <= 1e-12 then 100
         else (metric - min(metric) over w) / (max(metric) over w - min(metric) over w) * 100 end as s2,
    case when composite_score is null then null when max(composite_score) over w - min(composite_score) over w <= 1e-12 then 100
         else (composite_score - min(composite_score) over w) / (max(composite_score) over w - min(composite_score) over w) * 100 end as s3
  from board window w as (partition by experiment_id)),
selected as materialized (
  select experiment_id, algorithm, rank,
    round((coalesce(s0 * 0.5, 0) + coalesce(s1 * 0.25, 0) + coalesce(s2 * 0.25, 0) + coalesce(s3 * 0.25, 0))
      / ((s0 is not null)::int * 0.5 + (s1 is not null)::int * 0.25 + (s2 is not null)::int * 0.25 + (s3 is not null)::int * 0.25), 2) as selection_score_pct
  from signals)"""

REGISTRY = """
log_ as (
  select min(event_id) as seq, 'saved' as event, user_id from events group by user_id
  union all
  select event_id, case when event_type = 'purchase' then 'promoted' else 'deleted' end, user_id from events
  where event_type = 'purchase' or (event_type = 'error' and value > 95)),
last_ as (
  select user_id, max(seq) filter (event = 'deleted') as deleted, max(seq) filter (event = 'promoted') as promoted,
         max(seq) filter (event = 'saved') as seq from log_ group by user_id),
states as materialized (
  select seq, 'm' || user_id as model_id, 'a' || (user_id % 7) as algorithm, seq::double as created_at, promoted_ as promoted from (
    select *, coalesce(promoted = max(promoted) over (partition by user_id % 7), false) as promoted_ from last_)
  where deleted is null)"""

CANDIDATES = """
stats as (
  select user_id::varchar as "userID", json_extract_string(props, '$.k') as "itemID", count(*)::double as "count",
         round(avg(value), 6) as value, max(event_id)::double as recent from events group by 1, 2),
long as (
  select "userID", "itemID", 'count' as model_id, "count" as score from stats union all
  select "userID", "itemID", 'value', value from stats union all
  select "userID", "itemID", 'recent', recent from stats),
candidates as materialized (
  select "userID", "itemID", model_id, score from (
    select *, row_number() over (partition by "userID", model_id order by score desc, "itemID") as rn from long) where rn <= 50),
scaled as materialized (
  select *, case when max(score) over w = min(score) over w then 1.0::double
                 else (score - min(score) over w) / (max(score) over w - min(score) over w) end as normalized_score
  from candidates window w as (partition by "userID", model_id))"""

ENSEMBLE = """
weights(model_id, algorithm, input_weight, normalized_weight) as (
  values ('count', 'Count', 50::double, 0.5::double), ('value', 'Value', 30::double, 0.3::double), ('recent', 'Recent', 20::double, 0.2::double)),
present as (select distinct "userID", model_id from scaled),
balanced as (
  select "userID", model_id, algorithm, input_weight,
         normalized_weight / sum(normalized_weight) over (partition by "userID") as normalized_weight
  from present join weights using (model_id)),
pieces as materialized (
  select s."userID", s."itemID", b.algorithm, s.model_id, s.score as raw_score, s.normalized_score, b.input_weight,
         b.normalized_weight, s.normalized_score * b.normalized_weight as weighted_score
  from scaled s join balanced b using ("userID", model_id)),
finals as (select "userID", "itemID", sum(weighted_score) as f from pieces group by 1, 2),
best as materialized (
  select * from (select *, row_number() over (partition by "userID" order by round(f, 10) desc, "itemID") as rank from finals) where rank <= 5)"""

VECTORS = """
keys_ as materialized (select vec_id::varchar as id, embedding::double[] as v from embeddings),
people as (select * from keys_)"""

EVENT_RECS = """
people_ as (select distinct "userID" from train),
recs as materialized (
  select "userID", "itemID", score from (
    select "userID", "itemID", score, row_number() over (partition by "userID" order by score desc, "itemID") as rn
    from (select "userID", "itemID", score from people_, popular) anti join train using ("userID", "itemID")) where rn <= 5)"""


def cos(a: str, b: str) -> str:
    """Cosine with the small terms of the explanation formula; ``a`` is the target."""
    return (f"list_dot_product({a}, {b}) / ((sqrt(list_dot_product({a}, {a})) + 1e-9) * sqrt(list_dot_product({b}, {b})) + 1e-9)")


def nearest(key: str, ident: str, table: str, out: str) -> str:
    return f"""
select "userID", "itemID", {out}, round(sim, 4) as similarity, rn as rank from (
  select *, row_number() over (partition by "userID", "itemID" order by sim desc, {out}) as rn from (
    select r."userID", r."itemID", t."{ident}" as {out}, round({cos('x.v', 'y.v')}, 10) as sim
    from recs r join train t on t."{key}" = r."{key}" and t."{ident}" <> r."{ident}"
    join {table} x on x.id = r."{ident}" join {table} y on y.id = t."{ident}")) where rn <= 3"""


def profile_row(column: str, dtype: str) -> str:
    return f"""select '{column}' as column_name, '{dtype}' as data_type, true as nullable, count(*) as row_count,
  count(*) - count({column}) as null_count, count(distinct {column}) as distinct_count,
  min({column})::varchar as min_value, max({column})::varchar as max_value from orders"""


def feedback_row(name: str, rating: str) -> str:
    return f"""
select '{name}' as source, lo as rating_min, hi as rating_max, n as n_unique,
  case when n = 0 or bin then true when scale then false when few then true when n > 20 and dec then false else hi <= 1 end as is_implicit,
  coalesce((dec and n >= 5) or (hi > 1 and n >= 3), false) as supports_explicit, true as supports_implicit,
  case when (dec and n >= 5) or (hi > 1 and n >= 3) then 'hybrid' else 'implicit' end as detected_mode,
  case when n = 0 then 'empty rating column; treating as implicit' when bin then 'binary values {{0,1}}; interpreted as implicit'
       when scale then 'classic ' || lo::bigint || '-' || hi::bigint || ' rating scale'
       when few then 'low-cardinality integer counts; likely implicit'
       when n > 20 and dec then n || ' decimal-like values; likely explicit'
       when hi > 1 then 'max value > 1; assuming explicit' else 'max value <= 1; assuming implicit' end as reason,
  case when (dec and n >= 5) or (hi > 1 and n >= 3) then 'rating' else '' end as explicit_signals, 'rating' as implicit_signals
from (select *, lo >= 1 and hi in (5, 10) and n >= 3 as scale, n <= 5 and hi <= 10 and hi not in (5, 10) and not dec as few
      from (select min(r) as lo, max(r) as hi, count(distinct r) as n, coalesce(bool_or(r % 1 <> 0), false) as dec,
                   coalesce(bool_and(r in (0, 1)), true) as bin
            from (select {rating} as r from lineitem join orders on l_orderkey = o_orderkey)))"""


def limits(n: int | None) -> str:
    return "null::bigint" if n is None else str(n)


JOIN_KEY = r"""
select o_orderkey, raw, case when n is null then trim(raw)
    when abs(n) < 1e18 and n = floor(n) then n::bigint::varchar
    else printf('%g', n) end as join_key
from (select o_orderkey, raw,
        case when regexp_full_match(trim(raw), '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') then try_cast(trim(raw) as double) end as n
      from (select o_orderkey, case o_orderkey % 7 when 0 then '  ' || o_orderkey || ' ' when 1 then o_orderkey || '.0'
              when 2 then '00' || o_orderkey when 3 then o_orderkey || '.50' when 4 then 'A' || o_orderkey
              when 5 then o_orderkey || 'e-3' else printf('%.2f', o_totalprice) end as raw from orders))"""

STATEMENTS = {
    "interaction_query": "select l_suppkey, l_partkey, l_quantity from lineitem where l_quantity >= 45",
    "table_profile": " union all ".join(profile_row(*p) for p in (
        ("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"),
        ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string"))),
    "raw_sql_dataset": "select distinct user_id, json_extract_string(props, '$.k') as item_id, event_type from events where value > 20",
    "clean_interactions": f"with {INTER} select * from inter",
    "kcore": f"with {INTER}, {core_rounds(ROUNDS, 20, 22)} select * from inter semi join c{ROUNDS} using (\"userID\", \"itemID\")",
    "cleaning_report": f"""with {INTER}, {core_rounds(ROUNDS, 20, 22)},
raw_ as (select count(*) as n from lineitem join orders on l_orderkey = o_orderkey),
last_ as (select count(*) as n, count(distinct "userID") as u, count(distinct "itemID") as i from c{ROUNDS})
select raw_.n as initial_rows, raw_.n as after_column_select, raw_.n as after_dropna, (select count(*) from inter) as after_dedup,
  last_.n as after_kcore, u as n_users, i as n_items, round(1 - last_.n / (u::double * i), 6) as sparsity,
  0::bigint as removed_null, raw_.n - (select count(*) from inter) as removed_dup,
  {' + '.join(f'(select count(*) from u{r})' for r in range(1, ROUNDS + 1))} as removed_kcore_users,
  {' + '.join(f'(select count(*) from i{r})' for r in range(1, ROUNDS + 1))} as removed_kcore_items
from raw_, last_""",
    "hash_split": f"""{ORDERS} select "userID", "itemID", 'train' as part from train union all select "userID", "itemID", 'test' from test""",
    "cold_users": f"""with {INTER} select distinct "userID" from inter where {bucket(0.95)}
and "userID" not in (select "userID" from inter where not ({bucket(0.95)}))""",
    "feedback_profile": feedback_row("orders", "l_quantity") + " union all "
    + feedback_row("stars", "floor((l_quantity - 1) / 10) + 1") + """ union all
select 'events', 0.0, 1.0, 1, true, false, true, 'implicit', 'no rating column; treating as implicit', '', 'event_type'""",
    "matrix_stats": f"""with {INTER} select count(distinct "userID") as n_users, count(distinct "itemID") as n_items, count(*) as nnz,
round(count(*) / (count(distinct "userID")::double * count(distinct "itemID")), 9) as density from inter""",
    "user_vector": f"""with {INTER} select "itemID", rating from inter where "userID" = '7'""",
    "name_functions": f"""
select p_partkey, replace(replace(replace(lower(n), '_', ''), ' ', ''), '-', '') as plain,
  regexp_replace(lower(n), '[^a-z0-9]+', '', 'g') as compact,
  array_to_string(list_filter(words, lambda x, i: list_position(words, x) = i), ',') as tokens,
  {cleaned('n')} as content, levenshtein(p_name, p_type) as distance
from (select *, list_filter(string_split(lower(regexp_replace(regexp_replace(n, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^0-9a-zA-Z]+', ' ', 'g')), ' '),
                            lambda x: x <> '') as words
      from (select *, p_brand || '-' || p_name as n from part))""",
    "key_normalise": JOIN_KEY,
    "outer_merge": """
select coalesce(l.cust, r.cust) as cust, c_mktsegment, o_orderkey from
  (select c_custkey::varchar as cust, c_mktsegment from customer union all select null, 'NONE') l
full outer join (select o_custkey::varchar as cust, o_orderkey from orders union all select null, -1) r
on l.cust is not distinct from r.cust""",
    "coalesce_columns": """
select coalesce(a.nation, b.nation)::varchar as nation, coalesce(a.label, b.label) as label, customers from
  (select n_nationkey as nation, case when n_nationkey % 3 <> 0 then n_name end as label from nation) a
full outer join (select c_nationkey as nation, min(c_name) as label, count(*) as customers from customer group by 1) b on a.nation = b.nation""",
    "assembled_dataset": """
select distinct c."userID", c."itemID", c.rating, c.timestamp, c.l_orderkey, c.c_mktsegment from (
  select coalesce(o.o_custkey, cu.c_custkey)::varchar as "userID", l.l_partkey as "itemID", l.l_quantity as rating,
         o.o_orderdate as timestamp, coalesce(l.l_orderkey, o.o_orderkey)::varchar as l_orderkey, cu.c_mktsegment
  from lineitem l full outer join orders o on l.l_orderkey = o.o_orderkey
  full outer join customer cu on cu.c_custkey = o.o_custkey) c""",
    "role_detection": f"""
with facts(col, fractional, numeric_, moment, whole, txt, d, f, n) as ({" union all ".join(
    f"select '{name}', {kind in 'F'}, {kind in 'FI'}, {kind in 'T'}, {kind in 'I'}, {kind in 'S'}, count(distinct {c}), count({c}), count(*) from lineitem"
    for (c, name), kind in zip(ROLE_COLUMNS.items(), "IIIIFTSS"))}),
named as (select *, regexp_replace(lower(col), '[_ -]', '', 'g') as flat, regexp_replace(lower(col), '[^a-z0-9]+', '', 'g') as letters,
  d / greatest(n, 1) as ratio, d / greatest(f, 1) as share from facts),
hints(role, h) as (values {", ".join(f"('{role}', {[x.replace('_', '') for x in words]})" for role, words in HINTS.items())}),
met as (select *, list_min(list_transform(h, lambda x: levenshtein(flat, x))) as near, role in ('userID', 'itemID') as ids,
  flat like '%id' and flat <> 'id' as named_id, regexp_matches(flat, 'type|name|title|date|time|status|action|log|desc|description') as no_id
  from named, hints)
select col as "column", role,
  case when list_contains(h, flat) then 0 when len(list_filter(h, lambda x: contains(flat, x))) > 0 then 1
       when length(flat) >= 2 and len(list_filter(h, lambda x: contains(x, flat))) > 0 then 2 when near <= 2 then near + 2 end as distance,
  (case when ids then greatest(0, 4 * no_id::int + 4 * (flat = 'id')::int + 3 * fractional::int - named_id::int
          + case when d <= 1 then 6 when d = 2 then 5 when d <= 5 then 4 when d <= 10 then 3 else 0 end
          + case when n <= 50 then 0 when ratio < 0.01 then 5 when ratio < 0.05 then 3 when ratio < 0.10 then 2 else 0 end)
        when role = 'rating' then 2 * (not numeric_)::int + 4 * (d > 500)::int
        when moment or regexp_matches(flat, 'time|date|created|updated|timestamp|ts') then 0 else 2 end)::bigint as penalty,
  case when role = 'rating' then numeric_ and d < 100
       when ids then named_id and not no_id and not fractional and d >= 10 and (n <= 50 or ratio >= 0.10) else false end as stands_in,
  case when ids then 160 * regexp_matches(letters, case role when 'userID' then 'user|customer|member|account|client|person|subscriber|owner|employee|patient|buyer'
            else 'item|product|service|offer|asset|object|content|listing|catalog|sku|article|book|movie|plan|package' end)::int
         + 35 * regexp_matches(letters, 'id|key|code|ref|uuid|guid|sku')::int - 80 * fractional::int - 90 * (letters = 'id')::int
         - 120 * regexp_matches(letters, 'time|timestamp|date|created|updated|viewed|purchased|ordered|event|rating|score|stars|grade|value|weight|rank|preference')::int
         + 55 * (share < 0.98)::int + 20 * (share < 0.9)::int + 10 * (share < 0.5)::int - 60 * (share >= 0.995 and f > 20)::int
         + 10 * (d between 3 and 500000)::int + 10 * (whole or txt)::int - 10000 * (d < 2)::int end::bigint as evidence
from met""",
    "output_order": """
select distinct o.o_custkey as "userID", l.l_partkey as "itemID", l.l_quantity as rating,
       coalesce(l.l_linenumber::varchar, o.o_orderpriority) as segment, coalesce(l.l_orderkey, o.o_orderkey)::varchar as l_orderkey,
       'userID,itemID,rating,segment,l_orderkey' as column_order
from lineitem l full outer join orders o on l.l_orderkey = o.o_orderkey""",
    "flatten_props": "select event_id, user_id, json_extract_string(props, '$.k')::bigint as props_k from events",
    "popularity_topk": f"""{ORDERS}, {POPULAR}, scores as (select "userID", "itemID", score from targets, popular) {top_unseen('scores')}""",
    "eval_explicit": f"""{ORDERS}, means as (select "itemID", avg(rating) as p from train group by 1)
select round(sqrt(avg((rating - p) * (rating - p))), 4) as "RMSE", round(avg(abs(rating - p)), 4) as "MAE" from test join means using ("itemID")""",
    "eval_ranking": f"""{ORDERS}, {POPULAR}, scores as (select "userID", "itemID", score from targets, popular),
ranked as materialized ({top_unseen('scores')}),
marked as (select r."userID", r.rank, (t."itemID" is not null)::int as hit from ranked r left join test t using ("userID", "itemID")),
counted as (select *, sum(hit) over (partition by "userID" order by rank rows unbounded preceding) as hits from marked),
per as (select "userID", sum(hit) as h, sum(hit / log2(rank + 1)) as dcg, sum(case when hit = 1 then hits / rank else 0 end) as ap from counted group by 1),
rel as (select "userID", count(*) as n from test group by 1),
ideal as (select n, (select sum(1 / log2(p + 1)) from range(1, least(n, 10) + 1) x(p)) as idcg from (select distinct n from rel))
select round(avg(h / 10), 4) as precision_at_k, round(avg(h / n), 4) as recall_at_k, round(avg(dcg / idcg), 4) as ndcg_at_k,
  round(avg(ap / least(n, 10)), 4) as map_at_k from per join rel using ("userID") join ideal using (n)""",
    "item_cosine": f"{ORDERS}, {cosine('itemID', 'userID', 0, 10)} select i, j, round(sim, 6) as sim from near",
    "user_cosine": f"{ORDERS}, {cosine('userID', 'itemID', 0, 10)} select i, j, round(sim, 6) as sim from near",
    "user_knn": f"""{ORDERS}, {cosine('userID', 'itemID', 10, 40)},
weights as (select i, sum(abs(sim)) + 1e-9 as w from near group by 1),
scores as materialized (
  select n.i as "userID", t."itemID", round(sum(n.sim * t.rating) / any_value(w.w), 10) as score
  from near n join targets on targets."userID" = n.i join train t on t."userID" = n.j join weights w on w.i = n.i group by 1, 2)
{top_unseen('scores')}""",
    "item_knn": f"{ORDERS}, {cosine('itemID', 'userID', 10, 40)}, {ITEM_SCORES} {top_unseen('scores')}",
    "item_knn_predictions": f"""{ORDERS}, {cosine('itemID', 'userID', 10, 40)}, {ITEM_SCORES}
select "userID", "itemID", round(coalesce(score, 0), 6) as prediction from test left join scores using ("userID", "itemID")""",
    "user_knn_predictions": f"""{ORDERS}, {cosine('userID', 'itemID', 10, 40)},
weights as (select i, sum(abs(sim)) + 1e-9 as w from near group by 1),
scores as materialized (
  select n.i as "userID", t."itemID", round(sum(n.sim * t.rating) / any_value(w.w), 10) as score
  from near n join targets on targets."userID" = n.i join train t on t."userID" = n.j join weights w on w.i = n.i group by 1, 2)
select "userID", "itemID", round(coalesce(score, 0), 6) as prediction from test left join scores using ("userID", "itemID")""",
    "serve_saved": f"""{ORDERS}, {cosine('itemID', 'userID', 10, 40)}, {ITEM_SCORES.replace('join targets using ("userID") ', '')},
users as (select 'S' || s_suppkey as "userID" from supplier),
totals as (select "itemID", sum(rating) as score from train group by 1),
best as (select *, row_number() over (order by score desc, "itemID") as rank from totals)
select "userID", "itemID", score, rank, 'Item-KNN' as algorithm from ({top_unseen('scores', 5)})
union all select u."userID", b."itemID", round(b.score, 6), b.rank, 'Item-KNN+popularity_fallback'
from (select * from users union select c_custkey::varchar from customer) u, best b where b.rank <= 5 and u."userID" not in (select "userID" from train)""",
    "serve_ensemble": f"""{ORDERS}, {POPULAR}, {cosine('itemID', 'userID', 10, 40)}, {ITEM_SCORES.replace('join targets using ("userID") ', '')},
lists as (
  select 0.6::double as w, "userID", "itemID", popular.score from (select distinct "userID" from train), popular
  union all select 0.4::double, "userID", "itemID", score from scores),
candidates as materialized (
  select w, "userID", "itemID", score from (
    select *, row_number() over (partition by w, "userID" order by score desc, "itemID") as rn from lists anti join train using ("userID", "itemID"))
  where rn <= 50),
scaled as (
  select *, case when max(score) over p = min(score) over p then 1 else (score - min(score) over p) / (max(score) over p - min(score) over p) end as s
  from candidates window p as (partition by w, "userID")),
shares as (select "userID", sum(w) as total from (select distinct w, "userID" from candidates) group by 1),
sums as (select "userID", "itemID", sum(s * w / total) as f from scaled join shares using ("userID") group by 1, 2)
select "userID", rank, "itemID", round(f, 6) as final_score from (
  select *, row_number() over (partition by "userID" order by round(f, 10) desc, "itemID") as rank from sums) where rank <= 5""",
    "genre_jaccard": f"with {GENRES} select a, b, round(jaccard, 6) as jaccard from jaccard",
    "movie_item_knn": f"""{ORDERS}, {cosine('itemID', 'userID', 0, 10).replace('near as', 'unused as')}, {GENRES},
known as (select distinct "itemID" from train),
both_ as (select a as i, b as j, jaccard from jaccard union all select b, a, jaccard from jaccard),
bonus as (select * from both_ where i in (select "itemID" from known) and j in (select "itemID" from known)),
boosted as (select coalesce(s.i, b.i) as i, coalesce(s.j, b.j) as j, coalesce(sim, 0) + 0.2::double * coalesce(jaccard, 0) as sim
  from sims s full outer join bonus b on s.i = b.i and s.j = b.j),
near as materialized (select i, j, sim from (select *, rank() over (partition by i order by sim desc) as r from boosted) where r <= 30),
{ITEM_SCORES} {top_unseen('scores')}""",
    "dominant_value": f"""with {INTER}, {FEATURES.format(source='inter')}, brand as ({dominant('p_brand', 'userID')}),
kind as ({dominant('p_type', 'userID')}), size as ({dominant('p_size', 'userID')})
select e.id as "userID", brand.v as p_brand, kind.v as p_type, size.v as p_size from (select distinct "userID" as id from rows_) e
left join brand using (id) left join kind using (id) left join size using (id)""",
    "tfidf_items": f"{ORDERS}, {FEATURES.format(source='train')}, {TFIDF} select id, term, round(weight, 6) as weight from tfidf",
    "content_topk": f"""{ORDERS}, {FEATURES.format(source='train')}, {TFIDF},
totals as (select "userID", sum(rating) as s from train group by 1),
profiles as materialized (
  select t."userID", f.term, sum(t.rating * f.weight) / any_value(case when s = 0 then 1 else s end) as w
  from train t join targets using ("userID") join tfidf f on f.id = t."itemID" join totals using ("userID") where f.df > 1 group by 1, 2),
scores as materialized (
  select p."userID", f.id as "itemID", round(sum(p.w * f.weight), 10) as score
  from profiles p join tfidf f using (term) group by 1, 2)
select * from ({top_unseen('scores')}) where score > 0""",
    "purchase_weights": f"""{EVENTS} select "userID", "itemID", event_type,
case when regexp_matches(lower(event_type), 'purchase|buy|order') then 5.0::double else 1.0::double end as rating from train""",
    "bm25_weights": f"""{ORDERS}, lens as (select "userID", sum(rating) as len from train group by 1),
avgs as (select avg(len) as a, count(*) as n from lens), dfs as (select "itemID", count(*) as df from train group by 1)
select t."userID", t."itemID", round(rating * 101.0::double / (100.0::double * ((1 - 0.8::double) + 0.8::double * len / a) + rating)
  * (ln(n) - ln(1 + df::double)), 6) as weight
from train t join lens using ("userID") join dfs using ("itemID"), avgs""",
    "time_bins": f"""with {INTER}, e as (select quantile_cont(timestamp, [0.2, 0.4, 0.6, 0.8]) as q from inter)
select "userID", "itemID", (timestamp > q[1])::bigint + (timestamp > q[2])::bigint + (timestamp > q[3])::bigint + (timestamp > q[4])::bigint as bin from inter, e""",
    "downsampled": f"""with {INTER},
u as (select "userID" from inter group by 1 order by count(*) desc, "userID" limit 500),
p as (select * from inter semi join u using ("userID")),
i as (select "itemID" from p group by 1 order by count(*) desc, "itemID" limit 300)
select * from p semi join i using ("itemID")""",
    "scalability_score": f"""with {INTER},
s as (select count(distinct "userID") as u, count(distinct "itemID") as i from inter),
c(algorithm, rating, mu, mi) as (values {', '.join(f"('{e.name}', '{e.scalability}', {limits(e.max_users)}, {limits(e.max_items)})" for e in CATALOGUE.values())})
select algorithm, round(greatest(0, least(1, 0.6::double * (case rating when 'low' then 0.35 when 'medium' then 0.65 else 0.9 end)::double
  + 0.4::double * ((case when mu is null then 1 else greatest(0, 1 - u / mu) end + case when mi is null then 1 else greatest(0, 1 - i / mi) end) / 2))), 6) as score
from c, s""",
    "leaderboard": f"with {RUNS} select * from board",
    "selection_score": f"with {RUNS}, {SELECTION} select experiment_id, algorithm, rank, selection_score_pct from selected",
    "serving_choice": f"""with {RUNS}, {SELECTION},
led as (select *, lead(selection_score_pct) over (partition by experiment_id order by rank) as nxt from selected),
tops as (select experiment_id, count(*) as n, max(selection_score_pct) filter (rank = 1) as top,
  coalesce(max(round(selection_score_pct - nxt, 2)) filter (rank = 1), 100.0::double) as gap from led group by 1)
select experiment_id, rank, algorithm, selection_score_pct, gap as score_gap,
  case when n = 1 or top >= 90 or (top >= 75 and gap >= 10) then 'single_model' else 'ensemble_weighted' end as strategy
from led join tops using (experiment_id)
where rank <= case when n = 1 or top >= 90 or (top >= 75 and gap >= 10) then 1 else least(n, 10, 5) end""",
    "model_states": f"with {REGISTRY} select * from states",
    "model_latest": f"""with {REGISTRY} select * exclude (r) from (
select *, row_number() over (partition by algorithm order by created_at desc, seq desc) as r from states) where r = 1""",
    "minmax_models": f"""with {CANDIDATES} select "userID", "itemID", model_id, score, round(normalized_score, 6) as normalized_score from scaled""",
    "ensemble_weighted": f"""with {CANDIDATES}, {ENSEMBLE}
select p."userID", b.rank, p."itemID", round(b.f, 6) as final_score, algorithm, model_id, raw_score, round(normalized_score, 4) as normalized_score,
  input_weight, normalized_weight, round(weighted_score, 4) as weighted_score,
  round(case when b.f <= 0 then 0 else weighted_score / b.f * 100 end, 4) as share_pct
from pieces p join best b using ("userID", "itemID")""",
    "single_model": f"""with {CANDIDATES}, r as (select *, row_number() over (partition by "userID" order by round(normalized_score, 10) desc, "itemID") as rank
  from scaled where model_id = 'value')
select "userID", rank, "itemID", round(normalized_score, 6) as final_score from r where rank <= 5""",
    "contribution_breakdown": f"""with {CANDIDATES}, {ENSEMBLE},
sums as (select p."userID", algorithm, model_id, sum(weighted_score) as s, count(*) as item_count
  from pieces p join best using ("userID", "itemID") group by 1, 2, 3)
select "userID", algorithm, model_id, item_count, round(round(s / sum(s) over (partition by "userID") * 100, 4), 3) as share_pct,
  round(round(s, 6), 3) as weighted_score from sums""",
    "weight_rebalance": f"""with {CANDIDATES}, {ENSEMBLE.split('present as')[0].rstrip().rstrip(',')},
present as (select distinct "userID", model_id from candidates where model_id <> 'recent' or "userID"::bigint % 2 = 0)
select "userID", model_id, algorithm, input_weight, round(normalized_weight / sum(normalized_weight) over (partition by "userID"), 6) as normalized_weight
from present join weights using (model_id)""",
    "popularity_fallback": f"""{ORDERS}, {POPULAR},
users as (select 'S' || s_suppkey as "userID" from supplier union select c_custkey::varchar from customer),
known as (select * from users where "userID" in (select "userID" from train)),
scores as (select "userID", "itemID", score from known, popular),
totals as (select "itemID", sum(rating) as score from train group by 1),
best as (select *, row_number() over (order by score desc, "itemID") as rank from totals)
select "userID", "itemID", score, rank, 'Ecommerce-Popularity' as algorithm from ({top_unseen('scores', 5)})
union all select u."userID", b."itemID", round(b.score, 6), b.rank, 'Ecommerce-Popularity+popularity_fallback'
from users u, best b where b.rank <= 5 and u."userID" not in (select "userID" from train)""",
    "similar_items": """with e as materialized (select vec_id::varchar as id, embedding::double[] as v from embeddings)
select "itemID", similar_id, round(sim, 6) as similarity, rn as rank from (
  select *, row_number() over (partition by "itemID" order by sim desc, similar_id) as rn from (
    select a.id as "itemID", b.id as similar_id, round(list_dot_product(a.v, b.v)
      / ((sqrt(list_dot_product(a.v, a.v)) + 1e-9) * (sqrt(list_dot_product(b.v, b.v)) + 1e-9)), 10) as sim
    from e a join e b on a.id <> b.id)) where rn <= 10""",
    "explain_items": f"{EVENTS}, {POPULAR}, {EVENT_RECS}, {VECTORS} {nearest('userID', 'itemID', 'keys_', 'similar_item')}",
    "explain_users": f"{EVENTS}, {POPULAR}, {EVENT_RECS}, {VECTORS} {nearest('itemID', 'userID', 'people', 'similar_user')}",
    "feature_importance": f"""{EVENTS}, {POPULAR}, {EVENT_RECS}, {VECTORS},
cells as (select r."userID", r."itemID", d - 1 as dimension, p.v[d] * q.v[d] as c
  from recs r join people p on p.id = r."userID" join keys_ q on q.id = r."itemID", range(1, 65) x(d))
select "userID", "itemID", rn as rank, dimension, round(c, 4) as contribution from (
  select *, row_number() over (partition by "userID", "itemID" order by abs(c) desc, dimension) as rn from cells) where rn <= 5""",
    "explain_reason": f"""{EVENTS}, {POPULAR}, {EVENT_RECS},
hist as (select "userID", "itemID", row_number() over (partition by "userID" order by "itemID") as rn from train),
titles as (select "userID", string_agg("itemID", ', ' order by rn) filter (rn <= 2) as t, count(*) as n from hist where rn <= 3 group by 1),
owners as (select "itemID", "userID" as other, row_number() over (partition by "itemID" order by "userID") as rn from train),
near_ as (select r."userID", r."itemID", count(*) as n from recs r join owners o on o."itemID" = r."itemID" and rn <= 3 and other <> r."userID" group by 1, 2)
select r."userID", r."itemID", case when t.n > 0 then 'Recommended because you interacted with similar items: ' || t.t
    when o.n > 0 then 'Users with similar taste to you also interacted with this item (' || o.n || ' similar users found)'
    when score > 0.7 then 'Highly rated item that matches your interaction patterns'
    else 'Recommended based on your overall interaction history' end as primary_reason,
  case when coalesce(t.n, 0) >= 2 or coalesce(o.n, 0) >= 2 then 'HIGH' when coalesce(t.n, 0) >= 1 or coalesce(o.n, 0) >= 1 then 'MEDIUM' else 'LOW' end as confidence
from recs r left join titles t on t."userID" = r."userID" left join near_ o on o."userID" = r."userID" and o."itemID" = r."itemID" """,
}
