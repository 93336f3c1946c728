"""SQL twins of the queries: the same results from the same tables, stated independently for DuckDB."""

from __future__ import annotations

ART = "(select doc_id as artifact_id, source || '/' || lang || '/doc-' || doc_id || '.md' as source_locator, text, source from documents)"


def _side(now: bool) -> str:
    skip, gone = (7, 2) if now else (3, 1)
    text = r"case when artifact_id % 5 = 0 then text || chr(10) || 'changed' else text end" if now else "text"
    media = "case when artifact_id % 11 = 0 then 'text/plain' else 'text/markdown' end" if now else "'text/markdown'"
    live = f"artifact_id % 13 <> {gone}"
    return f"""(select artifact_id, source_locator, source, case when {live} then {text} end as text, case when {live} then {media} end as media_type,
      case when {live} then 'sha256:' || sha256({text}) end as content_hash, case when {live} then 'captured' else 'missing' end as retrieval_status
      from {ART} where artifact_id % 10 <> {skip})"""


PREV, CUR = _side(False), _side(True)
ADELTA = f"""(select coalesce(p.source_locator, c.source_locator) as source_locator, p.content_hash as previous_content_hash, c.content_hash as current_content_hash,
  case when p.source_locator is null then 'capture_scope_added' when c.source_locator is null then 'capture_scope_removed'
    when p.retrieval_status = 'missing' and c.retrieval_status = 'missing' then null when p.retrieval_status = 'missing' then 'became_captured' when c.retrieval_status = 'missing' then 'became_missing'
    when p.content_hash is distinct from c.content_hash then 'content_changed' when p.media_type is distinct from c.media_type then 'metadata_changed' end as change_type
  from {PREV} p full outer join {CUR} c on p.source_locator = c.source_locator)"""


def _path_values(source: str, key: str = "artifact_id") -> str:
    """(key, source_locator, k, value) of the four path facts."""
    base = "string_split(source_locator, '/')[-1]"
    return f"""(select {key}, source_locator, unnest(['basename', 'path_depth', 'suffix', 'top_level_entry']) as k,
      unnest([{base}, len(string_split(source_locator, '/'))::varchar, lower(regexp_extract({base}, '[^.].*?(\\.[^.]+)$', 1)), string_split(source_locator, '/')[1]]) as value from {source})"""


def _facts(side: str) -> str:
    return f"""(select source_locator, 'artifact-path@1:#$path.' || k as structural_key, value from {_path_values(f"(select * from {side} where retrieval_status = 'captured')")}
      union all select source_locator, 'length@1:#length', length(text)::varchar from {side} where retrieval_status = 'captured')"""


SDELTA = f"""(select coalesce(p.source_locator, c.source_locator) as source_locator, coalesce(p.structural_key, c.structural_key) as structural_key,
  case when p.structural_key is null then 'added' when c.structural_key is null then 'removed' when p.value is distinct from c.value then 'modified' end as change_type,
  p.value as previous_value, c.value as current_value from {_facts(PREV)} p full outer join {_facts(CUR)} c on p.source_locator = c.source_locator and p.structural_key = c.structural_key)"""
SCHANGED = f"{SDELTA} s join (select source_locator from {ADELTA} where change_type in ('content_changed', 'metadata_changed')) a using (source_locator) where change_type is not null"


def _marked(source: str, key: str = "artifact_id, source_locator") -> str:
    """Lines of lens M by artifact: n, line."""
    return f"""(select {key}, n, case when n % 7 = 0 then '' when n % 17 = 2 then '```' when n % 11 = 3 then '- ' || x when n % 13 = 5 then '# ' || x else x end as line
      from (select {key}, unnest(string_split(regexp_replace(text, '[.] ', '.' || chr(10), 'g'), chr(10))) as x, generate_subscripts(string_split(regexp_replace(text, '[.] ', '.' || chr(10), 'g'), chr(10)), 1) as n from {source}))"""


def _lines(source: str, key: str = "artifact_id, source_locator") -> str:
    return f"""(select *, not fence and sum(fence::int) over (partition by artifact_id order by n) % 2 = 1 as inside from
      (select *, starts_with(s, '```') or starts_with(s, '~~~') as fence from (select *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') as s from {_marked(source, key)})))"""


RULE = r"^[|:\-\s]+$"


def _paragraphs(source: str, key: str = "artifact_id, source_locator") -> str:
    return f"""(select {key}, min(n) as first_line, max(n) as last_line, string_agg(s, ' ' order by n) as statement from
      (select *, sum(out_::int) over (partition by artifact_id order by n) as island from
        (select *, fence or inside or s = '' or regexp_matches(s, '^[#><]') or regexp_matches(s, '^([-+*]\\s+|\\d+[.)]\\s+)') or starts_with(s, '|') or (contains(s, '|') and regexp_matches(s, '{RULE}')) as out_ from {_lines(source, key)}))
      where not out_ group by {key}, island)"""


def _items() -> str:
    item = r"^([ \t]*)([-+*]|\d+[.)])[ \t]+(\S.*)$"
    return f"""
    with rows as (select *, not fence and not inside and regexp_matches(line, '{item}') as starts from {_lines(ART)}),
    numbered as (select *, sum(starts::int) over (partition by artifact_id order by n) as item from rows),
    marked as (select *, not starts and (fence or (not inside and (s = '' or regexp_matches(s, '^[#><|]') or (contains(s, '|') and regexp_matches(s, '{RULE}'))
        or length(regexp_extract(line, '^[ \\t]*')) <= first_value(length(regexp_extract(line, '^[ \\t]*'))) over (partition by artifact_id, item order by n)))) as stops from numbered where item > 0),
    ended as (select *, max(stops::int) over (partition by artifact_id, item order by n) as ended from marked)
    select artifact_id, source_locator || ':L' || min(n) || '-L' || max(n) as locator, string_agg(case when starts then trim(regexp_extract(line, '{item}', 3)) else s end, ' ' order by n) as statement
    from ended where ended = 0 and not inside group by artifact_id, source_locator, item"""


SURFACE = r"""case when starts_with(p, '.github/workflows/') then 'WORKFLOW'
  when b in ('package-lock.json', 'pnpm-lock.yaml', 'yarn.lock', 'poetry.lock', 'uv.lock', 'cargo.lock', 'go.sum', 'composer.lock', 'gemfile.lock') then 'LOCKFILE'
  when b in ('pyproject.toml', 'package.json', 'cargo.toml', 'go.mod', 'composer.json', 'gemfile') or (b like 'requirements%' and b like '%.txt') then 'MANIFEST'
  when list_has_any(parts, ['vendor', 'vendored', 'third_party', 'third-party']) then 'VENDORED'
  when list_has_any(parts, ['generated', 'gen']) or b like '%.min.js' then 'GENERATED'
  when list_has_any(parts, ['tests', 'test', '__tests__']) or regexp_matches(b, '^test_|_test\.py$|\.(test|spec)\.(ts|tsx|js)$') then 'TEST'
  when parts[1] in ('docs', 'doc') or b like 'readme%' or b like 'changelog%' or suffix in ('.md', '.rst', '.adoc') then 'DOCS'
  when b = 'dockerfile' or b like 'docker-compose%' or suffix in ('.toml', '.yaml', '.yml', '.ini', '.cfg', '.json') then 'CONFIG'
  when suffix in ('.py', '.pyi', '.js', '.jsx', '.ts', '.tsx', '.mjs', '.cjs', '.rs', '.go', '.java', '.kt', '.kts', '.c', '.h', '.cc', '.cpp', '.hpp', '.cs', '.rb', '.php', '.swift', '.scala', '.sh') then 'SOURCE'
  else 'UNKNOWN' end"""


def _tree(now: bool) -> str:
    text = "p_name || case when p_partkey % 5 = 0 then '!' else '' end" if now else "p_name"
    commit = "when p_partkey % 31 = 0 then 'commit'" if now else ""
    mode = "case when p_partkey % 19 = 0 then '100755' else '100644' end" if now else "'100644'"
    return f"""(select ['src', 'docs', 'vendor', 'tests', '.github/workflows', 'gen', 'lib'][p_partkey % 7 + 1] || '/' || replace(p_brand, '#', '-') || '/part-' || p_partkey || ['.py', '.md', '.json', '.ts', '.bin'][p_partkey % 5 + 1] as path,
      case when p_partkey % 50 = 0 then 'tree' {commit} else 'blob' end as entry_type, {mode} as mode, substr(sha256({text}), 1, 40) as object_sha, p_size::bigint * 25000 as size from part where p_partkey % 10 <> {7 if now else 3})"""


TP, TC = _tree(False), _tree(True)


def _surfaced(source: str) -> str:
    return f"""(select * exclude (p, b, parts), {SURFACE} as surface from (select *, lower(path) as p, string_split(lower(path), '/')[-1] as b, string_split(lower(path), '/') as parts, regexp_extract(string_split(lower(path), '/')[-1], '[^.].*?(\\.[^.]+)$', 1) as suffix from {source}))"""


TDELTA = _surfaced(f"""(select coalesce(p.path, c.path) as path, p.entry_type as previous_entry_type, c.entry_type as current_entry_type, p.object_sha as previous_object_sha, c.object_sha as current_object_sha, p.size as previous_size, c.size as current_size,
  case when p.path is null then 'added' when c.path is null then 'removed' when p.entry_type is distinct from c.entry_type then 'type_changed'
    when p.object_sha is distinct from c.object_sha or p.mode is distinct from c.mode or p.size is distinct from c.size then 'modified' end as change_type
  from {TP} p full outer join {TC} c on p.path = c.path where not (coalesce(p.entry_type, 'tree') = 'tree' and coalesce(c.entry_type, 'tree') = 'tree'))""")
TDELTA = f"(select * from {TDELTA} where change_type is not null)"


def _plan(side: str) -> str:
    big = f"case when change_type = 'modified' then greatest(previous_size, current_size) > 1000000 else {side}_size > 1000000 end"
    return f"""case when {side}_entry_type is null then 'absent:path_absent' when {side}_entry_type = 'tree' then 'non_file:directory_entry' when {side}_entry_type = 'commit' then 'non_file:submodule_pointer'
      when surface = 'GENERATED' then 'suppressed:generated_surface' when surface = 'VENDORED' then 'suppressed:vendored_surface' when {big} then 'suppressed:large_blob' else 'capture:eligible_blob' end"""


PLAN = f"""(select *, p not like 'capture%' and c not like 'capture%' and (p like 'suppressed%' or c like 'suppressed%') as policy_suppressed from (select *, {_plan('previous')} as p, {_plan('current')} as c from {TDELTA}))"""
GROUP = "case when not contains(path, '/') then 'root' when starts_with(path, '.github/workflows/') then 'path-prefix:\".github/workflows\"' else 'top-level:\"' || string_split(path, '/')[1] || '\"' end"
TOUCH = "(select ['src', 'docs', 'tests'][l_partkey % 3 + 1] || '/part-' || l_partkey as path, l_orderkey as commit_ordinal from lineitem)"
SEGMENT = f"""(select commit_ordinal, path_group, chunk_ordinal, count(*) as n_paths, string_agg(path, '|' order by path) as paths from
  (select *, (row_number() over (partition by commit_ordinal, path_group order by path) - 1) // 50 + 1 as chunk_ordinal from
    (select path, max(commit_ordinal) // 1000 as commit_ordinal, {GROUP} as path_group from {TOUCH} group by path)) group by all)"""
SIGNAL = f"""(select path, path_group, policy_suppressed as suppressed, list_filter([case when structural then 'structural_delta' end, case when assertion then 'authored_assertion_change' end,
    case when artifact and not structural and not assertion then 'artifact_delta_without_extracted_signal' end, case when not (artifact or structural or assertion or policy_suppressed) then 'git_only_change' end, case when policy_suppressed then 'policy_suppressed' end], lambda x: x is not null) as signals
  from (select *, {GROUP} as path_group, change_type in ('modified', 'removed') as artifact, coalesce(change_type = 'modified' and previous_object_sha <> current_object_sha and not coalesce(current_size > 1000000, false), false) as structural,
    path like '%.md' and change_type <> 'added' and not coalesce(current_size > 1000000, false) as assertion from {PLAN}))"""
TIMELINE = """(select user_id, ts, arg_min(event_id, event_id) as assignment_id, arg_min(level, event_id) as level from
  (select *, case event_type when 'view' then '1' when 'click' then '2' when 'signup' then '3' when 'purchase' then '4' else '0' end as level from events) where level in ('0', '3', '4') group by user_id, ts)"""
ASOF = f"(select e.event_id, e.event_type, t.assignment_id, t.level from events e asof left join {TIMELINE} t on e.user_id = t.user_id and e.ts >= t.ts)"
THREAD = "(select conv_id, turn, lag(turn) over (partition by conv_id order by turn) as parent from (select distinct conv_id, turn from conversations))"
CLOSURE = f"""with recursive edge as (select * from {THREAD} where parent is not null),
  up as (select conv_id, turn as child, parent as ancestor, 1::bigint as distance from edge union all select u.conv_id, u.child, e.parent, u.distance + 1 from up u join edge e on u.conv_id = e.conv_id and u.ancestor = e.turn)"""
HIT = """(select requirement_id, needed_capability, coalesce(bool_or(contains(s, f)), false) as covered from
  (select item_id as requirement_id, case when item_id % 2 = 0 then 'tree' else 'ast' end as needed_capability, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) as f from benchmark)
  left join (select distinct trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) as s from documents) on contains(s, f) group by all)"""
AGAIN = "(select o_orderkey, case when o_orderkey % 7 = 0 then o_orderpriority || '!' else o_orderpriority end as payload from orders)"
URL = "(select page_id as artifact_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') as source_locator from pages)"
SUFFIX = "regexp_extract(lower(string_split(path, '/')[-1]), '[^.].*?(\\.[^.]+)$', 1)"
PY = [("function", "'<module>'", 1), ("assignment", "'f_' || p_partkey", 2), ("call", "'f_' || p_partkey", 2), ("assert", "'f_' || p_partkey", 3)]

MD_PARAGRAPHS = f"select artifact_id, source_locator || ':L' || first_line || '-L' || last_line as locator, statement from {_paragraphs(ART)}"
MD_ITEMS = _items()

PAGES = """(with o as (select o_custkey as k, o_orderkey as o, count(*) over (partition by o_custkey) as total, (row_number() over (partition by o_custkey order by o_orderkey) - 1) // 5 + 1 as page from orders),
  p as (select k, page, any_value(total) as total, list_sort(list(o::varchar)) as items from o group by k, page)
  select 'c' || k as request, k, page, case when k % 5 <> 4 then total + case when k % 11 = 2 and page = 1 then 1 else 0 end end as total, case when k % 13 = 3 and page = 1 then 500 else 200 end as status,
    case when k % 17 = 5 and page = 2 then 'b2' else 'b1' end as base, items, len(items) as n from p, (select unnest(range(1, 3)) as copy) where not (k % 7 = 1 and page = 2) and (copy = 1 or (k % 19 = 6 and page = 1)))"""
PAGE_STATS = f"""(select request, any_value(k) as k, count(*) as n, count(distinct page) as d, min(page) as low, max(page) as high, sum(n) as items, arg_max(n, page) as tail, count(*) filter (n < 5) as short, count(*) filter (status <> 200) as failed,
  count(distinct coalesce(total, -1)) as totals, max(total) as total, count(distinct base) as bases, max(base) as base from {PAGES} group by request)"""
PAGE_FAULTS = f"""(select request, unnest(list_filter([case when failed > 0 then 'page failed' end, case when n > d then 'page twice' end, case when low <> 1 or high <> d then 'page missing' end, case when high > CEILING then 'over the ceiling' end,
  case when short > (tail < 5)::int then 'short page before the last' end, case when totals > 1 then 'total changed' end, case when bases > 1 then 'merge base changed' end, case when total is null and tail = 5 then 'end not seen' end,
  case when totals = 1 and items <> total then 'not as many as declared' end], lambda v: v is not null)) as fault from {PAGE_STATS})"""

RESULTS = """(select (o_custkey % 50)::varchar as c, o_orderkey::varchar as r, o_orderkey % 8 <> 0 and o_orderpriority < '3' as done, case when o_orderkey % 8 = 0 then 'other' when o_orderpriority < '3' then null else o_orderpriority end as need, o_orderkey % 8 <> 0 as checked from orders)"""

ORACLES: dict[str, str] = {
    "path_facts": f"select artifact_id, source_locator || '#$path.' || k as locator, value from {_path_values(URL)}",
    "surface_classify": f"select path, surface from {_surfaced(f'(select path from {TC} union select path from {TP})')}",
    "surface_counts": f"select surface, count(*) as n from {_surfaced(f'(select path from {TC} union select path from {TP})')} group by surface",
    "media_types": f"select case {SUFFIX} when '.py' then 'text/x-python' when '.md' then 'text/markdown' when '.json' then 'application/json' when '.ts' then 'text/typescript' else 'application/octet-stream' end as media_type, count(*) as n, min(path) as first_path from {TC} group by 1",
    "path_groups": f"select {GROUP} as path_group, count(*) as n from {TC} group by 1",
    "safe_paths": f"select artifact_id, len(source_locator) > 0 and len(list_filter(string_split(source_locator, '/'), lambda x: x in ('', '.', '..'))) = 0 as safe from {URL}",
    "md_paragraphs": f"select artifact_id, source_locator || ':L' || first_line || '-L' || last_line as locator, statement from {_paragraphs(ART)}",
    "md_list_items": _items(),
    "json_pointer_leaves": "select event_id as artifact_id, 'event-' || event_id || '.json#/' || k as locator, json_extract(props, '$.' || k)::varchar as value from (select event_id, props, unnest(json_keys(props)) as k from events)",
    "json_diagnostics": "select 'json-pointer' as extractor_name, 'JSONDecodeError' as error_type, count(*) as n from documents",
    "package_json_facts": """select p_partkey as artifact_id, 'p' || p_partkey || '/package.json#' || k as locator, v as value from (select p_partkey, unnest(['$manifest.kind', 'name', 'version', 'dependencies', 'scripts']) as k,
      unnest(['"package.json"', to_json(p_name)::varchar, to_json(p_size::varchar)::varchar, json_object('left', p_brand)::varchar, '["a","build"]']) as v from part)""",
    "pyproject_facts": """select p_partkey as artifact_id, 'pyproject.toml#' || k as locator, v as value from (select p_partkey, unnest(['$manifest.kind', 'project.name', 'project.version', 'project.dependencies', 'build-system.requires']) as k,
      unnest(['"pyproject.toml"', '"' || p_brand || '"', '"' || p_size || '"', '["a","b"]', '["x"]']) as v from part)""",
    "python_ast_facts": " union all ".join(f"select p_partkey as artifact_id, '{k}' as kind, {s} as scope, {n}::bigint as line from part" for k, s, n in PY),
    "typescript_facts": """select case when kind = '' then 'typescript-comment' else 'typescript-lexical' end as extractor_name, kind, n * (select count(*) from part) as n
      from (values ('', 1), ('function', 1), ('declaration', 1), ('call', 1), ('if', 1), ('throw', 1)) t(kind, n)""",
    "evidence_ordinals": f"""select capture_id, fact_index, locator, 'fact:' || sha256('fact' || chr(0) || 'run' || chr(0) || fact_index || chr(0) || 'artifact-path' || chr(0) || locator) as evidence_id from
      (select *, row_number() over (partition by capture_id order by locator, value) as fact_index from (select string_split(source_locator, '/')[1] as capture_id, source_locator || '#$path.' || k as locator, value from {_path_values(ART)}))""",
    "assertion_ordinals": f"""select capture_id, assertion_index, locator, 'assertion:' || sha256('assertion' || chr(0) || 'run' || chr(0) || assertion_index || chr(0) || extractor || chr(0) || locator) as assertion_id from
      (select *, row_number() over (partition by capture_id order by path, first, last, extractor, statement) as assertion_index from (select split_part(locator, '/', 1) as capture_id, locator, extractor, statement,
        regexp_extract(locator, '^(.*):L([0-9]+)-L([0-9]+)$', 1) as path, regexp_extract(locator, ':L([0-9]+)-L([0-9]+)$', 1)::int as first, regexp_extract(locator, ':L([0-9]+)-L([0-9]+)$', 2)::int as last
        from (select locator, statement, 'markdown-prose' as extractor from ({MD_PARAGRAPHS}) union all select locator, statement, 'markdown-list' as extractor from ({MD_ITEMS}))))""",
    "interval_summaries": """with n as (select o_custkey, o_orderpriority, count(*) as n from orders group by all)
      select c_custkey as interval_id, o_orderpriority as policy_version, coalesce(n, 0)::bigint as n_summaries from customer left join n on o_custkey = c_custkey where coalesce(n, 0) <> 1""",
    "envelope_chain": """with c as (select c_custkey as id, exists (select 1 from orders o where o.o_custkey = c_custkey and o_orderkey % 7 = 2) as has_change, exists (select 1 from orders o where o.o_custkey = c_custkey and o_orderkey % 7 = 5) as has_segment from customer)
      select id as interval_id, case when id % 19 = 4 then 'unknown input' when id % 17 = 7 and has_segment then 'other inputs' end as fault,
        case when id % 19 = 4 then 'extraction' when id % 11 = 3 and has_change then 'change' when id % 13 = 5 then 'plan' when id % 17 = 7 and has_segment then 'reduce' end as first_stage,
        case when id % 19 = 4 then 'unknown input' when id % 11 = 3 and has_change then 'other outputs' when id % 13 = 5 or (id % 17 = 7 and has_segment) then 'other inputs' end as first_fault
      from c where id % 19 = 4 or (id % 11 = 3 and has_change) or id % 13 = 5 or (id % 17 = 7 and has_segment)""",
    "ledger_lookup": """select 'fact:' || o_orderkey as evidence_id, 'run-' || o_custkey % 50 as run_id, '{"p":' || to_json(o_orderpriority) || '}' as normalized_value from orders where o_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R')""",
    "ledger_point": """select 'fact:' || o_orderkey as evidence_id, 'run-' || o_custkey % 50 as run_id, '{"p":' || to_json(o_orderpriority) || '}' as normalized_value from orders order by o_totalprice desc, o_orderkey limit 3""",
    "ledger_run": """select 'fact:' || o_orderkey as evidence_id, 'c' || o_custkey as artifact_id, '{"p":' || to_json(o_orderpriority) || '}' as normalized_value from orders where o_custkey % 50 = 7""",
    "strict_pair_faults": """with s as (select s_suppkey as id, s_nationkey in (select c_nationkey from customer where c_acctbal < -900) as bad, s_suppkey % 3 = 0 as tolerant from supplier),
      sides as (select id as pair_id, 'previous' as side, id as run from s union all select id, 'current', id + 1 from s), m as (select pair_id, side, coalesce(bad, false) as bad, coalesce(tolerant, true) as loose from sides left join s on s.id = run)
      select pair_id, side || ': diagnostics' as fault from m where bad union all select pair_id, side || ': not strict' from m where loose""",
    "foreign_evidence": """select l_orderkey as run_id, l_partkey as artifact_id, count(*) as n from lineitem where l_partkey not in (select p_partkey from part where p_size <> 7) group by all""",
    "python_nodes": """with m as (select p_partkey as k, p_size as z from part), c as (select k, 'C' || k as c, z % 3 as z3 from m)
      select k as artifact_id, 'class' as kind, '<module>' as scope, c as name, '' as targets, 6::bigint as n_inside from c
      union all select k, 'function', c, c || '.run', '', 5 from c union all select k, 'assignment', c || '.run', null, 'y', 1 from c union all select k, 'call', c || '.run', 'make_' || z3, '', 0 from c
      union all select k, 'assert', c || '.run', null, '', 0 from c union all select k, 'function', c || '.run', c || '.run.inner', '', 1 from c
      union all select k, 'call', c || '.run.inner', 'helper', '', 0 from c union all select k, 'call', '<module>', 'helper', '', 0 from c""",
    "python_selectors": """with m as (select p_partkey as k, 'C' || p_partkey || '.run' as r, p_size as z from part),
      x as (select k, list_filter([case when not (z % 3 = 1 and z % 5 = 2) then 'call:' || r || ':make_1' end, case when not (z % 3 = 0 and z % 5 = 1) then 'assignment:' || r || ':y:make_0' end,
        case when z % 4 <> 3 then 'assert:' || r || ':Y > 3' end, case when z % 2 <> 1 then 'call:' || r || '.inner:helper' end, case when k % 3 <> 0 then 'call:<module>:helper' end], lambda v: v is not null) as missing from m)
      select k::varchar as requirement_id, case when len(missing) = 0 then 'recovered' else 'gap' end as status, case when len(missing) = 0 then 6 else 0 end::int as n_locators, len(missing)::int as n_missing, array_to_string(missing, '|') as missing from x""",
    "fragments_over_assertions": f"""with s as (select regexp_extract(locator, '^(.*):L[0-9]+-L[0-9]+$', 1) as artifact, regexp_extract(locator, ':L([0-9]+)-', 1)::int as line, statement from ({MD_PARAGRAPHS})),
      t as (select artifact, trim(regexp_replace(lower(string_agg(statement, chr(10) order by line, statement)), '\\s+', ' ', 'g')) as text, arg_min(statement, line) as a, arg_max(statement, line) as b from s group by artifact)
      select artifact, contains(text, lower(string_split(a, ' ')[-1]) || ' ' || lower(string_split(b, ' ')[1])) as covered from t""",
    "locator_prefixes": """with e as (select p_type || case when p_size % 2 = 0 then ':' || p_brand else '' end || ':L' || p_size || '#x' as locator, p_partkey from part),
      w as (select distinct unnest([p_type, p_type || ':' || p_brand]) as artifact from part)
      select artifact, count(*) as n, sum(p_partkey)::bigint as keys from w join e on starts_with(locator, artifact || ':') or starts_with(locator, artifact || '#') group by artifact""",
    "golden_probe": """with g as (select distinct l_orderkey as group_id, 'part:' || l_partkey % 97 as locator from lineitem), r as (select 'part:' || s_suppkey % 61 as locator, count(*) as n from supplier group by 1 having locator <> 'part:5')
      select group_id, count(*) as n_locators, count(*) filter (n is null) as n_missing, count(*) filter (n > 1) as n_ambiguous, bool_and(coalesce(n, 0) = 1) as covered from g left join r using (locator) group by group_id""",
    "golden_supports": """with r as (select 'p:' || l_partkey as locator, count(*) as n, min(l_orderkey || '-' || l_linenumber) as id from lineitem where l_quantity > 25 and length(l_orderkey || '-' || l_linenumber) % 2 = 0 group by 1)
      select 'p:' || p_partkey as locator, coalesce(n, 0)::bigint as n_records, case when n is null then 'no record' when n > 1 then 'several records' end as fault, case when n = 1 then id end as support_id from part left join r on r.locator = 'p:' || p_partkey""",
    "page_faults": f"select * from {PAGE_FAULTS.replace('CEILING', '4')}",
    "page_items": f"""select request, ((page - 1) * 5 + i)::bigint as ordinal, items[i] as item from (select *, unnest(range(1, n + 1)) as i from {PAGES}) where request not in (select request from {PAGE_FAULTS.replace('CEILING', '4')})""",
    "commit_range_faults": f"""with s as (select s.*, (select arg_max(items[-1], page) from {PAGES} p where p.request = s.request) as last, (select count(distinct i) from (select unnest(items) as i from {PAGES} p where p.request = s.request)) as distinct_items from {PAGE_STATS} s),
      r as (select *, case when k % 10 = 9 then 'identical' when k % 23 = 7 then 'behind' else 'ahead' end as state, case when k % 3 = 0 then 'b0' else 'b1' end as wanted, case when k % 4 = 1 then 'x' else last end as head from s)
      select * from {PAGE_FAULTS.replace('CEILING', '12')} union all
      select request, unnest(list_filter([case when state = 'behind' then 'unknown status' end, case when base <> wanted then 'merge base isn''t the base' end, case when state = 'identical' then 'commits in an identical range' end,
        case when items > distinct_items then 'repeated commits' end, case when items > 12 then 'over the commit ceiling' end, case when state = 'ahead' and head <> last then 'doesn''t end at the head' end], lambda v: v is not null)) from r""",
    "identity_merge": """with recursive c as (select c_custkey as k, c_custkey // 3 as g from customer), e as (select 'n:r' || k as a, case when g % 9 <> 8 then 'p:id' || g else 'n:r' || k end as b from c
        union all select 'n:r' || k, 'n:r' || (k + 1) from c where k % 5 = 0),
      both_ as (select a, b from e union select b, a from e), reach as (select a as x, a as y from both_ union select r.x, b.b from reach r join both_ b on r.y = b.a), comp as (select x as node, min(y) as component from reach group by x),
      known as (select distinct 'p:id' || g as node, 's' || g % 11 as s from c where g % 9 <> 8 and (g % 4 = 0 or g % 7 = 0)), src as (select component, count(distinct s) as n, min(s) as s from known join comp using (node) group by component),
      ids as (select distinct component from comp where node like 'p:%'), names as (select component, k, 'r' || k as name, k as seen from c join comp on node = 'n:r' || k union all select component, k + 1, 'r' || (k + 1), null from c join comp on node = 'n:r' || (k + 1) where k % 5 = 0),
      al as (select component, arg_max(name, seen) as latest, list_sort(list_distinct(list(name))) as names from names group by component)
      select k as hit_id, case when coalesce(src.n, 0) > 1 then 'conflict' when src.n = 1 then 'resolved' when ids.component is not null then 'created' else 'unresolved' end as state, case when src.n = 1 then s end as source_id, comp.component,
        array_to_string(list_filter(names, lambda x: x <> latest), ',') as aliases
      from c join comp on comp.node = 'n:r' || k join al on al.component = comp.component left join src on src.component = comp.component left join ids on ids.component = comp.component""",
    "typescript_scopes": """with p as (select p_partkey as k, length(p_partkey::varchar) as w, p_size % 3 as n from part)
      select k as artifact_id, '4-2-4-66' as at, 'method_definition' as node_type, 'go' as what, null as arguments from p union all select k, '4-22-4-40', 'variable_declarator', 'é', null from p union all select k, '4-31-4-36', 'call_expression', 'f' || n, '["a"]' from p
      union all select k, '4-49-4-64', 'call_expression', '/[)(]/.test', '["é"]' from p union all select k, '6-13-9-1', 'variable_declarator', 'h' || k, null from p
      union all select k, '6-' || (17 + w) || '-9-1', 'arrow_function', null, null from p union all select k, '7-2-7-29', 'if_statement', '(!x)', null from p union all select k, '7-12-7-27', 'throw_statement', 'new E(x)', null from p
      union all select k, '8-9-8-30', 'call_expression', 'a.b(x)?.c' || n, '["1","[2, 3]"]' from p union all select k, '8-9-8-15', 'call_expression', 'a.b', '["x"]' from p""",
    "tracking_assignments": """with e as (select event_id as seq, user_id as s, event_type as level, case when event_id % 29 <> 5 then 'me' end as who, epoch_us(date_trunc('day', ts)) as recorded from events),
      src as (select s, min(recorded) + case when s % 5 = 0 then 5 * 86400000000 else 0 end as seen from e where s % 7 <> 3 group by s), q as (select e.*, seen, case when seq % 9 = 4 then recorded + 1 else recorded end as effective from e left join src using (s)),
      f as (select *, coalesce(seen is not null and who is not null and effective = recorded and effective >= seen, false) as fits from q), m as (select *, max(case when fits then recorded end) over (partition by s order by seq rows between unbounded preceding and 1 preceding) as latest from f),
      taken as (select s, effective, seq as first, level as said from m where fits and (latest is null or recorded > latest))
      select m.seq as event_id, case when seen is null then 'unknown source' when who is null then 'empty field' when first < m.seq and said = level then 'replayed' when first < m.seq then 'occupied' when m.effective <> recorded then 'not immediate'
        when m.effective < seen then 'before the source' when recorded < latest then 'clock moved back' else 'recorded' end as state from m left join taken t on t.s = m.s and t.effective = m.effective""",
    "workflow_payload_facts": """with o as (select o_orderkey as k, '$run/' || o_orderkey || '#' as root, o_orderstatus as st, nullif(o_orderpriority, '1-URGENT') as c, count(*) as n from orders join lineitem on l_orderkey = o_orderkey group by all),
      j as (select k, root, row_number() over (partition by k order by l_linenumber, l_returnflag, l_linestatus, l_quantity) as ln, l_returnflag as rf, l_linestatus as ls, l_quantity as q, n from o join lineitem on l_orderkey = k),
      f as (select k, 1 as a, 0 as b, 0 as c, root || '/run/id' as locator, k::varchar as v from o union all select k, 2, 0, 0, root || '/run/status', st from o union all select k, 3, 0, 0, root || '/run/conclusion', c from o
        union all select k, 4, 0, 0, root || '/job_count', (n + case when k % 9 = 2 then 1 else 0 end)::varchar from o union all select k, 5, 0, 0, root || '/artifact_count', n::varchar from o
        union all select k, 6, ln, x, root || '/jobs/' || ln || p, v from (select *, unnest([{'x': 1, 'p': '/id', 'v': ln::varchar}, {'x': 2, 'p': '/name', 'v': rf}, {'x': 3, 'p': '/log/availability', 'v': 'available'}, {'x': 4, 'p': '/log/http_status', 'v': case when ln % 2 = 0 then '302' end},
          {'x': 5, 'p': '/steps/1/number', 'v': '1'}, {'x': 6, 'p': '/steps/1/name', 'v': 's' || rf}, {'x': 7, 'p': '/steps/1/conclusion', 'v': case when ls = 'O' then 'success' end},
          {'x': 8, 'p': '/steps/2/number', 'v': '2'}, {'x': 9, 'p': '/steps/2/name', 'v': 's' || rf}, {'x': 10, 'p': '/steps/2/conclusion', 'v': case when ls = 'O' then 'success' end}], recursive := true) from j)
        union all select k, 7, ln, 1, root || '/artifacts/' || ln || '/id', ln::varchar from j union all select k, 7, ln, 2, root || '/artifacts/' || ln || '/size_in_bytes', q::bigint::varchar from j)
      select k as artifact_id, row_number() over (partition by k order by a, b, c) as fact_index, locator, coalesce(v, 'null') as normalized_value from f""",
    "workflow_count_faults": "select distinct l_orderkey as artifact_id, 'jobs differ from job_count' as fault from lineitem join orders on o_orderkey = l_orderkey where l_orderkey % 9 = 2",
    "commit_payload_facts": """with c as (select o_orderkey as k, * from orders), f as (select k, unnest([{'i': 1, 'p': 'commit_sha', 'v': k::varchar}, {'i': 2, 'p': 'tree_sha', 'v': o_orderstatus}, {'i': 3, 'p': 'parents', 'v': case when k % 5 <> 0 then '["' || (k - 1) || '"]' end},
        {'i': 4, 'p': 'parent_count', 'v': case when k % 5 <> 0 then '1' else '0' end}, {'i': 5, 'p': 'author_timestamp', 'v': strftime(o_orderdate, '%Y-%m-%d')}, {'i': 6, 'p': 'committer_timestamp', 'v': null}]
        || case when k % 3 = 0 then [{'i': 7, 'p': 'verification/verified', 'v': (k % 2 = 0)::varchar}, {'i': 8, 'p': 'verification/reason', 'v': 'valid'}] else [] end, recursive := true) from c)
      select k as artifact_id, 'fact:' || sha256('fact' || chr(0) || 'r' || chr(0) || i || chr(0) || '$git/commit#/' || p) as evidence_id, '$git/commit#/' || p as locator, coalesce(v, 'null') as normalized_value from f""",
    "commit_message_check": """with m as (select o_orderkey as k, o_orderkey % 6 <> 0 as has, lower(o_orderpriority) as p, case when o_orderkey % 2 = 0 then 'urgent' else 'low' end as want from orders),
      x as (select k, case when not has then 'order OF|' || want when not contains('order of ' || p, want) then want else '' end as missing, has from m)
      select k as requirement_id, case when missing = '' then 'recovered' else 'gap' end as status, case when missing = '' then '$git/commit#message' end as locator, missing, case when missing <> '' then case when k % 4 = 0 then 'x' else 'commit-metadata-and-change-facts' end end as needed_capability from x""",
    "event_payload_facts": """with e as (select user_id as u, event_id as id, event_type as t, row_number() over (partition by user_id order by event_id) - 1 as pl from events), n as (select u, count(*) as n from e group by u),
      f as (select u, -1 as pl, 1 as x, 'repository_full_name' as p, 'o/n' as v from n union all select u, -1, 2, 'issue_number', u::varchar from n union all select u, -1, 3, 'event_count', n::varchar from n
        union all select u, pl, 1, 'events/' || pl || '/provider_id', id::varchar from e union all select u, pl, 2, 'events/' || pl || '/event', t from e where t is not null union all select u, pl, 3, 'events/' || pl || '/commit_id', id::varchar from e where id % 3 = 0)
      select u as artifact_id, row_number() over (partition by u order by pl, x) as fact_index, 'i/' || u || '#/' || p as locator, v as normalized_value from f""",
    "family_counts": """select 'artifact-path' as extractor_name, 4 * count(*) as n_facts from documents union all select 'git-commit-metadata', sum(case when o_orderkey % 3 = 0 then 8 else 6 end)::bigint from orders""",
    "report_lines": f"""with x as (select * from {RESULTS}), t as (select count(distinct c) as c, count(*) as n, count(*) filter (done) as r from x)
      select 1 as section, '' as key, 0 as "at", '- Cases: **' || c || '**' as line from t union all select 1, '', 1, '- Requirements: **' || n || '**' from t union all select 1, '', 2, '- Recovered: **' || r || '**' from t
      union all select 1, '', 3, '- Gaps: **' || (n - r) || '**' from t union all select 1, '', 4, '- Fraction: **' || printf('%.3f', r / n) || '**' from t
      union all select 2, c, 0, '| `' || c || '` | ' || count(*) filter (done) || ' | ' || count(*) || ' | ' || printf('%.3f', round(count(*) filter (done) / count(*), 6)) || ' |' from x group by c
      union all select 3, need, 0, '- `' || need || '`: ' || count(*) from x where not done group by need
      union all select 4, c || '/' || r, 0, '- `' || r || '`: **' || case when done then 'recovered**' else 'gap** needs `' || need || '`' end from x union all select 4, c || '/' || r, 1, '  - matched: `a:' || r || '`' from x where done
      union all select 4, c || '/' || r, 1, '  - missing: `f`' from x where checked and not done union all select 4, c || '/' || r, 2, '  - missing: `g`' from x where checked and not done""",
    "report_cases": f"select c as case_id, count(*) filter (done) as recovered, count(*) as total, round(count(*) filter (done) / count(*), 6) as fraction from {RESULTS} group by c",
    "watchlist_candidates": "select c_custkey as position, c_name as discovered_locator, case when c_custkey % 3 = 0 then 's' || c_custkey end as source_id from customer",
    "elapsed_seconds": """select l_returnflag, sum(s)::bigint as seconds, count(s) as n from (select l_returnflag, case when l_orderkey % 5 <> 0 then epoch(l_shipdate::timestamp)::bigint - epoch(o_orderdate::timestamp)::bigint end as s from lineitem join orders on o_orderkey = l_orderkey) group by 1""",
    "policy_faults": """with o as (select o_orderkey as k from orders), f as (select k, 'proposal' as what, 'empty source_id' as fault from o where k % 7 = 1 union all select k, 'proposal', 'empty rationale' from o where k % 11 = 2
        union all select k, 'rule', 'repeated action type' from o where k % 5 = 1 union all select k, 'rule', 'no action type' from o where k % 5 = 2 union all select k, 'rule', 'no support' from o where k % 4 = 0
        union all select k, 'rule', 'no role' from o where k % 3 = 0 and k % 2 = 1 union all select k, 'rule', 'role without need' from o where k % 3 <> 0 and k % 2 = 0
        union all select k, 'support', 'not direct' from o where k % 3 = 2 union all select k, 'support', 'fact without a value' from o where k % 3 = 0 and k % 2 = 1 union all select k, 'support', 'fact with fragments' from o where k % 3 = 0 and k % 5 < 2
        union all select k, 'support', 'assertion with a value' from o where k % 3 = 1 and k % 2 = 0 union all select k, 'support', 'assertion without fragments' from o where k % 3 = 1 and k % 5 <> 1)
      select what, fault, count(*) as n, min(k) as first from f group by what, fault""",
    "run_envelopes": f"""with r as (select string_split(source_locator, '/')[1] as capture_id, sha256('{{"locator":' || to_json(source_locator || '#$path.' || k) || ',"normalized_value":' || to_json(value) || '}}') as h from {_path_values(ART)}),
      parts as (select capture_id, h[1:2] as p, sha256(string_agg(h, chr(10) order by h)) as part, count(*) as n from r group by all)
      select capture_id, sum(n)::bigint as n_rows, 'sha256:' || sha256(string_agg(p || ':' || part, chr(10) order by p)) as outputs_hash from parts group by 1""",
    "locator_slices": f"""select p.artifact_id, p.source_locator || ':L' || first_line || '-L' || last_line as locator, 'text_lines' as location_kind, string_agg(line || case when n < last then ' ' else '' end, '' order by n) as excerpt
      from {_paragraphs(ART)} p join (select *, max(n) over (partition by artifact_id) as last from {_marked(ART)}) l on p.artifact_id = l.artifact_id and l.n between first_line and last_line group by all""",
    "inspect_paths": f"select artifact_id, source_locator || '#$path.' || k as locator, value as excerpt, true as agrees from {_path_values(ART)}",
    "inspect_ranges": f"""with a as (select artifact_id, source_locator, text, string_split(text, chr(10)) as parts from {ART} where text is not null),
      l as (select *, list_transform(list_filter(range(1, len(parts) + 1), lambda i: i < len(parts) or parts[i] <> ''), lambda i: parts[i] || case when i < len(parts) then chr(10) else '' end) as ls from a),
      t as (select *, case when artifact_id % 2 = 0 then least(len(ls), 3) else 1 end as last, artifact_id % 5 as c1, artifact_id % 11 + 4 as c2 from l),
      b as (select *, hex(encode(ls[1])) as h1, hex(encode(ls[last])) as h2, case when last > 2 then hex(encode(ls[2])) else '' end as mid from t),
      x as (select *, case when last = 0 or 2 * c1 > len(h1) or 2 * c2 > len(h2) then null when last = 1 then h1[2 * c1 + 1:2 * c2] else h1[2 * c1 + 1:] || mid || h2[:2 * c2] end as h from b)
      select artifact_id, source_locator || ':L1:C' || c1 || '-L' || last || ':C' || c2 || '#x' as locator,
        'sha256:' || sha256(coalesce(case when h = '' then '' when h is not null and not regexp_matches(h, '^(..)*?$', 's') then null
          when h is not null and try(decode(unhex(h))) is not null then try(decode(unhex(h))) end, 'none')) as excerpt_hash from x""",
    "inspect_toml": """select p_partkey as artifact_id, 'pyproject.toml#project.' || k as locator, case k when 'name' then to_json(p_brand)::varchar when 'size' then p_size::varchar end as value, case when k = 'none' then 'KeyError' end as error
      from part, (values ('name'), ('size'), ('none')) v(k)""",
    "delta_identities": f"""with a as (select source_locator, change_type, 'artifact-delta:' || sha256('artifact-delta' || chr(0) || 'run' || chr(0) || source_locator) as id from {ADELTA} where change_type is not null)
      select 'artifact' as kind, source_locator as at, id from a union all
      select 'structure', source_locator || '|' || structural_key, 'structural-delta:' || sha256('structural-delta' || chr(0) || 'run' || chr(0) || a.id || chr(0) || structural_key || chr(0) || s.change_type) from {SDELTA} s join (select * from a where change_type in ('content_changed', 'metadata_changed')) a using (source_locator) where s.change_type is not null
      union all select 'path', path, 'git-path-delta:' || sha256('git-path-delta' || chr(0) || 'run' || chr(0) || 'previous' || chr(0) || 'current' || chr(0) || path || chr(0) || change_type) from {TDELTA}""",
    "inspect_pointers": "select event_id as artifact_id, 'event-' || event_id || '.json#/' || k as locator, json_extract(props, '$.' || k)::varchar as value from (select event_id, props, unnest(json_keys(props)) as k from events)",
    "artifact_delta": f"select source_locator, change_type, previous_content_hash, current_content_hash from {ADELTA} where change_type is not null",
    "artifact_delta_counts": f"select change_type, count(*) as n from {ADELTA} where change_type is not null group by change_type",
    "structural_delta": f"select source_locator, structural_key, change_type, previous_value, current_value from {SCHANGED}",
    "structural_delta_gaps": f"""select change_type, count(*) as n from {SCHANGED} and source_locator not in (select source_locator from {PREV} where text like '%|%' union select source_locator from {CUR} where text like '%|%') group by change_type""",
    "unexplained_structure": f"""select p.source_locator, 'length' as extractor_name from {PREV} p join {CUR} c on p.source_locator = c.source_locator where p.retrieval_status = 'captured' and c.retrieval_status = 'captured' and p.artifact_id % 23 = 9
      and p.source_locator not in (select source_locator from {ADELTA} where change_type is not null)""",
    "assertion_changes": f"""with sig as (select side, source_locator, string_agg(statement, chr(1) order by statement) as s, count(*) as n from
        (select 'p' as side, * from {_paragraphs(f"(select * from {PREV} where retrieval_status = 'captured')")} union all select 'c', * from {_paragraphs(f"(select * from {CUR} where retrieval_status = 'captured')")}) group by side, source_locator)
      select coalesce(p.source_locator, c.source_locator) as source_locator, coalesce(p.n, 0)::bigint as previous_n, coalesce(c.n, 0)::bigint as current_n
      from (select * from sig where side = 'p') p full outer join (select * from sig where side = 'c') c on p.source_locator = c.source_locator where p.s is distinct from c.s""",
    "tree_path_diff": f"select path, change_type, surface, previous_object_sha, current_object_sha from {TDELTA}",
    "diff_summary": f"select surface, change_type, count(*) as delta_count from {TDELTA} group by all",
    "materiality": """select o_orderkey, case when p = o_orderkey then 'same_revision' when pt = o_orderpriority then 'tree_unchanged' else 'tree_changed' end as reason, pt <> o_orderpriority as material from
      (select *, lag(o_orderkey) over w as p, lag(o_orderpriority) over w as pt from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)) where p is not null""",
    "capture_plan": f"select path, string_split(p, ':')[1] as previous_disposition, string_split(p, ':')[2] as previous_reason, string_split(c, ':')[1] as current_disposition, string_split(c, ':')[2] as current_reason, policy_suppressed from {PLAN}",
    "required_paths": f"select 'previous' as side, path from {PLAN} where p like 'capture%' or (p like 'absent%' and c like 'capture%') union all select 'current', path from {PLAN} where c like 'capture%' or (c like 'absent%' and p like 'capture%')",
    "suppressed_paths": f"select path, coalesce(case when c like 'suppressed%' then string_split(c, ':')[2] end, string_split(p, ':')[2]) as reason from {PLAN} where policy_suppressed",
    "first_parent_chain": f"with recursive t as (select * from {THREAD}), r as (select conv_id, turn, 0::bigint as place from t where parent is null union all select t.conv_id, t.turn, r.place + 1 from t join r on t.conv_id = r.conv_id and t.parent = r.turn) select conv_id, turn, place from r",
    "latest_touch": f"select path, max(commit_ordinal) as commit_ordinal from {TOUCH} group by path",
    "commit_snapshots": f"select commit_ordinal as ordinal, string_agg(distinct path, '|' order by path) as touched_paths from {TOUCH} group by 1",
    "candidate_segments": f"select * from {SEGMENT}",
    "candidate_size_stats": f"select count(*) as n_candidates, median(n_paths)::double as median_paths, max(n_paths) as max_paths, quantile_disc(n_paths, 0.95) as p95_paths from {SEGMENT}",
    "exact_cover": """select path, case when path like '%7' then 0 else 2 end::bigint as n from (select distinct ['src', 'docs', 'tests'][(l_partkey % 3 + 1)::int] || '/part-' || l_partkey as path from lineitem) where path like '%7' or path like '%11'""",
    "candidate_reduction": f"select path_group, count(*) as n_paths, array_to_string(list_sort(list_distinct(flatten(list(signals)))), '|') as signal_kinds, case when bool_and(suppressed) then 'suppress' else 'retain' end as disposition from {SIGNAL} group by path_group",
    "reduction_counts": f"select disposition, count(*) as n from (select array_to_string(string_split(path, '/')[1:2], '/') as folder, case when bool_and(suppressed) then 'suppress' else 'retain' end as disposition from {SIGNAL} group by 1) group by 1",
    "signal_counts": f"select signal, count(*) as n from (select unnest(signals) as signal from {SIGNAL}) group by 1",
    "gap_signals": f"""select source, string_agg(distinct source_locator, '|' order by source_locator) as paths, coalesce(string_agg(case when side = 'previous' then id end, '|' order by id), '') as previous_diagnostic_ids, coalesce(string_agg(case when side = 'current' then id end, '|' order by id), '') as current_diagnostic_ids
      from {ART} join (select source_locator, 'previous' as side, 'previous-' || artifact_id as id from {PREV} where text like '%|%' union all select source_locator, 'current', 'current-' || artifact_id from {CUR} where text like '%|%') using (source_locator) group by source""",
    "change_signal_counts": f"""with t as (select source_locator as path, substr(coalesce(content_hash, 'sha256:missing'), 8, 40) as sha, strlen(coalesce(text, '')) as size from {PREV}), u as (select source_locator as path, substr(coalesce(content_hash, 'sha256:missing'), 8, 40) as sha, strlen(coalesce(text, '')) as size from {CUR}),
      d as (select coalesce(t.path, u.path) as path from t full outer join u on t.path = u.path where t.path is null or u.path is null or t.sha <> u.sha or t.size <> u.size),
      c as (select d.path, string_split(d.path, '/')[1] as grp, coalesce(case when artifact_id % 2 = 0 then artifact_id % 9 + 1 end, 0) as ord from d join {ART} a on d.path = a.source_locator),
      k as (select ord, grp, (row_number() over (partition by ord, grp order by path) - 1) // 50 as chunk from c), n as (select count(*) as n from (select distinct ord, grp, chunk from k))
      select 'artifact deltas' as what, count(*) as n from {ADELTA} where change_type is not null union all select 'path deltas', count(*) from d union all select 'candidate paths', count(*) from c
      union all select 'retained', n from n union all select 'reductions', n from n union all select 'gaps', 0 union all select 'structural deltas', 0""",
    "asof_tracking": f"select event_id, assignment_id, level from {ASOF}",
    "tracking_policy": f"""select event_id, case coalesce(level, '0') when '0' then 'none' when '3' then 'structural' else 'deep' end as capture_depth, case coalesce(level, '0') when '0' then 'never' else 'revision' end as polling_mode, coalesce(level, '0') <> '0' as reasoning_allowed from {ASOF}""",
    "tracking_history": f"select assignment_id, lag(assignment_id) over w as supersedes, row_number() over w as version from {TIMELINE} window w as (partition by user_id order by ts, assignment_id)",
    "tracking_gates": f"select event_id from {ASOF} where case coalesce(level, '0') when '0' then 0 when '3' then 3 else 4 end < case when event_type = 'purchase' then 4 else 2 end or (event_type = 'error' and coalesce(level, '0') <> '4')",
    "latest_locator": "select o_custkey, o_orderkey, o_orderdate, o_orderpriority from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as k from orders) where k = 1",
    "discovery_dedupe": "select discovered_locator, position, row_number() over (order by position) as ordinal from (select regexp_extract(url, '^[a-z]+://([^/]+)', 1) as discovered_locator, min(page_id) as position from pages group by 1)",
    "registry_resolve": """select c_name as discovered_locator, case when c_acctbal > 0 then case when n_nationkey is null then 'created' else 'resolved' end else 'unresolved' end as state,
      case when c_acctbal > 0 and n_nationkey is not null then 'nation-' || n_nationkey end as source_id from customer left join (select * from nation where n_regionkey < 3) on c_nationkey = n_nationkey""",
    "profile_features": f"""with p as (select string_split(source_locator, '/')[1] as source_id, count(*) as n from {_paragraphs(ART)} group by 1), a as (select string_split(source_locator, '/')[1] as source_id, count(*) as n from {ART} group by 1)
      select a.source_id, case when p.n > 0 then 'artifact-path|markdown-prose' else 'artifact-path' end as extractor_families, 'text/markdown' as artifact_media_types, a.n as artifact_count, 4 * a.n as evidence_fact_count, coalesce(p.n, 0) as source_assertion_count,
        case when p.n > 0 then 'extractor:artifact-path|extractor:markdown-prose|media:text/markdown' else 'extractor:artifact-path|media:text/markdown' end as feature_keys from a left join p using (source_id)""",
    "triage_band": """select c_custkey, case when level = 0 then 'ignore' when dm and level >= 4 and ch and (gov or ex) then 'deep_dive' when dm and (ch or gov or ex or wf or rich) then 'review' else 'watch' end as band,
      array_to_string(list_sort(list_filter([case when level = 0 then 'tracking_ignored' else 'tracking_active' end, case when dm then 'domain_match' else 'domain_mismatch' end, case when rich then 'evidence_rich' end, case when wf then 'workflow_rich' end,
        case when ch then 'recent_structural_change' end, case when gov then 'governance_sensitive' end, case when ex then 'experiment_sensitive' end, case when level >= 4 then 'deep_tracking' end], lambda x: x is not null)), '|') as reasons
      from (select c_custkey, c_nationkey % 6 as level, c_mktsegment in ('BUILDING', 'MACHINERY') as dm, c_acctbal > 5000 as ch, c_nationkey % 3 = 0 as gov, c_nationkey % 4 = 0 as ex, c_acctbal > 0 as rich, c_custkey % 2 = 0 as wf from customer)""",
    "action_policy": """select action_id, decision, case when decision = 'blocked' then 'rejected' else 'recommended' end as status, matched as matched_rule_ids from
      (select *, case when (md and not cw) or (kind = 'contribute_upstream' and not cc) or kind = 'adopt' or (kind = 'pin' and not maint) then 'blocked' when kind in ('contribute_upstream', 'pin') then 'requires_authorization' else 'recommended' end as decision,
        case kind when 'adopt' then 'r1|r2' when 'pin' then 'r2|r3' when 'contribute_upstream' then 'r3' else '' end as matched from
      (select o_orderkey as action_id, case left(o_orderpriority, 1) when '1' then 'contribute_upstream' when '2' then 'adopt' when '3' then 'pin' else 'monitor' end as kind, o_custkey % 2 = 0 as maint, o_totalprice > 150000 as md, o_custkey % 3 <> 0 as cw, o_custkey % 5 <> 0 as cc from orders))""",
    "readiness_outcome": """select case_id, sum((r > 0)::int)::bigint as n_missing, case max(r) when 2 then 'deferred' when 1 then 'blocked' else 'ready' end as outcome from
      (select case_id, case c when 'c4' then 2 when 'c3' then 1 when 'c6' then 1 else 0 end as r from (select distinct p_partkey as case_id, unnest(['c' || (p_size % 7), 'c' || (p_partkey % 5)]) as c from part)) group by case_id""",
    "review_faults": "select o_orderkey as review_id from orders left join (select * from customer where c_acctbal > 0) on o_custkey = c_custkey where o_custkey % 4 = 0 or o_orderstatus <> 'F' or c_custkey is null",
    "support_closure": f"{CLOSURE} select conv_id, child, ancestor, distance from up",
    "observation_revisions": f"{CLOSURE} select up.conv_id || ':' || child as child, count(distinct role) as n_revisions, min(role) as revision from up join conversations c on up.conv_id = c.conv_id and up.ancestor = c.turn group by 1",
    "supersession": "select event_id, lead(event_id) over w as superseded_by, case when lead(event_id) over w is null then 'current' else 'superseded' end as state from events window w as (partition by user_id order by ts, event_id)",
    "event_transition": "select s.user_id, s.from_at, min(e.ts) as to_at from (select user_id, min(ts) as from_at from events where event_type = 'signup' group by 1) s left join events e on e.user_id = s.user_id and e.event_type = 'error' and e.ts > s.from_at group by 1, 2",
    "pattern_min_sources": """select event_type, count(distinct case when value > 50 then user_id end) as n_supporting, count(distinct case when not coalesce(value > 50, false) then user_id end) as n_controls, count(*) as n_occurrences,
      count(distinct case when value > 50 then user_id end) >= 2 and count(distinct case when not coalesce(value > 50, false) then user_id end) >= 1 as holds from events group by event_type""",
    "coverage_fraction": f"select coalesce(needed_capability, 'total') as needed_capability, count(*) as n_required, count(*) filter (covered) as n_covered, round(avg(covered::int), 6) as fraction from {HIT} group by rollup (needed_capability)",
    "coverage_gaps": f"select needed_capability, count(*) as n_gaps from {HIT} where not covered group by 1",
    "append_idempotent": f"select a.o_orderkey, a.payload from {AGAIN} a left join orders o on a.o_orderkey = o.o_orderkey and o.o_orderkey % 3 <> 0 where o.o_orderkey is null",
    "conflict_rows": f"select a.o_orderkey from {AGAIN} a join orders o on a.o_orderkey = o.o_orderkey and o.o_orderkey % 3 <> 0 where a.payload <> o.o_orderpriority",
    "content_dedupe": "select 'sha256:' || sha256(text) as content_hash, count(*) as n, min(doc_id) as first_id from documents group by 1",
    "capture_manifests": f"select a.source as capture_id, count(*) as n_refs, count(*) filter (c.source_locator is null) as n_missing from {ART} a left join (select * from {CUR} where retrieval_status = 'captured') c using (source_locator) group by 1",
    "reconstruction_faults": f"""with kept as (select * from {ART} where artifact_id % 17 <> 0), objects as (select distinct sha256(text) as h from kept where source_locator not like '%9.md')
      select * from (select 'no artifact' as fault, count(*) as n from {ART} where artifact_id % 17 = 0 union all select 'no object', count(*) from {ART} where sha256(text) not in (select h from objects)) where n > 0""",
    "provider_facts": """select s_suppkey as artifact_id, unnest(['$x#/name', '$x#/nation']) as locator, unnest([s_name, case when s_nationkey = 3 then 'null' else s_nationkey::varchar end]) as value from supplier""",
    "lineage_integrity": """select r_name, count(*) as n_lines, count(distinct o_orderkey) as n_orders from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1""",
    "orphans": "select 'parts' as what, count(*) as n from part where p_partkey not in (select l_partkey from lineitem) union all select 'labels', count(*) from labels where doc_id not in (select doc_id from documents)",
    "closed_set_check": """select * from (select 'left' as side, count(*) as n from (select doc_id from labels except select doc_id from documents) union all select 'right', count(*) from (select doc_id from documents except select doc_id from labels)) where n > 0""",
    "duplicate_keys": "select count(*) as n from (select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1)",
    "count_mismatches": "select o_orderkey, declared, actual from (select o_orderkey, o_orderkey % 8 as declared, coalesce(n, 0) as actual from orders left join (select l_orderkey, count(*) as n from lineitem group by 1) on o_orderkey = l_orderkey) where declared <> actual",
    "inconsistent_metadata": "select s_suppkey, s_suppkey % 3 = 0 as private, case when s_suppkey % 4 = 0 then 'private' else 'public' end as visibility from supplier where (s_suppkey % 3 = 0) <> (s_suppkey % 4 = 0)",
    "commit_facts": """select o_orderkey as artifact_id, '$git/commit#/' || unnest(['sha', 'tree_sha', 'parent_shas', 'parent_count', 'author_date', 'committer_date']) as locator,
      unnest([sha256(o_orderkey::varchar), sha256(o_orderpriority), '["' || (o_orderkey - 1) || '"]', '1', strftime(o_orderdate, '%Y-%m-%d'), case when o_orderkey % 4 <> 0 then strftime(o_orderdate, '%Y-%m-%d') else 'null' end]) as value from orders""",
    "event_facts": """select user_id as artifact_id, '$github/events#/events/' || place || '/' || k as locator, v as value from (select user_id, place, unnest(['id', 'node_id', 'event', 'actor', 'commit_id', 'created_at']) as k,
        unnest([event_id::varchar, 'n' || event_id, event_type, user_id::varchar, case when event_id % 3 = 0 then event_id::varchar end, strftime(ts, '%Y-%m-%dT%H:%M:%SZ')]) as v
        from (select *, row_number() over (partition by user_id order by date_trunc('second', ts), event_id) - 1 as place from events)) where v is not null""",
    "repository_metadata_facts": """select s_suppkey as artifact_id, '$github/repository#/' || unnest(['id', 'owner', 'name', 'default_branch', 'archived', 'fork', 'visibility']) as locator,
      unnest([s_suppkey::varchar, lower(s_name), s_name, case when s_nationkey <> 3 then 'main' else 'null' end, (s_suppkey % 2 = 0)::varchar, 'false', 'public']) as value from supplier""",
    "workflow_step_facts": """select l_orderkey % 100 as artifact_id, k as field, v as value, count(*) as n from (select l_orderkey, unnest(['number', 'name', 'status', 'conclusion', 'started_at', 'completed_at']) as k,
      unnest([l_linenumber::varchar, l_returnflag, 'completed', case when l_linestatus = 'O' then 'success' else 'null' end, strftime(l_shipdate, '%Y-%m-%d'), 'null']) as v from lineitem) group by all""",
    "tree_facts": f"""with t as (select *, string_split(path, '/')[1] as tree_sha from {TC})
      select tree_sha, locator, 'sha256:' || sha256(v) as value_hash from (
        select tree_sha, '$git/tree#/entries/' || replace(replace(path, '~', '~0'), '/', '~1') || '/' || unnest(['entry_type', 'mode', 'object_sha', 'size']) as locator, unnest([entry_type, mode, object_sha, size::varchar]) as v from t
        union all select tree_sha, '$git/tree#/' || unnest(['entry_count', 'entry_paths']), unnest([count(*)::varchar, to_json(list(path order by path))::varchar]) from t group by tree_sha)""",
    "incomplete_collections": "select l_orderkey, o_orderkey % 5 as jobs_total, count(*) as n_jobs from lineitem join orders on l_orderkey = o_orderkey group by all having count(*) <> o_orderkey % 5",
    "job_logs": """select o_orderstatus as conclusion, case when o_orderkey % 3 = 0 then null when o_orderkey % 2 = 0 then 'available' else 'expired' end as availability, case when o_orderkey % 3 = 0 then null when o_orderkey % 2 = 0 then 302 else 410 end as http_status,
      case when o_orderkey % 3 = 0 then null else o_orderkey % 2 = 0 end as redirected, count(*) as n from orders group by all""",
    "registry_drift": """select s_suppkey, case when s_suppkey % 6 = 0 then s_name || '!' else s_name end as s_name, case when s_suppkey % 10 <> 0 then s_nationkey end as s_nationkey from supplier
      where s_suppkey % 6 = 0 or (s_suppkey % 10 = 0 and s_nationkey is not null)""",
    "resolution_conflicts": "select c_custkey as hit_id, c_nationkey as source_id, 'unresolved' as state from customer where c_custkey % 8 = 0",
    "authorised_captures": """with latest as (select o_custkey, max(struct_pack(d := o_orderdate, k := o_orderkey)).k as loc from orders group by 1)
      select o_orderkey as capture_id, o.o_custkey as source_id, loc as repository_locator_id from orders o join latest l on o.o_custkey = l.o_custkey where loc % 10 < 7 and loc % 9 <> 0""",
    "backdated_assignments": "select event_id from events where event_id % 4 = 0 and date_trunc('day', ts) <> ts",
    "incomplete_runs": "select o_orderkey as run_id from orders where o_orderkey % 11 = 0 or o_orderstatus = 'P' or o_orderkey % 7 = 0",
    "out_of_order": "select l_returnflag, count(*) as n from lineitem join orders on l_orderkey = o_orderkey where l_shipdate < o_orderdate group by 1",
    "scope_mismatches": f"""select * from (select 'both' as side, 'not captured' as fault, count(*) as n from (select path from {TP} except select path from {TC})
      union all select 'both', 'not required', count(*) from (select path from {TC} except select path from {TP})) where n > 0""",
    "multiple_successors": "select user_id as superseded, count(*) as n from events where event_type <> 'view' group by 1 having count(*) > 1",
    "pattern_faults": """select event_type, what, count(*) as n_values, sum(n)::bigint as n_occurrences from (select event_type, 'source_id' as what, user_id::varchar as v, count(*) as n from events group by all
      union all select event_type, 'source_revision_id', date_trunc('day', ts)::varchar, count(*) from events group by all) where n > 1 group by all""",
    "matching_facts": """select c_custkey as selector_id, coalesce(count(*) filter (case when c_custkey % 2 = 0 then json_extract_string(props, '$.k') = (c_custkey % 10)::varchar else contains(json_extract_string(props, '$.k'), (c_custkey % 10)::varchar) end), 0) as n_matches
      from customer left join events on user_id = c_custkey group by c_custkey""",
    "comparison_pair_faults": """with p as (select o_orderkey as pair_id, lag(o_custkey) over w % 3 as ps, o_custkey % 3 as cs, lag(o_orderdate) over w as po, o_orderdate as co, lag(o_orderkey) over w as pc, case when o_orderkey % 8 = 0 then 0 else o_orderkey end as cc
        from orders window w as (partition by o_orderkey % 50 order by o_orderkey))
      select pair_id, 'another source' as fault from p where pc is not null and ps <> cs union all select pair_id, 'revision newer than the current one' from p where po > co union all select pair_id, 'capture newer than the current one' from p where pc > cc""",
    "comparison_run_faults": """with runs as (select s_suppkey as run_id, s_suppkey % 11 = 0 as other, s_suppkey % 7 = 0 as open, s_suppkey % 5 = 0 as bare, s_suppkey % 2 as code, s_suppkey % 3 = 0 as nopolicy from supplier where s_suppkey % 13 <> 0),
      p as (select s_suppkey as pair_id, a.run_id as pr, a.other as po, a.open as pf, a.bare as pb, b.run_id as cr, b.other as co, b.open as cf, b.bare as cb, a.code <> b.code as c, a.nopolicy <> b.nopolicy as n
        from supplier left join runs a on a.run_id = s_suppkey left join runs b on b.run_id = s_suppkey + 1 + s_suppkey % 2)
      select pair_id, fault from (select pair_id, unnest(['previous: unknown run', 'previous: another type', 'previous: unfinished', 'previous: no digest', 'current: unknown run', 'current: another type', 'current: unfinished', 'current: no digest', 'unlike code_version', 'unlike policy_version']) as fault,
        unnest([pr is null, po, pf, pb, cr is null, co, cf, cb, c, n]) as hit from p) where hit""",
    "generation_faults": "select l_orderkey as interval_id, (l_partkey % 4)::varchar as policy_version, count(*) as n_summaries from lineitem group by all having count(*) <> 1",
    "tampered_runs": """select distinct source as run_id from documents where (source = 'src3' and doc_id % 97 = 0) or (source = 'src5' and doc_id % 50 = 5 and text is not null)""",
}

ORACLES["readiness_counts"] = f"select count(*) filter (outcome = 'ready') as ready, count(*) filter (outcome = 'blocked') as blocked, count(*) filter (outcome = 'deferred') as deferred from ({ORACLES['readiness_outcome']})"
