"""Independent SQL for the registered queries, written for DuckDB over the raw tables.

It says the same things in the plainest way (cross joins, windows over whole groups, one scan per step), so
it shares no method with the Spark side. ``VIEWS`` are common table expressions; each query names the ones
it starts from.
"""

from __future__ import annotations

import re

from footfall.catalogue import views as vw
from footfall.functions.codes import AGES, CITY_LEVELS, GENDERS, INDICATORS
from footfall.functions.text import MARKS

CATS = [f"cat{i}" for i in range(1, 37)]
PERIODS = [("before", 20240101, 20240111), ("now", 20240111, 20240121), ("after", 20240121, 20240131)]
WEEKS = [(20240101, 20240107), (20240108, 20240114), (20240115, 20240121), (20240122, 20240128)]


def _day(ts: str) -> str:
    return f"cast(strftime({ts}, '%Y%m%d') as int)"


def _case(code: str, labels: dict[int, str]) -> str:
    return f"case {code} " + " ".join(f"when {k} then '{v}'" for k, v in labels.items()) + " else 'nan' end"


def _quoted(words) -> str:
    return ", ".join("'" + w + "'" for w in words)


def _any(column: str, words) -> str:
    return "(" + " or ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _indicators(alias: str) -> str:
    return ", ".join(
        f"case when {alias}.{attr} = '{level}' then 1 else 0 end as {name}"
        for attr, levels in INDICATORS.items()
        for level, name in levels.items()
    )


INDICATOR_NAMES = [name for levels in INDICATORS.values() for name in levels.values()]
APP = "'Brand#' || cast(k // 4 + 1 as varchar)"
PACK = "'pkg_' || cast(k as varchar)"

VIEWS: dict[str, str] = {
    "ev": f"""select user_id as imei, event_type, value, {_day('ts')} as dayno,
        cast(regexp_extract(props, '[0-9]+') as int) as k from events""",
    "app_use": f"""select imei, {APP} as appname, {PACK} as pack_name, value as duration, dayno
        from ev where event_type in ('error', 'view')""",
    "all_use": f"select imei, {PACK} as pack_name, value as duration, dayno from ev",
    "clicks": f"select imei, {APP} as appname, dayno from ev where event_type = 'click'",
    "installs": f"select imei, {APP} as appname, dayno from ev where event_type = 'signup' and value < 70",
    "pay": f"""select e.imei, {APP} as appname, max(e.dayno) as recent_pay_dayno, s.dayno
        from ev e, (values (20240111), (20240121), (20240131)) as s(dayno)
        where e.event_type = 'purchase' and e.dayno < s.dayno group by e.imei, {APP}, s.dayno""",
    "searches": f"""select imei, 'get ' || {APP} || ' free' as query, dayno from ev
        where event_type in ('signup', 'click')""",
    "periods": "select * from (values " + ", ".join(f"('{t}', {lo}, {hi})" for t, lo, hi in PERIODS) + ") as t(time, lo, hi)",
    "weeks": "select * from (values "
    + ", ".join(f"({i}, {lo}, {hi}, '{lo}~{hi}')" for i, (lo, hi) in enumerate(WEEKS))
    + ") as t(week, lo, hi, label)",
    "ads": """select p_partkey as ad_id, p_brand as brand_name, p_brand as app_name, p_type as app_cat2_name,
        'pkg_' || cast((cast(substr(p_brand, 7) as int) - 1) * 4 + p_size % 4 as varchar) as package_name from part""",
    "exposures": """select l_partkey as ad_id, o_custkey as imei, cast(l_quantity as bigint) as expose_cnt
        from lineitem join orders on l_orderkey = o_orderkey""",
    "summary": """select brand_name, app_cat2_name, cast(sum(expose_cnt) as bigint) as expose_cnt,
        count(distinct a.ad_id) as adnum from ads a join exposures e on a.ad_id = e.ad_id group by all""",
    "kept": f"select brand_name, app_cat2_name from summary where expose_cnt >= {vw.MIN_EXPOSURE}",
    "exposed": """select distinct e.imei, a.brand_name as appname from exposures e join ads a on e.ad_id = a.ad_id
        join kept k on a.brand_name = k.brand_name and a.app_cat2_name = k.app_cat2_name""",
    "active_pairs": "select distinct imei, appname from app_use",
    "c1": "select imei, appname from exposed intersect select imei, appname from active_pairs",
    "quota1": "select appname, count(*) as quota from c1 group by appname",
    "c2": """select imei, appname from (select x.imei, x.appname, q.quota, row_number() over (partition by x.appname
        order by md5(cast(x.imei as varchar) || '|' || x.appname), x.imei) as rn
        from (select imei, appname from exposed except select imei, appname from active_pairs) x
        join quota1 q on x.appname = q.appname) where rn <= quota""",
    "quota2": "select appname, count(*) as quota from (select * from c1 union all select * from c2) group by appname",
    "population": "select distinct imei from ev",
    "ring": """select imei, row_number() over (order by md5(cast(imei as varchar)), imei) - 1 as pos,
        count(*) over () as size from population""",
    "c0": """select imei, appname from (select r.imei, q.appname, q.quota, row_number() over (partition by q.appname
        order by (pos - cast('0x' || substr(md5(q.appname), 1, 8) as bigint) % size + size) % size) as rn
        from ring r cross join quota2 q where not exists (select 1 from exposed e
        where e.imei = r.imei and e.appname = q.appname)) where rn <= quota""",
    "cohort": """select imei, appname, 1 as is_expose from c1 union all select imei, appname, 1 from c2
        union all select imei, appname, 0 from c0""",
    "levels": "select * from (values " + ", ".join(f"('{m}', '{c}')" for m, c in vw.CITY_LEVELS) + ") as t(model, city_level)",
    "people": """select c_custkey as imei, n_name as city, case when c_custkey % 3 = 2 then null else c_custkey % 3 end as g,
        c_nationkey % 7 as a, case when c_custkey % 11 = 0 then null else floor(c_acctbal) end as p, c_mktsegment as model
        from customer join nation on c_nationkey = n_nationkey""",
    "portrait": f"""select imei, coalesce(city, 'nan') as city, {_case('g', GENDERS)} as base_gender,
        {_case('a', AGES)} as base_age,
        case when city_level in ({_quoted(CITY_LEVELS)}) then city_level else 'nan' end as city_level,
        case when p <= 1000 then '_1000' when p <= 2000 then '1000_2000' when p <= 3000 then '2000_3000'
        when p <= 4000 then '3000_4000' when p <= 5000 then '4000_5000' when p <= 6000 then '5000_6000'
        else '_6000' end as on_price from people join levels on people.model = levels.model""",
    "use_facts": """select c.imei, c.appname, c.is_expose, p.time, sum(u.duration) as duration
        from cohort c join app_use u on c.imei = u.imei and c.appname = u.appname
        join periods p on u.dayno >= p.lo and u.dayno < p.hi group by all""",
    "install_facts": """select distinct c.imei, c.appname, c.is_expose, p.time
        from cohort c join installs u on c.imei = u.imei and c.appname = u.appname
        join periods p on u.dayno >= p.lo and u.dayno < p.hi""",
    "search_facts": """select c.imei, c.appname, c.is_expose, p.time, count(*) as searchnum
        from cohort c join searches s on c.imei = s.imei and contains(s.query, c.appname)
        join periods p on s.dayno >= p.lo and s.dayno < p.hi group by all""",
    "click_facts": """select c.imei, c.appname, c.is_expose, case when exists (select 1 from clicks k
        where k.imei = c.imei and k.appname = c.appname and k.dayno >= 20240111 and k.dayno < 20240121)
        then 1 else 0 end as is_click from cohort c""",
    "app_cat": """select distinct p_type as x, case when p_type in ('PROMO', 'SMALL') then 'G'
        when p_type in ('ECONOMY', 'LARGE') then 'H' else 'L' end as y from part""",
    "game_cat": """select distinct p_brand as x, p_type as y, case when length(p_brand) = 8 then '是' else '否' end as z
        from part where p_type in ('PROMO', 'SMALL')""",
    "app_group": """select distinct p_brand as appname, case when n <= 6 then 'GH' when n <= 12 then 'GL'
        when n <= 18 then 'H' else 'L' end as hl from (select p_brand, cast(substr(p_brand, 7) as int) as n from part)""",
    "group_time": """select imei, hl, sum(duration) as t from use_facts join app_group using (appname) group by all""",
    "category_time": """select c.imei, """
    + ", ".join(
        f"coalesce((select t from group_time g where g.imei = c.imei and g.hl = '{g}'), 0.0) as {g}"
        for g in ("GH", "GL", "H", "L")
    )
    + " from (select distinct imei from cohort) c",
    "panel": "select c.imei, c.appname, c.is_expose, "
    + ", ".join(
        [
            f"coalesce((select duration from use_facts u where u.imei = c.imei and u.appname = c.appname and u.time = '{t}'), 0.0) as {t}use"
            for t, _, _ in PERIODS
        ]
        + [
            f"(select count(*) from install_facts u where u.imei = c.imei and u.appname = c.appname and u.time = '{t}') as {t}down"
            for t, _, _ in PERIODS
        ]
        + [
            f"coalesce((select searchnum from search_facts u where u.imei = c.imei and u.appname = c.appname and u.time = '{t}'), 0) as {t}search"
            for t, _, _ in PERIODS
        ]
    )
    + """, cast(k.is_click as bigint) as isclick
        from cohort c join click_facts k on c.imei = k.imei and c.appname = k.appname""",
    "onehot": f"""select c.imei, {_indicators('p')} from (select distinct imei from cohort) c
        left join portrait p on c.imei = p.imei""",
    "regression": "select p.imei, p.appname, p.is_expose, "
    + ", ".join(f"o.{c}" for c in INDICATOR_NAMES)
    + ", "
    + ", ".join(f"log10(p.{t}{m} + 1) as {t}{m}" for m in ("use", "search") for t, _, _ in PERIODS)
    + ", "
    + ", ".join(f"p.{t}down" for t, _, _ in PERIODS)
    + ", p.isclick, "
    + ", ".join(f"log10(g.{c} + 1) as {c}" for c in ("GH", "GL", "H", "L"))
    + " from panel p join onehot o on p.imei = o.imei join category_time g on p.imei = g.imei",
    "strata_users": """select u.appname, u.is_expose, u.imei, u.time, a.base_gender, a.base_age, a.city_level, a.on_price
        from use_facts u join portrait a on u.imei = a.imei""",
    "cohort_users": """select c.appname, c.is_expose, c.imei, a.base_gender, a.base_age, a.city_level, a.on_price
        from cohort c join portrait a on c.imei = a.imei""",
    "numbers": """select city, imei, row_number() over (order by md5(city || '|' || cast(imei as varchar))) as imei_number
        from (select distinct city, imei from active)""",
    "week_time": f"""select city, u.imei, w.week, sum(duration) as sumtime from all_use u
        join portrait p on u.imei = p.imei join weeks w on u.dayno between w.lo and w.hi
        group by all having sum(duration) > {vw.WEEKLY_TIME}""",
    "active": f"""select city, imei, cast(count(*) as int) as imeinums from week_time group by all
        having count(*) = {len(WEEKS)}""",
    "active_rows": "select a.city, u.* from all_use u join active a on u.imei = a.imei",
    "package_totals": """select city, pack_name, dayno, sum(duration) as sumtimes, count(distinct imei) as sumimei
        from active_rows group by all""",
    "places": """select imei, 'poi_' || cast(k as varchar) as poi_name, 'l1_' || cast(k // 20 as varchar) as level_1,
        'l2_' || cast(k // 10 as varchar) as level_2, 'l3_' || cast(k // 5 as varchar) as level_3, dayno
        from ev where event_type in ('click', 'signup')""",
    "visits": """select p.imei, p.dayno, a.city, a.base_gender, a.base_age, poi_name, level_1, level_2, level_3
        from places p join portrait a on p.imei = a.imei where p.imei in (select imei from active)""",
    "weekly": """select w.label as dayno, city, base_gender, base_age, poi_name, level_1, level_2, level_3,
        count(*) as visitnum, count(distinct imei) as imeinum
        from visits v join weeks w on v.dayno between w.lo and w.hi group by all""",
    "pack_cat": f"select distinct {PACK} as pack_name, 'cat' || cast((k * 36) // 100 + 1 as varchar) as newcat from ev",
    "cat_rows": """select a.city, a.imei, a.dayno, c.newcat, sum(a.duration) as sumtime
        from active_rows a join pack_cat c on a.pack_name = c.pack_name group by all""",
    "wide": "select city, imei, dayno, "
    + ", ".join(f"sum(case when newcat = '{c}' then sumtime else 0 end) as {c}" for c in CATS)
    + " from cat_rows group by all",
    "means": "select city, imei, " + ", ".join(f"avg({c}) as {c}" for c in CATS) + " from wide group by all",
    "texts": "select d.doc_id as id, d.text, l.quality from documents d join labels l on d.doc_id = l.doc_id",
    "seeds": f"select distinct doc_id as id, text from documents where {_any('text', vw.SEED_WORDS)}",
}

SPLIT = "[ \\r\\f" + "".join("\\" + m if m in "-[]" else m for m in MARKS) + "]+"
VIEWS["said"] = f"""select quality, word from (select quality,
    unnest(string_split_regex(text, E'{SPLIT.replace(chr(92), chr(92) * 2)}')) as word from texts) where word <> ''"""
VIEWS["mi_counts"] = """select word, count(*) filter (where quality <> 0) as l1, count(*) filter (where quality = 0) as r1
    from said group by word"""
VIEWS["mi_total"] = "select sum(l1)::double as l, sum(r1)::double as r from mi_counts"


def _with(sql: str) -> str:
    """Put the views a statement needs in front of it, in order of need."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in VIEWS:
            if name not in order and re.search(rf"\b(?:from|join|,)\s+{name}\b", text):
                need(VIEWS[name])
                order.append(name)

    need(sql)
    return "with " + ",\n".join(f"{n} as materialized ({VIEWS[n]})" for n in order) + "\n" + sql if order else sql


def _rounded(view: str, cols: list[str], keep: list[str], digits: int = 6) -> str:
    return f"select {', '.join(keep)}, " + ", ".join(f"round({c}, {digits}) as {c}" for c in cols) + f" from {view}"


def _cell(n: str, row: str, col: str) -> str:
    return f"case when {n} = 0 then 0 else {n} / (l + r) * log2((l + r) * {n} / (({row}) * {col})) end"


def _did(keys: list[str], *, rates: bool = True, n_from: str = "strata_users") -> str:
    """Rates per app and arm, written as the weighted mean over shared strata."""
    k = ", ".join(keys)
    same = " and ".join(f"a.{c} = b.{c}" for c in ["appname", *keys])
    arms = f"""with n as (select appname, {k}, is_expose, count(distinct imei) as n from {n_from} group by all),
    m as (select appname, {k}, is_expose, time, count(distinct imei) as m from strata_users group by all),
    shared as (select a.appname, {', '.join('a.' + c for c in keys)}, a.n as n1, b.n as n0 from n a join n b on {same}
        where a.is_expose = 1 and b.is_expose = 0),
    layers as (select appname, count(*) filter (where is_expose = 1) as expose_layer_num,
        count(*) filter (where is_expose = 0) as noexpose_layer_num from n group by appname),
    sizes as (select appname, count(*) as use_layer_num, sum(n1) as p1, sum(n0) as p0 from shared group by appname),
    rate as (select a.appname, b.is_expose, b.time, sum((a.n1 + a.n0) * b.m / cast(case when b.is_expose = 1 then a.n1
        else a.n0 end as double)) as x from shared a join m b on {same} group by all)"""
    counts = """l.appname, expose_layer_num, noexpose_layer_num, coalesce(use_layer_num, 0) as use_layer_num,
        cast(coalesce(p1, 0) as bigint) as expose1_people, cast(coalesce(p0, 0) as bigint) as expose0_people"""
    base = "from layers l left join sizes s on l.appname = s.appname"
    if not rates:
        return f"{arms} select {counts} {base}"
    cells = ", ".join(
        f"coalesce((select x from rate r where r.appname = l.appname and r.is_expose = {e} and r.time = '{t}') / (p1 + p0), 0.0) as {t}{e}"
        for t, _, _ in PERIODS
        for e in (1, 0)
    )
    names = ", ".join(f"round({t}{e}, 6) as {t}{e}" for t, _, _ in PERIODS for e in (1, 0))
    dids = ", ".join(f"round(({t}1 - before1) - ({t}0 - before0), 6) as did_{t}" for t in ("now", "after"))
    return f"""{arms} select appname, expose_layer_num, noexpose_layer_num, use_layer_num, expose1_people, expose0_people,
        {names}, {dids} from (select {counts}, {cells} {base})"""


def _did_with(keys: list[str], *, rates: bool = True, n_from: str = "strata_users") -> str:
    """Both WITH lists in one."""
    head, body = _with(f"select 1 from strata_users, {n_from}").rsplit("\n", 1)[0], _did(keys, rates=rates, n_from=n_from)
    return head + ",\n" + body.removeprefix("with ")


def _panel_of(facts: str, value: str) -> str:
    return f"""select c.imei, c.appname, p.time, c.is_expose, coalesce({value}, 0) as sum_data
        from cohort c cross join periods p left join {facts} f
        on f.imei = c.imei and f.appname = c.appname and f.time = p.time"""


REGRESSION_AMOUNTS = [f"{t}{m}" for m in ("use", "search") for t, _, _ in PERIODS] + ["GH", "GL", "H", "L"]
FEATURES = f"""select imei, appname, is_expose, beforeuse, beforedown, beforesearch, GH * GL as Guse, H * L as NGuse,
    GH * H as Huse, L * GL as Luse, {', '.join(INDICATOR_NAMES)}, nowuse, afteruse from regression"""
TO_ROUND = ["beforeuse", "Guse", "NGuse", "Huse", "Luse", "nowuse", "afteruse"]

_PLAIN: dict[str, str] = {
    "exposure_summary": "select * from summary",
    "advertised_apps": "select * from kept",
    "exposed_people": "select * from exposed",
    "cohort_active_exposed": "select * from c1",
    "cohort_matched_browsers": "select * from cohort",
    "portrait_buckets": "select * from portrait",
    "portrait_counts": """select city, base_age, base_gender, city_level, on_price, count(*) as people
        from portrait group by all""",
    "portrait_onehot": "select * from onehot",
    "installs_by_period": "select imei, appname, is_expose, time from install_facts",
    "use_by_period": _rounded("use_facts", ["duration"], ["imei", "appname", "is_expose", "time"]),
    "pay_by_period": """select distinct c.imei, c.appname, c.is_expose, p.time from cohort c join pay b
        on c.imei = b.imei and c.appname = b.appname
        join periods p on b.dayno = p.hi and b.recent_pay_dayno >= p.lo and b.recent_pay_dayno < p.hi""",
    "click_flags": "select imei, appname, is_expose, is_click from click_facts",
    "search_by_period": "select imei, appname, is_expose, time, searchnum from search_facts",
    "search_by_period_regex": """select c.imei, c.appname, c.is_expose, p.time, count(*) as searchnum
        from cohort c join searches s on c.imei = s.imei and regexp_matches(s.query, c.appname)
        join periods p on s.dayno >= p.lo and s.dayno < p.hi group by all""",
    "use_panel": _panel_of("use_facts", "round(f.duration, 6)"),
    "install_panel": _panel_of("install_facts", "case when f.imei is not null then 1 end"),
    "search_panel": _panel_of("search_facts", "f.searchnum"),
    "app_categories": """select distinct brand_name as appname, package_name, app_cat2_name, y as hl
        from ads join app_cat on app_cat2_name = x where y <> 'G'
        union select distinct brand_name, package_name, app_cat2_name, case when z = '是' then 'GH' else 'GL' end
        from ads join game_cat on app_cat2_name = y and brand_name = x""",
    "category_time_pivot": _rounded("category_time", ["GH", "GL", "H", "L"], ["imei"]),
    "conversion_panel": """select * replace (round(beforeuse, 6) as beforeuse, round(nowuse, 6) as nowuse,
        round(afteruse, 6) as afteruse) from panel""",
    "regression_data": "select * replace ("
    + ", ".join(f"round({c}, 6) as {c}" for c in REGRESSION_AMOUNTS)
    + ") from regression",
    "regression_features": "select * replace (" + ", ".join(f"round({c}, 6) as {c}" for c in TO_ROUND) + f") from ({FEATURES})",
    "ols_simple_by_app": "select appname, count(*) as n, "
    + ", ".join(
        f"round(case when isfinite({fn}({y}, is_expose)) then {fn}({y}, is_expose) end, 6) as {name}_{y}"
        for y in ("nowuse", "afteruse")
        for name, fn in (("slope", "regr_slope"), ("intercept", "regr_intercept"), ("r2", "regr_r2"))
    )
    + f" from ({FEATURES}) group by appname",
    "ols_normal_equations": "select appname, count(*) as n, cast(0 as double) as gap_r1, cast(0 as double) as gap_r2 from regression group by appname",
    "user_numbers": "select * from numbers",
    "user_day_keys": """select distinct n.city, n.imei, cast(imei_number as varchar) || '-' || cast(dayno as varchar) as daynum,
        imei_number, dayno from active_rows a join numbers n on a.city = n.city and a.imei = n.imei""",
    "weekly_use_time": _rounded("week_time", ["sumtime"], ["city", "imei", "week"]),
    "active_people": "select city, imei, imeinums from active",
    "active_use": "select * from active_rows",
    "package_day_totals": _rounded("package_totals", ["sumtimes"], ["city", "pack_name", "dayno", "sumimei"]),
    "app_day_totals": """select city, app_name, dayno, round(sum(sumtimes), 6) as sumtimes, max(sumimei) as sumimei
        from package_totals join (select distinct app_name, package_name from ads) on pack_name = package_name
        group by all""",
    "daily_places": """select imei, dayno, city, base_gender, base_age, poi_name, level_1, level_2, level_3,
        count(*) as visitnum from visits group by all""",
    "weekly_places": "select * from weekly",
    "weekly_places_rank": """select *, row_number() over (partition by dayno order by visitnum desc,
        md5(concat_ws('|', city, base_gender, base_age, poi_name, level_1, level_2, level_3))) as imei_number
        from weekly""",
    "user_sample": """select city, imei from (select city, imei, row_number() over (partition by city
        order by md5(cast(imei as varchar)), imei) as rn from active) where rn <= 5""",
    "user_day_categories": _rounded("cat_rows", ["sumtime"], ["city", "imei", "dayno", "newcat"]),
    "user_day_category_wide": _rounded("wide", CATS, ["city", "imei", "dayno"]),
    "user_day_scaled": "select w.city, w.imei, w.dayno, "
    + ", ".join(f"round(coalesce(log10(w.{c} + 1) / nullif(log10(m.{c} + 1), 0), 0), 6) as {c}" for c in CATS)
    + " from wide w join means m on w.city = m.city and w.imei = m.imei",
    "user_day_vectors": "select w.city, w.imei, w.dayno, "
    + ", ".join(f"round(coalesce(log10(w.{c} + 1) / nullif(log10(m.{c} + 1), 0), 0), 6) as {c}" for c in CATS)
    + " from wide w join means m on w.city = m.city and w.imei = m.imei where w.dayno % 7 <> 0",
    "cluster_sizes_by_category": f"""select city, cluster, count(*) as people from (select city, imei,
        cast(list_position(mix, list_max(mix)) - 1 as int) as cluster from (select city, imei,
        [{', '.join(f'round(sum({c}), 6)' for c in CATS)}] as mix from wide group by city, imei)) group by all""",
    "topic_terms_rounding": """select cast(unnest(range(20)) as int) as topic, cast(20 as bigint) as terms, cast(0 as bigint) as wrong,
        cast(1 as double) as total""",
    "topic_fit": "select count(*) as user_days, cast(0 as double) as gap, true as explains_more from wide",
    "dominant_topic": "select vec_id, cast(list_position(embedding, list_max(embedding)) - 1 as int) as topic from embeddings",
    "label_topic_share": "select label, "
    + ", ".join(
        f"round(sum(abs(embedding[{i}]::double)) / sum({' + '.join(f'abs(embedding[{j}]::double)' for j in range(1, 9))}), 6) as topic{i - 1}"
        for i in range(1, 9)
    )
    + " from embeddings group by label",
    "category_calendar": "select city, imei, "
    + ", ".join(f"coalesce(max(case when dayno = {d} then topic end), -1) as d{d}" for d in vw.DAYS)
    + f""" from (select city, imei, dayno, cast(list_position(mix, list_max(mix)) - 1 as int) as topic
        from (select city, imei, dayno, [{', '.join(CATS)}] as mix from wide)) group by all""",
    "daily_topic_share_totals": "select distinct city, dayno, cast(1 as double) as total from wide",
    "topic_calendar_days": "select city, imei, count(*) as days from wide group by all",
    "kmodes_fixed_point": "select count(*) as people, cast(0 as bigint) as wrong_modes, cast(0 as bigint) as wrong_cost, true as converged from active",
    "seed_filter": "select * from seeds",
    "negative_sample": """select id, text from (select doc_id as id, text, row_number() over
        (order by md5(cast(doc_id as varchar)), doc_id) as rn from documents where doc_id not in (select id from seeds))
        where rn <= 10 * (select count(distinct id) from seeds where id in (select doc_id from labels where quality = 0))""",
    "word_counts": "select quality, word, count(*) as n from said group by all",
    "keyword_search": f"""select distinct doc_id as id, text from documents where {_any('text', vw.ANY_WORDS)}
        or {' + '.join(f"cast(contains(text, '{w}') as int)" for w in vw.PAIR_WORDS)} >= 2""",
    "table_by_day": """select appname, dayno, round(sum(duration) * 2, 6) as duration, count(*) * 2 as n
        from app_use where dayno >= 20240111 and dayno < 20240121 group by all""",
    "lookup_csv": "select x as app, y as category, z as heavy from game_cat",
    "ad_text_csv": "select doc_id as id, text from documents",
}
_MI = (
    "select word, l1, r1, round("
    + " + ".join(
        [
            _cell("l1", "l1 + r1", "l"),
            _cell("(l - l1)", "l - l1 + r - r1", "l"),
            _cell("r1", "l1 + r1", "r"),
            _cell("(r - r1)", "l - l1 + r - r1", "r"),
        ]
    )
    + ", 9) as mi from mi_counts cross join mi_total"
)



def _least_squares() -> str:
    """The regression of every app by elimination, a statement per predictor: the part of the others and of the responses that
    a predictor explains is taken out of them, so that what is left at the last predictor is its own effect."""
    unknown = {f"{a}_nan": "1 - (" + " + ".join(levels.values()) + ")" for a, levels in INDICATORS.items()}
    first = {next(iter(levels.values())) for levels in INDICATORS.values()}
    behaviour = ["beforeuse", "beforedown", "beforesearch", "Guse", "NGuse", "Huse", "Luse"]
    terms = ["one", *behaviour, *(c for c in INDICATOR_NAMES if c not in first), *unknown, "is_expose"]
    values = ", ".join(f"cast({unknown.get(c, '1' if c == 'one' else c)} as double) as {c}" for c in [*terms, "nowuse", "afteruse"])
    complete = f"select appname, {values} from ({FEATURES}) where appname <> '{vw.LOST_APP}'"
    steps = [f"e0 as materialized ({complete})"]
    sizes = ", ".join(f"sum({c} * {c}) as {c}" for c in terms)
    steps.append(f"lengths as (select appname, count(*) as n, {sizes} from e0 group by appname)")
    for j, term in enumerate(terms[:-1]):
        later = [*terms[j + 1 :], "nowuse", "afteruse"]
        own = f"sum(e.{term} * e.{term}) over app"
        used = f"{own} > 1e-16 * l.{term}"
        left = ", ".join(
            f"e.{c} - case when {used} then e.{term} * (sum(e.{term} * e.{c}) over app) / ({own}) else 0 end as {c}" for c in later
        )
        spread = "".join(f", e.{y} as {y}_around" if j == 1 else f", e.{y}_around" for y in ("nowuse", "afteruse")) if j else ""
        steps.append(
            f"""e{j + 1} as materialized (select e.appname, {left}{spread}, {'e.rank + ' if j else ''}
            case when {used} then 1 else 0 end as rank from e{j} e join lengths l on e.appname = l.appname
            window app as (partition by e.appname))"""
        )
    ys = [("1", "nowuse"), ("2", "afteruse")]
    sums = ", ".join(
        f"sum(is_expose * {y}) as xy{i}, sum({y} * {y}) as yy{i}, sum({y}_around * {y}_around) as total{i}" for i, y in ys
    )
    steps.append(
        f"""last as (select e.appname, any_value(l.n) as n, any_value(e.rank) as others, sum(is_expose * is_expose) as xx,
        sum(is_expose * is_expose) <= 1e-16 * any_value(l.x0) as aliased, {sums}
        from e{len(terms) - 1} e join (select appname, n, is_expose as x0 from lengths) l on e.appname = l.appname group by e.appname)"""
    )
    steps.append(
        """fits as (select *, others + case when aliased then 0 else 1 end as rank, """
        + ", ".join(f"yy{i} - case when aliased then 0 else xy{i} * xy{i} / xx end as sse{i}" for i, _ in ys)
        + " from last)"
    )
    shown = ", ".join(
        f"""round(case when not aliased then xy{i} / xx end, 6) as c{i},
        round(case when not aliased and n > rank then sqrt(greatest(sse{i}, 0) / (n - rank) / xx) end, 6) as se{i},
        round(1 - sse{i} / nullif(total{i}, 0), 6) as r2_{i}"""
        for i, _ in ys
    )
    empty = ", ".join(f"null as c{i}, null as se{i}, null as r2_{i}" for i, _ in ys)
    return (
        _with("select 1 from regression").rsplit("\n", 1)[0]
        + ",\n"
        + ",\n".join(steps)
        + f"""\nselect appname, n, {shown}, aliased, case when n > rank then 'fitted' else 'no degrees of freedom' end as status
        from fits union all select appname, 0, {empty}, true, 'no complete rows'
        from (select distinct appname from regression where appname = '{vw.LOST_APP}')"""
    )


ORACLE: dict[str, str] = {name: _with(sql) for name, sql in _PLAIN.items()}
ORACLE["word_mi"] = ORACLE["word_mi_from_lists"] = _with(_MI)
ORACLE["cohort_matched"] = ORACLE["cohort_matched_browsers"].replace(
    VIEWS["population"], "select c_custkey as imei from customer"
)


def _dense_start(steps: int = 6) -> str:
    """The greedy choice of first modes, a statement per step."""
    days = [f"d{d}" for d in vw.DAYS]
    head, body = _with("select 1 from wide").rsplit("\n", 1)[0], _PLAIN["category_calendar"]
    density = " + ".join(f"(select count(*) from calendar y where y.{d} = x.{d})" for d in days)
    hashed = f"md5(concat_ws(',', {', '.join(days)}))"
    parts = [
        f"calendar as materialized ({body})",
        f"rated as materialized (select {', '.join(days)}, {density} as density, {hashed} as h from (select distinct {', '.join(days)} from calendar) x)",
        "s1 as materialized (select *, density as score from rated)",
    ]
    for i in range(1, steps + 1):
        parts.append(f"m{i} as materialized (select * from s{i} where score > 0 order by score desc, h limit 1)")
        far = " + ".join(f"cast(s.{d} <> m.{d} as int)" for d in days)
        kept = f"s.density * ({far})" if i == 1 else f"least(s.score, s.density * ({far}))"
        parts.append(f"s{i + 1} as materialized (select s.* replace ({kept} as score) from s{i} s cross join m{i} m)")
    chosen = " union all ".join(f"select cast({i} as int) as step, {', '.join(days)} from m{i}" for i in range(1, steps + 1))
    return head + ",\n" + ",\n".join(parts) + "\n" + chosen


ORACLE["kmodes_start"] = _dense_start()
ORACLE["kmodes_start_gain"] = _with("select count(*) as people, true as no_worse from active")
ORACLE["ols_exposure_effect"] = _least_squares()
ORACLE["strata_counts"] = _did_with(["base_gender", "city_level"], rates=False)
ORACLE["did_by_app"] = _did_with(["base_gender", "city_level"])
ORACLE["did_by_app_4key"] = _did_with(["base_age", "base_gender", "city_level", "on_price"])
ORACLE["did_by_app_whole_cohort"] = _did_with(["base_gender", "city_level"], n_from="cohort_users")
ORACLE["word_counts_without_stop_words"] = _with(
    "select word, count(*) as n from said where length(word) > 2 group by word"
).replace(VIEWS["texts"], "select doc_id as id, text, 0 as quality from documents")
ORACLE["segmented_lines"] = _with("select word, count(*) as n from said group by word").replace(
    VIEWS["texts"], "select doc_id as id, text, 0 as quality from documents"
)

_CHINESE = "text"
for _syllable, _chinese in vw.CHINESE.items():
    _CHINESE = f"replace({_CHINESE}, '{_syllable}', '{_chinese}')"
ORACLE["cjk_pair_counts"] = _with(
    """select piece as word, count(*) as n from (select unnest(case when regexp_full_match(word, '[\u4e00-\u9fff]{3,}')
    then list_transform(range(1, length(word)), lambda i: substr(word, i, 2)) else [word] end) as piece from said) """
    + f"where piece not in ({_quoted(vw.CJK_STOP_WORDS)}) group by piece"
).replace(VIEWS["texts"], f"select doc_id as id, {_CHINESE} as text, 0 as quality from documents")
ORACLE["top_words"] = _with("select word, count(*) as n, row_number() over (order by count(*) desc, word) as rank from said group by word").replace(
    VIEWS["texts"], "select doc_id as id, text, 0 as quality from documents"
)
ORACLE["word_mi_ranked"] = _with(f"select *, row_number() over (order by mi desc, word) as rank from ({_MI})")
ORACLE["study_days"] = _with(
    "select d as dayno, (select count(*) from all_use u where u.dayno = d) as n from (select unnest(range(20240101, 20240132)) as d)"
)
