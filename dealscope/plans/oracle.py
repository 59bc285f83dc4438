"""The catalogue's queries as plain SQL for a second engine.

Written directly from the meaning of each operator, in the joins' natural order and with
windows over whole labels, so that it shares no shortcut with the Spark plans.
"""

from __future__ import annotations

from dealscope.operators.preprocess import CATEGORIES, ONE_IF_MISSING, SCALED, VECTOR_ORDER, ZERO_IF_MISSING
from dealscope.schemas import (BASE_COLUMNS, ECONOMIC_COLUMNS, FEATURE_COLUMNS, LABEL, NUMERIC_GAP_COLUMNS,
                               SOURCE_COLUMNS, degree_columns)
from dealscope.sources.sample import sample_ctes

DOUBLES = ("average_funded", "average_participants")

CHAIN = """
company as (
  select id as company_id, category_code, founded_at, closed_at, country_code, state_code, city, region
  from cb_objects where entity_type = 'Company'),
round_stats as (
  select object_id as round_company_id, avg(raised_amount_usd) as average_funded, count(*) as total_rounds,
         avg(participants) as average_participants
  from cb_funding_rounds group by object_id),
product_counts as (
  select parent_id, count(*) as products_number from cb_objects
  where entity_type = 'Product' and parent_id is not null group by parent_id),
office_counts as (select object_id as office_company_id, count(*) as offices from cb_offices group by object_id),
acquirer_counts as (
  select acquiring_object_id, count(*) as acquired_companies from cb_acquisitions group by acquiring_object_id),
base as (
  select company_id, category_code, founded_at, closed_at, country_code, state_code, city, region,
         average_funded, total_rounds, average_participants, public_at, acquired_at, products_number, offices,
         acquired_companies
  from round_stats
  left join company on company_id = round_company_id
  left join cb_acquisitions as bought on bought.acquired_object_id = company_id
  left join cb_ipos as listed on listed.object_id = company_id
  left join product_counts on parent_id = company_id
  left join office_counts on office_company_id = company_id
  left join acquirer_counts as buyers on buyers.acquiring_object_id = company_id),
held as (
  select person_object_id, relationship_object_id as company_id,
         case when lower(degree_type) in ('mba', 'phd', 'ms') then lower(degree_type) else 'other' end as degree_type
  from cb_relationships join cb_degrees on person_object_id = object_id),
degree_counts as (select count(*) as count, company_id, degree_type from held group by company_id, degree_type),
degree_pivot as (
  select company_id,
         cast(sum(count) filter (where degree_type = 'mba') as bigint) as mba_degree,
         cast(sum(count) filter (where degree_type = 'phd') as bigint) as phd_degree,
         cast(sum(count) filter (where degree_type = 'ms') as bigint) as ms_degree,
         cast(sum(count) filter (where degree_type = 'other') as bigint) as other_degree
  from degree_counts group by company_id),
degreed as (
  select base.*, mba_degree, phd_degree, ms_degree, other_degree
  from base left join degree_pivot on base.company_id is not distinct from degree_pivot.company_id),
repaired as (
  select * replace (case when public_at > acquired_at then null else public_at end as public_at,
                    case when closed_at > acquired_at then null else closed_at end as closed_at)
  from degreed),
aged as (
  select *, public_at is not null as ipo, acquired_at is not null as is_acquired, closed_at is not null as is_closed,
         cast(date_diff('day', founded_at, coalesce(acquired_at, date '2014-01-01')) as int) as age
  from repaired),
features as (
  select company_id, category_code,
         case when country_code in ('USA', 'NZL') then country_code else 'other' end as country_code,
         case when state_code = 'CA' then 'California' else 'other' end as state_code,
         average_funded, total_rounds, average_participants, products_number, offices, acquired_companies,
         mba_degree, phd_degree, ms_degree, other_degree, ipo, is_acquired, is_closed, age
  from aged where age is null or age >= 0),
known_age as (select * from features where age >= 0)"""


def rnd(value: str, digits: int = 6) -> str:
    """Rounded, with no negative zero."""
    return f"(round({value}, {digits}) + 0.0)"


def pick(columns, digits: int = 6, doubles=DOUBLES) -> str:
    return ", ".join(f"{rnd(c, digits)} as {c}" if c in doubles else c for c in columns)


def sql(select: str, *more_ctes: str) -> str:
    return ",\n".join([sample_ctes(), CHAIN.strip(), *[c.strip() for c in more_ctes]]) + "\n" + select.strip()


def _joined(side: str, on: str, extra: str) -> str:
    return sql(f"select company.*, {extra} from company left join {side} on {on}")


def _key_text(columns=FEATURE_COLUMNS) -> str:
    parts = [f"coalesce(cast({f'cast({c} as decimal(38,6))' if c in DOUBLES else c} as varchar), '~')"
             for c in columns]
    return " || '|' || ".join(parts)


HASHED = f"hashed as (select *, md5('0|' || {_key_text()}) as h from features)"

RANKED = """
ranked as (select *, row_number() over (partition by is_acquired order by h) as place,
                  count(*) over (partition by is_acquired) as label_rows from hashed)"""

QUOTA = """
sizes as (select is_acquired, count(*) as n, sum(count(*)) over () as total from features group by is_acquired),
shares as (select *, total - ceil(cast(0.2 as double) * total) as train_total,
                  (total - ceil(cast(0.2 as double) * total)) * n / total as exact from sizes),
floors as (select *, row_number() over (order by exact - floor(exact) desc, is_acquired) as turn,
                  train_total - sum(floor(exact)) over () as spare from shares),
quota as (select is_acquired, n - floor(exact) - case when turn <= spare then 1 else 0 end as test_rows from floors)"""


def robust_line_ctes(name: str, points: str) -> str:
    """CTEs ending in ``{name}``, one row of slope, intercept and inliers, for a query of x and y."""
    return f"""
{name}_p as ({points}),
{name}_s as (
  select row_number() over (order by bucket) as i, x, y from (
    select left(h, 2) as bucket, arg_min(x, h) as x, arg_min(y, h) as y from (
      select x, y, md5(cast(cast(x as decimal(38,6)) as varchar) || '|' || cast(cast(y as decimal(38,6)) as varchar)) as h
      from {name}_p) group by 1)),
{name}_c as (
  select *, row_number() over (order by stride, i) as id from (
    select b.i - a.i as stride, a.i, (b.y - a.y) / (b.x - a.x) as m, a.y - (b.y - a.y) / (b.x - a.x) * a.x as b
    from {name}_s as a join {name}_s as b on b.i > a.i and b.x <> a.x order by 1, 2 limit 100)),
{name}_m as (select median(y) as middle from {name}_p),
{name}_t as (select median(abs(y - middle)) as t from {name}_p, {name}_m),
{name}_n as (
  select id, m, b, count(*) as n, sum((y - (m * x + b)) * (y - (m * x + b))) as error, var_pop(y) as spread
  from {name}_p, {name}_c, {name}_t where abs(y - (m * x + b)) <= t group by id, m, b),
{name}_b as (select m, b from {name}_n
  order by n desc, case when spread > 0 then 1 - error / (spread * n) else 0 end desc, id limit 1),
{name} as (
  select regr_slope(y, x) as slope, regr_intercept(y, x) as intercept, count(*) as inliers
  from {name}_p cross join {name}_t left join {name}_b on true where m is null or abs(y - (m * x + b)) <= t)"""


FUND_LINE = robust_line_ctes("fund_line", """
  select cast(total_rounds as double) as x, avg(average_funded) as y from features
  group by total_rounds having avg(average_funded) is not null""")

PARTICIPANT_LINE = robust_line_ctes("participant_line", """
  select average_funded as x, average_participants as y from features
  where average_participants <> 0 and average_funded is not null""")

REPAIRED_PARTICIPANTS = (
    "case when average_participants = 0 and average_funded is not null "
    "then participant_line.slope * average_funded + participant_line.intercept else average_participants end")

MODES = "modes as (select " + ", ".join(
    f"(select {c} from features where {c} is not null group by {c} order by count(*) desc, {c} limit 1) as {c}_mode"
    for c in CATEGORIES) + ")"

CATEGORIZED = "categorized as (select features.*, " + ", ".join(
    f"coalesce({c}, {c}_mode) as {c}_filled" for c in CATEGORIES) + " from features, modes)"


def _hot(column: str, separator: str, digits: str) -> str:
    """One-hot text of a filled category: sorted classes, the second alone where there are two."""
    classes = f"(select distinct {column}_filled as class from categorized)"
    kept = (f"(select class from {classes} where (select count(*) from {classes}) <> 2 "
            f"or class <> (select min(class) from {classes}))")
    return (f"(select string_agg(case when class = {column}_filled then '1{digits}' else '0{digits}' end, "
            f"'{separator}' order by class) from {kept})")


NUMBERED = f"""
numbered as (
  select categorized.*, {", ".join(f"coalesce({c}, 0) as {c}_n" for c in ZERO_IF_MISSING)},
         {", ".join(f"coalesce({c}, 1) as {c}_n" for c in ONE_IF_MISSING)},
         coalesce(age, avg(age) over ()) as age_n,
         coalesce(average_funded, fund_line.slope * total_rounds + fund_line.intercept) as average_funded_n,
         {REPAIRED_PARTICIPANTS} as participants_raw
  from categorized, fund_line, participant_line),
filled as (select *, coalesce(participants_raw, avg(participants_raw) over ()) as average_participants_n from numbered),
scaled as (
  select *, {", ".join(f"({c}_n - avg({c}_n) over ()) / case when stddev_pop({c}_n) over () = 0 then 1 else stddev_pop({c}_n) over () end as {c}_z" for c in SCALED)}
  from filled)"""


def _slot(name: str) -> str:
    hot = {short: column for column, short in CATEGORIES.items()}
    if name in hot:
        return _hot(hot[name], " ", ".000")
    value = {"ipo": "cast(ipo as int)", "is_closed": "cast(is_closed as int)", "total_rounds": "total_rounds"}.get(
        name, f"{name}_z" if name in SCALED else f"{name}_n")
    return f"cast(cast({value} as decimal(18,3)) as varchar)"


def _limits() -> str:
    cases = " and ".join(f"{c} is not null" for c in (*ECONOMIC_COLUMNS, LABEL))
    low_high = ", ".join(f"min({c}) over () as low_{c}, max({c}) over () as high_{c}" for c in ECONOMIC_COLUMNS)
    bins = ", ".join(
        f"case when high_{c} > low_{c} then least(cast(floor((cast({c} as double) - low_{c}) / "
        f"(cast(high_{c} as double) - low_{c}) * 10) as bigint), 9) else 0 end as {c}" for c in ECONOMIC_COLUMNS)
    return f"""
cases as (select *, {low_high} from known_age where {cases}),
binned as (select {LABEL}, {bins} from cases)"""


def _scan() -> str:
    return " union all ".join(
        f"select '{name}' as table_name, count(*) as row_count, count({columns[0]}) as known_keys, "
        f"count({columns[-1]}) as known_last from cb_{name}" for name, columns in SOURCE_COLUMNS.items())


def _completeness() -> str:
    return " union all ".join(
        f"select '{c}' as column_name, {rnd(f'avg(cast({c} is not null as int))')} as completeness from known_age"
        for c in FEATURE_COLUMNS)


def _correlations() -> str:
    return " union all ".join(
        f"select '{a}' as column_a, '{b}' as column_b, {rnd(f'corr({a}, {b})', 8)} as r from known_age"
        for a in NUMERIC_GAP_COLUMNS for b in NUMERIC_GAP_COLUMNS)


def _histograms() -> str:
    return " union all ".join(
        f"select {LABEL}, '{c}' as column_name, {c} as bin, count(*) as companies from binned group by {LABEL}, {c}"
        for c in ECONOMIC_COLUMNS)


def _pair_histograms() -> str:
    return " union all ".join(
        f"select {LABEL}, '{a}' as column_a, '{b}' as column_b, {a} as bin_a, {b} as bin_b, count(*) as companies "
        f"from binned group by {LABEL}, {a}, {b}"
        for i, a in enumerate(ECONOMIC_COLUMNS) for b in ECONOMIC_COLUMNS[i + 1:])


def age_rate(table: str) -> str:
    return f"""
select age_bucket, {rnd("rate")} as rate, companies,
       {rnd("rate - 1.96 * sqrt(rate * (1 - rate) / companies)")} as low,
       {rnd("rate + 1.96 * sqrt(rate * (1 - rate) / companies)")} as high
from (select cast(floor(age / 1825.0) as bigint) as age_bucket, avg(cast(is_acquired as int)) as rate,
             count(*) as companies from {table} where age is not null group by 1)"""

def _fold_statistics() -> str:
    """For each fold, all preprocessing over the rows of the other folds."""
    folds = []
    for fold in range(3):
        rows = f"features as (select * from dealt where fold <> {fold})"
        numbers = " union all ".join(f"select '{c}' as name, null as fill, avg({c}_n) as mean, "
                                     f"case when stddev_pop({c}_n) = 0 then 1 else stddev_pop({c}_n) end as scale from filled" for c in SCALED)
        fills = " union all ".join(f"select '{c}', {c}_mode, null, null from modes" for c in CATEGORIES)
        ctes = ", ".join(text.strip() for text in (rows, MODES, CATEGORIZED, FUND_LINE, PARTICIPANT_LINE, NUMBERED))
        folds.append(f"select cast({fold} as int) as fold, * from (with {ctes} {numbers} union all {fills})")
    return f"select fold, name, fill, {rnd('mean', 4)} as mean, {rnd('scale', 4)} as scale from (" + " union all ".join(folds) + ")"


FOLD = ("cast(case when place <= label_rows // 3 + (label_rows % 3 > 0)::int then 0 "
        "when place <= 2 * (label_rows // 3) + least(label_rows % 3, 2) then 1 else 2 end as int) as fold")

BY_COMPANY = f"""
owned as (select * from features where company_id is not null),
signed as (select company_id, md5('0|' || cast(company_id as varchar)) as h, count(*) filter (where is_acquired) as yes,
 count(*) filter (where is_acquired is distinct from true) as no from owned group by company_id),
turns as (select *, row_number() over (order by yes + no desc, yes desc) as turn from (
 select yes, no, count(*) as companies from signed group by yes, no)),
dealt as (
 select 0::bigint as turn, 0::bigint as yes, 0::bigint as no, 0::bigint as take, 0::double as lack_yes, 0::double as lack_no
 union all
 select turn, yes, no, take, lack_yes - take * yes, lack_no - take * no from (
  select *, least(companies, greatest(0, cast(floor((lack_yes * yes + lack_no * no) / (yes * yes + no * no) + 0.5::double) as bigint))) as take from (
   select turns.turn, turns.yes, turns.no, companies, lack_yes + 0.2::double * turns.yes * companies as lack_yes,
    lack_no + 0.2::double * turns.no * companies as lack_no
   from dealt join turns on turns.turn = dealt.turn + 1))),
sides as (select company_id, row_number() over (partition by signed.yes, signed.no order by h, company_id) <= take as is_test
 from signed join dealt on signed.yes = dealt.yes and signed.no = dealt.no and dealt.turn > 0),
lone as (select *, md5('0|' || {_key_text()}) as h from features where company_id is null),
lone_ranked as (select *, row_number() over (partition by is_acquired order by h) as place from lone),
lone_sizes as (select is_acquired, count(*) as n, sum(count(*)) over () as total from lone group by is_acquired),
lone_shares as (select *, total - ceil(0.2::double * total) as train_total, (total - ceil(0.2::double * total)) * n / total as exact from lone_sizes),
lone_floors as (select *, row_number() over (order by exact - floor(exact) desc, is_acquired) as turn,
 train_total - sum(floor(exact)) over () as spare from lone_shares),
lone_quota as (select is_acquired, n - floor(exact) - case when turn <= spare then 1 else 0 end as test_rows from lone_floors)"""

RESAMPLED = f"""
turns as (select age_bucket, cast(is_acquired as int) as positive, turn, md5('0|' || cast(turn as varchar) || '|' || cast(copy as varchar) || '|' || identity) as digest
 from (select *, row_number() over (partition by identity) - 1 as copy from (
  select cast(floor(age / 1825.0) as bigint) as age_bucket, is_acquired, {_key_text()} as identity from features where age is not null)),
      (select unnest(range(25)) as turn)),
draws as (select age_bucket, positive, 8 * turn + draw as resample, cast('0x' || substr(digest, 4 * draw + 1, 4) as int) as uniform
 from turns, (select unnest(range(8)) as draw) as d(draw)),
times as (select *, case when uniform < 24109 then 0 when uniform < 48218 then 1 when uniform < 60273 then 2 when uniform < 64291 then 3
 when uniform < 65296 then 4 when uniform < 65497 then 5 when uniform < 65530 then 6 when uniform < 65535 then 7 else 8 end as times from draws),
shares as (select age_bucket, sum(times * positive) / nullif(sum(times), 0) as share from times group by age_bucket, resample),
ordered as (select age_bucket, list_sort(list(share) filter (where share is not null)) as shares from shares group by age_bucket)"""

PAV = """
rule as (select company_id, is_acquired, total_rounds + case when ipo then 2.0::double else 0.0::double end
 - coalesce(age, 0) / 3650.0::double as margin from features),
ends as (select min(margin) as low, (max(margin) - min(margin)) / 40 as width from rule),
placed as (select *, least(cast(floor((margin - low) / width) as bigint), 39) as cell from rule, ends),
cells as (select cell, count(*) as n, count(*) filter (where is_acquired) as k from placed group by cell),
runs as (select a.cell as first, b.cell as last, sum(c.k) / sum(c.n) as share
 from cells a join cells b on a.cell <= b.cell join cells c on c.cell between a.cell and b.cell group by a.cell, b.cell),
below as (select cell, first, min(share) as share from cells join runs on first <= cell and last >= cell group by cell, first),
chances as (select cell, max(share) as chance from below group by cell)"""

METRICS = f"""
select tp, fp, fn, {rnd("tp / (tp + fp)")} as precision, {rnd("tp / (tp + fn)")} as recall,
       {rnd("2 * tp / (2 * tp + fp + fn)")} as f1
from (select count(*) filter (where is_acquired and guess) as tp, count(*) filter (where not is_acquired and guess) as fp,
             count(*) filter (where is_acquired and not guess) as fn
      from (select is_acquired, ipo or total_rounds >= 3 as guess from features))"""


def oracle() -> dict[str, str]:
    wide = ", ".join(degree_columns())
    line = (FUND_LINE, PARTICIPANT_LINE)
    split_parts = sql(
        f"select {pick(FEATURE_COLUMNS)}, case when place <= test_rows then 'test' else 'train' end as split "
        "from ranked join quota using (is_acquired)", HASHED, RANKED, QUOTA)
    all_features = sql(f"select {pick(FEATURE_COLUMNS)} from features")
    return {
        "scan_sources": sql(_scan()),
        "csv_roundtrip": all_features,
        "split_stratified": split_parts,
        "csv_split": split_parts,
        "companies": sql("select * from company"),
        "round_stats": sql(f"select {pick(('round_company_id', 'total_rounds', *DOUBLES))} from round_stats"),
        "product_counts": sql("select * from product_counts"),
        "office_counts": sql("select * from office_counts"),
        "acquirer_counts": sql("select * from acquirer_counts"),
        "rounds_right_join": sql(
            f"select company.*, {pick(('round_company_id', 'total_rounds', *DOUBLES))} "
            "from company right join round_stats on company_id = round_company_id"),
        "join_acquisitions": _joined("cb_acquisitions", "acquired_object_id = company_id", "acquired_at"),
        "join_ipos": _joined("cb_ipos", "object_id = company_id", "public_at"),
        "join_products": _joined("product_counts", "parent_id = company_id", "products_number"),
        "join_offices": _joined("office_counts", "office_company_id = company_id", "offices"),
        "join_acquirers": _joined("acquirer_counts", "acquiring_object_id = company_id", "acquired_companies"),
        "company_base": sql(f"select {pick(BASE_COLUMNS)} from base"),
        "degree_counts": sql("select * from degree_counts"),
        "degree_people": sql("select count(distinct person_object_id) as count, company_id, degree_type "
                             "from held group by company_id, degree_type"),
        "degree_pivot": sql("select * from degree_pivot"),
        "extract_degrees": sql(f"select {pick(BASE_COLUMNS)}, {wide} from degreed"),
        "fix_post_acquisition": sql("select company_id, acquired_at, public_at, closed_at from repaired"),
        "binary_flags": sql("select company_id, ipo, is_acquired, is_closed from aged"),
        "company_age": sql(
            "select * from (select company_id, founded_at, acquired_at, cast(date_diff('day', founded_at, "
            "coalesce(acquired_at, date '2014-01-01')) as int) as age from base) where age is null or age >= 0"),
        "geo_buckets": sql(
            "select country_code, state_code, count(*) as companies from (select case when country_code in ('USA', 'NZL') "
            "then country_code else 'other' end as country_code, case when state_code = 'CA' then 'California' else "
            "'other' end as state_code from base) group by 1, 2"),
        "company_features": all_features,
        "train_matrix": sql(f"select {pick(c for c in FEATURE_COLUMNS if c != 'company_id')} from features"),
        "eda_profile": sql(
            f"select count(*) as total_companies, cast({len(FEATURE_COLUMNS)} as int) as total_features, "
            f"{rnd('avg(cast(is_acquired as int))')} as acquired_share from features"),
        "eda_age_filter": sql("select company_id, age, is_acquired from known_age"),
        "eda_age_rate": sql(age_rate("features")),
        "eda_known_age_rate": sql(age_rate("known_age")),
        "eda_known_age_count": sql("select cast(floor(age / 1825.0) as bigint) as age_bucket, count(*) as companies "
                                   "from known_age group by 1"),
        "eda_age_count": sql("select cast(floor(age / 1825.0) as bigint) as age_bucket, count(*) as companies "
                             "from features where age is not null group by 1"),
        "eda_category_rate": sql(
            f"select category_code, {rnd('avg(cast(is_acquired as int))')} as rate, count(*) as companies "
            "from known_age where category_code is not null group by category_code"),
        "eda_corr": sql(_correlations()),
        "eda_completeness": sql(_completeness()),
        "eda_complete_cases": sql(f"select {pick((*ECONOMIC_COLUMNS, LABEL))} from known_age where "
                                  + " and ".join(f"{c} is not null" for c in ECONOMIC_COLUMNS)),
        "eda_histograms": sql(_histograms(), _limits()),
        "eda_pair_histograms": sql(_pair_histograms(), _limits()),
        "impute_constant": sql("select company_id, " + ", ".join(
            [f"coalesce({c}, 0) as {c}" for c in ZERO_IF_MISSING]
            + [f"coalesce({c}, 1) as {c}" for c in ONE_IF_MISSING]) + " from features"),
        "impute_mean": sql(f"select company_id, cast(age as double) as age, "
                           f"{rnd('coalesce(age, avg(age) over ())')} as age_filled from features"),
        "impute_mode": sql("select company_id, " + ", ".join(f"{c}, {c}_filled" for c in CATEGORIES)
                           + " from categorized", MODES, CATEGORIZED),
        "one_hot": sql("select company_id, " + ", ".join(
            f"{_hot(c, ',', '')} as {short}_hot" for c, short in CATEGORIES.items()) + " from categorized",
            MODES, CATEGORIZED),
        "funds_by_rounds": sql(
            f"select total_rounds, {rnd('avg(average_funded)')} as average_funded from features "
            "group by total_rounds having avg(average_funded) is not null"),
        "robust_line": sql(
            f"select inliers, {rnd('intercept', 4)} as at_zero, {rnd('slope * 1e6 + intercept', 4)} as at_million, "
            "(select count(*) from features) as rows_read from participant_line", PARTICIPANT_LINE),
        "impute_funds": sql(
            f"select company_id, total_rounds, {rnd('average_funded')} as average_funded, "
            f"coalesce({rnd('average_funded')}, {rnd('slope * total_rounds + intercept', 4)}) as funded_filled "
            "from features, fund_line", FUND_LINE),
        "impute_participants": sql(
            f"select company_id, {pick(DOUBLES)}, case when average_participants = 0 and average_funded is not null then "
            f"{rnd(REPAIRED_PARTICIPANTS, 4)} else {rnd('average_participants')} end as participants_filled "
            "from features, participant_line", PARTICIPANT_LINE),
        "standardize": sql("select company_id, " + ", ".join(f"{rnd(f'{c}_z', 4)} as {c}" for c in SCALED)
                           + " from scaled", MODES, CATEGORIZED, *line, NUMBERED),
        "feature_vector": sql(
            "select company_id, cast(len(string_split(slots, ' ')) as bigint) as width, slots from (select company_id, "
            + " || ' ' || ".join(_slot(n) for n in VECTOR_ORDER) + " as slots from scaled)",
            MODES, CATEGORIZED, *line, NUMBERED),
        "stratified_folds": sql(
            f"select {pick(FEATURE_COLUMNS)}, {FOLD} from ranked", HASHED, RANKED),
        "fold_statistics": sql(_fold_statistics(), HASHED, RANKED, f"dealt as (select *, {FOLD} from ranked)"),
        "class_weights": sql(
            f"select is_acquired, count(*) as rows, {rnd('sum(count(*)) over () / (2.0 * count(*))')} as weight "
            "from features group by is_acquired"),
        "classification_metrics": sql(METRICS),
        "split_by_company": sql(
            f"select {pick(FEATURE_COLUMNS)}, case when is_test then 'test' else 'train' end as split from owned join sides using (company_id) "
            f"union all select {pick(FEATURE_COLUMNS)}, case when place <= test_rows then 'test' else 'train' end as split "
            "from lone_ranked join lone_quota using (is_acquired)", BY_COMPANY).replace("with ", "with recursive ", 1),
        "eda_age_rate_resampled": sql(
            f"select age_bucket, {rnd('rate')} as rate, companies, {rnd('shares[cast(ceil(len(shares) * 0.025::double) as int)]')} as low, "
            f"{rnd('shares[cast(ceil(len(shares) * 0.975::double) as int)]')} as high from ordered join ("
            "select cast(floor(age / 1825.0) as bigint) as age_bucket, avg(cast(is_acquired as int)) as rate, count(*) as companies "
            "from features where age is not null group by 1) using (age_bucket)", RESAMPLED),
        "calibrated_chance": sql(
            f"select company_id, {rnd('100 * max(chance)', 2)} as chance_percent from placed join chances using (cell) "
            "where company_id is not null group by company_id", PAV),
    }
