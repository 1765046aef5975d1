"""DuckDB text of the shared layers, as common table expressions."""

from __future__ import annotations

from cohortry import config as C

REF = "DATE '2001-08-01'"

_LABEL = ("CASE n_nationkey WHEN 10 THEN 'The ' || n_name WHEN 11 THEN n_name || ' Islands' "
          "ELSE n_name END")
_ISO = "'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0')"

RAW = f"""
ln AS (
  SELECT o_custkey AS ck, CAST(o_orderdate AS DATE) AS od, o_orderpriority <> '5-LOW' AS lg,
         l_returnflag AS rf, l_linestatus AS ls, l_discount AS dc, l_tax AS tx,
         l_quantity AS q
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey
  WHERE o_orderdate BETWEEN TIMESTAMP '2000-08-01 00:00:00' AND TIMESTAMP '2001-08-01 00:00:00'
),
act AS (
  SELECT ck,
    min(od) FILTER (WHERE lg) AS d_l, min(od) FILTER (WHERE rf = 'A') AS d_n,
    min(od) FILTER (WHERE dc > 0.085) AS d_s, min(od) FILTER (WHERE tx > 0.075) AS d_m,
    min(od) FILTER (WHERE q < 1.5) AS d_g, min(od) FILTER (WHERE q > 48.5) AS d_r,
    min(od) FILTER (WHERE rf = 'R') AS d_t,
    count(DISTINCT od) FILTER (WHERE lg) AS c_l,
    count(*) FILTER (WHERE dc > 0.085) AS n_s, count(DISTINCT od) FILTER (WHERE dc > 0.085) AS c_s,
    count(*) FILTER (WHERE tx > 0.075) AS n_m, count(DISTINCT od) FILTER (WHERE tx > 0.075) AS c_m,
    count(*) FILTER (WHERE q < 1.5) AS n_g, count(DISTINCT od) FILTER (WHERE q < 1.5) AS c_g,
    count(*) FILTER (WHERE q > 48.5) AS n_r, count(DISTINCT od) FILTER (WHERE q > 48.5) AS c_r,
    coalesce(sum(q) FILTER (WHERE rf = 'R'), 0) AS q_t,
    count(DISTINCT od) FILTER (WHERE rf = 'R') AS c_t,
    count(DISTINCT od) FILTER (WHERE rf = 'A') AS c_n,
    sum(q) FILTER (WHERE rf = 'A') AS q_n,
    sum(q) FILTER (WHERE rf = 'A' AND ls = 'F') AS q_f,
    sum(q) FILTER (WHERE rf = 'A' AND ls = 'O') AS q_o,
    sum(q) FILTER (WHERE rf = 'A' AND dc < 0.045) AS q_nov,
    sum(q) FILTER (WHERE rf = 'A' AND tx < 0.015) AS q_qual
  FROM ln GROUP BY ck
),
users_raw AS (
  SELECT c_custkey AS USER_ID,
    DATE '2000-08-01' + CAST(c_custkey * 37 % 366 AS INTEGER) AS ACCOUNT_CREATE_DATE,
    CASE WHEN c_mktsegment = 'BUILDING' THEN 'Member' ELSE 'Public' END AS ACCOUNT_TYPE,
    CAST(floor(c_acctbal / 80) AS BIGINT) AS USER_CURRENT_AGE,
    {_LABEL} AS COUNTRY,
    CASE c_custkey % 10 WHEN 0 THEN 'Unknown' WHEN 1 THEN 'Redacted' WHEN 2 THEN ' - '
      WHEN 3 THEN '' ELSE 'P' || CAST(c_custkey % 7 AS VARCHAR) END AS PROVINCE,
    CASE c_custkey % 11 WHEN 0 THEN 'Unknown' WHEN 1 THEN 'Redacted' WHEN 2 THEN ' - '
      WHEN 3 THEN '' ELSE 'C' || CAST(c_custkey % 13 AS VARCHAR) END AS CITY,
    r_name AS USER_WORLD_REGION,
    CASE WHEN n_nationkey = 0 AND c_custkey % 5 = 0 THEN 'Core Area'
      ELSE r_name || ' Area' END AS USER_AREA_NAME,
    d_l AS EARLIEST_LOGIN_DATE, d_n AS EARLIEST_NAME_CONTRIBUTOR_DATE,
    d_s AS EARLIEST_SOURCE_CONTRIBUTOR_DATE, d_m AS EARLIEST_MEMORY_CONTRIBUTOR_DATE,
    d_g AS EARLIEST_GET_INVOLVED_USAGE_DATE, d_r AS EARLIEST_RECORD_EDIT_DATE,
    d_t AS EARLIEST_TREE_EDIT_DATE,
    CAST(c_l AS DOUBLE) AS DAYS_LOGGING_IN,
    CAST(n_s AS DOUBLE) AS SOURCES_ADDED, CAST(c_s AS DOUBLE) AS DAYS_ADDING_SOURCES,
    CAST(n_m AS DOUBLE) AS MEMORIES_ADDED, CAST(c_m AS DOUBLE) AS DAYS_ADDING_MEMORIES,
    CAST(n_g AS DOUBLE) AS GET_INVOLVED_ITEMS_REVIEWED,
    CAST(c_g AS DOUBLE) AS DAYS_REVIEWING_GET_INVOLVED_ITEMS,
    CAST(n_r AS DOUBLE) AS RECORD_EDITS, CAST(c_r AS DOUBLE) AS DAYS_EDITING_RECORDS,
    CAST(q_t AS DOUBLE) AS TREE_EDITS, CAST(c_t AS DOUBLE) AS DAYS_EDITING_TREES,
    CASE WHEN c_n > 0 THEN CAST(c_n AS DOUBLE) END AS DAYS_ADDING_NAMES,
    CASE WHEN c_n > 0 THEN coalesce(q_n, 0.0::DOUBLE) END AS TOTAL_NAMES_ADDED,
    CASE WHEN c_n > 0 THEN coalesce(q_f, 0.0::DOUBLE) END AS DECEASED_NAMES_ADDED,
    CASE WHEN c_n > 0 THEN coalesce(q_o, 0.0::DOUBLE) END AS LIVING_NAMES_ADDED,
    CASE WHEN c_n > 0 THEN coalesce(q_nov, 0.0::DOUBLE) END AS NOVEL_NAMES_ADDED,
    CASE WHEN c_n > 0 THEN coalesce(q_qual, 0.0::DOUBLE) END AS QUALIFIED_NAMES_ADDED
  FROM customer
  JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
  LEFT JOIN act ON ck = c_custkey
)"""

XWALK = f"""
names AS (SELECT DISTINCT {_LABEL} AS country_name FROM nation),
iso AS (SELECT lower(n_name) AS k, {_ISO} AS alpha3 FROM nation WHERE n_nationkey NOT IN (22, 23)),
manual AS (
  SELECT {_LABEL} AS country_name,
    CASE WHEN n_nationkey = 1 THEN 'N01' WHEN n_nationkey IN (2, 3) THEN 'N02' END AS code
  FROM nation WHERE n_nationkey BETWEEN 1 AND 5
),
crosswalk AS (
  SELECT n.country_name,
    CASE WHEN m.country_name IS NOT NULL THEN m.code
      ELSE coalesce(e.alpha3, c.alpha3) END AS iso3_code,
    CASE WHEN m.country_name IS NOT NULL THEN 'manual' WHEN e.alpha3 IS NOT NULL THEN 'exact'
      WHEN c.alpha3 IS NOT NULL THEN 'cleaned' ELSE 'unmatched' END AS match_method
  FROM names n LEFT JOIN manual m ON m.country_name = n.country_name
  LEFT JOIN iso e ON e.k = trim(lower(n.country_name))
  LEFT JOIN iso c ON c.k = trim(replace(replace(replace(lower(n.country_name),
    'the ', ''), ' islands', ''), ' island', ''))
)"""

_DATES = ", ".join(f"{old} AS {new}" for old, new in C.DATE_COLUMNS.items())
_KEEP = ", ".join(C.ACTIVITY_COLUMNS + C.NAME_COLUMNS)
_MNAR = " AND ".join(f"{c} IS NULL" for c in C.ACTIVITY_COLUMNS)
_BAD = ", ".join(f"'{s}'" for s in C.SENTINELS)

CLEAN = f"""
users_clean AS (
  SELECT USER_ID, ACCOUNT_TYPE,
    CASE WHEN USER_CURRENT_AGE < 8 THEN NULL WHEN USER_CURRENT_AGE > 110 THEN 110
      ELSE USER_CURRENT_AGE END AS user_age,
    COUNTRY,
    CASE WHEN trim(PROVINCE) IN ({_BAD}) THEN NULL ELSE PROVINCE END AS province,
    CASE WHEN trim(CITY) IN ({_BAD}) THEN NULL ELSE CITY END AS city,
    USER_WORLD_REGION, USER_AREA_NAME, iso3_code, {_DATES}, {_KEEP},
    ({_MNAR}) AS is_mnar,
    date_diff('day', ACCOUNT_CREATE_DATE, {REF}) AS tenure_days,
    date_diff('day', ACCOUNT_CREATE_DATE, {REF}) / 7.0::DOUBLE AS tenure_weeks
  FROM users_raw LEFT JOIN crosswalk ON COUNTRY = country_name
)"""


def gap(a: str, b: str) -> str:
    return (f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL "
            f"THEN greatest(0, date_diff('day', {a}, {b})) END")


def z(column: str) -> str:
    return f"coalesce({column}, 0.0::DOUBLE)"


_WEEKS = "greatest(tenure_weeks, 1.0::DOUBLE)"
_GAPS = ", ".join(f"{gap(a, b)} AS {n}" for n, (a, b) in {
    "days_to_first_login": ("account_create_date", "earliest_login_date"),
    "days_login_to_tree_edit": ("earliest_login_date", "earliest_tree_edit_date"),
    "days_login_to_name": ("earliest_login_date", "earliest_name_date"),
    "days_tree_to_source": ("earliest_tree_edit_date", "earliest_source_date"),
    "days_to_first_tree_edit": ("account_create_date", "earliest_tree_edit_date"),
    "days_to_first_name": ("account_create_date", "earliest_name_date"),
}.items())
_RATE_SQL = ", ".join(
    f"{z(c)} / {_WEEKS} AS {s}_per_week, ln(1 + {z(c)} / {_WEEKS}) AS log_{s}_pw, "
    f"ln(1 + {z(c)}) AS {raw}, "
    f"{z(c)} * least(90.0::DOUBLE, tenure_days) / greatest(tenure_days, 1.0::DOUBLE) AS {s}_90d"
    for s, (c, raw) in C.RATES.items())
FLAG = {n: f"CASE WHEN {z(c)} > 0 THEN 1 ELSE 0 END" for n, c in C.FLAGS.items()}
_FLAG_SQL = ", ".join(f"{e} AS {n}" for n, e in FLAG.items())
BREADTH = "(" + " + ".join(FLAG.values()) + ")"
_FIRST = "least(" + ", ".join(
    f"coalesce({C.MILESTONES[m]}, DATE '2099-12-31')" for m in C.CORE_MILESTONES) + ")"
_LAST = "greatest(" + ", ".join(
    f"coalesce({C.MILESTONES[m]}, account_create_date)" for m in C.CORE_MILESTONES) + ")"
_AGE = " ".join(f"WHEN user_age <= {b} THEN '{n}'"
                for b, n in zip(C.AGE_BOUNDS, C.AGE_LABELS))
_SEQ_ROWS = " UNION ALL ".join(
    f"SELECT USER_ID, '{m}' AS m, {c} AS d FROM users_clean WHERE NOT is_mnar "
    f"AND (earliest_login_date IS NOT NULL OR earliest_tree_edit_date IS NOT NULL "
    f"OR earliest_name_date IS NOT NULL) AND {c} IS NOT NULL"
    for m, c in C.MILESTONES.items())
TIER_D = ("NOT is_mnar AND tenure_days >= 31 AND coalesce(DAYS_LOGGING_IN, 0) >= {n} "
          "AND coalesce(TREE_EDITS, 0) > 0 AND coalesce(TOTAL_NAMES_ADDED, 0) > 0 "
          "AND earliest_login_date IS NOT NULL AND earliest_tree_edit_date IS NOT NULL "
          "AND earliest_name_date IS NOT NULL")


def tier_d(n: int = 1) -> str:
    return TIER_D.format(n=n)


FEAT = f"""
milestone_dates AS ({_SEQ_ROWS}),
user_sequences AS (
  SELECT USER_ID, string_agg(m, '>' ORDER BY d, m) AS seq FROM milestone_dates GROUP BY USER_ID
),
country_groups AS (
  SELECT {_LABEL} AS group_country,
    CASE WHEN n_nationkey <= 8 THEN 'High-LDS-International'
      WHEN n_nationkey <= 16 THEN 'Mod-Eng-Low-LDS'
      WHEN n_nationkey <= 20 THEN 'Low-Eng-High-Dev' ELSE 'Low-Eng-Developing' END AS grp
  FROM nation WHERE n_nationkey BETWEEN 1 AND 23
),
features_base AS (
  SELECT c.*, {_GAPS},
    CASE WHEN earliest_login_date IS NOT NULL THEN
      1.0::DOUBLE / (1.0::DOUBLE + greatest(0, date_diff('day', account_create_date, earliest_login_date))
        + coalesce({gap('earliest_login_date', 'earliest_tree_edit_date')}, 0)) END AS activation_speed,
    {_RATE_SQL}, {_FLAG_SQL}, {BREADTH} AS activity_breadth,
    CASE WHEN {z('RECORD_EDITS')} > 0 OR {z('GET_INVOLVED_ITEMS_REVIEWED')} > 0 THEN 4
      WHEN {z('SOURCES_ADDED')} > 0 THEN 3
      WHEN {z('TREE_EDITS')} > 0 OR {z('TOTAL_NAMES_ADDED')} > 0 THEN 2
      WHEN {z('DAYS_LOGGING_IN')} > 0 THEN 1 ELSE 0 END AS funnel_stage,
    {z('DAYS_LOGGING_IN')} / {_WEEKS} AS login_consistency,
    ln(1 + tenure_days) AS tenure_weight,
    CASE WHEN user_age IS NULL THEN NULL {_AGE} ELSE '80+' END AS age_group,
    CASE WHEN COUNTRY = 'NATION_0' AND USER_AREA_NAME = 'Core Area' THEN 'High-LDS-US-Utah'
      WHEN COUNTRY = 'NATION_0' THEN 'Mod-Eng-US-Other'
      ELSE coalesce(grp, 'Micro-Other') END AS country_cluster,
    {z('DAYS_LOGGING_IN')} / {_WEEKS} AS persistence_a,
    CASE WHEN {_LAST} > {_FIRST} THEN date_diff('day', {_FIRST}, {_LAST}) * 1.0::DOUBLE
      / greatest(tenure_days, 1) ELSE 0.0::DOUBLE END AS persistence_b,
    least(1.0::DOUBLE, {z('DAYS_LOGGING_IN')} / {_WEEKS}) / 3.0::DOUBLE
      + CASE WHEN {_LAST} > account_create_date THEN
          (1.0::DOUBLE - date_diff('day', {_LAST}, {REF}) * 1.0::DOUBLE / greatest(tenure_days, 1))
          / 3.0::DOUBLE ELSE 0.0::DOUBLE END
      + {BREADTH} / 7.0::DOUBLE / 3.0::DOUBLE AS persistence_c,
    coalesce(seq, '') AS milestone_sequence
  FROM users_clean c LEFT JOIN user_sequences s ON s.USER_ID = c.USER_ID
  LEFT JOIN country_groups g ON g.group_country = c.COUNTRY
),
users_features AS (
  SELECT *,
    CASE WHEN is_mnar THEN 'A_MNAR' WHEN tenure_days < 31 THEN 'X_SHORT_TENURE'
      WHEN {z('DAYS_LOGGING_IN')} = 0 AND activity_breadth = 0 THEN 'B_NO_ACTIVITY'
      WHEN {z('DAYS_LOGGING_IN')} = 0 THEN 'C_NONLOGIN_CONTRIB'
      WHEN {z('DAYS_LOGGING_IN')} = 1 AND {z('TREE_EDITS')} = 0 AND {z('TOTAL_NAMES_ADDED')} = 0
        AND {z('SOURCES_ADDED')} = 0 THEN 'D_SINGLE_BROWSE'
      WHEN {z('DAYS_LOGGING_IN')} <= 2 THEN 'E_LIGHT'
      WHEN {z('DAYS_LOGGING_IN')} <= 10 THEN 'F_MODERATE'
      WHEN {z('DAYS_LOGGING_IN')} <= 50 THEN 'G_REGULAR' ELSE 'H_POWER' END AS activity_segment
  FROM features_base
)"""

LABEL = """
cuts AS (
  SELECT median(persistence_c) AS med, quantile_cont(persistence_c, 0.333) AS p33,
         quantile_cont(persistence_c, 0.667) AS p67
  FROM users_features WHERE NOT is_mnar
),
users_labelled AS (
  SELECT f.*,
    CASE WHEN is_mnar THEN NULL WHEN persistence_c >= med THEN 1 ELSE 0 END AS persist_median,
    CASE WHEN is_mnar THEN NULL WHEN persistence_c >= p67 THEN 2
      WHEN persistence_c >= p33 THEN 1 ELSE 0 END AS persist_tertile
  FROM users_features f, cuts
)"""

_SUMS = ["n_orders", "price_cents", "bal_cents", "n_f", "n_o", "n_p", "lines",
         "disc_cents", "tax_cents", "qty"]
_YSUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in _SUMS)
_YEXT = "max(max_price_cents) AS max_price_cents, min(min_bal_cents) AS min_bal_cents"
_IND = {
    "gdp_per_capita_ppp": "price_cents / n_orders / 100",
    "internet_pct": "bal_cents / n_orders / 10000",
    "mobile_per_100": "max_price_cents / 100000",
    "tertiary_enrollment": "min_bal_cents / 100",
    "population": "n_orders * 1000.0::DOUBLE",
}

COUNTRY = f"""
lines_by_order AS (
  SELECT l_orderkey, count(*) AS lines, sum(CAST(round(l_discount * 100) AS BIGINT)) AS dcents,
    sum(CAST(round(l_tax * 100) AS BIGINT)) AS tcents, sum(CAST(l_quantity AS BIGINT)) AS qty
  FROM lineitem GROUP BY l_orderkey
),
nation_year AS (
  SELECT c_nationkey AS nk, CAST(year(o_orderdate) AS INTEGER) AS yr,
    CAST(month(o_orderdate) AS INTEGER) AS mon, count(*) AS n_orders,
    sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS price_cents,
    max(CAST(round(o_totalprice * 100) AS BIGINT)) AS max_price_cents,
    sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS bal_cents,
    min(CAST(round(c_acctbal * 100) AS BIGINT)) AS min_bal_cents,
    count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f,
    count(*) FILTER (WHERE o_orderstatus = 'O') AS n_o,
    count(*) FILTER (WHERE o_orderstatus = 'P') AS n_p,
    sum(lines) AS lines, sum(dcents) AS disc_cents, sum(tcents) AS tax_cents, sum(qty) AS qty
  FROM orders LEFT JOIN lines_by_order ON l_orderkey = o_orderkey
  JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2, 3
),
nations AS (
  SELECT n_nationkey AS nk, {_LABEL} AS country, {_ISO} AS iso3, r_name
  FROM nation JOIN region ON r_regionkey = n_regionkey
),
by_nation AS (SELECT nk, yr, {_YSUMS}, {_YEXT} FROM nation_year GROUP BY nk, yr),
by_region AS (SELECT r_name, yr, {_YSUMS}, {_YEXT} FROM nation_year JOIN nations USING (nk)
  GROUP BY r_name, yr),
economies AS (
  SELECT iso3 AS economy, FALSE AS aggregate, (nk + yr) % 4 = 0 AS gap, b.* EXCLUDE (nk)
  FROM by_nation b JOIN nations USING (nk)
  UNION ALL SELECT r_name, TRUE, FALSE, b.* EXCLUDE (r_name) FROM by_region b
),
indicator_records AS ({" UNION ALL ".join(
    f"SELECT economy, yr AS time, '{n}' AS indicator, CASE WHEN NOT gap THEN CAST({e} AS DOUBLE) "
    f"END AS value, aggregate FROM economies" for n, e in _IND.items())}),
latest_indicators AS (
  SELECT economy, indicator, value, time FROM (
    SELECT *, row_number() OVER (PARTITION BY economy, indicator ORDER BY time DESC) AS rn
    FROM indicator_records WHERE NOT aggregate AND value IS NOT NULL) WHERE rn = 1
),
wdi AS (
  SELECT economy AS iso3_code, {", ".join(
      f"max(value) FILTER (WHERE indicator = '{n}') AS {n}" for n in _IND)}
  FROM latest_indicators GROUP BY economy
),
index_2001 AS (
  SELECT iso3 AS iso3_code,
    CASE WHEN nk IN (6, 7, 8) THEN '..' ELSE
      CAST(CAST(round(disc_cents / lines / 10, 4) AS DECIMAL(18, 4)) AS VARCHAR) END AS hdi_text,
    CAST(round(tax_cents / lines, 4) AS DOUBLE) AS education_index,
    CAST(round(qty / lines, 4) AS DOUBLE) AS life_expectancy
  FROM by_nation JOIN nations USING (nk) WHERE yr = 2001
),
hdi AS (
  SELECT iso3_code, try_cast(hdi_text AS DOUBLE) AS hdi, education_index, life_expectancy
  FROM index_2001 WHERE try_cast(hdi_text AS DOUBLE) IS NOT NULL
),
running AS (
  SELECT nk, mon, CAST(sum(n_orders) OVER (PARTITION BY nk ORDER BY mon) AS BIGINT) AS r
  FROM nation_year WHERE yr = 2001
),
snapshot_rows AS (
  SELECT country AS country_name,
    CASE WHEN nk = 12 AND mon = 3 THEN NULL
      ELSE make_date(2001, CASE WHEN nk IN (2, 3) AND mon = 7 THEN 6 ELSE mon END, 1)
      END AS snapshot_date,
    CASE WHEN NOT (nk = 9 AND mon = 7) THEN CAST(r * 1237 AS DOUBLE) END AS lds_membership,
    CAST(r * 7 AS DOUBLE) AS lds_congregations, CAST(r % 5 AS DOUBLE) AS lds_temples,
    CAST(r % 11 AS DOUBLE) AS lds_stakes, CAST(r * 100003 AS DOUBLE) AS lds_country_pop
  FROM running JOIN nations USING (nk)
),
snapshot AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY country_name ORDER BY snapshot_date DESC NULLS LAST,
      lds_membership DESC NULLS LAST, lds_congregations DESC) AS rn FROM snapshot_rows)
  WHERE rn = 1
),
snapshot_by_code AS (
  SELECT iso3_code, {", ".join(
      f"arg_min({m}, country_name) FILTER (WHERE {m} IS NOT NULL) AS {m}" for m in
      ["lds_membership", "lds_congregations", "lds_temples", "lds_stakes", "lds_country_pop"])}
  FROM snapshot JOIN crosswalk USING (country_name) WHERE iso3_code IS NOT NULL GROUP BY iso3_code
),
composition AS (
  SELECT country AS country_name, n_f / n_orders * 100 AS pct_christian,
    n_o / n_orders * 100 AS pct_muslim, n_p / n_orders * 100 AS pct_unaffiliated,
    (1 - (0.0::DOUBLE + (n_f / n_orders) * (n_f / n_orders) + (n_o / n_orders) * (n_o / n_orders)
      + (n_p / n_orders) * (n_p / n_orders))) * 10 AS religious_diversity_index
  FROM by_nation JOIN nations USING (nk) WHERE yr = 2001
),
restrictions AS (
  SELECT country AS country_name, tax_cents / lines AS govt_restrictions_index,
    disc_cents / lines AS social_hostilities_index
  FROM by_nation JOIN nations USING (nk) WHERE yr = 2001
),
attitudes AS (
  SELECT country AS country_name, count(*) AS pew_n_respondents,
    round(count(*) FILTER (WHERE p_size % 10 IN (1, 2)) / count(*) * 100, 2) AS pct_relig_important,
    round(count(*) FILTER (WHERE p_size % 10 = 1) / count(*) * 100, 2) AS pct_relig_very_important,
    round(count(*) FILTER (WHERE l_linenumber IN (1, 2)) / count(*) * 100, 2) AS pct_prays_daily,
    round(count(*) FILTER (WHERE p_size % 3 = 2) / count(*) * 100, 2) AS pct_god_necessary_morality
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey
  JOIN nations ON nk = s_nationkey
  WHERE p_size % 10 NOT IN (8, 9) GROUP BY country
)"""


def _folded(table: str, columns: list[str]) -> str:
    return (f"{table}_by_code AS (SELECT iso3_code, "
            + ", ".join(f"max({c}) AS {c}" for c in columns)
            + f" FROM {table} JOIN crosswalk USING (country_name)"
            " WHERE iso3_code IS NOT NULL GROUP BY iso3_code)")


COMPOSITION = ["pct_christian", "pct_muslim", "pct_unaffiliated", "religious_diversity_index"]
RESTRICTIONS = ["govt_restrictions_index", "social_hostilities_index"]
ATTITUDES = ["pew_n_respondents", "pct_relig_important", "pct_relig_very_important",
             "pct_prays_daily", "pct_god_necessary_morality"]
_GEPI = C.COMPOSITE_COMPONENTS
_ZS = {c: (f"CASE WHEN s_{c} > 0 THEN ({c} - m_{c}) / s_{c} ELSE 0.0::DOUBLE END")
       for c in _GEPI}
_NZ = " + ".join(f"CASE WHEN s_{c} > 0 AND {c} IS NULL THEN 0 ELSE 1 END" for c in _GEPI)
_SUMZ = " + ".join(f"coalesce({e}, 0.0::DOUBLE)" for e in _ZS.values())

ENRICH = f"""
{_folded("composition", COMPOSITION)},
{_folded("restrictions", RESTRICTIONS)},
{_folded("attitudes", ATTITUDES)},
enrich_base AS (
  SELECT *, lds_membership / greatest(lds_country_pop, 1.0::DOUBLE) AS lds_members_per_capita
  FROM (SELECT DISTINCT iso3_code FROM crosswalk WHERE iso3_code IS NOT NULL)
  LEFT JOIN wdi USING (iso3_code) LEFT JOIN hdi USING (iso3_code)
  LEFT JOIN snapshot_by_code USING (iso3_code)
),
z_stats AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in _GEPI)}
  FROM enrich_base),
enrichment AS (
  SELECT b.*, CASE WHEN {_NZ} >= 3 THEN ({_SUMZ}) / ({_NZ}) END AS gepi, {_NZ} AS gepi_n_components,
    {", ".join(COMPOSITION + RESTRICTIONS + ATTITUDES)}
  FROM enrich_base b CROSS JOIN z_stats
  LEFT JOIN composition_by_code USING (iso3_code)
  LEFT JOIN restrictions_by_code USING (iso3_code)
  LEFT JOIN attitudes_by_code USING (iso3_code)
)"""

_LEVELS = {
    "raw": [RAW],
    "xwalk": [XWALK],
    "clean": [RAW, XWALK, CLEAN],
    "feat": [RAW, XWALK, CLEAN, FEAT],
    "label": [RAW, XWALK, CLEAN, FEAT, LABEL],
    "country": [XWALK, COUNTRY],
    "enrich": [XWALK, COUNTRY, ENRICH],
    "all": [RAW, XWALK, CLEAN, FEAT, LABEL, COUNTRY, ENRICH],
}


def sql(level: str, select: str, *ctes: str) -> str:
    """Statement that selects from the layers of ``level`` plus further expressions."""
    text = "WITH " + ",\n".join([*_LEVELS[level], *ctes])
    select = select.strip()
    return text + (select if select.startswith(",") else "\n" + select)


def rounded(columns: list[str], digits: int = 6, source: str = "") -> str:
    return ", ".join(f"round({source}{c}, {digits}) AS {c}" for c in columns)
