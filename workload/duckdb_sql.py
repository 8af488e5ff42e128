"""The same questions in DuckDB SQL, phrased in their own way.

Where the Spark plans aggregate, these rank with windows, use EXISTS, or join
fully outer; the two sides share nothing but the names of columns.
"""

from __future__ import annotations

ORACLE: dict[str, str] = {}

AS_OF = "DATE '2001-06-01'"


def pct(part: str, whole: str, places: int = 2, empty: str = "0.0") -> str:
    scale = 10**places
    return (
        f"CASE WHEN ({whole}) > 0 THEN CAST((({part}) * {200 * scale} + ({whole})) // (2 * ({whole})) AS DOUBLE)"
        f" / {float(scale)} ELSE {empty} END"
    )


def big(expression: str) -> str:
    return f"CAST(COALESCE({expression}, 0) AS BIGINT)"


# The priority buckets, and one status text per branch of the classes.
BUCKETS = [
    "NDF<14", "NotF<90", "P6", "P8", "NDF<7", "P5", "P2", "NDF<60", "NotF<60", "P1", "P3",
    "NotF<7", "P10", "NDF<30", "updated", "P7", "NotF<30", "NDF<90", "NotF<14",
]
TEXTS = [
    "HTTP 403", "Output Pattern not found", "Link Step have no links", "Error in loading page :404",
    "Not Found", "Part found elsewhere", "Timeout Error", "Incomplete page", "NullPointerException",
    "java.lang crash", "a-b", "", "anything", "found",
]


def array(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


PRTY = f"({array([*BUCKETS, 'X1'])})[CAST((l_partkey * 7 + l_linenumber) % 21 AS INTEGER) + 1]"


def text_at(place: str) -> str:
    return f"({array(TEXTS)})[CAST(({place}) % 15 AS INTEGER) + 1]"


LRD = "CASE WHEN l_quantity <= 2 OR l_returnflag = 'R' THEN CAST(l_shipdate AS DATE) END"
NFD = "CASE WHEN l_quantity <= 2 OR l_returnflag = 'A' THEN CAST(l_shipdate AS DATE) END"


def feed(man: str, mod: str) -> str:
    return f"""SELECT CAST(l_orderkey AS VARCHAR) AS mpn, {man} AS man_id, {mod} AS mod_id,
      CASE WHEN l_linenumber <> 6 THEN CAST(l_shipdate AS DATE) + 3 END AS check_date,
      {text_at('l_partkey + l_linenumber')} AS status
    FROM lineitem"""


def site(column: str) -> str:
    return f"{column} IN ('Output Pattern not found', 'Link Step have no links', 'Error in loading page :404')"


def has(column: str, *words: str) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def error_class(text: str, status: str) -> str:
    return f"""CASE WHEN {status} = 'found' THEN '' WHEN {has(text, '403')} THEN 'Proxy' WHEN {site(text)} THEN 'SITE'
      WHEN {has(text, 'Not Found')} THEN 'Not Found' WHEN {has(text, 'Error', 'Incomplete')} THEN 'Proxy'
      WHEN {has(text, 'Exception', 'java')} THEN 'SW' WHEN {has(text, 'found')} THEN '' ELSE 'not assigned error' END"""


def watch_class(text: str) -> str:
    return f"""CASE WHEN {text} IS NULL OR {text} = '' THEN 'not run' WHEN {site(text)} THEN 'SITE'
      WHEN {has(text, 'Not Found')} THEN 'Not Found' WHEN {has(text, 'found')} THEN 'found'
      WHEN {has(text, 'Error', 'Incomplete')} THEN 'Proxy' WHEN {has(text, 'Exception', 'java')} THEN 'SW'
      WHEN {has(text, '-')} THEN '-' ELSE 'not assigned error' END"""


def simple_class(text: str) -> str:
    return f"""CASE WHEN {has(text, '403')} THEN 'Proxy' WHEN {has(text, 'Error', 'Exception', 'Incomplete')}
      THEN 'Error' ELSE {text} END"""


def run_state(flag: str) -> str:
    return f"""CASE {flag} WHEN 0 THEN 'Stopped' WHEN 1 THEN 'Regular Running' WHEN 2 THEN 'Run By Request'
      WHEN 3 THEN 'schedule Running' WHEN 4 THEN 'schedule Running' ELSE 'Unknown' END"""


# Registry ------------------------------------------------------------------

LC = f"""lc AS (
  SELECT CAST(u.l_orderkey AS VARCHAR) AS pn, u.l_suppkey AS man_id
  FROM lineitem u
  LEFT JOIN (
    SELECT p_partkey AS com_id, CASE WHEN p_size % 4 <> 0 THEN 1 ELSE 0 END AS latest,
      CASE WHEN p_size % 7 <> 0 THEN {AS_OF} - CAST(p_size * 4 AS INTEGER) END AS last_checked_date,
      CASE WHEN p_size % 3 <> 0 THEN DATE '2000-01-01' END AS se_lc_date, p_partkey % 25 AS lookup
    FROM part) h ON u.l_partkey = h.com_id
  LEFT JOIN (
    SELECT n_nationkey, n_regionkey,
      CASE n_nationkey % 3 WHEN 0 THEN 'Obsolete' WHEN 1 THEN 'LTB' ELSE 'Active' END AS se_lc
    FROM nation) k ON h.lookup = k.n_nationkey
  LEFT JOIN region r ON k.n_regionkey = r.r_regionkey
  WHERE r.r_name IN ('AFRICA', 'ASIA', 'EUROPE') AND h.latest = 1
    AND (CASE WHEN u.l_linenumber = 5 THEN 'A)$.@(B' WHEN u.l_linenumber <> 6 THEN CAST(u.l_orderkey AS VARCHAR) END)
        NOT LIKE '%)$.@(%'
    AND (NOT (h.last_checked_date >= {AS_OF} - 90 OR k.se_lc = 'Obsolete'
              OR (k.se_lc = 'LTB' AND h.se_lc_date IS NOT NULL))
         OR h.last_checked_date IS NULL)
)"""

LATEST = f"""latest AS (
  SELECT mpn, man_id, status FROM (
    SELECT *, row_number() OVER (PARTITION BY mpn ORDER BY check_date DESC NULLS FIRST, man_id DESC NULLS LAST,
      status DESC NULLS LAST) AS rn
    FROM ({feed('l_suppkey', 'l_partkey % 5')})) WHERE rn = 1
)"""

REG = f"""reg AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS pn, l_suppkey AS man_id, l_partkey % 5 AS mod_id, {PRTY} AS prty,
    CASE WHEN p_size % 10 <> 0 THEN split_part(p_name, ' ', 1) || ' | ' || split_part(p_name, ' ', 2) || '|'
      || p_brand || '||' || split_part(p_name, ' ', 1) END AS cs,
    COALESCE({LRD}, DATE '1970-01-01') AS lrd2, COALESCE({NFD}, DATE '1970-01-01') AS v_notfound_dat2
  FROM lineitem JOIN part ON l_partkey = p_partkey
)"""

DIMS = """dims AS (
  SELECT s_suppkey AS man_id, k AS mod_id, 'M' || CAST(s_suppkey % 7 AS VARCHAR) || '-' || CAST(k AS VARCHAR)
    AS module_name, CAST((s_suppkey + k) % 6 AS INTEGER) AS run_flag, s_name AS man_name
  FROM supplier, (SELECT unnest(range(0, 4)) AS k)
)"""


def classed(extra: str, source: str) -> str:
    """Rows of a source with registry status, date, error class and expiry."""
    inner = f"""SELECT *, CASE WHEN v_notfound_dat2 > lrd2 THEN 'not found' WHEN lrd2 > v_notfound_dat2 THEN 'found'
        WHEN lrd2 = DATE '1970-01-01' AND v_notfound_dat2 = DATE '1970-01-01' THEN 'not run' END AS status,
      CASE WHEN v_notfound_dat2 > lrd2 THEN v_notfound_dat2 WHEN lrd2 > v_notfound_dat2 THEN lrd2 END AS lr_date
      FROM {source}"""
    return f"""SELECT {extra} man_name, module_name, run_flag, prty, cs, lrd2, v_notfound_dat2, status, lr_date,
      lc_outdated, {error_class('feed_status', 'status')} AS error_status,
      (lr_date IS NULL OR lr_date < {AS_OF} - 30) AS is_expired FROM ({inner})"""


def joined(lc_mode: str) -> str:
    lc = "lc" if lc_mode == "reference" else "(SELECT DISTINCT pn, man_id FROM lc)"
    return f"""joined AS (
  SELECT a.pn, a.man_id, a.mod_id, a.prty, a.cs, a.lrd2, a.v_notfound_dat2,
    CASE WHEN b.pn IS NULL THEN 0 ELSE 1 END AS lc_outdated, ls.status AS feed_status
  FROM reg a LEFT JOIN {lc} b ON a.man_id = b.man_id AND a.pn = b.pn
  LEFT JOIN latest ls ON ls.mpn = a.pn AND ls.man_id = a.man_id
)"""


def snapshot_cte(lc_mode: str = "reference") -> str:
    grouped = """(SELECT g.*, d.module_name, d.run_flag, d.man_name FROM (
      SELECT man_id, mod_id, prty, cs, lc_outdated, lrd2, v_notfound_dat2, feed_status, count(*) AS cnt
      FROM joined GROUP BY ALL) g JOIN dims d ON g.man_id = d.man_id AND g.mod_id = d.mod_id)"""
    body = classed('CAST(cnt AS BIGINT) AS "count",', grouped)
    return f"WITH {LC}, {LATEST}, {REG}, {DIMS}, {joined(lc_mode)}, snap AS ({body})"


def drill_cte(lc_mode: str) -> str:
    rows = """(SELECT j.*, d.module_name, d.run_flag, d.man_name FROM joined j
      JOIN dims d ON j.man_id = d.man_id AND j.mod_id = d.mod_id)"""
    return f"""WITH {LC}, {LATEST}, {REG}, {DIMS}, {joined(lc_mode)}, drill AS ({classed('pn AS part_number,', rows)})"""


SNAP = snapshot_cte()
SNAP_OUT = f'SELECT *, {AS_OF} AS download_date FROM snap'
REQUEST = """prty IN ('P1', 'P2', 'P3', 'NotF<90', 'NDF<30') AND status IN ('found', 'not found')
  AND run_flag IN (0, 1, 2, 3) AND lr_date >= DATE '1997-01-01'"""

ORACLE["registry_lifecycle_chain"] = f"WITH {LC} SELECT * FROM lc"
ORACLE["registry_latest_status"] = f"WITH {LATEST} SELECT * FROM latest"
ORACLE["registry_snapshot"] = f"{SNAP} {SNAP_OUT}"
ORACLE["registry_snapshot_distinct"] = f"{snapshot_cte('distinct')} {SNAP_OUT}"
ORACLE["registry_drilldown_classified"] = f"""{drill_cte('distinct')} SELECT * FROM drill
  WHERE error_status IN ('Proxy', 'SW', 'not assigned error') AND is_expired AND lc_outdated = 0
    AND lr_date <= DATE '2000-12-31'"""
# Rows are weighted where the plain join would repeat them.
WEIGHTED = f"""WITH {LC}, {LATEST}, {REG}, {DIMS}, weights AS (
  SELECT pn, man_id, count(*) AS n FROM lc GROUP BY pn, man_id), weighed AS (
  SELECT a.*, CASE WHEN w.n IS NULL THEN 0 ELSE 1 END AS lc_outdated, CAST(COALESCE(w.n, 1) AS BIGINT) AS weight,
    ls.status AS feed_status, d.module_name, d.run_flag, d.man_name
  FROM reg a JOIN dims d ON a.man_id = d.man_id AND a.mod_id = d.mod_id
  LEFT JOIN weights w ON a.pn = w.pn AND a.man_id = w.man_id
  LEFT JOIN latest ls ON ls.mpn = a.pn AND ls.man_id = a.man_id), drill AS (
  {classed('pn AS part_number, weight,', 'weighed')})"""
UPPER = ", ".join(
    f"{c} AS {c.upper()}" for c in (
        "part_number man_name module_name run_flag prty cs lrd2 v_notfound_dat2 status lr_date lc_outdated "
        "error_status is_expired weight"
    ).split()
)
ORACLE["registry_drilldown"] = f"{WEIGHTED} SELECT {UPPER} FROM drill"
ORACLE["registry_drilldown_substring_label"] = (
    f"{WEIGHTED} SELECT * FROM drill WHERE {REQUEST} AND (cs LIKE '%Brand#2%' OR cs LIKE '%red%')"
)
ORACLE["registry_filter_word_label"] = (
    f"{SNAP} {SNAP_OUT} WHERE {REQUEST} AND regexp_matches(cs, '\\bBrand#2\\b|\\bred\\b')"
)
ORACLE["registry_filter_member_label"] = f"""{SNAP} {SNAP_OUT}
  WHERE list_contains(list_transform(string_split(cs, '|'), lambda x: trim(x)), 'gear')"""

DUE = "COALESCE(prty LIKE 'P%', false)"
ORACLE["registry_kpis"] = f"""{SNAP}, k AS (SELECT
  {big('sum("count")')} AS total_parts,
  {big("sum(\"count\") FILTER (WHERE status = 'found')")} AS found_parts,
  {big("sum(\"count\") FILTER (WHERE status = 'not found')")} AS not_found_parts,
  {big("sum(\"count\") FILTER (WHERE status = 'not run')")} AS not_run_parts,
  {big(f'sum("count") FILTER (WHERE {DUE})')} AS expired_parts,
  {big('sum("count") FILTER (WHERE is_expired)')} AS expired_by_date,
  {big('sum("count") FILTER (WHERE lc_outdated = 1)')} AS lc_outdated_parts,
  count(DISTINCT module_name) AS unique_modules, count(DISTINCT man_name) AS unique_manufacturers FROM snap)
SELECT *, {pct('found_parts', 'total_parts', 1)} AS found_percentage,
  {pct('not_found_parts', 'total_parts', 1)} AS not_found_percentage,
  {pct('not_run_parts', 'total_parts', 1)} AS not_run_percentage,
  {pct('expired_parts', 'total_parts', 1)} AS expired_percentage,
  {pct('lc_outdated_parts', 'total_parts', 1)} AS lc_outdated_percentage FROM k"""


def chart(name: str, label: str, where: str = "true", value: str = 'sum("count")') -> str:
    return (
        f"SELECT '{name}' AS chart, {label} AS label, {big(value)} AS value FROM snap WHERE {where} GROUP BY ALL"
    )


NONE = "COALESCE({0}, '(none)')"
ORACLE["registry_charts_all"] = SNAP + " " + " UNION ALL ".join([
    chart("status", NONE.format("status")),
    chart("priority", NONE.format("prty")),
    chart("run_flag", "CAST(run_flag AS VARCHAR)"),
    chart("error_status", "error_status", "error_status <> ''"),
    "SELECT 'lc_outdated', 'Up to Date', " + big('sum("count") FILTER (WHERE lc_outdated = 0)') + " FROM snap",
    "SELECT 'lc_outdated', 'Outdated', " + big('sum("count") FILTER (WHERE lc_outdated = 1)') + " FROM snap",
    "SELECT 'expired', 'Active', " + big(f'sum("count") FILTER (WHERE NOT {DUE})') + " FROM snap",
    "SELECT 'expired', 'Expired', " + big(f'sum("count") FILTER (WHERE {DUE})') + " FROM snap",
])
ORACLE["registry_chart_sets"] = SNAP + " " + " UNION ALL ".join([
    chart("status", NONE.format("status")),
    chart("prty", NONE.format("prty")),
    chart("run_flag", "CAST(run_flag AS VARCHAR)"),
])
ORACLE["registry_top_mans"] = f"""{SNAP} SELECT man_name, {big('sum("count")')} AS value FROM snap
  GROUP BY man_name ORDER BY value DESC, man_name LIMIT 10"""
LABELS = """SELECT DISTINCT rid, trim(u) AS label, "count", keep FROM (
    SELECT rid, unnest(string_split(cs, '|')) AS u, "count", keep FROM numbered) WHERE trim(u) <> ''"""
ORACLE["registry_labels"] = f"""{SNAP}, numbered AS (SELECT row_number() OVER () AS rid, cs, "count", true AS keep
  FROM snap) SELECT label, {big('sum("count")')} AS value FROM ({LABELS}) GROUP BY label"""
ORACLE["registry_labels_filtered"] = f"""{SNAP}, numbered AS (SELECT row_number() OVER () AS rid, cs, "count",
  status = 'found' AND regexp_matches(cs, '\\bBrand#2\\b') AS keep FROM snap)
  SELECT label, {big('sum("count") FILTER (WHERE keep)')} AS value FROM ({LABELS}) GROUP BY label"""
ORACLE["registry_timeline"] = f"""{SNAP}, span AS (SELECT greatest(min(lr_date), {AS_OF} - 365) AS first FROM snap)
  SELECT lr_date AS date, {big('sum("count")')} AS value FROM snap, span WHERE lr_date >= first GROUP BY lr_date"""
ORACLE["registry_timeline_range"] = f"""{SNAP} SELECT min(lr_date) AS min_date, max(lr_date) AS max_date,
  greatest(min(lr_date), {AS_OF} - 365) AS default_start, max(lr_date) AS default_end FROM snap"""
ORACLE["registry_options"] = f"""{SNAP} SELECT DISTINCT option, value FROM (
  SELECT 'man_names' AS option, man_name AS value FROM snap UNION ALL SELECT 'module_names', module_name FROM snap
  UNION ALL SELECT 'priorities', COALESCE(prty, '(none)') FROM snap
  UNION ALL SELECT 'statuses', COALESCE(status, '(none)') FROM snap
  UNION ALL SELECT 'run_flags', CAST(run_flag AS VARCHAR) FROM snap
  UNION ALL SELECT 'lc_outdated', CAST(lc_outdated AS VARCHAR) FROM snap
  UNION ALL SELECT 'error_status', error_status FROM snap WHERE error_status <> ''
  UNION ALL SELECT 'cs_labels', trim(u) FROM (SELECT unnest(string_split(cs, '|')) AS u FROM snap) WHERE trim(u) <> '')"""
ORACLE["registry_table"] = f"""{SNAP} SELECT man_name, module_name, {big('sum("count")')} AS "count",
  {big(f'sum("count") FILTER (WHERE {DUE})')} AS outdated,
  {big('sum("count") FILTER (WHERE is_expired)')} AS expired,
  {big("sum(\"count\") FILTER (WHERE status = 'found')")} AS found,
  {big("sum(\"count\") FILTER (WHERE status = 'not found')")} AS notfound FROM snap GROUP BY man_name, module_name"""


def pivot(day: str) -> str:
    cells = ", ".join(f"""count(*) FILTER (WHERE prty = '{b}') AS "{b}\"""" for b in BUCKETS)
    return f"SELECT {day} AS summary_date, {cells} FROM (SELECT {PRTY} AS prty FROM lineitem)"


ORACLE["priority_pivot"] = pivot(AS_OF)
ORACLE["summary_history"] = " UNION ALL ".join(pivot(f"DATE '2001-06-0{d}'") for d in (1, 2, 3))

# Watch lists ---------------------------------------------------------------

PARTS = """parts AS (
  SELECT o_orderkey AS id, CAST(o_orderkey AS VARCHAR) AS part, 'NATION_' || CAST(o_custkey % 25 AS VARCHAR) AS man,
    o_orderpriority AS module, o_custkey AS file_id,
    CASE WHEN o_totalprice < 20000 THEN 'not_valid' ELSE o_orderstatus END AS status,
    CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS cm_date,
    CASE WHEN o_orderstatus <> 'O' THEN CAST(o_orderdate AS DATE) END AS last_run_date,
    CASE o_orderstatus WHEN 'F' THEN 'found' WHEN 'P' THEN 'not SE part' END AS table_name,
    'old|' AS features, o_orderstatus AS monitor_features, CAST(NULL AS VARCHAR) AS prty,
    CAST(NULL AS BIGINT) AS man_id, CAST(NULL AS BIGINT) AS module_id
  FROM orders
)"""
FILES = f"""files AS (
  SELECT c_custkey AS id, c_name AS file_name, DATE '1996-01-01' + CAST(c_custkey % 1500 AS INTEGER) AS upload_date,
    CASE c_mktsegment WHEN 'MACHINERY' THEN {AS_OF} WHEN 'BUILDING' THEN NULL ELSE {AS_OF} - 5 END AS last_check_date,
    CASE WHEN c_acctbal >= 0 THEN {AS_OF} + CAST(c_custkey % 21 - 10 AS INTEGER) END AS stop_monitor_date
  FROM customer
)"""
MODULES = """modules AS (
  SELECT * FROM (VALUES ('1-URGENT', CAST(0 AS BIGINT), CAST(0 AS BIGINT), 0), ('2-HIGH', 1, 1, 1),
    ('3-MEDIUM', 2, 0, 2), ('4-NOT SPECIFIED', 3, 1, 4)) AS t(module_name, man_id, module_id, run_flag)
)"""
ELIGIBLE_WHERE = f"COALESCE(stop_monitor_date, DATE '2999-01-01') > {AS_OF}"
ELIGIBLE = f"""due AS (
  SELECT * FROM files WHERE {ELIGIBLE_WHERE} AND COALESCE(last_check_date, DATE '1900-01-01') < {AS_OF}
)"""
FACTS = f"""facts AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS pn, l_suppkey % 4 AS man_id, l_partkey % 2 AS mod_id, {PRTY} AS prty,
    {LRD} AS lrd, {NFD} AS nfd FROM lineitem
)"""
FEED = f"feed AS ({feed('l_suppkey % 4', 'l_partkey % 2')})"
SOURCE = """known AS (
  SELECT p.id, p.part, p.man, p.module, p.file_id, p.cm_date, p.monitor_features, m.man_id, m.module_id,
    CASE WHEN m.module_name IS NULL THEN 'not_valid' ELSE p.status END AS stored
  FROM parts p LEFT JOIN modules m ON p.module = m.module_name WHERE p.file_id IN (SELECT id FROM due)
), seen AS (
  SELECT pn, man_id, mod_id, greatest(COALESCE(lrd, DATE '1900-01-01'), COALESCE(nfd, DATE '1900-01-01')) AS top, prty
  FROM facts QUALIFY row_number() OVER (PARTITION BY pn, man_id, mod_id ORDER BY
    greatest(COALESCE(lrd, DATE '1900-01-01'), COALESCE(nfd, DATE '1900-01-01')) DESC, prty DESC NULLS LAST) = 1
), stated AS (
  SELECT k.*, s.top, s.prty,
    CASE WHEN k.stored = 'not_valid' THEN 'not_valid'
      WHEN NOT EXISTS (SELECT 1 FROM facts f WHERE f.pn = k.part AND f.man_id = k.man_id) THEN 'not SE part'
      WHEN EXISTS (SELECT 1 FROM facts f WHERE f.pn = k.part AND f.man_id = k.man_id AND f.mod_id = k.module_id
        AND f.lrd IS NULL AND f.nfd IS NULL) THEN 'not run'
      WHEN EXISTS (SELECT 1 FROM facts f WHERE f.pn = k.part AND f.man_id = k.man_id AND f.mod_id = k.module_id
        AND COALESCE(f.lrd, DATE '1900-01-01') > COALESCE(f.nfd, DATE '1900-01-01')) THEN 'found'
      ELSE 'not found' END AS cls
  FROM known k LEFT JOIN seen s ON s.pn = k.part AND s.man_id = k.man_id AND s.mod_id = k.module_id
), ranked AS (
  SELECT k.*, nf.status AS feed_text,
    greatest(COALESCE(nf.check_date, DATE '1900-01-01'), COALESCE(k.top, DATE '1900-01-01')) AS run,
    row_number() OVER (PARTITION BY k.id ORDER BY COALESCE(nf.check_date, DATE '1900-01-01') DESC,
      nf.check_date DESC NULLS LAST, nf.status DESC NULLS LAST) AS rn
  FROM stated k LEFT JOIN feed nf ON nf.mpn = k.part AND nf.man_id = k.man_id AND nf.mod_id = k.module_id
), src AS (
  SELECT id, part, man, module, file_id, cm_date, monitor_features,
    CASE WHEN cls <> 'found' THEN feed_text END AS status,
    CASE WHEN run > DATE '2001-01-01' THEN run END AS last_run_date, cls AS table_name, prty, man_id, module_id
  FROM ranked WHERE rn = 1
)"""
STATUS = f"WITH {PARTS}, {FILES}, {MODULES}, {ELIGIBLE}, {FACTS}, {FEED}, {SOURCE}"
MERGED = """merged AS (
  SELECT p.id, p.part, p.man, p.module, p.file_id,
    CASE WHEN s.id IS NOT NULL THEN s.status ELSE p.status END AS status, p.cm_date,
    CASE WHEN s.id IS NOT NULL THEN s.last_run_date ELSE p.last_run_date END AS last_run_date,
    CASE WHEN s.id IS NOT NULL THEN s.table_name ELSE p.table_name END AS table_name, p.features,
    p.monitor_features, s.prty AS prty, s.man_id AS man_id, s.module_id AS module_id
  FROM parts p LEFT JOIN src s ON p.id = s.id
)"""
FEATURES = """feats AS (
  SELECT l_suppkey % 4 AS man_id, l_partkey % 2 AS module_id, CAST(l_orderkey AS VARCHAR) AS part,
    CASE WHEN l_linenumber <> 7 THEN l_returnflag || l_linestatus END AS feature_name,
    CASE WHEN l_tax < 0.075 THEN CAST(l_shipdate AS DATE) END AS dat FROM lineitem
), used AS (
  SELECT DISTINCT m.module_name, m.man_id, m.module_id FROM parts p LEFT JOIN modules m ON p.module = m.module_name
  WHERE m.man_id IS NOT NULL AND m.module_id IS NOT NULL AND p.file_id IN (SELECT id FROM due)
)"""


def found_cte(target: str, names: bool = True, scope: str = "module") -> str:
    inside = "" if scope == "module" else "AND p.file_id IN (SELECT id FROM due)"
    name = ", feature_name" if names else ""
    packed = (
        "string_agg(COALESCE(feature_name, ''), '|' ORDER BY COALESCE(feature_name, '')) || '|' AS new_features,"
        if names else ""
    )
    return f"""ranks AS (
  SELECT p.id, p.part, t.dat {name}, rank() OVER (PARTITION BY p.id, p.part ORDER BY t.dat DESC NULLS FIRST) AS rnk
  FROM {target} p JOIN used u ON p.module = u.module_name
  JOIN (SELECT DISTINCT man_id, module_id, part, dat {name} FROM feats) t
    ON t.part = p.part AND t.man_id = u.man_id AND t.module_id = u.module_id
  WHERE true {inside}
), newest AS (
  SELECT id, part, {packed} dat AS new_last_run_date FROM ranks WHERE rnk = 1 GROUP BY id, part, dat
)"""


def overridden(target: str) -> str:
    newer = "n.new_last_run_date IS NOT NULL AND (p.last_run_date IS NULL OR n.new_last_run_date {0} p.last_run_date)"
    return f"""overridden AS (
  SELECT p.id, p.part, p.man, p.module, p.file_id,
    CASE WHEN {newer.format('>=')} THEN 'found' ELSE p.status END AS status, p.cm_date,
    CASE WHEN {newer.format('>')} THEN n.new_last_run_date ELSE p.last_run_date END AS last_run_date,
    CASE WHEN {newer.format('>=')} AND p.table_name <> 'not SE part' THEN 'found' ELSE p.table_name END AS table_name,
    CASE WHEN n.id IS NOT NULL THEN n.new_features ELSE p.features END AS features, p.monitor_features, p.prty,
    p.man_id, p.module_id
  FROM {target} p LEFT JOIN newest n ON p.id = n.id AND p.part = n.part
)"""


ORACLE["watch_files_listing"] = f"""WITH {FILES} SELECT id, file_name, CAST(upload_date AS VARCHAR) AS upload_date,
  CAST(last_check_date AS VARCHAR) AS last_check_date, CAST(stop_monitor_date AS VARCHAR) AS stop_monitor_date FROM files"""
ORACLE["watch_eligible_files"] = f"WITH {FILES}, {ELIGIBLE} SELECT * FROM due"
ORACLE["watch_eligible_ignoring_check"] = f"WITH {FILES} SELECT * FROM files WHERE {ELIGIBLE_WHERE}"
ORACLE["watch_status_source"] = f"{STATUS} SELECT * FROM src"
ORACLE["watch_merge_status"] = f"{STATUS}, {MERGED} SELECT * FROM merged"
ORACLE["watch_merge_by_id"] = ORACLE["watch_merge_status"]
FOUND_HEAD = f"WITH {PARTS}, {FILES}, {MODULES}, {ELIGIBLE}, {FEATURES}"
ORACLE["watch_modules_of_files"] = f"{FOUND_HEAD} SELECT * FROM used"
ORACLE["watch_found_source"] = f"{FOUND_HEAD}, {found_cte('parts')} SELECT * FROM newest"
ORACLE["watch_found_source_no_names"] = f"{FOUND_HEAD}, {found_cte('parts', False, 'file')} SELECT * FROM newest"
ORACLE["watch_merge_found"] = f"{FOUND_HEAD}, {found_cte('parts')}, {overridden('parts')} SELECT * FROM overridden"
RUN = f"{STATUS}, {MERGED}, {FEATURES}, {found_cte('merged')}, {overridden('merged')}"
ORACLE["watch_run_status"] = f"{RUN} SELECT * FROM overridden"


def results_of(target: str) -> str:
    return f"""results AS (
  SELECT p.id, p.part, p.man, p.module, p.file_id, p.status, p.cm_date, p.last_run_date, p.table_name, p.features,
    p.monitor_features, p.prty, f.file_name, f.upload_date, f.last_check_date, f.stop_monitor_date,
    m.man_id, m.module_id, m.run_flag, (p.last_run_date IS NULL OR p.last_run_date < {AS_OF} - 30) AS is_expired
  FROM {target} p JOIN files f ON p.file_id = f.id JOIN modules m ON p.module = m.module_name
)"""


ORACLE["watch_results_join"] = f"{RUN}, {results_of('overridden')} SELECT * FROM results"
ORACLE["watch_valid_counts"] = f"""{STATUS}, {MERGED} SELECT f.file_name, count(*) AS total_count,
  count(*) FILTER (WHERE m.table_name = 'not_valid') AS not_valid_count,
  count(*) FILTER (WHERE m.table_name IS DISTINCT FROM 'not_valid') AS valid_count
  FROM merged m JOIN files f ON m.file_id = f.id GROUP BY f.file_name"""
ORACLE["watch_mark_checked"] = f"""WITH {FILES} SELECT id, file_name, upload_date, CASE WHEN file_name IN
  ('Customer#000000001', 'Customer#000000005', 'Customer#000000009') THEN {AS_OF} ELSE last_check_date END
  AS last_check_date, stop_monitor_date FROM files"""
ORACLE["watch_stop_date"] = f"""WITH {FILES} SELECT id, file_name, upload_date, last_check_date,
  CASE WHEN file_name = 'Customer#000000007' THEN DATE '2002-01-01' ELSE stop_monitor_date END AS stop_monitor_date
  FROM files"""

CHECKED = f"""checked AS (
  SELECT * REPLACE ({text_at('id + file_id')} AS status,
    CASE id % 4 WHEN 0 THEN 'not run' WHEN 1 THEN 'found' WHEN 2 THEN 'not found' END AS table_name,
    CASE WHEN monitor_features <> 'O' THEN 'P' || CAST(id % 3 AS VARCHAR) END AS prty) FROM parts
)"""
RESULTS = f"WITH {PARTS}, {FILES}, {MODULES}, {CHECKED}, {results_of('checked')}"
CLASSED = f"""classed AS (
  SELECT * REPLACE ({watch_class('status')} AS status, COALESCE(prty, '-') AS prty,
    COALESCE(table_name, '-') AS table_name), status AS status_orig FROM results
)"""
CUBE_SELECT = """SELECT man, module, file_id, status, last_run_date, table_name, prty, file_name, is_expired,
    count(*) AS "count", min(last_check_date) AS last_check_date, min(upload_date) AS upload_date,
    min(stop_monitor_date) AS stop_monitor_date, min(man_id) AS man_id, min(module_id) AS module_id,
    min(run_flag) AS run_flag, COALESCE(last_run_date >= min(upload_date) - 1, false) AS done"""
GROUPED = f"""{RESULTS}, {CLASSED}, cube9 AS (
  {CUBE_SELECT} FROM classed
  GROUP BY man, module, file_id, status, last_run_date, table_name, prty, file_name, is_expired
)"""
ORACLE["watch_cube"] = f"{GROUPED} SELECT * FROM cube9"
ORACLE["watch_kpis"] = f"""{RESULTS}, {CLASSED} SELECT count(*) AS total_parts,
  count(*) FILTER (WHERE is_expired) AS expired_parts, count(*) FILTER (WHERE NOT is_expired) AS active_parts,
  count(*) FILTER (WHERE status IN ('Error', 'Proxy')) AS error_parts,
  count(*) FILTER (WHERE table_name = 'not run') AS missing_parts,
  count(DISTINCT module) + CASE WHEN count(*) > count(module) THEN 1 ELSE 0 END AS module_count FROM classed"""
ORACLE["watch_distributions"] = f"""{RESULTS}, {CLASSED}
  SELECT 'status' AS chart, status AS label, count(*) AS value FROM classed WHERE status IS NOT NULL GROUP BY status
  UNION ALL SELECT 'module', module, count(*) FROM classed WHERE module IS NOT NULL GROUP BY module
  UNION ALL SELECT 'table_name', table_name, count(*) FROM classed WHERE table_name IS NOT NULL GROUP BY table_name"""
ORACLE["watch_timeline"] = f"""{RESULTS} SELECT last_run_date AS date, count(*) AS value FROM results
  WHERE last_run_date IS NOT NULL GROUP BY last_run_date"""
ORACLE["watch_status_counts"] = f"""{RESULTS} SELECT status, count(*) AS value FROM results
  WHERE status IS NOT NULL GROUP BY status"""

MATRIX = """matrix AS (
  SELECT * FROM (VALUES ('1-URGENT', '"Running"', 'ok, fine', NULL, 0), ('1-URGENT', 'Pending data team', 'second', 'x', 1),
    ('2-HIGH', 'Pending data team', NULL, 'old', 2), ('3-MEDIUM', NULL, 'third', NULL, 3))
    AS t(modules, running_status, module_comment, old, row_no)
  QUALIFY row_number() OVER (PARTITION BY modules ORDER BY row_no) = 1
)"""


def module_count(name: str, where: str) -> str:
    return f"(SELECT count(*) FROM classed c WHERE c.module = p.module AND {where}) AS {name}_count"


STATS = f"""{RESULTS}, {CLASSED}, {MATRIX}, pairs AS (SELECT DISTINCT module, man FROM classed), stats AS (
  SELECT p.module, p.man, {run_state('(SELECT min(c.run_flag) FROM classed c WHERE c.module = p.module)')} AS running_status,
    COALESCE(replace(x.running_status, '"', ''), '-') AS matrix_status,
    COALESCE(replace(x.module_comment, '"', ''), '-') AS matrix_comment,
    COALESCE(replace(x.old, '"', ''), '-') AS matrix_old,
    CASE WHEN x.modules IS NULL THEN 0 ELSE COALESCE(n.n_regionkey % 2, 0) END AS direct_feed_status,
    {module_count('total', 'true')}, {module_count('error', "c.status IN ('Error', 'Proxy')")},
    {module_count('found', "c.status = 'found'")}, {module_count('expired', 'c.is_expired')},
    {module_count('recent', f"c.last_run_date >= {AS_OF} - 3")}
  FROM pairs p LEFT JOIN matrix x ON x.modules = p.module LEFT JOIN nation n ON n.n_name = p.man
)"""
ORACLE["watch_module_stats"] = f"""{STATS} SELECT *, {pct('error_count', 'total_count')} AS error_percentage,
  {pct('found_count', 'total_count')} AS found_percentage, {pct('expired_count', 'total_count')} AS expired_percentage,
  {pct('recent_count', 'total_count')} AS recent_percentage FROM stats"""
ORACLE["watch_validation"] = f"""{STATS}, sums AS (SELECT count(*) AS module_pairs,
    (SELECT count(*) FROM classed) AS total_parts,
    count(*) FILTER (WHERE running_status = 'Stopped') AS stopped_modules,
    {big("sum(total_count) FILTER (WHERE running_status = 'Stopped')")} AS stopped_parts,
    count(*) FILTER (WHERE matrix_status = 'Pending data team') AS pending_modules,
    {big("sum(total_count) FILTER (WHERE matrix_status = 'Pending data team')")} AS pending_parts,
    count(*) FILTER (WHERE direct_feed_status = 1) AS direct_feed_modules FROM stats
  ), shares AS (SELECT *, {pct('stopped_modules', 'module_pairs', empty='NULL')} AS stopped_modules_percentage,
    {pct('stopped_parts', 'total_parts', empty='NULL')} AS stopped_parts_percentage,
    {pct('pending_modules', 'module_pairs', empty='NULL')} AS pending_modules_percentage,
    {pct('pending_parts', 'total_parts', empty='NULL')} AS pending_parts_percentage,
    {pct('direct_feed_modules', 'module_pairs', empty='NULL')} AS direct_feed_modules_percentage FROM sums
  ), crit AS (SELECT *, round(stopped_parts_percentage + pending_parts_percentage + direct_feed_modules_percentage, 2)
    AS total_critical_percentage FROM shares)
  SELECT *, CASE WHEN total_critical_percentage > 10 THEN 'Rejected' WHEN total_critical_percentage IS NOT NULL
    THEN 'Accepted' END AS file_status FROM crit"""

FILE_ERRORS = "status IN ('Error', 'Exception', 'Proxy', 'Incomplete')"


def file_stats(source: str, grace: int) -> str:
    return f"""SELECT file, total_count, error_count, notfound_count, found_count,
    {pct('error_count', 'total_count')} AS error_percentage, {pct('found_count', 'total_count')} AS found_percentage,
    {pct('done_count', 'total_count')} AS done_percentage,
    {pct('error_done_count', 'done_count')} AS error_done_percentage FROM (
    SELECT file_name AS file, count(*) AS total_count, count(*) FILTER (WHERE {FILE_ERRORS}) AS error_count,
      count(*) FILTER (WHERE status = 'Not Found') AS notfound_count,
      count(*) FILTER (WHERE status = 'found') AS found_count,
      count(*) FILTER (WHERE last_run_date >= upload_date - {grace}) AS done_count,
      count(*) FILTER (WHERE last_run_date >= upload_date AND {FILE_ERRORS}) AS error_done_count
    FROM {source} GROUP BY file_name)"""


SIMPLE = f"simple AS (SELECT * REPLACE (COALESCE({simple_class('status')}, '-') AS status) FROM results)"
ORACLE["watch_file_stats_offset"] = f"{RESULTS}, {CLASSED} {file_stats('classed', 1)}"
ORACLE["watch_file_stats_daily"] = f"{RESULTS}, {SIMPLE} {file_stats('simple', 0)}"


def band(expression: str) -> str:
    return f"CASE WHEN {expression} < 40 THEN 'red' WHEN {expression} < 70 THEN 'orange' ELSE 'green' END"


ORACLE["watch_file_bands"] = f"""{RESULTS}, {SIMPLE}, s AS ({file_stats('simple', 0)}) SELECT *,
  {band('(100.0 - error_percentage)')} AS error_band, {band('found_percentage')} AS found_band,
  {band('done_percentage')} AS done_band, {band('(100.0 - error_done_percentage)')} AS error_done_band FROM s"""
ORACLE["watch_filter_options"] = f"""{RESULTS}, {CLASSED} SELECT DISTINCT option, value FROM (
  SELECT 'teams' AS option, module AS value FROM classed UNION ALL SELECT 'status', status FROM classed
  UNION ALL SELECT 'files', file_name FROM classed UNION ALL SELECT 'manufacturers', man FROM classed
  UNION ALL SELECT 'priorities', prty FROM classed UNION ALL SELECT 'table_name', table_name FROM classed)
  WHERE value IS NOT NULL"""
FED = "man IN (SELECT n_name FROM nation WHERE n_regionkey % 2 = 1)"
ORACLE["watch_filter_grouped"] = f"""{GROUPED} SELECT * FROM cube9 WHERE module IN ('1-URGENT', '2-HIGH',
  '4-NOT SPECIFIED') AND status IN ('SITE', 'Proxy', 'found', 'not run') AND is_expired
  AND last_run_date BETWEEN DATE '1996-01-01' AND DATE '2000-06-30' AND run_flag IN (0, 3, 4) AND {FED}"""
ORACLE["watch_filter_rows"] = f"""{RESULTS}, {CLASSED} SELECT id, part, man, module, status_orig AS status, prty,
  table_name, file_name FROM classed WHERE {simple_class('status_orig')} IN ('Proxy', 'Error', 'found')
  AND prty IN ('P0', 'P2', '-') AND table_name IN ('found', '-')
  AND man IN (SELECT 'NATION_' || CAST(i AS VARCHAR) FROM range(0, 15) AS r(i)) AND NOT ({FED})"""
for _name, _end in {
    "day": "DATE '1999-02-01'", "month": "DATE '1999-02-28'", "quarter": "DATE '1999-04-30'", "year": "DATE '2000-01-31'",
}.items():
    ORACLE[f"watch_status_by_date_{_name}"] = f"""{RESULTS}, {CLASSED} SELECT status, count(*) AS value FROM classed
      WHERE last_run_date >= DATE '1999-01-31' AND last_run_date < {_end} GROUP BY status"""
ORACLE["watch_upload_list"] = f"""WITH {PARTS}, named AS (SELECT module, CASE WHEN module = '1-URGENT'
  THEN 'http://parts/' || part WHEN status <> 'F' THEN part END AS part FROM parts)
  SELECT part AS "Part", module AS "Module", CASE WHEN part LIKE '%http%' THEN 'P0' WHEN part IS NOT NULL THEN 'P1'
  END AS "Prty" FROM named"""
ORACLE["watch_expired_upload_list"] = f"""{RESULTS} SELECT part AS "Part", module AS "Module", 'P1' AS "Prty"
  FROM results WHERE is_expired"""
ORACLE["watch_slice_page"] = f"""{RESULTS} SELECT id, part, module, status FROM results
  QUALIFY row_number() OVER (ORDER BY id) BETWEEN 26 AND 125"""
ORACLE["watch_slice_far"] = f"""{RESULTS} SELECT id, part, module, status FROM results
  QUALIFY row_number() OVER (ORDER BY module, id) BETWEEN 501 AND 7000"""
ORACLE["watch_slice_pages"] = f"""{RESULTS} SELECT id, part, module, status,
  CASE WHEN n <= 100 THEN 'first' ELSE 'middle' END AS page FROM (
    SELECT *, row_number() OVER (ORDER BY module, id) AS n FROM results)
  WHERE n <= 100 OR n BETWEEN 701 AND 1200"""
ORACLE["watch_download_filtered"] = ORACLE["watch_filter_rows"]
ORACLE["registry_download_filtered"] = f"""SELECT man_name, module_name, prty, status, lr_date, "count" FROM (
  {ORACLE["registry_filter_word_label"]})"""
ORACLE["summary_export"] = "SELECT summary_date AS date, " + " + ".join(f'"{bucket}"' for bucket in BUCKETS) + f""" AS n
  FROM ({ORACLE["summary_history"]})"""
ORACLE["run_export_copies"] = f"""{RESULTS} SELECT id, part, man, nullif(status, '') AS status, file_name,
  last_run_date, '2001-06-01__06_05_04' AS run_at, place FROM results, (VALUES ('own'), ('shared')) AS v(place)"""
ORACLE["direct_feed_flag"] = f"""{RESULTS} SELECT id, man, module, CASE WHEN {FED} THEN 1 ELSE 0 END AS direct_feed
  FROM results"""

# Scalar rules --------------------------------------------------------------

ORACLE["classify_error"] = f"""WITH f AS (SELECT status AS txt, CASE WHEN mod_id = 0 THEN 'found' WHEN mod_id < 3
  THEN 'not found' END AS st FROM ({feed('l_suppkey', 'l_partkey % 5')}))
  SELECT {error_class('txt', 'st')} AS "class", count(*) AS n FROM f GROUP BY 1"""
ORACLE["classify_watch"] = f"""WITH {PARTS}, {CHECKED} SELECT id, {watch_class('status')} AS "class" FROM checked"""
ORACLE["classify_simple"] = f"""WITH {PARTS}, {CHECKED} SELECT id, COALESCE({simple_class('status')}, '-') AS "class"
  FROM checked"""
ORACLE["classify_documents"] = f"""SELECT doc_id, {watch_class('text')} AS watch,
  md5(COALESCE({simple_class('text')}, '-')) AS simple, COALESCE({simple_class('text')} <> text, false) AS flagged
  FROM documents"""
ORACLE["classify_running"] = f"""WITH {REG}, {DIMS} SELECT {run_state('run_flag')} AS running_status, count(*) AS n
  FROM reg JOIN dims USING (man_id, mod_id) GROUP BY 1"""
ORACLE["classify_registry_dates"] = f"""WITH {REG}, s AS (SELECT CASE WHEN v_notfound_dat2 > lrd2 THEN 'not found'
    WHEN lrd2 > v_notfound_dat2 THEN 'found' WHEN lrd2 = DATE '1970-01-01' THEN 'not run' END AS status,
    CASE WHEN v_notfound_dat2 > lrd2 THEN v_notfound_dat2 WHEN lrd2 > v_notfound_dat2 THEN lrd2 END AS lr_date FROM reg)
  SELECT status, lr_date, (lr_date IS NULL OR lr_date < {AS_OF} - 30) AS is_expired, count(*) AS n FROM s GROUP BY ALL"""
ORACLE["label_one_hot"] = f"""WITH {REG}, g AS (SELECT cs, count(*) AS n FROM reg GROUP BY cs), s AS (
  SELECT cs, n, list_filter(list_transform(string_split(COALESCE(cs, ''), '|'), lambda x: trim(x)), lambda x: x <> '') AS l
  FROM g) SELECT cs, n, CASE WHEN len(l) = 0 THEN '' WHEN l[1] = l[2] THEN l[1] || ',' || l[3]
    ELSE l[1] || ',' || l[2] || ',' || l[3] END AS labels,
  CASE WHEN list_contains(l, 'red') THEN 1 ELSE 0 END AS cs_red,
  CASE WHEN list_contains(l, 'Brand#2') THEN 1 ELSE 0 END AS cs_brand_2 FROM s"""
UPLOADED = "DATE '1996-01-01' + CAST(o_custkey % 1500 AS INTEGER)"
ORACLE["date_rules"] = f"""SELECT o_orderkey AS id, CASE WHEN o_orderstatus IN ('P', 'F') THEN CAST(o_orderdate AS DATE)
  END AS parsed, CASE WHEN o_orderkey % 24 = 0 THEN '00_AM' ELSE
    strftime(TIMESTAMP '2000-01-01 00:00:00' + to_hours(CAST(o_orderkey % 24 AS INTEGER)), '%I_%p') END AS slot,
  'list_' || CAST(o_custkey AS VARCHAR) || '@2001-06-01.txt' AS file_name,
  CAST(o_orderdate AS DATE) >= {UPLOADED} - 1 AS done_with_grace, CAST(o_orderdate AS DATE) >= {UPLOADED} AS done
  FROM orders"""

# Reconciliation ------------------------------------------------------------

EVENT_KEY = """CASE WHEN user_id % 50 <> 0 THEN 'U' || CAST(user_id AS VARCHAR) END AS mpn,
  'M' || CAST(user_id % 5 AS VARCHAR) AS man, 'X' || CAST(user_id % 3 AS VARCHAR) AS module"""
IMPORT_TEXT = """(['In Progress', 'Not Imported - duplicate', 'Imported', 'Done'])[CAST(floor(value) AS INTEGER) % 5 + 1]"""


def side_feed(event: str, not_imported: str) -> str:
    return f"""SELECT DISTINCT ON (date, mpn, man, module) * FROM (
    SELECT {EVENT_KEY}, CAST(ts AS DATE) AS date, {IMPORT_TEXT} AS raw, CASE WHEN raw = 'In Progress' THEN 1
      WHEN contains(raw, 'Not Imported') THEN {not_imported} WHEN raw IS NOT NULL THEN 3 ELSE 4 END AS pos
    FROM events WHERE event_type = '{event}' AND value >= 0.5)
    ORDER BY date, mpn, man, module, pos"""


def side(table: str, feed_name: str, outcome: str) -> str:
    return f"""SELECT COALESCE(f.date, d.date) AS date, COALESCE(f.mpn, d.mpn) AS mpn, COALESCE(f.man, d.man) AS man,
    COALESCE(f.module, d.module) AS module, '{table}' AS "table", f.date IS NOT NULL AS in_feed,
    d.date IS NOT NULL AS in_details, f.pos, f.raw, d.status AS details_status
  FROM {feed_name} f FULL OUTER JOIN (SELECT * FROM det WHERE outcome = '{outcome}') d
    ON f.date = d.date AND f.mpn IS NOT DISTINCT FROM d.mpn AND f.man = d.man AND f.module = d.module"""


RECON = f"""WITH ff AS ({side_feed('view', '2')}), nf AS ({side_feed('signup', '3')}), det AS (
  SELECT *, CASE WHEN lower(status) = 'found' THEN 'found' ELSE 'not found' END AS outcome FROM (
    SELECT {EVENT_KEY}, CAST(ts AS DATE) AS date,
      (['Found', 'not found', 'FOUND'])[CAST(event_id % 4 AS INTEGER) + 1] AS status
    FROM events WHERE event_type IN ('click', 'purchase', 'error') AND value >= 1)
  QUALIFY row_number() OVER (PARTITION BY date, mpn, man, module
    ORDER BY CASE WHEN lower(status) = 'found' THEN 0 ELSE 1 END, status NULLS FIRST) = 1
), both_tables AS ({side('found', 'ff', 'found')} UNION ALL {side('notfound', 'nf', 'not found')}), matched AS (
  SELECT date, mpn, man, module, "table", in_feed, in_details,
    CASE WHEN in_feed AND in_details THEN 'both' WHEN in_feed THEN 'left_only' ELSE 'right_only' END AS provenance,
    CASE WHEN in_feed AND in_details THEN 'received' WHEN in_details THEN 'not received' END AS received,
    CASE WHEN NOT in_feed OR raw IS NULL THEN '' WHEN raw = 'In Progress' THEN 'In Progress'
      WHEN "table" = 'found' AND contains(raw, 'Not Imported') THEN 'Not Imported' ELSE 'Imported' END AS auto_imp_status,
    details_status FROM both_tables
), days AS (SELECT DISTINCT date FROM det WHERE date IN (SELECT date FROM ff)), report AS (
  SELECT mpn AS part_number, module AS module_name, details_status AS status,
    CASE WHEN auto_imp_status = '' THEN 'NotReceived' ELSE auto_imp_status END AS auto_import_status, received,
    (CASE WHEN auto_imp_status = '' THEN 'NotReceived' ELSE auto_imp_status END)
      || (CASE WHEN "table" = 'found' THEN ' found' ELSE ' NotFound' END) AS category, date
  FROM matched WHERE date IN (SELECT date FROM days)
)"""
REPORT_COLUMNS = "part_number, module_name, status, auto_import_status, category, date"
MISSED = "(auto_import_status = 'In Progress' AND received = 'received') OR received = 'not received'"
ORACLE["recon_join"] = f"{RECON} SELECT * FROM matched"
ORACLE["recon_report"] = f"{RECON} SELECT * FROM report"
ORACLE["recon_imported"] = f"""{RECON} SELECT {REPORT_COLUMNS} FROM report
  WHERE auto_import_status IN ('Imported', 'Not Imported') AND received = 'received'"""
ORACLE["recon_missed"] = f"{RECON} SELECT {REPORT_COLUMNS} FROM report WHERE {MISSED}"
ORACLE["recon_reports_between"] = f"""{RECON} SELECT {REPORT_COLUMNS}, date AS report_date FROM report WHERE ({MISSED})
  AND date BETWEEN DATE '2024-01-10' AND DATE '2024-01-15'"""
COUNTS = f"""{RECON}, counts AS (SELECT d.date, t."table",
    count(m.man) FILTER (WHERE m.in_details) AS total_parts,
    count(m.man) FILTER (WHERE m.received = 'received') AS received_count,
    count(m.man) FILTER (WHERE m.auto_imp_status = 'Imported') AS imported_count,
    count(m.man) FILTER (WHERE m.auto_imp_status = 'Not Imported') AS not_imported_count,
    count(m.man) FILTER (WHERE m.auto_imp_status = 'In Progress') AS in_progress_count,
    count(m.man) FILTER (WHERE m.received = 'not received') AS not_received_count
  FROM days d CROSS JOIN (VALUES ('found'), ('notfound')) AS t("table")
  LEFT JOIN matched m ON m.date = d.date AND m."table" = t."table" GROUP BY d.date, t."table"), reported AS (
  SELECT * FROM counts WHERE not_received_count <> total_parts)"""
ORACLE["recon_counts"] = f"{COUNTS} SELECT * FROM reported"
ORACLE["recon_pivot"] = f"""{COUNTS} SELECT date,
  {big("max(in_progress_count) FILTER (WHERE \"table\" = 'found')")} AS in_progress_found,
  {big("max(not_received_count) FILTER (WHERE \"table\" = 'found')")} AS not_received_found,
  {big("max(in_progress_count) FILTER (WHERE \"table\" = 'notfound')")} AS in_progress_not_found,
  {big("max(not_received_count) FILTER (WHERE \"table\" = 'notfound')")} AS not_received_not_found
  FROM reported GROUP BY date"""

# One file a day: its day is the first date of its parts in order, where a third of the users give none and others
# give the day after.
FILE_DAYS = """file_days AS (SELECT day, first(sys_date ORDER BY no_mpn, mpn, man, module) AS date FROM (
    SELECT DISTINCT CAST(ts AS DATE) AS day, user_id % 50 = 0 AS no_mpn, 'U' || CAST(user_id AS VARCHAR) AS mpn,
      'M' || CAST(user_id % 5 AS VARCHAR) AS man, 'X' || CAST(user_id % 3 AS VARCHAR) AS module,
      CASE WHEN user_id % 7 = 0 THEN CAST(ts AS DATE) + 1 ELSE CAST(ts AS DATE) END AS sys_date
    FROM events WHERE event_type IN ('click', 'purchase', 'error') AND value >= 1 AND user_id % 3 <> 0) GROUP BY day)"""
ORACLE["recon_file_days"] = ORACLE["recon_counts"].replace("WITH ff AS", f"WITH {FILE_DAYS}, ff AS", 1).replace(
    """CAST(ts AS DATE) AS date,
      (['Found', 'not found', 'FOUND'])[CAST(event_id % 4 AS INTEGER) + 1] AS status
    FROM events WHERE""",
    """file_days.date AS date, CASE WHEN event_id % 4 IN (0, 2) THEN 'Found' ELSE 'no' END AS status
    FROM events JOIN file_days ON CAST(ts AS DATE) = file_days.day WHERE""",
)

# Calendar and retention ----------------------------------------------------

DAY = "CAST(o_orderdate AS DATE)"
ORACLE["calendar_gaps"] = f"""SELECT CAST(d AS DATE) AS date FROM (SELECT unnest(generate_series(
  TIMESTAMP '1995-01-01', TIMESTAMP '2001-08-01', INTERVAL 1 DAY)) AS d)
  WHERE CAST(d AS DATE) NOT IN (SELECT {DAY} FROM orders)"""
ORACLE["calendar_day_members"] = """SELECT event_id, CAST(ts AS DATE) AS date FROM events
  WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-10'"""
ORACLE["expected_exports"] = f"""SELECT d AS date, 'Export_' || t || 'Feed_' || strftime(d, '%d-%b-%Y') || '_00_AM.txt'
  AS file_name FROM (SELECT DISTINCT {DAY} AS d FROM orders),
  (VALUES ('NotFound_'), ('')) AS v(t)"""
ORACLE["retention_survivors"] = f"""SELECT o_orderkey, {DAY} AS download_date FROM orders
  QUALIFY dense_rank() OVER (ORDER BY {DAY} DESC) <= 7"""
ORACLE["retention_names"] = f"""WITH n AS (SELECT DISTINCT CASE o_orderkey WHEN 3 THEN 'snapshot_latest.csv'
    WHEN 4 THEN 'snapshot_bad-name.csv' ELSE 'snapshot_' || strftime({DAY}, '%Y-%m-%d') || '.csv' END AS file_name
  FROM orders), r AS (SELECT file_name, regexp_matches(file_name, '^snapshot_[0-9-]+[.]csv$') AS dated,
    rank() OVER (PARTITION BY regexp_matches(file_name, '^snapshot_[0-9-]+[.]csv$') ORDER BY file_name DESC) AS rk FROM n)
  SELECT file_name FROM r WHERE NOT dated OR rk <= 7"""
ORACLE["newest_snapshot"] = f"""SELECT o_orderkey, {DAY} AS download_date,
  o_orderdate <= TIMESTAMP '2001-08-02 06:00:00' - INTERVAL 24 HOUR AS stale FROM orders
  WHERE {DAY} = (SELECT max({DAY}) FROM orders)"""
ORACLE["snapshot_store"] = f"""{SNAP} SELECT man_name, module_name, prty, status, lr_date, "count",
  DATE '2001-06-02' AS download_date, false AS stale FROM snap"""
# Labels are left out of the stored snapshot, so its rows group without them.
ORACLE["snapshot_store"] = f"""{SNAP.replace('prty, cs, lc_outdated, lrd2', 'prty, NULL AS cs, lc_outdated, lrd2')}
  SELECT man_name, module_name, prty, status, lr_date, "count", DATE '2001-06-02' AS download_date, false AS stale
  FROM snap"""
ORACLE["snapshot_refreshed"] = f"""{ORACLE["registry_table"].replace(" FROM snap GROUP BY", ", step, built FROM snap, "
  "(VALUES (1, 1), (2, 1), (3, 3), (4, 3)) AS v(step, built) GROUP BY")}, step, built"""
ORACLE["snapshot_refreshed"] = f"SELECT *, step = 4 AS stale FROM ({ORACLE['snapshot_refreshed']})"
SLOT = "strftime(ts, '%d-%b-%Y_%I_%p')"
ORACLE["report_slots"] = f"""SELECT DISTINCT {SLOT} AS slot, CAST(ts AS DATE) AS report_date,
  CAST(hour(ts) AS INTEGER) AS report_hour FROM events WHERE event_type NOT IN ('view', 'error')"""
ORACLE["report_days"] = "SELECT DISTINCT CAST(ts AS DATE) AS report_date FROM events"

# Ingest and files ----------------------------------------------------------

ORACLE["ingest_new_files"] = """SELECT c_name AS file_name FROM customer WHERE c_name = 'Customer#000000001'
  OR NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')"""
ORACLE["ingest_register"] = """SELECT c_name AS file_name, DATE '2001-06-01' AS upload_date, count(*) AS rows,
  count(*) AS ids FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_name"""
ORACLE["cascade_delete"] = """SELECT 'file' AS kind, c_custkey AS id FROM customer WHERE c_name <> 'Customer#000000007'
  UNION ALL SELECT 'part', o_orderkey FROM orders WHERE o_custkey NOT IN
  (SELECT c_custkey FROM customer WHERE c_name = 'Customer#000000007')"""
ORACLE["ingest_watchlists"] = f"""WITH {PARTS} SELECT part, man, module, CAST(NULL AS VARCHAR) AS status,
  CAST(NULL AS VARCHAR) AS cm_date, CAST(NULL AS DATE) AS last_run_date, CAST(NULL AS VARCHAR) AS table_name,
  CAST(NULL AS VARCHAR) AS features, CAST(NULL AS VARCHAR) AS monitor_features FROM parts"""
# Layout of a part by its id; the columns that the layout has.
MIXED = {
    "status": (1, 2, 4), "cm_date": (2, 3), "last_run_date": (1, 2), "table_name": (2, 4), "features": (2, 3),
    "monitor_features": (2, 4),
}
ORACLE["ingest_mixed_watchlists"] = f"""WITH {PARTS} SELECT part, man, module, {", ".join(
    f"CASE WHEN id % 8 IN {layouts} THEN {name} END AS {name}" for name, layouts in MIXED.items()
)} FROM parts WHERE id % 8 < 5"""
ORACLE["watchlist_problems"] = """SELECT * FROM (VALUES ('part,man', 'too few leading columns', 5),
  ('part,man,module,STATUS,NOTE', 'unknown column', 6), ('part,man,module,NOTE,STATUS', 'too many leading columns', 7))
  AS v(header, problem, layout) SEMI JOIN (SELECT o_orderkey % 8 AS layout FROM orders) USING (layout)"""
ORACLE["watchlist_problems"] = f"SELECT header, problem FROM ({ORACLE['watchlist_problems']})"
ORACLE["folder_files"] = """SELECT DISTINCT 'segment=' || c_mktsegment || '.txt' AS file_name FROM customer
  WHERE c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING')"""
ORACLE["dimension_files"] = ORACLE["watch_module_stats"]
ORACLE["feed_surplus_fields"] = f"""SELECT {EVENT_KEY}, CASE WHEN value >= 0.5 THEN strftime(ts, '%Y-%m-%d') END
  AS check_date, {IMPORT_TEXT} AS auto_imp_status FROM events
  WHERE event_type = 'view' AND {IMPORT_TEXT} IS DISTINCT FROM 'Done'"""
ORACLE["drop_null_columns"] = f"WITH {PARTS} SELECT * EXCLUDE (prty, man_id, module_id) FROM parts"
ORACLE["upload_list_file"] = f"""WITH {PARTS} SELECT part AS "Part", module AS "Module", 'P1' AS "Prty" FROM parts"""
ORACLE["parts_versions"] = ORACLE["watch_merge_found"]

# Logs ----------------------------------------------------------------------

ACTIVITY = """log AS (SELECT ts AS "timestamp", 'user' || CAST(user_id AS VARCHAR) AS username,
  CASE event_type WHEN 'click' THEN 'LOGIN' WHEN 'error' THEN 'LOGIN_FAILED' WHEN 'view' THEN 'FILE_UPLOAD'
    WHEN 'signup' THEN 'PERMISSION_DENIED' ELSE 'RAW_DOWNLOAD' END AS action, props AS details,
  '10.0.0.' || CAST(user_id % 256 AS VARCHAR) AS ip_address FROM events)"""
FIGURES = """count(*) AS total_logs,
  count(*) FILTER (WHERE action LIKE '%FAILED%' OR action LIKE '%DENIED%') AS security_events"""
ORACLE["activity_security"] = f"""WITH {ACTIVITY} SELECT {FIGURES}, count(DISTINCT username) FILTER (
  WHERE action = 'LOGIN' AND "timestamp" > TIMESTAMP '2024-01-30 11:00:00') AS active_users FROM log"""
ORACLE["activity_active_users"] = f"""WITH {ACTIVITY} SELECT date_trunc('hour', "timestamp") AS hour, {FIGURES},
  count(DISTINCT username) FILTER (WHERE action = 'LOGIN') AS active_users FROM log GROUP BY 1"""
RECENT = """SELECT * FROM log ORDER BY "timestamp" DESC, username, action, details"""
ORACLE["activity_recent"] = f"WITH {ACTIVITY} {RECENT} LIMIT 50"
ORACLE["activity_kept"] = f"WITH {ACTIVITY} {RECENT} LIMIT 1000"
ORACLE["activity_appended"] = ORACLE["activity_kept"]
ORACLE["activity_appended_counts"] = f"WITH {ACTIVITY} SELECT action, count(*) AS n FROM log GROUP BY action"
ORACLE["activity_stream_hours"] = ORACLE["activity_active_users"]
PROCESS = """plog AS (SELECT ts, 'proc_' || CAST(user_id % 12 AS VARCHAR) AS parent_process,
  'job' || CAST(user_id % 3 AS VARCHAR) AS subject, event_type, value FROM events)"""
RUNS = f"""WITH {PROCESS}, marks AS (SELECT *, lead(ts) OVER w AS next_ts, lead(event_type) OVER w AS next_type FROM plog
    WHERE event_type IN ('click', 'purchase', 'error')
    WINDOW w AS (PARTITION BY parent_process, subject ORDER BY ts, event_type <> 'click', event_type)), runs AS (
  SELECT parent_process, subject, ts AS started, CASE WHEN next_type <> 'click' THEN next_ts END AS ended,
    CASE next_type WHEN 'purchase' THEN 'SUCCESS' WHEN 'error' THEN 'FAILED' ELSE 'UNFINISHED' END AS outcome,
    CASE WHEN next_type <> 'click' THEN epoch_us(next_ts) - epoch_us(ts) END AS micros
  FROM marks WHERE event_type = 'click')"""
ORACLE["process_runs"] = f"{RUNS} SELECT *, count(*) AS runs FROM runs GROUP BY ALL"
ORACLE["process_durations"] = f"""{RUNS} SELECT parent_process, subject, count(*) AS runs,
  count(*) FILTER (WHERE outcome = 'SUCCESS') AS succeeded, count(*) FILTER (WHERE outcome = 'FAILED') AS failed,
  count(*) FILTER (WHERE outcome = 'UNFINISHED') AS unfinished, {big('sum(micros)')} AS total_micros,
  {big('max(micros)')} AS longest_micros,
  {pct("count(*) FILTER (WHERE outcome = 'SUCCESS')", 'count(*)')} AS success_percentage
  FROM runs GROUP BY parent_process, subject"""
ORACLE["process_messages"] = f"""WITH {PROCESS} SELECT parent_process, CASE event_type WHEN 'click' THEN 'START'
  WHEN 'purchase' THEN 'END' WHEN 'error' THEN 'END' WHEN 'view' THEN 'STEP' ELSE 'INFO' END AS kind, count(*) AS value
  FROM plog GROUP BY 1, 2"""
ORACLE["process_log_files"] = ORACLE["process_messages"]
ORACLE["process_step_seconds"] = f"""WITH {PROCESS}, t AS (SELECT parent_process, CAST(value AS DECIMAL(18, 2)) AS s
  FROM plog WHERE event_type = 'signup') SELECT parent_process, count(*) AS timed_steps,
  CAST(sum(s) AS DECIMAL(28, 2)) AS total_seconds, max(s) AS longest_seconds FROM t GROUP BY parent_process"""
TRACE = """'Traceback "x",' || chr(10) || '  File ' || props || chr(13) || chr(10) || chr(10) || '"boom"'"""
ORACLE["process_log_details"] = f"""WITH t AS (SELECT 'proc_' || CAST(user_id % 12 AS VARCHAR) AS parent_process,
  COALESCE(CASE WHEN event_id % 3 = 0 THEN {TRACE} ELSE props END, '') AS details FROM events)
  SELECT parent_process, count(*) AS records, CAST(sum(length(details)) AS BIGINT) AS characters,
  count(*) FILTER (WHERE details LIKE '%' || chr(10) || chr(10) || '"boom"') AS whole FROM t GROUP BY parent_process"""
