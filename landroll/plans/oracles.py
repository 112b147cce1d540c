"""DuckDB SQL for every registered query, written independently of the Spark jobs."""

from __future__ import annotations

from landroll.plans.fixtures import portable

# ---- shared text --------------------------------------------------------------------------------

NUMERIC = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def number(column: str) -> str:
    return f"CASE WHEN regexp_matches(trim({column}), '{NUMERIC}') THEN TRY_CAST(trim({column}) AS DOUBLE) END"


def iso(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00'"


def trimmed(column: str) -> str:
    return rf"regexp_replace({column}, '^\s+|\s+$', '', 'g')"


def indian(value: str) -> str:
    """Group a number: the last three digits, then pairs."""
    fixed = f"CAST(CAST(abs({value}) AS DECIMAL(38,3)) AS VARCHAR)"
    whole = f"split_part({fixed}, '.', 1)"
    decimals = f"rtrim(split_part({fixed}, '.', 2), '0')"
    head = f"left({whole}, length({whole}) - 3)"
    pairs = rf"reverse(rtrim(regexp_replace(reverse({head}), '(\d\d)', '\1,', 'g'), ','))"
    return (
        f"CASE WHEN {value} IS NULL OR isnan(CAST({value} AS DOUBLE)) THEN '—' ELSE "
        f"CASE WHEN {value} < 0 THEN '-' ELSE '' END || "
        f"CASE WHEN length({whole}) > 3 THEN {pairs} || ',' || right({whole}, 3) ELSE {whole} END || "
        f"CASE WHEN {decimals} <> '' THEN '.' || {decimals} ELSE '' END END"
    )


LISTED = f"""listed AS (SELECT *, {number('latitude_in')} AS latitude, {number('longitude_in')} AS longitude
 FROM claims_v WHERE created_at IS NOT NULL)"""
SHOWN = LISTED + """,
shown AS (SELECT * REPLACE (CASE WHEN coalesce(status, '') = '' THEN 'Pending' ELSE status END AS status) FROM listed)"""
FOUND = """(contains(lower(coalesce(name, '')), 'ion_1') OR contains(lower(coalesce(village, '')), 'ion_1')
 OR contains(lower(coalesce(district, '')), 'ion_1'))"""
WANTED = SHOWN + f""",
wanted AS (SELECT * FROM shown WHERE {FOUND} AND state = 'ASIA' AND status = 'Approved')"""
POINTS = LISTED + """,
points AS (SELECT * FROM listed WHERE latitude IS NOT NULL AND latitude <> 0 AND NOT isnan(latitude)
 AND longitude IS NOT NULL AND longitude <> 0 AND NOT isnan(longitude))"""

MEASURES = [
    f"{stem}{part}"
    for stem in ("claimsReceived", "titlesDistributed", "pending", "rejected", "forestLand")
    for part in ("Individual", "Community", "Total")
    if (stem, part) != ("pending", "Total")
]

# Which measure each sheet's columns lead to, worked out by hand from the header texts; of two columns
# with one key the right-hand one counts.
SHEET_CELLS = {
    "A": {"claimsReceivedIndividual": "c2", "claimsReceivedCommunity": "c3", "claimsReceivedTotal": "c4"},
    "N": {
        "claimsReceivedIndividual": "c2", "claimsReceivedCommunity": "c3", "claimsReceivedTotal": "c4",
        "titlesDistributedIndividual": "c5", "pendingCommunity": "c6", "rejectedTotal": "c7",
        "forestLandTotal": "c8",
    },
    "R": {
        "claimsReceivedIndividual": "c2", "claimsReceivedCommunity": "c3", "claimsReceivedTotal": "c4",
        "titlesDistributedIndividual": "c8", "pendingCommunity": "c6", "rejectedTotal": "c7",
    },
    "F": {
        "titlesDistributedCommunity": "c2", "titlesDistributedTotal": "c3", "pendingIndividual": "c4", "rejectedIndividual": "c5",
        "rejectedCommunity": "c6", "forestLandIndividual": "c7", "forestLandCommunity": "c8",
    },
}


def dirty_number(column: str) -> str:
    return (
        f"CASE WHEN upper({trimmed(column)}) IN ('NA', 'NA/NR', 'NR', 'N/A', '-') THEN NULL "
        f"ELSE TRY_CAST(nullif(regexp_replace({column}, '[^0-9.\\-]', '', 'g'), '') AS DOUBLE) END"
    )


def measure(name: str) -> str:
    cells = " ".join(
        f"WHEN '{sheet}' THEN {dirty_number(cells[name])}" for sheet, cells in SHEET_CELLS.items() if name in cells
    )
    return f"CASE left(sheet_id, 1) {cells} END AS {name}" if cells else f"CAST(NULL AS DOUBLE) AS {name}"


BLANK_TEST = " AND ".join(f"{trimmed(f'coalesce(c{i}, {chr(39)*2})')} = ''" for i in range(9))
KEYED = f"""keyed AS (SELECT sheet_id, row_pos, {dirty_number('c0')} AS slNo, {trimmed("coalesce(c1, '')")} AS state,
 {', '.join(measure(m) for m in MEASURES)}
 FROM stats_sheet_v WHERE row_pos > 0 AND NOT ({BLANK_TEST}))"""


def total(stem: str) -> str:
    ind, com = f"{stem}Individual", f"{stem}Community"
    return (
        f"CASE WHEN {stem}Total IS NOT NULL THEN {stem}Total WHEN {ind} IS NULL AND {com} IS NULL THEN NULL "
        f"ELSE coalesce({ind}, 0) + coalesce({com}, 0) END AS {stem}Total"
    )


PERIOD_ORDER = """CAST(CASE sheet_id WHEN 'R-2' THEN 0 WHEN 'N-1' THEN 1
 ELSE CAST(split_part(sheet_id, '-', 2) AS INTEGER) + 2 END AS INTEGER)"""
STATES = KEYED + ",\nstates AS (SELECT * FROM keyed WHERE state <> '' AND lower(state) <> 'total')"
STATS = STATES + f""",
stats AS (SELECT * REPLACE ({total('claimsReceived')}, {total('titlesDistributed')}),
 CASE sheet_id WHEN 'N-1' THEN 'Period N' WHEN 'R-2' THEN 'Period R' ELSE sheet_id END AS label,
 CASE sheet_id WHEN 'N-1' THEN DATE '2024-06-30' WHEN 'R-2' THEN DATE '2023-10-31' END AS as_of,
 {PERIOD_ORDER} AS period_order FROM states)"""

SCREENED = """named AS (SELECT * FROM new_claims_v WHERE coalesce(name, '') <> ''),
firsts AS (SELECT raw_text, min(arrival) AS first_arrival FROM named WHERE coalesce(raw_text, '') <> '' GROUP BY raw_text),
screened AS (SELECT n.*, CASE WHEN coalesce(n.raw_text, '') = '' THEN 'accepted'
  WHEN n.raw_text IN (SELECT raw_text FROM ledger_texts_v) THEN 'duplicate'
  WHEN n.arrival = f.first_arrival THEN 'accepted' ELSE 'duplicate' END AS outcome
 FROM named n LEFT JOIN firsts f ON n.raw_text = f.raw_text)"""
ALREADY = "'This document has already been processed and saved.'"

LATEST = """latest AS (SELECT claim_id, status FROM (SELECT *, row_number() OVER (PARTITION BY claim_id
 ORDER BY ts DESC, event_id DESC) AS rn FROM status_updates_v WHERE coalesce(status, '') <> '') WHERE rn = 1)"""


# The patterns of form labels, coordinates and land areas below.
def field(label: str) -> str:
    found = rf"regexp_extract(raw_text, '(?i){label}[:\-]?\s*(.+)', 1)"
    return f"nullif({trimmed(found)}, '')"


def coordinate(group: int) -> str:
    return rf"nullif(regexp_extract(raw_text, '(?i)Coordinates[:\-]?\s*([\d\.-]+)\s*,\s*([\d\.-]+)', {group}), '')"


FIELDS = {
    "name": field(r"Name\s*of\s*Claimant"),
    "village": field("Village"),
    "district": field("District"),
    "state": field("State"),
    "claim_type": field(r"Claim\s*Type"),
    "status": field("Status"),
}
FORM = "form AS (SELECT doc_id, raw_text, " + ", ".join(f"{sql} AS {name}" for name, sql in FIELDS.items())
FORM += f", {coordinate(1)} AS latitude, {coordinate(2)} AS longitude FROM form_text_v)"

AREA = r"(\d+(\.\d+)?)\s*(hectares|hectare|acres|acre)"


def area(match: str, group: int) -> str:
    return f"coalesce(regexp_extract({match}, '(?i){AREA}', {group}), '')"


def js_number(value: str) -> str:
    return f"CASE WHEN {value} = floor({value}) THEN CAST(CAST({value} AS BIGINT) AS VARCHAR) ELSE CAST({value} AS VARCHAR) END"


def coordinate_text(axis: str) -> str:
    typed = number(f"{axis}_in")
    return f"coalesce(CASE WHEN {typed} <> 0 THEN {js_number(f'({typed})')} END, nullif({axis}_in, ''))"


def first_seen(facet: str) -> str:
    return f"""WITH {SHOWN} SELECT value, first_seen_at, first_seen_id FROM (
 SELECT {facet} AS value, created_at AS first_seen_at, id AS first_seen_id,
  row_number() OVER (PARTITION BY {facet} ORDER BY created_at DESC, id DESC) AS rn
 FROM shown WHERE coalesce({facet}, '') <> '') WHERE rn = 1"""


def or_text(column: str, default: str) -> str:
    return f"CASE WHEN coalesce({column}, '') = '' THEN '{default}' ELSE {column} END"


def joined(*columns: str) -> str:
    parts = ", ".join(f"nullif({c}, '')" for c in columns)
    return f"concat_ws(' · ', {parts})"


def counts(column: str, missing: str) -> str:
    return f"SELECT {or_text(column, missing)} AS {column}, count(*) AS n FROM listed GROUP BY 1"


# ---- one text per query -------------------------------------------------------------------------

ORACLES: dict[str, str] = {}

CLAIM = "id, name, village, district, state, claim_type, status, latitude_in, longitude_in, raw_text"
CLAIM_BUT_STATUS = CLAIM.replace(" status,", "")
ORACLES["claims_scan"] = f"SELECT {CLAIM}, created_at FROM claims_v WHERE created_at IS NOT NULL"
ORACLES["claims_sparse_json"] = f"""SELECT id, CAST(json_merge_patch('{{}}', to_json(struct_pack(id := id, name := name,
 village := village, district := district, state := state, claim_type := claim_type, status := status,
 latitude_in := latitude_in, longitude_in := longitude_in, raw_text := raw_text, created_at := {iso('created_at')}))) AS VARCHAR)
 AS json FROM claims_v"""
ORACLES["claims_serialized"] = f"WITH {LISTED} SELECT {CLAIM}, latitude, longitude, {iso('created_at')} AS created_at FROM listed"
ORACLES["claims_default_status"] = f"WITH {SHOWN} SELECT id, status FROM shown"
ORACLES["claims_search"] = f"WITH {SHOWN} SELECT {CLAIM}, created_at, latitude, longitude FROM shown WHERE {FOUND}"
ORACLES["claims_search_indexed"] = ORACLES["claims_search"]
ORACLES["claims_facet_filter"] = (
    f"WITH {SHOWN} SELECT {CLAIM}, created_at, latitude, longitude FROM shown WHERE state = 'ASIA' AND status = 'Approved'"
)
ORACLES["claims_search_facets"] = f"WITH {WANTED} SELECT {CLAIM}, created_at, latitude, longitude FROM wanted"
ORACLES["claim_by_id"] = f"SELECT {CLAIM}, created_at FROM claims_v WHERE id = '150'"
ORACLES["claims_coord_coerce"] = f"WITH {LISTED} SELECT id, latitude_in, longitude_in, latitude, longitude FROM listed"
ORACLES["ledger_rows"] = f"""WITH {SHOWN} SELECT id, {or_text('name', 'Unnamed claimant')} AS claimant,
 '#' || left(id, 8) AS short_id, {or_text('village', 'Village N/A')} AS village,
 {or_text(joined('district', 'state'), 'Location N/A')} AS location,
 {or_text('claim_type', 'Individual')} AS claim_type, {or_text('status', 'Pending')} AS status FROM shown"""
ORACLES["claim_detail_rows"] = f"""WITH c AS (SELECT *, {coordinate_text('latitude')} AS lat, {coordinate_text('longitude')} AS lon
 FROM claims_v) SELECT id, {or_text('name', 'Claim record')} AS title,
 {or_text(joined('village', 'district', 'state'), 'Location not recorded')} AS subtitle, '#' || left(id, 10) AS short_id,
 {or_text('claim_type', 'Individual')} AS type_chip, {or_text('status', 'Pending')} AS status_chip,
 {', '.join(f"{or_text(c, '—')} AS {c}" for c in ('name', 'village', 'district', 'state', 'claim_type'))},
 CASE WHEN lat IS NULL OR lon IS NULL THEN '—' ELSE lat || ', ' || lon END AS coordinates,
 {or_text('raw_text', 'No raw text available for this claim.')} AS raw_text FROM c"""
ORACLES["facet_states"] = first_seen("state")
ORACLES["facet_districts"] = first_seen("district")
ORACLES["facet_statuses"] = first_seen("status")
ORACLES["ledger_page"] = f"""WITH {WANTED} SELECT {CLAIM}, created_at, latitude, longitude FROM wanted
 ORDER BY created_at DESC, id DESC LIMIT 10 OFFSET 10"""
ORACLES["ledger_page_count"] = f"""WITH {WANTED} SELECT count(*) AS n_claims, CAST((count(*) + 9) // 10 AS BIGINT) AS n_pages
 FROM wanted"""
EXPORT = ", ".join(
    f"coalesce({c}, '')" for c in ("id", "name", "village", "district", "state", "status", "claim_type", iso("created_at"))
)
ORACLES["claims_export_lines"] = f"WITH {WANTED} SELECT concat_ws(',', {EXPORT}) AS line FROM wanted"

ORACLES["map_valid_claims"] = f"WITH {POINTS} SELECT id, latitude, longitude FROM points"
ORACLES["map_claim_color"] = f"""WITH {POINTS} SELECT id, claim_type, CASE claim_type WHEN 'IFR' THEN '#0d6efd'
 WHEN 'CR' THEN '#198754' WHEN 'CFR' THEN '#ffc107' ELSE '#6c757d' END AS color FROM points"""
ORACLES["map_claim_bbox"] = f"""WITH {POINTS} SELECT id,
 round(latitude - 0.01, 6) AS lat0, round(longitude - 0.01, 6) AS lon0,
 round(latitude + 0.01, 6) AS lat1, round(longitude - 0.01, 6) AS lon1,
 round(latitude + 0.01, 6) AS lat2, round(longitude + 0.01, 6) AS lon2,
 round(latitude - 0.01, 6) AS lat3, round(longitude + 0.01, 6) AS lon3 FROM points"""
ORACLES["map_popup"] = f"""WITH {POINTS} SELECT id,
 {', '.join(f"{or_text(c, 'N/A')} AS {c}" for c in ('name', 'village', 'district', 'claim_type', 'status'))} FROM points"""

ORACLES["dashboard_kpis"] = f"""WITH {LISTED} SELECT count(*) AS total_claims,
 count(*) FILTER (status = 'Pending') AS claims_in_review, count(*) FILTER (status = 'Approved') AS claims_approved FROM listed"""
ORACLES["claims_by_type"] = f"WITH {LISTED} {counts('claim_type', 'Unknown')}"
ORACLES["claims_by_status"] = f"WITH {LISTED} {counts('status', 'Pending')}"
ORACLES["claims_by_district"] = f"WITH {LISTED} {counts('district', 'Unknown')}"
ORACLES["claims_rollup"] = f"WITH {LISTED} " + " UNION ALL ".join(
    f"SELECT '{c}' AS dimension, {c} AS value, n FROM ({counts(c, missing)})"
    for c, missing in (("claim_type", "Unknown"), ("status", "Pending"), ("district", "Unknown"))
)
DAYS = "days AS (SELECT CAST(created_at AS DATE) AS day, count(*) AS n FROM claims_v WHERE created_at IS NOT NULL GROUP BY 1)"
ORACLES["claims_by_day"] = f"WITH {DAYS} SELECT day, n FROM days"
ORACLES["claims_cumulative"] = f"""WITH {DAYS} SELECT day, n, CAST(sum(n) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS BIGINT)
 AS running_total FROM days"""
ORACLES["claims_approval_rate"] = f"""WITH {LISTED}, t AS (SELECT count(*) AS n, count(*) FILTER (status = 'Approved') AS a FROM listed)
 SELECT n AS total_claims, a AS approved_claims, CASE WHEN n > 0 THEN round(a / n * 100, 1) ELSE 0.0 END AS approval_rate,
 CASE WHEN n > 0 THEN printf('%.1f', round(a / n * 100, 1)) ELSE '0' END AS approval_rate_text FROM t"""

ORACLES["claims_ingest_rejects"] = """SELECT arrival, name, 'Claimant name is required.' AS reject_reason FROM new_claims_v
 WHERE coalesce(name, '') = ''"""
ORACLES["ingest_first_wins"] = """SELECT arrival, name, raw_text FROM (SELECT *, row_number() OVER (PARTITION BY raw_text
 ORDER BY arrival) AS rn FROM new_claims_v WHERE coalesce(raw_text, '') <> '') WHERE rn = 1"""
ORACLES["ingest_dedup"] = f"WITH {SCREENED} SELECT arrival, name, raw_text FROM screened WHERE outcome = 'accepted'"
ORACLES["ingest_duplicates"] = (
    f"WITH {SCREENED} SELECT arrival, name, {ALREADY} AS reject_reason FROM screened WHERE outcome = 'duplicate'"
)
ORACLES["claims_ingest_accepted"] = f"""WITH {SCREENED} SELECT arrival, name, CAST(NULL AS VARCHAR) AS village,
 CAST(NULL AS VARCHAR) AS district, state, CAST(NULL AS VARCHAR) AS claim_type, CAST(NULL AS VARCHAR) AS status,
 CAST(NULL AS DOUBLE) AS latitude, CAST(NULL AS DOUBLE) AS longitude, raw_text, CAST(NULL AS VARCHAR) AS entities,
 TIMESTAMP '2024-01-01 00:00:00' AS created_at FROM screened WHERE outcome = 'accepted'"""
ORACLES["status_latest"] = f"WITH {LATEST} SELECT claim_id, status FROM latest"
ORACLES["status_apply"] = f"""WITH {LATEST} SELECT {CLAIM_BUT_STATUS}, coalesce(u.status, c.status) AS status, created_at
 FROM claims_v c LEFT JOIN latest u ON c.id = u.claim_id"""
STORED = f"""stored AS (SELECT id, name, village, district, state, claim_type, status, {number('latitude_in')} AS latitude,
 {number('longitude_in')} AS longitude, raw_text, created_at FROM claims_v)"""
ORACLES["status_write_back"] = f"""WITH {LATEST}, {STORED} SELECT s.* REPLACE (coalesce(u.status, s.status) AS status)
 FROM stored s LEFT JOIN latest u ON s.id = u.claim_id"""
ORACLES["ledger_deep_page"] = f"""WITH {STORED} SELECT * FROM stored WHERE created_at <= TIMESTAMP '1995-06-17 00:00:00'
 AND (created_at < TIMESTAMP '1995-06-17 00:00:00' OR id < '30000') ORDER BY created_at DESC, id DESC LIMIT 100"""
ORACLES["ingest_key_table"] = ORACLES["ingest_duplicates"]
ORACLES["ledger_batch_commit"] = f"""WITH {SCREENED} SELECT CAST(arrival AS VARCHAR) AS id, name, state, raw_text,
 TIMESTAMP '2024-01-01 00:00:00' AS created_at FROM screened WHERE outcome = 'accepted'"""
ORACLES["status_update_rejects"] = """SELECT event_id, claim_id, status, CASE WHEN coalesce(status, '') = ''
 THEN 'Status is required' ELSE 'Claim not found' END AS reject_reason FROM status_updates_v u
 WHERE coalesce(status, '') = '' OR NOT EXISTS (SELECT 1 FROM claims_v c WHERE c.id = u.claim_id)"""

CELLS = " UNION ALL ".join(
    f"SELECT sheet_id, row_pos, CAST({i} AS INTEGER) AS idx, c{i} AS cell FROM stats_sheet_v" for i in range(9)
)
NORMALIZED = r"regexp_replace(lower(regexp_replace(coalesce(cell, ''), '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g')"
ORACLES["stats_sheet_scan"] = "SELECT * FROM stats_sheet_v"
ORACLES["stats_header_norm"] = f"""SELECT sheet_id, idx, cell AS header, {NORMALIZED} AS normalized FROM ({CELLS})
 WHERE row_pos = 0"""
KEYS = " ".join(
    f"WHEN left(sheet_id, 1) = '{sheet}' AND idx = {int(cell[1:])} THEN '{name}'"
    for sheet, cells in SHEET_CELLS.items()
    for name, cell in cells.items()
)
ORACLES["stats_header_map"] = f"""SELECT sheet_id, idx, CASE WHEN idx = 0 THEN 'slNo' WHEN idx = 1 THEN 'state' {KEYS}
 WHEN left(sheet_id, 1) = 'R' AND idx = 5 THEN 'titlesDistributedIndividual' END AS key FROM ({CELLS}) WHERE row_pos = 0"""
ORACLES["stats_parse_number"] = f"""SELECT sheet_id, row_pos, idx, cell, {dirty_number('cell')} AS number FROM ({CELLS})
 WHERE row_pos > 0"""
ORACLES["stats_nonblank"] = f"SELECT sheet_id, row_pos FROM stats_sheet_v WHERE row_pos > 0 AND NOT ({BLANK_TEST})"
ORACLES["stats_keyed_rows"] = f"WITH {KEYED} SELECT * FROM keyed"
ORACLES["stats_clean_rows"] = f"WITH {STATES} SELECT sheet_id, row_pos, state FROM states"
ORACLES["stats_totals"] = f"""WITH {STATS} SELECT sheet_id, row_pos, claimsReceivedIndividual, claimsReceivedCommunity,
 claimsReceivedTotal, titlesDistributedIndividual, titlesDistributedCommunity, titlesDistributedTotal FROM stats"""
ORACLES["stats_period_meta"] = """SELECT sheet_id, CASE sheet_id WHEN 'N-1' THEN 'Period N' WHEN 'R-2' THEN 'Period R'
 ELSE sheet_id END AS label, CASE sheet_id WHEN 'N-1' THEN DATE '2024-06-30' WHEN 'R-2' THEN DATE '2023-10-31' END AS as_of,
 count(*) AS n_rows FROM stats_sheet_v WHERE row_pos > 0 GROUP BY 1, 2, 3"""
ORACLES["stats_period_order"] = f"""SELECT sheet_id, {PERIOD_ORDER}
 AS period_order, count(*) AS n_rows FROM stats_sheet_v WHERE row_pos > 0 GROUP BY 1, 2"""
ORACLES["stats_union_sheets"] = f"""WITH {STATES} SELECT sheet_id, row_pos, state, {', '.join(MEASURES)} FROM states"""
FIGURES = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in ("slNo", *MEASURES))
# Every sheet is a period, also one without states.
PERIODS = STATS + f""",
periods AS (SELECT sheet_id, CASE sheet_id WHEN 'N-1' THEN 'Period N' WHEN 'R-2' THEN 'Period R' ELSE sheet_id END AS label,
 CASE sheet_id WHEN 'N-1' THEN DATE '2024-06-30' WHEN 'R-2' THEN DATE '2023-10-31' END AS as_of, {PERIOD_ORDER} AS period_order FROM stats_names_v)"""
ORACLES["stats_json_nest"] = f"""WITH {PERIODS} SELECT 'workbook' AS source, p.sheet_id AS id, p.label, CAST(p.as_of AS VARCHAR) AS "asOf",
 p.period_order AS position, CAST(count(s.sheet_id) AS INTEGER) AS n_rows, arg_min(state, row_pos) AS first_state,
 arg_max(state, row_pos) AS last_state, coalesce(string_agg(state, '|' ORDER BY row_pos), '') AS states,
 coalesce(string_agg(concat_ws(',', {FIGURES}), '|' ORDER BY row_pos) FILTER (s.sheet_id IS NOT NULL), '') AS figures
 FROM periods p LEFT JOIN stats s ON s.sheet_id = p.sheet_id GROUP BY p.sheet_id, p.label, p.as_of, p.period_order"""
# A row ends at its last cell that is not null; one without the right-hand column of a key keeps the cell of the left-hand one.
TITLES = "titlesDistributedIndividual"
SHORT_TITLES = f"""CASE WHEN left(sheet_id, 1) = 'R' AND c8 IS NULL THEN {dirty_number('c5')}
 ELSE {measure(TITLES).removesuffix(f' AS {TITLES}')} END AS {TITLES}"""
ORACLES["stats_workbook_files"] = f"""WITH {STATS.replace(measure(TITLES), SHORT_TITLES)}
 SELECT sheet_id, row_pos, state, slNo, {', '.join(MEASURES)}, label, as_of, period_order FROM stats"""
ORACLES["stats_json_flatten"] = f"""WITH {STATS} SELECT 'workbook' AS source, * REPLACE (
 row_number() OVER (PARTITION BY sheet_id ORDER BY row_pos) - 1 AS row_pos) FROM stats"""
# In one document a period's place is its place in the list.
ORACLES["stats_json_document"] = f"""WITH {PERIODS}, places AS (SELECT sheet_id, CAST(row_number() OVER (ORDER BY period_order) - 1 AS INTEGER) AS place FROM periods)
 SELECT 'workbook' AS source, place AS period_order,
 s.sheet_id, label, as_of, row_number() OVER (PARTITION BY s.sheet_id ORDER BY row_pos) - 1 AS row_pos, slNo, state, {', '.join(MEASURES)}
 FROM stats s JOIN places p ON p.sheet_id = s.sheet_id"""

ORACLES["stats_sum_field"] = f"""WITH {PERIODS} SELECT p.sheet_id, coalesce(sum(claimsReceivedIndividual), 0) AS total
 FROM periods p LEFT JOIN stats s ON s.sheet_id = p.sheet_id GROUP BY p.sheet_id"""
ORACLES["stats_kpis"] = f"""WITH {PERIODS}, k AS (SELECT p.sheet_id, coalesce(sum(claimsReceivedTotal), 0) AS claims,
 coalesce(sum(titlesDistributedTotal), 0) AS titles, count(s.sheet_id) AS states FROM periods p LEFT JOIN stats s ON s.sheet_id = p.sheet_id GROUP BY p.sheet_id),
 r AS (SELECT *, CASE WHEN claims > 0 THEN titles / claims * 100 END AS x FROM k)
 SELECT sheet_id, claims, titles, states, round(x, 6) AS rate, {indian('claims')} AS claims_text, {indian('titles')} AS titles_text,
 {indian('states')} AS states_text, CASE WHEN x IS NULL THEN '—' ELSE printf('%.1f', round(x, 1)) || '%' END AS rate_text FROM r"""
ORACLES["stats_available_measures"] = f"""WITH {PERIODS} SELECT p.sheet_id, bool_or(rejectedTotal IS NOT NULL) AS has_rejected,
 bool_or(pendingIndividual IS NOT NULL OR pendingCommunity IS NOT NULL) AS has_pending,
 bool_or(forestLandTotal IS NOT NULL) AS has_forest_land FROM periods p LEFT JOIN stats s ON s.sheet_id = p.sheet_id GROUP BY p.sheet_id"""
ORACLES["stats_load_summary"] = f"""WITH {PERIODS} SELECT (SELECT count(*) FROM stats) AS state_rows, count(*) AS periods FROM periods"""
ORACLES["stats_sorted"] = f"""WITH {STATS} SELECT sheet_id, state, claimsReceivedTotal,
 row_number() OVER (PARTITION BY sheet_id ORDER BY claimsReceivedTotal DESC NULLS LAST, row_pos) AS rank_pos,
 row_number() OVER (PARTITION BY sheet_id ORDER BY lower(state), row_pos) AS state_rank_pos FROM stats"""
ORACLES["stats_top10"] = f"""WITH {STATS} SELECT state, coalesce(claimsReceivedTotal, 0) AS claims,
 coalesce(titlesDistributedTotal, 0) AS titles FROM stats WHERE sheet_id = 'N-1'
 ORDER BY coalesce(claimsReceivedTotal, 0) DESC, row_pos LIMIT 10"""
ORACLES["stats_focus_flag"] = f"""WITH {STATS} SELECT sheet_id, row_pos, state,
 state IN ('NATION_1', 'NATION_9', 'NATION_14', 'NATION_16') AS is_focus FROM stats"""
ORACLES["stats_period_pick"] = f"""WITH {STATS} SELECT 'N-1' AS wanted, sheet_id, label, state FROM stats WHERE sheet_id = 'N-1'
 UNION ALL SELECT 'ZZ' AS wanted, sheet_id, label, state FROM stats
 WHERE period_order = (SELECT min(period_order) FROM stats)"""


def pair(stem: str) -> str:
    return f"'I ' || {indian(stem + 'Individual')} || ' · C ' || {indian(stem + 'Community')}"


ORACLES["stats_table_rows"] = f"""WITH {STATS} SELECT sheet_id, row_pos, state,
 {indian('claimsReceivedTotal')} AS claims_text, {pair('claimsReceived')} AS claims_parts,
 {indian('titlesDistributedTotal')} AS titles_text, {pair('titlesDistributed')} AS titles_parts,
 CASE WHEN count(coalesce(pendingIndividual, pendingCommunity)) OVER p > 0 THEN
  {indian('pendingIndividual')} || ' / ' || {indian('pendingCommunity')} END AS pending_text,
 CASE WHEN count(rejectedTotal) OVER p > 0 THEN {indian('rejectedTotal')} END AS rejected_text,
 CASE WHEN count(forestLandTotal) OVER p > 0 THEN {indian('forestLandTotal')} END AS forest_land_text
 FROM stats WINDOW p AS (PARTITION BY sheet_id)"""
ORACLES["fmt_indian_number"] = f"""WITH v AS (SELECT o_orderkey, round(o_totalprice * 1000) / 8 AS a, -floor(o_totalprice / 7) AS b,
 CASE WHEN o_orderkey % 3 <> 0 THEN floor(o_totalprice / 1000) END AS c FROM {{orders}})
 SELECT o_orderkey, {indian('a')} AS large, {indian('b')} AS whole, {indian('c')} AS short FROM v"""

ORACLES["doc_ext_filter"] = r"""WITH x AS (SELECT page_id, url,
 lower(regexp_extract(url, '(?:^|/)\.*[^/.][^/]*(\.[^./]*)$', 1)) AS extension FROM {pages})
 SELECT page_id, url, extension, CASE WHEN coalesce(url, '') = '' THEN 'No selected file'
 WHEN extension <> '.html' THEN 'Invalid file type.' END AS reject_reason FROM x"""
ORACLES["doc_text_assembly"] = """SELECT conv_id,
 string_agg(coalesce(text, '') || chr(10), '' ORDER BY turn, text) AS raw_text FROM {conversations} GROUP BY 1"""
ORACLES["doc_text_fallback"] = f"""WITH t AS (SELECT doc_id, CASE WHEN primary_error IS NULL THEN primary_text ELSE fallback_text END AS x
 FROM engine_outputs_v), b AS (SELECT *, coalesce({trimmed('x')}, '') = '' AS blank FROM t)
 SELECT doc_id, CASE WHEN NOT blank THEN x END AS raw_text,
 CASE WHEN blank THEN 'Failed to extract any text from the document.' END AS reject_reason FROM b"""
ORACLES["form_fields"] = f"WITH {FORM} SELECT doc_id, name, village, district, state, claim_type, status FROM form"
ORACLES["form_coordinates"] = f"WITH {FORM} SELECT doc_id, latitude, longitude FROM form"
ORACLES["form_nested_json"] = f"""WITH {FORM} SELECT doc_id, CAST(to_json(struct_pack(
 claimant_info := struct_pack(name := name, village := village, district := district, state := state),
 claim_details := struct_pack("type" := claim_type, status := status),
 geographical_info := struct_pack(coordinates := struct_pack(latitude := latitude, longitude := longitude)),
 raw_text := raw_text)) AS VARCHAR) AS json FROM form"""
ORACLES["land_areas"] = f"""WITH m AS (SELECT doc_id, regexp_extract_all(raw_text, '(?i){AREA}') AS ms FROM form_text_v)
 SELECT doc_id, CAST(len(ms) AS INTEGER) AS n_areas,
 coalesce(array_to_string(list_transform(ms, lambda x: {area('x', 1)} || ' ' || {area('x', 2)} || ' ' || {area('x', 3)}), '|'), '')
 AS land_area,
 coalesce(array_to_string(list_transform(ms, lambda x: CAST(CAST({area('x', 1)} AS DOUBLE) AS VARCHAR) || ' ' || lower({area('x', 3)})),
 '|'), '') AS areas FROM m"""


def spans(labels: str) -> str:
    return f"coalesce(string_agg(text, '|' ORDER BY pos, text) FILTER (label IN ({labels})), '')"


PLACES = """places AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY pos, text) AS rn FROM spans_v
 WHERE label IN ('GPE', 'LOC') AND lower(text) NOT IN ('india', 'state', 'district', 'village'))"""
ORACLES["entity_buckets"] = f"""SELECT doc_id, {spans("'PERSON'")} AS persons,
 {spans("'GPE', 'LOC'")} AS locations, {spans("'DATE'")} AS dates, {spans("'ORG'")} AS organizations FROM spans_v GROUP BY 1"""
ORACLES["entity_places"] = f"""WITH {PLACES} SELECT d.doc_id,
 (SELECT arg_min(text, pos) FROM spans_v s WHERE s.doc_id = d.doc_id AND label = 'PERSON') AS name,
 v.text AS village, w.text AS district FROM (SELECT DISTINCT doc_id FROM spans_v) d
 LEFT JOIN places v ON v.doc_id = d.doc_id AND v.rn = 1 LEFT JOIN places w ON w.doc_id = d.doc_id AND w.rn = 2"""
ORACLES["document_extraction"] = f"""WITH t AS (SELECT doc_id, string_agg(coalesce(text, '') || chr(10), '' ORDER BY page_no, text) AS raw
  FROM extraction_pages_v GROUP BY 1),
 e AS (SELECT doc_id, {spans("'PERSON'")} AS persons, {spans("'GPE', 'LOC'")} AS locations, {spans("'DATE'")} AS dates,
  {spans("'ORG'")} AS organizations, arg_min(text, pos) FILTER (label = 'PERSON') AS name FROM extraction_spans_v GROUP BY 1),
 p AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY pos, text) AS rn FROM extraction_spans_v
  WHERE label IN ('GPE', 'LOC') AND lower(text) NOT IN ('india', 'state', 'district', 'village')),
 d AS (SELECT doc_id FROM t UNION SELECT doc_id FROM e),
 x AS (SELECT d.doc_id, CASE WHEN {trimmed('t.raw')} <> '' THEN t.raw END AS raw_text, e.*  EXCLUDE (doc_id),
  v.text AS village, w.text AS district FROM d LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN e ON e.doc_id = d.doc_id
  LEFT JOIN p v ON v.doc_id = d.doc_id AND v.rn = 1 LEFT JOIN p w ON w.doc_id = d.doc_id AND w.rn = 2),
 m AS (SELECT *, list_transform(regexp_extract_all(coalesce(raw_text, ''), '(?i){AREA}'),
  lambda y: {area('y', 1)} || ' ' || {area('y', 2)} || ' ' || {area('y', 3)}) AS areas FROM x)
 SELECT doc_id, raw_text, CASE WHEN raw_text IS NULL THEN 'Failed to extract any text from the document.' END AS reject_reason,
 name, village, district, coalesce(persons, '') AS persons, coalesce(locations, '') AS locations, coalesce(dates, '') AS dates,
 coalesce(organizations, '') AS organizations, array_to_string(areas, '|') AS land_area,
 '[' || array_to_string(list_transform(areas, lambda a: '"' || a || '"'), ',') || ']' AS stored_areas,
 coalesce(name, '') AS form_name, coalesce(village, '') AS form_village, coalesce(district, '') AS form_district, 'Pending' AS form_status FROM m"""
ORACLES["review_prefill"] = f"""WITH {FORM} SELECT doc_id, coalesce(name, '') AS name, coalesce(village, '') AS village,
 coalesce(district, '') AS district, coalesce(state, '') AS state, 'Individual' AS claim_type, 'Pending' AS status,
 coalesce(latitude, '') AS latitude, coalesce(longitude, '') AS longitude, raw_text FROM form"""
ORACLES["extract_summary"] = f"""WITH {FORM} SELECT doc_id, {', '.join(
    f"coalesce({c}, 'Not found') AS {c}" for c in ('name', 'village', 'district')
)}, raw_text FROM form"""


def oracle_texts() -> dict[str, str]:
    return {name: portable(sql.strip()) for name, sql in ORACLES.items()}
