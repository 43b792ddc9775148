"""SQL that states the results of the queries of ``core``, for the spellings and shapes in the tables."""

from __future__ import annotations

#: Zone abbreviations of the clock zones that occur, with their offsets in minutes.
_ABBREVIATIONS = {
    "Europe/Berlin": {"CET": 60, "CEST": 120}, "Europe/Lisbon": {"WET": 0, "WEST": 60}, "Europe/London": {"GMT": 0, "BST": 60}, "America/New_York": {"EST": -300, "EDT": -240}, "America/Denver": {"MST": -420, "MDT": -360},
    "America/St_Johns": {"NST": -210, "NDT": -150}, "Australia/Sydney": {"AEST": 600, "AEDT": 660}, "Pacific/Auckland": {"NZST": 720, "NZDT": 780}, "Asia/Tokyo": {"JST": 540}, "Asia/Kolkata": {"IST": 330},
}
_ROWS = ", ".join(f"('{z}', '{a}', {o})" for z, m in _ABBREVIATIONS.items() for a, o in m.items())

_Z = r"\s*(Z|(?:GMT)?[+-]\d{1,2}(?::?\d{2})?)?(?:\[[^\]]*\])?\s*([A-Z]{3,4})?$"
_T = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_FORMS = [
    (rf"^(\d{{4}})[:-](\d{{1,2}})[:-](\d{{1,2}})[T ]{_T}{_Z}", ["y", "m", "d", "h", "i", "s", "f", "z", "a"]),
    (r"^(\d{4})(\d{2})(\d{2})_(\d{2})(\d{2})(\d{2})$", ["y", "m", "d", "h", "i", "s"]),
    (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}) {_T}(?: ([AP]M))?$", ["p", "q", "y", "h", "i", "s", "f", "n"]),
    (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}) {_T}$", ["d", "m", "y", "h", "i", "s", "f"]),
    (rf"^([A-Z][a-z]{{2}}) (\d{{1,2}}), (\d{{4}}) {_T} ([ap]m)$", ["b", "d", "y", "h", "i", "s", "f", "n"]),
    (rf"^(?:[A-Z][a-z]{{2}}, )?(\d{{1,2}}) ([A-Z][a-z]{{2}}) (\d{{4}}) {_T}{_Z}", ["d", "b", "y", "h", "i", "s", "f", "z", "a"]),
    (r"^(\d{9,17})$", ["e"]),
]
_KEYS = ["y", "m", "d", "h", "i", "s", "f", "z", "a", "p", "q", "n", "b", "e"]


def _branch(pattern: str, names: list[str]) -> str:
    cells = ", ".join(f"nullif(regexp_extract(t, '{pattern}', {names.index(k) + 1}), '') AS {k}" if k in names else f"NULL::VARCHAR AS {k}" for k in _KEYS)
    return f"SELECT photo_id, zone, ord, {cells} FROM r WHERE regexp_matches(t, '{pattern}')"


P2 = f"""
WITH r AS (SELECT DISTINCT photo_id, regexp_replace(captured_at, '^[\\s\\x00]+|[\\s\\x00]+$', '', 'g') AS t, CASE WHEN lower(trim(timestamp_source)) = 'mtime' THEN host_zone ELSE clock_zone END AS zone, coalesce(date_order, 'dmy') AS ord
  FROM photo LEFT JOIN capture_device USING (device_id) LEFT JOIN trip USING (trip_id) WHERE photo_id IS NOT NULL),
c AS ({" UNION ALL ".join(_branch(*f) for f in _FORMS)}),
x AS (SELECT *, coalesce(m, CASE WHEN ord = 'mdy' THEN p ELSE q END, lpad((instr('janfebmaraprmayjunjulaugsepoctnovdec', lower(b)) // 3 + 1)::VARCHAR, 2, '0')) AS mm, coalesce(d, CASE WHEN ord = 'mdy' THEN q ELSE p END) AS dd,
  CASE WHEN n IS NULL THEN h::INT ELSE h::INT % 12 + CASE WHEN lower(n) = 'pm' THEN 12 ELSE 0 END END AS hh FROM c),
w AS (SELECT *, try_cast(printf('%s-%s-%s %02d:%s:%s', y, lpad(mm, 2, '0'), lpad(dd, 2, '0'), hh, i, coalesce(s, '00')) AS TIMESTAMP) AS wall, coalesce(rpad(left(f, 6), 6, '0')::BIGINT, 0) AS us, regexp_replace(z, '[^0-9]', '', 'g') AS g FROM x WHERE e IS NOT NULL OR hh < 24),
o AS (SELECT w.*, v.off AS known, CASE WHEN z = 'Z' THEN 0 WHEN z IS NOT NULL THEN CASE WHEN contains(z, '-') THEN -1 ELSE 1 END * CASE WHEN len(g) <= 2 THEN g::INT * 60 ELSE left(g, len(g) - 2)::INT * 60 + right(g, 2)::INT END END AS told
  FROM w LEFT JOIN (VALUES {_ROWS}) v(zn, ab, off) ON v.zn = w.zone AND v.ab = w.a),
k AS (SELECT *, coalesce(told, known, CASE WHEN a IN ('UTC', 'GMT') THEN 0 END) AS minutes, timezone(zone, wall) AS u0 FROM o),
q AS (SELECT *, CASE WHEN timezone(zone, u0 - INTERVAL 60 MINUTE) = wall THEN u0 - INTERVAL 60 MINUTE WHEN timezone(zone, u0 - INTERVAL 30 MINUTE) = wall THEN u0 - INTERVAL 30 MINUTE
  WHEN timezone(zone, u0) <> wall THEN make_timestamptz(epoch_us(wall) - epoch_us(timezone(zone, u0 - INTERVAL 180 MINUTE)) + epoch_us(u0 - INTERVAL 180 MINUTE)) ELSE u0 END AS first FROM k)
SELECT DISTINCT photo_id, CASE WHEN e IS NOT NULL THEN e::BIGINT * CASE WHEN len(e) <= 11 THEN 1000000 WHEN len(e) <= 14 THEN 1000 ELSE 1 END
  WHEN minutes IS NOT NULL THEN epoch_us(wall) + us - minutes::BIGINT * 60000000 ELSE epoch_us(first) + us END AS captured_us FROM q WHERE e IS NOT NULL OR wall IS NOT NULL
"""


def _field(node: str, name: str) -> str:
    head, *rest = name.split("_")
    camel = head + "".join(x.capitalize() for x in rest)
    one = lambda n: f"CASE WHEN json_type({node}, '$.{n}') <> 'NULL' THEN json_extract({node}, '$.{n}') END"
    return f"coalesce({one(name)}, {one(camel)})"


def _entries(node: str, own: tuple[str, ...]) -> str:
    """A list of (k, name, node) of a list, of one object, or of an object of objects."""
    single = " OR ".join(f"{_field(node, n)} IS NOT NULL" for n in own)
    listed = f"list_transform(json_extract({node}, '$[*]'), lambda x, i: {{'k': i::INT, 'name': NULL::VARCHAR, 'node': x}})"
    alone = f"[{{'k': 1, 'name': NULL::VARCHAR, 'node': {node}}}]"
    named = f"list_transform(json_keys({node}), lambda n, i: {{'k': i::INT, 'name': n, 'node': json_extract({node}, '$.\"' || n || '\"')}})"
    return f"CASE json_type({node}) WHEN 'ARRAY' THEN {listed} WHEN 'OBJECT' THEN CASE WHEN {single} THEN {alone} ELSE {named} END END"


P3 = f"""
WITH l AS (SELECT manifest_id, regexp_replace(payload, '^\\s*\\x{{FEFF}}', '') AS p FROM cluster_manifest WHERE manifest_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY manifest_id ORDER BY received_at DESC NULLS LAST, payload DESC NULLS LAST) = 1),
i AS (SELECT manifest_id, CASE WHEN json_type(p) = 'VARCHAR' THEN regexp_replace(json_extract_string(p, '$'), '^\\s*\\x{{FEFF}}', '') ELSE p END AS p FROM l WHERE json_valid(p)),
d AS (SELECT manifest_id, p::JSON AS doc FROM i WHERE json_valid(p) AND json_type(p) = 'OBJECT'),
c AS (SELECT manifest_id, {_field('doc', 'clusters')} AS cs, {_field('doc', 'burst_groups')} AS bs FROM d),
b AS (SELECT manifest_id, unnest({_entries('bs', ('burst_group_id', 'member_filenames', 'member_count'))}) AS e FROM c),
bf AS (SELECT manifest_id, e.k AS k, coalesce(json_extract_string({_field('e.node', 'burst_group_id')}, '$'), e.name) AS bid, unnest(json_extract_string({_field('e.node', 'member_filenames')}, '$[*]')) AS filename FROM b),
bm AS (SELECT manifest_id, filename, arg_min(bid, k) AS listed FROM bf GROUP BY ALL),
n AS (SELECT manifest_id, unnest({_entries('cs', ('cluster_id', 'members', 'member_filenames', 'member_count'))}) AS e FROM c),
cn AS (SELECT manifest_id, coalesce(json_extract_string({_field('e.node', 'cluster_id')}, '$'), e.name) AS cluster_id, {_field('e.node', 'members')} AS ms, {_field('e.node', 'member_filenames')} AS fs FROM n),
me AS (SELECT manifest_id, cluster_id, unnest({_entries('ms', ('filename', 'relative_path', 'blur_score'))}) AS e FROM cn WHERE ms IS NOT NULL),
m AS (SELECT manifest_id, cluster_id, e.k AS k, coalesce(json_extract_string(e.node, '$.filename'), e.name) AS filename, json_extract_string({_field('e.node', 'burst_group_id')}, '$') AS own FROM me
  UNION ALL SELECT manifest_id, cluster_id, 1, unnest(json_extract_string(fs, '$[*]')), NULL FROM cn WHERE ms IS NULL),
a AS (SELECT m.*, coalesce(own, listed, '') AS burst FROM m LEFT JOIN bm USING (manifest_id, filename) WHERE filename IS NOT NULL)
SELECT manifest_id, cluster_id, arg_min(burst, {{'e': burst = '', 'k': k}}) AS burst_group_id, filename FROM a GROUP BY manifest_id, cluster_id, filename
"""
