"""DuckDB SQL for those queries of this package that SQL can express on whole tables."""

from __future__ import annotations

# Bytes md5 gives as hex, 9 digits of them as a number.
_HASH = " + ".join(f"(instr('0123456789abcdef', substr(code, {i}, 1)) - 1) * {16 ** (9 - i)}" for i in range(1, 10))

MIXING = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS code
  FROM documents
), hashed AS (
  SELECT doc_id, source, size, ({_HASH})::BIGINT AS hash FROM sized
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight
  FROM hashed GROUP BY source
), candidate AS (
  -- the level at which as much is shared as there is, if the sources with a smaller ratio are at their ceilings
  SELECT a.source,
         (SELECT sum(source_size) * 1.5 FROM sources)
         - coalesce((SELECT sum(2.0 * b.source_size) FROM sources b WHERE 2.0 * b.source_size / b.weight < 2.0 * a.source_size / a.weight), 0) AS remaining,
         (SELECT sum(b.weight) FROM sources b WHERE 2.0 * b.source_size / b.weight >= 2.0 * a.source_size / a.weight) AS sharing,
         2.0 * a.source_size / a.weight AS ratio
  FROM sources a
), level AS (
  SELECT arg_min(remaining / sharing, ratio) AS share FROM candidate WHERE ratio > remaining / sharing
), targets AS (
  SELECT source, source_size, CASE WHEN share IS NULL THEN 2.0 * source_size ELSE least(2.0 * source_size, weight * share) END::DOUBLE AS target
  FROM sources, level
), budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2)::BIGINT ELSE 0 END AS copies FROM targets
), running AS (
  SELECT h.source, h.hash, sum(h.size) AS here, sum(sum(h.size)) OVER (PARTITION BY h.source ORDER BY h.hash) AS upto
  FROM hashed h GROUP BY h.source, h.hash
), edges AS (
  SELECT b.source, b.copies, b.source_size, b.target,
         min(CASE WHEN r.upto > b.target - b.copies * b.source_size THEN r.hash END) AS boundary,
         min(CASE WHEN r.upto > b.target - b.copies * b.source_size THEN r.upto END) AS over,
         coalesce(max(CASE WHEN r.upto <= b.target - b.copies * b.source_size THEN r.upto END), 0) AS used
  FROM budgets b JOIN running r ON b.source IS NOT DISTINCT FROM r.source
  GROUP BY b.source, b.copies, b.source_size, b.target
)
SELECT h.doc_id, h.size, e.source_size, e.target,
       (h.size * least(2, e.copies + CASE
         WHEN e.boundary IS NULL OR h.hash < e.boundary THEN 1
         WHEN h.hash = e.boundary AND e.over - (e.target - e.copies * e.source_size) < (e.target - e.copies * e.source_size) - e.used THEN 1
         ELSE 0 END))::BIGINT AS taken
FROM hashed h JOIN edges e ON h.source IS NOT DISTINCT FROM e.source
"""

_HOST = r"nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\.$', ''), '')"
_ADDRESS = r"regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '[?#].*$', '')"


def _day(first: int) -> str:
    return f"TIMESTAMP '2024-01-01 00:00:00' + to_days((ascii(substr(code, {first}, 1)) * 3 + ascii(substr(code, {first + 1}, 1)) - 190)::INTEGER)"


URL_FILTERS = rf"""
WITH captured AS (
  SELECT page_id, url, {_HOST} AS host, {_ADDRESS} AS address,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes((page_id * 7919) % (366 * 24 * 60)) AS fetched_at
  FROM pages
), hosts AS (
  SELECT DISTINCT host, md5(host) AS code FROM captured WHERE host IS NOT NULL
), entries AS (
  SELECT 'host' AS kind, host AS value, TRUE AS listed, {_day(2)} AS dated FROM hosts WHERE substr(code, 1, 1) < '6'
  UNION ALL SELECT 'host', host, FALSE, {_day(4)} FROM hosts WHERE substr(code, 1, 1) < '6'
  UNION ALL SELECT 'host', host, TRUE, {_day(6)} FROM hosts WHERE substr(code, 1, 1) < '6'
  UNION ALL SELECT 'domain', array_to_string(string_split(host, '.')[-3:], '.'), TRUE, {_day(8)} FROM hosts WHERE contains(host, 'ads-track') OR contains(host, 'cheap-pills')
  UNION ALL SELECT 'url', address, TRUE, TIMESTAMP '2024-03-01 00:00:00' FROM captured WHERE page_id % 50 = 0 AND url IS NOT NULL
), moments AS (
  SELECT kind, value, dated, bool_or(listed) AS listed FROM entries GROUP BY kind, value, dated
), spans AS (
  SELECT kind, value, dated AS since, lead(dated, 1, TIMESTAMP '9999-01-01 00:00:00') OVER (PARTITION BY kind, value ORDER BY dated) AS ended, listed FROM moments
), hits AS (
  SELECT c.page_id, s.kind, s.value, s.since
  FROM captured c JOIN spans s
    ON s.listed AND s.since <= c.fetched_at AND c.fetched_at < s.ended
   AND ((s.kind = 'host' AND s.value = c.host) OR (s.kind = 'url' AND s.value = c.address)
        OR (s.kind = 'domain' AND (s.value = c.host OR ends_with(c.host, '.' || s.value))))
), first_hits AS (
  SELECT page_id, count(*) AS n_entries, min(struct_pack(since := since, kind := kind, value := value)) AS first FROM hits GROUP BY page_id
)
SELECT c.page_id, c.url, c.host, c.fetched_at, f.page_id IS NOT NULL AS blocked, coalesce(f.n_entries, 0)::BIGINT AS n_entries,
       f.first.kind AS first_kind, f.first.value AS first_value, f.first.since AS first_since
FROM captured c LEFT JOIN first_hits f USING (page_id)
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# crc32 of the id as text, bit by bit; SQL has no function for it.
_CRC32 = """xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, c: list_reduce(list_prepend(xor(crc, c), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""


def _leaf_text(text: str) -> str:
    fields = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(concat(" + ", ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + "))"


def _merkle_levels(name: str, levels: int) -> str:
    """CTEs from the nodes ``{name}0 (tree, place, digest)`` up: siblings of each level, then its parents; and the last nodes."""
    out = []
    for k in range(levels):
        run = "OVER (PARTITION BY tree, place // 16 ORDER BY place ROWS BETWEEN"
        out.append(f"""{name}s{k} AS (
  SELECT tree, place, coalesce(string_agg(digest, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lhs,
         coalesce(string_agg(digest, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rhs
  FROM {name}{k} WHERE tree IN (SELECT tree FROM {name}{k} GROUP BY tree HAVING count(*) > 1)
), {name}{k + 1} AS (
  SELECT tree, place // 16 AS place, sha256(string_agg(digest, '' ORDER BY place)) AS digest
  FROM {name}{k} WHERE tree IN (SELECT tree FROM {name}{k} GROUP BY tree HAVING count(*) > 1) GROUP BY tree, place // 16
)""")
    last = " UNION ALL ".join(f"SELECT tree, max(digest) AS digest FROM {name}{k} GROUP BY tree HAVING count(*) = 1" for k in range(levels + 1))
    return ",\n".join(out) + f",\n{name}_roots AS ({last})"


_ROW_LEVELS, _SOURCE_LEVELS = 6, 4
_STEPS = [(f"a{k}", f"n1s{k}", "r.tree", f"r.place // {16**k}") for k in range(_ROW_LEVELS)]
_STEPS += [(f"b{k}", f"n2s{k}", "0", f"r.tree // {16**k}") for k in range(_SOURCE_LEVELS)]


def _merkle_folds() -> str:
    """One CTE a step, as a nested expression would double at each."""
    out, before = [], "told_rows"
    for k, (name, siblings, tree, place) in enumerate(_STEPS):
        out.append(f"""f{k} AS (
  SELECT r.* REPLACE (CASE WHEN s.tree IS NULL THEN r.node ELSE sha256(s.lhs || r.node || s.rhs) END AS node,
                      CASE WHEN s.tree IS NULL THEN r.proof ELSE r.proof || s.lhs || s.rhs END AS proof)
  FROM {before} r LEFT JOIN {siblings} s ON s.tree = {tree} AND s.place = {place}
)""")
        before = f"f{k}"
    return ",\n".join(out)


MERKLE = f"""
WITH sources AS (
  SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT source FROM documents)
), leaves AS (
  SELECT doc_id, source, {_leaf_text("text")} AS leaf,
         CASE WHEN {_CRC32} % 5 = 0 THEN {_leaf_text(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS told
  FROM documents
), placed AS (
  SELECT doc_id, tree, leaf, coalesce(told, leaf) AS told, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place
  FROM leaves JOIN sources ON leaves.source IS NOT DISTINCT FROM sources.source
), n10 AS (
  SELECT tree, place, leaf AS digest FROM placed
),
{_merkle_levels("n1", _ROW_LEVELS)},
n20 AS (
  SELECT 0 AS tree, tree AS place, digest FROM n1_roots
),
{_merkle_levels("n2", _SOURCE_LEVELS)},
told_rows AS (
  SELECT doc_id, tree, place, leaf, told AS node, '' AS proof FROM placed
),
{_merkle_folds()}
SELECT f.doc_id, f.leaf, s.digest AS subroot, t.digest AS root, sha256(f.proof) AS proof_sha256, f.node AS folded_root, f.node = t.digest AS verified
FROM f{len(_STEPS) - 1} f JOIN n1_roots s ON s.tree = f.tree CROSS JOIN n2_roots t
"""

ORACLES = {"op8_mixing": MIXING, "op10_url_filters": URL_FILTERS, "op11_merkle_manifest": MERKLE}
