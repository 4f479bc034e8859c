"""Queries of the general training-data problems, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.records import END_REASONS
from ..operators import compact, delivery, drift, intervals, orphans, spikes
from ..session import checkpoint, table, work_path


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.gaps(table(spark, sf, "read_rows"))


def p1_periods(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.periods(table(spark, sf, "read_rows"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return delivery.repeated(table(spark, sf, "read_rows"))


def p2_seen_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return delivery.seen_ranges(table(spark, sf, "read_rows"))


def _orphans(spark: SparkSession, sf: str) -> DataFrame:
    return orphans.orphan_references(*(table(spark, sf, t) for t in ("read_rows", "signal_rows", "run_info")))


def p3_bits(spark: SparkSession, sf: str) -> DataFrame:
    found = orphans.doubtful_references(*(table(spark, sf, t) for t in ("read_rows", "signal_rows", "run_info")))
    return found.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _orphans(spark, sf)


def p3_by_month(spark: SparkSession, sf: str) -> DataFrame:
    return orphans.orphans_by_month(checkpoint(_orphans(spark, sf)), table(spark, sf, "read_rows"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return spikes.implausible(*(table(spark, sf, t) for t in ("signal_rows", "read_rows", "run_info")))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return drift.found_changes(table(spark, sf, "read_exports"))


def p5_changes(spark: SparkSession, sf: str) -> DataFrame:
    return drift.schema_changes(table(spark, sf, "read_exports"))


def p5_versions(spark: SparkSession, sf: str) -> DataFrame:
    versions = drift.registry(table(spark, sf, "read_exports"))
    counted = lambda action: F.size(F.filter("steps", lambda x: x["action"] == action)).cast("long").alias(f"n_{action}s")
    return versions.select("producer", "fingerprint", "since", "n_files", counted("rename"), counted("default"))


def p5_table(spark: SparkSession, sf: str) -> DataFrame:
    return drift.consistent_table(table(spark, sf, "read_exports")).withColumn("uncast", F.array_join("uncast", ","))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return compact.left_out(table(spark, sf, "file_records"))


def p6_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return compact.compact(spark, table(spark, sf, "file_records"), work_path(spark, "compacted"))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_periods, p2_found, p2_seen_ranges, p3_found, p3_bits, p3_by_month, p4_found, p5_found, p5_changes, p5_versions, p5_table, p6_found, p6_manifest)}


_ACQ = r"lower(regexp_replace({}, '^[\s{{}}]+|[\s{{}}]+$', '', 'g'))"
_RANGES = f"""ranges AS (SELECT {_ACQ.format('run_info')} AS acquisition_id, channel::INT AS channel, well::INT AS well, start AS s, start + num_samples AS e
  FROM read_rows WHERE run_info IS NOT NULL AND channel IS NOT NULL AND well IS NOT NULL AND start IS NOT NULL AND num_samples > 0),
marked AS (SELECT *, max(e) OVER (PARTITION BY acquisition_id, channel, well ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ranges)"""
_ORPHANS = f"""reads AS (SELECT row_id, received_at, {_ACQ.format('run_info')} AS acq, signal FROM read_rows),
refs AS (SELECT 'run_info' AS ref_field, row_id, acq AS ref_key, received_at FROM reads WHERE acq IS NOT NULL
  UNION SELECT 'signal', row_id, key::VARCHAR, received_at FROM (SELECT row_id, received_at, unnest(signal) AS key FROM reads) WHERE key IS NOT NULL),
targets AS (SELECT 'run_info' AS ref_field, {_ACQ.format('acquisition_id')} AS ref_key, received_at, deleted_at FROM run_info
  UNION ALL SELECT 'signal', row_no::VARCHAR, received_at, deleted_at FROM signal_rows),
orphans AS (SELECT ref_field, row_id, ref_key, received_at FROM refs r WHERE NOT EXISTS (SELECT 1 FROM targets t WHERE t.ref_field = r.ref_field AND t.ref_key = r.ref_key
  AND t.received_at <= r.received_at AND (t.deleted_at IS NULL OR t.deleted_at > r.received_at)))"""
_READ = r"(CASE WHEN regexp_full_match(lower(regexp_replace(trim(read_id), '[\s{}\-]', '', 'g')), '[0-9a-f]{32}') THEN lower(regexp_replace(trim(read_id), '[\s{}\-]', '', 'g')) ELSE trim(read_id) END)"
_KEPT = f"""keyed AS (SELECT record_id, {_ACQ.format('acquisition_id')} AS acquisition_id, {_READ} AS rid, coalesce(n_bytes, 0) AS n_bytes FROM file_records),
kept AS (SELECT *, rid IS NOT NULL AND row_number() OVER (PARTITION BY acquisition_id, rid ORDER BY record_id) > 1 AS again FROM keyed)"""


#: Keys of the test tables' exports and the field that each holds, written down from the tables, apart from the operator's own list.
_FIELD_KEYS = {
    "read_id": "read_id", "read_number": "read_number", "start": "start", "channel": "channel", "run_info": "run_info",
    "median_before": "median_before median_before_pa", "num_samples": "n_samples num_samples sample_count length_in_samples",
    "tracked_scaling_scale": "tracked_scaling_scale trk_scale tracked_scaling.scale", "open_pore_level": "open_pore_level open_pore_pa pore_level_open",
    "pore_type": "pore_type pore_kind pore.pore_type", "well": "well mux pore.well", "end_reason": "end_reason read_end_reason",
}
_ALIASES = ", ".join(f"('{key}', '{field}')" for field, keys in _FIELD_KEYS.items() for key in keys.split() if key != field)
_DRIFT = f"""ok AS (SELECT file_id, payload::JSON AS j FROM read_exports WHERE CASE WHEN json_valid(payload) THEN json_type(payload) END = 'OBJECT'),
top AS (SELECT file_id, k, json_extract(j, '$."' || k || '"') AS v FROM (SELECT file_id, j, unnest(json_keys(j)) AS k FROM ok)),
leaf AS (SELECT file_id, k AS path, v FROM top WHERE json_type(v) <> 'OBJECT' UNION ALL
  SELECT file_id, k || '.' || n, json_extract(v, '$."' || n || '"') FROM (SELECT file_id, k, v, unnest(json_keys(v)) AS n FROM top WHERE json_type(v) = 'OBJECT')),
named AS (SELECT file_id, path, coalesce(field, path) AS field, CASE WHEN json_type(v) IN ('UBIGINT', 'BIGINT') THEN 'whole' WHEN json_type(v) = 'DOUBLE' THEN 'decimal' WHEN json_type(v) = 'VARCHAR' THEN 'text' END AS kind
  FROM leaf LEFT JOIN (VALUES {_ALIASES}) m(old, field) ON old = path),
fields AS (SELECT file_id, field, list_sort(list(DISTINCT path)) AS paths, CASE WHEN count(DISTINCT kind) = 1 THEN min(kind) WHEN count(DISTINCT kind) = 0 THEN NULL WHEN count(*) FILTER (kind = 'text') = 0 THEN 'decimal' ELSE 'text' END AS kind FROM named GROUP BY file_id, field),
files AS (SELECT file_id, lag(file_id) OVER (PARTITION BY producer ORDER BY file_seq, file_id) AS prev FROM (SELECT DISTINCT producer, file_seq, file_id FROM read_exports)),
news AS (SELECT f.file_id, prev, field, paths, kind FROM files f JOIN fields USING (file_id) WHERE prev IS NOT NULL), olds AS (SELECT f.file_id, field, paths, kind FROM files f JOIN fields o ON o.file_id = f.prev)"""


_CHANGED = """ SELECT n.file_id, n.field AS field_name, 'added' AS change_kind, NULL AS was, array_to_string(n.paths, '+') AS now FROM news n ANTI JOIN olds o ON o.file_id = n.file_id AND o.field = n.field
UNION ALL SELECT o.file_id, o.field, 'removed', array_to_string(o.paths, '+'), NULL FROM olds o ANTI JOIN news n ON o.file_id = n.file_id AND o.field = n.field
UNION ALL SELECT n.file_id, n.field, 'renamed', array_to_string(o.paths, '+'), array_to_string(n.paths, '+') FROM news n JOIN olds o ON o.file_id = n.file_id AND o.field = n.field AND o.paths <> n.paths
UNION ALL SELECT n.file_id, n.field, 'retyped', o.kind, n.kind FROM news n JOIN olds o ON o.file_id = n.file_id AND o.field = n.field AND o.kind <> n.kind"""
#: The fingerprint's text: names of fields, keys and types as a JSON list.
_PRINTS = """prints AS (SELECT file_id, left(sha256('[' || string_agg('["' || field || '", ["' || array_to_string(paths, '", "') || '"], "' || coalesce(kind, '') || '"]', ', ' ORDER BY field) || ']'), 16) AS fingerprint FROM fields GROUP BY file_id)"""


def _table_sql() -> str:
    at = lambda key: "'$." + ".".join(f'"{part}"' for part in key.split(".")) + "'"
    text = {f: "coalesce(" + ", ".join(f"json_extract_string(j, {at(k)})" for k in sorted(keys.split(), reverse=True)) + ")" for f, keys in _FIELD_KEYS.items()}
    reason = "coalesce(" + ", ".join(f"CASE WHEN json_type(json_extract(j, {at(k)})) = 'UBIGINT' THEN [{', '.join(map(repr, END_REASONS))}][json_extract(j, {at(k)})::INT + 1] END" for k in ("end_reason", "read_end_reason")) + ")"
    text["end_reason"] = f"coalesce({reason}, {text['end_reason']})"
    number = "TRY_CAST(t_{0} AS DOUBLE)".format
    whole = "CASE WHEN regexp_full_match(t_{0}, '\\s*[+-]?\\d+\\s*') THEN TRY_CAST(trim(t_{0}) AS BIGINT) WHEN TRY_CAST(t_{0} AS DOUBLE) = floor(TRY_CAST(t_{0} AS DOUBLE)) THEN TRY_CAST(TRY_CAST(t_{0} AS DOUBLE) AS BIGINT) END".format
    cast = {"string": "t_{0}".format, "float": lambda f: number(f) + "::FLOAT", "long": whole, "int": lambda f: f"TRY_CAST({whole(f)} AS INT)", "short": lambda f: f"TRY_CAST({whole(f)} AS SMALLINT)", "boolean": lambda f: "NULL::BOOLEAN"}
    values = [f"{cast[kind](f)} AS {f}" if f in text else f"NULL::{dict(string='VARCHAR', long='BIGINT', float='FLOAT', boolean='BOOLEAN')[kind]} AS {f}" for f, kind in drift.FIELDS.items()]
    names = ", ".join(f"CASE WHEN t_{f} IS NOT NULL AND {f} IS NULL THEN '{f}' END" for f in drift.FIELDS if f in text)
    known = ", ".join(f"'{k}'" for keys in _FIELD_KEYS.values() for k in keys.split())
    return f"""WITH objects AS (SELECT rec_id, file_id, CASE WHEN CASE WHEN json_valid(payload) THEN json_type(payload) END = 'OBJECT' THEN payload::JSON END AS j FROM read_exports),
top AS (SELECT rec_id, k, json_extract(j, '$."' || k || '"') AS v FROM (SELECT rec_id, j, unnest(json_keys(j)) AS k FROM objects)),
leaf AS (SELECT rec_id, k AS path, v FROM top WHERE json_type(v) <> 'OBJECT' UNION ALL SELECT rec_id, k || '.' || n, json_extract(v, '$."' || n || '"') FROM (SELECT rec_id, k, v, unnest(json_keys(v)) AS n FROM top WHERE json_type(v) = 'OBJECT')),
more AS (SELECT rec_id, '{{' || string_agg('"' || path || '":' || v::VARCHAR, ',' ORDER BY path) || '}}' AS extra FROM leaf WHERE path NOT IN ({known}) GROUP BY rec_id),
texts AS (SELECT rec_id, file_id, j IS NOT NULL AS readable, {', '.join(f'{t} AS t_{f}' for f, t in text.items())} FROM objects),
typed AS (SELECT *, {', '.join(v for v in values)} FROM texts)
SELECT rec_id, file_id, readable, {', '.join(drift.FIELDS)}, concat_ws(',', {names}) AS uncast, extra FROM typed LEFT JOIN more USING (rec_id)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p5_found": f"WITH {_DRIFT} SELECT file_id, field_name, change_kind FROM ({_CHANGED})",
        "p5_changes": f"""WITH {_DRIFT}, {_PRINTS}, found AS ({_CHANGED}), firsts AS (SELECT file_id, NULL AS field_name, 'first' AS change_kind, NULL AS was, NULL AS now FROM files WHERE prev IS NULL),
every AS (SELECT * FROM found UNION ALL SELECT * FROM firsts)
SELECT e.file_id, producer, file_seq::BIGINT AS file_seq, coalesce(fingerprint, left(sha256('[]'), 16)) AS fingerprint, field_name, change_kind, was, now FROM every e JOIN (SELECT DISTINCT file_id, producer, file_seq FROM read_exports) USING (file_id) LEFT JOIN prints USING (file_id)""",
        "p5_versions": f"""WITH {_DRIFT}, {_PRINTS}, every AS (SELECT f.*, coalesce(fingerprint, left(sha256('[]'), 16)) AS fingerprint FROM (SELECT DISTINCT file_id, producer, file_seq FROM read_exports) f LEFT JOIN prints USING (file_id)),
steps AS (SELECT file_id, count(*) AS n_present, count(*) FILTER (paths <> [field]) AS n_renames FROM fields GROUP BY file_id)
SELECT producer, fingerprint, min(file_seq)::BIGINT AS since, count(*) AS n_files, max(coalesce(n_renames, 0)) AS n_renames, max({len(drift.FIELDS)} - coalesce(n_present, 0)) AS n_defaults FROM every LEFT JOIN steps USING (file_id) GROUP BY 1, 2""",
        "p5_table": _table_sql(),
        "p2_seen_ranges": f"""WITH numbers AS (SELECT DISTINCT {_ACQ.format('run_info')} AS acquisition_id, lower(hex(read_id)) AS h, ('0x' || hex(read_id))::UHUGEINT AS v FROM read_rows WHERE octet_length(read_id) = 16)
SELECT acquisition_id, min(h) AS range_from, max(h) AS range_to, count(*) AS n_numbers FROM (SELECT *, v - row_number() OVER (PARTITION BY acquisition_id ORDER BY v)::UHUGEINT AS g FROM numbers) GROUP BY acquisition_id, g""",
        "p1_found": f"WITH {_RANGES} SELECT acquisition_id, channel, well, before AS gap_start, s AS gap_end FROM marked WHERE s > before",
        "p1_periods": f"""WITH {_RANGES}, labelled AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY acquisition_id, channel, well ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM marked)
SELECT acquisition_id, channel, well, min(s) AS period_start, max(e) AS period_end, count(*) AS n_rows FROM labelled GROUP BY acquisition_id, channel, well, island""",
        "p2_found": f"SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY {_ACQ.format('run_info')}, read_id ORDER BY received_at NULLS LAST, row_id) AS n FROM read_rows) WHERE n > 1",
        "p3_found": f"WITH {_ORPHANS} SELECT ref_field, row_id, ref_key FROM orphans",
        "p3_bits": f"""WITH {_ORPHANS}, firsts AS (SELECT ref_field, ref_key, min(floor(epoch_us(received_at) / 1000)) AS since FROM targets WHERE deleted_at IS NULL AND received_at IS NOT NULL GROUP BY 1, 2),
days AS (SELECT ref_field, ref_key, CAST(received_at AT TIME ZONE 'UTC' AS DATE) AS day, min(floor(epoch_us(received_at) / 1000)) AS referred FROM refs GROUP BY 1, 2, 3)
SELECT ref_field, ref_key, strftime(day, '%Y-%m-%d') AS day FROM days LEFT JOIN firsts USING (ref_field, ref_key) WHERE since IS NULL OR since >= referred""",
        "p3_by_month": f"WITH {_ORPHANS} SELECT CASE WHEN ref_field = 'run_info' THEN 'run_info' ELSE 'signal_rows' END AS ref_table, strftime(received_at AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) AS n_orphans FROM orphans GROUP BY 1, 2",
        "p6_found": f"WITH {_KEPT} SELECT record_id FROM kept WHERE again",
        "p6_manifest": f"WITH {_KEPT} SELECT acquisition_id, CAST(floor(before / {compact.TARGET_BYTES}) AS BIGINT) AS out_file, count(*) AS n_records, sum(n_bytes)::BIGINT AS n_bytes FROM (SELECT *, sum(n_bytes) OVER (PARTITION BY acquisition_id ORDER BY rid NULLS FIRST, record_id ROWS UNBOUNDED PRECEDING) - n_bytes AS before FROM kept WHERE NOT again) GROUP BY 1, 2",
    }


