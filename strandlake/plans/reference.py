"""Queries of the operators on reads, signal and run information, each over its whole tables, with their SQL.

Floats that may be NaN come out as null, times as epoch milliseconds, arrays as text, so that values can be compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import codec
from ..functions import ids, records
from ..functions import signal as sig
from ..functions.keys import acquisition_key
from ..operators import aggregate, merge, migrate, route, select, signal, view
from ..schema import READS_V3, RUN_INFO_COLUMNS
from ..session import broadcast_if_small, checkpoint, table, work_path
from ..sources.container import ReadStore, write

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        name = f.__name__.lstrip("_")
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def _reads(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "read_rows").withColumn("_file", F.concat(F.lit("store/batch_"), F.col("batch_id"), F.lit(".container")))


def _signal(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "signal_rows")


def _info(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "run_info")


def _stored(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "file_records").withColumn("acquisition_id", acquisition_key("acquisition_id"))


def _no_nan(df: DataFrame) -> DataFrame:
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if kind in ("float", "double") else F.col(c) for c, kind in df.dtypes])


#: Bare identifier of an acquisition, and a read id's 32 hex digits as the canonical text, as TESTDATA.md wants keys compared and given out.
_ACQ = r"lower(regexp_replace({}, '^[\s{{}}]+|[\s{{}}]+$', '', 'g'))".format
_U = r"regexp_replace(lower(hex({})), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\1-\2-\3-\4-\5')".format
_DIGITS = r"lower(regexp_replace(regexp_replace(read_id, '^\{(.*)\}$', '\1'), '-', '', 'g'))"
_VALID = f"regexp_full_match({_DIGITS}, '[0-9a-f]{{32}}')"
_STRICT = "regexp_full_match(read_id, '[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}')"
_NN = "CASE WHEN isfinite({0}) THEN {0} END AS {0}".format
_NOT_SET = "CASE WHEN length({0}) = 0 THEN 'not_set' ELSE {0} END AS {1}".format
_FLOATS = ["median_before", "predicted_scaling_scale", "predicted_scaling_shift", "tracked_scaling_scale", "tracked_scaling_shift"]


@_query(f"""SELECT {_U('read_id')} AS read_id, 'batch_' || batch_id || '.container' AS filename, read_number, channel, well AS mux, end_reason,
start::DOUBLE / nullif(sample_rate, 0) AS start_time, start AS start_sample, num_samples::DOUBLE / nullif(sample_rate, 0) AS duration, num_samples, num_minknow_events AS minknow_events, sample_rate,
{', '.join(map(_NN, _FLOATS))}, num_reads_since_mux_change, {_NN('time_since_mux_change')}, protocol_run_id AS run_id, {_NOT_SET('sample_id', 'sample_id')}, {_NOT_SET('experiment_name', 'experiment_id')}, {_NOT_SET('flow_cell_id', 'flow_cell_id')}, pore_type, {_NN('open_pore_level')}
FROM read_rows JOIN (SELECT DISTINCT {_ACQ('acquisition_id')} AS acquisition, sample_rate, protocol_run_id, sample_id, experiment_name, flow_cell_id FROM run_info) i ON {_ACQ('run_info')} = acquisition""")  # fmt: skip
def view_all(spark, sf):
    return _no_nan(view.view(_reads(spark, sf), _info(spark, sf), strict=False))


@_query(f"""SELECT {_U('read_id')} AS read_id, num_samples::DOUBLE / nullif(sample_rate, 0) AS duration, sample_rate
FROM read_rows JOIN (SELECT DISTINCT {_ACQ('acquisition_id')} AS acquisition, sample_rate FROM run_info) i ON {_ACQ('run_info')} = acquisition""")
def view_pruned(spark, sf):
    return view.view(_reads(spark, sf), _info(spark, sf), include="sample_rate, duration, read_id", strict=False)


@_query(f"SELECT {_U('read_id')} AS read_id FROM read_rows")
def view_ids(spark, sf):
    return view.view(_reads(spark, sf), ids=True)


@_query("SELECT 'batch_' || batch_id || '.container' AS filename FROM read_rows")
def view_filename(spark, sf):
    return view.view(_reads(spark, sf), include="filename")


@_query("SELECT * FROM (VALUES " + ", ".join("({}, '{}', '{}')".format(k, n, f.doc.replace("'", "''")) for k, (n, f) in enumerate(view.FIELDS.items())) + ") t(position, field, description)")
def list_fields(spark, sf):
    return view.list_fields(spark)


@_query(f"SELECT row_id, {_U('read_id')} AS read_id FROM read_rows")
def uuid_format(spark, sf):
    return table(spark, sf, "read_rows").select("row_id", ids.uuid_str("read_id").alias("read_id"))


@_query(f"SELECT record_id, CASE WHEN {_VALID} THEN {_DIGITS} END AS digits FROM file_records")
def uuid_parse(spark, sf):
    return table(spark, sf, "file_records").select("record_id", F.lower(F.hex(ids.uuid_bin("read_id"))).alias("digits"))


_BAG = f"bag AS (SELECT unhex({_DIGITS}) AS id FROM file_records WHERE {_VALID})"


@_query(f"""WITH {_BAG}, firsts AS (SELECT batch_id, read_id, min(row_id) AS row_id FROM read_rows GROUP BY 1, 2)
SELECT row_id, {_U('read_id')} AS read_id FROM firsts JOIN bag ON id = read_id""")
def select_bag(spark, sf):
    chosen = select.pack_ids(table(spark, sf, "file_records").select("read_id"))
    rows = table(spark, sf, "read_rows").select("batch_id", "row_id", "read_id")
    return select.select_reads(rows, chosen, file=["batch_id"], order=["row_id"]).select("row_id", ids.uuid_str("read_id").alias("read_id"))


@_query(f"WITH {_BAG} SELECT DISTINCT {_U('id')} AS read_id FROM bag WHERE id NOT IN (SELECT read_id FROM read_rows WHERE read_id IS NOT NULL)")
def select_missing(spark, sf):
    chosen = select.pack_ids(table(spark, sf, "file_records").select("read_id"))
    return select.missing(table(spark, sf, "read_rows"), chosen).select(ids.uuid_str("read_id").alias("read_id"))


@_query(f"""WITH {_BAG}, firsts AS (SELECT min(row_id) AS row_id FROM read_rows GROUP BY batch_id, read_id)
SELECT {_U('read_id')} AS read_id, read_number, num_samples FROM firsts JOIN read_rows USING (row_id) JOIN bag ON id = read_id""")
def selected_read_numbers(spark, sf):
    chosen = select.pack_ids(table(spark, sf, "file_records").select("read_id"))
    rows = table(spark, sf, "read_rows").select("batch_id", "row_id", "read_id", "read_number", "num_samples")
    return select.select_reads(rows, chosen, file=["batch_id"], order=["row_id"]).select(ids.uuid_str("read_id").alias("read_id"), "read_number", "num_samples")


@_query(f"SELECT {_U('min(read_id)')} AS read_id FROM read_rows")
def point_lookup(spark, sf):
    reads = table(spark, sf, "read_rows")
    wanted = reads.agg(ids.uuid_str(F.min("read_id"))).first()[0]
    return select.point_lookup(reads, wanted).select(ids.uuid_str("read_id").alias("read_id"))


@_query("SELECT row_id, row_number() OVER (ORDER BY batch_id, row_id) - 1 AS position FROM read_rows")
def storage_order(spark, sf):
    return select.bucketed(table(spark, sf, "read_rows").select("batch_id", "row_id"), 4000, ["batch_id", "row_id"]).select("row_id", "position")


@_query("SELECT record_id, (row_number() OVER (ORDER BY record_id) - 1) // 4000 AS bucket FROM file_records")
def bucket_4000(spark, sf):
    return select.bucketed(table(spark, sf, "file_records").select("record_id"), 4000, ["record_id"]).select("record_id", "bucket")


@_query("SELECT row_id, batch_id FROM read_rows WHERE batch_id IN (1, 3, 5)")
def batch_subset(spark, sf):
    return select.at_places(table(spark, sf, "read_rows").select("row_id", "batch_id"), [1, 3, 5], batch="batch_id")


@_query()
def sample_ids(spark, sf):
    return select.sample(table(spark, sf, "read_rows"), 0.1, 42).select(ids.uuid_str("read_id").alias("read_id"))


_MAP = f"pairs AS (SELECT DISTINCT unhex({_DIGITS}) AS id, 'acq-' || {_ACQ('acquisition_id')} || '.container' AS dest FROM file_records WHERE {_VALID} AND acquisition_id IS NOT NULL)"


@_query(f"WITH {_MAP} SELECT row_id, dest FROM read_rows JOIN pairs ON id = read_id")
def subset_route(spark, sf):
    mapping = route.mapping_of_table(_stored(spark, sf), ["acquisition_id"], template="acq-{acquisition_id}.container")
    return route.subset(table(spark, sf, "read_rows").select("row_id", "read_id"), mapping, missing_ok=True, check=False).select("row_id", "dest")


@_query(f"WITH {_MAP} SELECT dest, count(*) AS n_reads, sum(num_samples)::BIGINT AS n_samples FROM read_rows JOIN pairs ON id = read_id GROUP BY dest")
def subset_sizes(spark, sf):
    mapping = route.mapping_of_table(_stored(spark, sf), ["acquisition_id"], template="acq-{}.container")
    routed = route.subset(table(spark, sf, "read_rows").select("read_id", "num_samples"), mapping, missing_ok=True, check=False)
    return routed.groupBy("dest").agg(F.count(F.lit(1)).alias("n_reads"), F.sum("num_samples").alias("n_samples"))


@_query(f"SELECT record_id, 'acquisition_id-' || {_ACQ('acquisition_id')} || '_seq_no-' || seq_no || '.container' AS dest FROM file_records WHERE {_VALID} AND acquisition_id IS NOT NULL AND seq_no IS NOT NULL")
def template_dest(spark, sf):
    columns = ["acquisition_id", "seq_no"]
    rows = _stored(spark, sf).filter(ids.uuid_bin("read_id").isNotNull()).dropna(subset=columns)
    return rows.select("record_id", route.templated(route.default_template(columns), columns).alias("dest"))


@_query(f"WITH {_BAG} SELECT row_id FROM read_rows WHERE read_id IN (SELECT id FROM bag)")
def filter_ids(spark, sf):
    chosen = table(spark, sf, "file_records").select("read_id")
    return route.filter_ids(table(spark, sf, "read_rows").select("row_id", "read_id"), chosen, missing_ok=True).select("row_id")


@_query(f"SELECT record_id, read_id FROM file_records WHERE read_id IS NOT NULL AND {_STRICT}")
def uuid_regex_filter(spark, sf):
    return table(spark, sf, "file_records").select("record_id", "read_id").dropna().filter(ids.is_strict_uuid("read_id"))


@_query(f"SELECT {_U('read_id')} AS read_id, {_ACQ('run_info')} AS acquisition_id, num_samples FROM read_rows UNION ALL SELECT CASE WHEN {_VALID} THEN {_U(f'unhex({_DIGITS})')} END, {_ACQ('acquisition_id')}, num_samples FROM file_records")
def merge_union(spark, sf):
    reads = table(spark, sf, "read_rows").select(ids.uuid_str("read_id").alias("read_id"), acquisition_key("run_info").alias("acquisition_id"), "num_samples")
    stored = _stored(spark, sf).select(ids.uuid_str(ids.uuid_bin("read_id")).alias("read_id"), "acquisition_id", "num_samples")
    return merge.merge([reads, stored], check=False)


@_query(f"SELECT {_U('read_id')} AS read_id, count(*) AS n_rows FROM read_rows WHERE read_id IS NOT NULL GROUP BY read_id HAVING count(*) > 1")
def duplicate_ids(spark, sf):
    return select.repeated_ids(table(spark, sf, "read_rows")).select(ids.uuid_str("read_id").alias("read_id"), "n_rows")


@_query(f"""SELECT {_U('read_id')} AS read_id, count(*) AS n_chunks, sum(samples)::BIGINT AS sample_count, sum(2 * len(signal))::BIGINT AS byte_count,
sum(2 * len(signal))::BIGINT::DOUBLE / nullif(2 * sum(samples)::BIGINT, 0) AS compression_ratio FROM signal_rows GROUP BY read_id""")
def per_read_sizes(spark, sf):
    return aggregate.per_read(_signal(spark, sf)).withColumn("read_id", ids.uuid_str("read_id"))


@_query(f"SELECT {_U('read_id')} AS read_id, coalesce(sum(list_sum(signal)), 0)::BIGINT AS signal_sum FROM signal_rows GROUP BY read_id")
def signal_sum(spark, sf):
    return aggregate.signal_sums(_signal(spark, sf)).withColumn("read_id", ids.uuid_str("read_id"))


@_query(f"""SELECT n_reads, n_batches, n_samples, first_sample, last_sample, n_run_infos, n_bytes, 100 * n_bytes::DOUBLE / nullif(2 * n_stored, 0) AS percent_compressed FROM
(SELECT count(*) AS n_reads, count(DISTINCT batch_id) AS n_batches, coalesce(sum(num_samples), 0)::BIGINT AS n_samples, min(start) AS first_sample, max(start + num_samples) AS last_sample, count(DISTINCT {_ACQ('run_info')}) AS n_run_infos FROM read_rows),
(SELECT coalesce(sum(2 * len(signal)), 0)::BIGINT AS n_bytes, coalesce(sum(samples), 0)::BIGINT AS n_stored FROM signal_rows)""")
def debug_summary(spark, sf):
    return aggregate.debug_summary(table(spark, sf, "read_rows"), _signal(spark, sf), ["batch_id"])


@_query("SELECT batch_id, count(*) AS n_reads FROM read_rows GROUP BY 1")
def batch_sizes(spark, sf):
    return aggregate.batch_sizes(table(spark, sf, "read_rows"), "batch_id")


@_query(f"SELECT DISTINCT {_ACQ('run_info')} AS run_info FROM read_rows WHERE run_info IS NOT NULL")
def distinct_run_infos(spark, sf):
    return aggregate.distinct_run_infos(table(spark, sf, "read_rows"))


@_query("SELECT acquisition_id, count(DISTINCT (sample_id, experiment_name, flow_cell_id, software, system_name)) AS n_rows FROM run_info GROUP BY 1 HAVING count(DISTINCT (sample_id, experiment_name, flow_cell_id, software, system_name)) > 1")
def conflicting_acquisitions(spark, sf):
    return view.conflicting_acquisitions(_info(spark, sf), ["sample_id", "experiment_name", "flow_cell_id", "software", "system_name"])


@_query("""WITH refs AS (SELECT row_id, unnest(signal) AS row_no, unnest(range(len(signal))) AS position FROM read_rows WHERE len(signal) > 0),
parts AS (SELECT refs.row_id, position, s.signal FROM refs JOIN signal_rows s USING (row_no) WHERE s.signal IS NOT NULL),
whole AS (SELECT row_id, array_to_string(flatten(list(signal ORDER BY position)), ',') AS signal, count(*) AS n FROM parts GROUP BY row_id)
SELECT r.row_id, coalesce(w.signal, '') AS signal, coalesce(w.n, 0) = coalesce(len(r.signal), 0) AS complete FROM read_rows r LEFT JOIN whole w USING (row_id)""")
def reassemble(spark, sf):
    whole = signal.reassemble(table(spark, sf, "read_rows").select("row_id", "signal"), _signal(spark, sf), ["row_id"])
    return whole.select("row_id", F.array_join("signal", ",").alias("signal"), "complete")


@_query("SELECT row_no, len(signal) AS length, list_sum(signal)::BIGINT AS total FROM signal_rows")
def signal_length(spark, sf):
    return _signal(spark, sf).select("row_no", sig.signal_length("signal").alias("length"), sig.signal_sum("signal").alias("total"))


@_query("""WITH refs AS (SELECT row_id, calibration_offset AS o, calibration_scale AS c, unnest(signal) AS row_no, unnest(range(len(signal))) AS position FROM read_rows WHERE len(signal) > 0)
SELECT row_id, position, list_min(list_transform(signal, lambda x: (x::FLOAT + o) * c)) AS lowest_pa, list_max(list_transform(signal, lambda x: (x::FLOAT + o) * c)) AS highest_pa FROM refs JOIN signal_rows USING (row_no)""")
def calibrate(spark, sf):
    reads = table(spark, sf, "read_rows").select("row_id", "calibration_offset", "calibration_scale", "signal")
    chunks = signal.chunks_of_reads(reads, _signal(spark, sf), ["row_id", "calibration_offset", "calibration_scale"], ["signal"])
    levels = chunks.withColumn("pa", sig.calibrate("signal", "calibration_offset", "calibration_scale"))
    return levels.select("row_id", F.col("position").cast("long").alias("position"), F.array_min("pa").alias("lowest_pa"), F.array_max("pa").alias("highest_pa"))


@_query("SELECT info_id, adc_max::INT - adc_min::INT + 1 AS digitisation, 0.18::DOUBLE * (adc_max::INT - adc_min::INT + 1) AS calibration_range, 1400.0::DOUBLE / nullif(adc_max::INT - adc_min::INT + 1, 0) AS scale_of_1400, CASE WHEN adc_max::INT - adc_min::INT + 1 = 8192 THEN -4096 ELSE 0 END AS guessed_min FROM run_info")
def digitisation(spark, sf):
    digits = sig.digitisation("adc_max", "adc_min")
    return _info(spark, sf).select(
        "info_id", digits.alias("digitisation"), sig.calibration_range(F.lit(0.18), "adc_max", "adc_min").alias("calibration_range"),
        sig.scale_from_range(F.lit(1400.0), digits).alias("scale_of_1400"), records.guessed_adc(digits)["adc_min"].alias("guessed_min"),
    )


@_query("SELECT row_no, position, array_to_string(signal[position * 50 + 1 : position * 50 + 50], ',') AS signal FROM (SELECT row_no, signal, unnest(range((len(signal) + 49) // 50)) AS position FROM signal_rows)")
def chunk_signal(spark, sf):
    return signal.rechunk(_signal(spark, sf).select("row_no", "signal"), ["row_no"], 50).select("row_no", F.col("position").cast("long").alias("position"), F.array_join("signal", ",").alias("signal"))


@_query("SELECT row_no, array_to_string(signal[51:100], ',') AS signal FROM signal_rows WHERE len(signal) > 50")
def chunk_fetch(spark, sf):
    second = sig.chunk_at(sig.chunked("signal", 50), 1)
    return _signal(spark, sf).select("row_no", second.alias("signal")).filter("signal IS NOT NULL").select("row_no", F.array_join("signal", ",").alias("signal"))


@_query(f"""SELECT row_no, len(signal) AS n, CASE WHEN len(signal) > 0 THEN (len(signal) - 1)::DOUBLE / nullif(rate, 0) END AS last_second
FROM signal_rows JOIN (SELECT {_ACQ('acquisition_id')} AS acquisition, max(sample_rate) AS rate FROM run_info GROUP BY 1) ON {_ACQ('acquisition_id')} = acquisition""")
def time_axis(spark, sf):
    rates = _info(spark, sf).groupBy(acquisition_key("acquisition_id").alias("acquisition_id")).agg(F.max("sample_rate").alias("rate"))
    joined = _signal(spark, sf).withColumn("acquisition_id", acquisition_key("acquisition_id")).join(rates, "acquisition_id")
    return joined.select("row_no", sig.signal_length("signal").alias("n"), F.try_element_at(sig.time_axis("signal", "rate"), F.lit(-1)).alias("last_second"))


_CODE = "CASE end_reason " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(records.END_REASONS)) + " ELSE 0 END"


@_query(f"""SELECT row_id, {_CODE} AS code, end_reason AS name, coalesce(end_reason, 'unknown') NOT IN ('unknown', 'signal_positive', 'signal_negative') AS forced,
CASE WHEN {_CODE} = 0 THEN 0 ELSE {_CODE} + 1 END AS legacy_code, end_reason AS name_of_legacy FROM read_rows""")
def end_reason_codes(spark, sf):
    code = records.end_reason_code("end_reason")
    legacy = records.legacy_code_of_end_reason("end_reason")
    return table(spark, sf, "read_rows").select("row_id", code.alias("code"), records.end_reason_name(code).alias("name"), records.forced_by_default("end_reason").alias("forced"), legacy.alias("legacy_code"), records.end_reason_of_legacy_code(legacy).alias("name_of_legacy"))


@_query("SELECT row_id, dense_rank() OVER (ORDER BY end_reason) - 1 AS end_reason_index FROM read_rows WHERE end_reason IS NOT NULL UNION ALL SELECT row_id, NULL FROM read_rows WHERE end_reason IS NULL")
def dictionary_index(spark, sf):
    return records.dictionary_index(table(spark, sf, "read_rows").select("row_id", "end_reason"), ["end_reason"]).select("row_id", "end_reason_index")


@_query("SELECT info_id, v[1]::INT AS major, v[2]::INT AS minor, v[3]::INT AS patch, v[1]::INT > 4 OR v[1]::INT = 4 AND v[2]::INT >= 5 AS newer FROM (SELECT info_id, string_split(string_split(software, ' ')[2], '.') AS v FROM run_info)")
def version_compare(spark, sf):
    version = records.version_parts(F.try_element_at(F.split("software", " "), F.lit(2)))
    rows = _info(spark, sf).select("info_id", version.alias("v"))
    return rows.select("info_id", "v.major", "v.minor", "v.patch", (F.col("v") >= records.version_parts(F.lit("4.5.0"))).alias("newer"))


@_query("SELECT info_id, epoch_ms(acquisition_start_time) AS acquisition_ms, epoch_ms(protocol_start_time) AS protocol_ms, epoch_ms(acquisition_start_time) AS again_ms FROM run_info")
def times_in_ms(spark, sf):
    ms = records.epoch_millis("acquisition_start_time")
    return _info(spark, sf).select("info_id", ms.alias("acquisition_ms"), records.epoch_millis("protocol_start_time").alias("protocol_ms"), records.epoch_millis(records.of_epoch_millis(ms)).alias("again_ms"))


@_query("SELECT file_id, coalesce(epoch_ms(TRY_CAST(substr(file_path, 7, 4) || '-' || substr(file_path, 11, 2) || '-' || substr(file_path, 13, 2) AS TIMESTAMP)), 0) AS day_ms FROM container_files")
def lenient_times(spark, sf):
    text = F.concat(F.substring("file_path", 7, 4), F.lit("-"), F.substring("file_path", 11, 2), F.lit("-"), F.substring("file_path", 13, 2))
    return table(spark, sf, "container_files").select("file_id", records.epoch_millis(records.lenient_timestamp(text)).alias("day_ms"))


@_query("SELECT info_id, coalesce(tracking_id['asic_temp'], '') AS asic_temp, coalesce(context_tags['basecall'], 'none') AS basecall FROM run_info")
def map_defaults(spark, sf):
    return _info(spark, sf).select("info_id", records.map_get("tracking_id", "asic_temp").alias("asic_temp"), records.map_get("context_tags", "basecall", "none").alias("basecall"))


@_query("SELECT info_id, (SELECT string_agg(e.key || '=' || e.value, ';' ORDER BY e.key) FROM (SELECT unnest(map_entries(tracking_id)) AS e)) AS pairs FROM run_info")
def map_pairs(spark, sf):
    back = records.pairs(records.of_pairs(records.pairs("tracking_id")))
    text = F.array_join(F.transform(back, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return _info(spark, sf).select("info_id", F.when(text != "", text).alias("pairs"))


@_query("SELECT row_id, num_minknow_events, scale_unknown, num_reads_since_mux_change, time_since_mux_change FROM (SELECT row_id, 0::BIGINT AS num_minknow_events, TRUE AS scale_unknown, 0::BIGINT AS num_reads_since_mux_change, 0::FLOAT AS time_since_mux_change FROM read_rows)")
def migrate_v0(spark, sf):
    oldest = table(spark, sf, "read_rows").select("row_id", "read_id", "signal", "read_number", "start", "median_before")
    return migrate.v0_to_v1(oldest).select("row_id", "num_minknow_events", F.isnan("tracked_scaling_scale").alias("scale_unknown"), "num_reads_since_mux_change", "time_since_mux_change")


@_query("""WITH refs AS (SELECT row_id, unnest(signal) AS row_no FROM read_rows), sums AS (SELECT row_id, coalesce(sum(samples), 0)::BIGINT AS n FROM refs LEFT JOIN signal_rows USING (row_no) GROUP BY row_id)
SELECT row_id, coalesce(n, 0) AS num_samples FROM read_rows LEFT JOIN sums USING (row_id)""")
def migrate_v1(spark, sf):
    older = table(spark, sf, "read_rows").select("row_id", "signal")
    return migrate.v1_to_v2(older, _signal(spark, sf), ["row_id"], strict=False).select("row_id", "num_samples")


@_query("SELECT row_id, channel, well, pore_type, end_reason, end_reason_forced, run_info FROM read_rows")
def migrate_v2(spark, sf):
    rows = table(spark, sf, "read_rows")
    old = rows.select("row_id", F.struct(F.col("calibration_offset").alias("offset"), F.col("calibration_scale").alias("scale")).alias("calibration"), F.struct("channel", "well", "pore_type").alias("pore"), F.struct(F.col("end_reason").alias("name"), F.col("end_reason_forced").alias("forced")).alias("end_reason"), F.struct(F.col("run_info").alias("acquisition_id")).alias("run_info"))
    return migrate.v2_to_v3(old)[0].select("row_id", "channel", "well", "pore_type", "end_reason", "end_reason_forced", "run_info")


@_query("SELECT row_id, TRUE AS level_unknown FROM read_rows")
def migrate_v3(spark, sf):
    return migrate.v3_to_v4(table(spark, sf, "read_rows").drop("open_pore_level")).select("row_id", F.isnan("open_pore_level").alias("level_unknown"))


@_query("SELECT row_no, TRUE AS intact FROM signal_rows WHERE signal IS NOT NULL")
def vbz_round_trip(spark, sf):
    packed = _signal(spark, sf).filter("signal IS NOT NULL").select("row_no", "signal", codec.vbz_encode("signal").alias("packed"), F.size("signal").cast("long").alias("n"))
    return packed.select("row_no", (codec.vbz_decode("packed", "n") == F.col("signal")).alias("intact"))


@_query("SELECT row_no, inner_size + (inner_size >> 8) + CASE WHEN inner_size < 131072 THEN (131072 - inner_size) >> 11 ELSE 0 END AS max_size FROM (SELECT row_no, ((samples + 7) >> 3) + 2 * samples AS inner_size FROM signal_rows)")
def vbz_max_size(spark, sf):
    return _signal(spark, sf).select("row_no", sig.vbz_max_size("samples").alias("max_size"))


@_query("""WITH firsts AS (SELECT read_id, min(row_id) AS first_id FROM read_rows GROUP BY 1)
SELECT r.row_id, r.channel IS NOT DISTINCT FROM f.channel AND r.start IS NOT DISTINCT FROM f.start AND r.median_before IS NOT DISTINCT FROM f.median_before AS same
FROM read_rows r JOIN firsts USING (read_id) JOIN read_rows f ON f.row_id = first_id""")
def null_safe_equal(spark, sf):
    fields = ["channel", "start", "median_before"]
    rows = table(spark, sf, "read_rows").select("row_id", "read_id", *fields)
    firsts = rows.groupBy("read_id").agg(F.min_by(F.struct(*fields), "row_id").alias("first"))
    joined = rows.join(firsts, "read_id")
    return joined.select("row_id", records.same_record({c: F.col(c) for c in fields}, {c: F.col(f"first.{c}") for c in fields}).alias("same"))


@_query("SELECT acquisition_id, count(*) AS n_rows FROM (SELECT DISTINCT acquisition_id, adc_max, adc_min, sample_rate, sample_id, list_sort(map_entries(tracking_id)) AS t FROM run_info) GROUP BY 1")
def merge_dimension(spark, sf):
    info = _info(spark, sf).select("acquisition_id", "adc_max", "adc_min", "sample_rate", "sample_id", "tracking_id")
    return merge.dimension_upsert(info, info).groupBy("acquisition_id").agg(F.count(F.lit(1)).alias("n_rows"))


@_query(f"SELECT DISTINCT {_ACQ('run_info')} AS run_info FROM read_rows WHERE {_ACQ('run_info')} NOT IN (SELECT {_ACQ('acquisition_id')} FROM run_info WHERE acquisition_id IS NOT NULL)")
def unknown_run_infos(spark, sf):
    known = _info(spark, sf).select(acquisition_key("acquisition_id").alias("run_info")).distinct()
    return aggregate.distinct_run_infos(table(spark, sf, "read_rows")).join(known, "run_info", "left_anti")


@_query("SELECT row_no, row_no // 100 AS batch, row_no % 100 AS batch_row, samples, 2 * len(signal) AS n_bytes FROM signal_rows")
def signal_row_info(spark, sf):
    return signal.row_info(_signal(spark, sf), 100)


@_query(f"""WITH sizes AS (SELECT read_id, sum(2 * len(signal))::BIGINT AS byte_count, sum(samples)::BIGINT AS sample_count FROM signal_rows GROUP BY 1)
SELECT row_id, {_U('r.read_id')} AS read_id, channel, well, pore_type, read_number, start AS start_sample, end_reason, num_samples, byte_count, num_minknow_events, num_reads_since_mux_change
FROM read_rows r LEFT JOIN sizes USING (read_id)""")
def inspect_reads(spark, sf):
    sizes = aggregate.per_read(_signal(spark, sf)).select("read_id", "byte_count")
    rows = table(spark, sf, "read_rows").join(sizes, "read_id", "left")
    return rows.select("row_id", ids.uuid_str("read_id").alias("read_id"), "channel", "well", "pore_type", "read_number", F.col("start").alias("start_sample"), "end_reason", "num_samples", "byte_count", "num_minknow_events", "num_reads_since_mux_change")


@_query(f"SELECT row_id, {', '.join(c if c not in ('read_id', 'signal') else (_U('read_id') + ' AS read_id' if c == 'read_id' else 'len(signal) AS signal') for c in READS_V3 if 'scaling' not in c and 'before' not in c and 'time' not in c)} FROM read_rows")
def columns_v3(spark, sf):
    kept = [c for c in READS_V3 if "scaling" not in c and "before" not in c and "time" not in c]
    special = {"read_id": ids.uuid_str("read_id").alias("read_id"), "signal": F.when(F.col("signal").isNotNull(), F.size("signal").cast("long")).alias("signal")}
    return table(spark, sf, "read_rows").select("row_id", *[special.get(c, F.col(c)) for c in kept])


@_query("SELECT row_id, round(median_before::DOUBLE, 3) AS median_before FROM read_rows WHERE isfinite(median_before)")
def rounded_levels(spark, sf):
    return table(spark, sf, "read_rows").filter("median_before IS NOT NULL AND NOT isnan(median_before)").select("row_id", records.fixed("median_before", 3).cast("double").alias("median_before"))


@_query(f"""WITH refs AS (SELECT row_id, unnest(signal) AS row_no FROM read_rows), sums AS (SELECT row_id, sum(len(s.signal))::BIGINT AS n, sum(list_sum(s.signal))::BIGINT AS total FROM refs JOIN signal_rows s USING (row_no) WHERE s.signal IS NOT NULL GROUP BY row_id)
SELECT {_U('read_id')} AS read_id, read_number, coalesce(n, 0) AS num_samples, coalesce(total, 0) AS signal_sum FROM read_rows LEFT JOIN sums USING (row_id) WHERE {_ACQ('run_info')} IN (SELECT {_ACQ('acquisition_id')} FROM run_info)""")
def container_round_trip(spark, sf):
    """Reads written as containers into the shared folder, and read from there again."""
    reads = table(spark, sf, "read_rows").withColumn("run_info", acquisition_key("run_info"))
    whole = signal.reassemble(reads.select("row_id", "signal"), _signal(spark, sf), ["row_id"]).drop("complete")
    info = checkpoint(_info(spark, sf).select(*RUN_INFO_COLUMNS).withColumn("acquisition_id", acquisition_key("acquisition_id")).dropDuplicates(["acquisition_id"]))
    info = broadcast_if_small(info.select(F.col("acquisition_id").alias("_a"), F.struct(*RUN_INFO_COLUMNS).alias("info")), 20_000)
    path = work_path(spark, "containers")
    write(reads.drop("signal").join(whole, "row_id").join(info, F.col("run_info") == F.col("_a")), path)
    stored = ReadStore(spark, path).complete(decode=True)
    return stored.select(ids.uuid_str("read_id").alias("read_id"), "read_number", "num_samples", sig.signal_sum("signal").alias("signal_sum"))


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
