"""Queries of the operators on containers and on files that name reads, each over its whole tables, with their SQL.

The tables are written as containers into the shared folder once for each session and folder; what is queried is read from there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import codec
from ..functions import ids
from ..functions import signal as sig
from ..functions.keys import acquisition_key
from ..operators import aggregate, merge, migrate, route, select, signal, view
from ..schema import READS_V4, RUN_INFO_COLUMNS
from ..session import broadcast_if_small, checkpoint, exists, table, work_path
from ..sources import mapping
from ..sources.container import ReadStore, write
from ..sources.repack import differences
from .reference import _ACQ, _BAG, _DIGITS, _STRICT, _U, _VALID, _no_nan

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        _QUERIES[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return add


_STORES: dict[tuple[str, str], str] = {}


def rows_to_write(spark: SparkSession, sf: str) -> DataFrame:
    """Reads with their whole signal and run information, of the acquisitions that there is one for."""
    reads = table(spark, sf, "read_rows").withColumn("run_info", acquisition_key("run_info"))
    whole = signal.reassemble(reads.select("row_id", "signal"), table(spark, sf, "signal_rows"), ["row_id"]).drop("complete")
    info = table(spark, sf, "run_info").withColumn("acquisition_id", acquisition_key("acquisition_id")).dropna(subset=["acquisition_id"])
    first = info.groupBy(F.col("acquisition_id").alias("_a")).agg(F.min_by(F.struct(*RUN_INFO_COLUMNS), "info_id").alias("info"))
    return reads.drop("signal").join(whole, "row_id").join(broadcast_if_small(checkpoint(first), 20_000), F.col("run_info") == F.col("_a")).drop("_a")


def stored(spark: SparkSession, sf: str) -> ReadStore:
    key = spark.sparkContext.applicationId, sf
    if key not in _STORES or not exists(spark, _STORES[key]):
        path = work_path(spark, "store")
        write(rows_to_write(spark, sf), path)
        _STORES[key] = path
    return ReadStore(spark, _STORES[key])


_INFO = f"infos AS (SELECT acquisition, min_by(i, info_id) AS i FROM (SELECT info_id, {_ACQ('acquisition_id')} AS acquisition, run_info AS i FROM run_info WHERE acquisition_id IS NOT NULL) GROUP BY acquisition)"
_KNOWN = f"kept AS (SELECT * FROM read_rows WHERE {_ACQ('run_info')} IN (SELECT {_ACQ('acquisition_id')} FROM run_info WHERE acquisition_id IS NOT NULL))"
_SUMS = "sums AS (SELECT row_id, sum(len(s.signal))::BIGINT AS n, sum(list_sum(s.signal))::BIGINT AS total FROM (SELECT row_id, unnest(signal) AS row_no FROM kept) JOIN signal_rows s USING (row_no) WHERE s.signal IS NOT NULL GROUP BY row_id)"
#: Columns of reads as the writer leaves them: no nulls but NaN, which comes out as null here.
_PLAIN_READS = {"read_number": "0", "start": "0", "num_minknow_events": "0", "num_reads_since_mux_change": "0", "channel": "0", "well": "0", "pore_type": "''", "end_reason": "''", "end_reason_forced": "FALSE"}
_FLOAT_READS = [c for c in READS_V4 if c not in _PLAIN_READS and c not in ("read_id", "signal", "num_samples", "run_info")]


@_query(f"""WITH {_KNOWN}, {_SUMS} SELECT {_U('coalesce(read_id, unhex(repeat(chr(48), 32)))')} AS read_id, {', '.join(f'coalesce({c}, {x}) AS {c}' for c, x in _PLAIN_READS.items())},
{', '.join(f'CASE WHEN isfinite({c}) THEN {c} END AS {c}' for c in _FLOAT_READS)}, {_ACQ('run_info')} AS run_info, coalesce(n, 0) AS num_samples FROM kept LEFT JOIN sums USING (row_id)""")
def store_reads(spark, sf):
    reads = stored(spark, sf).table("reads", ["read_id", *_PLAIN_READS, *_FLOAT_READS, "run_info", "num_samples"])
    return _no_nan(reads.withColumn("read_id", ids.uuid_str("read_id")))


@_query(f"WITH {_KNOWN} SELECT {_U('coalesce(read_id, unhex(repeat(chr(48), 32)))')} AS read_id FROM kept")
def store_ids(spark, sf):
    return stored(spark, sf).read_ids()


@_query(f"WITH {_KNOWN}, {_SUMS} SELECT (SELECT count(*) FROM kept) AS n_reads, (SELECT count(*) FROM sums WHERE n > 0) AS n_signal_rows, 4 AS least_version, TRUE AS all_packed")
def store_summary(spark, sf):
    files = stored(spark, sf).files()
    return files.agg(F.sum("n_reads").alias("n_reads"), F.sum("n_signal_rows").alias("n_signal_rows"), F.min("table_version").alias("least_version"), F.bool_and("packed").alias("all_packed"))


@_query(f"WITH {_KNOWN} SELECT count(*) AS n_reads FROM kept")
def store_count(spark, sf):
    return spark.createDataFrame([(stored(spark, sf).num_reads(),)], "n_reads long")


@_query(f"WITH {_KNOWN}, {_SUMS} SELECT {_U('coalesce(read_id, unhex(repeat(chr(48), 32)))')} AS read_id, n AS samples, total AS signal_sum, TRUE AS has_bytes FROM kept JOIN sums USING (row_id) WHERE n > 0")
def store_signal(spark, sf):
    chunks = stored(spark, sf).signal(columns=["read_id", "signal", "samples", "n_bytes"])
    return chunks.select(ids.uuid_str("read_id").alias("read_id"), "samples", sig.signal_sum("signal").alias("signal_sum"), (F.col("n_bytes") > 0).alias("has_bytes"))


_TEXTS = [c for c in RUN_INFO_COLUMNS if c not in ("acquisition_id", "acquisition_start_time", "adc_max", "adc_min", "context_tags", "protocol_start_time", "sample_rate", "tracking_id")]
_PAIRS = "coalesce((SELECT string_agg(e.key || '=' || e.value, ';' ORDER BY e.key) FROM (SELECT unnest(map_entries(i.{0})) AS e)), '') AS {0}".format


@_query(f"""WITH {_KNOWN}, {_INFO} SELECT acquisition AS acquisition_id, epoch_ms(i.acquisition_start_time) AS acquisition_ms, epoch_ms(i.protocol_start_time) AS protocol_ms, coalesce(i.adc_max, 0) AS adc_max, coalesce(i.adc_min, 0) AS adc_min,
coalesce(i.sample_rate, 0) AS sample_rate, {', '.join(f"coalesce(i.{c}, '') AS {c}" for c in _TEXTS)}, {_PAIRS('context_tags')}, {_PAIRS('tracking_id')} FROM infos WHERE acquisition IN (SELECT {_ACQ('run_info')} FROM kept)""")
def store_run_info(spark, sf):
    info = stored(spark, sf).run_info().drop("_file", "_batch", "_row")
    pairs = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias(c)
    ms = lambda c: F.unix_millis(c)
    plain = info.select("acquisition_id", ms("acquisition_start_time").alias("acquisition_ms"), ms("protocol_start_time").alias("protocol_ms"), "adc_max", "adc_min", "sample_rate", *_TEXTS, pairs("context_tags"), pairs("tracking_id"))
    return plain.distinct()  # each file holds those of its reads


@_query(f"""WITH {_KNOWN}, {_INFO}, {_SUMS} SELECT {_U('coalesce(read_id, unhex(repeat(chr(48), 32)))')} AS read_id, coalesce(n, 0)::DOUBLE / nullif(coalesce(i.sample_rate, 0), 0) AS duration, coalesce(i.sample_rate, 0) AS sample_rate,
CASE WHEN coalesce(i.sample_id, '') = '' THEN 'not_set' ELSE i.sample_id END AS sample_id FROM kept LEFT JOIN sums USING (row_id) JOIN infos ON acquisition = {_ACQ('run_info')}""")
def store_view(spark, sf):
    return stored(spark, sf).view(include="read_id, duration, sample_rate, sample_id")


@_query(f"WITH {_KNOWN}, {_SUMS} SELECT {_U('coalesce(read_id, unhex(repeat(chr(48), 32)))')} AS read_id, coalesce(n, 0) AS num_samples, coalesce(total, 0) AS signal_sum FROM kept LEFT JOIN sums USING (row_id)")
def store_plain(spark, sf):
    """Containers of unpacked signal, written from the packed chunks of the others."""
    path = work_path(spark, "plain")
    write(stored(spark, sf).complete(), path, encoding="plain")
    return ReadStore(spark, path).complete(decode=True).select(ids.uuid_str("read_id").alias("read_id"), "num_samples", sig.signal_sum("signal").alias("signal_sum"))


@_query(f"WITH {_KNOWN} SELECT 0 AS n_differing, count(*) AS n_reads FROM kept")
def repack_equal(spark, sf):
    """Containers copied as packed chunks, one output for each input, and held against the inputs read by read."""
    store, path = stored(spark, sf), work_path(spark, "repacked")
    write(store.complete().withColumn("dest", F.element_at(F.split("_file", "/"), -1)), path)
    again = ReadStore(spark, path)
    return differences(store, again).agg(F.count(F.lit(1)).alias("n_differing")).withColumn("n_reads", F.lit(again.num_reads()))


@_query(f"WITH {_KNOWN} SELECT 'acq-' || {_ACQ('run_info')} || '.container' AS filename, count(*) AS n_reads FROM kept GROUP BY 1")
def subset_written(spark, sf):
    """One output for each acquisition, written and counted by file."""
    path = work_path(spark, "subset")
    write(stored(spark, sf).complete().withColumn("dest", F.concat(F.lit("acq-"), "run_info", F.lit(".container"))), path)
    return ReadStore(spark, path).view(include="filename").groupBy("filename").agg(F.count(F.lit(1)).alias("n_reads"))


@_query(f"WITH {_BAG}, {_KNOWN} SELECT DISTINCT {_U('read_id')} AS read_id FROM kept WHERE read_id IN (SELECT id FROM bag)")
def store_selected(spark, sf):
    chosen = select.pack_ids(table(spark, sf, "file_records").select("read_id")).distinct()
    return stored(spark, sf).reads(columns=["read_id"], selection=chosen, missing_ok=True).select(ids.uuid_str("read_id").alias("read_id")).distinct()


@_query(f"WITH {_BAG} SELECT DISTINCT {_U('read_id')} AS read_id, 'store/batch_' || batch_id || '.container' AS filename FROM read_rows WHERE read_id IN (SELECT id FROM bag)")
def paths_of_ids(spark, sf):
    reads = table(spark, sf, "read_rows").select("read_id", F.concat(F.lit("store/batch_"), F.col("batch_id"), F.lit(".container")).alias("_file"))
    chosen = select.pack_ids(table(spark, sf, "file_records").select("read_id"))
    return select.paths_of(reads, chosen).select(ids.uuid_str("read_id").alias("read_id"), F.col("_file").alias("filename"))


def _texts(spark: SparkSession, rows: DataFrame, name: str, **options: str) -> str:
    path = work_path(spark, name)
    rows.write.options(**options).csv(path)
    return path


@_query(f"SELECT DISTINCT read_id FROM file_records WHERE {_STRICT}")
def id_list(spark, sf):
    return mapping.read_id_list(spark, _texts(spark, table(spark, sf, "file_records").select("read_id"), "ids"))


@_query(f"SELECT 'acq-' || {_ACQ('acquisition_id')} AS dest, read_id FROM file_records WHERE acquisition_id IS NOT NULL AND {_STRICT}")
def csv_mapping(spark, sf):
    rows = table(spark, sf, "file_records").select(F.concat(F.lit("acq-"), acquisition_key("acquisition_id")).alias("dest"), "read_id")
    return mapping.read_csv_mapping(spark, _texts(spark, rows, "mapping"))


@_query(f"SELECT read_id, seq_no::VARCHAR AS seq_no, num_samples::VARCHAR AS num_samples FROM file_records WHERE {_STRICT}")
def table_mapping(spark, sf):
    path = _texts(spark, table(spark, sf, "file_records").select("record_id", "read_id", "seq_no", "num_samples"), "table", header="true", sep="\t")
    rows = mapping.read_table(spark, path, ["seq_no", "num_samples"])
    return rows.filter(ids.is_strict_uuid("read_id"))


@_query(f"""SELECT {_U('read_id')} AS read_id, channel::VARCHAR AS channel, CASE WHEN isnan(median_before) THEN 'NaN' ELSE printf('%.8f', median_before::DOUBLE) END AS median_before, end_reason FROM read_rows""")
def view_tsv(spark, sf):
    """A view written as text and read again."""
    path = work_path(spark, "view")
    view.write_view(view.view(table(spark, sf, "read_rows"), include="read_id, channel, median_before, end_reason"), path)
    return spark.read.csv(path, sep="\t", header=True)


@_query(f"""WITH {_INFO} SELECT row_id, acquisition IS NOT NULL AS found, i.sample_rate AS sample_rate FROM read_rows LEFT JOIN (SELECT DISTINCT acquisition, min(i.sample_rate) OVER (PARTITION BY acquisition) AS x, i FROM infos) ON acquisition = {_ACQ('run_info')}""")
def run_info_lookup(spark, sf):
    info = table(spark, sf, "run_info").withColumn("acquisition_id", acquisition_key("acquisition_id"))
    first = info.groupBy("acquisition_id").agg(F.min_by("sample_rate", "info_id").alias("sample_rate"))
    joined = merge.with_run_info(table(spark, sf, "read_rows").select("row_id", "run_info"), first, strict=False)
    return joined.select("row_id", F.col("info").isNotNull().alias("found"), "info.sample_rate")


@_query("SELECT row_id, TRUE AS intact FROM (SELECT row_id, unnest(signal) AS row_no FROM read_rows) JOIN signal_rows s USING (row_no) WHERE s.signal IS NOT NULL GROUP BY row_id")
def chunked_decode(spark, sf):
    """Each read's chunks packed, unpacked one by one, and put together."""
    reads = table(spark, sf, "read_rows").select("row_id", "signal")
    packed = table(spark, sf, "signal_rows").filter("signal IS NOT NULL").select("row_no", "signal", codec.vbz_encode("signal").alias("packed"), F.size("signal").cast("long").alias("n"))
    chunks = signal.chunks_of_reads(reads, packed, ["row_id"], ["signal", "packed", "n"])
    both = chunks.select("row_id", "position", "signal", codec.vbz_decode("packed", "n").alias("again"))
    whole = both.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("position", "signal", "again"))).alias("c"))
    return whole.select("row_id", (F.flatten("c.signal") == F.flatten("c.again")).alias("intact"))


@_query(f"""WITH refs AS (SELECT row_id, unnest(signal) AS row_no FROM read_rows), sums AS (SELECT row_id, coalesce(sum(samples), 0)::BIGINT AS n FROM refs JOIN signal_rows USING (row_no) GROUP BY row_id)
SELECT row_id, {_U('read_id')} AS read_id, read_number, start, CASE WHEN isfinite(median_before) THEN median_before END AS median_before, 0::BIGINT AS num_minknow_events, 0::BIGINT AS num_reads_since_mux_change, 0::FLOAT AS time_since_mux_change, TRUE AS unknown,
coalesce(n, 0) AS num_samples, channel, well, pore_type, CASE WHEN isfinite(calibration_offset) THEN calibration_offset END AS calibration_offset, CASE WHEN isfinite(calibration_scale) THEN calibration_scale END AS calibration_scale, end_reason, end_reason_forced, run_info
FROM read_rows LEFT JOIN sums USING (row_id) WHERE signal IS NULL OR len(list_filter(signal, x -> x NOT IN (SELECT row_no FROM signal_rows))) = 0""")
def migrate_all(spark, sf):
    """Reads of the oldest version brought through every step; those with references that the signal table lacks are left out, as they raise."""
    rows, chunks = table(spark, sf, "read_rows"), table(spark, sf, "signal_rows")
    broken = rows.select("row_id", F.explode("signal").alias("row_no")).join(chunks.select("row_no"), "row_no", "left_anti").select("row_id").distinct()
    old = rows.join(broken, "row_id", "left_anti").select(
        "row_id", "read_id", "signal", "read_number", "start", "median_before", F.struct(F.col("calibration_offset").alias("offset"), F.col("calibration_scale").alias("scale")).alias("calibration"), F.struct("channel", "well", "pore_type").alias("pore"),
        F.struct(F.col("end_reason").alias("name"), F.col("end_reason_forced").alias("forced")).alias("end_reason"), F.struct(F.col("run_info").alias("acquisition_id")).alias("run_info"),
    )
    new, _ = migrate.migrate(old, 0, chunks, ["row_id"])
    unknown = F.lit(True)
    for c in ("tracked_scaling_scale", "tracked_scaling_shift", "predicted_scaling_scale", "predicted_scaling_shift", "open_pore_level"):
        unknown = unknown & F.isnan(c)
    kept = ["read_number", "start", "median_before", "num_minknow_events", "num_reads_since_mux_change", "time_since_mux_change", "num_samples", "channel", "well", "pore_type", "calibration_offset", "calibration_scale", "end_reason", "end_reason_forced", "run_info"]
    return _no_nan(new.select("row_id", ids.uuid_str("read_id").alias("read_id"), unknown.alias("unknown"), *kept))


@_query("SELECT count(DISTINCT read_id) AS n_ids, count(*) > count(DISTINCT read_id) AS repeated, 2 * sum(num_samples)::BIGINT AS n_bytes FROM read_rows WHERE read_id IS NOT NULL")
def uniqueness(spark, sf):
    rows = table(spark, sf, "read_rows").filter("read_id IS NOT NULL")
    sums = rows.agg(F.countDistinct("read_id").alias("n_ids"), F.sum("num_samples").alias("n")).first()
    return spark.createDataFrame([(sums.n_ids, select.has_duplicate(rows), round(aggregate.throughput(sums.n, 1.0)[0] * 1e6))], "n_ids long, repeated boolean, n_bytes long")


@_query(f"SELECT record_id, CASE WHEN {_VALID} THEN {_U(f'unhex({_DIGITS})')} END AS read_id FROM file_records")
def canonical_ids(spark, sf):
    return table(spark, sf, "file_records").select("record_id", ids.canonical("read_id").alias("read_id"))


@_query(f"SELECT count(*) AS n_rows, count(DISTINCT {_ACQ('acquisition_id')}) AS n_dests FROM file_records WHERE {_VALID} AND acquisition_id IS NOT NULL")
def split_outputs(spark, sf):
    """Outputs of more reads than a container takes become several; none is lost and none holds more."""
    rows = table(spark, sf, "file_records").filter(ids.uuid_bin("read_id").isNotNull()).select("record_id", F.concat(acquisition_key("acquisition_id"), F.lit(".container")).alias("dest")).dropna()
    routed = route.routed_for_writing(rows, reads_a_file=100)
    sizes = routed.groupBy("dest").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.sum("n").alias("n_rows"), F.countDistinct(F.regexp_replace("dest", r"(-\d{5})?\.container$", "")).alias("n_dests"))


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
