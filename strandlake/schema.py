"""Columns of the three tables. Order and names are fixed values of the format."""

from __future__ import annotations

READS = (
    "read_id binary, signal array<bigint>, read_number bigint, start bigint, median_before float, num_minknow_events bigint, "
    "tracked_scaling_scale float, tracked_scaling_shift float, predicted_scaling_scale float, predicted_scaling_shift float, "
    "num_reads_since_mux_change bigint, time_since_mux_change float, num_samples bigint, channel int, well smallint, pore_type string, "
    "calibration_offset float, calibration_scale float, end_reason string, end_reason_forced boolean, run_info string, open_pore_level float"
)
RUN_INFO = (
    "acquisition_id string, acquisition_start_time timestamp, adc_max smallint, adc_min smallint, context_tags map<string,string>, "
    "experiment_name string, flow_cell_id string, flow_cell_product_code string, protocol_name string, protocol_run_id string, "
    "protocol_start_time timestamp, sample_id string, sample_rate int, sequencing_kit string, sequencer_position string, "
    "sequencer_position_type string, software string, system_name string, system_type string, tracking_id map<string,string>"
)
SIGNAL = "read_id binary, signal array<smallint>, samples bigint"
SIGNAL_PACKED = "read_id binary, signal binary, samples bigint"


def names(ddl: str) -> list[str]:
    """Column names of a DDL without nested structs."""
    return [part.strip().split(" ")[0] for part in ddl.replace("<string,string>", "").split(",")]


READS_V4 = names(READS)
READS_V3 = [c for c in READS_V4 if c != "open_pore_level"]
RUN_INFO_COLUMNS = names(RUN_INFO)
