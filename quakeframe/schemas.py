"""Explicit schemas: nothing is inferred from files."""

from __future__ import annotations

COMPONENTS = ("Z", "N", "E")

COMPONENT_RECORDS = "event_id string, station_id string, component string, samples array<float>, event_attrs map<string,string>, station_attrs map<string,string>, channel_attrs map<string,string>"

#: (column, source map, key, kind, default) of every attribute column of the trace table.
ATTRIBUTES = (
    ("trace_p_arrival_sample", "station_attrs", "p_arrival_sample", "int", None),
    ("trace_s_arrival_sample", "station_attrs", "s_arrival_sample", "int", None),
    ("trace_p_arrival_time", "station_attrs", "p_arrival_utc", "time", None),
    ("trace_s_arrival_time", "station_attrs", "s_arrival_utc", "time", None),
    ("trace_p_status", "station_attrs", "pick_source_p", "string", None),
    ("trace_s_status", "station_attrs", "pick_source_s", "string", None),
    ("trace_p_snr_db", "station_attrs", "final_snr_p", "double", None),
    ("trace_s_snr_db", "station_attrs", "final_snr_s", "double", None),
    ("trace_p_in_window", "station_attrs", "p_arrival_in_trace", "bool", None),
    ("trace_s_in_window", "station_attrs", "s_arrival_in_trace", "bool", None),
    ("trace_p_residual_s", "station_attrs", "p_TRes", "double", None),
    ("trace_s_residual_s", "station_attrs", "s_TRes", "double", None),
    ("trace_p_theoretical_time", "station_attrs", "p_theo_arrival", "time", None),
    ("trace_s_theoretical_time", "station_attrs", "s_theo_arrival", "time", None),
    ("trace_p_manual_time", "station_attrs", "p_manual_arrival", "time", None),
    ("trace_s_manual_time", "station_attrs", "s_manual_arrival", "time", None),
    ("trace_start_time", "station_attrs", "reference_starttime_utc", "time", None),
    ("trace_completeness", "station_attrs", "status_counts", "string", "ok"),
    ("path_back_azimuth_deg", "station_attrs", "back_azimuth", "double", None),
    ("path_ep_distance_km", "station_attrs", "epi_dist", "double", None),
    ("path_hyp_distance_km", "station_attrs", "hyp_dist", "double", None),
    ("source_origin_time", "event_attrs", "time", "time", None),
    ("source_latitude_deg", "event_attrs", "latitude", "double", None),
    ("source_longitude_deg", "event_attrs", "longitude", "double", None),
    ("source_depth_km", "event_attrs", "depth", "double", None),
    ("source_magnitude", "event_attrs", "magnitude", "double", None),
    ("source_catalog", "event_attrs", "source", "string", None),
    ("source_gap_deg", "event_attrs", "gap", "double", None),
    ("source_nsta", "event_attrs", "Nsta", "int", None),
    ("source_npha", "event_attrs", "Npha", "int", None),
    ("source_tres_mae_s", "event_attrs", "TRes_MAE", "double", None),
    ("source_tres_mad_s", "event_attrs", "TRes_MAD", "double", None),
    ("source_origin_time_raw", "event_attrs", "raw_time", "time", None),
    ("source_latitude_raw_deg", "event_attrs", "raw_lat", "double", None),
    ("source_longitude_raw_deg", "event_attrs", "raw_lon", "double", None),
    ("source_depth_raw_km", "event_attrs", "raw_depth", "double", None),
)

_SQL = {"string": "string", "double": "double", "int": "int", "bool": "boolean", "time": "timestamp_ntz"}
TRACES = ", ".join([
    "trace_name string", "trace_chunk string", "trace_sampling_rate_hz double", "trace_dt_s double", "trace_npts int", "trace_component_order string", "trace_units string",
    "station_network_code string", "station_code string", "station_location_code string", "station_channel string", "source_id string", "source_magnitude_type string",
    *(f"{name} {_SQL[kind]}" for name, _, _, kind, _ in ATTRIBUTES), "station_latitude_deg double", "station_longitude_deg double", "station_elevation_m double", "station_region string",
    "trace_status_physical string", "trace_missing_response_components string", "trace_unit_physical string", "trace_sensitivity_z double", "trace_sensitivity_n double", "trace_sensitivity_e double",
    "z array<float>", "n array<float>", "e array<float>",
])

STATIONS = "station string, latitude string, longitude string, elevation string, elevation_m string, region string"
EVENT_INDEX = "trace_name string, p_sample int, s_sample int, p_sample_original int, s_sample_original int, ps_residual_sec double, ps_group string"
NOISE_INDEX = "trace_name string"
SWEEP = "model string, phase string, threshold double, tp bigint, fp bigint, fn bigint, precision double, recall double, f1 double, mae_s double, rmse_s double, median_s double, iqr_s double, n_residuals bigint, mcc_phase_id double, mcc_phase_accuracy double, mcc_n_pairs bigint, mcc_n_phase_confusions bigint, det_recall double, det_iou_mean double, det_per_trace_mean double, det_start_mae_s double, det_end_mae_s double, n_evaluated bigint"
NOISE_TALLY = "n_noise bigint, n_traces_with_pick bigint, n_p bigint, n_s bigint, n_total bigint, mean_per_trace double, max_per_trace bigint, median_per_trace double, fp_rate double"
EVENT_CATALOGUE = "event_id string, time timestamp_ntz, latitude double, longitude double, depth double, magnitude double, source string"
PICK_CATALOGUE = "event_id string, station_id string, phase string, time timestamp_ntz, source string, snr double"
