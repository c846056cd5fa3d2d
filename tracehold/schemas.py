"""Schemas of the tables that the operators share."""

from __future__ import annotations

EVENTS = "id string, ts timestamp, class_uid int, source string, asset_id string, process_guid string, parent_process_guid string, username string, conn_tuple string, raw string"
ENVELOPE = "version int, id string, partition_key string, timestamp timestamp, class_uid int, source string, asset_id string, asset_os string, process_guid string, parent_process_guid string, username string, conn_tuple string, fingerprint_suffix string, raw string"
ASSETS = "id string, hostname string, os string, ip_addrs array<string>, agent_id string, first_seen timestamp, last_seen timestamp"
ALERTS = "id string, ts timestamp, rule_id string, severity int, event_id string, asset_id string, incident_id string, count bigint, last_ts timestamp"
INCIDENTS = "id string, created_at timestamp, status string, graph string, ai_verdict string, title string, notified_at timestamp"
INTEL = "id string, created_at timestamp, kind string, value string, source string, severity int, note string, expires_at timestamp, matched_count bigint, last_matched_at timestamp"
SUPPRESSIONS = "id string, created_at timestamp, rule_id string, asset_id string, reason string, created_by string, expires_at timestamp, matched_count bigint, last_matched_at timestamp"
BASELINES = "asset_id string, exe_path string, first_seen timestamp"
COMMANDS = "id string, created_at timestamp, kind string, status string, dry_run boolean, asset_id string, incident_id string, process_guid string, issued_by string, detail string, completed_at timestamp"
AUDIT = "id string, ts timestamp, username string, action string, target string, detail string, remote_addr string"
AGENT_EVENTS = "agent_id string, ts_unix_ns bigint, class_uid int, process_guid string, username string, conn_tuple string, raw_json string, parent_process_guid string, dropped_events bigint"
FLOW_RECORDS = (
    "start_unix_ns bigint, end_unix_ns bigint, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, src_packets bigint, src_bytes bigint, dst_packets bigint, dst_bytes bigint, tcp_flags int, "
    "dns_query string, tls_sni string, ja3 string, http_host string, http_uri string, http_user_agent string, dns_rcode string, dns_answers array<string>, ja3s string, "
    "tls_cert_subject string, tls_cert_issuer string, tls_cert_self_signed boolean, tls_cert_not_before string, tls_cert_not_after string"
)
PACKETS = "ts_ns bigint, src_ip string, dst_ip string, sport int, dport int, proto int, tcp_flags int, frame_len bigint"
STARTS = "host string, ts timestamp, pid int, ppid int, activity int"
SNAPSHOTS = "host string, kind string, snap_ts timestamp, key string, value string"
SYSLOG = "line string, from_ip string, received_at timestamp"
CORPUS = "technique string, name string, case_name string, source string, class_uid int, os string, event string, expect string"
