"""Names and schemas of the telemetry model."""

from __future__ import annotations

#: The 17 port counters in their order, and our names for their deltas.
COUNTER_KINDS = (
    "SymbolErrors", "LinkDowned", "PortRcvErrors", "PortXmitDiscards", "PortRcvData", "PortXmitData",
    "PortRcvRemotePhysicalErrors", "LocalLinkIntegrityErrors", "ExcessiveBufferOverrunErrors", "LinkErrorRecovery",
    "HwRcvPkts", "HwXmitPkts", "RxeDuplicateRequest", "RxeSeqError", "RxeRetryExceeded", "RxeSendError", "PortXmitWait",
)
DELTAS = (
    "symbol_errors", "link_downed", "rcv_errors", "xmit_discards", "rcv_data", "xmit_data",
    "remote_physical_errors", "integrity_errors", "buffer_overruns", "link_recovery",
    "rcv_pkts", "xmit_pkts", "rxe_duplicate_request", "rxe_seq_error", "rxe_retry_exceeded", "rxe_send_error", "xmit_wait",
)

#: File names of the port counters and what they count.
COUNTER_FILES = {
    "symbol_error": "SymbolErrors", "link_downed": "LinkDowned", "port_rcv_errors": "PortRcvErrors", "port_xmit_discards": "PortXmitDiscards",
    "port_rcv_data": "PortRcvData", "port_xmit_data": "PortXmitData", "port_rcv_remote_physical_errors": "PortRcvRemotePhysicalErrors",
    "local_link_integrity_errors": "LocalLinkIntegrityErrors", "excessive_buffer_overrun_errors": "ExcessiveBufferOverrunErrors",
    "link_error_recovery": "LinkErrorRecovery", "port_xmit_wait": "PortXmitWait", "rcvd_pkts": "HwRcvPkts", "sent_pkts": "HwXmitPkts",
    "duplicate_request": "RxeDuplicateRequest", "rcvd_seq_err": "RxeSeqError", "retry_exceeded_err": "RxeRetryExceeded", "send_err": "RxeSendError",
}

STATES = ("HEALTHY", "DEGRADED", "CRITICAL", "RECOVERING")

#: Capabilities, their weight in the fusion sum, and the quality weights.
CAPABILITY_WEIGHTS = {
    "LinkErrors": 1.0, "Throughput": 0.0, "CompletionLatency": 0.6, "RetransmitSignal": 0.8, "NakRate": 0.7, "OutOfOrder": 0.4, "PfcPause": 0.5,
    "EcnMarks": 0.4, "CnpRate": 0.4, "CreditStall": 0.5, "QpAttribution": 0.0, "ProcessAttribution": 0.0, "PeerLiveness": 0.6,
}
QUALITY_WEIGHTS = {"High": 1.0, "Medium": 0.7, "Low": 0.4, "Absent": 0.0}

#: One event of any kind; absent fields are null.
EVENT_SCHEMA = "node_id long, event_id long, timestamp_ns long, kind string, cpu int, bytes_req long, bytes_alloc long, latency_ns long, numa_node int, bytes_freed long, irq int, name_hash decimal(20,0), budget long, work_done long, len long, queue_pair_num long, is_error boolean, opcode int, device string, port_num int, counter_kind string, counter_value decimal(20,0)"

#: The scenario file: events are one-key maps of a kind's fields.
SCENARIO_SCHEMA = (
    "name string, description string, events array<map<string, struct<timestamp_ns: bigint, cpu: int, bytes_req: bigint, bytes_alloc: bigint, "
    "latency_ns: bigint, numa_node: int, bytes_freed: bigint, irq: int, handler_name_hash: decimal(20,0), budget: bigint, work_done: bigint, "
    "dev_name_hash: decimal(20,0), len: bigint, queue_pair_num: bigint, is_error: boolean, opcode: int, port_num: int, counter: map<string, decimal(20,0)>>>>, "
    "expected_states array<struct<after_event_index: int, expected_state: string>>"
)
