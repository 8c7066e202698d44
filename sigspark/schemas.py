"""Schemas of the input tables, as Spark DDL."""

SDP = (
    "STRUCT<origin:STRUCT<user:STRING,sess_id:STRING,sess_version:STRING,addr:STRING>,connection:STRING,"
    "session_attrs:ARRAY<STRING>,media:ARRAY<STRUCT<type:STRING,port:INT,proto:STRING,ptime:INT,direction:STRING,"
    "attrs:ARRAY<STRING>,payloads:ARRAY<STRUCT<pt:INT,codec:STRING,rate:INT,fmtp:STRING>>>>>"
)
PACKETS = (
    "capture_id STRING, n BIGINT, ts TIMESTAMP, src STRING, dst STRING, sport INT, dport INT, transport STRING, "
    "payload BINARY, tcp STRUCT<seq:BIGINT,syn:BOOLEAN,fin:BOOLEAN>, fragmented BOOLEAN, wire_bytes INT"
)
FRAGMENTS = (
    "capture_id STRING, src STRING, dst STRING, ip_id INT, proto INT, off INT, more BOOLEAN, data BINARY, ts TIMESTAMP, wire_bytes INT"
)
RAW_MESSAGES = "capture_id STRING, msg_id STRING, ord BIGINT, ts TIMESTAMP, src STRING, dst STRING, sport INT, dport INT, transport STRING, raw STRING"
ISUP = "STRUCT<message_type:STRING,cause_code:INT,called:STRING,calling:STRING>"
Q931 = (
    "capture_id STRING, msg_id STRING, ts TIMESTAMP, src STRING, dst STRING, sport INT, dport INT, q931_type STRING, "
    "call_ref INT, calling STRING, called STRING, cause_code INT, guid STRING"
)
RTP = (
    "capture_id STRING, n BIGINT, ts TIMESTAMP, src STRING, dst STRING, sport INT, dport INT, ssrc BIGINT, seq INT, rtp_ts BIGINT, "
    "pt INT, marker BOOLEAN, bytes INT, event INT, event_end BOOLEAN, event_duration INT"
)
RTCP = (
    "capture_id STRING, ts TIMESTAMP, src STRING, dst STRING, type STRING, sender_ssrc BIGINT, ntp_mid BIGINT, block_ssrc BIGINT, "
    "fraction_lost INT, cumulative_lost INT, lsr BIGINT, dlsr BIGINT"
)
DNS = (
    "capture_id STRING, ts TIMESTAMP, src STRING, sport INT, dst STRING, dport INT, txid INT, is_response BOOLEAN, qname STRING, "
    "qtype STRING, rcode STRING, answers ARRAY<STRUCT<name:STRING,type:STRING,ttl:BIGINT,value:STRING>>"
)
DIAMETER = (
    "capture_id STRING, ts TIMESTAMP, src STRING, sport INT, dst STRING, dport INT, is_request BOOLEAN, command STRING, app_id BIGINT, "
    "hop_by_hop BIGINT, session_id STRING, charging_id STRING, result_code INT, experimental_code INT"
)
STUN = (
    "capture_id STRING, ts TIMESTAMP, src STRING, sport INT, dst STRING, dport INT, txid STRING, class STRING, username STRING, "
    "use_candidate BOOLEAN, error_code INT, mapped STRING"
)
DTLS = (
    "capture_id STRING, ts TIMESTAMP, src STRING, sport INT, dst STRING, dport INT, content_type INT, handshake STRING, "
    "alert STRUCT<level:STRING,description:STRING>, profile STRING"
)
RULES = (
    "rule_id STRING, set_name STRING, ord INT, name STRING, direction STRING, msg_type STRING, methods ARRAY<STRING>, "
    "conditions ARRAY<STRUCT<element:STRING,comparison:STRING,value:STRING>>, target_header STRING, target_element STRING, "
    "operation STRING, value STRING, bindings ARRAY<STRING>"
)
