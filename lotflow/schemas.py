"""Input schemas, as DDL strings."""

MOVEMENT = (
    "event_id string, trace_parent string, aggregate_id string, occurred_at timestamp, published_at timestamp, cdc_emit_ts timestamp, "
    "sequence_engine_key string, movement_type int, sku string, mdm_vendor_id string, location_id string, quantity string, unit_cost string"
)
VENDOR_EMAIL = (
    "event_id string, trace_parent string, aggregate_id string, occurred_at timestamp, published_at timestamp, cdc_emit_ts timestamp, sequence_engine_key string, "
    "visualization_stage int, intent_classification int, vendor_email string, mdm_vendor_id string, secure_subject_uri string, secure_body_uri string, "
    "attachments array<struct<file_name:string,mime_type:string,secure_storage_uri:string,sha256_hash:string>>"
)
APPROVAL = "event_id string, trace_parent string, sequence_engine_key string, approved_by string"
RECORD = "topic string, partition int, offset bigint, key string, value string, headers array<struct<key:string,value:binary>>"

RECEIPT, CONSUMPTION, ADJUSTMENT = 1, 2, 3
KEYS = ("sku", "location_id")
ORDER = ("sequence_engine_key", "event_id")
