from lossledger.functions.columns import (
    bucket_label,
    clean_number,
    clip_to_capacity,
    code_base,
    cyclic_features,
    device_id,
    energy_kwh,
    epoch_seconds,
    month_of,
    parse_minute,
    severity_class,
    ticket_text,
    try_parse_minute,
    utc_naive,
    within,
)

__all__ = [
    "bucket_label",
    "clean_number",
    "clip_to_capacity",
    "code_base",
    "cyclic_features",
    "device_id",
    "energy_kwh",
    "epoch_seconds",
    "month_of",
    "parse_minute",
    "severity_class",
    "ticket_text",
    "try_parse_minute",
    "utc_naive",
    "within",
]
