"""Explicit schemas of the stored and exchanged records; nothing is inferred."""

from __future__ import annotations

_MEMORY = "struct<total:string,used:string,free:string>"
GPU_SNAPSHOT = (
    "driver_version string, gpu array<struct<product_name:string,uuid:string,minor_number:string,"
    f"utilization:struct<gpu_util:string>,fb_memory_usage:{_MEMORY},bar1_memory_usage:{_MEMORY}>>"
)
SLOT_NUMBERS = ["rank", "localRank", "crossRank", "size", "localSize", "crossSize"]
# Numbers come bare or quoted, so they are read as text first.
SLOT_PLAN = f"array<struct<hostname:string,{','.join(f'{n}:string' for n in SLOT_NUMBERS)}>>"
PROPERTY = "name string, value string, final string, source array<string>"
