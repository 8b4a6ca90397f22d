from sensorloom.sources.generator import generate_events
from sensorloom.sources.tables import as_events, read_events, read_table, stream_events
from sensorloom.sources.text import ParseMetrics, parse_lines, read_lines, read_text_events, stream_text_events
from sensorloom.sources.sinks import write_lines, write_with_manifest

__all__ = ["ParseMetrics", "as_events", "generate_events", "parse_lines", "read_events", "read_lines", "read_table", "read_text_events", "stream_events", "stream_text_events", "write_lines", "write_with_manifest"]
