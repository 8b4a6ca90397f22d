from sensorloom.streaming.panelog import PaneLog, changelog, closed_windows, corrected_windows, current_windows, last_batch, open_windows, run_panes, state_rows, stream_panes
from sensorloom.streaming.upsert import final_state, run_to_end, stream_windows

__all__ = ["PaneLog", "changelog", "closed_windows", "corrected_windows", "current_windows", "final_state", "last_batch", "open_windows", "run_panes", "run_to_end", "state_rows", "stream_panes", "stream_windows"]
