from sensorloom.operators.combine import all_windows, numbered, ordered, same_rows, union_of_both
from sensorloom.operators.difference import difference, differing_leaves, leaves
from sensorloom.operators.render import line_of, lines_in_order, lines_of_both, sliding_lines, to_lines, tumbling_lines
from sensorloom.operators.routing import hot_sensors, split_by_heat, windows_by_heat
from sensorloom.operators.selection import cells_of, keyed, narrowed, ranked_counts
from sensorloom.operators.windows import assign_windows, both_from_panes, both_in_blocks, from_epoch, key_domain, pane_states, panes, sliding_counted, sliding_from_panes, sliding_in_blocks, sliding_percentiles, sliding_percentiles_disc, tumbling_stats, within_horizon

__all__ = ["all_windows", "assign_windows", "both_from_panes", "both_in_blocks", "cells_of", "difference", "differing_leaves", "from_epoch", "hot_sensors", "key_domain", "keyed", "leaves", "line_of", "lines_in_order", "lines_of_both", "narrowed", "numbered", "ordered", "pane_states", "panes", "ranked_counts", "same_rows", "sliding_counted", "sliding_from_panes", "sliding_in_blocks", "sliding_lines", "sliding_percentiles", "sliding_percentiles_disc", "split_by_heat", "to_lines", "tumbling_lines", "tumbling_stats", "union_of_both", "windows_by_heat", "within_horizon"]
