from sensorloom.functions.aggregates import exact_avg, nearest_rank, rounded_mean, sorted_values
from sensorloom.functions.exact import exact_sums
from sensorloom.functions.values import scale_of, sensor_name, text_of

__all__ = ["exact_avg", "exact_sums", "nearest_rank", "rounded_mean", "scale_of", "sensor_name", "sorted_values", "text_of"]
