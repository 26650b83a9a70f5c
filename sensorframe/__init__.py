"""sensorframe: sensor-evidence analytics on Spark DataFrames.

Frames -> detections -> tracks -> representations / anomaly observations ->
events -> alerts -> cross-sensor fusion, plus detector evaluation, data
contracts and run summaries.  Every public operator takes and returns
DataFrames whose rows carry ``run_id``, so one job processes many runs.
"""

__version__ = "0.1.0"
