"""Steps: functions from a Dataset (and settings) to a Dataset."""
