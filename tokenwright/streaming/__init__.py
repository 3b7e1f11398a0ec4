"""Running token accounts over request logs that are still being written."""
