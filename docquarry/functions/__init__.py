"""docquarry: functions."""
