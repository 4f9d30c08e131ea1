"""docquarry: streaming."""
