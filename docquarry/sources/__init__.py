"""docquarry: sources."""
