"""docquarry: plans."""
